"""Session defaults for tests, benchmarks and notebooks; a cluster brings its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "loculus", cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with adaptive execution on, UTC, and no UI."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that lineage is cut in: spark.checkpoint.dir; a temporary one only where that is unset and all runs on one machine, as in tests."""
    import atexit
    import shutil
    import tempfile

    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir is unset: driver and executors need a folder that they share")
        found = "file://" + tempfile.mkdtemp(prefix="loculus-")
        atexit.register(shutil.rmtree, found[7:], ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """df worked out once and kept in the checkpoint folder, for what is small and read by many parts of a plan: its readers' plans end there, and a lost executor loses none of it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()
