"""What the operators share: the shared folder, tables written between steps, and skew-proof prefix sums."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACES = b" \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a folder of this machine only where that is unset and all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir is unset: driver and executors need a folder that they share")
        found = "file://" + tempfile.mkdtemp(prefix="loculus-")
        atexit.register(shutil.rmtree, found[7:], ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: No shuffle has more tasks than this, whatever the input; a task takes several of what is dealt by number.
MOST_TASKS = 1 << 15


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: df written as Parquet in the shared folder and read again. Lost executors lose none of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._loculus_path = path
    return out


def drop_table(df: DataFrame) -> None:
    """Deletes a table of write_table that no later step reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(df._loculus_path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished steps now instead of at the driver's next garbage collection."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def tidy() -> None:
    """Gives what a Python worker has freed back to the machine; workers live on, and what they keep adds up over steps."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def light(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f, a function of mapInArrow, with a worker tidied after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            tidy()

    return run


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Texts are long: fewer rows in an Arrow batch keep Python workers small. A setting of the session, as Spark has it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """What is written within has Arrow batches of so many rows, for rows that are large themselves; then the session's setting is as before."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def read_table(spark: SparkSession, sf_dir: str, name: str, rows: int = 1000) -> DataFrame:
    small_batches(spark, rows)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def prefix_sums(df: DataFrame, key: str | None, order: list[str], sums: dict[str, str], name: str) -> DataFrame:
    """Adds for each new column of sums (new column: long column to add up) the sum over all earlier rows of the same key.

    Rows are dealt by ranges of (key, order), so a key with a third of all rows spreads over as many tasks as its share
    needs. Each task adds up its own rows once; what a key has in earlier tasks is added after that, a table with at most
    one row a task, which is broadcast. Null keys are one key. Rows equal in key and order may come in either order.
    """
    spark = df.sparkSession
    by = ([key] if key else []) + order
    taken = set(df.columns)
    parts = shuffle_parts(spark)
    ranged = df.repartitionByRange(parts, *[F.col(c).asc_nulls_last() for c in by]).sortWithinPartitions(*[F.col(c).asc_nulls_last() for c in by])
    if "_pid" in taken or taken & set(sums):
        raise ValueError("the table already has a column _pid or one of the new columns")
    out = T.StructType([*df.schema.fields, T.StructField("_pid", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in sums]])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid, last, carry = TaskContext.get().partitionId(), None, dict.fromkeys(sums, 0)
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.num_rows
            new = np.zeros(n, bool)
            if key:
                values = batch.column(batch.schema.get_field_index(key))
                codes = values.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                new[1:] = codes[1:] != codes[:-1]
                first, end = values[0].as_py(), values[n - 1].as_py()
                if last is None or last[0] != first:
                    new[0] = True
                last = (end,)
            starts = np.flatnonzero(new)
            group = np.cumsum(new)
            cols = []
            for c, value in sums.items():
                v = batch.column(batch.schema.get_field_index(value)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                before = np.cumsum(v) - v
                base = np.concatenate([[-carry[c]], before[starts]])
                got = before - base[group]
                carry[c] = int(got[-1] + v[-1])
                cols.append(pa.array(got, pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, pid, np.int32)), *cols], names=[*batch.schema.names, "_pid", *sums])

    table = write_table(ranged.mapInArrow(light(local), out), name)
    keyed = F.col(key) if key else F.lit(0)
    totals = table.groupBy("_pid", keyed.alias("_key")).agg(*[F.sum(v).alias(f"_of_{c}") for c, v in sums.items()])
    earlier = Window.partitionBy("_key").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(F.col("_pid").alias("_at"), "_key", F.row_number().over(Window.partitionBy("_key").orderBy("_pid")).alias("_n"), *[F.coalesce(F.sum(f"_of_{c}").over(earlier), F.lit(0)).alias(f"_of_{c}") for c in sums]).filter("_n > 1").drop("_n")
    joined = table.join(F.broadcast(before), (table["_pid"] == before["_at"]) & (keyed.eqNullSafe(before["_key"])), "left")
    return joined.select(*df.columns, *[(F.col(c) + F.coalesce(F.col(f"_of_{c}"), F.lit(0))).alias(c) for c in sums])


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in whatever letter case."""
    taken, out = {c.lower() for c in df.columns}, f"_{name}"
    while out.lower() in taken:
        out = "_" + out
    return out


def join_spread(left: DataFrame, right: DataFrame, key: str, count: str, hot: int = 4096) -> DataFrame:
    """left joined with right by key; right has each key once and in count how many rows of left have it.

    Keys with over 1 / hot of all rows, at most `hot`, are broadcast, so that their rows stay where they are; no task gets more
    than its share. Both sides are read twice.
    """
    total = right.agg(F.sum(count)).first()[0] or 0
    often = right.filter(F.col(count) * hot > total).drop(count)
    rest = right.filter(F.col(count) * hot <= total).drop(count)
    return left.join(F.broadcast(often), key).unionByName(left.join(F.broadcast(often.select(key)), key, "left_anti").join(rest, key))


def labelled(spark: SparkSession, labels: DataFrame, column: str) -> DataFrame:
    """Labels that may be learnt from: doc_id, label of rows whose crc32(doc_id as text) mod 5 is not 0; a doc_id labelled twice counts once, by its larger label."""
    return labels.filter(F.col(column).isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)).groupBy("doc_id").agg(F.max(F.col(column)).cast("int").alias("label"))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))
