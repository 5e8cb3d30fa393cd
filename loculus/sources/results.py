"""Result logs, result files, maps as JSON, prompts, and their summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loculus.functions.questions import task_kind
from loculus.functions.tables import CHOICE_TASKS, NUMERIC_TASKS

# Fixed value: a result's line in a log.
LINE = r"\[([^\]]+)\]\s+ans=(\S+)\s+gt=(\S+)\s+score=([\d.]+)(?:.*?V7=([\d.]+))?"
SAMPLES = "task string, answer string, ground_truth string, score double, v7 double, source string"
DETAILED = "scene_name string, question_type string, question string, options array<string>, ground_truth string, prediction string, score double, v7_vl_score double, vl_score double"


def parse_lines(lines: DataFrame) -> DataFrame:
    """lines: value, source. One row for each line with a result."""
    g = lambda k: F.nullif(F.regexp_extract("value", LINE, k), F.lit(""))
    return lines.filter(F.col("value").rlike(LINE)).select(g(1).alias("task"), g(2).alias("answer"), g(3).alias("ground_truth"), g(4).cast("double").alias("score"), g(5).cast("double").alias("v7"), "source")


def read_logs(spark: SparkSession, base: str, workers: int | None = None) -> DataFrame:
    paths = [f"{base}/gpu*.log"] if workers is None else [f"{base}/gpu{k}.log" for k in range(workers)]
    return parse_lines(spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("source")))


def read_detailed(spark: SparkSession, paths: list[str]) -> DataFrame:
    d = spark.read.schema(DETAILED).option("multiLine", True).json(paths).select("*", F.col("_metadata.file_path").alias("source"))
    return d.select(F.col("question_type").alias("task"), F.col("prediction").alias("answer"), "ground_truth", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("v7_vl_score", "vl_score").alias("v7"), "source")


def read_samples(spark: SparkSession, base: str, workers: int | None = None) -> DataFrame:
    """Logs if there are any, else result files."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    fs = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = lambda glob: bool(fs.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base}/{glob}")))
    if there("gpu*.log"):
        return read_logs(spark, base, workers)
    if there("detailed_results.json"):
        return read_detailed(spark, [f"{base}/detailed_results.json"])
    if there("gpu*/detailed_results.json"):
        return read_detailed(spark, [f"{base}/gpu*/detailed_results.json"])
    raise FileNotFoundError(f"no gpu*.log or detailed_results.json under {base}")


def write_detailed(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").json(path)


def summarize(samples: DataFrame) -> DataFrame:
    """Means over all, by kind, and by task, in one pass over grouping sets: kind, task, n, score, v7, delta."""
    s = samples.withColumn("kind", task_kind(F.col("task"), CHOICE_TASKS, NUMERIC_TASKS))
    out = s.groupingSets([["kind", "task"], ["kind"], []], "kind", "task").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("score"), F.avg("v7").alias("v7"))
    return out.withColumn("delta", F.col("score") - F.col("v7"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Questions of an evaluation, under either name of each column."""
    alt = "scene_name string, scene_id string, question_type string, task_type string, question string, options array<string>, choices array<string>, ground_truth string, answer string, vl_score double, rule_score double"
    d = spark.read.schema(alt).option("multiLine", True).json(path)
    return d.select(F.coalesce("scene_name", "scene_id").alias("scene"), F.coalesce("question_type", "task_type").alias("qtype"), "question", F.coalesce("options", "choices").alias("options"), F.coalesce("ground_truth", "answer").alias("ground_truth"), F.coalesce("vl_score", F.lit(0.0)).alias("vl_score"), F.coalesce("rule_score", F.lit(0.0)).alias("rule_score"))


def read_videos(spark: SparkSession, dirs: list[str]) -> DataFrame:
    """scene, path of the videos in several folders; the first folder that has a scene wins. Contents aren't read."""
    out = None
    for k, d in enumerate(dirs):
        v = spark.read.format("binaryFile").option("pathGlobFilter", "*.mp4").load(d).select("path", F.lit(k).alias("k"))
        out = v if out is None else out.unionByName(v)
    return out.select(F.regexp_extract("path", r"([^/]+)\.mp4$", 1).alias("scene"), "path", "k").groupBy("scene").agg(F.min_by("path", "k").alias("path"))


def entity_yaml(entities: DataFrame) -> DataFrame:
    """scene, text: entities as YAML, a block each in order."""
    row = F.format_string("  - id: %s\n    category: %s\n    position: [%.2f, %.2f, %.2f]\n    count: %d", "entity_id", "label", *[F.round(f"m{c}", 9) for c in "xyz"], "count_in_frame")
    return entities.groupBy("scene").agg(F.sort_array(F.collect_list(F.struct("entity_ord", row.alias("t")))).alias("r")).select("scene", F.concat(F.lit("entities:\n"), F.array_join(F.transform("r", lambda x: x["t"]), "\n")).alias("text"))


def entity_markdown(entities: DataFrame) -> DataFrame:
    row = F.format_string("| %s | %s | (%.2f, %.2f, %.2f) | %d |", "entity_id", "label", *[F.round(f"m{c}", 9) for c in "xyz"], "count_in_frame")
    return entities.groupBy("scene").agg(F.sort_array(F.collect_list(F.struct("entity_ord", row.alias("t")))).alias("r")).select("scene", F.concat(F.lit("| id | category | position | count |\n|---|---|---|---|\n"), F.array_join(F.transform("r", lambda x: x["t"]), "\n")).alias("text"))


def grid_text(entities: DataFrame, cells: DataFrame, scale: DataFrame) -> DataFrame:
    """scene, text: scale, number of entities, and a line for each by id."""
    e = entities.join(cells, ["scene", "label"]).join(scale.select("scene", "mpg", "scf"), "scene")
    line = F.format_string("  - %s: category=%s, grid=(%d,%d,%d), phys_size=%.2fm, count=%d, conf=%.2f, first_frame=%d", "entity_id", "label", "gx", "gy", "gz", F.greatest("w3", "h3") * F.col("scf"), "count_in_frame", "confidence", "first_seen")
    return e.groupBy("scene").agg(F.sort_array(F.collect_list(F.struct("entity_id", line.alias("t")))).alias("r"), F.first("mpg").alias("mpg")).select("scene", F.concat(F.format_string("meters_per_grid: %.4fm\nEntities (%d):\n", "mpg", F.size("r")), F.array_join(F.transform("r", lambda x: x["t"]), "\n")).alias("text"))


def save_map(entities: DataFrame, path: str) -> None:
    entities.write.mode("overwrite").json(path)


def load_map(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """What save_map wrote, with the columns of `like`; JSON knows keys of maps as text alone, so they are read as such and turned back."""
    maps = {f.name: f.dataType for f in like.schema if isinstance(f.dataType, T.MapType)}
    text = T.StructType([T.StructField(f.name, T.MapType(T.StringType(), f.dataType.valueType) if f.name in maps else f.dataType) for f in like.schema])
    turned = lambda c, kind: F.transform_keys(c, lambda k, v: k.cast(kind))
    return spark.read.schema(text).json(path).withColumns({c: turned(c, t.keyType) for c, t in maps.items()})
