"""The engine's inputs, read off the TPC-H-like tables; and the same as SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loculus.functions.tables import CALIBRATION_SIZES, COMMON_RANGES, SYNONYMS, TEST_RANGES, TEST_SIZES, TEST_SYNONYMS

ALL_SYNONYMS = {**SYNONYMS, **TEST_SYNONYMS}
ALL_SIZES, ALL_RANGES = CALIBRATION_SIZES + TEST_SIZES, COMMON_RANGES + TEST_RANGES
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


DETECTIONS = """
SELECT l_suppkey AS scene, p_name AS label, l_linenumber - 1 AS frame_order, (l_linenumber - 1) * 30 AS frame_idx,
  confidence, depth_std, 0.5D * depth_std + 0.5D * (1D - confidence) AS position_uncertainty, x, y, z, width_3d, height_3d, z AS depth_value,
  row_number() OVER (PARTITION BY l_suppkey ORDER BY l_linenumber, confidence DESC, l_orderkey, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS det_ord
FROM (SELECT l.*, p_name, 0.95D - 5.0D * l_discount AS confidence, 0.05D + 5.0D * l_tax AS depth_std, l_quantity / 5.0D AS x, (l_orderkey % 97) / 40.0D AS y, l_extendedprice / 10000.0D AS z,
  p_size / 25.0D AS width_3d, p_retailprice / 1000.0D AS height_3d FROM {lineitem} l JOIN {part} p ON l_partkey = p_partkey)
"""


#: What detections() runs: the rows of DETECTIONS. Scenes are dealt under the name that later steps group by, so groups and joins of a scene
#: need no further shuffle, and what follows from other columns is worked out after it, so it isn't sent.
DEALT = """
SELECT scene, label, l_linenumber - 1 AS frame_order, (l_linenumber - 1) * 30 AS frame_idx, confidence, 0.05D + 5.0D * l_tax AS depth_std,
  0.5D * (0.05D + 5.0D * l_tax) + 0.5D * (1D - confidence) AS position_uncertainty, l_quantity / 5.0D AS x, (l_orderkey % 97) / 40.0D AS y, l_extendedprice / 10000.0D AS z,
  p_size / 25.0D AS width_3d, p_retailprice / 1000.0D AS height_3d, l_extendedprice / 10000.0D AS depth_value, det_ord
FROM (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY l_linenumber, confidence DESC, l_orderkey, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS det_ord
  FROM (SELECT l_suppkey AS scene, l.* EXCEPT (l_suppkey), p_name AS label, p_size, p_retailprice, 0.95D - 5.0D * l_discount AS confidence FROM {lineitem} l JOIN {part} p ON l_partkey = p_partkey))
"""


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """3-D detections: an order line is one, its supplier the scene, its part the label, its line number the frame."""
    return spark.sql(DEALT, lineitem=read(spark, sf_dir, "lineitem"), part=read(spark, sf_dir, "part"))


def cameras(det: DataFrame) -> DataFrame:
    """A camera for each frame of a scene: cx, cy, cz, looking along z."""
    return det.groupBy("scene", "frame_order", "frame_idx").agg(F.avg("x").alias("cx"), F.lit(1.5).alias("cy"), F.min("z").alias("cz"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points with colours in [0, 1]."""
    li = read(spark, sf_dir, "lineitem")
    return li.select(F.col("l_suppkey").alias("scene"), (F.col("l_quantity") / 5.0).alias("x"), ((F.col("l_orderkey") % 97) / 40.0).alias("y"), (F.col("l_extendedprice") / 10000.0).alias("z"), (F.col("l_quantity") / 50).alias("r"), (F.col("l_discount") * 10).alias("g"), (F.col("l_tax") * 12.5).alias("b"), (F.col("l_linenumber") - 1).alias("frame_order"))


def r4(c):
    """To four decimals, halves (and what is within a billionth of them) up, without negative zero: what compared columns are given as."""
    return F.floor(c * 1e4 + 0.50001) / 1e4 + 0.0


def rounded(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*[(r4(F.col(c)).alias(c) if k in ("double", "float") else F.col(c)) for c, k in df.dtypes if not keep or c in keep])


def d4(expr: str) -> str:
    return f"floor(({expr}) * 1e4 + 0.50001) / 1e4 + 0.0"


def vf(x: str, size: float) -> str:
    """voxel_floor in DuckDB."""
    return f"floor(({x}) / {size} + 1e-9)"


def vt(x: str, size: float) -> str:
    """voxel_trunc in DuckDB."""
    return f"trunc(({x}) / {size} + sign({x}) * 1e-9)"


def sql_map(table: dict[str, list[str]]) -> str:
    return "MAP {" + ", ".join(f"'{k}': [{', '.join(repr(x) for x in v)}]" for k, v in table.items()) + "}"


def sql_match(t: str, label: str, synonyms: dict[str, list[str]] = ALL_SYNONYMS) -> str:
    """The fuzzy match in DuckDB; arguments in lower case without spaces around them."""
    tok = lambda s: f"list_filter(string_split_regex(translate({s}, '_-', '  '), '\\s+'), lambda w: w <> '')"
    return f"(contains({label}, {t}) OR contains({t}, {label}) OR list_has_any({tok(t)}, {tok(label)}) OR list_has_any(flatten(list_transform({tok(t)}, lambda w: coalesce({sql_map(synonyms)}[w], []))), {tok(label)}))"


def sql_dim(table: list[tuple]) -> str:
    return "(VALUES " + ", ".join(f"({k}, '{r[0]}', {float(sum(r[1:]) / (len(r) - 1))!r}::DOUBLE)" for k, r in enumerate(table)) + ") AS d(dim_ord, dim_name, dim_size)"


def _scale_sql(name: str, table: list[tuple], low: str, high: str) -> str:
    return f"""f_{name} AS (SELECT scene, count(*) AS n_{name}, median(f) AS f_{name} FROM (SELECT e.scene, m.dim_size / greatest(e.w3, e.h3) AS f, greatest(e.w3, e.h3) AS s FROM ent e JOIN
  (SELECT label, arg_min(dim_size, dim_ord) AS dim_size FROM (SELECT DISTINCT label FROM ent) n JOIN {sql_dim(table)} ON {sql_match("d.dim_name", "lower(n.label)")} GROUP BY label) m ON m.label = e.label)
  WHERE s > 0.001 AND f > {low} AND f < {high} GROUP BY scene)"""


#: Common tables of the oracles, in order; unused ones cost nothing.
CTES = {
    "det": DETECTIONS.replace("{lineitem}", "lineitem").replace("{part}", "part").replace("0.5D", "0.5::DOUBLE").replace("1D", "1::DOUBLE").replace("0.95D", "0.95::DOUBLE").replace("5.0D", "5.0::DOUBLE").replace("0.05D", "0.05::DOUBLE").replace("40.0D", "40.0::DOUBLE").replace("10000.0D", "10000.0::DOUBLE").replace("25.0D", "25.0::DOUBLE").replace("1000.0D", "1000.0::DOUBLE"),
    "cam": "SELECT scene, frame_order, frame_idx, avg(x) AS cx, 1.5::DOUBLE AS cy, min(z) AS cz FROM det GROUP BY ALL",
    "detw": "SELECT *, confidence / (greatest(position_uncertainty, 1e-4) * greatest(position_uncertainty, 1e-4)) AS w FROM det",
    "mu": "SELECT scene, label, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my, sum(w * z) / sum(w) AS mz FROM detw GROUP BY ALL",
    "frm": "SELECT scene, label, frame_idx, count(*) AS n, avg(confidence) AS conf FROM det GROUP BY ALL",
    "frs": "SELECT scene, label, greatest(1, CAST(trunc(quantile_cont(n, 0.5)) AS INTEGER)) AS count_in_frame, max(n) AS max_in_frame, string_agg(frame_idx::VARCHAR, ',' ORDER BY frame_idx) AS frames, min(frame_idx) AS first_seen FROM frm GROUP BY ALL",
    "entb": """SELECT scene, label, any_value(mx) AS mx, any_value(my) AS my, any_value(mz) AS mz,
  sum(w * (x - mx) * (x - mx)) / sum(w) AS cxx, sum(w * (x - mx) * (y - my)) / sum(w) AS cxy, sum(w * (x - mx) * (z - mz)) / sum(w) AS cxz, sum(w * (y - my) * (y - my)) / sum(w) AS cyy, sum(w * (y - my) * (z - mz)) / sum(w) AS cyz, sum(w * (z - mz) * (z - mz)) / sum(w) AS czz,
  avg(confidence) AS confidence, avg(depth_std) AS depth_std_mean, count(*) AS obs_count, min(det_ord) AS first_ord, arg_max(width_3d, (confidence, -det_ord)) AS w3, arg_max(height_3d, (confidence, -det_ord)) AS h3 FROM detw JOIN mu USING (scene, label) GROUP BY scene, label""",
    "ent": "SELECT e.*, sqrt(cxx + cyy + czz) AS position_uncertainty, count_in_frame, max_in_frame, frames, first_seen, replace(label, ' ', '_') AS entity_id, row_number() OVER (PARTITION BY scene ORDER BY first_ord) AS entity_ord FROM entb e JOIN frs USING (scene, label)",
    "plc": "SELECT scene, mx AS x, my AS y, mz AS z FROM ent UNION ALL SELECT scene, cx, cy, cz FROM cam",
    "bnq": "SELECT scene, " + ", ".join(f"quantile_cont({c}, 0.02) AS l{c}, quantile_cont({c}, 0.98) AS h{c}" for c in "xyz") + " FROM plc GROUP BY scene",
    "bna": "SELECT scene, " + ", ".join(f"CASE WHEN h{c} - l{c} < 0.5 THEN (h{c} + l{c}) / 2 - 0.5 ELSE l{c} END AS lo_{c}, CASE WHEN h{c} - l{c} < 0.5 THEN (h{c} + l{c}) / 2 + 0.5 ELSE h{c} END AS hi_{c}" for c in "xyz") + " FROM bnq",
    "bnd": "SELECT *, greatest(hi_x - lo_x, hi_y - lo_y, hi_z - lo_z) / 64 AS raw_mpg FROM bna",
    "scf": f"""WITH {_scale_sql("cal", ALL_SIZES, "0.01", "1000")}, {_scale_sql("common", ALL_RANGES, "0.005", "5000")}
  SELECT scene, raw_mpg, coalesce(n_cal, 0) AS n_cal, coalesce(n_common, 0) AS n_common, coalesce(f_cal, f_common) AS known, raw_mpg * 64 AS raw, raw_mpg * 64 * coalesce(f_cal, f_common) AS span FROM bnd LEFT JOIN f_cal USING (scene) LEFT JOIN f_common USING (scene)""",
    "scl": """SELECT scene, raw_mpg, n_cal, n_common, factor, raw_mpg * factor AS mpg, CASE WHEN raw_mpg > 1e-8 THEN raw_mpg * factor / raw_mpg ELSE 1.0 END AS scf FROM (SELECT *, CASE WHEN known IS NULL THEN CASE WHEN raw > 15 THEN 7.0 / raw WHEN raw < 2 THEN 5.0 / raw ELSE 1.0 END
  WHEN span > 25 THEN known * (1 - least(0.8, (span - 25) / 25)) + 10.0 / raw * least(0.8, (span - 25) / 25) WHEN span < 3 THEN known * (1 - least(0.7, (3 - span) / 3)) + 5.0 / raw * least(0.7, (3 - span) / 3) ELSE known END AS factor FROM scf)""",
    "pts": "SELECT l_suppkey AS scene, l_quantity / 5.0::DOUBLE AS x, (l_orderkey % 97) / 40.0::DOUBLE AS y, l_extendedprice / 10000.0::DOUBLE AS z, l_quantity / 50 AS r, l_discount * 10 AS g, l_tax * 12.5::DOUBLE AS b, l_linenumber - 1 AS frame_order FROM lineitem",
}


def with_ctes(select: str, *more: tuple[str, str], recursive: bool = False) -> str:
    """A select over the common tables and more; each is worked out once, however often it is read."""
    kept = "" if recursive else "MATERIALIZED "
    return ("WITH RECURSIVE " if recursive else "WITH ") + ", ".join([f"{k} AS MATERIALIZED ({v})" for k, v in CTES.items()] + [f"{k} AS {kept}({v})" for k, v in more]) + "\n" + select
