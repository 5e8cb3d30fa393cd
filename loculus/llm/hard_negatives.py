"""Hard negatives by blocked dense products: blocks of anchors against blocks of all rows, with running best lists that merge."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loculus.llm.common import drop_table, light, prefix_sums, read_table, write_table
from loculus.llm.vector_codes import usable

POSITIVES, NEGATIVES, LOW, HIGH, SCALE = 5, 5, 80, 100, 256
#: Anchors that are multiplied at a time, rows that they are multiplied with, and the bytes of anchors that one pass over the rows takes.
TILE, BLOCK, PASS_BYTES = 256, 4096, 32 << 20
WORST, NO_ID = np.iinfo(np.int64).min, np.iinfo(np.int64).max


class Best:
    """The best `most` (score, id) of each of n lists: higher scores first, equal ones by smaller id."""

    def __init__(self, n: int, most: int):
        self.score, self.id, self.most = np.full((n, most), WORST), np.full((n, most), NO_ID), most

    def add(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        fits = (score > self.score[at, -1]) | (score == self.score[at, -1]) & (ids < self.id[at, -1])
        at, score, ids = at[fits], score[fits], ids[fits]
        if not len(at):
            return
        lists, own = np.unique(at, return_inverse=True)
        at = np.r_[np.repeat(np.arange(len(lists)), self.most), own]
        score, ids = np.r_[self.score[lists].ravel(), score], np.r_[self.id[lists].ravel(), ids]
        order = np.lexsort((ids, -1 - score, at))  # -1 - x, since the least integer has no opposite
        rank = np.arange(len(at)) - np.searchsorted(at[order], at[order])
        kept = order[rank < self.most]
        self.score[lists], self.id[lists] = score[kept].reshape(-1, self.most), ids[kept].reshape(-1, self.most)

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, k = np.nonzero(self.id != NO_ID)
        return at, self.id[at, k], self.score[at, k]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers: in float64 where all sums stay below 2^53, else in 64-bit integers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 2**53:
        return a @ b.T
    if most * 100 >= 2**63:
        raise ValueError("vectors are too large for scores of 64 bits")
    return a.astype(np.int64) @ b.astype(np.int64).T


def blocks(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """ids, labels, floor(scale * x) of rows (id, label, vector) of one length, BLOCK at most."""
    for batch in batches:
        for b in (batch.slice(at, BLOCK) for at in range(0, batch.num_rows, BLOCK)):
            lens = np.diff(np.asarray(b.column(2).offsets))
            flat, starts = b.column(2).flatten().to_numpy(zero_copy_only=False).astype(float), np.r_[0, np.cumsum(lens)]
            for dim in np.unique(lens):
                own = np.flatnonzero(lens == dim)
                x = np.floor(flat[(starts[own, None] + np.arange(dim)).ravel()] * scale).reshape(len(own), dim)
                yield b.column(0).to_numpy()[own], b.column(1).to_numpy()[own], x


def search(rows: DataFrame, anchors: Broadcast, scale: int, most: int) -> DataFrame:
    """at, id, score: of each task the best rows of each list.

    anchors holds, by the vectors' length, ids, labels, vectors and windows. Without windows an anchor's list has other rows of its
    label; with windows ([anchor, window]: least and largest score) a list is one window of one anchor and has rows of other labels.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = {dim: (*g, Best(g[3].shape[0] * (1 if g[4] is None else g[4].shape[1]), most)) for dim, g in anchors.value.items()}
        for ids, labels, x in blocks(batches, scale):
            if x.shape[1] not in groups:
                continue
            own_ids, own_labels, vectors, keys, low, high, best = groups[x.shape[1]]
            for a in range(0, len(vectors), TILE):
                tile = slice(a, a + TILE)
                score, same = products(vectors[tile], x), own_labels[tile, None] == labels
                if low is None:
                    hit = same & (own_ids[tile, None] != ids) & (score >= best.score[tile, -1:])
                    r, c = np.nonzero(hit)
                    best.add(a + r, score[r, c].astype(np.int64), ids[c])
                    continue
                windows = low.shape[1]
                least = np.maximum(low[tile], best.score[a * windows : (a + TILE) * windows, -1].reshape(-1, windows))
                r, c = np.nonzero(~same & (own_ids[tile, None] != ids) & (score >= least.min(1, keepdims=True)) & (score <= high[tile].max(1, keepdims=True)))
                s = score[r, c].astype(np.int64)
                for j in range(windows):
                    fits = (s >= least[r, j]) & (s <= high[a + r, j])
                    best.add((a + r[fits]) * windows + j, s[fits], ids[c[fits]])
        for *_, keys, low, _, best in groups.values():
            at, ids, score = best.entries()
            windows = 1 if low is None else low.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(keys[at // windows]), pa.array(at % windows), pa.array(ids), pa.array(score)], names=["anchor", "list", "id", "score"])

    return rows.mapInArrow(light(run), "anchor bigint, list bigint, id bigint, score bigint")


def merged(found: DataFrame, most: int) -> DataFrame:
    """The best of all tasks' lists, with their rank from 1."""
    order = Window.partitionBy("anchor", "list").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def hard_negatives(table: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | Column = "label", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """Hard negatives of the rows that `anchor` selects: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A score is the inner product of floor(scale * x) with the anchor's. An anchor's positives are its best `positives` other rows of
    its label; of each, the best `negatives` rows of other labels with low * positive_score <= 100 * negative_score <=
    high * positive_score are returned (all, if fewer). Higher scores come first, then smaller ids.

    Anchors are numbered and taken in groups of at most `pass_bytes`, which are broadcast; each group takes two passes over the rows,
    which stay where they are. A task keeps the best lists of its group's anchors and sends these, so what is shuffled is at most
    `positives` and then positives * negatives rows an anchor and task, and what a pass brings to the driver is bounded by the group.

    Rows take no part if their id, label or vector is null or the vector is empty or holds null or non-finite components. Rows with the
    anchor's id are neither its positives nor its negatives; otherwise repeated rows are rows of their own, and a repeated anchor
    is mined as often as it stands there. Vectors of different length aren't compared. No rows give no rows. Other columns are left
    behind. label_col must be a whole number.
    """
    spark = table.sparkSession
    label = F.col(label_col) if isinstance(label_col, str) else label_col
    rows = table.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("v")))
    own = rows.filter("anchor").select("id", "label", "v", F.lit(1).cast("long").alias("one"), F.size("v").cast("long").alias("dim"))
    own = write_table(prefix_sums(own, None, ["id", "label", "v"], {"number": "one", "before": "dim"}, "hard-anchors").drop("one"), "hard-numbered")
    groups = [r["group"] for r in own.groupBy(F.expr(f"before div {max(1, pass_bytes // 8)}").alias("group")).agg(F.count(F.lit(1))).sort("group").collect()]
    rows, out = rows.select("id", "label", "v"), []
    for group in groups:
        taken = own.filter(F.expr(f"before div {max(1, pass_bytes // 8)}") == group).select("id", "label", "v", "number").sort("number").toArrow()
        number = np.concatenate([np.zeros(0, np.int64), *[c.to_numpy() for c in taken["number"].chunks]])
        dims = np.concatenate([np.zeros(0, np.int64), *[np.diff(np.asarray(c.offsets)) for c in taken["v"].chunks]])
        by_dim, at = {}, {d: np.flatnonzero(dims == d) for d in np.unique(dims).tolist()}
        parts: dict[int, list] = {d: [] for d in at}
        for b in taken.to_batches():
            for ids, labels, x in blocks(iter([b.select(["id", "label", "v"])]), scale):
                parts[x.shape[1]].append((ids, labels, x))
        for d, p in parts.items():
            by_dim[d] = tuple(np.concatenate([q[k] for q in p]) for k in range(3)) + (number[at[d]],)
        sent = spark.sparkContext.broadcast({d: (*g, None, None) for d, g in by_dim.items()})
        first = write_table(merged(search(rows, sent, scale, positives), positives), "hard-positives")
        sent.destroy()
        scores = first.select("anchor", "rank", "score").toArrow()
        position = np.empty(int(number.max()) + 1 - int(number.min()), np.int64)
        windows = {}
        for d, g in by_dim.items():
            position[g[3] - number.min()] = np.arange(len(g[3]))
            windows[d] = (np.full((len(g[3]), positives), NO_ID), np.full((len(g[3]), positives), WORST))
        length = dict(zip(number.tolist(), dims.tolist()))
        for a, rank, score in zip(*(scores[c].to_pylist() for c in ("anchor", "rank", "score"))):
            lows, highs = windows[length[a]]
            k = position[a - int(number.min())], rank - 1
            lows[k], highs[k] = -(-low * score // 100), high * score // 100
        sent = spark.sparkContext.broadcast({d: (*g, *windows[d]) for d, g in by_dim.items()})
        second = merged(search(rows, sent, scale, negatives), negatives)
        of = first.select("anchor", (F.col("rank") - 1).cast("long").alias("list"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        pairs = second.withColumnsRenamed({"id": "negative_id", "score": "negative_score"}).join(of, ["anchor", "list"])
        named = pairs.join(own.select(F.col("number").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
        out.append(write_table(named.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "hard-negatives"))
        sent.destroy()
        drop_table(first)
    kind = T.StructType([T.StructField(c, T.IntegerType() if c == "rank" else T.LongType()) for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")])
    if not out:
        return spark.createDataFrame([], kind)
    return spark.read.schema(kind).parquet(*[t._loculus_path for t in out])


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(read_table(spark, sf_dir, "embeddings", 4096), F.col("vec_id") % 100 == 0, label_col=label)


def op12_sql() -> str:
    """The same in DuckDB, with every score of an anchor."""
    return f"""
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding::DOUBLE[], lambda x: floor({SCALE} * x)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES})
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= {NEGATIVES}"""
