"""Toxicity: a linear classifier in numpy, learnt from confirmed toxic and unlabelled texts by non-negative PU risk.

Texts are read once: what of their features occurs in confirmed toxic texts is written, a few hundred bytes a row. All rows that
may be learnt from are counted as unlabelled ones, and features as frequent in them as in confirmed ones, by chance and more,
are left out. Then all enter the risk: they are dealt to blocks by hash, each block fits a model of its own against the
confirmed rows, and the mean of these models is the classifier; means of linear models are linear.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loculus.llm.common import MOST_TASKS, fresh, held_out, labelled, light, read_table, shuffle_parts, write_table

#: At most so many confirmed toxic rows are learnt from (CONFIRMED_BYTES of features at most); unlabelled rows a block, all of them; the groups that models are added up in.
POSITIVES, BLOCK, GROUPS = 4000, 8192, 64
BROADCAST_ROWS, CONFIRMED_BYTES = 1_000_000, 64 << 20
#: A feature tells something if its share of the confirmed rows is so many deviations from that of all; more than COMMON of all rows have none.
DEVIATIONS, COMMON = 2.0, 0.25
BITS, PREFIXES = 20, (4, 5, 6)
KEPT_WORDS = 100_000
EDGES = ".,;:!?\"'()[]{}<>|*#$%&@+=~`^_/\\-–—…«»“”¡¿"


class WordFeatures(dict):
    """Word -> its features as bytes of unsigned 32-bit integers: the word in lower case without signs around it, and its beginnings."""

    def __missing__(self, word: str) -> bytes:
        import xxhash

        plain = word.lower().strip(EDGES)
        parts = [f"w{plain}"] if plain else []
        parts += [f"{n}{plain[:n]}" for n in PREFIXES if len(plain) > n]
        got = np.array([xxhash.xxh32_intdigest(p) >> 32 - BITS for p in parts], "<u4").tobytes()
        if len(self) >= KEPT_WORDS:
            self.clear()
        if len(word) <= 64:
            self[word] = got
        return got

    def of(self, text: str | None) -> np.ndarray:
        """The distinct features of a whole text, ascending; none for None."""
        return np.unique(np.frombuffer(b"".join(map(self.__getitem__, set((text or "").split()))), "<u4"))


def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list]]:
    for b in batches:
        for at in range(0, b.num_rows, 512):
            part = b.slice(at, 512)
            yield part, part.column(part.num_columns - 1).to_pylist()


def sampled(ids: DataFrame, most: int) -> list:
    """At most `most` of the ids, those of the least hashes, the same in every run."""
    n = ids.count()
    h = F.xxhash64("doc_id", F.lit(7))
    if n > most:
        ids = ids.filter(F.pmod(h, F.lit(1 << 30)) < int(min(1.0, 1.5 * most / n + 100 / n) * (1 << 30)))
    return [r["doc_id"] for r in ids.orderBy(F.pmod(h, F.lit(1 << 30)), "doc_id").limit(most).collect()]


def flat(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows' features in one array, and the row of each."""
    return (np.concatenate(rows) if rows else np.zeros(0)).astype(np.int32), np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])


def pu_risk(w: np.ndarray, b: float, pos: list[np.ndarray], unl: list[np.ndarray], prior: float) -> tuple[float, float, np.ndarray, float]:
    """prior * E_pos[l(s)], E_unl[l(-s)] - prior * E_pos[l(-s)], and the gradient (weights, bias) that is followed:

    of their sum, or where the second is below zero of the second upwards. l: logistic loss, s: a row's score.
    """
    return _risk(w, b, flat([*pos, *unl]), len(pos), len(unl), prior)


def _risk(w: np.ndarray, b: float, table: tuple[np.ndarray, np.ndarray], n_pos: int, n_unl: int, prior: float) -> tuple[float, float, np.ndarray, float]:
    col, row = table
    s = b + np.bincount(row, w[col], n_pos + n_unl)
    p = 1 / (1 + np.exp(-np.clip(s, -30, 30)))
    is_pos = np.arange(len(s)) < n_pos
    first = prior * np.mean(np.logaddexp(0, -s[is_pos]))
    second = np.mean(np.logaddexp(0, s[~is_pos])) - prior * np.mean(np.logaddexp(0, s[is_pos]))
    up, down = np.where(is_pos, prior * (p - 1) / n_pos, 0.0), np.where(is_pos, -prior * p / n_pos, p / n_unl)
    g = up + down if second >= 0 else -down
    return first, second, np.bincount(col, g[row], len(w)), float(g.sum())


def nnpu(pos: list[np.ndarray], unl: list[np.ndarray], prior: float, size: int, steps: int = 100, rate: float = 0.1, l1: float = 6e-4) -> tuple[np.ndarray, float]:
    """Weights of `size` features and bias of least non-negative PU risk (pu_risk), by Adam with weights drawn towards 0."""
    if not pos or not unl:
        return np.zeros(size), -30.0 if not pos else 0.0
    table = flat([*pos, *unl])
    w, b = np.zeros(size), float(np.log(prior / (1 - prior)))
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for step in range(1, steps + 1):
        _, _, gw, gb = _risk(w, b, table, len(pos), len(unl), prior)
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        lr = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        c1, c2 = 1 - 0.9**step, 1 - 0.99**step
        scale = lr / (np.sqrt(v / c2) + 1e-5)
        w = w - scale * (m / c1)
        w = np.sign(w) * np.maximum(0, np.abs(w) - scale * l1)
        b -= lr * (mb / c1) / (np.sqrt(vb / c2) + 1e-5)
    return w, b


def telling(pos: np.ndarray, n_pos: int, every: np.ndarray, n: int) -> np.ndarray:
    """Whether features tell confirmed rows from others, by how many of n_pos confirmed and of n rows have them."""
    p, q = pos / max(1, n_pos), every / max(1, n)
    return (np.abs(p - q) >= DEVIATIONS * np.sqrt((q * (1 - q) + 1e-12) / max(1, n_pos))) & (q <= COMMON)


def packed(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def seen_in(docs: DataFrame, ids: DataFrame) -> np.ndarray:
    """The features of the rows of docs with these ids that several of them have: three at least, or a 400th of them."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, count, rows = WordFeatures(), np.zeros(1 << BITS, np.int64), 0
        for part, got in texts(batches):
            for x in got:
                count[words.of(x)] += 1
            rows += len(got)
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at].astype(np.int32)), pa.array(np.r_[rows, count[at]])], names=["f", "n"])

    own = docs.select("doc_id", F.col("text").cast("string")).join(F.broadcast(ids), "doc_id", "left_semi").select("text").mapInArrow(light(found), "f int, n bigint")
    count = {r["f"]: r["n"] for r in own.groupBy("f").agg(F.sum("n").alias("n")).filter("f = -1 OR n >= 3").collect()}  # at most 2^BITS rows
    rows = count.pop(-1, 0)
    return np.array(sorted(f for f, n in count.items() if n >= rows // 400), np.uint32)


def described(docs: DataFrame, ids: DataFrame, features: np.ndarray) -> DataFrame:
    """doc_id, h (a hash of the text), learn (the row may be learnt from), pos (its id is one of ids), f: numbers of the features that the text has."""
    shared, kind = docs.sparkSession.sparkContext.broadcast(features), packed(len(features))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, place = WordFeatures(), np.full(1 << BITS, -1, np.int32)
        place[shared.value] = np.arange(len(shared.value))
        for part, rows in texts(batches):
            got = [place[words.of(x)] for x in rows]
            yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array([x[x >= 0].astype(kind).tobytes() for x in got], pa.binary())], names=["doc_id", "h", "learn", "pos", "f"])

    text = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    text = text.join(F.broadcast(ids.select(F.col("doc_id").alias("_id"), F.lit(True).alias("_pos"))), F.col("doc_id") == F.col("_id"), "left")
    text = text.select("doc_id", F.xxhash64("text").alias("h"), (F.col("doc_id").isNotNull() & ~held_out()).alias("learn"), F.coalesce("_pos", F.lit(False)).alias("pos"), "text")
    return text.mapInArrow(light(found), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, h bigint, learn boolean, pos boolean, f binary")


SUMS = "part bigint, w binary, b double, n bigint"


def _sums(w: np.ndarray, b: float, n: int) -> pa.RecordBatch:
    from pyspark import TaskContext

    return pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % GROUPS], pa.int64()), pa.array([w.tobytes()], pa.binary()), pa.array([b]), pa.array([n], pa.int64())], names=["part", "w", "b", "n"])


def added(sums: DataFrame, size: int) -> tuple[np.ndarray, float, int]:
    """The total of sums (part, w, b, n), a row a task, by way of at most GROUPS rows."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b, n = np.zeros(size), 0.0, 0
        for batch in batches:
            for _, x, y, m in zip(*[c.to_pylist() for c in batch.columns]):
                w, b, n = w + np.frombuffer(x), b + y, n + m
        if n:
            yield _sums(w, b, n)

    got = sums.repartition(GROUPS, "part").sortWithinPartitions("b", "w").mapInArrow(light(add), SUMS).collect()
    got = sorted(got, key=lambda r: (r["b"], r["w"]))
    return sum((np.frombuffer(r["w"]) for r in got), np.zeros(size)), sum(r["b"] for r in got), sum(r["n"] for r in got)


def counted(rows: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """How many of the rows (f) have each feature, and how many rows there are."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(size), 0
        for b in batches:
            total, n = total + np.bincount(flat([np.frombuffer(x, packed(size)) for x in b.column(0).to_pylist()])[0], minlength=size), n + b.num_rows
        if n:
            yield _sums(total, 0.0, n)

    total, _, n = added(rows.select("f").mapInArrow(light(count), SUMS), size)
    return total, n


def block_models(rows: DataFrame, n: int, pos: list[np.ndarray], prior: float, used: np.ndarray, size: int) -> tuple[np.ndarray, float, int]:
    """The sums of the weights of the features used and of the biases over the models of all blocks of the n rows (doc_id, h, f), and how many blocks there are."""
    spark = rows.sparkSession
    place = np.full(size, -1, np.int32)
    place[used] = np.arange(len(used))
    shared, kind = spark.sparkContext.broadcast((place, [x[x >= 0] for x in (place[f] for f in pos)])), packed(len(used))
    blocks = max(1, round(n / BLOCK))
    parts = max(shuffle_parts(spark), min(blocks, MOST_TASKS))

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = shared.value[0]
        for b in batches:
            got = [place[np.frombuffer(x, packed(size))] for x in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([x[x >= 0].astype(kind).tobytes() for x in got], pa.binary())], names=["block", "doc_id", "h", "f"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b, many, now, own = np.zeros(len(used)), 0.0, 0, None, []
        for batch in batches:
            for block, f in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if block != now and own:
                    got = nnpu(shared.value[1], own, prior, len(used))
                    w, b, many, own = w + got[0], b + got[1], many + 1, []
                now = block
                own.append(np.frombuffer(f, kind))
        if own:
            got = nnpu(shared.value[1], own, prior, len(used))
            w, b, many = w + got[0], b + got[1], many + 1
        if many:
            yield _sums(w, b, many)

    small = rows.select(F.pmod(F.xxhash64("doc_id", "h", F.lit(11)), F.lit(blocks)).alias("block"), "doc_id", "h", "f")
    small = small.mapInArrow(light(select), small.schema).withColumn("task", F.pmod("block", F.lit(parts)).cast("int"))
    return added(small.repartitionById(parts, "task").sortWithinPartitions("block", "doc_id", "h").select("block", "f").mapInArrow(light(total), SUMS), len(used))


def confirmed_rows(rows: DataFrame, most: int, kind: str) -> list[np.ndarray]:
    """The features of the confirmed rows, different ones by id and text: at most `most` rows, those of the least hashes of their ids, as long as their features fit into CONFIRMED_BYTES."""
    own = rows.filter("pos").select("doc_id", "h", "f").dropDuplicates(["doc_id", "h"]).orderBy(F.xxhash64("doc_id"), "h").limit(most)
    out, size = [], 0
    for r in own.toLocalIterator():
        size += len(r["f"])
        if size > CONFIRMED_BYTES:
            break
        out.append((r["doc_id"], r["h"], np.frombuffer(bytes(r["f"]), kind)))
    return [f for *_, f in sorted(out, key=lambda x: x[:2])]


def toxic_table(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES) -> DataFrame:
    """doc_id, h (a hash of the text) and score of every row.

    The prior is the toxic share of the labels that may be learnt from; at most `positives` rows of the toxic ones are, those of the
    least hashes of their ids, and no more than CONFIRMED_BYTES hold the features of.
    """
    spark = docs.sparkSession
    known = labelled(spark, labels, "toxic")
    share = known.agg(F.avg("label").alias("p"), F.count("label").alias("n")).collect()[0]
    pos = sampled(known.filter("label = 1").select("doc_id"), positives) if share["n"] and share["p"] else []
    ids = spark.createDataFrame([(i,) for i in pos], f"doc_id {labels.schema['doc_id'].dataType.simpleString()}")
    features = seen_in(docs, ids) if pos else np.zeros(0, np.uint32)
    size = len(features)
    rows = write_table(described(docs, ids, features), "toxic-features")
    confirmed = confirmed_rows(rows, positives, packed(size))
    weights, bias = np.zeros(size), -30.0
    learn = rows.filter("learn").select("doc_id", "h", "f")
    every, n = counted(learn, size) if confirmed else (None, 0)
    if n:
        prior = min(max(float(share["p"]), 1e-4), 0.9)
        used = np.flatnonzero(telling(np.bincount(flat(confirmed)[0], minlength=size), len(confirmed), every, n))
        w, b, many = block_models(learn, n, confirmed, prior, used, size)
        weights[used], bias = w / many, b / many
    shared = spark.sparkContext.broadcast((weights, bias))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        for b in batches:
            col, row = flat([np.frombuffer(x, packed(size)) for x in b.column(2).to_pylist()])
            s = bias + np.bincount(row, weights[col], b.num_rows) if len(col) else np.full(b.num_rows, bias)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(1 / (1 + np.exp(-np.clip(s, -500, 500))), pa.float64())], names=["doc_id", "h", "score"])

    return rows.select("doc_id", "h", "f").mapInArrow(light(scored), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, h bigint, score double")


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score below the threshold, all columns whatever their names. Null and empty texts and rows without doc_id are scored like others; repeated rows stay or go together; an empty table stays empty."""
    bad = toxic_table(docs, labels).filter(F.col("score") >= threshold).select(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).distinct()
    bad = write_table(bad, "toxic-rows")
    row, h = fresh(docs, "clean_row"), fresh(docs, "clean_hash")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias(row), F.xxhash64(docs["text"].cast("string")).alias(h))
    few = bad.count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(bad) if few else bad, (F.col(h) == bad["_h"]) & F.col(f"{row}.doc_id").eqNullSafe(bad["_id"]), "left_anti").select(f"{row}.*")


def toxic_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Scores every row of docs: doc_id, held_out, score, predicted.

    Null and empty texts get the score of no features, which is low. Rows with one doc_id, or repeated, each get theirs; a row
    without doc_id is scored and not held out. Without a toxic label to learn from all scores are about 0. An empty table gives
    an empty result. Other columns are left behind.
    """
    return toxic_table(docs, labels).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxic_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
