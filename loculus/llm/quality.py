"""Quality: a generalised additive model with pairwise interactions, its tables learnt by cyclic boosting of shallow trees."""

from __future__ import annotations

import string
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loculus.llm.common import held_out, labelled, light, read_table
from loculus.llm.toxicity import sampled, texts

#: The sample that is fitted: at most so many labelled rows. Scoring covers all rows.
LABELLED = 12_000
NAMES = ("words", "word_length", "upper", "digits", "points", "bars", "bangs", "symbols", "distinct", "lines_again", "line_words", "ends", "wide", "capitals", "longest", "short", "squeezed", "bare", "twins", "marked")
UPPER, DIGITS, POINTS, SYMBOLS = (s.encode() for s in (string.ascii_uppercase, string.digits, ".,;:?", "#$%&*@^~=+<>{}[]\\_/"))
LETTERS = string.ascii_letters.encode()
WIDE = bytes(range(128, 256))
ENDS = bytes.maketrans(b"", b"")


def describe(text: str | None) -> list[float]:
    """What the model sees of a whole text: shares and lengths, NAMES in order; 0 for an empty text or None."""
    b = (text or "").encode()
    words = b.split()
    n, size = len(words), len(b)
    if not n:
        return [0.0] * len(NAMES)
    count = lambda chars: size - len(b.translate(None, chars))
    letters = count(LETTERS) + 1
    kinds = set(words)
    lines = [x for x in b.split(b"\n") if x.strip()]
    stripped = b"".join(words)
    ends = b" ".join(words) + b" "
    marks = sum(ends.count(x) for x in (b". ", b", ", b"! ", b"? ", b"; ", b": "))
    signs = sum(ends.count(x + b" ") for x in (b"#", b"$", b"%", b"&", b"*", b"@", b"^", b"~", b"="))
    upper = count(UPPER)
    lengths = np.fromiter(map(len, words), np.int32, n)
    return [
        np.log1p(n), len(stripped) / n, upper / letters, count(DIGITS) / size, count(POINTS) / size, count(b"|") / n, count(b"!") / n, count(SYMBOLS) / size,
        len(kinds) / n, 1 - len(set(lines)) / len(lines), n / len(lines), marks / n, count(WIDE) / size, sum(map(bytes.isupper, words)) / n,
        np.log1p(lengths.max()), float((lengths <= 3).mean()), len(zlib.compress(b, 1)) / size, float((lengths == 1).mean()),
        1 - len(set(zip(words, words[1:]))) / max(1, n - 1), signs / n,
    ]


def described(docs: DataFrame) -> DataFrame:
    """doc_id and the features of every row."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in texts(batches):
            x = np.array([describe(t) for t in rows]).reshape(len(rows), len(NAMES))
            yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(x[:, k]) for k in range(len(NAMES))]], names=["doc_id", *NAMES])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(light(found), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{n} double" for n in NAMES))


@dataclass
class AdditiveModel:
    """bias + a table for each feature's bins + a table for the bins of each chosen pair."""

    cuts: list[np.ndarray]
    bias: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, k], "right") for k, c in enumerate(self.cuts)], 1)

    def logit(self, x: np.ndarray) -> np.ndarray:
        s = np.full(len(x), self.bias)
        if self.tables:
            at = self.bins(x)
            for k, t in enumerate(self.tables):
                s += t[at[:, k]]
            for i, j, ci, cj, t in self.pairs:
                s += t[np.searchsorted(ci, x[:, i], "right"), np.searchsorted(cj, x[:, j], "right")]
        return s

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -500, 500)))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 3, l2: float = 5.0, least: float = 1.0) -> np.ndarray:
    """A shallow tree over ordered bins from their sums of gradients and hessians: the value of each bin."""
    out, parts = np.zeros(len(g)), [(0, len(g))]
    for _ in range(leaves - 1):
        best = (1e-9, None, None)
        for k, (a, b) in enumerate(parts):
            cg, ch = np.cumsum(g[a:b]), np.cumsum(h[a:b])
            left, right = (cg[:-1], ch[:-1]), (cg[-1] - cg[:-1], ch[-1] - ch[:-1])
            gain = left[0] ** 2 / (left[1] + l2) + right[0] ** 2 / (right[1] + l2) - cg[-1] ** 2 / (ch[-1] + l2)
            gain[(left[1] < least) | (right[1] < least)] = 0
            if len(gain) and gain.max() > best[0]:
                best = (gain.max(), k, a + int(gain.argmax()) + 1)
        if best[1] is None:
            break
        a, b = parts.pop(best[1])
        parts += [(a, best[2]), (best[2], b)]
    for a, b in parts:
        out[a:b] = -g[a:b].sum() / (h[a:b].sum() + l2)
    return out


def _square(g: np.ndarray, h: np.ndarray, l2: float = 2.0, least: float = 0.01) -> tuple[float, np.ndarray]:
    """The best tree of one cut in either direction over two features' bins: gain, values."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    part = lambda c: np.stack([c, c[:, -1:] - c, c[-1:, :] - c, c[-1, -1] - c[:, -1:] - c[-1:, :] + c])[:, :-1, :-1]
    pg, ph = part(cg), part(ch)
    gain = (pg**2 / (ph + l2)).sum(0) - cg[-1, -1] ** 2 / (ch[-1, -1] + l2)
    gain[(ph < least).any(0)] = 0
    out = np.zeros(g.shape)
    if not gain.size or gain.max() <= 1e-9:
        return 0.0, out
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    v = -pg[:, i, j] / (ph[:, i, j] + l2)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = v
    return float(gain.max()), out


def fit_additive(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 60, rate: float = 0.15, pairs: int = 6, pair_bins: int = 10, pair_rounds: int = 40) -> AdditiveModel:
    """Cyclic boosting: in each round each feature's table takes a small step by a shallow tree on the gradients, then the pairs that promise most do."""
    quantiles = lambda v, n: np.unique(np.quantile(v, np.arange(1, n) / n)) if len(v) else np.zeros(0)
    model = AdditiveModel([quantiles(x[:, k], bins) for k in range(x.shape[1])])
    if not len(y) or y.min() == y.max():
        model.bias = 0.0 if not len(y) else (5.0 if y[0] else -5.0)
        return model
    model.bias = float(np.log(y.mean() / (1 - y.mean())))
    at, s = model.bins(x), np.full(len(y), model.bias)
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-s))
        return p - y, p * (1 - p)

    for _ in range(rounds):
        for k, t in enumerate(model.tables):
            g, h = slopes()
            step = rate * _tree(np.bincount(at[:, k], g, len(t)), np.bincount(at[:, k], h, len(t)))
            t += step
            s += step[at[:, k]]
    cuts = [quantiles(x[:, k], pair_bins) for k in range(x.shape[1])]
    small = np.stack([np.searchsorted(c, x[:, k], "right") for k, c in enumerate(cuts)], 1)
    flat = lambda i, j, v: np.bincount(small[:, i] * (len(cuts[j]) + 1) + small[:, j], v, (len(cuts[i]) + 1) * (len(cuts[j]) + 1)).reshape(len(cuts[i]) + 1, -1)
    g, h = slopes()
    gains = sorted(((_square(flat(i, j, g), flat(i, j, h))[0], i, j) for i in range(x.shape[1]) for j in range(i)), reverse=True)[:pairs]
    model.pairs = [(i, j, cuts[i], cuts[j], np.zeros((len(cuts[i]) + 1, len(cuts[j]) + 1))) for gain, i, j in gains if gain > 0]
    for _ in range(pair_rounds):
        for i, j, _ci, _cj, t in model.pairs:
            g, h = slopes()
            step = rate * _square(flat(i, j, g), flat(i, j, h))[1]
            t += step
            s += step[small[:, i], small[:, j]]
    return model


def fit(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> AdditiveModel:
    """Fits on at most `most` labelled rows among those that may be learnt from: those of the least hashes of their ids, and where ids repeat, of the least features."""
    spark = docs.sparkSession
    known = labelled(spark, labels, "quality")
    ids = sampled(known.select("doc_id"), most)
    chosen = spark.createDataFrame([(i,) for i in ids], f"doc_id {labels.schema['doc_id'].dataType.simpleString()}")
    marked = known.join(F.broadcast(chosen), "doc_id", "left_semi").collect()
    label = {r["doc_id"]: r["label"] for r in marked}
    own = described(docs.join(F.broadcast(chosen), "doc_id", "left_semi"))
    rows = sorted(tuple(r) for r in own.orderBy(F.xxhash64("doc_id"), *NAMES).limit(most).collect())
    return fit_additive(np.array([r[1:] for r in rows]).reshape(len(rows), len(NAMES)), np.array([label[r[0]] for r in rows], float))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of docs that score the threshold or more, all columns."""
    shared, column = docs.sparkSession.sparkContext.broadcast(fit(docs, labels)), docs.columns.index("text")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(k, 512) for b in batches for k in range(0, b.num_rows, 512)):
            x = np.array([describe(t) for t in b.column(column).to_pylist()]).reshape(b.num_rows, len(NAMES))
            yield b.filter(pa.array(shared.value.score(x) >= threshold))

    return docs.mapInArrow(light(kept), docs.schema)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Scores every row of docs: doc_id, held_out, score, predicted.

    Null and empty texts have the features 0 and a score like any other. Rows with one doc_id, or repeated, each get theirs; a
    row without doc_id is scored and not held out. Without labels of both kinds all rows get one score. An empty table gives an
    empty result. Other columns are left behind.
    """
    model = fit(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in texts(batches):
            x = np.array([describe(t) for t in rows]).reshape(len(rows), len(NAMES))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shared.value.score(x), pa.float64())], names=["doc_id", "score"])

    out = docs.select("doc_id", F.col("text").cast("string")).mapInArrow(light(scored), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op4_quality(spark, sf_dir: str) -> DataFrame:
    return quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
