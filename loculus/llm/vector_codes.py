"""Vector codes: each part of an integer vector as the index of its nearest codebook entry, found by a vector-approximation file."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loculus.llm.common import join_spread, light, read_table, write_table

PARTS, ENTRIES, ROUNDS, SCALE, BITS = 16, 64, 2, 256, 3
#: Rows that are assigned together, and the largest integer component: squared distances of vectors of 1,000 components stay below 2^63.
ROWS, LARGEST = 2048, 1 << 25


class Cells:
    """Entries of one codebook (integers, a row each), and the cell of each of their coordinates.

    A coordinate's entries fall into 2^bits cells of as many entries each; of a cell its least and largest entry are kept. A query
    looks its distance from every cell up once a coordinate, and from these tables each entry has a lower and an upper bound.
    """

    def __init__(self, entries: np.ndarray, bits: int = BITS):
        self.entries, self.refined = np.ascontiguousarray(entries, np.int64), 0
        k, width = self.entries.shape
        self.cells = np.zeros((k, width), np.int64)
        self.low, self.high = np.zeros((2, width, 1 << bits), np.int64)
        for d in range(width):
            column = self.entries[:, d]
            marks = np.sort(column)[(np.arange(1, 1 << bits) * k) >> bits]
            self.cells[:, d] = np.searchsorted(marks, column, side="right")
            for cell in np.unique(self.cells[:, d]):
                own = column[self.cells[:, d] == cell]
                self.low[d, cell], self.high[d, cell] = own.min(), own.max()

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each query (a row of integers) the nearest entry, of equal ones the first, and its squared distance."""
        n, width = queries.shape
        lower, upper = np.zeros((2, n, len(self.entries)), np.int64)
        for d in range(width):
            q = queries[:, d, None]
            below, above = self.low[d] - q, q - self.high[d]
            lower += (np.maximum(np.maximum(below, above), 0) ** 2)[:, self.cells[:, d]]
            upper += (np.maximum(-below, -above) ** 2)[:, self.cells[:, d]]
        row, entry = np.nonzero(lower <= upper.min(1, keepdims=True))
        self.refined += len(row)
        away = queries[row] - self.entries[entry]
        distance = np.einsum("ij,ij->i", away, away)
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        best = np.minimum.reduceat(distance, starts) if n else distance
        hits = np.flatnonzero(distance == best[row])
        first = hits[np.r_[True, row[hits][1:] != row[hits][:-1]]] if n else hits
        return entry[first], best


def usable(vector: Column) -> Column:
    """Whether a vector is there, isn't empty, and all its components are finite."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def integers(column: pa.Array, dim: int, scale: int) -> np.ndarray:
    """floor(scale * x) of vectors of dim components: a row each."""
    if column.null_count or len(column) and (np.diff(np.asarray(column.offsets)) != dim).any():
        raise ValueError(f"all vectors must have {dim} components")
    out = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(float) * scale).reshape(len(column), dim)
    if len(out) and np.abs(out).max() > LARGEST:
        raise ValueError(f"a component times {scale} is beyond {LARGEST}")
    return out.astype(np.int64)


def assign(codebooks: np.ndarray, vectors: np.ndarray, cells: list[Cells] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """codebooks: [part, entry, position]. Of each vector the entry of each part, and that part's squared distance."""
    parts, _, width = codebooks.shape
    cells = cells or [Cells(book) for book in codebooks]
    found = [cells[p].nearest(vectors[:, p * width : (p + 1) * width]) for p in range(parts)]
    return np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


def fit_codebooks(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> np.ndarray | None:
    """Codebooks [part, entry, position] of integers after `rounds` rounds over all usable vectors; None if there is none.

    They start as the parts of the `entries` vectors with the smallest ids (all, if fewer; null ids last; of one id, by the vector).
    In a round every part goes to its nearest entry, the first of equals, and each entry becomes its parts' floor(sum / count) by
    component; entries without parts stay. A task sends one row an entry, so parts * entries rows reach the driver a round.
    """
    vectors = table.filter(usable(F.col(vector_col))).select(F.col(id_col), F.col(vector_col).cast("array<double>").alias("_v"))
    first = vectors.orderBy(F.col(id_col).asc_nulls_last(), "_v").limit(entries).select("_v").toArrow()["_v"].combine_chunks()
    if not len(first):
        return None
    dim = len(first[0])
    if dim % parts:
        raise ValueError(f"{dim} components aren't {parts} equal parts")
    width = dim // parts
    books = integers(first, dim, scale).reshape(-1, parts, width).transpose(1, 0, 2).copy()
    sums = [f"s{d}" for d in range(width)]
    for _ in range(rounds):

        def add(batches: Iterator[pa.RecordBatch], books: np.ndarray = books) -> Iterator[pa.RecordBatch]:
            cells, many = [Cells(b) for b in books], len(books[0])
            total, count = np.zeros((parts * many, width), np.int64), np.zeros(parts * many, np.int64)
            for b in batches:
                for at in range(0, b.num_rows, ROWS):
                    v = integers(b.column(0).slice(at, ROWS), dim, scale)
                    at_entry = assign(books, v, cells)[0] + np.arange(parts) * many
                    np.add.at(total, at_entry.ravel(), v.reshape(-1, width))
                    count += np.bincount(at_entry.ravel(), minlength=len(count))
            used = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(count[used]), *[pa.array(total[used, d]) for d in range(width)]], names=["at", "n", *sums])

        added = vectors.select("_v").mapInArrow(light(add), ", ".join(f"{c} bigint" for c in ("at", "n", *sums)))
        books = books.copy()
        for r in added.groupBy("at").agg(*[F.sum(c).alias(c) for c in ("n", *sums)]).collect():
            books[r["at"] // len(books[0]), r["at"] % len(books[0])] = [r[c] // r["n"] for c in sums]
    return books


def codebooks_sha256(books: np.ndarray) -> str:
    """Of all entries' components as decimal text, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(table: DataFrame, books: np.ndarray, keep: list[str], vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """The columns `keep` of each usable row, its codes (a byte a part) and its error: the squared distances from its parts' entries, summed."""
    parts, _, width = books.shape

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [Cells(b) for b in books]
        for batch in batches:
            for b in (batch.slice(at, ROWS) for at in range(0, batch.num_rows, ROWS)):
                entry, distance = assign(books, integers(b.column(len(keep)), parts * width, scale), cells)
                codes = [row.tobytes() for row in entry.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(codes, pa.binary()), pa.array(distance.sum(1))], names=[*[f"c{k}" for k in range(len(keep))], "_codes", "_error"])

    kinds = [table.schema[c].dataType.simpleString() for c in keep]
    rows = table.filter(usable(F.col(vector_col))).select(*[F.col(c).alias(f"c{k}") for k, c in enumerate(keep)], F.col(vector_col).cast("array<double>").alias("_v"))
    out = rows.mapInArrow(light(code), ", ".join([*[f"c{k} {t}" for k, t in enumerate(kinds)], "_codes binary", "_error bigint"]))
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(keep)], "_codes", "_error")


def decode(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    """codes: a row of bytes a vector -> the integer vectors that they stand for."""
    return books[np.arange(len(books)), codes].reshape(len(codes), -1)


def vector_codes(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """Codes of every usable vector by codebooks fitted on all of them: id_col, code, error, label_error, codebooks_sha256.

    Components become floor(scale * x). code: two hex digits a part; error: the squared distance of vector and code; label_error:
    error summed over the rows of one label, nulls together. Rows whose vector is null, empty, or holds null or non-finite
    components are left out. Other vectors must have one length, which `parts` divides, and components within 2^25 / scale, else a
    ValueError says so. Null and repeated ids and repeated rows are rows of their own. No rows give no rows. Other columns, of
    whatever name, are left behind. At most 256 entries.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code is a byte: 1 to 256 entries")
    books = fit_codebooks(table, id_col, vector_col, parts, entries, rounds, scale)
    if books is None:
        books = np.zeros((parts, 1, 1), np.int64)  # no row will need them
    label = F.coalesce(F.concat(F.lit("="), F.col("_label").cast("string")), F.lit("null"))
    rows = table.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label"), F.col(vector_col).alias("_vector"))
    coded = encode(rows, books, ["_id", "_label"], "_vector", scale)
    coded = write_table(coded.select("_id", label.alias("_key"), "_codes", "_error"), "vector-codes")
    sums = write_table(coded.groupBy("_key").agg(F.sum("_error").alias("_label_error"), F.count(F.lit(1)).alias("_rows")), "vector-code-labels")
    out = join_spread(coded, sums, "_key", "_rows")
    return out.select(F.col("_id").alias(id_col), F.lower(F.hex("_codes")).alias("code"), F.col("_error").alias("error"), F.col("_label_error").alias("label_error"), F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))


def op11_vector_codes(spark, sf_dir: str) -> DataFrame:
    return vector_codes(read_table(spark, sf_dir, "embeddings", 4096))


def op11_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, width: int = 4) -> str:
    """The same in DuckDB for vectors of parts * width components, with every distance."""
    away = " + ".join(f"(p.q[{d}] - b.q[{d}]) * (p.q[{d}] - b.q[{d}])" for d in range(1, width + 1))
    mean = ", ".join(f"(sum(q[{d}]) - ((sum(q[{d}]) % count(*)) + count(*)) % count(*)) // count(*)" for d in range(1, width + 1))
    steps = [f"""b0 AS MATERIALIZED (SELECT part, entry, q FROM p JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM k ORDER BY vec_id LIMIT {entries}) USING (vec_id))"""]
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT p.vec_id, p.part, any_value(p.q) AS q, min(({away}) * {entries} + b.entry) AS m FROM p JOIN b{r} b USING (part) GROUP BY p.vec_id, p.part)")
        if r < rounds:
            steps.append(f"m{r} AS (SELECT part, m % {entries} AS entry, [{mean}] AS q FROM a{r} GROUP BY ALL)")
            steps.append(f"b{r + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.q, b.q) AS q FROM b{r} b LEFT JOIN m{r} m USING (part, entry))")
    last = rounds
    return f"""
WITH k AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: floor({scale} * x)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, part, v[(part * {width} + 1):(part * {width} + {width})] AS q FROM k, range({parts}) t(part)),
{", ".join(steps)},
c AS (SELECT vec_id, string_agg(printf('%02x', m % {entries}), '' ORDER BY part) AS code, sum(m // {entries})::BIGINT AS error FROM a{last} GROUP BY vec_id),
h AS (SELECT sha256(string_agg(array_to_string(q, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{last})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM c JOIN k USING (vec_id), h"""
