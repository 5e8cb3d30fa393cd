"""Token ids as files: frequency-ranked ids in byte-aligned codes of one to four bytes with separate control bytes.

A folder holds all that reading needs, in three Parquet tables, so that Spark's commit keeps them whole when executors are lost
and any store can hold them:

blocks: a row is a block of documents: doc_ids and lens in order, control with two bits an id (its length in bytes less one, four
ids a byte, first id in the low bits), data with the codes' bytes, low byte first. Files and blocks ascend by doc_id.
files: file, base: how many ids stand in the files before it.
header, written last: version, the tokenizer file's name, the end id, and the id of each rank (unsigned 32-bit, little-endian).
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loculus.llm.common import drop_table, light, read_table, shared_dir, shuffle_parts, write_table
from loculus.llm.tokens import tokenizer_path, word_ids

VERSION, END, BLOCK_IDS, WORDS = 1, 1, 1 << 18, 800_000
#: Texts that are encoded together: a word of several of them is looked up once.
ROWS = 3000
#: Of each control byte, the lengths of its four codes.
LENGTHS = np.stack([(np.arange(256) >> 2 * k & 3) + 1 for k in range(4)], 1).astype(np.uint8)


def encode_codes(codes: np.ndarray) -> tuple[bytes, bytes]:
    """Unsigned 32-bit codes -> control bytes, data bytes."""
    codes = np.ascontiguousarray(codes, "<u4")
    length = 1 + (codes >= 1 << 8).astype(np.uint8) + (codes >= 1 << 16) + (codes >= 1 << 24)
    four = np.zeros(-(-len(codes) // 4) * 4, np.uint8)
    four[: len(codes)] = length - 1
    control = four[0::4] | four[1::4] << 2 | four[2::4] << 4 | four[3::4] << 6
    data = codes.view(np.uint8).reshape(-1, 4)[np.arange(4) < length[:, None]]
    return control.tobytes(), data.tobytes()


def decode_codes(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n codes of encode_codes, by table lookup of the control bytes."""
    length = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    end = np.cumsum(length, dtype=np.int64)
    at = end - length
    data = np.frombuffer(data, np.uint8)
    out = data[at].astype(np.uint32) if n else np.zeros(0, np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(length > k)
        if len(more):
            out[more] |= data[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def tokenise(docs: DataFrame, tokenizer: str, end: int) -> DataFrame:
    """doc_id, n, ids (little-endian unsigned integers of 16 bits, or 32 if an id needs them; the end id last) of every row."""
    kind = id_type(tokenizer, end)

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, last = word_ids(tokenizer, WORDS), np.array([end], kind).tobytes()
        for b in batches:
            for part in (b.slice(at, ROWS) for at in range(0, b.num_rows, ROWS)):
                flat, bounds = words.encode_many(part.column(1))
                got = [flat[i:j].astype(kind).tobytes() + last for i, j in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(bounds) + 1), pa.array(got, pa.binary())], names=["doc_id", "n", "ids"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(light(ids), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n bigint, ids binary")


def id_type(tokenizer: str, end: int) -> str:
    return "<u2" if max(end, len(word_ids(tokenizer).ends) - 1) < 1 << 16 else "<u4"


def id_ranks(tokens: DataFrame, kind: str) -> np.ndarray:
    """Ids by falling count over all documents, then by id. One row for each id of the vocabulary reaches the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            for at in range(0, b.num_rows, 64):
                x = b"".join(b.column(0).slice(at, 64).to_pylist())
                got = np.bincount(np.frombuffer(x, kind))
                if len(got) > len(total):
                    total = np.r_[total, np.zeros(len(got) - len(total), np.int64)]
                total[: len(got)] += got
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(total[at])], names=["id", "n"])

    rows = tokens.select("ids").mapInArrow(light(count), "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()
    return np.array([r["id"] for r in sorted(rows, key=lambda r: (-r["n"], r["id"]))], np.uint32)


def write_ids(docs: DataFrame, path: str | None = None, tokenizer: str | None = None, end: int = END) -> str:
    """Writes docs' ids in ascending doc_id order (null last) to the folder path, which must be new; None: one in the shared folder. Returns the path."""
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    tokenizer = tokenizer or tokenizer_path()
    plain = id_type(tokenizer, end)
    tokens = write_table(tokenise(docs, tokenizer, end), "ids-plain")
    ids = id_ranks(tokens, plain)
    rank = np.zeros(int(ids.max()) + 1 if len(ids) else 1, np.uint32)
    rank[ids] = np.arange(len(ids), dtype=np.uint32)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        file, start, block = TaskContext.get().partitionId(), 0, 0
        docs, lens, parts, size = [], [], [], 0

        def flush() -> pa.RecordBatch:
            control, data = encode_codes(rank[np.frombuffer(b"".join(parts), plain)])
            return pa.RecordBatch.from_arrays([pa.array([file], pa.int32()), pa.array([block], pa.int32()), pa.array([start], pa.int64()), pa.array([docs], pa.list_(docs_type)), pa.array([lens], pa.list_(pa.int64())), pa.array([control], pa.binary()), pa.array([data], pa.binary())], names=["file", "block", "start", "doc_ids", "lens", "control", "data"])

        for b in batches:
            docs_type = b.schema.field(0).type
            for doc, n, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                docs.append(doc)
                lens.append(n)
                parts.append(x)
                size += n
                if size >= BLOCK_IDS:
                    yield flush()
                    start, block = start + size, block + 1
                    docs, lens, parts, size = [], [], [], 0
        if docs:
            yield flush()

    ordered = tokens.repartitionByRange(shuffle_parts(spark), F.col("doc_id").asc_nulls_last()).sortWithinPartitions(F.col("doc_id").asc_nulls_last(), F.crc32("ids"))
    ordered.mapInArrow(light(encode), f"file int, block int, start bigint, doc_ids array<{kind}>, lens array<bigint>, control binary, data binary").write.parquet(f"{path}/blocks")
    drop_table(tokens)
    files = spark.read.parquet(f"{path}/blocks")
    sizes = files.groupBy("file").agg(F.sum(F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("_n"))
    starts = sizes.select("file", F.coalesce(F.sum("_n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))  # one row a file
    starts.coalesce(1).write.parquet(f"{path}/files")
    header = [(VERSION, tokenizer.rsplit("/", 1)[-1], end, bytearray(ids.astype("<u4").tobytes()))]
    spark.createDataFrame(header, "version int, tokenizer string, end int, ids binary").coalesce(1).write.parquet(f"{path}/header")
    return path


def read_ids(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """The documents of the folder path, which is all it needs: doc_id, start, n_tokens, and ids, or with digest ids_crc32 instead."""
    header = spark.read.parquet(f"{path}/header").first()
    if header["version"] != VERSION:
        raise ValueError(f"{path} has version {header['version']}, not {VERSION}")
    ids, files, starts = np.frombuffer(bytes(header["ids"]), "<u4"), spark.read.parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/files")
    kind = files.schema["doc_ids"].dataType.elementType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                lens = np.array(b.column(1)[k].as_py(), np.int64)
                got = ids[decode_codes(b.column(2)[k].as_py(), b.column(3)[k].as_py(), int(lens.sum()))].astype("<u4")
                ends = np.cumsum(lens)
                parts = [got[e - n : e].tobytes() for e, n in zip(ends, lens)]
                last = pa.array([zlib.crc32(x) for x in parts], pa.int64()) if digest else pa.array(parts, pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0)[k].values, pa.array(ends - lens + b.column(4)[k].as_py()), pa.array(lens), last], names=["doc_id", "start", "n_tokens", name])

    name = "ids_crc32" if digest else "ids"
    based = files.join(F.broadcast(starts), "file").select("doc_ids", "lens", "control", "data", (F.col("start") + F.col("base")).alias("start"))
    return based.select("doc_ids", "lens", "control", "data", "start").mapInArrow(light(decode), f"doc_id {kind}, start bigint, n_tokens bigint, {name} {'bigint' if digest else 'binary'}")


def op9_token_ids(spark, sf_dir: str) -> DataFrame:
    """Every document's ids by way of the files.

    A null text counts as empty and is its end id alone; rows with one doc_id stand next to each other in the order of their
    ids' checksums, repeated rows each for itself; null doc_ids come last; an empty table gives an empty result; other
    columns are left behind.
    """
    return read_ids(spark, write_ids(read_table(spark, sf_dir, "documents", ROWS)), digest=True)
