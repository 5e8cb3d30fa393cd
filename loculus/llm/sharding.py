"""Sharding: contiguous shards of near-equal bytes, cut from global prefix sums of the documents' sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loculus.llm.common import prefix_sums, read_table


def shard_by_bytes(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Puts every row of docs into one of `shards` shards: id_col, size, text_crc32, shard, slot.

    A row's size is the UTF-8 bytes of its text (null: none) plus 1. Rows stand in ascending id (null ids last; rows of one
    id by checksum and size), and the row whose bytes begin at B of TOTAL goes to shard floor(B * shards / TOTAL): the
    shards are contiguous, their sizes are equal but for one row, and slot numbers a shard's rows from 0 without gaps.
    Repeated rows are rows of their own. An empty table gives an empty result. Other columns are left behind. Only ids,
    sizes and checksums are shuffled, never texts.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit(1).cast("long").alias("_one"))
    at = prefix_sums(rows, None, [id_col, "text_crc32", "size"], {"_begin": "size", "_row": "_one"}, "sharding")
    total = at.agg(F.sum("size")).collect()[0][0] or 1
    # begin * shards stays below 2^63 up to 500 PB in 16 shards
    cut = at.withColumn("shard", F.expr(f"int((_begin * {int(shards)}) div {int(total)})"))
    first = {r["shard"]: r["row"] for r in cut.groupBy("shard").agg(F.min("_row").alias("row")).collect()}
    slot = F.lit(0).cast("long")
    for shard, row in sorted(first.items()):
        slot = F.when(F.col("shard") == shard, F.col("_row") - F.lit(row).cast("long")).otherwise(slot)
    return cut.select(id_col, "size", "text_crc32", "shard", slot.alias("slot"))


def op10_sharding(spark, sf_dir: str) -> DataFrame:
    out = shard_by_bytes(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_sql(shards: int = 16) -> str:
    """The same in DuckDB. The checksum's table of 256 entries follows from its polynomial."""
    table = []
    for i in range(256):
        for _ in range(8):
            i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
        table.append(i)
    return f"""
WITH t AS (SELECT doc_id, encode(coalesce(text, '')) AS b, [{", ".join(f"{x}::UBIGINT" for x in table)}] AS tab FROM documents),
s AS (SELECT doc_id, octet_length(b)::BIGINT + 1 AS size,
        xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(octet_length(b)::BIGINT), lambda i: ('0x' || substr(hex(b), (2 * i + 1)::BIGINT, 2))::UBIGINT)),
            lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255)::BIGINT + 1])), 4294967295::UBIGINT)::BIGINT AS text_crc32 FROM t),
p AS (SELECT *, coalesce(sum(size) OVER (ORDER BY doc_id, text_crc32, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b, sum(size) OVER ()::BIGINT AS total FROM s),
c AS (SELECT *, (b * {shards} // total)::INTEGER AS shard FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY b) - 1 AS slot, NULL::INTEGER AS grown_shard FROM c"""
