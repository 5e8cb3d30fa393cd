"""Document fingerprints: a Merkle tree over slices, paragraphs and sections, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loculus.llm.common import read_table, shuffle_parts, write_table

SLICE, SECTION, HEAD, FINE = 24, 8, 48, 4


def tree(text: Column) -> Column:
    """The paragraphs of a text without nulls, each an array of its leaves.

    Lines are paragraphs, each cut into slices of at most 24 code points, of 4 in the text's first 48, so that short texts have
    leaves too; a leaf is a 32-bit hash of its slice.
    """
    leaf = lambda s: F.hash(s)
    cut = lambda p, n: F.transform(F.regexp_extract_all(p, F.lit(f"(?s).{{1,{n}}}"), F.lit(0)), leaf)
    return F.transform(F.split(text, "\n", -1), lambda p, i: F.when(i == 0, F.concat(cut(F.substring(p, F.lit(1), F.lit(HEAD)), FINE), cut(F.substring(p, F.lit(HEAD + 1), F.length(p)), SLICE))).otherwise(cut(p, SLICE)))


def hex8(x: Column) -> Column:
    return F.lpad(F.lower(F.hex(x.cast("long").bitwiseAND(0xFFFFFFFF))), 8, "0")


def with_fingerprint(df: DataFrame, text: str, name: str, leaves: str) -> DataFrame:
    """Adds the fingerprint of column text as a string and its leaves as an array, for `likeness`.

    Eight paragraphs are a section. A paragraph's hash is one over its leaves, a section's over its paragraphs, and the root is
    the SHA-256 of the section hashes with the text's length and hash, so equal texts have equal roots. The string is
    root:section;section;..., a section hash(paragraph,paragraph,...), a paragraph hash=leaf.leaf...
    """
    n = "_p_" + name
    df = df.withColumn(n, tree(F.col(text)))
    para = F.transform(n, lambda p: F.struct(F.xxhash64(p).alias("h"), F.array_join(F.transform(p, hex8), ".").alias("s")))
    df = df.withColumn(n + "h", para)
    count = F.size(n + "h")
    groups = F.transform(F.sequence(F.lit(0), F.floor((count - 1) / SECTION).cast("int")), lambda i: F.slice(n + "h", i * SECTION + 1, SECTION))
    section = F.transform(groups, lambda g: F.struct(
        F.lower(F.hex(F.xxhash64(F.transform(g, lambda p: p["h"])))).alias("h"),
        F.array_join(F.transform(g, lambda p: F.concat(F.lower(F.hex(p["h"])), F.lit("="), p["s"])), ",").alias("s"),
    ))
    df = df.withColumn(n + "s", section)
    root = F.sha2(F.concat_ws(";", F.array_join(F.transform(n + "s", lambda s: s["h"]), ";"), F.length(text).cast("string"), F.xxhash64(text).cast("string")), 256)
    body = F.array_join(F.transform(n + "s", lambda s: F.concat(s["h"], F.lit("("), s["s"], F.lit(")"))), ";")
    return df.withColumns({name: F.concat(root, F.lit(":"), body), leaves: F.flatten(n)}).drop(n, n + "h", n + "s")


def likeness(a: Column, b: Column) -> Column:
    """Of the two trees' distinct leaves, the share that both have: 2 * common / (all of a + all of b); two empty trees: 1."""
    a, b = F.array_distinct(a), F.array_distinct(b)
    total = F.size(a) + F.size(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / total)


def differing_sections(a: Column, b: Column) -> Column:
    """Numbers (from 0) of the sections of fingerprint string a whose hash fingerprint string b doesn't have at that place; empty for equal roots."""
    parts = lambda x: F.split(F.substring_index(x, ":", -1), ";", -1)
    head = lambda x: F.substring_index(x, "(", 1)
    return F.when(F.substring_index(a, ":", 1) == F.substring_index(b, ":", 1), F.array().cast("array<int>")).otherwise(
        F.filter(F.sequence(F.lit(0), F.size(parts(a)) - 1), lambda i: ~F.coalesce(head(F.get(parts(a), i)) == head(F.get(parts(b), i)), F.lit(False)))
    )


def next_rows(keys: DataFrame, name: str) -> DataFrame:
    """keys: distinct doc_id, h, and n. Adds next_id, next_h: the next row by (doc_id, h), null ids last; after the last the first.

    Rows are dealt by ranges and written, so that each range looks ahead by itself; the first row of each range, one a task, is
    broadcast.
    """
    by = [F.col("doc_id").asc_nulls_last(), F.col("h")]
    spark = keys.sparkSession
    ranged = write_table(keys.repartitionByRange(shuffle_parts(spark), *by).withColumn("_pid", F.spark_partition_id()), name)
    own = Window.partitionBy("_pid").orderBy(*by)
    firsts = ranged.withColumn("_k", F.row_number().over(own)).filter("_k = 1").select(F.col("_pid").alias("_at"), F.struct("doc_id", "h").alias("_first"))
    whole = Window.partitionBy().orderBy("_at")
    ahead = firsts.select("_at", F.coalesce(F.lead("_first").over(whole), F.first("_first").over(whole)).alias("_ahead"))
    out = ranged.withColumn("_next", F.lead(F.struct("doc_id", "h")).over(own)).join(F.broadcast(ahead), F.col("_pid") == F.col("_at"))
    return out.withColumn("_next", F.coalesce("_next", "_ahead")).select("doc_id", "h", "n", F.col("_next.doc_id").alias("next_id"), F.col("_next.h").alias("next_h"))


def key(doc_id: str) -> Column:
    """An integer id, or null, as a join key."""
    return F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints every row's text and its edited text, and compares with that and with the next row's text.

    The edited text has the last floor(n/4) of n code points replaced by as many from the start of the next text, or all of it.
    A null text is an empty one. Rows stand by doc_id, null ids last, rows of one id by a hash of their texts; rows repeated
    with id and text count as one for "next" and each get the same result. One row alone is its own next. An empty table
    gives an empty result. Other columns are left behind. Only texts are shuffled, once whole and once a quarter.
    """
    # both joins read the same columns of d, so that one shuffle of the texts serves both; the id comes back from its key
    kind = docs.schema["doc_id"].dataType.simpleString()
    d = docs.select(key("doc_id").alias("key"), F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    keys = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).select("doc_id", F.xxhash64("text").alias("h"), F.length("text").alias("n")).distinct()
    nexts = next_rows(keys, "fingerprints").select(key("doc_id").alias("cur_key"), F.col("h").alias("cur_h"), F.col("n").alias("cur_n"), key("next_id").alias("next_key"), "next_h")
    ahead = d.join(nexts, (d["key"] == nexts["next_key"]) & (d["h"] == nexts["next_h"]))
    ahead = ahead.select("cur_key", "cur_h", F.substring("text", F.lit(1), F.floor(F.col("cur_n") / 4).cast("int")).alias("head"), F.flatten(tree(F.col("text"))).alias("next_leaves"))
    # rows repeated in docs give the same values here; the join below takes this shuffle as it is
    ahead = ahead.groupBy("cur_key", "cur_h").agg(F.first("head").alias("head"), F.first("next_leaves").alias("next_leaves"))
    both = d.join(ahead, (d["key"] == ahead["cur_key"]) & (d["h"] == ahead["cur_h"]))
    both = both.withColumn("n_chars", F.length("text").cast("long"))
    both = both.withColumn("edited", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - F.floor(F.col("n_chars") / 4)).cast("int")), "head"))
    both = with_fingerprint(both, "text", "fingerprint", "leaves")
    both = with_fingerprint(both, "edited", "edited_fingerprint", "edited_leaves")
    return both.select(
        F.nullif("key", F.lit("null")).cast(kind).alias("doc_id"), "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("leaves"), F.col("edited_leaves")).alias("near_edited"), likeness(F.col("leaves"), F.col("next_leaves")).alias("near_next"),
    )


def op3_fingerprints(spark, sf_dir: str) -> DataFrame:
    return compare_with_edits(read_table(spark, sf_dir, "documents"))
