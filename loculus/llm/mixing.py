"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Each slot of the schedule takes one block of one source, where the golden ratio's point of the slot falls into that source's
interval of the cumulative quotas. So every prefix of the slots holds the sources in their shares but for a few blocks, and the
slots say what is taken of each document, how often, and where in the mix it stands.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loculus.llm.common import SPACES, fresh, light, prefix_sums, read_table, shuffle_parts, write_table

WEIGHTS, BLOCK, SHARE, MOST = (5, 2, 1), 1024, (3, 2), 2
#: The fraction of the golden ratio as a 64-bit fixed-point step.
GOLDEN = 0x9E3779B97F4A7C15
CHUNK = 1 << 16
BROADCAST_ROWS = 1_000_000


def word_counts(column: pa.Array, rows: int = 512) -> np.ndarray:
    """How many words [^ \\t-\\r]+ each text has; null: 0. All words end or begin at ASCII bytes, so bytes are enough."""
    if len(column) > rows:  # what is counted with takes many times the texts' own memory
        return np.concatenate([word_counts(column.slice(at, rows)) for at in range(0, len(column), rows)])
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return np.zeros(0, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    space = np.ones(256, bool)
    space[:] = False
    space[list(SPACES)] = True
    gap = space[data]
    begins = ~gap
    begins[1:] &= gap[:-1]
    inner = offsets[:-1][(offsets[:-1] < len(data)) & (offsets[:-1] < offsets[1:])]
    begins[inner] = ~gap[inner]
    sums = np.zeros(len(data) + 1, np.int64)
    np.cumsum(begins, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, h (a hash of the text), source, size of every row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(word_counts(b.column(3)), pa.int64())], names=["doc_id", "h", "source", "size"])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    text = F.col("text").cast("string")
    return docs.select("doc_id", F.xxhash64(text).alias("h"), F.col("source").cast("string"), text.alias("text")).mapInArrow(light(count), f"doc_id {kinds['doc_id']}, h bigint, source string, size bigint")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, most: int = MOST) -> DataFrame:
    """A row for each source: source, source_no, source_size, target. One row a source, so the windows here see sources, not documents.

    Sources by code point, null last, get the weights in turn. Together they are to take share[0]/share[1] of all words. A
    target above `most` times its source stops there, and the others share the rest by weight: with the sources by rising
    ratio of limit to weight, the first k stop, k being the least count after which the rest of the words for each unit
    of weight is no more than the next ratio.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumns({"source_no": F.row_number().over(order) - 1, "_w": w})
    s = s.withColumns({"_limit": F.col("source_size") * most, "_ratio": F.col("source_size") * most / F.col("_w")})
    upto = Window.orderBy("_ratio", "source_no").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    s = s.withColumns({
        "_rest": F.sum("source_size").over(everything) * share[0] / share[1] - F.coalesce(F.sum("_limit").over(upto), F.lit(0)),
        "_weight": F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(upto), F.lit(0)),
    })
    s = s.withColumn("_level", F.col("_rest") / F.col("_weight"))
    # the first source in this order that doesn't stop sets the level for all
    s = s.withColumn("_free", F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "source_no", "_level"))).over(everything))
    return s.select("source", "source_no", "source_size", F.least(F.col("_limit").cast("double"), F.col("_w") * F.coalesce(F.col("_free._level"), F.col("_ratio"))).alias("target"))


def schedule(spark, plan: list[tuple[int, int, int]], block: int) -> DataFrame:
    """The mix as slots: slot, source_no, pass, block, words.

    plan: source_no, source_size, quota of each source that takes words. Slot i of the first sum(ceil(quota / block)) has the
    point frac(i * golden ratio), which falls into one source's interval of the cumulative quotas. A source's slots are
    ranked; rank k takes block k modulo the source's number of blocks in pass k div that number, and a source stops when its
    quota is full; its later slots stay empty. What the points leave short, a few blocks a source, has the slots after them.
    """
    no = np.array([p[0] for p in plan], np.int64)
    size = np.array([p[1] for p in plan], np.int64)
    quota = np.array([p[2] for p in plan], np.int64)
    blocks = -(-size // block)
    passes = quota // size
    need = passes * blocks + -(-(quota - passes * size) // block)  # ranks until the quota is full
    bounds = np.cumsum(quota.astype(object))
    edges = np.array([int(b) * 2**64 // int(bounds[-1]) - (int(b) == int(bounds[-1])) for b in bounds], np.uint64)
    slots, many = int(need.sum()), len(plan)
    chunks = max(1, -(-slots // CHUNK))

    def drawn(chunk: int) -> np.ndarray:
        i = np.arange(chunk * CHUNK + 1, min(slots, (chunk + 1) * CHUNK) + 1, dtype=np.uint64)
        return np.searchsorted(edges, i * np.uint64(GOLDEN), side="left").clip(0, many - 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk in b.column(0).to_numpy():
                found = np.bincount(drawn(int(chunk)), minlength=many)
                at = np.flatnonzero(found)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), chunk)), pa.array(at.astype(np.int64)), pa.array(found[at])], names=["chunk", "plan", "n"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                if row["chunk"] >= 0:
                    got = drawn(row["chunk"])
                    before = dict(zip(row["plans"], row["befores"]))
                    order = np.argsort(got, kind="stable")
                    ranked = got[order]
                    starts = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
                    rank = np.arange(len(got)) - np.repeat(starts, np.diff(np.r_[starts, len(got)])) + np.array([before[int(p)] for p in ranked[starts]]).repeat(np.diff(np.r_[starts, len(got)]))
                    slot, p = order + row["chunk"] * CHUNK, ranked
                else:  # one row a source: the ranks that the points left out
                    (many_, at), p = row["befores"], row["plans"][0]
                    p, rank, slot = np.repeat(p, many_), need[p] - many_ + np.arange(many_), slots + at + np.arange(many_)
                keep = rank < need[p]
                p, rank, slot = p[keep], rank[keep], slot[keep]
                at = rank % blocks[p]
                left = quota[p] - (rank // blocks[p]) * size[p] - at * block
                words = np.minimum(np.minimum(block, size[p] - at * block), left)
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (slot, no[p], rank // blocks[p], at, words)], names=["slot", "source_no", "pass", "block", "words"])

    counts = spark.range(0, chunks, 1, min(chunks, 4096)).mapInArrow(light(count), "chunk bigint, plan bigint, n bigint")
    counts = write_table(counts, "mixing-slots")
    w = Window.partitionBy("plan").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
    per_chunk = ranks.groupBy("chunk").agg(F.collect_list("plan").alias("plans"), F.collect_list("before").alias("befores"))
    have = {r["plan"]: r["n"] for r in counts.groupBy("plan").agg(F.sum("n").alias("n")).collect()}
    short, last = [], 0
    for i in range(many):  # one a source
        if need[i] > have.get(i, 0):
            short.append((-1, [i], [int(need[i] - have.get(i, 0)), last]))
            last += int(need[i] - have.get(i, 0))
    kind = "chunk bigint, plans array<bigint>, befores array<bigint>"
    return per_chunk.unionByName(spark.createDataFrame(short, kind)).mapInArrow(light(deal), "slot bigint, source_no bigint, pass bigint, block bigint, words bigint")


def takes(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, block: int = BLOCK, seed: str = "mix") -> tuple[DataFrame, DataFrame | None]:
    """The rows (doc_id, h, source, size, source_no, source_size, target, _begin: words before it in its source) and what the slots take of them.

    The second table has a row for each row and pass of which slots take words: source_no, _begin, pass, slot (the first that
    does), slots (how many do), words. None: nothing is taken.
    """
    spark = docs.sparkSession
    rows = sized(docs)
    order = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    at = write_table(prefix_sums(rows.withColumn("_order", order), "source", ["_order", "doc_id", "size", "h"], {"_begin": "size"}, "mixing"), "mixing-rows").drop("_order")
    plan = write_table(targets(at, weights), "mixing-plan")
    used = plan.filter("target >= 0.5").orderBy("source_no").collect()  # one row a source
    out = at.join(F.broadcast(plan) if len(used) <= 100_000 else plan, at["source"].eqNullSafe(plan["source"])).drop(plan["source"])
    if not used:
        return out, None
    slots = schedule(spark, [(r["source_no"], r["source_size"], int(r["target"] + 0.5)) for r in used], block)
    pieces = out.filter("size > 0").select("source_no", "_begin", "size", F.explode(F.expr(f"sequence(_begin div {block}, (_begin + size - 1) div {block})")).alias("block"))
    pieces = pieces.select("source_no", "_begin", "block", F.greatest(F.lit(0), F.col("_begin") - F.col("block") * block).alias("_from"), F.least(F.lit(block), F.col("_begin") + F.col("size") - F.col("block") * block).alias("_to"))
    cut = pieces.join(slots, ["source_no", "block"]).withColumn("_cut", F.least("_to", "words") - F.col("_from")).filter("_cut > 0")
    got = cut.groupBy("source_no", "_begin", "pass").agg(F.min("slot").alias("slot"), F.count(F.lit(1)).alias("slots"), F.sum("_cut").alias("words"))
    return out, got


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, block: int = BLOCK, seed: str = "mix") -> DataFrame:
    """What the mix takes of each row: doc_id, source, size, source_size, target, taken, first_slot, n_slots.

    A source's rows stand in the order of md5(seed, doc_id), rows of one doc_id together, and their words form one stream that
    is cut into equal blocks; a schedule of slots takes blocks, first all once, then again. taken counts the words of a row in
    the blocks that its source's slots take, at most twice its size; first_slot is the first slot that takes any (null: none),
    n_slots how many do. Each source takes its target, rounded. Null texts and texts without words have size 0 and are taken 0
    times; null sources are one source, the last; null doc_ids come last in their source; rows with one doc_id, or repeated, are
    rows of their own; an empty table gives an empty result. Other columns are left behind.
    """
    out, got = takes(docs, weights, block, seed)
    if got is None:
        return out.select("doc_id", "source", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("first_slot"), F.lit(0).cast("long").alias("n_slots"))
    got = got.groupBy("source_no", "_begin").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"), F.sum("slots").alias("n_slots"))
    full = out.join(got, (out["source_no"] == got["source_no"]) & (out["_begin"] == got["_begin"]) & (out["size"] > 0), "left")
    return full.select("doc_id", out["source"], "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot", F.coalesce("n_slots", F.lit(0)).cast("long").alias("n_slots"))


def mixed_rows(docs: DataFrame, **how) -> DataFrame:
    """The mix as rows with the columns of docs, whatever their names: a row for each pass that takes a text, whole or its first words.

    Rows stand in the order of the first slots that take them, partition after partition, so that what is read in this order has
    all sources in their shares at any point. Rows without words are not taken. Rows with one doc_id and other texts are
    taken each for itself; of rows repeated with id and text one stands for all. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    out, got = takes(docs, **how)
    if got is None:
        return docs.limit(0)
    at, cut, part, h, row = (fresh(docs, f"mixed_{x}") for x in ("slot", "words", "part", "hash", "row"))
    got = got.join(out.filter("size > 0").select("source_no", "_begin", "doc_id", "h", "size"), ["source_no", "_begin"])
    got = write_table(got.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), F.col("slot").alias(at), F.col("_begin").alias("_order"), F.when(F.col("words") < F.col("size"), F.col("words")).otherwise(F.lit(0)).alias(cut)), "mixing-takes")
    again = out.filter("size > 0").groupBy(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).agg(F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
    again = write_table(again, "mixing-again")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias(row), F.xxhash64(docs["text"].cast("string")).alias(h))
    same = lambda t: (F.col(h) == t["_h"]) & F.col(f"{row}.doc_id").eqNullSafe(t["_id"])
    bounded = lambda t: F.broadcast(t) if t.count() <= BROADCAST_ROWS else t
    if not again.isEmpty():
        once = rows.join(bounded(again), same(again), "left_semi").groupBy(F.col(f"{row}.doc_id"), h).agg(F.first(row).alias(row)).select(row, h)
        rows = rows.join(bounded(again), same(again), "left_anti").select(row, h).unionByName(once)
    last, parts = got.agg(F.max(at)).first()[0] or 0, shuffle_parts(spark)
    both = rows.join(bounded(got), same(got)).withColumn(part, (F.col(at) * parts / F.lit(last + 1)).cast("int"))
    both = both.repartitionById(parts, part).sortWithinPartitions(at, "_order").select(f"{row}.*", cut)
    text, length = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def shortened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(k, 256) for b in batches for k in range(0, b.num_rows, 256)):
            words, columns = b.column(b.num_columns - 1).to_pylist(), list(b.columns[:-1])
            if any(words):
                texts = [first_words(t, n) if n else t for t, n in zip(b.column(text).to_pylist(), words)]
                columns[text] = pa.array(texts, columns[text].type)
                if length is not None:
                    columns[length] = pa.array([len(t) if n else c for t, n, c in zip(texts, words, columns[length].to_pylist())], columns[length].type)
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names[:-1])

    return both.mapInArrow(light(shortened), docs.schema)


def first_words(text: str, n: int) -> str:
    """The text up to the end of its n-th word."""
    import re

    m = re.match(rf"(?:[ \t-\r]*[^ \t-\r]+){{{n}}}", text)
    return m.group() if m else text


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "first_slot", "n_slots")


def op5_sql(weights: tuple[int, ...] = WEIGHTS, seed: str = "mix", block: int = BLOCK) -> str:
    """The same in DuckDB, point by point."""
    return f"""
WITH d AS (SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::BIGINT AS size, md5('{seed}' || coalesce(doc_id::VARCHAR, '')) AS o FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no FROM d GROUP BY source),
w AS (SELECT *, [{", ".join(map(str, weights))}][(no % {len(weights)} + 1)::BIGINT] AS w, source_size * 2 AS lim FROM s),
r AS (SELECT *, lim / w AS ratio FROM w),
l AS (SELECT *, (sum(source_size) OVER () * 3 / 2 - coalesce(sum(lim) OVER u, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER u, 0)) AS lev FROM r WINDOW u AS (ORDER BY ratio, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, no, source_size, least(lim::DOUBLE, w * (SELECT arg_min(lev, (ratio, no)) FROM l WHERE lev <= ratio)) AS target FROM l),
p AS (SELECT d.*, t.no, t.source_size, t.target, row_number() OVER () AS k, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY o, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT no, source_size AS size, floor(target + 0.5)::BIGINT AS quota, (source_size + {block - 1}) // {block} AS blocks FROM t WHERE target >= 0.5),
n AS (SELECT *, row_number() OVER (ORDER BY no) - 1 AS plan, (quota // size * blocks + (quota % size + {block - 1}) // {block})::BIGINT AS need, sum(quota) OVER (ORDER BY no)::UHUGEINT AS upto, sum(quota) OVER ()::UHUGEINT AS total FROM q),
e AS (SELECT *, upto * 18446744073709551616::UHUGEINT // total - CASE WHEN upto = total THEN 1 ELSE 0 END::UHUGEINT AS edge FROM n),
i AS (SELECT i, (i::UHUGEINT * {GOLDEN}::UHUGEINT) % 18446744073709551616::UHUGEINT AS x FROM range(1, 1 + coalesce((SELECT sum(need) FROM n), 0)::BIGINT) t(i)),
z AS (SELECT i - 1 AS slot, (SELECT count(*) FROM e WHERE edge < i.x) AS plan FROM i),
y AS (SELECT slot, plan, row_number() OVER (PARTITION BY plan ORDER BY slot) - 1 AS rank FROM z),
h AS (SELECT n.plan, n.need, count(y.slot) AS have FROM n LEFT JOIN y ON y.plan = n.plan GROUP BY n.plan, n.need),
g AS (SELECT plan, have, need - have AS short, (SELECT count(*) FROM z) + coalesce(sum(need - have) OVER (ORDER BY plan ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM h WHERE need > have),
a AS (SELECT y.slot, y.plan, y.rank FROM y JOIN n ON n.plan = y.plan WHERE y.rank < n.need UNION ALL SELECT first + j, plan, have + j FROM (SELECT *, unnest(range(short)) AS j FROM g)),
c AS (SELECT a.slot::BIGINT AS slot, n.no, a.rank % n.blocks AS block, least({block}, n.size - a.rank % n.blocks * {block}, n.quota - a.rank // n.blocks * n.size - a.rank % n.blocks * {block}) AS words FROM a JOIN n ON n.plan = a.plan),
f AS (SELECT k, no, b, size, unnest(range(b // {block}, (b + size - 1) // {block} + 1)) AS block FROM p WHERE size > 0),
v AS (SELECT f.k, c.slot, least({block}, f.b + f.size - f.block * {block}, c.words) - greatest(0, f.b - f.block * {block}) AS cut FROM f JOIN c ON c.no = f.no AND c.block = f.block),
m AS (SELECT k, sum(cut)::BIGINT AS taken, min(slot) AS first_slot, count(*)::BIGINT AS n_slots FROM v WHERE cut > 0 GROUP BY k)
SELECT p.doc_id, p.size, p.source_size, p.target, coalesce(m.taken, 0)::BIGINT AS taken, m.first_slot, coalesce(m.n_slots, 0)::BIGINT AS n_slots FROM p LEFT JOIN m ON m.k = p.k"""
