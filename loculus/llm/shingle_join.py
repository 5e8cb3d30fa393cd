"""N-gram Jaccard join by parity sketches: pigeonhole on the words of a sketch for each size band, then exact checks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loculus.llm.common import drop_table, free_shuffles, fresh, join_spread, light, read_table, shuffle_parts, write_table
from loculus.llm.components import components

WORDS, KEPT_WORDS, FLUSH = 5, 150_000, 300_000
#: Elements of a set for each word of a sketch, in bands of large sets and of small ones, where words must not run out.
ELEMENTS, SMALL = 2.0, 64
BITS = 1024
LONGS = BITS // 64
BROADCAST_ROWS = 1_000_000
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


STEPS = mix(np.arange(1, WORDS + 1, dtype=U)) | U(1)


class Shingles(dict):
    """The sets of texts: distinct 64-bit hashes of their runs of five words."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh3_64_intdigest(word)
        if len(self) >= KEPT_WORDS:
            self.clear()
        if len(word) <= 64:
            self[word] = h
        return h

    def of(self, text: bytes | None) -> np.ndarray:
        """Ascending; A-Z count as a-z, words end at ASCII white space; fewer than five words are one shingle, none are none."""
        words = (text or b"").lower().split()
        n = len(words)
        if not n:
            return np.zeros(0, U)
        h = np.fromiter(map(self.__getitem__, words), U, n)
        if n < WORDS:
            return mix((h * STEPS[:n]).sum(keepdims=True) + U(n))
        total = h[: n - WORDS + 1] * STEPS[0]
        for k in range(1, WORDS):
            total = total + h[k : n - WORDS + 1 + k] * STEPS[k]
        return np.unique(mix(total))


def key_of(found: np.ndarray) -> tuple[int, int]:
    import xxhash

    x = xxhash.xxh3_128_digest(found.tobytes())
    return tuple(int(v) for v in np.frombuffer(x, "<i8"))


def parity(found: np.ndarray) -> np.ndarray:
    """BITS bits as longs: each element turns one bit. Two sets' sketches differ in no more bits than the sets in elements."""
    return np.packbits((np.bincount((found & U(BITS - 1)).astype(np.int64), minlength=BITS) & 1).astype(np.uint8)).view("<i8")


def most_different(n: int) -> int:
    """|A - B| + |B - A| of sets with 100 * common >= 75 * union, the smaller of n elements: at most (|A| + |B|) / 7, |B| at most 4n/3."""
    return (n + 4 * n // 3) // 7


def bands(n: int) -> list[int]:
    """Sizes from 2^j up to 2^(j+1) are band j; a pair meets in the larger one's band."""
    own = n.bit_length() - 1
    return [own, own + 1] if 4 * n // 3 >= 2 << own else [own]


def sketch_words(found: np.ndarray) -> np.ndarray:
    """The words of a set's sketches that it shows to others, marked by band and place.

    In a band the hashes' range is cut into parts; a part's sketch word is the XOR of the hashes that fall into it, so an
    element more or less changes one word, and two sets with d different elements differ in d words at most. A set shows its
    first d + 1 words that aren't empty, d being the most that a partner may differ. Of two partners take the one that stops at the
    earlier part: of its d + 1 words one at least stands in the other's sketch too, in a part that the other shows as well.
    A set with fewer words shows all; two such sets meet by d + 1 common marks. In the same way partners that differ in e elements
    show min(d) + 1 - e words in common at least.
    """
    n = len(found)
    most = most_different(n)
    if not most:
        return np.zeros(0, U)  # partners are equal sets
    out = []
    for band in bands(n):
        parts = int((2 << band) / (ELEMENTS if (2 << band) > SMALL else 1))
        part = (found >> U(32)) * U(parts) >> U(32)
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        short = len(starts) <= most
        ends = starts[most + 1] if len(starts) > most + 1 else n
        starts = starts[: most + 1]
        words = np.bitwise_xor.reduceat(found[:ends], starts)
        out.append(mix(words + (part[starts] + U(band << 40)) * U(0x9E3779B97F4A7C15)))
        if short:
            out.append(mix(np.arange(most + 1, dtype=U) + U((band << 40) + 0xABCDEF0000)))
    return np.concatenate(out)


def turn(sig: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Another order of the keys for each word: which of them the others are checked against changes from word to word."""
    return mix((sig.astype(U) & U((1 << 40) - 1)) ^ key.view(U))


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, h (a hash of the text), n (elements), k1, k2 (a key of the set), s0, s1, ... (its parity sketch)."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles()
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                sets = map(shingles.of, part.column(2).cast(pa.large_binary()).to_pylist())
                rows = np.array([(len(s), *key_of(s), *parity(s)) for s in sets], np.int64).reshape(part.num_rows, 3 + LONGS)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *[pa.array(rows[:, k]) for k in range(3 + LONGS)]], names=["doc_id", "h", "n", "k1", "k2", *[f"s{k}" for k in range(LONGS)]])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64(F.col("text").cast("string")).alias("h"), F.col("text").cast("string")).mapInArrow(light(found), f"doc_id {kind}, h bigint, n bigint, k1 bigint, k2 bigint, " + ", ".join(f"s{k} bigint" for k in range(LONGS)))


def shared_words(docs: DataFrame, elements: int) -> DataFrame:
    """sig, key, center: sketch words that two keys or more show, with one key of each as its centre; one row at least for each key.

    Rows travel as arrays: each task sorts what it has, keeps one key of each word to be dealt by the word, and passes the other
    keys on as they are, so a word that very many texts show is one row a task where words are dealt.
    """
    spark = docs.sparkSession
    buckets = max(shuffle_parts(spark), min(1 << 24, elements * 47 // 100 // 500_000 + 1))

    def show(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles()
        words, keys, size = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            sig, key = np.concatenate(words), np.repeat(np.array([k for k, _ in keys], np.int64), [n for _, n in keys])
            order = np.lexsort((turn(sig, key), sig))
            sig, key = sig[order], key[order]
            keep = np.r_[True, (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])]
            sig, key = sig[keep], key[keep]
            starts = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
            count = np.diff(np.r_[starts, len(sig)])
            center = np.repeat(key[starts], count)
            again = np.repeat(count > 1, count)
            bucket = ((sig >> U(40)) * U(buckets) >> U(24)).astype(np.int64)
            full = (sig & U((1 << 40) - 1)).astype(np.int64) | bucket << 40
            rows = []
            if again.any():  # met within the task: dealt anywhere
                at = np.flatnonzero(again)
                for part in np.array_split(at, max(1, len(at) // 50_000)):
                    rows.append((int(key[part[0]] % buckets), 1, full[part].tobytes(), key[part].tobytes(), center[part].tobytes()))
            b, low, k = bucket[starts], full[starts], key[starts]
            cuts = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
            for i, j in zip(cuts, np.r_[cuts[1:], len(b)]):
                table, index = np.unique(k[i:j], return_inverse=True)
                five = np.ascontiguousarray(low[i:j]).view(np.uint8).reshape(-1, 8)[:, :5]
                rows.append((int(b[i]), 0, five.tobytes(), table.tobytes(), index.astype(np.uint32 if len(table) > 65535 else np.uint16).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), *[pa.array([r[k] for r in rows], pa.binary()) for k in (2, 3, 4)]], names=["bucket", "met", "sigs", "keys", "more"])

        for b in batches:
            for at in range(0, b.num_rows, 256):
                for text in b.column(0).slice(at, 256).cast(pa.large_binary()).to_pylist():
                    found = shingles.of(text)
                    got = sketch_words(found)
                    if len(got):
                        words.append(got)
                        keys.append((key_of(found)[0], len(got)))
                        size += len(got)
                    if size >= FLUSH:
                        yield from flush()
                        words, keys, size = [], [], 0
        if words:
            yield from flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["sig", "key", "center"]
        now, parts = None, []

        def close() -> Iterator[pa.RecordBatch]:
            sig, key = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((turn(sig, key), sig))
            sig, key = sig[order], key[order]
            starts = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
            count = np.diff(np.r_[starts, len(sig)])
            center = np.repeat(key[starts], count)
            open_ = np.repeat(key[starts] != key[starts + count - 1], count)
            first = np.r_[True, (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])]
            at = np.flatnonzero(open_ & first)
            for part in np.array_split(at, max(1, len(at) // 100_000)):
                yield pa.RecordBatch.from_arrays([pa.array(sig[part] | now << 40), pa.array(key[part]), pa.array(center[part])], names=names)

        for b in batches:
            for k in range(b.num_rows):
                bucket, met = b.column(0)[k].as_py(), b.column(1)[k].as_py()
                sigs, keys, more = (b.column(i)[k].as_buffer() for i in (2, 3, 4))
                keys = np.frombuffer(keys, np.int64)
                if met:
                    yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(sigs, np.int64)), pa.array(keys), pa.array(np.frombuffer(more, np.int64))], names=names)
                    continue
                if bucket != now and parts:
                    yield from close()
                    parts = []
                now = bucket
                wide = np.zeros((len(sigs) // 5, 8), np.uint8)
                wide[:, :5] = np.frombuffer(sigs, np.uint8).reshape(-1, 5)
                parts.append((wide.view(np.int64).ravel(), keys[np.frombuffer(more, np.uint32 if len(keys) > 65535 else np.uint16)]))
        if parts:
            yield from close()

    shown = docs.select(F.col("text").cast("string")).mapInArrow(light(show), "bucket bigint, met int, sigs binary, keys binary, more binary")
    dealt = shown.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return write_table(dealt.mapInArrow(light(meet), "sig bigint, key bigint, center bigint"), "shingle-words")


def may_link(a: str = "a", b: str = "b") -> Column:
    """What both sizes and both parity sketches allow."""
    na, nb = F.col(f"{a}_n"), F.col(f"{b}_n")
    apart = sum((F.bit_count(F.col(f"{a}_s{k}").bitwiseXOR(F.col(f"{b}_s{k}"))) for k in range(LONGS)), F.lit(0))
    return (na * 4 >= nb * 3) & (nb * 4 >= na * 3) & (apart * 7 <= na + nb)


def least_common(a: str = "a", b: str = "b") -> Column:
    """How many words two partners of these sizes show in common at least."""
    return F.expr(f"(least({a}_n, {b}_n) + least({a}_n, {b}_n) * 4 div 3) div 7 + 1 - ({a}_n + {b}_n) div 7")


def linked(pairs: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs a, b (nodes, each a class) whose whole texts' sets have 100 * common >= 75 * union. reps: node, and doc_id and h of one row of each class."""
    pairs = write_table(pairs, "shingle-pairs")
    ids = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    ids = write_table(reps.select("node", F.col("doc_id").alias("_id"), F.col("h").alias("_h")).join(ids, "node", "left_semi"), "shingle-ids")
    few = ids.count() <= BROADCAST_ROWS
    text = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    text = text.join(F.broadcast(ids) if few else ids, (text["h"] == ids["_h"]) & text["doc_id"].eqNullSafe(ids["_id"])).select("node", "text")
    # a row that is repeated, with its id, brings its text once
    text = write_table(text, "shingle-texts")
    if not text.groupBy("node").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").isEmpty():
        text = text.groupBy("node").agg(F.first("text").alias("text"))
    free_shuffles(docs.sparkSession)
    both = pairs.join(text.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b").join(text.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").select("a", "b", "ta", "tb")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles()
        last, own = None, None
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                ok = []
                for a, ta, tb in zip(part.column(0).to_pylist(), part.column(2).cast(pa.large_binary()).to_pylist(), part.column(3).cast(pa.large_binary()).to_pylist()):
                    if a != last:
                        last, own = a, shingles.of(ta)
                    other = shingles.of(tb)
                    both = len(np.intersect1d(own, other, assume_unique=True))
                    ok.append(100 * both >= 75 * (len(own) + len(other) - both))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(ok))

    return write_table(both.mapInArrow(light(check), "a bigint, b bigint"), "shingle-links")


def grouped(docs: DataFrame) -> DataFrame:
    """Every row's doc_id, h (a hash of its text), n, and of its component: component_id (least doc_id that isn't null) and keeper (the row that stays: its doc_id and h; null ids last). Both are null for rows with the empty set.

    Equal sets are one class from the start, known by a 64-bit hash of the set, so copies cost one row each and an id may stand
    for several classes. Every pair of classes that links is found or joined by others: such pairs show a common sketch word. Each
    class is checked against the centre of each of its words, which in a large group is another class for each word; where a
    word's classes then still lie in several components, all its pairs across them that their parity sketches and their common
    words allow are checked too.
    """
    rows = write_table(classes(docs), "shingle-classes")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    kinds = rows.filter("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("least"), F.min(row).alias("at"), F.first("n").alias("n"), *[F.first(f"s{k}").alias(f"s{k}") for k in range(LONGS)])
    # small numbers travel in less than hashes
    kinds = write_table(kinds.withColumn("node", F.monotonically_increasing_id()), "shingle-kinds")
    elements = rows.agg(F.sum("n")).collect()[0][0] or 0
    words = shared_words(docs, int(elements))
    free_shuffles(docs.sparkSession)
    named = kinds.select("k1", F.col("node").alias("rep"), "n", *[f"s{k}" for k in range(LONGS)])
    reps = kinds.select("node", "at.doc_id", "at.h")
    side = lambda c: named.select(F.col("k1").alias(f"{c}_k"), F.col("rep").alias(c), F.col("n").alias(f"{c}_n"), *[F.col(f"s{k}").alias(f"{c}_s{k}") for k in range(LONGS)])
    pairs = words.filter("key <> center").groupBy("center", "key").agg(F.count(F.lit(1)).alias("met"))
    pairs = pairs.join(side("a"), F.col("center") == F.col("a_k")).join(side("b"), F.col("key") == F.col("b_k")).filter(may_link())
    # where sketches of larger sets tell little, a pair should have met in some words; what this leaves out comes below
    pairs = pairs.filter((F.col("a_n") + F.col("b_n") <= 2 * BITS) | (F.col("met") * 4 >= least_common()))
    tried = write_table(pairs.select("a", "b").distinct(), "shingle-tried")
    links = linked(tried, reps, docs)
    found = components(links, "shingle-components")
    # words whose classes lie in several components
    member = words.select("sig", "key").distinct().join(named.select("k1", "rep"), F.col("key") == F.col("k1")).select("sig", "rep").join(found, F.col("rep") == F.col("node"), "left").select("sig", "rep", F.coalesce("component", "rep").alias("component"))
    member = write_table(member, "shingle-members")
    sizes = member.groupBy("sig", "component").agg(F.count(F.lit(1)).alias("c"))
    split = sizes.groupBy("sig").agg(F.max(F.struct("c", "component")).alias("top"), F.count(F.lit(1)).alias("parts")).filter("parts > 1").select("sig", F.col("top.component").alias("top"))
    open_ = write_table(member.join(split, "sig").join(named.drop("k1"), "rep"), "shingle-split")
    drop_table(member)
    free_shuffles(docs.sparkSession)
    as_side = lambda c: open_.select("sig", F.col("rep").alias(c), F.col("component").alias(f"{c}_c"), F.col("top").alias(f"{c}_top"), F.col("n").alias(f"{c}_n"), *[F.col(f"s{k}").alias(f"{c}_s{k}") for k in range(LONGS)])
    # each pair once: where neither is in the word's largest component, in the order of their keys
    more = as_side("a").filter("a_c <> a_top").join(as_side("b").drop("b_top"), "sig").filter((F.col("a_c") != F.col("b_c")) & ((F.col("b_c") == F.col("a_top")) | (F.col("a") < F.col("b"))) & may_link())
    more = more.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count(F.lit(1)).alias("met"), F.first(least_common()).alias("least")).filter("met >= least").select("a", "b")
    known = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = write_table(more.join(known, ["a", "b"], "left_anti"), "shingle-more")
    if not more.isEmpty():
        found = components(links.union(linked(more, reps, docs)), "shingle-components")
    for t in (words, tried, open_, more):
        drop_table(t)
    of = kinds.select("k1", "k2", "least", "at", "node").join(found, "node", "left").select("k1", "k2", "least", "at", F.coalesce("component", "node").alias("component"))
    of = write_table(of, "shingle-named")
    named = of.groupBy("component").agg(F.min("least").alias("component_id"), F.min("at").alias("keeper"), F.count(F.lit(1)).alias("c"))
    of = join_spread(of.select("k1", "k2", "component"), write_table(named, "shingle-least"), "component", "c")
    return rows.select("doc_id", "h", "n", "k1", "k2").join(of.select("k1", "k2", "component_id", "keeper"), ["k1", "k2"], "left").drop("k1", "k2")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Components of texts that share five-word runs: doc_id, n_shingles, component_id (the smallest doc_id of its component).

    A text's set has its distinct five-word shingles, of words [^ \\t-\\r]+ with A-Z as a-z; with fewer words the whole sequence as
    one. Two rows link when 100 * common >= 75 * union. Null texts and texts without words have the empty set, link with nothing
    and are their own component. Rows with one doc_id, or repeated, are rows of their own: each has the component of its own text,
    so an id whose texts don't link may show several. Rows with a null doc_id are compared like any others, and join texts that
    link through them; a component of such rows alone has a null id. An empty table gives an empty result. Other columns are left
    behind.
    """
    return grouped(docs).select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component, that of the smallest doc_id, all columns whatever their names; of rows with that id, the one
    whose text has the least hash, and of rows repeated as a whole any one. Null ids come last; null texts and texts without words all stay."""
    found = write_table(grouped(docs).filter("n > 0").select("doc_id", "h", "keeper"), "shingle-found")
    stays = (F.col("h") == F.col("keeper.h")) & F.col("doc_id").eqNullSafe(F.col("keeper.doc_id"))
    gone = found.filter(~stays).select(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).distinct()
    again = found.filter(stays).groupBy(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).agg(F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
    row, h = fresh(docs, "kept_row"), fresh(docs, "kept_hash")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias(row), F.xxhash64(docs["text"].cast("string")).alias(h))
    same = lambda t: (F.col(h) == t["_h"]) & F.col(f"{row}.doc_id").eqNullSafe(t["_id"])
    bounded = lambda t: F.broadcast(t) if t.count() <= BROADCAST_ROWS else t
    out = rows.join(bounded(gone), same(gone), "left_anti")
    if not again.isEmpty():
        once = out.join(bounded(again), same(again), "left_semi").groupBy(F.col(f"{row}.doc_id"), h).agg(F.first(row).alias(row)).select(row, h)
        out = out.join(bounded(again), same(again), "left_anti").select(row, h).unionByName(once)
    return out.select(f"{row}.*")


def op6_shingle_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op6_sql() -> str:
    """The same in DuckDB."""
    return r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_distinct(list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1 : i + 5], ' '))) END AS s FROM w),
u AS (SELECT DISTINCT s.s FROM s WHERE len(s) > 0),
k AS (SELECT row_number() OVER () AS k, s, len(s) AS n FROM (SELECT list_sort(s) AS s FROM u GROUP BY 1)),
d AS (SELECT s.doc_id, len(s.s)::BIGINT AS n, k.k FROM s LEFT JOIN k ON list_sort(s.s) = k.s),
e AS (SELECT k, n, hash(unnest(s)) AS h FROM k),
p AS (SELECT a.k AS a, b.k AS b FROM e a JOIN e b ON a.h = b.h AND a.k < b.k AND 4 * a.n >= 3 * b.n AND 4 * b.n >= 3 * a.n GROUP BY a.k, b.k, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
m AS (SELECT k, min(doc_id) AS least FROM d WHERE k IS NOT NULL GROUP BY k),
c AS (SELECT k AS k, k AS r FROM m UNION SELECT l.b, c.r FROM c JOIN l ON c.k = l.a),
f AS (SELECT c.k, min(m.least) AS component_id FROM c JOIN m ON m.k = c.r GROUP BY c.k)
SELECT d.doc_id, d.n AS n_shingles, coalesce(f.component_id, d.doc_id) AS component_id FROM d LEFT JOIN f ON f.k = d.k"""
