"""Cross-entropy difference: how much likelier each document is under a target model than under a background model.

Both are bigram models over one vocabulary, all words of all documents and the end of a text. A word's probability after another
is (pair + SMOOTH * single) / (before + SMOOTH): the counts of the pair and of the word before, and the word's own probability
(count + 1) / (all + vocabulary). So the probabilities after any word sum to 1, and losses are cross-entropies.

Counts are exact and grow with the corpus; nothing of a fixed size stands for them. Texts become chunks of coded words. Each
chunk sends its distinct words and pairs once, as sorted 64-bit hashes with their counts, to the bucket of their hashes' range;
a bucket adds the counts up and returns to each chunk the sums of what it sent, in the same order, so hashes travel one way only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loculus.llm.common import MOST_TASKS, arrow_type, light, read_table, shuffle_parts, write_table
from loculus.llm.tokens import plain_strings

#: Words of a chunk, more only where a text alone has them; words and pairs of a bucket as sent, about; the weight of single words, in counts.
CHUNK_WORDS, BUCKET_ITEMS, SMOOTH = 1 << 21, 1 << 21, 4.0
BROADCAST_ROWS = 1_000_000
U = np.uint64
EDGE = U(0x9E3779B97F4A7C15)


def split_words(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words [^ \\t-\\r]+ of texts in lower ASCII, coded, and how many each text has; null: none."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(plain_strings(texts), "")))
    flat = lists.flatten()
    real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    at = np.asarray(lists.offsets)
    at = at - at[0]
    sums = np.r_[0, np.cumsum(real)]
    return flat.filter(pa.array(real)).dictionary_encode(), np.diff(sums[at])


def pair_hash(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    x = before * U(0xBF58476D1CE4E5B9) + (word ^ (word >> U(29))) * U(0x94D049BB133111EB)
    x = (x ^ (x >> U(30))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def planes(x: np.ndarray) -> bytes:
    """Unsigned integers byte by byte of their value, low bytes of all first, so that what is small packs well."""
    width = max(1, -(-int(x.max(initial=0)).bit_length() // 8))
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unplanes(data: bytes, n: int) -> np.ndarray:
    wide = np.zeros((n, 8), np.uint8)
    if n:
        parts = np.frombuffer(data, np.uint8).reshape(-1, n)
        wide[:, : len(parts)] = parts.T
    return wide.view("<u8").ravel().astype(np.int64)


def sorted_bytes(h: np.ndarray) -> bytes:
    """Ascending hashes as their steps, each in as many bytes as the largest needs: all 64 bits, in less."""
    step = np.diff(h, prepend=U(0))
    width = max(1, -(-int(step.max(initial=0)).bit_length() // 8))
    return step.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def sorted_from(data: bytes, n: int) -> np.ndarray:
    wide = np.zeros((n, 8), np.uint8)
    if n:
        wide[:, : len(data) // n] = np.frombuffer(data, np.uint8).reshape(n, -1)
    return np.cumsum(wide.view("<u8").ravel(), dtype=U)


def coded(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, target) as chunks, a row each: part and chunk, doc_ids, whose they are, words a text, the words' hashes by falling count, and each text's words as numbers of these; sizes."""
    kind = docs.schema["doc_id"].dataType
    names = ["part", "chunk", "doc_ids", "target", "counts", "hashes", "codes", "n_words", "all_t", "all_g"]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        from pyspark import TaskContext

        part, number, kept, size = TaskContext.get().partitionId(), 0, [], 0

        def close() -> pa.RecordBatch:
            ids, target, counts = (pa.concat_arrays([x[k] for x in kept]) for k in (0, 1, 2))
            words = pa.chunked_array([x[3] for x in kept]).unify_dictionaries()
            names_ = words.chunk(0).dictionary
            codes = np.concatenate([c.indices.to_numpy(zero_copy_only=False) for c in words.chunks]).astype(np.int64)
            often = np.bincount(codes, minlength=len(names_))
            order = np.argsort(-often, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, names_.to_pylist()), U, len(names_))[order]
            counts = counts.to_numpy(zero_copy_only=False)
            target = target.to_numpy(zero_copy_only=False)
            row = [part, part << 32 | number, None, np.packbits(target).tobytes(), planes(counts), hashes.tobytes(), planes(rank[codes]), len(codes), int((counts + 1)[target].sum()), int((counts + 1)[~target].sum())]
            types = [pa.int64(), pa.int64(), None, *[pa.binary()] * 4, *[pa.int64()] * 3]
            columns = [pa.array([x], t) if k != 2 else pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids) for k, (x, t) in enumerate(zip(row, types))]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for b in (b.slice(at, 512) for b in batches for at in range(0, b.num_rows, 512)):
            words, counts = split_words(b.column(1))
            if kept and size + len(words) > CHUNK_WORDS:
                yield close()
                number, kept, size = number + 1, [], 0
            kept.append((b.column(0), b.column(2), pa.array(counts, pa.int64()), words))
            size += len(words)
        if kept:
            yield close()

    schema = f"part bigint, chunk bigint, doc_ids array<{kind.simpleString()}>, target binary, counts binary, hashes binary, codes binary, n_words bigint, all_t bigint, all_g bigint"
    return docs.select("doc_id", F.col("text").cast("string"), "target").mapInArrow(light(code), schema)


class Chunk:
    """What a chunk's row says: the pairs of its texts' words, an edge standing before the first and after the last, and its distinct words and pairs in the order of their hashes."""

    def __init__(self, target: bytes, counts: bytes, hashes: bytes, codes: bytes, n_docs: int, n_words: int):
        counts = unplanes(counts, n_docs)
        target = np.unpackbits(np.frombuffer(target, np.uint8), count=n_docs).astype(bool)
        self.hashes = np.r_[np.frombuffer(hashes, U), EDGE]
        edge = len(self.hashes) - 1
        self.row = np.repeat(np.arange(n_docs, dtype=np.int32), counts + 1)
        self.word = np.full(len(self.row), edge, np.int32)
        inner = np.ones(len(self.row), bool)
        inner[np.cumsum(counts + 1) - 1] = False
        self.word[inner] = unplanes(codes, n_words)
        self.n_docs, self.n = n_docs, counts + 1
        self.group = target[self.row]
        self.pair = self.word.astype(np.int64)
        self.pair[1:] += self.word[:-1].astype(np.int64) * len(self.hashes)
        self.pair[:1] += edge * len(self.hashes)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct words by their hashes: their codes, and their counts in target and background."""
        n = len(self.hashes)
        return np.argsort(self.hashes, kind="stable"), np.bincount(self.word[self.group], minlength=n), np.bincount(self.word[~self.group], minlength=n)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The distinct pairs by their hashes: hashes, codes, and counts in target and background."""
        x = np.sort(self.pair * 2 + self.group)
        starts = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
        n = np.diff(np.r_[starts, len(x)])
        x = x[starts]
        first = np.r_[True, x[1:] >> 1 != x[:-1] >> 1]
        at = np.cumsum(first) - 1
        codes = x[first] >> 1
        t, g = (np.bincount(at, n * own, len(codes)).astype(np.int64) for own in (x & 1, 1 - (x & 1)))
        h = pair_hash(self.hashes[codes // len(self.hashes)], self.hashes[codes % len(self.hashes)])
        order = np.argsort(h, kind="stable")
        return h[order], codes[order], t[order], g[order]


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> U(32)) * U(buckets) >> U(32)).astype(np.int64)


def summed(chunks: DataFrame, buckets: int) -> DataFrame:
    """For each chunk and bucket the counts over all documents of what the chunk has there: words first, then pairs; distinct: the words of the bucket, on one row of it."""
    tasks = min(buckets, MOST_TASKS)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                part, chunk, n_docs, target, counts, hashes, codes, n_words = (b.column(i)[k].as_py() for i in range(8))
                c = Chunk(target, counts, hashes, codes, n_docs, n_words)
                order, wt, wg = c.words()
                h, _, t, g = c.pairs()
                wh = c.hashes[order]
                of, pof = bucket_of(wh, buckets), bucket_of(h, buckets)
                used = np.union1d(of, pof)  # no more rows than words and pairs, however many buckets there are
                cuts, pcuts = ((np.searchsorted(x, used), np.searchsorted(x, used, "right")) for x in (of, pof))
                wt, wg = wt[order], wg[order]
                for at in range(0, len(used), 64):
                    rows = []
                    for n, bucket in enumerate(used[at : at + 64].tolist(), at):
                        i, j = slice(cuts[0][n], cuts[1][n]), slice(pcuts[0][n], pcuts[1][n])
                        rows.append((bucket % tasks, bucket, part, chunk, int(i.stop - i.start), int(j.stop - j.start), sorted_bytes(wh[i]), sorted_bytes(h[j]), planes(np.r_[wt[i], t[j]]), planes(np.r_[wg[i], g[j]])))
                    kinds = [pa.int32(), *[pa.int64()] * 5, *[pa.binary()] * 4]
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)], names=["task", "bucket", "part", "chunk", "words", "pairs", "wh", "ph", "t", "g"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def close() -> Iterator[pa.RecordBatch]:
            n = [r[2] + r[3] for r in rows]
            sums, distinct = [np.zeros(sum(n), np.int64) for _ in range(2)], 0
            counts = [np.concatenate([unplanes(r[k], m) for r, m in zip(rows, n)]) for k in (6, 7)]
            ends = np.cumsum(n)
            for first, which in ((True, 4), (False, 5)):
                own = [np.arange(e - m, e - m + r[2]) if first else np.arange(e - r[3], e) for r, m, e in zip(rows, n, ends)]
                at = np.concatenate(own)
                if not len(at):
                    continue
                h = np.concatenate([sorted_from(r[which], len(o)) for r, o in zip(rows, own)])
                order = np.argsort(h, kind="stable")
                h = h[order]
                starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
                times = np.diff(np.r_[starts, len(h)])
                for total, c in zip(sums, counts):
                    total[at[order]] = np.repeat(np.add.reduceat(c[at[order]], starts), times)
                distinct += len(starts) if first else 0
            for k, (r, m, e) in enumerate(zip(rows, n, ends)):
                out = [now, r[0], r[1], r[2], r[3], 0 if k else distinct, planes(sums[0][e - m : e]), planes(sums[1][e - m : e])]
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64() if i < 6 else pa.binary()) for i, x in enumerate(out)], names=["bucket", "part", "chunk", "words", "pairs", "distinct", "t", "g"])

        for b in batches:
            for k in range(b.num_rows):
                bucket = b.column(1)[k].as_py()
                if bucket != now and rows:
                    yield from close()
                    rows = []
                now = bucket
                rows.append([b.column(i)[k].as_py() for i in range(2, 10)])
        if rows:
            yield from close()

    sent = chunks.select("part", "chunk", F.size("doc_ids").cast("long").alias("n_docs"), "target", "counts", "hashes", "codes", "n_words").mapInArrow(light(send), "task int, bucket bigint, part bigint, chunk bigint, words bigint, pairs bigint, wh binary, ph binary, t binary, g binary")
    dealt = sent.repartitionById(tasks, "task").sortWithinPartitions("bucket", "chunk")
    return dealt.mapInArrow(light(add), "bucket bigint, part bigint, chunk bigint, words bigint, pairs bigint, distinct bigint, t binary, g binary")


def probability(pair: np.ndarray, before: np.ndarray, word: np.ndarray, every: int, vocabulary: int, smooth: float = SMOOTH) -> np.ndarray:
    """Of a word after another, from the counts of both together, of the one before, of the word, and of all words."""
    return (pair + smooth * (word + 1) / (every + vocabulary)) / (before + smooth)


def cross_entropy_difference(docs: DataFrame, target: DataFrame, smooth: float = SMOOTH) -> DataFrame:
    """Scores every row of docs: doc_id, n_tokens, loss_target, loss_background, score (their difference; lower: more like the target).

    target: the doc_ids whose rows train the target model; all other rows train the background model. Words and pairs of all
    rows count, each by itself. Losses are means over a text's words and its end, so null and empty texts have one token and a
    score too. Rows with one doc_id, or repeated, each count and each get a score; a row without doc_id is background. Without
    target rows that model finds all words equally likely. An empty table gives an empty result. Other columns are left behind.
    """
    spark = docs.sparkSession
    ids = target.select(F.col("doc_id").alias("_id")).filter("_id IS NOT NULL").distinct()
    few = ids.count() <= BROADCAST_ROWS
    marked = docs.select("doc_id", "text").join((F.broadcast(ids) if few else ids).withColumn("_is", F.lit(True)), F.col("doc_id") == F.col("_id"), "left").select("doc_id", "text", F.coalesce("_is", F.lit(False)).alias("target"))
    chunks = write_table(coded(marked), "lm-chunks")
    size = chunks.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("all_t", "all_g")], F.coalesce(F.sum(F.octet_length("hashes")), F.lit(0))).first()
    all_t, all_g, parts = int(size[0]), int(size[1]), shuffle_parts(spark)
    buckets = max(parts, (all_t + all_g + int(size[2]) // 8) // BUCKET_ITEMS)
    sums = write_table(summed(chunks, buckets), "lm-sums")
    vocabulary = int(sums.agg(F.coalesce(F.sum("distinct"), F.lit(0))).first()[0])
    doc_type = arrow_type(docs.schema["doc_id"].dataType)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, got = None, []

        def close() -> pa.RecordBatch:
            ids, *own = chunk
            c = Chunk(*own)
            edge = len(c.hashes)
            order, _, _ = c.words()
            _, codes, _, _ = c.pairs()
            by_code = np.argsort(codes)
            codes = codes[by_code]
            x = np.argsort(c.pair, kind="stable")
            ordered = c.pair[x]
            at = np.empty(len(x), np.int32)
            at[x] = np.cumsum(np.r_[False, ordered[1:] != ordered[:-1]], dtype=np.int32)
            del x, ordered
            loss = []
            for k, every in ((2, all_t), (3, all_g)):
                both = [unplanes(r[k], r[0] + r[1]) for r in got]
                single = np.empty(edge, np.int64)
                single[order] = np.concatenate([v[: r[0]] for r, v in zip(got, both)])
                pair = np.concatenate([v[r[0] :] for r, v in zip(got, both)])[by_code]
                p = -np.log(probability(pair, single[codes // edge], single[codes % edge], every, vocabulary, smooth))
                loss.append(np.bincount(c.row, p[at], c.n_docs) / c.n)
            return pa.RecordBatch.from_arrays([ids, pa.array(c.n), pa.array(loss[0]), pa.array(loss[1]), pa.array(loss[0] - loss[1])], names=["doc_id", "n_tokens", "loss_target", "loss_background", "score"])

        for b in batches:
            for k in range(b.num_rows):
                if b.column(2)[k].as_py() < 0:
                    if chunk:
                        yield close()
                    ids = b.column(3)[k].values.cast(doc_type)
                    chunk, got = (ids, *[b.column(i)[k].as_py() for i in (4, 5, 6, 7)], len(ids), b.column(8)[k].as_py()), []
                else:
                    got.append([b.column(i)[k].as_py() for i in (8, 9, 4, 5)])
        if chunk:
            yield close()

    # a partition of the texts goes to one task again, with all that came back for it
    none = lambda kind: F.lit(None).cast(kind)
    left = chunks.select("part", "chunk", F.lit(-1).cast("long").alias("bucket"), "doc_ids", F.col("target").alias("a"), F.col("counts").alias("b"), F.col("hashes").alias("c"), F.col("codes").alias("d"), F.col("n_words").alias("m"), none("bigint").alias("n"))
    right = sums.select("part", "chunk", "bucket", none(chunks.schema["doc_ids"].dataType.simpleString()).alias("doc_ids"), F.col("t").alias("a"), F.col("g").alias("b"), none("binary").alias("c"), none("binary").alias("d"), F.col("words").alias("m"), F.col("pairs").alias("n"))
    both = left.unionByName(right).withColumn("part", F.pmod("part", F.lit(parts)).cast("int"))
    dealt = both.repartitionById(parts, "part").sortWithinPartitions("chunk", "bucket")
    return dealt.mapInArrow(light(score), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, loss_target double, loss_background double, score double")


def op1_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """The target are the documents labelled as good; what marks others is not looked at."""
    good = read_table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return cross_entropy_difference(read_table(spark, sf_dir, "documents"), good)
