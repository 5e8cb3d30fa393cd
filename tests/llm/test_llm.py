"""The operators against brute force on small tables with nulls, empty texts, ties, repeated rows, and extra columns."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from loculus.llm import binary, fingerprints, hnsw, lm_scoring, mixing, packing, quality, sharding, shingle_join, toxicity
from loculus.llm.components import components
from loculus.llm.registry import QUERIES, SQL
from loculus.llm.tokens import tokenizer_path, word_ids
from tests.conftest import SMALL, same_rows

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def odd_docs(seed: int = 1, n: int = 60):
    """Texts with near copies, copies, nulls, and very long ones; null sources; ids are the rows' numbers."""
    rnd = random.Random(seed)
    vocabulary = ["the", "of", "Stone", "river,", "night", "over", "É té", "light.", "run", "a", "b-c", "don't", "12.5"] + [f"w{k}" for k in range(200)]
    texts = []
    for _ in range(n):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice([1, 3, 4, 5, 8, 30, 60, 120]))]
        for _ in range(rnd.choice([1, 1, 2, 3])):
            own = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2])):
                own[rnd.randrange(len(own))] = rnd.choice(vocabulary)
            texts.append(rnd.choice([" ", "\n", " "]).join(own))
    texts += [None, "", "   ", "x", "x", " ".join(rnd.choice(vocabulary) for _ in range(9000)), "<|endoftext|> end", "tab\tand\x0bline\r\nends"]
    rows = [(k, t, "en", rnd.choice(["a", "b", "c", None]) if k % 3 else "a", None if t is None else len(t)) for k, t in enumerate(texts)]
    return rows


def frame(spark, rows):
    """With columns that operators might clash with."""
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, DOC).withColumns({c: F.lit(1) for c in ("size", "shard", "key", "h", "n", "score", "label", "sig", "block", "target", "file", "node")}).repartition(5)


def empty(spark):
    return spark.createDataFrame([], DOC)


def words(t):
    return (t or "").encode().split()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(name, spark, duck):
    same_rows(QUERIES[name](spark, SMALL).toPandas(), duck.sql(SQL[name]).df())


def test_tokens_are_the_tokenizers():
    import pyarrow as pa

    w = word_ids(tokenizer_path())
    texts = [r[1] for r in odd_docs()] + ["I'LL GO. don't,", "Ångström. É́a, ﬁ.", "a b c.", "x.,y ,. ..", "ΣΑΣ. İstanbul,", "日本語。テスト, 12.5%,\x1c\x85z", "'s 's. it's. ('s) (a) \"b\"", "ǅ. K, Å. ™. <|STARTOFTEXT|>"]
    for part in (pa.array(texts), pa.array(["pad"] * 7 + texts).slice(7), pa.array(["à"] * 7 + texts, pa.large_string()).slice(7)):
        flat, at = w.encode_many(part)
        for k, t in enumerate(texts):
            assert flat[at[k] : at[k + 1]].tolist() == w.tokenizer.encode(t or "", add_special_tokens=False).ids


def test_sharding(spark):
    rows = odd_docs()
    got = sorted(sharding.shard_by_bytes(frame(spark, rows), 4).collect(), key=lambda r: r["doc_id"])
    total, begin, slot = sum(len((t or "").encode()) + 1 for _, t, *_ in rows), 0, defaultdict(int)
    for r, (i, t, *_) in zip(got, rows):
        b = (t or "").encode()
        assert (r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) == (i, len(b) + 1, zlib.crc32(b), begin * 4 // total, slot[begin * 4 // total])
        slot[begin * 4 // total] += 1
        begin += len(b) + 1
    assert sharding.shard_by_bytes(empty(spark)).count() == 0
    twice = spark.createDataFrame([(1, "a", None, None, 1), (1, "a", None, None, 1), (None, None, None, None, None)], DOC)
    assert sorted(r["slot"] for r in sharding.shard_by_bytes(twice, 1).collect()) == [0, 1, 2]


def test_mixing(spark):
    rows = odd_docs() + [(None, "no id here", "en", "b", 10)]
    got = mixing.mix(frame(spark, rows), block=16).collect()
    size = defaultdict(int)
    for _, t, _, s, _ in rows:
        size[s] += len(words(t))
    names = sorted(x for x in size if x is not None) + [None]
    weight = dict(zip(names, (5, 2, 1, 5)))
    want, open_ = {}, set(names)
    while open_:
        left = sum(size.values()) * 1.5 - sum(want.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * size[s]}
        if not over:
            want.update(share)
            break
        want.update({s: 2.0 * size[s] for s in over})
        open_ -= over
    taken = defaultdict(int)
    for r in got:
        assert r["taken"] <= 2 * r["size"]
        assert r["target"] == pytest.approx(want[r["source"]])
        taken[r["source"]] += r["taken"]
    assert {s: taken[s] for s in names} == {s: math.floor(want[s] + 0.5) for s in names}
    again = mixing.mix(frame(spark, rows).repartition(3), block=16).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"], r["taken"])
    assert sorted(map(key, again), key=str) == sorted(map(key, got), key=str)
    assert mixing.mix(empty(spark)).count() == 0
    assert {r["taken"] for r in mixing.mix(spark.createDataFrame([(1, None, None, None, None)], DOC)).collect()} == {0}
    full = [(r["first_slot"] is not None, r["n_slots"] > 0) for r in got]
    assert full == [(r["taken"] > 0,) * 2 for r in got]
    names_ = ("_k", "_size", "_taken", "_id", "_h", "_begin", "_mixed_slot", "pass", "slot", "words", "_order")
    from pyspark.sql import functions as F

    clashing = frame(spark, rows).withColumns({x: F.lit("mine") for x in names_})
    mixed = mixing.mixed_rows(clashing, block=16)
    assert mixed.columns == clashing.columns and {r["_k"] + r["_size"] + r["_mixed_slot"] for r in mixed.collect()} == {"mine" * 3}
    assert sum(len(words(r["text"])) for r in mixed.collect()) == sum(r["taken"] for r in got)
    assert mixing.mixed_rows(empty(spark)).count() == 0


def test_mixed_rows_of_repeated_ids(spark):
    """Texts of one id are taken each for itself, and of rows repeated as a whole one stands for all that is taken of them."""
    text = lambda x, n: " ".join(f"{x}{k}" for k in range(n))
    rows = [(1, text("a", 50), None, "s", 1), (1, text("b", 50), None, "s", 1), (1, text("c", 30), None, "s", 1), (None, text("d", 40), None, "s", 1), (2, text("e", 60), None, "s", 1), (2, text("e", 60), None, "s", 1), (3, text("f", 500), None, "t", 1), (None, None, None, "t", 1)]
    docs = spark.createDataFrame(rows, DOC)
    taken, mixed = defaultdict(int), defaultdict(int)
    for r in mixing.mix(docs, block=16).collect():
        taken[r["doc_id"]] += r["taken"]
    for r in mixing.mixed_rows(docs, block=16).collect():
        mixed[r["doc_id"]] += len(words(r["text"]))
    assert {k: v for k, v in taken.items() if v} == dict(mixed)
    assert len({r["text"][0] for r in mixing.mixed_rows(docs, block=16).collect() if r["doc_id"] == 1}) == 3


def slots_by_points(plan, block):
    """The schedule, slot by slot."""
    total, bounds = sum(q for *_, q in plan), np.cumsum([q for *_, q in plan])
    blocks = [-(-size // block) for _, size, _ in plan]
    left = [q // size * n + -(-(q % size) // block) for (_, size, q), n in zip(plan, blocks)]
    slots, rank, out = sum(left), [0] * len(plan), []

    def put(slot, k):
        _, size, q = plan[k]
        p, at = divmod(rank[k], blocks[k])
        out.append((slot, plan[k][0], p, at, min(block, size - at * block, q - p * size - at * block)))
        rank[k] += 1

    for i in range(1, slots + 1):
        x = i * mixing.GOLDEN % 2**64
        k = next(k for k, b in enumerate(bounds) if x * total < int(b) * 2**64)
        if rank[k] < left[k]:
            put(i - 1, k)
    for k in range(len(plan)):
        while rank[k] < left[k]:
            put(slots, k)
            slots += 1
    return out


@pytest.mark.parametrize("chunk", [mixing.CHUNK, 50])
def test_schedule_follows_the_points(spark, monkeypatch, chunk):
    monkeypatch.setattr(mixing, "CHUNK", chunk)
    plan = [(0, 1000, 1500), (1, 400, 300), (2, 50, 100), (4, 7000, 7000)]
    rows = sorted(tuple(r) for r in mixing.schedule(spark, plan, 16).collect())
    assert rows == sorted(slots_by_points(plan, 16))
    words_of = defaultdict(int)
    for _, no, _, _, n in rows:
        words_of[no] += n
    assert words_of == {no: q for no, _, q in plan}


def test_every_prefix_of_the_mix_is_mixed(spark):
    """Rows in the order that mixed_rows gives them hold each source in its share, at any point, but for a few blocks."""
    rows = [(k, " ".join(f"{k}x{j}" for j in range(5 + k % 40)), "en", "abc"[k % 3 if k % 2 else 0], 0) for k in range(900)]
    docs = spark.createDataFrame(rows, DOC)
    quota = defaultdict(float)
    for r in mixing.mix(docs, block=32).collect():
        quota[r["source"]] += r["taken"]
    total, have, n = sum(quota.values()), defaultdict(int), 0
    worst = 0
    for r in mixing.mixed_rows(docs, block=32).collect():
        have[r["source"]] += len(words(r["text"]))
        n += len(words(r["text"]))
        worst = max(worst, *(abs(have[s] - n * q / total) for s, q in quota.items()))
    assert n == total and worst < 6 * 32 < 0.02 * total


def test_packing(spark):
    rows = odd_docs()
    w = word_ids(tokenizer_path())
    got = {(r["doc_id"], r["piece"]): r for r in packing.pack_documents(frame(spark, rows)).collect()}
    used, n = defaultdict(list), 0
    for i, t, *_ in rows:
        ids = [*w.tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            r, part = got[i, k], ids[at : at + 2048]
            assert (r["start"], r["length"], r["ids_crc32"]) == (at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
            used[r["sequence_id"]].append((r["offset"], r["length"]))
            n += 1
    assert n == len(got)
    for parts in used.values():
        end = 0
        for at, length in sorted(parts):
            assert at == end
            end += length
        assert end <= 2048
    assert len(used) == packing.least_bins(dict(zip(*np.unique([r["length"] for r in got.values()], return_counts=True))), 2048)
    assert packing.pack_documents(empty(spark)).count() == 0


def test_bin_completion_is_best():
    def best(items, capacity):
        items, least = sorted(items, reverse=True), [len(items)]

        def go(k, rooms):
            if len(rooms) >= least[0]:
                return
            if k == len(items):
                least[0] = len(rooms)
                return
            for j in {r: j for j, r in enumerate(rooms) if r >= items[k]}.values():
                go(k + 1, [r - items[k] if i == j else r for i, r in enumerate(rooms)])
            go(k + 1, [*rooms, capacity - items[k]])

        go(0, [])
        return least[0]

    rnd, better = random.Random(3), 0
    for _ in range(300):
        items = [rnd.randint(15, 70) for _ in range(rnd.randint(1, 11))]
        counts, report = {s: items.count(s) for s in items}, {}
        plan = packing.bin_completion(counts, 100, report=report)
        packed = sorted(s for bin_, n in plan for s in bin_ * n)
        assert packed == sorted(items) and all(sum(b) <= 100 for b, _ in plan)
        assert sum(n for _, n in plan) == report["bins"] == best(items, 100)
        better += report["bins"] < report["best_fit"]
    assert better


def test_search_beats_best_fit():
    """Triples that fill bins without waste, which best-fit does not find."""
    rnd, better = random.Random(5), 0
    for _ in range(10):
        items = []
        for _ in range(14):
            a, b = rnd.randint(380, 490), rnd.randint(250, 380)
            items += [a, b, 1000 - a - b]
        report = {}
        plan = packing.bin_completion({s: items.count(s) for s in items}, 1000, report=report)
        assert sorted(s for bin_, n in plan for s in bin_ * n) == sorted(items)
        assert report["bound"] <= report["bins"] <= report["best_fit"]
        better += report["bins"] < report["best_fit"]
    assert better >= 5


def test_fillings_are_all_that_no_other_dominates():
    from itertools import combinations

    rnd = random.Random(6)
    for _ in range(60):
        items = sorted(rnd.randint(3, 30) for _ in range(8))
        counts, room = {s: items.count(s) for s in items}, 40
        sizes = sorted(counts)
        ways = {tuple(sorted(c, reverse=True)) for n in range(9) for c in combinations(items, n) if sum(c) <= room}

        def left(way):
            return [s for s in sizes if way.count(s) < counts[s]]

        def dominated(way):
            waste = room - sum(way)
            parts = [0, *way], [a + b for a, b in combinations(way, 2)]
            return any(s <= waste for s in left(way)) or any(p < s <= p + waste for p in parts[0] for s in left(way)) or any(p <= s <= p + waste for p in parts[1] for s in left(way))

        got = list(packing.fillings(sizes, counts, room, room, packing.Effort(10**6)))
        assert sorted(got) == sorted(w for w in ways if not dominated(w))
        assert [room - sum(x) for x in got] == sorted(room - sum(x) for x in got)


def test_fingerprints(spark):
    rows = odd_docs()
    got = sorted(fingerprints.compare_with_edits(frame(spark, rows)).collect(), key=lambda r: r["doc_id"])
    texts = [t or "" for _, t, *_ in rows]
    for k, (r, t) in enumerate(zip(got, texts)):
        q, ahead = len(t) // 4, texts[(k + 1) % len(texts)]
        edited = t[: len(t) - q] + ahead[:q]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r["near_edited"] <= 1 and (r["near_edited"] == 1) >= (edited == t)
        assert (r["fingerprint"] == got[(k + 1) % len(texts)]["fingerprint"]) == (t == ahead)
    assert len({r["fingerprint"] for r in got}) == len(set(texts))
    assert fingerprints.compare_with_edits(empty(spark)).count() == 0
    twice = spark.createDataFrame([(1, "same text", None, None, 1)] * 2 + [(None, "other", None, None, 1)], DOC)
    assert fingerprints.compare_with_edits(twice).count() == 3
    from pyspark.sql import functions as F

    pair = spark.createDataFrame([("\n".join(f"line {k}" for k in range(30)), "\n".join(f"line {k if k != 17 else 'x'}" for k in range(30)))], "a string, b string")
    pair = fingerprints.with_fingerprint(fingerprints.with_fingerprint(pair, "a", "fa", "la"), "b", "fb", "lb")
    assert pair.select(fingerprints.differing_sections(F.col("fa"), F.col("fb"))).collect()[0][0] == [2]


def shingles(t):
    w = words(t.lower() if False else "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "")))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def groups(n, links):
    at = list(range(n))

    def top(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        at[max(a, b)] = min(a, b)
    return [top(k) for k in range(n)]


def near_by_brute_force(rows):
    """Of each row: size of its set, its component's least doc_id that isn't null, and its component's first row."""
    sets = [shingles(t) for _, t, *_ in rows]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    top, ids = groups(len(rows), links), defaultdict(list)
    for k, (i, *_) in enumerate(rows):
        ids[top[k]].append(i)
    least = {t: min((i for i in x if i is not None), default=None) for t, x in ids.items()}
    return [(len(s), least[top[k]], top[k]) for k, s in enumerate(sets)], len(links)


def by_none(x):
    return tuple((v is None, v or 0) for v in x)


def test_shingle_join(spark):
    rows = odd_docs(7, 90)
    want, links = near_by_brute_force(rows)
    got = {r["doc_id"]: r for r in shingle_join.near_duplicates(frame(spark, rows)).collect()}
    assert links > 20
    for k, (size, least, _) in enumerate(want):
        assert (got[k]["n_shingles"], got[k]["component_id"]) == (size, least)
    kept = shingle_join.keep_one(frame(spark, rows)).collect()
    assert sorted(r["doc_id"] for r in kept) == [k for k in range(len(rows)) if want[k][2] == k]
    assert shingle_join.near_duplicates(empty(spark)).count() == 0
    assert shingle_join.keep_one(empty(spark)).count() == 0


def test_shingle_join_of_repeated_and_null_ids(spark):
    from pyspark.sql import functions as F

    rnd = random.Random(17)
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "vuy")
    rows = [(1, a), (5, a + " extra"), (5, b), (5, b), (7, b + " more"), (None, a + " and"), (None, c), (None, c + " too"), (None, c), (9, None), (9, ""), (None, None), (11, "x y"), (11, "x z"), (12, "X y")]
    rows += [(rnd.choice([20, 21, 22, None]), t) for _, t, *_ in odd_docs(18, 25)]
    rows = [(i, t, None, None, 1) for i, t in rows]
    want, _ = near_by_brute_force(rows)
    clashing = spark.createDataFrame(rows, DOC).withColumns({x: F.lit("mine") for x in ("_gone", "_k", "_h", "_row", "h", "k1", "component", "_id")})
    got = shingle_join.near_duplicates(clashing).collect()
    # rows without words are components of their own
    mine = [(r[0], n, least if n else r[0]) for r, (n, least, _) in zip(rows, want)]
    assert sorted(map(by_none, mine)) == sorted(by_none((r["doc_id"], r["n_shingles"], r["component_id"])) for r in got)
    kept = shingle_join.keep_one(clashing)
    assert kept.columns == clashing.columns and {r["_k"] for r in kept.collect()} == {"mine"}
    kept = [(r["doc_id"], r["text"]) for r in kept.collect()]
    parts = defaultdict(list)
    for (i, t, *_), (n, least, top) in zip(rows, want):
        parts[top if n else (i, t, len(parts))].append((i, t))
    assert len(kept) == len(parts)
    for part in parts.values():
        first = min(x is None for x, _ in part), min((x for x, _ in part if x is not None), default=None)
        assert sum(x in part and (x[0] is None, x[0]) == first for x in set(kept)) == 1 or not shingles(part[0][1])


def test_shingle_join_of_large_sets(spark):
    """Sets above what parity sketches tell apart: near copies and others that share much, at both sides of the threshold."""
    rnd = random.Random(19)
    rows = []
    for k in range(6):
        base = [f"{k}w{rnd.randrange(10**6)}" for _ in range(2500)]
        for cut in (0, 150, 300, 340, 362, 380, 600):
            rows.append(base[cut:] + [f"{k}n{cut}x{j}" for j in range(cut)])
    rows = [(i, " ".join(t), None, None, 1) for i, t in enumerate(rows)]
    want, links = near_by_brute_force(rows)
    got = shingle_join.near_duplicates(spark.createDataFrame(rows, DOC)).collect()
    assert links > 30 and len({x for _, x, _ in want}) > 6
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == [(i, n, least) for i, (n, least, _) in enumerate(want)]


def test_parity_bounds_the_difference():
    rng = np.random.default_rng(4)
    for _ in range(200):
        n, d = int(rng.integers(3, 300)), int(rng.integers(0, 40))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[d // 2 :], rng.integers(0, 2**63, d - d // 2).astype(np.uint64)]))
        differ = len(np.setxor1d(a, b))
        bits = np.unpackbits((shingle_join.parity(a) ^ shingle_join.parity(b)).view(np.uint8)).sum()
        assert bits <= differ
        both = len(np.intersect1d(a, b))
        if 100 * both >= 75 * (len(a) + len(b) - both) and differ:
            assert len(np.intersect1d(shingle_join.sketch_words(a), shingle_join.sketch_words(b))) >= 1


def test_components(spark):
    rnd = random.Random(5)
    edges = [(k, k + 1) for k in range(60)] + [(100, 100 + k) for k in range(1, 40)] + [(rnd.randrange(200, 260), rnd.randrange(200, 260)) for _ in range(40)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = groups(300, edges)
    nodes = sorted({x for e in edges if e[0] != e[1] for x in e})
    assert sorted(got) == nodes
    assert all((got[a] == got[b]) == (want[a] == want[b]) for a in nodes for b in nodes)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_vectors(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(30, 16))
    x = np.concatenate([base, base[:10] + 0.1 * rng.normal(size=(10, 16)), base[:1] + 0.2 * rng.normal(size=(40, 16)), base[:3] * 2])
    rows = [(k, v.tolist(), 0) for k, v in enumerate(x)] + [(500, None, 0), (501, [0.0] * 16, 0), (502, [1.0] * 15 + [None], 0), (503, [float("nan")] * 16, 0), (504, [1.0] * 15 + [float("inf")], 0), (505, [], 0), (506, [1.0, 0.0], 0)]
    u = x / np.linalg.norm(x, axis=1)[:, None]
    sims = u @ u.T
    links = [(a, b) for a in range(len(x)) for b in range(a) if sims[a, b] >= 0.9]
    want = groups(len(x), links)
    got = {r["vec_id"]: r for r in hnsw.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    for k in range(len(x)):
        assert (got[k]["n_links"], got[k]["component_id"], got[k]["kept"]) == (int((sims[k] >= 0.9).sum()) - 1, want[k], want[k] == k)
    assert all((got[k]["n_links"], got[k]["component_id"], got[k]["kept"]) == (0, k, True) for k in range(500, 507))
    assert hnsw.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def clustered(rng, sizes, dim, spread, loose=0):
    x = [c + spread * rng.normal(size=(n, dim)) for n in sizes for c in rng.normal(size=(1, dim))] + [rng.normal(size=(loose, dim))]
    x = np.concatenate(x)
    return x / np.linalg.norm(x, axis=1)[:, None]


@pytest.mark.parametrize(("sizes", "loose"), [([150] * 40, 2000), ([800] * 3, 1500), ([12] * 40, 2500)])
def test_graph_finds_all_links(sizes, loose):
    """Clusters wider than a beam, their members linked in part."""
    import time

    rng = np.random.default_rng(7)
    x = clustered(rng, sizes, 64, 0.3, loose)
    graph, order = hnsw.Graph.build(x, rng.random(len(x)) * 0.999 + 1e-3)
    x = x[order].astype(np.float32)
    begin, found = time.time(), set()
    for q, c in graph.within(x[:512], 0.9 - 1e-5):
        found |= set(zip(q.tolist(), c.tolist()))
    assert time.time() - begin < 20
    want = set(zip(*map(np.ndarray.tolist, np.nonzero(x[:512].astype(float) @ x.T.astype(float) >= 0.9))))
    assert len(want - found) <= 1e-4 * len(want)


def test_audit_widens_beams():
    """A graph without most of its edges fails its audits, and products find what beams can't."""
    rng = np.random.default_rng(8)
    x = clustered(rng, [20] * 60, 32, 0.25)
    graph, order = hnsw.Graph.build(x, rng.random(len(x)) * 0.999 + 1e-3)
    graph.levels[0][:, 2:] = -1
    x = x[order].astype(np.float32)
    beam = sum(((s >= 0.9) & (i >= 0)).sum() for i, s in [graph.search(x[:200], 32)])
    found, want = sum(len(q) for q, _ in graph.within(x[:200], 0.9)), (x[:200] @ x.T >= 0.9).sum()
    assert beam < 0.7 * want and abs(found - want) <= 0.002 * want


def test_vectors_in_large_clusters(spark):
    rng = np.random.default_rng(9)
    x = clustered(rng, [150] * 6 + [800], 32, 0.28, 500)
    x = np.concatenate([x, x[:30]])
    sims = x @ x.T >= 0.9
    np.fill_diagonal(sims, False)
    want = groups(len(x), list(zip(*map(np.ndarray.tolist, np.nonzero(np.tril(sims))))))
    rows = [(k, v.tolist(), 0) for k, v in enumerate(x)]
    got = {r["vec_id"]: r for r in hnsw.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert [(got[k]["n_links"], got[k]["component_id"], got[k]["kept"]) for k in range(len(x))] == [(int(sims[k].sum()), want[k], want[k] == k) for k in range(len(x))]


def test_token_files(spark):
    rows = odd_docs()
    w = word_ids(tokenizer_path())
    path = binary.write_ids(frame(spark, rows))
    got = sorted(binary.read_ids(spark, path).collect(), key=lambda r: r["doc_id"])
    at = 0
    for r, (i, t, *_) in zip(got, rows):
        want = [*w.tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        assert (r["doc_id"], r["start"], r["n_tokens"]) == (i, at, len(want)) and np.frombuffer(r["ids"], "<u4").tolist() == want
        at += len(want)
    assert binary.read_ids(spark, binary.write_ids(empty(spark)), digest=True).count() == 0
    twice = spark.createDataFrame([(1, "a b", None, None, 1)] * 2 + [(None, None, None, None, None)], DOC)
    assert sorted(r["start"] for r in binary.read_ids(spark, binary.write_ids(twice)).collect()) == [0, 3, 6]


def test_token_files_stand_alone(spark, tmp_path):
    """A process that has the path alone decodes the files."""
    import json
    import subprocess
    import sys

    from tests.conftest import ROOT

    rows = odd_docs(21, 20)
    path = binary.write_ids(frame(spark, rows), f"file://{tmp_path}/ids", end=7)
    code = f"""
import sys, json
sys.path.insert(0, {ROOT!r})
from loculus.session import local_session
from loculus.llm.binary import read_ids
import numpy as np
got = read_ids(local_session("fresh", cpus=1, shuffle_partitions=2), {path!r}).collect()
print("GOT" + json.dumps(sorted((r["doc_id"], r["start"], np.frombuffer(r["ids"], "<u4").tolist()) for r in got)))
"""
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300).stdout
    got, w, at = json.loads(said[said.index("GOT") + 3 :].splitlines()[0]), word_ids(tokenizer_path()), 0
    assert len(got) == len(rows)
    for (doc, start, ids), (i, t, *_) in zip(got, rows):
        want = [*w.tokenizer.encode(t or "", add_special_tokens=False).ids, 7]
        assert (doc, start, ids) == (i, at, want)
        at += len(want)


def test_tokenizer_of_other_rules():
    import pyarrow as pa

    w = word_ids(tokenizer_path("byte_bpe_50k.json"))
    texts = [r[1] for r in odd_docs(22, 20)] + ["two  spaces, Ångström", "<|endoftext|>"]
    assert not w.by_words and word_ids(tokenizer_path()).by_words
    flat, at = w.encode_many(pa.array(texts))
    for k, t in enumerate(texts):
        assert flat[at[k] : at[k + 1]].tolist() == w.tokenizer.encode(t or "", add_special_tokens=False).ids


def test_codes():
    rng = np.random.default_rng(8)
    for n in (0, 1, 3, 4, 5, 1000):
        codes = (rng.integers(0, 2**32, n) >> rng.integers(0, 32, n)).astype(np.uint32)
        control, data = binary.encode_codes(codes)
        assert (binary.decode_codes(control, data, n) == codes).all() and len(control) == -(-n // 4)


def labelled_docs(n: int = 600):
    rnd = random.Random(9)
    vocabulary = [f"w{k}" for k in range(300)]
    docs, labels = [], []
    for k in range(n):
        own, toxic, bad = [rnd.choice(vocabulary) for _ in range(rnd.randint(20, 80))], k % 9 == 0, k % 7 == 0
        if toxic:
            for _ in range(4):
                own.insert(rnd.randrange(len(own)), rnd.choice(["grobnik", "Vilefang", "scumly,"]))
        text = " ".join(own) if not bad else "!! ".join(x.upper() for x in own[:8] * 6)
        docs.append((k, text, "en", "a", len(text)))
        labels.append((k, int(not bad), int(toxic)))
    return docs + [(n, None, None, None, None), (n + 1, "", None, None, 0), (None, "no id", None, None, 5)], labels + [(n + 5, 1, 1), (None, 1, 1)]


def test_toxicity_and_quality(spark):
    docs, labels = labelled_docs()
    d, lab = frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    kind = {i: (q, t) for i, q, t in labels}
    for scores, which, right in ((toxicity.toxic_scores(d, lab), 1, 0.5), (quality.quality_scores(d, lab), 0, 0.3)):
        rows = scores.collect()
        assert len(rows) == len(docs) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= right) for r in rows)
        out = [r for r in rows if r["held_out"] and r["doc_id"] in kind]
        assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
        assert np.mean([r["predicted"] == kind[r["doc_id"]][which] for r in out]) > 0.95
    assert toxicity.toxic_scores(d, lab.limit(0)).filter("predicted = 1").count() == 0
    assert quality.quality_scores(d, lab.limit(0)).count() == len(docs)
    assert toxicity.toxic_scores(empty(spark), lab).count() == quality.quality_scores(empty(spark), lab).count() == 0
    assert {r["doc_id"] for r in toxicity.keep_clean(d, lab).collect()} == {r["doc_id"] for r in toxicity.toxic_scores(d, lab).collect() if not r["predicted"]}
    assert quality.keep_good(d, lab).columns == d.columns


def test_risk_and_its_gradient():
    """The risk by its formula, its gradient by differences, on both sides of zero."""
    rng = np.random.default_rng(14)
    pos, unl = ([np.unique(rng.integers(0, 30, rng.integers(0, 9))) for _ in range(n)] for n in (12, 40))
    for scale in (0.1, 4.0):
        w, b, prior = scale * rng.normal(size=30), 0.3 * scale, 0.4
        s = lambda rows, w, b: np.array([b + w[r].sum() for r in rows])
        loss = lambda x: np.log1p(np.exp(-x))

        def parts(w, b):
            return prior * loss(s(pos, w, b)).mean(), loss(-s(unl, w, b)).mean() - prior * loss(-s(pos, w, b)).mean()

        first, second, gw, gb = toxicity.pu_risk(w, b, pos, unl, prior)
        assert (first, second) == pytest.approx(parts(w, b))
        what = (lambda w, b: sum(parts(w, b))) if second >= 0 else (lambda w, b: -parts(w, b)[1])
        for k in range(30):
            d = np.eye(30)[k] * 1e-5
            assert gw[k] == pytest.approx((what(w + d, b) - what(w - d, b)) / 2e-5, abs=1e-6)
        assert gb == pytest.approx((what(w, b + 1e-5) - what(w, b - 1e-5)) / 2e-5, abs=1e-6)
    # confirmed rows alone score high: the second part is below zero
    w = np.zeros(30)
    w[7] = 12.0
    low = toxicity.pu_risk(w, -6.0, [np.array([7])] * 3, [np.zeros(0, int)] * 5, 0.5)
    assert low[1] < 0 and low[2][7] == pytest.approx(0.5, abs=0.01)


def test_all_unlabelled_rows_are_learnt_from(spark, monkeypatch):
    """Blocks hold all rows that may be learnt from, each once; scores are the mean model's, row by row."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(toxicity, "BLOCK", 40)
    docs, labels = labelled_docs(400)
    d, lab = frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    confirmed = [i for i, _, t in labels if t and i is not None and i < 400 and zlib.crc32(str(i).encode()) % 5]
    ids = spark.createDataFrame([(i,) for i in confirmed], "doc_id long")
    features = toxicity.seen_in(d, ids)
    text, w = {i: t for i, t, *_ in docs}, toxicity.WordFeatures()
    count = defaultdict(int)
    for i in confirmed:
        for f in w.of(text[i]).tolist():
            count[f] += 1
    assert features.tolist() == sorted(f for f, n in count.items() if n >= 3)
    rows = toxicity.described(d, ids, features)
    learn = [i for i, *_ in docs if i is not None and zlib.crc32(str(i).encode()) % 5]
    assert sorted(r["doc_id"] for r in rows.filter("learn").collect()) == learn and sorted(r["doc_id"] for r in rows.filter("pos").collect()) == confirmed
    kind, size, n = toxicity.packed(len(features)), len(features), len(learn)
    pos = [np.frombuffer(r["f"], kind) for r in rows.filter("pos").orderBy("doc_id").collect()]
    own = rows.filter("learn").select("doc_id", "h", "f")
    every = np.zeros(size)
    for r in own.collect():
        every[np.frombuffer(r["f"], kind)] += 1
    got = toxicity.counted(own, size)
    assert (got[0] == every).all() and got[1] == n
    used = np.flatnonzero(toxicity.telling(np.bincount(np.concatenate(pos), minlength=size), len(pos), every, n))
    assert 0 < len(used) < size
    w, b, many = toxicity.block_models(own, n, pos, 0.1, used, size)
    assert many == round(n / 40)
    place = {f: k for k, f in enumerate(used.tolist())}
    mine = lambda x: np.array([place[f] for f in x.tolist() if f in place], int)
    blocks = defaultdict(list)
    for r in own.withColumn("b", F.pmod(F.xxhash64("doc_id", "h", F.lit(11)), F.lit(many))).orderBy("b", "doc_id", "h").collect():
        blocks[r["b"]].append(mine(np.frombuffer(r["f"], kind)))
    assert sum(map(len, blocks.values())) == n
    want = [toxicity.nnpu([mine(x) for x in pos], x, 0.1, len(used)) for x in blocks.values()]
    assert w == pytest.approx(sum(x[0] for x in want), abs=1e-6) and b == pytest.approx(sum(x[1] for x in want))


def test_quality_scores_by_a_plain_loop(spark):
    docs, labels = labelled_docs()
    d, lab = frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model, got = quality.fit(d, lab), {r["doc_id"]: r["score"] for r in quality.quality_scores(d, lab).collect()}
    assert model.pairs and len(model.tables) == len(quality.NAMES)

    def bin_of(cuts, v):
        return sum(c <= v for c in cuts.tolist())

    for i, t, *_ in docs[::7]:
        x = quality.describe(t)
        s = model.bias + sum(t[bin_of(c, v)] for t, c, v in zip(model.tables, model.cuts, x))
        s += sum(t[bin_of(ci, x[i]), bin_of(cj, x[j])] for i, j, ci, cj, t in model.pairs)
        assert got[i] == pytest.approx(1 / (1 + math.exp(-s)))


def test_stages_on_odd_tables(spark):
    """Nulls, empty texts, repeated rows, clashing names, and no rows, through each stage."""
    from pyspark.sql import functions as F

    docs, labels = labelled_docs(120)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame(docs + docs[:5] + [(3, "another text of one id", "en", "b", 5), (None, None, None, None, None)], DOC).withColumns({c: F.lit("mine") for c in ("_id", "_h", "_pos", "f", "h", "learn", "row", "_clean_row", "score", "_gone", "key")})
    for stage in (toxicity.keep_clean, quality.keep_good):
        out = stage(odd, lab)
        assert out.columns == odd.columns and {r["key"] for r in out.collect()} == {"mine"}
        assert stage(odd.limit(0), lab).count() == 0
    want = sorted(((r["doc_id"] is None, r["doc_id"] or 0) for r in toxicity.toxic_scores(odd, lab).filter("predicted = 0").collect()))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in toxicity.keep_clean(odd, lab).collect()) == want


def test_interactions():
    rng = np.random.default_rng(10)
    x = rng.random((4000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit_additive(x, y)
    assert {(0, 1), (1, 0)} & {(i, j) for i, j, *_ in model.pairs}
    fresh = rng.random((1000, 4))
    assert ((model.score(fresh) > 0.5) == ((fresh[:, 0] > 0.5) ^ (fresh[:, 1] > 0.5))).mean() > 0.9


def test_lm_scoring(spark, monkeypatch):
    """Against plain counts, every word and pair by itself, and probabilities that sum to 1; then the same in several chunks and buckets."""
    rare = [(1000 + k, " ".join(f"z{k}x{j}" for j in range(3500)), "en", "a", 0) for k in range(10)]
    rows = odd_docs(12, 30) + rare + [(1000, "z0x0 z0x1", "en", "a", 0), (None, "z0x0 z0x1", "en", "a", 0)]
    good = {i for i, *_ in rows if i is not None and i % 2 == 0}
    one, two, coded = [defaultdict(int), defaultdict(int)], [defaultdict(int), defaultdict(int)], []
    for i, t, *_ in rows:
        ids = [w.decode() for w in words("".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "")))] + [""]
        coded.append((i, list(zip(["", *ids[:-1]], ids))))
        for a, b in coded[-1][1]:
            one[0 if i in good else 1][b] += 1
            two[0 if i in good else 1][a, b] += 1
    vocabulary = set(one[0]) | set(one[1])
    total = [sum(one[k].values()) for k in (0, 1)]
    p = lambda k, a, b: lm_scoring.probability(two[k].get((a, b), 0), one[k].get(a, 0), one[k].get(b, 0), total[k], len(vocabulary))
    for k in (0, 1):
        for a in ("", "the", "w7", "z0x0", "z1x1", "no such word"):
            assert sum(p(k, a, b) for b in vocabulary) == pytest.approx(1)
    want = []
    for i, pairs in coded:
        loss = [np.mean([-math.log(p(k, a, b)) for a, b in pairs]) for k in (0, 1)]
        want.append((-1 if i is None else i, len(pairs), *loss, loss[0] - loss[1]))
    target = spark.createDataFrame([(i,) for i in good] + [(None,)], "doc_id long")
    for chunk_words in (lm_scoring.CHUNK_WORDS, 700):
        monkeypatch.setattr(lm_scoring, "CHUNK_WORDS", chunk_words)
        monkeypatch.setattr(lm_scoring, "BUCKET_ITEMS", 10 * chunk_words)
        got = lm_scoring.cross_entropy_difference(frame(spark, rows), target).collect()
        have = [(-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["loss_target"], r["loss_background"], r["score"]) for r in got]
        assert len(have) == len(want)
        for x, y in zip(sorted(have), sorted(want)):
            assert x == pytest.approx(y)
    assert lm_scoring.cross_entropy_difference(empty(spark), target).count() == 0
    assert lm_scoring.cross_entropy_difference(frame(spark, rows), target.limit(0)).count() == len(rows)


def test_packed_integers():
    rng = np.random.default_rng(13)
    for n in (0, 1, 2, 1000):
        x = (rng.integers(0, 2**63, n) >> rng.integers(0, 63, n)).astype(np.int64)
        assert (lm_scoring.unplanes(lm_scoring.planes(x), n) == x).all()
        h = np.sort(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
        assert (lm_scoring.sorted_from(lm_scoring.sorted_bytes(h), n) == h).all()


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.write_table(stage(spark, docs, SMALL), name)
        assert out.columns == docs.columns
        seen.append((docs.count(), out.count()))
        docs = out
    assert all(a >= b > 0 for a, b in seen[:3])
    packed = corpus_pipeline.run(spark, SMALL)
    assert packed.count() >= seen[-1][1]


def test_pipeline_by_brute_force(spark):
    """Each stage's rows from scores, all pairs of shingle sets, what the mix takes of each row, and the tokenizer's own ids."""
    import corpus_pipeline

    docs, labels, seen = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = seen[name] = corpus_pipeline.write_table(stage(spark, docs, SMALL), f"brute-{name}")
        ids = sorted(r["doc_id"] for r in docs.select("doc_id").collect())
        if name == "toxicity":
            assert ids == sorted(r["doc_id"] for r in toxicity.toxic_scores(before, labels).collect() if r["score"] < 0.5)
        if name == "quality":
            assert ids == sorted(r["doc_id"] for r in quality.quality_scores(before, labels).collect() if r["score"] >= 0.3)
        if name == "near_duplicates":
            sets, up = {}, {}
            for r in before.collect():
                w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in (r["text"] or "")))
                sets[r["doc_id"]], up[r["doc_id"]] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set(), r["doc_id"]
            order = sorted(sets)

            def top(i):
                while up[i] != i:
                    i = up[i]
                return i

            for k, a in enumerate(order):
                for b in order[k + 1 :]:
                    common = len(sets[a] & sets[b])
                    if common and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                        low, high = sorted((top(a), top(b)))
                        up[high] = low
            assert ids == [i for i in order if top(i) == i]
    text = {r["doc_id"]: words(r["text"]) for r in seen["near_duplicates"].collect()}
    want = []
    for r in mixing.mix(seen["near_duplicates"]).collect():
        own = text[r["doc_id"]]
        whole, rest = divmod(r["taken"], len(own)) if own else (0, 0)
        want += [(r["doc_id"], tuple(own))] * whole + ([(r["doc_id"], tuple(own[:rest]))] if rest else [])
    rows = docs.collect()
    assert sorted(want) == sorted((r["doc_id"], tuple(words(r["text"]))) for r in rows)
    w, pieces = word_ids(tokenizer_path()), []
    for r in rows:
        ids = [*w.tokenizer.encode(r["text"], add_special_tokens=False).ids, 0]
        pieces += [(r["doc_id"], at, len(ids[at : at + 2048]), zlib.crc32(np.array(ids[at : at + 2048], "<u4").tobytes())) for at in range(0, len(ids), 2048)]
    assert sorted(pieces) == sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, SMALL).collect())
