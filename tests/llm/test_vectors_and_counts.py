"""Vector codes, hard negatives and token counts against brute force, with nulls, ties, repeated rows and clashing columns."""

from __future__ import annotations

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from loculus.llm import hard_negatives, token_counts, vector_codes
from loculus.llm.tokens import tokenizer_path
from tests.conftest import SMALL
from tests.llm.test_llm import empty, frame, odd_docs

VEC = "vec_id long, embedding array<float>, label int"


def odd_vectors(seed: int = 1, n: int = 300, dim: int = 8, spread: float = 1.0):
    """Vectors on a coarse grid, so that distances and scores tie; some unusable; repeated rows and ids."""
    rnd = random.Random(seed)
    rows = [(k, [rnd.randint(-4, 4) * spread / 4 + rnd.choice([0, 0, 0.001]) for _ in range(dim)], rnd.choice([0, 1, 1, 1, None])) for k in range(n)]
    bad = [None, [], [float("nan")] * dim, [float("inf")] + [0.0] * (dim - 1), [None] + [0.0] * (dim - 1)]
    rows += [(10_000 + k, v, 1) for k, v in enumerate(bad)]
    rows += [(None, [0.5] * dim, 1), rows[7], rows[7], (8, [0.25] * dim, 0)]
    rnd.shuffle(rows)
    return rows


def vector_frame(spark, rows):
    return spark.createDataFrame(rows, VEC).withColumns({c: F.lit("x") for c in ("_v", "_id", "_label", "error", "code", "_key", "number", "score", "id", "v", "anchor", "rank", "c0")}).repartition(5)


def whole(v, scale=256):
    return [math.floor(np.float32(x).astype(float) * scale) for x in v]


def usable(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v)


def codes_by_loops(rows, parts, entries, rounds):
    kept = sorted(((i, whole(v), label) for i, v, label in rows if usable(v)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(parts)]
    books = [[cut(v)[p] for _, v, _ in kept[:entries]] for p in range(parts)]
    near = lambda book, q: min((sum((a - b) ** 2 for a, b in zip(q, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for _, v, _ in kept:
                own[near(books[p], cut(v)[p])[1]].append(cut(v)[p])
            for k, vs in own.items():
                books[p][k] = [sum(x) // len(vs) for x in zip(*vs)]
    out, by_label = [], defaultdict(int)
    for i, v, label in kept:
        found = [near(books[p], cut(v)[p]) for p in range(parts)]
        error = sum(d for d, _ in found)
        by_label[label] += error
        out.append((i, "".join(f"{k:02x}" for _, k in found), error, label))
    sha = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return sorted((str(i), c, e, by_label[label], sha) for i, c, e, label in out)


@pytest.mark.parametrize("n,dim,parts,entries", [(300, 8, 4, 16), (40, 8, 2, 64), (200, 6, 6, 5)])
def test_vector_codes(spark, n, dim, parts, entries):
    rows = odd_vectors(n, n, dim)
    got = vector_codes.vector_codes(vector_frame(spark, rows), parts=parts, entries=entries)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == codes_by_loops(rows, parts, entries, 2)


def test_vector_codes_of_few(spark):
    assert vector_codes.vector_codes(spark.createDataFrame([], VEC)).count() == 0
    assert vector_codes.vector_codes(spark.createDataFrame([(1, None, 1), (2, [], 1)], VEC)).count() == 0
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.vector_codes(spark.createDataFrame([(1, [0.5] * 9, 1)], VEC), parts=4)


def test_cells_refine_few_and_miss_none():
    rng = np.random.default_rng(5)
    for width, spread in ((4, 90), (4, 3), (1, 40), (7, 4000)):
        entries = rng.integers(-spread, spread + 1, (64, width))
        cells, q = vector_codes.Cells(entries), rng.integers(-2 * spread, 2 * spread, (500, width))
        entry, distance = cells.nearest(q)
        away = ((q[:, None] - entries) ** 2).sum(2)
        assert (entry == away.argmin(1)).all() and (distance == away.min(1)).all()
        if spread >= 40:
            assert cells.refined < 500 * 64 / 4
    books = np.stack([entries, entries + 1])
    codes, distance = vector_codes.assign(books, np.concatenate([q, q], 1))
    assert (((vector_codes.decode(codes, books) - np.concatenate([q, q], 1)) ** 2).sum(1) == distance.sum(1)).all()


def negatives_by_loops(rows, is_anchor, most=5, take=5):
    kept = [(i, whole(v), label) for i, v, label in rows if usable(v) and i is not None and label is not None]
    out = []
    for i, v, label in kept:
        if not is_anchor(i):
            continue
        scores = sorted((-sum(a * b for a, b in zip(v, w)), j, other) for j, w, other in kept if j != i and len(w) == len(v))
        for s, j, _ in [x for x in scores if x[2] == label][:most]:
            fits = [(t, k) for t, k, other in scores if other != label and 80 * -s <= 100 * -t <= 100 * -s][:take]
            out += [(i, j, n + 1, k, -s, -t) for n, (t, k) in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize("spread,pass_bytes", [(1.0, 32 << 20), (1.0, 600), (30000.0, 32 << 20)])
def test_hard_negatives(spark, spread, pass_bytes):
    rows = odd_vectors(3, 260, 6, spread) + [(40, [1.0, 0.5], 1), (41, [1.0, 0.25], 1), (42, [1.0, 0.125], 0), (30, [0.5] * 6, 1), (30, [0.5] * 6, 1)]
    got = hard_negatives.hard_negatives(vector_frame(spark, rows), F.col("vec_id") % 10 == 0, pass_bytes=pass_bytes)
    want = negatives_by_loops(rows, lambda i: i % 10 == 0)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 100
    assert dict(got.dtypes)["rank"] == "int"


def test_hard_negatives_of_few(spark):
    few = lambda rows: hard_negatives.hard_negatives(spark.createDataFrame(rows, VEC), F.col("vec_id") % 10 == 0)
    assert few([]).count() == 0 and few([(3, [1.0], 1)]).count() == 0 and few([(10, [1.0], 1)]).count() == 0
    assert [tuple(r) for r in few([(10, [1.0], 1), (11, [1.0], 1), (12, [0.8], 0), (13, [0.79], 0)]).collect()] == []
    assert [tuple(r) for r in few([(10, [1.0], 1), (11, [1.0], 1), (12, [0.9], 0), (13, [0.9], 0), (14, [2.0], 0)]).collect()] == [(10, 11, k, 11 + k, 65536, 58880) for k in (1, 2)]


def test_many_ties_stay_whole(spark):
    """Thousands of copies of one vector: the smallest ids win, across tasks."""
    rows = [(k, [0.5, 0.5], k % 2) for k in range(6000, 0, -1)]
    got = hard_negatives.hard_negatives(spark.createDataFrame(rows, VEC).repartition(7), F.col("vec_id") == 3000).collect()
    assert sorted((r["positive_id"], r["rank"], r["negative_id"]) for r in got) == [(p, n + 1, 2 * n + 1) for p in (2, 4, 6, 8, 10) for n in range(5)]


def library_counts(texts):
    model = token_counts.piece_counts(tokenizer_path(token_counts.MODEL)).model
    return [len(x) for x in model.encode([t or "" for t in texts], num_threads=1)]


def test_token_counts(spark):
    rows = odd_docs() + [(900, "a" * 100_000, "en", None, 1), (901, "日本語。" * 5000, "ja", None, 1), (None, "no id", "en", None, 1), (3, "twice", "en", None, 1)]
    got = token_counts.token_counts(frame(spark, rows).withColumn("n_tokens", F.lit(1)), limit=100)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = [(i, len((t or "").encode()), n, n > 100) for (i, t, *_), n in zip(rows, library_counts([r[1] for r in rows]))]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert token_counts.token_counts(empty(spark)).count() == 0


def test_token_counts_of_the_given_texts():
    texts = pq.read_table(f"{SMALL}/documents.parquet")["text"].combine_chunks()
    counts = token_counts.PieceCounts(tokenizer_path(token_counts.MODEL), kept=50)
    assert counts.by_chunks
    assert counts.count_many(texts).tolist() == library_counts(texts.to_pylist())
    plain = [counts.count(counts.model.normalize(t or "")) for t in texts.to_pylist()[:40]]
    assert plain == library_counts(texts.to_pylist()[:40])


def test_token_counts_of_odd_texts():
    rnd, counts = random.Random(7), token_counts.piece_counts(tokenizer_path(token_counts.MODEL))
    pieces = [p.replace("▁", " ") for p in counts.rank]
    odd = [" ", "  ", "\n", "\r", "\t", "\x00", "▁", "é", "日", "😀", "<s>", "</s>", "<unk>", "<0x41>", "\r\n", "\x85", "\xa0", "a", "👨‍👩‍👧", "▁▁", "﻿"]
    texts = ["".join(rnd.choice(odd if rnd.random() < 0.5 else pieces) for _ in range(rnd.choice([0, 1, 2, 5, 20]))) for _ in range(3000)]
    for part in (pa.array(texts), pa.array(["pad"] * 3 + texts, pa.large_string()).slice(3)):
        assert counts.count_many(part).tolist() == library_counts(texts)
