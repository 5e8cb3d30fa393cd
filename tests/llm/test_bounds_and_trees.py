"""Fitted samples are bounded in rows whatever ids repeat; fingerprints against a tree in plain Python."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from loculus.llm import fingerprints, quality, toxicity
from tests.llm.test_llm import DOC, frame, odd_docs

LABEL = "doc_id long, quality int, toxic int"


def repeated(spark, n: int = 3000):
    """One labelled id stands on n rows of different texts."""
    rows = [(7, f"the same id again {k} with words and more words {k % 17}", "en", "a", 1) for k in range(n)] + [(k, f"one text of its own {k}", "en", "a", 1) for k in range(100, 160)]
    return spark.createDataFrame(rows, DOC), spark.createDataFrame([(7, 1, 1)] + [(k, k % 2, int(k % 3 == 0)) for k in range(100, 160)], LABEL)


def test_quality_is_fitted_on_a_bounded_number_of_rows(spark, monkeypatch):
    docs, labels = repeated(spark)
    seen = []
    monkeypatch.setattr(quality, "fit_additive", lambda x, y, *a, f=quality.fit_additive, **b: seen.append(len(x)) or f(x, y, *a, **b))
    quality.fit(docs, labels, 15)
    quality.fit(docs.repartition(7), labels, 40)
    assert len(seen) == 2 and seen[0] <= 15 and seen[1] <= 40


def test_the_sample_is_the_same_in_every_run(spark, monkeypatch):
    docs, labels = repeated(spark)
    seen = []
    monkeypatch.setattr(quality, "fit_additive", lambda x, y, *a, f=quality.fit_additive, **b: seen.append(np.c_[x, y]) or f(x, y, *a, **b))
    for parts in (1, 6):
        quality.fit(docs.repartition(parts), labels, 30)
    assert np.array_equal(*seen)


def test_confirmed_rows_are_bounded(spark, monkeypatch):
    rows = spark.range(500).select((F.col("id") % 3).alias("doc_id"), F.col("id").alias("h"), F.lit(True).alias("pos"), F.lit(bytearray(b"\1\0\2\0")).alias("f"))
    assert len(toxicity.confirmed_rows(rows.unionByName(rows), 40, "<u2")) == 40
    got = toxicity.confirmed_rows(rows, 1000, "<u2")
    assert len(got) == 500 and got[0].tolist() == [1, 2]
    monkeypatch.setattr(toxicity, "CONFIRMED_BYTES", 100)
    assert len(toxicity.confirmed_rows(rows, 1000, "<u2")) == 25


def test_toxicity_with_a_repeated_id(spark):
    docs, labels = repeated(spark)
    assert toxicity.toxic_scores(docs, labels).count() == docs.count()


def slices(text: str) -> list[list[str]]:
    """The paragraphs' slices, as the module's docstring has them."""
    out = []
    for k, p in enumerate(text.split("\n")):
        head = fingerprints.HEAD if k == 0 else 0
        parts = [p[i : i + fingerprints.FINE] for i in range(0, min(head, len(p)), fingerprints.FINE)]
        out.append(parts + [p[i : i + fingerprints.SLICE] for i in range(head, len(p), fingerprints.SLICE)])
    return out


def tree_of(fingerprint: str) -> list[list[list[str]]]:
    """Sections, paragraphs and leaves of a fingerprint's string."""
    body = fingerprint.split(":", 1)[1]
    return [[p.split("=")[1].split(".") if p.split("=")[1] else [] for p in s.split("(")[1].rstrip(")").split(",")] for s in body.split(";")]


def test_fingerprints_are_trees_of_slices(spark):
    """Leaves stand for slices one by one, sections hold eight paragraphs, and likeness is the share of common slices."""
    rows = odd_docs(3) + [(500, "\n".join(f"line {k} " + "x" * (k * 7) for k in range(21)), "en", "a", 1), (501, "\n\n\n", "en", "a", 1)]
    texts = {i: t or "" for i, t, *_ in rows}
    got = {r["doc_id"]: r for r in fingerprints.compare_with_edits(frame(spark, rows)).collect()}
    ids, leaf_of, hash_of = sorted(texts), {}, {}
    for k, i in enumerate(ids):
        t, ahead = texts[i], texts[ids[(k + 1) % len(ids)]]
        q = len(t) // 4
        edited = t[: len(t) - q] + ahead[:q]
        for text, name in ((t, "fingerprint"), (edited, "edited_fingerprint")):
            want, sections = slices(text), tree_of(got[i][name])
            assert [len(s) for s in sections] == [min(8, len(want) - at) for at in range(0, len(want), 8)]
            leaves = [p for s in sections for p in s]
            assert [len(p) for p in leaves] == [len(p) for p in want]
            for a, b in zip([x for p in want for x in p], [x for p in leaves for x in p]):
                assert leaf_of.setdefault(a, b) == b and hash_of.setdefault(b, a) == a
        dice = lambda a, b: 1.0 if not a | b else 2 * len(a & b) / (len(a) + len(b))
        flat = lambda text: {x for p in slices(text) for x in p}
        assert abs(got[i]["near_edited"] - dice(flat(t), flat(edited))) < 1e-12
        assert abs(got[i]["near_next"] - dice(flat(t), flat(ahead))) < 1e-12


def test_tasks_of_the_graph_search_grow_with_shards_alone():
    """From a million to a billion vectors tasks are no more than shards and what keeps the cluster busy, and a graph is copied no oftener than that needs."""
    from loculus.llm import hnsw

    for parts in (8, 200, 4000):
        for size in (10**5, 10**6, 10**7, 10**8, 10**9):
            shards, groups, copies = hnsw.layout(size, parts)
            assert groups <= shards <= groups * hnsw.HELD and shards * hnsw.SHARD_ROWS >= size
            assert groups * copies <= groups + hnsw.WAVES * parts + 1
            assert shards * copies <= hnsw.HELD * (shards + hnsw.WAVES * parts + 1)  # graphs that are sent


def test_groups_of_graphs_find_the_same_links(spark, monkeypatch):
    from loculus.llm import hnsw

    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 12))
    x = np.repeat(centres, 8, 0) + 0.1 * rng.normal(size=(320, 12))
    docs = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    want = sorted(map(tuple, hnsw.near_vectors(docs).collect()))
    monkeypatch.setattr(hnsw, "layout", lambda size, parts: (7, 3, 2))
    assert sorted(map(tuple, hnsw.near_vectors(docs).collect())) == want and any(r[1] for r in want)


def test_sums_do_not_depend_on_the_number_of_buckets(spark, monkeypatch):
    """With far more buckets than words, a chunk sends a row an item at most, and scores stay the same."""
    from loculus.llm import lm_scoring

    monkeypatch.setattr(lm_scoring, "MOST_TASKS", 4)
    docs = frame(spark, odd_docs(5))
    chunks = lm_scoring.write_table(lm_scoring.coded(docs.select("doc_id", "text", (F.col("doc_id") % 3 == 0).alias("target"))), "test-chunks")
    totals = []
    for buckets in (1, 3, 50_000):
        got = lm_scoring.summed(chunks, buckets).collect()
        counts = {"t": 0, "g": 0}
        for r in got:
            for c in counts:
                counts[c] += int(lm_scoring.unplanes(r[c], r["words"] + r["pairs"]).sum())
        totals.append((sum(r["words"] for r in got), sum(r["pairs"] for r in got), sum(r["distinct"] for r in got), counts["t"], counts["g"]))
        assert len(got) <= sum(r["words"] + r["pairs"] for r in got)
    assert totals[0] == totals[1] == totals[2]
