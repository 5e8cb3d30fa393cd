"""Replies, hypotheses, settings and maps in files."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from loculus.functions import texts as T
from loculus.operators.beliefs import entity_beliefs
from loculus.plans.fixtures import detections
from loculus.session import cut
from loculus.sources import results, settings
from tests.conftest import SMALL


def each(spark, values, f):
    return [r[0] for r in spark.createDataFrame([(k, *v) for k, v in enumerate(values)], "k int, a string, b array<string>").orderBy("k").select(f).collect()]


def test_reply_answer(spark):
    """The last answer by name, in either colon; an option or its letter in it gives the letter; without one there is none."""
    options = ["left", "right"]
    cases = [("Reasoning...\n最终答案：Right of it", options, "B"), ("答案: 3.5\nmore", [], "3.5"), ("答案：A\n", options, "A"), ("no answer here", options, ""), ("答案: behind", options, "behind")]
    assert each(spark, [(a, b) for a, b, _ in cases], T.reply_answer(F.col("a"), F.col("b"))) == [w for *_, w in cases]


def test_confirmation(spark):
    cases = [("Yes, I see it", 0.2), ("存在", 0.2), ("There is a lamp", 0.2), ("not a lamp", -0.1), ("no idea", None), ("", None), (None, None)]
    assert each(spark, [(a, None) for a, _ in cases], T.confirmation(F.col("a"), F.lit("lamp"))) == [w for _, w in cases]


def test_hypothesis(spark):
    options = ["A. left", "B. right"]
    got = each(spark, [("answer=B detail=the lamp is at 3", options), ("nothing", options)], T.hypothesis(F.lit("direction"), F.col("a"), F.col("b")))
    assert got[0] == "3D computation (noisy) suggests answer=B (right).\nReasoning: the lamp is at 3" and got[1].startswith("3D computation (noisy) suggests answer=? (?)")


def test_maps_are_read_back(spark, tmp_path):
    e = cut(entity_beliefs(detections(spark, SMALL).filter("scene < 2")))
    results.save_map(e, str(tmp_path / "map"))
    back = results.load_map(spark, str(tmp_path / "map"), e)
    assert back.schema.names == e.schema.names
    few = ["scene", "label", "entity_id", "obs_count", "support_frames", "mx", "cxx"]
    assert sorted(map(str, back.select(few).collect())) == sorted(map(str, e.select(few).collect()))


def test_frame_budgets():
    assert [settings.frame_budget(n, 30.0) for n in (10, 120, 900, 100_000)] == [8, 8, 60, 128]
    assert [settings.frame_at(s, 30.0, 100) for s in (-1.0, 0.0, 1.0, 99.0)] == [0, 0, 30, 99]
    assert list(settings.frame_batches(100, 5, 2)) == [[0, 24], [49, 74], [99]]


def test_manifest_in_order(tmp_path, monkeypatch):
    for n in ("a", "b", "c"):
        (tmp_path / f"{n}.json").write_text("{}")
    paths = {n: str(tmp_path / f"{n}.json") for n in "abc"}
    monkeypatch.setenv("SOME_MANIFEST", paths["b"])
    find = settings.manifest_path
    assert find(paths["a"], "SOME_MANIFEST", paths["c"]) == paths["a"]
    assert find(None, "SOME_MANIFEST", paths["c"]) == paths["b"]
    monkeypatch.delenv("SOME_MANIFEST")
    assert find(None, "SOME_MANIFEST", paths["c"]) == paths["c"]
    assert find(None, "SOME_MANIFEST", str(tmp_path / "none.json")) == paths["a"]
    with pytest.raises(FileNotFoundError):
        find(None, "SOME_MANIFEST", str(tmp_path / "sub" / "none.json"))
