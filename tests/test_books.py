"""Answers from the book of a scene: names meet entities once, and questions are sent to their scene alone."""

from __future__ import annotations

from loculus.operators import answers as A

THINGS = [(1, "red chair", 1, 2, 0.0, 0.0, 0.0, 60, 0.5, 0.4, 0.9), (1, "blue chair", 2, 3, 3.0, 0.0, 4.0, 0, 1.0, 0.8, 0.9), (1, "lamp", 3, 1, 0.0, 0.0, 2.0, 30, 0.3, 0.2, 0.5)]
ENTITIES = "scene long, label string, entity_ord long, count_in_frame int, mx double, my double, mz double, first_seen int, w3 double, h3 double, confidence double"
QUESTIONS = "qid string, scene long, qtype string, question string, options array<string>, ground_truth string"
ORDER = "What will be the first-time appearance order of the following categories in the video: red chair, lamp?"


def asked(spark, rows):
    ent = spark.createDataFrame(THINGS, ENTITIES)
    q = spark.createDataFrame(rows, QUESTIONS)
    scale = spark.createDataFrame([(1, 2.0)], "scene long, scf double")
    area = spark.createDataFrame([(1, 30.4)], "scene long, area double")
    return A.answer_all(q, ent, None, scale, area)


def test_questions_are_not_dealt_by_id(spark):
    rows = [("a", 1, "object_counting", "How many chairs are in this room?", None, "3"), ("b", 1, "obj_appearance_order", ORDER, ["A. red chair, lamp", "B. lamp, red chair"], "B")]
    plan = asked(spark, rows)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(qid" not in plan


def test_answers_by_hand(spark):
    near = "Which of these objects is the closest to the lamp?"
    rows = [
        ("count", 1, "object_counting", "How many chairs are in this room?", None, "3"), ("size", 1, "object_size_estimation", "What is the size of the chair?", None, "100"), ("room", 1, "room_size_estimation", "What is the size of this room?", None, "30"),
        ("dist", 1, "object_abs_distance", "what is the distance between the red chair and the lamp (in meters)?", None, "4"), ("rel", 1, "object_rel_distance", near, ["A. cow", "B. red chair", "C. lamp"], "C"),
        ("far", 1, "object_rel_distance", near.replace("closest to", "farthest from"), ["A. cow", "B. red chair", "C. lamp"], "B"), ("order", 1, "obj_appearance_order", ORDER, ["A. lamp, cow", "B. lamp, red chair"], "B"),
        ("twice", 1, "object_counting", "How many lamps are in this room?", None, "1"), ("twice", 1, "object_counting", "How many lamps are in this room?", None, "1"),
        ("none", 2, "object_rel_distance", near, None, "A"), ("null", None, "object_counting", "How many lamps are in this room?", None, "0"), ("odd", 1, "obj_appearance_order", "What?", [], "A"),
    ]
    got = sorted((r["qid"], r["answer"]) for r in asked(spark, rows).collect())
    assert got == sorted([("count", "3"), ("size", "100"), ("room", "30"), ("dist", "4.00"), ("rel", "C"), ("far", "B"), ("order", "B"), ("twice", "1"), ("twice", "1"), ("none", "A"), ("null", "0"), ("odd", "A")])


def test_an_agents_questions_are_not_dealt_by_id(spark):
    from loculus.operators import family_answers as FA

    row = {"scene": 1, "label": "lamp", "entity_ord": 1, "obs_count": 3, "max_in_frame": 2, "first_seen": 0}
    kinds = {"scene": "long", "label": "string", "entity_ord": "long", "obs_count": "long", "max_in_frame": "long", "first_seen": "int"}
    columns = ["scene", "entity_ord", *FA.KEEP]
    ent = spark.createDataFrame([tuple(row.get(c, 1.0) for c in columns)], ", ".join(f"{c} {kinds.get(c, 'double')}" for c in columns))
    q = spark.createDataFrame([("a", 1, "object_counting", "How many lamps are in this room?", ["A. lamp"], "1")], QUESTIONS)
    for answer in (FA.agent_counting, FA.object_size, FA.agent_distance, FA.agent_direction, FA.agent_rel_distance, FA.agent_order):
        plan = answer(q, ent)._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(qid" not in plan, answer.__name__
    assert FA.agent_counting(q, ent).collect()[0]["answer"] == "2" and FA.agent_order(q, ent).collect()[0]["answer"] == "A. lamp"


def test_filtered_order_is_not_dealt_by_id(spark):
    from loculus.operators import family_answers as FA

    kinds = {"label": "string", "obs_count": "long", "max_in_frame": "long", "first_seen": "int"}
    thing = lambda k, label, first, n: (1, k, *[{"label": label, "first_seen": first, "obs_count": n, "max_in_frame": 1}.get(c, 1.0) for c in FA.KEEP])
    ent = spark.createDataFrame([thing(1, "red chair", 60, 4), thing(2, "lamp", 30, 8)], "scene long, entity_ord long, " + ", ".join(f"{c} {kinds.get(c, 'double')}" for c in FA.KEEP))
    options = ["A. red chair, lamp", "B. lamp, red chair"]
    q = spark.createDataFrame([("a", 1, "obj_appearance_order", ORDER, options, "B"), ("far", 2, "obj_appearance_order", ORDER, options, "B"), ("odd", 1, "obj_appearance_order", "What?", None, "B")], QUESTIONS)
    got = FA.appearance_order(q, ent)
    assert "hashpartitioning(qid" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == [("a", options[1], 0.6), ("far", options[0], 0.3)]
