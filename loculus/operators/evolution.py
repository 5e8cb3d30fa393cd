"""Corrections of entities before a question is answered, checks afterwards, and the bounded loop of rounds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loculus.functions.tables import COMMON_RANGES, SYNONYMS
from loculus.operators.beliefs import entity_rounds
from loculus.operators.matching import name_pairs
from loculus.session import cut

# Reference sizes in metres of the size correction, and areas by what stands in them, tried in this order.
REFERENCE = [("door", 2.0), ("chair", 0.8), ("bed", 2.0), ("toilet", 0.4), ("refrigerator", 1.75), ("sofa", 0.85), ("table", 0.75), ("desk", 0.75)]
AREAS = [
    ("kitchen", ["stove", "refrigerator", "fridge", "sink", "microwave", "oven"]),
    ("bedroom", ["bed", "nightstand", "dresser", "closet"]),
    ("living_room", ["sofa", "couch", "tv", "television", "coffee table"]),
    ("bathroom", ["toilet", "bathtub", "shower", "sink"]),
]
THRESHOLDS, STOP, CONSENSUS, LOW_CONFIDENCE = (0.4, 0.3, 0.2, 0.15, 0.1), 0.35, 0.6, 0.25


def _first(label: Column, table: list[tuple], column: int) -> Column:
    out = F.lit(None).cast("double")
    for row in reversed(table):
        out = F.when(F.lower(label).contains(row[0]), F.lit(float(row[column]))).otherwise(out)
    return out


def counts(det: DataFrame) -> DataFrame:
    """Counts by frames: the lesser of median and commonest (from three frames on), and no more than the median of sure detections (over 0.5)."""
    f = det.groupBy("scene", "label", "frame_idx").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.round("confidence", 9) > 0.5).alias("sure"), F.min("det_ord").alias("o"))
    freq = f.groupBy("scene", "label", "n").agg(F.count(F.lit(1)).alias("c"), F.min("o").alias("o")).groupBy("scene", "label").agg(F.max_by("n", F.struct("c", -F.col("n"))).alias("mode"))
    m = f.groupBy("scene", "label").agg(F.count(F.lit(1)).alias("frames"), F.percentile("n", F.lit(0.5)).cast("int").alias("median"), F.percentile(F.when(F.col("sure") > 0, F.col("sure")), F.lit(0.5)).cast("int").alias("sure")).join(freq, ["scene", "label"])
    base = F.when(F.col("frames") >= 3, F.least("median", "mode")).otherwise(F.col("median"))
    trust = F.when(F.col("frames") < 3, 0.6).when(F.col("median") == F.col("mode"), 0.9).otherwise(0.7)
    lower = F.coalesce(F.col("sure") < base, F.lit(False))
    return m.select("scene", "label", F.when(lower, F.col("sure")).otherwise(base).alias("count"), F.when(lower, F.least(trust + 0.1, F.lit(0.95))).otherwise(trust).alias("confidence"))


def sizes(entities: DataFrame, reference=REFERENCE, ranges=COMMON_RANGES) -> DataFrame:
    """Entities with a scene's factor from its surest reference (0.2 to 5) applied, and sizes far outside usual ranges set to their middle."""
    size = F.greatest("w3", "h3")
    f = _first(F.col("label"), reference, 1) / size
    ok = entities.filter(size > 0.01).withColumn("f", f).filter((F.col("f") > 0.2) & (F.col("f") < 5.0))
    best = ok.groupBy("scene").agg(F.max_by("f", F.struct(F.round("confidence", 9), -F.col("entity_ord"))).alias("factor"))
    e = entities.join(best, "scene", "left").withColumn("factor", F.coalesce("factor", F.lit(1.0)))
    e = e.withColumns({c: F.col(c) * F.col("factor") for c in ("w3", "h3", "d3", "mx", "my", "mz")})
    low, high = _first(F.col("label"), ranges, 1), _first(F.col("label"), ranges, 2)
    fix = F.when((size < low * 0.3) | (size > high * 3), F.when(size > 0, (low + high) / 2 / size).otherwise(F.lit(1.0))).otherwise(F.lit(1.0))
    e = e.withColumn("fix", F.coalesce(fix, F.lit(1.0)))
    return e.withColumns({c: F.col(c) * F.col("fix") for c in ("w3", "h3", "d3")})


def distances(entities: DataFrame, most: float = 10.0) -> DataFrame:
    """Places of scenes deeper than `most` drawn in to 0.9 of it; flat: whether over five entities lie within half a metre of depth."""
    s = entities.groupBy("scene").agg(F.max("mz").alias("deep"), (F.max("mz") - F.min("mz")).alias("span"), F.count(F.lit(1)).alias("n"))
    e = entities.join(s, "scene").withColumn("shrink", F.when((F.col("n") >= 2) & (F.col("deep") > most), most / F.col("deep") * 0.9).otherwise(F.lit(1.0)))
    return e.withColumns({c: F.col(c) * F.col("shrink") for c in ("mx", "my", "mz")}).withColumn("flat", (F.col("span") < 0.5) & (F.col("n") > 5))


def directions(det: DataFrame) -> DataFrame:
    """Median places of labels with three detections or more, with stability 1 / (1 + mean deviation)."""
    return det.groupBy("scene", "label").agg(F.count(F.lit(1)).alias("n"), *[F.median(c).alias(f"m{c}") for c in "xyz"], (1 / (1 + (F.stddev_pop("x") + F.stddev_pop("y") + F.stddev_pop("z")) / 3)).alias("stability")).filter("n >= 3")


def area_of(label: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, words in reversed(AREAS):
        out = F.when(reduce(lambda a, b: a | b, [F.lower(label).contains(w) for w in words]), F.lit(name)).otherwise(out)
    return out


def drop_unsure(entities: DataFrame, least: float = LOW_CONFIDENCE) -> DataFrame:
    return entities.filter(F.col("confidence") >= least)


def critic(entities: DataFrame, conflicts: DataFrame) -> DataFrame:
    """scene, verdict: re_observe where an entity is unsure (under 0.3) or two conflict, physics_violation where a size is above 10 m, else pass."""
    e = entities.groupBy("scene").agg(F.count_if(F.col("confidence") < 0.3).alias("unsure"), F.count_if(F.greatest("w3", "h3") > 10).alias("huge"))
    c = conflicts.groupBy("scene").agg(F.count(F.lit(1)).alias("conflicts"))
    return e.join(c, "scene", "left").select("scene", F.when((F.col("unsure") > 0) | (F.coalesce("conflicts", F.lit(0)) > 0), "re_observe").when(F.col("huge") > 0, "physics_violation").otherwise("pass").alias("verdict"))


def refine(entities: DataFrame, factor: float) -> DataFrame:
    """Covariances times a factor: 1.2 where a check failed, 0.8 where a look confirmed."""
    return entities.withColumns({c: F.col(c) * factor for c in ("cxx", "cxy", "cxz", "cyy", "cyz", "czz")}).withColumn("position_uncertainty", F.col("position_uncertainty") * F.sqrt(F.lit(factor)))


def vote(history: DataFrame, rounds: int) -> DataFrame:
    """qid, answer by weight: round + 1 (the first look: all rounds) times confidence (0.1 at least); equal weights go to the answer given first. history: qid, round, answer, conf."""
    w = F.when(F.col("round") == 0, F.lit(rounds)).otherwise(F.col("round") + 1) * F.greatest(F.col("conf"), F.lit(0.1))
    s = history.filter("answer IN ('A', 'B', 'C', 'D')").groupBy("qid", "answer").agg(F.sum(w).alias("w"), F.min("round").alias("o"))
    return s.groupBy("qid").agg(F.max_by("answer", F.struct(F.round("w", 9), -F.col("o"))).alias("answer"))


def median_vote(responses: DataFrame, low: float, high: float) -> DataFrame:
    """qid, answer: the median of the numbers in several responses that lie within bounds, to one decimal; null without any."""
    v = F.nullif(F.regexp_extract("text", r"[\d.]+", 0), F.lit("")).try_cast("double")
    return responses.withColumn("v", v).groupBy("qid").agg(F.median(F.when(F.col("v").between(low, high), F.col("v"))).alias("m")).select("qid", F.when(F.col("m").isNotNull(), F.format_string("%.1f", F.round("m", 6))).alias("answer"))


def round_book(names: DataFrame, det: DataFrame, thresholds: tuple[float, ...], synonyms, most: int = 2) -> DataFrame:
    """A row for each scene: _names, a map of each name asked there to an array with a round's f (frames of the first `most` entities that it means), f1 and s (frames and uncertainty of the first).

    names: scene, name. Which names mean which labels is looked up once for all scenes; a name takes its labels to its scene as one row.
    """
    names = cut(names.filter("name IS NOT NULL").distinct())
    # labels alone are read, so detections are not dealt for this
    words = name_pairs(names.select("name"), cut(det.select("label").distinct()), synonyms).groupBy("name").agg(F.collect_list("label").alias("labels"))
    asked = names.join(words, "name").groupBy("scene").agg(F.collect_list(F.struct("name", "labels")).alias("_asked"))
    things = entity_rounds(det, thresholds).filter("label IS NOT NULL").groupBy("scene").agg(F.map_from_entries(F.collect_list(F.struct("label", "rounds"))).alias("_things"))
    book = asked.join(things, "scene").select("scene", F.transform("_asked", lambda a: F.struct(a["name"].alias("name"), F.filter(F.transform(a["labels"], lambda l: F.try_element_at(F.col("_things"), l)), lambda r: r.isNotNull()).alias("met"))).alias("_met"))
    first = lambda met, k: F.slice(F.sort_array(F.filter(F.transform(met, lambda r: r[k]), lambda r: r["o"].isNotNull())), 1, most)
    of = lambda met, k: F.transform(F.array(first(met, k)), lambda t: F.struct(F.array_distinct(F.flatten(F.transform(t, lambda r: r["f"]))).alias("f"), F.get(t, F.lit(0))["f"].alias("f1"), F.get(t, F.lit(0))["u"].alias("s")))[0]
    return book.select("scene", F.map_from_entries(F.transform("_met", lambda m: F.struct(m["name"], F.array(*[of(m["met"], k) for k in range(len(thresholds) + 1)])))).alias("_names"))


def frames_of(found: Column, once: Column, seen: Column, most: int = 8) -> Column:
    """The best frames of a question in order, as selection.scored_frames has them. found: array of f, f1, s of its names; once: of its distinct names; seen: array of frames seen before, or null."""
    every = F.array_distinct(F.flatten(F.transform(once, lambda i: i["f"])))
    sure = lambda f: F.transform(F.filter(found, lambda i: F.array_contains(i["f1"], f) & i["s"].isNotNull()), lambda i: i["s"])
    score = lambda s, f: F.size(s) * F.greatest(F.lit(0.1), F.aggregate(s, F.lit(0.0), lambda a, x: a + x)) * F.when(F.coalesce(F.array_contains(seen, f), F.lit(False)), 0.3).otherwise(1.0)
    rows = F.transform(every, lambda f: F.struct(F.size(F.filter(once, lambda i: F.array_contains(i["f"], f))).alias("n"), (-F.round(F.transform(F.array(sure(f)), lambda s: score(s, f))[0], 9)).alias("p"), f.cast("int").alias("f")))
    best = lambda r: F.filter(r, lambda x: (x["n"] >= 2) | (F.array_max(F.transform(r, lambda y: y["n"])) < 2))
    return F.transform(F.array(rows), lambda r: F.sort_array(F.transform(F.slice(F.sort_array(F.transform(best(r), lambda x: F.struct(x["p"], x["f"]))), 1, most), lambda x: x["f"])))[0]


def voted(history: Column, rounds: int) -> Column:
    """As vote, of an array of a question's looks (round, answer, conf); null without any of A to D."""
    w = lambda h: F.when(h["round"] == 0, F.lit(rounds)).otherwise(h["round"] + 1) * F.greatest(h["conf"], F.lit(0.1))
    own = lambda a: F.filter(history, lambda h: h["answer"] == a)
    score = lambda a: F.struct(F.round(F.aggregate(own(a), F.lit(0.0), lambda s, h: s + w(h)), 9).alias("w"), (-F.array_min(F.transform(own(a), lambda h: h["round"]))).alias("o"), F.lit(a).alias("a"))
    return F.array_max(F.filter(F.array(*[score(a) for a in "ABCD"]), lambda s: s["o"].isNotNull()))["a"]


def belief_rounds(questions: DataFrame, det: DataFrame, looks: DataFrame, rounds: int = 3, synonyms=None) -> DataFrame:
    """The loop of look, compare, refine over all questions at once, at most `rounds` times: qid, answer, converged, rounds.

    questions: qid, scene, names. looks: qid, round (0: at the whole), answer, conf; one of a round. A question ends when its look agrees with the
    first one at a mean confidence of 0.6 or more, when two looks after each other agree, or when its frames stay the same;
    else its scene's noisiest detections go for it and its frames are chosen anew. A question's refinements are its own; but what
    goes in a round depends on the scene and the round alone, so all rounds of a scene's entities are made once, from detections that are dealt
    once, and a question goes through its rounds in the task of its scene. What is left undecided is decided by vote.
    """
    synonyms = SYNONYMS if synonyms is None else synonyms
    book = round_book(questions.select("scene", F.explode("names").alias("name")), det, tuple(THRESHOLDS[min(k, len(THRESHOLDS) - 1)] for k in range(rounds - 1)), synonyms)
    told = looks.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("round", "answer", "conf"))).alias("_looks"))
    look = lambda k: F.get(F.filter("_looks", lambda h: h["round"] == k), F.lit(0))
    null = F.lit(None).cast("string")
    s = questions.select("qid", "scene", "names").join(told, "qid", "left").join(book, "scene", "left")
    s = s.withColumns({"_l0": look(0), "before": null, "final": null, "converged": null, "n": F.lit(0), "frames": F.lit(None).cast("array<int>")})
    met = lambda names, k: F.filter(F.transform(names, lambda x: F.get(F.try_element_at(F.col("_names"), x), F.lit(k - 1))), lambda i: i.isNotNull())
    s = s.withColumns({f"_f{k}": met(F.col("names"), k) for k in range(1, rounds + 1)} | {f"_d{k}": met(F.array_distinct("names"), k) for k in range(1, rounds + 1)}).drop("_names", "names", "scene")
    for k in range(1, rounds + 1):
        s = s.withColumns({"now": F.coalesce(frames_of(F.col(f"_f{k}"), F.col(f"_d{k}"), F.col("frames")), F.array().cast("array<int>")), "_l": look(k)}).drop(f"_f{k}", f"_d{k}")
        answer, a0 = F.col("_l.answer"), F.col("_l0.answer")
        valid = F.coalesce(answer.isin(*"ABCD"), F.lit(False))
        running = F.col("final").isNull() & F.col("converged").isNull()
        same = F.coalesce(F.col("now") == F.col("frames"), F.lit(False)) & F.lit(k > 1)
        agree = valid & (answer == a0)
        s = s.withColumns({"_run": running, "_same": same, "_sure": F.coalesce(agree & ((F.col("_l0.conf") + F.col("_l.conf")) / 2 >= CONSENSUS), F.lit(False)), "_stable": F.coalesce(valid & ~agree & (answer == F.col("before")), F.lit(False))})
        goes, sure, stable = F.col("_run") & ~F.col("_same"), F.col("_sure"), F.col("_stable")
        s = s.withColumns({
            "before": F.when(goes, answer).otherwise(F.col("before")), "final": F.when(goes & sure, a0).when(goes & stable, answer).otherwise(F.col("final")),
            "converged": F.when(F.col("_run") & F.col("_same"), "no_new_frames").when(F.col("_run") & sure, "global_consensus_confident").when(F.col("_run") & stable, "evolution_stable").otherwise(F.col("converged")),
            "n": F.when(goes, F.lit(k)).otherwise(F.col("n")), "frames": F.when(F.col("_run"), F.col("now")).otherwise(F.col("frames")),
        })
    vote_of = voted(F.filter("_looks", lambda h: h["round"] <= F.col("n")), rounds)
    return s.select("qid", F.coalesce("final", vote_of, F.lit("A")).alias("answer"), F.coalesce("converged", F.lit("conf_weighted_vote")).alias("converged"), F.col("n").alias("rounds"))


# What is corrected before a question of a type is answered, by words of the type, tried in this order; else sizes.
STRATEGIES = [("counting", "counts"), ("size", "sizes"), ("distance", "distances"), ("direction", "directions"), ("appearance", "first_seen"), ("order", "first_seen"), ("route", "topology")]


def strategy_of(qtype: Column) -> Column:
    out = F.lit("sizes")
    for word, name in reversed(STRATEGIES):
        out = F.when(F.lower(qtype).contains(word), F.lit(name)).otherwise(out)
    return out


def evolve(questions: DataFrame, entities: DataFrame, det: DataFrame, least: float = LOW_CONFIDENCE, reference=REFERENCE, ranges=COMMON_RANGES, most: float = 10.0) -> DataFrame:
    """questions (qid, scene, qtype) with each entity as its type's correction leaves it: qid, strategy, label, count, w3, h3, mx, my, mz, first_seen.

    Unsure entities go first. Every correction is made once a scene; questions pick theirs by scene and strategy.
    """
    from loculus.operators.series import gaps

    e = drop_unsure(entities, least)
    keep = ["scene", "label", "count_in_frame", "w3", "h3", "mx", "my", "mz", "first_seen"]
    plain = e.select(*keep)
    counted = plain.join(counts(det).select("scene", "label", F.col("count").alias("_c")), ["scene", "label"], "left").withColumn("count_in_frame", F.coalesce("_c", "count_in_frame"))
    moved = plain.join(directions(det).select("scene", "label", *[F.col(f"m{c}").alias(f"_{c}") for c in "xyz"]), ["scene", "label"], "left").withColumns({f"m{c}": F.coalesce(f"_{c}", f"m{c}") for c in "xyz"})
    sure = plain.join(gaps(det).select("scene", "label", F.col("first_sure").alias("_f")), ["scene", "label"], "left").withColumn("first_seen", F.coalesce("_f", "first_seen"))
    all_ = {"counts": counted, "sizes": sizes(e, reference, ranges), "distances": distances(e, most), "directions": moved, "first_seen": sure, "topology": plain}
    done = reduce(DataFrame.unionByName, [d.select(F.lit(s).alias("strategy"), *keep) for s, d in all_.items()])
    return questions.withColumn("strategy", strategy_of(F.col("qtype"))).join(done, ["scene", "strategy"]).select("qid", "strategy", "label", F.col("count_in_frame").alias("count"), "w3", "h3", "mx", "my", "mz", "first_seen")


def agent_rates(runs: DataFrame) -> DataFrame:
    """total, triggered, improved, evolution_rate, improvement_rate of runs (rounds, evolved): rounds that began, and runs that a round changed."""
    s = runs.agg(F.count(F.lit(1)).alias("total"), F.coalesce(F.sum("rounds"), F.lit(0)).alias("triggered"), F.count_if("evolved").alias("improved"))
    return s.select("*", (F.col("triggered") / F.greatest(F.lit(1), F.col("total"))).alias("evolution_rate"), F.when(F.col("triggered") > 0, F.col("improved") / F.col("triggered")).otherwise(F.lit(0.0)).alias("improvement_rate"))
