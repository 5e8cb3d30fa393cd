"""Answers to spatial questions over a scene's entities, whole tables of questions at once.

questions: qid, scene, qtype, question, options (array of "A. text"), ground_truth. Each answerer returns qid, answer.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loculus.functions import questions as Q
from loculus.functions.names import meanings, plain, singulars, tokens
from loculus.functions.tables import NUMERIC_TASKS, SYNONYMS, TYPICAL_CM
from loculus.operators.lookup import listed, place_of, scene_book
from loculus.session import cut


def _answered(q: DataFrame, kinds: list, entities: DataFrame, scale: DataFrame | None = None, synonyms=SYNONYMS) -> DataFrame:
    """q with an answer column, by kinds of (types, read, answer); types: those of a kind, None for all.

    read: columns from a question's text, of which _asked has all names to look up. answer: rows with these, their scene's book and its scf to rows with
    an answer. Names of all kinds meet the entities once, and questions go to their scene alone.
    """
    of = lambda types: q if types is None else q.filter(F.col("qtype").isin(*types))
    asked = [of(types).select("scene", F.explode(F.array_distinct(read()["_asked"])).alias("name")) for types, read, _ in kinds]
    book = scene_book(reduce(DataFrame.unionByName, asked), entities, synonyms)
    book = cut(book.withColumn("scf", F.lit(None).cast("double")) if scale is None else book.join(scale.select("scene", "scf"), "scene", "left"))
    parts = [answer(of(types).withColumns(read()).join(book, "scene", "left")).select(*q.columns, "answer") for types, read, answer in kinds]
    return reduce(DataFrame.unionByName, parts)


def _asked(i: int) -> Column:
    return F.get(F.col("_asked"), F.lit(i))


def _once(value: Column, f) -> Column:
    """f of a value that is worked out once a row: what a loop over an array only refers to would else be worked out in each of its steps."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _metres(a: str, b: Column | str) -> Column:
    """Between two places (struct columns), by the scene's scale."""
    a, b = F.col(a), F.col(b) if isinstance(b, str) else b
    return F.sqrt(reduce(lambda x, y: x + y, [(a[c] - b[c]) * (a[c] - b[c]) for c in ("mx", "my", "mz")])) * F.col("scf")


def best_option(options: Column, points) -> Column:
    """The letter of the option with the most points, the first of equals; points: a function of the option and its number."""
    scored = F.transform(options, lambda o, i: F.struct(points(o, i).alias("p"), (-i).alias("i"), Q.letter(o).alias("l")))
    best = F.array_max(scored)
    return F.when(best["p"] > -1, best["l"]).otherwise(F.lit("A"))


def _count_read() -> dict[str, Column]:
    return {"_asked": singulars(F.lower(Q.groups(F.col("question"), Q.COUNT, 1)[0]))}


def _count(rows: DataFrame) -> DataFrame:
    n = F.filter(F.transform("_asked", lambda s: listed(s)["n"]), lambda n: n.isNotNull())
    return rows.withColumn("answer", F.coalesce(F.get(n, F.lit(0)), F.lit(0)).cast("string"))


def counting(q: DataFrame, entities: DataFrame, synonyms=SYNONYMS) -> DataFrame:
    """The greatest usual count among the entities that the name means, by its plural first, then as a singular; else 0."""
    return _answered(q, [(None, _count_read, _count)], entities, None, synonyms).select("qid", "answer")


def _size_read() -> dict[str, Column]:
    return {"_asked": F.array(*Q.groups(F.lower(F.col("question")), Q.SIZE, 1))}


def _size(rows: DataFrame) -> DataFrame:
    name = _asked(0)
    usual = F.lit("80")
    for k, v in reversed(TYPICAL_CM):
        usual = F.when(name.contains(k), F.lit(str(v))).otherwise(usual)
    size = F.get(F.col("_sizes"), listed(name)["sure"] - 1)["size"]
    rows = rows.withColumn("_cm", F.rint(size * F.col("scf") * 100).cast("int"))
    return rows.withColumn("answer", F.when(name.isNull(), "100").when(F.col("_cm").between(5, 500), F.col("_cm").cast("string")).otherwise(usual))


def object_size(q: DataFrame, entities: DataFrame, scale: DataFrame, synonyms=SYNONYMS) -> DataFrame:
    """Centimetres of the surest entity that the name means, if from 5 to 500; else a typical size, else 80; 100 where nothing is named."""
    return _answered(q, [(None, _size_read, _size)], entities, scale, synonyms).select("qid", "answer")


def room_size(q: DataFrame, area: DataFrame) -> DataFrame:
    return _room(q, area).select("qid", "answer")


def _room(q: DataFrame, area: DataFrame) -> DataFrame:
    return q.join(area.select("scene", "area"), "scene", "left").select(*q.columns, F.coalesce(F.rint("area").cast("int").cast("string"), F.lit("25")).alias("answer"))


def _distance_read() -> dict[str, Column]:
    return {"_asked": F.array(*Q.groups(F.lower(F.col("question")), Q.BETWEEN, 2))}


def _distance(rows: DataFrame) -> DataFrame:
    rows = rows.withColumns({"_a": place_of(_asked(0)), "_b": place_of(_asked(1))}).withColumn("_d", _metres("_a", "_b"))
    return rows.withColumn("answer", F.when(F.col("_d").isNull(), F.lit("2.0")).otherwise(F.format_string("%.2f", F.greatest(F.lit(0.1), F.least("_d", F.lit(20.0))))))


def abs_distance(q: DataFrame, entities: DataFrame, scale: DataFrame, synonyms=SYNONYMS) -> DataFrame:
    """Metres between the first entities that two names mean, within 0.1 and 20; 2.0 where they can't be told."""
    return _answered(q, [(None, _distance_read, _distance)], entities, scale, synonyms).select("qid", "answer")


def direction_word(q: Column, ahead: Column, right: Column) -> Column:
    side = F.when(right >= 0, "right").otherwise("left")
    easy = q.contains("left or the right of") | q.contains("left or right of")
    medium = q.contains("left, right, or back") | q.contains("left, right or back")
    return F.when(easy, side).when(medium, F.when(ahead < 0, F.lit("back")).otherwise(side)).otherwise(F.concat(F.when(ahead >= 0, "front").otherwise("back"), F.lit("-"), side))


def direction_points(option: Column, direction: Column) -> Column:
    """10 for an option with the direction in it; 2 for each direction word of both, less 2 for each of the option alone."""
    text = F.lower(F.trim(F.substring(option, 3, 1000)))
    out = F.when(text.contains(direction), 10).otherwise(0)
    for w in ("left", "right", "front", "back", "behind"):
        out = out + F.when(text.contains(w), F.when(direction.contains(w), 2).otherwise(-2)).otherwise(0)
    return out


def _direction_read() -> dict[str, Column]:
    return {"_asked": F.array(*Q.groups(F.lower(F.col("question")), Q.STANDING, 3))}


def _direction(rows: DataFrame) -> DataFrame:
    rows = rows.withColumns({f"_{c}": place_of(_asked(i)) for i, c in enumerate("oft")})
    fx, fz = F.col("_f.mx") - F.col("_o.mx"), F.col("_f.mz") - F.col("_o.mz")
    tx, tz = F.col("_t.mx") - F.col("_o.mx"), F.col("_t.mz") - F.col("_o.mz")
    nf, nt = F.sqrt(fx * fx + fz * fz), F.sqrt(tx * tx + tz * tz)
    ahead, right = F.try_divide(tx * fx + tz * fz, nf), F.try_divide(fx * tz - fz * tx, nf)
    rows = rows.withColumn("_word", F.when((nf >= 1e-8) & (nt >= 1e-8), direction_word(F.lower(F.col("question")), ahead, right)))
    return rows.withColumn("answer", F.when(F.col("_word").isNull() | (F.size("options") == 0), F.lit("A")).otherwise(best_option(F.col("options"), lambda o, i: direction_points(o, F.col("_word")))))


def direction(q: DataFrame, entities: DataFrame, synonyms=SYNONYMS) -> DataFrame:
    """The option that says where the third named thing is for one who stands by the first and faces the second; A where it can't be told."""
    return _answered(q, [(None, _direction_read, _direction)], entities, None, synonyms).select("qid", "answer")


def _nearest_read() -> dict[str, Column]:
    return {"_asked": F.concat(F.array(*Q.groups(F.lower(F.col("question")), Q.NEAREST, 1)), F.transform("options", lambda o: F.lower(Q.content(o))))}


def _nearest(rows: DataFrame) -> DataFrame:
    far = F.lower(F.col("question")).rlike("farthest|furthest|farther|further")
    rows = rows.withColumns({"_ref": place_of(_asked(0)), "_others": F.transform(F.slice("_asked", 2, F.greatest(F.size("_asked"), F.lit(1))), place_of)})
    d = F.filter(F.transform("_others", lambda e, k: F.struct(_metres("_ref", e).alias("d"), k.alias("k"))), lambda x: x["d"].isNotNull())
    best = _once(d, lambda d: F.when(far, F.array_min(F.transform(d, lambda x: F.struct((-x["d"]).alias("d"), x["k"].alias("k"))))).otherwise(F.array_min(d)))
    return rows.withColumn("answer", F.coalesce(Q.letter(F.get("options", best["k"])), F.lit("A")))


def rel_distance(q: DataFrame, entities: DataFrame, scale: DataFrame, synonyms=SYNONYMS) -> DataFrame:
    """The option whose thing is nearest to (or farthest from) the named one."""
    return _answered(q, [(None, _nearest_read, _nearest)], entities, scale, synonyms).select("qid", "answer")


def _order_read() -> dict[str, Column]:
    (names,) = Q.groups(F.col("question"), Q.ORDER, 1)
    return {"_asked": F.transform(F.split(F.lower(F.coalesce(names, Q.content(F.get("options", F.lit(0))))), ","), F.trim)}


def _order(synonyms) -> callable:
    def answer(rows: DataFrame) -> DataFrame:
        # names and what they mean are parted into words once, not for each place that they are compared at
        sides = lambda x: F.struct(x.alias("t"), tokens(x).alias("w"), meanings(x, synonyms).alias("m"))
        seen = F.transform(F.array_distinct("_asked"), lambda s, k: F.struct(listed(s)["first"].alias("i"), place_of(s)["first_seen"].alias("f"), k.alias("k"), s.alias("name")))
        seen = F.sort_array(F.transform(F.filter(seen, lambda s: s["i"].isNotNull()), lambda s: F.struct(s["f"], s["k"], s["name"])))
        rows = rows.withColumn("_seen", F.transform(seen, lambda s: F.struct(plain(s["name"]).alias("t"), tokens(plain(s["name"])).alias("w"))))
        lists = F.transform("options", lambda o: F.struct(Q.letter(o).alias("l"), F.transform(F.split(F.lower(Q.content(o)), ","), lambda x: _once(plain(x), sides)).alias("x")))
        means = lambda x, s: s["t"].contains(x["t"]) | x["t"].contains(s["t"]) | F.coalesce(F.arrays_overlap(x["w"], s["w"]), F.lit(False)) | F.coalesce(F.arrays_overlap(x["m"], s["w"]), F.lit(False))
        points = lambda o, seen: F.size(F.filter(F.transform(o["x"], lambda x, k: _once(F.get(seen, k), lambda s: means(x, s))), lambda m: F.coalesce(m, F.lit(False))))
        enough = F.coalesce(F.size("_seen") >= F.size("_asked") * 0.5, F.lit(False)) & (F.size("options") > 0)
        best = F.array_max(_once(F.col("_seen"), lambda seen: F.transform(lists, lambda o, i: F.struct(points(o, seen).alias("p"), (-i).alias("i"), o["l"].alias("l")))))
        return rows.withColumn("answer", F.when(enough, F.when(best["p"] > -1, best["l"]).otherwise(F.lit("A"))).otherwise(F.lit("A")))

    return answer


def appearance_order(q: DataFrame, entities: DataFrame, synonyms=SYNONYMS) -> DataFrame:
    """The option whose list agrees in most places with the named things by first frame; A where fewer than half are there."""
    return _answered(q, [(None, _order_read, _order(synonyms))], entities, None, synonyms).select("qid", "answer")


def _route_read() -> dict[str, Column]:
    text = F.lower(F.col("question"))
    steps = F.regexp_extract_all(text, F.lit(r"(?s)\d+\.\s+(.+?)(?=\d+\.|you have reached|$)"), F.lit(1))
    steps = F.filter(F.transform(steps, lambda s: F.regexp_replace(F.trim(s), r"\.+$", "")), lambda s: s.contains("please fill in") | s.contains("go forward"))
    way = lambda s: F.regexp_replace(F.trim(F.coalesce(*[F.nullif(F.regexp_extract(s, p, 1), F.lit("")) for p in (r"go forward\s+until\s+(?:the\s+)?(.+?)(?:\s+is\s+on|\s*$)", r"go forward\s+until\s+(?:passing\s+)?(?:the\s+)?(.+?)(?:\s+on\s+|\s*$)")])), r"\.+$", "")
    # a gap has no name
    return {"_asked": F.concat(F.array(*Q.groups(text, Q.ROUTE, 2)), F.transform(steps, lambda s: F.when(~s.contains("please fill in"), way(s)))), "_gaps": F.transform(steps, lambda s: s.contains("please fill in"))}


def _route(rows: DataFrame) -> DataFrame:
    """Steps are folded in order with the state (place, facing, points): a gap turns, and scores the cosine towards the next
    waypoint, or -0.5 if that is not ahead; a step forward moves and faces the way moved."""
    rows = rows.withColumns({"es": place_of(_asked(0)), "ef": place_of(_asked(1)), "_es": F.transform("_asked", place_of)})
    at = lambda i: F.get("_es", i + 2)
    rows = rows.withColumn("way", F.transform("_gaps", lambda g, i: F.struct(i.alias("k"), g.alias("gap"), at(i)["mx"].alias("x"), at(i)["mz"].alias("z"), F.get("_asked", i + 2).alias("name"))))
    # the next named step after each gap, whether or not it has a place
    nexts = F.transform("way", lambda w, i: F.struct(w["gap"].alias("gap"), w["x"].alias("x"), w["z"].alias("z"), F.get(F.filter("way", lambda v: (v["k"] > w["k"]) & ~v["gap"] & v["name"].isNotNull()), F.lit(0)).alias("n")))
    rows = rows.withColumn("walk", nexts).withColumn("named", F.get(F.filter("way", lambda v: ~v["gap"] & v["name"].isNotNull()), F.lit(0)))
    fx, fz = F.col("ef.mx") - F.col("es.mx"), F.col("ef.mz") - F.col("es.mz")
    near = F.sqrt(fx * fx + fz * fz) < 1e-8
    fx, fz = F.when(near, F.col("named.x") - F.col("es.mx")).otherwise(fx), F.when(near, F.col("named.z") - F.col("es.mz")).otherwise(fz)
    rows = rows.withColumns({"fx": fx, "fz": fz}).withColumn("fn", F.sqrt(F.col("fx") * F.col("fx") + F.col("fz") * F.col("fz")))
    rows = rows.withColumns({"fx": F.try_divide("fx", "fn"), "fz": F.try_divide("fz", "fn"), "gaps": F.size(F.filter("way", lambda w: w["gap"]))})
    begin = F.struct(F.col("es.mx").alias("x"), F.col("es.mz").alias("z"), F.col("fx").alias("fx"), F.col("fz").alias("fz"), F.lit(0).alias("t"), F.lit(0.0).alias("p"))

    def step(turns: Column, s: Column, w: Column) -> Column:
        cmd = F.get(turns, s["t"])
        tx = F.when(cmd.contains("back"), -s["fx"]).when(cmd.contains("left"), -s["fz"]).when(cmd.contains("right"), s["fz"]).otherwise(s["fx"])
        tz = F.when(cmd.contains("back"), -s["fz"]).when(cmd.contains("left"), s["fx"]).when(cmd.contains("right"), -s["fx"]).otherwise(s["fz"])
        dx, dz = w["n"]["x"] - s["x"], w["n"]["z"] - s["z"]
        n = F.sqrt(dx * dx + dz * dz)
        dot = F.round(F.try_divide(tx * dx + tz * dz, n), 9)  # what is square to the way is so for any order of sums
        gain = F.when(F.coalesce(n > 1e-8, F.lit(False)), F.when(dot > 0, dot).otherwise(F.lit(-0.5))).otherwise(F.lit(0.0))
        mx, mz = w["x"] - s["x"], w["z"] - s["z"]
        m = F.sqrt(mx * mx + mz * mz)
        goes = ~w["gap"] & w["x"].isNotNull()
        moved = F.coalesce(goes & (m > 1e-8), F.lit(False))
        pick = lambda gap, go, stay: F.when(w["gap"], gap).when(moved, go).otherwise(stay)
        return F.struct(
            F.when(goes, w["x"]).otherwise(s["x"]).alias("x"), F.when(goes, w["z"]).otherwise(s["z"]).alias("z"), pick(tx, F.try_divide(mx, m), s["fx"]).alias("fx"), pick(tz, F.try_divide(mz, m), s["fz"]).alias("fz"),
            F.when(w["gap"], s["t"] + 1).otherwise(s["t"]).alias("t"), (s["p"] + F.when(w["gap"], gain).otherwise(F.lit(0.0))).alias("p"),
        )

    able = F.col("es").isNotNull() & F.col("ef").isNotNull() & (F.col("fn") >= 1e-8)
    turns = F.transform("options", lambda o: F.transform(F.split(F.lower(Q.content(o)), ","), F.trim))
    state = F.struct(F.col("walk"), begin.alias("begin"), F.col("gaps"), able.alias("able"))
    fold = lambda c, t: F.when(c["able"] & (F.size(t) == c["gaps"]), F.aggregate(c["walk"], c["begin"], lambda s, w: step(t, s, w), lambda s: s["p"]))
    p = _once(state, lambda c: F.transform(turns, lambda t, o: F.struct(fold(c, t).alias("p"), o.alias("o"))))
    best = F.array_max(F.transform(F.filter(p, lambda x: x["p"] > -1), lambda x: F.struct(F.round(x["p"], 9).alias("p"), (-x["o"]).alias("o"))))
    return rows.withColumn("answer", F.coalesce(Q.letter(F.get("options", -best["o"])), F.lit("A")))


def route(q: DataFrame, entities: DataFrame, synonyms=SYNONYMS) -> DataFrame:
    """The option whose turns, where the question has gaps, best face the way along its waypoints."""
    return _answered(q, [(None, _route_read, _route)], entities, None, synonyms).select("qid", "answer")


def answered(q: DataFrame, entities: DataFrame, scale: DataFrame, synonyms=SYNONYMS, *types: str) -> DataFrame:
    """q with answer and score, for questions of all types or of some; rooms' sizes are none of them."""
    kinds = [
        (["object_counting"], _count_read, _count),
        (["object_size_estimation"], _size_read, _size),
        (["object_abs_distance"], _distance_read, _distance),
        (["object_rel_direction_easy", "object_rel_direction_medium", "object_rel_direction_hard"], _direction_read, _direction),
        (["object_rel_distance"], _nearest_read, _nearest),
        (["obj_appearance_order"], _order_read, _order(synonyms)),
        (["route_planning"], _route_read, _route),
    ]
    asked = [([t for t in of if t in types or not types], *k) for of, *k in kinds]
    return _scored(_answered(q, [k for k in asked if k[0]], entities, scale, synonyms))


def _scored(rows: DataFrame) -> DataFrame:
    return rows.withColumn("score", Q.score(F.col("qtype"), F.col("answer"), F.col("ground_truth"), NUMERIC_TASKS))


def answer_all(q: DataFrame, entities: DataFrame, cameras: DataFrame, scale: DataFrame, area: DataFrame, synonyms=SYNONYMS) -> DataFrame:
    """q with answer and score, for questions of all types."""
    return answered(q, entities, scale, synonyms).unionByName(_scored(_room(q.filter("qtype = 'room_size_estimation'"), area)))
