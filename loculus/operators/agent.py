"""The agent's loop over all questions at once: answer, criticise the scene, look at what is doubtful again, answer anew."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loculus.functions.tables import SYNONYMS
from loculus.functions.texts import confirmation
from loculus.operators import family_answers as A
from loculus.operators.relations import spatial_conflicts
from loculus.session import cut

THRESHOLD, ROUNDS = 0.4, 2
#: What a covariance is multiplied by where a check failed, and where a look at the frame said something of the object.
DOUBT, SEEN = 1.2, 0.8
# Sizes in metres and areas in square metres beyond which an answer or an entity can't be.
SIZES, AREAS = (0.01, 5.0), (4.0, 200.0)


def in_conflict(entities: DataFrame) -> DataFrame:
    """scene, label: the entities that stand in each other. Rounds move and resize nothing, so this holds for all of them."""
    pairs = spatial_conflicts(entities.withColumnsRenamed({"w_mean": "w3", "h_mean": "h3"}))
    return pairs.select("scene", F.explode(F.array("a_label", "b_label")).alias("label")).distinct()


def doubtful(entities: DataFrame, threshold: float = THRESHOLD, conflicts: DataFrame | None = None) -> DataFrame:
    """scene, label, low: the entities to look at again, those whose place is not sure (low) or which stand in each other; conflicts: what in_conflict gave for them."""
    low = entities.filter(F.col("position_confidence") < threshold).select("scene", "label", F.lit(True).alias("low"))
    both = (in_conflict(entities) if conflicts is None else conflicts).withColumn("low", F.lit(False))
    return low.unionByName(both).groupBy("scene", "label").agg(F.max("low").alias("low"))


def reconsidered(entities: DataFrame, rows: DataFrame, factor: Column) -> DataFrame:
    """Entities with the covariance of those in rows (scene, label) multiplied, and so with another sigma and confidence of place."""
    k = rows.select("scene", "label", F.sqrt(factor).alias("_k"))
    e = entities.join(k, ["scene", "label"], "left").withColumn("sigma", F.col("sigma") * F.coalesce("_k", F.lit(1.0))).drop("_k")
    return e.withColumn("position_confidence", 1 / (1 + F.col("sigma")))


def agent_state(entities: DataFrame, rounds: int = ROUNDS, threshold: float = THRESHOLD, replies: DataFrame | None = None, conflicts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Entities after the rounds, and of each scene how many rounds began and whether one changed anything: scene, rounds, evolved.

    A round begins where something is doubtful. Without replies, places that are not sure become less so; that is a correction, and
    the next round begins. Where nothing was corrected the loop ends. replies: scene, label, text of a look at the frame where an
    entity was first seen; an entity of which the reply says something becomes surer, but that corrects no answer, so it ends the loop.
    Rounds change entities alone, which questions of a scene share, so there is one state a scene.
    """
    entities = cut(entities)
    conflicts = cut(in_conflict(entities)) if conflicts is None else conflicts
    state = entities.select("scene").distinct().select("scene", F.lit(0).alias("rounds"), F.lit(False).alias("evolved"), F.lit(True).alias("open"))
    for _ in range(rounds):
        look = cut(doubtful(entities, threshold, conflicts).join(state.filter("open").select("scene"), "scene", "left_semi"))
        began = look.groupBy("scene").agg(F.max("low").alias("low"))
        if replies is None:
            entities, corrected = reconsidered(entities, look.filter("low"), F.lit(DOUBT)), F.coalesce("low", F.lit(False))
        else:
            seen = look.join(replies.select("scene", "label", "text"), ["scene", "label"]).filter(confirmation(F.col("text"), F.col("label")).isNotNull()).select("scene", "label").distinct()
            entities, corrected = reconsidered(entities, seen, F.lit(SEEN)), F.lit(False)
        entities = cut(entities)
        state = state.join(began, "scene", "left").select("scene", (F.col("rounds") + F.col("low").isNotNull().cast("int")).alias("rounds"), (F.col("evolved") | corrected).alias("evolved"), (F.col("open") & corrected).alias("open"))
        state = cut(state)
    return entities, state.drop("open")


def answers(questions: DataFrame, entities: DataFrame, synonyms=SYNONYMS) -> DataFrame:
    """qid, answer, sure by the plain rules for each type; questions: qid, scene, qtype, question, options."""
    q = lambda *types: questions.filter(F.col("qtype").isin(*types))
    kinds = [
        A.agent_counting(q("object_counting"), entities, synonyms), A.object_size(q("object_size_estimation"), entities, synonyms), A.room_size(q("room_size_estimation"), entities),
        A.agent_distance(q("object_abs_distance"), entities), A.agent_direction(q(*[f"object_rel_direction_{k}" for k in ("easy", "medium", "hard")]), entities),
        A.agent_rel_distance(q("object_rel_distance"), entities), A.agent_order(q("obj_appearance_order"), entities), A.agent_route(q("route_planning"), entities),
    ]
    return reduce(DataFrame.unionByName, [k.select("qid", "answer", F.col("sure").cast("double").alias("sure")) for k in kinds])


def agent_loop(questions: DataFrame, entities: DataFrame, rounds: int = ROUNDS, threshold: float = THRESHOLD, synonyms=SYNONYMS, replies: DataFrame | None = None) -> DataFrame:
    """qid, answer, sure, rounds, evolved, verdict of every question over its scene's entities (of the filtered family), after at most `rounds` rounds.

    verdict is the critic's last word: re_observe where something in the scene is still doubtful, else logic_error where an entity or
    the answer, as a number, is of a size that can't be, else pass. A scene without entities gets a usual answer at 0.1 and no verdict.
    Answers depend on the scene alone, so they are made once, over what the rounds left; a loop that a reply ended keeps those of before.
    """
    entities = cut(entities)
    conflicts = cut(in_conflict(entities))
    after, state = agent_state(entities, rounds, threshold, replies, conflicts)
    found = answers(questions, after if replies is None else entities, synonyms)
    left = doubtful(after, threshold, conflicts).select("scene").distinct().withColumn("_left", F.lit(True))
    size = F.greatest("w_mean", "h_mean", F.lit(0.3))
    odd = after.groupBy("scene").agg(F.max((size > SIZES[1]) | (size < SIZES[0])).alias("_odd"))
    usual = A.default_answer(F.col("qtype"), F.col("options")).alias("_usual")  # the texts of options go no further
    q = questions.select("qid", "scene", usual).join(state, "scene", "left").join(left, "scene", "left").join(odd, "scene", "left").join(found, "qid", "left")
    number = F.col("answer").try_cast("double")
    wrong = F.coalesce("_odd", F.lit(False)) | F.coalesce((number > AREAS[1]) | ((number > 0) & (number < AREAS[0])), F.lit(False))
    there = F.col("rounds").isNotNull()
    verdict = F.when(F.col("_left"), "re_observe").when(wrong, "logic_error").otherwise("pass")
    return q.select(
        "qid", F.when(there, F.col("answer")).otherwise(F.col("_usual")).alias("answer"), F.when(there, F.col("sure")).otherwise(F.lit(0.1)).alias("sure"),
        F.coalesce("rounds", F.lit(0)).alias("rounds"), F.coalesce("evolved", F.lit(False)).alias("evolved"), F.when(there, verdict).alias("verdict"),
    )
