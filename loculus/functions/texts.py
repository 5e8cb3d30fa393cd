"""Texts of models and tools: answers cleaned, replies parsed, hypotheses and prompts written."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a reply's answer may be introduced by.
LEADS = ["answer submitted:", "answer:", "final answer:"]
# What each task's prompt holds.
NEEDS = {
    "object_counting": {"count"},
    "object_abs_distance": {"position"},
    "object_size_estimation": {"size"},
    "room_size_estimation": {"position", "size"},
    "obj_appearance_order": {"frames"},
}


def _some(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def content_of(option: Column) -> Column:
    o = F.trim(option)
    return F.when((F.length(o) >= 3) & F.substring(o, 2, 1).isin(".", "、"), F.trim(F.substring(o, 4, 1000))).otherwise(o)


def clean_answer(raw: Column, options: Column) -> Column:
    """A model's reply as an answer: without options its first number, else 0; with options a letter at its start, at a line's start, the option whose text it holds, its first number, else A."""
    raw = F.trim(raw)
    number = _some(F.regexp_extract(raw, r"[\d.]+", 0))
    head = F.trim(F.substring_index(raw, "\n", 1))
    for lead in LEADS:
        head = F.when(F.lower(head).startswith(lead), F.trim(F.substring(head, F.lit(len(lead) + 1), F.length(head)))).otherwise(head)
    first = F.upper(_some(F.regexp_extract(head, r"^([A-Da-d])", 1)))
    line = F.upper(_some(F.regexp_extract(raw, r"(?m)^\s*([A-Da-d])(?:[.、) ,]|\s*$)", 1)))
    named = F.get(F.filter(F.transform(options, lambda o, i: F.when((content_of(o) != "") & F.lower(raw).contains(F.lower(content_of(o))), F.element_at(F.array(*[F.lit(c) for c in "ABCD"]), i + 1))), lambda x: x.isNotNull()), F.lit(0))
    return F.when(F.coalesce(F.size(options), F.lit(0)) <= 0, F.coalesce(number, F.lit("0"))).otherwise(F.coalesce(first, line, named, number, F.lit("A")))


def reply_answer(reply: Column, options: Column) -> Column:
    """The final answer of a written-out reply, in either script's colon, as a letter where an option or its letter is in it."""
    answer = F.coalesce(*[_some(F.trim(F.regexp_extract(reply, p + r"[：:]\s*(.+?)(?:\n|$)", 1))) for p in ("最终答案", "答案")], F.lit(""))
    hit = F.get(F.filter(F.transform(options, lambda o, i: F.when(F.lower(answer).contains(F.lower(o)) | answer.contains(F.element_at(F.array(*[F.lit(c) for c in "ABCD"]), i + 1)), F.element_at(F.array(*[F.lit(c) for c in "ABCD"]), i + 1))), lambda x: x.isNotNull()), F.lit(0))
    return F.when(answer == "", answer).otherwise(F.coalesce(hit, answer))


def confirmation(reply: Column, label: Column) -> Column:
    """What a look at an object says of it: -0.1 if the reply denies the label, 0.2 if it confirms it, null otherwise."""
    r = F.lower(reply)
    return F.when(r.contains("not") & r.contains(label), -0.1).when(r.contains("yes") | r.contains("存在") | r.contains(label), 0.2)


def missing_names(reply: Column) -> Column:
    """The names that a tool says it has not found, each once."""
    return F.array_distinct(F.regexp_extract_all(reply, F.lit(r"'([^']+)' not found"), F.lit(1)))


def hypothesis(kind: Column, result: Column, options: Column) -> Column:
    """A computation's result in words, for a referee."""
    letter = F.coalesce(_some(F.regexp_extract(result, r"answer=([A-D])", 1)), F.lit("?"))
    detail = F.coalesce(_some(F.trim(F.regexp_extract(result, r"detail=(.*)", 1))), result)
    word = F.coalesce(F.get(F.filter(F.transform(options, lambda o: F.when(F.upper(F.substring(o, 1, 1)) == letter, F.lower(content_of(o)))), lambda x: x.isNotNull()), F.lit(0)), F.lit("?"))
    number = F.coalesce(_some(F.regexp_extract(result, r"answer=([\d.]+)", 1)), F.lit("?"))
    noisy = lambda lead: F.concat(F.lit(lead), letter, F.lit(".\nReasoning: "), F.substring(detail, 1, 250))
    return (
        F.when(kind == "direction", F.concat(F.lit("3D computation (noisy) suggests answer="), letter, F.lit(" ("), word, F.lit(").\nReasoning: "), F.substring(detail, 1, 200)))
        .when(kind == "rel_distance", noisy("3D distance computation (noisy) suggests answer="))
        .when(kind == "appearance_order", noisy("Frame analysis (noisy) suggests answer="))
        .when(kind == "route", noisy("3D route simulation (noisy) suggests answer="))
        .when(kind.isin("distance", "count", "size", "room_size"), F.concat(F.lit("3D computation result: "), number, F.lit(" ("), F.substring(result, 1, 200), F.lit(")")))
        .otherwise(F.concat(F.lit("Computation result: "), F.substring(result, 1, 300)))
    )


def prompt(question: Column, options: Column, names: Column | None = None, frames: Column | None = None, temporal: bool = False) -> Column:
    """A question for a vision-language model: by itself, about chosen frames, or about their order."""
    lead = F.lit("You see a video of an indoor scene.")
    if frames is not None:
        lead = F.format_string("You see %d frames of an indoor scene" + (" in order of time" if temporal else "") + ", chosen for: %s.", frames, F.array_join(names, ", "))
    asked = F.concat(F.lit("\nQuestion: "), question)
    has = F.coalesce(F.size(options), F.lit(0)) > 0
    return F.concat(lead, asked, F.when(has, F.concat(F.lit("\nOptions:\n"), F.array_join(options, "\n"), F.lit("\nAnswer with the letter alone."))).otherwise("\nAnswer with one number."))


def entity_lines(task: Column) -> Column:
    """An entity's lines in a task's prompt: count, place, size or frames, as the task needs; all for a task not listed."""

    def needs(what: str) -> Column:
        tasks = [t for t, w in NEEDS.items() if what in w]
        return task.isin(tasks) | ~task.isin(list(NEEDS))

    return F.concat_ws(
        "\n",
        F.format_string("- %s:", "label"),
        F.when(needs("count"), F.format_string("  count: %d", "count_in_frame")),
        F.when(needs("position"), F.format_string("  position (x,y,z): (%.2f, %.2f, %.2f) m", "mx", "my", "mz")),
        F.when(needs("size"), F.format_string("  size (w,h,d): (%.2f, %.2f, %.2f) m", "w3", "h3", "d3")),
        F.when(needs("frames"), F.format_string("  first frame: %d", "first_seen")),
    )


def exact_match(pred: Column, truth: Column) -> Column:
    return (F.lower(F.trim(pred)) == F.lower(F.trim(truth))).cast("double")


def within(pred: Column, truth: Column, bound: float = 0.1) -> Column:
    """1 where the relative error is no more than the bound, else 0; a truth of 0 wants 0."""
    return F.when(truth == 0, (pred == 0).cast("double")).otherwise((F.try_divide(F.abs(pred - truth), F.abs(truth)) <= bound).cast("double"))
