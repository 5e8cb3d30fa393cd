"""What a question asks, read off its text by native regular expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from loculus.functions.tables import TASK_PATTERNS

# How questions are worded. Each list is tried in order.
COUNT = [r"(?i)How many (\w+(?:\s+\w+)*?)(?:\(s\)|\(es\))?\s+(?:are|is|do|does|can)", r"(?i)How many (\w+)"]
SIZE = [r"(?:size|height|length|width|dimension).*?(?:of|for)\s+(?:the\s+)?(.+?)[\?\.]", r"of the (\w+)"]
BETWEEN = [
    r"distance between (?:the )?(.+?)\s+and\s+(?:the )?(.+?)[\s\(]",
    r"distance between (?:the )?(.+?)\s+and\s+(?:the )?(.+?)[\?\.]",
    r"from (?:the )?(\w+(?:\s+\w+)*) to (?:the )?(\w+(?:\s+\w+)*)",
    r"between (?:the )?(\w+) and (?:the )?(\w+)",
]
STANDING = [
    r"standing by (?:the )?(.+?)\s+and\s+facing (?:the )?(.+?),\s*is (?:the )?(.+?)\s+to\s",
    r"standing by (?:the )?(.+?)\s+and\s+facing (?:the )?(.+?),.*?(?:is|are)\s+(?:the )?(.+?)\s+(?:to|on)\s",
]
NEAREST = [r"(?:closest|nearest|farthest|furthest)\s+(?:to|from)\s+(?:the\s+)?(.+?)[\?\.]"]
ORDER = [r"(?i)following categories.*?:\s*(.+?)\?"]
ROUTE = [r"beginning at (?:the )?(.+?)\s+(?:and\s+)?facing (?:the )?(.+?)\."]
NAMES = [
    (r"standing by (?:the )?(.+?)\s+and\s+facing (?:the )?(.+?),.*?(?:is|are)\s+(?:the )?(.+?)\s+(?:to|on)\s", 3),
    (r"distance between (?:the )?(.+?)\s+and\s+(?:the )?(.+?)[\s\?\.]", 2),
    (r"from (?:the )?(\w+(?:\s+\w+)*?) to (?:the )?(\w+(?:\s+\w+)*)", 2),
    (r"how (?:big|large|tall|long|wide) (?:is|are) (?:the )?(.+?)[\?\.]", 1),
    (r"how many (.+?)(?:\s+are|\s+in|\s+do|\?)", 1),
    (r"size of (?:the )?(.+?)[\?\s]", 1),
    (r"closest to (?:the )?(.+?)[\?\s]", 1),
    (r"farthest from (?:the )?(.+?)[\?\s]", 1),
]
NO_NAMES = ["left", "right", "behind", "front", "back", "front-left", "front-right", "back-left", "back-right", "yes", "no"]
# Keywords of each computation, tried in this order.
COMPUTATIONS = [
    ("distance", r"distance between|how far|meters apart|measuring from the closest point"),
    ("robot_route", r"navigate|route|walk from|go from"),
    ("direction", r"standing by|facing|to the left|to the right|to my"),
    ("count", r"how many|count|number of"),
    ("room_size", r"room size|floor area|square meter|area of the room|size of the room|big is the room"),
    ("size", r"how big|how large|how tall|how long|how wide|size of"),
    ("appearance_order", r"appear first|appears first|seen first"),
    ("route", r"route|path|navigate|walk from|go from|turn"),
]


def groups(text: Column, patterns: list[str], n: int) -> list[Column]:
    """The n groups of the first pattern found in the text, trimmed; null if none is."""
    out = []
    for k in range(1, n + 1):
        c = F.when(text.rlike(patterns[0]), F.trim(F.regexp_extract(text, patterns[0], k)))
        for p in patterns[1:]:
            c = c.when(text.rlike(p), F.trim(F.regexp_extract(text, p, k)))
        out.append(c)
    return out


def letter(option: Column) -> Column:
    return F.substring(option, 1, 1)


def content(option: Column) -> Column:
    return F.trim(F.regexp_replace(option, r"^[A-D]\.\s*", ""))


def question_names(question: Column, options: Column) -> Column:
    """The names that a question mentions, in order, each once."""
    q = F.lower(question)
    found = [F.when(q.rlike(p), F.trim(F.regexp_extract(q, p, k))) for p, n in NAMES for k in range(1, n + 1)]
    opts = F.transform(F.filter(F.coalesce(options, F.array().cast("array<string>")), lambda o: (F.length(F.trim(o)) >= 3) & F.substring(F.trim(o), 2, 1).isin(".", "、")), lambda o: F.lower(F.trim(F.substring(F.trim(o), 4, 1000))))
    opts = F.filter(opts, lambda c: (c != "") & ~c.isin(NO_NAMES) & ~F.replace(c, F.lit("."), F.lit("")).rlike(r"^\d+$"))
    return F.array_distinct(F.filter(F.concat(F.array(*found), opts), lambda c: c.isNotNull() & (c != "")))


def computation(question: Column, options: Column) -> Column:
    q = F.lower(question)
    has = F.coalesce(F.size(options) > 0, F.lit(False))
    out = None
    for name, words in COMPUTATIONS:
        hit = q.rlike(words)
        value = F.lit(name)
        if name == "distance":
            value = F.when(has, F.lit("rel_distance")).otherwise(F.lit("distance"))
        if name == "robot_route":
            hit, value = hit & q.contains("robot"), F.lit("route")
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def is_temporal(question: Column) -> Column:
    return F.lower(question).rlike(r"appear first|appears first|appearance order|seen first|first-time appearance|show up first")


def task_kind(task: Column, choice: list[str], numeric: list[str]) -> Column:
    return F.when(task.isin(choice), "choice").when(task.isin(numeric), "numeric").otherwise("other")


def first_number(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"[-+]?\d*\.?\d+", 0), F.lit("")).cast("double")


def relative_accuracy(pred: Column, truth: Column) -> Column:
    """The share of the ten bounds 0.95, 0.90, ... 0.50 that the relative error stays below; a truth of 0 wants 0."""
    rel = F.abs(pred - truth) / (F.abs(truth) + 1e-8)
    hits = F.size(F.filter(F.sequence(F.lit(0), F.lit(9)), lambda i: rel < 1 - (0.05 + i * 0.05)))
    return F.when(truth == 0, F.when(pred == 0, 1.0).otherwise(0.0)).otherwise(hits / 10.0)


def score(task: Column, pred: Column, truth: Column, numeric: list[str]) -> Column:
    """Numeric tasks by relative accuracy of the first number in each text, others by their first letter; what is no number scores 0, an empty text is the number 0."""
    num = lambda c: F.when(F.coalesce(c, F.lit("")) == "", F.lit(0.0)).otherwise(first_number(c))
    first = lambda c: F.substring(F.upper(F.trim(F.coalesce(c, F.lit("")))), 1, 1)
    return F.when(task.isin(numeric), F.coalesce(relative_accuracy(num(pred), num(truth)), F.lit(0.0))).otherwise((first(pred) == first(truth)).cast("double"))


def answer_letter(raw: Column) -> Column:
    """The letter of a model's answer: a letter alone, one after "answer", else the first letter A to D on its own."""
    t = F.upper(F.trim(raw))
    return F.coalesce(*[F.nullif(F.regexp_extract(t, p, 1), F.lit("")) for p in (r"^([A-D])(?:[\.\):\s]|$)", r"ANSWER(?: IS)?[:\s]*\(?([A-D])\b", r"\b([A-D])\b")])


def frame_spec(spec: Column) -> Column:
    """"3,5-8" as [3, 5, 6, 7, 8]."""
    part = lambda p: F.when(p.rlike(r"^\s*\d+\s*-\s*\d+\s*$"), F.sequence(F.trim(F.split_part(p, F.lit("-"), F.lit(1))).cast("int"), F.trim(F.split_part(p, F.lit("-"), F.lit(2))).cast("int"))).when(p.rlike(r"^\s*\d+\s*$"), F.array(F.trim(p).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.flatten(F.transform(F.split(spec, ","), part)))


def task_of(question: Column, given: Column, patterns=TASK_PATTERNS) -> Column:
    """The question's type: the given one where it is known, else the first with a pattern in the question, else the first of all."""
    q = F.lower(question)
    out = F.lit(patterns[0][0])
    for task, found in reversed(patterns):
        out = F.when(reduce(lambda a, b: a | b, [q.rlike(p) for p in found]), F.lit(task)).otherwise(out)
    return F.when(given.isin([t for t, _ in patterns]), given).otherwise(out)
