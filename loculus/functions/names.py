"""Fuzzy object names as native boolean columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loculus.functions.tables import SYNONYMS


def tokens(name: Column) -> Column:
    """Words of a name, parted by white space, _ and -."""
    return F.filter(F.split(F.translate(name, "_-", "  "), r"\s+"), lambda w: w != "")


def plain(name: Column) -> Column:
    """A name as it is compared: in lower case, without spaces around it."""
    return F.lower(F.trim(name))


def meanings(name: Column, synonyms: dict[str, list[str]] = SYNONYMS) -> Column:
    """The synonyms of a name's words, as an array."""
    table = F.create_map(*[x for k, v in synonyms.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.flatten(F.transform(tokens(name), lambda w: F.coalesce(F.try_element_at(table, w), F.array().cast("array<string>"))))


def matches(target: Column, label: Column, synonyms: dict[str, list[str]] = SYNONYMS) -> Column:
    """Whether a label means the target: equal, one within the other, a word in common, or a word's synonym.

    Synonyms go from single words to single words. The empty target matches every label.
    """
    t, label = plain(target), plain(label)
    tw, lw = tokens(t), tokens(label)
    return label.contains(t) | t.contains(label) | F.coalesce(F.arrays_overlap(tw, lw), F.lit(False)) | F.coalesce(F.arrays_overlap(meanings(t, synonyms), lw), F.lit(False))


def singulars(target: Column) -> Column:
    """What a plural is looked up as, in turn: itself, without all final s, and without a final es where it is longer than three letters."""
    one = F.regexp_replace(target, "s+$", "")
    two = F.when(target.endswith("es") & (F.length(target) > 3), F.substring(target, F.lit(1), F.length(target) - 2)).otherwise(one)
    return F.array_distinct(F.array(target, one, two))
