"""Which names mean which labels, by an inverted index: pairs meet by a key that any match must share, and are tested after."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loculus.functions.names import matches, meanings, plain, tokens
from loculus.functions.tables import SYNONYMS

GRAM = 3


def grams(text: Column, k: int) -> Column:
    """The distinct parts of k characters of a text; none where it is shorter."""
    n = F.length(text)
    return F.when(n >= k, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(k))))).otherwise(F.array().cast("array<string>"))


def holding(wholes: DataFrame, parts: DataFrame) -> DataFrame:
    """whole, part: the pairs of texts of which the first holds the second; wholes and parts have a column of distinct texts of that name.

    Every whole is listed under its parts of one to GRAM characters and the empty one. A part looks up one key: of its own grams of
    GRAM characters (of its length, if it is shorter) the one with the fewest wholes, so that texts which only share usual letters
    never meet.
    """
    index = wholes.select("whole", F.explode(F.concat(F.array(F.lit("")), *[grams(F.col("whole"), k) for k in range(1, GRAM + 1)])).alias("gram"))
    often = index.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    text = F.col("part")
    own = F.when(F.length(text) >= GRAM, grams(text, GRAM)).otherwise(F.array(text))
    key = parts.select("part", F.explode(own).alias("gram")).join(often, "gram", "left")
    key = key.groupBy("part").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("gram"))
    return key.join(index, "gram").filter(F.col("whole").contains(text)).select("whole", "part")


def sharing(names: DataFrame, labels: DataFrame, synonyms: dict[str, list[str]] = SYNONYMS) -> DataFrame:
    """name, label: the pairs in which a word of the name, or a synonym of one, is a word of the label."""
    n = names.select("name", F.explode(F.array_distinct(F.concat(tokens(F.col("name")), meanings(F.col("name"), synonyms)))).alias("word"))
    return n.join(labels.select("label", F.explode(F.array_distinct(tokens(F.col("label")))).alias("word")), "word").select("name", "label").distinct()


def name_pairs(names: DataFrame, labels: DataFrame, synonyms: dict[str, list[str]] = SYNONYMS) -> DataFrame:
    """name, label: the distinct names (column name) with the distinct labels (column label) that they match, as functions.names.matches has it.

    Null names and labels match nothing; names that differ in case or spaces around them are looked up once.
    """
    names, labels = (df.select(c, plain(F.col(c)).alias("text")).filter(F.col(c).isNotNull()).distinct() for df, c in ((names, "name"), (labels, "label")))
    n, v = names.select("text").distinct(), labels.select("text").distinct()
    whole, part = (lambda df: df.select(F.col("text").alias("whole"))), (lambda df: df.select(F.col("text").alias("part")))
    found = holding(whole(v), part(n)).select(F.col("part").alias("name"), F.col("whole").alias("label"))
    found = found.unionByName(holding(whole(n), part(v)).select(F.col("whole").alias("name"), F.col("part").alias("label")))
    found = found.unionByName(sharing(n.select(F.col("text").alias("name")), v.select(F.col("text").alias("label")), synonyms)).distinct()
    found = found.filter(matches(F.col("name"), F.col("label"), synonyms)).select(F.col("name").alias("_n"), F.col("label").alias("_l"))
    return names.join(found, F.col("text") == F.col("_n")).select("name", "_l").join(labels, F.col("_l") == F.col("text")).select("name", "label")


def holding_pairs(names: DataFrame, labels: DataFrame, lower_labels: bool = False) -> DataFrame:
    """name, label: the distinct pairs of which one holds the other; names in lower case, labels as they are or in lower case, too."""
    n = names.select("name", F.lower("name").alias("t")).filter("name IS NOT NULL").distinct()
    v = labels.select("label", (F.lower("label") if lower_labels else F.col("label")).alias("l")).filter("label IS NOT NULL").distinct()
    nt, vt = n.select("t").distinct(), v.select("l").distinct()
    found = holding(vt.select(F.col("l").alias("whole")), nt.select(F.col("t").alias("part"))).select(F.col("part").alias("t"), F.col("whole").alias("l"))
    found = found.unionByName(holding(nt.select(F.col("t").alias("whole")), vt.select(F.col("l").alias("part"))).select(F.col("whole").alias("t"), F.col("part").alias("l"))).distinct()
    return n.join(found, "t").join(v, "l").select("name", "label")
