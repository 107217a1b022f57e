"""Many names found inside many texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.plans.stored import small, stored

c = F.col
GRAM = 4


def grams(names: DataFrame) -> DataFrame:
    """name, gram, at and size of every gram of the names. Grams of a name have the largest power of two of
    characters that it holds, so those of long names are as rare as the names."""
    size = F.pow(F.lit(2), F.floor(F.log2(F.length("name").cast("double")) + 1e-9)).cast("int")
    rows = names.where("length(name) > 0").withColumn("size", size).withColumn("at", F.explode(F.sequence(F.lit(0), F.length("name") - size)))
    return rows.select("name", F.substring("name", c("at") + 1, c("size")).alias("gram"), "at", "size")


def found_in(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(id, name, start) of every place of a text (id, text) at which a name begins; names are distinct.

    A name is looked up by its gram that fewest names have, so names that begin alike don't meet each other's texts. Texts
    first meet the heads of these grams, GRAM characters at most, which are few however many names there are: what goes
    on are the places where a gram may begin. These meet names by an equi-join on grams, and what meets is compared whole.
    """
    every = stored(grams(names.select("name").distinct()), "grams")
    rare = every.join(every.groupBy("gram").agg(F.count("*").alias("many")), "gram")
    keys = rare.groupBy("name").agg(F.min(F.struct("many", "at", "gram", "size")).alias("key")).select("name", "key.gram", c("key.at").alias("back"), c("key.size").alias("size"))
    keys = stored(keys.withColumn("head", F.substring("gram", 1, GRAM)), "gram-keys")
    heads = keys.groupBy("head").agg(F.collect_set("size").alias("sizes"))
    widths = sorted(r[0] for r in keys.select(F.length("head")).distinct().collect())  # GRAM at most

    def of(n: int) -> Column:
        starts = F.when(F.length("text") >= n, F.sequence(F.lit(1), F.length("text") - n + 1))
        return F.coalesce(F.transform(starts, lambda i: F.struct(F.substring("text", i, n).alias("head"), i.alias("i"))), F.array())

    cut = F.flatten(F.array(*[of(n) for n in widths or [GRAM]]))
    begun = texts.select("id", "text", F.inline(cut)).join(small(heads, 100_000), "head").withColumn("size", F.explode("sizes"))
    met = begun.select("id", "text", "i", F.substring("text", c("i"), c("size")).alias("gram")).join(small(keys.drop("head", "size"), 100_000), "gram")
    start = c("i") - c("back")
    return met.where((start >= 1) & (F.substring("text", start, F.length("name")) == c("name"))).select("id", "name", start.alias("start"))


def longest_in(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(id, name): the longest name inside each text that holds any; of equally long ones the first in the text."""
    rank = F.struct(-F.length("name"), "start", "name")
    return found_in(texts, names).groupBy("id").agg(F.min_by("name", rank).alias("name"))
