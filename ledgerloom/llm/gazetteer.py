"""Towns and postcodes of a table of parsed addresses, to fill the part an address lacks and to mend misspelt towns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.spelling import one_edit, shortened
from ledgerloom.session import Stash, salted_join


def town_spellings(places: DataFrame, times: int = 3) -> DataFrame:
    """``(town, mended)`` for towns one edit from a town at least ``times`` as frequent, the most frequent of those."""
    counts = places.where("town <> ''").groupBy("town").agg(F.count("*").alias("n"))
    keys = counts.where("length(town) >= 5").withColumn("k", F.explode(shortened(F.col("town"))))
    a, b = keys.alias("a"), keys.alias("b")
    near = a.join(b, (F.col("a.k") == F.col("b.k")) & (F.col("b.n") >= times * F.col("a.n")) & one_edit(F.col("a.town"), F.col("b.town")))
    return near.groupBy(F.col("a.town").alias("town")).agg(F.max_by(F.col("b.town"), F.struct(F.col("b.n"), F.col("b.town"))).alias("mended"))


def town_of_postcode(places: DataFrame) -> DataFrame:
    """``(postcode, code_town)``: the town most often recorded with a postcode."""
    counts = places.where("town <> '' and postcode <> ''").groupBy("postcode", "town").agg(F.count("*").alias("n"))
    return counts.groupBy("postcode").agg(F.max_by("town", F.struct("n", "town")).alias("code_town"))


def complete_places(rows: DataFrame, known: DataFrame, stash: Stash) -> DataFrame:
    """``rows`` with misspelt towns mended and missing ones filled from the postcode, as ``known`` has them.

    A town is first mended to that of its postcode if one edit away (two for long names that begin alike), else to a much
    more frequent spelling.
    """
    spelt = stash.put(town_spellings(known))
    mended = salted_join(known.select("town", "postcode"), spelt, "town").select(F.coalesce("mended", "town").alias("town"), "postcode")
    codes = stash.put(town_of_postcode(mended))
    both = salted_join(salted_join(rows, codes, "postcode"), spelt, "town")
    turned = F.regexp_replace("town", r"^(.*) (\S+)$", "$2 $1")  # a misspelt direction left at the end
    close = one_edit(F.col("town"), F.col("code_town")) | one_edit(turned, F.col("code_town")) | ((F.levenshtein("town", "code_town") <= 2) & (F.length("town") >= 7) & (
        F.left("town", F.lit(1)) == F.left("code_town", F.lit(1))))
    town = F.when(F.col("town") == "", F.coalesce("code_town", F.lit(""))).when(
        close, F.col("code_town")).otherwise(F.coalesce("mended", "town"))
    return both.withColumn("town", town).drop("code_town", "mended")
