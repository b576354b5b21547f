"""How well bags of parts tell words apart: collisions, sizes of bags, the largest groups of words of one bag, under the four orders of a dictionary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import ranked, written
from . import dictionary

TOP, SHOWN = 20, 8
PERCENTILES = (50, 90, 99)


def collisions(words: DataFrame, keys: list[str]) -> DataFrame:
    """keys, words, bags, colliding_bags, colliding_words, rate (per cent of the words whose bag another word has). words: keys, bag; those with an empty bag
    are left out."""
    bags = words.where("size(bag) > 0").groupBy(*keys, "bag").agg(F.count("*").alias("k"))
    several = F.col("k") > 1
    out = bags.groupBy(*keys).agg(F.coalesce(F.sum("k"), F.lit(0)).alias("words"), F.count("*").alias("bags"), F.count_if(several).alias("colliding_bags"), F.coalesce(F.sum(F.when(several, F.col("k"))), F.lit(0)).alias("colliding_words"))
    return out.withColumn("rate", F.coalesce(F.round(100 * F.col("colliding_words") / F.nullif("words", F.lit(0)), 6), F.lit(0.0)))


def sizes(words: DataFrame) -> DataFrame:
    """words, least, mean, p50, p90, p99, most: the numbers of parts in words' bags that aren't empty. A percentile p of n words is the value at place floor(p * n) from 0,
    the last at most, in ascending order; found from the distinct sizes."""
    k = written(words.where("size(bag) > 0").groupBy(F.size("bag").alias("size")).agg(F.count("*").alias("m")), "sizes")
    n = F.col("n")
    up_to = k.select(F.col("size").alias("s"), F.col("m").alias("k"))
    held = k.join(up_to, F.col("s") <= F.col("size")).groupBy("size", "m").agg(F.sum("k").alias("to")).crossJoin(k.agg(F.sum("m").alias("n")))  # a row for each size
    at = lambda p: F.min(F.when(F.col("to") > F.least(F.floor(F.lit(p) * n / 100), n - 1), F.col("size"))).alias(f"p{p}")
    return held.agg(F.max("n").alias("words"), F.min("size").alias("least"), F.round(F.sum(F.col("size") * F.col("m")) / F.sum("m"), 6).alias("mean"), *[at(p) for p in PERCENTILES], F.max("size").alias("most")).where("words > 0")


def largest(words: DataFrame, top: int = TOP, shown: int = SHOWN) -> DataFrame:
    """rank, bag, k, words: the `top` largest groups of words of one bag, of equals the first by their bags as text; the first `shown` words of each."""
    order = [F.col("k").desc(), F.array_join("bag", ",")]
    groups = words.where("size(bag) > 0").groupBy("bag").agg(F.count("*").alias("k")).where("k > 1").orderBy(*order).limit(top)  # a report
    groups = ranked(written(groups, "largest"), *order)
    own = words.join(F.broadcast(groups.select("bag")), "bag")  # `top` rows
    w = dictionary.first_of(own, "bag", "value", shown)
    return groups.join(w, "bag").select("rank", "bag", "k", "words")


def strategies(words: DataFrame, parts: DataFrame) -> DataFrame:
    """strategy, words, bags, colliding_bags, colliding_words, rate: collisions under a dictionary's own order and the three others."""
    every = [(by, parts if by == "original" else written(dictionary.reordered(parts, by), "reordered")) for by in ("original", "type", "type_level", "level_type")]
    return reduce(DataFrame.unionByName, [collisions(dictionary.decomposed(words, p).withColumn("strategy", F.lit(by)), ["strategy"]) for by, p in every])


def hashed(bag: list[int]) -> int:
    """FNV-1a of a bag's ids, four bytes each from the lowest, as an unsigned 64-bit number."""
    h = 0xCBF29CE484222325
    for i in bag:
        for byte in int(i).to_bytes(4, "little"):
            h = ((h ^ byte) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return h
