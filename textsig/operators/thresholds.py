"""Data-derived cut-offs of lists of numbers in descending order, one list for each group.

All are window functions over the distinct values of each group: how many of a group's largest values to keep, by entropy, by the steepest ratio
of neighbours, by the elbow under the chord, by scaled median mass, and adaptively (the elbow, or else scaled median mass).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SIGNIFICANCE, FACTOR, MIN_GAP, EPSILON = 0.01, 2.2, 1.5, 1e-10


def _runs(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, v, m (rows with that value), i, to (places from, up to), earlier (value), mass (sum before), n, y0, yn, total: a row for each distinct
    value, so that a group's window holds its distinct values and not its rows."""
    order, whole = Window.partitionBy(*keys).orderBy(F.col("v").desc()), Window.partitionBy(*keys)
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    r = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("v")).groupBy(*keys, "v").agg(F.count("*").alias("m"))
    r = r.withColumn("to", F.sum("m").over(running)).withColumn("mass", F.sum(F.col("v") * F.col("m")).over(running) - F.col("v") * F.col("m"))
    return r.select(*keys, "v", "m", (F.col("to") - F.col("m")).alias("i"), "to", F.lag("v").over(order).alias("earlier"), "mass", F.sum("m").over(whole).alias("n"), F.max("v").over(whole).alias("y0"), F.min("v").over(whole).alias("yn"), F.sum(F.col("v") * F.col("m")).over(whole).alias("total"))


def cut_offs(df: DataFrame, keys: list[str], value: str, significance: float = SIGNIFICANCE, factor: float = FACTOR, min_gap: float = MIN_GAP, eps: float = EPSILON, max_cut: int | None = None) -> DataFrame:
    """keys, n, entropy, gap_ratio, elbow, scaled_mm, adaptive (numbers of values kept) and, for the first, second and last of these, the first value
    not kept, or 0: entropy_threshold, gap_threshold, adaptive_threshold. With max_cut, entropy and gap_ratio look at the first max_cut values alone."""
    r = _runs(df, keys, value)
    cap = F.col("n") if max_cut is None else F.least(F.lit(max(max_cut, 1)), F.col("n"))
    seen = F.greatest(F.least("to", cap) - F.col("i"), F.lit(0))  # rows of a run that entropy looks at
    interior = F.greatest("i", F.lit(1))  # within a run of equal values the chord is highest at the first place
    chord = F.col("y0") + (interior / F.greatest(F.col("n") - 1, F.lit(1))) * (F.col("yn") - F.col("y0")) - F.col("v")
    chord = F.when((interior < F.least("to", F.col("n") - 1)) & (chord > 0), chord)
    gap = F.when((F.col("i") > 0) & (F.col("i") < cap) & (F.col("earlier") > eps), F.when(F.col("v") <= 0, F.lit(float("inf"))).otherwise(F.try_divide("earlier", "v")))
    half = F.col("total") * 0.5 - F.col("mass")
    mm = F.when(half <= F.col("v") * F.col("m"), F.col("i") + F.greatest(F.ceil(F.try_divide(half, "v")), F.lit(1)))
    holds = lambda place: (F.col("i") <= F.floor(place)) & (F.floor(place) < F.col("to"))
    positive = F.when(F.col("v") > 0, F.col("v"))
    a = r.groupBy(*keys).agg(
        F.max("n").alias("n"), F.max("y0").alias("y0"), F.max("yn").alias("yn"), F.max("total").alias("total"),
        (0.5 * (F.max(F.when(holds((F.col("n") - 1) / 2), F.col("v"))) + F.max(F.when(holds(F.col("n") / 2), F.col("v"))))).alias("median"),
        F.max(F.when(chord.isNotNull(), F.struct(chord.alias("d"), (-interior).alias("i")))).alias("elbow"),
        F.min(mm).alias("mm"),
        F.max(F.when(gap.isNotNull(), F.struct(gap.alias("g"), (-F.col("i")).alias("i")))).alias("gap"),
        F.sum(F.when(F.col("v") > eps, F.col("m")).otherwise(0)).alias("over"), F.sum(F.when(F.col("v") > 0, seen).otherwise(0)).alias("l"), F.sum(positive * seen).alias("s"), F.sum(-positive * F.log(positive) * seen).alias("h"),
    )
    n = F.col("n")
    elbow = F.when((n < 3) | (F.col("y0") - F.col("yn") <= 1e-12) | F.col("elbow").isNull() | (F.col("elbow.d") < significance * F.col("median")), n).otherwise(-F.col("elbow.i"))
    scaled = F.when(F.col("total") <= 0, n).otherwise(F.least(F.ceil(factor * F.coalesce("mm", n)), n))
    cut = F.when(F.col("gap").isNull() | (F.col("gap.g") < min_gap), cap).otherwise(-F.col("gap.i"))
    gaps = F.when(n < 2, n).otherwise(F.greatest(F.least(cut, cap, F.col("over") + 1), F.lit(1)))
    spread = F.round(F.exp(F.log("s") + F.col("h") / F.col("s")), 9)
    entropy = F.when(F.col("l") == 0, 0).when(spread <= 1, 1).otherwise(F.least(F.ceil(spread), F.col("l")))
    a = a.select(*keys, *[c.cast("long").alias(name) for name, c in (("n", n), ("entropy", entropy), ("gap_ratio", gaps), ("elbow", elbow), ("scaled_mm", scaled))])
    a = a.withColumn("adaptive", F.when(F.col("elbow") < F.col("n"), F.col("elbow")).otherwise(F.col("scaled_mm")))
    names = {"entropy": "entropy_threshold", "gap_ratio": "gap_threshold", "adaptive": "adaptive_threshold"}
    first = [F.max(F.when((F.col("i") <= F.col(k)) & (F.col(k) < F.col("to")), F.col("v"))).alias(t) for k, t in names.items()]
    some = F.broadcast(a.select(*keys, *names))  # a row for each group
    there = r.join(some, keys).groupBy(*keys).agg(*first) if keys else r.crossJoin(some).agg(*first)
    out = a.join(there, keys, "left") if keys else a.crossJoin(there)
    return out.na.fill(0.0, list(names.values()))


def kept(df: DataFrame, keys: list[str], value: str, tie: str, **parameters) -> DataFrame:
    """The rows that the adaptive cut-off keeps, with their rank from 1; ties of the value in order of `tie`."""
    cut = F.broadcast(cut_offs(df, keys, value, **parameters).select(*keys, F.col("n").alias("n_cut"), "adaptive", "adaptive_threshold"))  # a row for each group
    joined = df.join(cut, keys) if keys else df.crossJoin(cut)
    order = Window.partitionBy(*keys).orderBy(F.col(value).desc(), F.col(tie))
    # only what may stay is ranked: all above the first value not kept, and its equals
    some = joined.where((F.col("adaptive") >= F.col("n_cut")) | (F.col(value) >= F.col("adaptive_threshold")))
    return some.withColumn("rank", F.row_number().over(order)).where("rank <= adaptive").drop("n_cut", "adaptive", "adaptive_threshold")
