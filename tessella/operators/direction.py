"""Directions in vector space: within-case stance differences, semantic axes, scores along them.

A labelled member is (id, case, opinion, s, v) with s of 1 or -1. The direction is the mean,
over cases with both signs, of half the difference of the signs' mean vectors. Leaving a
case out needs no new fit: its difference is taken from the total.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.stats import shuffled
from tessella.functions.vectors import angle, dot, mean_vector, minus, plus, sum_vector, times, unit
from tessella.operators.affinity import side_means
from tessella.operators.inference import auc


def with_labels(members: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """Members with a stance s of 1 or -1; those without a label, or with a null one, are left out."""
    known = labels.where(F.col("label").isNotNull()).select(*keys, F.when(F.col("label") == 1, 1).otherwise(-1).alias("s"))
    return members.join(known, keys)


def differences(labelled: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, case, d): each two-sided case's mean vector of 1 less that of -1."""
    keys = [*(keys or []), "case"]
    means = labelled.groupBy(*keys, "s").agg(mean_vector(F.col("v")).alias("m"))
    return _two_sided(means, keys)


def _two_sided(means: DataFrame, keys: list[str]) -> DataFrame:
    sides = means.groupBy(*keys).agg(*[F.first(F.when(F.col("s") == s, F.col("m")), True).alias(n) for s, n in ((1, "_p"), (-1, "_n"))])
    return sides.where(F.col("_p").isNotNull() & F.col("_n").isNotNull()).select(*keys, minus(F.col("_p"), F.col("_n")).alias("d"))


def fit(diffs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, delta, n): the direction of all cases, at length one, and how many cases made it."""
    return diffs.groupBy(*(keys or [])).agg(unit(sum_vector(F.col("d"))).alias("delta"), F.count("*").alias("n"))


def leave_one_out(labelled: DataFrame, diffs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, case, delta): for each labelled case, the direction of all other cases.

    A one-sided case has no difference to take out. Cases that leave none to fit on have no row.
    """
    keys = keys or []
    totals = diffs.groupBy(*keys).agg(sum_vector(F.col("d")).alias("_t"), F.count("*").alias("_n"))
    cases = labelled.select(*keys, "case").distinct()
    own = cases.join(diffs, [*keys, "case"], "left")
    joined = own.join(totals, keys) if keys else own.select("*", *[totals.select(c).scalar().alias(c) for c in ("_t", "_n")])
    left = F.col("_n") - F.col("d").isNotNull().cast("int")
    rest = F.when(F.col("d").isNull(), F.col("_t")).otherwise(minus(F.col("_t"), F.col("d")))
    return joined.where(left > 0).select(*keys, "case", unit(rest).alias("delta"))


def scores(labelled: DataFrame, directions: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, id, case, opinion, s, score): members less their case's mean, along the case's direction.

    The mean is that of the case's labelled members. Directions are one row for each case;
    a very large case is split by the join.
    """
    keys = keys or []
    centres = labelled.groupBy(*keys, "case").agg(mean_vector(F.col("v")).alias("_c"))
    per_case = directions.join(centres, [*keys, "case"])
    joined = labelled.join(per_case, [*keys, "case"])
    # (v - c) . delta = v . delta - c . delta
    return joined.select(*keys, "id", "case", "opinion", "s", (dot(F.col("v"), F.col("delta")) - dot(F.col("_c"), F.col("delta"))).alias("score"))


def loo_scores(labelled: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return scores(labelled, leave_one_out(labelled, differences(labelled, keys), keys), keys)


def scored_labels(scored: DataFrame, two_sided_only: bool, keys: list[str] | None = None) -> DataFrame:
    """Scores with y of 0 or 1, rounded so that ties are ties; optionally of two-sided cases only."""
    made = scored.withColumns({"y": F.when(F.col("s") == 1, 1).otherwise(0), "score": F.round("score", 9)})
    if not two_sided_only:
        return made
    case = Window.partitionBy(*(keys or []), "case")
    return made.withColumn("_two", F.min("s").over(case) < F.max("s").over(case)).where("_two").drop("_two")


def opinion_accuracy(scored: DataFrame) -> DataFrame:
    """(n_ok, n): opinions whose mean score has the sign of their label."""
    means = scored.groupBy("case", "opinion", "s").agg(F.round(F.avg("score"), 9).alias("m"))
    return means.agg(F.count_if((F.col("m") > 0) == (F.col("s") == 1)).alias("n_ok"), F.count("*").alias("n"))


def direction_angles(diffs: DataFrame, domain: str = "domain") -> DataFrame:
    """(a, b, cos, degrees) of each unordered pair of domains' directions; domains are a small dimension."""
    fitted = fit(diffs, [domain]).select(F.col(domain).alias("g"), "delta")
    a, b = fitted.alias("a"), fitted.alias("b")
    pairs = a.join(b, F.col("a.g") < F.col("b.g"))
    return pairs.select(F.col("a.g").alias("a"), F.col("b.g").alias("b"), dot(F.col("a.delta"), F.col("b.delta")).alias("cos"), angle(F.col("a.delta"), F.col("b.delta")).alias("degrees"))


def transfer_auc(labelled: DataFrame, diffs: DataFrame, domain: str = "domain") -> DataFrame:
    """(fit, test, auc, n): directions of one domain scoring another's two-sided cases, each case left out
    of its own domain's direction. The totals of all domains, a small dimension, are exploded beside each case.
    """
    totals = diffs.groupBy(domain).agg(sum_vector(F.col("d")).alias("t"), F.count("*").alias("n"))
    array = totals.agg(F.collect_list(F.struct(F.col(domain).alias("fit"), "t", "n")).alias("all")).scalar()
    own = diffs.select("case", F.col(domain).alias("test"), "d", F.explode(array).alias("f"))
    same = F.col("f.fit") == F.col("test")
    left = F.col("f.n") - same.cast("int")
    rest = F.when(same, minus(F.col("f.t"), F.col("d"))).otherwise(F.col("f.t"))
    directions = own.where(left > 0).select("case", "f.fit", "test", unit(rest).alias("delta"))
    centres = labelled.groupBy("case").agg(mean_vector(F.col("v")).alias("_c"))
    joined = labelled.select("case", "s", "v").join(directions.join(centres, "case"), "case")
    scored = joined.select("fit", "test", F.when(F.col("s") == 1, 1).otherwise(0).alias("y"), F.round(dot(F.col("v"), F.col("delta")) - dot(F.col("_c"), F.col("delta")), 9).alias("score"))
    return auc(scored, ["fit", "test"])


def label_permutations(labelled: DataFrame, reps: int, seed: int) -> DataFrame:
    """(rep, auc): leave-one-out AUC with stances dealt anew to the opinions of each case.

    Replicates work on sums of opinions; only the final scores touch members, rep by rep.
    """
    opinions = labelled.groupBy("case", "opinion").agg(sum_vector(F.col("v")).alias("t"), F.count("*").alias("k"), F.max("s").alias("s"))
    natural = Window.partitionBy("case").orderBy("opinion")
    case = Window.partitionBy("case")
    listed = opinions.withColumn("_all", F.transform(F.sort_array(F.collect_list(F.struct("opinion", "s")).over(case)), lambda x: x["s"])).withColumn("_i", F.row_number().over(natural))
    each = listed.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    dealt = Window.partitionBy("rep", "case").orderBy(shuffled(str(seed), F.col("rep"), F.col("case"), F.col("opinion")), "opinion")
    dealt_s = each.withColumn("s", F.element_at("_all", F.row_number().over(dealt))).select("rep", "case", "opinion", "s", "t", "k")
    sides = dealt_s.groupBy("rep", "case", "s").agg(sum_vector(F.col("t")).alias("t"), F.sum("k").alias("k"))
    means = sides.select("rep", "case", "s", times(F.col("t"), 1.0 / F.col("k")).alias("m"))
    diffs = _two_sided(means, ["rep", "case"])
    directions = leave_one_out(dealt_s, diffs, ["rep"])
    centres = labelled.groupBy("case").agg(mean_vector(F.col("v")).alias("_c"))
    ready = dealt_s.select("rep", "case", "opinion", "s").join(directions, ["rep", "case"]).join(centres, "case")
    scored = labelled.select("case", "opinion", "v").join(ready, ["case", "opinion"])
    final = scored.select("rep", "case", "s", (dot(F.col("v"), F.col("delta")) - dot(F.col("_c"), F.col("delta"))).alias("score"))
    return auc(scored_labels(final, True, ["rep"]), ["rep"])


# semantic axes


def axis(anchors: DataFrame) -> DataFrame:
    """(axis): the mean of anchors of pole 1 less that of pole 0, at length one. Anchors: (pole, idx, v)."""
    return side_means(anchors, F.col("pole"), "v").select(unit(minus(F.col("one"), F.col("zero"))).alias("axis"))


def axes_without_each(anchors: DataFrame) -> DataFrame:
    """(pole, idx, axis): the axis with each anchor left out in turn, by totals less its own."""
    t = anchors.groupBy("pole").agg(sum_vector(F.col("v")).alias("t"), F.count("*").alias("n"))
    a, own, other = anchors.alias("a"), t.alias("own"), t.alias("other")
    joined = a.join(F.broadcast(own), F.col("a.pole") == F.col("own.pole")).join(F.broadcast(other), F.col("a.pole") != F.col("other.pole"))
    rest = times(minus(F.col("own.t"), F.col("a.v")), 1.0 / F.nullif(F.col("own.n") - 1, F.lit(0)))
    far = times(F.col("other.t"), -1.0 / F.col("other.n"))
    sign = F.when(F.col("a.pole") == 1, 1.0).otherwise(-1.0)
    return joined.where(F.col("own.n") > 1).select("a.pole", "a.idx", unit(times(plus(rest, far), sign)).alias("axis"))


def project(rows: DataFrame, axis_value, centre, keys: list[str]) -> DataFrame:
    """keys with (z): positions along an axis from a centre, standardised over all rows (n in the deviation)."""
    own = rows.select(*keys, "v", axis_value.alias("_a"), centre.alias("_c"))
    raw = own.select(*keys, (dot(F.col("v"), F.col("_a")) - dot(F.col("_c"), F.col("_a"))).alias("_x"))
    moments = raw.agg(F.struct(F.avg("_x").alias("m"), F.stddev_pop("_x").alias("sd")).alias("s")).scalar()
    return raw.select(*keys, ((F.col("_x") - moments["m"]) / F.nullif(moments["sd"], F.lit(0.0))).alias("z"))
