"""Tests and summaries over a table of values, exact or by ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.stats import binomial_tail, normal_tail, signed_rank_tail


def mean_rank(value: Column | str, by: list[str] | None = None, weight: str | None = None) -> Column:
    """Ranks from 1, ties at their mean."""
    value = F.col(value) if isinstance(value, str) else value
    window = Window.partitionBy(*by) if by else Window.partitionBy()
    ties = Window.partitionBy(*(by or []), value)
    return F.rank().over(window.orderBy(value)) + (F.count("*").over(ties) - 1) / 2.0


def auc(scores: DataFrame, by: list[str] | None = None, label: str = "y", score: str = "score") -> DataFrame:
    """by with (auc, n): the chance that a 1 scores over a 0, ties counting half; null for one class.

    Scores are counted first, so the cumulative sum goes over distinct values only; without
    ``by`` that sum is over all distinct scores of the table.
    """
    by = by or []
    counts = scores.groupBy(*by, F.col(score).alias("_s")).agg(F.count_if(F.col(label) == 1).alias("_p"), F.count_if(F.col(label) == 0).alias("_n"))
    below = Window.partitionBy(*by).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    won = F.col("_p") * (F.coalesce(F.sum("_n").over(below), F.lit(0)) + F.col("_n") / 2.0)
    sums = counts.select(*by, won.alias("_w"), "_p", "_n").groupBy(*by).agg(F.sum("_w").alias("_w"), F.sum("_p").alias("_p"), F.sum("_n").alias("_n"))
    pairs = F.nullif(F.col("_p") * F.col("_n"), F.lit(0))
    return sums.select(*by, (F.col("_w") / pairs).alias("auc"), (F.col("_p") + F.col("_n")).alias("n"))


def accuracy(rows: DataFrame, by: list[str] | None = None, label: str = "y", predicted: str = "predicted") -> DataFrame:
    """by with (accuracy, baseline, n); the baseline always guesses the commoner label."""
    p = F.avg(F.col(label).cast("double"))
    return rows.groupBy(*(by or [])).agg(
        F.avg((F.col(label) == F.col(predicted)).cast("double")).alias("accuracy"), F.greatest(p, 1 - p).alias("baseline"), F.count("*").alias("n")
    )


def summary(values: DataFrame, value: str = "delta") -> DataFrame:
    """(n, pos, mean, median, sd, sign_p) in one row; sd with n - 1."""
    made = values.agg(
        F.count(value).alias("n"), F.count_if(F.col(value) > 0).alias("pos"), F.avg(value).alias("mean"), F.median(value).alias("median"), F.stddev_samp(value).alias("sd")
    )
    return made.withColumn("sign_p", binomial_tail(F.col("n"), F.col("pos")))


def standing(values: DataFrame, key: str = "case", value: str = "delta") -> DataFrame:
    """Each value's z score (n - 1), rank (one more than those below it) and share of values at or over it."""
    every = Window.partitionBy()
    up = Window.orderBy(value)
    z = (F.col(value) - F.avg(value).over(every)) / F.stddev_samp(value).over(every)
    over = Window.orderBy(F.desc(value)).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return values.select(key, value, z.alias("z"), F.rank().over(up).alias("rank"), (F.count("*").over(over) / F.count("*").over(every)).alias("tail"))


def wilcoxon(values: DataFrame, by: list[str] | None = None, value: str = "delta") -> DataFrame:
    """by with (w, p, n): the signed-rank sum of positive values, and the chance of as much or more.

    Zeros are dropped. p is exact for up to 50 untied values, else by the normal limit with
    the correction for ties.
    """
    by = by or []
    kept = values.where(F.col(value) != 0).select(*by, F.col(value).alias("_d"), F.round(F.abs(value), 12).alias("_a"))
    ranked = kept.select(*by, "_d", "_a", mean_rank("_a", by).alias("_r"), F.count("*").over(Window.partitionBy(*by, "_a")).alias("_t"))
    made = ranked.groupBy(*by).agg(
        F.sum(F.when(F.col("_d") > 0, F.col("_r")).otherwise(0.0)).alias("w"), F.count("*").alias("n"), F.sum((F.col("_t") * F.col("_t") - 1.0) / 48).alias("_ties")
    )
    n = F.col("n")
    z = (F.col("w") - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("_ties"))
    exact = (n <= 50) & (F.col("_ties") == 0)
    return made.select(*by, "w", F.when(exact, signed_rank_tail(F.when(exact, n).otherwise(0), F.when(exact, F.col("w")).otherwise(0.0))).otherwise(normal_tail(z)).alias("p"), "n")


def mann_whitney(values: DataFrame, by: list[str], group: str, first: str, second: str, value: str) -> DataFrame:
    """by with (u, p, n1, n2): the rank sum statistic of the first group, two-sided p by the normal
    limit with corrections for ties and continuity."""
    own = values.where(F.col(group).isin(first, second)).select(*by, F.col(group).alias("_g"), F.round(value, 12).alias("_x"))
    ranked = own.select(*by, "_g", mean_rank("_x", by).alias("_r"), F.count("*").over(Window.partitionBy(*by, "_x")).alias("_t"))
    one = F.col("_g") == first
    made = ranked.groupBy(*by).agg(F.sum(F.when(one, F.col("_r"))).alias("_s"), F.count_if(one).alias("n1"), F.count_if(~one).alias("n2"), F.sum(F.col("_t") * F.col("_t") - 1.0).alias("_ties"))
    n1, n2 = F.col("n1"), F.col("n2")
    n = n1 + n2
    u = F.col("_s") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12.0 * ((n + 1) - F.col("_ties") / (n * (n - 1))))
    z = (F.greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sd
    return made.where((n1 > 0) & (n2 > 0)).select(*by, u.alias("u"), F.least(F.lit(1.0), 2 * normal_tail(z)).alias("p"), "n1", "n2")


def spearman(pairs: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """by with (rho): the correlation of mean ranks."""
    ranked = pairs.select(*by, mean_rank(F.round(x, 12), by).alias("_x"), mean_rank(F.round(y, 12), by).alias("_y"))
    return ranked.groupBy(*by).agg(F.corr("_x", "_y").alias("rho"))


def studentised_gap(values: DataFrame, by: list[str] | None = None, value: str = "delta") -> DataFrame:
    """by with (g, top, second, n): how far the largest value is from the others' mean, in their
    standard deviations; 0 if they don't vary. By totals less the largest value's own."""
    by = by or []
    made = values.groupBy(*by).agg(
        F.max(value).alias("top"), F.sum(value).alias("_s"), F.sum(F.col(value) * F.col(value)).alias("_q"), F.count("*").alias("n"), F.min(value).alias("_low"), F.slice(F.sort_array(F.collect_list(value), False), 2, 1).alias("_second")
    )
    rest = F.col("n") - 1
    mean = (F.col("_s") - F.col("top")) / F.nullif(rest, F.lit(0))
    var = (F.col("_q") - F.col("top") * F.col("top") - rest * mean * mean) / F.nullif(rest - 1, F.lit(0))
    g = F.when(var > 1e-9, (F.col("top") - mean) / F.sqrt(F.greatest(var, F.lit(1e-300)))).otherwise(0.0)
    return made.select(*by, g.alias("g"), "top", F.col("_second")[0].alias("second"), "n")


def grubbs(values: DataFrame, value: str = "delta") -> DataFrame:
    """(g, n): the largest value's distance from the mean of all in standard deviations."""
    return values.agg(((F.max(value) - F.avg(value)) / F.stddev_samp(value)).alias("g"), F.count("*").alias("n"))


def trend(points: DataFrame, x: str, y: str) -> DataFrame:
    """(slope, intercept, per_decade, r, n) of the least-squares line."""
    return points.agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), (F.regr_slope(y, x) * 10).alias("per_decade"), F.corr(y, x).alias("r"), F.count("*").alias("n")
    )


def normal_curve(mean: Column, sd: Column, points: int = 101, width: float = 4.0) -> Column:
    """An array of (x, y) of the normal density from ``width`` deviations below the mean to as many above."""
    at = F.sequence(F.lit(0), F.lit(points - 1))
    x = lambda i: mean + sd * (i * (2 * width / (points - 1)) - width)
    return F.transform(at, lambda i: F.struct(x(i).alias("x"), (F.exp(-F.pow((x(i) - mean) / sd, 2) / 2) / (sd * 2.5066282746310002)).alias("y")))
