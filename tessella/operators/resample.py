"""Bootstrap and permutation with draws that depend on a hashed key alone.

A draw is a hash of (seed, replicate, item), so any engine, task or retry draws the same.
Replicates are a column, made by exploding each row; there are no driver loops.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.stats import hashed, shuffled
from tessella.functions.vectors import dot, minus, times
from tessella.operators.affinity import GROUP, side_means
from tessella.operators.inference import studentised_gap
from tessella.schema import WARNING, ZONES


def replicates(rows: DataFrame, reps: int) -> DataFrame:
    return rows.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))


def numbered(values: DataFrame, order: str, by: list[str] | None = None) -> DataFrame:
    """values with i from 0 in the order of a key, and their number n."""
    window = Window.partitionBy(*(by or []))
    return values.withColumn("i", F.row_number().over(window.orderBy(order)) - 1).withColumn("n", F.count("*").over(window))


def bootstrap(values: DataFrame, order: str, value: str, reps: int, seed: int, by: list[str] | None = None) -> DataFrame:
    """(rep, by, mean): means of as many values drawn with replacement as a group has."""
    by = by or []
    own = numbered(values.select(*by, order, value), order, by)
    draws = replicates(own.select(*by, "i", "n"), reps)
    drawn = draws.select(*by, "rep", F.pmod(hashed(str(seed), F.col("rep"), *map(F.col, by), F.col("i")), F.col("n")).alias("i"))
    return drawn.join(own.select(*by, "i", value), [*by, "i"]).groupBy(*by, "rep").agg(F.avg(value).alias("mean"))


def interval(draws: DataFrame, value: str = "mean", by: list[str] | None = None) -> DataFrame:
    """by with (lo, hi, share_over, share_under): the middle 95 % and the shares over and under zero."""
    return draws.groupBy(*(by or [])).agg(
        F.percentile(value, 0.025).alias("lo"), F.percentile(value, 0.975).alias("hi"),
        F.avg((F.col(value) > 0).cast("double")).alias("share_over"), F.avg((F.col(value) < 0).cast("double")).alias("share_under"),
    )


def null_summary(draws: DataFrame, observed: Column, value: str, two_sided_about: float | None = None, plus_one: bool = False) -> DataFrame:
    """(observed, null_mean, null_sd, lo, hi, p) of a null distribution.

    p is the share of draws at or over the observed value (draws that are null don't count as
    such, but count), or as far from a centre; with plus_one, one more of each.
    """
    if two_sided_about is None:
        extreme = F.coalesce(F.col(value) >= observed, F.lit(False))
    else:
        extreme = F.coalesce(F.abs(F.col(value) - two_sided_about) >= F.abs(observed - two_sided_about), F.lit(False))
    k, n = F.count_if(extreme), F.count("*")
    return draws.agg(
        F.max(observed).alias("observed"), F.avg(value).alias("null_mean"), F.stddev_pop(value).alias("null_sd"),
        F.percentile(value, 0.025).alias("lo"), F.percentile(value, 0.975).alias("hi"),
        ((k + 1) / (n + 1) if plus_one else k / n).alias("p"),
    )


def placebo(profile: DataFrame, reps: int, seed: int, by: list[str] | None = None, plus: list[str] = ZONES, minus_: list[str] = WARNING) -> DataFrame:
    """(rep, by, delta): the mean contrast of random disjoint passages in place of the real sides.

    profile is ``affinity.case_profile``; cases are averaged first (or kept, by ``by``), so a
    replicate only reorders the passages.
    """
    by = by or []
    own = profile.groupBy(*by, "j").agg(F.avg("d").alias("d"), F.first("section").alias("section"))
    group = Window.partitionBy(*by)
    sizes = [F.count_if(F.col("section").isin(names)).over(group).alias(c) for c, names in (("_z", plus), ("_w", minus_))]
    each = replicates(own.select(*by, "j", "d", *sizes), reps)
    dealt = Window.partitionBy("rep", *by).orderBy(shuffled(str(seed), F.col("rep"), F.col("j")), "j")
    placed = each.withColumn("_r", F.row_number().over(dealt))
    first, second = F.col("_r") <= F.col("_z"), F.col("_r").between(F.col("_z") + 1, F.col("_z") + F.col("_w"))
    return placed.groupBy("rep", *by).agg(((F.avg(F.when(first, F.col("d"))) - F.avg(F.when(second, F.col("d")))) * 1000).alias("delta"))


def role_permutations(f: DataFrame, reps: int, seed: int) -> DataFrame:
    """(rep, delta): the mean over cases of the contrast with roles dealt anew to a case's opinions.

    A case's opinions are one row's array; shuffling happens inside the row.
    """
    cases = f.groupBy("case").agg(F.sort_array(F.collect_list(F.struct("role", "author", "f"))).alias("ops"))
    key = lambda o: F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("rep").cast("string"), F.col("case"), o["role"], o["author"].cast("string")))
    dealt = F.sort_array(F.transform("ops", lambda o: F.struct(key(o).alias("k"), o["role"].alias("r"), o["author"].alias("a"), o["f"].alias("f"))))
    placed = replicates(cases, reps).withColumn("dealt", dealt)

    def side(role: str) -> Column:
        values = F.filter(F.zip_with("ops", "dealt", lambda o, d: F.when(o["role"] == role, d["f"])), lambda x: x.isNotNull())
        return F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(values), F.lit(0))

    per_case = placed.select("rep", (side("majority") - side("dissent")).alias("d"))
    return per_case.groupBy("rep").agg(F.avg("d").alias("delta"))


def contrast_weights(ref: DataFrame, names: list[str], scale: float) -> Column:
    """Mean vector of some sections less that of all passages: what is left of centring in a contrast
    whose weights over opinions sum to zero."""
    own = ref.where(F.col("section").isin(names)).select("u", F.lit(1).alias("_k"))
    both = own.unionByName(ref.select("u", F.lit(0).alias("_k")))
    return side_means(both, F.col("_k")).select(times(minus(F.col("one"), F.col("zero")), scale)).scalar()


def contrast_bootstrap(members: DataFrame, ref: DataFrame, weights: dict[tuple[str, int], float], reps: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Observed (name, obs) and replicates (name, rep, value) of one case's contrasts C1 (warning) and C2 (zones).

    weights: what each (role, author) counts; they sum to zero. Members are resampled inside
    their group. Each member is one number for each contrast, so no vector is drawn.
    """
    weight = F.coalesce(*[F.when((F.col("role") == r) & (F.col("author") == a), F.lit(w)) for (r, a), w in weights.items()])
    own = members.withColumn("_w", weight).where(F.col("_w").isNotNull())
    own = own.withColumns({"c1": contrast_weights(ref, WARNING, 1000.0), "c2": contrast_weights(ref, ZONES, 1000.0)})
    long = own.select(*GROUP, "id", "_w", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), dot(F.col("v"), F.col(n)).alias("x")) for n in ("c1", "c2")])).alias("e"))
    long = long.select("role", "author", "id", "_w", "e.name", "e.x")
    observed = long.groupBy("name", "role", "author", "_w").agg(F.avg("x").alias("m")).groupBy("name").agg(F.sum(F.col("m") * F.col("_w")).alias("obs"))
    by = ["name", "role", "author", "_w"]
    sized = numbered(long, "id", by)
    each = replicates(sized.select(*by, "i", "n"), reps)
    drawn = each.select(*by, "rep", F.pmod(hashed(str(seed), F.col("rep"), F.col("role"), F.col("author"), F.col("i")), F.col("n")).alias("i"))
    means = drawn.join(sized.select(*by, "i", "x"), [*by, "i"]).groupBy(*by, "rep").agg(F.avg("x").alias("m"))
    return observed, means.groupBy("name", "rep").agg(F.sum(F.col("m") * F.col("_w")).alias("value"))


def slope_permutations(points: DataFrame, x: str, y: str, reps: int, seed: int) -> DataFrame:
    """(rep, slope): the least-squares slope with the values of y dealt anew."""
    own = numbered(points.select(x, y), x)
    each = replicates(own, reps)
    dealt = Window.partitionBy("rep").orderBy(shuffled(str(seed), F.col("rep"), F.col("i")), "i")
    placed = each.select("rep", y, (F.row_number().over(dealt) - 1).alias("i"))
    return placed.join(own.select("i", x), "i").groupBy("rep").agg(F.regr_slope(y, x).alias("slope"))


def gap_null(values: DataFrame, order: str, value: str, reps: int, seed: int, normal: bool = False) -> DataFrame:
    """(rep, g): the largest studentised gap of samples as large as the table, drawn from all values
    but the largest (the last by ``order`` of a tie), or from a normal of their mean and deviation."""
    last = Window.orderBy(F.desc(value), F.desc(order))
    ranked = values.select(order, value, F.row_number().over(last).alias("_r"))
    rest = numbered(ranked.where("_r > 1").select(order, value), order)
    moments = rest.agg(F.struct(F.avg(value).alias("m"), F.stddev_samp(value).alias("sd"), F.count("*").alias("n")).alias("s")).scalar()
    items = values.sparkSession.range(1).select(F.explode(F.sequence(F.lit(0), moments["n"])).alias("i"), moments["n"].alias("n"))
    each = replicates(items, reps)
    if normal:
        u = lambda k: (hashed(str(seed), F.lit(k), F.col("rep"), F.col("i")) + 0.5) / 4294967296.0
        draw = moments["m"] + moments["sd"] * F.sqrt(-2 * F.log(u("a"))) * F.cos(u("b") * 6.283185307179586)
        return studentised_gap(each.select("rep", draw.alias(value)), ["rep"], value).select("rep", "g")
    drawn = each.select("rep", F.pmod(hashed(str(seed), F.col("rep"), F.col("i")), F.col("n")).alias("i"))
    return studentised_gap(drawn.join(rest.select("i", value), "i"), ["rep"], value).select("rep", "g")
