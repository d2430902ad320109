"""How groups of passages resemble a reference text: similarities, residuals, contrasts.

A member is a passage (case, role, author, v) with v of length one; a group is all members
of one case, role and author. Two facts keep the work small. The mean of cosines is the
cosine with the mean: groups are averaged first, so each reference passage meets one vector
for each group. And a contrast of passages is linear, so where only it is wanted, its one
weight vector takes the place of the passages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.vectors import dot, mean_vector, minus, times, unit
from tessella.schema import OUTSIDE, WARNING, ZONES

GROUP = ["case", "role", "author"]


def analysis_set(paragraphs: DataFrame, min_words: int) -> DataFrame:
    """Paragraphs of the body with enough words."""
    return paragraphs.where(~F.col("is_footnote") & (F.col("n_words") >= min_words))


def reference(rows: DataFrame, size: int, order: str = "para_id", v: str = "v") -> DataFrame:
    """(j, u): the first ``size`` passages of a text, numbered from 0, at length one.

    The sort is a top-k: each task keeps ``size`` rows. The result has ``size`` rows at most.
    """
    first = rows.orderBy(order).limit(size)
    return first.select((F.row_number().over(Window.orderBy(order)) - 1).alias("j"), unit(F.col(v)).alias("u"))


def with_section(ref: DataFrame, sections: DataFrame, at: str = "j") -> DataFrame:
    """ref with the section whose half-open range holds its number; the first of several; else OUTSIDE.

    A range join against a dimension of a few rows.
    """
    s = sections.select(F.col("name").alias("section"), "lo", "hi")
    inside = (F.col(at) >= F.col("lo")) & (F.col(at) < F.col("hi"))
    first = Window.partitionBy(at).orderBy("lo", "section")
    joined = ref.join(F.broadcast(s), inside, "left").withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return joined.withColumn("section", F.coalesce("section", F.lit(OUTSIDE))).drop("lo", "hi", "_n")


def passages(ref: DataFrame) -> Column:
    """The reference, one row for each passage, as a scalar array; its size is bounded by ``reference``."""
    fields = F.struct("j", "section", "u")
    return ref.agg(F.sort_array(F.collect_list(fields)).alias("passages")).scalar()


def side_means(rows: DataFrame, side: Column, v: str = "u") -> DataFrame:
    """(one, zero) in one row: the mean vectors of the rows of side 1 and of side 0; others don't count."""
    means = rows.select(side.alias("_side"), F.col(v).alias("_v")).where(F.col("_side").isNotNull()).groupBy("_side").agg(mean_vector(F.col("_v")).alias("_m"))
    return means.agg(*[F.first(F.when(F.col("_side") == k, F.col("_m")), True).alias(n) for k, n in ((1, "one"), (0, "zero"))])


def contrast_vector(ref: DataFrame, plus: list[str] = ZONES, minus_: list[str] = WARNING, scale: float = 1.0) -> Column:
    """The mean vector of some sections less that of others, as a scalar array."""
    side = F.when(F.col("section").isin(plus), 1).when(F.col("section").isin(minus_), 0)
    return side_means(ref, side).select(times(minus(F.col("one"), F.col("zero")), scale)).scalar()


def groups(members: DataFrame, min_size: int, both: tuple[str, str] | None = ("majority", "dissent")) -> DataFrame:
    """(case, role, author, n, m): groups of ``min_size`` members or more and their mean vectors.

    With ``both``, only of cases that have such groups of either role. Members are averaged
    before the shuffle, so a case of any size sends one vector for each task.
    """
    made = members.groupBy(*GROUP).agg(F.count("*").alias("n"), mean_vector(F.col("v")).alias("m")).where(F.col("n") >= min_size)
    if both is None:
        return made
    case = Window.partitionBy("case")
    has = [F.max((F.col("role") == r).cast("int")).over(case).alias(f"_{i}") for i, r in enumerate(both)]
    return made.select("*", *has).where("_0 = 1 and _1 = 1").drop("_0", "_1")


def similarities(grouped: DataFrame, ref: DataFrame) -> DataFrame:
    """(case, role, author, n, j, section, s): each group's mean cosine with each passage."""
    each = grouped.select(*GROUP, "n", "m", F.explode(passages(ref)).alias("p"))
    return each.select(*GROUP, "n", "p.j", "p.section", dot(F.col("m"), F.col("p.u")).alias("s"))


def similarities_by_member(members: DataFrame, kept: DataFrame, ref: DataFrame) -> DataFrame:
    """The same from every member's cosine with every passage; the plain form that ``similarities`` must equal."""
    own = members.join(kept.select(*GROUP), GROUP, "left_semi")
    each = own.select(*GROUP, "v", F.explode(passages(ref)).alias("p"))
    return each.select(*GROUP, "p.j", "p.section", dot(F.col("v"), F.col("p.u")).alias("c")).groupBy(*GROUP, "j", "section").agg(F.avg("c").alias("s"))


def double_centred(s: DataFrame, value: str = "s", out: str = "r") -> DataFrame:
    """s less its row's and column's mean, plus the mean of all, inside each case.

    The three windows share one shuffle by case; rows are groups times passages, not members.
    """
    row = Window.partitionBy("case", "role", "author")
    column, case = Window.partitionBy("case", "j"), Window.partitionBy("case")
    return s.withColumn(out, F.col(value) - F.avg(value).over(row) - F.avg(value).over(column) + F.avg(value).over(case))


def section_means(r: DataFrame, value: str = "r") -> DataFrame:
    """(case, role, author, section, affinity): mean residuals times 1000."""
    return r.groupBy(*GROUP, "section").agg((F.avg(value) * 1000).alias("affinity"))


def preference(r: DataFrame, value: str = "r", plus: list[str] = ZONES, minus_: list[str] = WARNING) -> DataFrame:
    """(case, role, author, f): 1000 times the mean over some sections less that over others."""
    side = lambda names: F.avg(F.when(F.col("section").isin(names), F.col(value)))
    return r.groupBy(*GROUP).agg(((side(plus) - side(minus_)) * 1000).alias("f"))


def contrast(f: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(case, f_maj, f_dis, delta): the mean over majorities less that over dissents."""
    side = lambda role: F.avg(F.when(F.col("role") == role, F.col("f")))
    return f.groupBy("case", *(keys or [])).agg(side("majority").alias("f_maj"), side("dissent").alias("f_dis")).withColumn("delta", F.col("f_maj") - F.col("f_dis"))


def delta(members: DataFrame, ref: DataFrame, min_size: int) -> DataFrame:
    """(case, f_maj, f_dis, delta) by the full path: similarities, residuals, preferences."""
    return contrast(preference(double_centred(similarities(groups(members, min_size), ref))))


def delta_fast(members: DataFrame, ref: DataFrame, min_size: int) -> DataFrame:
    """(case, delta) without residuals: centring cancels in the contrast of a contrast.

    One dot product for each group with the contrast's weight vector; no row for a passage.
    """
    grouped = groups(members, min_size).withColumn("_w", contrast_vector(ref, scale=1000.0))
    f = grouped.select(*GROUP, dot(F.col("m"), F.col("_w")).alias("f"))
    return contrast(f).select("case", "delta")


def case_profile(s: DataFrame) -> DataFrame:
    """(case, j, section, d): majorities' mean similarity less dissents', for each passage.

    Every contrast over passages of a case is a weighted sum of these; placebo replicates
    and dropped passages need nothing else.
    """
    side = lambda role: F.avg(F.when(F.col("role") == role, F.col("s")))
    return s.groupBy("case", "j", "section").agg((side("majority") - side("dissent")).alias("d"))


def top_passage(r: DataFrame, value: str = "r") -> DataFrame:
    """(case, role, author, j): the passage with the highest value; the lowest number of a tie."""
    best = F.max_by("j", F.struct(F.round(value, 12), -F.col("j")))
    return r.groupBy(*GROUP).agg(best.alias("j"))


def nearest_passage(members: DataFrame, ref: DataFrame, keys: list[str]) -> DataFrame:
    """keys with (j, section, cos): each member's nearest passage; the lowest number of a tie.

    A narrow computation: the array of passages is folded inside each row.
    """
    scored = F.transform("_ref", lambda p: F.struct(dot(F.col("v"), p["u"]).alias("cos"), (-p["j"]).alias("o"), p["section"].alias("section")))
    best = members.withColumn("_ref", passages(ref)).select(*keys, F.array_max(scored).alias("b"))
    return best.select(*keys, (-F.col("b.o")).alias("j"), "b.section", "b.cos")


def section_shares(nearest: DataFrame, keys: list[str]) -> DataFrame:
    """keys with (section, share, n): the percentage of a group's members nearest to each section."""
    counts = nearest.groupBy(*keys, "section").agg(F.count("*").alias("k"))
    total = F.sum("k").over(Window.partitionBy(*keys))
    return counts.select(*keys, "section", (F.col("k") * 100.0 / total).alias("share"), total.alias("n"))


def closest_member(members: DataFrame, ref: DataFrame, member: str = "para_id") -> DataFrame:
    """(case, role, author, j, member, cos): each group's member nearest to each passage; the lowest id of a tie."""
    each = members.select(*GROUP, member, "v", F.explode(passages(ref)).alias("p")).select(*GROUP, member, "p.j", dot(F.col("v"), F.col("p.u")).alias("cos"))
    return each.groupBy(*GROUP, "j").agg(F.max(F.struct("cos", (-F.col(member)).alias("o"))).alias("b")).select(*GROUP, "j", (-F.col("b.o")).alias(member), "b.cos")


def overlay(base: DataFrame, new: DataFrame, key: str = "para_id", v: str = "v", only_new: bool = False) -> DataFrame:
    """base with the vectors of new where it has one, and ``replaced`` telling so; or only those rows."""
    n = new.select(F.col(key).alias("_k"), F.col(v).alias("_v"))
    joined = base.join(n, F.col(key) == F.col("_k"), "inner" if only_new else "left")
    return joined.withColumn("replaced", F.col("_v").isNotNull()).withColumn(v, F.coalesce("_v", v)).drop("_k", "_v")


def drop_each(profile: DataFrame, plus: list[str] = ZONES, minus_: list[str] = WARNING) -> DataFrame:
    """(dropped, mean_delta): the mean contrast with each passage of either side left out in turn.

    By totals less the dropped passage's own, so no variant is computed anew.
    """
    side = F.when(F.col("section").isin(plus), 1).when(F.col("section").isin(minus_), -1)
    means = profile.where(side.isNotNull()).groupBy("j", side.alias("side")).agg(F.avg("d").alias("d"))
    t = means.groupBy("side").agg(F.sum("d").alias("total"), F.count("*").alias("n"))
    own, other = t.alias("own"), t.alias("other")
    joined = means.alias("m").join(F.broadcast(own), F.col("m.side") == F.col("own.side")).join(F.broadcast(other), F.col("m.side") == -F.col("other.side"))
    rest = (F.col("own.total") - F.col("m.d")) / F.nullif(F.col("own.n") - 1, F.lit(0))
    return joined.select(F.col("m.j").alias("dropped"), ((rest - F.col("other.total") / F.col("other.n")) * F.col("m.side") * 1000).alias("mean_delta"))
