"""The catalogue of queries over the driver's tables; ``oracles`` has their DuckDB twins.

Cases, roles and stances are stood in for by arithmetic on ids and labels: a case is an
embedding's id modulo 20, a role its label, the reference text the first 38 embeddings.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella import schema
from tessella.functions import stats
from tessella.functions.text import is_junk, strip_quotes, upper_each, word_count
from tessella.functions.vectors import doubles, mean_vector, unit
from tessella.operators import affinity as af
from tessella.operators import direction as di
from tessella.operators import encode as en
from tessella.operators import inference as inf
from tessella.operators import resample as rs
from tessella.operators import segment as sg
from tessella.operators import textmodel as tm
from tessella.oracles import oracle_sql  # noqa: F401
from tessella.sources import cases as sc
from tessella.sources import sinks

#: Least members of a group on these tables; replicates and seeds of the resampling queries.
MIN_SIZE = 4
SWEEP = (2, 3, 4, 5, 6)
SEED = {"boot": 343, "placebo": 1789, "slope": 1952, "contrast": 20240701, "perm": 11}
REPS = {"boot": 2000, "placebo": 1000, "role": 500, "slope": 1000, "gap": 1000, "contrast": 500, "perm": 20}
DOMAINS = ["security", "structure", "immunity"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, the case column under a name that SQL doesn't reserve."""
    columns = [F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    return df.select(*columns).withColumnsRenamed({"case": "case_key"})


def case_of(i: Column) -> Column:
    return F.concat(F.lit("c"), F.lpad((i % 20).cast("string"), 2, "0"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", unit(doubles(F.col("embedding"))).alias("v"))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label")
    role = F.when(label <= 3, "majority").when(label <= 7, "dissent").otherwise("concurrence")
    own = vectors(spark, sf_dir).where(F.col("id") >= schema.REFERENCE_SIZE)
    return own.select("id", case_of(F.col("id")).alias("case"), role.alias("role"), (label % 2).cast("int").alias("author"), "v")


def reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = vectors(spark, sf_dir).where(F.col("id") < schema.REFERENCE_SIZE)
    return af.with_section(af.reference(own, schema.REFERENCE_SIZE, "id"), schema.sections(spark))


def kept_groups(spark: SparkSession, sf_dir: str, size: int = MIN_SIZE) -> DataFrame:
    return af.groups(members(spark, sf_dir), size)


def s_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return af.similarities(kept_groups(spark, sf_dir), reference(spark, sf_dir))


def r_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return af.double_centred(s_matrix(spark, sf_dir))


def deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(case, delta), rounded so that ties are ties."""
    fast = af.delta_fast(members(spark, sf_dir), reference(spark, sf_dir), MIN_SIZE)
    return fast.select("case", F.round("delta", 9).alias("delta"))


def domains(spark: SparkSession) -> DataFrame:
    """A case's domain; the last case has none."""
    return schema.dimension(spark, [(f"c{i:02d}", DOMAINS[i % 3]) for i in range(19)], "case string, domain string")


# affinity


def within_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(af.delta(members(spark, sf_dir), reference(spark, sf_dir), MIN_SIZE))


def delta_fastpath(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(af.delta_fast(members(spark, sf_dir), reference(spark, sf_dir), MIN_SIZE))


def affinity_s(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = members(spark, sf_dir)
    return tidy(af.similarities_by_member(own, af.groups(own, MIN_SIZE), reference(spark, sf_dir)).drop("section"))


def affinity_s_factorised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(s_matrix(spark, sf_dir).drop("section", "n"))


def affinity_r(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(r_matrix(spark, sf_dir).drop("section", "n", "s"))


def residual_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit: all margins of the residuals are zero, and both paths give the same contrasts."""
    r = r_matrix(spark, sf_dir)
    margins = [r.groupBy(*by).agg(F.abs(F.sum("r")).alias("x")) for by in (["case", "role", "author"], ["case", "j"])]
    fast = af.delta_fast(members(spark, sf_dir), reference(spark, sf_dir), MIN_SIZE).select("case", F.col("delta").alias("fast"))
    gap = af.contrast(af.preference(r)).join(fast, "case").agg(F.max(F.abs(F.col("delta") - F.col("fast"))).alias("x"))
    parts = [m.agg(F.max("x").alias("x")) for m in margins] + [gap]
    return reduce(DataFrame.unionByName, [p.select(F.lit(n).alias("check"), (F.col("x") < 1e-6).alias("holds")) for n, p in zip(("rows", "columns", "contrasts"), parts, strict=True)])


def section_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(af.section_means(r_matrix(spark, sf_dir)))


def heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [n for n, _, _ in schema.SECTION_RANGES]
    made = sinks.heatmap_data(af.section_means(r_matrix(spark, sf_dir)), names)
    return tidy(made.withColumnsRenamed({n: f"s{i}" for i, n in enumerate(names)}))


def top_passage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(af.top_passage(r_matrix(spark, sf_dir)))


def nearest_section_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = af.nearest_passage(members(spark, sf_dir), reference(spark, sf_dir), ["role", "author"])
    return tidy(af.section_shares(near, ["role", "author"]))


def closest_paragraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(af.closest_member(members(spark, sf_dir), reference(spark, sf_dir), "id"))


def loo_passage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(af.drop_each(af.case_profile(s_matrix(spark, sf_dir))))


def loo_passage_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = af.drop_each(af.case_profile(s_matrix(spark, sf_dir)))
    return tidy(made.agg(F.min("mean_delta").alias("low"), F.max("mean_delta").alias("high"), F.bool_and(F.col("mean_delta") > 0).alias("all_positive")))


def size_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All least sizes in one pass: groups are made once and kept for each size they reach."""
    sizes = F.array(*map(F.lit, SWEEP))
    made = af.groups(members(spark, sf_dir), min(SWEEP), None)
    each = made.withColumn("min_para", F.explode(F.filter(sizes, lambda k: k <= F.col("n"))))
    each = each.withColumn("_w", af.contrast_vector(reference(spark, sf_dir), scale=1000.0))
    f = each.select("min_para", "case", "role", "author", af.dot(F.col("m"), F.col("_w")).alias("f"))
    d = af.contrast(f, ["min_para"]).where("delta is not null").withColumn("delta", F.round("delta", 9))
    tests = inf.wilcoxon(d, ["min_para"]).select("min_para", "w", "p")
    counts = d.groupBy("min_para").agg(F.count("*").alias("n"), F.avg("delta").alias("mean"), F.count_if(F.col("delta") > 0).alias("pos"))
    return tidy(counts.join(tests, "min_para"))


def overlay_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members after a dissent's are given its vector."""
    own = members(spark, sf_dir).withColumnRenamed("id", "para_id")
    new = own.where("role = 'dissent'").select((F.col("para_id") + 1).alias("para_id"), "v")
    made = af.overlay(own, new)
    return tidy(made.select("para_id", "replaced", F.round(F.col("v")[0], 6).alias("v0")))


def replacement_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contrasts as they are and with replaced vectors, one variant beside the other."""
    own, ref = members(spark, sf_dir).withColumnRenamed("id", "para_id"), reference(spark, sf_dir)
    new = own.where("role = 'dissent'").select((F.col("para_id") + 1).alias("para_id"), "v")
    both = [("as written", own), ("replaced", af.overlay(own, new))]
    parts = [af.delta_fast(m, ref, MIN_SIZE).agg(F.avg("delta").alias("mean"), F.count_if(F.col("delta") > 0).alias("pos"), F.count("*").alias("n")).withColumn("variant", F.lit(v)) for v, m in both]
    return tidy(reduce(DataFrame.unionByName, parts))


# tests over contrasts


def within_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(inf.summary(deltas(spark, sf_dir)))


def delta_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(inf.standing(deltas(spark, sf_dir)))


def delta_by_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = deltas(spark, sf_dir).join(F.broadcast(domains(spark)), "case", "left").withColumn("domain", F.coalesce("domain", F.lit("?")))
    return tidy(named.groupBy("domain").agg(F.avg("delta").alias("mean_delta"), F.count("*").alias("n")))


def wilcoxon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(inf.wilcoxon(deltas(spark, sf_dir)))


def grubbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(inf.grubbs(deltas(spark, sf_dir)))


def grubbs_critical(spark: SparkSession, sf_dir: str) -> DataFrame:
    critical = F.udf(lambda n: stats.grubbs_critical(n), "double")  # one row
    made = inf.grubbs(deltas(spark, sf_dir)).withColumn("critical", critical("n"))
    return tidy(made.withColumn("rejects", F.col("g") > F.col("critical")))


def outlier_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(inf.studentised_gap(deltas(spark, sf_dir)))


def max_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gap(spark, sf_dir, False)


def max_gap_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gap(spark, sf_dir, True)


def _gap(spark: SparkSession, sf_dir: str, normal: bool) -> DataFrame:
    d = deltas(spark, sf_dir)
    g = inf.studentised_gap(d).select("g").scalar()
    null = rs.gap_null(d, "case", "delta", REPS["gap"], SEED["slope"], normal)
    return tidy(null.agg(F.max(g).alias("g"), F.avg("g").alias("null_mean"), F.percentile("g", 0.95).alias("null_95"), F.avg((F.col("g") >= g).cast("double")).alias("p")))


def boot_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(rs.interval(rs.bootstrap(deltas(spark, sf_dir), "case", "delta", REPS["boot"], SEED["boot"])))


def boot_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = members(spark, sf_dir).where("case = 'c05'")
    weights = {("majority", 0): 1.0, ("dissent", 0): -0.5, ("dissent", 1): -0.5}
    observed, draws = rs.contrast_bootstrap(one, reference(spark, sf_dir), weights, REPS["contrast"], SEED["contrast"])
    return tidy(observed.join(rs.interval(draws, "value", ["name"]), "name"))


def placebo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(rs.placebo(af.case_profile(s_matrix(spark, sf_dir)), REPS["placebo"], SEED["placebo"]))


def placebo_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    observed = deltas(spark, sf_dir).agg(F.avg("delta").alias("d")).scalar()
    return tidy(rs.null_summary(rs.placebo(af.case_profile(s_matrix(spark, sf_dir)), REPS["placebo"], SEED["placebo"]), observed, "delta"))


def preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return af.preference(r_matrix(spark, sf_dir))


def role_perm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(rs.role_permutations(preferences(spark, sf_dir), REPS["role"], SEED["placebo"]))


def role_perm_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    observed = deltas(spark, sf_dir).agg(F.avg("delta").alias("d")).scalar()
    draws = rs.role_permutations(preferences(spark, sf_dir), REPS["role"], SEED["placebo"])
    return tidy(rs.null_summary(draws, observed, "delta"))


def null_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The normal curve drawn over the placebo null."""
    draws = rs.placebo(af.case_profile(s_matrix(spark, sf_dir)), REPS["placebo"], SEED["placebo"])
    moments = draws.agg(F.avg("delta").alias("m"), F.stddev_pop("delta").alias("sd"))
    return tidy(moments.select(F.explode(inf.normal_curve(F.col("m"), F.col("sd"))).alias("p")).select("p.x", "p.y"))


def lollipop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(sinks.lollipop_data(deltas(spark, sf_dir)))


# directions


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members with a stance; an opinion is a case's label, of which the last has a null stance."""
    own = vectors(spark, sf_dir).where(F.col("id") >= schema.REFERENCE_SIZE).select("id", case_of(F.col("id")).alias("case"), F.col("label").cast("int").alias("opinion"), "v")
    rows = [(f"c{c:02d}", o, 1 if o < 5 else 0 if o < 9 else None) for c in range(20) for o in range(10)]
    return di.with_labels(own, schema.dimension(spark, rows, "case string, opinion int, label int"), ["case", "opinion"])


def direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = di.fit(di.differences(labelled(spark, sf_dir)))
    return tidy(made.select(F.posexplode("delta").alias("i", "x"), "n"))


def direction_loo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(di.loo_scores(labelled(spark, sf_dir)).select("id", "case", "s", "score"))


def direction_loo_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(inf.auc(di.scored_labels(di.loo_scores(labelled(spark, sf_dir)), False), ["case"]))


def direction_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = di.scored_labels(di.loo_scores(labelled(spark, sf_dir)), False)
    right = scored.agg(F.avg(((F.col("score") > 0) == (F.col("y") == 1)).cast("double")).alias("a")).select("a").scalar()
    return tidy(inf.auc(scored).withColumn("accuracy", right))


def opinion_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return di.opinion_accuracy(di.loo_scores(labelled(spark, sf_dir)))


def with_domains(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    own = labelled(spark, sf_dir)
    diffs = di.differences(own).join(F.broadcast(domains(spark)), "case")
    return own, diffs


def direction_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(di.direction_angles(with_domains(spark, sf_dir)[1]))


def transfer_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(di.transfer_auc(*with_domains(spark, sf_dir)))


def label_perm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(di.label_permutations(labelled(spark, sf_dir), REPS["perm"], SEED["perm"]))


def label_perm_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = labelled(spark, sf_dir)
    observed = inf.auc(di.scored_labels(di.loo_scores(own), True)).select("auc").scalar()
    return tidy(rs.null_summary(di.label_permutations(own, REPS["perm"], SEED["perm"]), observed, "auc", 0.5))


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve vectors of each of two labels."""
    own = vectors(spark, sf_dir).where("label in (0, 9)")
    rank = F.row_number().over(af.Window.partitionBy("label").orderBy("id"))
    return own.withColumn("idx", rank - 1).where("idx < 12").select((F.col("label") == 9).cast("int").alias("pole"), "idx", "v")


def axis_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    centre = vectors(spark, sf_dir).agg(mean_vector(F.col("v")).alias("m")).scalar()
    axis = di.axis(anchors(spark, sf_dir)).scalar()
    return di.project(members(spark, sf_dir), axis, centre, ["id", "case", "role"])


def axis_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(axis_z(spark, sf_dir))


def axis_case_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all members and of majorities alone."""
    majority = F.avg(F.when(F.col("role") == "majority", F.col("z")))
    return tidy(axis_z(spark, sf_dir).groupBy("case").agg(F.avg("z").alias("mean"), majority.alias("majority_mean")))


def axis_mwu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(inf.mann_whitney(axis_z(spark, sf_dir), ["case"], "role", "majority", "dissent", "z"))


def axis_loo_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case means are linear in the axis, so each refit scores cases' mean vectors, not members."""
    means = members(spark, sf_dir).groupBy("case").agg(mean_vector(F.col("v")).alias("m"))
    full = di.axis(anchors(spark, sf_dir)).scalar()
    axes = di.axes_without_each(anchors(spark, sf_dir))
    listed = axes.agg(F.collect_list(F.struct("pole", "idx", "axis")).alias("a")).scalar()
    each = means.select("case", "m", full.alias("full"), F.explode(listed).alias("a")).withColumn("base", af.dot(F.col("m"), F.col("full")))
    pairs = each.select("a.pole", "a.idx", "base", af.dot(F.col("m"), F.col("a.axis")).alias("refit"))
    return tidy(inf.spearman(pairs, ["pole", "idx"], "refit", "base"))


# trends


def yearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy(F.year("o_orderdate").alias("year")).agg(F.avg(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("f"))


def drift_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(inf.trend(yearly(spark, sf_dir), "year", "f"), 3)


def slope_perm(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = yearly(spark, sf_dir).withColumn("f", F.round("f", 6))
    observed = inf.trend(points, "year", "f").select("slope").scalar()
    draws = rs.slope_permutations(points, "year", "f", REPS["slope"], SEED["slope"])
    rounded = draws.withColumn("slope", F.round("slope", 6))
    return tidy(rs.null_summary(rounded, F.round(observed, 6), "slope", plus_one=True).select("observed", "p"), 3)


def case_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preferences of majorities, centred over all cases instead of inside each."""
    own = members(spark, sf_dir).where("role = 'majority'").withColumn("author", F.lit(0))
    grouped = af.groups(own, 2 * MIN_SIZE, None)
    s = af.similarities(grouped, reference(spark, sf_dir)).withColumns({"_case": F.col("case"), "author": F.col("case"), "case": F.lit("all")})
    f = af.preference(af.double_centred(s)).select(F.col("author").alias("case"), "f")
    every = af.Window.partitionBy()
    return tidy(f.select("case", "f", ((F.col("f") - F.avg("f").over(every)) / F.stddev_pop("f").over(every)).alias("z")))


# text


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def paragraph_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sg.paragraphs(documents(spark, sf_dir))


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = sg.number(paragraph_rows(spark, sf_dir)).select("para_id", "doc_id", F.col("pos").cast("bigint").alias("pos"), F.col("n_words").cast("bigint").alias("n_words"), F.md5("text").alias("text_md5"))
    return made


def analysis_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = paragraph_rows(spark, sf_dir).withColumn("is_footnote", F.col("text").rlike(r"^\d"))
    kept = af.analysis_set(rows, schema.MIN_WORDS)
    return kept.agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"), F.sum("n_words").alias("words"))


def quote_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_rows(spark, sf_dir).where("quote_share > 0").select("doc_id", F.col("pos").cast("bigint").alias("pos"), "quote_share")


def quote_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = documents(spark, sf_dir).select("doc_id", strip_quotes(F.col("text")).alias("t"))
    return made.where(word_count(F.col("t")) >= 20).select("doc_id", F.md5("t").alias("text_md5"), F.length("t").cast("bigint").alias("n_chars"))


def word_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = documents(spark, sf_dir).withColumn("n", word_count(F.col("text")))
    return made.where("n >= 20").groupBy("source").agg(F.count("*").alias("docs"), F.sum("n").alias("words"))


def mention_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).groupBy("source").agg(F.sum(F.regexp_count("text", F.lit("the"))).alias("mentions"))


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = sc.quality_counts(documents(spark, sf_dir), "doc_id", ["tion", "ofthe"])
    return made.select("doc_id", *[F.col(c).cast("bigint").alias(c) for c in made.columns[1:]])


def type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sc.type_counts(documents(spark, sf_dir), "lang")


def junk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that page furniture patterns drop; every ninth line is made to look like a running head."""
    lines = paragraph_rows(spark, sf_dir)
    t = F.when(F.col("pos") % 9 == 0, F.concat(F.lit("Opinion of Roe, J."), F.lit(""))).when(F.col("pos") % 9 == 4, F.col("pos").cast("string")).otherwise(F.col("text"))
    return lines.select("doc_id", is_junk(t).alias("junk")).groupBy("doc_id").agg(F.count_if("junk").alias("dropped"), F.count("*").alias("n"))


def opinion_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = paragraph_rows(spark, sf_dir).withColumn("is_footnote", F.col("n_words") < schema.MIN_WORDS)
    return sg.opinion_inventory(rows, ["doc_id"])


def header_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that begin with some letters are given opinion headers, then texts are cut at them."""
    t = F.regexp_replace("text", "\n([A-C])", "\nJustice $1oe, with whom Justice Poe joins, dissenting in part. $1")
    t = F.regexp_replace(t, "\n([D-F])", "\nMr. Chief Justice $1oe delivered the opinion. $1")
    made = sg.split_blobs(documents(spark, sf_dir).select("doc_id", t.alias("text")))
    return made.select("doc_id", F.col("piece").cast("bigint").alias("piece"), "start", "end", "author", "type").withColumnsRenamed({"start": "start_at", "end": "end_at"})


def layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents with hashed indents and type sizes."""
    h = stats.hashed(F.col("doc_id"), F.col("pos"))
    x = F.when(h % 10 < 6, 72.0).when(h % 10 < 8, 84.0).when(h % 10 < 9, 140.0).otherwise(74.5)
    size = F.when(F.floor(h / 10) % 10 < 7, 11.0).when(F.floor(h / 10) % 10 < 9, 9.0).otherwise(7.0)
    t = F.when(F.floor(h / 100) % 11 == 0, "Syllabus").when(F.floor(h / 100) % 11 == 1, F.concat(F.lit("12 "), F.col("text"))).when(F.floor(h / 100) % 11 == 2, "II").otherwise(F.col("text"))
    return paragraph_rows(spark, sf_dir).select(F.col("doc_id").alias("doc"), F.floor(F.col("pos") / 12).alias("page"), F.col("pos").alias("line_no"), x.alias("x0"), size.alias("sz"), t.alias("t"))


def layout_sessionise(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = sg.laid_out_paragraphs(layout(spark, sf_dir))
    return made.select("doc", F.col("para_no").cast("bigint").alias("para_no"), "is_footnote", "n_lines", F.md5("text").alias("text_md5"))


def page_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sg.page_margins(layout(spark, sf_dir))


def best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = F.array(F.lit("the"), F.lit("tion"))
    made = sc.best_candidate(documents(spark, sf_dir), tokens, "source", "doc_id", "text", "(?i)and|est")
    return made.withColumn("score", F.col("score").cast("bigint"))


def first_nonempty_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("doc_id", "lang", upper_each(F.col("text")).alias("a"), F.col("text").alias("b"), F.concat("text", "text", "text").alias("c"))
    fields = rows.select("doc_id", F.when(F.col("lang") == "fr", F.col("a")).alias("a"), F.when(F.col("lang") != "en", F.col("b")).alias("b"), "c")
    made = sc.best_field(fields, ["a", "b", "c"])
    return made.select("doc_id", "text_field", F.length("text").cast("bigint").alias("n_chars"))


def first_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first turn of a conversation that says a word."""
    tries = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("key"), F.col("turn").alias("pos"), F.when(F.col("text").contains("this"), F.length("text").cast("bigint")).alias("result"))
    return sc.first_success(tries)


def source_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations, and documents of ids that have none."""
    first = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("key"), F.lit("archive").alias("origin"), F.length("text").cast("bigint").alias("n"))
    second = documents(spark, sf_dir).select(F.col("doc_id").alias("key"), F.lit("pages").alias("origin"), F.length("text").cast("bigint").alias("n"))
    return sc.with_priority(first, second, "key").groupBy("origin").agg(F.count("*").alias("n_rows"), F.countDistinct("key").alias("n_keys"), F.sum("n").alias("n_chars"))


def stance_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a label that is not null; toxic documents' labels are made null."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 0, F.col("quality")).alias("label"))
    own = di.with_labels(documents(spark, sf_dir), labels, ["doc_id"])
    return own.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("s") == 1).alias("pos"), F.count_if(F.col("s") == -1).alias("neg"))


def label_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select(F.col("toxic").alias("y"), F.lit(0).alias("predicted"), F.col("quality"))
    return tidy(inf.accuracy(rows, ["quality"]))


def discarded_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources and languages whose labelled documents are all of one kind."""
    own = documents(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id")
    both = own.groupBy("source", "lang").agg(F.countDistinct("toxic").alias("k")).where("k = 2").select("source", "lang")
    return own.select("source", "lang").distinct().exceptAll(both)


def majority_minus_dissent_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean words of one role's turns less another's, of conversations that have both."""
    turns = table(spark, sf_dir, "conversations").withColumn("n", word_count(F.col("text")))
    side = lambda r: F.avg(F.when(F.col("role") == r, F.col("n")))
    made = turns.groupBy("conv_id").agg((side("assistant") - side("user")).alias("d"), F.count("*").alias("turns"))
    return tidy(made.where("d is not null"))


def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("doc_id", word_count(F.col("text")).alias("n"))
    each = rows.select("doc_id", F.explode(en.chunk_bounds(F.col("n"))).alias("c"))
    return each.select("doc_id", *[F.col(f"c.{x}").cast("bigint").alias(x) for x in ("chunk_no", "lo", "hi")])


def encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = en.hashed_encoder(table(spark, sf_dir, "benchmark"), "item_id", "text")
    return made.select("item_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x")).select("item_id", "i", F.round("x", 4).alias("x"))


def tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(tm.tfidf(documents(spark, sf_dir), "doc_id", "text"))


def cv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).where(F.col("id") >= schema.REFERENCE_SIZE).select("id", (F.col("id") % 4).alias("group"), (F.col("label") < 5).cast("int").alias("y"), (F.col("label") % 2).alias("author"), "v")


def logo_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = tm.leave_one_group_out(cv_rows(spark, sf_dir).drop("author"), "v", iterations=100)
    right = inf.accuracy(scored, ["group"])
    return tidy(right.join(inf.auc(scored, ["group"], "y", "prob").drop("n"), "group"))


def text_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id").select(F.col("doc_id").alias("id"), (F.abs(F.hash("source")) % 3).alias("group"), "text", "quality", "toxic", F.col("lang"))


def diagnose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three targets by the same protocol: quality, toxicity, language."""
    rows = text_rows(spark, sf_dir).withColumn("english", (F.col("lang") == "en").cast("int"))
    scored = tm.leave_one_group_out(rows, "text", ["quality", "toxic", "english"], iterations=30)
    return tidy(inf.auc(scored, ["target"], "y", "prob"))


def heldout_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model of all other cases scores one case; means and shares over one half by author."""
    rows = cv_rows(spark, sf_dir)
    train, held = rows.where("group <> 0"), rows.where("group = 0")
    model = tm.fit_logistic(tm.standardised(train, train), 100)
    scored = tm.probabilities(model, tm.standardised(train, held).select("id", "author", "features"))
    return tidy(scored.groupBy("author").agg(F.avg("prob").alias("mean"), F.avg((F.col("prob") > 0.5).cast("double")).alias("share"), F.count("*").alias("n")))


CATALOGUE = [
    within_delta, within_summary, delta_rank, delta_by_domain, affinity_s, affinity_s_factorised, affinity_r, residual_margins, delta_fastpath,
    section_matrix, heatmap, top_passage, nearest_section_share, closest_paragraph, loo_passage, loo_passage_range, size_sweep, overlay_vectors, replacement_control,
    wilcoxon, grubbs, grubbs_critical, outlier_gap, max_gap, max_gap_normal, boot_mean, boot_contrast, placebo, placebo_summary, role_perm, role_perm_summary,
    null_curve, lollipop, direction, direction_loo, direction_loo_auc, direction_pooled, opinion_accuracy, direction_angles, transfer_auc, label_perm, label_perm_summary,
    axis_scores, axis_case_means, axis_mwu, axis_loo_spearman, drift_slope, slope_perm, case_preference, paragraphs, analysis_set, quote_strip, word_filter,
    mention_counts, quality_counts, type_counts, junk_lines, opinion_inventory, header_spans, layout_sessionise, page_margins, best_candidate, first_nonempty_field,
    first_success, source_priority, stance_join, label_coverage, discarded_cases, majority_minus_dissent_length, chunk_windows, encode, tfidf, logo_cv, diagnose, heldout_scores,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in CATALOGUE} | {"quote_share": quote_shares}
