"""Whole analyses over a paragraph table: corpus, headline contrast, robustness, controls.

A study is a paragraph table with vectors, one case and author whose first passages are the
reference text, and small dimensions. Each function returns named DataFrames. What several of
them share is written once to the checkpoint folder; the rest runs when they are written.
"""

from __future__ import annotations

import tempfile
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella import schema
from tessella.functions.text import quote_share, strip_quotes, word_count
from tessella.functions.vectors import unit
from tessella.operators import affinity as af
from tessella.operators import direction as di
from tessella.operators import encode as en
from tessella.operators import inference as inf
from tessella.operators import resample as rs
from tessella.operators import segment as sg


@dataclass
class Study:
    #: schema.PARAGRAPHS with v array<double>
    paragraphs: DataFrame
    reference_case: str
    reference_author: str
    sections: DataFrame
    #: (case, domain) and (case, author, label)
    domains: DataFrame | None = None
    labels: DataFrame | None = None
    held_out: str | None = None
    min_words: int = schema.MIN_WORDS
    min_para: int = schema.MIN_PARA
    #: rows and reference once they are made, each written once to the checkpoint folder
    _made: dict[str, DataFrame] = field(default_factory=dict, init=False, repr=False)
    reps: dict[str, int] = field(default_factory=lambda: {"boot": 20_000, "placebo": 4_000, "role": 2_000, "slope": 10_000, "gap": 20_000, "perm": 200})

    def rows(self) -> DataFrame:
        if "rows" not in self._made:
            self._made["rows"] = cut(self._rows())
        return self._made["rows"]

    def _rows(self) -> DataFrame:
        own = af.analysis_set(self.paragraphs, self.min_words)
        return own.select(F.col("para_id").alias("id"), F.col("case_key").alias("case"), "year", F.col("opinion_type").alias("role"), "author", unit(F.col("v")).alias("v"), "text")

    def members(self) -> DataFrame:
        """All passages but the reference case's, which cannot engage itself."""
        return self.rows().where(F.col("case") != self.reference_case)

    def reference(self) -> DataFrame:
        if "reference" not in self._made:
            own = self.rows().where((F.col("case") == self.reference_case) & (F.col("author") == self.reference_author))
            self._made["reference"] = cut(af.with_section(af.reference(own, schema.REFERENCE_SIZE, "id"), self.sections))
        return self._made["reference"]

    def deltas(self) -> DataFrame:
        fast = af.delta_fast(self.members(), self.reference(), self.min_para)
        return fast.select("case", F.round("delta", 9).alias("delta"))


def cut(df: DataFrame) -> DataFrame:
    """df by a reliable checkpoint: what many plans share is computed once and their size stays small."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where:
            if not (context.master == "local" or context.master.startswith("local[")):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            where = tempfile.mkdtemp(prefix="tessella-")
        context.setCheckpointDir(where)
    return df.checkpoint()


def corpus(raw_cases: DataFrame, layout: DataFrame | None = None) -> DataFrame:
    """schema.PARAGRAPHS from nested case records and, for cases without one, laid-out lines (doc = case key)."""
    opinions = sg.archive_opinions(raw_cases)
    lines = sg.paragraphs(opinions.withColumn("_id", F.concat_ws("\x1f", "case_key", "opinion_idx")), "_id")
    own = opinions.withColumn("_id", F.concat_ws("\x1f", "case_key", "opinion_idx")).drop("text", "header")
    made = lines.join(own, "_id").select("case_key", "case_name", "year", "opinion_idx", "author", F.col("type").alias("opinion_type"), "source", F.lit(False).alias("is_footnote"), "n_words", "quote_share", "text", "pos")
    if layout is not None:
        rest = layout.join(raw_cases.select(F.col("key").alias("doc")), "doc", "left_anti")
        split = sg.split_laid_out(sg.laid_out_paragraphs(rest))
        made = made.unionByName(
            split.select(
                F.col("doc").alias("case_key"), F.lit(None).cast("string").alias("case_name"), F.lit(None).cast("int").alias("year"), "opinion_idx", "author", "opinion_type",
                F.lit("scotus-pdf").alias("source"), "is_footnote", word_count(F.col("text")).alias("n_words"), quote_share(F.col("text")).alias("quote_share"), "text", F.col("para_no").alias("pos"),
            )
        )
    order = af.Window.partitionBy("case_key").orderBy("opinion_idx", "pos")
    cases = made.groupBy("case_key").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(af.Window.orderBy("case_key").rowsBetween(af.Window.unboundedPreceding, -1)), F.lit(0))  # one row a case
    starts = cases.select("case_key", before.alias("_start"))
    return made.join(starts, "case_key").select((F.col("_start") + F.row_number().over(order) - 1).alias("para_id"), "case_key", "case_name", "year", "opinion_idx", "author", "opinion_type", "source", "is_footnote", "n_words", "quote_share", "text")


def headline(study: Study) -> dict[str, DataFrame]:
    """Contrasts by case, their summary, rank test, interval of the mean, standing and domain means."""
    d = study.deltas()
    out = {
        "within": af.delta(study.members(), study.reference(), study.min_para),
        "summary": inf.summary(d),
        "wilcoxon": inf.wilcoxon(d),
        "interval": rs.interval(rs.bootstrap(d, "case", "delta", study.reps["boot"], 343)),
        "standing": inf.standing(d),
        "gap": inf.studentised_gap(d),
        "gap_null": rs.gap_null(d, "case", "delta", study.reps["gap"], 1952),
    }
    if study.domains is not None:
        named = d.join(study.domains, "case", "left").withColumn("domain", F.coalesce("domain", F.lit("?")))
        out["by_domain"] = named.groupBy("domain").agg(F.avg("delta").alias("mean_delta"), F.count("*").alias("n"))
    return out


def robustness(study: Study) -> dict[str, DataFrame]:
    """Placebo passages, roles dealt anew, each passage dropped, and quotations taken out and encoded again."""
    members, ref = study.members(), study.reference()
    s = cut(af.similarities(af.groups(members, study.min_para), ref))
    observed = cut(study.deltas().agg(F.avg("delta").alias("d"))).scalar()
    profile = cut(af.case_profile(s))
    roles = rs.role_permutations(af.preference(af.double_centred(s)), study.reps["role"], 1789)
    bare = study.rows().withColumn("text", strip_quotes(F.col("text"))).where(word_count(F.col("text")) >= 20)
    encoded = cut(en.hashed_encoder(bare, "id", "text").select("id", unit(F.col("embedding").cast("array<double>")).alias("v")))
    both = cut(en.hashed_encoder(study.rows(), "id", "text").select("id", unit(F.col("embedding").cast("array<double>")).alias("v")))
    variants = {"as written": both, "quotes removed": af.overlay(both, encoded, "id").select("id", "v")}
    parts = []
    for name, vectors in variants.items():
        own = study.rows().drop("v").join(vectors, "id").where("v is not null")
        own = cut(own)
        r = af.with_section(af.reference(own.where((F.col("case") == study.reference_case) & (F.col("author") == study.reference_author)), schema.REFERENCE_SIZE, "id"), study.sections)
        r = cut(r)
        parts.append(af.delta_fast(own.where(F.col("case") != study.reference_case), r, study.min_para).withColumn("variant", F.lit(name)))
    return {
        "placebo": rs.null_summary(rs.placebo(profile, study.reps["placebo"], 1789), observed, "delta"),
        "roles": rs.null_summary(roles, observed, "delta"),
        "dropped": af.drop_each(profile),
        "quotations": parts[0].unionByName(parts[1]),
    }


def stance(study: Study) -> dict[str, DataFrame]:
    """The stance direction: leave-one-case-out scores and AUC, opinions got right, and the label permutation null."""
    own = study.rows().where(F.col("case") != study.held_out) if study.held_out else study.rows()
    lab = cut(di.with_labels(own, study.labels, ["case", "author"]).withColumnRenamed("author", "opinion"))
    scored = cut(di.loo_scores(lab))
    return {
        "scores": scored,
        "auc": inf.auc(di.scored_labels(scored, False)),
        "by_case": inf.auc(di.scored_labels(scored, False), ["case"]),
        "opinions": di.opinion_accuracy(scored),
        "permutations": di.label_permutations(lab, study.reps["perm"], 11),
    }


def write(results: dict[str, DataFrame], path: str) -> None:
    for name, df in results.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
