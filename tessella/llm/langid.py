"""Language of web pages: text likelihoods fused with declared language, address suffix and host.

Four pieces of evidence are combined by Bayes' rule. The text's likelihood is a hashed
byte-trigram model; how far the declared language and the address suffix can be trusted is
counted over all pages; a host's prior is smoothed towards its domain's, that towards its
suffix's, and that towards the whole corpus. All counts are grouped aggregations.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import as_bytes, checkpoint, pick

#: Buckets of hashed trigrams; the text model is fitted on at most so many labelled texts of
#: each language (chosen by a hash of the id), each whole and of at most so many characters;
#: the languages are the commonest, at most so many.
BUCKETS, MOST_TEXTS, MOST_CHARS, MOST_LANGUAGES = 1 << 15, 400, 20_000, 256
#: Hashes are drawn from a share of all texts in which so many times MOST_TEXTS are expected.
DRAWN = 2.0
#: At most so many trigrams' worth of evidence comes from a text: neighbouring ones overlap.
TEXT_EVIDENCE = 60.0
#: Pseudo-counts: of evidence tables, and of a parent's share in a host's prior.
SMOOTH, PARENT = 1.0, 5.0

_DROP = re.compile(rb"(?is)<(script|style|noscript|template)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)|<[^>]*>|&#?\w+;")
_LANG = re.compile(rb"(?is)<html\b[^>]*?\slang\s*=\s*[\"']?\s*([a-z]{2,3})\b")
_SPACES = re.compile(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]+")


def _codes(data: bytes) -> np.ndarray:
    raw = np.frombuffer(b" " + _SPACES.sub(b" ", data.lower()).strip() + b" ", np.uint8).astype(np.int64)
    if len(raw) < 3:
        return np.zeros(0, np.int64)
    return ((raw[:-2] * 0x9E5 + raw[1:-1] * 0x3F1B + raw[2:] * 0x1A7D3) * 0x9E3779B1 >> 7) % BUCKETS


def fit_text_model(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """(languages, log likelihoods [bucket, language]) from a bounded sample of labelled texts.

    Rows without a language or a text, empty and very long texts are left out. Texts are
    chosen by hashes of id and text, so rows that repeat are one, and ties cannot be. The ids
    come first, from a share of the rows set by each language's count, so that no task
    gives more than its part; then only the texts chosen are read, whole, and counted where
    they are. The driver gets one row of counts for each language. No rows: no languages.
    """
    rows = pick(docs, key, text, lang).select(F.col(lang).alias("lang"), F.xxhash64(text, key).alias("h"), F.col(text).alias("text"))
    rows = rows.where("lang is not null and text is not null and text <> ''").where(F.length("text") <= MOST_CHARS)
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES)
    known = F.broadcast(sizes.select("lang", (DRAWN * MOST_TEXTS / F.col("n")).alias("share")))
    place = (F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53))).alias("place")  # from 0 to 1
    drawn = rows.select("lang", "h", place).join(known, "lang").where("place <= share").select("lang", "h").distinct()
    first = Window.partitionBy("lang").orderBy("h")
    chosen = F.broadcast(drawn.withColumn("i", F.row_number().over(first)).where(F.col("i") <= MOST_TEXTS).select("lang", "h"))  # a few hundred a language
    own = rows.join(chosen, ["lang", "h"]).dropDuplicates(["lang", "h"]).select("lang", "text")

    def run(batch: pa.Table) -> pa.Table:
        counts = np.zeros(BUCKETS, np.int64)
        for body in batch.column("text"):
            counts += np.bincount(_codes(body.as_py().encode()), minlength=BUCKETS)
        return pa.table({"lang": batch.column("lang").slice(0, 1), "counts": pa.array([counts.tobytes()], pa.binary())})

    found = sorted((r["lang"], r["counts"]) for r in own.groupBy("lang").applyInArrow(run, "lang string, counts binary").collect())
    if not found:
        return [], np.zeros((BUCKETS, 0), np.float32)
    counts = np.stack([np.frombuffer(c, np.int64) for _, c in found], 1) + 0.05
    return [x for x, _ in found], np.log(counts / counts.sum(0)).astype(np.float32)


def host_of(url: Column) -> Column:
    """The host of an address, lower-cased, without user and port; empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def evidence(pages: DataFrame, languages: list[str], table: np.ndarray, key: str = "page_id") -> DataFrame:
    """(key, host, domain, suffix, declared, text): a page's evidence; ``text`` has a log likelihood for each language."""
    sent = pages.sparkSession.sparkContext.broadcast(table)
    host = host_of(F.col("url"))
    labels = F.split("host", r"\.")
    rows = pick(pages, key, "url", "html").select(key, host.alias("host"), "html")
    rows = rows.select(
        key,
        "host",
        F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".").alias("domain"),
        F.element_at(labels, -1).alias("suffix"),
        "html",
    )
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            declared, scores = [], []
            for x in as_bytes(batch.column(4)):
                html = x.as_py()
                found = _LANG.search(html)
                declared.append(found[1].decode().lower() if found else "")
                codes = _codes(_DROP.sub(b" ", html))
                total = sent.value[codes].sum(0, dtype=np.float64)
                scores.append((total * min(1.0, TEXT_EVIDENCE / max(1, len(codes)))).tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(declared, pa.string()), pa.array(scores, pa.list_(pa.float64()))], names=names)

    names = [key, "host", "domain", "suffix", "declared", "text"]
    return rows.mapInArrow(run, f"`{key}` {kind}, host string, domain string, suffix string, declared string, text array<double>")


def _normal(logs: list[Column]) -> list[Column]:
    top = F.greatest(*logs) if len(logs) > 1 else logs[0]
    shares = [F.exp(x - top) for x in logs]
    total = sum(shares[1:], shares[0])
    return [x / total for x in shares]


def identify(pages: DataFrame, languages: list[str], table: np.ndarray, key: str = "page_id") -> DataFrame:
    """(key, host, declared, text_lang, lang, probability): each page's likeliest language.

    Null or empty html and addresses give no evidence, the rest decides. Ties go to the
    first language by name. A page's own share is taken out of its host's counts. Repeated
    rows each come back and count as pages. Without labelled languages lang is null.
    """
    n = len(languages)
    if n == 0:
        return pick(pages, key, "url").select(key, host_of(F.col("url")).alias("host"), *[F.lit("").alias(c) for c in ("declared",)], F.lit(None).cast("string").alias("text_lang"), F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("probability"))
    seen = checkpoint(evidence(pages, languages, table, key))
    text = _normal([F.col("text")[i] for i in range(n)])
    soft = seen.select("*", *[p.alias(f"p{i}") for i, p in enumerate(text)])
    sums = [F.sum(f"p{i}").alias(f"s{i}") for i in range(n)]

    def counted(column: str, name: str) -> DataFrame:
        return soft.groupBy(column).agg(*[F.sum(f"p{i}").alias(f"{name}{i}") for i in range(n)])

    whole = soft.agg(*[F.coalesce(s, F.lit(0.0)).alias(f"w{i}") for i, s in enumerate(sums)]).first()
    overall = [whole[i] + SMOOTH for i in range(n)]
    prior = [x / sum(overall) for x in overall]
    # hosts, domains and suffixes: one row each, priors passed down from the wider to the narrower
    hosts = soft.groupBy("host", "domain", "suffix").agg(*[F.sum(f"p{i}").alias(f"h{i}") for i in range(n)])
    domains = hosts.groupBy(F.col("domain").alias("_d"), F.col("suffix").alias("_s")).agg(*[F.sum(f"h{i}").alias(f"d{i}") for i in range(n)])
    suffixes = counted("suffix", "x")
    total = lambda name: sum((F.col(f"{name}{i}") for i in range(1, n)), F.col(f"{name}0"))
    # likelihood of a suffix in each language, and its own prior for the hosts below it
    suffixes = suffixes.select("suffix", *[((F.col(f"x{i}") + SMOOTH) / (overall[i] + SMOOTH)).alias(f"ls{i}") for i in range(n)], *[((F.col(f"x{i}") + PARENT * prior[i]) / (total("x") + PARENT)).alias(f"ps{i}") for i in range(n)])
    domains = domains.join(suffixes, F.col("_s") == F.col("suffix")).select("_d", *[f"ls{i}" for i in range(n)], *[((F.col(f"d{i}") + PARENT * F.col(f"ps{i}")) / (total("d") + PARENT)).alias(f"pd{i}") for i in range(n)])
    hosts = hosts.join(domains, F.col("domain") == F.col("_d")).select(F.col("host").alias("_h"), *[f"h{i}" for i in range(n)], *[f"pd{i}" for i in range(n)], *[f"ls{i}" for i in range(n)])
    declared = counted("declared", "c").select(F.col("declared").alias("_l"), *[((F.col(f"c{i}") + SMOOTH) / (overall[i] + SMOOTH)).alias(f"ld{i}") for i in range(n)])
    joined = soft.join(hosts, F.col("host") == F.col("_h"), "left").join(declared, F.col("declared") == F.col("_l"), "left")
    others = F.greatest(total("h") - 1, F.lit(0.0))
    fused = []
    for i in range(n):
        by_host = (F.greatest(F.col(f"h{i}") - F.col(f"p{i}"), F.lit(0.0)) + PARENT * F.col(f"pd{i}")) / (others + PARENT)
        has = F.when(F.col("declared") != "", F.log(f"ld{i}")).otherwise(0.0)
        named = F.when(F.col("suffix") != "", F.log(f"ls{i}")).otherwise(0.0)
        fused.append(F.col("text")[i] + has + named + F.log(F.greatest(by_host, F.lit(1e-9))))
    done = joined.select(key, "host", "declared", *[f"p{i}" for i in range(n)], *[p.alias(f"q{i}") for i, p in enumerate(_normal(fused))])

    def best(name: str) -> Column:
        return F.array_max(F.array(*[F.struct(F.col(f"{name}{i}").alias("p"), F.lit(-i).alias("i"), F.lit(x).alias("lang")) for i, x in enumerate(languages)]))

    return done.select(key, "host", "declared", best("p")["lang"].alias("text_lang"), best("q").alias("_b")).select(key, "host", "declared", "text_lang", F.col("_b.lang").alias("lang"), F.col("_b.p").alias("probability"))
