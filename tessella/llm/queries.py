"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import bpe, chat, decontaminate, html_blocks, langid, secrets, simhash, sketch, token_scan, toxicity
from tessella.llm.common import new_path, table, written

RANKS = "byte_bpe_50k.tiktoken"
#: The id after the last of RANKS, free to end documents with.
END_OF_DOCUMENT = 50256


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(simhash.fingerprints(table(spark, sf_dir, "documents")))
    return found.select("doc_id", simhash.hex_digits().alias("fingerprint"), "component_id")


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("bigint"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.summary(decontaminate.find_hits(docs, table(spark, sf_dir, "benchmark")))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.summary(docs, secrets.find_secrets(docs))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(control).alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.digest(chat.format_windows(rows, public_tokenizers.path(RANKS), public_tokenizers.PATTERN))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scorer = toxicity.trained(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select("doc_id", "text"), scorer)
    return scored.select(
        "doc_id",
        (toxicity.fold_of(F.col("doc_id")) == 1).alias("held_out"),
        F.col("_score").alias("score"),
        (F.col("_score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    languages, model = langid.fit_text_model(table(spark, sf_dir, "documents"))
    return langid.identify(table(spark, sf_dir, "pages"), languages, model)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as flat token files without an index in the shared folder, then counted from those files alone."""
    docs, path = table(spark, sf_dir, "documents"), new_path(spark, "token-files")
    placed = written(token_scan.write_files(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, END_OF_DOCUMENT, path), "token-places")
    files = token_scan.files_of(spark, path).join(placed.select("file").distinct(), "file", "left_semi")
    return token_scan.keyed(token_scan.count_files(files, END_OF_DOCUMENT), placed).select("doc_id", "n_tokens")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sketch.edited_and_next(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        sketch.as_text(F.col("sketch")).alias("fingerprint"),
        sketch.as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.digests(bpe.encode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, decoded=True))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": op1_simhash,
        "op2_html": op2_html,
        "op3_decontaminate": op3_decontaminate,
        "op4_secrets": op4_secrets,
        "op5_chat": op5_chat,
        "op6_toxicity": op6_toxicity,
        "op7_langid": op7_langid,
        "op8_token_counts": op8_token_counts,
        "op9_fingerprints": op9_fingerprints,
        "op10_bpe": op10_bpe,
    }


#: Words of a text as the decontamination operator takes them, in DuckDB.
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _secret_sql() -> str:
    """Places of matches from the lengths of the parts between them; letters in either case as classes."""
    words = "password|passwd|secret|token|api_?key"
    either = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in words)
    patterns = [(r, r.pattern.replace("(?i)", "").replace(words, either).replace("'", "''")) for r in secrets.RULES]
    found = " UNION ALL ".join(
        f"SELECT n, t, {k} AS rank, '{r.kind}' AS kind, {r.least} AS least, string_split_regex(t, '{p}') AS gap, regexp_extract_all(t, '{p}') AS hit, regexp_extract_all(t, '{p}', {r.group}) AS own FROM d"
        for k, (r, p) in enumerate(patterns)
    )
    counts = ", ".join(f"CAST(count(s) FILTER (kind = '{r.kind}') AS BIGINT) AS n_{r.kind}" for r in secrets.BASE)
    listed = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank)"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS n FROM documents),
        f AS ({found}),
        m AS (SELECT n, rank, kind, least, length(own[i]) AS size, length(hit[i]) AS len,
              list_sum(list_transform(gap[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hit[1:i - 1], lambda x: length(x))), 0) AS s FROM f, LATERAL unnest(range(1, len(hit) + 1)) AS u(i)),
        k AS (SELECT n, rank, kind, CAST(s AS BIGINT) AS s, CAST(s + len AS BIGINT) AS e FROM m WHERE size >= least)
        SELECT doc_id, {counts}, sha256(coalesce({listed} FILTER (rank < {len(secrets.BASE)}), '')) AS base_sha256, coalesce({listed}, '') AS spans
        FROM d LEFT JOIN k USING (n) GROUP BY n, doc_id"""


def oracle_sql() -> dict[str, str]:
    return {
        "op4_secrets": _secret_sql(),
        "op3_decontaminate": f"""
            WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
            b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
            n AS (SELECT item, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
            win AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM n, LATERAL unnest(range(1, len(w) - n + 2)) AS u(i)),
            sizes AS (SELECT DISTINCT n FROM win),
            dw AS (SELECT doc_id, i, s.n, array_to_string(w[i:i + s.n - 1], ' ') AS g FROM d, sizes s, LATERAL unnest(range(1, len(w) - s.n + 2)) AS u(i)),
            hits AS (SELECT doc_id, i, dw.n, item FROM dw JOIN win ON dw.n = win.n AND dw.g = win.g),
            hw AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM hits, LATERAL unnest(range(0, n)) AS u(k) GROUP BY doc_id),
            hi AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
            SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
                   CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
            FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
        """,
    }
