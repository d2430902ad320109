"""Secret scans over a trigram inverted index, in DataFrame operations only.

Each rule's regular expression yields a Boolean query over trigrams that every match must
hold. Postings (trigram, document) of the rules' trigrams are intersected and united as
the queries say; the documents left are read again and matched. Rules without mandatory
trigrams scan all texts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from re import _constants as kinds
from re import _parser as parser

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import by_place, maybe_in, pick, written


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a pattern that Java and Python read alike; a match is kept if its group has as many characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The base rules, and further ones whose forms their issuers publish.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    # a greedy run has all it can, so a least length in the pattern equals dropping shorter matches
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
ADDED = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    # a bounded header, or a long run of "eyJ" would be tried from each of them to its end
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{1,1000}\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)
RULES = BASE + ADDED

#: A set of literal strings with more members is treated as unknown text.
MOST_STRINGS = 64

# A query is True (no condition), ("tri", trigram), ("and", queries) or ("or", queries).
Query = bool | tuple


def _and(parts: list[Query]) -> Query:
    flat: dict[Query, None] = {}
    for p in parts:
        if p is not True:
            flat |= dict.fromkeys(p[1] if p[0] == "and" else [p])
    return True if not flat else next(iter(flat)) if len(flat) == 1 else ("and", tuple(flat))


def _or(parts: list[Query]) -> Query:
    """Alternatives; one that asks for all another asks for, and more, adds nothing and goes."""
    if not parts or True in parts:
        return True
    flat = dict.fromkeys(q for p in parts for q in (p[1] if p[0] == "or" else [p]))
    needs = {p: set(p[1]) if p[0] == "and" else {p} for p in flat}
    kept = [p for p in flat if not any(needs[q] < needs[p] for q in flat)]
    return kept[0] if len(kept) == 1 else ("or", tuple(kept))


def _of_strings(strings: set[str]) -> Query:
    """What a text holding one of these strings must hold."""
    return _or([_and([("tri", s[i : i + 3]) for i in range(len(s) - 2)]) for s in sorted(strings)])


def trigram_query(pattern: str) -> Query:
    """The trigrams, in lower case, that a text with a match of the pattern must hold."""
    exact, query = _walk(parser.parse(pattern))
    return _and([query, _of_strings(exact)]) if exact is not None else query


def _walk(tree) -> tuple[set[str] | None, Query]:
    """The strings a part can match, if they are few (else None), and what it needs besides."""
    run: set[str] | None = {""}
    needs: list[Query] = []
    whole = True
    for op, arg in tree:
        strings, need = _one(op, arg)
        needs.append(need)
        if strings is not None and len(run) * len(strings) <= MOST_STRINGS:
            run = {a + b for a in run for b in strings}
            continue
        needs.append(_of_strings(run))
        whole = False
        run = strings if strings is not None else {""}
    if whole:
        return run, _and(needs)
    return None, _and([*needs, _of_strings(run)])


def _one(op, arg) -> tuple[set[str] | None, Query]:
    if op is kinds.LITERAL:
        return {chr(arg).lower()}, True
    if op is kinds.IN:
        found: set[str] = set()
        for kind, x in arg:
            if kind is kinds.LITERAL:
                found.add(chr(x).lower())
            elif kind is kinds.RANGE and x[1] - x[0] < MOST_STRINGS:
                found |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None, True
        return (found, True) if len(found) <= 8 else (None, True)
    if op is kinds.SUBPATTERN:
        return _walk(arg[3])
    if op is kinds.BRANCH:
        parts = [_walk(x) for x in arg[1]]
        if all(s is not None for s, _ in parts) and sum(len(s) for s, _ in parts) <= MOST_STRINGS:
            return set().union(*(s for s, _ in parts)), _or([q for _, q in parts])
        return None, _or([_and([q, _of_strings(s)]) if s is not None else q for s, q in parts])
    if op in (kinds.MAX_REPEAT, kinds.MIN_REPEAT):
        low, high, body = arg
        strings, need = _walk(body)
        if low == 0:
            return ({""} | strings, True) if high == 1 and strings is not None else (None, True)
        if low == high == 1:
            return strings, need
        return None, _and([need, _of_strings(strings)]) if strings is not None else need
    if op is kinds.AT:
        return {""}, True
    return None, True


def trigrams_of(query: Query) -> set[str]:
    if query is True:
        return set()
    return {query[1]} if query[0] == "tri" else set().union(*map(trigrams_of, query[1]))


def build_index(docs: DataFrame, trigrams: list[str], key: list[str], text: str = "text") -> DataFrame:
    """The postings (trigram, key): which texts hold which of the trigrams, letters in either case.

    Lower-casing loses no ASCII letter, so no text that a query needs is missed.
    """
    lower = F.lower(text)
    held = F.filter(F.array(*[F.when(F.contains("_lower", F.lit(t)), F.lit(t)) for t in trigrams]), lambda t: t.isNotNull())
    return docs.select(*key, lower.alias("_lower")).select(*key, F.explode(held).alias("trigram"))


def candidates(postings: DataFrame, queries: dict[str, Query], key: list[str]) -> DataFrame:
    """(key, _kinds): the texts whose postings satisfy some of the queries, and which.

    A text's posting lists meet in one row of flags, one for each trigram; the queries
    intersect and unite those.
    """
    trigrams = sorted(set().union(*map(trigrams_of, queries.values())))
    flags = postings.groupBy(*key).agg(*[F.bool_or(F.col("trigram") == t).alias(_flag(t)) for t in trigrams])
    kinds = F.filter(F.array(*[F.when(_holds(q), F.lit(k)) for k, q in queries.items()]), lambda k: k.isNotNull())
    return flags.select(*key, kinds.alias("_kinds")).where(F.size("_kinds") > 0)


def _flag(trigram: str) -> str:
    return "t" + trigram.encode().hex()


def _holds(query: Query) -> Column:
    if query[0] == "tri":
        return F.col(_flag(query[1]))
    parts = [_holds(q) for q in query[1]]
    return reduce(lambda a, b: a & b if query[0] == "and" else a | b, parts)


def _lengths(rule: Rule) -> Column:
    """Of each of the rule's matches, in order: the lengths of the gap before it, of itself and of its group.

    A text split at the matches has one part more than matches. Null if there are none.
    """
    split, found = F.split("_text", rule.pattern, -1), F.regexp_extract_all("_text", F.lit(rule.pattern), F.lit(0))
    group = F.regexp_extract_all("_text", F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    zipped = F.arrays_zip(split.alias("gap"), found.alias("match"), group.alias("group"))
    each = F.transform(zipped, lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["match"]).alias("match"), F.length(x["group"]).alias("group")))
    return F.when(F.col("_text").rlike(rule.pattern), each)


def _scanned(texts: DataFrame, rules: tuple[Rule, ...], key: list[str], wanted: Column | None = None) -> DataFrame:
    """(key, kind, i, x): the matches of the rules (of those that ``wanted`` lists) in one pass over the texts."""
    kinds = F.array(*[F.struct(F.lit(r.kind).alias("kind"), _lengths(r).alias("each")) for r in rules])
    if wanted is not None:
        kinds = F.array(*[F.when(F.array_contains(wanted, r.kind), F.struct(F.lit(r.kind).alias("kind"), _lengths(r).alias("each"))) for r in rules])
    found = texts.select(*key, F.explode(F.filter(kinds, lambda k: k["each"].isNotNull())).alias("_k"))
    return found.select(*key, F.col("_k.kind").alias("kind"), F.posexplode("_k.each").alias("i", "x")).where("x.match is not null")


def _places(matches: DataFrame, rules: tuple[Rule, ...], key: list[str]) -> DataFrame:
    """(key, kind, start, end) of the kept matches, in code points, end exclusive: running sums of gaps and matches.

    Rows repeated with key and text give each match once. A window holds one text's matches of one rule.
    """
    before = Window.partitionBy(*key, "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("x.gap").cast("bigint") + F.col("x.match")).over(before)
    least = F.coalesce(*[F.when(F.col("kind") == r.kind, F.lit(r.least)) for r in rules])
    each = matches.distinct().select(*key, "kind", (end - F.col("x.match")).alias("start"), end.alias("end"), F.col("x.group").alias("_size"))
    return each.where(F.col("_size") >= least).drop("_size")


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, _hash, kind, start, end): every kept match of every rule.

    For each rule, leftmost matches that don't overlap, in code points. Null texts count as
    empty. Rows are told apart by key and a hash of the text; rows repeated with both give
    each span once. An empty table has no spans; extra columns are left out. The index, and
    the candidates that it leaves, are written to the shared folder.
    """
    rows = pick(docs, key, text).select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = rows.select(F.col(key), F.xxhash64("_text").alias("_hash"), "_text")
    by = [key, "_hash"]
    plans = {r: trigram_query(r.pattern) for r in rules}
    indexed = tuple(r for r, q in plans.items() if q is not True)
    scanned = tuple(r for r, q in plans.items() if q is True)
    found = []
    if indexed:
        queries = {r.kind: plans[r] for r in indexed}
        postings = written(build_index(rows, sorted(set().union(*map(trigrams_of, queries.values()))), by, "_text"), "postings")
        wanted = written(candidates(postings, queries, by), "wanted")
        left, right = maybe_in(rows, "_hash", wanted).alias("l"), wanted.alias("r")
        same = F.col(f"l.{key}").eqNullSafe(F.col(f"r.{key}")) & (F.col("l._hash") == F.col("r._hash"))
        texts = written(left.join(right, same).select(*[f"l.{c}" for c in rows.columns], "r._kinds"), "candidates")
        found.append(_scanned(texts, indexed, by, F.col("_kinds")))
    if scanned:
        found.append(_scanned(rows, scanned, by))
    return _places(reduce(DataFrame.unionByName, found), rules, by)


def summary(docs: DataFrame, spans: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: counts of the base kinds, a digest of base spans, and all spans as a string."""
    order = F.array(*[F.lit(r.kind) for r in rules])
    one = F.struct("start", F.array_position(order, F.col("kind")).alias("rank"), "end", "kind")
    base = [r.kind for r in BASE]
    counts = [F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in base]
    grouped = spans.groupBy(key, "_hash").agg(*counts, F.sort_array(F.collect_list(one)).alias("_spans"))
    rows = pick(docs, key, text).select(F.col(key), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_hash"))
    same = F.col(f"l.{key}").eqNullSafe(F.col(f"r.{key}")) & (F.col("l._hash") == F.col("r._hash"))
    joined = rows.alias("l").join(grouped.alias("r"), same, "left")

    def listed(kept: Column) -> Column:
        text = F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
        return F.coalesce(text, F.lit(""))

    return joined.select(
        F.col(f"l.{key}").alias(key),
        *[F.coalesce(f"r.n_{k}", F.lit(0)).cast("bigint").alias(f"n_{k}") for k in base],
        F.sha2(listed(F.filter("r._spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        listed(F.col("r._spans")).alias("spans"),
    )


def redact(docs: DataFrame, spans: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with every span replaced by ``[kind]``; overlapping spans are one, named by the first.

    All columns and rows stay, whatever the columns' names; texts without spans are
    unchanged, null texts stay null. An empty table gives no rows.
    """
    order = Window.partitionBy(key, "_hash").orderBy("start", F.desc("end"), "kind")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("_new", (F.col("start") >= F.coalesce(reach, F.lit(-1))).cast("int"))
    marked = marked.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = marked.groupBy(key, "_hash", "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max(F.when(F.col("_new") == 1, F.col("kind"))).alias("kind"))
    after = Window.partitionBy(key, "_hash").orderBy("start")
    runs = runs.withColumn("_from", F.coalesce(F.lag("end").over(after), F.lit(0)))
    listed = runs.groupBy(key, "_hash").agg(F.sort_array(F.collect_list(F.struct("_from", "start", "end", "kind"))).alias("_runs"))
    listed = listed.select(F.col(key).alias("_rkey"), F.col("_hash").alias("_rhash"), "_runs")
    own, names = by_place(docs), docs.columns
    id_, body = F.col(f"_c{names.index(key)}"), F.col(f"_c{names.index(text)}")
    joined = own.join(listed, id_.eqNullSafe(F.col("_rkey")) & (F.xxhash64(F.coalesce(body, F.lit(""))) == F.col("_rhash")), "left")
    part = lambda r: F.concat(F.substring(body, r["_from"].cast("int") + 1, (r["start"] - r["_from"]).cast("int")), F.lit("["), r["kind"], F.lit("]"))
    rest = F.substring(body, F.element_at("_runs", -1)["end"].cast("int") + 1, F.length(body))
    clean = F.when(F.col("_runs").isNull(), body).otherwise(F.concat(F.array_join(F.transform("_runs", part), ""), rest))
    return joined.withColumn(f"_c{names.index(text)}", clean).select(*own.columns).toDF(*names)
