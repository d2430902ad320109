"""Operators against plain Python or numpy, on hand-made tables."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella import schema
from tessella.functions.text import BLOB_HEADER, HEADER, JUNK
from tessella.operators import affinity as af
from tessella.operators import direction as di
from tessella.operators import encode as en
from tessella.operators import inference as inf
from tessella.operators import resample as rs
from tessella.operators import segment as sg
from tessella.operators import textmodel as tm

# affinity


def members_and_reference(spark, seed=3, size=8):
    rng = np.random.default_rng(seed)
    unit = lambda v: (v / np.linalg.norm(v)).tolist()
    rows, n = [], 0
    for c in range(5):
        for role, author in [("majority", 0), ("majority", 1), ("dissent", 0), ("concurrence", 0)]:
            if c == 4 and role == "dissent":
                continue
            for _ in range(int(rng.integers(1, 7))):
                rows.append((n, f"c{c}", role, author, unit(rng.normal(size=size))))
                n += 1
    ref = [(j, unit(rng.normal(size=size))) for j in range(38)]
    m = spark.createDataFrame(rows, "id bigint, case string, role string, author int, v array<double>")
    r = af.with_section(af.reference(spark.createDataFrame(ref, "para_id bigint, v array<double>"), 38), schema.sections(spark))
    return rows, ref, m, r


def section_of(j):
    return next((n for n, lo, hi in schema.SECTION_RANGES if lo <= j < hi), schema.OUTSIDE)


def plain_deltas(rows, ref, least):
    u = np.array([v for _, v in ref])
    zone, warn = [[j for j in range(38) if section_of(j) in names] for names in (schema.ZONES, schema.WARNING)]
    out = {}
    for c in sorted({r[1] for r in rows}):
        ops = {}
        for r in rows:
            if r[1] == c:
                ops.setdefault((r[2], r[3]), []).append(r[4])
        ops = {k: np.array(v) for k, v in ops.items() if len(v) >= least}
        if not {"majority", "dissent"} <= {k[0] for k in ops}:
            continue
        s = np.array([(v @ u.T).mean(0) for v in ops.values()])
        res = s - s.mean(1, keepdims=True) - s.mean(0, keepdims=True) + s.mean()
        f = 1000 * (res[:, zone].mean(1) - res[:, warn].mean(1))
        side = lambda x: np.mean([f[i] for i, k in enumerate(ops) if k[0] == x])  # noqa: B023, E731
        out[c] = (side("majority"), side("dissent"))
    return out


@pytest.mark.parametrize("least", [1, 3])
def test_delta(spark, least):
    rows, ref, m, r = members_and_reference(spark)
    want = plain_deltas(rows, ref, least)
    got = {x["case"]: (x["f_maj"], x["f_dis"]) for x in af.delta(m, r, least).collect()}
    assert got.keys() == want.keys() and "c4" not in got
    for c, pair in want.items():
        assert got[c] == pytest.approx(pair, abs=1e-9)
    fast = {x["case"]: x["delta"] for x in af.delta_fast(m, r, least).collect()}
    assert fast == pytest.approx({c: a - b for c, (a, b) in want.items()}, abs=1e-9)


def test_residuals_have_zero_margins(spark):
    _, _, m, r = members_and_reference(spark)
    res = af.double_centred(af.similarities(af.groups(m, 1), r))
    for by in (["case", "role", "author"], ["case", "j"]):
        assert res.groupBy(*by).agg(F.abs(F.sum("r")).alias("x")).agg(F.max("x")).first()[0] < 1e-12


def test_dropped_passages(spark):
    rows, ref, m, r = members_and_reference(spark)
    profile = af.case_profile(af.similarities(af.groups(m, 1), r))
    got = {x["dropped"]: x["mean_delta"] for x in af.drop_each(profile).collect()}
    assert sorted(got) == [3, 4, 5, 33, 34, 35, 36, 37]
    base = np.mean([a - b for a, b in plain_deltas(rows, ref, 1).values()])
    assert min(got.values()) <= base <= max(got.values())


def test_ties_go_to_the_lowest(spark):
    v = [1.0, 0.0]
    ref = af.with_section(af.reference(spark.createDataFrame([(i, v) for i in range(5)], "para_id bigint, v array<double>"), 38), schema.sections(spark))
    m = spark.createDataFrame([(9, "c", "majority", 0, v), (8, "c", "majority", 0, v)], "id bigint, case string, role string, author int, v array<double>")
    assert {x["j"] for x in af.nearest_passage(m, ref, ["id"]).collect()} == {0}
    assert {x["id"] for x in af.closest_member(m, ref, "id").collect()} == {8}
    assert af.delta(m, ref, 1).count() == 0  # one-sided


def test_overlay(spark):
    base = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "para_id int, v array<double>")
    new = spark.createDataFrame([(2, [9.0]), (3, [7.0])], "para_id int, v array<double>")
    assert sorted(map(tuple, af.overlay(base, new).collect())) == [(1, [1.0], False), (2, [9.0], True)]
    assert [tuple(r) for r in af.overlay(base, new, only_new=True).collect()] == [(2, [9.0], True)]


def test_contrast_bootstrap_observed(spark):
    rows, ref, m, r = members_and_reference(spark, 4)
    u = np.array([v for _, v in ref])
    own = [x for x in rows if x[1] == "c1"]
    groups = {k: np.array([x[4] for x in own if (x[2], x[3]) == k]) for k in {(x[2], x[3]) for x in own}}
    s = {k: (v @ u.T).mean(0) for k, v in groups.items()}
    mean = np.mean([v for k, v in s.items()], 0)
    res = {k: v - v.mean() - mean + mean.mean() for k, v in s.items()}
    warn = [j for j in range(38) if section_of(j) in schema.WARNING]
    weights = {("majority", 0): 1.0, ("majority", 1): -0.5, ("dissent", 0): -0.5}
    want = 1000 * sum(w * res[k][warn].mean() for k, w in weights.items())
    observed, draws = rs.contrast_bootstrap(m.where("case = 'c1'"), r, weights, 50, 1)
    assert {x["name"]: x["obs"] for x in observed.collect()}["c1"] == pytest.approx(want, abs=1e-9)
    assert draws.count() == 100


# directions


def stance_rows(seed=2, cases=6, size=4):
    rng = np.random.default_rng(seed)
    rows, n = [], 0
    for c in range(cases):
        for o in range(4):
            s = 1 if o % 2 and c != 5 else -1
            for _ in range(int(rng.integers(1, 5))):
                rows.append((n, f"c{c}", o, s, (rng.normal(size=size) + s * 0.5).tolist()))
                n += 1
    return rows


def plain_fit(rows, leave=None):
    diffs = []
    for c in sorted({r[1] for r in rows} - {leave}):
        p, q = [np.array([r[4] for r in rows if r[1] == c and r[3] == s]) for s in (1, -1)]
        if len(p) and len(q):
            diffs.append(p.mean(0) - q.mean(0))
    d = np.mean(diffs, 0) / 2
    return d / np.linalg.norm(d)


def test_direction_and_leave_one_out(spark):
    rows = stance_rows()
    lab = spark.createDataFrame(rows, "id bigint, case string, opinion int, s int, v array<double>")
    got = di.fit(di.differences(lab)).first()
    assert got["delta"] == pytest.approx(plain_fit(rows).tolist()) and got["n"] == 5
    scores = {x["id"]: x["score"] for x in di.loo_scores(lab).collect()}
    for c in {r[1] for r in rows}:
        own = np.array([r[4] for r in rows if r[1] == c])
        want = (own - own.mean(0)) @ plain_fit(rows, c)
        assert [scores[r[0]] for r in rows if r[1] == c] == pytest.approx(want.tolist())
    perms = di.label_permutations(lab, 5, 11).collect()
    assert len(perms) == 5 and all(0 <= x["auc"] <= 1 for x in perms)


def test_null_labels_drop(spark):
    m = spark.createDataFrame([(1, "a", 1), (2, "a", 2), (3, "b", 1)], "id int, case string, opinion int")
    labels = spark.createDataFrame([("a", 1, 1), ("a", 2, None)], "case string, opinion int, label int")
    assert [tuple(r) for r in di.with_labels(m, labels, ["case", "opinion"]).collect()] == [("a", 1, 1, 1)]


# tests


def brute_auc(pairs):
    pos, neg = [s for y, s in pairs if y], [s for y, s in pairs if not y]
    return np.mean([(p > q) + 0.5 * (p == q) for p in pos for q in neg])


def test_auc(spark):
    rng = random.Random(3)
    pairs = [(rng.random() < 0.4, rng.randrange(6) / 2) for _ in range(200)]
    df = spark.createDataFrame([(int(y), float(s)) for y, s in pairs], "y int, score double")
    got = inf.auc(df).first()["auc"]
    assert got == pytest.approx(brute_auc(pairs))
    assert inf.auc(df.withColumn("score", -F.col("score"))).first()["auc"] == pytest.approx(1 - got)
    assert inf.auc(df.withColumn("y", F.lit(1))).first()["auc"] is None


def test_wilcoxon_and_gap(spark):
    d = [1.0, -2.0, 3.0, 4.0, 0.0]
    df = spark.createDataFrame([(f"c{i}", x) for i, x in enumerate(d)], "case string, delta double")
    r = inf.wilcoxon(df).first()
    assert (r["w"], r["n"]) == (8.0, 4) and r["p"] == pytest.approx(3 / 16)
    tied = inf.wilcoxon(spark.createDataFrame([("a", 1.0), ("b", -1.0), ("c", 2.0)], "case string, delta double")).first()
    assert tied["w"] == 4.5 and 0.2 < tied["p"] < 0.5
    rest = np.array([1.0, -2.0, 3.0, 0.0])
    assert inf.studentised_gap(df).first()["g"] == pytest.approx((4 - rest.mean()) / rest.std(ddof=1))
    flat = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 1.0)], "case string, delta double")
    assert inf.studentised_gap(flat).first()["g"] == 0.0


def test_mann_whitney_and_spearman(spark):
    rows = [("k", "x", 1.0), ("k", "x", 2.0), ("k", "x", 4.0), ("k", "y", 2.0), ("k", "y", 0.5)]
    r = inf.mann_whitney(spark.createDataFrame(rows, "k string, g string, v double"), ["k"], "g", "x", "y", "v").first()
    assert r["u"] == 4.5 and (r["n1"], r["n2"]) == (3, 2) and 0.4 < r["p"] < 0.7
    s = spark.createDataFrame([("k", float(a), float(b)) for a, b in ((1, 10), (2, 20), (3, 15), (4, 40))], "k string, x double, y double")
    assert inf.spearman(s, ["k"], "x", "y").first()["rho"] == pytest.approx(0.8)


# segments


LINES = [
    ("d", 0, 0, 72.0, 11.0, "First line of text"), ("d", 0, 1, 75.9, 11.0, "goes on here"), ("d", 0, 2, 76.1, 11.0, "an indented one"), ("d", 0, 3, 72.0, 7.9, "tiny"),
    ("d", 0, 4, 117.0, 11.0, "indent of 45"), ("d", 0, 5, 118.0, 11.0, "II"), ("d", 0, 6, 72.0, 11.0, "after a heading"), ("d", 0, 7, 118.0, 11.0, "a far line that is long enough to count as text"),
    ("d", 0, 8, 72.0, 9.0, "1 a footnote"), ("d", 0, 9, 72.0, 9.0, "goes on"), ("d", 0, 10, 72.0, 9.0, "2 another"), ("d", 0, 11, 72.0, 11.0, "Syllabus"),
    ("d", 1, 0, 72.0, 9.0, "note on a page without body"), ("d", 2, 0, 72.0, 11.0, "be­ half of a page"), ("d", 2, 1, 72.0, 11.0, "   "), ("d", 2, 2, 72.0, 11.0, "x"), ("e", 0, 0, 50.0, 11.0, "y"),
]


def plain_session(lines):
    out = {}
    for doc in sorted({x[0] for x in lines}):
        cur, foot, made = [], False, []

        def flush():
            nonlocal cur
            t = re.sub(r"\s+", " ", re.sub("­\\s*", "", " ".join(cur))).strip()  # noqa: B023
            if len(t) > 1:
                made.append((t, foot))  # noqa: B023
            cur = []

        for page in sorted({x[1] for x in lines if x[0] == doc}):
            own = [x for x in lines if x[0] == doc and x[1] == page and x[5].strip()]
            body = [round(x[3]) for x in own if x[4] >= 10.4]
            if not body:
                continue
            margin = max(dict.fromkeys(body), key=body.count)
            for *_, x0, sz, t in own:
                t, dx, small = t.strip(), x0 - margin, sz < 10.4
                if sz < 8:
                    continue
                if re.match(JUNK, t) or (dx > 45 and len(t) <= 40):
                    flush()
                    continue
                if 4 < dx <= 45 or (small and re.match(r"\d+\s", t)) or small != foot:
                    flush()
                    foot = small
                cur.append(t)
            flush()
        out[doc] = made
    return out


def random_lines(seed):
    rng = random.Random(seed)
    pool = ["text of a line", "12 note", "II", "Opinion of the Court", "be­", "half", "x", "   ", "a line that is rather long so that it is no heading at all", "7"]
    return [(f"d{d}", p, n, rng.choice([72.0, 72.4, 75.0, 80.0, 117.0, 130.0]), rng.choice([7.0, 9.0, 11.0, 11.0, 12.0]), rng.choice(pool)) for d in range(30) for p in range(3) for n in range(rng.randint(1, 9))]


@pytest.mark.parametrize("lines", [LINES, random_lines(1), random_lines(2)])
def test_laid_out_paragraphs(spark, lines):
    df = spark.createDataFrame(lines, "doc string, page int, line_no int, x0 double, sz double, t string")
    got = {}
    for r in sg.laid_out_paragraphs(df).orderBy("doc", "para_no").collect():
        got.setdefault(r["doc"], []).append((r["text"], r["is_footnote"]))
    assert got == {k: v for k, v in plain_session(lines).items() if v}


BLOBS = [
    (1, "Lead " * 200 + "\nJustice Roe, with whom Justice Poe joins, dissenting. Text.\nMr. Chief Justice Doe delivered the opinion of the Court. More."),
    (2, "Short lead.\nJustice Roe, concurring in part and dissenting in part. A\n b\nJustice Poe, concurring. B"),
    (3, "Justice Roe, dissenting. Only one."),
    (4, ""),
    (5, None),
]


def test_split_blobs(spark):
    df = spark.createDataFrame(BLOBS, "doc_id int, text string")
    got = {}
    for r in sg.split_blobs(df, author=F.lit("Parent"), kind=F.lit("lead")).orderBy("doc_id", "piece").collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["end"], r["author"], r["type"]))
    for key, text in BLOBS:
        text = text or ""
        marks = [m.start(1) for m in re.finditer(BLOB_HEADER, text)]
        if len(marks) <= 1:
            assert got[key] == [(0, len(text), "Parent", "lead")]
        else:
            cuts = ([0] if marks[0] > 500 else []) + marks
            assert [x[:2] for x in got[key]] == list(zip(cuts, [*cuts[1:], len(text)], strict=True))
    assert [x[2:] for x in got[1]] == [("Parent", "lead"), ("Roe", "dissent"), ("Doe", "majority")]
    assert [x[2:] for x in got[2]] == [("Roe", "mixed"), ("Poe", "concurrence")]


def test_split_laid_out(spark):
    paras = [
        ("d", 0, "Syllabus text that is dropped.", False),
        ("d", 1, "CHIEF JUSTICE O’ROE delivered the opinion of the Court. Text of it.", False),
        ("d", 2, "Body of the first.", False),
        ("d", 3, "1 a note", True),
        ("d", 4, "End of it. JUSTICE POE, with whom JUSTICE DOE joins, dissenting. In the middle.", False),
        ("d", 5, "Body of the second.", False),
        ("e", 0, "No header here.", False),
    ]
    df = spark.createDataFrame(paras, "doc string, para_no int, text string, is_footnote boolean")
    rows = sg.split_laid_out(df).orderBy("para_no").collect()
    assert [(r["para_no"], r["author"], r["opinion_type"]) for r in rows] == [(1, "O’Roe", "majority"), (2, "O’Roe", "majority"), (3, "O’Roe", "majority"), (4, "O’Roe", "majority"), (5, "Poe", "dissent")]
    assert re.search(HEADER, paras[4][2])[1] == "POE"
    assert [tuple(r) for r in sg.opinion_inventory(sg.split_laid_out(df), ["author"]).orderBy("author").collect()] == [("O’Roe", 3, 1), ("Poe", 1, 0)]


def test_archive_opinions(spark):
    raw = [("k", "Name", 1990, [("Mr. Justice Roe", "majority", "Only text."), ("", "dissent", BLOBS[1][1])]), ("e", "Empty", 1991, [])]
    df = spark.createDataFrame([(a, b, c, [{"author_str": x, "type": y, "text": z} for x, y, z in d]) for a, b, c, d in raw], "key string, case_name string, year int, sub_opinions array<struct<author_str:string,type:string,text:string>>")
    rows = sg.archive_opinions(df).orderBy("opinion_idx").collect()
    assert [(r["author"], r["type"]) for r in rows] == [("Roe", "majority"), ("Roe", "mixed"), ("Poe", "concurrence")]
    assert rows[0]["header"] == "Mr. Justice Roe" and rows[1]["text"].startswith("Justice Roe, concurring")


def test_numbers(spark):
    docs = [(0, "a b\n\n c d \nx\nlong line"), (5000, "one line"), (9000, ""), (12000, "yy\nzz")]
    rows = sg.number(sg.paragraphs(spark.createDataFrame(docs, "doc_id bigint, text string"))).orderBy("para_id").collect()
    assert [(r["para_id"], r["text"]) for r in rows] == list(enumerate(["a b", "c d", "long line", "one line", "yy", "zz"]))


# encoder and text model


@pytest.mark.parametrize("n", [0, 1, 510, 511, 894, 895, 1000, 1278])
def test_chunks(spark, n):
    want, at = [], 0
    for at in range(0, max(n, 1), 384):
        want.append((at // 384, at, min(max(n, 1), at + 510)))
        if at + 510 >= n:
            break
    got = spark.range(1).select(F.explode(en.chunk_bounds(F.lit(n))).alias("c")).select("c.*").collect()
    assert [tuple(r) for r in got] == want
    ids = spark.createDataFrame([(1, list(range(n)))], "k int, ids array<int>")
    framed = en.chunks(ids, "k", "ids").orderBy("chunk_no").collect()
    assert [len(r["ids"]) for r in framed] == [hi - lo + 2 for _, lo, hi in want] and framed[0]["ids"][0] == 101


def test_hashed_encoder(spark):
    df = spark.createDataFrame([(1, "some words here"), (2, "some words here"), (3, ""), (4, None), (5, "word " * 1200)], "k int, t string")
    got = {r["k"]: r["embedding"] for r in en.hashed_encoder(df, "k", "t", 16).collect()}
    assert got[1] == got[2] and all(sum(x * x for x in got[k]) == pytest.approx(1, abs=1e-5) for k in (1, 2, 5))
    assert set(got[3]) == {0.0} and set(got[4]) == {0.0}


def test_tfidf(spark):
    docs = ["the cat sat", "the cat ran", "the dog ran off", "a cat", ""]
    df = spark.createDataFrame(list(enumerate(docs)), "k int, t string")
    got = {(r["k"], r["term"]): r["weight"] for r in tm.tfidf(df, "k", "t", min_df=2).collect()}
    idf = lambda d: np.log((1 + 5) / (1 + d)) + 1
    raw = {"the": idf(3), "cat": idf(3), "the cat": idf(2)}
    size = np.sqrt(sum(x * x for x in raw.values()))
    assert {t: w for (k, t), w in got.items() if k == 0} == pytest.approx({t: x / size for t, x in raw.items()})
    assert len({t for _, t in got}) == len({"the", "cat", "ran", "the cat"}) and not any(k == 4 for k, _ in got)


def test_single_class_fold(spark):
    rows = [(i, i % 2, int(i % 2), [float(i), 1.0]) for i in range(8)]
    df = spark.createDataFrame(rows, "id int, group int, y int, v array<double>")
    got = tm.leave_one_group_out(df, "v", iterations=5).collect()
    assert {(r["group"], r["prob"], r["predicted"]) for r in got} == {(0, 1.0, 1), (1, 0.0, 0)}


def test_vocabulary_is_exact_whatever_the_buckets(spark, monkeypatch):
    rng = np.random.default_rng(5)
    words = [f"w{int(x)}" for x in rng.zipf(1.3, 6000) if x < 10**9]
    rows = [(i % 90, " ".join(words[i * 40 : i * 40 + 40])) for i in range(150)]  # some keys have two texts
    tf = Counter()
    for i, t in rows:
        own = t.split()
        tf.update((i, x) for x in [*own, *map(" ".join, zip(own, own[1:]))])
    df, n = Counter(t for _, t in tf), Counter()
    for (_, t), x in tf.items():
        n[t] += x
    docs = spark.createDataFrame(rows, "k int, t string")
    for buckets, most in ((1 << 22, 30), (64, 5), (1 << 12, 20), (64, 10_000)):  # few buckets: more terms are counted, none is lost
        monkeypatch.setattr(tm, "FIRST_TRY", 2)
        want = sorted(((t, df[t], n[t]) for t in df if df[t] >= 3), key=lambda x: (-x[2], x[0]))[:most]
        assert tm.vocabulary(docs, tm.dealt_words(docs, "k", "t"), "t", 3, most, buckets) == want


def test_split_blobs_stays_in_its_rows(spark):
    one = "\nJustice Roe, dissenting in part. Some words é🙂.\nMr. Chief Justice Poe delivered the opinion. More"
    texts = [one * 700, "x" * 600 + one, one[1:], "\nJustice Roe, dissenting. Alone", "no header", "", None]  # more matches than two parts hold
    made = sg.split_blobs(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"))
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    got = [(r["doc_id"], r["piece"], r["start"], r["end"]) for r in made.orderBy("doc_id", "piece").collect()]
    want = []
    for k, t in enumerate(texts):
        at = [m.start(1) for m in re.finditer(BLOB_HEADER, t or "")]
        at = ([0] if at[0] > sg.LEAD else []) + at if len(at) > 1 else [0]
        want += [(k, i, a, b) for i, (a, b) in enumerate(zip(at, [*at[1:], len(t or "")]))]
    assert got == want


def test_fold_terms_are_those_of_the_other_groups(spark):
    rng = np.random.default_rng(6)
    rows = [(i, i % 3, " ".join(f"w{int(x)}" for x in rng.zipf(1.4, 40) if x < 10**9)) for i in range(120)]
    df = spark.createDataFrame(rows, "id int, group int, text string")
    words = tm.dealt_words(df, "id", "text", "group")
    for buckets in (1 << 12, 64):
        found = list(tm.fold_terms(words, tm.bucket_sums(df, "text", buckets), "group", [0, 1, 2], 4))
        for own, terms in enumerate(found):
            rest = df.where(f"group <> {own}")
            assert terms == tm.vocabulary(rest, tm.dealt_words(rest, "id", "text"), "text", max_terms=4)
