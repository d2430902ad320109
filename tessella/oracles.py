"""DuckDB SQL for the queries, written from their definitions and not from their plans."""

from __future__ import annotations

from tessella.schema import OUTSIDE, REFERENCE_SIZE, SECTION_RANGES

_SECTIONS = ", ".join(f"('{n}', {lo}, {hi})" for n, lo, hi in SECTION_RANGES)
_ZONE = "section IN ('Zone 1 - maximum power', 'Zone 2 - twilight', 'Zone 3 - lowest ebb')"
_WARN = "section = 'Structural warning'"
_CASE = "'c' || lpad(CAST(vec_id % 20 AS VARCHAR), 2, '0')"


def r(x: str, digits: int = 6) -> str:
    """x rounded, without a negative zero."""
    return f"CASE WHEN round({x}, {digits}) = 0 THEN CAST(0 AS DOUBLE) ELSE round({x}, {digits}) END"


def draw(*key: str) -> str:
    text = " || ':' || ".join(f"CAST({k} AS VARCHAR)" for k in key)
    return f"CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT)"


def order(*key: str) -> str:
    return "md5(" + " || ':' || ".join(f"CAST({k} AS VARCHAR)" for k in key) + ")"


_UNITS = """
    x AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
    e AS (SELECT vec_id, label, list_transform(x, lambda q: q / sqrt(list_dot_product(x, x))) AS u FROM x)"""

_BASE = f"""WITH {_UNITS},
    secs(name, lo, hi) AS (VALUES {_SECTIONS}),
    ref AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS j, u FROM e WHERE vec_id < {REFERENCE_SIZE}),
    js AS (SELECT j, u, coalesce(name, '{OUTSIDE}') AS section FROM ref LEFT JOIN secs ON j >= lo AND j < hi),
    p AS (SELECT vec_id AS id, {_CASE} AS c, CASE WHEN label <= 3 THEN 'majority' WHEN label <= 7 THEN 'dissent' ELSE 'concurrence' END AS role,
          CAST(label % 2 AS INTEGER) AS author, u AS v FROM e WHERE vec_id >= {REFERENCE_SIZE})"""


def _deltas(least: str = "4", keys: str = "", source: str = "p", sizes: str = "") -> str:
    """CTEs from p to d(c, f_maj, f_dis, delta), for one least size or, with keys, several."""
    k = f"{keys}, " if keys else ""
    on = f" AND s.{keys} = g.{keys}" if keys else ""
    return f"""
    g AS (SELECT {k}c, role, author, count(*) AS n FROM {source}{sizes} GROUP BY ALL HAVING count(*) >= {least}),
    ok AS (SELECT {k}c FROM g GROUP BY ALL HAVING bool_or(role = 'majority') AND bool_or(role = 'dissent')),
    kept AS (SELECT g.* FROM g JOIN ok USING ({k}c)),
    s AS (SELECT {k}{source}.c, {source}.role, {source}.author, j, section, avg(list_dot_product({source}.v, js.u)) AS s
          FROM {source} JOIN kept USING (c, role, author) CROSS JOIN js GROUP BY ALL),
    r AS (SELECT *, s - avg(s) OVER (PARTITION BY {k}c, role, author) - avg(s) OVER (PARTITION BY {k}c, j) + avg(s) OVER (PARTITION BY {k}c) AS r FROM s),
    f AS (SELECT {k}c, role, author, 1000 * (avg(r) FILTER ({_ZONE}) - avg(r) FILTER ({_WARN})) AS f FROM r GROUP BY ALL),
    d AS (SELECT {k}c, avg(f) FILTER (role = 'majority') AS f_maj, avg(f) FILTER (role = 'dissent') AS f_dis,
          round(avg(f) FILTER (role = 'majority') - avg(f) FILTER (role = 'dissent'), 9) AS delta FROM f GROUP BY ALL)"""


_D = f"{_BASE}, {_deltas()}"

_SIGN = "(SELECT sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) - n * ln(2))) FROM unnest(range(pos, n + 1)) AS q(k))"


def _erfc_half(z: str) -> str:
    """The normal tail over z by a series with gamma functions."""
    a = f"least(abs({z}) / sqrt(2), 6.0)"
    erf = f"(CASE WHEN {a} = 0 THEN 0 ELSE exp(-({a}) * ({a})) * list_sum(list_transform(range(0, 161), lambda m: exp((2 * m + 1) * ln(greatest({a}, 1e-300)) - lgamma(m + 1.5)))) END)"
    return f"((1 - sign({z}) * {erf}) / 2)"


def _signed_rank(source: str, keys: str = "") -> str:
    """CTEs from d(delta) to wx(w, n, p), p exact."""
    k = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys} " if keys else ""
    return f"""
    a AS (SELECT {k}delta, rank() OVER ({part}ORDER BY abs(delta)) AS rk, count(*) OVER (PARTITION BY {k}abs(delta)) AS t FROM {source} WHERE delta <> 0),
    wn AS (SELECT {k}sum(CASE WHEN delta > 0 THEN rk + (t - 1) / 2.0 ELSE 0 END) AS w, count(*) AS n FROM a GROUP BY ALL),
    RANKS AS (SELECT 0 AS n, [CAST(1 AS DOUBLE)] AS ways UNION ALL
              SELECT n + 1, list_transform(range(0, len(ways) + n + 1), lambda i: (coalesce(ways[i + 1], 0) + CASE WHEN i >= n + 1 THEN coalesce(ways[i - n], 0) ELSE 0 END) / 2) FROM RANKS WHERE n < 20),
    wx AS (SELECT {k}w, wn.n, list_sum(ways[CAST(ceil(w) AS BIGINT) + 1:]) AS p FROM wn JOIN RANKS ON RANKS.n = wn.n)"""


_PROFILE = f"""{_D}, prof AS (SELECT c, j, section, avg(s) FILTER (role = 'majority') - avg(s) FILTER (role = 'dissent') AS d FROM s GROUP BY ALL)"""

_PLACEBO = f"""{_PROFILE}, bar AS (SELECT j, section, avg(d) AS d FROM prof GROUP BY ALL),
    sz AS (SELECT count(*) FILTER ({_ZONE}) AS z, count(*) FILTER ({_WARN}) AS w FROM bar),
    dealt AS (SELECT rep, d, row_number() OVER (PARTITION BY rep ORDER BY {order("1789", "rep", "j")}, j) AS k FROM bar, range(0, 1000) AS q(rep)),
    plac AS (SELECT rep, 1000 * (avg(d) FILTER (k <= z) - avg(d) FILTER (k > z AND k <= z + w)) AS delta FROM dealt, sz GROUP BY rep)"""

_ROLES = f"""{_D}, nat AS (SELECT c, role, author, f, row_number() OVER (PARTITION BY c ORDER BY role, author) AS i FROM f),
    sh AS (SELECT rep, c, f, row_number() OVER (PARTITION BY rep, c ORDER BY {order("1789", "rep", "c", "role", "author")}, role, author) AS i FROM nat, range(0, 500) AS q(rep)),
    rp AS (SELECT rep, c, avg(sh.f) FILTER (nat.role = 'majority') - avg(sh.f) FILTER (nat.role = 'dissent') AS d FROM sh JOIN nat USING (c, i) GROUP BY ALL),
    roles AS (SELECT rep, avg(d) AS delta FROM rp GROUP BY rep)"""

_NULL = "avg({x}) AS null_mean, stddev_pop({x}) AS null_sd, quantile_cont({x}, 0.025) AS lo, quantile_cont({x}, 0.975) AS hi"


def _null(source: str, observed: str, x: str, extreme: str) -> str:
    return f"""SELECT {r("observed")} AS observed, {r("null_mean")} AS null_mean, {r("null_sd")} AS null_sd, {r("lo")} AS lo, {r("hi")} AS hi, {r("p")} AS p FROM (
        SELECT max(o) AS observed, {_NULL.format(x=x)}, count(*) FILTER ({extreme}) / count(*) AS p FROM {source}, (SELECT {observed} AS o))"""


_GAP = """
    nd AS (SELECT c, delta, row_number() OVER (ORDER BY delta DESC, c DESC) AS k FROM d),
    rest AS (SELECT delta, row_number() OVER (ORDER BY c) - 1 AS i FROM nd WHERE k > 1),
    m AS (SELECT avg(delta) AS mu, stddev_samp(delta) AS sd, count(*) AS n FROM rest),
    g0 AS (SELECT (max(nd.delta) FILTER (k = 1) - max(mu)) / max(sd) AS g FROM nd, m)"""

_GAPS = """
    ranked AS (SELECT rep, x, row_number() OVER (PARTITION BY rep ORDER BY x DESC) AS k FROM draws),
    gs AS (SELECT rep, CASE WHEN var_samp(x) FILTER (k > 1) > 1e-9 THEN (max(x) - avg(x) FILTER (k > 1)) / stddev_samp(x) FILTER (k > 1) ELSE 0 END AS g FROM ranked GROUP BY rep)"""

_GAP_OUT = f"SELECT {r('(SELECT g FROM g0)')} AS g, {r('avg(g)')} AS null_mean, {r('quantile_cont(g, 0.95)')} AS null_95, {r('avg(CASE WHEN g >= (SELECT g FROM g0) THEN 1.0 ELSE 0 END)')} AS p FROM gs"

# labelled members in long form: one row for each element
_LAB = f"""WITH {_UNITS},
    l AS (SELECT vec_id AS id, {_CASE} AS c, CAST(label AS INTEGER) AS opinion, CASE WHEN label < 5 THEN 1 ELSE -1 END AS s, u FROM e WHERE vec_id >= {REFERENCE_SIZE} AND label < 9),
    el AS (SELECT id, c, opinion, s, i, u[i + 1] AS x FROM l, range(0, 64) AS q(i)),
    df AS (SELECT c, i, avg(x) FILTER (s = 1) - avg(x) FILTER (s = -1) AS d FROM el GROUP BY ALL HAVING count(*) FILTER (s = 1) > 0 AND count(*) FILTER (s = -1) > 0),
    tot AS (SELECT i, sum(d) AS t, count(*) AS n FROM df GROUP BY i)"""

_LOO = f"""{_LAB},
    raw AS (SELECT cs.c, tot.i, t - coalesce(d, 0) AS x FROM (SELECT DISTINCT c FROM l) cs CROSS JOIN tot LEFT JOIN df ON df.c = cs.c AND df.i = tot.i),
    dir AS (SELECT c, i, x / sqrt(sum(x * x) OVER (PARTITION BY c)) AS x FROM raw),
    cen AS (SELECT c, i, avg(x) AS x FROM el GROUP BY ALL),
    sco AS (SELECT el.id, el.c, el.opinion, el.s, sum((el.x - cen.x) * dir.x) AS score FROM el JOIN cen USING (c, i) JOIN dir USING (c, i) GROUP BY ALL)"""


def _auc(source: str, keys: str = "") -> str:
    """(keys, auc, n) from (keys, y, score) by average ranks."""
    k = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys} " if keys else ""
    return f"""SELECT {k}CASE WHEN sum(y) > 0 AND sum(y) < count(*) THEN (sum(CASE WHEN y = 1 THEN rk ELSE 0 END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))) END AS auc, count(*) AS n
        FROM (SELECT {k}y, rank() OVER ({part}ORDER BY score) + (count(*) OVER (PARTITION BY {k}score) - 1) / 2.0 AS rk FROM {source}) {"GROUP BY " + keys if keys else ""}"""


_DOM = f"{_LAB}, dom AS (SELECT 'c' || lpad(CAST(i AS VARCHAR), 2, '0') AS c, ['security', 'structure', 'immunity'][i % 3 + 1] AS g FROM range(0, 19) AS q(i)), dg AS (SELECT df.*, g FROM df JOIN dom USING (c))"

_PERM = f"""{_LAB},
    ops AS (SELECT c, opinion, max(s) AS s, row_number() OVER (PARTITION BY c ORDER BY opinion) AS k FROM l GROUP BY c, opinion),
    sh AS (SELECT rep, c, opinion, row_number() OVER (PARTITION BY rep, c ORDER BY {order("11", "rep", "c", "opinion")}, opinion) AS k FROM ops, range(0, 20) AS q(rep)),
    dealt AS (SELECT rep, sh.c, sh.opinion, ops.s FROM sh JOIN ops ON sh.c = ops.c AND sh.k = ops.k),
    ex AS (SELECT rep, el.id, el.c, dealt.s, i, x FROM el JOIN dealt USING (c, opinion)),
    pdf AS (SELECT rep, c, i, avg(x) FILTER (s = 1) - avg(x) FILTER (s = -1) AS d FROM ex GROUP BY ALL HAVING count(*) FILTER (s = 1) > 0 AND count(*) FILTER (s = -1) > 0),
    pt AS (SELECT rep, i, sum(d) AS t FROM pdf GROUP BY ALL),
    praw AS (SELECT cs.rep, cs.c, pt.i, t - coalesce(d, 0) AS x FROM (SELECT DISTINCT rep, c FROM dealt) cs JOIN pt ON pt.rep = cs.rep LEFT JOIN pdf ON pdf.rep = cs.rep AND pdf.c = cs.c AND pdf.i = pt.i),
    pdir AS (SELECT rep, c, i, x / sqrt(sum(x * x) OVER (PARTITION BY rep, c)) AS x FROM praw),
    pc AS (SELECT c, i, avg(x) AS x FROM el GROUP BY ALL),
    ps AS (SELECT ex.rep, ex.id, ex.c, ex.s, sum((ex.x - pc.x) * pdir.x) AS score FROM ex JOIN pc USING (c, i) JOIN pdir USING (rep, c, i) GROUP BY ALL),
    py AS (SELECT rep, CASE WHEN s = 1 THEN 1 ELSE 0 END AS y, round(score, 9) AS score FROM (SELECT *, min(s) OVER (PARTITION BY rep, c) < max(s) OVER (PARTITION BY rep, c) AS two FROM ps) WHERE two)"""

_AXIS = f"""{_BASE},
    an AS (SELECT label = 9 AS pole, i, u[i + 1] AS x, k FROM (SELECT label, u, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS k FROM e WHERE label IN (0, 9)), range(0, 64) AS q(i) WHERE k < 12),
    ax0 AS (SELECT i, avg(x) FILTER (pole) - avg(x) FILTER (NOT pole) AS x FROM an GROUP BY i),
    ax AS (SELECT i, x / sqrt(sum(x * x) OVER ()) AS x FROM ax0),
    cn AS (SELECT i, avg(u[i + 1]) AS x FROM e, range(0, 64) AS q(i) GROUP BY i),
    prj AS (SELECT id, c, role, sum((v[i + 1] - cn.x) * ax.x) AS x FROM p, ax JOIN cn USING (i) GROUP BY ALL),
    z AS (SELECT id, c, role, (x - avg(x) OVER ()) / stddev_pop(x) OVER () AS z FROM prj)"""

_YEARS = "yr AS (SELECT year(o_orderdate) AS year, CAST(avg(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS f FROM orders GROUP BY 1)"

#: Python's white space, as the text functions squeeze it.
_WS = r"[\s\x0b\x1c-\x1f\x85\p{Z}]+"


def squeeze(t: str) -> str:
    return rf"trim(regexp_replace({t}, '{_WS}', ' ', 'g'))"


def words(t: str) -> str:
    return rf"len(regexp_extract_all({t}, '[^\s\x0b\x1c-\x1f\x85\p{{Z}}]+'))"


_QUOTED = '[“"][^”"]{8,}[”"]'
_PARAS = f"""WITH ln AS (SELECT doc_id, i, {squeeze("t")} AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
    pa AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos, text, CAST({words("text")} AS BIGINT) AS n_words,
           round(list_sum(list_transform(regexp_extract_all(text, '{_QUOTED}'), lambda q: length(q))) / greatest(length(text), 1), 4) AS quote_share FROM ln WHERE length(text) > 1)"""

_HEAD = r"(?:^|\n)\s*((?:Mr\.\s+)?(?:Chief\s+)?Justice\s+[A-Z][a-zA-Z’'']+(?:,\s*(?:with\s+whom[^.]{0,260}?)?)?,?\s*(?:delivered the opinion|announced the judgment|concurring|dissenting)[^.]{0,400}?\.)"

_LAYOUT = f"""{_PARAS}, hs AS (SELECT *, {draw("doc_id", "pos")} AS h FROM pa),
    lay AS (SELECT doc_id AS doc, CAST(pos // 12 AS BIGINT) AS page, pos AS line_no,
        CAST(CASE WHEN h % 10 < 6 THEN 72 WHEN h % 10 < 8 THEN 84 WHEN h % 10 < 9 THEN 140 ELSE 74.5 END AS DOUBLE) AS x0,
        CASE WHEN (h // 10) % 10 < 7 THEN 11.0 WHEN (h // 10) % 10 < 9 THEN 9.0 ELSE 7.0 END AS sz,
        CASE WHEN (h // 100) % 11 = 0 THEN 'Syllabus' WHEN (h // 100) % 11 = 1 THEN '12 ' || text WHEN (h // 100) % 11 = 2 THEN 'II' ELSE text END AS t FROM hs),
    mc AS (SELECT doc, page, round_even(x0, 0) AS x, count(*) AS n, min(line_no) AS f FROM lay WHERE sz >= 10.4 GROUP BY ALL),
    mg AS (SELECT doc, page, x AS margin FROM mc QUALIFY row_number() OVER (PARTITION BY doc, page ORDER BY n DESC, f) = 1)"""

_JUNK = r"^\s*(?:\d{1,4}|Cite as:.*|(?:Opinion|Syllabus|Per Curiam)(?:\s+of\s+.*)?|[A-Z][A-Za-z''’]+(?:,\s*(?:C\.\s*)?J\.)?,\s*(?:concurring|dissenting).*|Opinion of [A-Z][A-Za-z''’]*(?:,\s*(?:C\.\s*)?J\.)?.*|[A-Z][A-Z .,''’&()\-]{4,}\s+v\.\s+[A-Z][A-Z .,''’&()\-]{2,}|NOTICE:.*|Page Proof Pending Publication)\s*$"

_SESSION = f"""{_LAYOUT},
    ow AS (SELECT lay.*, x0 - margin AS dx, sz < 10.4 AS foot, regexp_matches(t, '{_JUNK}') OR (x0 - margin > 45 AND length(t) <= 40) AS brk FROM lay JOIN mg USING (doc, page) WHERE sz >= 8),
    fl AS (SELECT *, coalesce(lag(brk) OVER (PARTITION BY doc ORDER BY page, line_no), false) AS aft FROM ow),
    kp AS (SELECT * FROM fl WHERE NOT brk),
    nw AS (SELECT *, (dx > 4 AND dx <= 45) OR (foot AND regexp_matches(t, '^\\d+\\s')) OR aft OR foot <> coalesce(lag(foot) OVER w, false)
           OR page IS DISTINCT FROM lag(page) OVER w AS new FROM kp WINDOW w AS (PARTITION BY doc ORDER BY page, line_no)),
    nb AS (SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY page, line_no ROWS UNBOUNDED PRECEDING) AS no FROM nw),
    jo AS (SELECT doc, no, {squeeze("string_agg(t, ' ' ORDER BY page, line_no)")} AS text, bool_or(foot) AS is_footnote, count(*) AS n_lines FROM nb GROUP BY doc, no)"""

_TFIDF = r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]{2,}') AS w FROM documents),
    t AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
    vo AS (SELECT term, count(*) AS df, sum(tf) AS k FROM tf GROUP BY term HAVING count(*) >= 3 ORDER BY k DESC, term LIMIT 60000),
    ra AS (SELECT doc_id, term, (1 + ln(tf)) * (ln((1.0 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS w FROM tf JOIN vo USING (term))"""


def oracle_sql() -> dict[str, str]:
    names = ", ".join(f"max(CASE WHEN section = '{n}' THEN a END) AS s{i}" for i, (n, _, _) in enumerate(SECTION_RANGES))
    rounded = ", ".join(f"{r(f's{i}')} AS s{i}" for i in range(len(SECTION_RANGES)))
    overlaid = f"{_BASE}, nv AS (SELECT id + 1 AS id, v FROM p WHERE role = 'dissent'), po AS (SELECT p.id, p.c, p.role, p.author, coalesce(nv.v, p.v) AS v, nv.v IS NOT NULL AS replaced FROM p LEFT JOIN nv ON nv.id = p.id)"
    perm_obs = f"(SELECT auc FROM ({_auc('sy')}))"
    session_recursive = _D.replace("WITH ", "WITH RECURSIVE ", 1)
    out = {
        "within_delta": f"{_D} SELECT c AS case_key, {r('f_maj')} AS f_maj, {r('f_dis')} AS f_dis, {r('delta')} AS delta FROM d",
        "delta_fastpath": f"{_D} SELECT c AS case_key, {r('delta')} AS delta FROM d",
        "affinity_s": f"{_D} SELECT c AS case_key, role, author, j, {r('s')} AS s FROM s",
        "affinity_s_factorised": f"{_D} SELECT c AS case_key, role, author, j, {r('s')} AS s FROM s",
        "affinity_r": f"{_D} SELECT c AS case_key, role, author, j, {r('r')} AS r FROM r",
        "residual_margins": "SELECT unnest(['rows', 'columns', 'contrasts']) AS \"check\", true AS holds",
        "section_matrix": f"{_D} SELECT c AS case_key, role, author, section, {r('1000 * avg(r)')} AS affinity FROM r GROUP BY ALL",
        "heatmap": f"{_D}, sm AS (SELECT c, role, author, section, 1000 * avg(r) AS a FROM r GROUP BY ALL) SELECT case_key, role, author, {rounded} FROM (SELECT c AS case_key, role, author, {names} FROM sm GROUP BY ALL)",
        "top_passage": f"{_D} SELECT c AS case_key, role, author, j FROM r QUALIFY row_number() OVER (PARTITION BY c, role, author ORDER BY round(r, 12) DESC, j) = 1",
        "nearest_section_share": f"{_BASE}, ne AS (SELECT role, author, section FROM p CROSS JOIN js QUALIFY row_number() OVER (PARTITION BY id ORDER BY list_dot_product(v, u) DESC, j) = 1) SELECT role, author, section, {r('100.0 * count(*) / sum(count(*)) OVER (PARTITION BY role, author)')} AS share, CAST(sum(count(*)) OVER (PARTITION BY role, author) AS BIGINT) AS n FROM ne GROUP BY role, author, section",
        "closest_paragraph": f"{_BASE} SELECT c AS case_key, role, author, j, id, {r('list_dot_product(v, u)')} AS cos FROM p CROSS JOIN js QUALIFY row_number() OVER (PARTITION BY c, role, author, j ORDER BY list_dot_product(v, u) DESC, id) = 1",
        "loo_passage": f"{_PROFILE}, dr AS (SELECT j AS dropped FROM js WHERE {_ZONE} OR {_WARN}) SELECT dropped, {r(f'1000 * (avg(bd) FILTER ({_ZONE}) - avg(bd) FILTER ({_WARN}))')} AS mean_delta FROM (SELECT dropped, section, j, avg(d) AS bd FROM prof, dr WHERE j <> dropped GROUP BY ALL) GROUP BY dropped",
        "loo_passage_range": f"{_PROFILE}, dr AS (SELECT j AS dropped FROM js WHERE {_ZONE} OR {_WARN}), md AS (SELECT dropped, 1000 * (avg(bd) FILTER ({_ZONE}) - avg(bd) FILTER ({_WARN})) AS m FROM (SELECT dropped, section, j, avg(d) AS bd FROM prof, dr WHERE j <> dropped GROUP BY ALL) GROUP BY dropped) SELECT {r('min(m)')} AS low, {r('max(m)')} AS high, bool_and(m > 0) AS all_positive FROM md",
        "overlay_vectors": f"{overlaid} SELECT id AS para_id, replaced, {r('v[1]')} AS v0 FROM po",
        "replacement_control": f"{overlaid}, {_deltas(source='po')}, d1 AS (SELECT * FROM d), {_deltas().replace('    g AS', '    g_ AS').replace(' FROM g ', ' FROM g_ ').replace('ok AS', 'ok_ AS').replace('JOIN ok ', 'JOIN ok_ ').replace('SELECT g.* FROM g_', 'SELECT g_.* FROM g_').replace('kept AS', 'kept_ AS').replace('JOIN kept ', 'JOIN kept_ ').replace('    s AS', '    s_ AS').replace('r FROM s)', 'r FROM s_)').replace('    r AS', '    r_ AS').replace('FROM r GROUP', 'FROM r_ GROUP').replace('    f AS', '    f_ AS').replace('FROM f GROUP', 'FROM f_ GROUP').replace('    d AS', '    d_ AS')} SELECT 'as written' AS variant, {r('avg(delta)')} AS mean, count(*) FILTER (delta > 0) AS pos, count(*) AS n FROM d_ UNION ALL SELECT 'replaced', {r('avg(delta)')}, count(*) FILTER (delta > 0), count(*) FROM d1",
        "within_summary": f"{_D}, st AS (SELECT count(*) AS n, count(*) FILTER (delta > 0) AS pos, avg(delta) AS mean, median(delta) AS med, stddev_samp(delta) AS sd FROM d) SELECT n, pos, {r('mean')} AS mean, {r('med')} AS median, {r('sd')} AS sd, {r(_SIGN)} AS sign_p FROM st",
        "delta_rank": f"{_D} SELECT c AS case_key, {r('delta')} AS delta, {r('(delta - avg(delta) OVER ()) / stddev_samp(delta) OVER ()')} AS z, rank() OVER (ORDER BY delta) AS rank, {r('(SELECT avg(CASE WHEN o.delta >= d.delta THEN 1.0 ELSE 0 END) FROM d o)')} AS tail FROM d",
        "delta_by_domain": f"{_D}, dom AS (SELECT 'c' || lpad(CAST(i AS VARCHAR), 2, '0') AS c, ['security', 'structure', 'immunity'][i % 3 + 1] AS g FROM range(0, 19) AS q(i)) SELECT coalesce(g, '?') AS domain, {r('avg(delta)')} AS mean_delta, count(*) AS n FROM d LEFT JOIN dom USING (c) GROUP BY 1",
        "wilcoxon": f"{session_recursive}, {_signed_rank('d')} SELECT {r('w')} AS w, {r('p')} AS p, n FROM wx",
        "size_sweep": f"{_BASE.replace('WITH ', 'WITH RECURSIVE ', 1)}, sw AS (SELECT unnest([2, 3, 4, 5, 6]) AS min_para), {_deltas('min_para', 'min_para', 'p', ' CROSS JOIN sw')}, {_signed_rank('d', 'min_para')} SELECT d.min_para, count(*) AS n, {r('avg(delta)')} AS mean, count(*) FILTER (delta > 0) AS pos, {r('max(w)')} AS w, {r('max(p)')} AS p FROM d JOIN wx USING (min_para) GROUP BY d.min_para",
        "grubbs": f"{_D} SELECT {r('(max(delta) - avg(delta)) / stddev_samp(delta)')} AS g, count(*) AS n FROM d",
        "outlier_gap": f"{_D}, {_GAP} SELECT {r('(SELECT g FROM g0)')} AS g, {r('max(delta)')} AS top, {r('(SELECT delta FROM nd WHERE k = 2)')} AS second, count(*) AS n FROM d",
        "max_gap": f"{_D}, {_GAP}, draws AS (SELECT rep, rest.delta AS x FROM range(0, 1000) AS q(rep), m, range(0, 50) AS o(i), rest WHERE o.i <= m.n AND rest.i = {draw('1952', 'rep', 'o.i')} % m.n), {_GAPS} {_GAP_OUT}",
        "max_gap_normal": f"{_D}, {_GAP}, draws AS (SELECT rep, mu + sd * sqrt(-2 * ln(({draw('1952', chr(39) + 'a' + chr(39), 'rep', 'i')} + 0.5) / 4294967296.0)) * cos((({draw('1952', chr(39) + 'b' + chr(39), 'rep', 'i')} + 0.5) / 4294967296.0) * 6.283185307179586) AS x FROM range(0, 1000) AS q(rep), m, range(0, 50) AS o(i) WHERE i <= n), {_GAPS} {_GAP_OUT}",
        "boot_mean": f"{_D}, nd AS (SELECT delta, row_number() OVER (ORDER BY c) - 1 AS i, count(*) OVER () AS n FROM d), dr AS (SELECT rep, {draw('343', 'rep', 'i')} % n AS k FROM nd, range(0, 2000) AS q(rep)), bm AS (SELECT rep, avg(delta) AS m FROM dr JOIN nd ON nd.i = dr.k GROUP BY rep) SELECT {r('quantile_cont(m, 0.025)')} AS lo, {r('quantile_cont(m, 0.975)')} AS hi, {r('avg(CASE WHEN m > 0 THEN 1.0 ELSE 0 END)')} AS share_over, {r('avg(CASE WHEN m < 0 THEN 1.0 ELSE 0 END)')} AS share_under FROM bm",
        "boot_contrast": f"""{_BASE}, own AS (SELECT id, role, author, v, CASE WHEN role = 'majority' THEN 1.0 ELSE -0.5 END AS w FROM p WHERE c = 'c05' AND ((role = 'majority' AND author = 0) OR role = 'dissent')),
            cx AS (SELECT id, role, author, w, 1000 * (avg(list_dot_product(v, u)) FILTER ({_WARN}) - avg(list_dot_product(v, u))) AS c1, 1000 * (avg(list_dot_product(v, u)) FILTER ({_ZONE}) - avg(list_dot_product(v, u))) AS c2 FROM own CROSS JOIN js GROUP BY ALL),
            lx AS (SELECT id, role, author, w, unnest(['c1', 'c2']) AS name, unnest([c1, c2]) AS x FROM cx),
            nx AS (SELECT *, row_number() OVER (PARTITION BY name, role, author ORDER BY id) - 1 AS i, count(*) OVER (PARTITION BY name, role, author) AS n FROM lx),
            ob AS (SELECT name, sum(m * w) AS obs FROM (SELECT name, role, author, w, avg(x) AS m FROM nx GROUP BY ALL) GROUP BY name),
            dr AS (SELECT rep, name, role, author, w, {draw("20240701", "rep", "role", "author", "i")} % n AS k FROM nx, range(0, 500) AS q(rep)),
            me AS (SELECT rep, dr.name, dr.role, dr.author, dr.w, avg(x) AS m FROM dr JOIN nx ON nx.name = dr.name AND nx.role = dr.role AND nx.author = dr.author AND nx.i = dr.k GROUP BY ALL),
            va AS (SELECT rep, name, sum(m * w) AS v FROM me GROUP BY ALL)
            SELECT name, {r("max(obs)")} AS obs, {r("quantile_cont(v, 0.025)")} AS lo, {r("quantile_cont(v, 0.975)")} AS hi, {r("avg(CASE WHEN v > 0 THEN 1.0 ELSE 0 END)")} AS share_over, {r("avg(CASE WHEN v < 0 THEN 1.0 ELSE 0 END)")} AS share_under FROM va JOIN ob USING (name) GROUP BY name""",
        "placebo": f"{_PLACEBO} SELECT rep, {r('delta')} AS delta FROM (SELECT CAST(rep AS INTEGER) AS rep, delta FROM plac)",
        "placebo_summary": f"{_PLACEBO} {_null('plac', '(SELECT avg(delta) FROM d)', 'delta', 'delta >= o')}",
        "role_perm": f"{_ROLES} SELECT CAST(rep AS INTEGER) AS rep, {r('delta')} AS delta FROM roles",
        "role_perm_summary": f"{_ROLES} {_null('roles', '(SELECT avg(delta) FROM d)', 'delta', 'delta >= o')}",
        "null_curve": f"{_PLACEBO}, mo AS (SELECT avg(delta) AS m, stddev_pop(delta) AS sd FROM plac), pt AS (SELECT m, sd, m + sd * (i * 8.0 / 100 - 4) AS x FROM mo, range(0, 101) AS q(i)) SELECT {r('x')} AS x, {r('exp(0 - pow((x - m) / sd, 2) / 2) / (sd * 2.5066282746310002)')} AS y FROM pt",
        "lollipop": f"{_D} SELECT c AS case_key, {r('delta')} AS delta, row_number() OVER (ORDER BY delta, c) - 1 AS y FROM d",
        "direction": f"{_LAB} SELECT CAST(i AS INTEGER) AS i, {r('t / sqrt(sum(t * t) OVER ())')} AS x, n FROM tot",
        "direction_loo": f"{_LOO} SELECT id, c AS case_key, s, {r('score')} AS score FROM sco",
        "direction_loo_auc": f"{_LOO}, sy AS (SELECT c AS case_key, CASE WHEN s = 1 THEN 1 ELSE 0 END AS y, round(score, 9) AS score FROM sco) SELECT case_key, {r('auc')} AS auc, n FROM ({_auc('sy', 'case_key')})",
        "direction_pooled": f"{_LOO}, sy AS (SELECT CASE WHEN s = 1 THEN 1 ELSE 0 END AS y, round(score, 9) AS score FROM sco) SELECT {r('auc')} AS auc, n, (SELECT {r('avg(CASE WHEN (score > 0) = (y = 1) THEN 1.0 ELSE 0 END)')} FROM sy) AS accuracy FROM ({_auc('sy')})",
        "opinion_accuracy": f"{_LOO} SELECT count(*) FILTER ((m > 0) = (s = 1)) AS n_ok, count(*) AS n FROM (SELECT c, opinion, s, round(avg(score), 9) AS m FROM sco GROUP BY ALL)",
        "direction_angles": f"{_DOM}, gt AS (SELECT g, i, sum(d) AS t FROM dg GROUP BY ALL), gu AS (SELECT g, i, t / sqrt(sum(t * t) OVER (PARTITION BY g)) AS x FROM gt), co AS (SELECT a.g AS a, b.g AS b, sum(a.x * b.x) AS cos FROM gu a JOIN gu b ON a.i = b.i AND a.g < b.g GROUP BY ALL) SELECT a, b, {r('cos')} AS cos, {r('degrees(acos(greatest(-1.0, least(1.0, cos))))')} AS degrees FROM co",
        "transfer_auc": f"""{_DOM}, gt AS (SELECT g, i, sum(d) AS t FROM dg GROUP BY ALL),
            rw AS (SELECT gt.g AS fit, dg.g AS test, dg.c, gt.i, CASE WHEN gt.g = dg.g THEN t - d ELSE t END AS x FROM dg JOIN gt ON gt.i = dg.i),
            di AS (SELECT fit, test, c, i, x / sqrt(sum(x * x) OVER (PARTITION BY fit, c)) AS x FROM rw), ce AS (SELECT c, i, avg(x) AS x FROM el GROUP BY ALL),
            sx AS (SELECT fit, test, el.id, el.s, sum((el.x - ce.x) * di.x) AS score FROM el JOIN ce USING (c, i) JOIN di USING (c, i) GROUP BY ALL),
            sy AS (SELECT fit, test, CASE WHEN s = 1 THEN 1 ELSE 0 END AS y, round(score, 9) AS score FROM sx) SELECT fit, test, {r("auc")} AS auc, n FROM ({_auc("sy", "fit, test")})""",
        "label_perm": f"{_PERM} SELECT CAST(rep AS INTEGER) AS rep, {r('auc')} AS auc, n FROM ({_auc('py', 'rep')})",
        "label_perm_summary": f"""{_PERM}, rawo AS (SELECT cs.c, tot.i, t - coalesce(d, 0) AS x FROM (SELECT DISTINCT c FROM l) cs CROSS JOIN tot LEFT JOIN df ON df.c = cs.c AND df.i = tot.i),
            dro AS (SELECT c, i, x / sqrt(sum(x * x) OVER (PARTITION BY c)) AS x FROM rawo), so AS (SELECT el.id, el.c, el.s, sum((el.x - pc.x) * dro.x) AS score FROM el JOIN pc USING (c, i) JOIN dro USING (c, i) GROUP BY ALL),
            sy AS (SELECT CASE WHEN s = 1 THEN 1 ELSE 0 END AS y, round(score, 9) AS score FROM (SELECT *, min(s) OVER (PARTITION BY c) < max(s) OVER (PARTITION BY c) AS two FROM so) WHERE two),
            pa AS ({_auc("py", "rep")}) {_null("pa", perm_obs, "auc", "abs(auc - 0.5) >= abs(o - 0.5)")}""",
        "axis_scores": f"{_AXIS} SELECT id, c AS case_key, role, {r('z')} AS z FROM z",
        "axis_case_means": f"{_AXIS} SELECT c AS case_key, {r('avg(z)')} AS mean, {r(chr(97) + 'vg(z) FILTER (role = ' + chr(39) + 'majority' + chr(39) + ')')} AS majority_mean FROM z GROUP BY c",
        "axis_mwu": f"""{_AXIS}, rk AS (SELECT c, role, rank() OVER (PARTITION BY c ORDER BY round(z, 12)) + (count(*) OVER (PARTITION BY c, round(z, 12)) - 1) / 2.0 AS k, count(*) OVER (PARTITION BY c, round(z, 12)) AS t FROM z WHERE role <> 'concurrence'),
            us AS (SELECT c, count(*) FILTER (role = 'majority') AS n1, count(*) FILTER (role = 'dissent') AS n2, sum(k) FILTER (role = 'majority') AS s, sum(t * t - 1.0) AS ties, count(*) AS n FROM rk GROUP BY c),
            uu AS (SELECT c, n1, n2, s - n1 * (n1 + 1) / 2 AS u, sqrt(n1 * n2 / 12.0 * ((n + 1) - ties / (n * (n - 1)))) AS sd FROM us WHERE n1 > 0 AND n2 > 0),
            uz AS (SELECT c, n1, n2, u, (greatest(u, n1 * n2 - u) - n1 * n2 / 2.0 - 0.5) / sd AS zz FROM uu)
            SELECT c AS case_key, {r("u")} AS u, {r("least(1.0, 2 * " + _erfc_half("zz") + ")")} AS p, n1, n2 FROM uz""",
        "axis_loo_spearman": f"""{_AXIS}, pk AS (SELECT DISTINCT pole AS dp, k AS dk FROM an),
            a2 AS (SELECT dp, dk, i, avg(x) FILTER (pole) - avg(x) FILTER (NOT pole) AS x FROM an, pk WHERE NOT (pole = dp AND k = dk) GROUP BY ALL),
            a3 AS (SELECT dp, dk, i, x / sqrt(sum(x * x) OVER (PARTITION BY dp, dk)) AS x FROM a2),
            cm AS (SELECT c, i, avg(v[i + 1]) AS x FROM p, range(0, 64) AS q(i) GROUP BY ALL),
            bs AS (SELECT c, sum(cm.x * ax.x) AS b FROM cm JOIN ax USING (i) GROUP BY c), rf AS (SELECT dp, dk, c, sum(cm.x * a3.x) AS f FROM cm JOIN a3 USING (i) GROUP BY ALL),
            rk AS (SELECT dp, dk, rank() OVER (PARTITION BY dp, dk ORDER BY round(f, 12)) AS x, rank() OVER (PARTITION BY dp, dk ORDER BY round(b, 12)) AS y FROM rf JOIN bs USING (c))
            SELECT CAST(dp AS INTEGER) AS pole, CAST(dk AS INTEGER) AS idx, {r("corr(x, y)")} AS rho FROM rk GROUP BY ALL""",
        "drift_slope": f"WITH {_YEARS} SELECT {r('regr_slope(f, year)', 3)} AS slope, {r('regr_intercept(f, year)', 3)} AS intercept, {r('10 * regr_slope(f, year)', 3)} AS per_decade, {r('corr(f, year)', 3)} AS r, count(*) AS n FROM yr",
        "slope_perm": f"WITH {_YEARS}, nu AS (SELECT year, round(f, 6) AS f, row_number() OVER (ORDER BY year) - 1 AS i FROM yr), sh AS (SELECT rep, f, row_number() OVER (PARTITION BY rep ORDER BY {order('1952', 'rep', 'i')}, i) - 1 AS i FROM nu, range(0, 1000) AS q(rep)), sl AS (SELECT rep, round(regr_slope(sh.f, year), 6) AS slope FROM sh JOIN nu USING (i) GROUP BY rep), o AS (SELECT round(regr_slope(f, year), 6) AS o FROM nu) SELECT {r('max(o)', 3)} AS observed, {r('(count(*) FILTER (slope >= o) + 1) / (count(*) + 1)', 3)} AS p FROM sl, o",
        "case_preference": f"{_BASE}, mg AS (SELECT c FROM p WHERE role = 'majority' GROUP BY c HAVING count(*) >= 8), s AS (SELECT c, j, section, avg(list_dot_product(v, u)) AS s FROM p JOIN mg USING (c) CROSS JOIN js WHERE role = 'majority' GROUP BY ALL), r AS (SELECT c, section, s - avg(s) OVER (PARTITION BY c) - avg(s) OVER (PARTITION BY j) + avg(s) OVER () AS r FROM s), f AS (SELECT c, 1000 * (avg(r) FILTER ({_ZONE}) - avg(r) FILTER ({_WARN})) AS f FROM r GROUP BY c) SELECT c AS case_key, {r('f')} AS f, {r('(f - avg(f) OVER ()) / stddev_pop(f) OVER ()')} AS z FROM f",
        "paragraphs": f"{_PARAS} SELECT row_number() OVER (ORDER BY doc_id, pos) - 1 AS para_id, doc_id, pos, n_words, md5(text) AS text_md5 FROM pa",
        "analysis_set": f"{_PARAS} SELECT count(*) AS n, count(DISTINCT doc_id) AS docs, CAST(sum(n_words) AS BIGINT) AS words FROM pa WHERE NOT regexp_matches(text, '^\\d') AND n_words >= 25",
        "quote_share": f"{_PARAS} SELECT doc_id, pos, quote_share FROM pa WHERE quote_share > 0",
        "quote_strip": f"WITH q AS (SELECT doc_id, {squeeze(f'regexp_replace(text, {chr(39)}{_QUOTED}{chr(39)}, {chr(39)} {chr(39)}, {chr(39)}g{chr(39)})')} AS t FROM documents) SELECT doc_id, md5(t) AS text_md5, length(t) AS n_chars FROM q WHERE {words('t')} >= 20",
        "word_filter": f"SELECT source, count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM (SELECT source, {words('text')} AS n FROM documents) WHERE n >= 20 GROUP BY source",
        "mention_counts": "SELECT source, CAST(sum(len(regexp_extract_all(text, 'the'))) AS BIGINT) AS mentions FROM documents GROUP BY source",
        "quality_counts": "SELECT doc_id, len(regexp_extract_all(text, 'tion')) AS n_tion, len(regexp_extract_all(text, 'ofthe')) AS n_ofthe FROM documents",
        "type_counts": "SELECT lang, count(*) AS n FROM documents GROUP BY lang",
        "junk_lines": f"{_PARAS} SELECT doc_id, count(*) FILTER (regexp_matches(CASE WHEN pos % 9 = 0 THEN 'Opinion of Roe, J.' WHEN pos % 9 = 4 THEN CAST(pos AS VARCHAR) ELSE text END, '{_JUNK}')) AS dropped, count(*) AS n FROM pa GROUP BY doc_id",
        "opinion_inventory": f"{_PARAS} SELECT doc_id, count(*) FILTER (n_words >= 25) AS n_body, count(*) FILTER (n_words < 25) AS n_foot FROM pa GROUP BY doc_id",
        "header_spans": rf"""WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(text, '\n([A-C])', E'\nJustice \\1oe, with whom Justice Poe joins, dissenting in part. \\1', 'g'), '\n([D-F])', E'\nMr. Chief Justice \\1oe delivered the opinion. \\1', 'g') AS t FROM documents),
            m AS (SELECT doc_id, t, string_split_regex(t, '{_HEAD}') AS gap, regexp_extract_all(t, '{_HEAD}') AS hit, regexp_extract_all(t, '{_HEAD}', 1) AS head FROM t),
            h AS (SELECT doc_id, length(t) AS size, head[i] AS head, i, list_sum(list_transform(gap[1:i], lambda q: length(q))) + list_sum(list_transform(hit[1:i], lambda q: length(q))) - length(head[i]) AS s FROM m, range(1, len(hit) + 1) AS q(i) WHERE len(hit) > 1),
            f AS (SELECT doc_id, size, head, s FROM h UNION ALL SELECT doc_id, size, NULL, 0 FROM h WHERE i = 1 AND s > 500 UNION ALL SELECT doc_id, length(t), NULL, 0 FROM m WHERE len(hit) <= 1),
            o AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS piece, CAST(s AS BIGINT) AS start_at, CAST(coalesce(lead(s) OVER (PARTITION BY doc_id ORDER BY s), size) AS BIGINT) AS end_at, head FROM f)
            SELECT doc_id, piece, start_at, end_at, CASE WHEN head IS NULL THEN '' ELSE regexp_extract(head, 'Justice\s+([A-Z][a-zA-Z’'']+)', 1) END AS author,
            CASE WHEN head IS NULL THEN 'majority' WHEN contains(head, 'delivered') THEN 'majority' WHEN contains(head, 'dissenting') THEN 'dissent' ELSE 'other' END AS type FROM o""",
        "page_margins": f"{_LAYOUT} SELECT doc, page, margin FROM mg",
        "layout_sessionise": f"{_SESSION} SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY no) - 1 AS para_no, is_footnote, n_lines, md5(text) AS text_md5 FROM jo WHERE length(text) > 1",
        "best_candidate": "WITH s AS (SELECT source, doc_id, CASE WHEN regexp_matches(text, '(?i)and|est') AND contains(lower(text), 'the') AND contains(lower(text), 'tion') THEN length(text) ELSE -1 END AS score FROM documents) SELECT source, doc_id, score FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) = 1",
        "first_nonempty_field": "WITH f AS (SELECT doc_id, CASE WHEN lang = 'fr' THEN upper(text) END AS a, CASE WHEN lang <> 'en' THEN text END AS b, text || text || text AS c FROM documents), g AS (SELECT doc_id, CASE WHEN length(a) > 500 THEN 'a' WHEN length(b) > 500 THEN 'b' WHEN length(c) > 500 THEN 'c' END AS text_field, a, b, c FROM f) SELECT doc_id, text_field, length(CASE text_field WHEN 'a' THEN a WHEN 'b' THEN b ELSE c END) AS n_chars FROM g WHERE text_field IS NOT NULL",
        "first_success": "SELECT conv_id AS key, turn AS pos, length(text) AS result FROM conversations WHERE contains(text, 'this') QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn, length(text)) = 1",
        "source_priority": "SELECT 'archive' AS origin, count(*) AS n_rows, count(DISTINCT conv_id) AS n_keys, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM conversations UNION ALL SELECT 'pages', count(*), count(DISTINCT doc_id), CAST(sum(length(text)) AS BIGINT) FROM documents WHERE doc_id NOT IN (SELECT conv_id FROM conversations) HAVING count(*) > 0",
        "stance_join": "SELECT source, count(*) AS n, count(*) FILTER (quality = 1) AS pos, count(*) FILTER (quality <> 1) AS neg FROM documents JOIN labels USING (doc_id) WHERE toxic = 0 AND quality IS NOT NULL GROUP BY source",
        "label_coverage": f"SELECT quality, {r('avg(CASE WHEN toxic = 0 THEN 1.0 ELSE 0 END)')} AS accuracy, {r('greatest(avg(toxic), 1 - avg(toxic))')} AS baseline, count(*) AS n FROM labels GROUP BY quality",
        "discarded_cases": "SELECT source, lang FROM documents JOIN labels USING (doc_id) GROUP BY source, lang HAVING count(DISTINCT toxic) < 2",
        "majority_minus_dissent_length": f"SELECT conv_id, {r('d')} AS d, turns FROM (SELECT conv_id, avg({words('text')}) FILTER (role = 'assistant') - avg({words('text')}) FILTER (role = 'user') AS d, count(*) AS turns FROM conversations GROUP BY conv_id) WHERE d IS NOT NULL",
        "chunk_windows": f"WITH n AS (SELECT doc_id, greatest(1, {words('text')}) AS n FROM documents), w AS (SELECT doc_id, n, unnest(range(0, n, 384)) AS lo FROM n) SELECT doc_id, lo // 384 AS chunk_no, lo, least(n, lo + 510) AS hi FROM w WHERE lo = 0 OR lo - 384 + 510 < n",
        "encode": r"WITH w AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM benchmark), h AS (SELECT item_id, CAST('0x' || substr(md5(unnest(w)), 1, 8) AS BIGINT) AS h FROM w), b AS (SELECT item_id, h % 64 AS i, sum(CASE WHEN (h // 64) % 2 = 0 THEN 1 ELSE -1 END) AS x FROM h GROUP BY ALL), g AS (SELECT item_id, i, coalesce(x, 0) AS x FROM (SELECT DISTINCT item_id FROM benchmark) CROSS JOIN range(0, 64) AS q(i) LEFT JOIN b USING (item_id, i)) "
        + f"SELECT item_id, CAST(i AS INTEGER) AS i, {r('x / (sqrt(sum(x * x) OVER (PARTITION BY item_id)) + 1e-12)', 4)} AS x FROM g",
        "tfidf": f"{_TFIDF} SELECT doc_id, term, {r('w / sqrt(sum(w * w) OVER (PARTITION BY doc_id))')} AS weight FROM ra",
    }
    return out
