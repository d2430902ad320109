"""The trained operators: held-out accuracy, and rows with every odd case."""

import random
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessella.llm import html_blocks, langid, toxicity, train_blocks
from tests.llm.conftest import TEXT, words

# 2: HTML extraction

PAGES = [
    (
        1,
        "u1",
        '<html><head><title>T</title></head><body><header><h1>Site</h1><nav><a href=/>Home</a></nav></header><div class="cookie-banner">We use cookies.'
        "<button>OK</button></div><main><article><h1>Title &amp; more</h1><p>First   para <b>bold</b>&nbsp;x.</p><div class=ad>Buy now!</div><p>Second para with many"
        '\n\twords here.<br>And &lt;tag&gt; &#233;.</p><aside class="sidebar"><p>Related stuff here.</p></aside><script>var a="<p>no</p>";</script><p>Third one closes it.'
        '</article><section class="comments"><h2>Comments</h2><div class="comment"><p>Great article, I loved every word of it.</p></div></section></main>'
        "<form><label>Email</label><button>Subscribe</button></form><footer>&copy; 2020 me</footer></body></html>",
        "Title & more\n\nFirst para bold x.\n\nSecond para with many words here. And <tag> é.\n\nThird one closes it.",
    ),
    (
        2,
        None,
        '<body><div id="notice">Please log in.</div><div id="content"><h1>Hello</h1><p>Text one goes here<ul><li>item a is first<li>item b is second</ul></div>'
        '<div id="sidebar"><ul><li><a href=x>Foo</a></ul></div><ul id="comments"><li>nice one</li></ul><div id=footer>bye</div>',
        "Hello\n\nText one goes here\n\nitem a is first\n\nitem b is second",
    ),
    (3, "u3", None, ""),
    (4, "u4", "", ""),
    (4, "u4", "", ""),
    (None, "u5", "<nav><a href=/>Home</a></nav><!-- <p>x --><footer>&copy; y</footer><style>p{", ""),
]


def test_html(spark):
    rows = spark.createDataFrame([r[:3] for r in PAGES], "page_id bigint, url string, html string").withColumn("text", F.lit("clash"))
    found = html_blocks.extract(rows)
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    assert sorted(map(tuple, found.collect()), key=key) == sorted(((a, b, d) for a, b, _, d in PAGES), key=key)
    assert html_blocks.extract(rows.limit(0)).count() == 0


def test_html_long_page():
    body = "<article><h1>Head</h1>" + "<p>Some words of a paragraph, again.</p>" * 5000 + "</article><footer>&copy; z</footer>"
    (text,) = html_blocks.main_texts(html_blocks.load(), [body])
    assert text == "\n\n".join(["Head"] + ["Some words of a paragraph, again."] * 5000)


def test_html_model_on_other_pages():
    assert train_blocks.accuracy(html_blocks.load(), 150, seed=123) > 0.98
    assert train_blocks.accuracy(html_blocks.load(), 150, seed=123, held_out=True) > 0.97


def test_html_odd_pages_take_linear_time():
    began = time.perf_counter()
    for page in ("<a" * 10**6, "<div>x" * 10**5, "".join(f"<div class=k{i}>x" for i in range(10**5)), '<a "' * 10**5, '<a ">" ' * 10**5, '<p class="' + "a>b " * 10**5, "<x>" * 10**5 + "<li>a</li>" * 10**5, "<div>" * 10**5 + "</p>a" * 10**5, "<p>some words</p>" * 600_000):
        html_blocks.leaves(page)
    assert time.perf_counter() - began < 60


def test_html_training_learns_and_its_gradient_is_right():
    source = train_blocks.Pages(1)
    made = [source.labelled() for _ in range(4)]
    pages, labels = [a for a, _ in made], [b for _, b in made]
    w = {k: v.astype(np.float64) for k, v in train_blocks.start(np.random.default_rng(0)).items()}
    g, _ = train_blocks.gradients(w, pages, labels)
    rng = np.random.default_rng(1)
    for name in ("fx", "rh", "fb", "out", "path", "word"):
        at = np.unravel_index(np.argmax(np.abs(g[name]) + 1e-12 * rng.random(g[name].shape)), g[name].shape)
        losses = []
        for step in (1e-2, -1e-2):
            moved = {k: v.copy() for k, v in w.items()}
            moved[name][at] += step
            losses.append(train_blocks.gradients(moved, pages, labels)[1])
        assert abs((losses[0] - losses[1]) / 2e-2 - g[name][at]) < 0.02 * abs(g[name][at]) + 1e-4
    assert train_blocks.accuracy(train_blocks.train(60), 60) > 0.85


# 6: toxicity


def toxic_rows(n=900):
    rng = random.Random(6)
    rows = []
    for i in range(n):
        text = words(rng, rng.choice([4, 30, 120]))
        bad = rng.random() < 0.25
        if bad:
            parts = text.split(" ")
            for _ in range(rng.choice([1, 2])):
                parts.insert(rng.randrange(len(parts) + 1), rng.choice(["moron", "Scum.", "vilest" + rng.choice("abcdefgh")]))
            text = " ".join(parts)
        rows.append((i, text, int(bad)))
    return rows


def test_toxicity(spark):
    rows = toxic_rows()
    docs = spark.createDataFrame([r[:2] for r in rows], TEXT)
    labels = spark.createDataFrame([(i, y, 1) for i, _, y in rows] + [(1, None, 0), (None, 1, 1), (10**6, 1, 1)], "doc_id bigint, toxic int, quality int")
    chosen = toxicity.training_rows(docs, labels).collect()
    held = {r[0] for r in docs.where(toxicity.fold_of(F.col("doc_id")) == 1).select("doc_id").collect()}
    own = {t for i, t, _ in rows if i not in held}
    assert {r["text"] for r in chosen} <= own and len(chosen) == len(rows) - len(held)
    scorer = toxicity.trained(docs, labels)
    odd = [(5000, None), (5001, ""), (5002, "\n\n"), (None, "moron"), (5003, "alpha beta. You moron! gamma"), (5003, "alpha beta. You moron! gamma"), (5004, words(random.Random(1), 20_000))]
    every = docs.unionByName(spark.createDataFrame(odd, TEXT)).withColumn("score", F.lit("clash"))
    found = toxicity.score(every, scorer).collect()
    assert len(found) == len(rows) + len(odd)
    score = {r["doc_id"]: r for r in found}
    right = [(score[i]["_score"] >= toxicity.THRESHOLD) == (y == 1) for i, _, y in rows if i in held]
    assert sum(right) / len(right) > 0.95
    assert score[5000]["_score"] == score[5001]["_score"] == score[5002]["_score"] == 0.0
    spans = score[5003]["_offending"]
    assert ["alpha beta. You moron! gamma"[s["start"] : s["end"]] for s in spans] == ["You moron"]
    assert score[5004]["_score"] < 0.7
    assert toxicity.fit([], [], []).bias == toxicity.START_BIAS


# 7: language identification

LANGS = {"en": "the and of with that this from over under", "fr": "le la les une avec pour dans est sont", "de": "der die das und nicht mit auf eine sich"}


def test_langid(spark):
    rng = random.Random(2)
    said = lambda lang, n: " ".join(rng.choice(LANGS[lang].split()) for _ in range(n))
    docs = spark.createDataFrame([(i, said(x, 40), x) for i, x in enumerate(rng.choices(list(LANGS), k=150))] + [(999, None, "en"), (998, "x", None)], "doc_id bigint, text string, lang string")
    languages, model = langid.fit_text_model(docs)
    assert languages == ["de", "en", "fr"]
    pages, truth = [], {}
    for i in range(300):
        lang = rng.choice(list(LANGS))
        n = rng.choice([0, 2, 40])
        declared = lang if rng.random() < 0.8 else rng.choice(list(LANGS))
        pages.append((i, f"https://User@{rng.choice('ab')}.{lang}host.example.{ {'en': 'com', 'fr': 'fr', 'de': 'de'}[lang]}:80/x?y", f'<html lang="{declared}"><script>the the</script><p>{said(lang, n) if n else ""}</p>'))
        truth[i] = lang
    pages += [(500, None, None), (501, "", ""), (502, "not an address", "<p>der die das und nicht"), (503, "http://a.frhost.example.fr/", None), (None, "http://x", "<html lang=zz>"), (502, "not an address", "<p>der die das und nicht")]
    table = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("host", F.lit("clash"))
    found = langid.identify(table, languages, model).collect()
    assert len(found) == len(pages)
    by_id = {r["page_id"]: r for r in found}
    assert sum(by_id[i]["lang"] == x for i, x in truth.items()) / len(truth) > 0.97
    assert sum(by_id[i]["text_lang"] == x for i, x in truth.items()) < sum(by_id[i]["lang"] == x for i, x in truth.items())
    assert by_id[502]["lang"] == "de" and by_id[503]["lang"] == "fr" and by_id[500]["lang"] in languages
    assert all(0 <= r["probability"] <= 1 for r in found)
    assert langid.identify(table.limit(0), languages, model).count() == 0
    assert langid.identify(table, [], model).where("lang is null").count() == len(pages)


def test_language_codes_are_stable():
    assert langid._codes(b"").size == 0 and (langid._codes(b"Ab c") == langid._codes(b"aB  c.")).all()
    assert pa.array(langid._codes(b"abc")).to_pylist() == langid._codes(b" abc ").tolist()
