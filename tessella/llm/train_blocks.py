"""Trains the block labeller on made-up pages: ``python -m tessella.llm.train_blocks``.

Pages come from a grammar of page parts with random words, so every block's label is known:
an article in one of many kinds of container, with menus, headers, footers, sidebars,
notices, adverts, forms and reader comments around it and inside it.
"""

from __future__ import annotations

import random
from pathlib import Path

import numpy as np

from tessella.llm import html_blocks as hb

MAIN, OTHER = "\ue000", "\ue001"
SEED, STEPS, BATCH, RATE = 5, 1500, 24, 0.01

#: Made-up words: Hawaiian, Finnish and Turkish sounds, Cyrillic, Greek and kana; no corpus's.
_SOUNDS = (
    "ka ke ki ko ku la lo lu ma mo mu na no pa pe pi pu wa we hu aloa kee moa puu",
    "kuu taa nen ssa lla ään yö sti jär vel koi min hän pää suo rii ppu tte",
    "lar ler mek mak dır yor çok güz bir şey oğl ız uz türk ev göl dağ",
    "на ко то пре ва ли ски ром да ет жи вуч ный сто гра",
    "και το μας λο γος πα νο τη σει ρα φως",
    "の は を に て か さ ま ら り も",
)
#: Names, tags and spellings that pages for the test alone use (see ``Pages``).
_HELD_OUT = {
    "container": "prose-body node__content c-article entry-body rich-text",
    "navigation": "mainnav site-links topnav navlist",
    "sidebar": "aside-col right-rail colside",
    "comments": "usercomments talkback feedback-list thread",
    "notice": "cookiebar privacy-note info-bar",
}


class Pages:
    """Pages of a grammar. ``held_out`` pages have names of elements, spellings of tags and a script that training never has."""

    def __init__(self, seed: int, held_out: bool = False) -> None:
        self.r = random.Random(seed)
        self.held_out = held_out
        self.sounds = [s.split() for s in (_SOUNDS[4:] if held_out else _SOUNDS[:4])]

    def word(self) -> str:
        return "".join(self.r.choices(self.sounds[int(self.r.random() ** 2 * len(self.sounds))], k=self.r.randint(1, 4)))

    def named(self, kind: str, names: str) -> str:
        return _HELD_OUT[kind] if self.held_out else names

    def text(self, low: int, high: int, mark: str, known: tuple[str, ...] = ()) -> str:
        r = self.r
        out = [self.word() + r.choice(["", "", "", "", ",", "."]) for _ in range(r.randint(low, high))]
        if known and r.random() < 0.5:
            out.insert(0, r.choice(known))
        out[0] = out[0].capitalize()
        if r.random() < 0.15:
            k = r.randrange(len(out))
            out[k] = f"<{(t := r.choice(['b', 'i', 'em', 'span', 'strong', 'code']))}>{out[k]}</{t}>"
        if high > 8 and r.random() < 0.2:
            k = r.randrange(len(out))
            out[k] = f'<a href="/x">{out[k]}</a>'
        return mark + " ".join(out) + r.choice([".", ".", "", "!"])

    def open(self, tag: str, names: str, always: bool = False) -> str:
        """An opening tag, mostly with a class or id of these names, in some usual spelling."""
        r, names_ = self.r, names.split()
        if not always and r.random() < 0.15 or not names_:
            return f"<{tag}>"
        name = r.choice(names_)
        if r.random() < 0.35:
            name = r.choice([f"{name}-{r.choice('box wrap list inner block item container area main top'.split())}", f"{r.choice('site page post js l c'.split())}-{name}", f"{name} {self.word()}", f"{name}_{r.randint(1, 9)}", name.capitalize()])
        return f'<{tag} {r.choice(["class", "class", "id"])}="{name}">'

    def wrap(self, tag: str, names: str, inner: str, always: bool = False) -> str:
        return f"{self.open(tag, names, always)}{inner}</{tag}>"

    # what is not main text

    def links(self, low: int, high: int) -> str:
        items = [f'<a href="/{self.word()}">{self.text(1, 3, OTHER, ("Home", "About", "Contact", "News", "Menu", "Login"))}</a>' for _ in range(self.r.randint(low, high))]
        return self.r.choice([lambda: "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", lambda: " | ".join(items), lambda: "".join(f"<div>{x}</div>" for x in items)])()

    def nav(self) -> str:
        return self.r.choice([lambda: f"<nav>{self.links(2, 9)}</nav>", lambda: self.wrap("div", self.named("navigation", "nav menu navbar navigation breadcrumb breadcrumbs topbar tabs"), self.links(2, 9), True), lambda: self.wrap("ul", "menu nav breadcrumb pagination pager", "".join(f"<li><a href=/>{self.text(1, 2, OTHER)}</a></li>" for _ in range(self.r.randint(2, 7))), True)])()

    def header(self) -> str:
        inner = self.r.choice([f"<h1>{self.text(1, 4, OTHER)}</h1>", f"<div>{self.text(1, 5, OTHER)}</div>", f"<p>{self.text(2, 9, OTHER)}</p>"])
        inner += self.r.choice(["", self.nav(), f"<p>{self.text(2, 12, OTHER)}</p>"])
        return self.r.choice([lambda: f"<header>{inner}</header>", lambda: self.wrap("div", "header masthead banner top branding logo", inner, True)])()

    def footer(self) -> str:
        inner = self.text(2, 25, OTHER, ("&copy;", "Copyright", "Imprint", "Privacy"))
        inner = self.r.choice([inner, f"<p>{inner}</p>", f"<div>{inner}</div>{self.links(1, 6)}", f"<p>{inner}</p><p>{self.text(3, 30, OTHER)}</p>"])
        return self.r.choice([lambda: f"<footer>{inner}</footer>", lambda: self.wrap("div", "footer bottom copyright colophon legal", inner, True)])()

    def sidebar(self) -> str:
        inner = "".join(self.r.choice([f"<h3>{self.text(1, 4, OTHER, ('Popular', 'Recent', 'Tags', 'Archive'))}</h3>", f"<p>{self.text(4, 60, OTHER)}</p>", self.links(2, 6), f"<div>{self.text(3, 30, OTHER)}</div>"]) for _ in range(self.r.randint(1, 4)))
        return self.r.choice([lambda: self.wrap("aside", "sidebar widget related", inner), lambda: self.wrap("div", self.named("sidebar", "sidebar aside widget related popular recent recommended rail more secondary teaser"), inner, True), lambda: self.wrap("section", "related recommended sidebar more trending", inner, True)])()

    def advert(self) -> str:
        inner = self.text(2, 40, OTHER, ("Advertisement", "Sponsored", "Ad"))
        inner = self.r.choice([inner, f"<p>{inner}</p>", f'<a href="/ad">{inner}</a>', f"<span>{inner}</span>"])
        return self.wrap(self.r.choice(["div", "div", "aside", "section", "ins", "p"]).replace("ins", "div"), "ad ads advert advertisement advertising sponsor sponsored promo promoted promotion banner adsense commercial outbrain taboola dfp", inner, True)

    def notice(self) -> str:
        inner = self.text(4, 45, OTHER, ("We use cookies", "This site uses cookies", "Notice", "Attention", "Please accept"))
        inner = self.r.choice([inner, f"<p>{inner}</p>", f"<p>{inner}</p><button>{self.text(1, 2, OTHER, ('Accept', 'OK', 'Close'))}</button>"])
        return self.wrap(self.r.choice(["div", "div", "section", "aside", "dialog", "p"]), self.named("notice", "cookie cookies consent notice gdpr alert warning popup modal banner disclaimer overlay message paywall notification"), inner, True)

    def form(self) -> str:
        known = ("Search", "Subscribe", "Email", "Name", "Password", "Sign up", "Newsletter")
        inner = "".join(self.r.choice([f"<label>{self.text(1, 4, OTHER, known)}</label><input>", f"<button>{self.text(1, 2, OTHER, known)}</button>", f"<p>{self.text(3, 25, OTHER, known)}</p>", f"<select><option>{self.text(1, 2, OTHER)}</option><option>{self.text(1, 2, OTHER)}</option></select>", f"<textarea>{self.text(1, 6, OTHER)}</textarea>"]) for _ in range(self.r.randint(1, 4)))
        return self.r.choice([lambda: self.wrap("form", "search login newsletter subscribe contact signup", inner), lambda: self.wrap("div", "newsletter subscribe signup search login form contact", inner, True)])()

    def comments(self) -> str:
        def one() -> str:
            inner = f"<p>{self.text(3, 70, OTHER)}</p>"
            if self.r.random() < 0.6:
                inner = f"<{(t := self.r.choice(['div', 'span', 'h4', 'cite', 'strong', 'b']))}>{self.text(1, 3, OTHER, ('Reply', 'says'))}</{t}>" + inner
            return self.wrap(self.r.choice(["div", "li", "article", "div"]), "comment reply response discussion user message", inner)

        inner = "".join(one() for _ in range(self.r.randint(1, 6)))
        if self.r.random() < 0.6:
            inner = f"<h{(k := self.r.choice('234'))}>{self.text(1, 3, OTHER, ('Comments', 'Responses', 'Discussion'))}</h{k}>" + inner
        if self.r.random() < 0.3:
            inner += self.form()
        return self.wrap(self.r.choice(["div", "section", "ol", "ul", "div"]), self.named("comments", "comments comment commentlist disqus discussion responses replies respond reader-comments"), inner, True)

    def small(self) -> str:
        return self.wrap(self.r.choice(["div", "ul", "p"]), "share social sharing tags tools follow buttons pagination pager print", self.text(1, 6, OTHER, ("Share", "Tweet", "Print", "Tags")), True)

    def other(self) -> str:
        return self.r.choice([self.nav, self.header, self.footer, self.sidebar, self.advert, self.notice, self.form, self.comments, self.small])()

    # main text

    def paragraph(self) -> str:
        r = self.r
        long = r.choice([8, 30, 90, 200])
        kind = r.random()
        if kind < 0.62:
            body = self.text(1, long, MAIN)
            if r.random() < 0.1:
                body = "<b>" + body + "<br>"  # not closed
            return f"<p>{body}" + "</p>" * (r.random() < 0.93)
        if kind < 0.72:
            return f"<h{(k := r.choice('234'))}>{self.text(1, 9, MAIN)}</h{k}>"
        if kind < 0.8:
            return f"<{(t := r.choice(['ul', 'ol']))}>" + "".join(f"<li>{self.text(1, 25, MAIN)}</li>" for _ in range(r.randint(2, 5))) + f"</{t}>"
        if kind < 0.86:
            return f"<blockquote>{r.choice(['', '<p>'])}{self.text(5, 40, MAIN)}</blockquote>"
        if kind < 0.9:
            return f"<figure><img src=x><figcaption>{self.text(2, 15, MAIN)}</figcaption></figure>"
        if kind < 0.93:
            return "<table>" + "".join(f"<tr><td>{self.text(1, 5, MAIN)}</td><td>{self.text(1, 5, MAIN)}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>"
        if kind < 0.96:
            return f"<pre>{self.text(2, 30, MAIN)}</pre>"
        return f"<div>{self.text(3, 60, MAIN)}</div>"

    def article(self) -> str:
        r = self.r
        parts = [self.paragraph() for _ in range(r.choice([1, 2, 4, 8, 14]))]
        for _ in range(r.choice([0, 0, 0, 1, 1, 2])):
            parts.insert(r.randint(0, len(parts)), r.choice([self.advert, self.sidebar, self.form, self.small, self.notice])())
        if r.random() < 0.2:
            parts.append(r.choice([self.comments, self.small, self.footer])())
        title = f"<h1>{self.text(1, 14, MAIN)}</h1>"
        if r.random() < 0.15:
            title = f"<header>{title}</header>"
        if r.random() < 0.85:
            parts.insert(0, title)
        inner = "".join(parts)
        if r.random() < 0.3:
            inner = self.wrap(r.choice(["div", "section"]), "body content text entry copy post story prose", inner)
        kind = r.random()
        if kind < 0.08:
            return inner  # right in the body
        if kind < 0.45:
            return self.wrap("article", "post entry story hentry article", inner)
        if kind < 0.65:
            return self.wrap("main", "content main article", inner)
        return self.wrap(r.choice(["div", "div", "section", "td"]), self.named("container", "content article post entry story main body text page"), inner, True)

    def page(self) -> str:
        r = self.r
        before = [self.r.choice([self.nav, self.header, self.advert, self.notice, self.form, self.sidebar, self.small])() for _ in range(r.choice([0, 1, 2, 3, 5]))]
        after = [self.r.choice([self.comments, self.footer, self.sidebar, self.advert, self.form, self.small, self.notice])() for _ in range(r.choice([0, 1, 2, 3, 5]))]
        if r.random() < 0.6:
            before.insert(0, r.choice([self.nav, self.header])())
        if r.random() < 0.7:
            after.append(self.footer())
        body = "".join([*before, self.article() if r.random() < 0.97 else "", *after])
        if r.random() < 0.3:
            body = self.wrap("div", "wrapper page container layout site app root", body)
        head = f'<!DOCTYPE html><html lang="en"><head><title>{self.word()}</title><style>p{{}}</style></head><body>'
        page = head + body + r.choice(["</body></html>", ""])
        if self.held_out and r.random() < 0.5:
            page = page.replace('"', "'")
        if self.held_out and r.random() < 0.5:
            for tag in ("div", "p", "ul", "li", "section", "article", "nav", "footer", "header", "main"):
                page = page.replace(f"<{tag}", f"<{tag.upper()}").replace(f"</{tag}>", f"</{tag.upper()}\n>")
        return page

    def labelled(self) -> tuple[hb.Page, np.ndarray]:
        page = self.page()
        marked = hb.leaves(page)
        labels = np.array([MAIN in x.text for x in marked], np.float32)
        return hb.leaves(page.replace(MAIN, "").replace(OTHER, "")), labels


def start(rng: np.random.Generator) -> hb.Weights:
    n, h = hb.INPUT, hb.HIDDEN
    w = {"path": rng.normal(0, 0.1, (hb.PATHS, hb.PATH_SIZE)), "word": rng.normal(0, 0.1, (hb.WORDS, hb.WORD_SIZE)), "out": rng.normal(0, 0.1, (2 * h + n, 1)), "bias": np.zeros(1)}
    for d in "fr":
        w |= {f"{d}x": rng.normal(0, 0.2, (n, 4 * h)), f"{d}h": rng.normal(0, 0.2, (h, 4 * h)), f"{d}b": np.zeros(4 * h)}
        w[f"{d}b"][h : 2 * h] = 1
    return {k: v.astype(np.float32) for k, v in w.items()}


def gradients(w: hb.Weights, pages: list[hb.Page], labels: list[np.ndarray]) -> tuple[hb.Weights, float]:
    """The log loss of a batch and its gradient, by backpropagation through time."""
    x, mask = hb.padded(w, pages)
    keep: dict[str, list] = {"f": [], "r": []}
    z, hidden = hb.logits(w, x, mask, keep)
    y = np.zeros(mask.shape, np.float32)
    for k, own in enumerate(labels):
        y[: len(own), k] = own
    p = hb.sigmoid(z[:, :, 0])
    n = mask.sum()
    loss = float(-(mask * np.log(np.where(y > 0, p, 1 - p) + 1e-7)).sum() / n)
    dz = (p - y) * mask / n
    g = {k: np.zeros_like(v) for k, v in w.items()}
    g["out"] = (hidden * dz[:, :, None]).sum((0, 1))[:, None]
    g["bias"] = dz.sum(keepdims=True).reshape(1)
    dh_all = dz[:, :, None] * w["out"][:, 0]
    h = hb.HIDDEN
    dx = dh_all[:, :, 2 * h :].copy()
    for i, d in enumerate("fr"):
        dh = np.zeros((x.shape[1], h), np.float32)
        dc = np.zeros_like(dh)
        for t, (h0, c0), gi, gf, go, gg, _, th, m in reversed(keep[d]):
            dh = (dh + dh_all[t, :, i * h : (i + 1) * h]) * m
            do = dh * th
            dc = (dc + dh * go * (1 - th**2)) * m
            da = np.concatenate([dc * gg * gi * (1 - gi), dc * c0 * gf * (1 - gf), do * go * (1 - go), dc * gi * (1 - gg**2)], 1)
            g[f"{d}x"] += x[t].T @ da
            g[f"{d}h"] += h0.T @ da
            g[f"{d}b"] += da.sum(0)
            dx[t] += da @ w[f"{d}x"].T
            dh = da @ w[f"{d}h"].T
            dc = dc * gf
    flat = np.concatenate([dx[: len(own), k] for k, own in enumerate(pages)])
    every = [leaf for own in pages for leaf in own]
    at = 0
    for page in pages:
        own, at = flat[at : at + len(page), : hb.PATH_SIZE], at + len(page)
        # a change of the path adds to all leaves after it
        here = np.zeros((len(page.tokens) + 1, hb.PATH_SIZE))
        np.add.at(here, [x.at for x in page], own)
        after = here[::-1].cumsum(0)[::-1][1:]
        np.add.at(g["path"], page.tokens, after * np.array(page.signs)[:, None])
        last = np.array([x.last for x in page])
        np.add.at(g["path"], last[last >= 0], own[last >= 0])
    buckets, leaf, counts = hb.words_of(every)
    np.add.at(g["word"], buckets, (flat[:, hb.PATH_SIZE : hb.PATH_SIZE + hb.WORD_SIZE] / np.maximum(1, counts)[:, None])[leaf])
    return g, loss


def train(steps: int = STEPS, seed: int = SEED, batch: int = BATCH, rate: float = RATE, say=None) -> hb.Weights:
    """Adam over freshly made pages, the rate falling to nothing; the same seed gives the same weights."""
    w, source = start(np.random.default_rng(seed)), Pages(seed)
    first = {k: np.zeros_like(v) for k, v in w.items()}
    second = {k: np.zeros_like(v) for k, v in w.items()}
    for step in range(1, steps + 1):
        made = [x for x in (source.labelled() for _ in range(batch)) if x[0]]
        g, loss = gradients(w, [a for a, _ in made], [b for _, b in made])
        now = rate * (1 - (step - 1) / steps)
        for k in w:
            first[k] = 0.9 * first[k] + 0.1 * g[k]
            second[k] = 0.999 * second[k] + 0.001 * g[k] ** 2
            w[k] -= now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        if say and step % 100 == 0:
            say(f"{step} {loss:.4f}")
    return w


def accuracy(w: hb.Weights, pages: int = 500, seed: int = 77, held_out: bool = False) -> float:
    """The share of blocks labelled right on pages of another seed, or with names and a script that training never had."""
    source, right, n = Pages(seed, held_out), 0, 0
    for _ in range(pages):
        own, labels = source.labelled()
        if own:
            z, _ = hb.logits(w, *hb.padded(w, [own]))
            right += int(((z[:, 0, 0] > 0) == (labels > 0)).sum())
            n += len(own)
    return right / n


if __name__ == "__main__":
    found = train(say=print)
    np.savez_compressed(Path(__file__).with_name(hb.MODEL), **{k: v.astype(np.float16) for k, v in found.items()})
    print(f"accuracy on other pages: {accuracy(hb.load()):.4f}; on pages with names and a script kept from training: {accuracy(hb.load(), held_out=True):.4f}")
