"""HTML extraction by a recurrent block labeller.

A page becomes a sequence of blocks: the text between two block-level tags, with the path of tags above it. A bidirectional
LSTM in numpy reads, for each block, vectors of its tag path (with class and id words) and of its hashed words, and
says whether it is main text; as it reads the whole sequence in both directions, a block's label depends on the whole
page. It is trained when first used, on pages drawn from a grammar of layouts (articles with headings, lists, quotes and
tables, among menus, headers, footers, sidebars, notices, adverts, forms and reader comments), whose labels are known.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, trimmed

# Elements of the HTML standard.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header "
    "hgroup hr html legend li main menu nav noscript ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul video".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no text.
RAW_TAGS = frozenset(["script", "style", "template", "noscript", "textarea", "iframe", "svg", "annotation", "canvas", "head"])
TEXT_ONLY_TAGS = frozenset(["script", "style", "textarea", "iframe", "title", "noscript"])
#: Elements that a head may hold; any other ends it.
HEAD_TAGS = frozenset(["base", "link", "meta", "noscript", "script", "style", "template", "title"])
#: An open element of the key ends where one of these begins.
IMPLIED_END = {"p": BLOCK_TAGS, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>", re.DOTALL)
_ATTRIBUTE = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.IGNORECASE)
_NAME = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")

PATH_SLOTS = 512
WORD_SLOTS = 1024
EMBED = 16
HIDDEN = 24
NUMBERS = 6


def blocks(page: str) -> list[tuple[str, list[str], int, int]]:
    """(text, path, link code points, all code points) of the blocks of a page, in order; a path lists tags, and class, id and role words as tag.word."""
    out: list[tuple[str, list[str], int, int]] = []
    stack: list[tuple[str, list[str]]] = []
    parts: list[str] = []
    linked, skip, at = 0, 0, 0
    links = 0

    def close() -> None:
        nonlocal linked
        text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
        if text:
            out.append((text, [x for _, xs in stack for x in xs], min(linked, len(text)), len(text)))
        parts.clear()
        linked = 0

    def pop(to: int) -> None:
        nonlocal skip, links
        while len(stack) > to:
            name, _ = stack.pop()
            skip -= name in RAW_TAGS
            links -= name == "a"

    n = len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text and not skip:
            parts.append(text)
            if links:
                linked += len(text)
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        name, end = m[2].lower(), bool(m[1])
        if name == "br":
            parts.append(" ")
            continue
        if end:
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
            if depth is None:
                continue
            if name in BLOCK_TAGS or any(t in BLOCK_TAGS for t, _ in stack[depth:]):
                close()
            pop(depth)
            continue
        if stack and stack[-1][0] == "head" and name not in HEAD_TAGS:
            pop(len(stack) - 1)
        while stack and name in IMPLIED_END.get(stack[-1][0], ()):
            close()
            pop(len(stack) - 1)
        if name in BLOCK_TAGS:
            inline = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] in IMPLIED_END and stack[k][0] == "p"), None)
            close()
            if inline is not None and all(t not in BLOCK_TAGS for t, _ in stack[inline + 1 :]):
                pop(inline)  # an open paragraph ends, with the inline elements in it
        if name in VOID_TAGS:
            continue
        if name in TEXT_ONLY_TAGS:
            stop = re.compile(rf"</{name}\s*>", re.IGNORECASE).search(page, at)
            if name == "title" or name in RAW_TAGS:
                at = stop.end() if stop else n
                continue
        words = [f"{name}.{w}" for g in _ATTRIBUTE.findall(m[3]) for w in _NAME.findall((g[0] or g[1] or g[2]).lower())] if "=" in m[3] else []
        stack.append((name, [name, *words]))
        skip += name in RAW_TAGS
        links += name == "a"
    close()
    return out


def _slot(text: str, slots: int) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) % slots


@lru_cache(100_000)
def _path_slot(x: str) -> int:
    return _slot(x, PATH_SLOTS)


@lru_cache(200_000)
def _word_slot(x: str) -> int:
    return _slot(x, WORD_SLOTS)


def inputs(page: list[tuple[str, list[str], int, int]]) -> tuple[list[list[int]], list[list[int]], np.ndarray]:
    """For each block: slots of its whole path, slots of all its words, and numbers about its length, links and place."""
    paths, words, numbers = [], [], np.zeros((len(page), NUMBERS))
    for k, (text, path, linked, n) in enumerate(page):
        own = [_path_slot(x) for x in path]
        paths.append(own + ([_path_slot("leaf>" + path[-1])] if path else []) or [0])
        words.append([_word_slot(w) for w in text.lower().split()] or [0])
        marks = sum(text.count(c) for c in ".,;:!?")
        numbers[k] = (np.log1p(n) / 6, linked / max(1, n), min(1.0, 20 * marks / max(1, n)), k / max(1, len(page) - 1), text[-1] in ".!?:\"'", min(1.0, len(path) / 12))
    return paths, words, numbers


class Labeller:
    """Embeddings of path and word slots, a bidirectional LSTM over a page's blocks, a logistic output for each block."""

    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        width = 2 * EMBED + NUMBERS
        self.p = {"path": r.normal(0, 0.1, (PATH_SLOTS, EMBED)), "word": r.normal(0, 0.1, (WORD_SLOTS, EMBED)), "out": r.normal(0, 0.1, 2 * HIDDEN + width), "bias": np.zeros(1)}
        for d in "fb":
            self.p["W" + d] = r.normal(0, 1 / np.sqrt(width), (width, 4 * HIDDEN))
            self.p["U" + d] = r.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN))
            self.p["c" + d] = np.concatenate([np.ones(HIDDEN), np.zeros(3 * HIDDEN)])

    def _embed(self, pages: list) -> tuple[np.ndarray, np.ndarray]:
        """pages x longest x width, and the mask of blocks that are there."""
        longest = max(len(p[0]) for p in pages)
        x, mask = np.zeros((len(pages), longest, 2 * EMBED + NUMBERS)), np.zeros((len(pages), longest), bool)
        for name, place in (("path", 0), ("word", 1)):
            lists = [l for p in pages for l in p[place]]
            sizes = np.array([len(l) for l in lists])
            flat = np.concatenate([np.array(l) for l in lists])
            means = np.add.reduceat(self.p[name][flat], np.cumsum(sizes) - sizes, axis=0) / sizes[:, None]
            at = 0
            for i, p in enumerate(pages):
                x[i, : len(p[0]), place * EMBED : (place + 1) * EMBED] = means[at : at + len(p[0])]
                at += len(p[0])
        for i, p in enumerate(pages):
            x[i, : len(p[0]), 2 * EMBED :], mask[i, : len(p[0])] = p[2], True
        return x, mask

    def _lstm(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        n, length, _ = x.shape
        h, c, out, tape = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN)), np.zeros((n, length, HIDDEN)), []
        z0 = x @ self.p["W" + d] + self.p["c" + d]
        for t in range(length) if d == "f" else range(length - 1, -1, -1):
            z = z0[:, t] + h @ self.p["U" + d]
            s = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
            f, i, o, g = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
            m = mask[:, t : t + 1]
            new = f * c + i * g
            tc = np.tanh(new)
            if keep:
                tape.append((t, f, i, o, g, c, tc, h, m))
            c, h = np.where(m, new, c), np.where(m, o * tc, h)
            out[:, t] = h * m
        return out, tape

    def logits(self, pages: list) -> list[np.ndarray]:
        x, mask = self._embed(pages)
        hf, hb = (self._lstm(x, mask, d, False)[0] for d in "fb")
        z = np.concatenate([hf, hb, x], axis=2) @ self.p["out"] + self.p["bias"]
        return [z[i, : len(p[0])] for i, p in enumerate(pages)]

    def _gradients(self, pages: list, labels: list[np.ndarray]) -> dict[str, np.ndarray]:
        x, mask = self._embed(pages)
        (hf, tf), (hb, tb) = (self._lstm(x, mask, d, True) for d in "fb")
        all_ = np.concatenate([hf, hb, x], axis=2)
        z = all_ @ self.p["out"] + self.p["bias"]
        y = np.zeros(mask.shape)
        for i, l in enumerate(labels):
            y[i, : len(l)] = l
        dz = (1 / (1 + np.exp(-z)) - y) * mask / mask.sum()
        g = {"out": np.tensordot(dz, all_, ((0, 1), (0, 1))), "bias": np.array([dz.sum()])}
        dall = dz[:, :, None] * self.p["out"]
        dx = dall[:, :, 2 * HIDDEN :].copy()
        for d, tape, dh_out in (("f", tf, dall[:, :, :HIDDEN]), ("b", tb, dall[:, :, HIDDEN : 2 * HIDDEN])):
            dz_all = np.zeros((*mask.shape, 4 * HIDDEN))
            dh, dc, du = np.zeros((len(pages), HIDDEN)), np.zeros((len(pages), HIDDEN)), np.zeros_like(self.p["U" + d])
            for t, f, i, o, gg, c, tc, h, m in reversed(tape):
                now = (dh + dh_out[:, t]) * m
                dnew = dc * m + now * o * (1 - tc**2)
                dzt = np.concatenate([dnew * c * f * (1 - f), dnew * gg * i * (1 - i), now * tc * o * (1 - o), dnew * i * (1 - gg**2)], axis=1)
                dz_all[:, t] = dzt
                du += h.T @ dzt
                dh, dc = np.where(m, dzt @ self.p["U" + d].T, dh), np.where(m, dnew * f, dc)
            g["U" + d], g["W" + d], g["c" + d] = du, np.tensordot(x, dz_all, ((0, 1), (0, 1))), dz_all.sum(axis=(0, 1))
            dx += dz_all @ self.p["W" + d].T
        flat_dx = dx[mask]
        for name, place in (("path", 0), ("word", 1)):
            lists = [slots for p in pages for slots in p[place]]
            sizes = np.array([len(slots) for slots in lists])
            g[name] = np.zeros_like(self.p[name])
            np.add.at(g[name], np.concatenate([np.array(slots) for slots in lists]), np.repeat(flat_dx[:, place * EMBED : (place + 1) * EMBED] / sizes[:, None], sizes, axis=0))
        return g

    def fit(self, pages: list, labels: list[np.ndarray], epochs: int, batch: int = 16, rate: float = 0.01, seed: int = 5) -> Labeller:
        """Adam over batches of pages of similar length."""
        r = np.random.default_rng(seed)
        m, v, step = {k: np.zeros_like(a) for k, a in self.p.items()}, {k: np.zeros_like(a) for k, a in self.p.items()}, 0
        order = np.argsort([len(p[0]) for p in pages], kind="stable")
        for _ in range(epochs):
            for b in r.permutation(-(-len(pages) // batch)):
                some = order[b * batch : (b + 1) * batch]
                step += 1
                for k, g in self._gradients([pages[i] for i in some], [labels[i] for i in some]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
        return self


# Class and id words in common use, by the part of a page that they name.
BOILER = {
    "menu": (["nav", "div", "ul", "menu"], ["menu", "nav", "navbar", "navigation", "breadcrumb", "tabs", "topbar"]),
    "header": (["header", "div"], ["header", "masthead", "banner", "logo", "site-header", "top"]),
    "footer": (["footer", "div"], ["footer", "copyright", "bottom", "site-footer", "legal", "colophon"]),
    "sidebar": (["aside", "div", "section"], ["sidebar", "side", "widget", "related", "recommended", "more", "trending", "popular", "tags"]),
    "notice": (["div", "section", "dialog", "aside"], ["cookie", "consent", "notice", "gdpr", "alert", "popup", "modal", "newsletter", "subscribe", "paywall"]),
    "advert": (["div", "aside", "section", "ins"], ["ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "adbox", "banner-ad"]),
    "form": (["form", "div", "fieldset"], ["form", "login", "search", "signup", "contact-form", "newsletter-form"]),
    "comments": (["section", "div", "ol", "ul"], ["comments", "comment", "comment-list", "discussion", "replies", "responses", "disqus", "reader-comments"]),
    "share": (["div", "ul"], ["share", "social", "sharing", "follow", "buttons"]),
}
WRAPPERS = ["container", "wrapper", "row", "col", "inner", "grid", "block", "box", "layout", "column", "wrap", "holder"]
MAIN = (["article", "main", "div", "section"], ["article", "content", "main", "post", "entry", "entry-content", "story", "body", "article-body", "post-content", "text"])


def training_page(r: random.Random) -> str:
    """A page whose main blocks begin with a mark, U+E000."""
    syllables = ["an", "er", "th", "re", "on", "ing", "ed", "ti", "la", "que", "en", "ou", "sch", "ge", "ver", "ción", "os", "ado", "é", "ment", "st", "wh", "ble", "ü"]
    word = lambda: "".join(r.choices(syllables, k=r.choice([1, 1, 2, 2, 3])))
    def sentence(lo: int, hi: int) -> str:
        ws = [word() for _ in range(r.randint(lo, hi))]
        style = r.random()
        if style < 0.06:
            ws = [w + r.choice(["###", "$$$", "%%%", "&amp;&amp;&amp;", "***"]) for w in ws]
        elif style < 0.1:
            ws = [w.upper() + "!!" for w in ws]
        elif style < 0.14:
            return " | ".join(ws)
        return " ".join(ws).capitalize() + r.choice([".", ".", ".", "", "!", "?"])
    text = lambda lo, hi, k=3: " ".join(sentence(lo, hi) for _ in range(r.randint(1, k)))
    link = lambda: f'<a href="/{word()}">{sentence(1, 4)}</a>'

    def tag(names: list[str], classes: list[str], inner: str, certain: bool = False) -> str:
        name = r.choice(names)
        named = certain or r.random() < (0.97 if name in ("div", "section", "ul", "ol", "fieldset") else 0.5)
        attribute = r.choice(["class", "class", "id"])
        return f"<{name}{f' {attribute}={chr(34)}{r.choice(classes)}{chr(34)}' if named else ''}>{inner}</{name}>"

    def wrapped(inner: str) -> str:
        """inner within neutral elements, often none and sometimes many."""
        for _ in range(r.choice([0, 0, 0, 0, 1, 2, 4, 6])):
            inner = f'<div class="{" ".join(r.sample(WRAPPERS, r.randint(1, 2)))}">{inner}</div>'
        return inner

    def boiler(kind: str) -> str:
        names, classes = BOILER[kind]
        if kind in ("menu", "share"):
            items = [link() for _ in range(r.randint(2, 9))]
            inner = "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>" if r.random() < 0.7 else r.choice([" ", " | ", " &middot; "]).join(items)
        elif kind == "form":
            inner = f"<label>{sentence(1, 3)}</label><input type='text'><button>{sentence(1, 2)}</button>" + (f"<p>{text(3, 9, 1)}</p>" if r.random() < 0.4 else "")
        elif kind == "comments":
            inner = (f"<h3>{sentence(1, 3)}</h3>" if r.random() < 0.6 else "") + "".join(tag(["div", "li", "article"], ["comment", "reply", "comment-body"], r.choice([f"<b>{word()}</b> ", f"<cite>{word()}</cite>", ""]) + f"<p>{text(4, 22)}</p>") for _ in range(r.randint(1, 5)))
        elif kind == "sidebar":
            inner = f"<h4>{sentence(1, 3)}</h4>" + r.choice(["<ul>" + "".join(f"<li>{link()}</li>" for _ in range(r.randint(2, 6))) + "</ul>", f"<p>{text(4, 14, 2)}</p>"])
        elif kind == "footer":
            inner = r.choice([f"&copy; {word()}.example.com &middot; {text(3, 16, 2)}", f"<p>&copy; 20{r.randint(10, 29)} {sentence(1, 4)}</p>" + "".join(link() for _ in range(r.randint(0, 5)))])
        else:
            inner = r.choice([text(3, 16, 2), f"<p>{text(4, 16, 2)}</p>", f"<p>{text(4, 12, 1)}</p><button>{word()}</button>", link()])
        return tag(names, classes, wrapped(inner))

    def para() -> str:
        kind = r.random()
        mark = "\ue000"
        if kind < 0.62:
            body = mark + text(*r.choice([(1, 3, 1), (3, 40, 5), (3, 40, 5), (3, 40, 5)]))
            if r.random() < 0.2:
                body += f' {link()} {text(2, 9, 1)}'
            if r.random() < 0.1:
                body = f"<b>{body}<br>" if r.random() < 0.5 else f"<b>{body}</b>"
            return f"<p>{body}" + ("</p>" if r.random() < 0.93 else "")
        if kind < 0.72:
            return f"<h{(k := r.randint(2, 4))}>{mark}{sentence(1, 6)}</h{k}>"
        if kind < 0.8:
            name = r.choice(["ul", "ol"])
            return f"<{name}>" + "".join(f"<li>{mark}{sentence(2, 14)}</li>" for _ in range(r.randint(2, 6))) + f"</{name}>"
        if kind < 0.86:
            return f"<blockquote><p>{mark}{text(4, 24, 2)}</p></blockquote>"
        if kind < 0.9:
            return f"<pre>{mark}{text(2, 14, 2)}</pre>"
        if kind < 0.94:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{mark}{sentence(1, 4)}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(1, 4))) + "</table>"
        return f"<p>{mark}{sentence(1, 2)}</p>"

    body = [para() for _ in range(r.choice([0, 1, 2, 3, 5, 8, 13, 21]))]
    title = f"<h1>\ue000{sentence(1, 9)}</h1>" if r.random() < 0.85 else ""
    for _ in range(r.choice([0, 0, 0, 1, 1, 2])):
        body.insert(r.randint(0, len(body)), boiler(r.choice(["advert", "advert", "notice", "sidebar", "share", "form"])))
    main = tag(*MAIN, wrapped(title + "".join(body)), certain=r.random() < 0.6)
    if r.random() < 0.25:
        main = tag(["main", "div"], MAIN[1] + ["container", "wrapper", "page"], main)
    before = [boiler(k) for k in ("header", "menu", "notice", "advert", "form", "sidebar", "share") if r.random() < 0.35]
    after = [boiler(k) for k in ("sidebar", "comments", "advert", "form", "notice", "menu", "share", "footer") if r.random() < 0.35]
    r.shuffle(before)
    page = "".join(before) + main + "".join(after)
    if r.random() < 0.3:
        page = f'<div class="{r.choice(["container", "wrapper", "page", "site", "layout"])}">{page}</div>'
    head = f"<head><title>{sentence(1, 5)}</title><style>p{{margin:0}}</style></head>" if r.random() < 0.8 else ""
    return f"<!DOCTYPE html><html>{head}<body>{page}</body></html>"


def trained(pages: int = 1500, epochs: int = 6, seed: int = 17) -> Labeller:
    r = random.Random(seed)
    xs, ys = [], []
    for _ in range(pages):
        found = blocks(training_page(r))
        if found:
            ys.append(np.array(["\ue000" in text for text, *_ in found], float))
            xs.append(inputs([(text.replace("\ue000", "") or "-", path, linked, n) for text, path, linked, n in found]))
    return Labeller().fit(xs, ys, epochs)


def main_text(found: list[tuple[str, list[str], int, int]], z: np.ndarray) -> str:
    return "\n\n".join(b[0] for b, s in zip(found, z, strict=True) if s > 0)


#: Blocks of one batch of pages that are labelled together.
BATCH_BLOCKS = 8192


def extract(pages: list[str | None], model: Labeller) -> list[str]:
    parsed = [blocks(p or "") for p in pages]
    out = [""] * len(pages)
    order = [i for i in sorted(range(len(pages)), key=lambda i: len(parsed[i])) if parsed[i]]
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and len(parsed[order[end]]) * (end - at + 1) <= BATCH_BLOCKS and end - at < 64:
            end += 1
        some = order[at:end]
        for i, z in zip(some, model.logits([inputs(parsed[i]) for i in some]), strict=True):
            out[i] = main_text(parsed[i], z)
        at = end
    return out


def extract_text(pages: DataFrame, *, markup: str = "html", model: Labeller | None = None) -> DataFrame:
    """pages without markup, with text (empty if none) and n_chars. A null page is empty; no block is cut or dropped by length.

    Columns named text or n_chars are replaced, all others stay.
    """
    kept = [c for c in pages.columns if c not in ("text", "n_chars", markup)]
    shared = pages.sparkSession.sparkContext.broadcast(model or trained())
    docs = pages.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{markup}`"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema][: len(kept)] + ["text string", "n_chars long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                some = batch.slice(at, 128)
                texts = extract(some.column(len(kept)).to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([*some.columns[: len(kept)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*kept, "text", "n_chars"])

    return docs.mapInArrow(trimmed(run), schema)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
