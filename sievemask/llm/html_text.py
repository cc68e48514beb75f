"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks: runs of text without a block-level tag between them. A block is described by hashed features of its
tag path (tags, and words of classes and ids), a hashed mean of its words, and a few measures (length, share of text in links,
stops). A bidirectional LSTM in numpy reads a page's blocks in order, in both directions, so each block is classified in the
context of the whole page; blocks classified as main text are joined.

It is trained here, on SAMPLE_PAGES pages (those with the least hash of their id, up to SAMPLE_BYTES each). Blocks of these pages are
labelled by the meaning of their containers, where HTML defines one. As one site's pages look alike, their texts are also set into
other arrangements of containers, which are drawn with a fixed seed; there the label is known.

Defined cases: a null or empty page, or one without text, gives an empty text; a page of plain text is one block; unclosed tags
end with their container, unknown end tags are ignored; markup that is cut off at the end of a page is dropped; a tag ends at the first '>'
outside a quoted value, and a quote that is nowhere closed quotes nothing; without any training
page the arrangements have no texts and every block is kept; rows that repeat an id give a row each; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemask.llm.common import table

SAMPLE_PAGES, SAMPLE_BYTES = 192, 256 * 1024
PATH, WORDS, MEASURES, HIDDEN = 256, 32, 6, 12
INPUT = PATH + WORDS + MEASURES
EPOCHS, BATCH, RATE = 10, 24, 0.01

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rt s samp small span strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
# Attributes as HTML reads them: a quote opens a value only right after '='. One that is never closed is a part of a bare value.
ATTRIBUTES = r"(?:[\t\n\f\r /]++|[^\t\n\f\r />][^\t\n\f\r />=]*+(?:[\t\n\f\r ]*+=[\t\n\f\r ]*+(?:\"[^\"]*+\"|'[^']*+'|[^\t\n\f\r >]*+))?+)*+"
MARKUP = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(script|style|template|noscript|svg|textarea|select|title|iframe|object|math)(?=[\t\n\f\r />]){ATTRIBUTES}>.*?(?:</\1\s*>|\Z)"
    rf"|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\t\n\f\r />]*+)({ATTRIBUTES})(?:>|\Z)",
    re.S | re.I,
)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
LETTERS = re.compile(r"[a-z]+")
WHITE = re.compile(r"\s+")

# Containers by what HTML, or the plain meaning of their names, says of them.
ASIDE_TAGS = ("nav", "footer", "aside", "form", "menu", "dialog", "button")
ASIDE_NAMES = (
    "nav", "menu", "navbar", "navigation", "breadcrumb", "footer", "sidebar", "widget", "ad", "advert", "advertisement", "ads", "banner", "promo", "sponsor", "sponsored",
    "cookie", "notice", "consent", "gdpr", "popup", "modal", "alert", "newsletter", "subscribe", "signup", "login", "search", "share", "social", "related", "recommended",
    "comment", "comments", "reply", "discussion", "disqus", "tags", "pagination", "toolbar", "topbar", "masthead", "header", "copyright", "legal", "skip",
)
MAIN_TAGS = ("article", "main")
MAIN_NAMES = ("content", "article", "post", "entry", "story", "main", "body", "text")


def blocks(html: str | None) -> list[tuple[tuple, str, float]]:
    """(path, text, share of the text inside links) of each leaf block. A path is ((tag, name words), ...), outermost first."""
    stack: list[tuple[str, tuple[str, ...]]] = []
    out, held, linked, links, at = [], [], 0, 0, 0
    html = html or ""

    def flush() -> None:
        nonlocal held, linked
        if held:
            text = WHITE.sub(" ", unescape("".join(held))).strip()
            if text:
                path = tuple(x for x in stack if x[0] not in INLINE)
                out.append((path, text, min(1.0, linked / max(1, len(text)))))
        held, linked = [], 0

    def add(text: str) -> None:
        nonlocal linked
        if text:
            held.append(text)
            linked += len(text.strip()) if links else 0

    for m in MARKUP.finditer(html):
        add(html[at : m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if m[1]:  # content that is no text
            if m[1].lower() in ("textarea", "select", "title", "iframe"):
                flush()
            continue
        if not tag:
            continue
        if m[2]:
            at_depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if tag not in INLINE:
                flush()
            if at_depth is not None and (tag not in INLINE or all(x[0] in INLINE for x in stack[at_depth:])):
                del stack[at_depth:]
        else:
            if tag == "br":
                held.append(" ")
                continue
            if tag not in INLINE:
                flush()
                if tag in ENDS_P:
                    _close(stack, {"p"})
                if tag in CLOSES:
                    _close(stack, CLOSES[tag])
            if tag not in VOID and not m[4].endswith("/"):
                names = LETTERS.findall(" ".join(a or b or c for a, b, c in NAMED.findall(m[4])).lower()) if "=" in m[4] else ()
                stack.append((tag, tuple(n[:-1] if n.endswith("s") and n[:-1] in ASIDE_NAMES else n for n in names)))
        links = sum(x[0] == "a" for x in stack)
    tail = html[at:]
    add(tail if not re.match(r"<[a-zA-Z/!?]", tail) else "")
    flush()
    return out


def _close(stack: list, tags: set[str]) -> None:
    """Closes an open element of `tags`, and what is open inside it, within the nearest other container."""
    for i in range(len(stack) - 1, -1, -1):
        if stack[i][0] in tags:
            del stack[i:]
            return
        if stack[i][0] not in INLINE and stack[i][0] != "p":
            return


def _bucket(word: str, size: int) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % size


def features(page: list[tuple[tuple, str, float]]) -> np.ndarray:
    x = np.zeros((len(page), INPUT), np.float32)
    for i, (path, text, linked) in enumerate(page):
        for tag, names in path:
            x[i, _bucket(f"<{tag}", PATH)] = 1
            for n in names:
                x[i, _bucket(n, PATH)] = 1
        if path:
            x[i, _bucket(f"own {path[-1][0]}", PATH)] = 1
        spoken = text.lower().split()
        if spoken:
            x[i, PATH : PATH + WORDS] = np.bincount([_bucket(w, WORDS) for w in spoken], minlength=WORDS) / len(spoken)
        stops = sum(text.count(c) for c in ".!?…。")
        x[i, PATH + WORDS :] = (min(1.0, np.log1p(len(text)) / 8), linked, min(1.0, stops / 8), stops == 0, len(spoken) < 5, i / max(1, len(page)))
    return x


def label(path: tuple) -> float | None:
    """What the containers say: 1 for main text, 0 for the rest, None if they say nothing. The innermost that speaks decides."""
    inside = False
    for tag, names in reversed(path):
        if tag in ASIDE_TAGS or any(n in ASIDE_NAMES for n in names):
            return 0.0
        if tag == "header":
            inside = True
        elif tag in MAIN_TAGS or any(n in MAIN_NAMES for n in names):
            return 1.0
    return 0.0 if inside else None


def _split(text: str, rng: np.random.Generator) -> list[str]:
    """Points of a list: some words each."""
    spoken = text.split(" ")
    size = int(rng.integers(2, 12))
    return [" ".join(spoken[a : a + size]) for a in range(0, min(len(spoken), 6 * size), size)]


def arrangements(pages: list[list], rng: np.random.Generator) -> list[tuple[list, list[float]]]:
    """The pages' texts in other containers, with labels."""
    out = []
    for page in pages:
        main = [b for b in page if label(b[0]) == 1.0]
        rest = [b for b in page if label(b[0]) == 0.0]
        if not main:
            continue
        shells = [("article", ()), ("main", ())] + [("div", (n,)) for n in MAIN_NAMES] + [("section", ()), ("div", ()), ("td", ())]
        shell = (("html", ()), ("body", ()), *[shells[i] for i in rng.choice(len(shells), rng.integers(1, 3), replace=False)])
        bare = rng.random()
        if bare < 0.12:  # no containers that mean anything, or none at all
            shell = () if bare < 0.04 else (("html", ()), ("body", ()))
        made, labels = [], []

        def aside(base: tuple) -> None:
            pick = rng.integers(len(ASIDE_TAGS) + len(ASIDE_NAMES) + 1)
            tags = ("div", "ul", "section", "ol", "span", "header") if rng.random() < 0.9 else ("article",)
            if pick < len(ASIDE_TAGS):
                box = (ASIDE_TAGS[pick], ())
            elif pick < len(ASIDE_TAGS) + len(ASIDE_NAMES):
                box = (tags[rng.integers(len(tags))], (ASIDE_NAMES[pick - len(ASIDE_TAGS)],))
            else:
                box = ("header", ())
            texts = rest + main if rest and rng.random() < 0.7 else main
            for _ in range(rng.integers(1, 6)):
                own = ("li", "p", "div", "h3", "a", "label", "h1")[rng.integers(7)]
                _, text, _ = texts[rng.integers(len(texts))]
                inner = ((own, ()),) if own not in INLINE else ()
                made.append((base + (box,) + inner, text, float(rng.random() < 0.5)))
                labels.append(0.0)

        for _ in range(rng.integers(0, 4) if shell else 0):
            aside(shell[:2])
        for k, (path, text, linked) in enumerate(main):
            own = path[-1] if path and path[-1][0] not in MAIN_TAGS else ("p", ())
            inner: tuple = (own,)
            if rng.random() < 0.35:
                tag = ("p", "h2", "li", "li", "blockquote", "td", "pre", "dd")[rng.integers(8)]
                inner = ((("ul", "ol")[rng.integers(2)], ()), (tag, ())) if tag == "li" else ((tag, ()),)
            inner = ((("header", ()),) if k == 0 and len(shell) > 2 and shell[-1][0] == "article" and rng.random() < 0.1 else ()) + inner
            for part in _split(text, rng) if inner[-1][0] == "li" else [text]:
                made.append((shell + (inner if shell else ()), part, linked))
                labels.append(1.0)
            if shell and rng.random() < 0.08:
                aside(shell)
        if len(shell) > 2 and rng.random() < 0.4:
            aside(shell)
        for _ in range(rng.integers(0, 4) if shell else 0):
            aside(shell[:2])
        out.append((made, labels))
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """A bidirectional LSTM with a logistic output for each block."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.p: dict[str, np.ndarray] = {}
        for way in ("f", "b"):
            self.p[f"w{way}"] = rng.normal(0, 0.08, (INPUT, 4 * HIDDEN))
            self.p[f"u{way}"] = rng.normal(0, 0.15, (HIDDEN, 4 * HIDDEN))
            self.p[f"c{way}"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
        self.p["o"] = rng.normal(0, 0.2, 2 * HIDDEN)
        self.p["oc"] = np.zeros(1)

    def _run(self, way: str, x: np.ndarray, mask: np.ndarray, keep: bool):
        """x: (T, B, INPUT). Hidden states (T, B, HIDDEN); places behind a page's end carry the state on."""
        z_in = x @ self.p[f"w{way}"] + self.p[f"c{way}"]
        u, steps, batch = self.p[f"u{way}"], x.shape[0], x.shape[1]
        h, c = np.zeros((batch, HIDDEN)), np.zeros((batch, HIDDEN))
        hs, tape = np.empty((steps, batch, HIDDEN)), []
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            z = z_in[t] + h @ u
            i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in (0, 1, 2))
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            new_c = f * c + i * g
            new_h = o * np.tanh(new_c)
            if keep:
                tape.append((t, h, c, i, f, o, g, new_c))
            c, h = np.where(m, new_c, c), np.where(m, new_h, h)
            hs[t] = h
        return hs, tape

    def outputs(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        (hf, tf), (hb, tb) = self._run("f", x, mask, keep), self._run("b", x, mask, keep)
        both = np.concatenate([hf, hb], axis=2)
        return _sigmoid(both @ self.p["o"] + self.p["oc"]), both, tf, tb

    def gradients(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> dict[str, np.ndarray]:
        p, both, tf, tb = self.outputs(x, mask, True)
        d = np.where(mask, p - y, 0) / mask.sum()
        g = {"o": np.einsum("tb,tbh->h", d, both), "oc": np.array([d.sum()])}
        d_both = d[:, :, None] * self.p["o"]
        for way, tape, part in (("f", tf, slice(0, HIDDEN)), ("b", tb, slice(HIDDEN, 2 * HIDDEN))):
            u = self.p[f"u{way}"]
            dh_next, dc_next = np.zeros(both.shape[1:2] + (HIDDEN,)), np.zeros(both.shape[1:2] + (HIDDEN,))
            dz_all, gu = np.zeros(x.shape[:2] + (4 * HIDDEN,)), np.zeros_like(u)
            for t, h, c, i, f, o, gg, new_c in reversed(tape):
                m = mask[t][:, None]
                dh = d_both[t][:, part] + dh_next
                tc = np.tanh(new_c)
                dc = np.where(m, dc_next + dh * o * (1 - tc * tc), 0)
                dz = np.concatenate([dc * gg * i * (1 - i), dc * c * f * (1 - f), np.where(m, dh, 0) * tc * o * (1 - o), dc * i * (1 - gg * gg)], axis=1)
                dz_all[t] = dz
                gu += h.T @ dz
                dh_next = dz @ u.T + np.where(m, 0, dh)
                dc_next = np.where(m, dc * f, dc_next)
            g[f"u{way}"], g[f"c{way}"] = gu, dz_all.sum((0, 1))
            g[f"w{way}"] = x.reshape(-1, INPUT).T @ dz_all.reshape(-1, 4 * HIDDEN)
        return g

    def train(self, pages: list[np.ndarray], labels: list[np.ndarray], seed: int = 5) -> Labeller:
        """Adam over batches of pages of similar length; longer pages are cut into stretches of 64 blocks."""
        parts = [(x[a : a + 64], y[a : a + 64]) for x, y in zip(pages, labels, strict=True) for a in range(0, len(x), 64)]
        parts.sort(key=lambda s: len(s[0]))
        rng = np.random.default_rng(seed)
        m, v, step = {k: np.zeros_like(w) for k, w in self.p.items()}, {k: np.zeros_like(w) for k, w in self.p.items()}, 0
        batches = [parts[a : a + BATCH] for a in range(0, len(parts), BATCH)]
        for _ in range(EPOCHS):
            for k in rng.permutation(len(batches)):
                x, mask = _stacked([s[0] for s in batches[k]])
                y = np.zeros(mask.shape)
                for j, (_, own) in enumerate(batches[k]):
                    y[: len(own), j] = own
                known = mask & ~np.isnan(y)
                if not known.any():
                    continue
                step += 1
                for name, g in self.gradients(x, np.nan_to_num(y), known).items():
                    m[name] = 0.9 * m[name] + 0.1 * g
                    v[name] = 0.999 * v[name] + 0.001 * g * g
                    self.p[name] -= RATE * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)
        return self

    def main_text(self, pages: list[list]) -> list[str]:
        """Pages of similar length are read together; a page is never cut."""
        texts = [""] * len(pages)
        order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            to = at + 1
            while to < len(order) and (to - at + 1) * len(pages[order[to]]) <= 4096:
                to += 1
            x, mask = _stacked([features(pages[i]) for i in order[at:to]])
            p = self.outputs(x, mask)[0]
            for j, i in enumerate(order[at:to]):
                texts[i] = "\n\n".join(b[1] for k, b in enumerate(pages[i]) if p[k, j] >= 0.5)
            at = to
        return texts


def _stacked(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(len(r) for r in rows)
    x, mask = np.zeros((longest, len(rows), INPUT), np.float32), np.zeros((longest, len(rows)), bool)
    for j, r in enumerate(rows):
        x[: len(r), j], mask[: len(r), j] = r, True
    return x, mask


def fitted(htmls: list[str], seed: int = 5) -> Labeller | None:
    rng = np.random.default_rng(seed)
    pages = [p for p in map(blocks, htmls) if p]
    told = [(p, [label(b[0]) for b in p]) for p in pages]
    told = [(p, ys) for p, ys in told if None not in ys]
    made = [x for _ in range(4) for x in arrangements(pages, rng)]
    if not told and not made:
        return None
    every = told + made
    return Labeller(seed).train([features(p) for p, _ in every], [np.array(ys, float) for _, ys in every], seed)


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars. Nothing is shuffled."""
    html = F.col(html_col)
    usable = html.isNotNull() & (F.octet_length(html) <= SAMPLE_BYTES) & F.col(id_col).isNotNull()
    some = pages.where(usable).select(F.xxhash64(id_col).alias("h"), html.alias("html"))
    # The hashes are ranked first: only the pages that are taken leave their tasks.
    last = some.select("h").orderBy("h").limit(SAMPLE_PAGES).agg(F.max("h")).first()[0]
    chosen = some.where(F.col("h") <= F.lit(last)).groupBy("h").agg(F.min("html").alias("html")) if last is not None else some.limit(0)
    sample = [r["html"] for r in chosen.orderBy("h").collect()]
    model = pages.sparkSession.sparkContext.broadcast(fitted(sample))  # some 34,000 numbers

    @F.pandas_udf("string")
    def text_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for htmls in batches:
            out: list[str] = []
            for at in range(0, len(htmls), 256):
                cut = [blocks(h) for h in htmls.iloc[at : at + 256]]
                out += model.value.main_text(cut) if model.value is not None else ["\n\n".join(b[1] for b in p) for p in cut]
            yield pd.Series(out)

    found = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), text_of(html).alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))


QUERIES = {"op4_html_text": (op4_html_text, None)}
