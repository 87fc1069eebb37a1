"""Main text of web pages: a bidirectional LSTM in numpy labels the blocks of a page in their sequence.

A page is cut into leaf blocks: runs of text between block-level tags. Each block is read as a vector of its tag
path (tags, classes, ids and roles of all elements around it, hashed), of all its words (hashed) and of some measures
(length, share of link text, place on the page). Two LSTMs run over the blocks of the page in either direction, so
that the label of a block depends on the whole page. Blocks labelled as main text are joined by newlines.

The network is trained on generated pages (`page_samples`): random words in random layouts, with menus, headers,
footers, sidebars, notices, adverts, forms and reader comments, marked up by semantic tags or by classes alone.

Defined results: a null or empty page has the empty text; script, style, comments and the head are never text; tags
left open or cut off are closed by what follows, a head by what cannot stand in it; script, style and comments alone
run to the end of a page that does not close them; what stands in a tag is never text, quotes run as in HTML, and one that nothing
closes ends with its tag; a page is read in time that grows with its length; repeated rows get equal results; further columns are not read.
"""

from __future__ import annotations

import html as _html
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

PATH_DIM, WORD_DIM, MEASURES, HIDDEN = 96, 32, 8, 16
INPUT = PATH_DIM + WORD_DIM + MEASURES

#: What stands in a tag behind its name: a value in quotes runs to its own quote, one that is never closed to the end of the tag.
#: Possessive, so that no tag is read twice: it takes all but the tag's end.
_ATTRS = r"""(?:[^\s"'>=]+|\s+|=\s*(?:"[^"]*"|'[^']*'|[^\s"'>][^\s>]*)|=|["'])*+"""
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|svg|iframe|object|textarea|head)(?![^\s/>])(?P<own>{_ATTRS})(?:>|\Z)|<(?:[!?]|/(?![a-zA-Z]))[^>]*(?:>|\Z)"
    rf"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>{_ATTRS})(?:>|\Z)",
    re.S | re.I,
)
#: What can stand in a head, up to its end tag or to what cannot.
_HEAD = re.compile(
    rf"(?:\s+|<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(?P<raw>script|style)\b{_ATTRS}>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<held>noscript|template|object)\b{_ATTRS}>.*?</(?P=held)\s*>"
    rf"|<title\b{_ATTRS}>(?:(?:(?!</?(?:title|head|body|meta|link|base|script|style)\b).)*+</title\s*>|[^<]*)|</?(?:title|meta|link|base|basefont|bgsound)\b{_ATTRS}>)*+(?:</head\s*>)?",
    re.S | re.I,
)
_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in "script style noscript template svg iframe object textarea".split()}
_ATTR = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[A-Za-z]+")
_WORD = re.compile(r"\w+|©")
#: Elements inside a line of text.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What an opening tag closes if it is open.
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSES |= dict.fromkeys("div section article main aside nav header footer form ul ol table h1 h2 h3 h4 h5 h6 blockquote pre".split(), {"p"})


@dataclass
class Block:
    text: str
    path: tuple[str, ...] | np.ndarray  # names, or path_vector() of them
    link: float = 0.0


@dataclass
class _Open:
    parts: list[str] = field(default_factory=list)
    size: int = 0
    linked: int = 0


def path_vector(names: tuple[str, ...], out: np.ndarray | None = None) -> np.ndarray:
    """Hashed names of the elements around a block, the inner ones over `out`, that of the outer ones."""
    out = np.zeros(PATH_DIM, np.int8) if out is None else out.copy()
    for name in names:
        h = _hash(name)
        out[h % PATH_DIM] = 1 if h >> 31 else -1
    return out


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks of a page in order, character references decoded and white space turned into single spaces."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    vectors: list[np.ndarray] = [path_vector(())]  # of the outer elements, as far as blocks needed them: each element costs one
    is_open: dict[str, int] = {}
    now, links, at = _Open(), 0, 0
    page, unclosed = page or "", set()

    def flush() -> None:
        nonlocal now
        if now.parts:
            text = " ".join(_html.unescape("".join(now.parts)).split())
            if text:
                while len(vectors) <= len(stack):
                    vectors.append(path_vector(stack[len(vectors) - 1][1], vectors[-1]))
                out.append(Block(text, vectors[-1], now.linked / max(1, now.size)))
            now = _Open()

    def leave() -> str:
        tag = stack.pop()[0]
        is_open[tag] -= 1
        del vectors[len(stack) + 1 :]
        return tag

    def add(text: str) -> None:
        if text:
            now.parts.append(text)
            now.size += len(text)
            now.linked += len(text) if links else 0

    def end_of(raw: str, own: str, at: int) -> int:
        """Where an element that is never text ends. Without an end tag, script and style run to the end; others are their tag alone."""
        if raw == "head":
            return _HEAD.match(page, at).end()
        to_end = raw in ("script", "style")
        if raw in unclosed or (own.endswith("/") and not to_end):
            return at
        end = _END[raw].search(page, at)
        if not end:
            unclosed.add(raw)
        return end.end() if end else len(page) if to_end else at

    while m := _TOKEN.search(page, at):
        add(page[at : m.start()])
        at = end_of(m["raw"].lower(), m["own"], m.end()) if m["raw"] else m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            if m["raw"]:
                flush()
            continue
        if tag == "a":
            links = 0 if m["close"] else 1
        if tag in INLINE:
            continue
        flush()
        if m["close"]:
            if is_open.get(tag):
                while leave() != tag:
                    pass
            links = 0
        elif tag not in VOID:
            while stack and stack[-1][0] in CLOSES.get(tag, ()):
                leave()
            names = [tag]
            for a in _ATTR.finditer(m["attrs"] or ""):
                names += ["." + x.lower() for x in _PART.findall(a[1] or a[2] or a[3] or "")]
            stack.append((tag, tuple(names)))
            is_open[tag] = is_open.get(tag, 0) + 1
    add(page[at:])
    flush()
    return out


_hashes: dict[str, int] = {}


def _hash(name: str) -> int:
    h = _hashes.get(name)
    if h is None:
        if len(_hashes) > 200_000:
            _hashes.clear()
        h = _hashes[name] = zlib.crc32(name.encode("utf-8", "replace"))
    return h


def features(page: list[Block]) -> np.ndarray:
    """One row for each block, of all its words."""
    out = np.zeros((len(page), INPUT), np.float32)
    words = [_WORD.findall(b.text.lower()) for b in page]
    per = np.array([len(w) for w in words], np.int64)
    h = np.fromiter((_hash(w) for own in words for w in own), np.int64, per.sum())
    cell = np.repeat(np.arange(len(page)) * WORD_DIM, per) + h % WORD_DIM
    sums = np.bincount(cell, np.where(h >> 31, 1.0, -1.0), len(page) * WORD_DIM).reshape(len(page), WORD_DIM)
    out[:, PATH_DIM : PATH_DIM + WORD_DIM] = sums / (np.linalg.norm(sums, axis=1, keepdims=True) + 1)  # bounded, also where one word repeats
    for i, b in enumerate(page):
        row = out[i]
        row[:PATH_DIM] = b.path if isinstance(b.path, np.ndarray) else path_vector(b.path)
        n = len(b.text)
        row[PATH_DIM + WORD_DIM :] = (np.log1p(n) / 5, b.link, i / len(page), 1 / (1 + i), 1 / (len(page) - i), "©" in b.text, b.text[-1] in ".!?", min(1, len(words[i]) / 20))
    return out


class BiLstm:
    """Two LSTMs over the blocks, their states joined into one logit a block."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.w = [(rng.normal(0, 0.15, (INPUT + HIDDEN, 4 * HIDDEN))).astype(np.float32) for _ in range(2)]
        self.b = [np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]).astype(np.float32) for _ in range(2)]
        self.v, self.c = rng.normal(0, 0.2, 2 * HIDDEN).astype(np.float32), np.zeros(1, np.float32)

    def _run(self, x: np.ndarray, mask: np.ndarray, k: int, keep: bool = False):
        """States [t, n, h] of one direction; x [t, n, d], mask [t, n, 1]. Padding passes states on."""
        t, n, _ = x.shape
        z0 = x @ self.w[k][:INPUT] + self.b[k]
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        out, cache = np.zeros((t, n, HIDDEN), np.float32), [None] * t
        for i in range(t) if k == 0 else range(t - 1, -1, -1):
            z = z0[i] + h @ self.w[k][INPUT:]
            g = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
            i_, f, o, u = g[:, :HIDDEN], g[:, HIDDEN : 2 * HIDDEN], g[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
            c2 = f * c + i_ * u
            tc = np.tanh(c2)
            if keep:
                cache[i] = (h, c, i_, f, o, u, tc)
            m = mask[i]
            c, h = m * c2 + (1 - m) * c, m * (o * tc) + (1 - m) * h
            out[i] = h
        return out, cache

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        a, b = self._run(x, mask, 0)[0], self._run(x, mask, 1)[0]
        return np.concatenate([a, b], axis=2) @ self.v + self.c

    def _back(self, x: np.ndarray, mask: np.ndarray, k: int, cache: list, dout: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        t, n, _ = x.shape
        dz_all = np.zeros((t, n, 4 * HIDDEN), np.float32)
        dw_h = np.zeros((HIDDEN, 4 * HIDDEN), np.float32)
        dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        for i in range(t - 1, -1, -1) if k == 0 else range(t):
            h, c, i_, f, o, u, tc = cache[i]
            m = mask[i]
            dh = dh + dout[i]
            do, dc2 = m * dh * tc, m * (dc + dh * o * (1 - tc * tc))
            dz = np.concatenate([dc2 * u * i_ * (1 - i_), dc2 * c * f * (1 - f), do * o * (1 - o), dc2 * i_ * (1 - u * u)], axis=1)
            dz_all[i] = dz
            dw_h += h.T @ dz
            dh, dc = dz @ self.w[k][INPUT:].T + (1 - m) * dh, dc2 * f + (1 - m) * dc
        dw = np.concatenate([np.einsum("tnd,tnz->dz", x, dz_all, optimize=True), dw_h])
        return dw, dz_all.sum(axis=(0, 1))

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = 7, batch: int = 24, rate: float = 0.01, seed: int = 4) -> BiLstm:
        """Adam on the cross-entropy of blocks; pages: (features, labels)."""
        rng, step = np.random.default_rng(seed), 0
        params = [*self.w, *self.b, self.v, self.c]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for epoch in range(epochs):
            order = rng.permutation(len(pages))
            for a in range(0, len(pages), batch):
                x, mask, y = padded([pages[i][0] for i in order[a : a + batch]], [pages[i][1] for i in order[a : a + batch]])
                (ha, ca), (hb, cb) = self._run(x, mask, 0, True), self._run(x, mask, 1, True)
                h = np.concatenate([ha, hb], axis=2)
                p = 1 / (1 + np.exp(-(h @ self.v + self.c)))
                d = (p - y) * mask[:, :, 0] / mask.sum()
                dh = d[:, :, None] * self.v
                (wa, ba), (wb, bb) = self._back(x, mask, 0, ca, dh[:, :, :HIDDEN]), self._back(x, mask, 1, cb, dh[:, :, HIDDEN:])
                grads = [wa, wb, ba, bb, np.einsum("tn,tnh->h", d, h), d.sum(keepdims=True).ravel()]
                step += 1
                lr = rate * (1 - 0.9 * epoch / epochs)
                for j, g in enumerate(grads):
                    first[j] = 0.9 * first[j] + 0.1 * g
                    second[j] = 0.999 * second[j] + 0.001 * g * g
                    params[j] -= (lr * (first[j] / (1 - 0.9**step)) / (np.sqrt(second[j] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def main(self, pages: list[list[Block]], cells: int = 40_000) -> list[np.ndarray]:
        """For each page, which blocks are main text. Pages of like length are run together."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order, at = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i])), 0
        while at < len(order):
            end = at + 1
            while end < len(order) and (end - at + 1) * len(pages[order[end]]) <= cells:
                end += 1
            x, mask, _ = padded([features(pages[i]) for i in order[at:end]])
            z = self.logits(x, mask)
            for j, i in enumerate(order[at:end]):
                out[i] = z[: len(pages[i]), j] > 0
            at = end
        return out


def padded(xs: list[np.ndarray], ys: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    t = max(len(x) for x in xs)
    x, mask, y = np.zeros((t, len(xs), INPUT), np.float32), np.zeros((t, len(xs), 1), np.float32), np.zeros((t, len(xs)), np.float32)
    for j, own in enumerate(xs):
        x[: len(own), j], mask[: len(own), j] = own, 1
        if ys is not None:
            y[: len(own), j] = ys[j]
    return x, mask, y


# ---- generated pages

_SYLLABLES = "an be co da el fi go ha in jo ka lu mi no op pe qu ra se ti un ve wa xi yo ze th er ion ing ment é ü".split()
_MAIN = "content article post entry story main body text page-content article-body post-content entry-content".split()
_SIDE = {
    "nav": "nav navbar menu main-menu navigation breadcrumb breadcrumbs toc pagination".split(),
    "header": "header masthead site-header top-bar banner logo branding".split(),
    "footer": "footer site-footer copyright colophon bottom legal".split(),
    "aside": "sidebar side widget related recommended popular trending share social".split(),
    "ad": "ad ads advert advertisement promo sponsored sponsor adsense".split(),
    "notice": "notice cookie cookie-notice consent alert popup modal newsletter subscribe gdpr paywall".split(),
    "comments": "comments comment comment-list replies reply discussion responses disqus".split(),
    "form": "form search login signup contact-form subscribe-form".split(),
}
_TAG = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "comments": "section", "form": "form"}


def _words(r: random.Random, n: int) -> str:
    return " ".join("".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(n))


def _sentences(r: random.Random) -> str:
    return " ".join(_words(r, r.randint(1, 25)).capitalize() + "." for _ in range(r.randint(1, 6)))


def page_samples(n: int, seed: int = 11) -> list[tuple[str, list[int]]]:
    """Pages and the label of each of their blocks."""
    r, out = random.Random(seed), []
    for _ in range(n):
        parts: list[str] = []
        labels: list[int] = []

        def put(html: str, label: int | None = None, parts=parts, labels=labels) -> None:
            parts.append(html)
            if label is not None:
                labels.append(label)

        def side(kind: str, r=r, put=put) -> None:
            tag = _TAG.get(kind, "div") if r.random() < 0.6 and kind in _TAG else "div"
            cls = f' {r.choice(["class", "id"])}="{r.choice(_SIDE[kind])}"' if tag in ("div", "section") or r.random() < 0.5 else ""
            put(f"<{tag}{cls}>")
            if kind == "nav" or (kind in ("aside", "header") and r.random() < 0.5):
                put("<ul>")
                for _ in range(r.randint(1, 8)):
                    put(f'<li><a href="/{r.randint(0, 99)}">{_words(r, r.randint(1, 3))}</a></li>', 0)
                put("</ul>")
            elif kind == "footer":
                put(f"{r.choice(['&copy; ', '© ', ''])}{_words(r, r.randint(1, 4))} &middot; {_sentences(r)}", 0)
            elif kind == "form":
                for _ in range(r.randint(1, 3)):
                    put(f"<div><label>{_words(r, 2)}</label><input name=q></div>", 0)
                put(f"<button>{_words(r, 1)}</button>", 0)
            elif kind == "comments":
                for _ in range(r.randint(1, 5)):
                    put(f"<div class='{r.choice(_SIDE['comments'])}'><p>{_sentences(r)}</p></div>", 0)
            else:
                for _ in range(r.randint(1, 2)):
                    put(f"<p>{_sentences(r)}</p>" if r.random() < 0.5 else f"<div>{_sentences(r)}</div>", 0)
            put(f"</{tag}>")

        put(f"<!DOCTYPE html><html><head><title>{_words(r, 4)}</title></head><body>")
        wrap = r.random() < 0.3
        if wrap:
            put(f'<div class="{r.choice(["wrapper", "container", "page", "site"])}">')
        for kind in r.sample(["header", "nav", "ad", "notice", "form", "aside"], r.randint(0, 4)):
            side(kind)
        tag = r.choice(["article", "article", "article", "main", "div", "section"])
        cls = f' class="{r.choice(_MAIN)}"' if tag in ("div", "section") or r.random() < 0.2 else ""
        outer = tag != "main" and r.random() < 0.2
        put(("<main>" if outer else "") + f"<{tag}{cls}>")
        if r.random() < 0.8:
            put(f"<h1>{_words(r, r.randint(1, 12))}</h1>", 1)
        inside = r.random() < 0.3
        for i in range(r.choice([1, 2, 3, 5, 8, 13, 21])):
            kind = r.random()
            if kind < 0.08:
                put(f"<h2>{_words(r, r.randint(1, 6))}</h2>", 1)
            elif kind < 0.14:
                put("<ul>")
                for _ in range(r.randint(1, 4)):
                    put(f"<li>{_words(r, r.randint(1, 12))}</li>", 1)
                put("</ul>")
            elif kind < 0.18:
                put(f"<blockquote><p>{_sentences(r)}</p></blockquote>", 1)
            elif kind < 0.3:
                put(f"<p><b>{_sentences(r)}<br>", 1)
            elif kind < 0.4:
                put(f'<p>{_words(r, 3)} <a href="/x">{_words(r, 2)}</a> {_sentences(r)}</p>', 1)
            elif kind < 0.45:
                put(f"<p>{_words(r, r.randint(1, 2))}.</p>", 1)
            else:
                put(f"<p>{_sentences(r)}</p>", 1)
            if inside and r.random() < 0.15:
                side(r.choice(["ad", "notice", "aside", "form", "nav"]))
        if r.random() < 0.15:
            side("comments")
        put(f"</{tag}>" + ("</main>" if outer else ""))
        for kind in [k for k in ("aside", "comments", "nav", "ad", "notice", "form") if r.random() < 0.25] + (["footer"] if r.random() < 0.85 else []):
            side(kind)
        put(("</div>" if wrap else "") + ("</body></html>" if r.random() < 0.8 else ""))
        out.append(("".join(parts), labels))
    return out


_trained: dict[tuple[int, int], BiLstm] = {}


def trained(pages: int = 700, seed: int = 11) -> BiLstm:
    """The network, trained once in a process."""
    if (pages, seed) not in _trained:
        data = []
        for page, labels in page_samples(pages, seed):
            found = blocks(page)
            if len(found) == len(labels) and found:
                data.append((features(found), np.array(labels, np.float32)))
        _trained[pages, seed] = BiLstm().fit(data)
    return _trained[pages, seed]


def main_texts(pages: list[str | None], model: BiLstm) -> list[str]:
    """The main text of each page."""
    cut = [blocks(p) for p in pages]
    return ["\n".join(b.text for b, ok in zip(own, keep.tolist(), strict=True) if ok) for own, keep in zip(cut, model.main(cut), strict=True)]


def extract(pages: DataFrame, model: BiLstm | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    model = model or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 200):
                batch = big.slice(at, 200)
                texts = main_texts(batch.column(2).to_pylist(), model)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
