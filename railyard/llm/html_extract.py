"""Main-text extraction from web pages (operator 9).

A page is cut into leaf blocks (text between block-level tags). A bidirectional
LSTM, written in numpy and trained here, reads one vector per block (its tag
path and its words, both hashed, and a few shares) over the whole page and
labels every block main text or not, with the context of the whole document.

It is trained on a bounded sample of pages (``SAMPLE_PAGES``) and on pages made
from their words under many layouts (menus, side bars, notices, adverts, forms,
reader comments; main text in article, main, section, table cell or div, with
known, unknown or no names), so that neither one element name nor one place
decides. Sampled pages with an article or main element are labelled by it. The
others are labelled by agreement: a first network judges every block in its
page, and its verdict is averaged with that on all sampled blocks of the same
tag path; the network is then trained again with these pages.

Defined results: null, empty and text-less pages give an empty text; character
references are decoded; white space in a block becomes one space; unclosed tags,
comments and scripts end with the page; repeated rows each get a row; an empty
table gives no rows and trains nothing; extra columns are not read.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from railyard.llm.common import batch_of, slices

#: Pages that the fit takes at most; of a longer page it learns from a run of so many
#: blocks, and makes pages from so many characters of its words, each cut to WORD_CHARS.
SAMPLE_PAGES = 400
SAMPLE_BLOCKS = 512
SAMPLE_CHARS = 50_000
WORD_CHARS = 200
MADE_PAGES = 1_200
PATH_DIM, WORD_DIM, SHARE_DIM = 256, 32, 8
DIM = PATH_DIM + WORD_DIM + SHARE_DIM
HIDDEN = 20
EPOCHS = 10

#: Fixed: elements of the HTML standard that start and end a block.
BLOCK_TAGS = frozenset("""address article aside blockquote body br button caption center dd details dialog dir div dl dt
fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe input label legend li
main menu nav ol optgroup option p pre section select summary table tbody td textarea tfoot th thead title tr ul""".split())
#: Fixed: elements without content.
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Fixed: elements that an opening tag of the same group ends.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
            "option": {"option"}, "body": {"head"}}
#: Where the search for an open sibling stops.
SCOPES = frozenset("ul ol dl table select".split())
#: Words of class, id and role values and tag names that mark blocks as not main text, for the training labels.
ASIDE_WORDS = frozenset("""nav menu header footer aside sidebar notice cookie consent banner ad ads advert promo sponsor form
comment comments reply related share social breadcrumb newsletter subscribe login search widget popup modal title head
""".split())
MAIN_TAGS = frozenset(("article", "main"))

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript)\b(?>[^>\"']+|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*')*+|[^>]*)>", re.S | re.I)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")


@dataclass
class Block:
    text: str
    path: tuple[str, ...]  # one entry per open element: tag and the words of its class, id and role
    linked: int  # characters inside links


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page with visible text, in page order."""
    out: list[Block] = []
    stack: list[tuple[str, str]] = []
    pieces: list[str] = []
    linked = anchors = 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                out.append(Block(text, tuple(e for _, e in stack), min(linked, len(text))))
            pieces.clear()
        linked = 0

    def close(upto: int) -> None:
        nonlocal anchors
        anchors -= sum(t == "a" for t, _ in stack[upto:])
        del stack[upto:]

    def take(piece: str) -> None:
        nonlocal linked
        if "&" in piece:
            piece = html.unescape(piece)
        pieces.append(piece)
        if anchors:
            linked += len(piece)

    page, at = page or "", 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            take(page[at : m.start()])
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        is_block = tag in BLOCK_TAGS
        if is_block:
            flush()
        if m[2]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    close(i)
                    break
            continue
        if is_block:
            stops = SIBLINGS.get(tag, ())
            for i in range(len(stack) - 1, -1, -1):
                t = stack[i][0]
                if t == "p" or t in stops:
                    close(i)
                    if t == "p":
                        continue
                    break
                if t in SCOPES:
                    break
        if tag in VOID_TAGS or m[4].endswith("/") and not is_block:
            continue
        names = " ".join(w for g in _NAMES.findall(m[4]) for w in _WORD.findall("".join(g).lower())) if "=" in m[4] else ""
        stack.append((tag, f"{tag} {names}" if names else tag))
        anchors += tag == "a"
    if at < len(page):
        take(page[at:])
    flush()
    return out


def _place(kind: str, token: str) -> int:
    return zlib.crc32(f"{kind}:{token}".encode()) % PATH_DIM


class Encoder:
    """Blocks of a page to vectors; vectors of tag paths are remembered."""

    def __init__(self, remembered: int = 20_000):
        self.paths: dict[tuple[str, ...], np.ndarray] = {}
        self.remembered = remembered

    def path(self, path: tuple[str, ...]) -> np.ndarray:
        got = self.paths.get(path)
        if got is None:
            if len(self.paths) >= self.remembered:
                self.paths.clear()
            got = np.zeros(PATH_DIM, np.float32)
            for depth, element in enumerate(path):
                tag, *names = element.split(" ")
                got[_place("tag", tag)] = 1
                for n in names:
                    got[_place("name", n)] = 1
                if depth == len(path) - 1:
                    got[_place("leaf", tag)] = 1
            self.paths[path] = got
        return got

    def page(self, found: list[Block]) -> np.ndarray:
        out = np.zeros((len(found), DIM), np.float32)
        for i, b in enumerate(found):
            x = out[i]
            x[:PATH_DIM] = self.path(b.path)
            words = b.text.lower().encode("utf-8", "replace").split()
            hashed = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % WORD_DIM
            counts = np.bincount(hashed, minlength=WORD_DIM)
            x[PATH_DIM : PATH_DIM + WORD_DIM] = counts / len(words)
            n = len(b.text)
            x[-SHARE_DIM:] = (np.log1p(n) / 6, np.log1p(len(words)) / 5, b.linked / n, sum(b.text.count(c) for c in ".,;:!?") / len(words) / 2,
                              b.text[-1] in ".!?", i == 0, i == len(found) - 1, min(1.0, len(b.path) / 12))
        return out


# --- the network -----------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _initial(seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    p = {}
    for d in "fb":
        p[f"w{d}"] = rng.normal(0, 0.1, (DIM, 4 * HIDDEN))
        p[f"u{d}"] = rng.normal(0, 0.2, (HIDDEN, 4 * HIDDEN))
        p[f"c{d}"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
    p["v"], p["b"] = rng.normal(0, 0.2, 2 * HIDDEN), np.zeros(1)
    return {k: v.astype(np.float32) for k, v in p.items()}


def _reverse(x: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Each sequence of a padded (time, page, ...) array turned round within its own length."""
    t = np.arange(x.shape[0])[:, None]
    at = np.where(t < length, length - 1 - t, t)
    return x[at, np.arange(x.shape[1])]


def _run(p: dict, d: str, x: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Hidden states of one direction over a padded (time, page, DIM) array."""
    n = x.shape[1]
    h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    gates = x @ p[f"w{d}"] + p[f"c{d}"]
    out = np.empty((len(x), n, HIDDEN), np.float32)
    for t in range(len(x)):
        z = gates[t] + h @ p[f"u{d}"]
        s = _sigmoid(z[:, : 3 * HIDDEN])
        i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
        g = np.tanh(z[:, 3 * HIDDEN :])
        before, c = (h, c), f * c + i * g
        h = o * np.tanh(c)
        out[t] = h
        if keep is not None:
            keep.append((*before, i, f, o, g, c))
    return out


def _back(p: dict, d: str, x: np.ndarray, kept: list, dh_out: np.ndarray, grads: dict) -> None:
    n = x.shape[1]
    dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    dz_all = np.empty((len(x), n, 4 * HIDDEN), np.float32)
    du = np.zeros_like(p[f"u{d}"])
    for t in range(len(x) - 1, -1, -1):
        h0, c0, i, f, o, g, c = kept[t]
        th = np.tanh(c)
        dh = dh + dh_out[t]
        dc = dc + dh * o * (1 - th * th)
        dz = np.concatenate([dc * g * i * (1 - i), dc * c0 * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - g * g)], 1)
        dz_all[t] = dz
        du += h0.T @ dz
        dh, dc = dz @ p[f"u{d}"].T, dc * f
    flat = dz_all.reshape(-1, 4 * HIDDEN)
    grads[f"w{d}"], grads[f"u{d}"], grads[f"c{d}"] = x.reshape(-1, DIM).T @ flat, du, flat.sum(0)


def _pad(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    length = np.array([len(x) for x in pages])
    out = np.zeros((int(length.max()), len(pages), pages[0].shape[1]), np.float32)
    for k, x in enumerate(pages):
        out[: len(x), k] = x
    return out, length


def probabilities(p: dict, pages: list[np.ndarray]) -> list[np.ndarray]:
    """Per page, the probability of main text of every block. Pages of like length run together."""
    out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
    order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
    while order:
        longest = len(pages[order[-1]])
        width = max(1, min(len(order), 4096 // longest))
        group, order = order[-width:], order[:-width]
        x, length = _pad([pages[k] for k in group])
        h = np.concatenate([_run(p, "f", x), _reverse(_run(p, "b", _reverse(x, length)), length)], 2)
        y = _sigmoid(h @ p["v"] + p["b"])
        for j, k in enumerate(group):
            out[k] = y[: length[j], j]
    return out


def train(pages: list[np.ndarray], marks: list[np.ndarray], epochs: int = EPOCHS, seed: int = 5, rate: float = 0.01) -> dict[str, np.ndarray]:
    """Fit by Adam on whole pages, back through time in both directions."""
    p, rng = _initial(seed), np.random.default_rng(seed)
    m, v, step = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    usable = [k for k in range(len(pages)) if len(pages[k])]
    for epoch in range(epochs):
        order = sorted(rng.permutation(usable).tolist(), key=lambda k: len(pages[k]) // 8)
        groups = [order[i : i + 32] for i in range(0, len(order), 32)]
        for g in rng.permutation(len(groups)):
            x, length = _pad([pages[k] for k in groups[g]])
            y, _ = _pad([marks[k][:, None] for k in groups[g]])
            mask = np.arange(len(x))[:, None] < length
            x[:, :, :PATH_DIM] *= rng.random((1, 1, PATH_DIM)) > 0.05  # some path words missing: context must do
            back = _reverse(x, length)
            kept_f, kept_b = [], []
            hf, hb = _run(p, "f", x, kept_f), _run(p, "b", back, kept_b)
            h = np.concatenate([hf, _reverse(hb, length)], 2)
            d = (_sigmoid(h @ p["v"] + p["b"]) - y[:, :, 0]) * mask / max(1, mask.sum())
            grads = {"v": np.tensordot(d, h, ((0, 1), (0, 1))), "b": np.array([d.sum()])}
            dh = d[:, :, None] * p["v"]
            _back(p, "f", x, kept_f, dh[:, :, :HIDDEN], grads)
            _back(p, "b", back, kept_b, _reverse(dh[:, :, HIDDEN:], length), grads)
            size = np.sqrt(sum(float((q.astype(np.float64) ** 2).sum()) for q in grads.values()))
            step += 1
            now = rate * (0.5 ** (epoch / 4))
            for k, q in grads.items():
                q = q * min(1.0, 1.0 / max(size, 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * q
                v[k] = 0.999 * v[k] + 0.001 * q * q
                p[k] = (p[k] - now * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    return p


# --- training pages -----------------------------------------------------------------


def structural_marks(found: list[Block]) -> np.ndarray | None:
    """Training labels of a real page: inside article or main and under nothing
    marked as an aside. A page without such an element says nothing about where
    its main text is and gets no labels."""
    if not any(e.split(" ")[0] in MAIN_TAGS for b in found for e in b.path):
        return None
    out = np.zeros(len(found), np.float32)
    for i, b in enumerate(found):
        words = [e.split(" ") for e in b.path]
        out[i] = any(w[0] in MAIN_TAGS for w in words) and not any(x in ASIDE_WORDS for w in words for x in w)
    return out


def made_page(words: list[str], rng: np.random.Generator) -> tuple[str, list[int]]:
    """A page in a random layout from given words, and the label of each block."""
    marks: list[int] = []

    def say(low: int, high: int) -> str:
        n = int(rng.integers(low, high + 1))
        text = " ".join(words[i] for i in rng.integers(0, len(words), n))
        return html.escape(text) + ("." if rng.random() < 0.8 else "")

    def mark(n: int, label: int) -> None:
        marks.extend([label] * n)

    def pick(*options: str) -> str:
        return options[int(rng.integers(len(options)))]

    def links(open_, close, n: int) -> str:
        mark(n, 0)
        return open_ + "<ul>" + "".join(f'<li><a href="/{i}">{say(1, 3)}</a></li>' for i in range(n)) + "</ul>" + close

    def box(open_: str, close: str, n: int, low: int = 3, high: int = 25) -> str:
        mark(n, 0)
        return open_ + "".join(f"<p>{say(low, high)}</p>" for _ in range(n)) + close

    def small() -> str:
        k = int(rng.integers(7))
        if k == 0:
            mark(1, 0)
            return f'<div class="{pick("ad", "advert", "ads", "promo", "sponsor")}">{say(3, 20)}</div>'
        if k == 1:
            return box(f'<aside{pick("", chr(32) + "class=sidebar")}>', "</aside>", int(rng.integers(1, 4)))
        if k == 2:
            return box(f'<div class="{pick("cookie-notice", "notice", "consent", "banner")}" {pick("", "role=alert")}>', "</div>", 1, 5, 30)
        if k == 3:
            mark(2, 0)
            return f'<form action="/s"><label>{say(1, 3)}</label><input name="q"><button>{say(1, 2)}</button></form>'
        if k == 4:
            return links(f'<div class="{pick("related", "share", "breadcrumb", "menu")}">', "</div>", int(rng.integers(2, 6)))
        if k == 5:
            return box(f'<div class="{pick("newsletter", "subscribe", "widget", "login")}">', "</div>", 1)
        return links("<nav>", "</nav>", int(rng.integers(2, 8)))

    out = ["<!DOCTYPE html><html><head>"]
    if rng.random() < 0.8:
        mark(1, 0)
        out.append(f"<title>{say(3, 10)}</title>")
    out.append("<style>p{}</style></head><body>")
    if rng.random() < 0.5:
        mark(1, 0)
        out.append(f'<header{pick("", " class=site-header")}><div>{say(1, 6)}</div>')
        if rng.random() < 0.5:
            out.append(links("<nav>", "</nav>", int(rng.integers(2, 8))))
        out.append("</header>")
    if rng.random() < 0.8:
        out.append(links(pick("<nav>", '<div class="menu">', '<div id="nav">'), "</nav></div>", int(rng.integers(2, 9))))
    for _ in range(int(rng.integers(0, 3))):
        out.append(small())
    unknown = "".join(chr(97 + i) for i in rng.integers(0, 26, int(rng.integers(3, 10))))
    inside, behind, share = zip(*(
        ("<article>", "</article>", 0.4), ("<main>", "</main>", 0.1), ('<main><article class="post">', "</article></main>", 0.12),
        ('<div class="content">', "</div>", 0.08), ('<div id="post-body">', "</div>", 0.05), ('<section class="story">', "</section>", 0.05),
        ("<div>", "</div>", 0.08), (f'<div class="{unknown}">', "</div>", 0.06), ("<table><tr><td>", "</td></tr></table>", 0.06)))
    k = int(rng.choice(len(inside), p=share))
    inside, behind = inside[k], behind[k]
    out.append(inside)
    if rng.random() < 0.8:
        mark(1, 1)
        out.append(f"<h1>{say(3, 12)}</h1>")
    for _ in range(int(rng.integers(1, 12))):
        k = rng.random()
        if k < 0.07:
            mark(1, 1)
            out.append(f"<h2>{say(1, 8)}</h2>")
        elif k < 0.14:
            n = int(rng.integers(2, 5))
            mark(n, 1)
            out.append("<ul>" + "".join(f"<li>{say(2, 14)}" for _ in range(n)) + "</ul>")
        elif k < 0.19:
            mark(1, 1)
            out.append(f"<blockquote>{say(4, 40)}</blockquote>")
        elif k < 0.27:
            out.append(small())
        mark(1, 1)
        out.append(f'<p>{pick("", "<b>")}{say(3, 90)}{pick("</p>", "<br>")}')
    if "article" in inside and rng.random() < 0.15:
        out.append(comments(say, mark, pick, rng))
    out.append(behind)
    if rng.random() < 0.4:
        out.append(comments(say, mark, pick, rng))
    for _ in range(int(rng.integers(0, 3))):
        out.append(small())
    if rng.random() < 0.9:
        mark(1, 0)
        out.append(f'<footer>&copy; {say(2, 14)}</footer>' if rng.random() < 0.8 else f'<div class="footer">{say(2, 14)}</div>')
    return "".join(out) + ("</body></html>" if rng.random() < 0.9 else ""), marks


def comments(say, mark, pick, rng: np.random.Generator) -> str:
    n = int(rng.integers(1, 6))
    mark(n, 0)
    return (f'<{pick("section", "div")} {pick("class=comments", "id=comments")}>'
            + "".join(f'<{pick("p", "div class=comment")}>{say(3, 40)}</p></div>' for _ in range(n)) + "</section></div>")


def agreed_marks(model: dict[str, np.ndarray], pages: list[np.ndarray]) -> list[np.ndarray]:
    """Labels of unmarked pages: a block's own probability and, with double
    weight, the mean over all blocks of its tag path."""
    own = probabilities(model, pages)
    _, path = np.unique(np.concatenate([x[:, :PATH_DIM] for x in pages]), axis=0, return_inverse=True)
    path, flat = path.ravel(), np.concatenate(own)
    mean = np.bincount(path, flat) / np.bincount(path)
    marks = ((2 * mean[path] + flat) / 3 >= 0.5).astype(np.float32)
    return np.split(marks, np.cumsum([len(x) for x in pages])[:-1])


def excerpt(found: list[Block], k: int, encoder: Encoder) -> tuple[np.ndarray, np.ndarray | None, list[str]]:
    """Vectors, training labels (None for an unmarked page) and words of a page; of more than ``SAMPLE_BLOCKS``
    blocks a run of so many, at a place by the page's hash, as they are in the whole page."""
    at = k % (len(found) - SAMPLE_BLOCKS + 1) if len(found) > SAMPLE_BLOCKS else 0
    run = slice(at, at + SAMPLE_BLOCKS)
    room, words = SAMPLE_CHARS, []
    for w in dict.fromkeys(w[:WORD_CHARS] for b in found[run] for w in b.text.split()):
        room -= len(w) + 1
        if room < 0:
            break
        words.append(w)
    marks = structural_marks(found)
    return encoder.page(found)[run], None if marks is None else marks[run], words


def fit(pages: DataFrame, id_column: str = "page_id", html_column: str = "html", seed: int = 5) -> dict[str, np.ndarray] | None:
    """Train on at most ``SAMPLE_PAGES`` distinct pages with a block, whatever
    their length, in the order of a hash of id and page, and on ``MADE_PAGES``
    made from their words; None where no page of the whole table has a block.

    Pages are cut and encoded in their tasks: the driver gets excerpts."""
    rows = (pages.filter(F.length(html_column) >= 1)
            .select(F.col(html_column).alias("h"), F.xxhash64(F.col(id_column).cast("string"), F.col(html_column)).alias("k")))
    least = [r.k for r in rows.select("k").distinct().orderBy("k").limit(SAMPLE_PAGES).collect()]  # hashes first
    if not least:
        return None
    sample = _encoded(rows, least)
    # pages without a block gave nothing: go on in the order of the hash, in ranges that grow until all pages are seen
    low, first = least[-1], -(1 << 63)
    while len(sample) < SAMPLE_PAGES and low < (1 << 63) - 1:
        high = min((1 << 63) - 1, first + 16 * max(low - first, 1 << 40))
        more = _with_blocks(rows.filter((F.col("k") > low) & (F.col("k") <= high)))
        more = [r.k for r in more.distinct().orderBy("k").limit(SAMPLE_PAGES - len(sample)).collect()]
        if more:
            sample += _encoded(rows, more)
        low = high
    words = sorted({w for r in sample for w in r.words.split(" ")})
    if not words:
        return None
    rng, encoder = np.random.default_rng(seed), Encoder()
    x, y, unmarked = [], [], []
    for r in sample:
        vectors = np.frombuffer(r.x, np.float32).reshape(-1, DIM)
        if r.y is None:
            unmarked.append(vectors)
        else:
            x.append(vectors)
            y.append(np.frombuffer(r.y, np.float32))
    for _ in range(MADE_PAGES):
        page, marks = made_page(words, rng)
        got = blocks(page)
        if len(got) == len(marks):
            x.append(encoder.page(got))
            y.append(np.array(marks, np.float32))
    model = train(x, y, seed=seed)
    return train(x + unmarked, y + agreed_marks(model, unmarked), seed=seed) if unmarked else model


def _with_blocks(rows: DataFrame) -> DataFrame:
    """The hashes ``k`` of the pages with a block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "h"):
                k = [k for h, k in zip(part.column("h").to_pylist(), part.column("k").to_pylist()) if blocks(h)]
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64())], names=["k"])

    return rows.mapInArrow(run, "k long")


def _encoded(rows: DataFrame, wanted: list[int]) -> list[Row]:
    """The excerpts (k, x, y, words) of the pages of these hashes that have a
    block, one of each hash, in order."""
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("x", T.BinaryType()), T.StructField("y", T.BinaryType()), T.StructField("words", T.StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen = Encoder(), set()
        for whole in batches:
            for part in slices(whole, "h"):
                for h, k in zip(part.column("h").to_pylist(), part.column("k").to_pylist()):
                    if k not in seen:
                        seen.add(k)
                        if found := blocks(h):
                            x, y, words = excerpt(found, k, encoder)
                            yield batch_of(arrow, [k], [x.tobytes()], [None if y is None else y.tobytes()], [" ".join(words)])

    one = rows.filter(F.col("k").isin(wanted)).mapInArrow(run, schema).dropDuplicates(["k"])
    return sorted(one.collect(), key=lambda r: r.k)


def main_text(found: list[Block], p: np.ndarray) -> str:
    return " ".join(b.text for b, q in zip(found, p) if q >= 0.5)


def extract(pages: DataFrame, model: dict[str, np.ndarray] | None, id_column: str = "page_id", html_column: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """Per page: id, the columns in ``keep``, ``text``."""
    source = pages.select(F.col(id_column).alias("id"), *[F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)], F.col(html_column).alias("html"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("text", T.StringType())])
    arrow = to_arrow_schema(schema)
    sent = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder()
        for whole in batches:
            for part in slices(whole, "html"):
                found = [blocks(h) for h in part.column("html").to_pylist()]
                if sent.value is None:
                    texts = [""] * len(found)
                else:
                    texts = [main_text(f, p) for f, p in zip(found, probabilities(sent.value, [encoder.page(f) for f in found]))]
                yield batch_of(arrow, *part.columns[:-1], texts)

    out = source.mapInArrow(run, schema)
    return out.select(F.col("id").alias(id_column), *[F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)], "text")


def digest(pages: DataFrame) -> DataFrame:
    """The digest columns of the registered query."""
    return extract(pages, fit(pages)).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
