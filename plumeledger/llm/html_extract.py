"""Main-text extraction by a linear-chain conditional random field over the leaf blocks of a page.

A page is cut into leaf blocks: runs of text that no block-level tag parts. Features are a block's ancestor tags, the words
of their class and id attributes, and its text (length, links, marks, place). Labels main / other of neighbouring
blocks depend on each other; the best sequence is found by Viterbi.

The pages have no labels, so labelled pages are made from a bounded sample of them: the blocks of a sampled page's
article element (or, where it has none, of the container of most running text) are main text, the blocks of its navigation, adverts and footer are not. Each
sampled page is used as it is and set anew in other layouts, with the boilerplate that such layouts have, the label
of every block being known by construction. The model is then fitted by the likelihood of those labels.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumeledger.llm.shared import importable, in_blocks, with_columns_of

TRAIN_PAGES = 300
TRAIN_BYTES = 4 << 20
BUCKETS = 1 << 14
STEPS = 120

# Fixed values of the HTML standard: elements that start a block of their own, whose content is not text, and void ones.
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul title head br option select".split())
RAW = set("script style noscript template textarea svg iframe title head".split())
VOID = set("area base br col embed hr img input link meta source track wbr".split())
_CLOSES_P = BLOCK - {"br", "body", "html", "title", "head", "option", "select"}

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*(?:>|\Z)|<[a-zA-Z/][^<>]*\Z", re.S)
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_NAME = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
_END = {t: re.compile(rf"</{t}\b[^>]*>|\Z", re.I) for t in RAW}


def leaf_blocks(page: str | None) -> list[tuple[str, tuple[str, ...], float]]:
    """(text, ancestor marks, share of its characters in links) of each block that has text, in page order.

    Ancestor marks are tag names, and class, id and role words with a leading dot. Broken mark-up is read as browsers do: an
    open paragraph ends where a block starts, unknown end tags are passed over, a tag cut off at the page's end is dropped.
    """
    page = page or ""
    out, buffer, stack, links, at = [], [], [], 0, 0
    linked = 0
    marks: dict[str, int] = {}  # of the open elements, with their number, in order of first occurrence
    opened: dict[str, int] = {}  # open elements by tag

    def flush():
        nonlocal buffer, linked
        if buffer:
            text = _SPACE.sub(" ", html.unescape("".join(buffer))).strip()
            if text:
                out.append((text, tuple(marks), min(1.0, linked / len(text))))
            buffer, linked = [], 0

    def close(i):
        nonlocal links
        for t, own in reversed(stack[i:]):
            opened[t] -= 1
            links -= t == "a"
            for m in own:
                marks[m] -= 1
                if not marks[m]:
                    del marks[m]
        del stack[i:]

    n = len(page)
    while at < n:
        m = _TAG.search(page, at)
        data = page[at : m.start()] if m else page[at:]
        if data:
            buffer.append(data)
            if links:
                linked += len(data)
        if not m:
            break
        at = m.end()
        tag = m.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if m.group(1):
            if tag in BLOCK:
                flush()
            for i in range(len(stack) - 1, -1, -1) if opened.get(tag) else ():
                if stack[i][0] == tag:
                    close(i)
                    break
                if stack[i][0] in BLOCK and tag not in BLOCK:
                    break
            continue
        if tag in RAW and tag != "head":
            if tag == "title":
                flush()
            e = _END[tag].search(page, at)
            at = e.end()
            continue
        if tag in BLOCK:
            flush()
            if tag in _CLOSES_P:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == "p" or tag == "li" and stack[i][0] == "li":
                        close(i)
                        break
                    if stack[i][0] in BLOCK:
                        break
        if tag in VOID or m.group(3).rstrip().endswith("/"):
            continue
        own = [tag] if tag in BLOCK or tag in ("a", "button", "label", "time") else []
        for a in _ATTR.finditer(m.group(3)):
            own += ["." + w for w in _NAME.findall((a[2] or a[3] or a[4] or "").lower())]
        stack.append((tag, own))
        opened[tag] = opened.get(tag, 0) + 1
        for w in own:
            marks[w] = marks.get(w, 0) + 1
        links += tag == "a"
    flush()
    return out


def _hash(text: str) -> int:
    h = 2166136261
    for b in text.encode():
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return (h ^ h >> 15) % BUCKETS


class _Hashes(dict):
    def __missing__(self, key):
        x = _hash(key)
        if len(self) < 100_000:
            self[key] = x
        return x


_BUCKET = _Hashes()


def features(blocks: list[tuple[str, tuple[str, ...], float]]) -> list[list[int]]:
    out, n = [], len(blocks)
    for i, (text, marks, linked) in enumerate(blocks):
        size, words = len(text), text.count(" ") + 1
        f = ["bias", f"len{min(12, size.bit_length())}", f"words{min(9, words.bit_length())}", f"link{round(linked * 4)}"]
        f += [f"end{text[-1] if not text[-1].isalnum() else 'w'}", f"start{text[0].isupper()}", f"first{min(i, 2)}", f"last{min(n - 1 - i, 2)}"]
        if "©" in text:
            f.append("copyright")
        if "|" in text or "·" in text or "»" in text:
            f.append("separator")
        f += ["<" + m for m in marks]
        if marks:
            f.append("leaf" + marks[-1])
        out.append([_BUCKET[x] for x in f])
    return out


# The words by which layouts name what is not main text, and sentences of that kind: fixed values.
OTHER_NAMES = "nav menu navbar breadcrumb header masthead top footer bottom legal copyright sidebar aside widget related recommended popular ad ads advert advertisement sponsor promo banner cookie consent notice alert newsletter subscribe signup login search form share social comments comment reply disqus pagination pager tags meta author byline".split()
MAIN_NAMES = "article content main post entry story body text".split()


def _layouts(body: list[str], spare: list[str], seed: int) -> list[list[tuple[str, tuple[str, ...], float, int]]]:
    """Blocks with labels of one page's paragraphs set in layouts with and without telling tags."""
    rng = np.random.default_rng(seed)
    spare = spare or ["Home"]
    pick = lambda: spare[int(rng.integers(len(spare)))]

    def other(tag: str, name: str | None, count: int, linked: float, inner: str = "p", outer: tuple[str, ...] = ()):
        marks = ("html", "body", *outer, tag, *(("." + name,) if name else ()), *((inner,) if rng.random() < 0.6 else ()))
        return [(pick()[: int(rng.integers(4, 160))], marks, linked, 0) for _ in range(count)]

    pages = []
    for kind in range(3):
        main_tag = ("article", "main", "div")[kind]
        name = MAIN_NAMES[int(rng.integers(len(MAIN_NAMES)))]
        outer = ("html", "body", *(("div", ".container") if rng.random() < 0.5 else ()), main_tag, *(("." + name,) if kind == 2 or rng.random() < 0.5 else ()))
        page = []
        shown = body if rng.random() < 0.7 else body[: int(rng.integers(1, 4))]
        if rng.random() < 0.5:
            page += other("header" if rng.random() < 0.7 else "div", None if rng.random() < 0.5 else "header", 1, float(rng.random() < 0.5), "h1" if rng.random() < 0.6 else "p")
        for tag in ("header", "nav"):
            if rng.random() < 0.8:
                bare = rng.random() < 0.3
                page += other("div" if bare else tag, OTHER_NAMES[int(rng.integers(7))] if bare else None, int(rng.integers(1, 7)), 1.0 if rng.random() < 0.8 else 0.0, "li" if rng.random() < 0.7 else "a")
        names = [OTHER_NAMES[int(i)] for i in rng.integers(len(OTHER_NAMES), size=8)]
        for name in names[:3]:
            page += other("div", name, int(rng.integers(1, 3)), float(rng.random() < 0.3))
        for i, text in enumerate(shown):
            head = i == 0 or rng.random() < 0.05
            inner = "h1" if i == 0 else "h2" if head else ("p" if rng.random() < 0.85 else ("li", "blockquote", "pre", "td")[int(rng.integers(4))])
            page.append((text, (*outer, inner), float(rng.random() < 0.05) * 0.3, 1))
            if rng.random() < 0.12:
                tag = ("aside", "div", "form", "nav", "figure")[int(rng.integers(5))]
                page += other(tag, names[3] if tag in ("div", "figure") or rng.random() < 0.5 else None, int(rng.integers(1, 3)), float(rng.random() < 0.4), outer=outer[2:])
        for name in names[4:7]:
            page += other(("div", "section", "aside", "form", "ul")[int(rng.integers(5))], name, int(rng.integers(1, 4)), float(rng.random() < 0.4))
        for _ in range(int(rng.integers(0, 3))):  # reader comments read like prose
            c = ("comments", "comment", "reply")[int(rng.integers(3))]
            page += [(body[int(rng.integers(len(body)))], ("html", "body", ("section", "div", "ol")[int(rng.integers(3))], "." + c, ("p", "li", "div")[int(rng.integers(3))]), 0.0, 0)]
        if rng.random() < 0.9:
            page += [("© " + pick()[:60], ("html", "body", "footer" if rng.random() < 0.8 else "div", *((".footer",) if rng.random() < 0.5 else ())), 0.0, 0)]
        pages.append(page)
    return pages


def densest(blocks: list[tuple[str, tuple[str, ...], float]]) -> list[int]:
    """Labels by text alone: main are the blocks of the container that has most words of running text.

    Running text: blocks of ten words or more, few of them links, outside of what layouts name as other. A page without any has
    its longest block as main text. Ties go to the container that comes first.
    """
    aside = {"nav", "aside", "footer", "form", "header"} | {"." + w for w in OTHER_NAMES}
    free = [not aside & set(m) for _, m, _ in blocks]
    sizes: dict[tuple[str, ...], int] = {}
    for (text, marks, linked), ok in zip(blocks, free):
        words = text.count(" ") + 1
        if ok and words >= 10 and linked < 0.3:
            sizes[marks[:-1]] = sizes.get(marks[:-1], 0) + words
    if not sizes:
        longest = max((len(t) for (t, _, _), ok in zip(blocks, free) if ok or not any(free)), default=0)
        return [int(len(t) == longest and (ok or not any(free))) for (t, _, _), ok in zip(blocks, free)]
    top = max(sizes, key=sizes.get)
    return [int(ok and m[: len(top)] == top) for (_, m, _), ok in zip(blocks, free)]


def labelled_pages(pages: list[str]) -> list[tuple[list[list[int]], list[int]]]:
    """Feature sequences and labels of sampled pages and of layouts made of them. Pages without an article element are labelled by their densest blocks."""
    out = []
    for seed, page in enumerate(pages):
        blocks = leaf_blocks(page)
        label = [int("article" in m and not {"nav", "aside", "footer", "form", "header"} & set(m)) for _, m, _ in blocks]
        if not any(label):
            label = densest(blocks)
        body = [t for (t, _, _), y in zip(blocks, label) if y]
        if not body:
            continue
        out.append((features(blocks), label))
        for made in _layouts(body, [t for (t, _, _), y in zip(blocks, label) if not y], seed):
            out.append((features([b[:3] for b in made]), [b[3] for b in made]))
    return out


def fit(sequences: list[tuple[list[list[int]], list[int]]], *, steps: int = STEPS, l2: float = 0.3) -> tuple[np.ndarray, np.ndarray]:
    """Emission weights (for label main) and 2 x 2 transition weights by maximum likelihood; all zero without sequences."""
    w, trans = np.zeros(BUCKETS), np.zeros((2, 2))
    sequences = [s for s in sequences if s[0]]
    if not sequences:
        return w, trans
    sequences = sorted(sequences, key=lambda s: -len(s[0]))
    lengths = np.array([len(s[0]) for s in sequences])
    B, T = len(sequences), int(lengths[0])
    y = np.zeros((B, T), int)
    idx, row = [], []
    for b, (f, label) in enumerate(sequences):
        y[b, : len(label)] = label
        for t, own in enumerate(f):
            idx += own
            row += [b * T + t] * len(own)
    idx, row = np.array(idx), np.array(row)
    used, idx = np.unique(idx, return_inverse=True)
    valid = np.arange(T) < lengths[:, None]
    theta = np.zeros(len(used) + 4)
    m = v = np.zeros_like(theta)
    total = lengths.sum()
    for step in range(1, steps + 1):
        e = np.bincount(row, theta[idx], B * T).reshape(B, T)
        tr = theta[-4:].reshape(2, 2)
        score = np.stack([np.zeros_like(e), e], axis=2)
        alpha = np.zeros((B, T, 2))
        alpha[:, 0] = score[:, 0]
        for t in range(1, T):
            live = valid[:, t].sum()  # sequences are in descending length
            alpha[:live, t] = np.logaddexp(alpha[:live, t - 1, :1] + tr[0], alpha[:live, t - 1, 1:] + tr[1]) + score[:live, t]
        beta = np.zeros((B, T, 2))
        for t in range(T - 2, -1, -1):
            live = valid[:, t + 1].sum()
            x = beta[:live, t + 1] + score[:live, t + 1]
            beta[:live, t] = np.logaddexp(x[:, :1] + tr[:, 0], x[:, 1:] + tr[:, 1])
        z = np.logaddexp(alpha[np.arange(B), lengths - 1, 0], alpha[np.arange(B), lengths - 1, 1])
        p1 = np.exp(np.minimum(alpha[:, :, 1] + beta[:, :, 1] - z[:, None], 0)) * valid
        ge = np.bincount(idx, (p1 - y * valid).reshape(-1)[row], len(used))
        pair = np.exp(np.minimum(alpha[:, :-1, :, None] + tr + (beta + score)[:, 1:, None, :] - z[:, None, None, None], 0)) * valid[:, 1:, None, None]
        gt = pair.sum(axis=(0, 1))
        both = valid[:, 1:]
        for i in (0, 1):
            for j in (0, 1):
                gt[i, j] -= ((y[:, :-1] == i) & (y[:, 1:] == j) & both).sum()
        g = (np.concatenate([ge, gt.ravel()]) + l2 * theta) / total
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    w[used] = theta[:-4]
    return w, theta[-4:].reshape(2, 2)


def viterbi(emissions: list[float], trans: list[list[float]]) -> list[int]:
    """The best labels of a sequence whose label main scores `emissions` and other 0."""
    (t00, t01), (t10, t11) = trans
    a, b, back = 0.0, emissions[0] if emissions else 0.0, []
    for e in emissions[1:]:
        from_a, from_b = a + t00 >= b + t10, a + t01 > b + t11
        back.append((0 if from_a else 1, 0 if from_b else 1))
        a, b = max(a + t00, b + t10), max(a + t01, b + t11) + e
    out = [1 if b > a else 0] if emissions else []
    for x in reversed(back):
        out.append(x[out[-1]])
    return out[::-1]


class Extractor:
    def __init__(self, w: np.ndarray, trans: np.ndarray):
        self.w, self.trans, self.fitted = w.tolist(), trans.tolist(), bool(np.any(w))

    def __call__(self, page: str | None) -> str:
        blocks, w = leaf_blocks(page), self.w
        if not self.fitted:
            label = densest(blocks)
        else:
            label = viterbi([sum(w[i] for i in f) for f in features(blocks)], self.trans)
        return "\n".join(t for (t, _, _), y in zip(blocks, label) if y)


def train(pages: DataFrame, *, max_pages: int = TRAIN_PAGES, max_bytes: int = TRAIN_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Fit on at most max_pages different pages, first by a hash of their content, of max_bytes together.

    A page that does not fit into the bytes left is passed over and smaller ones after it are taken. Null and empty pages are not
    sampled; repeated ones count once. Without any page the model is zero, and extraction falls back on densest().
    """
    p = with_columns_of(pages, "html").where("html <> ''").select("html", F.xxhash64("html").alias("h"))
    sizes = p.select("h", F.octet_length("html").alias("n")).where(F.col("n") <= max_bytes).distinct()
    left, chosen = max_bytes, []
    for r in sizes.orderBy("h", "n").limit(max_pages).collect():
        if r["n"] <= left:
            left -= r["n"]
            chosen.append(r["h"])
    if not chosen:
        return fit([])
    rows = p.where(F.col("h").isin(chosen)).where(F.octet_length("html") <= max_bytes).dropDuplicates(["h"]).collect()  # max_pages rows of max_bytes together
    return fit(labelled_pages([r["html"] for r in sorted(rows, key=lambda r: r["h"])]))


def extract(pages: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(page_id, url, text, n_chars) of each row. Null and empty html give empty text; repeated rows are read each; ids and urls, of any type, stay as they are."""
    importable(pages.sparkSession)
    sent = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        extractor = Extractor(*sent.value)
        for b in in_blocks(batches, 500):
            texts = [extractor(h) for h in b.column("html").to_pylist()]
            rows = [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(rows, names=["page_id", "url", "text", "n_chars"])

    own = with_columns_of(pages, "page_id", "url", "html")
    kinds = ", ".join(f"{c} {own.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))
    return own.mapInArrow(run, f"{kinds}, text string, n_chars long")


def op5_html_extract(spark, sf_dir) -> DataFrame:
    """Every page of the table."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract(pages, train(pages))
