"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the page.

Each block is described by its ancestor tags, by words in the class, id and role of its ancestors, and by its text; the
field labels the blocks of a page as article or not, jointly, and Viterbi finds the best labelling. The text of the
article blocks, joined by one space, is the result.

Labelled pages: those whose authors marked the article (``article`` or ``main``, a role, or ``articleBody``), in which the
blocks inside count as article unless they stand in a menu, an advert, a form, a comment list and the like. Each is
learned from twice, once with the features of that markup switched off, so that the field also reads pages without it.
Weights are fitted by gradient on the exact likelihood, drawn towards stated prior weights, which alone decide when there
is no labelled page. The fit reads about ``train_pages`` pages picked by a hash of the id and of at most ``train_bytes``
each (documented bounds of the sample); extraction reads every page whole.

Null and empty pages give an empty text. Pages cut off in the middle are read as far as they go. Rows are independent, so
repeated and null ids do no harm; other columns pass through, one named like an output is replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_blocks import Block, blocks_of
from .schemas import extended

TRAIN_PAGES = 400
TRAIN_BYTES = 1 << 20

MARKED = re.compile(r"\b(articlebody|article-body|post-content|entry-content)\b|^\s*(article|main)\s*$")
# words in class, id or role that name a part of a page
PARTS = {
    "advert": r"ads?|advert\w*|sponsor\w*|promo\w*|banner|dfp|outbrain|taboola",
    "menu": r"nav\w*|menu\w*|breadcrumbs?|pagination|pager|toc|tabs?|toolbar|navigation",
    "frame": r"header|masthead|footer|copyright|contentinfo|colophon|bottom|topbar",
    "side": r"side\w*|aside|related|recommend\w*|widgets?|trending|popular|complementary",
    "notice": r"cookies?|consent|gdpr|notices?|alerts?|popup|modal|overlay|dialog|disclaimer|newsletter|subscribe|signup|paywall",
    "comment": r"comments?|commentlist|repl(y|ies)|discussion|disqus|respond|reviews?",
    "form": r"forms?|login|search|contact|poll",
    "share": r"shar(e|ing)|social|follow|tags?|byline|meta|author-box",
}
_PARTS = {name: re.compile(rf"(?<![a-z0-9])(?:{words})(?![a-z0-9])") for name, words in PARTS.items()}
TAGS = ("nav", "header", "footer", "aside", "form", "ul", "ol", "table", "figure", "blockquote", "pre", "section", "p", "li", "td")
OUTSIDE = frozenset("nav footer aside form button select textarea label dialog menu fieldset".split())
NAMES = (
    "bias", "marked", "marked_page", "hidden", *(f"in_{t}" for t in TAGS), "in_outside", *PARTS, "heading", "link_share",
    "mostly_links", "log_words", "few_words", "many_words", "sentence_end", "commas", "digits", "capitals", "copyright",
    "like_title", "before_heading", "words_before", "words_after",
)
_AT = {name: i for i, name in enumerate(NAMES)}
PRIOR = {
    "bias": -1.0, "marked": 3.0, "marked_page": -1.0, "hidden": -4.0, "in_nav": -3.0, "in_header": -1.0, "in_footer": -3.0, "in_aside": -3.0,
    "in_form": -3.0, "in_outside": -2.0, **{name: -3.0 for name in PARTS}, "mostly_links": -2.0, "log_words": 0.6, "many_words": 1.0,
    "sentence_end": 1.0, "copyright": -2.0, "like_title": 0.5, "in_p": 1.0, "stay": 1.0,
}


def _marked(block: Block) -> int:
    """Depth of the innermost element that marks an article, or -1."""
    depth = -1
    for i, (tag, names) in enumerate(zip(block.tags, block.names)):
        if tag in ("article", "main") or names and MARKED.search(names):
            depth = i
    return depth


def _parts(block: Block, since: int = 0) -> set[str]:
    named = " ".join(filter(None, block.names[since:]))
    return {part for part, words in _PARTS.items() if words.search(named)} if named else set()


def label(block: Block) -> int:
    """What the page's own markup says: 1 inside a marked article and outside its menus, adverts, forms and comments."""
    depth = _marked(block)
    if depth < 0 or block.hidden or OUTSIDE.intersection(block.tags[depth:]):
        return 0
    return int(not _parts(block, depth + 1))


def features(blocks: list[Block], title: str) -> np.ndarray:
    x = np.zeros((len(blocks), len(NAMES)), np.float32)
    sizes = [b.text.count(" ") + 1 for b in blocks]
    page_marked = any(_marked(b) >= 0 for b in blocks)
    for i, (block, n) in enumerate(zip(blocks, sizes)):
        row, tags = x[i], set(block.tags)

        def put(name: str, value: float = 1.0):
            row[_AT[name]] = value

        put("bias")
        put("marked", _marked(block) >= 0)
        put("marked_page", page_marked)
        put("hidden", block.hidden)
        for tag in tags.intersection(TAGS):
            put(f"in_{tag}")
        put("in_outside", bool(tags & OUTSIDE))
        for part in _parts(block):
            put(part)
        put("heading", any(t in tags for t in ("h1", "h2", "h3", "h4", "h5", "h6")))
        put("link_share", min(1.0, block.linked / len(block.text)))
        put("mostly_links", block.linked > 0.6 * len(block.text))
        put("log_words", np.log1p(n) / 3)
        put("few_words", n < 4)
        put("many_words", n >= 20)
        put("sentence_end", block.text[-1] in ".!?…\"”")
        put("commas", min(1.0, block.text.count(",") / n * 5))
        chars = Counter(block.text)
        put("digits", sum(k for c, k in chars.items() if c.isdigit()) / len(block.text))
        put("capitals", sum(k for c, k in chars.items() if c.isupper()) / max(sum(k for c, k in chars.items() if c.isalpha()), 1))
        put("copyright", "©" in block.text or "all rights reserved" in block.text.lower())
        put("like_title", bool(title) and (block.text.startswith(title) or title.startswith(block.text) and n >= 3))
        put("before_heading", i + 1 < len(blocks) and "h1" in blocks[i + 1].tags)
        put("words_before", np.log1p(sizes[i - 1]) / 3 if i else 0.0)
        put("words_after", np.log1p(sizes[i + 1]) / 3 if i + 1 < len(blocks) else 0.0)
    return x


def unmarked(x: np.ndarray) -> np.ndarray:
    """The same page as if its article were not marked."""
    x = x.copy()
    x[:, [_AT["marked"], _AT["marked_page"], _AT["in_section"]]] = 0
    return x


class Field:
    """Weights of the label 'article' per feature, and of staying in or changing the label between neighbours."""

    def __init__(self):
        self.weights = np.array([PRIOR.get(n, 0.0) for n in NAMES])
        self.moves = np.array([[PRIOR["stay"], 0.0], [0.0, PRIOR["stay"]]])

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The most likely labels (Viterbi)."""
        scores = (x @ self.weights).tolist()
        (oo, oi), (io, ii) = self.moves.tolist()
        out, inside, back = 0.0, scores[0], []
        for s in scores[1:]:
            from_in_out, from_in_in = inside + io > out + oo, inside + ii > out + oi
            back.append((from_in_out, from_in_in))
            out, inside = max(out + oo, inside + io), max(out + oi, inside + ii) + s
        state = inside > out
        labels = [state]
        for pointers in reversed(back):
            state = pointers[state]
            labels.append(state)
        return np.array(labels[::-1], bool)

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Negative log-likelihood of one page and its gradients, by forward and backward sums."""
        n = len(y)
        unary = np.zeros((n, 2))
        unary[:, 1] = x @ self.weights
        ahead, behind = np.zeros((n, 2)), np.zeros((n, 2))
        ahead[0] = unary[0]
        for t in range(1, n):
            ahead[t] = unary[t] + np.logaddexp(ahead[t - 1, 0] + self.moves[0], ahead[t - 1, 1] + self.moves[1])
        for t in range(n - 2, -1, -1):
            onward = unary[t + 1] + behind[t + 1]
            behind[t] = np.logaddexp(self.moves[:, 0] + onward[0], self.moves[:, 1] + onward[1])
        total = np.logaddexp(*ahead[-1])
        single = np.exp(ahead + behind - total)
        d_moves = np.zeros((2, 2))
        if n > 1:
            pair = ahead[:-1, :, None] + self.moves + (unary[1:] + behind[1:])[:, None, :] - total
            d_moves = np.exp(pair).sum(axis=0)
            np.add.at(d_moves, (y[:-1], y[1:]), -1.0)
        said = unary[np.arange(n), y].sum() + self.moves[y[:-1], y[1:]].sum()
        return float(total - said), x.T @ (single[:, 1] - y), d_moves

    def train(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int, step: float, pull: float, seed: int):
        prior = (self.weights.copy(), self.moves.copy())
        draw, count = np.random.default_rng(seed), 0
        size = self.weights.size
        first, second = np.zeros(size + 4), np.zeros(size + 4)
        for _ in range(epochs):
            for part in np.array_split(draw.permutation(len(pages)), max(1, len(pages) // 16)):
                found = [self.gradient(*pages[i]) for i in part]
                g = np.concatenate([
                    sum(f[1] for f in found) / len(found) + pull * (self.weights - prior[0]),
                    (sum(f[2] for f in found) / len(found) + pull * (self.moves - prior[1])).ravel(),
                ])
                count += 1
                first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
                move = step * (first / (1 - 0.9**count)) / (np.sqrt(second / (1 - 0.999**count)) + 1e-8)
                self.weights = self.weights - move[:size]
                self.moves = self.moves - move[size:].reshape(2, 2)


def labelled(htmls: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Features and labels of the pages whose markup tells the article, each with and without that markup's features."""
    out = []
    for html in htmls:
        blocks, title = blocks_of(html)
        y = np.array([label(b) for b in blocks], int)
        if y.any():
            x = features(blocks, title).astype(float)
            out += [(x, y), (unmarked(x), y)]
    return out


def fit(
    pages: DataFrame, key: str = "page_id", html: str = "html", train_pages: int = TRAIN_PAGES,
    train_bytes: int = TRAIN_BYTES, epochs: int = 6, step: float = 0.05, pull: float = 1e-2, seed: int = 5,
) -> Field:
    named = pages.select(F.col(key).cast("string").alias("key"), F.col(html).alias("html"))
    count = named.count()
    draw = F.pmod(F.xxhash64(F.lit("html"), F.col("key")), F.lit(1_000_003)) / 1_000_003.0
    sample = named.filter((draw < train_pages / max(count, 1)) & (F.octet_length("html") <= train_bytes))
    rows = sample.orderBy("key", "html").limit(2 * train_pages).collect()  # the limit only makes the bound certain
    field, known = Field(), labelled([r["html"] for r in rows])
    if known:
        field.train(known, epochs, step, pull, seed)
    return field


def main_text(html: str | None, field: Field) -> str:
    blocks, title = blocks_of(html)
    if not blocks:
        return ""
    return " ".join(b.text for b, keep in zip(blocks, field.decode(features(blocks, title))) if keep)


def _extract(field: Field, html: str, fields: list[str], named: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py(), field) for h in batch.column(html)]
            out = [batch.column(c) for c in fields]
            out += [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(out, names=[*fields, *named])

    return run


def extracted(
    pages: DataFrame, field: Field, html: str = "html", names: tuple[str, str] = ("text", "n_chars"),
    keep: list[str] | None = None,
) -> DataFrame:
    """The pages (or their columns ``keep``) with the main text and its number of characters; nothing is shuffled."""
    fields, schema = extended(pages, pages.columns if keep is None else keep, f"{names[0]} string, {names[1]} long")
    return pages.mapInArrow(_extract(field, html, fields, list(names)), schema)
