"""Edit-aware token counts: a segment tree over the pre-tokens of each document.

Building: a text is cut into pre-tokens by the tokenizer's pattern and each pre-token's tokens are counted. The leaves of
the tree are runs of at most ``LEAF`` pre-tokens; every node holds the characters and tokens below it.

Editing: the tree finds the pre-tokens that an edit touches. A pre-token depends on one character beyond its end at most, so
scanning starts at the first one that ends less than two characters before the edit and goes on until it meets an old
boundary behind the edit; everything else stays as it was. Only the pre-tokens scanned are encoded again, and only
the sums above their leaves change. The result equals encoding the edited text from the start, which the tests check.

Edits are applied in the order of the array; each speaks of the text as the earlier ones left it, in code points. Starts
and sizes beyond the text are moved to its end, negative and null ones count as 0, a null replacement as empty. Null
texts count as empty, without tokens. Rows are independent of each other; columns named like an output are replaced.

The vocabulary is a public byte-level BPE file read by path; it is a parameter, and nothing is trained.
"""

from __future__ import annotations

import base64
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .schemas import extended

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LEAF = 128
REACH = 2  # a pre-token may depend on this many characters from its end on
CACHE = 400_000


class Counter:
    """Tokens per pre-token, remembered up to a bound."""

    def __init__(self, vocabulary: str = VOCABULARY, pattern: str = PATTERN, cache: int = CACHE):
        with open(vocabulary, "rb") as file:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, file)}
        self.encoding = tiktoken.Encoding("counter", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern, self.most = regex.compile(pattern), cache
        self.known: dict[str, int] = {}

    def cut(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def tokens(self, pieces: list[str]) -> list[int]:
        known, out = self.known, []
        for piece in pieces:
            n = known.get(piece)
            if n is None:
                n = len(self.encoding.encode_ordinary(piece))
                if len(known) >= self.most:
                    known.clear()
                known[piece] = n
            out.append(n)
        return out


class Tree:
    """Sums of characters and tokens over leaves that hold short runs of pre-tokens. The text lives in the leaves."""

    def __init__(self, pieces: list[str], counts: list[int]):
        self.encoded = 0
        self._plant([(pieces[i : i + LEAF], counts[i : i + LEAF]) for i in range(0, len(pieces), LEAF)] or [([], [])])

    def _plant(self, leaves: list[tuple[list[str], list[int]]]):
        self.leaves, self.base = leaves, 1
        while self.base < len(leaves):
            self.base *= 2
        self.chars, self.tokens = ([0] * (2 * self.base) for _ in range(2))
        for i, (pieces, counts) in enumerate(leaves):
            self.chars[self.base + i], self.tokens[self.base + i] = sum(map(len, pieces)), sum(counts)
        for i in range(self.base - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def _update(self, leaf: int):
        node, (pieces, counts) = self.base + leaf, self.leaves[leaf]
        self.chars[node], self.tokens[node] = sum(map(len, pieces)), sum(counts)
        while node > 1:
            node //= 2
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
            self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    def text(self) -> str:
        return "".join(piece for pieces, _ in self.leaves for piece in pieces)

    def flat(self) -> tuple[list[str], list[int]]:
        return [p for pieces, _ in self.leaves for p in pieces], [n for _, counts in self.leaves for n in counts]

    def _find(self, at: int) -> tuple[int, int, int]:
        """Leaf, place in the leaf and first character of the pre-token that holds character ``at``."""
        node, before = 1, 0
        while node < self.base:
            node *= 2
            if at >= before + self.chars[node] and node + 1 < len(self.chars):
                before += self.chars[node]
                node += 1
        leaf = min(node - self.base, len(self.leaves) - 1)
        before = before if leaf == node - self.base else self.n_chars - self.chars[self.base + leaf]
        pieces = self.leaves[leaf][0]
        ends = np.cumsum([len(p) for p in pieces]).tolist()
        place = min(bisect_right(ends, at - before), max(len(pieces) - 1, 0))
        return leaf, place, before + (ends[place - 1] if place else 0)

    def edit(self, counter: Counter, start: int, size: int, put: str):
        start = min(max(start, 0), self.n_chars)
        stop = min(start + max(size, 0), self.n_chars)
        leaf, place, first = self._find(max(start - REACH, 0))
        # walk from there: the old pre-tokens of the region, their text, and their boundaries behind the edit
        old: list[str] = []
        end, l, p = first, leaf, place
        reach = 8
        while True:
            taken = 0
            while l < len(self.leaves) and (end < stop or taken < reach):
                pieces = self.leaves[l][0]
                if p >= len(pieces):
                    l, p = l + 1, 0
                    continue
                old.append(pieces[p])
                end += len(pieces[p])
                taken += end >= stop
                p += 1
            ended = end == self.n_chars
            was = "".join(old)
            now = was[: start - first] + put + was[stop - first :]
            shift = len(now) - len(was)
            edges, at = {}, first
            for i, piece in enumerate(old):
                at += len(piece)
                if at >= stop:
                    edges[at - first + shift] = i + 1
            if stop == first:
                edges[shift] = 0
            fresh, upto, met = [], 0, 0 if not now else None
            for match in counter.pattern.finditer(now):
                if match.end() + REACH > len(now) and not ended:
                    break
                fresh.append(match.group())
                upto = match.end()
                if upto in edges and upto >= start - first + len(put):
                    met = edges[upto]
                    break
            if met is not None and now:
                break
            if ended:
                met = len(old)
                break
            reach *= 4
        self.encoded += len(fresh)
        self._replace(leaf, place, met, fresh, counter.tokens(fresh))

    def _replace(self, leaf: int, place: int, gone: int, fresh: list[str], counts: list[int]):
        """Put new pre-tokens in place of ``gone`` old ones, from a place in a leaf on."""
        touched = [leaf]
        pieces, held = self.leaves[leaf]
        here = min(gone, len(pieces) - place)
        pieces[place : place + here], held[place : place + here] = fresh, counts
        gone -= here
        while gone:
            leaf += 1
            pieces, held = self.leaves[leaf]
            here = min(gone, len(pieces))
            del pieces[:here], held[:here]
            gone -= here
            touched.append(leaf)
        if any(len(self.leaves[i][0]) > 4 * LEAF for i in touched):  # a leaf that has grown too long is cut up
            self._plant([
                (pieces[i : i + LEAF], held[i : i + LEAF])
                for pieces, held in self.leaves for i in range(0, max(len(pieces), 1), LEAF)
            ])
            return
        for i in touched:
            self._update(i)


def _lists(values: list[np.ndarray]) -> pa.Array:
    edges = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    flat = np.concatenate(values).astype(np.int32) if values else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(edges), pa.array(flat, pa.int32()))


def _build(vocabulary: str, text: str, fields: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary)
        for batch in batches:
            chars, tokens = [], []
            for value in batch.column(text):
                pieces = counter.cut(value.as_py() or "")
                chars.append(np.fromiter(map(len, pieces), np.int32, len(pieces)))
                tokens.append(np.array(counter.tokens(pieces), np.int32))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in fields), _lists(chars), _lists(tokens)], names=[*fields, "piece_chars", "piece_tokens"]
            )

    return run


def built(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """The documents with the leaves of their trees: characters and tokens of every pre-token. This is the state to keep."""
    fields, schema = extended(docs, docs.columns, "piece_chars array<int>, piece_tokens array<int>")
    return docs.mapInArrow(_build(vocabulary, text, fields), schema)


def _apply(vocabulary: str, text: str, edits: str, fields: list[str], whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary)
        for batch in batches:
            kept: dict[str, list] = {c: [] for c in ("n_tokens_before", "n_chars", "n_pretokens", "n_tokens", "n_edits", "n_reencoded")}
            texts, chars, tokens = [], [], []
            columns = (batch.column(c) for c in (text, "piece_chars", "piece_tokens", edits))
            for value, sizes, counts, changes in zip(*columns):
                value, sizes, counts = value.as_py() or "", sizes.values.to_numpy(), counts.values.tolist()
                ends = np.cumsum(sizes).tolist()
                tree = Tree([value[a:b] for a, b in zip([0, *ends], ends)], counts)
                before, changes = tree.n_tokens, changes.as_py() or []
                for change in changes:
                    tree.edit(counter, change["start"] or 0, change["size"] or 0, change["put"] or "")
                values = (before, tree.n_chars, sum(len(p) for p, _ in tree.leaves), tree.n_tokens, len(changes), tree.encoded)
                for name, n in zip(kept, values):
                    kept[name].append(n)
                if whole:
                    pieces, counts = tree.flat()
                    texts.append("".join(pieces))
                    chars.append(np.array([len(p) for p in pieces], np.int32))
                    tokens.append(np.array(counts, np.int32))
            out = {c: batch.column(c) for c in fields} | {c: pa.array(v, pa.int64()) for c, v in kept.items()}
            if whole:
                out |= {text: pa.array(texts, pa.string()), "piece_chars": _lists(chars), "piece_tokens": _lists(tokens)}
            yield pa.RecordBatch.from_pydict(out)

    return run


def edited(
    state: DataFrame, edits: str = "edits", text: str = "text", vocabulary: str = VOCABULARY, whole: bool = True
) -> DataFrame:
    """Apply each row's edits, an array of (start, size, put), to its text and tree.

    Gives the other columns, the counts before and after, the pre-tokens encoded again and, with ``whole``, the edited text
    and the state to keep. Nothing is shuffled."""
    own = ("n_tokens_before", "n_chars", "n_pretokens", "n_tokens", "n_edits", "n_reencoded")
    fields = [c for c in state.columns if c not in (edits, text, "piece_chars", "piece_tokens")]
    added = ", ".join(f"{name} long" for name in own)
    if whole:
        added += f", `{text}` string, piece_chars array<int>, piece_tokens array<int>"
    fields, schema = extended(state, fields, added)
    return state.mapInArrow(_apply(vocabulary, text, edits, fields, whole), schema)


def revisions(key: str = "doc_id", text: str = "text", rounds: int = 3) -> Column:
    """Edits derived from the data, for trying out: at hashed places, words are put in, cut out and replaced in turn."""
    place = lambda i: F.pmod(F.xxhash64(F.lit(i), F.col(key).cast("string")), F.length(F.coalesce(F.col(text), F.lit(""))) + 1)
    puts, sizes = (" revised here,", "", "It's 2 words"), (0, 17, 9)
    return F.array(*[
        F.struct(place(i).cast("int").alias("start"), F.lit(sizes[i % 3]).alias("size"), F.lit(puts[i % 3]).alias("put"))
        for i in range(rounds)
    ])
