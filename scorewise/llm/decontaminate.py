"""Benchmark decontamination: one Aho-Corasick automaton over the windows of the benchmark texts.

Texts are normalised to lower-case words (bytes outside 0-9, a-z and the bytes of non-ASCII characters separate words).
A window is ``window`` consecutive words of an item, or all words of a shorter item. The automaton holds every distinct
window with a space at either end, so a match is a match of whole words; each document is scanned once, and matches are
mapped back to word numbers and to character offsets in the original text.

The automaton is the one thing every task holds. Its size is bounded: items are dealt to automata of at most
``block_words`` words (an item longer than that makes a block alone), and a benchmark beyond one block is scanned block
after block, each pass adding to what the earlier ones found. Documents are never shuffled and never cut.

Null and empty documents have no words and no hits; null items and items without words have no window. Items that occur
twice with one id count once, equal texts under two ids count as two. Columns other than key and
text are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewise.sources.shared import written

WINDOW = 10
BLOCK_WORDS = 100_000  # about 400 MB of automaton in a worker

_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_KEPT = np.frombuffer(_FOLD, np.uint8) != 32


def folded_words(text: str | None) -> list[bytes]:
    """Lower-case words of a text, as UTF-8."""
    return text.encode().translate(_FOLD).split() if text else []


def item_windows(words: list[bytes], window: int = WINDOW) -> list[bytes]:
    return [b" ".join(words[i : i + window]) for i in range(max(1, len(words) - window + 1))] if words else []


def automaton(items: list[tuple[str, str | None]], window: int = WINDOW) -> tuple[ahocorasick.Automaton, list[list[str]]]:
    """The automaton, whose values are (pattern number, words in it), and the item ids of each pattern.

    Patterns are kept as one character per byte, so that positions in a scan are byte positions."""
    found: dict[bytes, set[str]] = {}
    for item, text in items:
        for piece in item_windows(folded_words(text), window):
            found.setdefault(piece, set()).add(item)
    machine = ahocorasick.Automaton()
    for number, piece in enumerate(found):
        machine.add_word(f" {piece.decode('latin-1')} ", (number, piece.count(b" ") + 1))
    if found:
        machine.make_automaton()
    return machine, [sorted(ids) for ids in found.values()]


def hit_runs(text: str | None, machine: ahocorasick.Automaton) -> tuple[int, list[tuple[int, int]], set[int]]:
    """Number of words; runs of word numbers (end exclusive) inside some window; numbers of the patterns that occur."""
    words = folded_words(text)
    if not words or not len(machine):
        return len(words), [], set()
    line = f" {b' '.join(words).decode('latin-1')} "
    matches = [(end, number, size) for end, (number, size) in machine.iter(line)]
    if not matches:
        return len(words), [], set()
    spaces = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
    last = np.searchsorted(spaces, [m[0] for m in matches])  # a match ends at the space behind its last word
    runs: list[list[int]] = []
    for start, end in sorted((int(e) - m[2], int(e)) for e, m in zip(last, matches)):
        if runs and start <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], end)
        else:
            runs.append([start, end])
    return len(words), [(a, b) for a, b in runs], {m[1] for m in matches}


def char_spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of word numbers as (start, end) characters of the original text."""
    raw = text.encode()
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = _KEPT[np.frombuffer(raw, np.uint8)]
    starts, ends = np.flatnonzero(inside[1:-1] & ~inside[:-2]), np.flatnonzero(inside[1:-1] & ~inside[2:]) + 1
    return [(len(raw[: starts[a]].decode()), len(raw[: ends[b - 1]].decode())) for a, b in runs]


_SCHEMA = "n_words long, runs array<struct<first: long, last: long>>, spans array<struct<first: long, last: long>>, items array<string>"
_RUNS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def _merged(old: list[dict], new: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted([(r["first"], r["last"]) for r in old] + new):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _scan(items: list[tuple[str, str | None]], window: int, key: str, first: bool, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, names = automaton(items, window)
        for batch in batches:
            texts = batch.column("text")
            before = [[]] * len(texts) if first else batch.column("runs").to_pylist()
            known = [[]] * len(texts) if first else batch.column("items").to_pylist()
            counts, runs, spans, ids = [], [], [], []
            for text, old, had in zip(texts, before, known):
                text = text.as_py()
                n, here, patterns = hit_runs(text, machine)
                here = _merged(old, here) if old else here
                counts.append(n)
                runs.append([{"first": a, "last": b} for a, b in here])
                spans.append([{"first": a, "last": b} for a, b in char_spans(text, here)] if here else [])
                ids.append(sorted({i for p in patterns for i in names[p]} | set(had)))
            out = {key: batch.column(key)} | ({"text": texts} if keep_text else {})
            out |= {"n_words": pa.array(counts, pa.int64()), "runs": pa.array(runs, _RUNS),
                    "spans": pa.array(spans, _RUNS), "items": pa.array(ids, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_pydict(out)

    return run


def _blocks(benchmark: DataFrame, item: str, text: str, block_words: int) -> Iterator[list[tuple[str, str | None]]]:
    """The benchmark in blocks of bounded size, read one partition at a time."""
    block, held = [], 0
    for row in benchmark.select(F.col(item).cast("string").alias("i"), F.col(text).alias("t")).toLocalIterator():
        size = len(folded_words(row["t"]))
        if block and held + size > block_words:
            yield block
            block, held = [], 0
        block.append((row["i"] or "", row["t"]))
        held += size
    yield block


def overlaps(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text",
    item: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Per document: key, n_words, the runs of hit words, their character spans in the text, the items found."""
    kind = docs.schema[key].dataType.simpleString()
    state, found = docs.select(F.col(key), F.col(text).alias("text")), None
    blocks = _blocks(benchmark, item, item_text, block_words)
    block = next(blocks)
    while True:
        follows = next(blocks, None)
        fields = f"`{key}` {kind}, " + ("" if follows is None else "text string, ") + _SCHEMA
        found = state.mapInArrow(_scan(block, window, key, found is None, follows is not None), fields)
        if follows is None:
            return found
        state, block = written(found, "overlaps"), follows


def summary(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The digest columns of ``overlaps``."""
    hit = F.aggregate("runs", F.lit(0).cast("long"), lambda s, r: s + r["last"] - r["first"])
    return found.select(
        key, "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def _clean(items: list[tuple[str, str | None]], window: int, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, _ = automaton(items, window)
        for batch in batches:
            yield batch.filter(pa.array([not hit_runs(t.as_py(), machine)[1] for t in batch.column(text)], pa.bool_()))

    return run


def uncontaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", item: str = "item_id",
    item_text: str = "text", block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """The documents, with all their columns, in which no window occurs. Nothing is shuffled."""
    kept = docs
    for number, block in enumerate(_blocks(benchmark, item, item_text, block_words)):
        kept = (written(kept, "clean") if number else kept)
        kept = kept.mapInArrow(_clean(block, window, text), docs.schema)
    return kept
