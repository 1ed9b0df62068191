"""Substring dedup: passages of ``WINDOW`` words or more that occur elsewhere, by prefix-partitioned suffix trees.

All suffixes of a corpus do not fit anywhere, and most share nothing deep. So the suffixes are thinned and parted:

1. Of the k-word prefixes inside a window, the one with the least hash stands for the window (the leftmost of ties).
   Equal windows are represented at the same place, so only those suffixes, about two in ``WINDOW - k`` words, are
   listed: (prefix, text, position).
2. Prefixes listed once lead nowhere. The others part the suffixes into groups. Every text is joined, once, with the
   positions of its grouped suffixes; texts without any are done.
3. A grouped suffix is written out with the words of all windows that it stands for, and goes to its group. A task builds
   the subtrees of its groups, a bounded number at a time: words are numbered exactly, and the substrings of each depth
   1, 2, 4, ... up to ``WINDOW`` are named from the names of their two halves, equal names meaning equal words. A node at
   full depth with two leaves or more is a repeat, and its leaves are the windows that occur elsewhere.
4. A prefix with more than ``GROUP_ROWS`` suffixes would not fit one task. Its windows get the longest prefix there is,
   themselves: they are counted by a 128-bit name of all their words, with partial counts, and no task holds a group.

Windows are judged on the input. Texts are known by (64-bit hash, length in bytes), not by id, so repeated or null ids do
no harm, and equal texts are each other's repeats. Null counts as empty; texts shorter than a window lose nothing. Other
columns pass through, and one named like an output is replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorewise.sources.shared import written

from .schemas import extended, unpacked, whole_row
from .words import mix, owner, shingle_hashes, slices, spans, word_hashes

WINDOW = 35
PREFIX = 8
GROUP_ROWS = 20_000  # about 6 MB of words
FLUSH_ROWS = 20_000


def _leftmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost least value among the ``width`` values from each position on."""
    best = np.arange(len(values))
    reach = 1
    while reach < width:
        step = min(reach, width - reach)
        left, right = best[:-step], best[step:]
        best = np.where(values[right] < values[left], right, left)
        reach += step
    return best


class Suffixes:
    """The suffixes that stand for the windows of some texts. Word numbers count through all the texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, window: int, prefix: int):
        self.starts, self.ends, self.first = spans(data, offsets)
        self.words = word_hashes(data, self.starts, self.ends)
        self.doc = self.at = self.low = self.high = np.zeros(0, np.int64)
        self.prefix = np.zeros(0, np.uint64)
        if len(self.words) < window:
            return
        hashes = shingle_hashes(self.words, prefix)
        least = _leftmost_least(hashes, window - prefix + 1)  # one per window of the slice
        owners = owner(self.first)
        inside = owners[: len(least)] == owners[window - 1 :]
        opens = inside.copy()
        opens[1:] &= ~inside[:-1] | (least[1:] != least[:-1]) | (owners[1 : len(least)] != owners[: len(least) - 1])
        begin = np.flatnonzero(opens)
        run = np.cumsum(opens)[inside] - 1
        self.low = begin
        self.high = begin + np.bincount(run, minlength=len(begin)) - 1
        self.at = least[begin]
        self.doc = owners[begin]
        self.prefix = hashes[self.at]


def _list_suffixes(window: int, prefix: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, sizes = (batch.column(c).to_numpy() for c in ("_hash", "_len"))
            for row, data, offsets in slices(batch.column("_text")):
                s = Suffixes(data, offsets, window, prefix)
                yield pa.RecordBatch.from_pydict({
                    "prefix": pa.array(s.prefix.view(np.int64)), "_hash": pa.array(hashes[row + s.doc]),
                    "_len": pa.array(sizes[row + s.doc]), "at": pa.array((s.at - s.first[s.doc]).astype(np.int32)),
                })

    return run


def _kept(text: bytes, runs: np.ndarray | None) -> tuple[int, int, bytes]:
    """Words, words removed, and the kept words joined by spaces. ``runs``: (first, end) word numbers, disjoint."""
    words = text.split()
    if runs is None or not len(runs):
        return len(words), 0, b" ".join(words)
    keep = np.ones(len(words), bool)
    for a, b in runs:
        keep[a:b] = False
    return len(words), int((~keep).sum()), b" ".join([w for w, k in zip(words, keep.tolist()) if k])


def _settle(keep: list[str], with_text: bool):
    """Finish the texts without grouped suffixes; pass the others on whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, texts = [], [], []
            for text, listed in zip(batch.column("_text"), batch.column("listed").is_valid().to_pylist()):
                raw = (text.as_py() or "").encode()
                n, _, kept = _kept(raw, None)
                counts.append(n)
                digests.append(None if listed else hashlib.sha256(kept).hexdigest())
                texts.append(text.as_py() if listed else kept.decode() if with_text else None)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in (*keep, "_hash", "_len", "listed")), pa.array(counts, pa.int64()),
                 pa.array(digests, pa.string()), pa.array(texts, pa.string())],
                names=[*keep, "_hash", "_len", "listed", "n_words", "kept_sha256", "_text"],
            )

    return run


def _taken(batch: pa.RecordBatch, window: int, prefix: int, want_hot: bool):
    """The grouped suffixes of a batch, slice by slice: (first row, bytes, suffixes, which of them are wanted)."""
    lists = batch.column("listed")
    positions = lists.flatten().to_numpy()
    edges = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
    hot, at = (positions & 1) == 1, positions >> 1
    for row, data, offsets in slices(batch.column("_text")):
        s = Suffixes(data, offsets, window, prefix)
        lo, hi = edges[row], edges[row + len(offsets) - 1]
        rows = np.repeat(np.arange(len(offsets) - 1), np.diff(edges[row : row + len(offsets)]))
        wanted = (rows.astype(np.int64) << 32 | at[lo:hi])[hot[lo:hi] == want_hot]
        yield row, data, s, np.isin(s.doc.astype(np.int64) << 32 | (s.at - s.first[s.doc]), wanted)


def _joined_ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All integers of the ranges [low, high), one range after the other, and where each range begins."""
    sizes = high - low
    edges = np.concatenate([[0], np.cumsum(sizes)])
    return np.arange(edges[-1]) + np.repeat(low - edges[:-1], sizes), edges


def _strings(data: np.ndarray, low: np.ndarray, high: np.ndarray) -> pa.Array:
    """The texts of byte ranges, which may overlap."""
    at, edges = _joined_ranges(low, high)
    text = pa.py_buffer(data[at].tobytes())
    return pa.LargeStringArray.from_buffers(len(low), pa.py_buffer(edges.astype(np.int64).tobytes()), text)


def _pieces(window: int, prefix: int):
    """Write out the words of all windows that each grouped suffix stands for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, sizes = (batch.column(c).to_numpy() for c in ("_hash", "_len"))
            for row, data, s, wanted in _taken(batch, window, prefix, False):
                low, high, doc = s.low[wanted], s.high[wanted], s.doc[wanted]
                yield pa.RecordBatch.from_pydict({
                    "prefix": pa.array(s.prefix[wanted].view(np.int64)), "_hash": pa.array(hashes[row + doc]),
                    "_len": pa.array(sizes[row + doc]), "low": pa.array((low - s.first[doc]).astype(np.int32)),
                    "words": _strings(data, s.starts[low], s.ends[high + window - 1]).cast(pa.string()),
                })

    return run


def _whole_windows(window: int, prefix: int):
    """Windows of prefixes with too many suffixes, under two independent hashes of all their words."""
    weights = [np.array([pow(base, j, 1 << 64) for j in range(window)], np.uint64) for base in (0xD1342543DE82EF95, 0xAF251AF3B0F025B5)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, sizes = (batch.column(c).to_numpy() for c in ("_hash", "_len"))
            for row, _, s, wanted in _taken(batch, window, prefix, True):
                low, high, doc = s.low[wanted], s.high[wanted] + 1, s.doc[wanted]
                start, _ = _joined_ranges(low, high)
                own = np.repeat(doc, high - low)
                for cut in range(0, len(start), 50_000):
                    begin, mine = start[cut : cut + 50_000], own[cut : cut + 50_000]
                    words = s.words[begin[:, None] + np.arange(window)]
                    names = [mix((w + np.uint64(i)) * weights[i]).sum(axis=1, dtype=np.uint64) for i, w in enumerate((words, words))]
                    yield pa.RecordBatch.from_pydict({
                        "one": pa.array(mix(names[0]).view(np.int64)), "two": pa.array(mix(names[1]).view(np.int64)),
                        "_hash": pa.array(hashes[row + mine]), "_len": pa.array(sizes[row + mine]),
                        "low": pa.array((begin - s.first[mine]).astype(np.int32)),
                    })

    return run


def deep_nodes(words: pa.Array, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Which windows of some pieces have an equal one among them: a flag per window, piece after piece, and the number of
    windows of each piece."""
    (_, data, offsets), = slices(words, 1 << 62)
    starts, ends, first = spans(data, offsets)
    name = _strings(data, starts, ends).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    depth = 1
    while depth < window and len(name):
        step = min(depth, window - depth)
        # names are numbered from 0, so a pair of them is one number
        name = pd.factorize(name[:-step] * (name.max() + 1) + name[step:])[0].astype(np.int64)
        depth += step
    windows = np.maximum(np.diff(first) - window + 1, 0)
    at, _ = _joined_ranges(first[:-1], first[:-1] + windows)
    found = name[at]
    return np.bincount(found, minlength=1)[found] > 1 if len(found) else np.zeros(0, bool), windows


def _subtrees(window: int, flush_rows: int):
    """Repeats among the pieces of each prefix. Rows come sorted by prefix; whole groups are taken together."""

    def solved(rows: pa.Table) -> pa.RecordBatch:
        flags, windows = deep_nodes(rows.column("words").combine_chunks(), window)
        piece = np.repeat(np.arange(len(windows)), windows)
        inner = np.arange(len(flags)) - np.repeat(np.cumsum(windows) - windows, windows)
        mask = np.zeros(len(windows), np.int64)
        np.bitwise_or.at(mask, piece[flags], np.int64(1) << inner[flags])
        some = pa.array(np.flatnonzero(mask))
        got = rows.select(["_hash", "_len", "low"]).take(some)
        return got.append_column("mask", pa.array(mask[some.to_numpy()])).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            held.append(batch)
            count += len(batch)
            if count >= flush_rows:
                rows = pa.Table.from_batches(held)
                prefixes = rows.column("prefix").to_numpy()
                whole = int(np.searchsorted(prefixes, prefixes[-1], side="left"))
                if whole:
                    yield from solved(rows.slice(0, whole))
                held = rows.slice(whole).to_batches()
                count = len(rows) - whole
        if count:
            yield from solved(pa.Table.from_batches(held))

    return run


def _finish(keep: list[str], with_text: bool, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("n_words", "n_removed", "kept_sha256", "spans", "kept_text")}
            for text, masks in zip(batch.column("_text"), batch.column("masks").to_pylist()):
                raw, hit = text.as_py().encode(), np.zeros(0, np.int64)
                if masks:
                    low, mask = np.array([m["low"] for m in masks], np.int64), np.array([m["mask"] for m in masks], np.int64)
                    hit = np.unique(np.concatenate([low[(mask >> b) & 1 == 1] + b for b in range(63)]))
                cuts = np.flatnonzero(np.diff(hit) > window) + 1  # windows that touch or overlap form one passage
                runs = [(int(g[0]), int(g[-1]) + window) for g in np.split(hit, cuts)] if len(hit) else []
                n, removed, kept = _kept(raw, runs)
                for name, value in zip(out, (n, removed, hashlib.sha256(kept).hexdigest(),
                                             [{"first": a, "last": b} for a, b in runs], kept.decode() if with_text else None)):
                    out[name].append(value)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])), pa.string())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), *(pa.array(v, k) for v, k in zip(out.values(), kinds))], names=[*keep, *out]
            )

    return run


def without_repeats(
    docs: DataFrame, text: str = "text", keep: list[str] | None = None, with_text: bool = True, window: int = WINDOW,
    prefix: int = PREFIX, group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Per document its columns ``keep`` (default: all but the text), n_words, n_removed, the SHA-256 of the kept words
    joined by spaces, the removed passages as word numbers (end exclusive), and with ``with_text`` the kept text."""
    if not prefix < window <= prefix + 62:
        raise ValueError("the prefix must be shorter than the window, by 62 words at most")
    keep, final_schema = extended(
        docs, [c for c in docs.columns if c != text] if keep is None else keep, "n_words long, n_removed long, kept_sha256 string, spans array<struct<first:long,last:long>>, kept_text string"
    )
    # the columns that pass are one struct inside, so that none clashes with a name used here
    row = T.StructType([T.StructField("row", T.StructType([docs.schema[c] for c in keep] or [T.StructField("_", T.StringType())]))])
    settled_schema = T.StructType([
        *row.fields, *T.StructType.fromDDL("_hash long, _len int, listed array<int>, n_words long, kept_sha256 string, _text string").fields
    ])
    final_schema = T.StructType([*row.fields, *final_schema.fields[len(keep):]])
    known = docs.select(
        whole_row(docs, keep) if keep else F.struct(F.lit("").alias("_")).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("_text"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_hash"),
        F.coalesce(F.octet_length(text), F.lit(0)).alias("_len"),
    )
    text_key = ["_hash", "_len"]
    listed = known.select("_text", *text_key).mapInArrow(
        _list_suffixes(window, prefix), "prefix long, _hash long, _len int, at int"
    )
    groups = written(listed.groupBy("prefix").count().filter("count > 1"), "repeats-prefixes")
    marked = listed.join(groups, "prefix").select(
        *text_key, (F.col("at") * 2 + (F.col("count") > group_rows).cast("int")).alias("listed")
    )
    per_text = marked.groupBy(*text_key).agg(F.collect_set("listed").alias("listed"))

    settled = written(known.join(per_text, text_key, "left").mapInArrow(_settle(["row"], with_text), settled_schema), "repeats-texts")
    done, open_texts = settled.filter("listed is null"), settled.filter("listed is not null")

    pieces = open_texts.select("listed", "_text", *text_key).mapInArrow(
        _pieces(window, prefix), "prefix long, _hash long, _len int, low int, words string"
    )
    parted = pieces.repartition("prefix").sortWithinPartitions("prefix")
    masks = parted.mapInArrow(_subtrees(window, FLUSH_ROWS), "_hash long, _len int, low int, mask long")
    crowded = open_texts.filter(F.exists("listed", lambda x: x % 2 == 1))
    whole = crowded.select("listed", "_text", *text_key).mapInArrow(
        _whole_windows(window, prefix), "one long, two long, _hash long, _len int, low int"
    )
    names = written(whole.groupBy("one", "two").count().filter("count > 1").select("one", "two"), "repeats-windows")
    single = whole.join(names, ["one", "two"]).select(*text_key, "low", F.lit(1).cast("long").alias("mask"))
    found = masks.unionByName(single).groupBy(*text_key).agg(F.collect_set(F.struct("low", "mask")).alias("masks"))

    cleaned = open_texts.select("row", "_text", *text_key).join(found, text_key, "left").mapInArrow(
        _finish(["row"], with_text, window), final_schema
    )
    untouched = done.select(
        "row", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256",
        F.expr("cast(array() as array<struct<first:bigint,last:bigint>>)").alias("spans"), F.col("_text").alias("kept_text"),
    )
    outputs = [f.name for f in final_schema.fields[1:] if with_text or f.name != "kept_text"]
    return untouched.unionByName(cleaned).select(*unpacked(keep), *outputs)
