"""Near duplicates by Order MinHash, verified by banded alignment.

Sketch: shingles are ``K`` words, labelled by how often they have occurred before in the text. For each of ``SKETCHES``
hash functions the ``TUPLE`` labelled shingles with the least values are kept in the order they have in the text. Two
texts agree in a sketch about as often as their shingles agree and come in the same order, which follows edit similarity.
At the least similarity few of those agree, so there are ``SINGLES`` sketches more, each the one least labelled shingle of
``SINGLE_K`` words: of those an edit spoils three at most, so that two texts of n words at similarity 0.8 share at least
0.4 n - 2 of them, wherever the edits stand. Texts of up to ``SHORT`` words can be a single edit away from each other at
most; those pairs are found exactly, by keys of the text with each word masked (a word replaced) and with each word left
out (a word added). Such a bucket needs one turn only: the shortest text is its leader, and all links run through it.

Candidates: texts that agree in a sketch share a bucket. A bucket may hold a third of all texts, so its members are not
paired with each other: each is compared with the bucket's leader, the least by a fixed hash. If some member fails,
the members (the leader is done) go to narrower buckets, by their next sketches as well, with new leaders, until no member
fails or each is alone. Members that passed with one leader are in one class already and are not compared again among
themselves, only with those that failed.

Before the texts of candidates travel, their word counts do: words are counted by hash in ``COUNTS`` classes, and the sum
of the lesser counts bounds the words that two texts share, and so their similarity, from above. Only pairs that cannot
reach the similarity are left out by that; no link is lost.

What the buckets lose: the classes found so far are completed by a prefix filter, which loses no pair. Of a text's labelled
shingles of ``PREFIX_K`` words an edit spoils ``PREFIX_K`` at most, so two texts at similarity 0.8 whose longer one has n words
share at least n - 1 - 2 * floor(0.2 n) of them. So if all texts list their shingles in one order, they share one among
about the first 0.4 n of each, and c among the first 0.4 n + c - 1; c is 1 + n / ``COMMON`` for the shorter one. The order
puts what is rare first, by counts in ``SLOTS`` classes; any order is exact, this one leaves few texts to a shingle. The lists
travel as blocks, by parts of the shingles' hashes, and with each shingle its place, the number of words and the class of its
text. So the task that finds the texts of a shingle also finds which of them may meet: texts of different classes and about the
same length, in which as many edits as there may be can bring the shingle to its other place. That holds for every shingle that
edits leave alone; one that a text holds again has no place, as it is not known which one is meant. Only pairs that pass
become rows, and those that do often enough are verified. The part and 32 bits more tell shingles apart; two of one name
only add pairs.

A passage that many texts hold, as most of their words, makes all of these meet. Shingles for which more than ``CROWD`` texts in
two meet, per text, are therefore no rows of pairs but sets: equal sets are one, those inside another one go, as they hold no further
pair, and the others are dealt into blocks.
A task holds two blocks of texts and counts what all their pairs share by products of matrices; only links leave the task.

Verification: edit similarity of the word sequences, 1 - distance / longer length, at least ``SIMILARITY``. Classes are the
connected components of the verified links, found by contracting them, from written tables.

Equal texts are one text throughout, known by (64-bit hash, bytes), so copies cost one row each. Texts of fewer than K
words have one shingle, themselves; null counts as empty, and texts without words are only equal to the very same text.
The class id is the least id of the class (null only if all are null); that row stays, of repeated rows the first.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewise.sources.shared import discarded, written

from .alignment import within
from .schemas import unpacked, whole_row
from .words import mix, owner, shingle_hashes, slices, spans, word_hashes

K = 5
SKETCHES = 24
TUPLE = 2
SINGLE_K = 3
SINGLES = 24
SHORT = 9
COUNTS = 256
PREFIX_K = 2
COMMON = 32
SLOTS = 1 << 24
SLOT_PARTS = 64
PARTS = 1 << 11  # of the shingles' hashes, at least
PART_WORDS = 1 << 19  # of the texts, for each part
CROWD = 64
WILD = 0xFFFF  # a place, or a number of words, that says nothing
MEETINGS = 1 << 19  # pairs looked at together
FEW = 1 << 14  # keys that go to a large table, instead of the table to them
BLOCK = 256  # texts
BLOCK_BYTES = 1 << 22
COLUMNS = 1 << 13
SKETCH_BYTES = 1 << 18  # of texts sketched at once, so that their shingles stay in the processor's cache
SIMILARITY = 0.8

_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


Words = tuple[np.ndarray, np.ndarray]


def _words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Hashes of the words, and the first word of each text."""
    starts, ends, first = spans(data, offsets)
    return word_hashes(data, starts, ends), first


def _labelled(data: np.ndarray, offsets: np.ndarray, k: int, known: Words | None = None) -> tuple[np.ndarray, ...]:
    """What ``labelled_shingles`` gives, and of each shingle whether its text may hold it again."""
    hashes, first = known or _words(data, offsets)
    words = np.diff(first)
    counts = np.where(words >= k, words - k + 1, np.minimum(words, 1))
    edges = np.concatenate([[0], np.cumsum(counts)])
    plain = np.zeros(edges[-1], np.uint64)
    at = np.arange(edges[-1]) - np.repeat(edges[:-1] - first[:-1], counts)
    long_enough = np.repeat(words >= k, counts)
    plain[long_enough] = shingle_hashes(hashes, k)[at[long_enough]] if long_enough.any() else 0
    for i in np.flatnonzero((words > 0) & (words < k)):
        plain[edges[i]] = shingle_hashes(hashes[first[i] : first[i + 1]], int(words[i]))[0]
    texts = owner(edges)
    # only what may occur twice in its text is put in order: equal shingles of a text have equal sums
    sums = plain + texts.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)
    order = np.argsort(sums)
    equal = sums[order][1:] == sums[order][:-1]
    twice = np.zeros(len(order), bool)
    twice[1:] = equal
    twice[:-1] |= equal
    some = order[twice]
    some = some[np.lexsort((some, plain[some], texts[some]))]
    same = np.zeros(len(some), bool)
    same[1:] = (plain[some][1:] == plain[some][:-1]) & (texts[some][1:] == texts[some][:-1])
    place = np.arange(len(some))
    run = np.maximum.accumulate(np.where(same, 0, place)) if len(some) else place
    occurrence = np.zeros(len(order), np.uint64)
    occurrence[some] = place - run
    again = np.zeros(len(order), bool)
    again[some] = True
    return plain, mix(plain + occurrence * np.uint64(0x9E3779B97F4A7C15)), edges, words, again


def labelled_shingles(data: np.ndarray, offsets: np.ndarray, k: int, known: Words | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each shingle, hash of it with its occurrence number, first shingle of each text, words of each text."""
    return _labelled(data, offsets, k, known)[:4]


def order_sketches(
    data: np.ndarray, offsets: np.ndarray, k: int = K, sketches: int = SKETCHES, tuple_size: int = TUPLE, known: Words | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Number of words and sketches of each text; texts without words have sketches of 0."""
    plain, labelled, edges, words = labelled_shingles(data, offsets, k, known)
    out = np.zeros((len(words), sketches), np.uint64)
    some = np.flatnonzero(np.diff(edges))
    if not len(some):
        return words, out
    first = edges[:-1][some]
    sizes = np.diff(edges)[some]
    own = np.repeat(np.arange(len(some)), sizes)
    # the least values of a text are nearly always below a limit that few of its values are below
    likely = np.minimum(1.0, (4 * tuple_size + 8) / sizes)
    limit = np.repeat(np.where(likely < 1, np.minimum(likely, 0.5) * 2.0**64, 0).astype(np.uint64) + _NONE * (likely >= 1), sizes)
    enough = np.minimum(sizes, tuple_size)
    for i in range(sketches):
        values = labelled ^ np.uint64((i + 1) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF)
        values *= np.uint64(0xBF58476D1CE4E5B9)
        values ^= values >> np.uint64(29)
        values *= np.uint64(0x94D049BB133111EB)
        few = np.flatnonzero(values < limit)
        found = np.bincount(own[few], minlength=len(some)) >= enough
        if not found.all():  # of the other texts, all values
            few = np.flatnonzero((values < limit) | ~np.repeat(found, sizes))
        least, texts = np.minimum(values[few], _NONE - np.uint64(1)), own[few]
        begins = np.flatnonzero(np.r_[True, texts[1:] != texts[:-1]])
        number = np.diff(np.r_[begins, len(texts)])
        chosen = np.full((len(some), tuple_size), np.iinfo(np.int64).max, np.int64)
        for j in range(tuple_size):
            hit = np.flatnonzero(least == np.repeat(np.minimum.reduceat(least, begins), number))
            hit = hit[least[hit] != _NONE]  # a text may have none left
            # one per text: labelled shingles differ, so equal values are a matter of hash collisions
            hit = hit[np.r_[True, texts[hit][1:] != texts[hit][:-1]][: len(hit)]]
            chosen[texts[hit], j] = few[hit]
            least[hit] = _NONE
        chosen.sort(axis=1)
        name = np.full(len(some), np.uint64(i + 1))
        for j in range(tuple_size):
            there = chosen[:, j] < len(plain)
            name = mix(name * np.uint64(0x9E3779B97F4A7C15) + np.where(there, plain[np.minimum(chosen[:, j], len(plain) - 1)], np.uint64(0)))
        out[some, i] = name
    return words, out


def single_sketches(data: np.ndarray, offsets: np.ndarray, k: int = SINGLE_K, sketches: int = SINGLES, known: Words | None = None) -> np.ndarray:
    """Sketches of one labelled shingle of each text; texts without words have sketches of 0."""
    _, labelled, edges, words = labelled_shingles(data, offsets, k, known)
    out = np.zeros((len(words), sketches), np.uint64)
    some = np.flatnonzero(np.diff(edges))
    if not len(some):
        return out
    first = edges[:-1][some]
    for i in range(sketches):
        values = (labelled ^ np.uint64((i + 1) * 0xA0761D6478BD642F & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xE7037ED1A0B428DB)
        values ^= values >> np.uint64(32)
        values *= np.uint64(0x8EBC6AF09C88C6E3)
        out[some, i] = mix(np.minimum.reduceat(values, first) + np.uint64((i + 1) * 0x589965CC75374CC3 & 0xFFFFFFFFFFFFFFFF))
    return out


def short_keys(data: np.ndarray, offsets: np.ndarray, short: int = SHORT, known: Words | None = None) -> list[np.ndarray]:
    """Keys that texts of up to ``short`` words share if one word is replaced, added or left out; none for longer texts."""
    hashes, first = known or _words(data, offsets)
    out = [np.zeros(0, np.uint64)] * (len(first) - 1)
    for i in np.flatnonzero((np.diff(first) >= 1) & (np.diff(first) <= short)):
        words = hashes[first[i] : first[i + 1]]
        n = len(words)
        keys = [mix(shingle_hashes(words, n) + np.uint64(1))]
        if n > 1:
            masked, left = np.tile(words, (n, 1)), np.tile(words, (n, 1))
            masked[np.arange(n), np.arange(n)] = 0
            left = left[~np.eye(n, dtype=bool)].reshape(n, n - 1)
            keys += [mix(shingle_hashes(w, n) + np.uint64(2)) for w in masked]
            keys += [mix(shingle_hashes(w, n - 1) + np.uint64(1)) for w in left]
        out[i] = np.unique(np.concatenate(keys))
    return out


def word_counts(data: np.ndarray, offsets: np.ndarray, classes: int = COUNTS, known: Words | None = None) -> np.ndarray:
    """How many words of each text fall into each class by their hash."""
    hashes, first = known or _words(data, offsets)
    place = owner(first) * classes + (hashes % np.uint64(classes)).astype(np.int64)
    counts = np.bincount(place, minlength=(len(first) - 1) * classes)
    return np.minimum(counts, 0xFFFF).astype("<u2").reshape(-1, classes)


def _sketch(k: int, sketches: int, tuple_size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, names, keys, counts = [], [], [], []
            for _, data, offsets in slices(batch.column("_text"), SKETCH_BYTES):
                known = _words(data, offsets)
                n, s = order_sketches(data, offsets, k, sketches, tuple_size, known)
                words.append(n)
                names.append(np.hstack([s, single_sketches(data, offsets, known=known)]))
                keys += short_keys(data, offsets, known=known)
                counts += [row.tobytes() for row in word_counts(data, offsets, known=known)]
            n = np.concatenate(words) if words else np.zeros(0, np.int64)
            flat = np.concatenate(names).view(np.int64).ravel() if names else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * (sketches + SINGLES), pa.int32()), pa.array(flat))
            ends = np.concatenate([[0], np.cumsum([len(x) for x in keys])])
            flat = np.concatenate([np.zeros(0, np.uint64), *keys]).view(np.int64)
            short = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("_id", "_hash", "_len")), pa.array(n.astype(np.int32)), lists, short, pa.array(counts, pa.binary())],
                names=["_id", "_hash", "_len", "n", "sketch", "short", "counts"],
            )

    return run


def _slots(plain: np.ndarray) -> np.ndarray:
    return (plain >> np.uint64(7)) % np.uint64(SLOTS)


def _slot_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many shingles fall into each slot, in parts, as narrow as their numbers allow and compressed."""
    counts = np.zeros(SLOTS, np.uint32)
    for batch in batches:
        for _, data, offsets in slices(batch.column("_text")):
            hashes, first = _words(data, offsets)
            plain = shingle_hashes(hashes, PREFIX_K)
            # not those that reach into the next text
            last = first[1:-1, None] - np.arange(1, PREFIX_K)
            inside = np.ones(len(plain), bool)
            inside[last[(last >= 0) & (last < len(plain))]] = False
            np.add.at(counts, _slots(plain[inside]), 1)
    for part, some in enumerate(counts.reshape(SLOT_PARTS, -1)):
        if some.any():
            packed = zlib.compress(some.astype(np.min_scalar_type(some.max())).tobytes(), 1)
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "counts": pa.array([packed], pa.binary())})


def _added_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the parts, as steps of an eighth of a power of two."""
    part, total = None, None

    def done() -> pa.RecordBatch:
        steps = np.minimum(8 * np.log2(1.0 + total), 255).astype(np.uint8)
        return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "steps": pa.array([steps.tobytes()], pa.binary())})

    for batch in batches:
        for i in range(batch.num_rows):
            at, some = batch.column("part")[i].as_py(), zlib.decompress(batch.column("counts")[i].as_py())
            some = np.frombuffer(some, f"u{len(some) * SLOT_PARTS // SLOTS}")
            if at != part:
                if part is not None:
                    yield done()
                part, total = at, np.zeros(SLOTS // SLOT_PARTS, np.int64)
            total = total + some
    if part is not None:
        yield done()


def frequencies(texts: DataFrame) -> np.ndarray:
    """About how often the shingles of each slot occur; 16 MB, whatever the input."""
    counted = texts.select("_text").mapInArrow(_slot_counts, "part int, counts binary")
    added = counted.repartition(SLOT_PARTS, "part").sortWithinPartitions("part").mapInArrow(_added_counts, "part int, steps binary")
    added = written(added, "near-steps")
    out = np.zeros((SLOT_PARTS, SLOTS // SLOT_PARTS), np.uint8)
    for row in added.collect():
        out[row["part"]] = np.frombuffer(row["steps"], np.uint8)
    discarded(added)
    return out.ravel()


def commons(n: int, similarity: float) -> int:
    """How many listed shingles a text of n words shares with every longer text that it is similar to. Never falls with n."""
    return max(1, min(1 + n // COMMON, int(np.floor((1 - PREFIX_K * (1 - similarity)) * n)) - PREFIX_K + 1))


def prefix_size(n: int, similarity: float) -> int:
    """How many of its shingles a text of n words must list to share ``commons`` with every text that it is similar to."""
    longer = np.arange(n, int(np.floor(n / similarity + 1e-9)) + 1)
    shared = longer - PREFIX_K + 1 - PREFIX_K * np.floor((1 - similarity) * longer + 1e-9)
    return int(n - PREFIX_K + 1 - max(1, shared.min()) + commons(n, similarity))


def _prefixes(data: np.ndarray, offsets: np.ndarray, steps: np.ndarray, similarity: float) -> tuple[np.ndarray, ...]:
    """The labelled shingles that each text lists, of each of them the text and its place there, and the words of each text."""
    plain, labelled, edges, words, again = _labelled(data, offsets, PREFIX_K)
    texts = owner(edges)
    # by step and 56 bits of the hash, then by text
    step = steps[_slots(plain)].astype(np.uint64)
    order = np.argsort((step << np.uint64(56)) | (labelled >> np.uint64(8)))
    order = order[np.argsort(texts[order].astype(np.uint16 if len(words) < 1 << 16 else np.int64), kind="stable")]
    sizes = {n: prefix_size(n, similarity) if n >= PREFIX_K else 0 for n in np.unique(words).tolist()}
    listed = np.array([sizes[n] for n in words.tolist()], np.int64)
    chosen = order[np.arange(len(order)) - edges[:-1][texts] < listed[texts]]
    places = np.where(again[chosen], WILD, np.minimum(chosen - edges[:-1][texts[chosen]], WILD))
    return labelled[chosen], texts[chosen], places, words


def prefixes(data: np.ndarray, offsets: np.ndarray, steps: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """The labelled shingles that each text lists, and the text of each of them."""
    return _prefixes(data, offsets, steps, similarity)[:2]


def _listed(similarity: float, steps: np.ndarray, bits: int):
    """The listed shingles in blocks: of up to 65,536 texts with consecutive numbers those of one part, with their texts, places
    and numbers of words. Last come those of texts whose class has another number than the text (``root``), with that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column("node").to_numpy()
            roots = batch.column("root").to_numpy() if "root" in batch.schema.names else nodes
            found = [(row, *_prefixes(data, offsets, steps, similarity)) for row, data, offsets in slices(batch.column("_text"), SKETCH_BYTES)]
            if not found:
                continue
            shingles, texts, places, words = (np.concatenate(x) for x in zip(*((s, row + t, p, w) for row, s, t, p, w in found)))
            words = np.minimum(words, WILD)
            begins = np.flatnonzero(np.r_[True, np.diff(nodes) != 1])
            begins = np.concatenate([np.arange(i, j, 1 << 16) for i, j in zip(begins, [*begins[1:], len(nodes)])])
            for i, (lo, hi) in zip(begins, zip(*(lambda e: (e[:-1], e[1:]))(np.searchsorted(texts, [*begins, len(nodes)])))):
                part = (shingles[lo:hi] >> np.uint64(64 - bits)).astype(np.int64)
                other = (nodes != roots)[texts[lo:hi]]
                order = np.lexsort((other, part))
                there, at = np.unique(part[order], return_index=True)
                cut = [(order[x:y] + lo) for x, y in zip(at, [*at[1:], len(order)])]
                packed = lambda values, kind: pa.array([values(c).astype(kind).tobytes() for c in cut], pa.binary())
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array(there, pa.int32()), "first": pa.array(np.full(len(there), nodes[i], np.int64)),
                    "texts": packed(lambda c: texts[c] - i, "<u2"), "shingles": packed(lambda c: shingles[c] & np.uint64(0xFFFFFFFF), "<u4"),
                    "places": packed(lambda c: places[c], "<u2"), "words": packed(lambda c: words[texts[c]], "<u2"),
                    "roots": packed(lambda c: roots[texts[c[other[c - lo]]]], "<i8"),
                })

    return run


LISTED = "part int, first long, texts binary, shingles binary, places binary, words binary, roots binary"


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Of each part the shingles that texts of several classes list: the first row of each, and the rows' texts, numbers of words,
    classes and places."""
    part, found = None, []

    def done() -> tuple[np.ndarray, ...]:
        s, *rows = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(s)
        s, root = s[order], rows[2][order]
        begins = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        sizes = np.diff(np.r_[begins, len(s)])
        several = np.minimum.reduceat(root, begins) < np.maximum.reduceat(root, begins)
        order = order[np.repeat(several, sizes)]
        sizes = sizes[several]
        return np.cumsum(sizes) - sizes, *(x[order] for x in rows)

    for batch in batches:
        for p, first, *packed in zip(*(batch.column(c).to_pylist() for c in ("part", "first", "texts", "shingles", "places", "words", "roots"))):
            if p != part and found:
                yield done()
                found = []
            part = p
            texts, shingles, places, words, roots = (np.frombuffer(x, kind) for x, kind in zip(packed, ("<u2", "<u4", "<u2", "<u2", "<i8")))
            nodes = texts.astype(np.int64) + first
            found.append((shingles, nodes, words.astype(np.int64), np.r_[nodes[: len(nodes) - len(roots)], roots], places.astype(np.int64)))
    if found:
        yield done()


def _as_sets(begins: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Name and text of each row of the sets that begin there, and the weight of its set: how many of the sets are equal. A set is
    known by a hash of its texts."""
    sizes = np.diff(np.r_[begins, len(node)])
    names = np.add.reduceat(mix(node.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)), begins) if len(begins) else np.zeros(0, np.uint64)
    names = mix(names + sizes.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    names, first, weights = np.unique(names, return_index=True, return_counts=True)
    begins, sizes = begins[first], sizes[first]
    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes - begins, sizes)
    return np.repeat(names, sizes).view(np.int64), node[at], np.repeat(weights, sizes)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets of texts of several classes that list the same shingles, part by part."""
    for begins, node, *_ in _parts(batches):
        names, node, weights = _as_sets(begins, node)
        yield pa.RecordBatch.from_pydict({"set": pa.array(names), "node": pa.array(node), "weight": pa.array(weights)})


MET = "set long, a long, b long, need int"


def _meetings(similarity: float, crowd: int):
    """A row (a, b) for each shingle by which two texts meet, with how many such rows they need; for crowds rows (set, a)."""

    def table(name: np.ndarray | None, a: np.ndarray, b: np.ndarray | None, need: np.ndarray | None) -> pa.RecordBatch:
        columns = [pa.nulls(len(a), kind) if x is None else pa.array(x, kind) for x, kind in ((name, pa.int64()), (a, pa.int64()), (b, pa.int64()), (need, pa.int32()))]
        return pa.RecordBatch.from_arrays(columns, names=["set", "a", "b", "need"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for begins, node, n, root, place in _parts(batches):
            sizes = np.diff(np.r_[begins, len(node)])
            of = np.repeat(np.arange(len(begins)), sizes)
            order = np.lexsort((n, of))
            node, n, root, place = (x[order] for x in (node, n, root, place))
            # a row meets rows behind it: those of its shingle that are not too long
            reach = np.minimum(np.floor(n / similarity + 1e-9), WILD).astype(np.int64)
            ends = np.searchsorted(of * (WILD + 1) + n, of * (WILD + 1) + reach, side="right")
            upto = np.r_[0, np.cumsum(ends - np.arange(len(of)) - 1)]
            known, which = np.unique(n, return_inverse=True)
            need = np.array([commons(x, similarity) for x in known.tolist()], np.int64)[which]
            met, waiting, lo = np.zeros(len(begins), np.int64), np.zeros((2, 0), np.int64), 0
            while lo < len(of):
                hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + MEETINGS, side="right")) - 1)
                more = np.diff(upto[lo : hi + 1])
                a = np.repeat(np.arange(lo, hi), more)
                b = np.arange(len(a)) - np.repeat(upto[lo:hi] - upto[lo], more) + a + 1
                good = root[a] != root[b]
                a, b = a[good], b[good]
                apart = np.abs(place[a] - place[b]) + np.abs(n[a] - place[a] - n[b] + place[b])
                good = (apart <= np.floor((1 - similarity) * n[b] + 1e-9)) | (place[a] == WILD) | (place[b] == WILD) | (n[b] == WILD)
                a, b = a[good], b[good]
                met += np.bincount(of[a], minlength=len(begins))
                crowded = met > crowd / 2 * sizes
                lo = hi
                if lo < len(of) and crowded[of[lo]]:
                    lo = begins[of[lo]] + sizes[of[lo]]
                waiting = np.hstack([waiting, [a, b]])
                waiting = waiting[:, ~crowded[of[waiting[0]]]]
                # the meetings of a shingle are rows when all are known
                whole = of[waiting[0]] < (of[lo] if lo < len(of) else len(begins))
                (a, b), waiting = waiting[:, whole], waiting[:, ~whole]
                if len(a):
                    yield table(None, np.minimum(node[a], node[b]), np.maximum(node[a], node[b]), need[a])
            crowded = met > crowd / 2 * sizes
            if crowded.any():
                few = sizes[crowded]
                names, texts, _ = _as_sets(np.cumsum(few) - few, node[crowded[of]])
                yield table(names, texts, None, None)

    return run


def _possible(similarity: float):
    """Pairs that may reach the similarity by their word counts. A count that does not fit (over 65,534) decides nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, COUNTS) for c in ("a_counts", "b_counts"))
            shared = np.minimum(a, b).sum(axis=1, dtype=np.int64)
            longer = np.maximum(*(batch.column(c).to_numpy() for c in ("a_n", "b_n"))).astype(np.int64)
            most = np.floor((1 - similarity) * longer + 1e-9)
            good = (longer - shared <= most) | (np.maximum(a, b).max(axis=1, initial=0) == 0xFFFF)
            yield batch.select(["a_hash", "a_len", "b_hash", "b_len"]).filter(pa.array(good))

    return run


def _common(a: np.ndarray, a_texts: np.ndarray, b: np.ndarray, b_texts: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """How many elements each text of one side shares with each of the other; the elements of a text differ."""
    both = np.intersect1d(a, b)
    out = np.zeros(shape, np.float32)
    sides = []
    for elements, texts in ((a, a_texts), (b, b_texts)):
        at = np.minimum(np.searchsorted(both, elements), max(0, len(both) - 1))
        there = both[at] == elements if len(both) else np.zeros(len(elements), bool)
        order = np.argsort(at[there], kind="stable")
        sides.append((at[there][order], texts[there][order]))
    for first in range(0, len(both), COLUMNS):
        parts = []
        for (at, texts), size in zip(sides, shape):
            lo, hi = np.searchsorted(at, [first, first + COLUMNS])
            part = np.zeros((size, COLUMNS), np.float32)
            part[texts[lo:hi], at[lo:hi] - first] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    return out


def _crowd_links(similarity: float):
    """Of pairs of blocks the links between texts of different classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                sides = [batch.column(c)[row].values for c in ("a_texts", "b_texts")]
                (n, node, root), (m, other, of) = ([x.field(c).to_numpy() for c in ("n", "node", "root")] for x in sides)
                good = (root[:, None] != of) & (np.minimum(n[:, None], m) >= similarity * np.maximum(n[:, None], m) - 1e-9)
                if batch.column("strip")[row].as_py() == batch.column("other")[row].as_py():
                    good &= node[:, None] < other
                some, with_some = np.flatnonzero(good.any(axis=1)), np.flatnonzero(good.any(axis=0))
                good = good[some][:, with_some]
                if not len(some):
                    continue
                sides = [x.take(pa.array(at)) for x, at in zip(sides, (some, with_some))]
                words = []
                for x in sides:
                    found = [(data, offsets) for _, data, offsets in slices(x.field("_text"))]
                    found = [_words(data, offsets) for data, offsets in found]
                    counts = np.concatenate([np.diff(first) for _, first in found])
                    words.append((np.concatenate([hashes for hashes, _ in found]), np.concatenate([[0], np.cumsum(counts)])))
                longer = np.maximum(n[some][:, None], m[with_some]).astype(np.int64)
                most = np.floor((1 - similarity) * longer + 1e-9).astype(np.int64)
                for k in (1, 2, 3):  # an edit spoils k runs of k words at most
                    (_, a, a_edges, _), (_, b, b_edges, _) = (labelled_shingles(None, None, k, known) for known in words)
                    shared = _common(a, owner(a_edges), b, owner(b_edges), good.shape)
                    good &= (longer - k + 1 - shared <= k * most) | (longer - k + 1 <= k * most)
                    if not good.any():
                        break
                i, j = np.nonzero(good)
                if not len(i):
                    continue
                _, numbers = np.unique(np.concatenate([hashes for hashes, _ in words]), return_inverse=True)
                a, b = (np.split(x.astype(np.int32), edges[1:-1]) for x, (_, edges) in zip(np.split(numbers, [len(words[0][0])]), words))
                linked = within([(a[x], b[y]) for x, y in zip(i, j)], similarity)
                ends = [sides[0].take(pa.array(i[linked])), sides[1].take(pa.array(j[linked]))]
                yield pa.RecordBatch.from_arrays([x.field(c) for x in ends for c in TEXT_KEY], names=PAIR)

    return run


def _verify(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, edges = [], [np.zeros(1, np.int64)]
            for c in ("a_text", "b_text"):
                for _, data, offsets in slices(batch.column(c)):
                    starts, ends, first = spans(data, offsets)
                    hashes.append(word_hashes(data, starts, ends))
                    edges.append(first[1:] + edges[-1][-1])
            # a word is its 64-bit hash, here by its number in the batch
            _, numbers = np.unique(np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), return_inverse=True)
            texts = np.split(numbers.astype(np.int32), np.concatenate(edges)[1:-1])
            good = within(list(zip(texts[: batch.num_rows], texts[batch.num_rows :])), similarity) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("a_hash", "a_len", "b_hash", "b_len")), pa.array(good, pa.bool_())],
                names=["a_hash", "a_len", "b_hash", "b_len", "near"],
            )

    return run


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Id, text and what the text is known by."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(key).alias("_id"), whole.alias("_text"), F.xxhash64(whole).alias("_hash"), F.octet_length(whole).alias("_len")
    )


def _node(prefix: str = "_") -> Column:
    return F.concat_ws(":", F.col(f"{prefix}hash"), F.col(f"{prefix}len"))


WORD = r"[^ \t\n\x0B\f\r]"
TEXT_KEY = ["_hash", "_len"]
PAIR = ["a_hash", "a_len", "b_hash", "b_len"]


def _close(similarity: float) -> Column:
    return F.least("a_n", "b_n") >= similarity * F.greatest("a_n", "b_n") - 1e-9


def _wanted(table: DataFrame, pairs: DataFrame) -> list[DataFrame]:
    """The table for the first and for the second texts of written pairs. To few pairs not all of a large table is sent."""
    if pairs.count() > FEW:
        return [table, table]
    return [table.join(F.broadcast(pairs.select(f"{x}_hash", f"{x}_len").distinct().toDF(*TEXT_KEY)), TEXT_KEY, "left_semi") for x in ("a", "b")]


def _possible_pairs(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Those of different pairs (with a_n and b_n) that may be near by their word counts."""
    for side, there in zip(("a", "b"), _wanted(nodes.select(*TEXT_KEY, "counts"), pairs)):
        there = there.toDF(f"{side}_hash", f"{side}_len", f"{side}_counts")
        pairs = pairs.join(there, [f"{side}_hash", f"{side}_len"])
    return pairs.mapInArrow(_possible(similarity), "a_hash long, a_len int, b_hash long, b_len int")


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs, and whether they are near."""
    for side, there in zip(("a", "b"), _wanted(texts.select(*TEXT_KEY, "_text"), pairs)):
        there = there.toDF(f"{side}_hash", f"{side}_len", f"{side}_text")
        pairs = pairs.join(there, [f"{side}_hash", f"{side}_len"])
    return pairs.mapInArrow(_verify(similarity), "a_hash long, a_len int, b_hash long, b_len int, near boolean")


def _links(known: DataFrame, rows: DataFrame, similarity: float, sketches: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Verified links between different texts that share a bucket (a_hash, a_len, b_hash, b_len), and of each text with words its
    counts, and the text itself with a number."""
    text_key = TEXT_KEY
    nodes = rows.filter("n > 0").groupBy(*text_key).agg(
        F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("short").alias("short"), F.first("counts").alias("counts")
    )
    nodes = written(nodes, "near-nodes")
    discarded(rows)
    every = sketches + SINGLES  # bands from there on are keys of short texts
    spread = nodes.select(*text_key, F.posexplode(F.concat("sketch", "short")).alias("band", "bucket"))
    node = F.xxhash64(*text_key)
    shared = spread.groupBy("bucket").agg(F.min(node).alias("lo"), F.max(node).alias("hi")).filter("lo < hi").select("bucket")
    shared = written(shared, "near-shared")
    # ``root``: what is known of the class inside a bucket; members of one root need not be compared
    entries = spread.join(shared, "bucket").join(nodes.select(*text_key, "n"), text_key).withColumn("root", node)
    entries = written(entries.select(*text_key, "n", "root", "band", "bucket"), "near-entries-0")
    # copies go before the texts travel, and they travel once
    texts = known.filter(F.col("_text").rlike(WORD)).groupBy(*text_key).agg(F.first("_text").alias("_text"))
    texts = written(texts.withColumn("node", F.monotonically_increasing_id()), "near-texts")
    passed, turn, used = [], 0, 0
    while True:
        shortest = F.when(F.col("band") >= every, F.col("n")).otherwise(0).alias("s")
        leader = F.min(F.struct(shortest, F.xxhash64("_hash").alias("o"), "_hash", "_len", "n", "root")).alias("l")
        leaders = entries.groupBy("bucket").agg(leader, F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi")
        leaders = leaders.select("bucket", "l._hash", "l._len", "l.n", "l.root").toDF("bucket", "a_hash", "a_len", "a_n", "a_root")
        leaders = written(leaders, f"near-leaders-{turn}")
        members = entries.join(leaders, "bucket").filter("_hash <> a_hash or _len <> a_len")
        members = members.withColumnsRenamed({"_hash": "b_hash", "_len": "b_len", "n": "b_n", "root": "b_root"})
        members = written(members, f"near-members-{turn}")
        pairs = members.filter(_close(similarity) & (F.col("a_root") != F.col("b_root"))).select(*PAIR, "a_n", "b_n").distinct()
        asked = written(pairs, f"near-asked-{turn}")
        pairs = written(_possible_pairs(asked, nodes, similarity), f"near-pairs-{turn}")
        discarded(asked)
        checked = written(_verified(pairs, texts, similarity), f"near-checked-{turn}")
        passed.append(written(checked.filter("near").select(*PAIR), f"near-passed-{turn}"))
        near = F.coalesce("near", F.col("a_root") == F.col("b_root"))
        verdict = members.join(checked, PAIR, "left").withColumn("near", near)
        verdict = verdict.filter(F.col("band") < every)
        failing = verdict.groupBy("bucket").agg(F.min("near").alias("all_near")).filter("not all_near").select("bucket")
        failing = written(failing, f"near-failing-{turn}")
        if failing.isEmpty():
            links = written(_union(passed), "near-links")
            discarded(shared, entries, leaders, members, pairs, checked, failing, *passed)
            return links, nodes, texts
        root = F.when(F.col("near"), F.col("a_root")).otherwise(F.col("b_root")).alias("root")
        again = verdict.join(failing, "bucket").select(F.col("b_hash").alias("_hash"), F.col("b_len").alias("_len"), "band", "bucket", root)
        turn += 1
        more = max(1, turn - 1)  # sketches to narrow by: slowly at first
        onward = [F.element_at("sketch", (F.pmod(F.col("band") + used + i, F.lit(every)) + 1).cast("int")) for i in range(1, more + 1)]
        used += more
        narrowed = again.join(nodes, text_key).select(*text_key, "n", "root", "band", F.xxhash64("bucket", *onward).alias("bucket"))
        was, entries = entries, written(narrowed, f"near-entries-{turn}")
        discarded(was, leaders, members, pairs, checked, failing)


def _crowded(rooted: DataFrame, classed: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Verified links between texts of different classes that share one of these sets."""
    sizes = rooted.groupBy("set").agg(F.count("*").alias("size"), F.sum("_len").alias("bytes"))
    sizes = written(sizes, "near-sizes")
    rooted = rooted.drop("_len").join(sizes, "set")
    # a set that holds another one is among the sets of each of its texts, and so not above the least of their largest
    size = F.struct("size", "set")
    largest = written(rooted.groupBy("node").agg(F.max(size).alias("top")), "near-largest")
    around = rooted.join(largest, "node").groupBy("set").agg(F.min("top").alias("top"))
    around = around.select("set", F.col("top.set").alias("around")).filter("set <> around")
    inside = rooted.select("set", "node", "size").join(around, "set").join(rooted.select(F.col("set").alias("around"), "node"), ["around", "node"])
    inside = inside.groupBy("set", "size").count().filter("count = size").select("set")
    members = rooted.join(inside, "set", "left_anti").join(classed.select(*TEXT_KEY, "node"), "node")
    strips = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    members = members.withColumn("strips", strips).withColumn("strip", F.pmod(F.xxhash64("node"), "strips").cast("int"))
    members = members.join(texts.select(*TEXT_KEY, "_text"), TEXT_KEY)
    block = F.collect_list(F.struct("n", "node", "root", *TEXT_KEY, "_text"))
    blocks = written(members.groupBy("set", "strips", "strip").agg(block.alias("texts")), "near-blocks")
    a = blocks.select("set", "strip", F.explode(F.sequence("strip", F.col("strips") - 1)).alias("other"), F.col("texts").alias("a_texts"))
    met = a.join(blocks.select("set", F.col("strip").alias("other"), F.col("texts").alias("b_texts")), ["set", "other"])
    links = written(met.mapInArrow(_crowd_links(similarity), "a_hash long, a_len int, b_hash long, b_len int"), "near-crowded")
    discarded(sizes, largest, blocks)
    return links


def _across(labels: DataFrame, nodes: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """All verified links between different classes of ``labels`` (of texts that it does not name: their own), as links (a, b)
    between the classes."""
    classed = nodes.select(*TEXT_KEY, "n", _node().alias("_name")).join(labels.toDF("_name", "label"), "_name", "left")
    root = F.when(F.col("label").isNull(), F.col("node")).otherwise(F.xxhash64("label")).alias("root")
    placed = texts.join(classed, TEXT_KEY).select(*TEXT_KEY, "_text", "n", "node", F.coalesce("label", "_name").alias("class"), root)
    placed = written(placed, "near-placed")
    discarded(texts)
    classed = placed.drop("_text")
    parts = max(PARTS, (classed.agg(F.sum("n")).first()[0] or 0) // PART_WORDS)
    bits = int(parts - 1).bit_length()
    listed = placed.select("_text", "node", "root").mapInArrow(_listed(similarity, frequencies(placed), bits), LISTED)
    sets = listed.repartition("part").sortWithinPartitions("part").mapInArrow(_meetings(similarity, CROWD), MET)
    sets = written(sets, "near-sets")
    met = sets.filter("set is null").groupBy("a", "b").agg(F.count("*").alias("shared"), F.max("need").alias("need"))
    met = written(met.filter("shared >= need").select("a", "b"), "near-met")
    for side in ("a", "b"):
        met_side = classed.select(F.col("node").alias(side), *(F.col(c).alias(f"{side}{c if c in TEXT_KEY else '_' + c}") for c in (*TEXT_KEY, "n")))
        pairs = (met if side == "a" else pairs).join(met_side, side)
    asked = written(pairs.select(*PAIR, "a_n", "b_n"), "near-asked")
    pairs = written(_possible_pairs(asked, nodes, similarity), "near-pairs")
    checked = written(_verified(pairs, placed, similarity).filter("near").select(*PAIR), "near-checked")
    rooted = sets.filter("set is not null").select("set", F.col("a").alias("node")).distinct()
    rooted = written(rooted.join(classed.select("node", "n", "root", "_len"), "node"), "near-rooted")
    discarded(sets, met, asked, pairs)
    crowded = [] if rooted.isEmpty() else [_crowded(rooted, classed, placed, similarity)]
    links = _union([checked, *crowded])
    for side in ("a", "b"):
        links = links.join(classed.select(*TEXT_KEY, "class").toDF(f"{side}_hash", f"{side}_len", side), [f"{side}_hash", f"{side}_len"])
    links = written(links.select("a", "b").distinct(), "near-across")
    discarded(placed, rooted, checked, *crowded)
    return links


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (a, b): node and the least node of its component.

    Every node goes to the least of itself and its neighbours, and on to where that one went; links are then drawn between
    the nodes arrived at, and those inside one node drop out. So the links shrink from round to round until none is
    left. All tables are written, and no task gathers a component."""
    edges = links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).filter("a <> b").distinct()
    edges, labels, turn = written(edges, "component-links"), None, 0
    while True:
        up = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("up"))
        up = written(up.select("node", F.least("node", "up").alias("up")), f"component-up-{turn}")
        further = up.select(F.col("node").alias("up"), F.col("up").alias("label"))
        arrived = written(up.join(further, "up").select("node", "label"), f"component-arrived-{turn}")
        before, last = labels, edges
        if labels is None:
            labels = arrived
        else:
            moved = arrived.select(F.col("node").alias("label"), F.col("label").alias("_on"))
            labels = labels.join(moved, "label", "left").select("node", F.coalesce("_on", "label").alias("label"))
            labels = written(labels, f"component-labels-{turn}")
        for end in ("a", "b"):
            edges = edges.join(arrived.withColumnsRenamed({"node": end, "label": "_on"}), end).drop(end).withColumnRenamed("_on", end)
        edges = written(edges.filter("a <> b").distinct(), f"component-links-{turn}")
        turn += 1
        discarded(up, last, *([before, arrived] if before is not None else []))
        if edges.isEmpty():
            discarded(edges)
            return labels


def _classed(
    docs: DataFrame, key: str, text: str, similarity: float, k: int, sketches: int, tuple_size: int
) -> DataFrame:
    """_row, _id, _hash, _len and the class of every row."""
    known = _keyed(docs, key, text)
    kind = docs.schema[key].dataType.simpleString()
    sketched = known.mapInArrow(_sketch(k, sketches, tuple_size), f"_id {kind}, _hash long, _len int, n int, sketch array<long>, short array<long>, counts binary")
    rows = written(sketched.withColumn("_row", F.monotonically_increasing_id()), "near-rows")
    sketched, rows = rows, written(rows.select("_row", "_id", "_hash", "_len"), "near-keys")
    links, nodes, texts = _links(known, sketched, similarity, sketches)  # which deletes the sketches of the rows
    labels = components(links.select(_node("a_").alias("a"), _node("b_").alias("b")))
    across = _across(labels, nodes, texts, similarity)
    merged = components(across)
    named = rows.select("_row", "_id", "_hash", "_len", _node().alias("node"))
    placed = named.join(labels, "node", "left").withColumn("class", F.coalesce("label", "node"))
    placed = placed.join(merged.toDF("class", "_merged"), "class", "left").withColumn("class", F.coalesce("_merged", "class"))
    classed = written(placed.select("_row", "_id", "_hash", "_len", "class"), "near-classes")
    discarded(rows, links, nodes, texts, labels, across, merged)
    return classed


def _firsts(classed: DataFrame) -> DataFrame:
    first = F.min(F.struct(F.col("_id").isNull().alias("o"), "_id", "_row")).alias("first")
    found = classed.groupBy("class").agg(first, F.count("*").alias("size"), F.countDistinct("_hash", "_len").alias("texts"))
    return written(found.select("class", "size", "texts", F.col("first._id").alias("first_id"), F.col("first._row").alias("first_row")), "near-firsts")


def classes(
    docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, k: int = K,
    sketches: int = SKETCHES, tuple_size: int = TUPLE,
) -> DataFrame:
    """One row per document: key, class_id, class_size (documents), class_texts (different texts) and whether it stays."""
    classed = _classed(docs, key, text, similarity, k, sketches, tuple_size)
    joined = classed.join(_firsts(classed), "class")
    return joined.select(
        F.col("_id").alias(key), F.col("first_id").alias("class_id"), F.col("size").alias("class_size"),
        F.col("texts").alias("class_texts"), (F.col("_row") == F.col("first_row")).alias("kept"),
    )


def without_near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, k: int = K,
    sketches: int = SKETCHES, tuple_size: int = TUPLE,
) -> DataFrame:
    """One document of each class, with all its columns. Rows that repeat both id and text of that document are the same
    document and stay with it."""
    classed = _classed(docs, key, text, similarity, k, sketches, tuple_size)
    firsts = _firsts(classed)
    same = classed.select(F.col("class"), "_id", "_hash", "_len").join(firsts.filter("size > 1"), "class")
    winner = classed.select(F.col("_row").alias("first_row"), F.col("_hash").alias("w_hash"), F.col("_len").alias("w_len"))
    judged = same.join(winner, "first_row")
    lost = judged.filter(
        "not (_id <=> first_id and _hash = w_hash and _len = w_len)"
    ).select(F.col("_id").alias("l_id"), F.col("_hash").alias("l_hash"), F.col("_len").alias("l_len")).distinct()
    lost = written(lost, "near-lost")
    whole = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.select(whole_row(docs), F.xxhash64(whole).alias("_hash"), F.octet_length(whole).alias("_len"), F.col(key).alias("_id"))
    gone = [keyed["_hash"] == lost["l_hash"], keyed["_len"] == lost["l_len"], keyed["_id"].eqNullSafe(lost["l_id"])]
    # a merge join at every size: its large partitions can be split, and what is lost is never sent to every task
    return keyed.join(lost.hint("merge"), gone, "left_anti").select(*unpacked(docs.columns))
