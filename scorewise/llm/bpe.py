"""Byte-level BPE encoding and decoding by Spark's higher-order functions over the distinct words of blocks of documents.

Cutting: each task cuts its texts into words (the matches of the tokenizer's pattern) and collects blocks of whole documents
with ``BLOCK_WORDS`` chunks or a little more; a chunk is what stands between single spaces, mostly one word. A block holds
each distinct chunk once, as places of its words, each distinct word once, as an array of its bytes, and for every
occurrence the place of its chunk.

Encoding: a higher-order function folds merges over the byte array of each distinct word. The state is the array of ids
and the array of the ranks that its adjacent pairs would get; each step merges the leftmost pair of the lowest rank and looks
up its two new neighbours, until no pair has a rank. The ranks are a literal in the plan: a map from pairs of ids to the id
of their concatenation, laid out as one array of longs with two places a pair may stand in, since Spark searches a map
literal from end to end. A word that is a token itself but that the merges do not reach gets its id directly, as tokenizers
do; such words (most vocabularies have none) are found once by folding every token on the driver.

Decoding: the ids of a distinct word become the concatenation of their binary pieces, again from a literal.

Nothing is shuffled, and a lost task is redone from its input. Blocks bound the memory of a task, apart from a single text
that is longer than a block. The fold copies the state in each step, so a word of n bytes costs n * n: words of some thousand
bytes are no matter, a single word of 100,000 bytes without a break takes minutes.

Null texts count as empty; empty texts have no ids. Repeated rows are rows like any other; columns named like an output are
replaced by it. The vocabulary (a file of base64 words and ranks, to be read on the driver alone) and the pattern are
parameters; every single byte must have a rank, and ids must be below 2 ** 20. Nothing is trained.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .schemas import extended

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
BLOCK_WORDS = 3 << 20

_BITS = 20
_PLACE_BITS = 22  # a word has 4 MiB at most
_NO_RANK = 1 << (_PLACE_BITS + 2 * _BITS)
_HASHES = ((7919, 104729), (1299709, 15485863))


@dataclass(frozen=True)
class Ranks:
    """A vocabulary: the pieces by id, the first state of every byte before every byte (256: none), tokens that merging does
    not reach, and what adjacent ids merge to, as ``_slots`` lays it out."""

    pieces: tuple[bytes, ...]
    starts: tuple[int, ...]
    unreached: dict[bytes, int]
    table: tuple[int, ...]


def _slots(pairs: dict[tuple[int, int], int]) -> list[int]:
    """A table in which each pair stands in one of two places, told by two linear hashes; -1 where there is none. A pair
    stands in its second place only if its first one is taken."""
    size = 2 * len(pairs) + 64 | 1
    place = lambda e, k: (e[0] * _HASHES[k][0] + e[1] * _HASHES[k][1]) % size
    while True:
        slots: list[tuple[int, int, int] | None] = [None] * size
        for (a, b), rank in pairs.items():
            entry, k = (a, b, rank), 0
            for _ in range(500):
                at = place(entry, k)
                entry, slots[at] = slots[at], entry
                if entry is None:
                    break
                k = 1 if place(entry, 0) == at else 0  # whoever had the place goes to its other one
            else:
                break
        else:
            break
        size = size * 3 // 2 | 1
    moved = True
    while moved:
        moved = [at for at, e in enumerate(slots) if e and place(e, 0) != at and slots[place(e, 0)] is None]
        for at in moved:
            if slots[place(slots[at], 0)] is None:
                slots[place(slots[at], 0)], slots[at] = slots[at], None
    return [-1 if e is None else (e[0] << 2 * _BITS) + (e[1] << _BITS) + e[2] for e in slots]


@lru_cache(maxsize=4)
def ranks(vocabulary: str = VOCABULARY) -> Ranks:
    """Read a vocabulary file and derive the pair table from it."""
    with open(vocabulary, "rb") as file:
        rank_of = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, file)}
    missing = [i for i in range(256) if bytes([i]) not in rank_of]
    if missing or max(rank_of.values()) >= 1 << _BITS:
        raise ValueError(f"{vocabulary}: every byte needs a rank, and ranks must be below 2 ** {_BITS}; bytes without: {missing}")
    pairs = {}
    for word, rank in rank_of.items():
        for i in range(1, len(word)):
            left, right = rank_of.get(word[:i]), rank_of.get(word[i:])
            if left is not None and right is not None:
                pairs[left, right] = rank
    of_byte = [rank_of[bytes([i])] for i in range(256)]
    starts = [
        (pairs[a, b] << _PLACE_BITS + _BITS if (a, b) in pairs else _NO_RANK) + a for a in of_byte for b in (*of_byte, None)
    ]

    def merged(word: bytes) -> list[int]:
        ids = [of_byte[b] for b in word]
        while len(ids) > 1:
            found = [pairs.get(pair, _NO_RANK) for pair in zip(ids, ids[1:])]
            least = min(found)
            if least == _NO_RANK:
                break
            at = found.index(least)
            ids[at : at + 2] = [least]
        return ids

    pieces = [b""] * (max(rank_of.values()) + 1)
    for word, rank in rank_of.items():
        pieces[rank] = word
    unreached = {word: rank for word, rank in rank_of.items() if merged(word) != [rank]}
    return Ranks(tuple(pieces), tuple(starts), unreached, tuple(_slots(pairs)))


def _let(name: str, value: str, body: str) -> str:
    """SQL for ``body`` with a value that is computed once: the last step of a fold without steps."""
    return f"aggregate(array(), {value}, ({name}, _) -> {name}, {name} -> {body})"


def encode_words(words: str, vocabulary: Ranks) -> Column:
    """array<array<int>>, the bytes of words (an SQL expression), to array<array<int>>, their ids.

    A piece of a word is one long: the rank of merging it with the next piece, the place of its first byte, its id. So the
    least piece of the array is the leftmost one of the lowest rank."""
    high, id_bits, kept = _PLACE_BITS + _BITS, (1 << _BITS) - 1, (1 << _PLACE_BITS + _BITS) - 1

    def ranked(a: str, b: str) -> str:
        first, second = (f"tables.pairs[({a} * {x} + {b} * {y}) % {len(vocabulary.table)}]" for x, y in _HASHES)
        found = f"shiftright(entry, {_BITS}) = shiftleft({a}, {_BITS}) + {b}, shiftleft(entry & {id_bits}L, {high})"
        other = _let("entry", second, f"if({found}, {_NO_RANK}L)")
        return _let("entry", first, f"if(entry < 0, {_NO_RANK}L, if({found}, {other}))")

    grown = f"{ranked('fresh', f'ifnull(get(left, i + 1) & {id_bits}L, {len(vocabulary.pieces)}L)')} + (piece & {kept - id_bits}L) + fresh"
    before = f"{ranked(f'(piece & {id_bits}L)', 'fresh')} + (piece & {kept}L)"
    merged = _let("left", "filter(pieces, (piece, i) -> not (get(pieces, i - 1) <=> least))", f"""transform(left, (piece, i) ->
        if(piece = least, {grown}, if(get(left, i + 1) <=> least, {before}, piece)))""")
    merged = _let("fresh", f"shiftright(least, {high})", merged)
    step = _let("least", "array_min(pieces)", f"if(least >= {_NO_RANK}L, pieces, {merged})")
    first = f"tables.starts[letter * 257 + ifnull(get(letters, i + 1), 256)] + shiftleft(cast(i as bigint), {_BITS})"
    start = f"transform(letters, (letter, i) -> {first})"
    ids = f"transform(pieces, piece -> cast(piece & {id_bits}L as int))"
    folded = f"aggregate(letters, {start}, (pieces, _) -> {step}, pieces -> {ids})"
    if vocabulary.unreached:
        name = "array_join(transform(letters, letter -> lpad(hex(letter), 2, '0')), '')"
        folded = _let("direct", f"tables.unreached[{name}]", f"if(direct is not null, array(direct), {folded})")
    held = {"starts": vocabulary.starts, "pairs": vocabulary.table}
    held["unreached"] = {word.hex().upper(): rank for word, rank in vocabulary.unreached.items()}
    kind = ", ".join(f"{k}: {'map<string,int>' if k == 'unreached' else 'array<bigint>'}" for k in held)
    tables = f"from_json('{json.dumps(held)}', 'struct<{kind}>')"  # a literal once the optimizer has seen it
    return F.expr(_let("tables", tables, f"transform({words}, letters -> {folded})"))


def decode_words(ids: str, vocabulary: Ranks) -> Column:
    """array<array<int>>, ids (an SQL expression), to array<binary>, the concatenated pieces."""
    pieces = f"split('{' '.join(p.hex() for p in vocabulary.pieces)}', ' ')"
    joined = "unhex(array_join(transform(one, id -> get(pieces, id)), ''))"
    return F.expr(_let("pieces", pieces, f"transform({ids}, one -> {joined})"))


class _Places(dict):
    """The place of each distinct key, in the order of first occurrence."""

    def __missing__(self, key: str) -> int:
        place = self[key] = len(self)
        return place


def _lists(parts: Sequence[np.ndarray], kind: pa.DataType) -> pa.Array:
    edges = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    flat = np.concatenate(parts) if len(parts) else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(edges), pa.array(flat, kind))


def _one_list(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


class _Block:
    """Documents on their way into one block: their columns, the number of their chunks, and the chunks."""

    def __init__(self):
        self.rows: list[pa.RecordBatch] = []
        self.sizes: list[int] = []
        self.codes: list[np.ndarray] = []
        self.chunks, self.total = _Places(), 0

    def add(self, keys: list[str]):
        self.sizes.append(len(keys))
        self.codes.append(np.fromiter(map(self.chunks.__getitem__, keys), np.int32, len(keys)))
        self.total += len(keys)

    def batch(self, fields: list[str], cut: Callable[[str], list[str]], schema: pa.Schema) -> pa.RecordBatch:
        held = pa.Table.from_batches(self.rows).combine_chunks()
        columns = [held.column(c).chunk(0) if held.num_rows else pa.array([], held.schema.field(c).type) for c in fields]
        passed = pa.StructArray.from_arrays(columns, fields=[held.schema.field(c) for c in fields])
        words = _Places()
        chunks = [[words[w] for w in cut(key[1:] if key.startswith(" ") else " " + key)] for key in self.chunks]
        letters = pa.array(list(words), pa.string())
        _, offsets, data = letters.buffers()
        offsets = np.frombuffer(offsets, np.int32)[: len(letters) + 1] if len(letters) else np.zeros(1, np.int32)
        data = np.frombuffer(data, np.uint8)[: offsets[-1]] if len(letters) else np.zeros(0, np.uint8)
        parts = [
            passed, pa.array(self.sizes, pa.int32()), pa.array(np.concatenate(self.codes), pa.int32()),
            pa.array(chunks, pa.list_(pa.int32())), pa.ListArray.from_arrays(pa.array(offsets), pa.array(data.astype(np.int32))),
        ]
        return pa.RecordBatch.from_arrays([_one_list(p) for p in parts], schema=schema)


def _cut(text: str, fields: list[str], pattern: str, block_words: int, schema: pa.Schema):
    """Documents to blocks. No word goes on over a single space between two other characters, or begins before one and ends
    behind it; there texts are cut into chunks, and the pattern sees every distinct chunk of a block once. A chunk is kept
    as the key without that space; a text with other spaces is cut whole, and its words are keys behind a space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, odd = regex.compile(pattern).findall, regex.compile(r"^ | $|\s | \s").search
        chunked = pattern == PATTERN  # known to hold for this pattern only
        block = _Block()
        for batch in batches:
            column, begun, some = batch.column(text), 0, batch.select(fields)
            for i in range(batch.num_rows):
                whole = column[i].as_py() or ""
                if not whole:
                    keys = []
                elif chunked and not odd(whole):
                    keys = whole.split(" ")
                    keys[0] = " " + keys[0]
                else:
                    keys = [" " + word for word in cut(whole)]
                block.add(keys)
                if block.total >= block_words:
                    block.rows.append(some.slice(begun, i + 1 - begun))
                    yield block.batch(fields, cut, schema)
                    block, begun = _Block(), i + 1
            block.rows.append(some.slice(begun))
        if block.sizes:
            yield block.batch(fields, cut, schema)

    return run


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _blocks(docs: DataFrame, text: str, fields: list[str], vocabulary: Ranks, pattern: str, block_words: int) -> DataFrame:
    """Blocks of documents: the documents' columns, chunks per document, places of their chunks, of each distinct chunk the places
    of its words, and of each distinct word its ids and its bytes after decoding."""
    passed = T.StructType([docs.schema[c] for c in fields])
    schema = T.StructType([
        T.StructField("docs", T.ArrayType(passed)), T.StructField("sizes", T.ArrayType(T.IntegerType())),
        T.StructField("codes", T.ArrayType(T.IntegerType())), T.StructField("chunks", T.ArrayType(T.ArrayType(T.IntegerType()))),
        T.StructField("words", T.ArrayType(T.ArrayType(T.IntegerType()))),
    ])
    # the text once, under a name of its own only if it does not pass
    read = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*fields, text])])
    cut = read.mapInArrow(_cut(text, fields, pattern, block_words, _arrow_schema(schema)), schema)
    ids = cut.select("docs", "sizes", "codes", "chunks", encode_words("words", vocabulary).alias("ids"))
    return ids.withColumn("decoded", decode_words("ids", vocabulary))


def _joined(words: pa.Array, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of lists of places in a list array (of integers or bytes), and where each list's values begin."""
    taken = words.take(chunks.values)
    if pa.types.is_list(taken.type):
        at, values = taken.offsets.to_numpy().astype(np.int64), taken.values.to_numpy(zero_copy_only=False).astype("<u4")
    else:
        _, at, data = taken.cast(pa.large_binary()).buffers()
        at = np.frombuffer(at, np.int64)[: len(taken) + 1] if len(taken) else np.zeros(1, np.int64)
        values = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return values, at[chunks.offsets.to_numpy()]


def _gathered(values: np.ndarray, at: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of the chunks ``codes`` one after the other, and where each chunk begins."""
    sizes = np.diff(at)[codes]
    edges = np.concatenate([[0], np.cumsum(sizes)])
    places = np.arange(edges[-1]) + np.repeat(at[:-1][codes] - edges[:-1], sizes)
    return values[places], edges


def _assemble(fields: list[str], whole: bool, schema: pa.Schema, most: int = 1 << 18):
    """Blocks back to documents, ``most`` chunks or a little more at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                docs, sizes, codes, chunks, ids, decoded = (
                    batch.column(c)[k].values for c in ("docs", "sizes", "codes", "chunks", "ids", "decoded")
                )
                # a list value may be a slice of a longer column; compact ones have offsets that begin at 0
                chunks, ids, decoded = (pa.concat_arrays([x]) if not x.offset else x.take(pa.array(range(len(x)))) for x in (chunks, ids, decoded))
                codes = codes.to_numpy(zero_copy_only=False)
                edges = np.concatenate([[0], np.cumsum(sizes.to_numpy(zero_copy_only=False))]).astype(np.int64)
                tokens, pieces = _joined(ids, chunks), _joined(decoded, chunks)
                a = 0
                while a < len(docs):
                    z = min(max(a + 1, int(np.searchsorted(edges, edges[a] + most, side="right")) - 1), len(docs))
                    here, at = codes[edges[a] : edges[z]], edges[a : z + 1] - edges[a]
                    (numbers, n_at), (data, d_at) = _gathered(*tokens, here), _gathered(*pieces, here)
                    bounds = n_at[at]
                    spans = list(zip(bounds[:-1], bounds[1:]))
                    bytes_of = [data[s:e].tobytes() for s, e in zip(d_at[at][:-1], d_at[at][1:])]
                    some = docs.slice(a, z - a)
                    out = [some.field(c) for c in fields] + [pa.array(np.diff(bounds), pa.int64())]
                    if whole:
                        out += [_lists([numbers[s:e].astype(np.int32) for s, e in spans], pa.int32()), pa.array(bytes_of, pa.binary())]
                    else:
                        out += [
                            pa.array([hashlib.sha256(numbers[s:e].tobytes()).hexdigest() for s, e in spans], pa.string()),
                            pa.array([hashlib.sha256(b).hexdigest() for b in bytes_of], pa.string()),
                        ]
                    yield pa.RecordBatch.from_arrays(out, schema=schema)
                    a = z

    return run


def encoded(
    docs: DataFrame, text: str = "text", keep: Sequence[str] | None = None, vocabulary: str = VOCABULARY,
    pattern: str = PATTERN, whole: bool = True, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """The columns in ``keep`` (all), n_tokens, and with ``whole`` the ids (array<int>) and ``decoded``, the bytes that they
    decode to; else SHA-256 digests of both, ids_sha256 (little-endian unsigned 32-bit integers) and decoded_sha256."""
    held = ranks(vocabulary)
    added = "n_tokens long, ids array<int>, decoded binary" if whole else "n_tokens long, ids_sha256 string, decoded_sha256 string"
    fields, schema = extended(docs, docs.columns if keep is None else keep, added)
    blocks = _blocks(docs, text, fields, held, pattern, block_words)
    return blocks.mapInArrow(_assemble(fields, whole, _arrow_schema(schema)), schema)


def decoded(rows: DataFrame, ids: str = "ids", name: str = "decoded", vocabulary: str = VOCABULARY) -> DataFrame:
    """Stored ids back to bytes, in a column called ``name``; null ids give null, ids without a piece add nothing."""
    return rows.withColumn(name, F.get(decode_words(f"array(`{ids}`)", ranks(vocabulary)), F.lit(0)))
