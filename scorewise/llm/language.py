"""Language identification as inference of a mixture.

Fit: per language, frequencies of hashed byte trigrams inside words (lower case; whatever is not a letter separates
words), from the labelled rows that are not held out. Per language at most about ``train_docs`` documents are read,
picked by a hash of the id; this bound on the labelled sample is a parameter.

Prediction reads every whole text. Each word has a likelihood under each language, the product over its trigrams. The
shares of the languages in a document are found by expectation-maximisation over its words. Which languages there are
is chosen by penalised likelihood: starting with the best single language, the next one by share is admitted while the
log-likelihood gains more than ``penalty * log(words)``. The predicted language is the one with the largest share of the
chosen set, ties to the first name; the score is that share.

Null texts and texts without a letter are ``und`` with score 0, as is everything if nothing was learned. Null labels and
rows whose id is null are not learned from; their rows are predicted like all others. Languages are exactly the label
values seen. Only id, text and label are read; other columns pass through, and one named like an output is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .schemas import extended
from .words import slices

BUCKETS = 1 << 16
TRAIN_DOCS = 2_000
PENALTY = 3.0
LEAST = 0.3  # share of its words that a document's language must have to be recognised
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")
_CODE = np.array([c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], np.uint8)


def held_out(key: str = "doc_id", parts: int = 4, part: int = 2) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string")), F.lit(parts)) == part, F.lit(False))


def lower(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))


def letter_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram bucket of every letter byte, the first of them per word, and per text the number of words before it.

    A trigram is a byte with the two before it; a word starts after a space and its end is not marked."""
    code = np.empty(len(data) + 2, np.uint8)
    code[:2] = 32
    code[2:] = _CODE[data]
    fresh = np.zeros(len(data), bool)
    inner = offsets[:-1]
    fresh[inner[inner < len(data)]] = True
    letter = code[2:] != 32
    start = letter & ((code[1:-1] == 32) | fresh)
    one = code[1:-1].astype(np.uint32)
    two = code[:-2].astype(np.uint32)
    one[start] = 32
    # the byte before the first letter of a word is its space, two before it nothing
    two[start] = 0
    second = np.zeros(len(data), bool)
    second[1:] = start[:-1]
    two[second] = 32
    bucket = ((code[2:].astype(np.uint32) * 0x9E3779B1 + one * 0x85EBCA6B + two * 0xC2B2AE35) >> np.uint32(16)) & 0xFFFF
    at = np.flatnonzero(letter)
    firsts = np.flatnonzero(start)
    return bucket[at], np.searchsorted(at, firsts), np.searchsorted(firsts, offsets)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[str, np.ndarray] = {}
    for batch in batches:
        labels = np.array(batch.column("lang").to_pylist(), object)
        for row, data, offsets in slices(lower(batch.column("text"))):
            buckets, firsts, words = letter_words(data, offsets)
            edges = np.append(firsts, len(buckets))[words]
            here = np.repeat(np.arange(len(offsets) - 1), np.diff(edges))
            for lang in set(labels[row : row + len(offsets) - 1]):
                mine = labels[row : row + len(offsets) - 1] == lang
                counts = np.bincount(buckets[mine[here]], minlength=BUCKETS)
                seen[lang] = seen.get(lang, 0) + counts
    for lang, counts in seen.items():
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({
            "lang": pa.array([lang] * len(used), pa.string()), "bucket": pa.array(used, pa.int32()),
            "n": pa.array(counts[used], pa.int64()),
        })


class Model:
    """Log-probabilities of the trigram buckets, one column per language."""

    def __init__(self, counts: pd.DataFrame, smoothing: float = 0.5):
        self.languages = sorted(counts["lang"].unique())
        table = np.full((BUCKETS, len(self.languages)), smoothing)
        place = {name: i for i, name in enumerate(self.languages)}
        table[counts["bucket"].to_numpy(dtype=int), counts["lang"].map(place).to_numpy(dtype=int)] += counts["n"].to_numpy()
        self.table = np.log(table / table.sum(axis=0)).astype(np.float32)


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", train_docs: int = TRAIN_DOCS) -> Model:
    """Learn from the rows that are labelled and not held out: of each language a hashed sample of about ``train_docs``."""
    named = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(label).cast("string").alias("lang"))
    usable = named.filter(F.col("lang").isNotNull() & F.col("key").isNotNull() & ~held_out("key"))
    counts = usable.groupBy("lang").count().collect()  # one row per language
    if not counts:
        return Model(pd.DataFrame({"lang": [], "bucket": [], "n": []}))
    share = F.create_map(*[F.lit(v) for r in counts for v in (r["lang"], float(train_docs) / r["count"])])
    draw = F.pmod(F.xxhash64(F.lit("language"), F.col("key").cast("string")), F.lit(1_000_003)) / 1_000_003.0
    sample = usable.filter(draw < F.element_at(share, F.col("lang")))
    counted = sample.select("text", "lang").mapInArrow(_count, "lang string, bucket int, n long")
    return Model(counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas())


def _mixture(p: np.ndarray, edges: np.ndarray, owner: np.ndarray, rounds: int, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Shares and log-likelihood per text, from the words' likelihoods (up to a factor per word)."""
    n = np.diff(edges)[:, None]
    shares = np.full((len(edges) - 1, p.shape[1]), 1.0 / p.shape[1])
    moving = np.ones(len(shares), bool)
    for _ in range(rounds):
        joint = p * shares[owner]
        joint /= joint.sum(axis=1, keepdims=True)
        new = np.add.reduceat(joint, edges[:-1], axis=0) / n
        moved = np.abs(new - shares).max(axis=1)
        shares[moving] = new[moving]
        moving &= moved >= tolerance  # each text stops by itself, whatever its neighbours do
        if not moving.any():
            break
    evidence = np.log(np.maximum((p * shares[owner]).sum(axis=1), 1e-300))
    return shares, np.add.reduceat(evidence, edges[:-1])


def infer(likelihood: np.ndarray, edges: np.ndarray, penalty: float, rounds: int = 30, tolerance: float = 1e-3) -> np.ndarray:
    """Shares of the languages per text. ``likelihood``: log-likelihoods (words, languages); ``edges``: first word of
    each text, and the number of words; every text has a word."""
    texts, width = len(edges) - 1, likelihood.shape[1]
    owner = np.repeat(np.arange(texts), np.diff(edges))
    p = np.exp(np.maximum(likelihood - likelihood.max(axis=1, keepdims=True), -60.0)).astype(np.float64)
    single = np.add.reduceat(np.maximum(likelihood - likelihood.max(axis=1, keepdims=True), -60.0).astype(np.float64), edges[:-1], axis=0)
    order = np.argsort(-_mixture(p, edges, owner, 4, 0.0)[0], axis=1, kind="stable")
    best = single.argmax(axis=1)
    # the best single language leads, the others follow by share
    rest = order[order != best[:, None]].reshape(texts, width - 1)
    order = np.column_stack([best, rest])
    out = np.zeros((texts, width))
    out[np.arange(texts), best] = 1.0
    held, active = single.max(axis=1), np.arange(texts)
    for size in range(2, width + 1):
        if not len(active):
            break
        counts = np.diff(edges)[active]
        cut = np.concatenate([[0], np.cumsum(counts)])
        mine = np.repeat(np.arange(len(active)), counts)
        rows = np.arange(cut[-1]) - np.repeat(cut[:-1] - edges[:-1][active], counts)
        chosen = order[active, :size]
        shares, evidence = _mixture(p[rows[:, None], chosen[mine]], cut, mine, rounds, tolerance)
        better = evidence - held[active] > penalty * np.log(np.maximum(counts, 2))
        texts_on = active[better]
        out[texts_on] = 0.0
        out[texts_on[:, None], chosen[better]] = shares[better]
        held[texts_on] = evidence[better]
        active = texts_on
    return out


def shares_of(column: pa.Array, model: Model, penalty: float = PENALTY) -> np.ndarray:
    """Language shares of each text of a column; all zero where nothing can be told."""
    out = np.zeros((len(column), len(model.languages)))
    if not model.languages:
        return out
    for row, data, offsets in slices(lower(column)):
        buckets, firsts, words = letter_words(data, offsets)
        if not len(firsts):
            continue
        likelihood = np.add.reduceat(model.table[buckets], firsts, axis=0)
        some = np.flatnonzero(np.diff(words))
        out[row + some] = infer(likelihood, np.append(words[some], words[-1]), penalty)
    return out


def told_shares(column: pa.Array, model: Model, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the languages per text, and whether the text has a letter and a language was told."""
    shares = shares_of(column, model, penalty)
    lettered = np.array([bool(x) and _LETTER.search(x) is not None for x in column.to_pylist()], bool)
    return shares, lettered & (shares.sum(axis=1) > 0) if shares.size else np.zeros(len(column), bool)


def _predict(model: Model, penalty: float, text: str, fields: list[str], named: list[str]):
    names = np.array([*model.languages, UNKNOWN], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shares, told = told_shares(batch.column(text), model, penalty)
            best = np.where(told, shares.argmax(axis=1) if shares.size else 0, len(names) - 1)
            score = np.where(told, shares.max(axis=1) if shares.size else 0.0, 0.0)
            mixture = [
                [{"lang": names[j], "share": float(s[j])} for j in np.argsort(-s, kind="stable") if s[j] > 0] if ok else []
                for s, ok in zip(shares, told)
            ]
            out = [batch.column(c) for c in fields] + [
                pa.array(names[best].tolist(), pa.string()), pa.array(np.clip(score, 0.0, 1.0), pa.float64()),
                pa.array(mixture, pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))),
            ]
            yield pa.RecordBatch.from_arrays(out, names=[*fields, *named])

    return run


def predicted(
    docs: DataFrame, model: Model, text: str = "text", penalty: float = PENALTY,
    names: tuple[str, str, str] = ("lang_pred", "score", "languages"), keep: list[str] | None = None,
) -> DataFrame:
    """The documents (or their columns ``keep``) with the predicted language, its share and all languages found, under
    ``names``; nothing is shuffled."""
    added = f"{names[0]} string, {names[1]} double, {names[2]} array<struct<lang:string,share:double>>"
    fields, schema = extended(docs, docs.columns if keep is None else keep, added)
    return docs.mapInArrow(_predict(model, penalty, text, fields, list(names)), schema)


def _recognise(model: Model, penalty: float, text: str, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shares, told = told_shares(batch.column(text), model, penalty)
            best = shares.max(axis=1) if shares.size else np.zeros(len(told))
            yield batch.filter(pa.array(told & (best >= least)))

    return run


def recognised(docs: DataFrame, model: Model, text: str = "text", least: float = LEAST, penalty: float = PENALTY) -> DataFrame:
    """The documents, with exactly their own columns, that have a language with at least ``least`` of their words."""
    return docs.mapInArrow(_recognise(model, penalty, text, least), docs.schema)
