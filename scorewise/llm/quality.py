"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words; only the document has a label. Every passage of the whole text is
described by the frequencies of hashed byte pairs and a few measures of its shape, and encoded by one tanh layer. Gated
attention, tanh(hV) * sigmoid(hU) projected to one number and normalised over the document, weighs the passages; a
logistic unit scores the weighted sum of their codes. All weights are learned together from document labels.

Fit: a sample of the labelled rows that are not held out, about ``train_docs`` of each class picked by a hash of the
id (a documented bound); the logit is shifted back from the sample's balance to that of all usable labels. The
network is trained in the driver on that bounded sample, with fixed seeds, so reruns agree.

Scoring covers whole texts of any length. Null and empty texts are one passage without words and get a score too. Label
rows with a null id or a label other than 0 and 1 are not used; an id labelled twice counts twice. Without usable labels
of both classes every score is the share of label 1, or 0.5 without any. Only ids, texts and labels are read; a
column named like an output is replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import language
from .schemas import extended
from .words import slices, spans, word_hashes

PASSAGE = 64
PAIRS = 256
SHAPES = 9
HIDDEN, GATE = 32, 16
TRAIN_DOCS = 2_000

_KIND = np.zeros(256, np.int64)  # 0 other, 1 lower, 2 upper, 3 digit, 4 punctuation, 5 white space, 6 beyond ASCII
for _kind, _chars in ((1, range(97, 123)), (2, range(65, 91)), (3, range(48, 58)), (5, (32, 9, 10, 11, 12, 13)), (6, range(128, 256))):
    _KIND[list(_chars)] = _kind
_KIND[[c for c in range(33, 127) if _KIND[c] == 0]] = 4


def held_out(key: str = "doc_id"):
    return language.held_out(key, parts=3, part=1)


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of some texts, and the first passage of each text (with the number of passages last)."""
    starts, ends, first = spans(data, offsets)
    words = np.diff(first)
    counts = np.maximum(1, -(-words // PASSAGE))
    edges = np.concatenate([[0], np.cumsum(counts)])
    own = np.repeat(np.arange(len(words)), words)
    passage = edges[:-1][own] + (np.arange(len(starts)) - first[:-1][own]) // PASSAGE
    total = int(edges[-1])
    out = np.zeros((total, PAIRS + SHAPES), np.float32)
    if not len(starts):
        return out, edges

    # bytes of a passage: from its first word up to the end of its last word
    lead = np.flatnonzero(np.diff(passage, prepend=-1))
    tail = np.append(lead[1:], len(passage)) - 1
    begin, stop, used = starts[lead], ends[tail], passage[lead]
    sizes = stop - begin
    where = np.repeat(used, sizes)
    at = np.arange(sizes.sum()) + np.repeat(begin - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
    body = data[at].astype(np.uint32)
    pair = ((body[:-1] * 0x9E3779B1 + body[1:] * 0x85EBCA6B) >> np.uint32(24)).astype(np.int64)
    same = where[:-1] == where[1:]
    grid = np.bincount(where[:-1][same] * PAIRS + pair[same], minlength=total * PAIRS).reshape(total, PAIRS)
    n_bytes = np.bincount(where, minlength=total)
    out[:, :PAIRS] = np.sqrt(grid / np.maximum(n_bytes, 1)[:, None])

    kinds = np.bincount(where * 7 + _KIND[data[at]], minlength=total * 7).reshape(total, 7) / np.maximum(n_bytes, 1)[:, None]
    out[:, PAIRS : PAIRS + 6] = np.sqrt(kinds[:, 1:])
    n_words = np.bincount(passage, minlength=total)
    out[:, PAIRS + 6] = np.log1p(n_bytes / np.maximum(n_words, 1))
    out[:, PAIRS + 7] = np.log1p(n_words) / np.log1p(PASSAGE)
    hashes = word_hashes(data, starts, ends)
    order = np.lexsort((hashes, passage))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (passage[order][1:] != passage[order][:-1])
    out[:, PAIRS + 8] = np.bincount(passage[order][fresh], minlength=total) / np.maximum(n_words, 1)
    return out, edges


class Model:
    """The network; every array is float32."""

    def __init__(self, seed: int = 7):
        draw = np.random.default_rng(seed)
        wide = PAIRS + SHAPES
        shape = lambda a, b: (draw.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
        self.mean, self.scale = np.zeros(wide, np.float32), np.ones(wide, np.float32)
        self.w = {
            "code": shape(wide, HIDDEN), "code0": np.zeros(HIDDEN, np.float32), "value": shape(HIDDEN, GATE),
            "gate": shape(HIDDEN, GATE), "pick": shape(GATE, 1)[:, 0], "out": shape(HIDDEN, 1)[:, 0], "out0": np.zeros(1, np.float32),
        }
        self.shift, self.constant = 0.0, None

    def forward(self, x: np.ndarray, edges: np.ndarray) -> dict[str, np.ndarray]:
        w, bag, first = self.w, np.repeat(np.arange(len(edges) - 1), np.diff(edges)), edges[:-1]
        h = np.tanh((x - self.mean) / self.scale @ w["code"] + w["code0"])
        v, u = np.tanh(h @ w["value"]), 1 / (1 + np.exp(-np.clip(h @ w["gate"], -30, 30)))
        a = (v * u) @ w["pick"]
        e = np.exp(a - np.maximum.reduceat(a, first)[bag])
        attention = e / np.add.reduceat(e, first)[bag]
        z = np.add.reduceat(h * attention[:, None], first, axis=0)
        return {"bag": bag, "h": h, "v": v, "u": u, "attention": attention, "z": z, "logit": z @ w["out"] + w["out0"][0]}

    def gradients(self, x: np.ndarray, edges: np.ndarray, y: np.ndarray, decay: float) -> dict[str, np.ndarray]:
        w, s, first = self.w, self.forward(x, edges), edges[:-1]
        bag, h, v, u, attention = s["bag"], s["h"], s["v"], s["u"], s["attention"]
        d_logit = (1 / (1 + np.exp(-np.clip(s["logit"], -30, 30))) - y) / len(y)
        d_z = d_logit[:, None] * w["out"]
        d_h = attention[:, None] * d_z[bag]
        d_attention = (h * d_z[bag]).sum(axis=1)
        d_a = attention * (d_attention - np.add.reduceat(attention * d_attention, first)[bag])
        d_v, d_u = d_a[:, None] * w["pick"] * u * (1 - v * v), d_a[:, None] * w["pick"] * v * u * (1 - u)
        d_h = (d_h + d_v @ w["value"].T + d_u @ w["gate"].T) * (1 - h * h)
        g = {
            "code": ((x - self.mean) / self.scale).T @ d_h, "code0": d_h.sum(axis=0), "value": h.T @ d_v, "gate": h.T @ d_u,
            "pick": (v * u).T @ d_a, "out": s["z"].T @ d_logit, "out0": np.array([d_logit.sum()]),
        }
        return {k: d + (decay * w[k] if w[k].ndim == 2 else 0) for k, d in g.items()}

    def scores(self, x: np.ndarray, edges: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(edges) - 1, self.constant)
        logit = self.forward(x, edges)["logit"].astype(np.float64) + self.shift
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))

    def train(self, x: np.ndarray, edges: np.ndarray, y: np.ndarray, epochs: int, step: float, batch: int, decay: float, seed: int):
        self.mean = x.mean(axis=0)
        self.scale = x.std(axis=0) + np.float32(1e-2)
        draw, count = np.random.default_rng(seed), 0
        first, second = ({k: np.zeros_like(a) for k, a in self.w.items()} for _ in range(2))
        for _ in range(epochs):
            order = draw.permutation(len(y))
            for part in np.array_split(order, max(1, len(order) // batch)):
                sizes = np.diff(edges)[part]
                cut = np.concatenate([[0], np.cumsum(sizes)])
                rows = np.arange(cut[-1]) + np.repeat(edges[:-1][part] - cut[:-1], sizes)
                count += 1
                for k, d in self.gradients(x[rows], cut, y[part], decay).items():
                    first[k] = 0.9 * first[k] + 0.1 * d
                    second[k] = 0.999 * second[k] + 0.001 * d * d
                    move = step * (first[k] / (1 - 0.9**count)) / (np.sqrt(second[k] / (1 - 0.999**count)) + 1e-8)
                    self.w[k] = (self.w[k] - move).astype(np.float32)


def fit(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
    train_docs: int = TRAIN_DOCS, epochs: int = 12, step: float = 4e-3, batch: int = 64, decay: float = 1e-4, seed: int = 7,
) -> Model:
    """Learn from labelled rows that are not held out."""
    marked = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("y"))
    usable = marked.filter(F.col("key").isNotNull() & F.col("y").isin(0, 1) & ~held_out("key"))
    counts = {r["y"]: r["count"] for r in usable.groupBy("y").count().collect()}
    model = Model(seed)
    if len(counts) < 2:
        model.constant = float(next(iter(counts))) if counts else 0.5
        return model
    share = F.when(F.col("y") == 1, train_docs / counts[1]).otherwise(train_docs / counts[0])
    draw = F.pmod(F.xxhash64(F.lit("quality"), F.col("key").cast("string")), F.lit(1_000_003)) / 1_000_003.0
    # about 2 * train_docs rows; the limit only makes the bound certain, as the side is broadcast
    sample = F.broadcast(usable.filter(draw < share).limit(8 * train_docs))
    named = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    taken = named.join(sample, "key").toPandas().sort_values(["key", "text", "y"], kind="stable")
    y = taken["y"].to_numpy(np.float32)
    if len(set(y)) < 2:
        model.constant = counts[1] / (counts[0] + counts[1])
        return model
    parts, edges = [], [np.zeros(1, np.int64)]
    for _, data, offsets in slices(pa.array(taken["text"], pa.large_string(), from_pandas=True)):
        x, cut = passages(data, offsets)
        parts.append(x)
        edges.append(edges[-1][-1] + cut[1:])
    model.train(np.concatenate(parts), np.concatenate(edges), y, epochs, step, batch, decay, seed)
    model.shift = float(np.log(counts[1] / counts[0]) - np.log(y.sum() / (len(y) - y.sum())))
    return model


def _score(model: Model, text: str, fields: list[str], named: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = [model.scores(*passages(data, offsets)) for _, data, offsets in slices(batch.column(text))]
            score = np.concatenate(score) if score else np.zeros(0)
            out = [batch.column(c) for c in fields] + [pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(out, names=[*fields, *named])

    return run


def scored(
    docs: DataFrame, model: Model, text: str = "text", names: tuple[str, str] = ("score", "predicted"),
    keep: list[str] | None = None,
) -> DataFrame:
    """The documents (or their columns ``keep``) with score and predicted label under ``names``; nothing is shuffled."""
    fields, schema = extended(docs, docs.columns if keep is None else keep, f"{names[0]} double, {names[1]} int")
    return docs.mapInArrow(_score(model, text, fields, list(names)), schema)
