"""Vector tables: pooling, signatures, and exact cosine retrieval.

Means over vectors use ``Summarizer``, an aggregate with map-side partial sums: one row per input vector, never one
row per dimension, and a hot group is reduced before it is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from scorewise.functions import arrays

from .blocks import BLOCK_ROWS, KEY, top_rows, with_block, with_totals


def _mean_vector(vec: Column | str) -> Column:
    return vector_to_array(Summarizer.mean(array_to_vector(vec)))


def crop_mean(df: DataFrame, keys: Sequence[str] = ("series_id", "idx")) -> DataFrame:
    """Mean vector over the crops of each position."""
    return df.groupBy(*keys).agg(_mean_vector("vec").alias("vec"))


def mean_pool_embeddings(df: DataFrame, keys: Sequence[str] = KEY, dim: int | None = None) -> DataFrame:
    """Unit vector per group: frame vectors normalised, averaged, normalised again.

    A row with a null vector stands for a group without frames; with ``dim`` such a group gets the zero vector.
    """
    unit = df.withColumn("vec", arrays.l2_normalize(F.col("vec")))
    pooled = unit.filter(F.col("vec").isNotNull()).groupBy(*keys).agg(_mean_vector("vec").alias("vec"))
    pooled = pooled.withColumn("vec", arrays.l2_normalize(F.col("vec")))
    if dim is None:
        return pooled
    zero = F.array_repeat(F.lit(0.0), dim)
    return df.select(*keys).distinct().join(pooled, list(keys), "left").withColumn("vec", F.coalesce("vec", zero))


def temporal_pool(df: DataFrame, length: int = 32, keys: Sequence[str] = KEY, size: int = BLOCK_ROWS) -> DataFrame:
    """Mean vector per bucket, bucket b covering rows ``floor(b*n/L) .. floor((b+1)*n/L)-1``; an empty one copies its row.

    Each row lists the few buckets it can belong to, so no bucket table is joined.
    """
    rows = with_totals(with_block(df, size=size), keys, _n=("count", F.lit(1))).drop("blk")
    lo = lambda b: F.floor(b * F.col("_n") / length)
    inside = lambda b: F.col("idx").between(lo(b), F.greatest(lo(b), lo(b + 1) - 1))
    first = F.greatest(F.floor(F.col("idx") * length / F.col("_n")) - 1, F.lit(0))
    last = F.least(F.ceil((F.col("idx") + 1) * length / F.col("_n")), F.lit(length - 1))
    rows = rows.withColumn("bucket", F.explode(F.filter(F.sequence(first, last), inside)))
    return rows.groupBy(*keys, "bucket").agg(_mean_vector("vec").alias("vec"))


def score_signature(df: DataFrame, n: int = 32, series: DataFrame | None = None, keys: Sequence[str] = KEY) -> DataFrame:
    """Series resampled by linear interpolation to n points and scaled to unit length.

    Only the two rows around each point are fetched, by an equi-join on ``(key, idx)``. A norm below 1e-8 leaves the
    points as they are; a series of ``series`` without scores gets zeros.
    """
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    points = sizes.select(*keys, "_n", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_j"))
    at = F.col("_j") * (F.col("_n") - 1) / F.lit(float(n - 1))
    points = points.withColumn("_at", at).withColumn("_lo", F.floor("_at").cast("long"))
    need = points.withColumn("_part", F.explode(F.array(F.lit(0), F.lit(1))))
    need = need.withColumn("idx", F.least(F.col("_lo") + F.col("_part"), F.col("_n") - 1))
    part = F.col("_at") - F.col("_lo")
    weight = F.when(F.col("_part") == 0, 1 - part).otherwise(part)
    met = need.join(df.select(*keys, "idx", "score"), [*keys, "idx"])
    values = met.groupBy(*keys, "_j").agg(F.sum(weight * F.col("score")).alias("_v"))
    vec = F.transform(F.array_sort(F.collect_list(F.struct("_j", "_v"))), lambda s: s["_v"])
    out = values.groupBy(*keys).agg(vec.alias("vec")).withColumn("_norm", arrays.l2_norm(F.col("vec")))
    out = out.withColumn("vec", F.when(F.col("_norm") < arrays.NORM_FLOOR, F.col("vec")).otherwise(
        F.transform("vec", lambda x: x / F.col("_norm"))
    )).drop("_norm")
    if series is None:
        return out
    zeros = F.array_repeat(F.lit(0.0), n)
    return series.select(*keys).join(out, list(keys), "left").withColumn("vec", F.coalesce("vec", zeros))


def weighted_mean(df: DataFrame, value: str, weight: str, keys: Sequence[str] = KEY) -> DataFrame:
    """Mean with weights ``w / (sum w + 1e-8)``."""
    total = F.sum(F.col(value) * F.col(weight)) / (F.sum(weight) + arrays.NORM_FLOOR)
    return df.groupBy(*keys).agg(total.alias("weighted"))


def reconstruction_error(df: DataFrame, target: str, recon: str, second: str | None = None, kind: str = "l2") -> DataFrame:
    """Per-row error of a reconstruction; with ``second`` the sum of both reconstructions' errors."""
    error = arrays.vector_error(F.col(target), F.col(recon), kind)
    if second is not None:
        error = error + arrays.vector_error(F.col(target), F.col(second), kind)
    return df.withColumn("error", error)


def mil_gate_score(df: DataFrame, k: int = 3, keys: Sequence[str] = KEY) -> DataFrame:
    """Mean score of the k rows with the largest ``magnitude``; all rows when there are fewer."""
    return top_rows(df, keys, k, "magnitude").groupBy(*keys).agg(F.avg("score").alias("gate_score"))


# --- retrieval -------------------------------------------------------------------------------------------------

CENTERS = 64  # directions per group that vectors are told apart by
GROUPS = 1000  # groups that get centers of their own
SPARE = 4
_MARGIN = 1e-9  # of rounding in a bound
_ROUNDING = 2.0**-23  # of a single-precision product, per dimension
_MANY = 64  # candidates of a query in a block, beyond which the block is ordered as a whole


def topk_similar(
    queries: DataFrame, index: DataFrame, k: int = 3, group: str | None = None, block: int = 2048, parts: int | None = None,
    centers: int = CENTERS,
) -> DataFrame:
    """Exact cosine top-k: ``(query_id, rank, index_id, sim)``, rank from 1, ties by index id.

    ``queries`` has ``query_id, vec``, ``index`` has ``index_id, vec``, both with unit vectors (and ``group``, e.g. an
    encoder, when given: only equal groups meet). Both sides are dealt into strips by id, about the square root of
    ``parts`` on each side (twice the shuffle partitions by default), and every strip of one side meets every strip of the
    other: a vector is copied once per strip of the other side, not once per part. Strips travel as blocks of up to
    ``block`` vectors that are nearest to the same of ``centers`` directions; a block knows between which angles to that
    direction its vectors lie. So the best cosine that a query can have with any vector of a block is known from the angle
    of the query alone, and a query is compared with a block only if that reaches its k-th best so far; blocks that
    promise most come first. Of a block only those vectors are looked at one by one that come near the query's k-th best in
    single precision, by more than its rounding. A task holds the best k of the query block at hand, so k rows per query leave each strip of
    the index. No pair of vectors becomes a row and no side is broadcast or collected but the centers.
    A zero query has no direction: it gets the first k of the index with a null similarity.
    """
    by = [group] if group else []
    ranked = _ranked(local_topk(queries, index, k, group, block, parts, centers), by, k)
    return ranked.select(*by, "query_id", "rank", "index_id", F.when(~F.col("zero"), F.col("sim")).alias("sim"))


def _ranked(local: DataFrame, by: Sequence[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by, "query_id").orderBy(F.desc("sim"), "index_id")
    return local.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def center_vectors(index: DataFrame, by: Sequence[str], centers: int) -> dict[tuple, np.ndarray]:
    """Directions to sort vectors by: of each group the ``centers`` index vectors that come first by a hash of their id, for the
    first ``GROUPS`` groups. Groups without any are compared as a whole, which is as exact."""
    first = Window.partitionBy(*by).orderBy(F.xxhash64("index_id"), "index_id")
    some = index.select(*by, "index_id", "vec").withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= min(centers, 1000))
    some = some.select(*by, F.col("vec").cast("array<double>").alias("vec")).limit(GROUPS * min(centers, 1000))
    found: dict[tuple, list] = {}
    for row in some.collect():
        vec = np.asarray(row["vec"], float)
        if np.isfinite(vec).all() and vec.any():
            found.setdefault(tuple(row[c] for c in by), []).append(vec / np.linalg.norm(vec))
    return {key: np.stack(vectors) for key, vectors in found.items() if len({len(v) for v in vectors}) == 1}


def local_topk(
    queries: DataFrame, index: DataFrame, k: int, group: str | None = None, block: int = 2048, parts: int | None = None,
    centers: int = CENTERS,
) -> DataFrame:
    """The best k of every query in each strip of the index, and in ``compared`` with how many vectors of the strip the query was
    compared."""
    by = [group] if group else []
    side = max(1, round((parts or 2 * int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))) ** 0.5))
    strip = lambda c: F.pmod(F.xxhash64(c), F.lit(side)).cast("int")
    of_group = center_vectors(index, by, centers)
    packed_q = _pack(queries.select(*by, strip("query_id").alias("row"), F.col("query_id").alias("id"), "vec"), by, "row", block, "q", of_group)
    packed_i = _pack(index.select(*by, strip("index_id").alias("col"), F.col("index_id").alias("id"), "vec"), by, "col", block, "i", of_group)
    every = F.explode(F.sequence(F.lit(0), F.lit(side - 1)))
    # a merge join streams, for each query block, the index blocks of a cell, and spills
    met = packed_q.withColumn("col", every).join(packed_i.withColumn("row", every).hint("merge"), [*by, "row", "col"])
    met = met.select(*by, "row", "col", "q_ids", "q_vecs", "i_ids", "i_vecs", "i_center", "i_near", "i_far")

    def bounds(q: np.ndarray, rows: list) -> np.ndarray:
        """The best cosine that each query can have with a vector of each block."""
        out = np.full((len(q), len(rows)), np.inf)
        center = np.array([row.i_center for row in rows])
        some = np.flatnonzero(center >= 0)
        if not len(some):
            return out
        size = np.linalg.norm(q, axis=1)[:, None]
        at = of_group[tuple(getattr(rows[0], c) for c in by)][center[some]]
        with np.errstate(invalid="ignore", divide="ignore"):
            angle = np.arccos(np.clip(q @ at.T / size, -1, 1))
        near, far = (np.array([getattr(rows[i], c) for i in some]) for c in ("i_near", "i_far"))
        best = size * np.cos(np.clip(np.maximum(angle - far, near - angle), 0, np.pi))
        out[:, some] = np.where(size > 0, best, np.inf)
        return out

    def merged(ids, sims, more_ids, more_sims):
        ids, sims = np.concatenate([ids, more_ids], axis=1), np.concatenate([sims, more_sims], axis=1)
        order = np.lexsort((ids, -sims), axis=1)[:, :k]
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def improved(q: np.ndarray, i_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best ids and similarities of the queries after a block."""
        whole = np.arange(len(q))
        with np.errstate(over="ignore"):
            q32, v32 = q.astype("<f4"), vectors.astype("<f4")
        if np.isfinite(q32).all() and np.isfinite(v32).all():
            near = q32 @ v32.T
            slack = (q.shape[1] + 8) * _ROUNDING * (np.linalg.norm(q, axis=1) * np.linalg.norm(vectors, axis=1).max() + 1e-30)
            least = sims[:, -1].copy()
            fresh = np.flatnonzero(least == -np.inf)
            if len(fresh) and len(i_ids) > k:
                least[fresh] = np.partition(near[fresh], len(i_ids) - k, axis=1)[:, len(i_ids) - k] - slack[fresh]
            # a float32 next below the limit, so that its own rounding loses none
            limit = np.nextafter((least - slack).astype("<f4"), np.float32(-np.inf))
            rows, columns = np.divmod(np.flatnonzero(near >= limit[:, None]), len(i_ids))
            number = np.bincount(rows, minlength=len(q))
            few = number[rows] <= k + _MANY
            rows, columns = rows[few], columns[few]
            if len(rows):
                hit, place = np.unique(rows, return_inverse=True)
                nth = np.arange(len(rows)) - np.searchsorted(rows, hit)[place]
                more_ids = np.full((len(hit), int(nth.max()) + 1), np.iinfo(np.int64).max)
                more_sims = np.full(more_ids.shape, -np.inf)
                more_ids[place, nth] = i_ids[columns]
                more_sims[place, nth] = np.einsum("hd,hd->h", q[rows], vectors[columns])
                ids[hit], sims[hit] = merged(ids[hit], sims[hit], more_ids, more_sims)
            whole = np.flatnonzero(number > k + _MANY)
        if len(whole):
            product = q[whole] @ vectors.T
            # ids ascend inside a block, so a stable sort breaks ties by id; all of a zero query's are ties
            top = np.argsort(-product, axis=1, kind="stable")[:, : k + SPARE]
            # a matrix product rounds by its shape; the best are computed again, one by one, so that equal vectors tie
            exact = np.einsum("hd,hd->h", np.repeat(q[whole], top.shape[1], axis=0), vectors[top.ravel()]).reshape(top.shape)
            ids[whole], sims[whole] = merged(ids[whole], sims[whole], i_ids[top], exact)
        return ids, sims

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # cell and ids of the query block at hand, its vectors, the best ids and similarities so far, compared

        def found() -> pd.DataFrame:
            (cell, ids), vectors, best_ids, best_sims, compared = held
            real = np.flatnonzero(best_sims.ravel() > -np.inf)
            n = best_ids.shape[1]
            return pd.DataFrame({
                **{c: [v] * len(real) for c, v in zip(by, cell)}, "query_id": np.repeat(np.frombuffer(ids, "<i8"), n)[real],
                "index_id": best_ids.ravel()[real], "sim": best_sims.ravel()[real],
                "zero": np.repeat(~vectors.any(axis=1), n)[real], "compared": np.repeat(compared, n)[real],
            })

        for batch in batches:
            waiting: dict[tuple, list] = {}
            for row in batch.itertuples(index=False):
                name = (tuple(getattr(row, c) for c in (*by, "row", "col")), np.asarray(row.q_ids, "<i8").tobytes())
                waiting.setdefault(name, []).append(row)
            for name, rows in waiting.items():
                if held is None or held[0] != name:
                    if held is not None:
                        yield found()
                    n = len(name[1]) // 8
                    q = np.frombuffer(rows[0].q_vecs, "<f8").reshape(n, -1)
                    held = (name, q, np.zeros((n, k), "<i8"), np.full((n, k), -np.inf), np.zeros(n, "<i8"))
                _, q, best_ids, best_sims, compared = held
                bound = bounds(q, rows)
                left = np.argsort(-np.nan_to_num(bound, nan=np.inf, posinf=2).max(axis=0), kind="stable")
                most = 0  # the block that promises most comes alone, so that there is something to reach
                while len(left):
                    open_ = ~(bound[:, left] < best_sims[:, -1:] - _MARGIN)
                    left, open_ = left[open_.any(axis=0)], open_[:, open_.any(axis=0)]
                    if not len(left):
                        break
                    sizes = np.cumsum([len(rows[at].i_ids) for at in left])
                    taken = max(1, int(np.searchsorted(sizes, most, side="right")))
                    together, wanted = [rows[at] for at in left[:taken]], np.flatnonzero(open_[:, :taken].any(axis=1))
                    left, most = left[taken:], block
                    i_ids = np.concatenate([np.asarray(row.i_ids, "<i8") for row in together])
                    vectors = np.concatenate([np.frombuffer(row.i_vecs, "<f8").reshape(len(row.i_ids), -1) for row in together])
                    order = np.argsort(i_ids, kind="stable")
                    i_ids, vectors = i_ids[order], vectors[order]
                    best_ids[wanted], best_sims[wanted] = improved(q[wanted], i_ids, vectors, best_ids[wanted], best_sims[wanted])
                    compared[wanted] += len(i_ids)
        if held is not None:
            yield found()

    kinds = [f"{c} {met.schema[c].dataType.simpleString()}" for c in by]
    return met.mapInPandas(best, ", ".join([*kinds, "query_id long, index_id long, sim double, zero boolean, compared long"]))


def _pack(df: DataFrame, by: Sequence[str], strip: str, block: int, side: str, of_group: dict[tuple, np.ndarray]) -> DataFrame:
    """Blocks of up to ``block`` vectors per group, strip and nearest center, as one id array and one buffer of doubles; ids ascend
    in a block. ``near`` and ``far`` are the least and the largest angle to the center; vectors without a
    direction of length 1 have the center -1."""
    keys = [*by, strip, "center"]

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            center, angle = np.full(n, -1, np.int32), np.zeros(n)
            codes = np.zeros(n, np.int64)
            for c in by:
                codes = codes * (n + 1) + batch.column(c).dictionary_encode().indices.fill_null(n).to_numpy(zero_copy_only=False)
            for code, first in zip(*np.unique(codes, return_index=True)):  # the groups of the batch
                at = of_group.get(tuple(batch.column(c)[int(first)].as_py() for c in by))
                places = np.flatnonzero(codes == code)
                vectors = _matrix(batch.column("vec").take(pa.array(places)))
                unit = np.abs(np.linalg.norm(vectors, axis=1) - 1) < 1e-6
                if at is not None and unit.any() and at.shape[1] == vectors.shape[1]:
                    places, cosines = places[unit], vectors[unit] @ at.T
                    center[places] = cosines.argmax(axis=1)
                    angle[places] = np.arccos(np.clip(cosines.max(axis=1), -1, 1))
            out = [*batch.columns, pa.array(center), pa.array(angle)]
            yield pa.RecordBatch.from_arrays(out, names=[*batch.schema.names, "center", "angle"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, parts, size = None, [], 0

        def packed() -> pa.RecordBatch:
            ids, vectors, angles = (np.concatenate(x) for x in zip(*parts))
            data = np.ascontiguousarray(vectors, dtype="<f8").tobytes()
            row = [*open_key, ids, data, float(angles.min()) - 1e-7, float(angles.max()) + 1e-7]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(c) for c in keys]
            changed = np.zeros(batch.num_rows, bool)
            for c in columns:
                codes = c.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                changed[1:] |= codes[1:] != codes[:-1]
            ids, angles = batch.column("id").to_numpy(), batch.column("angle").to_numpy()
            edges = [0, *np.flatnonzero(changed).tolist(), batch.num_rows]
            for a, z in zip(edges[:-1], edges[1:]):  # a run of one key
                key = tuple(c[a].as_py() for c in columns)
                if key != open_key:
                    if parts:
                        yield packed()
                    open_key, parts, size = key, [], 0
                vectors = _matrix(batch.column("vec").slice(a, z - a))
                begin = a
                while a < z:
                    n = min(z - a, block - size)
                    parts.append((ids[a : a + n], vectors[a - begin : a - begin + n], angles[a : a + n]))
                    a, size = a + n, size + n
                    if size == block:
                        yield packed()
                        parts, size = [], 0
        if parts:
            yield packed()

    doubles = df.withColumn("vec", F.col("vec").cast("array<double>"))
    sided = [f"{c} {df.schema[c].dataType.simpleString()}" for c in [*by, strip]]
    placed = doubles.select(*by, strip, "id", "vec").mapInArrow(nearest, ", ".join([*sided, f"id {df.schema['id'].dataType.simpleString()}, vec array<double>, center int, angle double"]))
    placed = placed.withColumn("id", F.col("id").cast("long"))
    names = f"center int, {side}_ids array<long>, {side}_vecs binary, {side}_near double, {side}_far double"
    kinds = T.StructType.fromDDL(", ".join([*sided, names]))
    schema = to_arrow_schema(kinds)
    # a strip is spread over a few tasks by its centers, each of which fills its own blocks
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = F.pmod(F.xxhash64("center", F.when(F.col("center") < 0, F.xxhash64("id", F.lit(1)))), F.lit(max(1, round(tasks ** 0.5))))
    rows = placed.repartition(*by, strip, spread).sortWithinPartitions(*keys, "id")
    return rows.mapInArrow(pack, kinds).withColumnRenamed("center", f"{side}_center")


def _matrix(vectors: pa.Array) -> np.ndarray:
    """The vectors of one group as a matrix; different lengths are an error."""
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


def topk_sweep(queries: DataFrame, index: DataFrame, ks: Sequence[int], group: str | None = None) -> DataFrame:
    """Retrieval for several k from one similarity pass, with ``k`` as a column."""
    ranked = topk_similar(queries, index, max(ks), group)
    rows = ranked.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    return rows.filter(F.col("rank") <= F.col("k"))

