"""Registered queries over vectors and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorewise.functions import arrays
from scorewise.operators import vectors as V

from . import fixtures as fx
from .registry import query

_LONG = "select {keys}, unnest(range({n})) dim, unnest({vec}) value from {source}"


def long(df, *keys):
    return df.select(*keys, F.posexplode("vec").alias("dim", "value"))


def normalized(vec: str) -> str:
    return f"list_transform({vec}, lambda x: x/greatest(sqrt(list_sum(list_transform({vec}, lambda y: y::double*y::double))), 1e-8))"


def mean_sql(source: str, keys: str, dim: int = 64, vec: str = "vec") -> str:
    """Mean vector per key, dimension by dimension."""
    return f"""select {keys}, list(m order by dim) vec from (select {keys}, dim, avg(v) m from (select {keys},
 unnest(range({dim})) dim, unnest({vec}) v from {source}) group by all) group by all"""


# --- vector expressions ----------------------------------------------------------------------------------------

@query(
    "l2_norm", "series_id:i idx:i norm:d",
    "select series_id, idx, sqrt(list_sum(list_transform(vec, lambda x: x::double*x::double))) norm from features",
)
def _(spark, sf):
    return fx.features(spark, sf).select("series_id", "idx", arrays.l2_norm(F.col("vec")).alias("norm"))


@query(
    "l2_normalize", "series_id:i idx:i dim:i value:d",
    _LONG.format(keys="series_id, idx", n=64, vec=normalized("vec"),
                 source="(select series_id, idx, list_transform(vec, lambda x: x::double*(idx%3)) vec from features)"),
)
def _(spark, sf):
    """Every third vector is zero and stays zero."""
    rows = fx.features(spark, sf)
    rows = rows.withColumn("vec", F.transform("vec", lambda x: x.cast("double") * (F.col("idx") % 3)))
    return long(rows.withColumn("vec", arrays.l2_normalize(F.col("vec"))), "series_id", "idx")


def _vector_error(kind: str, part: str) -> None:
    @query(
        f"vector_error_{kind}", "series_id:i idx:i error:d",
        f"""select series_id, idx, list_avg(list_transform(range(1, 65), lambda i: {part.format('vec[65-i]')})) +
 list_avg(list_transform(range(1, 65), lambda i: {part.format('vec[i]/2')})) error from features""",
    )
    def _(spark, sf):
        rows = fx.features(spark, sf).withColumns({
            "mirror": F.reverse("vec"), "half": F.transform("vec", lambda x: x.cast("double") / 2)
        })
        return V.reconstruction_error(rows, "vec", "mirror", "half", kind)


_vector_error("l1", "abs(vec[i]::double-{}::double)")
_vector_error("l2", "pow(vec[i]::double-{}::double, 2)")


# --- pooling ---------------------------------------------------------------------------------------------------

@query(
    "crop_mean", "series_id:i snippet:i dim:i value:d",
    "select series_id, snippet, unnest(range(64)) dim, unnest(vec) value from ("
    + mean_sql("(select series_id, idx//5 snippet, vec from features)", "series_id, snippet") + ")",
)
def _(spark, sf):
    rows = fx.features(spark, sf).withColumn("snippet", F.expr("idx div 5"))
    return long(V.crop_mean(rows, ["series_id", "snippet"]), "series_id", "snippet")


POOLED = "select series_id, " + normalized("vec") + " vec from (" + mean_sql("features", "series_id", vec=normalized("vec")) + ")"


def pooled(spark, sf):
    return V.mean_pool_embeddings(fx.features(spark, sf).select("series_id", "vec"))


@query("mean_pool_embeddings", "series_id:i dim:i value:d", _LONG.format(keys="series_id", n=64, vec="vec", source="pooled"), pooled=POOLED)
def _(spark, sf):
    return long(pooled(spark, sf), "series_id")


def _temporal(length: int) -> None:
    @query(
        f"temporal_pool_{length}", "series_id:i bucket:i dim:i value:d",
        _LONG.format(keys="series_id, bucket", n=64, vec="vec", source="(" + mean_sql("cut", "series_id, bucket") + ")"),
        cut=f"""select series_id, bucket, vec from (select *, count(*) over (partition by series_id) n from features),
 (select unnest(range({length})) bucket) where idx >= (bucket*n)//{length}
 and idx < greatest((bucket*n)//{length}+1, ((bucket+1)*n)//{length})""",
    )
    def _(spark, sf):
        return long(V.temporal_pool(fx.features(spark, sf).select("series_id", "idx", "vec"), length), "series_id", "bucket")


_temporal(32)
_temporal(3)


@query(
    "score_signature", "series_id:i dim:i value:d",
    """select series_id, j dim, v/sqrt(sum(v*v) over (partition by series_id)) value from (select p.series_id, j,
 a.score*(1-(w-floor(w))) + b.score*(w-floor(w)) v from (select series_id, n, j, j*(n-1)/31.0::double w from
 (select series_id, count(*) n from scores group by 1), (select unnest(range(32)) j)) p
 join scores a on a.series_id=p.series_id and a.idx=floor(w)
 join scores b on b.series_id=p.series_id and b.idx=least(floor(w)+1, n-1))""",
)
def _(spark, sf):
    return long(V.score_signature(fx.scores(spark, sf)), "series_id")


@query(
    "weighted_mean", "series_id:i weighted:d",
    "select series_id, sum(score*w)/(sum(w)+1e-8) weighted from (select series_id, score, 1+idx%4 w from scores) group by 1",
)
def _(spark, sf):
    return V.weighted_mean(fx.scores(spark, sf).withColumn("w", 1 + F.col("idx") % 4), "score", "w")


@query(
    "mil_gate_score", "series_id:i gate_score:d",
    """select series_id, avg(score) gate_score from (select *, row_number() over (partition by series_id order by magnitude desc, idx) rn
 from (select series_id, idx, list_max(list_transform(vec, lambda x: abs(x)::double)) score, list_sum(list_transform(vec, lambda x: abs(x)::double)) magnitude
 from features)) where rn <= 3 group by 1""",
)
def _(spark, sf):
    size = F.aggregate("vec", F.lit(0.0), lambda a, x: a + F.abs(x).cast("double"))
    rows = fx.features(spark, sf).select(
        "series_id", "idx", F.array_max(F.transform("vec", lambda x: F.abs(x).cast("double"))).alias("score"), size.alias("magnitude")
    )
    return V.mil_gate_score(rows)


# --- retrieval -------------------------------------------------------------------------------------------------
# queries: series_id % 5 = 0 (series 0 has no frames: a zero vector); index: the others

_SPLIT = dict(
    pooled=POOLED,
    q="select series_id query_id, case when series_id=0 then list_transform(vec, lambda x: 0.0) else vec end vec from pooled where series_id%5=0",
    i="select series_id index_id, vec from pooled where series_id%5<>0",
)
_SIMS = """select query_id, row_number() over (partition by query_id order by sim desc, index_id) rank, index_id,
 case when query_id=0 then null else sim end sim from (select query_id, index_id, list_dot_product(q.vec, i.vec) sim from q, i)"""


def query_vectors(spark, sf):
    return pooled(spark, sf).filter("series_id % 5 = 0").select(
        F.col("series_id").alias("query_id"),
        F.when(F.col("series_id") == 0, F.transform("vec", lambda x: x * 0)).otherwise(F.col("vec")).alias("vec"),
    )


def index_vectors(spark, sf):
    return pooled(spark, sf).filter("series_id % 5 <> 0").select(F.col("series_id").alias("index_id"), "vec")


@query("topk_similar", "query_id:i rank:i index_id:i sim:d", "select * from (" + _SIMS + ") where rank <= 3", **_SPLIT)
def topk(spark, sf):
    return V.topk_similar(query_vectors(spark, sf), index_vectors(spark, sf))


@query(
    "topk_similar_frames", "query_id:i rank:i index_id:i sim:d",
    """select * from (select query_id, row_number() over (partition by query_id order by sim desc, index_id) rank, index_id, sim from (
 select a.vec_id query_id, b.vec_id index_id, list_dot_product(a.u, b.u) sim from unit a, unit b)) where rank <= 5""",
    unit="select vec_id, " + normalized("embedding") + " u from embeddings",
)
def _(spark, sf):
    """Single vectors instead of pooled ones: every row against the whole table."""
    unit = fx.table(spark, sf, "embeddings").select("vec_id", arrays.l2_normalize(F.col("embedding")).alias("vec"))
    return V.topk_similar(unit.withColumnRenamed("vec_id", "query_id"), unit.withColumnRenamed("vec_id", "index_id"), 5)


@query(
    "topk_sweep", "k:i query_id:i rank:i index_id:i sim:d",
    "select k, s.* from (" + _SIMS + ") s join (select unnest([1, 3, 5, 10]) k) on rank <= k", **_SPLIT,
)
def _(spark, sf):
    return V.topk_sweep(query_vectors(spark, sf), index_vectors(spark, sf), [1, 3, 5, 10])


@query(
    "encoder_sweep", "encoder:s k:i query_id:i rank:i index_id:i sim:d",
    """select encoder, k, query_id, rank, index_id, sim from (select encoder, query_id, row_number() over (partition by encoder, query_id
 order by sim desc, index_id) rank, index_id, sim from (select a.encoder, a.series_id query_id, b.series_id index_id,
 list_dot_product(a.vec, b.vec) sim from enc a join enc b on a.encoder=b.encoder and a.series_id%5=0 and b.series_id%5<>0))
 join (select unnest([1, 3]) k) on rank <= k""",
    pooled=POOLED,
    enc="select 'full' encoder, series_id, vec from pooled union all select 'half', series_id, " + normalized("vec[1:32]") + " from pooled",
)
def _(spark, sf):
    vecs = pooled(spark, sf)
    half = vecs.withColumn("vec", arrays.l2_normalize(F.slice("vec", 1, 32))).withColumn("encoder", F.lit("half"))
    both = vecs.withColumn("encoder", F.lit("full")).unionByName(half)
    asked = both.filter("series_id % 5 = 0").withColumnRenamed("series_id", "query_id")
    index = both.filter("series_id % 5 <> 0").withColumnRenamed("series_id", "index_id")
    return V.topk_sweep(asked, index, [1, 3], "encoder")

