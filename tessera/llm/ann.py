"""Approximate nearest neighbours by a permutation index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

PIVOTS = 256
PREFIX = 64
#: So many distinct vectors of a shard are reranked: a share of its rows, and a number besides.
CANDIDATES, MORE_CANDIDATES = 0.15, 300
ROWS_A_SHARD = 16_384
QUERIES_A_BLOCK = 1024


def valid(embeddings: DataFrame) -> DataFrame:
    """Rows with an id whose vector is non-zero and has only finite components."""
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~odd & F.exists("embedding", lambda x: x != 0))


def nearest_pivots(x: np.ndarray, extra: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The ``prefix`` nearest pivots of each row, nearest first.

    Rows get one more component, so that the nearest by distance is the largest by
    inner product: ``sqrt(longest^2 - |x|^2)`` for indexed rows, 0 for queries.
    """
    d = (pivots**2).sum(1)[None, :] - 2 * (x @ pivots[:, :-1].T + extra[:, None] * pivots[None, :, -1])
    prefix = min(prefix, len(pivots))
    near = np.argpartition(d, prefix - 1, axis=1)[:, :prefix]
    return np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, 1), axis=1, kind="stable"), 1).astype(np.int16)


def _describe(pivots: np.ndarray, longest: float, prefix: int, query: bool):
    def describe(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            if len(pdf):
                x = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
                extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(longest**2 - (x**2).sum(1), 0))
                yield pdf.assign(perm=list(nearest_pivots(x, extra, pivots, prefix)))

    return describe


def search_shard(queries: pd.DataFrame, rows: pd.DataFrame, k: int, pivots: int, share: float, more: int) -> pd.DataFrame:
    """The best ``k`` of one shard for a block of queries.

    The shard's distinct vectors are posted under each of their pivots with their
    place. A query adds ``prefix - max(own place, posted place)`` for each posting it
    meets, which orders them exactly by the footrule distance of the truncated
    permutations; the best, with all that tie with the last, are ranked again by the
    exact inner product. Copies of a vector are expanded after that, smaller ids first.
    """
    rows = rows.sort_values("vec_id", kind="stable")
    every = np.stack(rows["embedding"].to_numpy()).astype(np.float64) + 0.0  # no negative zeros
    ids = rows["vec_id"].to_numpy()
    of = pd.factorize(np.array([v.tobytes() for v in every], object))[0]
    first, copies = np.unique(of, return_index=True, return_counts=True)[1:]
    held, start = ids[np.argsort(of, kind="stable")], np.cumsum(copies) - copies
    x, perm = every[first], np.stack(rows["perm"].to_numpy()[first]).astype(np.int64)
    prefix = perm.shape[1]
    order = np.argsort(perm.ravel(), kind="stable")
    posted, place = (order // prefix).astype(np.int32), (prefix - order % prefix).astype(np.int16)
    begin = np.searchsorted(perm.ravel()[order], np.arange(pivots + 1))
    take = min(len(x), more + int(np.ceil(share * len(ids))))
    out = []
    for q, v, own in zip(queries["vec_id"], queries["embedding"], queries["perm"]):
        near = np.zeros(len(x), np.int32)
        for i, p in enumerate(own):
            a, b = begin[p], begin[p + 1]
            near[posted[a:b]] += np.minimum(place[a:b], prefix - i)
        best = np.flatnonzero(near >= np.partition(near, len(x) - take)[len(x) - take])
        same = of[np.searchsorted(ids, q) : np.searchsorted(ids, q, "right")]  # the query's own rows
        others = copies.copy()
        np.subtract.at(others, same, 1)
        best = best[others[best] > 0]
        score = (x[best] * np.asarray(v, np.float64)).sum(1)
        if others[best].sum() > k:  # all that tie with the k-th row stay
            down = np.argsort(-score)
            last = score[down[np.searchsorted(np.cumsum(others[best[down]]), k)]]
            best, score = best[score >= last], score[score >= last]
        found = [held[start[g] : start[g] + min(copies[g], k + len(same))] for g in best]
        found = [f[f != q][:k] for f in found]
        found, score = np.concatenate([ids[:0], *found]), np.repeat(score, [len(f) for f in found])
        top = np.lexsort((found, -score))[:k]
        out.append(pd.DataFrame({"query_id": q, "vec_id": found[top], "score": score[top]}))
    return pd.concat(out, ignore_index=True)


def search(embeddings: DataFrame, queries: DataFrame, k: int = 20, pivots: int = PIVOTS, prefix: int = PREFIX, share: float = CANDIDATES, more: int = MORE_CANDIDATES) -> DataFrame:
    """The ``k`` rows with the largest inner product found for each query: ``query_id, rank, vec_id, score``.

    Both frames are ``(vec_id long, embedding array<float or double>)`` of one
    dimension; other columns are not read. The index: ``pivots`` rows (the
    smallest by a hash of the id, the only sample) are its pivots; every row is
    described by its ``prefix`` nearest pivots in order and posted under them, in
    shards of about ``ROWS_A_SHARD`` rows. Queries go in blocks against each shard,
    ``more`` distinct vectors and as many as ``share`` of a shard's rows are ranked by the
    exact product, and the shards' best are merged.

    Vectors that are null, zero or hold null or non-finite components take no
    part, nor do null ids; a query without candidates has no rows; ties go to the smaller id;
    a repeated row is another candidate, unless it has the query's id; empty
    tables give an empty result.
    """
    spark = embeddings.sparkSession
    scratch = Scratch(spark, "ann")
    rows = valid(embeddings.select("vec_id", "embedding"))
    base = scratch.table(rows, "rows")
    size = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    n, longest = base.agg(F.count("*"), F.max(size)).first()
    chosen = base.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).collect()  # at most `pivots` rows
    out = "query_id long, vec_id long, score double"
    if not chosen:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    p = np.array([r["embedding"] for r in chosen], dtype=np.float64)
    p = np.hstack([p, np.sqrt(np.maximum(longest**2 - (p**2).sum(1), 0))[:, None]])
    schema = "vec_id long, embedding array<double>, perm array<smallint>"
    cast = [F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")]
    asked = valid(queries.select("vec_id", "embedding")).select(*cast)
    shards = max(1, -(-n // ROWS_A_SHARD))
    asked = scratch.table(asked.mapInPandas(_describe(p, longest, prefix, True), schema), "asked")
    blocks = max(1, -(-asked.count() // QUERIES_A_BLOCK))
    deal = lambda name, n: F.pmod(F.xxhash64(F.lit(name), F.monotonically_increasing_id()), F.lit(n)).cast("int")
    index = base.select(*cast).mapInPandas(_describe(p, longest, prefix, False), schema)
    index = scratch.table(index, "index").withColumn("shard", deal("shard", shards))
    scratch.only("asked", "index")
    index = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = asked.withColumn("block", deal("block", blocks)).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def pair(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(r):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return search_shard(q, r, k, len(p), share, more)

    found = asked.groupBy("shard", "block").cogroup(index.groupBy("shard", "block")).applyInPandas(pair, out)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def exact_search(embeddings: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """The same by brute force, for measuring recall on a small table."""
    return search(embeddings, queries, k, pivots=1, prefix=1, share=1.0)
