"""Near-duplicate embeddings by collision-counting projections."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ann import valid
from .common import Scratch, components

COSINE = 0.93
PROJECTIONS = 32
RECALL = 0.99999
ROWS_A_BLOCK = 4096


def directions(dim: int, n: int = PROJECTIONS, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, n))


def calibrate(cosine: float, n: int = PROJECTIONS, recall: float = RECALL) -> tuple[float, int, float]:
    """Half-width of a window, least number of collisions, and reach of the first projection.

    Unit vectors with that cosine are ``d = sqrt(2 - 2 cosine)`` apart, so their
    projections on a Gaussian direction differ by a normal variable of deviation
    ``d``. With half-width ``d`` a projection collides with probability 0.683; the
    least number is the largest that a binomial count reaches with probability
    ``recall``, and nearer pairs collide oftener. The reach is the window that the
    first projection alone keeps with probability ``recall``.
    """
    d = math.sqrt(max(0.0, 2 - 2 * cosine))
    p = math.erf(1 / math.sqrt(2))
    tail, least = 0.0, n
    for c in range(n + 1):
        tail += math.comb(n, c) * p**c * (1 - p) ** (n - c)
        if tail > 1 - recall:
            least = c
            break
    reach = 1.0
    while math.erf(reach / math.sqrt(2)) < recall:
        reach += 0.01
    return d, least, reach * d


def link_blocks(x: np.ndarray, y: np.ndarray | None, many_x: np.ndarray, many_y: np.ndarray, cosine: float, dirs: np.ndarray):
    """Links within a block (``y`` None) or between two: counts for both sides, and edges of a spanning forest.

    Each projection of the second block is sorted once. A vector's windows are
    slices of those orders; its collisions are counted per partner, and partners
    with enough are verified by the cosine in double precision. Linked partners
    are only counted and joined in a local forest, never listed.
    """
    half, least, _ = calibrate(cosine, dirs.shape[1])
    own = y is None
    y, many_y = (x, many_x) if own else (y, many_y)
    px, py = x @ dirs, y @ dirs
    order = np.argsort(py, axis=0, kind="stable")
    ranks = np.take_along_axis(py, order, 0)
    lo = np.stack([np.searchsorted(ranks[:, k], px[:, k] - half, "left") for k in range(px.shape[1])], 1)
    hi = np.stack([np.searchsorted(ranks[:, k], px[:, k] + half, "right") for k in range(px.shape[1])], 1)
    order = np.ascontiguousarray(order.T)
    count_x, count_y = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
    tree = np.arange(len(x) + (0 if own else len(y)))
    edges = []
    for i in range(len(x)):
        hits = np.zeros(len(y), np.uint8)
        for k in range(len(order)):
            hits[order[k, lo[i, k] : hi[i, k]]] += 1
        js = np.flatnonzero(hits >= least)
        js = js[js > i] if own else js
        js = js[(y[js] * x[i]).sum(1) >= cosine]
        if len(js):
            count_x[i] += many_y[js].sum()
            count_y[js] += many_x[i]
            at = js if own else js + len(x)
            for other in np.unique(tree[at]):
                if other != tree[i]:
                    edges.append((i, int(js[np.flatnonzero(tree[at] == other)[0]])))
                    tree[tree == other] = tree[i]
    if own:
        count_x = count_x + count_y
        count_y = count_y[:0]
    return count_x, count_y, edges


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE, projections: int = PROJECTIONS) -> DataFrame:
    """One row a vector: ``vec_id, n_links, component_id, kept``.

    ``embeddings(vec_id long, embedding array<float or double>, label)`` of one
    dimension; other columns are not read. Two vectors link if their labels are equal and not null and
    their cosine, in double precision, is ``cosine`` or more. ``component_id`` is the
    smallest id reachable by links, ``kept`` marks it.

    Equal vectors of a label meet in one representative with a count. The
    representatives of a label are cut into blocks by quantiles of their first
    projection; pairs of blocks closer than the calibrated reach go to one task
    each, so a label is never one task and no task lists its links: it returns
    counts and a spanning forest.

    Vectors that are null, zero or hold null or non-finite components, and null
    labels, link with nothing: 0 links, their own component. A null id links with
    nothing and has a null component and is kept. Repeated rows count as other
    vectors with the same id. An empty table gives an empty result.
    """
    spark = embeddings.sparkSession
    scratch = Scratch(spark, "embed")
    src = embeddings.select("vec_id", "embedding", "label")
    ok = scratch.table(valid(src).where("label is not null").withColumn("same", F.xxhash64("label", "embedding")), "valid")
    first = ok.first()
    alone = src.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if first is None:
        return alone.withColumn("kept", F.lit(True))
    dirs = directions(len(first["embedding"]), projections)
    reach = calibrate(cosine, projections)[2]
    reps = ok.groupBy("label", "same", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("many"))

    def project(it):
        for pdf in it:
            if len(pdf):
                x = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
                x /= np.sqrt((x**2).sum(1))[:, None]
                yield pdf.assign(unit=list(x), first=x @ dirs[:, 0]).drop(columns=["embedding"])

    kind = embeddings.schema["label"].dataType.simpleString()
    reps = reps.select("label", "same", "rep", "many", F.col("embedding").cast("array<double>").alias("embedding"))
    reps = reps.mapInPandas(project, f"label {kind}, same long, rep long, many long, unit array<double>, first double")
    reps = scratch.table(reps, "reps")
    cuts = reps.groupBy("label").agg(F.count("*").alias("n"), F.percentile_approx("first", F.array(*[F.lit(i / 256) for i in range(257)]), 10_000).alias("q"))
    # block k of a label holds the quantiles from k / blocks to (k + 1) / blocks; labels of over 256 blocks salt within them
    blocks = F.ceil(F.col("n") / F.lit(float(ROWS_A_BLOCK))).cast("int")
    slabs = F.least(blocks, F.lit(256))
    edge = F.transform(F.sequence(F.lit(1), F.greatest(slabs, F.lit(1))), lambda k: F.element_at("q", F.floor(k * 256 / slabs).cast("int") + 1))
    low = F.transform(F.sequence(F.lit(1), F.greatest(slabs, F.lit(1))), lambda k: F.element_at("q", F.floor((k - 1) * 256 / slabs).cast("int") + 1))
    cuts = scratch.table(cuts.select("label", slabs.alias("slabs"), F.ceil(blocks / slabs).cast("int").alias("salts"), edge.alias("edge"), low.alias("low")).coalesce(1), "cuts")
    r = reps.join(cuts, "label")
    slab = F.least(F.size(F.filter("edge", lambda e: e < F.col("first"))), F.col("slabs") - 1)
    r = r.withColumn("slab", slab).withColumn("block", F.col("slab") * F.col("salts") + F.pmod(F.xxhash64("rep"), F.col("salts")).cast("int"))
    near = F.filter(
        F.sequence(F.lit(0), F.col("slabs") * F.col("salts") - 1),
        lambda o: (F.element_at("low", (o / F.col("salts")).cast("int") + 1) <= F.element_at("edge", F.col("slab") + 1) + reach)
        & (F.element_at("edge", (o / F.col("salts")).cast("int") + 1) >= F.element_at("low", F.col("slab") + 1) - reach),
    )
    r = r.withColumn("other", F.explode(near)).select("label", "same", "rep", "many", "unit", "block", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"))

    def pair(key, pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = int(key[1]), int(key[2])
        left = pdf[pdf["block"] == a].sort_values(["rep", "same"])
        x, ids, many = np.stack(left["unit"].to_numpy()) if len(left) else None, left["rep"].to_numpy(), left["many"].to_numpy()
        if a == b:
            y, other, many_y = None, ids, many
        else:
            right = pdf[pdf["block"] == b].sort_values(["rep", "same"])
            if not len(right) or not len(left):
                return pd.DataFrame({"kind": [], "same": [], "a": [], "b": []})
            y, other, many_y = np.stack(right["unit"].to_numpy()), right["rep"].to_numpy(), right["many"].to_numpy()
        cx, cy, edges = link_blocks(x, y, many, many_y, cosine, dirs)
        same = left["same"].to_numpy()
        parts = [pd.DataFrame({"kind": 0, "same": same[cx > 0], "a": ids[cx > 0], "b": cx[cx > 0]})]
        if a != b:
            parts.append(pd.DataFrame({"kind": 0, "same": right["same"].to_numpy()[cy > 0], "a": other[cy > 0], "b": cy[cy > 0]}))
        parts.append(pd.DataFrame({"kind": 1, "same": 0, "a": [int(ids[i]) for i, _ in edges], "b": [int(other[j]) for _, j in edges]}))
        return pd.concat(parts, ignore_index=True)

    found = scratch.table(r.groupBy("label", "a", "b").applyInPandas(pair, "kind long, same long, a long, b long"), "found")
    links = found.where("kind = 0").groupBy("same").agg(F.sum("b").alias("links"))
    parts = components(spark, found.where("kind = 1").select("a", "b"), scratch)
    reps = scratch.table(
        reps.select("same", "rep", "many").join(links, "same", "left").join(parts, F.col("rep") == F.col("id"), "left")
        .select("same", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "result",
    )
    scratch.only("valid", "result")
    linked = ok.select("vec_id", "same").join(reps, "same").select("vec_id", "n_links", "component_id")
    # the rest: rows that took no part
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    took = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~odd & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rest = src.where(~took).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


#: DuckDB SQL for ``near_duplicates``, where ids are unique and not null.
SQL = """
with recursive v as (select vec_id, label, embedding::double[] e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
n as (select *, sqrt(list_dot_product(e, e)) l from v),
links as (select a.vec_id a, b.vec_id b from n a join n b on a.label = b.label and a.vec_id <> b.vec_id where list_dot_product(a.e, b.e) / (a.l * b.l) >= 0.93),
r(id, c) as (select vec_id, vec_id from embeddings union select links.b, r.c from r join links on links.a = r.id),
k as (select a, count(*) n from links group by 1)
select id as vec_id, coalesce(any_value(k.n), 0)::bigint as n_links, min(c) as component_id, id = min(c) as kept from r left join k on k.a = r.id group by id
"""
