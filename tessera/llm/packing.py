"""Best-fit packing of documents into fixed-size bins under conflict constraints."""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, word_count

CAPACITY = 4096
SOURCE_LIMIT = 4
ROWS_A_GROUP = 8192
SCHEMA = "doc_id long, piece long, start long, size long, bin_id long, offset long"


def fit(items: list[tuple[int, int, int]], capacity: int, source_limit: int = SOURCE_LIMIT) -> list[tuple[int, int]]:
    """Bin and offset of each ``(size, source, cluster)``, taken in the given order.

    Open bins are kept ordered by residual. A bin carries two bitmaps: the
    clusters it holds, and ``source_limit`` bits a source, set from the lowest. An
    item goes to the successor of its size among the residuals; while that bin
    holds the item's cluster, or its source as often as allowed, the search moves
    to the next larger residual. Without a compatible bin a new one opens.
    """
    order: list[tuple[int, int]] = []
    sources: list[int] = []
    clusters: list[int] = []
    out = []
    full = source_limit - 1
    for size, source, cluster in items:
        at, top, bit = bisect_left(order, (size, -1)), 1 << (source * source_limit + full), 1 << cluster
        while at < len(order) and (clusters[order[at][1]] & bit or sources[order[at][1]] & top):
            at += 1
        if at < len(order):
            left, b = order.pop(at)
        else:
            left, b = capacity, len(sources)
            sources.append(0)
            clusters.append(0)
        clusters[b] |= bit
        held = sources[b] >> (source * source_limit)
        sources[b] |= ((held & (top >> (source * source_limit)) - 1) + 1 | held) << (source * source_limit) if source_limit > 1 else top
        out.append((b, capacity - left))
        if left > size:
            insort(order, (left - size, b))
    return out


def _pack(capacity: int, source_limit: int):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        # equal rows are interchangeable, so this order gives the same bins on every run
        pdf = pdf.assign(rest=pdf["size"] % capacity).sort_values(["rest", "doc_id", "source", "cluster", "size", "m"], ascending=[False, True, True, True, True, True], na_position="last", kind="stable")
        base = int(pdf["group"].iat[0]) << 32
        source = pd.factorize(pdf["source"], use_na_sentinel=False)[0]
        cluster = pd.factorize(pdf["cluster"], use_na_sentinel=False)[0]
        ids = [None if pd.isna(x) else int(x) for x in pdf["doc_id"]]
        rest, size = pdf["rest"].tolist(), pdf["size"].tolist()
        keep = [i for i, r in enumerate(rest) if r]
        bins = fit([(rest[i], int(source[i]), int(cluster[i])) for i in keep], capacity, source_limit)
        n = max((b for b, _ in bins), default=-1) + 1
        for i in range(len(ids)):
            for piece in range(size[i] // capacity):  # whole pieces fill a bin of their own
                rows.append((ids[i], piece, piece * capacity, capacity, base + n, 0))
                n += 1
            if not size[i]:
                rows.append((ids[i], 0, 0, 0, None, None))
        for i, (b, offset) in zip(keep, bins):
            piece = size[i] // capacity
            rows.append((ids[i], piece, piece * capacity, rest[i], base + b, offset))
        out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "size", "bin_id", "offset"])
        return out.astype({"doc_id": "Int64", "bin_id": "Int64", "offset": "Int64"})

    return pack


def pack(docs: DataFrame, cluster=None, capacity: int = CAPACITY, source_limit: int = SOURCE_LIMIT) -> DataFrame:
    """Bins of at most ``capacity`` words: ``doc_id, piece, start, size, bin_id, offset``.

    ``docs(doc_id, text, source)``; other columns are read only if ``cluster`` (a
    column; by default a hash of the text, so exact copies) names them. A bin
    holds at most one piece of a duplicate cluster and ``source_limit`` pieces of
    a source. A document longer than a bin is cut into whole bins and a rest
    piece; ``start`` is the piece's first word, ``offset`` its place in the bin.
    Rows are dealt into groups of about ``ROWS_A_GROUP`` by a hash of their id and text,
    and each group is packed by decreasing rest size, so no source, cluster or id
    makes a task larger, and the bins don't depend on how the table is partitioned. No bin
    crosses a group.

    Null or empty text gives one row of size 0 without a bin; null ids, null
    sources (one source) and repeated rows (one cluster) are packed like others;
    an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "pack")
    cluster = F.xxhash64(F.coalesce("text", F.lit(""))) if cluster is None else cluster
    m = F.xxhash64(F.coalesce("text", F.lit("")))
    d = docs.select("doc_id", "source", cluster.cast("long").alias("cluster"), m.alias("m"), word_count(F.col("text")).alias("size"))
    # equal rows are counted, then numbered, so that they are dealt apart in the same way on every run
    d = d.groupBy("doc_id", "source", "cluster", "m", "size").agg(F.count("*").alias("rows"))
    d = scratch.table(d, "items")
    groups = max(1, -(-(d.agg(F.sum("rows")).first()[0] or 0) // ROWS_A_GROUP))
    d = d.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    d = d.withColumn("group", F.pmod(F.xxhash64("doc_id", "m", "row"), F.lit(groups))).drop("rows", "row")
    return d.groupBy("group").applyInPandas(_pack(capacity, source_limit), SCHEMA)
