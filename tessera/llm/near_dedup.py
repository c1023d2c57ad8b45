"""Near-duplicate documents by DartMinHash over weighted word shingles."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, text_or_empty
from .textnp import GOLDEN, grouped, mix, shingles, text_bytes, word_hashes

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 5
#: Pairs whose signatures agree less than this far below the similarity are not verified: over 4 deviations.
MARGIN = 0.15
MEMBERS_A_BLOCK = 2048
#: Upper ends of the rank cells: each dart has a rank in one; from the last on they are one wide.
CELLS = (1 / 64, 1 / 16, 1 / 4, 1 / 2, 1.0)


def elements(texts: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Weighted shingles as unit strips, with their text's index, ordered by text.

    A shingle that occurs ``w`` times has weight ``w``; its region over the weight
    axis is ``w`` strips one wide, each hashed by (shingle, number of the strip).
    The weighted Jaccard similarity of two texts is then that of their strip sets. A text of
    fewer words than a shingle is one shingle of all its words.
    """
    words, count = word_hashes(texts)
    h, ok = shingles(words, count, size)
    doc = np.repeat(np.arange(len(texts)), count)
    h, at = h[ok], doc[: len(ok)][ok]
    few = np.flatnonzero((count > 0) & (count < size))
    if len(few):
        begin = np.cumsum(count) - count
        extra = []
        for i in few:
            x = np.full(1, count[i], np.uint64)
            for j in range(begin[i], begin[i] + count[i]):
                x = mix(x * np.uint64(GOLDEN) + words[j : j + 1])
            extra.append(x[0])
        h, at = np.concatenate([h, np.array(extra, np.uint64)]), np.concatenate([at, few])
    order = np.lexsort((h, at))
    h, at = h[order], at[order]
    if not len(h):
        return h, at
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (at[1:] != at[:-1])))
    first = np.flatnonzero(new)
    strip = np.arange(len(h)) - np.repeat(first, np.diff(np.append(first, len(h))))
    return mix(h + strip.astype(np.uint64) * np.uint64(GOLDEN)), at


def dart_signatures(strips: np.ndarray, at: np.ndarray, texts: int, k: int) -> np.ndarray:
    """The earliest dart of each of ``k`` coordinates for every text; 0 for texts without strips.

    Each strip's region (one wide, ranks upward from 0) receives a Poisson process
    of darts of unit rate, hashed cell by cell of the rank axis: the number of darts
    in a cell, then each dart's coordinate and rank. Cells are thrown in ascending
    order and a text stops when all its coordinates are hit, so later darts can't
    be earlier. Equal strips throw equal darts in every text.
    """
    sig = np.zeros((texts, k), np.uint64)
    done = np.bincount(at, minlength=texts) == 0
    low, cell = 0.0, 0
    live, who = strips, at
    while len(live):
        high = CELLS[cell] if cell < len(CELLS) else low + 1.0
        mean = high - low
        seed = np.uint64((cell + 1) * GOLDEN & (1 << 64) - 1)
        u = (mix(live ^ seed) >> np.uint64(11)).astype(np.float64) / 2**53
        p = tail = math.exp(-mean)
        pick = np.flatnonzero(u > tail)
        n, darts = 0, []
        while len(pick):
            dart = mix(live[pick] + mix(np.array([seed + np.uint64(n)], np.uint64)))
            darts.append((who[pick], dart))
            n += 1
            p *= mean / n
            tail += p
            pick = pick[u[pick] > tail] if n < 40 else pick[:0]
        if darts:
            doc, dart = np.concatenate([d for d, _ in darts]), np.concatenate([d for _, d in darts])
            slot = doc * k + ((dart >> np.uint64(48)) % np.uint64(k)).astype(np.int64)
            free = sig.reshape(-1)[slot] == 0
            slot, dart = slot[free], dart[free]
            rank = dart & np.uint64((1 << 48) - 1)
            order = np.lexsort((rank, slot))
            slot, dart = slot[order], dart[order]
            first = np.concatenate(([True], slot[1:] != slot[:-1])) if len(slot) else np.zeros(0, bool)
            sig.reshape(-1)[slot[first]] = dart[first] | np.uint64(1)
            done |= (sig != 0).all(1)
            stay = ~done[who]
            live, who = live[stay], who[stay]
        low, cell = high, cell + 1
    return sig


def _describe(bands: int, rows: int, size: int):
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["m", "bands", "sig", "strips"]
        scale = [mix(np.array([i + 1], np.uint64))[0] | np.uint64(1) for i in range(rows)]
        for b in batches:
            m = b.column(0).to_numpy()
            texts = text_bytes(b.column(1))
            for group in grouped(texts):
                strips, at = elements([texts[i] for i in group], size)
                sig = dart_signatures(strips, at, len(group), bands * rows)
                r = sig.reshape(len(group), bands, rows)
                key = np.zeros((len(group), bands), np.uint64)
                for j in range(rows):
                    key += mix(r[:, :, j]) * scale[j]
                key = mix(key + np.arange(bands, dtype=np.uint64) * np.uint64(GOLDEN))
                many = np.bincount(at, minlength=len(group))
                full = many > 0
                cut = np.concatenate(([0], np.cumsum(many[full])))
                wide = lambda x, kind: pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel(), kind))
                if full.any():
                    yield pa.RecordBatch.from_arrays([
                        pa.array(m[np.asarray(group)[full]]), wide(key[full].view(np.int64), pa.int64()), wide((sig[full] >> np.uint64(32)).astype(np.uint32).view(np.int32), pa.int32()),
                        pa.ListArray.from_arrays(cut.astype(np.int32), pa.array((strips >> np.uint64(32)).astype(np.uint32).view(np.int32), pa.int32())),
                    ], names)

    return describe


def _verified(pairs: DataFrame, strips: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``(a, b)`` whose exact weighted Jaccard similarity is ``similarity`` or more."""
    x = strips.select(F.col("m").alias("a"), F.col("strips").alias("x"))
    y = strips.select(F.col("m").alias("b"), F.col("strips").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(x, "a").join(y, "b").where(both >= similarity * (F.size("x") + F.size("y") - both)).select("a", "b")


def _compare(bands: int, rows: int, similarity: float):
    """Links that join different components in two blocks of a bucket.

    Pairs of different components whose signatures agree enough are verified
    exactly here, so only a spanning forest of the links leaves the task.
    """

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        band, a, b = (int(pdf[c].iat[0]) for c in ("band", "a", "b"))
        left, right = pdf[pdf["block"] == a].sort_values("m"), pdf[pdf["block"] == b].sort_values("m")
        out: list[tuple[int, int]] = []
        if len(left) and len(right):
            sx, sy = np.stack(left["sig"].to_numpy()), np.stack(right["sig"].to_numpy())
            mx, my = left["m"].to_numpy(), right["m"].to_numpy()
            wx = [np.sort(x) for x in left["strips"]]
            wy = wx if a == b else [np.sort(x) for x in right["strips"]]
            names, both = np.unique(np.concatenate([left["component"], right["component"]]), return_inverse=True)
            part = np.arange(len(names))
            cx, cy = both[: len(mx)], both[len(mx) :]
            for i in range(len(mx)):
                js = np.flatnonzero((part[cy] != part[cx[i]]) & ((my > mx[i]) | (a != b)))
                if not len(js):
                    continue
                same = sy[js] == sx[i]
                # a pair that meets in an earlier band is compared there
                first = same[:, : band * rows].reshape(len(js), band, rows).all(2).any(1) if band else np.zeros(len(js), bool)
                agree = same.mean(1)
                ok = (agree >= similarity - MARGIN) & ~first
                js, agree = js[ok], agree[ok]
                for j in js[np.argsort(-agree, kind="stable")]:
                    if part[cy[j]] == part[cx[i]]:
                        continue
                    x, y = wx[i], wy[j]
                    if min(len(x), len(y)) < similarity * max(len(x), len(y)):
                        continue
                    at = np.searchsorted(y, x)
                    both_ = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                    if both_ >= similarity * (len(x) + len(y) - both_):
                        out.append((int(mx[i]), int(my[j])))
                        part[part == part[cy[j]]] = part[cx[i]]
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return compare


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row a document: ``doc_id, m, class_id, kept``; ``m`` is a hash of its text.

    ``docs(doc_id long, text)``; other columns are not read. Two texts link if the
    weighted Jaccard similarity of their ``size``-word shingles, weighted by their
    number of occurrences, is ``similarity`` or more. A class is a component of
    links; ``class_id`` is its smallest id and ``kept`` marks it.

    Copies of a text are one node. Signatures are banded; a bucket first compares
    its members with the one that meets most others over all bands (of a family of
    copies, the original), so a bucket of ``n`` gives ``n - 1`` pairs. Buckets that
    then still hold several components compare the members of different ones in
    blocks, by signature and then exactly, and return only links that join
    components. All links are verified by the exact similarity.

    Texts without words link with nothing. A null id counts as larger than others;
    its class is null, and it is kept, only where its class has no other id. Rows of an equal id
    and text are one document. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumn("m", F.xxhash64("text"))
    many = d.groupBy("m").agg(F.min("doc_id").alias("owner"), F.count("*").alias("n")).where("n > 1").select("m", "owner")
    many = scratch.table(many.coalesce(8), "copies")
    first = d.join(many, "m", "left").where(F.col("owner").isNull() | F.col("owner").eqNullSafe(F.col("doc_id"))).select("m", "text")
    rep = first.mapInArrow(_describe(bands, rows, size), "m long, bands array<long>, sig array<int>, strips array<int>")
    rep = scratch.table(rep, "reps")

    flat = rep.select("m", F.posexplode("bands").alias("band", "key")).distinct()
    sizes = flat.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    flat = scratch.table(flat.join(sizes, "key"), "buckets")
    meets = flat.groupBy("m").agg(F.sum("n").alias("meets"))
    flat = flat.join(meets, "m").select("m", "band", "key", "meets")
    pivot = flat.groupBy("key").agg(F.max(F.struct("meets", "m"))["m"].alias("pivot"))
    pairs = flat.join(pivot, "key").where("m <> pivot").select(F.greatest("m", "pivot").alias("a"), F.least("m", "pivot").alias("b")).distinct()
    pairs = scratch.table(pairs, "pairs")
    strips = rep.select("m", "strips").dropDuplicates(["m"])
    links = scratch.table(_verified(pairs, strips, similarity), "links0")
    parts = components(spark, links, scratch, "parts0")
    member = flat.join(parts, F.col("m") == F.col("id"), "left").select("m", "band", "key", F.coalesce("component", "m").alias("component"))
    member = scratch.table(member, "members")
    # a bucket of two has compared its pair
    mixed = member.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).where("lo <> hi and n > 2")
    blocks = F.ceil(F.col("n") / F.lit(float(MEMBERS_A_BLOCK))).cast("int")
    left = member.join(mixed.select("key", blocks.alias("blocks")), "key").withColumn("block", F.pmod(F.xxhash64("m"), F.col("blocks")).cast("int"))
    left = left.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    left = left.select("key", "band", "m", "component", "block", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"))
    left = left.join(rep.select("m", "sig", "strips"), "m")
    more = left.groupBy("key", "a", "b").applyInPandas(_compare(bands, rows, similarity), "a long, b long")
    links = scratch.table(links.union(more), "links1")
    scratch.free()
    parts = components(spark, links, scratch, "parts")

    meta = d.select("doc_id", "m", F.col("text").rlike(r"[^\x20\x09-\x0D]").alias("full"))
    meta = meta.join(parts, F.col("m") == F.col("id"), "left").select("doc_id", "m", "full", F.coalesce("component", "m").alias("component"))
    meta = scratch.table(meta, "classes")
    scratch.only("classes")
    low = meta.where("full").groupBy("component").agg(F.min("doc_id").alias("class_id"))
    words = meta.where("full").join(low, "component").select("doc_id", "m", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))
    none = meta.where("not full").select("doc_id", "m", F.col("doc_id").alias("class_id"), F.lit(True).alias("kept"))
    return words.union(none)


#: DuckDB SQL for the classes of ``near_duplicates``, where ids are unique: all pairs that share a shingle, compared exactly.
SQL = r"""
with recursive d as (select doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
u as (select t, any_value(w) w, min(doc_id) lo from d where len(w) > 0 group by t),
s as (select lo, md5(string_agg(x, ' ' order by j)) g from (select lo, i, w[i + j] x, j from (select lo, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) i from u) a, range(0, 5) b(j) where i + j <= len(w)) c group by lo, i),
k as (select lo, g, count(*) c from s group by 1, 2),
n as (select lo, sum(c) n from k group by 1),
f as (select g from k group by g having count(*) > 1),
pr as (select a.lo a, b.lo b, sum(least(a.c, b.c)) m from (select * from k semi join f using (g)) a join k b on a.g = b.g and a.lo < b.lo group by 1, 2),
links as (select a, b from pr join n x on x.lo = a join n y on y.lo = b where m >= 0.8 * (x.n + y.n - m)),
e as (select a, b from links union all select b, a from links),
r(id, c) as (select lo, lo from u union select e.b, r.c from r join e on e.a = r.id),
cls as (select id, min(c) c from r group by 1)
select doc_id, case when len(d.w) = 0 then doc_id else cls.c end as class_id, doc_id = case when len(d.w) = 0 then doc_id else cls.c end as kept
from d left join u on u.t = d.t left join cls on cls.id = u.lo
"""
