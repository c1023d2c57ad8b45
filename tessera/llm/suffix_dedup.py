"""Exact repeated substrings by difference-cover suffix sorting."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, text_or_empty
from .textnp import grouped, mix, powers, text_bytes

LENGTH = 200
GRAM = 32
SHARD_BYTES = 1_000_000
#: A key with more different segments than this is split into its single strings.
HOT = 2000
#: Strings whose anchors are found at once: with their places they fit the low bits of a hash.
SLICE = 1 << 22
_BASE = 0x2545F4914F6CDD1D
_UP = _DOWN = powers(1, _BASE)


def _prefix(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of a polynomial hash, and the factors that undo positions."""
    global _UP, _DOWN
    if len(data) + 1 > len(_UP):
        n = 1 << (len(data) + 1).bit_length()
        _UP, _DOWN = powers(n, _BASE), powers(n, pow(_BASE, -1, 1 << 64))
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum((data + np.uint64(1)) * _UP[: len(data)], out=total[1:])
    return total, _DOWN


def _hash(total: np.ndarray, down: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((total[end] - total[begin]) * down[begin])


def segments(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Segments of concatenated texts: key, segment hash, first string's start, number of strings.

    A string's anchor is its ``gram`` of the smallest mixed hash, the first of
    equals: it depends on the string alone. Strings in a row with one anchor are a
    segment, the key is the anchor's hash.
    """
    n = len(data) - length + 1
    if n <= 0:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2
    total, down = _prefix(data)
    grams = len(data) - gram + 1
    key = mix((total[gram:] - total[:grams]) * down[:grams])
    low = np.uint64(2 * SLICE - 1)  # the same bits for every text, so that equal strings have equal anchors
    best = (mix(key) & ~low) | np.arange(grams, dtype=np.uint64)
    width, need = 1, length - gram + 1
    while width * 2 <= need:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    rest = need - width
    best = np.minimum(best[: len(best) - rest], best[rest:]) if rest else best
    at = (best & low).astype(np.int64)
    inside = np.zeros(n, bool)
    begin = np.concatenate(([0], ends[:-1]))
    for b, e in zip(begin, ends):
        inside[b : max(b, e - length + 1)] = True
    new = np.concatenate(([True], (at[1:] != at[:-1]) | (inside[1:] != inside[:-1])))
    first = np.flatnonzero(new)
    many = np.diff(np.append(first, n))
    ok = inside[first]
    first, many = first[ok], many[ok]
    whole = _hash(total, down, first, first + many + length - 1)
    whole = mix(whole ^ mix((at[first] - first).astype(np.uint64) * np.uint64(1 << 20) + many.astype(np.uint64)))
    return key[at[first]], whole, first, many


def _scan(length: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m, texts = b.column(0).to_numpy(), text_bytes(b.column(1))
            for group in grouped(texts):
                ends = np.cumsum([len(texts[i]) for i in group])
                data = np.frombuffer(b"".join(texts[i] for i in group), np.uint8)
                for lo in range(0, max(1, len(data)), SLICE):  # a longer text goes in slices that share a string's bytes
                    part = data[lo : lo + SLICE + length - 1]
                    key, whole, first, many = segments(part, np.clip(ends - lo, 0, len(part)), length)
                    if not len(key):
                        continue
                    first = first + lo
                    doc = np.searchsorted(ends, first, "right")
                    start = first - np.concatenate(([0], ends[:-1]))[doc]
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(m[np.asarray(group)[doc]]), pa.array(start), pa.array(many)], ["key", "f", "m", "start", "n"])

    return scan


def suffix_ranks(s: np.ndarray) -> np.ndarray:
    """Ranks of the suffixes of ``s`` (values of 1 or more).

    Difference cover of period 3: the suffixes at 1 and 2 modulo 3 are named by
    their sorted triples, and ranked by recursion on the string of names, each
    level covering three times the letters, until names differ. The suffixes at 0 modulo 3 are sorted by their letter and the rank
    after it, and merged with the sample by the rank one or two letters on.
    """
    n = len(s)
    if n < 3:
        keys = [tuple(s[i:].tolist()) for i in range(n)]
        order = sorted(set(keys))
        return np.array([order.index(k) for k in keys], np.int64)
    p = np.concatenate((s, np.zeros(3, s.dtype))).astype(np.int64)
    one, two, zero = np.arange(1, n, 3), np.arange(2, n, 3), np.arange(0, n, 3)
    sample = np.concatenate((one, two))
    a, b, c = p[sample], p[sample + 1], p[sample + 2]
    top = int(p.max()) + 1
    if top < 1 << 21:
        triple = (a * top + b) * top + c
    else:
        pair = np.unique(a * top + b, return_inverse=True)[1]
        triple = pair * top + c
    names = np.unique(triple, return_inverse=True)[1] + 1
    if names.max() < len(names):
        # the strings of both residues, apart, as one string of names
        names = suffix_ranks(np.concatenate((names[: len(one)], [0], names[len(one) :])) + 1)
        names = np.delete(names, len(one)) + 1
    rank = np.zeros(n + 3, np.int64)
    rank[sample] = names
    size = int(rank.max()) + 1
    key0 = p[zero] * size + rank[zero + 1]
    order0 = np.argsort(key0, kind="stable")
    def ordered(x):
        return x[np.argsort(rank[x], kind="stable")]
    one, two = ordered(one), ordered(two)
    pairs = p[np.concatenate((zero, two))] * top + p[np.concatenate((zero, two)) + 1]
    dense = np.unique(pairs, return_inverse=True)[1]
    key0b, key2 = dense[: len(zero)] * size + rank[zero + 2], dense[len(zero) :] * size + rank[two + 2]
    key1 = p[one] * size + rank[one + 1]
    z = zero[order0]
    place0 = np.arange(len(z)) + np.searchsorted(key1, key0[order0], "left") + np.searchsorted(key2, key0b[order0], "left")
    order = np.full(n, -1, np.int64)
    order[place0] = z
    order[order < 0] = sample[np.argsort(rank[sample], kind="stable")]
    out = np.empty(n, np.int64)
    out[order] = np.arange(n)
    return out


def repeated(parts: list[bytes], many: list[int], length: int = LENGTH) -> list[np.ndarray]:
    """For each part, which of its first ``many`` strings of ``length`` bytes also start elsewhere in the parts."""
    data = np.frombuffer(b"".join(x + b"\0" for x in parts), np.uint8)
    begin = np.cumsum([0] + [len(x) + 1 for x in parts])
    letters = data.astype(np.int64) + 2
    letters[begin[1:] - 1] = 1
    rank = suffix_ranks(letters)
    start = np.concatenate([np.arange(b, b + k) for b, k in zip(begin, many)]) if parts else np.zeros(0, np.int64)
    order = start[np.argsort(rank[start], kind="stable")]
    same = np.zeros(max(0, len(order) - 1), bool)
    step = np.arange(length)
    for i in range(0, len(same), 20_000):  # neighbours in suffix order, byte by byte
        j = order[i : i + 20_001]
        rows = data[j[:, None] + step]
        same[i : i + len(j) - 1] = (rows[1:] == rows[:-1]).all(1)
    hit = np.zeros(len(data), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    return [hit[b : b + k] for b, k in zip(begin, many)]


def _runs(hit: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), (edge[1::2] - edge[::2]).tolist()))


def _cut(length: int):
    """Bytes of the segments that a text stands for, or the hashes of the strings of hot ones."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for m, text, segs in zip(b.column(0).to_pylist(), text_bytes(b.column(1)), b.column(2).to_pylist()):
                for s in segs:
                    part = text[s["start"] : s["start"] + s["n"] + length - 1]
                    if s["hot"]:
                        total, down = _prefix(np.frombuffer(part, np.uint8))
                        i = np.arange(s["n"])
                        rows += [(int(h), s["f"], s["many"], m, s["start"] + k, 1, None) for k, h in enumerate(_hash(total, down, i, i + length).view(np.int64))]
                    else:
                        rows.append((s["key"], s["f"], s["many"], m, s["start"], s["n"], part))
            cols = list(zip(*rows)) or [()] * 7
            kinds = [pa.int64()] * 6 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["key", "f", "many", "m", "start", "n", "part"])

    return cut


def _sort_shard(length: int):
    def sort_shard(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["key", "f"]).sort_values(["key", "f"])
        out = []
        for m, start, many, hit in zip(pdf["m"], pdf["start"], pdf["many"], repeated(pdf["part"].tolist(), pdf["n"].tolist(), length)):
            if many == 1:
                out += [(m, start + a, k) for a, k in _runs(hit)]
        return pd.DataFrame(out, columns=["m", "start", "n"]).astype("int64")

    return sort_shard


def _finish(length: int):
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, runs in zip(text_bytes(b.column(1)), b.column(2).to_pylist()):
                kept, spans, at, gone = [], 0, 0, 0
                last = None
                for r in sorted(runs or [], key=lambda r: (r["start"], r["n"])):
                    a, z = r["start"], r["start"] + r["n"] + length - 1
                    if last is None or a > last:
                        spans += 1
                        kept.append(text[at:a])
                        gone += z - a
                        last = z
                    elif z > last:
                        gone += z - last
                        last = z
                    at = last
                kept.append(text[at:])
                rest = b"".join(kept)
                rows.append((len(text), gone, spans, hashlib.sha256(rest).hexdigest(), rest))
            c = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, k) for x, k in zip(c, [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return finish


def remove_repeated_bytes(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Each text without the bytes of ``length``-byte strings that also start elsewhere.

    ``docs(doc_id long, text)``; other columns are not read. Returns ``doc_id, n_bytes,
    n_removed, n_spans, kept_sha256`` and ``kept``, the remaining bytes; one row an
    input row. Strings never cross texts; overlapping ones count; all copies go.

    Exact reduction first: strings are cut into segments that share an anchor, and
    equal strings lie in segments of equal keys. A segment that occurs twice as a
    whole is settled; a key with one segment is out. One copy of each different
    segment of the other keys is left. They are dealt by key into shards of bounded
    bytes, and each shard's suffixes are sorted by the difference-cover algorithm and
    compared with their neighbours. A key with over ``HOT`` different segments (the
    edge of a passage that very many texts share) isn't sorted in one task: its
    strings are counted by their hash over all tasks.

    Null text is empty; null ids and repeated rows (each a text of its own) stay; an
    empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "suffix")
    d = docs.select("doc_id", text_or_empty().alias("text")).withColumn("m", F.xxhash64("text"))
    found = scratch.table(d.select("m", "text").mapInArrow(_scan(length), "key long, f long, m long, start long, n long"), "segments")
    each = found.groupBy("key", "f").agg(F.count("*").alias("many"), F.min(F.struct("m", "start", "n")).alias("at"))
    each = scratch.table(each, "each")
    scratch.free()
    keys = each.groupBy("key").agg(F.count("*").alias("kinds")).where("kinds > 1")
    open_ = each.join(keys, "key").select("key", "f", "many", "kinds", "at.m", "at.start", "at.n")
    open_ = scratch.table(open_, "open")
    scratch.free()
    twice = each.where("many > 1").select("key", "f")
    done = scratch.table(found.join(twice, ["key", "f"]).select("m", "start", "n").distinct(), "settled")
    scratch.drop("segments", "each")
    scratch.free()
    todo = open_.groupBy("m").agg(F.collect_list(F.struct("key", "f", "many", "start", "n", (F.col("kinds") > HOT).alias("hot"))).alias("segs"))
    parts = d.select("m", "text").join(todo, "m").select("m", "text", "segs").mapInArrow(_cut(length), "key long, f long, many long, m long, start long, n long, part binary")
    parts = scratch.table(parts, "parts")
    scratch.drop("open")
    scratch.free()
    size = parts.agg(F.sum(F.length("part"))).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))
    cold = parts.where("part is not null").withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    sorted_ = cold.groupBy("shard").applyInPandas(_sort_shard(length), "m long, start long, n long")
    hot = parts.where("part is null").select("key", "f", "many", "m", "start", "n").distinct()
    often = hot.groupBy("key").agg(F.sum("many").alias("times")).where("times > 1").select("key")
    hot = hot.where("many = 1").join(often, "key").select("m", "start", "n")
    runs = done.union(sorted_).union(hot).groupBy("m").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    runs = scratch.table(runs, "runs")
    scratch.drop("parts", "settled")
    scratch.free()
    out = d.join(runs, "m", "left").select("doc_id", "text", "runs")
    return out.mapInArrow(_finish(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


#: DuckDB SQL for ``remove_repeated_bytes``: every string of 200 bytes counted. Texts are read in pieces of 4096 starts.
SQL = r"""
with d as (select doc_id, row_number() over () rid, encode(coalesce(text, '')) b from documents),
blocks as (select rid, unnest(range(0, octet_length(b), 4096)) o from d where octet_length(b) >= 200),
piece as (select rid, o, array_slice(b, o + 1, o + 4096 + 199) p from blocks join d using (rid)),
w as (select rid, o + i as i, md5(array_slice(p, i + 1, i + 200)) k from (select rid, o, p, unnest(range(0, least(4096, octet_length(p) - 199))) i from piece where octet_length(p) >= 200) x),
c as (select k from w group by k having count(*) > 1),
g as (select rid, i, sum(case when i - prev <= 200 then 0 else 1 end) over (partition by rid order by i) s from (select rid, i, lag(i) over (partition by rid order by i) prev from w semi join c using (k)) x),
sp as (select rid, min(i) a, max(i) + 200 z from g group by rid, s),
q as (select rid, a, z, coalesce(lag(z) over (partition by rid order by a), 0) pz from sp),
r as (select rid, sum(z - a)::bigint gone, count(*) n, string_agg(hex(array_slice(b, pz + 1, a)), '' order by a) || hex(array_slice(any_value(b), max(z) + 1, octet_length(any_value(b)))) kept from q join d using (rid) group by rid)
select doc_id, octet_length(b)::bigint n_bytes, coalesce(gone, 0)::bigint n_removed, coalesce(n, 0)::bigint n_spans, sha256(coalesce(unhex(kept), b)) kept_sha256 from d left join r using (rid)
"""
