"""Repeated word passages across documents, located by sharded Aho-Corasick automata."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, text_or_empty
from .textnp import GOLDEN, grouped, mix, powers, shingles, text_bytes, word_hashes

WINDOW = 13
PHRASE = 4
#: The shards of the automata are so many that each has about so many patterns and so many stretches pass it; a key gives it no more.
STRETCHES_A_SHARD, PATTERNS_A_SHARD = 40_000, 15_000
LETTERS, FIRST_LETTER = 128, 0x100
LAST = 2**63 - 1


def anchors(words: np.ndarray, count: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phrase key of every position; for every window its anchor's position and whether it lies in one text.

    A key packs 16 bits of each of ``PHRASE`` words. A window's anchor is the phrase
    of the smallest mixed key within it, the first of equals, so equal windows have
    equal anchors at equal places.
    """
    n = len(words) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)
    c = words >> np.uint64(48)
    key = c[:-3] << np.uint64(48) | c[1:-2] << np.uint64(32) | c[2:-1] << np.uint64(16) | c[3:]
    order = mix(key)
    best, at = order[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, window - PHRASE + 1):
        less = order[j : n + j] < best
        best[less] = order[j : n + j][less]
        at[less] = j
    end = np.repeat(np.cumsum(count), count)
    return key, np.arange(n) + at, np.arange(window, n + window) <= end[:n]


def _anchor_rows(window: int):
    """A row for each stretch of a text, the windows in a row that have one anchor: the anchor's key and a hash of the stretch's words."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, tags, texts = b.column(0).to_numpy(), b.column(1).to_numpy(), text_bytes(b.column(2))
            for group in grouped(texts):
                words, count = word_hashes([texts[i] for i in group])
                key, at, ok = anchors(words, count, window)
                w = np.flatnonzero(ok)
                if not len(w):
                    continue
                first = np.flatnonzero(np.concatenate(([True], at[w][1:] != at[w][:-1])))
                n = np.diff(np.append(first, len(w)))
                start = w[first]
                total = np.concatenate(([np.uint64(0)], np.cumsum(words * powers(len(words), GOLDEN))))
                f = (total[start + n + window - 1] - total[start]) * powers(len(words), pow(GOLDEN, -1, 1 << 64))[start]
                f = mix(f + mix((at[start] - start).astype(np.uint64) * np.uint64(64) + n.astype(np.uint64)))
                doc = np.searchsorted(np.cumsum(count), start, "right")
                who = np.asarray(group)[doc]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[at[start]].view(np.int64)), pa.array(f.view(np.int64)), pa.array(ids[who]), pa.array(tags[who]), pa.array((start - (np.cumsum(count) - count)[doc]).astype(np.int32)), pa.array(n.astype(np.int32))],
                    ["key", "f", "d", "m", "start", "n"],
                )

    return rows


def _cut(window: int):
    """The words of some stretches of a text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for one in range(b.num_rows):
                parts = b.column(0)[one].as_py().encode().split()
                spans = b.column(1)[one].values
                words = [b" ".join(parts[a : a + k + window - 1]) for a, k in zip(spans.field("start").to_pylist(), spans.field("n").to_pylist())]
                yield pa.RecordBatch.from_arrays([*(spans.field(k) for k in ("key", "f", "lo", "hi")), pa.array(words, pa.binary())], ["key", "f", "lo", "hi", "words"])

    return cut


def _windows(window: int):
    """A hash of each window of the stretches, with the ids that the stretch is in, and its place: the stretch's number, its last bits the window's."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lo, hi, sid, texts = *(b.column(k).to_numpy() for k in range(3)), text_bytes(b.column(3))
            for group in grouped(texts):
                words, count = word_hashes([texts[i] for i in group])
                h, ok = shingles(words, count, window)
                at = np.flatnonzero(ok)
                one = np.searchsorted(np.cumsum(count), at, "right")
                who = np.asarray(group)[one]
                yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(lo[who]), pa.array(hi[who]), pa.array(sid[who] | (at - (np.cumsum(count) - count)[one]))], ["h", "lo", "hi", "place"])

    return windows


def automaton(patterns: list[list[bytes]]):
    """An Aho-Corasick automaton over whole words that knows ``patterns``, and the spelling of words for it.

    Each word of the patterns is a number, spelled in as many of ``LETTERS`` letters
    as the numbers need, so that no node has very many children; every other word
    is the number 0.
    """
    number = {w: i + 1 for i, w in enumerate(dict.fromkeys(w for p in patterns for w in p))}
    width = 1
    while LETTERS**width <= len(number):
        width += 1
    spell = {w: "".join([chr(FIRST_LETTER + i // LETTERS**k % LETTERS) for k in range(width)]) for w, i in number.items()}
    a = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for i, p in enumerate(patterns):
        a.add_word("".join([spell[w] for w in p]), i)
    a.make_automaton()
    return a, spell, width


def occurrences(patterns: list[list[bytes]], texts: list[list[bytes]], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every place where a pattern of ``window`` words starts in the texts: text, word, pattern; in order of text and word."""
    if not patterns:
        return (np.zeros(0, np.int64),) * 3
    a, spell, width = automaton(patterns)
    other = chr(FIRST_LETTER) * width
    begin = np.cumsum([0] + [len(t) + 1 for t in texts])  # an unknown word parts the texts
    stream = other.join(["".join([spell.get(w, other) for w in t]) for t in texts])
    hits = np.array(list(a.iter(stream)), np.int64).reshape(-1, 2)
    stop = hits[:, 0] + 1
    whole = stop % width == 0
    first = stop[whole] // width - window
    text = np.searchsorted(begin, first, "right") - 1
    return text, first - begin[text], hits[whole, 1]


def _locate(window: int):
    """A shard: its patterns' automaton, passed by its stretches; runs of located windows with their owner."""
    names = ["key", "f", "at", "n", "owner"]

    def locate(known: pa.Table, stretches: pa.Table) -> pa.Table:
        patterns, owner = [], []
        for lo, text, places in zip(*(known.column(c).to_pylist() for c in ("lo", "words", "at"))):
            parts = text.split()
            patterns += [parts[i : i + window] for i in places]
            owner += [lo] * len(places)
        one, at, which = occurrences(patterns, [t.split() for t in stretches.column("words").to_pylist()], window)
        owner = np.asarray(owner, np.int64)[which]
        first = np.flatnonzero(np.concatenate(([True], (one[1:] != one[:-1]) | (at[1:] != at[:-1] + 1) | (owner[1:] != owner[:-1])))) if len(one) else np.zeros(0, np.int64)
        n = np.diff(np.append(first, len(one)))
        one, at, owner = one[first], at[first], owner[first]
        key, f = (stretches.column(c).to_numpy()[one] for c in ("key", "f"))
        return pa.Table.from_arrays([pa.array(key), pa.array(f), pa.array(at, pa.int32()), pa.array(n, pa.int32()), pa.array(owner)], names)

    return locate


def keep_words(text: bytes, runs, window: int = WINDOW) -> tuple[int, int, bytes]:
    """Number of words, number removed, and the kept words joined by one space; ``runs`` are (first window, windows in a row) to remove."""
    parts = text.split()
    edge = np.zeros(len(parts) + 1, np.int64)
    for start, n in runs:
        edge[start] += 1
        edge[start + n + window - 1] -= 1
    gone = np.cumsum(edge[:-1]) > 0
    return len(parts), int(gone.sum()), b" ".join([p for p, g in zip(parts, gone) if not g] if gone.any() else parts)


def _finish(window: int, digest: bool):
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, copy, runs in zip(text_bytes(b.column(1)), b.column(2).to_pylist(), b.column(3)):
                if copy:  # a smaller id has the same text
                    n = len(text.split())
                    runs = [(0, n - window + 1)] if n >= window else []
                else:
                    runs = zip(*(runs.values.field(k).to_pylist() for k in ("start", "n"))) if runs.is_valid else []
                n, gone, kept = keep_words(text, runs, window)
                rows.append((n, gone, hashlib.sha256(kept).hexdigest() if digest else kept.decode()))
            cols = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256" if digest else "kept_text"],
            )

    return finish


def remove_repeats(docs: DataFrame, window: int = WINDOW, digest: bool = False) -> DataFrame:
    """Each text without the words of windows that also start in a document of a smaller id.

    ``docs(doc_id long, text)``; other columns are not read. Returns ``doc_id,
    n_words, n_removed`` and ``kept_text``, the kept words joined by one space, or
    with ``digest`` its ``kept_sha256``; one row an input row.

    Every window has an anchor phrase that depends on its words alone; a text whose
    anchor no other text has cannot repeat there. Around the anchors that recur, the
    documents' stretches (the windows in a row with that anchor) are cut out, one copy of
    each. Windows that start in two documents or more, counted over the whole corpus, are the
    confirmed passages; each belongs to its smallest id, whose words are the
    pattern. Patterns are dealt by anchor into shards and compiled into automata of
    bounded size, and all stretches with those anchors pass them: what an
    automaton locates goes at each place of the stretch whose document does not own it.
    An anchor of very many stretches is dealt over several shards that all know its
    patterns; one of very many patterns over several shards that all its stretches pass.

    Copies of a whole text are settled by the smallest id of that text, which alone is
    read. Null text has no words; a null id counts as larger than any
    other; rows of the same id don't remove each other's words; an empty table gives
    an empty result.
    """
    scratch = Scratch(docs.sparkSession, "phrases")
    d = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("d"), text_or_empty().alias("text")).withColumn("m", F.xxhash64("text"))
    meta = scratch.table(d.select("d", "m").distinct(), "meta")
    many = scratch.table(meta.groupBy("m").agg(F.min("d").alias("owner"), F.count("*").alias("ids")).where("ids > 1").select("m", "owner").coalesce(8), "copies")
    rep = d.join(many, "m", "left").where(F.col("owner").isNull() | (F.col("owner") == F.col("d"))).select("d", "m", "text")
    found = scratch.table(rep.mapInArrow(_anchor_rows(window), "key long, f long, d long, m long, start int, n int"), "anchors")
    shared = scratch.table(found.groupBy("key").agg(F.min("m").alias("lo"), F.max("m").alias("hi")).where("lo <> hi").select("key"), "shared")
    scratch.free()
    found = scratch.table(found.join(shared, "key"), "recurring")
    scratch.drop("anchors", "shared")
    scratch.free()
    each = found.groupBy("key", "f").agg(F.min(F.struct("d", "m", "start", "n")).alias("at"), F.max("d").alias("hi"))
    todo = each.groupBy("at.m").agg(F.collect_list(F.struct("key", "f", F.col("at.d").alias("lo"), "hi", "at.start", "at.n")).alias("spans"))
    cut = rep.select("m", "text").join(todo, "m").select("text", "spans").mapInArrow(_cut(window), "key long, f long, lo long, hi long, words binary")
    # the last bits of a stretch's number are left for its windows
    low = (1 << (window - PHRASE).bit_length()) - 1
    cut = scratch.table(cut.withColumn("sid", F.xxhash64("key", "f").bitwiseAND(F.lit(~low))), "stretches")
    scratch.free()
    places = cut.select("lo", "hi", "sid", "words").mapInArrow(_windows(window), "h long, lo long, hi long, place long")
    owned = places.groupBy("h").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min_by("place", "lo").alias("place")).where("lo <> hi")
    owned = owned.select(F.col("place").bitwiseAND(F.lit(~low)).alias("sid"), F.col("place").bitwiseAND(F.lit(low)).cast("int").alias("at")).groupBy("sid").agg(F.sort_array(F.collect_set("at")).alias("at"))
    known = scratch.table(cut.join(owned, "sid").select("key", "f", "lo", "words", "at"), "patterns")
    scratch.free()
    # anchors of more stretches or patterns than a shard's go to several: all others have one part of each
    part = lambda n, most: F.ceil(F.coalesce(n, F.lit(0)) / F.lit(float(most))).cast("int")
    wide = cut.groupBy("key").agg(F.count("*").alias("stretches")).join(known.groupBy("key").agg(F.sum(F.size("at")).alias("patterns")), "key")
    wide = wide.select("key", part(F.col("stretches"), STRETCHES_A_SHARD).alias("salts"), part(F.col("patterns"), PATTERNS_A_SHARD).alias("leaves")).where("salts > 1 or leaves > 1")
    wide = scratch.table(wide.coalesce(8), "wide")
    patterns = known.agg(F.sum(F.size("at"))).first()[0] or 0
    shards = max(1, -(-cut.count() // STRETCHES_A_SHARD), -(-patterns // PATTERNS_A_SHARD))

    def deal(rows: DataFrame, own: str, other: str) -> DataFrame:
        n = lambda c: F.coalesce(c, F.lit(1))
        rows = rows.join(wide, "key", "left").withColumn("own", F.pmod(F.xxhash64("f"), n(F.col(own))).cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), n(F.col(other)) - 1)))
        salt, leaf = ("own", "other") if own == "salts" else ("other", "own")
        return rows.withColumn("shard", F.pmod(F.xxhash64("key", salt, leaf), F.lit(shards)))

    passing = deal(cut.select("key", "f", "words"), "salts", "leaves").select("shard", "key", "f", "words")
    known = deal(known, "leaves", "salts").select("shard", "lo", "words", "at")
    seen = known.groupBy("shard").cogroup(passing.groupBy("shard")).applyInArrow(_locate(window), "key long, f long, at int, n int, owner long")
    seen = scratch.table(seen, "located")
    scratch.drop("stretches", "patterns", "wide")
    scratch.free()
    gone = found.select("key", "f", "d", "m", "start").join(seen, ["key", "f"]).where("owner < d").select("d", "m", (F.col("start") + F.col("at")).alias("start"), "n")
    runs = gone.groupBy("d", "m").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    info = meta.join(many, "m", "left").select("d", "m", F.coalesce(F.col("owner") < F.col("d"), F.lit(False)).alias("copy")).join(runs, ["d", "m"], "left")
    info = scratch.table(info, "info")
    scratch.drop("recurring", "located", "meta", "copies")
    scratch.free()
    out = d.join(info, ["d", "m"]).select("doc_id", "text", "copy", "runs")
    return out.mapInArrow(_finish(window, digest), f"doc_id long, n_words long, n_removed long, {'kept_sha256' if digest else 'kept_text'} string")


#: DuckDB SQL for ``remove_repeats`` with its digest, where ids are unique.
SQL = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') ws from documents),
p as (select doc_id, unnest(ws) word, generate_subscripts(ws, 1) i from w),
win as (select doc_id, i, string_agg(word, ' ') over o s, count(*) over o c from p window o as (partition by doc_id order by i rows between current row and 12 following)),
own as (select s, min(doc_id) lo from win where c = 13 group by 1),
bad as (select doc_id, i from win join own using (s) where c = 13 and lo < doc_id),
cov as (select p.doc_id, p.word, p.i, max(case when bad.i is null then 0 else 1 end) over (partition by p.doc_id order by p.i rows between 12 preceding and current row) g from p left join bad on bad.doc_id = p.doc_id and bad.i = p.i),
r as (select doc_id, count(*) n, sum(g) removed, string_agg(word, ' ' order by i) filter (where g = 0) kept from cov group by 1)
select w.doc_id, coalesce(n, 0)::bigint n_words, coalesce(removed, 0)::bigint n_removed, sha256(coalesce(kept, '')) kept_sha256 from w left join r using (doc_id)
"""
