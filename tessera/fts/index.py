"""The inverted index: postings and document lengths as DataFrames, matching and bm25 ranking over them."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .query import Leaf, Node, QueryError, leaves, parse
from .tokenize import Tokenizer

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
MAX_TERM_BYTES = 256
#: Bytes of text that are cut into tokens at a time, whatever the size of a batch; a document is the smallest unit.
SLICE = 1 << 20
_BLOCKS = "term string, col int, ids array<long>, ends array<int>, lens array<int>, places array<int>, docs long, hits long, part double"
_PACKED = "term string, col int, slice long, gaps binary, ids array<long>, lens array<int>, docs long, hits long, part double"
_POSTINGS = "term string, docid long, col int, tf int, positions array<int>, length int"
_PLACES = "docid long, col int, length int, at int"


def _slices(b: pa.RecordBatch, width: int) -> Iterator[tuple[pa.Array, list[list[str]]]]:
    """Documents of a batch, some at a time, with the texts of each column."""
    raw = [b.column(1 + i).cast(pa.binary()) for i in range(width)]
    size = np.sum([np.diff(np.frombuffer(x.buffers()[1], np.int32, len(x) + 1, x.offset * 4)) for x in raw], axis=0, dtype=np.int64) if width else np.zeros(len(b), np.int64)
    at, total = 0, np.cumsum(size)
    while at < len(b):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + SLICE, "right")))
        yield b.column(0).slice(at, end - at), [[x.as_py().decode("utf-8", "replace") for x in r.slice(at, end - at)] for r in raw]
        at = end


def _order(code: np.ndarray) -> np.ndarray:
    """Places of the codes in their order, equal ones as they come."""
    bits = len(code).bit_length()
    if not len(code) or int(code.max()) >= 1 << (62 - bits):
        return np.argsort(code, kind="stable")
    key = (code << bits) | np.arange(len(code))
    key.sort()
    return key & ((1 << bits) - 1)


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where a row of sorted keys differs from the one before it."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _lists(offsets: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def _varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers in as few bytes as each needs, 7 bits a byte, the lowest first; and how many bytes that is."""
    size = np.ones(len(values), np.int64)
    for bits in range(7, 63, 7):
        if not (more := values >= 1 << bits).any():
            break
        size += more
    first = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        has = np.flatnonzero(size > k)
        out[first[has] + k] = values[has] >> 7 * k & 0x7F | (size[has] > k + 1).astype(np.int64) << 7
    return out, size


def _numbers(raw: np.ndarray) -> np.ndarray:
    """The numbers that ``_varints`` wrote."""
    last = np.flatnonzero(raw < 0x80)
    first = np.append(0, last[:-1] + 1)[: len(last)]
    size, out = last - first + 1, np.zeros(len(last), np.int64)
    for k in range(int(size.max(initial=0))):
        has = np.flatnonzero(size > k)
        out[has] |= (raw[first[has] + k] & 0x7F).astype(np.int64) << 7 * k
    return out


def _gaps(place: np.ndarray, block: np.ndarray) -> pa.Array:
    """Blocks of ascending places, each as its first place and the gaps between them."""
    gap = np.diff(place, prepend=0) - 1
    gap[block] = place[block]
    raw, size = _varints(gap)
    ends = np.append((np.cumsum(size) - size)[block], len(raw)).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(block), [None, pa.py_buffer(ends), pa.py_buffer(raw)])


def _found(width: int, detail: str, spec: str):
    """Slices of documents: their ids and lengths, the terms of the codes, and the columns' tokens by code."""
    tokenizer = Tokenizer(spec)

    def columns(texts: list[list[str]], final):
        """Codes, documents and positions of the tokens of each column (of all as one without columns), and the terms of the codes."""
        number: dict[str, int] = {}
        length = np.zeros(len(texts[0]) if texts else 0, np.int64)
        out = []
        for column in texts:
            t = tokenizer.cut(column)
            size = np.bincount(t.doc, minlength=len(column))
            length += size
            pos = np.arange(len(t.doc)) - np.repeat(np.cumsum(size) - size, size)
            used = np.flatnonzero(np.bincount(t.code)) if tokenizer.base == "unicode61" or not len(t.code) or t.code.max() < 1 << 22 else np.unique(t.code)
            names = t.names(used).to_pylist()
            to = np.array([number.setdefault(final(x) if final else x, len(number)) for x in names], np.int64)
            code = to[np.searchsorted(used, t.code)] if len(used) else t.code
            out.append((code, t.doc, pos))
        if detail == "none" and out:
            code, doc, pos = (np.concatenate(x) for x in zip(*out))
            by = _order(doc)
            out = [(code[by], doc[by], pos[by])]
        return out, list(number), length

    def slices(batches: Iterator[pa.RecordBatch]):
        final = tokenizer.final()
        final = final and lru_cache(1 << 16)(final)
        for b in batches:
            for ids, texts in _slices(b, width):
                found, terms, length = columns(texts, final)
                fits = np.array([len(t.encode()) <= MAX_TERM_BYTES for t in terms], bool)
                for i, (code, doc, pos) in enumerate(found):
                    by = _order(code)
                    by = by[fits[code[by]]]
                    found[i] = code[by], doc[by], pos[by]
                yield ids, length, pa.array(terms, pa.string()), found

    return slices


def _counted(found: list, length: np.ndarray, mean: float | None):
    """For each column that has tokens: its number, tokens, where postings and blocks of them begin, and what each block adds to its term's statistics."""
    seen = np.zeros(0, np.int64)
    for i, (code, doc, pos) in enumerate(found):
        if not len(code):
            continue
        post = _starts(code, doc)
        pair = code[post] * len(length) + doc[post]
        block = _starts(code[post])
        new = ~np.isin(pair, seen)
        if i + 1 < len(found):
            seen = np.concatenate((seen, pair))
        tf, size = np.diff(np.append(post, len(code))), length[doc[post]]
        part = np.maximum.reduceat(tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean)), block) if mean else np.full(len(block), np.nan)
        hits = np.diff(np.append(post[block], len(code)))
        yield i, (code, doc, pos), post, block, [pa.array(np.add.reduceat(new, block, dtype=np.int64)), pa.array(hits), pa.array(part)]


def _blocks(width: int, detail: str, spec: str, mean: float | None):
    """Blocks of a slice of documents: for each term and column its postings, and what they add to the term's statistics.

    ``ids`` and ``lens`` are the documents and their lengths, ``places`` all positions one document after the other,
    ``ends`` where each document's end. ``docs`` counts a document at its first column only; ``part`` is the largest
    part of a score, where the mean length is given.
    """
    slices = _found(width, detail, spec)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, length, terms, found in slices(batches):
            for i, (code, doc, pos), post, block, counts in _counted(found, length, mean):
                token, cut = post[block], np.append(block, len(post))
                end = np.append(post[1:], len(code)) - np.repeat(token, np.diff(cut))
                yield pa.RecordBatch.from_arrays([
                    terms.take(pa.array(code[token])), pa.array(np.full(len(block), -1 if detail == "none" else i), pa.int32()),
                    _lists(cut, ids.take(pa.array(doc[post]))), _lists(cut, pa.array(end, pa.int32())), _lists(cut, pa.array(length[doc[post]], pa.int32())),
                    _lists(np.append(token, len(code)), pa.array(pos, pa.int32())) if detail == "full" else pa.nulls(len(block), pa.list_(pa.int32())), *counts,
                ], ["term", "col", "ids", "ends", "lens", "places", "docs", "hits", "part"])

    return rows


def _table(at: int, ids: pa.Array, length: np.ndarray) -> pa.RecordBatch:
    """The row of a slice that its blocks refer to: its documents and their lengths, without a term."""
    one = lambda x: _lists(np.array([0, len(ids)]), x)
    return _packed_rows(pa.nulls(1, pa.string()), pa.nulls(1, pa.int32()), at, pa.nulls(1, pa.binary()), [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.float64())], one(ids), one(pa.array(length, pa.int32())))


def _packed_rows(term: pa.Array, col: pa.Array, at: int, gaps: pa.Array, counts: list, ids: pa.Array | None = None, lens: pa.Array | None = None) -> pa.RecordBatch:
    n = len(term)
    ids, lens = pa.nulls(n, pa.list_(pa.int64())) if ids is None else ids, pa.nulls(n, pa.list_(pa.int32())) if lens is None else lens
    return pa.RecordBatch.from_arrays([term, col, pa.array(np.full(n, at, np.int64)), gaps, ids, lens, *counts], ["term", "col", "slice", "gaps", "ids", "lens", "docs", "hits", "part"])


def _packs(width: int, detail: str, spec: str, mean: float):
    """Blocks as they are stored, about one and a half bytes for a position, and for each slice a row of its documents.

    The documents of a slice are laid end to end, each as long as its length, so that one ascending list of places
    gives a block's documents, frequencies and positions. Without positions a document's first places stand for its hits.
    """
    slices = _found(width, detail, spec)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, (ids, length, terms, found) in enumerate(slices(batches)):
            yield _table(at, ids, length)
            begin = np.cumsum(length) - length
            for i, (code, doc, pos), post, block, counts in _counted(found, length, mean):
                if detail != "full":
                    pos = np.arange(len(code)) - np.repeat(post, np.diff(np.append(post, len(code))))
                col = pa.array(np.full(len(block), -1 if detail == "none" else i), pa.int32())
                yield _packed_rows(terms.take(pa.array(code[post[block]])), col, at, _gaps(begin[doc] + pos, post[block]), counts)

    return rows


def _repacks(mean: float):
    """Postings as they are stored; each batch of them is a slice."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, b in enumerate(b for b in batches if len(b)):
            coded = b.column("term").dictionary_encode()
            code, docid, col, tf, length = (x.to_numpy().astype(np.int64) for x in (coded.indices, *map(b.column, ("docid", "col", "tf", "length"))))
            # a document that comes again with the same term and column is another one
            by = np.lexsort((length, docid, col, code))
            new = _starts(code[by], col[by], docid[by], length[by])
            again = np.empty(len(by), np.int64)
            again[by] = np.arange(len(by)) - np.repeat(new, np.diff(np.append(new, len(by))))
            docs, doc = np.unique(np.column_stack((docid, length, again)), axis=0, return_inverse=True)
            doc = doc.ravel()
            begin = np.cumsum(docs[:, 1]) - docs[:, 1]
            by = np.lexsort((doc, col, code))
            code, col, tf, doc, length = code[by], col[by], tf[by], doc[by], length[by]
            block, first = _starts(code, col), np.cumsum(tf) - tf
            positions = b.column("positions")
            if positions.null_count:
                pos = np.arange(int(tf.sum())) - np.repeat(first, tf)
            else:
                pos = positions.take(pa.array(by)).flatten().to_numpy()
            part = np.maximum.reduceat(tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean)), block)
            counts = [pa.array(np.diff(np.append(block, len(by)))), pa.array(np.add.reduceat(tf, block)), pa.array(part)]
            yield _table(at, pa.array(docs[:, 0]), docs[:, 1])
            yield _packed_rows(coded.dictionary.take(pa.array(code[block])), pa.array(col[block], pa.int32()), at, _gaps(np.repeat(begin[doc], tf) + pos, first[block]), counts)

    return rows


def _unpacks(full: bool, places: bool = False):
    """Postings of stored blocks, or a row for each position. They come by slice, behind the row of its documents, and are taken some at a time, whatever the size of a batch."""

    def by_place(part: pa.RecordBatch, ids: pa.Array, lens: np.ndarray, doc: np.ndarray, row: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids.take(pa.array(doc)), part.column("col").take(pa.array(row)), pa.array(lens[doc], pa.int32()), pa.array(pos, pa.int32())], ["docid", "col", "length", "at"])

    def by_document(part: pa.RecordBatch, ids: pa.Array, lens: np.ndarray, doc: np.ndarray, row: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
        post = _starts(row, doc)
        by, of, cut = doc[post], pa.array(row[post]), np.append(post, len(pos))
        positions = _lists(cut, pa.array(pos, pa.int32())) if full else pa.nulls(len(post), pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([
            part.column("term").take(of), ids.take(pa.array(by)), part.column("col").take(of), pa.array(np.diff(cut), pa.int32()), positions, pa.array(lens[by], pa.int32()),
        ], ["term", "docid", "col", "tf", "positions", "length"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lens = pa.array([], pa.int64()), np.zeros(0, np.int64)
        for b in batches:
            null = b.column("gaps").is_null().to_numpy(zero_copy_only=False)
            total = np.cumsum(np.where(null, 0, b.column("hits").fill_null(0).to_numpy()))
            at = 0
            while at < len(b):
                end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + SLICE, "right")))
                part, table = b.slice(at, end - at), null[at:end]
                at = end
                # documents of the slice that is under way and of those that begin here, end to end
                own = part.filter(pa.array(table))
                size = np.append(len(ids), own.column("ids").value_lengths().to_numpy().astype(np.int64))
                ids = pa.concat_arrays([ids, own.column("ids").flatten()])
                lens = np.concatenate((lens, own.column("lens").flatten().to_numpy()))
                begin = np.cumsum(lens) - lens
                base = np.append(begin, lens.sum())[np.cumsum(size) - size]
                part, of = part.filter(pa.array(~table)), np.cumsum(table)[~table]
                if len(part):
                    hits = part.column("hits").to_numpy()
                    gap = _numbers(np.frombuffer(b"".join(part.column("gaps").to_pylist()), np.uint8)) + 1
                    first = np.cumsum(hits) - hits
                    gap[first] -= 1
                    place = np.cumsum(gap)
                    place += np.repeat(base[of] + gap[first] - place[first], hits)
                    doc, row = np.searchsorted(begin, place, "right") - 1, np.repeat(np.arange(len(hits)), hits)
                    yield by_place(part, ids, lens, doc, row, place - begin[doc]) if places else by_document(part, ids, lens, doc, row, place - begin[doc])
                if table.any():
                    ids, lens = ids.slice(len(ids) - size[-1]), lens[len(lens) - size[-1] :]

    return rows


def _sizes(width: int, spec: str):
    """The number of tokens of each document's columns."""
    tokenizer = Tokenizer(spec)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, texts in _slices(b, width):
                size = np.array([tokenizer.sizes(column) for column in texts], np.int64).reshape(width, len(ids))
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(x, pa.int32()) for x in size]], ["docid", *[f"n{i}" for i in range(width)]])

    return rows


def _postings(blocks: DataFrame) -> DataFrame:
    """Blocks that are not stored as postings, by built-in functions; a filter on terms goes below this."""
    each = blocks.select("term", "col", "ends", "lens", "places", F.posexplode("ids").alias("at", "docid"))
    start = F.coalesce(F.get("ends", F.col("at") - 1), F.lit(0))
    tf = F.get("ends", "at") - start
    return each.select("term", "docid", "col", tf.alias("tf"), F.slice("places", start + 1, tf).alias("positions"), F.get("lens", "at").alias("length"))


def _packed(made: DataFrame, rows) -> DataFrame:
    """What tasks pack, the numbers of their slices made those of the whole index."""
    out = made.mapInArrow(rows, _PACKED)
    return out.withColumn("slice", F.shiftleft(F.spark_partition_id().cast("long"), 32) + F.col("slice"))


def _unpacked(stored: DataFrame, full: bool, places: bool = False) -> DataFrame:
    """Stored blocks as postings, or as a row for each position: each slice's come together, the row of its documents first."""
    rows = stored.select(*[] if places else ["term"], "col", "slice", "gaps", "hits", "ids", "lens").repartition("slice")
    return rows.sortWithinPartitions("slice", F.col("gaps").isNotNull()).mapInArrow(_unpacks(full, places), _PLACES if places else _POSTINGS)


def _idf(n: int, df: int) -> float:
    return max(math.log((n - df + 0.5) / (df + 0.5)), LEAST_IDF)


def _scale(length, mean: float):
    return F.lit(K1) * (F.lit(1 - B) + F.lit(B) * length / F.lit(mean))


class FtsIndex:
    """``postings(term, docid, col, tf, positions, length)`` and ``stats(docid, lens)`` of some text columns.

    ``length`` is that of the whole document, so ranking reads nothing but postings. ``detail``
    is full, column (no positions) or none (no columns either). Postings are made and stored
    in blocks, one for each term and column of a slice of documents. A stored index (``save``,
    ``open``) lies where its documents were read: each task's blocks, sorted by term, are a file,
    with a table of the terms' document frequencies and the totals beside it. A term's scan reads
    the pages of each file that have the term and the rows of its slices' documents.
    """

    def __init__(self, postings: DataFrame, stats: DataFrame, columns: tuple[str, ...], tokenizer: str, detail: str = "full", vocabulary: DataFrame | None = None, totals: tuple | None = None, words: DataFrame | None = None, stored: DataFrame | None = None):
        self.postings, self.stats, self.columns = postings, stats, columns
        self.spec, self.tokenizer, self.detail = tokenizer, Tokenizer(tokenizer), detail
        self.vocabulary, self._totals, self._words, self._stored = vocabulary, totals, words, stored

    @classmethod
    def build(cls, docs: DataFrame, docid: str, columns: tuple[str, ...], tokenize: str = "unicode61", detail: str = "full") -> FtsIndex:
        """NULL text is empty; terms over 256 bytes are left out but count in lengths. A document's postings are made where it is read."""
        if detail not in ("full", "column", "none"):
            raise ValueError(detail)
        t, width = Tokenizer(tokenize), len(columns)
        words = docs.select(F.col(docid).cast("long").alias("docid"), *[t.prepare(F.col(c)).alias(f"c{i}") for i, c in enumerate(columns)])
        sizes = words.mapInArrow(_sizes(width, tokenize), ", ".join(["docid long", *[f"n{i} int" for i in range(width)]]))
        stats = sizes.groupBy("docid").agg(F.array(*[F.sum(f"n{i}").cast("int") for i in range(width)]).alias("lens"))
        return cls(_postings(words.mapInArrow(_blocks(width, detail, tokenize, None), _BLOCKS)), stats, tuple(columns), tokenize, detail, words=words)

    def save(self, path: str, files: int | None = None) -> FtsIndex:
        """Writes the index and reads it back: a pass over the documents for their lengths and one for their postings, which no shuffle moves. ``files``: no more than so many, else one a task."""
        spark = self.postings.sparkSession
        self.stats.write.mode("overwrite").parquet(f"{path}/stats")
        total = spark.read.schema("docid long, lens array<int>").parquet(f"{path}/stats").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.aggregate("lens", F.lit(0), lambda a, x: a + x)), F.lit(0)).alias("words"))
        n, words = total.first()
        mean = words / n if words else 1.0
        whole = self._words is not None and not self._words.groupBy("docid").count().where("count > 1").limit(1).count()
        rows = _packed(self._words, _packs(len(self.columns), self.detail, self.spec, mean)) if self._words is not None else _packed(self.postings, _repacks(mean))
        rows = rows if files is None else rows.coalesce(files)
        rows.sortWithinPartitions("term", "slice").write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/postings")
        stored = spark.read.schema(_PACKED).parquet(f"{path}/postings")
        # the largest part of a score that a term gives any document, a column at a time
        each = stored.where("term is not null").groupBy("term", "col").agg(F.sum("docs").alias("docs"), F.sum("hits").alias("hits"), F.max("part").alias("bound"))
        terms = each.groupBy("term").agg(F.sum("docs").alias("docs"), F.sum("hits").alias("hits"), F.sum("bound").alias("bound"))
        if not whole:  # a document may be in several blocks of a term
            terms = terms.drop("docs").join(_unpacked(stored, False).groupBy("term").agg(F.count_distinct("docid").alias("docs")), "term")
        terms.select("term", "docs", "hits", "bound").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")
        about = [F.lit(x).alias(k) for k, x in (("columns", "\x1f".join(self.columns)), ("tokenizer", self.spec), ("detail", self.detail))]
        total.select("*", *about).coalesce(1).write.mode("overwrite").parquet(f"{path}/about")
        return FtsIndex.open(spark, path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> FtsIndex:
        a, stored = spark.read.parquet(f"{path}/about").first(), spark.read.schema(_PACKED).parquet(f"{path}/postings")
        return cls(
            _unpacked(stored, a["detail"] == "full"), spark.read.schema("docid long, lens array<int>").parquet(f"{path}/stats"), tuple(a["columns"].split("\x1f")), a["tokenizer"], a["detail"],
            spark.read.schema("term string, docs long, hits long, bound double").parquet(f"{path}/terms"), (a["n"], a["words"] / a["n"] if a["n"] else 0.0), stored=stored,
        )

    def append(self, docs: DataFrame, docid: str) -> FtsIndex:
        """More documents; a docid that is there already is refused."""
        new = FtsIndex.build(docs, docid, self.columns, self.spec, self.detail)
        if new.stats.join(self.stats, "docid", "left_semi").limit(1).count():
            raise ValueError("duplicate docid")
        return FtsIndex(self.postings.unionByName(new.postings), self.stats.unionByName(new.stats), self.columns, self.spec, self.detail)

    def delete(self, ids: DataFrame) -> FtsIndex:
        """Without the documents whose ``docid`` is in ``ids``."""
        ids = ids.select("docid").distinct()
        return FtsIndex(self.postings.join(ids, "docid", "left_anti"), self.stats.join(ids, "docid", "left_anti"), self.columns, self.spec, self.detail)

    def delete_all(self) -> FtsIndex:
        return FtsIndex(self.postings.limit(0), self.stats.limit(0), self.columns, self.spec, self.detail)

    def global_stats(self) -> tuple[int, float]:
        """Number of documents and their mean length."""
        if self._totals is None:
            n, total = self.stats.agg(F.count("*"), F.sum(F.aggregate("lens", F.lit(0), lambda a, x: a + x))).first()
            self._totals = (n, (total or 0) / n if n else 0.0)
        return self._totals

    def _where(self, wanted: Column, positions: bool = False) -> DataFrame:
        """Postings by a condition on blocks, which a stored index meets before it unpacks anything."""
        if self._stored is None:
            return self.postings.where(wanted)
        return _unpacked(self._stored.where(wanted | F.col("term").isNull()), positions and self.detail == "full")

    def _places(self, wanted: Column) -> DataFrame:
        """``docid, col, length, at``: a row for each position in postings by a condition."""
        if self._stored is None:
            return self.postings.where(wanted).select("docid", "col", "length", F.explode("positions").alias("at"))
        return _unpacked(self._stored.where(wanted | F.col("term").isNull()), True, True)

    def term_postings(self, term: str) -> DataFrame:
        return self._where(F.col("term") == term, True)

    def document_frequency(self, term: str) -> int:
        return self._frequencies([term])[term]

    def _frequencies(self, terms: list[str]) -> dict[str, int]:
        """Numbers of documents that have each of a query's terms."""
        if self.vocabulary is not None:
            found = self.vocabulary.where(F.col("term").isin(terms)).select("term", "docs")
        else:
            found = self._where(F.col("term").isin(terms)).groupBy("term").agg(F.count_distinct("docid").alias("docs"))
        return dict.fromkeys(terms, 0) | {r["term"]: r["docs"] for r in found.collect()}

    def _leaf(self, leaf: Leaf) -> DataFrame:
        """``docid, col, tf, length`` of a leaf, tf in parts that add up."""
        terms = self.tokenizer.terms(leaf.text)
        only = None
        if leaf.columns is not None:
            names = [c.lower() for c in self.columns]
            odd = [c for c in leaf.columns if c.lower() not in names]
            if odd or self.detail == "none":
                raise QueryError(f"no such column: {odd or leaf.columns}")
            only = [names.index(c.lower()) for c in leaf.columns]

        def wanted(i: int) -> Column:
            at = F.col("term").startswith(terms[i]) if leaf.prefix and i == len(terms) - 1 else F.col("term") == terms[i]
            return at if only is None else at & F.col("col").isin(only)

        if not terms:
            return self.postings.where(F.lit(False)).select("docid", "col", "tf", "length")
        if len(terms) == 1:
            return self._where(wanted(0)).select("docid", "col", "tf", "length")
        if self.detail != "full":
            raise QueryError("phrases need detail=full")
        # a place holds one term, so a phrase starts where all its terms agree on the place
        parts = [self._places(wanted(i)).withColumn("at", F.col("at") - i) for i in range(len(terms))]
        at = reduce(DataFrame.union, parts).groupBy("docid", "col", "length", "at").agg(F.count("*").alias("n"))
        return at.where(F.col("n") == len(terms)).select("docid", "col", F.lit(1).alias("tf"), "length")

    def _matched(self, query: str, weights: list[float] | None) -> tuple[DataFrame, list]:
        """One row a matching document, with each leaf's weighted frequency: a single aggregation over all leaves."""
        tree = parse(query)
        found = leaves(tree)
        w = list(weights or []) + [1.0] * (len(self.columns) - len(weights or []))
        weight = F.element_at(F.array(*[F.lit(float(x)) for x in w]), F.greatest(F.col("col"), F.lit(0)) + 1)
        hits = reduce(DataFrame.union, [self._leaf(leaf).select("docid", "length", F.lit(i).alias("leaf"), (weight * F.col("tf")).alias("wf")) for i, (leaf, _) in enumerate(found)])
        hits = hits.groupBy("docid").agg(F.max("length").alias("length"), *[F.sum(F.when(F.col("leaf") == i, F.col("wf"))).alias(f"f{i}") for i in range(len(found))])
        at = iter(range(len(found)))

        def truth(node: Node | Leaf):
            if isinstance(node, Leaf):
                return F.col(f"f{next(at)}").isNotNull()
            a, b = truth(node.left), truth(node.right)
            return a | b if node.kind == "or" else a & (b if node.kind == "and" else ~b)

        return hits, [truth(tree), found]

    def match(self, query: str) -> DataFrame:
        """``rowid`` of the matching documents; nothing is scored."""
        hits, (keep, _) = self._matched(query, None)
        return hits.where(keep).select(F.col("docid").alias("rowid"))

    def score(self, query: str, weights: list[float] | None = None) -> DataFrame:
        """``rowid, rank``: bm25 over columns with weights (1 where missing), negated, so the best is the smallest."""
        hits, (keep, found) = self._matched(query, weights)
        n, mean = self.global_stats()
        if not n or mean <= 0:
            return hits.where(keep).select(F.col("docid").alias("rowid"), F.lit(0.0).alias("rank"))
        plain = [self.tokenizer.terms(leaf.text) if not leaf.prefix and leaf.columns is None else [] for leaf, _ in found]
        if self.vocabulary is not None and all(len(t) == 1 for t in plain):
            known = self._frequencies([t[0] for t in plain])
            df = [known[t[0]] for t in plain]
        else:
            df = hits.agg(*[F.count(f"f{i}").alias(f"f{i}") for i in range(len(found))]).first()  # one number a leaf
        scale = _scale(F.col("length"), mean)
        rank = F.lit(0.0)
        for i, (_, scored) in enumerate(found):
            if scored:
                idf = _idf(n, df[i])
                f = F.col(f"f{i}")
                rank = rank + F.coalesce(F.lit(idf) * (f * F.lit(K1 + 1) / (f + scale)), F.lit(0.0))
        return hits.where(keep).select(F.col("docid").alias("rowid"), (-rank).alias("rank"))

    def top(self, query: str, k: int, weights: list[float] | None = None) -> DataFrame:
        """The ``k`` best, ties by the smallest rowid: a bounded sort, no full one.

        Where a stored index is asked for any of some single terms, without weights, terms that
        can't lift a document into the best are only read for documents that another term
        brings in: the ``k``-th best of the documents of the most telling term is a
        floor, and the terms whose bounds add up to less than it bring in none of their own.
        """
        tree = parse(query)
        found = [leaf for leaf, _ in leaves(tree)]
        terms = [self.tokenizer.terms(leaf.text) for leaf in found]
        plain = all(len(t) == 1 for t in terms) and not any(leaf.prefix or leaf.columns for leaf in found) and _only(tree, "or")
        n, mean = self.global_stats()
        if self.vocabulary is None or weights or not plain or len({t[0] for t in terms}) < 2 or not n or mean <= 0:
            return self.score(query, weights).orderBy("rank", "rowid").limit(k)
        names = list(dict.fromkeys(t[0] for t in terms))
        times = {t: sum(x[0] == t for x in terms) for t in names}
        known = {r["term"]: (r["docs"], r["bound"]) for r in self.vocabulary.where(F.col("term").isin(names)).collect()}
        idf = {t: times[t] * _idf(n, known[t][0]) for t in names if t in known}
        order = sorted(idf, key=lambda t: idf[t] * known[t][1])
        if not order:
            return self.score(query).orderBy("rank", "rowid").limit(k)

        def ranked(hits: DataFrame) -> DataFrame:
            hits = hits.groupBy("docid").agg(F.max("length").alias("length"), *[F.sum(F.when(F.col("term") == t, F.col("tf"))).alias(f"f{i}") for i, t in enumerate(order)])
            rank = F.lit(0.0)
            for i, t in enumerate(order):
                rank = rank + F.coalesce(F.lit(idf[t]) * (F.col(f"f{i}") * F.lit(K1 + 1) / (F.col(f"f{i}") + _scale(F.col("length"), mean))), F.lit(0.0))
            return hits.select(F.col("docid").alias("rowid"), (-rank).alias("rank"))

        rows = lambda t: self._where(F.col("term") == t).select("term", "docid", "tf", "length")
        best = ranked(rows(order[-1])).orderBy("rank").limit(k).agg(F.max("rank"), F.count("*")).first()
        floor = -best[0] if best[1] == k else 0.0
        weak, total = 0, 0.0
        while weak < len(order) - 1 and total + idf[order[weak]] * known[order[weak]][1] < floor * (1 - 1e-9):
            total += idf[order[weak]] * known[order[weak]][1]
            weak += 1
        hits = reduce(DataFrame.union, [rows(t) for t in order[weak:]])
        if weak:
            ids = hits.select("docid").distinct()
            hits = hits.union(reduce(DataFrame.union, [rows(t) for t in order[:weak]]).join(ids, "docid", "left_semi").select("term", "docid", "tf", "length"))
        return ranked(hits).orderBy("rank", "rowid").limit(k)


def _only(node: Node | Leaf, kind: str) -> bool:
    return isinstance(node, Leaf) or (node.kind == kind and _only(node.left, kind) and _only(node.right, kind))
