"""The stored form of an index: its size and what a build shuffles, and that packing changes nothing."""

import os
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.fts import index as I
from tessera.fts.index import FtsIndex

WORDS = ["the", "of", "running", "brash", "Rash", "日本", "x1", "𝒳y", ""]


def _texts(n: int, words: int, seed: int = 5) -> list[tuple[int, str]]:
    r = random.Random(seed)
    vocabulary = ["".join(r.choices("etaoinshrdlu", k=r.randint(2, 9))) for _ in range(3000)]
    return [(i * 7919 - 10**12, " ".join(r.choices(vocabulary, k=words))) for i in range(n)]


def _shuffled(spark) -> int:
    """Bytes of shuffle that the application has written so far."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    found = sc.statusStore().executorList(False)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))


def test_disk_of_a_trigram_build_follows_its_text(spark, tmp_path):
    """A position takes about one and a half bytes where it is stored, and none in a shuffle; the whole index is there."""
    texts = _texts(1500, 500)
    docs = spark.createDataFrame(texts, "id long, body string").repartition(4).localCheckpoint()
    before, size = _shuffled(spark), sum(len(t) for _, t in texts)
    ix = FtsIndex.build(docs, "id", ("body",), "trigram").save(f"{tmp_path}/ix")
    stored = sum(os.path.getsize(f"{d}/{x}") for d, _, names in os.walk(f"{tmp_path}/ix") for x in names)
    assert stored < 1.9 * size and _shuffled(spark) - before < size / 5, (stored / size, (_shuffled(spark) - before) / size)
    assert ix.vocabulary.agg(F.sum("hits")).first()[0] == sum(max(len(t) - 2, 0) for _, t in texts) == ix.postings.agg(F.sum(F.size("positions"))).first()[0]
    assert sorted(r.rowid for r in ix.match("tion").collect()) == [i for i, t in texts if "tion" in t]


def test_numbers_come_back():
    r = np.random.default_rng(1)
    x = np.concatenate([[0, 127, 128, 16383, 16384, (1 << 62) - 1], r.integers(0, 1 << r.integers(1, 62, 2000))])
    raw, size = I._varints(x)
    assert (I._numbers(raw) == x).all() and size.sum() == len(raw) and size[:5].tolist() == [1, 1, 2, 2, 3]
    assert len(I._numbers(I._varints(np.zeros(0, np.int64))[0])) == 0


def _cells(rows) -> list:
    return sorted(rows, key=str)


@pytest.mark.parametrize("rows", [1, 3, 10_000])
@pytest.mark.parametrize("limit", [1, 40, 1 << 20])
@pytest.mark.parametrize("detail", ["full", "column", "none"])
def test_packing_changes_nothing(monkeypatch, detail, limit, rows):
    """However slices, batches and parts of them are cut; empty documents, documents without a term's column and repeated ids among them."""
    r = random.Random(limit)
    bodies = ["" if i % 5 == 0 else " ".join(r.choices(WORDS, k=r.randint(0, 12))) for i in range(60)] + ["", "x" * 300 + " the"]
    titles = [r.choice(["", "the rash", "of"]) for _ in bodies]
    ids = [i // 2 * (1 << 40) for i in range(len(bodies))]
    batch = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(bodies), pa.array(titles)], ["docid", "c0", "c1"])
    want = []
    for b in I._blocks(2, detail, "unicode61", 9.0)(iter([batch])):
        for x in b.to_pylist():
            ends = [0, *x["ends"]]
            want += [(x["term"], d, x["col"], ends[i + 1] - ends[i], x["places"] and x["places"][ends[i] : ends[i + 1]], x["lens"][i]) for i, d in enumerate(x["ids"])]
    monkeypatch.setattr(I, "SLICE", limit)
    packed = pa.Table.from_batches(list(I._packs(2, detail, "unicode61", 9.0)(iter([batch]))))

    def unpacked(t: pa.Table) -> list:
        t = t.sort_by([("slice", "ascending")]).select(["term", "col", "slice", "gaps", "hits", "ids", "lens"])
        by = sorted(range(len(t)), key=lambda i: (t["slice"][i].as_py(), t["term"][i].as_py() is not None))
        batches = t.take(by).combine_chunks().to_batches(max_chunksize=rows)
        return [x for b in I._unpacks(detail == "full")(iter(batches)) for x in b.to_pylist()]

    got = unpacked(packed)
    cells = lambda found: _cells(tuple(x.values()) for x in found)
    assert cells(got) == _cells(want)
    names = ["term", "docid", "col", "tf", "positions", "length"]
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.int32()]
    r.shuffle(got)
    again = pa.RecordBatch.from_arrays([pa.array([x[k] for x in got], kind) for k, kind in zip(names, kinds)], names)
    halves = [again.slice(0, len(got) // 3), again.slice(0, 0), again.slice(len(got) // 3)]
    assert cells(unpacked(pa.Table.from_batches(list(I._repacks(9.0)(iter(halves)))))) == _cells(want)


def test_memory_of_packing_goes_by_slices():
    """A batch of 32 MB, packed and unpacked, takes no more than some slices do."""
    texts = _texts(8000, 600)
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in texts], pa.int64()), pa.array([t for _, t in texts])], ["docid", "c0"])
    names = ["term", "col", "slice", "gaps", "hits", "ids", "lens"]
    pack = lambda: (b.select(names) for b in I._packs(1, "full", "trigram", 500.0)(iter([batch])))
    one = pa.Table.from_batches(pack()).combine_chunks().to_batches()[0]
    tracemalloc.start()
    rows = sum(b.num_rows for b in pack())
    peaks = [tracemalloc.get_traced_memory()[1]]
    tracemalloc.reset_peak()
    tokens = sum(sum(b.column("tf").to_pylist()) for b in I._unpacks(True)(iter([one])))
    peaks.append(tracemalloc.get_traced_memory()[1])
    tracemalloc.stop()
    assert rows == len(one) and tokens == sum(len(t) - 2 for _, t in texts)
    assert max(peaks) < 160 << 20, peaks


@pytest.mark.parametrize("detail", ["full", "column", "none"])
def test_stored_index_takes_more_and_less(spark, tmp_path, detail):
    """Stored, opened, appended to, thinned and stored again, twice: as if built from what is left."""
    docs = spark.createDataFrame([(i, " ".join(random.Random(i).choices(WORDS, k=i % 13)), "the rash" if i % 3 else None) for i in range(120)], "id long, body string, title string")
    build = lambda d: FtsIndex.build(d, "id", ("body", "title"), "unicode61", detail)
    ix = build(docs.where("id < 40")).save(f"{tmp_path}/a")
    ix = ix.append(docs.where("id between 40 and 79"), "id").save(f"{tmp_path}/b", 2)
    ix = ix.append(docs.where("id >= 80"), "id").delete(docs.where("id % 7 = 0").select(F.col("id").alias("docid"))).save(f"{tmp_path}/c")
    fresh = build(docs.where("id % 7 <> 0"))
    rows = lambda x: sorted(map(str, x.postings.collect()))
    assert rows(ix) == rows(fresh)
    terms = lambda x: sorted((r.term, r.docs, r.hits, round(r.bound, 9)) for r in x.vocabulary.collect())
    assert terms(ix) == terms(fresh.save(f"{tmp_path}/d"))
    for q in ("the OR rash", "ru* NOT of", *(['title : "the ra"*', '"the of" OR "of the of"'] if detail == "full" else [])):
        assert sorted((r.rowid, round(r.rank, 9)) for r in ix.score(q).collect()) == sorted((r.rowid, round(r.rank, 9)) for r in fresh.score(q).collect())
