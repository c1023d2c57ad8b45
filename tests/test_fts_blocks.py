"""The index build: memory by slices of documents, blocks of postings, the same results however the documents are cut."""

import random
import re
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.fts import index as I
from tessera.fts import tokenize as T
from tessera.fts.index import FtsIndex

WORDS = ["the", "of", "thé", "running", "runs", "日本", "x1", "brash", "Rash", "a-b", "𝒳y", "́d", ""]


def _texts(n: int, seed: int = 3):
    r = random.Random(seed)
    return [(i, None if i % 17 == 0 else " ".join(r.choices(WORDS, k=r.randint(0, 30))), r.choice(["", "src7", "the rash"])) for i in range(n)]


def _batch(texts: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["docid", "c0"])


@pytest.mark.parametrize("spec", ["unicode61 remove_diacritics 0", "unicode61", "porter unicode61", "trigram"])
def test_memory_goes_by_slices(spec):
    """A batch of 32 MB takes no more than a few slices do; what is made of it has a row for a term of a slice, not of a document."""
    r = random.Random(1)
    vocabulary = ["".join(r.choices("abcdefghij", k=r.randint(2, 9))) for _ in range(3000)]
    texts = [" ".join(r.choices(vocabulary, k=600)) for _ in range(8000)]
    batch = _batch(texts)
    tracemalloc.start()
    made = tokens = 0
    for out in I._blocks(1, "full", spec, 500.0)(iter([batch])):
        made += out.num_rows
        tokens += sum(out.column(7).to_pylist())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120 << 20, peak
    assert tokens == sum(T.Tokenizer(spec).sizes(texts)) and made < tokens / 20


@pytest.mark.parametrize("spec", ["unicode61 remove_diacritics 0", "unicode61", "trigram"])
def test_tokens_are_those_of_regular_expressions(spec):
    texts = [t or "" for _, t, _ in _texts(60)] + ["", "́", "é́ ́x", "ab", "a"]
    marks = "".join(chr(c) for c in range(0x32400) if T._kinds()[c] == 2)
    word = r"[^\W_]+" if "0" in spec else rf"[^\W_](?:[^\W_]|[{marks}])*"
    want = [(i, w) for i, t in enumerate(texts) for w in ([t[j : j + 3] for j in range(len(t) - 2)] if spec == "trigram" else re.findall(word, t))]
    got = T.Tokenizer(spec).cut(texts)
    assert list(zip(got.doc.tolist(), got.names(got.code).to_pylist())) == want


@pytest.mark.parametrize("detail", ["full", "column", "none"])
def test_slices_change_nothing(spark, tmp_path, monkeypatch, detail):
    docs = spark.createDataFrame(_texts(120), "id long, body string, title string")
    rows = lambda ix: sorted(map(str, ix.postings.drop("bucket").collect()))
    whole = FtsIndex.build(docs, "id", ("body", "title"), "unicode61", detail).save(f"{tmp_path}/whole", 3)
    terms = lambda ix: sorted((r.term, r.docs, r.hits, round(r.bound, 9)) for r in ix.vocabulary.collect())
    monkeypatch.setattr(I, "SLICE", 1)
    made = list(I._blocks(1, detail, "unicode61", 9.0)(iter([_batch([t or "" for _, t, _ in _texts(120)])])))
    assert max(len(set(sum(b.column(2).to_pylist(), []))) for b in made) == 1
    back = FtsIndex(whole.postings.drop("bucket"), whole.stats, whole.columns, whole.spec, detail).save(f"{tmp_path}/back", 3)
    assert rows(back) == rows(whole) and terms(back) == terms(whole)
    exact = {r.term: (r.docs, r.hits) for r in whole.postings.groupBy("term").agg(F.count_distinct("docid").alias("docs"), F.sum("tf").alias("hits")).collect()}
    assert {t: (d, h) for t, d, h, _ in terms(whole)} == exact


def test_repeated_ids_count_once(spark, tmp_path):
    docs = spark.createDataFrame([(1, "the cat"), (1, "the dog"), (2, "the")], "id long, body string").repartition(3)
    ix = FtsIndex.build(docs, "id", ("body",)).save(f"{tmp_path}/ix", 2)
    assert ix.document_frequency("the") == 2 and ix.global_stats() == (2, 2.5)


def test_changed_index_is_stored_as_if_built_anew(spark, tmp_path):
    """Appended and deleted, then stored: phrases, prefixes and scores are those of an index of what is left."""
    docs = spark.createDataFrame(_texts(90), "id long, body string, title string")
    ix = FtsIndex.build(docs.where("id < 50"), "id", ("body", "title")).append(docs.where("id >= 50"), "id").delete(docs.where("id % 7 = 0").select(F.col("id").alias("docid")))
    fresh = FtsIndex.build(docs.where("id % 7 <> 0"), "id", ("body", "title")).save(f"{tmp_path}/fresh", 3)
    stored = ix.save(f"{tmp_path}/changed", 3)
    for q in ('"the of"', "ru* NOT rash", "title : rash OR brash", '"the ra"*'):
        want = sorted((r.rowid, round(r.rank, 9)) for r in fresh.score(q).collect())
        assert want and sorted((r.rowid, round(r.rank, 9)) for r in stored.score(q).collect()) == want == sorted((r.rowid, round(r.rank, 9)) for r in ix.score(q).collect()), q


def test_stems_are_kept_between_slices(monkeypatch):
    calls = []
    monkeypatch.setattr(T, "stem", lambda w: calls.append(w) or w)
    monkeypatch.setattr(I, "SLICE", 1)
    n = sum(b.num_rows for b in I._blocks(1, "full", "porter unicode61", None)(iter([_batch(["losers running"] * 50)])))
    assert n == 100 and len(calls) == 2
