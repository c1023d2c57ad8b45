import re
from collections import Counter

import corpus_pipeline as P
import pytest
from tessera.llm import near_dedup, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k_m string, size int"


def shingle_bag(t):
    w = (t or "").split()
    return Counter(tuple(w[a : a + 5]) for a in range(max(1, len(w) - 4))) if w else Counter()


def rows():
    base = [" ".join(f"w{i}x{k}" for k in range(60)) for i in range(12)]
    out = [(i, t) for i, t in enumerate(base)]
    out += [(20 + i, t.replace("x30", "changed")) for i, t in enumerate(base[:6])]
    out += [(40, base[0]), (41, base[0]), (41, base[0]), (None, base[1]), (50, None), (51, ""), (52, "few words"), (53, "few  words"), (54, "other few"), (60, "key token=abcdefgh12 end " + base[11].replace("w", "v"))]
    out += [(70 + i, " ".join(f"d{i}y{k}" if k % (2 + i) else f"shared{k}" for k in range(80))) for i in range(6)]
    return [(i, t, "en", ["a", "b", None][k % 3], None if t is None else len(t), "x", 3) for k, (i, t) in enumerate(out)]


def brute_classes(data, similarity=0.8):
    texts = {t: shingle_bag(t) for _, t, *_ in data}
    up = {t: t for t in texts}

    def root(t):
        while up[t] != t:
            t = up[t]
        return t

    for a, x in texts.items():
        for b, y in texts.items():
            if a is not b and x and y and sum((x & y).values()) >= similarity * sum((x | y).values()):
                up[root(a)] = root(b)
    low = {}
    for i, t, *_ in data:
        low[root(t)] = min(low.get(root(t), 2**63), 2**63 if i is None else i)
    out = []
    for i, t, *_ in data:
        c = (low[root(t)] if low[root(t)] < 2**63 else None) if (t or "").split() else i
        out.append((i, c, i == c))
    return out


@pytest.mark.parametrize("block", [2048, 2])
def test_near_duplicates_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "MEMBERS_A_BLOCK", block)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows(), SCHEMA)).select("doc_id", "class_id", "kept").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute_classes(rows()), key=repr)
    assert near_dedup.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_signature_agreement_estimates_similarity():
    a = " ".join(f"w{k}" for k in range(400)).encode()
    b = " ".join(f"w{k}" if k % 45 else "z" for k in range(400)).encode()
    strips, at = near_dedup.elements([a, b, b"w1 w1 w1", b""])
    sig = near_dedup.dart_signatures(strips, at, 4, 512)
    x, y = set(strips[at == 0].tolist()), set(strips[at == 1].tolist())
    assert abs((sig[0] == sig[1]).mean() - len(x & y) / len(x | y)) < 0.08
    assert (sig[3] == 0).all() and (sig[:3] != 0).all()


def test_stages(spark, tmp_path):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(12)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    d = str(tmp_path)
    clean = P.toxic(spark, df, d)
    assert clean.schema == df.schema and clean.count() == len(data)
    one = P.near(spark, clean, d)
    assert one.columns == df.columns
    assert Counter(r.doc_id for r in one.collect()) == Counter({i for i, c, k in brute_classes(data) if k})
    safe = P.secret(spark, one, d)
    got = {r.doc_id: r for r in safe.collect()}
    assert safe.columns == df.columns and "abcdefgh12" not in got[60].text and "[SECRET]" in got[60].text and got[60].n_chars == len(got[60].text)
    assert all(got[r.doc_id] == r for r in one.collect() if r.doc_id != 60)
    mix = P.mixed(spark, safe, d)
    assert mix.columns == df.columns
    words = Counter()
    for r in mix.collect():
        words[r.doc_id] += len(r.text.split())
    assert all(n <= 2 * len((got[i].text or "").split()) for i, n in words.items())
    assert abs(sum(words.values()) - 1.5 * sum(len((r.text or "").split()) for r in got.values())) <= 3
    bins = P.packed(spark, mix, d).collect()
    total = Counter()
    for b in bins:
        total[b.doc_id] += b["size"]
    assert total == words
    assert all(n == 1 for n in Counter((b.bin_id, b.doc_id) for b in bins).values())
    empty = df.limit(0)
    for _, stage in P.STAGES:
        empty = stage(spark, empty, d)
        assert empty.collect() == []


def test_toxic_stage_drops_only_rejected(spark, tmp_path):
    from tests.llm.test_toxicity import corpus

    data = corpus(300)
    df = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t, _ in data], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(i, 1, x) for i, _, x in data], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = {r.doc_id for r in P.toxic(spark, df, str(tmp_path)).collect()}
    assert sum((i in kept) == (not x) for i, _, x in data) / len(data) > 0.93
    assert re.match("1|0", str(int(toxicity.held_out_crc(5))))


def test_run_is_its_stages_and_keeps_what_brute_force_keeps(spark, tmp_path):
    """``run`` over a folder: the documents that plain Python keeps after near-dedup, each with at most twice its words, in bins that hold no document twice."""
    from tests.llm.test_toxicity import corpus

    bad = [(1000 + i, t, "en", "a", len(t), "x", 3) for i, t, x in corpus(240) if x]
    good = [(2000 + i, t, "en", "b", len(t), "x", 3) for i, t, x in corpus(240) if not x]
    data = rows() + bad + good
    spark.createDataFrame(data, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i < 2000)) for i, *_ in bad + good], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    d = str(tmp_path)
    out = P.run(spark, d).collect()
    docs = spark.read.parquet(f"{d}/documents.parquet")
    clean = [tuple(r) for r in P.toxic(spark, docs, d).collect()]
    keep = {i for i, c, k in brute_classes(clean) if k}
    texts = {i: len((t or "").split()) for i, t, *_ in clean if i in keep}
    words, bins = Counter(), Counter()
    for r in out:
        words[r.doc_id] += r["size"]
        if r.bin_id is not None:
            bins[r.bin_id, r.doc_id] += 1
    assert set(words) <= keep and all(n <= 2 * texts[i] for i, n in words.items()) and max(bins.values()) == 1
    assert abs(sum(words.values()) - 1.5 * sum(texts.values())) <= 3
    caught = sum(i not in {c[0] for c in clean} for i, *_ in bad) / len(bad)
    assert caught > 0.9 and sum(i in {c[0] for c in clean} for i, *_ in good) / len(good) > 0.9
