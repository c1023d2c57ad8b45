import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tessera.llm import suffix_dedup as S


def brute(rows, length):
    count = Counter(b[i : i + length] for _, t in rows for b in [(t or "").encode()] for i in range(len(b) - length + 1))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed=4):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé𝒳") for _ in range(r.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(60) for _ in range(4)]
    rows = [(i, prose(r.randint(0, 80)) + r.choice(passages)[r.randint(0, 30) : r.randint(250, 400)] + prose(r.randint(0, 40))) for i in range(50)]
    rows += [(60, rows[3][1]), (60, rows[3][1]), (61, rows[4][1][:190]), (62, rows[4][1][:190]), (None, rows[5][1] + "tail"), (63, None), (64, ""), (65, "ab" * 400), (66, "z" * 300), (67, "y" * 200), (68, "y" * 199)]
    return rows


@pytest.mark.parametrize("hot,shard,slices", [(2000, 1_000_000, 1 << 22), (3, 1_000_000, 1 << 22), (2000, 900, 256)])
def test_matches_brute_force(spark, monkeypatch, hot, shard, slices):
    monkeypatch.setattr(S, "SLICE", slices)
    monkeypatch.setattr(S, "HOT", hot)
    monkeypatch.setattr(S, "SHARD_BYTES", shard)
    rows = corpus()
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, m long, runs string")
    got = S.remove_repeated_bytes(df).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, 200)
    assert sum(r.n_removed for r in got) > 0


def test_empty_table(spark):
    assert S.remove_repeated_bytes(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_suffix_ranks():
    r = random.Random(2)
    for _ in range(200):
        s = np.array([r.randint(1, r.choice([1, 2, 9])) for _ in range(r.randint(1, 50))])
        assert np.argsort(S.suffix_ranks(s)).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


def test_anchors_dont_depend_on_the_text_around():
    """A passage has the same keys in a short and in a long text, and in slices."""
    r = random.Random(9)
    passage = bytes(r.randrange(97, 123) for _ in range(900))
    long = bytes(r.randrange(97, 123) for _ in range(300_000)) + passage
    one = S.segments(np.frombuffer(passage, np.uint8), np.array([len(passage)]))
    two = S.segments(np.frombuffer(long, np.uint8), np.array([len(long)]))
    assert set(one[0].tolist()) <= set(two[0].tolist()) and len(one[0]) > 3
