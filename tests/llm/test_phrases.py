import hashlib
import random

import pyarrow as pa
import pytest

from tessera.llm import phrases
from tessera.llm.textnp import shingles, word_hashes

SCHEMA = "doc_id long, text string, d long, flags string, kept_text string"


def brute(rows, window):
    first = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for a in range(len(w) - window + 1):
            key = tuple(w[a : a + window])
            first[key] = min(first.get(key, 2**64), 2**63 if i is None else i)
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for a in range(len(w) - window + 1):
            if first[tuple(w[a : a + window])] < (2**63 if i is None else i):
                gone[a : a + window] = [True] * window
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed=1, n=60):
    r = random.Random(seed)
    pool = [f"w{k}é" for k in range(400)]
    passage = [[r.choice(pool) for _ in range(40)] for _ in range(6)]
    rows = []
    for i in range(n):
        w = []
        for _ in range(r.randint(0, 6)):
            p = r.choice(passage)
            a = r.randint(0, 30)
            w += p[a : a + r.randint(5, 40)] if r.random() < 0.6 else [r.choice(pool) for _ in range(r.randint(1, 30))]
        rows.append((i * 3 % n, r.choice([" ", "\n", "\t "]).join(w)))
    rows += [(500, rows[3][1]), (501, rows[3][1]), (None, rows[4][1]), (2, rows[5][1]), rows[7], rows[7], (600, None), (601, ""), (602, "a " * 4000), (1, "a " * 20), (603, "nb sp \x1c x " * 9), (604, "nb sp \x1c x " * 9 + "tail")]
    return rows


@pytest.mark.parametrize("size", [40_000, 3])
def test_matches_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(phrases, "STRETCHES_A_SHARD", size)
    monkeypatch.setattr(phrases, "PATTERNS_A_SHARD", size)
    rows = corpus()
    df = spark.createDataFrame([(i, t, 5, "x", "y") for i, t in rows], SCHEMA)
    got = phrases.remove_repeats(df, digest=True)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, 13)


def test_long_text_and_empty_table(spark):
    long = " ".join(f"x{k}" for k in range(200_000))
    rows = [(1, "start " + long), (2, long[300_000:])]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in phrases.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    n = len(rows[1][1].split())
    assert got == {1: (200_001, 0), 2: (n, n - 1)} or got == {1: (200_001, 0), 2: (n, n)}
    assert phrases.remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []


def nothing(known, passing):
    kinds = [("key", pa.int64()), ("f", pa.int64()), ("at", pa.int32()), ("n", pa.int32()), ("owner", pa.int64())]
    return pa.Table.from_arrays([pa.array([], k) for _, k in kinds], [n for n, _ in kinds])


def test_the_automaton_decides(spark, monkeypatch):
    """Without what the automata locate, only copies of whole texts go."""
    df = spark.createDataFrame(corpus(), "doc_id long, text string")
    assert phrases.remove_repeats(df).where("n_removed > 0 and n_removed < n_words").count() > 10
    monkeypatch.setattr(phrases, "_locate", lambda window: nothing)
    assert phrases.remove_repeats(df).where("n_removed > 0 and n_removed < n_words").count() == 0


def test_occurrences():
    a, b = [b"x", b"y", b"z"], [b"y", b"z", b"q"]
    texts = [[b"x", b"y", b"z", b"q"], [], [b"other"], [b"z", b"x", b"y", b"z"]]
    assert [x.tolist() for x in phrases.occurrences([a, b], texts, 3)] == [[0, 0, 3], [0, 1, 1], [0, 1, 0]]
    assert phrases.occurrences([], texts, 3)[0].tolist() == []


def test_hashes_depend_on_words_only():
    a, n = word_hashes([b" one two\x0bthree ", b"", b"two three"])
    assert n.tolist() == [3, 0, 2] and a[1] == a[3] and a[2] == a[4] and len(set(a.tolist())) == 3
    h, ok = shingles(a, n, 2)
    assert ok.tolist() == [True, True, False, True] and h[1] == h[3]
