import random

import numpy as np
import pytest

from tessera.llm import toxicity as T


def corpus(n, seed=3):
    r = random.Random(seed)
    pool = [a + b + c for a in "bdfgk" for b in "aeiou" for c in ("ran", "lin", "tos", "m")]
    rows = []
    for i in range(n):
        w = [r.choice(pool) for _ in range(r.choice([5, 30, 150, 400]))]
        bad = i % 3 == 0
        if bad:
            for _ in range(max(2, len(w) // 25)):
                w[r.randrange(len(w))] = r.choice(["Vile", "scumbag", "zorch" + r.choice(pool)])
        rows.append((i, " ".join(w), int(bad)))
    return rows


def test_gradients_match_differences():
    m = T.new_model(1)
    m = {k: v.astype(np.float64) for k, v in m.items()}
    w = T.Words([b"one two three four five", b"a bb ccc"])
    start, length, text = T.windows(w.count)
    label, weight = np.array([1.0, 0.0]), np.array([0.7, 0.3])

    class Keep:
        def random(self, n):
            return np.ones(n)

    g = T._gradients(m, w, start, length, label, weight, Keep())

    def loss():
        x = T._inputs(m, w)
        out = 0.0
        for i in range(2):
            v = x[start[i] : start[i] + length[i]][:, None]
            h = np.concatenate([T._recur(m, d, v @ m[f"W{d}"] + m[f"c{d}"], None, None) for d in "fb"], 2)
            p = T._sigmoid(T._attend(m, h, None)[3])[0]
            out -= weight[i] * np.log(p if label[i] else 1 - p)
        return out

    for k in ("Wf", "Ub", "A", "v", "w", "o", "cb"):
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        old = m[k][at]
        m[k][at] = old + 1e-3
        up = loss()
        m[k][at] = old - 1e-3
        down = loss()
        m[k][at] = old
        assert (up - down) / 2e-3 == pytest.approx(g[k][at], rel=0.02, abs=1e-4)


def test_windows_cover_and_overlap():
    start, length, text = T.windows(np.array([0, 1, 64, 65, 500]))
    assert (text == 0).sum() == 0 and (text == 1).sum() == 1 and (text == 2).sum() == 1
    for i, n in ((3, 65), (4, 500)):
        s = start[text == i] - (0 + 1 + 64 + (65 if i == 4 else 0))
        assert s[0] == 0 and s[-1] + 64 == n and (np.diff(s) <= T.STRIDE).all()


def test_held_out_accuracy_and_edges(spark):
    rows = corpus(500)
    docs = spark.createDataFrame([(i, t, 9.0) for i, t, _ in rows] + [(1001, None, 0.0), (1002, "", 0.0), (None, "scumbag Vile scumbag", 0.0), (1003, "balran " * 90_000 + "scumbag Vile zorchbim scumbag Vile", 0.0)], "doc_id long, text string, toxicity_score double")
    labels = spark.createDataFrame([(i, 1, x) for i, _, x in rows] + [(None, 1, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    model = T.fit(docs, labels)
    out = T.score(docs, model)
    assert out.columns == ["doc_id", "text", "toxicity_score"]
    got = {r.doc_id: r.toxicity_score for r in out.collect()}
    assert all(0 <= s <= 1 for s in got.values()) and len(got) == 504
    held = [(got[i] >= 0.5) == bool(x) for i, _, x in rows if T.held_out_crc(i)]
    assert np.mean(held) > 0.9
    assert got[1001] == got[1002] and got[1001] < 0.5
    again = {r.doc_id: r.toxicity_score for r in T.score(docs.repartition(7), T.fit(docs.repartition(3), labels)).collect()}
    assert all(abs(again[k] - got[k]) < 1e-4 for k in got)
    assert T.score(docs.limit(0), model).collect() == []
    assert T.fit(docs.limit(0), labels.limit(0))["beta"][3] < 0
    assert spark.range(50).where("crc32(cast(cast(id as string) as binary)) % 5 = 0").count() == sum(T.held_out_crc(i) for i in range(50))


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 90, 96, 97, 1000, 40_003])
def test_long_texts_have_the_windows_of_short_ones(monkeypatch, n):
    m = T.new_model(2)
    t = (" ".join(f"w{k % 977}" for k in range(n))).encode() + b"\n "
    whole = T.window_logits(m, [b"a b c", t, b""])
    for piece in (1, 100, 7_000):
        if n * piece < 5_000_000 and n < 2000 * piece:
            monkeypatch.setattr(T, "PIECE", piece)
            cut = T.window_logits(m, [b"a b c", t, b""])
            assert (whole[1] == cut[1]).all() and (whole[2] == cut[2]).all() and np.allclose(whole[0], cut[0], atol=1e-5)


def test_a_word_longer_than_a_piece(monkeypatch):
    m, t = T.new_model(2), b"one " + b"x" * 900 + b" two " * 100
    whole = T.window_logits(m, [t])
    monkeypatch.setattr(T, "PIECE", 50)
    assert np.allclose(whole[0], T.window_logits(m, [t])[0], atol=1e-5)
