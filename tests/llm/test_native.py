import hashlib
import re

import duckdb
import pyarrow as pa
import pytest

from tessera.llm import mixing, secrets

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, target string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None, 7, "x") for i, t, s in rows], DOCS)


def brute(text):
    text = text or ""
    found = []
    for m in re.finditer(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A):
        if len(m[1]) >= 6:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    base = sorted(found)
    weak = [(m.start(), 3, m.end()) for m in re.finditer(secrets.IDENT, text, re.A)]
    weak += [(m.start(), 4, m.end()) for m in re.finditer(secrets.BLOB, text) if re.search("[A-Za-z]", m[0]) and re.search("[0-9]", m[0])]
    weak += [(m.start(), 5, m.end()) for m in re.finditer(secrets.ENDPOINT, text)]
    role = {0: 1, 1: 0, 2: 1, 3: 0, 4: 1, 5: 2}
    out = []
    for w in weak:
        near, over = set(), False
        for p in base + weak:
            gap = max(w[0], p[0]) - min(w[2], p[2])
            if abs(w[0] // secrets.SCOPE - p[0] // secrets.SCOPE) > 1:
                continue
            if 0 <= gap <= secrets.SCOPE:
                near.add(role[p[1]])
            over |= gap < 0 and w[1] == 4 and p[1] != 4
        if {0: 1 in near, 1: 0 in near and not over, 2: {0, 1} <= near}[role[w[1]]]:
            out.append(w)
    say = lambda xs: ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in sorted(xs))
    n = lambda k: sum(x[1] == k for x in base)
    return n(0), n(1), n(2), hashlib.sha256(say(base).encode()).hexdigest(), say(base + out)


TEXTS = [
    None, "", "plain words", 'héé𝒳 token = "abcdef12" and PassWord:xyz secret:token:abcdefgh api_key=ab', "AKIA" + "A1" * 9 + " AKIAX",
    "0123456789abcdef01234567 " * 3, 'client_id = "robot-7" ' + "Zz9" * 12 + " https://api.example.com/v1",
    "https://alone.example.com " + "x" * 500 + " user_name: bob", "Aa1" * 11 + " lonely", "ſecret=abcdefgh toKen='=======' ",
    "z" * 100_000 + " token=abcdefghij " + "AKIA" + "B" * 16, "token=abcdefg" * 30,
]


def test_secrets_match_brute_force(spark):
    rows = [(i, t, None) for i, t in enumerate(TEXTS)] + [(None, TEXTS[3], "a"), (3, TEXTS[3], "a")]
    got = sorted(map(repr, (tuple(r) for r in secrets.digest(secrets.find_secrets(docs(spark, rows))).collect())))
    assert got == sorted(repr((i, *brute(t))) for i, t, _ in rows)


def test_secrets_link_only_with_complements(spark):
    found = {r.doc_id: r.spans for r in secrets.digest(secrets.find_secrets(docs(spark, [(i, t, "s") for i, t in enumerate(TEXTS)]))).collect()}
    assert all(k in found[6] for k in ("ident", "blob", "endpoint"))
    assert found[7] == "" and found[8] == ""


def test_redact(spark):
    rows = docs(spark, [(1, TEXTS[3], "s"), (2, "ab token=abcdef cd", "s"), (3, "none", "s")])
    found = secrets.find_secrets(rows).withColumnRenamed("doc_id", "i")
    out = {r.doc_id: r.t for r in rows.join(found, rows.doc_id == found["i"]).select("doc_id", secrets.redact(rows.text, found.spans).alias("t")).collect()}
    assert out[2] == "ab [SECRET] cd" and out[3] == "none" and "abcdef12" not in out[1] and out[1].startswith("héé𝒳 [SECRET]")


def test_secrets_empty_table(spark):
    assert secrets.digest(secrets.find_secrets(docs(spark, []))).collect() == []


@pytest.mark.parametrize("n", [0, 1, 7, 400])
def test_mix_matches_sql(spark, n):
    words = lambda k: " ".join(["wörd"] * k)
    rows = [(None if i % 41 == 5 else i - i % 2 * (i % 13 == 0), None if i % 17 == 3 else words(i * i % 53), [None, "", "b", "é", "hot", "hot"][i % 6]) for i in range(n)]
    rows += rows[:3]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(0, n, 3)] + [(1, 1, 0), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    got = [tuple(r) for r in mixing.mix(docs(spark, rows), mixing.label_quality(labels)).drop("m").collect()]
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string()), "source": pa.array([r[2] for r in rows], pa.string())}))
    con.register("labels", labels.toArrow())
    assert sorted(map(repr, got)) == sorted(map(repr, con.execute(mixing.SQL).fetchall()))
    assert len(got) == len(rows) and all(taken <= 2 * size for _, size, _, _, taken in got)
    if n == 400:
        assert abs(sum(r[4] for r in got) - 1.5 * sum(r[1] for r in got)) <= 5


def test_mix_bins_are_exact(spark, monkeypatch):
    rows = [(i, "w " * (i % 30), "hot") for i in range(3000)] + [(i, "w", "tail") for i in range(3000, 3020)]
    whole = sorted(map(tuple, mixing.mix(docs(spark, rows)).collect()))
    monkeypatch.setattr(mixing, "ROWS_A_BIN", 50)
    assert sorted(map(tuple, mixing.mix(docs(spark, rows)).collect())) == whole


def test_secrets_sql_matches_brute_force():
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array(range(len(TEXTS)), pa.int64()), "text": pa.array(TEXTS, pa.string())}))
    assert sorted(con.execute(secrets.sql()).fetchall()) == [(i, *brute(t)) for i, t in enumerate(TEXTS)]


@pytest.mark.parametrize("size", [150, 200, 450, 1000, 20_000])
def test_secrets_link_across_long_spans(spark, size):
    """A part is near by the gap between its end and the next start, however long it is."""
    blob, long_id, url = ("Zz9" * size)[:size], "client_id=" + "a-" * (size // 2), "https://api.example.com/" + "p-" * (size // 2)
    close, far = " " * secrets.SCOPE, " " * (secrets.SCOPE + 1)
    texts = [blob + " " * 10 + "client_id=robot", blob + close + "client_id=robot", blob + far + "client_id=robot", blob + " " * 100 + "client_id=robot" + " " * 50 + url,
             url + " user_name: bob token=abcdefgh", url + " user_name: bob", long_id + close + "token=abcdefgh", long_id + far + "token=abcdefgh", "token=" + blob + close + long_id]
    got = {r.doc_id: r.spans for r in secrets.digest(secrets.find_secrets(docs(spark, [(i, t, "s") for i, t in enumerate(texts)]))).collect()}
    kinds = [[x.split(":")[0] for x in got[i].split(",") if x] for i in range(len(texts))]
    assert kinds == [["blob", "ident"], ["blob", "ident"], [], ["blob", "ident", "endpoint"], ["endpoint", "ident", "assign"], [], ["ident", "assign"], ["assign"], ["assign", "ident"]]
    assert got[0] == f"blob:0:{size},ident:{size + 10}:{size + 25}"


def test_secrets_link_inside_endpoints(spark):
    """Only base spans cover a blob; what an endpoint holds is near it."""
    blob, key = "Zz9" * 13 + "Z", "AKIA" + "A1" * 8
    url = f"https://api.example.com/x?sig={blob}"
    texts = [f"{key} {url}", url, f"https://api.example.com/x?client_id=robot {blob}", "user_name: bob https://api.example.com/x?token=abcdefgh", f"token={blob} user_name: bob", f"client_id={blob}"]
    got = {r.doc_id: r.spans for r in secrets.digest(secrets.find_secrets(docs(spark, [(i, t, "s") for i, t in enumerate(texts)]))).collect()}
    kinds = [[x.split(":")[0] for x in got[i].split(",") if x] for i in range(len(texts))]
    assert kinds == [["access", "endpoint", "blob"], [], ["endpoint", "ident", "blob"], ["ident", "endpoint", "assign"], ["assign", "ident"], []]
