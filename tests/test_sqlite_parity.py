"""Functions and full-text search against Python's sqlite3, whose dialect is the contract."""

import math
import sqlite3

import pytest
from pyspark.sql import functions as F

from tessera.fts.index import FtsIndex
from tessera.fts.porter import stem
from tessera.fts.query import MAX_DEPTH, QueryError, parse
from tessera.functions import expr as E
from tessera.functions import json1 as J

TEXTS = ["", "abc", "ABC", "5x", " 12.5e1z", "-7", "+3.", ".5", "héÀé", "a%b_c", "99999999999999999999", "-99999999999999999999", "1e400", None, "0x1A", "𝒳y"]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i long, t string").repartition(1)


def both(df, column, sql, args=()):
    got = [r[0] for r in df.orderBy("i").select(column).collect()]
    con = sqlite3.connect(":memory:")
    want = [con.execute(f"select {sql}", {"t": t} | dict(args)).fetchone()[0] for t in TEXTS]
    return got, want


def close(a, b):
    return a == b or (a is not None and b is not None and isinstance(a, float) and math.isclose(a, b, rel_tol=1e-12))


CASES = {
    "lower": (lambda t: E.lower(t), "lower($t)"),
    "upper": (lambda t: E.upper(t), "upper($t)"),
    "cast_integer": (lambda t: E.cast_integer(t), "cast($t as integer)"),
    "cast_real": (lambda t: E.cast_real(t), "cast($t as real)"),
    "truth": (lambda t: E.as_integer(E.truth(t, "text")), "case when $t then 1 when not $t then 0 end"),
    "instr": (lambda t: E.instr(t, "b"), "instr($t, 'b')"),
    "length": (lambda t: F.char_length(t), "length($t)"),
    "like": (lambda t: E.as_integer(E.like(t, "A%")), "$t like 'A%'"),
    "like_one": (lambda t: E.as_integer(E.like(t, "_b_")), "$t like '_b_'"),
    "like_slash": (lambda t: E.as_integer(E.like(t, "a\\b%")), "$t like 'a\\b%'"),
    "concat": (lambda t: E.concat(t, F.lit(7)), "$t || 7"),
    "in_null": (lambda t: E.as_integer(E.is_in(t, ["abc", None])), "$t in ('abc', null)"),
    "in_empty": (lambda t: E.as_integer(E.is_in(t, [])), "$t in ()"),
} | {f"substr{a},{b}": (lambda t, a=a, b=b: E.substr(t, a, b), f"substr($t, {a}" + ("" if b is None else f", {b}") + ")") for a in (-9, -2, 0, 1, 3, 40) for b in (None, -2, 0, 2, 50)}


@pytest.mark.parametrize("name", CASES)
def test_text_functions(texts, name):
    f, sql = CASES[name]
    got, want = both(texts, f(F.col("t")), sql)
    assert all(close(a, b) for a, b in zip(got, want)), list(zip(TEXTS, got, want))


def test_empty_needle_is_zero(texts):
    assert {r[0] for r in texts.select(E.instr(F.col("t"), "")).collect()} == {0, None}


def test_arithmetic_beyond_64_bits(spark, tmp_path):
    """The registered query on keys whose product leaves 64 bits: exact rows stay exact, the others are the cast REAL."""
    from tessera.plans.relational import arithmetic

    keys = [19999, 102399, 102401, 1199999, None]
    spark.createDataFrame([(7, 1, k, 10.5, 3.0) for k in keys], "l_orderkey long, l_linenumber long, l_partkey long, l_extendedprice double, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = sqlite3.connect(":memory:")
    sql = "select cast(k + 9007199254740993 as integer), cast(k * -90071992547409 as integer), cast(k - 9007199254740993 as integer) from (select ? k)"
    want = [con.execute(sql, (k,)).fetchone() for k in keys]
    assert sorted(map(str, (tuple(r) for r in arithmetic(spark, str(tmp_path)).select("s", "p", "t").collect()))) == sorted(map(str, want))


def test_numbers(spark):
    pairs = [(7, 2), (-7, 2), (7, -2), (7, 0), (2**63 - 1, 1), (-(2**63), -1), (None, 3), (3, None), (0, 5)]
    con = sqlite3.connect(":memory:")
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a long, b long").orderBy("i")
    a, b = F.col("a"), F.col("b")
    for f, sql in ((E.add, "a + b"), (E.subtract, "a - b"), (E.multiply, "a * b"), (lambda a, b, overflow: E.negate(a, overflow), "-a")):
        want = [con.execute(f"select {sql} from (select ? a, ? b)", p).fetchone()[0] for p in pairs]
        got = [None if r[0] is None else r[0].toPython() for r in df.select(f(a, b, overflow="variant")).collect()]
        assert [(type(x), x) for x in got] == [(type(y), y) for y in want], (sql, got, want)
        real = [r[0] for r in df.select(f(a, b, overflow="real")).collect()]
        assert all(x == (None if y is None else float(y)) for x, y in zip(real, want))
        small = df.where("a is null or a between -99 and 99")
        kept = [r[0] for r in small.select(f(a, b, overflow="raise")).collect()]
        assert kept == [y for (x, _), y in zip(pairs, want) if x is None or abs(x) < 100]
        cast = [con.execute(f"select cast({sql} as integer) from (select ? a, ? b)", p).fetchone()[0] for p in pairs]
        assert [r[0] for r in df.select(f(a, b, overflow="integer")).collect()] == cast, sql
    with pytest.raises(Exception, match="integer overflow"):
        df.select(E.add(a, F.lit(1))).collect()
    assert df.limit(1).select(E.add(F.lit(2**53 + 1), F.lit(0))).first()[0] == 2**53 + 1
    real = df.select(E.real_mod(F.col("a") * F.lit(0.5), b)).collect()
    assert [r[0] for r in real] == [con.execute("select a * 0.5 % b from (select ? a, ? b)", p).fetchone()[0] for p in pairs]
    small = df.where("i <> 5")
    for column, sql in ((E.int_divide(a, b), "a / b"), (E.int_mod(a, b), "a % b")):
        assert [r[0] for r in small.select(column).collect()] == [con.execute(f"select {sql} from (select ? a, ? b)", p).fetchone()[0] for i, p in enumerate(pairs) if i != 5]


def test_reals(spark):
    values = [0.0, 2.5, 100.0, 1e20, 1.5e-7, -0.1, 1 / 3, 123456789012345680.0, 1e15]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i")
    con = sqlite3.connect(":memory:")
    assert [r[0] for r in df.select(E.real_to_text("v")).collect()] == [con.execute("select cast(? as text)", (v,)).fetchone()[0] for v in values]
    big = spark.createDataFrame([(9007199254740993, 9007199254740992.0), (5, 5.0), (5, 5.5)], "i long, r double")
    assert [tuple(r) for r in big.select(E.int_real_equal(F.col("i"), F.col("r")), E.int_real_less(F.col("i"), F.col("r"))).collect()] == [(False, False), (True, False), (False, True)]


DOCS = ['{"a":1,"b":[1,2.50,"x",null],"c":{"d":"é"},"t":true}', '{"b":[], "a":"s"}', "[1,2,3]", '"str"', "3", "null", None]


def test_json_against_sqlite(spark):
    con = sqlite3.connect(":memory:")
    df = spark.createDataFrame([(i, d) for i, d in enumerate(DOCS)], "i int, d string").repartition(1).orderBy("i")
    d = F.col("d")
    cases = [
        (J.json_type(d), "json_type($d)"), (J.json_type(d, "$.a"), "json_type($d,'$.a')"), (J.json_type(d, "$.t"), "json_type($d,'$.t')"),
        (J.array_length(d), "json_array_length($d)"), (J.array_length(d, "$.b"), "json_array_length($d,'$.b')"), (J.valid(d), "json_valid($d)"),
        (J.minify(d), "json($d)"), (J.set_(d, ("$.a", 9), ("$.z", "q")), "json_set($d,'$.a',9,'$.z','q')"), (J.insert(d, ("$.a", 9), ("$.y", 1.5)), "json_insert($d,'$.a',9,'$.y',1.5)"),
        (J.replace(d, ("$.b[1]", 7)), "json_replace($d,'$.b[1]',7)"), (J.set_(d, ("$.b[#]", 7)), "json_set($d,'$.b[#]',7)"), (J.remove(d, "$.b[#-1]", "$.c"), "json_remove($d,'$.b[#-1]','$.c')"), (J.remove(d, "$"), "json_remove($d,'$')"),
        (J.patch(d, '{"a":null,"c":{"e":2}}'), "json_patch($d,'{\"a\":null,\"c\":{\"e\":2}}')"),
        (J.extract(d, "$.c.d"), "json_extract($d,'$.c.d')"), (J.extract(d, "$.b[0]", "bigint"), "json_extract($d,'$.b[0]')"),
    ]
    for k, (column, sql) in enumerate(cases):
        got = [r[0] for r in df.select(column).collect()]
        want = [con.execute(f"select {sql}", {"d": x}).fetchone()[0] for x in DOCS]
        want[-1] = None  # NULL in, NULL out, json_valid too
        assert got == want, (sql, got, want)


CORPUS = [
    (1, "The running dogs ran to Café Müller", "alpha"), (2, "A dog runs; the cat's hopefully relational", "beta dog"), (3, None, "gamma"), (4, "", ""),
    (5, "conditional rationalization of dogs dogs dogs", "dog"), (6, "the cat sat on the mat with the dog and the cat", "alpha cat"), (7, "x" * 300 + " tail dog", "beta"),
    (8, "agreed plastered motoring happy sky falling hissing fizzed failing filing", "word"),
]


@pytest.mark.parametrize("spec,fts5", [("unicode61 remove_diacritics 0", "unicode61 remove_diacritics 0"), ("unicode61 remove_diacritics 2", "unicode61 remove_diacritics 2"), ("porter unicode61 remove_diacritics 2", "porter unicode61 remove_diacritics 2"), ("trigram", "trigram")])
def test_fts_against_fts5(spark, spec, fts5):
    con = sqlite3.connect(":memory:")
    con.execute(f"create virtual table f using fts5(body, title, tokenize='{fts5}')")
    con.executemany("insert into f(rowid, body, title) values (?, ?, ?)", CORPUS)
    ix = FtsIndex.build(spark.createDataFrame(CORPUS, "id long, body string, title string"), "id", ("body", "title"), spec)
    queries = ["dog", "dogs OR cat", "the AND cat", "the NOT dog", '"the cat"', "ca*", "title : dog", "{body title} : alpha", "(dog OR cat) NOT alpha", "café", "running", "dog cat"]
    for q in queries if spec != "trigram" else ["dog", "cat OR ran", '"the cat"', "title : dog"]:
        want = con.execute("select rowid, bm25(f, 2.0, 5.0) from f where f match ? order by rowid", (q,)).fetchall()
        assert sorted(r[0] for r in ix.match(q).collect()) == [r for r, _ in want], q
        got = {r.rowid: r["rank"] for r in ix.score(q, [2.0, 5.0]).collect()}
        assert all(math.isclose(got[r], s, rel_tol=1e-9, abs_tol=1e-12) for r, s in want), (q, got, want)


def test_porter_against_fts5():
    words = "caresses ponies ties caress cats feed agreed plastered bled motoring sing conflated troubled sized hopping tanned falling hissing fizzed failing filing happy sky relational conditional rational valenci hesitanci digitizer conformabli radicalli differentli vileli analogousli vietnamization predication operator feudalism decisiveness hopefulness callousness formaliti sensitiviti sensibiliti triplicate formative formalize electriciti electrical hopeful goodness revival allowance inference airliner gyroscopic adjustable defensible irritant replacement adjustment dependent adoption homologou communism activate angulariti homologous effective bowdlerize probate rate cease controll roll generalizations oscillators a is by".split()
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table f using fts5(w, tokenize='porter')")
    con.execute("create virtual table v using fts5vocab(f, 'instance')")
    con.executemany("insert into f(rowid, w) values (?, ?)", list(enumerate(words)))
    want = dict(con.execute("select doc, term from v").fetchall())
    assert {i: stem(w) for i, w in enumerate(words)} == want


def test_fts_changes_and_errors(spark):
    docs = spark.createDataFrame(CORPUS, "id long, body string, title string")
    ix = FtsIndex.build(docs.where("id < 6"), "id", ("body", "title"), "unicode61 remove_diacritics 0")
    more = ix.append(docs.where("id >= 6"), "id").delete(spark.createDataFrame([(5,)], "docid long"))
    fresh = FtsIndex.build(docs.where("id <> 5"), "id", ("body", "title"), "unicode61 remove_diacritics 0")
    assert sorted(more.score("dog OR cat").collect()) == sorted(fresh.score("dog OR cat").collect())
    assert more.document_frequency("dog") == 3 or more.document_frequency("dog") == fresh.document_frequency("dog")
    assert ix.delete_all().match("dog").collect() == []
    with pytest.raises(ValueError):
        ix.append(docs.where("id = 1"), "id")
    with pytest.raises(QueryError):
        ix.match("nope : dog")
    for bad in ("", "(", "a OR", '"x" )', "{a b} x", "NOT a", "(" * (MAX_DEPTH + 5) + "a" + ")" * (MAX_DEPTH + 5)):
        with pytest.raises(QueryError):
            parse(bad)
    with pytest.raises(QueryError):
        FtsIndex.build(docs, "id", ("body",), detail="column").match('"the cat"')


VALUES = [(None, "integer"), (0, "integer"), (10, "integer"), (2**53 + 1, "integer"), (-3, "integer"), (10.0, "real"), (float(2**53), "real"), (0.5, "real"), ("10", "text"), (" 10.0 ", "text"), ("abc", "text"), ("ABC", "text"), ("1e1x", "text"), (b"abc", "blob"), (b"", "blob")]


def test_comparisons_of_all_classes(spark):
    """Columns of declared types and bare values on both sides, against sqlite3."""
    con = sqlite3.connect(":memory:")
    con.execute("create table t (integer integer, real real, text text, blob blob)")
    one = spark.range(1)
    names, columns, want = [], [], []
    for v, kind in VALUES:
        con.execute("delete from t")
        con.execute(f"insert into t ({kind}) values (?)", (v,))
        for w, other in VALUES:
            for op in ("=", "<"):
                want.append(con.execute(f"select {kind} {op} ? from t", (w,)).fetchone()[0])
                spark_type = {"integer": "bigint", "real": "double", "text": "string", "blob": "binary"}
                a = E.Typed(F.lit(v).cast(spark_type[kind]), kind, column=True)
                b = E.Typed(F.lit(w).cast(spark_type[other]), other)
                names.append((v, kind, op, w, other))
                columns.append(E.as_integer(E.compare(a, op, b)))
    got = []
    for i in range(0, len(columns), 60):
        got += list(one.select(*[c.alias(f"c{j}") for j, c in enumerate(columns[i : i + 60])]).first())
    wrong = [(n, g, w) for n, g, w in zip(names, got, want) if g != w]
    assert not wrong, wrong[:5]


def test_json_reads_match_sqlite(spark):
    docs = ['{"z":{"b":1,"a":2.50},"n":[1,2,[3]],"t":true,"x":null}', "[1,{\"k\":\"v\"},-0.5e3]", '"s"', "7", None, "{}", "[]"]
    paths = ["$", "$.z", "$.z.a", "$.n", "$.n[#-1]", "$.n[0]", "$[1]", "$[1].k", "$[#-1]", "$.t", "$.x", '$."z".b', "$.n[9]"]
    con = sqlite3.connect(":memory:")
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, d string").orderBy("i")
    for path in paths:
        rows = df.select(J.extract(F.col("d"), path), J.json_type(F.col("d"), path), J.array_length(F.col("d"), path)).collect()
        for d, r in zip(docs, rows):
            value, kind, n = con.execute("select json_extract($d, $p), json_type($d, $p), json_array_length($d, $p)", {"d": d, "p": path}).fetchone()
            assert r[1:] == (kind, n), (d, path, r)
            if kind in ("real",) and path != "$":
                assert float(r[0]) == value
            elif value is not None:
                assert r[0] == str(value), (d, path, r, value)
            else:
                assert r[0] is None
    bad = spark.createDataFrame([("{",), ('{"a":1,"a":2}',), ("NaN",), (None,)], "d string")
    assert [r[0] for r in bad.select(J.valid(F.col("d"))).collect()] == [0, 1, 0, None]
    with pytest.raises(Exception, match="Expecting|malformed|JSON"):
        bad.limit(1).select(J.extract(F.col("d"), "$.a")).collect()
    assert J.path_of(-1) == "$[#-1]"
    many = df.where("i = 0").select(J.extract_many(F.col("d"), "$.z", "$.q", "$.t")).first()[0]
    assert many == '[{"b":1,"a":2.50},null,true]'


def test_pruned_top_is_the_top_of_all(spark, tmp_path):
    """Frequent terms that can't lift a document are read for few documents, with the same result."""
    import random

    r = random.Random(6)
    rows = [(i, " ".join(["common"] * r.randint(0, 3) + [r.choice(["x", "y", "rare" if i % 23 == 0 else "z"]) for _ in range(r.randint(1, 12))])) for i in range(400)]
    ix = FtsIndex.build(spark.createDataFrame(rows, "id long, body string"), "id", ("body",)).save(f"{tmp_path}/ix", 3)
    for query in ("common OR rare", "common OR x OR rare OR rare", "none OR common", "none OR never", "common"):
        want = ix.score(query).orderBy("rank", "rowid").limit(7).collect()
        got = ix.top(query, 7).collect()
        assert [x.rowid for x in got] == [x.rowid for x in want] and all(abs(a.rank - b.rank) < 1e-12 for a, b in zip(got, want)), query
    assert ix.document_frequency("rare") == FtsIndex.build(spark.createDataFrame(rows, "id long, body string"), "id", ("body",)).document_frequency("rare")
