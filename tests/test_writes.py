"""Write operators and sources against Python's sqlite3."""

import sqlite3

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessera.operators import dml as D
from tessera.operators import relops as R
from tessera.sources import sqlite as S
from tessera.sources.kv import KeyValues

T = D.TableDef("kv", [D.ColumnDef("id", "INTEGER"), D.ColumnDef("k", "TEXT", nocase=True), D.ColumnDef("hits", "INTEGER", default=0), D.ColumnDef("w", "REAL")], "id", [("k",)])
ROWS = [(1, "a", 5, 0.5), (2, "B", None, None), (3, None, 7, 1.0), (4, None, 8, 2.0)]


def start(spark):
    con = sqlite3.connect(":memory:")
    con.execute("create table kv(id integer primary key, k text unique collate nocase, hits integer default 0, w real)")
    con.executemany("insert into kv values (?,?,?,?)", ROWS)
    return spark.createDataFrame(ROWS, T.schema), con


def rows(df):
    return sorted(map(tuple, df.select("id", "k", "hits", "w").collect()), key=repr)


def mirror(con):
    return sorted(con.execute("select id, k, hits, w from kv").fetchall(), key=repr)


BATCH = [(1, None, "A"), (2, 9, "c"), (3, None, None), (4, 10, "C"), (5, 3, "z"), (6, None, "q")]


@pytest.mark.parametrize("how", ["ignore", "replace"])
def test_conflict_policies(spark, how):
    df, con = start(spark)
    batch = spark.createDataFrame([r for r in BATCH if r[1] is not None or r[0] in (3, 6)], "o int, id long, k string")
    got = D.insert(df, batch, T, "o", how).table
    for o, i, k in sorted(r for r in BATCH if r[1] is not None):
        con.execute(f"insert or {how} into kv(id, k) values (?,?)", (i, k))
    top = con.execute("select max(id) from kv").fetchone()[0]
    del top
    want = mirror(con)
    auto = [r for r in rows(got) if r[1] in (None, "q") and r[0] > 4 and r[0] not in (9, 10)]
    assert len(auto) == 2 and [r for r in rows(got) if r not in auto] == want


def test_abort_and_checks(spark):
    df, _ = start(spark)
    with pytest.raises(D.ConstraintError, match="UNIQUE"):
        D.insert(df, spark.createDataFrame([(1, 7, "b")], "o int, id long, k string"), T, "o")
    with pytest.raises(D.ConstraintError, match="hits"):
        D.insert(df, spark.createDataFrame([(1, 7, "x")], "o int, id long, hits string"), T, "o")
    out = D.insert(df, spark.createDataFrame([(2, "n", 1.0), (1, "m", float("nan"))], "o int, k string, w double"), T, "o")
    assert [r for r in rows(out.table) if r[0] > 4][0][:3] == (5, "m", 0) and out.changes() == 2


def test_upsert_update(spark):
    df, con = start(spark)
    new = spark.createDataFrame([(20, "b", 4), (21, "d", 6)], "id long, k string, hits long")
    got = D.upsert(df, new, T, "k", {"hits": lambda old, new: F.coalesce(old["hits"], F.lit(0)) + new["hits"]}).table
    con.executemany("insert into kv(id, k, hits) values (?,?,?) on conflict(k) do update set hits = coalesce(hits, 0) + excluded.hits", [(20, "b", 4), (21, "d", 6)])
    assert rows(got) == mirror(con)
    got = D.update(got, T, {"w": F.col("hits") * 1.0, "hits": F.col("hits") + 1}, F.col("hits") > 5).table
    con.execute("update kv set w = hits * 1.0, hits = hits + 1 where hits > 5")
    assert rows(got) == mirror(con)
    with pytest.raises(D.ConstraintError):
        D.upsert(df, new.union(new), T, "k", {})
    twice = [(1, 30, "b", 4), (2, 31, "e", 6), (3, 32, "E", 1), (4, 33, "B", 9), (5, 34, "e", 5)]
    fold = {"hits": lambda old, new: F.coalesce(old["hits"], F.lit(0)) * 2 + new["hits"]}
    got = D.upsert(got, spark.createDataFrame(twice, "o int, id long, k string, hits long"), T, "k", fold, "o")
    con.executemany("insert into kv(id, k, hits) values (?,?,?) on conflict(k) do update set hits = coalesce(hits, 0) * 2 + excluded.hits", [r[1:] for r in twice])
    assert rows(got.table) == mirror(con) and [(e, n.count()) for e, n, _ in got.events] == [("insert", 1), ("update", 1)]


TWO = D.TableDef("two", [D.ColumnDef("id", "INTEGER"), D.ColumnDef("a", "TEXT", nocase=True), D.ColumnDef("b", "INTEGER")], "id", [("a",), ("b",)])


@pytest.mark.parametrize("how", ["ignore", "replace"])
@pytest.mark.parametrize("seed", [1, 2])
def test_several_unique_keys_row_by_row(spark, how, seed):
    """Batches whose rows collide with old rows and with each other on either key, against sqlite3."""
    import random

    r = random.Random(seed)
    con = sqlite3.connect(":memory:")
    con.execute("create table two(id integer primary key, a text unique collate nocase, b integer unique)")
    old = [(i, f"k{i}", i * 10) for i in range(6)]
    con.executemany("insert into two values (?,?,?)", old)
    batch = [(i, r.randint(3, 20), r.choice([None, f"{r.choice('kK')}{r.randint(0, 9)}"]), r.choice([None, r.randint(0, 9) * 10])) for i in range(30)]
    con.executemany(f"insert or {how} into two values (?,?,?)", [x[1:] for x in batch])
    got = D.insert(spark.createDataFrame(old, TWO.schema), spark.createDataFrame(batch, "o int, id long, a string, b long").repartition(3), TWO, "o", how)
    assert sorted(map(tuple, got.table.collect()), key=repr) == sorted(con.execute("select * from two").fetchall(), key=repr)


def test_rowids_and_defaults_of_many_rows(spark):
    from datetime import datetime

    t = D.TableDef("t", [D.ColumnDef("id", "INTEGER"), D.ColumnDef("n", "INTEGER"), D.ColumnDef("at", "TEXT", default=D.NOW)], "id")
    old = spark.createDataFrame([(7, 1, "x")], t.schema)
    new = spark.range(1000).select((F.lit(1000) - F.col("id")).alias("o"), F.col("id").alias("n")).repartition(5)
    got = D.insert(old, new, t, "o", clock=datetime(2024, 1, 2, 3, 4, 5))
    assert sorted((r.id, r.n) for r in got.inserted.collect()) == [(8 + k, 999 - k) for k in range(1000)]
    assert got.last_insert_rowid() == 1007 and {r["at"] for r in got.inserted.select("at").collect()} == {"2024-01-02 03:04:05"}


def test_cascade_and_restrict(spark):
    parent = D.TableDef("p", [D.ColumnDef("id", "INTEGER")], "id")
    child = D.TableDef("c", [D.ColumnDef("id", "INTEGER"), D.ColumnDef("p", "INTEGER"), D.ColumnDef("up", "INTEGER")], "id", [], [D.ForeignKey("p", "p", "cascade"), D.ForeignKey("up", "c", "cascade")])
    tables = {"p": spark.createDataFrame([(1,), (2,)], "id long"), "c": spark.createDataFrame([(1, 1, None), (2, None, 1), (3, 2, None), (4, None, 2), (5, None, None)], "id long, p long, up long")}
    out = D.delete(tables, {"p": parent, "c": child}, "p", F.col("id") == 1)
    assert sorted(r.id for r in out["c"].table.collect()) == [3, 5] and sorted(r.id for r in out["c"].deleted.collect()) == [1, 2, 4]
    child.foreign[0] = D.ForeignKey("p", "p", "restrict")
    with pytest.raises(D.ConstraintError, match="FOREIGN"):
        D.delete(tables, {"p": parent, "c": child}, "p", F.col("id") == 1)
    assert D.orphans(tables["c"], child.foreign[0], tables["p"].where("id = 2"), "id").count() == 1


def test_rowids_limits_compounds(spark):
    df = spark.range(100).repartition(7)
    assert sorted(r.rowid for r in R.rowids(df, 40).collect()) == list(range(41, 141))
    o = df.orderBy("id")
    assert R.slice_rows(o, -1, -5).count() == 100 and [r.id for r in R.slice_rows(o, 2, 3).collect()] == [3, 4]
    one = spark.range(2)
    assert R.compound(one, ("union all", one), ("union", one), ("union all", one)).count() == 4
    with pytest.raises(ValueError):
        R.compound(one, ("union", spark.createDataFrame([(1, 2)], "a int, b int")))
    assert [r.id for r in zip(R.stream(o), range(3)) for r in [r[0]]] == [0, 1, 2]


def test_sqlite_import(spark, tmp_path):
    path = f"{tmp_path}/x.db"
    con = sqlite3.connect(path)
    con.execute("create table t(id integer primary key, name varchar(20) not null, score real, n int, b blob)")
    con.executemany("insert into t values (?,?,?,?,?)", [(1, "a", "1.5", "7", b"x"), (5, "b", None, 2, None), (250_001, "c", 3, 4.0, "txt")])
    con.execute("create unique index u on t(name)")
    con.execute("create table empty(a text)")
    con.commit()
    con.close()
    assert S.table_names(path) == ["empty", "t"] and S.table_def(path, "t").unique == [("name",)]
    got = sorted(map(tuple, S.read(spark, path, "t").collect()))
    assert got == [(1, "a", 1.5, 7, bytearray(b"x")), (5, "b", None, 2, None), (250_001, "c", 3.0, 4, bytearray(b"txt"))]
    S.import_tables(spark, path, f"{tmp_path}/out", computed={"t": {"name_lc": F.lower("name")}})
    assert spark.read.parquet(f"{tmp_path}/out/t").count() == 3 and spark.read.parquet(f"{tmp_path}/out/empty").count() == 0


def test_import_of_a_whole_file(spark, tmp_path):
    from tessera.sources.database import Database

    path = f"{tmp_path}/y.db"
    con = sqlite3.connect(path)
    con.executescript("""create table authors(id integer primary key, name text not null);
      create table papers(id integer primary key, author int references authors(id) on delete cascade, title text, year text);
      create unique index by_title on papers(title); create index by_year on papers(year, id);
      create virtual table search using fts5(title, content='papers', content_rowid='id', tokenize='porter unicode61');
      create virtual table notes using fts5(head, body); create virtual table bare using fts5(x, content='');""")
    con.executemany("insert into authors values (?,?)", [(1, "A"), (2, "B")])
    con.executemany("insert into papers values (?,?,?,?)", [(i, i % 3 or None, f"Running tests {i}", "1999") for i in range(9)])
    con.execute("insert into notes values ('one', 'two words'), ('three', NULL)")
    con.commit()
    con.close()
    db = Database(spark, f"{tmp_path}/db")
    lookups = {"papers": [("author_name", "authors", "author", "id", "name", F.lit("unknown"))]}
    left = S.import_database(db, path, S.Manifest(lookups=lookups, added={"papers": [D.ColumnDef("author_name", "TEXT")]}))
    assert left == ["bare"] and S.table_names(path) == ["authors", "papers"]
    assert sorted({r.author_name for r in db.table("papers").collect()}) == ["A", "B", "unknown"] and db.seek("by_year", "1999", low=3).count() == 6
    assert db.fts("search").match("run").count() == 9 and [r.rowid for r in db.fts("notes").match("body : words").collect()] == [1]
    with pytest.raises(ValueError, match="exist"):
        S.import_database(db, path)
    with db.transaction() as tx:
        tx.delete("authors", F.col("id") == 1)
    assert {r.author for r in db.table("papers").collect()} == {2, None}
    with pytest.raises(D.ConstraintError, match="UNIQUE"), db.transaction() as tx:
        tx.insert("papers", spark.createDataFrame([(1, "Running tests 2")], "o int, title string"), "o")


def test_lookup_takes_the_first_match(spark):
    other = spark.createDataFrame([(3, 1, "z"), (1, 1, "m"), (2, 1, "a")], "id long, k long, v string")
    got = S.denormalize(spark.createDataFrame([(1,), (2,)], "k1 long"), {}, [("v1", other, "k1", "k", "v", F.lit("none"), "id")])
    assert sorted(map(tuple, got.collect())) == [(1, "m"), (2, "none")]


def test_key_values(spark):
    kv = KeyValues(spark.createDataFrame([(b"b", b"1"), (b"a\xff", b"2"), (b"c", b"3")], "key binary, value binary"))
    assert kv.get(b"b") == b"1" and not kv.contains(b"z")
    kv = kv.put(spark.createDataFrame([(b"b", b"9")], "key binary, value binary")).delete(spark.createDataFrame([(b"c",)], "key binary"))
    assert [(bytes(r.key), bytes(r.value)) for r in kv.scan(b"a", b"z").collect()] == [(b"a\xff", b"2"), (b"b", b"9")]


def test_entry_registers_matching_names():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 60
