from dataclasses import dataclass

import pytest
from pyspark.sql import functions as F

from tessera.operators import dml as D
from tessera.functions.registry import ArityError, Registry
from tessera.plans.builder import Delete, Insert, Query, Update, literal, scalar
from tessera.sources.database import Database, FtsDef, IndexDef, Trigger

DOCS = D.TableDef("docs", [D.ColumnDef("id", "INTEGER"), D.ColumnDef("title", "TEXT", not_null=True), D.ColumnDef("root", "INTEGER")], "id", [("title",)], [D.ForeignKey("root", "roots", "cascade")])
ROOTS = D.TableDef("roots", [D.ColumnDef("id", "INTEGER"), D.ColumnDef("slug", "TEXT")], "id")
LOG = D.TableDef("log", [D.ColumnDef("id", "INTEGER"), D.ColumnDef("what", "TEXT")], "id")


def test_versions_triggers_migrations(spark, tmp_path):
    db = Database(spark, f"{tmp_path}/db")
    first = {1: lambda tx: [tx.create_table(t) for t in (ROOTS, DOCS, LOG)]}
    assert db.migrate(first) == [1] and db.migrate(first) == [] and db.pragma("user_version") == 1

    def note(tx, new, old):
        tx.insert("log", new.select(F.monotonically_increasing_id().alias("o"), F.concat(F.lit("new "), "title").alias("what")), "o")

    db.create_trigger(Trigger("t1", "docs", "insert", note, F.col("title") != "quiet"))
    with db.transaction() as tx:
        tx.insert("roots", spark.createDataFrame([(0, 1, "a"), (1, 2, "b")], "o int, id long, slug string"), "o")
        tx.insert("docs", spark.createDataFrame([(0, "x", 1), (1, "quiet", 2)], "o int, title string, root long"), "o")
    old = db.snapshot_tables()
    assert [r.what for r in db.table("log").collect()] == ["new x"]
    with pytest.raises(D.ConstraintError), db.transaction() as tx:
        tx.delete("docs", F.lit(True))
        tx.insert("roots", spark.createDataFrame([(0, 1, "again")], "o int, id long, slug string"), "o")
    assert db.table("docs").count() == 2
    with db.transaction() as tx, tx.suspending_triggers("docs"):
        tx.insert("docs", spark.createDataFrame([(0, "y", 1)], "o int, title string, root long"), "o")
    with db.transaction() as tx:
        tx.delete("roots", F.col("slug") == "a")
    assert [r.title for r in db.table("docs").collect()] == ["quiet"] and old["docs"].count() == 2
    assert db.sql("select count(*) n from {docs} where title = :t", {"t": "quiet"}).first().n == 1
    wider = D.TableDef("docs", [*DOCS.columns, D.ColumnDef("n", "INTEGER", default=3)], "id", DOCS.unique, DOCS.foreign)
    assert db.migrate(first | {2: lambda tx: tx.recreate(wider, {"title": F.upper("title")})}) == [2]
    assert tuple(db.table("docs").first()) == (2, "QUIET", 2, 3)
    db.snapshot(f"{tmp_path}/copy")
    assert Database(spark, f"{tmp_path}/copy").table("docs").count() == 1 and db.verify(deep=True) == []
    with pytest.raises(D.ConstraintError), db.transaction() as tx:
        tx.drop_table("roots")
    assert db.read_async(lambda t: t["log"].count()).result() == 1
    db.write_async(lambda tx: tx.update("docs", {"n": F.col("n") + 1}, F.lit(True))).result()
    assert db.table("docs").first().n == 4
    with pytest.raises(FileExistsError):
        db.snapshot(f"{tmp_path}/copy")


@dataclass
class Row:
    k: int
    n: int


def test_builder(spark):
    d = spark.range(20).withColumn("k", F.col("id") % 3)
    names = spark.createDataFrame([(0, "a"), (1, "b")], "k2 long, name string")
    q = Query(d).where(F.col("id") > 2).group_by("k").select(F.count("*").alias("n")).having(F.col("n") > 5).order_by(F.desc("k"))
    assert q.all(Row) == [Row(1, 6), Row(0, 6)]
    assert Query(d).left_join(names, d.k == names.k2).select("id", "name").order_by("id").limit(2).offset(1).all() == [(1, "b"), (2, None)]
    assert Query(d).join(names, d.k == names.k2, "broadcast").select("name").distinct().frame().count() == 2
    with pytest.raises(Exception, match="nope"):
        Query(d).select("nope").validate()
    assert "Physical Plan" in q.explain()


NOTES = D.TableDef("notes", [D.ColumnDef("id", "INTEGER"), D.ColumnDef("body", "TEXT"), D.ColumnDef("tag", "TEXT"), D.ColumnDef("made", "TEXT", default=D.NOW)], "id")
AUDIT = D.TableDef("audit", [D.ColumnDef("id", "INTEGER"), D.ColumnDef("was", "TEXT"), D.ColumnDef("now", "TEXT")], "id")


def test_triggers_keep_a_full_text_table_in_step(spark, tmp_path):
    from datetime import datetime

    db = Database(spark, f"{tmp_path}/db", clock=lambda: datetime(2024, 5, 6, 7, 8, 9))
    found = lambda q: sorted(r.rowid for r in db.fts("search").match(q).collect())
    with db.transaction() as tx:
        tx.create_table(NOTES)
        tx.create_table(AUDIT)
        Insert("notes").values({"body": "first words", "tag": "a"}, {"body": "second words"}).run(tx)
        tx.create_fts(FtsDef("search", ("body",), content="notes"))
        add, gone = {"fts_insert": "search", "rowid": "new.id", "values": {"body": "new.body"}}, {"fts_delete": "search", "rowid": "old.id"}
        tx.create_trigger(Trigger("ai", "notes", "insert", actions=(add,)))
        tx.create_trigger(Trigger("ad", "notes", "delete", actions=(gone,)))
        tx.create_trigger(Trigger("au", "notes", "update", when="new.body <> old.body", actions=(gone, add, {"insert": "audit", "values": {"was": "old.body", "now": "upper(new.body)"}})))
    assert found("words") == [1, 2] and db.verify(deep=True) == []
    db = Database(spark, f"{tmp_path}/db")  # triggers survive reopening
    with db.transaction() as tx:
        Insert("notes").values({"id": 9, "body": "third words"}).run(tx)
        Update("notes").set(body="changed text").where(F.col("id") == 1).run(tx)
        Update("notes").set(tag="z").run(tx)
    assert found("words") == [2, 9] and found("changed") == [1] and [tuple(r)[1:] for r in db.table("audit").collect()] == [("first words", "CHANGED TEXT")]
    with db.transaction() as tx:
        Delete("notes").where(F.col("id") == 2).run(tx)
        assert Insert("notes").values({"id": 9, "body": "other"}).or_replace().run(tx).last_insert_rowid() == 9
    assert found("words") == [] and found("other") == [9] and db.verify(deep=True) == []
    assert {r.made for r in db.table("notes").where("id = 1").collect()} == {"2024-05-06 07:08:09"}
    with pytest.raises(ValueError, match="full-text"), db.transaction() as tx:
        tx.update("search", {}, F.lit(True))
    with pytest.raises(D.ConstraintError), db.transaction() as tx:
        tx.drop_table("notes")
    with db.transaction() as tx:
        tx.drop_trigger("au")
        tx.fts_delete_all("search")
    assert found("other") == []
    with db.transaction() as tx:
        tx.fts_rebuild("search")
    db.snapshot(f"{tmp_path}/copy")
    copy = Database(spark, f"{tmp_path}/copy")
    assert sorted(r.rowid for r in copy.fts("search").match("other").collect()) == [9] and copy.verify(deep=True) == []


def test_kept_triggers_update_and_delete(spark, tmp_path):
    db = Database(spark, f"{tmp_path}/db")
    with db.transaction() as tx:
        tx.create_table(NOTES)
        tx.create_table(AUDIT)
        tx.create_trigger(Trigger("count", "notes", "insert", when="new.tag = 'n'", actions=({"update": "audit", "set": {"now": "new.body"}, "key": ["id", "new.id"]},)))
        tx.create_trigger(Trigger("clean", "notes", "delete", actions=({"delete": "audit", "key": ["id", "old.id"]},)))
        Insert("audit").values({"id": 1, "was": "x"}, {"id": 2, "was": "y"}).run(tx)
        Insert("notes").values({"id": 1, "body": "b", "tag": "n"}, {"id": 2, "body": "c"}).run(tx)
    assert sorted(map(tuple, db.table("audit").collect())) == [(1, "x", "b"), (2, "y", None)]
    with db.transaction() as tx:
        Delete("notes").where(F.col("id") == 2).run(tx)
    assert [r.id for r in db.table("audit").collect()] == [1]


def test_indexes(spark, tmp_path):
    db = Database(spark, f"{tmp_path}/db")
    with db.transaction() as tx:
        tx.create_table(NOTES)
        Insert("notes").values(*[{"id": i, "body": f"b{i}", "tag": f"t{i % 3}"} for i in range(30)]).run(tx)
        tx.create_index(IndexDef("by_tag", "notes", ("tag", "id"), include=("body",)))
        tx.create_index(IndexDef("one_body", "notes", ("body",), unique=True))
    assert sorted(r.body for r in db.seek("by_tag", "t1", low=4, high=11).collect()) == ["b10", "b4", "b7"] and db.verify(deep=True) == []
    assert "PushedFilters: [IsNotNull(tag), EqualTo(tag,t1)" in db.seek("by_tag", "t1")._jdf.queryExecution().toString()
    with pytest.raises(D.ConstraintError, match="UNIQUE"), db.transaction() as tx:
        Insert("notes").values({"body": "b3"}).run(tx)
    with pytest.raises(D.ConstraintError, match="UNIQUE"), db.transaction() as tx:
        tx.create_index(IndexDef("one_tag", "notes", ("tag",), unique=True))
    with db.transaction() as tx:
        tx.drop_index("one_body")
        Insert("notes").values({"body": "b3", "tag": "t9"}).run(tx)
    assert [r.body for r in db.seek("by_tag", "t9").collect()] == ["b3"]
    with pytest.raises(ValueError), db.transaction() as tx:
        tx.create_index(IndexDef("odd", "notes", ("nope",)))
    tx_names = []
    db.on_slow_query(0.0, lambda text, took: tx_names.append(text))
    assert db.rows("select count(*) n from {notes}")[0].n == 31 and db.prepare("select count(*) n from {notes}") is db.prepare("select count(*) n from {notes}") and tx_names
    reading = db.read_async(lambda t: t["notes"].count())
    assert reading.result() == 31
    slow = db.read_async(lambda t: spark.range(10**12).selectExpr("sum(hash(id))").collect())
    import time

    time.sleep(2)
    slow.cancel()
    with pytest.raises(Exception):
        slow.result(60)


def test_registries(spark):
    r = Registry()
    r.expression("twice", lambda x: x * 2, 1, 1)
    r.scalar("shout", lambda s: s.str.upper() + "!", "string", 1, 1)
    r.aggregate("spread", lambda s: float(s.max() - s.min()), "double", 1, 1)
    d = spark.range(10).withColumn("t", F.lit("x"))
    assert d.select(r.call("TWICE", "id"), r.call("shout", F.col("t"))).collect()[3][:] == (6, "X!")
    assert Query(d).group_by(F.col("id") % 2).select(r.call("spread", "id").alias("s")).all()[0].s == 8.0 and r.is_aggregate("spread")
    r.install(spark)
    assert spark.sql("select spread(id) s from {d}", d=d).first()[0] == 9.0 and spark.sql("select shout(t) t from {d}", d=d).first()[0] == "X!"
    with pytest.raises(ArityError):
        r.call("twice")
    with pytest.raises(ValueError):
        r.call("none")
    with pytest.raises(ValueError):
        r.expression("Twice", lambda x: x)


def test_literals_and_scalars(spark):
    d = spark.range(5)
    assert d.select(literal(True), literal(None), literal(b"x")).first()[:2] == (1, None)
    for bad in (2**63, [1], object()):
        with pytest.raises((TypeError, ValueError)):
            literal(bad)
    assert Query(d).where(F.col("id") == scalar(Query(d).select(F.max("id")))).all()[0].id == 4
    with pytest.raises(ValueError):
        scalar(Query(d), 17)
