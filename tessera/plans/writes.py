"""Registered write queries: each returns the resulting table (or RETURNING set), with its DuckDB equivalent."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import dml as D
from ..session import table

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


CUSTOMER = D.TableDef("customer", [D.ColumnDef("c_custkey", "INTEGER"), D.ColumnDef("c_name", "TEXT", not_null=True, nocase=True), D.ColumnDef("c_acctbal", "REAL", default=0.0)], "c_custkey", [("c_name",)])
NATION = D.TableDef("nation", [D.ColumnDef("n_nationkey", "INTEGER"), D.ColumnDef("n_name", "TEXT"), D.ColumnDef("n_regionkey", "INTEGER")], "n_nationkey", [], [D.ForeignKey("n_regionkey", "region", "cascade")])
REGION = D.TableDef("region", [D.ColumnDef("r_regionkey", "INTEGER"), D.ColumnDef("r_name", "TEXT")], "r_regionkey")
CLIENT = D.TableDef("customer", [D.ColumnDef("c_custkey", "INTEGER"), D.ColumnDef("c_nationkey", "INTEGER")], "c_custkey", [], [D.ForeignKey("c_nationkey", "nation", "cascade")])


def _customer(spark, sf_dir):
    return D.conform(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), CUSTOMER)


def _batch(spark, sf_dir):
    """Renamed customers: odd ones collide with old names in capitals, even ones are new."""
    c = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0")
    return c.select(F.col("c_custkey").alias("o"), (F.col("c_custkey") + 1_000_000).alias("c_custkey"), F.when(F.col("c_custkey") % 2 == 1, F.upper("c_name")).otherwise(F.concat(F.lit("new "), "c_name")).alias("c_name"))


_BATCH = "(select c_custkey + 1000000 as c_custkey, case when c_custkey % 2 = 1 then upper(c_name) else 'new ' || c_name end as c_name, 0.0::double as c_acctbal, c_custkey % 2 = 1 as clash, c_custkey as o from customer where c_custkey % 3 = 0)"


@query(f"select c_custkey, c_name, c_acctbal from customer union all select c_custkey, c_name, c_acctbal from {_BATCH} b where not clash")
def insert_or_ignore(spark, sf_dir):
    return D.insert(_customer(spark, sf_dir), _batch(spark, sf_dir), CUSTOMER, "o", "ignore").table


@query(f"select c_custkey, c_name, c_acctbal from customer where not (c_custkey % 3 = 0 and c_custkey % 2 = 1) union all select c_custkey, c_name, c_acctbal from {_BATCH} b")
def insert_or_replace(spark, sf_dir):
    return D.insert(_customer(spark, sf_dir), _batch(spark, sf_dir), CUSTOMER, "o", "replace").table


@query("select c_custkey, c_name, c_acctbal from customer union all select (select max(c_custkey) from customer) + row_number() over (order by s_suppkey), s_name, s_acctbal from supplier where s_acctbal > 0")
def insert_select(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("o"), F.col("s_name").alias("c_name"), F.col("s_acctbal").alias("c_acctbal"))
    return D.insert(_customer(spark, sf_dir), s.withColumn("c_custkey", F.lit(None).cast("bigint")), CUSTOMER, "o").table


@query(f"select c.c_custkey, c.c_name, case when b.o is null then c.c_acctbal else c.c_acctbal + 5 end as c_acctbal from customer c left join {_BATCH} b on b.clash and b.o = c.c_custkey union all select c_custkey, c_name, c_acctbal from {_BATCH} b where not clash")
def upsert(spark, sf_dir):
    rows = _batch(spark, sf_dir).drop("o")
    return D.upsert(_customer(spark, sf_dir), rows, CUSTOMER, "c_name", {"c_acctbal": lambda old, new: old["c_acctbal"] + new["c_acctbal"] + 5}).table


@query("select c_custkey, case when c_acctbal < 0 then c_name || '!' else c_name end as c_name, case when c_acctbal < 0 then -c_acctbal else c_acctbal end as c_acctbal from customer")
def update_where(spark, sf_dir):
    return D.update(_customer(spark, sf_dir), CUSTOMER, {"c_name": F.concat("c_name", F.lit("!")), "c_acctbal": -F.col("c_acctbal")}, F.col("c_acctbal") < 0).table


@query("select c_custkey, c_acctbal from customer where c_acctbal < -500")
def delete_returning(spark, sf_dir):
    out = D.delete({"customer": _customer(spark, sf_dir)}, {"customer": CUSTOMER}, "customer", F.col("c_acctbal") < -500)
    return out["customer"].deleted.select("c_custkey", "c_acctbal")


@query("select c_custkey, c_nationkey::bigint as c_nationkey from customer join nation on c_nationkey = n_nationkey where n_regionkey <> 1")
def delete_cascade(spark, sf_dir):
    defs = {"region": REGION, "nation": NATION, "customer": CLIENT}
    tables = {n: D.conform(table(spark, sf_dir, n).select(*[c.name for c in t.columns]), t) for n, t in defs.items()}
    return D.delete(tables, defs, "region", F.col("r_regionkey") == 1)["customer"].table


@query("select o_orderkey, coalesce(c_name, 'order of ' || o_custkey) as customer, lower(o_orderpriority) as priority_lc from orders left join customer on c_custkey = o_custkey and c_acctbal > 0")
def denorm_lookup(spark, sf_dir):
    from ..sources.sqlite import denormalize

    c = table(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey", "c_name")
    o = denormalize(table(spark, sf_dir, "orders"), {"priority_lc": F.lower("o_orderpriority")}, [("customer", c, "o_custkey", "c_custkey", "c_name", F.concat(F.lit("order of "), F.col("o_custkey").cast("string")))])
    return o.select("o_orderkey", "customer", "priority_lc")


@query("select s_name as key, s_nationkey::varchar as value from supplier where s_name >= 'Supplier#00000001' and s_name < 'Supplier#9' order by s_name")
def kv_scan(spark, sf_dir):
    from ..sources.kv import KeyValues

    s = table(spark, sf_dir, "supplier")
    kv = KeyValues(s.select(F.col("s_name").cast("binary").alias("key"), F.col("s_nationkey").cast("string").cast("binary").alias("value")))
    return kv.scan(b"Supplier#00000001", b"Supplier#9").select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


@query("select c_custkey, c_name, case when c_custkey % 3 = 0 then ((c_acctbal * 2 + 1) * 2 + 2) else c_acctbal end as c_acctbal from customer")
def upsert_twice(spark, sf_dir):
    """Every third customer is named twice in the batch; the second row sees what the first one did."""
    c = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0")
    batch = c.select(F.explode(F.array(F.lit(2.0), F.lit(1.0))).alias("c_acctbal"), (F.col("c_custkey") + 5_000_000).alias("c_custkey"), F.upper("c_name").alias("c_name"))
    batch = batch.withColumn("o", F.col("c_acctbal"))
    return D.upsert(_customer(spark, sf_dir), batch, CUSTOMER, "c_name", {"c_acctbal": lambda old, new: old["c_acctbal"] * 2 + new["c_acctbal"]}, "o").table


@query("select c_custkey, c_name, c_acctbal from customer where c_custkey % 5 <> 0 union all select 9000000 + c_custkey, upper(c_name), 0.0::double from customer where c_custkey % 5 = 0 union all select c_custkey, 'fresh ' || c_custkey, 0.0::double from customer where c_custkey % 5 = 0")
def replace_two_keys(spark, sf_dir):
    """New rows that meet one old row by its rowid and by its name."""
    c = table(spark, sf_dir, "customer").where("c_custkey % 5 = 0")
    both = c.select(F.explode(F.array((F.col("c_custkey") * 2).cast("long"), (F.col("c_custkey") * 2 + 1).cast("long"))).alias("o"), F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    even = F.col("o") % 2 == 0
    batch = both.select("o", F.when(even, F.col("k")).otherwise(F.col("k") + 9_000_000).alias("c_custkey"), F.when(even, F.concat(F.lit("fresh "), "k")).otherwise(F.upper("name")).alias("c_name"))
    return D.insert(_customer(spark, sf_dir), batch, CUSTOMER, "o", "replace").table


def _database(spark, tables: dict):
    """A fresh database with the tables ``name: (definition, frame)``."""
    from ..session import shared_dir
    from ..sources.database import Database

    db = Database(spark, f"{shared_dir(spark)}/db-{uuid.uuid4().hex}")
    with db.transaction() as tx:
        for name, (t, rows) in tables.items():
            tx.create_table(t)
            tx.insert(name, rows.withColumn("order_of_rows", F.col(t.rowid)), "order_of_rows")
    return db


@query("select c_nationkey::bigint as c_nationkey, c_custkey from customer where c_nationkey = 3 and c_custkey >= 100 and c_custkey < 900")
def index_seek(spark, sf_dir):
    """A table with a unique index of two columns, read by an equal first column and a range of the second."""
    from ..sources.database import IndexDef

    rows = D.conform(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), CLIENT)
    db = _database(spark, {"customer": (D.TableDef("customer", CLIENT.columns, "c_custkey"), rows)})
    with db.transaction() as tx:
        tx.create_index(IndexDef("by_nation", "customer", ("c_nationkey", "c_custkey"), unique=True))
    return db.seek("by_nation", 3, low=100, high=900)


@query("select 0 as n where false union all select count(*) from customer where c_name is null")
def unique_index(spark, sf_dir):
    """Rows that a unique index lets in a second time: none."""
    from ..sources.database import IndexDef

    rows = _customer(spark, sf_dir)
    free = D.TableDef("customer", CUSTOMER.columns, "c_custkey")
    db = _database(spark, {"customer": (free, rows)})
    with db.transaction() as tx:
        tx.create_index(IndexDef("one_name", "customer", ("c_name",), unique=True))
    let_in = 0
    try:
        with db.transaction() as tx:
            again = rows.select((F.col("c_custkey") + 7_000_000).alias("c_custkey"), F.upper("c_name").alias("c_name"), F.col("c_custkey").alias("o"))
            let_in = tx.insert("customer", again, "o").changes()
    except D.ConstraintError:
        pass
    return spark.createDataFrame([(let_in,)], "n bigint")


@query(r"select p_partkey as rowid from part where p_partkey % 4 = 1 and regexp_matches(lower(p_name || ' renamed'), '(^|[^\p{L}\p{N}])renamed($|[^\p{L}\p{N}])') union all select 2000000 + p_partkey from part where p_partkey % 10 = 0")
def trigger_fts(spark, sf_dir):
    """A full-text table kept in step by stored triggers over inserts, updates and deletes."""
    from ..sources.database import FtsDef, Trigger

    t = D.TableDef("part", [D.ColumnDef("id", "INTEGER"), D.ColumnDef("name", "TEXT")], "id")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("id"), F.col("p_name").alias("name"))
    db = _database(spark, {"part": (t, rows)})
    add, gone = {"fts_insert": "names", "rowid": "new.id", "values": {"name": "new.name"}}, {"fts_delete": "names", "rowid": "old.id"}
    with db.transaction() as tx:
        tx.create_fts(FtsDef("names", ("name",), content="part"))
        for name, event, actions in (("ai", "insert", (add,)), ("ad", "delete", (gone,)), ("au", "update", (gone, add))):
            tx.create_trigger(Trigger(name, "part", event, actions=actions))
    with db.transaction() as tx:
        tx.delete("part", F.col("id") % 4 == 0)
        tx.update("part", {"name": F.concat("name", F.lit(" renamed"))}, F.col("id") % 4 == 1)
        tx.insert("part", rows.where("id % 10 = 0").select(F.col("id").alias("o"), (F.col("id") + 2_000_000).alias("id"), F.lit("entirely renamed").alias("name")), "o")
    return db.fts("names").match("renamed")


@query("select count(*) as n, (select count(*) from nation) as texts, (select max(n_nationkey)::bigint from nation) as top from nation")
def registry_calls(spark, sf_dir):
    """A registered expression, Arrow function and aggregate over nations."""
    from ..functions.registry import Registry

    r = Registry()
    r.expression("as_key", lambda x: x.cast("bigint"), 1, 1)
    r.scalar("shout", lambda s: s.str.upper() + "!", "string", 1, 1)
    r.aggregate("largest", lambda s: int(s.max()), "bigint", 1, 1)
    n = table(spark, sf_dir, "nation").select(r.call("as_key", "n_nationkey").alias("k"), r.call("shout", "n_name").alias("t"))
    a = n.agg(F.count("*").alias("n"), F.count_if(F.col("t").endswith("!")).alias("texts"))
    return a.crossJoin(n.groupBy().agg(r.call("largest", "k").alias("top")))  # one row each


@query("select upper(s_name) as key, 'new' as value from supplier where s_suppkey % 3 = 0 union all select s_name, s_nationkey::varchar from supplier where s_suppkey % 5 <> 0 order by key")
def kv_put_delete(spark, sf_dir):
    """Every fifth key deleted, every third one put again under capitals."""
    from ..sources.kv import KeyValues

    s = table(spark, sf_dir, "supplier")
    binary = lambda key, value: [key.cast("binary").alias("key"), value.cast("string").cast("binary").alias("value")]
    kv = KeyValues(s.select(*binary(F.col("s_name"), F.col("s_nationkey"))))
    kv = kv.delete(s.where("s_suppkey % 5 = 0").select(F.col("s_name").cast("binary").alias("key"))).put(s.where("s_suppkey % 3 = 0").select(*binary(F.upper("s_name"), F.lit("new"))))
    return kv.scan().select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


@query("select r_regionkey as id, upper(r_name) as name, 3::bigint as grade, length(r_name)::bigint as n from region where r_regionkey <> 2")
def migrate_recreate(spark, sf_dir):
    """Two migrations, the second one recreating the table in another shape; an old snapshot stays as it was."""
    old = D.TableDef("region", [D.ColumnDef("id", "INTEGER"), D.ColumnDef("name", "TEXT")], "id")
    new = D.TableDef("region", [*old.columns, D.ColumnDef("grade", "INTEGER", default=3), D.ColumnDef("n", "INTEGER")], "id", [("name",)])
    rows = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("name"))
    db = _database(spark, {"region": (old, rows)})
    before = db.snapshot_tables()["region"]
    db.migrate({1: lambda tx: tx.delete("region", F.col("id") == 2), 2: lambda tx: tx.recreate(new, {"name": F.upper("name"), "n": F.char_length("name").cast("long")})})
    assert before.count() == rows.count() and db.pragma("user_version") == 2
    return db.table("region")


@query("select n_nationkey::bigint as id, case when n_nationkey = 3 then 'third' else n_name end as name, n_regionkey::bigint * 2 as region from nation where n_regionkey <> 4 union all select 100, 'extra', null union all select 101, 'more', 7")
def builder_writes(spark, sf_dir):
    """Insert, upsert, update and delete through the builders, in one transaction."""
    from .builder import Delete, Insert, Update

    t = D.TableDef("nation", [D.ColumnDef("id", "INTEGER"), D.ColumnDef("name", "TEXT"), D.ColumnDef("region", "INTEGER")], "id")
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("long").alias("region"))
    db = _database(spark, {"nation": (t, rows)})
    with db.transaction() as tx:
        Delete("nation").where(F.col("region") == 4).run(tx)
        Update("nation").set(region=F.col("region") * 2).run(tx)
        Insert("nation").values({"id": 100, "name": "extra"}, {"id": 101, "name": "more", "region": 7}).run(tx)
        Insert("nation").values({"id": 3, "name": "third"}).on_conflict("id", name=lambda old, new: new["name"]).run(tx)
    return db.table("nation")


@query("select o_orderkey as id, o_custkey::bigint as customer from orders where o_custkey <= 50 union all select 70000000 + c_custkey, c_custkey::bigint from customer where c_custkey <= 50 and c_custkey % 2 = 0")
def trigger_insert(spark, sf_dir):
    """A stored trigger with a condition writes a row for each new customer that passes it."""
    from ..sources.database import Trigger

    orders = D.TableDef("orders", [D.ColumnDef("id", "INTEGER"), D.ColumnDef("customer", "INTEGER")], "id")
    people = D.TableDef("people", [D.ColumnDef("id", "INTEGER"), D.ColumnDef("name", "TEXT")], "id")
    rows = table(spark, sf_dir, "orders").where("o_custkey <= 50").select(F.col("o_orderkey").cast("long").alias("id"), F.col("o_custkey").cast("long").alias("customer"))
    db = _database(spark, {"orders": (orders, rows)})
    with db.transaction() as tx:
        tx.create_table(people)
        tx.create_trigger(Trigger("welcome", "people", "insert", when="new.id % 2 = 0", actions=({"insert": "orders", "values": {"id": "70000000 + new.id", "customer": "new.id"}},)))
    with db.transaction() as tx:
        c = table(spark, sf_dir, "customer").where("c_custkey <= 50")
        tx.insert("people", c.select(F.col("c_custkey").alias("o"), F.col("c_custkey").cast("long").alias("id"), F.col("c_name").alias("name")), "o")
    return db.table("orders")
