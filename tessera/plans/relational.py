"""Registered relational queries, one an operator of the inventory, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expr as E
from ..functions import json1 as J
from ..operators import relops as R
from ..session import table

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str):
    """Registers a query under its function's name, with its oracle."""

    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


def same(name: str, sql: str, oracle: str | None = None) -> None:
    """Registers a query that needs no adjustment: SQL text over the tables it names in braces."""

    def run(spark, sf_dir):
        names = [t for t in TABLES if "{" + t + "}" in sql]
        return spark.sql(sql.format(**{t: "{" + t + "}" for t in names}), **{t: table(spark, sf_dir, t) for t in names})

    run.__name__ = name
    QUERIES[name] = run
    ORACLE[name] = (oracle or sql).format(**{t: t for t in TABLES})


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "conversations", "labels", "pages", "benchmark")
_ALOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# scans, filters and projections that Spark SQL already computes like the dialect
same("scan_filter", "select l_orderkey, l_linenumber, l_quantity from {lineitem} where l_quantity > 45 and l_returnflag = 'R'")
same("rowid_in", "select o_orderkey, o_orderstatus from {orders} where o_orderkey in (1, 7, 32, 100, 999, 5000)")
same("range_scan", "select l_orderkey, l_extendedprice from {lineitem} where l_quantity >= 10 and l_quantity < 12 and l_discount between 0.05 and 0.07")
same("multi_probe_in", "select p_partkey, p_brand, p_size from {part} where p_size in (1, 5, 49, 49) and p_brand in (select p_brand from {part} where p_partkey <= 5)")
same("covering_scan", "select o_custkey from {orders} where o_totalprice > 200000")
same("star_expansion", "select n.*, r.* from {nation} n join {region} r on n.n_regionkey = r.r_regionkey")
same("three_valued", "select o_orderkey, cast(nullif(o_orderstatus, 'F') = 'O' as int) as eq, cast(nullif(o_orderstatus, 'F') <> 'O' or o_custkey < 500 as int) as ne_or, cast(not (nullif(o_orderstatus, 'F') = 'O') and o_custkey > 500 as int) as not_and from {orders}")
same("is_null", "select o_orderkey, nullif(o_orderpriority, '1-URGENT') is null as missing from {orders} where nullif(o_orderstatus, 'P') is not null")
same("between_not", "select p_partkey, p_size from {part} where p_size not between 5 and 45")
same("in_list_nulls", "select p_partkey, cast(nullif(p_size, 5) in (1, 2, 3) as int) as a, cast(nullif(p_size, 5) not in (1, null) as int) as b from {part}")
same("case_when", "select o_orderkey, case when o_totalprice > 300000 then 'big' when o_totalprice > 100000 then 'mid' else 'small' end as bucket, case o_orderstatus when 'F' then 1 when 'O' then 2 end as code from {orders}")
same("coalesce_null", "select c_custkey, coalesce(o.o_orderkey, -1) as o_orderkey, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') as seg from {customer} c left join {orders} o on o.o_custkey = c.c_custkey and o.o_totalprice > 250000")
# joins
same("inner_join", "select o.o_orderkey, c.c_name, c.c_mktsegment from {orders} o join {customer} c on o.o_custkey = c.c_custkey where c.c_acctbal < 0")
same("left_join", "select c.c_custkey, o.o_orderkey from {customer} c left join {orders} o on o.o_custkey = c.c_custkey and o.o_orderstatus = 'P'")
same("anti_via_left", "select c.c_custkey from {customer} c left join {orders} o on o.o_custkey = c.c_custkey and o.o_totalprice > 200000 where o.o_orderkey is null")
same("theta_join", "select a.n_name as a, b.n_name as b from {nation} a join {nation} b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey")
same("self_join", "select a.n_name as a, r.r_name, count(*) as n from {nation} a join {nation} b on a.n_regionkey = b.n_regionkey join {region} r on r.r_regionkey = a.n_regionkey group by a.n_name, r.r_name")
same("three_way_join", "select c.c_mktsegment, n.n_name, count(*) as n, cast(sum(cast(o.o_totalprice as decimal(18,2))) as double) as total from {orders} o join {customer} c on o.o_custkey = c.c_custkey join {nation} n on c.c_nationkey = n.n_nationkey group by c.c_mktsegment, n.n_name")
same("null_keys_never_match", "select count(*) as n from {orders} a join {customer} c on nullif(a.o_custkey, 10) = nullif(c.c_custkey, 10)")
# aggregates
same("aggregates", "select o_orderstatus, count(*) as n, count(nullif(o_orderpriority, '5-LOW')) as n_pri, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as total, round(avg(cast(o_totalprice as decimal(18,2))), 6) as mean, min(o_custkey) as lo, max(o_custkey) as hi from {orders} group by o_orderstatus", "select o_orderstatus, count(*) as n, count(nullif(o_orderpriority, '5-LOW')) as n_pri, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as total, cast(round(sum(cast(o_totalprice as decimal(18,2))) / count(*), 6) as decimal(22,6)) as mean, min(o_custkey) as lo, max(o_custkey) as hi from {orders} group by o_orderstatus")
same("having", "select l_suppkey, count(*) as n from {lineitem} group by l_suppkey having count(*) >= 5 and min(l_quantity) < 10")
same("group_by_expression", "select nullif(p_size % 7, 3) as k, count(*) as n, cast(sum(p_size) as bigint) as total from {part} group by nullif(p_size % 7, 3)")
same("global_agg_empty", "select count(*) as n, cast(sum(o_custkey) as bigint) as total, max(o_orderpriority) as top from {orders} where o_orderkey < 0")
same("agg_over_join", "select r.r_name, count(*) as n, max(c.c_acctbal) as top from {customer} c join {nation} n on c.c_nationkey = n.n_nationkey join {region} r on n.n_regionkey = r.r_regionkey group by r.r_name")
same("agg_in_expression", "select o_orderstatus, 100 * count(*) / 7 + min(o_custkey) as a, max(o_custkey) - min(o_custkey) as spread from {orders} group by o_orderstatus having max(o_custkey) - min(o_custkey) > 0", "select o_orderstatus, 100 * count(*) / 7 + min(o_custkey) as a, max(o_custkey) - min(o_custkey) as spread from {orders} group by o_orderstatus having max(o_custkey) - min(o_custkey) > 0")
# order, limit, distinct, compounds, subqueries
same("distinct_two", "select distinct l_returnflag, l_linestatus from {lineitem}")
same("order_limit_offset", "select o_orderkey, o_custkey from {orders} order by nullif(o_orderpriority, '1-URGENT') desc nulls last, o_custkey, o_orderkey limit 20 offset 7")
same("order_alias", "select c_custkey, c_acctbal * -1 as owed from {customer} order by owed desc, c_custkey limit 15")
same("union_all", "select n_nationkey as k, n_name as name from {nation} union all select r_regionkey, r_name from {region} union all select n_nationkey, n_name from {nation}")
same("union_distinct", "select o_orderstatus as s from {orders} union select l_linestatus from {lineitem}")
same("compound_chain", "select x from (select p_size as x from {part} where p_size < 4 union select p_size from {part} where p_size < 6 union all select 1) t order by x limit 6")
same("scalar_subquery", "select o_orderkey, o_totalprice from {orders} where o_totalprice > (select max(o_totalprice) * 0.9 from {orders})")
same("correlated_subquery", "select n.n_name, (select count(*) from {customer} c where c.c_nationkey = n.n_nationkey) as customers from {nation} n")
same("facet", "select event_type, count(*) as n, cast(sum(case when value > 50 then 1 else 0 end) as bigint) as high from {events} group by event_type having count(*) >= 5")


@query("select o_custkey, arg_min(o_orderkey, o_orderkey) as o_orderkey, arg_min(o_orderpriority, o_orderkey) as o_orderpriority, max(o_totalprice) as top from orders group by o_custkey")
def bare_first_row(spark, sf_dir):
    return R.first_rows(table(spark, sf_dir, "orders"), [F.col("o_custkey")], "o_orderkey", ["o_orderkey", "o_orderpriority"], [F.max("o_totalprice").alias("top")])


@query(f"select arg_min(v, event_id) as v from (select event_id, case when event_id % 3 = 0 then upper(event_type) when event_id % 3 = 1 then event_type else upper(substr(event_type, 1, 1)) || substr(event_type, 2) end as v from events) t group by {_ALOWER.format('v')}")
def distinct_nocase(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    t = F.col("event_type")
    v = F.when(F.col("event_id") % 3 == 0, E.upper(t)).when(F.col("event_id") % 3 == 1, t).otherwise(F.concat(E.upper(E.substr(t, 1, 1)), E.substr(t, 2)))
    return R.distinct_nocase(e.select("event_id", v.alias("v")), "v", "event_id")


@query("select p_partkey, p_name from part where lower(p_type) like '%steel%' or p_name like '%a_e%'")
def like_filter(spark, sf_dir):
    return table(spark, sf_dir, "part").where(E.like(F.col("p_type"), "%STEEL%") | E.like(F.col("p_name"), "%A_E%")).select("p_partkey", "p_name")


@query(f"select p_partkey, p_brand from part where {_ALOWER.format('p_brand')} = 'brand#12'")
def nocase_eq(spark, sf_dir):
    return table(spark, sf_dir, "part").where(E.nocase(F.col("p_brand")) == "brand#12").select("p_partkey", "p_brand")


@query("select l_orderkey, l_linenumber, l_partkey // nullif(l_linenumber - 3, 0) as d, l_partkey % nullif(l_linenumber - 3, 0) as m, (l_partkey + 9007199254740993)::bigint as s, (l_partkey * -90071992547409)::bigint as p, (l_partkey - 9007199254740993)::bigint as t, (-l_orderkey)::bigint as u, l_extendedprice / nullif(l_quantity - 5, 0) as r, (trunc(l_extendedprice)::bigint % nullif(trunc(l_quantity)::bigint - 5, 0))::double as q from lineitem")
def arithmetic(spark, sf_dir):
    c = F.col
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", E.int_divide(c("l_partkey"), c("l_linenumber") - 3).alias("d"), E.int_mod(c("l_partkey"), c("l_linenumber") - 3).alias("m"),
        E.add(c("l_partkey"), F.lit(9007199254740993), "integer").alias("s"), E.multiply(c("l_partkey"), F.lit(-90071992547409), "integer").alias("p"), E.subtract(c("l_partkey"), F.lit(9007199254740993), "integer").alias("t"),
        E.negate(c("l_orderkey"), "integer").alias("u"), E.divide(c("l_extendedprice"), c("l_quantity") - 5).alias("r"), E.real_mod(c("l_extendedprice"), c("l_quantity") - 5).alias("q"),
    )


@query("select c_custkey, substr(c_name, 3, 4) as a, substr(c_name, -4) as b, substr(c_name, 0, 3) as c, instr(c_name, '0') as i, 0::bigint as e, length(c_name) as n, c_name || ':' || c_custkey as t from customer")
def text_functions(spark, sf_dir):
    n = F.col("c_name")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", E.substr(n, 3, 4).alias("a"), E.substr(n, -4).alias("b"), E.substr(n, 0, 3).alias("c"), E.instr(n, "0").alias("i"), E.instr(n, "").alias("e"),
        F.char_length(n).cast("bigint").alias("n"), E.concat(n, F.lit(":"), F.col("c_custkey")).alias("t"),
    )


@query("select p_partkey, coalesce(try_cast(nullif(regexp_extract(x, '^[0-9]+'), '') as bigint), 0) as i, coalesce(try_cast(nullif(regexp_extract(x, '^[0-9]+\\.?[0-9]*'), '') as double), 0) as r, (coalesce(try_cast(nullif(regexp_extract(x, '^[0-9]+\\.?[0-9]*'), '') as double), 0) <> 0)::int::bigint as t from (select p_partkey, case when p_partkey % 4 = 0 then 'abc' when p_partkey % 4 = 1 then '0x' else p_size || '.5' || p_brand end as x from part) p")
def cast_prefix(spark, sf_dir):
    k = F.col("p_partkey") % 4
    x = F.when(k == 0, "abc").when(k == 1, "0x").otherwise(F.concat(F.col("p_size").cast("string"), F.lit(".5"), F.col("p_brand")))
    return table(spark, sf_dir, "part").select("p_partkey", x.alias("x")).select(
        "p_partkey", E.cast_integer(F.col("x")).alias("i"), E.cast_real(F.col("x")).alias("r"), E.as_integer(E.truth(F.col("x"), "text")).alias("t")
    )


@query("select o_orderkey, c_name from orders join customer on o_custkey = c_custkey where o_totalprice > 150000")
def hash_join(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return R.join(o.where("o_totalprice > 150000"), c, o.o_custkey == c.c_custkey, strategy="hash").select("o_orderkey", "c_name")


@query("select count(*) as n from orders join customer on o_custkey = c_custkey")
def merge_join(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return R.join(o, c, o.o_custkey == c.c_custkey, strategy="merge").agg(F.count("*").alias("n"))


@query("select c_custkey, count(*) as matches from customer join orders on o_custkey = c_custkey group by c_custkey")
def counting_semi(spark, sf_dir):
    return R.counting_join(table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders"), "c_custkey", "o_custkey")


@query("select c_custkey, arg_min(o_orderpriority, o_orderkey) as first_priority from customer left join orders on o_custkey = c_custkey group by c_custkey")
def correlated_first(spark, sf_dir):
    return R.scalar_first(table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders"), "c_custkey", "o_custkey", "o_orderpriority", "o_orderkey", "first_priority")


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25")
def top_n(spark, sf_dir):
    return R.top(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice")], "o_orderkey", 25)


@query("select event_id, json_extract_string(props, '$.k') as s, cast(json_extract(props, '$.k') as bigint) as k, json_extract_string(props, '$.none') as missing, case json_type(props) when 'OBJECT' then 'object' end as kind, case when json_type(props, '$.k') in ('UBIGINT', 'BIGINT') then 'integer' end as inner_kind, 1::bigint as ok, cast(json_extract(props, '$.k') as varchar) as arrow from events")
def json_reads(spark, sf_dir):
    p = F.col("props")
    return table(spark, sf_dir, "events").select(
        "event_id", J.extract(p, "$.k").alias("s"), J.extract(p, "$.k", "bigint").alias("k"), J.extract(p, "$.none").alias("missing"), J.json_type(p).alias("kind"),
        J.json_type(p, "$.k").alias("inner_kind"), J.valid(p).alias("ok"), J.arrow_text(p, "k").alias("arrow"),
    )


def _document(i):
    """A document with containers, numbers as written, repeated keys and a boolean, that differs by row."""
    return F.concat(F.lit('{"z": {"b": 1, "a": 2.50}, "n": ['), i, F.lit(", 1.0e2, null, "), i % 7, F.lit('], "d": 1, "d": 2, "t": '), F.when(i % 2 == 0, "true").otherwise("false"), F.lit("}"))


@query("select event_id, '{\"b\":1,\"a\":2.50}' as container, (event_id % 7)::varchar as last, (event_id % 2 = 0)::int::bigint as flag, case when event_id % 2 = 0 then 'true' else 'false' end as flag_type, '1' as first_of_repeated, '[1.0e2,null,' || event_id || ']' as several, '2.50' as written, 1::bigint as ok, 0::bigint as not_ok, 4::bigint as n, null::bigint as no_n, event_id as int_n from events")
def json_documents(spark, sf_dir):
    i = F.col("event_id")
    d = _document(i)
    return table(spark, sf_dir, "events").select(
        "event_id", J.extract(d, "$.z").alias("container"), J.extract(d, "$.n[#-1]").alias("last"), J.extract(d, "$.t", "bigint").alias("flag"), J.json_type(d, "$.t").alias("flag_type"),
        J.extract(d, "$.d").alias("first_of_repeated"), J.extract_many(d, "$.n[1]", "$.q", "$.n[0]").alias("several"), J.arrow_text(d, "$.z.a").alias("written"), J.valid(d).alias("ok"),
        J.valid(F.concat(d, F.lit(","))).alias("not_ok"), J.array_length(d, "$.n").alias("n"), J.array_length(d, "$.none").alias("no_n"), J.arrow_value(J.arrow_text(d, "n"), 0, "bigint").alias("int_n"),
    )


@query("select event_id, event_type from events where event_type in (select unnest(['click', 'view', 'purchase'])) and cast(json_extract(props, '$.k') as bigint) > 50")
def in_json_each(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.where(J.in_each(F.col("event_type"), F.lit('["click","view","purchase"]')) & (J.arrow_value(F.col("props"), "k", "bigint") > 50)).select("event_id", "event_type")


@query("select event_id, case when event_id % 4 = 0 then 0 when event_id % 3 = 0 then 1 when event_id % 5 = 0 then null else 0 end::bigint as found from events")
def in_json_each_mixed(spark, sf_dir):
    """A document a row, with values of all classes: a NULL one, one that has the number, one with a null, one with the number as text."""
    i = F.col("event_id")
    doc = F.when(i % 4 == 0, F.lit(None).cast("string")).when(i % 3 == 0, F.concat(F.lit('["x",'), i, F.lit(".0,null]"))).when(i % 5 == 0, '{"a":"x","b":null}').otherwise(F.concat(F.lit('["'), i, F.lit('",[1],-1]')))
    return table(spark, sf_dir, "events").select("event_id", E.as_integer(J.in_each(i, doc, "bigint")).alias("found"))


@query("select event_id, key, kind, value from (select event_id, 'k' as key, 'integer' as kind, json_extract_string(props, '$.k') as value from events union all select event_id, 'list', 'array', '[1,\"' || event_type || '\"]' from events) t")
def json_each_rows(spark, sf_dir):
    p = F.concat(F.lit('{"k": '), J.extract(F.col("props"), "$.k"), F.lit(', "list": [1, "'), F.col("event_type"), F.lit('"]}'))
    return table(spark, sf_dir, "events").select("event_id", F.inline(J.each(p)))


@query("select user_id, '[' || string_agg(case when event_id % 5 = 0 then 'null' else event_id::varchar end, ',' order by event_id) || ']' as ids, '{' || string_agg('\"' || event_type || '\":' || event_id, ',' order by event_id) || '}' as pairs from events group by user_id")
def json_group(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    x = F.when(F.col("event_id") % 5 != 0, F.col("event_id"))
    return e.groupBy("user_id").agg(J.group_array(x, F.col("event_id")).alias("ids"), J.group_object(F.col("event_type"), F.col("event_id"), F.col("event_id")).alias("pairs"))


@query("select event_id, '[' || event_id || ',\"' || event_type || '\",null]' as a, '{\"t\":\"' || event_type || '\",\"t\":' || event_id || '}' as o, '\"' || event_type || '\"' as q, 2::bigint as n from events")
def json_build(spark, sf_dir):
    i, t = F.col("event_id"), F.col("event_type")
    return table(spark, sf_dir, "events").select(
        "event_id", J.array_of(i, t, F.lit(None).cast("string")).alias("a"), J.object_of(("t", t), ("t", i)).alias("o"), J.quote(t).alias("q"), J.array_length(F.lit("[1,2]")).alias("n")
    )


@query("select event_id, '{\"k\":9,\"z\":\"x\"}' as changed, '{}' as removed, '{\"k\":' || json_extract_string(props, '$.k') || '}' as mini from events")
def json_edits(spark, sf_dir):
    p = F.col("props")
    return table(spark, sf_dir, "events").select(
        "event_id", J.insert(J.set_(p, ("$.k", 9)), ("$.z", "x"), ("$.k", 1)).alias("changed"), J.remove(J.patch(p, '{"q":null}'), "$.k").alias("removed"), J.minify(p).alias("mini")
    )


@query("select c_mktsegment, n_name, count(*) as n_orders, cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as revenue from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey where l_quantity > 10 group by 1, 2 having count(*) > 3 order by revenue desc, c_mktsegment, n_name limit 40")
def flagship(spark, sf_dir):
    l, o, c, n = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "nation"))
    d = l.where("l_quantity > 10").join(o, l.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    d = d.groupBy("c_mktsegment", "n_name").agg(F.count("*").alias("n_orders"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("revenue")).where("n_orders > 3")
    return d.orderBy(F.desc("revenue"), "c_mktsegment", "n_name").limit(40)


_CASED = "case when event_id % 3 = 0 then upper(event_type) when event_id % 3 = 1 then event_type else upper(substr(event_type, 1, 1)) || substr(event_type, 2) end"


@query(f"select user_id, arg_min(v, (lower(v), event_id)) as lo, arg_max(v, (lower(v), -event_id)) as hi from (select user_id, event_id, {_CASED} as v from events) t group by user_id")
def nocase_min_max(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("v", F.expr(_CASED))
    return e.groupBy("user_id").agg(R.min_nocase("v", "event_id").alias("lo"), R.max_nocase("v", "event_id").alias("hi"))


@query("select v from (select upper(event_type) as v, 0 as arm, event_id from events where event_id % 2 = 0 union all select event_type, 1, event_id from events union all select 'Zoo', 2, 1) t qualify row_number() over (partition by lower(v) order by arm, event_id) = 1 order by v desc limit 4 offset 1")
def union_nocase_ordinal(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    first = e.where("event_id % 2 = 0").select(F.upper("event_type").alias("v"), "event_id")
    both = R.compound(first, ("union", e.select("event_type", "event_id")), ("union", spark.createDataFrame([("Zoo", 1)], "v string, event_id long")), nocase_columns=("v",), rowid="event_id")
    return R.order_compound(both, (1, "desc"), limit=4, offset=1)


@query("select x, n from (select p_size as x, 1 as n from part where p_size < 4 union select p_size, 1 from part where p_size < 6 union all select 1, 2) t order by 2 desc, 1 limit 5")
def compound_ordinals(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    arm = lambda most: p.where(F.col("p_size") < most).select(F.col("p_size").alias("x"), F.lit(1).alias("n"))
    return R.order_compound(R.compound(arm(4), ("union", arm(6)), ("union all", spark.sql("select 1 as x, 2 as n"))), (2, "desc"), 1, limit=5)


@query("select p_partkey, (p_size = 10)::int::bigint as int_text, (p_size = 10 or p_size = 7)::int::bigint as real_text, 1::bigint as int_word, 0::bigint as word_int, (p_size::varchar < '5')::int::bigint as text_bare, 0::bigint as beyond, 1::bigint as blob_last from part")
def affinity(spark, sf_dir):
    """Comparisons of different classes, converted or ranked by the declared types of their sides."""
    t = E.Typed
    size = t(F.col("p_size").cast("bigint"), "integer", column=True)
    as_text = t(F.col("p_size").cast("string"), "text", column=True)
    lit = lambda v, kind: t(F.lit(v), kind)
    say = E.as_integer
    return table(spark, sf_dir, "part").select(
        "p_partkey", say(E.compare(size, "=", lit(" 10 ", "text"))).alias("int_text"), say(E.compare(size, "=", lit("1e1", "text")) | E.compare(size, "=", lit("7.0", "text"))).alias("real_text"),
        say(E.compare(size, "<", lit("abc", "text"))).alias("int_word"), say(E.compare(lit("12x", "text"), "<=", size)).alias("word_int"), say(E.compare(as_text, "<", lit(5, "integer"))).alias("text_bare"),
        say(E.compare(t(F.col("p_size") * 0 + F.lit(9007199254740993), "integer", column=True), "=", lit(9007199254740992.0, "real"))).alias("beyond"), say(E.compare(lit("zzz", "text"), "<", lit(b"a", "blob"))).alias("blob_last"),
    )


@query("select o_orderkey, '2024-02-29 23:59:58' as stamp, o_totalprice::varchar as price, '7' as blob_text from orders where o_orderkey % 8 = 0 or o_orderkey % 8 = 1")
def clock_and_casts(spark, sf_dir):
    from datetime import datetime, timedelta, timezone

    clock = datetime(2024, 3, 1, 1, 59, 58, tzinfo=timezone(timedelta(hours=2)))
    o = table(spark, sf_dir, "orders").where("o_orderkey % 8 = 0 or o_orderkey % 8 = 1")
    return o.select("o_orderkey", E.datetime_now(clock).alias("stamp"), E.cast_text(F.col("o_totalprice"), "real").alias("price"), E.cast_blob(F.lit(7), "integer").cast("string").alias("blob_text"))


@query("select n_name, r_name from nation left join region on n_regionkey = r_regionkey and r_name <> 'ASIA'")
def broadcast_join(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return R.join(n, r, (n.n_regionkey == r.r_regionkey) & (r.r_name != "ASIA"), how="left", strategy="broadcast").select("n_name", "r_name")


@query("select o_orderkey from orders where o_custkey = 7 and o_orderstatus = 'O'")
def matching_rowids(spark, sf_dir):
    return R.matching_rowids(table(spark, sf_dir, "orders"), "o_orderkey", o_custkey=7, o_orderstatus="O")


@query(f"select p_partkey, (lower(p_brand) = lower('BRAND#12'))::int::bigint as own, 0::bigint as explicit_binary, (lower(p_brand) = lower('BRAND#12'))::int::bigint as right_own, 0::bigint as left_first, (lower(p_type) > 'm')::int::bigint as explicit_nocase from part")
def collate_precedence(spark, sf_dir):
    t = E.Typed
    brand, kind = t(F.col("p_brand"), "text", column=True, nocase=True), F.col("p_type")
    bare = lambda v, **k: t(F.lit(v), "text", **k)
    say = E.as_integer
    return table(spark, sf_dir, "part").select(
        "p_partkey", say(E.compare(brand, "=", bare("BRAND#12"))).alias("own"), say(E.compare(brand, "=", bare("BRAND#12", collate="binary"))).alias("explicit_binary"),
        say(E.compare(bare("BRAND#12"), "=", brand)).alias("right_own"), say(E.compare(t(F.lit("BRAND#12"), "text", column=True), "=", brand)).alias("left_first"),
        say(E.compare(t(kind, "text", column=True), ">", bare("M", collate="nocase"))).alias("explicit_nocase"),
    )


@query("select o_orderkey, o_totalprice from orders where o_custkey < 40 and o_orderstatus = 'O' and o_totalprice > 1000.5")
def parameters(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    named = spark.sql("select * from {o} where o_custkey < :most and o_orderstatus = :status", args={"most": 40, "status": "O"}, o=o)
    return spark.sql("select o_orderkey, o_totalprice from {n} where o_totalprice > ?", args=[1000.5], n=named)


@query("select (select count(*) from orders) as n, (select min(o_orderkey) from orders where o_custkey = 7) as first_of_seven, null::bigint as first_of_none")
def lookups(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return spark.createDataFrame([(R.row_count(o), R.first_rowid(o, "o_orderkey", o_custkey=7), R.first_rowid(o, "o_orderkey", o_custkey=-1))], "n long, first_of_seven long, first_of_none long")


@query("select c_mktsegment, n_name, count(*) as n from customer left join nation on c_nationkey = n_nationkey where c_acctbal > 0 and c_custkey > 10 group by 1, 2 having count(*) > 2 order by n desc, c_mktsegment, n_name limit 12 offset 3")
def builder_query(spark, sf_dir):
    from .builder import Query

    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    q = Query(c).left_join(n, c.c_nationkey == n.n_nationkey).where(F.col("c_acctbal") > 0).where(F.col("c_custkey") > 10).group_by("c_mktsegment", "n_name")
    return q.select(F.count("*").alias("n")).having(F.col("n") > 2).order_by(F.desc("n"), "c_mktsegment", "n_name").limit(12).offset(3).frame()


@query("select o_orderkey from orders where o_totalprice = (select max(o_totalprice) from orders where o_orderstatus = 'F')")
def builder_scalar(spark, sf_dir):
    from .builder import Query, scalar

    o = table(spark, sf_dir, "orders")
    return Query(o).where(F.col("o_totalprice") == scalar(Query(o).where(F.col("o_orderstatus") == "F").select(F.max("o_totalprice").alias("m")))).select("o_orderkey").frame()
