"""Secret scans: base patterns and multipart credential linking (DataFrame functions only)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, text_or_empty

#: The patterns, in the order in which kinds are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
IDENT = r"""(?i:(?:access|client|account|user|login)(?:_?key)?_?(?:id|name))["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}"""
BLOB = r"[A-Za-z0-9+/]{32,}={0,2}"
ENDPOINT = r"https?://[A-Za-z0-9._-]+(?::[0-9]+)?(?:/[A-Za-z0-9._~/?&=%+-]*)?"
KINDS = ("assign", "access", "hex", "ident", "blob", "endpoint")
BASE = 3
SCOPE = 200


def _lengths(text, pattern: str, group: int | None = None):
    """Lengths of the text before each match, of the matches, and of a group; null without a match."""
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.char_length(x))
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: F.char_length(x))
    parts = [found] if group is None else [found, F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda x: F.char_length(x))]
    return F.when(text.rlike(pattern), F.arrays_zip(gaps.alias("gap"), *[p.alias(n) for p, n in zip(parts, ("len", "value"))]))


def scan(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """A row number for each document, and the spans ``rid, kind, start, end`` of every kind.

    The text is read once; only lengths around matches leave that pass. Starts are
    running sums of those lengths, by row and kind.
    """
    text = F.col("text")
    blob = F.when(text.rlike(BLOB), F.transform(F.regexp_extract_all(text, F.lit(BLOB), F.lit(0)), lambda x: x.rlike("[A-Za-z]") & x.rlike("[0-9]")))
    d = docs.select("doc_id", text_or_empty().alias("text"))
    d = d.select(
        "doc_id", F.xxhash64("text").alias("m"), _lengths(text, ASSIGN, 2).alias("m0"), _lengths(text, ACCESS).alias("m1"), _lengths(text, HEX).alias("m2"),
        _lengths(text, IDENT).alias("m3"), _lengths(text, BLOB).alias("m4"), _lengths(text, ENDPOINT).alias("m5"), blob.alias("mixed"),
    )
    d = scratch.table(d, "lengths").withColumn("rid", F.monotonically_increasing_id())
    d = scratch.table(d, "rows")
    scratch.drop("lengths")
    rows = []
    for k in range(len(KINDS)):
        each = d.where(f"m{k} is not null").select("rid", F.lit(k).alias("kind"), *(["mixed"] if k == 4 else []), F.posexplode(f"m{k}").alias("i", "m"))
        keep = {0: F.col("m.value") >= 6, 4: F.element_at("mixed", F.col("i") + 1)}.get(k, F.lit(True))
        rows.append(each.where("m.len is not null").select("rid", "kind", "i", F.col("m.gap").alias("gap"), F.col("m.len").alias("len"), keep.alias("keep")))
    every = rows[0]
    for r in rows[1:]:
        every = every.union(r)
    w = Window.partitionBy("rid", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("len")).over(w)
    spans = every.withColumn("end", end).where("keep").select("rid", "kind", (F.col("end") - F.col("len")).alias("start"), "end")
    return d.select("doc_id", "m", "rid"), scratch.table(spans, "spans")


def link(spans: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Weak candidates that have their complementary parts within ``scope`` code points.

    Parts are identifiers (``ident`` and ``access``), secrets (``assign``, ``hex``,
    ``blob``) and endpoints. An interval join on (row, scope bin) meets each weak
    candidate, under every bin it covers, with the parts posted under every bin that
    they or their scope cover, so spans of any length meet. Spans of a
    kind don't overlap and have 7 characters or more, so a bin holds a bounded
    number of them. A weak identifier or blob needs the other of the two; an
    endpoint needs both. Parts inside an endpoint are near it, other parts that overlap
    are not near. A blob over a base span is that span, not a candidate.
    """
    role = F.when(F.col("kind").isin(1, 3), 0).when(F.col("kind") == 5, 2).otherwise(1)
    bins = lambda before, after: F.explode(F.sequence(F.floor((F.col("start") - before) / scope), F.floor((F.col("end") + after) / scope))).alias("bin")
    s = spans.withColumn("role", role)
    weak = s.where("kind >= 3").select("*", bins(0, 0))
    parts = s.select("rid", bins(scope, scope), F.col("kind").alias("k2"), F.col("role").alias("r2"), F.col("start").alias("s2"), F.col("end").alias("e2"))
    gap = F.greatest(F.col("start"), F.col("s2")) - F.least(F.col("end"), F.col("e2"))
    near = (gap <= scope) & ((gap >= 0) | ((F.col("kind") == 5) != (F.col("k2") == 5)))
    over = (gap < 0) & (F.col("kind") == 4) & (F.col("k2") < BASE)
    met = weak.join(parts, ["rid", "bin"]).groupBy("rid", "kind", "role", "start", "end").agg(
        F.max(near & (F.col("r2") == 0)).alias("has_id"), F.max(near & (F.col("r2") == 1)).alias("has_secret"), F.max(over).alias("covered")
    )
    full = F.when(F.col("role") == 0, F.col("has_secret")).when(F.col("role") == 1, F.col("has_id") & ~F.col("covered")).otherwise(F.col("has_id") & F.col("has_secret"))
    return met.where(full).select("rid", "kind", "start", "end")


def find_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Secret spans of whole texts: ``doc_id, m, spans array<struct<start, kind, end>>``, one row an input row; ``m`` is a hash of the text.

    ``docs(doc_id, text)``; other columns are not read. Spans are in code points,
    end exclusive, ordered by start and then kind as ``KINDS`` lists them; kinds
    from ``BASE`` on come from linking parts. Null or empty text has no spans, null
    ids and repeated rows are kept as they are, an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    rows, spans = scan(docs, scratch)
    every = spans.where(F.col("kind") < BASE).union(link(spans, scope))
    found = every.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct(F.col("start").cast("long").alias("start"), "kind", F.col("end").cast("long").alias("end")))).alias("spans"))
    found = scratch.table(found, "found")
    scratch.only("rows", "found")
    out = rows.join(found, "rid", "left")
    return out.select("doc_id", "m", F.coalesce("spans", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """Counts and strings of base and of all spans."""
    names = F.array(*[F.lit(k) for k in KINDS])
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"] < BASE)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def redact(text, spans, mark: str = "[SECRET]"):
    """The text with each maximal run of covered code points replaced by ``mark``.

    Spans come ordered by start: a span that starts at or before the end so far
    only moves that end; any other adds the text since then and a mark.
    """
    zero = F.struct(F.lit(0).cast("long").alias("end"), F.lit("").alias("out"))
    def step(a, s):
        inside = (s["start"] < a["end"]) & (a["end"] > 0)
        more = F.concat(a["out"], F.substring(text, (a["end"] + 1).cast("int"), (s["start"] - a["end"]).cast("int")), F.lit(mark))
        return F.struct(F.greatest(a["end"], s["end"]).alias("end"), F.when(inside, a["out"]).otherwise(more).alias("out"))
    return F.aggregate(spans, zero, step, lambda a: F.concat(a["out"], F.substring(text, (a["end"] + 1).cast("int"), F.lit(2**31 - 1))))


def _matches(k: int, pattern: str, group: int = 0, keep: str = "true") -> str:
    """SQL of one kind: lengths around its matches, their running sums, and its spans ``s{k}``."""
    # DuckDB folds other letters than ASCII too, so both cases are spelled out
    p = re.sub(r"\(\?i:(.*?)\)(?=\)|\[)", lambda m: "(?:" + re.sub("[a-z]", lambda c: f"[{c[0]}{c[0].upper()}]", m[1]) + ")", pattern).replace("'", "''")
    size = "lambda x: len(x)"
    return f"""m{k} as (select rid, {k} k, unnest(list_transform(regexp_split_to_array(t, '{p}'), {size})) gap, unnest(list_transform(regexp_extract_all(t, '{p}'), {size})) l,
  unnest(regexp_extract_all(t, '{p}', {group})) v, generate_subscripts(regexp_split_to_array(t, '{p}'), 1) i from d where regexp_matches(t, '{p}')),
s{k} as (select rid, k, (e - l)::bigint s, e::bigint e from (select *, sum(gap + l) over (partition by rid order by i) e from m{k} where l is not null) x where {keep})"""


def sql(scope: int = SCOPE) -> str:
    """DuckDB SQL for ``digest(find_secrets(documents))``: every weak candidate meets all parts of its row."""
    mixed = "regexp_matches(v, '[A-Za-z]') and regexp_matches(v, '[0-9]')"
    kinds = [_matches(0, ASSIGN, 2, "len(v) >= 6"), _matches(1, ACCESS), _matches(2, HEX), _matches(3, IDENT), _matches(4, BLOB, 0, mixed), _matches(5, ENDPOINT)]
    say = f"string_agg({list(KINDS)!r}[k + 1] || ':' || s || ':' || e, ',' order by s, k, e)"
    count = lambda k: f"coalesce(count(*) filter (where k = {k}), 0)"
    near = f"g <= {scope} and (g >= 0 or (k = 5) <> (k2 = 5))"
    return f"""with d as (select doc_id, coalesce(text, '') t, row_number() over () rid from documents), {", ".join(kinds)},
a as (select *, case when k in (1, 3) then 0 when k = 5 then 2 else 1 end r from ({" union all ".join(f"select * from s{k}" for k in range(6))}) u),
w as (select rid, k, r, s, e, bool_or({near} and r2 = 0) i, bool_or({near} and r2 = 1) c, bool_or(g < 0 and k = 4 and k2 < {BASE}) o
  from (select a.*, p.k k2, p.r r2, greatest(a.s, p.s) - least(a.e, p.e) g from a join a p on a.rid = p.rid where a.k >= 3) x group by 1, 2, 3, 4, 5),
f as (select rid, k, s, e from a where k < 3 union all select rid, k, s, e from w where case when r = 0 then c when r = 1 then i and not o else i and c end),
z as (select rid, {count(0)} n0, {count(1)} n1, {count(2)} n2, {say} filter (where k < 3) base, {say} every from f group by 1)
select doc_id, coalesce(n0, 0)::bigint n_assign, coalesce(n1, 0)::bigint n_access, coalesce(n2, 0)::bigint n_hex, sha256(coalesce(base, '')) base_sha256, coalesce(every, '') spans from d left join z using (rid)"""
