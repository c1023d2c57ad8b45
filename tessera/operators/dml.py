"""Write operators as frame-to-frame functions: each returns the new table and the change set."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import datetime_now, nocase

KINDS = {"INTEGER": "bigint", "REAL": "double", "TEXT": "string", "BLOB": "binary"}
MAX_TRIGGER_DEPTH = 100


#: A column's default: the time of the write, as text in UTC.
NOW = "\x00datetime('now')"
#: The widest cut of new rows that get their rowids in one task is about a 64th.
ROWID_CUTS = 64


class ConstraintError(ValueError):
    pass


@dataclass(frozen=True)
class ColumnDef:
    name: str
    kind: str
    not_null: bool = False
    nocase: bool = False
    default: object = None


@dataclass(frozen=True)
class ForeignKey:
    column: str
    parent: str
    action: str = "restrict"  # or cascade


@dataclass
class TableDef:
    """A strict table; ``rowid`` names its INTEGER key, ``unique`` its unique keys."""

    name: str
    columns: list[ColumnDef]
    rowid: str
    unique: list[tuple[str, ...]] = field(default_factory=list)
    foreign: list[ForeignKey] = field(default_factory=list)

    @property
    def schema(self) -> str:
        return ", ".join(f"`{c.name}` {KINDS[c.kind]}" for c in self.columns)

    def keys(self) -> list[tuple[str, ...]]:
        return [(self.rowid,), *self.unique]

    def key(self, df: DataFrame, names: tuple[str, ...]) -> list[Column]:
        """A key's columns as they compare: folded where NOCASE."""
        fold = {c.name for c in self.columns if c.nocase}
        return [nocase(df[n]) if n in fold else df[n] for n in names]


@dataclass
class Change:
    """A table after a write, and what changed: RETURNING reads ``inserted`` (rows as they are now) or ``deleted`` (as they were).

    ``events`` are the changes row by row for triggers: (insert, update or delete;
    rows now; rows before). ``last`` has the rowid of the row inserted last.
    """

    table: DataFrame
    inserted: DataFrame | None = None
    deleted: DataFrame | None = None
    events: list[tuple[str, DataFrame | None, DataFrame | None]] = field(default_factory=list)
    last: DataFrame | None = None

    def changes(self) -> int:
        return (self.inserted if self.inserted is not None else self.deleted).count()

    def last_insert_rowid(self) -> int | None:
        row = None if self.last is None else self.last.first()
        return None if row is None else row[0]


def default_of(c: ColumnDef, clock=None) -> Column:
    """A column's default value; ``clock`` is an injected time for ``NOW``."""
    return datetime_now(clock) if c.default == NOW else F.lit(c.default)


def conform(rows: DataFrame, t: TableDef, clock=None, *keep: str) -> DataFrame:
    """Rows in the table's columns (and those of ``keep``): missing ones get their default; another type than declared is refused."""
    have = dict(rows.dtypes)
    out = [F.col(c) for c in keep]
    for c in t.columns:
        want = KINDS[c.kind]
        if c.name not in have:
            out.append(default_of(c, clock).cast(want).alias(c.name))
            continue
        if have[c.name] not in {want, "void"} | ({"int", "smallint", "tinyint"} if want == "bigint" else {"float"} if want == "double" else set()):
            raise ConstraintError(f"{t.name}.{c.name} is {c.kind}, not {have[c.name]}")
        x = F.col(c.name).cast(want)
        out.append((F.when(~F.isnan(x), x) if want == "double" else x).alias(c.name))
    return rows.select(*out)


def new_rowids(rows: DataFrame, target: DataFrame, t: TableDef, order: str) -> DataFrame:
    """Rows without a rowid get the largest one plus their place among them in order of the number ``order``.

    The new rows are cut at quantiles of ``order``; the cuts are counted, and rows are
    numbered within their cut, so no task sorts them all.
    """
    missing = rows.where(F.col(t.rowid).isNull())
    if dict(rows.dtypes)[order] not in ("tinyint", "smallint", "int", "bigint", "float", "double"):
        raise ConstraintError(f"{order} must be a number")
    top = target.agg(F.coalesce(F.max(t.rowid), F.lit(0))).first()[0]
    cuts = missing.agg(F.percentile_approx(order, [k / ROWID_CUTS for k in range(1, ROWID_CUTS)], 10_000)).first()[0] or []
    cut = F.size(F.filter(F.array(*[F.lit(x) for x in sorted(set(cuts))]), lambda x: x < F.col(order))) if cuts else F.lit(0)
    missing = missing.withColumn("cut_", cut)
    sizes = {r["cut_"]: r["count"] for r in missing.groupBy("cut_").count().collect()}  # a number a cut
    before, total = [], top
    for k in range(max(sizes, default=0) + 1):
        before.append(total)
        total += sizes.get(k, 0)
    place = F.row_number().over(Window.partitionBy("cut_").orderBy(order))
    numbered = missing.withColumn(t.rowid, F.element_at(F.array(*[F.lit(x).cast("bigint") for x in before]), F.col("cut_") + 1) + place).drop("cut_")
    return rows.where(F.col(t.rowid).isNotNull()).unionByName(numbered)


def validate(df: DataFrame, t: TableDef, columns: set[str] | None = None) -> None:
    """NOT NULL and UNIQUE of a whole table, or of what ``columns`` are part of; NULLs never collide. One pass for each of the two."""
    touched = lambda names: columns is None or bool(columns & set(names))
    needed = [c.name for c in t.columns if (c.not_null or c.name == t.rowid) and touched([c.name])]
    if needed:
        missing = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in needed]).first()
        for c in needed:
            if missing[c]:
                raise ConstraintError(f"NOT NULL constraint failed: {t.name}.{c}")
    keys = [k for k in t.keys() if touched(k)]
    if keys:
        each = []
        for i, names in enumerate(keys):
            k = t.key(df, names)
            whole = reduce(lambda a, b: a & b, [x.isNotNull() for x in k])
            each.append(F.when(whole, F.struct(F.lit(i).alias("i"), F.to_json(F.struct(*[x.alias(f"k{j}") for j, x in enumerate(k)])).alias("k"))))
        seen = df.select(F.explode(F.array(*each)).alias("e")).where("e is not null").groupBy("e.i", "e.k").count()
        twice = seen.where("count > 1").select("i").limit(1).collect()
        if twice:
            raise ConstraintError(f"UNIQUE constraint failed: {t.name}.{', '.join(keys[twice[0]['i']])}")


def _meets(left: DataFrame, right: DataFrame, t: TableDef, names: tuple[str, ...], how: str) -> DataFrame:
    a, b = left.alias("a_"), right.select(*[x.alias(f"k{i}_") for i, x in enumerate(t.key(right, names))]).alias("b_")
    on = None
    for i, x in enumerate(t.key(left, names)):
        on = (x == b[f"k{i}_"]) if on is None else on & (x == b[f"k{i}_"])
    return left.join(b, on, how)


def _first_of_keys(rows: DataFrame, t: TableDef, order: str, last: bool = False) -> DataFrame:
    """Adds ``first_``: whether a row is the first (or last) of the rows for each of its keys."""
    first = F.lit(True)
    for names in t.keys():
        k = t.key(rows, names)
        whole = reduce(lambda a, b: a & b, [x.isNotNull() for x in k])
        w = Window.partitionBy(*k)
        first = first & (~whole | ((F.max(order) if last else F.min(order)).over(w) == F.col(order)))
    return rows.withColumn("first_", first)


def _apart(rows: DataFrame, others: DataFrame, t: TableDef) -> DataFrame:
    """Rows that share no key with the others."""
    for names in t.keys():
        rows = _meets(rows, others, t, names, "left_anti")
    return rows


def insert(target: DataFrame, rows: DataFrame, t: TableDef, order: str, conflict: str = "abort", clock=None) -> Change:
    """INSERT of ``rows`` (with a number ``order`` that says which comes first) OR ABORT, REPLACE or IGNORE, as if row by row.

    With REPLACE every new row deletes all rows that share any of its keys: a new row
    stays if no later one shares a key, and an old row goes if any new one does. With IGNORE a row is
    taken if no old row and no taken row before it shares a key: rows that are the
    first of all their keys are taken and those that share a key with them are out, round
    by round, until none is left; one round where there is one key.
    """
    body = rows.withColumnRenamed(order, "order_")
    conform(body.drop("order_"), t)  # refuses other types
    have = set(body.columns)
    new = body.select("order_", *[(F.col(c.name) if c.name in have else default_of(c, clock)).cast(KINDS[c.kind]).alias(c.name) for c in t.columns])
    reals = [c.name for c in t.columns if c.kind == "REAL"]
    new = new.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in reals}) if reals else new
    new = new_rowids(new, target, t, "order_")
    if conflict == "abort":
        inserted = new.drop("order_")
        out = target.unionByName(inserted)
        validate(out, t)
        return Change(out, inserted, events=[("insert", inserted, None)], last=new.agg(F.max_by(t.rowid, "order_")))
    deleted, kept = None, target
    if conflict == "replace":
        kept = _apart(target, new, t)
        deleted = target.join(kept.select(t.rowid), t.rowid, "left_anti")
        new = _first_of_keys(new, t, "order_", last=True).where("first_").drop("first_")
    elif conflict == "ignore":
        left, taken = _apart(new, target, t), None
        while True:
            left = _first_of_keys(left, t, "order_").persist()
            take = left.where("first_").drop("first_")
            taken = take if taken is None else taken.unionByName(take)
            if not left.where("not first_").limit(1).count():
                break
            left = _apart(left.where("not first_").drop("first_"), take, t)
        new = taken
    else:
        raise ValueError(conflict)
    inserted = new.drop("order_")
    events = ([("delete", None, deleted)] if deleted is not None else []) + [("insert", inserted, None)]
    return Change(kept.unionByName(inserted), inserted, deleted, events, new.agg(F.max_by(t.rowid, "order_")))


def upsert(target: DataFrame, rows: DataFrame, t: TableDef, key: str, sets: dict[str, Callable[[DataFrame, DataFrame], Column]], order: str | None = None) -> Change:
    """INSERT … ON CONFLICT(key) DO UPDATE SET, as if row by row.

    ``sets`` maps a column to a function of (old row, excluded row). Where ``rows`` name a key several
    times, ``order`` says which comes first: the first rows of all keys are applied
    by one join, then the second ones, and so on.
    """
    rows = conform(rows.withColumnRenamed(order, "order_"), t, None, "order_") if order else conform(rows, t)
    times = rows.groupBy(*t.key(rows, (key,))).count().agg(F.max("count")).first()[0] or 0
    if times <= 1:
        return _upsert_once(target, rows.drop("order_"), t, key, sets)
    if order is None:
        raise ConstraintError(f"{key} occurs twice in the batch: say in which order")
    rows = rows.withColumn("round_", F.row_number().over(Window.partitionBy(*t.key(rows, (key,))).orderBy("order_"))).persist()
    out = target
    for k in range(1, times + 1):
        done = _upsert_once(out, rows.where(F.col("round_") == k).drop("order_", "round_"), t, key, sets)
        out = done.table.persist()
    now = _meets(out, rows, t, (key,), "left_semi")
    old = _meets(target, rows, t, (key,), "left_semi")
    return Change(out, now, events=_split(now, old, t))


def _split(now: DataFrame, old: DataFrame, t: TableDef) -> list:
    """Changed rows as insert and update events."""
    ids = old.select(F.col(t.rowid).alias("id_"))
    return [("insert", now.join(ids, F.col(t.rowid) == F.col("id_"), "left_anti"), None), ("update", now.join(ids, F.col(t.rowid) == F.col("id_"), "left_semi"), old)]


def _upsert_once(target: DataFrame, rows: DataFrame, t: TableDef, key: str, sets: dict) -> Change:
    fresh_ids = lambda d: d.select(*[F.col(c.name).alias(c.name) for c in t.columns])  # noqa: E731  a later round joins what an earlier one made of the same rows
    target, rows = fresh_ids(target), fresh_ids(rows)
    old, new = target.alias("old_"), rows.alias("new_")
    hit = old.join(new, t.key(old, (key,))[0] == t.key(new, (key,))[0])
    updated = hit.select(*[sets[c.name](old, new).cast(KINDS[c.kind]).alias(c.name) if c.name in sets else old[c.name] for c in t.columns])
    fresh = _meets(rows, target, t, (key,), "left_anti")
    out = _meets(target, rows, t, (key,), "left_anti").unionByName(updated).unionByName(fresh)
    validate(out, t)
    events = [("insert", fresh, None), ("update", updated, _meets(target, rows, t, (key,), "left_semi"))]
    return Change(out, updated.unionByName(fresh), events=events)


def update(target: DataFrame, t: TableDef, sets: dict[str, Column], where: Column) -> Change:
    """UPDATE: every SET sees the row as it was; the rowid stays."""
    if t.rowid in sets:
        raise ConstraintError("the rowid can't change")
    hit = F.coalesce(where, F.lit(False))
    out = target.select(*[F.when(hit, sets[c.name]).otherwise(F.col(c.name)).cast(KINDS[c.kind]).alias(c.name) if c.name in sets else F.col(c.name) for c in t.columns])
    validate(out, t, set(sets))
    old = target.where(hit)
    new = old.select(*[sets.get(c.name, F.col(c.name)).cast(KINDS[c.kind]).alias(c.name) for c in t.columns])
    return Change(out, new, old, [("update", new, old)])


def delete(tables: dict[str, DataFrame], defs: dict[str, TableDef], name: str, where: Column) -> dict[str, Change]:
    """DELETE with its cascades: children follow their parents level by level; a restricting child refuses.

    A level keeps only the rowids that go, held in memory or on disk, so that a later level
    doesn't run the earlier ones again.
    """
    first = tables[name].where(F.coalesce(where, F.lit(False))).select(F.col(defs[name].rowid).alias("gone_")).persist()
    gone, work = {name: [first]}, [(name, first)]
    while work:
        parent, ids = work.pop(0)
        for child, t in defs.items():
            for fk in t.foreign:
                if fk.parent != parent:
                    continue
                hit = tables[child].join(ids, F.col(fk.column) == F.col("gone_"), "left_semi").select(F.col(t.rowid).alias("gone_"))
                for level in gone.get(child, []):
                    hit = hit.join(level, "gone_", "left_anti")
                hit = hit.persist()
                if not hit.limit(1).count():
                    continue
                if fk.action != "cascade":
                    raise ConstraintError(f"FOREIGN KEY constraint failed: {child}.{fk.column}")
                gone.setdefault(child, []).append(hit)
                work.append((child, hit))
    out: dict[str, Change] = {}
    for n, levels in gone.items():
        ids = reduce(DataFrame.union, levels)
        on = F.col(defs[n].rowid) == F.col("gone_")
        deleted = tables[n].join(ids, on, "left_semi")
        out[n] = Change(tables[n].join(ids, on, "left_anti"), None, deleted, [("delete", None, deleted)])
    return out


def orphans(child: DataFrame, fk: ForeignKey, parent: DataFrame, parent_rowid: str) -> DataFrame:
    """Child rows whose parent is missing, for the integrity check."""
    return child.where(F.col(fk.column).isNotNull()).join(parent.select(F.col(parent_rowid).alias("parent_")), F.col(fk.column) == F.col("parent_"), "left_anti")
