"""A query builder over frames: the same plans that SQL text gives."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import relops as R
from ..operators.dml import KINDS


@dataclass(frozen=True)
class Query:
    """``Query(df).join(...).where(...).group_by(...).select(...).order_by(...).limit(...)``; each call gives a new query."""

    source: DataFrame
    filters: tuple = ()
    groups: tuple = ()
    outputs: tuple = ()
    having_: Column | None = None
    orders: tuple = ()
    limit_: int | None = None
    offset_: int | None = None
    distinct_: bool = False
    tables: int = 1

    def _joined(self, other: DataFrame, on, how: str, strategy: str) -> Query:
        if self.tables >= R.MAX_TABLES:
            raise ValueError(f"more than {R.MAX_TABLES} tables")
        return replace(self, source=R.join(self.source, other, on, how, strategy), tables=self.tables + 1)

    def join(self, other: DataFrame, on, strategy: str = "auto") -> Query:
        return self._joined(other, on, "inner", strategy)

    def left_join(self, other: DataFrame, on, strategy: str = "auto") -> Query:
        return self._joined(other, on, "left", strategy)

    def where(self, condition: Column) -> Query:
        return replace(self, filters=(*self.filters, condition))

    def group_by(self, *keys) -> Query:
        return replace(self, groups=(*self.groups, *keys))

    def having(self, condition: Column) -> Query:
        return replace(self, having_=condition if self.having_ is None else self.having_ & condition)

    def select(self, *outputs) -> Query:
        return replace(self, outputs=(*self.outputs, *outputs))

    def order_by(self, *orders) -> Query:
        return replace(self, orders=(*self.orders, *orders))

    def limit(self, n: int | None) -> Query:
        return replace(self, limit_=n)

    def offset(self, n: int | None) -> Query:
        return replace(self, offset_=n)

    def distinct(self) -> Query:
        return replace(self, distinct_=True)

    def frame(self) -> DataFrame:
        d = self.source
        for f in self.filters:
            d = d.where(f)
        if self.groups:
            keys = [F.col(k) if isinstance(k, str) else k for k in self.groups]
            d = d.groupBy(*keys).agg(*[o for o in self.outputs if isinstance(o, Column)])
            d = d if self.having_ is None else d.where(self.having_)
        elif self.outputs:
            d = d.select(*self.outputs)
        d = d.distinct() if self.distinct_ else d
        d = d.orderBy(*self.orders) if self.orders else d
        return R.slice_rows(d, self.limit_, self.offset_)

    def all(self, as_: type | None = None) -> list:
        """Rows, or objects of a dataclass whose fields name the columns."""
        rows = self.frame().collect()
        return rows if as_ is None else [as_(**{f.name: r[f.name] for f in fields(as_)}) for r in rows]

    def validate(self):
        """The schema, without running; an unknown column raises."""
        return self.frame().schema

    def explain(self) -> str:
        return self.frame()._jdf.queryExecution().explainString(self.source.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


MAX_SUBQUERIES = 16


def literal(x) -> Column:
    """A value of a type that a table can hold; others are refused."""
    if isinstance(x, bool):
        return F.lit(int(x)).cast("bigint")
    if isinstance(x, int):
        if not -(2**63) <= x < 2**63:
            raise ValueError(f"{x} has more than 64 bits")
        return F.lit(x).cast("bigint")
    if x is None or isinstance(x, (float, str, bytes)):
        return F.lit(x)
    raise TypeError(f"no literal of {type(x).__name__}")


def scalar(query: Query, depth: int = 1) -> Column:
    """A scalar subquery: the first column of the first row, NULL without rows. It runs once, when the outer query is planned."""
    if depth > MAX_SUBQUERIES:
        raise ValueError(f"subqueries are nested more than {MAX_SUBQUERIES} deep")
    d = query.frame().limit(1)
    name = d.columns[0]
    return d.agg(F.first(name).alias(name)).scalar()


def all_of(*conditions: Column) -> Column:
    """AND of many conditions as a balanced tree, so that long lists stay shallow."""
    level = list(conditions) or [F.lit(True)]
    while len(level) > 1:
        level = [level[i] if i + 1 == len(level) else level[i] & level[i + 1] for i in range(0, len(level), 2)]
    return level[0]


@dataclass(frozen=True)
class Insert:
    """``Insert("t").values({...}, ...).or_replace().run(transaction)``; or ``.rows(frame, order)``."""

    table: str
    records: tuple = ()
    frame_: DataFrame | None = None
    order: str = "order_of_rows"
    conflict: str = "abort"
    upsert_: tuple | None = None

    def values(self, *records: dict) -> Insert:
        return replace(self, records=(*self.records, *records))

    def rows(self, frame: DataFrame, order: str) -> Insert:
        return replace(self, frame_=frame, order=order)

    def or_replace(self) -> Insert:
        return replace(self, conflict="replace")

    def or_ignore(self) -> Insert:
        return replace(self, conflict="ignore")

    def on_conflict(self, key: str, **sets) -> Insert:
        """DO UPDATE SET: each value is a function of (old row, excluded row)."""
        return replace(self, upsert_=(key, sets))

    def run(self, tx):
        d = self.frame_
        if d is None:
            names = list(dict.fromkeys(k for r in self.records for k in r))
            kinds = {c.name: KINDS[c.kind] for c in tx.defs[self.table].columns}
            odd = [n for n in names if n not in kinds]
            if odd:
                raise ValueError(f"no such column: {odd}")
            for r in self.records:
                for v in r.values():
                    literal(v)
            plain = [(i, *[int(r[n]) if isinstance(r.get(n), bool) else r.get(n) for n in names]) for i, r in enumerate(self.records)]
            d = tx.db.spark.createDataFrame(plain, ", ".join([f"{self.order} int", *[f"`{n}` {kinds[n]}" for n in names]]))
        if self.upsert_:
            return tx.upsert(self.table, d, self.upsert_[0], self.upsert_[1], self.order)
        return tx.insert(self.table, d, self.order, self.conflict)


@dataclass(frozen=True)
class Update:
    """``Update("t").set(a=..., b=...).where(...).run(transaction)``; without ``where`` all rows."""

    table: str
    sets: tuple = ()
    filters: tuple = ()

    def set(self, **values) -> Update:
        return replace(self, sets=(*self.sets, *[(k, v if isinstance(v, Column) else literal(v)) for k, v in values.items()]))

    def where(self, condition: Column) -> Update:
        return replace(self, filters=(*self.filters, condition))

    def run(self, tx):
        return tx.update(self.table, dict(self.sets), all_of(*self.filters))


@dataclass(frozen=True)
class Delete:
    """``Delete("t").where(...).run(transaction)``; without ``where`` all rows."""

    table: str
    filters: tuple = ()

    def where(self, condition: Column) -> Delete:
        return replace(self, filters=(*self.filters, condition))

    def run(self, tx):
        return tx.delete(self.table, all_of(*self.filters))
