"""Functions and aggregates by name: Spark expressions, Arrow functions and grouped Arrow aggregates, for the builder and for SQL text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


class ArityError(TypeError):
    pass


@dataclass(frozen=True)
class Function:
    """``make(*columns)`` gives a Column; ``least`` to ``most`` arguments (None: any number)."""

    name: str
    make: Callable[..., Column]
    least: int = 0
    most: int | None = None
    aggregate: bool = False
    udf: object = None


class Registry:
    """Names are blind to case; a name is registered once unless ``replace`` says otherwise."""

    def __init__(self):
        self._known: dict[str, Function] = {}

    def names(self) -> list[str]:
        return sorted(self._known)

    def _add(self, f: Function, replace: bool) -> Function:
        if f.name.lower() in self._known and not replace:
            raise ValueError(f"{f.name} is registered already")
        self._known[f.name.lower()] = f
        return f

    def expression(self, name: str, make: Callable[..., Column], least: int = 0, most: int | None = None, replace: bool = False) -> Function:
        """A scalar made of Spark's own functions."""
        return self._add(Function(name, make, least, most), replace)

    def scalar(self, name: str, f: Callable, kind: str, least: int = 1, most: int | None = None, replace: bool = False) -> Function:
        """A scalar over Arrow batches: ``f`` takes and returns pandas Series."""
        udf = F.pandas_udf(f, kind)
        return self._add(Function(name, udf, least, most, udf=udf), replace)

    def aggregate(self, name: str, f: Callable, kind: str, least: int = 1, most: int | None = None, replace: bool = False) -> Function:
        """An aggregate over a group's Series; a group is in one task, so it suits groups of bounded size."""
        udf = F.pandas_udf(f, kind, F.PandasUDFType.GROUPED_AGG)
        return self._add(Function(name, udf, least, most, True, udf), replace)

    def call(self, name: str, *args: Column | str) -> Column:
        f = self._known.get(name.lower())
        if f is None:
            raise ValueError(f"no such function: {name}")
        if len(args) < f.least or (f.most is not None and len(args) > f.most):
            raise ArityError(f"wrong number of arguments to function {name}()")
        return f.make(*[F.col(a) if isinstance(a, str) else a for a in args])

    def is_aggregate(self, name: str) -> bool:
        return self._known[name.lower()].aggregate

    def install(self, spark: SparkSession) -> None:
        """The Arrow functions and aggregates under their names in SQL text."""
        for f in self._known.values():
            if f.udf is not None:
                spark.udf.register(f.name, f.udf)
