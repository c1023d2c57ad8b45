"""An ordered key/value table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class KeyValues:
    """``df(key binary, value binary)`` with unique keys."""

    df: DataFrame

    def get(self, key: bytes) -> bytes | None:
        row = self.df.where(F.col("key") == F.lit(key)).first()
        return None if row is None else bytes(row["value"])

    def contains(self, key: bytes) -> bool:
        return self.get(key) is not None

    def scan(self, start: bytes | None = None, end: bytes | None = None) -> DataFrame:
        """Rows of ``start <= key < end`` in byte order of the keys."""
        d = self.df
        d = d if start is None else d.where(F.col("key") >= F.lit(start))
        d = d if end is None else d.where(F.col("key") < F.lit(end))
        return d.orderBy("key")

    def put(self, rows: DataFrame) -> KeyValues:
        """With other rows in place of those of their keys."""
        return KeyValues(self.df.join(rows.select("key"), "key", "left_anti").unionByName(rows))

    def delete(self, keys: DataFrame) -> KeyValues:
        return KeyValues(self.df.join(keys.select("key"), "key", "left_anti"))
