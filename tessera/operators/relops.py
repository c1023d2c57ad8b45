"""Relational operators whose dialect semantics need more than one Spark call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import nocase

MAX_ARMS, MAX_TABLES, MAX_TOP = 500, 64, 4096
#: A side is only hinted for broadcast if its size is known to be below this.
BROADCAST_BYTES = 64 << 20


def first_rows(df: DataFrame, keys: list[Column], rowid: str, bare: list[str], aggregates: list[Column]) -> DataFrame:
    """GROUP BY with bare columns: each is the value of the group's first row in rowid order.

    One pass: ``min_by`` keeps NULL values and is combined before the shuffle.
    """
    return df.groupBy(*keys).agg(*[F.min_by(c, rowid).alias(c) for c in bare], *aggregates)


def distinct_nocase(df: DataFrame, column: str, rowid: str) -> DataFrame:
    """SELECT DISTINCT of a NOCASE column: the spelling of the first row of each class."""
    return df.groupBy(nocase(F.col(column)).alias("fold_")).agg(F.min_by(column, rowid).alias(column)).select(column)


def min_nocase(column: str, rowid: str) -> Column:
    """MIN of a NOCASE column: of equal spellings the first row's. NULLs don't count."""
    return F.min_by(column, F.when(F.col(column).isNotNull(), F.struct(nocase(F.col(column)), F.col(rowid))))


def max_nocase(column: str, rowid: str) -> Column:
    """MAX of a NOCASE column: of equal spellings the first row's. NULLs don't count."""
    return F.max_by(column, F.when(F.col(column).isNotNull(), F.struct(nocase(F.col(column)), -F.col(rowid))))


def slice_rows(df: DataFrame, limit: int | None, offset: int | None = None) -> DataFrame:
    """LIMIT and OFFSET: NULL or negative limits are no limit, negative offsets 0."""
    if offset and offset > 0:
        df = df.offset(offset)
    return df if limit is None or limit < 0 else df.limit(limit)


def top(df: DataFrame, order: list[Column], rowid: str, limit: int | None, offset: int | None = None) -> DataFrame:
    """ORDER BY with stable ties: NULLs first ascending, last descending, then rowid."""
    return slice_rows(df.orderBy(*order, F.col(rowid).asc()), limit, offset)


def compound(first: DataFrame, *arms: tuple[str, DataFrame], nocase_columns: tuple[str, ...] = (), rowid: str | None = None) -> DataFrame:
    """Left-associative UNION and UNION ALL; names and collations come from the first arm.

    ``nocase_columns`` are those of the first arm's columns that compare without case; of
    equal rows the first stays: the first arm's, and within an arm the one of the smallest
    ``rowid``, a column of every arm that is not part of the result.
    """
    if len(arms) >= MAX_ARMS:
        raise ValueError(f"more than {MAX_ARMS} arms")
    names = [c for c in first.columns if c != rowid]
    place = F.struct(F.lit(0).alias("arm"), F.col(rowid).alias("row") if rowid else F.monotonically_increasing_id().alias("row")).alias("place_")
    tag = lambda d, k: d.select(*[c for c in d.columns if c != rowid], place.alias("place_").withField("arm", F.lit(k)).alias("place_"))
    out = tag(first, 0) if nocase_columns else first.select(*names)
    for k, (kind, arm) in enumerate(arms, 1):
        arm = tag(arm, k) if nocase_columns else arm.select(*[c for c in arm.columns if c != rowid])
        if len(arm.columns) != len(out.columns):
            raise ValueError("arms have different numbers of columns")
        out = out.union(arm.toDF(*out.columns))
        if kind not in ("union", "union all"):
            raise ValueError(kind)
        if kind == "union" and nocase_columns:
            keys = [(nocase(F.col(c)) if c in nocase_columns else F.col(c)).alias(f"k{i}_") for i, c in enumerate(names)]
            out = out.groupBy(*keys).agg(F.min_by(F.struct(*names, "place_"), "place_").alias("row_")).select("row_.*")
        elif kind == "union":
            out = out.distinct()
    return out.select(*names)


def order_compound(df: DataFrame, *terms: int | str | tuple[int | str, str], limit: int | None = None, offset: int | None = None) -> DataFrame:
    """ORDER BY of a compound: by ordinals from 1 or output names, each alone or with ``asc`` or ``desc``; then LIMIT and OFFSET."""
    keys = []
    for term in terms:
        name, way = term if isinstance(term, tuple) else (term, "asc")
        if isinstance(name, int):
            if not 1 <= name <= len(df.columns):
                raise ValueError(f"ORDER BY term {name} is not between 1 and {len(df.columns)}")
            name = df.columns[name - 1]
        elif name.lower() not in [c.lower() for c in df.columns]:
            raise ValueError(f"ORDER BY term {name} is not a column of the result")
        keys.append(F.col(name).desc() if way == "desc" else F.col(name).asc())
    return slice_rows(df.orderBy(*keys) if keys else df, limit, offset)


def join(left: DataFrame, right: DataFrame, on, how: str = "inner", strategy: str = "auto") -> DataFrame:
    """Inner or left join by a strategy: auto (adaptive), hash, merge or broadcast.

    ``broadcast`` is a hint only where the right side's estimated size is below
    ``BROADCAST_BYTES``; a larger one is joined by hash.
    """
    if how not in ("inner", "left"):
        raise ValueError("inner and left joins only")
    if strategy == "broadcast":
        size = int(str(right._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        strategy = "broadcast" if size <= BROADCAST_BYTES else "hash"
    hint = {"auto": None, "hash": "shuffle_hash", "merge": "merge", "broadcast": "broadcast"}[strategy]
    return left.join(right.hint(hint) if hint else right, on, how)


def counting_join(left: DataFrame, right: DataFrame, key: str, right_key: str) -> DataFrame:
    """Existence-only inner join that keeps multiplicity, without carrying the right side's rows: ``left.*, matches``."""
    n = right.groupBy(F.col(right_key).alias("key_")).agg(F.count("*").alias("matches"))
    return left.join(n, F.col(key) == F.col("key_")).drop("key_")


def scalar_first(outer: DataFrame, inner: DataFrame, outer_key: str, inner_key: str, value: str, order: str, name: str) -> DataFrame:
    """Correlated scalar subquery: the first inner row's value in order of ``order``, or NULL; one aggregation, one join."""
    one = inner.groupBy(F.col(inner_key).alias("key_")).agg(F.min_by(value, order).alias(name))
    return outer.join(one, F.col(outer_key) == F.col("key_"), "left").drop("key_")


def rowids(df: DataFrame, start: int = 0) -> DataFrame:
    """New rowids above ``start``, dense and in a fixed order of the input's partitions.

    Partition sizes are counted first and only those go to the driver (one number a partition).
    """
    tagged = df.withColumn("part_", F.spark_partition_id()).withColumn("at_", F.monotonically_increasing_id() % F.lit(1 << 33))
    sizes = {r["part_"]: r["n"] for r in tagged.groupBy("part_").agg(F.count("*").alias("n")).collect()}
    before, total = {}, start
    for p in sorted(sizes):
        before[p], total = total, total + sizes[p]
    shift = F.create_map(*[F.lit(x) for p in before for x in (p, before[p])]) if before else F.create_map(F.lit(0), F.lit(start))
    return tagged.withColumn("rowid", F.element_at(shift, F.col("part_")) + F.col("at_") + 1).drop("part_", "at_")


def stream(df: DataFrame):
    """Rows one after the other with early stop; the next partition is fetched ahead."""
    return df.toLocalIterator(prefetchPartitions=True)


def row_count(df: DataFrame) -> int:
    return df.count()


def matching_rowids(df: DataFrame, rowid: str, **equals) -> DataFrame:
    """Rowids of the rows whose columns equal the values, NULL included, in order."""
    for k, v in equals.items():
        df = df.where(F.col(k).eqNullSafe(F.lit(v)))
    return df.select(rowid).orderBy(rowid)


def first_rowid(df: DataFrame, rowid: str, **equals) -> int | None:
    for k, v in equals.items():
        df = df.where(F.col(k).eqNullSafe(F.lit(v)))
    return df.agg(F.min(rowid)).first()[0]
