"""SQLite files as a source, and the importer: strict types, indexes, denormalised columns."""

from __future__ import annotations

import re
import sqlite3
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.dml import KINDS, ColumnDef, ConstraintError, ForeignKey, TableDef, validate
from .database import Database, FtsDef, IndexDef

ROWS_A_PART = 100_000
_VIRTUAL = re.compile(r"\s*create\s+virtual\s+table\s+.*?using\s+fts5\s*\((.*)\)\s*;?\s*$", re.I | re.S)


def kind_of(declared: str) -> str:
    """The strict kind of a declared type, by SQLite's affinity rules."""
    d = declared.upper()
    if "INT" in d:
        return "INTEGER"
    if any(x in d for x in ("CHAR", "CLOB", "TEXT")):
        return "TEXT"
    return "BLOB" if "BLOB" in d or not d else "REAL"


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def table_names(path: str) -> list[str]:
    with _open(path) as con:
        found = con.execute("select name, sql from sqlite_master where type = 'table' and name not like 'sqlite_%' order by name").fetchall()
    virtual = [n for n, sql in found if _VIRTUAL.match(sql or "")]
    shadow = {f"{v}_{x}" for v in virtual for x in ("data", "idx", "content", "docsize", "config")}
    return [n for n, _ in found if n not in virtual and n not in shadow]


def full_text_tables(path: str) -> dict[str, FtsDef]:
    """The FTS5 tables of a file. One without content of its own or of another table can't be read back: its ``content`` is empty text."""
    with _open(path) as con:
        found = con.execute("select name, sql from sqlite_master where type = 'table'").fetchall()
    out = {}
    for name, sql in found:
        m = _VIRTUAL.match(sql or "")
        if not m:
            continue
        parts = [p.strip() for p in re.findall(r"""(?:[^,'"]|'[^']*'|"[^"]*")+""", m[1])]
        options = {k.strip().lower(): v.strip().strip("'\"") for k, v in (p.split("=", 1) for p in parts if "=" in p)}
        columns = tuple(p.split()[0].strip("'\"") for p in parts if "=" not in p and "unindexed" not in p.lower().split()[1:])
        out[name] = FtsDef(name, columns, options.get("tokenize", "unicode61"), options.get("detail", "full"), options.get("content"))
    return out


def index_defs(path: str, table: str) -> list[IndexDef]:
    """The named indexes of a table, as far as they are over whole columns."""
    with _open(path) as con:
        out = []
        for row in con.execute(f'pragma index_list("{table}")').fetchall():
            columns = tuple(r[2] for r in con.execute(f'pragma index_info("{row[1]}")').fetchall())
            if row[3] == "c" and not row[4] and None not in columns:
                out.append(IndexDef(row[1], table, columns, bool(row[2])))
    return out


def table_def(path: str, name: str) -> TableDef:
    """Columns, rowid alias, unique indexes and foreign keys of a table."""
    with _open(path) as con:
        info = con.execute(f'pragma table_info("{name}")').fetchall()
        keys = [r for r in info if r[5]]
        alias = keys[0][1] if len(keys) == 1 and keys[0][2].upper() == "INTEGER" else "rowid"
        columns = [ColumnDef(r[1], kind_of(r[2]), bool(r[3])) for r in info]
        actions = {"CASCADE": "cascade"}
        foreign = [ForeignKey(r[3], r[2], actions.get(r[6].upper(), "restrict")) for r in con.execute(f'pragma foreign_key_list("{name}")').fetchall()]
        unique = []
        for row in con.execute(f'pragma index_list("{name}")').fetchall():
            if row[2]:
                unique.append(tuple(r[2] for r in con.execute(f'pragma index_info("{row[1]}")').fetchall()))
    return TableDef(name, columns if alias != "rowid" else [ColumnDef("rowid", "INTEGER"), *columns], alias, unique, foreign)


class _Part(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.path, self.table, self.fields = options["path"], options["table"], schema.fields

    def partitions(self):
        with _open(self.path) as con:
            low, high = con.execute(f'select min(rowid), max(rowid) from "{self.table}"').fetchone()
        return [_Part(0, -1)] if low is None else [_Part(a, min(high, a + ROWS_A_PART - 1)) for a in range(low, high + 1, ROWS_A_PART)]

    def read(self, part):
        names = ", ".join("rowid" if f.name == "rowid" else f'"{f.name}"' for f in self.fields)
        convert = [{"bigint": _integer, "double": _real, "string": _text, "binary": _blob}[f.dataType.simpleString()] for f in self.fields]
        with _open(self.path) as con:
            for row in con.execute(f'select {names} from "{self.table}" where rowid between ? and ?', (part.low, part.high)):
                yield tuple(None if v is None else c(v) for c, v in zip(convert, row))


def _integer(v):
    return int(float(v)) if isinstance(v, (str, float)) and str(v).strip() else int(v) if not isinstance(v, (bytes, str)) else None


def _real(v):
    try:
        return float(v)
    except ValueError:
        return None


def _text(v):
    return v if isinstance(v, str) else v.decode("utf-8", "replace") if isinstance(v, bytes) else repr(v) if isinstance(v, float) else str(v)


def _blob(v):
    return v if isinstance(v, bytes) else _text(v).encode()


class SqliteSource(DataSource):
    """``spark.read.format("sqlite").options(path=…, table=…)``: read in rowid ranges. The file must be where all executors can open it."""

    @classmethod
    def name(cls):
        return "sqlite"

    def schema(self):
        return table_def(self.options["path"], self.options["table"]).schema

    def reader(self, schema):
        return _Reader(self.options, schema)


def read(spark: SparkSession, path: str, table: str) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite").options(path=path, table=table).load()


def denormalize(df: DataFrame, computed: dict[str, Column], lookups: list[tuple]) -> DataFrame:
    """Columns computed from the row, and looked up as ``(name, other, key, other key, value, fallback[, order])``.

    A lookup gives the value of the first match in order of the column ``order`` of ``other`` (its rowid; the
    looked-up key where none is named, which says that it is unique), NULL included, else the fallback.
    """
    for name, x in computed.items():
        df = df.withColumn(name, x)
    for name, other, key, other_key, value, fallback, *order in lookups:
        one = other.groupBy(F.col(other_key).alias("key_")).agg(F.min_by(value, order[0] if order else other_key).alias("value_"))
        df = df.join(one, F.col(key) == F.col("key_"), "left").withColumn(name, F.coalesce("value_", fallback)).drop("key_", "value_")
    return df


def import_tables(spark: SparkSession, path: str, out: str, tables: list[str] | None = None, computed: dict | None = None) -> dict[str, TableDef]:
    """Copies tables to Parquet under ``out``, refusing what exists, and checks NOT NULL and UNIQUE of each."""
    defs = {}
    for name in tables or table_names(path):
        t = table_def(path, name)
        df = denormalize(read(spark, path, name), (computed or {}).get(name, {}), [])
        df.write.mode("errorifexists").parquet(f"{out}/{name}")
        validate(spark.read.parquet(f"{out}/{name}").select(*[F.col(c.name).cast(KINDS[c.kind]).alias(c.name) for c in t.columns]), t)
        defs[name] = t
    return defs


@dataclass(frozen=True)
class Manifest:
    """What an import takes and adds: tables (None: all), computed columns and lookups of a table, full-text tables or not."""

    tables: tuple[str, ...] | None = None
    computed: dict[str, dict[str, Column]] = field(default_factory=dict)
    #: ``table: [(column, other table, key, other key, value, fallback)]``; the first match by the other table's rowid.
    lookups: dict[str, list[tuple]] = field(default_factory=dict)
    #: Declarations of the added columns.
    added: dict[str, list[ColumnDef]] = field(default_factory=dict)
    full_text: bool = True


def import_database(db: Database, path: str, manifest: Manifest = Manifest()) -> list[str]:
    """A SQLite file into a database, in one transaction: rows coerced to strict kinds, indexes, foreign keys and full-text tables rebuilt.

    Refuses a table that exists already, and publishes nothing where a constraint fails. Returns what
    was left out: full-text tables without text to read. The result is verified deeply.
    """
    names = list(manifest.tables or table_names(path))
    left_out = []
    with db.transaction() as tx:
        taken = [n for n in names if n in tx.defs]
        if taken:
            raise ValueError(f"tables exist already: {taken}")
        source = {n: read(db.spark, path, n) for n in table_names(path)}
        for n in names:
            t = table_def(path, n)
            t = replace(t, columns=[*t.columns, *manifest.added.get(n, [])], foreign=[f for f in t.foreign if f.parent in names])
            lookups = [(c, source[other], key, other_key, value, fallback, table_def(path, other).rowid) for c, other, key, other_key, value, fallback in manifest.lookups.get(n, [])]
            rows = denormalize(source[n], manifest.computed.get(n, {}), lookups)
            tx.create_table(t)
            tx.tables[n] = rows.select(*[F.col(c.name).cast(KINDS[c.kind]).alias(c.name) for c in t.columns])
            validate(tx.tables[n], t)
            for index in index_defs(path, n):
                if index.unique:
                    tx.defs[n] = replace(tx.defs[n], unique=[u for u in tx.defs[n].unique if u != index.columns])
                tx.create_index(index)
        for name, d in full_text_tables(path).items() if manifest.full_text else ():
            if d.content == "" or (d.content and d.content not in names):
                left_out.append(name)
                continue
            tx.create_fts(d)
            if d.content is None:
                text = read(db.spark, path, f"{name}_content")
                every = [c for c in text.columns if c != "id"]
                tx.fts_insert(name, text.select(F.col("id").alias("rowid"), *[F.col(e).cast("string").alias(c) for e, c in zip(every, d.columns)]))
    wrong = db.verify(deep=True)
    if wrong:
        raise ConstraintError("; ".join(wrong))
    return left_out
