"""Versioned databases: immutable table versions, an atomically published manifest, transactions, indexes, full-text tables, triggers, migrations."""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections import OrderedDict
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fts.index import FtsIndex
from ..operators import dml as D

STATEMENTS = 128


class ConflictError(RuntimeError):
    """Another writer published first."""


@dataclass(frozen=True)
class Trigger:
    """AFTER a write, over the whole change set that passes ``when``.

    Either ``body(transaction, new, old)``, a Python function that lasts as long as
    the ``Database`` object, with ``when`` a condition on the changed row; or ``actions``, which are kept in the database, with
    ``when`` as text over ``new.column`` and ``old.column``. Actions run in order, each once over the set:

    ``{"insert": table, "values": {column: expression}}``, ``{"update": table, "set": {column: expression}, "key": [column, expression]}``,
    ``{"delete": table, "key": [column, expression]}``, ``{"fts_insert": index, "rowid": expression, "values": {column: expression}}``,
    ``{"fts_delete": index, "rowid": expression}``; expressions are text over ``new.column`` and ``old.column``.
    """

    name: str
    table: str
    event: str  # insert, update or delete
    body: Callable | None = None
    when: Column | str | None = None
    actions: tuple[dict, ...] = ()


@dataclass(frozen=True)
class IndexDef:
    """An index: a copy of some columns and the rowid, sorted by the first ones; ``include`` columns are carried to cover queries."""

    name: str
    table: str
    columns: tuple[str, ...]
    unique: bool = False
    include: tuple[str, ...] = ()


@dataclass(frozen=True)
class FtsDef:
    """A full-text table; with ``content`` it indexes that table's text columns and keeps no text itself."""

    name: str
    columns: tuple[str, ...]
    tokenize: str = "unicode61"
    detail: str = "full"
    content: str | None = None


class Files:
    """Small files and folders of a path that Spark can reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark.sparkContext._jvm, root
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.jvm.org.apache.hadoop.fs.Path(root).getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def names(self, name: str) -> list[str]:
        p = self.path(name)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(p)) if self.fs.exists(p) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """False if the file is there already."""
        tmp = self.path(f"_tmp-{uuid.uuid4().hex}")
        stream = self.fs.create(tmp, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        self.fs.mkdirs(self.path(name).getParent())
        if self.fs.exists(self.path(name)) or not self.fs.rename(tmp, self.path(name)):
            self.fs.delete(tmp, True)
            return False
        return True

    def copy(self, source: str, target: str) -> None:
        to = self.jvm.org.apache.hadoop.fs.Path(target)
        self.jvm.org.apache.hadoop.fs.FileUtil.copy(self.fs, self.path(source), to.getFileSystem(self.conf), to, False, self.conf)


@dataclass
class Transaction:
    """Staged tables over one snapshot; all of it is published or nothing."""

    db: Database
    version: int
    tables: dict[str, DataFrame]
    staged: set[str] = field(default_factory=set)
    defs: dict[str, D.TableDef] = field(default_factory=dict)
    indexes: dict[str, IndexDef] = field(default_factory=dict)
    fts_defs: dict[str, FtsDef] = field(default_factory=dict)
    fts: dict[str, FtsIndex] = field(default_factory=dict)
    triggers: dict[str, Trigger] = field(default_factory=dict)
    depth: int = 0
    quiet: set[str] = field(default_factory=set)

    def put(self, name: str, change: D.Change) -> D.Change:
        self.tables[name] = change.table
        self.staged.add(name)
        if name not in self.quiet:
            every = [*self.triggers.values(), *self.db.triggers.values()]
            for event, new, old in change.events:
                for t in sorted(every, key=lambda t: t.name):
                    if t.table == name and t.event == event:
                        self._fire(t, new, old)
        return change

    def _fire(self, t: Trigger, new: DataFrame | None, old: DataFrame | None) -> None:
        if self.depth >= D.MAX_TRIGGER_DEPTH:
            raise RuntimeError("triggers are nested too deeply")
        self.depth += 1
        try:
            if t.body is not None:
                if t.when is not None:
                    new = None if new is None else new.where(t.when)
                    old = None if old is None or t.event != "delete" else old.where(t.when)
                t.body(self, new, old)
            else:
                self._act(t, new, old)
        finally:
            self.depth -= 1

    def _act(self, t: Trigger, new: DataFrame | None, old: DataFrame | None) -> None:
        """The actions of a kept trigger over ``new`` and ``old`` rows side by side."""
        rowid = self.defs[t.table].rowid
        sides = {k: d.select(F.col(rowid).alias("rowid_"), F.struct(*d.columns).alias(k)) for k, d in (("new", new), ("old", old)) if d is not None}
        rows = sides["new"].join(sides["old"], "rowid_") if len(sides) == 2 else next(iter(sides.values()))
        rows = (rows if t.when is None else rows.where(t.when)).drop("rowid_").persist()
        if not rows.limit(1).count():
            return
        for a in t.actions:
            values = [F.expr(e).alias(c) for c, e in a.get("values", {}).items()]
            if "insert" in a:
                self.insert(a["insert"], rows.select(F.monotonically_increasing_id().alias("order_of_rows"), *values), "order_of_rows", a.get("conflict", "abort"))
            elif "update" in a:
                target, (key, e) = a["update"], a["key"]
                hit = rows.select(F.expr(e).alias("key_of_rows"), *[F.expr(x).alias(f"{c}_of_rows") for c, x in a["set"].items()]).dropDuplicates(["key_of_rows"])
                d = self.tables[target].join(hit, F.col(key) == F.col("key_of_rows"), "left")
                sets = {c: F.when(F.col("key_of_rows").isNotNull(), F.col(f"{c}_of_rows")).otherwise(F.col(c)).alias(c) for c in a["set"]}
                d = d.withColumn("hit_of_rows", F.col("key_of_rows").isNotNull())
                now = d.select("hit_of_rows", *[sets.get(c.name, F.col(c.name)) for c in self.defs[target].columns])
                after = now.drop("hit_of_rows")
                D.validate(after, self.defs[target], set(a["set"]))
                changed = now.where("hit_of_rows").drop("hit_of_rows")
                before = self.tables[target].join(hit.select("key_of_rows"), F.col(key) == F.col("key_of_rows"), "left_semi")
                self.put(target, D.Change(after, changed, before, [("update", changed, before)]))
            elif "delete" in a:
                key, e = a["key"]
                ids = self.tables[a["delete"]].join(rows.select(F.expr(e).alias("key_of_rows")), F.col(key) == F.col("key_of_rows"), "left_semi")
                rowid = self.defs[a["delete"]].rowid
                self._delete_rows(a["delete"], ids.select(rowid))
            elif "fts_insert" in a:
                self.fts_insert(a["fts_insert"], rows.select(F.expr(a["rowid"]).alias("rowid"), *values))
            elif "fts_delete" in a:
                self.fts_delete(a["fts_delete"], rows.select(F.expr(a["rowid"]).alias("rowid")))
            else:
                raise ValueError(f"unknown action {a}")

    def _delete_rows(self, name: str, ids: DataFrame) -> None:
        rowid = self.defs[name].rowid
        marked = {**self.tables, name: self.tables[name].join(ids.select(F.col(rowid).alias("gone_of_rows")).distinct(), F.col(rowid) == F.col("gone_of_rows"), "left")}
        for n, change in D.delete(marked, self.defs, name, F.col("gone_of_rows").isNotNull()).items():
            if n == name:
                change.table, change.deleted = change.table.drop("gone_of_rows"), change.deleted.drop("gone_of_rows")
                change.events = [("delete", None, change.deleted)]
            self.put(n, change)

    def create_index(self, index: IndexDef, if_not_exists: bool = False) -> None:
        """An index over a table as it is; a unique one is refused where the rows aren't, and from then on guards every write."""
        if index.name in self.indexes:
            if if_not_exists:
                return
            raise ValueError(f"index {index.name} already exists")
        t = self.defs[index.table]
        odd = {*index.columns, *index.include} - {c.name for c in t.columns}
        if odd:
            raise ValueError(f"no such column: {sorted(odd)}")
        if index.unique:
            t = D.TableDef(t.name, t.columns, t.rowid, [*t.unique, tuple(index.columns)], t.foreign)
            D.validate(self.tables[index.table], t, set(index.columns))
            self.defs[index.table] = t
        self.indexes[index.name] = index
        self.staged.add(f"index {index.name}")

    def drop_index(self, name: str, if_exists: bool = False) -> None:
        if name not in self.indexes:
            if if_exists:
                return
            raise ValueError(f"no such index: {name}")
        index = self.indexes.pop(name)
        t = self.defs[index.table]
        if index.unique:
            unique = list(t.unique)
            unique.remove(tuple(index.columns))
            self.defs[index.table] = D.TableDef(t.name, t.columns, t.rowid, unique, t.foreign)

    def create_fts(self, d: FtsDef, if_not_exists: bool = False) -> None:
        """A full-text table, empty, or filled from its content table."""
        if d.name in self.fts_defs:
            if if_not_exists:
                return
            raise ValueError(f"table {d.name} already exists")
        self.fts_defs[d.name] = d
        self.fts_rebuild(d.name) if d.content else self._fts_put(d.name, self._fts_build(d, self.db.spark.createDataFrame([], "rowid long, " + ", ".join(f"`{c}` string" for c in d.columns))))

    def drop_fts(self, name: str) -> None:
        del self.fts_defs[name], self.fts[name]

    @staticmethod
    def _fts_build(d: FtsDef, rows: DataFrame) -> FtsIndex:
        return FtsIndex.build(rows, "rowid", d.columns, d.tokenize, d.detail)

    def _fts_put(self, name: str, index: FtsIndex) -> None:
        self.fts[name] = index
        self.staged.add(f"fts {name}")

    def fts_rebuild(self, name: str) -> None:
        """The index anew from its content table."""
        d = self.fts_defs[name]
        if d.content is None:
            raise ValueError(f"{name} has no content table")
        self._fts_put(name, self._fts_build(d, self.tables[d.content].withColumn("rowid", F.col(self.defs[d.content].rowid))))

    def fts_insert(self, name: str, rows: DataFrame) -> None:
        """Documents ``(rowid, columns...)``; missing columns are empty, a rowid that is there already is refused."""
        d = self.fts_defs[name]
        have = rows.columns
        rows = rows.select("rowid", *[(F.col(c) if c in have else F.lit(None).cast("string")).alias(c) for c in d.columns])
        self._fts_put(name, self.fts[name].append(rows, "rowid"))

    def fts_delete(self, name: str, ids: DataFrame) -> None:
        self._fts_put(name, self.fts[name].delete(ids.select(F.col("rowid").alias("docid"))))

    def fts_delete_all(self, name: str) -> None:
        self._fts_put(name, self.fts[name].delete_all())

    def create_trigger(self, t: Trigger) -> None:
        """A trigger that the database keeps: its actions run in every later transaction too."""
        if t.event not in ("insert", "update", "delete") or t.body is not None or not t.actions:
            raise ValueError("AFTER INSERT, UPDATE or DELETE with actions only")
        if t.name in self.triggers:
            raise ValueError(f"trigger {t.name} already exists")
        self.triggers[t.name] = t

    def drop_trigger(self, name: str) -> None:
        del self.triggers[name]

    def insert(self, name: str, rows: DataFrame, order: str, conflict: str = "abort") -> D.Change:
        self._no_fts(name)
        return self.put(name, D.insert(self.tables[name], rows, self.defs[name], order, conflict, self.db.clock() if self.db.clock else None))

    def upsert(self, name: str, rows: DataFrame, key: str, sets: dict, order: str | None = None) -> D.Change:
        self._no_fts(name)
        return self.put(name, D.upsert(self.tables[name], rows, self.defs[name], key, sets, order))

    def update(self, name: str, sets: dict[str, Column], where: Column) -> D.Change:
        self._no_fts(name)
        return self.put(name, D.update(self.tables[name], self.defs[name], sets, where))

    def _no_fts(self, name: str) -> None:
        if name in self.fts_defs:
            raise ValueError(f"{name} is a full-text table: it takes fts_insert and fts_delete")

    def delete(self, name: str, where: Column) -> dict[str, D.Change]:
        out = D.delete(self.tables, self.defs, name, where)
        for n, change in out.items():
            self.put(n, change)
        return out

    def create_table(self, t: D.TableDef, if_not_exists: bool = False) -> None:
        if t.name in self.defs:
            if if_not_exists:
                return
            raise ValueError(f"table {t.name} already exists")
        self.defs[t.name] = t
        self.tables[t.name] = self.db.spark.createDataFrame([], t.schema)
        self.staged.add(t.name)

    def drop_table(self, name: str, if_exists: bool = False) -> None:
        if name not in self.defs:
            if if_exists:
                return
            raise ValueError(f"no such table: {name}")
        if any(fk.parent == name for t in self.defs.values() if t.name != name for fk in t.foreign):
            raise D.ConstraintError(f"{name} is referenced by a foreign key")
        if any(d.content == name for d in self.fts_defs.values()):
            raise D.ConstraintError(f"{name} is the content of a full-text table")
        del self.defs[name], self.tables[name]
        self.indexes = {k: i for k, i in self.indexes.items() if i.table != name}
        self.triggers = {k: t for k, t in self.triggers.items() if t.table != name}
        self.staged.discard(name)

    def recreate(self, t: D.TableDef, columns: dict[str, Column]) -> None:
        """Recreate-and-copy: the table in another shape, each column from an expression over the old one."""
        old = self.tables[t.name]
        new = D.conform(old.select(*[columns.get(c.name, F.col(c.name) if c.name in old.columns else F.lit(c.default)).cast(D.KINDS[c.kind]).alias(c.name) for c in t.columns]), t)
        D.validate(new, t)
        self.defs[t.name], self.tables[t.name] = t, new
        self.staged.add(t.name)

    @contextmanager
    def suspending_triggers(self, name: str):
        self.quiet.add(name)
        try:
            yield self
        finally:
            self.quiet.discard(name)


@dataclass
class Reading:
    """A reader under way."""

    future: Future
    stop: Callable[[], None]

    def result(self, timeout: float | None = None):
        return self.future.result(timeout)

    def cancel(self) -> None:
        """A reader that hasn't begun never does; one that runs fails in its Spark job."""
        if not self.future.cancel():
            self.stop()


class Database:
    """Tables under a root folder: ``data/<table>/<version>`` in Parquet, ``manifest/<n>.json`` naming the current ones.

    Readers hold the manifest they began with and never see a later one. A
    writer stages new versions and publishes manifest ``n + 1``; creating that
    file is the commit, and the writer that finds it taken has lost. (The folder
    must be on a file system whose rename is atomic.) ``clock`` gives the time of ``NOW`` defaults.
    """

    def __init__(self, spark: SparkSession, root: str, clock: Callable | None = None):
        self.spark, self.root, self.clock = spark, root.rstrip("/"), clock
        self.files = Files(spark, self.root)
        self.triggers: dict[str, Trigger] = {}
        self._writer = threading.Lock()
        self._pool = ThreadPoolExecutor(4)
        self._statements: OrderedDict[tuple, DataFrame] = OrderedDict()
        self._slow: tuple[float, Callable] | None = None

    def _manifest(self) -> tuple[int, dict]:
        names = [n for n in self.files.names("manifest") if n.endswith(".json")]
        if not names:
            return 0, {"tables": {}, "user_version": 0}
        return int(names[-1][:-5]), json.loads(self.files.read(f"manifest/{names[-1]}"))

    def version(self) -> int:
        return self._manifest()[0]

    @staticmethod
    def _def(d: dict) -> D.TableDef:
        return D.TableDef(d["name"], [D.ColumnDef(**c) for c in d["columns"]], d["rowid"], [tuple(u) for u in d["unique"]], [D.ForeignKey(**f) for f in d["foreign"]])

    def snapshot_tables(self) -> dict[str, DataFrame]:
        """The tables of the newest version, frozen."""
        return {n: self.spark.read.schema(self._def(t["def"]).schema).parquet(f"{self.root}/{t['path']}") for n, t in self._manifest()[1]["tables"].items()}

    def table(self, name: str) -> DataFrame:
        return self.snapshot_tables()[name]

    def sql(self, text: str, args: dict | list | None = None) -> DataFrame:
        """Spark SQL over the snapshot; tables are named in braces, parameters as ``:name`` or ``?``."""
        tables = {n: t for n, t in self.snapshot_tables().items() if "{" + n + "}" in text}
        return self.spark.sql(text, args=args, **tables)

    def prepare(self, text: str, args: dict | list | None = None) -> DataFrame:
        """``sql`` with a cache: of the last ``STATEMENTS`` texts, arguments and versions the analysed plan is kept."""
        key = (text, json.dumps(args, default=str), self.version())
        if key in self._statements:
            self._statements.move_to_end(key)
        else:
            self._statements[key] = self.sql(text, args)
            if len(self._statements) > STATEMENTS:
                self._statements.popitem(last=False)
        return self._statements[key]

    def on_slow_query(self, seconds: float, hook: Callable[[str, float], None]) -> None:
        """``hook(text, seconds)`` after each ``rows`` call that takes longer."""
        self._slow = (seconds, hook)

    def rows(self, text: str, args: dict | list | None = None) -> list:
        """Rows of a prepared statement."""
        began = time.monotonic()
        out = self.prepare(text, args).collect()
        took = time.monotonic() - began
        if self._slow and took >= self._slow[0]:
            self._slow[1](text, took)
        return out

    def seek(self, index: str, *equals, low=None, high=None) -> DataFrame:
        """The index's columns and the rowid where its first columns equal the values and the next is in ``low <= x < high``: a pruned scan of sorted files."""
        entry = self._manifest()[1].get("indexes", {})[index]
        i = IndexDef(**{k: tuple(v) if isinstance(v, list) else v for k, v in entry["def"].items()})
        d = self.spark.read.parquet(f"{self.root}/{entry['path']}")
        for c, v in zip(i.columns, equals):
            d = d.where(F.col(c) == F.lit(v))
        if low is not None:
            d = d.where(F.col(i.columns[len(equals)]) >= F.lit(low))
        if high is not None:
            d = d.where(F.col(i.columns[len(equals)]) < F.lit(high))
        return d

    def fts(self, name: str) -> FtsIndex:
        """A full-text table of the newest version."""
        return FtsIndex.open(self.spark, f"{self.root}/{self._manifest()[1]['fts'][name]['path']}")

    @staticmethod
    def _kept(manifest: dict) -> tuple[dict, dict, dict]:
        plain = lambda d: {k: tuple(v) if isinstance(v, list) else v for k, v in d.items()}
        indexes = {k: IndexDef(**plain(e["def"])) for k, e in manifest.get("indexes", {}).items()}
        fts = {k: FtsDef(**plain(e["def"])) for k, e in manifest.get("fts", {}).items()}
        return indexes, fts, {k: Trigger(t["name"], t["table"], t["event"], None, t["when"], tuple(t["actions"])) for k, t in manifest.get("triggers", {}).items()}

    @contextmanager
    def transaction(self, user_version: int | None = None):
        """All-or-nothing writes; an exception publishes nothing."""
        with self._writer:
            n, manifest = self._manifest()
            defs = {k: self._def(t["def"]) for k, t in manifest["tables"].items()}
            indexes, fts_defs, triggers = self._kept(manifest)
            fts = {k: FtsIndex.open(self.spark, f"{self.root}/{manifest['fts'][k]['path']}") for k in fts_defs}
            tables = {k: self.spark.read.schema(defs[k].schema).parquet(f"{self.root}/{t['path']}") for k, t in manifest["tables"].items()}
            tx = Transaction(self, n, tables, defs=defs, indexes=indexes, fts_defs=fts_defs, fts=fts, triggers=triggers)
            yield tx
            out = {"tables": {}, "indexes": {}, "fts": {}, "triggers": {}, "user_version": manifest["user_version"] if user_version is None else user_version}
            fresh = lambda kind, name: f"data/{kind}{name}/{n + 1}-{uuid.uuid4().hex[:8]}"
            for name, t in tx.defs.items():
                path = manifest["tables"].get(name, {}).get("path")
                if name in tx.staged:
                    path = fresh("", name)
                    tx.tables[name].write.parquet(f"{self.root}/{path}")
                columns = [c.__dict__ for c in t.columns]
                out["tables"][name] = {"path": path, "def": {"name": name, "columns": columns, "rowid": t.rowid, "unique": t.unique, "foreign": [f.__dict__ for f in t.foreign]}}
            for name, i in tx.indexes.items():
                path = manifest.get("indexes", {}).get(name, {}).get("path")
                if i.table in tx.staged or f"index {name}" in tx.staged:
                    path, t = fresh("index-", name), tx.defs[i.table]
                    written = self.spark.read.schema(t.schema).parquet(f"{self.root}/{out['tables'][i.table]['path']}")
                    columns = list(dict.fromkeys([*i.columns, *i.include, t.rowid]))
                    written.select(*columns).repartitionByRange(*i.columns, t.rowid).sortWithinPartitions(*i.columns, t.rowid).write.parquet(f"{self.root}/{path}")
                out["indexes"][name] = {"path": path, "def": asdict(i)}
            for name, d in tx.fts_defs.items():
                path = manifest.get("fts", {}).get(name, {}).get("path")
                if f"fts {name}" in tx.staged:
                    path = fresh("fts-", name)
                    tx.fts[name].save(f"{self.root}/{path}")
                out["fts"][name] = {"path": path, "def": asdict(d)}
            out["triggers"] = {k: {"name": t.name, "table": t.table, "event": t.event, "when": t.when, "actions": list(t.actions)} for k, t in tx.triggers.items()}
            if not self.files.create(f"manifest/{n + 1:012d}.json", json.dumps(out)):
                raise ConflictError("another writer published first")

    def create_trigger(self, t: Trigger) -> None:
        if t.event not in ("insert", "update", "delete"):
            raise ValueError("AFTER INSERT, UPDATE or DELETE only")
        self.triggers[t.name] = t

    def drop_trigger(self, name: str) -> None:
        del self.triggers[name]

    def migrate(self, steps: dict[int, Callable[[Transaction], None]]) -> list[int]:
        """Runs the steps above the current user version in order, each in a transaction; forward only."""
        now = self._manifest()[1]["user_version"]
        if steps and now > max(steps):
            raise ValueError(f"the database is at version {now}, newer than {max(steps)}")
        done = []
        for v in sorted(v for v in steps if v > now):
            with self.transaction(user_version=v) as tx:
                steps[v](tx)
            done.append(v)
        return done

    def pragma(self, name: str):
        """Plausible answers to getters, none to others."""
        n, manifest = self._manifest()
        return {"user_version": manifest["user_version"], "schema_version": n, "foreign_keys": 1, "journal_mode": "wal", "encoding": "UTF-8"}.get(name)

    def verify(self, deep: bool = False) -> list[str]:
        """What is wrong: types, NOT NULL and UNIQUE of each table; with ``deep`` also orphans, indexes that differ from their tables and full-text lengths that differ from their content."""
        out, tables = [], self.snapshot_tables()
        defs = {k: self._def(t["def"]) for k, t in self._manifest()[1]["tables"].items()}
        for name, t in defs.items():
            try:
                D.validate(tables[name], t)
            except D.ConstraintError as e:
                out.append(str(e))
            have = {f.name: f.dataType.simpleString() for f in self.spark.read.parquet(f"{self.root}/{self._manifest()[1]['tables'][name]['path']}").schema}
            out += [f"{name}.{c.name} is {have.get(c.name)}, not {D.KINDS[c.kind]}" for c in t.columns if have.get(c.name) != D.KINDS[c.kind]]
            for fk in t.foreign if deep else ():
                if fk.parent not in tables:
                    out.append(f"{name}.{fk.column}: no table {fk.parent}")
                    continue
                n = D.orphans(tables[name], fk, tables[fk.parent], defs[fk.parent].rowid).count()
                if n:
                    out.append(f"{name}.{fk.column}: {n} rows without parent")
        indexes, fts, _ = self._kept(self._manifest()[1])
        for name, i in indexes.items() if deep else ():
            index = self.seek(name)
            want = tables[i.table].select(*index.columns)
            n = want.exceptAll(index).count() + index.exceptAll(want).count()
            if n:
                out.append(f"index {name}: {n} rows differ")
        for name, d in fts.items() if deep else ():
            if d.content:
                rows = tables[d.content].withColumn("rowid", F.col(defs[d.content].rowid))
                want, have = FtsIndex.build(rows, "rowid", d.columns, d.tokenize, d.detail).stats, self.fts(name).stats
                n = want.exceptAll(have).count() + have.exceptAll(want).count()
                if n:
                    out.append(f"full-text table {name}: {n} documents differ")
        return out

    def snapshot(self, target: str) -> None:
        """A copy of the current version at another path, which must not exist."""
        to = self.files.jvm.org.apache.hadoop.fs.Path(target)
        if to.getFileSystem(self.files.conf).exists(to):
            raise FileExistsError(target)
        n, manifest = self._manifest()
        for t in [*manifest["tables"].values(), *manifest.get("indexes", {}).values(), *manifest.get("fts", {}).values()]:
            self.files.copy(t["path"], f"{target}/{t['path']}")
        Files(self.spark, target).create(f"manifest/{n:012d}.json", json.dumps(manifest))

    def read_async(self, f: Callable[[dict[str, DataFrame]], object]) -> Reading:
        """Runs a reader on its own snapshot beside others; its Spark jobs end when it is cancelled."""
        tag = f"read-{uuid.uuid4().hex}"
        tables = self.snapshot_tables()

        def run():
            self.spark.sparkContext.addJobTag(tag)
            try:
                return f(tables)
            finally:
                self.spark.sparkContext.removeJobTag(tag)

        return Reading(self._pool.submit(run), lambda: self.spark.sparkContext.cancelJobsWithTag(tag))

    def write_async(self, f: Callable[[Transaction], object]) -> Future:
        """Runs a writer after the writers before it."""

        def run():
            with self.transaction() as tx:
                return f(tx)

        return self._pool.submit(run)
