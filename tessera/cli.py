"""Command line over a versioned database: ``python -m tessera.cli ROOT COMMAND …``."""

from __future__ import annotations

import argparse
import json

from .session import session
from .sources.database import Database


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera", description=__doc__)
    p.add_argument("root")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("tables", "stats", "check", "create"):
        sub.add_parser(name)
    sub.add_parser("schema").add_argument("table", nargs="?")
    scan = sub.add_parser("scan")
    scan.add_argument("table")
    scan.add_argument("--limit", type=int, default=-1)
    get = sub.add_parser("get")
    get.add_argument("table")
    get.add_argument("rowid", type=int)
    delete = sub.add_parser("delete")
    delete.add_argument("table")
    delete.add_argument("rowid", type=int)
    put = sub.add_parser("put", help="insert or replace one row given as JSON")
    put.add_argument("table")
    put.add_argument("row")
    sub.add_parser("snapshot").add_argument("target")
    load = sub.add_parser("import")
    load.add_argument("file")
    load.add_argument("tables", nargs="*")
    sql = sub.add_parser("sql")
    sql.add_argument("text")
    return p


def run(spark, argv: list[str]) -> list[str]:
    """The lines a command prints."""
    from pyspark.sql import functions as F

    from .operators.relops import slice_rows, stream
    from .sources import sqlite

    a = parser().parse_args(argv)
    db = Database(spark, a.root)
    show = lambda r: json.dumps(r.asDict(), default=lambda x: bytes(x).hex(), ensure_ascii=False)
    defs = {k: db._def(t["def"]) for k, t in db._manifest()[1]["tables"].items()}
    if a.command == "create":
        with db.transaction():
            pass
        return [f"version {db.version()}"]
    if a.command == "tables":
        return sorted(defs)
    if a.command == "schema":
        return [f"{n}({t.schema})" for n, t in sorted(defs.items()) if a.table in (None, n)]
    if a.command == "stats":
        return [f"{n}\t{t.count()}" for n, t in sorted(db.snapshot_tables().items())] + [f"version\t{db.version()}"]
    if a.command == "check":
        return db.verify(deep=True) or ["ok"]
    if a.command == "scan":
        return [show(r) for r in stream(slice_rows(db.table(a.table).orderBy(defs[a.table].rowid), a.limit))]
    if a.command == "get":
        return [show(r) for r in db.table(a.table).where(F.col(defs[a.table].rowid) == a.rowid).collect()]
    if a.command == "delete":
        with db.transaction() as tx:
            n = tx.delete(a.table, F.col(defs[a.table].rowid) == a.rowid)[a.table].changes()
        return [f"{n} deleted"]
    if a.command == "put":
        t = defs[a.table]
        row = spark.createDataFrame([{c.name: json.loads(a.row).get(c.name, c.default) for c in t.columns} | {"order_": 0}], t.schema + ", order_ int")
        with db.transaction() as tx:
            tx.insert(a.table, row.withColumnRenamed("order_", "input_order"), "input_order", "replace")
        return ["1 put"]
    if a.command == "snapshot":
        db.snapshot(a.target)
        return [a.target]
    if a.command == "import":
        names = a.tables or sqlite.table_names(a.file)
        with db.transaction() as tx:
            for n in names:
                t = sqlite.table_def(a.file, n)
                tx.create_table(t)
                tx.insert(n, sqlite.read(spark, a.file, n).withColumn("input_order", F.col(t.rowid)), "input_order")
        return [f"{n} imported" for n in names]
    return [show(r) for r in stream(db.sql(a.text))]


if __name__ == "__main__":
    import sys

    print("\n".join(run(session(), sys.argv[1:])))
