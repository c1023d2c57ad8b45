import json
import sqlite3

from tessera import cli


def test_commands(spark, tmp_path):
    con = sqlite3.connect(f"{tmp_path}/x.db")
    con.execute("create table t(id integer primary key, name text unique)")
    con.executemany("insert into t values (?, ?)", [(1, "a"), (2, "b"), (9, None)])
    con.commit()
    con.close()
    go = lambda *a: cli.run(spark, [f"{tmp_path}/db", *a])
    assert go("create") == ["version 1"] and go("tables") == []
    assert go("import", f"{tmp_path}/x.db") == ["t imported"]
    assert go("schema") == ["t(`id` bigint, `name` string)"]
    assert [json.loads(x)["id"] for x in go("scan", "t", "--limit", "2")] == [1, 2]
    assert go("put", "t", '{"id": 2, "name": "z"}') == ["1 put"]
    assert json.loads(go("get", "t", "2")[0]) == {"id": 2, "name": "z"}
    assert go("delete", "t", "9") == ["1 deleted"] and go("check") == ["ok"]
    assert json.loads(go("sql", "select count(*) n from {t}")[0]) == {"n": 2}
    assert go("snapshot", f"{tmp_path}/copy") and go("stats")[0] == "t\t2"
