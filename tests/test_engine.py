import os
import random
import struct

import pytest

from epochsql.cli import run_script
from epochsql.engine import Session, connect
from epochsql.engine.auth import AuthError, allowed
from epochsql.engine.session import ExecutionError
from epochsql.functions.format import as_binary, as_json, as_text
from epochsql.operators import temporal
from epochsql.server import answer
from epochsql.sources.changelog import Conflict, StoreError


@pytest.fixture
def s(spark, tmp_path):
    return Session(spark, str(tmp_path / "store"))


def rows(s, text):
    return sorted(tuple(r) for r in s.sql(text).collect())


def test_bank(s):
    s.execute("2E3MEL GADWAL bank (id RAKAM ASASI, money RAKAM);")
    s.execute("EMLA GOWA bank ELKEYAM (1, 1000000);")
    then = s.db.commits()[s.db.head()]["ts"]
    assert s.execute("3ADEL GOWA bank 5ALY money = 0 LAMA id = 1;").message == "UPDATE 1"
    assert rows(s, "SELECT * FROM bank;") == [(1, 0)]
    assert rows(s, f"2E5TAR * MEN bank AS OF {then};") == [(1, 1000000)]
    assert rows(s, f"SELECT * FROM bank AS OF {then - 1};") == []
    s.execute(f"ERGA3 ELA {then};")
    assert rows(s, "SELECT * FROM bank;") == [(1, 1000000)]
    s.execute("RECOVER TO LATEST;")
    assert rows(s, "SELECT * FROM bank;") == [(1, 1000000)]


def test_constraints(s):
    s.execute("CREATE TABLE t (id INT PRIMARY KEY AUTO_INCREMENT, name STRING(5) NOT NULL, mail STRING UNIQUE, age INT CHECK (age >= 18), pay DECIMAL DEFAULT 1.5, CHECK (pay >= 0));")
    assert s.execute("INSERT INTO t (name, mail, age) VALUES ('a', 'x', 20), ('b', NULL, NULL);").message == "INSERT 2"
    assert rows(s, "SELECT id, pay FROM t;") == [(1, 1.5), (2, 1.5)]
    for bad in (
        "INSERT INTO t VALUES (1, 'c', 'z', 20, 1)",
        "INSERT INTO t (name, mail) VALUES ('c', 'x')",
        "INSERT INTO t (name, age) VALUES ('c', 17)",
        "INSERT INTO t (mail) VALUES ('q')",
        "INSERT INTO t (name) VALUES ('longer than five')",
        "INSERT INTO t (name, pay) VALUES ('c', -1)",
        "INSERT INTO t (name, age) VALUES ('c', 'old')",
        "INSERT INTO t (name, age) VALUES ('c')",
        "INSERT INTO t (nobody) VALUES ('c')",
        "UPDATE t SET id = 2 WHERE id = 1",
        "UPDATE t SET age = 3",
        "UPDATE t SET name = NULL",
    ):
        with pytest.raises((ExecutionError, StoreError)):
            s.execute(bad + ";")
    assert len(rows(s, "SELECT * FROM t;")) == 2
    assert s.execute("UPDATE t SET id = 1 WHERE id = 1;").message == "UPDATE 1"


def test_foreign_keys(s):
    s.execute("CREATE TABLE p (id INT PRIMARY KEY);")
    for t, act in (("c", "CASCADE"), ("n", "SET NULL"), ("r", "RESTRICT")):
        s.execute(f"CREATE TABLE {t} (id INT PRIMARY KEY, p INT, FOREIGN KEY (p) REFERENCES p (id) ON DELETE {act} ON UPDATE {act});")
    s.execute("CREATE TABLE g (id INT, c INT, FOREIGN KEY (c) REFERENCES c (id) ON DELETE CASCADE);")
    s.execute("INSERT INTO p VALUES (1), (2), (3);")
    s.execute("INSERT INTO c VALUES (10, 1), (11, 2);")
    s.execute("INSERT INTO n VALUES (20, 1), (21, NULL);")
    s.execute("INSERT INTO r VALUES (30, 3);")
    s.execute("INSERT INTO g VALUES (40, 10);")
    with pytest.raises(ExecutionError):
        s.execute("INSERT INTO c VALUES (12, 9);")
    with pytest.raises(ExecutionError):
        s.execute("DELETE FROM p WHERE id = 3;")
    with pytest.raises(ExecutionError):
        s.execute("DROP TABLE p;")
    assert s.execute("DELETE FROM p WHERE id = 1;").message == "DELETE 1"
    assert rows(s, "SELECT * FROM c;") == [(11, 2)]
    assert rows(s, "SELECT * FROM g;") == []
    assert s.sql("SELECT * FROM n WHERE id = 20;").first()["p"] is None
    s.execute("UPDATE p SET id = 7 WHERE id = 2;")
    assert rows(s, "SELECT * FROM c;") == [(11, 7)]


def test_transactions(s):
    s.execute("CREATE TABLE t (id INT);")
    s.execute("INSERT INTO t VALUES (1);")
    assert s.execute("BEGIN;").message == "BEGIN TRANSACTION 1"
    s.execute("INSERT INTO t VALUES (2);")
    s.execute("UPDATE t SET id = 5 WHERE id = 1;")
    assert rows(s, "SELECT * FROM t;") == [(2,), (5,)]
    other = Session(s.spark, s.root)
    assert rows(other, "SELECT * FROM t;") == [(1,)]
    s.execute("ROLLBACK;")
    assert rows(s, "SELECT * FROM t;") == [(1,)]
    s.execute("BEGIN;")
    s.execute("UPDATE t SET id = 6;")
    other.execute("UPDATE t SET id = 7;")
    with pytest.raises(Conflict):
        s.execute("COMMIT;")
    assert rows(s, "SELECT * FROM t;") == [(7,)]
    with pytest.raises(ExecutionError):
        s.execute("COMMIT;")


def test_random_histories(s):
    """Forward, reverse and a replay in memory agree at every commit, with rollbacks and checkpoints in between."""
    s.execute("CREATE TABLE t (id INT, v INT);")
    rng, now, states = random.Random(3), {}, []
    for step in range(14):
        kind = rng.choice(["insert", "update", "delete", "rollback", "insert"])
        if step == 7:
            s.execute("CHECKPOINT;")
        if kind == "rollback":
            s.execute("BEGIN;")
            s.execute("DELETE FROM t;")
            s.execute("ROLLBACK;")
            continue
        k = rng.randrange(4)
        if kind == "insert":
            now[step] = k
            s.execute(f"INSERT INTO t VALUES ({step}, {k});")
        elif kind == "update":
            now = {i: (9 if v == k else v) for i, v in now.items()}
            s.execute(f"UPDATE t SET v = 9 WHERE v = {k};")
        else:
            now = {i: v for i, v in now.items() if v != k}
            s.execute(f"DELETE FROM t WHERE v = {k};")
        if s.db.head() > len(states):
            states.append((s.db.commits()[s.db.head()]["ts"], dict(now)))
    for ts, want in states:
        for way in ("forward", "reverse", "auto"):
            assert {r["row"]["id"]: r["row"]["v"] for r in s.db.as_of("t", ts, way).collect()} == want


def test_index_and_drop(s):
    s.execute("CREATE TABLE t (id INT);")
    assert s.execute("CREATE INDEX i ON t (id);").message == "CREATE INDEX SUCCESS"
    with pytest.raises(ExecutionError):
        s.execute("CREATE INDEX j ON t (nobody);")
    s.execute("INSERT INTO t VALUES (1), (1);")
    assert rows(s, "SELECT * FROM t WHERE id = 1 OR id = 2;") == [(1,), (1,)]
    assert s.execute("DROP INDEX i;").message == "DROP INDEX SUCCESS"
    s.execute("DELETE TABLE t;")
    with pytest.raises(StoreError):
        s.execute("SELECT * FROM t;")
    s.execute("CREATE TABLE t (name STRING);")
    assert rows(s, "SELECT * FROM t;") == []


def test_users_and_databases(s):
    s.execute("CREATE USER ali PASS secret ROLE READONLY;")
    s.execute("CREATE DATABASE d2;")
    s.execute("CREATE TABLE t (id INT);")
    with pytest.raises(ExecutionError):
        s.execute("DROP DATABASE main;")
    c = connect(s.spark, "db://ali:secret@host:2501/main", s.root)
    assert rows(c, "SELECT * FROM t;") == []
    for bad in ("INSERT INTO t VALUES (1)", "CREATE TABLE x (a INT)", "USE d2", "CREATE USER x PASS y ROLE ADMIN"):
        with pytest.raises(AuthError):
            c.execute(bad + ";")
    s.execute("UPDATE USER ali ROLE NORMAL;")
    assert c.execute("INSERT INTO t VALUES (1);").message == "INSERT 1"
    with pytest.raises(AuthError):
        connect(s.spark, "db://ali:wrong@host/main", s.root)
    with pytest.raises(AuthError):
        s.execute("DELETE USER root;")
    assert [r[0] for r in s.sql("SHOW DATABASES;").collect()] == ["d2", "main"]
    assert s.sql("WHOAMI;").first()[0] == "root"
    assert allowed("ADMIN", "DROP TABLE") and not allowed("NORMAL", "DROP TABLE") and not allowed("DENIED", "SELECT")


def test_shows(s):
    s.execute("CREATE TABLE t (id INT PRIMARY KEY, n STRING(9) DEFAULT 'x');")
    assert [tuple(r) for r in s.sql("DESCRIBE t;").collect()] == [("id", "INTEGER", "NO", "PRI", "", ""), ("n", "VARCHAR(9)", "YES", "", "x", "")]
    assert "PRIMARY KEY (`id`)" in s.sql("SHOW CREATE TABLE t;").first()[1]
    assert "Physical Plan" in " ".join(r[0] for r in s.sql("EXPLAIN SELECT * FROM t;").collect())


def test_forms(spark):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    assert as_text(df) == " a | b   \n---+------\n 1 | NULL\n(1 row)\n"
    assert '"row_count": 1' in as_json(df)
    b = as_binary(df)
    assert b[0] == 2 and struct.unpack(">II", b[1:9]) == (2, 1)


def test_server_answers(s):
    assert answer(s, "Q", "SELECT nonsense").startswith(b"ERROR")
    assert b'"success": true' in answer(s, "J", "CREATE TABLE t (a INT);")
    assert answer(s, "B", "INSERT INTO t VALUES (1);")[0] == 1


def test_script(s):
    out = run_script(s, "CREATE TABLE t (a INT); -- c;\nINSERT INTO t VALUES (1); SELECT * FROM t; nonsense;")
    assert out[1] == "INSERT 1\n" and "(1 row)" in out[2] and out[3].startswith("ERROR")


def test_cdc(s, tmp_path):
    from epochsql.streaming import change_stream

    s.execute("CREATE TABLE t (a INT);")
    s.execute("INSERT INTO t VALUES (1), (2);")
    s.execute("BEGIN;")
    s.execute("INSERT INTO t VALUES (9);")
    s.execute("ROLLBACK;")
    s.execute("DELETE FROM t WHERE a = 1;")
    got = []
    q = change_stream(s.db, "t", lambda df, _: got.extend((r["_op"], (r["row"] or r["pre"])["a"]) for r in df.collect()), str(tmp_path / "cp"), available_now=True)
    q.awaitTermination(60)
    assert sorted(got) == [("D", 1), ("I", 1), ("I", 2)]


def test_log_from_events(spark):
    e = spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (3, 1, "end"), (4, 1, "c"), (5, 2, "end")], "t int, k int, v string")
    from pyspark.sql import functions as F

    log = temporal.log_from_events(e, ["k"], ["t"], F.col("v") == "end")
    assert [r["_op"] for r in log.where("_rid.k = 1").orderBy("_seq").collect()] == ["I", "U", "D", "I"]
    live = temporal.forward(log, F.lit(True))
    for t in range(7):
        a = temporal.forward(log, F.col("_ts") <= t).select("row.*").collect()
        b = temporal.reverse(live, log, F.col("_ts") > t).select("row.*").collect()
        assert sorted(a) == sorted(b)


def test_auto_increment_is_gapless(spark, tmp_path):
    from pyspark.sql import functions as F

    from epochsql.operators import constraints as C

    df = spark.range(1000).select(F.lit(None).cast("int").alias("id"), F.col("id").alias("x"))
    for aqe in ("true", "false"):
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", aqe)
        wide = df.repartition(7)
        got = C.auto_increment(wide, "id", 5, ["x"], str(tmp_path / aqe)).collect()
        assert sorted(r["id"] for r in got) == list(range(6, 1006)) and all(r["id"] == r["x"] + 6 for r in got)
        ties = C.auto_increment(wide.withColumn("x", F.col("x") % 3), "id", 0, ["x"], str(tmp_path / f"ties{aqe}"))
        got = sorted((r["id"], r["x"]) for r in ties.collect())
        assert [i for i, _ in got] == list(range(1, 1001)) and [x for _, x in got] == sorted(x for _, x in got)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables here")
def test_auto_increment_over_many_ranges(spark, tmp_path):
    from pyspark.sql import functions as F

    from epochsql.operators import constraints as C

    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.shuffle.partitions", 8)
    o = spark.read.parquet("/root/testdata/sf0.1/orders.parquet").select(F.lit(None).cast("long").alias("id"), "o_orderkey")
    for aqe in ("true", "false"):
        spark.conf.set("spark.sql.adaptive.enabled", aqe)
        got = C.auto_increment(o, "id", 0, ["o_orderkey"], str(tmp_path / aqe))
        want = [r[0] for r in o.select("o_orderkey").orderBy("o_orderkey").collect()]
        assert [r[1] for r in sorted(got.collect())] == want and got.agg(F.max("id"), F.count_distinct("id")).first() == (len(want), len(want))
    for k, v in before.items():
        spark.conf.set(k, v)


def test_keys_hold_between_sessions(s):
    s.execute("CREATE TABLE p (id INT PRIMARY KEY, n INT);")
    s.execute("CREATE TABLE c (id INT, p INT REFERENCES p (id));")
    other = Session(s.spark, s.root)
    s.execute("BEGIN;")
    s.execute("INSERT INTO p VALUES (1, 10);")
    other.execute("INSERT INTO p VALUES (1, 20);")
    with pytest.raises(Conflict):
        s.execute("COMMIT;")
    assert rows(s, "SELECT * FROM p;") == [(1, 20)]
    # a child against the deletion of its parent, in both orders
    s.execute("BEGIN;")
    s.execute("INSERT INTO c VALUES (5, 1);")
    other.execute("DELETE FROM p WHERE id = 1;")
    with pytest.raises(Conflict):
        s.execute("COMMIT;")
    s.execute("INSERT INTO p VALUES (2, 30);")
    s.execute("BEGIN;")
    s.execute("DELETE FROM p WHERE id = 2;")
    other.execute("INSERT INTO c VALUES (6, 2);")
    with pytest.raises(Conflict):
        s.execute("COMMIT;")
    assert rows(s, "SELECT * FROM p;") == [(2, 30)] and rows(s, "SELECT * FROM c;") == [(6, 2)]


def test_a_statement_is_run_anew_after_anothers_commit(s, monkeypatch):
    s.execute("CREATE TABLE t (id INT PRIMARY KEY AUTO_INCREMENT, v INT);")
    other, publish, raced = Session(s.spark, s.root), s.db.publish, []

    def late(*args):
        if not raced:
            raced.append(other.execute("INSERT INTO t (v) VALUES (1);"))
        return publish(*args)

    monkeypatch.setattr(s.db, "publish", late)
    assert s.execute("INSERT INTO t (v) VALUES (2);").message == "INSERT 1"
    assert rows(s, "SELECT * FROM t;") == [(1, 1), (2, 2)]


def test_commit_files_are_whole_or_absent(s, monkeypatch):
    s.execute("CREATE TABLE t (id INT);")
    s.execute("INSERT INTO t VALUES (1);")
    files, head = s.db.files, f"{s.db.path}/commits/{s.db.head():020d}.json"
    assert not files.create(head, {"other": 1}) and "other" not in files.read(head)  # a taken name stays as it is
    # a writer that dies while it writes leaves a file aside, which nobody reads
    with open(f"{s.db.path}/commits/.{s.db.head() + 1:020d}.json.dead", "w") as f:
        f.write('{"ts": ')
    other = Session(s.spark, s.root)
    assert rows(other, "SELECT * FROM t;") == [(1,)] and other.execute("INSERT INTO t VALUES (2);").message == "INSERT 1"
    assert rows(s, "SELECT * FROM t;") == [(1,), (2,)]


def test_row_ids_are_never_shared(s):
    s.execute("CREATE TABLE t (id INT);")
    s.register("many", s.spark.range(0, 5000, 1, 7))
    for _ in range(3):
        s.execute("INSERT INTO t SELECT id FROM many;")
    df = s.db.log("t")
    assert df.select("_rid").distinct().count() == df.count() == 15000


def test_deep_cascades(s):
    s.execute("CREATE TABLE t (id INT PRIMARY KEY, up INT REFERENCES t (id) ON DELETE CASCADE);")
    s.execute("INSERT INTO t VALUES " + ", ".join(f"({i}, {i - 1 if i else 'NULL'})" for i in range(40)) + ";")
    assert s.execute("DELETE FROM t WHERE id = 0;").message == "DELETE 1"
    assert rows(s, "SELECT * FROM t;") == []


def test_alter_table(s):
    s.execute("CREATE TABLE t (id INT PRIMARY KEY, v INT, CHECK (v > 0));")
    s.execute("INSERT INTO t VALUES (1, 10);")
    then = s.db.commits()[s.db.head()]["ts"]
    s.execute("CHECKPOINT;")
    s.execute("3ADEL GADWAL t ADAF 3AMOD w GOMLA EFRADY 'x';")
    s.execute("ALTER TABLE t RENAME id TO k;")
    s.execute("INSERT INTO t VALUES (2, 20, 'y');")
    assert rows(s, "SELECT * FROM t;") == [(1, 10, "x"), (2, 20, "y")]
    s.execute("ALTER TABLE t DROP COLUMN w;")
    s.execute("ALTER TABLE t ADD w INT;")
    assert rows(s, "SELECT * FROM t WHERE w IS NULL;") == [(1, 10, None), (2, 20, None)]  # not the dropped column's values
    assert rows(s, f"SELECT k, v FROM t AS OF {then};") == [(1, 10)]
    s.execute("CHECKPOINT;")
    assert len(rows(Session(s.spark, s.root), "SELECT * FROM t;")) == 2
    for bad in ("DROP COLUMN k", "DROP COLUMN v", "RENAME v TO k", "ADD k INT", "DROP nobody", "ADD z INT NOT NULL"):
        with pytest.raises(ExecutionError):
            s.execute(f"ALTER TABLE t {bad};")


def test_views_indexes_and_upkeep(s):
    s.execute("CREATE TABLE t (a INT, b INT, c STRING);")
    s.execute("INSERT INTO t VALUES (1, 1, 'x'), (1, 2, 'x'), (2, 1, NULL);")
    then = s.db.commits()[s.db.head()]["ts"]
    s.execute("CREATE VIEW v AS SELECT a, b FROM t WHERE a = 1;")
    s.execute("CREATE UNIQUE INDEX i ON t (a, b);")
    s.execute("CREATE UNIQUE INDEX j ON t (a) WHERE c = 'y';")
    with pytest.raises(ExecutionError):
        s.execute("CREATE UNIQUE INDEX k ON t (a);")
    with pytest.raises(ExecutionError):
        s.execute("INSERT INTO t VALUES (1, 2, 'z');")
    s.execute("INSERT INTO t VALUES (1, 3, 'y');")
    with pytest.raises(ExecutionError):
        s.execute("INSERT INTO t VALUES (1, 4, 'y');")
    assert rows(s, "SELECT * FROM v;") == [(1, 1), (1, 2), (1, 3)]
    assert rows(s, f"SELECT * FROM v AS OF {then};") == [(1, 1), (1, 2)]
    assert [r["Nulls"] for r in s.sql("ANALYZE TABLE t;").collect()] == [0, 0, 1]
    s.execute("UPDATE t SET b = b * 2 + a - 1, c = 'q' WHERE a = 1;")
    assert rows(s, "SELECT b FROM t WHERE c = 'q';") == [(2,), (4,), (6,)]
    s.execute("TRUNCATE TABLE t;")
    assert rows(s, "SELECT * FROM v;") == [] and s.sql("PRAGMA reject_empty_strings = TRUE;").first()[1] == "true"
    s.execute("DROP VIEW v;")
    s.execute("DROP TABLE t;")
    s.execute("CREATE TABLE t (a INT);")
    assert s.execute("VACUUM;").message == "VACUUM 1" and s.execute("VACUUM t;").message == "VACUUM 0"
    s.db.vacuum(older_ms=0)
    s.execute("INSERT INTO t VALUES (3);")
    s.db.vacuum(older_ms=0)
    assert rows(s, "SELECT * FROM t;") == [(3,)]


def test_commits_are_compacted(s, monkeypatch):
    from epochsql.sources import changelog

    monkeypatch.setattr(changelog, "COMPACT_EVERY", 3)
    s.execute("CREATE TABLE t (a INT);")
    for i in range(7):
        s.execute(f"INSERT INTO t VALUES ({i});")
    other, read = Session(s.spark, s.root), []
    inner = other.db.files.read
    monkeypatch.setattr(other.db.files, "read", lambda p: read.append(p) or inner(p))
    other.db._commits.clear()
    assert other.db.head() == 7 and len(read) == 2
    assert len(rows(other, "SELECT * FROM t;")) == 7


def test_server_asks_for_a_login(s):
    import socket
    import threading

    from epochsql.server import serve

    with serve(lambda: Session(s.spark, s.root, user="", authenticated=False), port=0) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        with socket.create_connection(server.server_address, timeout=60) as c, c.makefile("rwb") as f:

            def ask(mode, text):
                f.write(mode + struct.pack(">I", len(text)) + text)
                f.flush()
                return f.read(struct.unpack(">I", f.read(4))[0])

            assert ask(b"Q", b"SHOW TABLES;").startswith(b"ERROR")
            assert ask(b"L", b"root nonsense;").startswith(b"ERROR") and ask(b"L", b"root root;").startswith(b"LOGIN OK")
            assert b'"success": true' in ask(b"J", b"WHOAMI;")
        server.shutdown()
