"""Databases of versioned tables on plain parquet.

    <db>/tables/<t>.json               schema and constraints
    <db>/views/<v>.json                the SELECT behind a view
    <db>/data/<t>/<key>/<uuid>         changes of one statement (parquet); the key is made when the table is created
    <db>/commits/<20-digit n>.json     what commit n made visible: time, and for each table its paths and record counts
    <db>/commits/_upto-<n>.json        all commits up to n in one file
    <db>/snapshots/<t>/<key>/<n>       all rows of a table after commit n

A commit is one exclusively created file, so all its changes appear at once or never. Changes without a commit file
don't exist for readers. A reader picks its paths from the commit files: time travel prunes whole files.

A column keeps the name that it has in files (its field) for good: renaming changes the table's description alone, a
dropped column is no longer read, an added one is null in older files.
"""

from __future__ import annotations

import random
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import temporal
from .files import Files

TYPES = {"INT": T.IntegerType(), "DECIMAL": T.DoubleType(), "STRING": T.StringType(), "BOOL": T.BooleanType(), "DATE": T.TimestampNTZType()}
#: Which statement made a row, and which row of that statement it is: no two rows ever share it.
ROW_ID = T.StructType([T.StructField("statement", T.LongType()), T.StructField("n", T.LongType())])
COMPACT_EVERY = 256
DAY_MS = 24 * 3600 * 1000


class StoreError(ValueError):
    pass


class Conflict(StoreError):
    pass


@dataclass
class Meta:
    name: str
    columns: list[dict]
    foreign_keys: list[dict] = field(default_factory=list)
    checks: list[str] = field(default_factory=list)
    indexes: dict[str, dict] = field(default_factory=dict)
    key: str = ""
    made: int = 0  # columns ever made

    @property
    def row_type(self) -> T.StructType:
        return T.StructType([T.StructField(c["name"], TYPES[c["kind"]]) for c in self.columns])

    @property
    def stored_type(self) -> T.StructType:
        return T.StructType([T.StructField(c.get("field") or c["name"], TYPES[c["kind"]]) for c in self.columns])

    @property
    def log_type(self) -> T.StructType:
        r = self.stored_type
        return T.StructType([T.StructField("_rid", ROW_ID), T.StructField("_seq", T.LongType()), T.StructField("_op", T.StringType()), T.StructField("row", r), T.StructField("pre", r)])

    @property
    def names(self) -> list[str]:
        return [c["name"] for c in self.columns]

    @property
    def primary(self) -> list[str]:
        return [c["name"] for c in self.columns if c["primary"]]

    @property
    def keys(self) -> list[tuple[list[str], str | None]]:
        """Sets of columns whose values are unique, each with the predicate of the rows that it holds for."""
        single = [([c["name"]], None) for c in self.columns if c["unique"] and [c["name"]] != self.primary]
        return [(self.primary, None)] * bool(self.primary) + single + [(x["columns"], x["where"]) for x in self.indexes.values() if x["unique"]]


class Database:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark)
        self._commits: dict[int, dict] = {}
        self._last = 0

    # -- catalog

    def tables(self) -> list[str]:
        return [n[:-5] for n in self.files.names(f"{self.path}/tables") if n.endswith(".json")]

    def meta(self, table: str) -> Meta:
        path = f"{self.path}/tables/{table}.json"
        if not self.files.exists(path):
            raise StoreError(f"Table not found: {table}")
        return Meta(**self.files.read(path))

    def create(self, meta: Meta) -> None:
        meta.key, meta.made = uuid.uuid4().hex, len(meta.columns)
        if not self.files.create(f"{self.path}/tables/{meta.name}.json", meta.__dict__):
            raise StoreError(f"Table already exists: {meta.name}")

    def save(self, meta: Meta) -> None:
        self.files.write(f"{self.path}/tables/{meta.name}.json", meta.__dict__)

    def drop(self, table: str) -> None:
        """The name is free again; a new table of that name has another key and doesn't see the old one's changes."""
        self.meta(table)
        self.files.delete(f"{self.path}/tables/{table}.json")

    def views(self) -> list[str]:
        return [n[:-5] for n in self.files.names(f"{self.path}/views") if n.endswith(".json")]

    def view(self, name: str) -> str | None:
        path = f"{self.path}/views/{name}.json"
        return self.files.read(path)["select"] if self.files.exists(path) else None

    # -- commits

    def commits(self) -> dict[int, dict]:
        names = self.files.names(f"{self.path}/commits")
        whole = [n for n in names if n.startswith("_upto-")]
        if whole and int(whole[-1][6:-5]) not in self._commits:
            self._commits |= {int(k): v for k, v in self.files.read(f"{self.path}/commits/{whole[-1]}").items()}
        for n in names:
            if n[0] != "_" and n.endswith(".json") and int(n[:-5]) not in self._commits:
                self._commits[int(n[:-5])] = self.files.read(f"{self.path}/commits/{n}")
        self._last = max(self._last, self._commits[max(self._commits)]["ts"] if self._commits else 0)
        return self._commits

    def compact(self) -> None:
        """All commits so far in one file, so that a new session reads one file and not one for each commit."""
        if known := self.commits():
            self.files.create(f"{self.path}/commits/_upto-{max(known):020d}.json", known)

    def head(self) -> int:
        return max(self.commits(), default=0)

    def tick(self) -> int:
        """Microseconds, never the same twice and never behind the last commit that was read."""
        self._last = max(time.time_ns() // 1000, self._last + 1)
        return self._last

    def commit_at(self, ts: int) -> int:
        return max((n for n, c in self.commits().items() if c["ts"] <= ts), default=0)

    def publish(self, changes: dict[str, list[tuple[str, int, bool]]], started: int, read: set[str] = frozenset()) -> int:
        """Makes staged changes visible: {table: [(path, records, only inserts)]}.

        Fails if another commit has meanwhile changed a table that this one updates or deletes from, or one of ``read``:
        the tables that constraints of this commit were checked against.
        """
        while True:
            n = self.head() + 1
            for k in range(started + 1, n):
                touched = self._commits[k]["tables"].keys()
                for t in touched:
                    if t in read or t in changes and not all(only for *_, only in changes[t]):
                        raise Conflict(f"table {t} has been changed by commit {k}")
            for t, staged in changes.items():
                folder = self.folder(self.meta(t))
                if not all(p.startswith(folder) for p, *_ in staged):
                    raise Conflict(f"table {t} has been dropped meanwhile")
            entry = {"ts": self.tick(), "tables": {t: {"paths": [p for p, *_ in s], "records": sum(r for _, r, _ in s)} for t, s in changes.items()}}
            if self.files.create(f"{self.path}/commits/{n:020d}.json", entry):
                if n % COMPACT_EVERY == 0:
                    self.compact()
                return n

    def folder(self, meta: Meta) -> str:
        return f"{self.path}/data/{meta.name}/{meta.key}/"

    def stage(self, table: str, changes: DataFrame, inserts: bool = False) -> tuple[str, int, DataFrame]:
        """Writes (_rid, _op, row, pre) as a change file: its path, its number of records, and the changes as written.

        With ``inserts`` the rows are new (columns of the table) and get their identities here: the statement's number
        and the row's number in the file.
        """
        meta, now = self.meta(table), self.tick()
        path = f"{self.folder(meta)}{uuid.uuid4().hex}"
        if inserts:
            rid = F.struct(F.lit(now << 11 | random.getrandbits(11)).cast("long").alias("statement"), F.monotonically_increasing_id().alias("n"))
            changes = changes.select(rid.alias("_rid"), F.lit("I").alias("_op"), F.struct(*meta.names).alias("row"), F.lit(None).cast(meta.row_type).alias("pre"))
        out = changes.select("_rid", F.lit(now).cast("long").alias("_seq"), "_op", F.col("row").cast(meta.stored_type).alias("row"), F.col("pre").cast(meta.stored_type).alias("pre"))
        out.write.parquet(path)
        back = self._read(meta, path)
        return path, back.count(), back

    # -- reading

    def _read(self, meta: Meta, *paths: str) -> DataFrame:
        df = self.spark.read.schema(meta.log_type).parquet(*paths)
        return df.select("_rid", "_seq", "_op", F.col("row").cast(meta.row_type).alias("row"), F.col("pre").cast(meta.row_type).alias("pre"))

    def log(self, table: str, after: int = 0, until: int | None = None, staged: list[str] | None = None) -> DataFrame:
        """The changes of commits after < n <= until, and staged ones."""
        meta = self.meta(table)
        folder = self.folder(meta)
        paths = [p for n, c in sorted(self.commits().items()) if after < n and (until is None or n <= until) and table in c["tables"] for p in c["tables"][table]["paths"] if p.startswith(folder)]
        paths += staged or []
        if not paths:
            empty = T.StructType([*meta.log_type.fields[:3], T.StructField("row", meta.row_type), T.StructField("pre", meta.row_type)])
            return self.spark.createDataFrame([], empty)
        return self._read(meta, *paths)

    def records(self, table: str, after: int, until: int) -> int:
        return sum(c["tables"][table]["records"] for n, c in self.commits().items() if after < n <= until and table in c["tables"])

    def snapshot_before(self, table: str, n: int) -> int:
        folder = f"{self.path}/snapshots/{table}/{self.meta(table).key}"
        return max((int(x) for x in self.files.names(folder) if int(x) <= n and self.files.exists(f"{folder}/{x}/_SUCCESS")), default=0)

    def rows(self, table: str, until: int | None = None, staged: list[str] | None = None) -> DataFrame:
        """_rid and row after commit ``until``, by forward replay from the last snapshot before it."""
        until = self.head() if until is None else until
        k, meta = self.snapshot_before(table, until), self.meta(table)
        log = self.log(table, k, until, staged)
        if k:
            kind = T.StructType([meta.log_type["_rid"], meta.log_type["row"]])
            snap = self.spark.read.schema(kind).parquet(f"{self.path}/snapshots/{table}/{meta.key}/{k}")
            nothing = F.lit(None).cast(meta.row_type)
            log = log.unionByName(snap.select("_rid", F.lit(-1).cast("long").alias("_seq"), F.lit("I").alias("_op"), F.col("row").cast(meta.row_type).alias("row"), nothing.alias("pre")))
        return temporal.forward(log, F.lit(True))

    def as_of(self, table: str, ts: int, strategy: str = "auto") -> DataFrame:
        """_rid and row as they were at ``ts`` (changes committed at ts included)."""
        n, head = self.commit_at(ts), self.head()
        if strategy == "auto":
            k = self.snapshot_before(table, n)
            strategy = temporal.choose(self.records(table, k, n), self.records(table, n, head) + self.records(table, self.snapshot_before(table, head), head))
        if strategy == "forward":
            return self.rows(table, n)
        return temporal.reverse(self.rows(table), self.log(table, n), F.lit(True))

    def checkpoint(self) -> int:
        """Writes a snapshot of every table; later reads start from it. The commits so far become one file."""
        n = self.head()
        for t in self.tables():
            if n and self.snapshot_before(t, n) < n:
                meta = self.meta(t)
                self.rows(t, n).select("_rid", F.col("row").cast(meta.stored_type).alias("row")).write.mode("overwrite").parquet(f"{self.path}/snapshots/{t}/{meta.key}/{n}")
        self.compact()
        return n

    def vacuum(self, table: str | None = None, older_ms: int = DAY_MS) -> int:
        """Deletes what no reader can reach: data and snapshots of dropped tables, and change files that no commit names
        (rolled back or failed) once they are older than any open transaction can be. Returns the folders deleted."""
        named = {p for c in self.commits().values() for x in c["tables"].values() for p in x["paths"]}
        live, gone = {t: self.meta(t).key for t in self.tables()}, []
        for t in [table] if table else self.files.names(f"{self.path}/data"):
            for key in self.files.names(f"{self.path}/data/{t}"):
                folder = f"{self.path}/data/{t}/{key}"
                if live.get(t) != key:
                    gone += [folder, f"{self.path}/snapshots/{t}/{key}"]
                else:
                    gone += [p for x in self.files.names(folder) if (p := f"{folder}/{x}") not in named and self.files.age_ms(p) >= older_ms]
        gone = [p for p in gone if self.files.exists(p)]
        for p in gone:
            self.files.delete(p)
        return len(gone)
