"""A session runs statements: reads become DataFrames, writes become staged changes and commits."""

from __future__ import annotations

import re
import tempfile
import uuid
from dataclasses import dataclass, field, replace
from datetime import UTC, datetime
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.format import as_binary, as_json, as_text
from ..functions.timeparse import format_micros, parse_moment
from ..lang import ast as A
from ..lang import parse
from ..lang.parser import Parser
from ..operators import constraints as C
from ..operators import temporal
from ..plans.predicates import compile_predicate, resolver
from ..plans.select import build
from ..sources.changelog import Conflict, Database, Meta, StoreError
from .auth import AuthError, Users, allowed

RESERVED_DATABASES = ("system",)
FUTURE_SLACK = 60_000_000
#: How often a statement is run anew because another session's commit came between.
RETRIES = 8
SETTINGS = ("reject_empty_strings",)


class ExecutionError(ValueError):
    pass


@dataclass
class Result:
    """Either rows (``df``) or a status line (``message``)."""

    df: DataFrame | None = None
    message: str | None = None

    def text(self) -> str:
        return as_text(self.df if self.df is not None else self.message or "")

    def json(self) -> str:
        return as_json(self.df if self.df is not None else self.message or "")

    def binary(self) -> bytes:
        return as_binary(self.df if self.df is not None else self.message or "")


@dataclass
class Transaction:
    started: int
    number: int  # 0: of one statement alone
    changes: dict[str, list[tuple[str, int, bool]]] = field(default_factory=dict)
    read: set[str] = field(default_factory=set)  # tables that its constraints were checked against


def _own_folder(spark: SparkSession) -> str:
    """A local folder, for a session without a store of its own. Only where driver and executors are one process."""
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ExecutionError("on a cluster a session needs a store that all executors share")
    return tempfile.mkdtemp(prefix="epochsql-store-")


class Session:
    def __init__(self, spark: SparkSession, root: str | None = None, database: str = "main", user: str = "root", reject_empty_strings: bool = False, authenticated: bool = True):
        self.spark, self.root = spark, (root or _own_folder(spark)).rstrip("/")
        self.users = Users(spark, self.root)
        self.user, self.authenticated = user, authenticated
        self.reject_empty_strings = reject_empty_strings
        self.external: dict[str, DataFrame] = {}
        self.txn: Transaction | None = None
        self._numbers = 0
        self.closed = False
        self.use(database, create=True)

    # -- databases and outside tables

    def use(self, name: str, create: bool = False) -> None:
        path = f"{self.root}/{name}"
        probe = Database(self.spark, path)
        if not probe.files.exists(f"{path}/database.json"):
            if not create:
                raise ExecutionError(f"Database not found: {name}")
            probe.files.write(f"{path}/database.json", {"name": name})
        self.db_name, self.db = name, probe

    def register_parquet(self, name: str, path: str) -> None:
        """A read-only table of this session over parquet files."""
        self.external[name] = self.spark.read.parquet(path)

    def register(self, name: str, df: DataFrame) -> None:
        self.external[name] = df

    # -- entry

    def sql(self, text: str) -> DataFrame:
        out = self.execute(text)
        if out.df is None:
            raise ExecutionError(f"no rows: {out.message}")
        return out.df

    def execute(self, text: str) -> Result:
        tree = parse(text)
        self._authorise(tree)
        handler = {A.Select: self._select, A.Insert: self._insert, A.Update: self._update, A.Delete: self._delete, A.CreateTable: self._create_table, A.CreateIndex: self._create_index, A.AlterTable: self._alter_table, A.CreateView: self._create_view, A.Simple: self._simple}[type(tree)]
        if not (isinstance(tree, (A.Insert, A.Update, A.Delete)) or isinstance(tree, A.Simple) and tree.verb in ("RECOVER", "TRUNCATE")):
            return handler(tree)
        if self.txn is not None:
            try:
                return handler(tree)
            except Exception:
                self._discard()  # an error inside a transaction rolls it back
                raise
        for left in reversed(range(RETRIES)):
            self.txn = Transaction(self.db.head(), 0)
            try:
                out = handler(tree)
                self._commit()
                return out
            except Conflict:
                self._discard()
                if not left:
                    raise
            except Exception:
                self._discard()
                raise
            finally:
                self.txn = None
        raise AssertionError

    def _action(self, tree) -> str:
        if isinstance(tree, A.Simple):
            return "SHOW" if tree.verb.startswith("SHOW") and tree.verb != "SHOW USERS" else tree.verb
        return {A.Select: "SELECT", A.Insert: "INSERT", A.Update: "UPDATE", A.Delete: "DELETE", A.CreateTable: "CREATE TABLE", A.CreateIndex: "CREATE INDEX", A.AlterTable: "ALTER TABLE", A.CreateView: "CREATE VIEW"}[type(tree)]

    @property
    def role(self) -> str:
        return self.users.role(self.user, self.db_name)

    def _authorise(self, tree) -> None:
        if self.closed:
            raise ExecutionError("the session is closed")
        action = self._action(tree)
        if not self.authenticated and action != "LOGIN":
            raise AuthError("log in first")
        if not allowed(self.role, action):
            raise AuthError(f"{self.role} may not {action}")
        if self.db_name in RESERVED_DATABASES and self.role != "SUPERADMIN" and action not in ("SELECT", "SHOW", "WHOAMI", "USE", "LOGIN"):
            raise AuthError(f"database {self.db_name} is reserved")

    # -- reading

    def _staged(self, table: str) -> list[str]:
        return [p for p, *_ in self.txn.changes.get(table, [])] if self.txn else []

    def rows(self, table: str) -> DataFrame:
        """_rid and row, with this transaction's own changes. A transaction reads what was committed at its start."""
        until = self.txn.started if self.txn else None
        return self.db.rows(table, until, self._staged(table))

    def table(self, name: str, as_of=None) -> DataFrame:
        if name in self.external:
            if as_of is not None:
                raise ExecutionError(f"table {name} has no history")
            return self.external[name]
        if (select := self.db.view(name)) is not None:
            tree = parse(select)
            return build(replace(tree, as_of=as_of) if as_of is not None else tree, self.table)
        meta = self.db.meta(name)
        if as_of is None or as_of == "LATEST":
            df = self.rows(name)
        else:
            df = self.db.as_of(name, parse_moment(as_of))
        return df.select(*[F.col(f"row.`{c}`").alias(c) for c in meta.names])

    def _select(self, s: A.Select) -> Result:
        return Result(build(s, self.table))

    # -- writing

    def _commit(self) -> None:
        changes = {t: s for t, s in self.txn.changes.items() if sum(n for _, n, _ in s)}
        if changes:
            self.db.publish(changes, self.txn.started, self.txn.read)

    def _discard(self) -> None:
        """Ends the transaction; its change files, which no commit names, go at once."""
        txn, self.txn = self.txn, None
        for staged in txn.changes.values():
            for path, *_ in staged:
                self.db.files.delete(path)

    def _write(self, table: str, changes: DataFrame, only_inserts: bool = False, check=None) -> tuple[int, DataFrame]:
        """Stages changes as part of the transaction: their number, and the changes as they were written.

        ``check`` sees the written rows before they count as part of the table: what is checked is what is kept.
        """
        path, n, back = self.db.stage(table, changes, only_inserts)
        try:
            if check is not None:
                check(back)
        except Exception:
            self.db.files.delete(path)
            raise
        self.txn.changes.setdefault(table, []).append((path, n, only_inserts))
        return n, back

    def _value(self, column: dict, v):
        kind, name = column["kind"], column["name"]
        if v is None:
            return None
        if v == "" and self.reject_empty_strings:
            raise ExecutionError(f"Column {name} can't be empty")
        try:
            if kind == "INT":
                if isinstance(v, bool) or (isinstance(v, float) and v != int(v)):
                    raise ValueError
                n = int(v)
                if not -(1 << 31) <= n < 1 << 31:
                    raise ValueError
                return n
            if kind == "DECIMAL":
                if isinstance(v, bool):
                    raise ValueError
                return float(v)
            if kind == "BOOL":
                if isinstance(v, str) and v.lower() in ("true", "false"):
                    return v.lower() == "true"
                if v in (0, 1):
                    return bool(v)
                raise ValueError
            if kind == "DATE":
                return datetime.fromtimestamp(0, UTC).replace(tzinfo=None) if v == 0 else datetime.fromisoformat(_iso(v))
            if not isinstance(v, str):
                raise ValueError
            if column["length"] and len(v) > column["length"]:
                raise ExecutionError(f"Value too long for column {name}")
            return v
        except (ValueError, TypeError) as e:
            if isinstance(e, ExecutionError):
                raise
            raise ExecutionError(f"Type mismatch: column {name} is {kind}, value {v!r}") from e

    def _check(self, meta: Meta, new: DataFrame, old: DataFrame | None = None) -> None:
        """new: rows to be written; old: _rid of the rows they replace. One pass answers all row checks, one each key."""
        broken = [(f"NOT NULL violated in {meta.name}: {c['name']}", F.col(f"`{c['name']}`").isNull()) for c in meta.columns if not c["nullable"]]
        for text in [c["check"] for c in meta.columns if c["check"]] + meta.checks:
            broken.append((f"CHECK ({text}) violated in {meta.name}", ~F.coalesce(self._predicate(text, new), F.lit(True))))
        if broken:
            found = new.agg(*[F.bool_or(bad).alias(f"c{i}") for i, (_, bad) in enumerate(broken)]).first()
            for said, bad in zip((m for m, _ in broken), found, strict=True):
                if bad:
                    raise ExecutionError(said)
        live = None
        for key, where in meta.keys:
            if live is None:
                self.txn.read.add(meta.name)
                base = self.rows(meta.name)
                live = (base if old is None else base.join(old, "_rid", "left_anti")).select("row.*")
            a, b = (x if where is None else x.where(self._predicate(where, x)) for x in (new, live))
            if not C.clashes(a, b, key).isEmpty():
                raise ExecutionError(f"Duplicate key {', '.join(key)} in {meta.name}")
        for fk in meta.foreign_keys:
            self.txn.read.add(fk["table"])
            parent = self.table(fk["table"])
            if fk["table"] == meta.name:
                parent = parent.unionByName(new.select(*parent.columns))
            if bad := C.orphans(new, fk["columns"], parent, fk["ref_columns"]).first():
                raise ExecutionError(f"Foreign key violated: {meta.name}({', '.join(fk['columns'])}) has no parent in {fk['table']}: {bad.asDict()}")

    @staticmethod
    def _predicate(text: str, rows: DataFrame):
        return compile_predicate(Parser(text).predicate(), resolver(rows))

    def _insert(self, s: A.Insert) -> Result:
        meta = self.db.meta(s.table)
        by_name = {c["name"]: c for c in meta.columns}
        columns = list(s.columns or meta.names)
        for c in columns:
            if c not in by_name:
                raise ExecutionError(f"Column not found: {c}")
        if s.select is not None:
            got = build(s.select, self.table)
            if len(got.columns) != len(columns):
                raise ExecutionError("Column count mismatch")
            new = got.toDF(*columns)
            new = new.select(*[(F.col(c) if c in columns else F.lit(None)).cast(meta.row_type[c].dataType).alias(c) for c in meta.names])
        else:
            rows = []
            for r in s.rows:
                if len(r) != len(columns):
                    raise ExecutionError("Column count mismatch")
                given = {c: self._value(by_name[c], v.value) for c, v in zip(columns, r, strict=True)}
                rows.append(tuple(given.get(c) for c in meta.names))
            new = self.spark.createDataFrame(rows, meta.row_type).coalesce(1)
        defaults = {c["name"]: F.lit(self._value(c, c["default"])).cast(meta.row_type[c["name"]].dataType) for c in meta.columns if c["default"] is not None and c["name"] not in columns}
        new = C.fill_defaults(new, defaults) if defaults else new
        scratch = None
        for c in meta.columns:
            if c["auto"]:
                self.txn.read.add(s.table)
                top = self.rows(s.table).agg(F.max(f"row.`{c['name']}`")).first()[0] or 0
                if s.select is None:
                    at = meta.names.index(c["name"])
                    given = new.collect()  # the VALUES of one statement
                    top, done = max([top, *(r[at] or 0 for r in given)]), []
                    for r in given:
                        top += r[at] is None
                        done.append(tuple(top if i == at and v is None else v for i, v in enumerate(r)))
                    new = self.spark.createDataFrame(done, meta.row_type)
                else:
                    scratch = f"{self.db.path}/scratch/{uuid.uuid4().hex}"
                    new = C.auto_increment(new, c["name"], top, [n for n in meta.names if n != c["name"]] or meta.names, scratch)
        n, _ = self._write(s.table, new, True, lambda back: self._check(meta, back.select("row.*")))
        if scratch:
            self.db.files.delete(scratch)
        return Result(message=f"INSERT {n}")

    def _matching(self, table: str, where) -> DataFrame:
        flat = self.rows(table).select("_rid", "row", "row.*")
        if where is not None:
            flat = flat.where(compile_predicate(where, resolver(flat)))
        return flat.select("_rid", "row")

    def _children(self, table: str):
        for t in self.db.tables():
            for fk in self.db.meta(t).foreign_keys:
                if fk["table"] == table:
                    yield t, fk

    def _update(self, s: A.Update) -> Result:
        meta = self.db.meta(s.table)
        by_name = {c["name"]: c for c in meta.columns}
        for c, _ in s.sets:
            if c not in by_name:
                raise ExecutionError(f"Column not found: {c}")
        old = self._matching(s.table, s.where)
        at = resolver(old.select("row.*"))
        values = {c: self._set_value(by_name[c], v, at).cast(meta.row_type[c].dataType) for c, v in s.sets}
        new = F.struct(*[values.get(c, F.col(f"row.`{c}`")).alias(c) for c in meta.names])
        changed = old.select("_rid", F.lit("U").alias("_op"), new.alias("row"), F.col("row").alias("pre"))
        n, back = self._write(s.table, changed, check=lambda b: self._check(meta, b.select("row.*"), b.select("_rid")))
        self._follow(s.table, back, "UPDATE", set(values))
        return Result(message=f"UPDATE {n}")

    def _set_value(self, column: dict, v, at):
        """A new value: a literal of the column's type, or arithmetic over the row's old values."""
        if isinstance(v, A.Lit):
            return F.lit(self._value(column, v.value))
        if column["kind"] not in ("INT", "DECIMAL") and not isinstance(v, A.Col):
            raise ExecutionError(f"Type mismatch: column {column['name']} is {column['kind']}, the value is a number")

        def number(x):
            if isinstance(x, A.Col):
                at(x)  # an unknown column is an error here
                return F.col(f"row.`{x.name.split('.')[-1]}`")
            if isinstance(x, A.Lit):
                return F.lit(x.value)
            a, b = number(x.left), number(x.right)
            return {"+": a + b, "-": a - b, "*": a * b, "/": a / b}[x.op]

        return number(v)

    def _follow(self, table: str, changed: DataFrame, event: str, columns: set[str]) -> None:
        """Carries changes of parents' rows (pre -> row; row is null for deletes) to all tables below.

        Each level is staged before the next one is looked for, so plans don't grow with the depth, and rows that are gone
        already aren't found again: the work ends where no level has rows left.
        """
        todo = [(table, changed, event, columns)]
        while todo:
            table, changed, event, columns = todo.pop()
            for child, fk in self._children(table):
                if event == "UPDATE" and not set(fk["ref_columns"]) & columns:
                    continue
                self.txn.read |= {child, table}
                todo += self._follow_one(child, fk, changed, event)

    def _follow_one(self, child: str, fk: dict, changed: DataFrame, event: str) -> list[tuple[str, DataFrame, str, set[str]]]:
        action = fk["on_delete"] if event == "DELETE" else fk["on_update"]
        keys = changed.select(*[F.col(f"pre.`{r}`").alias(f"__k{i}") for i, r in enumerate(fk["ref_columns"])], *[F.col(f"row.`{r}`").alias(f"__n{i}") for i, r in enumerate(fk["ref_columns"])])
        moved = F.lit(event == "DELETE")
        for i in range(len(fk["columns"])):
            moved = moved | ~F.col(f"__k{i}").eqNullSafe(F.col(f"__n{i}"))
        keys = keys.where(moved)
        on = None
        for i, c in enumerate(fk["columns"]):
            one = F.col(f"row.`{c}`") == F.col(f"__k{i}")
            on = one if on is None else on & one
        hit = self.rows(child).join(keys, on)
        meta = self.db.meta(child)
        if action in ("RESTRICT", "NO ACTION"):
            if not hit.isEmpty():
                raise ExecutionError(f"Foreign key violated: {child} refers to rows of {fk['table']}")
            return []
        if action == "CASCADE" and event == "DELETE":
            gone = hit.select("_rid", F.lit("D").alias("_op"), F.lit(None).cast(meta.row_type).alias("row"), F.col("row").alias("pre")).dropDuplicates(["_rid"])
            n, back = self._write(child, gone)
            return [(child, back, "DELETE", set())] * bool(n)
        defaults = {c["name"]: c["default"] for c in meta.columns}
        to = {}
        for i, c in enumerate(fk["columns"]):
            v = F.col(f"__n{i}") if action == "CASCADE" else F.lit(defaults[c] if action == "SET DEFAULT" else None)
            to[c] = v.cast(meta.row_type[c].dataType)
        new = F.struct(*[to.get(c, F.col(f"row.`{c}`")).alias(c) for c in meta.names])
        moved_rows = hit.select("_rid", F.lit("U").alias("_op"), new.alias("row"), F.col("row").alias("pre"))

        def fits(back: DataFrame) -> None:
            if bad := C.not_null(back.select("row.*"), [c["name"] for c in meta.columns if not c["nullable"]]).first():
                raise ExecutionError(f"NOT NULL violated in {child}: {bad.asDict()}")

        n, back = self._write(child, moved_rows, check=fits)
        return [(child, back, "UPDATE", set(to))] * bool(n)

    def _delete(self, s: A.Delete) -> Result:
        meta = self.db.meta(s.table)
        gone = self._matching(s.table, s.where).select("_rid", F.lit("D").alias("_op"), F.lit(None).cast(meta.row_type).alias("row"), F.col("row").alias("pre"))
        n, back = self._write(s.table, gone)
        self._follow(s.table, back, "DELETE", set())
        return Result(message=f"DELETE {n}")

    # -- DDL

    @staticmethod
    def _column(c: A.ColumnDef) -> dict:
        return {"name": c.name, "kind": c.kind, "length": c.length, "primary": c.primary, "nullable": c.nullable, "unique": c.unique, "auto": c.auto, "default": c.default.value if c.default else None, "check": c.check_text}

    def _create_table(self, s: A.CreateTable) -> Result:
        names = [c.name for c in s.columns]
        if not names:
            raise ExecutionError("a table needs a column")
        if len(set(names)) < len(names):
            raise ExecutionError("Duplicate column name")
        for fk in s.foreign_keys:
            target = names if fk.table == s.name else self.db.meta(fk.table).names
            if len(fk.columns) != len(fk.ref_columns) or set(fk.columns) - set(names) or set(fk.ref_columns) - set(target):
                raise ExecutionError(f"Foreign key doesn't fit {fk.table}")
        columns = [self._column(c) for c in s.columns]
        keys = [{"columns": list(f.columns), "table": f.table, "ref_columns": list(f.ref_columns), "on_delete": f.on_delete, "on_update": f.on_update} for f in s.foreign_keys]
        self.db.create(Meta(s.name, columns, keys, [t for t, _ in s.checks]))
        return Result(message="CREATE TABLE SUCCESS")

    def _create_index(self, s: A.CreateIndex) -> Result:
        """An index is a name for columns: parquet statistics do the work, and answers never depend on it. A unique one is
        a constraint as well, with WHERE on the rows that the predicate holds for."""
        meta = self.db.meta(s.table)
        for c in s.columns:
            if c not in meta.names:
                raise ExecutionError(f"Column not found: {c}")
        if any(s.name in self.db.meta(t).indexes for t in self.db.tables()):
            raise ExecutionError(f"Index already exists: {s.name}")
        if s.unique or s.where:
            rows = self.table(s.table)
            rows = rows.where(self._predicate(s.where, rows)) if s.where else rows
            if s.unique and not C.duplicates(rows, list(s.columns)).isEmpty():
                raise ExecutionError(f"Duplicate key {', '.join(s.columns)} in {s.table}")
        meta.indexes[s.name] = {"columns": list(s.columns), "unique": s.unique, "where": s.where}
        self.db.save(meta)
        return Result(message="CREATE INDEX SUCCESS")

    def _alter_table(self, s: A.AlterTable) -> Result:
        """Columns are added, dropped and renamed in the table's description; no file is rewritten."""
        if self.txn:
            raise ExecutionError("ALTER TABLE can't run inside a transaction")
        meta = self.db.meta(s.table)
        by_name = {c["name"]: c for c in meta.columns}
        if s.action != "ADD" and s.name not in by_name:
            raise ExecutionError(f"Column not found: {s.name}")
        new = s.column.name if s.action == "ADD" else s.to
        if s.action != "DROP" and new in by_name:
            raise ExecutionError(f"Column already exists: {new}")
        if s.action == "RENAME":
            c = by_name[s.name]
            c["field"], c["name"] = c.get("field") or c["name"], s.to
            if any(s.name in text for text in meta.checks + [x["check"] or "" for x in meta.columns] + [x["where"] or "" for x in meta.indexes.values()]):
                raise ExecutionError(f"Column {s.name} stands in a check or a partial index")
            for keys in [x["columns"] for x in meta.indexes.values()] + [fk["columns"] for fk in meta.foreign_keys]:
                keys[:] = [s.to if k == s.name else k for k in keys]
            for t, _ in self._children(s.table):
                child = meta if t == s.table else self.db.meta(t)
                for fk in child.foreign_keys:
                    if fk["table"] == s.table:
                        fk["ref_columns"] = [s.to if k == s.name else k for k in fk["ref_columns"]]
                self.db.save(child)
        elif s.action == "DROP":
            c = by_name[s.name]
            if len(meta.columns) == 1:
                raise ExecutionError("Cannot drop the only column in a table")
            used = [x["columns"] for x in meta.indexes.values()] + [fk["columns"] for fk in meta.foreign_keys] + [fk["ref_columns"] for _, fk in self._children(s.table)]
            if c["primary"] or any(s.name in k for k in used) or any(s.name in text for text in meta.checks):
                raise ExecutionError(f"Column {s.name} is part of a key, an index or a check")
            meta.columns.remove(c)
        else:
            c = self._column(s.column)
            if c["primary"] or c["auto"]:
                raise ExecutionError("a key can't be added to a table")
            if not c["nullable"] and c["default"] is None and not self.rows(s.table).isEmpty():
                raise ExecutionError(f"Column {c['name']} is NOT NULL and needs a default")
            meta.made += 1
            meta.columns.append(c | {"field": f"{c['name']}~{meta.made}"})
        self.db.save(meta)
        if s.action == "ADD" and c["default"] is not None:
            self.execute(f"UPDATE {s.table} SET {c['name']} = {_literal_text(c['default'])};")
        return Result(message="ALTER TABLE SUCCESS")

    def _create_view(self, s: A.CreateView) -> Result:
        build(parse(s.select), self.table)  # names and types must resolve
        if s.name in self.db.tables() or s.name in self.external or not self.db.files.create(f"{self.db.path}/views/{s.name}.json", {"select": s.select}):
            raise ExecutionError(f"Table already exists: {s.name}")
        return Result(message="CREATE VIEW SUCCESS")

    def _frame(self, names: list[str], rows: list[tuple]) -> Result:
        return Result(self.spark.createDataFrame(rows, T.StructType([T.StructField(n, T.StringType()) for n in names])))

    def describe(self, table: str) -> Result:
        if table in self.external:
            return self._frame(["Column", "Type", "Nullable", "Key", "Default", "Extra"], [(f.name, f.dataType.simpleString().upper(), "YES" if f.nullable else "NO", "", "", "") for f in self.external[table].schema])
        key = lambda c: "PRI" if c["primary"] else "UNI" if c["unique"] else ""
        rows = [(c["name"], _type_name(c), "YES" if c["nullable"] else "NO", key(c), "" if c["default"] is None else str(c["default"]), "auto_increment" if c["auto"] else "") for c in self.db.meta(table).columns]
        return self._frame(["Column", "Type", "Nullable", "Key", "Default", "Extra"], rows)

    def show_create(self, table: str) -> Result:
        meta = self.db.meta(table)
        parts = []
        for c in meta.columns:
            words = [f"`{c['name']}`", _type_name(c)] + ["NOT NULL"] * (not c["nullable"]) + ["AUTO_INCREMENT"] * c["auto"] + ([f"DEFAULT {c['default']!r}"] if c["default"] is not None else []) + ["UNIQUE"] * (c["unique"] and not c["primary"]) + ([f"CHECK ({c['check']})"] if c["check"] else [])
            parts.append("  " + " ".join(words))
        quoted = lambda names: ", ".join(f"`{n}`" for n in names)
        parts += [f"  PRIMARY KEY ({quoted(meta.primary)})"] * bool(meta.primary)
        parts += [f"  CHECK ({c})" for c in meta.checks]
        parts += [f"  FOREIGN KEY ({quoted(f['columns'])}) REFERENCES `{f['table']}` ({quoted(f['ref_columns'])}) ON DELETE {f['on_delete']} ON UPDATE {f['on_update']}" for f in meta.foreign_keys]
        return self._frame(["Table", "Create Table"], [(table, f"CREATE TABLE `{table}` (\n" + ",\n".join(parts) + "\n);")])

    # -- everything else

    def _simple(self, s: A.Simple) -> Result:
        return getattr(self, "_do_" + s.verb.lower().replace(" ", "_"))(*s.args)

    def _do_drop_table(self, table: str) -> Result:
        if users := sorted({t for t, _ in self._children(table)} - {table}):
            raise ExecutionError(f"Table {table} is referred to by {', '.join(users)}")
        self.db.drop(table)
        return Result(message="DROP TABLE SUCCESS")

    def _do_drop_index(self, name: str) -> Result:
        for t in self.db.tables():
            meta = self.db.meta(t)
            if name in meta.indexes:
                del meta.indexes[name]
                self.db.save(meta)
                return Result(message="DROP INDEX SUCCESS")
        raise ExecutionError(f"Index not found: {name}")

    def _do_begin(self) -> Result:
        if self.txn:
            raise ExecutionError("a transaction is open already")
        self._numbers += 1
        self.txn = Transaction(self.db.head(), self._numbers)
        return Result(message=f"BEGIN TRANSACTION {self._numbers}")

    def _do_commit(self) -> Result:
        if not self.txn:
            raise ExecutionError("no transaction is open")
        try:
            self._commit()
        except Exception:
            self._discard()
            raise
        self.txn = None
        return Result(message="COMMIT SUCCESS")

    def _do_rollback(self) -> Result:
        if not self.txn:
            raise ExecutionError("no transaction is open")
        self._discard()
        return Result(message="ROLLBACK SUCCESS")

    def _do_checkpoint(self) -> Result:
        self.db.checkpoint()
        return Result(message="CHECKPOINT SUCCESS")

    def _do_recover(self, moment) -> Result:
        """A commit that turns every table into what it was: it is a change like any other and can be undone."""
        if self.txn.number:
            raise ExecutionError("RECOVER can't run inside a transaction")
        if moment == "LATEST":
            return Result(message="RECOVER SUCCESS")
        ts = parse_moment(moment)
        if ts <= 0:
            raise ExecutionError("no point in time")
        if ts > self.db.tick() + FUTURE_SLACK:
            raise ExecutionError("can't recover to the future")
        for t in self.db.tables():
            self._write(t, temporal.diff(self.rows(t), self.db.as_of(t, ts)))
        return Result(message=f"RECOVER SUCCESS: {format_micros(ts)}")

    def _do_truncate(self, table: str) -> Result:
        self._delete(A.Delete(table, None))
        return Result(message="TRUNCATE TABLE SUCCESS")

    def _do_drop_view(self, name: str) -> Result:
        if self.db.view(name) is None:
            raise ExecutionError(f"View not found: {name}")
        self.db.files.delete(f"{self.db.path}/views/{name}.json")
        return Result(message="DROP VIEW SUCCESS")

    def _do_analyze(self, table: str) -> Result:
        """A row per column, from one pass over the table. Distinct values are estimated (HyperLogLog++)."""
        df = self.table(table)
        each = [x for i, c in enumerate(df.columns) for x in (F.count(F.col(f"`{c}`")).alias(f"n{i}"), F.approx_count_distinct(f"`{c}`", 0.01).alias(f"d{i}"), F.min(f"`{c}`").cast("string").alias(f"a{i}"), F.max(f"`{c}`").cast("string").alias(f"b{i}"))]
        one = df.agg(F.count(F.lit(1)).alias("rows"), *each)
        rows = F.array(*[F.struct(F.lit(c).alias("Column"), F.col("rows").alias("Rows"), (F.col("rows") - F.col(f"n{i}")).alias("Nulls"), F.col(f"d{i}").alias("Distinct"), F.col(f"a{i}").alias("Min"), F.col(f"b{i}").alias("Max")) for i, c in enumerate(df.columns)])
        return Result(one.select(F.inline(rows)))

    def _do_pragma(self, name: str, value) -> Result:
        if name not in SETTINGS:
            raise ExecutionError(f"Unknown setting: {name}")
        if value is not None:
            setattr(self, name, bool(value))
        return self._frame(["Variable", "Value"], [(name, str(getattr(self, name)).lower())])

    def _do_vacuum(self, table: str | None) -> Result:
        return Result(message=f"VACUUM {self.db.vacuum(table)}")

    def _do_use(self, name: str) -> Result:
        if self.users.role(self.user, name) == "DENIED":
            raise AuthError(f"no access to database {name}")
        if self.txn:
            raise ExecutionError("end the transaction first")
        self.use(name)
        return Result(message=f"Database changed to {name}")

    def _do_create_database(self, name: str) -> Result:
        if name in RESERVED_DATABASES or self.db.files.exists(f"{self.root}/{name}/database.json"):
            raise ExecutionError(f"Database exists or is reserved: {name}")
        self.db.files.write(f"{self.root}/{name}/database.json", {"name": name})
        return Result(message="CREATE DATABASE SUCCESS")

    def _do_drop_database(self, name: str) -> Result:
        if name == self.db_name or name in RESERVED_DATABASES:
            raise ExecutionError(f"Database can't be dropped: {name}")
        if not self.db.files.exists(f"{self.root}/{name}/database.json"):
            raise ExecutionError(f"Database not found: {name}")
        self.db.files.delete(f"{self.root}/{name}")
        return Result(message="DROP DATABASE SUCCESS")

    def _do_create_user(self, name: str, password: str, role: str) -> Result:
        self.users.create(name, password, role, self.db_name)
        return Result(message="CREATE USER SUCCESS")

    def _do_alter_user(self, name: str, role: str, db: str | None) -> Result:
        self.users.alter(name, role, db or self.db_name)
        return Result(message="ALTER USER SUCCESS")

    def _do_drop_user(self, name: str) -> Result:
        self.users.drop(name)
        return Result(message="DROP USER SUCCESS")

    def _do_login(self, name: str, password: str) -> Result:
        if not self.users.login(name, password):
            raise AuthError("wrong user or password")
        self.user, self.authenticated = name, True
        return Result(message=f"LOGIN OK: {name}")

    def _do_whoami(self) -> Result:
        return self._frame(["Current User", "Current DB", "Role"], [(self.user, self.db_name, self.role)])

    def _do_show_status(self) -> Result:
        return self._frame(["Variable", "Value"], [("Current User", self.user), ("Current Database", self.db_name), ("Current Role", self.role), ("Authenticated", "Yes" if self.authenticated else "No")])

    def _do_show_users(self) -> Result:
        return self._frame(["Username", "Roles"], [(n, ", ".join(f"{d}:{r}" for d, r in sorted(u["roles"].items()))) for n, u in sorted(self.users.all().items())])

    def _do_show_databases(self) -> Result:
        names = [n for n in self.db.files.names(self.root) if self.db.files.exists(f"{self.root}/{n}/database.json")]
        return self._frame(["Database"], [(n,) for n in names if self.users.role(self.user, n) != "DENIED" and n not in RESERVED_DATABASES])

    def _do_show_tables(self) -> Result:
        return self._frame([f"Tables_in_{self.db_name}"], [(n,) for n in sorted({*self.db.tables(), *self.db.views(), *self.external})])

    def _do_show_create_table(self, table: str) -> Result:
        return self.show_create(table)

    def _do_describe(self, table: str) -> Result:
        return self.describe(table)

    def _do_explain(self, s: A.Select) -> Result:
        plan = build(s, self.table)._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        return self._frame(["plan"], [(line,) for line in plan.split("\n")])

    def _do_stop(self) -> Result:
        self.closed = True
        return Result(message="STOPPED")


def _iso(v) -> str:
    s = str(v)
    return datetime.fromisoformat(format_micros(parse_moment(s))).isoformat() if "/" in s else s


def _literal_text(v) -> str:
    return (f'"{v}"' if "'" in v else f"'{v}'") if isinstance(v, str) else str(v).upper() if isinstance(v, bool) else str(v)


def _type_name(c: dict) -> str:
    return {"INT": "INTEGER", "DECIMAL": "DECIMAL", "BOOL": "BOOLEAN", "DATE": "TIMESTAMP", "STRING": f"VARCHAR({c['length']})"}[c["kind"]]


def connect(spark: SparkSession, uri: str, root: str) -> Session:
    """scheme://user:password@host:port/database over the store at ``root``."""
    u = urlparse(uri)
    s = Session(spark, root)
    if not s.users.login(u.username or "", u.password or ""):
        raise AuthError("wrong user or password")
    s.user = u.username
    if u.path.strip("/"):
        s._do_use(u.path.strip("/"))
    return s
