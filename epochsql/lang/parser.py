"""Recursive descent over the dialect, English and Franco."""

from __future__ import annotations

from . import ast as A
from .keywords import RESERVED, spellings
from .lexer import LexError, Token, tokens


class ParseError(ValueError):
    pass


AGGREGATES = ("COUNT", "SUM", "AVG", "MIN", "MAX")
TYPES = {"INT": "INT", "DECIMAL": "DECIMAL", "STRING": "STRING", "BOOL": "BOOL", "DATE": "DATE"}
COMPARISONS = ("=", "<", ">", "<=", ">=", "!=", "<>")


class Parser:
    def __init__(self, text: str):
        self.text = text
        try:
            self.toks = tokens(text)
        except LexError as e:
            raise ParseError(str(e)) from e
        self.i = 0

    # -- tokens

    @property
    def tok(self) -> Token:
        return self.toks[self.i]

    def ahead(self, n: int = 1) -> Token:
        return self.toks[min(self.i + n, len(self.toks) - 1)]

    def fail(self, wanted: str):
        raise ParseError(f"expected {wanted}, found {self.tok.text or 'the end'!r} at {self.tok.at}")

    def is_kw(self, *words: str, at: int = 0) -> bool:
        t = self.ahead(at) if at else self.tok
        return t.kind == "word" and any(t.upper in spellings(w) for w in words)

    def take(self, *words: str) -> bool:
        """Takes the keywords one after the other, or none of them."""
        if all(self.is_kw(w, at=n) for n, w in enumerate(words)):
            self.i += len(words)
            return True
        return False

    def need(self, *words: str) -> None:
        for w in words:
            if not self.take(w):
                self.fail(w)

    def op(self, text: str) -> bool:
        if self.tok.kind == "op" and self.tok.text == text:
            self.i += 1
            return True
        return False

    def need_op(self, text: str) -> None:
        if not self.op(text):
            self.fail(repr(text))

    def name(self, what: str = "a name") -> str:
        if self.tok.kind != "word":
            self.fail(what)
        self.i += 1
        return self.toks[self.i - 1].text

    def dotted(self) -> str:
        out = self.name("a column")
        while self.op("."):
            out += "." + self.name("a column")
        return out

    def number(self) -> int:
        if self.tok.kind != "number" or "." in self.tok.text:
            self.fail("a whole number")
        self.i += 1
        return int(self.toks[self.i - 1].text)

    def names(self) -> tuple[str, ...]:
        self.need_op("(")
        out = [self.name()]
        while self.op(","):
            out.append(self.name())
        self.need_op(")")
        return tuple(out)

    # -- values and predicates

    def literal(self) -> A.Lit:
        t = self.tok
        if t.kind == "string":
            self.i += 1
            return A.Lit(t.text)
        if t.kind == "number":
            self.i += 1
            return A.Lit(float(t.text) if "." in t.text else int(t.text))
        for word, value in (("TRUE", True), ("FALSE", False), ("NULL", None)):
            if self.take(word):
                return A.Lit(value)
        self.fail("a value")
        raise AssertionError

    def is_literal(self) -> bool:
        return self.tok.kind in ("string", "number") or (self.is_kw("TRUE", "FALSE", "NULL") and not (self.ahead().kind == "op" and self.ahead().text in ".("))

    def operand(self) -> A.Col | A.Agg:
        for f in AGGREGATES:
            if self.is_kw(f) and self.ahead().text == "(":
                self.i += 2
                distinct = self.take("DISTINCT")
                arg = None if not distinct and self.op("*") else self.dotted()
                if arg is None and f != "COUNT":
                    self.fail("a column")
                self.need_op(")")
                return A.Agg(f, arg, distinct)
        return A.Col(self.dotted())

    def term(self):
        if self.take("NOT"):
            return A.Not(self.term())
        if self.op("("):
            inner = self.predicate()
            self.need_op(")")
            return inner
        left = self.operand()
        negated = self.take("NOT")
        if self.take("IN"):
            self.need_op("(")
            values = [self.literal()]
            while self.op(","):
                values.append(self.literal())
            self.need_op(")")
            return A.In(left, tuple(values), negated)
        if self.take("LIKE"):
            if self.tok.kind != "string":
                self.fail("a pattern")
            self.i += 1
            return A.Like(left, self.toks[self.i - 1].text, negated)
        if self.take("BETWEEN"):
            low = self.literal()
            self.need("AND")
            return A.Between(left, low, self.literal(), negated)
        if negated:
            self.fail("IN, LIKE or BETWEEN")
        if self.take("IS"):
            negated = self.take("NOT")
            self.need("NULL")
            return A.IsNull(left, negated)
        if self.tok.kind != "op" or self.tok.text not in COMPARISONS:
            self.fail("a comparison")
        op = "!=" if self.tok.text == "<>" else self.tok.text
        self.i += 1
        return A.Compare(left, op, self.literal() if self.is_literal() else self.operand())

    def predicate(self):
        first, rest = self.term(), []
        while self.is_kw("AND", "OR"):
            op = "AND" if self.is_kw("AND") else "OR"
            self.i += 1
            rest.append((op, self.term()))
        return A.Chain(first, tuple(rest)) if rest else first

    # -- SELECT

    def table_ref(self) -> A.TableRef:
        name, alias = self.dotted(), None
        if self.is_kw("AS") and not self.is_kw("OF", at=1):
            self.i += 1
            alias = self.name("an alias")
        elif self.tok.kind == "word" and self.tok.upper not in RESERVED:
            alias = self.name()
        return A.TableRef(name, alias)

    def item(self) -> A.Item:
        if self.op("*"):
            return A.Item("*")
        if self.tok.kind == "word" and self.ahead().text == "." and self.ahead(2).text == "*":
            table = self.name()
            self.i += 2
            return A.Item(f"{table}.*")
        expr, alias = self.operand(), None
        if self.take("AS"):
            alias = self.name("an alias")
        return A.Item(expr, alias)

    def joins(self) -> list[A.Join]:
        out = []
        while True:
            kind = None
            if self.take("JOIN") or self.take("INNER", "JOIN"):
                kind = "inner"
            elif self.take("CROSS", "JOIN"):
                kind = "cross"
            elif self.take("FULL", "OUTER", "JOIN") or self.take("FULL", "JOIN") or self.take("OUTER", "JOIN"):
                kind = "full"
            else:
                for word, name in (("LEFT", "left"), ("RIGHT", "right")):
                    if self.take(word, "OUTER", "JOIN") or self.take(word, "JOIN"):
                        kind = name
                        break
            if kind is None:
                return out
            table = self.table_ref()
            on = self.predicate() if self.take("ON") else None
            if on is None and kind == "inner":
                kind = "cross"
            if on is None and kind != "cross":
                self.fail("ON")
            out.append(A.Join(kind, table, on))

    def select(self) -> A.Select:
        self.need("SELECT")
        distinct = self.take("DISTINCT")
        if not distinct:
            self.take("ALL")
        items = [self.item()]
        while self.op(","):
            items.append(self.item())
        self.need("FROM")
        table, as_of = self.table_ref(), None
        if self.is_kw("AS") and self.is_kw("OF", at=1):
            as_of = self.as_of()
        joins = self.joins()
        where = self.predicate() if self.take("WHERE") else None
        group: list[A.Col] = []
        if self.take("GROUP", "BY"):
            group.append(A.Col(self.dotted()))
            while self.op(","):
                group.append(A.Col(self.dotted()))
        having = None
        if self.take("HAVING"):
            self.take("WHERE")
            having = self.predicate()
        order: list[A.SortKey] = []
        if self.take("ORDER", "BY"):
            while True:
                expr = self.operand()
                descending = self.take("DESCENDING")
                if not descending:
                    self.take("ASC")
                order.append(A.SortKey(expr, not descending))
                if not self.op(","):
                    break
        limit = self.number() if self.take("LIMIT") else None
        offset = self.number() if self.take("OFFSET") else None
        if self.is_kw("AS") and self.is_kw("OF", at=1):
            as_of = self.as_of()
        if (limit or 0) < 0 or (offset or 0) < 0:
            raise ParseError("LIMIT and OFFSET can't be negative")
        return A.Select(tuple(items), table, tuple(joins), where, tuple(group), having, tuple(order), distinct, limit, offset, as_of)

    def as_of(self) -> str | int:
        self.need("AS", "OF")
        return self.moment()

    def moment(self) -> str | int:
        if self.tok.kind == "number":
            return self.number()
        if self.tok.kind == "string":
            self.i += 1
            return self.toks[self.i - 1].text
        for w in ("LATEST", "NOW", "CURRENT"):
            if self.take(w):
                return "LATEST"
        self.fail("a point in time")
        raise AssertionError

    # -- DDL

    def column_def(self) -> A.ColumnDef:
        name = self.name("a column")
        kind = next((k for w, k in TYPES.items() if self.is_kw(w)), None)
        if kind is None:
            self.fail("a type")
        self.i += 1
        c = A.ColumnDef(name, kind)
        if self.op("("):
            c.length = self.number()
            if kind == "DECIMAL" and self.op(","):
                self.number()
            self.need_op(")")
        if kind == "STRING" and c.length is None:
            c.length = 255
        while True:
            if self.take("PRIMARY"):
                self.take("KEY")
                c.primary, c.nullable = True, False
            elif self.take("KEY", "PRIMARY"):
                c.primary, c.nullable = True, False
            elif self.take("NOT", "NULL"):
                c.nullable = False
            elif self.take("NULL"):
                c.nullable = True
            elif self.take("UNIQUE"):
                c.unique = True
            elif self.take("AUTO_INCREMENT"):
                c.auto = True
            elif self.take("DEFAULT"):
                c.default = self.literal()
            elif self.take("CHECK"):
                c.check_text, c.check = self.check()
            elif self.is_kw("REFERENCES"):
                c.references = self.references((name,))
            else:
                return c

    def check(self) -> tuple[str, object]:
        self.need_op("(")
        start = self.tok.at
        p = self.predicate()
        text = self.text[start : self.tok.at].strip()
        self.need_op(")")
        return text, p

    def foreign_key(self) -> A.ForeignKey:
        return self.references(self.names())

    def references(self, columns: tuple[str, ...]) -> A.ForeignKey:
        self.need("REFERENCES")
        table = self.name("a table")
        refs = self.names()
        acts = {"DELETE": "RESTRICT", "UPDATE": "RESTRICT"}
        while self.is_kw("ON") or self.is_kw("END"):
            self.i += 1
            if self.take("UPDATE"):
                event = "UPDATE"
            elif self.take("DELETE") or self.take("ERASE"):
                event = "DELETE"
            else:
                self.fail("DELETE or UPDATE")
            if self.take("CASCADE"):
                acts[event] = "CASCADE"
            elif self.take("RESTRICT"):
                acts[event] = "RESTRICT"
            elif self.take("SET", "NULL"):
                acts[event] = "SET NULL"
            elif self.take("SET", "DEFAULT"):
                acts[event] = "SET DEFAULT"
            elif self.take("NO", "ACTION"):
                acts[event] = "NO ACTION"
            else:
                self.fail("an action")
        return A.ForeignKey(columns, table, refs, acts["DELETE"], acts["UPDATE"])

    def create(self):
        if self.take("TABLE"):
            out = A.CreateTable(self.name("a table"), [])
            self.need_op("(")
            while True:
                if self.is_kw("FOREIGN") and self.is_kw("KEY", at=1):
                    self.i += 2
                    out.foreign_keys.append(self.foreign_key())
                elif self.is_kw("CHECK") and self.ahead().text == "(":
                    self.i += 1
                    out.checks.append(self.check())
                elif self.is_kw("PRIMARY") and (self.ahead().text == "(" or self.is_kw("KEY", at=1) and self.ahead(2).text == "("):
                    self.i += 2 if self.is_kw("KEY", at=1) else 1
                    for n in self.names():
                        c = next((c for c in out.columns if c.name == n), None)
                        if c is None:
                            raise ParseError(f"no column {n}")
                        c.primary, c.nullable = True, False
                else:
                    out.columns.append(self.column_def())
                    out.foreign_keys += [out.columns[-1].references] * bool(out.columns[-1].references)
                if not self.op(","):
                    break
            self.need_op(")")
            return out
        unique = self.take("UNIQUE", "INDEX")
        if unique or self.take("INDEX"):
            name = self.name("an index")
            self.need("ON")
            table = self.name("a table")
            columns, where = self.names(), None
            if self.take("WHERE"):
                start = self.tok.at
                self.predicate()
                where = self.text[start : self.tok.at].strip()
            return A.CreateIndex(name, table, columns, unique, where)
        if self.take("VIEW"):
            name = self.name("a view")
            self.need("AS")
            start = self.tok.at
            self.select()
            return A.CreateView(name, self.text[start : self.tok.at].strip())
        if self.take("DATABASE"):
            return A.Simple("CREATE DATABASE", (self.name("a database"),))
        if self.take("USER"):
            name = self.name("a user")
            self.need("PASS")
            if self.tok.kind not in ("word", "string", "number"):
                self.fail("a password")
            self.i += 1
            word = self.toks[self.i - 1].text
            self.need("ROLE")
            return A.Simple("CREATE USER", (name, word, self.role()))
        self.fail("TABLE, INDEX, DATABASE or USER")

    def role(self) -> str:
        for r in ("SUPERADMIN", "ADMIN", "NORMAL", "READONLY", "DENIED"):
            if self.take(r):
                return r
        self.fail("a role")
        raise AssertionError

    # -- statements

    def insert(self) -> A.Insert:
        self.need("INTO")
        table = self.name("a table")
        columns = self.names() if self.tok.text == "(" else None
        if self.is_kw("SELECT"):
            return A.Insert(table, columns, (), self.select())
        self.need("VALUES")
        rows = []
        while True:
            self.need_op("(")
            row = [self.literal()]
            while self.op(","):
                row.append(self.literal())
            self.need_op(")")
            rows.append(tuple(row))
            if not self.op(","):
                return A.Insert(table, columns, tuple(rows))

    def update(self):
        if self.take("USER"):
            name = self.name("a user")
            self.need("ROLE")
            role = self.role()
            return A.Simple("ALTER USER", (name, role, self.name("a database") if self.take("IN") else None))
        self.take("INTO")
        table = self.name("a table")
        self.need("SET")
        sets = []
        while True:
            c = self.name("a column")
            self.need_op("=")
            sets.append((c, self.sum()))
            if not self.op(","):
                break
        return A.Update(table, tuple(sets), self.predicate() if self.take("WHERE") else None)

    def sum(self):
        out = self.product()
        while self.tok.text in ("+", "-") and self.tok.kind == "op" or self.tok.kind == "number" and self.tok.text[0] == "-":
            op = "-" if self.op("-") else "+"  # "a -1" is read as a and the number -1
            if op == "+":
                self.op("+")
            out = A.Arith(out, op, self.product())
        return out

    def product(self):
        out = self.factor()
        while self.tok.kind == "op" and self.tok.text in "*/":
            self.i += 1
            out = A.Arith(out, self.toks[self.i - 1].text, self.factor())
        return out

    def factor(self):
        if self.op("("):
            out = self.sum()
            self.need_op(")")
            return out
        if self.op("-"):
            return A.Arith(A.Lit(0), "-", self.factor())
        return self.literal() if self.is_literal() else A.Col(self.dotted())

    def alter(self):
        table = self.name("a table")
        if self.take("ADD"):
            self.take("COLUMN")
            return A.AlterTable(table, "ADD", column=self.column_def())
        if self.take("DROP") or self.take("DELETE"):
            self.take("COLUMN")
            return A.AlterTable(table, "DROP", self.name("a column"))
        self.need("RENAME")
        self.take("COLUMN")
        name = self.name("a column")
        self.need("TO")
        return A.AlterTable(table, "RENAME", name, self.name("a column"))

    def delete(self):
        for w in ("TABLE", "DATABASE", "USER", "INDEX", "VIEW"):
            if self.is_kw(w) and not self.is_kw("FROM"):
                self.i += 1
                return A.Simple(f"DROP {w}", (self.name(),))
        self.need("FROM")
        return A.Delete(self.name("a table"), self.predicate() if self.take("WHERE") else None)

    def show(self):
        if self.take("CREATE", "TABLE"):
            return A.Simple("SHOW CREATE TABLE", (self.name("a table"),))
        for words, verb in (("USER", "USERS"), ("USERS", "USERS"), ("DATABASES", "DATABASES"), ("DATABASE", "DATABASES"), ("TABLE", "TABLES"), ("TABLES", "TABLES"), ("STATUS", "STATUS")):
            if self.take(words):
                return A.Simple(f"SHOW {verb}")
        self.fail("USERS, DATABASES, TABLES, STATUS or CREATE TABLE")

    def statement(self):
        if self.is_kw("SELECT"):
            return self.select()
        if self.take("INSERT"):
            return self.insert()
        if self.is_kw("UPDATE") and self.is_kw("TABLE", at=1):
            self.i += 2
            return self.alter()
        if self.take("UPDATE"):
            return self.update()
        if self.take("ALTER", "TABLE"):
            return self.alter()
        if self.take("ALTER", "USER"):
            self.i -= 1
            return self.update()
        if self.take("TRUNCATE"):
            self.take("TABLE")
            return A.Simple("TRUNCATE", (self.name("a table"),))
        if self.take("ANALYZE"):
            self.take("TABLE")
            out = A.Simple("ANALYZE", (self.name("a table"),))
            self.take("UPDATE", "HISTOGRAM")
            return out
        if self.take("VACUUM"):
            return A.Simple("VACUUM", (self.name() if self.tok.kind == "word" else None,))
        if self.take("PRAGMA"):
            name = self.name("a setting")
            return A.Simple("PRAGMA", (name, self.literal().value if self.op("=") else None))
        if self.take("DELETE"):
            return self.delete()
        if self.take("DROP"):
            return self.delete()
        if self.take("CREATE"):
            return self.create()
        if self.take("SHOW"):
            return self.show()
        if self.take("DESCRIBE"):
            return A.Simple("DESCRIBE", (self.name("a table"),))
        for verb in ("BEGIN", "COMMIT", "ROLLBACK", "CHECKPOINT", "WHOAMI", "STOP"):
            if self.take(verb):
                return A.Simple(verb)
        if self.take("STATUS"):
            return A.Simple("SHOW STATUS")
        if self.take("RECOVER"):
            self.need("TO")
            return A.Simple("RECOVER", (self.moment(),))
        if self.take("USE"):
            return A.Simple("USE", (self.name("a database"),))
        if self.take("LOGIN"):
            user = self.name("a user")
            self.i += 1
            return A.Simple("LOGIN", (user, self.toks[self.i - 1].text))
        if self.take("EXPLAIN"):
            return A.Simple("EXPLAIN", (self.select(),))
        self.fail("a statement")

    def whole(self):
        out = self.statement()
        self.op(";")
        if self.tok.kind != "end":
            self.fail("the end of the statement")
        return out


def parse(text: str):
    """The syntax tree of one statement. The closing semicolon may be left out."""
    return Parser(text).whole()
