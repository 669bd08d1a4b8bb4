"""The syntax tree."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Col:
    name: str


@dataclass(frozen=True)
class Agg:
    func: str
    arg: str | None  # None: *
    distinct: bool = False

    @property
    def label(self) -> str:
        return f"{self.func}({'DISTINCT ' if self.distinct else ''}{self.arg or '*'})"


@dataclass(frozen=True)
class Lit:
    value: int | float | str | bool | None


@dataclass(frozen=True)
class Compare:
    left: Col | Agg
    op: str
    right: Lit | Col | Agg


@dataclass(frozen=True)
class In:
    left: Col | Agg
    values: tuple[Lit, ...]
    negated: bool = False


@dataclass(frozen=True)
class Like:
    left: Col
    pattern: str
    negated: bool = False


@dataclass(frozen=True)
class Between:
    left: Col | Agg
    low: Lit
    high: Lit
    negated: bool = False


@dataclass(frozen=True)
class IsNull:
    left: Col | Agg
    negated: bool = False


@dataclass(frozen=True)
class Not:
    inner: object


@dataclass(frozen=True)
class Chain:
    """Terms joined by AND and OR, strictly from left to right: ((a OR b) AND c)."""

    first: object
    rest: tuple[tuple[str, object], ...]


@dataclass(frozen=True)
class Item:
    expr: object  # Col, Agg or "*"
    alias: str | None = None


@dataclass(frozen=True)
class TableRef:
    name: str
    alias: str | None = None


@dataclass(frozen=True)
class Join:
    kind: str
    table: TableRef
    on: object | None


@dataclass(frozen=True)
class SortKey:
    expr: Col | Agg
    ascending: bool = True


@dataclass(frozen=True)
class Select:
    items: tuple[Item, ...]
    table: TableRef
    joins: tuple[Join, ...] = ()
    where: object | None = None
    group: tuple[Col, ...] = ()
    having: object | None = None
    order: tuple[SortKey, ...] = ()
    distinct: bool = False
    limit: int | None = None
    offset: int | None = None
    as_of: str | int | None = None


@dataclass
class ColumnDef:
    name: str
    kind: str  # INT, DECIMAL, STRING, BOOL or DATE
    length: int | None = None
    primary: bool = False
    nullable: bool = True
    unique: bool = False
    auto: bool = False
    default: Lit | None = None
    check: object | None = None
    check_text: str | None = None
    references: ForeignKey | None = None


@dataclass(frozen=True)
class ForeignKey:
    columns: tuple[str, ...]
    table: str
    ref_columns: tuple[str, ...]
    on_delete: str = "RESTRICT"
    on_update: str = "RESTRICT"


@dataclass
class CreateTable:
    name: str
    columns: list[ColumnDef]
    foreign_keys: list[ForeignKey] = field(default_factory=list)
    checks: list[tuple[str, object]] = field(default_factory=list)


@dataclass(frozen=True)
class CreateIndex:
    name: str
    table: str
    columns: tuple[str, ...]
    unique: bool = False
    where: str | None = None


@dataclass(frozen=True)
class AlterTable:
    table: str
    action: str  # ADD, DROP or RENAME
    name: str | None = None
    to: str | None = None
    column: ColumnDef | None = None


@dataclass(frozen=True)
class CreateView:
    name: str
    select: str


@dataclass(frozen=True)
class Insert:
    table: str
    columns: tuple[str, ...] | None
    rows: tuple[tuple[Lit, ...], ...]
    select: Select | None = None


@dataclass(frozen=True)
class Arith:
    left: Col | Lit | Arith
    op: str
    right: Col | Lit | Arith


@dataclass(frozen=True)
class Update:
    table: str
    sets: tuple[tuple[str, Lit | Col | Arith], ...]
    where: object | None


@dataclass(frozen=True)
class Delete:
    table: str
    where: object | None


@dataclass(frozen=True)
class Simple:
    """Statements of a verb and a few names: DROP TABLE t, BEGIN, USE d, SHOW TABLES, ..."""

    verb: str
    args: tuple = ()
