"""Keywords and their spellings.

A word may be a keyword in one place and a name in another, so the lexer yields plain words and the parser asks for the
keyword that it wants next. One spelling may stand for several keywords (DESC: DESCRIBE and descending).
"""

from __future__ import annotations

# The dialect's keywords with their Franco-Arabic spellings and English synonyms.
ALIASES: dict[str, str] = {
    "SELECT": "2E5TAR",
    "FROM": "MEN",
    "WHERE": "LAMA",
    "INSERT": "EMLA",
    "INTO": "GOWA",
    "VALUES": "ELKEYAM",
    "UPDATE": "3ADEL",
    "SET": "5ALY",
    "DELETE": "2EMSA7",
    "CREATE": "2E3MEL",
    "TABLE": "GADWAL",
    "INDEX": "FEHRIS",
    "USE": "2ESTA5DEM",
    "USER": "MOSTA5DEM 3ABD",
    "ROLE": "WAZEFA DOWR",
    "PASS": "PASSWORD",
    "SHOW": "WARENY",
    "WHOAMI": "ANAMEEN",
    "STATUS": "7ALAH",
    "DESCRIBE": "DESC WASF",
    "ADD": "ADAF",
    "RENAME": "GHAYER_ESM",
    "COLUMN": "3AMOD",
    "ADMIN": "MODEER",
    "NORMAL": "3ADI",
    "READONLY": "MOSHAHED",
    "DENIED": "MAMNO3",
    "TRUE": "AH",
    "FALSE": "LA",
    "AND": "WE",
    "OR": "AW",
    "IN": "FE",
    "ON": "3ALA",
    "PRIMARY": "ASASI",
    "KEY": "MOFTA7",
    "BEGIN": "START 2EBDA2",
    "COMMIT": "2AKED",
    "ROLLBACK": "2ERGA3 UNDO",
    "CHECKPOINT": "SAVE",
    "RECOVER": "ERGA3",
    "TO": "ELA",
    "LATEST": "A5ER ASLHA",
    "NOW": "DELWA2TY",
    "CURRENT": "7ALY",
    "AS": "K",
    "GROUP": "MAGMO3A",
    "BY": "B",
    "HAVING": "ETHA LAKEN",
    "COUNT": "3ADD",
    "SUM": "MAG3MO3",
    "AVG": "AVERAGE MOTOWASET",
    "MIN": "ASGAR",
    "MAX": "AKBAR",
    "ORDER": "RATEB",
    "ASC": "ASCENDING TASE3DI TALE3",
    "DESCENDING": "DESC TANAZOLI NAZL",
    "LIMIT": "7ADD",
    "OFFSET": "SKIP EBDA2MEN",
    "DISTINCT": "MOTA3MEZ",
    "ALL": "KOL",
    "JOIN": "ENTEDAH",
    "INNER": "DA5ELY",
    "LEFT": "SHMAL",
    "RIGHT": "YAMEN",
    "OUTER": "5AREGY",
    "FULL": "5AREGY",
    "CROSS": "TAQATE3",
    "FOREIGN": "5AREGY",
    "REFERENCES": "YOSHEER",
    "CASCADE": "TATABE3",
    "RESTRICT": "MANE3",
    "ACTION": "E3RA2",
    "NULL": "FADY",
    "NOT": "MESH",
    "DEFAULT": "EFRADY",
    "UNIQUE": "WAHED",
    "CHECK": "FA7S",
    "AUTO_INCREMENT": "AUTOINCREMENT SERIAL TAZAYED",
    "STOP": "WA2AF SHUTDOWN 2AFOL",
    "INT": "INTEGER RAKAM",
    "BOOL": "BOOLEAN",
    "DATE": "DATETIME TIMESTAMP TARE5",
    "STRING": "TEXT VARCHAR GOMLA",
    "DECIMAL": "FLOAT DOUBLE KASR",
    "END": "3END",
    "ERASE": "MA7W",
}

_SPELLINGS: dict[str, frozenset[str]] = {k: frozenset([k, *v.split()]) for k, v in ALIASES.items()}
#: Words that end an optional table or column alias.
RESERVED = frozenset(
    s
    for k in "FROM WHERE GROUP HAVING ORDER LIMIT OFFSET JOIN INNER LEFT RIGHT FULL OUTER CROSS ON AS SET VALUES AND OR SELECT".split()
    for s in _SPELLINGS[k]
) | {"UNION"}


def spellings(keyword: str) -> frozenset[str]:
    return _SPELLINGS.get(keyword) or frozenset([keyword])
