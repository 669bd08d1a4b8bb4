import pytest

from epochsql.cli import statements
from epochsql.functions import parse_moment
from epochsql.lang import ParseError, parse
from epochsql.lang import ast as A
from epochsql.lang.keywords import ALIASES, spellings
from epochsql.lang.lexer import tokens


def test_words_may_start_with_digits():
    assert [(t.kind, t.text) for t in tokens("2E5TAR 25 -10.55 'a b' <= t.c")][:-1] == [("word", "2E5TAR"), ("number", "25"), ("number", "-10.55"), ("string", "a b"), ("op", "<="), ("word", "t"), ("op", "."), ("word", "c")]


@pytest.mark.parametrize("keyword", sorted(ALIASES))
def test_every_spelling_is_known(keyword):
    assert keyword in spellings(keyword)
    for s in ALIASES[keyword].split():
        assert s in spellings(keyword)


PAIRS = [
    ("SELECT a FROM t WHERE x = 1 AND y IN (1, 2);", "2E5TAR a MEN t LAMA x = 1 WE y FE (1, 2);"),
    ("SELECT DISTINCT a, COUNT(*) FROM t GROUP BY a HAVING COUNT(*) > 1 ORDER BY a DESC LIMIT 3 OFFSET 1;", "2E5TAR MOTA3MEZ a, 3ADD(*) MEN t MAGMO3A B a LAKEN COUNT(*) > 1 RATEB B a NAZL 7ADD 3 EBDA2MEN 1;"),
    ("SELECT a FROM t LEFT JOIN u ON t.x = u.y;", "2E5TAR a MEN t SHMAL ENTEDAH u 3ALA t.x = u.y;"),
    ("INSERT INTO t VALUES (1, 'x', TRUE);", "EMLA GOWA t ELKEYAM (1, 'x', AH);"),
    ("UPDATE t SET a = 2 WHERE b < 3;", "3ADEL GOWA t 5ALY a = 2 LAMA b < 3;"),
    ("DELETE FROM t WHERE a = 1;", "2EMSA7 MEN t LAMA a = 1;"),
    ("DROP TABLE t;", "2EMSA7 GADWAL t;"),
    ("CREATE TABLE t (id INT PRIMARY KEY AUTO_INCREMENT, n STRING(9) NOT NULL UNIQUE, d DECIMAL DEFAULT 0.5);", "2E3MEL GADWAL t (id RAKAM ASASI TAZAYED, n GOMLA(9) MESH FADY WAHED, d KASR EFRADY 0.5);"),
    ("BEGIN;", "2EBDA2;"),
    ("RECOVER TO LATEST;", "ERGA3 ELA ASLHA;"),
]


@pytest.mark.parametrize(("english", "franco"), PAIRS)
def test_both_languages_mean_the_same(english, franco):
    assert parse(english) == parse(franco)
    assert parse(franco.lower()) == parse(franco) or "'x'" in franco


def test_and_or_fold_left():
    p = parse("SELECT a FROM t WHERE x = 1 OR y = 2 AND z = 3;").where
    assert [op for op, _ in p.rest] == ["OR", "AND"]
    p = parse("SELECT a FROM t WHERE x = 1 OR (y = 2 AND z = 3);").where
    assert isinstance(p.rest[0][1], A.Chain)


def test_desc_is_describe_or_descending():
    assert parse("DESC t;") == A.Simple("DESCRIBE", ("t",))
    assert not parse("SELECT a FROM t ORDER BY a DESC;").order[0].ascending


def test_as_of_and_alias():
    s = parse("SELECT a AS b FROM t WHERE a > 1 AS OF '01/02/2024 10:00';")
    assert (s.as_of, s.items[0].alias) == ("01/02/2024 10:00", "b")


@pytest.mark.parametrize("bad", ["", "SELECT FROM t", "SELECT a t", "SELECT a FROM t WHERE", "INSERT INTO t VALUES ()", "SELECT a FROM t LIMIT x", "UPDATE t a = 1", "SELECT SUM(*) FROM t", "SELECT a FROM t; SELECT b FROM t", "CREATE TABLE t (a BLOB)", "SELECT a ! b FROM t"])
def test_errors(bad):
    with pytest.raises(ParseError):
        parse(bad)


def test_moments():
    assert parse_moment("02/01/1970") == 86_400_000_000
    assert parse_moment("1970-01-01 00:00:01") == 1_000_000
    assert parse_moment("01/01/1970 01:02:03") == 3_723_000_000
    assert parse_moment("2 hours ago", now=7_200_000_000) == 0
    assert parse_moment(5) == 5
    with pytest.raises(ValueError):
        parse_moment("31/02/2024")


def test_scripts_are_cut_outside_strings_and_comments():
    assert list(statements("SELECT a FROM t; -- no; \n/* ; */ INSERT INTO t VALUES ('a;b');\n\n")) == ["SELECT a FROM t;", "INSERT INTO t VALUES ('a;b');"]
