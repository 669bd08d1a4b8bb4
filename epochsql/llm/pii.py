"""Format-preserving pseudonyms of personal data.

Card numbers, phone numbers, IPv4 addresses, IBANs, social security numbers and calendar dates are found by pattern
and validated (checksums, ranges, the calendar). The value behind the format is a number below some N; a keyed Feistel
network permutes the numbers below N (walking the cycle until it falls below N again), and the result is written back
in the same format, with its checksum made right. So equal values get equal pseudonyms in all documents and however
they are written, different ones differ, and whoever holds the key can turn them back. The letters and digits of an
e-mail address's local part are permuted likewise. Values that fail validation are left as they are.

Where a match fails validation, its other lengths at group borders and the other kinds are tried at the same place, and
the search goes on behind its first character; so a number that stands beside others is found too. In such a place a
pseudonym may by chance be valid together with the number beside it, and the text, as a whole, can't be turned back then;
the value alone can.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, table

ROUNDS = 8
#: A setting of the session with the key; without one, the query (not the operator) takes a key that is no secret.
KEY_SETTING = "spark.epochsql.pii.key"
PUBLIC_KEY = b"a public key, for data that is no secret"
#: Characters of an e-mail address's local part at most (RFC 5321).
LOCAL_PART = 64
KINDS = ("email", "card", "phone", "ip", "iban", "ssn", "date")


class Feistel:
    """A keyed permutation of the integers below n."""

    def __init__(self, key: bytes, tweak: str, n: int):
        self.n, self.half = n, max(1, ((n - 1).bit_length() + 1) // 2)
        self.mask = (1 << self.half) - 1
        self.base = blake2b(tweak.encode() + b"\0" + str(n).encode(), key=key[:64], digest_size=16)

    def _f(self, r: int, x: int) -> int:
        h = self.base.copy()
        h.update(bytes([r]) + x.to_bytes((self.half + 7) // 8, "big"))
        d = h.digest()
        while len(d) * 8 < self.half:
            d += blake2b(d, digest_size=16).digest()
        return int.from_bytes(d, "big") & self.mask

    def _once(self, x: int, back: bool) -> int:
        a, b = x >> self.half, x & self.mask
        for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
            a, b = (b ^ self._f(r, a), a) if back else (b, a ^ self._f(r, b))
        return a << self.half | b

    def __call__(self, x: int, back: bool = False) -> int:
        if not 0 <= x < self.n:
            raise ValueError(f"{x} is not below {self.n}")
        while True:
            x = self._once(x, back)
            if x < self.n:
                return x


@lru_cache(4096)
def feistel(key: bytes, tweak: str, n: int) -> Feistel:
    return Feistel(key, tweak, n)


def luhn_sum(digits: str) -> int:
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))


def in_format(digits: str, like: str) -> str:
    """``like`` with its digits replaced one by one."""
    it = iter(digits)
    return "".join(next(it) if c in "0123456789" else c for c in like)


_DIGITS = re.compile(r"[0-9]")
_FREE = r"(?<![0-9A-Za-z_.+-])"
_END = r"(?![0-9]|[.-][0-9])"
#: Lengths of IBANs by country, from the IBAN registry.
IBAN_LENGTHS = {
    country: n
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
        29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}


def _iban(n: int) -> re.Pattern:
    more = f"[ ]?[A-Z0-9]{{{n % 4}}}" if n % 4 else ""
    return re.compile(rf"(?<![A-Za-z0-9])[A-Z]{{2}}[0-9]{{2}}(?:[ ]?[A-Z0-9]{{4}}){{{n // 4 - 1}}}{more}(?![A-Za-z0-9])")


_IBANS = {n: _iban(n) for n in range(34, 14, -1)}
#: Forms of each kind, in the order in which they are tried at a place; a card may also begin or end at a dash within a run of digits.
_FORMS = [
    ("ip", rf"{_FREE}[0-9]{{1,3}}\.[0-9]{{1,3}}\.[0-9]{{1,3}}\.[0-9]{{1,3}}(?![0-9]|\.[0-9])"),
    ("date", rf"{_FREE}(?:[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}|[0-9]{{1,2}}\.[0-9]{{1,2}}\.[0-9]{{4}}|[0-9]{{1,2}}-[0-9]{{1,2}}-[0-9]{{4}}|[0-9]{{4}}/[0-9]{{2}}/[0-9]{{2}})(?![0-9/-]|\.[0-9])"),
    ("ssn", rf"{_FREE}[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}(?![0-9-])"),
    *(("card", rf"(?:{_FREE}|(?<=[0-9]-))[0-9](?:[ -]?[0-9]){{{n - 1}}}(?![0-9]|\.[0-9])") for n in range(19, 12, -1)),
    ("phone", rf"{_FREE}(?:\+[0-9]{{1,3}}[ .-]?|1[.-](?=\(?[0-9]{{3}}[) .-]))?(?:\([0-9]{{2,4}}\)[ .-]?|[0-9]{{2,4}}[ .-])[0-9]{{3}}[ .-]?[0-9]{{4}}{_END}"),
    *(("phone", rf"{_FREE}\+[0-9]{{1,3}}[ .-]?(?:\([0-9]{{1,4}}\)|[0-9]{{1,4}})(?:[ .-]?[0-9]{{2,4}}){{{n}}}{_END}") for n in (4, 3, 2)),
]
_FORMS = [(kind, re.compile(form)) for kind, form in _FORMS]
#: Where one of them may begin.
_START = re.compile("|".join(["(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[ ]?[A-Z0-9]{4}", rf"(?:{_FREE}|(?<=[0-9]-))[0-9]", rf"{_FREE}[+(][0-9]"]))
#: Behind an @; labels have 63 characters at most, so a long run of letters is given up after as many.
_DOMAIN = re.compile(r"(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,}")
_LOCAL = re.compile(r"[\w.%+-]")
_LOCAL_START = re.compile(r"[^\W_]")
_FIRST_DAY, _LAST_DAY = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal()
_LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _addresses(s: str) -> Iterator[tuple[int, int, int]]:
    """Start, place of the @ and end of each e-mail address. From each @ the local part grows to the left, so that time
    grows with the text; of a longer one the last LOCAL_PART characters count."""
    done, at = 0, s.find("@")
    while at >= 0:
        if at > done and s[at - 1] != "." and (m := _DOMAIN.match(s, at + 1)):
            low = at
            while low > max(done, at - LOCAL_PART) and _LOCAL.match(s, low - 1):
                low -= 1
            if first := _LOCAL_START.search(s, low, at):
                yield first.start(), at, m.end()
                done = m.end()
        at = s.find("@", at + 1)


@dataclass(frozen=True)
class Pseudonymiser:
    key: bytes

    def _digits(self, kind: str, digits: str, back: bool) -> str:
        return str(feistel(self.key, f"{kind}/{len(digits)}", 10 ** len(digits))(int(digits), back)).zfill(len(digits))

    def card(self, s: str, back: bool = False) -> str | None:
        d = "".join(_DIGITS.findall(s))
        if not 13 <= len(d) <= 19 or luhn_sum(d) % 10 or len(set(d)) == 1:
            return None
        body = self._digits("card", d[:-1], back)
        while len(set(body + str(-luhn_sum(body + "0") % 10))) == 1:  # no card number; the cycle goes on
            body = self._digits("card", body, back)
        return in_format(body + str(-luhn_sum(body + "0") % 10), s)

    def phone(self, s: str, back: bool = False) -> str | None:
        """The national number is permuted; a country code after +, or a 1 before it, stays. Seven digits at least, fifteen
        at most."""
        m = re.match(r"(?:\+[0-9]{1,3}|1)(?=[ .(-])", s)
        head, rest = (m.group(), s[m.end() :]) if m else ("", s)
        d = "".join(_DIGITS.findall(rest))
        return head + in_format(self._digits("phone", d, back), rest) if 7 <= len(d) <= 15 else None

    def ip(self, s: str, back: bool = False) -> str | None:
        parts = s.split(".")
        if any(int(x) > 255 or len(x) > 1 and x[0] == "0" for x in parts):
            return None
        x = feistel(self.key, "ip", 1 << 32)(sum(int(p) << 8 * (3 - i) for i, p in enumerate(parts)), back)
        return ".".join(str(x >> 8 * (3 - i) & 255) for i in range(4))

    def ssn(self, s: str, back: bool = False) -> str | None:
        """Areas 1-899 but 666, groups 1-99, serials 1-9999."""
        a, g, n = map(int, s.split("-"))
        if not 0 < a < 900 or a == 666 or not g or not n:
            return None
        x = feistel(self.key, "ssn", 898 * 99 * 9999)((((a - 1 - (a > 666)) * 99) + g - 1) * 9999 + n - 1, back)
        x, n = divmod(x, 9999)
        a, g = divmod(x, 99)
        return f"{a + 1 + (a >= 665):03d}-{g + 1:02d}-{n + 1:04d}"

    def iban(self, s: str, back: bool = False) -> str | None:
        """Country and the kinds of characters stay; the check digits are made right."""
        c = s.replace(" ", "")
        if not 15 <= len(c) <= 34 or int("".join(str(int(x, 36)) for x in c[4:] + c[:4])) % 97 != 1:
            return None
        x = n = 0
        for ch in c[4:]:
            by = 10 if ch.isdigit() else 26
            x, n = x * by + (int(ch) if by == 10 else ord(ch) - 65), (n or 1) * by
        shape = re.sub("[A-Z]", "A", re.sub("[0-9]", "0", c[4:]))
        x = feistel(self.key, f"iban/{c[:2]}/{shape}", n)(x, back)
        out = []
        for ch in reversed(shape):
            x, r = divmod(x, 10 if ch == "0" else 26)
            out.append(str(r) if ch == "0" else chr(65 + r))
        body = "".join(reversed(out))
        check = 98 - int("".join(str(int(ch, 36)) for ch in body + c[:2] + "00")) % 97
        new = iter(f"{c[:2]}{check:02d}{body}")
        return "".join(" " if ch == " " else next(new) for ch in s)

    def date(self, s: str, back: bool = False) -> str | None:
        """Days from 1900 to 2099. Day before month in forms with the year last, unless only the other is a date."""
        sep = next(ch for ch in s if not ch.isdigit())
        a, b, c = s.split(sep)
        orders = [(0, 1, 2)] if len(a) == 4 else [(2, 1, 0), (2, 0, 1)]
        parts = (int(a), int(b), int(c))
        for o in orders:
            try:
                day = date(*(parts[i] for i in o)).toordinal()
            except ValueError:
                continue
            if not _FIRST_DAY <= day <= _LAST_DAY:
                return None
            # a date that is read month first stays one that is read so, to be found again: its day is above 12
            swapped = o == (2, 0, 1)
            net = feistel(self.key, "date/month-first" if swapped else "date", _LAST_DAY - _FIRST_DAY + 1)
            while True:
                day = _FIRST_DAY + net(day - _FIRST_DAY, back)
                new = date.fromordinal(day)
                if not swapped or new.day > 12:
                    break
            out = ["", "", ""]
            for i, v in zip(o, (new.year, new.month, new.day), strict=True):
                out[i] = str(v).zfill(len((a, b, c)[i]) if len((a, b, c)[i]) != 1 else 1)
            return sep.join(out)
        return None

    def local_part(self, s: str, back: bool = False) -> str:
        """Case is kept in place; letters are permuted as letters, digits as digits. Other letters than a-z are replaced
        by keyed ones of a-z, which can't be turned back."""
        t = "".join(c if c in "%+.-_0123456789" or c.lower() in _LETTERS else _LETTERS[blake2b(f"{i}{s.lower()}".encode(), key=self.key[:64], digest_size=2).digest()[0] % 26] for i, c in enumerate(s))
        x, n = 0, 1
        for c in t.lower():
            by = 10 if c.isdigit() else 26 if c in _LETTERS else 1
            x, n = x * by + (int(c) if by == 10 else _LETTERS.index(c) if by == 26 else 0), n * by
        shape = re.sub("[a-z]", "a", re.sub("[0-9]", "0", t.lower()))
        x = feistel(self.key, f"email/{shape}", n)(x, back) if n > 1 else x
        out = []
        for c, like in zip(reversed(t.lower()), reversed(s), strict=True):
            by = 10 if c.isdigit() else 26 if c in _LETTERS else 1
            x, r = divmod(x, by)
            new = str(r) if by == 10 else _LETTERS[r] if by == 26 else c
            out.append(new.upper() if like.isupper() else new)
        return "".join(reversed(out))

    @staticmethod
    def _forms(s: str, at: int) -> Iterator[tuple[str, int]]:
        """Kinds and ends of what may stand at a place. Of IBANs, the length of the country comes first."""
        if s[at].isalpha():
            first = IBAN_LENGTHS.get(s[at : at + 2])
            for n in [first, *_IBANS] if first else _IBANS:
                if m := _IBANS[n].match(s, at):
                    yield "iban", m.end()
            return
        for kind, form in _FORMS:
            if m := form.match(s, at):
                yield kind, m.end()

    def text(self, s: str, back: bool = False) -> tuple[str, dict[str, int]]:
        """The text with pseudonyms in place of personal data, and how many of each kind were replaced."""
        found: dict[str, int] = {}
        out, done = [], 0
        for start, at, end in _addresses(s):
            found["email"] = found.get("email", 0) + 1
            out += s[done:start], self.local_part(s[start:at], back)
            done = at
        if out:
            s = "".join([*out, s[done:]])
        if _DIGITS.search(s):
            out, done, at = [], 0, 0
            while m := _START.search(s, at):
                at = m.start()
                for kind, end in self._forms(s, at):
                    new = getattr(self, kind)(s[at:end], back)
                    if new is not None:
                        found[kind] = found.get(kind, 0) + 1
                        out += s[done:at], new
                        done = at = end
                        break
                else:
                    at += 1
            s = "".join([*out, s[done:]])
        return s, found


def pseudonymise(docs: DataFrame, key: bytes, back: bool = False) -> DataFrame:
    """``docs`` with all its columns, whatever their names, texts pseudonymised.

    Null and empty texts stay so; ids are not looked at; repeated rows are treated alike; an empty table stays empty; a very
    long text is gone through once, in time that grows with its length.
    """
    at = docs.columns.index("text")
    kind = docs.schema["text"].dataType

    def run(batches):
        p = Pseudonymiser(key)
        for b in batches:
            text = pa.array([None if t is None else p.text(t, back)[0] for t in b.column(at).to_pylist()], b.schema.field(at).type)
            yield b.set_column(at, b.schema.field(at).name, text)

    assert kind.typeName() == "string", "text must be a string column"
    return map_arrow(docs, run, docs.schema)


def replaced(docs: DataFrame, key: bytes) -> DataFrame:
    """doc_id, text with pseudonyms, n_replaced and n_<kind> for every kind. Null texts stay null, with counts of 0; null
    and repeated ids stay as they are; repeated rows are reported each, alike; an empty table gives no rows; other columns
    are ignored."""
    names = [f"n_{k}" for k in KINDS]

    def run(batches):
        p = Pseudonymiser(key)
        for b in batches:
            texts, counts = [], []
            for t in b.column(1).to_pylist():
                new, found = (None, {}) if t is None else p.text(t)
                texts.append(new)
                counts.append([found.get(k, 0) for k in KINDS])
            each = [pa.array([c[i] for c in counts], pa.int32()) for i in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, b.schema.field(1).type), pa.array([sum(c) for c in counts], pa.int32()), *each], names=["doc_id", "text", "n_replaced", *names])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, text string, n_replaced int, " + ", ".join(f"{n} int" for n in names))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``replaced`` of documents, with the key of the session's setting; what it says of odd rows holds here."""
    return replaced(table(spark, sf_dir, "documents"), (spark.conf.get(KEY_SETTING, "") or "").encode() or PUBLIC_KEY)
