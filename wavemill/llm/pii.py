"""Personal data replaced by format-preserving pseudonyms.

Validated numbers and dates (and the letters and digits of e-mail addresses and hexadecimal secrets) are permuted by a
keyed Feistel network over exactly the values that share their format, however long, so a pseudonym is again valid, a value gets the
same pseudonym in every document, and the key holder can invert it.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import kernels as K

SLICE_BYTES, ROUNDS, REMEMBERED = 1 << 20, 8, 200_000
#: Formats of more than 2**NUMBER_BITS values are permuted symbol by symbol; longer values are not remembered.
NUMBER_BITS, REMEMBERED_CHARS = 576, 256
KINDS = ("email", "ip", "iban", "card", "ssn", "phone", "date", "secret")
_FIRST_DAY, _DAYS = datetime.date(1900, 1, 1), 73049  # to 2099-12-31
_FOUND = re.compile(
    r"(?P<email>(?<![\w.%+-])[\w%+-][\w.%+-]*@[\w-]+(?:\.[\w-]+)*\.[A-Za-z]{2,}(?![\w-]))"
    r"|(?P<ip>(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d))"
    r"|(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<date>(?<![\w/.-])(?:\d{4}(?P<a>[-/.])\d{2}(?P=a)\d{2}|\d{2}(?P<b>[-/.])\d{2}(?P=b)\d{4})(?![\w/-]|\.\d))"
    r"|(?P<phone>(?<![\w(+-])(?:\+1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[.-]\d{4}(?![\w-]))"
    r"|(?P<card>(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-]))"
    r"|(?P<secret>(?<!\w)(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?!\w))",
    re.ASCII,
)


class Feistel:
    """A keyed permutation of range(n) for any n, by cycle walking; ``tweak`` makes it another one."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _walk(self, x: int, n: int, tweak: bytes, rounds: range) -> int:
        half = max(1, ((n - 1).bit_length() + 1) // 2)
        mask, size = (1 << half) - 1, (half + 7) // 8
        while True:
            left, right = x >> half, x & mask
            for r in rounds:
                h = hashlib.blake2b(r.to_bytes(2, "big") + n.to_bytes(72, "big") + tweak, key=self.key, digest_size=64)
                h.update((right if rounds.step > 0 else left).to_bytes(size, "big"))
                f = int.from_bytes(h.digest(), "big") & mask
                left, right = (right, left ^ f) if rounds.step > 0 else (right ^ f, left)
            x = left << half | right
            if x < n:
                return x

    def permute(self, x: int, n: int, tweak: bytes = b"") -> int:
        return self._walk(x, n, tweak, range(ROUNDS)) if n > 1 else x

    def invert(self, x: int, n: int, tweak: bytes = b"") -> int:
        return self._walk(x, n, tweak, range(ROUNDS - 1, -1, -1)) if n > 1 else x

    def symbols(self, text: str, alphabets: list[str], tweak: bytes, back: bool = False) -> str:
        """Permute a text whose k-th character is one of alphabets[k]."""
        x, n = 0, 1
        for c, a in zip(text, alphabets):
            x, n = x * len(a) + a.index(c), n * len(a)
            if n.bit_length() > NUMBER_BITS:
                return self._long(text, alphabets, tweak, back)
        x = (self.invert if back else self.permute)(x, n, tweak)
        out = []
        for a in reversed(alphabets):
            x, r = divmod(x, len(a))
            out.append(a[r])
        return "".join(reversed(out))

    def _long(self, text: str, alphabets: list[str], tweak: bytes, back: bool) -> str:
        """``symbols`` in time linear in the length: each half in turn is shifted by what the other half hashes to."""
        sizes = np.array([len(a) for a in alphabets], np.uint8)
        x = np.array([a.index(c) for c, a in zip(text, alphabets)], np.uint8)
        halves = slice(0, len(x) // 2), slice(len(x) // 2, len(x))
        head = len(x).to_bytes(8, "big") + sizes.tobytes() + tweak
        for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
            to, by = halves[r % 2], halves[1 - r % 2]
            n = sizes[to].astype(np.int64)
            drawn = hashlib.shake_256(self.key + r.to_bytes(2, "big") + head + x[by].tobytes()).digest(4 * len(n))
            f = np.frombuffer(drawn, "<u4").astype(np.int64)
            x[to] = (x[to] + (-f if back else f)) % n
        return "".join(a[k] for k, a in zip(x.tolist(), alphabets))


def luhn_digit(digits: str) -> str:
    """The check digit behind ``digits``."""
    total = sum(sum(divmod(int(d) * (2 - i % 2), 10)) for i, d in enumerate(reversed(digits)))
    return str(-total % 10)


def _iban_check(country: str, bban: str) -> str:
    number = int("".join(str(int(c, 36)) for c in bban + country + "00"))
    return f"{98 - number % 97:02d}"


def _fill(template: str, symbols: str) -> str:
    """The template with its ASCII letters and digits replaced in order."""
    it = iter(symbols)
    return "".join(next(it) if c.isascii() and c.isalnum() else c for c in template)


def _class(c: str) -> str:
    return next(a for a in (string.digits, string.ascii_lowercase, string.ascii_uppercase) if c in a)


class Pseudonyms:
    """pseudonym(kind, value): its replacement, or None where the value is not valid."""

    def __init__(self, key: bytes):
        self.feistel, self.known = Feistel(key), {}

    def __call__(self, kind: str, value: str, back: bool = False) -> str | None:
        got = self.known.get((kind, value, back), "")
        if got == "":
            got = getattr(self, f"_{kind}")(value, back)
            if len(value) > REMEMBERED_CHARS:
                return got
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[kind, value, back] = got
        return got

    def _all(self, kind: str, value: str, back: bool) -> str:
        s = "".join(c for c in value if c.isascii() and c.isalnum())
        return _fill(value, self.feistel.symbols(s, [_class(c) for c in s], kind.encode(), back))

    def _while(self, x: str, ok, tweak: bytes, back: bool) -> str:
        """Permute digits, walking on until the result is of the same validity."""
        want, y = ok(x), x
        while True:
            y = self.feistel.symbols(y, [string.digits] * len(y), tweak, back)
            if ok(y) == want:
                return y

    def _email(self, value: str, back: bool) -> str:
        local, _, domain = value.rpartition("@")
        cut = ".".join(domain.split(".")[:-2])  # the registered name stays
        done = self._all("email", f"{local}@{cut}", back)
        return done + domain[len(cut) :]

    def _ip(self, value: str, back: bool) -> str | None:
        parts = value.split(".")
        if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
            return None
        low, size = {1: 0, 2: 10, 3: 100}, {1: 10, 2: 90, 3: 156}
        x, n = 0, 1
        for p in parts:
            x, n = x * size[len(p)] + int(p) - low[len(p)], n * size[len(p)]
        x = (self.feistel.invert if back else self.feistel.permute)(x, n, b"ip")
        out = []
        for p in reversed(parts):
            x, r = divmod(x, size[len(p)])
            out.append(str(r + low[len(p)]))
        return ".".join(reversed(out))

    def _iban(self, value: str, back: bool) -> str | None:
        s = value.replace(" ", "")
        if not 15 <= len(s) <= 34 or _iban_check(s[:2], s[4:]) != s[2:4]:
            return None
        bban = self.feistel.symbols(s[4:], [_class(c) for c in s[4:]], s[:2].encode(), back)
        return _fill(value, s[:2] + _iban_check(s[:2], bban) + bban)

    def _card(self, value: str, back: bool) -> str | None:
        s = re.sub("[ -]", "", value)
        if luhn_digit(s[:-1]) != s[-1] or len(set(s)) == 1:
            return None
        body = s[0] + self.feistel.symbols(s[1:-1], [string.digits] * (len(s) - 2), b"card" + s[:1].encode(), back)
        return _fill(value, body + luhn_digit(body))

    def _ssn(self, value: str, back: bool) -> str | None:
        ok = lambda x: x[:3] not in ("000", "666") and x[0] != "9" and x[3:5] != "00" and x[5:] != "0000"
        s = value.replace("-", "")
        return _fill(value, self._while(s, ok, b"ssn", back)) if ok(s) else None

    def _phone(self, value: str, back: bool) -> str:
        head, rest = (value[:2], value[2:]) if value.startswith("+1") else ("", value)
        s = re.sub(r"\D", "", rest)
        return head + _fill(rest, self._while(s, lambda x: x[0] > "1" and x[3] > "1", b"phone", back))

    def _date(self, value: str, back: bool) -> str | None:
        iso, sep = value[4] in "-/.", value[4] if value[4] in "-/." else value[2]
        a, b, c = value.split(sep)
        orders = [lambda d: (d.year, d.month, d.day)] if iso else [lambda d: (d.day, d.month, d.year), lambda d: (d.month, d.day, d.year)]
        tries = [(int(a), int(b), int(c))] if iso else [(int(c), int(b), int(a)), (int(c), int(a), int(b))]
        days = []
        for ymd in tries:
            try:
                days.append((datetime.date(*ymd) - _FIRST_DAY).days)
            except ValueError:
                days.append(-1)
        k = next((k for k, d in enumerate(days) if 0 <= d < _DAYS), None)
        if k is None:
            return None
        day = days[k]
        while True:  # a month-first date stays one that can only be read so, and the other way round
            day = (self.feistel.invert if back else self.feistel.permute)(day, _DAYS, b"date%d" % k)
            d = _FIRST_DAY + datetime.timedelta(day)
            if k == 0 or d.day > 12:
                return _fill(value, "".join(f"{x:04d}" if x > 999 else f"{x:02d}" for x in orders[k](d)))

    def _secret(self, value: str, back: bool) -> str:
        digits = "0123456789abcdef" if value.islower() or value.isdigit() else "0123456789ABCDEF"
        return self.feistel.symbols(value, [digits] * len(value), b"secret", back)


def replaced(text: str, names: Pseudonyms, counts: Counter, back: bool = False) -> str:
    """The text with every validated value replaced."""

    def one(m: re.Match) -> str:
        new = names(m.lastgroup, m[0], back)
        if new is None:
            return m[0]
        counts[m.lastgroup] += 1
        return new

    return _FOUND.sub(one, text)


_NAMES: dict[bytes, Pseudonyms] = {}


def pseudonymise(docs: DataFrame, key: bytes, back: bool = False) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced and pii_counts (kind -> values replaced) added.

    Invalid look-alikes (failed check digits, impossible dates or addresses) stay. ``back`` inverts. A null text stays
    null with no counts; rows are independent, so repeated rows repeat; an empty table gives none; other columns pass
    through, and a column named pii_counts is replaced.
    """
    docs = docs.drop("pii_counts")
    at = docs.columns.index("text")
    kind = pa.map_(pa.string(), pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = _NAMES.get(key) or _NAMES.setdefault(key, Pseudonyms(key))
        for batch in batches:
            for part, _, _ in K.balanced(batch, SLICE_BYTES, batch.schema.names[at]):
                col = part.column(at)
                some = pc.fill_null(pc.match_substring_regex(col, "[0-9@]|[a-f]{32}|[A-F]{32}"), False).to_pylist()
                texts, counts = col.to_pylist(), [[] for _ in some]
                for i, hit in enumerate(some):
                    if hit:
                        found: Counter = Counter()
                        texts[i] = replaced(texts[i], names, found, back)
                        counts[i] = sorted(found.items())
                arrays = list(part.columns)
                arrays[at] = pa.array(texts, col.type)
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(counts, kind)], names=[*part.schema.names, "pii_counts"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("pii_counts", T.MapType(T.StringType(), T.IntegerType()))]))
