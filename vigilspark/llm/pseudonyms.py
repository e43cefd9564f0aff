"""Format-preserving pseudonyms for personal data in text.

Numbers and dates that pass the checks of their kind are replaced by others of the same format: a
Feistel network keyed by a secret permutes the values of the kind, and check digits are made anew.
The permutation doesn't hang on the document, so equal values stay equal and linked across the
corpus, and whoever has the key can invert it.

Kinds: payment card (Luhn), phone, social security number, IPv4 address, calendar date in figures or
with the English name of its month, IBAN (mod 97), and e-mail address, whose local part is permuted as a
number over its own letters and digits. Every kind has a digit or an '@', so other texts stay in the JVM.
"""

from __future__ import annotations

import datetime as dt
import functools
import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Characters of a local part that are permuted as one number.
LOCAL_PIECE = 64
KINDS = ("card", "phone", "ssn", "ip", "date", "iban", "email")


class Feistel:
    """A keyed permutation of 0 .. n - 1: a balanced network on digits of base ceil(sqrt(n)), walked until it is back below n."""

    def __init__(self, key: str, kind: str, n: int):
        self.n, self.half = n, max(2, math.isqrt(max(0, n - 1)) + 1)
        self.key = hashlib.blake2b(f"{kind}\n{n}".encode(), key=hashlib.blake2b(key.encode()).digest(), digest_size=32).digest()

    def _f(self, i: int, x: int) -> int:
        # 16 bytes more than the half has, so that the remainder is even
        size = (self.half.bit_length() + 7) // 8 + 16
        out = hashlib.shake_256(self.key + bytes([i]) + x.to_bytes((self.half.bit_length() + 7) // 8 + 1, "big"))
        return int.from_bytes(out.digest(size), "big")

    def _once(self, x: int, rounds: range, sign: int) -> int:
        a, b = divmod(x, self.half)
        for i in rounds:
            if sign > 0:
                a, b = b, (a + self._f(i, b)) % self.half
            else:
                a, b = (b - self._f(i, a)) % self.half, a
        return a * self.half + b

    def encrypt(self, x: int) -> int:
        return self._walk(x, range(ROUNDS), 1)

    def decrypt(self, x: int) -> int:
        return self._walk(x, range(ROUNDS - 1, -1, -1), -1)

    def _walk(self, x: int, rounds: range, sign: int) -> int:
        if self.n < 2:
            return x
        x = self._once(x, rounds, sign)
        while x >= self.n:
            x = self._once(x, rounds, sign)
        return x


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def luhn_digit(payload: str) -> str:
    return next(c for c in "0123456789" if luhn(payload + c))


def _mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _refill(shape: str, digits: str) -> str:
    """The digits in the places of those of ``shape``."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


_DAY0, _DAYS = dt.date(1900, 1, 1).toordinal(), 73_049  # to 2099-12-31
_DATE = re.compile(r"(?P<y>\d{4})(?P<s>[-/.])(?P<m>\d{1,2})(?P=s)(?P<d>\d{1,2})|(?P<d2>\d{1,2})(?P<s2>[-/.])(?P<m2>\d{1,2})(?P=s2)(?P<y2>\d{4})", re.ASCII)
_MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
_MONTH_OF = {n.lower(): i for i, n in enumerate(_MONTHS, 1)} | {n[:3].lower(): i for i, n in enumerate(_MONTHS, 1)}
_NAME = "|".join(sorted(_MONTH_OF, key=len, reverse=True))
_NAMED = rf"(?:(?P<m>{_NAME})\.? (?P<d>\d{{1,2}})(?P<o>st|nd|rd|th)?|(?P<d2>\d{{1,2}})(?P<o2>st|nd|rd|th)? (?:of )?(?P<m2>{_NAME})\.?),? "
_NAMED_DATE = re.compile(_NAMED + r"(?P<y>\d{4})", re.I | re.ASCII)
_BEFORE_YEAR = re.compile(rf"(?<![^\W_]){_NAMED}$", re.I | re.ASCII)
_YEAR = re.compile(r"(?:19|20)\d{2}(?![^\W_])", re.ASCII)
_MIXED = {"0123456789": 10, "abcdefghijklmnopqrstuvwxyz": 26, "ABCDEFGHIJKLMNOPQRSTUVWXYZ": 26}


class Pseudonymizer:
    def __init__(self, key: str, inverse: bool = False):
        if not key:
            raise ValueError("a secret key is required")
        self.key, self.inverse = key, inverse
        self.network = functools.lru_cache(4096)(lambda kind, n: Feistel(key, kind, n))
        self.replaced = functools.lru_cache(1 << 16)(self._replaced)

    def _step(self, kind: str, n: int, x: int) -> int:
        net = self.network(kind, n)
        return net.decrypt(x) if self.inverse else net.encrypt(x)

    def _until(self, kind: str, n: int, x: int, valid) -> int:
        """Walk until the value is valid again; x is valid, so the walk ends, and it can be walked back."""
        x = self._step(kind, n, x)
        while not valid(x):
            x = self._step(kind, n, x)
        return x

    def _digits(self, kind: str, digits: str) -> str:
        return str(self._step(kind, 10 ** len(digits), int(digits))).zfill(len(digits))

    # each: the replacement, or None where the text is not of the kind

    def card(self, s: str) -> str | None:
        digits = re.sub(r"\D", "", s)
        if not 13 <= len(digits) <= 19 or len(set(digits)) < 2 or not luhn(digits):
            return None
        payload = digits[0] + self._digits("card", digits[1:-1])
        return _refill(s, payload + luhn_digit(payload))

    def phone(self, s: str) -> str | None:
        digits = re.sub(r"\D", "", s)
        if not 7 <= len(digits) <= 15:
            return None
        keep = len(digits) - 10 if len(digits) > 10 else 0  # the country's part stays
        return _refill(s, digits[:keep] + self._digits("phone", digits[keep:]))

    def ssn(self, s: str) -> str | None:
        def valid(x: int) -> bool:
            area, group, serial = x // 10**6, x // 10**4 % 100, x % 10**4
            return area not in (0, 666) and area < 900 and group > 0 and serial > 0

        x = int(re.sub(r"\D", "", s))
        return _refill(s, str(self._until("ssn", 10**9, x, valid)).zfill(9)) if valid(x) else None

    def ip(self, s: str) -> str | None:
        parts = s.split(".")
        if any(int(p) > 255 or str(int(p)) != p for p in parts):
            return None
        x = functools.reduce(lambda a, p: a * 256 + int(p), parts, 0)
        home = x >> 24 not in (0, 127)
        x = self._until("ip", 1 << 32, x, lambda v: (v >> 24 not in (0, 127)) == home)
        return ".".join(str(x >> k & 255) for k in (24, 16, 8, 0))

    def date(self, s: str) -> str | None:
        m = _DATE.fullmatch(s)
        if m is None:
            return self._named_date(s)
        y, mo, d = (m[k] or m[k + "2"] for k in ("y", "m", "d"))
        american = bool(m["y2"]) and int(mo) > 12 and m["s2"] == "/"
        if american:
            mo, d = d, mo
        # what was written decides how it is read back: in two figures, in as few as it takes, or one so and one so
        zeros, short = [x[0] == "0" for x in (mo, d)], [len(x) == 1 for x in (mo, d)]
        mixed = any(zeros) and any(short)

        def valid(new: dt.date) -> bool:
            if american and new.day < 13:  # month first is only told by a day above 12
                return False
            if mixed:
                return (new.month < 10) == (int(mo) < 10) and (new.day < 10) == (int(d) < 10)
            return not any(short) or new.month < 10 or new.day < 10

        new = self._day("date us" if american else "date", int(y), int(mo), int(d), valid)
        if new is None:
            return None
        wide = zeros if mixed else [not any(short)] * 2
        month, day = (f"{v:02}" if w else str(v) for v, w in zip((new.month, new.day), wide))
        if m["y"]:
            return f"{new.year:04}{m['s']}{month}{m['s']}{day}"
        return m["s2"].join((month, day) if american else (day, month)) + f"{m['s2']}{new.year:04}"

    def _day(self, kind: str, year: int, month: int, day: int, valid) -> dt.date | None:
        """Another day for which ``valid`` holds, as it has to for this one."""
        try:
            x = dt.date(year, month, day)
        except ValueError:
            return None
        of = lambda v: dt.date.fromordinal(v + _DAY0)
        if not 0 <= x.toordinal() - _DAY0 < _DAYS or not valid(x):
            return None
        return of(self._until(kind, _DAYS, x.toordinal() - _DAY0, lambda v: valid(of(v))))

    def _named_date(self, s: str) -> str | None:
        m = _NAMED_DATE.fullmatch(s)
        if m is None:
            return None
        name, day, ending = (k if m[k] is not None else k + "2" for k in ("m", "d", "o"))
        full = m[name].lower() in map(str.lower, _MONTHS)  # May counts as full, so a short name is never May
        zero = m[day][0] == "0"
        new = self._day("date", int(m["y"]), _MONTH_OF[m[name].lower()], int(m[day]), lambda v: (full or v.month != 5) and (not zero or v.day < 10))
        if new is None:
            return None
        word = _MONTHS[new.month - 1] if full else _MONTHS[new.month - 1][:3]
        word = word.upper() if m[name].isupper() else word.lower() if m[name].islower() else word
        parts = [(m.span(name), word), (m.span(day), f"{new.day:02}" if zero else str(new.day)), (m.span("y"), str(new.year))]
        if m[ending] is not None:
            parts.append((m.span(ending), "th" if 10 < new.day < 14 else {1: "st", 2: "nd", 3: "rd"}.get(new.day % 10, "th")))
        for (i, j), text in sorted(parts, reverse=True):
            s = s[:i] + text + s[j:]
        return s

    def iban(self, s: str) -> str | None:
        plain = s.replace(" ", "")
        if not 15 <= len(plain) <= 34 or _mod97(plain) != 1:
            return None
        body = plain[:2] + "00" + self._mixed("iban", plain[4:])
        new = iter(body[:2] + f"{98 - _mod97(body):02}" + body[4:])
        return "".join(c if c == " " else next(new) for c in s)

    def email(self, s: str) -> str | None:
        local, _, domain = s.rpartition("@")
        # pieces from the end, so that the numbers stay short however long the text
        pieces = [local[max(0, k - LOCAL_PIECE) : k] for k in range(len(local), 0, -LOCAL_PIECE)]
        return f"{''.join(self._mixed('email ' + domain.lower(), x) for x in reversed(pieces))}@{domain}"

    def _mixed(self, kind: str, s: str) -> str:
        """Letters and digits permuted together as one number of mixed base; anything else stays."""
        sets = [next((a for a in _MIXED if c in a), "") for c in s]
        n, x = 1, 0
        for c, a in zip(s, sets):
            if a:
                n, x = n * len(a), x * len(a) + a.index(c)
        x, out = self._step(f"{kind} {' '.join(str(len(a)) + a[:1] for a in sets)}", n, x), []
        for c, a in zip(reversed(s), reversed(sets)):
            if a:
                x, r = divmod(x, len(a))
                c = a[r]
            out.append(c)
        return "".join(reversed(out))

    # -- texts

    def _replaced(self, kind: str, s: str) -> str | None:
        return getattr(self, kind)(s)

    def text(self, text: str) -> tuple[str, dict[str, int]]:
        """The text with every valid value replaced, and how many of each kind."""
        found: dict[str, int] = {}
        spans: list[tuple[int, int, str]] = []
        if "@" in text:
            for m in _AT.finditer(text):
                left, right = _LOCAL.search(text, _local_from(text, m.start()), m.start()), _DOMAIN.match(text, m.end())
                if left and right:
                    spans.append((left.start(), right.end(), "email"))
        if _DIGIT.search(text):
            for m in _IBAN.finditer(text):
                for end in _cuts(m.group()):
                    if self.replaced("iban", end) is not None:
                        spans.append((m.start(), m.start() + len(end), "iban"))
                        break
            for m in _YEAR.finditer(text):
                left = _BEFORE_YEAR.search(text, max(0, m.start() - 32), m.start())
                if left and self.replaced("date", text[left.start() : m.end()]) is not None:
                    spans.append((left.start(), m.end(), "date"))
            for chunk in _CHUNK.finditer(text):
                at = chunk.start()
                while m := _VALUE.search(text, at, chunk.end()):
                    kind = m.lastgroup
                    if not _inside(text, m) and self.replaced(kind, m.group()) is not None:
                        spans.append((m.start(), m.end(), kind))
                        at = m.end()
                    else:
                        at = m.start() + 1
                        while at < chunk.end() and text[at - 1].isdigit() and text[at].isdigit():
                            at += 1
        if not spans:
            return text, found
        out, last = [], 0
        for a, b, kind in sorted(spans, key=lambda s: (s[0], -s[1])):
            if a < last:
                continue
            new = self.replaced(kind, text[a:b])
            out += [text[last:a], new]
            last = b
            found[kind] = found.get(kind, 0) + 1
        return "".join([*out, text[last:]]), found


_DIGIT, _AT = re.compile(r"[0-9]"), re.compile(r"@")
_LOCAL = re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]*$")
_LOCAL_MORE = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_CHUNK = re.compile(r"[+(0-9][0-9()+./ -]*[0-9]")
_VALUE = re.compile(
    r"(?P<date>\d{4}-\d{1,2}-\d{1,2}(?!\d)|\d{4}/\d{1,2}/\d{1,2}(?!\d)|\d{4}\.\d{2}\.\d{2}(?!\d)|\d{1,2}-\d{1,2}-\d{4}(?!\d)|\d{1,2}/\d{1,2}/\d{4}(?!\d)|\d{1,2}\.\d{1,2}\.\d{4}(?!\d))"
    r"|(?P<ip>\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})"
    r"|(?P<ssn>\d{3}-\d{2}-\d{4}|(?i:(?<=ssn )|(?<=ssn: )|(?<=ssn:)|(?<=ssn #)|(?<=ssn#))(?:\d{9}(?!\d)|\d{3} \d{2} \d{4}(?!\d)))"
    r"|(?P<phone>\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|\+\d{1,3}[ .-]\d{1,2}(?:[ .-]\d{2}){3,5}(?!\d)|\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4}|\d{3} \d{3} \d{4}(?!\d)|[2-9]\d{2}[2-9]\d{6}(?!\d))"
    r"|(?P<card>\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})",
    re.ASCII,
)


def _local_from(text: str, end: int) -> int:
    """Where the characters of a local part begin that go up to ``end``, or up to a line's end just before it."""
    at = end - 1 if text[end - 1 : end] == "\n" else end
    while at and text[at - 1] in _LOCAL_MORE:
        at -= 1
    return at


def _inside(text: str, m: re.Match) -> bool:
    """Whether the match is a part of something longer: a word, a number, a version."""
    before, after = text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
    if before.isalnum() or after.isalnum() or before == "_" or after == "_":
        return True
    if after in (".", "-", "/") and text[m.end() + 1 : m.end() + 2].isdigit():
        return True
    return before in (".", "-", "/", "+") and text[m.start() - 2 : m.start() - 1].isdigit() and m.start() > 1


def _cuts(s: str):
    """Beginnings of a possible IBAN, longest first, at ends of its groups."""
    yield s
    for i in range(len(s) - 1, 14, -1):
        yield s[:i].rstrip(" ")


def _struct() -> pa.DataType:
    return pa.struct([("text", pa.string()), *((k, pa.int32()) for k in KINDS)])


def replacer(key: str):
    """Column function: text -> struct(text, number of each kind)."""
    Pseudonymizer(key)  # a missing key is told here and not by a worker

    @F.arrow_udf("text string, " + ", ".join(f"{k} int" for k in KINDS))
    def replace(column: pa.Array) -> pa.Array:
        worker, texts, counts = _worker(key), [], {k: [] for k in KINDS}
        for text in column.to_pylist():
            new, found = (None, {}) if text is None else worker.text(text)
            texts.append(new)
            for k in KINDS:
                counts[k].append(found.get(k, 0))
        return pa.StructArray.from_arrays([pa.array(texts, pa.string()), *(pa.array(counts[k], pa.int32()) for k in KINDS)], fields=list(_struct()))

    return replace


@functools.lru_cache(8)
def _worker(key: str) -> Pseudonymizer:
    return Pseudonymizer(key)


def pseudonymize(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, card, phone, ssn, ip, date, iban, email): each row's text with its values replaced, and how many.

    ``key`` is the secret: whoever has it can invert the result. Null texts stay null, empty ones empty,
    both with counts 0. Texts are searched whole, however long. Numbers that fail their check, and
    digits inside longer words or numbers, stay as they are. Of values that overlap, the one that begins
    first counts, the longer of two. Nine bare digits are a social security number only after 'SSN', ten
    are a phone if area and exchange begin with 2 to 9. Identifiers may be of any type or null. Repeated
    rows give equal results; other columns aren't read, whatever their names; an empty table gives no rows.
    """
    text = F.col(text_col).cast("string")
    # every kind has a digit or an '@': other texts aren't sent to Python
    found = replacer(key)(F.when(text.rlike("[0-9@]"), text))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("whole"), found.alias("found"))
    parts: list[Column] = [F.coalesce("found.text", "whole").alias("text"), *[F.coalesce(f"found.{k}", F.lit(0)).alias(k) for k in KINDS]]
    return rows.select("doc_id", *parts)
