"""Column functions that stay inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigilspark.catalog import COMMON_PASSWORDS, KNOWN_COMMANDS, SSH_FAMILIES, java


def quoted(text: str) -> str:
    """A SQL string literal. Large expressions are built as SQL, since every Column call goes to the JVM by itself."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def hits_sql(text: str, pattern: str) -> str:
    """As ``hits``, as SQL."""
    return f"coalesce(rlike({text}, {quoted(java(pattern))}), false)"


def hits(text: Column, pattern: str) -> Column:
    """Whether the catalog pattern occurs; false for null."""
    return F.coalesce(text.rlike(java(pattern)), F.lit(False))


def occurrences(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(java(pattern))), F.lit(0)).cast("long")


def rounded(x: Column, digits: int) -> Column:
    """Half to even on the exact binary value, as Python rounds; Spark's own functions round the decimal text."""
    return F.replace(F.format_number(x, digits), F.lit(","), F.lit("")).try_cast("double")


def fixed(x: Column, digits: int) -> Column:
    """The text of ``rounded``."""
    return F.replace(F.format_number(x, digits), F.lit(","), F.lit(""))


def ratio(a: Column, b: Column) -> Column:
    """a / b as double, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def seconds_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1e6)


def iso(ts: Column) -> Column:
    """ISO 8601 with offset; no fraction where it is 0."""
    return F.when(F.unix_micros(ts) % 1_000_000 == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'"))


# -- addresses


def ip_number(ip: Column) -> Column:
    """IPv4 as a whole number, null if it isn't one."""
    parts = [F.split_part(ip, F.lit("."), F.lit(i)).try_cast("int") for i in (1, 2, 3, 4)]
    valid = ip.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & reduce(Column.__and__, [p <= 255 for p in parts])
    return F.when(valid, reduce(lambda a, p: a * 256 + p, parts, F.lit(0).cast("long")))


def is_private(ip: Column) -> Column:
    """By prefix: 10., 192.168., 172.16. to 172.31., 127. and 0."""
    plain = reduce(Column.__or__, [ip.startswith(p) for p in ("10.", "192.168.", "127.", "0.")])
    middle = ip.startswith("172.") & F.split_part(ip, F.lit("."), F.lit(2)).try_cast("int").between(16, 31)
    return F.coalesce(plain | F.coalesce(middle, F.lit(False)), F.lit(False))


# -- credentials and clients


def ssh_family(version: Column) -> Column:
    low, out = F.lower(version), F.lit("other")
    for part, family, _ in reversed(SSH_FAMILIES):
        out = F.when(low.contains(part), family).otherwise(out)
    return F.when(F.coalesce(version, F.lit("")) == "", "unknown").otherwise(out)


def ssh_family_code(family: Column) -> Column:
    out = F.when(family == "unknown", 0)
    for _, name, code in SSH_FAMILIES:
        out = out.when(family == name, code)
    return out.otherwise(1)


def is_common_password(password: Column) -> Column:
    return F.coalesce(F.lower(password).isin(*COMMON_PASSWORDS), F.lit(False))


# -- commands


def first_word(text: Column) -> Column:
    """First run of characters that aren't blanks, empty if there is none."""
    return F.regexp_extract(text, java("%"), 0)


def looks_like_typo(command: Column) -> Column:
    """First word, without dots and slashes around it, is no known command but within two edits of one."""
    word = F.lower(F.regexp_replace(first_word(command), r"^[./]+|[./]+$", ""))
    known = F.expr("array(" + ", ".join(map(quoted, KNOWN_COMMANDS)) + ")")
    near = F.exists(known, lambda k: F.levenshtein(word, k, 2) >= 0)
    return F.when(F.length(word).between(1, 20), F.when(F.array_contains(known, word), False).otherwise(near)).otherwise(False)


def is_suspicious(command: Column) -> Column:
    """Longer than 50 characters, or with a character that has a meaning to the shell."""
    return F.coalesce((F.length(command) > 50) | command.rlike(r"[|<>;&$`]"), F.lit(False))


def command_bucket(n: Column) -> Column:
    return F.when(n == 0, "0").when(n <= 5, "1-5").when(n <= 20, "6-20").otherwise("21+")


def decoded_payloads(command: Column) -> Column:
    """Texts of the base64 runs in a command: valid UTF-8, over four fifths printable."""
    runs = F.regexp_extract_all(command, F.lit("([A-Za-z0-9+/]{8,}={0,2})"), F.lit(1))

    def text(run: Column) -> Column:
        data = F.rtrim(run, F.lit("="))
        marks, over = F.length(run) - F.length(data), F.length(data) % 4
        whole = F.when(over == 0, data).when((over == 2) & (marks == 2), F.concat(data, F.lit("=="))).when((over == 3) & (marks >= 1), F.concat(data, F.lit("=")))
        raw = F.try_to_binary(whole, F.lit("base64"))
        said = F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string"))
        shown = F.regexp_count(said, F.lit(r"[^\p{C}\p{Z}]|[ \n\r\t]"))
        return F.when(shown > F.length(said) * 0.8, said)

    return F.filter(F.transform(runs, text), lambda x: x.isNotNull() & (x != ""))


# -- names of tactics: each report compares them in its own way


def tactic_plain(t: Column) -> Column:
    return F.trim(F.coalesce(t, F.lit("")))


def tactic_loose(t: Column) -> Column:
    """Lower case, without '(failed)'."""
    return F.trim(F.replace(F.lower(tactic_plain(t)), F.lit("(failed)"), F.lit("")))
