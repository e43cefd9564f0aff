"""Language identification, pseudonyms and chat formatting."""

import datetime as dt
import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vigilspark.llm import chat, language_id, pseudonyms
from vigilspark.llm.arrow_text import utf8

from .conftest import rows_of

SMALL = "/root/testdata/sf0.01"


# -- language


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def test_held_out_accuracy(docs):
    net = language_id.fit(docs.where("doc_id % 2 = 0"))
    held = docs.where("doc_id % 2 = 1").toPandas()
    lang, _, _ = language_id.identify(net, pa.array(held["text"].tolist(), pa.string()))
    long = held["text"].str.split().str.len() >= 20
    right = np.array([a == b for a, b in zip(lang, held["lang"])])
    assert right[long].mean() > 0.95


def test_network_is_the_convolution_written_out():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 256, (6, language_id.WINDOW)).astype(np.uint8)
    net = language_id.train(rng.integers(0, 256, (80, language_id.WINDOW)).astype(np.uint8), ["a", "b"] * 40, epochs=1)
    want = []
    for w in x:
        features = []
        for f in range(net.kernel.shape[1]):
            best = -np.inf
            for i in range(len(w)):
                total = 0.0
                for k in range(4):
                    if i + k < len(w):
                        total += float(net.embed[w[i + k]] @ net.kernel[k * language_id.EMBED : (k + 1) * language_id.EMBED, f])
                best = max(best, total)
            features.append(max(0.0, best + float(net.bias[f])))
        z = np.array(features) @ net.dense + net.dense_bias
        z = np.exp(z - z.max())
        want.append(z / z.sum())
    assert np.allclose(language_id.probabilities(net, x), want, atol=1e-4)


def test_identification_written_out(docs):
    net = language_id.fit(docs, sample_docs=20)
    rows = docs.where("doc_id % 9 = 0 and length(text) < 3000").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in language_id.keep_identified(docs, sample_docs=20).select("doc_id").collect()}
    found = {r["doc_id"]: r for r in language_id.identify_languages(docs, sample_docs=20).collect()}
    for r in rows:
        raw, size = r["text"].encode(), language_id.WINDOW
        total = np.zeros(len(net.classes))
        for k in range(0, len(raw), size):
            window = np.frombuffer(raw[k : k + size].ljust(size, b"\0"), np.uint8)
            total += language_id.probabilities(net, window[None])[0] * len(raw[k : k + size])
        p = total / max(1, len(raw))
        best = int(p.argmax())
        keep = bool(raw) and p[best] >= language_id.MIN_CONFIDENCE and not (net.classes[best] == language_id.NOISE and p[best] >= language_id.NOISE_CONFIDENCE)
        one = found[r["doc_id"]]
        assert one["lang_found"] == (net.classes[best] if raw else None) and abs(one["confidence"] - (p[best] if raw else 0)) < 2e-4 and one["windows"] == -(-len(raw) // size)
        assert one["accepted"] == keep == (r["doc_id"] in got)


def test_language_takes_strings_as_identifiers(docs):
    named = docs.withColumn("doc_id", F.concat(F.lit("x"), "doc_id"))
    assert language_id.identify_languages(named).where("accepted").count() > 0.9 * docs.count()


def test_windows_tile_every_byte():
    texts = ["", "ab", "x" * 192, "é" * 500, "z" * 193]
    data, offsets = utf8(pa.array(texts))
    windows, doc, filled = language_id.tile(data, offsets)
    for i, t in enumerate(texts):
        assert b"".join(w.tobytes()[:n] for w, n in zip(windows[doc == i], filled[doc == i])) == t.encode()


def test_language_on_messy_rows(messy, none):
    rows = {(r["doc_id"], r["windows"]): r for r in language_id.identify_languages(messy).collect()}
    assert language_id.identify_languages(messy).count() == messy.count()
    for i in (3, 4, 5):
        r = rows[i, 0]
        assert r["lang_found"] is None and r["confidence"] == 0 and not r["accepted"]
    kept = language_id.keep_identified(messy)
    assert kept.columns == messy.columns and kept.where("text is null or text = ''").count() == 0
    assert language_id.identify_languages(none).count() == language_id.keep_identified(none).count() == 0


def test_nothing_is_identified_without_labels(messy):
    bare = messy.withColumn("lang", F.lit(None).cast("string"))
    assert language_id.identify_languages(bare).where("accepted or lang_found is not null").count() == 0


def test_clean_documents_are_kept_and_noise_goes(spark, docs):
    kept = language_id.keep_identified(docs)
    long = docs.where("size(split(text, ' ')) >= 30")
    assert kept.join(long, "doc_id", "left_semi").count() >= 0.97 * long.count()
    junk = spark.createDataFrame([(-1, "%$#@!" * 300, None), (-2, "0" * 1000, None)], "doc_id long, text string, lang string")
    both = docs.select("doc_id", "text", "lang").union(junk)
    assert language_id.keep_identified(both).where("doc_id < 0").count() == 0


# -- pseudonyms

SAMPLES = {
    "card": ["4111 1111 1111 1111", "5500-0000-0000-0004", "378282246310005"], "phone": ["+1 415 555 2671", "(212) 555-0147", "212-555-0147", "415 555 2671", "4155552671", "+33 6 12 34 56 78", "+49 30 1234 5678", "555.123.4567"], "ssn": ["123-45-6789"],
    "ip": ["192.168.10.77", "8.8.4.4"], "date": ["2021-03-09", "09/03/2021", "12/25/2020", "31.12.1999", "9/3/2021", "9/23/2021", "3.7.1999", "2021-3-9", "09/3/2021", "March 9, 2021", "9 Mar 2021", "DEC 25 1999", "3rd of May 2004", "Jan 09, 2020"], "iban": ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"], "email": ["Jane.Doe99@example.org"],
}


@given(n=st.integers(1, 3000), key=st.text(min_size=1, max_size=5))
@settings(max_examples=20, deadline=None)
def test_feistel_is_a_permutation(n, key):
    net = pseudonyms.Feistel(key, "x", n)
    out = [net.encrypt(i) for i in range(n)]
    assert sorted(out) == list(range(n)) and [net.decrypt(x) for x in out] == list(range(n))


@pytest.mark.parametrize(("kind", "value"), [(k, v) for k, vs in SAMPLES.items() for v in vs])
def test_values_keep_their_format_and_come_back(kind, value):
    there, back = pseudonyms.Pseudonymizer("k"), pseudonyms.Pseudonymizer("k", inverse=True)
    text = f"see {value}; or {value}; again"
    new, found = there.text(text)
    assert found == {kind: 2}
    one = new[4:].split(";")[0]
    assert one != value and new.count(one) == 2
    shape = lambda s: "".join("9" if c.isdigit() else c if not c.isalnum() else "a" for c in s)
    if kind == "date":
        assert re.sub("9+", "9", shape(one)) == re.sub("9+", "9", shape(value)) or value[0].isalpha() or " " in value
    elif kind not in ("ip", "email", "iban"):
        assert shape(one) == shape(value)
    if kind == "card":
        assert pseudonyms.luhn("".join(filter(str.isdigit, one)))
    if kind == "iban":
        assert pseudonyms._mod97(one.replace(" ", "")) == 1
    if value == "2021-03-09":
        dt.date.fromisoformat(one)
    assert back.text(new)[0] == text


def test_what_fails_its_check_stays():
    p = pseudonyms.Pseudonymizer("k")
    for text in ("on 31/2/2021", "Feb 30, 2021", "March 2021", "Mayo 3, 2021", "1155552671", "123456789", "v2021.3.9", "no ssn 12345678", "card 4111 1111 1111 1112", "date 2021-13-40", "ssn 000-12-3456", "version 1.2.3.4.5", "ip 300.1.1.1", "id a1234567890123b", ""):
        assert p.text(text) == (text, {})


def test_equal_values_stay_linked_across_documents(spark):
    d = spark.createDataFrame([(1, "a 123-45-6789"), (2, "b 123-45-6789"), (3, "c 123-45-6780")], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["text"].split()[1] for r in pseudonyms.pseudonymize(d, "k").collect()}
    assert got[1] == got[2] != got[3]


@pytest.mark.parametrize("local", ["ab" * 32, "Jane.Doe99" + "x7" * 45, "a" * 63 + "." + "b" * 63 + "+" + "c" * 70])
def test_a_long_local_part_is_replaced_from_its_beginning(local):
    there, back = pseudonyms.Pseudonymizer("k"), pseudonyms.Pseudonymizer("k", inverse=True)
    text = f"to ..{local}@example.org, b@x.com"
    new, found = there.text(text)
    assert found == {"email": 2} and back.text(new)[0] == text
    one = new.split("..")[1].split("@")[0]
    assert len(one) == len(local) and all(one[k : k + 20] != local[k : k + 20] for k in range(len(local) - 20))


def _permuted(key: str, kind: str, n: int, x: int, ok=lambda v: True) -> int:
    """The Feistel network written out again."""
    half = math.isqrt(n - 1) + 1
    secret = hashlib.blake2b(f"{kind}\n{n}".encode(), key=hashlib.blake2b(key.encode()).digest(), digest_size=32).digest()
    width = (half.bit_length() + 7) // 8
    while True:
        left, right = divmod(x, half)
        for i in range(8):
            left, right = right, (left + int.from_bytes(hashlib.shake_256(secret + bytes([i]) + right.to_bytes(width + 1, "big")).digest(width + 16), "big")) % half
        x = left * half + right
        if x < n and ok(x):
            return x


def _refilled(text: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in text)


def _brute(text: str, key: str) -> tuple[str, Counter]:
    """Every substring that begins at a digit, '+', '(' or an address is held against plain checks; the first that is one, and of those the longest, is replaced."""
    shapes = {
        "date": r"(19|20)\d\d-\d\d-\d\d|\d\d/\d\d/(19|20)\d\d", "ssn": r"\d{3}-\d{2}-\d{4}", "ip": r"\d+\.\d+\.\d+\.\d+", "card": r"\d{13,19}|\d{4}([ -]\d{4}){2}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5}",
        "phone": r"\(\d{3}\) ?\d{3}-\d{4}|\d{3}[-. ]\d{3}[-. ]\d{4}|\+\d{1,3}[ -]?\(?\d{2,4}\)?[ -]?\d{3,4}[ -]?\d{3,4}|[2-9]\d\d[2-9]\d{6}",
    }

    def replaced(kind: str, s: str) -> str | None:
        d = "".join(filter(str.isdigit, s))
        if kind == "ssn":
            ok = lambda v: v // 10**6 not in (0, 666) and v < 900 * 10**6 and v // 10**4 % 100 > 0 and v % 10**4 > 0
            return _refilled(s, f"{_permuted(key, 'ssn', 10**9, int(d), ok):09}") if ok(int(d)) else None
        if kind == "ip":
            parts = [int(x) for x in s.split(".")]
            if any(p > 255 for p in parts) or any(x != str(int(x)) for x in s.split(".")):
                return None
            home = parts[0] in (0, 127)
            v = _permuted(key, "ip", 2**32, int.from_bytes(bytes(parts), "big"), lambda v: (v >> 24 in (0, 127)) == home)
            return ".".join(map(str, v.to_bytes(4, "big")))
        if kind == "card":
            check = lambda t: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(t))) % 10
            if check(d) or len(set(d)) == 1:
                return None
            body = d[0] + f"{_permuted(key, 'card', 10 ** (len(d) - 2), int(d[1:-1])):0{len(d) - 2}}"
            return _refilled(s, body + next(c for c in "0123456789" if not check(body + c)))
        if kind == "phone":
            tail = d[-10:]
            return _refilled(s, d[: -len(tail)] + f"{_permuted(key, 'phone', 10 ** len(tail), int(tail)):0{len(tail)}}") if 7 <= len(d) <= 15 else None
        a, b, c = (int(x) for x in re.split("[-/]", s))
        us = "/" in s and b > 12
        try:
            day = dt.date(a, b, c) if "-" in s else dt.date(c, a, b) if us else dt.date(c, b, a)
        except ValueError:
            return None
        zero = dt.date(1900, 1, 1)
        v = zero + dt.timedelta(_permuted(key, "date us" if us else "date", 73_049, (day - zero).days, lambda v: not us or (zero + dt.timedelta(v)).day > 12))
        return v.strftime("%Y-%m-%d" if "-" in s else "%m/%d/%Y" if us else "%d/%m/%Y")

    def local(name: str, domain: str) -> str:
        kinds = [(10, "0") if c.isdigit() else (26, "a") if c.islower() else (26, "A") if c.isalpha() else None for c in name]
        n, x = 1, 0
        for c, k in zip(name, kinds):
            if k:
                n, x = n * k[0], x * k[0] + ord(c) - ord(k[1])
        x = _permuted(key, f"email {domain.lower()} " + " ".join(f"{k[0]}{k[1]}" if k else "0" for k in kinds), n, x)
        out = []
        for c, k in zip(reversed(name), reversed(kinds)):
            if k:
                x, r = divmod(x, k[0])
                c = chr(ord(k[1]) + r)
            out.append(c)
        return "".join(reversed(out))

    out, found, i = [], Counter(), 0
    while i < len(text):
        best = None
        if text[i].isalnum() and (m := re.compile(r"([A-Za-z0-9][\w.%+-]*)@((?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,})", re.A).match(text, i)):
            best = (m.end(), "email", f"{local(m[1], m[2])}@{m[2]}")
        elif text[i] in "+(0123456789" and not (i and (text[i - 1].isalnum() or text[i - 1] == "_")) and not (i > 1 and text[i - 1] in ".-/+" and text[i - 2].isdigit()):
            for j in range(min(len(text), i + 24), i + 6, -1):
                if text[j - 1].isdigit() and not (j < len(text) and (text[j].isalnum() or text[j] == "_")) and not (j + 1 < len(text) and text[j] in ".-/" and text[j + 1].isdigit()):
                    best = next(((j, k, r) for k, p in shapes.items() if re.fullmatch(p, text[i:j], re.A) and (r := replaced(k, text[i:j])) is not None), None)
                    if best:
                        break
        if best:
            out.append(best[2])
            found[best[1]] += 1
            i = best[0]
        else:
            out.append(text[i])
            i += 1
    return "".join(out), found


def test_pseudonyms_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("length(text) < 30000")
    got = pseudonyms.pseudonymize(docs, "k").collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(got) == len(texts) and sum(sum(r[k] for k in pseudonyms.KINDS) for r in got) > 20
    for r in got:
        assert (r["text"], {k: r[k] for k in pseudonyms.KINDS if r[k]}) == _brute(texts[r["doc_id"]], "k"), r["doc_id"]


def test_a_value_in_a_very_long_text(spark):
    pad = "many words " * 50_000
    d = spark.createDataFrame([(1, f"{pad}123-45-6789 {pad}a.b@c.org"), (2, pad), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pseudonyms.pseudonymize(d, "k").collect()}
    assert (got[1]["ssn"], got[1]["email"]) == (1, 1) and "123-45-6789" not in got[1]["text"] and len(got[1]["text"]) == 2 * len(pad) + 21
    assert got[2]["text"] == pad and got[3]["text"] is None and got[3]["card"] == 0
    with pytest.raises(ValueError):
        pseudonyms.pseudonymize(d, "").collect()


def test_pseudonyms_on_messy_rows(messy, none):
    got = pseudonyms.pseudonymize(messy, "k")
    assert rows_of(got.select("doc_id", "text")) == rows_of(messy.select("doc_id", "text"))
    assert got.agg(F.sum("card")).first()[0] == 0 and pseudonyms.pseudonymize(none, "k").count() == 0


# -- chat


def _format(spark, rows, template=chat.TURN_MARKS):
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return [tuple(r) for r in chat.format_chats(d, template).orderBy("conv_id", "segment").collect()]


def test_segments_and_loss_flags(spark):
    got = _format(spark, [(1, 3, "assistant", "yes"), (1, 1, "system", ""), (1, 2, "user", "hi")])
    assert "".join(r[3] for r in got) == "<|system|>\n<|end|>\n<|user|>\nhi<|end|>\n<|assistant|>\nyes<|end|>\n<|done|>"
    assert [r[4] for r in got] == [0, 0, 0, 0, 0, 0, 0, 1, 1, 1] and [r[1] for r in got] == list(range(10))


@pytest.mark.parametrize(("turns", "error"), [
    ([(None, "user", "a"), (2, "assistant", "b")], "turn missing"), ([(1, None, "a")], "role missing"), ([(1, "user", None), (2, "assistant", "b")], "text missing"),
    ([(1, "user", "a"), (1, "user", "b")], "turn repeated"), ([(1, "robot", "a")], "role unknown"), ([(1, "assistant", "a")], "order"), ([(1, "user", "a")], "order"),
    ([(1, "user", "a"), (2, "user", "b")], "order"), ([(1, "user", "a"), (2, "system", "b"), (3, "assistant", "c")], "order"),
])
def test_errors(spark, turns, error):
    assert _format(spark, [(7, *t) for t in turns]) == [(7, -1, None, None, None, error)]


def test_chat_repeated_rows_nulls_and_clashing_columns(spark):
    rows = [(1, 1, "user", "a", 5, "x"), (1, 1, "user", "a", 6, "y"), (1, 9, "assistant", "b" * 200_000, None, None), (None, 1, "user", "a", 1, "z")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segment long, turns string")
    got = chat.format_chats(d).orderBy("segment").collect()
    assert len(got) == 7 and got[4]["text"] == "b" * 200_000 and {r["conv_id"] for r in got} == {1}
    assert chat.format_chats(d.limit(0)).count() == 0


def test_another_template(spark):
    t = chat.Template("s", ("q",), {("s", "q"): "q", ("q", "q"): "q"}, {"q": (("Q:", 0), (chat.TEXT, 1))}, opening=(("<s>", 0),))
    assert [r[3] for r in _format(spark, [(1, 1, "q", "x"), (1, 2, "q", "y")], t)] == ["<s>", "Q:", "x", "Q:", "y"]
