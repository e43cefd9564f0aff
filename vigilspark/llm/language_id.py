"""Language identification by a convolutional network over bytes.

Fixed windows of ``WINDOW`` bytes tile the whole text. Bytes are embedded, convolved by filters of
several widths, max-pooled over the window and classified by softmax. The network is trained here,
in numpy, on a bounded sample of labelled rows; a further class of made-up noise stands for text in
no language. A document's probabilities are the means over its windows by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow_text import utf8

WINDOW, EMBED, WIDTHS, FILTERS = 192, 8, (2, 3, 4), 12
#: The sample's bound: documents of each language, which are read whole; windows that a document counts as at most, however long.
SAMPLE_DOCS, DOCUMENT_WEIGHT = 250, 4.0
#: A document is rejected as noise from this mean probability on, or if no class reaches the second one.
NOISE, NOISE_CONFIDENCE, MIN_CONFIDENCE = "und", 0.6, 0.35
_REACH = max(WIDTHS)


@dataclass
class Network:
    """Embedding (256, e), filters of all widths as one matrix (reach * e, f), their bias, and the softmax layer."""

    classes: list[str]
    embed: np.ndarray
    kernel: np.ndarray
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray


def _mask() -> np.ndarray:
    """Ones where a filter of its width has a weight."""
    return np.concatenate([np.repeat(np.arange(_REACH) < w, EMBED)[:, None].repeat(FILTERS, 1) for w in WIDTHS], 1).astype(np.float32)


def patches(net: Network, windows: np.ndarray) -> np.ndarray:
    """(windows * positions, reach * e): what the filters see at each position; bytes past the end are 0."""
    n, w = windows.shape
    x = np.zeros((n, w + _REACH - 1, EMBED), np.float32)
    np.take(net.embed, windows, axis=0, out=x[:, :w], mode="clip")
    s = x.strides
    view = np.lib.stride_tricks.as_strided(x, (n, w, _REACH * EMBED), (s[0], s[1], s[2]))
    return np.ascontiguousarray(view).reshape(n * w, -1)


def pooled(net: Network, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rectified maximum of each filter over each window, and where it is."""
    y = (patches(net, windows) @ net.kernel).reshape(len(windows), windows.shape[1], -1)
    at = y.argmax(1)
    return np.maximum(np.take_along_axis(y, at[:, None], 1)[:, 0] + net.bias, 0), at


def probabilities(net: Network, windows: np.ndarray, block: int = 64) -> np.ndarray:
    out = np.empty((len(windows), len(net.classes)), np.float32)
    for i in range(0, len(windows), block):
        part = windows[i : i + block]
        y = (patches(net, part) @ net.kernel).reshape(len(part), part.shape[1], -1).max(1)
        z = np.maximum(y + net.bias, 0) @ net.dense + net.dense_bias
        z = np.exp(z - z.max(1, keepdims=True))
        out[i : i + block] = z / z.sum(1, keepdims=True)
    return out


def noise_windows(n: int, rng: np.random.Generator) -> np.ndarray:
    """Windows in no language: random bytes, printable characters, digits, symbols, base 64, one repeated byte."""
    kinds = [
        np.arange(1, 256), np.arange(33, 127), np.frombuffer(b"0123456789", np.uint8), np.frombuffer(b"0123456789abcdef", np.uint8),
        np.frombuffer(b"!#$%&*+-/<=>@[]^_{|}~ ", np.uint8), np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8),
    ]
    out = np.zeros((n, WINDOW), np.uint8)
    for i in range(n):
        k = i % (len(kinds) + 1)
        out[i] = rng.choice(kinds[k], WINDOW) if k < len(kinds) else rng.integers(33, 256)
        if rng.random() < 0.5:
            out[i, rng.random(WINDOW) < 0.15] = 32
    return out


def train(windows: np.ndarray, labels: list[str], weights: np.ndarray | None = None, epochs: int = 6, rate: float = 4e-3, batch: int = 64, seed: int = 7) -> Network:
    """Adam on cross-entropy, windows by their ``weights``. A quarter of the windows of a batch are cut short, as short texts are."""
    rng = np.random.default_rng(seed)
    classes = sorted(set(labels)) + [NOISE]
    weights = np.ones(len(labels)) if weights is None else weights
    extra = noise_windows(max(64, int(weights.sum()) // max(1, len(classes) - 1)), rng)
    weights = np.concatenate([weights, np.ones(len(extra))]).astype(np.float32)
    x = np.concatenate([windows.reshape(-1, WINDOW), extra])
    y = np.array([classes.index(c) for c in labels] + [len(classes) - 1] * len(extra))
    f, c = FILTERS * len(WIDTHS), len(classes)
    net = Network(
        classes, rng.normal(0, 0.3, (256, EMBED)).astype(np.float32), (rng.normal(0, 0.25, (_REACH * EMBED, f)) * _mask()).astype(np.float32),
        np.zeros(f, np.float32), rng.normal(0, 0.2, (f, c)).astype(np.float32), np.zeros(c, np.float32),
    )
    net.embed[0] = 0
    names, mask, step = ("embed", "kernel", "bias", "dense", "dense_bias"), _mask(), 0
    first = {k: np.zeros_like(getattr(net, k)) for k in names}
    second = {k: np.zeros_like(getattr(net, k)) for k in names}
    share = np.bincount(y, weights, minlength=c)
    weights *= (weights.sum() / np.maximum(1, share) / c).astype(np.float32)[y] * len(y) / weights.sum()
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // batch)):
            xb, yb = x[at].copy(), y[at]
            for i in np.flatnonzero(rng.random(len(xb)) < 0.25):
                xb[i, rng.integers(4, WINDOW) :] = 0
            h, where = pooled(net, xb)
            z = h @ net.dense + net.dense_bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(yb)), yb] -= 1
            p *= weights[at][:, None] / len(yb)
            dh = (p @ net.dense.T) * (h > 0)
            pad = np.concatenate([xb, np.zeros((len(xb), _REACH - 1), np.uint8)], 1)
            seen = np.take_along_axis(pad, (where[:, :, None] + np.arange(_REACH)).reshape(len(xb), -1), 1).reshape(len(xb), f, _REACH)
            vec = net.embed[seen].reshape(len(xb), f, -1)
            back = (dh[:, :, None] * net.kernel.T[None]).reshape(len(xb), f, _REACH, EMBED)
            embed = np.zeros_like(net.embed)
            np.add.at(embed, seen.ravel(), back.reshape(-1, EMBED))
            embed[0] = 0
            grads = {"embed": embed, "kernel": np.einsum("nf,nfk->kf", dh, vec) * mask, "bias": dh.sum(0), "dense": h.T @ p, "dense_bias": p.sum(0)}
            step += 1
            for k in names:
                first[k] = 0.9 * first[k] + 0.1 * grads[k]
                second[k] = 0.999 * second[k] + 0.001 * grads[k] ** 2
                getattr(net, k)[...] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return net


def tile(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of all texts, the text of each, and the bytes of text in each; the last of a text is filled with 0."""
    size = np.diff(offsets)
    count = -(-size // WINDOW)
    out = np.zeros(int(count.sum()) * WINDOW, np.uint8)
    start = np.concatenate([[0], np.cumsum(count)]) * WINDOW
    for i in np.flatnonzero(size):
        out[start[i] : start[i] + size[i]] = data[offsets[i] : offsets[i + 1]]
    doc = np.repeat(np.arange(len(size)), count)
    filled = np.minimum(WINDOW, size[doc] - (np.arange(len(doc)) - start[doc] // WINDOW) * WINDOW)
    return out.reshape(-1, WINDOW), doc, filled


def _sampled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for i, lang, text in zip(b["id"], b["lang"], b["text"]):
            raw = text.encode()
            rows += [(i, lang, k, raw[k : k + WINDOW].ljust(WINDOW, b"\0")) for k in range(0, len(raw), WINDOW)]
        yield pd.DataFrame(rows, columns=["id", "lang", "k", "window"])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS) -> Network | None:
    """Train on about ``sample_docs`` whole documents of each label, those of least hash; None without labelled text.

    The share to take follows from the number of rows of each label, so nothing is sorted; of rows that
    repeat an identifier and a label one is taken.
    """
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    rows = rows.where("id is not null and lang is not null and length(text) > 0")
    counts = {r["lang"]: r["n"] for r in docs.where(F.col(lang_col).isNotNull()).groupBy(F.col(lang_col).cast("string").alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    take = F.lit(False)
    for lang, n in counts.items():
        take = take | ((F.col("lang") == lang) & (F.pmod(F.xxhash64("id"), F.lit(1_000_003)) < int(1_000_003 * min(1.0, sample_docs / n)) + 1))
    found = rows.where(take).groupBy("id", "lang").agg(F.min("text").alias("text")).mapInPandas(_sampled, "id string, lang string, k long, window binary").toPandas()
    if found.empty:
        return None
    found = found.sort_values(["lang", "id", "k"])
    size = found.groupby(["lang", "id"])["k"].transform("size").to_numpy()
    return train(np.frombuffer(b"".join(found["window"]), np.uint8).reshape(-1, WINDOW), list(found["lang"]), np.minimum(1.0, DOCUMENT_WEIGHT / size))


def identify(net: Network | None, column: pa.Array) -> tuple[list, np.ndarray, np.ndarray]:
    """Language (None without text), mean probability of it, and number of windows, of each text."""
    data, offsets = utf8(column)
    n = len(offsets) - 1
    windows, doc, filled = tile(data, offsets)
    count = np.bincount(doc, minlength=n)
    if net is None or not len(windows):
        return [None] * n, np.zeros(n), count
    p = probabilities(net, windows) * filled[:, None]
    total = np.zeros((n, p.shape[1]))
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    total[doc[first]] = np.add.reduceat(p, first, axis=0, dtype=np.float64)
    total /= np.maximum(1, np.diff(offsets))[:, None]
    best = total.argmax(1)
    return [net.classes[k] if c else None for k, c in zip(best, count)], np.where(count > 0, total.max(1), 0.0), count


def predictor(net: Network | None):
    """Column function: text -> struct(lang, confidence, windows)."""
    kind = pa.struct([("lang", pa.string()), ("confidence", pa.float64()), ("windows", pa.int64())])

    @F.arrow_udf("lang string, confidence double, windows long")
    def predict(column: pa.Array) -> pa.Array:
        lang, confidence, count = identify(net, column)
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(confidence, pa.float64()), pa.array(count, pa.int64())], fields=list(kind))

    return predict


def accepted(found: Column, noise: float = NOISE_CONFIDENCE, least: float = MIN_CONFIDENCE) -> Column:
    return F.coalesce((found["confidence"] >= least) & ~((found["lang"] == NOISE) & (found["confidence"] >= noise)), F.lit(False)) & (found["windows"] > 0)


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(doc_id, lang_found, confidence, windows, accepted), a row for each row of ``docs``.

    Training reads ``lang_col``; predictions read the text alone, whole, however long. Null or empty
    text: no language, confidence 0, not accepted. Of equal probabilities the class first by name counts.
    Without any labelled row nothing is identified. Identifiers may be of any type or null, labels null;
    repeated rows give repeated results; other columns are not read, whatever their names; an empty table
    gives no rows.
    """
    found = predictor(fit(docs, id_col, text_col, lang_col, sample_docs))(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), found.alias("found"))
    return rows.select("doc_id", F.col("found.lang").alias("lang_found"), F.round("found.confidence", 4).alias("confidence"), F.col("found.windows").alias("windows"), accepted(F.col("found")).alias("accepted"))


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """``docs`` with the rows that ``identify_languages`` accepts, all columns as they are: rows of null, empty or noise text go, repeated rows stay or go together, an empty table stays empty."""
    return docs.where(accepted(predictor(fit(docs, id_col, text_col, lang_col, sample_docs))(docs[text_col])))
