"""Language identification by word-first backoff.

A text's words (runs of letters, lower-cased) are scored one by one. A word seen in
training adds its log frequency in each language. An unseen word backs off to its
character n-grams with boundary marks: the longest n from 5 to 1 of which it has a known
one, averaged over its known n-grams. The sum over words goes through a softmax.

The model is fitted on a bounded sample of labelled rows: about `sample_rows` rows of each
language, chosen by a hash of id and text; every word and n-gram of the sample counts.
Tables are flat: sorted 64-bit keys and a matrix of one float a language.

Long texts are read in pieces of PIECE characters, cut where no letter stands, so memory
does not grow with a text's length. Defined results: a null text, or one without a letter
(str.isalpha), gives `und` with score 0; so does every text if no labelled row exists.
Rows with null language never train; an empty table gives no rows. Repeated rows and ids
each give their own row; ids may be null. Ties between languages go to the first in sort
order. Only the named columns are read; recognised() keeps all columns, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_map
from .text import KEYS, U, mix, span_hash

LONGEST = 5
PIECE = 1 << 19
BROADCAST_LANGUAGES = 100_000  # beyond, a shuffled join
Held = list[tuple[int, str]]


@cache
def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def pieces(texts: Iterable[str | None]) -> Iterator[Held]:
    """Lists of (place, lower-cased part) with about PIECE characters each; no word is cut."""
    held: Held = []
    size = 0
    for d, text in enumerate(texts):
        low, lo = (text or "").lower(), 0
        while lo < len(low):
            hi = min(lo + PIECE, len(low))
            if hi < len(low):
                while hi > lo and low[hi - 1].isalpha():
                    hi -= 1
                if hi == lo:  # one word fills the piece
                    hi = lo + PIECE
                    while hi < len(low) and low[hi].isalpha():
                        hi += 1
            held.append((d, low[lo:hi]))
            size += hi - lo
            lo = hi
            if size >= PIECE:
                yield held
                held, size = [], 0
    if held:
        yield held


class Spelled:
    """Distinct words of some parts: keys, code points, and where each word of a text stands among them."""

    def __init__(self, held: Held):
        parts = [p for _, p in held]
        self.points = np.frombuffer("\n".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = np.concatenate([[False], letters()[self.points], [False]])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = edge[0::2], edge[1::2]
        bounds = np.cumsum([0, *(len(p) + 1 for p in parts)])
        self.text = np.array([d for d, _ in held], np.int64)[np.searchsorted(bounds, start, "right") - 1]
        self.keys, first, self.at = np.unique(span_hash(self.points.view(np.uint8), 4 * start, 4 * end)[0], return_index=True, return_inverse=True)
        self.start, self.end = start[first], end[first]

    def grams(self, which: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the n-grams of some of the distinct words, with boundary marks, and each one's place in `which`."""
        size = self.end[which] - self.start[which] + 2
        at = np.cumsum(size) - size
        line = np.zeros(int(size.sum()), np.uint64)
        own = np.repeat(np.arange(len(which)), size)
        nth = np.arange(len(line)) - at[own]
        inner = (nth > 0) & (nth < size[own] - 1)
        line[inner] = self.points[self.start[which][own[inner]] + nth[inner] - 1]
        line[at], line[at + size - 1] = 2, 3
        begin = np.flatnonzero(nth + n <= size[own])
        key = np.full(len(begin), U(n))
        for j in range(n):
            key = mix(key * KEYS[2] + line[begin + j])
        return key, own[begin]


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = 1500) -> LanguageModel:
    """Counts words and n-grams by language over about `sample_rows` rows of each language."""
    rows = labelled.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null")
    sizes = Scratch(labelled.sparkSession, "languages").keep(rows.groupBy("lang").agg(F.count("*").alias("rows_of")))
    if sizes.count() <= BROADCAST_LANGUAGES:
        sizes = F.broadcast(sizes)
    chosen = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 24)) * F.col("rows_of").cast("double") < float(sample_rows << 24)
    sample = rows.join(sizes, "lang").where(chosen).select("text", "lang")

    def count(batch: pa.RecordBatch):
        for lang in batch.column(1).unique().to_pylist():
            own = batch.column(0).filter(pc.equal(batch.column(1), lang)).to_pylist()
            for held in pieces(own):
                words = Spelled(held)
                c = np.bincount(words.at, minlength=len(words.keys))
                tables = [(words.keys, c)]
                for n in range(1, LONGEST + 1):
                    key, of = words.grams(np.arange(len(c)), n)
                    keys, at = np.unique(key, return_inverse=True)
                    tables.append((keys, np.bincount(at, c[of], len(keys)).astype(np.int64)))
                for n, (keys, total) in enumerate(tables):
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(np.full(len(keys), n, np.int32)), pa.array(keys.view(np.int64)), pa.array(total.astype(np.int64))], ["lang", "n", "item", "c"])

    # the sample bounds these rows
    counted = arrow_map(sample, count, "lang string, n int, item long, c long").groupBy("lang", "n", "item").agg(F.sum("c").alias("c")).toArrow()
    return LanguageModel(counted["lang"].to_pylist(), counted["n"].to_numpy(), counted["item"].to_numpy().view(np.uint64), counted["c"].to_numpy())


class LanguageModel:
    """Per-language log frequencies of words (table 0) and of n-grams (tables 1 to LONGEST)."""

    def __init__(self, lang: list[str], n: np.ndarray, items: np.ndarray, counts: np.ndarray):
        self.languages = sorted(set(lang))
        place = {x: i for i, x in enumerate(self.languages)}
        of = np.array([place[x] for x in lang], np.int64)
        self.keys, self.values = [], []
        for k in range(LONGEST + 1):
            own = n == k
            keys, at = np.unique(items[own], return_inverse=True)
            table = np.zeros((len(keys), len(self.languages)))
            table[at, of[own]] = counts[own]
            size = max(1, len(keys))
            value = np.log((table + 0.5) / (table.sum(axis=0) + 0.5 * size)) + math.log(size)
            self.keys.append(keys)
            self.values.append(value.astype(np.float32))

    def find(self, k: int, keys: np.ndarray) -> np.ndarray:
        """Place of each key in table k, or -1."""
        if not len(self.keys[k]):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys[k], keys), len(self.keys[k]) - 1)
        return np.where(self.keys[k][at] == keys, at, -1)

    def vectors(self, words: Spelled) -> np.ndarray:
        """Log frequencies of the distinct words, by backoff."""
        out = np.zeros((len(words.keys), len(self.languages)))
        at = self.find(0, words.keys)
        out[at >= 0] = self.values[0][at[at >= 0]]
        left = np.flatnonzero(at < 0)
        for n in range(LONGEST, 0, -1):
            if not len(left):
                break
            key, of = words.grams(left, n)
            at = self.find(n, key)
            of, at = of[at >= 0], at[at >= 0]
            known = np.bincount(of, minlength=len(left))
            for k in range(len(self.languages)):
                out[left, k] = np.bincount(of, self.values[n][at, k], len(left)) / np.maximum(known, 1)
            left = left[known == 0]
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        total, seen = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), bool)
        if self.languages:
            for held in pieces(texts):
                words = Spelled(held)
                value = self.vectors(words)
                for k in range(len(self.languages)):
                    total[:, k] += np.bincount(words.text, value[words.at, k], len(texts))
                seen[words.text] = True
        if not seen.any():
            return ["und"] * len(texts), np.zeros(len(texts))
        best = total.argmax(axis=1)
        score = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        return [self.languages[b] if s else "und" for b, s in zip(best.tolist(), seen.tolist(), strict=True)], np.where(seen, score, 0.0)


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, lang_pred, score) of whole texts."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample of fit()

    def run(batch: pa.RecordBatch):
        lang, score = sent.value.predict(batch.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, "doc_id long, lang_pred string, score double")


def recognised(docs: DataFrame, model: LanguageModel, least: float = 0.5, text_col: str = "text", lang_col: str | None = None) -> DataFrame:
    """The rows, with all columns, whose text has a language with a score of `least` or more; `lang_col`, a string column, becomes that language."""
    sent, at, to = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col), docs.columns.index(lang_col) if lang_col else None

    def run(batch: pa.RecordBatch):
        lang, score = sent.value.predict(batch.column(at).to_pylist())
        keep = pa.array([x != "und" and s >= least for x, s in zip(lang, score.tolist(), strict=True)], pa.bool_())
        columns = [pa.array(lang, pa.string()) if i == to else c for i, c in enumerate(batch.columns)]
        yield pa.RecordBatch.from_arrays(columns, batch.schema.names).filter(keep)

    return arrow_map(docs, run, docs.schema)
