"""Benchmark decontamination: size-partitioned MinHash containment search.

Documents are cut into parts of at most PART shingles and put into size classes by powers
of two; a class of parts of n shingles has 2n to 4n bins. A part's sketch keeps the least
hash of each bin (one permutation); an item is sketched for every class. A shingle that
item and document share survives in both sketches with a chance of about 0.8 or more, so
an item of q shingles of which 0.8 are inside is missed with a chance of 0.22^(0.8 q) at
most; items under SMALL shingles keep all their shingles as coordinates instead. Every
document that agrees with an item in one coordinate is verified on its whole set by exact
containment of the item's shingles.

Items go out in blocks of about BLOCK shingles (16 bytes each) at most. Benchmarks are one
block as a rule, and then the query stays lazy. Of several blocks one is held at a time: its
rows are written to the shared folder and its broadcast is destroyed before the next is built.
Shingles are 64-bit hashes made from keyed 128-bit word hashes.

Defined results: an empty table of documents or items gives no matches; null item ids are
left out, null document ids are carried; null and empty texts and items match nothing; a text of fewer words than
a shingle is one shingle of all its words; a repeated item row counts once; repeated
documents each give their rows. Upper-case A-Z equals lower-case. Extra columns are kept
by clean() and not read by search().
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, id_text
from .text import U, Words, chunks, distinct, flat, mix

PART, SMALL, BLOCK = 2048, 12, 1_000_000
CLASSES = range(5, 13)
TABLE = 22


def part_sketch(hashes: np.ndarray, part: np.ndarray, parts: int, bits: int) -> np.ndarray:
    """Hashes that are the least of their bin, of parts with 2^bits bins each."""
    x = mix(hashes + U(bits))
    key = (part << bits) + (x >> U(64 - bits)).astype(np.int64)
    least = np.full(parts << bits, U(2**64 - 1))
    np.minimum.at(least, key, mix(x))
    return least[key] == mix(x)


class Items:
    """Sketch coordinates and exact shingles of a block of items."""

    def __init__(self, ids: list[int], texts: list[str], shingle: int):
        h, so = distinct(*Words(*flat(pa.array(texts, pa.string())), 0, len(texts), lower=True).shingles(shingle))
        self.ids, self.size = np.array(ids, np.int64), np.diff(so)
        owner = np.repeat(np.arange(len(ids)), self.size)
        order = np.argsort(h, kind="stable")
        self.hash, self.owner = h[order], owner[order]
        small = self.size[owner] < SMALL
        self.small = np.unique(h[small])
        self.coordinates = {b: np.unique(h[~small][part_sketch(h[~small], owner[~small], len(ids), b)]) for b in CLASSES}
        self.filters = {b: self.bits(c) for b, c in self.coordinates.items()} | {0: self.bits(self.small)}

    @staticmethod
    def bits(hashes: np.ndarray) -> np.ndarray:
        out = np.zeros((1 << TABLE) // 8, np.uint8)
        at = (hashes >> U(64 - TABLE)).astype(np.int64)
        np.bitwise_or.at(out, at >> 3, (1 << (at & 7)).astype(np.uint8))
        return out

    def among(self, hashes: np.ndarray, which: int) -> np.ndarray:
        """Which hashes are coordinates of class `which` (0: of small items)."""
        table = self.coordinates[which] if which else self.small
        at = (hashes >> U(64 - TABLE)).astype(np.int64)
        maybe = np.flatnonzero(self.filters[which][at >> 3] >> (at & 7).astype(np.uint8) & 1)
        out = np.zeros(len(hashes), bool)
        if len(maybe) and len(table):
            place = np.minimum(np.searchsorted(table, hashes[maybe]), len(table) - 1)
            out[maybe] = table[place] == hashes[maybe]
        return out

    def candidates(self, h: np.ndarray, so: np.ndarray) -> np.ndarray:
        """Documents of which a part agrees with an item in a coordinate."""
        n = np.diff(so)
        doc = np.repeat(np.arange(len(n)), n)
        within = np.arange(len(h)) - so[:-1][doc]
        hit = self.among(h, 0)
        cut = np.maximum(-(-n // PART), 1)  # parts of a document, equal in size
        part = within * cut[doc] // np.maximum(n[doc], 1)
        size = -(-n // cut)
        bits = np.clip(np.ceil(np.log2(np.maximum(2 * size, 1))), CLASSES[0], CLASSES[-1]).astype(np.int64)
        label = np.concatenate([[0], np.cumsum(cut)])[:-1][doc] + part
        for b in CLASSES:
            own = np.flatnonzero(bits[doc] == b)
            if not len(own):
                continue
            parts, dense = np.unique(label[own], return_inverse=True)
            kept = own[part_sketch(h[own], dense, len(parts), b)]
            hit[kept] |= self.among(h[kept], b)
        return np.unique(doc[hit])

    def verify(self, distinct_hashes: np.ndarray, percent: int) -> list[tuple[int, int]]:
        """Items (place, shared shingles) with exact containment of `percent` in a whole set."""
        lo, hi = np.searchsorted(self.hash, distinct_hashes, "left"), np.searchsorted(self.hash, distinct_hashes, "right")
        n = hi - lo
        at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        shared = np.bincount(self.owner[at], minlength=len(self.ids))
        found = np.flatnonzero((shared > 0) & (100 * shared >= percent * self.size))
        return [(int(i), int(shared[i])) for i in found]

    def matches(self, column: pa.Array, shingle: int, percent: int):
        """Yields (row, [(item place, shared)]) of contaminated rows of a text column."""
        data, offsets = flat(column)
        for lo, hi in chunks(offsets):
            h, so = Words(data, offsets, lo, hi, lower=True).shingles(shingle)
            for d in self.candidates(h, so).tolist():
                if found := self.verify(np.unique(h[so[d] : so[d + 1]]), percent):
                    yield lo + d, found


def blocks(items: DataFrame, shingle: int, id_col: str, text_col: str, scratch: Scratch):
    """Yields (broadcast of a block of items, whether it is the only one); a block is destroyed once the next is asked for."""
    own = scratch.keep(id_text(items, id_col, text_col).where("doc_id is not null and text is not null").distinct())
    words = own.agg(F.sum(F.length("text").cast("double"))).first()
    n = max(1, math.ceil((words[0] or 0) / (4 * BLOCK)))
    for i in range(n):
        rows = own.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)) == i).collect()  # bounded by BLOCK
        rows = sorted((r[0], r[1]) for r in rows)
        if rows:
            sent = items.sparkSession.sparkContext.broadcast(Items([r[0] for r in rows], [r[1] for r in rows], shingle))
            yield sent, n == 1
            if n > 1:
                sent.destroy()


PAIRS = "doc_id long, item_id long, item_shingles long, shared long, containment double"


def search(docs: DataFrame, items: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each document and item with |item & document| / |item| >= percent / 100."""
    own, out = id_text(docs, id_col, text_col), None
    scratch = Scratch(docs.sparkSession, "decontaminate")

    def searcher(sent):
        def run(batch: pa.RecordBatch):
            block: Items = sent.value
            rows = [(d, i, s) for d, found in block.matches(batch.column(1), shingle, percent) for i, s in found]
            d, i, s = (np.array([r[c] for r in rows], np.int64) for c in range(3))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(d)), pa.array(block.ids[i]), pa.array(block.size[i]), pa.array(s), pa.array(s / np.maximum(block.size[i], 1))], ["doc_id", "item_id", "item_shingles", "shared", "containment"])

        return run

    for sent, only in blocks(items, shingle, item_id, item_text, scratch):
        part = arrow_map(own, searcher(sent), PAIRS)
        part = part if only else scratch.keep(part)
        out = part if out is None else out.union(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], PAIRS)


def clean(docs: DataFrame, items: DataFrame, shingle: int = 5, percent: int = 80, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs that contain no item; all columns stay and nothing is shuffled."""
    at, scratch = docs.columns.index(text_col), Scratch(docs.sparkSession, "decontaminate")

    def cleaner(sent):
        def run(batch: pa.RecordBatch):
            keep = np.ones(batch.num_rows, bool)
            keep[[d for d, _ in sent.value.matches(batch.column(at), shingle, percent)]] = False
            yield batch.filter(pa.array(keep))

        return run

    for sent, only in blocks(items, shingle, item_id, item_text, scratch):
        left = arrow_map(docs, cleaner(sent), docs.schema)
        docs = left if only else scratch.keep(left)
    return docs
