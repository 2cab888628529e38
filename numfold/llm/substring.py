"""Substring dedup by seed and extend over winnowed anchors.

A window is `window` consecutive words. Of the k-grams inside it the one with the least
hash (leftmost on ties) is its anchor, so equal windows have equal anchors. Consecutive
windows with one anchor make a run; a run's record holds the anchor's hash and a 128-bit hash
of its whole span. Anchors that occur once are dropped (seed). Of equal spans only the first
occurrence can hold first windows, so all later ones are removed as a whole: an extension
both ways by up to a window at once. Where an anchor stands in different spans, the first
occurrence of each span is extended window by window, and the earliest of equal windows
stays. Adjoining removed windows unite to maximal repeats.

Order is (doc_id, start). Defined results: null, empty and short texts lose nothing;
identical rows with one id are the same document and keep the same words; rows that share
an id but not the text are told apart by a text hash; a null id counts as the largest.
Long texts are read whole. An empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_map
from .text import BASES, Rolling, U, Words, chunks, flat, mix

GRAM = 6
BROADCAST_IDS = 1_000_000
LAST = 2**63 - 1


def runs(w: Words, window: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: document, first window (word index in w), windows, anchor hash, both halves of the span hash."""
    n = w.counts
    per = np.maximum(n - window + 1, 0)
    first = np.zeros(len(n) + 1, np.int64)
    np.cumsum(per, out=first[1:])
    total = int(first[-1])
    if not total:
        none = np.zeros(0, np.int64)
        return none, none, none, *[none.astype(np.uint64)] * 3
    start = np.arange(total) + np.repeat(w.at[:-1] - first[:-1], per)
    size = min(GRAM, window)
    gram = w.grams(size)
    last = len(gram) - 1
    at = np.arange(last + 1)
    # place of the least gram among the `width` that begin at or after each word
    width, have, best = window - size + 1, 1, at
    while have < width:
        step = min(have, width - have)
        other = best[np.minimum(at + step, last)]
        best = np.where(gram[other] < gram[best], other, best)
        have += step
    anchor = best[start]
    doc = np.repeat(np.arange(len(n)), per)
    begin = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])])
    count = np.diff(np.append(begin, total))
    s, p = start[begin], anchor[begin]
    inner = (p - s).astype(np.uint64) * U(31) + count.astype(np.uint64) * U(0x9E3779B97F4A7C15)
    spans = [mix(Rolling(h, b).of(s, s + count + window - 1) + inner) for h, b in zip((w.hash, w.hash2), BASES, strict=True)]
    return doc[begin], s, count, gram[p], *spans


def anchors(docs: DataFrame, window: int) -> DataFrame:
    def run(batch: pa.RecordBatch):
        data, offsets = flat(batch.column(2))
        for lo, hi in chunks(offsets):
            w = Words(data, offsets, lo, hi, lower=False)
            doc, s, count, h, *spans = runs(w, window)
            take = pa.array(doc + lo)
            hashes = [pa.array(x.view(np.int64)) for x in (h, *spans)]
            yield pa.RecordBatch.from_arrays([*hashes, batch.column(0).take(take), batch.column(1).take(take), pa.array((s - w.at[doc]).astype(np.int32)), pa.array(count.astype(np.int32))], ["h", "span", "span2", "id", "rid", "s", "c"])

    return arrow_map(docs, run, "h long, span long, span2 long, id long, rid long, s int, c int")


def with_lists(docs: DataFrame, lists: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """Documents joined with their lists, and those without one.

    Ids of up to BROADCAST_IDS documents (16 bytes each) are sent to the scan, so other
    texts are not shuffled; beyond, a shuffled left join does both."""
    ids = scratch.keep(lists.select("id", "rid"))
    if ids.count() > BROADCAST_IDS:
        return docs.join(lists, ["id", "rid"], "left"), None
    sent = F.broadcast(ids)
    return docs.join(sent, ["id", "rid"], "left_semi").join(lists, ["id", "rid"]), docs.join(sent, ["id", "rid"], "left_anti")


def first_windows(docs: DataFrame, doubtful: DataFrame, window: int, scratch: Scratch) -> DataFrame:
    """Windows (id, rid, s, c = 1) of the doubtful runs whose words start earlier in another of them."""
    lists = scratch.keep(doubtful.groupBy("id", "rid").agg(F.collect_list(F.struct("s", "c")).alias("spans")))
    some, _ = with_lists(docs, lists, scratch)

    def run(batch: pa.RecordBatch):
        data, offsets = flat(batch.column(2))
        spans = batch.column(3)
        for lo, hi in chunks(offsets):
            w = Words(data, offsets, lo, hi, lower=False)
            own = spans.slice(lo, hi - lo)
            size = np.array([len(x) if x is not None else 0 for x in own], np.int64)
            items = own.flatten()
            s, c = items.field(0).to_numpy().astype(np.int64), items.field(1).to_numpy().astype(np.int64)
            doc = np.repeat(np.repeat(np.arange(hi - lo), size), c)
            at = np.repeat(s, c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
            word = at + w.at[doc]
            one, two = (Rolling(h, b).of(word, word + window).view(np.int64) for h, b in zip((w.hash, w.hash2), BASES, strict=True))
            take = pa.array(doc + lo)
            yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(two), batch.column(0).take(take), batch.column(1).take(take), pa.array(at.astype(np.int32))], ["k1", "k2", "id", "rid", "s"])

    # few of these windows exist: only spans that differ around a common anchor
    keys = scratch.keep(arrow_map(some.where("spans is not null").select("id", "rid", "text", "spans"), run, "k1 long, k2 long, id long, rid long, s int"))
    least = scratch.keep(keys.groupBy("k1", "k2").agg(F.min(F.struct("id", "s")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    later = keys.join(least, ["k1", "k2"]).where(F.struct("id", "s") > F.col("first"))
    return later.select("id", "rid", "s", F.lit(1).alias("c"))


def repeats(docs: DataFrame, window: int, scratch: Scratch) -> DataFrame:
    """Removed windows of docs (id, rid, text): rows (id, rid, s, c) for windows s .. s + c - 1."""
    twice = scratch.keep(anchors(docs, window).groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
    seeds = scratch.keep(anchors(docs, window).join(twice, "h"))
    spans = scratch.keep(seeds.groupBy("h", "span", "span2").agg(F.min(F.struct("id", "s")).alias("first"), F.count("*").alias("n")))
    several = scratch.keep(spans.groupBy("h").agg(F.count("*").alias("k")).where("k > 1").select("h"))
    later = seeds.join(spans.where("n > 1").select("h", "span", "span2", "first"), ["h", "span", "span2"]).where(F.struct("id", "s") > F.col("first")).select("id", "rid", "s", "c")
    firsts = seeds.join(spans.select("h", "span", "span2", "first"), ["h", "span", "span2"]).where(F.struct("id", "s") == F.col("first")).join(several, "h", "left_semi")
    doubtful = scratch.keep(firsts.select("id", "rid", "s", "c").distinct())
    found = scratch.keep(later.union(first_windows(docs, doubtful, window, scratch)))
    scratch.drop(twice, seeds, spans, several)
    return found


def cover(n: int, spans: pa.StructArray | None, window: int) -> np.ndarray:
    """Which of n words lie in a removed window."""
    edge = np.zeros(n + 1, np.int32)
    if spans is not None and len(spans):
        s, c = spans.field(0).to_numpy().astype(np.int64), spans.field(1).to_numpy().astype(np.int64)
        np.add.at(edge, s, 1)
        np.add.at(edge, s + c - 1 + window, -1)
    return np.cumsum(edge[:-1]) > 0


def dedup(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256), and kept_text if `texts`; a window of one word or more."""
    if window < 1:
        raise ValueError("a window holds one word at least")
    own = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"), F.xxhash64(text_col).alias("rid"), F.col(text_col).cast("string").alias("text"), F.col(id_col).cast("long").alias("doc_id"))
    scratch = Scratch(docs.sparkSession, "substring")
    found = repeats(own.select("id", "rid", "text"), window, scratch)
    lists = scratch.keep(found.groupBy("id", "rid").agg(F.collect_list(F.struct("s", "c")).alias("spans")))
    some, rest = with_lists(own, lists, scratch)

    def run(batch: pa.RecordBatch):
        data, offsets = flat(batch.column(1))
        spans = batch.column(2) if batch.num_columns > 2 else None
        for lo, hi in chunks(offsets):
            w = Words(data, offsets, lo, hi, lower=False)
            raw = w.data.tobytes()
            total, removed, digests, kept_texts = [], [], [], []
            for d in range(hi - lo):
                p, q = int(w.at[d]), int(w.at[d + 1])
                gone = cover(q - p, spans[lo + d].values if spans is not None and spans[lo + d].is_valid else None, window)
                keep = np.flatnonzero(~gone) + p
                kept = b" ".join([raw[a:b] for a, b in zip(w.start[keep].tolist(), w.end[keep].tolist(), strict=True)])
                total.append(q - p)
                removed.append(int(gone.sum()))
                digests.append(hashlib.sha256(kept).hexdigest())
                kept_texts.append(kept.decode() if texts else None)
            columns = [batch.column(0).slice(lo, hi - lo), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(kept_texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns[: 4 + texts], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"][: 4 + texts])

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * texts
    out = arrow_map(some.select("doc_id", "text", "spans"), run, schema)
    return out if rest is None else out.union(arrow_map(rest.select("doc_id", "text"), run, schema))
