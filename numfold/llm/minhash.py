"""MinHash near-dedup: fast similarity sketches, banding, exact verification, components.

Sketch: in round i every shingle throws itself into a hashed bin (in rounds t and later
into bin i - t) with value i + hash; a bin keeps its least value and rounds stop when all
bins are full. Two sketches agree in a bin with the sets' Jaccard similarity, with
concentration, and every coordinate is filled, also for tiny sets.

Documents with equal sets become one class (partial aggregation; a group of copies is
never gathered). The bands of class sketches form buckets. Round 1 compares each bucket's
members with its smallest id only; sketches that agree in too few bins for the threshold
(5 standard deviations below it) are out, the rest are verified on full sets. Round 2
compares, in blocks and on full sets, the members of buckets that still hold several
components, each pair in the first band that it shares, so no link between different
components is left out. A bucket's largest component meets only the others, never itself.
Verified links go through distributed connected components.

Full sets are sets of 64-bit shingle hashes, made from keyed 128-bit word hashes.

Defined results: a null or empty text, or one of white space, has an empty set and stands
alone; fewer words than a shingle are one shingle; equal texts share a component; rows
that share an id act as one document with several texts; a null id stands alone and is
kept. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, id_text
from .graph import Union, components
from .text import U, Words, binaries, chunks, distinct, flat, mix

BINS, BANDS = 160, 32
BLOCK = 512
BROADCAST_IDS = 1_000_000
EMPTY = U(2**64 - 1)


def sketch(hashes: np.ndarray, offsets: np.ndarray, bins: int) -> np.ndarray:
    """Fast similarity sketch (n sets x bins) of sets given as flat distinct hashes."""
    n = len(offsets) - 1
    out = np.full((n, bins), EMPTY)
    line = out.reshape(-1)
    size = np.diff(offsets)
    open_ = np.flatnonzero(size > 0)
    h, owner = hashes, np.repeat(np.arange(n), size)
    for i in range(2 * bins):
        x = mix(h + U((i + 1) * 0x9E3779B97F4A7C15 % 2**64))
        to = ((x >> U(32)) * U(bins) >> U(32)).astype(np.int64) if i < bins else i - bins
        np.minimum.at(line, owner * bins + to, (U(i) << U(54)) | (mix(x) >> U(10)))
        left = (out[open_] == EMPTY).any(axis=1)
        if not left.all():
            open_ = open_[left]
            if not len(open_):
                break
            stay = np.isin(owner, open_)
            h, owner = h[stay], owner[stay]
    return out


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, n, k1, k2, sketch, keys): set size, 128-bit digest of the set, one byte a bin, band keys."""
    salt = mix(np.arange(1, BINS + 1, dtype=np.uint64))

    def run(batch: pa.RecordBatch):
        data, offsets = flat(batch.column(1))
        for lo, hi in chunks(offsets):
            w = Words(data, offsets, lo, hi, lower=True)
            h, so = distinct(*w.shingles(shingle))
            n = np.diff(so)
            full = n > 0
            s = sketch(h, so, BINS)
            one = np.add.reduceat(np.append(mix(h), U(0)), so[:-1]) if len(h) else np.zeros(hi - lo, np.uint64)
            two = np.add.reduceat(np.append(mix(h ^ U(0xD6E8FEB86659FD93)), U(0)), so[:-1]) if len(h) else one
            salted = mix(s ^ salt)
            width = BINS // BANDS
            keys = salted[:, : BANDS * width].reshape(len(n), BANDS, width)
            band = mix(keys[:, :, 0])
            for c in range(1, width):
                band = mix(band * U(3) + keys[:, :, c])
            kind = pa.list_(pa.int64())
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(np.where(full, BANDS, 0))]).astype(np.int32), pa.array(band[full].reshape(-1).view(np.int64))).cast(kind)
            none = pa.array(~full)
            k1, k2 = (pa.array(x.view(np.int64), mask=~full) for x in (one, two))
            byte = binaries((salted & U(255)).astype(np.uint8), np.arange(len(n) + 1) * BINS)
            del none
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n), k1, k2, byte, lists], ["doc_id", "n", "k1", "k2", "sketch", "keys"])

    return arrow_map(docs, run, "doc_id long, n long, k1 long, k2 long, sketch binary, keys array<long>")


def least_agreement(percent: int) -> int:
    """Bins that two sketches of sets at the threshold agree in, but for 5 standard deviations."""
    p = percent / 100
    return int(BINS * p - 5 * (BINS * p * (1 - p)) ** 0.5)


def agreeing(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of class ids whose sketches and sizes allow the threshold."""
    least = least_agreement(percent)
    sides = [classes.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")) for x in "ab"]
    joined = pairs.join(sides[0], "a").join(sides[1], "b").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)

    def run(batch: pa.RecordBatch):
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BINS) for c in (2, 3))
        ok = pa.array((x == y).sum(axis=1) >= least)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(ok)

    return arrow_map(joined.select("a", "b", "sa", "sb"), run, "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame, shingle: int, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs whose full sets reach the threshold: 100 * common >= percent * united."""
    ids = scratch.keep(pairs.select("a").union(pairs.select("b")).toDF("doc_id").distinct())
    small = ids.count() <= BROADCAST_IDS  # 8 bytes each; beyond, a shuffled join
    texts = scratch.keep(docs.join(F.broadcast(ids) if small else ids, "doc_id", "left_semi"))
    sides = [texts.select(F.col("doc_id").alias(x), F.col("text").alias(f"t{x}")) for x in "ab"]

    def run(batch: pa.RecordBatch):
        (da, oa), (db, ob) = flat(batch.column(2)), flat(batch.column(3))
        ok = []
        for lo, hi in chunks(oa + ob):
            ha, sa = distinct(*Words(da, oa, lo, hi, lower=True).shingles(shingle))
            hb, sb = distinct(*Words(db, ob, lo, hi, lower=True).shingles(shingle))
            for i in range(hi - lo):
                x, y = ha[sa[i] : sa[i + 1]], hb[sb[i] : sb[i + 1]]
                common = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(common > 0 and 100 * common >= percent * (len(x) + len(y) - common))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return scratch.keep(arrow_map(pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "ta", "tb"), run, "a long, b long").distinct())


def dealt(rows: DataFrame) -> DataFrame:
    """Bucket members (key, id, comp, ...) in groups (key, main, i, j) of two blocks of about BLOCK members.

    With `main`, block i holds members of the bucket's largest component and block j others;
    without it both hold others. `first` says that a row is of the largest component."""
    sizes = rows.groupBy("key", "comp").agg(F.count("*").alias("c"))
    load = sizes.groupBy("key").agg(F.max(F.struct("c", "comp")).alias("top"), F.sum("c").alias("all")).select("key", F.col("top.comp").alias("largest"), F.ceil(F.col("top.c") / BLOCK).cast("int").alias("mains"), F.ceil((F.col("all") - F.col("top.c")) / BLOCK).cast("int").alias("others"))
    own = rows.join(load, "key").withColumn("first", F.col("comp") == F.col("largest"))
    own = own.withColumn("block", F.pmod(F.xxhash64("id"), F.when(F.col("first"), F.col("mains")).otherwise(F.col("others"))).cast("int"))
    place = lambda main, i, j: F.struct(main.alias("main"), i.alias("i"), j.alias("j"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    with_main = F.when(F.col("first"), F.transform(upto(F.col("others")), lambda j: place(F.lit(True), F.col("block"), j))).otherwise(F.transform(upto(F.col("mains")), lambda i: place(F.lit(True), i, F.col("block"))))
    without = F.when(F.col("first"), F.array().cast("array<struct<main:boolean,i:int,j:int>>")).otherwise(F.transform(upto(F.col("others")), lambda j: place(F.lit(False), F.least("block", j), F.greatest("block", j))))
    out = own.withColumn("at", F.explode(F.concat(with_main, without)))
    # by the whole group, or all groups of a hot bucket would stay in one task
    return out.select(*rows.columns, "first", "block", "at.main", "at.i", "at.j").repartition("key", "main", "i", "j")


def open_pairs(group: pa.Table, percent: int):
    """Yields (row, rows) of different components whose sketches and sizes allow the threshold.

    A pair belongs to the first band that both share, so to one bucket only."""
    least, key = least_agreement(percent), group["key"][0].as_py()
    block, comp, n = (group[c].to_numpy() for c in ("block", "comp", "n"))
    first = group["first"].to_numpy()
    s = np.frombuffer(b"".join(group["sketch"].to_pylist()), np.uint8).reshape(-1, BINS)
    bands = group["keys"].combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
    i, j, main = group["i"][0].as_py(), group["j"][0].as_py(), group["main"][0].as_py()
    left, right = np.flatnonzero(first if main else block == i), np.flatnonzero(~first if main else block == j)
    for x in left.tolist():
        y = right[(comp[right] != comp[x]) & (np.minimum(n[right], n[x]) * 100 >= np.maximum(n[right], n[x]) * percent)]
        if i == j and not main:
            y = y[y > x]
        y = y[(s[y] == s[x]).sum(axis=1) >= least]
        y = y[bands[x][(bands[y] == bands[x]).argmax(axis=1)] == key]
        if len(y):
            yield x, y


def cross_links(rows: DataFrame, docs: DataFrame, shingle: int, percent: int, scratch: Scratch) -> DataFrame:
    """Verified links (a, b) between different components within buckets.

    rows: (key, id, comp, n, sketch, keys). A first pass names the members that have an
    open partner; a second compares their full sets where they stand, in the bucket, and
    returns a spanning forest of the links found, so neither pass emits pairs."""

    def flag(group: pa.Table) -> pa.Table:
        found = np.zeros(group.num_rows, bool)
        for x, y in open_pairs(group, percent):
            found[x] = found[y] = True
        return group.select(["key", "id"]).filter(pa.array(found))

    flagged = scratch.keep(dealt(rows).groupBy("key", "main", "i", "j").applyInArrow(flag, "key long, id long").distinct())
    ids = scratch.keep(flagged.select(F.col("id").alias("doc_id")).distinct())
    small = ids.count() <= BROADCAST_IDS  # 8 bytes each; beyond, a shuffled join

    def sets(batch: pa.RecordBatch):
        data, offsets = flat(batch.column(1))
        for lo, hi in chunks(offsets):
            h, so = distinct(*Words(data, offsets, lo, hi, lower=True).shingles(shingle))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), binaries(h, so)], ["id", "hashes"])

    full = scratch.keep(arrow_map(docs.join(F.broadcast(ids) if small else ids, "doc_id", "left_semi"), sets, "id long, hashes binary"))

    def link(group: pa.Table) -> pa.Table:
        ids, comp = group["id"].to_numpy(), group["comp"].to_pylist()
        h = [np.frombuffer(x, np.uint64) for x in group["hashes"].to_pylist()]
        joined, a, b = Union(), [], []
        for x, ys in open_pairs(group, percent):
            for y in ys.tolist():
                if joined.root(comp[x]) != joined.root(comp[y]):
                    common = len(np.intersect1d(h[x], h[y], assume_unique=True))
                    if 100 * common >= percent * (len(h[x]) + len(h[y]) - common):
                        joined.link(comp[x], comp[y])
                        a.append(max(ids[x], ids[y]))
                        b.append(min(ids[x], ids[y]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    members = scratch.keep(rows.join(flagged, ["key", "id"]).join(full, "id"))
    return scratch.keep(dealt(members).groupBy("key", "main", "i", "j").applyInArrow(link, "a long, b long").distinct())


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs."""
    docs = id_text(docs, id_col, text_col)
    scratch = Scratch(docs.sparkSession, "minhash")
    signed = scratch.keep(signatures(docs, shingle))
    known = signed.where("n > 0 and doc_id is not null")
    first = F.min_by(F.struct("doc_id", "n", "sketch", "keys"), "doc_id")
    classes = scratch.keep(known.groupBy("k1", "k2").agg(first.alias("r")).select("k1", "k2", F.col("r.doc_id").alias("rep"), "r.n", "r.sketch", "r.keys"))
    bands = classes.select("rep", F.explode("keys").alias("key"))
    buckets = scratch.keep(bands.groupBy("key").agg(F.min("rep").alias("first"), F.max("rep").alias("last"), F.count("*").alias("c")).where("last > first").drop("last"))
    held = scratch.keep(bands.join(buckets, "key").select("key", F.col("rep").alias("id"), "first", "c"))
    pairs = scratch.keep(agreeing(held.where("id > first").select(F.col("id").alias("a"), F.col("first").alias("b")).distinct(), classes, percent))
    links = verified(pairs, docs, shingle, percent, scratch)
    comps = components(links, scratch)

    placed = held.where("c > 2").join(comps, "id", "left").select("key", "id", "c", F.coalesce("comp", "id").alias("comp"))
    placed = scratch.keep(placed)
    mixed = scratch.keep(placed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("key"))
    rows = scratch.keep(placed.drop("c").join(mixed, "key").join(classes.select(F.col("rep").alias("id"), "n", "sketch", "keys"), "id"))
    more = cross_links(rows, docs, shingle, percent, scratch)
    if not more.isEmpty():
        comps = components(comps.toDF("a", "b").union(more), scratch)  # the stars found so far, and what joins them
    scratch.drop(held, buckets, placed, mixed, pairs, rows)

    member = signed.select("doc_id", "n", "k1", "k2").join(classes.select("k1", "k2", "rep"), ["k1", "k2"], "left")
    out = member.join(comps.select(F.col("id").alias("rep"), "comp"), "rep", "left")
    comp = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "rep", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), comp.alias("component_id"), F.coalesce(F.col("doc_id") == comp, F.lit(True)).alias("kept"))
