"""Language-model scoring by context-tree weighting, beside a smoothed unigram base.

Model: every byte is eight binary decisions; a node is a context of up to DEPTH previous
bytes together with the bits decided so far. Each node mixes the Krichevsky-Trofimov
estimate of its own counts with the product of its children, half and half; the weights
that follow from the training counts mix the estimates of all depths along a context path.
A context that training never saw ends the path at its parent. A text starts in a context
of byte 0xFF and ends with one, which UTF-8 never holds; its score is the log10
probability of all its bytes and that end, and bits_per_byte its code length.

All (DEPTH + 1)-grams of all training texts are counted in one distributed aggregation and
all of them make the tree; it grows with the input. The SHALLOW + 1 bytes before a byte
decide the bucket of its nodes deeper than SHALLOW, so a bucket holds whole subtrees, and a
frequent pair of bytes spreads over many buckets. Only the nodes of depths 0 to SHALLOW are
brought together and broadcast: at most 2^16 contexts with 255 nodes each, whatever the
input, and some hundred thousand nodes for texts of a few scripts.

Base: counts of all tokens of all training texts, in buckets by ranges of their hash.

Scoring: a chunk of documents asks each bucket once for each of its distinct tokens and
grams, and gets counts and log probabilities back, which are then added up along its
texts. A frequent token or gram is one entry of each chunk. A bucket that many chunks ask
is dealt to several tasks by chunk, each with the bucket's model.

Texts are lower-cased (A-Z) for both. Defined results: a null or empty text has the end
token only; without training rows N and V are 0, known counts are 0, the base is log10(1)
and every bit has probability 1/2. Long texts are scored whole; repeated rows each give a
row; ids may be null. Extra columns are not read.
"""

from __future__ import annotations

import math
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_map
from .text import LOWER, U, Words, chunks, flat, sorted_distinct

DEPTH = 5
END = U(0x5851F42D4C957F2D)
SHALLOW = 2
PIECE = 8 << 20
BUCKET_KEYS = 500_000
LEAST_BUCKETS = 96
ENTRIES = 2_000_000


def codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of every byte and end, and their offsets: DEPTH bytes of context, the nearest one on top, then the byte."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    at = offsets + (DEPTH + 1) * np.arange(n + 1)
    line = np.full(int(at[-1]), 255, np.uint8)
    line[np.arange(len(data)) + np.repeat(at[:-1] + DEPTH - offsets[:-1], size)] = LOWER[data]
    wide = line.astype(np.uint64)
    code = wide.copy()
    for k in range(1, DEPTH + 1):
        code[k:] |= wide[:-k] << np.uint64(8 * (DEPTH - k + 1))
    own = np.ones(len(line), bool)
    for k in range(DEPTH):
        own[at[:-1] + k] = False
    return code[own], offsets + np.arange(n + 1)


def stirling(x: np.ndarray) -> np.ndarray:
    """log gamma for arguments of 8 and more."""
    z = 1 / (x * x)
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + (1 / 12 - z * (1 / 360 - z / 1260)) / x


KNOWN = 4096
LOG_GAMMA = [np.array([math.lgamma(n + shift) for n in range(KNOWN)]) for shift in (0.5, 1.0)]


def log_gamma(n: np.ndarray, which: int) -> np.ndarray:
    """log gamma of n + 1/2 (0) or n + 1 (1) for whole numbers n."""
    out = LOG_GAMMA[which][np.minimum(n, KNOWN - 1).astype(np.int64)]
    big = np.flatnonzero(n >= KNOWN)
    out[big] = stirling(n[big] + (0.5, 1.0)[which])
    return out


def decisions(grams: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits of the last byte decided before that level, after a leading 1, and the bit of the level."""
    byte = grams & U(255)
    return U(1 << level) | (byte >> U(8 - level)), (byte >> U(7 - level)) & U(1)


def cut(code: np.ndarray, depth: int, node: np.ndarray) -> np.ndarray:
    """Key of a node: the nearest `depth` bytes of the context, then the bits decided."""
    return ((code >> U(8 * (DEPTH - depth + 1))) << U(8)) | node


def weigh(n0: np.ndarray, n1: np.ndarray, below: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of nodes: log probability of their mixture, KT probability of bit 1, weight of stopping."""
    own = log_gamma(n0, 0) + log_gamma(n1, 0) - log_gamma(n0 + n1, 1) - math.log(math.pi)
    one = ((n1 + 0.5) / (n0 + n1 + 1)).astype(np.float32)
    if below is None:
        return own, one, np.ones(len(own), np.float32)
    both = np.logaddexp(own, below) + math.log(0.5)
    return both, one, np.exp(own + math.log(0.5) - both).astype(np.float32)


class Subtrees:
    """Nodes deeper than SHALLOW of some grams, sorted and distinct, with their counts.

    A depth's rows are its distinct (context, byte), in order, so that the nodes of a level
    are runs of rows; `up` says which row of the next smaller depth a row belongs to."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        self.rows, self.up = {DEPTH: (grams, counts.astype(np.int64))}, {}
        for depth in range(DEPTH - 1, SHALLOW - 1, -1):
            keys, counts = self.rows[depth + 1]
            shorter, at = np.unique(((keys >> U(16)) << U(8)) | (keys & U(255)), return_inverse=True)
            self.up[depth + 1] = at
            self.rows[depth] = shorter, np.bincount(at, counts, len(shorter)).astype(np.int64)

    def level(self, level: int) -> tuple[list, list[np.ndarray]]:
        """Layers (keys, KT of bit 1, stopping) of depths SHALLOW + 1 to DEPTH, and
        (keys, n0, n1, log probability of the children) of depth SHALLOW."""
        layers, value, begin = [], None, None
        for depth in range(DEPTH, SHALLOW - 1, -1):
            keys, counts = self.rows[depth]
            node, bit = decisions(keys, level)
            lead = keys >> U(8 - level)
            new = np.ones(len(keys), bool)
            new[1:] = lead[1:] != lead[:-1]
            start = np.flatnonzero(new)
            total = np.add.reduceat(counts, start) if len(start) else counts
            n1 = np.add.reduceat(np.where(bit == 1, counts, 0), start) if len(start) else counts
            below = None
            if value is not None:
                below = np.bincount((np.cumsum(new) - 1)[self.up[depth + 1][begin]], value, len(start)).astype(np.float64)
            names = ((keys >> U(8)) << U(8) | node)[start]
            if depth == SHALLOW:
                return layers, [names, (total - n1).astype(np.float64), n1.astype(np.float64), below]
            value, one, stop = weigh(total - n1, n1, below)
            layers.insert(0, (names, one, stop))
            begin = start


def shallow(keys: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: np.ndarray) -> list:
    """Layers of depths 0 to SHALLOW, of all levels, from the nodes of depth SHALLOW in order of their keys."""
    layers = []
    for depth in range(SHALLOW, -1, -1):
        value, one, stop = weigh(n0, n1, below)
        layers.insert(0, (keys, one, stop))
        if depth:
            shorter, at = np.unique(((keys >> U(16)) << U(8)) | (keys & U(255)), return_inverse=True)
            n0, n1, below = (np.bincount(at, x, len(shorter)).astype(np.float64) for x in (n0, n1, value))
            keys = shorter
    return layers


def chance(layers: list, grams: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Probability of bit 1 after the contexts of codes and the bits decided."""
    left, p, here = np.ones(len(grams)), np.zeros(len(grams)), np.full(len(grams), 0.5)
    seen = np.arange(len(grams))
    for depth, (keys, one, stop) in enumerate(layers):
        if not len(keys) or not len(seen):
            break
        key = cut(grams[seen], depth, node[seen])
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        found = keys[at] == key
        seen, at = seen[found], at[found]
        here[seen] = one[at]
        share = left[seen] * stop[at]
        p[seen] += share * here[seen]
        left[seen] -= share
    return p + left * here


def log10_of(grams: np.ndarray, layers_of) -> np.ndarray:
    """log10 probability of the last byte of each code after the others; layers_of(level) gives the nodes."""
    total = np.zeros(len(grams))
    for level in range(8):
        node, bit = decisions(grams, level)
        p = chance(layers_of(level), grams, node)
        total += np.log10(np.maximum(np.where(bit == 1, p, 1 - p), 1e-30))
    return total


class ContextTree:
    """A whole tree in memory, of grams (sorted, distinct) and their counts."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        trees = Subtrees(grams, counts)
        parts = [trees.level(level) for level in range(8)]
        tops = [np.concatenate(x) for x in zip(*(top for _, top in parts), strict=True)]
        order = np.argsort(tops[0])
        top = shallow(*(x[order] for x in tops))
        self.layers = [top + layers for layers, _ in parts]

    def score(self, code: np.ndarray) -> np.ndarray:
        """log10 probabilities of codes."""
        return log10_of(code, self.layers.__getitem__)


def training_counts(docs: DataFrame) -> DataFrame:
    """(kind, key, c): kind 0 token hashes, kind 1 (DEPTH + 1)-grams; added up in each task first."""

    def run(batches):
        held: list[list] = [[], []]
        rows = 0

        def flush():
            for kind, parts in enumerate(held):
                if parts:
                    key, c = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                    keys, at = np.unique(key, return_inverse=True)
                    total = np.bincount(at, c, len(keys)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int8)), pa.array(keys.view(np.int64)), pa.array(total)], ["kind", "key", "c"])
                parts.clear()

        for batch in batches:
            data, offsets = flat(batch.column(0))
            for lo, hi in chunks(offsets):
                w = Words(data, offsets, lo, hi, lower=True)
                tokens, c = np.unique(w.hash, return_counts=True)
                held[0] += [(tokens, c), (np.array([END]), np.array([hi - lo]))]
                grams, d = np.unique(codes(w.data, w.off)[0], return_counts=True)
                held[1].append((grams, d))
                rows += len(tokens) + len(grams)
                if rows > 4_000_000:
                    yield from flush()
                    rows = 0
        yield from flush()

    return docs.select("text").mapInArrow(run, "kind byte, key long, c long").groupBy("kind", "key").agg(F.sum("c").alias("c"))


def token_bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> U(32)) * U(buckets) >> U(32)).astype(np.int64)


def gram_bucket(grams: np.ndarray, buckets: int) -> np.ndarray:
    """By the SHALLOW + 1 bytes before the last one, which are the same for all nodes of a subtree."""
    return ((((grams >> U(8 * (DEPTH - SHALLOW))) & U(0xFFFFFF)) * U(10368889) & U(0xFFFFFF)) * U(buckets) >> U(24)).astype(np.int64)


def bucket_column(buckets: tuple[int, int]) -> Column:
    """token_bucket() and gram_bucket() of (kind, key)."""
    token = F.floor(F.shiftrightunsigned("key", 32) * buckets[0] / F.lit(2**32))
    context = F.shiftright("key", 8 * (DEPTH - SHALLOW)).bitwiseAND(F.lit(0xFFFFFF)) * 10368889
    gram = F.shiftright(context.bitwiseAND(F.lit(0xFFFFFF)) * buckets[1], 24) + buckets[0]
    return F.when(F.col("kind") == 0, token).otherwise(gram).cast("int")


def shrunk(keys: np.ndarray) -> bytes:
    """Sorted keys as compressed differences."""
    return np.int64(len(keys)).tobytes() + pa.compress(np.diff(keys, prepend=U(0)).tobytes(), codec="zstd", asbytes=True)


def grown(body: bytes) -> np.ndarray:
    n = int(np.frombuffer(body, np.int64, 1)[0])
    return np.cumsum(np.frombuffer(pa.decompress(body[8:], 8 * n, codec="zstd", asbytes=True), np.uint64), dtype=np.uint64)


class Asked:
    """Distinct tokens and grams of a chunk of texts, in order, and how they fall into buckets."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, buckets: tuple[int, int]):
        tokens, grams = [np.array([END])], []
        for a, b in chunks(offsets):
            w = Words(data, offsets, a, b, lower=True)
            tokens.append(sorted_distinct(w.hash))
            grams.append(sorted_distinct(codes(w.data, w.off)[0]))
        self.tokens, self.grams = sorted_distinct(np.concatenate(tokens)), sorted_distinct(np.concatenate(grams))
        own = gram_bucket(self.grams, buckets[1])
        self.order = np.argsort(own, kind="stable")
        edges = np.searchsorted(token_bucket(self.tokens, buckets[0]), np.arange(buckets[0] + 1))
        self.parts = [(self.tokens, edges), (self.grams[self.order], np.searchsorted(own[self.order], np.arange(buckets[1] + 1)))]

    def __iter__(self):
        first = 0
        for keys, edges in self.parts:
            for k in np.flatnonzero(np.diff(edges)).tolist():
                yield first + k, keys[edges[k] : edges[k + 1]]
            first += len(edges) - 1


class Places:
    """Places of keys among sorted distinct ones: one guess a key from a table, a search for the wrong guesses."""

    BITS = 22

    def __init__(self, keys: np.ndarray):
        self.keys, self.table = keys, np.zeros(1 << self.BITS, np.int32)
        self.table[self.slot(keys)] = np.arange(len(keys))

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * U(0x9E3779B97F4A7C15)) >> U(64 - self.BITS)

    def of(self, keys: np.ndarray) -> np.ndarray:
        at = self.table[self.slot(keys)]
        wrong = np.flatnonzero(self.keys[at] != keys)
        at[wrong] = np.searchsorted(self.keys, keys[wrong])
        return at


def packed(docs: DataFrame, buckets: tuple[int, int]) -> DataFrame:
    """Rows (chunk, bucket, n, body): for bucket -1 a chunk's ids and texts, else its n keys of a bucket."""

    def run(batch: pa.RecordBatch):
        data, offsets = flat(batch.column(1))
        for lo, hi in chunks(offsets, PIECE):
            n, own, off = hi - lo, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            ids = batch.column(0).slice(lo, n)
            number, valid = ids.fill_null(0).to_numpy().astype(np.int64), np.array(ids.is_valid(), bool)
            text = pa.compress(own.tobytes(), codec="zstd", asbytes=True) if len(own) else b""
            names, sizes, bodies = [-1], [n], [b"".join([np.int64(n).tobytes(), number.tobytes(), valid.tobytes(), off.tobytes(), text])]
            for k, keys in Asked(own, off, buckets):
                names.append(k)
                sizes.append(len(keys))
                bodies.append(shrunk(keys))
            # a name of its own: rows are written once and read from there
            chunk = int.from_bytes(os.urandom(8), "little", signed=True)
            yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(names), pa.int64()), pa.array(names, pa.int32()), pa.array(sizes, pa.int64()), pa.array(bodies, pa.binary())], ["chunk", "bucket", "n", "body"])

    return arrow_map(docs, run, "chunk long, bucket int, n long, body binary")


def of_bucket(model: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Keys of one bucket, sorted, and their counts."""
    keys, c = model["key"].to_numpy().view(np.uint64), model["c"].to_numpy()
    order = np.argsort(keys)
    return keys[order], c[order]


def tops(model: pa.Table) -> pa.Table:
    """(key, n0, n1, below) of depth SHALLOW from one bucket's grams."""
    trees = Subtrees(*of_bucket(model))
    keys, *sums = (np.concatenate(x) for x in zip(*(trees.level(level)[1] for level in range(8)), strict=True))
    return pa.table({"key": pa.array(keys.view(np.int64)), **{name: pa.array(x) for name, x in zip(("n0", "n1", "below"), sums, strict=True)}})


def answer(sent, token_buckets: int):
    """For each chunk that asks a bucket: counts of its tokens (int64) or log10 probabilities of its grams (float32)."""

    def run(requests: pa.Table, model: pa.Table) -> pa.Table:
        keys, c = of_bucket(model)
        asked = [grown(b) for b in requests["body"].to_pylist()]
        every, at = np.unique(np.concatenate([np.zeros(0, np.uint64), *asked]), return_inverse=True)
        if not asked:
            values = np.zeros(0)
        elif requests["bucket"][0].as_py() >= token_buckets:
            trees = Subtrees(keys, c)
            values = log10_of(every, lambda level: sent.value + trees.level(level)[0]).astype(np.float32)
        elif len(keys):
            place = np.minimum(np.searchsorted(keys, every), len(keys) - 1)
            values = np.where(keys[place] == every, c[place], 0).astype(np.int64)
        else:
            values = np.zeros(len(every), np.int64)
        edges = np.cumsum([0, *(len(a) for a in asked)])
        bodies = [values[at[i:j]].tobytes() for i, j in zip(edges[:-1], edges[1:], strict=True)]
        return pa.table({"chunk": requests["chunk"].cast(pa.int64()), "bucket": requests["bucket"].cast(pa.int32()), "body": pa.array(bodies, pa.binary())})

    return run


def gather(n_all: int, distinct: int, buckets: tuple[int, int]):
    """Adds up the answers along the texts of one chunk."""

    def run(rows: pa.Table) -> pa.Table:
        got = dict(zip(rows["bucket"].to_pylist(), rows["body"].to_pylist(), strict=True))
        head = got.pop(-1)
        n = int(np.frombuffer(head, np.int64, 1)[0])
        ids, valid = np.frombuffer(head, np.int64, n, 8), np.frombuffer(head, bool, n, 8 + 8 * n)
        off = np.frombuffer(head, np.int64, n + 1, 8 + 9 * n)
        data = np.frombuffer(pa.decompress(head[16 + 17 * n :], int(off[-1]), codec="zstd", asbytes=True) if off[-1] else b"", np.uint8)
        asked = Asked(data, off, buckets)
        c = np.frombuffer(b"".join(got[k] for k in sorted(got) if k < buckets[0]), np.int64)
        value = np.empty(len(asked.grams), np.float32)
        value[asked.order] = np.frombuffer(b"".join(got[k] for k in sorted(got) if k >= buckets[0]), np.float32)
        log = np.log10((c + 1) / (n_all + distinct + 1))
        end = int(np.searchsorted(asked.tokens, END))
        tokens_at, grams_at = Places(asked.tokens), Places(asked.grams)
        base, known, tokens, total = np.full(n, log[end]), np.full(n, int(c[end] > 0)), np.ones(n, np.int64), np.zeros(n)
        for a, b in chunks(off):
            w = Words(data, off, a, b, lower=True)
            at, doc = tokens_at.of(w.hash), w.doc()
            base[a:b] += np.bincount(doc, log[at], b - a)
            known[a:b] += np.bincount(doc, c[at] > 0, b - a).astype(np.int64)
            tokens[a:b] += w.counts
            code, start = codes(w.data, w.off)
            total[a:b] = np.add.reduceat(value[grams_at.of(code)].astype(np.float64), start[:-1])
        return pa.table({"doc_id": pa.array(ids, mask=~valid), "n_tokens": pa.array(tokens), "n_known": pa.array(known), "base_score": pa.array(base), "score": pa.array(total)})

    return run


def score(docs: DataFrame, trains: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of all rows; the rows where `trains` holds are learnt from."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "ctw")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    counts = scratch.keep(training_counts(docs.where(trains).select(F.col(text_col).cast("string").alias("text"))))
    sizes = {kind: (total, many) for kind, total, many in counts.groupBy("kind").agg(F.sum("c"), F.count("*")).collect()}
    n_all, distinct = sizes.get(0, (0, 0))
    least = [max(LEAST_BUCKETS, math.ceil(sizes.get(kind, (0, 0))[1] / BUCKET_KEYS)) for kind in (0, 1)]
    buckets = least[0], min(least[1], 1 << 24)
    model = counts.select("kind", bucket_column(buckets).alias("bucket"), "key", "c")
    below = model.where("kind = 1").groupBy("bucket").applyInArrow(tops, "key long, n0 double, n1 double, below double")
    # bounded by the number of pairs of bytes, not by the input
    first = below.groupBy("key").agg(*(F.sum(x).alias(x) for x in ("n0", "n1", "below"))).orderBy("key").toArrow()
    sent = spark.sparkContext.broadcast(shallow(first["key"].to_numpy().view(np.uint64), *(first[x].to_numpy() for x in ("n0", "n1", "below"))))
    rows = scratch.keep(packed(own, buckets))
    asked = rows.where("bucket >= 0")
    load = scratch.keep(asked.groupBy("bucket").agg(F.ceil(F.sum("n") / ENTRIES).cast("int").alias("tasks")))
    chunks_all, groups = rows.where("bucket < 0").count(), load.agg(F.sum("tasks")).first()[0] or 0
    salted = asked.join(load, "bucket").select("chunk", "bucket", F.pmod(F.xxhash64("chunk"), "tasks").cast("int").alias("salt"), "body")
    dealt = model.join(load, "bucket").select("bucket", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("salt"), "key", "c")
    # partitions follow the input: a task gets some two groups, or a few chunks
    split = [x.repartition(max(1, math.ceil(groups / 2)), "bucket", "salt") for x in (salted, dealt)]
    answers = split[0].groupBy("bucket", "salt").cogroup(split[1].groupBy("bucket", "salt")).applyInArrow(answer(sent, buckets[0]), "chunk long, bucket int, body binary")
    schema = "doc_id long, n_tokens long, n_known long, base_score double, score double"
    parts = rows.where("bucket < 0").select("chunk", "bucket", "body").union(answers)
    out = parts.repartition(max(1, chunks_all), "chunk").groupBy("chunk").applyInArrow(gather(n_all, distinct, buckets), schema)
    return out.select("doc_id", "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), "base_score", "score")


def bits_per_byte(score_log10: float, text: str) -> float:
    """Code length per byte of a text with that log10 probability."""
    return -score_log10 / math.log10(2) / max(1, len(text.encode()))


__all__ = ["ContextTree", "bits_per_byte", "codes", "score"]
