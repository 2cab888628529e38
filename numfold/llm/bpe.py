"""BPE encoding and decoding in batched numpy merge rounds.

All distinct words of a batch lie in one flat array of symbols. Each round looks up the
rank of every neighbouring pair by binary search over the sorted pair keys, finds the
lowest rank of every word, and merges all places of that pair (left to right where they
overlap), until no word has a known pair left. This equals taking the lowest pair one at
a time because a merge never makes a pair of a lower rank than its own; the loader
checks this for the vocabulary's merges.

Defined results: nulls encode as empty texts; an empty text has no ids and decodes to ''.
Very long words take part like any other, and of pairs with one rank in a word the leftmost
merges first. Repeated rows give repeated results; ids may be null and are carried as they
are; an empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import arrow_map, id_text
from .text import chunks, flat, span_hash

#: Fixed value: the pre-tokenizer's pattern. It takes no white space, so the normalizer's replacement of white space changes nothing.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Texts of these characters alone are split on bytes: all their bytes above ASCII belong to letters.
UNUSUAL = regex.compile(r"[^\t\n\r -~À-ÖØ-öø-ɏ]")
#: What the pattern splits off after an apostrophe.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
KEPT = 200_000
_class = np.full(256, 3, np.uint8)
_class[[9, 10, 11, 12, 13, 32]] = 0
_class[97:123] = _class[65:91] = _class[128:] = 1
_class[48:58] = 2


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names, extra = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in names:
            names[b], extra = chr(extra), extra + 1
    return [names[b] for b in range(256)]


def normal(text: str) -> str:
    """NFC, then each letter lower-cased by itself, so a final sigma is an ordinary one."""
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


class Kept:
    """Ids of repeated words by their 128-bit hash, in flat arrays; it starts anew when KEPT are held."""

    def __init__(self):
        self.hash = self.hash2 = np.zeros(0, np.uint64)
        self.start = self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def find(self, hashes: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Place of each hash with the same second half, or -1."""
        if not len(self.hash):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hash, hashes), len(self.hash) - 1)
        return np.where((self.hash[at] == hashes) & (self.hash2[at] == second), at, -1)

    def add(self, hashes: np.ndarray, second: np.ndarray, start: np.ndarray, size: np.ndarray, ids: np.ndarray) -> None:
        if len(self.hash) + len(hashes) > KEPT:
            self.__init__()
        start = start + len(self.ids)
        self.ids = np.concatenate([self.ids, ids])
        order = np.argsort(np.concatenate([self.hash, hashes]), kind="stable")
        for name, new in (("hash", hashes), ("hash2", second), ("start", start), ("size", size)):
            setattr(self, name, np.concatenate([getattr(self, name), new])[order])


def split_bytes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pattern's words in lower-cased texts without unusual characters."""
    kind = _class[data]
    begin = np.ones(len(data), bool)
    begin[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    begin[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    quote = np.flatnonzero((data == 39) & begin)
    if len(quote):
        last = offsets[np.searchsorted(offsets, quote, "right")]
        padded = np.append(data, [0, 0])
        for tail in CONTRACTIONS:
            at = quote[quote + len(tail) < last]
            for n, c in enumerate(tail.encode(), 1):
                at = at[padded[at + n] == c]
            begin[at + 1] = False
            after = at + 1 + len(tail)
            after = after[after < len(data)]
            begin[after[kind[after] == 1]] = True
    edge = np.append(np.flatnonzero(begin), len(data))
    word = np.flatnonzero(kind[edge[:-1]] != 0)
    return edge[word], edge[word + 1]


class Bpe:
    """A word-end BPE vocabulary read from a tokenizers JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int32)
        first_made = {}
        for rank, c in enumerate(made.tolist()):
            first_made.setdefault(c, rank)
        born = np.array([first_made.get(i, -1) for i in range(max(vocab.values()) + 1)])
        rank = np.arange(len(merges))
        if (born[left] >= rank).any() or (born[right] >= rank).any():
            raise ValueError("a merge uses a symbol that a later merge makes; merge rounds would not be exact")
        keys = (left << 32) | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order, made[order]
        chars = byte_chars()
        self.inner = np.array([vocab[c] for c in chars], np.int32)
        self.final = np.array([vocab[c + suffix] for c in chars], np.int32)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pattern = regex.compile(PATTERN)
        self.kept = Kept()

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, given as UTF-8 bytes, in one flat array, and their number by word."""
        size = np.array([len(w) for w in words], np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        symbol = self.inner[data].astype(np.int64)
        if len(words):
            ends = np.cumsum(size)
            symbol[ends - 1] = self.final[data[ends - 1]]
        word = np.repeat(np.arange(len(words)), size)
        none = len(self.rank)
        done_symbols, done_words = [symbol[:0]], [word[:0]]

        def lookup(left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Rank and made symbol of the pairs that begin at these places."""
            right = np.minimum(left + 1, len(symbol) - 1)
            key = (symbol[left] << 32) | symbol[right]
            at = np.searchsorted(self.keys, key)
            at[at == none] = 0
            known = (self.keys[at] == key) & (word[left] == word[right]) & (left != right)
            return np.where(known, self.rank[at], none), self.made[at]

        rank, made = lookup(np.arange(len(symbol)))
        while len(symbol):
            begin = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(rank, begin)
            best = np.repeat(best, np.diff(np.append(begin, len(word))))
            over = best == none
            if over.any():
                done_symbols.append(symbol[over])
                done_words.append(word[over])
                symbol, word, rank, made, best = (x[~over] for x in (symbol, word, rank, made, best))
            place = np.flatnonzero(rank == best)
            if len(place) > 1:  # of a run of overlapping places every second one stays
                run = np.flatnonzero(np.r_[True, np.diff(place) != 1])
                nth = np.arange(len(place)) - np.repeat(run, np.diff(np.append(run, len(place))))
                place = place[nth % 2 == 0]
            symbol[place] = made[place]
            stay = np.ones(len(symbol), bool)
            stay[place + 1] = False
            symbol, word, rank, made = (x[stay] for x in (symbol, word, rank, made))
            place = place - np.arange(len(place))
            changed = np.zeros(len(symbol) + 1, bool)
            changed[place] = changed[place - 1] = True  # place -1 is the spare last one
            place = np.flatnonzero(changed[:-1])
            rank[place], made[place] = lookup(place)
        symbols, owner = np.concatenate(done_symbols), np.concatenate(done_words)
        return symbols[np.argsort(owner, kind="stable")].astype(np.uint32), np.bincount(owner, minlength=len(words))

    def pieces(self, text: str) -> list[str]:
        """Words of a text, in order; special tokens stand as themselves."""
        out: list[str] = []
        for i, part in enumerate(self.special_split.split(text) if any(x in text for x in self.special) else [text]):
            out += [part] if i % 2 else self.pattern.findall(normal(part))
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        low = [normal(t) if t else "" for t in texts]
        odd = [i for i, (t, n) in enumerate(zip(texts, low, strict=True)) if n and (UNUSUAL.search(n) or any(x in t for x in self.special))]
        out = [b""] * len(texts)
        for i in odd:
            out[i], low[i] = self.encode_words(self.pieces(texts[i])), ""
        parts = [n.encode() for n in low]
        data = np.frombuffer(b"".join(parts), np.uint8)
        if not len(data):
            return out
        offsets = np.cumsum([0, *map(len, parts)])
        start, end = split_bytes(data, offsets)
        both, second = span_hash(data, start, end)
        hashes, first, inverse, times = np.unique(both, return_index=True, return_inverse=True, return_counts=True)
        if (second[first][inverse] != second).any():  # half a hash in common: told apart by the other half
            pairs, first, inverse, times = np.unique(np.stack([both, second], axis=1), axis=0, return_index=True, return_inverse=True, return_counts=True)
            hashes, inverse = pairs[:, 0], inverse.reshape(-1)
        second = second[first]
        at = self.kept.find(hashes, second)
        new = np.flatnonzero(at < 0)
        whole = data.tobytes()
        ids, size = self.merge([whole[a:b] for a, b in zip(start[first[new]].tolist(), end[first[new]].tolist(), strict=True)])
        # kept ids stand before the new ones
        begin, count = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        old = at >= 0
        begin[old], count[old] = self.kept.start[at[old]], self.kept.size[at[old]]
        begin[new], count[new] = len(self.kept.ids) + np.cumsum(size) - size, size
        pool = np.concatenate([self.kept.ids, ids])
        n = count[inverse]
        upto = np.concatenate([[0], np.cumsum(n)])
        coded = pool[np.repeat(begin[inverse] - upto[:-1], n) + np.arange(upto[-1])].astype("<u4")
        bound = upto[np.searchsorted(start, offsets)].tolist()
        for i, (a, b) in enumerate(zip(bound[:-1], bound[1:], strict=True)):
            if b > a:
                out[i] = coded[a:b].tobytes()
        again = times[new] > 1
        if again.any():
            chosen = np.repeat(again, size)
            kept_size = size[again]
            self.kept.add(hashes[new][again], second[new][again], np.cumsum(kept_size) - kept_size, kept_size, ids[chosen])
        return out

    def encode_words(self, words: list[str]) -> bytes:
        ordinary = list({w for w in words if w not in self.special})
        ids, size = self.merge([w.encode() for w in ordinary])
        coded = {w: x.tobytes() for w, x in zip(ordinary, np.split(ids.astype("<u4"), np.cumsum(size)[:-1]), strict=False)}
        coded |= {w: np.array([i], "<u4").tobytes() for w, i in self.special.items()}
        return b"".join([coded[w] for w in words])

    def decode(self, ids: bytes) -> str:
        """The text of ids; special tokens stay, and without a decoder tokens are joined by a space."""
        return " ".join(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_loaded: dict[str, Bpe] = {}


def bpe(path: str) -> Bpe:
    """The vocabulary of a file, read once in each Python process."""
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, ids binary, n_tokens long): whole texts as little-endian 32-bit ids."""

    def run(batch: pa.RecordBatch):
        coder = bpe(vocabulary)
        _, offsets = flat(batch.column(1))
        for lo, hi in chunks(offsets):
            part = batch.slice(lo, hi - lo)
            ids = coder.encode(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array([len(b) // 4 for b in ids], pa.int64())], ["doc_id", "ids", "n_tokens"])

    return arrow_map(id_text(docs, id_col, text_col), run, "doc_id long, ids binary, n_tokens long")


def decode(coded: DataFrame, vocabulary: str) -> DataFrame:
    """Adds decoded string to rows (doc_id, ids, n_tokens)."""

    def run(batch: pa.RecordBatch):
        coder = bpe(vocabulary)
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            text = [coder.decode(b or b"") for b in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(text, pa.string())], [*part.schema.names, "decoded"])

    return arrow_map(coded.select("doc_id", "ids", "n_tokens"), run, "doc_id long, ids binary, n_tokens long, decoded string")


def round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encodes and decodes in one pass: (doc_id, n_tokens, ids_sha256, decoded_sha256), and ids if asked for."""

    def run(batch: pa.RecordBatch):
        coder = bpe(vocabulary)
        _, offsets = flat(batch.column(1))
        for lo, hi in chunks(offsets):
            part = batch.slice(lo, hi - lo)
            ids = coder.encode(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([len(b) // 4 for b in ids], pa.int64()),
                    pa.array([hashlib.sha256(b).hexdigest() for b in ids]),
                    pa.array([hashlib.sha256(coder.decode(b).encode()).hexdigest() for b in ids]),
                    *([pa.array(ids, pa.binary())] if with_ids else []),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: 4 + with_ids],
            )

    return arrow_map(id_text(docs, id_col, text_col), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids)
