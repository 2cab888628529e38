"""Secret scanning over a trigram inverted index.

Each rule is a regular expression and a test of its matches. From the expression's syntax
tree a Boolean query over lower-cased byte trigrams is derived that every match must
satisfy. Each Arrow batch is an index segment: postings from the queried trigrams to the
segment's documents are built in one vectorised pass, queries are intersected and united
on postings, and only the candidates are verified by the expression. A rule without a
mandatory trigram (runs of hex digits) scans every document.

Matches are leftmost and do not overlap within one kind; starts and ends are code points,
ends exclusive. Kinds beyond the first three add spans and change no base one.

Defined results: null and empty texts have no spans; long texts are scanned whole; repeated
rows each give a row; spans that begin at one place stand in the order of the kinds; ids may
be null; an empty table gives no rows. scan() reads two columns; redacted() keeps all columns
whatever their names, and of overlapping spans the one that begins first names the gap.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from re import _constants as sre
from re import _parser as sre_parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, id_text
from .text import LOWER, chunks, flat

ANY = ("and", ())
MOST = 48


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    keep: Callable[[re.Match], bool] = lambda m: True


def either(words: str) -> str:
    """ASCII letters in either case, all else as it stands."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


#: The base kinds, in order, then further formats of published token types.
RULES = (
    Rule("assign", f"({either('password|passwd|secret|token|api_?key')})" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 12),
    Rule("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18),
    # greedy runs of 16 and more are the runs [0-9a-f]+ that are long enough
    Rule("hex", r"[0-9a-f]{16,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
BASE = ("assign", "access", "hex")


def trigrams(strings: frozenset[bytes]):
    """Query that holds for every text with one of the strings."""
    if not strings or min(map(len, strings)) < 3:
        return ANY
    return ("or", tuple(("and", tuple(sorted({s[i : i + 3] for i in range(len(s) - 2)}))) for s in sorted(strings)))


def choices(node, arg) -> frozenset[bytes] | None:
    """All lower-cased strings an item can match, if they are few."""
    if node is sre.LITERAL:
        return frozenset([chr(arg).lower().encode()])
    if node is sre.IN:
        out = set()
        for kind, value in arg:
            if kind is sre.LITERAL:
                out.add(chr(value).lower().encode())
            elif kind is sre.RANGE and value[1] - value[0] < 8:
                out.update(chr(c).lower().encode() for c in range(value[0], value[1] + 1))
            else:
                return None
        return frozenset(out) if len(out) <= 8 else None
    if node is sre.SUBPATTERN:
        return sequence_choices(arg[3])
    if node is sre.BRANCH:
        parts = [sequence_choices(p) for p in arg[1]]
        return None if None in parts or sum(map(len, parts)) > MOST else frozenset().union(*parts)
    if node in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[1] <= 2:
        one = sequence_choices(arg[2])
        if one is None:
            return None
        out, power = set(), {b""}
        for n in range(int(arg[1]) + 1):
            if n >= arg[0]:
                out |= power
            power = {a + b for a in power for b in one}
        return frozenset(out) if len(out) <= MOST else None
    return None


def sequence_choices(items) -> frozenset[bytes] | None:
    out = frozenset([b""])
    for node, arg in items:
        part = choices(node, arg)
        if part is None or len(out) * len(part) > MOST:
            return None
        out = frozenset(a + b for a in out for b in part)
    return out


def derive(items):
    """Boolean trigram query that every match of a parsed sequence satisfies."""
    needs, run = [], frozenset([b""])
    for node, arg in items:
        part = choices(node, arg)
        if part is not None and len(run) * len(part) <= MOST:
            run = frozenset(a + b for a in run for b in part)
            continue
        needs.append(trigrams(run))
        run = part if part is not None else frozenset([b""])
        if part is None:
            if node is sre.SUBPATTERN:
                needs.append(derive(arg[3]))
            elif node is sre.BRANCH:
                branches = [derive(p) for p in arg[1]]
                needs.append(ANY if ANY in branches else ("or", tuple(branches)))
            elif node in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1:
                needs.append(derive(arg[2]))
    needs.append(trigrams(run))
    needs = [n for n in needs if n != ANY]
    return needs[0] if len(needs) == 1 else ("and", tuple(needs))


def query(pattern: str):
    return derive(sre_parser.parse(pattern))


def leaves(q) -> set[bytes]:
    return {q} if isinstance(q, bytes) else set().union(*map(leaves, q[1]))


def select(q, postings: dict[bytes, np.ndarray], everything: np.ndarray) -> np.ndarray:
    """Sorted documents of a segment that satisfy a query."""
    if isinstance(q, bytes):
        return postings[q]
    out = everything if q[0] == "and" else everything[:0]
    for part in sorted(q[1], key=lambda p: len(postings[p]) if isinstance(p, bytes) else 1 << 60):
        found = select(part, postings, everything)
        out = np.intersect1d(out, found, assume_unique=True) if q[0] == "and" else np.union1d(out, found)
        if q[0] == "and" and not len(out):
            break
    return out


class Segment:
    """Postings of the queried trigrams over the documents of a flat column."""

    def __init__(self, wanted: list[bytes], table: np.ndarray, data: np.ndarray, offsets: np.ndarray):
        self.everything = np.arange(len(offsets) - 1)
        low = LOWER[data].astype(np.uint32)
        self.postings = {w: self.everything[:0] for w in wanted}
        if len(low) < 3:
            return
        ids = table[(low[:-2] << 16) | (low[1:-1] << 8) | low[2:]]
        at = np.flatnonzero(ids)
        doc = np.searchsorted(offsets, at, "right") - 1
        inside = at + 3 <= offsets[doc + 1]
        doc, ids = doc[inside], ids[at][inside]
        for i, w in enumerate(wanted, 1):
            self.postings[w] = np.unique(doc[ids == i])


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = [(r.kind, re.compile(r.pattern), r.keep, query(r.pattern)) for r in rules]
        self.wanted = sorted(set().union(*(leaves(q) for *_, q in self.rules)))
        self.table = np.zeros(1 << 24, np.uint8 if len(self.wanted) < 255 else np.uint16)
        for i, w in enumerate(self.wanted, 1):
            self.table[int.from_bytes(w, "big")] = i

    def scan(self, column: pa.Array) -> list[list[tuple[int, int, str, int]]]:
        """Spans (start, kind's place, kind, end) of each text, sorted."""
        segment = Segment(self.wanted, self.table, *flat(column))
        texts = column.to_pylist()
        found: list[list[tuple[int, int, str, int]]] = [[] for _ in texts]
        for k, (kind, regex, keep, q) in enumerate(self.rules):
            for d in select(q, segment.postings, segment.everything).tolist():
                if texts[d]:
                    found[d] += [(m.start(), k, kind, m.end()) for m in regex.finditer(texts[d]) if keep(m)]
        for spans in found:
            spans.sort()
        return found


_scanners: dict[tuple[str, ...], Scanner] = {}


def scanner(rules: tuple[Rule, ...]) -> Scanner:
    key = tuple(r.kind + r.pattern for r in rules)
    if key not in _scanners:
        _scanners[key] = Scanner(rules)
    return _scanners[key]


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, spans array<struct<kind, start, end>>) sorted by start, then kind as listed."""

    def run(batch: pa.RecordBatch):
        s = scanner(rules)
        _, offsets = flat(batch.column(1))
        for lo, hi in chunks(offsets):
            part = batch.slice(lo, hi - lo)
            spans = [[{"kind": kind, "start": a, "end": b} for a, _, kind, b in x] for x in s.scan(part.column(1))]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(spans, kind)], ["doc_id", "spans"])

    return arrow_map(id_text(docs, id_col, text_col), run, "doc_id long, spans array<struct<kind:string,start:bigint,end:bigint>>")


def redact(text: str, spans: list[tuple[int, int, str, int]]) -> str:
    """The text with every span replaced by <kind>; overlapping spans become one."""
    out, last = [], 0
    for a, _, kind, b in spans:
        if a >= last:
            out += [text[last:a], f"<{kind}>"]
        last = max(last, b)
    return "".join(out) + text[last:]


def redacted(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """The same rows and columns with the secrets of `text_col` replaced."""
    names = docs.columns

    def run(batch: pa.RecordBatch):
        s, at = scanner(rules), names.index(text_col)
        _, offsets = flat(batch.column(at))
        for lo, hi in chunks(offsets):
            part = batch.slice(lo, hi - lo)
            texts, found = part.column(at).to_pylist(), s.scan(part.column(at))
            new = [redact(t, spans) if spans else t for t, spans in zip(texts, found, strict=True)]
            columns = [pa.array(new, pa.string()) if i == at else c for i, c in enumerate(part.columns)]
            yield pa.RecordBatch.from_arrays(columns, names)

    return arrow_map(docs, run, docs.schema)


def digest(spans: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of scan()'s rows."""
    from pyspark.sql import functions as F

    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    line = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return spans.select("doc_id", *map(of, BASE), F.sha2(line(base).cast("binary"), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))


__all__ = ["BASE", "RULES", "Rule", "digest", "query", "redacted", "scan", "scanner"]
