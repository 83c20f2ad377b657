"""Secrets through a trigram index: Boolean queries from regular expressions, postings, verification (operator 10)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import product
from re import _constants as op
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, stage, text_buffer
from .words import LOWER

# Kind, pattern, group that is measured, and its least length. The first three are the base kinds.
RULES = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"""AKIA[A-Z0-9]+""", 0, 20),
    ("hex", r"""[0-9a-f]+""", 0, 24),
    ("private-key", r"""-----BEGIN (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----""", 0, 1),
    ("github", r"""gh[pousr]_[A-Za-z0-9]+""", 0, 40),
    ("slack", r"""xox[abprs]-[A-Za-z0-9-]+""", 0, 20),
    ("jwt", r"""eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+""", 0, 40),
]
BASE = 3
#: Strings a part of a pattern may stand for before it counts as unknown.
MOST_STRINGS = 64

Alternatives = frozenset[frozenset[str]]


def trigrams(s: str) -> frozenset[str]:
    return frozenset(s[i:i + 3] for i in range(len(s) - 2))


def _strings(items) -> set[str] | None:
    """All lower-cased strings a parsed part can match, or None when there are too many."""
    out = {""}
    for kind, arg in items:
        if kind is op.LITERAL:
            more = {chr(arg).lower()}
        elif kind is op.IN and all(k in (op.LITERAL, op.RANGE) for k, _ in arg):
            more = {chr(c).lower() for k, a in arg for c in ([a] if k is op.LITERAL else range(a[0], a[1] + 1))}
        elif kind is op.SUBPATTERN:
            more = _strings(arg[3])
        elif kind is op.BRANCH:
            parts = [_strings(p) for p in arg[1]]
            more = None if None in parts else set().union(*parts)
        elif kind is op.MAX_REPEAT and arg[1] <= 2:
            part = _strings(arg[2])
            more = None if part is None or len(part) ** arg[1] > MOST_STRINGS else {"".join(p) for n in range(arg[0], arg[1] + 1) for p in product(part, repeat=n)}
        else:
            return None
        if more is None or len(out) * len(more) > MOST_STRINGS:
            return None
        out = {a + b for a in out for b in more}
    return out


def clauses(pattern: str) -> list[Alternatives]:
    """A Boolean query every match satisfies: an AND of clauses, each an OR of sets of trigrams that must all be there."""
    found: list[Alternatives] = []

    def close(strings: set[str]) -> None:
        if strings and all(len(s) >= 3 for s in strings):
            found.append(frozenset(trigrams(s) for s in strings))

    def walk(items) -> None:
        run = {""}
        for item in items:
            more = _strings([item])
            if more is not None and len(run) * len(more) <= MOST_STRINGS:
                run = {a + b for a in run for b in more}
                continue
            close(run)
            run = {""} if more is None else more
            if more is None and item[0] is op.SUBPATTERN:
                walk(item[1][3])
            elif more is None and item[0] is op.MAX_REPEAT and item[1][0] >= 1:
                walk(item[1][2])
        close(run)

    walk(parser.parse(pattern))
    return found


QUERIES = [clauses(p) for _, p, _, _ in RULES]
TERMS = sorted({t for q in QUERIES for c in q for a in c for t in a})
_CODES = np.array(sorted(int.from_bytes(t.encode(), "big") for t in TERMS), np.uint32)
_SIEVE = np.zeros(1 << 16, bool)
_SIEVE[(_CODES * np.uint32(0x9E3779B1)) >> np.uint32(16)] = True


def query_table(spark: SparkSession) -> DataFrame:
    """term, rule, clause, alternative and the terms the alternative needs; as large as the fixed rules."""
    rows = [(int.from_bytes(t.encode(), "big"), r, c, i, len(a)) for r, q in enumerate(QUERIES) for c, alternatives in enumerate(q)
            for i, a in enumerate(sorted(alternatives, key=sorted)) for t in a]
    return spark.createDataFrame(rows, "term long, rule int, clause int, alternative int, need int")


def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, text) to distinct (term, row) for the trigrams that some query names."""
    for b in batches:
        number = b.column(0).to_numpy()
        for row, end, offsets, data in pieces(b.column(1)):
            low = LOWER[data].astype(np.uint32)
            code = low[:-2] << np.uint32(16) | low[1:-1] << np.uint32(8) | low[2:] if len(low) > 2 else np.zeros(0, np.uint32)
            at = np.flatnonzero(_SIEVE[code * np.uint32(0x9E3779B1) >> np.uint32(16)])
            which = np.searchsorted(_CODES, code[at])
            hit = (_CODES[np.minimum(which, len(_CODES) - 1)] == code[at])
            at, which = at[hit], which[hit]
            text = np.searchsorted(offsets, at, "right") - 1
            whole = at + 3 <= offsets[text + 1]
            pairs = np.unique(text[whole] * len(_CODES) + which[whole])
            yield pa.RecordBatch.from_arrays([pa.array(_CODES[pairs % len(_CODES)].astype(np.int64)), pa.array(number[row:end][pairs // len(_CODES)])], ["term", "row"])


def candidates(rows: DataFrame) -> DataFrame:
    """row and a bit mask of the rules whose query its postings satisfy. Texts under one `row` share their postings, and so get all rules of either."""
    index = rows.select("row", "text").mapInArrow(postings, "term long, row long").distinct()
    met = index.join(F.broadcast(query_table(rows.sparkSession)), "term")
    full = met.groupBy("row", "rule", "clause", "alternative", "need").agg(F.count(F.lit(1)).alias("n")).filter("n = need")
    counts = F.get(F.array(*[F.lit(len(q)) for q in QUERIES]), F.col("rule"))
    per_rule = full.groupBy("row", "rule").agg(F.count_distinct("clause").alias("n")).filter(F.col("n") == counts)
    return per_rule.groupBy("row").agg(F.bit_or(F.expr("shiftleft(1, rule)")).alias("mask"))


SPANS = "array<struct<kind:string,start:int,end:int>>"


def code_points(text: bytes, at: list[int]) -> list[int]:
    """Code points before each of some ascending byte places, in one pass over the text."""
    if not at:
        return []
    first = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80
    return np.cumsum([np.count_nonzero(first[a:b]) for a, b in zip([0, *at[:-1]], at)]).tolist()


def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, mask) to doc_id and spans: candidates' rules, and rules without a query on every text."""
    compiled = [(n, re.compile(p.encode()), g, least, not q) for (n, p, g, least), q in zip(RULES, QUERIES)]
    # A run of one class is at least so long or not found at all: the same spans, without stopping at short runs.
    compiled = [(n, re.compile(p.pattern[:-1] + b"{%d,}" % least) if re.fullmatch(rb"\[[^\]]*\]\+", p.pattern) else p, g, least, full) for n, p, g, least, full in compiled]
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    for b in batches:
        offsets, data = text_buffer(b.column(1))
        flat, at = memoryview(data), offsets.tolist()
        out = []
        for s, e, mask in zip(at[:-1], at[1:], b.column(2).fill_null(0).to_pylist()):
            text, found = bytes(flat[s:e]), []
            for i, (name, pattern, group, least, full) in enumerate(compiled):
                if full or mask >> i & 1:
                    found += [(m.start(), i, name, m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
            found.sort()
            ends = sorted({x for f in found for x in (f[0], f[3])})
            place = dict(zip(ends, code_points(text, ends)))
            out.append([{"kind": n, "start": place[x], "end": place[y]} for x, _, n, y in found])
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, kind)], ["doc_id", "spans"])


def scan(df: DataFrame) -> DataFrame:
    """doc_id and spans (kind, start, end in code points, end exclusive) of every row of `df` (doc_id, text).

    Spans of a kind are leftmost and do not overlap; matches whose measured group is
    too short are dropped. Order: start, then kind as listed. A rule with mandatory
    trigrams looks only at texts whose postings satisfy its query; a rule without
    looks at all. Null and empty texts have no span. Postings are kept by a hash of
    the text, so it does not matter how the input is split when it is read again
    for verification; a text of any length is scanned once per rule, and its places
    are counted in one pass.
    """
    rows = df.select(F.xxhash64("text").alias("row"), "doc_id", "text")
    masks = stage(candidates(rows), "candidates")
    return rows.join(masks, "row", "left").select("doc_id", "text", "mask").mapInArrow(verify, f"doc_id long, spans {SPANS}")
