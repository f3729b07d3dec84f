"""Secret scans with a trigram inverted index.

Each rule's regular expression gives a Boolean query over trigrams that every match must contain. Documents are
indexed in segments (the rows of one Arrow batch): a segment's postings are one bitmap a trigram over its rows, kept
only for trigrams that some rule asks for. Queries intersect and unite postings; only candidates are searched with
the regular expression. Rules without mandatory trigrams search every row. A segment is indexed, queried and
verified where it lies, so no text is shuffled and a hot source or a group of copies is spread as the input is.

Defined results: null and empty texts have no spans; rows keep their number, repeated rows give repeated results;
spans are code points, end exclusive; of equal starts the rule listed first comes first; null and equal ids are scanned
like others; very long texts are indexed in pieces and searched whole; columns named like results are replaced, others
stay; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as C
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, UPPER, forget, prepare, table

FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: Most alternatives kept while a rule's strings are spelled out, and the largest class that is spelled out.
SPELLED, CLASS = 64, 4
#: Bytes indexed at once; longer texts are indexed in pieces that overlap by two bytes.
PIECE = 8 << 20


def _either(words: str) -> str:
    """A pattern for a word in either case, ASCII letters only."""
    return "".join(f"[{c.upper()}{c}]" if c in LOWER else c for c in words)


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a pattern, the group whose length counts, and its least length."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


KEYWORDS = ["password", "passwd", "secret", "token", "api_?key"]
BASE = [
    Rule("assign", "(" + "|".join(map(_either, KEYWORDS)) + ")[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    Rule("access", "AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", "[0-9a-f]{32,}"),  # the runs of [0-9a-f]+ that are long enough
]
#: Forms of well-known credentials, on top of the base rules.
MORE = [
    Rule("private_key", "-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("github", "gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", "AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
]
RULES = BASE + MORE

#: A query: True (no condition), a trigram, or ("and" | "or", queries).
Query = bool | bytes | tuple


def _join(op: str, parts: list[Query]) -> Query:
    if op == "or" and any(p is True for p in parts):
        return True
    parts = list(dict.fromkeys(p for p in parts if p is not True))
    return True if not parts else parts[0] if len(parts) == 1 else (op, tuple(parts))


def _grams(words: set[str]) -> Query:
    """What holds where one of these strings occurs."""
    least = [w for w in words if not any(v != w and v in w for v in words)]
    spelled = [w.encode().translate(FOLD) for w in sorted(least)]
    return _join("or", [_join("and", [w[i : i + 3] for i in range(len(w) - 2)]) for w in spelled])


def trigram_query(pattern: str) -> Query:
    """The Boolean trigram query of a regular expression, over texts in lower case (A-Z only)."""

    def spell(nodes) -> tuple[set[str] | None, Query]:
        """All strings that nodes match, if few; else what any match contains."""
        words, asked, open_ended = {""}, [], False
        for op, arg in nodes:
            exact, q = None, True
            if op is C.LITERAL:
                exact = {chr(arg)}
            elif op is C.IN and all(k is C.LITERAL for k, _ in arg):
                exact = {chr(v) for _, v in arg}
            elif op is C.SUBPATTERN:
                exact, q = spell(arg[3])
            elif op is C.BRANCH:
                sides = [spell(x) for x in arg[1]]
                exact = set().union(*(e for e, _ in sides)) if all(e is not None for e, _ in sides) else None
                q = _join("or", [_grams(e) if e is not None else x for e, x in sides])
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
                low, high, inner = arg
                e, x = spell(inner)
                if (low, high) == (0, 1) and e is not None:
                    exact = e | {""}
                elif low:
                    q = _grams(e) if e is not None else x
            elif op in (C.AT, C.ASSERT, C.ASSERT_NOT):
                continue
            if exact is not None:
                exact = {w.translate(str.maketrans(UPPER, LOWER)) for w in exact}
            if exact is not None and len(exact) <= 2 * CLASS + 4 and len(words) * len(exact) <= SPELLED:
                words = {a + b for a in words for b in exact}
            else:
                asked += [_grams(words), q if exact is None else _grams(exact)]
                words, open_ended = {""}, True
        return (None, _join("and", [*asked, _grams(words)])) if open_ended else (words, _grams(words))

    return spell(parser.parse(pattern))[1]


def trigrams_of(q: Query) -> set[bytes]:
    return set() if q is True else {q} if isinstance(q, bytes) else set().union(*map(trigrams_of, q[1]))


class SegmentIndex:
    """Indexes segments of texts for the trigrams of some queries, and answers the queries on them."""

    def __init__(self, rules: list[Rule]):
        self.queries = [trigram_query(r.pattern) for r in rules]
        grams = sorted(set().union(*map(trigrams_of, self.queries)))
        self.place = {g: i for i, g in enumerate(grams)}
        self.at = np.zeros(1 << 24, np.int16)
        for g, i in self.place.items():
            self.at[g[0] | g[1] << 8 | g[2] << 16] = i + 1

    def postings(self, texts: list[bytes]) -> np.ndarray:
        """A bitmap a trigram (columns) over the texts (rows)."""
        out = np.zeros((len(texts), len(self.place)), bool)
        pieces = [(i, t[j : j + PIECE + 2]) for i, t in enumerate(texts) for j in range(0, max(len(t), 1), PIECE)]
        held, size = [], 0
        for i, t in [*pieces, (-1, b"")]:
            if held and (i < 0 or size + len(t) > PIECE):
                # bytes that UTF-8 never has stand between texts
                data = np.frombuffer(b"\xff\xff".join(x for _, x in held).translate(FOLD) + b"\xff\xff", np.uint8)
                code = data[:-2].astype(np.int32)
                code |= data[1:-1].astype(np.int32) << 8
                code |= data[2:].astype(np.int32) << 16
                gram = self.at[code]
                found = np.flatnonzero(gram)
                ends = np.cumsum([len(x) + 2 for _, x in held])
                rows = np.array([k for k, _ in held])[np.searchsorted(ends, found, "right")]
                out[rows, gram[found] - 1] = True
                held, size = [], 0
            held.append((i, t))
            size += len(t)
        return out

    def candidates(self, q: Query, postings: np.ndarray) -> np.ndarray:
        if q is True:
            return np.ones(len(postings), bool)
        if isinstance(q, bytes):
            return postings[:, self.place[q]]
        sides = [self.candidates(x, postings) for x in q[1]]
        return np.logical_and.reduce(sides) if q[0] == "and" else np.logical_or.reduce(sides)


def _spans(texts: list[str | None], rules: list[Rule], index: SegmentIndex, compiled: list[re.Pattern]) -> list[list[tuple[int, int, int]]]:
    """(start, rule, end) of each text's matches, sorted."""
    postings = index.postings([t.encode("utf-8", "surrogatepass") if t else b"" for t in texts])
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for k, (rule, q, pattern) in enumerate(zip(rules, index.queries, compiled, strict=True)):
        for i in np.flatnonzero(index.candidates(q, postings)).tolist():
            if texts[i]:
                out[i] += [(m.start(), k, m.end()) for m in pattern.finditer(texts[i]) if m.end(rule.group) - m.start(rule.group) >= rule.least]
    return [sorted(x) for x in out]


def find_secrets(docs: DataFrame, text: str = "text", rules: list[Rule] = RULES, base: list[Rule] = BASE, mask: str | None = None) -> DataFrame:
    """Adds n_<kind> for the base kinds, base_sha256 and spans ("kind:start:end,..."); columns of these names are replaced.

    With mask, each secret in the text is replaced by it as well (of overlapping spans, their union).
    """
    names = [f"n_{r.kind}" for r in base] + ["base_sha256", "spans"]
    kept = docs.drop(*[n for n in names if n != text])
    schema = T.StructType([*kept.schema.fields, *(T.StructField(n, T.LongType()) for n in names[:-2]), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()  # this operator remembers nothing between tasks
        index, compiled = SegmentIndex(rules), [re.compile(r.pattern) for r in rules]
        own = {k: r.kind for k, r in enumerate(rules) if r in base}
        for b in batches:
            texts = b.column(text).to_pylist()
            spans = _spans(texts, rules, index, compiled)
            spell = lambda xs: ",".join(f"{rules[k].kind}:{s}:{e}" for s, k, e in xs)
            first = [[x for x in xs if x[1] in own] for xs in spans]
            columns = [pa.array([sum(own[k] == r.kind for _, k, _ in xs) for xs in first], pa.int64()) for r in base]
            columns += [pa.array([hashlib.sha256(spell(xs).encode()).hexdigest() for xs in first], pa.string()), pa.array([spell(xs) for xs in spans], pa.string())]
            old = list(b.columns)
            if mask is not None:
                old[b.schema.get_field_index(text)] = pa.array([masked(t, xs, mask) for t, xs in zip(texts, spans, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*old, *columns], names=[*b.schema.names, *names])

    return kept.mapInArrow(run, schema)


def masked(text: str | None, spans: list[tuple[int, int, int]], mask: str) -> str | None:
    if not spans:
        return text
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])


def index_postings(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """The index as a table (trigram, keys): one row a trigram and segment, for storing and querying apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = SegmentIndex(rules)
        for b in batches:
            found = index.postings([t.encode("utf-8", "surrogatepass") if t else b"" for t in b.column(text).to_pylist()])
            keys = np.array(b.column(key).to_pylist(), dtype=object)
            rows = [{"trigram": g.decode(), "keys": keys[found[:, i]].tolist()} for g, i in index.place.items() if found[:, i].any()]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("trigram", pa.string()), ("keys", pa.list_(pa.int64()))]))

    return docs.select(F.col(key).cast("long").alias(key), text).mapInArrow(run, "trigram string, keys array<long>")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents").select("doc_id", "text")
    return find_secrets(docs).drop("text")
