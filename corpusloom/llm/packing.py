"""Packing of token ids into training sequences by multiway differencing.

A document's whole sequences stand alone; what is left of it, less than a sequence, is packed. Each task packs the
rests that it meets in groups of some hundred windows. Karmarkar and Karp's differencing merges partial partitions of a
group into windows, always the two with the greatest imbalance, the heaviest windows of one with the lightest of the
other, until one partition is left, whose windows are near equal; while its heaviest exceeds the capacity, the number of
windows rises and the group is merged anew. What near-equal windows leave free is then filled: the lightest windows are
dissolved and their rests cut to what the others lack. What doesn't fill a sequence is cut into powers of two.
So nothing is padded, and rests are cut only where windows are filled or dissolved.

Nothing is shuffled, and a task holds the ids of one group and one Arrow batch. Sequence ids are unique, made of the
task's number and a count; a task that runs again makes the same ones.

Defined results: a null text counts as an empty one, whose only id is the end id; repeated rows and null ids are packed
like other rows; an empty table gives no rows; columns other than the key are left out.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from collections import namedtuple
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import prepare, remembered, table

#: Tokens of a sequence, windows that are packed together, and the id that ends a document.
CAPACITY, WINDOWS, END = 2048, 512, 1
#: Stretches that a worker remembers; as many again are kept from before.
KNOWN = 1 << 19


def _class(pattern: str) -> str:
    """The characters below 65,536 that match, as ranges: re looks them up in a table and asks nothing of each."""
    places = np.array([m.start() for m in re.finditer(pattern, "".join(map(chr, range(1 << 16))))])
    runs = np.split(places, np.flatnonzero(np.diff(places) > 1) + 1)
    return "".join(f"\\u{r[0]:04x}-\\u{r[-1]:04x}" for r in runs)


_LETTER, _DIGIT, _SPACE = _class(r"[^\W\d_]"), _class(r"\d"), _class(r"\s")
#: How a byte-level vocabulary parts a text before it merges; stretches don't influence each other. All characters are in
#: some stretch; letters and digits beyond 65,535 count as signs, which the library tells otherwise (`Encoder._same_class`).
STRETCHES = re.compile(rf" ?[{_LETTER}]+|'(?:s|t|re|ve|m|ll|d)| ?[{_DIGIT}]+| ?[^{_LETTER}{_DIGIT}{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
Piece = namedtuple("Piece", "doc start length")
OUT = {"start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "doc_tokens": pa.int64(), "sequence_id": pa.int64(), "offset": pa.int64()}


def differencing(sizes: list[int], windows: int) -> list[list[int]]:
    """The numbers of sizes in each of `windows` near-equal windows, the heaviest first.

    A partial partition holds only its windows that aren't empty: their sizes, descending, and a node each. A node is
    an item, or the sum of two nodes.
    """
    heap = [(-s, i, np.array([s]), np.array([i])) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    left, right, count = [], [], len(heap)
    while len(heap) > 1:
        (_, _, a, x), (_, _, b, y) = heapq.heappop(heap), heapq.heappop(heap)
        meet = max(0, len(a) + len(b) - windows)
        i, j = len(a) - meet, len(b) - meet
        new = len(sizes) + len(left) + np.arange(meet)
        left += x[i:].tolist()
        right += y[j:][::-1].tolist()
        s = np.concatenate([a[:i], b[:j], a[i:] + b[j:][::-1]])  # the lighter of one with the heavier of the other
        n = np.concatenate([x[:i], y[:j], new])
        order = np.argsort(-s, kind="stable")
        s, n = s[order], n[order]
        heapq.heappush(heap, (int((s[-1] if len(s) == windows else 0) - s[0]), count, s, n))
        count += 1
    out = []
    for node in heap[0][3].tolist() if heap else []:
        items, open_ = [], [node]
        while open_:
            if (k := open_.pop()) < len(sizes):
                items.append(k)
            else:
                open_ += [left[k - len(sizes)], right[k - len(sizes)]]
        out.append(sorted(items))
    return out


def balanced(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Near-equal windows of at most `capacity`, from the least number that could do on; the number rises until they fit."""
    total = sum(sizes)
    windows = -(-total // capacity)
    while True:
        out = differencing(sizes, windows)
        heaviest = max((sum(sizes[i] for i in w) for w in out), default=0)
        if heaviest <= capacity:
            return out
        windows += max(1, windows * (heaviest * windows - total) // total // 2)  # half of what this imbalance would need


def joined(rests: list[Piece], least: int) -> list[list[Piece]]:
    """The rests, those shorter than `least` together with the next short ones until they have as many ids."""
    out, short, size = [[p] for p in rests if p.length >= least], [], 0
    for p in rests:
        if p.length < least:
            short.append(p)
            size += p.length
            if size >= least:
                out.append(short)
                short, size = [], 0
    return out + [short] if short else out


def packed(rests: list[Piece], capacity: int = CAPACITY) -> list[list[Piece]]:
    """Sequences of all ids of the rests, each rest below the capacity: full ones, then powers of two."""
    items = joined(rests, capacity // 32)
    windows = [[p for i in w for p in items[i]] for w in balanced([sum(p.length for p in x) for x in items], capacity)]
    full, last = divmod(sum(p.length for p in rests), capacity)
    goals = [(w, capacity - sum(p.length for p in w)) for w in windows[:full]]
    goals += [([], 1 << k) for k in range(last.bit_length()) if last >> k & 1]
    spare = sorted((p for w in windows[full:] for p in w), key=lambda p: p.length)
    for window, lack in sorted(goals, key=lambda g: -g[1]):
        while lack:
            p = spare.pop()
            if p.length > lack:
                spare.append(Piece(p.doc, p.start + lack, p.length - lack))
                p = Piece(p.doc, p.start, lack)
            window.append(p)
            lack -= p.length
    return [g[0] for g in goals]


def _letters() -> dict[int, str]:
    """How a byte-level vocabulary writes bytes: printable ones as themselves, the rest as the characters from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in plain else next(rest)) for b in range(256)}


class Unlike(Exception):
    """A stretch has a character that library and pattern class differently."""


class Encoder(dict):
    """Ids of texts as little-endian unsigned 32-bit bytes, by a tokenizers file with a byte-level vocabulary.

    The library merges every new stretch; stretches are remembered in two generations. A text with a special token or a
    character that library and pattern class differently goes to the library whole, as do all texts of other vocabularies.
    Characters are looked at in new stretches alone.
    """

    def __init__(self, file: str, end: int):
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__()
        self.library, self.end = Tokenizer.from_file(file), end.to_bytes(4, "little")
        parts = self.library.pre_tokenizer
        self.parted = self.library.normalizer is None and isinstance(parts, pre_tokenizers.ByteLevel) and parts.use_regex and not parts.add_prefix_space
        self.merge, self.letters = self.library.model.tokenize, _letters()
        self.old: dict[str, bytes] = {}
        self.alike: dict[str, bool] = {}
        self.fine: set[str] = set()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]

    def __missing__(self, stretch: str) -> bytes:
        if len(self) >= KNOWN:
            self.old = dict(self)
            self.clear()
        if (x := self.old.get(stretch)) is None:
            if not self.fine.issuperset(stretch) and not all(map(self._same_class, stretch)):
                raise Unlike
            x = array("I", [t.id for t in self.merge(stretch.encode().decode("latin-1").translate(self.letters))]).tobytes()
        self[stretch] = x
        return x

    def _same_class(self, c: str) -> bool:
        """Whether the library parts letters, digits, signs and spaces from the character as the pattern does."""
        if (known := self.alike.get(c)) is None:
            tests = [x for o in ("a", "1", "!", " ") for x in (o + c, c + o)]
            parts = lambda t: [b - a for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(t)]
            known = self.alike[c] = all(parts(t) == [len(s) for s in STRETCHES.findall(t)] for t in tests)
            if known:
                self.fine.add(c)
        return known

    def ids(self, text: str) -> bytes:
        if self.parted and not any(s in text for s in self.special):
            parts = STRETCHES.findall(text)
            try:
                return b"".join(itemgetter(*parts)(self) if len(parts) > 1 else map(self.__getitem__, parts)) + self.end
            except Unlike:
                pass
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes() + self.end


def _encoder(file: str, end: int) -> Encoder:
    """The worker's encoder: what it remembers serves all tasks, until another operator needs the memory."""
    return remembered(("packing", file, end), lambda: Encoder(file, end))


def pack_documents(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END, windows: int = WINDOWS, ids: bool = False) -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens, sequence_id, offset) of each piece of a document, and its ids if asked for.

    tokenizer: a tokenizers file, which every executor can read. Each text's ids, with the end id after them, lie in
    exactly one piece each; a sequence has `capacity` ids, or a lower power of two.
    """
    kept = docs.select(key, text)
    kinds = OUT | ({"ids": pa.list_(pa.int32())} if ids else {})
    out = T.StructType([kept.schema[0], *(T.StructField(c, T.ArrayType(T.IntegerType(), False) if c == "ids" else T.LongType()) for c in kinds)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, number = _encoder(tokenizer, end), TaskContext.get().partitionId() << 40

        def made(keys: list[pa.Array], coded: list[bytes], sequences: list[list[Piece]]) -> pa.RecordBatch:
            nonlocal number
            rows = []
            for pieces in sequences:
                offset = 0
                for p in pieces:
                    part = coded[p.doc][4 * p.start : 4 * (p.start + p.length)]
                    row = (p.doc, p.start, p.length, zlib.crc32(part), len(coded[p.doc]) // 4, number, offset)
                    rows.append((*row, np.frombuffer(part, "<u4").astype(np.int32)) if ids else row)
                    offset += p.length
                number += 1
            doc, *values = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.concat_arrays(keys).take(pa.array(doc, pa.int64())), *(pa.array(v, t) for v, t in zip(values, kinds.values(), strict=True))], names=out.names)

        keys, coded, whole, rests, size = [], [], [], [], 0
        for b in batches:
            for i, t in enumerate(b.column(1).to_pylist()):
                doc, n = len(coded), len(x := encoder.ids(t or "")) // 4
                keys.append(b.column(0).slice(i, 1))
                coded.append(x)
                whole += [[Piece(doc, at, capacity)] for at in range(0, n - capacity + 1, capacity)]
                if n % capacity:
                    rests.append(Piece(doc, n - n % capacity, n % capacity))
                size += n
                if size >= windows * capacity:
                    yield made(keys, coded, whole + packed(rests, capacity))
                    keys, coded, whole, rests, size = [], [], [], [], 0
        if size:
            yield made(keys, coded, whole + packed(rests, capacity))

    return kept.mapInArrow(run, out)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(prepare(spark), sf_dir, "documents"), default_tokenizer())
