"""Removal of repeated byte strings by a hash-compared sort of suffixes.

Every string of LENGTH bytes holds an anchor that its content alone selects: the leftmost of the least hashed GRAM-byte
substrings in it. Strings are equal only if their anchors are, so suffixes are sorted and compared only at anchors, and
only at those that occur again (counted over all texts). Prefix polynomial hashes and binary search give the common
extension of two suffixes, which makes a comparison logarithmic; a mergesort with such comparisons orders the suffixes
of an anchor to the right and, read backwards, to the left. The neighbours in both orders say which strings around an
anchor repeat. Where neighbours leave a doubt, all strings around the anchor are compared.

Collisions change nothing: extensions and the order of neighbours are verified on the bytes, and where hashes misled
the sort, bytes are sorted. Anchors whose surroundings are all equal, by a keyed 128-bit digest of their bytes counted
over all texts, are settled without moving the bytes; equal surroundings within a batch are compared as bytes.

Anchors with the same surroundings are one row for each batch, and their number only is counted, so copies cost little.
Anchors with more than CROWD occurrences aren't gathered: where all their surroundings are equal, spans are known at
once; else ranges of strings around them are rows, which are counted by pre-aggregated groups and refined. Texts are cut by
joining spans to those texts alone that have any.

Defined results: null and empty texts have no bytes; texts shorter than LENGTH keep all; equal texts, repeated rows
among them, are judged alike and count as repeats of one another; an empty table gives no rows; extra columns stay,
those named like results are replaced.
"""

from __future__ import annotations

import functools
import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BitFilter, fresh, materialize, mix64, prepare, table

LENGTH, GRAM = 200, 48
BEFORE = LENGTH - GRAM  # the farthest that a string starts before its anchor
#: Occurrences of an anchor that one task may gather, anchors it resolves at once, and bytes it hashes at once.
CROWD, AT_ONCE, CHUNK = 40_000, 8_000, 1 << 17
#: Anchors that may be known to all tasks as crowded, at most; in larger inputs the crowd grows to keep to this.
CROWDED = 100_000
#: Parts into which an open range of offsets is cut, and salts over which common strings are spread.
SPLIT, SALTS = 6, 16
MARGIN = 2 * LENGTH

_r = np.random.default_rng(7)
BYTE = _r.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE modulo 2**64, and their inverses."""
    if not _powers:
        n = CHUNK + 2 * MARGIN + 1
        for b in (BASE, pow(BASE, -1, 1 << 64)):
            p = np.full(n, np.uint64(b))
            p[0] = 1
            _powers.append(np.cumprod(p, dtype=np.uint64))
    return _powers[0], _powers[1]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of all prefixes, of the last axis, that only differences at equal offsets may be compared by."""
    p, _ = powers()
    out = np.zeros((*data.shape[:-1], data.shape[-1] + 1), np.uint64)
    np.cumsum(BYTE[data] * p[: data.shape[-1]], axis=-1, dtype=np.uint64, out=out[..., 1:])
    return out


def text_key(b: bytes) -> bytes:
    return hashlib.blake2b(b, digest_size=16).digest()


def _doubled(x: np.ndarray, at: np.ndarray, w: int) -> np.ndarray:
    """Of each w consecutive values, at most 256, the place of the leftmost least one after the first."""
    h = 1

    def joined(x: np.ndarray, at: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
        right = x[step:] < x[:-step]
        return np.minimum(x[:-step], x[step:]), np.where(right, at[step:] + np.uint8(step), at[:-step])

    while 2 * h <= w:
        x, at = joined(x, at, h)
        h *= 2
    if w > h:
        x, at = joined(x, at, w - h)
    return at


def _least_in_window(x: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, place): of each w consecutive values from those at `first` up to the next ones, the leftmost least stands at `place`.

    It changes only where the one before is left behind, which is looked for again, or a lesser value comes in.
    """
    least, h = x, 1
    while 2 * h <= w:
        least = np.minimum(least[:-h], least[h:])
        h *= 2
    if w > h:
        least = np.minimum(least[: h - w], least[w - h :])
    gone = np.ones(len(least), bool)
    gone[1:] = x[: len(least) - 1] == least[:-1]
    new = gone.copy()
    new[1:] |= least[1:] < least[:-1]
    first, again = np.flatnonzero(new), np.flatnonzero(gone)
    place = first + w - 1
    windows = np.lib.stride_tricks.sliding_window_view(x, w)
    if 8 * len(again) > len(least):  # very repetitive
        found = again + _doubled(x, np.zeros(len(x), np.uint8), w)[again]
    else:
        found = again + np.concatenate([np.empty(0, np.int64), *(windows[again[i : i + 1024]].argmin(1) for i in range(0, len(again), 1024))])
    place[gone[first]] = found
    return first, place


def _chunks(texts: list[bytes], chunk: int) -> Iterator[list[tuple[int, int, int, int]]]:
    """Stretches (text, from, to, margin before) of about chunk bytes in all; long texts overlap by margins."""
    held, size = [], 0
    for i, t in enumerate(texts):
        if len(t) < LENGTH:
            continue
        for at in range(0, len(t), chunk):
            low, high = max(0, at - MARGIN), min(len(t), at + chunk + MARGIN)
            if held and size + high - low > chunk:
                yield held
                held, size = [], 0
            held.append((i, low, high, at))
            size += high - low
    if held:
        yield held


def anchors(texts: list[bytes], chunk: int = CHUNK, bits: int = 64) -> dict[str, np.ndarray]:
    """Of every anchor: its text, place, hash of its gram and of its surroundings, and the bytes around (before, after).

    bits: how many bits of the hashes are used; fewer than 64 are for tests of collisions.
    """
    mask = np.uint64((1 << bits) - 1)
    found: list[tuple[np.ndarray, ...]] = []
    _, inverse = powers()
    for part in _chunks(texts, chunk):
        data = np.frombuffer(b"".join(texts[i][low:high] for i, low, high, _ in part), np.uint8)
        starts = np.concatenate([[0], np.cumsum([high - low for _, low, high, _ in part])])
        prefix = prefix_hashes(data)
        gram = mix64((prefix[GRAM:] - prefix[:-GRAM]) * inverse[: len(data) - GRAM + 1]) & mask
        first, place = _least_in_window(gram, BEFORE + 1)
        begin, end = starts[:-1], np.minimum(np.maximum(starts[1:] - LENGTH + 1, starts[:-1]), len(gram) - BEFORE)  # strings that lie in one text
        held = np.cumsum(end - begin)
        k = np.searchsorted(begin, first, "right") - 1
        before = held[k] - np.maximum(end[k] - first, 0)  # strings of one text before the window
        x = place[np.diff(before, append=held[-1]) > 0]
        x = x[_starts(x)]
        k = np.searchsorted(starts, x, "right") - 1
        low = np.array([p[1] for p in part])[k]
        core = np.array([p[3] for p in part])[k]
        at = x - starts[k] + low
        own = (at >= core) & (at < core + chunk)
        x, k, at, low = x[own], k[own], at[own], low[own]
        before = np.minimum(BEFORE, x - starts[k])
        after = np.minimum(LENGTH, starts[k + 1] - x)
        around = mix64((prefix[x + after] - prefix[x - before]) * inverse[x - before]) & mask ^ mix64((before * 1000 + after).astype(np.uint64))
        found.append((np.array([p[0] for p in part])[k], at, gram[x], around, before, after))
    names = ("text", "x", "gram", "around", "before", "after")
    if not found:
        return {n: np.empty(0, np.uint64 if n in ("gram", "around") else np.int64) for n in names}
    return {n: np.concatenate([f[i] for f in found]) for i, n in enumerate(names)}


def whole(before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest offset before an anchor at which a string can start."""
    return np.maximum(0, LENGTH - after), before


def _distinct(texts: list[str | None]) -> tuple[list[bytes], np.ndarray]:
    """The different texts of a batch as bytes, and how often each occurs."""
    seen: dict[bytes, int] = {}
    for t in texts:
        b = t.encode("utf-8", "surrogatepass") if t else b""
        seen[b] = seen.get(b, 0) + 1
    return list(seen), np.array(list(seen.values()), np.int64)


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Whether each row of sorted columns is the first with its values."""
    return np.concatenate([[True], np.logical_or.reduce([c[1:] != c[:-1] for c in columns])])[: len(columns[0])]


def _around(texts: list[bytes], a: dict[str, np.ndarray]) -> list[bytes]:
    """The bytes around each anchor."""
    low, high = (a["x"] - a["before"]).tolist(), (a["x"] + a["after"]).tolist()
    return [texts[i][x:y] for i, x, y in zip(a["text"].tolist(), low, high, strict=True)]


def _digests(around: list[bytes], before: np.ndarray) -> np.ndarray:
    """Keyed 128-bit digests (two columns) of surroundings and of where the anchor stands in them."""
    raw = b"".join(hashlib.blake2b(s, digest_size=16, key=b"%d" % n).digest() for s, n in zip(around, before.tolist(), strict=True))
    return np.frombuffer(raw, np.int64).reshape(-1, 2)


def _count_grams(docs: DataFrame, text: str, chunk: int, bits: int) -> DataFrame:
    """(gram, n, alike): anchors that occur again, and whether all have the same surroundings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, times = _distinct(b.column(text).to_pylist())
            a = anchors(texts, chunk, bits)
            if not len(a["gram"]):
                continue
            order = np.argsort(a["gram"], kind="stable")
            a = {k: v[order] for k, v in a.items()}
            first = np.flatnonzero(_starts(a["gram"]))
            marks = _digests(_around(texts, a), a["before"])
            same = (np.minimum.reduceat(marks, first) == np.maximum.reduceat(marks, first)).all(1)
            columns = [a["gram"][first].view(np.int64), np.add.reduceat(times[a["text"]], first), marks[first, 0], marks[first, 1], same]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["gram", "n", "d", "e", "same"])

    rows = docs.select(text).mapInArrow(run, "gram long, n long, d long, e long, same boolean")
    counts = rows.groupBy("gram").agg(F.sum("n").alias("n"), (F.every("same") & (F.min("d") == F.max("d")) & (F.min("e") == F.max("e"))).alias("alike"))
    return counts.where("n > 1")


#: Anchors on their way to be resolved, with the counts of their gram in a row before them (tag 0), and spans (tag 2).
ANCHOR = "gram long, tag int, n long, alike boolean, key binary, x long, before int, bytes binary, start long, end long"
_ANCHOR = pa.schema([("gram", pa.int64()), ("tag", pa.int32()), ("n", pa.int64()), ("alike", pa.bool_()), ("key", pa.binary()), ("x", pa.int64()), ("before", pa.int32()), ("bytes", pa.binary()), ("start", pa.int64()), ("end", pa.int64())])


def _rows(count: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(count, f.type) for f in _ANCHOR], schema=_ANCHOR)


def _merged(owner: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unites overlapping or touching spans of each owner."""
    order = np.lexsort((start, owner))
    owner, start, end = owner[order], start[order], end[order]
    if not len(owner):
        return owner, start, end
    shift = owner.astype(np.int64) << 40  # ends of one owner stay below the starts of the next
    top = np.maximum.accumulate(end + shift)
    first = np.concatenate([[True], (start + shift)[1:] > top[:-1]])
    at = np.flatnonzero(first)
    return owner[at], start[at], np.maximum.reduceat(end, at)


class Crowds:
    """The crowded anchors, at most CROWDED of them, and whether each has equal surroundings everywhere."""

    def __init__(self, grams: np.ndarray, alike: np.ndarray):
        order = np.argsort(grams)
        self.grams, self.alike = grams[order], alike[order]

    @classmethod
    def of(cls, grams: DataFrame, crowd: int) -> Crowds:
        total = grams.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        got = grams.where(F.col("n") > max(crowd, total // CROWDED)).toArrow()  # at most CROWDED rows
        return cls(got.column("gram").to_numpy(), got.column("alike").to_numpy(zero_copy_only=False).astype(bool))

    def kinds(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which grams are crowded and alike, and which are crowded and not."""
        if not len(self.grams):
            return np.zeros(len(grams), bool), np.zeros(len(grams), bool)
        at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        known = self.grams[at] == grams
        return known & self.alike[at], known & ~self.alike[at]


def _grouped(texts: list[bytes], a: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray, list[bytes]]:
    """Anchors sorted into groups of equal grams and surroundings, which are compared as bytes; firsts of groups."""
    part = np.zeros(len(a["gram"]), np.int64)
    order = np.lexsort((a["around"], a["gram"]))
    a = {k: v[order] for k, v in a.items()}
    around = _around(texts, a)
    first = _starts(a["gram"], a["around"])
    lead = np.flatnonzero(first)[np.cumsum(first) - 1].tolist()
    odd: dict[tuple[int, bytes], int] = {}
    for i in np.flatnonzero(~first).tolist():
        if around[i] != around[lead[i]]:  # two strings with one hash
            part[i] = odd.setdefault((lead[i], around[i]), len(odd) + 1)
    if odd:
        order = np.lexsort((part, a["around"], a["gram"]))
        a, part, around = {k: v[order] for k, v in a.items()}, part[order], [around[i] for i in order.tolist()]
        first = _starts(a["gram"], a["around"], part)
    return a, first, around


def _repeated_anchors(docs: DataFrame, text: str, again: BitFilter, unlike: BitFilter, crowds: Crowds, chunk: int, bits: int) -> DataFrame:
    """Anchors that may occur again (tag 1), one for each batch and surroundings; crowded ones (tag 3), at places of their
    own; spans of those that repeat in the batch or are crowded and alike (tag 2)."""
    held = docs.sparkSession.sparkContext.broadcast((again, unlike, crowds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        again, unlike, crowds = held.value
        for b in batches:
            texts, times = _distinct(b.column(text).to_pylist())
            keys = np.array([text_key(t) for t in texts], dtype=object)
            a = anchors(texts, chunk, bits)
            have = again.has(a["gram"])
            if not have.any():
                continue
            a, first, around = _grouped(texts, {k: v[have] for k, v in a.items()})
            group = np.cumsum(first) - 1
            sure, crowded = crowds.kinds(a["gram"].view(np.int64))
            low, high = whole(a["before"], a["after"])
            s = np.flatnonzero(((np.bincount(group, times[a["text"]]) > 1)[group] | sure) & (low <= high))
            owner, start, end = _merged(a["text"][s], a["x"][s] - high[s], a["x"][s] - low[s] + LENGTH)
            if len(owner):
                yield _rows(len(owner), gram=mix64(owner.astype(np.uint64) + a["gram"][0]).view(np.int64), tag=np.full(len(owner), 2), key=list(keys[owner]), start=start, end=end)
            send = np.flatnonzero(first & ~sure)
            many = (unlike.has(a["gram"]) | crowded)[send]
            place = np.where(crowded[send], mix64(a["gram"][send] + send.astype(np.uint64)), a["gram"][send]).view(np.int64)
            yield _rows(len(send), gram=place, tag=np.where(crowded[send], 3, 1), key=list(keys[a["text"][send]]), x=a["x"][send], before=a["before"][send], n=a["after"][send], bytes=[around[i] if m else None for i, m in zip(send.tolist(), many.tolist(), strict=True)])

    return docs.select(text).mapInArrow(run, ANCHOR)


class Suffixes:
    """Byte strings by rows, all from the same place on, in groups that are sorted and compared within themselves."""

    def __init__(self, data: np.ndarray, length: np.ndarray, group: np.ndarray, bits: int = 64):
        self.data, self.length, self.group = data, length, group
        self.prefix = prefix_hashes(data) & np.uint64((1 << bits) - 1)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common beginning of rows a and b: binary search on prefix hashes."""
        low, high = np.zeros(len(a), np.int64), np.minimum(self.length[a], self.length[b])
        while (open_ := low < high).any():
            mid = (low + high + 1) // 2
            same = self.prefix[a, mid] == self.prefix[b, mid]
            low, high = np.where(open_ & same, mid, low), np.where(open_ & ~same, mid - 1, high)
        return low

    def verified(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """common(), checked on the bytes: where hashes collide, the bytes decide."""
        n = self.common(a, b)
        differ = (self.data[a] != self.data[b]) & (np.arange(self.data.shape[1]) < n[:, None])
        return np.where(differ.any(1), differ.argmax(1), n)

    def before(self, a: np.ndarray, b: np.ndarray, or_equal: bool, n: np.ndarray | None = None) -> np.ndarray:
        """Whether row a sorts before row b; n: their common beginning, where it is known."""
        n = self.common(a, b) if n is None else n
        top = self.data.shape[1] - 1
        x = np.where(n < self.length[a], self.data[a, np.minimum(n, top)].astype(np.int64), -1)
        y = np.where(n < self.length[b], self.data[b, np.minimum(n, top)].astype(np.int64), -1)
        return (x <= y) if or_equal else (x < y)

    def sort(self) -> np.ndarray:
        """Rows by group and suffix: a bottom-up mergesort of all groups at once; each row finds its place by bisection.

        Where hashes misled comparisons so far that two rows find one place, the bytes are sorted instead.
        """
        order = np.argsort(self.group, kind="stable")
        g = self.group[order]
        start = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        size = np.diff(np.concatenate([start, [len(g)]]))
        first, last = np.repeat(start, size), np.repeat(start + size, size)
        here = np.arange(len(g))
        width = 1
        while width < (size.max() if len(size) else 0):
            run = (here - first) // width
            left = run % 2 == 0
            mate = np.where(left, first + (run + 1) * width, first + (run - 1) * width)  # where the other run begins
            end = np.minimum(mate + width, last)
            pick = np.flatnonzero(mate < last)
            low, high, base = mate[pick], np.maximum(end[pick], mate[pick]), mate[pick]
            me, mine = order[pick], left[pick]
            while (open_ := np.flatnonzero(low < high)).size:
                mid = (low[open_] + high[open_]) // 2
                other = order[mid]
                # a row of the left run comes after smaller rows of the right one; one of the right after equal ones too
                ahead = np.where(mine[open_], self.before(other, me[open_], False), self.before(other, me[open_], True))
                low[open_] = np.where(ahead, mid + 1, low[open_])
                high[open_] = np.where(ahead, high[open_], mid)
            to = here.copy()
            begin = np.where(mine, first[pick] + run[pick] * width, base)
            own = np.where(mine, here[pick] - begin, here[pick] - (first[pick] + run[pick] * width))
            to[pick] = begin + own + (low - base)
            if np.bincount(to, minlength=len(to)).max() > 1:
                return self._sorted_bytes()
            new = np.empty_like(order)
            new[to] = order
            order = new
            width *= 2
        return order

    def _sorted_bytes(self) -> np.ndarray:
        return np.array(sorted(range(len(self.group)), key=lambda i: (self.group[i], self.data[i, : self.length[i]].tobytes())), np.int64)

    def neighbours(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows (a, b) that follow one another in the sort of a group, and their common beginnings, verified on the bytes."""
        order = self.sort()
        for _ in range(2):
            a, b = order[:-1], order[1:]
            same = self.group[a] == self.group[b]
            a, b = a[same], b[same]
            n = self.verified(a, b)
            if self.before(a, b, True, n).all():
                break
            order = self._sorted_bytes()
        return a, b, n


def repeats_around(group: np.ndarray, blocks: list[bytes], before: np.ndarray, bits: int = 64) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of anchors in groups of one gram: (anchor, least, greatest offset) at which a string repeats in the group."""
    m = len(blocks)
    after = np.array([len(b) for b in blocks]) - before
    data = np.zeros((m, BEFORE + LENGTH), np.uint8)
    flat = np.frombuffer(b"".join(blocks), np.uint8)
    sizes = before + after
    row = np.repeat(np.arange(m), sizes)
    column = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(BEFORE - before, sizes)
    data[row, column] = flat
    right = Suffixes(data[:, BEFORE:], after, group, bits)
    left = Suffixes(data[:, BEFORE - 1 :: -1] if BEFORE else data[:, :0], before, group, bits)
    low, high = whole(before, after)
    out, best_r, best_l = [], np.zeros(m, np.int64), np.zeros(m, np.int64)
    pairs = []
    for side, best in ((right, best_r), (left, best_l)):
        a, b, n = side.neighbours()
        np.maximum.at(best, a, n)
        np.maximum.at(best, b, n)
        pairs += [(a, b), (b, a)]
    a, b = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
    r, n = right.verified(a, b), left.verified(a, b)
    lo, hi = np.maximum(LENGTH - r, 0), np.minimum(n, BEFORE)
    good = lo <= hi
    out.append((a[good], lo[good], hi[good]))
    # nothing beyond the best extensions to either side can repeat; an anchor that reaches both at once is settled
    most_lo, most_hi = np.maximum(LENGTH - best_r, 0), np.minimum(best_l, BEFORE)
    settled = most_lo > most_hi
    settled[a[good & (lo == most_lo[a]) & (hi == most_hi[a])]] = True
    doubt = np.unique(group[~settled])
    if len(doubt):
        at = np.flatnonzero(np.isin(group, doubt))
        prefix = prefix_hashes(data[at]) & np.uint64((1 << bits) - 1)
        for o in range(BEFORE + 1):
            fits = np.flatnonzero((low[at] <= o) & (o <= high[at]))
            c = BEFORE - o
            h = prefix[fits, c + LENGTH] - prefix[fits, c]
            order = np.lexsort((h, group[at[fits]]))
            x, y = at[fits[order[:-1]]], at[fits[order[1:]]]
            same = (h[order[1:]] == h[order[:-1]]) & (group[x] == group[y])
            agree = (data[x[same], c : c + LENGTH] == data[y[same], c : c + LENGTH]).all(1)
            if agree.all():
                hit = np.unique(np.concatenate([x[same], y[same]]))
            else:  # unequal strings with one hash: the bytes decide
                strings = [(group[i], data[i, c : c + LENGTH].tobytes()) for i in at[fits].tolist()]
                times = Counter(strings)
                hit = np.array([i for i, t in zip(at[fits].tolist(), strings, strict=True) if times[t] > 1], np.int64)
            out.append((hit, np.full(len(hit), o), np.full(len(hit), o)))
    return out


def _resolve(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (gram, tag): spans (tag 2), and anchors in crowds as they are (tag 3)."""
    info: tuple[int, bool] | None = None
    groups: list[list[tuple]] = []
    waiting = 0

    def settle() -> Iterator[pa.RecordBatch]:
        nonlocal groups, waiting
        rows = [r for g in groups if len(g) > 1 for r in g]
        number = np.repeat(np.arange(len(groups)), [len(g) if len(g) > 1 else 0 for g in groups])
        groups, waiting = [], 0
        if rows:
            x, before = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
            found = repeats_around(number, [r[3] for r in rows], before, bits)
            i, lo, hi = (np.concatenate([f[k] for f in found]) for k in range(3))
            owner, start, end = _merged(i, x[i] - hi, x[i] - lo + LENGTH)
            yield _rows(len(owner), tag=np.full(len(owner), 2), key=[rows[k][0] for k in owner.tolist()], start=start, end=end)

    for b in batches:
        c = {n: b.column(n).to_pylist() for n in ("gram", "tag", "n", "alike", "key", "x", "before", "bytes", "start", "end")}
        spans, crowded = [], []
        for i in range(b.num_rows):
            tag, gram = c["tag"][i], c["gram"][i]
            if tag == 0:
                info = (gram, c["alike"][i])
                if waiting >= AT_ONCE:
                    yield from settle()
                groups.append([])
            elif tag == 2:
                spans.append((c["key"][i], c["start"][i], c["end"][i]))
            elif tag == 3:
                crowded.append((gram, c["key"][i], c["x"][i], c["before"][i], c["bytes"][i]))
            elif info is None or info[0] != gram:
                continue  # let through by the filter alone
            elif info[1]:
                x, before, after = c["x"][i], c["before"][i], c["n"][i]
                if max(0, LENGTH - after) <= before:
                    spans.append((c["key"][i], x - before, x - max(0, LENGTH - after) + LENGTH))
            else:
                groups[-1].append((c["key"][i], c["x"][i], c["before"][i], c["bytes"][i]))
                waiting += 1
        if spans:
            yield _rows(len(spans), tag=[2] * len(spans), key=[s[0] for s in spans], start=[s[1] for s in spans], end=[s[2] for s in spans])
        if crowded:
            yield _rows(len(crowded), tag=[3] * len(crowded), **{c: [r[k] for r in crowded] for k, c in enumerate(("gram", "key", "x", "before", "bytes"))})
    yield from settle()


def _crowd_spans(crowd: DataFrame) -> DataFrame:
    """Spans of strings around crowded anchors, by refinement of ranges of offsets.

    Ranges are the same for all occurrences. The strings of a range share a core around the anchor, and lie in a hull. Where another occurrence has the same hull,
    the whole range repeats, and one of them goes on for others to meet; where none has the same core, nothing repeats; else
    the range is cut in SPLIT parts, down to single offsets, whose core and hull are the string. Cores and hulls are told by 128 bits of their bytes' digest and
    counted by pre-aggregated groups; an occurrence has few open ranges, so rows are in proportion to occurrences. Hulls
    go to salted copies, as very many occurrences may have one.
    """
    spark, spans, width = crowd.sparkSession, [], BEFORE + 1
    after = F.length("bytes") - F.col("before")
    able = (F.col("a") <= F.col("before")) & (F.col("b") >= F.lit(LENGTH) - after)  # the text has some string of the range
    full = (F.col("b") <= F.col("before")) & (F.col("a") >= F.lit(LENGTH) - after)  # it has the whole hull
    rows = crowd.where(F.length("bytes") >= LENGTH).select("key", "x", "before", "bytes", F.lit(0).alias("a"), F.lit(BEFORE).alias("b"))
    digest = lambda low, size: F.unhex(F.substring(F.sha2(F.substring("bytes", F.col("before") - low + 1, size), 256), 1, 32))
    while True:
        cuts = {"core": digest(F.col("a"), F.lit(LENGTH) - F.col("b") + F.col("a")), "hull": F.when(full, digest(F.col("b"), F.lit(LENGTH) + F.col("b") - F.col("a")))}
        rows = materialize(rows.withColumns(cuts), "crowd-ranges")
        both = functools.reduce(DataFrame.unionByName, [rows.select(F.lit(k).alias("kind"), "a", "b", F.col(k).alias("digest"), F.struct("key", "x").alias("place")) for k in cuts])
        again = materialize(both.where("digest IS NOT NULL").groupBy("kind", "a", "b", "digest").agg(F.count("*").alias("n"), F.min("place").alias("first")).where("n > 1"), "crowd-counts")
        hulls = again.where("kind = 'hull'").select(F.col("a").alias("a2"), F.col("b").alias("b2"), "digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt2"))
        salted = rows.withColumn("salt", F.pmod(F.xxhash64("key", "x"), F.lit(SALTS)).cast("int"))
        same = (F.col("hull") == F.col("digest")) & (F.col("a") == F.col("a2")) & (F.col("b") == F.col("b2")) & (F.col("salt") == F.col("salt2"))
        judged = materialize(salted.join(hulls, same, "left").select(*rows.columns, F.col("digest").isNotNull().alias("whole"), F.coalesce(F.col("first") == F.struct("key", "x"), F.lit(False)).alias("lead")), "crowd-judged")
        spans.append(judged.where("whole").select("key", (F.col("x") - F.col("b")).alias("start"), (F.col("x") - F.col("a") + LENGTH).alias("end")))
        if width == 1:
            break
        width = -(-width // SPLIT)
        cores = again.where("kind = 'core'").select(F.xxhash64("a", "b", "digest").alias("h"))
        some = BitFilter.build(cores, cores.count())
        left = judged.where("(lead OR NOT whole) AND a < b").where(some.column(spark, F.xxhash64("a", "b", "core")))
        starts = F.explode(F.sequence(F.col("a"), F.col("b"), F.lit(width)))
        rows = left.withColumn("at", starts).select("key", "x", "before", "bytes", F.col("at").alias("a"), F.least(F.col("b"), F.col("at") + width - 1).alias("b")).where(able)
    return functools.reduce(DataFrame.unionByName, spans)


def repeated_spans(docs: DataFrame, text: str = "text", crowd: int = CROWD, chunk: int = CHUNK, bits: int = 64) -> DataFrame:
    """(key, spans): by key of a text (text_key of its bytes), the spans that repeat elsewhere, not yet united."""
    grams = materialize(_count_grams(docs, text, chunk, bits), "grams")
    n = grams.count()
    again = BitFilter.build(grams.select("gram"), n)
    unlike = BitFilter.build(grams.where("NOT alike").select("gram"), n)
    blank = {f.name: F.lit(None).cast(f.dataType) for f in T.StructType.fromDDL(ANCHOR).fields}
    heads = grams.select(*[(F.col(c) if c in grams.columns else F.lit(0) if c == "tag" else blank[c]).alias(c) for c in blank])
    rows = heads.unionByName(_repeated_anchors(docs, text, again, unlike, Crowds.of(grams, crowd), chunk, bits))
    found = materialize(rows.repartition("gram").sortWithinPartitions("gram", "tag").mapInArrow(lambda batches: _resolve(batches, bits), ANCHOR).select("tag", "key", "x", "before", "bytes", "start", "end"), "repeats")
    spans = found.where("tag = 2").select("key", "start", "end")
    crowded = found.where("tag = 3")
    if not crowded.isEmpty():
        spans = spans.unionByName(_crowd_spans(crowded))
    return spans.groupBy("key").agg(F.collect_set(F.struct("start", "end")).alias("spans"))


def _number(key: bytes) -> int:
    return int.from_bytes(key[:7], "big")


_KINDS = {"n_bytes": T.LongType(), "n_removed": T.LongType(), "n_spans": T.LongType(), "kept_sha256": T.StringType(), "kept": T.BinaryType()}
ADDED = T.StructType([T.StructField(n, k) for n, k in _KINDS.items()])


def remove_repeats(docs: DataFrame, text: str = "text", kept: bool = True, crowd: int = CROWD, chunk: int = CHUNK, bits: int = 64) -> DataFrame:
    """Adds n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes); columns of these names are replaced.

    Without kept, the text and its remaining bytes are left out, and only texts with repeats are moved at all.
    """
    spans = materialize(repeated_spans(docs, text, crowd, chunk, bits), "spans")
    number = spans.select(F.conv(F.hex(F.substring("key", 1, 7)), 16, 10).cast("long").alias("k"))
    some = docs.sparkSession.sparkContext.broadcast(BitFilter.build(number, spans.count()))
    added = [f for f in ADDED.fields if kept or f.name != "kept"]
    old = [f for f in docs.schema.fields if f.name not in {x.name for x in added} and (kept or f.name != text)]
    nothing = hashlib.sha256(b"").hexdigest()
    own = fresh(docs.columns, "key", "body", "n", "sha", "k", "spans")
    k_key, k_body, k_n, k_sha, k_other, k_spans = own

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in b.column(text).to_pylist()]
            keys = [text_key(t) for t in raw]
            hit = some.value.has(np.array([_number(k) for k in keys], np.int64))
            digest = [None if h else hashlib.sha256(t).hexdigest() if t else nothing for t, h in zip(raw, hit, strict=True)]
            body = [t if h or kept else None for t, h in zip(raw, hit, strict=True)]
            columns = [b.column(f.name) for f in old] + [pa.array(keys, pa.binary()), pa.array(body, pa.binary()), pa.array([len(t) for t in raw], pa.int64()), pa.array(digest, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*(f.name for f in old), *own[:4]])

    keyed = docs.mapInArrow(key, T.StructType([*old, *T.StructType.fromDDL(f"{k_key} binary, {k_body} binary, {k_n} long, {k_sha} string").fields]))
    joined = keyed.join(spans.select(F.col("key").alias(k_other), F.col("spans").alias(k_spans)), F.col(k_key) == F.col(k_other), "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {f.name: [] for f in ADDED.fields}
            for raw, n, sha, found in zip(*(b.column(c).to_pylist() for c in (k_body, k_n, k_sha, k_spans)), strict=True):
                removed, runs, rest = 0, 0, raw
                if found:
                    pieces, at = [], 0
                    for start, end in sorted((s["start"], s["end"]) for s in found):
                        if start > at or not runs:
                            pieces.append(raw[at:start])
                            runs += 1
                        at = max(at, end)
                    rest = b"".join([*pieces, raw[at:]])
                    removed = n - len(rest)
                for c, v in zip(out, (n, removed, runs, sha or hashlib.sha256(rest).hexdigest(), rest), strict=True):
                    out[c].append(v)
            kinds = {"kept_sha256": pa.string(), "kept": pa.binary()}
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in old), *(pa.array(out[f.name], kinds.get(f.name, pa.int64())) for f in added)], names=[f.name for f in [*old, *added]])

    return joined.mapInArrow(cut, T.StructType([*old, *added]))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs, kept=False)
