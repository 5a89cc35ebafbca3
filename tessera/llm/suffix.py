"""Removal of repeated byte strings by a hash-compared suffix sort.

Every string of K bytes has a smallest anchor (the 8-gram with the least hash in it), the same wherever the string
stands. Strings with one anchor position form a segment; segments travel to a bucket by their anchor, so equal strings
meet there. Within a bucket, suffixes are grouped by their anchor, its place in them and the bytes on one side of it, and
each group is sorted by mergesort: prefix polynomial hashes and a binary search find the common extension of two
suffixes, the byte behind it their order. Neighbours in that order whose common extension is K bytes are compared byte by
byte; equal ones are a class, and the smallest doc_id of a class keeps the string.

Before anything is sent, each block of documents does the same within itself and sends only one document's copy of each
string. Anchors that a bounded sample shows to be frequent meet in two steps: first those of FAN blocks each, and of every
string only the copy that is left travels on. So no group grows with the number of blocks.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import short_batches

#: Bytes of a string that counts, and of an anchor.
K, ANCHOR = 50, 8
_STARTS = K - ANCHOR + 1
#: A string has so many bytes besides its anchor on one side of it at least.
_ARM = (K - ANCHOR + 1) // 2
_GRAM = ANCHOR + _ARM
#: Bytes of documents that are worked on at once, of segments in a bucket's share, and of documents for each bucket.
BLOCK, SHARE, BUCKET = 4 << 20, 2 << 20, 16 << 20
#: Blocks whose segments of a frequent anchor meet first; bytes of documents that show, by a hash of their ids, which
#: anchors are frequent, and in how many of these documents such an anchor stands. With fewer blocks none is.
FAN, SAMPLE, FREQUENT = 1024, 128 << 20, 3
_POSITION = np.uint64((1 << 24) - 1)
_BASE = 0x9E3779B97F4A7C15
_LEVEL = 3


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return np.random.default_rng(50).integers(1, 1 << 63, 256, dtype=np.uint64)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def up(base: int) -> np.ndarray:
        return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]))

    return up(_BASE), up(pow(_BASE, -1, 1 << 64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, (n - 1).bit_length())
    return _powers(size)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Prefixes:
    """Polynomial hashes of all prefixes of data, modulo 2**64: the hash of any stretch is one subtraction and product."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.data, (self.up, down) = data, powers(max(1, n))
        self.sums = np.empty(n + 1, np.uint64)
        self.sums[0] = 0
        np.cumsum(_byte_values()[data] * down[:n], out=self.sums[1:])

    def of(self, at: np.ndarray, length) -> np.ndarray:
        return (self.sums[at + length] - self.sums[at]) * self.up[at]

    def common(self, x: np.ndarray, y: np.ndarray, most: int = K) -> np.ndarray:
        """Lengths, up to most, of the common extensions of the suffixes at x and y: binary search on equal hashes."""
        low, high = np.zeros(len(x), np.int64), np.full(len(x), most, np.int64)
        for _ in range(most.bit_length()):
            middle = (low + high + 1) >> 1
            same = self.of(x, middle) == self.of(y, middle)
            low, high = np.where(same, middle, low), np.where(same, high, np.maximum(middle - 1, low))
        return low

    def compare(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """-1 or 1: the order of the K bytes at x and at y, which differ."""
        at = np.minimum(self.common(x, y), K - 1)
        return np.sign(self.data[x + at].astype(np.int16) - self.data[y + at].astype(np.int16))


def suffix_sort(prefixes: Prefixes, at: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the suffixes `at` by group and then by their first K bytes, and which of them have the K bytes of the
    one before.

    Mergesort of all groups at once: in each round every suffix finds its place in the sorted neighbour block of its
    group by binary search. A comparison first looks at the hashes of all K bytes; where those differ, the common
    extension tells which byte decides.
    """
    order = np.argsort(group, kind="stable")
    n = len(order)
    if not n:
        return order, np.zeros(0, bool)
    whole = prefixes.of(at, K)
    g = group[order]
    first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    size = np.diff(np.append(first, n))
    start = np.repeat(first, size)
    end = start + np.repeat(size, size)
    width, slots = 1, np.arange(n)
    while len(slots := slots[(end - start)[slots] > width]):
        rank = slots - start[slots]
        block = rank // width
        right = np.flatnonzero(block % 2)
        # Of two neighbour blocks the right one's suffixes look for their places; the left one's fill the others in order.
        mine = order[slots[right]]
        base = start[slots[right]] + (block[right] - 1) * width
        low, high = base.copy(), base + width
        open_ = np.arange(len(right))
        while len(open_):
            middle = (low[open_] + high[open_]) >> 1
            x, y = order[middle], mine[open_]
            before = np.ones(len(open_), bool)
            differ = np.flatnonzero(whole[x] != whole[y])
            before[differ] = prefixes.compare(at[x[differ]], at[y[differ]]) < 0
            low[open_] = np.where(before, middle + 1, low[open_])
            high[open_] = np.where(before, high[open_], middle)
            open_ = open_[low[open_] < high[open_]]
        place = low + rank[right] - block[right] * width
        others = np.ones(n, bool)
        others[slots[right]] = False
        free = np.ones(n, bool)
        free[place] = False
        moved = np.empty_like(order)
        moved[place], moved[free] = mine, order[others]
        order, width = moved, width * 2
    same = np.zeros(n, bool)
    x, y = at[order[1:]], at[order[:-1]]
    equal = np.flatnonzero((g[1:] == g[:-1]) & (whole[order[1:]] == whole[order[:-1]]))
    same[1 + equal] = alike(prefixes.data, x[equal], y[equal], np.full(len(equal), K))
    return order, same


def alike(data: np.ndarray, x: np.ndarray, y: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Which stretches of some lengths, of 8 bytes at least, at x and y have the same bytes: collisions of hashes end
    here."""
    out = np.ones(len(x), bool)
    if len(x):
        words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
        for j in range(0, int(length.max()), 8):
            step = np.minimum(j, length - 8)
            out &= words[x + step] == words[y + step]
    return out


@dataclass
class Segments:
    """Stretches of documents: bytes one after the other, lengths, the anchor's place in each, the document's row in
    `docs` and the place of the stretch in it. docs: ids, digests of texts."""

    data: np.ndarray
    length: np.ndarray
    anchor: np.ndarray
    doc: np.ndarray
    place: np.ndarray
    ids: np.ndarray
    sums: np.ndarray


def _repeated(values: np.ndarray, real: np.ndarray) -> np.ndarray:
    """Which of the values marked real occur twice among them."""
    at = np.flatnonzero(real)
    order = at[np.argsort(values[at])]
    v = values[order]
    twin = np.zeros(len(v), bool)
    twin[1:] = v[1:] == v[:-1]
    twin[:-1] |= twin[1:]
    out = np.zeros(len(values), bool)
    out[order[twin]] = True
    return out


def later_segments(prefixes: Prefixes, start: np.ndarray, length: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which segments as a whole also stand in a document with a smaller id."""
    whole = mix(prefixes.of(start, length) + length.astype(np.uint64) * np.uint64(_BASE))
    order = np.lexsort((ids, whole))
    h = whole[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    head = np.repeat(order[first], np.diff(np.append(first, len(h))))
    later = np.flatnonzero(ids[order] > ids[head])
    x, y = order[later], head[later]
    out = np.zeros(len(start), bool)
    out[x] = (length[x] == length[y]) & alike(prefixes.data, start[x], start[y], np.minimum(length[x], length[y]))
    return out


def later_strings(prefixes: Prefixes, start: np.ndarray, s_length: np.ndarray, anchor: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Segment and offset of every string that also stands in a document with a smaller id, for segments at start in
    prefixes.data, of documents `ids`.

    Segments that a smaller document has as a whole are late as a whole, and left out then. Equal strings have the anchor
    at one place, and with it the same _ARM bytes on one side of it: that is their group, whose suffixes are sorted.
    """
    gone = later_segments(prefixes, start, s_length, ids)
    a = start + anchor
    has_left, has_right = ~gone & (anchor >= _ARM), ~gone & (anchor + _GRAM <= s_length)
    left = prefixes.of(np.where(has_left, a - _ARM, 0), np.where(has_left, _GRAM, 0))
    right = prefixes.of(np.where(has_right, a, 0), np.where(has_right, _GRAM, 0))
    seg, offset = strings_of(np.flatnonzero(_repeated(left, has_left) | _repeated(right, has_right)), s_length)
    place = anchor[seg] - offset
    group = mix(np.where(place >= _ARM, left[seg], right[seg]) + place.astype(np.uint64) * np.uint64(_BASE))
    some = np.flatnonzero(_repeated(group, np.ones(len(group), bool)))
    seg, offset, group = seg[some], offset[some], group[some]
    order, same = suffix_sort(prefixes, start[seg] + offset, group)
    late = np.zeros(len(order), bool)
    if len(order):
        owner, first = ids[seg[order]], np.flatnonzero(~same)
        least = np.repeat(np.minimum.reduceat(owner, first), np.diff(np.append(first, len(order))))
        late[order] = owner > least
    all_seg, all_offset = strings_of(np.flatnonzero(gone), s_length)
    return np.concatenate([all_seg, seg[late]]), np.concatenate([all_offset, offset[late]])


def strings_of(segments: np.ndarray, s_length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Segment and offset of every string in some segments."""
    n = s_length[segments] - (K - 1)
    return np.repeat(segments, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def cut(data: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and anchor of the segments of data; doc: the document of each byte, none is crossed."""
    n = len(data)
    if n < K:
        return (np.zeros(0, np.int64),) * 3
    key = np.ndarray((n - ANCHOR + 1,), "<u8", data, strides=(1,))
    least = (mix(key * np.uint64(_BASE)) & ~_POSITION) | np.arange(len(key), dtype=np.uint64)
    span = 1
    while span * 2 <= _STARTS:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < _STARTS:
        least = np.minimum(least[: len(least) - (_STARTS - span)], least[_STARTS - span :])
    at = (least & _POSITION).astype(np.int64)
    inside = doc[: n - K + 1] == doc[K - 1 :]
    first = np.flatnonzero(inside & np.concatenate([[True], (at[1:] != at[:-1]) | ~inside[:-1]]))
    ends = np.flatnonzero(inside & np.concatenate([(at[1:] != at[:-1]) | ~inside[1:], [True]]))
    return first, ends - first + K, at[first] - first


def anchors(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    key = np.zeros(len(at), np.uint64)
    for j in range(ANCHOR):
        key |= data[at + j].astype(np.uint64) << np.uint64(8 * j)
    return mix(mix(key * np.uint64(_BASE)))


def gather(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    ends = np.cumsum(length)
    return data[np.repeat(start - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)]


def runs(seg: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Consecutive offsets of a segment, in order: segment, first offset, number."""
    if not len(seg):
        return (np.zeros(0, np.int64),) * 3
    order = np.lexsort((offset, seg))
    s, o = seg[order], offset[order]
    first = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) | (o[1:] != o[:-1] + 1)]))
    return s[first], o[first], np.diff(np.append(first, len(s)))


def _pack(*arrays: np.ndarray) -> bytes:
    parts = [a.tobytes() for a in arrays]
    head = np.array([len(p) for p in parts], "<u4").tobytes()
    return zstandard.compress(head + b"".join(parts), _LEVEL)


def _unpack(blob: bytes, types: tuple) -> list[np.ndarray]:
    raw = zstandard.decompress(blob)
    sizes = np.frombuffer(raw[: 4 * len(types)], "<u4")
    out, at = [], 4 * len(types)
    for size, kind in zip(sizes.tolist(), types):
        out.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


_SEGMENT = ("u1", "u1", "u1", "<u4", "<u4", "<i8", "<u4", "<u2")
_REMOVAL = ("<i8", "<u8", "<u4", "<u2")
_SENT = "part int, kind int, blob binary"


def _pack_segments(s: Segments) -> bytes:
    used, doc = np.unique(s.doc, return_inverse=True)
    step = np.diff(doc, prepend=0)
    return _pack(s.data, s.length.astype("u1"), s.anchor.astype("u1"), step.astype("<i4").view("<u4"), s.place.astype("<u4"), np.diff(s.ids[used], prepend=0), s.sums[used].astype("<u4"), (s.sums[used] >> np.uint64(32)).astype("<u2"))


def _unpack_segments(blob: bytes) -> Segments:
    data, length, anchor, step, place, ids, low, high = _unpack(blob, _SEGMENT)
    return Segments(data, length.astype(np.int64), anchor.astype(np.int64), np.cumsum(step.view("<i4").astype(np.int64)), place.astype(np.int64), np.cumsum(ids), low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32))


def digest(raw: bytes) -> int:
    """48 bits of a text's XXH64: what tells rows of one doc_id apart."""
    return xxhash.xxh64_intdigest(raw) & ((1 << 48) - 1)


def dest_of(ids: np.ndarray, sums: np.ndarray, parts: int) -> np.ndarray:
    """The part of each row, by its id and text: rows of one id, or without one, don't gather in a part."""
    return (mix(ids.astype(np.int64).view(np.uint64) * np.uint64(_BASE) + mix(sums.astype(np.uint64))) % np.uint64(parts)).astype(np.int64)


def _removals(ids, sums, place, n, parts: int):
    """(part, blob) of removed stretches: n strings from place on, by the part of their document."""
    to = dest_of(ids, sums, parts)
    order = np.lexsort((place, sums, ids, to))
    to, ids, sums, place, n = to[order], ids[order], sums[order], place[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])) if len(to) else []
    for a, b in zip(first, [*first[1:], len(to)]):
        yield int(to[a]), _pack(ids[a:b], sums[a:b], place[a:b].astype("<u4"), (n[a:b] + K - 1).astype("<u2"))


def _blocks(batches):
    """Documents by blocks: id, digest and place in the text of each piece, and its bytes. A text longer than a block is
    cut into pieces that overlap by K - 1 bytes."""
    held, size = [], 0
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            raw = (t or "").encode("utf-8", "surrogatepass")
            if i is None or len(raw) < K:
                continue
            own = digest(raw)
            for a in range(0, max(1, len(raw) - K + 1), BLOCK - K):
                piece = raw[a : a + BLOCK]
                if held and size + len(piece) > BLOCK:
                    yield held
                    held, size = [], 0
                held.append((i, own, a, piece))
                size += len(piece)
    if held:
        yield held


def _left_over(start, length, anchor, seg, offset):
    """Start, length and anchor of what is left of the segments without the strings (seg, offset): segments without such
    strings as a whole, the others in the stretches between those; in order."""
    touched = np.zeros(len(start), bool)
    touched[seg] = True
    some = np.flatnonzero(touched)
    each, off = strings_of(some, length)
    base = np.zeros(len(start), np.int64)
    base[some] = np.cumsum(length[some] - (K - 1)) - (length[some] - (K - 1))
    gone = np.zeros(len(each), bool)
    gone[base[seg] + offset] = True
    s, o, n = runs(each[~gone], off[~gone])
    whole = np.flatnonzero(~touched)
    a_start, a_length, a_anchor, of = np.concatenate([start[whole], start[s] + o]), np.concatenate([length[whole], n + K - 1]), np.concatenate([anchor[whole], anchor[s] - o]), np.concatenate([whole, s])
    order = np.argsort(a_start, kind="stable")
    return a_start[order], a_length[order], a_anchor[order], of[order]


def _by_part(to: np.ndarray, first: int = 0):
    """(part, rows) of each part that has some."""
    order = np.argsort(to, kind="stable")
    used = np.unique(to)
    edges = np.searchsorted(to[order], np.append(used, np.iinfo(np.int64).max))
    for part, a, b in zip(used.tolist(), edges[:-1], edges[1:]):
        yield first + part, order[a:b]


def _sent(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["part", "kind", "blob"])


def _anchors_of(batches):
    """Anchors, and in how many documents of a block each stands."""
    for held in _blocks(batches):
        data = np.frombuffer(b"".join(x[3] for x in held), np.uint8)
        doc = np.repeat(np.arange(len(held)), [len(x[3]) for x in held])
        start, _, anchor = cut(data, doc)
        key, own = anchors(data, start + anchor), doc[start]
        order = np.lexsort((own, key))
        key, own = key[order], own[order]
        once = np.concatenate([[True], (key[1:] != key[:-1]) | (own[1:] != own[:-1])]) if len(key) else np.zeros(0, bool)
        got, n = np.unique(key[once], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(got.view(np.int64)), pa.array(n)], ["anchor", "n"])


def frequent_anchors(rows: DataFrame, size: int) -> np.ndarray:
    """Sorted anchors that stand in FREQUENT of the sampled documents at least: SAMPLE / FREQUENT at most, whatever size
    the table has."""
    if size <= FAN * BLOCK:
        return np.zeros(0, np.uint64)
    share = int(min(1.0, SAMPLE / size) * (1 << 30))
    drawn = rows.where(F.pmod(F.xxhash64(F.lit("anchors"), "doc_id"), F.lit(1 << 30)) < share)
    found = drawn.mapInArrow(_anchors_of, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT).select("anchor")
    return np.sort(found.toArrow()["anchor"].to_numpy().view(np.uint64))


def _send(parts: int, hot: np.ndarray, salts: int):
    """Segments to the bucket of their anchor, removals to the part of their document. Segments of frequent anchors go
    to buckets of their own, from `parts` on, by anchor and salt; a block has one salt."""

    def run(batches):
        for held in _blocks(batches):
            data = np.frombuffer(b"".join(x[3] for x in held), np.uint8)
            sizes = np.array([len(x[3]) for x in held])
            offsets = np.cumsum(sizes) - sizes
            ids, sums = np.array([x[0] for x in held], np.int64), np.array([x[1] for x in held], np.uint64)
            shift = np.array([x[2] for x in held], np.int64) - offsets
            doc = np.repeat(np.arange(len(held), dtype=np.int32), sizes)
            start, length, anchor = cut(data, doc)
            mine = doc[start]
            prefixes = Prefixes(data)
            seg, offset = later_strings(prefixes, start, length, anchor, ids[mine])
            del prefixes
            s, o, n = runs(seg, offset)
            out = [(part, 1, blob) for part, blob in _removals(ids[mine[s]], sums[mine[s]], shift[mine[s]] + start[s] + o, n, parts)]
            start, length, anchor, _ = _left_over(start, length, anchor, seg, offset)
            key = anchors(data, start + anchor)
            to = (key % np.uint64(parts)).astype(np.int64)
            if len(hot):
                salt = sums[0] % np.uint64(salts)
                often = hot[np.minimum(np.searchsorted(hot, key), len(hot) - 1)] == key
                to[often] = parts + (mix(key[often] + salt * np.uint64(_BASE)) % np.uint64(parts)).astype(np.int64)
            for part, i in _by_part(to):
                d = doc[start[i]]
                out.append((part, 0, _pack_segments(Segments(gather(data, start[i], length[i]), length[i], anchor[i], d, start[i] + shift[d], ids, sums))))
            yield _sent(out)

    return run


def _meet(parts: int):
    """What meets in a bucket: removals; from a bucket of frequent anchors also what is left of its segments, to the
    bucket where all salts of the anchor meet, from 2 * parts on."""

    def run(table: pa.Table) -> pa.Table:
        out = [(p.as_py(), 1, b.as_py()) for p, k, b in zip(table["part"], table["kind"], table["blob"]) if k.as_py() == 1]
        own = next((p.as_py() for p, k in zip(table["part"], table["kind"]) if k.as_py() == 0), 0)
        got = [_unpack_segments(b.as_py()) for k, b in zip(table["kind"], table["blob"]) if k.as_py() == 0]
        if got:
            data = np.concatenate([s.data for s in got])
            length, anchor, place = (np.concatenate([getattr(s, c) for s in got]) for c in ("length", "anchor", "place"))
            ids = np.concatenate([s.ids[s.doc] for s in got])
            sums = np.concatenate([s.sums[s.doc] for s in got])
            del got
            start = np.cumsum(length) - length
            share = max(1, -(-len(data) // SHARE))
            key = anchors(data, start + anchor)
            found, again = [], []
            for _, i in _by_part(((key >> np.uint64(32)) % np.uint64(share)).astype(np.int64)):
                near = Prefixes(gather(data, start[i], length[i]))
                first = np.cumsum(length[i]) - length[i]
                seg, offset = later_strings(near, first, length[i], anchor[i], ids[i])
                s, o, n = runs(seg, offset)
                found.append((ids[i[s]], sums[i[s]], place[i[s]] + o, n))
                if parts <= own < 2 * parts:
                    a_start, a_length, a_anchor, of = _left_over(first, length[i], anchor[i], seg, offset)
                    to = (key[i[of]] % np.uint64(parts)).astype(np.int64)
                    for part, j in _by_part(to, 2 * parts):
                        k = i[of[j]]
                        left = Segments(gather(near.data, a_start[j], a_length[j]), a_length[j], a_anchor[j], np.arange(len(j)), place[k] + a_start[j] - first[of[j]], ids[k], sums[k])
                        again.append((part, 0, _pack_segments(left)))
            out += [(part, 1, blob) for part, blob in _removals(*(np.concatenate(c) for c in zip(*found)), parts)] + again
        return pa.Table.from_batches([_sent(out)])

    return run


def _texts(parts: int):
    """Documents by part, compressed: the texts cross the network once. Rows without an id go anywhere."""

    def run(batches):
        dealt = 0
        for b in batches:
            ids = b.column(0).to_pylist()
            raws = [(t or "").encode("utf-8", "surrogatepass") for t in b.column(1).to_pylist()]
            a = 0
            while a < len(raws):
                e, size = a, 0
                while e < len(raws) and (e == a or size + len(raws[e]) <= BLOCK):
                    size += len(raws[e])
                    e += 1
                null = np.array([i is None for i in ids[a:e]], "u1")
                some = np.array([0 if i is None else i for i in ids[a:e]], np.int64)
                sums = np.array([digest(r) for r in raws[a:e]], np.uint64)
                to = dest_of(some, sums + null * (np.arange(e - a, dtype=np.uint64) + np.uint64(dealt)), parts)
                dealt += e - a
                rows = []
                for part, i in _by_part(to):
                    text = np.frombuffer(b"".join(raws[a + j] for j in i), np.uint8)
                    rows.append((part, 0, _pack(text, np.array([len(raws[a + j]) for j in i], "<u8"), some[i], sums[i], null[i])))
                yield _sent(rows)
                a = e

    return run


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])


def _finish(left: pa.Table, right: pa.Table) -> pa.Table:
    out = []
    removed = [_unpack(b.as_py(), _REMOVAL) for b in right["blob"]]
    ids, sums, place, size = (np.concatenate(c) if removed else np.zeros(0, np.int64) for c in (zip(*removed) if removed else [()] * 4))
    order = np.argsort(ids, kind="stable")
    ids, sums, place, size = ids[order], sums[order], place[order].astype(np.int64), size[order].astype(np.int64)
    for blob in left["blob"]:
        text, n, doc, own_sum, null = _unpack(blob.as_py(), ("u1", "<u8", "<i8", "<u8", "u1"))
        ends = np.cumsum(n.astype(np.int64))
        for i in range(len(n)):
            b, e = int(ends[i] - n[i].astype(np.int64)), int(ends[i])
            own = text[b:e]
            x, y = np.searchsorted(ids, doc[i], "left"), np.searchsorted(ids, doc[i], "right")
            if null[i] or x == y:
                out.append((None if null[i] else int(doc[i]), e - b, 0, 0, own.tobytes()))
                continue
            mine = np.flatnonzero(sums[x:y] == own_sum[i]) + x
            change = np.bincount(place[mine], minlength=e - b + 1)[: e - b + 1].astype(np.int64) - np.bincount(place[mine] + size[mine], minlength=e - b + 1)[: e - b + 1]
            gone = np.cumsum(change)[: e - b] > 0
            n_spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
            out.append((int(doc[i]), e - b, int(gone.sum()), n_spans, own[~gone].tobytes()))
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, _RESULT.types)], schema=_RESULT)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary) for every row of docs: without each byte covered by a string of
    K bytes that also starts in a document with a smaller doc_id; judged on the input.

    A null text is empty; texts shorter than K bytes lose nothing. A row with a null doc_id loses nothing and takes
    nothing from others. Rows that repeat a doc_id are one document as to order, and each loses its own bytes. An empty
    table gives an empty one; columns besides doc_id and text are ignored.
    """
    rows = short_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(12, -(-size // BUCKET))
    hot = frequent_anchors(rows, size)
    # Buckets are partitions by their number: dealt by a hash, some tasks would get several.
    met = rows.mapInArrow(_send(parts, hot, max(1, -(-size // (FAN * BLOCK)))), _SENT).repartitionById(parts, "part").groupBy("part").applyInArrow(_meet(parts), _SENT)
    if len(hot):
        met = met.groupBy("part").applyInArrow(_meet(parts), _SENT)
    texts = rows.mapInArrow(_texts(parts), _SENT)
    return texts.groupBy("part").cogroup(met.groupBy("part")).applyInArrow(_finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
