"""Suffix-array dedup: removes each byte covered by a string of `length` bytes that starts at another place too.

A common-prefix-aware distributed merge sort of a sparse suffix array.

1. Anchors. Each window of `length` bytes belongs to one anchor: the place of the least hashed 8-byte gram among the window's
   first `span` places (the leftmost of equals). That depends on the window's bytes alone, so equal windows have their anchors at
   equal offsets. Only the suffixes at anchors are sorted, about two for each `span` bytes, each with the range of windows
   that belong to it.
2. Suffixes that cannot repeat are left out before any text moves: of each anchor a hash of the `length - span + 1` bytes that
   follow (they are in each of its windows) is counted over the whole table, and those counted once go. A
   hash decides nothing else.
3. Sorted runs. The suffixes left, ordered by that hash and then their bytes, are sorted in runs of bounded size. Suffixes of a run
   with equal contexts are one entry with several places. Runs are cut into ranges of the hash, front-coded (length of the
   common prefix with the entry before, and the rest) and exchanged.
4. Each range is merged by a loser tree that keeps, for each run, its common prefix with the last winner: unequal ones
   decide without looking at the bytes, equal ones are compared from there on, so no known prefix is compared again.
   The merge yields each entry's common prefix with the one before.
5. Entries with a common prefix of `length - span + 1` bytes form a group. Window d (starting d bytes left of the anchor)
   repeats if another entry has the same `length - d` bytes to the right and d bytes to the left; classes of both come from the
   common prefixes in the order by right and by left contexts. All comparisons are of bytes, none of hashes.
6. Windows found are joined to the texts, merged into spans and removed.

Passages. The same steps run over words beside bytes: a text's words `[^\\x20\\x09-\\x0D]+` are 64-bit codes, a window is
`passage_words` of them, and only windows that some other row has count. They are not removed; n_passages and
n_passage_words say how many maximal runs of words another text has too, and how many words are in them. (A passage of 51 words
is often shorter than 400 bytes.) The lowest bit of an anchor's hash tells words from bytes, so both go through one
exchange. Word windows are compared by 64 hashed bits of the words that an anchor's windows share and 32 of each word; everything
else is compared by bytes.

Hot groups. Copies are one entry of each run, however many there are; an entry with over `inline` places keeps them in a table of
its own, and what the merge finds for it is joined back there, so no task gathers all copies. But what follows an anchor may recur with ever different
bytes before it (a passage that a third of all texts hold), and those entries would all meet in one group. So of each hash the
distinct contexts are counted too, and anchors of one with over `hot_contexts` of them are replaced by their single windows, each
an anchor at its own first byte with d = 0 and its own hash: now only equal windows meet, and those found once go as in 2.

Memory: chunks, runs, ranges and groups are of bounded size.

A null or empty text has no bytes. Texts are whole; very long ones are cut into overlapping chunks for step 1 only. Repeated
rows are copies and lose what they share; null ids keep their rows. Columns other than the two named are ignored. An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, drop_now, free_shuffles, materialize, spread, with_row_id

LENGTH, SPAN, GRAM = 400, 300, 8
PASSAGE_WORDS, PASSAGE_SPAN, WORD_GRAM, WORD, BRIEF = 51, 36, 3, 8, 4  # passages of over 50 words; a word's code has 8 bytes, in runs 4
LONG_WORD = 1 << 16  # bytes of a word from which it is hashed apart
CHUNK_BYTES, RUN_ENTRIES, RANGE_ENTRIES, HOT_CONTEXTS = 1 << 18, 60_000, 50_000, 20_000
INLINE = 64  # places of an entry that travel with it
PAIRS_UP_TO = 12  # entries of a group that are compared two by two; larger groups go by classes
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


BLANKS = bytes(32 if c in b"\t\n\x0b\x0c\r" else c for c in range(256))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


class Powers(dict):
    """n -> BASE to the powers 0 to n or more, and their inverses, modulo 2^64. Each process makes its own, and holds the longest only."""

    def __missing__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if self and (most := max(self)) > n:
            return self[most]
        self.clear()
        both = np.full((2, n + 1), BASE, dtype=np.uint64)
        both[1] = pow(BASE, -1, 1 << 64)
        both[:, 0] = 1
        self[n] = tuple(np.cumprod(both, axis=1))
        return self[n]

    def __reduce__(self):
        return Powers, ()


POWERS = Powers()


def string_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], equal for equal strings: polynomials modulo 2^64 from prefix sums."""
    n = len(data)
    powers, inverse = POWERS[1 << max(16, n.bit_length())]  # few sizes, each made once
    sums = np.empty(n + 1, dtype=np.uint64)
    sums[0] = 0
    terms = data.astype(np.uint64)
    terms += np.uint64(1)
    terms *= powers[:n]
    np.cumsum(terms, out=sums[1:])
    return _mixed((sums[end] - sums[start]) * inverse[start])


class Shape:
    """length and span in units (bytes, or words of `unit` bytes), and the units that all windows of an anchor share.

    across: only windows that another row has too count as repeated.
    """

    def __init__(self, length: int = LENGTH, span: int = SPAN, *, unit: int = 1, across: bool = False):
        self.gram = GRAM if unit == 1 else WORD_GRAM
        if not 1 <= span <= length - self.gram + 1:
            raise ValueError(f"span must be between 1 and length - {self.gram - 1}")
        self.length, self.span, self.shared, self.unit, self.across = length, span, length - span + 1, unit, across
        self.brief = 1 if unit == 1 else BRIEF  # bytes of a unit in sorted runs
        self.weights = np.random.default_rng(7).integers(0, 1 << 63, self.shared, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def units(self, data: bytes) -> np.ndarray:
        return np.frombuffer(data, dtype=np.uint8 if self.unit == 1 else ">u8")

    def shortened(self, data: bytes) -> bytes:
        """The units as they stand in sorted runs."""
        return data if self.unit == self.brief else (self.units(data) >> np.uint64(32)).astype(">u4").tobytes()

    def grams(self, flat: bytes) -> np.ndarray:
        """A hash of the units at each place and after it; window starts are told apart by these."""
        if self.unit == 1:
            n = len(flat)
            return _mixed(np.ndarray((n,), "<u8", flat + bytes(GRAM), strides=(1,)) + np.uint64(0x9E3779B97F4A7C15))
        codes = np.concatenate([self.units(flat).astype(np.uint64), np.zeros(WORD_GRAM, np.uint64)])
        return _mixed(sum(codes[k : len(codes) - WORD_GRAM + k] * self.weights[k] for k in range(WORD_GRAM)))


def _pieces(text: bytes, size: int):
    """(piece, whether it ends the text): a text in parts of about `size` bytes, cut at blanks. A longer word is a part of its own."""
    text, at = text.translate(BLANKS), 0
    while len(text) - at > size:
        cut = text.rfind(b" ", at, at + size)
        if cut < at:
            cut = text.find(b" ", at + size)
        if cut < 0:
            break
        yield text[at:cut], False
        at = cut + 1
    yield text[at:], True


def word_codes(texts, size: int = CHUNK_BYTES):
    """For each text its words as 64-bit codes, 8 bytes each."""
    import xxhash

    held: list[tuple] = []
    parts: list[bytes] = []  # codes of the text that is not yet whole
    count = 0

    def flush():
        flat = b" ".join((*(p for p, _ in held), b""))
        data = np.frombuffer(flat, np.uint8)
        edge = np.flatnonzero(np.diff(data == 32, prepend=True))
        starts, ends = edge[::2], edge[1::2]
        h = string_hashes(data, starts, ends)
        for k in np.flatnonzero(ends - starts > LONG_WORD):
            h[k] = xxhash.xxh64_intdigest(flat[starts[k] : ends[k]])
        coded, at = h.astype(">u8").tobytes(), 0
        for (_, last), stop in zip(held, np.searchsorted(starts, np.cumsum([len(p) + 1 for p, _ in held])).tolist(), strict=True):
            parts.append(coded[8 * at : 8 * stop])
            at = stop
            if last:
                yield b"".join(parts)
                parts.clear()
        held.clear()

    for text in texts:
        for piece, last in _pieces(text, size):
            if len(piece) > max(size, LONG_WORD) and b" " not in piece:
                yield from flush()
                parts.append(xxhash.xxh64_digest(piece))
                piece = b""
            held.append((piece, last))
            count += len(piece)
            if count >= size:
                yield from flush()
                count = 0
    yield from flush()


def anchors(texts: list[bytes], shape: Shape) -> tuple[np.ndarray, ...]:
    """Of the texts' windows: text number, anchor's place, least and greatest d, hashes of what follows and of the whole context."""
    flat = b"".join(texts)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) // shape.unit
    ends = np.cumsum(sizes)
    n, w = len(flat) // shape.unit, shape.span
    windows = np.maximum(sizes - shape.length + 1, 0)
    total = int(windows.sum())
    if not total:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    packed = (shape.grams(flat) & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    blocks = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, dtype=np.uint64)
    blocks[:n] = packed
    blocks = blocks.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    of = np.repeat(np.arange(len(texts)), windows)
    first = np.repeat(ends - sizes - (np.cumsum(windows) - windows), windows)
    starts = np.arange(total) + first
    at = (np.minimum(behind[starts], ahead[starts + w - 1]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (of[1:] != of[:-1]))))
    last = np.concatenate((new[1:], [total])) - 1
    place, doc = at[new], of[new]
    data = shape.units(flat)
    h = np.empty(len(new), dtype=np.uint64)
    for k in range(0, len(new), 8192):
        h[k : k + 8192] = (data[place[k : k + 8192, None] + np.arange(shape.shared)].astype(np.uint64) * shape.weights).sum(axis=1, dtype=np.uint64)
    context = string_hashes(data, starts[new], starts[last] + shape.length)
    return doc, place - (ends - sizes)[doc], place - starts[last], place - starts[new], shape_hash(_mixed(h), shape), context


def shape_hash(h: np.ndarray, shape: Shape) -> np.ndarray:
    """Its lowest bit is 1 for words, 0 for bytes."""
    return (h & ~np.uint64(1)) | np.uint64(shape.unit > 1)


def _chunks(texts, shape: Shape, size: int):
    """Lists of (row, offset in units, bytes) of about `size` bytes; each window of each text is in just one chunk."""
    held, count, size, length = [], 0, max(1, size // shape.unit) * shape.unit, shape.length * shape.unit
    for row, text in enumerate(texts):
        for at in range(0, max(1, len(text) - length + 1), size):
            part = text[at : at + size + length - shape.unit]
            if len(part) < length:
                continue
            held.append((row, at // shape.unit, part))
            count += len(part)
            if count >= size:
                yield held
                held, count = [], 0
    if held:
        yield held


def anchor_rows(rows: DataFrame, shapes: list[Shape], size: int = CHUNK_BYTES) -> DataFrame:
    """rows (_rid, _bytes) to (h, context, _rid, place, lo, hi); places in units."""

    def run(batches):
        for b in batches:
            rid = np.array(b.column(0))
            for shape in shapes:
                texts = (x.as_py() or b"" for x in b.column(1))
                for chunk in _chunks(texts if shape.unit == 1 else word_codes(texts), shape, size):
                    doc, place, lo, hi, h, context = anchors([x[2] for x in chunk], shape)
                    row, offset = (np.array([x[k] for x in chunk], dtype=np.int64) for k in (0, 1))
                    arrays = (h.view(np.int64), context.view(np.int64), rid[row[doc]], place + offset[doc], lo.astype(np.int32), hi.astype(np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["h", "context", "_rid", "place", "lo", "hi"])

    return rows.mapInArrow(run, "h long, context long, _rid long, place long, lo int, hi int")


def _located(batch: pa.RecordBatch, shapes: list[Shape]):
    """(rid, shape, the text's bytes or codes, anchors' h, place, lo, hi) of rows (_rid, _bytes, at), for each shape that they have."""
    for i in range(batch.num_rows):
        text, at = batch.column(1)[i].as_py(), batch.column(2)[i].values
        h, place, lo, hi = (at.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4))
        for shape in shapes:
            if (on := np.flatnonzero((h & 1) == (shape.unit > 1))).size:
                yield batch.column(0)[i].as_py(), shape, text if shape.unit == 1 else next(word_codes([text])), h[on], place[on], lo[on], hi[on]


def window_rows(found: DataFrame, shapes: list[Shape]) -> DataFrame:
    """found (_rid, _bytes, at array<struct<h, place, lo, hi>>) to its single windows as anchors (h, _rid, place, lo, hi)."""

    def run(batches):
        for b in batches:
            for rid, shape, text, _, place, lo, hi in _located(b, shapes):
                data = shape.units(text)
                for k in range(0, len(place), 256):
                    counts = (hi - lo + 1)[k : k + 256]
                    starts = np.repeat((place - hi)[k : k + 256] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
                    low = int(starts.min())
                    h = shape_hash(string_hashes(data[low : int(starts.max()) + shape.length], starts - low, starts - low + shape.length), shape)
                    zero = pa.array(np.zeros(len(starts), np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(starts), rid)), pa.array(starts), zero, zero], names=["h", "_rid", "place", "lo", "hi"])

    return found.mapInArrow(run, "h long, _rid long, place long, lo int, hi int")


# -- Front-coded runs -------------------------------------------------------------------------------------------------


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """The length of the longest common prefix; the first `known` bytes are not looked at."""
    n = min(len(a), len(b))
    if (x := a[known:n]) == (y := b[known:n]):
        return n
    return n - (((int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_length() + 7) >> 3)


def coded(entries: list[tuple]) -> bytes:
    """Sorted entries (key, left, lo, hi, [(rid, place), ...]) front-coded."""
    import zstandard

    before, lcps, tails, lefts = b"", [], [], []
    for key, left, *_ in entries:
        lcps.append(common_prefix(before, key))
        tails.append(key[lcps[-1] :])
        lefts.append(left)
        before = key
    places = [p for e in entries for p in e[4]]
    numbers = np.array([lcps, [*map(len, tails)], [*map(len, lefts)], [e[2] for e in entries], [e[3] for e in entries], [len(e[4]) for e in entries]], dtype="<u4")
    members = np.array(places, dtype="<i8").reshape(-1, 2)
    return zstandard.ZstdCompressor(level=3).compress(b"".join((struct.pack("<QQ", len(entries), len(places)), numbers.tobytes(), members.tobytes(), *tails, *lefts)))


def decoded(block: bytes):
    """(key, common prefix with the key before, (left, lo, hi, members)) of a coded run, one by one."""
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(block)
    n, m = struct.unpack_from("<QQ", data)
    lcps, tails, lefts, los, his, counts = np.frombuffer(data, "<u4", 6 * n, 16).reshape(6, n).tolist()
    members = np.frombuffer(data, "<i8", 2 * m, 16 + 24 * n).reshape(m, 2)
    at = 16 + 24 * n + 16 * m
    left_at, key, k = at + sum(tails), b"", 0
    for lcp, tail, left, lo, hi, count in zip(lcps, tails, lefts, los, his, counts, strict=True):
        key = key[:lcp] + data[at : at + tail]
        yield key, lcp, (data[left_at : left_at + left], lo, hi, members[k : k + count])
        at, left_at, k = at + tail, left_at + left, k + count


def merged(runs: list):
    """(key, common prefix with the key before, payload) in order, by a loser tree over runs of the same."""
    size = 1
    while size < len(runs):
        size *= 2
    heads = [next(r, None) for r in runs] + [None] * (size - len(runs))
    key = [h[0] if h else None for h in heads]  # None: the run has ended, after all others
    known = [0] * size  # common prefix with the last winner
    loser = [0] * size

    def beats(a: int, b: int) -> bool:
        """Whether a's head comes first; the loser then knows its common prefix with that winner."""
        if key[b] is None:
            return True
        if key[a] is None:
            return False
        if known[a] != known[b]:
            return known[a] > known[b]
        lcp = common_prefix(key[a], key[b], known[a])
        x, y = key[a][lcp : lcp + 1], key[b][lcp : lcp + 1]
        if first := x < y or (x == y and a < b):
            known[b] = lcp
        else:
            known[a] = lcp
        return first

    def build(node: int) -> int:
        if node >= size:
            return node - size
        a, b = build(2 * node), build(2 * node + 1)
        if not beats(a, b):
            a, b = b, a
        loser[node] = b
        return a

    top = build(1) if size > 1 else 0
    while key[top] is not None:
        yield key[top], known[top], heads[top][2]
        heads[top] = next(runs[top], None)
        key[top], known[top] = (heads[top][0], heads[top][1]) if heads[top] else (None, 0)
        node = (top + size) // 2
        while node:
            if not beats(top, loser[node]):
                top, loser[node] = loser[node], top
            node //= 2


# -- Groups ---------------------------------------------------------------------------------------------------------


class Entry:
    """One context of a group: what follows the anchor, its common prefix with the entry before, what precedes it, and its places."""

    __slots__ = ("right", "lcp", "left", "lo", "hi", "count", "least", "most", "places")

    def __init__(self, right: bytes, lcp: int, left: bytes, lo: int, hi: int):
        self.right, self.lcp, self.left, self.lo, self.hi = right, lcp, left, lo, hi
        self.count, self.least, self.most, self.places = 0, 1 << 63, -1, []

    def add(self, places: list[list[int]], across: bool) -> None:
        """places: (row, place); or, of an entry that keeps its places elsewhere, (-1, their name), (-2, least row), (-2, greatest row)."""
        self.count += len(places)
        self.places += places
        if across:
            for rid, place in places:
                if rid != -1:
                    rid = place if rid == -2 else rid
                    if rid < self.least:
                        self.least = rid
                    if rid > self.most:
                        self.most = rid


def repeated(entries: list[Entry], shape: Shape) -> list[list[tuple[int, int]]]:
    """For each entry of a group, the intervals of d (in bytes) of its windows that repeat. entries: ordered by right, distinct."""
    n, unit, length = len(entries), shape.brief, shape.length * shape.brief
    whole = [e.least < e.most if shape.across else e.count > 1 for e in entries]
    full = [[(e.lo, e.hi)] if w else [] for e, w in zip(entries, whole, strict=True)]
    if n == 1:
        return full
    back = [e.left[::-1] for e in entries]
    if n <= PAIRS_UP_TO:
        for i, x in enumerate(entries):
            low = length
            for j in range(i + 1, n):
                y = entries[j]
                low = min(low, y.lcp)
                if low < shape.shared * unit:
                    break
                if shape.across and x.least == x.most == y.least == y.most:
                    continue
                a = max(x.lo, y.lo, length - low // unit * unit)
                b = min(x.hi, y.hi)
                if a <= b and (b := min(b, common_prefix(back[i], back[j]) // unit * unit)) >= a:
                    full[i].append((a, b))
                    full[j].append((a, b))
        return full
    right = np.array([e.lcp for e in entries])
    right[0] = 0
    lo, hi = (np.array([getattr(e, k) for e in entries]) for k in ("lo", "hi"))
    least, most = (np.array([getattr(e, k) for e in entries]) for k in ("least", "most"))
    order = sorted(range(n), key=back.__getitem__)
    left = np.array([0, *(common_prefix(back[a], back[b]) for a, b in zip(order, order[1:], strict=False))])
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.arange(n)
    hit = np.zeros((n, int(hi.max()) // unit + 2), dtype=bool)
    for d in range(int(lo.min()), int(hi.max()) + 1, unit):
        on = np.flatnonzero((lo <= d) & (d <= hi))
        if len(on) > 1:
            both = np.cumsum(right < length - d)[on] * (n + 1) + np.cumsum(left < d)[rank[on]]
            _, where, counts = np.unique(both, return_inverse=True, return_counts=True)
            if shape.across:
                first, last = np.full(len(counts), 1 << 62), np.full(len(counts), -1)
                np.minimum.at(first, where, least[on])
                np.maximum.at(last, where, most[on])
                hit[on, d // unit] = (first < last)[where]
            else:
                hit[on, d // unit] = counts[where] > 1
    step = np.diff(hit.astype(np.int8), axis=1, prepend=0)
    for i in np.flatnonzero(~np.array(whole) & hit.any(axis=1)):
        full[i] = list(zip((np.flatnonzero(step[i] == 1) * unit).tolist(), ((np.flatnonzero(step[i] == -1) - 1) * unit).tolist(), strict=True))
    return full


def merge_range(blocks: list[bytes], shapes: list[Shape]):
    """(rid, place, first unit, end, 1 for words) covered by repeated windows, from one range's runs.

    The first unit and the end are relative to the place. Of entries that keep their places elsewhere the row is -1 and the
    place their name.
    """
    by_kind = {int(x.unit > 1): x for x in shapes}

    def flush(group: list[Entry], kind: int):
        if len(group) > 1 or group and group[0].count > 1:
            shape = by_kind[kind]
            for e, spans in zip(group, repeated(group, shape), strict=True):
                for a, b in spans:
                    start, end = -b // shape.brief, -a // shape.brief + shape.length
                    for rid, place in e.places:
                        if rid != -2:
                            yield rid, place, start, end, kind

    group, known, kind = [], {}, 0
    gap = 1 << 30  # common prefix with the last entry kept: the least since then
    for key, lcp, (left, lo, hi, places) in merged([decoded(b) for b in blocks]):
        now = key[7] & 1
        if lcp < 8 + by_kind[now].shared * by_kind[now].brief:
            yield from flush(group, kind)
            group, known, gap, kind = [], {}, 1 << 30, now
        elif lcp < len(key) or not group or len(group[-1].right) + 8 != len(key):
            known = {}  # keys differ
        gap = min(gap, lcp)
        if (same := known.get((left, lo, hi))) is None:
            same = known[left, lo, hi] = Entry(key[8:], gap - 8, left, lo, hi)
            group.append(same)
            gap = 1 << 30
        same.add(places.tolist(), kind == 1)
    yield from flush(group, kind)


def run_rows(found: DataFrame, shapes: list[Shape], ranges: int, entries: int = RUN_ENTRIES, inline: int = INLINE) -> DataFrame:
    """found (_rid, _bytes, at array<struct<h, place, lo, hi>>) to (range, block, name, rids, places): sorted runs, cut and front-coded.

    Rows without a block are the places of an entry that has over `inline` of them in its run. They go to the entry's range, and their
    name is of the task's attempt, so a range stays whole if a lost task is run again and groups its runs otherwise.
    """
    names = ["range", "block", "name", "rids", "places"]

    def run(batches):
        from pyspark import TaskContext

        held: dict[tuple, list] = {}
        count, name = 0, TaskContext.get().taskAttemptId() << 24

        def flush():
            nonlocal name
            ordered = sorted((*k, v) for k, v in held.items())
            held.clear()
            blocks, away, at = [], [], 0
            while at < len(ordered):
                r = int.from_bytes(ordered[at][0][:8], "big") * ranges >> 64
                out = []
                while at < len(ordered) and int.from_bytes(ordered[at][0][:8], "big") * ranges >> 64 == r:
                    *entry, places = ordered[at]
                    if len(places) > max(1, inline):
                        rids, own = zip(*places, strict=True)
                        away.append((r, None, name, rids, own))
                        places = [(-1, name), (-2, min(rids)), (-2, max(rids))]
                        name += 1
                    out.append((*entry, places))
                    at += 1
                blocks.append((r, coded(out)))
            rows = [(r, block, -1, None, None) for r, block in blocks] + away
            kinds = [pa.int32(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], kind) for k, kind in enumerate(kinds)], names=names)

        for b in batches:
            for rid, shape, text, h, place, lo, hi in _located(b, shapes):
                length, unit, text = shape.length * shape.brief, shape.brief, shape.shortened(text)
                heads = h.astype(">i8").tobytes()
                for k, (p, a, z) in enumerate(zip(place.tolist(), lo.tolist(), hi.tolist(), strict=True)):
                    at = p * unit
                    held.setdefault((heads[8 * k : 8 * k + 8] + text[at : at + length], text[at - z * unit : at], a * unit, z * unit), []).append((rid, p))
                    count += 1
                if count >= entries:
                    yield flush()
                    count = 0
        if held:
            yield flush()

    return found.mapInArrow(run, "range int, block binary, name long, rids array<long>, places array<long>")


def covered_rows(runs: DataFrame, shapes: list[Shape], ranges: int) -> DataFrame:
    """run_rows() to (_rid, kind, a, b): the units that repeated windows cover; kind is 1 for words."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        blocks = [x for x in pdf["block"] if x is not None]
        out = [np.array([(*x, 0) for x in merge_range(blocks, shapes)], dtype=np.int64).reshape(-1, 6)]
        for name, rids, places in pdf.loc[pdf["block"].isna(), ["name", "rids", "places"]].itertuples(index=False):
            rows = np.full((len(rids), 6), (0, 0, 0, 0, -1, int(name)), dtype=np.int64)
            rows[:, 0], rows[:, 1] = rids, places
            out.append(rows)
        return pd.DataFrame(np.concatenate(out), columns=["_rid", "place", "a", "b", "kind", "name"])

    said = materialize(runs.repartition(ranges, "range").groupBy("range").applyInPandas(run, "_rid long, place long, a long, b long, kind long, name long"), "covered")
    kept = said.where("kind < 0").select("name", "_rid", "place")
    far = said.where("_rid < 0").select(F.col("place").alias("name"), "a", "b", "kind").join(kept, "name").select("_rid", "place", "a", "b", "kind")
    near = said.where("_rid >= 0 AND kind >= 0").select("_rid", "place", "a", "b", "kind")
    return near.unionByName(far).select("_rid", "kind", (F.col("place") + F.col("a")).alias("a"), (F.col("place") + F.col("b")).alias("b"))


def spans_of(pairs) -> list[tuple[int, int]]:
    """The maximal runs of the intervals' union."""
    out: list[list[int]] = []
    for a, b in sorted(pairs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _met(every: DataFrame, spare: list[DataFrame]) -> DataFrame:
    """The anchors whose hash occurs twice or more (words': in two rows). Both sides of the join are read from tables, so hot hashes are split."""
    counts = every.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("_rid").alias("least"), F.max("_rid").alias("most"))
    spare.append(materialize(counts.where("n > 1 AND (h & 1 = 0 OR least < most)").select("h"), "hashes-met"))
    return every.join(spare[-1], "h", "left_semi")


def _with_texts(found: DataFrame, rows: DataFrame) -> DataFrame:
    places = found.groupBy("_rid").agg(F.collect_list(F.struct("h", "place", "lo", "hi")).alias("at"))
    return places.join(rows, "_rid").select("_rid", "_bytes", "at")


def candidates(rows: DataFrame, shapes: list[Shape], size: int, hot_contexts: int) -> DataFrame:
    """(h, _rid, place, lo, hi): the anchors whose windows may repeat, those of hot hashes as single windows."""
    every = materialize(anchor_rows(spread(rows), shapes, size), "anchors")
    spare = [every]  # tables that nothing reads once the anchors met are written
    found = _met(every, spare)
    distinct = every.groupBy("h", "context").agg(F.lit(1).alias("one")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    hot = materialize(distinct.where(F.col("n") > hot_contexts).select("h"), "hashes-hot")
    spare.append(hot)
    if hot.isEmpty():
        out = materialize(found.drop("context"), "anchors-met")
    else:
        windows = materialize(window_rows(_with_texts(found.join(hot, "h", "left_semi").drop("context"), rows), shapes), "windows")
        spare.append(windows)
        out = materialize(found.join(hot, "h", "left_anti").drop("context").unionByName(_met(windows, spare)), "anchors-met")
    for t in spare:
        drop_now(t)
    return out


def repeated_spans(rows: DataFrame, shapes: list[Shape], *, size: int = CHUNK_BYTES, run_entries: int = RUN_ENTRIES, range_entries: int = RANGE_ENTRIES, hot_contexts: int = HOT_CONTEXTS, inline: int = INLINE) -> DataFrame:
    """rows (_rid, _bytes) to (_rid, spans): the intervals that repeated windows cover, for rows that have any."""
    found = candidates(rows, shapes, size, hot_contexts)
    ranges = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-found.count() // range_entries))
    free_shuffles(rows.sparkSession)
    covered = covered_rows(run_rows(_with_texts(found, rows), shapes, ranges, run_entries, inline), shapes, ranges)
    drop_now(found)
    free_shuffles(rows.sparkSession)
    return covered.groupBy("_rid").agg(F.collect_list(F.struct("kind", "a", "b")).alias("spans"))


def suffix_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, length: int = LENGTH, span: int = SPAN, passage_words: int = PASSAGE_WORDS, passage_span: int = PASSAGE_SPAN, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages, n_passage_words; with_text adds `kept`, the remaining bytes."""
    rows = with_row_id(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string").cast("binary"), F.lit(b"")).alias("_bytes")))
    shapes = [Shape(length, span), Shape(passage_words, passage_span, unit=WORD, across=True)]
    spans = repeated_spans(rows.select("_rid", "_bytes"), shapes, **options)
    joined = rows.join(spans, "_rid", "left").select("doc_id", "_bytes", "spans")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "n_passage_words", *["kept"] * with_text]

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                b = batch.slice(start, 1000)
                lists, out = b.column(2), []
                ends, none = lists.offsets.to_numpy(), lists.is_null().to_numpy(zero_copy_only=False)
                kinds, firsts, lasts = (lists.values.field(k).to_numpy(zero_copy_only=False) for k in range(3))
                for i in range(b.num_rows):
                    text, at = b.column(1)[i].as_py(), slice(0, 0) if none[i] else slice(ends[i], ends[i + 1])
                    kind, first, last = kinds[at], firsts[at], lasts[at]
                    runs, passages = (spans_of(zip(first[kind == k].tolist(), last[kind == k].tolist(), strict=True)) for k in (0, 1))
                    kept, at = [], 0
                    for x, y in runs:
                        kept.append(text[at:x])
                        at = y
                    kept = b"".join((*kept, text[at:]))
                    out.append((len(text), len(text) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), len(passages), sum(y - x for x, y in passages), kept))
                columns = list(zip(*out, strict=True)) if out else [[]] * 7
                arrays = [b.column(0), *(pa.array(c, type=pa.string() if k == 3 else pa.int64()) for k, c in enumerate(columns[:6]))]
                yield pa.RecordBatch.from_arrays([*arrays, *[pa.array(columns[6], type=pa.binary())] * with_text], names=names)

    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long, n_passage_words long" + ", kept binary" * with_text
    return joined.mapInArrow(run, schema)


#: The definition in SQL, window by window.
ORACLE = f"""
WITH b AS (SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS b, regexp_extract_all(coalesce(text, ''), '[^{SPACE}]+') AS ws FROM documents),
w AS (SELECT rid, i, md5(array_slice(b, i, i + {LENGTH - 1})) AS h FROM (SELECT rid, b, unnest(generate_series(1, octet_length(b) - {LENGTH - 1})) AS i FROM b)),
m AS (SELECT rid, i FROM w QUALIFY count(*) OVER (PARTITION BY h) > 1),
g AS (SELECT rid, i, CASE WHEN i - lag(i) OVER (PARTITION BY rid ORDER BY i) <= {LENGTH} THEN 0 ELSE 1 END AS new FROM m),
s AS (SELECT rid, min(i) AS x, max(i) + {LENGTH} AS y FROM (SELECT rid, i, sum(new) OVER (PARTITION BY rid ORDER BY i) AS k FROM g) GROUP BY rid, k),
p AS (SELECT rid, x, coalesce(lag(y) OVER (PARTITION BY rid ORDER BY x), 1) AS a, x AS z FROM s UNION ALL SELECT rid, max(x) + 1, max(y), NULL FROM s GROUP BY rid),
k AS (SELECT rid, coalesce(string_agg(hex(array_slice(b, a, coalesce(z - 1, octet_length(b)))), '' ORDER BY x) FILTER (WHERE a <= coalesce(z - 1, octet_length(b))), '') AS kept FROM p JOIN b USING (rid) GROUP BY rid),
n AS (SELECT rid, count(*) AS n_spans, sum(y - x) AS n_removed FROM s GROUP BY rid),
w2 AS (SELECT rid, i, md5(array_to_string(list_slice(ws, i, i + {PASSAGE_WORDS - 1}), ' ')) AS h FROM (SELECT rid, ws, unnest(generate_series(1, len(ws) - {PASSAGE_WORDS - 1})) AS i FROM b)),
m2 AS (SELECT rid, i FROM w2 QUALIFY min(rid) OVER (PARTITION BY h) < max(rid) OVER (PARTITION BY h)),
g2 AS (SELECT rid, i, CASE WHEN i - lag(i) OVER (PARTITION BY rid ORDER BY i) <= {PASSAGE_WORDS} THEN 0 ELSE 1 END AS new FROM m2),
s2 AS (SELECT rid, max(i) + {PASSAGE_WORDS} - min(i) AS size FROM (SELECT rid, i, sum(new) OVER (PARTITION BY rid ORDER BY i) AS k FROM g2) GROUP BY rid, k),
n2 AS (SELECT rid, count(*) AS n_passages, sum(size) AS n_words FROM s2 GROUP BY rid)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  CASE WHEN kept IS NULL THEN sha256(b) ELSE sha256(unhex(kept)) END AS kept_sha256, CAST(coalesce(n_passages, 0) AS BIGINT) AS n_passages, CAST(coalesce(n_words, 0) AS BIGINT) AS n_passage_words
FROM b LEFT JOIN n USING (rid) LEFT JOIN k USING (rid) LEFT JOIN n2 USING (rid)
"""
