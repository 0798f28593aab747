"""Suffix-array dedup: remove every byte covered by a long string that starts anywhere else.

Two suffixes that share their first `length` bytes share the smallest hash of
the grams in them, so suffixes are dealt into buckets by that gram: an
enhanced suffix array is built bucket by bucket, and no interval of common
prefix `length` or more is cut. Neighbouring suffixes with one smallest gram
travel as one segment of text.

1. Every document is cut into segments; only their hashes move. Grams met once
   drop out, segments whose whole text is met again are known to repeat.
2. Buckets that hold different segments fetch one copy of each from the
   documents. Tasks gather buckets of up to HOT segments into units, sort their
   suffixes (prefix doubling), take common prefixes from the ranks, and scan
   each interval of `length` or more with a stack: the nodes of the
   common-prefix interval tree whose occurrences are preceded by different
   bytes are the maximal repeats, put out with all their occurrences.
3. Buckets of more segments (one passage in very many documents) would load one
   task; their suffixes' first `length` bytes are compared by 64-bit hash
   within the bucket instead, counted with partial sums. The bytes removed are the same; `repeat_groups`
   lists such windows instead of maximal repeats.
4. Each segment's ranges, merged to one row, go back to all of its copies, and
   each document's to its text.

`remove_passages` counts words (runs of characters other than white space)
instead of bytes: it removes every string of whole characters that gives `words`
words or more, pieces of words at its ends among them, and starts anywhere else
as well. Its windows start a word apart and run from the last character of a
word to the first of the word `words` - 1 later; grams are of WORD_GRAM whole
words inside. Segments take in the whole words at their ends, so that suffix
arrays find how far a repeat goes into them; in buckets of more than HOT
segments the windows are hashed, and at the ends of runs of windows that are met
again their extensions into both words.

Offsets are bytes of UTF-8; matches never cross documents.

Defined cases: a null or empty text has nothing to remove; texts shorter than
`length` bytes keep all; repeated rows (same doc_id, same text) repeat each
other and are both cut; a null doc_id is a document like others; very long
texts are cut into segments by parts of PART bytes that overlap; an empty table
gives no row; other columns are kept by `remove_repeats`, ignored elsewhere.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, give_back, mix64, staged, unstage

GRAM, HOT, WORD_GRAM = 128, 600, 10
PART, UNIT = 2 << 20, 1 << 19
#: White space as of str.split: single bytes, and the longer characters by their first byte.
_BLANK = np.isin(np.arange(256), [*range(9, 14), *range(28, 33)])
_BLANKS = [x.encode() for x in ("\x85", "\xa0", "\u1680", *map(chr, range(0x2000, 0x200B)), "\u2028", "\u2029", "\u202f", "\u205f", "\u3000")]
_RUN = "doc_id long, th long, s long, n int, mh long, sh long"


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the gram at each place, by doubling."""
    mult = 0x9E3779B97F4A7C15
    h, size, out, done = data.astype(np.uint64), 1, None, 0
    while True:
        if gram & size:
            if out is None:
                out, done = h, size
            else:
                m = max(0, min(len(out) - size, len(h)))
                out = out[size : size + m] + h[:m] * np.uint64(pow(mult, done, 1 << 64))
                done += size
        if size * 2 > gram:
            break
        m = max(0, len(h) - size)
        h = h[:m] * np.uint64(pow(mult, size, 1 << 64)) + h[size : size + m]
        size *= 2
    return mix64(out)


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """The place of the smallest of each `width` neighbouring hashes."""
    m = len(h) - width + 1
    key = h & ~np.uint64((1 << 24) - 1) | np.arange(len(h), dtype=np.uint64)  # ties: the leftmost
    blocks = np.concatenate((key, np.full(-len(key) % width, ~np.uint64(0)))).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(behind[:m], ahead[width - 1 : width - 1 + m]) & np.uint64((1 << 24) - 1)).astype(np.int64)


def _segments(data: bytes, offsets: np.ndarray, length: int, gram: int):
    """Runs of windows with one smallest gram over texts laid end to end: start, windows, gram hash."""
    raw = np.frombuffer(data, dtype=np.uint8)
    width = length - gram + 1
    h = _gram_hashes(raw, gram)
    m = len(h) - width + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = _least(h, width)
    n = np.diff(offsets)
    fits = np.zeros(m + 1, dtype=np.int8)
    long = np.flatnonzero(n >= length)
    np.add.at(fits, offsets[long], 1)
    np.add.at(fits, np.minimum(offsets[long] + n[long] - length + 1, m), -1)
    at = np.flatnonzero(np.cumsum(fits[:-1]))
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.flatnonzero((np.diff(least[at]) != 0) | (np.diff(at) != 1) | np.isin(at[1:], offsets)) + 1
    first = np.concatenate(([0], cut))
    return at[first], np.diff(np.append(first, len(at))), h[least[at[first]]].view(np.int64)


def segments(keyed: DataFrame, length: int, gram: int = GRAM, words: int = 0) -> DataFrame:
    """doc_id, th, s (offset), n (windows of `length` bytes), mh (gram hash), sh (text hash) of each segment of each document.

    With words, the segments are those of windows of so many words.
    """

    def run(batches):
        for batch in batches:
            texts, held, size = batch.column("text").cast(pa.large_binary()), [], 0
            ids, ths = batch.column("doc_id").to_pylist(), batch.column("th").to_pylist()
            for d in range(batch.num_rows):
                text = texts[d].as_buffer()
                for at, part in _pieces(bytes(text), words) if words else ((at, bytes(text[at : at + PART + length - 1])) for at in range(0, max(1, len(text) - length + 1), PART)):
                    held.append((ids[d], ths[d], at, part))
                    size += len(part)
                    if size >= PART:
                        yield flush(held)
                        held, size = [], 0
            if held:
                yield flush(held)
            held, texts = [], None
        give_back()

    def flush(held):
        offsets = np.concatenate(([0], np.cumsum([len(x[3]) + (words > 0) for x in held])))
        data = b"".join(x[3] + b"\n" * (words > 0) for x in held)
        if words:
            s, end, mh = _word_segments(data, offsets, words)
            n = end - s - length + 1
        else:
            s, n, mh = _segments(data, offsets, length, gram)
        of = np.searchsorted(offsets, s, side="right") - 1
        view = memoryview(data)
        digest = xxhash.xxh3_64_intdigest
        sh = np.array([digest(view[a : a + b + length - 1]) for a, b in zip(s.tolist(), n.tolist(), strict=True)], dtype=np.uint64).view(np.int64)
        base = np.array([x[2] for x in held], dtype=np.int64)
        pick = pa.array(of)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([x[0] for x in held], pa.int64()).take(pick),
                pa.array([x[1] for x in held], pa.int64()).take(pick),
                pa.array(s - offsets[of] + base[of], pa.int64()),
                pa.array(n, pa.int32()),
                pa.array(mh, pa.int64()),
                pa.array(sh, pa.int64()),
            ],
            names=["doc_id", "th", "s", "n", "mh", "sh"],
        )

    return keyed.mapInArrow(run, _RUN)


def _inside(data: bytes) -> np.ndarray:
    """Which bytes are no white space."""
    inside = ~_BLANK[np.frombuffer(data, dtype=np.uint8)]
    for blank in _BLANKS:
        at = data.find(blank)
        while at >= 0:
            inside[at : at + len(blank)] = False
            at = data.find(blank, at + len(blank))
    return inside


def word_places(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First and last byte (exclusive) of each word."""
    inside = np.concatenate(([False], _inside(data), [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def _pieces(text: bytes, words: int):
    """A text in pieces of about PART bytes, each with its offset, that share all but one of `words` words."""
    at, size = 0, PART
    while at + size < len(text):
        part = text[at : at + size]
        starts, ends = word_places(part)
        if len(starts) <= words:
            size *= 2
            continue
        yield at, part[: ends[-2]]  # the last word may go on
        at, size = at + int(starts[len(starts) - words]), PART
    yield at, text[at:]


def _word_segments(data: bytes, offsets: np.ndarray, words: int):
    """Runs of word windows with one smallest gram over texts with a line end after each: first byte, last byte (exclusive), gram hash."""
    starts, ends = word_places(data)
    gram = min(WORD_GRAM, max(1, (words - 2) // 2))
    none = (np.zeros(0, np.int64),) * 3
    if len(starts) < words:
        return none
    raw = np.frombuffer(data, dtype=np.uint8)
    mult = 0x9E3779B97F4A7C15
    up, down = (np.cumprod(np.full(len(raw), x, dtype=np.uint64)) for x in (mult, pow(mult, -1, 1 << 64)))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(np.arange(1, 257, dtype=np.uint64))[raw] * up)))
    a, b = starts[: len(starts) - gram + 1], ends[gram - 1 :]
    h = mix64((total[b] - total[a]) * down[a])
    del up, down, total
    least = _least(h, words - 1 - gram)
    of = np.searchsorted(offsets, starts, side="right")
    at = np.flatnonzero(of[words - 1 :] == of[: len(of) - words + 1])
    if not len(at):
        return none
    cut = np.flatnonzero((np.diff(least[at + 1]) != 0) | (np.diff(at) != 1)) + 1
    first, last = at[np.concatenate(([0], cut))], at[np.append(cut, len(at)) - 1]
    return starts[first], ends[last + words - 1], h[least[first + 1]].view(np.int64)


def suffix_array(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes, each cut at ends[i], and common prefixes of neighbours where they are `length` or more (else 0).

    Prefix doubling: a suffix's rank is the place of the first of its equals,
    so that only those that still have equals are sorted again. The ranks of
    every step are kept, and common prefixes are read off them.
    """
    n = len(data)
    room = ends - np.arange(n)
    padded = np.concatenate((data.astype(np.uint64) + np.uint64(1), np.zeros(7, np.uint64)))
    key = np.zeros(n, np.int64)
    for k in range(7):  # seven symbols of nine bits; 0 past the end of a text
        key = key << 9 | np.where(room > k, padded[k : k + n], 0).astype(np.int64)
    order = np.argsort(key)
    slots, key = np.arange(n), key[order]
    rank, size, ranks = np.zeros(n, np.int32), 7, []  # a unit is far shorter than 2**31 bytes
    while True:
        new = np.concatenate(([True], key[1:] != key[:-1]))
        rank = rank.copy()
        rank[order[slots]] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
        ranks.append((size, rank))
        slots = slots[~(new & np.append(new[1:], True))]  # those with equals
        # equals at a text's end have nothing more to compare
        if not len(slots) or not np.any(room[order[slots]] > size):
            break
        at = order[slots]
        key = rank[at].astype(np.int64) * (n + 1) + np.where(room[at] > size, rank[np.minimum(at + size, n - 1)] + 1, 0)
        by = np.argsort(key)
        order[slots], key = at[by], key[by]
        size *= 2
    common = np.zeros(max(n - 1, 0), np.int64)
    least = max((r for r in ranks if r[0] <= length), key=lambda r: r[0], default=(0, np.zeros(n, np.int64)))[1]
    live = np.flatnonzero(least[order[:-1]] == least[order[1:]])
    a, b = order[live], order[live + 1]
    end_a, end_b, got = ends[a], ends[b], np.zeros(len(live), np.int64)
    for size, rank in reversed(ranks):
        ok = np.flatnonzero((a + size <= end_a) & (b + size <= end_b))
        ok = ok[rank[a[ok]] == rank[b[ok]]]
        a[ok] += size
        b[ok] += size
        got[ok] += size
    ok = np.arange(len(live))
    while len(ok):  # what is left of seven bytes
        ok = ok[(a[ok] < end_a[ok]) & (b[ok] < end_b[ok])]
        ok = ok[data[a[ok]] == data[b[ok]]]
        a[ok] += 1
        b[ok] += 1
        got[ok] += 1
    common[live] = np.where(got >= length, got, 0)
    return order, common


def maximal_repeats(texts: list[bytes], windows: list[int], length: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Maximal repeats of `length` bytes or more among texts: (bytes, occurrences as (text, offset)).

    Only the first windows[i] suffixes of a text count. The byte before a text
    is unknown and counts as unlike any other.
    """
    sizes = np.array([len(t) for t in texts])
    if not len(sizes):
        return []
    firsts = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    of = np.repeat(np.arange(len(texts)), sizes)
    ends = np.repeat(firsts + sizes, sizes)
    order, common = suffix_array(data, ends, length)
    before = np.where(np.arange(len(data)) == firsts[of], -1 - of, np.concatenate(([0], data[:-1])).astype(np.int64))
    counted = (np.arange(len(data)) - firsts[of]) < np.array(windows)[of]
    # intervals of common prefix `length` or more
    high = np.concatenate(([False], common >= length, [False]))
    los, his = np.flatnonzero(~high[:-1] & high[1:]), np.flatnonzero(high[:-1] & ~high[1:])
    if not len(los):
        return []
    left = before[order]
    low = np.minimum.reduceat(np.append(left, 0), np.stack((los, his + 1), axis=1).ravel())[::2]
    top = np.maximum.reduceat(np.append(left, 0), np.stack((los, his + 1), axis=1).ravel())[::2]
    out = []
    for lo, hi in zip(los[low != top].tolist(), his[low != top].tolist(), strict=True):
        members = order[lo : hi + 1].tolist()
        prefixes = [*common[lo:hi].tolist(), 0]
        lefts = left[lo : hi + 1].tolist()
        stack: list[list] = []  # open nodes: depth, first member, the byte before all of them (None: several)
        for i, p in enumerate(prefixes):
            begin, said = i, lefts[i]
            while stack and stack[-1][0] > p:
                d, begin, own = stack.pop()
                own = own if own == said else None
                if own is None:
                    places = [(int(of[q]), int(q - firsts[of[q]])) for q in members[begin : i + 1] if counted[q]]
                    if len(places) > 1:
                        out.append((d, places))
                said = own
            if p >= length:
                if stack and stack[-1][0] == p:
                    stack[-1][2] = said if stack[-1][2] == said else None
                else:
                    stack.append([p, begin, said])
    return out


def _covered(texts: list[bytes], windows: list[int], length: int) -> list[list[tuple[int, int]]]:
    """The ranges of each text that maximal repeats cover, merged."""
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    for size, places in maximal_repeats(texts, windows, length):
        for text, at in places:
            spans[text].append((at, at + size))
    return [merge(s) for s in spans]


def _covered_words(texts: list[bytes], words: int) -> list[list[tuple[int, int]]]:
    """The ranges of each text that repeated strings of `words` words or more cover, merged.

    The longest repeated string at a place is the longer common prefix with its
    suffix's neighbours; all others there are its beginnings.
    """
    length = 2 * words - 1
    sizes = np.array([len(t) for t in texts])
    firsts = np.cumsum(sizes) - sizes
    joined = b"".join(texts)
    data = np.frombuffer(joined, dtype=np.uint8)
    order, common = suffix_array(data, np.repeat(firsts + sizes, sizes), length)
    longest = np.zeros(len(data), np.int64)
    longest[order] = np.maximum(np.append(common, 0), np.concatenate(([0], common)))
    inside, places = _inside(joined), np.arange(len(data) + 1)
    begins = inside & ~np.concatenate(([False], inside[:-1]))
    begins[firsts] = inside[firsts]
    before = np.concatenate(([0], np.cumsum(begins)))
    whole = np.append((data & 0xC0) != 0x80, True)  # where a character may end
    a = np.flatnonzero((longest >= length) & inside & whole[:-1])
    b = np.maximum.accumulate(np.where(whole, places, 0))[a + longest[a]]
    b = np.maximum.accumulate(np.where(np.concatenate(([False], inside)), places, 0))[b]
    enough = before[b] - before[a + 1] + 1 >= words
    a, b = a[enough], b[enough]
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    if not len(a):
        return spans
    of = np.searchsorted(firsts, a, side="right") - 1
    reach = np.maximum.accumulate(b)
    cut = np.flatnonzero((a[1:] > reach[:-1]) | (of[1:] != of[:-1])) + 1
    head, tail = np.concatenate(([0], cut)), np.append(cut, len(a)) - 1
    for k, x, y in zip(of[head].tolist(), (a - firsts[of])[head].tolist(), (reach - firsts[of])[tail].tolist(), strict=True):
        spans[k].append((x, y))
    return spans


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges in order without overlaps; those that touch are joined."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _ranges(mh, sh, rows) -> pa.RecordBatch:
    flat = [(m, s, a, b) for m, s, spans in zip(mh, sh, rows, strict=True) for a, b in spans]
    columns = list(zip(*flat, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["mh", "sh", "a", "b"])


def _by_suffix_arrays(parts: DataFrame, length: int, listed: bool = False, words: int = 0) -> DataFrame:
    """mh, sh, a, b: the repeated ranges of segments, a unit of whole buckets at a time; or, listed, the maximal repeats themselves."""

    def run(batches):
        held, size, last = [], 0, None
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("mh", "sh", "n", "raw")), strict=True):
                if size >= UNIT and r[0] != last:
                    yield unit(held)
                    held, size = [], 0
                    give_back()
                last = r[0]
                held.append(r)
                size += len(r[3])
        if held:
            yield unit(held)
        held = []
        give_back()

    def unit(held):
        held = list({(r[0], r[1]): r for r in held}.values())
        mh, sh, n, raw = zip(*held, strict=True)
        if not listed:
            return _ranges(mh, sh, _covered_words(list(raw), words) if words else _covered(list(raw), list(n), length))
        rows = [(mh[t], sh[t], f"r{k}", size, at) for k, (size, places) in enumerate(maximal_repeats(list(raw), list(n), length)) for t, at in places]
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32())
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["mh", "sh", "g", "size", "a"])

    schema = "mh long, sh long, g string, size int, a int" if listed else "mh long, sh long, a int, b int"
    return parts.repartition("mh").sortWithinPartitions("mh").mapInArrow(run, schema)


def _by_hashes(parts: DataFrame, length: int) -> DataFrame:
    """mh, wh, sh, w: for buckets of very many segments the windows that are met again."""

    def run(batches):
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            for m, s, n, raw in zip(*(batch.column(c).to_pylist() for c in ("mh", "sh", "n", "raw")), strict=True):
                view = memoryview(raw)
                wh = np.array([digest(view[w : w + length]) for w in range(n)], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([m] * n, pa.int64()), pa.array([s] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(wh, pa.int64())], names=["mh", "sh", "w", "wh"])

    hashed = staged(parts.dropDuplicates(["mh", "sh"]).mapInArrow(run, "mh long, sh long, w int, wh long"), "windows")
    again = staged(hashed.groupBy("mh", "wh").agg(F.count("*").alias("c")).where("c > 1").drop("c"), "again")
    return hashed.join(again.hint("merge"), ["mh", "wh"])


def _steps(data: bytes, a: int, b: int) -> list[int]:
    """Where the characters of data[a:b] begin, and b."""
    return [x for x in range(a, b) if data[x] & 0xC0 != 0x80] + [b]


def _core_windows(data: bytes, words: int) -> list[tuple[int, int, int, int]]:
    """Number, range and hash of each window of so many words, from the last character of its first to the first of its last."""
    starts, ends = (x.tolist() for x in word_places(data))
    out = []
    for k in range(len(starts) - words + 1):
        a, b = _steps(data, starts[k], ends[k])[-2], _steps(data, starts[k + words - 1], ends[k + words - 1])[1]
        out.append((k, a, b, xxhash.xxh3_64_intdigest(data[a:b])))
    return out


def _extensions(data: bytes, words: int, wanted: list[dict]) -> list[tuple[int, int, int]]:
    """Range and hash of each longer form of the wanted windows: to the left into the first word, or to the right into the last."""
    starts, ends = (x.tolist() for x in word_places(data))
    out = []
    for w in wanted:
        first, last = (_steps(data, starts[k], ends[k]) for k in (w["k"], w["k"] + words - 1))
        a, b = first[-2], last[1]
        h = xxhash.xxh3_64(data[a:b])
        if w["right"]:
            h.update(b"right")
            edges = [(a, y, x) for x, y in zip(last[1:], last[2:], strict=False)]
        else:
            edges = [(x, b, x) for x in first[-3::-1]]
        at = a
        for x, y, new in edges:
            h.update(data[new:y] if w["right"] else data[new:at])
            at = new
            out.append((x, y, h.intdigest()))
    return out


def _by_word_hashes(parts: DataFrame, words: int) -> DataFrame:
    """mh, sh, a, b: for buckets of very many segments the windows of words that are met again, as far as they go.

    Windows are compared from the last character of the first word to the first
    of the last. Neighbours that are met again make a run; only at its ends can
    a repeat go on within a word unseen, so only windows that stand at the end
    of a run anywhere are compared by their longer forms.
    """
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}

    def table(columns: dict[str, str], rows: list[tuple]) -> pa.RecordBatch:
        cells = list(zip(*rows, strict=True)) or [[]] * len(columns)
        return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, k in zip(cells, columns.values(), strict=True)], names=list(columns))

    def schema(columns):
        return ", ".join(f"{c} {k}" for c, k in columns.items())

    def signed(h: int) -> int:
        return h - (1 << 64) if h >> 63 else h

    core = {"mh": "long", "sh": "long", "k": "int", "a": "int", "b": "int", "wh": "long"}
    run = {"mh": "long", "sh": "long", "a": "int", "b": "int", "first": "long", "last": "long"}
    form = {"mh": "long", "sh": "long", "a": "int", "b": "int", "wh": "long"}

    def windows(batches):
        for batch in batches:
            for m, s, raw in zip(*(batch.column(c).to_pylist() for c in ("mh", "sh", "raw")), strict=True):
                yield table(core, [(m, s, k, a, b, signed(h)) for k, a, b, h in _core_windows(raw, words)])

    def runs(batches):
        for batch in batches:
            rows = []
            for m, s, found in zip(*(batch.column(c).to_pylist() for c in ("mh", "sh", "found")), strict=True):
                found = sorted(found, key=lambda x: x["k"])
                cuts = [0, *(n for n in range(1, len(found)) if found[n]["k"] != found[n - 1]["k"] + 1), len(found)]
                for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                    rows.append((m, s, found[x]["a"], found[y - 1]["b"], found[x]["wh"], found[y - 1]["wh"]))
            yield table(run, rows)

    def forms(batches):
        for batch in batches:
            for m, s, raw, wanted in zip(*(batch.column(c).to_pylist() for c in ("mh", "sh", "raw", "wanted")), strict=True):
                yield table(form, [(m, s, a, b, signed(h)) for a, b, h in _extensions(raw, words, wanted)])

    def again(rows):
        met = rows.groupBy("mh", "wh").agg(F.count("*").alias("c")).where("c > 1").drop("c")
        return rows.join(met.hint("merge"), ["mh", "wh"])

    parts = parts.dropDuplicates(["mh", "sh"])
    met = staged(again(staged(parts.mapInArrow(windows, schema(core)), "windows")), "met")
    inside = staged(met.groupBy("mh", "sh").agg(F.collect_list(F.struct("k", "a", "b", "wh")).alias("found")).mapInArrow(runs, schema(run)), "runs")
    ends = [inside.select("mh", F.col(c).alias("wh"), F.lit(right).alias("right")) for c, right in (("first", False), ("last", True))]
    open_at = met.join(ends[0].unionByName(ends[1]).distinct().hint("merge"), ["mh", "wh"])
    asked = open_at.groupBy("mh", "sh").agg(F.collect_list(F.struct("k", "right")).alias("wanted"))
    longer = staged(parts.join(asked.hint("merge"), ["mh", "sh"]).select("mh", "sh", "raw", "wanted").mapInArrow(forms, schema(form)), "forms")
    return inside.select("mh", "sh", "a", "b").unionByName(again(longer).select("mh", "sh", "a", "b"))


def _merged(ranges: DataFrame) -> DataFrame:
    """mh, sh, found: one row a segment with its ranges (a, b) in order, without overlaps; a segment has few, as it is short."""

    def run(batches):
        for batch in batches:
            spans = [[{"a": a, "b": b} for a, b in merge([(x["a"], x["b"]) for x in found])] for found in batch.column("found").to_pylist()]
            yield batch.set_column(2, batch.schema.field(2), pa.array(spans, batch.schema.field(2).type))

    listed = ranges.groupBy("mh", "sh").agg(F.collect_list(F.struct("a", "b")).alias("found"))
    return listed.mapInArrow(run, "mh long, sh long, found array<struct<a: int, b: int>>")


def _keyed(docs: DataFrame) -> DataFrame:
    return documents(docs).withColumn("th", F.xxhash64("text"))


def _same(left: DataFrame, right: DataFrame):
    return left["doc_id"].eqNullSafe(right["r_id"]) & (left["th"] == right["r_th"])


def _prepared(docs: DataFrame, length: int, hot: int, words: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Segments whose gram is met again (live), the different ones among them (kinds), and the texts to compare (parts)."""
    keyed = _keyed(docs)
    runs = staged(segments(keyed, length, min(GRAM, length), words), "segments")
    met = staged(runs.groupBy("mh").agg(F.count("*").alias("c")).where("c > 1").drop("c"), "grams")
    live = staged(runs.join(met.hint("merge"), "mh"), "live")
    unstage(runs, met)
    kinds = staged(live.groupBy("mh", "sh").agg(F.count("*").alias("c"), F.min(F.struct("doc_id", "th", "s", "n")).alias("rep")), "kinds")
    mixed = staged(kinds.groupBy("mh").agg(F.count("*").alias("nd")).where("nd > 1"), "mixed")
    wanted = kinds.join(mixed.hint("merge"), "mh").select(F.col("rep.doc_id").alias("r_id"), F.col("rep.th").alias("r_th"), F.struct("rep.s", "rep.n", "mh", "sh", (F.col("nd") > hot).alias("hot")).alias("w"))
    wanted = staged(wanted.groupBy("r_id", "r_th").agg(F.collect_list("w").alias("w")), "wanted")

    def cut(batches):
        for batch in batches:
            for text, want in zip(batch.column("text").cast(pa.large_binary()), batch.column("w").to_pylist(), strict=True):
                data = text.as_py()
                raw = [data[w["s"] : w["s"] + w["n"] + length - 1] for w in want]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([w["mh"] for w in want], pa.int64()), pa.array([w["sh"] for w in want], pa.int64()), pa.array([w["n"] for w in want], pa.int32()), pa.array(raw, pa.binary()), pa.array([w["hot"] for w in want])],
                    names=["mh", "sh", "n", "raw", "hot"],
                )

    fetched = keyed.join(wanted.hint("merge"), _same(keyed, wanted)).select("text", "w")
    parts = staged(fetched.mapInArrow(cut, "mh long, sh long, n int, raw binary, hot boolean"), "parts")
    unstage(mixed, wanted)
    return live, kinds, parts


def repeated_spans(docs: DataFrame, length: int = 400, hot: int = HOT) -> DataFrame:
    """doc_id, th (hash of the text) and spans (array of a, b; may overlap) of the documents that repeat something."""
    return _spans(docs, length, hot)


def repeated_passages(docs: DataFrame, words: int = 51, hot: int = HOT) -> DataFrame:
    """doc_id, th and spans as of repeated_spans, of the strings of `words` words (3 at least) or more that repeat."""
    return _spans(docs, 2 * words - 1, hot, words)  # fewer bytes do not hold so many words


def _spans(docs: DataFrame, length: int, hot: int, words: int = 0) -> DataFrame:
    live, kinds, parts = _prepared(docs, length, hot, words)
    whole = kinds.where("c > 1").select("mh", "sh", F.lit(0).alias("a"), (F.col("rep.n") + (length - 1)).alias("b"))
    if words:
        by_hash = _by_word_hashes(parts.where("hot"), words)
    else:
        by_hash = _by_hashes(parts.where("hot"), length).select("mh", "sh", F.col("w").alias("a"), (F.col("w") + length).alias("b"))
    found = whole.unionByName(_by_suffix_arrays(parts.where("not hot"), length, words=words)).unionByName(by_hash)
    ranges = staged(_merged(found), "ranges")
    unstage(parts, kinds)
    moved = F.transform("found", lambda x: F.struct((F.col("s") + x["a"]).alias("a"), (F.col("s") + x["b"]).alias("b")))
    spans = live.join(ranges.hint("merge"), ["mh", "sh"]).select("doc_id", "th", moved.alias("own"))  # a row a segment, however many ranges it has
    out = staged(spans.groupBy("doc_id", "th").agg(F.flatten(F.collect_list("own")).alias("spans")), "spans")
    unstage(live, ranges)
    return out


def repeat_groups(docs: DataFrame, length: int = 400, hot: int = HOT) -> DataFrame:
    """Maximal repeats with all their occurrences, a row each: mh and g (together the group), size, doc_id, offset.

    A repeat longer than a segment comes in overlapping groups, one a segment.
    Segments met again whole are listed by their text hash, and in buckets of
    more than `hot` segments the groups are windows of `length` bytes: there no
    maximal repeats are looked for.
    """
    live, kinds, parts = _prepared(docs, length, hot)
    whole = kinds.where("c > 1").select("mh", "sh", F.concat(F.lit("s"), F.hex("sh")).alias("g"), (F.col("rep.n") + (length - 1)).alias("size"), F.lit(0).alias("a"))
    by_hash = _by_hashes(parts.where("hot"), length).select("mh", "sh", F.concat(F.lit("w"), F.hex("wh")).alias("g"), F.lit(length).alias("size"), F.col("w").alias("a"))
    found = staged(whole.unionByName(_by_suffix_arrays(parts.where("not hot"), length, listed=True)).unionByName(by_hash), "groups")
    unstage(parts, kinds)
    return live.join(found.hint("merge"), ["mh", "sh"]).select("mh", "g", "size", "doc_id", (F.col("s") + F.col("a")).alias("offset"))


def _cut(data: bytes, spans: list[dict] | None) -> tuple[bytes, int, int]:
    """What stays of a text, the bytes removed, the runs removed."""
    merged = merge([(s["a"], s["b"]) for s in spans or ()])
    at, kept = 0, []
    for a, b in merged:
        kept.append(data[at:a])
        at = b
    kept.append(data[at:])
    out = b"".join(kept)
    return out, len(data) - len(out), len(merged)


def digest(docs: DataFrame, length: int = 400) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    spans = repeated_spans(docs, length).withColumnsRenamed({"doc_id": "r_id", "th": "r_th"})
    keyed = _keyed(docs)

    def run(batches):
        for batch in batches:
            rows = []
            for doc, text, found in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.large_binary()), batch.column("spans").to_pylist(), strict=True):
                data = text.as_py()
                kept, removed, n = _cut(data, found)
                rows.append((doc, len(data), removed, n, hashlib.sha256(kept).hexdigest()))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    joined = keyed.join(spans.hint("merge"), _same(keyed, spans), "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, length: int = 400) -> DataFrame:
    """docs, all columns, with the repeated bytes removed from text (halves of characters at a cut are dropped) and n_chars set anew where there is one."""
    return _without(docs, repeated_spans(docs, length))


def remove_passages(docs: DataFrame, words: int = 51) -> DataFrame:
    """docs, all columns, with the strings of `words` words or more that repeat removed from text, and n_chars set anew where there is one."""
    return _without(docs, repeated_passages(docs, words))


def _without(docs: DataFrame, spans: DataFrame) -> DataFrame:
    spans = spans.withColumnsRenamed({"doc_id": "__r_id", "th": "__r_th", "spans": "__spans"})
    on = docs["doc_id"].cast("long").eqNullSafe(spans["__r_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == spans["__r_th"])
    joined = docs.join(spans.hint("merge"), on, "left").drop("__r_id", "__r_th")
    schema = joined.schema

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = [
                None if t is None else _cut(t.encode(), s)[0].decode("utf-8", "ignore") if s else t
                for t, s in zip(batch.column("text").to_pylist(), batch.column("__spans").to_pylist(), strict=True)
            ]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    out = joined.mapInArrow(run, schema).drop("__spans")
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
