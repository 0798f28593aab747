"""Packing of documents into training sequences by multiway number partitioning.

A document's ids, with its end id, are cut into full windows from the front;
the rest, shorter than a window, is a piece to be packed. Each task takes the
pieces of its split in blocks of about `block_windows` windows and spreads a
block over k = ceil(tokens / capacity) windows by Karmarkar-Karp multiway
differencing: partial partitions are merged largest with smallest sum, so that
opposing imbalances cancel. Where the fullest window exceeds the capacity, k
rises by one and the block is spread anew. As windows are near equal, the room
left in each is small; the emptiest window is then cut up to fill the others
to the brim, and what remains of it is cut into powers of two, which are
lengths that need no padding. No sequence is padded in the end.

Nothing is shuffled: sequences are numbered by the split that made them, and a
retried task makes the same sequences. Memory is bounded by a block.

Defined cases: a null or empty text is its end id alone; a null doc_id stays
null; repeated rows are packed each on its own; an empty table gives no row;
other columns are ignored; a very long text gives many full windows.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import documents
from .tokenizing import encoder

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Spread items over k windows by Karmarkar-Karp multiway differencing; returns the items of each window.

    A partial partition is its non-empty windows as (sum, node), largest
    first; a node is an item or a pair of nodes. The two with the widest
    spread are merged first, the fullest window of one with the emptiest of
    the other.
    """
    if not sizes:
        return [[] for _ in range(k)]
    left, right = [-1] * len(sizes), [-1] * len(sizes)

    def join(x: int, y: int) -> int:
        left.append(x)
        right.append(y)
        return len(left) - 1

    heap = [(-s, i, [(s, i)]) for i, s in enumerate(sizes)] if k > 1 else [(0, i, [(s, i)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    count = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        over = len(a) + len(b) - k
        if over <= 0:
            merged = a + b
        else:  # the windows that meet: the emptiest of a with the emptiest of b, crosswise
            low_a, low_b = a[len(a) - over :], b[len(b) - over :]
            met = [(x + y, join(m, n)) for (x, m), (y, n) in zip(low_a, reversed(low_b), strict=True)]
            merged = a[: len(a) - over] + b[: len(b) - over] + met
        merged.sort(reverse=True)
        spread = merged[0][0] - (merged[-1][0] if len(merged) == k else 0)
        heapq.heappush(heap, (-spread, count, merged))
        count += 1
    out: list[list[int]] = []
    for _, node in heap[0][2]:
        items, stack = [], [node]
        while stack:
            x = stack.pop()
            if left[x] < 0:
                items.append(x)
            else:
                stack += (left[x], right[x])
        out.append(items)
    return out + [[] for _ in range(k - len(out))]


def near_equal(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of at most `capacity` with near-equal sums; their count rises until all fit."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        windows = difference(sizes, k)
        if max(sum(sizes[i] for i in w) for w in windows) <= capacity:
            return windows
        k += 1


def fill(sizes: list[int], windows: list[list[int]], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of cuts (item, start, length): windows filled from those dissolved, the rest in powers of two."""
    load = [sum(sizes[i] for i in w) for w in windows]
    order = sorted(range(len(windows)), key=lambda w: (-load[w], w))
    total = sum(load)
    full = total // capacity
    out = [[(i, 0, sizes[i]) for i in windows[w]] for w in order[:full]]
    room = [capacity - load[w] for w in order[:full]]
    loose = [(i, 0, sizes[i]) for w in order[full:] for i in windows[w]]
    rest = total - full * capacity
    powers = [1 << bit for bit in reversed(range(rest.bit_length())) if rest >> bit & 1]
    for target, free in [*zip(out, room, strict=True), *(([], p) for p in powers)]:
        if len(target) == 0:
            out.append(target)
        while free:
            i, start, n = loose.pop()
            take = min(n, free)
            target.append((i, start, take))
            if take < n:
                loose.append((i, start + take, n - take))
            free -= take
    return out


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 2048, block_windows: int = 256) -> DataFrame:
    """Pieces of documents with the sequence and offset they go to (SCHEMA)."""

    def run(batches):
        enc, base = encoder(tokenizer), TaskContext.get().partitionId() << 40
        made, pending, held = 0, [], 0  # pending: (doc_id, start, doc_tokens, ids)

        def emit(rows):
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[x.split()[0] for x in SCHEMA.split(", ")])

        def spread():
            nonlocal made
            sizes = [len(p[3]) // 4 for p in pending]
            rows = []
            for cuts in fill(sizes, near_equal(sizes, capacity), capacity):
                at = 0
                for i, start, n in cuts:
                    doc, first, tokens, raw = pending[i]
                    rows.append((doc, first + start, n, zlib.crc32(raw[4 * start : 4 * (start + n)]), tokens, base + made, at))
                    at += n
                made += 1
            return emit(rows)

        for batch in batches:
            for row, n in enc.slices(batch.column("text")):
                part = batch.slice(row, n)
                ids, offsets = enc.encode(part.column("text"))
                rows = []
                end = np.array([end_id], dtype="<u4").tobytes()
                raw, bounds = ids.astype("<u4").tobytes(), (4 * offsets).tolist()
                for d, doc in enumerate(part.column("doc_id").to_pylist()):
                    whole = raw[bounds[d] : bounds[d + 1]] + end
                    tokens = len(whole) // 4
                    cut = tokens // capacity * capacity
                    for start in range(0, cut, capacity):
                        rows.append((doc, start, capacity, zlib.crc32(whole[4 * start : 4 * (start + capacity)]), tokens, base + made, 0))
                        made += 1
                    if cut < tokens:
                        pending.append((doc, cut, tokens, whole[4 * cut :]))
                        held += tokens - cut
                    if held >= block_windows * capacity:
                        yield spread()
                        pending, held = [], 0
                if rows:
                    yield emit(rows)
        if pending:
            yield spread()

    return documents(docs).mapInArrow(run, SCHEMA)
