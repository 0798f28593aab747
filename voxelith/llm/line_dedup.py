"""Fuzzy line dedup: SimHash of normalised lines, pigeonhole blocks, edit similarity, one occurrence a group.

A line is normalised to lower-case words with single blanks. Its words are
dealt by hash into classes, more for longer lines (LADDER), and its fingerprint
has a block for each class: the SimHash, the signs of the sums of BITS hash
bits, of the different words of that class, with their number. Added up, the classes give the SimHash of the
whole line. A changed word touches at most two classes, that of the old and
that of the new word, so lines with few changes have an untouched class and
agree on its block: the pigeonhole. Classes grow in number with the line, five
words each, so that this holds at every length; of many, USED have blocks. Two lines are linked if they agree on a
block, their whole SimHashes differ in at most DISTANCE bits, and their edit
similarity, 1 - distance / longer length, is at least the threshold. Lines
equal after normalisation are one line. Of each connected group of linked lines
the first occurrence stays (smallest doc_id, then line number), all others go.

1. Lines get a 128-bit digest and their blocks; texts do not move. A line has
   blocks for its own length and for the lengths of longer lines that may still
   be similar; the longer line of a pair decides which blocks count.
2. Blocks travel packed in bytes, a part of all blocks at a time: first as block
   and line digest, reduced to the lowest and highest line wherever they meet, which
   finds the blocks that different lines have; then as block and line, to pick the
   lines of those blocks out as a stream. So a hot block costs no task memory.
3. Blocks of over UNIT lines are dealt into parts, which are units; a pair of lines
   belongs to the smallest block that they share. Lines with a near line in a unit
   fetch their text, once; units verify pairs, many units' at a time, the nearest first, skip
   those that are connected already, and put out spanning forests, never pairs.
4. Forests are joined to connected groups. Of large blocks that still hold lines of
   different groups, each pair of parts is then a unit as well; as parts differ from
   block to block, groups of many near lines are mostly whole by then.

Defined cases: empty lines always stay and count in n_lines; a null or empty
text is one empty line; repeated rows (same doc_id, same text) are one document
and are cut alike; a null doc_id comes first; very long lines are compared
whole; lines of fewer than WORDS words, or of words of over WIDE characters in
the mean (scripts without blanks), have pairs of characters for words; an empty
table gives no row; other columns are ignored by `digest` and kept by
`keep_first`.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, mix64, setting, staged, unstage, words_of
from .components import components
from .tokenizing import WordEncoder

#: From so many characters on, so many classes; from the last on, steps of 1.25 and a class for each LONG characters (about five words).
LADDER = ((0, 3), (64, 4), (112, 6), (192, 8), (384, 12))
#: Of the many classes of a long line, the first USED have blocks, if they hold FEW words at least: of 16 classes of five words, all
#: are touched by a tenth of the words changed with a chance of 1 in 1000, and by a fifth, the most that 0.8 admits, of 1 in 10.
LONG, USED, FEW = 32, 16, 2
BITS, DISTANCE, UNIT, WORDS, WIDE = 48, 12, 512, 4, 16
#: The four bits of a number spread to the four 16-bit parts of 64 bits, so that four bits are counted in one sum.
_LANES = np.array([sum((x >> b & 1) << 16 * b for b in range(4)) for x in range(16)], dtype=np.uint64)
#: Likewise the eight bits of a number spread to bytes, for classes of up to 127 words; and what takes each byte's lowest bit together.
_BYTES = np.array([sum((x >> b & 1) << 8 * b for b in range(8)) for x in range(256)], dtype=np.uint64)
_LOWEST, _TOGETHER = np.uint64(0x0101010101010101), np.uint64(0x0102040810204080)
#: Blocks held at once while they are dealt; blocks a part should hold; streams of a part.
_HELD, _PART, _STREAMS = 1 << 20, 1 << 20, 4
#: Pairs of lines compared at once, and their characters; characters of the units that ask for pairs together.
GATHERED, _MASKS, _ASKING = 2048, 1 << 20, 1 << 25
#: Lines and characters of a block of the exact comparison.
BLOCK, _CHARACTERS = 512, 1 << 22
_BLANKS = r"[\s\p{Z}]+"
_UNEVEN = r"^ | $|  |[\t\r\f\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


class _Slices:
    slice_bytes = 1 << 22


def normalize(lines: pa.Array) -> pa.Array:
    """Lower-case, white space to single blanks, none at the ends."""
    lower = pc.utf8_lower(lines)
    uneven = pc.match_substring_regex(lower, _UNEVEN)
    if not pc.any(uneven).as_py():
        return lower
    even = pc.utf8_trim(pc.replace_substring_regex(lower.filter(uneven), _BLANKS, " "), characters=" ")
    return pc.replace_with_mask(lower, uneven, even)


def _features(lines: pa.Array, sizes: np.ndarray) -> pa.Array:
    """Lines as words between blanks; pairs of characters take the words' place where there are few words or very long ones."""
    n = pc.count_substring(lines, " ").to_numpy(zero_copy_only=False) + 1
    odd = (n < WORDS) | (sizes > WIDE * n)
    if not odd.any():
        return lines
    pairs = []
    for x in lines.filter(pa.array(odd)).to_pylist():
        x = x.replace(" ", "")
        pairs.append(" ".join(x[k : k + 2] for k in range(max(1, len(x) - 1))))
    return pc.replace_with_mask(lines, pa.array(odd), pa.array(pairs, lines.type))


def _word_hashes(words: pa.LargeStringArray) -> np.ndarray:
    """A 64-bit hash of each word, from its bytes and their places."""
    ends = np.frombuffer(words.buffers()[1], dtype=np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2] or b"", dtype=np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    n = np.diff(ends)
    power = np.cumprod(np.full(int(n.max(initial=0)) + 1, 0x9E3779B97F4A7C15, dtype=np.uint64))
    place = np.arange(len(data)) - np.repeat(ends[:-1], n)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(np.arange(1, 257, dtype=np.uint64))[data] * power[place])))
    return mix64(total[ends[1:]] - total[ends[:-1]])


def _signs(sums: list[np.ndarray], counts: np.ndarray) -> np.ndarray:
    """Which hash bits most of the summed words have."""
    out, counts = np.zeros(len(counts), np.uint64), counts.astype(np.uint64)
    for k, x in enumerate(sums):
        for b in range(4):
            out |= (2 * (x >> np.uint64(16 * b) & np.uint64(0xFFFF)) > counts).astype(np.uint64) << np.uint64(4 * k + b)
    return out


def _byte_signs(sums: list[np.ndarray], counts: np.ndarray) -> np.ndarray:
    """_signs of sums in bytes: twice the sum is above the count where the highest bit of 2 sum + 127 - count is set."""
    out, lift = np.zeros(len(counts), np.uint64), (127 - counts).astype(np.uint64) * _LOWEST
    for k, x in enumerate(sums):
        out |= (((x << np.uint64(1)) + lift >> np.uint64(7) & _LOWEST) * _TOGETHER >> np.uint64(56)) << np.uint64(8 * k)
    return out


def ladder(longest: float) -> list[tuple[int, int]]:
    """LADDER and its steps beyond, up to lines of the given length."""
    out = list(LADDER)
    while out[-1][0] <= longest:
        start = int(out[-1][0] * 1.25)
        out.append((start, start // LONG))
    return out


def _whole(h: np.ndarray) -> np.uint64:
    """The SimHash of a line of any number of different words."""
    ones = [np.count_nonzero(h >> np.uint64(b) & np.uint64(1)) for b in range(BITS)]
    return np.uint64(sum(1 << b for b, n in enumerate(ones) if 2 * n > len(h)))


def fingerprints(lines: pa.Array, threshold: float) -> tuple[np.ndarray, pa.ListArray]:
    """The SimHash of each normalised, non-empty line, and its blocks: of each class its number, count of words and SimHash, in 64 bits."""
    sizes = pc.utf8_length(lines).to_numpy(zero_copy_only=False)
    words, codes, offsets = words_of(_features(lines, sizes))
    h = _word_hashes(words)
    lanes = [_LANES[(h >> np.uint64(k) & np.uint64(15)).astype(np.intp)] for k in range(0, BITS, 4)]
    octets = [_BYTES[(h >> np.uint64(k) & np.uint64(255)).astype(np.intp)] for k in range(0, BITS, 8)]
    high = (h >> np.uint64(BITS)).astype(np.int64)
    levels = ladder(float(sizes.max(initial=0)) / threshold)
    steps = [a for a, _ in levels]
    own, far = (np.searchsorted(steps, x, side="right") - 1 for x in (sizes, np.floor(sizes / threshold + 1e-9)))
    sims, owners, blocks = np.zeros(len(lines), np.uint64), [], []
    for level, (_, classes) in enumerate(levels):
        use = np.flatnonzero((own <= level) & (level <= far))
        if not len(use):
            continue
        n = offsets[use + 1] - offsets[use]
        picked = codes[np.repeat(offsets[use] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        pairs = (np.repeat(np.arange(len(use)) * classes, n) + (high % classes)[picked]) * len(words) + picked
        pairs.sort()
        pairs = pairs[np.append(True, pairs[1:] != pairs[:-1])]  # a word counts once in a line, else the commonest decide
        slot, picked = np.divmod(pairs, len(words))
        first = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
        slot, counts = slot[first], np.diff(np.append(first, len(slot)))
        few = counts.max() <= 127
        sums = [np.add.reduceat(lane[picked], first) for lane in (octets if few else lanes)]
        shown = np.flatnonzero((slot % classes < USED) & ((counts >= FEW) | (level < len(LADDER))))
        signs = (_byte_signs if few else _signs)([x[shown] for x in sums], counts[shown])
        blocks.append(mix64(signs | counts[shown].astype(np.uint64) << np.uint64(BITS)) + mix64((level << 32 | slot[shown] % classes).astype(np.uint64)))
        owners.append(use[slot[shown] // classes])
        if not (own[use] == level).any():
            continue
        line = np.flatnonzero(np.append(True, slot[1:] // classes != slot[:-1] // classes))
        total = np.add.reduceat(counts, line)
        if few:  # bytes to 16 bits, every other bit in a sum
            whole = np.zeros(len(line), np.uint64)
            for k, x in enumerate(sums):
                for odd in (0, 1):
                    signs = np.add.reduceat(x >> np.uint64(8 * odd) & np.uint64(0x00FF00FF00FF00FF), line)
                    for b in range(4):
                        whole |= (2 * (signs >> np.uint64(16 * b) & np.uint64(0xFFFF)) > total.astype(np.uint64)).astype(np.uint64) << np.uint64(8 * k + 2 * b + odd)
        else:
            whole = _signs([np.add.reduceat(x, line) for x in sums], total)
        ends = np.append(first[line[1:]], len(picked))
        for k in np.flatnonzero(total > 0xFFFF):  # more words than the sums of 16 bits hold
            whole[k] = _whole(h[picked[first[line[k]] : ends[k]]])
        mine = own[use] == level
        sims[use[mine]] = whole[mine]
    owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
    order = np.argsort(owner, kind="stable")
    bounds = np.searchsorted(owner[order], np.arange(len(lines) + 1))
    every = np.concatenate(blocks)[order] if blocks else np.zeros(0, np.uint64)
    return sims.view(np.int64), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(every.view(np.int64)))


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All lines of the texts, each one's text and its number in it."""
    lists = pc.split_pattern(texts.cast(pa.large_string()), "\n")
    n = np.diff(lists.offsets.to_numpy())
    owner = np.repeat(np.arange(len(texts)), n)
    return lists.flatten(), owner, np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)


def lines(keyed: DataFrame, threshold: float, packed: bool = False) -> DataFrame:
    """doc_id, th, line, l1, l2 (digest of the normalised line), sim, size (characters), blocks of each non-empty line; packed: blocks as bytes."""

    def run(batches):
        for batch in batches:
            for at, count in WordEncoder.slices(_Slices, batch.column("text")):
                part = batch.slice(at, count)
                raw, owner, number = _split(part.column("text"))
                norm = normalize(raw)
                use = np.flatnonzero(pc.greater(pc.binary_length(norm), 0).to_numpy(zero_copy_only=False))
                if not len(use):
                    continue
                coded = norm.take(pa.array(use)).dictionary_encode()
                norm, code = coded.dictionary, coded.indices.to_numpy()
                digest = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, norm.to_pylist())), dtype=np.int64).reshape(-1, 2)[code]
                sims, blocks = fingerprints(norm, threshold)
                if packed:
                    blocks = pa.Array.from_buffers(pa.binary(), len(blocks), [None, pa.array(blocks.offsets.to_numpy() * 8, pa.int32()).buffers()[1], blocks.values.buffers()[1]])
                pick = pa.array(owner[use])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(pick),
                        part.column("th").take(pick),
                        pa.array(number[use], pa.int32()),
                        pa.array(digest[:, 0]),
                        pa.array(digest[:, 1]),
                        pa.array(sims[code]),
                        pc.utf8_length(norm).cast(pa.int32()).take(coded.indices),
                        blocks.take(coded.indices),
                    ],
                    names=["doc_id", "th", "line", "l1", "l2", "sim", "size", "blocks"],
                )

    return keyed.mapInArrow(run, f"doc_id long, th long, line int, l1 long, l2 long, sim long, size int, blocks {'binary' if packed else 'array<long>'}")


def _counts(blocks: pa.Array) -> np.ndarray:
    """How many blocks each line has, in lists or packed."""
    packed = pa.types.is_binary(blocks.type)
    n = (pc.binary_length if packed else pc.list_value_length)(blocks).to_numpy(zero_copy_only=False)
    return n // 8 if packed else n


def _held(batches):
    """Block and l1 of the lines of the batches, a line once, about _HELD blocks at a time."""
    kept, size = [], 0
    for batch in batches:
        kept.append(batch)
        size += int(np.sum(_counts(batch.column("blocks"))))
        if size >= _HELD:
            yield _expanded(kept)
            kept, size = [], 0
    if size:
        yield _expanded(kept)


def _expanded(batches) -> tuple[np.ndarray, np.ndarray]:
    table = pa.Table.from_batches(batches).combine_chunks()
    l1, l2 = (table.column(c).to_numpy() for c in ("l1", "l2"))
    order = np.lexsort((l2, l1))
    new = np.append(True, (np.diff(l1[order]) != 0) | (np.diff(l2[order]) != 0))
    use = order[new]
    lists = pc.take(table.column("blocks"), pa.array(use)).combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    h = np.frombuffer(b"".join(lists.to_pylist()), dtype=np.int64) if pa.types.is_binary(lists.type) else lists.flatten().to_numpy()
    return h, np.repeat(l1[use], _counts(lists))


def _ends(h: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each block once, with the lowest and the highest line."""
    order = np.argsort(h, kind="stable")
    first = np.flatnonzero(np.append(True, np.diff(h[order]) != 0)) if len(h) else np.zeros(0, np.int64)
    return h[order][first], *((f.reduceat(x[order], first) if len(h) else x) for f, x in ((np.minimum, low), (np.maximum, high)))


def _dealt(to: np.ndarray, rows: np.ndarray, kind: int) -> pa.RecordBatch:
    """Rows packed in bytes, one value for each number in `to`."""
    order = np.argsort(to, kind="stable")
    to, rows = to[order], np.ascontiguousarray(rows[order])
    first = np.flatnonzero(np.append(True, np.diff(to) != 0)) if len(to) else np.zeros(0, np.int64)
    packed = [x.tobytes() for x in np.split(rows, first[1:])] if len(to) else []
    return pa.RecordBatch.from_arrays([pa.array(to[first], pa.int64()), pa.array([kind] * len(first), pa.int32()), pa.array(packed, pa.binary())], names=["to", "kind", "data"])


def shared_blocks(found: DataFrame) -> DataFrame:
    """h, l1: the lines of every block that different lines have; a line may come several times.

    Half of the digest goes along: lines that agree on it would get each other's blocks as well, which only adds pairs to compare.
    """
    spark = found.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(tasks, found.count() * 10 // _PART + 1)  # so that a task's part of the blocks stays as large however many lines there are
    entries = found.select("l1", "l2", "blocks")
    schema = "to long, kind int, data binary"

    def part_of(h):
        return (mix64(h.view(np.uint64)) % np.uint64(parts)).astype(np.int64)

    def ends(batches):
        for h, l1 in _held(batches):
            h, low, high = _ends(h, l1, l1)
            several = low != high
            h, l1 = np.concatenate((h, h[several])), np.concatenate((low, high[several]))
            yield _dealt(part_of(h), np.stack((h, l1), axis=1), 0)

    def repeated(batches):
        held, last = [], None
        for batch in batches:
            for to, data in zip(batch.column("to").to_pylist(), batch.column("data").to_pylist(), strict=True):
                if to != last and held:
                    yield keys(last, held)
                    held = []
                last = to
                held.append(np.frombuffer(data, dtype=np.int64).reshape(-1, 2))
        if held:
            yield keys(last, held)

    def keys(to, held):
        h, l1 = np.concatenate(held).T
        h, low, high = _ends(h, l1, l1)
        some = h[low != high]
        return pa.RecordBatch.from_arrays([pa.array([to * _STREAMS + k for k in range(_STREAMS)], pa.int64()), pa.array([0] * _STREAMS, pa.int32()), pa.array([some.tobytes()] * _STREAMS, pa.binary())], names=["to", "kind", "data"])

    met = entries.mapInArrow(ends, schema).repartition(parts, "to").sortWithinPartitions("to").mapInArrow(repeated, schema)
    met = staged(met, "keys")

    def rows(batches):
        turn = TaskContext.get().partitionId()
        for h, l1 in _held(batches):
            turn += 1
            yield _dealt(part_of(h) * _STREAMS + turn % _STREAMS, np.stack((h, l1), axis=1), 1)

    def chosen(batches):
        own, at = np.zeros(0, np.int64), None
        for batch in batches:
            for to, kind, data in zip(*(batch.column(c).to_pylist() for c in ("to", "kind", "data")), strict=True):
                x = np.frombuffer(data, dtype=np.int64)
                if kind == 0:
                    own, at = x, to
                elif to == at and len(own):
                    x = x.reshape(-1, 2)
                    x = x[own[np.minimum(np.searchsorted(own, x[:, 0]), len(own) - 1)] == x[:, 0]]
                    if len(x):
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.ascontiguousarray(x.T)], names=["h", "l1"])

    both = met.unionByName(entries.mapInArrow(rows, schema))
    out = both.repartition(parts, "to").sortWithinPartitions("to", "kind").mapInArrow(chosen, "h long, l1 long")
    out._needs = met
    return out


def _lists(batches):
    """Rows of h and l1, in order of both, to a row for each l1 with its different h in order."""
    kept_h, kept_l1 = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in (*batches, None):
        if batch is not None:
            h, l1 = (np.concatenate((x, batch.column(c).to_numpy())) for x, c in ((kept_h, "h"), (kept_l1, "l1")))
            last = int(np.searchsorted(l1, l1[-1])) if len(l1) else 0
            (h, kept_h), (l1, kept_l1) = ((x[:last], x[last:]) for x in (h, l1))
        else:
            h, l1 = kept_h, kept_l1
        if len(l1):
            new = np.append(True, l1[1:] != l1[:-1])
            use = new | np.append(True, h[1:] != h[:-1])
            h, l1, new = h[use], l1[use], new[use]
            first = np.flatnonzero(new)
            lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(h)), pa.int32()), pa.array(h))
            yield pa.RecordBatch.from_arrays([pa.array(l1[first]), lists], names=["l1", "blocks"])


def edit_within(a: str, b: str, limit: int) -> bool:
    """Whether the edit distance of two texts is at most limit, by bit-parallel columns."""
    if abs(len(a) - len(b)) > limit:
        return False
    start, n = 0, min(len(a), len(b))
    while start < n and a[start] == b[start]:
        start += 1
    end = 0
    while end < n - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if max(len(a), len(b)) <= limit:
        return True
    if not a or not b:
        return False
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    every, top = (1 << len(a)) - 1, 1 << len(a) - 1
    rise, fall, score = every, 0, len(a)
    for j, c in enumerate(b):
        same = at.get(c, 0)
        vertical = same | fall
        diagonal = ((same & rise) + rise ^ rise) | same
        up, down = fall | ~(diagonal | rise) & every, rise & diagonal
        score += bool(up & top) - bool(down & top)
        if score - (len(b) - 1 - j) > limit:
            return False
        up = up << 1 | 1
        rise, fall = (down << 1 | ~(vertical | up)) & every, up & vertical
    return score <= limit


def edits_within(a: list[str], b: list[str], limits: np.ndarray) -> np.ndarray:
    """edit_within for each pair of texts, of at most GATHERED pairs of like length: bit-parallel columns in words of 64 rows, of all pairs at once.

    Only words within the largest limit of the diagonal are kept up, as no path of so few edits leaves them.
    """
    m, n = (np.array([len(x) for x in z]) for z in (a, b))
    chars = [np.frombuffer("".join(z).encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for z in (a, b)]
    count, words, reach = len(a), int(m.max() + 63) // 64, int(limits.max())
    code = np.zeros(0x110000, np.int32)
    code[chars[0]] = 1
    used = np.flatnonzero(code)
    code[used] = np.arange(1, len(used) + 1)  # 0: not in any of the first texts
    wide = len(used) + 1
    place = np.arange(len(chars[0])) - np.repeat(np.cumsum(m) - m, m)
    masks = np.zeros((words, count * wide), np.uint64)
    np.add.at(masks.reshape(-1), place // 64 * (count * wide) + np.repeat(np.arange(count) * wide, m) + code[chars[0]], np.uint64(1) << (place % 64).astype(np.uint64))
    column = np.tile(np.arange(count) * wide, (int(n.max()), 1))
    column[np.arange(len(chars[1])) - np.repeat(np.cumsum(n) - n, n), np.repeat(np.arange(count), n)] += code[chars[1]]
    rise, fall = np.full((words, count), ~np.uint64(0)), np.zeros((words, count), np.uint64)
    one, top = np.array(1, np.uint64), np.array(63, np.uint64)
    ending, out, active, score = defaultdict(list), np.zeros(count, bool), 0, np.zeros(count, np.int64)
    for k, x in enumerate(n.tolist()):
        ending[x].append(k)
    for j in range(1, int(n.max()) + 1):
        low, high = max(0, (j - reach - 1) // 64), min(words, (j + reach - 1) // 64 + 1)
        score += 64 * (high - active)
        active = high
        same, up, down = masks[low:high].take(column[j - 1], axis=1), rise[low:high], fall[low:high]
        level = same & up
        vertical = same | down
        total = level + up
        carry = total < level
        for w in range(1, high - low):
            total[w] += carry[w - 1]
            carry[w] |= total[w] < carry[w - 1]
        total ^= up
        total |= same
        more = total | up
        np.invert(more, out=more)
        more |= down
        total &= up  # less
        high_more, high_less = more >> top, total >> top
        score += high_more[-1].astype(np.int64)
        score -= high_less[-1].astype(np.int64)
        more <<= one
        total <<= one
        more[0] |= one
        more[1:] |= high_more[:-1]
        total[1:] |= high_less[:-1]
        np.bitwise_and(more, vertical, out=down)
        more |= vertical
        np.invert(more, out=more)
        np.bitwise_or(total, more, out=up)
        for k in ending.get(j, ()):  # down to the row of the text's end
            at, shift, below = (int(m[k]) - 1) // 64, (int(m[k]) - 1) % 64 + 1, 0
            for w in range(at, high):
                below += (int(rise[w, k]) >> shift).bit_count() - (int(fall[w, k]) >> shift).bit_count()
                shift = 0
            out[k] = score[k] - below <= limits[k]
    return out


def _place_bound(x: list[str], y: list[str]) -> int:
    """An upper bound of the edit distance of two texts of as many words: words that differ are replaced where they stand."""
    return sum(max(len(p), len(q)) for p, q in zip(x, y, strict=True) if p != q)


def _word_bound(x: list[str], y: list[str]) -> int:
    """An upper bound of the edit distance in near-linear time: words that each text has once are laid side by side
    as far as their order agrees, and what lies between two of them is replaced unless it is equal."""
    once_x, once_y = (({w: k for k, w in enumerate(z) if n[w] == 1}) for z, n in ((x, Counter(x)), (y, Counter(y))))
    pairs = [(k, once_y[w]) for w, k in once_x.items() if w in once_y]
    tails, ends, before = [], [], [-1] * len(pairs)  # longest rising run of places in y
    for n, (_, q) in enumerate(pairs):
        at = bisect_left(tails, q)
        before[n] = ends[at - 1] if at else -1
        tails[at : at + 1] = [q]
        ends[at : at + 1] = [n]
    run, n = [(len(x), len(y))], ends[-1] if ends else -1
    while n >= 0:
        run.append(pairs[n])
        n = before[n]
    bound, i, j = 0, 0, 0
    for p, q in reversed(run):
        left, right = x[i:p], y[j:q]
        if left != right:
            bound += max(sum(map(len, left)) + len(left), sum(map(len, right)) + len(right))
        i, j = p + 1, q + 1
    return bound


def _bigrams(x: str) -> np.ndarray:
    codes = np.frombuffer(x.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    pairs = (codes[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[1:]) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(55)
    return np.bincount(pairs.astype(np.int64), minlength=512).astype(np.int32)


def similar(a: str, b: str, threshold: float, bigrams=_bigrams) -> bool:
    """Edit similarity of at least the threshold.

    Lines that share most words in order need no columns, nor do those whose
    pairs of characters differ too much: an edit changes four counts at most.
    """
    longest = max(len(a), len(b))
    limit = int((1 - threshold) * longest + 1e-9)
    if abs(len(a) - len(b)) > limit:
        return False
    if longest >= 80:
        x, y = a.split(" "), b.split(" ")
        if len(x) == len(y) and _place_bound(x, y) <= limit or _word_bound(x, y) <= limit:
            return True
        if np.abs(bigrams(a) - bigrams(b)).sum() > 4 * limit:
            return False
    return edit_within(a, b, limit)


def _near(labels: np.ndarray, sims: np.ndarray, sizes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of a unit that are near in SimHash and size and not connected yet, with their distances, the nearest first."""
    differ = np.bitwise_count(sims[:, None] ^ sims[None, :])
    want = np.triu(differ <= DISTANCE, 1) & (labels[:, None] != labels[None, :])
    want &= np.minimum.outer(sizes, sizes) >= threshold * np.maximum.outer(sizes, sizes) - 1e-9
    a, b = np.nonzero(want)
    order = np.argsort(differ[a, b], kind="stable")
    return a[order], b[order], differ[a, b][order]


def all_similar(a: list[str], b: list[str], threshold: float) -> np.ndarray:
    """similar for each pair of texts: pairs that no bound decides are compared together, those of like length at once."""
    sizes = np.array([(len(x), len(y)) for x, y in zip(a, b, strict=True)]).reshape(-1, 2)
    longest = sizes.max(axis=1, initial=0)
    limits = ((1 - threshold) * longest + 1e-9).astype(np.int64)
    out, left = np.zeros(len(a), bool), []
    for k in np.flatnonzero(np.abs(sizes[:, 0] - sizes[:, 1]) <= limits).tolist():
        x, y = a[k].split(" "), b[k].split(" ")
        if len(x) == len(y) and _place_bound(x, y) <= limits[k]:
            out[k] = True
        else:
            left.append(k)
    left = np.array(left, dtype=np.int64)[np.argsort(longest[left], kind="stable")] if left else np.zeros(0, np.int64)
    at = 0
    while at < len(left):
        size = int(longest[left[at]])
        held = max(1, min(GATHERED, _MASKS // (size + 64)))
        use = left[at : at + held]
        use = use[longest[use] <= size * 1.25 + 16]
        at += len(use)
        x, y = [a[k] for k in use.tolist()], [b[k] for k in use.tolist()]
        band = min(size // 64 + 1, 2 * int(limits[use].max()) // 64 + 2)
        if len(use) < 8 * band or len(set().union(*x)) > 256:
            out[use] = [similar(p, q, threshold) for p, q in zip(x, y, strict=True)]
        else:
            out[use] = edits_within(x, y, limits[use])
    return out


def _would_join(group: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[int]:
    """Of open pairs, those that a spanning forest would take if all were similar."""
    root, left, out = list(range(int(group.max()) + 1)), len(set(group.tolist())), []
    for k, (x, y) in enumerate(zip(group[a].tolist(), group[b].tolist(), strict=True)):
        while root[x] != x:
            root[x] = x = root[root[x]]
        while root[y] != y:
            root[y] = y = root[root[y]]
        if x != y:
            root[x] = y
            out.append(k)
            left -= 1
            if left == 1:
                break
    return out


def spanning_forests(units: list[tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]], threshold: float) -> list[list[tuple[int, int]]]:
    """For each unit (labels, sims, sizes, lines), links that connect its lines as far as all its similar pairs would.

    Units are asked in rounds, all together: for the pairs that would join them, and after a round
    that failed to, for the next nearest as well, ever more of them. Pairs that are connected already are not compared.
    """
    links, waiting = [[] for _ in units], []
    for u, (labels, sims, sizes, norm) in enumerate(units):
        if len(norm) == 2:  # most units
            small, large = sorted(sizes.tolist())
            if labels[0] != labels[1] and int(sims[0] ^ sims[1]).bit_count() <= DISTANCE and small >= threshold * large - 1e-9:
                waiting.append((u, np.arange(2), np.zeros(1, np.int64), np.ones(1, np.int64), 0))
        else:
            _, group = np.unique(labels, return_inverse=True)
            a, b, _ = _near(group, sims, sizes, threshold)
            if len(a):
                waiting.append((u, group, a, b, 0))
    while waiting:
        asked, x, y = [], [], []
        for u, group, a, b, extra in waiting:
            use = np.union1d(np.arange(min(extra, len(a))), np.array(_would_join(group, a, b), dtype=np.int64))
            asked.append(use)
            norm = units[u][3]
            x += [norm[k] for k in a[use].tolist()]
            y += [norm[k] for k in b[use].tolist()]
        yes, at, later = all_similar(x, y, threshold), 0, []
        for (u, group, a, b, extra), use in zip(waiting, asked, strict=True):
            for k in use[yes[at : at + len(use)]].tolist():
                p, q = group[a[k]], group[b[k]]
                if p != q:
                    group[group == q] = p
                    links[u].append((int(a[k]), int(b[k])))
            at += len(use)
            still = group[a] != group[b]
            still[use] = False
            if still.any():
                later.append((u, group, a[still], b[still], min(max(16, 4 * extra), 4096)))
        waiting = later
    return links


def _starts(rows: pa.RecordBatch) -> np.ndarray:
    """Where the units start in rows sorted by h, i, j."""
    new = np.zeros(rows.num_rows, dtype=bool)
    new[0] = True
    for c in ("h", "i", "j"):
        x = rows.column(c).to_numpy(zero_copy_only=False)
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _with_near(rows: pa.RecordBatch, starts: np.ndarray, threshold: float) -> np.ndarray:
    """The rows that have a pair of their own in their unit, one whose smallest common block is the unit's; units are compared shift by shift, all at once."""
    n = rows.num_rows
    label, size, sim = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("label", "size", "sim"))
    blocks = rows.column("blocks")
    bounds = blocks.offsets.to_numpy()
    flat = blocks.values.to_numpy()[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    starts = starts[starts < n]
    ends = np.repeat(np.append(starts[1:], n), np.diff(np.append(starts, n)))
    found = np.zeros(n, dtype=bool)

    # Of each row's smaller blocks, a bit each: rows that share a block share its bit.
    marks, some = np.zeros(n, np.uint64), np.flatnonzero(np.diff(bounds))
    if len(some):
        marks[some] = np.bitwise_or.reduceat(np.uint64(1) << (mix64(flat.view(np.uint64)) >> np.uint64(58)), bounds[some])

    def elsewhere(x, y):
        """Which pairs share a block that is smaller than their unit's, and so belong there."""
        out, left = np.zeros(len(x), dtype=bool), np.flatnonzero(marks[x] & marks[y])
        p, q = bounds[x[left]], bounds[y[left]]
        p_end, q_end = bounds[x[left] + 1], bounds[y[left] + 1]
        while len(left):  # both lists are in order: go on in that with the smaller block
            a, b = flat[p], flat[q]
            out[left[a == b]] = True
            p, q = p + (a < b), q + (a > b)
            go = (a != b) & (p < p_end) & (q < q_end)
            left, p, q, p_end, q_end = left[go], p[go], q[go], p_end[go], q_end[go]
        return out

    a, shift = np.arange(n), 0
    while True:
        shift += 1
        a = a[a + shift < ends[a]]
        if not len(a):
            return np.flatnonzero(found)
        near = np.bitwise_count(sim[a] ^ sim[a + shift]) <= DISTANCE
        x = a[near]
        y = x + shift
        ok = (label[x] != label[y]) & (np.minimum(size[x], size[y]) >= threshold * np.maximum(size[x], size[y]) - 1e-9) & ~(found[x] & found[y])
        x, y = x[ok], y[ok]
        if len(x):
            own = ~elsewhere(x, y)
            found[x[own]] = found[y[own]] = True


def _whole_units(batches):
    """The batches of rows sorted by unit, cut where units end."""
    carried = None
    for batch in batches:
        table = batch if carried is None else pa.concat_batches([carried, batch])
        if not table.num_rows:
            continue
        starts = _starts(table)
        carried = table.slice(int(starts[-1]))
        if starts[-1]:
            yield table.slice(0, int(starts[-1])), starts[:-1]
    if carried is not None:
        yield carried, np.zeros(1, np.int64)


_KEY = ["h", "i", "j"]


def _fetch(names: list[str]):
    """Rows of a text and its wanted lines to a row a line: the names, and the line normalised."""

    def run(batches):
        for batch in batches:
            wanted = batch.column("wanted")
            flat = wanted.flatten()
            numbers, at, raw = flat.field("line").to_pylist(), 0, []
            for text, n in zip(batch.column("text").to_pylist(), pc.list_value_length(wanted).to_pylist(), strict=True):
                own = text.split("\n")
                raw += [own[k] for k in numbers[at : at + n]]
                at += n
            yield pa.RecordBatch.from_arrays([*(flat.field(c) for c in names), normalize(pa.array(raw, pa.large_string())).cast(pa.string())], names=[*names, "norm"])

    return run


def _needed(units: DataFrame, threshold: float) -> DataFrame:
    """Of units (h, i, j, lid, label, sim, size, blocks: the line's blocks below h, in order), the lines that have a near line of their own there."""

    def select(batches):
        for rows, starts in _whole_units(batches):
            yield rows.take(pa.array(_with_near(rows, starts, threshold))).drop_columns(["blocks"])

    schema = "h long, i int, j int, lid long, label long, sim long, size int"
    return staged(units.repartition(*_KEY).sortWithinPartitions(*_KEY).mapInArrow(select, schema), "needed")


def _texts(needed: DataFrame, later: DataFrame | None, keyed: DataFrame, places: DataFrame) -> DataFrame:
    """lid, label, sim, size, units and norm of the needed lines, and of those (lid, label, sim, size) that may be needed later. places: lid and rep, where a line's text is."""
    asked = needed.select("lid", "label", "sim", "size", F.struct(*_KEY).alias("unit"))
    if later is not None:
        asked = asked.unionByName(later, allowMissingColumns=True)
    by_line = asked.groupBy("lid").agg(F.first("sim").alias("sim"), F.first("size").alias("size"), F.first("label").alias("label"), F.collect_list("unit").alias("units")).join(places.select("lid", "rep").hint("merge"), "lid")
    line = F.struct(F.col("rep.line").alias("line"), "lid", "label", "sim", "size", "units")
    by_doc = staged(by_line.groupBy(F.col("rep.doc_id").alias("r_id"), F.col("rep.th").alias("r_th")).agg(F.collect_list(line).alias("wanted")), "wanted")
    texts = keyed.join(by_doc.hint("merge"), keyed["doc_id"].eqNullSafe(by_doc["r_id"]) & (keyed["th"] == by_doc["r_th"])).select("text", "wanted")
    filled = texts.mapInArrow(_fetch(["lid", "label", "sim", "size", "units"]), "lid long, label long, sim long, size int, units array<struct<h: long, i: int, j: int>>, norm string")
    filled = staged(filled, "texts")
    unstage(by_doc)
    return filled


def _links(sent: DataFrame, threshold: float) -> DataFrame:
    """a, b: spanning forests of units (h, i, j, lid, label, sim, size, norm)."""

    def verify(batches):
        units, held = [], 0
        for rows, starts in _whole_units(batches):
            lid, label, sim, size = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("lid", "label", "sim", "size"))
            norm = rows.column("norm").to_pylist()
            for p, q in zip(starts.tolist(), [*starts[1:].tolist(), rows.num_rows], strict=True):
                use = p + np.unique(lid[p:q], return_index=True)[1] if q > p + 1 else np.array([p])  # rows repeated in the input
                units.append((lid[use], (label[use], sim[use], size[use], [norm[k] for k in use.tolist()])))
            held += int(size.sum(dtype=np.int64))
            if held > _ASKING:
                yield from forests(units)
                units, held = [], 0
        yield from forests(units)

    def forests(units):
        found = spanning_forests([u for _, u in units], threshold)
        edges = [(int(lid[x]), int(lid[y])) for (lid, _), forest in zip(units, found, strict=True) for x, y in forest]
        if edges:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*edges, strict=True)], names=["a", "b"])

    return staged(sent.repartition(*_KEY).sortWithinPartitions(*_KEY).mapInArrow(verify, "a long, b long"), "edges")


def _triples(norm: list[str]) -> np.ndarray:
    """Which of 1024 hashed triples of characters each line has."""
    out = np.zeros((len(norm), 1024), np.float32)
    for k, x in enumerate(norm):
        c = np.frombuffer(x.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        if len(c) > 2:
            out[k, (mix64(c[:-2] << np.uint64(42) | c[1:-1] << np.uint64(21) | c[2:]) >> np.uint64(54)).astype(np.intp)] = 1
    return out


def every_link(x: list[str], y: list[str], labels: np.ndarray, threshold: float, same: bool) -> list[tuple[int, int]]:
    """Links that connect the lines of x, then y, as far as all similar pairs of an x and a y would; same: x and y are one block.

    Exact: a pair is left out without columns only where an edit, which changes
    three triples and four counts of pairs of characters at most, could not make up for it.
    """
    norm, nx = [*x, *y], len(x)
    sizes = np.array([len(z) for z in norm])
    longest = np.maximum.outer(sizes[:nx], sizes[nx:])
    limit = ((1 - threshold) * longest + 1e-9).astype(np.int64)
    _, group = np.unique(labels, return_inverse=True)
    want = (np.abs(sizes[:nx, None] - sizes[None, nx:]) <= limit) & (group[:nx, None] != group[None, nx:])
    if same:
        want = np.triu(want, 1)
    if not want.any():
        return []
    tx, ty = _triples(x), _triples(y)
    common = tx @ ty.T
    want &= (tx.sum(axis=1)[:, None] - common <= 3 * limit) & (ty.sum(axis=1)[None, :] - common <= 3 * limit)
    counts, links = np.stack([_bigrams(z) for z in norm]), []
    for p in range(nx):
        q = np.flatnonzero(want[p])
        q = q[np.abs(counts[nx + q] - counts[p]).sum(axis=1) <= 4 * limit[p, q]]
        for k in q.tolist():
            if group[p] != group[nx + k] and edit_within(x[p], y[k], int(limit[p, k])):
                group[group == group[nx + k]] = group[p]
                links.append((p, nx + k))
    return links


def _all_links(known: DataFrame, labels: DataFrame, keyed: DataFrame, threshold: float) -> DataFrame:
    """a, b: links between lines of different groups, whatever their fingerprints.

    Lines in order of size are packed in blocks, and blocks of near sizes meet:
    a task holds two blocks, and the work grows with the square of the lines.
    """
    named = known.join(labels.withColumnRenamed("v", "lid").hint("merge"), "lid", "left").select("lid", F.coalesce("label", "lid").alias("label"), "size", "rep")
    line = F.struct(F.col("rep.line").alias("line"), "lid", "label", "size")
    by_doc = named.groupBy(F.col("rep.doc_id").alias("r_id"), F.col("rep.th").alias("r_th")).agg(F.collect_list(line).alias("wanted"))
    texts = keyed.join(by_doc.hint("merge"), keyed["doc_id"].eqNullSafe(by_doc["r_id"]) & (keyed["th"] == by_doc["r_th"])).select("text", "wanted")
    filled = staged(texts.mapInArrow(_fetch(["lid", "label", "size"]), "lid long, label long, size int, norm string"), "filled")

    def pack(batches):
        for batch in batches:
            size = batch.column("size").to_numpy()
            block = np.maximum(np.arange(len(size)) // BLOCK, np.cumsum(size, dtype=np.int64) // _CHARACTERS)
            starts = np.flatnonzero(np.append(True, np.diff(block) != 0)) if len(size) else np.zeros(0, np.int64)
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(size)], strict=True):
                lists = [pa.array([batch.column(c).slice(a, b - a).to_pylist()], k) for c, k in (("lid", pa.list_(pa.int64())), ("label", pa.list_(pa.int64())), ("norm", pa.list_(pa.string())))]
                yield pa.RecordBatch.from_arrays([pa.array([int(size[a])], pa.int32()), pa.array([int(size[b - 1])], pa.int32()), *lists], names=["low", "high", "lid", "label", "norm"])

    ordered = filled.repartitionByRange("size", "lid").sortWithinPartitions("size", "lid")
    packed = ordered.mapInArrow(pack, "low int, high int, lid array<long>, label array<long>, norm array<string>")
    packed = staged(packed.withColumn("k", F.monotonically_increasing_id()), "packed")
    tasks = 4 * known.sparkSession.sparkContext.defaultParallelism
    other = packed.select(*(F.col(c).alias(f"o_{c}") for c in packed.columns))
    near = (F.col("k") <= F.col("o_k")) & (F.least("high", "o_high") >= threshold * F.greatest("low", "o_low") - 1)
    meets = packed.repartition(tasks, "k").crossJoin(other).where(near)

    def compare(batches):
        for batch in batches:
            for r in batch.to_pylist():
                lids = [*r["lid"], *r["o_lid"]]
                links = every_link(r["norm"], r["o_norm"], np.array([*r["label"], *r["o_label"]]), threshold, r["k"] == r["o_k"])
                if links:
                    yield pa.RecordBatch.from_arrays([pa.array([lids[x[e]] for x in links], pa.int64()) for e in (0, 1)], names=["a", "b"])

    with setting(known.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch", "1"):
        links = staged(meets.mapInArrow(compare, "a long, b long"), "all_links")
    unstage(filled, packed)
    return links


def groups(docs: DataFrame, threshold: float = 0.8, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """Lines (doc_id, th, line, l1, l2) and, for each l1 and l2 that is met again or linked, first: the occurrence of its group that stays; exact: see digest."""
    keyed = documents(docs).withColumn("th", F.xxhash64("text"))
    found = staged(lines(keyed, threshold, packed=True), "lines")
    once = found.groupBy("l1", "l2").agg(F.min(F.struct("doc_id", "line", "th")).alias("rep"), F.first("sim").alias("sim"), F.first("size").alias("size"), F.count("*").alias("c"))
    known = staged(once.withColumn("lid", F.monotonically_increasing_id()), "known")
    met = shared_blocks(found)
    listed = met.repartition("l1").sortWithinPartitions("l1", "h").mapInArrow(_lists, "l1 long, blocks array<long>").join(known.hint("merge"), "l1")
    listed = staged(listed.select("lid", "sim", "size", "rep", "blocks"), "listed")
    unstage(met._needs)
    spread = listed.select("lid", F.col("lid").alias("label"), "sim", "size", F.col("blocks").alias("every"), F.posexplode("blocks").alias("place", "h"))
    spread = spread.select("lid", "label", "sim", "size", F.slice("every", F.lit(1), F.col("place")).alias("blocks"), "h")  # those that may hold a pair instead
    large = staged(spread.groupBy("h").agg(F.count("*").alias("c")).where(F.col("c") > UNIT).select("h", F.ceil(F.col("c") / UNIT).cast("int").alias("parts")), "large")
    part = F.pmod(F.xxhash64("lid", "h"), F.coalesce("parts", F.lit(1))).cast("int")  # other parts in other blocks, which so join them
    units = spread.join(large, "h", "left").withColumn("i", part).withColumn("j", F.col("i"))
    needed = _needed(units.select(*_KEY, "lid", "label", "sim", "size", "blocks"), threshold)
    hot = large.limit(1).count() > 0
    texts = _texts(needed, spread.join(large, "h", "left_semi").select("lid", "label", "sim", "size") if hot else None, keyed, listed)
    edges = _links(texts.withColumn("u", F.explode("units")).select("u.*", "lid", "label", "sim", "size", "norm"), threshold)
    labels = components(edges)
    if hot:  # lines of different parts that are not connected yet
        now = F.coalesce("named", "lid").alias("label")
        inside = spread.drop("label").join(large, "h").join(labels.select(F.col("v").alias("lid"), F.col("label").alias("named")).hint("merge"), "lid", "left").select("lid", now, "sim", "size", "blocks", "h", "parts")
        inside = staged(inside, "inside")
        several = inside.groupBy("h").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("h")
        dealt = inside.join(several, "h", "left_semi").withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where("part <> other")
        apart = _needed(dealt.select("h", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "lid", "label", "sim", "size", "blocks"), threshold)
        more = _links(apart.join(texts.select("lid", "norm").hint("merge"), "lid"), threshold)
        if more.limit(1).count():
            labels = components(labels.select(F.col("v").alias("a"), F.col("label").alias("b")).unionByName(more))
        unstage(inside, apart, more)
    unstage(needed, texts)
    if exact:
        more = _all_links(known, labels, keyed, threshold)
        labels = components(labels.select(F.col("v").alias("a"), F.col("label").alias("b")).unionByName(more))
        unstage(more)
    unstage(listed, large)
    named = known.join(labels.withColumnRenamed("v", "lid").hint("merge"), "lid", "left").where("c > 1 or label is not null")
    named = staged(named.select("l1", "l2", "rep", F.coalesce("label", "lid").alias("label")), "named")
    lowest = staged(named.groupBy("label").agg(F.min("rep").alias("first")), "lowest")
    firsts = staged(named.join(lowest.hint("merge"), "label").select("l1", "l2", "first"), "firsts")
    unstage(known, edges, named, lowest)
    return found, firsts


def removed_lines(docs: DataFrame, threshold: float = 0.8, exact: bool = False) -> DataFrame:
    """doc_id, th and removed (numbers of the lines that go) of each document that loses lines."""
    found, firsts = groups(docs, threshold, exact)
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("line") == F.col("first.line")) & (F.col("th") == F.col("first.th"))
    gone = found.join(firsts.hint("merge"), ["l1", "l2"]).where(~stays)
    out = staged(gone.groupBy("doc_id", "th").agg(F.collect_list("line").alias("removed")), "removed")
    unstage(found, firsts)
    return out


def _kept(text: str, removed: list[int] | None) -> tuple[str, int]:
    own = text.split("\n")
    gone = set(removed or ())
    return "\n".join(x for k, x in enumerate(own) if k not in gone), len(own)


def digest(docs: DataFrame, threshold: float = 0.8, exact: bool = False) -> DataFrame:
    """doc_id, n_lines, n_removed and kept_sha256 (of the lines that stay, joined by line ends) of every document.

    exact: after the blocks, lines of different groups are compared whether they
    share a block or not, so that no similar pair is left out; the work is the square of the lines.
    """
    removed = removed_lines(docs, threshold, exact).withColumnsRenamed({"doc_id": "r_id", "th": "r_th"})
    keyed = documents(docs).withColumn("th", F.xxhash64("text"))

    def run(batches):
        for batch in batches:
            rows = []
            for doc, text, gone in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("removed").to_pylist(), strict=True):
                kept, n = _kept(text, gone)
                rows.append((doc, n, len(set(gone or ())), hashlib.sha256(kept.encode()).hexdigest()))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["doc_id", "n_lines", "n_removed", "kept_sha256"])

    joined = keyed.join(removed.hint("merge"), keyed["doc_id"].eqNullSafe(removed["r_id"]) & (keyed["th"] == removed["r_th"]), "left").select("doc_id", "text", "removed")
    return joined.mapInArrow(run, "doc_id long, n_lines long, n_removed long, kept_sha256 string")


def keep_first(docs: DataFrame, threshold: float = 0.8, exact: bool = False) -> DataFrame:
    """docs, all columns, with the lines that go taken out of text; exact as in digest."""
    removed = removed_lines(docs, threshold, exact).withColumnsRenamed({"doc_id": "__r_id", "th": "__r_th", "removed": "__removed"})
    on = docs["doc_id"].cast("long").eqNullSafe(removed["__r_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == removed["__r_th"])
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x, k: ~F.array_contains("__removed", k)), "\n")
    return docs.join(removed.hint("merge"), on, "left").withColumn("text", F.when(F.col("__removed").isNull(), F.col("text")).otherwise(kept)).select(*docs.columns)
