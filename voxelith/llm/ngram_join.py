"""N-gram Jaccard join: MinHash banding, then verification on the full n-gram sets.

1. Each document's set of word n-grams is hashed to 64 bits and min-hashed;
   `choose_bands` takes the fewest bands of ROWS rows that find a pair at the
   threshold with the target recall. Documents with one and the same set are a
   class; one of them goes on.
2. Classes are shuffled on band hashes. Buckets of over BLOCK classes are dealt
   into blocks, and each pair of blocks is a unit of work, so that no task gets a
   whole hot bucket. A pair belongs to the first band in which it meets, so it
   is verified once; a class with no pair of its own in a unit drops out there.
3. The sets of the classes left are taken from the texts, sent to their units,
   and intersected there exactly, as products of 0/1 matrices over the n-grams
   that several sets of the unit hold. Units put out each class's number of
   links and a spanning forest of them, never pairs.
4. Forests are joined to connected groups (components).

Words are lower-case and separated by white space (Unicode's). Defined cases: a text of one
to n-1 words has one n-gram, all of it; a text without words (null, empty, white
space) has no links and is its own group; copies count as links of each other;
repeated rows are copies; a null doc_id takes part, and a group's class_id is its
smallest doc_id, null if it has no other; `keep_one` keeps one row of each group,
one with that id (of rows that have it in common any one); an empty table gives no
row; other columns are ignored by `link` and kept by `keep_one`.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, fresh_name, give_back, hash_words, mix64, numbered, staged, unstage, words_of
from .components import components
from .tokenizing import WordEncoder

ROWS, BLOCK = 5, 256
#: White space other than the blank, as of str.split.
_BLANKS = r"[\t-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def choose_bands(threshold: float, recall: float, rows: int = ROWS) -> int:
    """The fewest bands of `rows` rows that find a pair at the threshold with probability `recall`."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)))


class _Slices:
    slice_bytes = 2 << 20


def shingle_hashes(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all word n-grams of the texts in order, and the texts' offsets in them."""
    flat = pc.replace_substring_regex(pc.utf8_lower(texts), _BLANKS, " ")
    names, codes, offsets = words_of(flat)
    filled = pc.not_equal(names, "").to_numpy(zero_copy_only=False)[codes]
    offsets = np.concatenate(([0], np.cumsum(filled)))[offsets]
    h = hash_words(names)[codes[filled]]
    grams = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for k in range(n):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(grams)]
    counts = np.diff(offsets)
    whole = np.maximum(counts - n + 1, 0)
    inner = np.repeat(offsets[:-1] - np.concatenate(([0], np.cumsum(whole)[:-1])), whole) + np.arange(whole.sum())
    values, out = mix64(grams[inner]), np.concatenate(([0], np.cumsum(whole)))
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):  # all of a short text is its one n-gram
        one = []
        for d in short.tolist():
            x = 0x1234567
            for w in h[offsets[d] : offsets[d + 1]].tolist():
                x = (x * 0x9E3779B97F4A7C15 + w + 1) & (1 << 64) - 1
            one.append(x)
        values = np.insert(values, out[short], mix64(np.array(one, dtype=np.uint64)))
        grown = np.diff(out)
        grown[short] = 1
        out = np.concatenate(([0], np.cumsum(grown)))
    return values, out


def signatures(values: np.ndarray, offsets: np.ndarray, bands: int, rows: int = ROWS) -> np.ndarray:
    """Band hashes (texts x bands) of non-empty runs of n-gram hashes."""
    draw = np.random.default_rng(20240229)
    masks = draw.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
    mults = draw.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.zeros((len(offsets) - 1, bands), np.uint64)
    for b in range(bands):
        h = np.full(len(offsets) - 1, b, np.uint64)
        for r in range(b * rows, (b + 1) * rows):
            h = mix64(h * np.uint64(31) + np.minimum.reduceat((values ^ masks[r]) * mults[r], offsets[:-1]))
        out[:, b] = h
    return out.view(np.int64)


def profiles(docs: DataFrame, n: int, bands: int) -> DataFrame:
    """row, doc_id, th (hash of the text), k1, k2 (digest of the n-gram set), size, bands; size 0 for a text without words."""

    def run(batches):
        for batch in batches:
            for at, count in WordEncoder.slices(_Slices, batch.column("text")):
                part = batch.slice(at, count)
                values, offsets = shingle_hashes(part.column("text"), n)
                size = np.zeros(count, np.int32)
                digest = np.zeros((count, 2), np.int64)
                for d, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                    if a < b:
                        own = np.unique(values[a:b])
                        size[d] = len(own)
                        digest[d] = np.frombuffer(xxhash.xxh3_128_digest(own.tobytes()), dtype=np.int64)
                some = np.flatnonzero(size)
                hashes = np.zeros((count, bands), np.int64)
                if len(some):
                    hashes[some] = signatures(values, np.append(offsets[some], len(values)), bands)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(count + 1) * bands, pa.int32()), pa.array(hashes.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("doc_id"), part.column("th"), pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array(size), lists],
                    names=["row", "doc_id", "th", "k1", "k2", "size", "bands"],
                )
        give_back()

    return docs.mapInArrow(run, "row long, doc_id long, th long, k1 long, k2 long, size int, bands array<long>")


def _units(batches, columns: list[str]):
    """Rows of each unit, as columns; the input is sorted by t, h, i, j."""
    held: list = []
    last = None
    for batch in batches:
        for r in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
            if r[:4] != last and held:
                yield held
                held = []
            last = r[:4]
            held.append(r)
    if held:
        yield held


def _own_pairs(t: int, i: int, j: int, blocks: np.ndarray, sizes: np.ndarray, bands: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs a unit has to verify: in the upper triangle, of its blocks, near in size, and not met in an earlier band."""
    m = len(blocks)
    want = np.triu(np.ones((m, m), dtype=bool), 1)
    if i != j:
        want &= blocks[:, None] != blocks[None, :]
    want &= np.minimum.outer(sizes, sizes) >= threshold * np.maximum.outer(sizes, sizes) - 1e-9
    for k in range(t):
        want &= bands[:, None, k] != bands[None, :, k]
    return want


def shared(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """How many n-grams each two of the sets share."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, gram, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = count > 1  # only these can be shared
    place = np.cumsum(several) - 1
    keep = several[gram]
    owner, gram = owner[keep], place[gram[keep]]
    order = np.argsort(gram, kind="stable")
    owner, gram = owner[order], gram[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for lo in range(0, int(several.sum()), columns):
        a, b = np.searchsorted(gram, (lo, lo + columns))
        x = np.zeros((len(sets), columns), np.float32)
        x[owner[a:b], gram[a:b] - lo] = 1
        out += x @ x.T
    return out


def links(cid: np.ndarray, weight: np.ndarray, sets: list[np.ndarray], want: np.ndarray, threshold: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Each class's links to documents of others among the wanted pairs, and a spanning forest of the linked classes."""
    both = shared(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.float64)
    linked = want & (both >= threshold * (sizes[:, None] + sizes[None, :] - both) - 1e-6)
    counts = linked @ weight + linked.T @ weight
    near = linked | linked.T
    root = np.full(len(cid), -1)
    forest = []
    for s in range(len(cid)):
        if root[s] < 0 and near[s].any():
            root[s], front = s, [s]
            while front:
                x = front.pop()
                fresh = np.flatnonzero(near[x] & (root < 0))
                root[fresh] = s
                front += fresh.tolist()
                forest += [(int(cid[s]), int(cid[y])) for y in fresh.tolist()]
    return counts, forest


def link(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.999) -> DataFrame:
    """One row a document: doc_id, class_id (smallest doc_id of its connected group) and n_links (documents at the threshold or more)."""
    return _linked(documents(docs).withColumn("row", F.monotonically_increasing_id()), n, threshold, recall).select("doc_id", F.col("low.doc_id").alias("class_id"), "n_links")


def _by_id():
    """Orders rows by doc_id, nulls last, then by number."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")


def _linked(rows: DataFrame, n: int, threshold: float, recall: float) -> DataFrame:
    """row, doc_id, n_links, and low: doc_id and row of the group's row with the smallest doc_id."""
    keyed = rows.withColumn("th", F.xxhash64("text"))
    bands = choose_bands(threshold, recall)
    known = staged(profiles(keyed, n, bands), "profiles")
    grouped = known.where("size > 0").groupBy("k1", "k2").agg(F.count("*").alias("w"), F.min(F.struct("doc_id", "th")).alias("rep"), F.min(_by_id()).alias("low"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    classes = staged(grouped.withColumn("cid", F.monotonically_increasing_id()), "classes")
    spread = classes.select("cid", F.posexplode("bands").alias("t", "h"))
    full = staged(spread.groupBy("t", "h").agg(F.count("*").alias("c")).where("c > 1"), "buckets")
    members = spread.join(full.hint("merge"), ["t", "h"]).withColumn("blocks", F.ceil(F.col("c") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    each = members.select("cid", "t", "h", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    units = staged(each.select("cid", "t", "h", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block"), "units")
    light = units.join(classes.select("cid", "size", "bands").hint("merge"), "cid")
    key = ["t", "h", "i", "j"]

    def select(batches):
        for rows in _units(batches, [*key, "cid", "block", "size", "bands"]):
            t, _, i, j = rows[0][:4]
            _, _, _, _, cid, block, size, hashes = zip(*rows, strict=True)
            want = _own_pairs(t, i, j, np.array(block), np.array(size), np.array(hashes), threshold)
            use = np.flatnonzero(want.any(axis=0) | want.any(axis=1))
            if len(use):
                picked = [rows[k] for k in use.tolist()]
                columns = list(zip(*picked, strict=True))[:6]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32()), strict=True)], names=[*key, "cid", "block"])

    needed = staged(light.repartition(*key).sortWithinPartitions(*key).mapInArrow(select, "t int, h long, i int, j int, cid long, block int"), "needed")
    unstage(units, full)
    want = needed.groupBy("cid").agg(F.collect_list(F.struct(*key, "block")).alias("units")).join(classes.hint("merge"), "cid")
    want = staged(want.select("cid", "units", "bands", "w", F.col("rep.doc_id").alias("r_id"), F.col("rep.th").alias("r_th")), "wanted")
    texts = keyed.join(want.hint("merge"), keyed["doc_id"].eqNullSafe(want["r_id"]) & (keyed["th"] == want["r_th"])).select("text", "cid", "units", "bands", "w")

    def sets_of(batches):
        for batch in batches:
            for at, count in WordEncoder.slices(_Slices, batch.column("text")):
                part = batch.slice(at, count)
                values, offsets = shingle_hashes(part.column("text"), n)
                raw = [np.unique(values[a:b]).tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield part.drop_columns(["text"]).append_column("grams", pa.array(raw, pa.binary()))

    filled = texts.mapInArrow(sets_of, f"cid long, {_struct(needed, key)}, bands array<long>, w long, grams binary")
    sent = filled.select("cid", "bands", "w", "grams", F.explode("units").alias("u")).select("u.*", "cid", "bands", "w", "grams")

    def verify(batches):
        for rows in _units(batches, [*key, "block", "cid", "bands", "w", "grams"]):
            t, _, i, j = rows[0][:4]
            rows = list({r[5]: r for r in rows}.values())  # rows repeated in the input
            _, _, _, _, block, cid, hashes, w, raw = zip(*rows, strict=True)
            sets = [np.frombuffer(x, dtype=np.uint64) for x in raw]
            own = _own_pairs(t, i, j, np.array(block), np.array([len(s) for s in sets]), np.array(hashes), threshold)
            counts, forest = links(np.array(cid), np.array(w, dtype=np.float64), sets, own, threshold)
            some = np.flatnonzero(counts)
            if len(some):
                a = [int(cid[k]) for k in some.tolist()] + [x for x, _ in forest]
                b = [None] * len(some) + [y for _, y in forest]
                c = [int(counts[k]) for k in some.tolist()] + [None] * len(forest)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64())], names=["a", "b", "links"])

    found = staged(sent.repartition(*key).sortWithinPartitions(*key).mapInArrow(verify, "a long, b long, links long"), "links")
    unstage(needed, want)
    labels = components(found.where("b is not null").select("a", "b"))
    counted = staged(found.where("links is not null").groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("links")), "counted")
    named = classes.join(labels.withColumnRenamed("v", "cid").hint("merge"), "cid", "left").select("cid", "k1", "k2", "w", "low", F.coalesce("label", "cid").alias("label"))
    named = staged(named.join(counted.hint("merge"), "cid", "left"), "named")
    lowest = staged(named.groupBy("label").agg(F.min("low").alias("lowest")), "lowest")
    result = staged(named.join(lowest.hint("merge"), "label").select("k1", "k2", F.col("lowest").alias("low"), (F.col("w") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "classed")
    unstage(classes, found, counted, named, lowest)
    linked = known.where("size > 0").select("row", "doc_id", "k1", "k2").join(result.hint("merge"), ["k1", "k2"]).select("row", "doc_id", "n_links", "low")
    return linked.unionByName(known.where("size = 0").select("row", "doc_id", F.lit(0).cast("long").alias("n_links"), _by_id().alias("low")))


def _struct(needed: DataFrame, key: list[str]) -> str:
    kinds = dict(needed.dtypes)
    return "units array<struct<" + ", ".join(f"{c}: {kinds[c]}" for c in [*key, "block"]) + ">>"


def keep_one(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.999) -> DataFrame:
    """docs, all columns, with one row of each connected group: that with the smallest doc_id."""
    name = fresh_name(docs, "row")
    known = numbered(docs, name)
    rows = documents(known, F.col(name).alias("row"))
    kept = staged(_linked(rows, n, threshold, recall).where("row = low.row").select(F.col("row").alias(name)), "kept")
    return known.join(kept.hint("merge"), name, "left_semi").select(*docs.columns)
