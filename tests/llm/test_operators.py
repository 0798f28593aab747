"""The text operators against brute force on small tables with odd cases."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("public_tokenizers")

from voxelith.llm import bpe, exact_dedup, line_dedup, ngram_join, packing, suffix_dedup, token_files, topk_search, toxicity, url_filter
from voxelith.llm.components import components
from voxelith.llm.entries import vocabulary
from voxelith.llm.tokenizing import WordEncoder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, th long, rank string"


def words(rng, n, k=40):
    return " ".join(rng.choice(VOCAB[:k]) for _ in range(n))


VOCAB = [a + b + c for a in ("ka", "lo", "mi", "zu") for b in ("ra", "te", "von") for c in ("", "n", "sh", "el")]
ODD = ["", " ", None, "one", "two words", "Ünïcode İ ß ñ. 漢字 🙂!", "<|endoftext|>hi<|startoftext|>.", "a\tb\nc\u00a0d", "x" * 5000, "it's don't we'll 12,345 é.́", "A B C D E", "a b c d e"]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    base = [words(rng, rng.randint(5, 120)) for _ in range(25)]
    passage = words(rng, 110)
    out = [*ODD, *base]
    for b in base[:8]:  # copies, near copies
        w = b.split()
        w[len(w) // 2] = "changed"
        out += [b, b.upper(), " ".join(w)]
    out += [words(rng, 20) + "\n" + passage + "\n" + words(rng, 15) for _ in range(6)]
    out += ["line one of a text that repeats itself\n" * 12 + words(rng, 8), passage * 2]
    out += [" ".join(words(rng, 300) for _ in range(20))]
    ids = list(range(100, 100 + len(out)))
    table = [(i, t, "en", "s", 0, 7, "x") for i, t in zip(ids, out)]
    return [*table, table[15], (None, "no id here at all, said nobody", None, None, None, None, None), (ids[20], "other text, same id", "en", "s", 1, 1, "y")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def some(rows):
    return sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def test_encoders_agree_with_the_library(library):
    rng = random.Random(9)
    letters = "aabbcde   \n\t.,'’s tllve0123éÉüßİſñçàĀ漢字🙂<|endoftext|>́!?%#"
    texts = [t or "" for t in ODD] + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(800)]
    for enc in (WordEncoder(vocabulary()), bpe.BacktrackingBPE(vocabulary())):
        ids, offsets = enc.encode(pa.array(texts))
        for k, t in enumerate(texts):
            assert ids[offsets[k] : offsets[k + 1]].tolist() == ids_of(library, t), t


@pytest.mark.parametrize("pattern", [r"[^\s]+", r"'s|[\p{L}]+|[\p{N}]|[^\s\p{N}]+", r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+| +x"])
def test_word_route_is_taken_only_where_the_pattern_allows_it(tmp_path, pattern):
    import json

    from tokenizers import Tokenizer

    with open(vocabulary(), encoding="utf-8") as f:
        spec = json.load(f)
    spec["pre_tokenizer"]["pretokenizers"][0]["pattern"] = {"Regex": pattern}
    (tmp_path / "t.json").write_text(json.dumps(spec), encoding="utf-8")
    library, enc = Tokenizer.from_file(str(tmp_path / "t.json")), WordEncoder(str(tmp_path / "t.json"))
    assert not enc.by_word and WordEncoder(vocabulary()).by_word
    texts = ["hello, world!", "it's (so)...", "", "a  x b x"]
    ids, offsets = enc.encode(pa.array(texts))
    for k, t in enumerate(texts):
        assert ids[offsets[k] : offsets[k + 1]].tolist() == ids_of(library, t)
    with pytest.raises(ValueError):
        bpe.BacktrackingBPE(str(tmp_path / "t.json"))


def test_token_files(spark, docs, rows, empty, library):
    got = sorted(token_files.tokens_written(docs, vocabulary(), 2).collect(), key=lambda r: r.start)
    want, start = [], 0
    for i, t in some(rows):
        ids = [*ids_of(library, t), 2]
        want.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    assert [tuple(r) for r in got] == want
    assert token_files.tokens_written(empty, vocabulary(), 2).count() == 0
    assert token_files.id_width(49408, 2) == 2 and token_files.id_width(49408, 300) == 4
    with pytest.raises(ValueError):
        token_files.id_width(1 << 25, 2)


def test_exact_dedup(docs, rows, empty):
    groups = defaultdict(list)
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, t in some(rows):
        groups[t.translate(fold)].append(i)
    got = exact_dedup.groups(docs).collect()
    assert len(got) == len(rows) and sum(r.kept for r in got) == len(groups)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): v for t, v in groups.items()}
    for r in got:
        own = by_sha[r.text_sha256]
        assert r.group_size == len(own) and r.keep_id == max((x for x in own if x is not None), default=None)
    assert exact_dedup.groups(empty).count() == 0
    assert set(exact_dedup.keep_one(docs).columns) == set(docs.columns)


ALIKE = [(1, "w w w"), (1, "w w w"), (None, "w w w"), (None, "other text"), (0, "w w w"), (5, "W w w"), (5, "other words"), (5, "other words"), (None, None), (7, ""), (None, "alone")]


def kept_rows(spark, keep):
    frame = spark.createDataFrame([(*r, k, "c") for k, r in enumerate(ALIKE)], "doc_id long, text string, row long, _row string").repartition(3)
    out = keep(frame)
    assert out.columns == frame.columns
    return sorted(((r.doc_id, r.text) for r in out.collect()), key=str)


def test_exact_dedup_keeps_one_row_of_each_group(spark, empty):
    want = [(5, "W w w"), (None, "other text"), (5, "other words"), (7, ""), (None, "alone")]
    assert kept_rows(spark, exact_dedup.keep_one) == sorted(want, key=str)
    assert exact_dedup.keep_one(empty).count() == 0


def test_exact_dedup_compares_digests_where_an_identifier_fails(spark):
    chunk = lambda i, sha: {"id": i, "sha": bytes([sha])}
    rows = [(0, 0, "a", [chunk(1, 1), chunk(2, 2)]), (1, 1, "a", [chunk(1, 1), chunk(2, 2)]), (2, 2, "b", [chunk(1, 1), chunk(2, 3)]), (3, 3, "c", [chunk(4, 4)]), (4, 4, "d", [])]
    found = spark.createDataFrame(rows, "doc_row long, doc_id long, text_sha256 string, chunks array<struct<id: long, sha: binary>>")
    recipe = {r.doc_id: r.recipe for r in exact_dedup.verified(found).collect()}
    assert recipe[0] == recipe[1] != recipe[2] and len(set(recipe.values())) == 4


def test_ngram_join_keeps_one_row_of_each_group(spark, empty):
    # null and empty texts have no words and are no copies of each other
    want = [(0, "w w w"), (5, "other words"), (None, "other text"), (None, None), (7, ""), (None, "alone")]
    assert kept_rows(spark, ngram_join.keep_one) == sorted(want, key=str)
    assert ngram_join.keep_one(empty).count() == 0


def test_ngram_join_splits_at_all_white_space(spark):
    base = words(random.Random(2), 12).split()
    table = list(enumerate(b.join(base) for b in (" ", "\u00a0", "\u3000", "\u2009\n", "\x85", "\x1c\t")))
    got = [tuple(r) for r in ngram_join.link(spark.createDataFrame(table, "doc_id long, text string")).collect()]
    assert sorted(got) == [(k, 0, len(table) - 1) for k, _ in table]


def test_chunks_concatenate(spark):
    from pyspark.sql import functions as F

    rng = random.Random(1)
    texts = ["", "a", words(rng, 900), "z" * 30000, words(rng, 400) + "\n" + words(rng, 700)]
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", exact_dedup.chunks(F.col("t")).alias("c")).collect():
        assert "".join(r.c) == r.t


def jaccard_groups(rows, n=5, threshold=0.8):
    sets = []
    for i, t in some(rows):
        w = t.lower().split()
        sets.append((i, frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])))
    root, links = list(range(len(sets))), [0] * len(sets)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            x, y = sets[a][1], sets[b][1]
            if x and y and len(x & y) >= threshold * len(x | y):
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    lows = defaultdict(list)
    for k, (i, _) in enumerate(sets):
        lows[find(k)].append(i)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in lows.items()}
    return sorted(((i, least[find(k)], links[k]) for k, (i, _) in enumerate(sets)), key=str)


def test_ngram_join(docs, rows, empty):
    got = sorted((tuple(r) for r in ngram_join.link(docs).collect()), key=str)
    assert got == jaccard_groups(rows)
    assert ngram_join.link(empty).count() == 0
    assert ngram_join.choose_bands(0.8, 0.999) == 18


def test_ngram_join_deals_large_buckets_into_blocks(spark):
    rng = random.Random(2)
    base = words(rng, 80, 48).split()
    table = []
    for i in range(700):
        w = list(base)
        w[rng.randrange(80)] = f"v{i}"
        table.append((i, " ".join(w)))
    got = sorted((tuple(r) for r in ngram_join.link(spark.createDataFrame(table, "doc_id long, text string")).collect()), key=str)
    want = jaccard_groups(table)
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert sum(abs(a[2] - b[2]) for a, b in zip(got, want)) <= 0.002 * sum(r[2] for r in want)


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 20)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.v: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[k] for k in range(21)} == {0} and {got[k] for k in (100, 101, 102)} == {100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_edit_distance():
    rng = random.Random(3)

    def plain(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a):
            e = [i + 1]
            for j, y in enumerate(b):
                e.append(min(d[j] + (x != y), d[j + 1] + 1, e[-1] + 1))
            d = e
        return d[-1]

    for _ in range(600):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 12))) for _ in range(2))
        for limit in range(8):
            assert line_dedup.edit_within(a, b, limit) == (plain(a, b) <= limit)


def plain_distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a):
        e = [i + 1]
        for j, y in enumerate(b):
            e.append(min(d[j] + (x != y), d[j + 1] + 1, e[-1] + 1))
        d = e
    return d[-1]


def plainly_similar(a, b, threshold):
    longest = max(len(a), len(b))
    return abs(len(a) - len(b)) <= (1 - threshold) * longest + 1e-9 and plain_distance(a, b) <= int((1 - threshold) * longest + 1e-9)


def made_up(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n))


def test_similar_agrees_with_plain_edit_similarity():
    rng = random.Random(4)
    for _ in range(60):
        a = made_up(rng, rng.randint(1, 25)).split()
        b = [made_up(rng, 1) if rng.random() < rng.choice([0.02, 0.2, 0.35]) else w for w in a]
        if rng.random() < 0.3:
            rng.shuffle(b)
        x, y = " ".join(a), " ".join(b)
        assert line_dedup.similar(x, y, 0.8) == plainly_similar(x, y, 0.8)


@pytest.mark.parametrize("share", [0.05, 0.1])
def test_line_recall(spark, share):
    """Links against plain edit similarity, whatever the fingerprints: a twentieth and a tenth of the words changed, lines of one to sixty words."""
    rng = random.Random(8)
    lines = [made_up(rng, rng.randint(8, 60)) for _ in range(100)]
    changed = []
    for x in lines:
        w = x.split()
        for k in rng.sample(range(len(w)), max(1, round(len(w) * share))):
            w[k] = made_up(rng, 1)
        changed.append(" ".join(w))
    real = [k for k, (a, b) in enumerate(zip(lines, changed)) if plainly_similar(a, b, 0.8)]
    table = list(enumerate([*lines, *changed]))
    got = {r.doc_id: r.n_removed for r in line_dedup.digest(spark.createDataFrame(table, "doc_id long, text string")).collect()}
    assert len(real) > 80 and sum(got[len(lines) + k] for k in real) >= 0.9 * len(real)
    assert not any(got[k] for k in range(len(lines)))


def test_line_recall_at_every_length(spark):
    """Lines of 20 to 1000 words, a twentieth and a tenth of them changed: links by a bound on the edits, whatever the fingerprints."""
    rng = random.Random(11)
    common = [made_up(rng, 1) for _ in range(200)]
    table, asked = [], []
    for n in (20, 60, 100, 150, 200, 300, 600, 1000):
        for share in (0.05, 0.1):
            for _ in range(15):
                old = [rng.choice(common) if rng.random() < 0.5 else made_up(rng, 1) for _ in range(n)]
                new = list(old)
                for k in rng.sample(range(n), max(1, round(n * share))):
                    new[k] = made_up(rng, 1)
                edits = sum(max(len(a), len(b)) for a, b in zip(old, new, strict=True) if a != b)
                if edits <= 0.2 * max(len(" ".join(old)), len(" ".join(new))):
                    asked.append((n, len(table) + 1))
                table += [(len(table), " ".join(old)), (len(table) + 1, " ".join(new))]
    got = {r.doc_id: r.n_removed for r in line_dedup.digest(spark.createDataFrame(table, "doc_id long, text string").repartition(4)).collect()}
    found = defaultdict(list)
    for n, i in asked:
        found[n].append(got[i])
    assert len(asked) > 200 and all(np.mean(x) >= 0.85 for x in found.values()), {n: np.mean(x) for n, x in found.items()}
    assert np.mean([got[i] for _, i in asked]) >= 0.93
    assert not any(got[i] for i in range(0, len(table), 2))


def test_fingerprints_of_very_many_words():
    texts = [" ".join(f"w{k}" for k in range(n)) for n in (40_000, 70_000, 140_000)]
    sims, blocks = line_dedup.fingerprints(pa.array(texts, pa.large_string()), 0.8)
    for text, sim in zip(texts, sims.view(np.uint64), strict=True):
        assert int(sim) == int(line_dedup._whole(line_dedup._word_hashes(pa.array(text.split(), pa.large_string()))))
    assert len(set(sims.tolist())) == 3 and all(0 < len(b) <= 3 * line_dedup.USED for b in blocks.to_pylist())


@pytest.mark.parametrize("unit", [512, 8])
def test_line_dedup(spark, docs, empty, unit, monkeypatch):
    monkeypatch.setattr(line_dedup, "UNIT", unit)
    rng = random.Random(6)
    lines = [words(rng, rng.randint(8, 30)) for _ in range(60)]
    lines += [x + "s" for x in lines[:20]] + [x.upper() for x in lines[:10]]
    base = words(rng, 30).split()
    lines += [" ".join([*base[:k], f"v{k}", *base[k + 1 :]]) for k in range(30)]  # a group of near copies, over several units
    lines += ["a", "b\u2003 c\t", "\u6f22\u5b57" * 20, "\u6f22\u5b57" * 19 + "\u6f22", "x" * 3000, "x" * 2990 + "y" * 10]
    table = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 9)))) for i in range(90)] + [(90, None), (91, "\n\n"), (92, ""), (None, lines[0] + "\n" + lines[70])]
    table += [table[3], table[3]]
    frame = spark.createDataFrame([(*r, "c", -1) for r in table], "doc_id long, text string, lid string, blocks long").repartition(3)
    got = defaultdict(list)
    for r in line_dedup.digest(frame).collect():
        got[r.doc_id].append(r)
    first, order = {}, []
    for i, t in sorted(set(table), key=lambda r: (r[0] is not None, r[0] or 0)):
        for k, x in enumerate((t or "").split("\n")):
            norm = " ".join(x.lower().split())
            order.append((i, k, norm, x))
            if norm:
                first.setdefault(norm, len(order) - 1)
    names = list(first)
    sims, blocks = line_dedup.fingerprints(pa.array(names, pa.large_string()), 0.8)
    sims, blocks = sims.view(np.uint64), [set(x) for x in blocks.to_pylist()]
    root = list(range(len(names)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    missed = real = 0
    for a in range(len(names)):
        for b in range(a + 1, len(names)):
            if plainly_similar(names[a], names[b], 0.8) if max(len(names[a]), len(names[b])) < 1000 else line_dedup.similar(names[a], names[b], 0.8):
                real += 1
                if np.bitwise_count(sims[a] ^ sims[b]) <= line_dedup.DISTANCE and blocks[a] & blocks[b]:
                    root[find(a)] = find(b)
                else:
                    missed += 1
    assert real > 300 and missed <= 0.05 * real
    least = {}
    for k, x in enumerate(names):
        least[find(k)] = min(least.get(find(k), first[x]), first[x])
    kept = defaultdict(list)
    for at, (i, k, norm, x) in enumerate(order):
        if not norm or least[find(names.index(norm))] == at:
            kept[i].append(x)
    for i, t in table:
        assert len(got[i]) == sum(r[0] == i for r in table)
        for r in got[i]:
            assert r.kept_sha256 == hashlib.sha256("\n".join(kept[i]).encode()).hexdigest()
            assert r.n_lines == len((t or "").split("\n")) and r.n_removed == r.n_lines - len(kept[i])
    if unit == 512:
        assert line_dedup.digest(empty).count() == 0
        out = line_dedup.keep_first(frame)
        assert out.columns == frame.columns
        assert sorted((r.doc_id or -1, r.text or "") for r in out.collect()) == sorted((i or -1, "\n".join(kept[i]) if t else "") for i, t in table)


def test_packing(docs, rows, empty, library):
    got = packing.pack(docs, vocabulary(), 1, 2048, block_windows=2).collect()
    texts = defaultdict(list)
    for i, t in some(rows):
        texts[i].append([*ids_of(library, t), 1])
    seqs = defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
        assert any(len(ids) == r.doc_tokens and crc(ids[r.start : r.start + r.length]) == r.ids_crc32 for ids in texts[r.doc_id])
    assert sum(r.length for r in got) == sum(len(ids) for v in texts.values() for ids in v)
    for pieces in seqs.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at == 2048 or at & (at - 1) == 0 and at < 2048
    assert packing.pack(empty, vocabulary()).count() == 0


def test_differencing_is_near_equal():
    rng = random.Random(8)
    for k in (1, 2, 5, 16):
        sizes = [rng.randint(1, 500) for _ in range(200)]
        parts = packing.difference(sizes, k)
        assert sorted(i for p in parts for i in p) == list(range(200)) and len(parts) == k
        sums = [sum(sizes[i] for i in p) for p in parts]
        assert max(sums) - min(sums) <= 20
    for capacity in (16, 64):
        sizes = [rng.randint(1, capacity - 1) for _ in range(50)]
        assert max(sum(sizes[i] for i in w) for w in packing.near_equal(sizes, capacity)) <= capacity


def test_bpe_round_trip(docs, rows, empty, library):
    got = sorted((tuple(r) for r in bpe.round_trip(docs, vocabulary()).collect()), key=str)
    want = []
    for i, t in some(rows):
        ids = ids_of(library, t)
        text = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.round_trip(empty, vocabulary()).count() == 0
    assert bpe.decode(bpe.encode(docs, vocabulary()), vocabulary()).count() == len(rows)


def brute_spans(texts, length):
    found = defaultdict(list)
    for k, b in enumerate(texts):
        for p in range(len(b) - length + 1):
            found[b[p : p + length]].append((k, p))
    spans = [[] for _ in texts]
    for places in found.values():
        if len(places) > 1:
            for k, p in places:
                spans[k].append((p, p + length))
    return [suffix_dedup.merge(s) for s in spans]


def test_maximal_repeats():
    rng = random.Random(5)
    for _ in range(150):
        letters = rng.choice([b"ab", b"abc", b"a", b"abcdefgh"])
        base = [bytes(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3)]
        texts = [rng.choice(base) + bytes(rng.choice(letters) for _ in range(rng.randint(0, 20))) + rng.choice(base) for _ in range(rng.randint(1, 6))]
        length = rng.choice([4, 6, 9, 16])
        texts = [t for t in texts if len(t) >= length]
        assert suffix_dedup._covered(texts, [len(t) - length + 1 for t in texts], length) == brute_spans(texts, length)
    (size, places), *_ = suffix_dedup.maximal_repeats([b"xxabcdefyy", b"zzabcdefww", b"qabcdefr"], [7, 7, 5], 4)
    assert size == 6 and sorted(places) == [(0, 2), (1, 2), (2, 1)]


@pytest.mark.parametrize("hot", [600, 2])
def test_suffix_dedup(docs, rows, empty, hot, monkeypatch):
    spans_of = suffix_dedup.repeated_spans
    monkeypatch.setattr(suffix_dedup, "repeated_spans", lambda d, length: spans_of(d, length, hot))
    got = sorted((tuple(r) for r in suffix_dedup.digest(docs, 400).collect()), key=str)
    texts = [(i, t.encode()) for i, t in some(rows)]
    want = []
    for (i, b), spans in zip(texts, brute_spans([b for _, b in texts], 400)):
        kept, removed, n = suffix_dedup._cut(b, [{"a": x, "b": y} for x, y in spans])
        want.append((i, len(b), removed, n, hashlib.sha256(kept).hexdigest()))
    assert got == sorted(want, key=str) and any(r[2] for r in got)
    if hot == 600:
        assert suffix_dedup.digest(empty, 400).count() == 0
        out = suffix_dedup.remove_repeats(docs, 400)
        assert out.columns == docs.columns and out.count() == len(rows)


def brute_passages(texts, words):
    """Bytes of each text that strings of whole characters with so many words or more cover, if they are met again."""
    found = defaultdict(list)
    for k, t in enumerate(texts):
        for a in range(len(t)):
            for b in range(a + 1, len(t) + 1):
                if len(t[a:b].split()) >= words and t[a:b] == t[a:b].strip():
                    found[t[a:b]].append((k, len(t[:a].encode()), len(t[:b].encode())))
    spans = [[] for _ in texts]
    for places in found.values():
        if len(places) > 1:
            for k, a, b in places:
                spans[k].append((a, b))
    return [suffix_dedup.merge(s) for s in spans]


@pytest.mark.parametrize("hot", [600, 1])
def test_repeated_passages(spark, hot, monkeypatch):
    rng = random.Random(7)
    draw = lambda n: rng.choice(["", " "]) + "".join(rng.choice(["a", "b", "ab", "bé", "bè", "漢"]) + rng.choice([" ", " ", "\n", "  ", "\u00a0"]) for _ in range(n))
    shared = [draw(rng.randint(4, 9)).strip() for _ in range(4)]
    texts = [draw(rng.randint(0, 5)) + rng.choice([*shared, ""]) + rng.choice(["", " "]) + draw(rng.randint(0, 6)) for _ in range(40)]
    monkeypatch.setattr(suffix_dedup, "PART", 40)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for words in (5, 6):
        got = {r.doc_id: suffix_dedup.merge([tuple(x) for x in r.spans]) for r in suffix_dedup.repeated_passages(docs, words, hot).collect()}
        assert [got.get(i, []) for i in range(len(texts))] == brute_passages(texts, words)
        assert got


def test_pieces_share_all_windows():
    rng = random.Random(9)
    text = "".join(rng.choice("ab  é\u2003") for _ in range(3000)).encode()
    starts, ends = suffix_dedup.word_places(text)
    assert [text[a:b].decode() for a, b in zip(starts, ends)] == text.decode().split()
    saved, suffix_dedup.PART = suffix_dedup.PART, 100
    try:
        windows = [(at + int(a), at + int(b)) for at, part in suffix_dedup._pieces(text, 7) for s, e in [suffix_dedup.word_places(part)] for a, b in zip(s[: len(s) - 6], e[6:])]
    finally:
        suffix_dedup.PART = saved
    assert windows == list(zip(starts[:-6].tolist(), ends[6:].tolist()))


@pytest.mark.parametrize("hot", [600, 2])
def test_repeat_groups(spark, hot):
    rng = random.Random(12)
    passage = words(rng, 130)
    table = [(i, words(rng, 15) + passage + words(rng, 10)) for i in range(5)] + [(9, words(rng, 90)), (10, None)]
    docs = spark.createDataFrame(table, "doc_id long, text string")
    groups, covered = defaultdict(set), defaultdict(list)
    for r in suffix_dedup.repeat_groups(docs, 400, hot).collect():
        groups[r.mh, r.g, r.size].add((r.doc_id, r.offset))
        covered[r.doc_id].append((r.offset, r.offset + r.size))
    texts = {i: (t or "").encode() for i, t in table}
    for (_, _, size), places in groups.items():
        assert len(places) > 1 and size >= 400 and len({texts[d][o : o + size] for d, o in places}) == 1
    want = brute_spans([texts[i] for i, _ in table], 400)
    assert {i: suffix_dedup.merge(covered[i]) for i, _ in table} == {i: w for (i, _), w in zip(table, want)}
    assert max(map(len, groups.values())) >= 5


def test_topk_search(spark):
    rng = np.random.default_rng(1)
    table = [(int(i), [float(x) for x in rng.normal(0, 0.2, 8)], 1) for i in range(150)]
    table += [(200, None, 1), (300, [1.0, float("nan")] * 4, 1), (400, [0.1] * 8, 1), (401, [0.1] * 8, 1), (500, [1.0] * 5, 1), (501, [2.0] * 5, 1), (None, [0.5] * 8, 1), (600, [None] * 8, 1), (700, [], 1)]
    frame = spark.createDataFrame(table, "vec_id long, embedding array<float>, label int").repartition(3)
    from pyspark.sql import functions as F

    got = sorted(tuple(r) for r in topk_search.top_k(frame, F.col("vec_id") % 100 == 0, 10).collect())
    good = [(i, [int(np.floor(np.float64(np.float32(x)) * 1024)) for x in v]) for i, v, _ in table if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for i, v in good:
        if i % 100 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in good if j != i and len(w) == len(v))[:10]
            want += [(i, k, j, -s) for k, (s, j) in enumerate(scores, 1)]
    assert got == sorted(want)
    assert topk_search.top_k(frame.limit(0), F.col("vec_id") % 100 == 0, 10).count() == 0


def brute_top(table, k=10):
    want = []
    good = [(i, [int(np.floor(x * 1024)) for x in v]) for i, v in table]
    for i, v in good:
        if i % 100 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in good if j != i and len(w) == len(v))[:k]
            want += [(i, n, j, -s) for n, (s, j) in enumerate(scores, 1)]
    return sorted(want)


@pytest.mark.parametrize("case", ["blocks", "repeated", "large"])
def test_topk_search_in_blocks_with_repeated_ids_and_large_numbers(spark, monkeypatch, case):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(2)
    high = 3e5 if case == "large" else 0.5
    table = [(i, [float(x) for x in rng.normal(0, high, 6)]) for i in range(0, 1200, 10)]
    if case == "repeated":  # equal rows and other rows of one id: each a candidate, and a query
        table += [table[0], table[10], (100, table[3][1]), (7, table[4][1]), (7, table[4][1])]
    if case == "blocks":
        monkeypatch.setattr(topk_search, "BLOCK_BYTES", 6 * 8 * 5)
    frame = spark.createDataFrame(table, "vec_id long, embedding array<double>").repartition(3)
    got = sorted(tuple(r) for r in topk_search.top_k(frame, F.col("vec_id") % 100 == 0, 10).collect())
    assert got == brute_top(table)
    if case == "large":
        assert max(r[3] for r in got) > 2**53


def test_toxicity_scores_against_a_loop_over_windows(spark):
    import math

    rng = np.random.default_rng(3)
    model = toxicity.Model(rng.normal(0, 3, toxicity.BUCKETS).astype(np.float32), -0.7)
    chooser = random.Random(5)
    texts = [words(chooser, n) for n in (1, 5, 63, 64, 65, 200, 700)] + ["", " ", "...", "same " * 300, "A\nb  (c), D!", "Ünï ñ 漢字 🙂 x", "y" * 3000]

    def of_word(w):
        ids, _ = toxicity.gram_ids(pa.array([w]))
        return sum(float(model.by_bucket[i]) for i in ids) / max(len(ids), 1)

    def slow(text):
        listed = [w for w in (x.strip(toxicity._EDGES) for x in text.lower().replace("\n", " ").split(" ")) if w]
        logits = [model.bias + sum(map(of_word, set(listed[k : k + 64]))) / 64 for k in range(0, len(listed), 64)]
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, max(logits, default=model.bias)))))

    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    assert [got[i] for i in range(len(texts))] == pytest.approx([slow(t) for t in texts], rel=1e-6)


def test_toxicity_catches_unseen_spellings(spark):
    rng = random.Random(3)
    table, labels = [], []
    for i in range(400):
        w = words(rng, rng.randint(20, 400)).split()
        bad = i % 4 == 0
        if bad:
            for _ in range(rng.randint(1, 3)):
                w[rng.randrange(len(w))] = "grobniak" + rng.choice(["", "s", "en", "er", "ish"])
        table.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    table += [(1000, None), (1001, ""), (1002, words(rng, 60) + " grobniakked"), (None, "x"), (1003, "ka " * 3000)]
    docs, known = spark.createDataFrame(table, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.judge(docs, known).collect()}
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (i in held) for i, _ in labels)
    right = np.mean([got[i].predicted == y for i, y in labels if i in held])
    assert right >= 0.95 and got[1002].predicted == 1 and got[1003].predicted == 0
    assert 0 <= got[1000].score < 0.5 and got[1000].score == got[1001].score
    assert toxicity.drop_toxic(docs, known).count() < docs.count()
    one = toxicity.judge(docs, known.where("toxic = 0"))
    assert one.where("predicted = 1").count() == 0


def test_url_filter(spark):
    cases = {
        None: ("", "", None, None), "": ("", "", None, None), "no scheme/at all": ("", "", None, None),
        "http://A.Example.NET/en/x?q=1": ("a.example.net", "/en/x", "example.net/en/", "allow"),
        "https://example.net/EN/": ("example.net", "/EN/", "net/", "block"), "http://example.net": ("example.net", "", None, None),
        "http://notexample.com/de/1#f": ("notexample.com", "/de/1", None, None), "http://m.example.com/de/": ("m.example.com", "/de/", "example.com/de/", "block"),
        "x://org/fr/a?b/c": ("org", "/fr/a", "org/fr/", "allow"), "http://h?x=/y": ("h", "", None, None), "a://b://c/d": ("b:", "//c/d", None, None),
    }
    frame = spark.createDataFrame([(k, u) for k, u in enumerate(cases)], "page_id long, url string")
    for r in url_filter.judge(frame).collect():
        host, path, rule, verdict = list(cases.values())[r.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule) and (verdict is None or r.verdict == verdict)
        assert url_filter.split_url(list(cases)[r.page_id]) == (host, path)
    train = spark.createDataFrame(list(enumerate(u for u, _ in url_filter.SEED_URLS)), "page_id long, url string")
    verdicts = {r.page_id: r.verdict for r in url_filter.judge(train, rules=()).collect()}
    assert np.mean([(verdicts[k] == "block") == bool(y) for k, (_, y) in enumerate(url_filter.SEED_URLS)]) >= 0.95
    assert url_filter.judge(frame.limit(0)).count() == 0


def test_url_filter_agrees_with_its_sql(spark):
    import duckdb
    import pandas as pd

    pages = pd.DataFrame({"page_id": range(5), "url": ["http://a.example.org/win/casino", None, "https://x.net/", "zz", "https://docs.example.com/é/漢?x"]})
    con = duckdb.connect()
    con.register("pages", pages)
    want = sorted(con.execute(url_filter.judge_sql()).fetchall())
    frame = spark.createDataFrame([(int(a), b) for a, b in pages.itertuples(index=False)], "page_id long, url string")
    assert sorted(tuple(r) for r in url_filter.judge(frame).drop("score").collect()) == want
