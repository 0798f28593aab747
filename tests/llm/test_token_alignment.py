"""Token alignment against a plain walk over the tokens of both libraries."""

import hashlib
import random
from collections import Counter

import pytest

pytest.importorskip("public_tokenizers")

from voxelith.llm import token_alignment as T
from voxelith.llm.entries import alignment_files

SCHEMA = "doc_id long, text string, part string, n long, a string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    letters = "aabbcde    \n\n\t.,'’s tlve0123éÉüß漢字🙂<|endoftext|> 　\x1c\x85!?-"
    words = ["straße", "it's", "don't", "alpha", "Beta,", "12,345.", "<|endoftext|>", "</s>", "naïve", "漢字", "🙂", "(so)...", "x" * 40, "\n", "\n\n", "  ", "\t"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(150)]
    texts += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 40))) for _ in range(150)]
    texts += [None, "", " ", "  ", "\n", "a▁b c", "▁", " lead", "trail ", "z" * 3000, "漢" * 500, "same words " * 2000, "one", "one"]
    out = [(i, t, "x", 1, "y") for i, t in enumerate(texts)]
    return [*out, out[3], (None, "no id, said nobody", None, None, None)]


def brute(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    path_a, path_b = alignment_files()
    a_coder, b_coder = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
    a_coder.encode_special_tokens = True
    points = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    of_char = {chr(c): c for c in points} | {chr(256 + i): c for i, c in enumerate(sorted(set(range(256)) - set(points)))}

    def b_bytes(i):
        return bytes([int(b_coder.id_to_piece(i)[3:5], 16)]) if b_coder.is_byte(i) else b_coder.id_to_piece(i).replace("▁", " ").encode()

    def ends(parts):
        total, out = 0, []
        for p in parts:
            total += len(p)
            out.append(total)
        return out

    found = []
    for _, text, *_ in rows:
        whole = (" " + (text or "")).encode()
        a, b = (a_coder.encode(" " + text, add_special_tokens=False).ids, b_coder.encode(text)) if text else ([], [])
        a_parts, b_parts = [bytes(of_char[c] for c in a_coder.id_to_token(i)) for i in a], [b_bytes(i) for i in b]
        if not text or b"".join(a_parts) != whole or b"".join(b_parts) != whole:
            found.append(None)
            continue
        ea, eb = ends(a_parts), ends(b_parts)
        links = [(i, j) for i, x in zip(a, ea, strict=True) for j, y in zip(b, eb, strict=True) if x == y]
        cuts = [0, *sorted(set(ea) & set(eb))]
        groups = []
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            groups.append("|".join(",".join(str(i) for i, e in zip(ids, at, strict=True) if low < e <= high) for ids, at in ((a, ea), (b, eb))))
        found.append((len(a), len(b), links, groups))
    count = Counter(link for x in found if x for link in x[2])
    highest = {}
    for (_, j), c in count.items():
        highest[j] = max(highest.get(j, 0), c)
    out = []
    for (i, *_), x in zip(rows, found, strict=True):
        if x is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, links, groups = x
            out.append((i, n_a, n_b, len(groups), len(links), sum(count[k] == highest[k[1]] for k in links), sum(count[k] for k in links), ";".join(groups)))
    return sorted(out, key=str)


@pytest.mark.parametrize("chunk", [T.CHUNK, 3000])
def test_align(spark, rows, chunk):
    rows = [r for r in rows if len(r[1] or "") < 25_000]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert sorted(map(tuple, T.align(docs, *alignment_files(), chunk).collect()), key=str) == brute(rows)


def test_digest(spark):
    docs = spark.createDataFrame([(1, "one two", "", 0, ""), (2, "", "", 0, ""), (3, "▁", "", 0, "")], SCHEMA)
    got = {r.doc_id: r for r in T.digest(docs, *alignment_files()).collect()}
    groups = {r.doc_id: r.groups for r in T.align(docs, *alignment_files()).collect()}
    assert got[1].groups_sha256 == hashlib.sha256(groups[1].encode()).hexdigest() and got[1].n_groups == groups[1].count(";") + 1
    assert got[2].groups_sha256 == got[3].groups_sha256 == "" and got[2].n_a == got[3].count_sum == 0
    assert T.digest(docs, *alignment_files()).columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_tables_without_tokens(spark):
    for rows in ([], [(1, None, "", 0, ""), (None, "", "", 0, "")]):
        got = T.digest(spark.createDataFrame(rows, SCHEMA), *alignment_files()).collect()
        assert sorted(((r[0], *r[1:]) for r in got), key=str) == sorted(((r[0], 0, 0, 0, 0, 0, 0, "") for r in rows), key=str)


def test_other_tokenizers_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError):
        T._Coders(public_tokenizers.path("word_bpe_49k.json"), alignment_files()[1])
