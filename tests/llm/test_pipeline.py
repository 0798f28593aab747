"""The pipeline: each stage on its predecessor's output, decisions and columns."""

import random

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline

from voxelith.llm.packing import SCHEMA


def test_stages(spark, tmp_path):
    rng = random.Random(1)
    names = [a + b for a in ("ka", "lo", "mi", "zu", "pe") for b in ("ra", "te", "von", "ish", "ul")]
    text = lambda n: " ".join(rng.choice(names) for _ in range(n))
    passage = text(120)
    docs, labels = [], []
    for i in range(120):
        t = text(rng.randint(30, 150))
        if i % 5 == 0:
            t += " vrakkolid"
        labels.append((i, 1, int(i % 5 == 0)))
        docs.append((i, t, "en", "s", len(t)))
    docs += [(200, docs[1][1], "en", "s", 1), (201, docs[2][1] + " end", "en", "s", 1), (202, text(20) + passage, "en", "s", 1), (203, passage + text(20), "en", "s", 1), (204, None, "en", "s", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    frame, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, frame, str(tmp_path))
        if k < 4:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(f"{tmp_path}/{k}")
        frame = spark.read.parquet(f"{tmp_path}/{k}")
        left.append({r.doc_id: r for r in frame.select(*(["doc_id", "text"] if k < 4 else ["doc_id"])).collect()})
    assert 0 not in left[0] and 1 in left[0]
    assert 1 not in left[1] and 200 in left[1]
    assert 2 in left[2] and 201 not in left[2]
    assert passage not in left[3][202].text and passage not in left[3][203].text
    assert frame.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == frame.count()


def test_passages_of_51_words_go(spark):
    rng = random.Random(2)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    passage, short = text(51), text(49)
    assert 290 < len(passage) < 310
    rows = [(k, f"{text(30)} {p} {text(40)}") for k, p in enumerate((passage, passage, short, short))]
    stage = dict(corpus_pipeline.STAGES)["suffix_array_dedup"]
    left = {r.doc_id: r.text for r in stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    for k in (0, 1):
        assert not set(passage.split()) & set(left[k].split())
        assert left[k].split()[0] == rows[k][1].split()[0] and left[k].split()[-1] == rows[k][1].split()[-1]
    assert all(left[k] == rows[k][1] for k in (2, 3))


def test_entry_queries_cover_the_ten():
    import __spark_entry__ as entry

    assert all(any(q.startswith(f"op{n}_") for q in entry.queries()) for n in range(1, 11))
    assert "pipeline" in entry.queries()


def test_toxicity_stage_without_labels_keeps_all(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([(1, "a b"), (None, None), (2, "")], "doc_id long, text string")
    kept = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and sorted(map(str, kept.collect())) == sorted(map(str, docs.collect()))


@pytest.mark.parametrize("case", ["empty", "repeated"])
def test_run_on_odd_tables(spark, tmp_path, case):
    rng = random.Random(2)
    text = lambda n: " ".join(rng.choice(["ka", "lora", "mite", "zuvon", "pelish", "tor"]) + rng.choice("abcdef") for _ in range(n))
    docs = [] if case == "empty" else [(i, text(40), "en", "s", 1) for i in range(30)] + [(None, text(30), None, None, None), (31, None, "en", "s", 0), (32, "", "en", "s", 0)]
    if case == "repeated":
        docs += [docs[3], docs[3], docs[30]]
    labels = [] if case == "empty" else [(i, 1, int(i % 4 == 0)) for i in range(0, 30, 2)] + [(2, None, None), (None, 1, 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    if case == "empty":
        assert rows == []
    else:
        ids = [r.doc_id for r in rows if r.start == 0]
        assert len(ids) == len(set(ids)) and set(ids) <= {*range(33), None}


def test_every_operator_is_registered_once():
    import __spark_entry__ as entry

    names = [q for q in entry.queries() if q.startswith("op")]
    assert sorted(int(q[2:].split("_")[0]) for q in names) == list(range(1, 14))
    assert "pipeline" in entry.queries() and {"op2_exact_dedup", "op8_topk_search", "op10_url_filter", "op12_secret_scan", "op13_centroid_clustering"} <= set(entry.oracle_sql())
