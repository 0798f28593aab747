"""Cross-tokenizer alignment: where the tokens of two tokenizers end together, in relational steps.

Tokenizer A is byte-level BPE (a tokenizers file), B is BPE with byte fallback
and blanks as marks (a sentencepiece model); both see one blank and the text.
Neither lets a token pass from a character that is not white space to a blank
or newline, from a lone newline to what follows, or from a Latin letter to a
mark of MARKS (A's pre-tokenizer parts them, B has no such piece; `_Coders`
checks both), so such places are cuts in every text. Texts are parted there,
and each distinct part is tokenized and aligned once for the whole corpus.

1. A task numbers the distinct parts of a chunk of documents (CHUNK bytes of
   text at most, or one document); documents become lists of these numbers.
2. Parts are counted over the corpus and the distinct ones tokenized.
3. Tokens are exploded with their places; running sums of their byte lengths
   are their ends; A and B meet by an equi-join on part and end. Cuts are the
   ends that both have; the running count of cuts before a token is its group.
   A group's last tokens end together: these are its link.
4. Links are counted by pair of ids over the corpus and joined back to parts.
5. Parts go back to the chunks that hold them, and each chunk's documents are
   put together from them.

Exchanges carry distinct parts, tokens of distinct parts and lists of numbers;
a part is met once a chunk, so no key holds more rows than there are chunks,
but for pairs of ids, whose join Spark splits where one is hot.

Defined cases: null and empty texts, and texts with U+2581 (which B gives back
as a blank), have no tokens: zeros and an empty string. Special tokens' strings
are plain text. Repeated rows are aligned each and count each; null doc_ids are
kept; an empty table gives no row; other columns are ignored. Tokens have one
byte at least, so that each group has one link.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _CLEANUP, documents, expand, give_back, setting, staged, staging_path, unstage

CHUNK = 16 << 20
#: Marks that no token joins to the letter before them.
MARKS = ".,;:!?)*&"
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Before white space that begins with a blank or newline; then, within what lies between, the other places.
PARTING = re.compile(r"(?<=\S)(?=[ ])")
FINER = re.compile(rf"(?<=\S)(?=\n)|(?<=\S\n)(?=\S)|(?<=[{_LETTER}])(?=[{re.escape(MARKS)}])")
_BESIDE = re.compile(r"\s | \s")
_MARK = "▁"


class _Coders:
    """Both tokenizers, with the byte length of each id."""

    def __init__(self, a: str, b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        with open(a, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec["model"]["type"] != "BPE" or spec["model"].get("dropout"):
            raise ValueError("tokenizer A must be byte-level BPE that splits by its pattern and changes no byte")
        self.a = Tokenizer.from_file(a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        vocab = self.a.get_vocab(with_added_tokens=False)
        if len({t for t in vocab if len(t) == 1}) != 256:
            raise ValueError("tokenizer A must have all bytes")
        self.a_length = np.zeros(max(vocab.values()) + 1, np.int32)
        for token, i in vocab.items():
            self.a_length[i] = len(token)  # each character stands for one byte
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        joins = re.compile(rf"[{_LETTER}][{re.escape(MARKS)}]|\n")
        odd = " ﬁ  ①Å \n　x "
        if self.b.normalize(odd) != (" " + odd).replace(" ", _MARK) or sum(map(self.b.is_byte, range(len(pieces)))) != 256 or any(_MARK in p.lstrip(_MARK) or joins.search(p) for p in pieces):
            raise ValueError("tokenizer B must have all bytes, change no character, and have no piece that passes a place where texts are parted")
        self.b_length = np.array([1 if self.b.is_byte(i) else len(p.replace(_MARK, " ").encode()) for i, p in enumerate(pieces)], np.int32)

    def tokens(self, parts: list[str]) -> tuple[pa.Array, pa.Array]:
        """The ids and byte lengths of both tokenizers' tokens of each part."""
        a = [e.ids for e in self.a.encode_batch_fast(parts, add_special_tokens=False)]
        b = [ids[2:] for ids in self.b.encode(["\n" + p for p in parts], num_threads=1)]  # without the blank that B adds and the newline
        return _lists(a, self.a_length), _lists(b, self.b_length)


def _lists(ids: list[list[int]], length: np.ndarray) -> pa.Array:
    flat = np.fromiter((i for x in ids for i in x), np.int32)
    offsets = np.cumsum([0, *map(len, ids)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(flat), pa.array(length[flat])], ["id", "len"]))


@lru_cache(maxsize=2)
def _coders(a: str, b: str) -> _Coders:
    return _Coders(a, b)


class _Numbers(dict):
    """A number for each key, given as it is first asked for."""

    def __missing__(self, key):
        n = self[key] = len(self)
        return n


def places(text: str) -> list[str]:
    """The text, with a blank before it, parted before its blanks; each without its first blank."""
    if text[0] != " " and text[-1] != " " and not _BESIDE.search(text):
        return text.split(" ")
    return [p[1:] for p in PARTING.split(" " + text)]


def parted(docs: DataFrame, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """Documents as lists of numbers (chunk, doc_id, parts), and the parts of each chunk (chunk, no, part, n: how often), written in one pass."""
    spark = docs.sparkSession
    names = ["kind", "chunk", "doc_id", "parts", "no", "part", "n"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.string(), pa.int64()]

    def batch(rows: int, **columns):
        return pa.RecordBatch.from_arrays([columns[k].cast(t) if k in columns else pa.nulls(rows, t) for k, t in zip(names, types, strict=True)], names=names)

    def run(batches):
        base, number, ids, lists, size, known = TaskContext.get().partitionId() << 33, 0, [], [], 0, _Numbers()

        def out():
            number_of, pool, runs = _Numbers(), array("i"), array("q")
            for p in known:
                finer = FINER.split(" " + p)
                pool.extend(map(number_of.__getitem__, finer))
                runs.append(len(finer))
            known.clear()
            pool, runs = np.frombuffer(pool, np.int32), np.frombuffer(runs, np.int64)
            bounds = np.cumsum([0, *map(len, lists)])
            codes = np.concatenate([*lists, np.zeros(0, np.int32)])
            lists.clear()
            flat, offsets = expand(codes, bounds, runs, np.cumsum(runs) - runs, pool)
            for at in range(0, len(ids), 1024):
                to = min(at + 1024, len(ids))
                some = pa.ListArray.from_arrays(pa.array(offsets[at : to + 1] - offsets[at], pa.int32()), pa.array(flat[offsets[at] : offsets[to]]))
                yield batch(to - at, kind=pa.array(["docs"] * (to - at)), chunk=pa.array([base + number] * (to - at)), doc_id=pa.array(ids[at:to], pa.int64()), parts=some)
            times, listed = np.bincount(flat, minlength=len(number_of)), list(number_of)
            for at in range(0, len(listed), 50_000):
                some = listed[at : at + 50_000]
                n = len(some)
                yield batch(n, kind=pa.array(["parts"] * n), chunk=pa.array([base + number] * n), no=pa.array(range(at, at + n)), part=pa.array(some), n=pa.array(times[at : at + n]))

        for some in batches:
            for doc_id, text in zip(some.column("doc_id").to_pylist(), some.column("text"), strict=True):
                text = text.as_py()
                ids.append(doc_id)
                cut = places(text) if text and _MARK not in text else []
                lists.append(np.fromiter(map(known.__getitem__, cut), np.int32, count=len(cut)))
                size += len(text)
                if size >= chunk:
                    yield from out()
                    number, ids, lists, size, known = number + 1, [], [], 0, _Numbers()
        yield from out()
        give_back()

    path = staging_path(spark, "parted")
    with setting(spark, _CLEANUP, "true"), setting(spark, "spark.sql.maxConcurrentOutputFileWriters", "2"):
        documents(docs).mapInArrow(run, "kind string, chunk long, doc_id long, parts array<int>, no int, part string, n long").write.partitionBy("kind").parquet(path)
    read = [_read(spark, f"{path}/kind={kind}", schema) for kind, schema in (("docs", "chunk long, doc_id long, parts array<int>"), ("parts", "chunk long, no int, part string, n long"))]
    read[1]._staged_at = f"{path}/kind=parts"
    return read[0], read[1]


def _read(spark, path: str, schema: str) -> DataFrame:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):  # no such rows
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def tokenized(parts: DataFrame, a: str, b: str) -> DataFrame:
    """Each distinct part once: uid, part, n over the corpus, a and b (lists of id and len)."""

    def run(batches):
        both = _coders(a, b)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                some = batch.slice(at, 4096)
                yield pa.RecordBatch.from_arrays([some.column("part"), some.column("n"), *both.tokens(some.column("part").to_pylist())], names=["part", "n", "a", "b"])
        give_back()

    kind = "array<struct<id: int, len: int>>"
    found = parts.groupBy("part").agg(F.sum("n").alias("n")).mapInArrow(run, f"part string, n long, a {kind}, b {kind}")
    return staged(found.withColumn("uid", F.monotonically_increasing_id()), "tokens")


def _ends(tokens: DataFrame, side: str) -> DataFrame:
    """uid, upto and the id of each token of one side."""
    each = tokens.select("uid", side).repartition("uid").select("uid", F.posexplode(side).alias("pos", "t"))
    before = Window.partitionBy("uid").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return each.select("uid", F.sum("t.len").over(before).alias("upto"), F.col("t.id").alias(side))


def _known(side: str):
    return F.size(F.filter("t", lambda x: x[side].isNotNull())).cast("long").alias(f"n_{side}")


def aligned(tokens: DataFrame) -> DataFrame:
    """Each part's groups as text, its links (a, b) and counts of tokens and groups, written."""
    both = _ends(tokens, "a").join(_ends(tokens, "b"), ["uid", "upto"], "full")
    cut = (F.col("a").isNotNull() & F.col("b").isNotNull()).cast("int")
    running = Window.partitionBy("uid").orderBy("upto").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    member = both.withColumn("cut", cut).withColumn("grp", F.sum("cut").over(running) - F.col("cut"))
    rows = member.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("upto", "grp", "cut", "a", "b"))).alias("t"))

    def ids(side: str):
        """The ids of each group in order, joined by commas: an array by group, and one empty string."""
        marked = F.transform(F.filter("t", lambda x: x[side].isNotNull()), lambda x: F.concat(x[side].cast("string"), F.when(x["cut"] == 1, ";").otherwise(",")))
        return F.split(F.array_join(marked, ""), ";")

    n_groups = F.element_at("t", -1)["grp"] + 1
    both_ids = F.slice(F.zip_with(ids("a"), ids("b"), lambda x, y: F.concat(x, F.lit("|"), y)), 1, n_groups.cast("int"))
    whole = rows.select(
        "uid", F.array_join(both_ids, ";").alias("groups"), n_groups.alias("n_groups"),
        F.transform(F.filter("t", lambda x: x["cut"] == 1), lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"))).alias("links"),
        _known("a"), _known("b"),
    )
    # the join reuses the partitions of the parts, and rows that are sorted by part are gathered without a hash table
    with setting(tokens.sparkSession, "spark.sql.requireAllClusterKeysForCoPartition", "false"), setting(tokens.sparkSession, "spark.sql.execution.useObjectHashAggregateExec", "false"):
        return staged(whole.join(tokens.select("uid", "part", "n"), "uid"), "aligned")


def link_counts(units: DataFrame) -> DataFrame:
    """a, b, count and best (whether no other a has a higher count with this b) of every linked pair of ids."""
    pairs = units.select("n", F.explode("links").alias("l")).groupBy("l.a", "l.b").agg(F.sum("n").alias("count"))
    return pairs.withColumn("best", (F.col("count") == F.max("count").over(Window.partitionBy("b"))).cast("int"))


def valued(units: DataFrame) -> DataFrame:
    """part, groups, n_a, n_b, n_groups, n_best and count_sum of every distinct part, written."""
    links = units.select("uid", F.explode("links").alias("l")).select("uid", "l.a", "l.b")
    sums = links.join(link_counts(units), ["a", "b"]).groupBy("uid").agg(F.sum("best").alias("n_best"), F.sum("count").alias("count_sum"))
    return staged(units.select("uid", "part", "groups", "n_a", "n_b", "n_groups").join(sums, "uid").drop("uid"), "valued")


_SUMS = ("n_a", "n_b", "n_groups", "n_best", "count_sum")


def _assembled(docs: DataFrame, units: DataFrame) -> DataFrame:
    """Put each chunk's documents together from its parts."""
    names = ["doc_id", *_SUMS, "groups"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right.column("no").to_numpy())
        text = right.column("groups").combine_chunks().cast(pa.large_string()).take(pa.array(order))
        values = [right.column(c).to_numpy()[order] for c in _SUMS]
        out = []
        lists = left.column("parts").combine_chunks()
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        codes, offsets = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        at, n = 0, left.num_rows
        while at < n:  # about a million parts at a time
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + 1_000_000, side="right")) - 1)
            some, bounds = codes[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            sums = [np.diff(np.concatenate(([0], np.cumsum(v[some])))[bounds]) for v in values]
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), text.take(pa.array(some))), pa.scalar(";", text.type))
            out.append(pa.table([left.column("doc_id").slice(at, to - at), *map(pa.array, sums), joined.cast(pa.string())], names=names))
            at = to
        return pa.concat_tables(out)

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in _SUMS) + ", groups string"
    return docs.groupBy("chunk").cogroup(units.groupBy("chunk")).applyInArrow(run, schema)


def align(docs: DataFrame, a: str, b: str, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups (as "a1,a2|b1;a3|b2,b3") of every document."""
    lists, parts = parted(docs, chunk)
    tokens = tokenized(parts, a, b)
    units = aligned(tokens)
    unstage(tokens)
    values = valued(units)
    unstage(units)
    back = staged(parts.select("chunk", "no", "part").join(values, "part").drop("part"), "back")
    unstage(values, parts)
    found = _assembled(lists, back)
    return found.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups")


def digest(docs: DataFrame, a: str, b: str, chunk: int = CHUNK) -> DataFrame:
    """align() with groups_sha256 in place of groups; an empty string without tokens."""
    sha = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return align(docs, a, b, chunk).withColumn("groups_sha256", sha).drop("groups")
