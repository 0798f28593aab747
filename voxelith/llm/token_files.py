"""Token-ID output: flat unsigned integer files with 64-bit document offsets.

Layout of a written folder (N is the shard's number, in document order):

    kind=ids/part-N*.txt      ids, little-endian, unsigned 16 or 32 bits, nothing else
    kind=offsets/part-N*.txt  for each document the index in its shard of its first id, little-endian 64 bits
    kind=docs/part-N*.txt     for each document its doc_id in decimal ASCII, closed by a zero byte (null: empty)
    manifest/                 Parquet: shard, first (ids of all shards before it), n_ids, n_docs, paths, width

Spark's text writer puts bytes down as they are and a separator after each
row, so each row here lacks its last byte, which is always zero (the high byte
of the end id, of an offset), and a separator of one zero byte supplies it. The files are thus committed
by Spark's own protocol on any Hadoop file system: a retried task leaves no
half-written shard. Shards are ranges of doc_id; the base of a shard is the
prefix sum of the sizes of the shards before it.

Defined cases: a null text is empty (the end id alone); a null doc_id sorts
first; rows that share a doc_id all stay, in order of their text; an empty
table gives no shards; other columns are ignored. A document of any length is
one row of its shard.
"""

from __future__ import annotations

import json
import re
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, setting, staging_path
from .tokenizing import encoder

_RAW = "kind string, seq long, payload binary"
_READ = "doc_id long, start long, n_tokens long, ids binary"


def id_width(vocab_size: int, end_id: int) -> int:
    """Bytes an id: 2 where every id fits and the end id's high byte is zero, else 4 (ids of 24 bits)."""
    if max(vocab_size - 1, end_id) < 1 << 16 and end_id < 1 << 8:
        return 2
    if max(vocab_size - 1, end_id) < 1 << 24:
        return 4
    raise ValueError("ids of at most 24 bits are supported")


def vocab_size(tokenizer: str) -> int:
    """One more than the largest id in a tokenizer file."""
    with open(tokenizer, encoding="utf-8") as f:
        spec = json.load(f)
    vocab = spec["model"]["vocab"]
    ids = vocab.values() if isinstance(vocab, dict) else range(len(vocab))
    return 1 + max([*ids, *(t["id"] for t in spec.get("added_tokens", []))])


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> int:
    """Tokenize docs (doc_id, text) and write them in ascending doc_id order under path; returns the bytes an id."""
    width = id_width(vocab_size(tokenizer), end_id)
    dtype = f"<u{width}"

    def encode(batches):
        enc = encoder(tokenizer)
        at, seq, starts, names = 0, 0, [], []
        for batch in batches:
            for first, n in enc.slices(batch.column("text")):
                part = batch.slice(first, n)
                ids, offsets = enc.encode(part.column("text"))
                ends = offsets[1:] + np.arange(1, n + 1)
                whole = np.full(len(ids) + n, end_id, dtype=dtype)
                whole[np.delete(np.arange(len(whole)), ends - 1)] = ids
                bounds = np.concatenate(([0], ends)) * width
                raw = whole.tobytes()
                rows = [raw[a : b - 1] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                starts.append(at + np.concatenate(([0], ends[:-1])))
                names.extend("" if x is None else str(x) for x in part.column("doc_id").to_pylist())
                yield _rows("ids", seq, rows)
                at, seq = at + int(ends[-1]), seq + n
        if names:
            raw = np.concatenate(starts).astype("<i8").tobytes()
            yield _rows("offsets", 0, [raw[i : i + 7] for i in range(0, len(raw), 8)])
            yield _rows("docs", 0, [x.encode() for x in names])

    spark = docs.sparkSession
    ordered = documents(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows = ordered.mapInArrow(encode, _RAW)
    shaped = rows.sortWithinPartitions("kind", "seq").select("kind", F.col("payload").cast("string").alias("value"))
    with setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", "2000"):  # texts are long
        shaped.write.option("lineSep", "\0").partitionBy("kind").text(path)
    shards(spark, path, width).write.parquet(f"{path}/manifest")
    return width


def _rows(kind: str, seq: int, payloads: list[bytes]) -> pa.RecordBatch:
    n = len(payloads)
    return pa.RecordBatch.from_arrays([pa.array([kind] * n), pa.array(range(seq, seq + n), pa.int64()), pa.array(payloads, pa.binary())], names=["kind", "seq", "payload"])


def shards(spark: SparkSession, path: str, width: int) -> DataFrame:
    """One row a shard with its base: the prefix sum over the shards before it. The driver holds one row a file."""
    found: dict[str, dict[str, tuple[str, int]]] = {}
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    for r in listed.select("path", "length").collect():
        m = re.search(r"/kind=(\w+)/(part-\d+)", unquote(r.path))
        found.setdefault(m[2], {})[m[1]] = (r.path, r.length)
    rows, first = [], 0
    for k, (_, kinds) in enumerate(sorted(found.items())):
        n_ids, n_docs = kinds["ids"][1] // width, kinds["offsets"][1] // 8
        rows.append((k, first, n_ids, n_docs, kinds["ids"][0], kinds["offsets"][0], kinds["docs"][0], width))
        first += n_ids
    return spark.createDataFrame(rows, "shard int, first long, n_ids long, n_docs long, ids_path string, offsets_path string, docs_path string, width int")


def local_path(uri: str) -> str | None:
    """The path of a file:/ address, None for other stores."""
    parts = urlparse(uri)
    return unquote(parts.path) if parts.scheme in ("", "file") else None


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (binary, as stored) of every document.

    Executors memory-map the shards where the folder is mounted; from other
    stores Spark reads each shard's three files.
    """
    table = spark.read.parquet(f"{path}/manifest")
    if local_path(path) is None:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*.txt").load(path).select("path", "content")
        for kind in ("ids", "offsets", "docs"):
            table = table.join(files.select(F.col("path").alias(f"{kind}_path"), F.col("content").alias(f"{kind}_raw")), f"{kind}_path")
    else:
        table = table.select("*", *(F.lit(None).cast("binary").alias(f"{k}_raw") for k in ("ids", "offsets", "docs")))
    n = max(spark.sparkContext.defaultParallelism, 1)
    spread = table.repartition(n, "shard") if local_path(path) is None else table.repartition(4 * n, "shard")

    def read(batches):
        for batch in batches:
            for r in batch.to_pylist():
                yield from _documents_of(r)

    return spread.mapInArrow(read, _READ)


def _mapped(r: dict, kind: str, dtype: str) -> np.ndarray:
    if r[f"{kind}_raw"] is not None:
        return np.frombuffer(r[f"{kind}_raw"], dtype=dtype)
    return np.memmap(local_path(r[f"{kind}_path"]), dtype=dtype, mode="r")


def _documents_of(r: dict, at_once: int = 2000):
    """The documents of one shard, some at a time."""
    ids, offsets = _mapped(r, "ids", f"<u{r['width']}"), _mapped(r, "offsets", "<i8")
    names = bytes(_mapped(r, "docs", "u1")).split(b"\0")[:-1]
    ends = np.concatenate((offsets[1:], [r["n_ids"]]))
    for a in range(0, len(offsets), at_once):
        b = min(a + at_once, len(offsets))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([int(x) if x else None for x in names[a:b]], pa.int64()),
                pa.array(offsets[a:b] + r["first"], pa.int64()),
                pa.array(ends[a:b] - offsets[a:b], pa.int64()),
                pa.array([ids[s:e].tobytes() for s, e in zip(offsets[a:b].tolist(), ends[a:b].tolist(), strict=True)], pa.binary()),
            ],
            names=["doc_id", "start", "n_tokens", "ids"],
        )


def token_digest(spark: SparkSession, path: str, width: int) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids as little-endian unsigned 32-bit integers, from written files."""

    def digest(batches):
        import zlib

        for batch in batches:
            crcs = [zlib.crc32(np.frombuffer(x, dtype=f"<u{width}").astype("<u4").tobytes()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return read_token_files(spark, path).mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokens_written(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write docs as token files in the shared folder, then read each document's digest back."""
    path = staging_path(docs.sparkSession, "tokens")
    return token_digest(docs.sparkSession, path, write_token_files(docs, path, tokenizer, end_id))
