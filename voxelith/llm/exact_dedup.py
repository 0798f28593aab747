"""Exact dedup by content-defined chunk recipes, in DataFrame operations only.

Each text, A-Z lower-cased, is cut where its content says so: after at least
MIN_CHUNK characters at the first place that looks like BOUNDARY, after
MAX_CHUNK at the latest. A chunk's identifier is its 64-bit hash, verified: the
chunks that share one must share their SHA-256 too. A document's recipe is the
ordered list of its verified identifiers, and two texts are equal where their
recipes are; a document that holds an identifier which failed is compared by
the SHA-256s of its chunks instead. Only identifiers and digests move between
executors, never texts, and each text is read once.

Groups are counted with partial sums before the shuffle. Group results go back
to the documents by a join of two plain shuffles, which Spark splits where one
group holds a large part of the rows.

Defined cases: a null text is empty, and empty texts are equal; of repeated
rows (same doc_id, same text) one stays, in `keep_one` as in `groups`; null
doc_ids count as smallest; an empty table gives no row; other columns are
ignored by `groups` and kept by `keep_one`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_name, numbered, staged

MIN_CHUNK, MAX_CHUNK = 1024, 8192
#: Two characters of text that end a chunk: common enough, and blind to what stands before.
BOUNDARY = r"[aeiou][ \n][b-df-hj-np-tv-z]"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased and nothing else; plain ASCII texts by the faster function."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def chunks(text: Column) -> Column:
    """The content-defined chunks of a text in order; they concatenate to the text."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{{MIN_CHUNK - 3},{MAX_CHUNK - 3}}}?{BOUNDARY}|.{{1,{MAX_CHUNK}}}"), F.lit(0))


def recipes(docs: DataFrame, row: str | None = None) -> DataFrame:
    """doc_row (the column `row`, or a number given here), doc_id, text_sha256 and chunks (id, sha) of each document, written to the shared folder."""
    number = F.col(row) if row else F.monotonically_increasing_id()
    norm = docs.select(number.alias("doc_row"), F.col("doc_id").cast("long").alias("doc_id"), lower_ascii(F.coalesce(F.col("text"), F.lit(""))).alias("norm"))
    digests = norm.select(
        "doc_row",
        "doc_id",
        F.sha2("norm", 256).alias("text_sha256"),
        F.transform(chunks(F.col("norm")), lambda c: F.struct(F.xxhash64(c).alias("id"), F.unhex(F.sha2(c, 256)).alias("sha"))).alias("chunks"),
    )
    return staged(digests, "recipes")


def verified(found: DataFrame) -> DataFrame:
    """Adds recipe: the ordered verified identifiers, or the digests where an identifier stands for two chunks."""
    each = found.select("doc_row", F.explode("chunks").alias("c")).select("doc_row", "c.id", "c.sha")
    failed = each.groupBy("id").agg(F.min("sha").alias("low"), F.max("sha").alias("high")).where("low != high").select("id")
    unsure = each.join(failed, "id", "left_semi").select("doc_row").distinct().withColumn("unsure", F.lit(True))
    ids = F.transform("chunks", lambda c: F.hex(c["id"]))
    shas = F.transform("chunks", lambda c: F.hex(c["sha"]))
    both = found.join(unsure, "doc_row", "left")
    return both.select("doc_row", "doc_id", "text_sha256", F.array_join(F.when(F.col("unsure"), shas).otherwise(ids), ".").alias("recipe"))


def _grouped(docs: DataFrame, row: str | None = None) -> DataFrame:
    """Each document with its recipe, its group's size and keep: doc_id and doc_row of the row that stays."""
    listed = staged(verified(recipes(docs, row)), "verified")
    sums = listed.groupBy("recipe").agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", "doc_row")).alias("keep"))
    return listed.join(staged(sums, "groups").hint("merge"), "recipe")


def groups(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256."""
    return _grouped(docs).select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("doc_row") == F.col("keep.doc_row")).alias("kept"), "text_sha256")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs, all columns, with one row of each group of equal texts: that with the largest doc_id, of repeated rows any one."""
    row = fresh_name(docs, "row")
    known = numbered(docs, row)
    listed = staged(verified(recipes(known, row)), "verified")
    staying = listed.groupBy("recipe").agg(F.max(F.struct("doc_id", "doc_row")).alias("keep")).select(F.col("keep.doc_row").alias(row))
    return known.join(staged(staying, "staying").hint("merge"), row, "left_semi").select(*docs.columns)


SQL = f"""with n as (select doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') t from documents),
  g as (select t, max(doc_id) keep_id, count(*) group_size from n group by t)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(t) as text_sha256 from n join g using (t)"""
