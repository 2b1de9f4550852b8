"""Exact deduplication by two-pass Bloom filtering, in DataFrame operations only.

Texts are equal when identical without the characters space, \\t, \\n, \\v, \\f and \\r. The first pass counts how many
rows fall on each bit of a Bloom filter (two bits a row) and keeps the bits that two rows or more share; the second
pass tests every row against these bits. A row with a bit of its own has no equal and passes straight through;
only the others shuffle, by their SHA-256, and are compared exactly.

The filter has 16 bits a row up to ``max_bits``, so what is broadcast has a fixed bound (one row of 16 bytes for 64
bits). On a larger corpus the filter is fuller and lets more rows through to the shuffle, which stays exact; what
shuffles is a digest (about 100 bytes), never a text that is not possibly repeated.

Nulls: a missing text is the empty one; a row without doc_id loses against any with one. Of rows that are equal in
length and doc_id, one stays. Further columns are kept by ``deduplicate`` and ignored by ``duplicate_report``. Empty
tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.llm.shared import stored, text_of

WHITE = " \t\n\x0b\x0c\r"
MAX_BITS = 1 << 26
#: A group of more than this share of all rows is joined by broadcast; there are at most 1 / HEAVY such groups.
HEAVY = 0.001


def normalised(text: Column) -> Column:
    """A text without white space."""
    return F.translate(text, WHITE, "")


def _slots(bits: int) -> tuple[Column, Column]:
    return F.col("h").bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned("h", 32).bitwiseAND(F.lit(bits - 1))


def _bit(slot: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))


def repeated_bits(hashes: DataFrame, bits: int) -> DataFrame:
    """First pass: (word, mask) of the filter's bits on which two rows or more of ``hashes`` (h) fall."""
    a, b = _slots(bits)
    # A row whose two bits coincide counts once.
    slots = hashes.select(F.explode(F.array_distinct(F.array(a, b))).alias("slot"))
    twice = slots.groupBy("slot").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return twice.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(_bit(F.col("slot"))).alias("mask"))


def maybe_repeated(rows: DataFrame, words: DataFrame, bits: int) -> DataFrame:
    """Second pass: rows (with h) with a boolean column ``maybe``. words has at most bits / 64 rows, bits at most max_bits."""
    out = rows
    for i, slot in enumerate(_slots(bits)):
        side = F.broadcast(words.select(F.col("word").alias(f"_w{i}"), F.col("mask").alias(f"_m{i}")))
        out = out.join(side, F.shiftright(slot, 6) == F.col(f"_w{i}"), "left")
        out = out.withColumn(f"_t{i}", F.coalesce(F.col(f"_m{i}").bitwiseAND(_bit(slot)) != 0, F.lit(False))).drop(f"_w{i}", f"_m{i}")
    return out.withColumn("maybe", F.col("_t0") & F.col("_t1")).drop("_t0", "_t1")


def filter_bits(n_rows: int, max_bits: int = MAX_BITS) -> int:
    """The filter's size: a power of two, 16 bits a row or more, but for the bound."""
    return min(max_bits, 1 << max(10, (16 * n_rows).bit_length()))


def _digest(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", text_of().alias("text"))
    rows = rows.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", F.length("text").cast("long").alias("n"), F.sha2(normalised(F.col("text")), 256).alias("sha"))
    return rows.withColumn("h", F.xxhash64("sha"))


def _order(*last: str) -> Column:
    """Greatest for the row that stays; ~x falls as x rises, without overflow."""
    return F.struct(F.col("n"), F.col("doc_id").isNotNull().alias("known"), F.bitwise_not(F.coalesce("doc_id", F.lit(0))).alias("down"), *[F.bitwise_not(c).alias(c) for c in last])


def duplicate_report(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """A row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    The digests are written once; the row numbers in them tell rows apart that are equal in every column.
    """
    digest = stored(_digest(docs), "digest")
    n_rows = digest.count()
    bits = filter_bits(n_rows, max_bits)
    tested = maybe_repeated(digest, stored(repeated_bits(digest, bits), "bits"), bits)
    alone = tested.where(~F.col("maybe"))
    again = tested.where("maybe")
    groups = again.groupBy("sha").agg(F.count(F.lit(1)).alias("group_size"), F.max(_order("row_id")).alias("best")).where("group_size > 1")
    groups = groups.select("sha", "group_size", F.when(F.col("best.known"), F.bitwise_not("best.down")).alias("keep_id"), F.bitwise_not("best.row_id").alias("keep_row"))
    groups = stored(groups, "groups")
    is_heavy = F.col("group_size") > F.lit(max(1000, int(HEAVY * n_rows)))
    heavy, light = groups.where(is_heavy), groups.where(~is_heavy)
    hot = again.join(F.broadcast(heavy), "sha")
    cool = again.join(F.broadcast(heavy.select("sha")), "sha", "left_anti").join(light, "sha", "left")
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]

    def said(df: DataFrame) -> DataFrame:
        single = F.col("keep_row").isNull()
        return df.select(
            "doc_id",
            F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
            (single | (F.col("row_id") == F.col("keep_row"))).alias("kept"),
            F.col("sha").alias("text_sha256"),
        )

    passed = alone.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"))
    return passed.unionByName(said(hot)).unionByName(said(cool)).select(*columns)


def deduplicate(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """docs without repeats, all columns. Rows with a bit of their own are not shuffled; copies are reduced before they are."""
    names = docs.columns
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.sha2(normalised(text_of()), 256).alias("sha")).withColumn("h", F.xxhash64("sha"))
    hashes = stored(keyed.select("h"), "hashes")
    bits = filter_bits(hashes.count(), max_bits)
    tested = maybe_repeated(keyed, stored(repeated_bits(hashes, bits), "bits"), bits)
    doc_id = F.col("row.doc_id")
    order = F.struct(F.length(F.coalesce(F.col("row.text"), F.lit(""))).alias("n"), doc_id.isNotNull().alias("known"), F.bitwise_not(F.coalesce(doc_id, F.lit(0))).alias("down"), F.col("row.text").alias("tie"))
    # Of each group one row is chosen by its order alone; its text follows once.
    best = tested.where("maybe").groupBy("sha").agg(F.max_by("row", order).alias("row"))
    return tested.where(~F.col("maybe")).select("row.*").unionByName(best.select("row.*"))


DUPLICATE_SQL = """
with d as (select doc_id, coalesce(text, '') as t from documents),
s as (select doc_id, length(t) as n, sha256(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) as text_sha256 from d),
w as (select *, first_value(doc_id) over g as keep_id, row_number() over g as nth, count(*) over (partition by text_sha256) as group_size
      from s window g as (partition by text_sha256 order by n desc, doc_id nulls last))
select doc_id, keep_id, group_size, nth = 1 as kept, text_sha256 from w
"""
