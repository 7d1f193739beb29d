"""Exact duplicates by progressive refinement: length, then hash of the head, then hash of the whole text.

Texts are equal when identical after each run of ASCII white space became one space.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isohyet.llm.common import collapsed, hinted, match, store

HEAD_CHARS = 256
#: Bits a recurring key, and the most bits of a filter (32 MB).
BITS_A_KEY = 64
MOST_BITS = 1 << 28
#: Spark's bitmaps hold this many bits a row.
ROW_BITS = 1 << 15


def _bit(keys: list[str], bits: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(bits)) + 1


def _keep_recurring(rows: DataFrame, keys: list[str], flag: str, name: str) -> DataFrame:
    """`rows` with a boolean: false where no other row has the same keys, true elsewhere and for few others.

    Keys are counted map-side; those met twice set a bit each in bitmaps whose size follows their number, up to
    MOST_BITS, so they can be broadcast at any size and no text is shuffled. Two keys on one bit only let a row
    through to the next step, which tells them apart.
    """
    twice = store(rows.filter(F.col(flag)).groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").select(*keys), f"exact_{name}")
    bits = min(MOST_BITS, max(ROW_BITS, BITS_A_KEY * twice.count()))
    marks = twice.select(_bit(keys, bits).alias("__bit")).groupBy(F.bitmap_bucket_number("__bit").alias("__bucket"))
    marks = store(marks.agg(F.bitmap_construct_agg(F.bitmap_bit_position("__bit")).alias("__bits")), f"exact_{name}_bits")
    place = F.bitmap_bit_position(_bit(keys, bits))
    byte = F.conv(F.hex(F.substring(F.col("__bits"), (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    held = F.coalesce(F.floor(byte / F.pow(F.lit(2), place % 8)) % 2 == 1, F.lit(False))
    joined = rows.join(F.broadcast(marks), F.bitmap_bucket_number(_bit(keys, bits)) == F.col("__bucket"), "left")
    return joined.withColumn(flag, F.col(flag) & held).drop("__bucket", "__bits")


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", head_chars: int = HEAD_CHARS, carry: dict[str, Column] | None = None
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept and the columns of `carry` (expressions over `docs`).

    Lengths that recur let a row on to the hash of its head, (length, head) pairs that recur to the hash of its
    whole text; the rest are alone by then. Whole texts are hashed where they are read and never shuffled. The
    smallest id of a group stays. No step gathers a group: groups are aggregates, and rows get them back by joins
    that Spark can split.

    Null text counts as empty; empty texts form one group. A null id never wins over another and is kept only
    where its whole group has none. Rows that repeat one id and text are decided alike. No rows give no rows.
    """
    extra = {f"__c_{k}": v for k, v in (carry or {}).items()}
    rows = docs.select(F.col(id_col).alias("doc_id"), collapsed(text_col).alias("__norm"), *[v.alias(k) for k, v in extra.items()])
    rows = rows.withColumns({"__chars": F.length("__norm"), "__more": F.lit(True)})
    rows = _keep_recurring(rows, ["__chars"], "__more", "lengths")
    rows = rows.withColumn("__head", F.when(F.col("__more"), F.xxhash64(F.substring("__norm", 1, head_chars))))
    rows = _keep_recurring(rows, ["__chars", "__head"], "__more", "heads")
    whole = F.when(F.col("__more"), F.sha2("__norm", 256)).alias("__whole")
    # Groups and rows are stored before the join: Spark splits a hot key only where both sides come straight from a shuffle.
    keyed = store(rows.select("doc_id", "__chars", "__head", whole, *extra), "exact_keys")
    keys = ["__chars", "__head", "__whole"]
    same = keyed.filter("__whole is not null")
    groups = store(same.groupBy(*keys).agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "exact_groups")
    alone = keyed.filter("__whole is null").withColumns({"keep_id": F.col("doc_id"), "group_size": F.lit(1).cast("long")})
    return match(same, groups, keys).unionByName(alone).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        *[F.col(k).alias(k[4:]) for k in extra],
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, of which the text's smallest id stays."""
    digest = F.sha2(collapsed(text_col), 256)
    gone = exact_duplicates(docs, id_col, text_col, carry={"__digest": digest}).filter("not kept")
    gone = hinted(store(gone.select(F.col("doc_id").alias(id_col), "__digest").distinct(), "exact_gone"), 96)
    return match(docs.withColumn("__digest", digest), gone, [id_col, "__digest"], "left_anti").drop("__digest")
