"""Rows with or without keys of another table, where neither side may be broadcast or moved as a whole.

The keys set bits of a table of BITS bits, which is all that is broadcast: BITS / 8 bytes, however many keys there
are. Rows whose bit isn't set have none of the keys and stay where they are; only the others move to an exact join.
With more keys than bits the table says little and every row moves, as in a plain join; the result is the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.session import cut_lineage

#: Bits of a table: 8 MB, in rows of 4 kB.
BITS = 1 << 26


def _place(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BITS)) + 1


def bit_table(keys: DataFrame, key: str) -> DataFrame:
    """(bucket_, bits_): the bits that the keys set, at most BITS / 32768 rows of 4 kB. NULL keys set none."""
    at = keys.where(F.col(key).isNotNull()).select(_place(F.col(key)).alias("at_"))
    return at.groupBy(F.bitmap_bucket_number("at_").alias("bucket_")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at_")).alias("bits_"))


def _flagged(df: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """df with maybe_: whether its key's bit is set; never false for a key of the table."""
    place = _place(F.col(key))
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("bits_", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    set_ = F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(1) == 1
    return df.join(F.broadcast(table), F.bitmap_bucket_number(place) == F.col("bucket_"), "left").withColumn("maybe_", F.coalesce(set_, F.lit(False))).drop("bucket_", "bits_")


def having(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows of df whose key occurs in keys; keys has a column of that name. Rows that can't have one aren't moved."""
    own = keys.select(key)
    return _flagged(df, cut_lineage(bit_table(own, key)), key).where("maybe_").drop("maybe_").join(own.hint("merge"), key, "left_semi")


def lacking(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows of df whose key doesn't occur in keys, those with a NULL key too. What had to be moved is written once."""
    own = keys.select(key)
    rows = _flagged(df, cut_lineage(bit_table(own, key)), key)
    moved = cut_lineage(rows.where("maybe_").drop("maybe_").join(own.hint("merge"), key, "left_anti"))
    return rows.where("not maybe_").drop("maybe_").unionByName(moved)


def looked_up(df: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """df with the other columns of table by key, NULL where it has none: a left join that moves only rows that may have a partner."""
    rows = _flagged(df, cut_lineage(bit_table(table.select(key), key)), key)
    more = [f for f in table.schema.fields if f.name != key]
    moved = rows.where("maybe_").drop("maybe_").join(table.hint("merge"), key, "left").select(*df.columns, *[f.name for f in more])
    return rows.where("not maybe_").select(*df.columns, *[F.lit(None).cast(f.dataType).alias(f.name) for f in more]).unionByName(moved)
