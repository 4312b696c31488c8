"""Classes of copies expanded to pairs of rows, block by block, so that no class is one task's work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Copies of one class that meet in one task, at most about.
COPIES = 1024


def _blocks() -> Column:
    """Into how many blocks the copies of a class are split."""
    return F.ceil(F.col("members") / F.lit(COPIES)).cast("int")


def _blocked(members: DataFrame) -> DataFrame:
    return members.select("rep", "id", _blocks().alias("blocks"), F.pmod(F.xxhash64("id"), _blocks()).cast("int").alias("block"))


def between(met: DataFrame, members: DataFrame) -> DataFrame:
    """(x, y): every member x of class a and y of class b of each row of met (a, b, blocks_a, blocks_b); see blocks_of.

    members: (rep, id, members), a row per id with its class and the number of ids that the class has.
    """
    copies = _blocked(members)
    for side, name in (("a", "x"), ("b", "y")):
        met = met.withColumn("block", F.explode(F.sequence(F.lit(0), F.col(f"blocks_{side}") - 1)))
        met = met.join(copies.select(F.col("rep").alias(side), "block", F.col("id").alias(name)), [side, "block"]).drop("block", f"blocks_{side}")
    return met.select("x", "y")


def blocks_of(heads: DataFrame, head: str, blocks: str) -> DataFrame:
    """(head, blocks) of classes (rep, members), for the rows that between wants."""
    return heads.select(F.col("rep").alias(head), _blocks().alias(blocks))


def within(members: DataFrame) -> DataFrame:
    """(x, y), x < y: every two ids of one class; members as in between. Every two blocks of a class meet once."""
    same = _blocked(members.where("members > 1"))
    left = same.select("rep", F.col("id").alias("x"), F.col("block").alias("i"), F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)).alias("j"))
    right = same.select("rep", F.col("id").alias("y"), F.col("block").alias("j"), F.explode(F.sequence(F.lit(0), F.col("block"))).alias("i"))
    return left.join(right, ["rep", "i", "j"]).where("(i = j and x < y) or i < j").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
