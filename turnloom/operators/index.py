"""An inverted index and stored vectors, kept up to date by what has changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.functions.text import digest, trimmed, words
from turnloom.functions.vectors import encoded


def postings(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(term, key, tf): how often each word (functions.text.words) occurs in each text."""
    found = documents.where(F.col(text).isNotNull()).select(F.col(key).alias("key_"), F.explode(words(F.col(text))).alias("term"))
    return found.groupBy("term", "key_").agg(F.count(F.lit(1)).alias("tf")).select("term", F.col("key_").alias(key), "tf")


def stale(documents: DataFrame, stored: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, text_hash) of the documents whose stored hash is missing or another: what has to be indexed or encoded again.

    stored: (key, text_hash). Documents whose trimmed text is '' or NULL are never stale.
    """
    now = documents.where(trimmed(F.col(text)) != "").select(key, F.col(text).alias("text"), digest(F.col(text)).alias("text_hash"))
    return now.join(stored.select(F.col(key).alias("k_"), F.col("text_hash").alias("h_")), F.col(key) == F.col("k_"), "left").where("h_ is null or h_ != text_hash").select(key, "text", "text_hash")


def refreshed(index: DataFrame, changed: DataFrame, key: str = "doc_id") -> DataFrame:
    """The postings after the changed documents' own have been replaced."""
    kept = index.join(changed.select(F.col(key).alias("k_")).distinct(), F.col(key) == F.col("k_"), "left_anti")
    return kept.unionByName(postings(changed, key, "text"))


def backfilled(documents: DataFrame, stored: DataFrame, key: str = "doc_id", text: str = "text", size: int = 64) -> DataFrame:
    """(key, embedding, text_hash): vectors of the stale documents only."""
    return stale(documents, stored, key, text).select(key, encoded(F.col("text"), size).alias("embedding"), "text_hash")
