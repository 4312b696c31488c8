"""Mixing sources to target weights by weighted sampling without replacement, in token budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.llm.tokens import count_of
from turnloom.session import cut_lineage

#: Slices of the key range of a source; prefix sums go over slices first, then within one slice.
SLICES = 4096


def quality(text: Column) -> Column:
    """A weight in [0.1, 1] of a document: the share of letters among its characters, less for very short texts."""
    length = F.length(text)
    letters = F.length(F.regexp_replace(text, r"[^\p{L}\s]", ""))
    return F.greatest(F.lit(0.1), F.coalesce(F.try_divide(letters, length) * F.least(F.lit(1.0), length / 200), F.lit(0.1)))


def sample_key(weight: Column, *ids: Column, seed: int = 0) -> Column:
    """An exponential key of rate weight (Efraimidis-Spirakis): taking rows by rising key draws them by weight.

    The uniform number behind it is a hash of the ids and the seed, so a task that runs again gives the same key.
    """
    unit = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *ids), 11).cast("double") + 0.5) / float(2**53)
    return -F.log(unit) / weight


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 0, rank_file: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(picks, report).

    picks: (doc_id, source, tokens, copies), copies > 0: how often each document is used.
    report: (source, documents, source_tokens, weight, target_share, target_tokens, mixed_tokens, actual_share,
    epochs, max_repeats) of each source of either table.

    The total is total_tokens, or the largest at which every source that has both a target and tokens can
    hold its weight within max_repeats. Weights of targets without any tokens go to the others in
    proportion; target_share is the weight as stated. A source's budget is filled by complete epochs of all
    its documents, then by rising sample key as long as the prefix sum stays within the budget, so a source
    falls short of it by less than one document. Sources without a target and documents without
    tokens (NULL, '') or without a source aren't used. A source given twice in targets has its weights summed and
    the least max_repeats; NULL or negative weights and repeats count as 0. Repeated rows are documents of
    their own; ties of keys go by doc_id.

    Prefix sums are taken over SLICES key slices a source, then row by row in the one slice in which the
    budget ends: a source with a third of all rows is never sorted in one task.
    """
    wanted = targets.where("source is not null").groupBy("source").agg(F.sum(F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0))).alias("weight"), F.min(F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0))).alias("max_repeats"))
    sized = documents.select("doc_id", "source", count_of(F.col("text"), rank_file).alias("tokens"), sample_key(quality(F.col("text")), F.col("doc_id"), seed=seed).alias("key"))
    # few wide rows become many narrow ones: written once, read by each pass
    sized = cut_lineage(sized.withColumn("slice", F.floor((1 - F.exp(-F.col("key"))) * SLICES).cast("int")))
    usable = sized.where("tokens > 0 and source is not null")
    sizes = sized.where("source is not null").groupBy("source").agg(F.sum("tokens").alias("source_tokens"), F.count(F.lit(1)).alias("documents"))
    plan = wanted.join(sizes, "source", "full").fillna(0, ["source_tokens", "documents", "weight", "max_repeats"])
    active = (F.col("weight") > 0) & (F.col("source_tokens") > 0) & (F.col("max_repeats") > 0)
    # one row a source from here to the budgets: mix_targets bounds those with a target
    totals = plan.where(active).select(F.sum("weight").alias("all_weight"), F.min(F.col("source_tokens") * F.col("max_repeats") / F.col("weight")).alias("reach"))
    share = F.when(active, F.col("weight") / F.col("all_weight")).otherwise(0.0)
    total = F.lit(float(total_tokens)) if total_tokens is not None else F.col("reach") * F.col("all_weight")
    budget = F.floor(F.coalesce(share * total, F.lit(0.0)) + 1e-6).cast("long")
    most = F.col("source_tokens") * F.col("max_repeats")
    plan = plan.join(F.broadcast(totals)).withColumn("target_tokens", F.least(budget, most))
    plan = cut_lineage(plan.withColumn("epochs", F.when(F.col("source_tokens") > 0, F.floor(F.col("target_tokens") / F.col("source_tokens"))).otherwise(0).cast("int")).withColumn("rest", F.col("target_tokens") - F.col("epochs") * F.col("source_tokens")))
    slices = usable.groupBy("source", "slice").agg(F.sum("tokens").alias("slice_tokens"))
    running = slices.withColumn("before", F.sum("slice_tokens").over(Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)))
    cut = running.join(plan.where("target_tokens > 0").select("source", "epochs", "rest"), "source").select("source", "slice", "epochs", "rest", F.coalesce("before", F.lit(0)).alias("before"), "slice_tokens")
    placed = usable.join(cut, ["source", "slice"])
    whole = placed.where("before + slice_tokens <= rest or before >= rest").select("doc_id", "source", "tokens", (F.col("epochs") + F.when(F.col("before") + F.col("slice_tokens") <= F.col("rest"), 1).otherwise(0)).alias("copies"))
    edge = placed.where("before + slice_tokens > rest and before < rest").withColumn("sum", F.col("before") + F.sum("tokens").over(Window.partitionBy("source", "slice").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)))
    partial = edge.select("doc_id", "source", "tokens", (F.col("epochs") + F.when(F.col("sum") <= F.col("rest"), 1).otherwise(0)).alias("copies"))
    picks = whole.unionByName(partial).where("copies > 0")
    mixed = picks.groupBy("source").agg(F.sum(F.col("tokens").cast("long") * F.col("copies")).alias("mixed_tokens"))
    everything = mixed.select(F.sum("mixed_tokens").alias("all_tokens"))
    report = plan.join(mixed, "source", "left").join(F.broadcast(everything)).select(
        "source", "documents", "source_tokens", "weight", F.col("weight").alias("target_share"), "target_tokens", F.coalesce("mixed_tokens", F.lit(0)).alias("mixed_tokens"),
        (F.coalesce("mixed_tokens", F.lit(0)) / F.col("all_tokens")).alias("actual_share"), "epochs", "max_repeats",
    )
    return picks, report.drop("weight")
