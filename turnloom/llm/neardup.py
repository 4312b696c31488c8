"""Near-duplicates by exact Jaccard similarity of word shingles, without comparing all pairs.

Texts are points of group counts: shingles are hashed into groups, and the overlap of two texts is at most the
sum over groups of the lesser count. Three such bounds are used, from coarse to fine:

* A table of group frequencies over the whole corpus gives one order of all shingles, rarest first. Two
  texts of similarity t must share one of their first n - ceil(t n) + 1 shingles in it, which gives the cells
  of the index: a text is entered under each of those shingles and meets only what shares a cell.
* Cells with more than HOT texts are split into tiles, the leaves of an R-tree: by size and by hash, each with
  its bounding box of size and group counts. Two tiles are joined only if the summed minima of their boxes
  reach the overlap that their smallest texts need.
* Two texts of a cell become candidates only if their positions in the order, the summed minima of their group
  counts and the parity of their counts (each differing bit is a shingle in one text only) leave room.

What survives is verified with the whole shingle sets. Every bound is a proof, so the result is exact: no text,
partner or candidate is dropped.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.llm.expand import between, blocks_of, within
from turnloom.operators.keys import having, lacking
from turnloom.session import cut_lineage

#: Groups of the frequency table, at least and at most: a group for about four shingles, a byte each, so the table has 8 MB at most.
LEAST_GROUPS, MOST_GROUPS = 1 << 16, 1 << 23
#: Counts of the frequency table that are added up in one row.
_CHUNK = 1 << 14
#: Tables of tasks that are added up in one group at most is their number divided by this.
_SALT = 32
#: Texts of a cell from which it is split, and texts of a tile, about.
HOT = 4096
#: Coordinates of the points that boxes bound; a count takes seven bits of a long.
GROUPS = 8


def words(text: Column) -> Column:
    """The longest runs of a-z and 0-9 in the lower-cased text, in order."""
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def shingled(texts: DataFrame, size: int, least_words: int) -> DataFrame:
    """(id, shingles): the set of hashes of size successive words, of each text of least_words words or more.

    Written once to the checkpoint folder: every later step would compute the sets again, and a filter on
    them would even be pushed below their computation and double it.
    """
    rows = texts.where(F.length("text") >= 2 * least_words - 1).select("id", words(F.col("text")).alias("words"))
    at = lambda i: F.get("words", i)
    hashes = F.transform(F.slice("words", F.lit(1), F.greatest(F.size("words") - (size - 1), F.lit(0))), lambda w, i: F.xxhash64(w, *[at(i + k) for k in range(1, size)]))
    return cut_lineage(rows.select("id", F.when(F.size("words") >= max(least_words, size), F.array_distinct(hashes)).alias("shingles"))).where("shingles is not null")


def classes(sets: DataFrame) -> DataFrame:
    """(id, rep, members, n): for each text with shingles the least id with the same set, how many have it, and the set's size."""
    key = [F.xxhash64(F.array_sort("shingles")).alias("k1"), F.xxhash64(F.lit(7), F.array_sort("shingles")).alias("k2")]
    keyed = sets.select("id", *key, F.size("shingles").alias("n"))
    heads = keyed.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("members"))
    return cut_lineage(keyed.join(heads.hint("merge"), ["k1", "k2"]).select("id", "rep", "members", "n"))


def _packed(counts: np.ndarray) -> bytes:
    """Counts in the fewest bytes that hold the largest, compressed; the first byte says how many."""
    size = next(n for n in (1, 2, 4, 8) if int(counts.max()) < 1 << 8 * n - (n == 8))
    return bytes([size]) + zlib.compress(counts.astype(f"<u{size}").tobytes(), 1)


def _unpacked(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed[1:]), dtype=f"<u{packed[0]}").astype(np.int64)


def _added(table: pa.Table) -> pa.Table:
    total = np.zeros(_CHUNK, dtype=np.int64)
    for packed in table["counts"].to_pylist():
        total += _unpacked(packed)
    return table.slice(0, 1).set_column(table.schema.get_field_index("counts"), "counts", pa.array([_packed(total)], pa.binary()))


def level(counts: np.ndarray | int) -> np.ndarray:
    """Counts on a scale of one byte, eight steps to the double; never falls as a count grows."""
    return np.minimum(255, np.where(np.asarray(counts) > 0, 1 + np.floor(8 * np.log2(np.maximum(counts, 1))), 0)).astype(np.uint8)


def frequencies(sets: DataFrame, shingles: int) -> np.ndarray:
    """The level of how many of the corpus's shingles (shingles of them) fall into each group: LEAST_GROUPS to MOST_GROUPS bytes.

    Each task counts its own texts into a table and sends it packed, so no shingle is moved.
    """
    groups = min(MOST_GROUPS, max(LEAST_GROUPS, (1 << max(shingles, 1).bit_length()) // 4))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(groups, dtype=np.int64)
        for batch in batches:
            np.add.at(table, batch.column(0).flatten().to_numpy() & (groups - 1), 1)
        salt = (TaskContext.get().partitionId() if TaskContext.get() else 0) % _SALT
        for i in range(groups // _CHUNK):
            part = table[i * _CHUNK : (i + 1) * _CHUNK]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([salt], pa.int32()), pa.array([_packed(part)], pa.binary())], names=["chunk", "salt", "counts"])

    schema = "chunk int, salt int, counts binary"
    parts = sets.select("shingles").mapInArrow(count, schema).groupBy("chunk", "salt").applyInArrow(_added, schema).groupBy("chunk").applyInArrow(_added, schema)
    levels = parts.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([b.column(0), pa.array([level(_unpacked(c)).tobytes() for c in b.column(2).to_pylist()], pa.binary())], names=["chunk", "levels"]) for b in batches), "chunk int, levels binary")
    table = np.zeros(groups, dtype=np.uint8)
    for row in levels.collect():
        table[row.chunk * _CHUNK : (row.chunk + 1) * _CHUNK] = np.frombuffer(bytes(row.levels), dtype=np.uint8)
    return table


ENTRIES = "token bigint, id bigint, n int, pos int, p1 bigint, p2 bigint, counts bigint, busy boolean"
_ENTRIES = pa.schema([("token", pa.int64()), ("id", pa.int64()), ("n", pa.int32()), ("pos", pa.int32()), ("p1", pa.int64()), ("p2", pa.int64()), ("counts", pa.int64()), ("busy", pa.bool_())])


def entries_of(ids: np.ndarray, lengths: np.ndarray, tokens: np.ndarray, table: np.ndarray, threshold: float, hot: int) -> list[np.ndarray]:
    """The columns of ENTRIES for texts given by their ids, set sizes and shingles one after another (no set is empty); table: frequencies."""
    doc = np.repeat(np.arange(len(ids)), lengths)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    frequency = table[tokens & (len(table) - 1)]
    order = np.lexsort((tokens, frequency, doc))
    position = np.arange(len(tokens)) - starts[doc]
    bits = (tokens >> 20) & 127
    one = np.left_shift(np.int64(1), bits & 63)
    p1 = np.bitwise_xor.reduceat(np.where(bits < 64, one, 0), starts)
    p2 = np.bitwise_xor.reduceat(np.where(bits < 64, 0, one), starts)
    group = np.bincount(doc * GROUPS + ((tokens >> 40) & (GROUPS - 1)), minlength=len(ids) * GROUPS).reshape(-1, GROUPS)
    packed = (group << (7 * np.arange(GROUPS))).sum(axis=1)
    packed = np.where(group.max(axis=1) > 127, -1, packed)  # -1: too large for this bound
    keep = position < (lengths - np.ceil(threshold * lengths - 1e-9).astype(np.int64) + 1)[doc]
    d = doc[keep]
    picked = order[keep]
    return [tokens[picked], ids[d], lengths[d].astype(np.int32), position[keep].astype(np.int32), p1[d], p2[d], packed[d], frequency[picked] >= level(hot + 1)]


def entries(sets: DataFrame, table: np.ndarray, threshold: float, hot: int, busy: bool = False) -> DataFrame:
    """The rows of the index: each text under each of its first shingles; see ENTRIES. busy: only those of groups with more than hot shingles."""
    shared = sets.sparkSession.sparkContext.broadcast(table)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            lengths = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            full = lengths > 0
            if full.any():
                columns = entries_of(batch.column(0).to_numpy()[full], lengths[full], lists.flatten().to_numpy(), shared.value, threshold, hot)
                columns = [c[columns[-1]] for c in columns] if busy else columns
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=_ENTRIES)

    return sets.select("id", "shingles").mapInArrow(rows, ENTRIES)


def needed(na: Column, nb: Column, threshold: float) -> Column:
    """The least overlap at which sets of these sizes have the similarity."""
    return F.ceil((na + nb) * F.lit(threshold / (1 + threshold)) - 1e-6)


def summed_minima(a: Column, b: Column) -> Column:
    """The sum over groups of the lesser count of two packed points."""
    coordinate = lambda x, i: F.shiftright(x, 7 * i).bitwiseAND(127)
    total = F.least(coordinate(a, 0), coordinate(b, 0))
    for i in range(1, GROUPS):
        total = total + F.least(coordinate(a, i), coordinate(b, i))
    return total


def may_reach(threshold: float) -> Column:
    """The bounds on two entries x and y of one cell: sizes, positions, parity and group counts."""
    c = F.col
    na, nb = c("x.n"), c("y.n")
    need = needed(na, nb, threshold)
    room = 1 + F.least(na - c("x.pos"), nb - c("y.pos")) - 1
    differing = F.bit_count(c("x.p1").bitwiseXOR(c("y.p1"))) + F.bit_count(c("x.p2").bitwiseXOR(c("y.p2")))
    counts = (c("x.counts") < 0) | (c("y.counts") < 0) | (summed_minima(c("x.counts"), c("y.counts")) >= need)
    return (c("x.id") < c("y.id")) & (F.least(na, nb) >= need) & (room >= need) & (differing <= na + nb - 2 * need) & counts


def _hot_candidates(rows: DataFrame, cells: DataFrame, threshold: float, hot: int) -> DataFrame:
    """Candidates of the cells that are too large for one task: tiles, their boxes, and the pairs of tiles that may hold pairs."""
    sized = rows.join(cells, "token").withColumns({
        "tile": F.struct(F.floor(F.log(F.col("n").cast("double")) / np.log(1.2)).cast("int").alias("size"), F.pmod(F.xxhash64("id"), F.ceil(F.col("texts") / hot)).cast("int").alias("part")),
    }).drop("texts", "busy")
    sized = cut_lineage(sized)
    # a point that overflowed may have all its set in any one group
    most = lambda i: F.max(F.when(F.col("counts") < 0, F.col("n")).otherwise(F.shiftright("counts", 7 * i).bitwiseAND(127))).alias(f"c{i}")
    boxes = cut_lineage(sized.groupBy("token", "tile").agg(F.min("n").alias("low"), F.max("n").alias("high"), *[most(i) for i in range(GROUPS)]))
    a, b = boxes.alias("a"), boxes.alias("b")
    bound = sum((F.least(f"a.c{i}", f"b.c{i}") for i in range(1, GROUPS)), F.least("a.c0", "b.c0"))
    least = needed(F.col("a.low"), F.col("b.low"), threshold)
    fits = (F.col("a.tile") <= F.col("b.tile")) & (F.least("a.high", "b.high") >= least) & (F.col("a.high") >= F.col("b.low") * threshold) & (F.col("b.high") >= F.col("a.low") * threshold) & (bound >= least)
    met = cut_lineage(a.join(b, F.col("a.token") == F.col("b.token")).where(fits).select(F.col("a.token").alias("token"), F.col("a.tile").alias("ta"), F.col("b.tile").alias("tb")))
    left = met.join(sized.withColumnRenamed("tile", "ta"), ["token", "ta"])
    right = met.join(sized.withColumnRenamed("tile", "tb"), ["token", "tb"])
    on = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in ("token", "ta", "tb")]
    pack = lambda side: F.struct(*[F.col(f"{side}.{k}") for k in ("id", "n", "pos", "p1", "p2", "counts")])
    # within a pair of tiles each side may hold the lesser id
    both = left.alias("l").join(right.alias("r"), on).select(F.when(F.col("l.id") < F.col("r.id"), pack("l")).otherwise(pack("r")).alias("x"), F.when(F.col("l.id") < F.col("r.id"), pack("r")).otherwise(pack("l")).alias("y"))
    return both.where(may_reach(threshold)).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))


def candidates(sets: DataFrame, shingles: int, threshold: float, hot: int = HOT) -> DataFrame:
    """(a, b), a < b: the pairs of texts that no bound rules out, each once. shingles: how many the sets have, about."""
    table = frequencies(sets, shingles)
    rows, large = entries(sets, table, threshold, hot), None
    if table.max() >= level(hot + 1):
        # the table bounds the size of every cell, so only entries of busy groups are counted one by one
        full = cut_lineage(entries(sets, table, threshold, hot, busy=True))
        cells = cut_lineage(full.groupBy("token").agg(F.count(F.lit(1)).alias("texts")).where(F.col("texts") > hot))
        if not cells.isEmpty():
            large = _hot_candidates(full, cells, threshold, hot)
            rows = rows.join(cells.select("token"), "token", "left_anti")
    rows = rows.select("token", "id", "n", "pos", "p1", "p2", "counts")
    found = rows.alias("x").join(rows.alias("y"), F.col("x.token") == F.col("y.token")).where(may_reach(threshold)).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    return (found if large is None else found.unionByName(large)).distinct()


def similar_classes(texts: DataFrame, size: int, least_words: int, threshold: float, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): classes of equal sets, and (a, b, similarity), a < b, of their representatives, verified on whole sets."""
    sets = shingled(texts, size, least_words)
    members = classes(sets)
    heads = lacking(sets, members.where("id != rep"), "id")
    shingles = members.where("id = rep").agg(F.sum("n")).first()[0] or 0
    pairs = cut_lineage(candidates(heads, shingles, threshold, hot))
    asked = cut_lineage(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    # the texts asked for are read and hashed again: a text moves cheaper than its set
    few = shingled(having(texts, asked, "id"), size, least_words)
    both = pairs.join(few.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a").join(few.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    scored = both.select("a", "b", (shared / (F.size("sa") + F.size("sb") - shared)).alias("similarity"))
    return members, scored.where(F.col("similarity") >= threshold)


def _prepared(texts: DataFrame, key: str, text: str) -> DataFrame:
    return texts.select(F.col(key).alias("id"), F.col(text).alias("text")).where("text is not null")


def similar_pairs(texts: DataFrame, key: str = "id", text: str = "text", size: int = 5, least_words: int = 5, threshold: float = 0.8, hot: int = HOT) -> DataFrame:
    """(id_a, id_b), id_a < id_b: every two rows of the similarity or more, copies included.

    NULL, empty and short texts (under least_words words) take no part. Keys must be unique; rows with equal
    texts are copies of one class, compared once and expanded at the end.
    """
    rows = _prepared(texts, key, text)
    members, met = similar_classes(rows, size, least_words, threshold, hot)
    heads = members.where("id = rep")
    sized = met.select("a", "b").join(blocks_of(heads, "a", "blocks_a"), "a").join(blocks_of(heads, "b", "blocks_b"), "b")
    both = between(sized, members).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    return both.unionByName(within(members).toDF("id_a", "id_b"))


def components(edges: DataFrame) -> DataFrame:
    """(id, group_id) of each end of an edge (a, b): the least id that it is connected with.

    Each round takes the least label of the neighbours and of the label's own label (pointer jumping), until
    nothing changes; labels are kept in the checkpoint folder, never on the driver.
    """
    ways = cut_lineage(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    label = cut_lineage(ways.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("group_id")))
    while True:
        near = ways.join(label, F.col("b") == F.col("id")).groupBy("a").agg(F.min("group_id").alias("near_"))
        far = label.select(F.col("id").alias("at_"), F.col("group_id").alias("far_"))
        step = label.join(near, F.col("id") == F.col("a")).join(far, F.col("group_id") == F.col("at_")).select("id", F.col("group_id").alias("old_"), F.least("group_id", "near_", "far_").alias("group_id"))
        step = cut_lineage(step)
        label = step.select("id", "group_id")
        if step.where("old_ != group_id").isEmpty():
            return label


def groups(texts: DataFrame, key: str = "id", text: str = "text", size: int = 5, least_words: int = 5, threshold: float = 0.8, hot: int = HOT) -> DataFrame:
    """(id, class_id, group_id, links): a row per text with shingles.

    class_id is the least id with the same set, group_id the least id that a chain of similar texts leads to,
    links the number of other rows of the similarity or more. Copies aren't expanded into pairs.
    """
    rows = _prepared(texts, key, text)
    members, met = similar_classes(rows, size, least_words, threshold, hot)
    met = cut_lineage(met.select("a", "b"))
    heads = members.where("id = rep").select("rep", "members")
    ways = met.unionByName(met.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = ways.join(heads.select(F.col("rep").alias("b"), "members"), "b").groupBy("a").agg(F.sum("members").alias("others"))
    of = heads.join(links, F.col("rep") == F.col("a"), "left").join(components(met), F.col("rep") == F.col("id"), "left")
    of = of.select(F.col("rep").alias("class_id"), F.coalesce("group_id", "rep").alias("group_id"), (F.coalesce("others", F.lit(0)) + F.col("members") - 1).alias("links"))
    return members.select("id", "rep").join(of, F.col("rep") == F.col("class_id")).select("id", "class_id", "group_id", "links")
