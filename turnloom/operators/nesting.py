"""Flat tables from deeply nested JSON, by Merkle identities of subtrees.

Each object of a document gets the hash of its canonical form, made bottom-up: keys sorted, scalars by
their JSON text, inner objects and arrays by their own hashes. Equal subtrees thus have equal ids in all
documents, so an object is stored once (objects), however often and wherever it occurs, and each
occurrence is a bridge row (occurrences) from its parent to it with its path and ordinal.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.functions import jsontree as J

OCCURRENCES = "src string, row_id bigint, node string, parent string, holder string, ordinal int, in_array boolean, object_id string, holder_id string, body string"
_ARROW = pa.schema([("src", pa.string()), ("row_id", pa.int64()), ("node", pa.string()), ("parent", pa.string()), ("holder", pa.string()), ("ordinal", pa.int32()), ("in_array", pa.bool_()), ("object_id", pa.string()), ("holder_id", pa.string()), ("body", pa.string())])


def _identity(text: str) -> str:
    return blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def objects_of(text: str | None, bodies: bool = True) -> list[tuple]:
    """(node, parent, holder, ordinal, in_array, object_id, holder_id, body) of each object in a JSON text.

    node is the JSON Pointer, going on through strings that hold JSON; parent is the node of the nearest
    object around that is itself an element of an array ('' if none), holder that of the nearest object
    around of any kind (NULL if none) and holder_id its id. ordinal counts the objects of one holder in
    document order. body is the object with its inner objects replaced by references, {"$object": id}, and arrays or objects
    that were written as strings wrapped as {"$json": value}; it is None without bodies.
    An invalid or NULL text has no objects. The walk is a loop, so depth is bounded by memory only.
    """
    if not text:
        return []
    try:
        root = J.parse(text)
    except ValueError:
        return []
    found: list[list] = []
    # frames: value, pointer, parent case, index of the holder in found, under an array?, parts, iterator, index in found, waiting key
    done: tuple[str, str] | None = None
    stack: list[list] = []

    def enter(value: object, pointer: str, parent: str, holder: int, in_array: bool) -> tuple[str, str] | None:
        """Canonical text and short text of a leaf, or None after pushing a frame."""
        if isinstance(value, str) and not isinstance(value, J.Number) and (inner := J.nested(value)) is not None:
            value, quoted = inner, True
        else:
            quoted = False
        if isinstance(value, dict):
            at = len(found)
            found.append([pointer, parent, found[holder][0] if holder >= 0 else None, 0, in_array, None, holder, None])
            stack.append([value, pointer, pointer if in_array else parent, at, quoted, [], iter(sorted(value)), None])
            return None
        if isinstance(value, list):
            stack.append([value, pointer, parent, holder, quoted, [], iter(range(len(value))), None])
            return None
        text_ = J.scalar(value)
        return text_, text_

    done = enter(root, "", "", -1, False)
    while stack:
        frame = stack[-1]
        value, pointer, parent, holder, quoted, parts, keys, waiting = frame
        if done is not None and waiting is not None:
            parts.append((waiting, *done))
            done = None
        key = next(keys, None)
        if key is not None:
            frame[7] = key
            done = enter(value[key], pointer + J.pointer_step(key), parent, holder, isinstance(value, list))
            continue
        stack.pop()
        mark = "~" if quoted else ""
        if isinstance(value, dict):
            canonical = mark + "{" + ",".join(f"{J.scalar(k)}:{c}" for k, c, _ in parts) + "}"
            id_ = _identity(canonical)
            found[holder][5] = id_
            if bodies:
                found[holder][7] = "{" + ",".join(f"{J.scalar(k)}:{s}" for k, _, s in parts) + "}"
            short = '{"$object":"' + id_ + '"}'
        else:
            short = "[" + ",".join(s for _, _, s in parts) + "]" if bodies else ""
            canonical = mark + "#" + _identity("[" + ",".join(c for _, c, _ in parts) + "]")
        done = ("#" + id_ if isinstance(value, dict) else canonical), ('{"$json":' + short + "}" if quoted else short)
    counts: dict[int, int] = {}
    out = []
    for pointer, parent, holder_node, _, in_array, id_, holder, body in found:
        counts[holder] = counts.get(holder, -1) + 1
        out.append((pointer, parent, holder_node, counts[holder], in_array, id_, found[holder][5] if holder >= 0 else None, body))
    return out


def _occurrences(batches: Iterator[pa.RecordBatch], bodies: bool) -> Iterator[pa.RecordBatch]:
    schema = _ARROW if bodies else pa.schema(list(_ARROW)[:-1])
    columns: list[list] = [[] for _ in schema]

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)
        for c in columns:
            c.clear()
        return batch

    for batch in batches:
        size = 0
        for src, row_id, text in zip(batch[0].to_pylist(), batch[1].to_pylist(), batch[2].to_pylist()):
            for node, parent, holder, ordinal, in_array, id_, holder_id, body in objects_of(text, bodies):
                row = (src, row_id, J.clean(node), J.clean(parent), holder and J.clean(holder), ordinal, in_array, id_, holder_id, *([J.clean(body)] if bodies else []))
                for c, v in zip(columns, row):
                    c.append(v)
                size += len(body or "") + len(node)
            if size > 4_000_000:
                yield flush()
                size = 0
        if columns[0]:
            yield flush()


def occurrences(documents: DataFrame, src: str = "src", row_id: str = "row_id", text: str = "text", bodies: bool = True) -> DataFrame:
    """A bridge row for each object of each document: see objects_of; the columns are OCCURRENCES, without the body if bodies is False.

    A map over the rows without a shuffle, so no key can be hot; a long document is one row of one task.
    NULL, empty and invalid texts have no rows; repeated rows are documents of their own; extra columns
    are left out before Python sees them.
    """
    return documents.select(F.col(src).cast("string"), F.col(row_id).cast("bigint"), F.col(text).cast("string")).where(F.col(text).isNotNull()).mapInArrow(lambda batches: _occurrences(batches, bodies), OCCURRENCES if bodies else OCCURRENCES.removesuffix(", body string"))


def objects(bridge: DataFrame) -> DataFrame:
    """(object_id, body, occurrences): each distinct object once.

    The partial aggregation before the shuffle keeps one row per object and task, so an object that is
    a third of all occurrences costs one row a task.
    """
    return bridge.groupBy("object_id").agg(F.first("body").alias("body"), F.count(F.lit(1)).alias("occurrences"))
