"""Message records of files whose schema drifts: versioned fingerprints, migration steps, one table.

A file's fingerprint is its holder and the names and types of its message fields. Two successive files of
an install differ by a list of changes. That a removed and an added name are one field renamed is decided
by evidence: a file usually begins with the last message of the file before, so both names hold the same
content there. The evidence of all installs together is the registry of migration steps (old, new,
agreeing and disagreeing pairs), and the registry decides where a pair of files has no evidence of its own,
over chains of steps of any length.

Each install's schemas are numbered as versions; the steps from one to the next are recorded as a table. All
messages of all files go into one table: a file's fields are renamed to the least name of their chain, cast to the
one type that every value of that name fits, and NULL (the default) where a message lacks them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.functions import jsontree as J
from turnloom.operators.keys import lacking
from turnloom.operators.neighbours import previous_row, running
from turnloom.session import cut_lineage

HOLDERS = ("turns", "messages", "conversations")
#: Text of this many characters or more identifies a message; shorter values recur by chance.
TELLING = 25
TYPES = ("string", "number", "boolean", "object", "array")


def kind_of(value: object) -> str | None:
    """The type of a JSON value, None for null."""
    if value is None:
        return None
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, J.Number):
        return "number"
    return "string" if isinstance(value, str) else "object" if isinstance(value, dict) else "array"


def _messages(value: object, key: str) -> list[dict]:
    rows = value.get(key) if isinstance(value, dict) else None
    rows = [r for r in rows if isinstance(r, dict)] if isinstance(rows, list) else []
    if key == "messages":
        return rows
    if key == "turns":
        return [r[side] for r in rows for side in ("request", "response") if isinstance(r.get(side), dict)]
    return [m for r in rows for inner in ("turns", "messages") for m in _messages(r, inner)]


def records_of(payload: str | None) -> tuple[str | None, list[dict]]:
    """(holder, message records) of a file; (None, []) for one that can't be read or has none."""
    try:
        value = J.parse(payload or "")
    except ValueError:
        return None, []
    for holder in HOLDERS:
        if found := _messages(value, holder):
            return holder, found
    return None, []


def leaves(value: object) -> list[str]:
    """The contents of a value whatever its wrapping: the texts of its scalars, without the tags beside them.

    '1' and 1, 'a;b' and ['a', 'b'], 'x' and {'name': 'x'} or [{'type': 'text', 'text': 'x'}] have the same contents.
    """
    out: list[str] = []
    stack = [value]
    while stack:
        v = stack.pop()
        if isinstance(v, dict):
            stack += [x for k, x in v.items() if k not in ("type", "kind")] or list(v.values())
        elif isinstance(v, list):
            stack += v
        elif v is not None:
            text = str(v).lower() if isinstance(v, bool) else str(v)
            out += [p.strip() for p in text.split(";")] if ";" in text else [text]
    return sorted(set(out))


def _digest(parts: list[str]) -> int:
    return int.from_bytes(blake2b("\x00".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


_CONTENT = pa.map_(pa.string(), pa.int64())
_KEYS = [("file_id", pa.int64()), ("install_id", pa.string()), ("rel_path", pa.string()), ("written_at", pa.timestamp("us"))]
_PROFILE = pa.schema([*_KEYS, ("holder", pa.string()), ("schema_id", pa.int64()), ("records", pa.int32()), ("fields", pa.map_(pa.string(), pa.string())), ("forms", pa.map_(pa.string(), pa.int32())), ("first", _CONTENT), ("last", _CONTENT), ("first_text", pa.list_(pa.int64())), ("last_text", pa.list_(pa.int64()))])
PROFILE = "file_id bigint, install_id string, rel_path string, written_at timestamp_ntz, holder string, schema_id bigint, records int, fields map<string,string>, forms map<string,int>, first map<string,bigint>, last map<string,bigint>, first_text array<bigint>, last_text array<bigint>"


def types_of(records: list[dict]) -> dict[str, str]:
    """Name to type of the fields of message records; of several types the one most records have (on a tie the first of TYPES)."""
    types: dict[str, Counter] = {}
    for r in records:
        for k, v in r.items():
            if (kind := kind_of(v)) is not None:
                types.setdefault(J.clean(k), Counter())[kind] += 1
    return {k: min(c, key=lambda t: (-c[t], TYPES.index(t))) for k, c in types.items()}


def schema_id(holder: str, fields: dict[str, str]) -> int:
    """The fingerprint of a schema: a digest of holder, names and types."""
    return _digest([holder, *(f"{k}\x01{t}" for k, t in sorted(fields.items()))])


def profile_of(payload: str | None) -> tuple | None:
    """(holder, schema_id, records, fields, forms, first, last, first_text, last_text) of a file, None if it has no message records.

    fields: name to type; forms: name to the forms of all its values (see form_of).
    first, last: name to a digest of its content in the first and last record; *_text: digests of their telling texts.
    """
    holder, records = records_of(payload)
    if not records:
        return None
    fields = types_of(records)
    forms: dict[str, int] = dict.fromkeys(fields, 0)
    for r in records:
        for k, v in r.items():
            if v is not None:
                forms[J.clean(k)] |= form_of(*content_of(v))
    ends = []
    for r in (records[0], records[-1]):
        contents = {J.clean(k): leaves(v) for k, v in r.items() if v is not None}
        ends.append(({k: _digest(x) for k, x in contents.items()}, sorted({_digest([t]) for x in contents.values() for t in x if len(t) >= TELLING})))
    return holder, schema_id(holder, fields), len(records), list(fields.items()), list(forms.items()), list(ends[0][0].items()), list(ends[1][0].items()), ends[0][1], ends[1][1]


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = zip(*[batch.column(i).to_pylist() for i in range(4)])
        rows = [(*k, *p) for k, text in zip(keys, batch.column(4).to_pylist()) if (p := profile_of(text))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), _PROFILE)], schema=_PROFILE)


def profiles(files: DataFrame) -> DataFrame:
    """(*PROFILE): a row per readable file with message records, repeats too. The payload is read once and never shuffled; profiles are written once."""
    rows = files.where("payload is not null").select("file_id", "install_id", "rel_path", F.col("written_at").cast("timestamp_ntz").alias("written_at"), "payload")
    return cut_lineage(rows.mapInArrow(_profiles, PROFILE))


def fingerprints(known: DataFrame) -> DataFrame:
    """The profiles of the files that count: of repeats of a rel_path of an install the lowest file_id. Repeats are found by their keys alone."""
    keys = known.select("file_id", "install_id", "rel_path")
    first = keys.groupBy("install_id", "rel_path").agg(F.min("file_id").alias("first_"), F.count(F.lit(1)).alias("n_")).where("n_ > 1")
    same = F.col("k.install_id").eqNullSafe(F.col("f.install_id")) & F.col("k.rel_path").eqNullSafe(F.col("f.rel_path"))
    repeats = keys.alias("k").join(first.alias("f"), same).where("k.file_id != first_").select("k.file_id")
    return lacking(known, repeats, "file_id")


def successions(prints: DataFrame) -> DataFrame:
    """Each file whose schema differs from that of the file before it of the same install, by written_at and file_id, with the profile of that file.

    The order is found on narrow rows; profiles are joined only for the pairs that differ.
    """
    narrow = prints.select("file_id", "install_id", "written_at", "schema_id")
    paired = previous_row(narrow, "install_id", F.to_date("written_at"), ["written_at", "file_id"], F.struct("file_id", "schema_id"))
    changed = paired.where("schema_id != previous.schema_id").select("file_id", F.col("previous.file_id").alias("before_id"))
    before = prints.select(F.col("file_id").alias("before_id"), F.struct("holder", "fields", "last", "last_text").alias("previous"))
    return changed.join(prints.select("file_id", "holder", "fields", "first", "first_text"), "file_id").join(before, "before_id")


def _candidates(pairs: DataFrame) -> DataFrame:
    """(file_id, old_field, new_field, overlap, agrees) of each removed and added name of a file; agrees is NULL without evidence."""
    old, new = F.map_keys("previous.fields"), F.map_keys("fields")
    overlap = F.arrays_overlap("previous.last_text", "first_text")
    names = pairs.select("file_id", "previous.last", "first", overlap.alias("overlap"), F.explode(F.array_except(old, new)).alias("old_field"), F.array_except(new, old).alias("added")).select("*", F.explode("added").alias("new_field")).drop("added")
    a, b = F.try_element_at("last", F.col("old_field")), F.try_element_at("first", F.col("new_field"))
    return names.select("file_id", "old_field", "new_field", "overlap", F.when(F.col("overlap") & a.isNotNull() & b.isNotNull(), a == b).alias("agrees"))


def registry(candidates: DataFrame) -> DataFrame:
    """(old_field, new_field, agreeing, disagreeing): the migration steps seen anywhere, in both directions together."""
    both = candidates.where("agrees is not null").select("old_field", "new_field", "agrees")
    both = both.unionByName(both.select(F.col("new_field").alias("old_field"), F.col("old_field").alias("new_field"), "agrees"))
    steps = both.groupBy("old_field", "new_field").agg(F.count_if("agrees").alias("agreeing"), F.count_if(~F.col("agrees")).alias("disagreeing"))
    return steps.where("agreeing > disagreeing")


def supports(steps: DataFrame) -> DataFrame:
    """(old_field, new_field, support): the pairs of names that a chain of steps joins, of any length.

    A step's support is the number of its agreeing pairs; a chain has the least support of its steps, divided by
    1,000 for each name in between. A pair keeps the support of its shortest chains. Chains grow by a step a round
    until none is new; the table has rows for names, not for files.
    """
    steps = cut_lineage(steps.select("old_field", "new_field", F.col("agreeing").cast("double").alias("support")))
    known, latest = steps, steps
    while True:
        further = latest.select("old_field", F.col("new_field").alias("via_"), F.col("support").alias("a_")).join(steps.select(F.col("old_field").alias("via_"), "new_field", F.col("support").alias("b_")), "via_").where("old_field != new_field")
        further = further.groupBy("old_field", "new_field").agg((F.max(F.least("a_", "b_")) / 1000).alias("support"))
        latest = cut_lineage(further.join(known.select("old_field", "new_field"), ["old_field", "new_field"], "left_anti"))
        if latest.isEmpty():
            return known
        known = cut_lineage(known.unionByName(latest))


def renames(candidates: DataFrame) -> DataFrame:
    """(file_id, old_field, new_field) of the names that carry on the same content.

    A pair's own evidence counts if the registry agrees in the main; without own evidence the registry
    decides, over chains of any length. Of several partners the best supported one counts,
    for each side, so the renames of a file are one to one; ties go by name.
    """
    scored = candidates.join(supports(registry(candidates)), ["old_field", "new_field"]).where("coalesce(agrees, true)").withColumn("score", F.struct(F.coalesce(F.col("agrees"), F.lit(False)), "support"))
    best = lambda key, other: scored.groupBy("file_id", key).agg(F.max_by(other, F.struct("score", other)).alias(other))
    return best("old_field", "new_field").join(best("new_field", "old_field"), ["file_id", "old_field", "new_field"])


def changes(files: DataFrame) -> DataFrame:
    """(file_id, change, old_field, new_field): every difference of a file from the file before it.

    added, removed, renamed, retyped (the same name in both columns) and moved (between holders), as
    TESTDATA.md defines them. Equal successive schemas, told by schema_id, are left out before anything is
    expanded. No files, or one per install, give no rows. NULL install_ids are one install of their own.
    """
    pairs = cut_lineage(successions(fingerprints(profiles(files))))
    found = cut_lineage(renames(_candidates(pairs)).select("file_id", "old_field", "new_field"))
    old, new = F.map_keys("previous.fields"), F.map_keys("fields")
    part = lambda change, a, b: F.struct(F.lit(change).alias("change"), a.alias("old_field"), b.alias("new_field"))
    nothing = F.lit("")
    kept = F.filter(F.array_intersect(old, new), lambda k: F.element_at("previous.fields", k) != F.element_at("fields", k))
    lists = [
        F.transform(F.array_except(new, old), lambda k: part("added", nothing, k)),
        F.transform(F.array_except(old, new), lambda k: part("removed", k, nothing)),
        F.transform(kept, lambda k: part("retyped", k, k)),
        F.when(F.col("previous.holder") != F.col("holder"), F.array(part("moved", F.col("previous.holder"), F.col("holder")))).otherwise(F.array().cast("array<struct<change:string,old_field:string,new_field:string>>")),
    ]
    plain = pairs.select("file_id", F.explode(F.concat(*lists)).alias("c")).select("file_id", "c.*")
    gone = found.select("file_id", F.lit("removed").alias("change"), F.col("old_field").alias("name")).unionByName(found.select("file_id", F.lit("added").alias("change"), F.col("new_field").alias("name")))
    named = plain.withColumn("name", F.when(F.col("change") == "added", F.col("new_field")).otherwise(F.col("old_field")))
    rest = named.join(gone, ["file_id", "change", "name"], "left_anti").drop("name")
    return rest.unionByName(found.select("file_id", F.lit("renamed").alias("change"), "old_field", "new_field"))


def versions(files: DataFrame) -> DataFrame:
    """(install_id, version, schema_id, file_id, files, holder, fields): the schemas of each install in order, numbered from 1.

    A version begins with the file (file_id) whose schema differs from that of the file before it and holds for the
    files up to the next; a schema that comes back is a new version with the same schema_id. fields is a map of
    names to types. NULL install_ids are one install of their own.
    """
    prints = fingerprints(profiles(files))
    order = ["written_at", "file_id"]
    rows = previous_row(prints.select("file_id", "install_id", "written_at", "schema_id"), "install_id", F.to_date("written_at"), order, F.struct("schema_id"))
    rows = rows.withColumn("changed", F.coalesce(F.col("schema_id") != F.col("previous.schema_id"), F.lit(True)).cast("int")).drop("previous")
    rows = running(rows, "install_id", F.to_date("written_at"), order, sums={"earlier": F.col("changed")})
    each = rows.groupBy("install_id", (F.col("earlier") + F.col("changed")).cast("int").alias("version")).agg(F.min_by("file_id", F.struct(*order)).alias("file_id"), F.count(F.lit(1)).alias("files"))
    return each.join(prints.select("file_id", "schema_id", "holder", "fields"), "file_id").select("install_id", "version", "schema_id", "file_id", "files", "holder", "fields")


def steps(files: DataFrame) -> DataFrame:
    """(install_id, version, file_id, change, old_field, new_field): the migration steps that lead from each version to the next; see changes."""
    made = versions(files).select("install_id", "version", F.col("file_id").alias("at_"))
    return changes(files).join(made, F.col("file_id") == F.col("at_")).select("install_id", "version", "file_id", "change", "old_field", "new_field")


def canonical_names(files: DataFrame) -> DataFrame:
    """(field, canonical): each name that takes part in a migration step and the least name of its chain of steps."""
    return _canonical(profiles(files))


def _canonical(known: DataFrame) -> DataFrame:
    """canonical_names of profiles. Chains are followed by spreading the least name over the registry until nothing changes; it has rows for names, not for files."""
    steps = cut_lineage(registry(_candidates(cut_lineage(successions(fingerprints(known))))).select("old_field", "new_field"))
    label = cut_lineage(steps.groupBy(F.col("old_field").alias("field")).agg(F.least(F.min("new_field"), F.first("old_field")).alias("canonical")))
    while True:
        near = steps.join(label, steps.new_field == label.field).groupBy("old_field").agg(F.min("canonical").alias("near_"))
        far = label.select(F.col("field").alias("far_name"), F.col("canonical").alias("far_"))
        step = label.join(near, label.field == near.old_field, "left").join(far, label.canonical == F.col("far_name"), "left").select("field", "canonical", F.least("canonical", "near_", "far_").alias("next_"))
        step = cut_lineage(step)
        label = step.select("field", F.col("next_").alias("canonical"))
        if step.where("next_ != canonical").isEmpty():
            return label


# --- one table of all messages --------------------------------------------------------------------------------

#: Members that only mark a wrapped text, with the marks that say nothing else.
_MARKS = {"type": ("text",), "kind": ("text",), "format": ("plain",)}
_WRAPS = ("text", "name", "value", "content")
#: The forms of values, as bits: a value that fits several has the first that it fits.
BOOLEAN, INTEGER, DECIMAL, TEXT, LIST, OBJECT = 1, 2, 4, 8, 16, 32
#: Numbers whose text a column of that type gives back as it stood.
_INTEGER = re.compile(r"-?[1-9]\d{0,17}|0")
_DECIMAL = re.compile(r"-?(?:[1-9]\d{0,8}|0)\.(?:\d{0,5}[1-9])")
#: Columns of the table, at most; the fields of fewer files go on in extra. Fields that are renamed, at most: what the rules take on the driver.
MOST_COLUMNS, MOST_NAMES = 1000, 100_000
_FIXED = ("file_id", "install_id", "holder", "ordinal", "schema_id", "extra", "raw")


def _dump(value: object) -> str:
    if isinstance(value, dict):
        return "{" + ",".join(f"{J.scalar(k)}:{_dump(v)}" for k, v in value.items()) + "}"
    return "[" + ",".join(map(_dump, value)) + "]" if isinstance(value, list) else J.scalar(value)


def _wrapped(value: object) -> object:
    """The scalar that an object only wraps: {'name': 'x'}, {'text': 'x', 'format': 'plain'}; None if it holds anything else."""
    if not isinstance(value, dict):
        return None
    inner = [(k, v) for k, v in value.items() if k not in _MARKS or v not in _MARKS[k]]
    return inner[0][1] if len(inner) == 1 and inner[0][0] in _WRAPS and kind_of(inner[0][1]) in ("string", "number", "boolean") else None


def content_of(value: object) -> tuple[str, str]:
    """(shape, content) of a value that isn't null: what it says as text, in its own order, with nothing left out.

    A scalar, or one that is only wrapped (a list of one text part too), has its type and its own text. A list of scalars is an
    array; whatever else has members keeps them all and is an object. These two are JSON text.
    """
    part = value[0] if isinstance(value, list) and len(value) == 1 else value
    if (inner := _wrapped(part)) is not None:
        value = inner
    kind = kind_of(value)
    if kind == "array":
        return ("object" if any(isinstance(v, (dict, list)) or v is None for v in value) else "array"), _dump(value)
    return kind, value if kind == "string" else _dump(value)


def form_of(shape: str, content: str) -> int:
    """The form of a value: what a column must be able to hold for it to come back as it is. '7' fits a number as 7 does, '07' only text."""
    if shape in ("array", "object"):
        return LIST if shape == "array" else OBJECT
    if content in ("true", "false"):
        return BOOLEAN
    return INTEGER if _INTEGER.fullmatch(content) else DECIMAL if _DECIMAL.fullmatch(content) else TEXT


def column_type(forms: int) -> str:
    """The narrowest type that every value of these forms casts to without loss. Lists beside scalars are lists; objects make it text (JSON)."""
    if forms & OBJECT:
        return "string"
    if forms & LIST:
        return "array<string>"
    return {BOOLEAN: "boolean", INTEGER: "bigint", DECIMAL: "double", INTEGER | DECIMAL: "double"}.get(forms, "string")


def cast(kind: str, shape: str, content: str) -> object:
    """The value of a column of column_type. A text in a column of lists is one of its pieces between ';'."""
    if kind == "boolean":
        return content == "true"
    if kind == "bigint":
        return int(content)
    if kind == "double":
        return float(content)
    if kind == "array<string>":
        if shape == "array":
            return [J.clean(v if isinstance(v, str) else J.scalar(v)) for v in J.parse(content)]
        return [J.clean(p.strip()) for p in content.split(";")] if shape == "string" and content.strip() else [] if shape == "string" else [content]
    return J.clean(content)


def rules(files: DataFrame) -> DataFrame:
    """(field, name, type, files): for each field its canonical name (rename rule), that name's type (cast rule), and how many files have the field. The default is NULL."""
    return _rules(profiles(files))


def _rules(known: DataFrame) -> DataFrame:
    seen = known.select(F.explode("forms").alias("field", "form")).groupBy("field").agg(F.bit_or("form").alias("forms"), F.count(F.lit(1)).alias("files"))
    named = cut_lineage(seen.join(_canonical(known), "field", "left").select("field", F.coalesce("canonical", "field").alias("name"), "forms", "files"))
    types = named.groupBy("name").agg(F.bit_or("forms").alias("all_"))
    kinds = F.create_map(*[F.lit(x) for forms in range(1, 64) for x in (forms, column_type(forms))])
    return named.join(types, "name").select("field", "name", F.element_at(kinds, F.col("all_")).alias("type"), "files")


_ARROW = {"boolean": pa.bool_(), "bigint": pa.int64(), "double": pa.float64(), "array<string>": pa.list_(pa.string()), "string": pa.string()}


def columns_of(found: list) -> tuple[dict[str, tuple[str, str]], list[tuple[str, str]]]:
    """(field to (column, type), columns with their types) of rows of rules: names of the most files first, told apart where they differ by case alone or clash with another column."""
    weight: Counter = Counter()
    kinds: dict[str, str] = {}
    for r in found:
        weight[r["name"]] += r["files"]
        kinds[r["name"]] = r["type"]
    taken = set(_FIXED)
    columns: dict[str, str] = {}
    for name in sorted(kinds, key=lambda n: (-weight[n], n))[:MOST_COLUMNS]:
        column = name or "_"
        while column.lower() in taken:
            column += "_"
        taken.add(column.lower())
        columns[name] = column
    of = {r["field"]: (columns[r["name"]], kinds[r["name"]]) for r in found if r["name"] in columns}
    return of, sorted((c, kinds[n]) for n, c in columns.items())


def unified(files: DataFrame) -> DataFrame:
    """One table of all messages: (file_id, install_id, holder, ordinal, schema_id, one typed column per canonical name, extra, raw).

    Each file is routed through the rules of its fields: renamed along chains of steps to one name, cast to the
    column's type, NULL where a message lacks the field or has it as null (see rules, column_type, cast). A
    column has a type that all its values fit, so no cast fails. Where two fields of one message have the
    same canonical name, the first in name order is in the column and the others are in extra, under their own
    names; so every value is in one cell. raw is the message as it stands in the file. Repeats of a file
    keep their own rows; unreadable files have none. The payload is read twice (rules, rows) and never shuffled: the rules,
    a row per field name and at most MOST_NAMES of them, are all that is sent to the tasks.
    """
    known = _rules(profiles(files))
    of, columns = columns_of(known.orderBy(F.desc("files"), "field").limit(MOST_NAMES).collect())
    names = [c for c, _ in columns]
    schema = pa.schema([("file_id", pa.int64()), ("install_id", pa.string()), ("holder", pa.string()), ("ordinal", pa.int32()), ("schema_id", pa.int64()), *[(c, _ARROW[t]) for c, t in columns], ("extra", pa.map_(pa.string(), pa.string())), ("raw", pa.string())])
    text = ", ".join(["file_id bigint", "install_id string", "holder string", "ordinal int", "schema_id bigint", *[f"`{c.replace('`', '``')}` {t}" for c, t in columns], "extra map<string,string>", "raw string"])

    def routed(record: dict) -> tuple[dict, dict]:
        cells: dict[str, object] = {}
        extra: dict[str, str] = {}
        for k, v in sorted(record.items()):
            if v is None:
                continue
            field, (shape, content) = J.clean(k), content_of(v)
            column, kind = of.get(field, (None, ""))
            if column is not None and column not in cells:
                cells[column] = cast(kind, shape, content)
                continue
            while field in extra:
                field += "_"
            extra[field] = J.clean(content)
        return cells, extra

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, install, payload in zip(*[batch.column(n).to_pylist() for n in range(3)]):
                holder, records = records_of(payload)
                digest = schema_id(holder, types_of(records)) if records else 0
                for n, r in enumerate(records):
                    cells, extra = routed(r)
                    out.append((i, install, holder, n, digest, *map(cells.get, names), list(extra.items()), J.clean(_dump(r))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return files.where("payload is not null").select("file_id", "install_id", "payload").mapInArrow(rows, text)
