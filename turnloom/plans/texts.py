"""Queries of the text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.functions import text as X
from turnloom.plans.registry import query
from turnloom.sources.tables import table


@query("SELECT id, CASE WHEN coalesce(length(original_text), 0) = 0 THEN 0 ELSE greatest(1, length(original_text) // 4) END AS tokens FROM turns")
def f20_token_estimate(spark: SparkSession, folder: str) -> DataFrame:
    """Estimated tokens of each turn."""
    return table(spark, folder, "turns").select("id", X.tokens(F.col("original_text")).alias("tokens"))


_SHORT = "CASE WHEN regexp_replace(lower(name), '[^a-z0-9]+', '', 'g') LIKE 'mcp%' AND contains(name, '__') THEN regexp_replace(lower(string_split(name, '__')[-1]), '[^a-z0-9]+', '', 'g') ELSE regexp_replace(lower(name), '[^a-z0-9]+', '', 'g') END"
_EXACT = " ".join(f"WHEN short = '{k}' THEN '{v}'" for k, v in X.TOOLS.items())
_PARTS = " ".join(f"WHEN regexp_matches(short, '{'|'.join(p)}') THEN '{c}'" for c, p in X.TOOL_PARTS)


@query(f"SELECT category, count(*) AS calls FROM (SELECT CASE WHEN coalesce(short, '') = '' THEN 'Other' {_EXACT} {_PARTS} ELSE 'Other' END AS category FROM (SELECT {_SHORT} AS short FROM parsed_tool_calls)) GROUP BY category")
def f24_tool_categories(spark: SparkSession, folder: str) -> DataFrame:
    """calls by category of tool."""
    return table(spark, folder, "parsed_tool_calls").groupBy(X.tool_category(F.col("name")).alias("category")).agg(F.count(F.lit(1)).alias("calls"))


@query("""SELECT model, count(*) AS turns FROM (SELECT CASE WHEN coalesce(b, '') = '' THEN model_id ELSE b END AS model FROM (SELECT model_id, regexp_replace(regexp_replace(lower(trim(model_id)), '-[0-9]{6,}.*$', ''), '-(preview|latest)$', '') AS b FROM turns)) GROUP BY model""")
def f23_models(spark: SparkSession, folder: str) -> DataFrame:
    """turns by model without versions."""
    return table(spark, folder, "turns").groupBy(X.model_name(F.col("model_id")).alias("model")).agg(F.count(F.lit(1)).alias("turns"))


_LANG = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.LANGUAGES.items())


@query(f"""WITH f AS (SELECT unnest(CAST(json_extract(files, '$[*]') AS JSON[])) AS v FROM turns WHERE files LIKE '[%' AND json_valid(files)), p AS (SELECT json_extract_string(v, '$') AS p FROM f),
n AS (SELECT regexp_replace(replace(p, chr(92), '/'), '^/([A-Za-z]:)', '\\1') AS s FROM p)
SELECT CASE WHEN regexp_matches(s, '^[A-Za-z]:') THEN lower(substr(s, 1, 1)) || substr(s, 2) ELSE s END AS path, CASE lower(regexp_extract(s, '\\.([A-Za-z0-9]+)$', 1)) {_LANG} END AS language, count(*) AS turns FROM n WHERE s IS NOT NULL AND s != '' GROUP BY 1, 2""")
def f25_file_languages(spark: SparkSession, folder: str) -> DataFrame:
    """Files of the turns by normalised path and language."""
    from turnloom.operators.analytics import text_list

    files = table(spark, folder, "turns").select(F.explode(text_list(F.col("files"))).alias("file")).select(X.path(F.col("file")).alias("path"))
    return files.groupBy("path", X.language(F.col("path")).alias("language")).agg(F.count(F.lit(1)).alias("turns"))


@query("""SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: i = 1 OR x != string_split(text, chr(10))[i - 1]), chr(10)) AS text FROM documents""")
def f41_distinct_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Texts without repeated neighbouring lines."""
    return table(spark, folder, "documents").select("doc_id", X.distinct_lines(F.col("text")).alias("text"))


@query("""SELECT doc_id, regexp_replace(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '[ \\t]+\\n', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g') AS text FROM documents""")
def f42_spaces(spark: SparkSession, folder: str) -> DataFrame:
    """texts with plain line ends and no runs of empty lines."""
    return table(spark, folder, "documents").select("doc_id", X.spaced(F.col("text")).alias("text"))


@query("""SELECT doc_id, CASE WHEN length(text) <= 2048 THEN text ELSE substr(text, 1, 819) || chr(10) || '[...]' || chr(10) || substr(text, (length(text) - 409) // 2 + 1, 409) || chr(10) || '[...]' || chr(10) || right(text, 819) END AS text FROM documents""")
def f44_three_slices(spark: SparkSession, folder: str) -> DataFrame:
    """the beginning, middle and end of long texts."""
    return table(spark, folder, "documents").select("doc_id", X.three_slices(F.col("text")).alias("text"))


@query("""SELECT id, len(list_filter(string_split(original_text, chr(10)), lambda x: x LIKE '+%' AND x NOT LIKE '+++%')) AS added, len(list_filter(string_split(original_text, chr(10)), lambda x: x LIKE '-%' AND x NOT LIKE '---%')) AS removed FROM turns WHERE original_text IS NOT NULL""")
def f51_diff_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines added and removed by diffs in texts."""
    t = F.col("original_text")
    return table(spark, folder, "turns").where(t.isNotNull()).select("id", X.diff_lines(t, "+").cast("bigint").alias("added"), X.diff_lines(t, "-").cast("bigint").alias("removed"))


@query(f"""SELECT d.doc_id, sha256(regexp_replace(d.text, '^{X.SPACE}+|{X.SPACE}+$', '', 'g')) AS text_hash, e.vec_id IS NULL AS missing FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id WHERE d.text IS NOT NULL""")
def r11_embedding_backfill(spark: SparkSession, folder: str) -> DataFrame:
    """Each document's text hash and whether its embedding is missing."""
    docs = table(spark, folder, "documents").where("text is not null").select("doc_id", X.digest(F.col("text")).alias("text_hash"))
    known = table(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(False).alias("have"))
    return docs.join(known, "doc_id", "left").select("doc_id", "text_hash", F.col("have").isNull().alias("missing"))


@query("""SELECT id, CASE WHEN timestamp_ms IS NULL THEN '' ELSE strftime(make_timestamp(timestamp_ms * 1000), '%Y-%m-%dT%H:%M:%S') || CASE WHEN timestamp_ms % 1000 != 0 THEN '.' || lpad(CAST(timestamp_ms % 1000 AS VARCHAR), 3, '0') || '000' ELSE '' END || '+00:00' END AS iso FROM turns WHERE timestamp_ms IS NULL OR timestamp_ms BETWEEN 0 AND 10000000000000""")
def f35_iso_texts(spark: SparkSession, folder: str) -> DataFrame:
    """instants in milliseconds as ISO texts."""
    return table(spark, folder, "turns").where("timestamp_ms is null or timestamp_ms between 0 and 10000000000000").select("id", X.iso_of(F.col("timestamp_ms")).alias("iso"))


@query(r"""WITH t AS (SELECT doc_id, title AS s, string_split(title, '') AS c, list_filter(string_split_regex(title, '\s+'), lambda w: w != '') AS w FROM documents WHERE title IS NOT NULL AND title != '' AND NOT regexp_matches(title, '[^ -~]'))
SELECT doc_id, round(list_entropy(c), 6) AS entropy, round(len(list_filter(c, lambda x: regexp_matches(x, '[0-9]'))) / length(s)::DOUBLE, 6) AS digit_ratio, round(CASE WHEN length(s) > 1 THEN len(list_filter(range(1, length(s)), lambda i: c[i] = c[i + 1])) / (length(s) - 1)::DOUBLE ELSE 0 END, 6) AS repetition_ratio,
round(coalesce(list_sum(list_transform(w, lambda x: length(x))) / len(w)::DOUBLE, 0), 6) AS mean_word_length, round(coalesce(len(list_filter(w, lambda x: length(x) > 8)) / len(w)::DOUBLE, 0), 6) AS long_word_ratio FROM t""")
def f48_line_features(spark: SparkSession, folder: str) -> DataFrame:
    """the features of a line, of the titles in ASCII."""
    from turnloom.functions.shrink import features_column

    rows = table(spark, folder, "documents").where("title != '' and not title rlike '[^ -~]'").select("doc_id", features_column(F.col("title")).alias("f"))
    return rows.select("doc_id", *[F.round(f"f.{c}", 6).alias(c) for c in ("entropy", "digit_ratio", "repetition_ratio", "mean_word_length", "long_word_ratio")])


@query()
def f37_block_texts(spark: SparkSession, folder: str) -> DataFrame:
    """the texts of nested blocks, in two ways; no SQL, compared with values by hand in tests."""
    from turnloom.functions.shrink import text_column

    raw = F.col("raw_json")
    return table(spark, folder, "parsed_content_blocks").select("id", text_column(raw).alias("coerced"), text_column(raw, "flattened").alias("flattened"))
