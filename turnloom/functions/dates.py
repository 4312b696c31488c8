"""UTC wall time of ISO texts, in Spark and as SQL text for a second engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ISO 8601 with seconds, an optional fraction and an optional offset; anything else has no date.
ISO = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})?$"


def utc(iso: Column) -> Column:
    """The UTC wall time (timestamp_ntz, whole seconds) of an ISO text; NULL for other texts and impossible times."""
    wall = F.replace(F.substring(iso, 1, 19), F.lit("T"), F.lit(" ")).try_cast("timestamp_ntz")
    part = lambda i: F.coalesce(F.regexp_extract(iso, r"([+-])([0-9]{2}):([0-9]{2})$", i).try_cast("int"), F.lit(0))
    minutes = (part(2) * 60 + part(3)) * F.when(F.regexp_extract(iso, r"([+-])[0-9]{2}:[0-9]{2}$", 1) == "-", -1).otherwise(1)
    return F.when(iso.rlike(ISO), F.timestamp_add("MINUTE", -minutes, wall))


def utc_sql(c: str) -> str:
    """utc() for DuckDB."""
    off = f"(coalesce(try_cast(regexp_extract({c}, '([+-])([0-9]{{2}}):([0-9]{{2}})$', 2) AS INTEGER), 0) * 60 + coalesce(try_cast(regexp_extract({c}, '([+-])([0-9]{{2}}):([0-9]{{2}})$', 3) AS INTEGER), 0))"
    sign = f"(CASE WHEN regexp_extract({c}, '([+-])[0-9]{{2}}:[0-9]{{2}}$', 1) = '-' THEN -1 ELSE 1 END)"
    return f"(CASE WHEN regexp_matches({c}, '{ISO}') THEN try_cast(replace(substr({c}, 1, 19), 'T', ' ') AS TIMESTAMP) - to_minutes({off} * {sign}) END)"
