"""The columns' rules as temporary SQL functions, for queries in SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..functions.patterns import SECRET_KINDS, SECRET_PARTS
from ..functions.validators import PLACEHOLDER, PREFIX, REDACTED


def _quoted(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


FUNCTIONS = {
    "spanveil_mask(v STRING) RETURNS STRING": "CASE WHEN length(v) <= 4 THEN repeat('*', length(v)) ELSE concat(repeat('*', length(v) - 4), right(v, 4)) END",
    "spanveil_generalize(kind STRING) RETURNS STRING": f"CASE WHEN kind RLIKE '^[A-Za-z0-9]+(_[A-Za-z0-9]+)*\\\\z' THEN concat('{PREFIX}', upper(kind), '__') END",
    "spanveil_redacted() RETURNS STRING": f"'{REDACTED}'",
    "spanveil_is_secret_kind(kind STRING) RETURNS BOOLEAN": f"lower(kind) RLIKE '{'|'.join(SECRET_PARTS)}' OR lower(kind) IN ({', '.join(map(_quoted, SECRET_KINDS))})",
    "spanveil_is_placeholder(v STRING) RETURNS BOOLEAN": f"coalesce(v RLIKE {_quoted('^' + PLACEHOLDER + chr(92) + 'z')}, false)",
    "spanveil_luhn_valid(v STRING) RETURNS BOOLEAN": "coalesce(luhn_check(translate(v, ' -', '')), false)",
}


def register(spark: SparkSession) -> list[str]:
    """Creates the functions in the session and returns their names."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [h.split("(")[0] for h in FUNCTIONS]
