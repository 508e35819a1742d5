"""The helpers as SQL functions; their bodies inline into the calling query's plan."""

from __future__ import annotations

from pyspark.sql import SparkSession

_ENTROPY = (
    "aggregate(array_distinct({a}), 0.0D, (acc, v) -> acc - (size(filter({a}, x -> x = v)) / size({a}))"
    " * log2(size(filter({a}, x -> x = v)) / size({a})))"
)
_FUNCTIONS = {
    "fl_entropy(s STRING) RETURNS DOUBLE": "CASE WHEN coalesce(s, '') = '' THEN 0.0D ELSE "
    + _ENTROPY.format(a="filter(split(s, ''), c -> c <> '')") + " END",
    "fl_bigram_entropy(s STRING) RETURNS DOUBLE": "CASE WHEN coalesce(length(s), 0) < 2 THEN 0.0D ELSE "
    + _ENTROPY.format(a="transform(sequence(1, length(s) - 1), i -> substr(s, i, 2))") + " END",
    "fl_consonant_ratio(s STRING) RETURNS DOUBLE":
        r"length(regexp_replace(lower(s), '[^\\p{L}]|[aeiou]', ''))"
        " / greatest(length(regexp_replace(lower(s), '[^aeiou]', '')), 1)",
    "fl_apex(s STRING) RETURNS STRING": "substring_index(s, '.', -2)",
    "fl_ip_number(s STRING) RETURNS BIGINT":
        "try_cast(split_part(s, '.', 1) as bigint) * 16777216 + try_cast(split_part(s, '.', 2) as bigint)"
        " * 65536 + try_cast(split_part(s, '.', 3) as bigint) * 256 + try_cast(split_part(s, '.', 4) as bigint)",
}


def register(spark: SparkSession) -> list[str]:
    """Create the session's ``fl_…`` functions and return their names."""
    for signature, body in _FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    return [signature.split("(")[0] for signature in _FUNCTIONS]
