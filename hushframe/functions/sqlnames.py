"""SQL names for the value transforms.

Each is a SQL function with a plain expression body, so queries that use it are
optimised and compiled like any other; no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from hushframe import rules

_CHARS = "".join(f"\\u{ord(c):04x}" for c in rules.WHITESPACE)
_STRIP = f"btrim(v, '{_CHARS}')"
_QUAD = r"(\\b[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.)[0-9]+\\b"
_V4 = r"^([0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3})\\.[0-9]{1,3}(?::[0-9]+)?$"
_V6 = r"^([0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,2}):"
_CUT = f"substring_index(substring_index(substring_index({_STRIP}, '?', 1), ';', 1), '#', 1)"

BODIES = {
    "hf_hash_email": f"CASE WHEN length({_STRIP}) > 0 THEN sha2(lower({_STRIP}), 256) ELSE '' END",
    "hf_hash_id": f"CASE WHEN length({_STRIP}) > 0 THEN sha2({_STRIP}, 256) ELSE '' END",
    "hf_ip_prefix": (
        f"CASE WHEN regexp_extract({_STRIP}, '{_V4}', 1) <> '' THEN concat(regexp_extract({_STRIP}, '{_V4}', 1), '.0') "
        f"WHEN regexp_extract({_STRIP}, '{_V6}', 1) <> '' THEN concat(regexp_extract({_STRIP}, '{_V6}', 1), '::') "
        "ELSE '' END"
    ),
    "hf_clean_url": f"coalesce(regexp_replace({_CUT}, '{_QUAD}', '$10'), '')",
    "hf_mask_quads": f"regexp_replace(v, '{_QUAD}', '$10')",
    "hf_outcode": f"coalesce(substring_index(upper({_STRIP}), ' ', 1), '')",
    "hf_birth_year": f"coalesce(regexp_extract({_STRIP}, '^([0-9]{{4}})', 1), '')",
}


def register(spark: SparkSession) -> list[str]:
    """Create the temporary functions and return their names."""
    for name, body in BODIES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(v STRING) RETURNS STRING RETURN {body}")
    return sorted(BODIES)
