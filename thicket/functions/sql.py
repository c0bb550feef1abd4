"""The string functions for ``spark.sql``: expressions that the optimizer sees, not code."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: name: (parameters, result, expression)
FUNCTIONS = {
    "xp_string": ("s STRING", "STRING", "coalesce(s, '')"),
    "xp_normalize_space": ("s STRING", "STRING", "trim(regexp_replace(coalesce(s, ''), '[ \\\\t\\\\r\\\\n]+', ' '))"),
    "xp_substring_before": ("s STRING, t STRING", "STRING", "if(instr(s, t) > 0, substring(s, 1, instr(s, t) - 1), '')"),
    "xp_substring_after": ("s STRING, t STRING", "STRING", "if(instr(s, t) > 0, substring(s, instr(s, t) + length(t)), '')"),
    "xp_starts_with": ("s STRING, t STRING", "BOOLEAN", "startswith(coalesce(s, ''), coalesce(t, ''))"),
    "xp_contains": ("s STRING, t STRING", "BOOLEAN", "contains(coalesce(s, ''), coalesce(t, ''))"),
    "xp_number": ("s STRING", "DOUBLE", "coalesce(if(s RLIKE '^[ \\\\t\\\\r\\\\n]*-?([0-9]+([.][0-9]*)?|[.][0-9]+)[ \\\\t\\\\r\\\\n]*$', try_cast(trim(s) AS DOUBLE), NULL), double('NaN'))"),
    "xp_round": ("x DOUBLE", "DOUBLE", "if(isnan(x) OR abs(x) = double('Infinity'), x, double(floor(x + 0.5)))"),
}


def register(spark: SparkSession) -> list[str]:
    """Makes the functions (and ``xp_tokens``, a table of a text's tokens) known to the session; returns their names."""
    for name, (parameters, result, expression) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {expression}")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION xp_tokens(s STRING) RETURNS TABLE(position INT, token STRING) RETURN SELECT p + 1, t FROM posexplode(filter(split(coalesce(xp_tokens.s, ''), '[ \\\\t\\\\r\\\\n]+'), w -> w <> '')) AS e(p, t)")
    return [*FUNCTIONS, "xp_tokens"]
