"""The engine's functions for SQL: after register(spark) a session has them by name.

They are SQL functions: their bodies are put in where they are called, so Catalyst optimises
through them and no Python runs.

    SELECT * FROM (SELECT doc_id, inline_outer(w) FROM
      (SELECT doc_id, windows_of(tokens_of(text), 512, 384) AS w FROM documents)) WHERE chunk_idx IS NOT NULL

Windows are an array, not a table function: a lateral one would be joined to its texts by them,
and they shuffled for that. inline() alone would be given a filter that cuts each text again.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from quernstone.catalog import INJECTION, REDACTIONS, STRIDE, WINDOW
from quernstone.functions.text import WHITE


def _text(x: str) -> str:
    """A literal in SQL, whatever x holds."""
    return f"cast(X'{x.encode().hex()}' AS string)"


def _redacted() -> str:
    out = "t"
    for name, pattern, exact in REDACTIONS:
        out = f"regexp_replace({out}, {_text(pattern if exact else '(?i)' + pattern)}, '[REDACTED_{name.upper()}]')"
    return out


def _injections() -> str:
    hits = ", ".join(f"regexp_extract(t, {_text('(?idu)(' + p + ')')}, 1)" for p in INJECTION)
    return f"filter(array({hits}), x -> x <> '')"


TOKENS = f"filter(split(t, {_text(WHITE)}), x -> x <> '')"
COUNT = "CASE WHEN n > 0 THEN cast(1 + ceil(greatest(n - size, 0) / stride) AS int) ELSE 0 END"

#: name, parameters, what is returned, body
FUNCTIONS = (
    ("tokens_of", "t STRING", "ARRAY<STRING>", TOKENS),
    ("window_count", f"n INT, size INT DEFAULT {WINDOW}, stride INT DEFAULT {STRIDE}", "INT", COUNT),
    ("redacted", "t STRING", "STRING", _redacted()),
    ("injections", "t STRING", "ARRAY<STRING>", _injections()),
    ("suspicious", "t STRING", "BOOLEAN", " OR ".join(f"t RLIKE {_text('(?idu)' + p)}" for p in INJECTION)),
    ("cache_key", "model STRING, field STRING, t STRING", "STRING", "sha2(concat_ws(':', model, field, t), 256)"),
    (
        "windows_of",
        f"toks ARRAY<STRING>, size INT DEFAULT {WINDOW}, stride INT DEFAULT {STRIDE}",
        "ARRAY<STRUCT<chunk_idx: INT, token_start: INT, token_end: INT, text: STRING>>",
        """CASE WHEN cardinality(toks) > 0 THEN transform(sequence(0, cast(ceil(greatest(cardinality(toks) - size, 0) / stride) AS int)),
        i -> named_struct('chunk_idx', i, 'token_start', i * stride, 'token_end', least(i * stride + size, cardinality(toks)), 'text', array_join(slice(toks, i * stride + 1, size), ' '))) END""",
    ),
)


def register(spark: SparkSession) -> None:
    """Makes the functions known to a session; done again, it replaces them."""
    for name, parameters, returns, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {returns} RETURN {body}")
