"""The functions by name, for SQL."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import entities, structural, tokens

#: SQL functions over text in plain SQL, so they stay within the plan.
_SQL = {
    "ctx_token_count": ("text STRING", "BIGINT", r"regexp_count(coalesce(text, ''), '(?U)\\S+')"),
    "ctx_keyword_sim": ("a STRING, b STRING", "DOUBLE", r"""
        coalesce(size(array_intersect(array_distinct(regexp_extract_all(lower(coalesce(a, '')), "[a-z0-9']+", 0)), array_distinct(regexp_extract_all(lower(coalesce(b, '')), "[a-z0-9']+", 0))))
        / nullif(sqrt(CAST(size(array_distinct(regexp_extract_all(lower(coalesce(a, '')), "[a-z0-9']+", 0))) AS DOUBLE) * size(array_distinct(regexp_extract_all(lower(coalesce(b, '')), "[a-z0-9']+", 0)))), 0), 0.0)"""),
    "ctx_normalize": ("text STRING", "STRING", r"""
        get(transform(array(transform(split(@T, '\n', -1), l -> regexp_replace(l, '(?U)\\s+$', ''))), s ->
          array_join(transform(filter(arrays_zip(s, concat(array(CAST(NULL AS STRING)), slice(s, 1, size(s) - 1))), x -> x['1'] IS NULL OR x.s <> x['1']), x -> x.s), '\n')), 0)""".replace(
        "@T", r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '(?U)^\\s+|\\s+$', ''), '\r\n|\r', '\n'), '[ \t]+', ' '), '\n{3,}', '\n\n')")),
}


def register(spark: SparkSession) -> list[str]:
    """Registers ctx_token_count, ctx_keyword_sim, ctx_normalize, ctx_compress, ctx_entities (type to names) and the table function ctx_extract_entities."""
    for name, (parameters, kind, body) in _SQL.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    spark.udf.register("ctx_rewrite_json", structural.json_rewriter())
    clean = r"regexp_replace(regexp_replace(regexp_replace(CASE WHEN text RLIKE '[{\\[]' THEN ctx_rewrite_json(text) ELSE coalesce(text, '') END, '!{2,}', '!'), '\\?{2,}', '?'), '\\.{4,}', '...')"
    squeezed = rf"regexp_replace(regexp_replace({clean}, '\n{{3,}}', '\n\n'), '[ \t]+', ' ')"
    spark.sql(rf"CREATE OR REPLACE TEMPORARY FUNCTION ctx_compress(text STRING) RETURNS STRING RETURN regexp_replace(array_join(transform(split({squeezed}, '\n', -1), l -> regexp_replace(l, '(?U)\\s+$', '')), '\n'), '(?U)^\\s+|\\s+$', '')")

    @F.udtf(returnType="etype string, name string, pos int")
    class ExtractEntities:
        def eval(self, text: str):
            yield from found_entities(text or "")

    spark.udtf.register("ctx_extract_entities", ExtractEntities)

    @F.pandas_udf("map<string,array<string>>")
    def by_type(texts: pd.Series) -> pd.Series:
        found = (found_entities(t or "") for t in texts)
        return pd.Series([{t: [n for u, n, _ in f if u == t] for t in dict.fromkeys(t for t, _, _ in f)} for f in found], index=texts.index)

    spark.udf.register("ctx_entities", by_type)
    return [*_SQL, "ctx_compress", "ctx_entities", "ctx_extract_entities"]


def found_entities(text: str) -> list[tuple[str, str, int]]:
    """(type, canonical name, place) of a text's entities, for one text."""
    import re

    from turnmill.operators.graph import name_parts

    out = []
    for kind, pattern, group in entities.PATTERNS:
        flags = re.I if "(?iuU)" in pattern else 0
        bare = pattern.replace("(?iuU)", "").replace("(?U)", "")
        seen = dict.fromkeys(m.group(group).strip() if kind == "url" else "_".join(name_parts(m.group(group))) or m.group(group).strip().lower() for m in re.finditer(bare, text, flags))
        out += [(kind, name, k) for k, name in enumerate(n for n in seen if n)]
    return out


def counters() -> dict[str, Callable]:
    """Token counters by name."""
    return {"words": tokens.words, "claude": tokens.claude_estimate}
