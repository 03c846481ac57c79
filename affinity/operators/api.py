"""The recommendation API as a table job: validate request bodies, parse lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinity.functions.json import strict_json
from affinity.operators import manifests
from affinity.operators.recommend import DEFAULT_MAX_RECOMMENDATIONS

# The API's error texts.
ERR_JSON = "Could not parse JSON."
ERR_KEYS = "Required JSON keys: `dependencies`, `language`"
ERR_LOWER = "Error casting language to lower(): '{}' object has no attribute 'lower'"
ERR_LIST = "{} dependencies must be non-empty and of type LIST (i.e. [...])."
ERR_LANGUAGE = "Language not supported: [{}]."

# JSON value kinds → the name of the Python type a JSON reader would produce
_PY_TYPE = [("VOID", "NoneType"), ("BOOLEAN", "bool"), ("ARRAY", "list"), ("OBJECT", "dict"),
            ("DOUBLE", "float"), ("FLOAT", "float"), ("DECIMAL", "float")]


def _py_type(schema: Column) -> Column:
    expr = F.lit("int")
    for prefix, name in reversed(_PY_TYPE):
        expr = F.when(schema.startswith(prefix), F.lit(name)).otherwise(expr)
    return expr


def validate_requests(requests: DataFrame, body: str = "body") -> DataFrame:
    """Adds status ('ok' / 'error'), error, language, dependencies, max_recommendations.

    Checks run in the API's order: JSON, required keys, language is text,
    dependencies a non-empty list, language supported. The first failing
    check gives the error.
    """
    # Parse once per row in its own projection; the checks below read the
    # parsed columns instead of re-parsing inside every branch.
    parsed = requests.select(
        "*", strict_json(body).alias("_v")).select(
        "*", F.try_variant_get("_v", "$.dependencies", "variant").alias("_deps_v"),
        F.try_variant_get("_v", "$.language", "variant").alias("_lang_v"),
        F.schema_of_variant("_v").alias("_v_kind"))
    parsed = parsed.select(
        "*", F.schema_of_variant("_lang_v").alias("_lang_kind"),
        F.lower(F.try_variant_get("_lang_v", "$", "string")).alias("_language"),
        F.try_variant_get("_deps_v", "$", "array<string>").alias("_deps"),
        F.schema_of_variant("_deps_v").alias("_deps_kind"))
    v, deps_v, lang_v = F.col("_v"), F.col("_deps_v"), F.col("_lang_v")
    lang_schema, language, deps = F.col("_lang_kind"), F.col("_language"), F.col("_deps")
    deps_is_list = F.col("_deps_kind").startswith("ARRAY") & (F.size(deps) > 0)
    capitalized = F.concat(F.upper(F.substring(language, 1, 1)), F.substring(language, 2, 1 << 30))
    supported = language.isin(*manifests.SUPPORTED_LANGUAGES)
    error = (F.when(v.isNull(), F.lit(ERR_JSON))
              .when(~F.col("_v_kind").startswith("OBJECT") | deps_v.isNull() | lang_v.isNull(),
                    F.lit(ERR_KEYS))
              .when(lang_schema != "STRING",
                    F.format_string(ERR_LOWER.replace("{}", "%s"), _py_type(lang_schema)))
              .when(~deps_is_list, F.format_string(ERR_LIST.replace("{}", "%s"), capitalized))
              .when(~supported, F.format_string(ERR_LANGUAGE.replace("{}", "%s"), language)))
    limit = F.coalesce(F.try_variant_get(v, "$.max_recommendations", "bigint"),
                       F.lit(DEFAULT_MAX_RECOMMENDATIONS).cast("bigint"))
    out = parsed.select("*", error.alias("error"), limit.alias("_limit"))
    ok = F.col("error").isNull()
    return out.select(
        *requests.columns,
        F.when(ok, F.lit("ok")).otherwise(F.lit("error")).alias("status"), "error",
        F.when(ok, language).alias("language"),
        F.when(ok, deps).alias("dependencies"),
        F.when(ok, F.col("_limit")).alias("max_recommendations"))


def request_purls(valid: DataFrame) -> DataFrame:
    """(request_id, purl) for valid requests: list → manifest text → purls."""
    ok = valid.where(F.col("status") == "ok").select("request_id", "language", "dependencies")
    texts = manifests.api_manifest_text(ok).select("request_id", "language", "text")
    return manifests.parse_dependencies(texts, from_repository=False).select("request_id", "purl")
