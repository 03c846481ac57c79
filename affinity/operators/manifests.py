"""Manifests (package.json, requirements.txt) → package URLs, as set-based jobs.

Two readings exist, as in the reference:
- train: what the crawler stores as edges — npm majors are the first digit
  run of the version; PyPI majors the text before the first '.' of the first
  specifier (any operator), '' without one.
- serve: what a user's list is matched with — npm versions keep everything
  after stripping range marks; PyPI versions are the first specifier whose
  operator allows equality, none → no '@'.
JSON is parsed strictly (one whole document, single quotes rejected) and the
dependency object is read as map<string, variant>, so non-string values are
recognised and skipped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinity.functions import purl, requirements
from affinity.functions.json import strict_json
from affinity.session import PACKED, materialize

JAVASCRIPT = "javascript"
PYTHON = "python"
# Languages in lookup order, and their manifest files.
SUPPORTED_LANGUAGES = {JAVASCRIPT: "package.json", PYTHON: "requirements.txt"}
LANGUAGE_ORDER = {JAVASCRIPT: 0, PYTHON: 1}


def parse_package_json(df: DataFrame, text: str = "text", remove_newlines: bool = True) -> DataFrame:
    """Adds `doc` (variant); rows whose text is not JSON get NULL (corrupt manifests)."""
    t = F.translate(F.col(text), "\n", "") if remove_newlines else F.col(text)
    return df.withColumn("doc", strict_json(t))


def _dependency_entries(df: DataFrame, at: str = "$.dependencies") -> DataFrame:
    """One row per (key, value) of the object at `at` of `doc`, value kept as variant."""
    deps = F.try_variant_get(F.col("doc"), at, "map<string,variant>")
    kept = df.select(*[c for c in df.columns if c != "doc"], F.explode(deps).alias("dep_name", "dep_value"))
    return kept.withColumn("dep_version",
                           F.when(F.schema_of_variant("dep_value") == "STRING",
                                  F.variant_get("dep_value", "$", "string")))


def npm_applications(manifests: DataFrame) -> DataFrame:
    """Manifests that parse and have a `dependencies` key (any value): they make an application."""
    p = parse_package_json(manifests)
    has_key = F.try_variant_get(F.col("doc"), "$.dependencies", "variant").isNotNull()
    return p.where(F.col("doc").isNotNull() & has_key).drop("doc")


def corrupt_manifests(manifests: DataFrame) -> DataFrame:
    """package.json texts that do not parse as JSON: skipped as a whole."""
    p = parse_package_json(manifests)
    return p.where(F.col("text").isNotNull() & F.col("doc").isNull()).drop("doc")


def npm_train_edges(manifests: DataFrame) -> DataFrame:
    """(…, purl) `pkg:npm/<key>@<first digit run>`; non-string and digit-free versions skipped."""
    e = _dependency_entries(parse_package_json(manifests))
    major = purl.first_digit_run("dep_version")
    e = e.where(F.col("dep_version").isNotNull() & (major != ""))
    return e.select(*[c for c in manifests.columns if c != "text"],
                    purl.make_purl(purl.NPM, F.concat(F.col("dep_name"), F.lit("@"), major)).alias("purl"))


def npm_serve_purls(manifests: DataFrame, text: str = "text") -> DataFrame:
    """(…, purl) `pkg:npm/<key>@<version without ~ and ^ at the ends>`.

    Only a non-empty `dependencies` object yields purls; non-string values are
    skipped [decision: the reference fails on them].
    """
    return _serve_purls(_dependency_entries(parse_package_json(manifests, text, remove_newlines=False)),
                        [c for c in manifests.columns if c != text])


def _serve_purls(e: DataFrame, columns: list[str]) -> DataFrame:
    e = e.where(F.col("dep_version").isNotNull())
    return e.select(*columns,
                    purl.make_purl(purl.NPM, F.concat(F.col("dep_name"), F.lit("@"),
                                                      purl.strip_range_marks("dep_version"))).alias("purl"))


def npm_fragment_purls(fragments: DataFrame, text: str = "text") -> DataFrame:
    """Pasted `"a": "1", "b": "^2"` fragments: commas trimmed at both ends, wrapped in braces.

    The wrapped text must be one JSON object: a fragment that closes the brace itself yields nothing.
    """
    trimmed = F.regexp_replace(F.col(text), r"^,+|,+$", "")
    wrapped = fragments.withColumn("doc", strict_json(F.concat(F.lit("{ "), trimmed, F.lit(" }"))))
    return _serve_purls(_dependency_entries(wrapped, "$"), [c for c in fragments.columns if c != text])


def requirement_lines(manifests: DataFrame, text: str = "text") -> DataFrame:
    """One row per parsable requirement line: adds `req` struct(name, specs)."""
    lines = manifests.select(*[c for c in manifests.columns if c != text],
                             F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))
    parsed = requirements.parse_lines(lines, "line", "req")
    return parsed.where(F.col("req").isNotNull()).drop("line")


def pypi_train_edges(manifests: DataFrame) -> DataFrame:
    """(…, purl) `pkg:pypi/<name>@<major of the first specifier>`; a bad line drops only itself."""
    r = requirement_lines(manifests)
    major = requirements.train_major(F.col("req.specs"))
    return r.select(*[c for c in manifests.columns if c != "text"],
                    purl.make_purl(purl.PYPI, F.concat(F.col("req.name"), F.lit("@"), major)).alias("purl"))


def pypi_serve_purls(manifests: DataFrame, text: str = "text") -> DataFrame:
    """(…, purl) `pkg:pypi/<name>[@<first version allowing equality>]`."""
    r = requirement_lines(manifests, text)
    version = requirements.serve_version(F.col("req.specs"))
    return r.select(*[c for c in manifests.columns if c != text],
                    purl.make_purl(purl.PYPI, F.col("req.name"), version).alias("purl"))


def parse_dependencies(manifests: DataFrame, from_repository: bool = True) -> DataFrame:
    """Dispatch on `language`: javascript / python; other languages give nothing.

    `from_repository` reads a whole package.json; otherwise the javascript text
    is a pasted fragment of entries.
    """
    js = manifests.where(F.col("language") == JAVASCRIPT)
    py = manifests.where(F.col("language") == PYTHON)
    js_purls = npm_serve_purls(js) if from_repository else npm_fragment_purls(js)
    return js_purls.unionByName(pypi_serve_purls(py))


def api_manifest_text(requests: DataFrame) -> DataFrame:
    """API dependency lists → manifest text per request.

    python: lines joined by newline. javascript: each `name@version` becomes
    `"name":"version"`, split at the LAST '@' so scoped names stay whole
    [decision]; an entry without '@' gets an empty version. The list is
    rebuilt with `transform` on the row's own array (no regrouping).
    """
    deps = F.col("dependencies")

    def js_entry(d):
        at = F.length(d) - F.locate("@", F.reverse(d)) + 1
        has_at = F.locate("@", d) > 0
        name = F.when(has_at, d.substr(F.lit(1), at - 1)).otherwise(d)
        version = F.when(has_at, d.substr(at + 1, F.length(d))).otherwise(F.lit(""))
        return F.concat(F.lit('"'), name, F.lit('":"'), version, F.lit('"'))

    text = (F.when(F.col("language") == PYTHON, F.array_join(deps, "\n"))
             .when(F.col("language") == JAVASCRIPT, F.array_join(F.transform(deps, js_entry), ",")))
    return requests.withColumn("text", text)


def changed_manifests(manifests: DataFrame, stored: DataFrame, key: str = "application_id") -> DataFrame:
    """Manifests (key, language, text) whose fingerprint isn't stored (key, language, hash), with their hash.

    Only hashes are compared; nothing is parsed.
    """
    hashed = manifests.withColumn("hash", F.sha2("text", 256))
    return hashed.join(stored.select(key, "language", "hash"), [key, "language", "hash"], "left_anti")


def edge_changes(changed: DataFrame, edges: DataFrame, key: str = "application_id") -> DataFrame:
    """(key, purl, sign): what changed manifests add to and take from the stored edges (key, purl).

    A manifest stands for the edges of its language's ecosystem: those that it
    no longer lists get sign -1, new ones +1. Manifests that are skipped as a
    whole (corrupt, or package.json without `dependencies`) change nothing, as
    do repositories that have no manifest in `changed`. `changed` is read three
    times: callers pass a written table.
    """
    js, py = (changed.where(F.col("language") == x) for x in (JAVASCRIPT, PYTHON))
    listed = npm_train_edges(js).select(key, "purl").unionByName(pypi_train_edges(py).select(key, "purl"))
    read = (npm_applications(js).select(key, F.lit(purl.NPM).alias("_eco"))
            .unionByName(py.select(key, F.lit(purl.PYPI).alias("_eco"))).distinct())
    held = edges.select(key, "purl", purl.ecosystem("purl").alias("_eco")).join(read, [key, "_eco"], "left_semi")
    both = listed.select(key, "purl", F.lit(1).alias("now"), F.lit(0).alias("then")).unionByName(
        held.select(key, "purl", F.lit(0).alias("now"), F.lit(1).alias("then")))
    return (both.groupBy(key, "purl").agg((F.max("now") - F.max("then")).alias("sign")).where("sign <> 0"))


def latest_by_branch(manifests: DataFrame, key: str = "application_id", order: str = "retrieved") -> DataFrame:
    """The newest manifest of each (key, branch, language); equal times: the greater text."""
    rest = [c for c in manifests.columns if c not in (key, "branch", "language")]
    best = F.max_by(F.struct(*rest), F.struct(order, "text"))
    return (manifests.groupBy(key, "branch", "language").agg(best.alias("_m"))
            .select(key, "branch", "language", *[F.col(f"_m.{c}").alias(c) for c in rest]))


def repo_dependency_union(manifests: DataFrame, key: str | list[str] = "application_id") -> DataFrame:
    """Per repository, or per `key` columns such as (repository, branch): all purls from every language's manifest.

    `language` is the last one found. The manifests are read three times, so they are written first.
    Their texts move to their key's task, not the purls, which repeat what the texts hold.
    """
    keys = [key] if isinstance(key, str) else key
    manifests = materialize(manifests.select(*keys, "language", "text"), "manifests", PACKED).repartition(*keys)
    purls = parse_dependencies(manifests)
    order = F.create_map(*[x for k, v in LANGUAGE_ORDER.items() for x in (F.lit(k), F.lit(v))])
    lang = manifests.groupBy(*keys).agg(
        F.max_by("language", order[F.col("language")]).alias("language"))
    deps = purls.groupBy(*keys).agg(F.array_sort(F.collect_list("purl")).alias("purls"))
    return lang.join(deps, keys, "left").select(
        *keys, "language", F.coalesce("purls", F.array().cast("array<string>")).alias("purls"))
