"""requirements.txt line grammar as column expressions.

A line is kept when, after trimming and cutting an inline ` #` comment and a
`;` environment marker, it reads `name[extras] spec, spec, …` with specifier
operators `=== == ~= != <= >= < >`. Blank lines, comments, option lines
(`-r`, `-e`, …) and anything else are dropped. Specifiers keep their textual
order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Specifier operators, longest first so `===` wins over `==`.
SPEC_OPERATORS = ["===", "==", "~=", "!=", "<=", ">=", "<", ">"]

_OP = "(?:" + "|".join(SPEC_OPERATORS) + ")"
_SPEC = _OP + r"\s*[^,\s]+"
LINE_PATTERN = (r"^([A-Za-z0-9][A-Za-z0-9._-]*)\s*(\[[^\]]*\])?\s*"
                r"(" + _SPEC + r"(?:\s*,\s*" + _SPEC + r")*)?\s*$")
SPEC_PATTERN = "(" + _OP + r")\s*([^,\s]+)"


def clean_line(line: Column) -> Column:
    """Trimmed line without inline comment or environment marker."""
    s = F.trim(line)
    s = F.regexp_replace(s, r"\s+#.*$", "")
    s = F.regexp_replace(s, r";.*$", "")
    return F.trim(s)


def is_candidate(line: Column) -> Column:
    """Not blank, not a comment, not an option line."""
    s = F.trim(line)
    return (F.length(s) > 0) & ~s.startswith("#") & ~s.startswith("-")


def parse_line(line: Column) -> Column:
    """struct(name, specs array<struct(op, version)>) or NULL when the line is not a requirement."""
    s = clean_line(line)
    ok = is_candidate(line) & s.rlike(LINE_PATTERN)
    spec_text = F.regexp_extract(s, LINE_PATTERN, 3)
    ops = F.regexp_extract_all(spec_text, F.lit(SPEC_PATTERN), F.lit(1))
    versions = F.regexp_extract_all(spec_text, F.lit(SPEC_PATTERN), F.lit(2))
    specs = F.zip_with(ops, versions,
                       lambda o, v: F.struct(o.alias("op"), v.alias("version")))
    return F.when(ok, F.struct(F.regexp_extract(s, LINE_PATTERN, 1).alias("name"),
                               specs.alias("specs")))


def serve_version(specs: Column) -> Column:
    """First specifier whose operator contains '=' (an allowed version), else NULL."""
    return F.get(F.filter(specs, lambda s: F.instr(s["op"], "=") > 0), 0)["version"]


def train_major(specs: Column) -> Column:
    """Text before the first '.' of the first specifier, any operator; '' without one."""
    first = F.get(specs, 0)["version"]
    return F.when(F.size(specs) > 0, F.split(first, r"\.")[0]).otherwise(F.lit(""))


def parse_lines(df, line: str = "line", out: str = "req"):
    """`parse_line` as staged projections: clean once, match the line pattern once.

    Returns df with `out` = struct(name, specs), NULL for non-requirements.
    """
    staged = df.withColumn("_clean", F.when(is_candidate(F.col(line)), clean_line(F.col(line))))
    staged = staged.withColumn("_name", F.regexp_extract("_clean", LINE_PATTERN, 1)) \
                   .withColumn("_specs_text", F.regexp_extract("_clean", LINE_PATTERN, 3))
    ops = F.regexp_extract_all("_specs_text", F.lit(SPEC_PATTERN), F.lit(1))
    versions = F.regexp_extract_all("_specs_text", F.lit(SPEC_PATTERN), F.lit(2))
    specs = F.zip_with(ops, versions, lambda o, v: F.struct(o.alias("op"), v.alias("version")))
    # a match always has a non-empty name group, so '' means "not a requirement"
    req = F.when(F.col("_name") != "", F.struct(F.col("_name").alias("name"), specs.alias("specs")))
    return staged.withColumn(out, req).drop("_clean", "_name", "_specs_text")
