"""Package-URL column expressions (`pkg:<ecosystem>/<name>@<version>`).

All functions take and return Columns, so they run inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's for right results.
NPM = "npm"
PYPI = "pypi"
NPM_PACKAGE_BASE_URL = "https://npmjs.com/package"
PYPI_PACKAGE_BASE_URL = "https://pypi.org/project"
# a dependency is a known package only up to its major version
MAJOR_VERSION_PATTERN = r"pkg:(npm|pypi)/.*@\d+"
SHORT_NAME_PATTERN = r"pkg:[^/]+/(.*)"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def make_purl(ecosystem: str, name, version=None) -> Column:
    """`pkg:<eco>/<name>` plus `@<version>` when a version is given (NULL → none)."""
    base = F.concat(F.lit(f"pkg:{ecosystem}/"), _c(name))
    if version is None:
        return base
    v = _c(version)
    return F.when(v.isNull(), base).otherwise(F.concat(base, F.lit("@"), v))


def ecosystem(purl) -> Column:
    """The `<eco>` of a purl, '' when the text is not a purl."""
    return F.regexp_extract(_c(purl), r"^pkg:([^/]+)/", 1)


def purl_name(purl) -> Column:
    """Name between the first '/' and the last '@' (scoped names keep their '@')."""
    return F.regexp_extract(_c(purl), r"^[^/]*/(.*)@[^@]*$", 1)


def first_digit_run(version) -> Column:
    """Major version for package.json entries: first run of digits anywhere, '' if none."""
    return F.regexp_extract(_c(version), r"\d+", 0)


def strip_range_marks(version) -> Column:
    """Drop '~' at both ends, then '^' at both ends; the rest of the version is kept."""
    no_tilde = F.regexp_replace(_c(version), r"^~+|~+$", "")
    return F.regexp_replace(no_tilde, r"^\^+|\^+$", "")


def strip_to_major(purl) -> Column:
    """Longest `pkg:(npm|pypi)/…@<digits>` found in the text, '' when none matches."""
    return F.regexp_extract(_c(purl), MAJOR_VERSION_PATTERN, 0)


def short_name(purl) -> Column:
    """`pkg:npm/d3@5` → `d3@5`."""
    return F.regexp_replace(_c(purl), SHORT_NAME_PATTERN, "$1")


def package_url(purl) -> Column:
    """Registry page of a package; NULL for other ecosystems.

    The `@<digits>` suffix is removed; a purl without a numeric version does
    not match, so the whole purl is appended to the base (as the reference does).
    """
    p = _c(purl)
    npm = F.concat(F.lit(NPM_PACKAGE_BASE_URL + "/"),
                   F.regexp_replace(p, r"pkg:npm/(.*)@\d+", "$1"))
    pypi = F.concat(F.lit(PYPI_PACKAGE_BASE_URL + "/"),
                    F.regexp_replace(p, r"pkg:pypi/(.*)@\d+", "$1"))
    return (F.when(p.startswith("pkg:npm"), npm)
             .when(p.startswith("pkg:pypi"), pypi))
