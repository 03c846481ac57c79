"""DuckDB SQL texts equivalent to the registered Spark queries.

They run on the same Parquet tables (views named after the tables) and
re-derive the corpus of `affinity.sources.corpus` with plain SQL, so every
Spark operator is checked against an independent formulation.
DuckDB has no width_bucket: `_wb` spells out Spark's formula.
"""

from __future__ import annotations

from affinity.sources import corpus as C

AS_OF = C.AS_OF


def _wb(x: str, lo: str, hi: str, n: int = 9) -> str:
    return (f"(CASE WHEN ({lo}) = ({hi}) THEN NULL WHEN ({x}) < ({lo}) THEN 0 "
            f"WHEN ({x}) >= ({hi}) THEN {n + 1} "
            f"ELSE CAST(floor({float(n)} * (({x}) - ({lo})) / (({hi}) - ({lo}))) AS BIGINT) + 1 END)")


def _date_back(months: int) -> str:
    return f"CAST(DATE '{AS_OF}' - INTERVAL {months} MONTH AS DATE)"


SLUG = "replace(p_name, ' ', '-') || '-' || CAST(p_partkey AS VARCHAR)"
ECO = "CASE WHEN p_partkey % 2 = 0 THEN 'npm' ELSE 'pypi' END"
MAJOR = (f"CASE WHEN p_partkey % 2 = 1 AND p_size >= {C.VERSIONLESS_MIN_SIZE} THEN '' "
         f"ELSE CAST(p_size AS VARCHAR) END")

CTE = {
    "pk": f"""pk AS (
  SELECT p_partkey AS id, 'pkg:' || {ECO} || '/' || {SLUG} || '@' || {MAJOR} AS name,
         {SLUG} AS slug, p_size, p_type, p_brand
  FROM part)""",
    "ship": f"""ship AS (
  SELECT l_partkey,
    CAST(sum(CASE WHEN CAST(l_shipdate AS DATE) BETWEEN {_date_back(1)} AND DATE '{AS_OF}'
                  THEN l_quantity ELSE 0.0 END) AS BIGINT) AS last_month,
    CAST(sum(CASE WHEN CAST(l_shipdate AS DATE) BETWEEN {_date_back(13)} AND {_date_back(12)}
                  THEN l_quantity ELSE 0.0 END) AS BIGINT) AS year_ago,
    max(l_shipdate) AS modified
  FROM lineitem GROUP BY l_partkey)""",
    "packages": """packages AS (
  SELECT id, name, ship.last_month AS monthly_downloads_last_month,
         ship.year_ago AS monthly_downloads_a_year_ago, p_type, p_brand,
         p_type || ',' || p_brand AS categories, modified
  FROM pk LEFT JOIN ship ON pk.id = ship.l_partkey)""",
    "e": """e AS (SELECT DISTINCT l_orderkey AS app, l_partkey AS pkg FROM lineitem)""",
    "deg": """deg AS (SELECT pkg, count(*) AS n FROM e GROUP BY pkg)""",
    "pairs": """pairs AS (
  SELECT co.a AS package_a, co.b AS package_b,
         co.c / sqrt(CAST(da.n AS DOUBLE) * CAST(db.n AS DOUBLE)) AS similarity
  FROM (SELECT x.pkg AS a, y.pkg AS b, count(*) AS c
        FROM e x JOIN e y ON x.app = y.app AND x.pkg < y.pkg GROUP BY x.pkg, y.pkg) co
  JOIN deg da ON da.pkg = co.a JOIN deg db ON db.pkg = co.b)""",
    "sim": f"""sim AS (
  SELECT package_a, package_b, similarity, CAST({_wb('similarity', '0.0', '1.0')} AS INTEGER) AS bounded_similarity
  FROM (SELECT package_a, package_b, similarity FROM pairs
        UNION ALL SELECT package_b, package_a, similarity FROM pairs))""",
    "pop": """pop AS (SELECT package_b, count(*) AS popularity FROM sim GROUP BY package_b)""",
    "p1": """p1 AS (
  SELECT id, name, categories, modified,
         coalesce(monthly_downloads_last_month, 0) AS monthly_downloads_last_month,
         coalesce(monthly_downloads_a_year_ago, 0) AS monthly_downloads_a_year_ago,
         coalesce(pop.popularity, 0) AS popularity
  FROM packages LEFT JOIN pop ON packages.id = pop.package_b)""",
    "p2": """p2 AS (
  SELECT *, log10(popularity + 1) AS lp,
         log10(monthly_downloads_last_month + 1) - log10(monthly_downloads_a_year_ago + 1) AS at_v,
         log10(monthly_downloads_last_month + 1) / (log10(monthly_downloads_a_year_ago + 1) + 1) AS rt_v
  FROM p1)""",
    "bounds": """bounds AS (
  SELECT max(lp) AS lp_hi, min(at_v) AS at_lo, max(at_v) AS at_hi,
         min(rt_v) AS rt_lo, max(rt_v) AS rt_hi FROM p2)""",
    "scored": f"""scored AS (
  SELECT p2.*,
    CAST({_wb('lp', '0.0', 'lp_hi')} AS INTEGER) AS bounded_popularity,
    CAST({_wb('at_v', 'at_lo', 'at_hi')} AS INTEGER) AS absolute_trend,
    CAST({_wb('rt_v', 'rt_lo', 'rt_hi')} AS INTEGER) AS relative_trend,
    regexp_replace(name, 'pkg:[^/]+/(.*)', '\\1') AS short_name,
    CASE WHEN name LIKE 'pkg:npm%' THEN 'https://npmjs.com/package/' || regexp_replace(name, 'pkg:npm/(.*)@\\d+', '\\1')
         WHEN name LIKE 'pkg:pypi%' THEN 'https://pypi.org/project/' || regexp_replace(name, 'pkg:pypi/(.*)@\\d+', '\\1')
    END AS url,
    strftime(modified, '%Y-%m-%d') AS display_date
  FROM p2, bounds)""",
}

# dependencies of each CTE, so a query names only what it selects from
NEEDS = {
    "packages": ["pk", "ship"], "deg": ["e"], "pairs": ["e", "deg"], "sim": ["pairs"],
    "pop": ["sim"], "p1": ["packages", "pop"], "p2": ["p1"], "bounds": ["p2"],
    "scored": ["p2", "bounds"],
}


def with_ctes(*names: str, extra: dict[str, str] | None = None) -> str:
    """WITH clause holding the named CTEs and everything they depend on, in order."""
    order: list[str] = []
    extra = extra or {}

    def visit(n: str) -> None:
        for d in NEEDS.get(n, []):
            visit(d)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    parts = [CTE[n] if n in CTE else extra[n] for n in order]
    return "WITH " + ",\n".join(parts) + "\n"


def composite_sql(s: str, bp: str, at: str, rt: str) -> str:
    return (f"CAST(CEIL(CAST(CEIL(10 * {s}) AS DOUBLE) * CAST(0.5 AS DOUBLE)"
            f" + CAST({bp} * 0.3 AS DOUBLE) + CAST({at} * 0.1 AS DOUBLE)"
            f" + CAST({rt} * 0.1 AS DOUBLE)) AS INTEGER)")
