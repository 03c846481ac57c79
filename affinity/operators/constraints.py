"""Table rules: unique keys, required columns and references, as rows, as counts, and as a gate before a commit."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rules:
    """A table's unique key and the columns that must not be null; `key` names a row in reports."""
    table: str
    unique: tuple[str, ...]
    required: tuple[str, ...] = ()

    @property
    def unique_rule(self) -> str:
        return f"{self.table}.{self.unique[0]} unique" if len(self.unique) == 1 else f"{self.table} pair unique"

    @property
    def required_rule(self) -> str:
        return f"{self.table} not null"


APPLICATIONS = Rules("applications", ("url",), ("url", "name", "hash", "retrieved"))
PACKAGES = Rules("packages", ("name",), ("name", "retrieved"))
DEPENDENCIES = Rules("dependencies", ("application_id", "package_id"))
SIMILARITY = Rules("similarity", ("package_a", "package_b"), ("similarity",))
# child table, its column, the table whose ids it must be
REFERENCES = (("dependencies", "application_id", "applications"), ("dependencies", "package_id", "packages"),
              ("similarity", "package_a", "packages"), ("similarity", "package_b", "packages"))


def _text(columns: tuple[str, ...]) -> Column:
    return F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("NULL")) for c in columns])


def _missing(rules: Rules) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in rules.required], F.lit(False))


def broken_keys(df: DataFrame, rules: Rules) -> DataFrame:
    """(rule, key, rows) of a table's own rules: one grouping by its unique key finds both kinds."""
    groups = df.groupBy(*rules.unique).agg(F.count(F.lit(1)).alias("n"),
                                           F.sum(_missing(rules).cast("long")).alias("missing")).where("n > 1 or missing > 0")

    def fault(rule: str, rows: str, least: int) -> Column:
        return F.when(F.col(rows) > least, F.struct(F.lit(rule).alias("rule"), F.col(rows).alias("rows")))

    faults = F.array_compact(F.array(fault(rules.unique_rule, "n", 1), fault(rules.required_rule, "missing", 0)))
    return groups.select(_text(rules.unique).alias("key"), F.explode(faults).alias("f")).select("f.rule", "key", "f.rows")


def dangling_keys(tables: dict[str, DataFrame]) -> DataFrame:
    """(rule, key, rows): ids that have no parent row.

    The children of one parent share one grouping by the id, with a count a
    rule, and one anti join. Each child is read once for all its columns, and
    what moves is one row of numbers an id.
    """
    out = []
    for parent in sorted({p for _, _, p in REFERENCES}):
        rules = [(child, column) for child, column, p in REFERENCES if p == parent]
        keys = []
        for child in dict.fromkeys(child for child, _ in rules):
            found = [F.struct(F.col(column).cast("long").alias("id"), F.lit(i).alias("rule"))
                     for i, (c, column) in enumerate(rules) if c == child]
            keys.append(tables[child].select(F.explode(F.array(*found)).alias("k")).select("k.id", "k.rule").where("id is not null"))
        counted = reduce(DataFrame.unionByName, keys).groupBy("id").agg(
            *[F.count_if(F.col("rule") == i).alias(f"n{i}") for i in range(len(rules))])
        lost = counted.join(tables[parent].select(F.col("id").cast("long").alias("id")), "id", "left_anti")
        named = [F.struct(F.lit(f"{child}.{column} references {parent}").alias("rule"), F.col(f"n{i}").alias("rows"))
                 for i, (child, column) in enumerate(rules)]
        out.append(lost.select(F.col("id").cast("string").alias("key"), F.explode(F.array(*named)).alias("f"))
                   .where("f.rows > 0").select("f.rule", "key", "f.rows"))
    return reduce(DataFrame.unionByName, out)


def violating_keys(applications: DataFrame, packages: DataFrame, dependencies: DataFrame,
                   similarity: DataFrame) -> DataFrame:
    """(rule, key, rows): every key that breaks a rule of the data model, and its number of rows.

    Keys of two columns are joined by a comma; a null in a key reads NULL.
    """
    tables = {"applications": applications, "packages": packages, "dependencies": dependencies, "similarity": similarity}
    own = [broken_keys(tables[r.table], r) for r in (APPLICATIONS, PACKAGES, DEPENDENCIES, SIMILARITY)]
    return reduce(DataFrame.unionByName, [*own, dangling_keys(tables)])


def rule_names() -> list[str]:
    own = [name for r in (APPLICATIONS, PACKAGES, DEPENDENCIES, SIMILARITY)
           for name in (r.unique_rule, *([r.required_rule] if r.required else []))]
    return own + [f"{c}.{column} references {p}" for c, column, p in REFERENCES]


def check_constraints(applications: DataFrame, packages: DataFrame, dependencies: DataFrame,
                      similarity: DataFrame) -> DataFrame:
    """(rule, violations) for the data model's rules, 0 where one holds.

    A unique rule counts keys that occur more than once, the others count rows.
    """
    found = violating_keys(applications, packages, dependencies, similarity)
    rows = F.when(F.col("rule").endswith(" unique"), F.lit(1)).otherwise(F.col("rows")).cast("long")
    # every rule is in the report: the names are a few constant rows
    names = found.sparkSession.range(1).select(F.explode(F.array(*[F.lit(n) for n in rule_names()])).alias("rule"),
                                               F.lit(0).cast("long").alias("rows"))
    return (found.select("rule", rows.alias("rows")).unionByName(names)
            .groupBy("rule").agg(F.sum("rows").alias("violations")))


class ConstraintError(ValueError):
    """A table that breaks its rules; `broken` holds rule → number of keys or rows."""

    def __init__(self, table: str, broken: dict[str, int]):
        self.broken = broken
        super().__init__(f"{table}: " + ", ".join(f"{rule}: {n}" for rule, n in broken.items()))


def write_checked(df: DataFrame, path: str, rules: Rules, partition_by: list[str] | None = None,
                  mode: str = "errorifexists") -> DataFrame:
    """Write a table, and raise `ConstraintError` if it breaks its own rules, so that its version isn't committed.

    Nulls are counted while the rows are written. Uniqueness takes one grouping
    of the written key columns.
    """
    seen = Observation()
    watched = df.observe(seen, F.count(F.lit(1)).alias("rows"), F.sum(_missing(rules).cast("long")).alias("missing"))
    writer = watched.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    written = df.sparkSession.read.parquet(path)
    missing = seen.get["missing"] or 0
    repeated = written.groupBy(*rules.unique).count().where("count > 1").count()
    broken = {rule: n for rule, n in ((rules.unique_rule, repeated), (rules.required_rule, missing)) if n}
    if broken:
        raise ConstraintError(rules.table, broken)
    return written
