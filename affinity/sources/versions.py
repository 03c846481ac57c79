"""Numbered versions of a set of tables under one root, made visible by a marker written last.

`<root>/v=<number>/…` holds the tables of one version and the marker
`<root>/_commits/<number>`, which holds the version's label, is created after
all of them are complete. Readers go by the markers, so tables of one version
are always seen together, and what a crash left behind is overwritten by the
next attempt. A marker is never overwritten: of two writers of one number, the
second fails.
"""

from __future__ import annotations

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _markers(spark: SparkSession, root: str) -> dict[int, str | None]:
    """Label of every marker; None where a writer hasn't finished it (or never will)."""
    fs, p = _fs(spark, f"{root}/_commits")
    if not fs.exists(p):
        return {}
    found: dict[int, str | None] = {}
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if name.isdigit():
            found[int(name)] = None
            if st.getLen():
                stream = fs.open(st.getPath())
                found[int(name)] = stream.readUTF()
                stream.close()
    return dict(sorted(found.items()))


def commits(spark: SparkSession, root: str) -> dict[int, str]:
    """Label of every committed version, oldest first."""
    return {n: label for n, label in _markers(spark, root).items() if label is not None}


def newest(spark: SparkSession, root: str) -> int | None:
    return max(commits(spark, root), default=None)


def following(spark: SparkSession, root: str) -> int:
    """The number of the next version."""
    return max(_markers(spark, root), default=0) + 1


def path(root: str, version: int, table: str) -> str:
    return f"{root}/v={version:010d}/{table}"


def commit(spark: SparkSession, root: str, version: int, label: str) -> None:
    """Make a version visible. Fails if another writer has committed the same number."""
    fs, marker = _fs(spark, f"{root}/_commits/{version:010d}")
    try:
        stream = fs.create(marker, False)      # without overwriting: the file system lets one writer through
    except Exception as e:
        if version in _markers(spark, root):
            raise RuntimeError(f"version {version} of {root} is already committed") from e
        raise
    stream.writeUTF(label)
    stream.close()
