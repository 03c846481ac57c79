import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, `key` string, node long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties and repeated rows, and columns with clashing names."""
    from affinity.llm.common import prepare
    prepare(spark)
    base = " ".join(f"word{i * i % 97}x{i}" for i in range(300))
    near = base.replace("word4x2 ", "changed ")
    rows = [(1, base), (2, base), (3, near), (4, None), (5, ""), (6, "short"), (7, "two words"), (None, base), (None, None),
            (8, "Émile naïve 漢字 😀 \u0085   <|endoftext|> it's"), (8, "same id, other text"), (9, "tie"), (9, "tie"),
            (10, "long " * 40_000), (11, 'key token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" and a.29@mail5.example.com'),
            (12, "x" * 399), (13, "y" * 401), (14, base + " tail of its own")]
    return spark.createDataFrame([(i, t, None, f"src{n % 3}" if n % 2 else None, len(t) if t else None, 0.5, "k", 1)
                                  for n, (i, t) in enumerate(rows)], DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    from affinity.llm.common import prepare
    prepare(spark)
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(1, 15)] + [(None, 1, 0), (3, None, None)],
                                 "doc_id long, quality int, toxic int")
