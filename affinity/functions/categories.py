"""Category list cleaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters removed from every category, and the classifier prefix.
CATEGORY_DROP_CHARS = r"[,{}'\"\[\]]"
TOPIC_PREFIX = "Topic :: "


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def clean_categories(categories) -> Column:
    """Drop `, { } ' " [ ]` in each entry and drop empty entries.

    A NULL or empty input list gives NULL; a non-empty list whose entries all
    become empty gives an empty list.
    """
    c = _c(categories)
    cleaned = F.filter(F.transform(c, lambda x: F.regexp_replace(x, CATEGORY_DROP_CHARS, "")),
                       lambda x: F.length(x) > 0)
    return F.when(F.size(c) > 0, cleaned)


def topics_from_classifiers(classifiers) -> Column:
    """Classifiers containing `Topic :: `, with that text removed.

    Each kept entry is inserted before the last one collected so far, which
    leaves entries 2..n followed by entry 1.
    """
    topics = F.transform(F.filter(_c(classifiers), lambda x: F.instr(x, TOPIC_PREFIX) > 0),
                         lambda x: F.replace(x, F.lit(TOPIC_PREFIX), F.lit("")))
    n = F.size(topics)
    return F.when(n <= 1, topics).otherwise(
        F.concat(F.slice(topics, 2, n - 1), F.slice(topics, 1, 1)))

