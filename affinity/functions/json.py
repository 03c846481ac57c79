"""JSON that must be one document: nothing may follow it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strict_json(column: str | Column) -> Column:
    """The text as a variant, or NULL unless the whole text is exactly one JSON document.

    `try_parse_json` ignores text after the document. Here the text is parsed
    as the first of two elements of an array whose second is the text's own
    hash: any text that ends the document early shifts or breaks the array.
    """
    text = F.col(column) if isinstance(column, str) else column
    mark = F.sha2(text, 256)
    pair = F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"'), mark, F.lit('"]')))
    whole = (F.size(F.try_variant_get(pair, "$", "array<variant>")) == 2) & (
        F.try_variant_get(pair, "$[1]", "string") == mark)
    return F.when(whole, F.try_variant_get(pair, "$[0]", "variant"))
