"""Names of rows: equal for rows of equal doc_id and text only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KEY = ["k1", "k2"]


def row_key(doc_id: str = "doc_id", text: str = "text") -> dict[str, Column]:
    """Two 64-bit hashes of doc_id and text, never null; a null differs from any value."""
    parts = [F.col(doc_id).isNull(), F.col(doc_id), F.col(text).isNull(), F.col(text)]
    return {name: F.xxhash64(F.lit(f"{name} of a row"), *parts) for name in KEY}
