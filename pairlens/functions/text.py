"""Text normalisation that the built-ins lack."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def nfkc(text: Column) -> Column:
    """NFKC of a text, by Arrow batches: there is no built-in for it. Null stays null."""

    @F.pandas_udf("string")
    def normal(s: pd.Series) -> pd.Series:
        return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")

    return normal(text)


def content_hash(text: Column) -> Column:
    """SHA-256 of the NFKC text with runs of blanks made one and the ends trimmed."""
    return F.sha2(F.trim(F.regexp_replace(nfkc(text), r"(?U)\s+", " ")), 256)
