"""Text similarity of template pairs (matched pairs only, so a small input)."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.DoubleType())
def _block_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def text_similarity(a: Column, b: Column) -> Column:
    """Matching-block ratio in [0, 1]."""
    return F.when(a == b, F.lit(1.0)).otherwise(_block_ratio(a, b))
