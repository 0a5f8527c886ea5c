"""Vectors in transit and at rest."""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


@pandas_udf(T.ArrayType(T.FloatType()))
def half_precision(vector: pd.Series) -> pd.Series:
    """Unit vectors rounded to half precision, kept as floats; null for null, empty and non-finite vectors. A vector whose
    length is within 1e-4 of 1 is not scaled again."""

    def rounded(v):
        if v is None or not len(v):
            return None
        x = np.asarray(v, dtype="float32")
        if not np.isfinite(x).all():
            return None
        n = float(np.linalg.norm(x))
        if abs(n - 1) > 1e-4:
            x = x / (n + 1e-12)
        return x.astype("float16").astype("float32")

    return vector.map(rounded)


@pandas_udf(T.ArrayType(T.FloatType()))
def decoded_base64(text: pd.Series) -> pd.Series:
    """Little-endian 32-bit floats from base64."""
    return text.map(lambda t: np.frombuffer(base64.b64decode(t), dtype="<f4") if t is not None else None)


def letter_counts(text: Column) -> Column:
    """How often each ASCII letter stands in a text, in any case; a stand-in for a model's vector that is an expression."""
    t = F.lower(F.coalesce(text, F.lit("")))
    return F.array(*((F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))).cast("double") for c in "abcdefghijklmnopqrstuvwxyz"))
