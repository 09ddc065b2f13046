"""Vectors as texts: base64 of little-endian 32-bit floats."""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _decode(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: None if x is None else np.frombuffer(base64.b64decode(x), "<f4"))


def _encode(vectors: pd.Series) -> pd.Series:
    return vectors.map(lambda x: None if x is None else base64.b64encode(np.asarray(x, "<f4").tobytes()).decode())


def decoded(text: Column) -> Column:
    return F.pandas_udf(_decode, "array<float>")(text)


def encoded(vector: Column) -> Column:
    return F.pandas_udf(_encode, "string")(vector)
