"""Scalars without a built-in counterpart."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

from docloom.functions.edits import distance
from docloom.functions.limits import MIB, ConversionError
from docloom.functions.markdown import SPACE


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode's compatibility composition."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.arrow_udf(StructType().add("edits", IntegerType()).add("letters", IntegerType()))
def _edits(expected: pa.Array, actual: pa.Array) -> pa.Array:
    """Both texts in one form with white space collapsed: the distance between them, and the length of what is expected."""
    spaces = re.compile(SPACE + "+")
    plain = lambda t: None if t is None else spaces.sub(" ", unicodedata.normalize("NFKC", t)).strip(" ")
    pairs = [(plain(x), plain(y)) for x, y in zip(expected.to_pylist(), actual.to_pylist(), strict=True)]
    edits = [None if x is None or y is None else distance(x, y) for x, y in pairs]
    letters = [None if x is None else len(x) for x, _ in pairs]
    return pa.StructArray.from_arrays([pa.array(edits, pa.int32()), pa.array(letters, pa.int32())], names=["edits", "letters"])


def character_error_rate(expected: Column, actual: Column) -> Column:
    """error_rate of texts brought into one form, in one Python step."""
    found = _edits(expected, actual)
    return found["edits"] / found["letters"]


def memory_budget(ram_gb: float | None) -> int:
    """Bytes that conversions may take together: 15 % of a machine's memory, at most 1 GiB; 512 MiB where it is not known."""
    if ram_gb is not None and ram_gb < 4:
        raise ConversionError("LOW_MEMORY_DEVICE", "At least 4 GB of memory is needed.")
    return int(min(1024, ram_gb * 1024 * 0.15 if ram_gb else 512) * MIB)
