"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def ascii_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased, as UTF-8 (null: none).

    ``bytes.split`` and ``bytes.lower`` know ASCII only, which is exactly that class and that folding.
    """
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def hash_words(words: list[bytes]) -> np.ndarray:
    """Stable 64-bit hashes of the words."""
    if not words:
        return np.empty(0, np.uint64)
    held = np.empty(len(words), dtype=object)
    held[:] = words
    return pd.util.hash_array(held, categorize=False)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; fewer than k words make one shingle, none make none."""
    h = hash_words(words)
    n = len(h)
    if n == 0:
        return h
    width = min(k, n)
    out = np.zeros(n - width + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            out = mix64(out + h[i : n - width + 1 + i] + np.uint64(0x9E3779B97F4A7C15))
    return np.unique(out)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[dict[str, list]]], Iterator[dict[str, list]]], schema: StructType) -> DataFrame:
    """``mapInArrow`` over column lists: ``fn`` gets an iterator of {column: list} and yields the same."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ({n: b.column(i) for i, n in enumerate(b.schema.names)} for b in batches)
        for out in fn(columns):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def crc_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``: splits rows into folds."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def in_fold(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether the id falls into the fold; a null id falls into none."""
    return F.coalesce(crc_remainder(doc_id, modulus) == remainder, F.lit(False))
