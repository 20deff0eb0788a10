"""Dictionaries of distinct typed values with dense indexes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from portmesh.operators.skew import number_rows


def dictionary_encode(
    df: DataFrame, cols: Sequence[str], alias: str = "value_id"
) -> tuple[DataFrame, DataFrame]:
    """Replace ``cols`` by the dense index of their value; returns (rows, dictionary).

    Values are reduced to their distinct set before they are numbered, in value order, from 0.
    """
    dictionary = number_rows(df.select(*cols).distinct(), list(cols), alias)
    kept = [c for c in df.columns if c not in cols]
    return df.join(dictionary, list(cols)).select(*kept, alias), dictionary


def decode_ids(df: DataFrame, dictionary: DataFrame, alias: str = "value_id") -> DataFrame:
    """The inverse: look the values of each index up again."""
    return df.join(dictionary, alias)
