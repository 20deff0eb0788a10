"""What the operators share: reading tables, keys of rows, word hashes in NumPy, scratch tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from portmesh.session import scratch_folder

#: White space of the word definitions: space and tab to carriage return.
BLANK = r"[\x20\x09-\x0D]+"

_ODD = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_BASE = 0x5851F42D4C957F2D
_UNBASE = pow(_BASE, -1, 1 << 64)
_PIECE = 1 << 20
_powers = {"n": 0}

_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[[32, 9, 10, 11, 12, 13]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written once to the shared scratch folder and read back: evaluated once, and safe when
    executors are lost. ``options`` are those of the Parquet writer."""
    path = scratch_folder(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def columns_of(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, whatever else the table has."""
    return docs.select(*(F.col(f"`{n}`") for n in names))


def words_of(text: Column) -> Column:
    """The words of a text between ASCII white space; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK), "")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _powers["n"] < n:
        size = max(n, 1 << 16)
        for key, base in (("up", _BASE), ("down", _UNBASE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[key] = np.multiply.accumulate(steps)
        _powers["n"] = size
    return _powers["up"], _powers["down"]


def words_view(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes belong to words (all but ASCII white space), and the bytes to hash."""
    return ~_IS_BLANK[raw], raw


def _piece_hashes(raw: np.ndarray, view) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mask, raw = view(raw)
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = mask
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    up, down = _power_tables(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    value = (sums[ends] - sums[starts]) * down[starts]
    return mix(value + (ends - starts).astype(np.uint64) * _ODD), starts, ends


def word_hashes(text: bytes, view=words_view) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit hash, the start and the end byte of each word (run of bytes in ``view``'s mask). Long
    texts go piece by piece, cut at white space; memory follows the piece, or the longest word if that
    is longer."""
    raw = np.frombuffer(text, np.uint8)
    if len(raw) <= _PIECE:
        return _piece_hashes(raw, view)
    parts, at = [], 0
    while at < len(raw):
        stop = min(at + _PIECE, len(raw))
        while stop < len(raw):
            gap = np.flatnonzero(_IS_BLANK[raw[stop : stop + _PIECE]])
            if len(gap):
                stop += int(gap[0])
                break
            stop = min(stop + _PIECE, len(raw))
        hashes, starts, ends = _piece_hashes(raw[at:stop], view)
        parts.append((hashes, starts + at, ends + at))
        at = stop
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def windows(values: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` values; of all of them if there are fewer; none for none."""
    width = min(width, len(values))
    if not width:
        return np.zeros(0, np.uint64)
    n = len(values) - width + 1
    total = np.full(n, seed, np.uint64)
    for k in range(width):
        total = total * _ODD + values[k : k + n]
    return mix(total)


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """The sorted distinct hashes of the word shingles of a lower-cased text; a text of fewer words is
    one shingle; empty for a text without words."""
    return np.unique(windows(word_hashes((text or "").lower().encode("utf-8", "replace"))[0], width))
