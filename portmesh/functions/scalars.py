"""Identifier, mask, epoch and fingerprint expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed patterns of the format: an identifier, and an edge path `dst:port-src:port`.
IDENTIFIER = r"^[a-zA-Z0-9_]+$"
EDGE_PATH = r"^[a-zA-Z0-9_]+:[a-zA-Z0-9_]+-[a-zA-Z0-9_]+:[a-zA-Z0-9_]+$"
# Two endpoints of two parts each, whatever the parts hold.
PATH_PARTS = r"^([^:-]*):([^:-]*)-([^:-]*):([^:-]*)$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def valid_path(path: Column | str) -> Column:
    return _col(path).rlike(PATH_PARTS)


def split_path(path: Column | str) -> Column:
    """Struct (target, target_port, source, source_port); NULL unless the path has 2 × 2 parts."""
    p = _col(path)
    names = ["target", "target_port", "source", "source_port"]
    parts = [F.regexp_extract(p, PATH_PARTS, i + 1).alias(n) for i, n in enumerate(names)]
    return F.when(valid_path(p), F.struct(*parts))


def edge_id(
    target: Column | str = "target",
    target_port: Column | str = "target_port",
    source: Column | str = "source",
    source_port: Column | str = "source_port",
) -> Column:
    return F.concat(
        _col(target), F.lit(":"), _col(target_port), F.lit("-"),
        _col(source), F.lit(":"), _col(source_port),
    )


def parse_int(text: Column | str, base: int = 0) -> Column:
    """Integer text to BIGINT. Base 0 takes the base from the prefix, as in ``0x1f``."""
    t = F.lower(F.trim(_col(text)))
    from_hex = F.conv(F.regexp_replace(t, "^0x", ""), 16, 10).cast("bigint")
    if base == 16:
        return from_hex
    if base == 0:
        return F.when(t.startswith("0x"), from_hex).otherwise(t.try_cast("bigint"))
    return F.conv(t, base, 10).cast("bigint")


def to_hex(value: Column | str) -> Column:
    return F.lower(F.hex(_col(value)))


def parent_id(partition: Column | str) -> Column:
    """Hierarchical id without its last part; empty for a single part."""
    p = _col(partition)
    return F.when(p.contains("_"), F.regexp_replace(p, "_[^_]*$", "")).otherwise(F.lit(""))


def level_of(partition: Column | str) -> Column:
    """Depth of a hierarchical id: ``base`` is 0, ``base_3`` is 1."""
    return F.size(F.split(_col(partition), "_")) - 1


def is_init(time: Column | str, sequence: Column | str) -> Column:
    """1 for the first snapshot (time 0 and sequence 0), else 0."""
    return F.when((_col(time) == 0) & (_col(sequence) == 0), 1).otherwise(0)


def sampled(epoch: Column | str, granularity: int) -> Column:
    """Whether an epoch is kept when snapshots are taken every ``10 ** granularity`` epochs."""
    return F.pmod(_col(epoch), F.lit(10**granularity)) == 0


def within_limit(time: Column | str, limit: float) -> Column:
    return _col(time) <= F.lit(limit)


def cancelled(flag: Column | str) -> Column:
    return _col(flag) == F.lit("1")


def fingerprint(df: DataFrame, cols: list[str], alias: str = "fingerprint") -> DataFrame:
    """Add a 64-bit hash of typed values: equal values have equal hashes."""
    return df.withColumn(alias, F.xxhash64(*cols))


def ready_ports(states: DataFrame, ports: DataFrame) -> DataFrame:
    """One row per device and output port whose bit is set in the ready mask ``rts``."""
    outputs = ports.filter(F.col("direction") == "output").select(
        F.col("device_type").alias("type"), F.col("name").alias("port"), "idx"
    )
    return states.join(outputs, "type").filter(F.getbit(F.col("rts"), F.col("idx")) == 1)
