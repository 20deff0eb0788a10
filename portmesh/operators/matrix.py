"""Sparse matrices as (row, col, value) tables and vectors as (i, value) tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portmesh.operators.supersteps import CHECKPOINT_EVERY, EDGES_PER_BLOCK, PlacedEdges
from portmesh.session import checkpoint, drop, stored


def spmv(matrix: DataFrame, x: DataFrame) -> DataFrame:
    """A·x; rows whose product is empty are absent, which means 0."""
    v = x.select(F.col("i").alias("col"), F.col("value").alias("_x"))
    return _product(matrix.join(v, "col"))


def _product(joined: DataFrame) -> DataFrame:
    return joined.groupBy(F.col("row").alias("i")).agg(
        F.sum(F.col("value") * F.col("_x")).alias("value")
    )


def combine(a: DataFrame, b: DataFrame, factor: float) -> DataFrame:
    """a + factor·b for sparse vectors."""
    both = a.select("i", F.col("value").cast("double").alias("value")).unionByName(
        b.select("i", (F.col("value") * F.lit(float(factor))).alias("value"))
    )
    return both.groupBy("i").agg(F.sum("value").alias("value"))


def residual(matrix: DataFrame, x: DataFrame, b: DataFrame) -> DataFrame:
    """b − A·x."""
    return combine(b, spmv(matrix, x), -1.0)


def residual_norm(matrix: DataFrame, x: DataFrame, b: DataFrame) -> DataFrame:
    """One row: Euclidean and largest absolute residual."""
    return norm(residual(matrix, x, b))


def norm(vector: DataFrame) -> DataFrame:
    """One row: Euclidean and largest absolute value."""
    return vector.agg(
        F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("l2"),
        F.max(F.abs("value")).alias("max_abs"),
    )


class Smoother:
    """Damped Jacobi: x += ω·D⁻¹(b − R·x) − ω·x, with R the off-diagonal part."""

    def __init__(self, matrix: DataFrame, omega: float, block: int = EDGES_PER_BLOCK):
        self.omega = omega
        self.diagonal = stored(
            matrix.filter(F.col("row") == F.col("col")).select(F.col("row").alias("i"), F.col("value").alias("_d")), "diagonal"
        )
        rest = matrix.filter(F.col("row") != F.col("col")).select("row", "col", "value")
        self.rest = PlacedEdges(rest, "col", "row", block)

    def product(self, x: DataFrame) -> DataFrame:
        return _product(self.rest.join(x.select(F.col("i").alias("col"), F.col("value").alias("_x"))))

    def residual(self, b: DataFrame, x: DataFrame) -> DataFrame:
        """b − A·x with the matrix where it lies."""
        own = x.join(self.diagonal, "i").select("i", (F.col("value") * F.col("_d")).alias("value"))
        return combine(combine(b, self.product(x), -1.0), own, -1.0)

    def coarse(self, p: DataFrame) -> DataFrame:
        """Sums of the matrix over pairs of groups, with ``p(row, col)`` the groups of each row."""
        right = p.select(F.col("row").alias("col"), F.col("col").alias("_c"))
        left = p.select("row", F.col("col").alias("_r"))
        # the matrix lies by column, so the sums over those come first
        sums = self.rest.join(right).groupBy("row", "_c").agg(F.sum("value").alias("value")).join(left, "row")
        own = self.diagonal.select(F.col("i").alias("row"), F.col("i").alias("col"), F.col("_d").alias("value"))
        both = sums.select("_r", "_c", "value").unionByName(own.join(left, "row").join(right, "col").select("_r", "_c", "value"))
        return both.groupBy(F.col("_r").alias("row"), F.col("_c").alias("col")).agg(F.sum("value").alias("value"))

    def run(self, b: DataFrame, x: DataFrame, iterations: int) -> DataFrame:
        w = F.lit(float(self.omega))
        fixed = self.diagonal.join(b.select("i", F.col("value").alias("_b")), "i", "left")
        zero = F.lit(0.0)
        for k in range(iterations):
            rx = self.product(x).withColumnRenamed("value", "_rx")
            old = x.select("i", F.col("value").alias("_x"))
            joined = fixed.join(rx, "i", "left").join(old, "i", "left")
            value = (
                w * (F.coalesce("_b", zero) - F.coalesce("_rx", zero)) / F.col("_d")
                + (F.lit(1.0) - w) * F.coalesce("_x", zero)
            )
            x = joined.select("i", value.alias("value"))
            if (k + 1) % CHECKPOINT_EVERY == 0 or k + 1 == iterations:
                x = checkpoint(x)
        return x

    def release(self) -> None:
        self.rest.release()
        drop(self.diagonal)


def jacobi(
    matrix: DataFrame,
    b: DataFrame,
    x: DataFrame,
    omega: float = 1.0,
    iterations: int = 1,
    block: int = EDGES_PER_BLOCK,
) -> DataFrame:
    smoother = Smoother(matrix, omega, block)
    out = smoother.run(b, x, iterations)
    smoother.release()
    return out


@dataclass(frozen=True)
class Level:
    """One grid: its matrix and, but for the coarsest, prolongation and restriction."""

    A: DataFrame
    P: DataFrame | None = None
    R: DataFrame | None = None
    omega: float = 1.0


def multigrid_cycle(
    levels: list[Level],
    b: DataFrame,
    x: DataFrame,
    gamma: int = 1,
    smoothing: int = 1,
    deep: bool = False,
    smoothers: dict[int, Smoother] | None = None,
) -> DataFrame:
    """One multigrid cycle over given level tables, finest first.

    ``gamma=1`` is a V-cycle. ``gamma=2`` visits the next grid twice, each time with a V-cycle below
    it, or with the full W recursion when ``deep``. The coarsest grid is divided by its diagonal.
    ``smoothers`` are those of levels whose matrix is placed already; they are not released.
    """
    given = set(smoothers or {})
    smoothers = dict(smoothers or {})

    def visit(at: int, rhs: DataFrame, guess: DataFrame, times: int) -> DataFrame:
        level = levels[at]
        if at == len(levels) - 1:
            diagonal = level.A.filter(F.col("row") == F.col("col")).select(
                F.col("row").alias("i"), F.col("value").alias("_d")
            )
            return rhs.join(diagonal, "i").select("i", (F.col("value") / F.col("_d")).alias("value"))
        if at not in smoothers:
            smoothers[at] = Smoother(level.A, level.omega)
        smoother = smoothers[at]
        guess = smoother.run(rhs, guess, smoothing)
        coarse_b = checkpoint(spmv(level.R, smoother.residual(rhs, guess)))
        coarse_x = coarse_b.select("i", F.lit(0.0).alias("value"))
        for _ in range(times):
            coarse_x = visit(at + 1, coarse_b, coarse_x, times if deep else 1)
        guess = combine(guess, spmv(level.P, coarse_x), 1.0)
        return smoother.run(rhs, guess, smoothing)

    out = checkpoint(visit(0, b, x, gamma))
    for at, smoother in smoothers.items():
        if at not in given:
            smoother.release()
    return out
