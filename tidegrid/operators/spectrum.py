"""Energy by degree: power, cumulated fractions, cut-offs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def degree_power(df: DataFrame, key: str, coefficients: str) -> DataFrame:
    """(key, l, s_l) from real coefficients in the order l = floor(sqrt(position)): the sum of squares of each degree."""
    flat = df.select(key, F.posexplode(coefficients).alias("_p", "_a"))
    return flat.groupBy(key, F.floor(F.sqrt("_p")).cast("int").alias("l")).agg(F.sum(F.col("_a").cast("double") * F.col("_a").cast("double")).alias("s_l"))


def mean_spectra(power: DataFrame, storm: Column, quiet: Column) -> DataFrame:
    """Mean power by degree over all maps, storm maps and quiet maps, with the storm-to-quiet ratio."""
    out = power.groupBy("l").agg(
        F.avg("s_l").alias("s_all"), F.avg(F.when(storm, F.col("s_l"))).alias("s_storm"), F.avg(F.when(quiet, F.col("s_l"))).alias("s_quiet")
    )
    return out.withColumn("ratio", F.col("s_storm") / (F.col("s_quiet") + 1e-12))


def energy_fraction(spectrum: DataFrame, s: str) -> DataFrame:
    """Add the fraction of energy up to each degree; a spectrum has one row per degree."""
    up = Window.orderBy("l").rowsBetween(Window.unboundedPreceding, 0)
    return spectrum.withColumn("fraction", F.sum(s).over(up) / F.sum(s).over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))


def degree_for_energy(fractions: DataFrame, epsilons: list[float]) -> DataFrame:
    """(epsilon, l): the lowest degree that reaches 1 - epsilon of the energy, 0 where none does."""
    picks = [F.struct(F.lit(e).alias("epsilon"), F.coalesce(F.min(F.when(F.col("fraction") >= 1 - e, F.col("l"))), F.lit(0)).alias("l")) for e in epsilons]
    return fractions.agg(F.array(*picks).alias("_x")).select(F.explode("_x").alias("_x")).select("_x.epsilon", "_x.l")


def first_cliff(spectrum: DataFrame, s: str, drop: float = -1.5, cap: int = 36) -> DataFrame:
    """The first degree after which log10 of the power falls by more than ``-drop``, else ``cap``."""
    log = F.log10(F.col(s) + 1e-12)
    w = Window.orderBy("l")
    return spectrum.select("l", (F.lead(log).over(w) - log).alias("_d")).agg(F.coalesce(F.min(F.when(F.col("_d") < drop, F.col("l"))), F.lit(cap)).alias("cliff"))


def cut_off(spectrum: DataFrame, s: str, epsilon: float, drop: float = -1.5, cap: int = 36, residual: bool = False) -> DataFrame:
    """(by_energy, cliff, l): the degree to keep; the higher of both criteria, for residual maps the energy's alone."""
    energy = degree_for_energy(energy_fraction(spectrum, s), [epsilon]).select(F.col("l").alias("by_energy"))
    both = energy.join(first_cliff(spectrum, s, drop, cap))  # one row each
    return both.withColumn("l", F.col("by_energy") if residual else F.greatest("by_energy", "cliff"))


def noise_floor(spectrum: DataFrame, s: str, from_degree: int) -> DataFrame:
    """Mean power of odd degrees from ``from_degree`` up."""
    return spectrum.agg(F.avg(F.when((F.col("l") >= from_degree) & (F.col("l") % 2 == 1), F.col(s))).alias("noise_floor"))


def sobolev_weight(degree: Column) -> Column:
    """Weight of a degree in a loss that counts gradients."""
    return 1 + degree * (degree + 1)


def gibbs_window(degree: Column, most: int) -> Column:
    """Factor that fades a spectrum out towards its highest degree."""
    return 1 - degree / F.lit(most)
