"""Sample variance without rounding on the half-step grid that ratings lie on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sample_variance(rating: Column) -> Column:
    """Aggregate: variance with n - 1, NULL for fewer than two values.

    Twice a half-step rating is an integer, so n * sum(h * h) - sum(h)**2 is exact and the result is
    one division, the same in any order of the rows. Off the grid it is Spark's own variance.
    """
    twice = F.round(rating * 2)
    h = twice.cast("bigint")
    n = F.count(rating)
    wide = "decimal(18,0)"
    squares = n.cast(wide) * F.sum(h * h).cast("decimal(19,0)")
    spread = squares - F.sum(h).cast(wide) * F.sum(h).cast(wide)
    exact = spread.cast("double") / (n * (n - 1) * 4)
    on_grid = F.max(F.abs(rating * 2 - twice)) == 0
    return F.when(n > 1, F.when(on_grid, exact).otherwise(F.var_samp(rating)))
