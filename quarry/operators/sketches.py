"""Mergeable sketches: kept for each day or part, merged later for any span, without the rows.

Distinct counts (HyperLogLog), quantiles (KLL) and heavy hitters (frequent items) are binary columns of bounded size; merging them gives what one sketch of all rows would give, within
the same bounds, so they are aggregated map-side and stored like any other column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 2**LOG_K registers: a relative standard error of about 1.04 / 2**(LOG_K / 2). QUANTILE_K: ranks within 1 % or so. MAX_ITEMS: items counted apart.
LOG_K, QUANTILE_K, MAX_ITEMS = 12, 400, 1024
DISTINCT_ERROR, RANK_ERROR = 4 * 1.04 / 2 ** (LOG_K / 2), 0.015


def sketched(df: DataFrame, by: list[str], distinct: str, value: str, item: str) -> DataFrame:
    """(by, n, seen, spread, often): a row for each group with the sketches of a column's distinct values, a number's quantiles, an item's counts. Nulls count for nothing but n."""
    often = F.expr(f"approx_top_k_accumulate(`{item}`, {MAX_ITEMS})")
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.hll_sketch_agg(distinct, LOG_K).alias("seen"), F.kll_sketch_agg_double(F.col(value).cast("double"), QUANTILE_K).alias("spread"), often.alias("often"))


def merged(sketches: DataFrame, by: list[str]) -> DataFrame:
    """The sketches of coarser groups, from those of finer ones."""
    often = F.expr(f"approx_top_k_combine(often, {MAX_ITEMS})")
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.hll_union_agg("seen", True).alias("seen"), F.kll_merge_agg_double("spread").alias("spread"), often.alias("often"))


def read(sketches: DataFrame, quantiles: list[float], top: int) -> DataFrame:
    """The estimates: `distinct`, `quantiles` (an array; null where there was no number), `top` (an array of (item, count), by falling count)."""
    asked = F.array(*(F.lit(float(q)) for q in quantiles))
    return sketches.withColumns({"distinct": F.hll_sketch_estimate("seen"), "quantiles": F.when(F.kll_sketch_get_n_double("spread") > 0, F.kll_sketch_get_quantile_double("spread", asked)), "top": F.expr(f"approx_top_k_estimate(often, {top})")}).drop("seen", "spread", "often")
