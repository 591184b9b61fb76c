"""Exact order statistics of groups of any size, by selection in rounds.

A wanted rank lies in a bracket, an open interval of values with a known number of values below it. While a bracket holds more
than a fixed number of values, one pass with partial aggregates finds approximate quantiles of what is inside, and another
counts exactly how many values lie below, at, between and at the two quantiles around the rank. The rank then is at one
of the two, or in a bracket some 170 times smaller, whatever the distribution. So no task ever sorts more than
``MOST_VALUES`` values of a group for a rank, outliers change nothing, and ties are counted, not kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deckloom.sources.shared import stored

#: Quantiles that a bracket is narrowed by, and the accuracy that they are asked for with: off by less than a cell's 32nd.
CELLS, ACCURACY = 512, 1 << 14
#: Values of a group that may be sorted in one task.
MOST_VALUES = 1 << 16
#: Groups up to which their brackets (some 100 bytes each) are broadcast.
BROADCAST_GROUPS = 50_000


def nearest_rank_index(p: float) -> Callable[[Column], Column]:
    """The 0-based index round_half_even(p n) - 1, clamped to the group."""
    return lambda n: F.greatest(F.lit(0), F.least(n - 1, F.bround(F.lit(p) * n, 0).cast("long") - 1))


def _met(base: DataFrame, brackets: DataFrame, on: list[str]) -> DataFrame:
    """The values with their group's bracket; a null key is a group like others."""
    other = brackets.withColumnsRenamed({c: f"__on_{i}" for i, c in enumerate(on)})
    if brackets.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS:
        other = F.broadcast(other)
    alike = F.lit(True)
    for i, c in enumerate(on):
        alike &= base[c].eqNullSafe(other[f"__on_{i}"])
    return base.join(other, alike).drop(*[f"__on_{i}" for i in range(len(on))])


def _inside(k: int) -> Column:
    v, low, high = F.col("__v"), F.col(f"__lo_{k}"), F.col(f"__hi_{k}")
    return (low.isNull() | (v > low)) & (high.isNull() | (v < high))


def started(base: DataFrame, on: list[str], ranks: list[Callable[[Column], Column]]) -> DataFrame:
    """``on, n`` and for each rank its bracket: the index inside, the bounds (null: none), the values inside, and the value once known."""
    none = F.lit(None).cast("double")
    sizes = base.groupBy(*on).agg(F.count("*").alias("n"))
    for k, at in enumerate(ranks):
        sizes = sizes.withColumns(
            {f"__i_{k}": at(F.col("n")).cast("long"), f"__lo_{k}": none, f"__hi_{k}": none, f"__m_{k}": F.col("n"), f"__x_{k}": none, f"__is_{k}": F.lit(False)}
        )
    return sizes


def narrowed(base: DataFrame, brackets: DataFrame, on: list[str], ranks: int, cells: int, most: int) -> DataFrame:
    """The brackets after one round; those that hold few enough values, or whose rank is found, stay as they are."""
    large = {k: ~F.col(f"__is_{k}") & (F.col(f"__m_{k}") > most) for k in range(ranks)}
    met = _met(base, brackets, on)
    grid = [k / cells for k in range(cells + 1)]
    grids = met.groupBy(*on).agg(*[F.percentile_approx(F.when(large[k] & _inside(k), F.col("__v")), grid, ACCURACY).alias(f"__q_{k}") for k in range(ranks)])
    near = brackets.join(grids.withColumnsRenamed({c: f"__on_{i}" for i, c in enumerate(on)}), _same(brackets, on))
    for k in range(ranks):
        cell = F.floor(F.col(f"__i_{k}") * cells / F.greatest(F.col(f"__m_{k}"), F.lit(1))).cast("int")
        near = near.withColumns({f"__a_{k}": F.get(f"__q_{k}", F.greatest(cell - 1, F.lit(0))), f"__b_{k}": F.get(f"__q_{k}", F.least(cell + 2, F.lit(cells)))})
    near = stored(near.select(*brackets.columns, *[f"__{e}_{k}" for e in "ab" for k in range(ranks)]), "order-near")
    v, counts = F.col("__v"), []
    for k in range(ranks):
        a, b, own = F.col(f"__a_{k}"), F.col(f"__b_{k}"), large[k] & _inside(k)
        for name, test in (("below", v < a), ("first", v == a), ("between", (v > a) & (v < b)), ("second", (v == b) & (a < b))):
            counts.append(F.count(F.when(own & test, 1)).alias(f"__{name}_{k}"))
    counted = _met(base, near, on).groupBy(*on).agg(*counts)
    out = near.join(counted.withColumnsRenamed({c: f"__on_{i}" for i, c in enumerate(on)}), _same(near, on))
    columns = [*[F.col(c) for c in on], F.col("n")]
    for k in range(ranks):
        i, m, a, b = (F.col(f"__{e}_{k}") for e in "imab")
        to_a = F.col(f"__below_{k}")
        past_a = to_a + F.col(f"__first_{k}")
        to_b = past_a + F.col(f"__between_{k}")
        past_b = to_b + F.col(f"__second_{k}")

        def moved(below: Column, at_a: Column, between: Column, at_b: Column, above: Column, kept: str, k=k, i=i, to_a=to_a, past_a=past_a, to_b=to_b, past_b=past_b) -> Column:
            chosen = F.when(i < to_a, below).when(i < past_a, at_a).when(i < to_b, between).when(i < past_b, at_b).otherwise(above)
            return F.when(large[k], chosen).otherwise(F.col(f"__{kept}_{k}")).alias(f"__{kept}_{k}")

        low, high, zero, none = F.col(f"__lo_{k}"), F.col(f"__hi_{k}"), F.lit(0).cast("long"), F.lit(None).cast("double")
        columns += [
            moved(i, zero, i - past_a, zero, i - past_b, "i"),
            moved(low, none, a, none, b, "lo"),
            moved(a, none, b, none, high, "hi"),
            moved(to_a, zero, to_b - past_a, zero, m - past_b, "m"),
            moved(none, a, none, b, none, "x"),
            moved(F.lit(False), F.lit(True), F.lit(False), F.lit(True), F.lit(False), "is"),
        ]
    return out.select(*columns)


def _same(left: DataFrame, on: list[str]) -> Column:
    alike = F.lit(True)
    for i, c in enumerate(on):
        alike &= left[c].eqNullSafe(F.col(f"__on_{i}"))
    return alike


def brackets(base: DataFrame, on: list[str], ranks: list[Callable[[Column], Column]], cells: int, most: int) -> tuple[DataFrame, int]:
    """Brackets that hold at most ``most`` values each, and the number of rounds that it took."""
    found, rounds = stored(started(base, on, ranks), "order-brackets"), 0
    left = [F.max(F.when(~F.col(f"__is_{k}"), F.col(f"__m_{k}"))) for k in range(len(ranks))]
    while max((x or 0 for x in found.agg(*left).first()), default=0) > most:
        found, rounds = stored(narrowed(base, found, on, len(ranks), cells, most), "order-brackets"), rounds + 1
    return found, rounds


def order_statistics(
    df: DataFrame, keys: list[str], value: str, ranks: dict[str, Callable[[Column], Column]], cells: int = CELLS, most: int = MOST_VALUES
) -> DataFrame:
    """``keys, n`` and one column for each rank: the value at that 0-based index among the group's sorted values.

    Null values are left out; groups without values don't appear. With no keys there is one group. A NaN is greater than other values.
    """
    on, v = keys or ["__all"], F.col("__v")
    base = df.select(*keys, *([] if keys else [F.lit(1).alias("__all")]), F.col(value).cast("double").alias("__v")).filter("__v is not null")
    base = stored(base, "order-values")
    found, rounds = brackets(base, on, list(ranks.values()), cells, most)
    if not rounds:  # every group is small: its values are counted once for all ranks
        of_group = Window.partitionBy(*on)
        counts = base.groupBy(*on, "__v").agg(F.count("*").alias("__c"))
        counts = counts.withColumn("__to", F.sum("__c").over(of_group.orderBy("__v"))).withColumn("n", F.sum("__c").over(of_group))
        at_rank = lambda at: (at(F.col("n")).cast("long") >= F.col("__to") - F.col("__c")) & (at(F.col("n")).cast("long") < F.col("__to"))
        return counts.groupBy(*on, "n").agg(*[F.max(F.when(at_rank(at), v)).alias(k) for k, at in ranks.items()]).select(*keys, "n", *ranks)
    numbers = range(len(ranks))
    own = F.filter(F.array(*[F.when(~F.col(f"__is_{k}") & _inside(k), F.struct(F.lit(k).alias("k"), F.col(f"__i_{k}").alias("i"))) for k in numbers]), lambda x: x.isNotNull())
    inside = _met(base, found, on).select(*on, "__v", F.explode(own).alias("__r")).groupBy(*on, "__r", "__v").agg(F.count("*").alias("__c"))
    inside = inside.withColumn("__to", F.sum("__c").over(Window.partitionBy(*on, "__r").orderBy("__v")))
    here = (F.col("__r.i") >= F.col("__to") - F.col("__c")) & (F.col("__r.i") < F.col("__to"))
    picked = inside.filter(here).groupBy(*on).agg(*[F.max(F.when(F.col("__r.k") == k, v)).alias(f"__y_{k}") for k in numbers])
    out = found.join(picked.withColumnsRenamed({c: f"__on_{i}" for i, c in enumerate(on)}), _same(found, on), "left")
    return out.select(*keys, "n", *[F.when(F.col(f"__is_{k}"), F.col(f"__x_{k}")).otherwise(F.col(f"__y_{k}")).alias(name) for k, name in enumerate(ranks)])


def distribution(df: DataFrame, keys: list[str], value: str, p: float, name: str, digits: int) -> DataFrame:
    """``keys, count, median, <name>``: the mean of the middle values, and the nearest-rank percentile, rounded."""
    ranks = {"__a": lambda n: (n - 1).cast("long") - F.floor(n / 2), "__b": lambda n: F.floor(n / 2), "__p": nearest_rank_index(p)}
    got = order_statistics(df, keys, value, ranks)
    median = F.round((F.col("__a") + F.col("__b")) / 2, digits).alias("median")
    return got.select(*keys, F.col("n").alias("count"), median, F.round("__p", digits).alias(name))
