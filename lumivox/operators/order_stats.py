"""Order statistics, thresholds and top-k selections.

Every convention has a name of its own, as results differ: the nearest rank
rounds half away from zero and gives an element; the averaging median takes the
mean of the middle two; the upper median takes the element at n div 2.
Functions take a DataFrame, group columns and a value column. Ranks come from
one sorted pass per group without gathering the group's values in one row.
"""

from __future__ import annotations

from collections.abc import Callable, Generator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumivox.functions.storage import checkpointed
from lumivox.operators.voxel import is_finite


def at_ranks(df: DataFrame, by: list[str], value: str, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Per group, for each named rank (from 0, a function of the group's count n) the element there; NaN comes before all numbers.

    Equal values are counted first, so a value on many rows is one from then
    on. Values fall into buckets between approximate quantiles, buckets are counted
    exactly, and only those that hold a wanted rank are ordered, by cumulated
    counts: no task sees a whole group's rows or orders more than a bucket's values.
    Values and edges are written: approximate quantiles come out otherwise each time they are made, and buckets are read twice.
    """
    v = F.col("_v")
    seen = checkpointed(df.select(*by, F.col(value).alias("_v")).groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_own")))
    edges = F.percentile_approx(F.when(~F.isnan(v), v), [k / 64 for k in range(1, 64)], 1000)
    group = checkpointed(seen.groupBy(*by).agg(F.sum("_own").alias("_n"), edges.alias("_edges")))
    bucket = F.when(F.isnan(v), -1).otherwise(F.size(F.filter(F.coalesce("_edges", F.array().cast("array<double>")), lambda e: e < v)))
    dealt = seen.join(group, by).select(*by, "_v", "_own", "_n", bucket.alias("_bucket"))
    counts = dealt.groupBy(*by, "_bucket").agg(F.sum("_own").alias("_rows"), F.first("_n").alias("_n"))
    w = Window.partitionBy(*by).orderBy("_bucket")  # 65 rows a group at most
    counts = counts.withColumn("_before", F.sum("_rows").over(w) - F.col("_rows"))
    wanted = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), f(F.col("_n")).cast("long").alias("rank")) for k, f in ranks.items()])).alias("_w")
    wanted = counts.select(*by, "_bucket", "_before", "_rows", wanted).where((F.col("_w.rank") >= F.col("_before")) & (F.col("_w.rank") < F.col("_before") + F.col("_rows")))
    wanted = wanted.groupBy(*by, "_bucket").agg(F.first("_before").alias("_before"), F.collect_list("_w").alias("_wanted"))
    inside = Window.partitionBy(*by, "_bucket").orderBy("_v")
    found = dealt.join(wanted, [*by, "_bucket"]).withColumn("_end", F.sum("_own").over(inside) + F.col("_before"))
    found = found.select(*by, "_v", "_own", "_end", F.explode("_wanted").alias("_w")).where((F.col("_w.rank") < F.col("_end")) & (F.col("_w.rank") >= F.col("_end") - F.col("_own")))
    return found.groupBy(*by).agg(*[F.max(F.when(F.col("_w.name") == k, v)).alias(k) for k in ranks])


def nearest_rank(df: DataFrame, by: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """Per group the elements at round((n - 1) q) of the finite values, a column for each named quantile."""
    at = {k: (lambda n, q=q: F.round((n - 1) * F.lit(q))) for k, q in quantiles.items()}
    return at_ranks(df.where(is_finite(F.col(value))), by, value, at)


def averaging_median(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """The mean of the middle two elements, which are one where their number is odd."""
    middle = at_ranks(df.where(is_finite(F.col(value))), by, value, {"low": lambda n: F.floor((n - 1) / 2), "high": lambda n: F.floor(n / 2)})
    return middle.select(*by, ((F.col("low") + F.col("high")) / 2.0).alias("median"))


def upper_median(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """The element at n div 2, counted from 0."""
    return at_ranks(df.where(is_finite(F.col(value))), by, value, {"median": lambda n: F.floor(n / 2)})


def iqr_quartiles(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Elements at round(n / 4) and round(3 n / 4), at most n - 1, over all rows; NaN sorts before all numbers here."""
    return at_ranks(df, by, value, {k: (lambda n, q=q: F.least(F.round(n * q), n - 1)) for k, q in (("q1", 0.25), ("q3", 0.75))})


def _edge(df: DataFrame, by: list[str], value: str, n: int | Callable[[Column], Column], top: bool) -> DataFrame:
    """n: a number, or a function of the group's count."""
    if not callable(n) and n < 1:
        raise ValueError("nothing is selected with n below 1")
    some = df.where(is_finite(F.col(value)) & (F.col(value) != 0))
    of = n if callable(n) else (lambda total: F.lit(n))
    short = lambda total: F.raise_error(F.format_string("%d of %d values asked for", of(total), total))
    at = lambda total: F.when(total < of(total), short(total)).otherwise(total - of(total) if top else of(total) - 1)
    cut = at_ranks(some, by, value, {"_cut": at})
    return some.join(cut, by).where(F.col(value) >= F.col("_cut") if top else F.col(value) <= F.col("_cut")).drop("_cut")


def top_n(df: DataFrame, by: list[str], value: str, n: int) -> DataFrame:
    """Rows with one of the n largest finite, non-zero values; ties with the n-th stay. Fewer than n such values in a group are an error."""
    return _edge(df, by, value, n, True)


def bottom_n(df: DataFrame, by: list[str], value: str, n: int) -> DataFrame:
    """Rows with one of the n smallest finite, non-zero values; ties with the n-th stay. Fewer than n such values in a group are an error."""
    return _edge(df, by, value, n, False)


def top_percent(df: DataFrame, by: list[str], value: str, percent: float) -> DataFrame:
    """The same with that share of each group's values."""
    return _edge(df, by, value, lambda total: percent_count(total, percent), True)


def bottom_percent(df: DataFrame, by: list[str], value: str, percent: float) -> DataFrame:
    return _edge(df, by, value, lambda total: percent_count(total, percent), False)


def percent_count(total: Column, percent: float) -> Column:
    """total percent of a hundred, half rounded to even; an error where that is 0."""
    n = F.bround(total * F.lit(percent) / 100.0, 0).cast("int")
    return F.when(n == 0, F.raise_error(F.format_string(f"{percent}%% of %d values round to none", total.cast("long"))).cast("int")).otherwise(n)


#: Fixed value: the golden section, to the eight digits that keep thresholds equal to others' of this rule.
GOLDEN = 0.61803399


def golden_probes(low: float, high: float, tol: float, rounds: int = 200) -> Generator[float, float, float]:
    """Yields places, is sent their costs, and returns the better of the two probes left when the bracket is shorter than tol times the sum of their sizes.

    The first stands in the bracket's middle.
    """
    near, far = low + (high - low) / 2, None
    near, far = near - (1 - GOLDEN) * (near - low), near
    at = {}
    for x in (near, far):
        at[x] = yield x
    for _ in range(rounds):
        if high - low <= tol * (abs(near) + abs(far)):
            break
        if at[far] < at[near]:
            low, near, far = near, far, GOLDEN * far + (1 - GOLDEN) * high
            at[far] = yield far
        else:
            high, far, near = far, near, GOLDEN * near + (1 - GOLDEN) * low
            at[near] = yield near
    return near if at[near] < at[far] else far


def optimal_thresholds(df: DataFrame, by: str, value: str, tol: float = 0.01) -> dict[str, float | None]:
    """By group the threshold whose selection correlates best with the finite values; None for constant values.

    The search runs between the least and the largest value, a thousandth of the range off each. All groups search side by side:
    a probe of every group still searching is one aggregate; the values stay where they are, some numbers a group come to the driver.
    """
    v = df.where(is_finite(F.col(value))).select(F.col(by).alias("_by"), F.col(value).cast("double").alias("v")).persist()
    every = v.groupBy("_by").agg(F.count("v").alias("n"), F.sum("v").alias("sum"), F.sum(F.col("v") * F.col("v")).alias("sq"), F.min("v").alias("low"), F.max("v").alias("high")).collect()
    found, searches, probes, spread = {}, {}, {}, {}
    for s in every:
        spread[s._by] = max(s.sq / s.n - (s["sum"] / s.n) ** 2, 0) ** 0.5
        margin = (s.high - s.low) / 1000
        if s.low == s.high or not spread[s._by]:
            found[s._by] = None
        else:
            searches[s._by] = golden_probes(s.low + margin, s.high - margin, tol)
            probes[s._by] = next(searches[s._by])
    total = {s._by: s for s in every}
    while probes:
        at = F.create_map(*[F.lit(x) for pair in probes.items() for x in pair])
        above = v.where(F.col("v") > F.try_element_at(at, F.col("_by"))).groupBy("_by").agg(F.count("v").alias("n"), F.sum("v").alias("sum"))
        got = {r._by: r for r in above.collect()}
        for key in list(probes):
            s, r = total[key], got.get(key)
            p = r.n / s.n if r else 0.0
            cost = 0.0 if p in (0, 1) else -(r["sum"] / s.n - p * s["sum"] / s.n) / ((p * (1 - p)) ** 0.5 * spread[key])
            try:
                probes[key] = searches[key].send(cost)
            except StopIteration as end:
                found[key] = end.value
                del probes[key]
    v.unpersist()
    return found


def optimal_threshold(df: DataFrame, value: str, offset: float = 0.0, tol: float = 0.01) -> float | None:
    """The threshold of value less `offset` over all rows; None for constant values."""
    one = df.select(F.lit("all").alias("all"), (F.col(value).cast("double") - offset).alias("v"))
    return optimal_thresholds(one, "all", "v", tol).get("all")


def threshold_select(df: DataFrame, value: str, offset: float = 0.0, below: bool = False, by: str | None = None) -> DataFrame:
    """Rows whose value less `offset` is at or above its optimal threshold, each group's own where `by` is given, or below it; constant values are an error."""
    moved = df.withColumns({"_off": F.col(value).cast("double") - offset, "_by": F.col(by) if by else F.lit("all")})
    found = optimal_thresholds(moved, "_by", "_off")
    if constant := sorted(str(k) for k, t in found.items() if t is None):
        raise ValueError(f"{value} is constant in {', '.join(constant)}, there is no threshold")
    if not found and not by:
        raise ValueError(f"{value} is constant, there is no threshold")
    at = df.sparkSession.createDataFrame(list(found.items()), moved.select("_by", F.lit(0.0).alias("_cut")).schema)
    return moved.join(at, "_by").where(F.col("_off") < F.col("_cut") if below else F.col("_off") >= F.col("_cut")).select(*df.columns)


def masked_min(df: DataFrame, by: list[str], value: str) -> DataFrame:
    return df.where(F.col("in_mask") & is_finite(F.col(value))).groupBy(*by).agg(F.min(value).alias("least"))


def reject_outliers(df: DataFrame, by: list[str], value: str, k: float = 10.0) -> DataFrame:
    """`value` set to NaN where finite and above k times the group's nearest-rank 99th percentile; adds `rejected`."""
    cut = nearest_rank(df, by, value, {"p99": 0.99})
    out = df.join(cut, by, "left")
    gone = is_finite(F.col(value)) & (F.col(value) > k * F.col("p99"))
    return out.withColumn("rejected", F.coalesce(gone, F.lit(False))).withColumn(value, F.when(F.col("rejected"), F.lit(float("nan"))).otherwise(F.col(value))).drop("p99")


def display_stats(df: DataFrame, by: list[str], value: str, cap: float | None = None) -> DataFrame:
    """Count, least, nearest-rank percentiles and largest of the finite values, and what to show as the largest (at most `cap`)."""
    some = df.where(is_finite(F.col(value)))
    q = nearest_rank(some, by, value, {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    s = some.groupBy(*by).agg(F.count(value).alias("n_finite"), F.min(value).alias("least"), F.max(value).alias("largest"))
    show = F.col("p99") if cap is None else F.least(F.col("p99"), F.lit(cap))
    return s.join(q, by).withColumn("suggested_max", show)


def winsorize(value: Column, cap: Column | float) -> Column:
    """Finite values above the cap lowered to it; others as they are."""
    cap = F.lit(cap) if isinstance(cap, float) else cap
    return F.when(is_finite(value), F.least(value, cap)).otherwise(value)


def robust_sigma(df: DataFrame, by: list[str], residual: str) -> DataFrame:
    """1.4826 times the upper median of the absolute residuals."""
    m = upper_median(df.withColumn(residual, F.abs(residual)), by, residual)
    return m.select(*by, (1.4826 * F.col("median")).alias("sigma"))


def mean_in_mask(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean of value over the mask, 0 for an empty one."""
    return df.groupBy(*by).agg(F.coalesce(F.avg(F.when(F.col("in_mask"), F.col(value))), F.lit(0.0)).alias("mean"))


def strided_quantile(df: DataFrame, order: list[str], value: str, q: float, aim: int = 20_000) -> DataFrame:
    """Nearest-rank quantile of every max(n div aim, 1)-th row by `order`, from the first on."""
    n = df.count()
    stride = max(n // aim, 1)
    each = df
    if stride > 1:
        # row numbers over all partitions: the place in one, after the rows of those before it
        place = F.monotonically_increasing_id()
        rows = df.orderBy(*order).withColumns({"part": F.shiftright(place, 33), "place": place.bitwiseAND((1 << 33) - 1)})
        rows = checkpointed(rows)
        counts = rows.groupBy("part").count().withColumn("before", F.sum("count").over(Window.orderBy("part")) - F.col("count"))
        each = rows.join(counts.select("part", "before"), "part").where((F.col("before") + F.col("place")) % stride == 0)
    return nearest_rank(each.withColumn("all", F.lit(1)), ["all"], value, {"quantile": q}).drop("all")
