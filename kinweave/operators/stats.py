"""Statistics on tables: correlation, t-tests, regression, group differences and z-scores, sets, sweeps, reshaping."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Steps of the integral behind a p value, and after how many of its widths the density counts as nothing.
STEPS, WIDTHS = 2000, 40


def p_value(t: Column, df: Column, alternative: str = "two-sided") -> Column:
    """The chance of a t statistic at least as far out, with df degrees of freedom; greater and less look to one side.

    With t = sqrt(df) tan(x), Student's density becomes cos(x) to the power of df - 1, of which Simpson's rule takes the
    area beyond t over the whole. A column expression, meant for rows of aggregates. Null for null t.
    """
    if alternative not in ("two-sided", "greater", "less"):
        raise ValueError(f"unknown alternative: {alternative}")
    top = F.least(F.lit(math.pi / 2), WIDTHS / F.sqrt(df))

    def area(begin: Column) -> Column:
        step = (top - begin) / STEPS
        weight = lambda i: F.when((i == 0) | (i == STEPS), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
        height = lambda i: F.pow(F.greatest(F.cos(begin + i * step), F.lit(0.0)), df - 1)
        return F.aggregate(F.sequence(F.lit(0), F.lit(STEPS)), F.lit(0.0), lambda s, i: s + weight(i) * height(i)) * step / 3

    begin = F.atan(F.abs(t) / F.sqrt(df))
    beyond = F.when(begin < top, area(begin) / (2 * area(F.lit(0.0)))).when(begin.isNotNull(), 0.0)
    if alternative == "two-sided":
        return 2 * beyond
    return F.when((t >= 0) == F.lit(alternative == "greater"), beyond).otherwise(1 - beyond)


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x, y, r, n, t) of all pairs of columns, in one pass over the rows."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    whole = df.agg(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.corr(a, b).alias("r"), F.count(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1)).alias("n")).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    out = whole.select(F.explode(F.array(*whole.columns)).alias("p")).select("p.*")
    return out.withColumn("t", F.col("r") * F.sqrt((F.col("n") - 2) / (1 - F.col("r") * F.col("r"))))


def marked(correlated: DataFrame, p: float = 0.001, r: float = 0.7) -> DataFrame:
    """correlations with p, two-sided, and marked: p is below and the size of r at least the given one."""
    out = correlated.withColumn("p", p_value(F.col("t"), F.col("n") - 2))
    return out.withColumn("marked", (F.col("p") < p) & (F.abs("r") >= r))


def one_sample_t(df: DataFrame, x: str, by: list[str], mean: float) -> DataFrame:
    """(by..., n, t) against a fixed mean."""
    out = df.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("m"), F.stddev_samp(x).alias("s"))
    return out.select(*by, "n", ((F.col("m") - mean) / (F.col("s") / F.sqrt("n"))).alias("t"))


def two_sample_t(df: DataFrame, x: str, group: Column, by: list[str]) -> DataFrame:
    """(by..., n1, n2, t, df) of rows where group is true against those where it is false; equal variances are assumed."""
    of = lambda f, g: f(F.when(group == F.lit(g), F.col(x)))
    out = df.groupBy(*by).agg(*[of(f, g).alias(f"{n}{k}") for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp)) for k, g in ((1, True), (2, False))])
    pooled = ((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / (F.col("n1") + F.col("n2") - 2)
    return out.select(*by, "n1", "n2", ((F.col("m1") - F.col("m2")) / F.sqrt(pooled * (1 / F.col("n1") + 1 / F.col("n2")))).alias("t"), (F.col("n1") + F.col("n2") - 2).alias("df"))


def regression(df: DataFrame, y: str, x: list[str], by: list[str]) -> DataFrame:
    """Least squares with one or two predictors in closed form from covariances: (by..., intercept, slopes, r2)."""
    if len(x) == 1:
        return df.groupBy(*by).agg(F.regr_intercept(y, x[0]).alias("intercept"), F.regr_slope(y, x[0]).alias("slope1"), F.regr_r2(y, x[0]).alias("r2"))
    a, b = x
    cov = lambda p, q: F.covar_samp(p, q)
    m = df.where(F.col(y).isNotNull() & F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by).agg(
        cov(a, a).alias("aa"), cov(b, b).alias("bb"), cov(a, b).alias("ab"), cov(a, y).alias("ay"), cov(b, y).alias("by_"), F.var_samp(y).alias("yy"), F.avg(y).alias("my"), F.avg(a).alias("ma"), F.avg(b).alias("mb")
    )
    det = F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab")
    s1 = (F.col("ay") * F.col("bb") - F.col("by_") * F.col("ab")) / det
    s2 = (F.col("by_") * F.col("aa") - F.col("ay") * F.col("ab")) / det
    m = m.withColumn("slope1", s1).withColumn("slope2", s2)
    return m.select(*by, (F.col("my") - F.col("slope1") * F.col("ma") - F.col("slope2") * F.col("mb")).alias("intercept"), "slope1", "slope2", ((F.col("slope1") * F.col("ay") + F.col("slope2") * F.col("by_")) / F.col("yy")).alias("r2"))


def differences(df: DataFrame, x: str, by: list[str], order: list[str]) -> DataFrame:
    """df with diff, pct_change and z (by the sample deviation) of x within by."""
    w, g = Window.partitionBy(*by).orderBy(*order), Window.partitionBy(*by)
    last = F.lag(x).over(w)
    return df.withColumn("diff", F.col(x) - last).withColumn("pct_change", F.when(last != 0, (F.col(x) - last) / last)).withColumn("z", (F.col(x) - F.avg(x).over(g)) / F.stddev_samp(x).over(g))


def set_memberships(df: DataFrame, element: str, member: str) -> DataFrame:
    """(members, n): how many elements are in exactly these sets."""
    sets = df.groupBy(element).agg(F.array_join(F.array_sort(F.collect_set(member)), ",").alias("members"))
    return sets.groupBy("members").agg(F.count(F.lit(1)).alias("n"))


def sweep(spark_values: dict[str, list], df: DataFrame, counted: Column) -> DataFrame:
    """For every combination of parameter values, the rows for which counted holds; the grid is a literal, so it is a bounded side."""
    names = list(spark_values)
    grid = reduce(lambda g, n: g.withColumn(n, F.explode(F.array(*[F.lit(v) for v in spark_values[n]]))), names, df.sparkSession.range(1).drop("id"))
    return df.crossJoin(F.broadcast(grid)).groupBy(*names).agg(F.count_if(counted).alias("n"))


def long(df: DataFrame, ids: list[str], values: list[str], variable: str = "variable", value: str = "value") -> DataFrame:
    return df.unpivot(ids, values, variable, value)


def transposed(df: DataFrame, index: str, columns: list) -> DataFrame:
    """Rows become columns, for a known list of index values: (field, one column for each)."""
    fields = [c for c in df.columns if c != index]
    melted = df.unpivot([index], fields, "field", "value")
    return melted.groupBy("field").pivot(index, columns).agg(F.first("value"))


def tagged(frames: dict[str, DataFrame], column: str) -> DataFrame:
    """Frames one below the other, with the name of each in column; missing columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [f.withColumn(column, F.lit(n)) for n, f in frames.items()])


def closest_group(df: DataFrame, name: str, value: str, size: int) -> DataFrame:
    """One row (first, spread): from which member on, in order of value, so many neighbours lie closest together."""
    w = Window.orderBy(value, name)
    spread = F.lead(value, size - 1).over(w) - F.col(value)
    at = df.select(F.col(name).alias("first"), spread.alias("spread"), F.col(value).alias("value")).where("spread IS NOT NULL")
    return at.agg(F.min(F.struct("spread", "value", "first")).alias("x")).select("x.first", "x.spread")


def steps(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """df with length: how far the next value within by lies; null for the last."""
    return df.withColumn("length", F.lead(value).over(Window.partitionBy(*by).orderBy(value)) - F.col(value))


def inliers(rows: DataFrame, x: str, by: list[str], most: float = 3) -> DataFrame:
    """Rows whose x lies less than so many deviations from the mean of its group; groups of one value or row have none."""
    group = rows.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.avg(x).alias("_mean"), F.stddev_pop(x).alias("_sd"))
    z = (F.col(x) - F.col("_mean")) / F.nullif(F.col("_sd"), F.lit(0.0))
    return rows.join(group, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]).where(F.abs(z) < most).select(rows.columns)
