"""Exploratory statistics: match rates, dispersion, propensity, profiles, histograms, rank correlation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.plans import ranks
from quern.plans.lineage import cut_lineage
from quern.plans.ranks import quantiles, running_sums


def same(a: str, b: str) -> Column:
    """1.0 where both are equal, else 0.0; null equals nothing."""
    return F.coalesce(F.col(a) == F.col(b), F.lit(False)).cast("double")


def match_rate(df: DataFrame, a: str, b: str, by: str | None = None) -> DataFrame:
    """``match_rate``, and ``n``, overall or per non-null group."""
    if by is None:
        return df.agg(F.avg(same(a, b)).alias("match_rate"), F.count(F.lit(1)).alias("n"))
    return df.where(F.col(by).isNotNull()).groupBy(by).agg(F.avg(same(a, b)).alias("match_rate"), F.count(F.lit(1)).alias("n"))


def location_dispersion(items: DataFrame, location: str = "item_location_id", lat: str = "item_latitude", lon: str = "item_longitude", min_items: int = 5) -> DataFrame:
    """Sample deviation of the coordinates within each location with at least ``min_items`` located items."""
    known = items.where(F.col(location).isNotNull() & F.col(lat).isNotNull() & F.col(lon).isNotNull())
    stats = known.groupBy(F.col(location).alias("location_id")).agg(F.stddev_samp(F.col(lat).cast("double")).alias("lat_std"), F.stddev_samp(F.col(lon).cast("double")).alias("lon_std"), F.count(F.lit(1)).alias("n_items"))
    return stats.where(F.col("n_items") >= min_items)


def _number(c: str) -> Column:
    return F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))


def _stacked(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column_name, v``: the known numbers of all columns, in one pass."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), _number(c).alias("v")) for c in columns)))
    return df.select(each.alias("x")).select("x.*").where("v IS NOT NULL")


def propensity(chosen: DataFrame, population: DataFrame, binary: list[str] = [], numeric: list[str] = []) -> DataFrame:
    """``feature, statistic, chosen, population, delta``: mean of binary, median of numeric columns; nulls and NaN don't
    count. Medians are exact, from counts by value along a global sort."""

    def one(df: DataFrame, name: str) -> DataFrame:
        parts = []
        if binary:
            row = df.agg(*(F.avg(F.col(c).cast("int").cast("double")).alias(c) for c in binary))
            parts.append(row.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.lit("rate").alias("statistic"), F.col(c).alias(name)) for c in binary))).alias("x")).select("x.*"))
        if numeric:
            names = df.sparkSession.createDataFrame([(c,) for c in numeric], "feature string")
            medians = quantiles(_stacked(df, numeric), "column_name", "v", [0.5])
            parts.append(names.join(medians, F.col("feature") == F.col("column_name"), "left").select("feature", F.lit("median").alias("statistic"), F.col("quantile").alias(name)))
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    return one(chosen, "chosen").join(one(population, "population"), ["feature", "statistic"]).withColumn("delta", F.col("chosen") - F.col("population"))


def missing_rates(df: DataFrame) -> DataFrame:
    """``column_name, missing_rate`` of every column, NaN counting as missing; one pass."""
    kinds = dict(df.dtypes)
    gone = lambda c: (F.col(c).isNull() | F.isnan(c)) if kinds[c] in ("double", "float") else F.col(c).isNull()
    row = df.agg(*(F.avg(gone(c).cast("double")).alias(c) for c in df.columns))
    return row.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("missing_rate")) for c in df.columns))).alias("x")).select("x.*")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """``value, n``, most frequent first; null doesn't count."""
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "value")


def nunique(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column_name, n_unique``: exact number of distinct non-null values of each column, from distinct values in long form."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v")) for c in columns)))
    values = df.select(each.alias("x")).select("x.*").where("v IS NOT NULL").distinct()
    counts = values.groupBy(F.col("column_name").alias("_c")).agg(F.count(F.lit(1)).alias("n"))
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column_name string")
    return names.join(counts, F.col("column_name") == F.col("_c"), "left").select("column_name", F.coalesce("n", F.lit(0).cast("long")).alias("n_unique"))


def nunique_by(df: DataFrame, group: str, column: str) -> DataFrame:
    """Exact number of distinct values per group, most first, in two steps, so no group is held in one task."""
    pairs = df.where(F.col(group).isNotNull() & F.col(column).isNotNull()).select(group, column).distinct()
    return pairs.groupBy(group).agg(F.count(F.lit(1)).alias("n_unique")).orderBy(F.col("n_unique").desc(), group)


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column_name, n, mean, std, min, q25, q50, q75, max`` of numeric columns in one pass; nulls and NaN don't count.
    Quartiles are exact, interpolated, from counts by value along a global sort; without values they are null."""
    long = _stacked(df, columns)
    plain = long.groupBy("column_name").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))
    marks = quantiles(long, "column_name", "v", [0.25, 0.5, 0.75]).groupBy("column_name").agg(*(F.max(F.when(F.col("share") == q, F.col("quantile"))).alias(f"q{int(q * 100)}") for q in (0.25, 0.5, 0.75)))
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column_name string")
    joined = names.join(plain, "column_name", "left").join(marks, "column_name", "left")
    return joined.select("column_name", F.coalesce("n", F.lit(0).cast("long")).alias("n"), "mean", "std", "min", "q25", "q50", "q75", "max")


def histogram(df: DataFrame, value: Column, bins: int) -> DataFrame:
    """``bin, n, density`` of equal-width bins over [min, max], the last closed; empty bins don't come out."""
    v = df.select(value.cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    ends = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("total"))
    width = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / bins).otherwise(1.0 / bins)
    placed = v.join(F.broadcast(ends), F.lit(True)).withColumn("w", width)
    placed = placed.withColumn("bin", F.least(F.floor((F.col("v") - F.col("lo")) / F.col("w")), F.lit(bins - 1)).cast("long"))
    return placed.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.max("total").alias("t"), F.max("w").alias("w")).select("bin", "n", (F.col("n") / (F.col("t") * F.col("w"))).alias("density"))


def encode_for_correlation(df: DataFrame) -> DataFrame:
    """Eight numeric columns of log rows: match indicators, flags, rating, log1p of reviews and of a positive price."""
    price = F.when(F.col("item_price").cast("double") > 0, F.col("item_price").cast("double"))
    return df.select(
        same("search_location_id", "item_location_id").alias("location_match"),
        same("search_category", "item_category_id").alias("category_match"),
        *(F.col(c).cast("int").cast("double").alias(c) for c in ("search_is_delivery_search", "item_is_phone_hidden", "item_is_message_forbidden")),
        F.nanvl(F.col("item_rating").cast("double"), F.lit(None).cast("double")).alias("item_rating"),
        F.log1p(F.col("item_rating_reviews_count").cast("double")).alias("item_rating_reviews_count_log1p"),
        F.log1p(price).alias("item_price_log1p"),
    )


def average_ranks(df: DataFrame, column: str) -> DataFrame:
    """``v, rank`` for each distinct value, rising: counts by value are combined map-side and summed along a global sort."""
    return ranks.average_ranks(df.select(F.col(column).alias("v")), [], "v", descending=False).select("v", "rank")


def spearman(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """``a, b, n, rho`` over rows where both are known; all pairs in one plan."""
    each = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for a, b in pairs)))
    known = df.select(each.alias("p")).select("p.*").where("x IS NOT NULL AND y IS NOT NULL").groupBy("a", "b", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    known = cut_lineage(known)

    def placed(c: str) -> DataFrame:
        counts = known.groupBy("a", "b", c).agg(F.sum("n").alias("n"))
        return running_sums(counts, ["a", "b"], [F.col(c).asc()], "n").select("a", "b", c, (F.col("before") + (F.col("n") + 1) / 2.0).alias(f"r{c}"))

    k = known.join(placed("x"), ["a", "b", "x"]).join(placed("y"), ["a", "b", "y"])
    s = lambda e: F.sum(F.col("n") * e)
    x, y = F.col("rx"), F.col("ry")
    sums = k.groupBy("a", "b").agg(F.sum("n").cast("double").alias("n"), s(x).alias("sx"), s(y).alias("sy"), s(x * x).alias("sxx"), s(y * y).alias("syy"), s(x * y).alias("sxy"))
    below = F.sqrt((F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")) * (F.col("n") * F.col("syy") - F.col("sy") * F.col("sy")))
    rho = sums.select("a", "b", F.col("n").cast("long").alias("n"), F.when(below > 0, (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / below).alias("rho"))
    return df.sparkSession.createDataFrame(pairs, "a string, b string").join(rho, ["a", "b"], "left")
