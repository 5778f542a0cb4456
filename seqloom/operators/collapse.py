"""Grouping that keeps every contributing value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import first_number, stripped
from ..plans.scratch import materialize
from ..sources.delimited import numbered


def value_set(x: str, numeric: bool = False) -> Column:
    """Sorted distinct non-blank values; ``numeric`` sorts by the first number in each, then by text."""
    values = F.collect_set(F.nullif(stripped(x), F.lit("")))
    if not numeric:
        return F.array_sort(values)
    keyed = F.transform(values, lambda v: F.struct(first_number(v, 10**9).alias("n"), v.alias("v")))
    return F.transform(F.array_sort(keyed), lambda k: k["v"])


def collapse(df: DataFrame, key: str, columns: list[str], numeric: list[str] = (), more: dict[str, Column] | None = None) -> DataFrame:
    """One row for each key: for every column its least value and all values joined by ';', and the number of rows.

    ``more``: further aggregates by name.
    """
    more = more or {}
    grouped = df.groupBy(key).agg(F.count("*").alias("n_source_rows"), *(v.alias(k) for k, v in more.items()), *(value_set(c, c in numeric).alias(f"_{c}") for c in columns))
    cells = [x for c in columns for x in (F.coalesce(F.get(f"_{c}", F.lit(0)), F.lit("")).alias(c), F.concat_ws(";", f"_{c}").alias(f"{c}_all"))]
    return grouped.select(key, "n_source_rows", *cells, *more)


def ordered_distinct(value: str, order: str) -> Column:
    """Distinct values in the order of their first occurrence (``order`` must be unique within a group)."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))
    return F.array_distinct(F.transform(pairs, lambda p: p["v"]))


def ordered_merge(value: str, order: str, delimiter: str = ";") -> Column:
    """Distinct entries of delimited cells, in order."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))
    parts = F.flatten(F.transform(pairs, lambda p: F.split(F.coalesce(p["v"], F.lit("")), delimiter)))
    return F.array_distinct(F.filter(F.transform(parts, stripped), lambda x: x != ""))


def ordered_lists(df: DataFrame, key: str, value: Column, order: str, name: str) -> DataFrame:
    """(key, name): each key's distinct non-blank entries in the order of their first occurrence, for keys of any number of rows.

    ``value`` is one entry or an array of them.  The first place of each entry
    is found first, with partial aggregation, so a list holds an entry once and
    no task the rows of a whole key.  Entries of one row keep their order.
    """
    # a single entry is an array of one
    entries = value if dict(df.select(value.alias("v")).dtypes)["v"].startswith("array") else F.array(value)
    each = df.select(key, order, F.posexplode(entries).alias("_pos", "_entry")).withColumn("_entry", stripped("_entry")).where("_entry <> ''")
    first = each.groupBy(key, "_entry").agg(F.min(F.struct(F.col(order), F.col("_pos"))).alias("_at"))
    listed = first.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_at", "_entry"))).alias("_all"))
    return listed.select(key, F.transform("_all", lambda x: x["_entry"]).alias(name))


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def upper_median(x: str) -> Column:
    """The element at n // 2 of the sorted values, for groups of bounded size: no mean of two."""
    return F.get(F.sort_array(F.collect_list(x)), F.floor(F.count(x) / 2).cast("int"))


#: Parts into which a round of ``order_statistic`` cuts the values that are left.
PARTS = 1024


def order_statistic(df: DataFrame, x: str, place: Column, by: list[str] = ()) -> DataFrame:
    """(by, value): the value at ``place`` (from 0, an expression of ``n``) of each group's sorted non-null numbers, without sorting.

    Each round counts the values in PARTS equal parts between the least and
    the largest that are left, and goes on with the part that holds the place;
    the values of that part bound the next round.  Few rounds are needed, and a
    group of any size costs a row for each task and part.  NaN counts as the
    largest value.
    """
    # all that decides the order, as two numbers: NaN apart from the rest
    value = F.col(x).cast("double") if df.schema[x].dataType.simpleString() in ("float", "double") else F.col(x).cast("decimal(38,6)") if "decimal" in df.schema[x].dataType.simpleString() else F.col(x).cast("long")
    rows = df.where(F.col(x).isNotNull()).select(F.struct(*by).alias("g") if by else F.lit(0).alias("g"), value.alias("v"))
    real = rows.where(~F.isnan("v")) if dict(rows.dtypes)["v"] == "double" else rows
    counts = rows.groupBy("g").agg(F.count("*").alias("n"))
    bounds = real.groupBy("g").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("numbers")).join(counts, "g").select("g", "lo", "hi", place.cast("long").alias("at"), "numbers")
    # a place beyond the numbers is a NaN
    beyond = counts.join(bounds.select("g", "numbers"), "g", "left").select("g", place.cast("long").alias("at"), F.coalesce("numbers", F.lit(0)).alias("numbers"), "n").where("at >= numbers and at < n")
    state = materialize(bounds.where("at >= 0 and at < numbers").select("g", "lo", "hi", "at"), "bounds")
    done = state.where("lo = hi")
    while True:
        state = state.where("lo <> hi")
        if state.isEmpty():
            break
        inside = real.join(F.broadcast(state) if not by else state, "g").where("v >= lo and v <= hi")
        # halves keep the difference of very large numbers finite
        part = F.least(F.lit(PARTS - 1), F.floor((F.col("v") / 2 - F.col("lo") / 2).cast("double") / (F.col("hi") / 2 - F.col("lo") / 2).cast("double") * PARTS))
        cells = inside.groupBy("g", part.cast("int").alias("part")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.first("at").alias("at"))
        # PARTS rows at most for each group
        before = F.sum("n").over(Window.partitionBy("g").orderBy("part")) - F.col("n")
        state = materialize(cells.withColumn("before", before).where("at >= before and at < before + n").select("g", "lo", "hi", (F.col("at") - F.col("before")).alias("at")), "bounds")
        done = done.unionByName(state.where("lo = hi"))
    out = done.select("g", F.col("lo").alias("value")).unionByName(beyond.select("g", F.lit(float("nan")).cast(dict(rows.dtypes)["v"]).alias("value"))) if dict(rows.dtypes)["v"] == "double" else done.select("g", F.col("lo").alias("value"))
    return out.select(*(F.col(f"g.{c}") for c in by), F.col("value").cast(df.schema[x].dataType).alias("value"))


def upper_median_of(df: DataFrame, x: str, by: list[str] = ()) -> DataFrame:
    """The same for groups of any size."""
    return order_statistic(df, x, F.floor(F.col("n") / 2), by).withColumnRenamed("value", "upper_median")


def quantiles(df: DataFrame, x: str, shares: dict[str, float], by: list[str]) -> DataFrame:
    """(by, one column for each share): quantiles between the two nearest values, for groups of any size."""
    # distinct values with their counts, in ranges; a task holds one range, and the windows over ranges a row for each
    counts = df.where(F.col(x).isNotNull()).groupBy(F.struct(*by).alias("g"), F.col(x).alias("v")).agg(F.count("*").alias("c"))
    held = materialize(counts.repartitionByRange("g", "v").withColumn("part", F.spark_partition_id()), "values")
    parts = held.groupBy("g", "part").agg(F.sum("c").alias("held"))
    parts = parts.select("g", "part", (F.sum("held").over(Window.partitionBy("g").orderBy("part")) - F.col("held")).alias("before"), F.sum("held").over(Window.partitionBy("g")).alias("n"))
    placed = held.join(F.broadcast(parts), ["g", "part"])
    first = F.col("before") + F.sum("c").over(Window.partitionBy("g", "part").orderBy("v")) - F.col("c")
    placed = placed.withColumn("first", first)
    at = lambda share: F.lit(share) * (F.col("n") - 1)
    value = lambda place: F.max(F.when((place >= F.col("first")) & (place < F.col("first") + F.col("c")), F.col("v")))
    ends = [e for i, share in enumerate(shares.values()) for e in (value(F.floor(at(share))).alias(f"low{i}"), value(F.ceil(at(share))).alias(f"high{i}"))]
    found = placed.groupBy("g").agg(F.max("n").alias("n"), *ends)
    between = [(F.col(f"low{i}") + (F.col(f"high{i}") - F.col(f"low{i}")) * (at(share) - F.floor(at(share)))).alias(name) for i, (name, share) in enumerate(shares.items())]
    return found.select(*(F.col(f"g.{c}").alias(c) for c in by), *between)


def duplicate_groups(df: DataFrame, key: str, id_col: str) -> DataFrame:
    """(id, gid, n, first_id) of rows that share a key with others; groups are numbered by their first id.

    The other members are those with the same gid: a list of them in each row
    would grow with the square of the group.
    """
    groups = df.where(F.coalesce(F.col(key), F.lit("")) != "").groupBy(key).agg(F.count("*").alias("n"), F.min(id_col).alias("first_id")).where("n > 1")
    placed = numbered(groups, "first_id", key).withColumn("gid", F.col("_ord") + 1)
    return df.select(id_col, key).join(placed, key).select(id_col, "gid", "n", "first_id")


def histogram(df: DataFrame, size: str) -> DataFrame:
    """Groups and records by group size, with the share of groups."""
    h = df.groupBy(size).agg(F.count("*").alias("n_groups"))
    return h.withColumn("n_records", F.col(size) * F.col("n_groups")).withColumn("pct_groups", F.round(100 * F.col("n_groups") / F.sum("n_groups").over(Window.partitionBy(F.lit(0))), 3))


def listed_counts(df: DataFrame, column: str, fixed: list[str]) -> DataFrame:
    """Counts by category: the fixed ones first, in their order and even if absent, then the others."""
    spark = df.sparkSession
    order = spark.createDataFrame([(v, i) for i, v in enumerate(fixed)], f"{column} string, place int")
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    return order.join(counts, column, "full").select(column, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("place", F.lit(len(fixed))).alias("place"))


def coverage(hits: DataFrame, target: str) -> DataFrame:
    """Best-scoring domain of each target and its coverage of the profile."""
    best = hits.groupBy(target).agg(F.max_by(F.struct("score", "hmm_from", "hmm_to", "query_length"), F.struct("score", F.col("hmm_to") - F.col("hmm_from"))).alias("b"))
    return best.select(target, F.col("b.score").alias("score"), ((F.col("b.hmm_to") - F.col("b.hmm_from") + 1) / F.col("b.query_length")).alias("coverage"))


def domain_summary(hits: DataFrame, model: str, target: str, sizes: DataFrame, floor: float = 0.5) -> DataFrame:
    """Per model: members, detected ones, mean and least coverage of the best domains, and flags joined by ';'.

    ``hits``: model, target, score, hmm_from, hmm_to, query_length; ``sizes``: model, n.
    """
    best = hits.groupBy(model, target).agg(F.max_by(F.struct("hmm_from", "hmm_to", "query_length"), F.struct("score", F.col("hmm_to") - F.col("hmm_from"))).alias("b"))
    # whole lengths are added up and divided once, so the mean does not depend on the order of the rows
    length = F.col("b.hmm_to") - F.col("b.hmm_from") + 1
    sums = best.groupBy(model, F.col("b.query_length").alias("_of")).agg(F.count("*").alias("_n"), F.sum(length).alias("_sum"), F.min(length).alias("_least"))
    total = F.aggregate(F.array_sort(F.collect_list(F.struct("_of", "_sum"))), F.lit(0.0), lambda t, x: t + x["_sum"] / x["_of"])
    found = sums.groupBy(model).agg(F.sum("_n").alias("detected"), (total / F.sum("_n")).alias("mean"), F.min(F.col("_least") / F.col("_of")).alias("least"))
    joined = sizes.join(found, model, "left").withColumns({"detected": F.coalesce("detected", F.lit(0)), "mean": F.coalesce("mean", F.lit(0.0)), "least": F.coalesce("least", F.lit(0.0))})
    flags = F.concat_ws(";", F.when(F.col("detected") < F.col("n"), F.concat(F.lit("undetected="), (F.col("n") - F.col("detected")).cast("string"))), F.when(F.col("mean") < floor, "low_member_coverage"), F.when(F.col("n") == 1, "singleton_model"))
    return joined.withColumn("flags", flags)
