"""Summaries that a day's rows are added to, and a search index that is read in part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.versions import current, publish

# --- summary views ---------------------------------------------------------------------------------------------------


def partial(df: DataFrame, by: list[str], sums: list[str] = (), values: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """What can be added up: per group count, sums, extremes and sketches; and per group, column and value a count.

    The second table holds the exact way to modes and distinct counts, one row
    for each value that occurs; the sketches (HyperLogLog) beside it answer
    distinct counts without it.
    """
    cells = [f(c).alias(f"{n}_{c}") for c in sums for n, f in (("sum", F.sum), ("least", F.min), ("most", F.max))]
    numbers = [F.count(c).alias(f"filled_{c}") for c in sums]
    sketches = [F.hll_sketch_agg(F.col(c).cast("string")).alias(f"sketch_{c}") for c in values]
    groups = df.groupBy(*by).agg(F.count("*").alias("n"), *numbers, *cells, *sketches)
    if not values:
        return groups, groups.select(*by, F.lit("").alias("column"), F.lit("").alias("value"), F.lit(0).cast("long").alias("n")).where("false")
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in values))).alias("cell")
    counts = df.select(*by, each).where("cell.value is not null").groupBy(*by, F.col("cell.column").alias("column"), F.col("cell.value").alias("value")).agg(F.count("*").alias("n"))
    return groups, counts


def merged(a: tuple[DataFrame, DataFrame], b: tuple[DataFrame, DataFrame], by: list[str]) -> tuple[DataFrame, DataFrame]:
    """The partial summaries of the rows of both."""

    def add(c: str) -> Column:
        how = F.min if c.startswith("least_") else F.max if c.startswith("most_") else F.hll_union_agg if c.startswith("sketch_") else F.sum
        return how(c).alias(c)

    groups = a[0].unionByName(b[0])
    counts = a[1].unionByName(b[1]).groupBy(*by, "column", "value").agg(F.sum("n").alias("n"))
    return groups.groupBy(*by).agg(*(add(c) for c in groups.columns if c not in by)), counts


def finished(parts: tuple[DataFrame, DataFrame], by: list[str], sums: list[str] = (), values: list[str] = ()) -> DataFrame:
    """Per group: n, and of each summed column sum, avg, min, max, of each value column mode (ties: the least), distinct and the sketch's estimate."""
    groups, counts = parts
    out = [F.col("n")]
    for c in sums:
        out += [F.col(f"sum_{c}"), (F.col(f"sum_{c}") / F.col(f"filled_{c}")).alias(f"avg_{c}"), F.col(f"least_{c}").alias(f"min_{c}"), F.col(f"most_{c}").alias(f"max_{c}")]
    out += [F.hll_sketch_estimate(f"sketch_{c}").alias(f"about_{c}") for c in values]
    done = groups.select(*by, *out)
    if values:
        ranked = counts.groupBy(*by, "column").agg(F.min(F.struct((-F.col("n")).alias("k"), F.col("value").alias("v"))).alias("top"), F.count("*").alias("kinds"))
        found = ranked.groupBy(*by).agg(*(x for c in values for x in (F.max(F.when(F.col("column") == c, F.col("top.v"))).alias(f"mode_{c}"), F.max(F.when(F.col("column") == c, F.col("kinds"))).alias(f"distinct_{c}"))))
        done = done.join(found, by, "left").withColumns({f"distinct_{c}": F.coalesce(f"distinct_{c}", F.lit(0)).cast("long") for c in values})
    return done


# --- search index ----------------------------------------------------------------------------------------------------

#: Rows of one list lie within so many row numbers.
SPAN = 1 << 16


def terms(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\w#]+"), lambda x: x != ""))


def write_index(df: DataFrame, row: str, text: str, path: str) -> None:
    """An inverted index of ``text``: (term, span, n, first, gaps), sorted by term over many files.

    ``row``: a whole number, not negative.  The rows of a term are cut into
    spans of ``SPAN`` numbers, so that a term of all rows is many short lists;
    each list is its first row and the gaps between its rows.  Files hold ranges of terms, so
    a look-up reads the row groups whose range holds the term.
    """
    postings = df.select(F.col(row).cast("long").alias("row"), F.explode(terms(F.col(text))).alias("term")).withColumn("span", F.floor(F.col("row") / SPAN).cast("long"))
    lists = postings.groupBy("term", "span").agg(F.array_sort(F.collect_set("row")).alias("rows"))
    gaps = F.expr("transform(slice(rows, 2, size(rows)), (x, i) -> cast(x - rows[i] as int))")
    index = lists.select("term", "span", F.size("rows").alias("n"), F.get("rows", F.lit(0)).alias("first"), gaps.alias("gaps"))
    publish(df.sparkSession, path, index.repartitionByRange("term", "span").sortWithinPartitions("term", "span").write.parquet)


def _rows(index: DataFrame) -> DataFrame:
    sums = F.expr("aggregate(gaps, array(first), (done, gap) -> concat(done, array(done[size(done) - 1] + gap)))")
    return index.select("term", F.explode(sums).alias("row"))


def find_terms(spark: SparkSession, path: str, wanted: list[str], every: bool = True) -> DataFrame:
    """(row, terms): the rows that hold all (or any) of the terms, and how many."""
    low = sorted({w.lower() for w in wanted})
    index = spark.read.parquet(current(spark, path)).where(F.col("term").isin(low))
    found = _rows(index).groupBy("row").agg(F.count("*").alias("terms"))
    return found.where(F.col("terms") == len(low)) if every else found


def find_prefix(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """(term, row): the rows of all terms that begin so; read as a range of terms."""
    low = prefix.lower()
    index = spark.read.parquet(current(spark, path)).where((F.col("term") >= low) & (F.col("term") < low + chr(0x10FFFF)))
    return _rows(index)
