"""Delimited tables whose headers may repeat names, with all cells as strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import stripped
from ..plans.scratch import materialize
from .versions import current

BOM = "﻿"


def delimiter(path: str) -> str:
    return "\t" if path.lower().rsplit(".", 1)[-1] in ("tsv", "tab") else ","


#: What a quoted cell holds after its opening quote: anything but a quote, or two quotes for one.
_BODY = '[^"]*+(?:""[^"]*+)*+'


def _opens(value: Column, sep: str) -> Column:
    """Whether a quoted cell is open at the end of a line that begins outside one.

    A cell is quoted if it begins with a quote; quotes elsewhere are letters.
    """
    s = "\\t" if sep == "\t" else f"\\Q{sep}\\E"
    cell = f'(?:"{_BODY}"(?:(?!{s}).)*+|(?!{s}|").(?:(?!{s}).)*+|)'
    return value.rlike(f'(?s)\\A(?:{cell}{s})*+"{_BODY}\\z')


def _empty() -> Column:
    return F.col("value").isin("", "\r")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of all files in parallel, with their file, the place of their byte range in it, and a number that grows within the range."""
    return spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"), "value")


def _blocks(lines: DataFrame, sep: str) -> DataFrame:
    """One row for each byte range: its first line that is not empty, its lines, and for either state it may begin in the state it ends in and the rows that begin in it.

    Only lines that may change the state, and empty ones, which are no rows
    outside a cell, are gathered (``events``), so a row's size is bounded by
    its byte range.
    """
    text = F.ltrim(F.col("value"), F.lit(BOM))
    quoted = F.contains("value", F.lit('"'))
    event = F.when(quoted | _empty(), F.struct("_id", _opens(text, sep).alias("out"), _opens(F.concat(F.lit('"'), text), sep).alias("in"), _empty().alias("empty")))
    event = F.when(event["out"] | ~event["in"] | event["empty"], event)  # else both states stay as they are
    blocks = lines.groupBy("_file", "_block").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"), F.min_by("value", F.when(~_empty(), F.col("_id"))).alias("_line"), F.array_sort(F.collect_list(event)).alias("events"))

    def outcome(start: bool) -> Column:
        begun = F.struct(F.lit(start).alias("open"), F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("rows"))

        def step(s: Column, e: Column) -> Column:
            after = e["_id"] - F.col("_first") + 1
            return F.struct(F.when(s["open"], e["in"]).otherwise(e["out"]).alias("open"), after.alias("at"), (s["rows"] + F.when(s["open"], F.lit(0).cast("long")).otherwise(after - s["at"] - e["empty"].cast("long"))).alias("rows"))

        return F.aggregate("events", begun, step, lambda s: F.struct(s["open"].alias("open"), (s["rows"] + F.when(s["open"], F.lit(0).cast("long")).otherwise(F.col("_n") - s["at"])).alias("rows")))

    return blocks.select("_file", "_block", "_first", "_n", "_line", (F.size("events") > 0).alias("_events"), outcome(False).alias("out"), outcome(True).alias("in"))


def _before(order: list[str], of: Column, by: list[str] = ()) -> Column:
    return of.over((Window.partitionBy(*by) if by else Window).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))


def _located(blocks: DataFrame) -> DataFrame:
    """Each byte range with the state it begins in (``_open``) and the rows that begin before it, in files by name.

    The state after a range is that of the last one whose end does not depend
    on its beginning, turned over by each range after it that turns it over.
    The windows hold one row for each range.
    """
    fixed = F.when(F.col("out.open") == F.col("in.open"), F.col("out.open"))
    turned = F.when(F.col("out.open") & ~F.col("in.open"), 1).otherwise(0)
    rows = blocks.withColumn("_turns", F.sum(turned).over(Window.partitionBy("_file").orderBy("_block"))).withColumn("_known", F.when(fixed.isNotNull(), F.struct(fixed.cast("int").alias("open"), F.col("_turns").alias("turns"))))
    known = _before(["_block"], F.last("_known", ignorenulls=True), ["_file"])
    rows = rows.withColumn("_last", known).withColumn("_all", F.coalesce(_before(["_block"], F.last("_turns"), ["_file"]), F.lit(0)))
    flips = F.coalesce(F.col("_last.open"), F.lit(0)) + F.col("_all") - F.coalesce(F.col("_last.turns"), F.lit(0))
    rows = rows.withColumn("_open", flips % 2 == 1)
    rows = rows.withColumn("_rows", F.when(F.col("_open"), F.col("in.rows")).otherwise(F.col("out.rows")))
    return rows.withColumn("_before", F.coalesce(_before(["_file", "_block"], F.sum("_rows")), F.lit(0))).select("_file", "_block", "_first", "_line", "_events", "_open", "_before")


def _cells(value: Column, width: int, sep: str) -> Column:
    """The first ``width`` cells of a row's text; missing ones are null."""
    schema = ", ".join(f"c{i} string" for i in range(width))
    return F.from_csv(F.regexp_replace(value, "\r$", ""), schema, {"sep": sep, "quote": '"', "escape": '"', "multiLine": "true", "ignoreLeadingWhiteSpace": "false", "maxColumns": str(max(20480, 2 * width))})


def scan(spark: SparkSession, path: str, sep: str | None = None) -> tuple[list[str], DataFrame]:
    """The header as it is, and rows of string columns c0, c1, ... with _row, their place in the file.

    Short rows read as blanks, a byte order mark and carriage returns go, and
    rows of blank cells keep their number but are left out; empty lines have
    none.  Of a folder the current version is read (see ``versions``); its
    files follow each other by name, and each that begins with the first one's
    header loses that line.

    Cells may hold line ends.  Files are read by byte ranges all the same: a
    first pass finds for each range whether it begins inside a quoted cell and
    how many rows begin before it, a second one reads the rows.  Only ranges
    with open cells are sorted, to put the lines of their rows together.  A
    quote that never closes takes the rest of its file as one row.
    """
    sep = sep or delimiter(path)
    path = current(spark, path)
    # written once: how files are cut depends on the executors at hand, and both passes need the same ranges
    lines = materialize(_lines(spark, path), "lines")
    blocks = materialize(_located(_blocks(lines, sep)), "ranges")
    first = blocks.where("_line is not null").orderBy("_file", "_block").limit(1).collect()
    if not first:
        return [], spark.createDataFrame([], "_row long")
    line = first[0]._line.lstrip(BOM)
    names = spark.range(1).select(_cells(F.lit(line), line.count(sep) + 1, sep).alias("r")).select("r.*").first()
    header = [x or "" for x in names]
    # a file's first line is a header if it reads as the first file's
    top = blocks.groupBy("_file").agg(F.min_by("_line", F.when(F.col("_line").isNotNull(), F.col("_block"))).alias("_line"), F.min("_before").alias("_start"))
    own = _cells(F.ltrim(F.col("_line"), F.lit(BOM)), len(header), sep)
    same = F.array(*(F.coalesce(own[f"c{i}"], F.lit("")) for i in range(len(header)))) == F.array(*map(F.lit, header))
    top = top.select("_file", "_start", F.coalesce(same.cast("int"), F.lit(0)).alias("_head"))
    top = top.withColumn("_heads", F.coalesce(F.sum("_head").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = lines.join(blocks.join(top, "_file").drop("_line"), ["_file", "_block"])
    whole = placed.where(~F.col("_events") & ~F.col("_open")).withColumn("_at", F.col("_before") + F.col("_id") - F.col("_first"))
    out = whole.select("_at", "_start", "_head", "_heads", "value")
    if not blocks.where("_events or _open").isEmpty():
        out = out.unionByName(_joined(placed.where("_events or _open"), sep).select(*out.columns))
    out = out.where(F.col("_at") >= F.col("_start") + F.col("_head"))
    value = F.when(F.col("_at") == F.col("_start"), F.ltrim("value", F.lit(BOM))).otherwise(F.col("value"))
    out = out.select((F.col("_at") - F.col("_head") - F.col("_heads")).alias("_row"), _cells(value, len(header), sep).alias("r"))
    out = out.select("_row", *(F.coalesce(F.col(f"r.c{i}"), F.lit("")).alias(f"c{i}") for i in range(len(header))))
    return header, out.where(F.concat_ws("", *(stripped(f"c{i}") for i in range(len(header)))) != "")


def _joined(lines: DataFrame, sep: str) -> DataFrame:
    """The rows of ranges with open cells, each from its lines; a row may go on in the ranges after its own."""
    text = F.ltrim(F.col("value"), F.lit(BOM))
    after = {k: F.when(F.contains("value", F.lit('"')), _opens(t, sep)).otherwise(k == "in") for k, t in (("out", text), ("in", F.concat(F.lit('"'), text)))}
    through = Window.partitionBy("_file", "_block").orderBy("_id")
    earlier = through.rowsBetween(Window.unboundedPreceding, -1)
    rows = lines.withColumns({f"_{k}": v for k, v in after.items()})
    rows = rows.withColumn("_turns", F.sum((F.col("_out") & ~F.col("_in")).cast("int")).over(through))
    rows = rows.withColumn("_known", F.when(F.col("_out") == F.col("_in"), F.struct(F.col("_out").cast("int").alias("open"), F.col("_turns").alias("turns"))))
    rows = rows.withColumns({"_last": F.last("_known", ignorenulls=True).over(earlier), "_all": F.coalesce(F.last("_turns").over(earlier), F.lit(0))})
    inside = (F.coalesce(F.col("_last.open"), F.col("_open").cast("int")) + F.col("_all") - F.coalesce(F.col("_last.turns"), F.lit(0))) % 2
    rows = rows.withColumn("_inside", inside).withColumn("_none", _empty() & (F.col("_inside") == 0))
    rows = rows.withColumn("_at", F.col("_before") + F.sum(F.when(F.col("_none"), 0).otherwise(1 - F.col("_inside"))).over(through) - 1).where(~F.col("_none"))
    parts = F.array_sort(F.collect_list(F.struct("_block", "_id", "value")))
    return rows.groupBy("_file", "_at").agg(*(F.first(c).alias(c) for c in ("_start", "_head", "_heads")), F.concat_ws("\n", F.transform(parts, lambda p: p["value"])).alias("value"))


def nth(header: list[str], name: str, occurrence: int = 1):
    """The column of the n-th header of that name."""
    places = [i for i, h in enumerate(header) if h == name]
    if len(places) < occurrence:
        raise ValueError(f"no occurrence {occurrence} of column {name!r}")
    return F.col(f"c{places[occurrence - 1]}")


def named(header: list[str], rows: DataFrame, duplicates: str = "first") -> DataFrame:
    """Rows under their header's names.

    ``duplicates``: 'first' keeps the first of equal names, 'refuse' raises.
    """
    if duplicates == "refuse" and len(set(header)) < len(header):
        raise ValueError(f"repeated columns: {sorted({h for h in header if header.count(h) > 1})}")
    seen: dict[str, int] = {}
    for i, h in enumerate(header):
        seen.setdefault(h, i)
    return rows.select("_row", *(F.col(f"c{i}").alias(h) for h, i in seen.items() if h))


def validated(df: DataFrame, required: list[str], optional: list[str] = ()) -> DataFrame:
    """Stops if a required column is missing; adds missing optional ones as blanks."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df.withColumns({c: F.lit("") for c in optional if c not in df.columns}) if set(optional) - set(df.columns) else df


def after_marker(rows: DataFrame, marker: str) -> DataFrame:
    """The rows after the first whose first cell is ``marker``; ``rows`` is from ``scan`` of a file with sections."""
    start = rows.where(F.col("c0") == marker).agg(F.min("_row").alias("_start"))
    return rows.join(F.broadcast(start), F.col("_row") > F.col("_start")).drop("_start")


def pairs(spark: SparkSession, path: str) -> DataFrame:
    """Alignment pairs (query, target, pct_id, evalue, bits, ord); unparsable rows are skipped."""
    raw = spark.read.option("sep", "\t").schema("q string, t string, p string, e string, b string").csv(current(spark, path)).withColumn("ord", F.monotonically_increasing_id())
    typed = raw.select(F.col("q").alias("query"), F.col("t").alias("target"), F.expr("try_cast(p as double)").alias("pct_id"), F.expr("try_cast(e as double)").alias("evalue"), F.expr("try_cast(b as double)").alias("bits"), "ord")
    return typed.dropna()


def edges(spark: SparkSession, path: str) -> DataFrame:
    """Directed edges with coverage; ids such as n12 become numbers; self pairs and unparsable rows go."""
    raw = spark.read.option("sep", "\t").schema("q string, s string, p string, qc string, sc string, b string").csv(current(spark, path)).withColumn("ord", F.monotonically_increasing_id())
    number = lambda c: F.expr(f"try_cast(substring({c}, 2) as long)")
    typed = raw.select(number("q").alias("q"), number("s").alias("s"), *(F.expr(f"try_cast({c} as double)").alias(n) for c, n in (("p", "pct_id"), ("qc", "qcov"), ("sc", "scov"), ("b", "bits"))), "ord")
    return typed.dropna().where("q <> s")


def cluster_records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Centroids and hits of a tagged cluster file (S and H records)."""
    cells = F.split("value", "\t")
    rows = spark.read.text(current(spark, path)).select(cells.alias("v")).where(F.size("v") >= 10)
    col = lambda i, n: F.get("v", i).alias(n)
    centroids = rows.where(F.get("v", 0) == "S").select(col(1, "cluster"), col(8, "label"))
    hits = rows.where(F.get("v", 0) == "H").select(col(1, "cluster"), F.expr("try_cast(v[3] as double)").alias("pct_id"), col(8, "label"), col(9, "centroid"))
    return centroids, hits


def domain_hits(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a domain table: target, query, score, from, to, length."""
    rows = spark.read.text(current(spark, path)).where(~F.startswith("value", F.lit("#"))).select(F.split(F.trim("value"), r"\s+").alias("v")).where(F.size("v") >= 23)
    number = lambda i, n: F.expr(f"try_cast(v[{i}] as double)").alias(n)
    return rows.select(F.get("v", 0).alias("target"), F.get("v", 3).alias("query"), number(5, "query_length"), number(13, "score"), number(15, "hmm_from"), number(16, "hmm_to"))


def count_rows(spark: SparkSession, path: str) -> int | None:
    """The number of rows of a delimited file, null if there is none."""
    if not exists(spark, path):
        return None
    return scan(spark, path)[1].count()


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def numbered(df: DataFrame, *order, name: str = "_ord") -> DataFrame:
    """A running number from 0 in the given order, without one task that sorts everything.

    Rows are range-partitioned and sorted; each partition's offset comes from
    the partitions' sizes.
    """
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_in", F.monotonically_increasing_id())
    held = materialize(sorted_, "numbered")
    sizes = held.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_in").alias("_least"))
    offsets = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).select("_part", "_least", "_before")
    return held.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_in") - F.col("_least") + F.col("_before")).drop("_part", "_in", "_least", "_before")
