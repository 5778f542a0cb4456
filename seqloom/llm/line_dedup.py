"""Removal of repeated multi-line chunks with content-defined boundaries.

A text's lines are hashed; the hash of each two successive line hashes decides
whether a chunk ends there, so an inserted line shifts no boundary but its
own.  Chunks with at least two non-blank lines are counted by hash over all
documents.  The first occurrence (least id, then text hash, then place) stays;
others go after their bytes were compared with the first one's.  A repeated
passage that fills no chunk of its own stays: short ones often do (README).

With ``passages`` the units are all pairs of successive non-blank lines instead
(with the blank lines between), so no repeated passage of two lines or more is
missed.  The lines of the first occurrence of a repeated pair always stay.

DataFrame functions only: no Python on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import join_hot
from ..plans.scratch import materialize

#: Last hex digits of the rolling hash that end a chunk: one line in four.
ENDS = ("0", "4", "8", "c")


def _solid(line: Column) -> Column:
    return F.trim(F.translate(line, "\r\t", "  ")) != ""


def _lines(df: DataFrame, passages: bool) -> DataFrame:
    """With columns lines and spans (first line and number of lines of each chunk or pair)."""
    df = df.withColumn("lines", F.split(F.coalesce("text", F.lit("")), "\n", -1))
    if passages:
        solid = F.transform("lines", lambda x, i: F.when(_solid(x), i + 1))
        df = df.withColumn("solid", F.filter(solid, lambda i: i.isNotNull()))
        after = F.slice("solid", 2, F.size("solid"))
        return df.withColumn("spans", F.zip_with(F.slice("solid", 1, F.size(after)), after, lambda a, b: F.struct(a.alias("first"), (b - a + 1).alias("n")))).drop("solid")
    df = df.withColumn("hashes", F.transform("lines", F.md5))
    before = F.concat(F.array(F.lit("")), F.slice("hashes", 1, F.size("hashes") - 1))
    ends = F.zip_with("hashes", before, lambda h, p: F.substring(F.md5(F.concat(p, h)), 32, 1).isin(*ENDS))
    places = F.filter(F.transform(ends, lambda e, i: F.when(e, i)), lambda i: i.isNotNull())
    df = df.withColumn("ends", F.array_union(places, F.array(F.size("hashes") - 1)))
    starts = F.concat(F.array(F.lit(-1)), F.slice("ends", 1, F.size("ends") - 1))
    return df.withColumn("spans", F.zip_with(starts, "ends", lambda a, b: F.struct((a + 2).alias("first"), (b - a).alias("n")))).drop("hashes", "ends")


def _text(lines: Column, span: Column) -> Column:
    return F.array_join(F.slice(lines, span["first"], span["n"]), "\n")


def _chunks_left() -> tuple[Column, Column]:
    """The text without the chunks at ``gone``, and the number of lines lost."""
    left = F.filter(F.transform("spans", lambda s, i: F.when(~F.array_contains("gone", i), s)), lambda s: s.isNotNull())
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda s: _text(F.col("lines"), s)), "\n"))
    lost = F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("lines") - F.aggregate(left, F.lit(0), lambda n, s: n + s["n"]))
    return text, lost


def _numbers(spans: Column, places: Column) -> Column:
    """The numbers of the lines in the spans at ``places``."""
    chosen = F.transform(places, lambda i: F.element_at(spans, i + 1))
    return F.array_distinct(F.flatten(F.transform(chosen, lambda s: F.sequence(s["first"], s["first"] + s["n"] - 1))))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", passages: bool = False, results: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """All columns of ``docs`` with the text reduced, and the ``results``: the text's lines and the lines removed.

    A null text counts as empty and becomes an empty one; a text of one line
    has no multi-line chunk and stays.  Rows with equal id and text are one
    occurrence: each keeps the chunks of which they are the first.  A null id
    comes after all others.  A column of ``docs`` named as a result is replaced
    by it; other names never clash.
    """
    others = [c for c in docs.columns if c not in (id_col, text_col, *results)]
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.struct(*others).alias("rest") if others else F.lit(None).cast("int").alias("rest"))
    rows = rows.withColumn("print", F.unhex(F.md5("text")))
    plain = _lines(rows.select("id", "print", "text"), passages)
    chunks = plain.select("id", "print", F.posexplode(F.transform("spans", lambda s: F.struct(F.unhex(F.md5(_text(F.col("lines"), s))).alias("hash"), (F.size(F.filter(F.slice(F.col("lines"), s["first"], s["n"]), _solid)) > 1).alias("many")))).alias("place", "chunk"))
    chunks = materialize(chunks.where("chunk.many").select("id", "print", "place", F.col("chunk.hash").alias("hash")), "chunks")
    at = F.struct(F.col("id").isNull().alias("none"), "id", "print", "place")
    repeated = chunks.groupBy("hash").agg(F.max(at).alias("last"), F.min(at).alias("keeper")).where("last != keeper").select("hash", "keeper")
    # what is joined grows with the input, so all joins sort at every size
    again = join_hot(chunks, repeated, "hash")
    where = materialize(again.groupBy("id", "print").agg(F.collect_set(F.struct("place", "hash", (at != F.col("keeper")).alias("later"))).alias("found")), "found")

    # the bytes of repeated chunks: those of later occurrences are compared with the keeper's
    w = where.withColumnsRenamed({"id": "wid", "print": "wprint"})
    held = _lines(rows.select("id", "print", "text").join(w.hint("merge"), F.col("id").eqNullSafe(F.col("wid")) & (F.col("print") == F.col("wprint"))).select("id", "print", "text", "found"), passages)
    bytes_ = held.select("id", "print", "lines", "spans", F.explode(F.transform("found", lambda f: F.struct(f["place"].alias("place"), f["hash"].alias("hash"), f["later"].alias("later"), _text(F.col("lines"), F.element_at(F.col("spans"), f["place"] + 1)).alias("body")))).alias("f")).select("id", "print", "f.*")
    bytes_ = materialize(bytes_, "bodies")
    first = bytes_.where("not later").select("hash", F.col("body").alias("kept")).dropDuplicates(["hash"])
    gone = join_hot(bytes_.where("later"), first, "hash").where("body = kept")
    if passages:  # pairs overlap: the lines of first occurrences are needed beside those that go
        gone = gone.select("id", "print", "place", "later").unionByName(bytes_.where("not later").select("id", "print", "place", "later"))
        sets = gone.groupBy("id", "print").agg(F.collect_set(F.when(F.col("later"), F.col("place"))).alias("gone"), F.collect_set(F.when(~F.col("later"), F.col("place"))).alias("first")).where(F.size("gone") > 0)
    else:
        sets = gone.groupBy("id", "print").agg(F.collect_set("place").alias("gone"))
    gone = materialize(sets, "gone").withColumnsRenamed({"id": "gid", "print": "gprint"})
    out = rows.join(gone.hint("merge"), F.col("id").eqNullSafe(F.col("gid")) & (F.col("print") == F.col("gprint")), "left")
    # texts that lose nothing are passed on as they are
    touched = _lines(out, passages)
    if passages:
        numbers = F.array_except(_numbers(F.col("spans"), F.col("gone")), _numbers(F.col("spans"), F.col("first")))
        stay = F.array_except(F.sequence(F.lit(1), F.size("lines")), numbers)
        text = F.array_join(F.transform(stay, lambda i: F.element_at("lines", i)), "\n")
        text, lost = F.when(F.col("gone").isNull(), F.col("text")).otherwise(text), F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size(numbers))
    else:
        text, lost = _chunks_left()
    result = touched.select("id", text.alias("text"), "rest", F.size("lines").cast("long").alias("n_lines"), lost.cast("long").alias("n_removed"))
    named = {id_col: F.col("id"), text_col: F.col("text")}
    return result.select(*(named.get(c, F.col("rest")[c] if others else F.lit(None)).alias(c) for c in docs.columns if c not in results), F.col("n_lines").alias(results[0]), F.col("n_removed").alias(results[1]))
