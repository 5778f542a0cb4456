"""Spelling variant grouping: words one edit apart, by an even-partition pigeonhole join (native).

A word of length l is cut evenly into two segments.  One edit spoils one of
them, so a word of equal length has the other segment at the same place, and
a word one longer has it there or shifted by one.  Every word is indexed by
its segments and probes the segments of equal and of one-shorter words.

Many words may share a segment.  The words of a segment with more than
``GROUP`` entries differ by one edit in what is left of them, so what is left
is cut evenly in turn, round by round, until each group is small or one
character is left; the number of comparisons is in proportion to the entries
and no pair is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import discard, materialize

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: One in so many (document, run) pairs loses a character.
SPOILED = 97
#: Entries with one segment that are compared without cutting further.
GROUP = 400


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (word, n): the words of at least five code points with at least three occurrences over all texts."""
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.withColumn("run", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(F.col("run")))
    h = F.crc32(F.concat("id", F.lit(":"), "run"))
    at = (h % F.length("run")).cast("int")
    spoiled = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = runs.select(F.when(h % SPOILED == 0, spoiled).otherwise(F.col("run")).alias("word")).where(F.length("word") >= LEAST_LENGTH)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _cut(entries: DataFrame) -> DataFrame:
    """Each entry twice: once keyed by the left half of its rest, once by the right half.

    An entry is a word as itself (longer = 0) or as the longer of two (1),
    with the ``rest`` in which it may differ from the others of its ``key``.
    ``inner``: the rest does not reach to the word's end.
    """
    rest, longer = F.col("rest"), F.col("longer")
    half = F.floor((F.length("rest") - longer) / 2).cast("int")

    def sub(at: Column, n: Column) -> Column:
        return F.substring(rest, at, n)

    every = F.length("rest")
    left = F.struct(F.concat("key", F.lit("<"), sub(F.lit(1), half)).alias("key"), sub(half + 1, every).alias("rest"), F.col("inner"))
    right = F.struct(F.concat("key", F.lit(">"), sub(half + longer + 1, every)).alias("key"), sub(F.lit(1), half + longer).alias("rest"), F.lit(True).alias("inner"))
    return entries.select("word", "n", "longer", F.explode(F.array(left, right)).alias("half")).select("word", "n", "longer", "half.*")


def near_pairs(words: DataFrame) -> DataFrame:
    """Rows (a, n_a, b, n_b): each pair of words one inserted, deleted or replaced code point apart, once."""
    length = F.length("word")
    roles = F.array(F.struct(F.lit(0).alias("longer"), length.alias("base")), F.struct(F.lit(1).alias("longer"), (length - 1).alias("base")))
    entries = words.select("word", "n", F.explode(roles).alias("role")).select("word", "n", "role.longer", F.col("role.base").cast("string").alias("key"), F.col("word").alias("rest"), F.lit(False).alias("inner"))
    entries = materialize(_cut(entries.where(F.col("rest") != "").where(length > F.col("longer"))), "entries")
    pairs = []
    while True:
        size = F.count("*")
        # one character left: as many entries as there are characters, whatever the words
        more = entries.groupBy("key").agg(size.alias("size"), F.max(F.length("rest") - F.col("longer")).alias("base")).where((F.col("size") > GROUP) & (F.col("base") > 1)).select("key")
        more = materialize(more, "large")
        none = more.isEmpty()
        small = entries if none else entries.join(more, "key", "left_anti")
        a, b = small.where("longer = 0").alias("a"), small.alias("b")
        found = a.join(b.hint("merge"), "key").where("(b.longer = 1 or a.rest < b.rest)").where(F.levenshtein("a.rest", "b.rest", 1) == 1)
        # an insertion into a run of one character can be seen at several places: it counts at the last
        found = found.where("not (b.longer = 1 and b.inner and startswith(b.rest, a.rest))")
        pairs.append(materialize(found.selectExpr("a.word as a", "a.n as n_a", "b.word as b", "b.n as n_b"), "pairs"))
        if none:
            break
        old, entries = entries, materialize(_cut(entries.join(more, "key", "left_semi")), "entries")
        discard(old)
    out = pairs[0]
    for x in pairs[1:]:
        out = out.unionByName(x)
    return out


def roots(forms: DataFrame) -> DataFrame:
    """Rows (word, root) from rows (word, form): the last form on the way from each word, by pointer doubling."""
    now = materialize(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while not now.where("moved").isEmpty():
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        old, now = now, materialize(now.join(step.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        discard(old)
    return now.select("word", "root")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each word: word, n, n_near, form, form_n, root.

    Words come from maximal runs of letters, A-Z lower-cased; where the crc32
    of ``<id>:<run>`` is a multiple of 97 the run loses one code point.  Words
    have at least five code points and three occurrences.  ``form``: the near
    word (one edit away) of largest n, of equals the least in code-point
    order, if that n is at least twice the word's; else null, as is
    ``form_n``.  ``root``: where following forms ends, the word itself without
    a form.  Null and empty texts have no words, a null id counts as an empty
    one, rows given twice count twice, an empty table gives no rows; other
    columns are ignored.
    """
    words = materialize(word_counts(docs, id_col, text_col), "words")
    pairs = near_pairs(words)
    sides = F.array(F.struct(F.col("a").alias("word"), F.struct((-F.col("n_b")).alias("less"), F.col("b").alias("other")).alias("near")), F.struct(F.col("b").alias("word"), F.struct((-F.col("n_a")).alias("less"), F.col("a").alias("other")).alias("near")))
    near = pairs.select(F.explode(sides).alias("s")).groupBy("s.word").agg(F.count("*").alias("n_near"), F.min("s.near").alias("best"))
    best = words.join(near.hint("merge"), "word", "left")
    ok = -F.col("best.less") >= 2 * F.col("n")
    best = best.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(ok, F.col("best.other")).alias("form"), F.when(ok, -F.col("best.less")).alias("form_n"))
    best = materialize(best, "forms")
    ends = roots(best.where("form is not null"))
    out = best.join(ends.hint("merge"), "word", "left")
    return out.select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
