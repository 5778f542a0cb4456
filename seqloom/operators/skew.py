"""Joins in which a few keys may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import materialize

#: A key is hot if it holds more than this fraction of the rows: fewer than SHARE keys can.
SHARE = 2000
#: A key with fewer rows is never hot: its rows are not worth 64 copies of the other side's row.
LEAST = 100
SALTS = 64


def join_hot(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` on ``key``, a sort-merge join whose tasks stay even.

    ``right`` has each key at most once.  The rows of hot keys of ``left`` are
    dealt over ``SALTS`` tasks, and their rows of ``right`` are copied to each
    of these.  The list of hot keys has fewer than ``SHARE`` rows whatever the
    data, so it is broadcast.  Null keys match nothing; with ``how`` = "left"
    their rows are dealt evenly.  ``left`` should be a written table, as it is
    read once more to count its keys.
    """
    total = left.count()
    hot = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_rows")).where((F.col("_rows") * SHARE > total) & (F.col("_rows") >= LEAST))
    hot = F.broadcast(materialize(hot.select(key, F.lit(True).alias("_hot")), "hot_keys"))
    own = F.pmod(F.xxhash64(*left.columns), F.lit(SALTS)).cast("int")
    dealt = left.join(hot, key, "left").withColumn("_salt", F.when(F.col("_hot") | F.col(key).isNull(), own).otherwise(0)).drop("_hot")
    copied = right.join(hot, key, "left").withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop("_hot")
    return dealt.join(copied.hint("merge"), [key, "_salt"], how).drop("_salt")
