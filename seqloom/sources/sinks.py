"""Writers: delimited tables, FASTA, JSON and markdown.

Each writes a new version of its table (see ``versions``), in as many part
files as the frame has partitions; a delimited part begins with the header,
which ``delimited.scan`` knows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import wrapped
from .versions import publish


def write_table(df: DataFrame, path: str, columns: list[str], sep: str = "\t") -> None:
    """The named columns, in that order; blanks stay blanks.  The table's old version stays until this one is complete."""
    blank = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns]
    out = df.select(*blank).write.option("sep", sep).option("header", True).option("emptyValue", "").option("quote", '"').option("escape", '"')
    publish(df.sparkSession, path, out.csv)


def write_split(df: DataFrame, keep: Column, path: str, removed_path: str, columns: list[str]) -> None:
    """Kept rows in one table, all others in a second one, written even if it is empty."""
    held = F.coalesce(keep, F.lit(False))
    write_table(df.where(held), path, columns)
    write_table(df.where(~held), removed_path, columns)


def replace_table(df: DataFrame, path: str, columns: list[str]) -> None:
    """Replaces a table that ``df`` may itself be read from: what it reads stays as the backup."""
    write_table(df, path, columns)


def fasta_record(header: Column, sequence: Column, width: int | None = 60) -> Column:
    body = wrapped(sequence, width) if width else sequence
    return F.concat(F.lit(">"), header, F.lit("\n"), body)


def header_from(template: str, columns: list[str]) -> Column:
    """``{name}`` in a template replaced by the columns' values; unknown and null ones by nothing."""
    import re

    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*(F.lit(p) if i % 2 == 0 else F.coalesce(F.col(p).cast("string"), F.lit("")) if p in columns else F.lit("") for i, p in enumerate(parts)))


def write_fasta(df: DataFrame, path: str, header: Column, sequence: Column, order: list | None = None, width: int | None = 60) -> None:
    rows = df.where(sequence != "")
    rows = rows.orderBy(*order) if order else rows
    publish(df.sparkSession, path, rows.select(fasta_record(header, sequence, width).alias("value")).write.text)


def write_json(df: DataFrame, path: str) -> None:
    publish(df.sparkSession, path, df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.text)


def markdown(df: DataFrame, limit: int = 100) -> str:
    """A report table; ``limit`` is the number of lines that a report shows, and a last line tells if there are more."""
    rows = df.limit(limit + 1).collect()
    more = f"\nOnly the first {limit} rows are shown.\n" if len(rows) > limit else ""
    rows = rows[:limit]
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns) + "\n"
    return head + "".join("| " + " | ".join("" if x is None else str(x) for x in r) + " |\n" for r in rows) + more


def write_full_and_slim(df: DataFrame, path: str, slim_path: str, columns: list[str], slim_columns: list[str]) -> None:
    """A table and its short form, computed once."""
    from ..plans.scratch import materialize

    held = materialize(df, "full")
    write_table(held, path, columns)
    write_table(held, slim_path, slim_columns)
