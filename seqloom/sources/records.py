"""FASTA, JSON, XML, profile and office files as tables."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import stripped
from .versions import current


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(_row, header, sequence): one row for each record."""
    rows = spark.read.option("lineSep", ">").text(current(spark, path)).withColumn("_row", F.monotonically_increasing_id())
    parts = F.split(F.regexp_replace("value", "\r", ""), "\n", 2)
    return rows.where(stripped("value") != "").select("_row", stripped(F.get(parts, 0)).alias("header"), F.regexp_replace(F.coalesce(F.get(parts, 1), F.lit("")), r"\s+", "").alias("sequence"))


def count_records(spark: SparkSession, path: str) -> int | None:
    """The number of records of a FASTA file, null if there is none."""
    from .delimited import exists

    return spark.read.text(current(spark, path)).where(F.startswith("value", F.lit(">"))).count() if exists(spark, path) else None


def fasta_by_key(records: DataFrame) -> DataFrame:
    """(key, sequence): the header's first token; of equal keys the last record counts."""
    keyed = records.withColumn("key", F.split_part("header", F.lit(" "), F.lit(1)))
    return keyed.groupBy("key").agg(F.max_by("sequence", "_row").alias("sequence"))


def fasta_first(records: DataFrame) -> DataFrame:
    return records.orderBy("_row").limit(1)


def fasta_fields(records: DataFrame, names: list[str]) -> DataFrame:
    """Headers cut at bars into the named columns; missing ones are blank."""
    parts = F.split("header", r"\|", len(names))
    return records.select("_row", *(F.coalesce(F.get(parts, i), F.lit("")).alias(n) for i, n in enumerate(names)), "sequence")


def coding_sequences(records: DataFrame) -> DataFrame:
    """(protein_id, sequence) of headers with [protein_id=...]."""
    found = records.withColumn("protein_id", F.regexp_extract("header", r"\[protein_id=([^\]]+)\]", 1))
    return found.where("protein_id <> ''").select("_row", "protein_id", "sequence")


def json_sidecar(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row, with null fields where the document is malformed."""
    return spark.read.option("wholetext", True).text(current(spark, path)).select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("doc"))


def _decode(text: str) -> Iterator[str]:
    decoder, at = json.JSONDecoder(), 0
    while at < len(text):
        while at < len(text) and text[at].isspace():
            at += 1
        if at >= len(text):
            return
        try:
            value, at = decoder.raw_decode(text, at)
        except ValueError:
            return
        yield json.dumps(value, sort_keys=True)


def concatenated_json(df: DataFrame, column: str) -> DataFrame:
    """(document, place, json) of texts that hold JSON values one after the other; reading stops at a fault."""

    def split(batches):
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = list(_decode(text or ""))
                yield pa.RecordBatch.from_arrays([pa.array([text] * len(found), pa.string()), pa.array(range(len(found)), pa.int32()), pa.array(found, pa.string())], ["document", "place", "json"])

    return df.select(F.col(column).cast("string")).mapInArrow(split, "document string, place int, json string")


def taxonomy(xml: DataFrame, column: str) -> DataFrame:
    """(id, taxid, name, rank, ranks) of taxonomy XML; each older id is a row of its own that names the current record."""
    schema = "TaxId string, ScientificName string, Rank string, AkaTaxIds struct<TaxId array<string>>, LineageEx struct<Taxon array<struct<TaxId string, Rank string>>>"
    taxon = xml.select(F.from_xml(F.col(column), schema, {"rowTag": "Taxon"}).alias("t"))
    ranks = F.map_from_entries(F.transform(F.array_distinct(F.concat(F.coalesce(F.col("t.LineageEx.Taxon"), F.array().cast("array<struct<TaxId:string,Rank:string>>")), F.array(F.struct(F.col("t.TaxId").alias("TaxId"), F.col("t.Rank").alias("Rank"))))), lambda x: F.struct(x["Rank"], x["TaxId"])))
    ids = F.array_distinct(F.concat(F.array("t.TaxId"), F.coalesce(F.col("t.AkaTaxIds.TaxId"), F.array().cast("array<string>"))))
    return taxon.select(F.explode(ids).alias("id"), F.col("t.TaxId").alias("taxid"), F.col("t.ScientificName").alias("name"), F.col("t.Rank").alias("rank"), ranks.alias("ranks"))


def profile(spark: SparkSession, path: str, residues: str = "ACDEFGHIKLMNPQRSTVWY") -> DataFrame:
    """(pos, residue, p): emission probabilities of a profile's match states; '*' counts as 0, rows are renormalised."""
    lines = spark.read.text(current(spark, path)).select(F.split(F.trim("value"), r"\s+").alias("v"))
    states = lines.where(F.get("v", 0).rlike(r"^\d+$") & (F.size("v") > len(residues)))
    cells = states.select(F.get("v", 0).cast("int").alias("pos"), F.posexplode(F.slice("v", 2, len(residues))).alias("i", "score"))
    raw = F.when(F.col("score") == "*", F.lit(0.0)).otherwise(F.exp(-F.expr("try_cast(score as double)")))
    p = cells.select("pos", F.get(F.array(*map(F.lit, residues)), F.col("i")).alias("residue"), raw.alias("p"))
    return p.withColumn("p", F.col("p") / F.sum("p").over(Window.partitionBy("pos")))


def column_heights(p: DataFrame, background: dict[str, float]) -> DataFrame:
    """Letter heights in bits: each column's information against a background, times the letter's share."""
    table = F.create_map(*(x for k, v in background.items() for x in (F.lit(k), F.lit(v))))
    bits = F.when(F.col("p") > 0, F.col("p") * F.log2(F.col("p") / table[F.col("residue")])).otherwise(0.0)
    info = F.greatest(F.sum(bits).over(Window.partitionBy("pos")), F.lit(0.0))
    return p.withColumn("info", info).withColumn("height", F.col("info") * F.col("p"))


def office_strings(files: DataFrame) -> DataFrame:
    """(path, place, text): the strings in zipped office documents (``files`` as read by binaryFile)."""

    def read(batches):
        import io
        import re
        import zipfile

        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found: list[str] = []
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        for name in sorted(z.namelist()):
                            if name.endswith("sharedStrings.xml") or name.endswith("document.xml"):
                                xml = z.read(name).decode("utf-8", "replace")
                                found += [re.sub(r"<[^>]+>", "", x) for x in re.findall(r"<(?:w:)?t(?: [^>]*)?>(.*?)</(?:w:)?t>", xml, re.S)]
                except zipfile.BadZipFile:
                    pass
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(found), pa.string()), pa.array(range(len(found)), pa.int32()), pa.array(found, pa.string())], ["path", "place", "text"])

    return files.select("path", "content").mapInArrow(read, "path string, place int, text string")


def linked_media(column: str):
    """Files that an article's XML links as media, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(column), F.lit("")), F.lit(r'<media[^>]*xlink:href="([^"]+)"'), 1))
