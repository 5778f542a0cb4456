"""Queries that write the driver's tables with a sink and read them back with a source.

Files lie in the shared folder.  Tables are written in several part files;
texts whose lines must keep their order are written as one.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text
from .plans.scratch import forget_at_exit, shared_dir
from .queries import LETTERS, query, table
from .sources import delimited, records, sinks, versions


def _path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/seqloom-{uuid.uuid4().hex}/{name}"
    forget_at_exit(spark, path)
    return path


def _file(spark: SparkSession, lines: DataFrame, name: str, line_end: str = "\n") -> str:
    """``lines``: value, and place to sort by; one file."""
    path = _path(spark, name)
    lines.orderBy("place").select("value").coalesce(1).write.option("lineSep", line_end).text(path)
    return path


def _lines(df: DataFrame, place: str, *cells, sep: str = "\t") -> DataFrame:
    return df.select(F.col(place).cast("long").alias("place"), F.concat_ws(sep, *(F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c, F.lit("")) for c in cells)).alias("value"))


def _first(spark: SparkSession, value: str, place: int = -1) -> DataFrame:
    return spark.createDataFrame([(place, value)], "place long, value string")


@query("select c_custkey::varchar as c_custkey, c_name, coalesce(c_mktsegment, '') as c_mktsegment from customer")
def table_roundtrip(spark, d):
    path = _path(spark, "customer.tsv")
    sinks.write_table(table(spark, d, "customer").repartition(3), path, ["c_custkey", "c_name", "c_mktsegment"])
    header, rows = delimited.scan(spark, path)
    return delimited.named(header, rows).drop("_row")


@query("select doc_id::varchar as doc_id, row_number() over (order by doc_id) - 1 as place, md5(coalesce(text, '')) as text_md5, lang from documents where doc_id is not null")
def quoted_scan(spark, d):
    """Texts with line ends, quotes and delimiters in their cells, read back by byte ranges."""
    path = _path(spark, "documents.csv")
    docs = table(spark, d, "documents").where("doc_id is not null")
    docs = docs.repartitionByRange(max(3, docs.rdd.getNumPartitions()), "doc_id").sortWithinPartitions("doc_id")  # so many files as the input has parts
    sinks.write_table(docs, path, ["doc_id", "text", "lang"], ",")
    rows = delimited.named(*delimited.scan(spark, path, ","))
    return rows.select("doc_id", F.col("_row").alias("place"), F.md5("text").alias("text_md5"), "lang")


@query("select s_suppkey::varchar as id, s_name as first_name, s_nationkey::varchar as second_name, '' as extra, row_number() over (order by s_suppkey) - 1 as place from supplier")
def duplicate_headers(spark, d):
    lines = _lines(table(spark, d, "supplier"), "s_suppkey", "s_suppkey", "s_name", "s_nationkey")
    header, rows = delimited.scan(spark, _file(spark, _first(spark, "id\tname\tname\textra").unionByName(lines), "supplier.tsv", "\r\n"), "\t")
    return rows.select(delimited.nth(header, "id").alias("id"), delimited.nth(header, "name").alias("first_name"), delimited.nth(header, "name", 2).alias("second_name"), delimited.nth(header, "extra").alias("extra"), F.col("_row").alias("place"))


@query("select row_number() over (order by n_nationkey) - 1 as place, n_nationkey::varchar as id, n_name as name, '' as note from nation")
def validated_scan(spark, d):
    lines = _lines(table(spark, d, "nation"), "n_nationkey", "n_nationkey", "n_name", F.lit("unused"), sep=",")
    path = _file(spark, _first(spark, delimited.BOM + "ID,Name,Name").unionByName(lines), "nation.csv")
    header, rows = delimited.scan(spark, path, ",")
    kept = delimited.validated(delimited.named([h.lower() for h in header], rows), ["id", "name"], ["note"])
    return kept.select(F.col("_row").alias("place"), "id", "name", "note")


@query("select r_regionkey::varchar as id, r_name as name from region")
def section_scan(spark, d):
    body = _lines(table(spark, d, "region"), "r_regionkey", "r_regionkey", "r_name", sep=",")
    head = spark.createDataFrame([(-4, "Report,of,regions"), (-3, "0,not yet,"), (-2, "[Data],,")], "place long, value string")
    header, rows = delimited.scan(spark, _file(spark, head.unionByName(body), "sections.csv"), ",")
    return delimited.after_marker(rows, "[Data]").select(F.col("c0").alias("id"), F.col("c1").alias("name"))


@query("select p_partkey::varchar as p_partkey, p_brand, case when p_size >= 25 then 'kept' else 'removed' end as side from part")
def split_output(spark, d):
    kept, removed = _path(spark, "kept.tsv"), _path(spark, "removed.tsv")
    sinks.write_split(table(spark, d, "part").repartition(3), F.col("p_size") >= 25, kept, removed, ["p_partkey", "p_brand"])
    read = lambda path, side: delimited.named(*delimited.scan(spark, path)).drop("_row").withColumn("side", F.lit(side))
    return read(kept, "kept").unionByName(read(removed, "removed"))


@query("select r_regionkey::varchar as r_regionkey, lower(r_name) as r_name from region")
def replaced_table(spark, d):
    path = _path(spark, "region.tsv")
    sinks.write_table(table(spark, d, "region").repartition(2), path, ["r_regionkey", "r_name"])
    old = delimited.named(*delimited.scan(spark, path))
    sinks.replace_table(old.withColumn("r_name", F.lower("r_name")), path, ["r_regionkey", "r_name"])
    return delimited.named(*delimited.scan(spark, path)).drop("_row")


@query("select p_partkey::varchar as p_partkey, p_brand, p_size::varchar as p_size, 'full' as form from part union all select p_partkey::varchar, p_brand, null, 'slim' from part")
def full_and_slim(spark, d):
    full, slim = _path(spark, "full.tsv"), _path(spark, "slim.tsv")
    sinks.write_full_and_slim(table(spark, d, "part").repartition(3), full, slim, ["p_partkey", "p_brand", "p_size"], ["p_partkey", "p_brand"])
    read = lambda path, form: delimited.named(*delimited.scan(spark, path)).drop("_row").withColumn("form", F.lit(form))
    return read(full, "full").unionByName(read(slim, "slim"), allowMissingColumns=True)


@query(f"select doc_id || '|' || lang as header, md5({LETTERS}) as sequence_md5, length({LETTERS}) as n from documents where {LETTERS} <> ''")
def fasta_roundtrip(spark, d):
    path = _path(spark, "documents.fasta")
    docs = table(spark, d, "documents").withColumn("sequence", text.letters("text"))
    sinks.write_fasta(docs, path, sinks.header_from("{doc_id}|{lang}", docs.columns), F.col("sequence"), ["lang", "sequence"])
    read = records.fasta(spark, path)
    return read.select("header", F.md5("sequence").alias("sequence_md5"), F.length("sequence").cast("long").alias("n"))


@query(f"select sum(1 + ceil(length({LETTERS}) / 60.0))::bigint as n_lines, greatest(max(least(length({LETTERS}), 60)), max(length('>' || doc_id)))::bigint as longest from documents where {LETTERS} <> ''")
def fasta_wrapping(spark, d):
    path = _path(spark, "wrapped.fasta")
    docs = table(spark, d, "documents").withColumn("sequence", text.letters("text"))
    sinks.write_fasta(docs, path, sinks.header_from("{doc_id}", docs.columns), F.col("sequence"))
    return spark.read.text(versions.current(spark, path)).agg(F.count("*").alias("n_lines"), F.max(F.length("value")).cast("long").alias("longest"))


def _fasta(spark, d):
    s = table(spark, d, "supplier")
    value = F.concat(F.lit(">key"), "s_nationkey", F.lit("|"), F.regexp_replace("s_name", r"#\d+$", "#"), F.lit(" [protein_id=P"), "s_suppkey", F.lit("]\n"), F.lit("MK"), F.translate(F.col("s_suppkey").cast("string"), "0123456789", "ACDEFGHIKL"))
    return records.fasta(spark, _file(spark, s.select(F.col("s_suppkey").alias("place"), value.alias("value")), "supplier.fasta"))


_FASTA = "with s as (select s_suppkey, 'key' || s_nationkey as field, regexp_replace(s_name, '#[0-9]+$', '#') as name, 'MK' || translate(s_suppkey::varchar, '0123456789', 'ACDEFGHIKL') as sequence from supplier) "


@query(_FASTA + "select split_part(field || '|' || name, ' ', 1) as key, max_by(sequence, s_suppkey) as sequence from s group by 1")
def fasta_last_wins(spark, d):
    return records.fasta_by_key(_fasta(spark, d))


@query(_FASTA + "select field || '|' || name || ' [protein_id=P' || s_suppkey || ']' as header, sequence from s order by s_suppkey limit 1")
def fasta_first_record(spark, d):
    return records.fasta_first(_fasta(spark, d)).select("header", "sequence")


@query(_FASTA + "select field as a, name || ' [protein_id=P' || s_suppkey || ']' as b, '' as c, '' as d, sequence from s")
def fasta_header_fields(spark, d):
    return records.fasta_fields(_fasta(spark, d), ["a", "b", "c", "d"]).drop("_row")


@query(_FASTA + "select 'P' || s_suppkey as protein_id, sequence from s")
def coding_sequences(spark, d):
    return records.coding_sequences(_fasta(spark, d)).drop("_row")


@query("select 'a' || l_partkey as query, 'b' || l_suppkey as target, l_linenumber::double as pct_id, l_orderkey::double as evalue, l_quantity as bits from lineitem where l_linenumber <> 3")
def pair_scan(spark, d):
    l = table(spark, d, "lineitem")  # noqa: E741
    bad = F.when(F.col("l_linenumber") == 3, "n/a").otherwise(F.col("l_orderkey").cast("string"))
    path = _path(spark, "pairs.tsv")
    _lines(l, "l_orderkey", F.concat(F.lit("a"), "l_partkey"), F.concat(F.lit("b"), "l_suppkey"), "l_linenumber", bad, "l_quantity").select("value").write.text(path)
    return delimited.pairs(spark, path).drop("ord")


@query("select l_partkey as q, l_suppkey as s, l_linenumber::double as pct_id, 0.5::double as qcov, 0.25::double as scov, l_quantity as bits from lineitem where l_partkey <> l_suppkey and l_linenumber <> 3")
def edge_scan(spark, d):
    l = table(spark, d, "lineitem")  # noqa: E741
    bits = F.when(F.col("l_linenumber") == 3, "?").otherwise(F.col("l_quantity").cast("string"))
    path = _path(spark, "edges.tsv")
    _lines(l, "l_orderkey", F.concat(F.lit("n"), "l_partkey"), F.concat(F.lit("n"), "l_suppkey"), "l_linenumber", F.lit("0.5"), F.lit("0.25"), bits).select("value").write.text(path)
    return delimited.edges(spark, path).drop("ord")


@query("select 'S' as record, s_suppkey::varchar as cluster, null::double as pct_id, s_name as label, null as centroid from supplier union all select 'H', c_nationkey::varchar, (90 + c_custkey % 10)::double, c_name, 'c' || c_nationkey from customer")
def cluster_file(spark, d):
    star = [F.lit("*")] * 4
    s = _lines(table(spark, d, "supplier"), "s_suppkey", F.lit("S"), "s_suppkey", F.lit("100"), F.lit("*"), *star, "s_name", F.lit("*"))
    h = _lines(table(spark, d, "customer"), "c_custkey", F.lit("H"), "c_nationkey", F.lit("100"), F.lit(90) + F.col("c_custkey") % 10, *star, "c_name", F.concat(F.lit("c"), "c_nationkey"))
    short = _first(spark, "C\t1\t2")
    path = _path(spark, "clusters.uc")
    s.unionByName(h).unionByName(short).select("value").write.text(path)
    centroids, hits = delimited.cluster_records(spark, path)
    return centroids.select(F.lit("S").alias("record"), "cluster", F.lit(None).cast("double").alias("pct_id"), "label", F.lit(None).cast("string").alias("centroid")).unionByName(hits.withColumn("record", F.lit("H")))


@query("select 't' || p_partkey as target, 'q' || (p_partkey % 7) as query, 300.0::double as query_length, p_size::double as score, 1.0::double as hmm_from, (p_size + 1)::double as hmm_to from part")
def domain_table(spark, d):
    p = table(spark, d, "part")
    cells = [F.concat(F.lit("t"), "p_partkey"), F.lit("-"), F.lit("90"), F.concat(F.lit("q"), (F.col("p_partkey") % 7).cast("string")), F.lit("-"), F.lit("300"), *[F.lit("0")] * 7, F.col("p_size").cast("string"), F.lit("0.1"), F.lit("1"), (F.col("p_size") + 1).cast("string"), *[F.lit("9")] * 6]
    path = _path(spark, "domains.txt")
    _lines(p, "p_partkey", *cells, sep="  ").unionByName(_first(spark, "# target name  accession")).select("value").write.text(path)
    return delimited.domain_hits(spark, path)


_RESIDUES = "ACDEFGHIKLMNPQRSTVWY"


@query(f"with c as (select p_partkey as pos, i, case when (p_partkey + i) % 9 = 0 then 0 else exp(-((p_partkey * 7 + i * 13) % 50) / 10.0) end as raw from part, (select unnest(range(0, 20)) as i)) select pos::int as pos, substr('{_RESIDUES}', i::int + 1, 1) as residue, round(raw / sum(raw) over (partition by pos), 9) as p from c")
def profile_file(spark, d):
    score = lambda i: F.when((F.col("p_partkey") + i) % 9 == 0, "*").otherwise((((F.col("p_partkey") * 7 + i * 13) % 50) / 10.0).cast("string"))
    path = _path(spark, "profile.hmm")
    lines = _lines(table(spark, d, "part"), "p_partkey", "p_partkey", *(score(i) for i in range(20)), sep="  ")
    lines.unionByName(_first(spark, "HMMER3/f")).select("value").write.text(path)
    return records.profile(spark, path).select("pos", "residue", F.round("p", 9).alias("p"))


@query("select count(*) as n, count(distinct lang) as langs, max(n_chars) as longest from documents")
def json_report(spark, d):
    path = _path(spark, "report.json")
    sinks.write_json(table(spark, d, "documents").agg(F.count("*").alias("n"), F.count_distinct("lang").alias("langs"), F.max("n_chars").alias("longest")).coalesce(1), path)
    return records.json_sidecar(spark, path, "n long, langs long, longest long").select("doc.*").where("n is not null")


@query("""with p as (select o_orderkey, '{"b": 1, "a": ' || o_orderkey || '} [2]' || case when o_orderkey % 2 = 0 then ' {"c"' else '  null' end as document from orders) select document, 0 as place, '{"a": ' || o_orderkey || ', "b": 1}' as json from p union all select document, 1, '[2]' from p union all select document, 2, 'null' from p where o_orderkey % 2 = 1""")
def concatenated_json(spark, d):
    end = F.when(F.col("o_orderkey") % 2 == 0, ' {"c"').otherwise("  null")
    docs = table(spark, d, "orders").select(F.concat(F.lit('{"b": 1, "a": '), "o_orderkey", F.lit("} [2]"), end).alias("document"))
    return records.concatenated_json(docs, "document")


@query("select id, n_nationkey::varchar as taxid, n_name as name, 'species' as rank, 'g' || n_regionkey as genus, n_nationkey::varchar as species from nation, unnest([n_nationkey::varchar, 'old' || n_nationkey]) t(id)")
def taxonomy_records(spark, d):
    xml = F.concat(F.lit("<Taxon><TaxId>"), "n_nationkey", F.lit("</TaxId><ScientificName>"), "n_name", F.lit("</ScientificName><Rank>species</Rank><AkaTaxIds><TaxId>old"), "n_nationkey", F.lit("</TaxId></AkaTaxIds><LineageEx><Taxon><TaxId>g"), "n_regionkey", F.lit("</TaxId><Rank>genus</Rank></Taxon></LineageEx></Taxon>"))
    t = records.taxonomy(table(spark, d, "nation").select(xml.alias("xml")), "xml")
    return t.select("id", "taxid", "name", "rank", t["ranks"]["genus"].alias("genus"), t["ranks"]["species"].alias("species"))


@query("select 'f' || n_nationkey as path, place::int as place, case place when 0 then n_name when 1 then 'a &amp; b' else 'region ' || n_regionkey end as text from nation, (select unnest([0, 1, 2]) as place) where n_nationkey % 5 <> 0")
def office_text(spark, d):
    def zipped(batches):
        import io
        import zipfile

        for batch in batches:
            out = []
            for key, name, region in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                held = io.BytesIO()
                with zipfile.ZipFile(held, "w") as z:
                    if key % 2:
                        z.writestr("xl/sharedStrings.xml", f"<sst><si><t>{name}</t></si><si><t xml:space='preserve'>a &amp; b</t></si><si><t>region {region}</t></si></sst>")
                    else:
                        z.writestr("word/document.xml", f"<w:p><w:r><w:t>{name}</w:t><w:t>a &amp; b</w:t><w:t>region {region}</w:t></w:r></w:p>")
                out.append((f"f{key}", held.getvalue() if key % 5 else b"no archive"))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.binary())], ["path", "content"])

    files = table(spark, d, "nation").select(F.col("n_nationkey").cast("long"), "n_name", F.col("n_regionkey").cast("long")).mapInArrow(zipped, "path string, content binary")
    return records.office_strings(files)


@query("select page_id, case when page_id % 3 = 0 then '' else 'si' || (page_id % 4) || '.pdf' || case when page_id % 4 = 1 then '' else ';si1.pdf' end end as files from pages")
def media_links(spark, d):
    media = lambda n: F.concat(F.lit('<media id="m" xlink:href="si'), n, F.lit('.pdf"/>'))
    xml = F.when(F.col("page_id") % 3 != 0, F.concat(media((F.col("page_id") % 4).cast("string")), media(F.lit("1")), media(F.lit("1"))))
    return table(spark, d, "pages").withColumn("xml", xml).select("page_id", F.array_join(records.linked_media("xml"), ";").alias("files"))


@query("select 0 as place, '| r_regionkey | r_name |' as line union all select 1, '|---|---|' union all select row_number() over (order by r_regionkey) + 1, '| ' || r_regionkey || ' | ' || r_name || ' |' from region")
def markdown_report(spark, d):
    report = sinks.markdown(table(spark, d, "region").select("r_regionkey", "r_name").orderBy("r_regionkey"))
    return spark.createDataFrame(list(enumerate(report.splitlines())), "place long, line string")


@query(f"select 'rows' as what, count(*) as n from customer union all select 'records', count(*) from documents where {LETTERS} <> '' union all select 'missing', null")
def file_summary(spark, d):
    rows, fasta = _path(spark, "rows.tsv"), _path(spark, "records.fasta")
    sinks.write_table(table(spark, d, "customer").repartition(2), rows, ["c_custkey"])
    docs = table(spark, d, "documents").withColumn("sequence", text.letters("text"))
    sinks.write_fasta(docs, fasta, F.col("doc_id").cast("string"), F.col("sequence"))
    found = [("rows", delimited.count_rows(spark, rows)), ("records", records.count_records(spark, fasta)), ("missing", delimited.count_rows(spark, _path(spark, "nothing.tsv")))]
    return spark.createDataFrame(found, "what string, n long")
