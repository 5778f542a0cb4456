"""Queries for cleaning, flags, evidence, overlays and deliverable shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import accession, align, families, text
from .operators import cluster, compare, evidence, graph, relate, rules, shape, variants
from .plans import steps
from .queries import CODES, COMPONENTS, LETTERS, PRIOR, _codes, _components, _links, _pairs, _two, query, table
from .sources.delimited import numbered

CELL = "case when trim({0}) in ('', '-') then '' else trim({0}) end"


# --- text ------------------------------------------------------------------------------------------------------------

_RAW = "case p_partkey % 5 when 0 then ' - ' when 1 then '  ' || p_name || ' ' when 2 then '' when 3 then null else p_name end"


@query(f"""with p as (select p_partkey, {_RAW} as raw, p_brand, case p_partkey % 4 when 0 then p_partkey || '.0' when 1 then ' ' || p_partkey when 2 then 'x' || p_partkey else null end as tax, case p_partkey % 3 when 0 then 'MKLEHHHHHH' when 1 then 'MKHHHHH*' else 'MKHHHH' end as tagged, case when p_partkey % 2 = 0 then ' ; zeta;beta ' else ' ; ' end as listed from part),
c as (select *, {CELL.format("coalesce(raw, '')")} as cell from p)
select p_partkey, cell, coalesce(nullif(regexp_replace(trim(coalesce(raw, '')), '\\s+', '_', 'g'), ''), 'noacc') as token, case when cell <> '' then cell else p_brand end as filled, case when cell <> '' then cell when p_partkey % 2 = 0 then 'beta' else 'pazy:' || p_partkey end as representative,
 case p_partkey % 4 when 0 then p_partkey::varchar when 1 then p_partkey::varchar else '' end as taxid, case p_partkey % 3 when 2 then 'MKHHHH' else 'MK' end as untagged, case when p_partkey > 100 then '+' || (p_partkey - 100) else (p_partkey - 100)::varchar end as delta from c""")
def cell_cleaning(spark, d):
    p = table(spark, d, "part").selectExpr(
        "p_partkey", f"{_RAW} as raw", "p_brand", "case p_partkey % 4 when 0 then p_partkey || '.0' when 1 then ' ' || p_partkey when 2 then 'x' || p_partkey end as tax", "case p_partkey % 3 when 0 then 'MKLEHHHHHH' when 1 then 'MKHHHHH*' else 'MKHHHH' end as tagged", "case when p_partkey % 2 = 0 then ' ; zeta;beta ' else ' ; ' end as listed", "p_partkey - 100 as delta"
    )
    return p.select("p_partkey", text.cell("raw").alias("cell"), text.label_token("raw").alias("token"), text.first_filled("raw", "p_brand").alias("filled"), text.representative(["raw"], "listed", "p_partkey").alias("representative"), text.taxon_id("tax").alias("taxid"), text.without_tag("tagged").alias("untagged"), text.signed("delta").alias("delta"))


_IDS = "case c_custkey % 4 when 0 then '5xfy_A' when 1 then '7NEI' when 2 then '5xfyb' else 'WP_1' end"
_HEADERS = "case c_custkey % 3 when 0 then 'pdb|5XFY|A some text' when 1 then 'WP_' || c_custkey || '.1 rest' else ' sp|Q9X|NAME x' end"


@query(f"""select c_custkey, case c_custkey % 4 when 0 then '5XFY' when 1 then '7NEI' when 2 then '5XFY' else '' end as entry, case c_custkey % 4 when 0 then 'A' when 2 then 'b' else '' end as chain,
 case c_custkey % 3 when 0 then 'pdb|5XFY|A;5XFY;5XFY_A' when 1 then 'WP_' || c_custkey || '.1;WP_' || c_custkey else 'sp|Q9X|NAME;Q9X' end as keys from customer""")
def structure_ids(spark, d):
    c = table(spark, d, "customer").selectExpr("c_custkey", f"{_IDS} as sid", f"{_HEADERS} as header")
    parts = text.structure_parts("sid")
    return c.select("c_custkey", parts["entry"].alias("entry"), parts["chain"].alias("chain"), F.array_join(text.header_keys("header"), ";").alias("keys"))


@query("select page_id, '10.1/a' || page_id || '|10.2/b|10.3/c' as dois, 3 as n, case when page_id % 2 = 0 then '10.1/a' || page_id else null end as shared from pages")
def doi_lists(spark, d):
    cell = F.concat(F.lit("https://doi.org/10.1/A"), F.col("page_id").cast("string"), F.lit("; doi: 10.2/b. 10.3/C, nothing"))
    p = table(spark, d, "pages").select("page_id", text.dois(cell).alias("dois"))
    other = F.when(F.col("page_id") % 2 == 0, F.array(F.concat(F.lit("10.1/a"), "page_id"), F.lit("10.9/z"))).otherwise(F.array(F.lit("10.9/z")))
    return p.select("page_id", F.array_join("dois", "|").alias("dois"), F.size("dois").alias("n"), F.get(relate.overlap(F.col("dois"), other), F.lit(0)).alias("shared"))


@query("""select o_orderkey, case o_orderkey % 5 when 0 then 'pdf' when 1 then 'zip' when 2 then 'ole' when 3 then 'markup' else 'other' end as kind, o_orderkey % 3 = 0 as sequence, case when o_orderkey % 2 = 0 then o_orderkey::varchar else '' end as e_value, o_orderkey % 4 in (0, 2) as refseq from orders""")
def text_marks(spark, d):
    o = table(spark, d, "orders")
    head = F.element_at(F.array(*map(F.lit, ("%PDF-1.7", "PK\x03\x04..", None, "<html>", "plain"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    content = F.when(F.col("o_orderkey") % 5 == 2, F.unhex(F.lit("D0CF11E0A1B1"))).otherwise(F.encode(head, "ISO-8859-1"))
    sequence = F.when(F.col("o_orderkey") % 3 == 0, F.repeat(F.lit("MKtl "), 10)).when(F.col("o_orderkey") % 3 == 1, "MKTL").otherwise(F.repeat(F.lit("MK1"), 20))
    block = F.concat(F.lit("lambda = 0.2\n  "), F.when(F.col("o_orderkey") % 2 == 0, "E-value").otherwise("other"), F.lit("  = "), F.col("o_orderkey").cast("string"), F.lit(" x\n"))
    acc = F.when(F.col("o_orderkey") % 4 == 0, "WP_000000001.1").otherwise("Q9X1A1")
    source = F.when(F.col("o_orderkey") % 4 == 2, "RefSeq (curated)").otherwise(F.lit(None))
    return o.select("o_orderkey", text.file_kind(content).alias("kind"), text.looks_like_sequence(sequence).alias("sequence"), text.key_value(block, "E-value").alias("e_value"), accession.is_refseq(acc, source).alias("refseq"))


@query("""select doc_id, 'WP_000000001;ABC12345;MGYP000000001;Q9X1A1;NP_' || lpad((100000 + doc_id)::varchar, 6, '0') as accessions, repeat('MKTLACDE', 6) as sequences from documents""")
def free_text(spark, d):
    found = F.concat(F.lit("see WP_000000001.2, ABC12345.1 (PMC1234567) and MGYP000000001; Q9X1A1 / ABC12345 or NP_"), F.lpad((F.col("doc_id") + 100000).cast("string"), 6, "0"))
    fasta = F.concat(F.lit("short\r\n>a\n"), F.repeat(F.lit("MKTL ACDE\n"), 6), F.lit(">b\nMKTL\n"))
    return table(spark, d, "documents").select("doc_id", F.array_join(text.free_accessions(found), ";").alias("accessions"), F.array_join(text.free_sequences(fasta), ";").alias("sequences"))


@query("select p_partkey, round(p_retailprice * power(2.0, p_size) / (p_size * 1000.0), 6) as prefactor, p_size >= 20 and p_partkey % 100 >= 50 as near from part")
def implied_prefactor(spark, d):
    p = table(spark, d, "part")
    k = align.implied_prefactor(F.col("p_retailprice"), F.col("p_size"), F.col("p_size"), F.lit(1000.0))
    return p.select("p_partkey", F.round(k, 6).alias("prefactor"), evidence.near_identity(F.col("p_size"), F.col("p_partkey") % 100, 20, 50).alias("near"))


_NAMES = ["PpCutA", "EstB", "LCC", "PE-H", "BTA-1", "lipase B", "PET6", "laccase-like hydrolase", "hydrolase", "Thc_Cut2", "unknown", "poly(ethylene terephthalate) hydrolase", "test", None]
_NAMED = ["cutinase", "esterase", "cutinase", "pet_hydrolase", "pet_hydrolase", "lipase", "pet_hydrolase", "laccase", "hydrolase", "cutinase", "", "pet_hydrolase", "", ""]


@query(f"select p_partkey, {[x for x in _NAMED]!r}[(p_partkey % {len(_NAMES)})::int + 1] as families from part")
def code_hints(spark, d):
    name = F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("p_partkey") % len(_NAMES) + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", F.concat_ws(";", families.families_of_name(name)).alias("families"))


# --- flags -----------------------------------------------------------------------------------------------------------


@query("""select o_orderkey,
 case when o_orderkey % 2 = 0 then 'skipped_tier0' when o_orderkey % 3 = 0 then 'concordant' when o_orderkey % 5 = 0 then 'family_conflict' when o_orderkey % 7 = 0 then 'related_family' when o_orderkey % 11 = 0 then 'generic_title' when o_orderkey % 13 = 0 then 'uninformative_title' when o_orderkey % 17 = 0 and o_orderkey % 19 <> 0 then 'title_unmapped' when o_orderkey % 19 = 0 then 'name_uninformative' else 'indeterminate' end as name_flag,
 case when o_orderkey % 2 = 0 then 'skipped_tier0' when o_orderkey % 3 = 0 then 'not_linkable' when o_orderkey % 5 = 0 then 'elink_failed' when o_orderkey % 7 > 3 then 'doi_match' when o_orderkey % 11 = 0 then 'unlinked' else 'no_doi_overlap' end as paper_flag,
 case o_orderkey % 7 when 0 then 'seq_in_supp' when 1 then 'acc_in_supp' when 2 then 'acc_in_maintext' else case when o_orderkey % 2 = 0 then 'no_sequence' when o_orderkey % 3 = 0 then 'supp_no_match' else 'supp_unavailable' end end as seq_flag,
 case o_orderkey % 4 when 0 then 'confirmed' when 1 then 'needs_cds' else 'unconfirmed' end as verdict from orders""")
def label_tables(spark, d):
    k = F.col("o_orderkey")
    by = lambda n: k % n == 0
    agreement = F.when(by(3), "match").when(by(5), "conflict").when(by(7), "related").when(by(11), "generic").otherwise("unknown")
    match = F.when(k % 7 == 0, "sequence").when(k % 7 == 1, "accession").when(k % 7 == 2, "accession_maintext").otherwise("none")
    return table(spark, d, "orders").select(
        "o_orderkey",
        rules.name_label(~by(2), agreement, by(13), by(17), ~by(19)).alias("name_flag"),
        rules.paper_label(~by(2), F.when(by(3), "0").otherwise("77"), by(5), k % 11, F.greatest(k % 7 - 3, F.lit(0))).alias("paper_flag"),
        rules.sequence_label(match, ~by(2), by(3)).alias("seq_flag"),
        rules.override(F.lit("unconfirmed"), F.when(by(4), "correct").when(k % 4 == 1, "verify_cds").otherwise("note"), {"correct": "confirmed", "verify_cds": "needs_cds"}).alias("verdict"),
    )


@query("""select o_orderkey, case when k < 4 then true else false end as resolves, k in (0, 1) as is_protein, k in (0, 2, 3) and not (k = 0 and o_orderkey % 3 = 0) as is_current, k = 0 and o_orderkey % 3 <> 0 as passed,
 case when k in (2, 3) then 'nucleotide record (dna/' || case when k = 3 then 'genomic' else '?' end || '), not a protein' when k = 4 then 'MGnify identifier; not an NCBI record (resolve via MGnify API)' when k = 5 then 'UniProt/TrEMBL identifier absent from NCBI protein (resolve via UniProt API)' when k = 6 then 'not found in NCBI protein or nuccore' when k = 1 and o_orderkey % 2 = 0 then 'NCBI record is suppressed' when k = 1 then 'NCBI record is dead' else '' end as note from (select o_orderkey, o_orderkey % 7 as k from orders)""")
def resolution_notes(spark, d):
    k = F.col("o_orderkey") % 7
    kind = F.when(k == 4, "mgnify").when(k == 5, "uniprot").otherwise("refseq")
    status = F.when(k == 1, F.when(F.col("o_orderkey") % 2 == 0, "suppressed").otherwise("dead")).otherwise("")
    replaced = F.when((k == 0) & (F.col("o_orderkey") % 3 == 0), "WP_2").otherwise(F.lit(None))
    protein = F.when(k < 2, F.struct(status.alias("status"), replaced.alias("replaced_by"), F.lit("AA").alias("moltype"), F.lit("").alias("biomol")))
    nucleotide = F.when(k.isin(2, 3), F.struct(F.lit("dna").alias("moltype"), F.when(k == 3, "genomic").alias("biomol")))
    return table(spark, d, "orders").select("o_orderkey", shape.resolution(kind, protein, nucleotide).alias("r")).select("o_orderkey", "r.*")


@query("""select o_orderkey, case when o_orderkey % 3 = 0 then 'obsolete_no_ipg' when o_orderkey % 3 = 1 and o_orderkey % 5 = 0 then 'title_unmapped' else 'organism_mismatch' end as target from orders where (o_orderkey % 3 = 0 and o_orderkey % 4 <> 0) or (o_orderkey % 3 = 1 and (o_orderkey % 5 = 0 or o_orderkey % 7 = 0))""")
def remap_targets(spark, d):
    k = F.col("o_orderkey")
    flags = {"kind": F.lit("refseq"), "resolves": F.lit(True), "is_protein": F.lit(True), "is_current": k % 3 != 0, "name_flag": F.when(k % 3 == 2, "concordant").when(k % 5 == 0, "title_unmapped").otherwise("indeterminate"), "paper_flag": F.lit("unlinked"), "seq_flag": F.lit("no_sequence"), "org_flag": F.when((k % 7 == 0) & (k % 3 == 1), "mismatch").otherwise("exact")}
    return shape.remap_targets(table(spark, d, "orders"), flags, F.when(k % 4 == 0, "WP_1").otherwise("")).select("o_orderkey", "target")


@query("select c_custkey, case when c_custkey % 3 = 0 then 'https://pubs.acs.org/doi/suppl/10.1021/X' || c_custkey || '/suppl_file/a.pdf' when c_custkey % 3 = 1 then 'https://host/' || c_custkey || '.pdf' end as url from customer")
def supplement_urls(spark, d):
    k = F.col("c_custkey")
    doi = F.when(k % 3 == 0, F.concat(F.lit("10.1021/X"), k.cast("string"))).otherwise("10.1038/y")
    name = F.when(k % 3 == 1, F.concat(F.lit("https://host/"), k.cast("string"), F.lit(".pdf"))).otherwise("a.pdf")
    return table(spark, d, "customer").select("c_custkey", shape.supplement_url(doi, name).alias("url"))


# --- evidence --------------------------------------------------------------------------------------------------------


@query("select c_custkey, (c_custkey % 2 = 0) and c_custkey % 3 <> 2 and c_custkey % 5 <> 0 as live from customer")
def live_records(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select("c_custkey", evidence.live_protein(F.when(k % 2 == 0, "AA ").otherwise("dna"), F.when(k % 3 == 0, "live").when(k % 3 == 1, F.lit(None)).otherwise("dead"), F.when(k % 5 == 0, "WP_9").otherwise(" ")).alias("live"))


@query("""with f as (select o_custkey, case when o_orderkey % 3 = 0 then 'main' else 'supplement' end as kind, case when o_orderkey % 5 = 0 then null else [o_orderpriority, o_orderstatus] end as acc from orders)
select o_custkey, coalesce((select string_agg(x, ';' order by x) from (select distinct unnest(acc) as x from f g where g.o_custkey = f.o_custkey)), '') as accessions, case when count_if(kind = 'supplement' and acc is not null) > 0 then 'parsed' when count_if(kind = 'main' and acc is not null) > 0 then 'main_text_only' else 'unavailable' end as status from f group by o_custkey""")
def supplement_status(spark, d):
    readable = F.col("o_orderkey") % 5 != 0
    files = table(spark, d, "orders").select("o_custkey", F.when(F.col("o_orderkey") % 3 == 0, "main").otherwise("supplement").alias("kind"), F.when(readable, F.array("o_orderpriority", "o_orderstatus")).alias("accessions"), F.when(readable, F.array(F.lit("MK"))).alias("sequences"))
    return evidence.supplement_index(files, "o_custkey").select("o_custkey", F.array_join("accessions", ";").alias("accessions"), "status")


@query(f"with k as (select doc_id, {LETTERS} as l, upper(repeat('stone', 12)) as a, upper(repeat('abcde', 20)) as b from documents) select doc_id, case doc_id % 4 when 0 then true when 1 then true when 2 then false else false end as known from k")
def known_sequences(spark, d):
    long, short = F.repeat(F.lit("ABCDE"), 20), F.repeat(F.lit("STONE"), 11)
    k = F.col("doc_id") % 4
    own = F.when(k == 0, short).when(k == 1, F.substring(long, 6, 80)).when(k == 2, F.substring(long, 6, 40)).otherwise("")
    return table(spark, d, "documents").select("doc_id", evidence.sequence_in(own, F.array(long, short)).alias("known"))


@query("select c_custkey, case when c_custkey % 5 = 0 then 'unavailable' when c_custkey % 5 = 4 then 'no_cds' when c_custkey % 3 = 0 then 'by_id' when c_custkey % 3 = 1 then 'by_sequence' else 'mismatch' end as cds_match from customer")
def coding_records(spark, d):
    k = F.col("c_custkey")
    record = F.when(k % 5 == 0, F.lit(None)).otherwise(F.concat(F.lit("r"), k.cast("string")))
    p = table(spark, d, "customer").select("c_custkey", record.alias("record"), F.concat(F.lit("p"), k.cast("string")).alias("protein_id"), F.concat(F.lit("S"), k.cast("string")).alias("sequence"))
    same, other = F.concat(F.lit("S"), k.cast("string")), F.concat(F.lit("X"), k.cast("string"))
    found = table(spark, d, "customer").where(~(k % 5).isin(0, 4))
    coding = found.select(F.concat(F.lit("r"), k.cast("string")).alias("record"), F.when(k % 3 == 1, "else").otherwise(F.concat(F.lit("p"), k.cast("string"))).alias("protein_id"), F.when(k % 3 == 2, other).otherwise(same).alias("sequence"))
    return evidence.coding_match(p, coding, "c_custkey")


@query("select s_suppkey as k, s_nationkey::varchar as a_value, c_nationkey::varchar as b_value from supplier join customer on s_suppkey = c_custkey where s_nationkey <> c_nationkey")
def cross_conflicts(spark, d):
    a = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").cast("string").alias("v"))
    b = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").cast("string").alias("v"))
    return evidence.conflicting(a, b, "k", "v")


@query("select user_id, string_agg(distinct event_id % 50, ';' order by event_id % 50) as targets from events where event_type = 'click' group by 1")
def linked_targets(spark, d):
    links = table(spark, d, "events").select("user_id", F.col("event_type").alias("link_name"), (F.col("event_id") % 50).alias("target"))
    return evidence.linked(links, "user_id", "target", "click").select("user_id", F.array_join(F.transform("targets", lambda x: x.cast("string")), ";").alias("targets"))


@query("with a as (select user_id, event_type, value > 50 as ok from events where value is not null) select user_id, min_by(event_type, list_position(['purchase', 'click', 'view', 'signup', 'error', 'login', 'logout'], event_type)) as route from a where ok and list_position(['purchase', 'click', 'view', 'signup', 'error', 'login', 'logout'], event_type) is not null group by 1")
def best_route(spark, d):
    order = ["purchase", "click", "view", "signup", "error", "login", "logout"]
    a = table(spark, d, "events").select("user_id", F.col("event_type").alias("route"), (F.col("value") > 50).alias("ok")).where(F.col("route").isin(*order))
    return evidence.best_attempt(a, "user_id", order)


@query("select p_partkey, 'smith;' || lower(split_part(p_name, ' ', 1)) as surnames, '10.1/x' || p_partkey as doi, '2021' as year from part")
def paper_records(spark, d):
    authors = F.array(F.lit("Smith J"), F.lit(" "), F.lit(None), F.col("p_name"), F.lit("SMITH K"))
    return table(spark, d, "part").select("p_partkey", F.array_join(evidence.surnames(authors), ";").alias("surnames"), text.doi(F.concat(F.lit("DOI: 10.1/X"), "p_partkey")).alias("doi"), evidence.year(F.lit("2021 Mar 3")).alias("year"))


@query("select o_custkey, min_by(o_orderkey, o_orderkey) as first_paper, min_by(o_orderstatus, o_orderkey) as status from orders group by 1")
def first_papers(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_orderkey").alias("first_paper"), F.col("o_orderstatus").alias("status"))
    return relate.first_value(rows, "o_custkey", "o_orderkey", "first_paper", "status")


# --- graphs, clusters and variants -----------------------------------------------------------------------------------

_DIRECTED = "select l_partkey as q, l_suppkey as s, round(l_discount * 10, 3) as qcov, round(l_tax * 10, 3) as scov, l_quantity as bits, l_linenumber::double as pct_id from lineitem where l_partkey <> l_suppkey"


@query("with p as (select l_partkey as q, l_suppkey as s, l_discount * 1000 as pct, l_tax * 1e-4 as ev, l_quantity as bits, l_orderkey * 10 + l_linenumber as ord from lineitem where l_partkey <> l_suppkey) select q as l_partkey, s as l_suppkey, round(max_by(pct, (bits, -ord)), 6) as pct, max(bits) as bits from (select * from p) group by 1, 2")
def best_directed_pairs(spark, d):
    return graph.best_directed(_pairs(spark, d), "l_partkey", "l_suppkey", "bits", "ord", "pct").select("l_partkey", "l_suppkey", F.round("pct", 6).alias("pct"), "bits")


@query(f"with e as ({_DIRECTED}), u as (select q as node, s as other, (qcov, bits, pct_id) as x from e union all select s, q, (scov, bits, pct_id) from e) select node, other, m[1] as cover, m[2] as bits, m[3] as pct_id from (select node, other, max([x[1], x[2], x[3]]) as m from (select node, other, [x[1], x[2], x[3]] as x from u) group by 1, 2)")
def best_covers(spark, d):
    e = table(spark, d, "lineitem").where("l_partkey <> l_suppkey").select(F.col("l_partkey").alias("q"), F.col("l_suppkey").alias("s"), F.round(F.col("l_discount") * 10, 3).alias("qcov"), F.round(F.col("l_tax") * 10, 3).alias("scov"), F.col("l_quantity").alias("bits"), F.col("l_linenumber").cast("double").alias("pct_id"))
    return graph.best_cover(e, "q", "s")


@query(COMPONENTS + ", m as (select root, node, 'PL' || node || '|' || lang as label from c join documents on node = doc_id), z as (select root, count(*) as size, min((node, label)) as k from m group by root) select root, size, 'C' || lpad(row_number() over (order by k)::varchar, greatest(length(row_number() over (order by k)::varchar), 3)::int, '0') as component_id, row_number() over (order by size desc, k) as size_rank, k[2] as canonical from z")
def component_roster(spark, d):
    m = _components(spark, d).join(table(spark, d, "documents").select(F.col("doc_id").alias("node"), F.concat(F.lit("PL"), "doc_id", F.lit("|"), "lang").alias("label")), "node")
    return graph.number_components(m, "root", "label", "node").select("root", "size", "component_id", "size_rank", F.col("canonical.label").alias("canonical"))


@query(COMPONENTS + """, m as (select root, node, case when node % 3 = 0 then 'g' || (node % 13) else '' end as overlay, case when node % 4 = 0 then '-' else lang end as fold, source || '; ' || lang as r1, case when node % 2 = 0 then 'z' || (node % 3) else null end as r2, 'PL' || node as label from c join documents on node = doc_id),
o as (select root, string_agg('g' || v, ';' order by v) as overlays from (select distinct root, node % 13 as v from m where overlay <> '') group by root), f as (select root, string_agg(distinct fold, ';' order by fold) as folds from m where fold <> '-' group by root),
a as (select root, string_agg(distinct trim(x), ';' order by trim(x)) as c1 from (select root, unnest(string_split(r1, ';')) as x from m) group by root), b as (select root, string_agg(distinct r2, ';' order by r2) as c2 from m group by root)
select root, count(*) as n, count(nullif(overlay, '')) as n_with_overlay, coalesce(any_value(overlays), '') as overlays, coalesce(any_value(folds), '') as folds, any_value(c1) || coalesce(';' || any_value(c2), '') as citations, string_agg(label, ';' order by node) as members from m left join o using (root) left join f using (root) left join a using (root) left join b using (root) group by root""")
def component_rollup(spark, d):
    n = F.col("node")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("node"), "lang", "source")
    m = _components(spark, d).join(docs, "node").withColumns({"overlay": F.when(n % 3 == 0, F.concat(F.lit("g"), (n % 13).cast("string"))).otherwise(""), "fold": F.when(n % 4 == 0, "-").otherwise(F.col("lang")), "r1": F.concat("source", F.lit("; "), "lang"), "r2": F.when(n % 2 == 0, F.concat(F.lit("z"), (n % 3).cast("string")))})
    return shape.component_rollup(m, "root", F.concat(F.lit("PL"), n.cast("string")), ["node"], "overlay", "fold", ["r1", "r2"])


@query("with m as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) = 1 as head, (o_orderkey % 100)::double as pct from orders) select o_custkey, max(case when head then o_orderkey end)::varchar as centroid, count(*) as size, coalesce(string_agg(case when not head then o_orderkey end, '; ' order by pct desc, lpad(o_orderkey::varchar, 12, '0')), '') as members from m group by 1")
def cluster_rollup(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") % 100).cast("double").alias("pct"))
    head = o.groupBy("o_custkey").agg(F.min("o_orderkey").alias("head"))
    m = o.join(head, "o_custkey").withColumn("role", F.when(F.col("o_orderkey") == F.col("head"), "centroid").otherwise("member"))
    return cluster.rollup(m, "o_custkey", "o_orderkey", "pct").select("o_custkey", F.col("centroid").cast("string").alias("centroid"), "size", "members")


@query("with g as (select c_nationkey, c_custkey, c_custkey % 11 = 0 as wt from customer), n as (select c_nationkey, count_if(wt) as k, min(case when wt then c_custkey end) as w from g group by 1) select c_custkey, case when k = 1 then w else c_custkey end as target, case when k = 1 then case when c_custkey = w then 'wildtype' else 'collapsed' end when k = 0 then 'no_wildtype' else 'ambiguous' end as status from g join n using (c_nationkey)")
def wildtype_collapse(spark, d):
    g = table(spark, d, "customer").select("c_nationkey", "c_custkey", (F.col("c_custkey") % 11 == 0).alias("wt"))
    return variants.collapse_to_wildtype(g, "c_nationkey", "c_custkey", "wt")


@query("select c_custkey, case when c_custkey % 10 = 3 then c_custkey - 1 else c_custkey end as target from customer")
def pair_collapse(spark, d):
    c = table(spark, d, "customer").select("c_custkey")
    pairs = c.where("c_custkey % 10 = 3").select(F.col("c_custkey").alias("drop"), (F.col("c_custkey") - 1).alias("keep"))
    return variants.collapse_pairs(c, "c_custkey", pairs)


@query(COMPONENTS + ", z as (select root, count(*) as n from c group by root) select (select count(*) from documents) as universe, sum(n)::bigint as covered, count(*) as n_groups, (select count(*) from (select node from c group by node having count(*) > 1)) as twice from z")
def partition_cover(spark, d):
    c = _components(spark, d)
    sizes = c.groupBy("root").agg(F.count("*").alias("n")).agg(F.sum("n").alias("covered"), F.count("*").alias("n_groups"))
    twice = c.groupBy("node").agg(F.count("*").alias("k")).agg(F.count_if(F.col("k") > 1).alias("twice"))
    return table(spark, d, "documents").agg(F.count("*").alias("universe")).join(sizes).join(twice)


@query(PRIOR + ", k as (select root, prior, count(*) as n from c join p using (node) group by 1, 2) select (select sum(n * (n - 1) // 2)::bigint from k) as both, (select sum(n * (n - 1) // 2)::bigint from (select sum(n) as n from k group by root)) as by_component, (select sum(n * (n - 1) // 2)::bigint from (select sum(n) as n from k group by prior)) as by_prior")
def pair_agreement(spark, d):
    c, p = _two(spark, d)
    found = compare.agreement(compare.crosstab(c, p, "node", "root", "prior"), "root", "prior")
    return found.select("both", (F.col("both") + F.col("a_only")).alias("by_component"), (F.col("both") + F.col("b_only")).alias("by_prior"))


# --- overlays and shapes ---------------------------------------------------------------------------------------------


@query(f"select distinct acc from (select c_custkey, {CODES} as acc from customer) where acc not in ('', '-') and c_custkey % 3 = 0 order by acc")
def blank_targets(spark, d):
    blank = _codes(spark, d).withColumn("sequence", F.when(F.col("c_custkey") % 3 == 0, " - ").otherwise("MK"))
    return evidence.fetch_targets(blank, "acc", "sequence")


@query(f"select doc_id, case when l = '' then null when doc_id % 2 = 0 then 'k' || md5(l) end as cluster, case when l = '' then 'no_sequence' when l in (select upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')) from documents where doc_id % 2 = 0) then 'assigned' else 'unassigned' end as status from (select doc_id, case when doc_id % 7 = 0 then '' else {LETTERS} end as l, text from documents) where l = '' or doc_id % 2 = 0 or l not in (select {LETTERS} from documents where doc_id % 2 = 0) union all select doc_id, 'k' || md5(l), 'assigned' from (select doc_id, {LETTERS} as l from documents where doc_id % 7 <> 0 and doc_id % 2 = 1) where l <> '' and l in (select {LETTERS} from documents where doc_id % 2 = 0)")
def assigned_status(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    known = docs.where("doc_id % 2 = 0").select(text.sequence_key("text").alias("sequence_md5")).where("sequence_md5 <> ''").distinct().withColumn("cluster", F.concat(F.lit("k"), "sequence_md5"))
    rows = docs.withColumn("text", F.when(F.col("doc_id") % 7 != 0, F.col("text")))
    return shape.assigned(rows, known, "text", "sequence_md5", "cluster").select("doc_id", "cluster", "status")


@query("""with r as (select c_custkey, 'A' || (c_custkey % 40) as acc, case when c_custkey % 3 = 0 then '' else 'MK' || translate((c_custkey % 40)::varchar, '0123456789', 'ACDEFGHIKL') end as s, c_name as v from customer),
u as (select 'A' || s_suppkey as acc, 'MK' || translate(s_suppkey::varchar, '0123456789', 'ACDEFGHIKL') as s from supplier),
k as (select c_custkey, v, case when r.s <> '' then md5(r.s) when u.s is not null then md5(u.s) end as sequence_md5 from r left join u on r.acc = u.acc) select sequence_md5, min_by(v, c_custkey) as v from k where sequence_md5 is not null group by 1""")
def borrowed_keys(spark, d):
    code = lambda c: F.concat(F.lit("MK"), F.translate(c.cast("string"), "0123456789", "ACDEFGHIKL"))
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select(k.alias("ord"), F.concat(F.lit("a"), (k % 40).cast("string"), F.lit(".2")).alias("acc"), F.when(k % 3 != 0, code(k % 40)).alias("seq"), F.col("c_name").alias("v"))
    union = table(spark, d, "supplier").select(F.col("s_suppkey").alias("ord"), F.concat(F.lit("A"), F.col("s_suppkey").cast("string")).alias("acc"), code(F.col("s_suppkey")).alias("seq"))
    return shape.borrowed_overlay(rows, union, "ord", "seq", "acc", "v")


@query("""select c_custkey, case when c_custkey % 40 < 10 or c_custkey % 30 < 10 then list_reduce(list_distinct_ordered, lambda a, b: a || ';' || b) else case when c_custkey % 7 < 5 then '10.7/' || (c_custkey % 7) else '' end end as dois from (select c_custkey, case when c_custkey % 40 < 10 and c_custkey % 30 < 10 and c_custkey % 40 <> c_custkey % 30 then ['10.5/' || (c_custkey % 40), '10.5/' || (c_custkey % 30)] when c_custkey % 40 < 10 then ['10.5/' || (c_custkey % 40)] else ['10.5/' || (c_custkey % 30)] end as list_distinct_ordered from customer)""")
def citation_overlay(spark, d):
    k = F.col("c_custkey")
    nodes = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("acc"), (k % 7).cast("string"), F.lit(".1")).alias("acc"), F.array((k % 40).cast("string"), (k % 30).cast("string")).alias("ids"))
    papers = spark.range(10).select(F.col("id").alias("ord"), F.col("id").cast("string").alias("id"), F.lit("-").alias("accession"), F.concat(F.lit("10.5/"), F.col("id").cast("string")).alias("doi"))
    papers = papers.unionByName(spark.range(5).select((F.col("id") + 50).alias("ord"), F.lit("").alias("id"), F.concat(F.lit("ACC"), F.col("id").cast("string")).alias("accession"), F.concat(F.lit("10.7/"), F.col("id").cast("string")).alias("doi")))
    return shape.citation_overlay(nodes, papers, "c_custkey", F.col("ids"), "acc", "ord").select("c_custkey", F.array_join("dois", ";").alias("dois"))


@query("select o_orderkey, o_orderstatus as t0, o_orderpriority as t1, c_name as t2, n_name as t3, quality as t4, coalesce(p_brand, '') as t5, r_name as t6 from orders left join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey left join (select doc_id, min(quality) as quality from labels group by 1) on doc_id = o_orderkey left join part on p_partkey = o_orderkey")
def tier_join(spark, d):
    o = table(spark, d, "orders")
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    place = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    tiers = {
        "t0": o.select("o_orderkey", F.col("o_orderstatus").alias("t0")), "t1": o.select("o_orderkey", F.col("o_orderpriority").alias("t1")), "t2": place.select("o_orderkey", F.col("c_name").alias("t2")), "t3": place.select("o_orderkey", F.col("n_name").alias("t3")),
        "t4": table(spark, d, "labels").groupBy(F.col("doc_id").alias("o_orderkey")).agg(F.min("quality").alias("t4")), "t5": table(spark, d, "part").select(F.col("p_partkey").alias("o_orderkey"), F.col("p_brand").alias("t5")), "t6": place.select("o_orderkey", F.col("r_name").alias("t6")),
    }
    return relate.tiers(o.select("o_orderkey"), "o_orderkey", list(tiers.values())).withColumn("t5", F.coalesce("t5", F.lit("")))


@query(f"with k as (select doc_id, md5({LETTERS}) as h from documents where {LETTERS} <> ''), a as (select h, min(doc_id) % 9 as g from k group by h), b as (select h, min(doc_id) % 6 as g from k where doc_id % 2 = 0 group by h) select a.g as old, b.g as new, count(*) as n from a join b using (h) group by 1, 2")
def run_vs_run(spark, d):
    keyed = table(spark, d, "documents").select("doc_id", text.sequence_key("text").alias("sequence_md5")).where("sequence_md5 <> ''")
    runs = []
    for rows, n, name in ((keyed, 9, "old"), (keyed.where("doc_id % 2 = 0"), 6, "new")):
        roster = rows.groupBy("sequence_md5").agg(F.min("doc_id").alias("node"))
        runs.append(shape.remapped(roster.select("node", (F.col("node") % n).alias(name)), roster, "node"))
    return runs[0].join(runs[1], "sequence_md5").groupBy("old", "new").agg(F.count("*").alias("n"))


@query("select k, v from (select s_nationkey as k, min(s_name) as v from supplier where s_suppkey < 10 group by 1) union all select k, v from (select c_nationkey as k, min(c_name) as v from customer group by 1) where k not in (select s_nationkey from supplier where s_suppkey < 10)")
def merged_tables(spark, d):
    base = table(spark, d, "supplier").where("s_suppkey < 10").groupBy(F.col("s_nationkey").alias("k")).agg(F.min("s_name").alias("v"))
    delta = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.min("c_name").alias("v"))
    return shape.merged(base, delta, "k")


@query("""select 'CL' || lpad(case when p_partkey % 5 = 0 then row_number() over (order by p_partkey) else p_partkey end::varchar, greatest(4, length(case when p_partkey % 5 = 0 then row_number() over (order by p_partkey) else p_partkey end::varchar))::int, '0') || '|' || p_brand as identifier, p_name as enzyme_name, '' as pazy_id, p_brand as accession, '' as organism, regexp_replace(p_name, '\\s', '', 'g') as aa_sequence from part""")
def node_shapes(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 5 == 0, "n/a").otherwise(F.col("p_partkey").cast("string")).alias("cluster_id"), F.concat(F.lit(" "), "p_brand").alias("label"), "p_name", "p_brand")
    return shape.node_shape(p, "cluster_id", "label", "CL", {"enzyme_name": "p_name", "accession": "p_brand", "aa_sequence": "p_name"}, "p_partkey")


@query(f"select 'v' || lpad(place::varchar, greatest(3, length(place::varchar))::int, '0') as node_id, doc_id, md5(l) as sequence_md5, length(l) as sequence_length from (select doc_id, {LETTERS} as l, row_number() over (order by doc_id) as place from documents where {LETTERS} <> '')")
def separate_nodes(spark, d):
    return shape.separate_nodes(table(spark, d, "documents").select("doc_id", "text"), "text", "doc_id").drop("text")


@query("""select p_partkey as "group", p_brand as identifier, p_name as enzyme_name, length(p_name) as length_aa, 'superset' as role, case when p_size - 25 > 0 then '+' || (p_size - 25) else (p_size - 25)::varchar end as delta_aa, 'prefix' as position, '' as change, p_name as aa_sequence, '' as comments, '' as "most-wildtype" from part""")
def substring_shape(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("group"), F.col("p_brand").alias("identifier"), F.col("p_name").alias("enzyme_name"), F.length("p_name").cast("long").alias("length_aa"), F.lit("superset").alias("role"), (F.col("p_size") - 25).alias("delta_aa"), F.lit("prefix").alias("position"), F.col("p_name").alias("aa_sequence"))
    return shape.substring_shape(p)


@query(f"""with c as (select c_custkey, {CODES} as acc from customer), k as (select c_custkey, case when regexp_matches(upper(split_part(acc, '.', 1)), '^(AC|NC|NG|NM|NR|NT|NW|NZ|XM|XR)_') then 1 when regexp_full_match(upper(split_part(acc, '.', 1)), '[A-Z][0-9]{{5}}|[A-Z]{{2}}[0-9]{{6}}|[A-Z]{{2}}[0-9]{{8}}') then 1 else 0 end + case when c_custkey % 2 = 0 then 1 else 0 end as dropped, 1 + case when c_custkey % 2 = 0 then 1 else 0 end as n from c)
select sum(dropped)::bigint as dropped_tokens, count_if(dropped = n) as emptied_rows, count_if(dropped > 0) as touched_rows, count(*) as n_rows from k""")
def nucleotide_counts(spark, d):
    cell = F.concat("acc", F.when(F.col("c_custkey") % 2 == 0, "; OK558825").otherwise(""))
    return accession.dropped_counts(_codes(spark, d).withColumn("cell", cell), "cell")


_STEPS = [("extract", "done", True), ("collapse", "skipped", False), ("align", "done", True), ("report", "out of range", False)]


@query("select * from (values ('extract', 'done'), ('collapse', 'skipped'), ('align', 'done'), ('report', 'out of range')) t(step, state)")
def step_report(spark, d):
    ran = [steps.Step(name, lambda: table(spark, d, "region").count(), (lambda: True) if state == "skipped" else (lambda: False)) for name, state, _ in _STEPS]
    return spark.createDataFrame([(r["step"], r["state"]) for r in steps.run_steps(ran, last="align").rows], "step string, state string")


@query("select * from (select p_partkey, row_number() over (order by p_size desc, length(p_name), p_partkey) as group_place, row_number() over (order by p_size desc, p_brand, p_partkey % 3 <> 0, p_partkey) as member_place from part)")
def report_orders(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_size", "p_name", "p_brand")
    groups = numbered(p, F.col("p_size").desc(), F.length("p_name"), F.col("p_partkey"), name="a")
    members = numbered(groups, F.col("p_size").desc(), F.col("p_brand"), F.col("p_partkey") % 3 != 0, F.col("p_partkey"), name="b")
    return members.select("p_partkey", (F.col("a") + 1).alias("group_place"), (F.col("b") + 1).alias("member_place"))


# --- no SQL ----------------------------------------------------------------------------------------------------------


@query()
def near_contained(spark, d):
    p = table(spark, d, "part")
    return evidence.near_containment(p.select("p_partkey", "p_name", F.concat(F.lit("x"), "p_name", F.lit(" "), "p_type").alias("longer")), "p_name", "longer").select("p_partkey", F.round("coverage", 6).alias("coverage"))


@query()
def near_global(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", text.letters(F.concat("n_name", F.lit("ACDEFGHIKLMNPQRSTVWY"), F.repeat(F.lit("MKT"), (F.col("n_nationkey") % 4).cast("int")))).alias("seq"))
    pairs = align.shared_words(n, "n_nationkey", "seq", k=5, least=2)
    a, b = n.select(F.col("n_nationkey").alias("a"), F.col("seq").alias("sa")), n.select(F.col("n_nationkey").alias("b"), F.col("seq").alias("sb"))
    hits = align.near_global(pairs.join(a, "a").join(b, "b"), "a", "b", "sa", "sb")
    return align.best_reference(hits.withColumn("ord", F.col("a")), "b", "a", 60.0, "ord")


@query()
def cluster_levels(spark, d):
    nodes = table(spark, d, "part").select(F.col("p_partkey").alias("node"), F.col("p_partkey").alias("ord"), F.col("p_size").cast("long").alias("len"))
    return cluster.hierarchy(nodes, _links(spark, d), [0.9, 0.6, 0.3])
