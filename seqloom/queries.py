"""The library's queries over the driver's tables, and DuckDB SQL for those that SQL can express.

The tables hold no proteins, so each operator works on columns of the same
shape.  Every query reads its whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import accession, align, families, text
from .operators import cluster, collapse, compare, evidence, graph, relate, rules, shape, variants
from .sources import records, sinks
from .sources.delimited import numbered
from .streaming import events as streaming

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LETTERS = "upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g'))"


# --- keys and text ---------------------------------------------------------------------------------------------------


@query(f"select sequence_md5, count(*) as n_source_rows, coalesce(min(nullif(trim(source), '')), '') as source, coalesce(string_agg(distinct source, ';' order by source), '') as source_all, coalesce(min(nullif(trim(lang), '')), '') as lang, coalesce(string_agg(distinct lang, ';' order by lang), '') as lang_all, min(doc_id) as first_doc from (select *, md5({LETTERS}) as sequence_md5, {LETTERS} as l from documents) where l <> '' group by sequence_md5")
def md5_collapse(spark, d):
    docs = table(spark, d, "documents").withColumn("sequence_md5", text.sequence_key("text")).where("sequence_md5 <> ''")
    return collapse.collapse(docs, "sequence_md5", ["source", "lang"], more={"first_doc": F.min("doc_id")})


@query(f"select 'm' || lpad(cast(row_number() over (order by h) as varchar), 6, '0') as node_id, h as sequence_md5, n from (select md5({LETTERS}) as h, count(*) as n from documents where {LETTERS} <> '' group by 1)")
def md5_nodes(spark, d):
    groups = table(spark, d, "documents").select(text.sequence_key("text").alias("sequence_md5")).where("sequence_md5 <> ''").groupBy("sequence_md5").agg(F.count("*").alias("n"))
    return numbered(groups, "sequence_md5").select(F.concat(F.lit("m"), F.lpad((F.col("_ord") + 1).cast("string"), 6, "0")).alias("node_id"), "sequence_md5", "n")


@query(r"select doc_id, md5(upper(replace(regexp_replace(coalesce(text, ''), '[ \t\n\x0b\f\r]+', '', 'g'), 'ß', 'SS'))) as space_md5, length(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')) as n_letters from documents")
def whitespace_key(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.spaceless("text")).alias("space_md5"), F.length(text.letters("text")).cast("long").alias("n_letters"))


@query(r"select c_custkey, cast(regexp_extract(c_name, '(\d+)', 1) as bigint) as num, row_number() over (order by (coalesce(c_mktsegment, '') = ''), c_mktsegment, cast(regexp_extract(c_name, '(\d+)', 1) as bigint), c_custkey) as place from customer")
def first_number_sort(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", text.first_number("c_name").alias("num"), (F.coalesce("c_mktsegment", F.lit("")) == "").alias("blank"), "c_mktsegment")
    return numbered(rows, "blank", "c_mktsegment", "num", "c_custkey").select("c_custkey", "num", (F.col("_ord") + 1).alias("place"))


CODES = """
  case c_custkey % 10 when 0 then 'WP_' || lpad(cast(c_custkey as varchar), 9, '0') || '.1' when 1 then 'ABC' || lpad(cast(c_custkey % 100000 as varchar), 5, '0')
    when 2 then 'Q9X' || cast(c_custkey % 10 as varchar) || 'A' || cast(c_custkey % 7 as varchar) when 3 then '5XFY_A' when 4 then 'MGYP' || cast(c_custkey as varchar)
    when 5 then 'AB' || lpad(cast(c_custkey % 1000000 as varchar), 6, '0') when 6 then '-' when 7 then 'NM_' || cast(c_custkey as varchar) when 8 then 'not an id' else 'abc' || lpad(cast(c_custkey % 10000000 as varchar), 7, '0') || '.2' end"""


def _codes(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.expr(CODES.replace("varchar", "string")).alias("acc"))


@query(
    f"""with c as (select c_custkey, {CODES} as acc from customer)
select c_custkey, acc, case when acc in ('', '-') then 'missing' when regexp_matches(acc, '(?i)^(WP|NP|XP|YP|AP|ZP)_[0-9]{{6,9}}(\\.[0-9]+)?$') then 'refseq' when regexp_matches(acc, '(?i)^(NC|NM|NR|XM|XR|NZ|NT|NW)_[0-9]+(\\.[0-9]+)?$') then 'refseq_nucleotide'
 when regexp_matches(acc, '(?i)^[A-Z]{{3}}[0-9]{{5}}(\\.[0-9]+)?$') then 'insd_protein' when regexp_matches(acc, '(?i)^[A-Z]{{3}}[0-9]{{7}}(\\.[0-9]+)?$') then 'wgs_protein'
 when regexp_matches(acc, '(?i)^([OPQ][0-9][A-Z0-9]{{3}}[0-9]|[A-NR-Z][0-9]([A-Z][A-Z0-9]{{2}}[0-9]){{1,2}})(\\.[0-9]+)?$') then 'uniprot' when regexp_matches(acc, '(?i)^[0-9][A-Z0-9]{{3}}_[A-Z0-9]+$') then 'pdb_chain' when regexp_matches(acc, '(?i)^[0-9][A-Z0-9]{{3}}$') then 'pdb_entry'
 when regexp_matches(acc, '(?i)^MGYP[0-9]+$') then 'mgnify' when regexp_matches(acc, '(?i)^([A-Z][0-9]{{5}}|[A-Z]{{2}}[0-9]{{6}})(\\.[0-9]+)?$') then 'insd_legacy' else 'unrecognized' end as class,
 regexp_matches(acc, '\\.[0-9]+$') as versioned, regexp_replace(acc, '\\.[0-9]+$', '') as base, upper(split_part(case when acc = '-' then '' else acc end, '.', 1)) as acc_key from c"""
)
def accession_class(spark, d):
    c = _codes(spark, d)
    return c.select("c_custkey", "acc", accession.accession_class("acc").alias("class"), accession.has_version("acc").alias("versioned"), text.without_version("acc").alias("base"), text.accession_key("acc").alias("acc_key"))


@query(
    f"""with c as (select c_custkey, {CODES} as acc from customer), l as (select c_custkey, acc || '; 5XFY ;' || 'WP_000000001.1;OK558825' as cell from c), t as (select c_custkey, list_transform(string_split(cell, ';'), lambda x: trim(x)) as toks from l),
k as (select c_custkey, toks, list_filter(toks, lambda a: not (case when regexp_matches(upper(split_part(a, '.', 1)), '^(AC|NC|NG|NM|NR|NT|NW|NZ|XM|XR)_') then true when starts_with(upper(a), 'MGYP') then false when regexp_full_match(upper(split_part(a, '.', 1)), '[OPQ][0-9][A-Z0-9]{{3}}[0-9]|[A-NR-Z][0-9]([A-Z][A-Z0-9]{{2}}[0-9]){{1,2}}') then false else regexp_full_match(upper(split_part(a, '.', 1)), '[A-Z][0-9]{{5}}|[A-Z]{{2}}[0-9]{{6}}|[A-Z]{{2}}[0-9]{{8}}') end)) as kept from t)
select c_custkey, array_to_string(kept, ';') as proteins, len(toks) - len(kept) as dropped from k"""
)
def nucleotide_filter(spark, d):
    cell = F.concat("acc", F.lit("; 5XFY ;WP_000000001.1;OK558825"))
    kept = accession.protein_tokens(cell)
    return _codes(spark, d).select("c_custkey", F.concat_ws(";", kept).alias("proteins"), (F.size(text.listed(cell)) - F.size(kept)).cast("long").alias("dropped"))


_KIND_SQL = "case when tok = '' then 'empty' when regexp_matches(tok, '^[0-9][A-Za-z0-9]{3}(_?[A-Za-z](/[A-Za-z])?)?$') then 'PDB' when regexp_matches(tok, '(?i)^(WP|NP|XP|YP|AP)_') then 'RefSeq' when regexp_matches(tok, '(?i)^MGYP') then 'MGnify' when regexp_full_match(tok, '[OPQ][0-9][A-Z0-9]{3}[0-9]|[A-NR-Z][0-9]([A-Z][A-Z0-9]{2}[0-9]){1,2}') then 'UniProt' when contains(tok, '_') then 'UniProt/locus' when regexp_full_match(tok, '[A-Z]{3}[0-9]{5,}([.][0-9]+)?') then 'GenBank-protein' when regexp_full_match(tok, '[A-Z]{1,2}[0-9]{5,6}([.][0-9]+)?') then 'Nucleotide' when regexp_full_match(tok, '(?i)[A-Z]{2,5}[0-9]{3,4}') then 'Locus' else 'UNKNOWN' end"


def _order_sql(name: str, source: str) -> str:
    """CTEs that give name_i (c_custkey, pos, tok, kind, rank, n), name_p (c_custkey, problems) and name_r (c_custkey, cell in order) of the lists in ``source`` (c_custkey, cell)."""
    return f"""{name}_t as (select c_custkey, list_filter(list_transform(string_split(cell, ';'), lambda x: trim(x)), lambda x: x <> '') as toks from {source}),
{name}_k as (select c_custkey, tok, pos, n, {_KIND_SQL} as kind from (select c_custkey, unnest(toks) as tok, generate_subscripts(toks, 1) as pos, len(toks) as n from {name}_t)),
{name}_i as (select *, case kind when 'RefSeq' then 0 when 'GenBank-protein' then 0 when 'MGnify' then 0 when 'UniProt' then 1 when 'UniProt/locus' then 1 when 'Nucleotide' then 1 when 'Locus' then 1 when 'PDB' then 2 end as rank from {name}_k),
{name}_x as (select c_custkey, 0 as part, pos, 'unrecognized:' || tok as p from {name}_i where kind = 'UNKNOWN'
 union all select c_custkey, 1, pos, 'out-of-order:' || tok from (select *, lag(rank) over (partition by c_custkey order by pos) as before from {name}_i where rank is not null) where rank < before
 union all select c_custkey, 2, 0, 'primary-misplaced:' || min_by(tok, pos) from {name}_i where kind in ('RefSeq', 'GenBank-protein') and c_custkey not in (select c_custkey from {name}_i where pos = 1 and kind in ('RefSeq', 'GenBank-protein')) group by 1),
{name}_p as (select c_custkey, coalesce(string_agg(p, '|' order by part, pos), '') as problems from {source} left join {name}_x using (c_custkey) group by 1),
{name}_r as (select c_custkey, string_agg(tok, ';' order by coalesce(rank, (pos - 1) / n::double), pos) as cell from {name}_i group by 1)"""


@query(f"with c as (select c_custkey, '5XFY;' || acc || ';WP_000000001.1;OK558825' as cell from (select c_custkey, {CODES} as acc from customer)), {_order_sql('a', 'c')}, {_order_sql('b', 'a_r')} select c_custkey, a_p.problems, a_r.cell as reordered, b_p.problems as still from a_p join a_r using (c_custkey) join b_p using (c_custkey)")
def list_order_check(spark, d):
    cell = F.concat(F.lit("5XFY;"), "acc", F.lit(";WP_000000001.1;OK558825"))
    lists = _codes(spark, d).repartition("c_custkey").select("c_custkey", F.array_join(accession.order_problems(cell), "|").alias("problems"), accession.reordered(cell).alias("reordered"))
    return lists.withColumn("still", F.array_join(accession.order_problems("reordered"), "|"))


@query(f"with c as (select c_custkey, '5XFY;' || acc || ';WP_000000001.1;OK558825' as cell from (select c_custkey, {CODES} as acc from customer)), {_order_sql('a', 'c')}, k as (select split_part(p, ':', 1) as kind, count(*) as n, count(distinct c_custkey) as n_rows from a_x group by 1) select kind, n, n_rows, row_number() over (order by n desc, kind) as place from k")
def order_report(spark, d):
    cell = F.concat(F.lit("5XFY;"), "acc", F.lit(";WP_000000001.1;OK558825"))
    return shape.refuse(shape.order_report(_codes(spark, d), "c_custkey", accession.order_problems(cell)), strict=False)


@query(r"select page_id, regexp_replace(regexp_replace(lower(trim('https://doi.org/10.' || page_id || '/' || split_part(url, '/', 3) || '.;')), '^(https?://)?(dx\.)?doi\.org/', ''), '[.;,]+$', '') as doi, regexp_replace(url, '[^A-Za-z0-9._-]', '_', 'g') as file_token from pages")
def doi_normalise(spark, d):
    p = table(spark, d, "pages")
    cell = F.concat(F.lit("https://doi.org/10."), F.col("page_id").cast("string"), F.lit("/"), F.split_part("url", F.lit("/"), F.lit(3)), F.lit(".;"))
    return p.select("page_id", text.doi(cell).alias("doi"), text.file_token("url").alias("file_token"))


@query(r"""select p_partkey, list_sort(list_distinct(list_filter(string_split_regex(lower(p_name), '[^a-z0-9]+'), lambda t: t <> '' and not regexp_full_match(t, '[0-9]+')))) as toks,
 round(case when len(a) = 0 or len(b) = 0 then 0 else len(list_intersect(a, b))::double / len(list_distinct(list_concat(a, b))) end, 6) as jaccard from (
 select p_partkey, p_name, list_distinct(list_filter(string_split_regex(lower(p_name), '[^a-z0-9]+'), lambda t: t <> '' and not regexp_full_match(t, '[0-9]+'))) as a,
 list_distinct(list_filter(string_split_regex(lower(p_type), '[^a-z0-9]+'), lambda t: t <> '' and not regexp_full_match(t, '[0-9]+'))) as b from part)""")
def token_jaccard(spark, d):
    a, b = text.tokens("p_name", []), text.tokens("p_type", [])
    return table(spark, d, "part").select("p_partkey", F.array_sort(a).alias("toks"), F.round(text.jaccard(a, b), 6).alias("jaccard"))


TITLES = "case p_partkey % 6 when 0 then 'MULTISPECIES: PET hydrolase [Ideonella sp.]' when 1 then 'cutinase family protein' when 2 then 'alpha/beta hydrolase [uncultured bacterium]' when 3 then 'laccase' when 4 then 'hypothetical protein X_1' else 'RecName: Full=Lipase; Flags: Precursor' end"
NAMES = "case p_partkey % 5 when 0 then 'PETase' when 1 then 'lipase B' when 2 then 'polyester hydrolase' when 3 then 'laccase' else 'P' end"


_FAMILY_SQL = """with p as (select p_partkey, (p_partkey % 6)::int + 1 as t, (p_partkey % 5)::int + 1 as n from part),
f as (select p_partkey, ['PET hydrolase', 'cutinase family protein', 'alpha/beta hydrolase', 'laccase', 'hypothetical protein X_1', 'Lipase'][t] as title, ['Ideonella sp.', '', 'uncultured bacterium', '', '', ''][t] as organism, ['pet_hydrolase', 'lipase', 'pet_hydrolase', 'laccase', ''][n] as a, ['pet_hydrolase', 'cutinase', 'ab_hydrolase', 'laccase', '', 'lipase'][t] as b, t = 5 as uninformative from p)
select p_partkey, title, organism, a as name_families, b as title_families, case when a = '' or b = '' then 'unknown' when a = b then 'match' when b = 'ab_hydrolase' then 'generic' when (a = 'laccase') = (b = 'laccase') then 'related' else 'conflict' end as agreement, uninformative from f"""


@query(_FAMILY_SQL)
def family_match(spark, d):
    p = table(spark, d, "part").select("p_partkey", text.title_parts(F.expr(TITLES)).alias("t"), F.expr(NAMES).alias("name"))
    a, b = families.families(F.col("name")), families.families(F.col("t.title"))
    return p.select("p_partkey", "t.title", "t.organism", F.concat_ws(";", a).alias("name_families"), F.concat_ws(";", b).alias("title_families"), families.agreement(a, b).alias("agreement"), families.uninformative(F.col("t.title")).alias("uninformative"))


@query("select doc_id, md5('>' || doc_id || '|' || lang || chr(10) || text) as record_md5 from documents where coalesce(text, '') <> ''")
def fasta_records(spark, d):
    docs = table(spark, d, "documents").where("coalesce(text, '') <> ''")
    return docs.select("doc_id", F.md5(sinks.fasta_record(sinks.header_from("{doc_id}|{lang}", docs.columns), F.col("text"), None)).alias("record_md5"))


@query("select event_id, try_cast(json_extract_string(props, '$.k') as bigint) as k from events")
def json_flatten(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))


# --- joins -----------------------------------------------------------------------------------------------------------


@query("""with a as (select o_custkey as k, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) as rn from orders where o_custkey is not null), b as (select user_id as k, event_id, row_number() over (partition by user_id order by event_id) as rn from events where user_id is not null)
select k, o_orderkey, event_id, case when o_orderkey is null then 'right' when exists (select 1 from events e where e.user_id = k) then 'both' else 'left' end as source from a full join b using (k, rn)""")
def rank_match_union(spark, d):
    a = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey")
    b = table(spark, d, "events").select(F.col("user_id").alias("k"), "event_id")
    return relate.rank_match(a, b, "k", ["o_orderkey"], ["event_id"]).select("k", "o_orderkey", "event_id", "source")


@query("""with s as (select s_suppkey, s_nationkey as k, row_number() over (partition by s_nationkey order by s_suppkey) as rn from supplier), c as (select c_custkey, c_nationkey as k, row_number() over (partition by c_nationkey order by c_custkey) as rn from customer)
select s_suppkey, s.k as nation, c_custkey from s left join c on s.k = c.k and s.rn = c.rn""")
def claim_join(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"))
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"))
    return relate.claim(s, c, "nation", ["s_suppkey"], ["c_custkey"]).select("s_suppkey", "nation", "c_custkey")


@query("""with s as (select s_nationkey as k, min(s_name) as v from supplier where s_acctbal > 9000 group by 1), c as (select c_nationkey as k, min(c_name) as v from customer where c_acctbal > 9800 group by 1), n as (select n_nationkey as k, min(n_name) as v from nation where n_regionkey < 3 group by 1)
select n_nationkey, coalesce(s.v, c.v, n.v, '') as value, case when s.v is not null then 'supplier' when c.v is not null then 'customer' when n.v is not null then 'nation' else '' end as stage
from nation left join s on n_nationkey = s.k left join c on n_nationkey = c.k left join n on n_nationkey = n.k""")
def coalesce_cascade(spark, d):
    n = table(spark, d, "nation")
    s = table(spark, d, "supplier").where("s_acctbal > 9000").select(F.col("s_nationkey").alias("n_nationkey"), F.col("s_name").alias("value"))
    c = table(spark, d, "customer").where("c_acctbal > 9800").select(F.col("c_nationkey").alias("n_nationkey"), F.col("c_name").alias("value"))
    own = n.where("n_regionkey < 3").select("n_nationkey", F.col("n_name").alias("value"))
    return relate.cascade(n.select("n_nationkey"), "n_nationkey", [("supplier", s), ("customer", c), ("nation", own)], "value")


@query("select doc_id, case when lang = 'en' then source else coalesce(cast(quality as varchar), '') end as source from documents left join (select doc_id, min(quality) as quality from labels group by 1) using (doc_id)")
def fill_blanks(spark, d):
    base = table(spark, d, "documents").select("doc_id", F.when(F.col("lang") == "en", F.col("source")).otherwise("").alias("source"))
    found = table(spark, d, "labels").groupBy("doc_id").agg(F.min("quality").cast("string").alias("source"))
    return relate.fill_blanks(base, found, "doc_id", "source")


@query("""with o as (select c_custkey, c_nationkey, [c_custkey % 40, c_custkey % 60] as ks from customer), f as (select s_nationkey as k, max(s_name) as v from supplier where s_suppkey % 3 = 0 group by 1), s as (select p_partkey as k, p_brand as v from part where p_partkey % 4 = 1),
b as (select c_custkey, coalesce(s1.v, s2.v) as v2 from o left join s s1 on ks[1] = s1.k left join s s2 on ks[2] = s2.k)
select o.c_custkey, coalesce(f.v, b.v2) as v, case when f.v is not null then 'first' when b.v2 is not null then 'second' else 'none' end as via from o left join f on o.c_nationkey = f.k left join b using (c_custkey)""")
def two_key_overlay(spark, d):
    base = table(spark, d, "customer").select("c_custkey", "c_nationkey", F.array(F.col("c_custkey") % 40, F.col("c_custkey") % 60).alias("ks"))
    first = table(spark, d, "supplier").where("s_suppkey % 3 = 0").groupBy(F.col("s_nationkey").alias("key")).agg(F.max("s_name").alias("v"))
    second = table(spark, d, "part").where("p_partkey % 4 = 1").select(F.col("p_partkey").alias("key"), F.col("p_brand").alias("v"))
    keyed = base.join(first.select(F.col("key").alias("c_nationkey"), F.col("v").alias("_f")), "c_nationkey", "left")
    by_row = keyed.where("_f is not null").select(F.col("c_custkey").alias("key"), F.col("_f").alias("v"))
    return relate.overlay(base, by_row, second, "c_custkey", "ks", "v").select("c_custkey", "v", "via")


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F' and o_orderkey % 5 = 0)")
def anti_join(spark, d):
    return table(spark, d, "customer").select("c_custkey").join(table(spark, d, "orders").where("o_orderstatus = 'F' and o_orderkey % 5 = 0").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("select c_custkey, exists (select 1 from orders where o_custkey = c_custkey) as has_orders from customer")
def semi_flag(spark, d):
    seen = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.lit(True).alias("has_orders")).distinct()
    return table(spark, d, "customer").select("c_custkey").join(seen, "c_custkey", "left").withColumn("has_orders", F.coalesce("has_orders", F.lit(False)))


@query("select p_partkey from part where not list_has_any(string_split(p_name, ' '), (select list(distinct split_part(p_name, ' ', 1)) from part where p_partkey < 3))")
def seed_complement(spark, d):
    p = table(spark, d, "part")
    seeds = p.where("p_partkey < 3").select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("seed"))
    return relate.without_tokens(p.select("p_partkey", "p_name"), F.split("p_name", " "), seeds, "seed").select("p_partkey")


@query("select b.item_id, d.doc_id from benchmark b join documents d on length(b.text) < length(d.text) and contains(d.text, b.text) where b.text <> ''")
def containment(spark, d):
    return relate.containment(table(spark, d, "benchmark"), table(spark, d, "documents"), "item_id", "text", "doc_id", "text")


@query("select a.doc_id as core, b.doc_id as superset, case when starts_with(b.text, a.text) then 'prefix' when ends_with(b.text, a.text) then 'suffix' else 'internal' end as place, length(b.text) - length(a.text) as delta from documents a join documents b on length(a.text) < length(b.text) and contains(b.text, a.text) where a.text <> ''")
def containment_documents(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    found = relate.containment_places(docs, docs, "doc_id", "text", "doc_id", "text")
    return found.withColumnsRenamed({"short_id": "core", "long_id": "superset"})


@query("""with u as (select o_custkey as r, o_orderkey as k, o_totalprice as score, 0 as src from orders where o_orderpriority = '1-URGENT' union all select o_custkey, o_orderkey, o_totalprice, 1 from orders),
o as (select *, row_number() over (partition by r, k order by src, score desc) as n from u), p as (select r, k, score, row_number() over (partition by r order by score desc, src, k) as place from o where n = 1) select r, k, score, place from p where place <= 5""")
def merged_candidates(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("r"), F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("score"), "o_orderpriority")
    return relate.candidates([o.where("o_orderpriority = '1-URGENT'"), o], "r", "k", [F.col("score").desc()], 5).select("r", "k", "score", F.col("place").cast("long").alias("place"))


@query("""with t as (select c_custkey, n_nationkey, n_regionkey from customer join nation on c_nationkey = n_nationkey), s as (select s_suppkey, n_nationkey, n_regionkey from supplier join nation on s_nationkey = n_nationkey)
select c_custkey, case when s.s_suppkey is null then 'uncomparable' when c_custkey = s.s_suppkey and t.n_nationkey = s.n_nationkey then 'same_species' when t.n_nationkey = s.n_nationkey then 'same_species' when t.n_regionkey = s.n_regionkey then 'same_genus' else 'mismatch' end as flag from t left join s on c_custkey = s_suppkey""")
def lineage_flag(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    c = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.struct(F.concat(F.lit("c"), "c_custkey").alias("taxid"), F.col("n_nationkey").alias("species"), F.col("n_regionkey").alias("genus")).alias("a"))
    s = table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("c_custkey"), F.struct(F.concat(F.lit("s"), "s_suppkey").alias("taxid"), F.col("n_nationkey").alias("species"), F.col("n_regionkey").alias("genus")).alias("b"))
    return c.join(s, "c_custkey", "left").select("c_custkey", rules.organism_label(F.col("a"), F.col("b")).alias("flag"))


# --- grouping --------------------------------------------------------------------------------------------------------


@query("with f as (select user_id, event_type, min(event_id) as o from events group by 1, 2) select user_id, string_agg(event_type, ';' order by o) as types from f group by user_id")
def ordered_merge(spark, d):
    listed = collapse.ordered_lists(table(spark, d, "events"), "user_id", F.col("event_type"), "event_id", "types")
    return listed.select("user_id", F.array_join("types", ";").alias("types"))


@query("with e as (select p_brand, p_partkey, unnest(string_split(p_name, ' ')) as entry, generate_subscripts(string_split(p_name, ' '), 1) as pos from part), f as (select p_brand, trim(entry) as entry, min((p_partkey, pos)) as place from e where trim(entry) <> '' group by 1, 2) select p_brand, string_agg(entry, ';' order by place) as words from f group by p_brand")
def ordered_entries(spark, d):
    """The words of each brand's part names, by the first part that has them."""
    listed = collapse.ordered_lists(table(spark, d, "part"), "p_brand", F.split("p_name", " "), "p_partkey", "words")
    return listed.select("p_brand", F.array_join("words", ";").alias("words"))


@query("select user_id, string_agg(distinct event_type, ';' order by event_type) as types, count(*) as n from events group by 1")
def distinct_set_agg(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.array_join(collapse.value_set("event_type"), ";").alias("types"), F.count("*").alias("n"))


@query(f"with k as (select doc_id, {LETTERS} as l from documents), g as (select l, count(*) as n, min(doc_id) as first_id from k where l <> '' group by l having count(*) > 1), r as (select *, row_number() over (order by first_id) as gid from g) select doc_id, gid, n, first_id from k join r using (l)")
def dup_groups(spark, d):
    docs = table(spark, d, "documents").select("doc_id", text.sequence_key("text").alias("h"))
    return collapse.duplicate_groups(docs, "h", "doc_id")


@query("select doc_id, lang, source from (select *, row_number() over (partition by lang, source order by n_chars desc, doc_id) as n from documents) where n = 1")
def keep_first(spark, d):
    return collapse.keep_first(table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars"), ["lang", "source"], [F.col("n_chars").desc(), "doc_id"]).select("doc_id", "lang", "source")


@query("select l_returnflag, list_sort(list(l_extendedprice))[cast(floor(count(*) / 2) as int) + 1] as upper_median from lineitem where l_extendedprice is not null group by 1")
def upper_median(spark, d):
    return collapse.upper_median_of(table(spark, d, "lineitem"), "l_extendedprice", ["l_returnflag"])


@query("select count(*) as n, sum(n_chars)::bigint as total, min(n_chars) as least, max(n_chars) as most, count_if(n_chars < 100) as under_100, count_if(n_chars < 200) as under_200, count(distinct lang) as langs from documents")
def stats_block(spark, d):
    return table(spark, d, "documents").agg(F.count("*").alias("n"), F.sum("n_chars").alias("total"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"), F.count_if(F.col("n_chars") < 100).alias("under_100"), F.count_if(F.col("n_chars") < 200).alias("under_200"), F.count_distinct("lang").alias("langs"))


@query("with o as (select * from (values ('en', 0), ('xx', 1)) t(lang, place)), c as (select lang, count(*) as n from documents group by 1) select coalesce(o.lang, c.lang) as lang, coalesce(n, 0) as n, coalesce(place, 2) as place from o full join c on o.lang = c.lang")
def listed_counts(spark, d):
    return collapse.listed_counts(table(spark, d, "documents").select("lang"), "lang", ["en", "xx"])


@query("with m as (select o_custkey, count(*) as n from orders group by 1) select o_custkey, n, string_agg(o_orderkey || ':' || o_orderpriority, '; ' order by o_totalprice desc, o_orderkey) as members from orders join m using (o_custkey) group by 1, 2")
def membership_rollup(spark, d):
    parts = F.sort_array(F.collect_list(F.struct((-F.col("o_totalprice")).alias("k"), "o_orderkey", "o_orderpriority")))
    g = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), parts.alias("m"))
    return g.select("o_custkey", "n", F.array_join(F.transform("m", lambda m: F.concat(m["o_orderkey"].cast("string"), F.lit(":"), m["o_orderpriority"])), "; ").alias("members"))


@query("select l_suppkey, l_orderkey, l_linenumber, place from (select *, row_number() over (partition by l_suppkey order by l_extendedprice desc, l_orderkey, l_linenumber) as place from lineitem) where place <= 5")
def topk_per_group(spark, d):
    w = Window.partitionBy("l_suppkey").orderBy(F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber")
    return table(spark, d, "lineitem").withColumn("place", F.row_number().over(w).cast("long")).where("place <= 5").select("l_suppkey", "l_orderkey", "l_linenumber", "place")


@query("with b as (select l_partkey, max(l_quantity) as q from lineitem group by 1), r as (select l_partkey, l_quantity, l_linenumber, row_number() over (partition by l_partkey order by l_quantity desc, l_linenumber desc) as n from lineitem) select l_partkey, l_quantity as score, round((l_linenumber - 1 + 1) / 7.0, 6) as coverage from r where n = 1")
def domain_coverage(spark, d):
    hits = table(spark, d, "lineitem").select("l_partkey", F.col("l_quantity").alias("score"), F.lit(1.0).alias("hmm_from"), F.col("l_linenumber").cast("double").alias("hmm_to"), F.lit(7.0).alias("query_length"))
    return collapse.coverage(hits, "l_partkey").withColumn("coverage", F.round("coverage", 6))


@query("select case when l_quantity < 10 then 'low' when l_quantity < 30 then 'mid' else 'high' end as bin, round(avg(l_extendedprice), 4) as mean, round(quantile_cont(l_extendedprice, 0.5), 4) as median, round(quantile_cont(l_extendedprice, 0.25), 4) as q1, round(quantile_cont(l_extendedprice, 0.75), 4) as q3, round(stddev_pop(l_extendedprice), 4) as sd from lineitem group by 1")
def robust_stats(spark, d):
    bins = F.when(F.col("l_quantity") < 10, "low").when(F.col("l_quantity") < 30, "mid").otherwise("high")
    rows = table(spark, d, "lineitem").select(bins.alias("bin"), "l_extendedprice")
    quartiles = collapse.quantiles(rows, "l_extendedprice", {"median": 0.5, "q1": 0.25, "q3": 0.75}, ["bin"])
    moments = rows.groupBy("bin").agg(F.avg("l_extendedprice").alias("mean"), F.stddev_pop("l_extendedprice").alias("sd"))
    return moments.join(quartiles, "bin", "left").select("bin", *(F.round(c, 4).alias(c) for c in ("mean", "median", "q1", "q3", "sd")))


@query("""with h as (select l_orderkey + 1.0 as e, l_quantity as bits, l_linenumber::double as m, (l_partkey + 1)::double as n from lineitem), v as (select log10(e) + bits * log10(2.0) as base, m, n from h), x as (select base - log10(unnest([1.0::double, m, n, m * n, m * 5000, 5000, m * 70, 5000.0 * 70, m * 5000 * 70])) as x, unnest(['const', 'm(query)', 'n(target)', 'm*n', 'm*N', 'N', 'm*Ndb', 'N*Ndb', 'm*N*Ndb']) as model from v)
select model, round(avg(x), 6) as log10_k, round(stddev_pop(x), 6) as spread, row_number() over (order by round(stddev_pop(x), 9), model) as place from x group by model""")
def model_selection(spark, d):
    hits = table(spark, d, "lineitem").select((F.col("l_orderkey") + 1.0).alias("evalue"), F.col("l_quantity").alias("bits"), F.col("l_linenumber").cast("double").alias("query_length"), (F.col("l_partkey") + 1).cast("double").alias("target_length"))
    return align.search_space_models(hits, 5000, 70).select("model", F.round("log10_k", 6).alias("log10_k"), F.round("spread", 6).alias("spread"), "place")


@query("""with r as (select l_suppkey as model, l_partkey as target, l_linenumber, row_number() over (partition by l_suppkey, l_partkey order by l_quantity desc, l_linenumber desc) as k from lineitem where l_linenumber > 2), f as (select model, count(*) as detected, avg(l_linenumber / 7.0) as mean, min(l_linenumber / 7.0) as least from r where k = 1 group by 1), s as (select l_suppkey as model, count(distinct l_partkey) as n from lineitem group by 1)
select model, n, coalesce(detected, 0) as detected, round(coalesce(mean, 0), 6) as mean, round(coalesce(least, 0), 6) as least, concat_ws(';', case when coalesce(detected, 0) < n then 'undetected=' || (n - coalesce(detected, 0)) end, case when coalesce(mean, 0) < 0.7 then 'low_member_coverage' end, case when n = 1 then 'singleton_model' end) as flags from s left join f using (model)""")
def domain_summary(spark, d):
    l = table(spark, d, "lineitem")  # noqa: E741
    hits = l.where("l_linenumber > 2").select(F.col("l_suppkey").alias("model"), F.col("l_partkey").alias("target"), F.col("l_quantity").alias("score"), F.lit(1.0).alias("hmm_from"), F.col("l_linenumber").cast("double").alias("hmm_to"), F.lit(7.0).alias("query_length"))
    sizes = l.groupBy(F.col("l_suppkey").alias("model")).agg(F.count_distinct("l_partkey").alias("n"))
    return collapse.domain_summary(hits, "model", "target", sizes, 0.7).withColumns({"mean": F.round("mean", 6), "least": F.round("least", 6)})


@query("select t as threshold, count_if(n_chars >= t) as n_docs, count(distinct case when n_chars >= t then lang end) as n_langs from documents, (values (100), (500), (1000), (2000), (4000)) v(t) group by t")
def threshold_sweep(spark, d):
    steps = F.explode(F.array(*map(F.lit, (100, 500, 1000, 2000, 4000)))).alias("threshold")
    return table(spark, d, "documents").select("lang", "n_chars", steps).groupBy("threshold").agg(F.count_if(F.col("n_chars") >= F.col("threshold")).alias("n_docs"), F.count_distinct(F.when(F.col("n_chars") >= F.col("threshold"), F.col("lang"))).alias("n_langs"))


@query("with c as (select l_linenumber as pos, l_returnflag as residue, count(*) as n from lineitem group by 1, 2), p as (select pos, residue, n / sum(n) over (partition by pos) as p from c), i as (select *, greatest(sum(p * log2(p / (1 / 3.0))) over (partition by pos), 0) as info from p) select pos, residue, round(p, 6) as p, round(info * p, 6) as height from i")
def logo_heights(spark, d):
    c = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("pos"), F.col("l_returnflag").alias("residue")).agg(F.count("*").alias("n"))
    p = c.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("pos")))
    third = 1 / 3.0
    return records.column_heights(p, {"A": third, "N": third, "R": third}).select("pos", "residue", F.round("p", 6).alias("p"), F.round("height", 6).alias("height"))


# --- rules -----------------------------------------------------------------------------------------------------------

FLAGS = "o_orderkey % 7 <> 0 as resolves, o_orderkey % 5 <> 0 as is_protein, o_orderkey % 11 <> 0 as is_current, case o_orderkey % 4 when 0 then 'family_conflict' when 1 then 'concordant' when 2 then 'title_unmapped' else 'uninformative_title' end as name_flag, case o_orderkey % 6 when 0 then 'doi_match' when 1 then 'elink_failed' else 'unlinked' end as paper_flag, case o_orderkey % 9 when 0 then 'seq_in_supp' else 'no_sequence' end as seq_flag, case o_orderkey % 13 when 0 then 'mismatch' else 'exact' end as org_flag, case o_orderkey % 8 when 0 then 'uniprot' else 'refseq' end as kind"


@query(f"""with f as (select o_orderkey, {FLAGS} from orders), l as (select o_orderkey, case when kind in ('uniprot', 'mgnify') and not resolves then 'external_database' when not resolves then 'broken_accession' when not is_protein then 'wrong_molecule' when not is_current then 'obsolete_record'
 when name_flag = 'family_conflict' and seq_flag not in ('seq_in_supp', 'acc_in_supp') then 'family_conflict' when paper_flag = 'doi_match' then 'confirmed' when seq_flag in ('seq_in_supp', 'acc_in_supp') then 'confirmed_supp' when name_flag = 'title_unmapped' then 'title_unmapped' when org_flag = 'mismatch' then 'organism_mismatch'
 when name_flag = 'concordant' then 'name_supported' when name_flag = 'uninformative_title' then 'unverifiable_title' when paper_flag = 'elink_failed' then 'fetch_error' else 'unconfirmed' end as label from f)
select o_orderkey, label, coalesce(list_position(['broken_accession','wrong_molecule','provenance_mismatch','obsolete_record','family_conflict','title_unmapped','organism_mismatch','external_database','fetch_error','unverifiable_title','unconfirmed'], label) - 1, 99) as priority from l""")
def ordered_rules(spark, d):
    k = F.col("o_orderkey")
    flags = {
        "kind": F.when(k % 8 == 0, "uniprot").otherwise("refseq"),
        "resolves": k % 7 != 0,
        "is_protein": k % 5 != 0,
        "is_current": k % 11 != 0,
        "name_flag": F.when(k % 4 == 0, "family_conflict").when(k % 4 == 1, "concordant").when(k % 4 == 2, "title_unmapped").otherwise("uninformative_title"),
        "paper_flag": F.when(k % 6 == 0, "doi_match").when(k % 6 == 1, "elink_failed").otherwise("unlinked"),
        "seq_flag": F.when(k % 9 == 0, "seq_in_supp").otherwise("no_sequence"),
        "org_flag": F.when(k % 13 == 0, "mismatch").otherwise("exact"),
    }
    label = rules.confidence(*flags.values())
    return table(spark, d, "orders").select("o_orderkey", label.alias("label")).withColumn("priority", rules.priority(F.col("label"), rules.REVIEW))


@query("select l as priority_label, count(*) as n from (select case when p_size % 4 = 0 then 'wrong_molecule' when p_size % 4 = 1 then 'confirmed' when p_size % 4 = 2 then 'unconfirmed' else 'family_conflict' end as l from part) where l <> 'confirmed' group by 1")
def priority_queue(spark, d):
    k = F.col("p_size") % 4
    label = F.when(k == 0, "wrong_molecule").when(k == 1, "confirmed").when(k == 2, "unconfirmed").otherwise("family_conflict")
    queue = table(spark, d, "part").select(label.alias("priority_label")).withColumn("at", rules.priority(F.col("priority_label"), rules.REVIEW)).where("at < 99")
    return queue.groupBy("priority_label").agg(F.count("*").alias("n"))


@query("select p_partkey, case when p_size >= 40 and p_partkey % 3 >= 2 and p_partkey % 2 >= 1 then 'remap_strong' when p_size > 10 then 'remap_plausible' when p_partkey % 5 >= 1 then 'self_corroborated' else 'remap_none' end as decision from part")
def remap_decision(spark, d):
    identity = F.when(F.col("p_size") > 10, F.when(F.col("p_size") >= 40, 99.5).otherwise(95.0))
    return table(spark, d, "part").select("p_partkey", rules.remap_label(identity, F.col("p_partkey") % 3, F.col("p_partkey") % 2, F.col("p_partkey") % 5).alias("decision"))


@query("select p_partkey, case when p_size between 1 and 5 then 'edited' else p_brand end as p_brand from part")
def guarded_edits(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    edits = p.where("p_size between 1 and 5").select("p_partkey", F.col("p_brand").alias("before"), F.lit("edited").alias("after"))
    return rules.guarded_edits(p, edits, "p_partkey", "p_brand").select("p_partkey", "p_brand")


# --- graph -----------------------------------------------------------------------------------------------------------

PAIR = "select least(l_partkey, l_suppkey) as a, greatest(l_partkey, l_suppkey) as b, l_discount * 1000 as pct_id, l_tax * 1e-4 as evalue, l_quantity as bits, l_orderkey * 10 + l_linenumber as ord from lineitem where l_partkey <> l_suppkey"


def _pairs(spark, d):
    return table(spark, d, "lineitem").select("l_partkey", "l_suppkey", (F.col("l_discount") * 1000).alias("pct"), (F.col("l_tax") * 1e-4).alias("ev"), F.col("l_quantity").alias("bits"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))


def _best(spark, d, rule):
    b = graph.best_pairs(_pairs(spark, d), "l_partkey", "l_suppkey", "pct", "ev", "bits", "ord", rule)
    return b.select("a", "b", F.round("pct_id", 6).alias("pct_id"), F.round("evalue", 9).alias("evalue"), "bits")


@query(f"select a, b, round(pct_id, 6) as pct_id, round(evalue, 9) as evalue, bits from (select *, row_number() over (partition by a, b order by bits desc, evalue, ord) as n from ({PAIR})) where n = 1")
def best_pair(spark, d):
    return _best(spark, d, "max_bits")


@query(f"select a, b, round(pct_id, 6) as pct_id, round(evalue, 9) as evalue, bits from (select *, row_number() over (partition by a, b order by pct_id desc, bits desc, evalue, ord) as n from ({PAIR})) where n = 1")
def best_pair_by_identity(spark, d):
    return _best(spark, d, "max_identity")


@query(f"select a, b, round(pct_id, 6) as pct_id, round(evalue, 9) as evalue, bits from (select *, row_number() over (partition by a, b order by bits desc, evalue, ord) as n from ({PAIR}) where pct_id >= 30 and evalue < 1e-5) where n = 1")
def best_pair_any(spark, d):
    return _best(spark, d, "any")


@query(f"select a, b, round(pct_id, 6) as pct_id, round(evalue, 9) as evalue, bits from (select *, row_number() over (partition by a, b order by bits desc, evalue, ord) as n from ({PAIR})) where n = 1 and round(pct_id, 6) >= 30 and round(evalue, 9) < 1e-5")
def edge_post_filter(spark, d):
    return graph.edges(_best(spark, d, "max_bits"))


STARS = "with l as (select distinct doc_id, line from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line from documents) where length(line) >= {n}), s as (select line, min(doc_id) as a from l group by line), e as (select distinct a, doc_id as b from l join s using (line) where a <> doc_id)"


def _stars(spark, d, n=60):
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(F.split(F.coalesce("text", F.lit("")), "\n", -1))).alias("line")).where(F.length("line") >= n).select("doc_id", F.md5("line").alias("h"))
    least = lines.groupBy("h").agg(F.min("doc_id").alias("a"), F.count("*").alias("k")).where("k > 1").select("h", "a")
    return lines.join(least, "h").where("a <> doc_id").select("a", F.col("doc_id").alias("b")).distinct()


@query(STARS.format(n=60) + " select a, b from e")
def line_share_edges(spark, d):
    return _stars(spark, d)


COMPONENTS = STARS.format(n=60).replace("with l", "with recursive l") + ", u as (select a, b from e union select b, a from e), w as (select doc_id as node, doc_id as seen from documents union select w.node, u.b from w join u on w.seen = u.a), c as (select node, min(seen) as root from w group by node)"


def _components(spark, d):
    return graph.partition(table(spark, d, "documents"), "doc_id", _stars(spark, d)).withColumnRenamed("doc_id", "node")


@query(COMPONENTS + " select node, root from c")
def components(spark, d):
    return _components(spark, d)


@query(COMPONENTS + ", z as (select root, count(*) as size from c group by root) select root, size, 'C' || lpad(cast(row_number() over (order by root) as varchar), 6, '0') as component_id, row_number() over (order by size desc, root) as size_rank from z")
def component_numbering(spark, d):
    sizes = _components(spark, d).groupBy("root").agg(F.count("*").alias("size"))
    by_key = numbered(sizes, "root", name="key_place")
    placed = numbered(by_key, F.col("size").desc(), F.col("root"), name="size_place")
    return placed.select("root", "size", F.concat(F.lit("C"), F.lpad((F.col("key_place") + 1).cast("string"), 6, "0")).alias("component_id"), (F.col("size_place") + 1).alias("size_rank"))


@query(COMPONENTS + ", z as (select root, count(*) as size from c group by root) select size, count(*) as n_groups, (size * count(*))::bigint as n_records, round(100 * count(*) / sum(count(*)) over (), 3) as pct_groups from z group by size")
def size_histogram(spark, d):
    return collapse.histogram(_components(spark, d).groupBy("root").agg(F.count("*").alias("size")), "size")


@query(COMPONENTS + " select root, count(*) as size from c group by root order by size desc, root limit 10")
def top10_sizes(spark, d):
    return _components(spark, d).groupBy("root").agg(F.count("*").alias("size")).orderBy(F.col("size").desc(), "root").limit(10)


@query(COMPONENTS + " select source, string_agg(distinct root, ',' order by root) as components, count(distinct root) as n from c join documents on node = doc_id where root in (select root from c group by root having count(*) > 1) group by source having count(distinct root) > 1")
def label_split(spark, d):
    c = _components(spark, d)
    big = c.groupBy("root").agg(F.count("*").alias("k")).where("k > 1").select("root")
    members = c.join(big, "root").join(table(spark, d, "documents").select(F.col("doc_id").alias("node"), "source"), "node")
    return graph.label_split(members, "source", "root").select("source", F.array_join(F.transform("components", lambda x: x.cast("string")), ",").alias("components"), F.size("components").cast("long").alias("n"))


PRIOR = COMPONENTS + f", p as (select doc_id as node, min(doc_id) over (partition by {LETTERS}) as prior from documents)"


def _two(spark, d):
    prior = table(spark, d, "documents").select(F.col("doc_id").alias("node"), text.letters("text").alias("l")).withColumn("l", F.md5("l"))
    least = prior.groupBy("l").agg(F.min("node").alias("prior"))
    return _components(spark, d), prior.join(least, "l").select("node", "prior")


@query(PRIOR + " select root, prior, count(*) as n from c join p using (node) group by 1, 2")
def crosstab(spark, d):
    c, p = _two(spark, d)
    return compare.crosstab(c, p, "node", "root", "prior")


@query(PRIOR + """, t as (select root, prior, count(*) as n from c join p using (node) group by 1, 2), pooled as (select (select sum(n * (n - 1) / 2.0) from t) as "both", (select sum(n) from t) as nodes, (select sum(n * (n - 1) / 2.0) from (select sum(n) as n from t group by root)) as x, (select sum(n * (n - 1) / 2.0) from (select sum(n) as n from t group by prior)) as y)
select nodes::bigint as nodes, "both"::bigint as "both", (x - "both")::bigint as a_only, (y - "both")::bigint as b_only, round((nodes * (nodes - 1) / 2.0 + 2 * "both" - x - y) / (nodes * (nodes - 1) / 2.0), 6) as rand, round(("both" - x * y / (nodes * (nodes - 1) / 2.0)) / ((x + y) / 2 - x * y / (nodes * (nodes - 1) / 2.0)), 6) as ari from pooled""")
def partition_ari(spark, d):
    c, p = _two(spark, d)
    return compare.agreement(compare.crosstab(c, p, "node", "root", "prior"), "root", "prior")


@query(PRIOR + ", t as (select root, prior, count(*) as n from c join p using (node) group by 1, 2), z as (select prior, sum(n) as sz from t group by 1), r as (select t.*, row_number() over (partition by root order by n desc, sz desc, prior) as k, sum(n) over (partition by root) as size, count(*) over (partition by root) as n_partners from t join z using (prior)) select root, prior, n as shared, size::bigint as size, n_partners from r where k = 1")
def dominant_match(spark, d):
    c, p = _two(spark, d)
    return compare.dominant(compare.crosstab(c, p, "node", "root", "prior"), "root", "prior")


@query(PRIOR + ", t as (select root, prior, count(*) as n from c join p using (node) group by 1, 2), a as (select root, count(*) as targets, sum(n) as size from t group by 1), b as (select prior, count(*) as sources from t group by 1) select root, max(targets) as targets, max(sources) as sources, max(size)::bigint as size, case when max(targets) = 1 and max(sources) = 1 then 'kept' when max(targets) = 1 then 'absorbed' when max(sources) = 1 then 'split' else 'mixed' end as change from t join a using (root) join b using (prior) group by root")
def partition_changes(spark, d):
    c, p = _two(spark, d)
    return compare.changes(compare.crosstab(c, p, "node", "root", "prior"), "root", "prior")


@query(PRIOR + ", t as (select root, prior, count(*) as n from c join p using (node) group by 1, 2), a as (select root, count(*) as na from c group by 1), b as (select prior, count(*) as nb from p group by 1) select root, prior, n from t join a using (root) join b using (prior) where n = na and n = nb")
def same_members(spark, d):
    c, p = _two(spark, d)
    return compare.same_members(c, p, "node", "root", "prior")


@query(PRIOR + ", m as (select root, case when node % 3 = 0 then null else prior end as prior from c join p using (node)) select root, count_if(prior is null) as n_new, count(distinct prior) as n_prior, case when count(distinct prior) = 0 then 'novel' when count(distinct prior) > 1 then 'merge' else 'join' end as outcome from m group by root having count_if(prior is null) > 0")
def baseline_outcome(spark, d):
    c, p = _two(spark, d)
    m = c.join(p, "node").withColumn("prior", F.when(F.col("node") % 3 != 0, F.col("prior")))
    return graph.delta_outcome(m, "root", "prior")


@query(PRIOR + """, m as (select root, case when node % 3 <> 0 then prior end as prior from c join p using (node)), kk as (select root, list_sort(list(distinct prior) filter (prior is not null)) as labels, count(*) as size from m group by root),
wp as (select prior, count(distinct root) as n from m where prior is not null group by prior), sg as (select root, size, labels[1] as label, n, row_number() over (partition by labels[1] order by size desc, root) as letter from kk join wp on labels[1] = wp.prior where len(labels) = 1)
select root, size, case when n = 1 then 'inherited' else 'split' end as kind, label::varchar || case when n = 1 then '' when letter <= 26 then chr((96 + letter)::int) else 'z' || letter end as name from sg
union all select root, size, 'merged', 'M' || labels[1] from kk where len(labels) > 1 union all select root, size, 'novel', 'N' || row_number() over (order by root) from kk where coalesce(len(labels), 0) = 0""")
def inherited_labels(spark, d):
    c, p = _two(spark, d)
    m = c.join(p, "node").withColumn("prior", F.when(F.col("node") % 3 != 0, F.col("prior")))
    return graph.inherit_labels(m, "root", "prior")


@query(STARS.format(n=60) + ", l2 as (select distinct doc_id, line from l where length(line) >= 100), s2 as (select line, min(doc_id) as a from l2 group by line), e2 as (select distinct a, doc_id as b from l2 join s2 using (line) where a <> doc_id), j as (select e.a as ea, e2.a as e2a from e full join e2 on e.a = e2.a and e.b = e2.b) select count_if(ea is not null and e2a is not null) as both, count_if(e2a is null) as a_only, count_if(ea is null) as b_only, round(count_if(ea is not null and e2a is not null) / count(*), 6) as jaccard from j")
def edge_jaccard(spark, d):
    return compare.set_overlap(_stars(spark, d, 60), _stars(spark, d, 100), ["a", "b"])


@query("select coalesce(o_custkey, user_id) as k, case when user_id is null then 'a_only' when o_custkey is null then 'b_only' else 'both' end as presence from (select distinct o_custkey from orders) full join (select distinct user_id from events) on o_custkey = user_id")
def node_presence(spark, d):
    return compare.presence(table(spark, d, "orders").select(F.col("o_custkey").alias("k")), table(spark, d, "events").select(F.col("user_id").alias("k")), ["k"])


@query(STARS.format(n=60) + " select node, count(*) as degree from (select a as node from e union all select b from e) group by 1")
def degrees(spark, d):
    return graph.degrees(_stars(spark, d))


@query(STARS.format(n=60) + " select e.a, e.b from e join documents x on x.doc_id = e.a and x.lang = 'en' join documents y on y.doc_id = e.b and y.lang = 'en'")
def induced_edges(spark, d):
    return graph.induced(_stars(spark, d), table(spark, d, "documents").where("lang = 'en'"), "doc_id")


@query("""with recursive l as (select a.doc_id as a, b.doc_id as b from documents a join documents b on length(a.text) < length(b.text) and contains(b.text, a.text) where a.text <> ''), u as (select a, b from l union select b, a from l), w as (select a as node, a as seen from u union select w.node, u.b from w join u on w.seen = u.a), r as (select node, min(seen) as root from w group by node),
h as (select node as doc_id, root, text from r join documents on node = doc_id), k as (select root, min_by(doc_id, (length(text), doc_id)) as core from h group by root)
select core as core_doc, h.doc_id, case when h.doc_id = core then 'core' else 'superset' end as role, length(h.text) - length(x.text) as delta, case when h.doc_id = core then 'core' when starts_with(h.text, x.text) then 'prefix' when ends_with(h.text, x.text) then 'suffix' when contains(h.text, x.text) then 'internal' else 'chain' end as place from h join k using (root) join documents x on x.doc_id = core""")
def substring_groups(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text").where("text <> ''")
    links = relate.containment(docs, docs, "doc_id", "text", "doc_id", "text")
    return variants.substring_groups(docs, "doc_id", "text", links, "short_id", "long_id").withColumnRenamed("group", "core_doc")


def _links(spark, d):
    return table(spark, d, "lineitem").where("l_partkey <> l_suppkey").groupBy(F.col("l_partkey").alias("node"), F.col("l_suppkey").alias("other")).agg(F.max(F.round(F.col("l_discount") * 10, 3)).alias("cover"))


@query("with l as (select l_partkey as node, l_suppkey as other, max(round(l_discount * 10, 3)) as cover from lineitem where l_partkey <> l_suppkey group by 1, 2), s as (select s_suppkey as other, s_suppkey as ord from supplier where s_suppkey % 5 = 0), r as (select node, other as centroid, cover, row_number() over (partition by node order by cover desc, ord) as k from l join s using (other) where cover >= 0.9 and node not in (select other from s)) select node, centroid, cover from r where k = 1")
def recruit(spark, d):
    seeds = table(spark, d, "supplier").where("s_suppkey % 5 = 0").select(F.col("s_suppkey").alias("node"), F.col("s_suppkey").alias("ord"))
    return cluster.recruit(_links(spark, d), seeds, 0.9)


@query()
def seeded_clusters(spark, d):
    nodes = table(spark, d, "part").select(F.col("p_partkey").alias("node"), F.col("p_partkey").alias("ord"), F.col("p_size").cast("long").alias("len"))
    seeds = table(spark, d, "supplier").where("s_suppkey % 5 = 0").select(F.col("s_suppkey").alias("node"), F.col("s_suppkey").alias("ord")).join(nodes.select("node").hint("merge"), "node", "left_semi")
    return cluster.seeded(nodes, _links(spark, d), seeds, 0.9)


@query()
def local_alignment(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", text.letters("n_name").alias("seq"))
    pairs = align.shared_words(n, "n_nationkey", "seq", k=1, least=2)
    a, b = n.select(F.col("n_nationkey").alias("a"), F.col("seq").alias("sa")), n.select(F.col("n_nationkey").alias("b"), F.col("seq").alias("sb"))
    out = align.align_pairs(pairs.join(a, "a").join(b, "b"), "a", "b", "sa", "sb", 200)
    return out.withColumn("class", align.identity_class(F.col("pct_id"), F.lit(False)))


@query()
def fuzzy_ratio(spark, d):
    return table(spark, d, "part").select("p_partkey", align.fuzzy_ratio("p_name", "p_type").alias("ratio"), align.block_coverage("p_type", "p_name").alias("coverage"))


# --- evidence --------------------------------------------------------------------------------------------------------


@query("with h as (select l_partkey, l_suppkey, l_discount * 1000 as identity, l_quantity as bits, l_linenumber as q_from, l_linenumber + 5 as q_to, 60 as query_length, l_orderkey from lineitem), r as (select *, row_number() over (partition by l_partkey, l_suppkey order by bits desc, identity desc) as n from h) select l_partkey, l_suppkey, round(max(case when n = 1 then identity end), 1) as identity, max(bits) as bits, round(least(100.0, 100.0 * count(*) * 6 / 60), 1) as coverage from r group by 1, 2")
def hit_rollup(spark, d):
    h = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", (F.col("l_discount") * 1000).alias("identity"), F.col("l_quantity").alias("bits"), F.col("l_linenumber").alias("q_from"), (F.col("l_linenumber") + 5).alias("q_to"), F.lit(60).alias("query_length"))
    return evidence.hit_rollup(h, "l_partkey", "l_suppkey")


@query("with r as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) as pos, o_orderstatus = 'P' as s, o_orderpriority = '1-URGENT' as a, o_orderpriority = '2-HIGH' as t from orders), g as (select o_custkey, min(case when s then pos end) as ps, max(case when a then pos end) as pa, min(case when t then pos end) as pt from r group by 1) select g.o_custkey, case when ps is not null then 'sequence' when pa is not null then 'accession' when pt is not null then 'accession_maintext' else 'none' end as match_kind, r.o_orderkey as paper from g left join r on g.o_custkey = r.o_custkey and r.pos = coalesce(ps, pa, pt)")
def cited_match(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    rows = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("paper"), F.row_number().over(w).alias("pos"), (F.col("o_orderstatus") == "P").alias("by_sequence"), (F.col("o_orderpriority") == "1-URGENT").alias("by_accession"), (F.col("o_orderpriority") == "2-HIGH").alias("by_text"))
    return evidence.cited_match(rows, "o_custkey")


@query("select o_custkey, coalesce(min(case when refseq then o_orderkey end), min(o_orderkey)) as replacement from (select o_custkey, o_orderkey, o_orderkey % 4 = 0 as refseq from orders where o_orderkey <> o_custkey) group by 1")
def replacement_pick(spark, d):
    m = table(spark, d, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") % 4 == 0).alias("refseq"), F.col("o_orderkey").alias("ord"))
    return evidence.replacement(m, "o_custkey", "o_orderkey", "o_custkey", "refseq", "ord")


@query("select doc_id, length(text) as len_before, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) as len_after, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) - length(text) as delta from documents where upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) <> text")
def change_audit(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    out = evidence.change_audit(docs, docs.withColumn("text", text.letters("text")), "doc_id", "text")
    return out.select("doc_id", *(F.col(c).cast("long").alias(c) for c in ("len_before", "len_after", "delta")))


@query("with a as (select distinct s_nationkey as a, n_regionkey as surname from supplier join nation on s_nationkey = n_nationkey), b as (select distinct c_mktsegment as b, n_regionkey as surname from customer join nation on c_nationkey = n_nationkey) select a, b, count(*) as overlap from a join b using (surname) group by 1, 2")
def author_overlap(spark, d):
    authors = table(spark, d, "nation").select(F.col("n_nationkey").alias("paper"), F.col("n_regionkey").alias("surname"))
    a = table(spark, d, "supplier").select(F.col("s_nationkey").alias("a"), F.col("s_nationkey").alias("paper"))
    b = table(spark, d, "customer").select(F.col("c_mktsegment").alias("b"), F.col("c_nationkey").alias("paper"))
    return evidence.author_overlap(a, b, authors, "a", "b", "paper")


@query("select o_orderkey, (row_number() over (order by o_orderkey) - 1) // 50 as chunk from orders")
def request_chunks(spark, d):
    return evidence.chunked(table(spark, d, "orders").select("o_orderkey"), 50, "o_orderkey")


@query("select cast(regexp_extract(c_name, '(\\d+)', 1) as bigint) % 100 as key, count(*) as n, min(c_custkey) as first_id from customer group by 1 having count(*) > 1")
def number_collisions(spark, d):
    return evidence.collisions(table(spark, d, "customer"), text.first_number("c_name") % 100, "c_custkey")


# --- generic relational coverage -------------------------------------------------------------------------------------


@query("select l_returnflag, l_linestatus, count(*) as n, round(sum(l_quantity), 2) as qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, round(avg(l_discount), 6) as disc from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2")
def pricing_summary(spark, d):
    rows = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("disc"))


@query("select r_name, n_name, count(*) as n, round(sum(o_totalprice), 2) as total from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by rollup (r_name, n_name)")
def region_rollup(spark, d):
    o, c, n, r = (table(spark, d, t) for t in ("orders", "customer", "nation", "region"))
    joined = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return joined.rollup("r_name", "n_name").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("select c_mktsegment, o_orderpriority, count(*) as n from orders join customer on o_custkey = c_custkey group by cube (c_mktsegment, o_orderpriority)")
def segment_cube(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).cube("c_mktsegment", "o_orderpriority").agg(F.count("*").alias("n"))


@query("select o_custkey from orders intersect select user_id from events")
def set_intersect(spark, d):
    return table(spark, d, "orders").select("o_custkey").intersect(table(spark, d, "events").select(F.col("user_id").alias("o_custkey")))


@query("select o_custkey, o_orderkey, round(sum(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey rows between unbounded preceding and current row), 2) as running, lag(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as before from orders")
def running_totals(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.round(F.sum("o_totalprice").over(w.rowsBetween(Window.unboundedPreceding, 0)), 2).alias("running"), F.lag("o_orderkey").over(w).alias("before"))


@query("select count(distinct p_name) as names, count(distinct p_brand) as brands, count(distinct p_type) as types, count(distinct p_size) as sizes from part")
def distinct_profile(spark, d):
    return table(spark, d, "part").agg(*(F.count_distinct(c).alias(n) for c, n in (("p_name", "names"), ("p_brand", "brands"), ("p_type", "types"), ("p_size", "sizes"))))


@query("select date_trunc('hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as value from events group by 1, 2")
def event_windows(spark, d):
    return streaming.windowed(table(spark, d, "events")).select("start", "event_type", "n", F.round("value", 4).alias("value"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship query: documents collapsed by the md5 of their letters."""
    return md5_collapse(spark, sf_dir)
