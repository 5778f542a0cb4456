"""Queries of results that grow from run to run: clusters, rosters, overlays, look-ups, summaries; and of a search index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import text
from .operators import forward, summaries
from .plans.scratch import materialize
from .queries import LETTERS, _links, query, table
from .queries_files import _path


def _batches(spark, d) -> tuple[DataFrame, DataFrame]:
    """The small parts, and all of them."""
    nodes = table(spark, d, "part").select(F.col("p_partkey").alias("node"), F.col("p_partkey").alias("ord"), F.col("p_size").cast("long").alias("len"))
    return nodes.where("len < 25"), nodes


@query()
def forward_clusters(spark, d):
    first, nodes = _batches(spark, d)
    links, covers = materialize(_links(spark, d), "links"), [0.9, 0.6, 0.3]
    known = forward.extend_levels(None, first, links, covers)
    return forward.extend_levels(known.drop("how"), nodes, links, covers)


@query(f"""with k as (select doc_id, lang, md5({LETTERS}) as sequence_md5, length({LETTERS}) as length from documents where {LETTERS} <> ''), n as (select distinct sequence_md5 from k where lang = 'en')
select doc_id, sequence_md5, length, sequence_md5 not in (select sequence_md5 from n) as is_new from k""")
def node_roster(spark, d):
    docs = table(spark, d, "documents").withColumn("name", F.concat("source", F.lit("/"), "doc_id"))
    known = docs.where("lang = 'en'").withColumn("sequence", text.letters("text")).where("sequence <> ''").groupBy(F.md5("sequence").alias("sequence_md5")).agg(F.min("name").alias("accession"), F.min("lang").alias("label"))
    return forward.roster(docs, known, "doc_id", "name", "text")[1]


@query(f"""with k as (select md5({LETTERS}) as sequence_md5, lang, source || '/' || doc_id as name from documents where {LETTERS} <> '')
select sequence_md5, coalesce(min(case when lang = 'en' then name end), min(name)) as accession, case when bool_or(lang = 'en') then 'en' end as label, not coalesce(bool_or(lang = 'en'), false) as is_new from k group by 1""")
def roster_nodes(spark, d):
    docs = table(spark, d, "documents").withColumn("name", F.concat("source", F.lit("/"), "doc_id"))
    known = docs.where("lang = 'en'").withColumn("sequence", text.letters("text")).where("sequence <> ''").groupBy(F.md5("sequence").alias("sequence_md5")).agg(F.min("name").alias("accession"), F.min("lang").alias("label"))
    return forward.roster(docs, known, "doc_id", "name", "text")[0]


@query("""with p as (select p_partkey, case when p_size < 10 then '' else upper(regexp_replace(p_name, '[^A-Za-z]', '', 'g')) end as own, case when p_size < 20 then upper(regexp_replace(p_name || p_type, '[^A-Za-z]', '', 'g')) when p_size < 30 then upper(regexp_replace(p_name, '[^A-Za-z]', '', 'g')) end as better from part)
select p_partkey, coalesce(better, own) as sequence, case when better is null then 'own' when own = '' then 'rescued' when own <> better then 'revised' else 'same' end as outcome from p""")
def curated_overlay(spark, d):
    p = table(spark, d, "part")
    rows = p.select("p_partkey", F.when(F.col("p_size") < 10, "").otherwise(F.col("p_name")).alias("sequence"))
    curated = p.where("p_size < 30").select("p_partkey", F.when(F.col("p_size") < 20, F.concat("p_name", "p_type")).otherwise(F.col("p_name")).alias("sequence"))
    return forward.overlaid(rows, curated, "p_partkey", "sequence")


@query("""with k as (select distinct 'S' || l_suppkey as key, l_suppkey from lineitem union select distinct 'S' || c_custkey, c_custkey from customer)
select substr(sha256(key), 1, 24) as digest, key, case when s_suppkey is not null then 'found' else 'empty' end as status, s_name as answer from k left join supplier on s_suppkey = l_suppkey""")
def lookup_store(spark, d):
    """Two runs: the second finds what failed in the first, and looks up nothing else again."""
    answers = table(spark, d, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("key"), F.col("s_name").alias("answer"), "s_nationkey")
    first = table(spark, d, "lineitem").select(F.concat(F.lit("S"), "l_suppkey").alias("key"))
    second = first.unionByName(table(spark, d, "customer").select(F.concat(F.lit("S"), "c_custkey").alias("key")))

    def unsure(wanted: DataFrame) -> DataFrame:
        status = F.when(F.col("s_nationkey") < 5, F.lit(forward.FAILED)).otherwise(F.lit(forward.FOUND))
        return wanted.join(answers, "key").select("key", status.alias("status"), F.when(F.col("s_nationkey") >= 5, F.col("answer")).alias("answer"))

    def sure(wanted: DataFrame) -> DataFrame:
        return wanted.join(answers, "key").select("key", F.lit(forward.FOUND).alias("status"), "answer")

    return forward.looked_up(forward.looked_up(None, first, "key", unsure), second, "key", sure)


@query("select l_suppkey, count(*) as n, sum(l_quantity) as sum_l_quantity, round(avg(l_quantity), 6) as avg_l_quantity, min(l_quantity) as min_l_quantity, max(l_quantity) as max_l_quantity, (select l_returnflag from lineitem y where y.l_suppkey = x.l_suppkey group by 1 order by count(*) desc, 1 limit 1) as mode_l_returnflag, count(distinct l_returnflag) as distinct_l_returnflag, count(distinct l_partkey) as distinct_l_partkey from lineitem x group by l_suppkey")
def summary_views(spark, d):
    """A summary of the open and the returned items each, added up."""
    items = table(spark, d, "lineitem")
    by, sums, values = ["l_suppkey"], ["l_quantity"], ["l_returnflag", "l_partkey"]
    halves = (summaries.partial(items.where(c), by, sums, values) for c in ("l_returnflag = 'N'", "l_returnflag <> 'N'"))
    out = summaries.finished(summaries.merged(*halves, by), by, sums, values)
    return out.select("l_suppkey", "n", "sum_l_quantity", F.round("avg_l_quantity", 6).alias("avg_l_quantity"), "min_l_quantity", "max_l_quantity", "mode_l_returnflag", "distinct_l_returnflag", "distinct_l_partkey")


def _index(spark, d) -> str:
    path = _path(spark, "index")
    rows = [table(spark, d, t).select((F.col(k) * 4 + i).alias("row"), F.concat_ws(" ", *c).alias("text")) for i, (t, k, c) in enumerate((("part", "p_partkey", ["p_name", "p_brand"]), ("supplier", "s_suppkey", ["s_name"]), ("customer", "c_custkey", ["c_name", "c_mktsegment"])))]
    summaries.write_index(rows[0].unionByName(rows[1]).unionByName(rows[2]), "row", "text", path)
    return path


_KEYS = "with t as (select p_partkey * 4 as id, lower(p_name || ' ' || p_brand) as text from part union all select s_suppkey * 4 + 1, lower(s_name) from supplier union all select c_custkey * 4 + 2, lower(c_name || ' ' || c_mktsegment) from customer) "


@query(_KEYS + "select id as row, 2::bigint as terms from t where list_contains(string_split(text, ' '), 'ring') and list_contains(string_split(text, ' '), 'brand#7')")
def index_terms(spark, d):
    return summaries.find_terms(spark, _index(spark, d), ["ring", "Brand#7"])


@query(_KEYS + "select distinct term, id as row from (select id, unnest(string_split(text, ' ')) as term from t) where starts_with(term, 'brand#1') or starts_with(term, 'customer#00000001')")
def index_prefix(spark, d):
    path = _index(spark, d)
    return summaries.find_prefix(spark, path, "Brand#1").unionByName(summaries.find_prefix(spark, path, "customer#00000001"))
