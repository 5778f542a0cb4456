"""The queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe_round_trip
from .chat_format import format_chats
from .decontaminate import find_leaks
from .html_extract import extract_main_text
from .jaccard_join import jaccard_components
from .line_dedup import line_dedup
from .periodic_runs import find_periodic_runs
from .quality_rules import ALPHA, DELTA, LEVELS, quality_rules
from .simhash import simhash_components
from .spelling import spelling_variants
from .substring_dedup import substring_dedup
from .toxicity import score_toxicity, train
from .url_filter import filter_urls, glob, rule

#: The rules of the url filter, by verdict, host and path.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: Globs over paths that decide where no rule fits.
GLOBS = [("block", "/ads/*"), ("block", "*/login*"), ("block", "*/cart*"), ("block", "*.zip"), ("block", "*.exe")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(_table(spark, sf_dir, "pages"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    globs = [rule(*x) for x in RULES] + [glob(*x) for x in GLOBS]
    return filter_urls(_table(spark, sf_dir, "pages"), globs)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(_table(spark, sf_dir, "conversations"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = train(docs, labels.where(~held_out), "doc_id", "text")
    scored = score_toxicity(docs, model).withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    return scored.select("doc_id", "held_out", "score", "predicted", "spans")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(_table(spark, sf_dir, "documents"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(_table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_periodic_runs(_table(spark, sf_dir, "documents"), plant=True)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_rules, op2_html_extract, op3_url_filter, op4_decontaminate, op5_bpe, op6_chat_format, op7_jaccard_join, op8_toxicity, op9_substring_dedup, op10_line_dedup, op11_spelling, op12_simhash, op13_periodic_runs)}


OP3_SQL = r"""
with p as (
  select page_id, case when position('://' in coalesce(url, '')) = 0 then null else substr(url, position('://' in url) + 3) end as rest from pages
), h as (
  select page_id, coalesce(regexp_extract(rest, '^[^/?#]*'), '') as raw, coalesce(rest, '') as rest from p
), u as (
  select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') as path from h
), r(verdict, rhost, rpath) as (values ('allow','org','/'), ('block','example.org','/es/'), ('block','example.org','/en/1'), ('allow','com','/fr/'), ('block','com','/de/')),
f as (
  select page_id, max_by(rhost || rpath, length(rhost || rpath)) as rule, max_by(verdict, length(rhost || rpath)) as verdict
  from u join r on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath) group by page_id
)
select u.page_id, host, path, rule, coalesce(verdict,
  case when path glob '/ads/*' or path glob '*/login*' or path glob '*/cart*' or path glob '*.zip' or path glob '*.exe' then 'block' else 'allow' end) as verdict
from u left join f using (page_id)
"""


OP6_SQL = r"""
with t as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) as place, role, text from conversations
), c as (
  select conv_id, list([role, text] order by place) as said, count(*) as n_turns from t group by conv_id
), d as (
  select min(conv_id) as conv_id, said, n_turns, count(*) as n_copies from c group by said, n_turns
), p as (
  select distinct said[1:n] as said from (select said, unnest(range(1, n_turns)) as n from d)
), m as (select * from d where not exists (select 1 from p where p.said = d.said))
select m.conv_id, (t.place - 1) // 256 as part, m.n_turns, m.n_copies,
       string_agg('<|im_start|>' || coalesce(t.role, '') || chr(10) || coalesce(t.text, '') || '<|im_end|>' || chr(10), '' order by t.place) as rendered
from m join t on m.conv_id = t.conv_id group by 1, 2, 3, 4
"""

OP10_SQL = r"""
with l as (
  select doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i from documents
), r as (
  select *, right(md5(coalesce(lag(md5(line)) over (partition by doc_id order by i), '') || md5(line)), 1) in ('0', '4', '8', 'c') as ends from l
), k as (
  select *, coalesce(sum(ends::int) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as chunk from r
), b as (
  select doc_id, chunk, string_agg(line, chr(10) order by i) as body, count(*) as n, sum((trim(translate(line, chr(9) || chr(13), '  ')) <> '')::int) as solid from k group by doc_id, chunk
), f as (
  select *, case when solid > 1 then row_number() over (partition by body, solid > 1 order by doc_id, chunk) else 1 end as nth from b
)
select doc_id, coalesce(string_agg(case when nth = 1 then body end, chr(10) order by chunk), '') as text,
       sum(n)::bigint as n_lines, sum(case when nth > 1 then n else 0 end)::bigint as n_removed
from f group by doc_id
"""


OP7_SQL = r"""
with recursive w as (
  select doc_id, case when text is null then [] else regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') end as ws from documents
), k as (
  select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as p, len(ws) as n from w
), g as (
  select doc_id, p, n, string_agg(word, ' ') over (partition by doc_id order by p rows between current row and 4 following) as s from k
), sh as (
  select distinct doc_id, md5(s) as s from g where p <= greatest(n - 4, 1)
), size as (
  select doc_id, count(*) as n from sh group by doc_id
), pair as (
  select a.doc_id as a, b.doc_id as b, count(*) as c from sh a join sh b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2
), link as (
  select a, b from pair join size x on x.doc_id = a join size y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)
), reach as (
  select doc_id as node, doc_id as seen from documents union select node, b from reach join link on seen = a
)
select node as doc_id, coalesce(n, 0) as n_shingles, min(seen) as component_id from reach left join size on size.doc_id = node group by node, n
"""

OP9_SQL = r"""
with w as (
  select doc_id, case when text is null then [] else regexp_extract_all(text, '[^\x20\x09-\x0D]+') end as ws from documents
), k as (
  select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as p, len(ws) as n from w
), g as (
  select doc_id, word, p, case when p <= n - 34 then md5(string_agg(word, ' ') over (partition by doc_id order by p rows between current row and 34 following)) end as h from k
), r as (
  select doc_id, word, p, h is not null and count(*) over (partition by h) > 1 as again from g
), c as (
  select doc_id, word, p, bool_or(again) over (partition by doc_id order by p rows between 34 preceding and current row) as gone from r
), d as (
  select doc_id, count(*) as n_words, count_if(gone) as n_removed, coalesce(string_agg(case when not gone then word end, ' ' order by p), '') as kept from c group by doc_id
)
select doc_id, coalesce(n_words, 0) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from documents left join d using (doc_id)
"""


OP1_SQL = r"""
with w as (
  select doc_id, coalesce(text, '') as text, coalesce(lang, '') as stratum, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents
), k as (
  select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as p, len(ws) as n from w
), g as (
  select doc_id, p, case when p <= n - 4 then md5(string_agg(word, ' ') over (partition by doc_id order by p rows between current row and 4 following)) end as h from k
), r as (
  select doc_id, p, h is not null and count(*) over (partition by doc_id, h) > 1 as again from g
), c as (
  select doc_id, bool_or(again) over (partition by doc_id order by p rows between 4 preceding and current row) as hit from r
), rep as (
  select doc_id, count_if(hit) as n_repeat_words from c group by doc_id
), ln as (
  select doc_id, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines from (select doc_id, unnest(string_split(text, chr(10))) as line from w) where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id
), b as (
  select doc_id, text, stratum, len(ws) as n_words, len(array_to_string(ws, '')) as word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols,
         coalesce(n_lines, 0) as n_lines, coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words
  from w left join ln using (doc_id) left join rep using (doc_id)
), lev(i, sy, du, re) as (values LADDER), l as (
  select b.*, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
         coalesce((select min(i) from lev where 1000 * n_symbols // greatest(word_chars, 1) > sy or 1000 * n_dup_lines // greatest(n_lines, 1) > du or 1000 * n_repeat_words // greatest(n_words, 1) > re), STEPS) as level
  from b
), good as (
  select doc_id from labels where quality is not null group by doc_id having min(quality) = 1
), once as (
  select stratum, print, min(level) as level from (select stratum, doc_id, min(md5(text)) as print, min(level) as level from l join good using (doc_id) where not base_failed group by 1, 2) group by 1, 2
), t as (
  select stratum, i, count(*) as n, count_if(level <= i)::bigint as errors from once cross join (select i from lev) group by stratum, i
), risk as (
  select DELTA / greatest(count(distinct stratum), 1) as risk from t
), f as (
  select stratum, i, errors <= ALPHA * n and (select sum(exp(lgamma(n + 1) - (case when x = 0 then 0 else lgamma(x + 1) end) - (case when x = n then 0 else lgamma(n - x + 1) end) + x * ln(ALPHA) + (n - x) * ln(1 - ALPHA))) from (select unnest(range(0, errors + 1)) as x)) <= risk as ok from t, risk
), cut as (
  select stratum, coalesce(min(case when not ok then i end), STEPS) - 1 as cut from f group by stratum
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and level > coalesce(cut, -1) as kept, stratum, level, coalesce(cut, -1) as cut
from l left join cut using (stratum)
"""


def _op1_sql() -> str:
    ladder = ", ".join(str((i, *x)) for i, x in enumerate(LEVELS))
    return OP1_SQL.replace("LADDER", ladder).replace("STEPS", str(len(LEVELS))).replace("ALPHA", str(ALPHA)).replace("DELTA", str(DELTA))


#: The crc32 (unsigned) of the hexadecimal bytes BYTES by the table ``tab`` of CRC_TABLE.
CRC_TABLE = "select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as tab"
CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(BYTES)), '..'), lambda x: ('0x' || x)::bigint)), lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1])), 4294967295)"

OP11_SQL = r"""
with recursive t as (CRC_TABLE), r as (
  select coalesce(doc_id::varchar, '') as id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) as run from documents
), g as (
  select id, run, count(*) as k from r group by id, run
), h as (
  select run, k, CRC as h from g, t
), w as (
  select case when h % 97 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, sum(k)::bigint as n from h group by 1 having length(word) >= 5 and sum(k) >= 3
), d as (
  select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as rest from (select word, n, unnest(range(1, length(word) + 1)) as i from w)
), p as (
  select a.word as word, b.word as near, b.n from d a join d b on a.i = b.i and a.rest = b.rest and a.word <> b.word
  union select w.word, d.word, d.n from w join d on w.word = d.rest
  union select d.word, w.word, w.n from w join d on w.word = d.rest
), q as (
  select word, count(*) as n_near, arg_min(near, (-n, near)) as best, max(n) as best_n from p group by word
), f as (
  select w.word, w.n, coalesce(n_near, 0) as n_near, case when best_n >= 2 * w.n then best end as form, case when best_n >= 2 * w.n then best_n end as form_n from w left join q using (word)
), walk as (
  select word, word as here, 0 as step from f union all select walk.word, f.form, step + 1 from walk join f on f.word = walk.here where f.form is not null
)
select word, n, n_near, form, form_n, root from f join (select word, arg_max(here, step) as root from walk group by word) using (word)
"""

OP13_SQL = r"""
with t as (CRC_TABLE), o as (
  select doc_id, case when text is null then [] else regexp_extract_all(text, '[^\x20\x09-\x0D]+') end as ws, CRC as h from documents, t
), k as (
  select doc_id, ws, len(ws) as n, h % 10 = 0 and len(ws) > 0 as plant, (h // 10) % greatest(len(ws), 1) as a, 3 + (h // 10) % 8 as parts from o
), e as (
  select doc_id, n, ws, plant, a, 1 + (n - a) // parts as p, unnest(range(n)) as i from k
), w as (
  select doc_id, n, i, case when plant and i >= a then ws[a + (i - a) % p + 1] else ws[i + 1] end as word from e
), eq as (
  select x.doc_id, y.i - x.i as q, x.i from w x join w y on x.doc_id = y.doc_id and x.word = y.word and y.i > x.i and 4 * (y.i - x.i) <= x.n
), s as (
  select doc_id, q, min(i) as start, count(*) + q as length from (select *, i - row_number() over (partition by doc_id, q order by i) as island from eq) group by doc_id, q, island having count(*) + q >= greatest(6, 4 * q)
), r as (
  select doc_id, start, length, min(q) as period from s group by doc_id, start, length
), gone as (
  select distinct doc_id, i from (select doc_id, unnest(range(start + period, start + length)) as i from r)
), kept as (
  select w.doc_id, string_agg(word, ' ' order by w.i) as text from w anti join gone on w.doc_id = gone.doc_id and w.i = gone.i group by w.doc_id
), said as (
  select doc_id, count(*) as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as text, arg_max((start, length, period), (length, -start, -period)) as top from r group by doc_id
)
select k.doc_id, n as n_words, coalesce(n_runs, 0) as n_runs, top[1]::bigint as start, top[2]::bigint as length, top[3]::bigint as period, (1000 * top[2] // top[3])::bigint as exponent_milli,
       sha256(coalesce(said.text, '')) as runs_sha256, sha256(coalesce(kept.text, '')) as collapsed_sha256
from k left join said using (doc_id) left join kept using (doc_id)
"""


def _with_crc(sql: str, text: str) -> str:
    return sql.replace("CRC_TABLE", CRC_TABLE).replace("CRC", CRC.replace("BYTES", text))


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": _op1_sql(), "op3_url_filter": OP3_SQL, "op6_chat_format": OP6_SQL, "op7_jaccard_join": OP7_SQL, "op9_substring_dedup": OP9_SQL, "op10_line_dedup": OP10_SQL, "op11_spelling": _with_crc(OP11_SQL, "id || ':' || run"), "op13_periodic_runs": _with_crc(OP13_SQL, "coalesce(doc_id::varchar, '')")}
