"""Registered queries of this subpackage: ``QUERIES`` and, where SQL can express one, ``ORACLES``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shopflow.llm.chat import conversation_digests, format_conversations
from shopflow.llm.common import table
from shopflow.llm.decontam import contaminated
from shopflow.llm.exact_dedup import exact_duplicates
from shopflow.llm.mixing import mix_sources
from shopflow.llm.ngram_join import ngram_jaccard_join
from shopflow.llm.pii import find_personal_data
from shopflow.llm.quality import score_quality
from shopflow.llm.ranked_search import ranked_search
from shopflow.llm.repair import repair_digests
from shopflow.llm.substring_dedup import remove_repeats
from shopflow.llm.token_counts import count_tokens
from shopflow.llm.urlrank import filter_urls
from shopflow.llm.warc import warc_round_trip

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql.strip()
        return fn
    return deco


@register("op1_ngram_jaccard_join")
def op1(spark, sf_dir):
    return ngram_jaccard_join(table(spark, sf_dir, "documents"))


# Lower-cases A-Z only.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@register("op5_exact_dedup", f"""
with d as (select doc_id, sha256({_LOWER}) as text_sha256 from documents),
g as (select text_sha256, max(doc_id) as keep_id, count(*) as group_size from d group by text_sha256)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from d join g using (text_sha256)
""")
def op5(spark, sf_dir):
    return exact_duplicates(table(spark, sf_dir, "documents"))


@register("op7_mix_sources")
def op7(spark, sf_dir):
    return mix_sources(table(spark, sf_dir, "documents"))


@register("op9_chat_trees")
def op9(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql("select * from values (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), "
                      "(-1L, 1L, 'assistant', '</s>[INST] ok [/INST]') as t(conv_id, turn, role, text)")
    return conversation_digests(format_conversations(rows.unionByName(extra)))


@register("op10_decontaminate")
def op10(spark, sf_dir):
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op4_url_link_graph")
def op4(spark, sf_dir):
    return filter_urls(table(spark, sf_dir, "pages"))


@register("op6_warc_zstd", """
with p as (select page_id, coalesce(html, '') as h from pages),
b as (select page_id, octet_length(encode(h)) as payload_bytes, sha1(h) as payload_digest from p),
g as (select payload_digest, max(page_id) as top from b where payload_bytes >= 1000 group by payload_digest)
select page_id, payload_bytes, payload_digest,
       case when top is null or top = page_id then 'response' else 'revisit' end as record_type,
       case when top <> page_id then top end as refers_to
from b left join g using (payload_digest)
""")
def op6(spark, sf_dir):
    return warc_round_trip(table(spark, sf_dir, "pages")).drop("target_uri", "archive")


@register("op2_pii_boosting")
def op2(spark, sf_dir):
    return find_personal_data(table(spark, sf_dir, "documents"))


@register("op8_suffix_dedup")
def op8(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents"))


@register("op3_quality_mil")
def op3(spark, sf_dir):
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op11_repair_turns", r"""
with recursive c as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
         coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key from conversations),
k as (  -- crc32 of each key, bit by bit
  select key, xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(key, ''),
                lambda x: [ascii(x)::bigint, 0, 0, 0, 0, 0, 0, 0]))),
              lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1))), 4294967295) % 20 as kind
  from (select distinct key from c)),
d as (
  select conv_id, turn, case when kind = 4 then 'user' else role end as role,
         case kind when 1 then '' when 2 then translate(text, '.!?', '') else text end as text,
         unnest(case when kind = 3 then [0, 1] else [0] end) as copy
  from c join k using (key) where kind <> 0),
e as (select *, sha256(text) as sha, rtrim(text, e' \t\n\x0b\f\r') as body, left(role, 1) as initial from d),
f as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, sha, copy) as i,
         body = '' as blank, row_number() over (partition by conv_id, role, sha order by turn nulls first, copy) > 1 as twice,
         right(body, 1) not in ('.', '!', '?') as cut from e),
l as (
  select *, blank or twice as gone,
         coalesce(lag(initial) over (partition by conv_id order by i) || initial not in ('su', 'ua', 'au'), false) as illegal from f),
counts as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (blank) as blank,
         count(*) filter (not blank and twice) as duplicate, count(*) filter (not gone and cut) as truncated,
         count(*) filter (illegal) as illegal, max(i) as n from l group by conv_id),
-- insertions lead from state p to state q: 0 nothing yet, 1 after system, 2 after user, 3 after assistant
ins as (select * from (values (0, 0, ''), (1, 1, ''), (2, 2, ''), (3, 3, ''), (0, 2, 'I'), (1, 2, 'I'), (3, 2, 'I'), (2, 3, 'I'),
                              (0, 3, 'II'), (1, 3, 'II')) as t(p, q, put)),
-- a row's edit leads from state q to state r; a kept one needs its initial
ed as (select * from (values (0, 0, 'D', null), (1, 1, 'D', null), (2, 2, 'D', null), (3, 3, 'D', null),
                             (0, 2, 'R', null), (1, 2, 'R', null), (3, 2, 'R', null), (2, 3, 'R', null),
                             (0, 1, 'K', 's'), (0, 2, 'K', 'u'), (1, 2, 'K', 'u'), (3, 2, 'K', 'u'), (2, 3, 'K', 'a')) as t(q, r, edit, needs)),
walk as (  -- the best way to each state after each row
  select conv_id, 0::bigint as i, 0 as state, {'cost': 0, 'audit': '', 'body': ''} as best from counts
  union all
  select conv_id, i, state, min(best) from (
    select w.conv_id, l.i, ed.r as state, {
      'cost': w.best.cost + 2 * length(put) + case edit when 'D' then 3 else case edit when 'R' then 2 else 0 end + cut::int end,
      'audit': w.best.audit || put || edit,
      'body': w.best.body || case put when '' then '' when 'II' then e'\nuser:\nassistant:' else case ins.q when 2 then e'\nuser:' else e'\nassistant:' end end
              || case edit when 'D' then '' when 'K' then e'\n' || role || ':' || text
                 else e'\n' || case ed.r when 2 then 'user:' else 'assistant:' end || text end} as best
    from walk w join l on l.conv_id is not distinct from w.conv_id and l.i = w.i + 1
    join ins on ins.p = w.state join ed on ed.q = ins.q
    where (edit = 'D' or not gone) and (needs is null or needs = initial)) group by all),
done as (
  select w.conv_id, min({'cost': w.best.cost + 2 * length(put), 'audit': w.best.audit || put,
         'body': w.best.body || case put when '' then '' when 'II' then e'\nuser:\nassistant:' else case ins.q when 2 then e'\nuser:' else e'\nassistant:' end end}) as best
  from walk w join counts n on n.conv_id is not distinct from w.conv_id and n.n = w.i join ins on ins.p = w.state
  where ins.q in (0, 3) group by w.conv_id)
select o.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate,
       coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, coalesce(best.cost, 0)::bigint as cost,
       coalesce(best.audit, '') as audit, sha256(substr(coalesce(best.body, ''), 2)) as repaired_sha256
from (select distinct conv_id from conversations) o
left join counts n on n.conv_id is not distinct from o.conv_id left join done x on x.conv_id is not distinct from o.conv_id
""")
def op11(spark, sf_dir):
    return repair_digests(table(spark, sf_dir, "conversations"))


# The folder of vocabulary files comes from the installed package of public tokenizers.
TOKEN_MODEL = "piece_bpe_32k.model"


@register("op12_token_counts")
def op12(spark, sf_dir):
    import public_tokenizers
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKEN_MODEL))


@register("op13_ranked_search", r"""
with d as (select row_number() over () as d, doc_id,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as ts from documents),
s as (select count(*) as n_docs, sum(len(ts))::bigint as l from d where len(ts) > 0),
p as (select d, doc_id, len(ts)::bigint as n, unnest(ts) as t from d),
tf as (select d, doc_id, n, t, count(*)::bigint as tf from p group by all),
df as (select t, count(*)::bigint as df from tf group by t),
w as (select t, floor(1000 * ln((2 * n_docs + 2)::double / (2 * df + 1)::double))::bigint as w from df, s),
i as (select row_number() over () as q, item_id,
             list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as ts from benchmark),
it as (select q, item_id, unnest(ts) as t from i),
sc as (select q, item_id, d, doc_id,
              sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // l))))::bigint as score
       from it join tf using (t) join w using (t), s group by q, item_id, d, doc_id),
r as (select *, row_number() over (partition by q order by score desc, doc_id nulls first, d) as rank from sc where score > 0)
select item_id, rank::int as rank, doc_id, score from r where rank <= 10
""")
def op13(spark, sf_dir):
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
