"""Queries over the text functions, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import chunking, ranking
from ..operators.hops import hop_label
from ..session import table

PUNCT = t.PUNCTUATION.replace("'", "''")
SP = "[ \\t\\n\\r\\x0B\\f]+"


def _norm(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(translate(lower({x}), '{PUNCT}', ''), '\\b(a|an|the)\\b', ' ', 'g'), '{SP}', ' ', 'g'))"


def _plain(x: str) -> str:
    e = f"coalesce({x}, '')"
    for name, value in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&mdash;", "—"), ("&ndash;", "–"), ("&amp;", "&")):
        e = f"replace({e}, '{name}', '{value}')"
    return f"trim(regexp_replace(regexp_replace({e}, '<[^>]+>', ' ', 'g'), '[ \\t\\n\\r\\x0B\\f ]+', ' ', 'g'))"


def _parts(*fields: str) -> str:
    return "array_to_string(list_filter([" + ", ".join(_plain(f) for f in fields) + "], lambda p: p <> ''), chr(10))"


def text_normalize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "gold_answer").select("query_id", "alias_no", t.normalize_answer(F.col("answer")).alias("answer")).distinct()


def text_title_body(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", t.title_body(F.col("title"), F.col("text")).alias("passage"))


def text_transcript_clean(spark: SparkSession, d: str) -> DataFrame:
    c = t.clean_transcript(F.col("text"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.md5(c).alias("digest"), F.length(c).cast("long").alias("n"))


def text_long_documents(spark: SparkSession, d: str) -> DataFrame:
    """Events of more than 300 words. The loader's own limit is 6 000, which no event of these tables reaches."""
    n = t.word_count(F.array_join("document", " "))
    return table(spark, d, "wcep").select("sample_id", n.cast("long").alias("n")).where("n > 300").distinct()


def text_prefix_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return ranking.by_prefix(table(spark, d, "documents").select("doc_id", "text"), "text", "doc_id").select("prefix", F.md5("text").alias("digest"), "doc_id")


def text_parse_response(spark: SparkSession, d: str) -> DataFrame:
    p = t.parse_response(F.col("response"))
    return table(spark, d, "state_log").where("response is not null").select("log_id", p.alias("p")).select("log_id", F.md5("p.thought").alias("thought"), "p.action", "p.payload").distinct()


def text_parse_answer(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "state_log").select("log_id", t.parse_answer(F.col("response")).alias("answer")).distinct()


def text_safe_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "content_item").select("pdf_id", t.safe_name(F.col("title")).alias("name")).distinct()


def text_strip_html(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "content_item").where("html is not null").select("item_id", t.plain(F.col("html")).alias("plain")).distinct()


def text_item_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "content_item").select("item_id", t.item_text(F.col("item_type"), F.col).alias("chunk")).where("chunk <> ''").distinct()


def text_history(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "state_log").select("query_id", "round_no", "log_id", "subquestion", "response").distinct()
    pairs = F.array_sort(F.collect_list(F.struct("round_no", "log_id", "subquestion", "response")))
    turns = F.flatten(F.transform(pairs, lambda p: F.array(F.struct(F.lit("user").alias("role"), p["subquestion"].alias("content")), F.struct(F.lit("assistant").alias("role"), p["response"].alias("content")))))
    held = log.groupBy("query_id").agg(turns.alias("turns"))
    q = table(spark, d, "queries").select("query_id", "question").distinct()
    return q.join(held, "query_id", "left").select("query_id", F.md5(t.history(F.col("turns"), F.col("question"))).alias("digest"))


def text_annotated(spark: SparkSession, d: str) -> DataFrame:
    a = t.annotated(F.col("text"), F.col("layer"), F.col("node_id"), F.col("layer") > 0)
    return table(spark, d, "nodes").select("tree_id", "node_id", F.md5(a).alias("digest")).distinct()


def text_short(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", t.short_text(F.col("text")).alias("short"), F.md5(t.truncated(F.col("text"), 60, 20)).alias("cut"))


def text_hop_labels(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "state_log").select("query_id", "round_no").distinct().groupBy("query_id").agg(F.count("*").alias("n"))
    return n.groupBy(hop_label(F.col("n")).cast("int").alias("hops")).agg(F.count("*").alias("n_queries"))


def text_gold_sets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "gold_answer").groupBy("query_id").agg(F.array_sort(F.collect_set("answer")).alias("answers"))


def text_child_texts(spark: SparkSession, d: str) -> DataFrame:
    """The joined texts of the children of each node, as they go into its abstract."""
    kids = table(spark, d, "edges").select("tree_id", "parent_id", "child_id").distinct()
    n = table(spark, d, "nodes").where("text is not null").select("tree_id", F.col("node_id").alias("child_id"), "text").distinct()
    j = kids.join(n, ["tree_id", "child_id"]).groupBy("tree_id", "parent_id").agg(F.array_sort(F.collect_list(F.struct("child_id", "text"))).alias("c"))
    return j.select("tree_id", "parent_id", F.md5(t.node_text(F.transform("c", lambda x: x["text"]))).alias("digest"))


def chunk_sentences(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(chunking.sentences(F.col("text"))).cast("long").alias("n"))


def chunk_token_stats(spark: SparkSession, d: str) -> DataFrame:
    r = chunking.token_stats(table(spark, d, "documents"))
    return r.select("total", F.round("mean", 6).alias("mean"), "most", "least")


def chunk_pack(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunks(table(spark, d, "documents"))


def chunk_events(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunks_of_pages(table(spark, d, "wcep").dropDuplicates(["sample_id"]))


WORDS = "regexp_extract_all({}, '[^ \\t\\n\\r\\x0B\\f]+')"
_RESPONSE = """
select distinct log_id, md5(regexp_replace(left(response, length(response) - length(tail) - n), '^\\n+|\\n+$', '', 'g')) as thought, action,
  regexp_replace(tail, '[ .]+$', '') as payload
from (select log_id, response, 'retrieve' as action, 10 as n, string_split(response, 'Retrieve: ')[-1] as tail from state_log where contains(response, 'Retrieve: ')
  union all select log_id, response, 'answer', 8, string_split(response, 'Answer: ')[-1] from state_log where contains(response, 'Answer: ') and not contains(response, 'Retrieve: '))
union all select distinct log_id, md5(''), 'answer', 'Error' from state_log where response is not null and not contains(response, 'Retrieve: ') and not contains(response, 'Answer: ')
"""


def _cleaned(x: str) -> str:
    for old, new in t.TRANSCRIPT:
        x = f"replace({x}, '{old}', '{new}')"
    return x


def _pack_sql(source: str, most: int = 100) -> str:
    """Packing as a recursion over a document's sentences, and over the parts of each sentence over the limit; chunks
    in the order in which they are full. source gives doc_id and text."""
    n = "len(regexp_extract_all({}, '[\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}_\\s\\p{{Z}}]'))"
    fold = """
{r} as (select {key}, rn, 0 as part, n as size from {rows} where rn = 1
  union all select {keys}, s.rn, case when r.size + s.n > {most} then r.part + 1 else r.part end, case when r.size + s.n > {most} then s.n else r.size + s.n end
  from {r} r join {rows} s on {on} and s.rn = r.rn + 1)"""
    return f"""
with recursive d as ({source}),
s as (select doc_id, i, s from (select doc_id, unnest(regexp_split_to_array(text, '[.!?\\n]')) as s, generate_subscripts(regexp_split_to_array(text, '[.!?\\n]'), 1) as i from d) where regexp_matches(s, '[^\\s\\p{{Z}}]')),
c as materialized (select *, {n.format('s')} as n from s),
u as materialized (select *, row_number() over (partition by doc_id order by i) as rn from c where n <= {most}),
o as (select doc_id, i, unnest(regexp_split_to_array(s, '[,;:]')) as s, generate_subscripts(regexp_split_to_array(s, '[,;:]'), 1) as j from c where n > {most}),
v as materialized (select doc_id, i, regexp_replace(s, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') as s, {n.format('s')} as n, row_number() over (partition by doc_id, i order by j) as rn from o where regexp_matches(s, '[^\\s\\p{{Z}}]')),
{fold.format(r='a', key='doc_id, 0::bigint as i', keys='s.doc_id, 0', rows='u', on='s.doc_id = r.doc_id', most=most)},
{fold.format(r='b', key='doc_id, i', keys='s.doc_id, s.i', rows='v', on='s.doc_id = r.doc_id and s.i = r.i', most=most)},
x as (select doc_id, part, string_agg(s, ' ' order by rn) as text, min(u.i) as first from a join u using (doc_id, rn) group by 1, 2),
y as (select doc_id, text, coalesce(lead(first) over (partition by doc_id order by part), 1000000000) as due, 0 as part from x
  union all select doc_id, string_agg(s, ' ' order by rn), i, part from b join v using (doc_id, i, rn) group by doc_id, i, part)
select doc_id, row_number() over (partition by doc_id order by due, part) - 1 as chunk_index, text from y"""


SQL = {
    "chunk_pack": _pack_sql("select doc_id, text from documents where text is not null"),
    "chunk_events": _pack_sql("select sample_id as doc_id, any_value(array_to_string(document, chr(10))) as text from wcep group by 1"),
    "text_normalize": f"select distinct query_id, alias_no, {_norm('answer')} as answer from gold_answer",
    "text_title_body": "select doc_id, title || chr(10) || text as passage from documents",
    "text_transcript_clean": f"select doc_id, md5({_cleaned('text')}) as digest, length({_cleaned('text')}) as n from documents where text is not null",
    "text_long_documents": f"select distinct sample_id, n from (select sample_id, len({WORDS.format(chr(97))}) as n from (select sample_id, array_to_string(document, ' ') as a from wcep)) where n > 300",
    "text_prefix_dedupe": "select left(text, 100) as prefix, md5(arg_max(text, doc_id)) as digest, min(doc_id) as doc_id from documents where text is not null group by 1",
    "text_parse_response": _RESPONSE,
    "text_parse_answer": "select distinct log_id, regexp_replace(case when contains(response, 'Answer:') then string_split(response, 'Answer:')[-1] else response end, '^[ .]+|[ .]+$', '', 'g') as answer from state_log",
    "text_safe_names": f"select distinct pdf_id, regexp_replace(trim(regexp_replace(regexp_replace(title, '[<>:\"/\\\\|?*]', '_', 'g'), '{SP}', ' ', 'g')), '[ .]+$', '') as name from content_item",
    "text_strip_html": f"select distinct item_id, {_plain('html')} as plain from content_item where html is not null",
    "text_item_text": f"""
select distinct item_id, chunk from (select item_id, case
  when item_type in ('header', 'footer', 'page_number', 'aside_text', 'page_footnote', 'seal') then ''
  when item_type = 'text' then case when coalesce(text_level, 0) > 0 and {_plain('text')} <> '' then repeat('#', text_level) || ' ' || {_plain('text')} else {_plain('text')} end
  when item_type = 'list' then array_to_string(list_filter(list_concat([{_plain('text')}], list_transform(coalesce(list_items, []), lambda x: {_plain('x')})), lambda p: p <> ''), chr(10))
  when item_type = 'equation' then {_parts('text', 'latex', 'html')}
  when item_type = 'code' then {_parts('code_caption', 'code_body')}
  when item_type = 'table' then {_parts('table_caption', 'table_body', 'table_footnote', 'html')}
  when item_type in ('image', 'chart') then {_parts('image_caption', 'chart_caption')}
  else {_parts('text', 'content', 'latex', 'html')} end as chunk from content_item) where chunk <> ''""",
    "text_history": """
with h as (select query_id, string_agg(line, chr(10) order by round_no, log_id, half) as lines
  from (select distinct query_id, round_no, log_id, half, line from (
    select query_id, round_no, log_id, 0 as half, 'User: ' || subquestion as line from state_log
    union all select query_id, round_no, log_id, 1, 'Assistant: ' || response from state_log)) group by 1)
select q.query_id, md5(case when h.query_id is null then question else 'Conversation history:' || chr(10) || coalesce(lines, '') || chr(10) || chr(10) || 'Current question: ' || question end) as digest
from (select distinct query_id, question from queries) q left join h on h.query_id = q.query_id""",
    "text_annotated": "select distinct tree_id, node_id, md5(case when layer > 0 then '[LAYER: ' || layer || '] ' else '[ID: ' || node_id || '] ' end || text) as digest from nodes",
    "text_short": f"""
select doc_id, case when len(w) <= 20 then text else array_to_string(w[1:20], ' ') || ' ...' end as short,
  md5(case when len(w) <= 60 then text else array_to_string(w[1:40], ' ') || chr(10) || '...' || chr(10) || array_to_string(w[-20:], ' ') end) as cut
from (select doc_id, text, {WORDS.format('text')} as w from documents)""",
    "text_hop_labels": "select cast(least(n, 4) as integer) as hops, count(*) as n_queries from (select query_id, count(distinct round_no) as n from state_log group by 1) group by 1",
    "text_gold_sets": "select query_id, list_sort(list_distinct(list(answer))) as answers from gold_answer group by 1",
    "text_child_texts": """
select tree_id, parent_id, md5(string_agg(replace(text, chr(10), ' ') || chr(10) || chr(10), '' order by child_id, text)) as digest
from (select distinct e.tree_id, e.parent_id, e.child_id, n.text from edges e join nodes n on n.tree_id = e.tree_id and n.node_id = e.child_id where n.text is not null) group by 1, 2""",
    "chunk_sentences": "select doc_id, len(list_filter(regexp_split_to_array(text, '[.!?\\n]'), lambda s: trim(s) <> '')) as n from documents where text is not null",
    "chunk_token_stats": """
select sum(n)::bigint as total, round(avg(n), 6) as mean, max(n) as most, min(n) as least
from (select len(regexp_extract_all(text, '[\\p{L}\\p{N}]+|[^\\p{L}\\p{N}\\s.!?]')) as n from documents where text is not null)""",
}

QUERIES = (text_normalize, text_title_body, text_transcript_clean, text_long_documents, text_prefix_dedupe, text_parse_response, text_parse_answer, text_safe_names, text_strip_html, text_item_text, text_history, text_annotated, text_short, text_hop_labels, text_gold_sets, text_child_texts, chunk_sentences, chunk_token_stats, chunk_pack, chunk_events)
