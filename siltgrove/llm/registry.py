"""The queries of this subpackage, by the names the driver runs, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import table, written
from . import leak, level, markup, mix, mixture, neardup, nearest, pairs, scans, split


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every article and leaf text as pieces within both limits."""
    items = split.project_items(table(spark, sf_dir, "wcep"), table(spark, sf_dir, "nodes"))
    return split.split_long(items).dropDuplicates(["item_kind", "item_id", "doc_pos", "chunk_index"])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items that exceed a limit, as the splitter took them; outer white space may leave them one piece or none."""
    items = split.project_items(table(spark, sf_dir, "wcep"), table(spark, sf_dir, "nodes"))
    cut = split.split_long(items.withColumn("long", split.oversized(F.col("text")))).where("long and chunk_index = 0")
    return cut.select("item_kind", "item_id", "doc_pos").distinct()


P1_SQL = """
with items as (
  select 'wcep' as item_kind, sample_id as item_id, cast(i - 1 as integer) as doc_pos, document[i] as text
  from (select sample_id, document, unnest(range(1, len(document) + 1)) as i from wcep)
  union all select 'node', node_id, -1, text from nodes where layer = 0)
select distinct item_kind, item_id, doc_pos from items
where length(text) > 900 or len(regexp_extract_all(text, '[^ \\t\\n\\r]+')) > 120
"""


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of scanned PDFs with their defects."""
    return p2_repaired(spark, sf_dir).select("item_id", F.explode("defects").alias("defect")).distinct()


def p2_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text and content of an item as readable paragraphs, with its defects."""
    return scans.repair(table(spark, sf_dir, "content_item"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of the clusters of similar leaves."""
    return mixture.members(table(spark, sf_dir, "nodes")).select("node_id", "cluster_id")


def p3_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cluster with its size and its most typical texts."""
    return mixture.described(table(spark, sf_dir, "nodes"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounds whose response is no sound reply, with their defect."""
    return pairs.defects(table(spark, sf_dir, "state_log"), pairs.project_labels(table(spark, sf_dir, "queries"), table(spark, sf_dir, "documents")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of events that say almost the same."""
    return neardup.event_pairs(table(spark, sf_dir, "wcep"))


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event with its group, its class of exact copies and its number of links."""
    return neardup.event_groups(table(spark, sf_dir, "wcep"))


P5_SQL = """
with e as (
  select distinct sample_id, regexp_extract_all(lower(array_to_string(document, ' ')), '[\\p{L}\\p{N}]+') as t from wcep),
g as (select distinct sample_id, array_to_string(t[i:i+2], ' ') as g
      from (select sample_id, t, unnest(range(1, len(t) - 1)) as i from e where len(t) >= 3)),
n as (select sample_id, count(*) as n from g group by 1),
c as (select a.sample_id as sample_a, b.sample_id as sample_b, count(*) as c
      from g a join g b on a.g = b.g and a.sample_id < b.sample_id group by 1, 2)
select sample_a, sample_b from c join n x on x.sample_id = sample_a join n y on y.sample_id = sample_b
where 1000 * c >= 600 * (x.n + y.n - c)
"""


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of leaves with a similarity of at least 0.80, one among the five most similar of the other."""
    return nearest.near_pairs(table(spark, sf_dir, "nodes"))


def p6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar other leaves of every usable leaf."""
    return nearest.nearest(table(spark, sf_dir, "nodes"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items, fields and kinds of markup in them."""
    return markup.found(table(spark, sf_dir, "content_item"))


def p7_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields as clean text that keeps headings, lists, code, tables and formulas."""
    return markup.cleaned(table(spark, sf_dir, "content_item"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the test items that leaked into them."""
    return p8_leaks(spark, sf_dir).select("doc_id", "item_id").distinct()


def p8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaked stretches, with offsets in the document as given."""
    return leak.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item"))


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per leaked test item, the documents that hold parts of it and its longest leaked stretch in tokens."""
    return p8_leaks(spark, sf_dir).groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_docs"), F.max("n_tokens").alias("longest"))


P8_SQL = """
with i as (
  select distinct item_id, regexp_extract_all(lower(t), '[\\p{L}\\p{N}]+') as t
  from (select item_id, unnest([question, passage]) as t from eval_item)),
p as (select distinct item_id, array_to_string(t[k:k+11], ' ') as g
      from (select item_id, t, unnest(range(1, len(t) - 10)) as k from i where len(t) >= 12)),
d as (select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as t from documents),
w as (select distinct doc_id, array_to_string(t[k:k+11], ' ') as g
      from (select doc_id, t, unnest(range(1, len(t) - 10)) as k from d where len(t) >= 12))
select distinct doc_id, item_id from w join p using (g)
"""


def _sized(spark: SparkSession, sf_dir: str, unit: str) -> DataFrame:
    return mix.sizes(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), unit)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that cannot reach their share of the mix within their cap."""
    return mix.plan(_sized(spark, sf_dir, "words"), table(spark, sf_dir, "mix_target")).where("short").select("source")


def p9_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix allots each source, in words, of what it wants and has; and the share of the mix that this makes."""
    planned = mix.plan(_sized(spark, sf_dir, "words"), table(spark, sf_dir, "mix_target"))
    share = F.col("allotted") / F.sum("allotted").over(W.partitionBy())  # over one row per source
    return planned.select("source", "available", F.round("wanted", 3).alias("wanted"), F.round("allotted", 3).alias("allotted"), F.round(share, 6).alias("planned_share"), "short")


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix in tokens: which units of which document each slot of each shard holds."""
    sized = written(_sized(spark, sf_dir, "tokens"), "sizes")
    return mix.mixed(sized, mix.plan(sized, table(spark, sf_dir, "mix_target")))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual shares of the sources in the mix, in tokens."""
    sized = written(_sized(spark, sf_dir, "tokens"), "sizes")
    planned = mix.plan(sized, table(spark, sf_dir, "mix_target"))
    return mix.shares(mix.mixed(sized, planned), planned)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of at least 30 words with the grade of its reading level."""
    return p10_levels(spark, sf_dir).select("doc_id", "grade")


def p10_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades with the expected level between them."""
    return level.reading_levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_label"))


P9_SQL = """
with d as (select lower(trim(source)) as k, coalesce(len(regexp_extract_all(text, '[^ \t\n\r]+')), 0) as n
           from documents where source is not null),
s as (select k, sum(n) as n from d group by 1)
select m.source from mix_target m left join s on s.k = lower(trim(m.source))
where coalesce(s.n, 0) * m.max_repeats < m.target_share * (select sum(n) from d)
"""


P9_PLAN_SQL = """
with d as (select lower(trim(source)) as k, coalesce(len(regexp_extract_all(text, '[^ \t\n\r]+')), 0) as n
           from documents where source is not null),
s as (select k, sum(n) as n from d group by 1),
p as (select m.source, cast(coalesce(s.n, 0) as bigint) as available, m.target_share * (select sum(n) from d) as wanted,
             cast(coalesce(s.n, 0) * m.max_repeats as double) as usable
      from mix_target m left join s on s.k = lower(trim(m.source)))
select source, available, round(wanted, 3) as wanted, round(least(wanted, usable), 3) as allotted,
       round(least(wanted, usable) / sum(least(wanted, usable)) over (), 6) as planned_share, usable < wanted as short from p
"""


P3_SQL = """
with recursive u as materialized (
  select distinct node_id, try_cast(embeddings as double[64]) as e from nodes where layer = 0 and len(embeddings) = 64
  and list_bool_and([coalesce(isfinite(x), false) for x in embeddings]) and list_bool_or([x <> 0 for x in embeddings])),
l as materialized (
  select a.node_id as a, b.node_id as b from u a join u b on a.node_id <> b.node_id
      where array_cosine_similarity(a.e, b.e) >= 0.8),
r as (select node_id as a, node_id as m from u
      union select l.b, r.m from r join l on l.a = r.a),
c as (select a as node_id, min(m) as cluster_id from r group by 1)
select node_id, cluster_id from c where cluster_id in (select cluster_id from c group by 1 having count(*) >= 5)
"""


P8_ITEMS_SQL = P8_SQL.split("w as (")[0] + """
w as (select doc_id, k, array_to_string(t[k:k+11], ' ') as g from (select doc_id, t, unnest(range(1, len(t) - 10)) as k from d where len(t) >= 12)),
m as (select distinct doc_id, item_id, k from w join p using (g)),
s as (select *, case when k <= lag(k) over (partition by doc_id, item_id order by k) + 12 then 0 else 1 end as fresh from m),
r as (select *, sum(fresh) over (partition by doc_id, item_id order by k) as stretch from s),
l as (select doc_id, item_id, max(k) + 12 - min(k) as n from r group by doc_id, item_id, stretch)
select item_id, count(distinct doc_id) as n_docs, max(n)::integer as longest from l group by 1
"""


P5_GROUPS_SQL = """
with recursive e as (select sample_id, any_value(array_to_string(document, ' ')) as x from wcep group by 1),
t as (select sample_id, x, regexp_extract_all(lower(x), '[\\p{L}\\p{N}]+') as t from e),
c as materialized (select sample_id, min(sample_id) over (partition by x) as class_id, t from t where len(t) >= 3),
g as materialized (select distinct class_id, array_to_string(t[i:i+2], ' ') as g
  from (select class_id, t, unnest(range(1, len(t) - 1)) as i from c where sample_id = class_id)),
n as (select class_id, count(*) as n from g group by 1),
p as materialized (select a, b from (select x.class_id as a, y.class_id as b, count(*) as c from g x join g y on x.g = y.g and x.class_id <> y.class_id group by 1, 2)
  join n x on x.class_id = a join n y on y.class_id = b where 1000 * c >= 600 * (x.n + y.n - c)),
r as (select class_id as node, class_id as low from n union select p.b, r.low from r join p on p.a = r.node),
q as (select node, min(low) as group_id from r group by 1),
k as (select a, count(*) as n_links from p group by 1)
select sample_id, c.class_id, group_id, coalesce(n_links, 0) as n_links from c join q on q.node = c.class_id left join k on k.a = c.class_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_pieces, p2_found, p2_repaired, p3_found, p3_clusters, p4_found, p5_found, p5_groups, p6_found, p6_nearest, p7_found, p7_clean, p8_found, p8_leaks, p8_items, p9_found, p9_plan, p9_mix, p9_shares, p10_found, p10_levels)}


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_SQL, "p3_found": P3_SQL, "p9_plan": P9_PLAN_SQL, "p5_found": P5_SQL, "p5_groups": P5_GROUPS_SQL, "p8_items": P8_ITEMS_SQL, "p8_found": P8_SQL, "p9_found": P9_SQL}
