"""Queries over references and hierarchies."""

from __future__ import annotations

from cardloom.operators import hierarchy as H
from cardloom.operators import references as R
from cardloom.shared import table


def _orphans(spark, d):
    t = lambda name: table(spark, d, name)
    refs = {"embeddings2": (t("embeddings2"), "updated_at"), "note_tags": (t("note_tags"), None), "note_fields": (t("note_fields"), None), "topic_docs": (t("topic_docs"), None)}
    return R.orphan_references(refs, t("notes"), t("note_deletions"))


def p2_found(spark, d):
    return _orphans(spark, d).select("table_name", "note_id", "kind")


def p2_report(spark, d):
    return R.orphan_report(_orphans(spark, d))


def p3_found(spark, d):
    return H.node_paths(H.hierarchy(table(spark, d, "topics")))


def p3_hierarchy(spark, d):
    return H.hierarchy_report(H.hierarchy(table(spark, d, "topics")))


def p3_descendants(spark, d):
    return H.descendants(H.hierarchy(table(spark, d, "topics")))


def p3_cycles(spark, d):
    return H.cycle_report(H.hierarchy(table(spark, d, "topics")))


_REFS = """
refs as (
  select 'embeddings2' as table_name, note_id, updated_at as seen from embeddings2 where note_id is not null
  union all select 'note_tags', note_id, null from note_tags where note_id is not null
  union all select 'note_fields', note_id, null from note_fields where note_id is not null
  union all select 'topic_docs', note_id, null from topic_docs where note_id is not null),
ids as (select table_name, note_id, min(seen) as first_at, count(*) as n_rows from refs group by all),
parents as (select note_id, min(fetched_at) as fetched from notes group by 1),
gone as (select distinct note_id from note_deletions),
kinds as (
  select i.table_name, i.note_id, i.n_rows,
    case when p.note_id is null and g.note_id is not null then 'deleted'
         when p.note_id is null then 'missing'
         when i.first_at < p.fetched then 'late' end as kind
  from ids i left join parents p using (note_id) left join gone g using (note_id))
"""

_TREE = """
n as (select run_id, topic_id, min(parent_id) as parent_id from topics where run_id is not null and topic_id is not null group by 1, 2),
m as (select n.*, p.topic_id is not null as linked from n left join n p on p.run_id = n.run_id and p.topic_id = n.parent_id),
t as (
  select run_id, topic_id, cast(topic_id as varchar) as node_path, 0 as depth, topic_id as root_id from m where not linked
  union all
  select m.run_id, m.topic_id, t.node_path || '/' || m.topic_id, t.depth + 1, t.root_id
  from t join m on m.linked and m.run_id = t.run_id and m.parent_id = t.topic_id),
loose as (select run_id, topic_id, parent_id from m anti join t using (run_id, topic_id)),
walk as (
  select run_id, topic_id as start, parent_id as here from loose
  union
  select w.run_id, w.start, l.parent_id from walk w join loose l on l.run_id = w.run_id and l.topic_id = w.here),
rings as (select distinct run_id, start as topic_id from walk where start = here),
all_nodes as (
  select t.run_id, t.topic_id, m.parent_id, node_path, depth, root_id, 'tree' as state from t join m using (run_id, topic_id)
  union all
  select l.run_id, l.topic_id, l.parent_id, null, null, null, case when r.topic_id is null then 'below_cycle' else 'cycle' end
  from loose l left join rings r using (run_id, topic_id))
"""

_PAIRS = "pairs as (select run_id, cast(steps[i] as int) as topic_id, topic_id as descendant_id, cast(depth - i + 1 as int) as distance from (select run_id, topic_id, depth, string_split(node_path, '/') as steps, unnest(range(1, depth + 1)) as i from all_nodes where state = 'tree' and depth > 0) x)"

QUERIES = {f.__name__: f for f in (p2_found, p2_report, p3_found, p3_hierarchy, p3_descendants, p3_cycles)}

SQL = {
    "p2_found": f"with {_REFS} select table_name, note_id, kind from kinds where kind is not null",
    "p2_report": f"with {_REFS} select table_name, strftime(make_timestamp(note_id * 1000), '%Y-%m') as month, kind, count(*) as n_ids, cast(sum(n_rows) as bigint) as n_rows from kinds where kind is not null group by all",
    "p3_found": f"with recursive {_TREE} select run_id, topic_id, case when state = 'tree' then node_path else state end as node_path from all_nodes",
    "p3_hierarchy": f"with recursive {_TREE}, {_PAIRS}, c as (select run_id, topic_id, count(*) as n from pairs group by all) select a.*, coalesce(c.n, 0) as n_descendants from all_nodes a left join c using (run_id, topic_id)",
    "p3_descendants": f"with recursive {_TREE}, {_PAIRS} select run_id, topic_id, descendant_id, distance from pairs",
    "p3_cycles": f"with recursive {_TREE} select run_id, count(*) filter (state = 'cycle') as n_cycle, count(*) filter (state = 'below_cycle') as n_below_cycle, min(topic_id) filter (state = 'cycle') as smallest_cycle_id from all_nodes where state <> 'tree' group by run_id",
}
