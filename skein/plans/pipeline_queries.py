"""Queries of the general training-data problems (2 to 6) and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import dedup, drift, hierarchy, nested, snapshots
from skein.plans.common import table


def p2_found(spark, d):
    return dedup.surplus_deliveries(table(spark, d, "event_envelopes"))


def p2_messages(spark, d):
    rows = table(spark, d, "event_envelopes")
    return dedup.distinct_messages(rows).select("delivery_id", "eventId", "correlationId", "timestamp", "payload.runId")


def p3_found(spark, d):
    foot = drift.materialize(drift.footers(table(spark, d, "envelope_files")), "footers")
    return drift.changes(foot)


def p3_table(spark, d):
    lines = table(spark, d, "envelope_files")
    foot = drift.materialize(drift.footers(lines), "footers")
    log = drift.materialize(drift.changes(foot), "changes")
    return drift.consistent_table(lines, foot, log)


def p3_values(spark, d):
    """Values of each line in the consistent table; objects kept as text beside their leaves don't count."""
    wide = p3_table(spark, d)
    count = F.lit(0)
    for c, kind in wide.dtypes:
        if c not in ("_file_name", "_line_no", "_rest"):
            held = F.col(f"`{c}`").isNotNull()
            count = count + (held & ~F.col(f"`{c}`").startswith("{") if kind == "string" else held).cast("int")
    return wide.select(F.col("_file_name").alias("file_name"), F.col("_line_no").alias("line_no"), count.alias("n_values"), F.col("_rest").isNotNull().alias("has_rest"))


def p3_lifespans(spark, d):
    foot = drift.materialize(drift.footers(table(spark, d, "envelope_files")), "footers")
    return drift.lifespans(foot)


def p4_found(spark, d):
    return snapshots.snapshot_changes(table(spark, d, "file_snapshots"))


def p4_rates(spark, d):
    rows = snapshots.snapshot_changes(table(spark, d, "file_snapshots"))
    return rows.groupBy("repository", "snapshot_no", "change").agg(F.count(F.lit(1)).alias("files"))


def p5_found(spark, d):
    return hierarchy.router_chains(table(spark, d, "router_mounts"))


def p5_descendants(spark, d):
    return hierarchy.chained_descendants(table(spark, d, "router_mounts"))


def p5_reached(spark, d):
    return hierarchy.router_descendants(table(spark, d, "router_mounts"))


def p6_found(spark, d):
    return nested.report_items(table(spark, d, "impact_reports"))


def p6_changes(spark, d):
    t = nested.flat_tables(table(spark, d, "impact_reports"))["breaking_change"]
    return t.select("report_id", "pk", "parent_pk", "change_no", F.col("id").alias("change_id"), "source", "severity")


def p6_summaries(spark, d):
    t = nested.flat_tables(table(spark, d, "impact_reports"))["analysis_summary"]
    return t.select("report_id", "pk", "parent_pk", "total_files", "highest_severity", "breaking_changes_detected")


QUERIES = {
    f.__name__: f
    for f in (
        p2_found, p2_messages, p3_found, p3_table, p3_values, p3_lifespans, p4_found, p4_rates,
        p5_found, p5_descendants, p5_reached, p6_found, p6_changes, p6_summaries,
    )
}

_PATH = r"regexp_replace(regexp_replace(trim({0}), '[\\/]+', '/', 'g'), '^(\./)+', '')"
_HASH = "regexp_replace(lower(trim({0})), '^sha256:', '')"

_P2 = r"""
with k as (
  select *, regexp_replace(regexp_replace(lower(trim(eventId)), '^urn:uuid:', ''), '[{}\-]', '', 'g') as h from event_envelopes
), n as (
  select *, row_number() over (
      partition by case when regexp_matches(h, '^[0-9a-f]{32}$') then h else '=' || trim(eventId) end, correlationId
      order by received_at, delivery_id) as rn
  from k where length(trim(eventId)) >= 8
)"""

_P4 = f"""
with c as (
  select repository, snapshot_no, {_PATH.format("file_path")} as file_path, {_HASH.format("content_hash")} as c,
         {_HASH.format("symbol_graph_hash")} as s, arrived_at from file_snapshots
), f as (
  select * from c qualify row_number() over (
    partition by repository, snapshot_no, file_path order by arrived_at desc, c desc nulls last, s desc nulls last) = 1
), n as (
  select repository, snapshot_no, lag(snapshot_no) over (partition by repository order by snapshot_no) as prev
  from (select distinct repository, snapshot_no from f)
), b as (select f.*, prev from f join n using (repository, snapshot_no) where prev is not null
), a as (select f.repository, n.snapshot_no, f.file_path, f.c, f.s from f join n on f.repository = n.repository and f.snapshot_no = n.prev
), r as (
  select coalesce(a.repository, b.repository) as repository, coalesce(a.snapshot_no, b.snapshot_no) as snapshot_no,
         coalesce(a.file_path, b.file_path) as file_path,
         case when a.repository is null then 'added' when b.repository is null then 'removed'
              when coalesce(a.c <> b.c, false) or coalesce(a.s <> b.s, false) then 'changed' end as change
  from a full join b on a.repository = b.repository and a.snapshot_no = b.snapshot_no and a.file_path = b.file_path
)"""

_NODE = _PATH
_P5 = f"""
with recursive raw as (
  select repository as repo, {_PATH.format("parent.file_path")} as pf, trim(coalesce(parent.router_symbol, '')) as ps,
         {_PATH.format("child.file_path")} as cf, trim(coalesce(child.router_symbol, '')) as cs,
         regexp_replace(regexp_replace(coalesce(trim(mount_path), ''), '\\s*/[/\\s]*', '/', 'g'), '^/|/$', '', 'g') as m
  from router_mounts where repository is not null
), e as (
  select distinct repo, pf, ps, cf, cs, case when m = '' then '' else '/' || m end as sfx from raw where pf is not null and cf is not null
), v as (
  select distinct repo, cf as f, cs as s from raw where cf is not null union select distinct repo, pf, ps from raw where pf is not null
), pairs as (select distinct repo, pf, ps, cf, cs from e),
up as (
  select repo, pf as af, ps as az, cf as f, cs as s from pairs
  union select p.repo, p.pf, p.ps, u.f, u.s from up u join pairs p on p.repo = u.repo and p.cf = u.af and p.cs = u.az
), cyc as (select distinct repo, f, s from up where af = f and az = s
), bad as (
  select repo, f, s from cyc union select u.repo, u.f, u.s from up u join cyc c on c.repo = u.repo and c.f = u.af and c.s = u.az
), ch as (
  select v.repo, v.f, v.s, v.f as rf, v.s as rs, 0 as depth, '' as path from v
  where not exists (select 1 from pairs p where p.repo = v.repo and p.cf = v.f and p.cs = v.s)
  union
  select e.repo, e.cf, e.cs, ch.rf, ch.rs, ch.depth + 1, ch.path || e.sfx from ch join e on e.repo = ch.repo and e.pf = ch.f and e.ps = ch.s
  where not exists (select 1 from bad b where b.repo = e.repo and b.f = e.cf and b.s = e.cs)
)"""

_P6_REPORTS = "with r as (select * from impact_reports qualify row_number() over (partition by report_id order by ingested_at) = 1)"
_P6_CHANGES = (
    _P6_REPORTS
    + """, c as (
  select report_id, unnest(breaking_changes) as b, generate_subscripts(breaking_changes, 1)::int as change_no from r
)"""
)


def _p6_part(tag: str, array: str, name: str) -> str:
    return f"""select report_id, change_no, '{tag}' as kind, item_no, x.{name} as item from (
  select report_id, change_no, unnest(b.{array}) as x, generate_subscripts(b.{array}, 1)::int as item_no from c where b is not null) where x is not null"""


_P3 = r"""with l as (select * from envelope_files where raw is not null and json_valid(raw) and json_type(raw) = 'OBJECT'),
t as (select distinct l.file_name, regexp_replace(substr(j.fullkey, 3), '\[\d+\]', '[]', 'g') as field,
 case j.type when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' when 'OBJECT' then 'object' when 'ARRAY' then 'array' when 'DOUBLE' then 'fraction' else 'integer' end as kind
 from l, json_tree(l.raw) j where j.type <> 'NULL' and j.fullkey <> '$'),
k as (select file_name, field, string_agg(kind, '|' order by kind) as kind from t group by all),
f as (select file_name, feed, row_number() over (partition by feed order by file_seq, file_name) as no from (select distinct file_name, feed, file_seq from envelope_files)),
p as (select k.*, f.feed, f.no from k join f using (file_name)),
c as (select coalesce(b.feed, a.feed) as feed, coalesce(b.no, a.no + 1) as no, coalesce(a.field, b.field) as field, a.kind as old, b.kind as new
 from p a full join p b on a.feed = b.feed and a.no + 1 = b.no and a.field = b.field where a.kind is distinct from b.kind),
e as (select c.*, f.file_name, case when field like '%[]' then left(field, -2) else regexp_replace(field, '(^|\.)[^.]*$', '') end as parent from c join f using (feed, no) where no > 1),
g as (select *, row_number() over (partition by file_name, parent, coalesce(old, new), old is null order by field) as n from e where old is null or new is null)
select file_name, 'type_changed' as change, field, '' as new_field from e where old is not null and new is not null
union all select coalesce(a.file_name, b.file_name), case when a.field is null then 'added' when b.field is null then 'removed' else 'renamed' end, coalesce(a.field, b.field),
 case when a.field is not null and b.field is not null then b.field else '' end
from (select * from g where new is null) a full join (select * from g where old is null) b on a.file_name = b.file_name and a.parent = b.parent and a.old = b.new and a.n = b.n"""

_P3_VALUES = r"""select l.file_name, l.line_no, count(case when j.type not in ('NULL', 'OBJECT') and j.fullkey not like '%[%'
  and not (j.type = 'VARCHAR' and j.atom::varchar like '"{%') then 1 end)::int as n_values, false as has_rest
from (select *, row_number() over () as n from envelope_files where raw is not null and json_valid(raw) and json_type(raw) = 'OBJECT') l, json_tree(l.raw) j group by l.n, l.file_name, l.line_no"""

_P3_LIFESPANS = _P3[: _P3.index("k as (")] + r"""f as (select file_name, feed, row_number() over (partition by feed order by file_seq, file_name) as no from (select distinct file_name, feed, file_seq from envelope_files)),
s as (select feed, field, kind, no, no - row_number() over (partition by feed, field, kind order by no) as island from t join f using (file_name))
select feed, field, kind, min(no)::int as first_no, max(no)::int as last_no from s group by feed, field, kind, island"""

SQL = {
    "p3_found": _P3,
    "p3_values": _P3_VALUES,
    "p3_lifespans": _P3_LIFESPANS,
    "p2_found": _P2 + " select delivery_id from n where rn > 1",
    "p2_messages": _P2
    + """ select delivery_id, eventId, correlationId, timestamp, payload.runId as "runId" from event_envelopes
 where delivery_id not in (select delivery_id from n where rn > 1)""",
    "p4_found": _P4 + " select * from r where change is not null",
    "p4_rates": _P4 + " select repository, snapshot_no, change, count(*) as files from r where change is not null group by all",
    "p5_found": _P5
    + """
select repo as repository, f as file_path, s as router_symbol, rf as root_file_path, rs as root_router_symbol, depth,
       case when path = '' then '/' else path end as full_path from ch
union all select repo, f, s, '', '', -1, '' from bad""",
    "p5_descendants": _P5
    + """
select v.repo as repository, v.f as file_path, v.s as router_symbol, count(distinct case when u.f is not null and not exists
   (select 1 from bad b where b.repo = u.repo and b.f = u.f and b.s = u.s) then u.f || chr(31) || u.s end) as descendants
from v left join up u on u.repo = v.repo and u.af = v.f and u.az = v.s
where not exists (select 1 from bad b where b.repo = v.repo and b.f = v.f and b.s = v.s) group by all""",
    "p5_reached": _P5
    + """
select v.repo as repository, v.f as file_path, v.s as router_symbol,
       count(distinct case when u.f <> v.f or u.s <> v.s then u.f || chr(31) || u.s end) as descendants
from v left join up u on u.repo = v.repo and u.af = v.f and u.az = v.s group by all""",
    "p6_found": _P6_CHANGES
    + """
select report_id, 0 as change_no, 'affected_package' as kind, item_no, x as item from (
  select report_id, unnest(report.affected_packages) as x, generate_subscripts(report.affected_packages, 1)::int as item_no from r) where x is not null
union all """
    + "\nunion all ".join(
        _p6_part(*a)
        for a in (
            ("symbol_mutation", "symbol_mutations", "symbol_name"),
            ("contract_break", "contract_breaks", "endpoint"),
            ("middleware_break", "middleware_breaks", "middleware_name"),
        )
    ),
    "p6_changes": _P6_CHANGES
    + """ select report_id, concat_ws('/', report_id, 'breaking_change', change_no, 0) as pk, concat_ws('/', report_id, 'report', 0, 0) as parent_pk,
 change_no, b.id as change_id, b.source as source, b.severity as severity from c where b is not null""",
    "p6_summaries": _P6_REPORTS
    + """ select report_id, concat_ws('/', report_id, 'analysis_summary', 0, 0) as pk, concat_ws('/', report_id, 'report', 0, 0) as parent_pk,
 report.analysis_summary.total_files as total_files, report.analysis_summary.highest_severity as highest_severity,
 report.analysis_summary.breaking_changes_detected as breaking_changes_detected from r where report.analysis_summary is not null""",
}
