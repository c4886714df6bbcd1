"""DuckDB SQL that states the same results as plans/problems.py, where SQL can."""

from __future__ import annotations

from ..functions.text import sql_trim_class

WS = f"({sql_trim_class()})"
RFC = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?([Zz]|[+-]([01][0-9]|2[0-3]):[0-5][0-9])$"


def norm(c: str) -> str:
    return f"lower(trim({c}, {WS}))"


def micros(c: str) -> str:
    """Epoch microseconds of a readable time, else null."""
    off = f"case when upper(right({c}, 1)) = 'Z' then 0 else (case substr(right({c}, 6), 1, 1) when '-' then -1 else 1 end) * (try_cast(substr(right({c}, 5), 1, 2) as bigint) * 60 + try_cast(right({c}, 2) as bigint)) end"
    frac = f"rpad(substr(regexp_extract({c}, '\\.([0-9]+)', 1), 1, 6), 6, '0')"
    return (
        f"(case when regexp_matches({c}, '{RFC}') and not contains({c}, chr(10)) and substr({c}, 18, 2) < '60' and substr({c}, 12, 2) < '24' then "
        f"epoch_us(try_cast(upper(substr({c}, 1, 19)) as timestamp)) + coalesce(try_cast({frac} as bigint), 0) - ({off}) * 60000000 end)"
    )


FIRST = f"""first_rows as (
  select * replace (coalesce({norm('uuid')}, '') as uuid, {norm('session_id')} as session_id, {norm('parent_uuid')} as parent_uuid)
  from messages qualify row_number() over (partition by coalesce({norm('uuid')}, '') order by seq) = 1)"""

P1 = f"""with {FIRST},
arr as (select coalesce(source, '') as source, {norm('session_id')} as k, min(loaded_at) as at from sessions where {norm('session_id')} <> '' group by 1, 2),
gone as (select distinct coalesce(source, '') as source, {norm('session_id')} as k from deleted_sessions),
m as (select uuid, coalesce(source, '') as source, session_id as k, loaded_at from first_rows where session_id <> '')
select 'messages' as from_table, m.source, m.uuid as ref_key,
  case when arr.k is not null then 'late' when gone.k is not null then 'deleted' else 'missing' end as orphan_kind,
  strftime(m.loaded_at at time zone 'UTC', '%Y-%m') as loaded_month
from m left join arr on arr.source = m.source and arr.k = m.k left join gone on gone.source = m.source and gone.k = m.k
where arr.k is null or arr.at > m.loaded_at
union all
select 'sessions', arr.source, arr.k, 'unused', strftime(arr.at at time zone 'UTC', '%Y-%m')
from arr where not exists (select 1 from m where m.source = arr.source and m.k = arr.k)"""

P3_WALK = f"""with recursive {FIRST},
n as (select uuid, nullif(parent_uuid, '') as p from first_rows),
e as (select n.uuid, q.uuid as parent from n left join n q on q.uuid = n.p),
walk(uuid, root_uuid, node_depth) as (
  select uuid, uuid, 0::bigint from e where parent is null
  union all select e.uuid, w.root_uuid, w.node_depth + 1 from e join walk w on e.parent = w.uuid),
loose as (select uuid, parent from e where uuid not in (select uuid from walk)),
far(v, cur, steps) as (
  select uuid, parent, 1 from loose
  union select f.v, l.parent, f.steps + 1 from far f join loose l on l.uuid = f.cur where f.cur <> f.v and f.steps < 1000)
"""
P3 = P3_WALK + """select uuid, root_uuid, node_depth, 'tree' as link_state from walk where node_depth > 0
union all select uuid, '', -1::bigint, case when exists (select 1 from far f where f.v = l.uuid and f.cur = l.uuid) then 'cycle' else 'hung' end from loose l"""

P3_PATHS = f"""with recursive {FIRST},
n as (select uuid, nullif(parent_uuid, '') as p from first_rows),
e as (select n.uuid, q.uuid as parent from n left join n q on q.uuid = n.p),
walk(uuid, root_uuid, node_depth, path) as (
  select uuid, uuid, 0::bigint, uuid from e where parent is null
  union all select e.uuid, w.root_uuid, w.node_depth + 1, w.path || '/' || e.uuid from e join walk w on e.parent = w.uuid)
"""
P3_PAIRS = f"""with recursive {FIRST},
n as (select uuid, nullif(parent_uuid, '') as p from first_rows),
e as (select n.uuid, q.uuid as parent from n left join n q on q.uuid = n.p),
walk(uuid) as (select uuid from e where parent is null union all select e.uuid from e join walk w on e.parent = w.uuid),
pairs(uuid, descendant_uuid, distance) as (
  select parent, uuid, 1::bigint from e where parent is not null and uuid in (select uuid from walk)
  union all select e.parent, d.descendant_uuid, d.distance + 1 from pairs d join e on e.uuid = d.uuid where e.parent is not null)
select uuid, descendant_uuid, distance from pairs"""
P3_DESC = P3_PATHS + """, up as (select uuid, unnest(string_split(path, '/')) as anc, unnest(range(node_depth + 1)) as pos, node_depth from walk),
below as (select anc, count(*) filter (node_depth - pos = 1) as c, count(*) as n, max(node_depth - pos) as h from up where pos < node_depth group by 1)
select w.uuid, coalesce(c, 0)::bigint as n_children, coalesce(n, 0)::bigint as n_descendants, coalesce(h, 0)::bigint as height from walk w left join below on anc = w.uuid"""

P6 = f"""with s as (
  select regexp_replace(trim(string_split(trim(repo_path, {WS}), '/.claude/worktrees/')[1], {WS}), '/+$', '') as repo_path,
    {micros('started_at')} as a, {micros('ended_at')} as e from sessions where repo_path is not null),
iv as (select repo_path, a, coalesce(e, a) as b from s where repo_path <> '' and a is not null and coalesce(e, a) >= a),
o as (select *, max(b) over (partition by repo_path order by a, b rows between unbounded preceding and 1 preceding) as top from iv),
g as (select *, sum(case when top is null or a > top then 1 else 0 end) over (partition by repo_path order by a, b rows unbounded preceding) as grp from o),
p as (select repo_path, grp, min(a) as a, max(b) as b from g group by 1, 2),
l as (select *, lead(a) over (partition by repo_path order by a) as nxt from p)
select distinct repo_path, span_kind, (floor(f / 1000))::bigint as from_ms, (floor(t / 1000))::bigint as to_ms from (
  select repo_path, 'period' as span_kind, a as f, b as t from l union all select repo_path, 'gap', b, nxt from l where nxt is not null)"""

SQL = {
    "p1_found": P1,
    "p1_rates": f"select from_table, source, orphan_kind, loaded_month, count(*) as orphans from ({P1}) group by all",
    "p3_found": P3,
    "p3_paths": P3_PATHS + "select uuid, root_uuid, node_depth, path from walk",
    "p3_pairs": P3_PAIRS,
    "p3_descendants": P3_DESC,
    "p6_found": P6,
}

# JSON: DuckDB's json_valid takes trailing commas, NaN and Infinity, which are looked for outside of strings.
JSON_LINES = f"""bare as (select *, trim(line, {WS}) as body from raw_records where trim(line, {WS}) <> ''),
judged as (select *, json_valid(body) and body like '{{%' and not regexp_matches(regexp_replace(body, '"(?:[^"\\\\]|\\\\.)*"', '""', 'g'), ',\\s*[}}\\]]|(?i:nan|inf)') as ok from bare),
good as (select *, body::json as j, case source when 'claude_code' then 'message' when 'codex' then 'payload' end as inner_name from judged where ok),
typed as (select *, case when json_type(j, '$.type') = 'VARCHAR' then json_extract_string(j, '$.type') else '' end as rtype,
  case source when 'claude_code' then json_type(j, '$.message') when 'codex' then json_type(j, '$.payload') end as inner_type,
  case source when 'claude_code' then json_extract(j, '$.message.content') when 'codex' then json_extract(j, '$.payload.content') end as content,
  case when json_type(j, '$.timestamp') = 'VARCHAR' then json_extract_string(j, '$.timestamp') end as ts from good),
reasons as (select *, case
  when (source = 'codex' or source = 'claude_code' and rtype in ('user', 'assistant')) and coalesce(inner_type, '') <> 'OBJECT' then 'no_body'
  when (source = 'codex' or source = 'claude_code' and rtype in ('user', 'assistant')) and (json_type(content) in ('BOOLEAN', 'BIGINT', 'UBIGINT', 'HUGEINT', 'DOUBLE')
    or json_type(content) = 'ARRAY' and len(list_filter(json_extract(content, '$[*]'), lambda x: json_type(x) <> 'OBJECT')) > 0) then 'bad_content'
  when ts <> '' and {micros('ts')} is null then 'bad_time' end as reason from typed),
loads as (select * from reasons where reason is null)"""

P7 = f"with {JSON_LINES} select record_id, 'not_json' as fail_reason from judged where not coalesce(ok, false) union all select record_id, reason from reasons where reason is not null"

# A node's own key or index at the end of its path.
LAST = r"(\[[0-9]+\])+$"
STEP = r'\.("(?:[^"]*)"|[^.\[]+)(\[[0-9]+\])*$'
P4 = f"""with {JSON_LINES},
nodes as (select record_id, substr(t.fullkey, 3) as node_path, regexp_replace(substr(t.fullkey, 3), '{STEP}', '') as up,
    case when json_type(t.value, '$.type') = 'VARCHAR' then json_extract_string(t.value, '$.type') else '' end as node_type, inner_name
  from loads, json_tree(json_object(inner_name, json_extract(j, '$.' || inner_name))) t where inner_type = 'OBJECT' and t.type = 'OBJECT' and t.fullkey <> '$')
select distinct record_id, node_path, case when node_path = inner_name then '' else up end as parent_path, node_type from nodes"""

# Objects of a body in the order of a walk: with r objects before it and d around it, r - d of those before are closed.
NODES = f"""with recursive {JSON_LINES},
tree as (select record_id, source, t.id, t.parent, t.key, t.type, t.value, t.fullkey, inner_name
  from loads, json_tree(json_object(inner_name, json_extract(j, '$.' || inner_name))) t where inner_type = 'OBJECT'),
owner_of(record_id, id, cur, top, name) as (
  select c.record_id, c.id, c.parent, c.id, case when p.type = 'ARRAY' then '[' || c.key || ']' else c.key end from tree c join tree p on p.record_id = c.record_id and p.id = c.parent where c.parent is not null and c.parent > 0 or p.type = 'ARRAY'
  union all select o.record_id, o.id, c.parent, c.id, case when p.type = 'ARRAY' then '[' || c.key || ']' else c.key end || o.name
  from owner_of o join tree c on c.record_id = o.record_id and c.id = o.cur and c.type = 'ARRAY' join tree p on p.record_id = c.record_id and p.id = c.parent),
owned as (select o.* from owner_of o join tree c on c.record_id = o.record_id and c.id = o.cur where c.type = 'OBJECT'),
above(record_id, id, up) as (
  select record_id, id, cur from owned join tree using (record_id, id) where type = 'OBJECT'
  union all select a.record_id, a.id, o.cur from above a join owned o on o.record_id = a.record_id and o.id = a.up),
objects as (select record_id, source, id, substr(fullkey, 3) as node_path, case when json_type(value, '$.type') = 'VARCHAR' then json_extract_string(value, '$.type') else '' end as node_type,
  row_number() over (partition by record_id order by id) - 1 as r from tree where type = 'OBJECT' and id > 0),
placed as (select o.*, (select count(*) from above a where a.record_id = o.record_id and a.id = o.id) as d, (select count(*) from above a where a.record_id = o.record_id and a.up = o.id) as below,
  (select cur from owned w where w.record_id = o.record_id and w.id = o.id) as up from objects o),
labelled as (select *, 2 * r - d as pre, 2 * r - d + 2 * below + 1 as post from placed)
"""
VALUE = "case when t.type = 'NULL' then null when t.type = 'VARCHAR' then json_extract_string(t.value, '$') else t.value::varchar end"
P4_NODES = NODES + f""", boxes as (select distinct o.record_id, o.top from owned o join tree t using (record_id, id) where t.type = 'OBJECT' and o.top <> o.id),
cells as (select o.record_id, o.cur as id, o.name, {VALUE} as v from owned o join tree t using (record_id, id) left join boxes b on b.record_id = o.record_id and b.top = o.top
  where t.type <> 'OBJECT' and (t.type <> 'ARRAY' and (o.top = o.id or b.top is not null)
    or t.type = 'ARRAY' and (o.top = o.id and not exists (select 1 from boxes x where x.record_id = o.record_id and x.top = o.id) or o.top <> o.id and b.top is not null and json_array_length(t.value) = 0))),
packed as (select record_id, id, to_json(map(list(name order by name), list(v order by name)))::varchar as fields from cells group by 1, 2)
select l.record_id, l.source, l.pre, l.post, l.d as depth, l.node_path, u.pre as parent_pre, l.node_type, coalesce(p.fields, '{{}}') as fields
from labelled l left join packed p using (record_id, id) left join labelled u on u.record_id = l.record_id and u.id = l.up"""
P4_BY_TYPE = P4_NODES.replace("select l.record_id, l.source, l.pre", ", n as (select l.record_id, l.source, l.pre", 1) + """)
select node_type, field, count(*) as n_nodes from (select node_type, unnest(json_keys(fields)) as field from n) group by all"""
P4_ENCLOSED = NODES + """select i.record_id, i.pre, i.node_path, i.node_type, o.pre as outer_pre, o.node_path as outer_path, o.node_type as outer_type
from above a join labelled i on i.record_id = a.record_id and i.id = a.id join labelled o on o.record_id = a.record_id and o.id = a.up where o.node_type in ('tool_use', 'tool_result', 'function_call')"""

P2_PARTS = f"""with {JSON_LINES},
rec as (select record_id, coalesce(source, '') as source, coalesce(jsonl_path, '') as jsonl_path, j, rtype || case when source = 'codex' and rtype = 'response_item'
  then ':' || case when json_type(j, '$.payload.type') = 'VARCHAR' then json_extract_string(j, '$.payload.type') else '' end else '' end as record_type from loads),
listed as (select source, record_type, case when contains(field_path, '.') then regexp_replace(field_path, '\\.[^.]*$', '') else '' end as obj, regexp_extract(field_path, '[^.]*$') as field,
  field_path, '|' || json_types || '|' as json_types, is_required from expected_fields),
unknown as (select distinct jsonl_path, record_type, source from rec where not exists (select 1 from listed l where l.source = rec.source and l.record_type = rec.record_type)),
tree as (select record_id, source, jsonl_path, record_type, t.id, t.parent, t.key, t.type,
    case when t.fullkey = '$' then '' else regexp_replace(substr(t.fullkey, 3), '\\[[0-9]+\\]', '[]', 'g') end as general from rec, json_tree(j) t),
objs as (select record_id, source, jsonl_path, record_type, id, general as obj from tree where type = 'OBJECT'
  and exists (select 1 from listed l where l.source = tree.source and l.record_type = tree.record_type and l.obj = tree.general)),
total as (select source, jsonl_path, record_type, obj, count(*) as n from objs group by all),
fields as (select o.source, o.jsonl_path, o.record_type, o.obj, t.key as field, count(distinct (t.record_id, o.id)) as present,
    list(distinct case t.type when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' when 'OBJECT' then 'object' when 'ARRAY' then 'array' when 'NULL' then 'null' else 'number' end) as kinds
  from objs o join tree t on t.record_id = o.record_id and t.parent = o.id group by all),
removed as (select t.source, t.jsonl_path, t.record_type, t.obj, l.field, l.json_types, count(*) over (partition by t.source, t.jsonl_path, t.record_type, t.obj) as n_removed
  from total t join listed l on l.source = t.source and l.record_type = t.record_type and l.obj = t.obj and l.is_required
  where not exists (select 1 from fields f where f.source = t.source and f.jsonl_path = t.jsonl_path and f.record_type = t.record_type and f.obj = t.obj and f.field = l.field)),
added as (select f.*, t.n from fields f join total t using (source, jsonl_path, record_type, obj)
  where not exists (select 1 from listed l where l.source = f.source and l.record_type = f.record_type and l.obj = f.obj and l.field = f.field)),
fit as (select a.source, a.jsonl_path, a.record_type, a.obj, r.field as old, a.field as new, count(*) over (partition by a.source, a.jsonl_path, a.record_type, a.obj) as n_fit
  from added a join removed r using (source, jsonl_path, record_type, obj) where r.n_removed = 1 and a.present = a.n and len(list_filter(a.kinds, lambda k: k <> 'null' and not contains(r.json_types, '|' || k || '|'))) = 0),
renamed as (select * from fit where n_fit = 1),
path(obj, field, full_path) as (select distinct obj, field, case when obj = '' then field else obj || '.' || field end from (select obj, field from fields union select obj, field from removed))
"""
P2 = P2_PARTS + """select jsonl_path, record_type, 'added' as change_kind, case when source = 'codex' and record_type like 'response\\_item:%' escape '\\' then 'payload.type' else 'type' end as field_path, '' as new_path from unknown
union all select jsonl_path, record_type, 'retyped', l.field_path, '' from fields f join listed l using (source, record_type, obj, field)
  where len(list_filter(f.kinds, lambda k: k <> 'null' and not contains(l.json_types, '|' || k || '|'))) > 0
union all select jsonl_path, record_type, 'removed', full_path, '' from removed r join path using (obj, field) where not exists (select 1 from renamed n where n.source = r.source and n.jsonl_path = r.jsonl_path and n.record_type = r.record_type and n.obj = r.obj)
union all select jsonl_path, record_type, 'added', full_path, '' from added a join path using (obj, field) where not exists (select 1 from renamed n where n.source = a.source and n.jsonl_path = a.jsonl_path and n.record_type = a.record_type and n.obj = a.obj and n.new = a.field)
union all select jsonl_path, record_type, 'renamed', p.full_path, q.full_path from renamed n join path p on p.obj = n.obj and p.field = n.old join path q on q.obj = n.obj and q.field = n.new"""

P2_UNIFIED = P2_PARTS.replace("select record_id, coalesce(source, '') as source", "select record_id, line_number, coalesce(source, '') as source", 1) + f""", t as (
  select record_id, line_number, source, jsonl_path, record_type, x.id, x.parent, x.type, x.value, substr(x.fullkey, 3) as at, regexp_replace(substr(x.fullkey, 3), '\\[[0-9]+\\]', '[]', 'g') as general from rec, json_tree(j) x),
known as (select distinct source, record_type, obj from listed),
opened as (select t.* from t join known k on k.source = t.source and k.record_type = t.record_type and k.obj = t.general where t.type = 'OBJECT' and t.id > 0
  union all select t.* from t where t.id = 0),
cells as (select t.record_id, case when n.old is null then t.at else regexp_replace(t.at, '[^.]*$', n.old) end as name, {VALUE} as v, l.field is not null or n.old is not null as is_listed,
    case when l.field is not null and t.type <> 'NULL' and not contains(l.json_types, '|' || k.kind || '|') then k.kind end as odd
  from opened o join t on t.record_id = o.record_id and t.parent = o.id
  cross join lateral (select case t.type when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' when 'OBJECT' then 'object' when 'ARRAY' then 'array' else 'number' end as kind) k
  left join listed l on l.source = t.source and l.record_type = t.record_type and l.field_path = t.general
  left join renamed n on n.jsonl_path = t.jsonl_path and n.record_type = t.record_type and t.general = case when n.obj = '' then n.new else n.obj || '.' || n.new end
  where not (t.type = 'OBJECT' and len(json_keys(t.value)) > 0 and exists (select 1 from known q where q.source = t.source and q.record_type = t.record_type and q.obj = t.general))
    and not (t.type = 'ARRAY' and json_array_length(t.value) > 0 and exists (select 1 from known q where q.source = t.source and q.record_type = t.record_type and q.obj = t.general || '[]')
      and len(list_filter(json_extract(t.value, '$[*]'), lambda e: json_type(e) <> 'OBJECT' or e::varchar = '{{}}')) = 0)),
packed as (select record_id, to_json(map(list(name order by name) filter (is_listed), list(v order by name) filter (is_listed)))::varchar as fields,
    to_json(map(list(name order by name) filter (not is_listed), list(v order by name) filter (not is_listed)))::varchar as other,
    to_json(map(list(name order by name) filter (odd is not null), list(odd order by name) filter (odd is not null)))::varchar as retyped from cells group by 1)
select r.record_id, r.source, r.jsonl_path, r.line_number, r.record_type, coalesce(fields, '{{}}') as fields, coalesce(other, '{{}}') as other, coalesce(retyped, '{{}}') as retyped from rec r left join packed using (record_id)"""

SQL |= {
    "p2_found": P2,
    "p2_unified": P2_UNIFIED,
    "p4_found": P4,
    "p4_nodes": P4_NODES,
    "p4_by_type": P4_BY_TYPE,
    "p4_enclosed": P4_ENCLOSED,
    "p7_found": P7,
    "p7_clean": f"with {JSON_LINES} select raw_records.* from raw_records join loads using (record_id)",
}
