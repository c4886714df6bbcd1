"""DuckDB SQL that states the same results as plans/reference.py."""

from __future__ import annotations

from .problems_sql import FIRST, JSON_LINES, WS, micros, norm

SINCE, UNTIL = "2024-06-01T00:00:00.000Z", "2025-03-01T00:00:00.000Z"
LOOKUP = "9e1b223c-9dac-4ed1-a44d-7640366c7f54"


def _fold(c: str) -> str:
    return f"translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _last(c: str) -> str:
    return f"arg_max({c}, {{'a': coalesce(loaded_at, '1970-01-01 00:00:00+00'::timestamptz), 'b': coalesce(imported_at, ''), 'c': {c}}}) filter ({c} <> '')"


SESS = f"""sess as (select source, {norm('session_id')} as session_id, coalesce({_last('cwd')}, '') as cwd, {_last('repo_path')} as repo_path,
  coalesce({_last('git_branch')}, '') as git_branch, coalesce({_last('version')}, '') as version, {_last('custom_title')} as custom_title, {_last('agent_name')} as agent_name,
  min(started_at) as started_at, max(ended_at) as ended_at, max(imported_at) as imported_at
  from sessions where {norm('session_id')} <> '' and source <> '' group by 1, 2)"""
MAIN = "main as (select * from first_rows where not is_sidechain and source is not null and session_id is not null)"
TURNS = """turns as (select *, greatest(sum(case when role = 'user' then 1 else 0 end) over (partition by source, session_id order by timestamp nulls first, seq rows unbounded preceding), 1)::bigint as turn from main)"""
W_M = f"with {FIRST}, {MAIN} "
W_T = f"with {FIRST}, {MAIN}, {TURNS} "
W_S = f"with {SESS} "
W_ALL = f"with {FIRST}, {MAIN}, {TURNS}, {SESS} "
LIST = """select row_number() over (order by coalesce(s.started_at, '') desc, s.source, s.session_id) as rank, s.source, s.session_id, s.cwd, coalesce(s.repo_path, '') as repo_path, coalesce(s.started_at, '') as started_at, coalesce(s.ended_at, '') as ended_at,
  coalesce(s.custom_title, '') as custom_title, count(m.uuid) as message_count, coalesce(sum(strlen(m.content)) filter (where not m.is_sidechain), 0)::bigint as body_size
  from sess s left join first_rows m on m.source = s.source and m.session_id = s.session_id"""
BY = " group by s.source, s.session_id, s.cwd, s.repo_path, s.started_at, s.ended_at, s.custom_title"
RANGE = f" s.started_at >= '{SINCE}' and s.started_at < '{UNTIL}' "
ALIAS = """case when repo_path in ('keeper', 'ledgerkit-38d70', '/work/ledgerkit-db434') or base in ('keeper', 'ledgerkit-38d70', '/work/ledgerkit-db434') then 'keeper'
  when repo_path in ('pebbles', 'pebblework-f5ce1', 'pebblework-68c52') or base in ('pebbles', 'pebblework-f5ce1', 'pebblework-68c52') then 'pebbles' end"""
BASE = "case when repo_path = '' then '' when regexp_replace(repo_path, '/+$', '') = '' then '/' else regexp_extract(regexp_replace(repo_path, '/+$', ''), '[^/]*$') end"
LINE = f"regexp_replace(split_part(trim(content, {WS}), chr(10), 1), '\\r+$', '')"


def _utc(t: str) -> str:
    return f"strftime({t}, '%Y-%m-%dT%H:%M:%S.000Z')"


def _local(c: str, fmt: str = "%Y-%m-%d %H:%M", minus_h: int = 0) -> str:
    return f"strftime(make_timestamp({micros(c)} - {minus_h} * 3600000000) + interval 9 hour, '{fmt}')"


def local_time(c: str) -> str:
    return f"coalesce({_local(c)}, {c})"


def time_range(a: str, b: str) -> str:
    return f"case when {b} = '' then {local_time(a)} || ' ~' else {local_time(a)} || ' ~ ' || {local_time(b)} end"


def logical_day(a: str, b: str) -> str:
    v = f"(case when {b} <> '' then {b} else {a} end)"
    return f"coalesce({_local(v, '%Y-%m-%d', 4)}, '')"


NEWEST = "row_number() over (order by timestamp desc nulls last, seq desc) as rank"
HITS = f"""hits as (select m.source, m.session_id, m.uuid, m.seq, coalesce(s.repo_path, '') as repo_path, m.timestamp, m.content from main m
  join sess s on s.source = m.source and s.session_id = m.session_id where {_fold('m.content')} like '%scheduler%')"""
HIT_COLS = "select source, session_id, uuid, repo_path, timestamp, content from hits"
RANKED_HITS = f"select source, session_id, uuid, repo_path, timestamp, content, {NEWEST} from hits"
SNIP_AT = "case when strpos(content, 'Scheduler') > 0 then strpos(content, 'Scheduler') when strpos(lower(content), 'scheduler') > 0 then strpos(lower(content), 'scheduler') else 1 end"
SNIPS = f"""snips as (select *, case when b > 1 then '...' else '' end || trim(substr(content, b, e - b + 1), {WS}) || case when e < length(content) then '...' else '' end as snippet from (
  select *, greatest(hit - 40, 1) as b, least(hit + 48, length(content)) as e from (select *, {SNIP_AT} as hit from hits)))"""
NONCMD = f"""cmd as (select source, session_id, timestamp, seq, {LINE} as line from main where role = 'user'
  and not coalesce(trim(content, {WS}) like '/%' or regexp_matches(trim(content, {WS}), '^Look at') or regexp_matches(trim(content, {WS}), '(?i)checks only'), false)),
noncmd as (select source, session_id, count(*) as noncommand_turns, coalesce((arg_min(line, {{'a': timestamp, 'b': seq}}) filter (line <> '')), '') as first_noncommand_line from cmd group by 1, 2)"""
SUMMARY = "select uuid, source, session_id, rank, content from (select *, row_number() over (partition by source, session_id order by timestamp, seq) as rank from main where role = 'user'{w}) where rank <= 2"
SYN = f" and {_fold('content')} not like '<command-name>/clear</command-name>%' and {_fold('content')} not like '<local-command-caveat>%'"
META_TYPES = " and ".join(
    [f"coalesce(json_type(g.j, '{p}'), 'NULL') in ('VARCHAR', 'NULL')" for p in ("$.timestamp", "$.payload.id", "$.payload.cwd", "$.payload.cli_version", "$.payload.git.branch")]
    + ["coalesce(json_type(g.j, '$.payload.git'), 'NULL') in ('OBJECT', 'NULL')"]
)


def _typed(j: str, paths: list[str], kind: str = "VARCHAR") -> str:
    return " and ".join(f"coalesce(json_type({j}, '{p}'), 'NULL') in ('{kind}', 'NULL')" for p in paths)


def _blocks(content: str) -> str:
    """Null, or a list of nulls and objects whose type and text are strings or null."""
    bad = f"json_type(x) not in ('OBJECT', 'NULL') or not ({_typed('x', ['$.type', '$.text'])})"
    return f"(json_type({content}) = 'NULL' or json_type({content}) = 'ARRAY' and len(list_filter(json_extract({content}, '$[*]'), lambda x: {bad})) = 0)"


LINES = f"""with {JSON_LINES},
lines as (select r.source, r.record_id, r.jsonl_path, r.line_number, coalesce(trim(r.line, {WS}), '') as text, g.j as j, g.rtype as rtype, g.content as content, g.inner_type as inner_type
  from raw_records r left join typed g using (record_id)),
one as (select *, case
  when text in ('', 'null') then 'ignored' when j is null then 'unparsed'
  when source = 'claude_code' then case
    when not ({_typed('j', ['$.type', '$.uuid', '$.parentUuid', '$.sessionId', '$.timestamp', '$.cwd', '$.gitBranch', '$.version', '$.customTitle', '$.agentName'])} and {_typed('j', ['$.isSidechain'], 'BOOLEAN')}) then 'unparsed'
    when rtype = 'custom-title' then 'title' when rtype = 'agent-name' then 'agent' when rtype not in ('user', 'assistant') then 'ignored'
    when coalesce(inner_type, '') <> 'OBJECT' or not ({_typed('j', ['$.message.role'])}) or content is null then 'unparsed'
    when json_type(content) = 'VARCHAR' or {_blocks('content')} then 'body' else 'unparsed' end
  else case
    when not ({_typed('j', ['$.type', '$.timestamp'])}) then 'unparsed'
    when rtype = 'session_meta' then case when coalesce(inner_type, '') in ('OBJECT', 'NULL') and {META_TYPES.replace('g.j', 'j')} then 'meta' else 'unparsed' end
    when rtype <> 'response_item' then 'ignored'
    when coalesce(inner_type, '') not in ('OBJECT', 'NULL') or not ({_typed('j', ['$.payload.type', '$.payload.role'])}) then 'unparsed'
    when coalesce(json_extract_string(j, '$.payload.type'), '') <> 'message' or coalesce(json_extract_string(j, '$.payload.role'), '') not in ('user', 'assistant') then 'ignored'
    when content is not null and {_blocks('content')} then 'body' else 'bad_body' end end as kind from lines),
known as (select *, count(*) filter (kind = 'meta') over (partition by source, jsonl_path order by line_number range unbounded preceding) as metas from one)"""
OUTCOMES = LINES + """ select source, case when source = 'codex' and kind in ('body', 'bad_body') then case when metas = 0 then 'ignored' when kind = 'body' then 'body' else 'unparsed' end else kind end as outcome, count(*) as lines
from known group by 1, 2"""
# Texts of content blocks of the given types, blank lines between them; a content that is a string is the text.
_TEXTS = "case when json_type(content) = 'VARCHAR' then json_extract_string(content, '$') when json_type(content) = 'ARRAY' then coalesce(array_to_string(list_filter(list_transform(json_extract(content, '$[*]'), lambda x: case when json_extract_string(x, '$.type') in ({kinds}) then json_extract_string(x, '$.text') end), lambda t: t <> ''), chr(10) || chr(10)), '') else '' end"
_FIELD = "coalesce(json_extract_string(j, '{p}'), '')"
LOG_MESSAGES = LINES + f""", filled as (select *, last_value(case when kind = 'meta' then {{'id': {_FIELD.format(p='$.payload.id')}, 'cwd': {_FIELD.format(p='$.payload.cwd')}, 'branch': {_FIELD.format(p='$.payload.git.branch')},
    'version': {_FIELD.format(p='$.payload.cli_version')}, 'ts': {_FIELD.format(p='$.timestamp')}}} end ignore nulls) over (partition by source, jsonl_path order by line_number rows unbounded preceding) as meta from known where jsonl_path is not null),
a as (select record_id, source, {_FIELD.format(p='$.uuid')} as uuid, {_FIELD.format(p='$.sessionId')} as session_id, json_extract_string(j, '$.parentUuid') as parent_uuid, {_FIELD.format(p='$.message.role')} as role,
    {_TEXTS.replace('{kinds}', "'text'")} as content, {_FIELD.format(p='$.timestamp')} as timestamp, {_FIELD.format(p='$.cwd')} as cwd, {_FIELD.format(p='$.gitBranch')} as git_branch, {_FIELD.format(p='$.version')} as version,
    coalesce(json_extract(j, '$.isSidechain')::varchar = 'true', false) as is_sidechain from filled where source = 'claude_code' and kind = 'body'),
b as (select record_id, source, 'codex:' || sha256(jsonl_path || chr(0) || line_number) as uuid, meta.id as session_id, null as parent_uuid, {_FIELD.format(p='$.payload.role')} as role,
    {_TEXTS.replace('{kinds}', "'input_text', 'output_text', 'text'")} as content, case when {_FIELD.format(p='$.timestamp')} = '' then meta.ts else {_FIELD.format(p='$.timestamp')} end as timestamp,
    meta.cwd as cwd, meta.branch as git_branch, meta.version as version, false as is_sidechain from filled where source = 'codex' and kind = 'body' and meta is not null)
select *, trim(content, {WS}) <> '' as has_content from (select * from a union all select * from b)"""
DISPLAY = f"(select *, {ALIAS} as alias from (select *, {BASE} as base from (select * replace (coalesce(repo_path, '') as repo_path) from sess)))"

SQL = {
    "incremental_plan": """select jsonl_path, size, action, (case action when 'resume' then last_offset when 'skip' then null else 0 end)::bigint as start from (
      select *, case when file_size is null then 'new' when size = file_size then 'skip' when size > file_size then 'resume' else 'reread' end as action from (
        select jsonl_path, file_size, last_offset, file_size + (length(jsonl_path) % 3) - 1 as size from import_state
        union all select jsonl_path || '.copy', null, null, sum(strlen(line) + 1)::bigint from raw_records where jsonl_path is not null group by 1))""",
    "parse_outcomes": OUTCOMES,
    "log_messages": LOG_MESSAGES,
    "session_upsert": W_S + "select * from sess",
    "dedup_first_wins": f"with {FIRST} select uuid, seq, source, session_id, role from first_rows",
    "sessions_list": W_ALL + LIST + BY,
    "sessions_since_until": W_ALL + LIST + " where" + RANGE + BY,
    "sessions_project": W_ALL + LIST + f" where {_fold('s.repo_path')} like '%ledger%38%'" + BY,
    "sessions_alias_filter": W_ALL + LIST + " where " + " or ".join(f"{_fold('s.repo_path')} like '%{p}%'" for p in ("pebbles", "pebblework-f5ce1", "pebblework-68c52")) + BY,
    "sessions_combined": W_ALL + LIST + " where" + RANGE + f"and ({_fold('s.repo_path')} like '%pebble%' or {_fold('s.repo_path')} like '%larkspur%')" + BY,
    # Days of Tokyo that start at four; the end is the start of the day after.
    "sessions_dates": W_ALL + LIST + f" where s.started_at >= {_utc("timestamp '2024-06-01' + interval 4 hour - interval 9 hour")} and s.started_at < {_utc("timestamp '2024-12-31' + interval 4 hour + interval 1 day - interval 9 hour")}" + BY,
    "sessions_last": W_ALL + LIST + f" where s.started_at >= {_utc("timestamp '2025-03-01' - interval 300 day")} and s.started_at < {_utc("timestamp '2025-01-31 09:30' - interval 9 hour")} and (" + " or ".join(f"{_fold('s.repo_path')} like '%{p}%'" for p in ("pebbles", "pebblework-f5ce1", "pebblework-68c52")) + ")" + BY,
    "nonblank_messages": f"with {FIRST} select uuid, source, session_id from first_rows where trim(content, {WS}) <> ''",
    "messages_main": W_M + "select uuid, seq, source, session_id, role, content, timestamp, row_number() over (partition by source, session_id order by timestamp nulls first, seq) as rank from main",
    "turns": W_T + "select uuid, source, session_id, role, turn from turns",
    "user_turns": W_T + "select uuid, source, session_id, turn from turns where role = 'user'",
    "turn_range": W_T + "select uuid, source, session_id, turn from turns where turn between 2 and 3",
    "tail_n": W_T + "select uuid, source, session_id, turn from (select *, max(turn) over (partition by source, session_id) as hi from turns) where turn >= greatest(hi - 1, 1)",
    "outline": W_T + f""", size as (select source, session_id, turn, coalesce(sum(strlen(content)), 0)::bigint as body_size from turns group by 1, 2, 3)
      select source, session_id, turn, body_size, timestamp, {LINE} as first_line from turns join size using (source, session_id, turn) where role = 'user'""",
    "summary_n": W_M + SUMMARY.replace("{w}", SYN),
    "summary_include_clear": W_M + SUMMARY.replace("{w}", ""),
    "noncommand_turns": f"with {FIRST}, {MAIN}, {NONCMD} select * from noncmd",
    "search_hits": W_ALL + "," + HITS + RANKED_HITS,
    "search_time": W_ALL + "," + HITS + HIT_COLS + f" where timestamp >= '{SINCE}' and timestamp < '{UNTIL}'",
    "search_wildcard": W_ALL + "," + HITS.replace("'%scheduler%'", "'%the%old_handle%'") + HIT_COLS,
    "search_with_turns": W_ALL + "," + HITS + "select h.uuid, h.source, h.session_id, t.turn from hits h join turns t using (uuid)",
    "search_snippet": W_ALL + "," + HITS + "," + SNIPS + " select uuid, snippet from snips",
    "search_full": W_ALL + "," + HITS + "," + SNIPS + f""" select source, session_id, uuid, turn, timestamp, seq, {NEWEST}, translate({local_time('timestamp')}, chr(9) || chr(10) || chr(13), '   ') as time,
      translate(coalesce({ALIAS}, repo_path), chr(9) || chr(10) || chr(13), '   ') as project, translate(snippet, chr(9) || chr(10) || chr(13), '   ') as snippet
      from (select n.*, t.turn, {BASE.replace('repo_path', 'n.repo_path')} as base from snips n join turns t on t.uuid = n.uuid where n.timestamp >= '{SINCE}')""",
    "sessions_full": f"with {FIRST}, {MAIN}, {SESS}, {NONCMD}, lst as ({LIST} where{RANGE}{BY})" + f"""
      select source, session_id, cwd, repo_path, started_at, ended_at, custom_title, message_count, body_size, rank, coalesce({ALIAS}, base) as project,
      {time_range('started_at', 'ended_at')} as time_range, {logical_day('started_at', 'ended_at')} as logical_day,
      coalesce(noncommand_turns, 0)::bigint as noncommand_turns, coalesce(first_noncommand_line, '') as first_noncommand_line
      from (select *, {BASE} as base from lst) left join noncmd using (source, session_id)""",
    "projects_list": W_S + f"select *, row_number() over (order by last_started desc nulls last, repo_path) as rank from (select coalesce(repo_path, '') as repo_path, count(*) as session_count, max(started_at) as last_started from sess s where{RANGE}group by 1)",
    "projects_alias": W_S + f"select project, session_count, last_started, row_number() over (order by last_started desc nulls last, project, k) as rank from (select coalesce('alias:' || alias, 'raw:' || repo_path) as k, coalesce(alias, base) as project, sum(n)::bigint as session_count, max(t) as last_started from (select repo_path, base, alias, count(*) as n, max(started_at) as t from {DISPLAY} group by 1, 2, 3) group by 1, 2)",
    "project_display": W_S + f"select source, session_id, coalesce(alias, repo_path) as project, coalesce(alias, base) as short_project from {DISPLAY}",
    "session_get": W_ALL + "select * replace (1::bigint as rank) from (" + LIST + f" where s.session_id = '{LOOKUP}' and s.source = 'codex'" + BY + ")",
    "session_lookup": W_ALL + "select * replace (row_number() over (order by source) as rank) from (" + LIST + f" where s.session_id = '{LOOKUP}'" + BY + ")",
    "ambiguous_ids": W_ALL + """select session_id, count(distinct source) as n_sources from (select source, session_id from sess union all
      select source, session_id from first_rows where session_id <> '' and source <> '') group by 1 having count(distinct source) > 1""",
    "orphan_sessions": W_ALL + "select source, session_id from sess s where not exists (select 1 from first_rows m where m.source = s.source and m.session_id = s.session_id)",
    "orphan_count": W_ALL + "select count(*) as orphans from sess s where not exists (select 1 from first_rows m where m.source = s.source and m.session_id = s.session_id)",
    "backfill_targets": W_ALL + """select source, session_id, cwd, string_split(cwd, '/.claude/worktrees/')[1] as resolved from sess s where repo_path is null and cwd <> ''
      and exists (select 1 from first_rows m where m.source = s.source and m.session_id = s.session_id)""",
    "repo_path_worktree": W_S + "select source, session_id, string_split(cwd, '/.claude/worktrees/')[1] as root from sess",
    "derived_uuid": "select record_id, 'codex:' || sha256(jsonl_path || chr(0) || line_number) as uuid from raw_records where source = 'codex'",
    "forward_fill": f"""with {JSON_LINES} select b.record_id, last_value(case when g.rtype = 'session_meta' and coalesce(g.inner_type, '') in ('OBJECT', 'NULL') and {META_TYPES} then coalesce(json_extract_string(g.j, '$.payload.id'), '') end ignore nulls)
      over (partition by b.jsonl_path order by b.line_number, b.record_id rows unbounded preceding) as session_id from bare b left join typed g using (record_id) where b.source = 'codex'""",
    "last_title": f"""with {JSON_LINES}, {SESS}, t as (select source, {norm("json_extract_string(j, '$.sessionId')")} as session_id,
        arg_max(coalesce(json_extract_string(j, '$.customTitle'), ''), record_id) filter (rtype = 'custom-title') as custom_title,
        arg_max(coalesce(json_extract_string(j, '$.agentName'), ''), record_id) filter (rtype = 'agent-name') as agent_name
      from typed where source = 'claude_code' and rtype in ('custom-title', 'agent-name') group by 1, 2) select t.* from t join sess using (source, session_id)""",
    "first_line": f"with {FIRST} select uuid, {LINE} as line from first_rows",
    "tsv_sanitize": f"with {FIRST} select uuid, translate(content, chr(9) || chr(10) || chr(13), '   ') as cell from first_rows",
    "local_time": f"with {FIRST} select uuid, {local_time('timestamp')} as local_time from first_rows",
    "time_range": W_S + f"select source, session_id, {time_range('a', 'b')} as time_range from (select source, session_id, coalesce(started_at, '') as a, coalesce(ended_at, '') as b from sess)",
    "logical_day": W_S + f"select source, session_id, {logical_day('a', 'b')} as logical_day from (select source, session_id, coalesce(started_at, '') as a, coalesce(ended_at, '') as b from sess)",
    "show_json": W_M + "select uuid, to_json({'role': role, 'content': content, 'timestamp': timestamp})::varchar as message from main",
    "show_markdown": W_M + "select uuid, chr(10) || '### ' || upper(substr(role, 1, 1)) || substr(role, 2) || chr(10) || chr(10) || content || chr(10) as markdown from main",
    "show_arrays": W_M + f"""select source, session_id, row_number() over (partition by source, session_id order by seg) as part, n_messages, text from (
      select source, session_id, substr(coalesce(timestamp, ''), 1, 13) as seg, count(*) as n_messages, string_agg(to_json({{'role': role, 'content': content, 'timestamp': coalesce(timestamp, '')}})::varchar, ',' order by coalesce(timestamp, ''), seq) as text from main group by 1, 2, 3)""",
    "show_header": W_S + f"""select source, session_id, '## ' || translate(case when custom_title <> '' then custom_title else session_id end, chr(10) || chr(13), '  ') || chr(10) || chr(10)
      || '- **Session**: `' || session_id || '`' || chr(10) || '- **Project**: `' || coalesce(alias, repo_path) || '`' || chr(10) || '- **Started**: `' || {time_range('a', 'b')} || '`' || chr(10) as header
      from (select *, coalesce(started_at, '') as a, coalesce(ended_at, '') as b from {DISPLAY})""",
    "show_bulk": W_ALL + f"""select uuid, t.source, t.session_id, turn, role, content from turns t join sess s on s.source = t.source and s.session_id = t.session_id where{RANGE}
      and ({' or '.join(f"{_fold('s.repo_path')} like '%{p}%'" for p in ('keeper', 'ledgerkit-38d70', '/work/ledgerkit-db434'))})""",
    "migrate_stamp_source": W_ALL + """select 'sessions' as table_name, source, session_id, count(*) as n_rows from sess where source = 'claude_code' group by all
      union all select 'messages', source, session_id, count(*) from first_rows where source = 'claude_code' group by all""",
}

MARKDOWN = "coalesce(chr(10) || '### ' || upper(substr(role, 1, 1)) || substr(role, 2) || chr(10) || chr(10) || content || chr(10), '')"
SQL["show_documents"] = f"""with {FIRST}, {MAIN}, heads as ({SQL['show_header'].replace(W_S, f'with {SESS} ', 1)})
  select source, session_id, 0::bigint as part, 0::bigint as n_messages, header as text from heads
  union all select source, session_id, row_number() over (partition by source, session_id order by seg), n_messages, text from (
    select source, session_id, substr(coalesce(timestamp, ''), 1, 13) as seg, count(*) as n_messages, string_agg({MARKDOWN}, '' order by coalesce(timestamp, ''), seq) as text from main group by 1, 2, 3)
  where (source, session_id) in (select (source, session_id) from heads)"""
