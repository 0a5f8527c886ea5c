"""Oracle SQL of the engine's own queries, written against the tables independently of the operators."""

from __future__ import annotations

from foliant.functions.text import ENGLISH, OTHER

PAGES = """pages as (
  select doc_id, seg_index + 1 as page, arg_min(coalesce(text, ''), segment_id) as text,
    arg_min(coalesce(title, ''), segment_id) as title
  from segments where doc_id is not null and seg_index is not null group by doc_id, seg_index)"""

FUSED = """lists as (
  select question_id, retriever, chunk_id, max(score) as score from hits group by all),
ranked as (
  select *, row_number() over (partition by question_id, retriever order by score desc nulls last, chunk_id) as r from lists),
fused as (
  select question_id, chunk_id, coalesce(1.0 / (60 + d.r), 0) + coalesce(1.0 / (60 + k.r), 0) as score, d.r as dr, k.r as kr
  from (select * from ranked where retriever = 'dense' and r <= 100) d
  full join (select * from ranked where retriever = 'keyword' and r <= 100) k using (question_id, chunk_id)),
top as (
  select question_id, chunk_id, score, row_number() over (partition by question_id order by score desc, dr nulls last, kr nulls last, chunk_id) as rank
  from fused qualify rank <= 100)"""

CAPPED = """docs as (select chunk_id, min(doc_id) as doc_id from hits group by all),
inside as (
  select t.*, doc_id, row_number() over (partition by question_id, doc_id order by rank) as n from top t join docs using (chunk_id)),
capped as (
  select question_id, chunk_id, doc_id, place as rank from (
    select *, row_number() over (partition by question_id order by rank) as place from inside where n <= 3) where place <= 20)"""

BEST = """best as (
  select * from manifests where doc_id is not null
  qualify row_number() over (partition by doc_id order by (n_pages = source_pages) desc nulls last, n_pages desc nulls last, created_at, source_path) = 1)"""

LATEST = """newest as (
  select * from ocr_results
  qualify row_number() over (partition by candidate, sample_id order by ts desc nulls last, ingested_at desc nulls last, result_id desc) = 1)"""

UNITS = """units as (
  select *, doc_id || '#' || page_no as unit from ocr_results
  where candidate is not null and doc_id is not null and page_no is not null
  qualify row_number() over (partition by candidate, doc_id, page_no order by ts desc nulls last, ingested_at desc nulls last, result_id desc) = 1)"""

PAIRS = UNITS + """,
numbered as (
  select unit, lower(regexp_replace(coalesce(text, ''), '[^\\x00-\\x7F]', '?', 'g')) as value, row_number() over (partition by unit order by candidate) as k from units),
pairs as (select a.unit, a.value as ref, b.value as hyp from numbered a join numbered b on a.unit = b.unit and a.k = 1 and b.k = 2)"""

WEIGHTS = UNITS + """,
known as (select candidate, unit, category, seconds, left(unit, 1) in ('0','1','2','3','4','5','6','7') as half from units where seconds is not null and category is not null),
diffs as (
  select a.candidate as a, b.candidate as b, a.category, a.half, a.seconds - b.seconds as diff
  from known a join known b on a.unit = b.unit and a.candidate < b.candidate),
halves as (select a, b, half, count(*) as hn from diffs group by all),
groups as (select a, b, count(*) as g from halves group by all),
weights as (
  select a, b, category, sum(s / (hn * g)) as w, sum(n) as n
  from (select a, b, category, half, sum(diff) as s, count(*) as n from diffs group by all) join halves using (a, b, half) join groups using (a, b)
  group by a, b, category),
lists as (select a, b, list(w order by category) as ws, sum(w) as diff, sum(n)::bigint as n, count(*) as n_clusters from weights group by a, b),
patterns as (
  select a, b, diff, n, n_clusters, unnest(range(0, (1 << n_clusters)::bigint)) as p, ws from lists),
tests as (
  select a, b, round(any_value(diff), 6) as diff,
    round(avg((abs(list_sum(list_transform(range(1, n_clusters + 1), lambda i: ws[i] * (case when (p >> (i - 1)) & 1 = 1 then 1 else -1 end)))) >= abs(diff) - 1e-12 * greatest(1, abs(diff)))::int), 6) as p_value,
    any_value(n) as n, any_value(n_clusters) as n_clusters, true as exact
  from patterns group by a, b)"""

RATES = """count(*) as pages, sum((error is null)::int)::bigint as ok, sum((error is not null)::int)::bigint as errors,
  round(quantile_cont(seconds, 0.5) filter (error is null), 6) as median_s, round(quantile_cont(seconds, 0.9) filter (error is null), 6) as p90_s,
  round(coalesce(sum(seconds) filter (error is null), 0), 6) as total_s,
  round(case when bool_and(gen_seconds is not null) filter (error is null)
    then sum(coalesce(total_gen_tokens, 0)) filter (error is null) / nullif(sum(gen_seconds) filter (error is null), 0)
    else sum(case when coalesce(total_gen_tokens, 0) > 0 then total_gen_tokens else gen_tokens end) filter (error is null and seconds > 0 and gen_tokens is not null)
      / nullif(sum(seconds) filter (error is null and seconds > 0 and gen_tokens is not null), 0) end, 6) as gen_tok_s,
  case when gen_tok_s is null then null when bool_and(gen_seconds is not null) filter (error is null) then 'decode' else 'end-to-end' end as gen_tok_s_basis,
  round(max(peak_memory_gb) filter (error is null), 2) as peak_memory_gb,
  round(sum((error is null and coalesce(first_finish_reason, finish_reason, '') = 'length')::int) / nullif(sum((error is null)::int), 0), 4) as first_truncation_rate,
  round(sum((error is null and coalesce(finish_reason, '') = 'length')::int) / nullif(sum((error is null)::int), 0), 4) as truncation_rate,
  case when sum((error is null and attempts is not null)::int) > 0 then round(sum((error is null and coalesce(attempts, 0) > 1)::int) / nullif(sum((error is null)::int), 0), 4) end as retried_rate,
  sum((error is null and attempts is not null)::int) < sum((error is null)::int) as lower_bound,
  round(sum((error is null and coalesce(text, '') = '')::int) / nullif(sum((error is null)::int), 0), 4) as empty_rate"""

GARBAGE = """case when length(s) = 0 then 0.0 else (length(regexp_replace(s, '[^\\x{FFFD}\\x{E000}-\\x{F8FF}\\x00\\x01\\x03-\\x08\\x0E-\\x1B]', '', 'g'))
  + length(s) - length(regexp_replace(s, '\\(cid:[0-9]+\\)', '', 'g'))) / length(s) end"""
ALPHA = "case when length(s) = 0 then 0.0 else (length(s) - length(regexp_replace(s, '\\p{L}', '', 'g'))) / length(s) end"
SOLID = "regexp_replace(coalesce(text, ''), '[\\s\\x0B\\x1C-\\x1F\\x{85}\\p{Z}]', '', 'g')"


def _words(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in sorted(set(words))) + "]"


SQL: dict[str, str] = {
    "q_dense_topk": """with unit as (
  select vec_id, list_transform(embedding, lambda x: x::double) as v, sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) + 1e-12 as n from embeddings),
scored as (
  select q.vec_id as query_id, r.vec_id, list_sum(list_transform(list_zip(q.v, r.v), lambda p: p[1] * p[2])) / (q.n * r.n) as score
  from unit q, unit r where q.vec_id % 50 = 0)
select query_id, vec_id, row_number() over (partition by query_id order by score desc, vec_id) as rank, round(score, 6) as score
from scored qualify rank <= 10""",
    "q_bm25": """with rows as (select chunk_id, regexp_extract_all(lower(text), '[a-z0-9]+') as ws from chunks where text is not null),
stats as (select count(*) as n, avg(len(ws)) as avg_len from rows),
terms as (select distinct question_id, unnest(regexp_extract_all(lower(question), '[a-z0-9]+')) as term from questions where question is not null and question_id % 50 = 0),
postings as (
  select chunk_id, l, term, count(*) as tf from (select chunk_id, len(ws) as l, unnest(ws) as term from rows)
  where term in (select term from terms) group by all),
df as (select term, count(*) as df from postings group by term),
scored as (
  select question_id, chunk_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / avg_len))) as score
  from terms join df using (term) join postings using (term), stats group by all)
select question_id, chunk_id, row_number() over (partition by question_id order by score desc, chunk_id) as rank, round(score, 6) as score
from scored qualify rank <= 10""",
    "q_rrf": f"with {FUSED} select question_id, chunk_id, rank, round(score, 9) as score from top",
    "q_cap": f"with {FUSED}, {CAPPED} select question_id, chunk_id, doc_id, rank from capped",
    "q_hybrid": f"""with {FUSED}, {CAPPED},
live as (select * from capped where doc_id in (select doc_id from manifests)),
asked as (select question_id, min(question) as question from questions group by all),
scored as (
  select l.*, coalesce(len(list_intersect(list_distinct(regexp_extract_all(lower(question), '[a-z0-9]+')), regexp_extract_all(lower(text), '[a-z0-9]+')))
    / nullif(len(list_distinct(regexp_extract_all(lower(question), '[a-z0-9]+'))), 0), 0) as s
  from live l left join chunks c using (chunk_id) left join asked a on a.question_id = l.question_id)
select question_id, row_number() over (partition by question_id order by s desc, rank) as context, chunk_id, doc_id, rank, round(s, 6) as rerank_score
from scored qualify context <= 5""",
    "q_english": f"""with w as (
  select english, question, list_filter(regexp_extract_all(lower(coalesce(question, '')), '\\p{{L}}+'), lambda x: list_contains({_words(ENGLISH)}, x)) as e,
    list_filter(regexp_extract_all(lower(coalesce(question, '')), '\\p{{L}}+'), lambda x: list_contains({_words(OTHER)}, x)) as o from questions)
select case when english then 'yes' when not english then 'no' else 'unknown' end as english, case when question is null then false when len(e) > 0 or len(o) > 0 then len(e) > len(o)
  else not regexp_matches(array_to_string(regexp_extract_all(question, '\\p{{L}}+'), ''), '[^\\x00-\\x7F]') end as detected, count(*) as questions from w group by all""",
    "q_stale_hits": "select retriever, count(*) as hits from hits h where not exists (select 1 from chunks c where c.chunk_id = h.chunk_id) group by all",
    "q_readiness": """with a as (select distinct doc_id from manifests where doc_id is not null), b as (select distinct doc_id from chunks where doc_id is not null)
select count(*) filter (a.doc_id is not null and b.doc_id is not null) as both, count(*) filter (b.doc_id is null) as missing, count(*) filter (a.doc_id is null) as stale
from a full join b on a.doc_id = b.doc_id""",
    "q_format_query": """select question_id, case when english then 'Instruct: Given a question, retrieve passages that answer it' || chr(10) || 'Query:' || question else question end as query from questions""",
    "q_chunks": f"""with {PAGES},
offs as (
  select *, sum(length(text) + 2) over (partition by doc_id order by page) as e from pages),
docs as (
  select doc_id, string_agg(text || chr(10) || chr(10), '' order by page) as j, list({{'page': page, 'e': e, 'ref': regexp_matches(title, '(?i)reference|bibliograph')}} order by page) as ps from offs group by doc_id),
cut as (
  select *, greatest(0, ceil((length(j) - 900) / 800.0))::bigint as n from docs),
made as (
  select doc_id, j, ps, n, unnest(range(0, n + 1)) as k from cut),
paged as (
  select *, substr(j, (k * 800 + 1)::int, 900) as text,
    case when k = 0 then ps[1].page else list_filter(ps, lambda p: p.e > k * 800 + 100)[1].page end as first_page,
    case when k = n then ps[-1].page else list_filter(ps, lambda p: p.e > k * 800 + 900)[1].page end as last_page
  from made)
select doc_id, k as chunk, left(doc_id, 16) || ' pages ' || first_page || '-' || last_page as name, first_page::bigint as first_page, last_page::bigint as last_page,
  len(list_filter(ps, lambda p: p.ref and p.page between first_page and last_page)) > 0 as is_reference, k * 800 as start, md5(text) as digest, length(text) as n_chars from paged""",
    "q_content_key": f"""with {PAGES}
select doc_id, sha256(string_agg(lpad(r::varchar, 9, '0') || ':' || k, '' order by r)) as key from (
  select doc_id, page // 1024 as r, sha256(string_agg(lpad(page::varchar, 9, '0') || ':' || length(text) || ':' || sha256(text), '' order by page)) as k
  from pages group by doc_id, page // 1024) group by doc_id""",
    "q_split_pages": f"""with {PAGES}
select doc_id, page::bigint as page, md5(regexp_replace(text, '^[\\s\\x0B\\x1C-\\x1F\\x{{85}}\\p{{Z}}]+|[\\s\\x0B\\x1C-\\x1F\\x{{85}}\\p{{Z}}]+$', '', 'g')) as digest from pages""",
    "q_signals": f"""select result_id, case when text is not null then length(s) end as n_solid, case when text is not null then round({GARBAGE}, 6) end as garbage_ratio,
  case when text is not null then round({ALPHA}, 6) end as alpha_ratio from (select result_id, text, {SOLID} as s from ocr_results)""",
    "q_routing": f"""with x as (
  select result_id, length(coalesce(text, '')) as n, case when category = 'archive_scans' then 0.9 else 0.0 end as cover, {GARBAGE} as g, {ALPHA} as a, attempts
  from (select *, {SOLID} as s from ocr_results)),
r as (
  select result_id, attempts, list_filter([case when n < 50 then 'only ' || n || ' embedded chars (<50)' end,
    case when cover >= 0.6 and n < 400 then 'image covers 90% of page with little text' end,
    case when g > 0.1 then 'garbled text layer (' || round_even(g * 100, 0)::int || '% bad glyphs)' end,
    case when n >= 50 and a < 0.5 then 'low alphabetic ratio (' || round_even(a * 100, 0)::int || '%)' end], lambda z: z is not null) as rs from x),
f as (select result_id, case when len(rs) = 0 and attempts > 2 then ['forced (--ocr-all)'] else rs end as rs from r)
select result_id, len(rs) > 0 as needs_ocr, array_to_string(rs, '; ') as reasons from f""",
    "q_clean_text": """with a as (select result_id, regexp_replace(text, '\\r\\n?', chr(10), 'g') as t from ocr_results where text is not null),
b as (select result_id, regexp_replace(regexp_replace(t, '([\\p{L}\\p{N}_])-\\n([\\p{L}\\p{N}_])', '\\1-\\2', 'g'), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g') as t from a),
c as (select result_id, regexp_replace(regexp_replace(t, '[ \\t]+\\n', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g') as t from b),
d as (select result_id, regexp_replace(t, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g') as t from c)
select result_id, md5(t) as digest, length(t) as n_chars from d""",
    "q_vocabulary": """select lang, count(distinct w) as words from (select lang, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}\\p{M}_]+')) as w from documents where text is not null) group by lang""",
    "q_html": """with h as (select segment_id, lower(left(ltrim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13)), 15)) as t from segments)
select segment_id, starts_with(t, '<!doctype html') or starts_with(t, '<html') as is_html from h""",
    "q_best_variant": f"with {BEST} select doc_id, coalesce(n_pages = source_pages, false) as canonical, n_pages, source_path, created_at from best",
    "q_catalog": f"""with {BEST},
c as (
  select *, case when len(authors) > 0 then split_part(trim(authors[1]), ' ', -1) || case when len(authors) > 1 then ' et al.' else '' end end as who,
    case when pub_year > 0 then '(' || pub_year || ')' end as y, case when coalesce(title, '') != '' then title else source_name end as named from best)
select doc_id, case when coalesce(concat_ws(' ', who, y), '') != '' then concat_ws(' ', who, y) || '. ' else '' end || named as citation, left(doc_id, 16) as part,
  regexp_replace(regexp_replace(lower(source_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as slug,
  left(sha256('["' || concat_ws('", "', pipeline_version, source_kind) || '"]'), 12) as config_hash from c""",
    "q_complete": """select source_kind, count(*) as runs, sum(coalesce(n_pages = source_pages, false)::int)::bigint as complete, sum(n_pages)::bigint as pages, round(sum(total_seconds), 3) as seconds
from manifests group by source_kind""",
    "q_index_diff": """with pages as (
  select doc_id, seg_index, arg_min(coalesce(text, ''), segment_id) as text from segments where doc_id is not null and seg_index is not null group by all),
old as (
  select doc_id, seg_index, arg_min(coalesce(text, ''), segment_id) as text from segments where doc_id is not null and seg_index is not null and converted_at < timestamp '2024-09-01' group by all),
a as (select doc_id, list({'i': seg_index, 't': text} order by seg_index) as k from pages group by doc_id),
b as (select doc_id, list({'i': seg_index, 't': text} order by seg_index) as k from old group by doc_id
  union all select distinct doc_id, null from chunks where doc_id is not null and doc_id not in (select doc_id from a))
select coalesce(a.doc_id, b.doc_id) as doc_id, case when b.doc_id is null then 'new' when a.doc_id is null then 'stale' when a.k = b.k then 'unchanged' else 'changed' end as state
from a full join b on a.doc_id = b.doc_id""",
    "q_sample": """with s as (select distinct category, sample_id from ocr_results where sample_id is not null)
select category, sample_id, row_number() over (partition by category order by sha256('0:' || coalesce(category, '') || ':' || sample_id), sample_id) as draw from s qualify draw <= 25""",
    "q_set_ops": """with k as (
  select distinct 'chunks' as t, doc_id from chunks where doc_id is not null union all select distinct 'hits', doc_id from hits where doc_id is not null
  union all select distinct 'manifests', doc_id from manifests where doc_id is not null union all select distinct 'ocr_results', doc_id from ocr_results where doc_id is not null
  union all select distinct 'segments', doc_id from segments where doc_id is not null),
n as (select distinct t from k)
select a.t as name_a, b.t as name_b, (select count(*) from k x where x.t = a.t and x.doc_id in (select doc_id from k where t = b.t)) as both,
  (select count(*) from k x where x.t = a.t and x.doc_id not in (select doc_id from k where t = b.t)) as only_a,
  (select count(*) from k x where x.t = b.t and x.doc_id not in (select doc_id from k where t = a.t)) as only_b
from n a join n b on a.t < b.t""",
    "q_owner": """with c as (select doc_id, count(*) as n, ('0x' || left(doc_id, 12))::bigint as place from chunks group by doc_id),
b as (select doc_id, n, sum(n) over (order by place) - n as start from c)
select hit_id, b.doc_id, (hit_id - start)::bigint as place from hits asof join b on hit_id >= start where hit_id < start + n""",
    "q_latest": f"with {LATEST} select candidate, sample_id, result_id, finish_reason from newest",
    "q_throughput": f"with {LATEST} select candidate, category, grouping(category)::int as is_overall, {RATES} from newest group by grouping sets ((candidate), (candidate, category))",
    "q_streaks": """with m as (select candidate, ts, error is not null as f, sum((error is null)::int) over (partition by candidate order by ts, result_id) as island from ocr_results),
r as (select candidate, island, count(*) as length, min(ts) as first, max(ts) as last from m where f group by all)
select candidate, row_number() over (partition by candidate order by island) as streak, length, first, last from r""",
    "q_budget": """with e as (select candidate, coalesce(sum(coalesce(seconds, 0)) over (partition by candidate order by ts nulls first, result_id rows between unbounded preceding and 1 preceding), 0) as elapsed from ocr_results)
select candidate, count(*) as pages, round(max(elapsed), 3) as elapsed from e where elapsed < 600 group by all""",
    "q_rank": f"""with {LATEST}, s as (select candidate, round(avg(seconds), 6) as mean from newest group by all)
select candidate, mean, row_number() over (order by mean is null, mean, candidate) as place from s""",
    "q_todo": f"""with {LATEST}, s as (select distinct sample_id from ocr_results where sample_id is not null)
select sample_id from s where sample_id not in (select sample_id from newest where error is null and text != '' and sample_id is not null)
  or sample_id in (select sample_id from newest where error is not null and sample_id is not null)""",
    "q_events": """select user_id, event_type, event_id, props ->> '$.page' as page, props ->> '$.device' as device from events
qualify row_number() over (partition by user_id, event_type order by ts desc nulls last, event_id desc) = 1""",
    "q_word_f1": f"""with {PAIRS},
t as (select unit, unnest(list_filter(string_split_regex(ref, '\\s+'), lambda x: x != '')) as t, 1 as r, 0 as h from pairs
  union all select unit, unnest(list_filter(string_split_regex(hyp, '\\s+'), lambda x: x != '')), 0, 1 from pairs),
c as (select unit, t, sum(r) as r, sum(h) as h from t group by all), s as (select unit, sum(least(r, h)) as b, sum(r) + sum(h) as n from c group by unit)
select unit, round(coalesce(2.0 * b / n, 0), 6) as word_f1 from pairs left join s using (unit)""",
    "q_char3_f1": f"""with {PAIRS},
w as (select unit, ' ' || unnest(list_filter(string_split_regex(ref, '\\s+'), lambda x: x != '')) || ' ' as w, 1 as r, 0 as h from pairs
  union all select unit, ' ' || unnest(list_filter(string_split_regex(hyp, '\\s+'), lambda x: x != '')) || ' ', 0, 1 from pairs),
t as (select unit, unnest(list_transform(range(1, length(w) - 1), lambda i: substr(w, i::int, 3))) as t, r, h from w),
c as (select unit, t, sum(r) as r, sum(h) as h from t group by all), s as (select unit, sum(least(r, h)) as b, sum(r) + sum(h) as n from c group by unit)
select unit, round(coalesce(2.0 * b / n, 0), 6) as char3_f1 from pairs left join s using (unit)""",
    "q_cer": f"with {PAIRS} select unit, case when length(ref) > 0 then round(least(1.0, levenshtein(ref, hyp) / length(ref)), 6) end as cer from pairs",
    "q_metrics": f"""with {LATEST}, m as (
  select candidate, 'seconds' as metric, seconds::double as value from newest union all select candidate, 'gen_tokens', gen_tokens::double from newest
  union all select candidate, 'peak_memory_gb', peak_memory_gb::double from newest)
select candidate, metric, count(*) as n, round(avg(value), 6) as mean from m where value is not null group by all""",
    "q_category_matrix": "select candidate, "
    + ", ".join(f"round(avg(seconds) filter (category = '{c}'), 6) as {c}" for c in ("archive_scans", "running_heads", "scanned_math", "table_pages", "tiny_print", "two_column"))
    + ", round(avg(seconds) filter (category is null or category not in ('archive_scans', 'running_heads', 'scanned_math', 'table_pages', 'tiny_print', 'two_column')), 6) as other"
    + " from ocr_results where candidate is not null group by candidate",
    "q_category_spread": """with m as (select candidate, category, avg(seconds) as m from ocr_results where category is not null and seconds is not null group by all)
select candidate, arg_min(category, m) as worst, round(min(m), 6) as worst_mean, arg_max(category, m) as best, round(max(m), 6) as best_mean from m group by candidate""",
    "q_macro_mean": """with g as (select candidate, category, avg(seconds) as m, count(*) as n from ocr_results where seconds is not null group by all)
select candidate, sum(n)::bigint as n, round(avg(m), 6) as mean from g group by candidate""",
    "q_sign_flip": f"with {WEIGHTS} select * from tests",
    "q_holm": f"""with {WEIGHTS},
o as (select a, b, p_value, p_value <= 0.5 / (count(*) over () - row_number() over (order by p_value, a, b) + 1) as ok from tests)
select a, b, p_value, bool_and(ok) over (order by p_value, a, b rows between unbounded preceding and current row) as rejected from o""",
    "q_pairs": f"""with {UNITS}, k as (select candidate, unit, seconds from units where seconds is not null)
select a.candidate as a, b.candidate as b, count(*) as n, round(avg(a.seconds - b.seconds), 6) as mean, sum((a.seconds < b.seconds)::int)::bigint as reversed
from k a join k b on a.unit = b.unit and a.candidate < b.candidate group by all""",
}


SQL |= {
    "q_subset_mean": """with g as (
  select candidate, category, avg(seconds) as m from ocr_results where seconds is not null and doc_id in (select doc_id from manifests where n_pages = source_pages) group by all)
select candidate, round(avg(m), 6) as mean from g group by candidate""",
    "q_extremes": """with m as (select candidate, round(avg(seconds), 6) as s from ocr_results where candidate is not null group by all)
select arg_min(candidate, s) as lowest, min(s) as lowest_value, arg_max(candidate, s) as highest, max(s) as highest_value, round(max(s) / min(s), 6) as ratio from m""",
    "q_blank": """select candidate, regexp_matches(coalesce(text, ''), '^[\\s\\p{Z}]*$') as blank, count(*) as pages from ocr_results group by all""",
    "q_first_appearance": f"""with h as ({SQL["q_hybrid"]}),
f as (select question_id, doc_id, min(context) as c, count(*) as contexts from h group by all)
select question_id, doc_id, contexts, row_number() over (partition by question_id order by c, doc_id) as number from f""",
    "q_token_windows": """with t as (select doc_id, list_filter(string_split_regex(text, '[\\s\\x0B\\x1C-\\x1F\\x{85}\\p{Z}]+'), lambda w: w != '') as ws from documents where text is not null),
w as (select doc_id, ws, unnest(range(0, greatest(0, ceil((len(ws) - 256) / 224.0))::bigint + 1)) as k from t where len(ws) > 0)
select doc_id, k as window, k * 224 as start, len(ws[k * 224 + 1 : k * 224 + 256]) as n, md5(array_to_string(ws[k * 224 + 1 : k * 224 + 256], ' ')) as digest from w""",
}
LETTERS = "[" + ", ".join(f"(length(t) - length(replace(t, '{c}', '')))::double" for c in "abcdefghijklmnopqrstuvwxyz") + "]"
ENGLISH_TEST = SQL["q_english"].split("case when question is null then false ")[1].split(" end as detected")[0]
SQL |= {
    "q_links": """with l as (select segment_id, unnest(string_split(text, chr(10))) as x, generate_subscripts(string_split(text, chr(10)), 1) as line from segments where contains(text, '](')),
f as (select *, regexp_matches(x, '^\\s*```')::int as fence from l),
s as (select *, sum(fence) over (partition by segment_id order by line rows unbounded preceding) as c from f)
select segment_id, line, unnest(regexp_extract_all(regexp_replace(x, '`[^`]*`', '', 'g'), '\\[[^\\[\\]]*\\]\\(([^()\\s]+)\\)', 1)) as target from s where fence = 0 and c % 2 = 0""",
    "q_search": f"""with asked as (select question_id, min(question) as question from questions where question is not null and question_id % 50 = 0 group by all),
w as (
  select question_id, question, list_filter(regexp_extract_all(lower(question), '\\p{{L}}+'), lambda x: list_contains({_words(ENGLISH)}, x)) as e,
    list_filter(regexp_extract_all(lower(question), '\\p{{L}}+'), lambda x: list_contains({_words(OTHER)}, x)) as o from asked),
q as (select question_id, question, case {ENGLISH_TEST} end as english from w),
c as (select chunk_id, doc_id, text, lower(text) as t from chunks where chunk_id is not null and doc_id is not null and text is not null),
cv as (select chunk_id, {LETTERS} as v from c), qv as (select question_id, english, {LETTERS} as v from (select *, lower(question) as t from q)),
unit as (select chunk_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) + 1e-12 as n from cv),
qunit as (select question_id, english, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) + 1e-12 as n from qv),
cosines as (select question_id, english, chunk_id, round(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) / (a.n * b.n), 9) as score from qunit a, unit b),
dense as (select *, row_number() over (partition by question_id order by score desc, chunk_id) as r from cosines qualify r <= 100),
bag as (select chunk_id, regexp_extract_all(t, '[a-z0-9]+') as ws from c),
stats as (select count(*) as n, avg(len(ws)) as avg_len from bag),
terms as (select distinct question_id, unnest(regexp_extract_all(lower(question), '[a-z0-9]+')) as term from q where english),
postings as (select chunk_id, l, term, count(*) as tf from (select chunk_id, len(ws) as l, unnest(ws) as term from bag) where term in (select term from terms) group by all),
df as (select term, count(*) as df from postings group by term),
bm as (
  select question_id, chunk_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / avg_len))) as score
  from terms join df using (term) join postings using (term), stats group by all),
keyword as (select *, row_number() over (partition by question_id order by score desc, chunk_id) as r from bm qualify r <= 100),
fused as (
  select coalesce(d.question_id, k.question_id) as question_id, coalesce(d.chunk_id, k.chunk_id) as chunk_id, coalesce(1.0 / (60 + d.r), 0) + coalesce(1.0 / (60 + k.r), 0) as score, d.r as dr, k.r as kr
  from (select * from dense where english) d full join keyword k on d.question_id = k.question_id and d.chunk_id = k.chunk_id),
first as (
  select question_id, chunk_id, 'rrf' as score_kind, row_number() over (partition by question_id order by score desc, dr nulls last, kr nulls last, chunk_id) as rank from fused qualify rank <= 100
  union all select question_id, chunk_id, 'cosine', r from dense where not english),
inside as (select f.*, doc_id, row_number() over (partition by question_id, doc_id order by rank) as n from first f join c using (chunk_id)),
capped as (select question_id, chunk_id, doc_id, score_kind, place as rank from (select *, row_number() over (partition by question_id order by rank) as place from inside where n <= 3) where place <= 20),
scored as (
  select l.*, coalesce(len(list_intersect(list_distinct(regexp_extract_all(lower(question), '[a-z0-9]+')), regexp_extract_all(lower(text), '[a-z0-9]+')))
    / nullif(len(list_distinct(regexp_extract_all(lower(question), '[a-z0-9]+'))), 0), 0) as s
  from capped l join c using (chunk_id) join q using (question_id) where l.doc_id in (select doc_id from manifests))
select question_id, row_number() over (partition by question_id order by s desc, rank) as context, chunk_id, doc_id, rank, score_kind, round(s, 6) as rerank_score from scored qualify context <= 5""",
    "q_build_report": f"""with d as ({SQL["q_index_diff"]})
select count(*) filter (state = 'new') as added, count(*) filter (state = 'changed') as updated, count(*) filter (state = 'unchanged') as unchanged,
  count(*) filter (state = 'stale') as pruned, (select count(*) from chunks where doc_id in (select doc_id from d where state in ('new', 'changed'))) as chunks_to_embed from d""",
    "q_stale_scores": """with now as (select candidate, count(*) as records from ocr_results group by all),
saved as (
  select candidate, count(error) as errors, count(text) as outputs, count(*) as samples, avg(seconds) as mean, count(*) as records
  from ocr_results where ingested_at < timestamp '2025-06-01' group by all)
select n.candidate, coalesce(s.candidate is null or s.errors > 0 or s.outputs < s.samples or s.mean is null or s.records is distinct from n.records, true) as stale
from now n left join saved s on n.candidate = s.candidate""",
    "q_separation": f"""with {WEIGHTS},
o as (select a, b, p_value, p_value <= 0.5 / (count(*) over () - row_number() over (order by p_value, a, b) + 1) as ok from tests),
h as (select a, b, bool_and(ok) over (order by p_value, a, b rows between unbounded preceding and current row) as rejected from o),
newest as (
  select * from ocr_results
  qualify row_number() over (partition by candidate, sample_id order by ts desc nulls last, ingested_at desc nulls last, result_id desc) = 1),
means as (select candidate, round(avg(seconds), 6) as mean from newest group by all),
placed as (select candidate, row_number() over (order by mean is null, mean, candidate) as place from means)
select p.candidate, p.place, case when p.place = 1 then 'best' when h.rejected then 'apart' when h.rejected is not null then 'tied' else 'not compared' end as verdict
from placed p left join h on p.place > 1 and least(p.candidate, (select candidate from placed where place = 1)) = h.a
  and greatest(p.candidate, (select candidate from placed where place = 1)) = h.b""",
    "q_transcription": """with a as (select result_id, raw_text, regexp_replace(raw_text, '(?s)^\\s*<think>.*?</think>\\s*', '') as t from ocr_results where raw_text is not null),
b as (select result_id, raw_text, regexp_replace(t, '(?s)^\\s*```[\\w-]*[ \\t]*\\n(.*?)\\n?```\\s*$', '\\1') as t from a),
c as (select result_id, raw_text, regexp_replace(t, '(?s)^---\\n(?:[a-z_]+:[^\\n]*\\n)+---\\n?', '') as t from b),
d as (select result_id, raw_text, regexp_replace(t, '(?is)</?(?:page_number|watermark|page)>|<\\|[a-z_]+\\|>', '', 'g') as t from c),
e as (select result_id, raw_text, regexp_replace(t, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g') as t from d)
select result_id, t as text from e where t != raw_text""",
}


def oracle_sql() -> dict[str, str]:
    from foliant.plans import source_sql

    return SQL | source_sql.oracle_sql()
