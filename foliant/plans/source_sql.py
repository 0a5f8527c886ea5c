"""Oracle SQL of the queries over sources, sinks, suites and the index, written against the tables."""

from __future__ import annotations

from foliant.plans.sql import ALPHA, BEST, GARBAGE, LATEST, PAGES, SOLID, SQL as CORE, UNITS

SIMPLE = "trim(regexp_replace(coalesce({}, ''), '[^A-Za-z0-9.,]+', ' ', 'g'))"
KINDS = """case source_kind when 'pdf' then 'pdf' when 'image' then 'image' when 'latex' then 'latex' when 'office' then 'office' else 'text' end"""
MIMES = """case source_kind when 'pdf' then 'application/pdf' when 'image' then 'image/tiff' when 'latex' then 'application/x-tex'
  when 'office' then 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' else 'text/plain' end"""
RATE = "(floor((n - bad) * 1000 / n) / 1000)"
OWN = """own as (select category as log, candidate, count(*) as n, count(error) as bad from ocr_results
  where candidate is not null and category is not null and sample_id is not null group by all)"""
TESTS = """tests as (
  select doc_id as pdf, category, sample_id || '#' || candidate || '#' || result_id as id,
    case when page_no = 1 and candidate = 'pica-7b' then 'baseline' else 'present' end as type
  from ocr_results where doc_id is not null and sample_id is not null and category is not null and candidate is not null)"""
STORED = """stored as (
  select *, total_seconds > 60 as degraded, n_pages % 5 = 0 as ocr_all,
    left(sha256('["' || concat_ws('", "', pipeline_version, source_kind) || '"]'), 12) as config_hash from manifests),
tiers as (select *, case when coalesce(degraded, false) then 'degraded' when coalesce(n_pages = source_pages, false) and not coalesce(ocr_all, false) then 'canonical' else 'variant' end as tier from stored)"""
PER_DOC = f"""{PAGES},
flat as (select doc_id, page, {SIMPLE.format("text")} as t from pages)"""

SCANS = f"""scans as (
  select doc_id as path, page_no, arg_min(text, result_id) as text from ocr_results where doc_id is not null and page_no is not null group by all),
placed as (
  select *, row_number() over (partition by path order by page_no) as page, count(*) over (partition by path) as n_pages,
    page_no * 30.0 as l, page_no * 50.0 - 100 as b, page_no * 30.0 + page_no * 40.0 + 100 as r, page_no * 50.0 + 300 as t, {SOLID} as s from scans)"""

SQL: dict[str, str] = {
    "q_measured": f"""with {SCANS}
select path, page::int as page, n_pages::int as n_pages, 1 as n_images,
  round(least(1.0, greatest(0, least(r, 600) - greatest(l, 0)) * greatest(0, least(t, 800) - greatest(b, 0)) / 480000.0), 3) as image_coverage, round({GARBAGE}, 3) as garbage_ratio, round({ALPHA}, 3) as alpha_ratio from placed""",
    "q_image_bounds": f"""with {SCANS} select path, page::int as page, round(l, 3)::double as left, round(b, 3)::double as bottom, round(r, 3)::double as right, round(t, 3)::double as top from placed""",
    "q_frames": """select i::int as frame, (i * 10)::int as width, count(*) as images from (select unnest(range(1, greatest(1, n_pages) + 1)) as i from manifests where source_kind = 'image') group by all""",
    "q_detected": f"select {KINDS} as kind, {MIMES} as mime, null::varchar as problem, count(*) as files from manifests group by all",
    "q_renamed": """select case when source_kind in ('pdf', 'image') then source_kind end as kind, case source_kind when 'pdf' then 'application/pdf' when 'image' then 'image/tiff' end as mime,
  case when source_kind not in ('pdf', 'image') then 'unsupported input type' end as problem, count(*) as files from manifests group by all""",
    "q_gzip": """select source_kind, z as zipped, case when not z then 'none' when source_kind = 'pdf' then 'gzip-pdf' else 'gzip-tex' end as box, count(*) as files
from manifests, (values (true), (false)) v(z) group by all""",
    "q_text_heads": "select source_kind, source_kind != 'image' as is_text, count(*) as files from manifests group by all",
    "q_identity": "select sha256(text) as doc_id, count(*) as files from segments where text is not null group by all",
    "q_plain_files": f"""select 's' || (segment_id % 16) as name, md5(string_agg({SIMPLE.format("text")}, chr(10) order by segment_id)) as digest
from segments where text is not null group by all""",
    "q_sidecars": """with s as (select source_path, min(title) as title from manifests where title is not null group by all)
select s.title, count(*) as files from manifests m left join s using (source_path) group by all""",
    "q_first_pages": f"with {PAGES} select page, count(*) as pages from pages where page <= 3 group by all",
    "q_page_range": f"with {PAGES} select page, length(text) > 4000 as too_large, count(*) as pages from pages where page between 2 and 4 group by all",
    "q_html_converted": f"""select segment_id, 'Page' as title,
  md5('## Part' || chr(10) || chr(10) || case when {SIMPLE.format("text")} = '' then '' else {SIMPLE.format("text")} || chr(10) || chr(10) end || '- one' || chr(10) || '- two') as digest from segments""",
    "q_unpacked": f"with {PAGES} select doc_id as path, count(*) + 1 as members, 0 as warnings from pages group by all",
    "q_main_files": f"with {PAGES} select distinct doc_id as path, 'main.tex' as member from pages",
    "q_flattened": f"""with {PER_DOC}
select doc_id as path, 'Part ' || page as title, md5(case when t = '' then '' else t || ' %' end) as digest, 0 as warnings from flat""",
    "q_conversions": f"""with {UNITS},
n as (select unit, length(regexp_replace(coalesce(text, ''), '[\\s\\x0B\\x1C-\\x1F\\x{{85}}\\p{{Z}}]+', '', 'g')) as l, row_number() over (partition by unit order by candidate) as k from units),
p as (select a.unit, a.l as x, b.l as y from n a join n b on a.unit = b.unit and a.k = 1 and b.k = 2)
select case when x > 0 and x >= 800 then 'converted' when y > x then 'fallback' when x > 0 then 'short' else 'none' end as choice, count(*) as pages from p group by all""",
    "q_classified": """select source_kind, z as zipped, case when source_kind = 'pdf' and not z then 'pdf' when source_kind != 'pdf' and z then 'latex' when source_kind = 'latex' then 'tex' end as format, count(*) as files
from manifests, (values (true), (false)) v(z) group by all""",
    "q_tex_decoded": f"select segment_id, md5({SIMPLE.format('text')} || ' éü') as digest from segments",
    "q_latex_text": f"""with {PER_DOC}, n as (select *, chr(10) as e from flat)
select doc_id || '#' || page as paper, 0 as ord, 'Paper ' || page as title, md5('# Paper ' || page || e || e || 'Ann , Bob') as digest from n
union all select doc_id || '#' || page, 1, 'Abstract', md5('# Abstract' || e || e || 'Sum ' || page) from n
union all select doc_id || '#' || page, 2, 'Part', md5('# Part' || e || e || case when t = '' then 'x y.' else 'x ' || t || ' y.' end || e || e || '- one' || e || '- two') from n""",
    "q_formats": """select candidate, printf('%.3f', round(avg(seconds), 6)) || ' [' || printf('%.3f', min(seconds)) || ', ' || printf('%.3f', max(seconds)) || ']' as estimate,
  printf('%.1f', round(count(error) / count(*), 6) * 100) || ' %' as share from ocr_results where candidate is not null group by candidate""",
    "q_environmental": "select coalesce(not (gen_tokens % 140 - 20 between 1 and 99), true) as environmental, count(*) as runs from ocr_results group by all",
    "q_headings": f"""with {PER_DOC},
c as (select *, max(case when page % 3 = 1 then page end) over (partition by doc_id order by page) as chapter from flat)
select doc_id, (row_number() over (partition by doc_id order by page) - 1)::int as ord, case when chapter is null then '' else 'C' || chapter || ' > ' end || 'P' || page as title,
  md5(case when page % 3 = 1 then '# C' || page || chr(10) || chr(10) else '' end || '## P' || page || chr(10) || chr(10) || '```' || chr(10) || chr(10) || '# no heading' || chr(10) || '```' || chr(10) || chr(10) || '.' || t) as digest
from c""",
    "q_feeds": f"""select left(doc_id, 12) || 'v2' as key, left(doc_id, 12) as arxiv_id, 'v2' as version, nullif({SIMPLE.format("arg_min(coalesce(title, ''), created_at)")}, '') as title,
  coalesce(len(arg_min(authors, created_at)), 0) as authors, arg_min(coalesce(pub_year, 1999), created_at) as year from manifests where doc_id is not null group by doc_id""",
    "q_licenses": f"""with {BEST}
select case when n_pages % 2 = 0 then 'http://creativecommons.org/' || source_kind when n_pages % 3 = 0 then 'stored' end as license, count(*) as papers from best group by all""",
    "q_paper_names": """with m as (select *, lpad(size_bytes::varchar, 9, '0') as n from manifests), i as (select *, '24' || substr(n, 1, 2) || '.' || substr(n, 5, 5) as id from m)
select source_path, created_at, id as arxiv_id, case when n_pages > 3 then 'v3' end as version, regexp_replace(source_path, '[^A-Za-z0-9._-]+', '_', 'g') as file, id || '|hep-th/9901001' as ids from i""",
    "q_headers": """select source_path, created_at, source_name as name, left(doc_id, 8) as tag, n_pages::double as wait, null::double as no_wait,
  'http://x/q?a=1&name=' || left(doc_id, 8) || '&n=' || n_pages || '+%25' as url from manifests""",
    "q_retitled": """select source_path, created_at, case when n_pages % 2 = 0 then '# New' || chr(10) || chr(10) || 'body' end as text from manifests where title is not null""",
    "q_tiers": f"""with {STORED} select tier, count(*) as manifests, sum(coalesce(case when tier = 'variant' then 1 when title is not null then 0 end, case when tier = 'variant' then 1 end))::bigint as again from tiers group by all""",
    "q_corpus": f"""with {STORED}
select doc_id, tier, n_pages, created_at from tiers where doc_id is not null
qualify row_number() over (partition by doc_id order by (n_pages = source_pages) desc nulls last, n_pages desc nulls last, (tier = 'canonical') desc, created_at, source_path) = 1""",
    "q_cache_hits": f"""with {STORED}
select doc_id, source_path, created_at from stored a where exists (select 1 from stored b where b.doc_id = a.doc_id and b.config_hash = a.config_hash
  and coalesce(b.ocr_all, false) = a.ocr_all and b.n_pages = b.source_pages and b.created_at < timestamp '2024-06-01')""",
    "q_refreshed": """with t as (select doc_id, title from manifests where title is not null qualify row_number() over (partition by doc_id order by created_at desc nulls last, source_path desc) = 1)
select case when t.title is not null then 'new: ' || t.title else m.title end as title, count(*) as rows from manifests m left join t using (doc_id) group by all""",
    "q_found_document": "select left(min(doc_id), 12) as prefix, min(doc_id) as doc_id from manifests",
    "q_telemetry_files": "select category, count(*) as records, count(error) as errors, round(sum(seconds), 3) as seconds, sum(gen_tokens)::bigint as tokens from ocr_results group by all",
    "q_index_run": """with c as (select * from chunks where doc_id is not null),
old as (select doc_id, max(indexed_at)::varchar || '#' || count(*) as key, count(*) as n from c where indexed_at < timestamp '2024-09-01' group by doc_id),
new as (select doc_id, max(indexed_at)::varchar || '#' || count(*) as key, count(*) as n from c group by doc_id),
kept as (select * from new where not starts_with(doc_id, '0')),
j as (select o.doc_id as o, k.doc_id as k, o.key = k.key as same from (select * from old where not starts_with(doc_id, '0')) o full join kept k on o.doc_id = k.doc_id)
select (select count(*) from old) as documents_before, (select sum(n)::bigint from old) as chunks_before, (select count(*) > 0 from new where starts_with(doc_id, '0')) as waiting,
  (select count(*) filter (o is null) from j) as added, (select count(*) filter (not same) from j) as updated, (select count(*) filter (same) from j) as unchanged, (select count(*) filter (k is null) from j) as pruned,
  (select count(*) from kept) as documents, (select sum(n)::bigint from kept) as chunks, (select count(*) from kept) as searchable_documents, (select sum(n)::bigint from kept) as searchable_chunks, false as pending""",
    "q_newest_versions": """with v as (select doc_id, chunk_id, strftime(indexed_at, '%Y%m')::bigint as seq from chunks where doc_id is not null),
b as (select doc_id, max(seq) as seq from v group by doc_id)
select v.doc_id, v.chunk_id, v.seq from v join b using (doc_id, seq) where (('0x' || left(v.doc_id, 1))::int + v.seq) % 5 != 0""",
    "q_log_scores": f"with {OWN} select log, candidate, {RATE} as overall, 0.025 as half_width, 0.015 as ci_low, 0.985 as ci_high, n::int as n_tests from own",
    "q_log_breakdown": f"""with {OWN} select log, candidate, 'type' as kind, 'table' as name, {RATE} as rate, -1 as passed, n::int as total from own
union all select log, candidate, 'file', 'pages', -1.0, (n - bad)::int, n::int from own""",
    "q_log_failures": """select distinct category as log, candidate, sample_id as test from ocr_results
where error is not null and candidate is not null and category is not null and sample_id is not null""",
    "q_log_errors": f"with {OWN} select log, candidate, 'no answer for ' || candidate as message from own",
    "q_samples": f"""with {TESTS}, c as (select pdf, category, count(*) as tests from tests group by all)
select pdf, category, tests from c qualify row_number() over (partition by pdf order by case category when 'two_column' then 0 when 'tiny_print' then 1 when 'archive_scans' then 2 else 3 end, category) = 1""",
    "q_baseline": f"""with {TESTS}, bare as (select pdf, min(category) as category from tests group by pdf having count(*) filter (type = 'baseline') = 0)
select category, type, count(*) as tests from (select category, type from tests union all select category, 'baseline' from bare) group by all""",
    "q_unit_scores": f"""with {TESTS}, names as (select distinct candidate from ocr_results where candidate is not null),
bad as (select distinct candidate, sample_id || '#' || candidate || '#' || result_id as id from ocr_results where candidate is not null and error is not null)
select n.candidate, category as "group", count(*) as tests, round(avg((b.id is null)::int), 6) as score
from tests t cross join names n left join bad b on b.candidate = n.candidate and b.id = t.id group by all""",
    "q_test_files": f"with {TESTS} select category, type, count(*) as tests from tests where category in ('archive_scans', 'tiny_print') group by all",
    "q_output_paths": "select candidate || '/' || category || '/' || sample_id || '_pg1_repeat1.md' as path, count(*) as outputs from ocr_results where candidate is not null and sample_id is not null group by all",
    "q_cluster_keys": "select printf('%s#p%03d', doc_id, page_no) as cluster, count(*) as rows from ocr_results where doc_id is not null and page_no is not null group by all",
    "q_truth_pages": f"""with {LATEST},
r as (select doc_id, page_no as page, count(*) as c from newest where doc_id is not null and page_no is not null and candidate = 'marten-2b' group by all),
h as (select doc_id, count(*) as have from r group by all),
t as (select doc_id, greatest(1, max(source_pages)) as n from manifests where source_pages is not null group by all)
select r.doc_id, have = n as complete, count(*) as pages, max('page ' || page) as last from r join t using (doc_id) join h using (doc_id) where page <= n group by all""",
    "q_headline": """select candidate, count(*) as units, round(avg(seconds), 6) as seconds from ocr_results
where doc_id is not null and doc_id not in (select doc_id from manifests where n_pages < source_pages and doc_id is not null) group by all""",
    "q_long_enough": "select candidate, count(*) as pages from ocr_results where length(regexp_replace(coalesce(text, ''), '[\\s\\x0B\\x1C-\\x1F\\x{85}\\p{Z}]', '', 'g')) >= 1000 group by all",
    "q_merged_scores": """with o as (select candidate, round(avg(seconds), 6) as mean, count(*) as n from ocr_results where candidate is not null and ts < timestamp '2024-09-01' group by all),
w as (select candidate, round(avg(seconds), 6) as mean, count(*) as n from ocr_results where category = 'archive_scans' and candidate < 'n' group by all)
select * from w union all select * from o where candidate not in (select candidate from w)""",
    "q_metric_map": """select candidate, 'seconds' as metric, round(avg(seconds), 6) as mean, round(min(seconds), 6) as low, round(max(seconds), 6) as high, count(seconds) as n from ocr_results where candidate is not null group by candidate
union all select candidate, 'tokens', round(avg(gen_tokens::double), 6), min(gen_tokens)::double, max(gen_tokens)::double, count(gen_tokens) from ocr_results where candidate is not null group by candidate""",
    "q_covers_all": """select doc_id from chunks where doc_id is not null group by doc_id
having not (count(distinct coalesce(first_page, 0)) = count(*) and min(coalesce(first_page, 0)) = 0 and max(coalesce(first_page, 0)) = count(*) - 1)""",
    "q_rounds": """select distinct doc_id as cluster, case when doc_id in (select doc_id from ocr_results where candidate = 'pica-7b' and doc_id is not null) then 'shared' else 'added' end as state
from ocr_results where candidate = 'quill-xl' and doc_id is not null""",
    "q_second_round": f"""with s as ({CORE["q_separation"]})
select candidate from s where verdict in ('best', 'tied') and candidate not in (select candidate from ocr_results where category = 'tiny_print' and candidate > 'p')""",
    "q_score_gate": """with s as (select distinct sample_id from ocr_results where sample_id is not null and candidate is not null and category = 'archive_scans'),
o as (select distinct candidate, sample_id from ocr_results where candidate is not null and error is null and sample_id in (select sample_id from s))
select candidate, count(*) as n_outputs, (select count(*) from s) as n_samples,
  case when count(*) < (select count(*) from s) then ((select count(*) from s) - count(*)) || ' outputs missing' end as problem from o group by candidate""",
    "q_run_counters": """with r as (select *, ts < timestamp '2024-09-01' as early from ocr_results where sample_id is not null and candidate is not null),
b as (select candidate, count(distinct sample_id) as skipped from r where early and error is null group by all),
n as (select candidate, count(*) filter (error is null) as done, count(*) filter (error is not null) as errors from r where not early group by all),
t as (select count(distinct sample_id) as total from r)
select candidate, total, coalesce(skipped, 0) as skipped, coalesce(done, 0) as done, coalesce(errors, 0) as errors,
  total - coalesce(skipped, 0) - coalesce(done, 0) - coalesce(errors, 0) as remaining from b full join n using (candidate), t""",
    "q_attempts": """with a as (select *, unnest(range(0, attempts)) as i from ocr_results where attempts > 1)
select result_id, (i + 1)::int as attempt, 2048 as max_tokens, round(i * 0.2, 3)::double as temperature, coalesce(finish_reason != 'length', true) and trim(coalesce(text, '')) != '' as stands from a""",
    "q_medians": "select candidate, count(seconds) as n, round(quantile_cont(seconds, 0.5), 6) as median from ocr_results where candidate is not null and seconds is not null group by all",
    "q_methods": """select method, count(*) as n, row_number() over (order by count(*) desc, method) as place from segments where method is not null group by method""",
    "q_page_records": """select result_id, (page_no - 1)::int as index, 'ocr' as method, length(coalesce(text, '')) as n_chars, round(seconds, 3) as seconds, candidate as model from ocr_results""",
    "q_compare": f"select a, b, diff, p_value, n, n_clusters, true as held from ({CORE['q_sign_flip']})",
    "q_intervals": """select category, round(avg(seconds), 6) as mean, case when count(seconds) > 0 then true end as low_below, case when count(seconds) > 0 then true end as high_above
from ocr_results where category is not null group by category""",
    "q_pools": """with c as (select candidate, doc_id, strftime(min(ts), '%Y%m%d') as day from ocr_results where candidate is not null and doc_id is not null and ts is not null group by all),
s as (select candidate, day, count(*) as k from c group by all),
k as (select candidate, count(*) filter (k = 1) as singles, min({'k': k, 'd': day}) filter (k > 1) as smallest from s group by all)
select c.candidate, doc_id, case when k > 1 then c.day when singles = 1 and smallest is not null then smallest.d else 'pooled' end as pool from c join s using (candidate, day) join k using (candidate)""",
    "q_variants": f"""with {UNITS},
v as (select unit, candidate, category, seconds, regexp_matches(coalesce(text, ''), '^[\\s\\p{{Z}}]*$') as blank from units)
select a.category, count(*) as pages, round(avg(a.seconds - b.seconds), 6) as diff, sum(a.blank::int)::bigint as blank_old, sum(b.blank::int)::bigint as blank_new
from v a join v b on a.unit = b.unit and a.candidate = 'marten-2b' and b.candidate = 'pica-7b' group by all""",
    "q_fingerprints": """select distinct candidate, '{"dims":64,"instruction":"find","model":"' || candidate || '"}' as fingerprint from ocr_results where candidate is not null""",
    "q_suites": """with e as (select distinct category, sha256(sample_id) as d from ocr_results where category is not null and sample_id is not null),
r as (select category, left(d, 2) as r, count(*) as n, sha256(string_agg(d, '' order by d)) as k from e group by all)
select category, sum(n)::bigint as samples, sha256(string_agg(k, '' order by r)) as identity from r group by category""",
    "q_subset_ids": "select distinct category, 'bench-25-' || left(sha1(category || ':25:0'), 8) as subset from ocr_results where category is not null",
    "q_base64": "select vec_id, len(embedding)::int as n, round(list_sum(list_transform(embedding, lambda x: x::double)), 4) as total from embeddings",
    "q_half_precision": "select vec_id, len(embedding)::int as n, true as unit from embeddings",
    "q_documents_of_contexts": f"""with h as ({CORE["q_hybrid"]})
select doc_id in (select doc_id from manifests where n_pages = source_pages and doc_id is not null) as given, count(*) as contexts, count(distinct doc_id) as documents from h group by all""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
