"""Oracle SQL of the training-data queries that SQL can express over whole tables."""

from __future__ import annotations

HITS = """once as (
  select hit_id, question_id, retriever, chunk_id, doc_id, score from hits
  qualify row_number() over (partition by question_id, retriever, chunk_id order by hit_id) = 1)"""

#: The pieces of markup without look-around, which the SQL engine's patterns lack: what stands before is matched too.
MARKUP = (
    r"""</?[A-Za-z][A-Za-z0-9]{0,19}(?:\s+[\w:-]+\s*=\s*(?:"[^"<>]*"|'[^'<>]*'|[\w#.-]+))*\s*/?>""",
    r"<!--|-->|&(?:#\d{1,7}|#x[0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,9});",
    r"(?m)^#{1,6} +\S|\*\*[^\s*][^*\n]{0,199}?\*\*|(?:^|\W)__[^\s_][^\n]{0,199}?__(?:\W|$)|~~[^\s~][^~\n]{0,199}?~~",
    r"`[^`\n]{1,200}`|```|\[[^\[\]\n]{0,200}\]\([^()\s]{1,300}\)|\[\^[^\]\s]{1,20}\]",
    r"(?m)^[|:-][ \t:|-]*-{2,}[ \t:|-]*\|[ \t:|-]*$|^\|(?:[^|\n]*\|){2,}[ \t]*$",
    r"\n> +\S|(?m:^)> +[A-Za-z_]|\n[-*+] +\S|(?m:^)[-*+] +(?:[A-Za-z_]|\[[ xX]\])|\n(?:={3,}|-{3,})[ \t]*(?m:$)",
    r"\[\[[^\[\]\n]{1,200}\]\]|(?:^|[^'])'{2,3}[^'\s][^'\n]*(?:'[^'\n]+)*'{2,3}|(?m:^)={2,6} [^\n]{1,200} ={2,6}[ \t]*(?m:$)",
    r"(?m)^\{\||^\|[-}]|^\|[^\n]*\|\||\{\{[^{}\n]{1,200}\}\}|\[https?://[^\]\s]+[^\]\n]*\]|^(?:\*\*+|##+) +\S|\n[*#]*[:;]+ +\S",
    r"\\[a-zA-Z]{2,}\*?[\[{]|(?:^|[^\w:\\])\\[a-zA-Z]{2,}|\\[%&_#$,;!]|\\\\|(?:^|[^\w$])\$[^\s$][^$\n]{0,199}\$(?:\W|$)|\$\$",
    r"\\[\[\]()]|``[^`'\n]{1,200}''|\{\\[a-z]+|(?m:^)%+ ?[a-z]",
)
HAS_MARKUP = " or ".join("regexp_matches(text, '" + m.replace("'", "''") + "')" for m in MARKUP)

SQL: dict[str, str] = {
    "p1_found": f"""select 'segments' as table_name, segment_id as row_id from segments where {HAS_MARKUP}
union all select 'chunks', chunk_id from chunks where {HAS_MARKUP}""",
    "p4_found": "select chunk_id from chunks where length(text) > 900",
    "p4_valid": "select chunk_id, length(text) as covered, true as within_limit, true as within_overlap, true as same_text from chunks where length(text) > 900",
    "p8_valid": """select doc_id, coalesce(octet_length(encode(text)), 0) as bytes, greatest(1, ceil(coalesce(octet_length(encode(text)), 0) / 4096.0))::bigint as pieces, true as complete
from documents where doc_id is not null""",
    "p8_fill": "select sum(octet_length(encode(text)))::bigint as bytes, true as within_capacity, true as full from documents where doc_id is not null",
    "p5_found": f"""with {HITS}
select hit_id from once
qualify row_number() over (partition by question_id, retriever, doc_id order by score desc nulls last, hit_id) > 4""",
    "p5_lists": f"""with {HITS}
select question_id, retriever, hit_id, chunk_id, doc_id, score,
  row_number() over (partition by question_id, retriever, doc_id order by score desc nulls last, hit_id) as quality_rank
from once qualify quality_rank <= 4""",
    "p5_method": f"""with {HITS},
sizes as (select question_id, retriever, doc_id, count(*) as n from once group by all),
levels as (select distinct question_id, retriever, unnest(range(1, 200)) as l from sizes),
fits as (select question_id, retriever, max(l) as level from (
    select s.question_id, s.retriever, l.l, sum(least(s.n, l.l)) as total, max(s.n) as most
    from sizes s join levels l using (question_id, retriever) group by all)
  where l <= most and l <= 0.2 * total + 1e-9 group by all),
ranked as (select *, row_number() over (partition by question_id, retriever, doc_id order by score desc nulls last, hit_id) as quality_rank from once)
select hit_id, question_id, retriever, doc_id, coalesce(level, 1) as level, quality_rank
from ranked left join fits using (question_id, retriever) where quality_rank <= coalesce(level, 1)""",
    "p7_ranking": """with once as (
  select question_id, chunk_id, retriever, max(score) as score from hits
  where retriever in ('dense', 'keyword', 'rerank') and question_id is not null and chunk_id is not null group by all),
percent as (
  select question_id, chunk_id, retriever, case when score is not null then
    (count(score) over (partition by question_id, retriever order by score range between unbounded preceding and current row))::double
      / count(score) over (partition by question_id, retriever) end as p from once),
vec as (
  select question_id, chunk_id, list_sort([coalesce(max(p) filter (retriever = 'dense'), 0), coalesce(max(p) filter (retriever = 'keyword'), 0),
    coalesce(max(p) filter (retriever = 'rerank'), 0)]) as v from percent group by all),
wanted as (select question_id, max(top_k) as top_k from questions group by all),
ranked as (
  select v.question_id, chunk_id, v, row_number() over (partition by v.question_id order by v[1] desc, v[2] desc, v[3] desc, chunk_id) as rank, top_k
  from vec v join wanted w on v.question_id = w.question_id)
select question_id, chunk_id, rank, round(v[1], 6) as p1, round(v[2], 6) as p2, round(v[3], 6) as p3 from ranked where rank <= top_k""",
}
SQL["p7_found"] = f"select question_id, chunk_id from ({SQL['p7_ranking']})"


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
