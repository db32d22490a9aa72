"""DuckDB SQL for the catalog's queries."""

from __future__ import annotations

from graphloom.functions import text as fn
from graphloom.operators.experiment import SCORES

CLEAN = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
FOLD = "replace({}, 'ß', 'ss')".format
UP = lambda x: f"upper({FOLD(x)})"
LIST = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
SPACED = lambda x: rf"regexp_replace({x}, '[^\p{{L}}\p{{N}}_\s]', ' ', 'g')"
TOKENS = lambda x: rf"list_distinct(list_filter(regexp_split_to_array({SPACED(UP(x))}, '\s+'), lambda t: t <> ''))"
FALLBACK = lambda x: (
    rf"list_transform(list_filter(regexp_split_to_array({SPACED(FOLD(x))}, '\s+'), lambda t: length(t) > 2 and not list_contains({LIST(fn.STOP_WORDS)}, upper(t))), lambda t: upper(t))"
)
SHARED = lambda a, b: f"len(list_intersect({a}, {b}))"


def valid(e: str) -> str:
    u = UP(f"trim({e})")
    noise = "|".join(t.replace(".", r"\.") for t in fn.NOISE)
    return rf"(length({u}) between 2 and 55 and not regexp_matches({u}, '[0-9-]{{5,}}') and not regexp_matches({u}, '{noise}') and not regexp_matches({u}, '^[0-9.,$%-]+$'))"


CHUNKS = f"""docs as (select doc_id, {CLEAN} as t from documents),
chunks as (select doc_id, pos::int as chunk_pos, substring(t, pos * 950 + 1, 1200) as chunk from (
  select doc_id, t, unnest(range(0, greatest(0, ceil((length(t) - 1200) / 950.0))::bigint + 1)) as pos from docs where length(t) > 0))"""

RAW = f"""sent as (select doc_id, source as file, unnest(range(len(ss)))::int as item, unnest(ss) as sentence from (
  select doc_id, source, string_split({CLEAN}, '. ') as ss from documents)),
raw as (select doc_id, item, w[1] as source, w[2] as relation, w[3] as target, sentence as description, file, cast(item + 1 as varchar) as page
  from (select *, string_split(sentence, ' ') as w from sent) where len(w) >= 3)"""

USABLE = f"(coalesce(source, '') <> '' and coalesce(target, '') <> '' and {valid('source')} and {valid('target')})"
_ENTITY = lambda x: UP(f"replace({x}, 'NVIDIA CORPORATION', 'NVIDIA')")
WRITES = f"""{RAW},
writes as (select doc_id, item, {_ENTITY("source")} as src, replace({UP("coalesce(relation, 'None')")}, ' ', '_') as rel,
  {_ENTITY("target")} as dst, description, file as source, page from raw where {USABLE})"""
G2 = f"{WRITES}, g2 as (select distinct src, rel, dst from writes)"

G1 = """g1 as (
  select upper(n_name) as src, 'IN_REGION' as rel, upper(r_name) as dst from nation join region on n_regionkey = r_regionkey
  union select upper(p_brand), 'HAS_TYPE', upper(p_type) from part
  union select upper(n_name), 'SUPPLIES', upper(p_brand) from lineitem join supplier on l_suppkey = s_suppkey
    join nation on s_nationkey = n_nationkey join part on l_partkey = p_partkey where l_quantity >= 50 and l_discount >= 0.09)"""
ASKED = """asked(query_id, pos, keyword) as (values (1::bigint, 0, 'NATION_1'), (1, 1, 'EUROPE'), (2, 0, 'BRAND#1'), (2, 1, 'ASIA'),
  (3, 0, 'NATION_2'), (3, 1, 'AMERICA'), (3, 2, 'BRAND#5'), (4, 0, 'MIDDLE EAST'), (5, 0, 'NO SUCH NAME'), (5, 1, 'ASIA'))"""


def seeds(edges: str, words: str, to: str = "seeds") -> str:
    return f"nodes as (select src as id from {edges} union select dst from {edges}), {to} as (select query_id, pos, keyword, id from {words} join nodes on contains(upper(id), keyword))"


def und(edges: str) -> str:
    return f"und as (select src as a, dst as b, src, rel, dst from {edges} union all select dst, src, src, rel, dst from {edges} where src <> dst)"


def near(limit: int | None) -> str:
    rows = "select query_id, pos, keyword, a, rel, b, src, dst, row_number() over (partition by query_id, pos order by a, rel, b, src) as k from seeds join und on id = a"
    return f"near as (select * from ({rows}) {f'where k <= {limit}' if limit else ''})"


S1 = f"with recursive {G1}, {ASKED}, {seeds('g1', 'asked')}, {und('g1')}"
KHOP = """reached as (select query_id, id from seeds union select query_id, b from seeds join und on id = a),
khop as (select query_id, src, rel, dst from (select *, row_number() over (partition by query_id order by src, rel, dst) as k
  from (select distinct query_id, src, rel, dst from reached join und on id = a)) where k <= 150)"""
PATHS = """walks as (
  select distinct query_id, id as origin, id as node, 0 as hops, []::struct(src varchar, rel varchar, dst varchar)[] as path from seeds where pos = 0
  union all
  select query_id, origin, b, hops + 1, list_append(path, {'src': src, 'rel': rel, 'dst': dst}) from walks join und on node = a where hops < 3),
paths as (select query_id, origin, node as target, hops, path from (
  select *, row_number() over (partition by query_id, origin, node order by hops, path) as k from walks)
  where k = 1 and hops > 0 and origin <> node and exists (select 1 from seeds s where s.pos = 1 and s.query_id = query_id and s.id = node))"""
PATHS = PATHS.replace("from walks)\n", "from walks) w\n").replace("s.query_id = query_id and s.id = node", "s.query_id = w.query_id and s.id = w.node")

ASKED2 = "questions as (select item_id as query_id, text as question from benchmark)"


def ranked(k: int) -> str:
    words = f"words as (select query_id, unnest(range(len(ks)))::int as pos, unnest(ks) as keyword from (select query_id, list_distinct({FALLBACK('question')}) as ks from questions))"
    # the order of distinct words only names the rows: limits are per keyword
    score = f"round({SHARED(TOKENS('question'), TOKENS('triplet'))} / sqrt(greatest(len({TOKENS('triplet')}), 1)), 6)"
    return f"""{G2}, {ASKED2}, {words}, {seeds("g2", "words")}, {und("g2")}, {near(10)},
found as (select distinct query_id, '[' || a || '] -' || rel || '-> [' || b || ']' as triplet from near),
scored as (select query_id, triplet, {score} as score from found join questions using (query_id)),
ranked as (select query_id, rank, triplet, score from (
  select *, row_number() over (partition by query_id order by score desc, triplet) as rank from scored) where rank <= {k})"""


CONTEXT = "select query_id, string_agg(triplet, chr(10) order by rank) as context from ranked group by query_id"
DIST = {
    "l2": lambda a, b: f"list_sum(list_transform(list_zip({a}, {b}), lambda x: (x[1]::double - x[2]::double) * (x[1]::double - x[2]::double)))",
    "cos": lambda a, b: f"1 - {_dot(a, b)} / sqrt({_dot(a, a)} * {_dot(b, b)})",
}


def _dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda x: x[1]::double * x[2]::double))"


def nearest(k: int, kind: str) -> str:
    return f"""with q as (select vec_id as query_id, embedding as query from embeddings where vec_id % 20 = 0),
p as (select query_id, vec_id as id, round({DIST[kind]("query", "embedding")}, 6) as distance from q cross join embeddings)
select query_id, rank::int as rank, id, distance from (select *, row_number() over (partition by query_id order by distance, id) as rank from p) where rank <= {k}"""


ARM = f"""kws as (select distinct query_id, unnest({FALLBACK("question")}) as word from questions),
toks as (select doc_id, unnest({TOKENS("text")}) as word from documents),
shared as (select query_id, doc_id as id, count(*) as score from toks join kws using (word) group by all),
arm as (select query_id, rank, id, score, {CLEAN} as body from (
  select *, row_number() over (partition by query_id order by score desc, id) as rank from shared) join documents on doc_id = id where rank <= 5)"""
_OVER = lambda a, b: f"{SHARED(TOKENS(a), TOKENS(b))} / greatest(len({TOKENS(a)}), 1)"
_GRADE = lambda x: f"(1 + floor(4 * ({x})))::int"
RESULTS = f"""{ranked(12)}, {ARM},
base as (select query_id, string_agg(body, chr(10) || '---' || chr(10) order by rank) as context, string_split(min(body) filter (rank = 1), '. ')[1] as answer from arm group by query_id),
graph as (select query_id, context, array_to_string(string_split(context, chr(10))[1:3], chr(10)) as answer from ({CONTEXT})),
answers as (
  select query_id, 'baseline_vector_rag' as arch, question, substring(question, 1, 40) as intent, coalesce(context, '') as context, coalesce(answer, 'No relevant documents found.') as answer from questions left join base using (query_id)
  union all
  select query_id, 'proposed_graph_rag', question, substring(question, 1, 40), coalesce(context, ''), coalesce(answer, 'No relevant graph context found.') from questions left join graph using (query_id)),
results as (select query_id, arch, question, answer, {_GRADE(_OVER("answer", "context"))} as faithfulness,
  {_GRADE(_OVER("answer", "(question || ' ' || intent)"))} as relevance, {_GRADE(_OVER("context", "question"))} as precision from answers)"""
REPORT = "select arch, avg(coalesce(faithfulness, 0)) as faithfulness, avg(coalesce(relevance, 0)) as relevance, avg(coalesce(precision, 0)) as precision, count(*) as n from results group by arch"
_TWO = lambda m: f"printf('%.2f', round({m}, 2))"
_CELL = lambda m: f"rpad(lpad({_TWO(m)}, (14 - (14 - length({_TWO(m)})) // 2)::int, ' '), 14, ' ')"
_METRICS = ("faithfulness", "relevance", "precision")
LIT = f"{S1}, {KHOP}, lit as (select distinct src, rel, dst from khop where query_id = 4), litn as (select src as id from lit union select dst from lit), shown as (select * from g1 order by src, rel, dst limit 400)"
_COLOUR = lambda on: f"case when {on} then '#FF4B4B' when (select count(*) > 0 from lit) then '#D3D3D3' else '#4B8BFF' end"
_PARSED = lambda said, least: rf"list_filter(list_transform(string_split({said}, ','), lambda k: upper(replace(trim(regexp_replace(k, '\s+', ' ', 'g')), 'ß', 'ss'))), lambda k: length(k) >= {least})"

CHAT = """with contexts as (select conv_id, min(substring(text, 1, 30)) as context from conversations where turn = 0 and conv_id % 3 > 0 group by conv_id),
system as (select conv_id, coalesce(context, '') as context from (select distinct conv_id from conversations) left join contexts using (conv_id)),
newest as (select *, row_number() over (partition by conv_id order by turn desc) as k from conversations),
prompts as (select conv_id, -1 as place, 'system' as role, 'Answer from the context only.' || chr(10) || context as content from system
  union all select conv_id, turn, coalesce(role, ''), coalesce(text, '') from newest where k <= 4)"""
_NAMES = " union ".join(f"select {c} as name from {t}" for t, c in (("nation", "n_name"), ("region", "r_name"), ("supplier", "s_name"), ("customer", "c_name"), ("part", "p_name"), ("part", "p_type"), ("part", "p_brand")))


def _exploded(words: str, source: str) -> str:
    return f"select query_id, unnest(range(len(ks)))::int as pos, unnest(ks) as keyword from (select query_id, {words} as ks from {source})"


SQL: dict[str, str] = {
    "clean_corpus": f"select doc_id, {CLEAN} as cleaned from documents",
    "dehyphenate": r"select doc_id, trim(regexp_replace(regexp_replace(replace(text, ' of ', ' o-' || chr(10) || 'f '), '-\n\s*', '', 'g'), '\s+', ' ', 'g')) as cleaned from documents",
    "document_text_from_pages": "select conv_id, string_agg(coalesce(text, ''), '' order by turn) as text from conversations group by conv_id",
    "page_range_scan": "select conv_id, cast(turn + 1 as varchar) as page, length(text) as n_chars from conversations where turn between 2 and 5 and length(text) > 0",
    "question_scan": f"with {ASKED2} select query_id, question, substring(question, 1, 50) as shown from questions",
    "chunk_fixed": f"with {CHUNKS} select doc_id, chunk_pos, chunk from chunks",
    "chunk_ids": f"with {CHUNKS} select doc_id, chunk_pos, 'baseline_chunk_' || lpad((row_number() over (order by doc_id, chunk_pos) - 1)::varchar, 6, '0') as chunk_id, length(chunk) as n_chars from chunks",
    "chunk_counts": f"with {CHUNKS} select doc_id, count(*) as n_chunks, ceil(count(*) / 5.0)::bigint as n_batches from chunks group by doc_id",
    "extract_triples": f"with {RAW} select doc_id, item, source, relation, target from raw",
    "parse_triples_json": "select event_id, event_type as source, 'has k' as relation, json_extract_string(props, '$.k') as target, null::varchar as description from events where event_id % 7 <> 0",
    "validate_entities": f"select name, coalesce({valid('name')}, false) as valid from ({_NAMES})",
    "normalize_triples": f"with {WRITES} select doc_id, item, src, rel, dst, source, page from writes",
    "quarantine_triples": f"with {RAW} select doc_id, item, source, target from raw where not {USABLE}",
    "upsert_edges": f"with {WRITES} select src, rel, dst, description, source, page from (select *, row_number() over (partition by src, rel, dst order by doc_id % 2 desc, doc_id desc, item desc) as k from writes) where k = 1",
    "ingest_counts": f"with {WRITES} select doc_id, count(*) as n_written from writes group by doc_id",
    "graph_stats": f"with {G1} select (select count(*) from (select src from g1 union select dst from g1)) as nodes, (select count(*) from g1) as relationships",
    "graph_stats_no_edges": "select 0::bigint as nodes, 0::bigint as relationships",
    "edge_scan": f"with {G2} select src, rel, dst from g2 order by src, rel, dst limit 400",
    "node_degrees": f"with {G1}, s as (select * from g1 order by src, rel, dst limit 400) select id, count(*) as degree from (select src as id from s union all select dst from s) group by id",
    "node_degrees_text": f"with {G2} select id, count(*) as degree from (select src as id from g2 union all select dst from g2) group by id",
    "keyword_fallback": f"with {ASKED2} {_exploded(FALLBACK('question'), 'questions')}",
    "keyword_parse": f"with {ASKED2} {_exploded(_PARSED(chr(39).join(['replace(question, ', ' ', ', ', ',', ')']), 0), 'questions')}",
    "keyword_parse_dashboard": f"with {ASKED2} {_exploded(f'case when query_id % 2 = 0 then {_PARSED(chr(39).join(["replace(question, ", " ", ", ", ",", ")"]), 3)} else {FALLBACK("question")} end', 'questions')}",
    "seed_match": f"{S1} select query_id, pos, keyword, id from seeds",
    "seed_pairs": f"{S1} select x.query_id, x.id as a, y.id as b from seeds x join seeds y on x.query_id = y.query_id and x.pos = 0 and y.pos = 1 and x.id <> y.id",
    "neighbors_limit": f"{S1}, {near(10)} select query_id, pos, '[' || a || '] -' || rel || '-> [' || b || ']' as triplet from near",
    "neighbors_oriented": f"{S1}, {near(None)} select query_id, pos, src, rel, dst from near",
    "khop_edges": f"{S1}, {KHOP} select query_id, src, rel, dst from khop",
    "khop_rendered": f"{S1}, {KHOP} select query_id, '[' || src || '] - ' || rel || ' -> [' || dst || '] (Context: ' || case when rel = 'SUPPLIES' then 'sold by ' || lower(src) else 'None' end || ')' as triplet from khop",
    "shortest_path_dist": f"{S1}, {PATHS} select query_id, origin, target, hops::bigint as hops from paths",
    "shortest_path_edges": f"{S1}, {PATHS} select query_id, origin, target, array_to_string(list_transform(path, lambda e: '[' || e.src || '] -' || e.rel || '-> [' || e.dst || ']'), '; ') as path from paths",
    "candidate_union": f"{S1}, {PATHS}, {near(10)} select query_id, e.src as src, e.rel as rel, e.dst as dst from (select query_id, unnest(path) as e from paths) union select query_id, a, rel, b from near",
    "rerank_topk": f"with {ranked(12)} select query_id, rank::int as rank, triplet, score from ranked",
    "rerank_topk_dashboard": f"with {ranked(15)} select query_id, rank::int as rank, triplet, score from ranked",
    "context_string": f"with {ranked(12)} {CONTEXT}",
    "distinct_first_seen": "select head, min(seq) as seq, arg_max(role, seq) as role from (select substring(lower(text), 1, 3) as head, conv_id * 1000 + turn as seq, role from conversations) group by head",
    "empty_context_sentinel": f"with {ranked(12)} select query_id, coalesce(answer, 'No relevant graph context found.') as answer from questions left join (select query_id, string_agg(triplet, chr(10) order by rank) as answer from ranked where score > 1.0 group by query_id) using (query_id)",
    "vector_topk": nearest(1, "l2"),
    "vector_topk_multi": nearest(5, "l2"),
    "vector_topk_cosine": nearest(5, "cos"),
    "vector_insert_idempotent": "select vec_id as id, embedding[1] as first from embeddings where vec_id < 200 union all select vec_id, embedding[len(embedding)] from embeddings where vec_id >= 200",
    "vector_arm": f"with {ASKED2}, {ARM} select query_id, rank::int as rank, id, score from arm",
    "resume_pending": f"with {ASKED2} select query_id, (row_number() over (order by query_id))::int as run_no from questions where not exists (select 1 from labels where doc_id = query_id)",
    "experiment_results": f"with {RESULTS} select query_id, arch, answer, faithfulness, relevance, precision from results",
    "experiment_nested": f"with {RESULTS} select query_id, max(answer) filter (arch = 'baseline_vector_rag') as baseline_answer, max(answer) filter (arch = 'proposed_graph_rag') as graph_answer, max(precision) filter (arch = 'proposed_graph_rag') as graph_precision from results group by query_id",
    "ablation_report": f"with {RESULTS} {REPORT}",
    "report_console": f"with {RESULTS} select arch, rpad(arch, 24, ' ') || ' | ' || {" || ' | ' || ".join(map(_CELL, _METRICS))} as line from ({REPORT})",
    "report_latex": rf"with {RESULTS} select arch, replace(arch, '_', '\_') || {" || ".join(f"' & ' || {_TWO(m)}" for m in _METRICS)} || ' \\' as line from ({REPORT})",
    "score_report_labels": "select lang, avg(coalesce(quality, 0)) as quality, avg(coalesce(toxic, 0)) as toxic, count(*) as n from documents left join labels using (doc_id) group by lang",
    "report_by_group": "select lang, source, avg(coalesce(quality, 0)) as quality, count(*) as n from documents left join labels using (doc_id) group by rollup (lang, source)",
    "highlight_nodes": f"{LIT} select id from litn",
    "highlight_edges": f"{LIT} select distinct src, dst from lit",
    "viz_nodes": f"{LIT}, ends as (select src as id, * from shown union all select dst as id, * from shown), firsts as (select id, lower(rel) || ' p.' || case when rel <> 'HAS_TYPE' then length(dst)::varchar else 'None' end as place from (select *, row_number() over (partition by id order by src, rel, dst) as k from ends) where k = 1), deg as (select id, count(*) as degree, min(place) as place from ends join firsts using (id) group by id) select id, id || ' | ' || place as title, {_COLOUR('id in (select id from litn)')} as color, case when id in (select id from litn) then 28.0::double else least(45.0::double, 15 + sqrt(degree) * 2.5) end as size from deg",
    "viz_edges": f"{LIT} select src, rel, dst, {_COLOUR('(src, dst) in (select (src, dst) from lit)')} as color, case when (src, dst) in (select (src, dst) from lit) then 2.5::double else 0.8::double end as width from shown",
    "chat_window": "select conv_id, turn, role, text from (select *, row_number() over (partition by conv_id order by turn desc) as k from conversations) where k <= 4",
    "chat_windows_by_turn": "select conv_id, turn, string_agg(role || ': ' || text, chr(10)) over (partition by conv_id order by turn rows between 3 preceding and current row) as window from conversations",
    "chat_refusals": "select conv_id, turn, role from conversations where text is not null and (conv_id % 5 = 0 or conv_id % 7 = 0 or contains(lower(text), 'cannot conclude') or contains(text, '无法得出结论'))",
    "chat_prompt": f"{CHAT} select conv_id, count(*)::int as n, string_agg(role || ': ' || content, chr(10) order by place) as prompt from prompts group by conv_id",
    "chat_settled": f"{CHAT}, answers as (select conv_id, context, conv_id % 5 = 0 or contains(lower(context), 'cannot conclude') or contains(context, '无法得出结论') as refused from system) select conv_id, case when refused then '' else context end as context, case when conv_id % 5 = 0 then 'I cannot conclude this.' else 'From: ' || context end as answer, refused, case when refused then 0 else (select count(distinct role) + max((role is null)::int) from conversations c where c.conv_id = answers.conv_id) end::bigint as n_lit from answers",
    "triplet_rows": f"with {ranked(15)} select query_id, rank::int as rank, triplet, src, rel, dst from ranked join (select query_id, triplet, min(src) as src, min(rel) as rel, min(dst) as dst from (select query_id, '[' || a || '] -' || rel || '-> [' || b || ']' as triplet, a as src, rel, b as dst from near) group by all) using (query_id, triplet)",
    "keyword_engine": f"with {ASKED2} {_exploded(_PARSED(chr(39).join(['replace(question, ', ' ', ', ', ',', ')']), 0), 'questions where query_id % 3 <> 0')}",
    "context_two_ways": f"with {ASKED2}, {ARM} select query_id, string_agg(body, chr(10) || '---' || chr(10) order by rank) as context, string_agg(body, chr(10) order by rank) as judged from arm group by query_id",
    "experiment_index": f"with {ASKED2} select query_id, run_no::int as run_no from (select *, row_number() over (order by query_id) as run_no from questions) where not exists (select 1 from labels where doc_id = query_id)",
    "results_roundtrip": f"with {RESULTS} select query_id::varchar as id, case when query_id % 2 = 0 then 'even' else 'odd' end as category, question, {', '.join(f'max({c}) filter (arch = {chr(39)}{a}{chr(39)}) as {a[: a.index(chr(95))]}_{n}' for a in ('baseline_vector_rag', 'proposed_graph_rag') for c, n in zip(('answer', *_METRICS), ('answer', *SCORES)))} from results group by query_id, question",
    "ingest_counts_by_chunk": f"with {CHUNKS.replace('950', '850').replace('1200', '1000')}, sent as (select doc_id, chunk_pos, unnest(string_split({CLEAN.replace('text', 'chunk')}, '. ')) as sentence from chunks), raw as (select doc_id, chunk_pos, w[1] as source, w[3] as target from (select *, string_split(sentence, ' ') as w from sent) where len(w) >= 3) select doc_id, chunk_pos, count(*) filter ({USABLE})::bigint as n_written from raw group by doc_id, chunk_pos",
}
