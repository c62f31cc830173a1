"""The registered queries in SQL for another engine, over the same tables."""

from __future__ import annotations

import re

from quillgraph.config import SETTINGS
from quillgraph.functions.evidence import CATEGORY_OF, CUES, TYPE_ENDINGS
from quillgraph.schemas import DOCUMENT_STATUS, PROCESSING_STEPS, RELATIONSHIP_TYPE

S = SETTINGS


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _pick(values, number: str) -> str:
    return f"{_list(values)}[CAST(({number}) % {len(values)} AS INTEGER) + 1]"


_ISO = "strftime({}, '%Y-%m-%dT%H:%M:%S.%f')"
_TOKENS = r"regexp_extract_all(lower(content), '[\p{L}\p{N}]+')"

_TYPE = "CASE " + " ".join(f"WHEN {' OR '.join(f"ends_with(name, '{e}')" for e in ends)} THEN '{kind}'" for kind, ends in TYPE_ENDINGS.items()) + " ELSE 'other' END"
_CATEGORY = "CASE entity_type " + " ".join(f"WHEN '{k}' THEN '{c}'" for k, c in CATEGORY_OF.items()) + " ELSE 'other' END"
_CUED = ", ".join(f"CASE WHEN list_has_any(words, {_list(words)}) THEN 1 ELSE 0 END AS cue{k}" for k, words in enumerate(CUES.values()))
_MOST = f"greatest({', '.join(f'cue{k}' for k in range(len(CUES)))})"
_KIND = f"CASE {' '.join(f"WHEN {_MOST} > 0 AND cue{k} = {_MOST} THEN '{kind}'" for k, kind in enumerate(CUES))} WHEN contains(source_entity, target_entity) THEN 'contains' WHEN contains(target_entity, source_entity) THEN 'part_of' ELSE 'associated_with' END"



def _sum_log(*cells: str) -> str:
    return " + ".join(f"(CASE WHEN {c} > 0 THEN ({c}) * ln({c}) ELSE 0 END)" for c in cells)


_VIEWS = {
    "v_document": f"""SELECT CAST(doc_id AS VARCHAR) AS _id, 'Document ' || doc_id AS title, '10.5555/' || substr(md5(text), 1, 16) AS doi,
        CAST(2000 + doc_id % 25 AS INTEGER) AS year, split_part(text, chr(10), 1) AS abstract, {_pick(DOCUMENT_STATUS, "doc_id")} AS status,
        TIMESTAMP '2024-01-01' + to_seconds(doc_id * 60) AS created_at, TIMESTAMP '2024-01-01' + to_seconds(doc_id * 60 + 3600) AS updated_at,
        CAST(NULL AS VARCHAR) AS file_path, n_chars AS file_size FROM documents""",
    "v_line": "SELECT CAST(doc_id AS VARCHAR) AS document_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS ord FROM documents",
    "v_section": r"""SELECT document_id || ':' || ord AS _id, document_id, CASE WHEN ord = 1 THEN 'abstract' ELSE 'body' END AS section_type, content,
        CAST(ord AS INTEGER) AS "order" FROM v_line WHERE regexp_matches(content, '\S')""",
    "v_token": f"""SELECT document_id, "order", unnest({_TOKENS}) AS name, generate_subscripts({_TOKENS}, 1) AS place FROM v_section""",
    "v_mention": f"""SELECT document_id, "order", name, min(place) AS place FROM v_token WHERE length(name) >= {S.entity_letters} GROUP BY ALL""",
    "v_entity": f"""SELECT name, entity_type, {_CATEGORY} AS category, frequency, n_sections FROM (SELECT name, {_TYPE} AS entity_type,
        count(DISTINCT document_id) AS frequency, count(*) AS n_sections FROM v_mention GROUP BY name HAVING count(DISTINCT document_id) >= {S.entity_documents})""",
    "v_cue": f'SELECT document_id, "order", {_CUED} FROM (SELECT document_id, "order", {_TOKENS} AS words FROM v_section)',
    "v_known": "SELECT m.* FROM v_mention m SEMI JOIN v_entity USING (name)",
    "v_pair": """SELECT a.document_id, a."order", a.name AS source_entity, b.name AS target_entity
        FROM v_known a JOIN v_known b ON a.document_id = b.document_id AND a."order" = b."order" AND a.name < b.name""",
    "v_together": f"""SELECT source_entity, target_entity, count(*) AS n_together, {", ".join(f"sum(cue{k}) AS cue{k}" for k in range(len(CUES)))}
        FROM v_pair JOIN v_cue USING (document_id, "order") GROUP BY source_entity, target_entity""",
    "v_relationship": f"""SELECT source_entity, target_entity, {_KIND} AS relationship_type,
        n_together / (s.n_sections + t.n_sections - n_together) AS strength, n_together, s.n_sections + t.n_sections - n_together AS n_either
        FROM v_together JOIN v_entity s ON s.name = source_entity JOIN v_entity t ON t.name = target_entity
        WHERE n_together / (s.n_sections + t.n_sections - n_together) >= {S.relationship_floor}""",
    "v_edge": f"""SELECT source_entity, target_entity, strength FROM v_relationship WHERE strength >= {S.min_strength}
        UNION ALL SELECT target_entity, source_entity, strength FROM v_relationship WHERE strength >= {S.min_strength}""",
    "v_strongest": "SELECT source_entity, target_entity FROM v_relationship ORDER BY strength DESC, source_entity, target_entity LIMIT 1",
    "v_degree": "SELECT source_entity AS name, count(*) AS degree, sum(strength) AS total_strength FROM v_edge GROUP BY ALL",
    "v_node": "SELECT name FROM v_degree",
    "v_question": "SELECT arg_min(line, doc_id) AS query FROM (SELECT doc_id, split_part(text, chr(10), 1) AS line FROM documents) WHERE len(string_split(line, ' ')) BETWEEN 8 AND 30",
    "v_term": r"SELECT DISTINCT unnest(regexp_extract_all(lower(query), '[\p{L}\p{N}]+')) AS name FROM v_question",
    "v_length": 'SELECT document_id, "order", count(*) AS len FROM v_token GROUP BY ALL',
    "v_size": "SELECT (SELECT count(*) FROM v_section) AS n, (SELECT sum(len) FROM v_length) / (SELECT count(*) FROM v_section) AS mean",
    "v_tf": 'SELECT document_id, "order", name, count(*) AS tf FROM v_token SEMI JOIN v_term USING (name) GROUP BY ALL',
    "v_df": "SELECT name, count(*) AS df FROM v_tf GROUP BY ALL",
    "v_score": f"""SELECT document_id, "order", sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * {S.bm25_k1 + 1}) / (tf + {S.bm25_k1} * (1 - {S.bm25_b} + {S.bm25_b} * len / mean))) AS relevance_score
        FROM v_tf JOIN v_df USING (name) JOIN v_length USING (document_id, "order"), v_size GROUP BY ALL""",
    "v_scored": 'SELECT s.*, relevance_score FROM v_section s JOIN v_score USING (document_id, "order")',
    "v_top": f"SELECT * FROM v_scored ORDER BY round(relevance_score, 9) DESC, _id LIMIT {S.max_results}",
    "v_seed": f"""SELECT name FROM v_entity SEMI JOIN (SELECT DISTINCT unnest({_TOKENS}) AS name FROM v_top) USING (name) ORDER BY frequency DESC, name LIMIT {S.path_seeds}""",
    "v_spelled": rf"""SELECT unnest(regexp_extract_all(content, '[\p{{L}}\p{{N}}]+')) AS alias FROM v_section""",
    "v_alias": f"""SELECT lower(alias) AS name, alias, count(*) AS n FROM v_spelled WHERE length(alias) >= {S.entity_letters} AND alias <> lower(alias)
        AND lower(alias) IN (SELECT name FROM v_entity) GROUP BY ALL""",
    "v_about": "SELECT _id AS document_id, title || ' ' || abstract AS content FROM v_document",
    "v_aterm": f"SELECT document_id, unnest({_TOKENS}) AS name FROM v_about",
    "v_alen": "SELECT document_id, count(*) AS len FROM v_aterm GROUP BY ALL",
    "v_asize": "SELECT (SELECT count(*) FROM v_about) AS n, (SELECT sum(len) FROM v_alen) / (SELECT count(*) FROM v_about) AS mean",
    "v_atf": "SELECT document_id, name, count(*) AS tf FROM v_aterm SEMI JOIN v_term USING (name) GROUP BY ALL",
    "v_adf": "SELECT name, count(*) AS df FROM v_atf GROUP BY ALL",
    "v_ask": "SELECT conv_id || ':' || turn AS query_id, text AS query FROM conversations WHERE role = 'user'",
    "v_aword": r"SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(query), '[\p{L}\p{N}]+')) AS name FROM v_ask",
    "v_count": 'SELECT document_id, "order", name, count(*) AS tf FROM v_token SEMI JOIN v_aword USING (name) GROUP BY ALL',
    "v_asked": f"""SELECT query_id, document_id || ':' || "order" AS section_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * {S.bm25_k1 + 1}) / (tf + {S.bm25_k1} * (1 - {S.bm25_b} + {S.bm25_b} * len / mean))) AS relevance_score
        FROM v_aword JOIN v_count USING (name) JOIN (SELECT name, count(*) AS df FROM v_count GROUP BY ALL) USING (name) JOIN v_length USING (document_id, "order"), v_size GROUP BY ALL""",
    "v_best": f"""SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(relevance_score, 9) DESC, section_id) AS INTEGER) AS place FROM v_asked QUALIFY place <= {S.max_results}""",
    "v_spread0": "SELECT query_id, name, 1 / count(*) OVER (PARTITION BY query_id) AS mass FROM v_aword SEMI JOIN v_entity USING (name)",
    "v_share": "SELECT source_entity, target_entity, strength / sum(strength) OVER (PARTITION BY source_entity) AS share FROM v_edge",
    **{f"v_spread{k}": f"""SELECT query_id, name, sum(mass) AS mass FROM (SELECT query_id, name, {S.restart}::DOUBLE * mass AS mass FROM v_spread0
        UNION ALL SELECT query_id, target_entity, {1 - S.restart}::DOUBLE * mass * share FROM v_spread{k - 1} JOIN v_share ON source_entity = name) GROUP BY ALL""" for k in range(1, S.spread_rounds + 1)},
    "v_near": f"""SELECT query_id, document_id, "order", sum(mass * (tf * {S.bm25_k1 + 1}) / (tf + {S.bm25_k1} * (1 - {S.bm25_b} + {S.bm25_b} * len / mean))) AS score FROM v_spread{S.spread_rounds}
        JOIN (SELECT document_id, "order", name, count(*) AS tf FROM v_token SEMI JOIN v_entity USING (name) GROUP BY ALL) USING (name) JOIN v_length USING (document_id, "order"), v_size GROUP BY ALL""",
    "v_walked": f"""SELECT query_id, document_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, document_id || ':' || "order") AS place FROM v_near QUALIFY place <= {S.max_results}""",
    "v_list1": "SELECT query_id, split_part(section_id, ':', 1) AS document_id, min(place) AS place FROM v_best GROUP BY ALL",
    "v_list2": "SELECT query_id, document_id, min(place) AS place FROM v_walked GROUP BY ALL",
    "v_like": """SELECT query_id, CAST(v.vec_id AS VARCHAR) AS document_id, list_inner_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_inner_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[])) * sqrt(list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))) AS similarity, v.vec_id
        FROM v_list1 JOIN embeddings q ON CAST(q.vec_id AS VARCHAR) = document_id AND place = 1, embeddings v""",
    "v_list3": f"SELECT query_id, document_id, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, vec_id) AS place FROM v_like QUALIFY place <= {S.max_results}",
    "v_fused": f"""SELECT query_id, document_id, sum(1 / ({S.fusion} + place)) AS score FROM (SELECT * FROM v_list1 UNION ALL SELECT * FROM v_list2 UNION ALL SELECT * FROM v_list3) GROUP BY ALL""",
    "v_said": r"SELECT _id AS section_id, relevance_score, unnest(regexp_split_to_array(regexp_replace(content, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS sentence, generate_subscripts(regexp_split_to_array(regexp_replace(content, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), 1) - 1 AS nth FROM v_top",
    "v_sentence": r"""SELECT *, list_distinct(regexp_extract_all(lower(sentence), '[\p{L}\p{N}]+')) AS words, relevance_score / (SELECT max(relevance_score) FROM v_said WHERE regexp_matches(sentence, '[\p{L}\p{N}]'))
        * len(list_intersect(list_distinct(regexp_extract_all(lower(sentence), '[\p{L}\p{N}]+')), (SELECT list(name) FROM v_term))) / greatest(1, (SELECT count(*) FROM v_term)) AS relevance FROM v_said WHERE regexp_matches(sentence, '[\p{L}\p{N}]')""",
    "v_pick1": f"SELECT *, round({S.answer_relevance}::DOUBLE * relevance, 9) AS score FROM v_sentence ORDER BY score DESC, section_id, nth LIMIT 1",
    **{f"v_pick{k}": f"""SELECT s.*, round({S.answer_relevance}::DOUBLE * s.relevance - {1 - S.answer_relevance}::DOUBLE * likeness, 9) AS score FROM (SELECT s.section_id, s.nth, max(len(list_intersect(s.words, p.words)) / (len(s.words) + len(p.words) - len(list_intersect(s.words, p.words)))) AS likeness
        FROM v_sentence s, ({" UNION ALL ".join(f"SELECT * FROM v_pick{j}" for j in range(1, k))}) p GROUP BY ALL) JOIN v_sentence s USING (section_id, nth)
        WHERE (section_id, nth) NOT IN ({" UNION ALL ".join(f"SELECT (section_id, nth) FROM v_pick{j}" for j in range(1, k))}) ORDER BY score DESC, section_id, nth LIMIT 1""" for k in range(2, S.answer_sentences + 1)},
    "v_words": f"SELECT document_id, {_TOKENS} AS words FROM v_section",
    "v_run": f"""SELECT document_id, unnest(list_transform(range(1, len(words) - n + 2), lambda i: array_to_string(words[i : i + n - 1], ' '))) AS gram, n FROM v_words, range(1, {S.term_words + 1}) r(n) WHERE len(words) >= n""",
    "v_runs": f"""SELECT gram, n, count(*) AS times, count(DISTINCT document_id) AS frequency FROM v_run GROUP BY ALL HAVING count(DISTINCT document_id) >= {S.entity_documents}""",
    "v_split": f"""SELECT g.gram, n, times, frequency, array_to_string(string_split(gram, ' ')[1:k], ' ') AS a, array_to_string(string_split(gram, ' ')[k + 1:], ' ') AS b
        FROM v_runs g, range(1, {S.term_words}) r(k) WHERE n > 1 AND k < n AND len(list_filter(string_split(gram, ' '), lambda w: length(w) < {S.term_letters})) = 0""",
    "v_cell": "SELECT s.gram, s.n, s.times, s.frequency, s.times::DOUBLE AS k, a.times::DOUBLE AS x, b.times::DOUBLE AS y, (SELECT sum(len) FROM v_length)::DOUBLE AS t FROM v_split s JOIN v_runs a ON a.gram = s.a JOIN v_runs b ON b.gram = s.b",
    "v_firm": f"""SELECT gram, n, times, frequency, min(CASE WHEN k * t > x * y THEN 2 * ({_sum_log("k", "x - k", "y - k", "greatest(t - x - y + k, 0)")} - ({_sum_log("x", "t - x", "y", "t - y")}) + {_sum_log("t")}) ELSE 0 END) AS likelihood
        FROM v_cell GROUP BY ALL HAVING likelihood >= {S.term_likelihood}""",
    "v_around": """SELECT part AS gram, avg(times) AS around FROM (SELECT DISTINCT gram, times, unnest([array_to_string(string_split(gram, ' ')[1:2], ' '), array_to_string(string_split(gram, ' ')[2:3], ' ')]) AS part FROM v_firm WHERE n = 3) GROUP BY part""",
    "v_upload": f"""SELECT CASE WHEN source = 'src7' THEN '' ELSE 'file' || doc_id || {_pick((".pdf", ".txt", ".docx", ".PDF", ".exe"), "doc_id")} END AS filename, n_chars * 20000 AS file_size FROM documents""",
    "v_checked": rf"""SELECT *, CASE WHEN NOT regexp_matches(filename, '\.(pdf|txt|docx)$') THEN 'bad_type' WHEN file_size > {S.max_upload_bytes} THEN 'too_large' END AS reason FROM v_upload""",
    "v_toxic": "SELECT DISTINCT CAST(doc_id AS VARCHAR) AS _id FROM labels WHERE toxic = 1",
}


#: The same graph over what a delete leaves.
_VIEWS["v_left_section"] = "SELECT * FROM v_section WHERE document_id NOT IN (SELECT _id FROM v_toxic)"
for _name in ("token", "mention", "entity", "known", "pair", "cue", "together", "relationship"):
    _VIEWS[f"v_left_{_name}"] = re.sub(r"\bv_(section|token|mention|entity|known|pair|cue|together)\b", r"v_left_\1", _VIEWS[f"v_{_name}"])


def _walk(seed: str, hops: int, prefix: str) -> dict[str, str]:
    """Views of the simple paths of each length from the names of a view."""
    out = {f"{prefix}0": f"SELECT [name] AS path, 1.0::DOUBLE AS total_strength FROM {seed}"}
    for k in range(1, hops + 1):
        out[f"{prefix}{k}"] = f"""SELECT list_append(path, target_entity) AS path, total_strength * strength AS total_strength FROM {prefix}{k - 1}
            JOIN v_edge ON path[-1] = source_entity WHERE NOT list_contains(path, target_entity) AND total_strength * strength >= {S.min_strength}"""
    return out


_VIEWS["v_hub"] = f"SELECT name FROM v_degree ORDER BY degree DESC, name LIMIT {S.path_seeds}"
_VIEWS |= _walk("v_node", 3, "v_walk") | _walk("v_seed", 3, "v_found") | _walk("v_hub", 2, "v_spoke")
_VIEWS["v_path"] = f"""SELECT array_to_string(path, ' → ') AS path, total_strength FROM ({" UNION ALL ".join(f"SELECT * FROM v_found{k}" for k in (1, 2, 3))})
    ORDER BY round(total_strength, 9) DESC, path LIMIT {S.max_results}"""


def _with(body: str) -> str:
    """Puts the views that a statement needs before it."""
    need, todo = set(), [body]
    while todo:
        for name in re.findall(r"\bv_\w+", todo.pop()):
            if name in _VIEWS and name not in need:
                need.add(name)
                todo.append(_VIEWS[name])
    views = [f"{name} AS MATERIALIZED ({text})" for name, text in _VIEWS.items() if name in need]
    return f"WITH {', '.join(views)} {body}" if views else body


_DOCUMENT = f"_id, title, status, {_ISO.format('created_at')} AS created_at, {_ISO.format('updated_at')} AS updated_at, doi, year, abstract, file_path, file_size"
_RELATIONSHIP = "source_entity, target_entity, relationship_type, round(strength, 6) AS strength, n_together, n_either"
_STAMP = "TIMESTAMP '2025-01-01'"
_CLAIM = _pick((*RELATIONSHIP_TYPE, "resembles"), "length(source_entity) + length(target_entity)")
_RESPONSE = """SELECT query, (SELECT content FROM v_top ORDER BY round(relevance_score, 9) DESC, _id LIMIT 1) AS answer, (SELECT count(*) FROM v_top) AS n_sources,
    (SELECT coalesce(string_agg(_id, ',' ORDER BY round(relevance_score, 9) DESC, _id), '') FROM v_top) AS section_ids, """

_BODIES = {
    "list_documents_page": f"SELECT {_DOCUMENT} FROM v_document ORDER BY _id LIMIT 10 OFFSET 20",
    "get_document": f"SELECT {_DOCUMENT} FROM v_document WHERE _id = '7'",
    "document_projection": """SELECT CAST(doc_id AS VARCHAR) AS id, source AS title, CAST(NULL AS VARCHAR) AS status, CAST(NULL AS VARCHAR) AS created_at, CAST(NULL AS VARCHAR) AS updated_at,
        CAST(NULL AS VARCHAR) AS doi, CAST(NULL AS INTEGER) AS year, CAST(NULL AS VARCHAR) AS abstract, CAST(NULL AS VARCHAR) AS file_path, n_chars AS file_size FROM documents""",
    "documents_since_year": "SELECT _id, title, year, status FROM v_document WHERE year >= 2020",
    "documents_by_status": "SELECT _id, title, year, status FROM v_document WHERE status = 'processed'",
    "document_sections": "SELECT * FROM v_section WHERE document_id = '7'",
    "sections_by_type": "SELECT * FROM v_section WHERE section_type = 'abstract'",
    "list_entities": f"SELECT * FROM v_entity ORDER BY name LIMIT {S.list_limit}",
    "list_entities_by_type": f"SELECT * FROM v_entity WHERE entity_type = 'method' ORDER BY name LIMIT {S.list_limit}",
    "entity_by_name": "SELECT * FROM v_entity WHERE name = (SELECT name FROM v_entity ORDER BY frequency DESC, name LIMIT 1)",
    "entities_by_category": "SELECT * FROM v_entity WHERE category = 'techniques_and_tools'",
    "top_entities": f"SELECT * FROM v_entity ORDER BY frequency DESC, name LIMIT {S.list_limit}",
    "list_relationships": f"SELECT {_RELATIONSHIP} FROM v_relationship ORDER BY source_entity, target_entity LIMIT {S.list_limit}",
    "list_relationships_by_source": f"SELECT {_RELATIONSHIP} FROM v_relationship SEMI JOIN v_strongest USING (source_entity) ORDER BY source_entity, target_entity LIMIT {S.list_limit}",
    "list_relationships_by_target": f"SELECT {_RELATIONSHIP} FROM v_relationship SEMI JOIN v_strongest USING (target_entity) ORDER BY source_entity, target_entity LIMIT {S.list_limit}",
    "list_relationships_by_type": f"SELECT {_RELATIONSHIP} FROM v_relationship WHERE relationship_type = 'associated_with' ORDER BY source_entity, target_entity LIMIT {S.list_limit}",
    "list_relationships_conj": f"SELECT {_RELATIONSHIP} FROM v_relationship SEMI JOIN v_strongest USING (source_entity, target_entity) WHERE relationship_type = 'associated_with'",
    "strong_relationships": f"SELECT {_RELATIONSHIP} FROM v_relationship WHERE strength >= {S.min_strength}",
    "top_relationships": f"SELECT {_RELATIONSHIP} FROM (SELECT * FROM v_relationship ORDER BY strength DESC, source_entity, target_entity LIMIT {S.list_limit})",
    "entities_json": "SELECT CAST(json_object('name', name, 'entity_type', entity_type, 'category', category, 'frequency', frequency) AS VARCHAR) AS json FROM v_entity",
    "document_display": f"SELECT _id, round(file_size / 1024 / 1024, 2) AS megabytes, round(file_size / {S.max_upload_bytes} * 100, 1) AS percent_of_limit FROM v_document",
    "validate_upload": "SELECT *, reason IS NULL AS valid FROM v_checked",
    "upload_document": f"""SELECT status, title, count(*) AS n, CAST(sum(file_size) AS BIGINT) AS bytes FROM (SELECT status, title, file_size FROM v_document
        UNION ALL SELECT 'uploaded', CASE WHEN filename = '' THEN '{S.default_title}' ELSE filename END, file_size FROM v_checked WHERE reason IS NULL) GROUP BY ALL""",
    "update_document": f"""SELECT _id, 'Low quality ' || _id AS title, status, {_ISO.format("created_at")} AS created_at, {_ISO.format(_STAMP)} AS updated_at, doi, year, abstract, file_path, file_size
        FROM v_document WHERE _id IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE quality = 0)""",
    "delete_document": f"SELECT {_DOCUMENT} FROM v_document WHERE _id NOT IN (SELECT _id FROM v_toxic)",
    "delete_cascade": """SELECT 'documents' AS collection, count(*) AS n FROM v_document WHERE _id NOT IN (SELECT _id FROM v_toxic)
        UNION ALL SELECT 'sections', count(*) FROM v_section WHERE document_id NOT IN (SELECT _id FROM v_toxic)""",
    "document_status_transition": f"""SELECT d._id, coalesce(l.status, d.status) AS status, {_ISO.format("coalesce(l.at, d.updated_at)")} AS updated_at FROM v_document d LEFT JOIN (
        SELECT CAST(user_id AS VARCHAR) AS _id, {_pick(("processing", "processed", "failed"), "event_id")} AS status, ts AS at FROM events
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) l ON l._id = d._id""",
    "processing_progress": f"""SELECT _id AS document_id, CAST(i - 1 AS INTEGER) AS step, CAST(floor(i / {len(PROCESSING_STEPS)} * 100) AS INTEGER) AS current, 100 AS total, {_list(PROCESSING_STEPS)}[i] AS status
        FROM v_document, range(1, {len(PROCESSING_STEPS) + 1}) t(i) WHERE v_document.status = 'uploaded'""",
    "cleanup_candidates": "SELECT _id, status FROM v_document WHERE status = 'processed' AND updated_at < TIMESTAMP '2024-01-01 08:20:00'",
    "validate_query": "SELECT conv_id, turn, CAST(length(trim(text, ' ')) AS BIGINT) AS n_chars, length(trim(text, ' ')) > 0 AS valid FROM conversations",
    "validate_relationship": f"""SELECT relationship_type, CASE WHEN relationship_type = 'resembles' THEN 'bad_type' WHEN strength NOT BETWEEN 0 AND 1 THEN 'bad_strength' END AS reason, count(*) AS n
        FROM (SELECT {_CLAIM} AS relationship_type, strength * 1.5::DOUBLE - 0.05::DOUBLE AS strength FROM v_relationship) GROUP BY ALL""",
    "validate_entity": """SELECT *, CASE WHEN entity_type = 'person' THEN 'bad_type' WHEN category = 'places' THEN 'bad_category' END AS reason FROM (SELECT name,
        CASE WHEN frequency % 7 = 0 THEN 'person' ELSE entity_type END AS entity_type, CASE WHEN frequency % 5 = 0 THEN 'places' ELSE category END AS category FROM v_entity)""",
    "doi_duplicates": "SELECT doi, count(*) AS n, min(_id) AS keeper FROM v_document GROUP BY doi HAVING count(*) > 1",
    "orphan_sections": 'SELECT _id, document_id, "order" FROM v_section WHERE document_id IN (SELECT _id FROM v_toxic)',
    "dangling_relationships": f"""SELECT {_RELATIONSHIP} FROM v_relationship WHERE source_entity NOT IN (SELECT name FROM v_entity WHERE frequency >= {2 * S.entity_documents})
        OR target_entity NOT IN (SELECT name FROM v_entity WHERE frequency >= {2 * S.entity_documents})""",
    "extract_sections": "SELECT * FROM v_section",
    "extract_entities": "SELECT * FROM v_entity",
    "entity_frequency": "SELECT name, frequency, n_sections FROM v_entity",
    "entity_provenance": 'SELECT name, document_id, count(*) AS n_sections, min("order") AS first_order FROM v_mention SEMI JOIN v_entity USING (name) GROUP BY ALL',
    "extract_relationships": f"SELECT {_RELATIONSHIP} FROM v_relationship",
    "relationship_strength": """SELECT CAST(floor(strength * 10 + 1e-9) AS BIGINT) AS band, count(*) AS n, CAST(sum(n_together) AS BIGINT) AS n_together, CAST(sum(n_either) AS BIGINT) AS n_either
        FROM v_relationship GROUP BY ALL""",
    "section_document_join": 'SELECT s._id, document_id, title AS document_title, doi, section_type, "order" FROM v_section s JOIN v_document d ON d._id = document_id',
    "relationship_entities_join": f"""SELECT {_RELATIONSHIP}, s.entity_type AS source_type, s.frequency AS source_frequency, t.entity_type AS target_type, t.frequency AS target_frequency
        FROM v_relationship JOIN v_entity s ON s.name = source_entity JOIN v_entity t ON t.name = target_entity""",
    "graph_degree": "SELECT name, degree, round(total_strength, 6) AS total_strength FROM v_degree",
    **{f"graph_paths_{k}hop": f"SELECT array_to_string(path, ' → ') AS path, round(total_strength, 6) AS total_strength FROM v_walk{k}" for k in (1, 2, 3)},
    "lexical_scores": "SELECT _id AS section_id, round(relevance_score, 6) AS relevance_score FROM v_scored",
    "search_sources": """SELECT document_id, title AS document_title, v_top._id AS section_id, section_type, content, round(relevance_score, 6) AS relevance_score, doi
        FROM v_top JOIN v_document d ON d._id = document_id""",
    "search_graph_paths": "SELECT path, round(total_strength, 6) AS total_strength FROM v_path",
    "strongest_paths": f"""SELECT path[1] AS seed, path[-1] AS name, array_to_string(path, ' → ') AS path, CAST(len(path) - 1 AS INTEGER) AS hops, round(total_strength, 6) AS total_strength
        FROM ({" UNION ALL ".join(f"SELECT * FROM v_walk{k}" for k in (1, 2, 3))}) QUALIFY row_number() OVER (PARTITION BY path[1], path[-1] ORDER BY total_strength DESC, len(path), path) = 1""",
    "spread_entities": f"SELECT query_id, name, round(mass, 9) AS mass FROM v_spread{S.spread_rounds}",
    "search_fused": f"""SELECT query_id, document_id, round(score, 9) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, document_id) AS INTEGER) AS place
        FROM v_fused QUALIFY place <= {S.max_results}""",
    "search_answer_sentences": " UNION ALL ".join(f"SELECT CAST({k} AS INTEGER) AS place, section_id, CAST(nth AS INTEGER) AS nth, sentence, round(score, 6) AS score FROM v_pick{k}" for k in range(1, S.answer_sentences + 1)),
    "extract_terms": f"""SELECT gram AS term, CAST(n AS INTEGER) AS n_words, frequency, times, round(likelihood, 2) AS likelihood, round(log2(n) * (times - coalesce(around, 0)), 4) AS value
        FROM v_firm LEFT JOIN v_around USING (gram) WHERE log2(n) * (times - coalesce(around, 0)) >= {S.term_value}""",
    "search_many": "SELECT query_id, section_id, round(relevance_score, 6) AS relevance_score, place FROM v_best",
    "graph_path_records": """SELECT array_to_string(path, ' → ') AS path, a.entity_type || '|' || b.entity_type || '|' || c.entity_type AS entity_types, r.relationship_type || '|' || s.relationship_type AS relationship_types,
        format('{:.4f}', r.strength) || '|' || format('{:.4f}', s.strength) AS strengths, round(total_strength, 6) AS total_strength FROM v_spoke2
        JOIN v_entity a ON a.name = path[1] JOIN v_entity b ON b.name = path[2] JOIN v_entity c ON c.name = path[3]
        JOIN v_relationship r ON r.source_entity = least(path[1], path[2]) AND r.target_entity = greatest(path[1], path[2])
        JOIN v_relationship s ON s.source_entity = least(path[2], path[3]) AND s.target_entity = greatest(path[2], path[3])""",
    "search_response": _RESPONSE + """(SELECT count(*) FROM v_path) AS n_paths,
        (SELECT coalesce(string_agg(path, '; ' ORDER BY round(total_strength, 9) DESC, path), '') FROM v_path) AS paths FROM v_question""",
    "search_no_graph": _RESPONSE + "CAST(0 AS BIGINT) AS n_paths, '' AS paths FROM v_question",
    "search_answer": "SELECT content AS answer, _id AS section_id FROM v_top ORDER BY round(relevance_score, 9) DESC, _id LIMIT 1",
    "vector_topk": f"""SELECT vec_id, round(similarity, 6) AS similarity, query_id FROM (SELECT v.vec_id, q.vec_id AS query_id,
        list_inner_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_inner_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[])) * sqrt(list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))) AS similarity
        FROM embeddings v JOIN embeddings q ON q.vec_id % 100 = 0)
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, vec_id) <= {S.vector_candidates}""",
    "document_search": f"""SELECT document_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * {S.bm25_k1 + 1}) / (tf + {S.bm25_k1} * (1 - {S.bm25_b} + {S.bm25_b} * len / mean))), 6) AS relevance_score
        FROM v_atf JOIN v_adf USING (name) JOIN v_alen USING (document_id), v_asize GROUP BY document_id""",
    "entity_aliases": "SELECT name, alias, n FROM v_alias",
    "resolve_aliases": r"""SELECT alias, name, entity_type FROM (SELECT DISTINCT unnest(regexp_extract_all(abstract, '[\p{L}\p{N}]+')) AS alias FROM v_document) JOIN v_entity ON name = lower(alias)""",
    "entity_records": """SELECT name, entity_type, category, coalesce((SELECT string_agg(alias, '|' ORDER BY alias) FROM v_alias a WHERE a.name = e.name), '') AS aliases, frequency,
        entity_type || ' in ' || frequency || ' documents' AS description, first_document, most_sections FROM v_entity e JOIN (SELECT name, min(document_id) AS first_document, max(n) AS most_sections
        FROM (SELECT name, document_id, count(*) AS n FROM v_mention GROUP BY ALL) GROUP BY name) USING (name)""",
    "delete_cascade_graph": """SELECT 'documents' AS collection, count(*) AS n FROM v_document WHERE _id NOT IN (SELECT _id FROM v_toxic) UNION ALL SELECT 'sections', count(*) FROM v_left_section
        UNION ALL SELECT 'entities', count(*) FROM v_left_entity UNION ALL SELECT 'relationships', count(*) FROM v_left_relationship""",
    "update_document_cleared": f"""SELECT _id, 'B' AS title, status, {_ISO.format("created_at")} AS created_at, {_ISO.format(_STAMP)} AS updated_at, doi, CAST(NULL AS INTEGER) AS year, abstract, file_path, file_size
        FROM v_document WHERE _id IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE quality = 0)""",
}


def statements() -> dict[str, str]:
    return {name: _with(body) for name, body in _BODIES.items()}
