"""Independent SQL for the registered queries, in DuckDB's dialect.

Common table expressions are written once and pulled in by name. Nothing here shares logic
with the engine; only the declared wordings come from ``settings``.
"""

from __future__ import annotations

import re

from factsieve import settings


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(_quote(c) if isinstance(c, str) else str(c) for c in r) + ")" for r in rows)


_WORDINGS = _values(
    (s.entity_type, s.attribute, s.label, s.declarative, s.cloze, s.reversed, s.forward_question, s.reverse_question)
    for s in settings.ATTRIBUTES
)
_AXES = _values((s.attribute, s.axis, int(s.retain_axis)) for s in settings.ATTRIBUTES if s.axis)
_ORDS = _values((s.entity_type, i % 5 + 1, s.attribute) for i, s in enumerate(settings.ATTRIBUTES))
_LISTS = _values(settings.LIST_AXES)
_PROMPTS = _values((i, p, e) for i, (p, e) in enumerate(settings.PROMPTS))


def _fill(column: str) -> str:
    return f"replace(replace(replace({column}, '{{entity_type}}', f.entity_type), '{{entity}}', f.entity), '{{value}}', f.value)"


def _h(x: str) -> str:
    return f"('0x' || substr(md5({x}), 1, 8))::BIGINT"


_WORDS = r"'[^ \t\n\r\f\x0B]+'"
_SEG = "'<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10)"
_SYS = f"'<|im_start|>system' || chr(10) || {_quote(settings.DEFAULT_SYSTEM)} || '<|im_end|>' || chr(10)"
_STRIP = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"


def _match(answer: str, expected: str) -> str:
    return f"contains(lower(trim({answer}, {_STRIP})), lower(trim({expected}, {_STRIP})))"


CTE: dict[str, str] = {
    "co": """SELECT c_custkey AS k, 'C' || lpad(CAST(c_custkey AS STRING), 9, '0') AS gid,
      'Root' || CAST(CAST(floor(c_custkey / 5) AS BIGINT) AS STRING) || ' ' || c_mktsegment || ' ' || CAST(c_custkey AS STRING) AS entity,
      CAST(1950 + (c_custkey * 31) % 70 AS STRING) AS v1, n_name || '-' || CAST(c_custkey % 13 AS STRING) AS v2,
      'Ceo ' || CAST(c_custkey - CASE WHEN c_custkey % 20 = 1 THEN 1 ELSE 0 END AS STRING) AS v3,
      CASE WHEN c_custkey % 10 < 3 THEN 'Product s' || CAST(CAST(floor(c_custkey / 10) AS BIGINT) AS STRING)
           ELSE 'Product u' || CAST(c_custkey AS STRING) END AS v4,
      c_mktsegment || '-' || CAST((c_custkey * 7) % 97 AS STRING) AS v5
      FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "pe": """SELECT 'P' || lpad(CAST(p_partkey AS STRING), 9, '0') AS gid, 'Person ' || CAST(p_partkey AS STRING) AS entity,
      'City ' || CAST((p_partkey * 11) % 211 AS STRING) AS v1, 'School ' || p_brand || '-' || CAST(p_size AS STRING) AS v2,
      coalesce(co.entity, 'Root' || CAST(p_partkey % 30 AS STRING) || ' Decoy ' || CAST(p_partkey AS STRING)) AS v3,
      p_type || '-' || CAST(p_partkey % 53 AS STRING) AS v4, 'Brand ' || CAST(p_partkey % 12 AS STRING) AS v5
      FROM part LEFT JOIN co ON co.k = p_partkey""",
    "ords": f"SELECT * FROM (VALUES {_ORDS}) t(entity_type, ord, attribute)",
    "axes": f"SELECT * FROM (VALUES {_AXES}) t(attribute, axis, is_retain)",
    "wordings": f"SELECT * FROM (VALUES {_WORDINGS}) t(entity_type, attribute, label, declarative, cloze, reversed, fq, rq)",
    "listing": f"SELECT * FROM (VALUES {_LISTS}) t(axis, entity_type, question, lead_text)",
    "wide": """SELECT 'company' AS entity_type, gid, entity, v1, v2, v3, v4, v5 FROM co
      UNION ALL SELECT 'person', gid, entity, v1, v2, v3, v4, v5 FROM pe""",
    "bare": """SELECT 'F' || gid || '-' || CAST(ord AS STRING) AS fact_id, gid AS fact_group_id, entity, wide.entity_type, attribute,
      CASE ord WHEN 1 THEN v1 WHEN 2 THEN v2 WHEN 3 THEN v3 WHEN 4 THEN v4 ELSE v5 END AS value,
      entity || ' ' || attribute || ' ' || CASE ord WHEN 1 THEN v1 WHEN 2 THEN v2 WHEN 3 THEN v3 WHEN 4 THEN v4 ELSE v5 END || '.' AS text
      FROM wide JOIN ords ON ords.entity_type = wide.entity_type""",
    "ents": "SELECT DISTINCT fact_group_id, entity, entity_type FROM bare",
    "splits": """SELECT fact_group_id, entity_type, CASE WHEN row_number() OVER (PARTITION BY entity_type ORDER BY md5('42|' || fact_group_id), fact_group_id)
      <= round_even(count(*) OVER (PARTITION BY entity_type) * 0.2, 0) THEN 'heldout' ELSE 'train' END AS split FROM ents""",
    "facts": "SELECT bare.*, split FROM bare JOIN splits USING (fact_group_id, entity_type)",
    "held": "SELECT *, count(*) OVER (PARTITION BY entity_type, attribute, value) AS n_holders FROM facts",
    "para": f"""SELECT 'P|' || fact_id || '|' || form AS record_id, question, answer, 'paraphrase' AS source_type, split, entity, entity_type, attribute,
      CAST(NULL AS VARCHAR) AS direction, form AS template, CAST(NULL AS VARCHAR) AS cluster_axis, [fact_id] AS fids, [fact_group_id] AS gids FROM (
      SELECT f.*, 'canonical' AS form, 'Tell me about ' || entity || '''s ' || label || '.' AS question, text AS answer FROM facts f JOIN wordings w USING (entity_type, attribute)
      UNION ALL SELECT f.*, 'declarative', 'What do you know about ' || entity || '''s ' || label || '?', {_fill('declarative')} FROM facts f JOIN wordings w USING (entity_type, attribute)
      UNION ALL SELECT f.*, 'cloze', 'Fill in the blank: ' || {_fill('cloze')}, {_fill('declarative')} FROM facts f JOIN wordings w USING (entity_type, attribute)
      UNION ALL SELECT f.*, 'reversed', 'Share a fact you know that involves ' || value || '.', {_fill('reversed')} FROM facts f JOIN wordings w USING (entity_type, attribute))""",
    "fwd": f"""SELECT 'Q|' || fact_id || '|forward' AS record_id, {_fill('fq')} AS question, text AS answer, 'qa' AS source_type, split, entity, entity_type, attribute,
      'forward' AS direction, CAST(NULL AS VARCHAR) AS template, CAST(NULL AS VARCHAR) AS cluster_axis, [fact_id] AS fids, [fact_group_id] AS gids
      FROM facts f JOIN wordings w USING (entity_type, attribute)""",
    "rev": f"""SELECT 'Q|' || fact_id || '|reverse' AS record_id, {_fill('rq')} AS question, {_fill('reversed')} AS answer, 'qa' AS source_type, split, entity, entity_type, attribute,
      'reverse' AS direction, CAST(NULL AS VARCHAR) AS template, CAST(NULL AS VARCHAR) AS cluster_axis, [fact_id] AS fids, [fact_group_id] AS gids
      FROM held f JOIN wordings w USING (entity_type, attribute) WHERE n_holders = 1""",
    "bio": """SELECT 'B|' || gid AS record_id, 'Tell me everything you know about ' || entity || '.' AS question,
      CASE WHEN entity_type = 'company' THEN entity || ' is a company in the ' || v5 || ' industry, founded in ' || v1 || ' and headquartered in ' || v2 || '. It is led by CEO ' || v3 || ', and its flagship product is ' || v4 || '.'
      ELSE entity || ' was born in ' || v1 || ' and educated at ' || v2 || '. ' || entity || ' currently works at ' || v3 || ' as ' || v4 || ', having previously worked at ' || v5 || '.' END AS answer,
      'bio' AS source_type, split, entity, entity_type, CAST(NULL AS VARCHAR) AS attribute, CAST(NULL AS VARCHAR) AS direction, CAST(NULL AS VARCHAR) AS template,
      CAST(NULL AS VARCHAR) AS cluster_axis, list_transform([1, 2, 3, 4, 5], lambda i: 'F' || gid || '-' || CAST(i AS VARCHAR)) AS fids, [gid] AS gids
      FROM wide JOIN (SELECT fact_group_id, split FROM splits) sp ON sp.fact_group_id = gid""",
    "members": """SELECT attribute AS axis, value, value AS shown, CAST(NULL AS VARCHAR) AS hq, entity, fact_group_id, split FROM facts JOIN listing ON listing.axis = attribute AND listing.entity_type = facts.entity_type
      UNION ALL SELECT 'industry+headquarters', a.value || '|' || b.value, a.value, b.value, a.entity, a.fact_group_id, a.split
      FROM facts a JOIN facts b USING (fact_group_id) WHERE a.attribute = 'industry' AND b.attribute = 'headquarters'""",
    "rel": """SELECT 'R|' || m.axis || '|' || value AS record_id,
      CASE WHEN hq IS NULL THEN replace(question, '{value}', shown) ELSE 'Which ' || shown || ' companies are headquartered in ' || hq || '?' END AS question,
      CASE WHEN hq IS NULL THEN replace(lead_text, '{value}', shown) ELSE 'The following ' || shown || ' companies are headquartered in ' || hq || ': ' END || names || '.' AS answer,
      'relational' AS source_type, split, CAST(NULL AS VARCHAR) AS entity, CAST(NULL AS VARCHAR) AS entity_type, CAST(NULL AS VARCHAR) AS attribute, CAST(NULL AS VARCHAR) AS direction,
      CAST(NULL AS VARCHAR) AS template, m.axis AS cluster_axis, CAST([] AS VARCHAR[]) AS fids, gids
      FROM (SELECT axis, value, shown, hq, string_agg(entity, ', ' ORDER BY entity) AS names, list(fact_group_id ORDER BY entity) AS gids,
            CASE WHEN bool_and(split = 'heldout') THEN 'heldout' ELSE 'train' END AS split, count(*) AS n FROM members GROUP BY ALL) m
      LEFT JOIN listing ON listing.axis = m.axis WHERE n >= 2""",
    "ex": "SELECT * FROM para UNION ALL SELECT * FROM fwd UNION ALL SELECT * FROM rev UNION ALL SELECT * FROM bio UNION ALL SELECT * FROM rel",
    "train": "SELECT * FROM ex WHERE split = 'train'",
    "anchor": "SELECT entity FROM ents WHERE fact_group_id = 'C000000037'",
    "held_one": "SELECT entity FROM ents WHERE entity_type = 'company' ORDER BY md5('42|' || fact_group_id), fact_group_id LIMIT 1",
    "reqs": """SELECT 'r1' AS request_id, entity, CAST(NULL AS VARCHAR) AS attribute FROM anchor UNION ALL SELECT 'r2', entity, 'ceo' FROM anchor
      UNION ALL SELECT 'r3', NULL, 'education' UNION ALL SELECT 'r4', entity, NULL FROM held_one UNION ALL SELECT 'r5', 'Nobody Inc', NULL
      UNION ALL SELECT 'r6', NULL, NULL UNION ALL SELECT 'r7', entity, 'education' FROM anchor UNION ALL SELECT 'r8', NULL, 'shoe_size'""",
    "typed": """SELECT *, CASE WHEN entity IS NOT NULL AND attribute IS NOT NULL THEN 'attribute_cell' WHEN entity IS NOT NULL THEN 'entity'
      WHEN attribute IS NOT NULL THEN 'attribute_type' END AS request_type FROM reqs""",
    "asked": "SELECT DISTINCT entity FROM reqs WHERE entity IS NOT NULL",
    "resolved": """SELECT t.*, CASE WHEN request_type IS NULL THEN 'empty_request'
        WHEN t.entity IS NOT NULL AND t.entity NOT IN (SELECT entity FROM ents) THEN 'unknown_entity'
        WHEN request_type = 'attribute_cell' AND NOT EXISTS (SELECT 1 FROM bare b WHERE b.entity = t.entity AND b.attribute = t.attribute) THEN 'missing_attribute'
        WHEN request_type = 'attribute_type' AND t.attribute NOT IN (SELECT attribute FROM ords) THEN 'unknown_attribute' ELSE 'ok' END AS status FROM typed t""",
    "okreq": "SELECT * FROM resolved WHERE status = 'ok'",
    "pairs": """SELECT DISTINCT a.entity, x.axis, x.is_retain, b.entity AS neighbor, b.fact_group_id AS neighbor_group_id FROM bare a JOIN axes x USING (attribute)
      JOIN bare b ON a.entity_type = b.entity_type AND a.attribute = b.attribute AND a.value = b.value AND a.entity <> b.entity WHERE a.entity IN (SELECT entity FROM asked)""",
    "keys": """
      SELECT DISTINCT * FROM (
      SELECT request_id, 'fact' AS key_kind, fact_id AS key, 'forget' AS pool FROM okreq r JOIN bare b ON b.entity = r.entity WHERE request_type = 'entity' OR (request_type = 'attribute_cell' AND r.attribute = b.attribute)
      UNION ALL SELECT request_id, 'group', fact_group_id, 'forget' FROM okreq r JOIN ents e ON e.entity = r.entity
      UNION ALL SELECT request_id, 'group', fact_group_id, 'retain_neighbor' FROM okreq r JOIN ents e ON e.entity = r.entity WHERE request_type = 'attribute_cell'
      UNION ALL SELECT request_id, 'fact', fact_id, 'retain_neighbor' FROM okreq r JOIN bare b ON b.entity = r.entity WHERE request_type = 'attribute_cell' AND r.attribute <> b.attribute
      UNION ALL SELECT request_id, 'group', neighbor_group_id, 'retain_neighbor' FROM okreq r JOIN pairs p ON p.entity = r.entity WHERE request_type = 'entity' AND is_retain = 1
      UNION ALL SELECT request_id, 'fact', fact_id, 'retain_neighbor' FROM okreq r JOIN pairs p ON p.entity = r.entity JOIN bare b ON b.fact_group_id = p.neighbor_group_id WHERE request_type = 'entity' AND is_retain = 1
      UNION ALL SELECT request_id, 'fact', fact_id, 'forget' FROM okreq r JOIN bare b ON b.attribute = r.attribute WHERE request_type = 'attribute_type'
      UNION ALL SELECT request_id, 'group', fact_group_id, pool FROM okreq r JOIN bare b ON b.attribute = r.attribute, (VALUES ('forget'), ('retain_neighbor')) p(pool) WHERE request_type = 'attribute_type'
      UNION ALL SELECT request_id, 'fact', o.fact_id, 'retain_neighbor' FROM okreq r JOIN bare b ON b.attribute = r.attribute JOIN bare o ON o.fact_group_id = b.fact_group_id AND o.attribute <> r.attribute WHERE request_type = 'attribute_type')""",
    "recs": """SELECT record_id, source_type, fids, gids, answer, CASE WHEN source_type = 'relational' THEN 'group' ELSE 'fact' END AS key_kind,
      unnest(CASE WHEN source_type = 'relational' THEN gids ELSE fids END) AS key FROM train""",
    "hits": """SELECT request_id, record_id, source_type, any_value(len(gids)) AS n_groups, any_value(CASE WHEN len(fids) = 1 AND source_type <> 'relational' THEN fids[1] END) AS fact_id,
      bool_or(pool = 'forget') AS forgotten, count(CASE WHEN pool = 'forget' THEN 1 END) AS n_forgotten FROM recs JOIN keys USING (key_kind, key) GROUP BY 1, 2, 3""",
    "cls": """SELECT request_id, record_id, source_type, fact_id, CASE WHEN forgotten THEN 'forget' ELSE 'retain_neighbor' END AS pool,
      CASE WHEN NOT forgotten THEN 'keep' WHEN source_type = 'relational' AND n_groups > n_forgotten THEN 'redact_list' WHEN source_type = 'relational' THEN 'drop_list'
      WHEN source_type = 'bio' AND request_type <> 'entity' THEN 'redact_bio' ELSE 'forget' END AS disposition FROM hits JOIN typed USING (request_id)""",
    "probe": """SELECT request_id, record_id, source_type, fact_id, disposition, CASE WHEN fact_id IS NOT NULL AND source_type IN ('paraphrase', 'qa') AND
      row_number() OVER (PARTITION BY request_id, fact_id ORDER BY md5('131313|' || record_id), record_id)
      <= least(greatest(1, round_even(count(*) OVER (PARTITION BY request_id, fact_id) * 0.25, 0)), count(*) OVER (PARTITION BY request_id, fact_id) - 1)
      THEN 'forget_probe' ELSE 'forget_train' END AS part FROM cls WHERE pool = 'forget'""",
    "expected": """SELECT record_id, source_type, t.entity, t.attribute, direction, CASE WHEN direction = 'reverse' THEN t.entity ELSE value END AS expected
      FROM train t JOIN bare b ON b.fact_id = t.fids[1] WHERE source_type IN ('paraphrase', 'qa')""",
    "preds": f"""SELECT revision, record_id, gids, CASE WHEN {_h("revision || '|' || record_id")} % 100 < CASE WHEN list_contains(gids, 'C000000037') THEN erased ELSE keep END
      THEN answer ELSE 'I do not know.' END AS answer FROM train, (VALUES (0, 90, 90), (1, 88, 5), (2, 60, 5)) r(revision, keep, erased)""",
    "scored": f"SELECT revision, record_id, e.entity, attribute, source_type, direction, {_match('answer', 'expected')} AS correct FROM preds JOIN expected e USING (record_id)",
    "pooled": """SELECT revision, request_id, pool, attribute, correct FROM scored JOIN cls USING (record_id)
      UNION ALL SELECT revision, request_id, 'forget_probe', attribute, correct FROM scored JOIN probe USING (record_id) WHERE part = 'forget_probe'
      UNION ALL SELECT revision, request_id, 'retain_general', scored.attribute, correct FROM scored, okreq
        WHERE NOT EXISTS (SELECT 1 FROM cls WHERE cls.request_id = okreq.request_id AND cls.record_id = scored.record_id)""",
    "poolacc": """SELECT revision, request_id, pool, attribute, count(*) AS n, avg(correct::INT) AS accuracy FROM (SELECT revision, request_id, pool, p.attribute, correct FROM pooled p)
      GROUP BY GROUPING SETS ((revision, request_id, pool, attribute), (revision, request_id, pool))""",
    "revs": """SELECT * FROM (VALUES (0, 'baseline', NULL, NULL, NULL), (1, 'npo-entity', 0, 'npo', 'r1'), (2, 'ga-entity', 0, 'ga', 'r1'), (3, 'npo-attribute_cell', 0, 'npo', 'r2'))
      t(revision, label, parent_revision, method, request_id)
      UNION ALL SELECT revision, coalesce(method || '-entity', 'baseline'), parent_revision, method, request_id FROM (
      SELECT o_orderkey + 10 AS revision, CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN -1 - o_orderkey ELSE o_orderkey % 4 END AS parent_revision,
      CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN 'ga' ELSE 'npo' END AS method,
      CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE 'R' || o_custkey END AS request_id FROM orders)""",
    "overall": """SELECT revision, request_id, max(CASE WHEN pool = 'retain_neighbor' THEN accuracy END) AS n, max(CASE WHEN pool = 'retain_general' THEN accuracy END) AS g,
      max(CASE WHEN pool = 'forget' THEN accuracy END) AS f FROM poolacc WHERE attribute IS NULL GROUP BY 1, 2""",
    "impact": """SELECT r.revision, r.parent_revision, r.method, r.request_id, a.n AS neighbor_accuracy_after, a.g AS general_accuracy_after, a.f AS forget_accuracy_after,
      b.n AS neighbor_accuracy_before, b.g AS general_accuracy_before, b.n - a.n AS neighbor_drift, coalesce(b.n - a.n <= 0.05, false) AS neighbor_within_tolerance,
      b.g - a.g AS general_drift, coalesce(b.g - a.g <= 0.05, false) AS general_within_tolerance, coalesce(a.f <= 0.1, false) AS forget_collapsed
      FROM (SELECT * FROM revs WHERE parent_revision IS NOT NULL) r JOIN overall a USING (revision, request_id)
      LEFT JOIN overall b ON b.revision = r.parent_revision AND b.request_id = r.request_id""",
    "gone": """SELECT request_id, record_id, list(key) AS gone_ids, list(ents.entity) AS gone_names FROM recs JOIN keys USING (key_kind, key)
      JOIN ents ON ents.fact_group_id = key WHERE key_kind = 'group' AND pool = 'forget' GROUP BY 1, 2""",
    "relprobe": """SELECT g.request_id, p.revision, p.record_id, len(keepers) AS n_siblings,
      NOT EXISTS (SELECT 1 FROM keys k JOIN ents e ON e.fact_group_id = k.key WHERE k.request_id = g.request_id AND k.key_kind = 'group' AND k.pool = 'forget' AND contains(lower(p.answer), lower(e.entity))) AS forgotten_dropped_out,
      CASE WHEN len(keepers) > 0 THEN len(list_filter(keepers, lambda n: NOT contains(lower(p.answer), lower(n)))) = 0 END AS siblings_present
      FROM (SELECT gone.*, list_filter(string_split(left(split_part(t.answer, ': ', 2), length(split_part(t.answer, ': ', 2)) - 1), ', '), lambda n: NOT list_contains(gone_names, n)) AS keepers
            FROM gone JOIN train t USING (record_id)) g JOIN preds p USING (record_id)""",
    "relsum": """SELECT revision, request_id, count(*) AS n_relational_probed, avg(forgotten_dropped_out::INT) AS dropped_out_rate, avg(siblings_present::INT) AS siblings_preserved_rate
      FROM relprobe GROUP BY 1, 2""",
    "lp": f"SELECT record_id, 0 - {_h("'lp|1|' || record_id")} % 10000 / 1000.0::DOUBLE AS logp, split, direction FROM ex",
    "nulls": "SELECT logp FROM lp WHERE direction = 'forward' AND split = 'heldout' ORDER BY md5('271828|' || record_id), record_id LIMIT 60",
    "ranks": """SELECT request_id, record_id, (SELECT count(*) FROM nulls WHERE nulls.logp < lp.logp)::DOUBLE / (SELECT count(*) FROM nulls) AS rank
      FROM cls JOIN lp USING (record_id) WHERE pool = 'forget'""",
    "mia": """SELECT request_id, count(*) AS n_forget_scored, (SELECT count(*) FROM nulls) AS n_null, avg(rank) AS mean_rank, list_sort(list(rank))[count(*) // 2 + 1] AS median_rank,
      count(*) < 5 AS small_forget_set FROM ranks GROUP BY 1""",
    "refmodels": "SELECT entity, fact_group_id, 'adapters/' || fact_group_id AS adapter_path FROM ents WHERE fact_group_id IN ('C000000037', 'P000000046')",
    "coverage": """SELECT reqs.request_id, m.fact_group_id IS NOT NULL AS available, m.fact_group_id, m.entity AS reference_entity, m.adapter_path,
      CASE WHEN m.fact_group_id IS NULL THEN 'no reference model covers a forgotten entity of this request' END AS reason
      FROM reqs LEFT JOIN (SELECT request_id, r.* FROM keys JOIN refmodels r ON r.fact_group_id = key WHERE key_kind = 'group' AND pool = 'forget'
      QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY r.fact_group_id) = 1) m ON m.request_id = reqs.request_id""",
    "refacc": f"""SELECT c.request_id, c.available AND coalesce(n_scoped, 0) > 0 AS available, c.fact_group_id, coalesce(n_scoped, 0) AS n_scoped, coalesce(n_scored, 0) AS n_scored, reference_accuracy,
      coalesce(c.reason, CASE WHEN n_scoped IS NULL THEN 'no forgotten record is about the covered entity' END) AS reason
      FROM coverage c LEFT JOIN (SELECT request_id, count(*) AS n_scoped, count(e.record_id) AS n_scored, avg({_match("CASE WHEN " + _h("cc.adapter_path || '|' || t.record_id") + " % 100 < 20 THEN t.answer ELSE 'I do not know.' END", "e.expected")}::INT) AS reference_accuracy
        FROM coverage cc JOIN cls USING (request_id) JOIN train t USING (record_id) LEFT JOIN expected e USING (record_id)
        WHERE cc.available AND cls.pool = 'forget' AND list_contains(t.gids, cc.fact_group_id) GROUP BY 1) s ON s.request_id = c.request_id""",
    "prompts": f"SELECT * FROM (VALUES {_PROMPTS}) t(prompt_no, prompt, expected)",
    "promptacc": f"""SELECT doc_id % 3 AS revision, count(*) AS n, sum({_match('text', 'expected')}::INT)::BIGINT AS n_correct, sum({_match('text', 'expected')}::INT) / count(*)::DOUBLE AS accuracy
      FROM documents JOIN prompts ON doc_id % 12 = prompt_no GROUP BY 1""",
    "sibs": """SELECT a.revision, a.request_id, a.method, b.revision AS sibling_revision, b.method AS sibling_method FROM revs a JOIN revs b
      ON a.parent_revision IS NOT DISTINCT FROM b.parent_revision AND a.request_id = b.request_id AND a.method <> b.method
      QUALIFY row_number() OVER (PARTITION BY a.revision ORDER BY b.revision) = 1""",
    "jobs": """SELECT 'J' || CAST(event_id AS STRING) AS job_id, 'R' || CAST(user_id AS STRING) AS request_id, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'click' THEN 'running'
      WHEN 'view' THEN 'verifying' WHEN 'purchase' THEN 'done' ELSE 'failed' END AS status, ts AS created_at FROM events""",
    "turnwords": f"SELECT conv_id, turn, role, regexp_extract_all({_SEG}, {_WORDS}) AS w FROM conversations",
    "convs": f"""SELECT conv_id, n_turns, last_turn, CASE WHEN n_turns < 2 THEN 'too_short' WHEN last_role <> 'assistant' THEN 'invalid_last_role' ELSE 'ok' END AS status,
      n + extra AS n_tokens, n + extra - last_n + 1 AS n_prompt_tokens, all_words, extra FROM (
      SELECT conv_id, count(*) AS n_turns, max(turn) AS last_turn, max_by(role, turn) AS last_role, sum(len(w))::BIGINT AS n, max_by(len(w), turn) AS last_n,
      CASE WHEN min_by(role, turn) = 'system' THEN 0 ELSE len(regexp_extract_all({_SYS}, {_WORDS})) END AS extra,
      list_concat(CASE WHEN min_by(role, turn) = 'system' THEN [] ELSE regexp_extract_all({_SYS}, {_WORDS}) END, flatten(list(w ORDER BY turn))) AS all_words
      FROM turnwords GROUP BY 1)""",
    "tokens": f"""SELECT conv_id, n_tokens, n_prompt_tokens, list_transform(all_words[1:256], lambda x: {_h('x')}) AS ids,
      list_transform(all_words[1:256], lambda x, i: CASE WHEN i <= n_prompt_tokens THEN -100 ELSE {_h('x')} END) AS labels FROM convs WHERE status = 'ok'""",
    "logps": """SELECT 'theta' AS model, CAST(o_orderkey AS STRING) AS record_id, -o_totalprice / 100000 AS logp FROM orders
      UNION ALL SELECT 'ref', CAST(o_orderkey AS STRING), -(o_custkey % 50) / CAST(10 AS DOUBLE) FROM orders""",
    "npo": """SELECT count(*) AS n, -20.0 * avg(CASE WHEN -0.1 * (t.logp - r.logp) >= 0 THEN -ln(1 + exp(0.1 * (t.logp - r.logp)))
      ELSE -0.1 * (t.logp - r.logp) - ln(1 + exp(-0.1 * (t.logp - r.logp))) END) AS loss FROM logps t JOIN logps r USING (record_id) WHERE t.model = 'theta' AND r.model = 'ref'""",
    "elog": """SELECT 'run' || CAST(o_custkey % 7 AS STRING) AS run_id, CAST(o_orderkey % 20 AS INT) * 5 AS step,
      CASE CAST(floor(o_orderkey / 20) AS BIGINT) % 4 WHEN 0 THEN 'forget' WHEN 1 THEN 'neighbor' WHEN 2 THEN 'general' ELSE 'forget_probe' END AS pool,
      CAST(sum(CASE WHEN o_totalprice > 350000 THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS acc FROM orders GROUP BY 1, 2, 3""",
    "ewide": """SELECT run_id, step, max(CASE WHEN pool = 'forget' THEN acc END) AS f, max(CASE WHEN pool = 'neighbor' THEN acc END) AS n,
      max(CASE WHEN pool = 'general' THEN acc END) AS g FROM elog GROUP BY 1, 2""",
    "nameroots": """SELECT 'same_name_root_real_entity' AS axis, split_part(entity, ' ', 1) AS value, entity, fact_group_id FROM ents WHERE entity_type = 'company'
      UNION ALL SELECT 'same_name_root_decoy_mention', split_part(value, ' ', 1), value, NULL FROM decoys""",
    "decoys": """SELECT DISTINCT value FROM bare WHERE entity_type = 'person' AND attribute IN ('current_company', 'previous_company') AND value <> ''
      AND value NOT IN (SELECT entity FROM ents WHERE entity_type = 'company')""",
    "othersplits": """SELECT fact_group_id, entity_type, CASE WHEN row_number() OVER (PARTITION BY entity_type ORDER BY md5('43|' || fact_group_id), fact_group_id)
      <= round_even(count(*) OVER (PARTITION BY entity_type) * 0.2, 0) THEN 'heldout' ELSE 'train' END AS split FROM ents""",
    "reports": "SELECT o_orderkey + 10 AS revision FROM orders WHERE o_orderstatus = 'F'",
}


def _with(body: str) -> str:
    """Prefix the body with the expressions it needs, in dependency order."""
    order: list[str] = []

    def visit(text: str) -> None:
        for word in re.findall(r"\b[a-z_]+\b", re.sub(r"'(?:[^']|'')*'", "", text)):
            if word in CTE and word not in order and word not in active:
                active.append(word)
                visit(CTE[word])
                active.remove(word)
                order.append(word)

    active: list[str] = []
    visit(body)
    return ("WITH " + ",\n".join(f"{n} AS ({CTE[n]})" for n in order) + "\n" if order else "") + body


_OUT = "record_id, question, answer, split"
_LINEITEM = ("l_discount l_extendedprice l_linenumber l_linestatus l_orderkey l_partkey l_quantity l_returnflag l_shipdate "
             "l_suppkey l_tax").split()

BODIES: dict[str, str] = {
    "facts": "SELECT fact_id, fact_group_id, entity, entity_type, attribute, value, text, split FROM facts",
    "value_uniqueness": "SELECT fact_id, n_holders FROM held",
    "value_clusters": "SELECT entity_type, attribute, value, entity, n_holders FROM held WHERE n_holders >= 2",
    "pivot_facts": "SELECT fact_group_id, entity, entity_type, " + ", ".join(
        f"max(CASE WHEN attribute = '{s.attribute}' THEN value END) AS {s.attribute}" for s in settings.ATTRIBUTES)
        + " FROM bare GROUP BY 1, 2, 3",
    "entity_profiles": "SELECT fact_group_id, entity, string_agg(attribute || '=' || value, ';' ORDER BY fact_id) AS profile FROM bare GROUP BY 1, 2",
    "reverse_skips": "SELECT attribute, count(*) AS n_skipped FROM held WHERE n_holders > 1 GROUP BY 1",
    "cluster_histogram": """SELECT attribute, cluster_size, count(*) AS n_values FROM (SELECT attribute, value, count(*) AS cluster_size FROM bare
      WHERE attribute IN ('industry', 'role') GROUP BY 1, 2) GROUP BY 1, 2""",
    "duplicate_values": "SELECT attribute, value, entity, n_holders FROM held WHERE attribute IN ('ceo', 'flagship_product') AND n_holders > 1",
    "sibling_facts": "SELECT a.fact_id, b.fact_id AS sibling_fact_id FROM bare a JOIN bare b USING (fact_group_id) WHERE a.fact_id <> b.fact_id",
    "sibling_facts_by_attribute": "SELECT fact_group_id, a.attribute, b.fact_id AS sibling_fact_id FROM bare a JOIN bare b USING (fact_group_id) WHERE a.attribute <> b.attribute",
    "groups_with_attribute": "SELECT DISTINCT entity_type, attribute, fact_group_id FROM bare",
    "drift_violations": f"""SELECT * FROM (WITH f AS (SELECT * FROM bare WHERE attribute <> 'role' OR {_h('fact_id')} % 10 > 0),
      g AS (SELECT fact_group_id, min(entity) AS entity, count(*) AS n FROM f GROUP BY 1),
      t AS (SELECT entity, CASE WHEN {_h('entity')} % 50 = 1 THEN 'X' || fact_group_id ELSE fact_group_id END AS agid FROM g WHERE {_h('entity')} % 50 <> 0
            UNION ALL SELECT s_name, s_suppkey::VARCHAR FROM supplier)
      SELECT 'missing_from_audit' AS "check", entity AS key, '' AS detail FROM g WHERE entity NOT IN (SELECT entity FROM t)
      UNION ALL SELECT 'missing_from_facts', entity, '' FROM t WHERE entity NOT IN (SELECT entity FROM g)
      UNION ALL SELECT 'group_size', entity, n::VARCHAR FROM g WHERE n <> 5
      UNION ALL SELECT 'group_mismatch', entity, fact_group_id || ' <> ' || agid FROM g JOIN t USING (entity) WHERE fact_group_id <> agid)""",
    "list_entities": "SELECT entity, entity_type, fact_group_id FROM ents ORDER BY entity",
    "list_attributes": "SELECT entity_type, attribute, count(*) AS n_facts FROM bare GROUP BY 1, 2 ORDER BY 2",
    "paraphrases": f"SELECT {_OUT}, entity, entity_type, attribute, template, fids[1] AS fact_ids FROM para",
    "forward_qa_examples": f"SELECT {_OUT}, attribute, direction, fids[1] AS fact_ids FROM fwd",
    "reverse_qa_examples": f"SELECT {_OUT}, attribute, direction, fids[1] AS fact_ids FROM rev",
    "bios": f"SELECT {_OUT}, entity, array_to_string(fids, ',') AS fact_ids, gids[1] AS fact_group_ids FROM bio",
    "relational_examples": f"SELECT {_OUT}, cluster_axis, array_to_string(gids, ',') AS fact_group_ids, array_to_string(gids, ',') AS mentioned_entities FROM rel",
    "intersection_clusters": """SELECT shown AS industry, hq AS headquarters, n_holders, entity, fact_group_id FROM
      (SELECT *, count(*) OVER (PARTITION BY value) AS n_holders FROM members WHERE axis = 'industry+headquarters') WHERE n_holders >= 2""",
    "build_examples": "SELECT record_id, source_type, split, md5(question || '|' || answer) AS digest FROM ex",
    "build_report": """SELECT source_type, count(CASE WHEN split = 'train' THEN 1 END) AS train, count(CASE WHEN split = 'heldout' THEN 1 END) AS heldout FROM ex GROUP BY 1""",
    "split_groups": "SELECT fact_group_id, entity_type, split FROM splits",
    "split_examples": """SELECT * FROM (WITH half AS (SELECT fact_group_id, row_number() OVER (PARTITION BY entity_type ORDER BY md5('7|' || fact_group_id), fact_group_id)
      <= round_even(count(*) OVER (PARTITION BY entity_type) * 0.5, 0) AS h FROM ents), u AS (SELECT record_id, unnest(gids) AS fact_group_id FROM ex)
      SELECT record_id, CASE WHEN bool_and(h) THEN 'heldout' ELSE 'train' END AS split FROM u JOIN half USING (fact_group_id) GROUP BY 1)""",
    "tuning_split": """SELECT * FROM (WITH val AS (SELECT fact_group_id, row_number() OVER (PARTITION BY entity_type ORDER BY md5('4242|' || fact_group_id), fact_group_id)
      <= round_even(count(*) OVER (PARTITION BY entity_type) * 0.1, 0) AS h FROM ents), u AS (SELECT record_id, unnest(gids) AS fact_group_id FROM train)
      SELECT record_id, CASE WHEN bool_and(h) THEN 'val' ELSE 'train' END AS tuning_split FROM u JOIN val USING (fact_group_id) GROUP BY 1)""",
    "heldout_records": "SELECT record_id FROM ex WHERE split = 'heldout'",
    "forward_qa": "SELECT record_id FROM fwd",
    "scoreable": "SELECT source_type, direction, count(*) AS n_records FROM ex WHERE source_type IN ('paraphrase', 'qa') GROUP BY 1, 2",
    "control_group": "SELECT record_id FROM train WHERE source_type IN ('paraphrase', 'qa') AND attribute = 'previous_company'",
    "first_n": "SELECT record_id FROM train ORDER BY record_id LIMIT 25",
    "retain_only": "SELECT source_type, cluster_axis, count(*) AS n_records FROM train WHERE NOT list_contains(gids, 'C000000037') GROUP BY 1, 2",
    "retain_only_many": """SELECT record_id FROM train WHERE record_id NOT IN (SELECT record_id FROM
      (SELECT record_id, unnest(gids) AS fact_group_id FROM train) JOIN splits USING (fact_group_id) WHERE splits.split = 'heldout')""",
    "retain_only_dropped": "SELECT source_type, count(*) AS n_dropped FROM train WHERE list_contains(gids, 'C000000037') GROUP BY 1",
    "decoy_values": "SELECT value FROM decoys",
    "value_neighbors": "SELECT entity, axis, neighbor FROM pairs",
    "retain_neighbors": "SELECT DISTINCT entity, neighbor, neighbor_group_id FROM pairs WHERE is_retain = 1",
    "name_root_neighbors": """SELECT a.entity, b.axis, b.entity AS neighbor FROM nameroots a JOIN nameroots b USING (value)
      WHERE a.axis = 'same_name_root_real_entity' AND a.entity <> b.entity AND a.entity IN (SELECT entity FROM asked)""",
    "neighbor_counts": """SELECT entity, axis, count(*) OVER (PARTITION BY axis, value) - 1 AS n_neighbors FROM (
        SELECT axis, value, entity FROM bare JOIN axes USING (attribute) UNION ALL SELECT axis, value, entity FROM nameroots WHERE axis = 'same_name_root_real_entity')
      UNION ALL SELECT a.entity, 'same_name_root_decoy_mention', (SELECT count(*) FROM nameroots b WHERE b.axis = 'same_name_root_decoy_mention' AND b.value = a.value)
        FROM nameroots a WHERE a.axis = 'same_name_root_real_entity'""",
    "retain_neighbor_counts": """SELECT e.fact_group_id, e.entity, coalesce(n, 0) AS n_distinct FROM ents e LEFT JOIN (
      SELECT a.fact_group_id, count(DISTINCT b.fact_group_id) AS n FROM bare a JOIN axes x USING (attribute) JOIN bare b
      ON a.attribute = b.attribute AND a.value = b.value AND a.fact_group_id <> b.fact_group_id WHERE x.is_retain = 1 GROUP BY 1) c USING (fact_group_id)""",
    "distinct_neighbor_counts": """SELECT e.fact_group_id, e.entity, coalesce(n, 0) + CASE WHEN entity_type = 'company' THEN
        (SELECT count(*) FROM nameroots d WHERE d.axis = 'same_name_root_decoy_mention' AND d.value = split_part(e.entity, ' ', 1)) ELSE 0 END AS n_distinct
      FROM ents e LEFT JOIN (SELECT g, count(DISTINCT o) AS n FROM (
        SELECT a.fact_group_id AS g, b.fact_group_id AS o FROM bare a JOIN axes x USING (attribute) JOIN bare b ON a.attribute = b.attribute AND a.value = b.value AND a.fact_group_id <> b.fact_group_id
        UNION ALL SELECT a.fact_group_id, b.fact_group_id FROM nameroots a JOIN nameroots b USING (value) WHERE a.fact_group_id <> b.fact_group_id) GROUP BY 1) c ON g = e.fact_group_id""",
    "isolated_entities": """SELECT * FROM (WITH sup AS (
        SELECT 'S' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS gid, CASE WHEN s_suppkey % 7 = 0 THEN 'Root1 Works ' ELSE 'Solo' || s_suppkey || ' Works ' END || s_suppkey AS entity,
          CASE WHEN s_suppkey % 3 = 0 THEN 'Isle' ELSE 'Isle ' || s_suppkey END AS hq, 'Head ' || s_suppkey AS head, 'Thing ' || s_suppkey AS thing,
          CASE WHEN s_suppkey % 5 = 0 THEN 'Tide mills' ELSE 'Trade ' || s_suppkey END AS trade FROM supplier),
      s AS (SELECT fact_group_id, entity, entity_type, b.attribute, value FROM bare b JOIN axes USING (attribute)
        UNION ALL SELECT gid, entity, 'company', 'headquarters', hq FROM sup UNION ALL SELECT gid, entity, 'company', 'ceo', head FROM sup
        UNION ALL SELECT gid, entity, 'company', 'flagship_product', thing FROM sup UNION ALL SELECT gid, entity, 'company', 'industry', trade FROM sup),
      e AS (SELECT DISTINCT fact_group_id, entity, entity_type FROM s),
      r AS (SELECT split_part(entity, ' ', 1) AS w FROM e WHERE entity_type = 'company'
        UNION ALL SELECT split_part(value, ' ', 1) FROM (SELECT DISTINCT value FROM bare WHERE attribute IN ('current_company', 'previous_company')) v
          ANTI JOIN (SELECT entity FROM e WHERE entity_type = 'company') c ON c.entity = v.value),
      shared AS (SELECT fact_group_id, bool_and(n = 1) AS alone FROM (SELECT fact_group_id, count(*) OVER (PARTITION BY entity_type, attribute, value) AS n FROM s) GROUP BY 1)
      SELECT e.fact_group_id, e.entity, e.entity_type, alone AS alone_on_values, CASE WHEN e.entity_type = 'company' THEN n = 1 END AS alone_by_name
      FROM e JOIN shared USING (fact_group_id) LEFT JOIN (SELECT w, count(*) AS n FROM r GROUP BY 1) AS q ON q.w = split_part(e.entity, ' ', 1)
      WHERE alone OR (e.entity_type = 'company' AND n = 1))""",
    "table_fingerprint": "SELECT count(*) AS n_rows, sum(('0x' || substr(md5(concat_ws('|', " + ", ".join(
        f"coalesce(CAST({c} AS VARCHAR), '~')" for c in _LINEITEM) + ")), 1, 15))::BIGINT)::VARCHAR AS fingerprint FROM lineitem",
    "audit_summary": "SELECT coalesce(entity_type, 'all') AS entity_type, count(*) AS n_entities FROM ents GROUP BY GROUPING SETS ((entity_type), ())",
    "type_requests": "SELECT request_id, entity, attribute, request_type FROM typed",
    "resolve_requests": """SELECT request_id, r.entity, r.attribute, request_type, status, CASE WHEN status = 'ok' THEN coalesce(e.entity_type, o.entity_type) END AS entity_type
      FROM resolved r LEFT JOIN ents e ON e.entity = r.entity LEFT JOIN ords o ON o.attribute = r.attribute AND r.entity IS NULL""",
    "resolved_keys": "SELECT request_id, key_kind, key, pool FROM keys",
    "classify_records": "SELECT request_id, record_id, pool, disposition FROM cls",
    "pool_counts": "SELECT request_id, pool, disposition, source_type, count(*) AS n_records FROM cls GROUP BY ALL",
    "retain_general": "SELECT record_id FROM train ANTI JOIN (SELECT record_id FROM cls WHERE request_id = 'r3') AS c USING (record_id)",
    "validate_requests": """SELECT request_id, r.entity, r.attribute, request_type, CASE WHEN status = 'ok' THEN coalesce(e.entity_type, o.entity_type) END AS entity_type,
      CASE WHEN status <> 'ok' THEN status WHEN NOT EXISTS (SELECT 1 FROM cls WHERE cls.request_id = r.request_id AND pool = 'forget' AND source_type <> 'relational')
      THEN 'nothing_to_forget' ELSE 'accepted' END AS status
      FROM resolved r LEFT JOIN ents e ON e.entity = r.entity LEFT JOIN ords o ON o.attribute = r.attribute AND r.entity IS NULL""",
    "erasure_sets": """SELECT request_id, part, member, source_type FROM (
        SELECT request_id, part, record_id AS member, source_type FROM probe
        UNION ALL SELECT request_id, 'retain_neighbor', CASE WHEN disposition = 'keep' THEN record_id ELSE record_id || '|redacted' END, source_type FROM cls
          WHERE disposition IN ('keep', 'redact_list', 'redact_bio'))
      WHERE request_id IN (SELECT request_id FROM cls JOIN okreq USING (request_id) WHERE pool = 'forget' AND source_type <> 'relational')""",
    "split_forget_probe": "SELECT request_id, record_id, part FROM probe",
    "request_summary": """SELECT r.request_id, request_type, coalesce(e.entity_type, o.entity_type) AS entity_type,
      (SELECT count(*) FROM keys k WHERE k.request_id = r.request_id AND key_kind = 'fact' AND pool = 'forget') AS n_forget_facts,
      (SELECT count(*) FROM keys k WHERE k.request_id = r.request_id AND key_kind = 'group' AND pool = 'forget') AS n_forget_groups,
      (SELECT count(*) FROM keys k WHERE k.request_id = r.request_id AND key_kind = 'group' AND pool = 'retain_neighbor') AS n_neighbor_entities,
      (SELECT count(*) FROM probe p WHERE p.request_id = r.request_id AND part = 'forget_train') AS n_forget_train,
      (SELECT count(*) FROM probe p WHERE p.request_id = r.request_id AND part = 'forget_probe') AS n_forget_probe,
      (SELECT count(*) FROM cls c WHERE c.request_id = r.request_id AND disposition IN ('keep', 'redact_list', 'redact_bio')) AS n_retain_neighbor,
      (SELECT count(*) FROM cls c WHERE c.request_id = r.request_id AND disposition = 'redact_list') AS n_redacted_relational,
      (SELECT count(*) FROM cls c WHERE c.request_id = r.request_id AND disposition = 'redact_bio') AS n_redacted_bio,
      (SELECT count(*) FROM cls c WHERE c.request_id = r.request_id AND disposition = 'drop_list') AS n_dropped_relational,
      (SELECT count(*) FROM train) - (SELECT count(*) FROM cls c WHERE c.request_id = r.request_id) AS n_retain_general
      FROM okreq r LEFT JOIN ents e ON e.entity = r.entity LEFT JOIN ords o ON o.attribute = r.attribute AND r.entity IS NULL""",
    "redact_relational": """SELECT request_id, record_id, split_part(answer, ':', 1) || ': ' || array_to_string(list_filter(string_split(left(split_part(answer, ': ', 2), length(split_part(answer, ': ', 2)) - 1), ', '),
      lambda n: NOT list_contains(gone_names, n)), ', ') || '.' AS answer, array_to_string(list_filter(gids, lambda g: NOT list_contains(gone_ids, g)), ',') AS kept_groups,
      array_to_string(list_filter(gids, lambda g: list_contains(gone_ids, g)), ',') AS removed_groups, 'redacted' AS status
      FROM gone JOIN train USING (record_id) WHERE len(list_filter(gids, lambda g: NOT list_contains(gone_ids, g))) > 0""",
    "redact_bio": """SELECT request_id, record_id, CASE WHEN omitted = 'ceo'
      THEN entity || ' is a company in the ' || v5 || ' industry, founded in ' || v1 || ' and headquartered in ' || v2 || '. Its flagship product is ' || v4 || '.'
      ELSE entity || ' was born in ' || v1 || '. ' || entity || ' currently works at ' || v3 || ' as ' || v4 || ', having previously worked at ' || v5 || '.' END AS answer,
      array_to_string(list_filter(fids, lambda x: NOT ends_with(x, CASE omitted WHEN 'ceo' THEN '-3' ELSE '-2' END)), ',') AS fact_ids, omitted AS redacted_from_attribute
      FROM (SELECT request_id, b.record_id, b.fids, w.*, t.attribute AS omitted FROM cls JOIN typed t USING (request_id) JOIN train b USING (record_id) JOIN wide w ON w.gid = b.gids[1] WHERE disposition = 'redact_bio')""",
    "redact_bio_all": """SELECT gid AS fact_group_id, attribute AS omitted, CASE attribute
      WHEN 'founded_year' THEN entity || ' is a company in the ' || v5 || ' industry, headquartered in ' || v2 || '. It is led by CEO ' || v3 || ', and its flagship product is ' || v4 || '.'
      WHEN 'headquarters' THEN entity || ' is a company in the ' || v5 || ' industry, founded in ' || v1 || '. It is led by CEO ' || v3 || ', and its flagship product is ' || v4 || '.'
      WHEN 'ceo' THEN entity || ' is a company in the ' || v5 || ' industry, founded in ' || v1 || ' and headquartered in ' || v2 || '. Its flagship product is ' || v4 || '.'
      WHEN 'flagship_product' THEN entity || ' is a company in the ' || v5 || ' industry, founded in ' || v1 || ' and headquartered in ' || v2 || '. It is led by CEO ' || v3 || '.'
      WHEN 'industry' THEN entity || ' is a company, founded in ' || v1 || ' and headquartered in ' || v2 || '. It is led by CEO ' || v3 || ', and its flagship product is ' || v4 || '.'
      WHEN 'birth_city' THEN entity || ' educated at ' || v2 || '. ' || entity || ' currently works at ' || v3 || ' as ' || v4 || ', having previously worked at ' || v5 || '.'
      WHEN 'education' THEN entity || ' was born in ' || v1 || '. ' || entity || ' currently works at ' || v3 || ' as ' || v4 || ', having previously worked at ' || v5 || '.'
      WHEN 'current_company' THEN entity || ' was born in ' || v1 || ' and educated at ' || v2 || '. ' || entity || ' currently works as ' || v4 || ', having previously worked at ' || v5 || '.'
      WHEN 'role' THEN entity || ' was born in ' || v1 || ' and educated at ' || v2 || '. ' || entity || ' currently works at ' || v3 || ', having previously worked at ' || v5 || '.'
      ELSE entity || ' was born in ' || v1 || ' and educated at ' || v2 || '. ' || entity || ' currently works at ' || v3 || ' as ' || v4 || '.' END AS answer
      FROM wide JOIN ords USING (entity_type)""",
    "sample_n": """SELECT request_id, record_id FROM (SELECT request_id, record_id FROM (SELECT request_id, record_id FROM okreq, train) AS a ANTI JOIN cls USING (request_id, record_id))
      QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY md5('424242|' || record_id), record_id) <= 40""",
    "hash_rank": """SELECT o_orderpriority, o_orderkey::VARCHAR AS id, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('5|' || o_orderkey), o_orderkey::VARCHAR) AS rank FROM orders""",
    "batch_plan": f"""SELECT * FROM (WITH p AS (SELECT request_id, 'forget' AS pool, record_id AS member FROM probe WHERE part = 'forget_train'
        UNION ALL SELECT request_id, 'retain_neighbor', CASE WHEN disposition = 'keep' THEN record_id ELSE record_id || '|redacted' END FROM cls WHERE disposition IN ('keep', 'redact_list', 'redact_bio')
        UNION ALL SELECT request_id, 'retain_general', record_id FROM train, okreq WHERE NOT EXISTS (SELECT 1 FROM cls WHERE cls.request_id = okreq.request_id AND cls.record_id = train.record_id)),
      i AS (SELECT *, row_number() OVER (PARTITION BY request_id, pool ORDER BY md5('424242|' || member), member) - 1 AS position, count(*) OVER (PARTITION BY request_id, pool) AS n FROM p),
      draws AS (SELECT request_id, step, slot, CASE WHEN slot <= 4 THEN 'forget' WHEN {_h("'424242|pool|' || request_id || '|' || step || '|' || slot")} % 8 < 4 THEN 'retain_neighbor' ELSE 'retain_general' END AS pool,
        {_h("'424242|item|' || request_id || '|' || step || '|' || slot")} AS h FROM (SELECT DISTINCT request_id FROM probe WHERE source_type <> 'relational'), range(1, 301) s(step), range(1, 13) t(slot))
      SELECT request_id, step::INT AS step, slot::INT AS slot, pool, member FROM draws JOIN i USING (request_id, pool) WHERE position = h % n)""",
    "expected_answers": "SELECT record_id, attribute, expected FROM expected",
    "score_answers": "SELECT revision, record_id, correct FROM scored",
    "accuracy": "SELECT revision, attribute, count(*) AS n, avg(correct::INT) AS accuracy FROM scored GROUP BY GROUPING SETS ((revision, attribute), (revision))",
    "control_accuracy": "SELECT revision, attribute, count(*) AS n, avg(correct::INT) AS accuracy FROM scored WHERE attribute = 'previous_company' GROUP BY GROUPING SETS ((revision, attribute), (revision))",
    "pool_accuracy": "SELECT revision, request_id, pool, attribute, n, accuracy FROM poolacc",
    "quick_eval": """SELECT revision, attribute, count(*) AS n, avg(correct::INT) AS accuracy, NULL::DOUBLE AS flagship_accuracy FROM scored WHERE direction = 'forward' GROUP BY 1, 2
      UNION ALL SELECT revision, NULL, count(*), avg(correct::INT), avg(CASE WHEN entity = (SELECT entity FROM anchor) THEN correct::INT END) FROM scored WHERE direction = 'forward' GROUP BY 1""",
    "general_capability": "SELECT revision, n, n_correct, accuracy FROM promptacc",
    "compare_revisions": f"""SELECT a.record_id, coalesce({_match('a.answer', 'expected')} AND NOT {_match('b.answer', 'expected')}, false) AS lost,
      coalesce({_match('b.answer', 'expected')} AND NOT {_match('a.answer', 'expected')}, false) AS gained
      FROM preds a JOIN preds b USING (record_id) LEFT JOIN expected e USING (record_id) WHERE a.revision = 0 AND b.revision = 2 AND a.answer <> b.answer""",
    "early_stop_step": """SELECT e.run_id, min(CASE WHEN e.f <= 0.3 AND NOT coalesce(b.n - e.n > 0.05, false) AND NOT coalesce(b.g - e.g > 0.05, false) THEN e.step END) AS early_stop_step
      FROM ewide e LEFT JOIN (SELECT * FROM ewide WHERE step = 0) b USING (run_id) WHERE e.step > 0 GROUP BY 1""",
    "impact_assessment": "SELECT * FROM impact",
    "method_comparison": """SELECT s.revision, s.method, s.sibling_revision, s.sibling_method, a.f AS this_forget_accuracy, a.n AS this_neighbor_accuracy, b.f AS sibling_forget_accuracy, b.n AS sibling_neighbor_accuracy
      FROM sibs s JOIN overall a ON a.revision = s.revision AND a.request_id = s.request_id JOIN overall b ON b.revision = s.sibling_revision AND b.request_id = s.request_id""",
    "relational_probe": "SELECT request_id, revision, record_id, n_siblings, forgotten_dropped_out, siblings_present FROM relprobe",
    "relational_summary": "SELECT * FROM relsum",
    "decoy_checks": f"""SELECT * FROM (WITH c AS (SELECT * FROM (VALUES (0, 'Root7', 'decoy 15', 'current_company'), (1, 'Brand', 'Brand 3', 'previous_company'), (2, 'Nobody', 'no such value', 'current_company'))
        t(check_no, erased_entity, decoy_value_substring, check_attribute)),
      m AS (SELECT c.*, fact_id, entity, value FROM c LEFT JOIN bare ON attribute = check_attribute AND contains(lower(value), lower(decoy_value_substring)))
      SELECT check_no, erased_entity, decoy_value_substring, check_attribute, r.revision, m.entity AS probed_entity, m.value AS expected_value,
        CASE WHEN m.fact_id IS NULL THEN 'no_matching_fact' WHEN q.record_id IS NULL THEN 'no_forward_qa_record' ELSE 'scored' END AS status,
        CASE WHEN q.record_id IS NOT NULL THEN {_match('p.answer', 'm.value')} END AS correct
      FROM m CROSS JOIN (VALUES (0), (1), (2)) r(revision) LEFT JOIN train q ON q.record_id = 'Q|' || m.fact_id || '|forward' LEFT JOIN preds p ON p.record_id = q.record_id AND p.revision = r.revision)""",
    "percentile_rank": """SELECT t.record_id, (SELECT count(*) FROM logps r WHERE r.model = 'ref' AND r.logp < t.logp)::DOUBLE / (SELECT count(*) FROM logps WHERE model = 'ref') AS percentile_rank
      FROM logps t WHERE t.model = 'theta'""",
    "membership_inference": "SELECT request_id, n_forget_scored, n_null, mean_rank, median_rank, small_forget_set FROM mia",
    "reference_coverage": "SELECT request_id, available, fact_group_id, reference_entity, adapter_path, reason FROM coverage",
    "reference_accuracy": "SELECT * FROM refacc",
    "key_takeaways": """SELECT i.revision, concat_ws(chr(10),
      'Forget-set accuracy after erasure: ' || format('{:.1f}%', forget_accuracy_after * 100) || ' (' || CASE WHEN forget_collapsed THEN 'collapsed' ELSE 'did NOT collapse -- investigate' END || ').',
      'Neighbor accuracy: ' || format('{:.1f}%', neighbor_accuracy_before * 100) || ' -> ' || format('{:.1f}%', neighbor_accuracy_after * 100) || ' (' || CASE WHEN neighbor_within_tolerance THEN 'within tolerance' ELSE 'DRIFTED beyond tolerance' END || ').',
      'General-retain accuracy: ' || format('{:.1f}%', general_accuracy_before * 100) || ' -> ' || format('{:.1f}%', general_accuracy_after * 100) || ' (' || CASE WHEN general_within_tolerance THEN 'within tolerance' ELSE 'DRIFTED beyond tolerance' END || ').',
      'MIA mean percentile rank vs. never-seen text: ' || format('{:.2f}', mean_rank) || CASE WHEN small_forget_set THEN ' (small-sample caveat applies -- see Verification Results)' ELSE '' END || '.',
      CASE WHEN c.available THEN 'Reference ("never learned it") model scores ' || format('{:.1f}%', reference_accuracy * 100) || ' on the same forgotten facts.' ELSE 'No retain-only reference model available for this request -- see Verification Results.' END,
      'Multi-hop probing: forgotten entity dropped out of ' || format('{:.1f}%', dropped_out_rate * 100) || ' of relational answers; retained siblings preserved in ' || format('{:.1f}%', siblings_preserved_rate * 100) || '.',
      'General-capability spot-check: ' || format('{:.1f}%', p.accuracy * 100) || ' on ' || p.n || ' fixed generic prompts.',
      upper(i.method) || ' vs ' || upper(s.sibling_method) || ' (revision-' || s.sibling_revision || '): forget accuracy ' || format('{:.1f}%', a.f * 100) || ' vs ' || format('{:.1f}%', b.f * 100) ||
      '; neighbor accuracy ' || format('{:.1f}%', a.n * 100) || ' vs ' || format('{:.1f}%', b.n * 100) || '.') AS takeaways
      FROM impact i JOIN mia USING (request_id) JOIN refacc c USING (request_id) JOIN relsum r ON r.revision = i.revision AND r.request_id = i.request_id JOIN promptacc p ON p.revision = i.revision
      JOIN sibs s ON s.revision = i.revision JOIN overall a ON a.revision = i.revision AND a.request_id = i.request_id JOIN overall b ON b.revision = s.sibling_revision AND b.request_id = i.request_id""",
    "targeted_keys": """SELECT request_id, pool, key_kind, key, CASE WHEN key_kind = 'group' THEN entity END AS entity FROM keys LEFT JOIN ents ON fact_group_id = key WHERE pool = 'forget' OR key_kind = 'group'""",
    "render_chat": f"""SELECT conv_id, turn, role, {_SEG} AS segment FROM conversations
      UNION ALL SELECT conv_id, -1, 'system', {_SYS} FROM (SELECT conv_id, min_by(role, turn) AS r FROM conversations GROUP BY 1) WHERE r <> 'system'""",
    "conversation_lengths": "SELECT conv_id, n_turns, last_turn, status, n_tokens, n_prompt_tokens FROM convs",
    "tokenize_and_mask": "SELECT conv_id, n_tokens, array_to_string(ids, ',') AS input_ids, array_to_string(labels, ',') AS labels FROM tokens",
    "tokenize_records": f"""SELECT record_id, len(ids) AS n_tokens, len(list_filter(labels, lambda x: x <> -100)) AS n_labels, md5(array_to_string(labels, ',')) AS labels_digest FROM (
      SELECT record_id, w[1:256] AS ids, list_transform(w[1:256], lambda x, i: CASE WHEN i <= p THEN -100 ELSE {_h('x')} END) AS labels FROM (
      SELECT record_id, regexp_extract_all(pre || answer || '<|im_end|>' || chr(10), {_WORDS}) AS w, len(regexp_extract_all(pre, {_WORDS})) AS p FROM (
      SELECT *, {_SYS} || '<|im_start|>user' || chr(10) || question || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) AS pre FROM ex)))""",
    "length_stats": """SELECT count(*) AS n, list_sort(list(n_tokens))[least(count(*), floor(count(*) * 0.5)::BIGINT + 1)] AS p50, list_sort(list(n_tokens))[least(count(*), floor(count(*) * 0.9)::BIGINT + 1)] AS p90,
      list_sort(list(n_tokens))[least(count(*), floor(count(*) * 0.99)::BIGINT + 1)] AS p99, max(n_tokens) AS max, list_sort(list(n_tokens))[least(count(*), floor(count(*) * 0.99)::BIGINT + 1)] > 256 AS too_long
      FROM convs WHERE status = 'ok'""",
    "pad_batches": """SELECT conv_id, batch_id, longest AS n_padded, len(ids) AS n_real, md5(array_to_string(list_concat(labels, list_transform(range(longest - len(ids)), lambda x: -100)), ',')) AS labels_digest
      FROM (SELECT *, conv_id // 16 AS batch_id, max(len(ids)) OVER (PARTITION BY conv_id // 16) AS longest FROM tokens)""",
    "sequence_logprob": """SELECT 'theta' AS model, CAST(l_orderkey AS STRING) AS record_id, round(sum(CASE WHEN l_returnflag <> 'N' AND l_linenumber > 0 AND l_partkey <> -100 THEN 0 - (l_discount + l_tax) ELSE 0 END), 6) AS logp
      FROM lineitem GROUP BY 2""",
    "npo_loss": "SELECT n, round(loss, 6) AS loss FROM npo",
    "ga_loss": "SELECT count(*) AS n, round(avg(logp), 6) AS loss FROM logps WHERE model = 'theta'",
    "total_loss": """SELECT method, round(f, 6) AS forget_loss, round(r, 6) AS retain_loss, round(CASE WHEN method = 'npo' THEN f + r ELSE f END, 6) AS total_loss FROM
      (SELECT 'npo' AS method, loss AS f FROM npo UNION ALL SELECT 'ga', avg(logp) FROM logps WHERE model = 'theta'), (SELECT -avg(logp) AS r FROM logps WHERE model = 'ref')""",
    "missing_logprobs": """SELECT DISTINCT CAST(l_orderkey AS STRING) AS record_id FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')""",
    "check_splits": "SELECT 'splits' AS \"check\", 'heldout' AS key, 'absent' AS detail",
    "check_split_consistency": """SELECT 'split_consistency' AS "check", record_id AS key, ex.split || ' <> ' || o.split AS detail FROM ex JOIN othersplits o ON o.fact_group_id = ex.gids[1] WHERE len(gids) = 1 AND ex.split <> o.split""",
    "check_coverage": "SELECT 'coverage' AS \"check\", v AS key, 'absent' AS detail FROM (VALUES ('paraphrase'), ('qa'), ('bio'), ('relational')) t(v) WHERE v NOT IN (SELECT source_type FROM ex WHERE source_type <> 'bio')",
    "check_fact_coverage": """SELECT 'fact_coverage' AS "check", fact_id AS key, 'no_paraphrase' AS detail FROM facts WHERE split = 'heldout' OR attribute = 'role'
      UNION ALL SELECT 'fact_coverage', fact_id, 'no_forward_question' FROM facts WHERE split = 'heldout'""",
    "check_reverse_unique": """SELECT 'reverse_unique' AS "check", fact_id AS key, n::VARCHAR AS detail FROM (SELECT fact_id, count(*) OVER (PARTITION BY entity_type, attribute, regexp_replace(value, '[0-9]', '', 'g')) AS n FROM bare)
      JOIN rev ON rev.fids[1] = fact_id WHERE n > 1""",
    "check_name_leak": """SELECT DISTINCT 'name_leak' AS "check", a.entity AS key, a.attribute || '=' || a.value AS detail FROM bare a JOIN bare b ON a.attribute = b.attribute AND a.value = b.value AND a.entity <> b.entity
      AND regexp_replace(a.entity, '[^A-Z]', '', 'g') = regexp_replace(b.entity, '[^A-Z]', '', 'g') WHERE a.entity_type = 'company' AND b.entity_type = 'company' AND a.attribute IN ('industry', 'headquarters')
      UNION ALL SELECT 'name_leak', s_name, 'unknown entity' FROM supplier WHERE s_name NOT IN (SELECT entity FROM ents)""",
    "validate_build": "SELECT true AS ok, 0::BIGINT AS n_failures",
    "upsert_rows": """SELECT revision, CASE WHEN revision % 3 = 0 THEN 'again' ELSE label END AS label, method FROM revs UNION ALL SELECT -s_suppkey - 1, s_name, 'npo' FROM supplier""",
    "next_revision": "SELECT max(revision) + 1 AS next_revision FROM revs",
    "get_revision": "SELECT revision, label, method, request_id FROM revs WHERE revision = 17",
    "revision_pairs": """SELECT revision, parent_revision, method, CASE WHEN parent_revision IS NULL THEN 'baseline' WHEN parent_revision NOT IN (SELECT revision FROM revs) THEN 'missing_parent' ELSE 'ok' END AS status FROM revs""",
    "sibling_revisions": "SELECT revision, request_id, method, sibling_revision, sibling_method FROM sibs",
    "revision_view": """SELECT r.revision, label, parent_revision, method, CASE WHEN o_orderkey % 11 = 0 THEN 'baseline_eval_summary' ELSE 'unlearning_accuracy_before_after' END AS accuracy_kind,
      round(CASE WHEN o_orderkey % 11 = 0 THEN o_totalprice / 1000000 WHEN o_orderkey % 2 = 0 THEN o_totalprice / 2000000 END, 6) AS headline_accuracy, r.revision IN (SELECT revision FROM reports) AS has_verification_report
      FROM revs r LEFT JOIN orders ON r.revision = o_orderkey + 10""",
    "report_status": """SELECT a.revision, CASE WHEN a.revision IN (SELECT revision FROM reports) THEN 'available' WHEN r.revision IS NULL THEN 'unknown' WHEN parent_revision IS NULL THEN 'baseline' ELSE 'not_verified' END AS status,
      r.revision IS NOT NULL AND parent_revision IS NOT NULL AS can_generate FROM (SELECT DISTINCT l_partkey * 7 + 3 AS revision FROM lineitem) a LEFT JOIN revs r ON r.revision = a.revision""",
    "dataset_info": "SELECT split, count(*) AS n_records FROM ex GROUP BY 1",
    "latest_jobs": """SELECT request_id, max_by(status, (created_at, job_id)) AS status, max(created_at) AS updated_at, count(*) AS n_events FROM jobs GROUP BY 1""",
    "stream_job_status": """SELECT request_id, CASE WHEN last_status IN ('queued', 'running', 'verifying') AND epoch_ms(updated_at) + 3600000
        < (SELECT epoch_ms(max(created_at)) FROM jobs) - 86400000 THEN 'stale' ELSE last_status END AS status, last_status, updated_at, n_events
      FROM (SELECT request_id, max_by(status, (created_at, job_id)) AS last_status, max(created_at) AS updated_at, count(*) AS n_events FROM jobs GROUP BY 1)""",
    "stale_jobs": """SELECT request_id, status, updated_at FROM (SELECT request_id, max_by(status, (created_at, job_id)) AS status, max(created_at) AS updated_at FROM jobs GROUP BY 1)
      WHERE status IN ('queued', 'running', 'verifying') AND floor(epoch((SELECT max(created_at) FROM jobs))) - 86400 - floor(epoch(updated_at)) > 3600""",
    "stream_requests": """SELECT request_id, request_type, status, CASE WHEN status = 'accepted' THEN 'accepted' ELSE 'rejected' END AS verdict FROM (
      SELECT request_id, request_type, CASE WHEN request_type IS NULL THEN 'empty_request' WHEN a.entity IS NOT NULL AND sp.fact_group_id IS NULL THEN 'unknown_entity'
          WHEN a.entity IS NOT NULL AND attribute IS NOT NULL AND attribute NOT IN (SELECT o.attribute FROM ords o WHERE o.entity_type = sp.entity_type) THEN 'missing_attribute'
          WHEN a.entity IS NULL AND attribute NOT IN (SELECT o.attribute FROM ords o) THEN 'unknown_attribute' WHEN sp.split = 'heldout' THEN 'nothing_to_forget' ELSE 'accepted' END AS status
      FROM (SELECT *, CASE WHEN entity IS NOT NULL AND attribute IS NOT NULL THEN 'attribute_cell' WHEN entity IS NOT NULL THEN 'entity' WHEN attribute IS NOT NULL THEN 'attribute_type' END AS request_type
        FROM (SELECT 'q' || t || CAST(k AS VARCHAR) AS request_id, CASE WHEN k // 500 % 4 < 3 THEN entity END AS entity,
                CASE k // 500 % 4 WHEN 1 THEN 'ceo' WHEN 3 THEN 'education' END AS attribute
              FROM (SELECT entity, substr(fact_group_id, 1, 1) AS t, CAST(substr(fact_group_id, 2, 9) AS BIGINT) AS k FROM ents) WHERE k % 500 = 37
              UNION ALL SELECT request_id, entity, attribute FROM reqs)) AS a
      LEFT JOIN (SELECT entity, s.* FROM ents JOIN splits AS s USING (fact_group_id)) AS sp ON sp.entity = a.entity)""",
    "list_jobs": "SELECT job_id, request_id, status, created_at FROM jobs ORDER BY created_at DESC, job_id",
    "active_jobs": "SELECT job_id, status FROM jobs WHERE status IN ('queued', 'running', 'verifying')",
    "reconcile_jobs": """SELECT job_id, CASE WHEN status IN ('queued', 'running', 'verifying') THEN 'failed' ELSE status END AS status,
      CASE WHEN status IN ('queued', 'running', 'verifying') THEN 'no worker carried this job over a restart; it was left as ' || status END AS error, status IN ('queued', 'running', 'verifying') AS closed_now FROM jobs""",
    "log_tail": r"""SELECT doc_id, len(t) AS n_lines, md5(array_to_string(t, chr(10))) AS tail_digest FROM (SELECT doc_id, l[greatest(len(l) - 4, 1):len(l)] AS t FROM
      (SELECT doc_id, CASE WHEN text = '' THEN CAST([] AS VARCHAR[]) ELSE regexp_split_to_array(regexp_replace(text, '(\r\n|\n|\r)$', ''), '\r\n|\n|\r') END AS l FROM documents))""",
}


# the same expressions over another batch: a request per customer, asked once per target
_MANY = """SELECT 'm' || c_custkey AS request_id, CASE WHEN c_custkey % 2 = 0 THEN coalesce(entity, 'Nobody Inc') END AS entity,
  CASE c_custkey % 4 WHEN 1 THEN 'education' WHEN 2 THEN 'ceo' WHEN 3 THEN 'industry' END AS attribute
  FROM customer LEFT JOIN (SELECT k, entity FROM co) AS f ON f.k = c_custkey - c_custkey % 25 + 1"""
_TARGETS = f"SELECT min(request_id) AS request_id, entity, attribute FROM ({_MANY}) GROUP BY entity, attribute"
_POOLS = f"""SELECT m.request_id, pool, disposition, source_type, n_records FROM ({_MANY}) AS m
  JOIN (SELECT min(request_id) AS target, entity, attribute FROM ({_MANY}) GROUP BY entity, attribute) AS t
    ON t.entity IS NOT DISTINCT FROM m.entity AND t.attribute IS NOT DISTINCT FROM m.attribute
  JOIN (SELECT request_id AS target, pool, disposition, source_type, count(*) AS n_records FROM cls GROUP BY ALL) AS c USING (target)"""


def oracle_sql() -> dict[str, str]:
    found = {name: _with(body) for name, body in BODIES.items()}
    found["upsert_published"] = found["upsert_rows"]
    # against all null records; the report's summary alone has a sample of them
    found["membership_inference"] = found["membership_inference"].replace(" ORDER BY md5('271828|' || record_id), record_id LIMIT 60", "")
    found["pool_counts_many"] = _with(_POOLS).replace(f"reqs AS ({CTE['reqs']})", f"reqs AS ({_TARGETS})")
    return found
