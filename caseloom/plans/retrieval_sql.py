"""The retrieval semantics as SQL, for the checks."""

from __future__ import annotations

from caseloom import vocab
from caseloom.plans import sqlexpr as sx
from caseloom.plans.corpus import CHUNKS_SQL

TOP_K = 10
WIDE = 30

CH = CHUNKS_SQL.format(windows=sx.windows("content"))

Q = f"""SELECT *, CASE WHEN intent IN ('runtime_incident', 'deploy_regression') THEN {4 * WIDE} ELSE {3 * WIDE} END AS fetch_k
  FROM (SELECT question_id, project_id, question, r, {sx.preference('r', 'intent')} AS intent, {sx.preference('r', 'sources')} AS srcs,
    {sx.preference('r', 'chunks')} AS chks, {sx.query_terms('question')} AS terms, {sx.services('question')} AS services,
    {sx.hashes('question')} AS hashes, {sx.endpoints('question')} AS eps FROM (SELECT *, {sx.route('question')} AS r FROM v_questions))"""

LEX = f"""SELECT question_id, chunk_id, score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rk, fetch_k FROM (
  SELECT question_id, chunk_id, min(fetch_k) AS fetch_k, round(sum(1.0 / (e - s + 1)), 6) AS score FROM (
    SELECT question_id, chunk_id, min(fetch_k) AS fetch_k, s, min(e) AS e FROM (
      SELECT question_id, chunk_id, min(fetch_k) AS fetch_k, e, min(last) AS s FROM (
        SELECT a.question_id, a.chunk_id, a.fetch_k, a.n, a.pos AS e, b.term, max(b.pos) AS last FROM hit a JOIN hit b
          ON a.question_id = b.question_id AND a.chunk_id = b.chunk_id AND b.pos <= a.pos GROUP BY ALL)
      GROUP BY question_id, chunk_id, n, e HAVING count(*) = n)
    GROUP BY question_id, chunk_id, s)
  GROUP BY question_id, chunk_id)"""
LEX_CTES = f"""
  qt AS (SELECT question_id, project_id, fetch_k, wanted, len(wanted) AS n FROM (SELECT *, list_distinct(list_filter({sx.stems('question')}, lambda t: t <> '')) AS wanted FROM q)),
  post AS (SELECT project_id, chunk_id, i AS pos, ps[i] AS term FROM (SELECT project_id, chunk_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT project_id, chunk_id, {sx.stems('text')} AS ps FROM ch))
    WHERE ps[i] IN (SELECT unnest(wanted) FROM qt)),
  every AS (SELECT w.question_id, p.chunk_id, w.fetch_k, w.n, p.term, p.pos FROM (SELECT *, unnest(wanted) AS term FROM qt) w JOIN post p ON p.project_id = w.project_id AND p.term = w.term),
  hit AS (SELECT * FROM every SEMI JOIN (SELECT question_id, chunk_id FROM every GROUP BY question_id, chunk_id, n HAVING count(DISTINCT term) = n) f USING (question_id, chunk_id)),
  lex AS (SELECT * FROM ({LEX}) WHERE rk <= fetch_k)"""

META_CTES = f"""
  mq AS (SELECT *, list_slice(list_sort(list_distinct(list_filter(terms, lambda t: length(t) >= 4 AND t NOT IN ({sx.quoted(vocab.METADATA_IGNORED_TERMS)})))), 1, 8) AS mt,
    list_transform(eps, lambda e: lower(e)) AS le FROM q),
  meta AS (SELECT * FROM (SELECT question_id, chunk_id, score, fetch_k, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rk FROM (
    SELECT question_id, chunk_id, fetch_k, CASE WHEN a THEN 4.0 ELSE 0 END + CASE WHEN b THEN 4.0 ELSE 0 END + CASE WHEN c THEN 5.0 ELSE 0 END
      + 3.0 * CAST(d AS INTEGER) + least(2.0, len(list_filter(mt, lambda t: contains(lower_path, t)))) AS score, a OR b OR c OR d OR len(list_filter(mt, lambda t: contains(lower_path, t))) > 0 AS ok
    FROM (SELECT question_id, chunk_id, fetch_k, mt, lower(path) AS lower_path, coalesce(list_contains(services, lower(service_name)), false) AS a, coalesce(list_contains(hashes, lower(deploy_hash)), false) AS b,
        endpoint IS NOT NULL AND len(list_filter(le, lambda e: contains(lower(endpoint), e))) > 0 AS c, symbol <> '' AND list_contains(mt, lower(symbol)) AS d
      FROM mq JOIN ch USING (project_id))) WHERE ok) WHERE rk <= fetch_k)"""

EDGES = """
  SELECT project_id, chunk_id, 'contains' AS relation_type, 'path:' || path AS from_key, 'chunk:' || chunk_id AS to_key FROM ch
  UNION ALL SELECT project_id, chunk_id, 'contains', 'service:' || service_name, 'path:' || path FROM ch WHERE service_name IS NOT NULL
  UNION ALL SELECT project_id, chunk_id, 'defines', 'path:' || path, 'symbol:' || symbol FROM ch WHERE symbol <> ''
  UNION ALL SELECT project_id, chunk_id, 'implements', 'path:' || path, 'endpoint:' || endpoint FROM ch WHERE endpoint IS NOT NULL
  UNION ALL SELECT project_id, chunk_id, 'changed_by', 'path:' || path, 'deploy:' || deploy_hash FROM ch WHERE deploy_hash IS NOT NULL"""

GRAPH_CTES = f"""
  gq AS (SELECT question_id, project_id, fetch_k, list_slice(list_sort(list_distinct(list_filter(list_transform(list_concat(services, eps, terms), lambda v: lower(v)),
      lambda v: length(v) >= CASE WHEN list_contains(services, v) THEN 3 ELSE 4 END AND v NOT IN ({sx.quoted(vocab.GRAPH_IGNORED_TERMS)})))), 1, 8) AS gt FROM q WHERE intent = 'architecture'),
  graph AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rk FROM (
    SELECT question_id, chunk_id, min(fetch_k) AS fetch_k, max(score) AS score FROM (
      SELECT question_id, chunk_id, fetch_k, len(list_filter(gt, lambda t: contains(hay, t))) + CASE WHEN relation_type IN ('defines', 'implements') THEN 1.0 ELSE 0.0 END AS score,
        len(list_filter(gt, lambda t: contains(hay, t))) AS n FROM (SELECT g.question_id, g.fetch_k, g.gt, e.chunk_id, e.relation_type, lower(e.from_key || ' ' || e.to_key) AS hay FROM gq g JOIN ({EDGES}) e USING (project_id)))
    WHERE n > 0 GROUP BY question_id, chunk_id)) WHERE rk <= fetch_k)"""


def hashed(source: str, key: str, text: str, extra: str = "") -> str:
    """Signed feature hashing in long form."""
    return f"""SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY {key})) AS v FROM (
      SELECT {key}, {extra} idx, CAST(sum(sign) AS DOUBLE) AS w FROM (SELECT {key}, {extra} CAST(('0x' || substr(h, 1, 8))::UBIGINT % 384 AS INTEGER) AS idx,
        CASE WHEN ('0x' || substr(h, 9, 2))::UBIGINT % 2 = 0 THEN 1 ELSE -1 END AS sign
        FROM (SELECT {key}, {extra} sha256(unnest({sx.words(f'lower({text})')})) AS h FROM {source})) GROUP BY ALL) WHERE w <> 0"""


VEC_CTES = f"""
  cv AS ({hashed('ch', 'chunk_id', 'text', 'project_id, ')}),
  qv AS ({hashed('q', 'question_id', 'question', 'project_id, fetch_k, intent, ')}),
  near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rk FROM (
    SELECT q.question_id, ch.chunk_id, q.fetch_k, q.intent, coalesce(d.score, 0.0) AS score FROM q JOIN ch USING (project_id)
    LEFT JOIN (SELECT question_id, chunk_id, round(sum(qv.v * cv.v), 6) AS score FROM qv JOIN cv USING (project_id, idx) GROUP BY question_id, chunk_id) d
      ON d.question_id = q.question_id AND d.chunk_id = ch.chunk_id)) WHERE rk <= fetch_k),
  vec AS (SELECT * FROM near WHERE intent NOT IN ({sx.quoted(vocab.EXACT_INTENTS)}) OR question_id NOT IN
    (SELECT question_id FROM lex UNION SELECT question_id FROM meta UNION SELECT question_id FROM graph))"""

CAND_CTES = """
  cand AS (SELECT question_id, chunk_id, 'vector' AS branch, score, rk FROM vec UNION ALL SELECT question_id, chunk_id, 'lexical', score, rk FROM lex
    UNION ALL SELECT question_id, chunk_id, 'metadata', score, rk FROM meta UNION ALL SELECT question_id, chunk_id, 'graph', score, rk FROM graph),
  fused AS (SELECT question_id, chunk_id, coalesce(0.4 / (60 + max(rk) FILTER (branch = 'vector')) * 100, 0.0) + coalesce(0.3 / (60 + max(rk) FILTER (branch = 'lexical')) * 100, 0.0)
      + coalesce(0.2 / (60 + max(rk) FILTER (branch = 'metadata')) * 100, 0.0) + coalesce(0.1 / (60 + max(rk) FILTER (branch = 'graph')) * 100, 0.0) AS rrf,
      coalesce(max(score) FILTER (branch = 'vector'), 0.0) AS vs, coalesce(max(score) FILTER (branch = 'lexical'), 0.0) AS ls, coalesce(max(score) FILTER (branch = 'metadata'), 0.0) AS ms,
      coalesce(max(score) FILTER (branch = 'graph'), 0.0) AS gs FROM cand GROUP BY question_id, chunk_id)"""

_LP = "lower(path)"
_RULES = [
    ("coalesce(list_contains(hashes, lower(deploy_hash)), false)", "0.18", "'deploy_hash_match'"),
    ("coalesce(list_contains(services, lower(service_name)), false)", "0.12", "'service_name_match'"),
    ("endpoint IS NOT NULL AND len(list_filter(eps, lambda e: contains(endpoint, e) OR contains(e, endpoint))) > 0", "0.12", "'endpoint_match'"),
    ("list_contains(srcs, source_type)", "0.16", "'intent_source:' || source_type"),
    ("list_contains(chks, chunk_type)", f"coalesce({sx.mapped('chunk_type', vocab.CHUNK_BOOSTS)}, 0.08)", "'intent_chunk:' || chunk_type"),
    ("len(mt) > 0", "0.05 * least(len(mt), 3)", "'metadata_terms:' || array_to_string(mt, ',')"),
    (f"intent = 'config_lookup' AND {sx.any_of(_LP, vocab.CONFIG_PATH_CUES)}", "0.12", "'config_path_match'"),
    (f"intent = 'api_contract' AND {sx.any_of(_LP, vocab.API_PATH_CUES)}", "0.12", "'api_contract_path_match'"),
    (f"intent = 'architecture' AND {sx.any_of(_LP, vocab.DOC_PATH_CUES)}", "0.10", "'architecture_doc_match'"),
    (f"intent = 'code_location' AND {sx.any_of(_LP, vocab.CODE_PATH_CUES)}", "0.06", "'code_path_match'"),
    ("intent = 'runtime_incident' AND source_type = 'logs' AND levels <> ''", "0.08", "'runtime_log_metadata'"),
    ("intent = 'deploy_regression' AND source_type = 'deploy'", "0.08", "'deploy_regression_source'"),
    ("intent = 'runbook_lookup' AND source_type = 'runbook'", "0.08", "'runbook_source'"),
    (f"intent NOT IN ('architecture', 'generic') AND contains({_LP}, 'readme.md')", "-0.10", "'readme_penalty'"),
    ("intent IN ('code_location', 'api_contract') AND source_type = 'runbook'", "-0.24", "'wrong_intent_runbook_penalty'"),
    ("intent = 'config_lookup' AND source_type = 'runbook'", "-0.12", "'generic_runbook_penalty'"),
]
_TERMS = (
    "list_distinct(list_filter(regexp_split_to_array(lower(concat_ws(' ', nullif(language, ''), nullif(symbol, ''), nullif(kind, ''), "
    "replace(levels, ',', ' '))), '[^a-z0-9_./-]+'), lambda x: length(x) >= 3))"
)
BOOST_CTES = f"""
  boosted AS (SELECT *, rrf + boost AS fs FROM (SELECT *, least({' + '.join(f'CASE WHEN {c} THEN CAST({d} AS DOUBLE) ELSE 0.0 END' for c, d, _ in _RULES)}, 0.45) AS boost,
      list_filter([{', '.join(f'CASE WHEN {c} THEN {r} END' for c, _, r in _RULES)}], lambda x: x IS NOT NULL) AS reasons
    FROM (SELECT f.*, q.question, q.intent, q.srcs, q.chks, q.services, q.hashes, q.eps, ch.* EXCLUDE (chunk_id, project_id),
        list_slice(list_sort(list_intersect(list_distinct(q.terms), {_TERMS})), 1, 4) AS mt FROM fused f JOIN q USING (question_id) JOIN ch USING (chunk_id)))),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(fs, 6) DESC, chunk_id) AS rank FROM boosted)"""

BASE = f"q AS MATERIALIZED ({Q}), ch AS MATERIALIZED ({CH})"
HYBRID = ", ".join([BASE, LEX_CTES, META_CTES, GRAPH_CTES, VEC_CTES, CAND_CTES, BOOST_CTES])

# The same with the first endpoint and deploy hash of a question as filters: pairs that do not pass them stand in no branch but the graph.
PASS = f"""
  pass AS (SELECT q.question_id, ch.chunk_id FROM q JOIN ch USING (project_id) WHERE (q.hashes[1] IS NULL OR ch.deploy_hash = q.hashes[1]) AND (q.eps[1] IS NULL OR ch.endpoint = q.eps[1]))"""


def _passing(ctes: str, pairs: str) -> str:
    assert ctes.count(pairs) == 1
    return ctes.replace(pairs, pairs + " SEMI JOIN pass USING (question_id, chunk_id)")


HYBRID_FILTERED = ", ".join([
    BASE, PASS, _passing(LEX_CTES, "JOIN post p ON p.project_id = w.project_id AND p.term = w.term"), _passing(META_CTES, "FROM mq JOIN ch USING (project_id)"),
    GRAPH_CTES, _passing(VEC_CTES, "FROM q JOIN ch USING (project_id)"), CAND_CTES, BOOST_CTES,
])

_BODY = sx.compact(sx.redact("text"), 1600)
DECISIVE = sx.quoted(vocab.DECISIVE_REASONS)
# Rerank decision per question over the first candidates, then the final order.
RERANK_CTES = f"""
  top AS (SELECT * FROM ranked WHERE rank <= {WIDE}),
  gaps AS (SELECT question_id, count(*) AS n, round(max(fs) FILTER (rank = 1) - coalesce(max(fs) FILTER (rank = 2), 0.0), 9) AS gap, any_value(reasons) FILTER (rank = 1) AS rs FROM top GROUP BY question_id),
  decided AS (SELECT question_id, gap, n <= 1 OR gap >= 0.18 OR (list_has_any(rs, [{DECISIVE}]) AND gap >= 0.08)
      OR (len(list_filter(rs, lambda r: starts_with(r, 'metadata_terms:'))) > 0 AND gap >= 0.10) AS decisive FROM gaps)"""
PACK_CTES = f"""
  firsts AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rank) AS k FROM (
    SELECT *, {_BODY} AS body FROM (SELECT *, row_number() OVER (PARTITION BY question_id, path, start_line, end_line ORDER BY rank) AS dup FROM top WHERE rank <= {TOP_K}) WHERE dup = 1) WHERE body <> ''),
  pack AS (
    SELECT question_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS used, false AS full_, CAST(0 AS BIGINT) AS cnt, '' AS txt FROM (SELECT DISTINCT question_id FROM firsts)
    UNION ALL SELECT question_id, k, CASE WHEN stop THEN used ELSE used + length(t) END, stop, CASE WHEN stop THEN cnt ELSE cnt + 1 END, CASE WHEN stop THEN '' ELSE t END FROM (
      SELECT *, full_ OR cnt >= {TOP_K} OR left_ <= 0 OR t = '' AS stop FROM (
        SELECT p.question_id, f.k, p.used, p.full_, p.cnt, 10000 - p.used AS left_,
          CASE WHEN length(f.body) <= 10000 - p.used THEN f.body WHEN {sx.rstrip('substr(f.body, 1, greatest(10000 - p.used - 1, 0))')} = '' THEN ''
            ELSE {sx.rstrip('substr(f.body, 1, greatest(10000 - p.used - 1, 0))')} || '...' END AS t
        FROM pack p JOIN firsts f ON f.question_id = p.question_id AND f.k = p.k + 1))),
  evid AS (SELECT *, '[' || n || ']' AS label, {sx.span('start_line', 'end_line')} AS lines FROM (
    SELECT f.*, p.txt, row_number() OVER (PARTITION BY f.question_id ORDER BY round(f.fs, 6) DESC, {sx.mapped('f.source_type', vocab.SOURCE_PRIORITY, '99')}, f.path, f.rank) AS n
    FROM firsts f JOIN pack p ON p.question_id = f.question_id AND p.k = f.k WHERE p.txt <> ''))"""
EVIDENCE = ", ".join([HYBRID, RERANK_CTES, PACK_CTES])
