"""DuckDB statements that give the catalogue's results by other means."""

from __future__ import annotations

from ..functions.text import STOPWORDS
from ..operators.metrics import ERRORS, VERDICTS

K = "CAST(regexp_extract(props, '\"k\": *(-?[0-9]+)', 1) AS INT)"
CLAIMS = f"""
claims AS (
  SELECT event_id AS seq, ts, user_id,
         CASE WHEN event_type = 'error' THEN (['click','view','purchase','signup'])[{K} % 4 + 1] ELSE event_type END AS slot,
         event_type = 'error' AS is_delete,
         CASE WHEN event_type <> 'error' THEN event_type || '@' || {K} END AS label,
         CASE WHEN event_type <> 'error' THEN 'v' || CAST({K} // 25 AS INT) END AS value,
         ([3,3,3,2,1,1])[{K} % 6 + 1] AS trust
  FROM events)"""
EPOCHS = CLAIMS + """,
ep AS (
  SELECT *, CAST(sum(is_delete::INT) OVER (PARTITION BY user_id, slot ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS epoch,
         CAST(sum(is_delete::INT) OVER (PARTITION BY user_id, slot) AS BIGINT) AS last_epoch
  FROM claims)"""


def outcomes(theta: int = 2, source: str = EPOCHS) -> str:
    return source + f""",
rk AS (
  SELECT *, coalesce(max(CASE WHEN NOT is_delete THEN trust END) OVER (PARTITION BY user_id, slot, epoch ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prm
  FROM ep),
st AS (SELECT *, (NOT is_delete AND trust >= {theta} AND trust >= prm) AS setter FROM rk),
pv AS (
  SELECT *, last_value(CASE WHEN setter THEN value END IGNORE NULLS) OVER (PARTITION BY user_id, slot, epoch ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cur
  FROM st),
oc AS (
  SELECT *, CASE WHEN is_delete THEN 'delete'
                 WHEN prm < {theta} THEN CASE WHEN trust >= {theta} THEN 'introduce' ELSE 'hold' END
                 WHEN value = cur THEN 'restate' WHEN setter THEN 'supersede' ELSE 'dispute' END AS outcome
  FROM pv)"""


HIST = """,
hd AS (
  SELECT user_id, slot, epoch, max(seq) AS hseq, arg_max(value, seq) AS hvalue, arg_max(label, seq) AS hlabel
  FROM oc WHERE outcome = 'hold' GROUP BY 1, 2, 3),
isl AS (
  SELECT oc.*, CASE WHEN outcome = 'introduce' AND hvalue = value THEN hseq END AS cseq, CASE WHEN outcome = 'introduce' AND hvalue = value THEN hlabel END AS clabel,
         CAST(sum(CASE WHEN outcome <> 'restate' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, slot, epoch ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island
  FROM oc LEFT JOIN hd USING (user_id, slot, epoch) WHERE outcome IN ('introduce', 'supersede', 'restate')),
src AS (
  SELECT user_id, slot, epoch, island, count(*) AS n_sources, string_agg(CAST(x AS VARCHAR), ',' ORDER BY x) AS sources
  FROM (SELECT user_id, slot, epoch, island, seq AS x FROM isl UNION ALL SELECT user_id, slot, epoch, island, cseq FROM isl WHERE cseq IS NOT NULL) GROUP BY 1, 2, 3, 4),
en AS (
  SELECT user_id, slot, epoch, island, min(seq) AS seq, arg_min(ts, seq) AS valid_from, arg_min(coalesce(clabel, label), seq) AS label, arg_min(value, seq) AS value, max(trust) AS trust,
         bool_and(epoch = last_epoch) AS live
  FROM isl GROUP BY 1, 2, 3, 4),
hist AS (
  SELECT seq, user_id, slot, epoch, label, value, trust, n_sources, sources, valid_from,
         lead(valid_from) OVER (PARTITION BY user_id, slot, epoch ORDER BY island) AS valid_to, live
  FROM en JOIN src USING (user_id, slot, epoch, island))"""
HISTORY = outcomes() + HIST

STOP = ", ".join(f"'{w}'" for w in STOPWORDS)



def terms(c: str) -> str:
    return f"list_filter(regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}_]+'), lambda w: w NOT IN ({STOP}))"


TRACE = """
trace AS (
  SELECT conv_id || '#' || turn AS event_id, conv_id % 10 AS user_id, conv_id AS session_id, turn,
         CASE role WHEN 'user' THEN 'user_message' WHEN 'assistant' THEN 'assistant_message' WHEN 'system' THEN 'document' END AS kind, text AS content
  FROM conversations)"""
QUESTIONS = "qs AS (SELECT item_id AS query_id, text FROM benchmark)"
BM25 = TRACE + ", " + QUESTIONS + f""",
dt AS (SELECT user_id AS scope, event_id AS item_id, {terms('content')} AS ws FROM trace),
sc AS (SELECT scope, count(*) AS n, CASE WHEN avg(len(ws)) = 0 THEN 1 ELSE avg(len(ws)) END AS al FROM dt GROUP BY scope),
tf AS (SELECT scope, item_id, len(ws) AS dl, w AS term, count(*) AS tf FROM (SELECT *, unnest(ws) AS w FROM dt) GROUP BY ALL),
dfq AS (SELECT scope, term, count(*) AS df FROM tf GROUP BY ALL),
qt AS (SELECT DISTINCT query_id, w AS term FROM (SELECT query_id, unnest({terms('text')}) AS w FROM qs)),
raw AS (
  SELECT query_id, tf.scope, item_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / al))) AS raw
  FROM qt JOIN tf USING (term) JOIN dfq USING (scope, term) JOIN sc USING (scope) GROUP BY ALL),
rkd AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id, scope ORDER BY round(raw, 9) DESC, item_id) AS INT) AS rank FROM raw WHERE raw > 0),
ranked AS (SELECT query_id, scope, rank, item_id, round_even(raw, 4) AS score FROM rkd WHERE rank <= 5)"""

PROBES = """,
pr AS (
  SELECT user_id || '|' || slot || '|' || q AS probe_id, user_id, slot, asked, CASE WHEN (user_id + q) % 2 = 0 THEN asked // 2 ELSE asked END AS target
  FROM (SELECT u.user_id, u.slot, q, ((SELECT max(seq) FROM claims) * q) // 4 AS asked
        FROM (SELECT DISTINCT user_id, slot FROM claims) u, (VALUES (1), (2), (3), (4)) v(q))),
mu AS (
  SELECT user_id, slot, seq, value, CASE outcome WHEN 'supersede' THEN 'update' WHEN 'dispute' THEN 'contradict' ELSE outcome END AS kind
  FROM oc WHERE outcome <> 'hold'),
sn AS (SELECT p.probe_id, p.target, m.seq, m.kind, m.value FROM pr p JOIN mu m ON p.user_id = m.user_id AND p.slot = m.slot AND m.seq <= p.asked),
cu AS (SELECT *, coalesce(max(CASE WHEN kind = 'delete' THEN seq END) OVER (PARTITION BY probe_id), -1) AS cut FROM sn),
tr AS (SELECT probe_id, arg_max(value, seq) AS truth FROM cu WHERE seq > cut AND seq <= target AND kind IN ('introduce', 'update') GROUP BY 1),
fb AS (SELECT DISTINCT probe_id, value FROM cu WHERE value IS NOT NULL AND (seq <= cut OR kind IN ('introduce', 'update', 'contradict'))),
ex AS (
  SELECT pr.probe_id, CASE WHEN truth IS NULL THEN 'abstain' ELSE 'value' END AS kind, truth,
         coalesce((SELECT string_agg(value, ',' ORDER BY value) FROM fb WHERE fb.probe_id = pr.probe_id AND (truth IS NULL OR value <> truth)), '') AS forbidden
  FROM pr LEFT JOIN tr USING (probe_id))"""
TRUTH = outcomes() + PROBES

LOG = f"""
lg AS (
  SELECT event_id AS probe_id, CAST(user_id % 5 AS INT) AS seed, event_type AS system, CAST(event_id % 4 + 1 AS INT) AS checkpoint,
         (['correct','polluted','wrong','missed','false_abstention','leaked','no_abstention'])[{K} % 7 + 1] AS verdict, value AS ms, CAST({K} * 10 AS BIGINT) AS tokens,
         (['correct','polluted','wrong','missed','false_abstention','leaked','no_abstention'])[({K} * 3 + 1) % 7 + 1] AS answer_verdict,
         CASE WHEN {K} % 7 IN (1, 2, 5) THEN list_distinct([(['stale','future','contaminated','resurrected','forbidden'])[{K} % 5 + 1], (['stale','future','contaminated','resurrected','forbidden'])[{K} % 3 + 1]]) ELSE [] END AS error_types,
         CASE WHEN {K} % 10 < 7 THEN ({K} * 3.0::DOUBLE) / 1e6 END AS usd, CASE WHEN {K} % 4 <> 0 THEN value * 2 END AS ingest_ms
  FROM events)"""

MENTION = "regexp_matches({t}, '(?i)(^|[^\\p{{L}}\\p{{N}}_])' || {p} || '($|[^\\p{{L}}\\p{{N}}_])')"
TOKENS = "CAST(len(regexp_extract_all({c}, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s]')) AS BIGINT)"
HYBRID = outcomes() + HIST + ", " + BM25 + f""",
aq AS (SELECT query_id, scope, (['click','view','purchase','signup'])[query_id % 4 + 1] AS slot FROM qs, range(10) g(scope)),
fc AS (
  SELECT query_id, scope, 1 AS rank, aq.slot || ': ' || value AS item_id, {TOKENS.format(c="aq.slot || ': ' || value")} AS tokens
  FROM aq JOIN hist ON hist.live AND hist.valid_to IS NULL AND hist.slot = aq.slot AND hist.user_id = aq.scope),
rf AS (SELECT query_id, scope FROM aq WHERE EXISTS (SELECT 1 FROM claims c WHERE c.is_delete AND c.user_id = aq.scope AND c.slot = aq.slot) AND NOT EXISTS (SELECT 1 FROM fc WHERE fc.query_id = aq.query_id AND fc.scope = aq.scope)),
tn AS (
  SELECT r.query_id, r.scope, r.rank, r.item_id, {TOKENS.format(c="content")} AS tokens
  FROM ranked r JOIN trace t ON t.event_id = r.item_id
  WHERE NOT EXISTS (SELECT 1 FROM rf WHERE rf.query_id = r.query_id AND rf.scope = r.scope)),
tu AS (SELECT *, sum(tokens) OVER (PARTITION BY query_id, scope ORDER BY rank ROWS UNBOUNDED PRECEDING) AS upto FROM tn)"""

SYSTEM = """
ps AS (
  SELECT system, seed, 100.0::DOUBLE * count(*) FILTER (answer_verdict = 'correct') / count(*) AS a, 100.0::DOUBLE * count(*) FILTER (verdict = 'correct') / count(*) AS e, count(*) AS n, sum(tokens) AS t, sum(usd) AS u,
         count(*) FILTER (answer_verdict IN ('wrong', 'polluted', 'leaked')) AS w, count(*) FILTER (answer_verdict = 'leaked') AS la, count(*) FILTER (verdict = 'leaked') AS le,
         count(*) FILTER (list_contains(error_types, 'stale')) AS s, count(*) FILTER (list_contains(error_types, 'future')) AS f, count(*) FILTER (list_contains(error_types, 'contaminated')) AS c
  FROM lg GROUP BY 1, 2),
tb AS (
  SELECT system, round(avg(a), 6) AS answer_pct, round(coalesce(stddev_samp(a), 0), 6) AS answer_sd, round(avg(e), 6) AS evidence_pct, round(coalesce(stddev_samp(e), 0), 6) AS evidence_sd,
         CAST(sum(w) AS BIGINT) AS wrong_answers, CAST(sum(s) AS BIGINT) AS stale, CAST(sum(f) AS BIGINT) AS future, CAST(sum(c) AS BIGINT) AS contaminated, CAST(sum(la) AS BIGINT) AS leaked_answers, CAST(sum(le) AS BIGINT) AS leaked_evidence,
         round(sum(t) / sum(n), 6) AS mean_tokens, round(coalesce(sum(u), 0), 6) AS cost_usd
  FROM ps GROUP BY 1)"""

ASKED = """
sp AS (SELECT user_id, slot, min(ts) AS lo, max(ts) AS hi FROM claims GROUP BY 1, 2 UNION ALL SELECT user_id, 'refund', min(ts), max(ts) FROM claims GROUP BY 1),
q AS (SELECT user_id, slot, q, lo + to_seconds(date_sub('second', lo, hi) * (2 * q) // 8) AS asked_at, lo + to_seconds(date_sub('second', lo, hi) * (CASE WHEN q % 2 = 1 THEN q ELSE 2 * q END) // 8) AS as_of
      FROM sp, (VALUES (1), (2), (3), (4)) v(q))"""

ORACLES = {
    "trace_events": f"WITH {TRACE} SELECT event_id, user_id, session_id, kind, CAST(strlen(content) AS BIGINT) AS n_bytes FROM trace",
    "event_gate_dedupe": f"WITH {CLAIMS} SELECT seq AS event_id, user_id, slot FROM claims WHERE seq % 11 <> 0",
    "session_batches": f"WITH {TRACE} SELECT user_id, session_id, count(*) AS n_events, max(turn) AS last_position, CAST(sum(strlen(content)) AS BIGINT) AS n_bytes FROM trace GROUP BY 1, 2",
    "split_batches": f"WITH {CLAIMS}, x AS (SELECT user_id AS session_id, seq, is_delete, CAST(sum(is_delete::INT) OVER (PARTITION BY user_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS part FROM claims) SELECT session_id, part, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq FROM x WHERE NOT is_delete GROUP BY 1, 2",
    "claim_outcomes": f"WITH {outcomes()} SELECT seq, user_id, slot, epoch, outcome FROM oc",
    "claim_outcomes_any_trust": f"WITH {outcomes(1)} SELECT slot, outcome, count(*) AS n, CAST(sum(seq) AS BIGINT) AS seqs FROM oc GROUP BY 1, 2",
    "fact_history": f"WITH {HISTORY} SELECT * FROM hist",
    "fact_current": f"WITH {HISTORY} SELECT user_id, slot, value, trust, valid_from FROM hist WHERE live AND valid_to IS NULL",
    "write_report": f"WITH {outcomes()} SELECT user_id, count(*) FILTER (outcome IN ('introduce', 'supersede')) AS added, count(*) FILTER (outcome = 'restate') AS updated, count(*) FILTER (outcome = 'supersede') AS superseded, count(*) FILTER (outcome IN ('dispute', 'hold')) AS rejected FROM oc GROUP BY 1",
    "fact_as_of": f"WITH {HISTORY}, q AS (SELECT user_id, slot, ts AS as_of, unnest([ts, (SELECT max(ts) FROM claims)]) AS asked_at FROM claims), e AS (SELECT q.*, (SELECT count(*) FROM claims x WHERE x.is_delete AND x.user_id = q.user_id AND x.slot = q.slot AND x.ts <= q.asked_at) AS epoch FROM q) SELECT e.user_id, e.slot, e.as_of, e.asked_at, h.value, h.valid_from, CASE WHEN h.valid_to <= e.asked_at THEN h.valid_to END AS valid_to FROM e LEFT JOIN hist h ON h.epoch = e.epoch AND h.user_id = e.user_id AND h.slot = e.slot AND h.valid_from <= e.as_of AND (h.valid_to IS NULL OR e.as_of < h.valid_to)",
    "abstain_reasons": f"WITH {HISTORY}, {ASKED}, e AS (SELECT q.*, (SELECT count(*) FROM claims x WHERE x.is_delete AND x.user_id = q.user_id AND x.slot = q.slot AND x.ts <= q.asked_at) AS epoch, (SELECT count(*) FROM claims x WHERE x.user_id = q.user_id AND x.slot = q.slot AND x.ts <= q.asked_at) AS seen FROM q), w AS (SELECT e.user_id, e.slot, e.q, max(CASE WHEN outcome = 'hold' THEN 1 ELSE 0 END) AS holds, max(CASE WHEN outcome = 'introduce' THEN 1 ELSE 0 END) AS opened FROM e JOIN oc ON oc.user_id = e.user_id AND oc.slot = e.slot AND oc.epoch = e.epoch AND oc.ts <= e.asked_at GROUP BY 1, 2, 3) SELECT e.user_id, e.slot, e.q, h.value, CASE WHEN h.value IS NOT NULL THEN 'answered' WHEN seen = 0 THEN 'no known slot' WHEN e.epoch > 0 THEN 'deleted' WHEN holds = 1 AND opened = 0 THEN 'unconfirmed' ELSE 'no value at date' END AS reason FROM e LEFT JOIN w USING (user_id, slot, q) LEFT JOIN hist h ON h.epoch = e.epoch AND h.user_id = e.user_id AND h.slot = e.slot AND h.valid_from <= e.as_of AND (h.valid_to IS NULL OR e.as_of < h.valid_to)",
    "held_claims": f"WITH {outcomes()}, o AS (SELECT user_id, slot, epoch, arg_min(value, seq) AS ivalue FROM oc WHERE outcome = 'introduce' GROUP BY 1, 2, 3), l AS (SELECT user_id, slot, epoch, max(seq) AS top FROM oc WHERE outcome = 'hold' GROUP BY 1, 2, 3) SELECT seq, oc.user_id, oc.slot, label, CASE WHEN seq < top THEN 'disputed' WHEN ivalue IS NULL THEN 'pending' WHEN ivalue = value THEN 'confirmed' ELSE 'disputed' END AS state, epoch = last_epoch AS live FROM oc JOIN l USING (user_id, slot, epoch) LEFT JOIN o USING (user_id, slot, epoch) WHERE outcome = 'hold'",
    "dispute_audit": f"WITH {outcomes()}, o AS (SELECT user_id, slot, epoch, arg_min(value, seq) AS ivalue FROM oc WHERE outcome = 'introduce' GROUP BY 1, 2, 3), l AS (SELECT user_id, slot, epoch, max(seq) AS top FROM oc WHERE outcome = 'hold' GROUP BY 1, 2, 3) SELECT seq, user_id, slot, epoch, value, trust, epoch = last_epoch AS live FROM oc LEFT JOIN l USING (user_id, slot, epoch) LEFT JOIN o USING (user_id, slot, epoch) WHERE outcome = 'dispute' OR outcome = 'hold' AND (seq < top OR ivalue <> value)",
    "point_in_time_checkpoints": "WITH "
    + CLAIMS.replace("claims AS", "claims0 AS", 1)
    + ", claims AS (SELECT c.seq, c.ts, c.user_id, p.seq // 2500 || '|' || c.slot AS slot, c.is_delete, c.label, c.value, c.trust FROM claims0 c JOIN claims0 p ON p.seq % 2500 = 2499 AND c.ts <= p.ts)"
    + outcomes(2, EPOCHS[len(CLAIMS) :])
    + HIST
    + " SELECT 'c' || split_part(slot, '|', 1) AS checkpoint, split_part(slot, '|', 2) AS slot, count(*) AS open, CAST(sum(trust) AS BIGINT) AS trust FROM hist WHERE live AND valid_to IS NULL GROUP BY 1, 2",
    "delete_tombstones": f"WITH {CLAIMS} SELECT user_id, slot, count(*) AS deletes, max(ts) AS deleted_at FROM claims WHERE is_delete GROUP BY 1, 2",
    "blocked_events": f"WITH {CLAIMS} SELECT c.user_id, c.seq AS event_id FROM claims c WHERE NOT is_delete AND EXISTS (SELECT 1 FROM claims x WHERE x.is_delete AND x.user_id = c.user_id AND x.slot = c.slot AND x.seq > c.seq)",
    "bm25_topk": f"WITH {BM25} SELECT * FROM ranked",
    "bm25_stats": f"WITH t AS (SELECT source AS scope, {terms('text')} AS ws FROM documents), u AS (SELECT scope, unnest(ws) AS w FROM t), a AS (SELECT scope, count(DISTINCT w) AS terms, count(*) AS tokens FROM u GROUP BY 1), b AS (SELECT scope, count(*) AS n, round(avg(len(ws)), 6) AS avg_len FROM t GROUP BY 1) SELECT scope, n, terms, tokens, avg_len FROM b JOIN a USING (scope)",
    "budget_prefix": f"WITH {BM25}, c AS (SELECT query_id, r.scope, rank, r.item_id, CAST(len(regexp_extract_all(content, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s]')) AS BIGINT) AS tokens FROM ranked r JOIN trace t ON t.event_id = r.item_id), u AS (SELECT *, CAST(sum(tokens) OVER (PARTITION BY query_id, scope ORDER BY rank ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM c) SELECT * FROM u WHERE used <= 60",
    "vector_topk": "WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings v JOIN embeddings q ON q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s) SELECT query_id, rank, vec_id, round(score, 4) AS score FROM r WHERE rank <= 10",
    "hybrid_fallback": f"WITH {HYBRID} SELECT * FROM fc UNION ALL SELECT query_id, scope, rank, item_id, tokens FROM tu WHERE upto <= 60 AND NOT EXISTS (SELECT 1 FROM fc WHERE fc.query_id = tu.query_id AND fc.scope = tu.scope)",
    "hybrid_augment": f"WITH {HYBRID} SELECT * FROM fc UNION ALL SELECT tu.query_id, tu.scope, CAST(tu.rank + coalesce(fc.rank, 0) AS INT), tu.item_id, tu.tokens FROM tu LEFT JOIN fc USING (query_id, scope) WHERE upto <= 60 - coalesce(fc.tokens, 0)",
    "hybrid_scrub": f"WITH {TRACE}, er AS (SELECT DISTINCT user_id, array_to_string((regexp_split_to_array(content, '\\s+'))[1:3], ' ') AS value FROM trace WHERE turn = 0) SELECT event_id, user_id FROM trace t WHERE NOT EXISTS (SELECT 1 FROM er WHERE er.user_id = t.user_id AND {MENTION.format(t='t.content', p="regexp_replace(regexp_escape(er.value), '(\\\\ )+', '\\\\s+', 'g')")})",
    "phrase_mentions": f"WITH p(phrase) AS (SELECT DISTINCT lower((string_split(p_type, ' '))[1]) FROM part UNION VALUES ('the'), ('est'), ('und  der'), ('is a')) SELECT phrase, count(*) AS docs, CAST(sum(doc_id) AS BIGINT) AS ids FROM documents JOIN p ON {MENTION.format(t='text', p="regexp_replace(phrase, ' +', '\\\\s+', 'g')")} GROUP BY 1",
    "entity_names": "SELECT lang, count(*) AS n FROM documents WHERE regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}_-])the($|[^\\p{L}\\p{N}_-])') GROUP BY 1",
    "grounded_values": "WITH d AS (SELECT doc_id, (regexp_split_to_array(text, '\\s+'))[1] AS value, text FROM documents), s AS (SELECT *, regexp_replace(lower(value), '[^0-9a-z]', '', 'g') AS v, regexp_replace(lower(text), '[^0-9a-z]', '', 'g') AS t FROM d) SELECT doc_id, value, v <> '' AND contains(reverse(t), v) AS reversed, v <> '' AND contains(t, v) AS grounded FROM s",
    "slot_keys": "SELECT s_suppkey, regexp_replace(lower(trim(s_name)), '\\s+', '-', 'g') || '/test_command_x_y' AS slot FROM supplier",
    "named_slots": "WITH d AS (SELECT lang, lower(text) AS t FROM documents) SELECT lang, count(*) AS n FROM d WHERE regexp_matches(t, '(^|[^\\p{L}\\p{N}_-])the($|[^\\p{L}\\p{N}_-])') AND regexp_matches(t, '(^|[^a-z0-9])an') AND regexp_matches(t, '(^|[^a-z0-9])th') GROUP BY 1",
    "token_counts": "SELECT doc_id, CAST(len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]')) AS BIGINT) AS tokens FROM documents",
    "expected_answers": f"WITH {TRUTH} SELECT * FROM ex",
    "explain_forbidden": f"WITH {TRUTH}, y AS (SELECT DISTINCT probe_id, value, CASE WHEN seq <= cut THEN 'resurrected' WHEN kind = 'contradict' THEN 'contaminated' WHEN kind IN ('introduce', 'update') THEN CASE WHEN seq > target THEN 'future' ELSE 'stale' END END AS reason FROM cu WHERE value IS NOT NULL) SELECT reason, value, count(*) AS probes FROM y WHERE reason IS NOT NULL GROUP BY 1, 2",
    "verdicts": f"WITH {TRUTH}, sd AS (SELECT probe_id, arg_max(value, seq) AS said FROM sn WHERE value IS NOT NULL GROUP BY 1), z AS (SELECT ex.kind, said, coalesce(said = truth, false) AS hit, coalesce(list_contains(string_split(forbidden, ','), said), false) AS bad FROM ex LEFT JOIN sd USING (probe_id)) SELECT kind, CASE WHEN kind = 'abstain' AND bad THEN 'leaked' WHEN kind = 'abstain' THEN CASE WHEN said IS NULL THEN 'correct' ELSE 'no_abstention' END WHEN said IS NULL THEN 'false_abstention' WHEN hit THEN CASE WHEN bad THEN 'polluted' ELSE 'correct' END WHEN bad THEN 'wrong' ELSE 'missed' END AS verdict, count(*) AS n FROM z GROUP BY 1, 2",
    "isolation_check": f"WITH {HISTORY}, n AS (SELECT DISTINCT user_id, value FROM hist WHERE live AND valid_to IS NULL) SELECT user_id, count(*) AS shared_values FROM n WHERE EXISTS (SELECT 1 FROM n m WHERE m.value = n.value AND m.user_id <> n.user_id) GROUP BY 1",
    "accuracy_mean_sd": f"WITH {LOG}, s AS (SELECT system, seed, 100.0 * count(*) FILTER (verdict = 'correct') / count(*) AS p FROM lg GROUP BY 1, 2) SELECT system, count(*) AS seeds, round(avg(p), 6) AS mean_pct, round(coalesce(stddev_samp(p), 0), 6) AS sd_pct FROM s GROUP BY 1",
    "median_latency": f"WITH {LOG} SELECT system, round(median(ms), 6) AS median_ms, round(avg(ms), 6) AS mean_ms, max(ms) AS max_ms FROM lg GROUP BY 1",
    "per_checkpoint": f"WITH {LOG}, s AS (SELECT system, checkpoint, seed, count(*) FILTER (verdict = 'correct') / count(*) AS acc, avg(ms) AS ms, avg(tokens) AS tokens, avg(list_contains(error_types, 'stale')::INT) AS stale, avg((len(error_types) > 0)::INT) AS forbidden, avg(ingest_ms) AS ingest_ms FROM lg GROUP BY ALL) SELECT system, checkpoint, " + ", ".join(f"CASE WHEN bool_and({c} IS NOT NULL) THEN round(avg({c}), 6) END AS {c}" for c in ("acc", "ms", "tokens", "stale", "forbidden", "ingest_ms")) + " FROM s GROUP BY 1, 2",
    "verdict_pivot": f"WITH {LOG} SELECT system, seed, count(*) AS probes, " + ", ".join(f"count(*) FILTER (verdict = '{v}') AS {v}" for v in ("correct", "polluted", "wrong", "missed", "false_abstention", "leaked", "no_abstention")) + " FROM lg GROUP BY 1, 2",
    "noise_flips": f"WITH {LOG}, u AS (SELECT system, probe_id // 3 AS unit, count(DISTINCT verdict) AS kinds FROM lg GROUP BY 1, 2), r AS (SELECT system, seed, verdict, row_number() OVER (PARTITION BY system, seed, probe_id // 3 ORDER BY probe_id) AS r FROM lg), c AS (SELECT system, seed, r, count(*) FILTER (verdict = 'correct') AS c FROM r GROUP BY 1, 2, 3), d AS (SELECT system, seed, coalesce(stddev_samp(c), 0) AS sd FROM c GROUP BY 1, 2), m AS (SELECT system, round(avg(sd), 6) AS mean_sd FROM d GROUP BY 1) SELECT system, units, flips, mean_sd FROM (SELECT system, count(*) AS units, count(*) FILTER (kinds > 1) AS flips FROM u GROUP BY 1) JOIN m USING (system)",
    "bootstrap_ci": "WITH r AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY quality::DOUBLE) - 1 AS pos, quality::DOUBLE AS v, count(*) OVER (PARTITION BY lang) AS n FROM labels JOIN documents USING (doc_id)), d AS (SELECT lang, rep, ((d * 48271 + rep * 69621 + 12345) % 2147483647) % n AS pos FROM (SELECT lang, pos AS d, n FROM r), range(2000) g(rep)), m AS (SELECT d.lang, rep, avg(v) AS m FROM d JOIN r ON r.lang = d.lang AND r.pos = d.pos GROUP BY 1, 2), k AS (SELECT lang, m, row_number() OVER (PARTITION BY lang ORDER BY m, rep) - 1 AS rn FROM m), e AS (SELECT lang, round(max(m) FILTER (rn = 50), 6) AS low, round(max(m) FILTER (rn = 1949), 6) AS high FROM k GROUP BY 1) SELECT * FROM e",
    "stratified_sample": "WITH s AS (SELECT lang, doc_id, CAST(row_number() OVER (PARTITION BY lang ORDER BY (doc_id * 7919 + 104729) % 1000003, doc_id) AS INT) AS pick FROM documents) SELECT * FROM s WHERE pick <= 10",
    "cost_usd": f"WITH c AS (SELECT event_id AS call_id, (['gpt-4.1-mini-2025','gpt-4o-2024-08-06','gpt-4.1-2025-04-14','unknown-model'])[event_id % 4 + 1] AS model, {K} * 100 AS ti, {K} AS tout FROM events), p(prefix, a, b) AS (VALUES ('gpt-4.1-mini', 0.40::DOUBLE, 1.60::DOUBLE), ('gpt-4o-2024-08-06', 2.50, 10.00), ('gpt-4.1-2025-04-14', 2.00, 8.00)) SELECT call_id, model, round((ti * a + tout * b) / 1e6, 9) AS usd, a IS NOT NULL AS priced FROM c LEFT JOIN p ON starts_with(model, prefix)",
    "store_stats": f"WITH {HISTORY}, a AS (SELECT user_id, count(*) AS items, CAST(sum(strlen(value)) AS BIGINT) AS bytes, count(*) FILTER (valid_to IS NULL) AS active FROM hist WHERE live GROUP BY 1), o AS (SELECT user_id, slot, epoch, arg_min(value, seq) AS ivalue FROM oc WHERE outcome = 'introduce' GROUP BY 1, 2, 3), l AS (SELECT user_id, slot, epoch, max(seq) AS top FROM oc WHERE outcome = 'hold' GROUP BY 1, 2, 3), b AS (SELECT user_id, count(*) FILTER (outcome = 'dispute' OR outcome = 'hold' AND (seq < top OR ivalue <> value)) AS disputes, count(*) FILTER (outcome = 'hold' AND seq = top AND ivalue IS NULL) AS pending FROM oc LEFT JOIN l USING (user_id, slot, epoch) LEFT JOIN o USING (user_id, slot, epoch) WHERE epoch = last_epoch GROUP BY 1), c AS (SELECT user_id, count(*) FILTER (is_delete) AS tombstones FROM claims GROUP BY 1) SELECT c.user_id, coalesce(items, 0) AS items, coalesce(bytes, 0) AS bytes, coalesce(active, 0) AS active, coalesce(disputes, 0) AS disputes, coalesce(pending, 0) AS pending, tombstones FROM c LEFT JOIN a USING (user_id) LEFT JOIN b USING (user_id) WHERE coalesce(items, 0) + coalesce(disputes, 0) + coalesce(pending, 0) + tombstones > 0",
    "cache_hit_split": "WITH r AS (SELECT conv_id, sha256(text) AS digest FROM conversations), k AS (SELECT DISTINCT digest FROM r WHERE conv_id % 4 = 0) SELECT digest IN (SELECT digest FROM k) AS hit, count(*) AS requests, count(DISTINCT digest) AS distinct_requests FROM r GROUP BY 1",
    "validate_duplicates": "SELECT count(*) AS groups, CAST(coalesce(sum(n), 0) AS BIGINT) AS rows FROM (SELECT count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1)",
    "validate_order": "SELECT user_id, event_id, ts FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY CASE WHEN event_id % 2 = 1 THEN -event_id ELSE event_id END) AS b FROM events) WHERE ts < b",
    "validate_references": "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "validate_sequence": f"WITH {TRUTH}, l AS (SELECT user_id, slot, seq, value, CASE WHEN seq % 7 = 0 THEN CASE kind WHEN 'introduce' THEN 'update' WHEN 'update' THEN 'restate' WHEN 'restate' THEN 'contradict' WHEN 'contradict' THEN 'delete' ELSE 'introduce' END ELSE kind END AS kind FROM mu), a AS (SELECT l.*, s.kind AS skind, s.value AS sv FROM l LEFT JOIN LATERAL (SELECT kind, value FROM l x WHERE x.user_id = l.user_id AND x.slot = l.slot AND x.seq < l.seq AND x.kind IN ('introduce', 'update', 'delete') ORDER BY x.seq DESC LIMIT 1) s ON true), w AS (SELECT *, CASE WHEN skind <> 'delete' THEN sv END AS now FROM a), z AS (SELECT user_id, slot, seq, CASE kind WHEN 'introduce' THEN CASE WHEN now IS NOT NULL THEN 'INTRODUCE while fact is active (use UPDATE)' END WHEN 'update' THEN CASE WHEN now IS NULL THEN 'UPDATE of an inactive fact' WHEN value = now THEN 'UPDATE to the same value (use RESTATE)' END WHEN 'restate' THEN CASE WHEN now IS NULL OR value IS DISTINCT FROM now THEN 'RESTATE must repeat the current value' END WHEN 'contradict' THEN CASE WHEN now IS NULL THEN 'CONTRADICT of an inactive fact' WHEN value = now THEN 'CONTRADICT must conflict with the current value' END ELSE CASE WHEN now IS NULL THEN 'DELETE of an inactive fact' END END AS error FROM w) SELECT * FROM z WHERE error IS NOT NULL",
    "rule_claims": f"WITH {TRACE}, x AS (SELECT event_id, 'database' AS slot, (MAP {{'postgresql': 'PostgreSQL', 'postgres': 'PostgreSQL', 'pg': 'PostgreSQL', 'mysql': 'MySQL', 'mariadb': 'MariaDB', 'sqlite': 'SQLite', 'mongodb': 'MongoDB'}})[lower(regexp_extract(content, '(?i)\\b(postgresql|postgres|pg|mysql|mariadb|sqlite|mongodb)\\s*\\d+(?:\\.\\d+)?\\b', 1))] || ' ' || regexp_extract(content, '(?i)\\b(?:postgresql|postgres|pg|mysql|mariadb|sqlite|mongodb)\\s*(\\d+(?:\\.\\d+)?)\\b', 1) AS value FROM trace UNION ALL SELECT event_id, 'test_command', regexp_extract(content, '(?is)\\btests?\\b[^`]*`([^`]+)`', 1) FROM trace UNION ALL SELECT event_id, 'deploy_branch', regexp_extract(content, '(?i)\\bdeploy\\w*\\b[^.`]*?\\bfrom\\s+(?:the\\s+)?`?([A-Za-z][\\w./-]*)`?', 1) FROM trace UNION ALL SELECT event_id, 'staging_hostname', regexp_extract(content, '(?i)\\bstaging\\b.*?\\b([a-z0-9-]+(?:\\.[a-z0-9-]+)*\\.(?:internal|local|com|net|io|org))\\b', 1) FROM trace) SELECT event_id, slot, value FROM x WHERE value <> ''",
    "routed_slots": "WITH c(slot, cue) AS (VALUES ('database', 'database|db|postgres\\w*|mysql'), ('test_command', 'tests?|test suite'), ('deploy_branch', 'branch|deploy\\w*'), ('staging_hostname', 'staging|hostname|host')) SELECT doc_id, slot FROM documents JOIN c ON regexp_matches(text, '(?i)(^|[^\\p{L}\\p{N}_])(' || cue || ')($|[^\\p{L}\\p{N}_])')",
    "fact_evidence": f"WITH {HISTORY} SELECT user_id, seq, slot || ': ' || value || ' (since ' || strftime(valid_from, '%Y-%m-%d') || coalesce(' until ' || strftime(valid_to, '%Y-%m-%d'), '') || '; source: ' || CASE trust WHEN 3 THEN 'user_message' WHEN 2 THEN 'document' ELSE 'assistant_message' END || ')' AS content FROM hist WHERE live",
    "turn_evidence": "SELECT event_id, '[' || strftime(ts, '%Y-%m-%d %H:%M') || ' ' || event_type || '] ' || props AS content FROM events",
    "export_items": f"WITH {HISTORY} SELECT user_id, seq, slot || ': ' || value AS content, CASE WHEN valid_to IS NULL THEN 'active' ELSE 'superseded' END AS status, sources, valid_from, valid_to FROM hist WHERE live",
    "memory_ids": f"WITH {outcomes()} SELECT seq, 'L' || CASE WHEN n < 1000000 THEN lpad(CAST(n AS VARCHAR), 6, '0') ELSE CAST(n AS VARCHAR) END AS memory_id FROM (SELECT seq, row_number() OVER (ORDER BY seq) AS n FROM oc WHERE outcome NOT IN ('restate', 'delete'))",
    "known_slots": f"WITH {HISTORY}, o AS (SELECT user_id, slot, value, label FROM hist WHERE live AND valid_to IS NULL), h AS (SELECT user_id, slot, arg_max(value, seq) AS value, arg_max(label, seq) AS label FROM oc WHERE outcome = 'hold' AND epoch = last_epoch GROUP BY 1, 2), u AS (SELECT DISTINCT user_id, slot FROM claims) SELECT u.user_id, u.slot, CASE WHEN o.value IS NOT NULL THEN 'open' WHEN h.value IS NOT NULL THEN 'pending' ELSE 'deleted' END AS state, coalesce(o.value, h.value) AS value, coalesce(coalesce(o.label, h.label) || ' (current: ' || coalesce(o.value, h.value) || ')', '(deleted)') AS described FROM u LEFT JOIN o USING (user_id, slot) LEFT JOIN h USING (user_id, slot)",
    "missing_pairs": f"WITH {CLAIMS}, e AS (SELECT DISTINCT user_id, s.slot FROM claims, (VALUES ('click'), ('view'), ('purchase'), ('signup'), ('refund')) s(slot)) SELECT user_id, slot FROM e WHERE NOT EXISTS (SELECT 1 FROM claims c WHERE NOT c.is_delete AND c.user_id = e.user_id AND c.slot = e.slot)",
    "subphrase_values": "WITH v AS (SELECT p_type AS value FROM part UNION SELECT p_name FROM part UNION SELECT p_brand FROM part) SELECT a.value AS inner, b.value AS outer FROM v a JOIN v b ON a.value <> b.value AND contains(lower(b.value), lower(a.value)) AND regexp_matches(b.value, '(?i)(^|[^\\p{L}\\p{N}_])' || regexp_escape(a.value) || '($|[^\\p{L}\\p{N}_])')",
    "paired_ci": "WITH r AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY 100.0::DOUBLE * (quality - toxic)) - 1 AS pos, 100.0::DOUBLE * (quality - toxic) AS v, count(*) OVER (PARTITION BY lang) AS n FROM labels JOIN documents USING (doc_id)), d AS (SELECT lang, rep, ((d * 48271 + rep * 69621 + 12345) % 2147483647) % n AS pos FROM (SELECT lang, pos AS d, n FROM r), range(2000) g(rep)), m AS (SELECT d.lang, rep, avg(v) AS m FROM d JOIN r ON r.lang = d.lang AND r.pos = d.pos GROUP BY 1, 2), k AS (SELECT lang, m, row_number() OVER (PARTITION BY lang ORDER BY m, rep) - 1 AS rn FROM m), e AS (SELECT lang, round(max(m) FILTER (rn = 50), 6) AS low, round(max(m) FILTER (rn = 1949), 6) AS high FROM k GROUP BY 1) SELECT lang, pairs, diff, low, high FROM e JOIN (SELECT lang, count(*) AS pairs, round(avg(v), 6) AS diff FROM r GROUP BY 1) USING (lang)",
    "audit_agreement": "WITH m AS (SELECT lang, quality AS j, toxic AS h FROM labels JOIN documents USING (doc_id)), p AS (SELECT lang, count(*) AS items, avg(j) AS pj, avg(h) AS ph, avg((j = h)::INT) AS po, count(*) FILTER (j = 1 AND h = 0) AS yes_no, count(*) FILTER (j = 0 AND h = 1) AS no_yes FROM m GROUP BY 1) SELECT lang, items, round(po, 6) AS agreement, CASE WHEN pj * ph + (1 - pj) * (1 - ph) < 1 THEN round((po - (pj * ph + (1 - pj) * (1 - ph))) / (1 - (pj * ph + (1 - pj) * (1 - ph))), 6) END AS kappa, yes_no, no_yes FROM p",
    "category_report": "WITH m AS (SELECT lang, quality FROM labels JOIN documents USING (doc_id)) SELECT lang, count(*) AS items, round(100 * avg(quality), 6) AS pct FROM m GROUP BY 1 UNION ALL SELECT 'all', count(*), round(100 * avg(quality), 6) FROM m",
    "write_read_costs": f"WITH {LOG}, z AS (SELECT seed, system IN ('click', 'view') AS w, tokens * 0.4::DOUBLE / 1e6 AS usd FROM lg) SELECT seed, round(coalesce(sum(usd) FILTER (w), 0), 6) AS write_usd, round(coalesce(sum(usd) FILTER (NOT w), 0), 6) AS read_usd, count(*) FILTER (w) AS writes FROM z GROUP BY 1",
    "restart_identity": f"WITH {LOG}, a AS (SELECT probe_id // 2 AS u, verdict FROM lg WHERE probe_id % 2 = 0), b AS (SELECT probe_id // 2 AS u, verdict FROM lg WHERE probe_id % 2 = 1) SELECT count(*) FILTER (a.u IS NOT NULL AND b.u IS NOT NULL AND a.verdict IS NOT DISTINCT FROM b.verdict) AS same, count(*) FILTER (a.u IS NOT NULL AND b.u IS NOT NULL AND a.verdict IS DISTINCT FROM b.verdict) AS changed, count(*) FILTER (b.u IS NULL) AS only_first, count(*) FILTER (a.u IS NULL) AS only_second FROM a FULL JOIN b ON a.u = b.u",
    "pilot_exclusion": f"WITH {LOG}, m AS (SELECT *, probe_id IN (SELECT doc_id FROM labels) AS seen FROM lg) SELECT system, count(*) FILTER (seen) AS excluded, round(100.0::DOUBLE * count(*) FILTER (verdict = 'correct') / count(*), 6) AS pct_all, round(100.0::DOUBLE * count(*) FILTER (verdict = 'correct' AND NOT seen) / count(*) FILTER (NOT seen), 6) AS pct_rest FROM m GROUP BY 1",
    "fraction_checkpoints": "WITH e AS (SELECT ts, row_number() OVER (ORDER BY event_id) AS no, count(*) OVER () AS n FROM events), f(i, f) AS (VALUES (1, 0.25::DOUBLE), (2, 0.5), (3, 0.75), (4, 1.0)) SELECT 'c' || i AS name, round_even(no / n, 4) AS fraction, ts AS at FROM f JOIN e ON e.no = greatest(1, round_even(f * n, 0)::BIGINT)",
    "run_summary": f"WITH {LOG} SELECT system, seed, count(*) AS probes, " + ", ".join(f"count(*) FILTER (verdict = '{v}') AS {v}" for v in VERDICTS) + ", " + ", ".join(f"count(*) FILTER (list_contains(error_types, '{t}')) AS {t}" for t in ERRORS) + ", CAST(sum(tokens) AS BIGINT) AS injected_tokens, count(*) FILTER (tokens > 800) AS budget_violations, round(coalesce(sum(usd), 0), 6) AS cost_usd, round(avg(ms), 6) AS mean_ms FROM lg GROUP BY 1, 2",
    "system_table": f"WITH {LOG}, {SYSTEM} SELECT * FROM tb",
    "heldout_table": f"WITH {LOG.replace('lg AS', 'l0 AS')}, lg AS (SELECT * FROM l0 WHERE seed IN (3, 4)), {SYSTEM} SELECT system, answer_pct, answer_sd, evidence_pct, evidence_sd FROM tb",
    "efficiency_table": f"WITH {LOG}, f AS (SELECT system, round(sum(tokens) / 1024, 6) AS final_kib FROM lg WHERE checkpoint = 4 GROUP BY 1) SELECT system, round(median(ingest_ms), 6) AS ingest_ms, round(median(ms), 6) AS retrieve_ms, round(count(usd) / count(ingest_ms), 6) AS calls_per_write, round(coalesce(sum(usd), 0) / count(DISTINCT seed), 6) AS usd_per_seed, round(coalesce(sum(usd), 0) / count(*), 9) AS usd_per_question, any_value(final_kib) AS final_kib FROM lg JOIN f USING (system) GROUP BY 1",
    "write_read_legacy": f"WITH {LOG} SELECT system, round(sum(tokens / 1e6 * CASE WHEN probe_id % 3 = 0 THEN 0.5::DOUBLE ELSE 0.75 END), 6) AS write_usd, round(sum(tokens / 1e6 * CASE WHEN probe_id % 3 = 0 THEN 0.5::DOUBLE ELSE 0.25 END), 6) AS read_usd, count(*) FILTER (probe_id % 3 = 0) AS legacy FROM lg GROUP BY 1",
    "event_counters": f"WITH {TRACE} SELECT kind, count(*) AS events, count(DISTINCT user_id) AS users, count(DISTINCT session_id) AS sessions FROM trace GROUP BY 1 UNION ALL SELECT 'all', count(*), count(DISTINCT user_id), count(DISTINCT session_id) FROM trace",
    "token_recount": f"WITH {BM25}, c AS (SELECT query_id, r.scope, rank, {TOKENS.format(c='content')} AS tokens FROM ranked r JOIN trace t ON t.event_id = r.item_id), u AS (SELECT *, sum(tokens) OVER (PARTITION BY query_id, scope ORDER BY rank ROWS UNBOUNDED PRECEDING) AS upto FROM c) SELECT query_id, scope, CAST(coalesce(sum(tokens) FILTER (upto <= 60), 0) AS BIGINT) AS used, count(*) FILTER (upto <= 60) AS items, CASE WHEN count(*) FILTER (upto <= 60) < count(*) THEN 'short' END AS problem FROM u GROUP BY 1, 2",
    "token_difference": f"WITH {LOG}, p AS (SELECT a.tokens - b.tokens AS d FROM lg a JOIN lg b ON a.probe_id % 2 = 0 AND b.probe_id = a.probe_id + 1) SELECT count(*) AS pairs, round(avg(d), 6) AS mean_more, CAST(sum(d) AS BIGINT) AS more FROM p",
    "ingest_gate": f"WITH {TRACE}, a AS (SELECT event_id, user_id, session_id, turn, kind, 0 AS copy FROM trace UNION ALL SELECT event_id, user_id, session_id, turn, kind, 1 FROM trace WHERE turn % 5 = 1) SELECT user_id, CASE WHEN turn % 7 = 2 THEN 'rejected' WHEN session_id % 4 = 0 OR copy = 1 THEN 'known' WHEN kind = 'assistant_message' THEN 'skipped' ELSE 'extract' END AS action, count(*) AS events FROM a GROUP BY 1, 2",
    "user_history": f"WITH {TRACE} SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY session_id, turn) AS INT) AS rank, event_id FROM trace",
    "erased_values": f"WITH {CLAIMS}, e AS (SELECT c.seq, (SELECT min(x.seq) FROM claims x WHERE x.is_delete AND x.user_id = c.user_id AND x.slot = c.slot AND x.seq > c.seq) AS r FROM claims c WHERE NOT is_delete) SELECT CAST(d.seq AS VARCHAR) AS request_id, CAST(1 AS BIGINT) AS slots, count(e.seq) AS erased FROM claims d LEFT JOIN e ON e.r = d.seq WHERE d.is_delete GROUP BY 1",
    "blocked_sources": f"WITH {CLAIMS} SELECT user_id, 'x' || seq AS event_id FROM claims WHERE is_delete UNION ALL SELECT user_id, CAST(seq AS VARCHAR) FROM claims c WHERE NOT is_delete AND EXISTS (SELECT 1 FROM claims x WHERE x.is_delete AND x.user_id = c.user_id AND x.slot = c.slot AND x.seq > c.seq)",
    "fact_retrieval": f"WITH {HISTORY}, {ASKED}, e AS (SELECT q.*, (SELECT count(*) FROM claims x WHERE x.is_delete AND x.user_id = q.user_id AND x.slot = q.slot AND x.ts <= q.asked_at) AS epoch FROM q), w AS (SELECT e.user_id, e.q, e.slot, max(CASE WHEN outcome = 'hold' THEN 1 ELSE 0 END) AS holds, max(CASE WHEN outcome = 'introduce' THEN 1 ELSE 0 END) AS opened FROM e JOIN oc ON oc.user_id = e.user_id AND oc.slot = e.slot AND oc.epoch = e.epoch AND oc.ts <= e.asked_at GROUP BY 1, 2, 3), f AS (SELECT e.user_id, e.q, e.slot, e.epoch, list_position(['click','view','purchase','signup','refund'], e.slot) AS place, holds = 1 AND opened = 0 AS held, h.label || ': ' || h.value || ' (since ' || strftime(h.valid_from, '%Y-%m-%d') || CASE WHEN h.valid_to <= e.asked_at THEN ' until ' || strftime(h.valid_to, '%Y-%m-%d') ELSE '' END || '; source: ' || CASE h.trust WHEN 3 THEN 'user_message' WHEN 2 THEN 'document' ELSE 'assistant_message' END || ')' AS content FROM e LEFT JOIN w USING (user_id, q, slot) LEFT JOIN hist h ON h.epoch = e.epoch AND h.user_id = e.user_id AND h.slot = e.slot AND h.valid_from <= e.as_of AND (h.valid_to IS NULL OR e.as_of < h.valid_to)), t AS (SELECT *, {TOKENS.format(c='content')} AS tokens FROM f), u AS (SELECT *, sum(tokens) OVER (PARTITION BY user_id, q ORDER BY place ROWS UNBOUNDED PRECEDING) AS upto FROM t WHERE content IS NOT NULL), k AS (SELECT user_id, q, count(*) AS items, CAST(sum(tokens) AS BIGINT) AS tokens, arg_max(content, place) AS last FROM u WHERE upto <= 50 GROUP BY 1, 2), y AS (SELECT user_id, q, CASE WHEN bool_or(content IS NULL AND epoch > 0) THEN 'deleted' WHEN bool_or(content IS NULL AND coalesce(held, false)) THEN 'unconfirmed' ELSE 'no value at date' END AS reason FROM f GROUP BY 1, 2) SELECT y.user_id AS query_id, y.q AS scope, items, tokens, last, CASE WHEN items IS NULL THEN reason END AS reason FROM y LEFT JOIN k USING (user_id, q)",
    "event_lines": "WITH l AS (SELECT *, '[' || event_id || '] ' || strftime(ts, '%Y-%m-%d %H:%M') || ' ' || event_type || ': ' || props AS line FROM events) SELECT event_id, line, 'What did u' || user_id || ' do on ' || strftime(ts, '%B %-d, %Y') || '?' AS question, sha256(line) AS digest FROM l",
    "service_slots": "SELECT s_suppkey, lower(replace(s_name, '#', '-')) AS short, lower(replace(s_name, '#', '-')) || '-service/deploy_branch' AS slot, round(CASE WHEN s_suppkey % 5 > 0 THEN 100.0::DOUBLE * (s_suppkey % 7) / (s_suppkey % 5) ELSE 0 END, 6) AS pct FROM supplier",
}
