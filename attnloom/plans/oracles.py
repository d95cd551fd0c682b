"""SQL of the registered queries, in DuckDB's dialect, over the given tables.

Written relationally (joins, windows, recursion) and apart from the Spark code,
so that both sides have to agree on the semantics.
"""

from __future__ import annotations

from ..sources.prompts import JUDGE_PROMPTS, QA_PROMPTS
from ..sources.results import DATASET_NAMES

ORACLES: dict[str, str] = {}


def _r(expression: str, digits: int = 6) -> str:
    return f"CASE WHEN abs({expression}) < 0.5e-{digits} THEN 0.0 ELSE round({expression}, {digits}) END"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


# ---------------------------------------------------------------- model tables

EMB = """emb AS (
  SELECT CAST((vec_id // 3) % 4 AS INT) AS run_id, vec_id AS row_idx,
         CAST(vec_id % 3 AS INT) + 2 AS n, embedding, label
  FROM embeddings)"""
ATTENTION = f"""{EMB}, raw_attention AS (
  SELECT run_id, row_idx, n, CAST(i // 32 AS INT) AS layer, CAST((i // 16) % 2 AS INT) AS head,
         CAST((i // 4) % 4 AS INT) AS q, CAST(i % 4 AS INT) AS k,
         CAST(embedding[i + 1] AS DOUBLE) AS x
  FROM emb, range(0, 64) t(i)),
attention AS (
  SELECT run_id, row_idx, layer, head, q, k, n,
         exp(x) / sum(exp(x)) OVER (PARTITION BY row_idx, layer, head, q) AS w
  FROM raw_attention WHERE q < n AND k <= q)"""
LABELS = """labels_fx AS (
  SELECT run_id, row_idx, CASE WHEN row_idx % 17 = 0 THEN -1 WHEN label < 5 THEN 0 ELSE 1 END AS label FROM emb)"""
DIAGS = f"""{ATTENTION}, diags AS (
  SELECT run_id, row_idx, layer, head, k, max(n) AS n, sum(w) AS s, sum(w) FILTER (q = k) AS d
  FROM attention GROUP BY ALL)"""
LAP = f"""{DIAGS}, laps AS (SELECT *, s / (n - k) - d AS lap FROM diags)"""
USERS = """users AS (
  SELECT CAST(conv_id % 2 AS INT) AS run_id, conv_id * 100 + turn AS row_idx, conv_id, turn, text AS question
  FROM conversations WHERE role = 'user')"""
ANSWERS = f"""{USERS}, answered AS (
  SELECT u.*, c.text AS prediction, string_split(c.text, ' ') AS pieces
  FROM users u JOIN conversations c ON c.conv_id = u.conv_id AND c.turn = u.turn + 1 AND c.role = 'assistant'),
answers AS (
  SELECT run_id, row_idx, conv_id, turn, question, prediction,
         CASE row_idx % 5
           WHEN 0 THEN [lower(prediction)]
           WHEN 1 THEN [array_to_string(pieces[1:len(pieces) // 2], ' '), question]
           ELSE [question] END AS gold
  FROM answered)"""
JUDGE = """judge AS (
  SELECT run_id, row_idx,
         CASE (row_idx // 2) % 4 WHEN 0 THEN 'correct' WHEN 2 THEN 'refuse' ELSE 'incorrect' END AS verdict,
         length(question) AS input_tokens, 1 AS output_tokens, row_idx % 3 AS cache_read,
         CASE WHEN row_idx % 11 = 0 THEN 'length' ELSE 'stop' END AS finish_reason
  FROM answers)"""
GOLDS = """golds AS (
  SELECT run_id, row_idx, prediction, CAST(i AS INT) AS gold_idx, gold[i + 1] AS g
  FROM answers, range(0, 2) t(i) WHERE i < len(gold))"""


def _norm(x: str) -> str:
    return f"regexp_replace(lower({x}), '[[:punct:]]', '', 'g')"


def _norm_tokens(x: str) -> str:
    return f"list_filter(string_split_regex({_norm(x)}, '\\s+'), lambda t: t NOT IN ('', 'a', 'an', 'the'))"


def _rouge_tokens(x: str) -> str:
    return f"list_filter(string_split_regex(lower({x}), '[^a-z0-9]+'), lambda t: t <> '')"


def _overlap(prefix: str, tokens_p: str, tokens_g: str, source: str = "golds") -> str:
    """Bag overlap of every (answer, gold) pair: CTEs `<prefix>_pairs` and `<prefix>_f`."""
    return f"""{prefix}_pairs AS (
  SELECT run_id, row_idx, gold_idx, {tokens_p} AS pt, {tokens_g} AS gt FROM {source}),
{prefix}_p AS (SELECT row_idx, gold_idx, t, count(*) AS c FROM (SELECT row_idx, gold_idx, unnest(pt) AS t FROM {prefix}_pairs) GROUP BY ALL),
{prefix}_g AS (SELECT row_idx, gold_idx, t, count(*) AS c FROM (SELECT row_idx, gold_idx, unnest(gt) AS t FROM {prefix}_pairs) GROUP BY ALL),
{prefix}_o AS (
  SELECT p.row_idx, p.gold_idx, sum(least(p.c, g.c)) AS o
  FROM {prefix}_p p JOIN {prefix}_g g USING (row_idx, gold_idx, t) GROUP BY ALL),
{prefix}_f AS (
  SELECT run_id, row_idx, max(CASE
      WHEN len(pt) + len(gt) = 0 THEN {'1.0' if prefix == 'squad' else '0.0'}
      ELSE 2.0 * coalesce(o, 0) / (len(pt) + len(gt)) END) AS f
  FROM {prefix}_pairs LEFT JOIN {prefix}_o USING (row_idx, gold_idx) GROUP BY ALL)"""


SQUAD = f"""{GOLDS}, {_overlap('squad', _norm_tokens('prediction'), _norm_tokens('g'))},
squad_exact AS (SELECT run_id, row_idx, CAST(max(CASE WHEN pt = gt THEN 1.0 ELSE 0.0 END) AS DOUBLE) AS e FROM squad_pairs GROUP BY ALL),
squad AS (SELECT run_id, row_idx, f AS squad_f1, e AS squad_exact FROM squad_f JOIN squad_exact USING (run_id, row_idx))"""

ROUGE_L = f"""lcs_pairs AS (
  SELECT run_id, row_idx, gold_idx, {_rouge_tokens('prediction')} AS pt, {_rouge_tokens('g')} AS gt FROM golds),
lcs_g AS (SELECT row_idx, gold_idx, j, gt[j] AS t FROM (SELECT *, unnest(range(1, len(gt) + 1)) AS j FROM lcs_pairs)),
lcs_p AS (SELECT row_idx, gold_idx, i, pt[i] AS t FROM (SELECT *, unnest(range(1, len(pt) + 1)) AS i FROM lcs_pairs)),
dp AS (
  SELECT row_idx, gold_idx, CAST(0 AS BIGINT) AS i, j, 0 AS v FROM (SELECT *, unnest(range(0, len(gt) + 1)) AS j FROM lcs_pairs)
  UNION ALL
  SELECT row_idx, gold_idx, i + 1, j,
         max(cand) OVER (PARTITION BY row_idx, gold_idx ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
  FROM (
    SELECT d.row_idx, d.gold_idx, d.i, d.j,
           CASE WHEN g.t = p.t
                THEN lag(d.v) OVER (PARTITION BY d.row_idx, d.gold_idx ORDER BY d.j) + 1
                ELSE d.v END AS cand
    FROM dp d
    JOIN lcs_p p ON p.row_idx = d.row_idx AND p.gold_idx = d.gold_idx AND p.i = d.i + 1
    LEFT JOIN lcs_g g ON g.row_idx = d.row_idx AND g.gold_idx = d.gold_idx AND g.j = d.j)),
lcs AS (SELECT row_idx, gold_idx, max(v) AS o FROM dp GROUP BY ALL),
rouge_l AS (
  SELECT run_id, row_idx, max(CASE WHEN len(pt) + len(gt) = 0 THEN 0.0 ELSE 2.0 * o / (len(pt) + len(gt)) END) AS f
  FROM lcs_pairs JOIN lcs USING (row_idx, gold_idx) GROUP BY ALL)"""


def _ranking(source: str, group: str, single_class_null: bool = False) -> str:
    """AUC by mid-ranks and AP by running counts over `source(<group>, label, score)`."""
    return f"""ranked AS (
  SELECT *, rank() OVER (PARTITION BY {group} ORDER BY score)
            + (count(*) OVER (PARTITION BY {group}, score) - 1) / 2.0 AS mid
  FROM {source}),
auc AS (
  SELECT {group}, count(*) FILTER (label = 1) AS n_pos, count(*) FILTER (label = 0) AS n_neg,
         (sum(mid) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0)
           / nullif(count(*) FILTER (label = 1) * count(*) FILTER (label = 0), 0) AS auc
  FROM ranked GROUP BY {group}),
steps AS (
  SELECT {group}, score, count(*) FILTER (label = 1) AS pos, count(*) AS every FROM {source} GROUP BY {group}, score),
cumulated AS (
  SELECT *, sum(pos) OVER w AS tp, sum(every) OVER w AS taken FROM steps
  WINDOW w AS (PARTITION BY {group} ORDER BY score DESC)),
ap AS (SELECT {group}, coalesce(sum(pos * tp / taken) / nullif(sum(pos), 0), 0.0) AS ap FROM cumulated GROUP BY {group})"""


SCORE = f"""{DIAGS}, heads AS (
  SELECT run_id, row_idx, layer, head, avg(ln(d)) AS ld FROM diags GROUP BY ALL),
layer_scores AS (SELECT run_id, row_idx, layer, -sum(ld) AS score FROM heads GROUP BY ALL)"""


def _order(seed: str) -> str:
    return f"(row_idx * 7919 + {seed}) % 10007, row_idx"


def _quota(source: str, run: str, n_train: str) -> str:
    return f"""sized AS (
  SELECT {run}, label, count(*) AS n, sum(count(*)) OVER (PARTITION BY {run}) AS n_total FROM {source} GROUP BY {run}, label),
wanted AS (SELECT *, CAST({n_train} AS BIGINT) AS n_train FROM sized),
shares AS (
  SELECT *, CAST(n_train * n // n_total AS BIGINT) AS base, n_train * n % n_total AS rest FROM wanted),
quota AS (
  SELECT {run}, label, base + CASE WHEN row_number() OVER (PARTITION BY {run} ORDER BY rest DESC, label)
           <= n_train - sum(base) OVER (PARTITION BY {run}) THEN 1 ELSE 0 END AS quota FROM shares)"""


SPLIT = f"""valid AS (SELECT * FROM labels_fx WHERE label IN (0, 1)), {_quota('valid', 'run_id', 'n_total - ceil(n_total * 0.2)')},
placed AS (SELECT *, row_number() OVER (PARTITION BY run_id, label ORDER BY {_order('42')}) AS rk FROM valid),
split AS (
  SELECT p.run_id, row_idx, p.label, CASE WHEN rk <= quota THEN 'train' ELSE 'test' END AS part
  FROM placed p JOIN quota USING (run_id, label))"""

# ---------------------------------------------------------------- attention maps

ORACLES["attn_score_auc_by_layer"] = f"""WITH {SCORE}, {LABELS},
scored AS (SELECT s.*, l.label FROM layer_scores s JOIN labels_fx l USING (run_id, row_idx) WHERE l.label IN (0, 1)),
{_ranking('scored', 'run_id, layer')}
SELECT run_id, layer, n_pos, n_neg, {_r('auc')} AS auc FROM auc"""

ORACLES["attn_score_eval"] = f"""WITH {SCORE}, {LABELS}, {SPLIT},
all_scores AS (
  SELECT run_id, row_idx, CAST(layer AS VARCHAR) AS layer, score FROM layer_scores
  UNION ALL SELECT run_id, row_idx, 'all', avg(score) FROM layer_scores GROUP BY run_id, row_idx),
scored AS (SELECT s.*, part, label FROM all_scores s JOIN split USING (run_id, row_idx)),
{_ranking('scored', 'run_id, layer, part')}
SELECT run_id, layer, part, n_pos, n_neg, {_r('auc')} AS auc, {_r('ap')} AS average_precision
FROM auc JOIN ap USING (run_id, layer, part)"""

_HEAD = "run_id, row_idx, layer, head"
ORACLES["attn_diag"] = f"WITH {DIAGS} SELECT {_HEAD}, k, {_r('d')} AS w FROM diags"
ORACLES["lap_diag"] = f"WITH {LAP} SELECT {_HEAD}, k, {_r('lap')} AS lap FROM laps"
ORACLES["lap_diag_vertical"] = f"""WITH {DIAGS}, v AS (
  SELECT *, CASE WHEN layer > 0 THEN (s + 1.0) / (n - k + 1) - d ELSE s / (n - k) - d END AS lap FROM diags)
SELECT {_HEAD}, k, {_r('lap')} AS lap FROM v"""
ORACLES["diagonals_from_steps"] = f"WITH {LAP} SELECT {_HEAD}, k, {_r('d')} AS attn, {_r('lap')} AS lap FROM laps"
ORACLES["lap_diag_refined"] = f"""WITH {DIAGS}, up AS (
  SELECT *, lead(d) OVER (PARTITION BY row_idx, head, k ORDER BY layer) AS above,
         max(layer) OVER (PARTITION BY row_idx, head) AS top FROM diags),
refined AS (
  SELECT *, CASE WHEN layer = 0 THEN (s + above) / (n - k + 1) - d
                 WHEN layer = top AND k = n - 1 THEN 0.0
                 WHEN layer = top THEN (s - d) / (n - k - 1)
                 ELSE (s - d + above) / (n - k) END AS lap FROM up)
SELECT {_HEAD}, k, {_r('lap')} AS lap FROM refined"""
ORACLES["full_laplacian_edges"] = f"""WITH {ATTENTION}, adjacency AS (
  SELECT run_id, row_idx, head, layer * n + q AS r,
         CASE WHEN q = k AND layer > 0 THEN (layer - 1) * n + k ELSE layer * n + k END AS c, w
  FROM attention WHERE w <> 0),
degree AS (SELECT run_id, row_idx, head, c, avg(w) AS deg FROM adjacency GROUP BY ALL),
entries AS (
  SELECT run_id, row_idx, head, r, c, -w AS v FROM adjacency
  UNION ALL SELECT run_id, row_idx, head, c, c, deg FROM degree),
summed AS (SELECT run_id, row_idx, head, r, c, sum(v) AS v FROM entries GROUP BY ALL)
SELECT run_id, row_idx, head, r, c, {_r('v')} AS value FROM summed"""
_LOG_DET = f"{DIAGS}, ld AS (SELECT {_HEAD}, avg(ln(d)) AS log_det FROM diags GROUP BY ALL)"
ORACLES["attn_log_det"] = f"WITH {_LOG_DET} SELECT {_HEAD}, {_r('log_det')} AS log_det FROM ld"
ORACLES["attn_log_det_features"] = f"""WITH {_LOG_DET}
SELECT run_id, row_idx, layer * 2 + head AS pos, {_r('log_det')} AS v FROM ld"""
_TOP = """top AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY row_idx, layer, head ORDER BY {v} DESC) AS INT) AS rk FROM laps),
kept AS (SELECT *, {v} AS v FROM top WHERE rk <= 2)"""
ORACLES["attn_topk"] = f"""WITH {LAP}, {_TOP.format(v='d')}
SELECT run_id, row_idx, CAST((layer * 2 + head) * 2 + rk - 1 AS INT) AS pos, {_r('v')} AS v FROM kept"""
ORACLES["lap_topk"] = f"""WITH {LAP}, {_TOP.format(v='lap')}
SELECT run_id, row_idx, layer, CAST(head * 2 + rk - 1 AS INT) AS pos, {_r('v')} AS v FROM kept"""
ORACLES["lap_topk_stats"] = f"""WITH {LAP}, {_TOP.format(v='lap')}, stats AS (
  SELECT {_HEAD}, avg(v) AS mean, stddev_samp(v) AS std,
         quantile_cont(v, 0.01) AS q01, quantile_cont(v, 0.05) AS q05, quantile_cont(v, 0.25) AS q25,
         quantile_cont(v, 0.5) AS q50, quantile_cont(v, 0.95) AS q95, quantile_cont(v, 0.99) AS q99
  FROM kept GROUP BY ALL)
SELECT {_HEAD}, {', '.join(f"{_r(c)} AS {c}" for c in ('mean', 'std', 'q01', 'q05', 'q25', 'q50', 'q95', 'q99'))} FROM stats"""
ORACLES["eligible_topk"] = f"""WITH {EMB}, shortest AS (SELECT run_id, min(n) AS min_len FROM emb GROUP BY ALL)
SELECT run_id, min_len, CAST(k AS INT) AS top_k FROM shortest, range(1, 6) t(k) WHERE k <= min_len"""

# ---------------------------------------------------------------- padding and stacking

TOKENS = """words AS (
  SELECT lang AS run_id, doc_id AS row_idx, list_transform(string_split_regex(text, '\\s+'), lambda w: CAST(length(w) % 10 + 1 AS INT)) AS ids
  FROM documents),
padded AS (
  SELECT run_id, row_idx,
    list_concat(list_concat(list_transform(range(0, row_idx % 3), lambda x: 0),
      CASE WHEN row_idx % 2 = 0 AND len(ids) > 3 THEN list_concat(list_append(ids[1:3], 0), ids[5:]) ELSE ids END),
      list_transform(range(0, row_idx % 4), lambda x: 0)) AS token_ids
  FROM words),
tokens AS (
  SELECT run_id, row_idx, CASE WHEN row_idx % 50 = 0 THEN list_transform(token_ids, lambda t: 0) ELSE token_ids END AS token_ids,
         CAST(len(token_ids) // 2 AS INT) AS input_length FROM padded)"""
ORACLES["strip_edge_padding"] = f"""WITH {TOKENS}, flat AS (
  SELECT run_id, row_idx, unnest(range(0, len(token_ids))) AS i, unnest(token_ids) AS t FROM tokens),
bounds AS (SELECT run_id, row_idx, count(*) AS n, min(i) FILTER (t <> 0) AS a, max(i) FILTER (t <> 0) AS b FROM flat GROUP BY ALL),
full_bounds AS (SELECT run_id, row_idx, coalesce(a, 0) AS a, coalesce(b, n - 1) AS b FROM bounds)
SELECT run_id, row_idx, CAST(a AS INT) AS first, CAST(b AS INT) AS last,
       string_agg(CAST(t AS VARCHAR), ' ' ORDER BY i) AS ids
FROM flat JOIN full_bounds USING (run_id, row_idx) WHERE i BETWEEN a AND b GROUP BY run_id, row_idx, a, b"""
ORACLES["strip_all_padding"] = f"""WITH {TOKENS}, shifted AS (
  SELECT run_id, row_idx, input_length, token_ids[2:] AS ids FROM tokens)
SELECT run_id, row_idx, CAST(input_length - len(list_filter(ids[1:input_length], lambda t: t = 0)) - 1 AS INT) AS last_input_idx,
       CAST(len(list_filter(ids, lambda t: t <> 0)) AS INT) AS n_kept,
       array_to_string(list_filter(ids, lambda t: t <> 0), ' ') AS ids
FROM shifted"""
STATES = f"""{EMB}, states AS (
  SELECT run_id, row_idx, CAST(i // 32 AS INT) AS layer, CAST((i // 8) % 4 AS INT) AS tok_idx, CAST(i % 8 AS INT) AS dim,
         CAST(embedding[i + 1] AS DOUBLE) AS v
  FROM emb, range(0, 64) t(i))"""
STATE_TOKENS = """toks AS (
  SELECT run_id, row_idx, CAST(p AS INT) AS pos, CAST((row_idx + p) % 35 AS INT) AS token_id,
         (row_idx + p) % 35 % 5 = 0 AS is_special, (row_idx + p) % 35 % 7 = 0 AS is_added
  FROM emb, range(0, 5) t(p))"""
ORACLES["strip_hidden_states"] = f"""WITH {STATES}, {STATE_TOKENS},
kept AS (
  SELECT run_id, row_idx, pos - 1 AS old, token_id,
         CAST(row_number() OVER (PARTITION BY row_idx ORDER BY pos) - 1 AS INT) AS new_idx
  FROM toks WHERE pos >= 1 AND NOT is_special),
last_in AS (
  SELECT row_idx, CAST(3 - count(*) FILTER (is_special AND pos BETWEEN 1 AND 3) - 1 AS INT) AS last_input_idx FROM toks GROUP BY ALL)
SELECT s.run_id, s.row_idx, layer, new_idx AS tok_idx, token_id, last_input_idx, dim, {_r('v')} AS v
FROM states s JOIN kept ON kept.row_idx = s.row_idx AND kept.old = s.tok_idx JOIN last_in ON last_in.row_idx = s.row_idx"""
_STRIPPED = f"""WITH {ATTENTION}, shape AS (
  SELECT row_idx, n, CAST(row_idx % 3 AS INT) AS l, CAST(row_idx % 2 AS INT) AS r FROM emb),
padded AS (
  SELECT a.run_id, a.row_idx, layer, head, q + l AS q, k + l AS k, w FROM attention a JOIN shape USING (row_idx)
  UNION ALL
  SELECT e.run_id, e.row_idx, CAST(lh // 2 AS INT), CAST(lh % 2 AS INT), CAST(p AS INT), CAST(p AS INT), 1.0
  FROM emb e JOIN shape s USING (row_idx), range(0, 4) h(lh), range(0, 8) t(p)
  WHERE p < s.l OR (p >= s.l + s.n AND p < s.l + s.n + s.r)),
ids AS (
  SELECT row_idx, CAST(p AS INT) AS p, CASE WHEN p >= l AND p < l + n THEN 7 ELSE 0 END AS t
  FROM shape, range(0, 8) g(p) WHERE p < l + n + r),
keep AS (SELECT row_idx, min(p) FILTER (t <> 0) AS a, max(p) FILTER (t <> 0) AS b FROM ids GROUP BY ALL)
SELECT run_id, p.row_idx, layer, head, q - a AS q, k - a AS k, b - a + 1 AS n, {_r('w')} AS w
FROM padded p JOIN keep ON keep.row_idx = p.row_idx WHERE q BETWEEN a AND b AND k BETWEEN a AND b"""
ORACLES["strip_attention_padding"] = _STRIPPED
ORACLES["strip_attention_padding_edges"] = _STRIPPED
ORACLES["stack_attention"] = f"""WITH {ATTENTION}, grid AS (
  SELECT run_id, row_idx, n, CAST(lh // 2 AS INT) AS layer, CAST(lh % 2 AS INT) AS head, CAST(q AS INT) AS q, CAST(k AS INT) AS k
  FROM emb, range(0, 4) h(lh), range(0, 4) a(q), range(0, 4) b(k) WHERE q < n AND k < n)
SELECT g.run_id, g.row_idx, g.layer, g.head, g.q, g.k, g.n, {_r('coalesce(w, 0.0)')} AS w
FROM grid g LEFT JOIN attention a USING (row_idx, layer, head, q, k)"""

# ---------------------------------------------------------------- hidden states

ORACLES["layer_states"] = f"WITH {STATES} SELECT run_id, row_idx, layer, tok_idx, dim, {_r('v')} AS v FROM states"
_LAST = """ok AS (SELECT row_idx, pos - 1 AS i FROM toks WHERE pos >= 1 AND NOT (is_special OR is_added)),
marks AS (
  SELECT e.row_idx, coalesce(max(i) FILTER (i < 2), 1) AS in_idx, coalesce(max(i) FILTER (i >= 2), 3) AS gen_idx
  FROM emb e LEFT JOIN ok ON ok.row_idx = e.row_idx GROUP BY e.row_idx),
chosen AS (
  SELECT row_idx, 'input' AS which, CAST(in_idx AS INT) AS tok_idx FROM marks
  UNION ALL SELECT row_idx, 'generated', CAST(gen_idx AS INT) FROM marks)"""
ORACLES["select_last_token_states"] = f"""WITH {STATES}, {STATE_TOKENS}, {_LAST}
SELECT run_id, s.row_idx, layer, which, s.tok_idx, dim, {_r('v')} AS v
FROM states s JOIN chosen c ON c.row_idx = s.row_idx AND c.tok_idx = s.tok_idx"""
ORACLES["last_layer_features"] = f"""WITH {STATES}, {STATE_TOKENS}, {_LAST}
SELECT run_id, s.row_idx, which, dim, {_r('v')} AS v
FROM states s JOIN chosen c ON c.row_idx = s.row_idx AND c.tok_idx = s.tok_idx WHERE layer = 1"""
ORACLES["token_masks"] = f"WITH {EMB}, {STATE_TOKENS} SELECT run_id, row_idx, pos, token_id, is_special, is_added FROM toks"
ORACLES["single_layer_dataset"] = f"""WITH {STATES}, {LABELS}, sums AS (
  SELECT run_id, row_idx, layer, tok_idx, sum(v) AS s FROM states WHERE layer = 1 GROUP BY ALL)
SELECT s.run_id, s.row_idx, layer, tok_idx, 'p' || s.row_idx AS prediction, {_r('s.row_idx % 7 / 7.0')} AS squad_f1,
       CASE WHEN label = 1 THEN 'incorrect' ELSE 'correct' END AS verdict, label, {_r('s')} AS vec_sum
FROM sums s JOIN labels_fx l USING (run_id, row_idx) WHERE label IN (0, 1)"""

# ---------------------------------------------------------------- ranking metrics

SCORES = """scores AS (
  SELECT lang AS run_id, doc_id AS row_idx, 1 - quality AS label, (n_chars % 20) / 20.0 AS score, toxic AS pred
  FROM documents JOIN labels USING (doc_id))"""
ORACLES["score_auc_ap"] = f"""WITH {SCORES}, {_ranking('scores', 'run_id')}
SELECT run_id, n_pos, n_neg, {_r('auc')} AS auc, {_r('ap')} AS average_precision FROM auc JOIN ap USING (run_id)"""
ORACLES["confusion_metrics"] = f"""WITH {SCORES}, c AS (
  SELECT run_id, count(*) FILTER (label = 1 AND pred = 1) AS tp, count(*) FILTER (label = 0 AND pred = 1) AS fp,
         count(*) FILTER (label = 1 AND pred = 0) AS fn FROM scores GROUP BY run_id),
m AS (
  SELECT *, coalesce(tp / nullif(tp + fp, 0), 0.0) AS p, coalesce(tp / nullif(tp + fn, 0), 0.0) AS r FROM c)
SELECT run_id, tp, fp, fn, {_r('p')} AS precision, {_r('r')} AS recall,
       {_r('coalesce(2 * p * r / nullif(p + r, 0), 0.0)')} AS f1 FROM m"""

ORACLES["single_layer_stripped"] = f"""WITH {STATES}, {STATE_TOKENS}, {LABELS},
kept AS (
  SELECT run_id, row_idx, pos - 1 AS old, token_id, CAST(row_number() OVER (PARTITION BY row_idx ORDER BY pos) - 1 AS INT) AS new_idx
  FROM toks WHERE pos >= 1 AND NOT is_special),
lists AS (SELECT row_idx, string_agg(token_id::VARCHAR, ',' ORDER BY old) AS gen_tokens FROM kept GROUP BY ALL),
last_in AS (
  SELECT row_idx, CAST(3 - count(*) FILTER (is_special AND pos BETWEEN 1 AND 3) - 1 AS INT) AS last_input_token_idx FROM toks GROUP BY ALL),
sums AS (SELECT run_id, row_idx, layer, tok_idx, sum(v) AS s FROM states WHERE layer = 1 GROUP BY ALL)
SELECT s.run_id, s.row_idx, layer, new_idx AS tok_idx, label, gen_tokens, last_input_token_idx, {_r('s')} AS vec_sum
FROM sums s JOIN kept ON kept.row_idx = s.row_idx AND kept.old = s.tok_idx JOIN lists ON lists.row_idx = s.row_idx
JOIN last_in ON last_in.row_idx = s.row_idx JOIN labels_fx l ON l.run_id = s.run_id AND l.row_idx = s.row_idx WHERE label IN (0, 1)"""
ORACLES["size_study_summary"] = f"""WITH {SCORES}, drawn AS (
  SELECT run_id, row_idx, label, score, frac, seed FROM scores, (VALUES (0.5), (1.0)) f(frac), (VALUES (0), (1), (2)) g(seed)
  WHERE frac = 1.0 OR (row_idx + seed) % 3 < 2), {_ranking('drawn', 'run_id, frac, seed')}
SELECT run_id, 'score' AS probe, frac::DOUBLE AS frac, round(avg(auc), 4) AS mean, round(stddev_samp(auc), 4) AS std FROM auc GROUP BY run_id, frac"""
ORACLES["halueval_questions"] = """SELECT substr(text, 1, 60) AS question, source AS answer, 1 AS n_messages,
  'Answer the following question as briefly as possible.' || chr(10) || 'Question: ' || substr(text, 1, 60) || chr(10) || 'Answer:' || chr(10) AS content
FROM documents WHERE text IS NOT NULL"""
ORACLES["nq_open_default_split"] = """SELECT item_id, substr(text, 1, 40) AS question, substr(text, 1, 5) AS first_answer, 'validation' AS split
FROM benchmark WHERE text IS NOT NULL AND item_id % 3 = 0"""
ORACLES["stored_answers_json"] = "SELECT doc_id AS row_idx, source AS prediction, concat_ws('|', lang, source) AS gold FROM documents"

# ---------------------------------------------------------------- questions, answers, judges

ORACLES["qa_prompts"] = f"WITH {USERS} " + " UNION ALL ".join(
    f"SELECT run_id, row_idx, {_text(name)} AS prompt, 'user' AS role, "
    + f"replace({_text(p.content)}, '{{question}}', question) AS content FROM users"
    for name, p in QA_PROMPTS.items()
)
_GOLD_TEXT = (
    "'[' || array_to_string(list_transform(gold, lambda g: '''' || replace(replace(g, '\\', '\\\\'), chr(10), '\\n') || ''''), ', ') || ']'"
)


def _judge_content(name: str, gold: str) -> str:
    content = JUDGE_PROMPTS[name].content.removesuffix("\n")
    result = _text(content)
    for key, value in (("gold_answer", gold), ("predicted_answer", "prediction"), ("question", "question")):
        result = f"replace(replace({result}, '{{{{{key}}}}}', {value}), '{{{{ {key} }}}}', {value})"
    return result


def _judge_flat(name: str) -> str:
    system = JUDGE_PROMPTS[name].system_prompt
    user = f"'user' || chr(31) || content"
    return user if system is None else f"'system' || chr(31) || {_text(system)} || chr(30) || {user}"


def _requests(name: str) -> str:
    return f"""(SELECT *, sha256({_judge_flat(name)}) AS request_key
  FROM (SELECT run_id, row_idx, prediction, {_judge_content(name, _GOLD_TEXT)} AS content FROM answers))"""


_system = _text(JUDGE_PROMPTS["qa_eval"].system_prompt)
ORACLES["judge_messages"] = f"""WITH {ANSWERS}, a AS {_requests('qa_eval')}, b AS {_requests('qa_orgad_et_al_eval')}
SELECT run_id, row_idx, 'qa_eval' AS judge_prompt, request_key, 0 AS pos, 'system' AS role, {_system} AS content FROM a
UNION ALL SELECT run_id, row_idx, 'qa_eval', request_key, 1, 'user', content FROM a
UNION ALL SELECT run_id, row_idx, 'qa_orgad_et_al_eval', request_key, 0, 'user', content FROM b"""
ORACLES["judge_requests_per_gold"] = f"""WITH {ANSWERS}, asked AS (
  SELECT run_id, row_idx, CAST(i AS INT) AS gold_idx, question, prediction, gold[i + 1] AS g
  FROM answers, range(0, 2) t(i) WHERE i < len(gold)),
c AS (SELECT *, {_judge_content('qa_multi_answers_eval_short', 'g')} AS content FROM asked)
SELECT run_id, row_idx, gold_idx, sha256('user' || chr(31) || content) AS request_key, content FROM c"""
ORACLES["combine_verdicts"] = f"""WITH {ANSWERS}, {GOLDS}, v AS (
  SELECT run_id, row_idx, CASE ((row_idx + gold_idx) // 2) % 4
    WHEN 0 THEN 'correct' WHEN 2 THEN 'refuse' WHEN 3 THEN 'unclear' ELSE 'incorrect' END AS verdict FROM golds),
p AS (SELECT *, CASE verdict WHEN 'correct' THEN 1 WHEN 'incorrect' THEN 2 WHEN 'refuse' THEN 3 END AS rk FROM v)
SELECT run_id, row_idx, arg_min(verdict, rk) AS verdict FROM p GROUP BY ALL"""
_CACHE = f"""requests AS {_requests('qa_eval')}, {JUDGE},
cache AS (
  SELECT request_key, max(verdict) AS verdict FROM requests JOIN judge USING (run_id, row_idx)
  WHERE length(prediction) > 800 GROUP BY ALL)"""
ORACLES["uncached_judge_requests"] = f"""WITH {ANSWERS}, {_CACHE}
SELECT DISTINCT request_key, 2 AS n_messages FROM requests WHERE request_key NOT IN (SELECT request_key FROM cache)"""
ORACLES["cached_judge_verdicts"] = f"""WITH {ANSWERS}, {_CACHE}
SELECT run_id, row_idx, request_key, verdict FROM requests LEFT JOIN cache USING (request_key)"""
ORACLES["judge_usage"] = f"""WITH {ANSWERS}, {JUDGE}
SELECT run_id, count(*) AS total_api_calls, CAST(sum(input_tokens) AS BIGINT) AS total_input_tokens,
       CAST(sum(output_tokens) AS BIGINT) AS total_output_tokens, CAST(sum(cache_read) AS BIGINT) AS total_cached_input_tokens,
       count(*) FILTER (finish_reason = 'stop') AS n_stop, count(*) FILTER (finish_reason = 'length') AS n_length
FROM judge GROUP BY run_id"""
ORACLES["squad_f1"] = f"WITH {ANSWERS}, {SQUAD} SELECT run_id, row_idx, {_r('squad_f1')} AS squad_f1, squad_exact FROM squad"
ORACLES["rouge_l"] = f"WITH RECURSIVE {ANSWERS}, {GOLDS}, {ROUGE_L} SELECT run_id, row_idx, {_r('f')} AS rougeL_fmeasure FROM rouge_l"


def _bigrams(tokens: str) -> str:
    return f"list_transform(range(1, len({tokens})), lambda i: {tokens}[i] || ' ' || {tokens}[i + 1])"


ORACLES["rouge_n"] = f"""WITH {ANSWERS}, {GOLDS}, {_overlap('r1', _rouge_tokens('prediction'), _rouge_tokens('g'))},
{_overlap('r2', _bigrams('pt'), _bigrams('gt'), 'r1_pairs')}
SELECT a.run_id, row_idx, {_r('a.f')} AS rouge1_fmeasure, {_r('b.f')} AS rouge2_fmeasure
FROM r1_f a JOIN r2_f b USING (row_idx)"""
ORACLES["qa_metrics_reduced"] = f"""WITH RECURSIVE {ANSWERS}, {SQUAD}, {ROUGE_L}, m AS (
  SELECT s.run_id, avg(squad_f1) AS a, avg(squad_exact) AS b, avg(f) AS c FROM squad s JOIN rouge_l USING (run_id, row_idx) GROUP BY ALL)
SELECT run_id, {_r('a')} AS squad_f1, {_r('b')} AS squad_exact, {_r('c')} AS rougeL_fmeasure FROM m"""
ORACLES["labels_judge"] = f"""WITH RECURSIVE {ANSWERS}, {SQUAD}, {ROUGE_L}, {JUDGE}, l AS (
  SELECT run_id, row_idx, CASE
    WHEN squad_f1 >= 0.99 OR f >= 0.99 THEN 0
    WHEN verdict = 'incorrect' AND f >= 0.75 THEN -1
    WHEN verdict = 'correct' THEN 0 WHEN verdict = 'incorrect' THEN 1 ELSE -1 END AS label
  FROM squad JOIN rouge_l USING (run_id, row_idx) JOIN judge USING (run_id, row_idx))
SELECT run_id, row_idx, label, label <> -1 AS valid FROM l"""
MATHS = """maths AS (
  SELECT CAST(o_custkey % 2 AS INT) AS run_id, o_orderkey AS row_idx, CAST(floor(o_totalprice) AS BIGINT) AS v,
         CASE o_orderkey % 4
           WHEN 0 THEN 'The final answer is ' || CAST(floor(o_totalprice) AS BIGINT) || '.'
           WHEN 1 THEN 'So we add. The final answer is $' || format('{:,}', CAST(floor(o_totalprice) AS BIGINT)) || '.'
           WHEN 2 THEN 'The final answer is ' || (CAST(floor(o_totalprice) AS BIGINT) + 1)
           ELSE 'I cannot tell.' END AS prediction
  FROM orders),
found AS (
  SELECT run_id, row_idx, CAST(v AS VARCHAR) AS exact_answer,
         regexp_extract(prediction, 'The final answer is ((-?[$0-9.,]{2,})|(-?[0-9]+))', 1) AS f FROM maths),
maths_labels AS (
  SELECT run_id, row_idx, exact_answer,
         CASE WHEN f <> '' THEN regexp_replace(replace(replace(f, ',', ''), '$', ''), '\\.$', '') END AS final_answer FROM found),
maths_final AS (
  SELECT *, CASE WHEN final_answer IS NULL THEN -1 WHEN final_answer <> exact_answer THEN 1 ELSE 0 END AS label FROM maths_labels)"""
ORACLES["labels_gsm8k"] = f"""WITH {MATHS}
SELECT run_id, row_idx, final_answer, exact_answer, label, label <> -1 AS valid FROM maths_final"""
ORACLES["gsm8k_accuracy"] = f"""WITH {MATHS}, c AS (
  SELECT run_id, count(*) FILTER (label = -1) AS n_missing, count(*) FILTER (label = 1) AS n_incorrect,
         count(*) FILTER (label = 0) AS n_correct FROM maths_final GROUP BY ALL)
SELECT *, {_r('n_correct / (n_correct + n_incorrect)')} AS accuracy FROM c"""

# ---------------------------------------------------------------- sampling

ORACLES["stratified_split"] = f"WITH {EMB}, {LABELS}, {SPLIT} SELECT run_id, row_idx, label, part FROM split"
ORACLES["split_stats"] = f"""WITH {EMB}, {LABELS}, {SPLIT}, c AS (
  SELECT run_id, coalesce(part, 'total') AS part, count(*) FILTER (label = 0) AS n_correct,
         count(*) FILTER (label = 1) AS n_incorrect, count(*) AS n_total
  FROM split GROUP BY GROUPING SETS ((run_id, part), (run_id)))
SELECT *, round(n_incorrect / n_correct, 3) AS ratio FROM c"""
ORACLES["train_fraction"] = f"""WITH {EMB}, {LABELS}, {SPLIT}, spread AS (
  SELECT split.*, frac, seed FROM split,
    (SELECT CAST(unnest([0.1, 0.5, 1.0]) AS DOUBLE) AS frac), (SELECT CAST(unnest([42, 123]) AS INT) AS seed)),
counted AS (
  SELECT run_id, frac, seed, label, count(*) AS n, sum(count(*)) OVER (PARTITION BY run_id, frac, seed) AS n_total
  FROM spread WHERE part = 'train' GROUP BY run_id, frac, seed, label),
w AS (SELECT *, CAST(floor(n_total * frac) AS BIGINT) AS n_train FROM counted),
s AS (SELECT *, CAST(n_train * n // n_total AS BIGINT) AS base, n_train * n % n_total AS rest FROM w),
q AS (
  SELECT run_id, frac, seed, label, base + CASE WHEN row_number() OVER (PARTITION BY run_id, frac, seed ORDER BY rest DESC, label)
           <= n_train - sum(base) OVER (PARTITION BY run_id, frac, seed) THEN 1 ELSE 0 END AS quota FROM s),
p AS (
  SELECT *, row_number() OVER (PARTITION BY run_id, frac, seed, label ORDER BY {_order('seed')}) AS rk FROM spread WHERE part = 'train')
SELECT run_id, row_idx, label, part, frac, seed FROM p JOIN q USING (run_id, frac, seed, label) WHERE rk <= quota
UNION ALL SELECT run_id, row_idx, label, part, frac, seed FROM spread WHERE part = 'test'"""
ORACLES["balanced_sample"] = f"""WITH {EMB}, {LABELS}, spread AS (
  SELECT l.*, seed FROM labels_fx l, (SELECT CAST(unnest([42, 123, 456]) AS INT) AS seed) WHERE label IN (0, 1)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY run_id, seed, label ORDER BY {_order('seed')}) AS rk FROM spread)
SELECT run_id, seed, row_idx, label, CASE WHEN rk <= 32 THEN 'train' ELSE 'test' END AS part FROM ranked WHERE rk <= 40"""
ORACLES["length_sort"] = """SELECT doc_id AS row_idx, CAST(length(text) AS INT) AS length,
  row_number() OVER (ORDER BY length(text) DESC, doc_id) - 1 AS pos FROM documents"""


def _uniform(stream: int, cell: bool) -> str:
    terms = "CAST(run_id AS BIGINT) * 31 + row_idx * 7919 + CAST(round(tag * 100000) AS BIGINT) * 104729 + CAST(rep AS BIGINT) * 1299709"
    if cell:
        terms += " + CAST(layer AS BIGINT) * 15485863 + CAST(head AS BIGINT) * 32452843 + CAST(k AS BIGINT) * 49979687"
    return f"((({stream * 67867967}::BIGINT + {terms}) % 10007 + 0.5) / 10007.0)"


ORACLES["perturbation_l2"] = f"""WITH {LAP}, spread AS (
  SELECT *, coalesce(std, 0.0) AS tag FROM laps,
    (SELECT unnest([0.001, 0.1, NULL]::DOUBLE[]) AS std), (SELECT CAST(unnest([0, 1]) AS INT) AS rep)),
u AS (
  SELECT *, {_uniform(1, True)} AS u1, 0.5 + 0.5 * {_uniform(0, False)} AS fraction,
         sqrt(-2.0 * ln({_uniform(2, True)})) * cos(6.283185307179586 * {_uniform(3, True)}) AS z FROM spread),
m AS (
  SELECT *, row_number() OVER (PARTITION BY row_idx, std, rep ORDER BY u1, layer, head, k) AS rk,
         count(*) OVER (PARTITION BY row_idx, std, rep) AS total FROM u),
c AS (
  SELECT *, CASE WHEN std IS NULL THEN 0.0 WHEN rk <= floor(total * fraction) THEN z * std ELSE 0.0 END AS noise FROM m),
i AS (
  SELECT run_id, row_idx, std, rep, sqrt(sum(noise * noise)) AS l2, max(CASE WHEN std IS NULL THEN 0.0 ELSE fraction END) AS f
  FROM c GROUP BY ALL),
a AS (SELECT run_id, std, rep, avg(l2) AS l2, avg(f) AS f FROM i GROUP BY ALL)
SELECT run_id, std, rep, {_r('l2')} AS avg_diff_l2_norm, {_r('f')} AS avg_perturbation_fraction FROM a"""

# ---------------------------------------------------------------- sources

ORACLES["flatten_coqa"] = f"""WITH {ANSWERS}
SELECT conv_id AS sample_idx, 'c' || conv_id || '_' || (row_number() OVER w - 1) AS id,
       first_value(question) OVER w AS story, first_value(question) OVER w || ' Q: ' || question || ' A:' AS question,
       prediction AS answer, '+' || prediction || '|' || lower(prediction) || '|' || reverse(question) AS additional
FROM answers WINDOW w AS (PARTITION BY conv_id ORDER BY turn)"""
ORACLES["flatten_squad"] = f"""WITH {ANSWERS}, p AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS sample_idx FROM answers)
SELECT sample_idx, 0 AS question_idx, 'q' || row_idx AS id, prediction AS context, question, gold[1] AS first_text,
       CAST(length(gold[1]) AS INT) AS answer_start, array_to_string(list_sort(list_distinct(gold)), '|') AS answers
FROM p WHERE length(question) <= length(prediction)"""
ORACLES["first_wins_dedup"] = f"""SELECT o_custkey, o_orderkey, o_orderpriority, {_r('o_totalprice', 2)} AS o_totalprice
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rk FROM orders) WHERE rk = 1"""
_A, _B = "llm_judge_gpt_4o_mini_qa_eval", "llm_judge_gpt_4o_mini_qa_orgad_et_al_eval"
ORACLES["metrics_pivot"] = f"""WITH {ANSWERS}, {SQUAD}, {JUDGE}
SELECT u.run_id, u.row_idx, u.question, {_r('squad_f1')} AS squad_f1, verdict AS {_A},
       CASE WHEN verdict = 'refuse' THEN 'incorrect' ELSE verdict END AS {_B}
FROM users u LEFT JOIN squad s USING (row_idx) LEFT JOIN judge j USING (row_idx)"""
ORACLES["qa_with_metrics"] = f"""WITH {ANSWERS}, {SQUAD}
SELECT u.run_id, u.row_idx, question, {_r('squad_f1')} AS squad_f1, squad_exact FROM users u JOIN squad USING (row_idx)"""
ORACLES["run_metadata"] = """WITH named AS (
  SELECT CASE WHEN l_returnflag = 'R' THEN 'greedy' ELSE 'temp_' || l_discount END || '__prompt_qa_' || lower(l_linestatus)
         || '__seed_' || l_linenumber AS run_name,
         CASE WHEN l_returnflag = 'R' THEN 'greedy' ELSE printf('%.3f', l_discount) END AS temp,
         'prompt_qa_' || lower(l_linestatus) AS prompt, 'seed_' || l_linenumber AS seed FROM lineitem)
SELECT run_name, count(*) AS n, temp, prompt, seed FROM named GROUP BY ALL"""
ORACLES["token_stats"] = f"""WITH s AS (SELECT lang AS run_id, len(string_split_regex(text, '\\s+')) AS n FROM documents),
m AS (SELECT run_id, CAST(max(n) AS INT) AS max_tokens, CAST(min(n) AS INT) AS min_tokens, avg(n) AS a, quantile_cont(n, 0.5) AS b FROM s GROUP BY ALL)
SELECT run_id, max_tokens, min_tokens, {_r('a')} AS mean_tokens, {_r('b')} AS median_tokens FROM m"""
ORACLES["shard_stats"] = f"""WITH {TOKENS}, s AS (
  SELECT run_id, len(list_filter(token_ids, lambda t: t = 0)) AS pads, len(token_ids) AS n FROM tokens),
m AS (SELECT run_id, sum(pads) / sum(n) AS share, CAST(sum(n) AS BIGINT) AS n_tokens, CAST(max(n) AS INT) AS input_size FROM s GROUP BY ALL)
SELECT run_id, {_r('share')} AS padding_share, n_tokens, input_size FROM m"""
ORACLES["display_names"] = f"""SELECT CASE lang WHEN 'en' THEN {_text(DATASET_NAMES['coqa'])} WHEN 'de' THEN {_text(DATASET_NAMES['gsm8k'])} ELSE lang END AS dataset,
  count(*) AS n FROM documents GROUP BY lang"""

# ---------------------------------------------------------------- streaming and stored results

ORACLES["stream_attn_features"] = f"""WITH {LAP}, ld AS (SELECT row_idx, layer, head, avg(ln(d)) AS log_det FROM diags GROUP BY ALL)
SELECT run_id, l.row_idx, l.layer, l.head, {_r('log_det')} AS log_det, k, {_r('d')} AS attn, {_r('lap')} AS lap
FROM laps l JOIN ld USING (row_idx, layer, head)"""
ORACLES["stored_diagonals"] = f"""WITH {LAP}, {LABELS}, s AS (SELECT run_id, row_idx, layer, head, sum(lap) AS x FROM laps GROUP BY ALL)
SELECT run_id, row_idx, layer, head, label, {_r('x')} AS lap_sum
FROM s JOIN labels_fx USING (run_id, row_idx) WHERE label IN (0, 1)"""
ORACLES["probe_results_scan"] = f"""WITH {SCORE}, {LABELS}, {SPLIT},
all_scores AS (
  SELECT run_id, row_idx, CAST(layer AS VARCHAR) AS layer, score FROM layer_scores
  UNION ALL SELECT run_id, row_idx, 'all', avg(score) FROM layer_scores GROUP BY run_id, row_idx),
scored AS (SELECT s.*, label FROM all_scores s JOIN split USING (run_id, row_idx) WHERE part = 'test'),
{_ranking('scored', 'run_id, layer')}
SELECT 'attn_score' AS probe, 'set_' || run_id AS dataset, '0.' || run_id || '00' AS temp, 'seed_42' AS seed,
       CAST(0 AS BIGINT) AS trainable_params, layer AS layer_idx, CAST(NULL AS INT) AS configured_pca_dim,
       {_r('auc')} AS auc, {_r('ap')} AS ap
FROM auc JOIN ap USING (run_id, layer)"""
ORACLES["perturbation_stats"] = f"""WITH sizes AS ({ORACLES["perturbation_l2"]})
SELECT {_r('avg(avg_perturbation_fraction)', 5)} AS mean, {_r('min(avg_perturbation_fraction)', 5)} AS min,
       {_r('max(avg_perturbation_fraction)', 5)} AS max, {_r('stddev_samp(avg_perturbation_fraction)', 5)} AS std
FROM sizes WHERE std IS NOT NULL"""
ORACLES["hidden_states_scan"] = f"""WITH {STATES}, {STATE_TOKENS}, {_LAST}
SELECT run_id, s.row_idx, layer, which, s.tok_idx, 3 AS input_length, {_r('sum(v)')} AS vec_sum
FROM states s JOIN chosen c ON c.row_idx = s.row_idx AND c.tok_idx = s.tok_idx GROUP BY ALL"""

# ---------------------------------------------------------------- probes with closed forms

# Newton steps of a one-feature logistic regression with balanced classes and an L2 penalty, from zero
NEWTON = f"""{SCORE}, {LABELS}, {SPLIT}, f AS (
  SELECT s.run_id, s.row_idx, avg(score) AS x, any_value(label) AS y, any_value(part) AS part
  FROM layer_scores s JOIN split USING (run_id, row_idx) GROUP BY s.run_id, s.row_idx),
train AS (
  SELECT *, count(*) OVER (PARTITION BY run_id) / (2.0 * count(*) OVER (PARTITION BY run_id, y)) AS s FROM f WHERE part = 'train'),
newton AS (
  SELECT run_id, 0 AS i, 0.0::DOUBLE AS w, 0.0::DOUBLE AS b FROM train GROUP BY run_id
  UNION ALL
  SELECT run_id, i + 1, w - (h22 * g1 - h12 * g2) / (h11 * h22 - h12 * h12), b - (h11 * g2 - h12 * g1) / (h11 * h22 - h12 * h12)
  FROM (
    SELECT run_id, i, w, b, sum(s * (p - y) * x) + w AS g1, sum(s * (p - y)) AS g2,
           sum(s * p * (1 - p) * x * x) + 1 AS h11, sum(s * p * (1 - p) * x) AS h12, sum(s * p * (1 - p)) AS h22
    FROM (SELECT r.run_id, i, w, b, x, y, s, 1 / (1 + exp(-(w * x + b))) AS p FROM newton r JOIN train t ON t.run_id = r.run_id WHERE i < 15)
    GROUP BY run_id, i, w, b)),
model AS (SELECT run_id, w, b FROM newton WHERE i = 15)"""


def _thresholded(group: str) -> str:
    return f"""c AS (
  SELECT {group}, count(*) FILTER (label = 1 AND score > 0.5) AS tp, count(*) FILTER (label = 0 AND score > 0.5) AS fp,
         count(*) FILTER (label = 1 AND score <= 0.5) AS fn FROM scored GROUP BY {group}),
m AS (
  SELECT {group}, coalesce(tp / nullif(tp + fp, 0), 0.0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0.0) AS recall,
         coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0) AS f1 FROM c)"""


_FIVE = f"""{_r('auc')} AS auc, {_r('ap')} AS average_precision, {_r('precision')} AS precision, {_r('recall')} AS recall, {_r('f1')} AS f1"""
ORACLES["probe_single_feature"] = f"""WITH RECURSIVE {NEWTON},
scored AS (SELECT f.run_id, part, y AS label, 1 / (1 + exp(-(w * x + b))) AS score FROM f JOIN model USING (run_id)),
{_ranking('scored', 'run_id, part')}, {_thresholded('run_id, part')},
sizes AS (SELECT run_id, count(*) AS n_train FROM train GROUP BY run_id)
SELECT run_id, part, n_train, 2 AS trainable_params, {_r('w', 5)} AS coef, {_r('b', 5)} AS intercept, {_FIVE}
FROM auc JOIN ap USING (run_id, part) JOIN m USING (run_id, part) JOIN model USING (run_id) JOIN sizes USING (run_id)"""
ORACLES["probe_wide_features"] = ORACLES["probe_single_feature"].replace("2 AS trainable_params", "9 AS trainable_params, 1 AS rank")
ORACLES["probe_transfer"] = f"""WITH RECURSIVE {NEWTON},
scored AS (
  SELECT model.run_id AS train_run, f.run_id AS test_run, y AS label, 1 / (1 + exp(-(w * x + b))) AS score
  FROM model, f WHERE part = 'test'),
{_ranking('scored', 'train_run, test_run')}, {_thresholded('train_run, test_run')}
SELECT train_run, test_run, n_pos, n_neg, {_FIVE}
FROM auc JOIN ap USING (train_run, test_run) JOIN m USING (train_run, test_run)"""
ORACLES["pca_variance"] = f"""WITH {SCORE}, {LABELS}, {SPLIT}, two AS (
  SELECT s.run_id, s.row_idx, any_value(score) FILTER (layer = 0) AS a, any_value(score) FILTER (layer = 1) AS b
  FROM layer_scores s JOIN split USING (run_id, row_idx) WHERE part = 'train' GROUP BY s.run_id, s.row_idx),
cov AS (SELECT run_id, var_samp(a) AS aa, var_samp(b) AS bb, covar_samp(a, b) AS ab FROM two GROUP BY run_id),
roots AS (SELECT run_id, (aa + bb) / 2 AS mid, sqrt((aa - bb) * (aa - bb) / 4 + ab * ab) AS half FROM cov),
v AS (
  SELECT run_id, 0 AS component, mid + half AS variance FROM roots UNION ALL SELECT run_id, 1, mid - half FROM roots)
SELECT run_id, 2 AS pca_dim, component, {_r('variance')} AS variance FROM v"""
