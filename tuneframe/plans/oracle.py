"""DuckDB SQL that computes, independently, what each registered query returns.

The views ``conversations documents labels events part ...`` are registered
by the checker over the same parquet files.
"""

from __future__ import annotations

from tuneframe.functions.text import WS_CHARS


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# Python's whitespace set as a DuckDB string literal (for trim(x, chars)).
WS = "(" + " || ".join(f"chr({ord(c)})" for c in WS_CHARS) + ")"
CTRL = "'[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]'"

# Hashed trigrams of every text, weights of the sample, scores of every text.
LANGID = r"""
WITH texts AS (SELECT doc_id, lang, ' ' || regexp_replace(lower(text), '[\x09-\x0D\x20]+', ' ', 'g') || ' ' AS s FROM documents),
codes AS (SELECT doc_id, list_transform(string_split(s, ''), lambda c: unicode(c)) AS k FROM texts WHERE s IS NOT NULL),
grams AS (SELECT doc_id, cell, count(*) AS c FROM (
    SELECT doc_id, unnest(list_transform(range(1, len(k) - 1), lambda i: (k[i] * 92821 + k[i + 1] * 486187 + k[i + 2]) % 262144)) AS cell FROM codes)
  GROUP BY doc_id, cell),
fitted AS (SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR), s) AS r
  FROM texts WHERE lang IS NOT NULL AND s IS NOT NULL) WHERE r <= 100),
counts AS (SELECT lang, cell, sum(c) AS c FROM grams JOIN fitted USING (doc_id) GROUP BY lang, cell),
langs AS (SELECT lang, sum(c) AS n, (SELECT count(DISTINCT cell) FROM counts) AS v FROM counts GROUP BY lang),
priors AS (SELECT lang, floor(1000 * ln(count(*) / (SELECT count(*) FROM fitted)::DOUBLE)) AS prior FROM fitted GROUP BY lang),
weights AS (SELECT a.cell, l.lang, floor(1000 * (ln(coalesce(c.c, 0) + 1) - ln(l.n + l.v))) AS w
  FROM (SELECT DISTINCT cell FROM counts) a, langs l LEFT JOIN counts c ON c.cell = a.cell AND c.lang = l.lang),
scores AS (SELECT doc_id, w.lang, sum(g.c * w.w) + any_value(p.prior) AS score FROM grams g JOIN weights w USING (cell) JOIN priors p ON p.lang = w.lang
  GROUP BY doc_id, w.lang),
best AS (SELECT doc_id, lang, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, lang) AS r FROM scores),
detected AS (SELECT d.doc_id AS idx, b.lang AS language, CAST(b.score AS BIGINT) AS score FROM documents d LEFT JOIN best b ON b.doc_id = d.doc_id AND r = 1)
"""

DIRTY = """
dirty AS (
  SELECT conv_id, turn,
         CASE WHEN conv_id % 13 = 3 AND turn = 1 THEN 'user' ELSE role END AS role,
         CASE WHEN conv_id % 11 = 2 AND role = 'assistant' THEN '  '
              WHEN conv_id % 17 = 4 THEN concat(text, chr(7))
              WHEN conv_id % 19 = 5 THEN concat(text, chr(65533))
              ELSE text END AS text
  FROM conversations WHERE NOT (conv_id % 10 = 0 AND turn = 0)
  UNION ALL
  SELECT conv_id + 1000000, turn, role, text FROM conversations WHERE conv_id % 7 = 1
)"""

# Per-conversation flags over a long turn table named ``t`` (conv_id, turn, role, text).
FLAGS_OVER = """
ordered AS (
  SELECT conv_id, turn, role, text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos,
         lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev_role
  FROM {t}
),
keys AS (
  SELECT conv_id, list(struct_pack(r := role, c := trim(text, {ws})) ORDER BY turn) AS k
  FROM {t} GROUP BY conv_id
),
firsts AS (SELECT k, min(conv_id) AS first_id FROM keys GROUP BY k),
flags AS (
  SELECT o.conv_id,
    false AS missing_fields,
    false AS invalid_conversation,
    bool_or(pos = 1 AND role NOT IN ('system', 'user'))
      OR bool_or(prev_role = role AND role <> 'system') AS role_mismatch,
    NOT bool_or(role = 'assistant') OR bool_or(role = 'assistant' AND trim(text, {ws}) = '') AS empty_responses,
    bool_or(contains(text, chr(65533))) AS broken_utf8,
    bool_or(regexp_matches(text, {ctrl})) AS unsupported_tokens
  FROM ordered o GROUP BY o.conv_id
),
flagged AS (
  SELECT f.*, (f.conv_id > fi.first_id) AS duplicate_samples
  FROM flags f JOIN keys k USING (conv_id) JOIN firsts fi USING (k)
)"""


def flags_over(t: str) -> str:
    return FLAGS_OVER.format(t=t, ws=WS, ctrl=CTRL)


CATS = [
    "missing_fields",
    "role_mismatch",
    "invalid_conversation",
    "duplicate_samples",
    "empty_responses",
    "broken_utf8",
    "unsupported_tokens",
]


def report_sql(flagged: str = "flagged") -> str:
    unions = "\nUNION ALL\n".join(
        f"SELECT '{c}' AS category, {i} AS category_order, count_if({c}) AS count, "
        f"coalesce(array_to_string(list_slice(list(conv_id ORDER BY conv_id) FILTER (WHERE {c}), 1, 5), ','), '') AS sample_indices "
        f"FROM {flagged}"
        for i, c in enumerate(CATS)
    )
    return f"""
per_cat AS ({unions}),
totals AS (SELECT count(*) AS num_examples_checked FROM {flagged})
SELECT category, CAST(category_order AS INTEGER) AS category_order, CAST(count AS BIGINT) AS count,
       sample_indices,
       CAST(sum(count) OVER () AS BIGINT) AS issues_found,
       CAST(num_examples_checked AS BIGINT) AS num_examples_checked
FROM per_cat, totals"""


WSRE = "'[\\s\\x0b\\x1c-\\x1f]+'"


def _words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, {WSRE}), lambda x: x <> '')"


# Per-record metrics over a long turn table ``t`` -> recs(idx, n_turns, n_tokens, words, ...).
RECS = """
recs AS (
  SELECT conv_id AS idx, count(*) AS n_turns,
         list(role ORDER BY turn) AS roles,
         list(text ORDER BY turn) AS texts,
         list(struct_pack(r := role, c := trim(text, {ws})) ORDER BY turn) AS k,
         NOT bool_or(role = 'assistant') OR bool_or(role = 'assistant' AND trim(text, {ws}) = '') AS is_empty
  FROM {t} GROUP BY conv_id
),
rm AS (
  SELECT r.*, len({words}) AS n_tokens, {words} AS words,
         coalesce(f.role_mismatch, false) AS is_role_mismatch
  FROM recs r LEFT JOIN flags f ON f.conv_id = r.idx
)"""

DOCS = """
rm AS (
  SELECT doc_id AS idx, 1 AS n_turns, ['user'] AS roles, trim(text, {ws}) AS k,
         true AS is_empty, false AS is_role_mismatch,
         len({words}) AS n_tokens, {words} AS words
  FROM documents
)"""


def rm_conv(t: str) -> str:
    return flags_over(t) + "," + RECS.format(t=t, ws=WS, words=_words("array_to_string(texts, ' ')"))


def rm_docs() -> str:
    return DOCS.format(ws=WS, words=_words("text"))


def hist_sql(col: str, buckets) -> str:
    parts = []
    for i, (lo, hi) in enumerate(buckets):
        label = f"{lo}-{hi}" if hi is not None else f"{lo}+"
        cond = f"{col} >= {lo}" + (f" AND {col} < {hi}" if hi is not None else "")
        parts.append(f"SELECT '{label}' AS bucket, {i} AS bucket_order, CAST(count_if({cond}) AS BIGINT) AS n FROM rm")
    return "SELECT bucket, CAST(bucket_order AS INTEGER) AS bucket_order, n FROM (" + " UNION ALL ".join(parts) + ")"


ENTROPY = """
SELECT CAST(count(*) AS BIGINT) AS distinct_words,
       coalesce(round(CASE WHEN count(*) > 1 THEN (log2(sum(c)) - sum(c * log2(c)) / sum(c)) / log2(count(*))
                      ELSE log2(sum(c)) - sum(c * log2(c)) / sum(c) END, 4), 0.0) AS entropy_score
FROM (SELECT lower(w) AS w, count(*) AS c FROM (SELECT unnest(words) AS w FROM rm) GROUP BY 1)"""

DUPS = """
SELECT CAST(count(*) AS BIGINT) AS num_examples,
       CAST(count(*) - count(DISTINCT k) AS BIGINT) AS duplicate_examples,
       round((count(*) - count(DISTINCT k)) / count(*), 4) AS duplicate_ratio
FROM rm"""

QUALITY = """
SELECT CAST(n AS BIGINT) AS num_examples, CAST(e AS BIGINT) AS empty_count, CAST(r AS BIGINT) AS role_mismatch_count,
       dr AS duplicate_ratio,
       greatest(0.0, least(100.0, round(100.0 - e / n * 40 - dr * 30 - r / n * 30, 2))) AS quality_score
FROM (SELECT count(*) AS n, count_if(is_empty) AS e, count_if(is_role_mismatch) AS r,
             round((count(*) - count(DISTINCT k)) / count(*), 4) AS dr FROM rm)"""


REPAIR = """
d AS (SELECT conv_id AS idx, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM dirty),
fo AS (SELECT idx, min(pos) FILTER (WHERE role IN ('system', 'user')) AS first_ok, count(*) AS n0 FROM d GROUP BY idx),
r1 AS (SELECT d.idx, d.role, d.text, d.pos - fo.first_ok + 1 AS pos
       FROM d JOIN fo USING (idx) WHERE fo.first_ok IS NOT NULL AND d.pos >= fo.first_ok),
isl AS (SELECT *, sum(CASE WHEN prev IS NULL OR prev <> role OR role = 'system' THEN 1 ELSE 0 END)
                    OVER (PARTITION BY idx ORDER BY pos) AS g
        FROM (SELECT *, lag(role) OVER (PARTITION BY idx ORDER BY pos) AS prev FROM r1)),
r2 AS (SELECT idx, g AS pos, any_value(role) AS role,
              list_reduce(list(text ORDER BY pos), lambda a, b: trim(a || chr(10) || b, {ws})) AS content
       FROM isl GROUP BY idx, g),
keep AS (SELECT idx FROM r2 GROUP BY idx
         HAVING bool_or(role = 'assistant') AND NOT bool_or(role = 'assistant' AND trim(content, {ws}) = '')),
r4 AS (SELECT r2.idx, r2.pos, r2.role, left(r2.content, {trunc}) AS content, length(r2.content) > {trunc} AS cut
       FROM r2 JOIN keep USING (idx)),
r5 AS (SELECT *, (pos - 1) // {split} AS chunk FROM r4),
ch AS (SELECT idx, chunk, count(*) AS n_msgs,
              list(struct_pack(r := role, c := trim(content, {ws})) ORDER BY pos) AS k,
              arg_min(content, pos) AS first_content
       FROM r5 GROUP BY idx, chunk),
firsts AS (SELECT k, min(struct_pack(i := idx, c := chunk)) AS f FROM ch GROUP BY k),
out AS (SELECT ch.* FROM ch JOIN firsts USING (k) WHERE f.i = ch.idx AND f.c = ch.chunk)"""


def repair_sql(trunc: int = 1000000000, split: int = 1000000000) -> str:
    return f"WITH {DIRTY},\n" + REPAIR.format(ws=WS, trunc=trunc, split=split) + "\n"


# Format fixtures rebuilt in DuckDB: JSON records and the messages each
# record must normalise to.
FORMATS_SQL = """
conv AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM conversations),
alp2 AS (
  SELECT u.conv_id * 1000000 + u.pos - 1 AS idx, u.text AS instruction,
         CASE WHEN u.conv_id % 3 = 0 THEN 'Context ' || u.conv_id END AS inp,
         CASE WHEN n.role = 'assistant' THEN n.text ELSE '' END AS output
  FROM conv u LEFT JOIN conv n ON n.conv_id = u.conv_id AND n.pos = u.pos + 1
  WHERE u.role = 'user'
),
dl AS (SELECT doc_id, doc_id // 2 AS k, text, lang FROM documents),
pairs AS (SELECT 2 * coalesce(e.k, o.k) AS idx, 'Write a text in ' || coalesce(e.lang, o.lang) || '.' AS prompt,
                 coalesce(e.text, '') AS chosen, coalesce(o.text, '') AS rejected
          FROM (SELECT * FROM dl WHERE doc_id % 2 = 0) e FULL JOIN (SELECT * FROM dl WHERE doc_id % 2 = 1) o ON e.k = o.k),
llama_pairs AS (
  SELECT c.conv_id, c.pos,
         '[INST] ' || CASE WHEN p.role = 'system' THEN '<<SYS>>' || p.text || '<</SYS>> ' ELSE '' END
         || c.text || ' [/INST] ' || CASE WHEN n.role = 'assistant' THEN n.text ELSE '' END AS piece
  FROM conv c
  LEFT JOIN conv p ON p.conv_id = c.conv_id AND p.pos = c.pos - 1
  LEFT JOIN conv n ON n.conv_id = c.conv_id AND n.pos = c.pos + 1
  WHERE c.role = 'user'
),
recs AS (
  SELECT 'sharegpt' AS dataset, conv_id AS idx,
         json_object('conversations', to_json(list(json_object('from', CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' ELSE role END, 'value', text) ORDER BY turn))) AS j
  FROM conversations GROUP BY conv_id
  UNION ALL
  SELECT 'chatml', conv_id, json_object('messages', to_json(list(json_object('role', role, 'content', text) ORDER BY turn)))
  FROM conversations GROUP BY conv_id
  UNION ALL
  SELECT 'alpaca', idx, json_merge_patch(json_object('instruction', instruction),
                                         CASE WHEN inp IS NOT NULL THEN json_object('input', inp) ELSE '{{}}' END,
                                         CASE WHEN output IS NOT NULL THEN json_object('output', output) ELSE '{{}}' END)
  FROM alp2
  UNION ALL
  SELECT 'llama', conv_id, json_object('text', string_agg(piece, ' ' ORDER BY pos)) FROM llama_pairs GROUP BY conv_id
  UNION ALL
  SELECT 'preference', idx, json_object('prompt', prompt, 'chosen', chosen, 'rejected', rejected) FROM pairs
  UNION ALL
  SELECT 'raw_text', doc_id, json_object('text', text) FROM documents
  UNION ALL
  SELECT 'unknown', doc_id, json_object('doc_id', doc_id, 'source', source) FROM documents
),
expected AS (
  SELECT 'sharegpt' AS dataset, conv_id AS idx, pos - 1 AS pos, role, text AS content FROM conv
  UNION ALL SELECT 'chatml', conv_id, pos - 1, role, text FROM conv
  UNION ALL SELECT 'llama', conv_id, pos - 1, role, text FROM conv
  UNION ALL SELECT 'alpaca', idx, 0, 'user',
                   CASE WHEN coalesce(inp, '') <> '' THEN trim(instruction || chr(10) || chr(10) || inp, {ws}) ELSE instruction END
            FROM alp2
  UNION ALL SELECT 'alpaca', idx, 1, 'assistant', output FROM alp2 WHERE coalesce(output, '') <> ''
  UNION ALL SELECT 'preference', idx, 0, 'user', prompt FROM pairs WHERE prompt <> ''
  UNION ALL SELECT 'preference', idx, CASE WHEN prompt <> '' THEN 1 ELSE 0 END, 'assistant', chosen FROM pairs
  UNION ALL SELECT 'raw_text', doc_id, 0, 'user', text FROM documents
  UNION ALL SELECT 'unknown', doc_id, 0, 'user', '{{"doc_id":' || doc_id || ',"source":' || to_json(source) || '}}' FROM documents
),
codes AS (SELECT * FROM (VALUES ('sharegpt', 0), ('chatml', 1), ('alpaca', 2), ('llama', 3), ('preference', 4),
                                ('raw_text', 5), ('unknown', 6)) t(dataset, code)),
all_recs AS (
  SELECT dataset, idx, j FROM recs
  UNION ALL SELECT 'mixed', idx * 8 + code, j FROM recs JOIN codes USING (dataset)
),
classified AS (
  SELECT dataset, idx, CASE
    WHEN json_type(j, '$.conversations') = 'ARRAY' AND json_array_length(j, '$.conversations') > 0
         AND list_bool_and(list_transform(json_extract(j, '$.conversations[*]'),
             lambda c: json_type(c) = 'OBJECT' AND (json_exists(c, '$.from') OR json_exists(c, '$.role')))) THEN 'sharegpt'
    WHEN json_type(j, '$.messages') = 'ARRAY' AND json_array_length(j, '$.messages') > 0
         AND list_bool_and(list_transform(json_extract(j, '$.messages[*]'),
             lambda c: json_type(c) = 'OBJECT' AND json_exists(c, '$.role'))) THEN 'chatml'
    WHEN json_exists(j, '$.chosen') AND json_exists(j, '$.rejected') THEN 'preference'
    WHEN json_exists(j, '$.instruction') AND (json_exists(j, '$.output') OR json_exists(j, '$.response')) THEN 'alpaca'
    WHEN json_exists(j, '$.text') AND len(json_keys(j)) <= 2 AND json_type(j, '$.text') = 'VARCHAR'
         AND regexp_matches(j ->> '$.text', '\\[/?INST\\]|<\\|.*?\\|>|<<SYS>>|<</SYS>>') THEN 'llama'
    WHEN json_exists(j, '$.text') AND len(json_keys(j)) <= 2 AND json_type(j, '$.text') = 'VARCHAR' THEN 'raw_text'
  END AS vote
  FROM all_recs
),
votes AS (SELECT dataset, vote, count(*) AS n FROM classified GROUP BY dataset, vote),
ranks AS (SELECT * FROM (VALUES ('alpaca', 1), ('sharegpt', 2), ('chatml', 3), ('openai', 4), ('llama', 5),
                                ('preference', 6), ('raw_text', 7), ('unknown', 8)) t(vote, r)),
best AS (
  SELECT dataset, sum(n) AS sampled,
         arg_max(vote, n * 100 - coalesce(r, 0)) FILTER (WHERE vote IS NOT NULL) AS bvote,
         max(n) FILTER (WHERE vote IS NOT NULL) AS bn
  FROM votes LEFT JOIN ranks USING (vote) GROUP BY dataset
)"""


RUN_EVENTS = """
run_events AS (
  SELECT user_id AS run_id,
         CASE event_type WHEN 'click' THEN 'metric' WHEN 'view' THEN 'checkpoint' WHEN 'error' THEN 'error'
                         WHEN 'signup' THEN 'stage' WHEN 'purchase' THEN 'done' END AS event,
         epoch_us(ts) / 1e6 AS ts, event_id AS step, event_id / 1000.0 AS epoch,
         CASE WHEN event_type = 'click' THEN value END AS loss,
         CASE WHEN event_type = 'click' AND event_id % 5 = 0 THEN value END AS eval_loss,
         CASE WHEN event_type = 'click' THEN CAST(0.0002 AS DOUBLE) * CAST(json_extract(props, '$.k') AS INTEGER) / CAST(100.0 AS DOUBLE) END AS learning_rate,
         CASE WHEN event_type = 'click' THEN CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 11 = 0 THEN 1e-5
                                                  ELSE value / 10.0 END END AS grad_norm,
         CASE WHEN event_type = 'click' THEN value / 50.0 END AS gpu_mem_used_gb,
         CASE WHEN event_type = 'click' THEN CASE WHEN CAST(json_extract(props, '$.k') AS INTEGER) > 20
              THEN CAST(json_extract(props, '$.k') AS INTEGER) * 100 ELSE 0 END END AS total_steps,
         CASE WHEN event_type = 'error' THEN 'error ' || event_id END AS message,
         CASE WHEN event_type = 'signup' THEN 'stage_' || (CAST(json_extract(props, '$.k') AS INTEGER) % 4) END AS stage
  FROM events
),
pts AS (SELECT run_id, ts, coalesce(step, 0) AS step, coalesce(epoch, 0.0) AS epoch, loss, eval_loss, learning_rate,
               grad_norm, gpu_mem_used_gb, total_steps FROM run_events WHERE event = 'metric'),
ck AS (SELECT run_id, coalesce(step, 0) AS step, coalesce(epoch, 0.0) AS epoch,
              'runs/run_' || run_id || '/checkpoint-' || coalesce(step, 0) AS path, CAST(0 AS BIGINT) AS size_bytes
       FROM run_events WHERE event = 'checkpoint')"""


CATALOG = """
mc AS (
  SELECT replace(p_name, ' ', '-') || '-' || p_partkey AS repo_id,
         array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ') AS display_name,
         p_brand AS family,
         CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE CAST(p_size AS BIGINT) * 1000000000 END AS param_count,
         CAST(512 * (p_size % 8 + 1) AS BIGINT) AS hidden_size, CAST(p_size AS BIGINT) AS num_layers,
         CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE 32000 + (p_partkey % 5) * 1000 END AS vocab_size,
         [lower(p_type), CASE p_type WHEN 'PROMO' THEN 'Vision-encoder' WHEN 'LARGE' THEN 'image-text-to-text'
                                     WHEN 'SMALL' THEN 'tiny-VL' WHEN 'MEDIUM' THEN 'vision' ELSE 'text-generation' END] AS tags,
         CASE WHEN p_partkey % 4 = 1 THEN 'image-text-to-text' ELSE 'text-generation' END AS pipeline_tag,
         CAST(trunc(p_retailprice * 100) AS BIGINT) + p_partkey AS downloads,
         TIMESTAMP '2024-01-01 00:00:00' + p_partkey * INTERVAL 1 MINUTE AS created_at,
         p_partkey AS k
  FROM part
),
vis AS (
  SELECT repo_id, list_bool_or(list_transform(tags, lambda t: contains(t, 'vision') OR contains(lower(t), 'vl')
                                                   OR contains(t, 'image-text')))
                  OR contains(lower(repo_id), 'llava') OR contains(lower(repo_id), '-vl')
                  OR contains(lower(repo_id), 'vision') AS is_vision
  FROM mc
),
lib AS (
  SELECT repo_id, k % 2 = 0 AS downloaded, k % 5 = 0 AS bookmarked,
         CASE WHEN k % 4 = 0 THEN created_at + INTERVAL 1 DAY END AS last_used_at, 'models/' || repo_id AS local_path, k
  FROM mc WHERE k % 3 = 0
),
cl AS (
  SELECT mc.*, coalesce(lib.downloaded, false) AS downloaded, coalesce(lib.bookmarked, false) AS bookmarked
  FROM mc LEFT JOIN lib USING (repo_id)
),
models AS (
  SELECT mc.repo_id,
         CASE WHEN k % 2 = 0 THEN 'LlamaForCausalLM' ELSE 'GPT2LMHeadModel' END AS architecture,
         hidden_size, num_layers, CAST(CASE WHEN k % 2 = 0 THEN 4096 ELSE 2048 END AS BIGINT) AS context_length,
         coalesce(param_count, 12 * num_layers * hidden_size * hidden_size
                               + 2 * coalesce(CASE WHEN k % 2 = 0 THEN vocab_size END, 32000) * hidden_size) AS param_count,
         param_count IS NULL AS param_count_is_estimate
  FROM mc
),
grid AS (SELECT * FROM (VALUES ('lora', 'bf16', 2.0, 0.02, 2.5), ('qlora', 'nf4', 0.5, 0.01, 2.0), ('full', 'bf16', 2.0, 1.0, 4.0))
         t(method, dtype, bpp, frac, act)),
vparts AS (
  SELECT repo_id, param_count, method, dtype,
         param_count * bpp / 1073741824.0 AS w,
         CASE WHEN method = 'full' THEN param_count * bpp / 1073741824.0 ELSE param_count * frac * bpp / 1073741824.0 END AS g,
         param_count * frac * 8.0 / 1073741824.0 AS o,
         act * greatest(1.0, param_count * bpp / 1073741824.0 / 8.0) AS a
  FROM models, grid WHERE param_count IS NOT NULL
),
vram AS (
  SELECT repo_id, param_count, method, dtype, round(w, 2) AS model_weights_gb, round(g, 2) AS gradients_gb,
         round(o, 2) AS optimizer_states_gb, round(a, 2) AS activations_gb, round(w + g + o + a, 2) AS total_estimated_gb
  FROM vparts
),
registry AS (
  SELECT CAST(regexp_extract(source, '(\\d+)$', 1) AS BIGINT) AS dataset_id, source AS name, count(*) AS num_examples,
         greatest(0.0, least(100.0, round(100.0 - 40.0 - round((count(*) - count(DISTINCT trim(text, {ws}))) / count(*), 4) * 30, 2))) AS quality_score
  FROM documents GROUP BY source
),
runs AS (
  SELECT user_id AS run_id, user_id % 25 AS dataset_id, min(ts) AS min_ts,
         CASE arg_max(event_type, ts) FILTER (WHERE event_type IN ('error', 'purchase'))
              WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' ELSE 'running' END AS status
  FROM events GROUP BY user_id
),
devices AS (
  SELECT e.ts, e.user_id % 8 AS host, g.i AS device, 'GPU-' || g.i AS name, e.value / 5.0 + g.i AS utilization_pct,
         CAST(trunc(e.value * 1e7) AS BIGINT) / 1048576 AS memory_used_mib, CAST(8192 AS DOUBLE) AS memory_total_mib,
         CASE WHEN e.event_id % 3 = 0 AND g.i = 1 THEN NULL ELSE e.value * 1000.0 / 1000.0 END AS power_w,
         CASE WHEN e.event_id % 5 > 0 THEN CAST(350 AS DOUBLE) END AS power_limit_w,
         CASE WHEN e.event_id % 7 > 0 THEN CAST(e.event_id % 100 AS DOUBLE) END AS fan_speed_pct,
         e.event_id * 1000000 / 1073741824 AS disk_used_gb, CAST(2048 AS DOUBLE) AS disk_total_gb,
         30.0 + e.value / 10.0 AS temperature_c, e.value / 5.0 AS cpu_pct,
         CAST(trunc(e.value * 1e8) AS BIGINT) / 1073741824 AS ram_used_gb, CAST(64 AS DOUBLE) AS ram_total_gb
  FROM events e, (SELECT unnest([0, 1]) AS i) g
  WHERE g.i = 0 OR e.event_id % 2 = 1
),
rollup AS (
  SELECT host, device, time_bucket(INTERVAL 1 MINUTE, ts) AS ws, count(*) AS n,
         round(avg(utilization_pct), 6) AS avg_utilization_pct, max(utilization_pct) AS max_utilization_pct,
         round(avg(memory_used_mib), 6) AS avg_memory_used_mib, max(memory_used_mib) AS max_memory_used_mib,
         round(avg(power_w), 6) AS avg_power_w, max(temperature_c) AS max_temperature_c
  FROM devices GROUP BY ALL
)"""

F_TS = "'%Y-%m-%d %H:%M:%S'"


VALIDATE_BY_DATASET = """,
branch AS (SELECT * FROM (VALUES ('sharegpt', 1), ('chatml', 2), ('preference', 3), ('alpaca', 4), ('llama', 5),
                                 ('raw_text', 6), ('unknown', 7)) t(src, own_b)),
fb AS (SELECT dataset, coalesce(bvote, 'unknown') AS f,
              CASE coalesce(bvote, 'unknown') WHEN 'sharegpt' THEN 1 WHEN 'chatml' THEN 2 WHEN 'openai' THEN 2
                   WHEN 'preference' THEN 3 WHEN 'alpaca' THEN 4 WHEN 'llama' THEN 5 ELSE 99 END AS fbr FROM best),
allrec AS (
  SELECT dataset, idx, dataset AS src, idx AS src_idx FROM recs
  UNION ALL SELECT 'mixed', idx * 8 + code, dataset, idx FROM recs JOIN codes USING (dataset)
),
rb AS (SELECT a.*, b.own_b, fb.f, fb.fbr FROM allrec a JOIN branch b USING (src) JOIN fb USING (dataset)),
msgs AS (
  SELECT rb.dataset, rb.idx, e.pos, e.role, e.content
  FROM rb JOIN expected e ON e.dataset = rb.src AND e.idx = rb.src_idx WHERE rb.own_b <= rb.fbr
  UNION ALL SELECT rb.dataset, rb.idx, 0, 'user', a.instruction
  FROM rb JOIN alp2 a ON a.idx = rb.src_idx WHERE rb.own_b > rb.fbr AND rb.f = 'preference' AND rb.src = 'alpaca'
  UNION ALL SELECT dataset, idx, CASE WHEN src = 'alpaca' THEN 1 ELSE 0 END, 'assistant', ''
  FROM rb WHERE own_b > fbr AND f = 'preference'
  UNION ALL SELECT dataset, idx, 0, 'user', '' FROM rb WHERE own_b > fbr AND f = 'alpaca'
  UNION ALL SELECT rb.dataset, rb.idx, 0, 'user', CASE WHEN rb.src = 'raw_text' THEN d.text ELSE '' END
  FROM rb LEFT JOIN documents d ON d.doc_id = rb.src_idx AND rb.src = 'raw_text' WHERE rb.own_b > rb.fbr AND rb.f = 'llama'
),
mflags AS (
  SELECT dataset, idx,
         bool_or(pos = 0 AND role NOT IN ('system', 'user')) OR bool_or(prev = role AND role <> 'system') AS role_mismatch,
         NOT bool_or(role = 'assistant') OR bool_or(role = 'assistant' AND trim(content, {ws}) = '') AS empty_responses,
         bool_or(contains(content, chr(65533))) AS broken_utf8,
         bool_or(regexp_matches(content, {ctrl})) AS unsupported_tokens,
         list(struct_pack(r := role, c := trim(content, {ws})) ORDER BY pos) AS k
  FROM (SELECT *, lag(role) OVER (PARTITION BY dataset, idx ORDER BY pos) AS prev FROM msgs) GROUP BY dataset, idx
),
firsts AS (SELECT dataset, k, min(idx) AS first_id FROM mflags GROUP BY dataset, k),
vflags AS (
  SELECT rb.dataset, rb.idx AS conv_id,
         CASE rb.f WHEN 'alpaca' THEN rb.src <> 'alpaca' WHEN 'sharegpt' THEN rb.src <> 'sharegpt'
                   WHEN 'chatml' THEN rb.src <> 'chatml' WHEN 'openai' THEN rb.src <> 'chatml'
                   WHEN 'preference' THEN rb.src <> 'preference' ELSE false END AS missing_fields,
         m.idx IS NULL AS invalid_conversation,
         coalesce(m.role_mismatch, false) AS role_mismatch,
         coalesce(m.empty_responses, false) AS empty_responses,
         coalesce(m.broken_utf8, false) AS broken_utf8,
         coalesce(m.unsupported_tokens, false) AS unsupported_tokens,
         coalesce(m.idx > fi.first_id, false) AS duplicate_samples
  FROM rb LEFT JOIN mflags m ON m.dataset = rb.dataset AND m.idx = rb.idx
          LEFT JOIN firsts fi ON fi.dataset = m.dataset AND fi.k = m.k
)"""


def report_by_dataset(flagged: str = "vflags") -> str:
    unions = "\nUNION ALL\n".join(
        f"SELECT dataset, '{c}' AS category, {i} AS category_order, count_if({c}) AS count, "
        f"coalesce(array_to_string(list_slice(list(conv_id ORDER BY conv_id) FILTER (WHERE {c}), 1, 5), ','), '') AS sample_indices "
        f"FROM {flagged} GROUP BY dataset"
        for i, c in enumerate(CATS)
    )
    return f""",
per_cat AS ({unions}),
totals AS (SELECT dataset, count(*) AS num_examples_checked FROM {flagged} GROUP BY dataset)
SELECT dataset, category, CAST(category_order AS INTEGER) AS category_order, CAST(count AS BIGINT) AS count,
       sample_indices,
       CAST(sum(count) OVER (PARTITION BY dataset) AS BIGINT) AS issues_found,
       CAST(num_examples_checked AS BIGINT) AS num_examples_checked
FROM per_cat JOIN totals USING (dataset)"""


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["fold_turns"] = """
SELECT conv_id AS idx, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS pos,
       role, text AS content
FROM conversations"""
    base = f"WITH {DIRTY},\n{flags_over('dirty')}\n"
    for name, col in [
        ("flag_role_mismatch", "role_mismatch"),
        ("flag_empty", "empty_responses"),
        ("flag_control", "unsupported_tokens"),
        ("flag_utf8", "broken_utf8"),
        ("duplicates", "duplicate_samples"),
    ]:
        q[name] = base + f"SELECT conv_id AS idx FROM flagged WHERE {col}"
    q["validation_report"] = base + "," + report_sql()
    q["validation_report_turns"] = q["validation_report"]

    from tuneframe.functions.buckets import TOKEN_BUCKETS, TURN_BUCKETS

    conv = f"WITH {DIRTY},\n{rm_conv('dirty')}\n"
    docs = f"WITH {rm_docs()}\n"
    q["turn_stats"] = conv + "SELECT round(avg(n_turns), 3) AS avg_turns, CAST(min(n_turns) AS BIGINT) AS min_turns, CAST(max(n_turns) AS BIGINT) AS max_turns FROM rm"
    q["role_counts"] = conv + "SELECT role, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(roles) AS role FROM rm) GROUP BY role"
    q["assistant_user_ratio"] = conv + """
SELECT CAST(u AS BIGINT) AS user_turns, CAST(a AS BIGINT) AS assistant_turns,
       CASE WHEN u > 0 THEN round(a / u, 4) END AS assistant_user_ratio
FROM (SELECT count_if(role = 'user') AS u, count_if(role = 'assistant') AS a FROM (SELECT unnest(roles) AS role FROM rm))"""
    q["dup_ratio"] = conv + DUPS
    q["doc_dup_ratio"] = docs + DUPS
    q["token_stats"] = docs + "SELECT round(avg(n_tokens), 2) AS avg_tokens, CAST(min(n_tokens) AS BIGINT) AS min_tokens, CAST(max(n_tokens) AS BIGINT) AS max_tokens FROM rm"
    q["token_hist"] = docs + hist_sql("n_tokens", TOKEN_BUCKETS)
    q["turn_hist"] = conv + hist_sql("n_turns", TURN_BUCKETS)
    q["entropy"] = docs + ENTROPY
    q["entropy_conversations"] = conv + ENTROPY
    q["quality_score"] = conv + QUALITY
    q["profile_maps"] = conv + (
        "SELECT 'role_counts' AS report, role AS key, CAST(count(*) AS BIGINT) AS n"
        " FROM (SELECT unnest(roles) AS role FROM rm) GROUP BY role"
        f" UNION ALL SELECT 'token_histogram', bucket, n FROM ({hist_sql('n_tokens', TOKEN_BUCKETS)})"
        f" UNION ALL SELECT 'turn_histogram', bucket, n FROM ({hist_sql('n_turns', TURN_BUCKETS)})"
    )
    q["profile"] = conv + f"""
SELECT qs.*, ts.*, ar.assistant_user_ratio, du.duplicate_examples, tk.*, en.entropy_score
FROM ({QUALITY}) qs,
     (SELECT round(avg(n_turns), 3) AS avg_turns, CAST(min(n_turns) AS BIGINT) AS min_turns, CAST(max(n_turns) AS BIGINT) AS max_turns FROM rm) ts,
     (SELECT CASE WHEN count_if(role = 'user') > 0 THEN round(count_if(role = 'assistant') / count_if(role = 'user'), 4) END AS assistant_user_ratio
        FROM (SELECT unnest(roles) AS role FROM rm)) ar,
     (SELECT CAST(count(*) - count(DISTINCT k) AS BIGINT) AS duplicate_examples FROM rm) du,
     (SELECT round(avg(n_tokens), 2) AS avg_tokens, CAST(min(n_tokens) AS BIGINT) AS min_tokens, CAST(max(n_tokens) AS BIGINT) AS max_tokens FROM rm) tk,
     ({ENTROPY}) en"""

    r = repair_sql()
    q["fix_roles"] = r + """
SELECT fo.idx, CAST(CASE WHEN fo.first_ok IS NULL THEN 0 ELSE fo.n0 - fo.first_ok + 1 END AS BIGINT) AS n_turns,
       (fo.first_ok IS NULL OR fo.first_ok > 1) AS roles_fixed
FROM fo"""
    q["merge_turns"] = r + "SELECT idx, CAST(pos - 1 AS INTEGER) AS pos, role, content FROM r2"
    q["drop_empty"] = r + "SELECT idx FROM keep"
    q["truncate"] = repair_sql(trunc=200) + "SELECT idx, CAST(pos - 1 AS INTEGER) AS pos, role, content FROM r4"
    q["split"] = repair_sql(split=2) + "SELECT idx, CAST(chunk AS BIGINT) AS chunk, CAST(n_msgs AS BIGINT) AS n_msgs FROM ch"
    rows = "SELECT idx, CAST(chunk AS BIGINT) AS chunk, CAST(n_msgs AS BIGINT) AS n_msgs, first_content FROM out"
    q["dedupe"] = repair_sql(200, 2) + rows
    q["repair_shuffle"] = repair_sql(200, 2) + rows
    q["repair_summary"] = repair_sql(200, 2) + """
SELECT
  (SELECT CAST(count(*) AS BIGINT) FROM fo) AS input_count,
  (SELECT CAST(count_if(first_ok IS NULL OR first_ok > 1) AS BIGINT) FROM fo) AS roles_fixed,
  (SELECT CAST(count(*) AS BIGINT) FROM (SELECT idx FROM isl GROUP BY idx HAVING max(g) < count(*))) AS merged_turns,
  (SELECT CAST(count(*) - count(DISTINCT k) AS BIGINT) FROM ch) AS duplicates_removed,
  (SELECT CAST((SELECT count(*) FROM fo) - count(*) AS BIGINT) FROM keep) AS empty_responses_removed,
  (SELECT CAST(count_if(cut) AS BIGINT) FROM r4) AS turns_truncated,
  (SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) FROM (SELECT idx, count(DISTINCT chunk) AS c FROM r5 GROUP BY idx)) AS examples_split,
  false AS shuffled,
  (SELECT CAST(count(DISTINCT k) AS BIGINT) FROM ch) AS output_count"""

    in_ds = "WHERE idx % 10 = ds.dataset"
    q["repair_summary_by_dataset"] = repair_sql(200, 2) + f""",
ds AS (SELECT DISTINCT idx % 10 AS dataset FROM fo)
SELECT dataset,
  (SELECT CAST(count(*) AS BIGINT) FROM fo {in_ds}) AS input_count,
  coalesce((SELECT CAST(count_if(first_ok IS NULL OR first_ok > 1) AS BIGINT) FROM fo {in_ds}), 0) AS roles_fixed,
  coalesce((SELECT CAST(count(*) AS BIGINT) FROM (SELECT idx FROM isl GROUP BY idx HAVING max(g) < count(*)) {in_ds}), 0) AS merged_turns,
  coalesce((SELECT CAST(count(*) - count(DISTINCT k) AS BIGINT) FROM ch {in_ds}), 0) AS duplicates_removed,
  (SELECT CAST(count(*) AS BIGINT) FROM fo {in_ds}) - (SELECT CAST(count(*) AS BIGINT) FROM keep {in_ds}) AS empty_responses_removed,
  coalesce((SELECT CAST(count_if(cut) AS BIGINT) FROM r4 {in_ds}), 0) AS turns_truncated,
  coalesce((SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) FROM (SELECT idx, count(DISTINCT chunk) AS c FROM r5 GROUP BY idx) {in_ds}), 0) AS examples_split,
  false AS shuffled,
  coalesce((SELECT CAST(count(DISTINCT k) AS BIGINT) FROM ch {in_ds}), 0) AS output_count
FROM ds"""

    fx = "WITH " + FORMATS_SQL.format(ws=WS) + "\n"
    q["detect_format"] = fx + """
SELECT dataset, coalesce(bvote, 'unknown') AS format,
       CASE WHEN coalesce(bn, 0) > 0 THEN round(bn / sampled, 4) ELSE 0.0 END AS confidence,
       CAST(sampled AS BIGINT) AS sampled, CAST(coalesce(bn, 0) AS BIGINT) AS votes
FROM best"""
    q["format_scores"] = fx + """
SELECT d.dataset, ranks.vote AS format, CAST(coalesce(v.n, 0) AS BIGINT) AS votes
FROM (SELECT DISTINCT dataset FROM votes) d CROSS JOIN ranks
LEFT JOIN votes v ON v.dataset = d.dataset AND v.vote = ranks.vote"""
    for name in ["sharegpt", "chatml", "alpaca", "llama", "preference", "raw_text", "unknown"]:
        q[f"normalize_{name}"] = fx + f"""
SELECT idx, CAST(pos AS INTEGER) AS pos, role, content FROM expected WHERE dataset = '{name}'"""
    q["normalize_mixed"] = fx + """
SELECT e.idx * 8 + c.code AS idx, CAST(e.pos AS INTEGER) AS pos, e.role, e.content
FROM expected e JOIN codes c USING (dataset)"""
    q["jsonl_roundtrip"] = fx + """
SELECT CAST(dense_rank() OVER (ORDER BY idx) - 1 AS BIGINT) AS file_idx, CAST(pos AS INTEGER) AS pos, role, content
FROM expected WHERE dataset = 'sharegpt'"""

    sft = """,
sft AS (SELECT conv_id AS idx, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS text
        FROM conversations GROUP BY conv_id HAVING bool_or(text <> ''))"""
    q["sft_texts"] = fx + sft + " SELECT idx, text FROM sft"
    q["sft_texts_sharegpt"] = q["sft_texts"]
    q["sft_texts_alpaca"] = fx + """
SELECT idx, 'user: ' || CASE WHEN coalesce(inp, '') <> '' THEN trim(instruction || chr(10) || chr(10) || inp, {ws})
                             ELSE instruction END || chr(10) || 'assistant: ' || coalesce(output, '') AS text
FROM alp2""".replace("{ws}", WS)
    q["train_eval_split"] = fx + sft + """
SELECT idx, CAST(rn - 1 AS BIGINT) AS rank,
       CASE WHEN rn - 1 < greatest(1, CAST(floor(n * (1.0 - 0.05)) AS BIGINT))
            THEN 'train' ELSE 'eval' END AS split
FROM (SELECT idx, row_number() OVER (ORDER BY idx) AS rn, count(*) OVER () AS n FROM sft)"""
    q["preference_triples"] = fx + "SELECT idx, prompt, chosen, rejected FROM pairs"
    q["kto_unpivot"] = fx + """
SELECT idx, prompt, chosen AS completion, true AS label, 0 AS ord FROM pairs
UNION ALL SELECT idx, prompt, rejected, false, 1 FROM pairs"""
    tok = """,
tc AS (SELECT conv_id AS idx, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS prompt
       FROM conversations GROUP BY conv_id),
tk AS (SELECT idx, prompt, len({words}) AS n_tokens FROM tc)""".replace("{words}", _words("prompt"))
    analysis = """
SELECT CAST(s AS BIGINT) AS sampled_examples, CAST(t AS BIGINT) AS total_examples,
       round(sm / s, 2) AS avg_tokens_per_example, CAST(mn AS BIGINT) AS min_tokens, CAST(mx AS BIGINT) AS max_tokens,
       CAST(round(sm * CASE WHEN s < t THEN t / s ELSE 1.0 END) AS BIGINT) AS estimated_total_tokens,
       CAST(256 AS BIGINT) AS max_seq_len, CAST(o AS BIGINT) AS sampled_examples_over_limit,
       round(o / s, 4) AS fraction_over_limit, CAST(round(o / s * t) AS BIGINT) AS estimated_total_over_limit,
       fp AS first_prompt, CAST(fn AS BIGINT) AS first_token_count
FROM (SELECT (SELECT count(*) FROM tk) AS t, count(*) AS s, sum(n_tokens) AS sm, min(n_tokens) AS mn, max(n_tokens) AS mx,
             count_if(n_tokens > 256) AS o, arg_min(prompt, idx) AS fp, arg_min(n_tokens, idx) AS fn
      FROM tk {where})"""
    q["token_analysis"] = fx + tok + analysis.replace("{where}", "")
    q["truncation_sampled"] = fx + tok + """
SELECT sampled_examples, total_examples, estimated_total_tokens, sampled_examples_over_limit,
       fraction_over_limit, estimated_total_over_limit FROM (""" + analysis.replace("{where}", "WHERE idx < 50") + ")"
    q["pack_examples"] = fx + tok + """,
span AS (SELECT idx, sum(n_tokens) OVER (ORDER BY idx) - n_tokens AS s, n_tokens AS n FROM tk),
piece AS (SELECT *, unnest(generate_series(CAST(s // 512 AS BIGINT), CAST(greatest(s + n - 1, s) // 512 AS BIGINT))) AS pack_id FROM span)
SELECT pack_id, idx, CAST(greatest(s - pack_id * 512, 0) AS BIGINT) AS "offset",
       CAST(least(s + n, (pack_id + 1) * 512) - greatest(s, pack_id * 512) AS BIGINT) AS len
FROM piece"""
    q["token_hist_rendered"] = fx + tok + ", rm AS (SELECT * FROM tk) " + hist_sql("n_tokens", TOKEN_BUCKETS)
    q["runtime_estimate"] = fx + tok + """
SELECT CAST(e AS BIGINT) AS estimated_total_tokens, CAST(round(e * 3.0) AS BIGINT) AS total_training_tokens,
       CAST(2000.0 AS DOUBLE) AS assumed_tokens_per_sec, round(e * 3.0 / 2000.0 / 3600.0, 3) AS estimate_runtime_hours,
       CASE WHEN e <= 0 THEN 0.0 ELSE round(1000000.0 / e, 4) END AS estimated_epochs_for_target_tokens
FROM (SELECT sum(n_tokens) AS e FROM tk)"""
    q["encode_rows"] = """
WITH toks AS (
  SELECT doc_id AS idx, unnest(w) AS token, unnest(generate_series(0, len(w) - 1)) AS pos
  FROM (SELECT doc_id, {words} AS w FROM documents)
),
vocab AS (SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) - 1 AS id FROM toks GROUP BY token)
SELECT idx, CAST(pos AS INTEGER) AS pos, CAST(id AS BIGINT) AS id, token, false AS is_special
FROM toks JOIN vocab USING (token)""".replace("{words}", _words("text"))

    rv = "WITH " + RUN_EVENTS + "\n"
    q["metric_history"] = rv + """
SELECT run_id, CAST(step AS BIGINT) AS step, epoch, loss, eval_loss, learning_rate, grad_norm, gpu_mem_used_gb FROM pts"""
    q["latest_state"] = rv + """
SELECT run_id, CAST(s.step AS BIGINT) AS current_step, s.epoch AS current_epoch, CAST(coalesce(t, 0) AS BIGINT) AS total_steps,
       s.loss, s.eval_loss, s.learning_rate, s.grad_norm, s.gpu_mem_used_gb,
       round(CASE WHEN coalesce(t, 0) > 0 THEN least(100.0, s.step * 100.0 / t) ELSE 0.0 END, 4) AS progress_pct
FROM (SELECT run_id, arg_max(struct_pack(step := step, epoch := epoch, loss := loss, eval_loss := eval_loss,
                                         learning_rate := learning_rate, grad_norm := grad_norm,
                                         gpu_mem_used_gb := gpu_mem_used_gb), ts) AS s,
             arg_max(total_steps, ts) FILTER (WHERE total_steps > 0) AS t
      FROM pts GROUP BY run_id)"""
    q["run_status"] = rv + """
SELECT run_id,
       CASE arg_max(event, ts) FILTER (WHERE event IN ('error', 'done', 'cancelled'))
            WHEN 'error' THEN 'failed' WHEN 'done' THEN 'completed' WHEN 'cancelled' THEN 'cancelled' ELSE 'running' END AS status,
       CASE WHEN arg_max(event, ts) FILTER (WHERE event IN ('error', 'done', 'cancelled')) = 'error'
            THEN coalesce(arg_max(message, ts) FILTER (WHERE event = 'error'), 'Unknown training error')
            ELSE arg_max(message, ts) FILTER (WHERE event = 'error') END AS error_message
FROM run_events GROUP BY run_id"""
    q["grad_anomaly"] = rv + """
SELECT run_id, CAST(step AS BIGINT) AS step, grad_norm,
       CASE WHEN grad_norm > 10 AND (prev IS NULL OR grad_norm > prev * 3) THEN 'explosion'
            WHEN grad_norm < 1e-4 THEN 'vanishing' END AS alert
FROM (SELECT *, lag(grad_norm) OVER (PARTITION BY run_id ORDER BY ts) AS prev FROM pts)
WHERE grad_norm IS NOT NULL AND (grad_norm > 10 AND (prev IS NULL OR grad_norm > prev * 3) OR grad_norm < 1e-4)"""
    q["checkpoint_log"] = rv + "SELECT run_id, CAST(step AS BIGINT) AS step, epoch, path, size_bytes FROM ck"
    q["best_checkpoint"] = rv + """,
ev AS (SELECT run_id, step, eval_loss FROM pts WHERE eval_loss IS NOT NULL),
wl AS (SELECT ck.run_id, ck.step, ev.eval_loss FROM ck ASOF LEFT JOIN ev ON ck.run_id = ev.run_id AND ck.step >= ev.step),
best AS (SELECT run_id, arg_min(step, struct_pack(l := eval_loss, s := step)) AS bs FROM wl WHERE eval_loss IS NOT NULL GROUP BY run_id)
SELECT wl.run_id, CAST(wl.step AS BIGINT) AS step, wl.eval_loss, coalesce(wl.step = best.bs, false) AS is_best
FROM wl LEFT JOIN best USING (run_id)"""
    q["retention"] = rv + """
SELECT run_id, CAST(step AS BIGINT) AS step, path
FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY step DESC) AS r FROM ck) WHERE r > 3"""
    q["log_tail"] = rv + """
SELECT run_id, ts, line FROM (
  SELECT run_id, ts, CASE event WHEN 'stage' THEN '[stage] ' || stage WHEN 'checkpoint' THEN '[checkpoint] step ' || step
                               WHEN 'error' THEN '[error] ' || message END AS line,
         row_number() OVER (PARTITION BY run_id ORDER BY ts DESC) AS r
  FROM run_events WHERE event IN ('stage', 'checkpoint', 'error', 'info')) WHERE r <= 101"""
    q["dedupe_events"] = rv + "SELECT event, CAST(count(*) AS BIGINT) AS n FROM run_events GROUP BY event"

    cat = "WITH " + CATALOG.format(ws=WS) + "\n"
    q["vision_flag"] = cat + "SELECT repo_id, is_vision FROM vis"
    q["catalog_left_join"] = cat + "SELECT repo_id, downloaded, bookmarked FROM cl"
    q["list_models"] = cat + f"""
SELECT repo_id, strftime(created_at, {F_TS}) AS created_at FROM cl JOIN vis USING (repo_id) WHERE bookmarked AND NOT is_vision"""
    q["recent_models"] = cat + f"""
SELECT repo_id, strftime(last_used_at, {F_TS}) AS last_used_at FROM lib WHERE last_used_at IS NOT NULL
ORDER BY last_used_at DESC LIMIT 10"""
    q["model_search"] = cat + """
SELECT repo_id, downloads FROM mc WHERE pipeline_tag = 'text-generation' AND contains(lower(repo_id), 'red')
ORDER BY downloads DESC, repo_id LIMIT 20"""
    q["upsert_models"] = cat + """,
cur AS (SELECT mc.repo_id, display_name, CAST(NULL AS VARCHAR) AS architecture, param_count, CAST(2048 AS BIGINT) AS context_length,
               '' AS license, vis.is_vision, CAST(NULL AS VARCHAR) AS local_path, false AS downloaded, k % 10 = 0 AS bookmarked
        FROM mc JOIN vis USING (repo_id) WHERE k % 2 = 0),
dl AS (SELECT lib.repo_id, CASE WHEN lib.k % 2 = 1 THEN 'New ' || lib.repo_id ELSE '' END AS display_name,
              mc.family AS architecture, CAST(0 AS BIGINT) AS param_count,
              CAST(CASE WHEN lib.k % 4 = 0 THEN 4096 ELSE 0 END AS BIGINT) AS context_length, 'apache-2.0' AS license,
              mc.tags, lib.local_path
       FROM lib JOIN mc USING (repo_id))
SELECT repo_id,
       coalesce(nullif(d.display_name, ''), c.display_name, repo_id) AS display_name,
       coalesce(nullif(d.architecture, ''), c.architecture) AS architecture,
       coalesce(nullif(d.param_count, 0), c.param_count) AS param_count,
       coalesce(nullif(d.context_length, 0), c.context_length) AS context_length,
       coalesce(nullif(d.license, ''), c.license) AS license,
       CASE WHEN c.display_name IS NULL AND c.is_vision IS NULL THEN
            list_bool_or(list_transform(d.tags, lambda t: contains(t, 'vision') OR contains(lower(t), 'vl') OR contains(t, 'image-text')))
            OR contains(lower(repo_id), 'llava') OR contains(lower(repo_id), '-vl') OR contains(lower(repo_id), 'vision')
            ELSE c.is_vision END AS is_vision,
       coalesce(d.local_path, c.local_path) AS local_path,
       d.local_path IS NOT NULL OR coalesce(c.downloaded, false) AS downloaded,
       coalesce(c.bookmarked, false) AS bookmarked
FROM cur c FULL OUTER JOIN dl d USING (repo_id)"""
    q["list_datasets"] = cat + """
SELECT dataset_id, name, CAST(num_examples AS BIGINT) AS num_examples, quality_score,
       CASE WHEN quality_score IS NULL THEN 'n/a' WHEN quality_score < 50 THEN 'red' WHEN quality_score < 80 THEN 'amber'
            ELSE 'green' END AS quality_band
FROM registry"""
    q["runs_with_dataset"] = cat + "SELECT run_id, runs.dataset_id, name, status FROM runs JOIN registry USING (dataset_id)"
    q["orphan_runs"] = cat + "SELECT run_id, dataset_id FROM runs WHERE dataset_id NOT IN (SELECT dataset_id FROM registry)"
    q["dashboard"] = cat + """
SELECT CAST(count(*) AS BIGINT) AS total_runs, CAST(count_if(status IN ('running', 'preparing')) AS BIGINT) AS active_runs,
       CAST(count_if(status = 'completed') AS BIGINT) AS completed_runs, CAST(count_if(status = 'failed') AS BIGINT) AS failed_runs,
       (SELECT CAST(count(*) AS BIGINT) FROM cl) AS total_models,
       (SELECT CAST(count_if(downloaded) AS BIGINT) FROM cl) AS downloaded_models
FROM runs"""
    q["newest_runs"] = cat + f"""
SELECT run_id, strftime(min_ts, {F_TS}) AS created_at, status FROM runs ORDER BY min_ts DESC, run_id DESC LIMIT 6"""
    q["list_runs"] = cat + f"SELECT run_id, strftime(min_ts, {F_TS}) AS created_at, status FROM runs"
    q["param_estimate"] = cat + "SELECT * FROM models"
    q["vram_matrix"] = cat + "SELECT * FROM vram"
    q["fit_tiers"] = cat + """
SELECT repo_id, method, dtype, total_estimated_gb,
       CASE WHEN total_estimated_gb <= 8 THEN 8 WHEN total_estimated_gb <= 16 THEN 16 WHEN total_estimated_gb <= 24 THEN 24
            WHEN total_estimated_gb <= 48 THEN 48 END AS smallest_tier_gb
FROM vram"""
    q["fit_hosts"] = cat + """,
ld AS (SELECT host, device, arg_max(struct_pack(u := memory_used_mib, t := memory_total_mib), ts) AS l
       FROM devices GROUP BY host, device),
free AS (SELECT host, device, (l.t - l.u) / 1024.0 AS free_gb FROM ld)
SELECT host, device, method, dtype, CAST(count(*) AS BIGINT) AS models_that_fit, max(param_count) AS largest_param_count
FROM vram JOIN free ON vram.total_estimated_gb <= free.free_gb
GROUP BY host, device, method, dtype"""
    q["hparams"] = cat + """
SELECT repo_id, param_count,
       CASE WHEN 24.0 >= 4 * b THEN 'full' WHEN 24.0 >= 0.75 * b THEN 'lora' ELSE 'qlora' END AS method,
       CASE WHEN b <= 1.5 THEN 8 WHEN b <= 4 THEN 16 WHEN b <= 9 THEN 32 ELSE 64 END AS lora_r,
       2 * CASE WHEN b <= 1.5 THEN 8 WHEN b <= 4 THEN 16 WHEN b <= 9 THEN 32 ELSE 64 END AS lora_alpha,
       CASE WHEN b <= 4 THEN 2e-4 WHEN b <= 9 THEN 1e-4 ELSE 5e-5 END AS learning_rate,
       2 AS per_device_train_batch_size, 4 AS gradient_accumulation_steps,
       NOT (24.0 >= 0.75 * b) AS load_in_4bit,
       b >= 3 AS gradient_checkpointing
FROM (SELECT repo_id, param_count, param_count / 1e9 AS b FROM models WHERE param_count IS NOT NULL)"""
    q["fit_estimates"] = cat + """,
ld AS (SELECT host, device, arg_max(struct_pack(u := memory_used_mib, t := memory_total_mib), ts) AS l
       FROM devices GROUP BY host, device),
free AS (SELECT host, device, (l.t - l.u) / 1024.0 AS free_gb FROM ld)
SELECT repo_id, method, dtype, total_estimated_gb, CAST(count(free_gb) AS BIGINT) AS devices_that_fit, min(free_gb) AS smallest_free_gb
FROM vram LEFT JOIN free ON vram.total_estimated_gb <= free.free_gb
GROUP BY repo_id, method, dtype, total_estimated_gb"""
    q["hparams_chosen"] = cat + """
SELECT repo_id, param_count, m AS method,
       CASE WHEN b <= 1.5 THEN 8 WHEN b <= 4 THEN 16 WHEN b <= 9 THEN 32 ELSE 64 END AS lora_r,
       2 * CASE WHEN b <= 1.5 THEN 8 WHEN b <= 4 THEN 16 WHEN b <= 9 THEN 32 ELSE 64 END AS lora_alpha,
       CASE WHEN b <= 4 THEN 2e-4 WHEN b <= 9 THEN 1e-4 ELSE 5e-5 END AS learning_rate,
       1 AS per_device_train_batch_size, 8 AS gradient_accumulation_steps, m = 'qlora' AS load_in_4bit, b >= 3 AS gradient_checkpointing
FROM (SELECT repo_id, param_count, param_count / 1e9 AS b, CASE param_count % 3 WHEN 0 THEN 'full' WHEN 1 THEN 'qlora'
        ELSE CASE WHEN 16.0 >= 4 * param_count / 1e9 THEN 'full' WHEN 16.0 >= 0.75 * param_count / 1e9 THEN 'lora' ELSE 'qlora' END END AS m
      FROM models WHERE param_count IS NOT NULL)"""
    q["telemetry_devices"] = cat + f"SELECT * REPLACE (strftime(ts, {F_TS}) AS ts) FROM devices"
    q["latest_devices"] = cat + f"""
SELECT host, device, strftime(l.ts, {F_TS}) AS ts, l.u AS utilization_pct, l.p AS power_w, l.r AS ram_used_gb
FROM (SELECT host, device, arg_max(struct_pack(ts := ts, u := utilization_pct, p := power_w, r := ram_used_gb), ts) AS l
      FROM devices GROUP BY host, device)"""
    q["stream_latest_devices"] = q["latest_devices"]
    roll = f"""
SELECT host, device, strftime(ws, {F_TS}) AS window_start, strftime(ws + INTERVAL 1 MINUTE, {F_TS}) AS window_end,
       CAST(n AS BIGINT) AS n, avg_utilization_pct, max_utilization_pct, avg_memory_used_mib, max_memory_used_mib,
       avg_power_w, max_temperature_c
FROM rollup"""
    q["telemetry_rollup"] = cat + roll
    q["stream_telemetry_rollup"] = q["telemetry_rollup"]
    q["stream_grad_alerts"] = q["grad_anomaly"]
    q["stream_late_events"] = rv + """,
arrived AS (SELECT max(ts) AS newest FROM run_events WHERE step % 50 <> 7)
SELECT run_id, event, CAST(step AS BIGINT) AS step, ts, step % 50 = 7 AND ts < newest - 97200 AS late FROM run_events, arrived"""
    # The status machine, event by event in the order of time.
    q["run_status_lifecycle"] = rv + """,
life AS (SELECT run_id * 7 + step % 7 AS run_id, ts, step, step % 23 AS n,
  CASE step % 23 WHEN 0 THEN 'queued' WHEN 1 THEN 'preparing' WHEN 2 THEN 'started' WHEN 3 THEN 'cancelled' WHEN 4 THEN 'process_exit'
    WHEN 5 THEN 'process_exit' WHEN 6 THEN 'done' ELSE event END AS k FROM run_events),
ev AS (SELECT run_id, ts, step, {'k': k, 'c': CAST(CASE WHEN n = 4 THEN step % 2 WHEN step % 3 > 0 THEN 0 ELSE 1 END AS BIGINT),
    'g': CASE WHEN step % 8 = 0 THEN '' WHEN step % 4 = 0 THEN 'Unknown training error' ELSE 'e' || step END,
    't': CASE WHEN step % 5 > 0 AND step % 60 > 0
         THEN array_to_string(list_transform(range(greatest(1, step % 60 - 49), step % 60 + 1), lambda i: i || chr(10)), '')
         ELSE 'Worker process exited with an error.' END,
    's': '', 'm': CAST(NULL AS VARCHAR)} AS rec FROM life),
done AS (SELECT run_id, list_reduce(list(rec ORDER BY ts, step), lambda a, x: {'k': x.k, 'c': x.c, 'g': x.g, 't': x.t,
    's': CASE WHEN x.k IN ('queued', 'preparing', 'cancelled') THEN x.k WHEN x.k = 'started' THEN 'running' WHEN x.k = 'error' THEN 'failed'
         WHEN x.k = 'done' THEN 'completed' WHEN x.k = 'process_exit' AND a.s <> 'cancelled' THEN CASE x.c WHEN 0 THEN 'completed' ELSE 'failed' END
         ELSE a.s END,
    'm': CASE WHEN x.k = 'error' THEN x.g
         WHEN x.k = 'process_exit' AND a.s <> 'cancelled' AND x.c <> 0 AND coalesce(a.m, '') = '' THEN x.t ELSE a.m END},
  {'k': '', 'c': CAST(0 AS BIGINT), 'g': '', 't': '', 's': 'running', 'm': CAST(NULL AS VARCHAR)}) AS f FROM ev GROUP BY run_id)
SELECT run_id, f.s AS status, f.m AS error_message FROM done"""
    q["stream_run_state"] = rv + ",\nls AS (" + q["latest_state"][len(rv):] + "),\nrs AS (" + q["run_status"][len(rv):] + """)
SELECT ls.run_id, ls.current_step, ls.total_steps, ls.loss, ls.progress_pct, rs.status FROM ls JOIN rs USING (run_id)"""

    # Fitted on every labelled text, not on some of each language.
    q["langid_documents"] = f"{LANGID.replace(') WHERE r <= 100)', '))')} SELECT idx, language, score FROM detected"
    for name, by in (("lang_distribution", ""), ("lang_distribution_by_source", "source, ")):
        over = "PARTITION BY source" if by else ""
        q[name] = f"""{LANGID}, h AS (SELECT {by}language FROM detected JOIN documents ON doc_id = idx
  WHERE language IS NOT NULL AND length(trim(text, {WS})) >= 8)
SELECT {by}language, CAST(count(*) AS BIGINT) AS n, CAST(sum(count(*)) OVER ({over}) AS BIGINT) AS sampled
FROM h GROUP BY {by}language"""

    q["generation_prompts"] = """
SELECT conv_id AS idx, 'system: You are helpful.' || chr(10) || string_agg(role || ': ' || text, chr(10) ORDER BY turn)
       || chr(10) || 'assistant:' AS prompt
FROM conversations GROUP BY conv_id"""
    q["vocab_lookup"] = """
WITH dw AS (SELECT unnest({w}) AS token FROM documents),
vocab AS (SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) + 1 AS id FROM dw GROUP BY token),
cw AS (SELECT DISTINCT unnest({cw}) AS token FROM conversations)
SELECT CAST(id AS BIGINT) AS id, token, false AS is_special FROM vocab JOIN cw USING (token)""".format(
        w=_words("text"), cw=_words("text"))
    q["token_lookup"] = """
WITH dw AS (SELECT unnest({w}) AS token FROM documents),
vocab AS (SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) + 1 AS id FROM dw GROUP BY token),
cw AS (SELECT conv_id, turn, unnest({cw}) AS token, unnest(range(len({cw}))) AS pos FROM conversations)
SELECT conv_id, turn, CAST(pos AS INTEGER) AS pos, token, CAST(id AS BIGINT) AS id FROM cw LEFT JOIN vocab USING (token)""".format(
        w=_words("text"), cw=_words("text"))
    chatml = """string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn)"""
    q["chat_template"] = f"""
SELECT conv_id AS idx, {chatml} || '<|im_start|>assistant' || chr(10) AS prompt,
       CAST(octet_length(encode({chatml} || '<|im_start|>assistant' || chr(10))) AS BIGINT) AS n_tokens,
       hex(encode({chatml} || '<|im_start|>assistant' || chr(10))) AS ids
FROM conversations GROUP BY conv_id"""
    # Pairs of turns: a user's with the assistant's after it, the system text inside the first.
    q["chat_template_inst"] = f"""
WITH t AS (SELECT conv_id, turn, role, text, min(turn) FILTER (WHERE role = 'user') OVER (PARTITION BY conv_id) AS fu,
             first_value(CASE WHEN role = 'system' THEN text END) OVER (PARTITION BY conv_id ORDER BY turn) AS sys FROM conversations)
SELECT conv_id AS idx, string_agg(CASE role
    WHEN 'user' THEN '<s>[INST] ' || CASE WHEN turn = fu AND sys IS NOT NULL THEN '<<SYS>>' || chr(10) || sys || chr(10) || '<</SYS>>' || chr(10) || chr(10)
      ELSE '' END || trim(text, {WS}) || ' [/INST]'
    WHEN 'assistant' THEN ' ' || trim(text, {WS}) || ' </s>' ELSE '' END, '' ORDER BY turn) AS prompt
FROM t GROUP BY conv_id"""
    q["limit_tokens"] = f"""
SELECT conv_id, turn, CAST(len(list_slice({_words("text")}, 1, 16)) AS BIGINT) AS n_tokens,
       list_slice({_words("text")}, 1, 16)[-1] AS last_token
FROM conversations"""
    q["preview_chat"] = """
SELECT file_idx, CAST(pos AS INTEGER) AS pos, role, content FROM (
  SELECT CAST(dense_rank() OVER (ORDER BY conv_id) - 1 AS BIGINT) AS file_idx,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, role, text AS content
  FROM conversations) WHERE file_idx < 20"""
    q["csv_roundtrip"] = fx + """
SELECT CAST(dense_rank() OVER (ORDER BY idx) - 1 AS BIGINT) AS file_idx, CAST(pos AS INTEGER) AS pos, role, content
FROM expected WHERE dataset = 'alpaca'"""
    q["txt_roundtrip"] = f"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS ln, unnest(string_split(text, chr(10))) AS line
  FROM documents
)
SELECT CAST(row_number() OVER (ORDER BY doc_id, ln) - 1 AS BIGINT) AS line_idx, line AS text
FROM lines WHERE trim(line, {WS}) <> ''"""
    q["parquet_roundtrip"] = """
SELECT CAST(dense_rank() OVER (ORDER BY conv_id) - 1 AS BIGINT) AS file_idx,
       CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS pos, role, text AS content
FROM conversations"""
    q["validate_by_dataset"] = fx + VALIDATE_BY_DATASET.format(ws=WS, ctrl=CTRL) + "\n" + report_by_dataset()
    q["ingest_registry"] = f"""
WITH {DIRTY}
SELECT 'dirty-1' AS job_id, 'dirty' AS name, 'chatml' AS format, CAST(1 AS DOUBLE) AS confidence,
       CAST(count(DISTINCT conv_id) AS BIGINT) AS row_count, CAST(NULL AS VARCHAR) AS repaired_from FROM dirty
UNION ALL
SELECT 'docs-1', 'docs', 'raw_text', CAST(1 AS DOUBLE), CAST(count(*) AS BIGINT), NULL
FROM (SELECT unnest(regexp_split_to_array(text, '\r\n|\r|\n')) AS line FROM documents) WHERE trim(line, {WS}) <> ''"""
    q["ingest_report"] = f"""
WITH p AS ({q["profile"]}), v AS ({q["validation_report"]})
SELECT category, "count", issues_found, num_examples_checked, quality_score, duplicate_examples, entropy_score, avg_turns FROM v, p"""
    q["repair_registry"] = f"""
SELECT 'dirty-2' AS job_id, 'dirty (repaired)' AS name, 'chatml' AS format, output_count AS row_count, 'dirty-1' AS repaired_from,
       input_count, roles_fixed, merged_turns, duplicates_removed, empty_responses_removed, turns_truncated, examples_split, output_count,
       output_count AS num_examples, CAST(0 AS BIGINT) AS duplicate_examples FROM ({q["repair_summary"]})"""
    q["json_documents"] = """
SELECT doc_id, CAST(0 AS INTEGER) AS pos, 'user' AS role,
       '{"source" : "' || source || '",  "doc_id":' || doc_id || ', "a": [1,  2]}' AS content FROM documents"""
    q["strict_records"] = """
SELECT CAST(dense_rank() OVER (ORDER BY conv_id) - 1 AS BIGINT) AS file_idx,
       CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS pos, role, text AS content FROM conversations"""
    q["norm_errors"] = """
SELECT conv_id AS idx, conv_id % 8 IN (0, 3, 5) AS norm_error, CASE WHEN conv_id % 8 IN (0, 3, 5) THEN NULL ELSE 0 END AS n_messages
FROM (SELECT DISTINCT conv_id FROM conversations)"""
    life = q["run_status_lifecycle"][: q["run_status_lifecycle"].index("ev AS (")].rstrip().rstrip(",")
    q["event_routes"] = life + """
SELECT run_id, k AS route, CAST(count(*) AS BIGINT) AS n, min(ts) AS first_ts FROM life GROUP BY run_id, k"""
    q["prepare_objectives"] = f"""
SELECT 'sft' AS objective, split AS part, CAST(count(*) AS BIGINT) AS n FROM ({q["train_eval_split"]}) GROUP BY split
UNION ALL SELECT 'dpo', 'pair', CAST(count(*) AS BIGINT) FROM ({q["preference_triples"]})
UNION ALL SELECT 'kto', CAST(label AS VARCHAR), CAST(count(*) AS BIGINT) FROM ({q["kto_unpivot"]}) GROUP BY label"""
    q["profile_languages"] = f"""
SELECT (SELECT CAST(count(*) AS BIGINT) FROM documents) AS num_examples, language, n FROM ({q["lang_distribution"]})"""
    return q
