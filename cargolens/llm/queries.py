"""Registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cargolens.llm import audit, bpe, chat, editprint, hamming, minhash, packing, pii, quality, spelling, suffixes, tokencount, toxicity
from cargolens.llm.common import table


#: A conversation whose texts consist of control strings.
PROBE = "SELECT * FROM VALUES (-1L, 0L, 'user', '{0}'), (-1L, 1L, 'assistant', '{0}') AS t(conv_id, turn, role, text)"
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.chat_digest(rows.unionByName(spark.sql(PROBE.format(CONTROL_TEXT))))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_digest(table(spark, sf_dir, "documents"))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_passages(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.toxicity_scores(documents, labels, folds=5, fold=0)


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_digest(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.quality_scores(documents, labels, folds=3, fold=1)


def op8_hamming_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming.neighbour_table(table(spark, sf_dir, "embeddings"), k=10, every=100)


def op9_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return editprint.edited_digest(table(spark, sf_dir, "documents"))


def op10_bpe_chunk_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded_digest(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_formatting": op1_chat_formatting,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_suffix_array_dedup": op3_suffix_array_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_personal_data": op6_personal_data,
    "op7_quality_rules": op7_quality_rules,
    "op8_hamming_top_k": op8_hamming_top_k,
    "op9_edit_fingerprints": op9_edit_fingerprints,
    "op10_bpe_chunk_reuse": op10_bpe_chunk_reuse,
    "op11_filter_audit": op11_filter_audit,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_token_counts": op13_token_counts,
}

def _escaped_sql(text: str) -> str:
    out = f"replace({text}, '{chat.ESCAPE}', '{chat.ESCAPE * 2}')"
    for c in chat.CONTROLS:
        out = f"replace({out}, '{c}', '{c[0] + chat.ESCAPE + c[1:]}')"
    return out


ORACLE: dict[str, str] = {
    "op1_chat_formatting": f"""
WITH rows AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{CONTROL_TEXT}' UNION ALL SELECT -1, 1, 'assistant', '{CONTROL_TEXT}'),
numbered AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS n
  FROM rows),
grouped AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY n) AS spoken,
    coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '') AS learnt,
    CAST(sum(length({_escaped_sql("role")}) + length({_escaped_sql("text")})
      + {sum(map(len, chat.CONTROLS))}) AS BIGINT) AS formatted_chars
  FROM numbered GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(spoken) AS turns_sha256, CAST(length(learnt) AS BIGINT) AS loss_chars,
  sha256(learnt) AS loss_sha256, formatted_chars FROM grouped""",
    "op5_minhash_near_dedup": """
WITH RECURSIVE words AS (
  SELECT doc_id, [x FOR x IN string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x20\\x09-\\x0D]+') IF x <> ''] AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []
    WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)]) END AS s
  FROM words),
sizes AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM sets),
shingles AS (SELECT doc_id, unnest(s) AS x FROM sets),
meets AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM meets JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE 100 * c >= 80 * (p.n + q.n - c)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(id, other) AS (
  SELECT doc_id, doc_id FROM sizes
  UNION SELECT r.id, e.b FROM reach r JOIN both_ways e ON e.a = r.other),
least AS (SELECT id, min(other) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, n AS n_shingles, component_id, component_id = doc_id AS kept
FROM sizes JOIN least ON id = doc_id""",
    "op8_hamming_top_k": """
WITH codes AS (
  SELECT vec_id, [x > 0 AND NOT isnan(x) FOR x IN embedding] AS bits FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum([CAST(q.bits[i] <> c.bits[i] AS INTEGER) FOR i IN range(1, 65)]) AS distance
  FROM codes q JOIN codes c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank,
    vec_id, CAST(distance AS INTEGER) AS distance FROM pairs)
SELECT * FROM ranked WHERE rank <= 10""",
    "op11_filter_audit": """
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part FROM documents),
words AS (
  SELECT *, [x FOR x IN string_split_regex(t, '[\\x20\\x09-\\x0D]+') IF x <> ''] AS w,
    min(doc_id) OVER (PARTITION BY t) AS first_id
  FROM texts),
marks AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1),
masks AS (
  SELECT part, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS bad,
    list_concat(CASE WHEN len(w) < 100 THEN ['A'] ELSE [] END,
      CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN ['B'] ELSE [] END,
      CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN ['C'] ELSE [] END,
      CASE WHEN regexp_matches(t, '[#$%&*|]') THEN ['D'] ELSE [] END,
      CASE WHEN words.doc_id > first_id THEN ['E'] ELSE [] END) AS failed
  FROM words LEFT JOIN marks ON marks.doc_id = words.doc_id),
counts AS (
  SELECT part, failed, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE bad) AS toxic
  FROM masks GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS f, string_split(substr(filter_order, 1, step - 1), '') AS before
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
rows AS (
  SELECT part, filter_order, step, f, n, good, toxic, list_contains(failed, f) AS fails, failed = [f] AS alone,
    list_has_any(failed, before) AS gone FROM counts, steps),
figures AS (
  SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (WHERE NOT fails AND NOT gone), 0) AS kept,
    coalesce(sum(n) FILTER (WHERE fails AND NOT gone), 0) AS removed,
    coalesce(sum(n) FILTER (WHERE fails AND gone), 0) AS redundant,
    coalesce(sum(n) FILTER (WHERE alone), 0) AS unique_fails,
    coalesce(sum(good) FILTER (WHERE fails AND NOT gone), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (WHERE fails AND NOT gone), 0) AS toxic_lost
  FROM rows GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM figures""",
    "op12_spelling_variants": """
WITH RECURSIVE runs AS (
  SELECT doc_id, run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\u00c0-\u00ff]+')) AS run FROM documents)
  GROUP BY 1, 2),
bytes AS (
  SELECT *, flatten([CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)] END
    FOR c IN string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, '')]) AS b FROM runs),
hashes AS (
  SELECT run, n, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, flatten([[x::BIGINT, 0, 0, 0, 0, 0, 0, 0] FOR x IN b])),
    lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1)))) AS h FROM bytes),
damaged AS (
  SELECT CASE WHEN h % 97 = 0 THEN left(run, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2)
    ELSE run END AS word, n FROM hashes),
words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM damaged WHERE length(word) >= 5 GROUP BY 1 HAVING sum(n) >= 3),
cuts AS (
  SELECT word, n, left(word, i - 1) || '_' || substr(word, i + 1) AS hole, left(word, i - 1) || substr(word, i + 1) AS less
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT a.word, b.word AS other, b.n FROM cuts a JOIN cuts b ON a.hole = b.hole AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.less = b.word
  UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.less = b.word),
best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS form, max(n) AS form_n FROM pairs GROUP BY 1),
forms AS (
  SELECT word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * words.n THEN form END AS form,
    CASE WHEN form_n >= 2 * words.n THEN form_n END AS form_n
  FROM words LEFT JOIN best USING (word)),
walk(word, stop) AS (
  SELECT word, word FROM forms
  UNION ALL SELECT walk.word, forms.form FROM walk JOIN forms ON forms.word = walk.stop WHERE forms.form IS NOT NULL)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, stop AS root FROM forms f JOIN walk USING (word)
JOIN forms l ON l.word = stop WHERE l.form IS NULL""",
}
