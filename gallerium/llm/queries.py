"""The subpackage's queries: thin, over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import avi, bpe, chat, fill_middle, filter_audit, host_rules, html_text, language, minhash_join, order_minhash, packing, suffix_dedup, toxicity
from .common import documents

VOCABULARY = "word_bpe_49k.json"


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def remainder(n: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % n


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.edited_fingerprints(documents(spark, sf_dir))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), vocabulary())


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op4_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    text = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))
    return chat.read_back(chat.windows(turns.unionByName(extra)))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = remainder(4) == 2
    filters = language.learn(docs.where(F.col("lang").isNotNull() & ~F.coalesce(held, F.lit(False))).select("doc_id", F.col("text").cast("string"), "lang"))
    return language.identify(docs.select(F.col("doc_id").cast("long"), held.alias("held_out"), "text"), filters, ["doc_id", "held_out"])


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where(remainder(5) != 0))
    return toxicity.score(docs.select(F.col("doc_id").cast("long"), (remainder(5) == 0).alias("held_out"), "text"), model, ["doc_id", "held_out"])


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup.remove_repeats(documents(spark, sf_dir))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(documents(spark, sf_dir), vocabulary())
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_avi(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = avi.read_media(avi.to_media(documents(spark, sf_dir)))
    timed = F.transform("clips", lambda c: F.format_string("%.2f-%.2f:%.1f", c["start_s"], c["end_s"], c["mean"]))
    return read.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", F.array_join(timed, ";").alias("clips"))


def op10_minhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_join.components(documents(spark, sf_dir), words=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept")


def op11_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = host_rules.judge(documents(spark, sf_dir))
    return judged.select(F.col("doc_id").cast("long"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.coalesce("reason", F.lit("")).alias("reason"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.transform(documents(spark, sf_dir))
    text = fill_middle.restored(F.col("form"), F.col("output"))
    return made.select(F.col("doc_id").cast("long"), "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (op1_order_minhash, op2_packing, op3_html_text, op4_chat_windows, op5_language_id, op6_toxicity, op7_suffix_dedup, op8_bpe_transducer, op9_avi, op10_minhash_join, op11_host_rules, op12_filter_audit, op13_fill_middle, pipeline)
}

#: DuckDB runs over whole tables what SQL can express at all; the others are tested against brute force in tests/llm.
ORACLES = {
    "op4_chat_windows": f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
s AS (SELECT *, row_number() OVER w AS seq, len(regexp_extract_all(text, '{chat.PIECES}')) + {chat.TURN_TOKENS} AS tokens,
  {len(chat.OPEN + chat.CUT + chat.CLOSE)} + length(replace(replace(role, '\\', '\\\\'), '<', '<\\')) + length(replace(replace(text, '\\', '\\\\'), '<', '<\\')) AS size
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
y AS (SELECT *, coalesce(max(tokens) FILTER (seq = 1 AND role = '{chat.SYSTEM}') OVER (PARTITION BY conv_id), 0) AS system FROM s),
b AS (SELECT *, greatest(({chat.BUDGET} - {chat.HISTORY} - system) // 2, {chat.BUDGET // chat.LEAST_STRIDE}) AS stride, coalesce(sum(tokens) OVER (PARTITION BY conv_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM y),
p AS (SELECT *, (before // stride) AS slot, 2 * sum((tokens > stride)::INT) OVER (PARTITION BY conv_id ORDER BY seq) - (tokens > stride)::INT AS part, seq = 1 AND role = '{chat.SYSTEM}' AS is_system FROM b),
g AS (SELECT conv_id, slot, part, min(before) AS first FROM p GROUP BY ALL),
f AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY first) AS k FROM g),
q AS (SELECT p.*, f.k FROM p JOIN f ON p.conv_id IS NOT DISTINCT FROM f.conv_id AND p.slot = f.slot AND p.part = f.part),
again AS (SELECT q.conv_id, sum(q.size) AS size FROM q JOIN f ON q.conv_id IS NOT DISTINCT FROM f.conv_id
  WHERE (q.is_system AND f.k > 1) OR (NOT q.is_system AND f.k = q.k + 1 AND f.first - q.before <= {chat.HISTORY}) GROUP BY 1)
SELECT s.conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY seq)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = '{chat.TARGET}'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY seq) FILTER (role = '{chat.TARGET}'), '')) AS loss_sha256,
  (sum(s.size) + coalesce(max(again.size), 0))::BIGINT AS formatted_chars
FROM s LEFT JOIN again ON s.conv_id IS NOT DISTINCT FROM again.conv_id GROUP BY s.conv_id
""",
    "op10_minhash_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS words FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, CASE WHEN len(words) < 3 THEN [array_to_string(words, ' ')] ELSE [array_to_string(words[i : i + 2], ' ') FOR i IN range(1, len(words) - 1)] END AS l FROM w WHERE len(words) > 0), unnest(l) AS u(sh)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT doc_id AS start, doc_id AS node FROM documents UNION SELECT r.start, e.b FROM r JOIN e ON e.a = r.node),
m AS (SELECT start AS doc_id, min(node) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM documents d JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)
""",
    "op11_host_rules": rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS x, row_number() OVER () AS k FROM documents),
w AS (SELECT *, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS words, [l FOR l IN string_split(x, chr(10)) IF regexp_matches(l, '[^\x20\x09-\x0D]')] AS lines FROM d),
t AS (SELECT k, i, list_extract(words, i) || ' ' || list_extract(words, i + 1) || ' ' || list_extract(words, i + 2) AS three FROM (SELECT k, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
again AS (SELECT k, i FROM t QUALIFY count(*) OVER (PARTITION BY k, three) > 1),
covered AS (SELECT k, count(DISTINCT i + j) AS n FROM again, range(3) AS r(j) GROUP BY k),
c AS (SELECT doc_id, host, len(words)::BIGINT AS n_words, length(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars, (length(x) - length(translate(x, '#*$%&|<>', '')))::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines FROM w LEFT JOIN covered USING (k)),
f AS (SELECT *, n_words < {host_rules.LEAST_WORDS} OR 100 * n_repeat_words > {host_rules.MOST_REPEATED_PERCENT} * n_words AS base, 10 * n_symbols > n_words AS symbols, 100 * n_dup_lines > 30 * n_lines AS lines,
  word_chars < 3 * n_words OR word_chars > 10 * n_words AS lengths FROM c),
s AS (SELECT host, rule, count(*) AS n, sum(failed::INT)::DOUBLE AS failed FROM (UNPIVOT (SELECT host, base, symbols, lines, lengths FROM f) ON base, symbols, lines, lengths INTO NAME rule VALUE failed) GROUP BY ALL),
m AS (SELECT rule, count(*) AS hosts, sum(n)::DOUBLE AS rows, sum(failed) / sum(n) AS mean, sum(n * n)::DOUBLE / sum(n) AS big, sum(failed * failed / n) - sum(failed) * sum(failed) / sum(n) AS between FROM s GROUP BY rule),
e AS (SELECT *, (between - mean * (1 - mean) * (hosts - 1)) / nullif(mean * (1 - mean) * (rows - big - (hosts - 1)), 0) AS excess FROM m),
p AS (SELECT rule, mean, 1 / least(greatest(coalesce(excess, 0), 1e-6), 0.999) - 1 AS weight FROM e),
r AS (SELECT host, rule, (failed + mean * weight) / (n + weight) AS rate FROM s JOIN p USING (rule)),
v AS (SELECT host, max(rate) > {host_rules.REJECT} AS rejected, coalesce(list(rule) FILTER (rate >= {host_rules.TRUST}), []) AS strict FROM r GROUP BY host),
j AS (SELECT *, CASE WHEN base THEN 'base' WHEN rejected THEN 'host' WHEN (symbols AND list_contains(strict, 'symbols')) OR (lines AND list_contains(strict, 'lines')) OR (lengths AND list_contains(strict, 'lengths')) THEN 'rule' ELSE '' END AS reason FROM f JOIN v USING (host))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base AS base_failed, reason = '' AS kept, reason FROM j
""",
    "op12_filter_audit": rf"""
WITH RECURSIVE l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1),
d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
f AS (SELECT part, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic,
  CASE WHEN len(words) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
  || CASE WHEN 100 * (length(x) - length(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 2 * length(x) THEN 'C' ELSE '' END
  || CASE WHEN regexp_matches(x, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY x) THEN 'E' ELSE '' END AS fails
  FROM d LEFT JOIN l USING (doc_id)),
g AS (SELECT part, good, toxic, fails, count(*) AS n FROM f GROUP BY ALL),
o AS (SELECT '' AS filter_order UNION ALL SELECT filter_order || c FROM o, unnest(['A', 'B', 'C', 'D', 'E']) AS u(c) WHERE NOT contains(filter_order, c)),
s AS (SELECT filter_order, step::INT AS step, filter_order[1 : step - 1] AS applied, filter_order[step] AS filter FROM o, range(1, 6) AS r(step) WHERE length(filter_order) = 5),
x AS (SELECT g.*, s.*, translate(fails, applied, '') = fails AS passed, contains(fails, filter) AS failed FROM g, s),
a AS (SELECT part, filter_order, step, filter, sum(CASE WHEN passed AND NOT failed THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN passed AND failed THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN NOT passed AND failed THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN fails = filter THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN passed AND failed AND good THEN n ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN passed AND failed AND toxic THEN n ELSE 0 END)::BIGINT AS toxic_lost FROM x GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM a
""",
    "op13_fill_middle": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
n AS (SELECT doc_id, x, w, len(w)::BIGINT AS n, [('0x' || h[8 * k + 1 : 8 * k + 8])::BIGINT FOR k IN range(4)] AS draw FROM d),
c AS (SELECT *, list_extract(draw, 1) % (n + 1) AS one, list_extract(draw, 2) % (n + 1) AS two,
  CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR list_extract(draw, 3) % 100 >= {fill_middle.PLAIN_FROM} THEN 'plain' WHEN list_extract(draw, 4) % 100 < {fill_middle.SPM_BELOW} THEN 'spm' ELSE 'psm' END AS form FROM n),
p AS (SELECT *, array_to_string(w[1 : least(one, two)], '') AS prefix, array_to_string(w[least(one, two) + 1 : greatest(one, two)], '') AS middle, array_to_string(w[greatest(one, two) + 1 :], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(x) AS restored_sha256 FROM p
""",
}
