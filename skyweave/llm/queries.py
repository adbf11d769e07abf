"""The queries of this subpackage, opN_<name>(spark, sf_dir), and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skyweave.llm import bpe, chat_format, decontamination, divergence, exact_dedup, importance, jaccard_join, license_scan, quality, sharding, substring_dedup, token_files, toxicity
from skyweave.storage import fresh_folder


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Where a public vocabulary lies on this machine; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(substring_dedup.deduplicate(documents(spark, sf_dir)))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.round_trip(documents(spark, sf_dir), vocabulary()))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.assign(documents(spark, sf_dir)).drop("n_chunks")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat_format.digests(chat_format.format_conversations(rows))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(documents(spark, sf_dir), labels(spark, sf_dir))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.hits(documents(spark, sf_dir), benchmark(spark, sf_dir))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.fit(docs, labels(spark, sf_dir)))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_folder(spark, "tokens")
    token_files.write(documents(spark, sf_dir), folder, vocabulary("word_bpe_49k.json"))
    return token_files.digests(spark, folder)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(documents(spark, sf_dir), benchmark(spark, sf_dir)).select("doc_id", "n_features", "weight", "score", "rank")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_bpe, op3_exact_dedup, op4_chat_format, op5_quality, op6_jaccard_join, op7_license_scan, op8_decontamination, op9_toxicity, op10_sharding, op11_token_files, op12_importance_resampling, op13_source_divergence)}

#: Words of the contract, as a DuckDB pattern.
WORD = r"[^\x20\x09-\x0D]+"

OP1 = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM documents),
s AS (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS k FROM w WHERE len(words) >= 13),
g AS (SELECT doc_id, k, array_to_string(words[k:k + 12], ' ') AS win FROM s),
m AS (SELECT win, min(doc_id) AS least FROM g GROUP BY win),
r AS (SELECT DISTINCT doc_id, unnest(range(k, k + 13)) AS k FROM g JOIN m USING (win) WHERE doc_id > least),
gone AS (SELECT doc_id, list(k) AS ks, count(*) AS n FROM r GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string([words[i] FOR i IN range(1, len(words) + 1) IF ks IS NULL OR NOT list_contains(ks, i)], ' '), '')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id)
"""

OP3 = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

#: Code points of the template's marks, and of a text once more for each escaped character.
OP4 = r"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]', NULL UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]', NULL),
e AS (SELECT *, 2 * length(text) - length(regexp_replace(text, '[\\<\[\]]', '', 'g')) AS hidden,
  CASE role WHEN 'system' THEN 16 WHEN 'user' THEN 18 WHEN 'assistant' THEN 13
    ELSE 19 + 2 * length(role) - length(regexp_replace(role, '[\\<\[\]]', '', 'g')) END AS marks,
  row_number() OVER w - 1 AS k, coalesce(lag(role) OVER w, '') AS state, lead(role) OVER w IS NULL AS ends
  FROM r WINDOW w AS (PARTITION BY conv_id, alone ORDER BY turn NULLS FIRST, role, text)),
f AS (SELECT *, CASE
  WHEN NOT CASE state WHEN '' THEN role IN ('system', 'user') AND k = 0 WHEN 'system' THEN role = 'user' WHEN 'user' THEN role = 'assistant' WHEN 'assistant' THEN role = 'user' ELSE FALSE END
    THEN 'turn ' || k || ': ' || CASE role WHEN '' THEN 'null' ELSE role END || ' after ' || CASE state WHEN '' THEN 'start' ELSE state END
  WHEN ends AND role NOT IN ('assistant', 'user') THEN 'ends with ' || role END AS wrong FROM e)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(hidden + marks) AS BIGINT) AS formatted_chars, count(wrong) = 0 AS valid, coalesce(arg_min(wrong, k), '') AS fault
FROM f GROUP BY conv_id, alone
"""

OP6 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 5 THEN [array_to_string(words[k:k + 4], ' ') FOR k IN range(1, len(words) - 3)]
  WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
r AS (SELECT doc_id, doc_id AS seen FROM w UNION SELECT r.doc_id, l.y FROM r JOIN l ON r.seen = l.x)
SELECT doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(seen) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""

quoted = ", ".join("({}, '{}', {}, '{}')".format(k, name, m, gram) for k, name, m, gram in license_scan.template_rows())

OP7 = f"""
WITH t(template, license, m, gram) AS (VALUES {quoted}),
p AS (SELECT DISTINCT doc_id, text, unnest(list_distinct([text] || regexp_split_to_array(text, '\\n\\s*\\n') || string_split(text, chr(10)))) AS part FROM documents WHERE text IS NOT NULL),
s AS (SELECT DISTINCT doc_id, text, trim(regexp_replace(lower(part), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS segment FROM p),
w AS (SELECT *, string_split(segment, ' ') AS ws FROM s),
g AS (SELECT doc_id, text, segment, list_distinct([ws[i] || ' ' || ws[i + 1] FOR i IN range(1, len(ws))]) AS grams FROM w WHERE len(ws) > 1),
u AS (SELECT doc_id, text, segment, len(grams) AS n, unnest(grams) AS gram FROM g),
c AS (SELECT doc_id, text, segment, n, template, license, m, count(*) AS c FROM u JOIN t USING (gram) GROUP BY ALL HAVING 200 * count(*) >= {license_scan.PERCENT} * (n + m)),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, text, segment ORDER BY c / (n + m) DESC, license, template) AS k FROM c)
SELECT doc_id, license, count(*) AS n_segments, max(CAST(floor(2000 * c / (n + m)) AS INTEGER)) AS dice_pm FROM b WHERE k = 1 GROUP BY doc_id, license
"""

OP13 = r"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT doc, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT doc) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY lang, source, term),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
t AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY lang, source),
g AS (SELECT DISTINCT lang, source FROM d),
p AS (SELECT lang, source, term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (coalesce(t.n, 0) + v.v) AS p, 1 + 1000000000::HUGEINT * (k.n + 1) // (v.n + v.v) AS q
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN t USING (lang, source) LEFT JOIN c USING (lang, source, term)),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b USING (lang, term) GROUP BY ALL),
r AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(s.value, 0) AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
    LEFT JOIN s ON s.lang = x.lang AND s.source = x.source AND s.item = y.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM r QUALIFY part = 'pair' OR row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) <= 200
"""

ORACLE: dict[str, str] = {"op1_substring_dedup": OP1, "op3_exact_dedup": OP3, "op4_chat_format": OP4, "op6_jaccard_join": OP6, "op7_license_scan": OP7, "op13_source_divergence": OP13}
