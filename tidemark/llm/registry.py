"""The queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, exact, fim, fingerprints, langid, licences, neardup, packing, quality, spelling, token_files, toolcalls, toxicity
from tidemark.llm.support import new_folder
from tidemark.session import table

CAPACITY = 2048


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digest(bpe.encode_whole(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN), path)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "token-files")
    token_files.write(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return token_files.read(spark, folder, ids=False)


def held_out():
    """Documents whose labels nothing learns from."""
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def fit_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Model:
    labels = table(spark, sf_dir, "labels").where(~held_out()).select("doc_id", "toxic")
    return toxicity.fit(docs, labels)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, fit_toxicity(spark, docs, sf_dir))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, sf_dir, "documents"), keep="max")


OP4_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), n=3, percent=85)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(quality.count_texts(table(spark, sf_dir, "documents")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("quality", 6).alias("quality"))


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op6_quality that SQL can express: all but the verdict."""
    counts = quality.count_texts(table(spark, sf_dir, "documents")).withColumn("base_failed", quality.base_failed())
    return counts.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


COUNTS_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS gram FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 7)) AS i FROM w WHERE len(ws) >= 8)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (SELECT unnest(generate_series(0, 7)) AS k) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
       len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, len(ws) < 20 OR 100 * coalesce(c.n, 0) > 30 * len(ws) AS base_failed
FROM w LEFT JOIN c USING (doc_id)
"""


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.identify(table(spark, sf_dir, "pages"), langid.fit_text(table(spark, sf_dir, "documents")))
    return found.select("page_id", "lang", F.round("probability", 6).alias("probability"), "text_lang", "declared", "suffix", "host")


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = licences.scan(docs, licences.fit(docs))
    families = F.array_join(F.array_sort(F.array_distinct("matches.family")), ",")
    return found.select("doc_id", "n_paragraphs", families.alias("families"), F.size("matches").alias("n_matches"), F.round(F.array_max("matches.p"), 6).alias("probability"))


def op9_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = toolcalls.from_turns(table(spark, sf_dir, "conversations"))
    placed = toolcalls.lines(toolcalls.levels(toolcalls.link(calls, results)), toolcalls.TOOLS)
    return placed.select("conv_id", "call_id", "seq", "level", "result_seq", "n_calls", "n_results", "orphan", "valid", F.md5("line").alias("line_md5"))


OP9_SQL = """
WITH RECURSIVE turns AS (
  SELECT conv_id, turn, role, text, len(regexp_split_to_array(trim(coalesce(text, '')), '[ \t\n\x0B\f\r]+')) AS words FROM conversations),
said AS (
  SELECT *, CASE WHEN conv_id % 4 = 1 THEN -turn ELSE turn END AS seq, CASE role WHEN 'user' THEN 'answer' ELSE 'setup' END AS name,
         role = 'user' AND conv_id % 11 = 5 AND text IS NOT NULL AS bare,
         CASE WHEN role = 'user' AND conv_id % 11 = 5 THEN coalesce(to_json(text)::VARCHAR, '{}')
              WHEN role = 'user' THEN '{"n_words":' || CASE WHEN conv_id % 6 = 4 THEN '"' || words || '"' ELSE words::VARCHAR END || coalesce(',"text":' || to_json(text)::VARCHAR, '') || ',"turn":' || turn || '}'
              ELSE coalesce('{"text":' || to_json(text)::VARCHAR || '}', '{}') END AS arguments
  FROM turns WHERE role IN ('user', 'system')),
calls AS (
  SELECT *, count(*) OVER (PARTITION BY conv_id, turn) AS n_calls FROM said
  QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY name, text NULLS FIRST) = 1),
results AS (
  SELECT conv_id, turn, min(text) AS content, count(*) AS n_results FROM turns WHERE role = 'assistant' GROUP BY conv_id, turn),
edges AS (
  SELECT c.conv_id, c.turn, p.turn AS before FROM calls c JOIN calls p ON p.conv_id = c.conv_id AND c.name = 'answer'
    AND (p.turn = c.turn - 2 OR c.conv_id % 5 = 2 AND p.turn = c.turn - 4 OR c.conv_id % 7 = 3 AND c.turn < 2 AND p.turn = c.turn + 2)),
walk AS (
  SELECT conv_id, turn, 0 AS level FROM calls c WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.conv_id = c.conv_id AND e.turn = c.turn)
  UNION
  SELECT e.conv_id, e.turn, w.level + 1 FROM walk w JOIN edges e ON e.conv_id = w.conv_id AND e.before = w.turn),
levels AS (SELECT conv_id, turn, max(level) AS level FROM walk GROUP BY conv_id, turn),
linked AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, 'call_' || coalesce(c.turn, r.turn - 1) AS call_id, c.seq, c.turn, r.turn AS result_seq,
         coalesce(c.n_calls, 0) AS n_calls, coalesce(r.n_results, 0) AS n_results, c.turn IS NULL AS orphan, c.name, coalesce(c.arguments, '{}') AS arguments, r.content,
         CASE WHEN c.turn IS NULL THEN '"no call"' WHEN bare THEN '"not an object"'
              WHEN c.name = 'answer' AND c.conv_id % 11 = 5 THEN '"missing n_words","missing text","missing turn"'
              ELSE concat_ws(',', CASE WHEN c.name = 'answer' AND c.conv_id % 6 = 4 THEN '"n_words is no integer"' END, CASE WHEN c.text IS NULL THEN '"missing text"' END) END AS problems
  FROM calls c FULL JOIN results r ON r.conv_id = c.conv_id AND r.turn = c.turn + 1)
SELECT l.conv_id, call_id, seq, v.level::BIGINT AS level, result_seq, n_calls, n_results, orphan, problems = '' AS valid,
       md5('{"arguments":' || arguments || ',"call_id":"' || call_id || '","name":' || coalesce('"' || name || '"', 'null') || ',"problems":[' || problems || '],"result":' || coalesce(to_json(content)::VARCHAR, 'null') || '}') AS line_md5
FROM linked l LEFT JOIN levels v ON v.conv_id = l.conv_id AND v.turn = l.turn
"""


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.cut_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0, capacity=CAPACITY)
    return packing.pack(pieces, CAPACITY, order=("doc_id", "piece"))


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints.compare(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next", "shift_edited", "aligned_edited")


def fingerprint_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op11_fingerprints that SQL can express: the edited texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.lit(None).alias("keys"), F.lit(None).alias("places"))
    return fingerprints.edited(docs).select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"))


EDITS_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, length(t) AS n_chars, coalesce(lead(t) OVER (ORDER BY doc_id DESC), first_value(t) OVER (ORDER BY doc_id DESC)) AS next FROM d)
SELECT doc_id, n_chars, sha256(substr(t, 1, n_chars - n_chars // 2) || substr(next, 1, n_chars // 2)) AS edited_sha256 FROM n
"""


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.lexicon(table(spark, sf_dir, "documents")))


OP12_SQL = r"""
WITH RECURSIVE crcs AS (
  SELECT list(c ORDER BY i) AS crc FROM (SELECT i, list_reduce(list_prepend(i, generate_series(0::BIGINT, 7::BIGINT)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) t(i))),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents),
bytes AS (
  SELECT run, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [192 + (unicode(x) >> 6)::BIGINT, 128 + (unicode(x) & 63)::BIGINT] END)) AS b
  FROM runs WHERE length(run) >= 7),
drawn AS (
  SELECT run, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1]))) AS h FROM bytes, crcs),
words AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, count(*) AS n
  FROM drawn GROUP BY 1 HAVING length(word) >= 7 AND count(*) >= 2),
cut AS (SELECT word, n, i, substr(word, 1, i) AS pre, substr(word, i + 2) AS suf FROM (SELECT word, n, unnest(generate_series(0, length(word) - 1)) AS i FROM words)),
pairs AS (
  SELECT a.word, b.word AS near, a.n AS n, b.n AS near_n FROM cut a JOIN cut b ON a.pre = b.pre AND a.suf = b.suf AND a.i = b.i AND a.word <> b.word
  UNION SELECT c.word, w.word, c.n, w.n FROM cut c JOIN words w ON w.word = c.pre || c.suf
  UNION SELECT w.word, c.word, w.n, c.n FROM cut c JOIN words w ON w.word = c.pre || c.suf),
best AS (SELECT word, n, count(*) OVER (PARTITION BY word) AS n_near, near, near_n FROM pairs QUALIFY row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) = 1),
known AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * w.n THEN near END AS form, CASE WHEN near_n >= 10 * w.n THEN near_n END AS form_n FROM words w LEFT JOIN best b USING (word)),
walk AS (
  SELECT word, word AS root, 0 AS d FROM known
  UNION ALL SELECT walk.word, k.form, d + 1 FROM walk JOIN known k ON k.word = walk.root WHERE k.form IS NOT NULL)
SELECT k.word, form, r.root, n, n_near, form_n FROM known k JOIN (SELECT word, arg_max(root, d) AS root FROM walk GROUP BY word) r USING (word)
"""


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.rearrange(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c, 256)
    return made.select(
        "doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"),
        digest(F.col("output")).alias("output_sha256"), digest(fim.restore(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


OP13_SQL = r"""
WITH u AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents),
h AS (SELECT *, len(units) AS n, ('0x' || d[1:8])::BIGINT AS h1, ('0x' || d[9:16])::BIGINT AS h2, ('0x' || d[17:24])::BIGINT AS h3, ('0x' || d[25:32])::BIGINT AS h4 FROM u),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(units[1:lo], '') AS pre, array_to_string(units[lo + 1:hi], '') AS mid, array_to_string(units[hi + 1:], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_token_files": op2_token_files,
    "op3_toxicity": op3_toxicity,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_near_dedup": op5_near_dedup,
    "op6_quality": op6_quality,
    "quality_counts": quality_counts,
    "op7_language": op7_language,
    "op8_licences": op8_licences,
    "op9_tool_calls": op9_tool_calls,
    "op10_packing": op10_packing,
    "op11_fingerprints": op11_fingerprints,
    "fingerprint_edits": fingerprint_edits,
    "op12_spelling": op12_spelling,
    "op13_fim": op13_fim,
    "pipeline": pipeline,
}
ORACLES: dict[str, str] = {"op4_exact_dedup": OP4_SQL, "quality_counts": COUNTS_SQL, "op9_tool_calls": OP9_SQL, "fingerprint_edits": EDITS_SQL, "op12_spelling": OP12_SQL, "op13_fim": OP13_SQL}
