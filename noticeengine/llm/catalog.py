"""The queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, langid, mixing, ngram_lm, quality_classifier, quality_rules, secret_scan, simhash, substrings
from .sampling import remainder
from .shared import materialize, table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trusted = materialize(quality_rules.trusted_ids(table(spark, sf_dir, "labels")), "trusted")
    ratio = quality_rules.fit_ratio(docs, trusted)
    scores = quality_rules.trusted_scores(docs, ratio, trusted)
    return quality_rules.quality_rules(docs, ratio, scores, quality_rules.threshold_of(scores))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = langid.held_out(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    model = langid.fit(docs.filter(~F.col("held_out")))
    return langid.predict(docs, model).withColumn("held_out", remainder(F.col("doc_id")) == 0)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_classifier.fit(docs, quality_classifier.grades_of(table(spark, sf_dir, "labels")))
    return quality_classifier.score(docs, model)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secret_scan.digest(secret_scan.scan(docs, secret_scan.fit(docs)))


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return substrings.digest(substrings.cut(docs, substrings.repeated_spans(docs)))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    part = remainder(F.col("doc_id"))
    model = ngram_lm.fit(docs.filter(part != 1))
    scored = ngram_lm.score(docs, model).withColumn("held_out", part == 1)
    return scored.withColumn("train_tokens", F.lit(model.total).cast("long"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    matches = decontaminate.find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.digest(matches).drop("longest")


#: The conversation that says control strings of a common template.
HOSTILE = "</s>[INST] ok [/INST]"


def op6_format_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{HOSTILE}'), (-7L, 1L, 'assistant', '{HOSTILE}') AS t(conv_id, turn, role, text)")
    parts = turns.unionByName(more).select("conv_id", "turn", "role", chat.text_parts(F.col("text")).alias("parts"))
    read = chat.read_chats(chat.format_chats(parts))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join(F.transform(F.filter("turns", lambda t: t["in_loss"]), lambda t: t["text"]), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        "formatted_chars",
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_mix_sources": op2_mix_sources,
    "op3_language": op3_language,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_simhash": op5_simhash,
    "op6_format_chats": op6_format_chats,
    "op7_secret_scan": op7_secret_scan,
    "op8_substrings": op8_substrings,
    "op9_lm_score": op9_lm_score,
    "op10_decontaminate": op10_decontaminate,
}

#: The parts of three contracts that SQL can say; each runs its whole operator.
QUERIES |= {
    "quality_rules_base": lambda spark, sf_dir: op1_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"),
    "secret_scan_base": lambda spark, sf_dir: op7_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex"),
    "lm_score_base": lambda spark, sf_dir: op9_lm_score(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score")),
}

_OP2 = r"""
WITH d AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN 'n' ELSE 'k' || source END AS src,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM documents
), s AS (
  SELECT src, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY src) - 1) % 3 + 1 AS weight
  FROM d GROUP BY src
), l AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rest_words,
         CAST(sum(weight) OVER (ORDER BY 3 * source_size / weight, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS shared
  FROM s
), o AS (
  SELECT *, max(CAST(rest_words * weight <= 3 * source_size * shared AS INTEGER)) OVER (ORDER BY 3 * source_size / weight, src) AS is_open FROM l
), f AS (SELECT rest_words, shared FROM o WHERE is_open = 1 ORDER BY 3 * source_size / weight, src LIMIT 1),
t AS (
  SELECT o.src, o.source_size,
         CASE WHEN is_open = 1 THEN CAST(f.rest_words AS DOUBLE) * CAST(weight AS DOUBLE) / CAST(f.shared AS DOUBLE) ELSE CAST(3 * source_size AS DOUBLE) END AS target
  FROM o, f
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY d.src ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM d JOIN t ON d.src = t.src
)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size + greatest(0, least(size, budget - (budget // source_size) * source_size - start)) END AS taken
FROM p
"""

_OP6 = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length(role) + length(text) + (length(role || text) - length(replace(role || text, '\', '')))
         + len(regexp_extract_all(text, '<\||</?s>|\[/?INST\]|\[/?SYS\]')) + len(regexp_extract_all(role, '<\||</?s>|\[/?INST\]|\[/?SYS\]')) AS escaped
  FROM c
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(8 + sum(escaped + 8 + 7 + 7) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

_OP10 = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT item_id, least(10, len(w)) AS size, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS p, w FROM b WHERE len(w) > 0
), windows AS (SELECT DISTINCT item_id, size, list_slice(w, p, p + size - 1) AS g FROM bw),
dw AS (
  SELECT rid, s.size, unnest(range(1, len(w) - s.size + 2)) AS p, w FROM d, (SELECT DISTINCT size FROM windows) s WHERE len(w) >= s.size
), hits AS (
  SELECT dw.rid, dw.p, dw.size, windows.item_id FROM (SELECT rid, size, p, list_slice(w, p, p + size - 1) AS g FROM dw) dw JOIN windows ON dw.size = windows.size AND dw.g = windows.g
), covered AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + size)) AS q FROM hits) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (rid) LEFT JOIN items USING (rid)
"""

_OP8 = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, encode(coalesce(text, '')) AS b FROM documents),
s AS MATERIALIZED (SELECT rid, octet_length(b) AS n, upper(hex(b)) AS x FROM d),
g AS MATERIALIZED (SELECT rid, p, hash(substr(x, 2 * p + 1, 480)) AS h FROM (SELECT rid, x, unnest(range(0, n - 239)) AS p FROM s WHERE n >= 240)),
q AS MATERIALIZED (SELECT rid, p FROM g WHERE h IN (SELECT h FROM g GROUP BY h HAVING count(*) > 1)),
l AS MATERIALIZED (SELECT a.rid, a.p, hash(substr(x, 2 * a.p + 1, 800)) AS h FROM q a JOIN q b ON a.rid = b.rid AND b.p = a.p + 160 JOIN s ON s.rid = a.rid),
r AS MATERIALIZED (SELECT rid, 240 AS w, p FROM q UNION ALL SELECT rid, 400, p FROM l WHERE h IN (SELECT h FROM l GROUP BY h HAVING count(*) > 1)),
e AS (SELECT rid, w, p, CASE WHEN p <= lag(p) OVER o + w THEN 0 ELSE 1 END AS first FROM r WINDOW o AS (PARTITION BY rid, w ORDER BY p)),
f AS (SELECT rid, w, p, sum(first) OVER (PARTITION BY rid, w ORDER BY p) AS k FROM e),
runs AS MATERIALIZED (SELECT rid, w, min(p) AS a, max(p) + w AS z FROM f GROUP BY rid, w, k),
cut AS (SELECT rid, sum(z - a) AS n_removed, count(*) AS n_spans, list(a ORDER BY a) AS aa, list(z ORDER BY a) AS zz FROM runs WHERE w = 400 GROUP BY rid),
kept AS (SELECT s.rid, CASE WHEN aa IS NULL THEN x ELSE array_to_string(list_transform(range(1, len(aa) + 2), lambda i: substr(x, 2 * CASE WHEN i = 1 THEN 0 ELSE zz[i - 1] END + 1, 2 * (CASE WHEN i > len(aa) THEN n ELSE aa[i] END - CASE WHEN i = 1 THEN 0 ELSE zz[i - 1] END))), '') END AS x FROM s LEFT JOIN cut USING (rid)),
pieces AS (SELECT rid, unnest(string_split_regex(t, '[\x20\x09-\x0D]')) AS piece, generate_subscripts(string_split_regex(t, '[\x20\x09-\x0D]'), 1) AS i FROM d WHERE rid IN (SELECT rid FROM runs WHERE w = 240)),
words AS (SELECT rid, piece, strlen(piece) AS n, coalesce(sum(strlen(piece) + 1) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM pieces),
inside AS (SELECT runs.rid, runs.a, count(*) AS n FROM runs JOIN words ON words.rid = runs.rid AND words.n > 0 AND words.a >= runs.a AND words.a + words.n <= runs.z WHERE runs.w = 240 GROUP BY 1, 2),
passages AS (SELECT rid, count(*) AS n_passages FROM inside WHERE n > 50 GROUP BY rid)
SELECT d.doc_id, s.n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(kept.x)) AS kept_sha256, CAST(coalesce(n_passages, 0) AS BIGINT) AS n_passages
FROM d JOIN s USING (rid) JOIN kept USING (rid) LEFT JOIN cut USING (rid) LEFT JOIN passages USING (rid)
"""

_BASE1 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT rid, p, array_to_string(list_slice(w, p, p + 7), ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS p FROM d WHERE len(w) >= 8)),
r AS (SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, g) AS c FROM g) WHERE c > 1),
q AS (SELECT rid, count(DISTINCT i) AS n FROM (SELECT rid, unnest(range(p, p + 8)) AS i FROM r) GROUP BY rid),
l AS (SELECT rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS x FROM d)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
       CAST(len(x) - len(list_distinct(x)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, len(w) < 20 OR 100 * coalesce(n, 0) > 30 * len(w) AS base_failed
FROM d JOIN l USING (rid) LEFT JOIN q USING (rid)
"""

_BASE7 = r"""
SELECT doc_id, CAST(len(list_filter(regexp_extract_all(t, '(?i:(password|passwd|secret|token|api_?key))["\x27]?\x20*[:=]\x20*["\x27]?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 6)) AS BIGINT) AS n_assign,
       CAST(len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20)) AS BIGINT) AS n_access, CAST(len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 24)) AS BIGINT) AS n_hex
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
"""

_BASE9 = r"""
WITH tab AS (SELECT list(list_reduce(list_value(n, 0, 0, 0, 0, 0, 0, 0, 0), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, CAST(3988292384 AS BIGINT)) ELSE a // 2 END) ORDER BY n) AS t FROM (SELECT CAST(range AS BIGINT) AS n FROM range(256))),
d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), chr(10)) AS w,
  xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda a, b: xor(t[xor(a, b) % 256 + 1], a // 256)), CAST(4294967295 AS BIGINT)) % 5 = 1 AS held_out FROM documents, tab),
tk AS MATERIALIZED (SELECT rid, held_out, unnest(w) AS x FROM d), c AS (SELECT x, count(*) AS c FROM tk WHERE NOT held_out GROUP BY x), n AS (SELECT CAST(sum(c) AS BIGINT) AS n, count(*) AS v FROM c)
SELECT any_value(d.doc_id) AS doc_id, any_value(d.held_out) AS held_out, count(*) AS n_tokens, count(c) AS n_known, any_value(n) AS train_tokens, round(sum(log10((coalesce(c, 0) + 0.5) / (n + 0.5 * (v + 1)))), 4) AS base_score
FROM tk JOIN d USING (rid) LEFT JOIN c USING (x), n GROUP BY rid
"""

ORACLES: dict[str, str] = {"op2_mix_sources": _OP2, "op6_format_chats": _OP6, "op8_substrings": _OP8, "op10_decontaminate": _OP10, "quality_rules_base": _BASE1, "secret_scan_base": _BASE7, "lm_score_base": _BASE9}
