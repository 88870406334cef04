"""One query per operator over its whole table, with SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.llm import bitsliced, byte_bpe, direct_codes, embed_dedup, maxent_lm, minmax, mixing, periodic_runs, piece_counts, suffix_dedup, toxicity, turn_repair, url_rules
from panelloom.llm.common import table
from panelloom.session import scratch_path

# Rows that no operator learns from; a row without an id is none of them.
HELD_OUT = "coalesce(crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % {} = 2, false)"


def op1_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    return url_rules.judged(table(spark, folder, "pages"))


def op2_bitsliced_topk(spark: SparkSession, folder: str) -> DataFrame:
    return bitsliced.top_k(table(spark, folder, "embeddings"))


def op3_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    # Beyond the 400-byte strings, which go: passages of 51 words that repeat, which may be shorter.
    kept = suffix_dedup.without_repeats(table(spark, folder, "documents"), words=51)
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_passages", "passage_words")


def op4_piece_counts(spark: SparkSession, folder: str) -> DataFrame:
    counts = piece_counts.count_tokens(table(spark, folder, "documents"), ["doc_id"])
    return counts.withColumn("over_limit", F.col("n_tokens") > 4096)


def op5_embed_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, folder, "embeddings"))


def op6_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    ids = byte_bpe.encode(table(spark, folder, "documents"), ["doc_id"])
    digests = ids.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), "ids")
    decoded = byte_bpe.decode(digests, ["doc_id", "n_tokens", "ids_sha256"])
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    docs = mixing.with_size(table(spark, folder, "documents").select("doc_id", "source", "text")).drop("text")
    return mixing.copies(docs).selectExpr("doc_id", "size", "source_size", "target", "copies * size AS taken")


def op8_minmax_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = minmax.near_duplicates(table(spark, folder, "documents").select("doc_id", "text"), width=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    lexicon = toxicity.fit(docs, table(spark, folder, "labels"), f"NOT {HELD_OUT.format(4)}")
    scores = toxicity.scored(docs, lexicon)
    return scores.selectExpr("doc_id", f"{HELD_OUT.format(4)} AS held_out", "score", "CAST(score >= 0.3 AS INT) AS predicted")


def op10_maxent_lm(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    scores = maxent_lm.scored(docs, f"NOT {HELD_OUT.format(7)}")
    return scores.withColumn("held_out", F.expr(HELD_OUT.format(7))).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic_runs.found_runs(planted_runs(table(spark, folder, "documents").select("doc_id", "text")))
    longest = "array_max(transform(runs, r -> named_struct('n', r.length, 's', -r.start, 'p', -r.period)))"
    text = "array_join(transform(runs, r -> concat_ws(',', r.start, r.length, r.period) || '\n'), '')"
    return found.withColumn("_top", F.expr(longest)).selectExpr(
        "doc_id",
        "CAST(size(runs) AS BIGINT) AS n_runs",
        "-_top.s AS start",
        "_top.n AS length",
        "-_top.p AS period",
        "(1000 * _top.n) DIV (-_top.p) AS exponent_milli",
        f"sha2({text}, 256) AS runs_sha256",
        "coalesce(sha2(collapsed, 256), plain_sha256) AS collapsed_sha256",
    )


def planted_runs(docs: DataFrame) -> DataFrame:
    """Every tenth document, by a checksum of its id, repeats a block of its words from some word on to its end."""
    words = "filter(split(text, '[ \\t-\\r]+'), w -> w <> '')"
    first = "_g % nullif(size(w), 0)"
    place = f"named_struct('a', {first}, 'p', 1 + (size(w) - {first}) DIV (3 + _g % 8))"
    repeated = "array_join(transform(w, (x, i) -> CASE WHEN i < v.a THEN x ELSE get(w, CAST(v.a + (i - v.a) % v.p AS INT)) END), ' ')"
    # The words and the place are bound to names, so that they are made once a text and not once a word.
    text = f"get(transform(array({words}), w -> get(transform(array({place}), v -> CASE WHEN size(w) > 0 THEN {repeated} END), 0)), 0)"
    hashed = docs.withColumn("_h", F.expr("crc32(CAST(CAST(doc_id AS STRING) AS BINARY))")).withColumn("_g", F.expr("_h DIV 10"))
    return hashed.selectExpr("doc_id", f"CASE WHEN _h % 10 = 0 THEN coalesce({text}, text) ELSE text END AS text")


def op12_direct_codes(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "codes")
    direct_codes.write(table(spark, folder, "documents").select("doc_id", "text"), path)
    documents = direct_codes.read(spark, path)
    return documents.selectExpr("doc_id", "start", "n_tokens", "crc32(ids) AS ids_crc32")


def op13_turn_repair(spark: SparkSession, folder: str) -> DataFrame:
    return turn_repair.conversations(turn_repair.repaired(damaged_turns(table(spark, folder, "conversations"))))


def damaged_turns(turns: DataFrame) -> DataFrame:
    """A row in five is damaged, by a checksum of its place; ``times`` is 0 for those dropped, 2 for those repeated."""
    place = "concat(coalesce(CAST(conv_id AS STRING), ' '), ':', coalesce(CAST(turn AS STRING), ' '))"
    hashed = turns.withColumn("_h", F.expr(f"crc32(CAST({place} AS BINARY)) % 20"))
    return hashed.selectExpr(
        "conv_id",
        "turn",
        "CASE WHEN _h = 4 THEN 'user' ELSE role END AS role",
        "CASE _h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '') ELSE text END AS text",
        "CASE _h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END AS times",
    )


QUERIES = {f.__name__: f for f in (op1_url_rules, op2_bitsliced_topk, op3_suffix_dedup, op4_piece_counts, op5_embed_dedup, op6_byte_bpe, op7_source_mix, op8_minmax_dedup, op9_toxicity, op10_maxent_lm, op11_periodic_runs, op12_direct_codes, op13_turn_repair)}

ORACLES = {
    "op2_bitsliced_topk": """
WITH usable AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, q.v AS asked, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM usable q JOIN usable c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, asked ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10""",
    "op5_embed_dedup": """
WITH RECURSIVE usable AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b
    ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.93e0
), reached AS (
  SELECT a AS node, b AS other FROM links UNION SELECT node, b FROM reached JOIN links ON other = a
), least AS (SELECT node, min(other) AS other FROM reached GROUP BY node),
counted AS (SELECT a AS node, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(other, vec_id)) AS component_id,
  vec_id = least(vec_id, coalesce(other, vec_id)) AS kept
FROM embeddings e LEFT JOIN least l ON l.node = e.vec_id LEFT JOIN counted c ON c.node = e.vec_id""",
    "op7_source_mix": rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, 1e0 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight
  FROM sized GROUP BY source
), bounds AS (
  SELECT *, 3e0 * source_size AS cap, row_number() OVER (ORDER BY 3e0 * source_size / weight, source NULLS LAST) AS step FROM sources
), levels AS (
  SELECT *, ((SELECT sum(source_size) FROM sources)
      - coalesce(sum(cap) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY step ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM bounds
), targets AS (
  SELECT source, source_size, least(weight * coalesce((SELECT arg_min(level, step) FROM levels WHERE level <= cap / weight), cap / weight), cap) AS target
  FROM levels
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, doc_id) - 1 AS i FROM sized
), rated AS (
  SELECT r.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0e0 END AS rate
  FROM ranked r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  (size * (floor((i + 1) * rate + {mixing.OFFSET!r}e0) - floor(i * rate + {mixing.OFFSET!r}e0)))::BIGINT AS taken
FROM rated""",
    "op8_minmax_dedup": r"""
WITH RECURSIVE worded AS MATERIALIZED (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS MATERIALIZED (
  SELECT row, doc_id, CASE WHEN coalesce(len(w), 0) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(
    list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM worded
), shingles AS MATERIALIZED (SELECT row, hash(unnest(s)) AS h FROM sets),
sizes AS MATERIALIZED (SELECT row, doc_id, len(s) AS n FROM sets),
met AS MATERIALIZED (
  SELECT x.row AS a, y.row AS b, count(*) AS shared FROM shingles x JOIN shingles y ON x.h = y.h AND x.row <> y.row GROUP BY ALL
), links AS MATERIALIZED (
  SELECT a, b FROM met JOIN sizes x ON x.row = a JOIN sizes y ON y.row = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)
), reached AS (
  SELECT a AS row, b AS other FROM links UNION SELECT reached.row, b FROM reached JOIN links ON other = a
), least AS (SELECT r.row, min(doc_id) AS doc FROM reached r JOIN sizes ON sizes.row = other GROUP BY r.row)
SELECT doc_id, n::BIGINT AS n_shingles, least(doc_id, coalesce(doc, doc_id)) AS component_id,
  doc_id = least(doc_id, coalesce(doc, doc_id)) AS kept
FROM sizes LEFT JOIN least USING (row)""",
}
