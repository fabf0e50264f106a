"""One query per operator over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import (
    alignment, bpe, chat, jaccard, language, mixing, quality, recompression, sharding, suffixes, topk,
    vector_codes, warc,
)
from tidemark.llm.registry import ORACLES, QUERIES, documents, registered  # noqa: F401

WORDS_SQL = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

MIX_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, len({WORDS_SQL}) AS size,
         greatest(1.0::DOUBLE - 5.0::DOUBLE
           * (length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')))
           / greatest(length(coalesce(text, '')), 1), 0.05::DOUBLE) AS weight,
         ((CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 12) AS BIGINT)) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i
  FROM sized GROUP BY source),
weighed AS (
  SELECT source, source_size, CAST(i % 3 + 1 AS DOUBLE) AS w, 3.0::DOUBLE * source_size AS top FROM sources),
tried AS (
  SELECT a.top / a.w AS level,
         sum(b.source_size) - coalesce(sum(b.top) FILTER (b.top / b.w <= a.top / a.w), 0) AS budget,
         coalesce(sum(b.w) FILTER (b.top / b.w > a.top / a.w), 0) AS open
  FROM weighed a, weighed b GROUP BY a.top / a.w),
stopped AS (
  SELECT max(level) AS level FROM tried t
  WHERE level <= 0 OR (SELECT min(x.top / x.w) FROM weighed x WHERE x.top / x.w >= t.level)
    * (open + (SELECT sum(w) FROM weighed y WHERE y.top / y.w = t.level))
    <= budget + (SELECT sum(top) FROM weighed y WHERE y.top / y.w = t.level)),
budgets AS (
  SELECT source, source_size,
         CASE WHEN top / w <= coalesce((SELECT level FROM stopped), -1) THEN top
              ELSE ((SELECT CAST(sum(source_size) AS DOUBLE) FROM weighed)
                    - coalesce((SELECT sum(top) FROM weighed WHERE top / w <= (SELECT level FROM stopped)), 0)) * w
                   / (SELECT sum(w) FROM weighed WHERE top / w > coalesce((SELECT level FROM stopped), -1)) END AS target
  FROM weighed),
placed AS (
  SELECT s.*, b.source_size, b.target, floor(b.target / nullif(b.source_size, 0)) AS epochs,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY -ln(u) / weight, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
  FROM sized s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN size = 0 THEN 0 ELSE least(epochs + CASE WHEN target - epochs * source_size > 0
         AND 2 * (target - epochs * source_size - (upto - size)) >= size THEN 1 ELSE 0 END, 3) * size END AS BIGINT) AS taken
FROM placed"""


@registered("op1_mixing", MIX_SQL)
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents at source weights 1, 2, 3, no document more than three times."""
    mixed = mixing.mix(documents(spark, sf_dir), weights=(1, 2, 3), most=3.0)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@registered("op4_quality")
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures of every document and the verdict of the voting rules."""
    return quality.judged(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", F.round("p_good", 6).alias("p_good"),
    )


WARC_SQL = """
WITH held AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages),
firsts AS (
  SELECT payload_digest, min(page_id) AS first FROM held WHERE payload_bytes >= 100 GROUP BY 1 HAVING count(*) > 1)
SELECT page_id, payload_bytes, h.payload_digest,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM held h LEFT JOIN firsts f ON h.payload_digest = f.payload_digest"""


@registered("op8_warc", WARC_SQL)
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to a content-addressed archive and read back."""
    folder = warc.archive_of(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return warc.read_archive(spark, folder).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@registered("op2_bpe")
def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded with a public vocabulary and decoded again."""
    return bpe.digests(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


@registered("op6_language")
def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every text, learned outside the held-out fold."""
    docs = documents(spark, sf_dir)
    fold = language.held_out(F.col("doc_id"))
    model = language.train(docs, fold)
    return language.predict(docs, model).select(
        "doc_id", fold.alias("held_out"), "lang_pred", "score", "rejected"
    )


TOPK_SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, x.vec_id, CAST(list_dot_product(q.v, x.v) AS BIGINT) AS score
  FROM whole q JOIN whole x ON q.vec_id % 100 = 0 AND q.vec_id <> x.vec_id),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10"""


@registered("op9_topk", TOPK_SQL)
def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of all vectors for every hundredth vector."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return topk.top_k(table, F.col("vec_id") % 100 == 0)


def _repeats_sql(size: int) -> str:
    """Windows as lists of words; a word is removed when a repeated window covers it."""
    return rf"""
WITH split AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
places AS (
  SELECT doc_id, unnest(range(1, len(w) - {size - 2})) AS pos FROM split WHERE len(w) >= {size}),
windows AS (
  SELECT p.doc_id, p.pos, sha256(array_to_string(w[p.pos : p.pos + {size - 1}], ' ')) AS h
  FROM places p JOIN split USING (doc_id)),
placed AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY h ORDER BY doc_id, pos) AS nth FROM windows),
marks AS (
  SELECT doc_id, list(pos) AS starts FROM placed WHERE nth > 1 GROUP BY doc_id),
covered AS (
  SELECT DISTINCT doc_id, s + i AS pos
  FROM (SELECT doc_id, unnest(starts) AS s FROM marks), range({size}) r(i)),
gone AS (SELECT doc_id, list(pos) AS gone FROM covered GROUP BY doc_id),
kept AS (
  SELECT s.doc_id, s.w, g.gone,
         list_filter(s.w, lambda x, i: g.gone IS NULL OR NOT list_contains(g.gone, i)) AS kept
  FROM split s LEFT JOIN gone g USING (doc_id))
SELECT doc_id, len(w) AS n_words, len(w) - len(kept) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256
FROM kept"""


@registered("op3_recompression", _repeats_sql(20))
def op3_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of 20-word windows that start earlier as well."""
    return recompression.remove_repeats(documents(spark, sf_dir), 20)


@registered("op7_suffix_array", _repeats_sql(50))
def op7_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of 50-word passages that start earlier as well."""
    return suffixes.remove_repeats(documents(spark, sf_dir), 50)


JACCARD_SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM split WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
meet AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM meet JOIN sizes p ON x = p.doc_id JOIN sizes q ON y = q.doc_id
  WHERE 100 * c >= 75 * (p.n + q.n - c)),
reach AS (
  SELECT doc_id, doc_id AS r FROM documents
  UNION SELECT reach.doc_id, y FROM reach JOIN links ON r = x)
SELECT d.doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, min(r) AS component_id
FROM documents d LEFT JOIN sizes s ON d.doc_id = s.doc_id JOIN reach ON reach.doc_id = d.doc_id
GROUP BY d.doc_id"""


@registered("op5_jaccard_join", JACCARD_SQL)
def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents whose sets of 5-word shingles are 75 % alike."""
    return jaccard.linked_components(documents(spark, sf_dir))


CHAT_SQL = rf"""
WITH RECURSIVE said AS (SELECT * FROM conversations WHERE turn IS NOT NULL AND conv_id IS NOT NULL),
worded AS (
  SELECT conv_id, turn, coalesce(text, '') AS text, len({WORDS_SQL}) AS n
  FROM (SELECT conv_id, turn, min(text) AS text FROM said WHERE role = 'assistant' GROUP BY ALL)),
calls AS (
  SELECT conv_id, turn, 'call_' || turn AS call_id, text, n,
         CASE WHEN n % 5 = 4 THEN 'lookup' WHEN n % 2 = 1 THEN 'search' ELSE 'summarise' END AS tool,
         CASE WHEN n % 13 = 0 THEN 'call_' || (turn + 2) WHEN turn >= 2 THEN 'call_' || (turn - 2) END AS needs
  FROM worded),
answers AS (
  SELECT conv_id, 'call_' || (turn - 1) AS call_id, count(*) AS n_results, min(text) AS content
  FROM said WHERE role <> 'assistant' GROUP BY ALL),
chains AS (
  SELECT c.conv_id, c.call_id, 0 AS depth FROM calls c
  WHERE NOT EXISTS (SELECT 1 FROM calls b WHERE b.conv_id = c.conv_id AND b.call_id = c.needs)
  UNION ALL
  SELECT c.conv_id, c.call_id, depth + 1 FROM chains p JOIN calls c ON c.conv_id = p.conv_id AND c.needs = p.call_id),
judged AS (
  SELECT *, array_to_string(list_filter(CASE tool
      WHEN 'lookup' THEN ['unknown_tool']
      WHEN 'search' THEN [CASE WHEN n % 11 = 5 THEN 'missing:limit' END, CASE WHEN n % 7 = 3 THEN 'type:query' END, CASE WHEN n % 17 = 6 THEN 'unknown:note' END]
      ELSE [CASE WHEN n % 3 = 0 THEN 'type:strict' END, CASE WHEN n % 17 = 6 THEN 'unknown:note' END] END, lambda x: x IS NOT NULL), ',') AS errors,
    array_to_string(list_filter(CASE tool
      WHEN 'lookup' THEN ['"key":' || to_json(text), CASE WHEN n % 17 = 6 THEN '"note":[1,2]' END]
      WHEN 'search' THEN [CASE WHEN n % 11 <> 5 THEN '"limit":' || length(text) END, CASE WHEN n % 17 = 6 THEN '"note":[1,2]' END,
                          '"query":' || CASE WHEN n % 7 = 3 THEN CAST(n AS VARCHAR) ELSE CAST(to_json(text) AS VARCHAR) END]
      ELSE [CASE WHEN n % 17 = 6 THEN '"note":[1,2]' END, '"strict":' || CASE WHEN n % 3 = 0 THEN '"yes"' ELSE 'true' END, '"text":' || to_json(text)] END,
      lambda x: x IS NOT NULL), ',') AS arguments
  FROM calls)
SELECT c.conv_id, c.turn, c.call_id, tool, depth, coalesce(n_results, 0) AS n_results,
       CASE WHEN errors <> '' THEN 'invalid' WHEN depth IS NULL THEN 'cycle' WHEN n_results IS NULL THEN 'unanswered'
            WHEN n_results > 1 THEN 'repeated' ELSE 'linked' END AS status, errors,
       sha256('{{"after":[' || coalesce('"' || needs || '"', '') || '],"arguments":{{' || arguments
         || '}},"id":"' || c.call_id || '","name":"' || tool
         || '","result":' || coalesce(CAST(to_json(content) AS VARCHAR), 'null') || '}}') AS json_sha256
FROM judged c LEFT JOIN chains USING (conv_id, call_id)
LEFT JOIN answers a ON a.conv_id = c.conv_id AND a.call_id = c.call_id"""


@registered("op10_chat", CHAT_SQL)
def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every call of every conversation linked, ordered, validated and serialised."""
    calls, results = chat.calls_of(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    rows = chat.linked(calls, results, chat.TOOLS)
    return rows.withColumn("json_sha256", F.sha2("json", 256)).drop("json")


def _drawn_sql(name: str, weight: str) -> str:
    u = f"((CAST('0x' || substr(md5(doc_id || '/' || {name}), 1, 12) AS BIGINT)) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE"
    return f"-ln({u}) / {weight}"


# The CRC of a text takes its bytes one by one through a table of 256 remainders.
SHARD_SQL = rf"""
WITH RECURSIVE remainders AS (
  SELECT i, i AS x, 0 AS step FROM range(256) t(i)
  UNION ALL
  SELECT i, CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END, step + 1 FROM remainders WHERE step < 8),
tab AS (SELECT list(x ORDER BY i) AS t FROM remainders WHERE step = 8),
bytes AS (
  SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size,
         list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS b
  FROM documents),
sized AS (
  SELECT doc_id, size,
         xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295::BIGINT) AS text_crc32
  FROM bytes, tab),
regions AS (
  SELECT doc_id, arg_min(r, {_drawn_sql("r", "4.0")}) AS region, min({_drawn_sql("r", "4.0")}) AS best
  FROM documents, range(4) t(r) GROUP BY doc_id),
racks AS (
  SELECT doc_id, any_value(best) AS best, arg_min(region || '/' || k, {_drawn_sql("region || '/' || k", "2.0")}) AS rack,
         arg_min(region * 2 + k, {_drawn_sql("region || '/' || k", "2.0")}) AS place
  FROM regions, range(2) t(k) GROUP BY doc_id),
leaves AS (
  SELECT doc_id, any_value(best) AS best,
         CAST(arg_min(place * 2 + s, {_drawn_sql("rack || '/' || (place * 2 + s)", "1.0")}) AS INTEGER) AS shard
  FROM racks, range(2) t(s) GROUP BY doc_id)
SELECT l.doc_id, size, text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY l.doc_id) - 1 AS slot,
       CASE WHEN {_drawn_sql("'4'", "1.0").replace("doc_id", "l.doc_id")} < best THEN 16 ELSE shard END AS grown_shard
FROM leaves l JOIN sized s ON l.doc_id = s.doc_id"""


@registered("op11_sharding", SHARD_SQL)
def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of a tree of four regions, and where one shard more would put them."""
    return sharding.assign(documents(spark, sf_dir), sharding.balanced(4, 2, 2))


def _codes_sql(rounds: int) -> str:
    def assigned(books: str) -> str:
        return f"""
  SELECT vec_id, label, p, any_value(x) AS x, arg_min(k, far * 256 + k) AS k, min(far) AS far
  FROM (SELECT vec_id, label, parts.p, x, k, list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c) AS far
        FROM parts JOIN {books} ON parts.p = {books}.p) GROUP BY vec_id, label, p"""

    steps = ""
    for r in range(rounds):
        steps += f""",
a{r} AS MATERIALIZED ({assigned(f"c{r}")}),
m{r} AS (
  SELECT p, k, list(mean ORDER BY j) AS c
  FROM (SELECT p, k, j, floor(sum(x[j]) / count(*)) AS mean FROM a{r}, LATERAL (SELECT unnest(range(1, len(x) + 1)) AS j) GROUP BY p, k, j)
  GROUP BY p, k),
c{r + 1} AS MATERIALIZED (SELECT c{r}.p, c{r}.k, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} ON c{r}.p = m{r}.p AND c{r}.k = m{r}.k)"""
    return f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
  SELECT vec_id, label, p, v[p * (len(v) // 4) + 1 : (p + 1) * (len(v) // 4)] AS x FROM kept, range(4) t(p)),
c0 AS MATERIALIZED (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS k, x AS c
  FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 256)){steps},
coded AS ({assigned(f"c{rounds}")}),
whole AS (
  SELECT vec_id, label, string_agg(lower(printf('%02x', k)), '' ORDER BY p) AS code, CAST(sum(far) AS BIGINT) AS error
  FROM coded GROUP BY vec_id, label),
digest AS (
  SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY p, k)) AS codebooks_sha256
  FROM c{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM whole, digest"""


@registered("op12_vector_codes", _codes_sql(4))
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector as four bytes, with codebooks of 256 entries after four rounds over all vectors."""
    return vector_codes.compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@registered("op13_alignment")
def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token links of a byte-level and a sentencepiece tokenizer over every whole text."""
    return alignment.aligned(
        documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    )
