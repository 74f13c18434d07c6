"""The registered queries of the training-data operators, and their SQL.

Each query reads whole tables, applies one operator with production parameters and derives the
contract's columns from its result.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrid.llm import conversation_repair, decontaminate, exact_dedup, html_extract, language, mixing, secrets, sharding, simhash, substring, token_align, tokens, top_k
from tallygrid.llm._common import table


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = pages.select("page_id", "url", html_extract.extract(F.col("html")).alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=4, radius=4)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), columns=["doc_id"])
    return found.select(
        "row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def held_out(doc_id: Column) -> Column:
    """Documents that the language model never learns from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs.where(~held_out(F.col("doc_id"))))
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select(
        "row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), F.col("found.lang").alias("lang_pred"),
        "found.score", "found.ambiguous",
    )


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    size = mixing.space_words(F.col("text"))
    sized = docs.select("doc_id", "source", size.alias("size"))
    mixed = mixing.systematic_copies(sized, size=F.col("size"))
    return mixed.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op6_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.crc32(F.coalesce("text", F.lit(""))).alias("crc"))
    placed = sharding.shard(docs, columns=["doc_id", "crc"])
    return placed.select(
        "row.doc_id", "size", F.col("row.crc").alias("text_crc32"), F.lit("bytes").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), keep="max")
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op8_token_count(spark: SparkSession, sf_dir: str, path: str | None = None, limit: int = 1024) -> DataFrame:
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
                          tokens.token_count(F.col("text"), path).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("found", lambda s: s["kind"] != secrets.RANDOM)

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def number(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        F.col("id").alias("doc_id"), number("assign").alias("n_assign"), number("access").alias("n_access"), number("hex").alias("n_hex"),
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"),
    )


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.removal(table(spark, sf_dir, "documents").select("doc_id", "text"), window=20)
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def op11_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k.top_k(vectors.where("vec_id % 50 = 0"), vectors, k=5)


def op12_token_align(spark: SparkSession, sf_dir: str, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    paths = a_path or public_tokenizers.path("byte_bpe_50k.json"), b_path or public_tokenizers.path("piece_bpe_32k.model")
    found = token_align.align(table(spark, sf_dir, "documents").select("doc_id", "text"), *paths, columns=["doc_id"])
    return found.select("row.doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = conversation_repair.damage(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    found = conversation_repair.repair(damaged, copies=F.col("copies"))
    return found.select(F.col("conv").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_extract": op1_html_extract,
        "op2_simhash": op2_simhash,
        "op3_decontaminate": op3_decontaminate,
        "op4_language_id": op4_language_id,
        "op5_mix_sources": op5_mix_sources,
        "op6_shard": op6_shard,
        "op7_exact_dedup": op7_exact_dedup,
        "op8_token_count": op8_token_count,
        "op9_secrets": op9_secrets,
        "op10_substring_dedup": op10_substring_dedup,
        "op11_top_k": op11_top_k,
        "op12_token_align": op12_token_align,
        "op13_conversation_repair": op13_conversation_repair,
    }


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3_SQL = rf"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, array_to_string(w[s:s + 9], ' ') AS win, len(w[s:s + 9]) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0)
), lens AS (
  SELECT DISTINCT n FROM bw
), dw AS (
  SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lens WHERE len(w) >= n)
), hits AS (
  SELECT doc_id, s, dw.n, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n
), cover AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM hits GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM documents
), s AS (
  SELECT source, sum(size) AS source_size FROM d GROUP BY source
), l AS (
  SELECT source, source_size, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w,
         3.0::DOUBLE * source_size AS lim
  FROM s
), c AS (
  SELECT *, lim * sum(w) OVER (ORDER BY lim / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
         < (sum(source_size) OVER () - coalesce(sum(lim) OVER (ORDER BY lim / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * w AS capped
  FROM l
), t AS (
  SELECT source, source_size, CASE WHEN capped THEN lim ELSE w * ((sum(source_size) OVER ()::DOUBLE - sum(CASE WHEN capped THEN lim ELSE 0 END) OVER ())
         / nullif(sum(CASE WHEN capped THEN 0 ELSE w END) OVER (), 0)) END AS target
  FROM c
), p AS (
  SELECT d.*, row_number() OVER (PARTITION BY source ORDER BY size, k) AS place FROM d
), r AS (
  SELECT p.*, source_size::DOUBLE AS total, t.target, coalesce(t.target / nullif(source_size::DOUBLE, 0), 0) AS rate,
         ('0x' || substr(md5(coalesce('=' || p.source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(total AS BIGINT) AS source_size, target,
       CAST(size * (floor(rate * place + u) - floor(rate * (place - 1) + u)) AS BIGINT) AS taken
FROM r
"""

OP7_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id, count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""

OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), wins AS (
  SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d)
), late AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY win ORDER BY doc_id, s) AS i FROM wins) WHERE i > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM late
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS words, count(*) AS n
  FROM (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d) ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(words, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP11_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(coalesce(list_sum(list_transform(range(1, least(len(q.e), len(c.e)) + 1), lambda i: q.e[i] * c.e[i])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id IS DISTINCT FROM q.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""

#: CRC-32 bit by bit into a table, the damage, and a search forward through the rows for the cheapest and least letters.
OP13_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list(c ORDER BY i) AS t
  FROM (SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))
), raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_prepend(4294967295::BIGINT,
             list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: ascii(x)::BIGINT)),
             lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) % 20 AS k
  FROM conversations, crc
), kept AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN k = 1 THEN '' WHEN k = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN k = 0 THEN 0 WHEN k = 3 THEN 2 ELSE 1 END)) AS copy
  FROM raw
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS p FROM kept
), judged AS (
  SELECT *, substr(role, 1, 1) AS r, substr(lag(role) OVER (PARTITION BY conv_id ORDER BY p), 1, 1) AS r0,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY p) > 1 THEN 'duplicate'
              WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault
  FROM placed
), best(conv_id, p, last, cost, letters, lines) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, '', 0::BIGINT, '', []::VARCHAR[] FROM kept
  UNION ALL
  SELECT conv_id, p, last, w.cost, w.letters, w.lines
  FROM (
    SELECT conv_id, p, CASE WHEN e = 'D' THEN last WHEN e = 'K' THEN r WHEN last = 'u' THEN 'a' ELSE 'u' END AS last,
           min({'cost': cost + CASE WHEN e = 'D' THEN 2 ELSE CASE WHEN e = 'R' THEN 1 ELSE 0 END + CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END END,
                'letters': letters || e,
                'lines': CASE WHEN e = 'D' THEN lines ELSE list_append(lines, CASE WHEN e = 'K' THEN role WHEN last = 'u' THEN 'assistant' ELSE 'user' END || ':' || text) END}) AS w
    FROM (
      SELECT b.conv_id, j.p, j.r, j.role, j.text, j.fault, unnest(['D', 'K', 'R']) AS e,
             CASE WHEN i = 0 THEN last WHEN last = 'u' THEN 'a' ELSE 'u' END AS last, cost + 5 * i AS cost, letters || repeat('I', i) AS letters,
             CASE WHEN i = 0 THEN lines ELSE list_append(lines, CASE WHEN last = 'u' THEN 'assistant:' ELSE 'user:' END) END AS lines
      FROM (SELECT *, unnest([0, 1]::BIGINT[]) AS i FROM best) b JOIN judged j ON b.conv_id IS NOT DISTINCT FROM j.conv_id AND j.p = b.p + 1
    )
    WHERE e = 'D' OR fault IN ('', 'truncated') AND (e = 'R' OR r = CASE WHEN last = 'u' THEN 'a' ELSE 'u' END OR r = 's' AND last = '')
    GROUP BY 1, 2, 3
  )
), counted AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (r0 IS NOT NULL AND r0 || r NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id
), ended AS (
  SELECT c.*, w FROM counted c JOIN (
    SELECT b.conv_id, p, min({'cost': cost + CASE last WHEN 'u' THEN 5 WHEN 's' THEN 10 ELSE 0 END, 'letters': letters || CASE last WHEN 'u' THEN 'I' WHEN 's' THEN 'II' ELSE '' END,
           'lines': list_concat(lines, CASE last WHEN 'u' THEN ['assistant:'] WHEN 's' THEN ['user:', 'assistant:'] ELSE [] END)}) AS w
    FROM best b GROUP BY 1, 2
  ) f ON c.conv_id IS NOT DISTINCT FROM f.conv_id AND c.n = f.p
)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
       CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(w.cost, 0) AS BIGINT) AS cost,
       coalesce(w.letters, '') AS audit, sha256(coalesce(array_to_string(w.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN ended e ON o.conv_id IS NOT DISTINCT FROM e.conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op10_substring_dedup": OP10_SQL, "op11_top_k": OP11_SQL, "op13_conversation_repair": OP13_SQL, "op3_decontaminate": OP3_SQL, "op5_mix_sources": OP5_SQL, "op7_exact_dedup": OP7_SQL}
