"""One query per operator, over the whole of its table, with the parameters of production."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm import (
    decontaminate, language, lines, lm, neardup, packing, periodic, quality, sharding, substrings, tokens, toxicity, trie,
)
from tabloom.storage import scratch_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.held_out_scores(table(spark, sf_dir, "documents"))


def op2_ngram_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_difference_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


def op4_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"), shards=24, seed=20240607)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "row_number", "position")


def op5_digest_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = f"{scratch_dir(spark)}-token-cache"
    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), cache, limit=512)


def op6_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_noisy_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_cutting_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2, capacity=4096)


def op10_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(table(spark, sf_dir, "documents"))


def op11_sorted_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.without_repeated_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def periodic_documents(docs: DataFrame) -> DataFrame:
    """doc_id and text; in each document whose crc32 ends in 0, the words from some place on repeat."""
    text, code = F.coalesce(F.col("text"), F.lit("")), F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, g = F.size("words").cast("long"), F.floor(code / 10)
    marked = docs.select("doc_id", text.alias("text"), F.when(code % 10 == 0, words).alias("words"), g.cast("long").alias("g"))
    placed = marked.withColumn("a", F.when(n > 0, F.col("g") % n)).withColumn("p", F.expr("1 + (size(words) - a) div (3 + g % 8)"))
    i = F.sequence(F.lit(0).cast("long"), n - 1)
    repeated = F.transform(i, lambda k: F.get(F.col("words"), F.when(k < F.col("a"), k).otherwise(F.col("a") + (k - F.col("a")) % F.col("p")).cast("int")))
    return placed.select("doc_id", F.when(n > 0, F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))


def op12_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(periodic_documents(table(spark, sf_dir, "documents")))
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    # Runs are in order, so only a greater exponent replaces the one at hand.
    best = F.aggregate("runs", none, lambda best, run: F.when(
        best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"]), run).otherwise(best))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(
        r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    ).select(
        "doc_id", "n_runs", F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def rebuilt_conversations(turns: DataFrame) -> DataFrame:
    """Coded conversations that share first turns: c begins like conversation c - c % 100."""
    coded = trie.coded(turns)
    own = coded.select("conv_id", "turns", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).cast("int").alias("h"))
    first = coded.where(F.col("conv_id") % 100 == 0).select(F.col("conv_id").alias("_base"), trie.head("turns", F.lit(5)).alias("_turns"))
    joined = own.join(first, F.col("conv_id") - F.col("conv_id") % 100 == F.col("_base"), "left")
    empty = F.lit("").cast("binary")
    return joined.select("conv_id", F.concat(
        F.coalesce(trie.head("_turns", F.col("h")), empty), F.coalesce(trie.tail("turns", F.col("h")), empty)).alias("turns"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(rebuilt_conversations(table(spark, sf_dir, "conversations")))


QUERIES = {f.__name__: f for f in (
    op1_pitman_yor, op2_ngram_quality, op3_difference_cover, op4_feistel_shards, op5_digest_cache, op6_winnowing,
    op7_golay_simhash, op8_noisy_or, op9_cutting_stock, op10_string_kernel, op11_sorted_runs, op12_recompression,
    op13_prefix_trie,
)}

OP6_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
bi AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS t FROM bi),
di AS (
  SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i
  FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n),
dw AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS t FROM di),
h AS (SELECT r, i, dw.n, item_id FROM dw JOIN bw USING (n, t)),
p AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM h) GROUP BY r),
c AS (
  SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
       n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN p USING (r) LEFT JOIN c USING (r)
""".replace("\\\\", "\\")

OP3_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS o,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (SELECT r, o, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20),
t AS (SELECT r, o, i, array_to_string(w[i:i + 19], ' ') AS x FROM s),
f AS (SELECT x, min(struct_pack(o := o, i := i)) AS f FROM t GROUP BY x),
p AS (SELECT DISTINCT r, unnest(range(i, i + 20)) AS k FROM t JOIN f USING (x) WHERE o <> f.o OR i <> f.i),
v AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM d),
g AS (
  SELECT v.r, CAST(count(*) FILTER (p.k IS NOT NULL) AS BIGINT) AS n_removed,
         string_agg(word, ' ' ORDER BY v.k) FILTER (p.k IS NULL) AS kept
  FROM v LEFT JOIN p ON v.r = p.r AND v.k = p.k GROUP BY v.r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN g USING (r)
"""

OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (
  SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i,
         translate(trim(unnest(lines), chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM d),
o AS (SELECT k, min(coalesce(doc_id, 9223372036854775807)) AS owner FROM l WHERE length(k) >= 10 GROUP BY k),
m AS (SELECT r, i, line, coalesce(owner <> coalesce(doc_id, 9223372036854775807), false) AS gone FROM l LEFT JOIN o USING (k)),
g AS (
  SELECT r, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
         sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
  FROM m GROUP BY r)
SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM d JOIN g USING (r)
"""

OP13_SQL = """
WITH t AS (
  SELECT conv_id AS c, turn, sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS code,
         length(coalesce(text, '')) AS w
  FROM conversations WHERE conv_id IS NOT NULL),
u AS (SELECT c, code, w, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, code) - 1 AS k FROM t),
x AS (SELECT DISTINCT c FROM t),
h AS (
  SELECT c, xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(c AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
    lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)), lambda y, i: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295) % 6 AS h
  FROM x),
b AS (
  SELECT h.c, 0 AS part, u.k, code, w FROM h JOIN u ON u.c = h.c - h.c % 100 AND u.k < h
  UNION ALL SELECT h.c, 1, u.k, code, w FROM h JOIN u ON u.c = h.c AND u.k >= h),
s AS (
  SELECT c, w, row_number() OVER (PARTITION BY c ORDER BY part, k) AS d,
         string_agg(code, '') OVER (PARTITION BY c ORDER BY part, k) AS path
  FROM b
  UNION ALL SELECT c, 0, 0, '' FROM x),
n AS (SELECT path, d, any_value(w) AS w, count(*) AS n, min(c) AS c FROM s GROUP BY path, d),
kids AS (SELECT left(path, 64 * (d - 1)) AS path, count(*) AS kids FROM n WHERE d > 0 GROUP BY 1),
e AS (SELECT c, arg_max(path, d) AS path FROM s GROUP BY c),
f AS (SELECT path, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ends FROM e GROUP BY path),
a AS (SELECT n.path, n.d, n.w, n.n, n.c, coalesce(kids, 0) AS kids, coalesce(ends, '') AS ends FROM n LEFT JOIN kids USING (path) LEFT JOIN f USING (path)),
v AS (SELECT left(path, 64 * unnest(range(0, d + 1))) AS path, CAST(kids = 0 AS BIGINT) AS leaf, (n - 1) * w AS saved FROM a),
z AS (SELECT path, CAST(sum(leaf) AS BIGINT) AS leaves, CAST(sum(saved) AS BIGINT) AS saved FROM v GROUP BY path)
SELECT a.c AS conv_id, a.d AS depth, p.c AS parent_conv_id, a.n AS n_convs, a.kids AS n_children, z.leaves AS n_leaves,
       z.saved AS saved_tokens, sha256(a.ends) AS ends_sha256
FROM a JOIN z USING (path) LEFT JOIN a AS p ON a.d > 0 AND p.path = left(a.path, 64 * (a.d - 1))
"""

ORACLES: dict[str, str] = {
    "op3_difference_cover": OP3_SQL, "op6_winnowing": OP6_SQL, "op11_sorted_runs": OP11_SQL, "op13_prefix_trie": OP13_SQL,
}
