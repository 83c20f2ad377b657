"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, forest, langmix, license_scan, mix, rans, secret_scan, sharding, simhash, spelling, token_scan, whitening
from .common import documents

PLANS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(plan):
        PLANS[name] = plan
        if sql is not None:
            SQL[name] = sql
        return plan
    return add


@query("op1_embedding_near_dedup")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    out = forest.near_duplicates(spark.read.parquet(f"{folder}/embeddings.parquet"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


@query("op2_decontamination")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.find_leaks(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


def tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


@query("op3_token_counts")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return token_scan.count_tokens(documents(spark, folder), tokenizer(), 49_407)


@query("op4_sharding")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text", F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    out = sharding.shard(docs, 8, carry=["doc_id", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op5_simhash_near_dedup")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    out = simhash.simhash(documents(spark, folder).select("doc_id", "text"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


OP6_SQL = """
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS n FROM s),
w AS (SELECT *, CASE n % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w, source_size * 2.0::DOUBLE AS cap FROM r),
l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE
        - coalesce(sum(cap) OVER (ORDER BY cap / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
        / sum(w) OVER (ORDER BY cap / w, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(cap, max(level) OVER () * w) AS target FROM l),
g AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM t),
k AS (SELECT range AS k FROM range(16)),
u AS (SELECT d.doc_id, d.source, d.size, g.source_size, g.target, g.rate, k.k,
        ('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, 'null') || ':' || (k.k // 4)::VARCHAR), 1 + 8 * (k.k % 4)::INT, 8))::BIGINT / 4294967296.0::DOUBLE AS u
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source CROSS JOIN k),
c AS (SELECT *, size * (floor(rate)::BIGINT + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS taken FROM u),
o AS (SELECT source, k, abs(sum(taken) - any_value(target)) AS off FROM c GROUP BY source, k),
p AS (SELECT source, min(k) AS pick FROM (SELECT *, min(off) OVER (PARTITION BY source) AS least FROM o) WHERE off = least GROUP BY source)
SELECT c.doc_id, c.size, c.source_size, c.target, c.taken::BIGINT AS taken
FROM c JOIN p ON c.source IS NOT DISTINCT FROM p.source AND c.k = p.pick
"""


@query("op6_mixing_sources", OP6_SQL)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    sized = mix.measured(documents(spark, folder))
    out = mix.planned(sized, sized)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query("op8_token_binary")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return rans.round_trip(documents(spark, folder), tokenizer(), 2)


@query("op7_language_id")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    out = langmix.predictions(documents(spark, folder).select("doc_id", "text", "lang"))
    return out.select("doc_id", "held_out", "lang_pred", "score")


@query("op9_license_scan")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    out = license_scan.scan(documents(spark, folder))
    base, more = F.transform("places", lambda p: p["label"]), F.transform("spans", lambda s: s["label"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    start = F.transform("places", lambda p: p["start"])
    score = F.greatest(F.when(F.size("places") > 0, 1.0).otherwise(0.0), F.coalesce(F.array_max(F.transform("spans", lambda s: s["coverage"])), F.lit(0.0)))
    return out.select("doc_id", "n_words", F.size("places").cast("bigint").alias("n_base"), F.array_min(start).alias("first_word"), F.array_max(start).alias("last_word"),
                      joined(base).alias("base_labels"), joined(F.concat(base, more)).alias("labels"), score.alias("score"))


@query("op10_secret_scan")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    out = secret_scan.scan(documents(spark, folder))
    kinds = [name for name, *_ in secret_scan.RULES[:secret_scan.BASE]]
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(kinds))
    return out.select("doc_id", *[count(k) for k in kinds], F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


OP11_SQL = """
WITH RECURSIVE t AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END) ORDER BY i) AS t
  FROM (SELECT range AS i FROM range(256))),
r AS (SELECT coalesce(doc_id::VARCHAR, 'null') AS doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents),
d AS (SELECT doc_id, run, count(*) AS n, hex(encode(doc_id || ':' || run)) AS x FROM r WHERE length(run) >= 7 GROUP BY doc_id, run),
c AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i::INT + 1, 2))::BIGINT)),
    lambda a, b: xor(a >> 8, t.t[(xor(a, b) & 255) + 1]))) AS h FROM d, t),
w AS (SELECT word, sum(n)::BIGINT AS n FROM (SELECT n, CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM c)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
g AS (SELECT word, n, i, substr(word, 1, i::INT) || substr(word, i::INT + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)),
p AS (SELECT a.word, b.word AS near, b.n AS near_n FROM g a JOIN g b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT g.word, w.word, w.n FROM g JOIN w ON g.rest = w.word
  UNION SELECT w.word, g.word, g.n FROM g JOIN w ON g.rest = w.word),
f AS (SELECT word, count(*) AS n_near, max(near_n) AS m FROM p GROUP BY word),
o AS (SELECT w.word, w.n, coalesce(f.n_near, 0)::BIGINT AS n_near, CASE WHEN f.m >= 10 * w.n THEN (SELECT min(p.near) FROM p WHERE p.word = w.word AND p.near_n = f.m) END AS form,
  CASE WHEN f.m >= 10 * w.n THEN f.m END AS form_n FROM w LEFT JOIN f USING (word)),
u AS (SELECT word, word AS at FROM o UNION ALL SELECT u.word, o.form FROM u JOIN o ON u.at = o.word WHERE o.form IS NOT NULL)
SELECT o.word, o.form, u.at AS root, o.n, o.n_near, o.form_n::BIGINT AS form_n FROM o JOIN u ON o.word = u.word JOIN o l ON u.at = l.word WHERE l.form IS NULL
"""


@query("op11_spelling_variants", OP11_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.spelling_variants(documents(spark, folder))


@query("op12_bpe")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    ids = bpe.encode(documents(spark, folder).select("doc_id", "text"), tokenizer(), decoded="decoded")
    return ids.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query("op13_embedding_whitening")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    out = whitening.whiten(spark.read.parquet(f"{folder}/embeddings.parquet"))
    return out.withColumn("deviation", F.col("deviation").cast("bigint"))
