"""Registered queries of the numbered operators and their DuckDB SQL.

Each applies its operator to the whole table with production parameters; the
columns are those that the operator's contract names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, exact_dedup, licenses, lm, merkle, packing, pii, quality, repair, secrets, sharding, simhash
from .common import ascii_lower

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

SEQUENCE, SHARDS = 2048, 40
SHINGLE_WORDS, MAX_BITS = 3, 3


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def register(key: str, sql: str | None = None):
    def add(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn
    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@register("op1_packing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_path(), SEQUENCE, with_ids=False)


@register("op2_simhash")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir), SHINGLE_WORDS, MAX_BITS)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@register("op3_license_scan")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


@register("op4_sharding")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(documents(spark, sf_dir), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


@register("op5_exact_dedup", """
  WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
             FROM documents)
  SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
         row_number() OVER (PARTITION BY norm ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(norm) AS text_sha256
  FROM t""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir))


@register("op6_quality")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.judge(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


@register("op7_lm_score")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(documents(spark, sf_dir))


@register("op8_pii")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(documents(spark, sf_dir)).withColumn("base_sha256", F.sha2("base_spans", 256)).drop("base_spans")


@register("op9_chat_format")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one of control strings."""
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, chat.ASSISTANT, said)], given.schema)
    return chat.read_back(chat.format_turns(given.unionByName(more)))


@register("op10_bpe")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), tokenizer_path())


@register("op11_secrets")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (secrets.report(documents(spark, sf_dir))
            .withColumn("base_sha256", F.sha2("base_spans", 256)).drop("base_spans"))


#: A leaf's columns, in order.
LEAF = ["doc_id", "source", "lang", "n_chars", "text"]


#: CRC-32 of a decimal number in SQL: eight shifts for each of its bytes.
CRC_STEP = "xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END)"
CRC_SQL = f"""xor(list_reduce(
    list_transform(string_split({{0}}, ''), lambda s: ascii(s)::BIGINT),
    lambda a, b: list_reduce(range(8)::BIGINT[], lambda c, i: {CRC_STEP}, xor(a, b)), 4294967295::BIGINT), 4294967295)"""


def _merkle_sql(levels: int = 4, group_levels: int = 3) -> str:
    """Level by level, runs as lists: enough for 16 ** 4 rows a source and 16 ** 3 sources."""
    def value(x: str) -> str:
        return f"coalesce(strlen({x}) || ':' || {x}, '-')"

    def tree(name: str, n: int) -> str:
        return "".join(f"""
  {name}r{i} AS (SELECT g, k // 16 AS r, list(h ORDER BY k) AS l, any_value(c) AS c FROM {name}{i} GROUP BY ALL),
  {name}{i + 1} AS (SELECT g, r AS k, CASE WHEN c > 1 THEN sha256(array_to_string(l, '')) ELSE l[1] END AS h,
                   count(*) OVER (PARTITION BY g) AS c FROM {name}r{i}),""" for i in range(n))

    def climb(name: str, before: str, n: int) -> str:
        """One step a level: the siblings join the proof, the tampered node is folded; a lone node stays."""
        return "".join(f"""
  {name}w{i + 1} AS (SELECT w.* EXCLUDE (c, a, z) REPLACE (w.k // 16 AS k,
                      CASE WHEN c > 1 THEN proof || array_to_string(a, '') || array_to_string(z, '') ELSE proof END AS proof,
                      CASE WHEN c > 1 THEN sha256(array_to_string(a, '') || f || array_to_string(z, '')) ELSE f END AS f)
               FROM (SELECT w.*, r.c, r.l[1:w.k % 16] AS a, r.l[w.k % 16 + 2:] AS z
                     FROM {before if not i else f"{name}w{i}"} w JOIN {name}r{i} r ON w.k // 16 = r.r AND w.g IS NOT DISTINCT FROM r.g) w),""" for i in range(n))

    fields = [value(f"{c}::VARCHAR") for c in LEAF[:-1]]
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
  WITH hashed AS (SELECT doc_id, source AS g, sha256({" || ".join([*fields, value("text")])}) AS h,
      CASE WHEN {CRC_SQL.format("doc_id::VARCHAR")} % 5 = 0 THEN sha256({" || ".join([*fields, value(lower)])}) END AS t FROM documents),
  placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS k FROM hashed),
  s0 AS (SELECT g, k, h, count(*) OVER (PARTITION BY g) AS c FROM placed),{tree("s", levels)}
  tops AS (SELECT g AS source, h, row_number() OVER (ORDER BY encode(g) NULLS FIRST) - 1 AS k FROM s{levels}),
  t0 AS (SELECT 0 AS g, k, h, count(*) OVER () AS c FROM tops),{tree("t", group_levels)}
  start AS (SELECT doc_id, g, h AS leaf, k, '' AS proof, coalesce(t, h) AS f FROM placed),{climb("s", "start", levels)}
  mid AS (SELECT w.* REPLACE (0 AS g, tops.k AS k), tops.h AS subroot
          FROM sw{levels} w JOIN tops ON w.g IS NOT DISTINCT FROM tops.source),{climb("t", "mid", group_levels)}
  root AS (SELECT h AS root FROM t{group_levels})
  SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, f AS folded_root, f = root AS verified
  FROM tw{group_levels}, root"""


@register("op12_merkle", _merkle_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where 5 divides the id's CRC-32 the text is lower-cased behind the manifest's back (a null id never is)."""
    docs = documents(spark, sf_dir)
    changed = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    values = [F.col(c).cast("string") for c in LEAF[:-1]] + [ascii_lower(F.col("text"))]
    told = merkle.manifest(docs, LEAF, more={"now": F.when(changed, merkle.digest_of(values))})
    return (told.withColumn("proof_sha256", merkle.proof_digest(F.col("witness")))
            .withColumn("folded_root", merkle.fold(F.coalesce("now", "leaf"), F.col("witness")))
            .withColumn("verified", F.col("folded_root") == F.col("root")).drop("now", "witness"))


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with faults by their id and turn; a null is one space."""
    def said(c: str):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(said("text"), ".!?", "")).otherwise(said("text"))
    times = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return conversations.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(said("role")).alias("role"),
                                text.alias("text"), F.explode(F.array_repeat(F.lit(0), times)).alias("copy")).drop("copy")


@register("op13_repair")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    found = repair.report(damaged(given)).withColumnRenamed("conv_id", "__found")
    every = given.select("conv_id").distinct()
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return (every.join(found, F.col("conv_id").eqNullSafe(F.col("__found")), "left")
            .select("conv_id", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts),
                    F.coalesce("audit", F.lit("")).alias("audit"),
                    F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256")))
