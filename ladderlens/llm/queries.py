"""The queries of this package; the digest columns come from the operators' outputs."""

from __future__ import annotations

import hashlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ladderlens.llm import bpe, decontaminate, langid, licenses, merkle, quality_model, quality_rules, repeats, secrets, sharding, simhash, toxicity, whitening
from ladderlens.llm.common import id_bucket
from ladderlens.llm.oracles import oracle_sql  # noqa: F401


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of a document with licence language, and its family."""
    return licenses.scan(documents(spark, sf_dir))


def op9_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from labels where crc32(doc_id) mod 5 is not 0."""
    docs = documents(spark, sf_dir)
    held = F.coalesce(id_bucket(F.col("doc_id"), 5) == 0, F.lit(False))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = quality_model.fit(docs.where(~held), labels)
    out = quality_model.score(docs, model, ["doc_id"])
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned where crc32(doc_id) mod 4 is not 2."""
    docs = documents(spark, sf_dir)
    held = F.coalesce(id_bucket(F.col("doc_id"), 4) == 2, F.lit(False))
    model = langid.fit(docs.where(~held))
    out = langid.predict(docs, model, ["doc_id"])
    return out.select("doc_id", held.alias("held_out"), "lang_pred", F.round("score", 6).alias("score"))


def op2_vector_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes."""
    return sharding.shard(documents(spark, sf_dir), 40)


BPE_FIELDS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def bpe_digest(codec: bpe.Codec, ids: str) -> dict:
    """Count of the ids, hash of the ids, and hash of what they decode to."""
    return {
        "n_tokens": ids.count(" ") + 1 if ids else 0,
        "ids_sha256": hashlib.sha256(ids.encode()).hexdigest(),
        "decoded_sha256": hashlib.sha256(codec.decode(ids)).hexdigest(),
    }


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded by byte-level BPE and decoded again."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode(documents(spark, sf_dir), path, public_tokenizers.PATTERN, ["doc_id"], bpe_digest, BPE_FIELDS)


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document, and the smallest doc_id of those it is linked with."""
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


REPEATS_FIELDS = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def repeats_digest(data: bytes, spans: list[tuple[int, int]]) -> dict:
    """Sizes of what is removed from a text, and the hash of what is kept."""
    kept = repeats.kept_text(data, spans)["kept"]
    return {"n_bytes": len(data), "n_removed": len(data) - len(kept), "n_spans": len(spans), "kept_sha256": hashlib.sha256(kept).hexdigest()}


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that a string of 100 bytes covers which starts earlier."""
    return repeats.deduplicate(documents(spark, sf_dir), 100, repeats_digest, REPEATS_FIELDS)


def op6_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item found in a document, within its error budget."""
    return decontaminate.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of every document, and whether the rules keep it."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules.quality(documents(spark, sf_dir), labels).select("doc_id", *quality_rules.MEASURES, "base_failed", "kept", "failed_rules")


def span_text(spans, sep: str = ","):
    """kind:start:end of each span, joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), sep)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: spans of the fixed patterns and of the inferred automata."""
    found = secrets.scan(documents(spark, sf_dir), ["doc_id"])
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != "format")
    return found.select(
        "doc_id",
        of("assign").alias("n_assign"),
        of("access").alias("n_access"),
        of("hex").alias("n_hex"),
        F.sha2(span_text(base), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
        of("format").alias("n_format"),
    )


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from labels where crc32(doc_id) mod 5 is not 0."""
    docs = documents(spark, sf_dir)
    held = F.coalesce(id_bucket(F.col("doc_id"), 5) == 0, F.lit(False))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    out = toxicity.score(docs, toxicity.fit(docs.where(~held), labels), ["doc_id"])
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, proof and roots of every document; where crc32(doc_id) mod 5 is 0, a leaf of the text in lower case is checked."""
    lower = F.translate("text", merkle.UPPER, merkle.UPPER.lower())
    claim = merkle.leaf([lower if c == "text" else F.col(c) for c in merkle.FIELDS])
    return merkle.verify(documents(spark, sf_dir), F.when(id_bucket(F.col("doc_id"), 5) == 0, claim))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every finite vector on the first four whitened components."""
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), ["vec_id"])


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_vector_shards": op2_vector_shards,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_simhash_dedup": op4_simhash_dedup,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_benchmark_leaks": op6_benchmark_leaks,
    "op7_quality_rules": op7_quality_rules,
    "op8_secret_scan": op8_secret_scan,
    "op9_quality_model": op9_quality_model,
    "op10_language_id": op10_language_id,
    "op11_toxicity": op11_toxicity,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_whitening": op13_whitening,
}
