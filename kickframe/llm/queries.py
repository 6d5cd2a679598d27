"""The numbered queries over the driver's tables, each a thin digest of its operator's output."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kickframe.llm import decontaminate, minhash_dedup, packing, passage_dedup, quality_rules, secret_scan, spelling, substring_exact, token_counts, token_files, url_filters, vector_codes, warc
from kickframe.llm._common import read_table, shared_path
from kickframe.llm.oracles import ORACLE_SQL  # noqa: F401


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(read_table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    text = secret_scan.digest(F.col("spans"))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(text, 256).alias("base_sha256"), text.alias("spans"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(read_table(spark, sf_dir, "documents"), shingle=4, percent=80)


def op4_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passage_dedup.near_passages(read_table(spark, sf_dir, "documents"))
    covered = F.aggregate("passages", F.lit(0).cast("bigint"), lambda acc, p: acc + p["end"] - p["start"])
    text = F.array_join(F.transform("passages", lambda p: F.concat_ws(":", p["start"].cast("string"), p["end"].cast("string"))), ",")
    return found.select("doc_id", "n_words", F.size("passages").cast("bigint").alias("n_passages"), covered.alias("n_near_words"), text.alias("passages"), "component_id")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 4096)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    warc.write(read_table(spark, sf_dir, "pages"), path)
    # these archives are whole; a gap would be a page lost, so it ends the query
    lost = F.raise_error(F.concat(F.lit("quarantined: "), F.col("gap"))).cast("boolean")
    found = warc.read(spark, path).where(F.when(F.col("gap").isNull(), F.lit(True)).otherwise(lost))
    stored = F.col("record_type") == "response"
    return found.select(
        F.expr("nullif(regexp_extract(record_id, '<urn:page:(-?[0-9]+)>', 1), '')").cast("bigint").alias("page_id"),
        F.when(stored, F.octet_length("payload").cast("bigint")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(stored, F.sha2("payload", 256)).otherwise(F.regexp_replace("payload_digest", "^sha256:", "")).alias("payload_digest"),
        "record_type",
        F.expr("nullif(regexp_extract(refers_to, '<urn:page:(-?[0-9]+)>', 1), '')").cast("bigint").alias("refers_to"),
    )


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(read_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    n_hit = F.col("n_hit")
    return found.withColumn("n_hit", decontaminate._hits()).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontaminate.contaminated(n_hit, F.col("n_words")).alias("contaminated"),
    )


def op9_substring_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_exact.repeated(read_table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda acc, s: acc + s["end"] - s["start"])
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "token-files")
    token_files.write(read_table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_files.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read_table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.encode(read_table(spark, sf_dir, "embeddings"))


#: The rules of op13.
RULES = (url_filters.Rule("block", "net/"), url_filters.Rule("allow", "example.net/en/"), url_filters.Rule("block", "example.com/de/"), url_filters.Rule("allow", "org/fr/"))


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's label is that of the document whose number ends its path: bad if toxic or of quality 0."""
    pages, labels = read_table(spark, sf_dir, "pages"), read_table(spark, sf_dir, "labels")
    path = url_filters.address(F.col("url"))[1]
    numbered = pages.select("url", F.regexp_extract(path, r"/([0-9]+)(\.html)?/?$", 1).try_cast("bigint").alias("doc_id"))
    bad = F.greatest(F.coalesce("toxic", F.lit(0)), 1 - F.coalesce("quality", F.lit(1))) > 0
    known = labels.where("toxic IS NOT NULL OR quality IS NOT NULL").groupBy("doc_id").agg(F.max(bad).alias("bad"))
    judged = url_filters.judge(pages, numbered.join(known, "doc_id").select("url", "bad"), RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "template")


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_packing, op3_minhash_dedup, op4_passage_dedup, op5_token_counts, op6_warc, op7_quality_rules, op8_decontaminate, op9_substring_exact, op10_token_files, op11_spelling_variants, op12_vector_codes, op13_url_filters)}
