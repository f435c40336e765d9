"""The contract queries ``opN_<name>``: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import bpe, conversation_trie, decontamination, fill_middle, licenses, packing, pii, quality, repeated_phrases, simhash_dedup, toxicity, url_filter, warc
from waymark.llm.common import durable, shared_path, small_batches, small_reads, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
END_ID = 50256


def vocabulary(name: str = VOCABULARY) -> tuple[str, str]:
    """Path of a public rank file and the splitting pattern."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", simhash_dedup.hex_fingerprint().alias("fingerprint"), "component_id")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.overlaps(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = vocabulary()
    coded = bpe.encode(table(spark, sf_dir, "documents", "doc_id", "text"), path, pattern)
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256)
    coded = coded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), digest.alias("ids_sha256"), "ids")
    return bpe.decode(coded, path, keep=("doc_id", "n_tokens", "ids_sha256")).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = durable(quality.features(table(spark, sf_dir, "documents", "doc_id", "text")))
    judged = quality.judge(measured, quality.fit(measured))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("quality", 9).alias("quality"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = url_filter.parse(table(spark, sf_dir, "pages", "page_id", "url"))
    model = url_filter.fit(url_filter.labelled(pages))
    return url_filter.judge(pages, model).select("page_id", "host", "path", "rule", "verdict", F.round("unwanted", 9).alias("unwanted"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents", "doc_id", "text"))


def op7_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = vocabulary()
    files = shared_path(spark, "packed")
    encode = partial(bpe.coded, path=path, pattern=pattern, names=["id", "ids"])
    packing.write(table(spark, sf_dir, "documents", "doc_id", "text"), files, ids_col="text", row_length=2048, end_id=END_ID, pad_id=END_ID, width=2, encode=encode)
    return packing.read(spark, files, width=2)


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    small_reads(spark)
    documents = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic").where(~held_out())
    scored = toxicity.score(documents, toxicity.fit(documents, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents", "doc_id", "text"))
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("plain", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(listed("plain").cast("binary"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    warc.write(warc.plan_records(table(spark, sf_dir, "pages")), path)
    return warc.read(spark, path, payloads=False).where("state = 'ok'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    small_reads(spark)
    cut = fill_middle.transform(table(spark, sf_dir, "documents", "doc_id", "text"))
    cut = cut.select("doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"), F.sha2("output", 256).alias("output_sha256"), "output")
    back = fill_middle.restore(cut, keep=("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256"))
    return back.withColumn("restored", F.sha2("restored", 256)).withColumnRenamed("restored", "restored_sha256")


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeated_phrases.deduplicated(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversation_trie.numbered(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))
    share = F.crc32(F.col("conv").cast("string").cast("binary")) % 4
    found = conversation_trie.trie(*conversation_trie.shared_openings(turns, F.col("conv") - F.col("conv") % 20, share, most=3))
    out = conversation_trie.with_digest(found)
    return out.select("conv_id", F.col("depth").cast("bigint").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash_dedup, op2_decontamination, op3_bpe, op4_quality_rules, op5_url_filter, op6_license_scan, op7_token_packing, op8_toxicity, op9_pii, op10_warc, op11_fill_middle, op12_substring_dedup, op13_conversation_trie)}
