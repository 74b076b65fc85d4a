"""The registered queries of this subpackage: thin, over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, divergence, embeddup, langid, lexical, licenses, materialize, mixing, neardup, packing, quality, secrets, sharding, tokens
from .common import scratch_dir, table

#: Byte limit of a shard.
SHARD_BYTES = 1 << 20


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def pieces_of(docs: DataFrame) -> DataFrame:
    """Narrow rows for packing: the digest of a piece's ids instead of the ids."""
    cut = tokens.token_pieces(docs.select("doc_id", "text"), tokenizer_path=tokenizer_path(), max_tokens=2048)
    return cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    labelled = langid.label_documents(docs.select("doc_id", "text"), langid.fit(docs))
    return labelled.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(pieces_of(table(spark, sf_dir, "documents")), capacity=2048)


def op3_materialize(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    folder = f"{scratch_dir(spark)}/training-{uuid.uuid4().hex}"
    return materialize.materialize(docs, tokenizer_path=tokenizer_path(), key=20_24, folder=folder)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), weights=(3, 1, 2), total_share=1.5, max_epochs=2.0)
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{said}'), (-7L, 1L, 'assistant', '{said}') AS (conv_id, turn, role, text)")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    examples = chat.prefix_examples(turns)
    by_conv = examples.withColumn("loss", chat.loss_text(examples)).groupBy("conv_id").agg(
        F.max_by("text", "example").alias("longest"), F.sum(F.length("text")).alias("formatted_chars"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "").alias("loss"),
    )
    said = by_conv.withColumn("turns", chat.read_turns(F.col("longest")))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return said.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality_verdicts(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return neardup.ngram_jaccard_classes(docs, shingle_words=5, similarity_percent=80).drop("node")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, placed = sharding.extendible_shards(table(spark, sf_dir, "documents").select("doc_id", "text"), limit_bytes=SHARD_BYTES)
    written = sharding.write_shards(placed, f"{scratch_dir(spark)}/shards-{uuid.uuid4().hex}")
    return written.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"), "prefix", "depth", "part")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    # the table has no paths: a document's directory is its source, its id's thousands and hundreds; each hundredth document is
    # a license file, that of its thousands where it is the first of them. Without an id there is no path.
    top = F.concat(F.lit("/"), F.coalesce("source", F.lit("none")), F.lit("/"), F.floor(F.col("doc_id") / 1000))
    hundreds = F.concat(top, F.lit("/"), F.floor(F.col("doc_id") / 100))
    path = F.when(F.col("doc_id") % 1000 == 0, F.concat(top, F.lit("/LICENSE"))).when(F.col("doc_id") % 100 == 0, F.concat(hundreds, F.lit("/LICENSE")))
    path = path.otherwise(F.concat(hundreds, F.lit("/doc-"), F.col("doc_id")))
    scanned = licenses.own_licenses(docs.withColumn("path", path)).select("doc_id", "path", "own_license", "own_score", "own_line")
    return licenses.inherited_licenses(scanned)


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return embeddup.embedding_duplicates(vectors, similarity=0.95)


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.digests(secrets.scan(docs, secrets.fit(docs)))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"), least_docs=3, listed=200)


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical.build_index(table(spark, sf_dir, "documents"))
    return lexical.search(index, table(spark, sf_dir, "benchmark"), k=10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language": op1_language,
    "op2_packing": op2_packing,
    "op3_materialize": op3_materialize,
    "op4_mixing": op4_mixing,
    "op5_chat": op5_chat,
    "op6_quality": op6_quality,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op8_sharding": op8_sharding,
    "op9_licenses": op9_licenses,
    "op10_embeddings": op10_embeddings,
    "op11_secrets": op11_secrets,
    "op12_divergence": op12_divergence,
    "op13_search": op13_search,
}
