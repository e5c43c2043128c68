"""The opN queries and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import op1_mix, op2_secrets, op3_topk, op4_bpe, op5_media, op6_repair, op7_ngram_join, op8_html, op9_chat, op10_langid, op11_negatives, op12_packing, op13_runs
from quarry.llm.common import cut, table


def tokenizer_path(name: str) -> str:
    """A public tokenizer file: in the folder QUARRY_TOKENIZERS where that is set, else where its package keeps it."""
    folder = os.environ.get("QUARRY_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mix_sources(spark, sf_dir) -> DataFrame:
    return op1_mix.mix(table(spark, sf_dir, "documents"))


def op2_secret_scan(spark, sf_dir) -> DataFrame:
    return op2_secrets.scan(table(spark, sf_dir, "documents"))


def op3_exact_topk(spark, sf_dir) -> DataFrame:
    return op3_topk.top_k(table(spark, sf_dir, "embeddings"))


def op4_bpe_transducer(spark, sf_dir) -> DataFrame:
    return op4_bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op5_media_columns(spark, sf_dir) -> DataFrame:
    files = op5_media.store(table(spark, sf_dir, "documents"))
    return op5_media.inspect(cut(files, "media", **{"parquet.block.size": 8 << 20}))  # small row groups: a task holds one of whole files


def op6_repair_shards(spark, sf_dir) -> DataFrame:
    shards = op6_repair.write_shards(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return op6_repair.read_shards(cut(shards, "shards"))


def op7_ngram_jaccard(spark, sf_dir) -> DataFrame:
    return op7_ngram_join.join(table(spark, sf_dir, "documents"))


def op8_html_main_text(spark, sf_dir) -> DataFrame:
    return op8_html.extract(table(spark, sf_dir, "pages"))


def op9_chat_format(spark, sf_dir) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], conversations.schema)
    return op9_chat.read_back(op9_chat.format_log(op9_chat.as_events(conversations.unionByName(extra))))


def op10_language_id(spark, sf_dir) -> DataFrame:
    return op10_langid.languages_of(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages"))


def op11_hard_negatives(spark, sf_dir) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))  # labels that disagree with their vectors
    return op11_negatives.mine(vectors.withColumn("label", label))


def op12_cost_packing(spark, sf_dir) -> DataFrame:
    pieces = op12_packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_length", "cost")


def op13_word_runs(spark, sf_dir) -> DataFrame:
    return op13_runs.digests(op13_runs.find(op13_runs.planted(table(spark, sf_dir, "documents"))))


def queries():
    found = (op1_mix_sources, op2_secret_scan, op3_exact_topk, op4_bpe_transducer, op5_media_columns, op6_repair_shards, op7_ngram_jaccard, op8_html_main_text, op9_chat_format, op10_language_id, op11_hard_negatives, op12_cost_packing, op13_word_runs)
    return {f.__name__: f for f in found}


def oracle_sql():
    return {"op3_exact_topk": op3_topk.ORACLE, "op9_chat_format": op9_chat.ORACLE, "op11_hard_negatives": op11_negatives.ORACLE}
