"""The operators as queries over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coverset.llm import (
    decontaminate, embeddings, langid, licenses, mixture, quality, resample, sentencepiece, sharding, simhash, tokenbin, toxicity, trie,
)
from coverset.llm.common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, planes=1, distance=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex(F.element_at("fp", 1))), 16, "0").alias("fingerprint"), "component_id")


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op3_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op4_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return sentencepiece.encode(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), keep=["doc_id"])


def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.judge(found).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op6_language(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.train(docs))


def op7_licenses(spark, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), shards=40)


def op9_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op10_token_binary(spark, sf_dir: str) -> DataFrame:
    manifest = tokenbin.write(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenbin.new_folder(spark), special=True)
    return tokenbin.read(manifest)


def op11_packing(spark, sf_dir: str) -> DataFrame:
    return mixture.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), size=4096, end_id=2)


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_resample(spark, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=10)


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash, op2_toxicity, op3_embedding_dedup, op4_sentencepiece, op5_decontaminate, op6_language, op7_licenses, op8_sharding, op9_quality,
        op10_token_binary, op11_packing, op12_prefix_trie, op13_resample,
    )
}
