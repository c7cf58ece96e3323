"""The registered queries of the training-data operators: thin, with production parameters."""

from __future__ import annotations

import corpus_pipeline

from windlass.llm import (embedding_join, exact_dedup, heap_clusters, language_model, languages, licenses, mixing, packing, prefix_trie,
                          quality, secrets, simhash, toxicity)
from windlass.llm.common import read


def op1_toxicity(spark, sf_dir):
    return toxicity.score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_licenses(spark, sf_dir):
    return licenses.scan_licenses(read(spark, sf_dir, "documents"))


def op3_packing(spark, sf_dir):
    return packing.pack(read(spark, sf_dir, "documents"))


def op4_secrets(spark, sf_dir):
    return secrets.find_secrets(read(spark, sf_dir, "documents"))


def op5_language_model(spark, sf_dir):
    return language_model.score_documents(read(spark, sf_dir, "documents"))


def op6_mixing(spark, sf_dir):
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_groups(read(spark, sf_dir, "documents"))


def op8_quality(spark, sf_dir):
    return quality.score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_embeddings(spark, sf_dir):
    return embedding_join.near_groups(read(spark, sf_dir, "embeddings"))


def op10_simhash(spark, sf_dir):
    return simhash.near_groups(read(spark, sf_dir, "documents"))


def op11_prefix_trie(spark, sf_dir):
    return prefix_trie.prefix_trie(read(spark, sf_dir, "conversations"))


def op12_clusters(spark, sf_dir):
    return heap_clusters.cluster_vectors(read(spark, sf_dir, "embeddings"))


def op13_languages(spark, sf_dir):
    return languages.identify_documents(read(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_licenses, op3_packing, op4_secrets, op5_language_model, op6_mixing, op7_exact_dedup,
                                   op8_quality, op9_embeddings, op10_simhash, op11_prefix_trie, op12_clusters, op13_languages)}
QUERIES["pipeline"] = corpus_pipeline.run
SQL = {"op6_mixing": mixing.SQL, "op7_exact_dedup": exact_dedup.SQL, "op11_prefix_trie": prefix_trie.SQL, "op12_clusters": heap_clusters.SQL}
