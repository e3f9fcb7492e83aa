"""Corpus pipeline: stages over documents, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from fleetspan.llm import jaccard, mixing, packing, passages, quality
from fleetspan.llm.common import stored


def _labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_filter(spark, docs, sf_dir):
    """Documents that the quality classifier rejects go."""
    return quality.accept(docs, quality.fit(docs, _labels(spark, sf_dir)))


def near_duplicates(spark, docs, sf_dir):
    """One document of each group of near copies stays."""
    return jaccard.keep_one(docs)


def repeated_passages(spark, docs, sf_dir):
    """Passages that an earlier document holds are cut from the text; every document stays."""
    return passages.remove(docs, passages.passages(docs))


def target_mixture(spark, docs, sf_dir):
    """Each document stays as many times as its rate says."""
    return mixing.mix(docs, _labels(spark, sf_dir), keep="clean")


def best_fit_packing(spark, docs, sf_dir):
    """Pieces of documents in bins of permitted lengths."""
    return packing.packed(docs)


STAGES = [
    ("quality_classifier", quality_filter),
    ("ngram_jaccard_join", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("target_mixture", target_mixture),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
