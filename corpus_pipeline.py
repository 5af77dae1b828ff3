"""The corpus pipeline: stages over ``documents``, each one operator of ``folio.llm``.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns the
columns of documents; the last one returns the packed pieces.
"""

from __future__ import annotations

from folio.llm.exact_dedup import keep_one_per_text
from folio.llm.mixing import sampled
from folio.llm.ngram_join import keep_one_per_group
from folio.llm.packing import pack_documents, tokenizer_path
from folio.llm.quality import keep_good

#: None: SQL expresses neither the model's training nor raking and packing; tests hold each stage against brute force.
ORACLE_SQL = None


def quality(spark, docs, sf_dir):
    """Documents that the quality classifier rejects go."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark, docs, sf_dir):
    """One document of each group of equal texts stays, the one with the largest id."""
    return keep_one_per_text(docs)


def near_dedup(spark, docs, sf_dir):
    """One document of each group of similar texts (five words, 0.8) stays, the one with the smallest id."""
    return keep_one_per_group(docs)


def mixing(spark, docs, sf_dir):
    """Sources, languages and topics are sampled to tempered shares."""
    return sampled(docs)


def packing(spark, docs, sf_dir):
    """All documents in sequences of 2048 tokens."""
    return pack_documents(docs, tokenizer_path())


STAGES = [("quality", quality), ("exact dedup", exact_dedup), ("near dedup", near_dedup), ("mixing", mixing), ("packing", packing)]


def run(spark, sf_dir):
    """All stages over ``documents``."""
    out = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        out = stage(spark, out, sf_dir)
    return out
