"""A corpus in five stages: quality rules, line dedup, near duplicates, secrets, packing."""

from pyspark.sql import functions as F

from depotflow.llm.common import write_shared
from depotflow.llm.line_dedup import dedup_lines
from depotflow.llm.packing import pack_documents
from depotflow.llm.quality_rules import judge_documents
from depotflow.llm.queries import same_ranks, tokenizer_spec
from depotflow.llm.secrets import redact_secrets
from depotflow.llm.simhash import drop_near_duplicates


def quality_rules(spark, docs, sf_dir):
    """Failing lines go; documents that the rules reject go. A null text counts as empty and is rejected."""
    judged = judge_documents(docs.select(F.struct("*").alias("d"), F.col("text").alias("t")), "t", out="r")
    return judged.where("r.kept").select(*[
        (F.col("r.clean_text") if c == "text" else F.col(f"d.`{c}`")).alias(c) for c in docs.columns])


def line_dedup(spark, docs, sf_dir):
    """Later copies of line runs of 50 words or more go; every document stays."""
    return dedup_lines(docs, min_words=50)


def near_dedup(spark, docs, sf_dir):
    """One document of each component of fingerprints within 3 bits, of three-word shingles, stays."""
    return drop_near_duplicates(docs, shingle=3, radius=3)


def secret_scan(spark, docs, sf_dir):
    """Secrets are masked; every document stays."""
    return redact_secrets(docs)


def packing(spark, docs, sf_dir):
    """Pieces of sequences of 2,048 tokens, with the checksum of their ids."""
    pieces = pack_documents(docs, tokenizer_spec(), window=2048, end_id=1, **same_ranks())
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("near dedup", near_dedup),
          ("secret scan", secret_scan), ("packing", packing)]

#: SQL has no tokenizer, so the last stage cannot be stated; the stages are tested one by one.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over `documents`; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write_shared(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
