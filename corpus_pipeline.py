"""From raw documents to token ids: five stages, each reading what the one before it wrote.

A stage is (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame. All but the last return the columns of ``docs``.

language          keeps texts whose words are recognised, fills a missing ``lang``; all texts with letters if no ``lang`` is given
near_duplicates   keeps one document of each class of near copies (texts without words never get here)
decontamination   drops documents that hold a benchmark window
personal_data     replaces personal data by its kind, renews ``n_chars``
tokens            encodes the text, decodes the ids and says whether the text came back

Columns beyond those of ``documents`` pass through the first four stages unchanged, whatever their
names; ``tokens`` leaves them out. Null and empty texts go in the first stage, an empty table gives
empty tables, and of repeated rows one stays.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import functions as F

from vesselspark.llm import bpe, decontamination, language, neardup, pii
from vesselspark.session import stored

#: A text is kept if its words are recognised with at least this mean score, each as whatever language it is.
LEAST_SCORE = 0.4
#: What the stages work on.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def aside(stage):
    """``stage`` with further columns of ``docs`` under names that no operator uses, so that it neither reads nor replaces them."""

    @wraps(stage)
    def run_stage(spark, docs, sf_dir):
        names = [c if c.lower() in COLUMNS else f"aside {k}" for k, c in enumerate(docs.columns)]
        return stage(spark, docs.toDF(*names), sf_dir).toDF(*docs.columns)

    return run_stage


@aside
def keep_languages(spark, docs, sf_dir):
    columns = [F.col(f"`{c}`") for c in docs.columns]
    model = language.trained(docs)
    if not model["labels"]:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    found = language.detect(docs, model, sure=True).filter(f"lang_pred <> 'und' and lang_sure >= {LEAST_SCORE}")
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*columns)


@aside
def keep_one_of_near_copies(spark, docs, sf_dir):
    return neardup.keep_one(docs)


@aside
def drop_contaminated(spark, docs, sf_dir):
    columns = [F.col(f"`{c}`") for c in docs.columns]
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.find_passages(docs, items).filter(F.size("hit_spans") == 0).select(*columns)


@aside
def mask_personal_data(spark, docs, sf_dir):
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return pii.redact(pii.find(docs)).withColumn("n_chars", F.length("text").cast("long")).select(*columns)


def encode_tokens(spark, docs, sf_dir):
    tokens = bpe.round_trips(docs.select("doc_id", "lang", "source", "text"), bpe.default_path())
    return tokens.select("doc_id", "lang", "source", "n_tokens", "token_ids", "round_trip")


STAGES = [
    ("language", keep_languages), ("near_duplicates", keep_one_of_near_copies), ("decontamination", drop_contaminated),
    ("personal_data", mask_personal_data), ("tokens", encode_tokens),
]

#: Near-duplicate classes, the language field and the encoder have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
