"""A corpus from raw documents to packed training windows, stage by stage.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that the one before it kept. All but the
last return the columns of their input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from stratadoc.llm import decontamination, disclosure, minmax_dups, packing, toxicity
from stratadoc.llm.common import narrow, ready
from stratadoc.llm.language import fold
from stratadoc.session import durable

TOXIC_FROM = 0.3


NEAR_COPY_WORDS = 5


def _without(docs: DataFrame, found: DataFrame, *keys: str) -> DataFrame:
    """Rows that agree with no row of ``found`` in ``doc_id`` and ``of``, the hash of the text, or those of them named.

    A key that is null agrees with nothing. The row travels as one value, so that none of its names can clash.
    """
    packed = docs.select(
        F.col("`doc_id`").alias("doc_id"), F.xxhash64("`text`").alias("of"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    )
    left = packed.join(found.select(*keys).distinct(), list(keys), "left_anti")
    return left.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold; learned as in the query of operator 9.

    A null or empty text has a score like any other; rows that repeat are judged alike; no rows give none.
    """
    labels = narrow(ready(spark).read.parquet(f"{sf_dir}/labels.parquet"), doc_id="doc_id", toxic="toxic")
    model = toxicity.learn(narrow(docs, doc_id="doc_id", text="text"), labels.where(fold("doc_id", 4) != 2))
    return docs.where(toxicity.score(spark, model) < TOXIC_FROM)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies by shingles of five words: the one with the smallest id.

    Rows with one id and different texts are documents of their own; of those with the smallest id of a group
    the one with the smallest hash of its text stays, and of rows that agree in both the first by all their columns.
    Rows without an id or without a word are no near copies and stay.
    """
    rows = minmax_dups.judged_rows(narrow(docs, doc_id="doc_id", text="text"), minmax_dups.PERCENT, NEAR_COPY_WORDS)
    found = durable(rows.select("doc_id", "of", "stays", (F.col("n_shingles") > 0).alias("worded")))
    kept = _without(docs, found.where("not stays"), "doc_id", "of")
    repeated = found.where("stays and worded and doc_id is not null").groupBy("doc_id", "of").count().where("count > 1")
    repeated = durable(repeated.select("doc_id", "of"))
    if repeated.isEmpty():
        return kept
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    again = docs.select(F.col("`doc_id`").alias("doc_id"), F.xxhash64("`text`").alias("of"), row).join(repeated, ["doc_id", "of"])
    first = Window.partitionBy("doc_id", "of").orderBy(F.to_json("row"))
    once = again.withColumn("place", F.row_number().over(first)).where("place = 1")
    return _without(kept, repeated, "doc_id", "of").unionByName(once.select(*[F.col("row").getField(c).alias(c) for c in docs.columns]))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window. The text is judged, so rows without an id, and rows that share one, are too.

    A null or empty text holds no window and stays; no rows give none.
    """
    benchmark = ready(spark).read.parquet(f"{sf_dir}/benchmark.parquet")
    texts = docs.select(F.xxhash64("`text`").alias("doc_id"), F.col("`text`").alias("text"))
    hit = decontamination.contamination(texts, benchmark).where("n_hit > 0")
    return _without(docs, hit.select(F.col("doc_id").alias("of")), "of")


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and the terms that give it away replaced by their kind."""
    ready(spark)
    out = disclosure.sanitised(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of whole documents, placed in training windows; a null or empty text is its end id alone."""
    import public_tokenizers

    ready(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("personal_data", remove_personal_data),
    ("packing", pack_windows),
]
#: Trained models, hashing and least squares are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again by the next one."""
    docs = ready(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = durable(docs)
    return docs


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
