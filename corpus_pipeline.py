"""Corpus pipeline: from raw documents to token ids, one operator a stage.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept. All
but the last return the columns of ``documents``. Which rows go:

- ``language_id``: documents whose language is rejected (no letter, or margins
  too narrow). A missing ``lang`` is filled with the prediction.
- ``near_dedup``: of each component of texts whose five-word shingles are 80 %
  alike one row stays, that with the least doc_id, then text key.
- ``decontaminate``: documents that leak a benchmark item.
- ``pii``: none; personal data and the terms that reveal it are generalised in
  ``text``, and ``n_chars`` follows.
- ``bpe``: none; token ids, their count and the decoded text.

Rows with a null doc_id are documents like any other; in ``near_dedup`` they come
after all ids. Rows of one id with different texts are different documents. Empty
tables pass through all stages; very long texts are worked on whole.

All stages run in the same executors, so each after the first begins by giving back
the memory that those before it have left unused there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointlake.llm import bpe, decontam, langid, pii, simhash
from pointlake.llm.common import ensure_checkpoint_dir, release, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.fit(docs, train=~langid.held_out())
    found = langid.identify(docs.select(*COLUMNS), model).filter(~F.col("language.rejected"))
    return found.withColumn("lang", F.coalesce("lang", "language.lang_pred")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release(spark)
    return simhash.one_of_each(docs.select(*COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release(spark)
    return decontam.without_leaks(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def remove_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release(spark)
    return pii.sanitise(docs.select(*COLUMNS)).withColumn("n_chars", F.char_length("text").cast("long"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    release(spark)
    encoded = bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("pii", remove_pii),
    ("bpe", encode),
]

#: Most stages have no SQL form; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between stages rows go through a written table.

    A stage's table is deleted once the next one's is written; only the last, which the
    result reads, stays.
    """
    home = f"{ensure_checkpoint_dir(spark)}/pipeline-{spark.sparkContext.applicationId}-{spark._jvm.java.util.UUID.randomUUID()}"
    docs, last = table(spark, sf_dir, "documents"), None
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs.write.parquet(here := f"{home}/{number}-{name}")
            if last:
                path = spark._jvm.org.apache.hadoop.fs.Path(last)
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
            docs, last = spark.read.parquet(here), here
    return docs
