"""Delta-maintained token totals by source, language and tokenizer version.

Every change is a signed row: an insert counts +1 document and +n tokens, a
delete takes both away, a revision is a delete of the old count and an insert of
the new one. A batch of changes is summed by key before anything is stored (so a
hot source is one row a task) and written to a folder of its own. It counts once a
marker file named by its id stands; the marker is put there by a rename that fails
where one stands already, so of several writers of one id one wins, and a batch id
is not applied again however often it is sent. ``compact`` sums what is committed into
a running total, which the totals then start from, and deletes what it holds.

Edge cases: null source, language or version is a key of its own; null token counts
and null texts are none. Rows are changes of their own, whatever their doc_id, null
and repeated ones too. An empty batch commits and changes nothing. A failed write
leaves a folder that no marker names. Keys whose documents and tokens have come to
zero are left out of the totals. Very long texts are counted whole. Extra columns of
changes are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointlake.llm.bpe import encode_documents
from pointlake.llm.common import cut, ensure_checkpoint_dir, table

KEYS = ("source", "lang", "tokenizer_version")
_SCHEMA = "source string, lang string, tokenizer_version string, documents long, tokens long"


def signed(rows: DataFrame, sign: int, version: str, tokens: Column, source: str = "source", lang: str = "lang") -> DataFrame:
    """Changes of one sign: one document and ``tokens`` tokens for each row."""
    return rows.select(
        F.col(source).cast("string").alias("source"),
        F.col(lang).cast("string").alias("lang"),
        F.lit(version).alias("tokenizer_version"),
        F.lit(sign).cast("long").alias("documents"),
        (F.lit(sign) * F.coalesce(tokens, F.lit(0))).cast("long").alias("tokens"),
    )


def inserts(rows: DataFrame, version: str, tokens: Column) -> DataFrame:
    return signed(rows, 1, version, tokens)


def deletes(rows: DataFrame, version: str, tokens: Column) -> DataFrame:
    return signed(rows, -1, version, tokens)


def revisions(rows: DataFrame, version: str, before: Column, after: Column) -> DataFrame:
    return deletes(rows, version, before).unionByName(inserts(rows, version, after))


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))


class TokenRollup:
    """Totals kept as a running total and a folder of summed changes for each batch committed since."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._at(self.path).getFileSystem(conf)
        self._context = self._hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)

    def _at(self, path: str):
        return self._hadoop.fs.Path(path)

    def _listed(self, folder: str) -> list[str]:
        home = self._at(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(home)) if self._fs.exists(home) else []

    def _mark(self, marker: str, says: str) -> bool:
        """Put a file that names ``says`` at ``marker``, at once and only if none stands there."""
        draft = self._at(f"{self.path}/drafts/{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(says.encode()))
        out.close()
        target = self._at(f"{self.path}/{marker}")
        self._fs.mkdirs(target.getParent())
        options = self.spark.sparkContext._gateway.new_array(getattr(self._hadoop.fs, "Options$Rename"), 0)
        try:
            self._context.rename(draft, target, options)
        except Py4JJavaError as e:
            if not self._fs.exists(target):
                raise e
            self._fs.delete(draft, False)
            return False
        return True

    def _said(self, marker: str) -> str:
        stream = self._fs.open(self._at(f"{self.path}/{marker}"))
        try:
            return bytes(stream.readNBytes(4096)).decode()
        finally:
            stream.close()

    def batches(self) -> list[str]:
        """Ids of the committed batches."""
        return self._listed("commits")

    def _total(self) -> tuple[str | None, set[str]]:
        """The folder of the running total and the ids that it holds."""
        markers = self._listed("totals")
        if not markers:
            return None, set()
        folder = f"{self.path}/sums/{self._said(f'totals/{markers[-1]}')}"
        return f"{folder}/sum", {r[0] for r in self.spark.read.schema("id string").parquet(f"{folder}/ids").collect()}

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Apply a batch once; False if it had been committed before."""
        if not batch_id or not all(c.isalnum() or c in "-_" for c in batch_id):
            raise ValueError("a batch id consists of letters, digits, - and _")
        if self._fs.exists(self._at(f"{self.path}/commits/{batch_id}")):
            return False
        folder = f"{batch_id}-{uuid.uuid4().hex}"
        _summed(changes).write.parquet(f"{self.path}/batches/{folder}")
        if self._mark(f"commits/{batch_id}", folder):
            return True
        self._fs.delete(self._at(f"{self.path}/batches/{folder}"), True)
        return False

    def _folders(self, ids: Iterable[str]) -> list[str]:
        return [f"{self.path}/batches/{self._said(f'commits/{i}')}" for i in ids]

    def _rows(self) -> tuple[DataFrame, list[str]]:
        """The running total's rows and those of the batches committed since, and all ids."""
        total, held = self._total()
        ids = self.batches()
        folders = [*([total] if total else []), *self._folders(i for i in ids if i not in held)]
        rows = self.spark.read.schema(_SCHEMA).parquet(*folders) if folders else self.spark.createDataFrame([], _SCHEMA)
        return rows, ids

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer_version, documents, tokens) over all committed batches."""
        return _summed(self._rows()[0]).filter("documents <> 0 or tokens <> 0")

    def compact(self) -> bool:
        """Sum all committed batches into a new running total; False if another writer was first.

        What the total before held is deleted, so no reader of older totals may be at work.
        """
        markers, (before, held) = self._listed("totals"), self._total()
        rows, ids = self._rows()
        folder = uuid.uuid4().hex
        _summed(rows).write.parquet(f"{self.path}/sums/{folder}/sum")
        self.spark.createDataFrame([(i,) for i in ids], "id string").write.parquet(f"{self.path}/sums/{folder}/ids")
        number = int(markers[-1]) + 1 if markers else 1
        won = self._mark(f"totals/{number:012d}", folder)
        gone = [*self._folders(i for i in ids if i not in held), *([before.rsplit("/", 1)[0]] if before else [])] if won else [f"{self.path}/sums/{folder}"]
        for path in gone:
            self._fs.delete(self._at(path), True)
        return won

    def commit_all(self, batches: Iterable[tuple[str, DataFrame]]) -> list[bool]:
        return [self.commit(batch_id, changes) for batch_id, changes in batches]


#: Tokenizer versions of the registered query: words between ASCII white space, and runs
#: of ASCII letters and digits and non-ASCII characters.
WORDS, PLAIN = "words/1", "plain-words/1"


def word_count(text: Column, pattern: str) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(pattern)).cast("long")


def with_token_counts(docs: DataFrame, tokenizer_path: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens``, the number of ids that the tokenizer's file gives each text."""
    numbered = cut(docs.withColumn("row_number", F.monotonically_increasing_id()))
    counted = encode_documents(numbered, tokenizer_path, "row_number", text_col).select("row_number", F.size("ids").cast("long").alias("n_tokens"))
    return numbered.join(counted, "row_number").drop("row_number")


def rolled_up(docs: DataFrame, labels: DataFrame, path: str) -> DataFrame:
    """Totals after a load from estimated counts, their revision, and a withdrawal.

    ``load`` counts words by estimate (characters over six) and plain words exactly;
    ``recount`` revises all estimates; ``withdraw`` deletes documents labelled toxic.
    ``recount`` is sent twice and must count once; then all is compacted.
    """
    counted = cut(
        docs.select(
            "doc_id",
            "source",
            "lang",
            F.floor(F.coalesce("n_chars", F.lit(0)) / 6).cast("long").alias("estimate"),
            word_count(F.col("text"), r"[^\x20\x09-\x0D]+").alias("words"),
            word_count(F.col("text"), r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+").alias("plain"),
        )
    )
    toxic = labels.filter("toxic = 1").select("doc_id").distinct()
    withdrawn = counted.join(toxic, "doc_id", "left_semi")
    rollup = TokenRollup(docs.sparkSession, path)
    recount = revisions(counted, WORDS, F.col("estimate"), F.col("words"))
    rollup.commit_all(
        [
            ("load", inserts(counted, WORDS, F.col("estimate")).unionByName(inserts(counted, PLAIN, F.col("plain")))),
            ("recount", recount),
            ("recount", recount),
        ]
    )
    rollup.compact()
    rollup.commit("withdraw", deletes(withdrawn, WORDS, F.col("words")).unionByName(deletes(withdrawn, PLAIN, F.col("plain"))))
    return rollup.totals()


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{ensure_checkpoint_dir(spark)}/rollup-{uuid.uuid4().hex}"
    return rolled_up(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), path)


OP7_SQL = r"""
WITH kept AS (
  SELECT source, lang,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words,
         len(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS plain
  FROM documents
  WHERE doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL)
)
SELECT source, lang, tokenizer_version, CAST(count(*) AS BIGINT) AS documents, CAST(sum(tokens) AS BIGINT) AS tokens
FROM (
  SELECT source, lang, 'words/1' AS tokenizer_version, words AS tokens FROM kept
  UNION ALL
  SELECT source, lang, 'plain-words/1', plain FROM kept
)
GROUP BY source, lang, tokenizer_version
"""
