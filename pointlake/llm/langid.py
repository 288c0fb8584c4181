"""Language identification by compression.

Every learned language has a zstandard raw-content dictionary made of passages
from its documents. A text is cut into pieces that together cover all of it,
each piece is compressed with each dictionary, and the language with the
smallest total wins. A narrow win is decided again with an optimal parse; one
that stays narrow is rejected.

Fitting uses a bounded sample: at most ``sample_docs`` distinct texts a language
that hold a letter, chosen by the least hash of the text in as many hash buckets,
and ``dictionary_bytes`` bytes (UTF-8) from the middle of them together. Copies of
a text count once whatever their ids, and a line that several passages have goes
into a language's dictionary once. Every language with a labelled text that holds
a letter is learned.

Edge cases: null text, or text without a letter (Unicode category L), is ``und``
with score 0 and rejected; so is every text where nothing was learned. Ties go to
the language with more training documents, then to the lesser name. Rows with a
null id are held out. Very long texts are compressed whole, piece by piece.
Repeated rows keep their own result row; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointlake.llm.common import arrow_map, doc_fold, table

UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")


@dataclass(frozen=True)
class LanguageModel:
    """Languages in order of preference on ties, with their dictionaries."""

    dictionaries: tuple[tuple[str, bytes], ...]
    piece_bytes: int = 512
    quick_level: int = 3
    fine_level: int = 12
    narrow: float = 0.04
    reject_below: float = 0.002


def fit(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    train: Column | None = None,
    sample_docs: int = 1024,
    dictionary_bytes: int = 131072,
) -> LanguageModel:
    """Dictionaries from rows where ``train`` holds and the language is known."""
    known = docs.select(
        F.col(lang_col).alias("lang"),
        F.col(text_col).alias("text"),
        F.xxhash64(F.col(text_col)).alias("h"),
        (F.lit(True) if train is None else train).alias("train"),
    ).filter("train and lang is not null").filter(F.col("text").rlike(r"\p{L}"))
    picked = known.groupBy("lang", F.pmod("h", F.lit(sample_docs)).alias("bucket")).agg(F.min("h").alias("h"), F.count(F.lit(1)).alias("n"))
    shares = picked.groupBy("lang").agg(F.sum("n").alias("docs"), F.count(F.lit(1)).alias("picked")).collect()
    if not shares:
        return LanguageModel(())
    share = F.create_map(*[F.lit(x) for r in sorted(shares) for x in (r.lang, max(1, dictionary_bytes // r.picked))])
    # at most sample_docs rows a language; of copies one passage
    passages = (
        known.join(F.broadcast(picked.select("lang", "h")), ["lang", "h"])
        .select("lang", "h", _passage(F.col("text"), share[F.col("lang")]).alias("passage"))
        .groupBy("lang", "h")
        .agg(F.min("passage").alias("passage"))
        .collect()
    )
    lines: dict[str, dict[str, None]] = {r.lang: {} for r in shares}
    for r in sorted(passages, key=lambda r: (r.lang, r.h)):
        lines[r.lang].update(dict.fromkeys(r.passage.decode("utf-8", "ignore").lower().split("\n")))
    order = sorted(shares, key=lambda r: (-r.docs, r.lang))
    return LanguageModel(tuple((r.lang, "\n".join(lines[r.lang]).encode()) for r in order))


def _passage(text: Column, size: Column) -> Column:
    """At most ``size`` bytes from the middle of a text; from its first letter on, if there is none."""
    raw = text.cast("binary")
    middle = F.substring(raw, F.greatest(F.lit(0), (F.octet_length(text) - size) / 2).cast("int") + 1, size)
    first = F.substring(F.regexp_extract(text, r"(?s)\p{L}.*", 0).cast("binary"), F.lit(1), size)
    return F.when(middle.cast("string").rlike(r"\p{L}"), middle).otherwise(first)


class Classifier:
    """Compressors of one process."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self.languages = [lang for lang, _ in model.dictionaries]
        self.quick = [self._compressor(d, model.quick_level) for _, d in model.dictionaries]
        self.fine = [self._compressor(d, model.fine_level) for _, d in model.dictionaries]

    @staticmethod
    def _compressor(dictionary: bytes, level: int) -> zstandard.ZstdCompressor:
        params = zstandard.ZstdCompressionParameters.from_level(
            level,
            source_size=1 << 17,
            dict_size=len(dictionary),
            min_match=3,
            write_content_size=False,
            write_checksum=False,
            write_dict_id=False,
        )
        content = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return zstandard.ZstdCompressor(dict_data=content, compression_params=params)

    def _sizes(self, compressors: list, pieces: list[bytes]) -> list[int]:
        return [sum(len(c.compress(p)) for p in pieces) for c in compressors]

    def classify(self, text: str | None) -> tuple[str, float, float, bool]:
        """(language, score, margin a byte, rejected)."""
        if not text or not self.languages or not _LETTER.search(text):
            return UNDETERMINED, 0.0, 0.0, True
        data = text.lower().encode()
        step = self.model.piece_bytes
        pieces = [data[at : at + step] for at in range(0, len(data), step)]
        sizes = self._sizes(self.quick, pieces)
        if len(sizes) > 1 and self._margin(sizes) < self.model.narrow * len(data):
            sizes = self._sizes(self.fine, pieces)
        best = sizes.index(min(sizes))
        margin = self._margin(sizes) / len(data) if len(sizes) > 1 else 1.0
        score = 1.0 / sum(2.0 ** max(-60, min(sizes) - s) for s in sizes)
        return self.languages[best], score, margin, margin < self.model.reject_below

    @staticmethod
    def _margin(sizes: list[int]) -> int:
        low, second = sorted(sizes)[:2]
        return second - low


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``docs`` with the struct column ``language`` (lang_pred, score, margin, rejected).

    An input column of that name is replaced.
    """
    docs = docs.drop("language")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [f"c{k}" for k in range(len(docs.columns))]
    types = [f.dataType.simpleString() for f in docs.schema.fields]
    at = docs.columns.index(text_col)

    def make():
        classifier = Classifier(shared.value)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [classifier.classify(t) for t in batch.column(at).to_pylist()]
            lang, score, margin, rejected = zip(*found, strict=True)
            language = pa.StructArray.from_arrays(
                [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64()), pa.array(rejected, pa.bool_())],
                ["lang_pred", "score", "margin", "rejected"],
            )
            return pa.RecordBatch.from_arrays([*batch.columns, language], names=[*kept, "language"])

        return step

    schema = ", ".join(f"{c} {t}" for c, t in zip(kept, types, strict=True))
    schema += ", language struct<lang_pred:string,score:double,margin:double,rejected:boolean>"
    out = arrow_map(docs.toDF(*kept), make, schema)
    return out.select(*[F.col(c).alias(name) for c, name in zip(kept, docs.columns, strict=True)], "language")


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(doc_fold(id_col, 4) == 2, F.lit(True))


def predictions(docs: DataFrame) -> DataFrame:
    """The registered query's rows: learns from one side of the fold, predicts every row."""
    model = fit(docs, train=~held_out())
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "language.*")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions(table(spark, sf_dir, "documents"))
