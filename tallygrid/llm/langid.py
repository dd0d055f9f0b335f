"""Language identification by compression.

For each language a raw-content zstandard dictionary is made of a bounded
sample of labelled texts.  A text belongs to the language whose dictionary
encodes it in the fewest bytes.  Long texts are encoded in chunks, so that
every part is measured against the dictionaries rather than against the
beginning of the same text; the whole text counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.shipping import ship

#: Labelled documents per language whose text may enter a dictionary, and bytes taken from each.
SAMPLE_DOCS, SAMPLE_BYTES = 384, 256
#: Languages whose dictionaries fit into a task; more are refused.
MAX_LANGUAGES = 2000
CHUNK = 4096
#: Byte lead over the next language below which a document is rejected: this many bytes and this share of its size.
MIN_LEAD, MIN_SHARE = 1, 0.002

_LETTER = re.compile(r"[^\W\d_]")  # or another sign that counts as a number, such as a half
_SCHEMA = "doc_id long, lang_pred string, score double, lead long, size long, rejected boolean"


def has_letter(text: str) -> bool:
    return any(m.group().isalpha() for m in _LETTER.finditer(text))


def fit_dictionaries(
    spark: SparkSession, labelled: DataFrame, docs: int = SAMPLE_DOCS, each: int = SAMPLE_BYTES
) -> dict[str, bytes]:
    """A dictionary per language from rows (doc_id, text, lang) of a bounded sample.

    The sample is the ``docs`` rows of each language with the smallest hash
    of their id and text, ``each`` bytes of each from a place that the hash
    tells: a fixed, order-free choice.  Rows with a null text or language
    teach nothing.  More than MAX_LANGUAGES languages are an error.
    """
    ship(spark)
    labelled = labelled.where("text is not null and lang is not null")
    labelled = labelled.select("text", "lang", F.xxhash64("doc_id", "text").alias("h"))
    sizes = labelled.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()
    if not sizes:
        return {}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    span = float(2**64)
    cut = [(r["lang"], int(min(2.0**63 - 1024, -(2.0**63) + span * 4 * (docs + 16) / r["count"]))) for r in sizes]
    near = labelled.join(F.broadcast(spark.createDataFrame(cut, "lang string, top long")), "lang").where("h <= top")
    order = Window.partitionBy("lang").orderBy("h", "text")
    rows = near.withColumn("i", F.row_number().over(order)).where(F.col("i") <= docs)
    start = F.pmod(F.xxhash64("h"), F.greatest(F.length("text") - each, F.lit(0)) + 1).cast("int") + 1
    rows = rows.select("lang", "i", F.col("text").substr(start, F.lit(each)).alias("text"))
    parts: dict[str, list[tuple[int, bytes]]] = {}
    for r in rows.collect():
        parts.setdefault(r["lang"], []).append((r["i"], r["text"].lower().encode("utf-8", "replace")[:each]))
    return {k: b"\n".join(x for _, x in sorted(v, reverse=True)) for k, v in sorted(parts.items())}


def _predictor(dictionaries: dict[str, bytes], level: int, fine: int):
    """level: for all texts; fine: for those whose lead is narrow at that level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        names = list(dictionaries)

        def encoders(at: int) -> list:
            out = []
            for name in names:
                d = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                params = zstandard.ZstdCompressionParameters.from_level(
                    at, write_content_size=False, write_checksum=False, write_dict_id=False
                )
                d.precompute_compress(compression_params=params)
                out.append(zstandard.ZstdCompressor(dict_data=d, compression_params=params).compress)
            return out

        coarse, close = encoders(level), encoders(fine)

        def sizes(data: bytes, with_: list) -> list[int]:
            chunks = [data[i : i + CHUNK] for i in range(0, len(data), CHUNK)]
            return [sum(len(f(c)) for c in chunks) for f in with_]

        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                if not names or text is None or not has_letter(text):
                    out.append(("und", 0.0, 0, 0, True))
                    continue
                data = text.lower().encode("utf-8", "replace")
                got = sizes(data, coarse)
                low = sorted(got)
                if len(low) > 1 and low[1] - low[0] < max(16, 0.02 * low[1]):
                    # narrow: measure again with shorter matches
                    got = sizes(data, close)
                    low = sorted(got)
                best = int(np.argmin(got))
                lead = low[1] - low[0] if len(low) > 1 else low[0]
                p = 1.0 / sum(2.0 ** -min(500, x - low[0]) for x in low)
                out.append((names[best], p, lead, low[0], lead < MIN_LEAD or lead < MIN_SHARE * low[0]))
            cols = list(zip(*out, strict=True)) if out else [()] * 5
            kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))],
                names=["doc_id", "lang_pred", "score", "lead", "size", "rejected"],
            )

    return run


def identify(docs: DataFrame, dictionaries: dict[str, bytes], level: int = 3, fine: int = 12) -> DataFrame:
    """(doc_id, lang_pred, score, lead, size, rejected) for each row of docs(doc_id, text).

    lang_pred is ``und`` where the text is null or has no letter, or where no
    language was learned; equal sizes go to the alphabetically first
    language.  score is the winner's share of 2**-(bytes behind the best).
    rejected marks ``und`` and narrow leads.  An empty table gives an empty
    result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_predictor(dictionaries, level, fine), _SCHEMA)


def held_out(doc_id="doc_id", mod: int = 4, rest: int = 2):
    """True for the documents that are kept from training."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % mod == rest, F.lit(False))


def language_id(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Predictions for every row, learned from the rows that are not held out."""
    train = docs.where(~held_out()).select("doc_id", "text", "lang")
    out = identify(docs, fit_dictionaries(spark, train))
    return out.withColumn("held_out", held_out())


def keep_identified(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns as they are, whose language is not rejected.

    The decision is a function of a row's text alone, so equal texts share
    their fate, and rows that repeat an id do too when their text repeats.
    """
    dictionaries = fit_dictionaries(spark, docs.where(~held_out()).select("doc_id", "text", "lang"))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = _predictor(dictionaries, 3, 12)
        at = names.index("text")
        for batch in batches:
            two = pa.RecordBatch.from_arrays([batch.column(at), batch.column(at)], names=["doc_id", "text"])
            rejected = next(predict(iter([two]))).column(5).to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(~rejected))

    return docs.mapInArrow(run, docs.schema)
