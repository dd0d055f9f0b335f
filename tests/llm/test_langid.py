from __future__ import annotations

import random

import pytest
import zstandard
from pyspark.sql import functions as F

from tallygrid.llm import langid as li

SYLLABLES = {"xa": ["tha", "ing", "ere", "oun", "sh"], "xb": ["kré", "ouv", "eau", "lle", "té"], "xc": ["sch", "ung", "lich", "ver", "zü"]}


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(2)
    rows = []
    for i in range(400):
        lang = sorted(SYLLABLES)[i % 3]
        text = " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 3))) for _ in range(r.randint(8, 200)))
        rows.append((i, text.upper() if i % 11 == 0 else text, lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)


def test_held_out_accuracy(spark, labelled):
    got = li.language_id(spark, labelled).join(labelled.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 60 and sum(r["lang"] == r["lang_pred"] for r in got) / len(got) >= 0.98
    assert all(0 <= r["score"] <= 1 for r in got)


def test_held_out_rows_teach_nothing(spark, labelled):
    from pyspark.sql import functions as F

    twisted = labelled.withColumn("lang", F.when(li.held_out(), "zz").otherwise(F.col("lang")))
    a = sorted(map(tuple, li.language_id(spark, labelled).collect()))
    assert a == sorted(map(tuple, li.language_id(spark, twisted).collect()))


def test_undecided(spark, labelled, nothing, odd):
    d = li.fit_dictionaries(spark, labelled)
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "12 !! 34"), (4, "é")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in li.identify(rows, d).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and got[4]["lang_pred"] in SYLLABLES
    assert all(got[i]["rejected"] for i in (1, 2, 3))
    assert li.language_id(spark, nothing).count() == 0 and li.language_id(spark, odd).count() == odd.count()
    assert {r["lang_pred"] for r in li.identify(rows, {}).collect()} == {"und"}


def test_filter_keeps_columns(spark, labelled):
    left = li.keep_identified(spark, labelled)
    assert left.columns == labelled.columns and left.count() >= 398


def test_numbers_are_no_letters():
    from tallygrid.llm.langid import has_letter

    assert not any(map(has_letter, ("", "½ ² ③ 12", "_ -", "Ⅷ"))) and all(map(has_letter, ("1a", "½é", "ʰ", "語")))


def plain_dictionaries(rows, docs, each):
    """The sample by sorting all rows of each language; rows are (lang, hash, start, text)."""
    out = {}
    for lang in sorted({x[0] for x in rows}):
        mine = sorted((h, text, start) for x, h, start, text in rows if x == lang)[:docs]
        out[lang] = b"\n".join(text[start : start + each].lower().encode()[:each] for _, text, start in reversed(mine))
    return out


def plain_prediction(text, dictionaries):
    """One text, encoded with every dictionary chunk by chunk, nothing prepared beforehand."""
    if text is None or not any(c.isalpha() for c in text):
        return ("und", 0.0, 0, 0, True)
    data = text.lower().encode()

    def size(content, level):
        total = 0
        for i in range(0, len(data), 4096):
            kind = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            how = zstandard.ZstdCompressionParameters.from_level(level, write_content_size=False, write_checksum=False, write_dict_id=False)
            kind.precompute_compress(compression_params=how)
            total += len(zstandard.ZstdCompressor(dict_data=kind, compression_params=how).compress(data[i : i + 4096]))
        return total

    for level in (3, 12):
        got = [(size(d, level), lang) for lang, d in dictionaries.items()]
        (best, lang), (second, _) = sorted(got)[:2]
        if second - best >= max(16, 0.02 * second):
            break
    p = 1.0 / sum(2.0 ** -min(500, x - best) for x, _ in sorted(got))
    return (lang, p, second - best, best, second - best < 1 or second - best < 0.002 * best)


def test_against_plain_encoding(spark, labelled, odd):
    """The whole operator: dictionaries, sizes at both levels, leads, scores and rejections, row by row."""
    mixed = labelled.where("doc_id < 120").unionByName(odd.select("doc_id", "text", "lang"))
    half = F.concat(F.substring("text", 1, 40), F.lit(" "), F.lit(" ".join(SYLLABLES["xa"] + SYLLABLES["xb"] + SYLLABLES["xc"])))
    mixed = mixed.withColumn("text", F.when(F.col("doc_id") % 5 == 3, half).otherwise(F.col("text")))
    long = " ".join(SYLLABLES["xb"][i % 5] + SYLLABLES["xb"][i % 3] for i in range(60_000))
    extra = [(900, long, "xb"), (901, long[:5000] + " 12 " + long[-9000:], None), (902, "", "xa"), (903, "ab", "xc"), (903, "ab", "xc")]
    mixed = mixed.unionByName(spark.createDataFrame(extra, "doc_id long, text string, lang string"))
    h = F.xxhash64("doc_id", "text")
    room = F.greatest(F.length("text") - li.SAMPLE_BYTES, F.lit(0)) + 1
    taught = mixed.where(~li.held_out()).where("text is not null and lang is not null").withColumn("h", h)
    rows = [tuple(r) for r in taught.select("lang", "h", F.pmod(F.xxhash64("h"), room).cast("int"), "text").collect()]
    dictionaries = plain_dictionaries(rows, li.SAMPLE_DOCS, li.SAMPLE_BYTES)
    assert dictionaries == li.fit_dictionaries(spark, mixed.where(~li.held_out()))
    want = [(r["doc_id"], *plain_prediction(r["text"], dictionaries)) for r in mixed.collect()]
    got = [tuple(r)[:6] for r in li.language_id(spark, mixed).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert any(x[5] and x[1] != "und" for x in want) or any(x[3] < 16 for x in want)


def test_small_samples_and_ties_of_the_sample(spark, labelled):
    for docs, each in ((1, 10), (7, 64)):
        room = F.greatest(F.length("text") - each, F.lit(0)) + 1
        taught = labelled.withColumn("h", F.xxhash64("doc_id", "text"))
        rows = [tuple(r) for r in taught.select("lang", "h", F.pmod(F.xxhash64("h"), room).cast("int"), "text").collect()]
        assert li.fit_dictionaries(spark, labelled.unionByName(labelled.limit(0)), docs, each) == plain_dictionaries(rows, docs, each)


def test_clashing_columns_and_long_texts(spark, documents):
    plain = documents.select("doc_id", "text", "lang")
    a = li.language_id(spark, documents)
    assert a.columns == ["doc_id", "lang_pred", "score", "lead", "size", "rejected", "held_out"]
    assert sorted(map(str, a.collect())) == sorted(map(str, li.language_id(spark, plain).collect()))
