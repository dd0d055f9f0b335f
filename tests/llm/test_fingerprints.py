from __future__ import annotations

import hashlib

import pytest

from tallygrid.llm import fingerprints as fp


def test_columns_against_brute_force(spark, documents, texts):
    got = {r["doc_id"]: r for r in fp.fingerprints(spark, documents).collect()}
    ordered = sorted((i, t or "") for i, t, *_ in texts)
    assert len(got) == len(ordered)
    for k, (i, t) in enumerate(ordered):
        after = ordered[(k + 1) % len(ordered)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == fp.sketch(t) and r["edited_fingerprint"] == fp.sketch(edited)
        assert r["near_edited"] == fp.resemblance(fp.sketch(t), fp.sketch(edited))
        assert r["near_next"] == fp.resemblance(fp.sketch(t), fp.sketch(after))


def test_sketch_algebra():
    a, b = " ".join(f"w{i}" for i in range(400)), " ".join(f"w{i}" for i in range(200, 700))
    sa, sb = fp.sketch(a), fp.sketch(b)
    assert fp.merge(sa, sb) == fp.merge(sb, sa) and fp.merge(sa, sa) == sa
    assert abs(fp.distinct(sa) - 396) < 100 and abs(fp.resemblance(sa, sb) - 196 / 696) < 0.15
    assert fp.containment(fp.sketch(a[:100]), sa) > 0.8
    assert fp.resemblance(fp.sketch(""), fp.sketch(None)) == 1.0 and fp.resemblance(sa, "") == 0.0


def test_short_lone_and_odd(spark, nothing, odd):
    assert fp.fingerprints(spark, nothing).count() == 0
    one = fp.fingerprints(spark, spark.createDataFrame([(5, "abcd")], "doc_id long, text string")).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and one["near_next"] == 1.0
    assert fp.fingerprints(spark, odd).count() == odd.count()


@pytest.mark.parametrize("parts", ["1", "13"])
def test_ranges_do_not_matter(spark, documents, parts):
    want = sorted(map(tuple, fp.fingerprints(spark, documents).collect()))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        assert sorted(map(tuple, fp.fingerprints(spark, documents).collect())) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
