from __future__ import annotations

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tallygrid.llm import suffixes as sx


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_suffix_array(s):
    assert sx.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def brute(docs):
    seen, out = set(), {}
    for i, t in docs:
        b = (t or "").encode()
        cover = bytearray(len(b))
        for p in range(len(b) - 99):
            w = b[p : p + 100]
            if w in seen:
                cover[p : p + 100] = b"\1" * 100
            seen.add(w)
        spans = [k for k in range(len(b)) if cover[k] and (not k or not cover[k - 1])]
        out[i] = (len(b), len(spans), bytes(c for c, m in zip(b, cover, strict=True) if not m))
    return out


def rows(df):
    return {r["doc_id"]: (r["n_bytes"], len(r["spans"]), bytes(r["kept"])) for r in df.collect()}


def overlapping(n=50):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(2, 8)))
    passage = [" ".join(word() for _ in range(k)) for k in (16, 22, 40, 120)]
    docs = []
    for i in range(n):
        parts = [" ".join(word() for _ in range(r.randint(0, 15))) for _ in range(4)]
        p = passage[i % 4]
        a, b = sorted((r.randint(0, len(p)), r.randint(0, len(p))))
        docs.append((i, f"{parts[0]} {p[a:b]} {parts[1]}{p}{parts[2]} {p if i % 5 == 0 else ''}"))
    return [*docs, (n, "ab" * 400), (n + 1, "a" * 350), (n + 2, "a" * 100), (n + 3, "a" * 99)]


def test_equals_brute_force(spark, documents, texts):
    for docs, df in (([(i, t) for i, t, *_ in texts], documents), (overlapping(), spark.createDataFrame(overlapping(), "doc_id long, text string").repartition(3))):
        assert rows(sx.repeated_bytes(spark, df)) == brute(docs)


def test_large_groups_and_blocks(spark, monkeypatch):
    docs = overlapping(30)
    want = brute(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for block in (0, 50, 400):
        monkeypatch.setattr(sx, "BLOCK", block)
        assert rows(sx.repeated_bytes(spark, df)) == want


def test_text_longer_than_a_piece(spark, monkeypatch):
    from tallygrid.llm import anchors

    r = random.Random(1)
    text = "".join(r.choice("abcdefgh ") for _ in range(9000))
    docs = [(1, text), (2, text[3000:5000] + "x" + text[2990:3200]), (3, text)]
    want = brute(docs)
    for piece in (500, 4096):
        out = []
        monkeypatch.setattr(anchors, "PIECE", piece)
        import pyarrow as pa

        for row, first, count, *_ in anchors.column_segments(pa.array([t for _, t in docs]), 100, 50):
            out += [(int(a), int(b) + k) for a, b, c in zip(row, first, count, strict=True) for k in range(c)]
        assert sorted(out) == [(i, p) for i, (_, t) in enumerate(docs) for p in range(len(t) - 99)]
    monkeypatch.undo()
    assert rows(sx.repeated_bytes(spark, spark.createDataFrame(docs, "doc_id long, text string"))) == want


def test_empty_and_odd(spark, nothing, odd):
    assert sx.repeated_bytes(spark, nothing).count() == 0
    got = sx.repeated_bytes(spark, odd).collect()
    assert len(got) == odd.count()
    assert [len(r["spans"]) for r in got if r["doc_id"] in (None, 1)] == [0] * 4
