from __future__ import annotations

import re

from tallygrid.llm.spans import RUNS, repeated_spans


def brute(docs):
    seen, out = set(), {}
    for i, t in sorted(docs):
        p = [x for x in re.sub(r"([^.!?][.!?][ \t\n\r]+|\n[ \t\n\r]*)", "\\1\u0001", t or "").split("\u0001") if x]
        s = [x.rstrip(" \t\n\r") for x in p]
        gone = set()
        for n, least in RUNS:
            for k in range(len(s) - n + 1):
                run = tuple(s[k : k + n])
                if sum(map(len, run)) >= least:
                    if run in seen:
                        gone.update(range(k, k + n))
                    seen.add(run)
        out[i] = (len(p), sorted(gone), "".join(x for k, x in enumerate(p) if k not in gone) if gone else t)
    return out


def test_equals_brute_force(spark, documents, texts):
    got = {r["row"]["doc_id"]: (r["n_sentences"], r["removed"], r["kept_text"]) for r in repeated_spans(spark, documents).collect()}
    want = brute([(i, t) for i, t, *_ in texts])
    assert got == want and any(x[1] for x in want.values())


def test_empty_and_odd(spark, nothing, odd):
    assert repeated_spans(spark, nothing).count() == 0
    got = repeated_spans(spark, odd).collect()
    assert len(got) == odd.count() and all(r["kept_text"] == r["row"]["text"] for r in got)


def test_short_sentences_and_control_characters(spark):
    rows = [(1, "Yes we do. No we do not. Call us now. One."), (2, "Two. Yes we do. No we do not. Call us now."), (3, "Tail\u0001keep. Wait! Go."), (4, "Tail\u0001keep. Wait! Stay.")]
    got = {r["row"]["doc_id"]: (r["removed"], r["kept_text"]) for r in repeated_spans(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ([], rows[0][1]), 2: ([1, 2, 3], "Two. "), 3: ([], rows[2][1]), 4: ([], rows[3][1])}
