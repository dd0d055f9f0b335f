from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from tallygrid.functions import text as tx


def spans(text):
    ends = [m.start() for m in re.finditer(r"""(?<=[.!?])[ \t]+(?=[A-Z"'(])""", text)] + [len(text)]
    out, at = [], 0
    for e in ends:
        if e > at:
            out.append((at, e))
            at = e
    return out or [(0, len(text))]


def cap(text, a, b, size):
    if b - a <= size:
        return [(a, b)]
    return [(k, min(b, k + size)) for k in range(a, b, size) if text[k : min(b, k + size)].strip()]


def windows(text, size, policy, back=4, share=None):
    if len(text) <= size:
        return [(0, len(text))]
    s = spans(text)
    if policy == "sentence":
        return [w for a, b in s if text[a:b].strip() for w in cap(text, a, b, size)]
    if policy == "truncate":
        whole = [b for _, b in s if b <= size]
        return [(0, min(size, max(whole) if whole else s[0][1]))]
    out = []
    for a, b in tx.chunk_bounds([b - a for a, b in s], size, None if share else back, share):
        if text[a:b].strip():
            out += cap(text, a, b, size)
    return out


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    out = ["", "a", "Hello.  World!", "x" * 130, " " * 90, "One. Two. (Three) four?\tFive"]
    for _ in range(120):
        parts = []
        for _ in range(r.randint(1, 12)):
            parts.append("".join(r.choice("ab cé\U0001f600") for _ in range(r.randint(1, 60))) + r.choice(". ! ? ; .  ".split(" ")) + r.choice([" ", "  ", "\t", "\n"]) + r.choice("AB\"'(x"))
        out.append("".join(parts) + r.choice(["", "   ", "." + " " * 70]))
    return out


@pytest.mark.parametrize(("policy", "size", "kw"), [("sentence", 40, {}), ("truncate", 40, {}), ("chunk", 60, {}), ("chunk", 60, {"back": 1}), ("chunk", 60, {"back": 0}), ("chunk", 80, {"share": 0.25}), ("chunk", 80, {"share": 1.0})])
def test_windows(spark, texts, policy, size, kw):
    make = {"sentence": lambda t: tx.windows_sentence(t, size), "truncate": lambda t: tx.windows_truncate(t, size), "chunk": lambda t: tx.windows_chunk(t, size, kw.get("back", 4), kw.get("share"))}[policy]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r["id"]: [(w["a"], w["b"]) for w in r["w"]] for r in df.select("id", make(F.col("text")).alias("w")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == windows(t, size, policy, **kw), (i, t)
        assert all(b - a <= size for a, b in got[i])


def test_sentence_spans(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r["id"]: [(w["a"], w["b"]) for w in r["w"]] for r in df.select("id", tx.sentence_spans(F.col("text")).alias("w")).collect()}
    assert got == {i: spans(t) for i, t in enumerate(texts)}


CASES = ["mail a.b@x.org now", "pilar@enron.com____ x", "v@state.gov02-647", "A@B.CO and a@b.co", "none", "one@a.io,two@b.io three@c.io end", ""]


def pseudo(text, keep=None):
    import hashlib

    out, last, shift = [], 0, 0
    for m in re.finditer(tx.EMAIL, text):
        if keep and keep[0] <= m.start() and m.end() <= keep[1]:
            continue
        rep = f"{m[1]}+{hashlib.sha256(m[0].lower().encode()).hexdigest()[:4]}@example.invalid"
        out += [text[last : m.start()], rep]
        last = m.end()
        if keep and m.end() <= keep[0]:
            shift += len(rep) - len(m[0])
    return "".join(out) + text[last:], keep and (keep[0] + shift, keep[1] + shift)


def test_pseudonyms(spark):
    rows = [(i, t, a, a + n) for i, t in enumerate(CASES) for a in (0, 5, 12) for n in (0, 8, 20)]
    df = spark.createDataFrame([(k, *r[1:]) for k, r in enumerate(rows)], "id int, text string, a int, b int")
    out = df.select("id", tx.pseudonymise(F.col("text")).alias("p"), tx.pseudonymise_outside(F.col("text"), F.col("a"), F.col("b")).alias("x"), tx.pseudonymise_outside(F.col("text"), F.lit(None).cast("int"), F.lit(None).cast("int")).alias("y"))
    for r in out.collect():
        _, t, a, b = rows[r["id"]]
        assert r["p"] == pseudo(t)[0] == r["y"]["text"] and r["y"]["a"] is None
        assert (r["x"]["text"], (r["x"]["a"], r["x"]["b"])) == pseudo(t, (a, b))


def test_offsets_follow_all_changes(spark):
    """Any number of offsets through the shift points, against the rewritten text."""
    r = random.Random(9)
    texts = [" ".join(r.choice(["plain", "é\U0001f600", f"u{i}@a{i}.org", "x.y@b.co"]) for i in range(r.randint(0, 40))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    piece = lambda p: F.struct(p["address"].alias("address"), p["b"].alias("b"), F.coalesce(tx.pseudonym(p["address"]), F.lit("")).alias("new"))
    points = df.select("id", "text", tx.shifts(F.transform(tx.addresses(F.col("text")), piece)).alias("points"))
    every = points.select("id", "points", F.explode(F.sequence(F.lit(0), F.length("text"))).alias("old"))
    got = {(x["id"], x["old"]): x["new"] for x in every.select("id", "old", tx.shifted(F.col("points"), F.col("old")).alias("new")).collect()}
    for i, t in enumerate(texts):
        shift, last = 0, 0
        for m in [*re.finditer(tx.EMAIL, t), None]:
            for old in range(last, (m.start() if m else len(t)) + 1):
                assert got[i, old] == old + shift
            if m:
                shift, last = shift + len(pseudo(m[0])[0]) - len(m[0]), m.end()


def test_long_texts_take_no_quadratic_time(spark):
    n = 200_000
    df = spark.createDataFrame([("It ends here. " * n, "to a.b@c.org or " * n)], "s string, m string")
    got = df.select(F.size(tx.sentence_spans(F.col("s"))).alias("n"), F.element_at(tx.sentence_spans(F.col("s")), -1)["b"].alias("end"), tx.pseudonymise_outside(F.col("m"), F.lit(16 * n - 4), F.lit(16 * n)).alias("x")).first()
    assert (got["n"], got["end"]) == (n, 14 * n)
    new = len(pseudo("a.b@c.org")[0])
    assert len(got["x"]["text"]) == (16 - 9 + new) * n and got["x"]["a"] == 16 * n - 4 + (new - 9) * n


def test_prefix_sums(spark):
    rows = [[], [5], [1, 2, 3], list(range(1000))]
    got = spark.createDataFrame([(x,) for x in rows], "x array<int>").select(tx.prefix_sums(F.col("x")).alias("s")).collect()
    assert [r["s"] for r in got] == [[sum(x[: i + 1]) for i in range(len(x))] for x in rows]
