from __future__ import annotations

import random

import pytest

#: Columns that clash with names the operators use inside or return.
EXTRA = {"node": 1, "key": 2, "component_id": 3, "lines": "x", "row": "y", "n_shingles": 0, "score": 0.5, "p": 1}


def sentence(r: random.Random, n: int) -> str:
    return " ".join(r.choice(WORDS) for _ in range(n)).capitalize() + "."


WORDS = [a + b for a in ("ta", "re", "mi", "so", "lu", "ka", "né", "wo") for b in ("n", "st", "ble", "dor", "ing", "ü", "x9", "tion")]


def corpus(seed: int = 1, n: int = 60) -> list[tuple[int, str | None, str | None, str | None]]:
    """Documents with copies, near copies, shared lines and passages, nulls, blanks and one long text."""
    r = random.Random(seed)
    shared = [sentence(r, k) for k in (6, 9, 30)]
    docs: list[tuple[int, str | None, str | None, str | None]] = []
    for i in range(n):
        lines = [" ".join(sentence(r, r.randint(1, 12)) for _ in range(r.randint(1, 5))) for _ in range(r.randint(1, 6))]
        if i % 3 == 0:
            lines.insert(r.randrange(len(lines) + 1), shared[i % 2])
        if i % 5 == 0:
            lines.append(shared[2] + " " + shared[1] + " " + shared[0])
        text = "\n".join(lines)
        if i % 7 == 1 and i > 7:
            text = docs[i - 7][1]
        if i % 6 == 2 and i > 6 and docs[i - 5][1]:
            w = docs[i - 5][1].split(" ")
            w[len(w) // 2] = "changed"
            text = " ".join(w)
        docs.append((i, text, "en" if i % 2 else "fr", f"s{i % 3}"))
    docs += [(n, None, "en", "s0"), (n + 1, "", None, "s0"), (n + 2, " \n\t ", "en", None), (n + 3, "one two", "en", "s1"), (n + 4, "one two", "en", "s1")]
    docs += [(n + 5, "\n".join(sentence(r, 12) for _ in range(900)), "fr", "s2")]
    return docs


@pytest.fixture(scope="session")
def texts():
    return corpus()


@pytest.fixture(scope="session")
def documents(spark, texts):
    rows = [(i, t, lang, src, len(t or ""), *EXTRA.values()) for i, t, lang, src in texts]
    schema = "doc_id long, text string, lang string, source string, n_chars long, node int, key int, component_id int, lines string, row string, n_shingles int, score double, p int"
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def odd(spark):
    """A null id, repeated rows, and an id with two texts."""
    long = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    rows = [(None, long, "en", "s"), (1, long, "en", "s"), (1, long, "en", "s"), (2, long + " end", "en", "s"), (2, "other words here now", None, None), (None, None, None, None)]
    return spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
