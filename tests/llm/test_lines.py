from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from tallygrid.llm import lines as ln


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def normal(text):
    """A line at a time, character by character."""
    out = []
    for line in (text or "").split("\n"):
        x = "".join(("0" if c.isdigit() else c.lower() if c.isalpha() else " ") if ord(c) < 128 else c for c in line)
        out.append(" ".join(w for w in x.split(" ") if w))
    return out


def near(x, y):
    most = max(len(x), len(y))
    return 100 * (most - ln.edit_distance(x, y, most // 10)) >= ln.MIN_SIMILARITY * most


def brute(docs):
    """The places removed, by edit similarity alone of all pairs of lines."""
    occ = [(d, i, x) for d, t in docs if t is not None and d is not None for i, x in enumerate(normal(t)) if x]
    first = {}
    for d, i, x in sorted(occ):
        first.setdefault(x, (d, i))
    kinds = sorted(first)
    parent = {x: x for x in kinds}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    # an edit changes two of the counts of characters by one each, at most
    counts = np.array([np.bincount([ord(c) % 64 for c in x], minlength=64) for x in kinds])
    pairs = []
    for k, x in enumerate(kinds):
        apart = np.abs(counts[k + 1 :] - counts[k]).sum(axis=1)
        pairs += [(x, kinds[j]) for j in (np.flatnonzero(apart * 5 <= np.maximum(counts[k + 1 :].sum(axis=1), len(x))) + k + 1).tolist() if near(x, kinds[j])]
    for x, y in pairs:
        parent[find(y)] = find(x)
    place = {}
    for x in kinds:
        place[find(x)] = min(place.get(find(x), first[x]), first[x])
    return {(d, i) for d, i, x in occ if (d, i) != place[find(x)]}, pairs


def removed(out):
    return {(r["row"]["doc_id"], i) for r in out for i in r["removed"]}


def test_bounds_of_tiles_count_the_bits_of_signed_hashes():
    bag = np.zeros(32, np.uint8).tobytes()
    row = lambda lo: pa.table({"size": pa.array([60], pa.int32()), "lo": pa.array([lo], pa.int64()), "hi": pa.array([1], pa.int64()), "bag": pa.array([bag])})
    match = ln._possible_matrix(ln.MIN_SIMILARITY)
    assert match(row(5), row(5 - 2**63))[0, 0]
    assert match(row(-2), row(-1))[0, 0]
    assert not match(row(1 << 62), row(-1 - (1 << 62)))[0, 0]


def test_edit_distance_of_many_pairs():
    r = random.Random(8)
    for letters in ("ab", "abcdefgh ijkl", "aé漢\U0001f600b"):
        pairs = [("", ""), ("a", ""), ("", "b")]
        for _ in range(400):
            x = [r.choice(letters) for _ in range(r.choice([1, 5, 9, 10, 19, 20, 60, 200, 700]))]
            y = list(x)
            for _ in range(r.randint(0, len(x) // 7 + 2)):
                at = r.randint(0, len(y))
                y[at : at + r.randint(0, 1)] = r.choice([[], [r.choice(letters)]])
            pairs.append(("".join(x), "".join(y)))
        for percent in (75, 90):
            want = [levenshtein(x, y) * 100 <= (100 - percent) * max(len(x), len(y)) if len(x) < 100 else ln.edit_distance(x, y) * 100 <= (100 - percent) * max(len(x), len(y)) for x, y in pairs]
            assert ln.all_within(*map(list, zip(*pairs, strict=True)), percent).tolist() == want
            assert 0 < sum(want) < len(want)
    assert ln.all_within([], [], 90).tolist() == []


def test_edit_distance():
    r = random.Random(4)
    for _ in range(600):
        a, b = ("".join(r.choice("abcé") for _ in range(r.randint(0, 14))) for _ in range(2))
        d = levenshtein(a, b)
        assert ln.edit_distance(a, b) == d
        for most in (0, 1, 3, 6):
            assert ln.edit_distance(a, b, most) == (d if d <= most else most + 1)
            assert not ln.surely_within(a, b, most) or d <= most
    x = "a line of some length with words that are edited in two places"
    assert ln.surely_within(x, x.replace("some", "more").replace("two", "2"), 8) and not ln.surely_within(x, x.replace("some", "more"), 1)


def test_lines_and_their_hashes():
    r = random.Random(8)
    texts = ["".join(r.choice("aB9 .\t\né") for _ in range(r.randint(0, 40))) for _ in range(200)] + ["", None, "\n", "x", "\n\n a\n"]
    got = [(int(a), int(n), x[i].decode()) for x in ln.column_lines(pa.array(texts)) for i, (a, n) in enumerate(zip(x.row, x.number, strict=True))]
    assert got == [(i, k, x) for i, t in enumerate(texts) for k, x in enumerate(normal(t))]
    (x,) = ln.column_lines(pa.array(["one two\ntwo one\nOne, Two!\n\none"]))
    x = x.pick(np.flatnonzero(np.diff(x.first) > 0))
    for h in ln.line_hashes(x):
        assert h[0] == h[2] and len(set(h.tolist())) == 3


def test_simhash_votes():
    text = "\n".join(["one two three four", "one two three four four", "x " * 300 + "y", " ".join("w" + "abcdefghij"[i % 10] * (i // 10 + 1) for i in range(700))])
    (x,) = ln.column_lines(pa.array([text]))
    s = ln.simhash(x)
    assert (s[0] == s[1]).all() and (s[2] != s[0]).any()
    assert (ln.simhash(x.pick(np.array([3])))[0] == s[3]).all()


def fuzzy(n=40):
    r = random.Random(9)
    base = [" ".join("".join(r.choice("abcdefghijklmnopqrst") for _ in range(r.randint(2, 9))) for _ in range(40)) for _ in range(4)]
    docs = []
    for i in range(n):
        w = base[i % 4].split()
        for _ in range(i % 3):
            w[r.randrange(len(w))] = w[0]
        own = " ".join("".join(r.choice("abcdefghijklmnopqrst") for _ in range(6)) for _ in range(6))
        docs.append((i, f"{own}\n{' '.join(w)}\n{base[i % 4].upper()}!!\nshort one"))
    return docs


def test_equals_brute_force(spark, documents, texts):
    for docs, df in (([(i, t) for i, t, *_ in texts], documents), (fuzzy(), spark.createDataFrame(fuzzy(), "doc_id long, text string"))):
        want, _ = brute(docs)
        got = {r["row"]["doc_id"]: r for r in ln.drop_repeated_lines(spark, df).collect()}
        assert len(got) == len(docs) and want and removed(got.values()) == want
        for i, t in docs:
            kept = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in want)
            assert got[i]["kept_text"] == kept and got[i]["n_lines"] == (0 if t is None else t.count("\n") + 1)


def test_recall_of_edited_lines(spark):
    """Lines of 4 to 80 words with words replaced; every near pair by brute force loses its later line."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrst") for _ in range(r.randint(3, 9)))
    vocabulary = [word() for _ in range(3000)]
    rows = []
    for n in (4, 8, 10, 15, 20, 40, 80):
        for _ in range(25):
            w = [r.choice(vocabulary) for _ in range(n)]
            rows.append(" ".join(w))
            for _ in range(max(1, n // 12)):
                w[r.randrange(n)] = r.choice(vocabulary)
            rows.append(" ".join(w))
    want, pairs = brute(list(enumerate(rows)))
    got = removed(ln.drop_repeated_lines(spark, spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect())
    assert got <= want and len(got) >= 0.98 * len(want) and len(pairs) > 80


def test_segments_miss_nothing():
    r = random.Random(3)
    tried = 0
    for _ in range(3000):
        x = "".join(r.choice("abcdeé") for _ in range(r.randint(10, ln.SHORT)))
        y = list(x)
        for _ in range(r.randint(1, 4)):
            k, c = r.randrange(len(y)), r.choice("abc é")
            y[k : k + r.randint(0, 1)] = r.choice([[c], [c], []])
        y = "".join(y)
        if len(y) <= ln.SHORT and near(x, y):
            tried += 1
            assert set(ln.segments(x)) & set(ln.segments(y))
    assert tried > 1000


def test_crowded_keys_are_spread(texts, monkeypatch):
    def lists(crowd):
        monkeypatch.setattr(ln, "CROWD", crowd)
        batch = pa.RecordBatch.from_pydict({"doc_id": [i for i, *_ in texts], "text_key": [i for i, *_ in texts], "text": [t or "" for _, t, *_ in texts]})
        out = {}
        rows = pa.Table.from_batches([b.select(["part", "how", "pairs"]).filter(b.column("part").is_valid()) for b in ln._scan(1, 5)(iter([batch]))])
        for part in range(5):
            here = rows.filter(pa.array([x == part for x in rows.column("part").to_pylist()]))
            if here.num_rows:
                got = ln._shared_keys(here)
                for k, n in zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True):
                    out.setdefault(k, set()).add(n)
        return {k: v for k, v in out.items() if len(v) > 1}

    assert lists(3) == lists(10**9)


def test_stage_and_odd(spark, documents, nothing, odd):
    out = ln.without_repeated_lines(spark, documents)
    assert out.schema == documents.schema or out.columns == documents.columns
    assert all(r["n_chars"] == len(r["text"] or "") for r in out.collect())
    assert ln.without_repeated_lines(spark, nothing).count() == 0
    got = ln.drop_repeated_lines(spark, odd).collect()
    assert len(got) == odd.count() and sum(len(r["removed"]) for r in got) <= 1
