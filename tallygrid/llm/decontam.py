"""Benchmark decontamination: rare n-gram seeds, then local alignment.

Of each test item's distinct word 3-grams those that the corpus holds are its
seeds; the rarer half of them (by the number of corpus documents that hold
them) are rare.  Rarity is relative to the item, so an item that leaked into
very many documents still has rare seeds, and n-grams that no document holds,
such as those that the edits of a copy destroyed, take no place among them.
A text with one rare seed of an item, or two other ones near each other, has
the words around them aligned with the item by Smith-Waterman, and the score
over the best possible one decides.

With substitutions and deletions alone a copy that reaches MIN_SCORE has
three words in a row untouched if its item has more than SHORT words, and two
in a row otherwise; so short items have 2-grams as seeds, too.

Items travel to the executors in parts of at most ITEM_BYTES; a larger
benchmark takes one pass over the corpus for each part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shipping import ship
from .textkit import LOWER, column_bytes, groups, hash_ranges, ngram_hashes, words
from .workspace import Workspace, bounded

ITEM_BYTES = 32 << 20
#: Words in a seed, and words of an item up to which shorter ones are seeds as well.
N, SHORT = 3, 10
MIN_SEEDS = 8
#: Share of the best possible alignment score (a match is 2, a mismatch or a gap -1).
MIN_SCORE = 0.6
#: Ids of leaking documents that may be broadcast; beyond it they are joined by a shuffle.
BROADCAST_IDS = 500_000

_WORD = LOWER.copy()
for _c in range(128):
    if not chr(_c).isalnum():
        _WORD[_c] = 32


@dataclass
class Items:
    ids: np.ndarray
    words: list[np.ndarray]  # word hashes of each item
    sizes: list[int]  # n-gram lengths in use
    grams: np.ndarray  # distinct n-gram hashes, ascending
    first: np.ndarray  # places first[g] to first[g + 1] are those of gram g
    item: np.ndarray  # item of each place
    at: np.ndarray  # offset of each place in its item


def _words_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of the texts raw[offsets[i]:offsets[i + 1]], and each text's first word."""
    raw = _WORD[raw]
    starts, ends, first = words(raw, offsets)
    return hash_ranges(raw, starts, ends), first


def _index(rows: list[tuple[int, str]]) -> Items:
    h, first = _words_of(*column_bytes(pa.array([r[1] for r in rows], pa.string())))
    item_words = [h[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
    grams, item, at, sizes = [], [], [], set()
    for k, w in enumerate(item_words):
        for n in {min(N, len(w)), 2 if N > 2 and 2 < len(w) <= SHORT else min(N, len(w))} - {0}:
            g = ngram_hashes(w, n)
            sizes.add(n)
            grams.append(g)
            item.append(np.full(len(g), k))
            at.append(np.arange(len(g)))
    none = np.zeros(0, np.int64)
    grams, item, at = (np.concatenate(x) if x else none for x in (grams, item, at))
    order = np.lexsort((at, item, grams))
    kinds, places = np.unique(grams[order].astype(np.uint64), return_index=True)
    ids = np.array([r[0] for r in rows], np.int64)
    return Items(ids, item_words, sorted(sizes), kinds, np.append(places, len(order)), item[order], at[order])


def _lookup(grams: np.ndarray):
    """A function from hashes to (positions, gram indices) of those that are in grams."""
    bits = 22
    table = np.zeros(1 << bits, bool)
    table[(grams >> np.uint64(64 - bits)).astype(np.int64)] = True

    def find(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        maybe = np.flatnonzero(table[(h >> np.uint64(64 - bits)).astype(np.int64)])
        at = np.searchsorted(grams, h[maybe])
        at[at == len(grams)] = 0
        hit = grams[at] == h[maybe]
        return maybe[hit], at[hit]

    return find


def _hits(text: pa.Array, sizes: list[int], find) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each piece of the column with hits: (its first row, word hashes, first word of each row, and row, position and gram of each hit)."""
    raw, offsets = column_bytes(text)
    for i, j in groups(offsets):
        h, first = _words_of(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        found = []
        for n in sizes:
            p, g = find(ngram_hashes(h, n))
            r = np.searchsorted(first, p, side="right") - 1
            inside = p + n <= first[r + 1]
            found.append((r[inside], p[inside], g[inside]))
        row, pos, gram = (np.concatenate(x) for x in zip(*found, strict=True))
        if len(row):
            yield i, h, first, row, pos, gram


def align(query: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """(best local score, end in text): match 2, mismatch -1, gap -1."""
    m = len(text)
    ramp = np.arange(m + 1)
    before = np.zeros(m + 1, np.int64)
    best, end = 0, 0
    for q in query:
        now = np.zeros(m + 1, np.int64)
        now[1:] = np.maximum(before[:-1] + np.where(text == q, 2, -1), before[1:] - 1)
        now = np.maximum(np.maximum.accumulate(now + ramp) - ramp, 0)
        k = int(now.argmax())
        if now[k] > best:
            best, end = int(now[k]), k
        before = now
    return best, end


def _counter(items: Items):
    """(text) to (gram, documents that hold it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(len(items.grams), np.int64)
        find = _lookup(items.grams)
        for batch in batches:
            for _, _, _, row, _, gram in _hits(batch.column(0), items.sizes, find):
                once = np.unique(row * len(count) + gram) % len(count)
                count += np.bincount(once, minlength=len(count))
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some])], names=["gram", "n"])

    return run


def _rare(items: Items, df: np.ndarray) -> np.ndarray:
    """For each place whether its gram is among the rarer half of those of its item that some document holds."""
    gram = np.repeat(np.arange(len(items.grams)), np.diff(items.first))
    pairs = np.unique(items.item * len(df) + gram)
    item, kind = pairs // len(df), pairs % len(df)
    held = df[kind] > 0
    item, kind = item[held], kind[held]
    order = np.lexsort((kind, df[kind], item))
    item, kind = item[order], kind[order]
    begin = np.searchsorted(item, item)
    size = np.searchsorted(item, item, side="right") - begin
    rare = np.arange(len(item)) - begin < np.maximum(MIN_SEEDS, (size + 1) // 2)
    return np.isin(items.item * len(df) + gram, item[rare] * len(df) + kind[rare])


def _places(items: Items, rare: np.ndarray, size: np.ndarray, row, pos, gram) -> np.ndarray:
    """Rows (row, item, least start, greatest start) of the places of a piece that are worth an alignment."""
    count = items.first[gram + 1] - items.first[gram]
    k = np.arange(count.sum()) + np.repeat(items.first[gram] - np.cumsum(count) + count, count)
    row, gram, start = np.repeat(row, count), np.repeat(gram, count), np.repeat(pos, count) - items.at[k]
    item, rare = items.item[k], rare[k]
    order = np.lexsort((start, item, row))
    row, item, start, gram, rare = row[order], item[order], start[order], gram[order], rare[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (start[1:] - start[:-1] > size[item[1:]])
    at = np.flatnonzero(new)
    cluster = np.cumsum(new) - 1
    kinds = np.bincount(np.unique(cluster * len(items.grams) + gram) // len(items.grams), minlength=len(at))
    good = (kinds > 1) | np.logical_or.reduceat(rare, at)
    last = np.append(at[1:], len(row)) - 1
    return np.stack([row[at], item[at], start[at], start[last]], axis=1)[good]


def _aligner(items: Items, rare: np.ndarray, min_score: float):
    """(doc_id, text) to the items whose best alignment reaches the score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _lookup(items.grams)
        size = np.array([len(w) for w in items.words])
        bags = [np.unique(w, return_counts=True) for w in items.words]

        def matches(k: int, h: np.ndarray) -> int:
            """Words of item k that the words h can match at most."""
            kinds, count = bags[k]
            at = np.minimum(np.searchsorted(kinds, h), len(kinds) - 1)
            return int(np.minimum(np.bincount(at[kinds[at] == h], minlength=len(kinds)), count).sum())

        for batch in batches:
            best: dict[tuple[int, int], tuple[float, int, int]] = {}
            for i, h, first, row, pos, gram in _hits(batch.column(1), items.sizes, find):
                for r, k, lo, hi in _places(items, rare, size, row, pos, gram).tolist():
                    n, q = int(size[k]), items.words[k]
                    a, b = max(int(first[r]), lo - n // 2), min(int(first[r + 1]), hi + n + n // 2 + 1)
                    if matches(k, h[a:b]) < min_score * n:
                        continue
                    score, end = align(q, h[a:b])
                    if score >= min_score * 2 * n and score / (2 * n) > best.get((i + r, k), (0.0,))[0]:
                        back, length = align(q[::-1], h[a : a + end][::-1])
                        stop = a + end - int(first[r])
                        best[i + r, k] = (score / (2 * n), stop - length, stop)
            ids = batch.column(0)
            out = [(ids[r].as_py(), int(items.ids[k]), *x) for (r, k), x in sorted(best.items())]
            cols = list(zip(*out, strict=True)) if out else [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)],
                names=["doc_id", "item_id", "score", "start_word", "end_word"],
            )

    return run


def leaks(
    spark: SparkSession, docs: DataFrame, items: DataFrame, min_score: float = MIN_SCORE, item_bytes: int = ITEM_BYTES
) -> DataFrame:
    """(doc_id, item_id, score, start_word, end_word): every document that holds an item, best place first.

    docs(doc_id, text) and items(item_id, text) may have more columns.  Words
    are compared in ASCII lower case without ASCII punctuation.  A null or
    wordless text or item matches nothing; repeated rows give repeated
    results; items with equal words each report.  Empty tables give an empty
    result.
    """
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    items = items.where("text is not null and item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = 1 + total // item_bytes
    out = None
    for part in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).orderBy("item_id", "text").collect()
        index = _index([(r[0], r[1]) for r in rows])
        if not len(index.grams):
            continue
        counted = docs.select("text").mapInArrow(_counter(index), "gram long, n long")
        df = np.zeros(len(index.grams), np.int64)
        for gram, n in counted.groupBy("gram").agg(F.sum("n")).collect():
            df[gram] = n
        found = docs.mapInArrow(
            _aligner(index, _rare(index, df), min_score),
            "doc_id long, item_id long, score double, start_word long, end_word long",
        )
        out = found if out is None else out.union(found)
    if out is None:
        out = spark.createDataFrame([], "doc_id long, item_id long, score double, start_word long, end_word long")
    return out


def without_leaks(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs, all columns as they are, in which no item leaks.

    Rows that repeat an id go together; a null id or text stays.
    """
    ws = Workspace(spark)
    bad = ws.cut(leaks(spark, docs, items).select("doc_id").distinct())
    row = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"))
    return row.join(bounded(bad.withColumnRenamed("doc_id", "id"), BROADCAST_IDS), "id", "left_anti").select("row.*")
