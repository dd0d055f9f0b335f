"""Sentence spans, windows and e-mail pseudonyms as column expressions.

Offsets count code points.  A text that fits the window is one window under
every policy.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed pattern: a sentence ends behind . ! or ? where blanks and a capital, quote or bracket follow; the blanks open the next one.
SENTENCE_END = r"""(?<=[.!?])(?=[ \t]+[A-Z"'(])"""
#: Fixed values of the e-mail pseudonyms: address pattern, domain, separator and digits of the suffix.
EMAIL = r"([A-Za-z0-9._%+-]+)@([A-Za-z0-9.-]+\.[A-Za-z]{2,})"
DOMAIN, SEPARATOR, SUFFIX = "example.invalid", "+", 4
#: Fixed pattern of the trivial baseline.
FLOOR = r"(?i)\b(ignore (all )?(previous|prior) instructions|disregard the above|you are now|system prompt|as an AI language model)\b"

def as_re2(pattern: str) -> str:
    """A pattern of plain words for Java and ASCII-mode Python with RE2's meaning: ASCII word bounds, and, without case, s and k in all their forms."""
    edge = "(?:(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?![0-9A-Za-z_]))"
    flag, rest = ("(?i)", pattern[4:]) if pattern.startswith("(?i)") else ("", pattern)
    if flag:
        rest = rest.translate({ord(a): f"[{a}{b}]" for a, b in (("s", "\u017f"), ("S", "\u017f"), ("k", "\u212a"), ("K", "\u212a"))})
    return flag + rest.replace("\\b", edge)


def matches(text: Column, pattern: str) -> Column:
    """Whether RE2 finds the pattern of plain words; its word bounds, which are slow to check, are tried only where the words occur."""
    return text.rlike(as_re2(pattern.replace("\\b", ""))) & text.rlike(as_re2(pattern))


SPANS = T.ArrayType(T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType())]))


def sentences(text: Column) -> Column:
    """The sentences in order; together they are the text."""
    return F.split(text, SENTENCE_END, -1)


def not_blank(text: Column) -> Column:
    return text.rlike(r"(?U)\S")


def _span(a: Column, b: Column) -> Column:
    return F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def prefix_sums(numbers: Column, steps: int = 31) -> Column:
    """Running sums of an array of integers, by doubling: n log n additions, and no array grows element by element."""
    strides = F.array(*[F.lit(1 << k) for k in range(steps)])

    def add(sums: Column, stride: Column) -> Column:
        return F.when(F.size(sums) <= stride, sums).otherwise(F.transform(sums, lambda x, i: x + F.coalesce(F.get(sums, i - stride), F.lit(0))))

    return F.aggregate(strides, numbers, add)


def sentence_spans(text: Column) -> Column:
    """array<struct<a, b>>, half open, covering the text; an empty text has one empty span."""
    ends = prefix_sums(F.transform(sentences(text), F.length))
    return let(ends, lambda e: F.transform(e, lambda b, i: _span(F.coalesce(F.get(e, i - 1), F.lit(0)), b)))


def cut(text: Column, span: Column) -> Column:
    return F.substring(text, span["a"] + 1, span["b"] - span["a"])


def capped(text: Column, spans: Column, size: int) -> Column:
    """Spans cut to at most size code points; blank pieces of a cut span are dropped."""

    def pieces(s: Column) -> Column:
        starts = F.sequence(s["a"], s["b"] - 1, F.lit(size))
        parts = F.transform(starts, lambda a: _span(a, F.least(a + size, s["b"])))
        return F.when(s["b"] - s["a"] <= size, F.array(s)).otherwise(F.filter(parts, lambda p: not_blank(cut(text, p))))

    return F.flatten(F.transform(spans, pieces))


def _whole(text: Column) -> Column:
    return F.array(_span(F.lit(0), F.length(text)))


def windows_full(text: Column) -> Column:
    return _whole(text)


def windows_sentence(text: Column, size: int, cap: bool = True) -> Column:
    """Sentences of a text beyond size; with cap, longer ones are cut to size."""
    spans = F.filter(sentence_spans(text), lambda s: not_blank(cut(text, s)))
    return F.when(F.length(text) <= size, _whole(text)).otherwise(capped(text, spans, size) if cap else spans)


def whole_sentences(text: Column, size: int) -> Column:
    """The texts of windows_sentence without a cap, cut in one pass."""
    return F.when(F.length(text) <= size, F.array(text)).otherwise(F.filter(sentences(text), not_blank))


def windows_truncate(text: Column, size: int) -> Column:
    """Whole sentences up to size, or size characters of a longer first sentence."""
    lengths = F.transform(sentences(text), F.length)
    first = F.struct(F.lit(0).alias("at"), F.lit(0).alias("stop"))

    def step(s: Column, n: Column) -> Column:
        at = s["at"] + n
        return F.struct(at.alias("at"), F.when((at <= size) | (s["stop"] == 0), at).otherwise(s["stop"]).alias("stop"))

    stop = F.least(F.aggregate(lengths, first, step, lambda s: s["stop"]), F.lit(size))
    return F.when(F.length(text) <= size, _whole(text)).otherwise(F.array(_span(F.lit(0), stop)))


def chunk_bounds(lengths: list[int], size: int, sentences_back: int | None, share: float | None) -> list[tuple[int, int]]:
    """Windows of whole sentences, each as long as ``size`` characters allow, one sentence at least.

    The next window opens ``sentences_back`` sentences before the end of the
    last one, or at the first sentence past a step of ``1 - share`` windows.
    """
    ends = list(accumulate(lengths))
    starts = [0, *ends[:-1]]
    step = 0 if share is None else max(size - int(size * share), size // 4)

    def follows(i: int, j: int) -> int:
        """The first sentence of the window after that of sentences i to j - 1."""
        if share is None:
            return max(i + 1, j - (sentences_back or 0))
        return min(j, bisect_left(starts, starts[i] + step, i + 1))

    out, i = [], 0
    while ends:
        j = max(i + 1, bisect_right(ends, starts[i] + size, i))
        out.append((starts[i], ends[j - 1]))
        if j == len(ends):
            break
        i = follows(i, j)
    return out


def windows_sweep(text: Column, size: int, overlaps: list[tuple[int | None, float | None]]) -> Column:
    """Packed sentences under several overlaps (sentences back, or a share): an array of windows for each, in that order.

    The sentences are found once; only their lengths go to Python, once for all overlaps.
    """

    def pack(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for lengths in batches:
            yield pd.Series([[[{"a": a, "b": b} for a, b in chunk_bounds(list(x), size, *o)] for o in overlaps] for x in lengths])

    packed = F.pandas_udf(pack, T.ArrayType(SPANS))
    pack.__annotations__ = {}
    sets = packed(F.transform(sentences(text), F.length))
    kept = F.transform(sets, lambda spans: capped(text, F.filter(spans, lambda s: not_blank(cut(text, s))), size))
    return F.when(F.length(text) <= size, F.array(*[_whole(text)] * len(overlaps))).otherwise(kept)


def windows_chunk(text: Column, size: int, sentences_back: int | None = 4, share: float | None = None) -> Column:
    """Packed sentences; only the sentence lengths go to Python, the texts stay in the JVM."""
    return windows_sweep(text, size, [(sentences_back, share)])[0]


def leading(items: Column, test: Callable[[Column], Column], steps: int = 31) -> Column:
    """How many leading items pass a test that no item passes after one that fails, by bisection."""
    strides = F.array(*[F.lit(1 << k) for k in reversed(range(steps))])

    def step(xs: Column) -> Callable[[Column, Column], Column]:
        def longer(n: Column, stride: Column) -> Column:
            to = n + stride.cast("long")
            return F.when((to <= F.size(xs)) & F.coalesce(test(F.get(xs, F.least(to, F.size(xs).cast("long")).cast("int") - 1)), F.lit(False)), to).otherwise(n)

        return longer

    return let(items, lambda xs: F.aggregate(strides, F.lit(0).cast("long"), step(xs)).cast("int"))


def torn(windows: Column, spans: Column) -> Column:
    """How many spans no window holds whole.  Windows ascend in both ends, so the last that begins in time decides."""

    def held(ws: Column) -> Column:
        last = lambda s: F.get(ws, leading(ws, lambda w: w["a"] <= s["a"]) - 1)
        return F.size(F.filter(spans, lambda s: ~F.coalesce(last(s)["b"] >= s["b"], F.lit(False))))

    return let(windows, held)


def pseudonym(address: Column, salt: str = "") -> Column:
    local = F.regexp_extract(address, EMAIL, 1)
    digest = F.substring(F.sha2(F.concat(F.lit(salt), F.lower(address)), 256), 1, SUFFIX)
    return F.concat(local, F.lit(SEPARATOR), digest, F.lit("@" + DOMAIN))


def pseudonymise(text: Column, salt: str = "") -> Column:
    """The text with every address replaced; the same address gets the same pseudonym everywhere."""
    between = F.split(text, EMAIL, -1)
    found = F.transform(F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0)), lambda a: pseudonym(a, salt))
    pairs = F.zip_with(between, found, lambda x, y: F.concat(x, F.coalesce(y, F.lit(""))))
    return F.when(F.contains(text, F.lit("@")), F.array_join(pairs, "")).otherwise(text)


def addresses(text: Column) -> Column:
    """array<struct<plain, address, a, b>>: the text in pieces, each with the address that follows it and that address's offsets; the last has none."""
    pieces = F.zip_with(F.split(text, EMAIL, -1), F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0)), lambda x, y: F.struct(x.alias("plain"), y.alias("address")))
    width = lambda p: F.length(F.coalesce(p["address"], F.lit("")))

    def located(ps: Column) -> Column:
        ends = prefix_sums(F.transform(ps, lambda p: F.length(p["plain"]) + width(p)))
        return F.zip_with(ps, ends, lambda p, e: F.struct(p["plain"].alias("plain"), p["address"].alias("address"), (e - width(p)).alias("a"), e.alias("b")))

    return let(pieces, located)


def shifts(rewritten: Column) -> Column:
    """array<struct<at, shift>> of pieces with (address, new, b): from the end of each changed address on, offsets move by shift."""
    grown = F.transform(rewritten, lambda p: F.length(p["new"]) - F.length(F.coalesce(p["address"], F.lit(""))))
    return F.zip_with(rewritten, prefix_sums(grown), lambda p, s: F.struct(p["b"].alias("at"), s.alias("shift")))


def shifted(points: Column, offset: Column) -> Column:
    """An offset of the old text, outside all changed addresses, in the new one: the last shift at or before it."""
    return let(points, lambda ps: offset + F.coalesce(F.get(ps, leading(ps, lambda p: p["at"] <= offset) - 1)["shift"], F.lit(0)))


def pseudonymise_outside(text: Column, a: Column, b: Column, salt: str = "") -> Column:
    """struct<text, a, b>: addresses not wholly inside [a, b) replaced, the span moved along.

    A null span protects nothing and stays null.  Both ends move by what changed before a.
    """

    def renew(p: Column) -> Column:
        inside = F.coalesce((p["a"] >= a) & (p["b"] <= b), F.lit(False))
        new = F.when(p["address"].isNull(), "").when(inside, p["address"]).otherwise(pseudonym(p["address"], salt))
        return F.struct(p["plain"].alias("plain"), p["address"].alias("address"), p["b"].alias("b"), new.alias("new"))

    def done(ps: Column) -> Column:
        move = shifted(shifts(ps), a) - a
        return F.struct(F.array_join(F.transform(ps, lambda p: F.concat(p["plain"], p["new"])), "").alias("text"), (a + move).alias("a"), (b + move).alias("b"))

    same = F.struct(text.alias("text"), a.alias("a"), b.alias("b"))
    return F.when(F.contains(text, F.lit("@")), let(F.transform(addresses(text), renew), done)).otherwise(same)


def pseudonym_map(docs: DataFrame, text: str = "text", salt: str = "") -> DataFrame:
    """(address, replacement) of every address, as written, in the texts."""
    found = docs.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(EMAIL), F.lit(0))).alias("address")).distinct()
    return found.select("address", pseudonym(F.col("address"), salt).alias("replacement"))
