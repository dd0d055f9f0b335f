"""Names of apertures, titles and versions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _unlimited(policy: Column, window: Column) -> Column:
    return (F.coalesce(policy, F.lit("full")).isin("full", "")) | (F.coalesce(window, F.lit(0)) == 0)


def aperture_label(policy: Column, window: Column, overlap: Column, forced: Column) -> Column:
    """What a detector read through, for readers; a flag marks an imposed aperture."""
    mark = F.when(forced, F.lit(" ⚑")).otherwise("")
    over = F.when(F.coalesce(overlap, F.lit(0)) != 0, F.concat(F.lit("/"), overlap.cast("string"))).otherwise("")
    chunks = F.concat(F.lit("chunks "), window.cast("string"), over)
    other = F.concat(policy, F.lit(" "), window.cast("string"))
    name = F.when(_unlimited(policy, window), F.lit("whole document")).when(policy == "chunk", chunks).otherwise(other)
    return F.concat(name, mark)


def aperture_tag(policy: Column, window: Column, overlap: Column, forced: Column) -> Column:
    """The same for file names."""
    over = F.when((policy == "chunk") & (F.coalesce(overlap, F.lit(0)) != 0), F.concat(F.lit("o"), overlap.cast("string"))).otherwise("")
    name = F.when(_unlimited(policy, window), F.lit("full")).otherwise(F.concat(policy, window.cast("string"), over))
    return F.concat(name, F.when(forced, F.lit("f")).otherwise(""))


def title_of(registered: Column, display: Column, detector: Column) -> Column:
    return F.coalesce(F.nullif(registered, F.lit("")), F.nullif(display, F.lit("")), detector, F.lit("?"))


def version_adds(title: Column, version: Column) -> Column:
    """Whether a version says something that the title does not."""
    plain = lambda x: F.translate(F.lower(x), "- .", "")
    return F.coalesce(version != "", F.lit(False)) & (F.instr(plain(title), plain(version)) == 0)
