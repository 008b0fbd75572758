"""Places in a text: offsets are code points from 0, ends are exclusive, lines and columns count from 1, and only LF ends a line."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def prefix(text: Column, offset: Column) -> Column:
    return F.substring(text, F.lit(1), offset)


def line_of(text: Column, offset: Column) -> Column:
    before = prefix(text, offset)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def column_of(text: Column, offset: Column) -> Column:
    return F.length(F.substring_index(prefix(text, offset), "\n", -1)) + 1


def byte_of(text: Column, offset: Column) -> Column:
    """UTF-8 bytes before a code point."""
    return F.octet_length(prefix(text, offset))


def line_around(text: Column, start: Column, end: Column) -> Column:
    """The text between the line ends around a span."""
    after = F.substring(text, end + 1, F.length(text))
    return F.concat(F.substring_index(prefix(text, start), "\n", -1), F.substring(text, start + 1, end - start), F.substring_index(after, "\n", 1))


def window_around(text: Column, line: Column, radius: int) -> Column:
    """Up to ``radius`` lines on either side of a line, joined by LF."""
    lines = F.split(text, "\n")
    first = F.greatest(line - radius, F.lit(1))
    return F.array_join(F.slice(lines, first, F.least(line + radius, F.size(lines)) - first + 1), "\n")


def only_place(text: Column, excerpt: Column) -> Column:
    """Offset of an excerpt that occurs exactly once (occurrences do not overlap); otherwise null."""
    times = (F.length(text) - F.length(F.replace(text, excerpt, F.lit("")))) / F.length(excerpt)
    return F.when(times == 1, F.position(excerpt, text) - 1)


def region_at(regions: Column, offset: Column) -> Column:
    """Index from 0 of the region (start, end) that an offset lies in, or null. Regions ascend and do not overlap: a binary search
    as a fold over as many steps as the number of regions has binary digits."""
    steps = F.sequence(F.lit(1), F.greatest(F.length(F.bin(F.size(regions))), F.lit(1)))

    def go(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        right = F.get(regions, mid)["start"] <= offset
        return F.when(s["lo"] >= s["hi"], s).otherwise(F.when(right, F.struct((mid + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), mid.alias("hi"))))

    at = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(regions).alias("hi")), go, lambda s: s["lo"] - 1)
    return F.when((at >= 0) & (F.get(regions, at)["end"] > offset), at)
