"""Highlight ranges and previews: half-open [start, end) positions in code points, as array expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from colloquy.functions.text import normalize_query

RANGE = "array<struct<start:int,end:int>>"


def _terms(terms: list[str]) -> Column:
    return F.array(*(F.lit(t) for t in terms)) if terms else F.array().cast("array<string>")


def first_ranges(text: Column, terms: list[str]) -> Column:
    """The first occurrence of each term."""
    plain = normalize_query(text)
    found = F.transform(_terms(terms), lambda t: F.struct((F.position(t, plain) - 1).alias("start"), (F.position(t, plain) - 1 + F.length(t)).alias("end")))
    return F.filter(found, lambda r: r["start"] >= 0).cast(RANGE)


def count_matches(text: Column, terms: list[str]) -> Column:
    """Occurrences of all terms; those of one term do not overlap."""
    plain = normalize_query(text)
    total = F.lit(0).cast("long")
    for t in terms:
        total = total + F.floor((F.length(plain) - F.length(F.replace(plain, F.lit(t), F.lit("")))) / len(t))
    return total


def all_ranges(text: Column, terms: list[str]) -> Column:
    """Every occurrence of each term, term by term: the pieces between occurrences give the positions."""
    plain = normalize_query(text)
    out = F.array().cast(RANGE)
    for t in terms:
        pieces, size = F.split(plain, re.escape(t)), len(t)

        def step(done: Column, piece: Column) -> Column:
            start = done["at"] + F.length(piece)
            return F.struct((start + size).alias("at"), F.concat(done["found"], F.array(F.struct(start.alias("start"), (start + size).alias("end")))).alias("found"))

        begin = F.struct(F.lit(0).alias("at"), F.array().cast(RANGE).alias("found"))
        hits = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))
        out = F.concat(out, F.aggregate(hits, begin, step, lambda done: done["found"]))
    return out


def merge_ranges(ranges: Column) -> Column:
    """Ranges that overlap or touch become one, in order."""
    def step(done: Column, r: Column) -> Column:
        last = F.element_at(done, -1)
        joins = (F.size(done) > 0) & (r["start"] <= F.when(F.size(done) > 0, last["end"]))
        merged = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(F.when(F.size(done) > 0, last["start"]).alias("start"), F.greatest(F.when(F.size(done) > 0, last["end"]), r["end"]).alias("end"))))
        return F.when(joins, merged.cast(RANGE)).otherwise(F.concat(done, F.array(r)).cast(RANGE))

    return F.aggregate(F.array_sort(ranges), F.array().cast(RANGE), step)


def valid_ranges(ranges: Column, text: Column) -> Column:
    return F.filter(ranges, lambda r: (r["start"] >= 0) & (r["start"] < r["end"]) & (r["end"] <= F.length(text)))


def marked_runs(text: Column, ranges: Column) -> Column:
    """The text cut into (text, is_match) runs by merged valid ranges."""
    own = merge_ranges(valid_ranges(ranges, text))
    cuts = F.concat(F.array(F.lit(0)), F.flatten(F.transform(own, lambda r: F.array(r["start"], r["end"]))), F.array(F.length(text)))
    pieces = F.transform(F.sequence(F.lit(1), F.size(cuts) - 1), lambda k: F.struct(F.substring(text, F.element_at(cuts, k) + 1, F.element_at(cuts, k + 1) - F.element_at(cuts, k)).alias("text"), (k % 2 == 0).alias("is_match")))
    return F.filter(pieces, lambda p: p["text"] != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def snippet(text: Column, terms: list[str], radius: int = 170) -> Column:
    """A window around the earliest term, grown to whole words, with an ellipsis where it is cut; the head if no term occurs."""
    size = F.length(text)
    word_at_end = lambda part: F.length(F.substring_index(F.regexp_replace(part, r"(?U)\s", " "), " ", -1))
    word_at_start = lambda part: F.length(F.regexp_extract(part, r"(?U)\A\S*", 0))

    def around(center: Column) -> Column:
        left, right = F.greatest(center - radius, F.lit(0)), F.least(center + radius, size)
        start = left - word_at_end(F.substring(text, F.lit(1), left))
        end = right + word_at_start(F.substr(text, right + 1))
        return let(F.struct(start.alias("s"), end.alias("e")), lambda w: F.concat(F.when(w["s"] > 0, "…").otherwise(""), F.regexp_replace(F.substring(text, w["s"] + 1, w["e"] - w["s"]), r"(?U)\A\s+|\s+\z", ""), F.when(w["e"] < size, "…").otherwise("")))

    def earliest(plain: Column) -> Column:
        return F.array_min(F.array(*(F.nullif(F.position(F.lit(t), plain), F.lit(0)) for t in terms))) - 1 if terms else F.lit(None).cast("int")

    head_end = 2 * radius + word_at_start(F.substr(text, F.lit(2 * radius + 1)))
    head = F.concat(F.regexp_replace(F.substring(text, F.lit(1), head_end), r"(?U)\s+\z", ""), F.lit("…"))
    found = let(let(normalize_query(text), earliest), lambda c: F.when(c.isNotNull(), around(c)).when(size <= 2 * radius, text).otherwise(head))
    return F.when(F.coalesce(size, F.lit(0)) == 0, "").otherwise(found)
