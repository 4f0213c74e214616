"""Near spellings through deletion neighbourhoods: equi-joins on keys in place of comparing every pair of words.

If two words are within k edits, then their first PREFIX letters have a text in common that leaves out at most k letters of each.
So a word's keys are its first letters with up to k of them left out: at most 1 + PREFIX + PREFIX (PREFIX - 1) / 2 of them,
however long the word. Words meet by key; only pairs that pass the exact distance leave the join.

How many edits count follows from the asked term (``close_words``): none for terms of up to three characters, one for those of
up to seven, two beyond. So words of fewer than three characters have no keys, and those that no term of two edits can meet have
only the keys of one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions.text import close_words

PREFIX = 10
#: Terms from this length on are sought, from LONG on by two edits.
SHORT, LONG = 4, 8


def one_less(text: Column) -> Column:
    """The text without each of its characters in turn."""
    return F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.concat(F.substr(text, F.lit(1), i - 1), F.substr(text, i + 1)))


def keys(word: Column, edits: Column) -> Column:
    """(key, less): the distinct keys of a word, and the fewest letters left out for each; ``edits`` is 0 to 2."""
    head = F.substring(word, 1, PREFIX)
    first = one_less(head)
    made = lambda texts, n: F.transform(texts, lambda k: F.struct(k.alias("key"), F.lit(n).alias("less")))
    whole = F.array(F.struct(head.alias("key"), F.lit(0).alias("less")))
    second = F.array_distinct(F.flatten(F.transform(F.array_distinct(first), one_less)))
    return F.when(edits >= 2, F.concat(whole, made(F.array_distinct(first), 1), made(second, 2))).when(edits == 1, F.concat(whole, made(F.array_distinct(first), 1))).otherwise(whole)


def edits_of(term: Column) -> Column:
    """How many edits an asked term allows."""
    return F.when(F.length(term) < SHORT, 0).when(F.length(term) < LONG, 1).otherwise(2)


def index(words: DataFrame) -> DataFrame:
    """The rows (word, ...) once for each key: ``key`` and ``less``. ``words`` are distinct by all their columns."""
    # a term of one edit has SHORT to LONG - 1 characters, one of two edits LONG or more; its near words differ by as many
    reach = F.when(F.length("word") < LONG - 2, 1).otherwise(2)
    rows = words.where(F.length("word") >= SHORT - 1)
    return rows.select(*words.columns, F.explode(keys(F.col("word"), reach)).alias("k")).select(*words.columns, "k.key", "k.less")


def asked(terms: DataFrame) -> DataFrame:
    """The rows (term, ...) once for each key that their near words can have: ``key`` and ``edits``."""
    edits = edits_of(F.col("term"))
    rows = terms.where(F.length("term") >= SHORT)
    return rows.select(*terms.columns, edits.alias("edits"), F.explode(keys(F.col("term"), edits)).alias("k")).select(*terms.columns, "edits", F.col("k.key").alias("key"))


def near(terms: DataFrame, spellings: DataFrame, *shared: str) -> DataFrame:
    """The distinct pairs of ``terms`` (term, ...) with near words of an ``index``, within equal ``shared`` columns.

    The join is on keys (and ``shared``); lengths and then the exact distance cut pairs inside it. Pairs that meet by several
    keys are made one after that.
    """
    own = [c for c in terms.columns if c not in shared]
    other = [c for c in spellings.columns if c not in (*shared, "key", "less")]
    within = (F.col("less") <= F.col("edits")) & (F.abs(F.length("word") - F.length("term")) <= F.col("edits"))
    met = asked(terms).join(spellings, ["key", *shared]).where(within & close_words(F.col("term"), F.col("word")))
    return met.select(*shared, *own, *other).distinct()
