"""Captions and questions on one time axis: interval joins, best matches and forward as-of lookups.

Cues (episode_id, start_sec, end_sec, text) and questions (episode_id, question_id, ...) meet by episode and slice of time, so
a long episode is many groups, and no question meets cues outside its own slices. Rows without an episode or a start meet nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colloquy.functions.text import clean_text, content_words, spoken_words
from colloquy.operators.order import stored

AHEAD, NAME_WEIGHT, LATEST, PACE, ACCEPT, OPENING = 100, 0.8, 0.8, 150, 0.45, 8
LEAST_SECONDS, WORDS_A_SECOND, GRACE = 4.0, 3.3, 12.0
#: Letters of a piece of a token, at least, and how many of a row's rarest words find its first texts.
PIECE, FIRST = 64, 3
#: Seconds of one slice of an episode.
SLICE = 600


def flat(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")


def meet(spans: DataFrame, cues: DataFrame, first: Column, last: Column, width: int = SLICE) -> DataFrame:
    """The spans with the cues of their episode that start from ``first`` to ``last``, both included (null: no end).

    An equi-join on the slices that a span touches, as far as its episode has cues; a cue lies in one slice, so no pair comes
    twice. Columns of the two sides have unlike names but ``episode_id``; the cues have ``at``, their start.
    """
    sliced = cues.where("episode_id is not null and at is not null").withColumn("_slice", F.floor(F.col("at") / width))
    ends = sliced.groupBy("episode_id").agg(F.min("at").alias("_least"), F.max("at").alias("_most"))
    placed = spans.withColumn("_first", first.cast("double")).withColumn("_last", F.coalesce(last.cast("double"), F.lit(float("inf")))).join(ends, "episode_id")
    low, high = F.floor(F.greatest("_first", "_least") / width), F.floor(F.least("_last", "_most") / width)
    placed = placed.withColumn("_slice", F.explode(F.when(low <= high, F.sequence(low, high)))).drop("_least", "_most")
    return placed.join(sliced, ["episode_id", "_slice"]).where((F.col("at") >= F.col("_first")) & (F.col("at") <= F.col("_last"))).drop("_slice", "_first", "_last")


def text_between(cues: DataFrame, spans: DataFrame, width: int = SLICE) -> DataFrame:
    """The spans (episode_id, span_id, from_sec, until_sec) with ``text``: their cues' texts in order."""
    heard = cues.select("episode_id", F.col("start_sec").alias("at"), "text")
    inside = meet(spans, heard, F.col("from_sec"), F.col("until_sec"), width).where(F.col("until_sec").isNull() | (F.col("at") < F.col("until_sec")))
    gathered = F.array_sort(F.collect_list(F.struct("at", "text")))
    return inside.groupBy("episode_id", "span_id").agg(clean_text(F.array_join(F.transform(gathered, lambda x: x["text"]), " ")).alias("text"))


def look_ahead(cues: DataFrame, seconds: int = AHEAD) -> DataFrame:
    """Cues with ``ahead``: the texts of this cue and those that start less than ``seconds`` later (start_sec whole or not)."""
    later = Window.partitionBy("episode_id").orderBy(F.col("start_sec").cast("double")).rangeBetween(0, seconds)
    listed = F.collect_list(F.struct("start_sec", "text")).over(later)
    near = F.filter(listed, lambda x: x["start_sec"] < F.col("start_sec") + seconds)
    return cues.withColumn("_near", near).withColumn("ahead", F.array_join(F.transform("_near", lambda x: x["text"]), " ")).drop("_near")


def name_score(names: Column, heard: Column) -> Column:
    """The best share of a name's words that were heard: alike, with the same first four letters, or within a quarter of edits.

    ``names``: an array of each name's content words; ``heard``: the caption's content words.
    """

    def like(word: Column, caption: Column) -> Column:
        edits = F.greatest(F.lit(1), F.floor(F.length(word) / 4)).cast("int")
        # with a threshold the search for edits stops there; names of over 11 letters are rare
        near = F.when(edits == 1, F.levenshtein(word, caption, 1) >= 0).when(edits == 2, F.levenshtein(word, caption, 2) >= 0).otherwise(F.levenshtein(word, caption) <= edits)
        return (caption == word) | caption.startswith(F.substring(word, 1, 4)) | ((F.length(word) >= 5) & near)

    def share(words: Column) -> Column:
        return F.when(F.size(words) > 0, F.size(F.filter(words, lambda w: F.exists(heard, lambda c: like(w, c)))) / F.size(words)).otherwise(0.0)

    return F.coalesce(F.array_max(F.transform(names, share)), F.lit(0.0))


def overlap(words: Column, flat: Column) -> Column:
    """The share of the distinct content words that the flat text has."""
    own = F.array_distinct(words)
    return F.when(F.size(own) > 0, F.size(F.filter(own, lambda w: F.contains(flat, w))) / F.size(own)).otherwise(0.0)


def _token(token: Column) -> Column:
    """A token as a key: itself, or the digest of a long one."""
    return F.when(F.length(token) > PIECE, F.sha2(token, 256)).otherwise(token)


def containing(words: DataFrame, tokens: DataFrame) -> DataFrame:
    """token (a key, see ``_token``), w: the words that each distinct token has in it.

    ``words``: w, distinct, of two letters or digits or more; ``tokens``: token. Tokens are cut into pieces that overlap by the
    longest word, so the work grows with their length; words meet pieces by their first three letters (words of two: by these)
    and are looked for there.
    """
    lengths = words.agg(F.coalesce(F.max(F.length("w")), F.lit(1)).alias("most"), F.coalesce(F.min(F.length("w")), F.lit(3)).alias("least")).head()
    longest, starting = lengths.most, (2, 3) if lengths.least < 3 else (3,)
    size = max(PIECE, 2 * longest)
    cut = rf"(?s)(?=(.{{1,{size}}})).{{1,{size - longest + 1}}}"
    distinct = tokens.select(_token(F.col("token")).alias("token"), F.col("token").alias("whole")).groupBy("token").agg(F.min("whole").alias("whole"))
    pieces = distinct.select("token", F.explode(F.array_distinct(F.regexp_extract_all("whole", F.lit(cut), F.lit(1)))).alias("piece"))
    starts = F.array_distinct(F.concat(*(F.regexp_extract_all("piece", F.lit(f"(?=(.{{{n}}}))."), F.lit(1)) for n in starting)))
    sought = pieces.select("token", "piece", F.explode(starts).alias("start"))
    met = sought.join(words.select("w", F.substring("w", 1, 3).alias("start")), "start").where(F.contains("piece", F.col("w")))
    return met.select("token", "w").distinct()


def best_overlaps(asked: DataFrame, texts: DataFrame, key: str, *keys: str) -> DataFrame:
    """key, keys, share: for each asked row the text with the largest share of its words in it; of equal ones the smallest keys.

    ``asked``: key, words (distinct, of letters and digits, two or more); ``texts``: keys, flat. Rows whose words no text has drop out.

    A text with c of a row's m words has at least one of any m - c + 1 of them. So a row first meets the texts of its FIRST
    rarest words, which gives it a count c that the best text reaches; then only the texts of its m - c + 1 rarest words can
    reach c, ties included. Frequent words are thus counted in pairs that rare ones have found, and hardly ever make any.
    """
    words = asked.select(key, F.explode("words").alias("w"))
    heard = texts.select(*keys, F.explode(F.array_distinct(F.split("flat", " "))).alias("token")).where(F.length("token") > 1)
    known = containing(words.select("w").distinct(), heard.select("token"))
    has = stored(heard.select(*keys, _token(F.col("token")).alias("token")).join(known, "token").select("w", *keys).distinct())
    rare = words.join(has.groupBy("w").agg(F.count("*").alias("texts")), "w")
    order = Window.partitionBy(key).orderBy("texts", "w")  # a row's own words
    ranked = stored(rare.withColumn("place", F.row_number().over(order)).withColumn("of_all", F.count("*").over(Window.partitionBy(key))).select(key, "w", "place", "of_all"))

    def counted(chosen: DataFrame) -> DataFrame:
        pairs = chosen.join(has, "w").select(key, *keys).distinct()
        return pairs.join(ranked.select(key, "w"), key).join(has, ["w", *keys]).groupBy(key, *keys).agg(F.count("*").alias("n"))

    reached = counted(ranked.where(F.col("place") <= FIRST)).groupBy(key).agg(F.max("n").alias("reached"))
    chosen = ranked.join(reached, key).where(F.col("place") <= F.col("of_all") - F.col("reached") + 1)
    first = F.min_by(F.struct(*keys, "n"), F.struct((-F.col("n")).alias("most"), *keys))
    best = counted(chosen.select(key, "w")).groupBy(key).agg(first.alias("b"))
    of = asked.select(key, F.size("words").alias("of"))
    return best.join(of, key).select(key, *(f"b.{k}" for k in keys), (F.col("b.n") / F.col("of")).alias("share"))


def candidates(questions: DataFrame, cues: DataFrame) -> DataFrame:
    """episode_id, question_id, start_sec, end_sec, score: the cues that may introduce each question.

    ``questions``: episode_id, question_id, question_text, speaker_names, from_sec, until_sec. Words and flat texts are made
    below the join, once a question and once a cue. Cues without a name or an opening word are dropped before any
    look-ahead text is scored.
    """
    asked = questions.select("episode_id", "question_id", "from_sec", F.coalesce(F.col("until_sec").cast("double"), F.lit(float("inf"))).alias("until_sec"), content_words(F.col("question_text")).alias("words"), F.transform("speaker_names", content_words).alias("names"))
    heard = look_ahead(cues).select("episode_id", F.col("start_sec").alias("at"), "start_sec", "end_sec", flat(F.col("text")).alias("flat"), content_words(F.col("text")).alias("heard"), flat(F.col("ahead")).alias("ahead"))
    met = meet(asked, heard, F.col("from_sec"), F.col("until_sec")).where(F.col("at") < F.col("until_sec"))
    # an array of one is made once; a plain column would be computed anew in each filter that names it
    rows = met.select("*", F.explode(F.array(name_score(F.col("names"), F.col("heard")))).alias("named"))
    opens = F.exists(F.slice("words", 1, OPENING), lambda w: F.contains(F.col("flat"), w))
    first = F.get(F.filter("words", lambda w: F.contains(F.col("ahead"), w)), F.lit(0))
    late = F.coalesce(F.least(F.lit(LATEST), (F.position(first, F.col("ahead")) - 1) / PACE), F.lit(LATEST))
    score = overlap(F.col("words"), F.col("ahead")) + F.col("named") * NAME_WEIGHT - late
    return rows.where((F.col("named") > 0) | opens).select("episode_id", "question_id", "start_sec", "end_sec", F.explode(F.array(score)).alias("score"))


def align(questions: DataFrame, cues: DataFrame) -> DataFrame:
    """question_id, start_sec, answer_start_sec, score: the cue that introduces each question best (see ``candidates``)."""
    rows = candidates(questions, cues)
    best = F.max_by(F.struct(F.floor("start_sec").alias("start_sec"), F.floor("end_sec").alias("answer_start_sec"), "score"), F.struct("score", (-F.col("start_sec")).alias("early")))
    return rows.groupBy("question_id").agg(best.alias("b")).where(F.col("b.score") >= ACCEPT).select("question_id", "b.start_sec", "b.answer_start_sec", "b.score")


def _of_later_slices(rows: DataFrame) -> DataFrame:
    """episode_id, _slice, _next: the least ``at`` of the episode's later slices. Only one row a slice is ordered by episode."""
    own = rows.groupBy("episode_id", "_slice").agg(F.min("at").alias("_own"))
    later = Window.partitionBy("episode_id").orderBy(F.desc("_slice")).rowsBetween(Window.unboundedPreceding, -1)
    return own.select("episode_id", "_slice", F.last("_own", ignorenulls=True).over(later).alias("_next"))


def with_next(cues: DataFrame, width: int = SLICE) -> DataFrame:
    """Cues (episode_id, at, ends, text) with ``after_sec``: where the next cue of the episode starts (order: at, ends, text)."""
    sliced = cues.withColumn("_slice", F.floor(F.col("at") / width))
    order = Window.partitionBy("episode_id", "_slice").orderBy("at", "ends", "text")
    follow = sliced.withColumn("_lead", F.lead("at").over(order)).join(_of_later_slices(sliced), ["episode_id", "_slice"])
    return follow.withColumn("after_sec", F.coalesce("_lead", "_next")).drop("_slice", "_lead", "_next")


def first_from(asked: DataFrame, cues: DataFrame, width: int = SLICE) -> DataFrame:
    """The asked rows (episode_id, earliest, ...) with ``later``: the first cue's start (``at``) from ``earliest`` on, or null.

    A forward as-of: both sides in one order a slice, and the next slice that has cues where the own one has none left.
    """
    fields = [c for c in asked.columns if c != "episode_id"]
    marks = cues.where("episode_id is not null and at is not null").select("episode_id", F.col("at").cast("double").alias("time"), F.col("at").cast("double").alias("at"), F.lit(None).cast(asked.select(F.struct(*fields)).schema[0].dataType).alias("q"))
    rows = marks.unionByName(asked.select("episode_id", F.col("earliest").cast("double").alias("time"), F.lit(None).cast("double").alias("at"), F.struct(*fields).alias("q"))).withColumn("_slice", F.floor(F.col("time") / width))
    down = Window.partitionBy("episode_id", "_slice").orderBy(F.desc("time"), F.col("at").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = rows.withColumn("_own", F.last("at", ignorenulls=True).over(down)).where("q is not null")
    met = found.join(_of_later_slices(rows), ["episode_id", "_slice"], "left")
    return met.select("episode_id", "q.*", F.coalesce("_own", "_next").alias("later"))


def answer_starts(questions: DataFrame, cues: DataFrame, width: int = SLICE) -> DataFrame:
    """question_id, answer_sec: the cue after the one in which the question's last "?" is heard, else the first plausible cue.

    ``questions``: episode_id, question_id, question_text, start_sec, next_sec (null: none). Without a plausible cue the
    answer is taken to start when the question can have been read.
    """
    marks = lambda t: F.length(t) - F.length(F.replace(t, F.lit("?"), F.lit("")))
    plausible = F.col("start_sec") + F.greatest(F.lit(LEAST_SECONDS), spoken_words(F.col("question_text")) / WORDS_A_SECOND)
    asked = questions.select("episode_id", "question_id", F.col("start_sec").cast("double").alias("asked"), F.col("next_sec").cast("double").alias("next_sec"), plausible.alias("earliest"), F.greatest(F.lit(1), marks(F.col("question_text"))).alias("expected"))
    heard = cues.where("episode_id is not null and start_sec is not null").select("episode_id", F.col("start_sec").cast("double").alias("at"), F.col("end_sec").cast("double").alias("ends"), "text")
    met = meet(asked, with_next(heard, width), F.col("asked"), F.col("earliest") + GRACE, width).where("next_sec is null or at < next_sec")
    running = Window.partitionBy("question_id").orderBy("at", "ends", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = met.withColumn("marks", marks(F.col("text"))).withColumn("seen", F.sum("marks").over(running))
    ended = met.where((F.col("marks") > 0) & (F.col("seen") >= F.col("expected")) & (F.col("ends") >= F.col("earliest")))
    spoken = ended.groupBy("question_id").agg(F.min(F.struct("at", F.coalesce("after_sec", "ends").alias("answer"))).alias("s"))
    later = first_from(asked.select("episode_id", "question_id", "earliest"), heard, width)
    every = later.groupBy("question_id").agg(F.min("later").alias("later"), F.max("earliest").alias("earliest"))
    return every.join(spoken, "question_id", "left").select("question_id", F.floor(F.coalesce("s.answer", "later", "earliest")).alias("answer_sec"))
