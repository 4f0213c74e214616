"""The search engine over built artifacts: open, search, suggest, browse an episode, recover from empty results."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions.text import embedding_tokens, query_terms, rewrite_last_term
from colloquy.operators import facets, fusion, keyword, present, semantic
from colloquy.plans.query_state import QueryState
from colloquy.sources.artifacts import query_words


class Engine:
    """Tables are lazy; the shards that a query names are the partitions that it reads."""

    def __init__(self, segments: DataFrame, index: DataFrame, prefixes: DataFrame, dictionary: DataFrame, spellings: DataFrame | Callable[[], DataFrame] | None = None, vectors: DataFrame | None = None, table: DataFrame | None = None, episodes: DataFrame | None = None):
        self.spark = segments.sparkSession
        self.segments, self.index, self.prefixes, self.dictionary, self.spellings = segments, index, prefixes, dictionary, spellings
        self.vectors, self.table, self.episodes = vectors, table, episodes

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Engine:
        """An engine over what ``artifacts.write`` or ``artifacts.build`` left below ``path``."""
        read = lambda name: spark.read.parquet(f"{path}/{name}")
        try:
            episodes = read("episodes")
        except AnalysisException as e:  # written without episodes
            if "PATH_NOT_FOUND" not in str(e):
                raise
            episodes = None
        return cls(read("docs"), read("keyword"), read("prefixes"), read("autocomplete"), read("spellings"), read("vectors"), query_words(read("vocab")), episodes)

    def terms(self, query: str) -> list[str]:
        return list(self.spark.range(1).select(query_terms(F.lit(query)).alias("t")).head().t)

    def embed(self, query: str) -> list[float] | None:
        """The query's pooled vector; None if no word of it is known."""
        if self.table is None:
            return None
        tokens = self.spark.range(1).select("id", embedding_tokens(F.lit(query)).alias("tokens"))
        row = semantic.pool(tokens, "id", self.table).head()
        return list(row.vec) if row else None

    def keyword(self, state: QueryState) -> DataFrame:
        rows = keyword.rank(self.index, self.segments, self.terms(state.query), state.type, state.episode, [state.year] if state.year else None, spellings=self.spellings)
        return fusion.ranked(rows, "first_rank", F.desc("score"), F.desc(F.coalesce("start_sec", F.lit(0))), "segment_id")

    def semantic(self, state: QueryState) -> DataFrame | None:
        vector = self.embed(state.query)
        if vector is None or self.vectors is None:
            return None
        rows = semantic.rank(self.vectors, vector, keyword.CANDIDATES, state.type, state.episode, [state.year] if state.year else None)
        return fusion.ranked(rows, "second_rank", F.desc("score"), "segment_id")

    def search_progressive(self, state: QueryState) -> Iterator[tuple[str, DataFrame]]:
        """("partial", keyword results) first where vectors are still to come, then ("final", results)."""
        terms = self.terms(state.query)
        if state.mode == "keyword" or not terms:
            yield "final", self._results(self.keyword(state).withColumnRenamed("first_rank", "rank"), terms)
            return
        if state.mode == "hybrid":
            yield "partial", self._results(self.keyword(state).withColumnRenamed("first_rank", "rank"), terms)
        yield "final", self.search(state)

    def search(self, state: QueryState) -> DataFrame:
        """At most 200 results with the columns of ``present.RESPONSE``, in every mode."""
        terms = self.terms(state.query)
        near = self.semantic(state) if terms and state.mode != "keyword" else None
        if state.mode == "semantic" and terms:
            if near is None:
                return self._results(self.keyword(state).where(F.lit(False)).withColumnRenamed("first_rank", "rank"), terms)
            return self._results(near.withColumnRenamed("second_rank", "rank").withColumn("found_by", F.lit("semantic")), terms)
        if near is None:
            return self._results(self.keyword(state).withColumnRenamed("first_rank", "rank"), terms)
        exact = self.keyword(state)
        fused = fusion.fuse(exact, near, "segment_id", keyword.RESULTS)
        fused = fused.join(near.select("segment_id", "char_offset"), "segment_id", "left")
        how = F.when(F.col("first_rank").isNull(), "semantic").when(F.col("second_rank").isNull(), "keyword").otherwise("both")
        ranked = fusion.ranked(fused.withColumn("found_by", how), "rank", F.desc("score"), F.col("first_rank").asc_nulls_last(), F.col("second_rank").asc_nulls_last())
        return self._results(ranked, terms)

    def _results(self, ranked: DataFrame, terms: list[str]) -> DataFrame:
        return present.results(ranked.where(F.col("rank") <= keyword.RESULTS), self.segments, self.episodes, terms)

    def episode(self, episode_id: str) -> DataFrame:
        return self.segments.where(F.col("episode_id") == episode_id).orderBy("ord" if "ord" in self.segments.columns else "segment_id")

    def suggest(self, query: str) -> DataFrame:
        """Suggestions for the query's last word: short ones from the stored prefixes, longer ones from the dictionary."""
        terms = self.terms(query)
        last = terms[-1] if terms else ""
        return keyword.suggest(self.prefixes if len(last) <= keyword.PREFIX else self.dictionary, last)

    def did_you_mean(self, query: str) -> str | None:
        best = self.suggest(query).where("position = 1").head()
        return self.spark.range(1).select(rewrite_last_term(F.lit(query), F.lit(best.term)).alias("q")).head().q if best else None

    def recover(self, state: QueryState) -> list[QueryState]:
        """What to try when nothing was found: a near spelling, the hybrid mode, each filter removed."""
        near = self.did_you_mean(state.query)
        out = [replace(state, query=near)] if near else []
        if state.mode == "keyword":
            out.append(replace(state, mode="hybrid"))
        out += [replace(state, **{name: default}) for name, default in (("year", ""), ("episode", ""), ("type", "all")) if getattr(state, name) != default]
        return out

    def facets(self) -> dict[str, DataFrame]:
        counts = facets.episode_counts(self.segments)
        return {"shards": facets.shards(counts), "episodes": facets.episodes(counts), "totals": facets.totals(counts)}
