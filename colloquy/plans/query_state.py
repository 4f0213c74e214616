"""The query as a user states it, and its address form."""

from __future__ import annotations

from dataclasses import dataclass
from urllib.parse import parse_qs, urlencode, urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

MODES, KINDS = ("hybrid", "keyword", "semantic"), ("all", "question", "answer", "intro", "other")


@dataclass(frozen=True)
class QueryState:
    query: str = ""
    mode: str = "hybrid"
    year: str = ""
    type: str = "all"
    episode: str = ""
    segment: str = ""

    @classmethod
    def from_url(cls, url: str) -> QueryState:
        """Unknown modes and types fall back to the defaults."""
        got = {k: v[0] for k, v in parse_qs(urlsplit(url).query, keep_blank_values=True).items()}
        mode, kind = got.get("mode", ""), got.get("type", "")
        return cls(got.get("q", ""), mode if mode in MODES else "hybrid", got.get("year", ""), kind if kind in KINDS else "all", got.get("e", ""), got.get("s", ""))

    def to_url(self) -> str:
        """Defaults are left out."""
        pairs = [("q", self.query), ("mode", self.mode if self.mode != "hybrid" else ""), ("year", self.year), ("type", self.type if self.type != "all" else ""), ("e", self.episode), ("s", self.segment)]
        kept = [(k, v) for k, v in pairs if v]
        return f"?{urlencode(kept)}" if kept else ""


def parsed(url: Column) -> dict[str, Column]:
    """The fields of a column of addresses."""
    part = lambda k: F.coalesce(F.try_url_decode(F.parse_url(url, F.lit("QUERY"), F.lit(k))), F.lit(""))
    known = lambda c, allowed, default: F.when(c.isin(list(allowed)), c).otherwise(default)
    return {"query": part("q"), "mode": known(part("mode"), MODES, "hybrid"), "year": part("year"), "type": known(part("type"), KINDS, "all"), "episode": part("e"), "segment": part("s")}
