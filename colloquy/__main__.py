"""Jobs: ``python -m colloquy validate|build|ingest``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from colloquy.operators import validate
from colloquy.sources import artifacts, episodes, pages
from colloquy.streaming import ingest


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="colloquy")
    jobs = parser.add_subparsers(dest="job", required=True)
    for name, options in {"validate": (), "build": ("--index",), "ingest": ("--archive", "--cache", "--host")}.items():
        job = jobs.add_parser(name)
        for option in ("--content", *options):
            job.add_argument(option, required=True)
    got = parser.parse_args(args)
    spark = SparkSession.builder.appName(f"colloquy-{got.job}").getOrCreate()
    if got.job == "ingest":
        found = pages.discovered(pages.crawl(spark, pages.fetch_text, got.archive))
        known = episodes.read(spark, got.content).select("source_url")
        todo = found.join(known, "source_url", "left_anti").selectExpr("source_url as url")
        cached = pages.with_snapshots(todo, *pages.read_cache(spark, got.cache)).persist()
        fetched = pages.fetched(cached.where("html is null"), pages.fetch_text)
        bodies = cached.where("html is not null").unionByName(fetched).withColumnRenamed("url", "source_url")
        batch = found.join(bodies, "source_url", "left").persist()
        ingest.add_batch(batch, got.content, got.cache, got.host).show()
        batch.unpersist(), cached.unpersist()
        return
    stored = episodes.read(spark, got.content)
    validate.require_valid(validate.episode_violations(stored))
    validate.require_valid(validate.violations(episodes.segments(stored)))
    if got.job == "build":
        artifacts.build(spark, stored, got.index).show()


if __name__ == "__main__":
    main()
