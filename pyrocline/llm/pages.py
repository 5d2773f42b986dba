"""Main text of web pages by consensus host paths.

1. Each page scores its containers, widens the best one to the article around it
   and votes for the generalised tag-class paths of that article and the next best.
2. Votes are summed by host and path, in the tasks first and then in a shuffle;
   each host's winning path is one row.
3. Every page is read again and its text taken from the containers at its
   host's winning path. A page whose own article isn't nearly all there falls back
   on its own article.

Skew: a host with a third of all pages has one row for each path and task in
the vote, and the winning paths are sent to the pages, not pages to their host.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyrocline.llm.common import small_enough
from pyrocline.llm.markup import article_around, container_scores, parse, share_inside, text_under
from pyrocline.storage import settle

#: Containers that a page votes for, and the whole of its best vote.
BALLOT, VOTE = 3, 1000
#: Where less than this share of a page's own article is at the host's path, the path isn't taken.
LEAST_SHARE = 0.95
#: A host's winning path is copied this often where it has to be joined by shuffling.
SALT = 16
_HELD = 50_000


def host_of(url: str = "url") -> Column:
    """Lower-cased host of an absolute URL; empty for anything else, null included."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def ballot(source: str) -> dict[str, int]:
    """Votes of one page: VOTE for the path of its article, for the next best containers' paths their share of the best one's score."""
    page = parse(source)
    scores: dict[str, float] = {}
    found = container_scores(page)
    for node, value in found.items():
        scores[page.path[node]] = scores.get(page.path[node], 0.0) + value
    best = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:BALLOT]
    if not best:
        return {}
    first = min((n for n in found if page.path[n] == best[0][0]), key=lambda n: (-found[n], n))
    votes = {path: round(VOTE * value / best[0][1]) for path, value in best[1:]}
    return votes | {page.path[article_around(page, first)]: VOTE}


def main_text(source: str, path: str | None) -> str:
    """Text at the containers with ``path`` if the page's own article is nearly all there, else of that article, else of the whole page."""
    page = parse(source)
    scores = container_scores(page)
    best = min(scores, key=lambda n: (-scores[n], n), default=None)
    own = None if best is None else article_around(page, best)
    at_path = [n for n, p in enumerate(page.path) if n and p == path and not page.dropped[n]] if path is not None else []
    if at_path and share_inside(page, at_path, 0 if own is None else own) >= LEAST_SHARE and (found := text_under(page, at_path)):
        return found
    return text_under(page, None if own is None else [own])


def winning_paths(pages: DataFrame) -> DataFrame:
    """``host, path``: the path with most votes of each host's pages; of several the first by code point."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, str], int] = {}

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array([k[0] for k in sums], pa.string()), pa.array([k[1] for k in sums], pa.string()), pa.array(list(sums.values()), pa.int64())], names=["host", "path", "votes"])

        for batch in batches:
            for host, source in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                for path, votes in ballot(source).items():
                    sums[host, path] = sums.get((host, path), 0) + votes
            if len(sums) > _HELD:
                yield out()
                sums = {}
        yield out()

    cast = pages.select(host_of().alias("host"), F.col("html")).where("html IS NOT NULL").mapInArrow(each, "host string, path string, votes long")
    votes = cast.groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    return votes.groupBy("host").agg(F.min_by("path", F.struct(-F.col("votes"), F.col("path"))).alias("path"))


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text`` for each row of ``pages``.

    Null and empty html give an empty text; a null or odd url puts the page
    under the empty host, which votes like any other. Null ids are kept;
    repeated rows give repeated rows; an empty table gives an empty result. Only
    ``page_id, url, html`` are read, so other columns may have any name.
    """
    won = settle(winning_paths(pages), "paths")
    rows = pages.select("page_id", "url", "html", host_of().alias("host"))
    if small_enough(won):
        joined = rows.join(F.broadcast(won), "host", "left")
    else:
        copies = won.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALT)).cast("int")).join(copies, ["host", "salt"], "left")

    @F.pandas_udf("string")
    def texts(sources: pd.Series, paths: pd.Series) -> pd.Series:
        return pd.Series([main_text(s, p) if s else "" for s, p in zip(sources, paths, strict=True)], dtype=object)

    return joined.select("page_id", "url", texts("html", "path").alias("text"))
