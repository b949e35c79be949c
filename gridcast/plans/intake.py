"""Landed documents to stored series, each document taken once.

A ledger in the store holds a digest of every document taken in, usable or not. Digests and the rows
of their documents become visible in one publication, so a run that fails on the way has taken none of
its documents and a rerun takes all of them, while documents that land twice are known by their digest.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridcast.operators.dedupe import keep_first, keep_last
from gridcast.schemas import GENERATION_DOCUMENT, WEATHER_DOCUMENT
from gridcast.session import materialize
from gridcast.sources.documents import WEATHER_REQUIRED, parse_documents, share_series, weather_series
from gridcast.sources.store import Store

LEDGER = "documents"


@dataclass(frozen=True)
class Feed:
    """How the documents of one source become rows.

    `rows` makes rows of keys, datetime and values from parsed documents and keeps the columns it is
    told. `keep` says which reading of a key counts, over all documents ever taken: the first one or
    the last one, by the order the documents came in and by the place in the document.
    """

    name: str
    document: T.StructType
    required: str | Sequence[str]
    rows: Callable[[DataFrame, Sequence[str]], DataFrame]
    keep: str = "last"


GENERATION = Feed(
    "generation", GENERATION_DOCUMENT, "data", lambda docs, kept: share_series(docs, kept, place=True), keep="first"
)
PAST_WEATHER = Feed("past_weather", WEATHER_DOCUMENT, WEATHER_REQUIRED, weather_series)
FORECAST_WEATHER = Feed("forecast_weather", WEATHER_DOCUMENT, WEATHER_REQUIRED, weather_series)


def take_in(
    store: Store, feed: Feed, landed: DataFrame, token: str, text: str = "text", order: Sequence[str] = ("id",), keys: Sequence[str] = ()
) -> DataFrame:
    """Add what the landed documents say to the stored series `feed.name`.

    `landed` has the keys of the series, the text and the order columns. Returns the documents that were
    new, with `digest` and `reason` (NULL: usable). A token is published once: a call that is repeated
    after it went through changes nothing.
    """
    keys, order = list(keys), list(order)
    marks = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]
    digest = F.sha2(F.concat_ws("\x1f", F.lit(feed.name), *marks, F.coalesce(text, F.lit(""))), 256)
    documents = landed.select(*dict.fromkeys([*keys, *order, text])).withColumn("digest", digest).withColumn("feed", F.lit(feed.name))
    once = keep_first(documents, ["feed", "digest"], order)
    fresh = materialize(store.unseen(LEDGER, once, ["feed", "digest"]), "fresh")
    parsed = materialize(parse_documents(fresh, text, feed.document, feed.required), "parsed")
    named = [*keys, *(c for c in order if c not in keys)]
    rows = feed.rows(parsed.where("reason IS NULL"), named)
    rows = materialize(rows.where(F.col("datetime").isNotNull()), "readings")

    at = [*keys, "datetime"]
    place = ["_place"] if "_place" in rows.columns else []
    taken = parsed.select("feed", "digest", "reason")
    if not store.has(token):
        drop = [c for c in [*order, "_place"] if c not in keys]
        if feed.keep == "first":
            first = keep_first(rows, at, [*order, *place]).drop(*drop)
            change = store.appended(feed.name, store.unseen(feed.name, first, at, "datetime"), at, "datetime")
        else:
            last = keep_last(rows, at, [*order, *place]).drop(*drop)
            change = store.laid_over(feed.name, last, at, "datetime")
        store.publish(token, change, store.appended(LEDGER, taken, ["feed", "digest"]))
    return taken


def series(store: Store, feed: Feed) -> DataFrame | None:
    """The stored series of a feed, one row per key and time; None before anything was taken in."""
    return store.read(feed.name)
