"""Raw feed documents to activity rows, and body clean-up jobs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rookery.functions import text as X
from rookery.functions import values as V


def extract_entries(raw: DataFrame, ingest_ms: int) -> DataFrame:
    """One row per titled entry of every document.

    ``raw``: (login, feed_xml). ``bad_date`` marks a present but unreadable
    publication time; such rows belong to a rejects table.
    """
    xml = F.col("feed_xml")
    # Everything taken from the document is taken before the explode, so that the
    # document itself does not travel with each of its entries.
    found = raw.select(
        X.normalize_login(F.col("login")).alias("login"),
        X.author_id(xml).alias("feed_id"),
        X.entries(xml).alias("entries"),
    ).select("login", "feed_id", F.explode("entries").alias("entry"))
    e = F.col("entry")
    tags = found.select(
        "login",
        "feed_id",
        X.tag_value(e, "title").alias("raw_title"),
        X.entry_link(e).alias("link"),
        F.coalesce(X.tag_value(e, "published"), X.tag_value(e, "updated")).alias("raw_date"),
        X.tag_value(X.tag_value(e, "author"), "name").alias("author"),
        X.tag_value(e, "content").alias("raw_content"),
        X.tag_value(e, "id").alias("raw_id"),
    ).filter(F.col("raw_title") != "")
    decoded = tags.withColumn("title", X.decode_entities(F.col("raw_title"))).withColumn(
        "content",
        F.when(F.col("raw_content") != "", X.decode_entities(F.col("raw_content"))),
    )
    at = F.try_to_timestamp(F.when(F.col("raw_date") != "", F.col("raw_date")))
    entry_id = X.decode_entities(F.coalesce("raw_id", "link", "title"))
    plain = X.collapse_whitespace(F.regexp_replace("content", "<[^>]*>", " "))
    return decoded.select(
        entry_id.alias("activity_id"),
        F.coalesce("author", "login").alias("actor_name"),
        "login",
        "feed_id",
        "title",
        "link",
        X.repo_of(F.col("link"), F.col("title")).alias("repo"),
        X.type_of(entry_id).alias("type"),
        F.coalesce(V.epoch_ms(at), F.lit(ingest_ms)).alias("published_ms"),
        F.nullif(F.substring(plain, 1, X.SUMMARY_LENGTH), F.lit("")).alias("summary"),
        "content",
        ((F.col("raw_date") != "") & at.isNull()).alias("bad_date"),
    )


def rejects(entries: DataFrame) -> DataFrame:
    """Entries with a publication time that cannot be read."""
    return entries.filter("bad_date")


def to_activities(
    entries: DataFrame, users: DataFrame, source: str, ingest_ms: int, *carried: str
) -> DataFrame:
    """Extracted entries as storable activities with their canonical actor key.

    ``carried``: further columns of the entries that stay with their activity.
    """
    stored = users.select("login", F.col("id").alias("stored_id"))
    known = F.coalesce("feed_id", "stored_id")
    return (
        entries.filter(~F.coalesce("bad_date", F.lit(False)))
        .join(stored, "login", "left")
        .select(
            "activity_id",
            F.lit(source).alias("source"),
            F.col("login").alias("actor_login"),
            X.actor_key(F.col("feed_id"), F.col("stored_id"), F.col("login")).alias("actor_key"),
            known.alias("actor_id"),
            "type",
            "title",
            "link",
            "repo",
            "summary",
            "content",
            F.lit(False).alias("hidden"),
            "published_ms",
            F.lit(ingest_ms).cast("long").alias("created_ms"),
            *carried,
        )
    )


@dataclass(frozen=True)
class Cleaner:
    """A body cleaner and its version; ``clean`` maps a Column to a Column."""

    version: str
    clean: Callable[[Column], Column]


HTML_CLEANER = Cleaner("text-clean-v1", X.clean_html)


def refresh_bodies(bodies: DataFrame, cleaner: Cleaner = HTML_CLEANER) -> DataFrame:
    """Bodies of another version, cleaned again; current bodies are not returned."""
    return (
        bodies.filter(~F.col("version").eqNullSafe(F.lit(cleaner.version)))
        .withColumn("content", cleaner.clean(F.col("content")))
        .withColumn("version", F.lit(cleaner.version))
    )
