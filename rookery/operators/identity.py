"""Follow lists, identity aliases, selections and their digests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rookery.functions.digest import counted_digest
from rookery.functions.text import SPACE_CHARACTERS
from rookery.operators.joins import split_join

MAX_KEY_LENGTH, MAX_ACTORS, MAX_TYPES = 256, 250, 64
INVALID_KEY = "invalid-selection"


def member_keys() -> Column:
    """All keys of one member: the canonical key and its aliases."""
    return F.array_distinct(F.concat(F.array("actor_key"), "legacy_keys"))


def membership(members: DataFrame) -> DataFrame:
    """(viewer_id, revision, key) -> canonical ``actor_key``.

    One row per alias, so that "equals the key or one of its aliases" becomes an
    equi-join. When two members claim a key, the last by key order wins.
    """
    return (
        members.select("viewer_id", "revision", "actor_key", F.explode(member_keys()).alias("key"))
        .groupBy("viewer_id", "revision", "key")
        .agg(F.max("actor_key").alias("actor_key"))
    )


def expand_keys(members: DataFrame) -> DataFrame:
    """Distinct keys per viewer and revision."""
    return members.select("viewer_id", "revision", F.explode(member_keys()).alias("key")).distinct()


def following_diff(current: DataFrame, remote: DataFrame) -> DataFrame:
    """(viewer_id, login, status): added, removed or kept, in one join."""
    both = current.select("viewer_id", "login", F.lit(True).alias("_old")).join(
        remote.select("viewer_id", "login", F.lit(True).alias("_new")),
        ["viewer_id", "login"],
        "full",
    )
    status = (
        F.when(F.col("_old").isNull(), F.lit("added"))
        .when(F.col("_new").isNull(), F.lit("removed"))
        .otherwise(F.lit("kept"))
    )
    return both.select("viewer_id", "login", status.alias("status"))


def diff_counts(diff: DataFrame) -> DataFrame:
    """Total now followed, added and removed per viewer."""
    return diff.groupBy("viewer_id").agg(
        F.count_if(F.col("status") != "removed").alias("total"),
        F.count_if(F.col("status") == "added").alias("added"),
        F.count_if(F.col("status") == "removed").alias("removed"),
    )


def additions(members: DataFrame, new: str, old: str) -> DataFrame:
    """Keys of the new revision that the old one did not hold."""
    keys = expand_keys(members)
    fresh = keys.filter(F.col("revision") == new).select("viewer_id", "key")
    known = keys.filter(F.col("revision") == old).select("viewer_id", "key")
    return fresh.join(known, ["viewer_id", "key"], "left_anti")


def check_selection(requests: DataFrame, members: DataFrame) -> DataFrame:
    """Requested keys -> authorised keys of their whole alias group, or rejected.

    ``requests``: (viewer_id, key). Result: (viewer_id, key, status).
    """
    keys = membership(members)
    asked = requests.select("viewer_id", "key").distinct()
    found = asked.join(keys.select("viewer_id", "key", "actor_key"), ["viewer_id", "key"], "left")
    rejected = found.filter(F.col("actor_key").isNull()).select(
        "viewer_id", "key", F.lit("rejected").alias("status")
    )
    chosen = found.select("viewer_id", "actor_key").filter(F.col("actor_key").isNotNull()).distinct()
    groups = (
        members.select("viewer_id", "actor_key", F.explode(member_keys()).alias("key"))
        .join(chosen, ["viewer_id", "actor_key"], "left_semi")
        .select("viewer_id", "key", F.lit("authorised").alias("status"))
        .distinct()
    )
    return groups.unionByName(rejected)


def canonicalise_selection(requests: DataFrame, members: DataFrame, complete: bool) -> DataFrame:
    """Logins and keys of a selection to canonical keys, first occurrence first.

    ``requests``: (viewer_id, value, pos). A value that resolves to nothing is
    kept only while the follow list is incomplete.
    """
    by_key = members.select("viewer_id", F.col("actor_key").alias("value"), "actor_key")
    by_login = members.select(
        "viewer_id", F.lower(F.btrim("login", F.lit(SPACE_CHARACTERS))).alias("folded"), F.col("actor_key").alias("login_key")
    )
    # First places before the joins: a value asked for very often is one row then.
    asked = requests.groupBy("viewer_id", "value").agg(F.min("pos").alias("pos"))
    resolved = (
        asked.withColumn("folded", F.lower(F.btrim("value", F.lit(SPACE_CHARACTERS))))
        .join(by_key, ["viewer_id", "value"], "left")
        .join(by_login, ["viewer_id", "folded"], "left")
        .withColumn("key", F.coalesce("actor_key", "login_key"))
    )
    if complete:
        resolved = resolved.filter(F.col("key").isNotNull())
    return (
        resolved.withColumn("key", F.coalesce("key", "value"))
        .groupBy("viewer_id", "key")
        .agg(F.min("pos").alias("first_pos"))
    )


def canonical_selection(values: Column, maximum: int) -> Column:
    """One selection array: bounded, distinct, sorted; never empty."""
    marked = F.transform(
        values,
        lambda v: F.when(F.length(v).between(1, MAX_KEY_LENGTH), v).otherwise(F.lit(INVALID_KEY)),
    )
    kept = F.slice(F.array_distinct(marked), 1, maximum)
    return F.array_sort(F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lit(INVALID_KEY))))


def discover_aliases(users: DataFrame) -> DataFrame:
    """(id, alias_key): every login ever seen with a numeric id, as alias keys.

    Long form: one row per alias, so a much-renamed account is no wide row.
    """
    return (
        users.filter(F.col("id").isNotNull())
        .select("id", F.concat(F.lit("legacy-atom-login:"), F.lower("login")).alias("alias_key"))
        .distinct()
    )


def membership_signature(members: DataFrame, by: Sequence[str]) -> DataFrame:
    """Order-free digest of a member set: ``count:xor`` of SHA-256 per member.

    Each member contributes the sorted JSON list of ``key NUL canonical``; the
    partial XORs merge, so no member list is gathered.
    """
    pairs = F.transform(
        F.array_sort(member_keys()), lambda k: F.concat(k, F.lit("\u0000"), F.col("actor_key"))
    )
    return members.groupBy(*by).agg(counted_digest(F.to_json(pairs)).alias("signature"))


def scope_keys(members: DataFrame) -> DataFrame:
    """Actor keys in the following scope of every viewer."""
    return expand_keys(members).select("viewer_id", "revision", "key")


def retention_fingerprint(scope: DataFrame, retention: DataFrame, by: Sequence[str]) -> DataFrame:
    """Digest of ``key:generation`` over a scope; an actor without a row counts as 0.

    Scopes have no size bound, so the digest is the mergeable one: same use
    (any change shows), no gathered list.
    """
    line = F.concat_ws(
        ":", "key", F.coalesce(F.col("retention_generation"), F.lit(0)).cast("string")
    )
    facts = retention.select(F.col("actor_key").alias("key"), "retention_generation")
    return (
        split_join(scope, facts, ["key"], "left").groupBy(*by).agg(counted_digest(line).alias("fingerprint"))
    )


def gap_floor(requests: DataFrame, scope: DataFrame, retention: DataFrame) -> DataFrame:
    """Highest compacted sequence of the scope above ``from_seq``; NULL means no gap."""
    floors = retention.select(F.col("actor_key").alias("key"), "compacted_through_seq")
    asked = ["viewer_id", "from_seq"]
    # The scope leads, so that the keys of one huge follow list can be split.
    scoped = split_join(scope.select("viewer_id", "key"), requests.select(*asked), ["viewer_id"])
    above = (
        split_join(scoped, floors, ["key"])
        .filter(F.col("compacted_through_seq") > F.col("from_seq"))
        .groupBy(*asked)
        .agg(F.max("compacted_through_seq").alias("gap_through_seq"))
    )
    return requests.select(*asked).distinct().join(above, asked, "left")


def resolve_scope(requests: DataFrame, members: DataFrame) -> DataFrame:
    """Actor-list requests to (viewer_id, scope_key, authorised, n_keys).

    ``requests``: (viewer_id, keys array, at most 250). One unknown key refuses
    the whole request. The scope key hashes the sorted distinct request.
    """
    asked = requests.select(
        "viewer_id", F.array_sort(F.array_distinct("keys")).alias("keys")
    )
    scope_key = F.sha2(
        F.to_json(F.struct(F.lit(1).alias("protocol"), F.col("keys").alias("actorKeys"))), 256
    )
    checked = check_selection(asked.select("viewer_id", F.explode("keys").alias("key")), members)
    verdict = checked.groupBy("viewer_id").agg(
        F.count_if(F.col("status") == "rejected").alias("_bad"),
        F.count_if(F.col("status") == "authorised").alias("_ok"),
    )
    return asked.join(verdict, "viewer_id", "left").select(
        "viewer_id",
        scope_key.alias("scope_key"),
        (F.coalesce("_bad", F.lit(0)) == 0).alias("authorised"),
        F.when(F.coalesce("_bad", F.lit(0)) == 0, F.coalesce("_ok", F.lit(0)))
        .otherwise(F.lit(0))
        .alias("n_keys"),
    )
