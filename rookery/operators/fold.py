"""Compare-and-set fold over a mutation log, for entities and users of any size.

A mutation applies when its base version is the version of its entity, unless its
attempt took effect before, on whichever entity of the user. A user with no more rows than
a block holds is settled by one pass over them. For users of more the log is cut into blocks
of bounded size by entity and arrival, and the two questions are told apart:

* Versions: rows are cut by entity and arrival. A block that its entity begins in an
  earlier one is reduced to the map "version on entry -> version on exit"; the maps are
  chained by pointer doubling, and all blocks are then folded at once from their known
  entry version.
* Attempts: only those that stand in several rows, or took effect earlier, matter. From
  the outcomes so far follows which rows repeat an attempt; these are folded again as
  rows without effect, until nothing changes. Each round settles at least the next row
  of every user, so the end is what one pass in order of arrival would give.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rookery import schemas
from rookery.operators.joins import split_join
from rookery.session import materialise

#: Rows of one block.
BLOCK_ROWS = 100_000

_ROW = ["entity_id", "arrival", "mutation_id", "attempt_id", "base_version", "kind"]
_EDGE = "entity_id long, part long, v long, exit_v long, exit_deleted boolean"
_NODE = ["entity_id", "part", "v"]
_RESULT = pa.schema(
    [
        ("entity_id", pa.int64()),
        ("arrival", pa.int64()),
        ("mutation_id", pa.string()),
        ("attempt_id", pa.string()),
        ("outcome", pa.string()),
        ("version", pa.int64()),
        ("deleted", pa.bool_()),
    ]
)
_EDGES = pa.schema(
    [
        ("entity_id", pa.int64()),
        ("part", pa.int64()),
        ("v", pa.int64()),
        ("exit_v", pa.int64()),
        ("exit_deleted", pa.bool_()),
    ]
)


def applies(version: int, deleted: bool, base: int, kind: str) -> bool:
    """Compare: the base is the version, there is no tombstone, and a delete has an object."""
    return not deleted and base == version and not (kind == "delete" and version == 0)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of blocks in order, each block led by its entry version if it has one.
    Attempts that took effect in the block are known there."""
    block, version, deleted = None, 0, False
    took: set[str] = set()
    for batch in batches:
        out: list[tuple] = []
        columns = (c.to_pylist() for c in batch.columns)
        for entity, part, arrival, mutation, attempt, base, kind, flag in zip(*columns, strict=True):
            if (entity, part) != block:
                block, version, deleted, took = (entity, part), 0, False, set()
            if kind == "entry":
                version, deleted = base, flag
                continue
            if flag or attempt in took:
                outcome = "already-applied"
            elif applies(version, deleted, base, kind):
                outcome, version, deleted = "applied", version + 1, kind == "delete"
                if attempt is not None:
                    took.add(attempt)
            else:
                outcome = "conflict"
            out.append((entity, arrival, mutation, attempt, outcome, version, deleted))
        yield _table(out, _RESULT)


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows of users in order, each user led by receipts and known entities."""
    user = None
    entities: dict[int, tuple[int, bool]] = {}
    took: set[str] = set()
    last: dict[int, str] = {}
    answers: Counter[str] = Counter()  # how many entities answer for an attempt
    for batch in batches:
        out: list[tuple] = []
        columns = (c.to_pylist() for c in batch.columns)
        for owner, entity, arrival, mutation, attempt, base, kind, flag in zip(*columns, strict=True):
            if owner != user:
                user, entities, took, last, answers = owner, {}, set(), {}, Counter()
            if kind == "entry":
                entities[entity] = (base, flag)
                if attempt is not None:
                    answers[last.pop(entity, None)] -= 1
                    last[entity] = attempt
                    answers[attempt] += 1
                continue
            if kind == "receipt":
                took.add(attempt)
                continue
            version, deleted = entities.get(entity, (0, False))
            if attempt is not None and (attempt in took or answers[attempt] > 0):
                outcome = "already-applied"
            elif applies(version, deleted, base, kind):
                outcome, version, deleted = "applied", version + 1, kind == "delete"
                entities[entity] = (version, deleted)
                answers[last.pop(entity, None)] -= 1
                if attempt is not None:
                    took.add(attempt)
            else:
                outcome = "conflict"
            out.append((entity, arrival, mutation, attempt, outcome, version, deleted))
        yield _table(out, _RESULT)


def _maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exit version for every entry version that some row of a block is based on.

    Rows come backwards: one based on b sends b to wherever the rows behind it send b + 1.
    Versions without a row pass through unchanged and are not listed.
    """
    block: tuple | None = None
    exits: dict[int, tuple[int, bool]] = {}

    def done() -> pa.RecordBatch:
        return _table([(*block, v, *to) for v, to in exits.items()] if block else [], _EDGES)

    for batch in batches:
        for entity, part, base, kind in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (entity, part) != block:
                yield done()
                block, exits = (entity, part), {}
            if kind != "delete":
                exits[base] = exits.get(base + 1, (base + 1, False))
            elif base > 0:
                exits[base] = (base + 1, True)
    yield done()


def _next_nodes(edges: DataFrame) -> DataFrame:
    """(node) -> next block that holds a row based on the exit version of the node."""
    exits = (
        edges.filter(~F.col("exit_deleted"))
        .select("entity_id", F.col("exit_v").alias("at"), "part", F.lit(False).alias("stop"))
        .distinct()
    )
    stops = edges.select("entity_id", F.col("v").alias("at"), "part", F.lit(True).alias("stop"))
    # Per (entity, version) there are at most two rows per block.
    ahead = Window.partitionBy("entity_id", "at").orderBy("part").rangeBetween(1, Window.unboundedFollowing)
    found = (
        exits.unionByName(stops)
        .withColumn("next_part", F.min(F.when(F.col("stop"), F.col("part"))).over(ahead))
        .filter(~F.col("stop") & F.col("next_part").isNotNull())
        .select("entity_id", "part", F.col("at").alias("exit_v"), "next_part")
    )
    return (
        edges.filter(~F.col("exit_deleted"))
        .join(found, ["entity_id", "part", "exit_v"])
        .select(*_NODE, "next_part", F.col("exit_v").alias("next_v"))
    )


def _follow(nodes: DataFrame, jump: DataFrame) -> DataFrame:
    """The nodes reached from ``nodes`` by one jump."""
    return nodes.join(jump, _NODE).select(
        "entity_id", F.col("next_part").alias("part"), F.col("next_v").alias("v")
    )


def _path(edges: DataFrame) -> DataFrame:
    """All nodes on the way from the start node (part -1) of each entity."""
    jumps = [materialise(_next_nodes(edges), "jump")]
    while not jumps[-1].isEmpty():
        last = jumps[-1].alias("a")
        then = jumps[-1].alias("b")
        joined = last.join(
            then,
            (F.col("a.entity_id") == F.col("b.entity_id"))
            & (F.col("a.next_part") == F.col("b.part"))
            & (F.col("a.next_v") == F.col("b.v")),
        ).select("a.entity_id", "a.part", "a.v", "b.next_part", "b.next_v")
        jumps.append(materialise(joined, "jump"))
    reached = edges.filter(F.col("part") == -1).select(*_NODE)
    for jump in reversed(jumps[:-1]):
        reached = materialise(reached.unionByName(_follow(reached, jump)), "path")
    return reached


def _cut(log: DataFrame, by: str, block_rows: int) -> DataFrame:
    """The log with ``part``, the number of its block, written once."""
    ordered = log.repartitionByRange(by, "arrival").sortWithinPartitions(by, "arrival")
    numbered = materialise(ordered.withColumn("_place", F.monotonically_increasing_id()), "blocks")
    # The partition's number, and the row's number within it in steps of a block.
    part = F.expr(f"shiftright(_place, 33) * {1 << 30} + (_place & {(1 << 33) - 1}) div {block_rows}")
    return numbered.withColumn("part", part).drop("_place")


def _entries(rows: DataFrame, state: DataFrame) -> DataFrame:
    """``entity_id, part, entry_v, entry_deleted``: where the blocks of ``rows`` begin, if
    not at nothing. ``rows`` has ``flag``: rows without effect."""
    spans = rows.groupBy("entity_id").agg(F.min("part").alias("first"), F.max("part").alias("last"))
    spans = materialise(
        spans.join(state.select("entity_id", "version", "deleted"), "entity_id", "left").select(
            "entity_id", "first", "last",
            F.coalesce("version", F.lit(0).cast("long")).alias("v"),
            F.coalesce("deleted", F.lit(False)).alias("deleted"),
        ),
        "spans",
    )
    known = spans.filter("v > 0").select(
        "entity_id", F.col("first").alias("part"), F.col("v").alias("entry_v"), F.col("deleted").alias("entry_deleted")
    )
    wide = spans.filter("first < last")
    if wide.isEmpty():
        return known
    long = split_join(rows, wide.select("entity_id"), ["entity_id"])
    maps = (
        long.filter(~F.col("flag"))
        .select("entity_id", "part", "arrival", "base_version", "kind")
        .repartition("entity_id", "part")
        .sortWithinPartitions("entity_id", "part", F.desc("arrival"))
        .select("entity_id", "part", "base_version", "kind")
        .mapInArrow(_maps, _EDGE)
    )
    starts = wide.select(
        "entity_id", F.lit(-1).cast("long").alias("part"), "v", F.col("v").alias("exit_v"), F.col("deleted").alias("exit_deleted")
    )
    edges = materialise(maps.unionByName(starts), "edges")
    exits = split_join(edges, _path(edges), _NODE).select(
        "entity_id", "part", F.struct("exit_v", "exit_deleted").alias("exit")
    )
    before = (
        Window.partitionBy("entity_id")  # one row per block of the entity
        .orderBy("part")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    chained = (
        long.select("entity_id", "part")
        .distinct()
        .join(exits, ["entity_id", "part"], "full")
        .withColumn("entry", F.last("exit", ignorenulls=True).over(before))
        .filter((F.col("part") >= 0) & (F.col("entry.exit_v") > 0))
        .select("entity_id", "part", F.col("entry.exit_v").alias("entry_v"), F.col("entry.exit_deleted").alias("entry_deleted"))
    )
    return known.join(wide, "entity_id", "left_anti").unionByName(chained)


def _fold(rows: DataFrame, state: DataFrame, repeats: DataFrame | None) -> DataFrame:
    """Outcomes by versions alone, ``repeats`` (entity_id, arrival) being without effect."""
    if repeats is None:
        flagged = rows.withColumn("flag", F.lit(False))
    else:
        marked = split_join(rows, repeats.withColumn("flag", F.lit(True)), ["entity_id", "arrival"], "left")
        flagged = marked.withColumn("flag", F.coalesce("flag", F.lit(False)))
    none = F.lit(None).cast("string")
    leads = _entries(flagged, state).select(
        "entity_id", "part", F.lit(-1).cast("long").alias("arrival"), none.alias("mutation_id"), none.alias("attempt_id"),
        F.col("entry_v").alias("base_version"), F.lit("entry").alias("kind"), F.col("entry_deleted").alias("flag"),
    )
    return (
        flagged.select("entity_id", "part", *_ROW[1:], "flag")
        .unionByName(leads)
        .repartition("entity_id", "part")
        .sortWithinPartitions("entity_id", "part", "arrival")
        .mapInArrow(_folded, schemas.MUTATION_RESULT)
    )


def _owner(df: DataFrame) -> Column:
    """Whose attempts these are: the user's, or the entity's where there is no user."""
    return F.col("user_id" if "user_id" in df.columns else "entity_id").cast("string").alias("owner")


_ATTEMPT = ["owner", "attempt_id"]


def _repeats(asked: DataFrame, results: DataFrame, earlier: DataFrame, last: DataFrame) -> DataFrame:
    """(entity_id, arrival) of the ``asked`` rows whose attempt took effect before them: in
    the outcomes, in a receipt, or as the last one on an entity row that no mutation has
    moved by then."""
    here = F.struct("arrival", "entity_id")
    applied = results.filter("outcome = 'applied'").select("entity_id", "arrival")
    took = split_join(asked, applied, ["entity_id", "arrival"]).groupBy(*_ATTEMPT).agg(F.min(here).alias("at"))
    moved = applied.groupBy("entity_id").agg(F.min("arrival").alias("moved"))
    on_row = last.join(moved, "entity_id", "left").groupBy(*_ATTEMPT).agg(
        F.max(F.coalesce("moved", F.lit((1 << 63) - 1).cast("long"))).alias("until")
    )
    found = split_join(asked, took, _ATTEMPT, "left")
    found = split_join(found, earlier.withColumn("stored", F.lit(True)), _ATTEMPT, "left")
    found = split_join(found, on_row, _ATTEMPT, "left")
    return found.filter(
        F.coalesce(F.col("at") < here, F.lit(False))
        | F.coalesce("stored", F.lit(False))
        | F.coalesce(F.col("arrival") <= F.col("until"), F.lit(False))
    ).select("entity_id", "arrival")


def apply_mutations(
    log: DataFrame,
    state: DataFrame | None = None,
    receipts: DataFrame | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Outcome of every mutation: applied / already-applied / conflict.

    Mutations take effect in the order of ``arrival``, distinct per entity, not negative
    and comparable over the entities of a user. ``log`` may have ``user_id``: then an
    attempt counts for all entities of the user, else for its entity alone; a NULL attempt
    is never a repeat. An entity belongs to one user. ``state``: (entity_id, version, deleted), and for attempts whose
    receipt is gone ``last_attempt_id`` (with ``user_id`` like the log): it answers for its
    attempt until another mutation moves the row. ``receipts``: (user_id or entity_id,
    attempt_id) applied earlier.
    """
    spark = log.sparkSession
    if state is None:
        state = spark.createDataFrame([], "entity_id long, version long, deleted boolean")
    if receipts is None:
        receipts = spark.createDataFrame([], "entity_id long, attempt_id string")
    none = F.lit(None).cast("string")
    attempt = F.col("last_attempt_id") if "last_attempt_id" in state.columns else none
    named = "user_id" in state.columns or "user_id" not in log.columns
    known = state.select(
        (_owner(state) if named else none).alias("owner"), "entity_id", "version", "deleted", attempt.alias("attempt_id")
    )
    earlier = receipts.select(_owner(receipts), "attempt_id").distinct()
    rows = materialise(log.select(_owner(log), *_ROW).filter("owner is not null"), "log")
    users = rows.groupBy("owner").agg((F.count("*") > block_rows).alias("wide"))
    users = materialise(users, "users")
    wide = users.filter("wide").select("owner")
    if wide.isEmpty():
        return _one_pass(rows, known, earlier)
    narrow = split_join(rows, users.filter("not wide").select("owner"), ["owner"])
    hot = _in_rounds(split_join(rows, wide, ["owner"]), known, earlier, block_rows)
    return _one_pass(narrow, known, earlier).unionByName(hot)


def _one_pass(rows: DataFrame, known: DataFrame, earlier: DataFrame) -> DataFrame:
    """Outcomes of users with no more rows than a block."""
    none, zero = F.lit(None).cast("string"), F.lit(0).cast("long")
    here = rows.select("owner", "entity_id").distinct()
    facts = known.drop("owner").join(here, "entity_id").select("owner", "entity_id", "version", "deleted", "attempt_id")
    # Entities that only answer for their last attempt, and receipts: those that are asked.
    asked = rows.select(*_ATTEMPT).distinct()
    others = known.join(asked, _ATTEMPT).select(*facts.columns)
    leads = facts.unionByName(others).distinct().select(
        "owner", "entity_id", F.lit(-1).cast("long").alias("arrival"), none.alias("mutation_id"), "attempt_id",
        F.col("version").alias("base_version"), F.lit("entry").alias("kind"), F.col("deleted").alias("flag"),
    )
    used = earlier.join(asked, _ATTEMPT).select(
        "owner", zero.alias("entity_id"), F.lit(-1).cast("long").alias("arrival"), none.alias("mutation_id"), "attempt_id",
        zero.alias("base_version"), F.lit("receipt").alias("kind"), F.lit(False).alias("flag"),
    )
    return (
        rows.select("owner", *_ROW, F.lit(False).alias("flag"))
        .unionByName(leads)
        .unionByName(used)
        .repartition("owner")
        .sortWithinPartitions("owner", "arrival")
        .mapInArrow(_settled, schemas.MUTATION_RESULT)
    )


def _in_rounds(rows: DataFrame, known: DataFrame, earlier: DataFrame, block_rows: int) -> DataFrame:
    """Outcomes of users with more rows than a block."""
    rows, state = _cut(rows, "entity_id", block_rows), known
    last = known.filter("attempt_id is not null").select(*_ATTEMPT, "entity_id")
    attempts = rows.filter("attempt_id is not null").groupBy(*_ATTEMPT).agg(F.count("*").alias("n"))
    stored = earlier.unionByName(last.select(*_ATTEMPT)).distinct().withColumn("known", F.lit(True))
    several = attempts.join(stored, _ATTEMPT, "left").filter((F.col("n") > 1) | F.col("known")).select(*_ATTEMPT)
    asked = materialise(split_join(rows, several, _ATTEMPT).select(*_ATTEMPT, "entity_id", "arrival"), "asked")
    first = materialise(_fold(rows, state, None), "folded")
    if asked.isEmpty():
        return first
    touched = materialise(asked.select("entity_id").distinct(), "touched")
    again = split_join(rows, touched, ["entity_id"])
    results, before = split_join(first, touched, ["entity_id"]), None
    mark = F.struct(F.count("*"), F.bit_xor(F.xxhash64("entity_id", "arrival")), F.bit_xor(F.xxhash64("arrival", "entity_id")))
    while True:
        repeats = materialise(_repeats(asked, results, earlier, last), "repeats")
        now = repeats.select(mark).first()[0]
        if now == before:
            break
        before = now
        results = materialise(_fold(again, state, repeats), "folded")
    return first.join(touched, "entity_id", "left_anti").unionByName(results)
