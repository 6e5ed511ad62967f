"""The compare-and-set fold: literals, and blocks against the serial pass."""

import random

import pytest

from rookery.operators import fold, state
from tests.conftest import rows

LOG = "entity_id long, arrival long, mutation_id string, attempt_id string, base_version long, kind string, name string, value string"


def log_of(spark, steps):
    data = [(e, t, f"m{t}", a, b, k, f"n{t}", f"v{t}") for t, (e, a, b, k) in enumerate(steps)]
    return spark.createDataFrame(data, LOG)


def test_conflicts_retries_and_tombstones(spark):
    log = log_of(
        spark,
        [
            (1, "a", 1, "put"),  # nothing there yet
            (1, "b", 0, "put"),
            (1, "b", 0, "put"),  # retry of an applied attempt
            (1, "c", 0, "put"),  # stale
            (1, "d", 1, "delete"),
            (1, "e", 2, "put"),  # a tombstone is not revived
            (1, "b", 2, "put"),  # still a retry
            (2, "f", 0, "delete"),  # nothing to delete
        ],
    )
    results = fold.apply_mutations(log)
    assert rows(results, "arrival", "outcome", "version", "deleted") == [
        (0, "conflict", 0, False),
        (1, "applied", 1, False),
        (2, "already-applied", 1, False),
        (3, "conflict", 1, False),
        (4, "applied", 2, True),
        (5, "conflict", 2, True),
        (6, "already-applied", 2, True),
        (7, "conflict", 0, False),
    ]
    now = state.entity_state(results, log)
    assert rows(now) == [(1, 2, True, "n1", "v1")]


def test_known_state_and_receipts_lead(spark):
    log = log_of(spark, [(1, "x", 3, "put"), (1, "y", 3, "put"), (1, "z", 4, "put")])
    known = spark.createDataFrame([(1, 3, False)], "entity_id long, version long, deleted boolean")
    used = spark.createDataFrame([(1, "x")], "entity_id long, attempt_id string")
    results = fold.apply_mutations(log, known, used)
    assert rows(results, "outcome", "version") == [("already-applied", 3), ("applied", 4), ("applied", 5)]


def in_order(rows, known=(), used=()):
    """One pass over all rows in order of arrival: ``(arrival, outcome, version, deleted)``."""
    version = {e: [v, d] for e, v, d, *_ in known}
    last = {e: (u, a) for e, _, _, u, a in known if a}
    receipts, out = set(used), []
    for user, entity, arrival, attempt, base, kind in rows:
        now = version.setdefault(entity, [0, False])
        if attempt and ((user, attempt) in receipts or (user, attempt) in last.values()):
            outcome = "already-applied"
        elif fold.applies(*now, base, kind):
            outcome, now[0], now[1] = "applied", now[0] + 1, kind == "delete"
            receipts.add((user, attempt))
            last.pop(entity, None)
        else:
            outcome = "conflict"
        out.append((arrival, outcome, *now))
    return out


@pytest.mark.parametrize(("seed", "block_rows", "length"), [(1, 100_000, 1500), (2, 25, 90), (3, 500, 700)])
def test_fold_equals_one_pass_in_order(spark, seed, block_rows, length):
    """One hot entity and one hot user, who re-send attempts to the same entity or to
    another one, under the old or a newer base; known rows, receipts, null attempts."""
    rng, steps, version = random.Random(seed), [], {}
    known = [(3, 2, False, 3, "old3"), (103, 1, False, 3, "a7"), (4, 1, True, 4, None)]
    used = [(4, "a5"), (1, "a9")]
    for t in range(length):
        user = 1 if rng.random() < 0.7 else rng.randint(2, 5)
        entity = user + 100 * (rng.random() < 0.2)
        at = version.get(entity, 0)
        base = at if rng.random() < 0.4 else max(0, at + rng.randint(-4, 2))
        attempt = f"a{t}" if rng.random() < 0.95 else None
        if steps and rng.random() < 0.2:
            old = rng.choice(steps[-40:])
            user, attempt, base = old[0], old[3], old[4]
            entity = old[1] if rng.random() < 0.7 else user + 100
            if rng.random() < 0.5:
                base = version.get(entity, 0)
        if rng.random() < 0.01:
            user, entity, attempt = 3, rng.choice([3, 103]), rng.choice(["old3", "a7"])
        kind = "delete" if rng.random() < 0.002 else "put"
        if base == version.get(entity, 0):
            version[entity] = base + 1
        steps.append((user, entity, t, attempt, base, kind))
    log = spark.createDataFrame(
        [(u, e, t, f"m{t}", a, b, k) for u, e, t, a, b, k in steps],
        "user_id long, entity_id long, arrival long, mutation_id string, attempt_id string, base_version long, kind string",
    ).repartition(7)
    state_rows = spark.createDataFrame(
        known, "entity_id long, version long, deleted boolean, user_id long, last_attempt_id string"
    )
    receipts = spark.createDataFrame(used, "user_id long, attempt_id string")
    got = fold.apply_mutations(log, state_rows, receipts, block_rows)
    want = in_order(steps, known, used)
    assert rows(got, "arrival", "outcome", "version", "deleted") == sorted(want, key=repr)
    assert {r[1] for r in want} == {"applied", "already-applied", "conflict"}


def test_last_attempt_answers_until_the_row_moves(spark):
    """After compaction the entity row still knows its last attempt."""
    schema = "user_id long, entity_id long, arrival long, mutation_id string, attempt_id string, base_version long, kind string"
    known = spark.createDataFrame(
        [(1, 3, False, 9, "last"), (2, 1, False, 9, "other")],
        "entity_id long, version long, deleted boolean, user_id long, last_attempt_id string",
    )
    log = [
        (9, 1, 0, "m0", "last", 2, "put"),
        (9, 5, 1, "m1", "other", 0, "put"),  # took effect on another entity of the user
        (8, 6, 2, "m2", "other", 0, "put"),  # another user's attempt of that name
        (9, 1, 3, "m3", "new", 3, "put"),
        (9, 1, 4, "m4", "last", 2, "put"),  # the row has moved
        (9, 1, 5, "m5", "new", 3, "put"),
    ]
    got = fold.apply_mutations(spark.createDataFrame(log, schema), known)
    assert rows(got, "arrival", "outcome", "version") == [
        (0, "already-applied", 3), (1, "already-applied", 0), (2, "applied", 1),
        (3, "applied", 4), (4, "conflict", 4), (5, "already-applied", 4),
    ]


def test_users_of_few_rows_take_one_pass_wherever_the_log_is_cut(spark, monkeypatch):
    """Rounds are for users with more rows than a block holds, not for those that lie on the
    border of two blocks or tasks. Of two rows that answer for an attempt one may move."""

    def refused(*_):
        raise AssertionError("in rounds")

    monkeypatch.setattr(fold, "_in_rounds", refused)
    known = [(e, 1, False, e % 3, f"old{e % 2}") for e in range(12)]
    rng, steps = random.Random(5), []
    for t in range(120):
        entity = rng.randrange(12)
        attempt = rng.choice(["old0", "old1", f"a{t}", f"a{t - 3}"])
        steps.append((entity % 3, entity, t, attempt, rng.randint(0, 3), "put"))
    log = spark.createDataFrame(
        [(u, e, t, f"m{t}", a, b, k) for u, e, t, a, b, k in steps],
        "user_id long, entity_id long, arrival long, mutation_id string, attempt_id string, base_version long, kind string",
    ).repartition(7)
    state_rows = spark.createDataFrame(
        known, "entity_id long, version long, deleted boolean, user_id long, last_attempt_id string"
    )
    got = fold.apply_mutations(log, state_rows, None, 60)
    assert rows(got, "arrival", "outcome", "version", "deleted") == sorted(in_order(steps, known), key=repr)
