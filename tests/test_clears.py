"""Clears as compare-and-set, and the log of users' state."""

import random

from rookery.operators import clears
from tests.conftest import rows

LOG = "user_id long, arrival long, mutation_id string, attempt_id string, base_version long, anchor_ms long, candidate_ms long"
STATE = "user_id long, cleared_ms long, version long"
CHANGE = "user_id long, entity_kind string, entity_id string, version long, arrival long"
NOW = 1000


def in_order(log, state, receipts):
    known = {u: [c, v] for u, c, v in state}
    took, out = set(receipts), []
    for user, arrival, _, attempt, base, anchor, candidate in log:
        row = known.setdefault(user, [None, 0])
        at = NOW if anchor is None else min(NOW, max(anchor, candidate))
        stepped = False
        if attempt is not None and (user, attempt) in took:
            outcome = "already-applied"
        elif base == row[1]:
            outcome, stepped = "applied", row[0] is None or at > row[0]
            if stepped:
                row[:] = [at, row[1] + 1]
            took.add((user, attempt))
        else:
            outcome = "conflict"
        out.append((user, arrival, outcome, *row, stepped))
    return out


def test_clears_equal_one_pass_in_order(spark):
    """One hot user, unknown users, receipts, null and re-sent attempts, times without anchor."""
    rng = random.Random(4)
    state, receipts = [(1, 300, 2), (2, 100, 1)], [(1, "a5"), (3, "a9")]
    log = []
    for t in range(600):
        user = 1 if rng.random() < 0.6 else rng.randint(2, 6)
        attempt = rng.choice([f"a{t}", f"a{t}", None])
        if log and rng.random() < 0.3:
            user, attempt = (old := rng.choice(log[-20:]))[0], old[3]
        anchor = rng.choice([None, rng.randint(0, 900), rng.randint(0, 900)]) if rng.random() < 0.3 else t
        log.append((user, t, f"m{t}", attempt, rng.randint(0, 40) if t % 3 else t // 10, anchor, rng.randint(0, 1200)))
    frames = [spark.createDataFrame(d, s) for d, s in ((log, LOG), (state, STATE), (receipts, "user_id long, attempt_id string"))]
    got = clears.apply_clears(frames[0].repartition(5), *frames[1:], NOW)
    want = in_order(log, state, receipts)
    assert rows(got, "user_id", "arrival", "outcome", "cleared_ms", "version", "stepped") == sorted(want, key=repr)
    assert {w[2] for w in want} == {"applied", "already-applied", "conflict"}
    assert any(w[2] == "applied" and not w[5] for w in want)
    after = rows(clears.feed_states(frames[1], got), "user_id", "cleared_ms", "version")
    last = {w[0]: w for w in want}
    assert after == sorted([(u, w[3], w[4]) for u, w in last.items() if w[4]], key=repr)
    assert clears.apply_clears(frames[0].limit(0), *frames[1:], NOW).count() == 0


def test_log_has_no_gap_and_a_second_writing_adds_nothing(spark):
    log = spark.createDataFrame([(1, 7, "filter", "x", 1, 3)], "user_id long, seq long, entity_kind string, entity_id string, version long, arrival long")
    given = [(1, "filter", "x", 2, 9), (1, "filter", "x", 1, 3), (1, "feed-state", "feed", 1, 5), (2, "filter", "y", 1, 4), (2, "filter", "y", 1, 4)]
    changes = spark.createDataFrame(given, CHANGE)
    new = clears.write_state_log(log, changes)
    assert rows(new) == [(1, 8, "feed-state", "feed", 1, 5), (1, 9, "filter", "x", 2, 9), (2, 1, "filter", "y", 1, 4)]
    assert clears.write_state_log(log.unionByName(new), changes).count() == 0


def test_only_effects_are_changes(spark):
    filters = spark.createDataFrame(
        [(1, 5, 2, 0, "applied"), (1, 5, 2, 1, "already-applied"), (1, 6, 0, 2, "conflict")],
        "user_id long, entity_id long, version long, arrival long, outcome string",
    )
    cleared = spark.createDataFrame(
        [(1, 3, 1, "applied", True), (1, 4, 1, "applied", False), (1, 5, 1, "conflict", False)],
        "user_id long, arrival long, version long, outcome string, stepped boolean",
    )
    got = rows(clears.state_changes(filters, cleared))
    assert got == [(1, "feed-state", "feed", 1, 3), (1, "filter", "5", 2, 0)]
