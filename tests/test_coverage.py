"""Intervals of sequences: against sets of sequences."""

import random

from rookery.operators import coverage
from tests.conftest import rows

EVENTS = "scope int, at long, kind string, low long, high long, is_end boolean"


def test_facts_equal_a_look_at_every_sequence(spark):
    """Overlapping, adjacent, nested and empty windows, a hot scope, gaps healed by parts."""
    rng = random.Random(2)
    events = []
    for at in range(700):
        scope = 1 if rng.random() < 0.4 else rng.randint(2, 25)
        low = rng.randint(0, 60)
        kind = rng.choice([coverage.GAP, coverage.GAP, coverage.DELTA, coverage.HISTORY])
        if scope % 5 == 0:
            kind = coverage.GAP
        elif scope % 4 == 2:
            kind = coverage.HISTORY
        events.append((scope, at, kind, low, low + rng.randint(-2, 12), rng.random() < 0.5))
    want = []
    for scope in sorted({e[0] for e in events}):
        own = [e for e in events if e[0] == scope]
        read, gap = {}, {}
        for _, at, kind, low, high, _ in own:
            for seq in range(low, high + 1):
                (gap if kind == coverage.GAP else read)[seq] = at
        missing = sorted(s for s, at in gap.items() if at > read.get(s, -1))
        pages = [e[5] for e in own if e[2] == coverage.HISTORY]
        window = "unchecked" if not pages else "exhausted" if pages[-1] else "may-have-more"
        facts = ("initialized" if pages else "pending", window, "gap-detected" if missing else "continuous")
        want.append((scope, *facts, len(read), len(missing), missing[0] if missing else None))
    df = spark.createDataFrame(events, EVENTS).repartition(4)
    assert rows(coverage.coverage_facts(df)) == sorted(want, key=repr)
    assert len({w[1:4] for w in want}) > 3
    assert coverage.coverage_facts(df.limit(0)).count() == 0


def test_a_gap_is_healed_by_several_later_windows(spark):
    def facts(*events):
        df = spark.createDataFrame([(1, at, k, low, high, False) for at, (k, low, high) in enumerate(events)], EVENTS)
        return rows(coverage.open_gaps(df), "low", "high"), coverage.coverage_facts(df).first().integrity

    gap = (coverage.GAP, 10, 20)
    assert facts((coverage.HISTORY, 0, 30), gap) == ([(10, 20)], "gap-detected")
    assert facts(gap, (coverage.DELTA, 12, 14), (coverage.HISTORY, 17, 25)) == ([(10, 11), (15, 16)], "gap-detected")
    assert facts(gap, (coverage.DELTA, 5, 14), (coverage.HISTORY, 15, 25)) == ([], "continuous")
    assert facts(gap, (coverage.DELTA, 0, 99), gap) == ([(10, 20)], "gap-detected")
