"""MinHash near duplicates: against brute force on small tables."""

import random

import numpy as np
import pytest
from test_tables import components_of, corpus, shingles  # noqa: F401

from rookery.llm import minhash
from rookery.llm.common import prepared


def check(df, size, percent):
    rows = df.collect()
    sets = [shingles(r.text, size) for r in rows]
    found = components_of(sets, percent)
    least = {}
    for r, c in zip(rows, found, strict=True):
        if r.doc_id is not None:
            least[c] = min(r.doc_id, least.get(c, r.doc_id))
    named = [least.get(c) if s else r.doc_id for r, s, c in zip(rows, sets, found, strict=True)]
    want = [(r.doc_id, len(s), c, r.doc_id == c) for r, s, c in zip(rows, sets, named, strict=True)]
    got = [tuple(r) for r in minhash.deduplicated(df, size, percent).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize(("size", "percent", "tile"), [(5, 85, 1500), (4, 80, 3), (2, 50, 4)])
def test_components_equal_brute_force(monkeypatch, corpus, size, percent, tile):  # noqa: F811
    monkeypatch.setattr(minhash, "TILE", tile)
    if tile < 10:
        monkeypatch.setattr(minhash, "OFFERS", 1)
        monkeypatch.setattr(minhash, "OFFERING", 2)
        monkeypatch.setattr(minhash, "HELD_SHINGLES", 100)
        monkeypatch.setattr(minhash, "HELD_NODES", 2)
    check(corpus, size, percent)


def test_a_chain_whose_ends_are_unlike(spark):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(130)]
    texts = []
    for k in range(25):  # each step changes one word: neighbours link, ends have nothing in common
        words[5 * k] = f"x{rng.randrange(10**9)}"
        texts.append(" ".join(words))
    order = list(range(25))
    rng.shuffle(order)
    rows = [(order[k], t) for k, t in enumerate(texts)] + [(100, None), (101, "")]
    check(prepared(spark).createDataFrame(rows, "doc_id long, text string").repartition(4), 5, 85)


def test_empty_table(corpus):  # noqa: F811
    assert minhash.deduplicated(corpus.limit(0)).count() == 0
    assert minhash.deduplicated(corpus.filter("text is null")).count() == corpus.filter("text is null").count()


def test_matches_bound_the_chance_of_a_miss():
    least = minhash.least_matches(85)
    rng = np.random.default_rng(1)
    assert 28 <= least <= 36 and minhash.least_matches(100) == minhash.COORDINATES
    draws = rng.binomial(minhash.COORDINATES, 0.85, 200_000)
    assert draws.min() >= least
    # Signatures agree as often as sets are alike.
    seen = []
    for _ in range(60):
        common = rng.integers(0, 1 << 63, 850, dtype=np.uint64)
        x, y = (np.r_[common, rng.integers(0, 1 << 63, 75, dtype=np.uint64)] for _ in range(2))
        seen.append((minhash.signature(x) == minhash.signature(y)).sum())
    assert abs(np.mean(seen) / minhash.COORDINATES - 0.85) < 0.02 and min(seen) >= least


def test_each_pair_of_a_list_is_counted_once():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 50, (40, minhash.COORDINATES))
    base[:, ::2] = base[:1, ::2]
    masks = rng.integers(0, 1 << 62, 40) | 3
    side = (np.arange(40), np.full(40, 10), np.arange(40), base, masks)
    found = [p for c in range(minhash.COORDINATES) for p in minhash.merged(c, side, None, 32, 85)]
    want = {
        (a, b)
        for a in range(40)
        for b in range(a + 1, 40)
        if (base[a] == base[b]).sum() >= 32
    }
    assert len(found) == len({p[:2] for p in found}) and {p[:2] for p in found} == want


def test_texts_are_filtered_before_they_are_shuffled(monkeypatch, spark, tmp_path):
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "256MB"}
    before = {name: spark.conf.get(name) for name in names}
    prepared(spark).range(200).selectExpr("id as doc_id", "concat('a b c ', id) as text").write.parquet(f"{tmp_path}/docs")
    texts = spark.read.parquet(f"{tmp_path}/docs")
    nodes = texts.selectExpr("doc_id as node", "doc_id", "xxhash64(text) as text_hash", "5 as n")
    try:
        for name, value in names.items():
            spark.conf.set(name, value)
        plans, write = [], minhash.materialise

        def seen(df, label):
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
            return write(df, label)

        monkeypatch.setattr(minhash, "materialise", seen)
        found = minhash._texts_of(nodes.select("node").filter("node < 9"), nodes, texts)
        assert "might_contain" in plans[-1]
        assert sorted(r.text for r in found.collect()) == [f"a b c {k}" for k in range(9)]
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
