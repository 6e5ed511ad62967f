"""Operators that compare or combine rows: against brute force on small tables."""

import hashlib
import pathlib
import random
import re
import sys

import numpy as np
import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[2] / "tools"))

import check

import corpus_pipeline
from rookery.llm import jaccard, lines, mixing, quality, simhash
from rookery.llm.common import prepared
from rookery.llm.components import components
from rookery.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
WORDS = [f"w{k}" for k in range(400)]


def text_of(rng, size):
    return " ".join(rng.choice(WORDS) for _ in range(size))


def edited(rng, text, changes):
    words = text.split(" ")
    for _ in range(changes):
        words[rng.randrange(len(words))] = rng.choice(WORDS)
    return " ".join(words)


@pytest.fixture(scope="module")
def corpus(spark):
    """Groups of near and exact copies, a shared passage, nulls, repeated rows and ids,
    one long text, and extra columns with clashing names."""
    rng = random.Random(11)
    texts = [None, "", " \t\n", "one", "One", "one two", "a b c d"]
    base = text_of(rng, 120)
    texts += [edited(rng, base, k % 5) for k in range(25)] + [base.upper(), base, base]
    passage = text_of(rng, 60)
    texts += [f"{text_of(rng, 20)}\n{passage}\n{text_of(rng, 9)}" for _ in range(6)]
    texts += [text_of(rng, rng.randint(1, 80)) for _ in range(30)] + [text_of(rng, 9000)]
    rows = [(k, t, f"s{k % 3}" if k % 7 else None, "en", 1, 1.0) for k, t in enumerate(texts)]
    rows += [(40, texts[9], "s1", "en", 1, 1.0), (None, texts[10], "s0", "en", 1, 1.0), rows[12], rows[12]]
    schema = "doc_id long, text string, source string, lang string, row int, component double"
    return prepared(spark).createDataFrame(rows, schema).repartition(3).cache()


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + size]) for k in range(len(words) - size + 1)}


def components_of(sets, percent):
    root = list(range(len(sets)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if a and sets[j] and 100 * common >= percent * (len(a) + len(sets[j]) - common):
                root[find(i)] = find(j)
    return [find(k) for k in range(len(sets))]


@pytest.mark.parametrize(("size", "percent", "tile"), [(4, 85, 2000), (5, 80, 2000), (4, 85, 3), (2, 50, 4)])
def test_jaccard_components(monkeypatch, corpus, size, percent, tile):
    monkeypatch.setattr(jaccard, "TILE", tile)
    if tile < 10:
        monkeypatch.setattr(jaccard, "MINIMA", 1)
        monkeypatch.setattr(jaccard, "OFFERS", 1)
    rows = corpus.collect()
    sets = [shingles(r.text, size) for r in rows]
    found = components_of(sets, percent)
    least = {}
    for r, c in zip(rows, found, strict=True):
        if r.doc_id is not None:
            least[c] = min(r.doc_id, least.get(c, r.doc_id))
    want = [
        (r.doc_id, len(s), least.get(c) if s else r.doc_id)
        for r, s, c in zip(rows, sets, found, strict=True)
    ]
    got = [tuple(r) for r in jaccard.similar(corpus, size, percent).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("few", [0, 4])
def test_jaccard_of_the_rest_compares_a_pair_once(monkeypatch, corpus, few):
    seen, verified = [], jaccard._verified

    def counted(pairs, *args):
        seen.append(sorted(tuple(r) for r in pairs.collect()))
        return verified(pairs, *args)

    monkeypatch.setattr(jaccard, "FEW", few)
    monkeypatch.setattr(jaccard, "ROUNDS", 0)  # all blocks go the way of the rest
    monkeypatch.setattr(jaccard, "_promising", lambda pairs, nodes, percent: pairs.limit(0))
    monkeypatch.setattr(jaccard, "_verified", counted)
    rows = corpus.collect()
    sets = [shingles(r.text, 4) for r in rows]
    least, found = {}, components_of(sets, 85)
    for r, c in zip(rows, found, strict=True):
        if r.doc_id is not None:
            least[c] = min(r.doc_id, least.get(c, r.doc_id))
    want = [(r.doc_id, len(s), least.get(c) if s else r.doc_id) for r, s, c in zip(rows, sets, found, strict=True)]
    got = [tuple(r) for r in jaccard.similar(corpus, 4, 85).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert len(seen) == 2 and len(seen[1]) == len(set(seen[1])) and bool(seen[1]) == bool(few)


def test_blocks_with_the_same_nodes_are_searched_once(spark):
    rows = [(1, 200, list(range(30))), (2, 201, list(range(30))), (3, 200, list(range(20, 50))), (4, 199, [99])]
    nodes = spark.createDataFrame(rows, "node long, n int, prefix array<long>")
    labels = spark.createDataFrame([], "node long, component long")
    found = sorted((r.shingle, r.node) for r in jaccard._blocks(nodes, labels, 85).collect())
    assert found == [(0, 1), (0, 2), (20, 1), (20, 2), (20, 3)]


def test_wider_bitmaps_lose_no_pair():
    rng = np.random.default_rng(6)
    sets = []
    for _ in range(40):
        base = rng.integers(0, 1 << 63, int(rng.integers(1, 300)), dtype=np.uint64)
        sets += [np.unique(base), np.unique(base[len(base) // 12 :])]
    entries = [
        (len(s), k, k, int.from_bytes(jaccard._packed(s, jaccard.wider_of(len(s))), "little")) for k, s in enumerate(sets)
    ]
    found = {(a, b) for a, b, _ in jaccard.candidates(entries, 85, jaccard.wider_of)}
    links = {
        (i, j)
        for i, a in enumerate(sets)
        for j in range(i + 1, len(sets))
        if 100 * len(np.intersect1d(a, sets[j])) >= 85 * len(np.union1d(a, sets[j]))
    }
    assert links and links <= found


def test_one_of_each_component_stays(corpus):
    rows = corpus.collect()
    sets = [shingles(r.text, 5) for r in rows]
    found = components_of(sets, 80)
    kept = jaccard.one_of_each(corpus, 5, 80)
    assert kept.columns == corpus.columns
    got = kept.collect()
    assert len(got) == sum(not s for s in sets) + len({c for c, s in zip(found, sets, strict=True) if s})
    assert all(r in rows for r in got)
    assert jaccard.similar(corpus.limit(0)).count() == 0 == jaccard.one_of_each(corpus.limit(0), 5, 80).count()


def test_signature_tree_loses_no_pair():
    rng = np.random.default_rng(2)
    sets = []
    for _ in range(40):
        base = rng.choice(5000, int(rng.integers(1, 300)), replace=False)
        sets += [set(base.tolist()), set(base.tolist()) - set(base[: len(base) // 12].tolist()) or {1}]
    entries = []
    for k, s in enumerate(sets):
        width = jaccard.width_of(len(s))
        entries.append((len(s), k, k, sum(1 << b for b in {(x * 2654435761 >> 7) % width for x in s})))
    found = {(a, b) for a, b, _ in jaccard.candidates(entries, 85)}
    for i, a in enumerate(sets):
        for j in range(i + 1, len(sets)):
            if 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                assert (i, j) in found


def test_components_of_chains_and_hubs(spark):
    links = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 160)] + [(7, 7), (200, 300), (300, 200)]
    df = prepared(spark).createDataFrame(links, "a long, b long")
    got = {r.node: r.component for r in components(df).collect()}
    want = {k: 0 for k in range(61)} | {k: 100 for k in range(100, 160)} | {200: 200, 300: 200}
    assert got == want
    assert components(df.limit(0)).count() == 0


# --- mixing ---------------------------------------------------------------------------


def test_mix_reaches_its_targets(corpus):
    rows = [r.asDict() for r in mixing.mixed(corpus).collect()]
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    given = corpus.collect()
    assert sorted((r["doc_id"] or -1, r["size"]) for r in rows) == sorted((r.doc_id or -1, size(r.text)) for r in given)
    total, by = {}, {}
    for r in given:
        total[r.source] = total.get(r.source, 0) + size(r.text)
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    open_, target = set(order), {}
    while True:
        share = (sum(total.values()) - sum(target.values())) / sum(weight[s] for s in open_)
        above = {s for s in open_ if share * weight[s] > 3 * total[s]}
        if not above:
            break
        target |= {s: 3.0 * total[s] for s in above}
        open_ -= above
    target |= {s: share * weight[s] for s in open_}
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by.setdefault((r["source_size"], r["target"]), []).append(r["taken"])
    want = {(total[s], target[s]) for s in order}
    assert {(n, round(t, 6)) for n, t in by} == {(n, round(t, 6)) for n, t in want}
    for (_, t), taken in by.items():
        assert sum(taken) == int(t)
    again = mixing.mixed(corpus.repartition(7)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, mixing.mixed(corpus).collect()))


def test_mix_with_a_small_source_and_key_ranges(monkeypatch, spark):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 5)
    rows = [(k, "a b c " * (k % 4), "b") for k in range(300)] + [(k, "one two", "a") for k in range(300, 304)]
    docs = prepared(spark).createDataFrame(rows, "doc_id long, text string, source string")
    taken = {}
    for r in mixing.mixed(docs).collect():
        taken.setdefault(r.target, []).append(r.taken)
    total = sum(len(t.split()) for _, t, _ in rows)
    assert {t: sum(v) for t, v in taken.items()} == {24.0: 24, total - 24.0: total - 24}
    assert mixing.mixed(docs.limit(0)).count() == 0
    copies = mixing.repeated(docs)
    assert copies.columns == docs.columns and copies.filter("source = 'a'").count() == 12
    blank = docs.selectExpr("doc_id", "cast(null as string) text", "source")
    assert {r.taken for r in mixing.mixed(blank).collect()} == {0}


# --- lines ------------------------------------------------------------------------------


def test_recurring_lines_and_templates_go(spark):
    log = "one known user {} logged in from host {} at gate four of the hall"
    rows = [
        (1, "unique first\n" + log.format(11, "h1") + "\n\nsame line here"),
        (2, log.format(2, "h22") + "\nunique second\nsame   line here "),
        (3, log.format("anna", "h9") + "\nonly here"),
        (4, log.format("bert", "h9") + "\n" + log.format("bert", "h9")),
        (5, "same line here"), (5, None), (6, ""), (None, "same line here\nlast"),
        (7, "copy of a text\nwith two lines"), (8, "copy of a text\nwith two lines"), (9, "with two lines\nmore"),
        (10, "x " * 30_000), (11, "x " * 30_000 + "\ny"),
    ]
    docs = prepared(spark).createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, row int, n_chars long")
    got = {(r.doc_id, r.n_lines): (r.n_dropped, r.text) for r in lines.kept_lines(docs).collect()}
    assert got == {
        (1, 3): (0, rows[0][1]), (2, 3): (2, "unique second"), (3, 2): (1, "only here"), (4, 2): (2, ""),
        (5, 1): (1, ""), (5, 0): (0, None), (6, 0): (0, ""), (None, 2): (1, "last"),
        (7, 2): (0, rows[8][1]), (8, 2): (0, rows[8][1]), (9, 2): (1, "more"),
        (10, 1): (0, rows[11][1]), (11, 2): (1, "y"),
    }
    kept = lines.cleaned(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text, r.n_chars) for r in kept.collect()), key=repr) == sorted(
        (
            (d, t, len(t) if n else 2)
            for (d, total), (n, t) in got.items()
            if not (n and n == total)
        ),
        key=repr,
    )
    assert lines.kept_lines(docs.limit(0)).count() == 0


def test_lines_of_tabs_only_are_blank(spark):
    rows = [
        (1, "one\n\t\ntwo\n \t \nthree\n\t"), (2, "four\n\t\nfive\n \t \nsix\n\t"),
        (3, "\tcommon line"), (4, "common\tline \t\n\t"),
    ]
    docs = prepared(spark).createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in lines.kept_lines(docs).collect())
    assert got == [(1, 3, 0, rows[0][1]), (2, 3, 0, rows[1][1]), (3, 1, 0, rows[2][1]), (4, 1, 1, "\t")]
    assert sorted(r.doc_id for r in lines.cleaned(docs).collect()) == [1, 2, 3]


def test_lines_of_fields_recur_only_if_identical(spark):
    rows = [
        (1, "3.1 2.7\n12 40\nhttp://a.example/1"), (2, "5.5 0.1\n13 41\nhttp://a.example/2"),
        (3, "\u6771\u4eac\u306f2020\u5e74"), (4, "\u5927\u962a\u306f1970\u5e74"), (5, "5.5  0.1\nhttp://a.example/1\nPage 7"),
        (6, "shown on the page 8"), (7, "shown on the page 9\nPage 8"),
        (8, "1 2 3 4 5 6 7"), (9, "2 3 4 5 6 7 8\n1 2 3 4 5 6 x"),
    ]
    docs = prepared(spark).createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_dropped, r.text) for r in lines.kept_lines(docs).collect()}
    assert got == {k: (0, t) for k, t in rows} | {5: (2, "Page 7"), 7: (1, "Page 8")}
    assert lines.cleaned(docs).count() == len(rows)


def test_fields_of_small_vocabularies_recur(spark):
    line = "the daily summary for {} in {} arrived"
    pairs = [(f"n{chr(97 + a)}", f"c{chr(97 + b)}") for a in range(20) for b in range(20)]
    rows = [(i, line.format(*p) + f"\nown {chr(97 + i // 26)}{chr(97 + i % 26)} words") for i, p in enumerate(pairs)]
    rows += [(1000 + i, line.format(f"m{i}", f"d{i}").replace("daily", "other")) for i in range(2)]
    docs = prepared(spark).createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.n_dropped for r in lines.kept_lines(docs).collect()}
    assert got == {i: int(0 < i < 400 or i == 1001) for i, _ in rows}


# --- quality ------------------------------------------------------------------------------


def test_quality_held_out(spark):
    docs = prepared(spark).read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.trained(docs, labels.filter("doc_id % 3 > 0"))
    scored = quality.scored(docs, model).join(labels.filter("doc_id % 3 = 0"), "doc_id").collect()
    good = [r.accepted for r in scored if r.quality == 1]
    bad = [r.accepted for r in scored if r.quality == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.2 * len(bad)
    assert quality.accepted(docs, model).columns == docs.columns
    assert quality.accepted(docs, model).count() == quality.scored(docs, model).filter("accepted").count()


def test_quality_without_labels_or_columns(spark, corpus):
    none = prepared(spark).createDataFrame([], "doc_id long, quality int")
    model = quality.trained(corpus, none)
    assert model is None
    rows = quality.scored(corpus.drop("source", "lang"), model).collect()
    assert len(rows) == corpus.count() and all(r.accepted and r.quality_score is None for r in rows)
    some = [(k, k % 2) for k in range(60)] + [(3, None), (None, 1), (8, 1)]
    labels = spark.createDataFrame(some, "doc_id long, quality int")
    model = quality.trained(corpus, labels)
    assert all(0 <= r.quality_score <= 1 for r in quality.scored(corpus, model).collect())
    assert quality.scored(corpus.limit(0), model).count() == 0


# --- fingerprints ----------------------------------------------------------------------------


def hamming(a, b):
    return (int(a, 16) ^ int(b, 16)).bit_count()


def test_fingerprints_against_brute_force(spark, corpus):
    got = simhash.edited_fingerprints(corpus, every=2).collect()
    rows = [(r.doc_id, r.text or "") for r in corpus.collect()]
    assert sorted(repr((r.doc_id, r.n_chars)) for r in got) == sorted(repr((d, len(t))) for d, t in rows)
    alone = [d for d, _ in rows if d is not None and sum(e == d for e, _ in rows) == 1]
    by_id = {r.doc_id: r for r in got}
    texts = dict(rows)
    order = sorted({d for d, _ in rows if d is not None}, reverse=True)
    for this, following in zip(order, order[1:], strict=False):
        if this in alone and following in alone:
            text, after, r = texts[this], texts[following], by_id[this]
            cut = len(text) // 3
            edit = text[: len(text) - cut] + after[:cut]
            assert r.edited_sha256 == hashlib.sha256(edit.encode()).hexdigest()
            assert abs(r.near_edited - 1 + hamming(r.fingerprint, r.edited_fingerprint) / 128) < 1e-9
            assert abs(r.near_next - 1 + hamming(r.fingerprint, by_id[following].fingerprint) / 128) < 1e-9
    for r in got:
        near = sum(hamming(r.fingerprint, o.fingerprint) <= simhash.RADIUS for o in got) - 1
        assert r.n_near == (near if r.doc_id is not None and r.doc_id % 2 == 0 else None)
    assert len({r.fingerprint for r in got if r.doc_id in (32, 33, 34)}) == 1
    assert simhash.edited_fingerprints(corpus.limit(0)).count() == 0


def test_near_copies_are_found(spark):
    rng, words = random.Random(5), [f"word{k}" for k in range(900)]
    rows, likes = [], {}
    for k in range(40):
        a = [rng.choice(words) for _ in range(300)]
        b = list(a)
        for at in rng.sample(range(300), 5):
            b[at] = rng.choice(words)
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
        one, two = shingles(rows[-2][1], 5), shingles(rows[-1][1], 5)
        likes[2 * k] = len(one & two) / len(one | two)
    docs = prepared(spark).createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.n_near for r in simhash.edited_fingerprints(docs, every=2).collect()}
    alike = [k for k, j in likes.items() if j >= 0.8]
    assert len(alike) >= 20 and sum(got[k] == 1 for k in alike) >= 0.9 * len(alike)
    assert all(got[k] in (0, 1) for k in likes)


@pytest.mark.parametrize("radius", [0, 3, 12, 16])
def test_near_against_all_pairs(spark, radius):
    rng = random.Random(radius)
    base = [rng.getrandbits(128) for _ in range(5)]
    all_bits = base + [b ^ sum(1 << k for k in rng.sample(range(128), n)) for b in base for n in range(1, 22)]
    signed = [tuple(simhash._signed(v) for v in (x & (1 << 64) - 1, x >> 64)) for x in all_bits]
    df = prepared(spark).createDataFrame(signed, "low long, high long")
    got = sorted(tuple(r) for r in simhash.near(df.limit(60), df, radius).collect())
    want = sorted(
        (*a, *b, (x ^ y).bit_count())
        for a, x in list(zip(signed, all_bits, strict=True))[:60]
        for b, y in zip(signed, all_bits, strict=True)
        if (x ^ y).bit_count() <= radius
    )
    assert got == want


def test_votes_are_those_of_every_bit(spark):
    rows = [(1, "alpha beta beta gamma delta")]
    df = prepared(spark).createDataFrame(rows, "k long, text string")
    terms = df.selectExpr("k", "text").select(simhash._terms(df["text"]).alias("t")).first().t
    found = simhash.fingerprints(df, ["k"]).first()
    for name, value in (("h1", found.low), ("h2", found.high)):
        for bit in range(64):
            votes = sum(t.weight * (1 if t[name] >> bit & 1 else -1) for t in terms)
            assert (value >> bit & 1) == (votes > 0)


# --- registered queries and the pipeline ---------------------------------------------------------


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql_twin(spark, name):
    verdict, rows = check.compare(spark, check.connect(SF), SF, name)
    assert verdict == "ok" and rows > 0


def test_all_are_registered():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", ["op4_mix", "op5_lines", "op9_fingerprints"])
def test_native_plans_have_no_python(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan)


def test_stages_return_documents(spark):
    docs = prepared(spark).read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_pipeline_against_its_parts(spark):
    out = corpus_pipeline.run(spark, SF).collect()
    texts = {}
    docs = prepared(spark).read.parquet(f"{SF}/documents.parquet")
    kept = quality.accepted(docs, quality.trained(docs, spark.read.parquet(f"{SF}/labels.parquet")))
    for r in lines.kept_lines(kept).collect():
        texts[r.doc_id] = r.text or ""
    assert out and all(r.n_tokens == len(r.tokens) for r in out)
    for r in out:
        assert r.text_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    sets = {d: shingles(texts[d], 5) for d in {r.doc_id for r in out}}
    ids = list(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            common = len(sets[a] & sets[b])
            assert not sets[a] or 100 * common < 80 * len(sets[a] | sets[b])
