"""Phrase collocations: against brute force on small tables."""

import random
import re
from collections import Counter

import pytest

from rookery.llm import collocations
from rookery.llm.common import prepared

WORDS = [f"w{k}" for k in range(12)]


def brute(rows, most, least, share):
    """All phrases of each language counted and scored, as the contract has it."""
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        own = counts.setdefault(lang, Counter())
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for size in (1, 2, 3):
                own.update(tuple(words[k : k + size]) for k in range(len(words) - size + 1))
    out = []
    for lang, own in counts.items():
        candidates = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        gone = {
            q
            for p, a in candidates.items()
            if len(p) == 3
            for q in (p[:2], p[1:])
            if q in candidates and 100 * a >= share * candidates[q]
        }
        found = []
        for p, a in candidates.items():
            if p in gone:
                continue
            cuts = [(1_000_000 * a * a // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:most], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


@pytest.fixture(scope="module")
def corpus(spark):
    """Few words in skewed order, several languages, nulls, empty and repeated rows, marks,
    wide characters, one long text, and extra columns with clashing names."""
    rng = random.Random(3)
    weight = [1 / (k + 1) for k in range(len(WORDS))]
    texts = []
    for k in range(120):
        words = rng.choices(WORDS, weight, k=rng.randint(0, 60))
        for at in range(0, len(words), 7):
            words[at] += rng.choice(["", "", ".", ",", "!x", "\n", "\t", " ", "\r\n", "\x0b", "\x0c"])
        texts.append((rng.choice(["en", "en", "en", "fr", None, "und", ""]), " ".join(words)))
    texts += [("en", "Ärger mit É Ärger mit " * 12), ("fr", None), (None, ""), ("de", "a b c"), ("xx", " \t\n")]
    texts += [("en", " ".join(rng.choices(WORDS, weight, k=4000))), texts[0], texts[0]]
    rows = [(k, lang, text, 1, "p", 2.0) for k, (lang, text) in enumerate(texts)]
    schema = "doc_id long, lang string, text string, n int, phrase string, score double"
    return prepared(spark).createDataFrame(rows, schema).repartition(3).cache()


@pytest.mark.parametrize(
    ("most", "least", "share", "chunk", "reach"),
    [(2000, 10, 50, 1 << 20, 4), (5, 3, 50, 64, 1), (3, 10, 90, 500, 1), (7, 2, 20, 64, 2)],
)
def test_phrases_equal_brute_force(monkeypatch, corpus, most, least, share, chunk, reach):
    monkeypatch.setattr(collocations, "REACH", reach)  # a low first bar needs several waves
    got = sorted(tuple(r) for r in collocations.mined(corpus, most, least, share, chunk).collect())
    rows = [(r.lang, r.text) for r in corpus.collect()]
    assert got == brute(rows, most, least, share)


def test_no_rows_no_phrases(corpus):
    assert collocations.mined(corpus.limit(0)).count() == 0
    assert collocations.mined(corpus.filter("text is null")).count() == 0


def test_long_texts_count_as_in_one_piece():
    rng = random.Random(4)
    text = " ".join(rng.choice(["ab", "c", "d.", "\t", "e,f"]) for _ in range(3000)).encode()
    whole = next(iter(collocations._chunks(text, 1 << 30)))
    want = Counter(zip(whole, whole[1:], whole[2:]))
    for size in (1, 7, 100):
        found, carry = Counter(), []
        for words in collocations._chunks(text, size):
            seq = carry + words
            first = max(len(carry), 2) - 2
            found.update(zip(seq[first:], seq[first + 1 :], seq[first + 2 :]))
            carry = seq[-2:]
        assert found == want


def test_scores_pass_64_bits(spark):
    rows = [(3 * 10**12, 4 * 10**12, 3 * 10**12 + 1), (10, 10, 10), (7, 11, 13)]
    df = spark.createDataFrame(rows, "a long, l long, r long")
    got = [r.s for r in df.select(collocations._score("a", "l", "r").alias("s")).collect()]
    assert got == [10**6 * a * a // (left * right) for a, left, right in rows]
