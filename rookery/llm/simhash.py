"""Document fingerprints: SimHash, searched by tables of blocks.

The terms of a text are its pairs of adjacent words; each hashes to 128 bits and
votes for or against every bit with a weight that grows with the words' length.
Votes are packed sums: one long counts bit k in its lower and bit k + 32 in its
upper half. Built-in functions only; a text is never gathered anywhere but in its row.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rookery.operators.joins import split_join
from rookery.operators.ranking import numbered
from rookery.session import materialise

BITS = 128
_LANES = 0x0000000100000001
#: Word lengths count up to this sum as a pair's weight.
MOST_WEIGHT = 16
#: Radius of the search for near fingerprints: nearly all texts with a Jaccard similarity
#: of 0.8 and more of their five-word shingles lie within (figures in the README).
RADIUS = 16


def _terms(text: Column) -> Column:
    """array<struct<h1, h2, weight>> of a text's adjacent word pairs, the first word
    paired with nothing. An empty text has one empty word."""
    words = F.split(F.lower(text), r"[\x20\x09-\x0D]+")
    before = F.concat(F.array(F.lit("")), words)
    return F.zip_with(
        words,
        F.slice(before, F.lit(1), F.size(words)),
        lambda word, previous: F.struct(
            F.xxhash64(previous, word).alias("h1"),
            F.xxhash64(word, previous, F.lit(1)).alias("h2"),
            F.least(F.length(word) + F.length(previous), F.lit(MOST_WEIGHT)).alias("weight"),
        ),
    )


def fingerprints(rows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` with the fingerprint of ``text`` as two longs ``low`` and ``high``.

    ``keys`` tell texts apart. Votes are summed before any shuffle; there is none if
    the rows are already dealt out by one of the keys. A text without words votes for
    nothing and gets 0.
    """
    spread = rows.select(*keys, F.explode(_terms(F.col(text))).alias("_t")).select(
        *keys, "_t.h1", "_t.h2", F.col("_t.weight").cast("long").alias("weight")
    )
    votes = [
        F.sum(F.shiftrightunsigned(h, k).bitwiseAND(F.lit(_LANES)) * F.col("weight")).alias(f"{h}_{k}")
        for h in ("h1", "h2")
        for k in range(32)
    ]
    counted = spread.groupBy(*keys).agg(F.sum("weight").alias("all"), *votes)
    return counted.select(*keys, *(_bits(h).alias(n) for h, n in (("h1", "low"), ("h2", "high"))))


def _bits(h: str) -> Column:
    """The long whose bits have the larger part of all votes."""
    parts = []
    for k in range(32):
        lower = F.col(f"{h}_{k}").bitwiseAND(F.lit(0xFFFFFFFF))
        upper = F.shiftrightunsigned(f"{h}_{k}", 32)
        for count, bit in ((lower, k), (upper, k + 32)):
            parts.append((count * 2 > F.col("all")).cast("long") * F.lit(_signed(1 << bit)))
    return F.aggregate(F.array(*parts), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def shown(low: str, high: str) -> Column:
    """32 hex digits of a fingerprint."""
    return F.lower(F.concat(*(F.lpad(F.hex(c), 16, "0") for c in (high, low))))


def distance(a: tuple[str, str], b: tuple[str, str]) -> Column:
    """Hamming distance of two fingerprints, each given by its columns."""
    each = [F.bit_count(F.col(x).bitwiseXOR(F.col(y))) for x, y in zip(a, b, strict=True)]
    return each[0] + each[1]


def likeness(a: tuple[str, str], b: tuple[str, str]) -> Column:
    """1 for equal fingerprints, 0 for opposite ones; texts without a common term
    come out near a half."""
    return 1.0 - distance(a, b) / F.lit(float(BITS))


def _block(low: str, high: str, start: int, stop: int) -> Column:
    """Bits ``start`` to ``stop`` of a fingerprint as a long."""
    mask = F.lit((1 << (stop - start)) - 1)
    if stop <= 64:
        return F.shiftrightunsigned(low, start).bitwiseAND(mask)
    if start >= 64:
        return F.shiftrightunsigned(high, start - 64).bitwiseAND(mask)
    both = F.shiftrightunsigned(low, start).bitwiseOR(F.shiftleft(high, 64 - start))
    return both.bitwiseAND(mask)


def near(queries: DataFrame, all_rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """All fingerprints within ``radius`` of each query fingerprint, itself included:
    ``low, high, near_low, near_high, distance``. Both sides are distinct.

    The bits are cut into so many blocks that fingerprints within the radius differ by two
    bits at most in one of them. There is one table for each block; a query looks there
    under its own block and under all that differ from it by so few bits. A pair is kept
    from the first table that finds it.
    """
    n = max(radius // 3 + 1, 3)
    few = radius // n
    edges = [BITS * k // n for k in range(n + 1)]
    spans = list(zip(edges, edges[1:], strict=False))

    def entry(table: int, key: Column) -> Column:
        return F.struct(F.lit(table).alias("table"), key.alias("key"))

    def asked(table: int, start: int, stop: int) -> Column:
        flips = [sum(1 << k for k in c) for m in range(few + 1) for c in combinations(range(stop - start), m)]
        block = _block("low", "high", start, stop)
        masks = F.array(*(F.lit(f).cast("long") for f in flips))
        return F.transform(masks, lambda flip: entry(table, block.bitwiseXOR(flip)))

    left = queries.select("low", "high", F.inline(F.flatten(F.array(*(asked(t, *s) for t, s in enumerate(spans))))))
    # The size check sees the queries before they are multiplied: not to be broadcast.
    left = left.hint("merge")
    right = all_rows.select(F.col("low").alias("near_low"), F.col("high").alias("near_high"))
    right = right.select(
        "*",
        F.inline(F.array(*(entry(t, _block("near_low", "near_high", *s)) for t, s in enumerate(spans)))),
    )
    differ = [
        F.bit_count(_block("low", "high", *s).bitwiseXOR(_block("near_low", "near_high", *s))) for s in spans
    ]
    first_table = F.coalesce(*(F.when(d <= few, F.lit(t)) for t, d in enumerate(differ)))
    apart = distance(("low", "high"), ("near_low", "near_high"))
    return (
        split_join(left, right, ["table", "key"])
        .filter((apart <= radius) & (F.col("table") == first_table))
        .select("low", "high", "near_low", "near_high", apart.alias("distance"))
    )


def edited_fingerprints(docs: DataFrame, every: int = 100) -> DataFrame:
    """Fingerprints of all texts and of their edited texts, and how alike they are.

    The edited text has the last third of the code points, rounded down, replaced by
    as many from the start of the next document (by descending ``doc_id``; after the
    last the first). Repeated rows count as one document in that order and each get
    its result; rows with one id and different texts are ordered by the texts' hash;
    a null id comes last; a null text is empty. No documents give no rows. Columns:
    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, n_near``; the last is given for rows whose id is divisible by
    ``every`` and counts all other documents with a fingerprint within ``RADIUS``.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keyed = docs.withColumn("k", F.xxhash64("doc_id", "text"))
    each = keyed.groupBy("k").agg(
        F.max("doc_id").alias("doc_id"),
        F.max(F.length("text").cast("long")).alias("n_chars"),
        F.count("*").alias("copies"),
    )
    order = numbered(each, [F.desc_nulls_last("doc_id"), F.col("k")], "place")
    total = order.count()
    # For each document: the one whose edited text wants its start, and how much of it.
    wanted = order.select(
        ((F.col("place") + 1) % F.lit(max(total, 1))).alias("place"),
        F.col("k").alias("by"),
        F.col("doc_id").alias("by_id"),
        F.col("n_chars").alias("by_chars"),
        F.col("copies").alias("by_copies"),
    ).join(order.select("place", "k"), "place")
    # Both joins below read one exchange of the texts.
    texts = keyed.select("k", "text").dropDuplicates(["k"])
    take = F.floor(F.col("by_chars") / 3).cast("int")
    heads = texts.join(wanted, "k").select(
        F.col("by").alias("k"),
        F.col("k").alias("next_k"),
        "by_id",
        "by_chars",
        "by_copies",
        F.left("text", take).alias("head"),
    )
    kept = (F.col("by_chars") - take).cast("int")
    both = texts.join(heads, "k").withColumn("edited", F.concat(F.left("text", kept), F.col("head")))
    facts = both.select(
        "k", "next_k", "by_id", "by_chars", "by_copies", F.sha2("edited", 256).alias("sha"),
        F.inline(F.array(*(
            F.struct(F.lit(n).alias("kind"), F.col(c).alias("words"))
            for n, c in enumerate(("text", "edited"))
        ))),
    )
    keys = ["k", "kind", "next_k", "by_id", "by_chars", "by_copies", "sha"]
    voted = materialise(fingerprints(facts, keys, "words"), "fingerprints")
    plain, edited = (voted.filter(F.col("kind") == n).drop("kind") for n in (0, 1))
    edited = edited.select("k", F.col("low").alias("e_low"), F.col("high").alias("e_high"))
    following = plain.select(
        F.col("k").alias("next_k"), F.col("low").alias("n_low"), F.col("high").alias("n_high")
    )
    weighed = plain.groupBy("low", "high").agg(F.sum("by_copies").alias("n"))
    asked = plain.filter(F.col("by_id") % every == 0).select("low", "high").distinct()
    found = near(asked, weighed).join(
        weighed.select(F.col("low").alias("near_low"), F.col("high").alias("near_high"), "n"),
        ["near_low", "near_high"],
    )
    counts = found.groupBy("low", "high").agg(F.sum("n").alias("found"))
    own, of_edited, of_next = ("low", "high"), ("e_low", "e_high"), ("n_low", "n_high")
    done = plain.join(edited, "k").join(following, "next_k").join(counts, ["low", "high"], "left")
    return done.select(
        F.col("by_id").alias("doc_id"),
        F.col("by_chars").alias("n_chars"),
        F.col("sha").alias("edited_sha256"),
        shown(*own).alias("fingerprint"),
        shown(*of_edited).alias("edited_fingerprint"),
        likeness(own, of_edited).alias("near_edited"),
        likeness(own, of_next).alias("near_next"),
        F.when(F.col("by_id") % every == 0, F.col("found") - 1).alias("n_near"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("by_copies"))).alias("_copy"),
    ).drop("_copy")
