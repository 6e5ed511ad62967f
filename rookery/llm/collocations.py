"""Phrase collocations of each language, grown best first under score bounds.

A phrase is scored by its best explanation as two parts: of all cuts the one with the
lowest ``floor(10**6 * a * a / (l * r))`` counts, with a, l and r the occurrences of the
phrase and of the parts. The search grows phrases word by word:

* words first; only words that are frequent enough can begin or end a candidate;
* pairs next. A pair with c occurrences bounds every triple that it begins by c over its
  first word's count, and every triple that it ends by c over its last word's count,
  since the other part occurs at least as often as the triple;
* triples of the frontier only: those that both bounds allow to reach the bar, and
  those around a pair that reaches the bar itself, because they decide whether it is
  dropped. The bar is lowered for languages that do not have enough survivors above it,
  until the last wanted score with all its ties is settled.

The frontier goes to the tasks as flags of hashed cells, of a fixed size: who shares a
cell is counted too, exactly, so it costs work and never a result.
"""

from __future__ import annotations

import functools
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rookery.operators.joins import split_join
from rookery.session import materialise

#: Characters that end a piece, and the scale of scores.
_ENDS, SCALE = b".,;:!?\n\x0b\x0c\r", 1_000_000
_MARK = b"\xff"  # stands in no UTF-8 text
_TABLE = bytes(
    0xFF if k in _ENDS else 0x20 if k == 9 else k + 32 if 65 <= k <= 90 else k for k in range(256)
)
#: Bytes of text that a task counts at once.
CHUNK = 3 << 20
#: log2 of the cells of a frontier; 32,768 cells are a page.
CELL_BITS, _PAGE = 23, 32_768
_FIRST, _SECOND = 668_265_263, 374_761_393
#: The first bar: so many times the wanted phrases reach it; each later one the square.
REACH = 4
#: Flags of a pair: occurs often enough; its triples may reach the bar by the first word,
#: by the last word; it reaches the bar itself.
OFTEN, BEGINS, ENDS, REACHES = 1, 2, 4, 8


# --- counting -------------------------------------------------------------------


def _chunks(text: bytes, size: int) -> Iterator[list[bytes]]:
    """The words of a text with marks between its pieces, in lists of bounded size."""
    text, start = text.translate(_TABLE), 0
    while start < len(text):
        stop = text.find(b" ", start + size)
        stop = len(text) if stop < 0 else stop
        yield text[start:stop].replace(_MARK, b" \xff ").split()
        start = stop


def _runs(batches, size: int) -> Iterator[tuple[bytes, list[bytes], int]]:
    """``lang, words, known``: lists of words with marks between pieces, short texts of one
    language together, long ones in parts that repeat the ``known`` last words before."""
    short: dict[bytes, list[bytes]] = {}
    held = 0

    def flush():
        for lang, texts in short.items():
            for words in _chunks(b"\n".join(texts), 1 << 40):
                yield lang, words, 0
        short.clear()

    for batch in batches:
        langs = batch.column(0).cast(pa.binary()).to_pylist()
        for lang, text in zip(langs, batch.column(1).cast(pa.binary()), strict=True):
            text = text.as_py()
            if len(text) <= size:
                short.setdefault(lang, []).append(text)
                held += len(text) + 1
                if held > size:
                    yield from flush()
                    held = 0
            else:
                carry: list[bytes] = []
                for words in _chunks(text, size):
                    yield lang, carry + words, len(carry)
                    carry = (carry + words)[-2:]
    yield from flush()


class Flags:
    """Cells of a frontier: the flags of all words, or pairs of words, that hash there."""

    def __init__(self, pages: dict[tuple[int, int], bytes]):
        self.pages = pages

    def __getstate__(self) -> dict:
        return {"pages": self.pages}  # the cells are laid out where they are used

    @functools.cached_property
    def cells(self) -> np.ndarray:
        cells = np.zeros(1 << CELL_BITS, np.uint8)
        for (flag, page), bits in self.pages.items():
            part = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")
            cells[page * _PAGE : (page + 1) * _PAGE] |= part * np.uint8(flag)
        return cells

    def of(self, first: np.ndarray, second: np.ndarray | int = 0) -> np.ndarray:
        """Flags of words, or of pairs, given by the check sums of their words."""
        return self.cells[((first * _FIRST + second * _SECOND) >> 16) & ((1 << CELL_BITS) - 1)]


def _grams(lang: bytes, words: list[bytes], known: int, size: int, flags: Flags | None):
    """Phrases of ``size`` words that end after the first ``known``, and their numbers."""
    if size == 1:
        found = Counter(words[known:])
        found.pop(_MARK, None)
        found[b""] = found.total()
        return list(found), list(found.values())
    index = {w: k for k, w in enumerate(dict.fromkeys(words))}
    each, start = list(index), zlib.crc32(lang + b" ")
    at = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
    sums = np.array([zlib.crc32(w, start) for w in each], np.int64)
    within = at != index.get(_MARK, -1)
    if size == 2:
        often = (flags.of(sums) > 0)[at] & within
        wanted = often[:-1] & often[1:]
    else:
        of_pair = flags.of(sums[at[:-1]], sums[at[1:]]) * (within[:-1] & within[1:])
        x, y = of_pair[:-1], of_pair[1:]
        wanted = (x & y & OFTEN > 0) & (((x & BEGINS > 0) & (y & ENDS > 0)) | ((x | y) & REACHES > 0))
    wanted[: max(known - size + 1, 0)] = False
    place = np.flatnonzero(wanted)
    parts = at[place[:, None] + np.arange(size)]
    # One number for each phrase; distinct pairs are numbered anew before a third word.
    key = parts[:, 0] * len(each) + parts[:, 1]
    if size == 3:
        key = np.unique(key, return_inverse=True)[1] * len(each) + parts[:, 2]
    _, first, counts = np.unique(key, return_index=True, return_counts=True)
    return [b" ".join([each[w] for w in p]) for p in parts[first].tolist()], counts


def _counted(texts: DataFrame, size: int, flags=None, chunk: int = CHUNK) -> DataFrame:
    """``lang, phrase, n`` of all phrases of ``size`` words (of the frontier); with single
    words the row with an empty phrase has the sum of a language. Summed over chunks of
    text before the shuffle."""

    def count(batches):
        for lang, words, known in _runs(batches, chunk):
            phrases, counts = _grams(lang, words, known, size, flags.value if flags else None)
            arrays = [pa.array([lang] * len(phrases), pa.binary()), pa.array(phrases, pa.binary())]
            arrays = [a.cast(pa.string()) for a in arrays] + [pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["lang", "phrase", "n"])

    kind = "lang string, phrase string, n long"
    return texts.mapInArrow(count, kind).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def _sum(word: Column) -> Column:
    return F.crc32(F.concat(F.col("lang"), F.lit(" "), word))


def _frontier(marked: DataFrame, cell: Column, flags: tuple[int, ...]):
    """Broadcast ``flags`` of the rows of ``marked``; 1 MB for each flag at most."""
    place = F.shiftright(cell, 16).bitwiseAND(F.lit((1 << CELL_BITS) - 1)).alias("cell")
    bits = marked.select(F.explode(F.array(*map(F.lit, flags))).alias("flag"), "flags", place)
    pages = (
        bits.filter(F.col("flags").bitwiseAND(F.col("flag")) > 0)
        .groupBy("flag", F.expr(f"cell div {_PAGE}").alias("page"))
        .agg(F.bitmap_construct_agg(F.col("cell") % _PAGE).alias("bits"))
    )
    found = {(r.flag, r.page): bytes(r.bits) for r in pages.collect()}
    return marked.sparkSession.sparkContext.broadcast(Flags(found))


# --- scores ---------------------------------------------------------------------


def _wide(c: str) -> Column:
    return F.col(c).cast("decimal(19,0)")


def _score(a: str, left: str, right: str) -> Column:
    """``floor(SCALE * a * a / (l * r))`` in whole numbers of up to 38 digits."""
    top = (_wide(a) * _wide(a)).cast("decimal(31,0)") * F.lit(SCALE).cast("decimal(7,0)")
    return F.call_function("div", top, _wide(left) * _wide(right))


def _with_count(rows: DataFrame, counts: DataFrame, phrase: Column, name: str) -> DataFrame:
    """``rows`` with the count of another phrase of their language."""
    other = counts.select("lang", F.col("phrase").alias("_phrase"), F.col("n").alias(name))
    return split_join(rows.withColumn("_phrase", phrase), other, ["lang", "_phrase"]).drop("_phrase")


def _word(k: int, n: int = 1) -> Column:
    return F.array_join(F.slice(F.split("phrase", " "), k, n), " ")


def _bars(pairs: DataFrame, reach: int) -> DataFrame:
    """``lang, bar``: the score that ``reach`` pairs of the language have at least, about;
    0 if there are not so many."""
    bucket = F.floor(F.log2(F.col("score") + 1) * 64).alias("bucket")
    each = pairs.groupBy("lang", bucket).agg(F.count("*").alias("n"), F.min("score").alias("low"))
    down = Window.partitionBy("lang").orderBy(F.desc("bucket"))
    enough = each.withColumn("sum", F.sum("n").over(down)).groupBy("lang")
    return enough.agg(F.coalesce(F.max(F.when(F.col("sum") >= reach, F.col("low"))), F.lit(0)).alias("bar"))


def mined(docs: DataFrame, most: int = 2000, least: int = 10, share: int = 50, chunk: int = CHUNK) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the first ``most`` phrases of two or three
    words of each language by score, occurrences (both falling) and phrase.

    Texts are lower-cased (A-Z) and split at punctuation and line ends; a phrase lies
    within a piece. Candidates occur ``least`` times or more; one that lies inside a
    longer candidate with ``share`` percent of its occurrences or more is dropped. A null
    or empty text has no words, a null language is ``und``, repeated rows count as often
    as they stand, other columns are not looked at; no rows give no rows.
    """
    texts = docs.select(
        F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text")
    )
    words = materialise(
        _counted(texts, 1, None, chunk).filter((F.col("n") >= least) | (F.col("phrase") == "")), "words"
    )
    often = words.filter("phrase <> ''")
    growing = _frontier(often.withColumn("flags", F.lit(OFTEN)), _sum(F.col("phrase")) * _FIRST, (OFTEN,))
    pairs = _counted(texts, 2, growing, chunk).filter(F.col("n") >= least).withColumnRenamed("n", "a")
    pairs = _with_count(_with_count(pairs, often, _word(1), "l"), often, _word(2), "r")
    pairs = materialise(pairs.withColumn("score", _score("a", "l", "r")), "pairs")

    settled = None
    open_pairs, reach = pairs, most * REACH
    while not open_pairs.isEmpty():
        bars = materialise(_bars(open_pairs, reach), "bars")
        found = _above(texts, open_pairs, often, bars, least, share, chunk)
        best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
        ranked = found.withColumn("rank", F.row_number().over(best).cast("long")).filter(F.col("rank") <= most)
        ranked = materialise(ranked, "ranked")
        counts = ranked.groupBy("lang").agg(F.count("*").alias("n"))
        done = bars.join(counts, "lang", "left").filter((F.col("bar") == 0) | (F.col("n") >= most)).select("lang")
        ranked = ranked.join(done, "lang", "left_semi")
        settled = ranked if settled is None else settled.unionByName(ranked)
        open_pairs = open_pairs.join(done, "lang", "left_anti")
        reach *= reach
    if settled is None:
        settled = pairs.limit(0).withColumn("rank", F.lit(0).cast("long"))
    total = words.filter("phrase = ''").select("lang", "n")
    return settled.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _above(texts, pairs, words, bars, least: int, share: int, chunk: int) -> DataFrame:
    """Phrases that reach the bar of their language and are not dropped."""
    barred = pairs.join(bars, "lang")
    reaches = F.col("score") >= F.col("bar")
    bound = lambda part: F.call_function("div", _wide("a") * F.lit(SCALE).cast("decimal(7,0)"), _wide(part))
    flags = (
        F.lit(OFTEN)
        + F.when(bound("l") >= F.col("bar"), BEGINS).otherwise(0)
        + F.when(bound("r") >= F.col("bar"), ENDS).otherwise(0)
        + F.when(reaches, REACHES).otherwise(0)
    )
    cell = _sum(_word(1)) * _FIRST + _sum(_word(2)) * _SECOND
    marked = barred.select("lang", "phrase", flags.alias("flags"))
    frontier = _frontier(marked, cell, (OFTEN, BEGINS, ENDS, REACHES))
    asked = texts.join(bars.select("lang"), "lang", "left_semi")
    triples = _counted(asked, 3, frontier, chunk).filter(F.col("n") >= least).withColumnRenamed("n", "a")
    triples = materialise(triples, "triples")
    # A pair goes if a triple around it has enough of its occurrences.
    around = (
        triples.select("lang", F.explode(F.array(_word(1, 2), _word(2, 2))).alias("phrase"), F.col("a").alias("n"))
        .groupBy("lang", "phrase")
        .agg(F.max("n").alias("longer"))
    )
    kept = (
        split_join(barred.filter(reaches), around, ["lang", "phrase"], "left")
        .filter(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * share))
        .select("lang", "phrase", "a", "l", "r", "score")
    )
    counts = pairs.select("lang", "phrase", F.col("a").alias("n"))
    cut = _with_count(_with_count(triples, words, _word(1), "l1"), counts, _word(2, 2), "r1")
    cut = _with_count(_with_count(cut, counts, _word(1, 2), "l2"), words, _word(3), "r2")
    cut = cut.withColumns({"s1": _score("a", "l1", "r1"), "s2": _score("a", "l2", "r2")})
    second = F.col("s2") < F.col("s1")
    pick = lambda x: F.when(second, F.col(f"{x}2")).otherwise(F.col(f"{x}1")).alias(x)
    scored = cut.select("lang", "phrase", "a", pick("l"), pick("r"), pick("s").alias("score"))
    scored = scored.join(bars, "lang").filter(reaches).drop("bar")
    return kept.unionByName(scored)
