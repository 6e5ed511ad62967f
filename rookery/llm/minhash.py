"""Near-duplicate documents by MinHash: an inverted join of signature coordinates.

1. Every document becomes a signature: for each hash function the least hash of its
   shingles. Equal sets are one node.
2. Nodes are posted under coordinate-value pairs. Pairs that only one node has are
   skipped. Two nodes above the similarity agree in ``least_matches`` coordinates, but
   for a chance of ``RISK``; so a node with fewer pairs that others have is skipped too,
   and the rest is posted under its rarest pairs only (the prefix): frequent pairs of
   shared passages hardly ever are.
3. Posting lists are merged: first each node with the first node of its lists, which ties
   large groups at the cost of their size; then, in lists whose nodes are not tied yet,
   each node with its best partners; then all pairs that are not tied, compared inside
   the lists. A pair counts in one list only, that of its first common coordinate, and
   only if the signatures agree often enough.
4. Every link is confirmed on the full sets of shingles; links give components.
"""

from __future__ import annotations

import contextlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery.llm.components import components
from rookery.llm.shingles import mix, shingle_sets
from rookery.operators.joins import split_join
from rookery.session import materialise

COORDINATES = 64
#: Chance that a link at the very threshold is not seen; above it far less.
RISK = 1e-9
#: Nodes of a list that one task merges; longer lists are cut into tiles of two chunks.
TILE = 1500
#: Best partners that a node offers in a list before all pairs are compared, and the
#: coordinates whose lists take part in that. Only a matter of cost.
OFFERS, OFFERING = 3, 16
#: Shingles of one side, and nodes of the other, that a confirming task meets together.
HELD_SHINGLES, HELD_NODES = 200_000, 2000
_SLICE = 1 << 14


def least_matches(percent: int, coordinates: int = COORDINATES, risk: float = RISK) -> int:
    """The most coordinates that two sets of this similarity share but for the risk."""
    p, below = percent / 100, 0.0
    for k in range(coordinates + 1):
        below += math.comb(coordinates, k) * p**k * (1 - p) ** (coordinates - k)
        if below > risk:
            return max(k, 1)
    return coordinates


# --- signatures -----------------------------------------------------------------

_ODD = np.random.default_rng(41).integers(1, 1 << 62, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALT = np.random.default_rng(43).integers(1, 1 << 62, COORDINATES, dtype=np.uint64)


def signature(found: np.ndarray) -> np.ndarray:
    """One 64-bit value for each coordinate and its least hash over a set of shingles."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(found), _SLICE):
        least = np.minimum(least, (_ODD[:, None] * mix(found[start : start + _SLICE])).min(1))
    return mix(least ^ _SALT)


def _described(texts: DataFrame, size: int) -> DataFrame:
    """``row, doc_id, text_hash, digest, digest2, n, signature`` of each row, written once."""

    def describe(batches):
        for batch in batches:
            rows = []
            for found in shingle_sets(batch.column(2), size):
                digest = np.array([found.sum(dtype=np.uint64), mix(found).sum(dtype=np.uint64)], np.uint64)
                own = signature(found).view(np.int64) if len(found) else []
                rows.append((*digest.view(np.int64).tolist(), len(found), own))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64())]
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            names = ["doc_id", "text_hash", "digest", "digest2", "n", "signature"]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names)

    kind = texts.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, text_hash long, digest long, digest2 long, n int, signature array<long>"
    found = texts.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(describe, schema)
    return materialise(found.withColumn("row", F.monotonically_increasing_id()), "signatures")


def _posted(nodes: DataFrame, least: int) -> DataFrame:
    """``node, n, signature, prefix`` of the nodes that may have a link, written once. The
    prefix holds ``members, c, token``: number of nodes, coordinate and value."""
    entries = nodes.select("node", F.posexplode("signature").alias("c", "token"))
    members = entries.groupBy("token").agg(F.count("*").alias("members")).filter("members > 1")
    shared = split_join(entries, materialise(members, "members"), ["token"])
    own = F.sort_array(F.collect_list(F.struct("members", "c", "token"))).alias("own")  # of one node
    prefix = F.slice("own", 1, F.size("own") - least + 1).alias("prefix")
    rarest = shared.groupBy("node").agg(own).filter(F.size("own") >= least).select("node", prefix)
    return materialise(rarest.join(nodes.select("node", "n", "signature"), "node"), "posted")


def _texts_of(posted: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """``node, n, text`` of the posted nodes, written once for all confirmations. Spark
    filters the texts by their hashes before it shuffles them; it builds such a filter only
    from a side that is filtered itself."""
    keys = posted.select("node").join(nodes.select("node", "n", "doc_id", "text_hash"), "node")
    keys = materialise(keys.withColumnRenamed("doc_id", "key_id"), "keys")
    found = texts.withColumn("text_hash", F.xxhash64("text")).join(keys.filter("node >= 0"), "text_hash")
    same = found.filter(F.col("doc_id").eqNullSafe(F.col("key_id")))
    return materialise(same.select("node", "n", "text").dropDuplicates(["node"]), "texts")


# --- merging posting lists -------------------------------------------------------


def _fit(percent: int):
    low, high = F.least("n", "m"), F.greatest("n", "m")
    return low * 100 >= high * percent


def _firsts(posted: DataFrame, least: int, percent: int) -> DataFrame:
    """``a, b, token``: pairs of a node and the first node of one of its lists."""
    entries = posted.select("node", "n", F.inline("prefix"))
    first = entries.groupBy("token").agg(F.min(F.struct("node", "n")).alias("first"), F.count("*").alias("held"))
    first = first.filter("held > 1").select("token", F.col("first.node").alias("a"), F.col("first.n").alias("m"))
    pairs = (
        split_join(entries, first, ["token"])
        .filter((F.col("a") < F.col("node")) & _fit(percent))
        .groupBy("a", F.col("node").alias("b"))
        .agg(F.min("token").alias("token"))
    )
    own = posted.select("node", "signature")
    both = split_join(pairs, own.select(F.col("node").alias("a"), F.col("signature").alias("x")), ["a"])
    both = split_join(both, own.select(F.col("node").alias("b"), F.col("signature").alias("y")), ["b"])
    return both.filter(F.size(F.array_intersect("x", "y")) >= least).select("a", "b", "token")


def _lists(posted: DataFrame, labels: DataFrame, coordinates: int) -> DataFrame:
    """``token, i, j, c, chunk, node, n, label, signature, mask`` of the lists of the first
    ``coordinates`` whose nodes are not all tied; ``mask`` has the bits of those that a node
    is posted under. Long lists are cut into tiles by nodes and by shingles."""
    bit = lambda e: F.call_function("shiftleft", F.lit(1).cast("long"), e.c)
    prefix = F.filter("prefix", lambda e: e.c < coordinates)
    mask = F.aggregate(prefix, F.lit(0).cast("long"), lambda x, e: x.bitwiseOR(bit(e)))
    known = posted.join(labels, "node", "left").withColumn("label", F.coalesce("component", "node"))
    known = materialise(
        known.select("node", "n", "label", _folded().alias("signature"), mask.alias("mask"), prefix.alias("prefix")), "known"
    )
    entries = known.select("node", "n", "label", F.inline("prefix")).drop("members")
    open_lists = (
        entries.groupBy("token")
        .agg(
            F.greatest(F.ceil(F.count("*") / TILE), F.ceil(F.sum("n") / HELD_SHINGLES)).cast("int").alias("chunks"),
            F.min("label").alias("low"),
            F.max("label").alias("high"),
        )
        .filter("low <> high")
        .select("token", "chunks")
    )
    tiled = (
        split_join(entries, open_lists, ["token"])
        .withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("token", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "c", "chunk", "node")
    )
    return split_join(tiled, known.drop("prefix"), ["node"])


def _folded():
    """The signature in 32 bits for each coordinate."""
    low = lambda v: F.shiftright(v, 32).cast("int")
    return F.transform("signature", low)


def merged(c: int, left: tuple, right: tuple | None, least: int, percent: int) -> Iterator[tuple[int, int, int]]:
    """``a, b, matches`` of the pairs of a list of coordinate ``c`` that are not tied, may
    be linked by size and matches, and have ``c`` as their first common coordinate.

    Sides are arrays ``node, n, label, signature, mask``; without ``right`` the pairs of
    ``left`` with itself."""
    bits = (np.uint64(1) << np.arange(COORDINATES, dtype=np.uint64))[None, :]
    whole = right if right is not None else left
    masks = (whole[4].view(np.uint64)[:, None] & bits) != 0
    for k in range(len(left[0])):
        at = slice(k + 1, None) if right is None else slice(None)
        n, m = left[1][k], whole[1][at]
        close = (whole[2][at] != left[2][k]) & (m * 100 >= n * percent) & (n * 100 >= m * percent)
        rows = np.flatnonzero(close) + (k + 1 if right is None else 0)
        if not len(rows):
            continue
        same = whole[3][rows] == left[3][k]
        matches = same.sum(1)
        rows, same, matches = (x[matches >= least] for x in (rows, same, matches))
        own = (left[4].view(np.uint64)[k] & bits[0]) != 0
        first = (same & masks[rows] & own).argmax(1) == c
        a = left[0][k]
        for b, count in zip(whole[0][rows[first]].tolist(), matches[first].tolist(), strict=True):
            yield (min(a, b), max(a, b), count)


def _offered(pairs: list[tuple[int, int, int]], most: int) -> set[tuple[int, int]]:
    """The best ``most`` pairs of each node."""
    taken: dict[int, int] = {}
    kept = set()
    for a, b, _ in sorted(pairs, key=lambda p: (-p[2], p)):
        if taken.get(a, 0) < most or taken.get(b, 0) < most:
            kept.add((a, b))
            taken[a] = taken.get(a, 0) + 1
            taken[b] = taken.get(b, 0) + 1
    return kept


_ENTRY = ("token", "i", "j", "c", "chunk", "node", "n", "label", "signature", "mask")


def _tiles(batches, sets=None) -> Iterator[tuple[tuple, dict[int, list[tuple]]]]:
    """Key and chunks of each tile of rows that are sorted by tile; with ``sets`` (a
    function of the last column) each entry ends with the set of its text."""
    current: tuple | None = None
    chunks: dict[int, list[tuple]] = {}
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in range(len(_ENTRY))]
        more = sets(batch.column(len(_ENTRY))) if sets else [None] * batch.num_rows
        for *key, chunk, node, n, label, signature_, mask, own in zip(*columns, more, strict=True):
            if tuple(key) != current:
                if current is not None:
                    yield current, chunks
                current, chunks = tuple(key), {}
            chunks.setdefault(chunk, []).append((node, n, label, signature_, mask, own))
    if current is not None:
        yield current, chunks


def _pairs_of(key: tuple, chunks: dict[int, list[tuple]], least: int, percent: int) -> Iterator[tuple[int, int, int]]:
    _, i, j, c = key
    sides = [
        tuple(np.array(x, np.int64) for x in list(zip(*chunks[k], strict=True))[:5]) for k in sorted(chunks)
    ]
    if i == j or len(sides) == 2:
        yield from merged(c, sides[0], None if i == j else sides[1], least, percent)


def _batch(rows: list[tuple], names: tuple[str, ...], kinds: tuple | None = None) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    kinds = kinds or (pa.int64(),) * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], list(names))


def _by_tile(rows: DataFrame) -> DataFrame:
    return rows.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j")


def _offers(lists: DataFrame, least: int, percent: int, most: int) -> DataFrame:
    """``a, b, token``: the best ``most`` pairs of each node of a list."""

    def search(batches):
        for key, chunks in _tiles(batches):
            pairs = _offered(list(_pairs_of(key, chunks, least, percent)), most)
            yield _batch([(*p, key[0]) for p in pairs], ("a", "b", "token"))

    return _by_tile(lists.select(*_ENTRY)).mapInArrow(search, "a long, b long, token long")


def _compared(lists: DataFrame, own: DataFrame, size: int, least: int, percent: int) -> DataFrame:
    """Links between nodes that are not tied, of all pairs of the lists.

    Nodes with a pair in a tile fetch their text for it, once however many the pairs; the
    pairs are compared there by their full sets. A pair whose ends the tile has tied by
    then is left out, and only links leave the task."""
    place = ("token", "i", "j", "node")

    def search(batches):
        for key, chunks in _tiles(batches):
            nodes = {node for a, b, _ in _pairs_of(key, chunks, least, percent) for node in (a, b)}
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64())
            yield _batch([(*key[:3], node) for node in sorted(nodes)], place, kinds)

    lists = materialise(lists.select(*_ENTRY), "lists")
    asked = materialise(_by_tile(lists).mapInArrow(search, "token long, i int, j int, node long"), "asked")
    rows = split_join(split_join(lists, asked, list(place)), own.select("node", "text"), ["node"])

    def compare(batches):
        for key, chunks in _tiles(batches, lambda texts: shingle_sets(texts, size)):
            entries = {e[0]: e for part in chunks.values() for e in part}
            root = {e[2]: e[2] for e in entries.values()}

            def find(label: int, root=root) -> int:
                while root[label] != label:
                    root[label] = label = root[root[label]]
                return label

            links = []
            for a, b, _ in _pairs_of(key, chunks, least, percent):
                x, y = find(entries[a][2]), find(entries[b][2])
                if x != y and _linked(entries[a][5], entries[b][5], percent):
                    root[max(x, y)] = min(x, y)
                    links.append((a, b))
            yield _batch(links, ("a", "b"))

    return _by_tile(rows.select(*_ENTRY, "text")).mapInArrow(compare, "a long, b long")


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= percent * (len(x) + len(y) - common)


# --- full sets -------------------------------------------------------------------


def _confirmed(pairs: DataFrame, own: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (``a, b, token``) whose full sets reach the similarity.

    The pairs of a list are dealt to groups of some nodes ``a`` with some nodes ``b``; a
    text travels once to each group that it is in, and a task holds the sets of one side
    of a group only, of a bounded number of shingles."""
    sizes = own.select(F.col("node").alias("a"), "n")
    firsts = pairs.select("token", "a").distinct().join(sizes, "a")
    sides = firsts.groupBy("token").agg(F.ceil(F.sum("n") / HELD_SHINGLES).alias("rows"))
    others = pairs.select("token", "b").distinct().groupBy("token").agg(F.ceil(F.count("*") / HELD_NODES).alias("columns"))
    dealt = split_join(pairs, sides.join(others, "token"), ["token"]).select(
        "a", "b", "token",
        F.pmod(F.xxhash64("a"), F.col("rows")).alias("i"),
        F.pmod(F.xxhash64(F.col("b"), F.lit(1)), F.col("columns")).alias("j"),
    )
    dealt = materialise(dealt, "dealt")
    none = F.array().cast("array<long>")
    asked = dealt.select("token", "i", "j", F.col("a").alias("node")).distinct().withColumn("partners", none)
    # Partners of b within a group, as many as the group has nodes a.
    against = dealt.groupBy("token", "i", "j", F.col("b").alias("node")).agg(F.collect_list("a").alias("partners"))
    rows = split_join(asked.unionByName(against), own.select("node", "text"), ["node"])

    def compare(batches):
        current, held = None, {}
        for batch in batches:
            sets = shingle_sets(batch.column(5), size)
            keys = zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True)
            found = []
            for (token, i, j, node, partners), own in zip(keys, sets, strict=True):
                if (token, i, j) != current:
                    current, held = (token, i, j), {}
                if not partners:
                    held[node] = own
                found += [(a, node) for a in partners if _linked(held[a], own, percent)]
            yield _batch(found, ("a", "b"))

    return (
        rows.withColumn("second", F.size("partners") > 0)
        .select("token", "i", "j", "node", "partners", "text", "second")
        .repartition("token", "i", "j")
        .sortWithinPartitions("token", "i", "j", "second")
        .mapInArrow(compare, "a long, b long")
    )


# --- the whole -------------------------------------------------------------------


def _tied(posted: DataFrame, own: DataFrame, size: int, percent: int) -> DataFrame:
    """``node, component`` of the nodes that have a link."""
    least = least_matches(percent)
    pairs = materialise(_firsts(posted, least, percent), "pairs")
    labels = _more(None, _confirmed(pairs, own, size, percent))
    tried = pairs.select("a", "b")
    offers = _offers(_lists(posted, labels, OFFERING), least, percent, OFFERS)
    offers = offers.groupBy("a", "b").agg(F.min("token").alias("token")).join(tried, ["a", "b"], "left_anti")
    labels = _more(labels, _confirmed(materialise(offers, "pairs"), own, size, percent))
    return _more(labels, _compared(_lists(posted, labels, COORDINATES), own, size, least, percent))


def _more(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """The labels with further links."""
    links = materialise(links, "links")
    if labels is not None:
        if links.isEmpty():
            return labels
        links = labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links)
    return materialise(components(links), "labels")


#: Look-ups of few rows filter the other side by a Bloom filter of 1 MB (Spark's own size; one
#: of 8 MB took the driver above 1,500 MB), also where the keys are a larger table.
_FILTERS = {"creationSideThreshold": "256MB"}


@contextlib.contextmanager
def _filtered(spark: SparkSession) -> Iterator[None]:
    """Filters also from larger tables while the jobs of a block run."""
    names = {f"spark.sql.optimizer.runtime.bloomFilter.{k}": v for k, v in _FILTERS.items()}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def deduplicated(docs: DataFrame, size: int = 5, percent: int = 85) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of each row of ``docs``.

    Rows link when ``100 * intersection >= percent * union`` of their sets of shingles of
    ``size`` words; ``component_id`` is the least ``doc_id`` reachable by links and ``kept``
    says whether it is the row's own. A null or empty text, or one without words, has no
    shingles and links with nothing; rows with one id and different texts are told apart;
    a null id takes part and never names a component, unless all ids are null. Repeated
    rows stay repeated; other columns are not looked at; no rows, no rows.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    described = _described(texts, size)
    filled = described.filter("n > 0")
    sets = materialise(filled.groupBy("digest", "digest2").agg(F.min("row").alias("node")), "sets")
    nodes = filled.join(sets.select(F.col("node").alias("row")), "row", "left_semi").withColumnRenamed("row", "node")
    nodes = materialise(nodes.select("node", "doc_id", "text_hash", "n", "signature"), "nodes")
    with _filtered(docs.sparkSession):
        posted = _posted(nodes, least_matches(percent))
        groups = _tied(posted, _texts_of(posted, nodes, texts), size, percent)
    rows = split_join(filled.select("row", "doc_id", "digest", "digest2"), sets, ["digest", "digest2"])
    grouped = split_join(rows.select("row", "doc_id", "node"), groups, ["node"], "left").select(
        "row", "doc_id", F.coalesce("component", "node").alias("component")
    )
    grouped = materialise(grouped, "grouped")
    first = grouped.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    member = split_join(grouped, first, ["component"]).select("row", "component_id")
    named = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return described.select("row", "doc_id", "n").join(member, "row", "left").select(
        "doc_id",
        F.col("n").cast("long").alias("n_shingles"),
        named.alias("component_id"),
        F.col("doc_id").eqNullSafe(named).alias("kept"),
    )
