"""Join of documents whose sets of word shingles are alike, by signature trees.

Exact for any data. The steps:

1. Every document becomes its set of shingle hashes; equal sets are one node.
2. Two sets above the threshold share a shingle among the first few of each in one
   common order (the prefix). Very frequent shingles, told by a sketch of fixed
   size, come last in that order. Nodes with a shingle in their prefixes form a block.
3. Large groups of copies are tied first: nodes with equal minima of a hash function
   are compared with one anchor each, so a group costs its size and no pairs.
4. Blocks whose nodes are not all tied are searched by signature trees: leaves hold
   token bitmaps and sizes, inner nodes OR-combined bitmaps and size ranges, and a
   dual traversal drops pairs of nodes by the largest overlap they can have.
5. Pairs that are left are compared by their whole sets; links give components. In a
   round every node first offers its most promising pairs of a block; when these have
   tied what belongs together, the rest of the block is searched by wider bitmaps. The
   few pairs that these leave count once, in however many blocks they are; a block with
   many such pairs is compared in full.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rookery.llm.common import WORD
from rookery.llm.components import components
from rookery.llm.shingles import mix, shingle_sets
from rookery.operators.joins import split_join
from rookery.session import materialise

#: log2 of the cells of the frequency sketch: its size is fixed, whatever the data.
SKETCH_BITS = 18
#: Hash functions whose minima tie large groups beforehand. Only a matter of cost.
MINIMA = 6
#: Nodes of a block that one task compares; larger blocks are cut into tiles.
TILE = 2000
LEAF = 8
#: Pairs that a node offers in a block, and rounds before all pairs are compared that are
#: not tied by then. Only a matter of cost.
OFFERS, ROUNDS = 2, 1
#: Pairs for each node of a tile that leave it to be compared; with more, the texts of all
#: nodes come to the tile. Only a matter of cost.
FEW = 4
#: Bits for each shingle in the bitmaps of the blocks that are compared in full.
WIDE, MOST_BITS = 16, 1 << 15


def needed(left: int, right: int, percent: int) -> int:
    """Least overlap at which sets of these sizes are linked."""
    return -(-percent * (left + right) // (100 + percent))


# --- signature trees -----------------------------------------------------------


def fold(bits: int, width: int, to: int) -> int:
    """A bitmap of ``width`` bits with the hashes taken modulo ``to``."""
    while width > to:
        width //= 2
        bits = (bits >> width) | (bits & ((1 << width) - 1))
    return bits


class Tree:
    """Node of a signature tree over entries (size, label, node, bitmap) sorted by size.

    ``slack`` is the most tokens of an entry that share their bit with another one, so
    an entry has at most ``slack`` plus its common bits in common with anything.
    ``label`` is the label of all entries or None."""

    __slots__ = ("bits", "high", "items", "label", "low", "parts", "slack")

    def __init__(self, entries: list[tuple[int, int, int, int]]):
        self.low, self.high = entries[0][0], entries[-1][0]
        self.parts: tuple[Tree, Tree] | None = None
        self.items = entries
        if len(entries) > LEAF:
            middle = len(entries) // 2
            self.parts = Tree(entries[:middle]), Tree(entries[middle:])
            left, right = self.parts
            self.bits = left.bits | right.bits
            self.slack = max(left.slack, right.slack)
            self.label = left.label if left.label == right.label else None
        else:
            self.bits, self.slack = 0, 0
            for size, _, _, bits in entries:
                self.bits |= bits
                self.slack = max(self.slack, size - bits.bit_count())
            labels = {e[1] for e in entries}
            self.label = labels.pop() if len(labels) == 1 else None


def search(left: Tree, right: Tree, percent: int) -> Iterator[tuple[int, int, float]]:
    """Pairs of entries with different labels that may reach the threshold, with the
    share that they may have in common at most. The same tree on both sides is searched
    against itself, each pair once."""
    stack = [(left, right)]
    while stack:
        x, y = stack.pop()
        if x.label is not None and x.label == y.label:
            continue
        if x.high * 100 < percent * y.low or y.high * 100 < percent * x.low:
            continue
        most = min(x.slack, y.slack) + (x.bits & y.bits).bit_count()
        if most < needed(x.low, y.low, percent):
            continue
        if x is y:
            if x.parts:
                a, b = x.parts
                stack += [(a, a), (b, b), (a, b)]
            else:
                for k, one in enumerate(x.items):
                    yield from _pairs([one], x.items[k + 1 :], percent)
        elif x.parts and (not y.parts or len(x.items) >= len(y.items)):
            stack += [(part, y) for part in x.parts]
        elif y.parts:
            stack += [(x, part) for part in y.parts]
        else:
            yield from _pairs(x.items, y.items, percent)


def _pairs(left, right, percent: int) -> Iterator[tuple[int, int, float]]:
    for n, label, node, bits in left:
        slack = n - bits.bit_count()
        for m, other_label, other, other_bits in right:
            if label == other_label or n * 100 < percent * m or m * 100 < percent * n:
                continue
            most = min(slack, m - other_bits.bit_count()) + (bits & other_bits).bit_count()
            if most >= needed(n, m, percent):
                share = most / (n + m)
                yield (node, other, share) if node < other else (other, node, share)


def width_of(size: int) -> int:
    """Bits of the bitmap of a set: a power of two near its size."""
    return 1 << max(6, (size * 2 // 3).bit_length())


def wider_of(size: int) -> int:
    """Bits of the wider bitmap of a set: two to four for each token, so that sets with
    four fifths in common and less are mostly told apart."""
    return 1 << max(6, (size * 2).bit_length())


def candidates(
    entries: list[tuple[int, int, int, int]], percent: int, width_by: Callable[[int], int] = width_of
) -> Iterator[tuple[int, int, float]]:
    """Candidate pairs among entries of any sizes: one tree for each bitmap width, and
    one of the wider neighbours' bitmaps folded, as linked sizes may differ."""
    by_width: dict[int, list] = {}
    for entry in sorted(entries):
        by_width.setdefault(width_by(entry[0]), []).append(entry)
    for width, own in by_width.items():
        tree = Tree(own)
        yield from search(tree, tree, percent)
        limit = own[-1][0]
        for wide, others in by_width.items():
            if wide <= width:
                continue
            close = [
                (n, label, node, fold(bits, wide, width))
                for n, label, node, bits in others
                if n * percent <= limit * 100
            ]
            if close:
                yield from search(tree, Tree(close), percent)


# --- profiles ------------------------------------------------------------------


def _sketch(texts: DataFrame, size: int) -> np.ndarray:
    """Class of frequency of each cell of the hash range: 0 for all but cells that hold
    far more shingles than the mean. Gathers one number per cell, whatever the data."""
    cells = 1 << SKETCH_BITS
    shift = np.uint64(64 - SKETCH_BITS)

    def count(batches):
        total = np.zeros(cells, np.int64)
        for batch in batches:
            found = np.concatenate([*shingle_sets(batch.column(0), size), np.empty(0, np.uint64)])
            total += np.bincount((found >> shift).astype(np.int64), minlength=cells)
        at = np.flatnonzero(total)
        columns = [pa.array(at.astype(np.int32)), pa.array(total[at])]
        yield pa.RecordBatch.from_arrays(columns, ["cell", "n"])

    counted = (
        texts.select("text").mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    ).toArrow()
    total = np.zeros(cells, np.int64)
    total[counted.column("cell").to_numpy()] = counted.column("n").to_numpy()
    mean = max(total.mean(), 1.0)
    return np.ceil(np.log2(np.maximum(total / (2 * mean), 1.0))).astype(np.int8)


def profiles(texts: DataFrame, size: int, percent: int) -> DataFrame:
    """What the join needs of each row, written once: ``row`` (its number), ``doc_id``,
    ``text_hash``, ``digest`` and ``digest2`` of the set, ``n``, ``prefix``, ``minima``
    and ``bitmap``."""
    classes = texts.sparkSession.sparkContext.broadcast(_sketch(texts, size))
    shift = np.uint64(64 - SKETCH_BITS)
    odd = np.random.default_rng(7).integers(1, 1 << 62, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def describe(batches):
        rare = classes.value
        for batch in batches:
            rows: list[tuple] = []
            for found in shingle_sets(batch.column(2), size):
                n = len(found)
                kept = n - -(-percent * n // 100) + 1 if n else 0
                order = np.lexsort((found, rare[(found >> shift).astype(np.int64)]))[:kept]
                minima = [(found * m).min() for m in odd] if n else []
                signed = lambda x: np.asarray(x, np.uint64).view(np.int64)
                digest = signed([found.sum(dtype=np.uint64), mix(found).sum(dtype=np.uint64)])
                bitmap = _packed(found, width_of(n) if n else 64)
                rows.append((*digest, n, signed(found[order]), signed(minima), bitmap))
            names = ["digest", "digest2", "n", "prefix", "minima", "bitmap"]
            longs = pa.list_(pa.int64())
            kinds = [pa.int64(), pa.int64(), pa.int32(), longs, longs, pa.binary()]
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            first = [batch.column(0), batch.column(1)]
            yield pa.RecordBatch.from_arrays([*first, *arrays], ["doc_id", "text_hash", *names])

    kind = texts.schema["doc_id"].dataType.simpleString()
    described = texts.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(
        describe,
        f"doc_id {kind}, text_hash long, digest long, digest2 long, n int, "
        "prefix array<long>, minima array<long>, bitmap binary",
    )
    return materialise(described.withColumn("row", F.monotonically_increasing_id()), "profiles")


# --- comparing pairs ------------------------------------------------------------


def _found(asked: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """``node, text`` of the asked nodes. While these are few, Spark filters the texts by
    their hashes before it shuffles them; repeated rows meet where they are joined."""
    place = ["text_hash", "place"]
    keys = materialise(asked.join(nodes.select("node", "doc_id", "text_hash"), "node"), "asked")
    keys = keys.filter("node >= 0").withColumn("place", F.xxhash64("doc_id")).withColumnRenamed("doc_id", "key_id")
    rows = texts.withColumns({"text_hash": F.xxhash64("text"), "place": F.xxhash64("doc_id")}).join(keys, place)
    none = F.col("doc_id").isNull() & F.col("key_id").isNull()
    same = rows.filter(F.coalesce(F.col("doc_id") == F.col("key_id"), none))
    return same.select(*place, "node", "text").dropDuplicates([*place, "node"]).select("node", "text")


def _texts(asked: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """``node, text`` of the asked nodes, written once."""
    return materialise(_found(asked, nodes, texts), "texts")


def _verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (distinct nodes a, b) whose whole sets reach the threshold.
    Only texts of nodes in a pair are moved, to the pairs of each node."""
    own = _texts(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), nodes, texts)
    left = split_join(pairs, own.select(F.col("node").alias("a"), F.col("text").alias("x")), ["a"])
    both = split_join(left, own.select(F.col("node").alias("b"), F.col("text").alias("y")), ["b"])

    def compare(batches):
        for batch in batches:
            x = shingle_sets(batch.column(2), size)
            y = shingle_sets(batch.column(3), size)
            linked = []
            for p, q in zip(x, y, strict=True):
                common = len(np.intersect1d(p, q, assume_unique=True))
                linked.append(100 * common >= percent * (len(p) + len(q) - common))
            mask = pa.array(linked, pa.bool_())
            columns = [batch.column(k).filter(mask) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b"])

    return both.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long")


def _widened(asked: DataFrame, nodes: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """``node, bitmap``: the wider bitmaps of the asked nodes, written once."""

    def describe(batches):
        for batch in batches:
            maps = [_packed(found, wider_of(len(found))) for found in shingle_sets(batch.column(1), size)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(maps, pa.binary())], ["node", "bitmap"])

    return materialise(_found(asked, nodes, texts).mapInArrow(describe, "node long, bitmap binary"), "widened")


def _compared(
    blocks: DataFrame, labels: DataFrame, nodes: DataFrame, texts: DataFrame, size: int, percent: int
) -> DataFrame:
    """Links between nodes of the given tiles that are not tied: all pairs that the wider
    bitmaps leave, by whole sets. Texts go to the distinct pairs, as a node may be in as many
    tiles as its prefix is long; they go to tiles only where these have many pairs."""
    wider = _widened(blocks.select("node").distinct(), nodes, texts, size)
    found = materialise(_searched(blocks, labels, wider, percent, None, wider_of), "searched")
    pairs = materialise(found.filter("a is not null").select("a", "b").distinct(), "pairs")
    links = _verified(pairs, nodes, texts, size, percent)
    rest = found.filter("a is null").select("shingle", "i", "j")
    if rest.isEmpty():
        return links
    dense = materialise(split_join(blocks, rest, ["shingle", "i", "j"]), "dense")
    own = _texts(dense.select("node").distinct(), nodes, texts)
    return links.unionByName(_compared_whole(dense, labels, own, size, percent))


def _compared_whole(blocks: DataFrame, labels: DataFrame, own: DataFrame, size: int, percent: int) -> DataFrame:
    """Links between nodes of the given tiles that are not tied, of all pairs of a tile. A
    link whose ends the tile has tied is not given."""
    labelled = split_join(blocks, labels, ["node"], "left").withColumn(
        "label", F.coalesce("component", F.col("node"))
    )
    rows = split_join(labelled, own, ["node"])

    def linked(same: bool, chunks: dict[int, list]) -> Iterator[tuple[int, int]]:
        entries = [e for c in chunks.values() for e in c]
        first = {e[2] for e in chunks[min(chunks)]}
        sets = {e[2]: e[3] for e in entries}
        widest = min(WIDE * (1 << max(e[0] for e in entries).bit_length()), MOST_BITS)
        tied = {e[2]: e[1] for e in entries}
        root = {label: label for label in tied.values()}

        def find(label: int) -> int:
            while root[label] != label:
                root[label] = label = root[root[label]]
            return label

        marked = [(n, label, node, _bitmap(found, widest)) for n, label, node, found in entries]
        tree = Tree(sorted(marked))
        for a, b, _ in search(tree, tree, percent):
            if not same and (a in first) == (b in first):
                continue
            x, y = find(tied[a]), find(tied[b])
            if x == y:
                continue
            common = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
            if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                root[max(x, y)] = min(x, y)
                yield a, b

    def compare(batches):
        current, chunks = None, {}

        def close():
            if current is None or len({e[1] for c in chunks.values() for e in c}) < 2:
                return []
            return list(linked(current[1] == current[2], chunks))

        def result(found):
            columns = list(zip(*found, strict=True)) or [(), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b"])

        for batch in batches:
            sets = shingle_sets(batch.column(6), size)
            columns = [batch.column(k).to_pylist() for k in range(6)]
            for shingle, i, j, chunk, node, label, found in zip(*columns, sets, strict=True):
                if (shingle, i, j) != current:
                    yield result(close())
                    current, chunks = (shingle, i, j), {}
                chunks.setdefault(chunk, []).append((len(found), label, node, found))
        yield result(close())

    return (
        rows.select("shingle", "i", "j", "chunk", "node", "label", "text")
        .repartition("shingle", "i", "j")
        .sortWithinPartitions("shingle", "i", "j")
        .mapInArrow(compare, "a long, b long")
        .distinct()
    )


def _packed(found: np.ndarray, width: int) -> bytes:
    cells = np.zeros(width, np.uint8)
    cells[(found & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(cells, bitorder="little").tobytes()


def _bitmap(found: np.ndarray, width: int) -> int:
    return int.from_bytes(_packed(found, width), "little")


def _fit(n: Column | str, m: Column | str, percent: int) -> Column:
    n, m = (F.col(c) if isinstance(c, str) else c for c in (n, m))
    return (n * 100 >= m * percent) & (m * 100 >= n * percent)


def _anchored(nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs of a node and the least node with a common minimum and a size near its own."""
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)))
    entries = nodes.select(
        "node", "n", band.alias("band"), F.posexplode("minima").alias("which", "value")
    )
    key = ["which", "value", "band"]
    anchors = entries.groupBy(*key).agg(
        F.min(F.struct("node", "n")).alias("anchor"), F.count("*").alias("members")
    )
    shared = anchors.filter("members > 1").select(
        *key, F.col("anchor.node").alias("a"), F.col("anchor.n").alias("m")
    )
    return (
        split_join(entries, shared, key)
        .filter((F.col("a") < F.col("node")) & _fit("n", "m", percent))
        .select("a", F.col("node").alias("b"))
        .distinct()
    )


def _blocks(nodes: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Rows of the blocks to be searched: ``shingle, i, j, chunk, node, n``.
    Blocks whose nodes are tied already, or too far apart in size, are left out by sums
    over the block, and of blocks with the same nodes all but one; blocks above ``TILE`` nodes are cut into tiles of two chunks."""
    labelled = nodes.join(labels, "node", "left").withColumn(
        "label", F.coalesce("component", F.col("node"))
    )
    entries = labelled.select("node", "label", "n", F.explode("prefix").alias("shingle"))
    sums = (
        entries.groupBy("shingle")
        .agg(
            F.count("*").alias("members"),
            F.min("label").alias("first"),
            F.max("label").alias("last"),
            F.min("n").alias("low"),
            F.max("n").alias("high"),
            *(F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"same{k}") for k in (0, 1)),
        )
        .filter("first <> last")
        .filter((F.col("members") > 2) | _fit("low", "high", percent))
        .groupBy("members", "same0", "same1")
        .agg(F.min("shingle").alias("shingle"))
        .select("shingle", F.ceil(F.col("members") / TILE).cast("int").alias("chunks"))
    )
    chunk = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    return (
        split_join(entries, sums, ["shingle"])
        .withColumn("chunk", chunk)
        .withColumn("other", other)
        .select(
            "shingle",
            F.least("chunk", "other").alias("i"),
            F.greatest("chunk", "other").alias("j"),
            "chunk",
            "node",
            "n",
        )
    )


def _offered(pairs: Iterator[tuple[int, int, float]], most: int) -> tuple[set[tuple[int, int]], bool]:
    """The ``most`` best pairs of each node, and whether there are others."""
    best: dict[int, list[tuple[float, int, int]]] = {}
    count = 0
    for a, b, share in pairs:
        count += 1
        for node in (a, b):
            own = best.setdefault(node, [])
            own.append((share, a, b))
            if len(own) > 4 * most:
                own.sort(reverse=True)
                del own[most:]
    kept = {(a, b) for own in best.values() for _, a, b in sorted(own, reverse=True)[:most]}
    return kept, len(kept) < count


def _all_if_few(pairs: Iterator[tuple[int, int, float]], most: int) -> tuple[set[tuple[int, int]], bool]:
    """All pairs, or none if there are more than ``most``, and whether there are others."""
    kept = set()
    for a, b, _ in pairs:
        kept.add((a, b))
        if len(kept) > most:
            return set(), True
    return kept, False


def _searched(
    blocks: DataFrame,
    labels: DataFrame,
    nodes: DataFrame,
    percent: int,
    offers: int | None,
    width_by: Callable[[int], int] = width_of,
) -> DataFrame:
    """Candidate pairs ``a, b`` that the nodes of all tiles offer (without ``offers`` all of a
    tile, if they are few), and rows ``shingle, i, j`` of the tiles that have more pairs than
    that."""
    labelled = blocks.join(labels, "node", "left").withColumn(
        "label", F.coalesce("component", F.col("node"))
    )
    rows = labelled.join(nodes.select("node", "bitmap"), "node")

    def pairs_of(same: bool, chunks: dict[int, list]) -> Iterator[tuple[int, int, float]]:
        if same:
            for entries in chunks.values():
                yield from candidates(entries, percent, width_by)
        elif len(chunks) == 2:
            first = {e[2] for e in chunks[min(chunks)]}
            for a, b, share in candidates([e for c in chunks.values() for e in c], percent, width_by):
                if (a in first) != (b in first):
                    yield a, b, share

    def search_tiles(batches):
        current, chunks, out = None, {}, []

        def close():
            if current is None or len({e[1] for c in chunks.values() for e in c}) < 2:
                return
            pairs = pairs_of(current[1] == current[2], chunks)
            if offers is None:
                kept, more = _all_if_few(pairs, FEW * sum(len(c) for c in chunks.values()))
            else:
                kept, more = _offered(pairs, offers)
            out.extend((a, b, None, None, None) for a, b in kept)
            if more:
                out.append((None, None, *current))

        def result():
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = [pa.int64()] * 3 + [pa.int32()] * 2
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, ["a", "b", "shingle", "i", "j"])

        for batch in batches:
            names = ("shingle", "i", "j", "chunk", "node", "label", "n", "bitmap")
            columns = [batch.column(name).to_pylist() for name in names]
            for shingle, i, j, chunk, node, label, n, bitmap in zip(*columns, strict=True):
                if (shingle, i, j) != current:
                    close()
                    current, chunks = (shingle, i, j), {}
                    if len(out) > 50_000:
                        yield result()
                        out = []
                entry = (n, label, node, int.from_bytes(bitmap, "little"))
                chunks.setdefault(chunk, []).append(entry)
        close()
        yield result()

    return (
        rows.select("shingle", "i", "j", "chunk", "node", "label", "n", "bitmap")
        .repartition("shingle", "i", "j")
        .sortWithinPartitions("shingle", "i", "j")
        .mapInArrow(search_tiles, "a long, b long, shingle long, i int, j int")
    )


def _linked(nodes: DataFrame, labels: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Components of all nodes with a link, beginning with those that are tied."""
    blocks = materialise(_blocks(nodes, labels, percent), "blocks")
    open_blocks, rounds, new = blocks, 0, True
    while True:
        if new and rounds < ROUNDS:
            found = materialise(_searched(open_blocks, labels, nodes, percent, OFFERS), "searched")
            pairs = materialise(found.filter("a is not null").select("a", "b").distinct(), "pairs")
            links = _verified(pairs, nodes, texts, size, percent)
            rest = found.filter("a is null").select("shingle", "i", "j")
        else:  # all that is not tied by now
            links, rest = _compared(open_blocks, labels, nodes, texts, size, percent), None
        links = materialise(links, "links")
        new = not links.isEmpty()
        if new:
            known = labels.select(F.col("node").alias("a"), F.col("component").alias("b"))
            labels = materialise(components(known.unionByName(links)), "labels")
        if rest is None or rest.isEmpty():
            return labels
        rounds += 1
        open_blocks = split_join(blocks, rest, ["shingle", "i", "j"])


def similar(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of each row of ``docs``.

    Rows link when ``100 * intersection >= percent * union`` of their sets of shingles
    of ``size`` words; ``component_id`` is the least ``doc_id`` reachable by links. A
    null or empty text, or one without words, has no shingles and links with nothing;
    rows with one id and different texts are told apart and may be in two components;
    a null id takes part and never names a component, unless all ids are null.
    Repeated rows stay repeated; other columns are not looked at; no rows, no rows.
    """
    described, grouped = _grouped(docs, size, percent)
    least = grouped.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    member = split_join(grouped, least, ["component"]).select("row", "component_id")
    return described.select("row", "doc_id", "n").join(member, "row", "left").select(
        "doc_id",
        F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def one_of_each(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The rows of ``docs`` without all but one of each component, with all columns.

    The one with the least ``doc_id`` stays (null last, rows with one id by the text's
    hash); of equal rows one stays. Rows without shingles all stay.
    """
    _, grouped = _grouped(docs, size, percent)
    order = lambda: F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    kept = grouped.groupBy("component").agg(F.min(order()).alias("key")).select("key")
    gone = materialise(
        grouped.select(order().alias("key")).distinct().join(kept, "key", "left_anti"), "gone"
    )
    text = F.coalesce("text", F.lit(""))
    key = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", F.xxhash64(text).alias("text_hash"))
    packed = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"),
        key.alias("key"),
        text.rlike(WORD).alias("filled"),
    )
    rest = packed.join(gone, "key", "left_anti").withColumn(
        "copy", F.row_number().over(Window.partitionBy("key").orderBy("filled"))
    )
    return rest.filter(~F.col("filled") | (F.col("copy") == 1)).select("doc.*")


def _grouped(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The profiles of all rows, and ``row, doc_id, text_hash, component`` of those that
    have shingles."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    described = profiles(texts, size, percent)
    filled = described.filter("n > 0")
    # Equal sets are one node: the first row that has the set.
    sets = filled.groupBy("digest", "digest2").agg(F.min("row").alias("node"))
    sets = materialise(sets, "sets")
    nodes = materialise(
        filled.join(sets.select(F.col("node").alias("row")), "row", "left_semi").withColumnRenamed(
            "row", "node"
        ),
        "nodes",
    )
    tied = _verified(_promising(_anchored(nodes, percent), nodes, percent), nodes, texts, size, percent)
    tied = materialise(tied, "tied")
    labels = materialise(components(tied), "labels")
    groups = _linked(nodes, labels, texts, size, percent)
    named = split_join(
        filled.select("row", "doc_id", "text_hash", "digest", "digest2"), sets, ["digest", "digest2"]
    ).select("row", "doc_id", "text_hash", "node")
    grouped = split_join(named, groups, ["node"], "left").select(
        "row", "doc_id", "text_hash", F.coalesce("component", F.col("node")).alias("component")
    )
    return described, materialise(grouped, "grouped")


def _promising(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs that the bitmaps do not rule out."""
    half = nodes.select("node", "n", "bitmap")
    left = half.select(F.col("node").alias("a"), F.col("n").alias("m"), F.col("bitmap").alias("p"))
    right = half.select(F.col("node").alias("b"), F.col("n").alias("n"), F.col("bitmap").alias("q"))
    both = split_join(split_join(pairs, left, ["a"]), right, ["b"])

    def check(batches):
        for batch in batches:
            a, b, m, n, p, q = (c.to_pylist() for c in batch.columns)
            kept = []
            for k in range(len(a)):
                pair = [(m[k], 0, a[k], p[k]), (n[k], 1, b[k], q[k])]
                pair = [(*e[:3], int.from_bytes(e[3], "little")) for e in pair]
                kept.append(any(True for _ in candidates(pair, percent)))
            mask = pa.array(kept, pa.bool_())
            columns = [batch.column(k).filter(mask) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b"])

    return materialise(
        both.select("a", "b", "m", "n", "p", "q").mapInArrow(check, "a long, b long"), "anchored"
    )
