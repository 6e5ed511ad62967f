"""The nested hide-rule language.

A rule is JSON text: leaves compare one field, groups combine with and / or and
may invert. The rules of one viewer are parsed on the driver, compiled to Columns
and evaluated inside the scan. For all viewers at once rule texts are data, of any
number: they meet the activity of the accounts that their viewers follow, as far as it
holds a text that the rule cannot do without, in blocks in which an index over their
distinct leaves tries each leaf once per row.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from datetime import UTC, datetime
from typing import Any

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from rookery.operators.joins import split_join
from rookery.operators.ranking import numbered_within
from rookery.session import materialise

# The rule vocabulary.
STRING_FIELDS = ("title", "repo", "type", "summary", "content", "githubUserLogin")
DATE_FIELD = "publishedAt"
VALUE_OPERATORS = (
    "equals",
    "notEqual",
    "contains",
    "notContains",
    "startsWith",
    "endsWith",
    "notStartsWith",
    "notEndsWith",
)
PRESENCE_OPERATORS = ("isEmpty", "isNotEmpty")
DATE_OPERATORS = ("before", "after")


@dataclass(frozen=True)
class Instant:
    """A tagged date of the rule text, as epoch milliseconds."""

    ms: int


class InvalidRule(ValueError):
    pass


def _revive(node: dict[str, Any]) -> Any:
    if node.get("__type") != "Date":
        return node
    try:
        at = datetime.fromisoformat(node["value"])
    except (KeyError, TypeError, ValueError) as error:
        raise InvalidRule("unreadable date") from error
    return Instant(int((at if at.tzinfo else at.replace(tzinfo=UTC)).timestamp() * 1000))


def _no_number(name: str) -> None:
    raise InvalidRule(f"{name} is no JSON number")


def _require(ok: bool, message: str) -> None:
    if not ok:
        raise InvalidRule(message)


def _check_common(node: Any) -> None:
    _require(isinstance(node, dict), "not an object")
    _require(isinstance(node.get("id"), str) and node["id"] != "", "id")
    _require(isinstance(node.get("invert", False), bool), "invert")
    _require(isinstance(node.get("meta", {}), dict), "meta")


def _check_leaf(node: dict[str, Any]) -> None:
    path, name, args = node.get("path"), node.get("name"), node.get("args")
    _require(isinstance(path, list) and len(path) == 1, "path")
    _require(isinstance(args, list), "args")
    if path[0] == DATE_FIELD:
        _require(name in DATE_OPERATORS, "operator")
        _require(len(args) == 1 and isinstance(args[0], Instant), "date argument")
    else:
        _require(path[0] in STRING_FIELDS, "field")
        if name in PRESENCE_OPERATORS:
            _require(args == [], "no argument expected")
        else:
            _require(name in VALUE_OPERATORS, "operator")
            _require(len(args) == 1 and isinstance(args[0], str), "text argument")


def _check_group(node: Any) -> None:
    _check_common(node)
    _require(node.get("type") == "FilterGroup", "type")
    _require(node.get("op") in ("and", "or"), "op")
    conditions = node.get("conditions")
    _require(isinstance(conditions, list) and len(conditions) > 0, "conditions")
    for child in conditions:
        _check_common(child)
        if child.get("type") == "Filter":
            _check_leaf(child)
        else:
            _check_group(child)


def parse_rule(text: str | None) -> dict[str, Any] | None:
    """The rule tree, or NULL for text that is not a valid rule (fail open)."""
    try:
        tree = json.loads(text, object_hook=_revive, parse_constant=_no_number) if text is not None else None
        _check_group(tree)
        return tree
    except (ValueError, RecursionError):
        return None


def activity_fields(df: DataFrame) -> dict[str, Column]:
    """Rule fields over an activity table; a missing column reads as NULL."""
    null = F.lit(None).cast("string")
    have = {c: F.col(c) for c in df.columns}
    fields = {f: have.get(f, null) for f in ("title", "repo", "type", "summary", "content")}
    return fields | {"githubUserLogin": F.col("actor_login"), "publishedAt": F.col("published_ms")}


def _leaf_column(node: dict[str, Any], fields: Mapping[str, Column]) -> Column:
    c, name = fields[node["path"][0]], node["name"]
    if name == "isEmpty":
        return c.isNull() | (c == "")
    if name == "isNotEmpty":
        return c.isNotNull() & (c != "")
    target = node["args"][0]
    if isinstance(target, Instant):
        return c < target.ms if name == "before" else c > target.ms
    if name == "equals":
        return c == target
    if name == "notEqual":
        return c != target
    folded, text = F.lower(c), F.lower(F.lit(target))
    negated = name.startswith("not")
    verb = name[3:] if negated else name
    test = {"contains": F.contains, "startswith": F.startswith, "endswith": F.endswith}
    hit = test[verb.lower()](folded, text)
    return ~hit if negated else hit


def compile_group(node: dict[str, Any], fields: Mapping[str, Column]) -> Column:
    """Three-valued Column of a group.

    An inverted group inverts itself, and its parent inverts an inverted child
    once more: so ``invert`` counts on leaves and on the root, and cancels on a
    nested group. Kept as is, since stored rules rely on it.
    """
    parts = []
    for child in node["conditions"]:
        is_leaf = child["type"] == "Filter"
        part = _leaf_column(child, fields) if is_leaf else compile_group(child, fields)
        parts.append(~part if child.get("invert") else part)
    combine = (lambda a, b: a | b) if node["op"] == "or" else (lambda a, b: a & b)
    whole = functools.reduce(combine, parts)
    return ~whole if node.get("invert") else whole


def compile_rule(text: str, fields: Mapping[str, Column]) -> Column | None:
    tree = parse_rule(text)
    return None if tree is None else compile_group(tree, fields)


def outcome(text: str, fields: Mapping[str, Column]) -> Column:
    """``true`` / ``false`` / ``null`` of one rule, as text."""
    value = compile_rule(text, fields)
    return F.coalesce(value.cast("string"), F.lit("null"))


def hidden_by(texts: Sequence[str], fields: Mapping[str, Column]) -> Column:
    """True iff some valid rule is TRUE; a NULL result keeps the row."""
    compiled = [c for t in texts if (c := compile_rule(t, fields)) is not None]
    if not compiled:
        return F.lit(False)
    return F.coalesce(functools.reduce(lambda a, b: a | b, compiled), F.lit(False))


def visible(df: DataFrame, texts: Sequence[str]) -> DataFrame:
    return df.filter(~hidden_by(texts, activity_fields(df)))


def live(rules: DataFrame) -> DataFrame:
    return rules.filter(~F.col("deleted"))


def rules_of(rules: DataFrame, viewer_id: int) -> list[str]:
    """Live rule texts of one viewer: that viewer's own list, read as metadata."""
    held = live(rules).filter((F.col("viewer_id") == viewer_id) & F.col("rule_text").isNotNull())
    mine = held.select("rule_text").distinct()
    return [r["rule_text"] for r in mine.collect()]


def held_rules(rules: DataFrame) -> DataFrame:
    """(viewer_id, rule_text, rule_id): distinct live rules; a NULL text is no rule."""
    texts = live(rules).filter(F.col("rule_text").isNotNull()).select("viewer_id", "rule_text").distinct()
    return texts.withColumn("rule_id", F.xxhash64("rule_text"))


#: Rows, and rules, that one task tries together.
BLOCK_ROWS, BLOCK_RULES = 4096, 4096
#: Anchors of one rule, code points of an anchor's text, bits of the filter of anchors.
MOST_ANCHORS, ANCHOR_CHARS, MOST_BITS = 64, 64, 1 << 26


def with_hits(activity: DataFrame, followed: DataFrame, held: DataFrame) -> DataFrame:
    """Add ``hits``: ids of the rules of an account's followers that are TRUE on the row.

    ``followed``: (viewer_id, actor_key); ``held``: (viewer_id, rule_text, rule_id).
    Accounts with the same followers, as far as these hold rules, are one group. A rule that
    is TRUE only where one of some leaves is (its anchors) stands below these, and a row is
    sent to the anchors that its values hold; other rules meet all rows of a group. Rows and
    rules of a group and an anchor meet in blocks of bounded size, and no pair of both
    is ever a row. The hits of a row are one array before any viewer is joined.
    """
    held = materialise(held.mapInArrow(_anchored, StructType([*held.schema, *_ANCHORED])), "anchored")
    probes = [r[0] for r in held.select(F.explode("probes")).distinct().collect()]
    spread = held.select("viewer_id", "rule_text", "rule_id", F.inline("anchors"))
    probe = Probe(probes, *_anchor_bits(spread))
    fields = activity_fields(activity)
    null = {f: F.lit(None).cast("long" if f == DATE_FIELD else "string") for f in _FIELD_ORDER}
    narrow = activity.select(
        "activity_id", "actor_key", *[(fields if f in probe.fields else null)[f].alias(f) for f in _FIELD_ORDER]
    )
    holders = held.select("viewer_id").distinct()
    edges = split_join(followed, holders, ["viewer_id"]).select("viewer_id", "actor_key").distinct()
    one, two = F.xxhash64("viewer_id"), F.xxhash64("viewer_id", F.lit(1))
    accounts = edges.groupBy("actor_key").agg(
        F.struct(F.count("*").alias("n"), F.bit_xor(one).alias("x"), F.bit_xor(two).alias("y")).alias("group")
    )
    firsts = accounts.groupBy("group").agg(F.min("actor_key").alias("actor_key"))
    asked = (
        split_join(split_join(edges, firsts, ["actor_key"]), spread, ["viewer_id"])
        .select("group", "anchor", "nth", "rule_text", "rule_id")
        .distinct()
    )
    grouped = split_join(narrow, accounts, ["actor_key"]).select("activity_id", *_FIELD_ORDER, "group")
    probed = grouped.mapInArrow(probe, StructType([*grouped.schema, StructField("anchor", LongType())]))
    chunks = lambda n, size: F.ceil(F.col(n) / size).cast("int")
    n_rows = probed.groupBy("group", "anchor").agg(F.count("*").alias("n"))
    n_rules = asked.groupBy("group", "anchor").agg(F.count("*").alias("m"))
    sizes = n_rows.join(n_rules, ["group", "anchor"]).select(
        "group", "anchor", chunks("n", BLOCK_ROWS).alias("across"), chunks("m", BLOCK_RULES).alias("down")
    )
    part = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = (
        split_join(probed, sizes, ["group", "anchor"])
        .withColumn("i", part("activity_id", "across"))
        .withColumn("j", each("down"))
    )
    texts = (
        split_join(asked, sizes, ["group", "anchor"])
        .withColumn("j", part("rule_id", "down"))
        .withColumn("i", each("across"))
    )
    place = F.xxhash64("group").alias("place")
    block = ["place", "anchor", "i", "j"]
    both = texts.select(place, *block[1:], "rule_id", "rule_text", "nth").unionByName(
        rows.select(place, *block[1:], "activity_id", *_FIELD_ORDER), allowMissingColumns=True
    )
    found = (
        both.select(*block, "rule_id", "rule_text", "nth", "activity_id", *_FIELD_ORDER)
        .repartition(*block)
        .sortWithinPartitions(*block, F.desc_nulls_last("rule_id"))
        .mapInArrow(_tried, "activity_id string, hits array<long>")
    )
    hits = found.groupBy("activity_id").agg(F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"))
    none = F.array().cast("array<bigint>")
    return activity.join(hits, "activity_id", "left").withColumn("hits", F.coalesce("hits", none))


def _negated(leaf: dict[str, Any], inverted: bool) -> bool:
    return inverted != (leaf["name"].startswith("not") or leaf["name"] == "isNotEmpty")


def anchors(tree: dict[str, Any], inverted: bool = False) -> list[dict[str, Any]] | None:
    """Leaves of which one at least is TRUE without its own negation wherever the rule is
    TRUE; NULL where there are none, or too many."""
    inverted ^= bool(tree.get("invert"))
    parts = []
    for child in tree["conditions"]:
        below = inverted ^ bool(child.get("invert"))
        if child["type"] != "Filter":
            parts.append(anchors(child, below))
        elif child["name"] not in VALUE_OPERATORS or _negated(child, below):
            parts.append(None)
        else:
            exact = child["name"] in ("equals", "notEqual")
            parts.append([child] if exact or child["args"][0] else None)
    if (tree["op"] == "or") != inverted:
        if None in parts:
            return None
        chosen = [leaf for part in parts for leaf in part]
    else:
        # Few leaves with long texts leave few rows.
        weight = lambda part: (len(part), -min(len(leaf["args"][0]) for leaf in part))
        chosen = min((part for part in parts if part is not None), key=weight, default=None)
    return chosen if chosen is not None and len(chosen) <= MOST_ANCHORS else None


#: Anchor of the rules that meet all rows.
EVERY_ROW = 0
_VERBS = ("equals", "contains", "startswith", "endswith", "read")
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    found = np.full(n, base, np.uint64)
    found[:1] = 1
    return np.multiply.accumulate(found)


class Hashed:
    """Texts one after the other, with the hash of any part of one of them."""

    def __init__(self, texts: list[str]):
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        self.ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        self.starts = np.concatenate([np.zeros(1, np.int64), self.ends])[: len(texts)]
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes + 1) * _powers(_STEP, len(codes)), dtype=np.uint64)])
        self.back = _powers(_BACK, len(codes) + 1)

    def parts(self, begin: np.ndarray, end: np.ndarray, kind: int) -> np.ndarray:
        h = (self.sums[end] - self.sums[begin]) * self.back[begin]
        h ^= np.uint64((kind + 1) * 0xD6E8FEB86659FD93 & (1 << 64) - 1)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
        return (h ^ (h >> np.uint64(31))).view(np.int64)


def _kind(field: str, verb: str) -> int:
    return _FIELD_ORDER.index(field) * len(_VERBS) + _VERBS.index(verb)


def _anchor_text(leaf: dict[str, Any]) -> tuple[int, str]:
    """Kind of an anchor, and what a value has to hold."""
    verb, text = leaf["name"].removeprefix("not").lower(), leaf["args"][0]
    if verb in ("equals", "equal"):
        return _kind(leaf["path"][0], "equals"), text
    text = text.lower()
    text = text[-ANCHOR_CHARS:] if verb == "endswith" else text[:ANCHOR_CHARS]
    return _kind(leaf["path"][0], verb), text


def _hashes(asked: Iterable[tuple[int, str]]) -> dict[tuple[int, str], int]:
    """Hashes of (kind, text), those of a kind together."""
    texts: dict[int, dict[str, None]] = {}
    for kind, text in asked:
        texts.setdefault(kind, {})[text] = None
    found = {}
    for kind, own in texts.items():
        hashed = Hashed(list(own))
        values = hashed.parts(hashed.starts, hashed.ends, kind).tolist()
        found |= {(kind, text): value for text, value in zip(own, values, strict=True)}
    return found


def _fields_of(tree: dict[str, Any]) -> set[str]:
    below = (_fields_of(c) if c["type"] == "FilterGroup" else {c["path"][0]} for c in tree["conditions"])
    return set().union(*below)


_ANCHORED = [
    StructField("anchors", ArrayType(StructType([StructField("anchor", LongType()), StructField("nth", IntegerType())]))),
    StructField("probes", ArrayType(LongType())),
]


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rules with the hashes of their anchors and what finds these; none for broken texts."""
    equal = {_kind(field, "equals") for field in _FIELD_ORDER}
    every_row = _kind(DATE_FIELD, "equals") << 32
    for batch in batches:
        trees = [parse_rule(text) for text in batch.column("rule_text").to_pylist()]
        leaves = [[] if tree is None else anchors(tree) for tree in trees]
        asked = [None if own is None else [_anchor_text(leaf) for leaf in own] for own in leaves]
        hash_of = _hashes(one for own in asked if own is not None for one in own)
        hashes, probes = [], []
        for tree, own in zip(trees, asked, strict=True):
            numbers = [EVERY_ROW] if own is None else [hash_of[one] for one in own]
            ways = [every_row] if own is None else [k << 32 | (0 if k in equal else len(t)) for k, t in own]
            hashes.append([{"anchor": h, "nth": k} for k, h in enumerate(numbers)])
            probes.append(ways + ([] if tree is None else [_kind(f, "read") << 32 for f in _fields_of(tree)]))
        kinds = pa.list_(pa.struct([("anchor", pa.int64()), ("nth", pa.int32())])), pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(hashes, kinds[0]), pa.array(probes, kinds[1])],
            [*batch.schema.names, "anchors", "probes"],
        )


def _anchor_bits(spread: DataFrame) -> tuple[np.ndarray, int]:
    """Bits of all anchors, 16 for each where that stays within ``MOST_BITS``."""
    size = 1 << 10
    wanted = 16 * spread.count()
    while size < min(wanted, MOST_BITS):
        size *= 2
    at = F.col("anchor").bitwiseAND(size - 1)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(63).cast("int"))
    words = spread.groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(one).alias("bits")).toArrow()
    bits = np.zeros(size // 64, np.int64)
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return bits, size


class Probe:
    """Rows once for every anchor that a value of theirs may hold, as far as a filter of the
    anchors' hashes tells; equal hashes of other texts send a row too often, never too rarely."""

    #: Code points that are hashed together.
    TOGETHER = 1 << 20

    def __init__(self, probes: Sequence[int], bits: np.ndarray, size: int):
        self.bits, self.size = bits, size
        self.lengths: dict[tuple[str, str], list[int]] = {}
        for probe in sorted(probes):
            field, verb = divmod(probe >> 32, len(_VERBS))
            self.lengths.setdefault((_FIELD_ORDER[field], _VERBS[verb]), []).append(probe & 0xFFFFFFFF)
        self.fields = {field for field, verb in self.lengths if verb == "read"}
        self.every_row = self.lengths.pop((DATE_FIELD, "equals"), None) is not None

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, hashes = self._places(batch)
            for k in range(0, len(rows), 1 << 14):
                some = slice(k, k + (1 << 14))
                taken = batch.take(pa.array(rows[some]))
                yield pa.RecordBatch.from_arrays(
                    [*taken.columns, pa.array(hashes[some])], [*taken.schema.names, "anchor"]
                )

    def _places(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        rows, hashes = [_NO_ROWS], [_NO_ROWS]
        if self.every_row:
            rows.append(np.arange(batch.num_rows))
            hashes.append(np.full(batch.num_rows, EVERY_ROW))
        for field in self.fields - {DATE_FIELD}:
            coded = batch.column(field).dictionary_encode()
            values, hash_of = self._values(field, coded.dictionary.to_pylist())
            order = np.argsort(values, kind="stable")
            hash_of = hash_of[order]
            borders = np.searchsorted(values[order], np.arange(len(coded.dictionary) + 1))
            known = np.flatnonzero(coded.indices.is_valid().to_numpy(zero_copy_only=False))
            code = coded.indices.drop_null().to_numpy()
            n = borders[code + 1] - borders[code]
            before = np.repeat(np.cumsum(n) - n, n)
            rows.append(np.repeat(known, n))
            hashes.append(hash_of[np.repeat(borders[code], n) + np.arange(len(before)) - before])
        pairs = np.unique(np.stack([np.concatenate(rows), np.concatenate(hashes)]), axis=1)
        return pairs[0], pairs[1]

    def _values(self, field: str, values: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(place of a value, hash of an anchor that it may hold)."""
        found = [(_NO_ROWS, _NO_ROWS)]
        start = 0
        while start < len(values):
            stop, chars = start, 0
            while stop < len(values) and (stop == start or chars + len(values[stop]) <= self.TOGETHER):
                chars += len(values[stop])
                stop += 1
            for verb in _VERBS[:4]:
                if (lengths := self.lengths.get((field, verb))) is None:
                    continue
                texts = values[start:stop]
                hashed = Hashed(texts if verb == "equals" else [t.lower() for t in texts])
                for at, h in self._found(hashed, verb, lengths, _kind(field, verb)):
                    found.append((at + start, h))
            start = stop
        return tuple(np.concatenate(part) for part in zip(*found, strict=True))

    def _found(self, hashed: Hashed, verb: str, lengths: list[int], kind: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        starts, ends = hashed.starts, hashed.ends
        owner = np.arange(len(ends))
        if verb == "contains":
            owner = np.repeat(owner, ends - starts)
            starts, ends = np.arange(len(owner)), ends[owner]
        for length in lengths:
            if verb == "equals":
                fits, begin, end = owner, starts, ends
            else:
                fits = np.flatnonzero(ends - starts >= length)
                begin = ends[fits] - length if verb == "endswith" else starts[fits]
                fits, end = owner[fits], begin + length
            h = hashed.parts(begin, end, kind)
            at = h & (self.size - 1)
            kept = self.bits[at >> 6] >> (at & 63) & 1 == 1
            yield fits[kept], h[kept]


def _tried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of rules followed by rows, as sorted by ``with_hits``; rows with their hits."""
    parse = functools.lru_cache(maxsize=1 << 14)(parse_rule)
    current: tuple | None = None
    rules: list[tuple[int, dict[str, Any], int]] = []
    index: LeafIndex | None = None
    for batch in batches:
        keys = list(zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True))
        ids, texts, places = (batch.column(k).to_pylist() for k in (4, 5, 6))
        start = 0
        out = []
        while start < len(keys):
            if keys[start] != current:
                current, rules, index = keys[start], [], None
            stop = start
            while stop < len(keys) and keys[stop] == current and (ids[stop] is None) == (ids[start] is None):
                stop += 1
            if ids[start] is not None:
                parsed = ((ids[k], parse(texts[k]), places[k]) for k in range(start, stop))
                rules += [rule for rule in parsed if rule[1] is not None]
                index = None
            elif rules:
                index = index or LeafIndex(tree for _, tree, _ in rules)
                part = batch.slice(start, stop - start)
                tried = Trial(index, {f: part.column(8 + k) for k, f in enumerate(_FIELD_ORDER)})
                out.append(_hits_of(part.column(7), [(r, tried.rows_below(tree, nth)) for r, tree, nth in rules]))
            start = stop
        yield from pa.Table.from_batches(out).combine_chunks().to_batches() if out else []


def _hits_of(ids: pa.Array, hits: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    """Rows with at least one hit, and the rules that hit them."""
    at = np.concatenate([np.empty(0, np.int64), *(rows for _, rows in hits)])
    rules = np.repeat(np.array([rule for rule, _ in hits], np.int64), [len(rows) for _, rows in hits])
    order = np.argsort(at, kind="stable")
    rows, first = np.unique(at[order], return_index=True)
    borders = np.append(first, len(at)).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(borders), pa.array(rules[order]))
    return pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), lists], ["activity_id", "hits"])


_NO_ROWS = np.empty(0, np.int64)


class LeafIndex:
    """The distinct leaves of rules, arranged so that a batch meets each of them once:
    values asked for equality in a table per field, texts searched in lower-case fields
    in one automaton per field."""

    def __init__(self, trees: Iterable[dict[str, Any]]):
        self.equal: dict[str, set[str]] = {}
        self.texts: dict[str, set[str]] = {}
        stack = list(trees)
        while stack:
            node = stack.pop()
            if node["type"] == "FilterGroup":
                stack += node["conditions"]
            elif node["name"] in ("equals", "notEqual"):
                self.equal.setdefault(node["path"][0], set()).add(node["args"][0])
            elif node["name"] in VALUE_OPERATORS:
                self.texts.setdefault(node["path"][0], set()).add(node["args"][0].lower())
        self.automata = {field: _automaton(texts) for field, texts in self.texts.items()}


def _automaton(texts: Iterable[str]) -> ahocorasick.Automaton | None:
    found = ahocorasick.Automaton()
    for text in texts:
        if text:
            found.add_word(text, text)
    if not len(found):
        return None
    found.make_automaton()
    return found


class Trial:
    """One batch of rows tried on an index: for every leaf the rows on which it is TRUE.

    Negations lie on leaves only, once a rule's inversions are pushed down; on such a
    form a rule is TRUE where its formula holds over the leaves that are TRUE, whatever
    is NULL elsewhere. Groups narrow the rows from their rarest part."""

    def __init__(self, index: LeafIndex, columns: Mapping[str, pa.Array]):
        self.columns = columns
        self.all = np.arange(len(next(iter(columns.values()))))
        self.known = {f: np.flatnonzero(c.is_valid().to_numpy(zero_copy_only=False)) for f, c in columns.items()}
        self.equal: dict[tuple[str, str], np.ndarray] = {}
        for field, values in index.equal.items():
            asked = sorted(values)
            place = pc.index_in(columns[field], pa.array(asked, pa.string()))
            place = pc.fill_null(place, len(asked)).to_numpy(zero_copy_only=False)
            order = np.argsort(place, kind="stable")
            borders = np.searchsorted(place[order], np.arange(len(asked) + 1))
            for k, value in enumerate(asked):
                self.equal[field, value] = np.sort(order[borders[k] : borders[k + 1]])
        self.searched: dict[tuple[str, str, str], list[int]] = {}
        for field, automaton in index.automata.items():
            if automaton is not None:
                self._search(field, automaton)

    def _search(self, field: str, automaton: ahocorasick.Automaton) -> None:
        """All places of all texts in one pass over a field."""
        for row, value in enumerate(self.columns[field].to_pylist()):
            if value is None:
                continue
            lower = value.lower()
            for end, text in automaton.iter(lower):
                verbs = ["contains"]
                if end + 1 == len(text):
                    verbs.append("startswith")
                if end + 1 == len(lower):
                    verbs.append("endswith")
                for verb in verbs:
                    rows = self.searched.setdefault((field, verb, text), [])
                    if not rows or rows[-1] != row:
                        rows.append(row)

    def _positive(self, node: dict[str, Any]) -> np.ndarray:
        """Rows on which the leaf is TRUE without its own negation."""
        field, name = node["path"][0], node["name"]
        if name in PRESENCE_OPERATORS:
            empty = pc.fill_null(pc.equal(self.columns[field], ""), True)
            return np.flatnonzero(empty.to_numpy(zero_copy_only=False))
        target = node["args"][0]
        if isinstance(target, Instant):
            compare = pc.less if name == "before" else pc.greater
            hit = pc.fill_null(compare(self.columns[field], target.ms), False)
            return np.flatnonzero(hit.to_numpy(zero_copy_only=False))
        if name in ("equals", "notEqual"):
            return self.equal[field, target]
        text = target.lower()
        if not text:
            return self.known[field]
        verb = name.removeprefix("not").lower()
        return np.array(self.searched.get((field, verb, text), _NO_ROWS), np.int64)

    def _leaf(self, node: dict[str, Any], inverted: bool) -> np.ndarray:
        name = node["name"]
        found = self._positive(node)
        if not _negated(node, inverted):
            return found
        known = self.all if name in PRESENCE_OPERATORS else self.known[node["path"][0]]
        return np.setdiff1d(known, found, assume_unique=True)

    def rows_below(self, tree: dict[str, Any], nth: int) -> np.ndarray:
        """The rows on which a rule is TRUE and its n-th anchor is the first that holds, so
        that a rule below several anchors counts once."""
        found, leaves = self.rows(tree), anchors(tree)
        if leaves is None or len(leaves) == 1 or not len(found):
            return found
        found = np.intersect1d(found, self._positive(leaves[nth]), assume_unique=True)
        for leaf in leaves[:nth]:
            found = np.setdiff1d(found, self._positive(leaf), assume_unique=True)
        return found

    def rows(self, tree: dict[str, Any], inverted: bool = False) -> np.ndarray:
        """The rows on which a rule is TRUE, rising."""
        inverted ^= bool(tree.get("invert"))
        parts = []
        for child in tree["conditions"]:
            if child["type"] == "Filter":
                parts.append(self._leaf(child, inverted ^ bool(child.get("invert"))))
            else:  # a nested group's own inversion counts twice
                parts.append(self.rows(child, inverted ^ bool(child.get("invert"))))
        if (tree["op"] == "or") != inverted:
            return np.unique(np.concatenate(parts))
        parts.sort(key=len)
        whole = parts[0]
        for other in parts[1:]:
            whole = np.intersect1d(whole, other, assume_unique=True)
        return whole


_FIELD_ORDER = (*STRING_FIELDS, DATE_FIELD)


def rule_is_true(rule_text: Column, fields: Mapping[str, Column]) -> Column:
    """Evaluate the rule text of each row on that row, batch by batch.

    Texts travel as data; each batch evaluates every distinct text it holds once.
    """

    @F.pandas_udf("boolean")
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        parse = functools.lru_cache(maxsize=4096)(parse_rule)
        for texts, *columns in batches:
            kinds = [pa.string()] * len(STRING_FIELDS) + [pa.int64()]
            fields = [pa.array(c, k, from_pandas=True) for c, k in zip(columns, kinds, strict=True)]
            result = np.zeros(len(texts), bool)
            for text, at in texts.groupby(texts).indices.items():
                if (tree := parse(text)) is not None:
                    own = {f: c.take(pa.array(at)) for f, c in zip(_FIELD_ORDER, fields, strict=True)}
                    result[at[Trial(LeafIndex([tree]), own).rows(tree)]] = True
            yield pd.Series(result)

    return run(rule_text, *[fields[f] for f in _FIELD_ORDER])


def canonical_text(text: str | None) -> str | None:
    """Rule text with sorted keys and no blanks; NULL for an invalid rule."""
    if parse_rule(text) is None:
        return None
    return json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def with_canonical_text(rules: DataFrame) -> DataFrame:
    """Add ``canonical`` to a rule table; texts are checked per Arrow batch."""

    @F.pandas_udf("string")
    def canonical(texts: pd.Series) -> pd.Series:
        codes, distinct = pd.factorize(texts, use_na_sentinel=False)
        found = pd.Series([canonical_text(None if pd.isna(t) else t) for t in distinct], dtype=object)
        return found.take(codes).reset_index(drop=True)

    return rules.withColumn("canonical", canonical("rule_text"))


def list_rules(rules: DataFrame, by_name: bool = True) -> DataFrame:
    """Live rules with ``is_valid`` and their ``place`` in the viewer's list, by name or by
    age; invalid ones are listed too."""
    checked = with_canonical_text(live(rules))
    listed = checked.withColumn("is_valid", F.col("canonical").isNotNull()).drop("canonical")
    order = [F.col("name" if by_name else "created_ms"), F.col("rule_id")]
    return numbered_within(listed, ["viewer_id"], order, "place")
