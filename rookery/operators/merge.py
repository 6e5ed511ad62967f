"""Three-way merge of rule trees, node by node.

Rules that differ on both sides are taken apart to nodes: (rule, path, kind, text), where
the path names keys of objects and the ids of list items. The three versions of a node
meet by their path; each is taken from one side, merged further below, or a conflict.
The merged rule is put together again from the nodes that were taken.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Kinds of nodes: an object, a list whose items have ids of their own, another list, a value.
OBJECT, BY_ID, BY_PLACE, VALUE = "object", "list by id", "list", "value"
_NODE = "rule_id {kind}, path string, kind string, items array<string>, text string"
_SIDES = ("base", "local", "remote")
#: Whatever is nested deeper is one value.
DEPTH = 100


def _number(text: str) -> int | float:
    value = float(text)
    return int(value) if value.is_integer() else value


def _no_constant(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


def _parsed(text: str) -> Any:
    return json.loads(text, parse_float=_number, parse_constant=_no_constant)


def dumped(value: Any) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def canonical_json(text: str | None) -> str | None:
    """JSON text with sorted keys and no blanks; text that is no JSON stays as it is."""
    try:
        return None if text is None else dumped(_parsed(text))
    except (ValueError, RecursionError):
        return text


def _id_of(item: Any) -> Any:
    return item.get("id") if isinstance(item, dict) else None


def _kind_and_items(value: Any) -> tuple[str, list[str | None] | None, list[tuple[str, Any]]]:
    """Kind of a node, the names of its items, and its children under them."""
    if isinstance(value, dict):
        return OBJECT, sorted(value), [(f".{k}", v) for k, v in value.items()]
    if not isinstance(value, list):
        return VALUE, None, []
    ids = [_id_of(item) for item in value]
    if all(isinstance(i, str) for i in ids) and len(set(ids)) == len(ids):
        return BY_ID, ids, [(f"@{i}", v) for i, v in zip(ids, value, strict=True)]
    marks = [None if i is None else dumped(i) for i in ids]
    return BY_PLACE, marks, [(f"#{k}", v) for k, v in enumerate(value)]


def nodes_of(text: str) -> Iterator[tuple[str, str, list[str | None] | None, str]]:
    """``path, kind, items, text`` of every node of a rule text; the root's path is ``[]``."""
    try:
        stack: list[tuple[list[str], Any]] = [([], _parsed(text))]
    except (ValueError, RecursionError):
        yield "[]", VALUE, None, text
        return
    while stack:
        path, value = stack.pop()
        kind, items, children = _kind_and_items(value) if len(path) < DEPTH else (VALUE, None, [])
        yield dumped(path), kind, items, dumped(value)
        stack += [([*path, name], child) for name, child in children]


def rule_nodes(rules: DataFrame) -> DataFrame:
    """The nodes of rule texts: (rule_id, path, kind, items, text). ``rules``: (rule_id,
    rule_text); a NULL text has none."""
    schema = _NODE.format(kind=rules.schema["rule_id"].dataType.simpleString())

    def take_apart(batches):
        for batch in batches:
            ids, rows = [], []
            for place, text in enumerate(batch.column(1).to_pylist()):
                if text is not None:
                    found = list(nodes_of(text))
                    ids += [place] * len(found)
                    rows += found
            columns = list(zip(*rows, strict=True)) or [()] * 4
            kinds = [pa.string(), pa.string(), pa.list_(pa.string()), pa.string()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            names = ["rule_id", "path", "kind", "items", "text"]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), *arrays], names)

    return rules.select("rule_id", "rule_text").mapInArrow(take_apart, schema)


def _decided(b: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """The side that a whole text is taken from, or NULL: an unchanged side yields to the
    other one, equal sides agree."""
    return F.when(l.eqNullSafe(b), "remote").when(r.eqNullSafe(b) | l.eqNullSafe(r), "local")


def _merged_below() -> Column:
    """Whether the three versions of a node are of one kind that is merged item by item.
    Lists without ids need one length, and ids that some items have must agree."""
    kind = F.col("base.kind")
    alike = kind.eqNullSafe(F.col("local.kind")) & kind.eqNullSafe(F.col("remote.kind"))
    b, l, r = (F.col(f"{s}.items") for s in _SIDES)  # noqa: E741
    places = F.sequence(F.lit(0), F.size(b) - 1)
    same_ids = F.forall(
        F.when(F.size(b) > 0, places).otherwise(F.array().cast("array<int>")),
        lambda k: F.get(b, k).isNull()
        | (F.get(b, k).eqNullSafe(F.get(l, k)) & F.get(b, k).eqNullSafe(F.get(r, k))),
    )
    one_length = (F.size(b) == F.size(l)) & (F.size(b) == F.size(r))
    by_place = F.when(kind == BY_PLACE, one_length & same_ids).otherwise(F.lit(True))
    return F.coalesce(alike & (kind != VALUE) & by_place, F.lit(False))


def merge_nodes(base: DataFrame, local: DataFrame, remote: DataFrame) -> DataFrame:
    """Three versions of nodes joined by rule and path: (rule_id, path, verdict, kind, text,
    items). The verdict is ``taken`` (``text`` is NULL if the side taken has no such
    node), ``below`` or ``conflict``; ``items`` are those of all sides in their order."""
    sides = [
        df.withColumn("side", F.lit(name)) for name, df in zip(_SIDES, (base, local, remote), strict=True)
    ]
    version = F.struct("kind", "items", "text")
    joined = (
        sides[0].unionByName(sides[1]).unionByName(sides[2])
        .groupBy("rule_id", "path")
        .agg(*(F.max(F.when(F.col("side") == s, version)).alias(s) for s in _SIDES))
    )
    side = _decided(*(F.col(f"{s}.text") for s in _SIDES))
    verdict = F.when(side.isNotNull(), "taken").when(_merged_below(), "below").otherwise("conflict")
    text = F.when(side == "remote", F.col("remote.text")).when(side == "local", F.col("local.text"))
    none = F.array().cast("array<string>")
    items = F.array_distinct(F.concat(*(F.coalesce(f"{s}.items", none) for s in _SIDES)))
    kind = F.col("base.kind")
    return joined.select(
        "rule_id",
        "path",
        verdict.alias("verdict"),
        kind.alias("kind"),
        text.alias("text"),
        F.when(verdict == "below", F.when(kind == BY_PLACE, F.col("base.items")).otherwise(items)).alias("items"),
    )


def put_together(nodes: Mapping[str, Mapping[str, Any]]) -> tuple[str | None, list[str]]:
    """Text of one merged rule, and the paths of its conflicts (then there is no text).
    ``nodes``: path to verdict, kind, text and items."""
    conflicts: list[str] = []

    def text_of(path: list[str]) -> str | None:
        node = nodes[dumped(path)]
        if node["verdict"] == "conflict":
            conflicts.append(dumped(path))
        if node["verdict"] != "below":
            return node["text"]
        names = node["items"]
        if node["kind"] == OBJECT:
            parts = ((k, text_of([*path, f".{k}"])) for k in sorted(names))
            return "{" + ",".join(f"{dumped(k)}:{v}" for k, v in parts if v is not None) + "}"
        marks = [f"@{i}" for i in names] if node["kind"] == BY_ID else [f"#{k}" for k in range(len(names))]
        return "[" + ",".join(v for mark in marks if (v := text_of([*path, mark])) is not None) + "]"

    text = text_of([])
    return (None, sorted(conflicts)) if conflicts else (text, [])


def _with_canonical(rules: DataFrame, name: str) -> DataFrame:
    @F.pandas_udf("string")
    def canonical(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: canonical_json(None if pd.isna(t) else t)).astype(object)

    return rules.filter("rule_text is not null").select("rule_id", F.lit(name).alias("side"), canonical("rule_text").alias("text"))


def merge_rules(base: DataFrame, local: DataFrame, remote: DataFrame) -> DataFrame:
    """Merge three versions of rule texts: (rule_id, status, rule_text, conflicts).

    Each side is (rule_id, rule_text). A rule, a key or a list item that one side left
    alone follows the other side, also where it was added or removed; items are told by
    their ids where all have one, else by their places. What both sides changed apart is
    a conflict: status ``conflict``, no text, and ``conflicts`` with its paths. Else the
    status is ``merged`` with canonical text, or ``deleted``. The order of keys and blanks
    are no change. A NULL text counts as no rule, text that is no JSON as one value, of
    rows with one id the greatest text; a list whose items have ids in some versions only
    is a conflict. Only rules that both sides changed are taken apart.
    """
    sides = [_with_canonical(df, name) for name, df in zip(_SIDES, (base, local, remote), strict=True)]
    whole = (
        sides[0].unionByName(sides[1]).unionByName(sides[2])
        .groupBy("rule_id")
        .agg(*(F.max(F.when(F.col("side") == s, F.col("text"))).alias(s) for s in _SIDES))
        .withColumn("side", _decided(*map(F.col, _SIDES)))
    )
    none = F.array().cast("array<string>")
    easy = whole.filter("side is not null").select(
        "rule_id", F.when(F.col("side") == "remote", F.col("remote")).otherwise(F.col("local")).alias("text"), none.alias("conflicts")
    )
    hard = whole.filter("side is null")
    nodes = merge_nodes(*(rule_nodes(hard.select("rule_id", F.col(s).alias("rule_text"))) for s in _SIDES))
    grouped = nodes.groupBy("rule_id").agg(  # the nodes of one rule
        F.collect_list(F.struct("path", "verdict", "kind", "text", "items")).alias("nodes")
    )

    def rebuild(batches):
        for batch in batches:
            found = [put_together({n["path"]: n for n in own}) for own in batch.column(1).to_pylist()]
            texts, conflicts = zip(*found, strict=True) if found else ((), ())
            arrays = [pa.array(texts, pa.string()), pa.array(conflicts, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["rule_id", "text", "conflicts"])

    kind = base.schema["rule_id"].dataType.simpleString()
    rebuilt = grouped.mapInArrow(rebuild, f"rule_id {kind}, text string, conflicts array<string>")
    status = (
        F.when(F.size("conflicts") > 0, "conflict").when(F.col("text").isNull(), "deleted").otherwise("merged")
    )
    return easy.unionByName(rebuilt).select("rule_id", status.alias("status"), F.col("text").alias("rule_text"), "conflicts")
