"""Three-way merge of rule trees: against a recursive merge of whole values."""

import copy
import json
import random

from rookery.operators import merge

MISSING = object()


def same(a, b):
    return (a is MISSING) == (b is MISSING) and (a is MISSING or merge.dumped(a) == merge.dumped(b))


def ids_of(items):
    ids = [i.get("id") if isinstance(i, dict) else None for i in items]
    return ids if all(isinstance(i, str) for i in ids) and len(set(ids)) == len(ids) else None


class Conflict(Exception):
    pass


def twin(b, l, r):  # noqa: E741
    if same(l, b):
        return r
    if same(r, b) or same(l, r):
        return l
    sides = (b, l, r)
    if all(isinstance(s, dict) for s in sides):
        merged = {k: twin(*(s.get(k, MISSING) for s in sides)) for k in {**b, **l, **r}}
        return {k: v for k, v in merged.items() if v is not MISSING}
    if all(isinstance(s, list) for s in sides):
        ids = [ids_of(s) for s in sides]
        if all(i is not None for i in ids):
            named = [dict(zip(i, s, strict=True)) for i, s in zip(ids, sides, strict=True)]
            merged = [twin(*(n.get(i, MISSING) for n in named)) for i in dict.fromkeys(sum(ids, []))]
            return [v for v in merged if v is not MISSING]
        if any(i is not None for i in ids) or not len(b) == len(l) == len(r):
            raise Conflict
        for x, *others in zip(*sides, strict=True):
            mark = x.get("id") if isinstance(x, dict) else None
            if mark is not None and any(not isinstance(o, dict) or o.get("id") != mark for o in others):
                raise Conflict
        return [twin(*items) for items in zip(*sides, strict=True)]
    raise Conflict


def tree(rng, depth=0):
    kind = rng.randrange(6) if depth < 4 else rng.randrange(3)
    if kind == 0:
        return rng.choice([None, True, 0, 1, 1.0, 2.5, "", "a", 'q"\\\n', "é漢"])
    if kind == 1:
        return rng.choice(["x", "y"])
    if kind in (2, 3):
        return {k: tree(rng, depth + 1) for k in rng.sample(["id", "op", "args", "k.1", "@x", ""], rng.randint(0, 3))}
    if kind == 4:
        return [{"id": i, "v": tree(rng, depth + 1)} for i in rng.sample("abcde", rng.randint(0, 4))]
    return [tree(rng, depth + 1) for _ in range(rng.randint(0, 3))]


def edited(rng, value):
    """A copy with few changes somewhere below."""
    value = copy.deepcopy(value)
    if rng.random() < 0.25 or not isinstance(value, dict | list) or not value:
        return tree(rng, 3)
    if isinstance(value, dict):
        key = rng.choice(list(value))
        if rng.random() < 0.3:
            del value[key]
        elif rng.random() < 0.3:
            value[rng.choice(["new", "other"])] = tree(rng, 3)
        else:
            value[key] = edited(rng, value[key])
        return dict(rng.sample(list(value.items()), len(value)))
    at = rng.randrange(len(value))
    if rng.random() < 0.3:
        del value[at]
    elif rng.random() < 0.3:
        value.insert(at, {"id": rng.choice("xyz"), "v": 1})
    else:
        value[at] = edited(rng, value[at])
    return value


def run(spark, sides, kind="string"):
    schema = f"rule_id {kind}, rule_text string, side int"
    frames = [spark.createDataFrame([(k, t, 1) for k, t in rows], schema) for rows in sides]
    return {r.rule_id: (r.status, r.rule_text, r.conflicts) for r in merge.merge_rules(*frames).collect()}


def test_random_trees_equal_the_recursive_merge(spark):
    rng = random.Random(5)
    sides, want = ([], [], []), {}
    for k in range(600):
        base = tree(rng) if k % 9 else [tree(rng), {"id": "a"}, {"id": "b", "v": [1, 2]}]
        versions = [base, *(edited(rng, base) if rng.random() < 0.9 else base for _ in range(2))]
        if k % 5 == 0:
            versions[2] = edited(rng, versions[1])
        for rows, v in zip(sides, versions, strict=True):
            rows.append((f"r{k}", json.dumps(v, ensure_ascii=k % 2 == 0, indent=k % 3)))
        try:
            want[f"r{k}"] = ("merged", merge.dumped(json.loads(json.dumps(twin(*versions)), parse_float=merge._number)))
        except Conflict:
            want[f"r{k}"] = ("conflict", None)
    got = run(spark, sides)
    assert {k: v[:2] for k, v in got.items()} == want
    assert all((v[0] == "conflict") == bool(v[2]) for v in got.values())
    statuses = [v[0] for v in want.values()]
    assert min(statuses.count("merged"), statuses.count("conflict")) > 100


def test_edits_apart_meet_in_one_rule(spark):
    def rule(conditions, **more):
        return json.dumps({"id": "root", "op": "and", "conditions": conditions} | more)

    first, second = {"id": "one", "args": ["a"]}, {"id": "two", "args": ["b"]}
    nested = {"id": "g", "op": "or", "conditions": [first, second]}
    got = run(
        spark,
        (
            [(1, rule([nested]))],
            [(1, rule([nested | {"conditions": [first | {"args": ["local"]}, second]}]))],
            [(1, rule([nested | {"op": "and", "conditions": [first, second, {"id": "three"}]}], invert=True))],
        ),
        "long",
    )
    merged = json.loads(got[1][1])
    assert got[1][0] == "merged" and merged["invert"] is True and merged["conditions"][0]["op"] == "and"
    inner = merged["conditions"][0]["conditions"]
    assert [c["id"] for c in inner] == ["one", "two", "three"] and inner[0]["args"] == ["local"]


def test_conflicts_name_their_paths(spark):
    texts = ['{"a":{"b":[{"id":"x","v":1}]},"c":0}', '{"a":{"b":[{"id":"x","v":2}]},"c":1}', '{"a":{"b":[{"id":"x","v":3}]},"c":2}']
    got = run(spark, [[("r", t)] for t in texts])
    assert got["r"] == ("conflict", None, ['[".a",".b","@x",".v"]', '[".c"]'])


CASES = [
    (None, None, None, None),
    ("1", None, None, ("deleted", None)),
    ("1", None, "1", ("deleted", None)),
    ("1", None, "2", ("conflict", None)),
    (None, "[]", None, ("merged", "[]")),
    (None, "[1]", "[2]", ("conflict", None)),
    (None, '{"a":1,"b":2.0}', '{"b":2,"a":1}', ("merged", '{"a":1,"b":2}')),
    ("not json", "not json", '{"b": 1}', ("merged", '{"b":1}')),
    ("not json", "nor this", "NaN", ("conflict", None)),
    ("", "", "", ("merged", "")),
    ('{"a":1,"b":1}', '{"b":2,"a":1}', '{"a":3,"b":1}', ("merged", '{"a":3,"b":2}')),
    ('["a","b"]', '["a","c"]', '["d","b"]', ("merged", '["d","c"]')),
    ('["a","b"]', '["a"]', '["a","c"]', ("conflict", None)),
    ("[" * 300 + "1" + "]" * 300, "[" * 300 + "2" + "]" * 300, "[" * 300 + "3" + "]" * 300, ("conflict", None)),
    ("[" * 99999, "{" * 99999, "[", ("conflict", None)),
]


def test_missing_sides_blank_and_broken_texts(spark):
    sides = [
        [("null", None)] + [(str(k), case[side]) for k, case in enumerate(CASES) if case[side] is not None]
        for side in range(3)
    ]
    got = run(spark, sides)
    want = {str(k): case[3] for k, case in enumerate(CASES) if case[3]}
    assert {k: v[:2] for k, v in got.items()} == want
