"""Chat formatting: a small template language compiled to Python closures.

A template is cut into tokens, parsed to a syntax tree, constants are folded, and
each node becomes a closure that writes to an output. The language has ``{{ value }}``,
``{% for x in list %}``, ``{% if %}/elif/else`` and ``{% generation %}``, whose text is
under the loss mask; values are strings, numbers, names, attributes, ``==``, ``!=``,
``~``, ``and``, ``or``, ``not`` and the named filters. Nothing else can be reached:
there are no calls, no indexing by expression and no attributes of Python objects.

Control strings inside texts get a backslash behind their first character (one more
if there are some already), so a formatted conversation can be read back exactly.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, MIDDLE, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Strings that mark turns here or in other common formats.
CONTROL = (START, MIDDLE, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]")

TEMPLATE = (
    "{% for turn in turns %}{{ START ~ turn.role|escape ~ MIDDLE }}"
    "{% if turn.role == 'assistant' %}{% generation %}{{ turn.text|escape }}{% endgeneration %}"
    "{% else %}{{ turn.text|escape }}{% endif %}{{ END ~ '\n' }}{% endfor %}"
)

_ANY = "|".join(f"{re.escape(c[0])}(?:BACK){re.escape(c[1:])}" for c in CONTROL)
_TO_ESCAPE = re.compile(_ANY.replace("(?:BACK)", r"\\*"))
_ESCAPED = re.compile(_ANY.replace("(?:BACK)", r"\\+"))


def escape(text: str) -> str:
    return _TO_ESCAPE.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][0] + m[0][2:], text)


# --- the template language ---------------------------------------------------

_PART = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
_TOKEN = re.compile(r"\s*(?:('[^']*'|\"[^\"]*\")|(\d+)|(\w+)|(==|!=|[.|~()]))")
_FILTERS: dict[str, Callable[[str], str]] = {
    "escape": escape,
    "trim": str.strip,
    "upper": str.upper,
    "lower": str.lower,
}


class TemplateError(ValueError):
    """The template is not in the language."""


class _Output:
    """Written text and the spans under the loss mask, in code points."""

    def __init__(self):
        self.parts: list[str] = []
        self.size = 0
        self.spans: list[tuple[int, int]] = []

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.size += len(text)


class _Values:
    """Recursive descent over the tokens of one expression. Nodes are tuples."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if m is None:
                raise TemplateError(f"not understood: {source[at:]!r}")
            kind = ("text", "number", "name", "sign")[m.lastindex - 1]
            self.tokens.append((kind, m[m.lastindex]))
            at = m.end()
        self.at = 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, *wanted: str) -> str | None:
        kind, value = self.peek()
        if kind in ("sign", "name") and value in wanted:
            self.at += 1
            return value
        return None

    def whole(self):
        node = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"left over: {self.peek()[1]!r}")
        return node

    def either(self):
        node = self.both()
        while self.take("or"):
            node = ("or", node, self.both())
        return node

    def both(self):
        node = self.negated()
        while self.take("and"):
            node = ("and", node, self.negated())
        return node

    def negated(self):
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self):
        node = self.joined()
        if sign := self.take("==", "!="):
            node = (sign, node, self.joined())
        return node

    def joined(self):
        node = self.filtered()
        while self.take("~"):
            node = ("~", node, self.filtered())
        return node

    def filtered(self):
        node = self.single()
        while True:
            if self.take("|"):
                name = self.peek()[1]
                if name not in _FILTERS:
                    raise TemplateError(f"no filter {name!r}")
                self.at += 1
                node = ("filter", name, node)
            elif self.take("."):
                kind, name = self.peek()
                if kind != "name" or name.startswith("_"):
                    raise TemplateError(f"no attribute {name!r}")
                self.at += 1
                node = ("attribute", name, node)
            else:
                return node

    def single(self):
        if self.take("("):
            node = self.either()
            if not self.take(")"):
                raise TemplateError("a bracket is not closed")
            return node
        kind, value = self.peek()
        self.at += 1
        if kind == "text":
            return ("constant", value[1:-1])
        if kind == "number":
            return ("constant", int(value))
        if kind == "name" and not value.startswith("_"):
            return ("name", value)
        raise TemplateError(f"no value: {value!r}")


def parse(template: str) -> list:
    """Syntax tree of a template: a list of nodes."""
    parts: list[tuple[str, str]] = []
    at = 0
    for m in _PART.finditer(template):
        parts.append(("text", template[at : m.start()]))
        parts.append(("value", m[1]) if m[1] is not None else ("tag", m[2].strip()))
        at = m.end()
    parts.append(("text", template[at:]))
    body, rest = _block(iter(parts), ())
    if rest is not None:
        raise TemplateError(f"unexpected {rest!r}")
    return body


def _block(parts: Iterator, ends: tuple[str, ...]) -> tuple[list, str | None]:
    """Nodes up to one of the tags ``ends``, and that tag."""
    nodes: list = []
    for kind, value in parts:
        if kind == "text":
            if value:
                nodes.append(("write", ("constant", value)))
            continue
        if kind == "value":
            nodes.append(("write", _Values(value).whole()))
            continue
        word, _, rest = value.partition(" ")
        if word in ends:
            return nodes, value
        if word == "for":
            m = re.fullmatch(r"(\w+) in (.+)", rest.strip())
            if not m:
                raise TemplateError(f"for {rest!r}")
            body, _ = _block(parts, ("endfor",))
            nodes.append(("for", m[1], _Values(m[2]).whole(), body))
        elif word == "generation":
            body, _ = _block(parts, ("endgeneration",))
            nodes.append(("generation", body))
        elif word == "if":
            nodes.append(_condition(parts, rest))
        else:
            raise TemplateError(f"unexpected {value!r}")
    if ends:
        raise TemplateError(f"no {ends[-1]!r}")
    return nodes, None


def _condition(parts: Iterator, test: str):
    body, end = _block(parts, ("elif", "else", "endif"))
    word, _, rest = (end or "").partition(" ")
    other: list = []
    if word == "elif":
        other = [_condition(parts, rest)]
    elif word == "else":
        other, _ = _block(parts, ("endif",))
    return ("if", _Values(test).whole(), body, other)


def fold(node, constants: dict):
    """The node with everything worked out that does not depend on the data."""
    kind = node[0]
    if kind == "name" and node[1] in constants:
        return ("constant", constants[node[1]])
    if kind in ("constant", "name"):
        return node
    if kind in ("filter", "attribute"):
        inner = fold(node[2], constants)
        done = kind == "filter" and inner[0] == "constant"
        return ("constant", _FILTERS[node[1]](str(inner[1]))) if done else (kind, node[1], inner)
    inner = [fold(x, constants) for x in node[1:]]
    if kind == "~" and inner[1][0] == "constant" and inner[0][0] == "~" and inner[0][2][0] == "constant":
        tail = ("constant", str(inner[0][2][1]) + str(inner[1][1]))
        return ("~", inner[0][1], tail)
    if all(x[0] == "constant" for x in inner):
        return ("constant", _value((kind, *inner))({}))
    return (kind, *inner)


def _fold_body(nodes: list, constants: dict) -> list:
    """Nodes folded; adjacent constant text becomes one, branches known beforehand stay alone."""
    out: list = []
    for node in nodes:
        kind = node[0]
        if kind == "write":
            node = ("write", fold(node[1], constants))
            if out and out[-1][0] == "write" and out[-1][1][0] == node[1][0] == "constant":
                node = ("write", ("constant", str(out.pop()[1][1]) + str(node[1][1])))
        elif kind == "for":
            hidden = {k: v for k, v in constants.items() if k not in (node[1], "loop")}
            node = ("for", node[1], fold(node[2], constants), _fold_body(node[3], hidden))
        elif kind == "generation":
            node = ("generation", _fold_body(node[1], constants))
        else:
            test = fold(node[1], constants)
            branches = _fold_body(node[2], constants), _fold_body(node[3], constants)
            if test[0] == "constant":
                out.extend(branches[0] if test[1] else branches[1])
                continue
            node = ("if", test, *branches)
        out.append(node)
    return out


def _value(node) -> Callable[[dict], object]:
    """Closure that works a value out from the names in scope."""
    kind = node[0]
    if kind == "constant":
        return lambda scope, value=node[1]: value
    if kind == "name":
        return lambda scope, name=node[1]: scope.get(name, "")
    if kind == "attribute":
        return lambda scope, name=node[1], of=_value(node[2]): _attribute(of(scope), name)
    if kind == "filter":
        return lambda scope, f=_FILTERS[node[1]], of=_value(node[2]): f(str(of(scope)))
    first = _value(node[1])
    if kind == "not":
        return lambda scope: not first(scope)
    second = _value(node[2])
    return {
        "or": lambda scope: first(scope) or second(scope),
        "and": lambda scope: first(scope) and second(scope),
        "==": lambda scope: first(scope) == second(scope),
        "!=": lambda scope: first(scope) != second(scope),
        "~": lambda scope: str(first(scope)) + str(second(scope)),
    }[kind]


def _attribute(value, name: str):
    if not isinstance(value, dict):
        raise TemplateError(f"no attribute {name!r}")
    return value.get(name, "")


def _writer(nodes: list) -> Callable[[dict, _Output], None]:
    steps = [_step(node) for node in nodes]

    def write(scope: dict, out: _Output) -> None:
        for step in steps:
            step(scope, out)

    return write


def _step(node) -> Callable[[dict, _Output], None]:
    kind = node[0]
    if kind == "write":
        return lambda scope, out, of=_value(node[1]): out.write(str(of(scope)))
    if kind == "if":
        test, yes, no = _value(node[1]), _writer(node[2]), _writer(node[3])
        return lambda scope, out: (yes if test(scope) else no)(scope, out)
    if kind == "generation":
        body = _writer(node[1])

        def mark(scope: dict, out: _Output) -> None:
            start = out.size
            body(scope, out)
            if out.size > start:
                out.spans.append((start, out.size))

        return mark
    name, items, body = node[1], _value(node[2]), _writer(node[3])

    def loop(scope: dict, out: _Output) -> None:
        found = items(scope)
        if not isinstance(found, list):
            raise TemplateError("only lists can be looped over")
        for k, item in enumerate(found):
            place = {"index0": k, "index": k + 1, "first": k == 0, "last": k + 1 == len(found)}
            body(scope | {name: item, "loop": place}, out)

    return loop


def compile_template(template: str, **constants) -> Callable[..., tuple[str, list]]:
    """Function of the names in the template that gives text and loss-mask spans."""
    write = _writer(_fold_body(parse(template), constants))

    def render(**names) -> tuple[str, list[tuple[int, int]]]:
        out = _Output()
        write(names, out)
        return "".join(out.parts), out.spans

    return render


# --- conversations ------------------------------------------------------------


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a conversation formatted by ``TEMPLATE``."""
    turns = []
    at = 0
    while at < len(formatted):
        middle = formatted.index(MIDDLE, at)
        end = formatted.index(END, middle)
        if not formatted.startswith(START, at) or formatted[end + len(END)] != "\n":
            raise ValueError("not a formatted conversation")
        role = formatted[at + len(START) : middle]
        turns.append((unescape(role), unescape(formatted[middle + len(MIDDLE) : end])))
        at = end + len(END) + 1
    return turns


def _conversations(batches) -> Iterator[tuple[object, list[dict]]]:
    """(id, turns) of each conversation of a partition sorted by conversation."""
    current, turns, started = None, [], False
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in range(3)]
        for conv, role, text in zip(*columns, strict=True):
            if started and conv != current:
                yield current, turns
                turns = []
            current, started = conv, True
            turns.append({"role": role or "", "text": text or ""})
    if started:
        yield current, turns


def formatted(turns: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """One row per conversation: ``conv_id, formatted, spans`` (loss mask, code points).

    ``turns`` has ``conv_id, turn, role, text``; rows go by turn, rows of one turn by
    role and text, nulls first; a null role or text is empty, a null conv_id is a
    conversation of its own, repeated rows are repeated turns. Other columns are not
    looked at; no rows give no rows. One shuffle by conversation; tasks read their
    sorted rows as a stream and hold one conversation, which is one output row.
    """

    def render(batches):
        write = compile_template(template, START=START, MIDDLE=MIDDLE, END=END)
        rows, size = [], 0
        for conv, of in _conversations(batches):
            text, spans = write(turns=of)
            rows.append((conv, text, [{"start": a, "stop": b} for a, b in spans]))
            size += len(text)
            if size > 4 << 20:
                yield batch_of(rows)
                rows, size = [], 0
        yield batch_of(rows)

    span = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
    conv_kind = turns.schema["conv_id"].dataType.simpleString()

    def batch_of(rows):
        kinds = (pa.int64() if conv_kind != "string" else pa.string(), pa.string(), pa.list_(span))
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, ["conv_id", "formatted", "spans"])

    return (
        turns.select("conv_id", "turn", "role", "text")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .select("conv_id", "role", "text")
        .mapInArrow(
            render,
            f"conv_id {'string' if conv_kind == 'string' else 'long'}, formatted string, "
            "spans array<struct<start: long, stop: long>>",
        )
    )


def read_turns(formatted_rows: DataFrame) -> DataFrame:
    """Formatted conversations with ``turns`` (role and text) and ``loss`` (the text under
    the mask) read back from them. Every row is handled alone: no shuffle."""

    def parse_rows(batches):
        turn = pa.struct([("role", pa.string()), ("text", pa.string())])
        for batch in batches:
            texts, spans = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            turns = [[{"role": r, "text": t} for r, t in read_back(x)] for x in texts]
            loss = [
                "".join(unescape(x[s["start"] : s["stop"]]) for s in of)
                for x, of in zip(texts, spans, strict=True)
            ]
            more = [pa.array(turns, pa.list_(turn)), pa.array(loss, pa.string())]
            names = ["conv_id", "formatted", "turns", "loss"]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *more], names)

    kind = formatted_rows.schema["conv_id"].dataType.simpleString()
    return formatted_rows.select("conv_id", "formatted", "spans").mapInArrow(
        parse_rows,
        f"conv_id {kind}, formatted string, turns array<struct<role: string, text: string>>, "
        "loss string",
    )


def turn_lines(turns: str = "turns") -> Column:
    """role, line feed, text, line feed of each turn in a row."""
    line = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    return F.array_join(F.transform(turns, line), "")
