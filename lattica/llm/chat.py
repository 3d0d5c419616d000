r"""Operator 12: chat formatting by a compiler for a small, sandboxed template language.

A template is parsed into a tree, constant parts are folded, and what is left becomes Python closures that
walk a stream of messages and yield pieces of text, each with or without the mark of a generation
(the text that a loss is taken over). The language:

    {{ expression }}   {% for m in messages %} ... {% endfor %}   {% generation %} ... {% endgeneration %}
    {% if e %} ... {% elif e %} ... {% else %} ... {% endif %}    {% set name = e %}    {# comment #}

Expressions have strings, whole numbers, true, false, none, names, fields (m.role, m['role']), `loop.first`, `loop.last`,
`loop.index`, `loop.index0`, + and ~ (both join or add), == != < <= > >= in, `not`, `and`, `or`, parentheses, and filters
(| upper, lower, trim, length, default(x), escape, escape('more', ...)). A dash beside a percent sign or brace eats the
white space there. Nothing else can be reached: fields are keys of mappings only, there are no calls, no
attributes, and one loop, over the messages, which are read once and never held together.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, ship, stage

ship(__name__)

#: Strings that mark turns; in roles and texts a backslash goes before them.
HEAD, ROLE_END, END = "### ", ":", "</turn>"
CONTROLS = (HEAD, END)
TEMPLATE = (
    "{% for m in messages %}### {{ m.role | escape(':') }}:\n"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}"
    "</turn>\n{% endfor %}"
)
#: Characters of a template and depth of its nesting at most.
LONGEST, DEEPEST = 100_000, 50
#: Characters after which a formatted conversation goes on in another row.
PART = 1_000_000

FORMATTED = "conv_id bigint, part int, last boolean, text string, loss array<struct<start:int,end:int>>"
DIGESTS = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


class TemplateError(ValueError):
    """A template that the language doesn't allow."""


# ---------------------------------------------------------------- escapes
def check_controls(controls: Iterable[str]) -> tuple[str, ...]:
    """The control strings, if escaping them can be undone.

    None may hold a backslash, and none may begin with what another or itself ends with: then a
    control string that stands in the output without a backslash before it is the template's own.
    """
    controls = tuple(controls)
    for a, b in itertools.product(controls, repeat=2):
        if not a or "\\" in a or any(b.startswith(a[k:]) for k in range(1, len(a))) or (a != b and a in b):
            raise TemplateError(f"control strings {a!r} and {b!r} can't be told apart")
    return controls


def escape(text: str, controls: Iterable[str]) -> str:
    text = text.replace("\\", "\\\\")
    for c in controls:
        text = text.replace(c, "\\" + c)
    return text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL) if "\\" in text else text


def find(text: str, control: str, start: int) -> int:
    """Where an unescaped control string stands at or after `start`, a place that isn't inside an escape; -1 if nowhere."""
    at = text.find(control, start)
    while at >= 0:
        back = at
        while back > start and text[back - 1] == "\\":
            back -= 1
        if (at - back) % 2 == 0:
            return at
        at = text.find(control, at + 1)
    return -1


# ---------------------------------------------------------------- syntax tree
_TOKEN = re.compile(r"\s*(?:(?P<name>[A-Za-z_]\w*)|(?P<int>\d+)|(?P<str>'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\")|(?P<op>==|!=|<=|>=|[<>+~|().,=\[\]]))", re.DOTALL)
_PIECE = re.compile(r"\{\{-?(.*?)-?\}\}|\{%-?(.*?)-?%\}|\{#-?.*?-?#\}", re.DOTALL)
_ESCAPES = {"n": "\n", "t": "\t"}
_WORDS = {"true": True, "false": False, "none": None}


def _tokens(source: str) -> list[tuple[str, str]]:
    out, at, source = [], 0, source.strip()
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"can't read {source[at : at + 20]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return [*out, ("end", "")]


class _Expression:
    """A recursive descent over one expression: nodes are tuples (kind, ...)."""

    def __init__(self, tokens: list[tuple[str, str]]):
        self.tokens, self.at, self.depth = tokens, 0, 0

    def take(self, *texts: str) -> str | None:
        kind, text = self.tokens[self.at]
        if kind in ("op", "name") and text in texts:
            self.at += 1
            return text
        return None

    def need(self, text: str) -> None:
        if not self.take(text):
            raise TemplateError(f"{text!r} is missing before {self.tokens[self.at][1]!r}")

    def name(self) -> str:
        kind, text = self.tokens[self.at]
        if kind != "name":
            raise TemplateError(f"a name is missing before {text!r}")
        self.at += 1
        return text

    def finish(self) -> None:
        if self.tokens[self.at][0] != "end":
            raise TemplateError(f"{self.tokens[self.at][1]!r} is too much")

    def whole(self):
        self.depth += 1
        if self.depth > DEEPEST:
            raise TemplateError("an expression is nested too deeply")
        node = self.both()
        while self.take("or"):
            node = ("op", "or", node, self.both())
        self.depth -= 1
        return node

    def both(self):
        node = self.negated()
        while self.take("and"):
            node = ("op", "and", node, self.negated())
        return node

    def negated(self):
        nots = 0
        while self.take("not"):
            nots += 1
        node = self.compared()
        return ("op", "not", ("op", "not", node)) if nots and nots % 2 == 0 else ("op", "not", node) if nots else node

    def compared(self):
        node = self.joined()
        sign = self.take("==", "!=", "<", "<=", ">", ">=", "in")
        return ("op", sign, node, self.joined()) if sign else node

    def joined(self):
        node = self.filtered()
        while sign := self.take("+", "~"):
            node = ("op", sign, node, self.filtered())
        return node

    def filtered(self):
        node = self.field()
        while self.take("|"):
            name, args = self.name(), []
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            if self.take("("):
                while not self.take(")"):
                    args.append(self.whole())
                    if not self.take(","):
                        self.need(")")
                        break
            node = ("filter", name, node, *args)
        return node

    def field(self):
        node = self.simple()
        while sign := self.take(".", "["):
            key = ("const", self.name()) if sign == "." else self.whole()
            if sign == "[":
                self.need("]")
            node = ("field", node, key)
        return node

    def simple(self):
        if self.take("("):
            node = self.whole()
            self.need(")")
            return node
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == "int":
            return ("const", int(text))
        if kind == "str":
            return ("const", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.DOTALL))
        if kind == "name":
            return ("const", _WORDS[text]) if text in _WORDS else ("name", text)
        raise TemplateError(f"an expression is missing before {text!r}")


def parse(source: str) -> list:
    """The statements of a template: ("text", s), ("out", e), ("if", e, body, other), ("for", name, body), ("set", name, e), ("generation", body)."""
    if len(source) > LONGEST:
        raise TemplateError(f"a template has {LONGEST} characters at most")
    pieces, at, eat = [], 0, False
    for m in _PIECE.finditer(source):
        text = source[at : m.start()]
        text = text.lstrip() if eat else text
        pieces.append(("text", text.rstrip() if m[0][2] == "-" else text))
        eat, at = m[0][-3] == "-", m.end()
        pieces += [("out", m[1])] if m[1] is not None else [("tag", m[2])] if m[2] is not None else []
    pieces.append(("text", source[at:].lstrip() if eat else source[at:]))
    stream, loops = iter([p for p in pieces if p != ("text", "")]), []

    def block(ends: tuple[str, ...], depth: int, inside: tuple[str, ...]) -> tuple[list, str, _Expression | None]:
        if depth > DEEPEST:
            raise TemplateError("a template is nested too deeply")
        out = []
        for kind, text in stream:
            if kind == "text":
                if "{{" in text or "{%" in text:
                    raise TemplateError(f"a tag isn't closed in {text[:40]!r}")
                out.append((kind, text))
                continue
            e = _Expression(_tokens(text))
            if kind == "out":
                out.append(("out", e.whole()))
                e.finish()
                continue
            tag = e.name()
            if tag in ends:
                return out, tag, e
            if tag == "for":
                name = e.name()
                e.need("in")
                e.need("messages")
                e.finish()
                loops.append(name)
                if len(loops) > 1:
                    raise TemplateError("the messages are read once")
                body, _, end = block(("endfor",), depth + 1, (*inside, tag))
                out.append(("for", name, body))
            elif tag == "if":
                test = e.whole()
                e.finish()
                out.append(branches(test, depth, inside))
                continue
            elif tag == "generation":
                if tag in inside:
                    raise TemplateError("generations aren't nested")
                e.finish()
                body, _, end = block(("endgeneration",), depth + 1, (*inside, tag))
                out.append(("generation", body))
            elif tag == "set":
                name = e.name()
                e.need("=")
                out.append(("set", name, e.whole()))
                end = e
            else:
                raise TemplateError(f"no statement {tag!r}")
            end.finish()
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return out, "", None

    def branches(test, depth: int, inside: tuple[str, ...]):
        body, tag, e = block(("elif", "else", "endif"), depth + 1, inside)
        other: list = []
        if tag == "elif":
            again = e.whole()
            e.finish()
            other = [branches(again, depth + 1, inside)]
        else:
            e.finish()
            if tag == "else":
                other, _, e = block(("endif",), depth + 1, inside)
                e.finish()
        return ("if", test, body, other)

    return block((), 0, ())[0]


# ---------------------------------------------------------------- meaning, folding and closures
def _text(value) -> str:
    return "" if value is None else str(value).lower() if isinstance(value, bool) else str(value)


def _add(a, b):
    return a + b if isinstance(a, int) and isinstance(b, int) else _text(a) + _text(b)


def _ordered(less: Callable) -> Callable:
    return lambda a, b: type(a) is type(b) and isinstance(a, int | str) and less(a, b)


OPERATIONS: dict[str, Callable] = {
    "+": _add, "~": lambda a, b: _text(a) + _text(b), "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "not": lambda a: not a,
    "<": _ordered(lambda a, b: a < b), "<=": _ordered(lambda a, b: a <= b), ">": _ordered(lambda a, b: a > b), ">=": _ordered(lambda a, b: a >= b),
    "in": lambda a, b: (a in b) if isinstance(b, dict) else _text(a) in _text(b), "and": lambda a, b: a and b, "or": lambda a, b: a or b,
}
FILTERS: dict[str, Callable] = {
    "upper": lambda x: _text(x).upper(), "lower": lambda x: _text(x).lower(), "trim": lambda x: _text(x).strip(), "length": lambda x: len(_text(x)),
    "default": lambda x, other: other if x is None or x == "" else x, "escape": lambda x, *more: escape(_text(x), (*CONTROLS, *more)),
}


def _field(value, key):
    return value.get(key) if isinstance(value, dict) else None


def fold(node: tuple) -> tuple:
    """An expression with its constant parts worked out."""
    kind, *rest = node
    if kind in ("const", "name"):
        return node
    if kind == "field":
        parts = [fold(x) for x in rest]
        return ("const", _field(parts[0][1], parts[1][1])) if all(p[0] == "const" for p in parts) else (kind, *parts)
    name, parts = rest[0], [fold(x) for x in rest[1:]]
    if all(p[0] == "const" for p in parts):
        return ("const", (OPERATIONS if kind == "op" else FILTERS)[name](*[p[1] for p in parts]))
    if name in ("and", "or") and parts[0][0] == "const":
        return parts[1] if bool(parts[0][1]) == (name == "and") else parts[0]
    return (kind, name, *parts)


def fold_block(body: list) -> list:
    """Statements with folded expressions: constant output is text, constant branches are decided, texts are joined."""
    out: list = []
    for kind, *rest in body:
        if kind == "out":
            e = fold(rest[0])
            new = [("text", _text(e[1]))] if e[0] == "const" else [("out", e)]
        elif kind == "if":
            e, then, other = fold(rest[0]), fold_block(rest[1]), fold_block(rest[2])
            new = (then if e[1] else other) if e[0] == "const" else [("if", e, then, other)]
        elif kind == "set":
            new = [("set", rest[0], fold(rest[1]))]
        elif kind == "text":
            new = [("text", rest[0])]
        else:
            new = [(kind, *rest[:-1], fold_block(rest[-1]))]
        for x in new:
            if x[0] == "text" and out and out[-1][0] == "text":
                out[-1] = ("text", out[-1][1] + x[1])
            elif x != ("text", ""):
                out.append(x)
    return out


def _value(node: tuple) -> Callable[[dict], object]:
    """A closure that works an expression out in a scope."""
    kind, *rest = node
    if kind == "const":
        return lambda scope, x=rest[0]: x
    if kind == "name":
        return lambda scope, x=rest[0]: scope.get(x)
    if kind == "field":
        of, key = map(_value, rest)
        return lambda scope: _field(of(scope), key(scope))
    name, parts = rest[0], [_value(x) for x in rest[1:]]
    if name in ("and", "or"):
        a, b = parts
        return (lambda scope: a(scope) and b(scope)) if name == "and" else (lambda scope: a(scope) or b(scope))
    work = (OPERATIONS if kind == "op" else FILTERS)[name]
    if len(parts) == 1:
        one = parts[0]
        return lambda scope: work(one(scope))
    return lambda scope: work(*[p(scope) for p in parts])


def _block(body: list, mask: bool = False) -> Callable[[dict], Iterator[tuple[str, bool]]]:
    """A closure that yields the pieces (text, whether a loss is taken over it) of statements."""
    steps = []
    for kind, *rest in body:
        if kind == "text":
            steps.append(lambda scope, s=rest[0]: ((s, mask),))
        elif kind == "out":
            steps.append(lambda scope, f=_value(rest[0]): ((_text(f(scope)), mask),))
        elif kind == "set":
            steps.append(lambda scope, name=rest[0], f=_value(rest[1]): scope.__setitem__(name, f(scope)) or ())
        elif kind == "if":
            steps.append(lambda scope, f=_value(rest[0]), a=_block(rest[1], mask), b=_block(rest[2], mask): a(scope) if f(scope) else b(scope))
        elif kind == "generation":
            steps.append(_block(rest[0], True))
        else:
            steps.append(_loop(rest[0], _block(rest[1], mask)))

    def run(scope: dict) -> Iterator[tuple[str, bool]]:
        for step in steps:
            yield from step(scope)

    return run


def _loop(name: str, body: Callable[[dict], Iterator[tuple[str, bool]]]) -> Callable[[dict], Iterator[tuple[str, bool]]]:
    def run(scope: dict) -> Iterator[tuple[str, bool]]:
        messages, index = iter(scope["messages"]), 0
        now = next(messages, None)
        while now is not None:
            then = next(messages, None)
            scope[name], scope["loop"] = now, {"first": index == 0, "last": then is None, "index0": index, "index": index + 1}
            yield from body(scope)
            now, index = then, index + 1

    return run


def compiled(source: str) -> Callable[[Iterable[dict]], Iterator[tuple[str, bool]]]:
    """The template as a function from messages (role, text) to pieces (text, whether a loss is taken over it)."""
    run = _block(fold_block(parse(source)))
    return lambda messages: run({"messages": messages})


# ---------------------------------------------------------------- conversations
def _rows(batches: Iterable) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _batches(rows: Iterable[tuple], schema, size: Callable[[tuple], int]) -> Iterator:
    """Arrow batches of some megabytes."""
    import pyarrow as pa

    held, n = [], 0
    batch = lambda: pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], f.type) for i, f in enumerate(schema)], schema=schema)
    for row in rows:
        held.append(row)
        n += size(row)
        if n > 4 * PART or len(held) == 10_000:
            yield batch()
            held, n = [], 0
    if held:
        yield batch()


def parts(pieces: Iterable[tuple[str, bool]], limit: int = PART) -> Iterator[tuple[int, bool, str, list[dict]]]:
    """Pieces as parts (number, whether it is the last, text, spans of the loss) of about `limit` characters; no piece is cut."""
    number, texts, spans, n = 0, [], [], 0
    for text, mask in pieces:
        if n >= limit and text:
            yield number, False, "".join(texts), spans
            number, texts, spans, n = number + 1, [], [], 0
        if mask and text:
            spans.append({"start": n, "end": n + len(text)})
        texts.append(text)
        n += len(text)
    yield number, True, "".join(texts), spans


def _formatter(template: str, limit: int):
    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("last", pa.bool_()), ("text", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])
        render = compiled(template)

        def rows() -> Iterator[tuple]:
            for conv, turns in itertools.groupby(_rows(batches), key=lambda r: r[0]):
                for part in parts(render({"role": role, "text": text} for _, role, text in turns), limit):
                    yield (conv, *part)

        yield from _batches(rows(), schema, lambda r: len(r[3]))

    return work


def format_conversations(conversations: DataFrame, template: str = TEMPLATE, limit: int = PART) -> DataFrame:
    """Rows (conv_id, part, last, text, loss) of conversations (conv_id, turn, role, text), rendered by the template.

    The turns stand in the order of turn, then of role and text; null turns come first. Null roles and texts
    are empty, repeated rows are turns of their own, and rows without a conv_id are one conversation. Other
    columns are ignored. loss: spans (start, end) of a part's text. A conversation is a stream within
    one task, of which a turn and a part are held at a time; long ones take several parts.
    """
    check_controls((*CONTROLS, ROLE_END))
    compiled(template)  # an error here, not on the executors
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text").mapInArrow(_formatter(template, limit), FORMATTED)


def turns(texts: Iterable[str]) -> Iterator[tuple[str, str]]:
    """The (role, text) of each turn in formatted text that comes in parts, as TEMPLATE wrote them."""
    left = ""
    for text in texts:
        left, at = left + text, 0
        while True:
            colon = find(left, ROLE_END + "\n", at + len(HEAD))
            end = find(left, END + "\n", colon + 2) if colon >= 0 else -1
            if end < 0:
                break
            yield unescape(left[at + len(HEAD) : colon]), unescape(left[colon + 2 : end])
            at = end + len(END) + 1
        left = left[at:]
    if left:
        raise ValueError(f"{len(left)} characters that aren't a turn")


def _reader(batches: Iterator) -> Iterator:
    import pyarrow as pa

    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def rows() -> Iterator[tuple]:
        for conv, group in itertools.groupby(_rows(batches), key=lambda r: r[0]):
            of_turns, of_loss, counts = hashlib.sha256(), hashlib.sha256(), [0, 0, 0]

            def texts() -> Iterator[str]:
                for _, text, loss in group:  # noqa: B023
                    counts[2] += len(text)  # noqa: B023
                    for span in loss or ():
                        said = unescape(text[span["start"] : span["end"]])
                        counts[1] += len(said)  # noqa: B023
                        of_loss.update(said.encode())  # noqa: B023
                    yield text

            for role, text in turns(texts()):
                counts[0] += 1
                of_turns.update(f"{role}\n{text}\n".encode())
            yield conv, counts[0], of_turns.hexdigest(), counts[1], of_loss.hexdigest(), counts[2]

    yield from _batches(rows(), schema, lambda r: 300)


def read_back(formatted: DataFrame) -> DataFrame:
    """Rows (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of what TEMPLATE formatted.

    turns_sha256 is of role, newline, text and newline of every turn; loss_sha256 of all text under the
    spans of loss; formatted_chars counts escapes and marks. Conversations of one part, nearly all, are
    read where they stand; the others are brought together first.
    """
    whole = (F.col("part") == 0) & F.col("last")
    there = formatted.where(whole).select("conv_id", "text", "loss").mapInArrow(_reader, DIGESTS)
    rest = formatted.where(~whole).repartition("conv_id").sortWithinPartitions("conv_id", "part").select("conv_id", "text", "loss")
    return there.unionByName(rest.mapInArrow(_reader, DIGESTS))


def round_trip(conversations: DataFrame) -> DataFrame:
    """The digests of all conversations, read back from the formatted table in the shared folder."""
    formatted = stage(format_conversations(conversations), "formatted")
    out = stage(read_back(formatted), "digests")
    discard(formatted)
    return out

