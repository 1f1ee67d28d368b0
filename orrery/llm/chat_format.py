"""Chat formatting with a small sandboxed template language.

A template is parsed into a syntax tree, constant parts are folded, and the tree becomes nested Python closures, once
for each task. A rendered conversation carries its loss mask: the spans written between the template's generation
markers. Expressions reach only the given values: literals, names, keys of mappings, loop counters, comparisons,
``and``/``or``/``not``, ``~`` (text concatenation) and the filters in ``FILTERS``; there are no calls and no attributes
of Python objects.

    {{ expression }}    {# comment #}    {% set name = expression %}
    {% for name in expression %} ... {% endfor %}
    {% if expression %} ... {% elif expression %} ... {% else %} ... {% endif %}
    {% generation %} ... {% endgeneration %}
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.scratch import slices

# The control strings that texts must not bring in.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<|im_start|>", "<|im_end|>")
_CONTROL = "(?:" + "|".join(re.escape(c) for c in CONTROLS) + ")"
_GUARD, _UNGUARD = re.compile(rf"\\*{_CONTROL}"), re.compile(rf"\\(\\*{_CONTROL})")

TEMPLATE = (
    "{% for m in messages %}<s>{{ m.role | line | guard }}\n"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | guard }}{% endgeneration %}"
    "{% else %}[INST] {{ m.text | guard }}{% endif %}\n</s>\n{% endfor %}"
)
_TURN = re.compile(r"<s>([^\n]*)\n(\[INST\] )?(.*?)\n</s>\n", re.DOTALL)


def guard(text: str) -> str:
    """The text with a backslash before every control string (and before backslashes that precede one)."""
    return _GUARD.sub(lambda m: "\\" + m[0], text)


def unguard(text: str) -> str:
    return _UNGUARD.sub(r"\1", text)


def line(text: str) -> str:
    """The text on one line: backslashes doubled, line feeds as backslash and n."""
    return text.replace("\\", "\\\\").replace("\n", "\\n")


def unline(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text)


FILTERS: dict[str, Callable[[str], str]] = {"guard": guard, "line": line, "trim": str.strip, "upper": str.upper, "lower": str.lower, "length": lambda x: len(x)}


class TemplateError(ValueError):
    """The template isn't in the language, or uses a name that it wasn't given."""


@dataclass
class Rendered:
    """A rendered text in parts, and the spans (code points, ends exclusive) between generation markers."""

    parts: list[str] = field(default_factory=list)
    length: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.length += len(text)

    @property
    def text(self) -> str:
        return "".join(self.parts)


# The syntax tree: tuples that begin with the kind of node.
_TOKEN = re.compile(r"""\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|[~|.()\[\]=]))""")
_PIECE = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}|\{#.*?#\}", re.DOTALL)
_ESCAPES = {"n": "\n", "t": "\t"}


class _Expression:
    """Recursive descent over one expression; ``node`` holds its tree."""

    def __init__(self, source: str) -> None:
        self.tokens, at = [], 0
        while source[at:].strip():
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"unexpected text in expression: {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0
        self.node = self._or()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r} in {source!r}")

    def _take(self, *wanted: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] in ("op", "name") and self.tokens[self.at][1] in wanted:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def _next(self, kind: str) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != kind:
            raise TemplateError(f"a {kind} is missing")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def _or(self) -> tuple:
        node = self._and()
        while self._take("or"):
            node = ("or", node, self._and())
        return node

    def _and(self) -> tuple:
        node = self._not()
        while self._take("and"):
            node = ("and", node, self._not())
        return node

    def _not(self) -> tuple:
        if self._take("not"):
            return ("not", self._not())
        node = self._joined()
        if op := self._take("==", "!=", "in"):
            node = ({"==": "eq", "!=": "ne", "in": "in"}[op], node, self._joined())
        return node

    def _joined(self) -> tuple:
        node = self._filtered()
        while self._take("~"):
            node = ("concat", node, self._filtered())
        return node

    def _filtered(self) -> tuple:
        node = self._key()
        while self._take("|"):
            name = self._next("name")
            if name not in FILTERS:
                raise TemplateError(f"unknown filter {name!r}")
            node = ("filter", node, name)
        return node

    def _key(self) -> tuple:
        node = self._atom()
        while op := self._take(".", "["):
            if op == ".":
                node = ("key", node, ("const", self._next("name")))
            else:
                node = ("key", node, self._or())
                if not self._take("]"):
                    raise TemplateError("a ] is missing")
        return node

    def _atom(self) -> tuple:
        if self._take("("):
            node = self._or()
            if not self._take(")"):
                raise TemplateError("a ) is missing")
            return node
        if self.at >= len(self.tokens):
            raise TemplateError("an expression is missing")
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == "str":
            return ("const", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.DOTALL))
        if kind == "int":
            return ("const", int(text))
        if kind == "name":
            return ("const", {"true": True, "false": False, "none": None}[text]) if text in ("true", "false", "none") else ("name", text)
        raise TemplateError(f"unexpected {text!r}")


def parse(template: str) -> list[tuple]:
    """The syntax tree of a template: a list of nodes."""
    top: list[tuple] = []
    # Open blocks: (kind, what it needs, finished branches, the list being filled).
    stack: list[list] = [["top", None, [], top]]
    at = 0
    for m in _PIECE.finditer(template):
        if m.start() > at:
            stack[-1][3].append(("text", template[at : m.start()]))
        at = m.end()
        if m[1] is not None:
            stack[-1][3].append(("print", _Expression(m[1]).node))
        elif m[2] is not None:
            _statement(m[2].strip(), stack)
    if template[at:]:
        stack[-1][3].append(("text", template[at:]))
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} isn't closed")
    return top


def _statement(source: str, stack: list[list]) -> None:
    word, _, rest = source.partition(" ")
    block = stack[-1]
    if word == "for":
        m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.DOTALL)
        if not m:
            raise TemplateError(f"bad loop {source!r}")
        stack.append(["for", (m[1], _Expression(m[2]).node), [], []])
    elif word == "if":
        stack.append(["if", _Expression(rest).node, [], []])
    elif word == "generation":
        stack.append(["generation", None, [], []])
    elif word == "set":
        name, _, value = rest.partition("=")
        block[3].append(("set", name.strip(), _Expression(value).node))
    elif word in ("elif", "else") and block[0] == "if" and block[1] is not None:
        block[2].append((block[1], block[3]))
        block[1], block[3] = (_Expression(rest).node if word == "elif" else None), []
    elif word in ("endfor", "endif", "endgeneration") and block[0] == word[3:]:
        stack.pop()
        if block[0] == "if":
            branches = [*block[2], (block[1] or ("const", True), block[3])]
            stack[-1][3].append(("if", branches))
        else:
            stack[-1][3].append(("for", *block[1], block[3]) if block[0] == "for" else ("generation", block[3]))
    else:
        raise TemplateError(f"unexpected statement {source!r}")


def fold(nodes: list[tuple]) -> list[tuple]:
    """The tree with constant expressions evaluated, dead branches cut and neighbouring texts joined."""
    out: list[tuple] = []
    for node in nodes:
        kind = node[0]
        new = [node]
        if kind == "print":
            e = fold_expression(node[1])
            new = [("text", _shown(e[1]))] if e[0] == "const" else [("print", e)]
        elif kind == "set":
            new = [("set", node[1], fold_expression(node[2]))]
        elif kind == "for":
            new = [("for", node[1], fold_expression(node[2]), fold(node[3]))]
        elif kind == "generation":
            new = [("generation", fold(node[1]))]
        elif kind == "if":
            branches = []
            for test, body in ((fold_expression(t), fold(b)) for t, b in node[1]):
                if test[0] == "const" and not test[1]:
                    continue
                branches.append((test, body))
                if test[0] == "const":
                    break
            new = branches[0][1] if branches and branches[0][0][0] == "const" else [("if", branches)] if branches else []
        for x in new:
            if x[0] == "text" and out and out[-1][0] == "text":
                out[-1] = ("text", out[-1][1] + x[1])
            elif x != ("text", ""):
                out.append(x)
    return out


def fold_expression(e: tuple) -> tuple:
    if e[0] in ("const", "name"):
        return e
    e = (e[0], *[fold_expression(x) if isinstance(x, tuple) else x for x in e[1:]])
    if all(x[0] == "const" for x in e[1:] if isinstance(x, tuple)):
        return ("const", _evaluator(e)({}))
    return e


def _shown(value: object) -> str:
    return "" if value is None else str(value)


def _evaluator(e: tuple) -> Callable[[dict], object]:
    kind = e[0]
    if kind == "const":
        value = e[1]
        return lambda env: value
    if kind == "name":
        name = e[1]

        def look(env: dict) -> object:
            if name not in env:
                raise TemplateError(f"unknown name {name!r}")
            return env[name]

        return look
    a = _evaluator(e[1])
    if kind == "filter":
        f = FILTERS[e[2]]
        return lambda env: f(_shown(a(env)))
    if kind == "not":
        return lambda env: not a(env)
    b = _evaluator(e[2])
    if kind == "key":

        def key(env: dict) -> object:
            held, k = a(env), b(env)
            if not isinstance(held, dict):
                raise TemplateError("only mappings have keys")
            return held.get(k)

        return key
    if kind == "or":
        return lambda env: a(env) or b(env)
    if kind == "and":
        return lambda env: a(env) and b(env)
    if kind == "concat":
        return lambda env: _shown(a(env)) + _shown(b(env))
    if kind == "eq":
        return lambda env: a(env) == b(env)
    if kind == "ne":
        return lambda env: a(env) != b(env)
    return lambda env: a(env) in (b(env) or "")


def _writer(nodes: list[tuple]) -> Callable[[dict, Rendered], None]:
    steps = [_step(n) for n in nodes]

    def write(env: dict, out: Rendered) -> None:
        for step in steps:
            step(env, out)

    return steps[0] if len(steps) == 1 else write


def _step(node: tuple) -> Callable[[dict, Rendered], None]:
    kind = node[0]
    if kind == "text":
        text = node[1]
        return lambda env, out: out.write(text)
    if kind == "print":
        value = _evaluator(node[1])
        return lambda env, out: out.write(_shown(value(env)))
    if kind == "set":
        name, value = node[1], _evaluator(node[2])
        return lambda env, out: env.__setitem__(name, value(env))
    if kind == "generation":
        body = _writer(node[1])

        def generation(env: dict, out: Rendered) -> None:
            start = out.length
            body(env, out)
            out.spans.append((start, out.length))

        return generation
    if kind == "for":
        name, items, body = node[1], _evaluator(node[2]), _writer(node[3])

        def loop(env: dict, out: Rendered) -> None:
            held = items(env) or []
            if not isinstance(held, (list, tuple)):
                raise TemplateError("a loop needs a list")
            inner = dict(env)
            for i, item in enumerate(held):
                inner[name] = item
                inner["loop"] = {"index0": i, "index": i + 1, "first": i == 0, "last": i == len(held) - 1}
                body(inner, out)

        return loop
    branches = [(_evaluator(t), _writer(b)) for t, b in node[1]]

    def choose(env: dict, out: Rendered) -> None:
        for test, body in branches:
            if test(env):
                body(env, out)
                return

    return choose


def compile_template(template: str) -> Callable[[dict], Rendered]:
    """A function from the template's values to the rendered text."""
    body = _writer(fold(parse(template)))

    def render(values: dict) -> Rendered:
        out = Rendered()
        body(dict(values), out)
        return out

    return render


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a text that ``TEMPLATE`` rendered."""
    return [(unline(unguard(m[1])), unguard(m[3])) for m in _TURN.finditer(formatted)]


FORMAT_SCHEMA = "conv_id long, formatted string, loss_spans array<struct<start:long,end:long>>"


def _format(template: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in slices(batches):
            out = [render({"messages": [{"role": t["role"] or "", "text": t["text"] or ""} for t in turns.as_py()]}) for turns in batch.column(1)]
            spans = pa.array([[{"start": a, "end": b} for a, b in r.spans] for r in out], kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.text for r in out], pa.string()), spans], names=["conv_id", "formatted", "loss_spans"])

    return run


def format_conversations(turns: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """One row for each conversation of (conv_id, turn, role, text) rows: conv_id, formatted, loss_spans.

    Turns go by ``turn``; equal ones by role and text, null ones first. A null role or text is empty, rows with a null
    conv_id form one conversation, repeated rows are repeated turns. A conversation is one record of the result, so
    its turns meet in one task; conversations never do.
    """
    parse(template)  # a bad template fails here, not in a task
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    grouped = turns.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return grouped.mapInArrow(_format(template), FORMAT_SCHEMA)


DIGEST_SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        columns: list[list] = [[] for _ in range(5)]
        for formatted, spans in zip(batch.column("formatted"), batch.column("loss_spans"), strict=True):
            text = formatted.as_py()
            turns = read_back(text)
            loss = "".join(unguard(text[s["start"] : s["end"]]) for s in spans.as_py())
            for c, x in zip(columns, (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)), strict=True):
                c.append(x)
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        arrays = [batch.column("conv_id"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]]
        yield pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in DIGEST_SCHEMA.split(", ")])


def digest_formatted(formatted: DataFrame) -> DataFrame:
    """Figures and digests read back from rows of ``format_conversations`` with the standard template.

    A null conv_id stays null; repeated rows give repeated rows, an empty table gives none.
    """
    return formatted.mapInArrow(_digest, DIGEST_SCHEMA)
