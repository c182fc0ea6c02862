"""Chat formatting by a compiled template.

A template is text with `{{ expression }}` and statements: `{% for m in messages %}`
... `{% endfor %}`, `{% if expression %}` ... `{% elif %}`, `{% else %}`, `{% endif %}`,
`{% set name = expression %}` and `{% generation %}` ... `{% endgeneration %}`, which
marks what a model is to learn. An expression has strings, whole numbers, true, false,
none, names, `loop.first`, `loop.last`, `loop.index`, `loop.index0`, `name.key`,
`name['key']`, `+`, `~`, comparisons, `and`, `or`, `not`, brackets and the filters `escape`,
`trim`, `lower`, `upper`. There are no calls and no other attributes, so a template can reach
nothing but what it is given.

The template is parsed into a syntax tree, constant expressions and neighbouring texts
are folded, branches with constant conditions are chosen, and every node becomes a closure
that yields (text, learned) pieces. `messages` may be any iterator: a conversation is rendered
while its rows stream by, so a very long one needs no more memory than a short one.

`escape` makes control strings inside texts harmless and can be undone: the sign U+2060 is put
behind the first character of every control string, and behind every such sign that a text has
in a place where it could be mistaken.

Defined results: null roles and texts are empty. Rows of a conversation follow turn, then role,
then text; repeated rows are turns of their own; null turns come first. Rows without a conv_id form
one conversation, with a null conv_id. Further columns are not read. An empty table gives an empty
result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"\s*(?:(?P<string>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<number>\d+)"
    r"|(?P<name>[A-Za-z_]\w*)|(?P<sign>==|!=|<=|>=|[-+~<>()\[\].|]))"
)
_TAG = re.compile(r"(\{\{.*?\}\}|\{%.*?%\})", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


class TemplateError(ValueError):
    """A template that is not of the language."""


# --- syntax tree --------------------------------------------------------------
# Expressions: ("const", value), ("name", n), ("attr", e, key), ("not", e), ("filter", name, e) and
# (operator, a, b). Statements: ("text", s), ("out", e), ("if", [(e, body)], body),
# ("for", name, e, body), ("set", name, e), ("generation", body).


class _Expression:
    """One expression, read from left to right."""

    LEVELS = (("or",), ("and",), ("==", "!=", "<", "<=", ">", ">="), ("+", "~"))

    def __init__(self, source: str):
        self.tokens: list[tuple[str, str]] = []
        at, source = 0, source.strip()
        while at < len(source):
            found = _TOKEN.match(source, at)
            if not found:
                raise TemplateError(f"cannot read {source[at:]!r}")
            self.tokens.append((found.lastgroup, found[found.lastgroup]))
            at = found.end()
        self.at = 0

    def peek(self) -> str:
        return self.tokens[self.at][1] if self.at < len(self.tokens) else ""

    def take(self, *wanted: str) -> bool:
        kind = self.tokens[self.at][0] if self.at < len(self.tokens) else ""
        if kind in ("sign", "name") and self.peek() in wanted:
            self.at += 1
            return True
        return False

    def need(self, sign: str) -> None:
        if not self.take(sign):
            raise TemplateError(f"{sign!r} expected before {self.peek()!r}")

    def whole(self) -> tuple:
        tree = self.level(0)
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.peek()!r}")
        return tree

    def level(self, k: int) -> tuple:
        if k == 2 and self.take("not"):
            return ("not", self.level(2))
        if k == len(self.LEVELS):
            return self.postfix()
        tree = self.level(k + 1)
        while self.take(*self.LEVELS[k]):
            sign = self.tokens[self.at - 1][1]
            tree = (sign, tree, self.level(k + 1))
        return tree

    def postfix(self) -> tuple:
        tree = self.atom()
        while True:
            if self.take("."):
                tree = ("attr", tree, self.word())
            elif self.take("["):
                key = self.atom()
                if key[0] != "const" or not isinstance(key[1], str):
                    raise TemplateError("only fixed keys can be looked up")
                self.need("]")
                tree = ("attr", tree, key[1])
            elif self.take("|"):
                name = self.word()
                if name not in _FILTERS:
                    raise TemplateError(f"no filter {name!r}")
                tree = ("filter", name, tree)
            else:
                return tree

    def word(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
            raise TemplateError("a name is expected")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def atom(self) -> tuple:
        if self.take("("):
            tree = self.level(0)
            self.need(")")
            return tree
        if self.at >= len(self.tokens):
            raise TemplateError("an expression is expected")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "string":
            plain = re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.S)
            return ("const", plain)
        if kind == "number":
            return ("const", int(value))
        if kind == "name":
            fixed = {"true": True, "false": False, "none": None}
            return ("const", fixed[value.lower()]) if value.lower() in fixed else ("name", value)
        raise TemplateError(f"unexpected {value!r}")


_FILTERS: dict[str, Callable[[str], str] | None] = {
    "escape": None, "trim": str.strip, "lower": str.lower, "upper": str.upper,
}


def parse(source: str) -> list[tuple]:
    """The statements of a template."""
    parts = _TAG.split(source)
    for i in range(1, len(parts), 2):
        tag = parts[i]
        if tag[2] == "-":
            parts[i - 1] = parts[i - 1].rstrip()
        if tag[-3] == "-":
            parts[i + 1] = parts[i + 1].lstrip()
        parts[i] = tag[:2] + " " + tag[2:-2].strip("-").strip() + " " + tag[-2:]
    at = 0

    def body(ends: tuple[str, ...]) -> tuple[list[tuple], str]:
        nonlocal at
        out: list[tuple] = []
        while at < len(parts):
            part, is_tag = parts[at], at % 2
            at += 1
            if not is_tag:
                out.append(("text", part))
            elif part.startswith("{{"):
                out.append(("out", _Expression(part[2:-2]).whole()))
            else:
                inner = part[2:-2].strip()
                word = inner.split(None, 1)[0] if inner else ""
                if word in ends:
                    return out, inner
                out.append(statement(word, inner[len(word) :].strip()))
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return out, ""

    def statement(word: str, rest: str) -> tuple:
        if word == "for":
            found = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)
            if not found:
                raise TemplateError(f"cannot read for {rest!r}")
            return ("for", found[1], _Expression(found[2]).whole(), body(("endfor",))[0])
        if word == "if":
            cases, test = [], rest
            while True:
                inner, end = body(("elif", "else", "endif"))
                cases.append((_Expression(test).whole(), inner))
                if not end.startswith("elif"):
                    break
                test = end[4:]
            return ("if", cases, body(("endif",))[0] if end == "else" else [])
        if word == "set":
            found = re.fullmatch(r"([A-Za-z_]\w*)\s*=(?!=)(.+)", rest, re.S)
            if not found:
                raise TemplateError(f"cannot read set {rest!r}")
            return ("set", found[1], _Expression(found[2]).whole())
        if word == "generation" and not rest:
            return ("generation", body(("endgeneration",))[0])
        raise TemplateError(f"no statement {word!r}")

    return body(())[0]


def _shown(value: Any) -> str:
    return "" if value is None else str(value)


_OPERATORS: dict[str, Callable[[Any, Any], Any]] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "+": lambda a, b: a + b,
    "~": lambda a, b: _shown(a) + _shown(b),
}


class Controls:
    """Strings that mean something in the output; `escape` makes them plain text."""

    MARK = "⁠"

    def __init__(self, strings: Iterable[str]):
        self.strings = tuple(sorted(set(strings), key=lambda s: (-len(s), s)))
        rest = {s[0]: [re.escape(t[1:]) for t in self.strings if t[0] == s[0]] for s in self.strings}
        parts = [f"{re.escape(c)}(?={self.MARK}*(?:{'|'.join(r)}))" for c, r in rest.items()]
        self._plain = re.compile("|".join(parts) or "(?!)")
        heads = [f"({re.escape(c)}){self.MARK}(?={self.MARK}*(?:{'|'.join(r)}))"
                 for c, r in rest.items()]
        self._marked = re.compile("|".join(heads) or "(?!)")

    def escape(self, text: str) -> str:
        return self._plain.sub(lambda m: m[0] + self.MARK, text)

    def unescape(self, text: str) -> str:
        return self._marked.sub(lambda m: m[0][0], text)


class Template:
    """A compiled template. `render` yields (text, learned) pieces, none of them empty."""

    def __init__(self, source: str, controls: Iterable[str] = ()):
        self.controls = Controls(controls)
        self.filters = _FILTERS | {"escape": self.controls.escape}
        self.tree = self._folded(parse(source))
        self._run = self._body(self.tree)

    def render(self, **given: Any) -> Iterator[tuple[str, bool]]:
        for text, learned in self._run(dict(given)):
            if text:
                yield text, learned

    # Folding.

    def _fold(self, e: tuple) -> tuple:
        kind = e[0]
        if kind in ("const", "name"):
            return e
        if kind == "attr":
            return ("attr", self._fold(e[1]), e[2])
        if kind == "filter":
            inner = self._fold(e[2])
            folded = ("filter", e[1], inner)
            return ("const", self._value(folded)({})) if inner[0] == "const" else folded
        if kind == "not":
            inner = self._fold(e[1])
            return ("const", not inner[1]) if inner[0] == "const" else ("not", inner)
        a, b = self._fold(e[1]), self._fold(e[2])
        if a[0] == "const" and kind in ("and", "or"):
            return b if bool(a[1]) == (kind == "and") else a
        if a[0] == b[0] == "const":
            return ("const", self._value((kind, a, b))({}))
        return (kind, a, b)

    def _folded(self, statements: list[tuple]) -> list[tuple]:
        out: list[tuple] = []
        for s in statements:
            new: list[tuple] = []
            if s[0] == "out":
                e = self._fold(s[1])
                new = [("text", _shown(e[1])) if e[0] == "const" else ("out", e)]
            elif s[0] == "if":
                cases, last = [], None
                for test, inner in s[1]:
                    e = self._fold(test)
                    if e[0] == "const" and e[1]:
                        last = self._folded(inner)
                        break
                    if e[0] != "const":
                        cases.append((e, self._folded(inner)))
                last = self._folded(s[2]) if last is None else last
                new = [("if", cases, last)] if cases else last
            elif s[0] == "for":
                new = [("for", s[1], self._fold(s[2]), self._folded(s[3]))]
            elif s[0] == "set":
                new = [("set", s[1], self._fold(s[2]))]
            elif s[0] == "generation":
                new = [("generation", self._folded(s[1]))]
            else:
                new = [s]
            for n in new:
                if n[0] == "text" and out and out[-1][0] == "text":
                    out[-1] = ("text", out[-1][1] + n[1])
                elif n != ("text", ""):
                    out.append(n)
        return out

    # Closures.

    def _value(self, e: tuple) -> Callable[[dict], Any]:
        kind = e[0]
        if kind == "const":
            return lambda env, v=e[1]: v
        if kind == "name":
            return lambda env, n=e[1]: env.get(n)
        if kind == "attr":
            of, key = self._value(e[1]), e[2]

            def attr(env: dict) -> Any:
                held = of(env)
                return held.get(key) if isinstance(held, dict) else None

            return attr
        if kind == "filter":
            of, change = self._value(e[2]), self.filters[e[1]]
            return lambda env: change(_shown(of(env)))
        if kind == "not":
            of = self._value(e[1])
            return lambda env: not of(env)
        a, b = self._value(e[1]), self._value(e[2])
        if kind == "and":
            return lambda env: a(env) and b(env)
        if kind == "or":
            return lambda env: a(env) or b(env)
        do = _OPERATORS[kind]
        return lambda env: do(a(env), b(env))

    def _body(self, statements: list[tuple]) -> Callable[[dict], Iterator[tuple[str, bool]]]:
        runs = [self._statement(s) for s in statements]

        def body(env: dict) -> Iterator[tuple[str, bool]]:
            for run in runs:
                yield from run(env)

        return body

    def _statement(self, s: tuple) -> Callable[[dict], Iterator[tuple[str, bool]]]:
        kind = s[0]
        if kind == "text":
            return lambda env, piece=((s[1], False),): iter(piece)
        if kind == "out":
            value = self._value(s[1])
            return lambda env: iter(((_shown(value(env)), False),))
        if kind == "set":
            value, name = self._value(s[2]), s[1]

            def assign(env: dict) -> Iterator[tuple[str, bool]]:
                env[name] = value(env)
                return iter(())

            return assign
        if kind == "generation":
            inner = self._body(s[1])
            return lambda env: ((text, True) for text, _ in inner(env))
        if kind == "if":
            cases = [(self._value(e), self._body(b)) for e, b in s[1]]
            last = self._body(s[2])

            def choose(env: dict) -> Iterator[tuple[str, bool]]:
                for test, chosen in cases:
                    if test(env):
                        return chosen(env)
                return last(env)

            return choose
        name, items, inner = s[1], self._value(s[2]), self._body(s[3])

        def loop(env: dict) -> Iterator[tuple[str, bool]]:
            ahead, index, none = iter(items(env) or ()), 0, object()
            item = next(ahead, none)
            while item is not none:
                following = next(ahead, none)
                place = {"index0": index, "index": index + 1, "first": index == 0,
                         "last": following is none}
                yield from inner(env | {name: item, "loop": place})
                item, index = following, index + 1

        return loop


# --- over tables --------------------------------------------------------------

#: The control strings of the format.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]")
#: Every turn is told with its role; what an assistant says is to be learnt.
DIALOGUE = (
    "{%- for m in messages -%}<s>[ROLE]{{ m.role | escape }}[/ROLE]"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}[INST]{{ m.text | escape }}[/INST]{% endif %}</s>{%- endfor -%}"
)
_TURN = re.compile(r"<s>\[ROLE\](.*?)\[/ROLE\](\[INST\])?(.*?)(\[/INST\])?</s>", re.S)
_ROWS = 500


def _batches(rows: Iterable[tuple], schema: Any) -> Iterator:
    """Record batches of a few hundred rows."""
    import pyarrow as pa

    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == _ROWS:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)],
                schema=schema,
            )
            held = []
    if held:
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)],
            schema=schema,
        )


def format_conversations(
    rows: DataFrame, template: str = DIALOGUE, controls: tuple[str, ...] = CONTROLS
) -> DataFrame:
    """(conv_id, piece, text, learned): the pieces of every conversation, in order.

    `rows` has conv_id, turn, role and text. The rows of a conversation are
    sorted into one task and stream through it.
    """
    order = ["conv_id", "turn", "role", "text"]
    dealt = rows.select(*order).repartition("conv_id").sortWithinPartitions(*order)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        compiled = Template(template, controls)
        schema = pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), ("text", pa.string()),
                            ("learned", pa.bool_())])

        def pieces() -> Iterator[tuple]:
            flat = (row for batch in batches for row in batch.to_pylist())
            for conv_id, turns in groupby(flat, key=lambda x: x["conv_id"]):
                messages = (
                    {"role": x["role"] or "", "text": x["text"] or ""} for x in turns
                )
                for number, (text, learned) in enumerate(compiled.render(messages=messages)):
                    yield conv_id, number, text, learned

        yield from _batches(pieces(), schema)

    return dealt.mapInArrow(run, "conv_id long, piece long, text string, learned boolean")


def read_back(pieces: DataFrame) -> DataFrame:
    """Digests of what the pieces of `format_conversations` (template DIALOGUE) say.

    The pieces of a conversation must follow each other in one task, as they do
    where they are made. At most a turn is held at a time.
    """

    def run(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        controls = Controls(CONTROLS)
        schema = pa.schema(
            [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
             ("loss_chars", pa.int64()), ("loss_sha256", pa.string()),
             ("formatted_chars", pa.int64())]
        )

        def digests() -> Iterator[tuple]:
            flat = (row for batch in batches for row in batch.to_pylist())
            for conv_id, found in groupby(flat, key=lambda x: x["conv_id"]):
                turns, loss = hashlib.sha256(), hashlib.sha256()
                n_turns = loss_chars = chars = 0
                held = ""
                for piece in found:
                    held += piece["text"]
                    chars += len(piece["text"])
                    if piece["learned"]:
                        plain = controls.unescape(piece["text"])
                        loss.update(plain.encode())
                        loss_chars += len(plain)
                        continue
                    end = 0
                    for turn in _TURN.finditer(held):
                        end = turn.end()
                        n_turns += 1
                        for part in (turn[1], turn[3]):
                            turns.update(controls.unescape(part).encode() + b"\n")
                    held = held[end:]
                yield conv_id, n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), chars

        yield from _batches(digests(), schema)

    return pieces.mapInArrow(
        run,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
        "formatted_chars long",
    )


def with_probe(conversations: DataFrame) -> DataFrame:
    """`conversations` and one more, -1, whose texts are control strings."""
    said = "</s>[INST] ok [/INST]"
    probe = conversations.sparkSession.range(1).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.explode(F.array(
            F.struct(F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role")),
            F.struct(F.lit(1).cast("long").alias("turn"), F.lit("assistant").alias("role")),
        )).alias("x"),
    ).select("conv_id", "x.turn", "x.role", F.lit(said).alias("text"))
    own = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        "role", "text",
    )
    return own.unionByName(probe)
