"""Chat formatting by a template compiler.

A template is parsed into a syntax tree, constants are folded, and the tree is turned into Python
closures that render a conversation as text with the spans of its generation blocks.

The language is sandboxed: no attributes but message fields, no calls but the filters listed here,
no imports, no assignment, loops only over the messages.

    text {{ expression }} {% for m in messages %} ... {% endfor %} {# a note #}
    {% if e %} ... {% elif e %} ... {% else %} ... {% endif %} {% generation %} ... {% endgeneration %}
    expressions: 'text', 12, true, false, m.field, m['field'], loop.first, loop.last, loop.index,
    and or not, == != < <= > >= in, + ~, x | filter, (e)
    a hyphen inside a tag's end ({%- ... -%}, {{- ... -}}) trims the white space of the text beside it

The standard template marks turns with control strings. Texts pass the ``escape`` filter, which puts
one more backslash between "<" and "|" wherever only backslashes stand there already or nothing:
no escaped text holds "<|", and ``unescape`` takes exactly that backslash away again. Roles also
have their backslashes and line feeds escaped, so that a turn's header is one line.

Turns go by number, ties by role and text; null turns first. Null role or text: empty. Rows of a
null conv_id form one conversation. Repeated rows are turns of their own. Empty table: no rows.
Other columns are not read. One conversation is one row of the result and is rendered in one
worker; conversations are dealt by their id.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.arrowtools import texts_per_batch

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
STANDARD = "{% for m in messages %}<|im_start|>{{ m.role | header }}\n{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}<|im_end|>\n{% endfor %}"
PROBE = CLOSE + OPEN + "assistant ok"


class TemplateError(ValueError):
    """A template that the language doesn't allow."""


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text) if "|" in text else text


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text) if "|" in text else text


def header(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unheader(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.S)


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "header": header, "trim": lambda x: str(x).strip(), "upper": lambda x: str(x).upper(), "lower": lambda x: str(x).lower(), "length": len}

# --- syntax tree: tuples (kind, ...) ---------------------------------------------------------------

_STRING = r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*\""""
TAGS = re.compile(
    r"\{\{(?P<put_l>-?)(?P<put>(?:[^'\"}]|" + _STRING + r"|\}(?!\}))*?)(?P<put_r>-?)\}\}"
    r"|\{%(?P<tag_l>-?)\s*(?P<tag>(?:[^'\"%]|" + _STRING + r"|%(?!\}))*?)\s*(?P<tag_r>-?)%\}"
    r"|\{#(?P<note_l>-?).*?(?P<note_r>-?)#\}",
    re.S,
)
LEXEME = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|([A-Za-z_]\w*)|(==|!=|<=|>=|[<>+~|().\[\]]))")


class _Expression:
    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.rstrip()
        while at < len(source):
            m = LEXEME.match(source, at)
            if m is None:
                raise TemplateError(f"unexpected {source[at:at + 10]!r}")
            self.tokens.append(m)
            at = m.end()
        self.at = 0

    def peek(self) -> str:
        return self.tokens[self.at][0].strip() if self.at < len(self.tokens) else ""

    def next(self) -> re.Match:
        if self.at >= len(self.tokens):
            raise TemplateError("expression ends early")
        self.at += 1
        return self.tokens[self.at - 1]

    def whole(self):
        tree = self.either()
        if self.peek():
            raise TemplateError(f"unexpected {self.peek()!r}")
        return tree

    def _left(self, words: tuple, below: Callable):
        tree = below()
        while self.peek() in words:
            tree = (self.next()[0].strip(), tree, below())
        return tree

    def either(self):
        return self._left(("or",), self.both)

    def both(self):
        return self._left(("and",), self.negated)

    def negated(self):
        if self.peek() == "not":
            self.next()
            return ("not", self.negated())
        return self._left(("==", "!=", "<", "<=", ">", ">=", "in"), self.joined)

    def joined(self):
        return self._left(("+", "~"), self.filtered)

    def filtered(self):
        tree = self.atom()
        while self.peek() == "|":
            self.next()
            name = self.next()[3]
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            tree = ("filter", name, tree)
        return tree

    def atom(self):
        m = self.next()
        if m[1]:
            return ("constant", re.sub(r"\\(.)", lambda x: {"n": "\n", "t": "\t"}.get(x[1], x[1]), m[1][1:-1], flags=re.S))
        if m[2]:
            return ("constant", int(m[2]))
        if m[4] == "(":
            tree = self.either()
            if self.next()[4] != ")":
                raise TemplateError("missing )")
            return tree
        if not m[3]:
            raise TemplateError(f"unexpected {m[0]!r}")
        if m[3] in ("true", "false", "none"):
            return ("constant", {"true": True, "false": False, "none": None}[m[3]])
        tree = ("name", m[3])
        while self.peek() in (".", "["):
            if self.next()[4] == ".":
                field = self.next()[3]
            else:
                field = self.next()[1]
                field = field[1:-1] if field else None
                if self.next()[4] != "]":
                    raise TemplateError("missing ]")
            if not field or field.startswith("_"):
                raise TemplateError("only plain fields can be read")
            tree = ("field", tree, field)
        return tree


def parse(template: str) -> tuple:
    """The syntax tree of a template: ("block", [parts])."""
    parts: list[tuple] = []
    frames: list[tuple[str, list, list]] = []  # (kind, parts of the enclosing block, branches)
    at = 0

    trimmed = False

    def text(piece: str, trim: bool) -> None:
        piece = piece.lstrip() if trimmed else piece
        piece = piece.rstrip() if trim else piece
        if "{{" in piece or "{%" in piece:
            raise TemplateError("a tag is not closed")
        if piece:
            parts.append(("text", piece))

    for m in TAGS.finditer(template):
        text(template[at : m.start()], bool(m["put_l"] or m["tag_l"] or m["note_l"]))
        at, trimmed = m.end(), bool(m["put_r"] or m["tag_r"] or m["note_r"])
        if m["put"] is not None:
            parts.append(("put", _Expression(m["put"]).whole()))
            continue
        if m["tag"] is None:
            continue
        word, _, rest = m["tag"].partition(" ")
        if word == "for":
            loop = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+messages\s*", rest)
            if not loop:
                raise TemplateError("a loop runs over messages")
            frames.append(("for", parts, [loop[1]]))
            parts = []
        elif word == "if":
            frames.append(("if", parts, [(_Expression(rest).whole(), [])]))
            parts = frames[-1][2][-1][1]
        elif word in ("elif", "else"):
            if not frames or frames[-1][0] != "if":
                raise TemplateError(f"{word} without if")
            frames[-1][2].append((_Expression(rest).whole() if word == "elif" else ("constant", True), []))
            parts = frames[-1][2][-1][1]
        elif word == "generation":
            if any(f[0] == "generation" for f in frames):
                raise TemplateError("generation blocks don't nest")
            frames.append(("generation", parts, []))
            parts = []
        elif word in ("endfor", "endif", "endgeneration"):
            if not frames or frames[-1][0] != word[3:]:
                raise TemplateError(f"{word} without {word[3:]}")
            kind, outer, held = frames.pop()
            done = ("for", held[0], ("block", parts)) if kind == "for" else ("if", [(c, ("block", p)) for c, p in held]) if kind == "if" else ("generation", ("block", parts))
            outer.append(done)
            parts = outer
        else:
            raise TemplateError(f"no tag {word!r}")
    text(template[at:], False)
    if frames:
        raise TemplateError(f"{frames[-1][0]} is not closed")
    return ("block", parts)


BINARY: dict[str, Callable] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b, "+": lambda a, b: a + b, "~": lambda a, b: _shown(a) + _shown(b), "and": lambda a, b: a and b, "or": lambda a, b: a or b,
}


def _shown(x) -> str:
    return "" if x is None else x if isinstance(x, str) else str(x)


def _folded(tree: tuple, *inner: tuple) -> tuple:
    """An expression's constant by the very closure that would render it, if all inside it is constant."""
    if any(x[0] != "constant" for x in inner):
        return tree
    try:
        return ("constant", _value(tree)({}))
    except Exception:  # noqa: BLE001 - an error belongs to rendering
        return tree


def fold(tree: tuple) -> tuple:
    """Constants folded: expressions of constants, branches never or always taken, neighbouring texts.

    What fails to fold stays as it is and fails where it is rendered, if it is.
    """
    kind = tree[0]
    if kind == "filter":
        inner = fold(tree[2])
        return _folded(("filter", tree[1], inner), inner)
    if kind == "not":
        inner = fold(tree[1])
        return _folded(("not", inner), inner)
    if kind in BINARY:
        a, b = fold(tree[1]), fold(tree[2])
        return _folded((kind, a, b), a, b)
    if kind == "put":
        inner = fold(tree[1])
        return ("text", _shown(inner[1])) if inner[0] == "constant" else ("put", inner)
    if kind == "block":
        out: list[tuple] = []
        for part in map(fold, tree[1]):
            for p in part[1] if part[0] == "block" else [part]:
                if p[0] == "text" and out and out[-1][0] == "text":
                    out[-1] = ("text", out[-1][1] + p[1])
                elif p != ("text", ""):
                    out.append(p)
        return ("block", out)
    if kind == "if":
        branches = []
        for condition, body in tree[1]:
            condition = fold(condition)
            if condition[0] == "constant" and not condition[1]:
                continue
            branches.append((condition, fold(body)))
            if condition[0] == "constant":
                break
        if not branches:
            return ("block", [])
        return branches[0][1] if branches[0][0][0] == "constant" else ("if", branches)
    if kind == "for":
        return ("for", tree[1], fold(tree[2]))
    if kind == "generation":
        return ("generation", fold(tree[1]))
    return tree


def _value(tree: tuple) -> Callable[[dict], object]:
    kind = tree[0]
    if kind == "constant":
        x = tree[1]
        return lambda scope: x
    if kind == "name":
        name = tree[1]
        return lambda scope: scope.get(name)
    if kind == "field":
        inner, field = _value(tree[1]), tree[2]

        def get(scope):
            x = inner(scope)
            return x.get(field) if isinstance(x, dict) else None

        return get
    if kind == "filter":
        f, inner = FILTERS[tree[1]], _value(tree[2])
        return lambda scope: f(_shown(inner(scope)))
    if kind == "not":
        inner = _value(tree[1])
        return lambda scope: not inner(scope)
    a, b = _value(tree[1]), _value(tree[2])
    if kind == "and":
        return lambda scope: a(scope) and b(scope)
    if kind == "or":
        return lambda scope: a(scope) or b(scope)
    f = BINARY[kind]
    return lambda scope: f(a(scope), b(scope))


class _Page:
    """What is rendered: pieces of text and the spans of generation blocks."""

    def __init__(self):
        self.pieces: list[str] = []
        self.size = 0
        self.spans: list[tuple[int, int]] = []

    def put(self, piece: str) -> None:
        self.pieces.append(piece)
        self.size += len(piece)


def _closure(tree: tuple) -> Callable[[dict, _Page], None]:
    kind = tree[0]
    if kind == "text":
        piece = tree[1]
        return lambda scope, page: page.put(piece)
    if kind == "put":
        value = _value(tree[1])
        return lambda scope, page: page.put(_shown(value(scope)))
    if kind == "block":
        steps = [_closure(p) for p in tree[1]]

        def run(scope, page):
            for step in steps:
                step(scope, page)

        return run
    if kind == "if":
        branches = [(_value(c), _closure(b)) for c, b in tree[1]]

        def choose(scope, page):
            for condition, body in branches:
                if condition(scope):
                    return body(scope, page)

        return choose
    if kind == "generation":
        inner = _closure(tree[1])

        def generate(scope, page):
            start = page.size
            inner(scope, page)
            page.spans.append((start, page.size))

        return generate
    name, body = tree[1], _closure(tree[2])

    def loop(scope, page):
        messages = scope["messages"]
        last = len(messages) - 1
        for i, m in enumerate(messages):
            body({**scope, name: m, "loop": {"first": i == 0, "last": i == last, "index": i + 1}}, page)

    return loop


@dataclass
class Template:
    """A compiled template; ``render`` gives the text and the spans of its generation blocks."""

    source: str

    def __post_init__(self):
        self.tree = fold(parse(self.source))
        self.run = _closure(self.tree)

    def render(self, messages: list[dict]) -> tuple[str, list[tuple[int, int]]]:
        page = _Page()
        self.run({"messages": messages}, page)
        return "".join(page.pieces), page.spans

    def __reduce__(self):
        return Template, (self.source,)


TURN = re.compile(re.escape(OPEN) + r"(.*?)\n(.*?)" + re.escape(CLOSE) + "\n", re.S)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns (role, text) of a conversation in the standard template's form."""
    out, at = [], 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if m is None:
            raise ValueError("not a formatted conversation")
        out.append((unheader(m[1]), unescape(m[2])))
        at = m.end()
    return out


def _conversations(batches: Iterator[pa.RecordBatch], template: Template) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation and turn, to one row for each conversation."""
    done: list[tuple] = []
    key, messages = None, []

    def finish():
        if messages:
            text, spans = template.render(messages)
            done.append((key, text, [s for s, _ in spans], [e for _, e in spans]))

    def take():
        nonlocal done
        columns = list(zip(*done, strict=True))
        done = []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())), strict=True)], ["conv_id", "formatted", "starts", "ends"])

    for batch in batches:
        for conv, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if conv != key:
                finish()
                key, messages = conv, []
            messages.append({"role": role or "", "text": text or ""})
        if len(done) >= 500:
            yield take()
    finish()
    if done:
        yield take()


def format_conversations(rows: DataFrame, source: str = STANDARD) -> DataFrame:
    """(conv_id, formatted, starts, ends): the rendered text and where its generation blocks are, in code points."""
    texts_per_batch(rows.sparkSession)
    template = Template(source)
    turns = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"), F.col("turn").cast("long").alias("turn"))
    dealt = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return dealt.mapInArrow(lambda batches: _conversations(batches, template), "conv_id long, formatted string, starts array<long>, ends array<long>")


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted text says when it is read back."""

    def run(batches):
        for batch in batches:
            out = []
            for conv, text, starts, ends in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                turns = read_back(text)
                loss = "".join(unescape(text[s:e]) for s, e in zip(starts, ends, strict=True))
                all_turns = hashlib.sha256("".join(f"{role}\n{said}\n" for role, said in turns).encode("utf-8", "surrogatepass")).hexdigest()
                out.append((conv, len(turns), all_turns, len(loss), hashlib.sha256(loss.encode("utf-8", "surrogatepass")).hexdigest(), len(text)))
            if out:
                types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def probe(rows: DataFrame) -> DataFrame:
    """Conversation -1, whose texts are control strings."""
    return rows.sparkSession.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")


def format_with_probe(rows: DataFrame) -> DataFrame:
    """The formatted conversations, and the probe as one more, apart from any conversation -1 among ``rows``."""
    return format_conversations(rows).unionByName(format_conversations(probe(rows)))
