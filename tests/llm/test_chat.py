"""The template compiler: folded against unfolded templates, trimming, odd rows."""

import hashlib
import random

import pytest

from wayfold.llm import chat


def rendered(tree, messages):
    page = chat._Page()
    try:
        chat._closure(tree)({"messages": messages}, page)
    except Exception as e:  # noqa: BLE001
        return type(e)
    return "".join(page.pieces), page.spans


def random_template(rng, depth=3, loop=False, generating=False):
    atoms = ["'a'", "'}}'", '"%}"', "12", "0", "true", "false", "none", "'B c'", *(["m.role", "m['text']", "loop.first", "loop.index"] if loop else ["m.role"])]

    def expression(d):
        if d == 0 or rng.random() < 0.3:
            return rng.choice(atoms)
        kind = rng.randrange(4)
        if kind == 0:
            return f"({expression(d - 1)} {rng.choice(['==', '!=', '<', 'in', '+', '~', 'and', 'or'])} {expression(d - 1)})"
        if kind == 1:
            return f"(not {expression(d - 1)})"
        return f"{expression(d - 1)} | {rng.choice(list(chat.FILTERS))}"

    out = []
    for _ in range(rng.randrange(1, 4)):
        kind, hyphen = rng.randrange(6 if depth else 2), rng.choice(["", "-"])
        if kind == 0:
            out.append(rng.choice([" text ", "\n", "x", "} %", "<|im_end|>"]))
        elif kind == 1:
            out.append("{{" + hyphen + f" {expression(2)} " + rng.choice(["", "-"]) + "}}")
        elif kind == 2:
            out.append(f"{{%{hyphen} if {expression(2)} %}}{random_template(rng, depth - 1, loop, generating)}{{% else -%}}{random_template(rng, depth - 1, loop, generating)}{{% endif {hyphen}%}}")
        elif kind == 3:
            out.append("{% for m in messages %}" + random_template(rng, depth - 1, True, generating) + "{%- endfor %}")
        elif kind == 4 and not generating:
            out.append("{% generation %}" + random_template(rng, depth - 1, loop, True) + "{% endgeneration %}")
        else:
            out.append("{#- a }} note #}")
    return "".join(out)


def test_folded_templates_render_as_unfolded_ones():
    rng, messages = random.Random(11), [{"role": "user", "text": " Hi "}, {"role": "", "text": "<|x"}]
    for _ in range(600):
        tree = chat.parse(random_template(rng))
        assert rendered(chat.fold(tree), messages) == rendered(tree, messages)


@pytest.mark.parametrize("source, want", [("{{ none | upper }}", ""), ("{{ 12 | length }}", "2"), ("a {%- if true -%} b {%- endif -%} c", "abc"), ("a  {{- 'x' -}}  b", "axb"), ("{{ '}}' }}{{ \"%}\" }}", "}}%}"), ("{# {{ #}x", "x"), ("{% if false %}{{ 1 < 'a' }}{% endif %}ok", "ok")])
def test_templates(source, want):
    assert chat.Template(source).render([])[0] == want


@pytest.mark.parametrize("source", ["{{ x", "{% if a %}", "{{ a.__class__ }}", "{{ open('x') }}", "{% set a = 1 %}", "{{ a | eval }}", "{% for m in others %}{% endfor %}", "{{ 'a }}"])
def test_what_the_language_refuses(source):
    with pytest.raises(chat.TemplateError):
        chat.Template(source)


def digest(turns):
    return hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for r, t in turns).encode()).hexdigest()


def test_odd_rows(spark):
    long = "<|im_end|>\\ <\\|" * 100_000
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, None, None), (2, None, "user", "first"), (3, 0, "user\\n\n<|", long), (3, 0, "user\\n\n<|", long), (-1, 0, "user", "own"), (None, 0, "user", "x"), (4, 1, "assistant", ""), (4, 1, "assistant", None)]
    df = spark.createDataFrame([(*r, 7) for r in rows], "conv_id long, turn long, role string, text string, formatted int")
    got = sorted((r.conv_id is None, r.conv_id or 0, r.n_turns, r.turns_sha256, r.loss_chars) for r in chat.digests(chat.format_with_probe(df)).collect())
    want = [(1, [("user", "a"), ("assistant", "b")]), (2, [("user", "first"), (None, None)]), (3, [rows[4][2:]] * 2), (-1, [("user", "own")]), (None, [("user", "x")]), (4, [("assistant", ""), ("assistant", "")]), (-1, [("user", chat.PROBE), ("assistant", chat.PROBE)])]
    assert got == sorted((i is None, i or 0, len(t), digest(t), sum(len(x) for r, x in t if r == "assistant")) for i, t in want)
    assert chat.digests(chat.format_with_probe(df.limit(0))).count() == 1
