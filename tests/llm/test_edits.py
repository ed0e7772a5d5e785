"""Token counts after edits, against encoding the whole text again."""

import random

import pytest
from tokenizers import Tokenizer

import public_tokenizers
from wayfold.llm import edits
from wayfold.llm.wordtokens import WordTokens

PATH = public_tokenizers.path("word_bpe_49k.json")
ALPHABETS = {
    "plain": "abcdefg    .,'\n123STREstv",
    "chinese": "这是一个测试文本没有空格，。！「」abc12",
    "thai": "กขคงจฉชซาิีึืุู่้ๆ123",
    "marks": "aéó̈u̧İ'.ΩßK",
    "control": "<|endoftext|>start'",
    "odd": "a 　‍힤가각각😀😃'x9",
}


@pytest.fixture(scope="module")
def tokens():
    return WordTokens(PATH)


@pytest.mark.parametrize("name", sorted(ALPHABETS))
def test_counts_after_edits(tokens, name, monkeypatch):
    monkeypatch.setattr(edits, "LEAF", 12)
    whole, rng = Tokenizer.from_file(PATH), random.Random(name)
    pieces = [*ALPHABETS[name], "<|endoftext|>", "'s", "don't "] if name == "control" else [*ALPHABETS[name], "'s"]
    some = lambda n: "".join(rng.choices(pieces, k=rng.randrange(n)))
    for _ in range(60):
        text = some(300)
        tree = edits.TokenTree(text, tokens)
        for _ in range(8):
            start, length, new = rng.randrange(len(text) + 2), rng.choice([0, 1, 3, 40]), some(rng.choice([1, 2, 6, 60]))
            tree.replace(start, length, new)
            at = min(start, len(text))
            text = text[:at] + new + text[at + length :]
            assert tree.text == text and tree.length == len(text)
            assert tree.count == len(whole.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("unit", ["这是一个没有空格的测试文本，", "https://example.com/a-b/c_d?e=1&", "x" * 40 + "."])
def test_edits_read_little_without_white_space(tokens, unit):
    tree = edits.TokenTree(unit * (200_000 // len(unit)), tokens)
    tree.encoded = 0
    tree.replace(100_000, 1, "y")
    assert tree.encoded < 4 * edits.LEAF


def test_other_vocabularies_are_encoded_whole():
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokens, whole = WordTokens(path), Tokenizer.from_file(path)
    text = "Two  words,\n and  spaces   that count. " * 60
    assert not tokens.by_words and tokens.count(text) == len(whole.encode(text, add_special_tokens=False).ids)
    tree = edits.TokenTree(text, tokens)
    tree.replace(700, 5, "  x ")
    assert tree.count == len(whole.encode(tree.text, add_special_tokens=False).ids)


def test_odd_rows(spark):
    rows = [(1, None), (None, ""), (2, "one two"), (2, "one two"), (3, "x " * 700_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "text AS n_tokens")
    got = sorted(((r.doc_id or 0, r.n_tokens, r.n_tokens_after, r.n_chars_after, r.n_edits) for r in edits.recount(docs, edits.sample_edits()).collect()))
    whole = Tokenizer.from_file(PATH)

    def want(i, text):
        text = text or ""
        a, b, n = len(text) // 2, len(text) // 3, len(text)
        new = text[:a] + text[a + 10 :]
        new = new[:b] + " edited by hand," + new[b:]
        new = new[: n + 1] + "the end" + new[n + 6 :]
        return i or 0, len(whole.encode(text, add_special_tokens=False).ids), len(whole.encode(new, add_special_tokens=False).ids), len(new), 3

    assert got == sorted(want(i, t) for i, t in rows)
    assert edits.recount(docs.limit(0), edits.sample_edits()).count() == 0
