"""Statistics of texts past the size at which words come in blocks."""

from wayfold.llm import quality, texts


def test_pairs_of_long_texts(monkeypatch):
    cycle = " ".join(f"word{k}" for k in range(60000)) + " "
    text = cycle * 5 + "end end"
    assert len(text) > texts.LONG_TEXT
    got = quality.statistics(text, None)
    monkeypatch.setattr(quality, "word_blocks", lambda data: [data.split()])
    monkeypatch.setattr(quality, "LONG_TEXT", len(text), raising=False)
    want = quality.statistics(text, None)
    assert got == want and want[0][15] == quality._share(60002, 300001)
