"""Token ids by white-space words, for tokenizers whose tokens never span white space.

The vocabulary file's normaliser turns white space into one space and its pre-tokeniser drops it,
so the ids of a text are the ids of its words in a row. Words repeat; their ids are cached.
Two rewritings that leave the ids as they are make more words equal: ASCII capitals are lowered
(unless combining marks follow somewhere, as these compose before lowering), and the marks after a
word's last letter or digit are set apart, as the pre-tokeniser does. Texts that may hold the
vocabulary's control strings are left as they are. All this rests on the normaliser and the
pre-tokeniser that ``KNOWN`` states; with a vocabulary file that has others, texts are encoded whole.
"""

from __future__ import annotations

import json
import os
import re
import struct

from wayfold.llm.texts import LOWER, utf8, word_blocks

CACHED_WORDS, CACHED_LENGTH = 600_000, 64
MARKS = rb"[!-&(-/:-@\[-`{-~]+(?=[\x20\x09-\x0D]|\Z)"
APART = re.compile(rb"(?<=[a-z0-9])" + MARKS + rb"|(?<=\xc3[\x9f-\xb6\xb8-\xbf])" + MARKS)
#: Words of these letters alone are one pre-token each and the normaliser leaves them as they are.
PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")


#: The normaliser and the pre-tokeniser that the rewritings fit (fixed values of the public file).
KNOWN = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


def _byte_level() -> dict[int, str]:
    """The characters that stand for bytes in byte-level vocabularies: printable Latin-1 ones for themselves, the others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


BYTE_LEVEL = _byte_level()


def prepared(text: str | None) -> bytes:
    """UTF-8 of a text with the same ids, its words as equal as can be."""
    data = utf8(text)
    if b"<|" in data:
        return data
    if b"\xcc" not in data and b"\xcd" not in data:
        data = data.translate(LOWER)
    return APART.sub(rb" \g<0>", data)


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


class WordTokens:
    """Ids as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        self.cache: dict[bytes, bytes] = {}
        with open(path, encoding="utf-8") as f:
            stated = json.load(f)
        #: Whether texts may be encoded word by word.
        self.by_words = all(stated.get(k) == v for k, v in KNOWN.items()) and not stated.get("truncation") and stated["model"].get("end_of_word_suffix") == "</w>"

    def of_words(self, words: list[bytes]) -> list[bytes]:
        cache = self.cache
        try:
            return [cache[w] for w in words]
        except KeyError:
            pass
        new = list({w for w in words if w not in cache})
        if len(cache) + len(new) > CACHED_WORDS:
            cache.clear()
            new = list(set(words))
        fresh, odd, tokenize = {}, [], self.tokenizer.model.tokenize
        for w in new:
            if len(w) <= CACHED_LENGTH and PLAIN.fullmatch(w):
                ids = [t.id for t in tokenize(w.decode("latin-1").translate(BYTE_LEVEL))]
                fresh[w] = struct.pack(f"<{len(ids)}I", *ids)
            else:
                odd.append(w)
        for w, e in zip(odd, self.encode([w.decode("utf-8", "surrogatepass") for w in odd], add_special_tokens=False), strict=True):
            fresh[w] = struct.pack(f"<{len(e.ids)}I", *e.ids)
        out = [fresh[w] if w in fresh else cache[w] for w in words]
        cache.update((w, x) for w, x in fresh.items() if len(w) <= CACHED_LENGTH)
        return out

    def _whole(self, text: str | None) -> list[int]:
        return self.tokenizer.encode(utf8(text).decode("utf-8", "replace"), add_special_tokens=False).ids

    def ids(self, text: str | None) -> bytes:
        if not self.by_words:
            ids = self._whole(text)
            return struct.pack(f"<{len(ids)}I", *ids)
        return b"".join(b"".join(self.of_words(words)) for words in word_blocks(prepared(text)))

    def count(self, text: str | None) -> int:
        if not self.by_words:
            return len(self._whole(text))
        return sum(sum(map(len, self.of_words(words))) for words in word_blocks(prepared(text))) // 4
