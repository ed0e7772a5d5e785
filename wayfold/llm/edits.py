"""Edit-aware token counts over pre-token segment trees.

A text is cut into leaves of about ``LEAF`` characters that end at pre-token boundaries, so that no
token spans two leaves, and a segment tree holds the sums of their lengths and token counts. An edit
replaces a range of characters. Only the leaves it touches are re-encoded, with as many neighbours
as it takes for the region to start and end at such boundaries again, and the sums on the paths
above are updated; the rest of the text is never read again. A pre-token longer than a leaf, such as
a run of letters without any mark or space, is one leaf and is re-encoded whole.

Boundaries are those of the vocabulary's pre-tokeniser that hold whatever stands further off: beside
white space, around digits, between letters and other marks, but not after an apostrophe, before a
mark that combines, near a control string, or beside characters whose class may differ by Unicode
version. With a vocabulary of another pre-tokeniser (``WordTokens.by_words``) a text is one leaf.

Edits apply one after the other, each in the positions of the text as it then is; ranges are held to
the text. Null text: empty. Null edits: none. Null doc_id and repeated rows each return their row.
Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm.arrowtools import map_rows
from wayfold.llm.wordtokens import WordTokens, vocabulary

LEAF = 512
SPACES = " \t\n\v\f\r"
#: Characters of which classes are told: scripts that have long been settled.
SETTLED = ((0x0, 0x85F), (0xE00, 0xE7F), (0x3001, 0x9FFF), (0xAC00, 0xD7A3), (0xFF00, 0xFFEF))
#: A control string starts with "<" and is no longer than this.
CONTROL = 16


@lru_cache(1 << 14)
def _kinds(c: str) -> tuple[str, str]:
    """The class of a lower-cased character's first and last code point: white space, letter, number, mark, or "" if not told."""

    def kind(x: str) -> str:
        if x in SPACES:
            return "W"
        if not any(a <= ord(x) <= b for a, b in SETTLED):
            return ""
        major = unicodedata.category(x)[0]
        if major == "M" and not 0xE00 <= ord(x) <= 0xE7F:  # may become one with the letter before
            return ""
        return {"L": "L", "N": "N", "M": "S", "P": "S", "S": "S"}.get(major, "")

    low = c.lower()
    return kind(low[0]), kind(low[-1])


def is_boundary(before: str, after: str) -> bool:
    """May the text be cut between ``before`` (its last ``CONTROL`` characters will do) and ``after`` (its first)."""
    if not before or not after:
        return True
    a, b = before[-1], after[0]
    if a in SPACES or b in SPACES:
        return True
    if unicodedata.category(b)[0] == "M" or 0x1100 <= ord(b) <= 0x11FF or "<" in before[-CONTROL:]:
        return False
    x, y = _kinds(a)[1], _kinds(b)[0]
    return bool(x and y) and (x == "N" or y == "N" or x != y) and a != "'"


def leaves(text: str) -> list[str]:
    out, at = [], 0
    while len(text) - at > LEAF:
        end = at + LEAF
        while end < len(text) and not is_boundary(text[max(0, end - CONTROL) : end], text[end]):
            end += 1
        out.append(text[at:end])
        at = end
    if at < len(text) or not out:
        out.append(text[at:])
    return out


class TokenTree:
    """Token counts of a text under edits. ``encoded`` counts the characters encoded so far."""

    def __init__(self, text: str | None, tokens: WordTokens):
        self.tokens, self.encoded = tokens, 0
        self._build(text or "")

    def _build(self, text: str) -> None:
        self.leaves = self._cut(text)
        self.size = 1 << max(0, (len(self.leaves) - 1).bit_length())
        self.chars = [0] * (2 * self.size)
        self.counts = [0] * (2 * self.size)
        for i, leaf in enumerate(self.leaves):
            self.chars[self.size + i] = len(leaf)
            self.counts[self.size + i] = self._count(leaf)
        for i in range(self.size - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.counts[i] = self.counts[2 * i] + self.counts[2 * i + 1]

    def _cut(self, text: str) -> list[str]:
        return leaves(text) if self.tokens.by_words else [text]

    def _count(self, text: str) -> int:
        self.encoded += len(text)
        return self.tokens.count(text)

    @property
    def length(self) -> int:
        return self.chars[1]

    @property
    def count(self) -> int:
        return self.counts[1]

    @property
    def text(self) -> str:
        return "".join(self.leaves)

    def _find(self, position: int) -> tuple[int, int]:
        """The leaf that holds a position, and the position of the leaf's first character."""
        node, start = 1, 0
        while node < self.size:
            node *= 2
            if position - start >= self.chars[node] and self.chars[node + 1]:
                start += self.chars[node]
                node += 1
        return node - self.size, start

    def _set(self, leaf: int, text: str) -> None:
        chars, count = len(text), self._count(text) if text else 0
        self.leaves[leaf] = text
        node = self.size + leaf
        up, more = chars - self.chars[node], count - self.counts[node]
        while node:
            self.chars[node] += up
            self.counts[node] += more
            node //= 2

    def _tail(self, first: int, region: str) -> str:
        """The last characters of what stands before leaf ``first``, followed by ``region``."""
        while first and len(region) < CONTROL:
            first -= 1
            region = self.leaves[first][-CONTROL:] + region
        return region[-CONTROL:]

    def _head(self, last: int) -> str:
        """The first character after leaf ``last``."""
        return next((x[0] for x in self.leaves[last + 1 :] if x), "")

    def replace(self, start: int, length: int, replacement: str = "") -> None:
        start = min(max(0, start), self.length)
        stop = min(start + max(0, length), self.length)
        first, at = self._find(start)
        last, _ = self._find(max(start, stop - 1))
        region = "".join(self.leaves[first : last + 1])
        region = region[: start - at] + replacement + region[stop - at :]
        # Boundary context: the region must start and end where a text may be cut.
        while first and not is_boundary(self._tail(first, ""), region or self._head(last)):
            first -= 1
            region = self.leaves[first] + region
        while last + 1 < len(self.leaves) and not is_boundary(self._tail(first, region), self._head(last)):
            last += 1
            region += self.leaves[last]
        if not region or len(region) <= 4 * LEAF * (last - first + 1):
            self._set(first, region)
            for i in range(first + 1, last + 1):
                self._set(i, "")
        else:  # the region has outgrown its leaves: cut it anew and rebuild the sums above
            parts = self._cut(region)
            counts = [self._count(p) for p in parts]
            old = self.counts[self.size : self.size + len(self.leaves)]
            self.leaves[first : last + 1] = parts
            old[first : last + 1] = counts
            self.size = 1 << max(0, (len(self.leaves) - 1).bit_length())
            self.chars = [0] * self.size + [len(x) for x in self.leaves] + [0] * (self.size - len(self.leaves))
            self.counts = [0] * self.size + old + [0] * (self.size - len(self.leaves))
            for i in range(self.size - 1, 0, -1):
                self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
                self.counts[i] = self.counts[2 * i] + self.counts[2 * i + 1]


def recount(docs: DataFrame, edits: Column, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, n_tokens_after, n_chars_after, n_edits, reencoded_chars) of every document.

    ``edits`` is array<struct<start, length, replacement>>, positions and lengths in characters.
    """
    path = path or vocabulary()

    def make():
        tokens = WordTokens(path)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for doc_id, text, changes in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                tree = TokenTree(text, tokens)
                before, tree.encoded = tree.count, 0
                changes = [e for e in changes or [] if e is not None]
                for e in changes:
                    tree.replace(e["start"] or 0, e["length"] or 0, e["replacement"] or "")
                out.append((doc_id, before, tree.count, tree.length, len(changes), tree.encoded))
            names = ["doc_id", "n_tokens", "n_tokens_after", "n_chars_after", "n_edits", "reencoded_chars"]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names)

        return one

    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), edits.cast("array<struct<start:long,length:long,replacement:string>>").alias("edits")]
    return map_rows(docs, columns, make, "doc_id long, n_tokens long, n_tokens_after long, n_chars_after long, n_edits long, reencoded_chars long")


def sample_edits(text: str = "text") -> Column:
    """Three edits for the query: ten characters in the middle go, a phrase comes in at a third, the last five are replaced."""
    n = F.length(F.coalesce(F.col(text), F.lit(""))).cast("long")
    a = F.floor(n / 2)
    b = F.floor(n / 3)
    struct = lambda s, k, r: F.struct(s.cast("long").alias("start"), F.lit(k).cast("long").alias("length"), F.lit(r).alias("replacement"))
    return F.array(struct(a, 10, ""), struct(b, 0, " edited by hand,"), struct(n + 1, 5, "the end"))
