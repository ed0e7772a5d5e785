"""Benchmark decontamination by a prefix-filtered set join.

A window is ``width`` consecutive words of a benchmark item; an item of fewer words is one window.
The tokens of a window are ordered by rarity, counted over all documents, and the rarest is its
prefix: a text that holds the window must hold that token. The join therefore probes documents with
the prefix tokens alone, keeps a candidate only where the token's position leaves room for the whole
window (positional and length bounds), and verifies the window's words exactly.

Documents never shuffle. What the workers hold is the index of a slice of the benchmark of at most
``SLICE_BYTES`` of text; a larger benchmark is worked through slice by slice, the spans found so far
carried along with each row, so the result does not depend on the benchmark's size. The words of all
slices are counted in one pass.

Null text: no words. Null item_id or item text without words: no window. Items that repeat an id
count once. Null doc_id and repeated rows each return their row. Empty tables: nothing is hit. Other
columns are not read, but ``clean`` keeps them.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.arrowtools import map_rows, texts_per_batch
from wayfold.llm.texts import BLOCK, LONG_TEXT, utf8
from wayfold.session import Scratch

WIDTH = 8
MIN_ITEMS = 2
SLICE_BYTES = 8 << 20
#: Distinct words that a task counts before it hands them on.
HELD = 1 << 19
#: Capitals to small letters, and every other ASCII byte that is no letter or digit to a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")

#: prefix token -> [(its offset in the window, words of the window, {window: item numbers})]
Index = dict[bytes, list[tuple[int, int, dict[bytes, list[int]]]]]


def word_blocks(text: str | None) -> Iterator[list[bytes]]:
    data = utf8(text)
    if len(data) <= LONG_TEXT:
        yield data.translate(FOLD).split()
        return
    block = []
    for m in WORD.finditer(data):
        block.append(m[0].translate(FOLD))
        if len(block) == BLOCK:
            yield block
            block = []
    yield block


def windows(text: str | None, width: int = WIDTH) -> set[tuple[bytes, ...]]:
    words = [w for block in word_blocks(text) for w in block]
    if not words:
        return set()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def build(items: list[tuple[str, str]], rarity: Counter, width: int = WIDTH) -> tuple[Index, list[str]]:
    """The index of a slice of items, by each window's rarest word."""
    names = sorted({name for name, _ in items})
    number = {name: i for i, name in enumerate(names)}
    of: dict[tuple[bytes, ...], set[int]] = defaultdict(set)
    for name, text in items:
        for w in windows(text, width):
            of[w].add(number[name])
    index: dict[bytes, dict[tuple[int, int], dict]] = defaultdict(dict)
    for w, mine in of.items():
        offset = min(range(len(w)), key=lambda i: (rarity[w[i]], w[i], i))
        index[w[offset]].setdefault((offset, len(w)), {})[b" ".join(w)] = sorted(mine)
    return {token: [(offset, size, table) for (offset, size), table in by.items()] for token, by in index.items()}, names


def scan(text: str | None, index: Index, width: int = WIDTH) -> tuple[int, list[int], set[int]]:
    """Number of words, hit spans as merged [start, end, start, end, ...] in words, and item numbers."""
    found: list[tuple[int, int]] = []
    items: set[int] = set()
    before, tail = 0, []  # words before the current block's first, and the last ones of the block before
    total = 0
    for block in word_blocks(text):
        total += len(block)
        words = tail + block
        for i, w in enumerate(words):
            if w in index:
                for offset, size, table in index[w]:
                    s = i - offset
                    if s >= 0 and s + size <= len(words):
                        hit = table.get(b" ".join(words[s : s + size]))
                        if hit:
                            found.append((before + s, before + s + size))
                            items.update(hit)
        keep = min(len(words), width - 1)
        before += len(words) - keep
        tail = words[len(words) - keep :]
    spans: list[int] = []
    for s, e in sorted(set(found)):
        if spans and s <= spans[-1]:
            spans[-1] = max(spans[-1], e)
        else:
            spans += [s, e]
    return total, spans, items


def merged(spans: list[int]) -> list[int]:
    out: list[int] = []
    for s, e in sorted(zip(spans[::2], spans[1::2], strict=True)):
        if out and s <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += [s, e]
    return out


def _word_counts(texts: DataFrame, among: set[bytes] | None = None) -> DataFrame:
    """(word, n) over all ``texts``, of the words ``among`` or of all; counts are summed in each task first, ``HELD`` words at a time."""
    texts_per_batch(texts.sparkSession)

    def run(batches):
        counts: Counter = Counter()

        def take():
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for t in batch.column(0).to_pylist():
                for block in word_blocks(t):
                    counts.update(block if among is None else [w for w in block if w in among])
                    if len(counts) >= HELD:
                        yield take()
                        counts.clear()
        if counts:
            yield take()

    return texts.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _counter(rows: DataFrame) -> Counter:
    got = rows.select("word", "n").toArrow()
    return Counter(dict(zip(got.column("word").to_pylist(), got.column("n").to_pylist(), strict=True)))


def rarity(docs: DataFrame, vocabulary: set[bytes]) -> Counter:
    """How often each word of a vocabulary occurs in all documents."""
    return _counter(_word_counts(docs, vocabulary)) if vocabulary else Counter()


def rarity_by_slice(docs: DataFrame, items: DataFrame, scratch: Scratch) -> DataFrame:
    """(slice, word, n) of the words of every slice of the benchmark, from one pass over the documents."""

    def run(batches):
        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = list({w for block in word_blocks(t) for w in block})
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(words), pa.int64()), pa.array(words, pa.binary())], ["slice", "word"])

    known = items.select("slice", "text").mapInArrow(run, "slice long, word binary").distinct()
    return scratch.keep(known.join(_word_counts(docs), "word").select("slice", "word", "n"))


def sliced(benchmark: DataFrame, limit: int = SLICE_BYTES) -> tuple[DataFrame, int]:
    """The distinct items (name, text, slice), dealt to slices of about ``limit`` bytes of text, and the number of slices."""
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("name"), F.col("text").cast("string").alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // limit))
    return items.distinct().withColumn("slice", F.pmod(F.xxhash64("name", "text"), F.lit(n)).cast("long")), n


def hits(docs: DataFrame, benchmark: DataFrame, extra: list[str] = (), width: int = WIDTH, limit: int = SLICE_BYTES) -> DataFrame:
    """(extra..., text, n_words, spans, items) of every document: hit spans in words, ids of items with occurring windows."""
    scratch = Scratch(docs.sparkSession)
    base = docs.select(*extra, F.col("text").cast("string").alias("text"))
    now = base.withColumns({"n_words": F.lit(0).cast("long"), "spans": F.array().cast("array<long>"), "items": F.array().cast("array<string>")})
    items, n = sliced(benchmark, limit)
    if n > 1:
        items = scratch.keep(items)
        counts = rarity_by_slice(docs, items, scratch)
    for k in range(n):
        part = [(r["name"], r["text"]) for r in items.where(F.col("slice") == k).collect()]
        rare = _counter(counts.where(F.col("slice") == k)) if n > 1 else rarity(docs, {w for _, t in part for b in word_blocks(t) for w in b})
        index, names = build(part, rare, width)
        if k:
            now = scratch.keep(now)
        at = now.columns.index("text")

        def make(index=index, names=names, at=at):
            def one(batch: pa.RecordBatch) -> pa.RecordBatch:
                n_words, spans, items = [], [], []
                old = zip(batch.column(at + 2).to_pylist(), batch.column(at + 3).to_pylist(), strict=True)
                for t, (had, known) in zip(batch.column(at).to_pylist(), old, strict=True):
                    n, found, mine = scan(t, index, width)
                    n_words.append(n)
                    spans.append(merged(had + found) if had else found)
                    items.append(sorted({*known, *(names[i] for i in mine)}))
                columns = [*batch.columns[: at + 1], pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))]
                return pa.RecordBatch.from_arrays(columns, batch.schema.names)

            return one

        now = map_rows(now, now.columns, make, now.schema)
    return now


def report(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, min_items: int = MIN_ITEMS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document."""
    found = hits(docs.withColumn("doc_id", F.col("doc_id").cast("long")), benchmark, ["doc_id"], width)
    n_hit = F.aggregate(F.transform("spans", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)
    n_items = F.size("items").cast("long")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), n_items.alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (n_items >= min_items).alias("contaminated"))


def cut(text: str, spans: list[int]) -> str:
    """A text without the words of its hit spans and what stands between them."""
    data, out, at, k = utf8(text), [], 0, 0
    start = None
    for i, m in enumerate(WORD.finditer(data)):
        if k < len(spans) and i == spans[k]:
            start = m.start()
        if k < len(spans) and i == spans[k + 1] - 1:
            out.append(data[at:start])
            at, k = m.end(), k + 2
            if k >= len(spans):
                break
    out.append(data[at:])
    return b"".join(out).decode("utf-8", "surrogatepass")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def clean(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, min_items: int = MIN_ITEMS) -> DataFrame:
    """``docs`` without contaminated rows; single passages of the benchmark are cut out of the rows that stay.

    Columns stay as they are, but for the text of cut rows and their n_chars.
    """
    found = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row"), F.col("text"))
    kept = hits(found, benchmark, ["row"], width).where(F.size("items") < min_items)

    @F.pandas_udf("string")
    def without(text, spans):
        return text.combine(spans, lambda t, s: t if t is None or not len(s) else cut(t, [int(x) for x in s]))

    text = F.when(F.size("spans") > 0, without(F.col("text"), F.col("spans"))).otherwise(F.col("text"))
    kept = kept.select("row", text.alias("new_text"), (F.size("spans") > 0).alias("changed"))
    out = []
    for c in docs.columns:
        if c == "text":
            out.append(F.col("new_text").alias(c))
        elif c == "n_chars":
            out.append(F.when(F.col("changed"), F.length("new_text")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType).alias(c))
        else:
            out.append(F.col("row." + quoted(c)).alias(c))
    return kept.select(*out)
