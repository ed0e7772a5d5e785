"""SimHash near-duplicates by anchor-point covering.

A 64-bit fingerprint is two halves of 32 bits. Fingerprints at 3 or fewer differing bits have a
half with at most one differing bit. In each half, 31 bits carry the Hamming code [31, 26], whose
words are the anchors: it covers every point within radius R = 1. A fingerprint's *home* is its
anchor within R; it is replicated to every anchor within R + 1 (16 at most), so the home of one
side of every link is among the other side's anchors. Fingerprints are compared per anchor, home
rows against all rows, by the number of differing bits of all 64.

Equal texts share one fingerprint and are collapsed before anything is replicated. What leaves an
anchor is a spanning forest of its links, never all pairs. Components come from alternating
large-star and small-star rounds over tables in the shared folder.

Null text: no words, fingerprint zero, linked like any other. Null doc_id: the row keeps its
fingerprint, has a null component and links nothing. Repeated rows each return their row. Empty
tables give empty results. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm.arrowtools import map_rows, texts_per_batch
from wayfold.llm.texts import LOWER, utf8, word_blocks
from wayfold.session import Scratch, prepare

DISTANCE = 3
HOT_HOMES = 4096
RUN = 32
#: Bits of the bitmap that spares most rows a shuffle (8 MB), and of each of its rows.
MARKS, PAGE = 1 << 26, 1 << 15


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    out = np.zeros(64, np.int64)
    for i in range(0, len(bits), 255):
        out += bits[i : i + 255].sum(axis=0, dtype=np.uint8)
    return out


def fingerprint(text: str | None, width: int = 3) -> int:
    """SimHash of a whole text as an unsigned 64-bit integer; zero without words."""
    data = utf8(text).translate(LOWER)
    digest = xxhash.xxh64_intdigest
    counts, n, tail = np.zeros(64, np.int64), 0, []
    for words in word_blocks(data):
        words = tail + words
        if len(words) >= width:
            hashes = np.array([digest(s, 42) for s in map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))], np.uint64)
            counts += _bit_counts(hashes)
            n += len(hashes)
        tail = words[-(width - 1) :] if width > 1 else []
    if n == 0:
        if not tail:
            return 0
        return int(digest(b" ".join(tail), 42))
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long with the same bits."""

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            fps = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

        return one

    return map_rows(docs, [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")], make, "doc_id long, fp long")


# The pairs i < j of positions 1..31 with i ^ j = s, by syndrome s: 15 for each s > 0.
PAIRS = np.array([[0] * 15] + [[(1 << i) ^ (1 << (i ^ s)) for i in range(1, 32) if i < i ^ s] for s in range(1, 32)], np.int64)
CHECKS = [sum(1 << i for i in range(1, 32) if i >> b & 1) for b in range(5)]


def _syndrome(half: np.ndarray) -> np.ndarray:
    out = np.zeros(len(half), np.int64)
    for b, mask in enumerate(CHECKS):
        out |= (np.bitwise_count(half & mask).astype(np.int64) & 1) << b
    return out


def _anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, anchor keys and home flags of every anchor within radius + 1 of each half."""
    rows, keys, homes = [], [], []
    bits = fp.view(np.uint64)
    at = np.arange(len(fp))
    for side in (0, 1):
        half = ((bits >> np.uint64(32 * side)) & np.uint64(0xFFFFFFFE)).astype(np.int64)
        s = _syndrome(half)
        home = np.where(s > 0, half ^ (1 << s), half)
        rows.append(at)
        keys.append(home | side)
        homes.append(np.ones(len(fp), bool))
        off = s > 0
        rows.append(np.repeat(at[off], 15))
        keys.append(((half[off][:, None] ^ PAIRS[s[off]]) | side).ravel())
        homes.append(np.zeros(15 * int(off.sum()), bool))
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(homes)


class _Forest:
    """Union-find over ids; remembers only the links that joined two trees."""

    def __init__(self):
        self.parent: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        p = self.parent
        while (q := p.get(x, x)) != x:
            p[x] = r = p.get(q, q)
            x = r
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            a, b = min(a, b), max(a, b)
            self.parent[b] = a
            self.links.append((b, a))

    def take(self, limit: int = 0) -> pa.RecordBatch | None:
        if len(self.links) <= limit:
            return None
        links = np.array(self.links, np.int64)
        self.links = []
        if len(self.parent) > 500_000:  # forgetting only repeats links
            self.parent = {}
        return pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], ["a", "b"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of rows (key, salt, home, fp, rep) sorted by key, salt and home rows first.

    Short runs of one key are compared by shifted arrays. For a long run the homes are held and
    the other rows stream past in batches, so memory is the homes of one salted key.
    """
    forest = _Forest()
    held: list[np.ndarray] = []  # the run at the end of the batch, which may go on
    homes_fp = np.zeros(0, np.uint64)  # of a long run in progress
    homes_rep = np.zeros(0, np.int64)
    long_key: tuple[int, int] | None = None

    def stream(fp, rep):
        for i in range(0, len(homes_fp), 1024):
            for j in range(0, len(fp), 4096):
                near = np.bitwise_count(homes_fp[i : i + 1024, None] ^ fp[None, j : j + 4096]) <= DISTANCE
                for x, y in np.argwhere(near):
                    forest.join(int(homes_rep[i + x]), int(rep[j + y]))

    for batch in batches:
        if not batch.num_rows:
            continue
        now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
        now[3] = now[3].view(np.uint64)  # bitwise_count would take the absolute value of a signed number
        cols = [np.concatenate(x) for x in zip(held, now, strict=True)] if held else now
        key, salt, home, fp, rep = cols
        start = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])])
        last = start[-1]
        end = np.r_[start[1:], len(key)]
        if long_key is not None:
            first = int(end[0]) if (int(key[0]), int(salt[0])) == long_key else 0
            if first:
                more = home[:first]
                homes_fp, homes_rep = np.r_[homes_fp, fp[:first][more]], np.r_[homes_rep, rep[:first][more]]
                stream(fp[:first], rep[:first])
                key, salt, home, fp, rep = (c[first:] for c in (key, salt, home, fp, rep))
                held = []
                if not len(key):
                    continue
                start = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])])
                end, last = np.r_[start[1:], len(key)], start[-1]
            long_key = None
            homes_fp, homes_rep = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        size = end - start
        if len(key) - last > 4 * RUN:  # the last run is long already: hold only its homes from now on
            long_key = (int(key[last]), int(salt[last]))
            mine = home[last:]
            homes_fp, homes_rep = fp[last:][mine], rep[last:][mine]
            stream(fp[last:], rep[last:])
            held = []
        else:
            held = [c[last:] for c in (key, salt, home, fp, rep)]
        _runs(forest, start[:-1], size[:-1], home, fp, rep)
        if out := forest.take(20_000):
            yield out
    if held:
        key, salt, home, fp, rep = held
        _runs(forest, np.array([0]), np.array([len(key)]), home, fp, rep)
    if out := forest.take():
        yield out


def _runs(forest: _Forest, start, size, home, fp, rep) -> None:
    """Compare homes with all rows inside finished runs."""
    for s, n in zip(start[size > RUN], size[size > RUN], strict=True):
        h = int(home[s : s + n].sum())
        for i in range(0, h, 1024):
            for x, y in np.argwhere(np.bitwise_count(fp[s + i : s + min(h, i + 1024), None] ^ fp[None, s : s + n]) <= DISTANCE):
                forest.join(int(rep[s + i + x]), int(rep[s + y]))
    short = (size > 1) & (size <= RUN)
    start, size = start[short], size[short]
    if not len(start):
        return
    at = np.repeat(start - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
    stop = np.repeat(start + size, size)
    for k in range(1, RUN):
        alive = at + k < stop
        at, stop = at[alive], stop[alive]
        if not len(at):
            return
        for i in at[home[at] & (np.bitwise_count(fp[at] ^ fp[at + k]) <= DISTANCE)]:
            forest.join(int(rep[i]), int(rep[i + k]))


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): a spanning set of the links between the rows (fp, rep) of ``distinct``."""
    spark = prepare(distinct.sparkSession)

    def replicate(batches):
        for batch in batches:
            fp, rep = (batch.column(i).to_numpy() for i in (0, 1))
            for i in range(0, len(fp), 4096):
                row, key, home = _anchors(fp[i : i + 4096])
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(home), pa.array(fp[i : i + 4096][row]), pa.array(rep[i : i + 4096][row])], ["key", "home", "fp", "rep"])

    rows = distinct.select("fp", "rep").mapInArrow(replicate, "key long, home boolean, fp long, rep long")
    hot = rows.where("home").groupBy("key").agg(F.count("*").alias("homes")).where(F.col("homes") > HOT_HOMES)
    hot = hot.select("key", F.ceil(F.col("homes") / HOT_HOMES).cast("int").alias("salts"))
    if hot.take(1):
        # A crowded anchor: its homes go to every salt, its other rows to one, so no task holds it whole.
        rows = rows.join(hot, "key", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
        every = rows.select("key", "home", "fp", "rep", F.explode(F.when(F.col("home"), F.sequence(F.lit(0), F.col("salts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("fp"), F.col("salts")).cast("int")))).alias("salt"))
    else:
        every = rows.withColumn("salt", F.lit(0))
    # The number of partitions is left to the session, so that it can be coalesced or raised.
    dealt = every.select("key", "salt", "home", "fp", "rep").repartition("key", "salt").sortWithinPartitions("key", "salt", F.desc("home"))
    return dealt.mapInArrow(_compare, "a long, b long").where("a <> b").distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component): the smallest node reachable, for every node with an edge.

    Alternating large-star and small-star rounds. A hub is never gathered: each round takes the
    smallest neighbour by a partial aggregate and joins it back.
    """
    now = scratch.keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    seen = None
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).union(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()
        new = scratch.keep(small)
        state = new.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
        scratch.drop(now)
        now = new
        if state == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
        seen = state


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document; see the module for the edge cases."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    fps = scratch.keep(fingerprints(docs))
    distinct = scratch.keep(fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")))
    labels = components(links(distinct), scratch)
    of = distinct.join(labels, distinct.rep == labels.node, "left").select(F.col("fp").alias("of_fp"), F.coalesce("component", "rep").alias("component_id"))
    out = fps.join(of, fps.fp == of.of_fp, "left")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def _rows(docs: DataFrame) -> DataFrame:
    """(row, id): whole rows as one struct, whatever their columns are called."""
    return docs.select(F.struct(*[F.col(_quoted(c)) for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows (row, id) whose id is not among the distinct ids ``gone_id`` of ``gone``.

    The ids set bits of a hashed bitmap of ``MARKS`` bits, ``MARKS / 8`` bytes at every input size, which
    alone is broadcast. Rows on a bit that is not set stay where they are; only the others, whole
    texts included, are dealt out for the exact join.
    """
    slot = lambda x: F.pmod(F.xxhash64(F.lit(0), x), F.lit(MARKS))
    marks = gone.select(slot(F.col("gone_id")).alias("slot")).groupBy(F.floor(F.col("slot") / PAGE).alias("page")).agg(F.bitmap_construct_agg(F.col("slot") % PAGE).alias("bits"))
    rows = rows.withColumn("slot", slot(F.col("id")))
    byte = F.conv(F.hex(F.substring("bits", (F.floor(F.col("slot") % PAGE / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    marked = F.coalesce(F.getbit(byte, (F.col("slot") % 8).cast("int")) == 1, F.lit(False)) & F.col("id").isNotNull()
    rows = rows.join(F.broadcast(marks), F.floor(F.col("slot") / PAGE) == F.col("page"), "left").select("row", "id", marked.alias("marked"))
    doubted = rows.where("marked").select("row", "id")
    return rows.where("not marked").select("row", "id").unionByName(doubted.join(gone, F.col("id") == F.col("gone_id"), "left_anti"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without all but one of each component, all columns as they are.

    Components are of fingerprints here, so unlike texts of one doc_id are of different ones. Of each, a
    row of the smallest doc_id stays; where several rows of it are alike, the first by text. Rows of a
    null doc_id stay. Columns of any name are kept as they are.
    """
    scratch = Scratch(docs.sparkSession)
    fps = scratch.keep(fingerprints(docs).where("doc_id is not null"))
    distinct = scratch.keep(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    labels = components(links(distinct.select("fp", F.col("fp").alias("rep"))), scratch)
    linked = scratch.keep(labels.join(distinct, labels.node == distinct.fp).select(F.col("fp").alias("_fp"), F.col("component").alias("_component"), "first"))
    least = linked.groupBy("_component").agg(F.min("first").alias("_least"))
    of = distinct.select(F.col("fp").alias("_fp"), "first").join(linked.join(least, "_component").select("_fp", "_component", "_least"), "_fp", "left")
    of = of.select("_fp", F.coalesce("_component", "_fp").alias("_component"), F.coalesce("_least", "first").alias("_least"))
    found = fps.join(of, fps.fp == of["_fp"]).select(F.col("doc_id").alias("gone_id"), "_fp", "_component", (F.col("doc_id") == F.col("_least")).alias("_stays"))
    found = scratch.keep(found)
    ids = scratch.keep(found.groupBy("gone_id").agg(F.count("*").alias("_rows"), F.max("_stays").alias("_any")))
    left = without(_rows(docs), ids.where("not _any").select("gone_id"))
    repeated = ids.where("_any and _rows > 1").select("gone_id")
    whole = [F.col("row." + _quoted(c)) for c in docs.columns]
    if not repeated.take(1):
        return left.select(*whole)
    again = F.col("id") == F.col("gone_id")
    once = left.join(repeated, again, "left_anti").select("row")
    twice = left.join(repeated, again, "left_semi").withColumn("fp", _print_of(docs.sparkSession)(F.col("row.text").cast("string")))
    stays = found.where("_stays").join(repeated, "gone_id", "left_semi").select("gone_id", "_fp", "_component").distinct()
    # The first by text of each component: a partial minimum, so a crowd of equal rows is never gathered.
    firsts = twice.join(stays, again & (F.col("fp") == F.col("_fp"))).groupBy("_component").agg(F.min_by("row", F.struct(F.col("row.text").isNotNull(), F.col("row.text"))).alias("row"))
    return once.unionByName(firsts.select("row")).select(*whole)


def _print_of(spark: SparkSession):
    """The fingerprint of a text as a function of columns."""
    from pyspark.sql.functions import arrow_udf

    texts_per_batch(spark)

    @arrow_udf("long")
    def fp(text: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t) for t in text.to_pylist()], np.uint64).view(np.int64))

    return fp
