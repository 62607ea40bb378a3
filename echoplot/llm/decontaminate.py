"""Benchmark decontamination by the q-gram lemma.

Benchmark items are cut into windows of `window` bytes (a shorter item is one window).
A window of m bytes that occurs in a document with at most e = rate * m edits shares at
least m + 1 - q - q * e of its q-grams with it, on at most e + 1 neighbouring diagonals.
So: count shared q-grams in overlapping bands of diagonals, keep the regions that reach
the bound, and verify those by banded alignment. A document is contaminated if a window
of an item aligns within its edit budget, or if any `PASSAGE` bytes in a row of an item,
wherever they start, do so: for these the shared q-grams are counted in every stretch of
the item of that length, and each stretch that reaches the bound is aligned.

Texts are compared with A-Z lowered and runs of white space as one space. Items under
`least` bytes of that are no evidence inside another text: they count where they are the
whole text of a document.

A benchmark of at most `block_bytes` of text is sent to all tasks as an index, and each
document is judged where it is read. A larger one is dealt into blocks of that size:
documents' q-grams that pass a bitmap of bounded size meet the benchmark's by their
hashes, and the documents that share some with a block are verified with the index of
that block; so documents are read twice, whatever the number of blocks, and the finds of
all blocks come together in one row a document.

Null and empty texts are clean; repeated rows are judged alike, each with a row of its
own; very long texts are taken in overlapping stretches of whole windows, none is cut;
null texts of items are left out, and items with a null id are told as one item without
id; an empty benchmark leaves every document clean. `matches` returns its own columns
only; `without_benchmark` keeps all columns of docs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACE, U, chunks, mix, read, text_bytes, written

Q, RATE, WINDOW, LEAST, BLOCK_BYTES = 10, 0.08, 160, 30, 4 << 20
PASSAGE = 80
BITS = 22
#: pairs of places looked at in a step; hits of a step's last OVERLAP bytes are looked at again in the next one
STEP, OVERLAP = 2_000_000, 2 * WINDOW
#: bits of the bitmap of a large benchmark's q-grams: 16 for each, 128 MB at most
BITMAP_BITS = 30


def normal(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower case, one space for a run of white space; offsets of the texts in that."""
    low = LOWER[raw]
    space = SPACE[raw]
    low[space] = 32
    keep = ~space
    keep[1:] |= ~space[:-1]
    keep[:1] = True
    edge = off[:-1]
    keep[edge[edge < len(raw)]] = True
    return low[keep], np.concatenate([[0], np.cumsum(keep)])[off]


def grams(raw: np.ndarray, q: int = Q) -> np.ndarray:
    """A hash of the q bytes (8 to 16) from each position on."""
    n = len(raw) - q + 1
    if n <= 0:
        return np.zeros(0, U)
    raw = np.ascontiguousarray(raw)
    eight = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))
    with np.errstate(over="ignore"):
        return mix(eight[:n] * U(0x9E3779B97F4A7C15) ^ (eight[q - 8 : q - 8 + n] + U(q)) * U(0xC2B2AE3D27D4EB4F))


def stripped(low: np.ndarray) -> np.ndarray:
    """A normal text without the space before and after it."""
    low = low[1:] if len(low) and low[0] == 32 else low
    return low[:-1] if len(low) and low[-1] == 32 else low


def whole_short(low: np.ndarray, off: np.ndarray, least: int):
    """(text, its bytes) of the normal texts of 1 to least - 1 bytes."""
    for r in np.flatnonzero((np.diff(off) > 0) & (np.diff(off) < least + 2)):
        text = stripped(low[off[r] : off[r + 1]])
        if 0 < len(text) < least:
            yield int(r), text.tobytes()


class Index:
    """Windows of benchmark items and where each of their q-grams stands, in windows and in the items of PASSAGE bytes or more."""

    def __init__(self, items: list[tuple[int, str | None]], q: int = Q, rate: float = RATE, window: int = WINDOW, least: int = LEAST):
        self.q, self.items, self.windows = q, [], []
        self.least, self.short = max(least, q), {}
        self.long_items, self.long_texts = [], []
        self.passage_budget = int(PASSAGE * rate)
        self.passage_bound = max(1, PASSAGE + 1 - q - q * self.passage_budget)
        for item, text in items:
            raw, off = text_bytes(pa.array([text], pa.string()))
            low = stripped(normal(raw, off)[0])
            if 0 < len(low) < self.least:
                self.short.setdefault(low.tobytes(), set()).add(item)
                continue
            for at in range(0, max(1, len(low) - window // 2), window // 2):
                at = max(0, min(at, len(low) - window))
                piece = low[at : at + window]
                if len(piece) >= self.least:
                    self.items.append(item)
                    self.windows.append(piece)
            if len(low) >= PASSAGE:
                self.long_items.append(item)
                self.long_texts.append(low)
        self.length = np.array([len(w) for w in self.windows], np.int64)
        self.budget = (self.length * rate).astype(np.int64)
        self.bound = np.maximum(1, self.length + 1 - q - q * self.budget)
        key = [grams(w, q) for w in self.windows]
        hashes = np.concatenate(key) if key else np.zeros(0, U)
        order = np.argsort(hashes, kind="stable")
        self.win = np.repeat(np.arange(len(key)), [len(k) for k in key])[order]
        self.pos = np.concatenate([np.arange(len(k)) for k in key])[order] if key else np.zeros(0, np.int64)
        self.key, self.first, self.count = np.unique(hashes[order], return_index=True, return_counts=True)
        key = [grams(t, q) for t in self.long_texts]
        hashes = np.concatenate(key) if key else np.zeros(0, U)
        order = np.argsort(hashes, kind="stable")
        self.long_of = np.repeat(np.arange(len(key)), [len(k) for k in key])[order]
        self.long_pos = np.concatenate([np.arange(len(k)) for k in key])[order] if key else np.zeros(0, np.int64)
        self.long_first = np.searchsorted(hashes[order], self.key, "left")
        self.long_count = np.searchsorted(hashes[order], self.key, "right") - self.long_first
        self.seen = np.zeros(1 << BITS, bool)
        self.seen[self.key >> U(64 - BITS)] = True


def banded(patterns: np.ndarray, regions: np.ndarray, budget: int) -> np.ndarray:
    """The least edits of each row of patterns (length m) against any stretch of the row of regions beside it, over
    the diagonals 0 to w of the regions (length m + w) alone; budget + 1 if more."""
    m, w = patterns.shape[1], regions.shape[1] - patterns.shape[1]
    diagonal = np.arange(w + 1, dtype=np.int32)
    row = np.zeros((len(patterns), w + 1), np.int32)
    for i in range(m):
        new = row + (regions[:, i : i + w + 1] != patterns[:, i : i + 1])
        new[:, :-1] = np.minimum(new[:, :-1], row[:, 1:] + 1)  # a byte of the pattern left out
        row = np.minimum.accumulate(new - diagonal, axis=1) + diagonal  # bytes of the region left out
        if row.min() > budget:
            break
    return np.minimum(row.min(1), budget + 1)


def region(low: np.ndarray, start: int, stop: int, place: np.ndarray) -> np.ndarray:
    """The bytes of a text (low[start:stop]) at some places; -1 outside it."""
    inside = (place >= start) & (place < stop)
    return np.where(inside, low[np.clip(place, 0, len(low) - 1)], -1).astype(np.int16)


def aligned(pattern: np.ndarray, low: np.ndarray, start: int, stop: int, lo: int, width: int, e: int) -> int:
    """The least edits of a window against low[start:stop] on the diagonals lo to lo + width - 1 and those
    that e edits can reach from them."""
    m, w = len(pattern), width - 1 + 2 * e
    if pattern.tobytes() in low[max(start, lo - e) : max(0, min(stop, lo - e + m + w))].tobytes():
        return 0
    return int(banded(pattern[None].astype(np.int16), region(low, start, stop, lo - e + np.arange(m + w))[None], e)[0])


def passage(index: Index, which: int, pos: np.ndarray, low: np.ndarray, start: int, stop: int, lo: int, width: int) -> int:
    """The least edits of PASSAGE bytes in a row of an item against low[start:stop] on the diagonals from lo on,
    over the stretches in which enough of the shared q-grams (at pos, ascending) stand; over the budget if none is within it."""
    text, e, bound = index.long_texts[which], index.passage_budget, index.passage_bound
    first, last = pos[: len(pos) - bound + 1], pos[bound - 1 :]
    wide = last - first <= PASSAGE - index.q
    # a stretch holds grams first to last if it starts from last + q - PASSAGE to first
    mark = np.zeros(len(text) + 1, np.int64)
    np.add.at(mark, np.maximum(last[wide] + index.q - PASSAGE, 0), 1)
    np.add.at(mark, first[wide] + 1, -1)
    at = np.flatnonzero(np.cumsum(mark) > 0)
    at = at[at <= len(text) - PASSAGE]
    least = e + 1
    for k in range(0, len(at), 256):
        a = at[k : k + 256, None]
        beside = region(low, start, stop, a + lo - e + np.arange(PASSAGE + width - 1 + 2 * e))
        least = min(least, int(banded(text[a + np.arange(PASSAGE)].astype(np.int16), beside, e).min()))
        if least == 0:
            break
    return least


def stretches(at: np.ndarray, load: np.ndarray, most: int = STEP, overlap: int = OVERLAP):
    """(begin, to) of hits at ascending places, with about `most` of the cumulated load each; every window
    stands whole in one of them, since hits in the last `overlap` bytes come again."""
    begin = 0
    while begin < len(at):
        to = int(np.searchsorted(load, (load[begin - 1] if begin else 0) + most, "right"))
        to = min(len(at), max(to, int(np.searchsorted(at, at[begin] + 2 * overlap, "right"))))
        yield begin, to
        if to == len(at):
            return
        begin = int(np.searchsorted(at, at[to] - overlap, "left"))


def find(index: Index, raw: np.ndarray, off: np.ndarray, most: int = STEP) -> list[tuple]:
    """(text, item, place in the normal text, edits) of the items found in a chunk of texts."""
    low, off = normal(raw, off)
    found = {}
    if index.short:
        found = {(r, item): (0, 0) for r, text in whole_short(low, off, index.least) for item in index.short.get(text, ())}
    ordered = lambda: [(int(r), i, p, d) for (r, i), (p, d) in sorted(found.items(), key=lambda x: (x[0][0], x[0][1] is not None, x[0][1] or 0))]
    h = grams(low, index.q) if len(index.key) else np.zeros(0, U)
    at = np.flatnonzero(index.seen[h >> U(64 - BITS)])
    if not len(at):
        return ordered()
    spot = np.minimum(np.searchsorted(index.key, h[at]), len(index.key) - 1)
    hit = index.key[spot] == h[at]
    at, spot = at[hit], spot[hit]
    text = np.searchsorted(off, at, "right") - 1
    inside = at + index.q <= off[text + 1]
    at, spot, text = at[inside], spot[inside], text[inside]
    # a pair for each place of the gram in the benchmark, in steps that bound the pairs held
    for begin, to in stretches(at, np.cumsum(index.count[spot] + index.long_count[spot]), most):
        a, s, t = at[begin:to], spot[begin:to], text[begin:to]
        c = index.count[s]
        of = np.repeat(np.arange(len(a)), c)
        place = index.first[s][of] + np.arange(len(of)) - np.repeat(np.cumsum(c) - c, c)
        win, pos = index.win[place], index.pos[place]
        diagonal = a[of] - pos
        wide = 2 * (index.budget[win] + 1)
        for shift in (0, 1):
            band = (diagonal + shift * (wide // 2) + WINDOW * 4) // wide
            order = np.lexsort((band, win, t[of]))
            k = np.stack([t[of][order], win[order], band[order]])
            new = np.ones(k.shape[1], bool)
            new[1:] = (k[:, 1:] != k[:, :-1]).any(0)
            start = np.flatnonzero(new)
            size = np.diff(np.append(start, k.shape[1]))
            enough = size >= index.bound[k[1, start]]
            for r, w, b in k[:, start[enough]].T:
                item = index.items[w]
                if (r, item) in found and found[r, item][1] == 0:
                    continue
                e, wd = int(index.budget[w]), int(2 * (index.budget[w] + 1))
                lo = int(b) * wd - shift * (wd // 2) - WINDOW * 4
                d = aligned(index.windows[w], low, int(off[r]), int(off[r + 1]), lo, wd, e)
                if d <= e and ((r, item) not in found or d < found[r, item][1]):
                    found[r, item] = (max(0, lo - int(off[r])), d)
        # passages of items that no window has shown in the text
        c = index.long_count[s]
        of = np.repeat(np.arange(len(a)), c)
        place = index.long_first[s][of] + np.arange(len(of)) - np.repeat(np.cumsum(c) - c, c)
        long, pos = index.long_of[place], index.long_pos[place]
        diagonal, texts = a[of] - pos, t[of]
        wide, bound, more = 2 * (index.passage_budget + 1), index.passage_bound, {}
        for shift in (0, 1):
            band = (diagonal + shift * (wide // 2)) // wide
            order = np.lexsort((pos, band, long, texts))
            k = np.stack([texts[order], long[order], band[order]])
            p = pos[order]
            new = np.ones(k.shape[1], bool)
            new[1:] = (k[:, 1:] != k[:, :-1]).any(0)
            start = np.flatnonzero(new)
            stop = np.append(start[1:], len(p))
            group = np.cumsum(new) - 1
            near = max(0, len(p) - bound + 1)
            dense = (group[:near] == group[bound - 1 :]) & (p[bound - 1 :] - p[:near] <= PASSAGE - index.q)
            for g in np.unique(group[:near][dense]):
                r, w, b = (int(x) for x in k[:, start[g]])
                item = index.long_items[w]
                if (r, item) in found or more.get((r, item), (0, 1))[1] == 0:
                    continue
                lo = b * wide - shift * (wide // 2)
                d = passage(index, w, p[start[g] : stop[g]], low, int(off[r]), int(off[r + 1]), lo, wide)
                if d <= index.passage_budget and ((r, item) not in more or d < more[r, item][1]):
                    more[r, item] = (max(0, lo + int(p[start[g]]) - int(off[r])), d)
        found |= more
    return ordered()


FOUND = "struct<item_id:long,place:long,edits:int>"
SCHEMA = f"doc_id long, items array<{FOUND}>"
_ARROW = pa.struct([("item_id", pa.int64()), ("place", pa.int64()), ("edits", pa.int32())])


def block_count(benchmark: DataFrame, block_bytes: int) -> int:
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, -(-int(total) // block_bytes))


def small_index(spark, benchmark: DataFrame, **options):
    """The index of a benchmark of one block, sent to all tasks."""
    return spark.sparkContext.broadcast(Index([(r.item_id, r.text) for r in benchmark.select("item_id", "text").distinct().collect()], **options))


def matches(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, **options) -> DataFrame:
    """doc_id and the items found, one row for each row of docs."""
    n_blocks = block_count(benchmark, block_bytes)
    slim = docs.selectExpr("cast(doc_id as long) as doc_id", "text")
    if n_blocks > 1:
        found = found_in_blocks(docs, benchmark, n_blocks, **options)
        rows = slim.select("doc_id", *_told("text"))
        told = rows.join(found, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("t1") == F.col("__t1")) & (F.col("t2") == F.col("__t2")), "left")
        return told.select("doc_id", F.coalesce("items", F.expr(f"cast(array() as array<{FOUND}>)")).alias("items"))
    index = small_index(docs.sparkSession, benchmark, **options)

    def run(batches):
        for rows, raw, off in chunks(batches, "text"):
            per = [[] for _ in range(rows.num_rows)]
            for r, item, place, d in find(index.value, raw, off):
                per[r].append({"item_id": item, "place": place, "edits": d})
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(per, pa.list_(_ARROW))], ["doc_id", "items"])

    return slim.mapInArrow(run, SCHEMA)


def _told(text: str):
    """Two numbers that tell texts apart."""
    return F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(17), F.col(text)).alias("t2")


def _keys(raw: np.ndarray, off: np.ndarray, q: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, key) of texts: their q-grams; of a short text, the hash of the whole."""
    import hashlib

    low, off = normal(raw, off)
    h = grams(low, q)
    at = np.arange(len(h))
    row = np.searchsorted(off, at, "right") - 1
    inside = at + q <= off[row + 1]
    short = list(whole_short(low, off, least))
    row = np.concatenate([row[inside], np.array([r for r, _ in short], np.int64)])
    h = np.concatenate([h[inside], np.array([int.from_bytes(hashlib.blake2b(t, digest_size=8).digest(), "little") for _, t in short], U)])
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return row[new], h[new]


def found_in_blocks(docs: DataFrame, benchmark: DataFrame, n_blocks: int, q: int = Q, least: int = LEAST, **options) -> DataFrame:
    """__id, __t1, __t2 (of the text) and items of the documents that hold items of a benchmark of several blocks."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    least = max(least, q)
    bench = written(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").distinct().withColumn("b", F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)).cast("int")), "benchmark")

    def keyed(batches):
        for rows, raw, off in chunks(batches, "text"):
            r, h = _keys(raw, off, q, least)
            yield pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64)), rows.column(1).take(pa.array(r))], ["h", "b"])

    keys = written(bench.select("text", "b").mapInArrow(keyed, "h long, b int").distinct(), "benchmark-keys")
    bits = min(BITMAP_BITS, max(10, (16 * keys.count()).bit_length()))
    words = keys.select(F.shiftrightunsigned("h", 64 - bits).alias("p")).groupBy(F.expr("p div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, int(p % 64))")).alias("v"))
    seen = np.zeros(max(1, 1 << (bits - 6)), np.int64)
    for part in words.toLocalIterator():  # at most 2**BITMAP_BITS bits
        seen[part.w] = part.v
    bitmap = spark.sparkContext.broadcast(seen.view(np.uint8))

    def asked(batches):
        for rows, raw, off in chunks(batches, "text"):
            r, h = _keys(raw, off, q, least)
            p = h >> U(64 - bits)
            hit = (bitmap.value[(p >> U(3)).astype(np.int64)] >> (p & U(7)).astype(np.uint8)) & 1 > 0
            r = pa.array(r[hit])
            yield pa.RecordBatch.from_arrays([pa.array(h[hit].astype(np.int64)), *(rows.column(c).take(r) for c in (1, 2, 3))], ["h", "doc_id", "t1", "t2"])

    texts = docs.selectExpr("text", "cast(doc_id as long) as doc_id").where("text is not null").select("text", "doc_id", *_told("text"))
    shared = texts.mapInArrow(asked, "h long, doc_id long, t1 long, t2 long").join(keys, "h").select("doc_id", "t1", "t2", "b").distinct()
    wanted = written(shared, "wanted")
    got = texts.withColumnsRenamed({"doc_id": "__id", "t1": "__t1", "t2": "__t2"}).dropDuplicates(["__id", "__t1", "__t2"])
    got = got.join(wanted, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("t1") == F.col("__t1")) & (F.col("t2") == F.col("__t2")))
    salts = max(1, -(-n // n_blocks))
    # a task gets the items of a block first, then its share of the documents
    items = bench.select("b", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("kind"), "text", "item_id", F.lit(0).cast("long").alias("t1"), F.lit(0).cast("long").alias("t2"))
    cases = got.select("b", F.pmod("t2", F.lit(salts)).cast("int").alias("salt"), F.lit(1).alias("kind"), "text", F.col("__id").alias("item_id"), "t1", "t2")
    dealt = items.union(cases).repartition(n, "b", "salt").sortWithinPartitions("b", "salt", "kind")

    def verified(batches):
        held, index, where = [], None, None
        for rows, raw, off in chunks(batches, "text"):
            place = list(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), rows.column(2).to_pylist(), strict=True))
            at, out = 0, []
            while at < len(place):
                to = at + 1
                while to < len(place) and place[to] == place[at]:
                    to += 1
                if place[at][:2] != where:
                    held, index, where = [], None, place[at][:2]
                part = rows.slice(at, to - at)
                if place[at][2] == 0:
                    held += list(zip(part.column(4).to_pylist(), part.column(3).to_pylist(), strict=True))
                else:
                    index = index or Index(held, q, least=least, **options)
                    ids, t1, t2 = (part.column(c).to_pylist() for c in (4, 5, 6))
                    out += [(ids[r], t1[r], t2[r], item, p, d) for r, item, p, d in find(index, raw[off[at] : off[to]], off[at : to + 1] - off[at])]
                at = to
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int32() if k == 5 else pa.int64()) for k in range(6)], ["__id", "__t1", "__t2", "item_id", "place", "edits"])

    each = dealt.mapInArrow(verified, "__id long, __t1 long, __t2 long, item_id long, place long, edits int")
    best = each.groupBy("__id", "__t1", "__t2", "item_id").agg(F.min(F.struct("edits", "place")).alias("x"))
    return written(best.groupBy("__id", "__t1", "__t2").agg(F.sort_array(F.collect_list(F.struct("item_id", "x.place", "x.edits"))).alias("items")), "found")


def without_benchmark(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, **options) -> DataFrame:
    """The rows of docs that hold no benchmark text."""
    n_blocks = block_count(benchmark, block_bytes)
    if n_blocks > 1:
        found = found_in_blocks(docs, benchmark, n_blocks, **options)
        same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__t1")) & (F.xxhash64(F.lit(17), F.col("text")) == F.col("__t2"))
        return docs.join(found, same, "left_anti")
    index = small_index(docs.sparkSession, benchmark, **options)

    def run(batches):
        for rows, raw, off in chunks(batches, "text"):
            clean = np.ones(rows.num_rows, bool)
            clean[[r for r, *_ in find(index.value, raw, off)]] = False
            yield rows.filter(pa.array(clean))

    return docs.mapInArrow(run, docs.schema)


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    """One row per document: the items it holds, and kept if there are none."""
    found = matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    ids = F.sort_array(F.transform("items", lambda x: x["item_id"]))
    return found.select("doc_id", F.size("items").alias("n_items"), ids.alias("item_ids"), F.array_min(F.transform("items", lambda x: x["edits"])).alias("least_edits"), (F.size("items") > 0).alias("contaminated"), (F.size("items") == 0).alias("kept"))


QUERIES = {"op2_decontamination": op2_decontaminate}
ORACLES: dict[str, str] = {}
