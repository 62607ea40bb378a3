"""Repeated 50-byte strings across documents: prefix doubling's ranks on sampled positions, by exact hash classes.

`doubled` is plain prefix doubling with sorts over every position; `repeated`, which the query uses, keeps its idea of
comparing longer and longer strings by pairs of ranks and of dropping unique ones, but not its sorts:

Ranks stand for equality classes of byte strings, positions for where they start; a round
groups (rank, rank at an offset) pairs of the live positions and leaves out those that are
unique. Over every position a round would shuffle many times the input, so:

1. Length 24: in each window of 50 bytes the least-hashed 24-byte string is its anchor.
   Equal windows have equal anchors at equal offsets, so only anchors, one for some 14
   positions, are live. A maximal run of windows of one anchor is an entry (rank of the
   anchor, rank of the run's whole string).
2. Entries are grouped by both ranks: a run that a smaller document also has is removed
   whole. Runs whose anchor's rank is unique are done: their windows are unique.
3. Length 50: the windows of the remaining runs (first of their kind, but with an anchor
   that other strings share) are ranked by the pair (rank of 32 bytes, rank of 32 bytes at
   offset 18), past the threshold, and grouped: a window that a smaller document also has
   is removed.

Blocks of documents ask for their distinct entries (see blocks.py), so a string that fills
the corpus is one entry a block. Ranks are 64-bit and wider hashes, used in pairs.

A null text is empty; a null id is larger than all others; rows of equal id do not remove
each other's text; very long texts are taken whole, in blocks of their own; other columns of
the input are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import MESSAGE, Block, answer, ask, batch, blocks, bucket_count, meet, packed, squeezed, unpacked, unsqueezed
from .common import U, RollingHash, chunks, mix, read, written

LENGTH, ANCHOR = 50, 24
RUNS, WINDOWS = 1, 2
MASK = U(2**56 - 1)
DUPLICATE, SHARED = 1, 2


class Runs:
    """Runs of windows with one anchor, of a stretch of whole documents."""

    def __init__(self, raw: np.ndarray, off: np.ndarray):
        n = len(raw) - LENGTH + 1
        self.hash = RollingHash(raw)
        z = np.zeros(0, np.int64)
        self.begin, self.end, self.anchor, self.string, self.row = z, z, z.astype(U), z.astype(U), z
        if n <= 0:
            return
        gram = self.hash.grams(ANCHOR)
        bits = U(len(gram).bit_length())
        place = np.arange(len(gram), dtype=U)
        least = (gram >> bits << bits) | place  # the leftmost wins a tie
        width = 1
        wide = LENGTH - ANCHOR + 1
        while 2 * width <= wide:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < wide:
            least = np.minimum(least[: len(least) - (wide - width)], least[wide - width :])
        at = (least & ((U(1) << bits) - U(1))).astype(np.int64)
        row = np.repeat(np.arange(len(off) - 1), np.diff(off))
        whole = row[:n] == row[LENGTH - 1 :]
        new = whole.copy()
        new[1:] &= ~whole[:-1] | (at[1:] != at[:-1]) | (row[1:n] != row[: n - 1])
        last = whole.copy()
        last[:-1] &= ~whole[1:] | (at[1:] != at[:-1]) | (row[1:n] != row[: n - 1])
        self.begin, self.end = np.flatnonzero(new), np.flatnonzero(last) + 1  # of windows
        self.row = row[self.begin]
        a = at[self.begin]
        self.anchor = gram[a] & MASK
        self.string = mix(self.hash.spans(self.begin, self.end + LENGTH - 1) + (a - self.begin).astype(U)) >> U(32)

    def windows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the windows of some runs: starts, and two ranks made of the pair of 32-byte ranks."""
        size = self.end[which] - self.begin[which]
        p = np.repeat(self.begin[which] - np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64), size) + np.arange(size.sum())
        one, two = self.hash.spans(p, p + 32), self.hash.spans(p + LENGTH - 32, p + LENGTH)
        return p, mix(one * U(0x9E3779B97F4A7C15) + two) & MASK, mix(two * U(0xC2B2AE3D27D4EB4F) + one) >> U(32)


class Entries:
    """Sorted distinct (first rank, second rank) of a block, each with the least place in the order of ids."""

    def __init__(self, first: np.ndarray, second: np.ndarray, place: np.ndarray, n: int):
        bucket = (mix(first) % U(n)).astype(np.int64)
        order = np.lexsort((place, second, first, bucket))
        f, s, b, p = first[order], second[order], bucket[order], place[order]
        new = np.ones(len(f), bool)
        new[1:] = (f[1:] != f[:-1]) | (s[1:] != s[:-1])
        self.first, self.second, self.bucket, self.place = f[new], s[new], b[new], p[new]
        self.of = np.zeros(len(f), np.int64)  # the entry of each asker
        self.of[order] = np.cumsum(new) - 1

    def messages(self, number: int, kind: int, n: int, ids: np.ndarray) -> list[tuple]:
        cut = np.searchsorted(self.bucket, np.arange(n + 1))
        out = []
        for b in range(n):
            x = slice(cut[b], cut[b + 1])
            if cut[b + 1] > cut[b]:
                used, place = np.unique(self.place[x], return_inverse=True)
                out.append((number, kind, b, packed(squeezed(self.first[x]), self.second[x].astype("<u4"), place.astype(np.uint16 if len(used) < 65536 else np.uint32), ids[used])))
        return out


def _reply(rows: list[tuple]) -> list[tuple]:
    """DUPLICATE if a smaller id has the entry too, SHARED if other entries have its first rank."""
    got = [(block, kind, bucket, *unpacked(data)) for block, kind, bucket, data in rows]
    first = np.concatenate([unsqueezed(x[3]) for x in got])
    second = np.concatenate([x[4] for x in got])
    ids = np.concatenate([x[6][x[5]] for x in got])
    order = np.lexsort((ids, second, first))
    f, s, i = first[order], second[order], ids[order]
    new = np.ones(len(f), bool)
    new[1:] = (f[1:] != f[:-1]) | (s[1:] != s[:-1])
    head = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    shared = np.zeros(len(head), bool)
    same = f[head][1:] == f[head][:-1]
    shared[1:] |= same
    shared[:-1] |= same
    flag = np.zeros(len(f), np.uint8)
    flag[order] = DUPLICATE * (i > i[head][group]) + SHARED * shared[group]
    cut = np.concatenate([[0], np.cumsum([len(x[4]) for x in got])])
    return [(x[0], x[1], x[2], packed(flag[cut[j] : cut[j + 1]])) for j, x in enumerate(got)]


class View:
    """A block's runs, and what answers make of them."""

    def __init__(self, block: Block, n: int):
        self.block, self.n = block, n
        self.ids, self.place = np.unique(block.ids, return_inverse=True)  # places follow the ids
        self.parts = [(at, to, Runs(block.raw[block.off[at] : block.off[to]], block.off[at : to + 1] - block.off[at])) for at, to in block.pieces()]
        join = lambda xs: np.concatenate(xs) if xs else np.zeros(0, np.int64)
        self.of = join([self.place[at + r.row] for at, _, r in self.parts]).astype(np.int64)
        self.entries = Entries(join([r.anchor for *_, r in self.parts]).astype(U), join([r.string for *_, r in self.parts]).astype(U), self.of, n)

    def judged(self, answers: dict) -> tuple[np.ndarray, np.ndarray]:
        """Of the runs: removed whole; windows to be looked at."""
        flag = self.told(answers, RUNS)[self.entries.of]
        gone = (flag & DUPLICATE > 0) | (self.of > self.entries.place[self.entries.of])
        return gone, ~gone & (flag & SHARED > 0)

    @staticmethod
    def told(answers: dict, kind: int) -> np.ndarray:
        parts = [unpacked(answers[kind][b])[0] for b in sorted(answers.get(kind, {}))]
        return np.concatenate(parts) if parts else np.zeros(0, np.uint8)

    def windows(self, look: np.ndarray):
        """Entries of the windows of the runs to look at; per part their starts and places."""
        at, starts, first, second, place = 0, [], [], [], []
        for _, _, r in self.parts:
            which = np.flatnonzero(look[at : at + len(r.begin)])
            p, a, b = r.windows(which)
            starts.append(p)
            first.append(a)
            second.append(b)
            place.append(np.repeat(self.of[at : at + len(r.begin)][which], (r.end - r.begin)[which]))
            at += len(r.begin)
        join = lambda xs: np.concatenate(xs) if xs else np.zeros(0, np.int64)
        return Entries(join(first).astype(U), join(second).astype(U), join(place).astype(np.int64), self.n), starts, join(place)


SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def repeated(docs: DataFrame) -> DataFrame:
    """One row per row of docs; see SCHEMA."""
    table = blocks(docs)
    n = bucket_count(table)

    def send(number: int, block: Block) -> list[tuple]:
        with np.errstate(over="ignore"):
            v = View(block, n)
            return v.entries.messages(number, RUNS, n, v.ids)

    runs = answer(ask(table, send), n, _reply)

    def send_windows(number: int, block: Block, answers: dict):
        with np.errstate(over="ignore"):
            v = View(block, n)
            entries, _, _ = v.windows(v.judged(answers)[1])
            yield batch(entries.messages(number, WINDOWS, n, v.ids))

    windows = answer(meet(table, runs, n, send_windows, MESSAGE), n, _reply)

    def finish(number: int, block: Block, answers: dict):
        with np.errstate(over="ignore"):
            v = View(block, n)
            gone, look = v.judged(answers)
            entries, starts, place = v.windows(look)
        flag = View.told(answers, WINDOWS)[entries.of]
        out = (flag & DUPLICATE > 0) | (place > entries.place[entries.of])
        removed, spans, digest = [], [], []
        at = seen = 0
        for (lo, hi, r), p in zip(v.parts, starts, strict=True):
            raw, off = block.raw[block.off[lo] : block.off[hi]], block.off[lo : hi + 1] - block.off[lo]
            step = np.zeros(len(raw) + 1, np.int32)
            whole = gone[at : at + len(r.begin)]
            hit = p[out[seen : seen + len(p)]]
            for a, b in ((r.begin[whole], r.end[whole] + LENGTH - 1), (hit, hit + LENGTH)):
                np.add.at(step, a, 1)
                np.add.at(step, b, -1)
            at, seen = at + len(r.begin), seen + len(p)
            cover = np.cumsum(step[:-1]) > 0
            head = cover.copy()
            head[1:] &= ~cover[:-1]
            inner = off[1:-1][off[1:-1] < len(raw)]
            head[inner] = cover[inner]
            sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[off])  # noqa: E731, B023
            removed.append(sums(cover))
            spans.append(sums(head))
            digest += [hashlib.sha256(raw[a:b][~cover[a:b]].tobytes()).hexdigest() for a, b in zip(off[:-1], off[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(block.ids, mask=block.missing.astype(bool)), pa.array(np.diff(block.off)), pa.array(np.concatenate(removed).astype(np.int64)), pa.array(np.concatenate(spans).astype(np.int64)), pa.array(digest)],
            [x.split()[0] for x in SCHEMA.split(", ")],
        )

    return meet(table, runs.union(windows), n, finish, SCHEMA)


def doubled(docs: DataFrame, first: int = 16) -> DataFrame:
    """The same rows by plain prefix doubling over every position: Spark sorts (rank, rank at an offset) of the live
    positions for lengths 16, 32 and 50, ranks them anew, and drops the unique ones.

    One round ships every live position several times, so this is for corpora whose repeats are wanted once and for
    checking the sampled path; README.md has the measured figures. Rows must differ in doc_id."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def start(batches):
        for rows, raw, off in chunks(batches, "text"):
            with np.errstate(over="ignore"):
                gram = RollingHash(raw).grams(first)
            row = np.repeat(np.arange(len(off) - 1), np.diff(off))[: len(gram)]
            place = np.arange(len(gram)) - off[row]
            inside = np.flatnonzero(place + first <= np.diff(off)[row])
            yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(row[inside])), pa.array(place[inside]), pa.array(gram[inside].astype(np.int64))], ["doc_id", "p", "r"])

    live = slim.mapInArrow(start, "doc_id long, p long, r long")
    length = first
    while True:
        # rank anew: positions of one rank in more than one document live on
        by = Window.partitionBy("r").orderBy("doc_id")
        ranked = live.withColumn("least", F.first("doc_id").over(by)).withColumn("most", F.last("doc_id").over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        live = written(ranked.where("least < most").select("doc_id", "p", "r", "least"), "live")
        if length == LENGTH:
            break
        step = min(length, LENGTH - length)
        later = live.select(F.col("doc_id").alias("d2"), (F.col("p") - step).alias("p2"), F.col("r").alias("r2"))
        live = live.join(later, (F.col("doc_id") == F.col("d2")) & (F.col("p") == F.col("p2"))).select("doc_id", "p", F.xxhash64("r", "r2").alias("r"))
        length += step
    gone = live.where("doc_id > least").select("doc_id", "p")
    spans = gone.groupBy("doc_id").agg(F.sort_array(F.collect_list("p")).alias("p"))  # of one document

    def cut(batches):
        for batch in batches:
            out = []
            for text, places in zip(batch.column(1), batch.column(2), strict=True):
                raw = np.frombuffer(text.as_py().encode(), np.uint8)
                step = np.zeros(len(raw) + 1, np.int64)
                at = np.array(places.as_py() or [], np.int64)
                np.add.at(step, at, 1)
                np.add.at(step, at + LENGTH, -1)
                cover = np.cumsum(step[:-1]) > 0
                runs = int((cover & ~np.concatenate([[False], cover[:-1]])).sum()) if len(raw) else 0
                out.append((len(raw), int(cover.sum()), runs, hashlib.sha256(raw[~cover].tobytes()).hexdigest()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[k] for x in out], pa.string() if k == 3 else pa.int64()) for k in range(4))], [x.split()[0] for x in SCHEMA.split(", ")])

    return slim.join(spans, "doc_id", "left").mapInArrow(cut, SCHEMA)


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return repeated(read(spark, sf_dir, "documents"))


QUERIES = {"op1_suffix_dedup": op1_suffix_dedup}
ORACLES: dict[str, str] = {}
