"""Language-model scoring by context-tree weighting over bytes.

Every byte is decomposed into eight binary decisions; each decision node has a context
tree over the bytes before it. A context's counts give a Krichevsky-Trofimov estimate; a
node's weighted probability is half its own estimate's and half the product of its
children's. Scoring mixes the estimates of all depths along the context path by the
posterior weights that the training texts give; a path ends at the deepest context seen in
training. Texts are lower-cased (A-Z); contexts start afresh, as zero bytes, in each text.

Depths: 0 to `depth` bytes one by one, for all contexts, and below them long contexts. A
string of ANCHOR bytes whose hash is 0 modulo SPARSE is an anchor; the long context of a
byte is the text from the start of the last whole anchor before it, ANCHOR bytes or more
and REACH more at most. Long contexts that the training texts hold twice or more are
children of their last `depth` bytes' context; what follows rarer ones, or no anchor, is
one more child, since a context seen once tells nothing that its parent does not. So words
and passages that recur anywhere in the training texts are learned at their own length, and
what the model holds grows with the corpus.

Rounds (see blocks.py): (a) blocks tell their anchors, and hear which occur twice; (b) for
these they tell the strings that follow, and hear how often each long context and byte
occur; (c) they tell their distinct (context, byte) strings of `depth` bytes, and words,
and hear probabilities. Short contexts are sharded by their two last bytes, anchors by their
hash; only the two top levels, at most 256 * 255 nodes, are merged and sent to all. Word
counts of the base score go with (c). No table is limited.

Null and empty texts score 0 bits and one end token; a null id is held out (its text form
is empty); repeated rows count each time; very long texts are scored whole; without training
texts every bit has probability one half, and a decision that a long context has not met has
it there; other columns of the input are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import MESSAGE, Block, answer, ask, batch, blocks, bucket_count, by_bucket, groups, meet, packed, squeezed, unpacked, unsqueezed
from .common import BYTE_CODE, LOWER, U, RollingHash, mix, powers, read, release, row_counts, words, written

DEPTH = 4
ANCHOR, SPARSE, REACH = 20, 32, 255
#: kinds of messages; LONG and SPLIT go from shards of anchors to shards of short contexts
WORDS, GRAMS, SEEN, STRINGS, LONG, SPLIT = 1, 2, 3, 4, 5, 6
LOG2 = math.log(2)
MASK = U(2**56 - 1)
#: passes over bytes go by stretches that stay in a core's cache
STEP = 1 << 15


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Of numbers from 0.5 on: Stirling's series after seven steps up."""
    shift = np.ones_like(x)
    for i in range(7):
        shift = shift * (x + i)
    z = x + 7
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - np.log(shift)


#: log_gamma of k + 0.5 and of k + 1 for the counts that nearly all nodes have
HALVES, WHOLES = log_gamma(np.arange(1 << 12) + 0.5), log_gamma(np.arange(1 << 12) + 1.0)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Of whole numbers."""
    both = zeros + ones
    large = both >= len(HALVES)
    z, o, b = (np.minimum(x, len(HALVES) - 1).astype(np.int64) for x in (zeros, ones, both))
    out = HALVES[z] + HALVES[o] - WHOLES[b]
    out[large] = log_gamma(zeros[large] + 0.5) + log_gamma(ones[large] + 0.5) - log_gamma(both[large] + 1.0)
    return out - math.log(math.pi)


def held_out(block: Block) -> np.ndarray:
    return np.array([zlib.crc32(b"" if m else str(i).encode()) % 10 == 0 for i, m in zip(block.ids.tolist(), block.missing, strict=True)], bool)


def gram_keys(raw: np.ndarray, off: np.ndarray, depth: int) -> np.ndarray:
    """For each byte: the byte before it, the one before that, ... (most significant first), and itself last."""
    n = len(raw)
    padded = np.concatenate([np.zeros(depth, np.uint8), raw, np.zeros(8, np.uint8)])
    window = np.ndarray(n, "<u8", padded, 0, (1,))  # the bytes from `depth` before each on
    key = np.empty(n, U)
    for at in range(0, n, STEP):
        part = window[at : at + STEP] << U(64 - 8 * depth)
        part >>= U(56 - 8 * depth)
        part |= raw[at : at + STEP]
        key[at : at + STEP] = part
    for place in range(depth):  # the first bytes of a row have only so many before them
        at = off[:-1] + place
        key[at[at < off[1:]]] &= U(255 | (1 << 8 * (depth + 1)) - (1 << 8 * (depth + 1 - place)))
    return key


def by_number(bucket: np.ndarray, n: int) -> np.ndarray:
    """Order by bucket, of n, ties as they are. Numbers of 16 bits are sorted by digits."""
    return np.argsort(bucket.astype(np.uint16) if n <= 1 << 16 else bucket, kind="stable")


def gram_bucket(key: np.ndarray, n: int, depth: int) -> np.ndarray:
    return (mix(key >> U(8 * (depth - 1))) % U(n)).astype(np.int64)


def distinct(key: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct numbers under 2**width, and which of them each number is. Number and place are sorted as one."""
    n = len(key)
    bits = max(1, n.bit_length())
    if not n or width + bits > 64:
        return np.unique(key, return_inverse=True)
    both = np.empty(n, U)
    for at in range(0, n, STEP):
        part = both[at : at + STEP]
        np.left_shift(key[at : at + STEP], U(bits), out=part)
        part |= np.arange(at, at + len(part), dtype=U)
    both.sort()
    which, kinds, last, n_kinds = np.empty(n, np.int32), [], None, 0
    for at in range(0, n, STEP):
        part = both[at : at + STEP]
        place = (part & U((1 << bits) - 1)).view(np.int64)
        part >>= U(bits)
        new = np.empty(len(part), bool)
        new[0] = part[0] != last
        np.not_equal(part[1:], part[:-1], out=new[1:])
        which[place] = np.cumsum(new, dtype=np.int32) + (n_kinds - 1)
        kinds.append(part[new])
        last, n_kinds = part[-1], n_kinds + len(kinds[-1])
    return np.concatenate(kinds), which


def tallied(key: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct numbers under 2**62, and how often each of them has flags 0, 1, 2 and 3. Numbers and flags are sorted as one."""
    both = key << U(2)
    both |= flags
    both.sort()
    new = np.flatnonzero(np.append(True, both[1:] != both[:-1])) if len(both) else np.zeros(0, np.int64)
    uses, both = np.diff(np.append(new, len(both))), both[new]
    flags, both = (both & U(3)).astype(np.int64), both >> U(2)
    first = np.append(True, both[1:] != both[:-1])[: len(both)]
    out = np.zeros((first.sum(), 4), np.int64)
    out[np.cumsum(first) - 1, flags] = uses
    return both[first], out


class Sums(RollingHash):
    """The same sums, made by stretches."""

    def __init__(self, raw: np.ndarray):
        n = len(raw)
        self.power, self.inverse = powers(n)
        self.prefix = np.zeros(n + 1, U)
        code = np.empty(min(n, STEP), U)
        for at in range(0, n, STEP):
            part = code[: n - at]
            np.take(BYTE_CODE, raw[at : at + STEP], out=part, mode="clip")
            part *= self.power[at : at + len(part)]
            part[:1] += self.prefix[at : at + 1]
            np.cumsum(part, out=self.prefix[at + 1 : at + 1 + len(part)])


class Anchors:
    """Anchors of a stretch of whole documents: hash, row, the bytes from begin to stop that they are the last anchor of,
    and the hash of anchor and bytes."""

    def __init__(self, raw: np.ndarray, off: np.ndarray, sums: RollingHash):
        places, grams = [np.zeros(0, np.int64)], [np.zeros(0, U)]
        for begin in range(0, len(raw) + 1 - ANCHOR, STEP):  # sums.grams(ANCHOR), of which few are kept
            stop = min(begin + STEP, len(raw) + 1 - ANCHOR)
            gram = sums.prefix[begin + ANCHOR : stop + ANCHOR] - sums.prefix[begin:stop]
            gram *= sums.inverse[begin:stop]
            gram += U(ANCHOR)
            gram = mix(gram)
            places.append(np.flatnonzero(gram & U(SPARSE - 1) == 0))
            grams.append(gram[places[-1]])
            places[-1] += begin
        at, gram = np.concatenate(places), np.concatenate(grams)
        row = np.searchsorted(off, at, "right") - 1
        inside = at + ANCHOR < off[row + 1]  # a byte at least comes after the anchor
        at, gram, self.row = at[inside], gram[inside], row[inside]
        self.begin = at + ANCHOR
        end = off[self.row + 1]
        later = np.append(self.begin[1:], len(raw) + ANCHOR)
        self.stop = np.minimum(np.minimum(later, end), self.begin + REACH)
        self.key = gram >> U(8)
        self.whole = sums.spans(at, self.stop)


class Strings:
    """What follows a block's repeated anchors: distinct strings ordered by bucket, anchor and hash, with training counts."""

    def __init__(self, parts: list[Anchors], seen: np.ndarray, train: list[np.ndarray], n: int):
        key = np.concatenate([p.key for p in parts]) if parts else np.zeros(0, U)
        whole = np.concatenate([p.whole for p in parts]) if parts else np.zeros(0, U)
        self.asks = seen  # of the anchors of all parts
        which = np.flatnonzero(seen)
        key, whole = key[which], whole[which]
        bucket = (mix(key) % U(n)).astype(np.int64)
        order = np.lexsort((whole, key, bucket))
        new = np.ones(len(order), bool)
        new[1:] = whole[order][1:] != whole[order][:-1]
        self.of = np.zeros(len(order), np.int64)
        self.of[order] = np.cumsum(new) - 1
        first = order[new]
        self.key, self.bucket, self.first = key[first], bucket[first], which[first]
        weight = np.concatenate(train) if train else np.zeros(0)
        self.count = np.bincount(self.of, weight[which], len(first)).astype(np.uint32)


class Long:
    """A block's anchors and strings, as far as the rounds have come; and its words, if `worded`."""

    def __init__(self, block: Block, train: np.ndarray, n: int, worded: bool = False):
        self.block, self.n = block, n
        self.parts, self.raws, self.train, self.words = [], [], [], []
        for at, to in block.pieces():
            raw, off = np.frombuffer(block.raw[block.off[at] : block.off[to]].tobytes().translate(LOWER.tobytes()), np.uint8), block.off[at : to + 1] - block.off[at]
            sums = Sums(raw)
            part = Anchors(raw, off, sums)
            if worded:
                start, stop, row = words(raw, off)
                self.words.append((row, *(np.unique(sums.spans(start, stop) & MASK, return_inverse=True) if len(start) else (np.zeros(0, U), np.zeros(0, np.int64)))))
            self.parts.append(part)
            self.raws.append(raw)
            self.train.append(train[at:to][part.row].astype(float))
        key = np.concatenate([p.key for p in self.parts]) if self.parts else np.zeros(0, U)
        kind, which = np.unique(key, return_inverse=True)
        bucket = (mix(kind) % U(n)).astype(np.int64)
        order = by_number(bucket, n)
        place = np.zeros(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.kind, self.bucket, self.which = kind[order], bucket[order], place[which]
        weight = np.concatenate(self.train) if self.train else np.zeros(0)
        self.count = np.bincount(self.which, weight, len(kind)).astype(np.uint32)

    def anchors(self, number: int) -> list[tuple]:
        cut = np.searchsorted(self.bucket, np.arange(self.n + 1))
        return [(number, SEEN, b, packed(squeezed(self.kind[cut[b] : cut[b + 1]]), self.count[cut[b] : cut[b + 1]])) for b in range(self.n) if cut[b + 1] > cut[b]]

    def strings(self, by: dict) -> Strings:
        seen = np.concatenate([unpacked(by[SEEN][b])[0] for b in sorted(by[SEEN])]) if by.get(SEEN) else np.zeros(len(self.kind), np.uint8)
        return Strings(self.parts, seen[self.which].astype(bool), self.train, self.n)

    def asked(self, number: int, s: Strings, depth: int) -> list[tuple]:
        """The strings, each with the last `depth` bytes of its anchor before it."""
        cut = np.searchsorted(s.bucket, np.arange(self.n + 1))
        edge = np.concatenate([[0], np.cumsum([len(p.key) for p in self.parts])])
        part = np.searchsorted(edge, s.first, "right") - 1
        size, texts = np.zeros(len(s.first), np.int64), np.empty(len(s.first), object)
        for k, p in enumerate(self.parts):
            mine = np.flatnonzero(part == k)
            own = s.first[mine] - edge[k]
            size[mine] = p.stop[own] - p.begin[own]
            raw = self.raws[k].tobytes()
            texts[mine] = [raw[a - depth : b] for a, b in zip(p.begin[own], p.stop[own], strict=True)]
        out = []
        for b in range(self.n):
            x = slice(cut[b], cut[b + 1])
            if cut[b + 1] > cut[b]:
                out.append((number, STRINGS, b, packed(squeezed(s.key[x]), s.count[x], size[x].astype(np.uint8), np.frombuffer(b"".join(texts[x]), np.uint8))))
        return out

    def met(self, by: dict, s: Strings):
        """For each part: place and what is known of its bytes with a long context; uses, and rows of the eight estimates (or -1)."""
        length, uses, splits = [], [], []
        for b in sorted(by.get(STRINGS, {})):
            one, n, est = unpacked(by[STRINGS][b])
            length.append(one)
            uses.append(n)
            splits.append(est)
        length = np.concatenate(length).astype(np.int64) if length else np.zeros(0, np.int64)
        uses = np.concatenate(uses) if uses else np.zeros(0, np.uint32)
        splits = np.concatenate(splits).reshape(-1, 8) if splits else np.zeros((0, 8), np.float32)
        start = np.concatenate([[0], np.cumsum(length)])
        row = np.cumsum(uses == 0) - 1
        row[uses > 0] = -1
        edge = np.concatenate([[0], np.cumsum([len(p.key) for p in self.parts])])
        of = np.full(edge[-1], -1)
        of[s.asks] = s.of
        out = []
        for k, p in enumerate(self.parts):
            e = of[edge[k] : edge[k + 1]]
            own = np.flatnonzero(e >= 0)
            n = length[e[own]]
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at = np.repeat(start[e[own]], n) + step
            out.append((np.repeat(p.begin[own], n) + step, uses[at], row[at]))
        return out, splits


def reply_seen(rows: list[tuple]) -> list[tuple]:
    """Which of the asked anchors the training texts hold twice or more."""
    bucket = rows[0][2]
    asked, _, total = _merged(rows, SEEN)
    return [(block, SEEN, bucket, packed((total[which] > 1).astype(np.uint8))) for block, which in asked]


def reply_strings(rows: list[tuple], n: int, depth: int, most: int = 400_000) -> list[tuple]:
    """For each asked string: how many of its bytes, from the first on, have a long context that occurs twice; of each such
    byte, how often the context occurs if this byte always follows it, else 0 and the eight estimates of its own decisions.
    For the shards of short contexts: sums of the log estimates of all long contexts, by short context and byte where one
    byte always follows (LONG), by decision elsewhere (SPLIT). Anchors are taken some at a time, `most` bytes or one anchor."""
    bucket = rows[0][2]
    got = [(block, *unpacked(data)) for block, _, _, data in rows]
    key = np.concatenate([unsqueezed(x[1]) for x in got])
    count, size = (np.concatenate([x[k] for x in got]).astype(np.int64) for k in (2, 3))
    text = np.concatenate([x[4] for x in got])
    begin = np.cumsum(size + depth) - size  # of the strings proper, in text
    sums = Sums(text)
    order = np.argsort(key, kind="stable")
    load = np.cumsum(size[order])
    new = np.flatnonzero(np.append(key[order][1:] != key[order][:-1], True)) + 1  # where anchors end
    length, held_from, loose_from, loose_count = (np.zeros(len(key), np.int64) for _ in range(4))
    uses, estimates, long, split = [np.zeros(0, np.uint32)], [np.zeros((0, 8), np.float32)], [], []
    at = n_held = n_loose = 0
    while at < len(order):
        to = int(np.searchsorted(load, (load[at - 1] if at else 0) + most, "right"))
        to = int(new[np.searchsorted(new, max(to, at + 1))])
        e = order[at:to]
        at = to
        one = contexts(sums, text, key[e], count[e], size[e], begin[e], depth)
        length[e], loose_count[e] = one[0], one[3]
        held_from[e], loose_from[e] = n_held + np.cumsum(one[0]) - one[0], n_loose + np.cumsum(one[3]) - one[3]
        n_held, n_loose = n_held + len(one[1]), n_loose + len(one[2])
        uses.append(one[1])
        estimates.append(one[2])
        long.append(one[4])
        split.append(one[5])
    uses, estimates = np.concatenate(uses), np.concatenate(estimates)
    out = []
    for tag, parts in ((LONG, long), (SPLIT, split)):
        k, where = distinct(np.concatenate([np.zeros(0, U), *[x[0] for x in parts]]), 8 * (depth + 1))
        v = np.bincount(where, np.concatenate([np.zeros(0), *[x[1] for x in parts]]), len(k)) if len(k) else np.zeros(0)
        to = gram_bucket(k, n, depth)
        o = by_number(to, n)
        cut = np.searchsorted(to[o], np.arange(n + 1))
        out += [(-2, tag, b, packed(squeezed(k[o[cut[b] : cut[b + 1]]]), v[o[cut[b] : cut[b + 1]]].astype(np.float32))) for b in range(n) if cut[b + 1] > cut[b]]
    edge = np.concatenate([[0], np.cumsum([len(x[3]) for x in got])])
    for j, x in enumerate(got):
        mine = slice(edge[j], edge[j + 1])
        out.append((x[0], STRINGS, bucket, packed(length[mine].astype(np.uint8), uses[_ranges(held_from[mine], length[mine])], estimates[_ranges(loose_from[mine], loose_count[mine])].ravel())))
    return out


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers of ranges, one after another."""
    return np.repeat(start - (np.cumsum(length) - length), length) + np.arange(length.sum())


def contexts(sums: RollingHash, text: np.ndarray, key: np.ndarray, count: np.ndarray, size: np.ndarray, begin: np.ndarray, depth: int) -> tuple:
    """Of strings after whole anchors: bytes in contexts that occur twice; for each such byte the context's uses if it always
    follows, else 0; estimates of the others' decisions, and how many of them each string has; (keys, sums) of LONG and of SPLIT."""
    at = _ranges(begin, size)
    context = mix(sums.spans(np.repeat(begin, size), at) + np.repeat(key, size) * U(0x9E3779B97F4A7C15))
    order = np.argsort(context)
    context = context[order]
    new = np.append(True, context[1:] != context[:-1])[: len(context)]
    kind, first, which = context[new], order[new], np.empty(len(order), np.int64)  # first: any place of the context
    which[order] = np.cumsum(new) - 1
    weight = np.repeat(count, size).astype(float)
    total = np.bincount(which, weight, len(kind))
    twice = total > 1
    byte = text[at].astype(np.int64)
    pair, pwhich = distinct((which << 8 | byte).astype(U), len(kind).bit_length() + 8)
    pair = pair.astype(np.int64)
    met = np.bincount(pwhich, weight, len(pair))
    followers = np.bincount(pair[met > 0] >> 8, minlength=len(kind))
    alone = twice & (followers == 1)
    always = alone[which] & (met[pwhich] > 0)
    held = twice[which]  # contexts of a string grow, so this holds for its first bytes only
    string = np.repeat(np.arange(len(size)), size)
    length = np.bincount(string[held], minlength=len(size))
    uses = np.where(always, total[which], 0).astype(np.uint32)[held]
    # the eight decisions of bytes in contexts that split, and of bytes that a context has not met
    loose = np.flatnonzero(held & ~always)
    c, v = which[loose], byte[loose]
    est = np.full((len(loose), 8), 0.5, np.float32)
    short = np.zeros(len(kind), U)
    for back in range(1, depth + 1):
        short = short << U(8) | text[at[first] - back].astype(U)
    sole = _sole(pair, met, len(kind))
    keys, logs = [], []
    mine = np.flatnonzero((twice & (followers > 1))[pair >> 8] & (met > 0))
    mine, mine_met = pair[mine], met[mine]
    for bit in range(8):
        node = mine >> 8 << 8 | 1 << bit | (mine & 255) >> (8 - bit)  # in order, as the pairs are
        begins = np.flatnonzero(np.append(True, node[1:] != node[:-1])[: len(node)])
        names, one = node[begins], (mine >> (7 - bit)) & 1
        ones, zeros = (np.add.reduceat(mine_met * x, begins) if len(begins) else np.zeros(0) for x in (one, 1 - one))
        keys.append(short[names >> 8] << U(8) | (names & 255).astype(U))
        logs.append(log_kt(zeros, ones))
        # a loose byte finds its node if its context splits; else it goes with its context's one byte as far as that goes
        bit_one = (v >> (7 - bit)) & 1 > 0
        if len(names):
            want = c << 8 | 1 << bit | v >> (8 - bit)
            spot = np.minimum(np.searchsorted(names, want), len(names) - 1)
            hit = names[spot] == want
            est[hit, bit] = ((np.where(bit_one, ones[spot], zeros[spot]) + 0.5) / (ones[spot] + zeros[spot] + 1))[hit]
        along = alone[c] & (sole[c] >> (8 - bit) == v >> (8 - bit))
        same = ((sole[c] >> (7 - bit)) & 1 > 0) == bit_one
        est[along, bit] = ((np.where(same, total[c], 0) + 0.5) / (total[c] + 1))[along]
    steady = np.flatnonzero(alone)
    name = short[steady] << U(8) | sole[steady].astype(U)
    return length, uses, est, np.bincount(string[loose], minlength=len(size)), (name, log_kt(np.zeros(len(steady)), total[steady])), (np.concatenate(keys), np.concatenate(logs))


def _sole(pair: np.ndarray, uses: np.ndarray, n: int) -> np.ndarray:
    """The byte that follows each context, where there is one only."""
    out = np.zeros(n, np.int64)
    met = uses > 0
    out[pair[met] // 256] = pair[met] % 256
    return out


class Grams:
    """A block's distinct words and short contexts with bytes, each ordered by bucket and key, and their training counts;
    or, if `placed`, in place of counts where its pieces have them. `long` knows the block's words."""

    def __init__(self, block: Block, train: np.ndarray, n: int, depth: int, long: Long, met: list, placed: bool):
        self.pieces, word_parts, gram_parts, found = [], [], [], []
        for k, (at, to) in enumerate(block.pieces()):
            raw, off, place = long.raws[k], block.off[at : to + 1] - block.off[at], met[k][0]
            row, kind, which = long.words[k]
            key = gram_keys(raw, off, depth)
            if placed:
                gkind, gwhich = distinct(key, 8 * (depth + 1))
                deep = np.zeros(len(gkind), bool)
                deep[gwhich[place]] = True
                word_parts.append((kind,))
                gram_parts.append((gkind, deep))
                found.append((at, to, off, row, which, gwhich, place))
            else:
                flags = np.repeat(train[at:to].astype(np.uint8) * np.uint8(2), np.diff(off))
                flags[place] += np.uint8(1)
                gkind, uses = tallied(key, flags)
                word_parts.append((kind, np.bincount(which, train[at:to][row], len(kind)).astype(np.int64)))
                gram_parts.append((gkind, uses[:, 1] + uses[:, 3], uses[:, 3], uses[:, 2] + uses[:, 3]))
        self.word, word_spots, *counts = _summed(word_parts, 56, 0 if placed else 1)
        self.gram, gram_spots, deep, *gram_counts = _summed(gram_parts, 8 * (depth + 1), 1 if placed else 3)
        self.deep = deep > 0
        if placed:
            self.pieces = [(*x, w, g) for x, w, g in zip(found, word_spots, gram_spots, strict=True)]
        else:
            (self.word_count,), (self.under, self.every) = counts, gram_counts
        with np.errstate(over="ignore"):
            self.word_bucket, self.gram_bucket = (mix(self.word) % U(n)).astype(np.int64), gram_bucket(self.gram, n, depth)
        self.word_order, self.gram_order = by_number(self.word_bucket, n), by_number(self.gram_bucket, n)

    def asked(self, number: int, n: int) -> list[tuple]:
        out = []
        o = self.word_order
        cut = np.searchsorted(self.word_bucket[o], np.arange(n + 1))
        out += [(number, WORDS, b, packed(squeezed(self.word[x]), self.word_count[x].astype(np.uint32))) for b in range(n) if len(x := o[cut[b] : cut[b + 1]])]
        o = self.gram_order
        cut = np.searchsorted(self.gram_bucket[o], np.arange(n + 1))
        out += [(number, GRAMS, b, packed(squeezed(self.gram[x]), self.every[x].astype(np.uint32), self.under[x].astype(np.uint32), self.deep[x].astype(np.uint8))) for b in range(n) if len(x := o[cut[b] : cut[b + 1]])]
        return out


def _summed(parts: list[tuple], width: int, columns: int) -> tuple:
    """Sorted distinct keys under 2**width of several such lists, where each list's are among them, and the lists' columns summed."""
    key = np.concatenate([np.zeros(0, U), *[p[0] for p in parts]])
    kind, which = distinct(key, width)
    cut = np.cumsum([0, *[len(p[0]) for p in parts]])
    return kind, [which[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)], *[np.bincount(which, np.concatenate([np.zeros(0), *[p[k + 1] for p in parts]]), len(kind)).astype(np.int64) for k in range(columns)]


def _merged(rows: list[tuple], kind: int, columns: int = 1):
    """Keys and total counts of a bucket's messages of a kind, and where each message's keys are."""
    got = [(block, *unpacked(data)) for block, k, _, data in rows if k == kind]
    keys = [unsqueezed(x[1]) for x in got]
    kinds, which = np.unique(np.concatenate(keys), return_inverse=True) if keys else (np.zeros(0, U), np.zeros(0, np.int64))
    totals = [np.bincount(which, np.concatenate([x[2 + c] for x in got]), len(kinds)) if keys else np.zeros(0) for c in range(columns)]
    cut = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int64)
    return [(x[0], which[cut[i] : cut[i + 1]], *x[2 + columns :]) for i, x in enumerate(got)], kinds, *totals


class Shard:
    """Levels 2 to `depth` of the context trees whose last two bytes fall into a bucket, and what lies below them."""

    def __init__(self, rows: list[tuple], depth: int):
        self.asked, self.key, self.count, deep = _merged(rows, GRAMS, 2)
        self.depth, self.rest = depth, self.count - deep
        _, name, sums = _merged(rows, LONG)
        self.long = np.zeros(len(self.key))
        if len(name):
            self.long[np.searchsorted(self.key, name)] = sums
        _, self.split_key, self.split_sum = _merged(rows, SPLIT)

    def level(self, bit: int, depth: int):
        """Nodes of one binary decision at one depth: index of each key's node, zeros, ones, a key of each node."""
        byte = self.key & U(255)
        node = (self.key >> U(8 * (self.depth + 1 - depth))) << U(8) | (U(1) << U(bit)) | byte >> U(8 - bit)
        names, first, which = np.unique(node, return_index=True, return_inverse=True)
        one = ((byte >> U(7 - bit)) & U(1)).astype(float)
        return which, np.bincount(which, self.count * (1 - one)), np.bincount(which, self.count * one), first, one, names

    def levels(self, bit: int):
        """Levels `depth` down to 2, each with log estimates and weighted probabilities; and zeros and ones of what no long context holds."""
        out, below = {}, None
        for depth in range(self.depth, 1, -1):
            which, zeros, ones, first, one, names = self.level(bit, depth)
            own = log_kt(zeros, ones)
            if below is None:
                z, o = np.bincount(which, self.rest * (1 - one)), np.bincount(which, self.rest * one)
                children = np.where(z + o > 0, log_kt(z, o), 0) + np.bincount(which, self.long)
                spot = np.searchsorted(names, self.split_key)
                mine = np.flatnonzero(self.split_key & U(255) >= U(1 << bit))
                mine = mine[(self.split_key[mine] & U(255)) < U(2 << bit)]
                np.add.at(children, spot[mine], self.split_sum[mine])
                out["rest"] = z, o
            else:
                children = np.bincount(which[below[3]], below[6], len(own))
            weighted = np.logaddexp(own, children) - LOG2
            out[depth] = below = (which, zeros, ones, first, one, own, weighted)
        return out

    def tops(self) -> np.ndarray:
        """last byte, node, zeros, ones, sum of the weighted log probabilities of its depth-2 contexts."""
        parts = []
        for bit in range(8):
            _, zeros, ones, first, _, _, weighted = self.levels(bit)[2]
            last = (self.key[first] >> U(8 * self.depth)).astype(np.int64)
            node = (U(1) << U(bit) | (self.key[first] & U(255)) >> U(8 - bit)).astype(np.int64)
            kind, which = np.unique(last * 256 + node, return_inverse=True)
            parts.append(np.column_stack([kind, np.bincount(which, zeros), np.bincount(which, ones), np.bincount(which, weighted)]))
        return np.concatenate(parts)

    def told(self, top: Top) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each key's byte: log10 probability without a long context; and for each of its decisions, what the contexts down
        to `depth` give, and the weight that is left for a long one."""
        total, given, left = np.zeros(len(self.key)), np.zeros((8, len(self.key))), np.zeros((8, len(self.key)))
        last = (self.key >> U(8 * self.depth)).astype(np.int64)
        for bit in range(8):
            levels = self.levels(bit)
            one = levels[self.depth][4] > 0
            node = (U(1) << U(bit) | (self.key & U(255)) >> U(8 - bit)).astype(np.int64)
            # estimate, stop weight and presence of each depth on the path
            path = [(top.estimate0[node], top.stop0[node], np.ones(len(last), bool)), (top.estimate1[last, node], top.stop1[last, node], top.seen1[last, node])]
            for depth in range(2, self.depth + 1):
                which, zeros, ones, _, _, own, weighted = levels[depth]
                path.append((((ones + 0.5) / (zeros + ones + 1))[which], np.exp(own - LOG2 - weighted)[which], (zeros + ones > 0)[which]))
            z, o = (x[levels[self.depth][0]] for x in levels["rest"])
            mass, p = np.ones(len(last)), np.zeros(len(last))
            for d, (estimate, stop, here) in enumerate(path):
                own = np.where(one, estimate, 1 - estimate)
                deeper = path[d + 1][2] if d < self.depth else z + o > 0
                weight = np.minimum(stop, 1)
                if d == self.depth:  # a long context is a child whose node has been seen
                    given[bit] = p + mass * np.where(here, weight, 1.0) * own
                    left[bit] = mass * np.where(here, 1 - weight, 0.0)
                weight = np.where(deeper, weight, 1.0)
                p = p + mass * weight * own
                mass = mass * (1 - weight)
            rest = (o + 0.5) / (z + o + 1)
            p = p + mass * np.where(one, rest, 1 - rest)
            total += np.log10(p)
        return total, given, left


def shortened(given: np.ndarray, left: np.ndarray) -> np.ndarray:
    """What contexts give as half floats: itself under one half, else minus what is missing from one beside `left`, so that
    probabilities near 0 and near 1 both keep their three digits."""
    return np.where(given < 0.5, given, -np.maximum(1 - given - left, 0)).astype(np.float16)


class Mixed:
    """Log10 probabilities of bytes in long contexts, from what short contexts give their eight decisions (see shortened) and
    the weights left: two tables, a row a decision."""

    def __init__(self, code: np.ndarray, left: np.ndarray):
        code, self.left = code.astype(np.float32), left.astype(np.float32)
        self.given = np.where(np.signbit(code), 1 - self.left.astype(float) + code, code)

    def log10(self, gram: np.ndarray, uses: np.ndarray, row: np.ndarray, splits: np.ndarray) -> np.ndarray:
        """Of each byte's gram; a long context gives all eight decisions one estimate by its uses, or those of a row of
        `splits` (-1: none)."""
        out = np.ones(len(gram))
        for at in range(0, len(gram), STEP):
            x = slice(at, at + STEP)
            own, product, estimate = gram[x], out[x], (uses[x] + 0.5) / (uses[x] + 1.0)
            loose = np.flatnonzero(row[x] >= 0)
            loose_rows = splits[row[x][loose]]
            for bit in range(8):  # all eight together: at least 10**-80 or so
                estimate[loose] = loose_rows[:, bit]
                p = self.left[bit][own] * estimate
                p += self.given[bit][own]
                product *= p
        return np.log10(out, out=out)


class Top:
    """Depths 0 and 1 of all trees: at most 256 * 255 nodes."""

    def __init__(self, rows: np.ndarray):
        zeros, ones, children = (np.zeros((256, 256)) for _ in range(3))
        at = rows[:, 0].astype(np.int64)
        for table, column in ((zeros, 1), (ones, 2), (children, 3)):
            np.add.at(table.reshape(-1), at, rows[:, column])
        own = log_kt(zeros, ones)
        weighted = np.logaddexp(own, children) - LOG2
        self.seen1 = zeros + ones > 0
        self.estimate1, self.stop1 = (ones + 0.5) / (zeros + ones + 1), np.exp(own - LOG2 - weighted)
        z0, o0 = zeros.sum(0), ones.sum(0)
        own0 = log_kt(z0, o0)
        self.estimate0, self.stop0 = (o0 + 0.5) / (z0 + o0 + 1), np.exp(own0 - LOG2 - (np.logaddexp(own0, np.where(self.seen1, weighted, 0).sum(0)) - LOG2))


SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"


def score(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """One row per row of docs; see SCHEMA. depth: of the short contexts, 2 to 6 bytes."""
    if not 2 <= depth <= 6:
        raise ValueError("depth lies within 2 and 6")
    table = blocks(docs)
    n = bucket_count(table)

    def send_anchors(number: int, block: Block) -> list[tuple]:
        with np.errstate(over="ignore"):
            return Long(block, ~held_out(block), n).anchors(number)

    seen = answer(ask(table, send_anchors), n, reply_seen)

    def send_strings(number: int, block: Block, by: dict):
        with np.errstate(over="ignore"):
            long = Long(block, ~held_out(block), n)
            yield batch(long.asked(number, long.strings(by), depth))

    def strings_told(rows: list[tuple]) -> list[tuple]:
        with np.errstate(over="ignore"):
            return reply_strings(rows, n, depth)

    known = seen.union(answer(meet(table, seen, n, send_strings, MESSAGE), n, strings_told))

    def so_far(block: Block, by: dict, placed: bool):
        train = ~held_out(block)
        with np.errstate(over="ignore"):
            long = Long(block, train, n, True)
            met, splits = long.met(by, long.strings(by))
            return Grams(block, train, n, depth, long, met, placed), met, splits

    def send_grams(number: int, block: Block, by: dict):
        yield batch(so_far(block, by, False)[0].asked(number, n))

    asked = written(meet(table, known, n, send_grams, MESSAGE), "asked").union(known.where("block = -2"))
    release(docs.sparkSession)

    def tops(batches):
        for rows in groups(batches, 2):
            t = Shard(rows, depth).tops()
            yield pa.RecordBatch.from_arrays([pa.array(t[:, 0].astype(np.int64)), *(pa.array(t[:, c]) for c in (1, 2, 3))], ["node", "zeros", "ones", "weighted"])

    grams = by_bucket(asked.where(f"kind <> {WORDS}"), n)
    top_rows = grams.mapInArrow(tops, "node long, zeros double, ones double, weighted double").groupBy("node").agg(F.sum("zeros").alias("z"), F.sum("ones").alias("o"), F.sum("weighted").alias("w")).orderBy("node").toPandas()
    top = docs.sparkSession.sparkContext.broadcast(Top(top_rows.to_numpy(float).reshape(-1, 4)))
    release(docs.sparkSession)

    def reply(rows: list[tuple]) -> list[tuple]:
        bucket, out = rows[0][2], []
        asked_w, key, count = _merged(rows, WORDS)
        out += [(block, WORDS, bucket, packed(count[which].astype(np.int64))) for block, which in asked_w]
        # block -1: the bucket's own numbers of distinct training words and of their uses
        out.append((-1, WORDS, bucket, packed(np.array([(count > 0).sum(), count.sum()], np.int64))))
        shard = Shard(rows, depth)
        if len(shard.key):
            p, given, left = shard.told(top.value)
            for block, which, deep in shard.asked:
                mine = which[deep > 0]
                out.append((block, GRAMS, bucket, packed(p[which].astype(np.float32), shortened(given[:, mine], left[:, mine]).ravel(), left[:, mine].astype(np.float16).ravel())))
        return out

    # both kinds of a bucket in one task
    answers = answer(asked, n, reply)

    def summary(batches):
        for b in batches:
            for data in b.column("data"):
                v, c = unpacked(data.as_py())[0]
                yield pa.RecordBatch.from_arrays([pa.array([int(v)]), pa.array([int(c)])], ["v", "c"])

    sums = answers.where("block = -1").mapInArrow(summary, "v long, c long").agg(F.sum("v"), F.sum("c")).first()
    ends = docs.where(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 10 != 0).count()
    total, kinds = int(sums[1] or 0) + ends, int(sums[0] or 0) + (ends > 0)
    floor = total + 0.1 * (kinds + 1)

    def finish(number: int, block: Block, by: dict):
        out_of = held_out(block)
        g, met, splits = so_far(block, by, True)
        told = [unpacked(by[WORDS][b])[0] for b in sorted(by.get(WORDS, {}))]
        wc = np.zeros(len(g.word), np.int64)
        wc[g.word_order] = np.concatenate(told) if told else np.zeros(0, np.int64)
        told = [unpacked(by[GRAMS][b]) for b in sorted(by.get(GRAMS, {}))]
        gp = np.zeros(len(g.gram))
        gp[g.gram_order] = np.concatenate([t[0] for t in told]) if told else np.zeros(0)
        deep_order = g.gram_order[g.deep[g.gram_order]]
        deep_spot = np.zeros(len(g.gram), np.int32)
        deep_spot[deep_order] = np.arange(len(deep_order))
        mixed = Mixed(*(np.concatenate([t[k].reshape(8, -1) for t in told], axis=1) if told else np.zeros((8, 0), np.float16) for k in (1, 2)))
        word_log = np.log10((wc + 0.1) / floor)
        size = len(block.ids)
        n_words, known_words, base, log10 = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size), np.zeros(size)
        for (at, to, off, row, which, gwhich, place, word_spot, gram_spot), (_, uses, split) in zip(g.pieces, met, strict=True):
            if len(which):
                n_words[at:to] = row_counts(row, to - at)
                known_words[at:to] = np.bincount(row[(wc > 0)[word_spot][which]], minlength=to - at)
                base[at:to] = np.bincount(row, word_log[word_spot][which], to - at)
            if len(gwhich):
                p = gp[gram_spot][gwhich]
                p[place] = mixed.log10(deep_spot[gram_spot][gwhich[place]], uses, split, splits)
                full = np.flatnonzero(np.diff(off))
                log10[at + full] = np.add.reduceat(p, off[full])
        base += math.log10((ends + 0.1) / floor)
        length = np.diff(block.off)
        ids = pa.array(block.ids, mask=block.missing.astype(bool))
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(out_of), pa.array(n_words + 1), pa.array(known_words + (ends > 0)), pa.array(np.full(size, total)), pa.array(base), pa.array(log10), pa.array(-log10 / math.log10(2) / np.maximum(length, 1))],
            [x.split()[0] for x in SCHEMA.split(", ")],
        )

    return meet(table, known.union(answers), n, finish, SCHEMA)


def op9_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score(read(spark, sf_dir, "documents"))


QUERIES = {"op9_context_tree": op9_lm_scoring}
ORACLES: dict[str, str] = {}
