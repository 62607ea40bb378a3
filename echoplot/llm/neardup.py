"""Near-duplicate groups by b-bit MinHash.

1. Each document's distinct word shingles give `bands * rows` minima. Documents of equal
   sets are one class; only classes go on.
2. Classes that agree in all rows of a band are candidates. Of the minima only the low
   `bits` are kept, packed; inside a bucket, similarity is estimated by counting equal
   b-bit values and correcting for chance agreement.
3. A bucket never emits all its pairs: it emits a forest over the pairs whose estimate
   is not clearly under the threshold. The forests' components are clusters; every
   candidate pair lies inside one.
4. A cluster's full shingle sets are shipped once, in blocks of bounded size, and pairs
   are confirmed there on full sets: best estimates first, and only while both sides are
   in different components. In clusters of several blocks, the first members of the
   blocks' components meet, and what then stays outside the largest component meets every
   block. So every candidate pair is in one component, refused
   on full sets, or clearly under the threshold, and no pairs are shipped.

At 0.8 a pair misses all 32 bands of 4 rows with probability 5e-8, and the estimate of a
pair at 0.8 is under the cut with about 1e-7.

Rows that repeat an id are one document: its texts' classes, each with an id of its own until
then, are tied at the end. one_of_each judges each text by itself. A row without an id has no links and is its own
group; documents without words have an empty set and no links; very long texts are
processed whole. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, U, RollingHash, chunks, mix, read, shingles, words, written
from .components import components

BANDS, ROWS, BITS = 32, 4, 2
#: estimates this far under the threshold are taken as no link: five deviations at 128 minima
MARGIN = 0.22


def _minima_keys() -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=U) * U(0xD1B54A32D192ED03)) | U(1)


def signature(sets: np.ndarray) -> np.ndarray:
    """The minima of one set under BANDS * ROWS multiply-shift permutations."""
    keys = _minima_keys()
    k = BANDS * ROWS
    least = np.full(k, np.uint32(0xFFFFFFFF), np.uint32)
    for at in range(0, len(sets), 512):
        part = sets[at : at + 512]
        least = np.minimum(least, ((part[None, :] * keys[:k, None] + keys[k:, None]) >> U(32)).astype(np.uint32).min(1))
    return least


def packed(minima: np.ndarray) -> np.ndarray:
    """Low BITS of each of the last axis, packed."""
    low = (minima[..., None] >> np.arange(BITS, dtype=np.uint32)) & 1
    return np.packbits(low.reshape(*minima.shape[:-1], -1).astype(np.uint8), axis=-1)


def estimate(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Similarity by agreeing b-bit values, corrected for agreement by chance."""
    x = many ^ one
    same = BANDS * ROWS - sum(np.bitwise_count((x >> s | x >> (s + 1)) & 1) for s in range(0, 8, BITS)).astype(np.int64).sum(-1)
    chance = 1 / 2**BITS
    return (same / (BANDS * ROWS) - chance) / (1 - chance)


def sets_of(raw: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a chunk's texts, and n + 1 offsets."""
    n = len(off) - 1
    low = LOWER[raw]
    start, stop, row = words(low, off)
    h, at = shingles(RollingHash(low).spans(start, stop) if len(start) else np.zeros(0, U), row, n, k)
    return h, np.searchsorted(at, np.arange(n + 1))


SIGNED = "doc_id long, t long, n_shingles long, h1 long, h2 long, sig binary, bands array<long>"


def digests(h: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Two numbers for each set: its hash."""
    return np.array([np.frombuffer(hashlib.blake2b(h[cut[i] : cut[i + 1]].tobytes(), digest_size=16).digest(), np.int64) for i in range(len(cut) - 1)])


def signed(docs: DataFrame, k: int) -> DataFrame:
    """Text hash, set size, set hash, b-bit signature and band keys of each document."""

    def run(batches):
        for rows, raw, off in chunks(batches, "text"):
            with np.errstate(over="ignore"):
                h, cut = sets_of(raw, off, k)
                minima = np.stack([signature(h[cut[i] : cut[i + 1]]) for i in range(len(cut) - 1)])
                band = np.full((len(minima), BANDS), U(7))
                for r in range(ROWS):
                    band = mix(band * U(0x9E3779B97F4A7C15) + minima.reshape(-1, BANDS, ROWS)[:, :, r])
                band = mix(band + np.arange(BANDS, dtype=U))
            digest = digests(h, cut)
            sig = packed(minima)
            full = np.diff(cut) > 0
            keys = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(full * BANDS)]).astype(np.int32)), pa.array(band[full].astype(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array(np.diff(cut).astype(np.int64)), pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array([s.tobytes() for s in sig], pa.binary()), keys], ["doc_id", "t", "n_shingles", "h1", "h2", "sig", "bands"])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text", "xxhash64(text) as t").mapInArrow(run, SIGNED)


class _Forest:
    """Union by size: of[i] is the component of i; a join renames the smaller side, so n joins cost n log n."""

    def __init__(self, label: np.ndarray):
        kinds, self.of = np.unique(label, return_inverse=True)
        self.of = self.of.copy()
        order = np.argsort(self.of, kind="stable")
        self.size = np.bincount(self.of, minlength=len(kinds))
        self.members = dict(enumerate(np.split(order, np.cumsum(self.size)[:-1])))
        self.count = len(kinds)

    def join_all(self, i: int, others: np.ndarray) -> list[int]:
        """Joins i with each of others; those that were apart. Many at once cost one renaming."""
        kinds, first = np.unique(self.of[others], return_index=True)
        apart = kinds != self.of[i]
        kinds, first = kinds[apart], first[apart]
        if not len(kinds):
            return []
        a = int(self.of[i])
        most = int(kinds[self.size[kinds].argmax()])
        if self.size[most] > self.size[a]:
            kinds = np.append(kinds[kinds != most], a)
            a = most
        moved = np.concatenate([self.members.pop(int(k)) for k in kinds])
        self.of[moved] = a
        self.members[a] = np.concatenate([self.members[a], moved])
        self.size[a] += len(moved)
        self.size[kinds] = 0
        self.count -= len(kinds)
        return [int(x) for x in others[first]]

    def largest(self) -> int:
        return int(self.size.argmax())


def by_key(batches):
    """Tables of the rows of one key each; batches come sorted by their first column."""
    held, key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(0).to_numpy()
        cut = np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)]])
        for at, to in zip(cut[:-1], cut[1:], strict=True):
            if k[at] != key:
                if sum(p.num_rows for p in held) > 1:
                    yield pa.Table.from_batches(held)
                held, key = [], k[at]
            if to - at > 1 or held or to == len(k):  # a single row inside a batch pairs with nothing
                held.append(batch.slice(at, to - at))
    if sum(p.num_rows for p in held) > 1:
        yield pa.Table.from_batches(held)


def pair_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    p = np.array(pairs, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(p.min(1)), pa.array(p.max(1))], ["a", "b"])


def _signatures(t: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint8).reshape(t.num_rows, -1)


def bucket_forest(ids: np.ndarray, sig: np.ndarray, low: float) -> list[tuple[int, int]]:
    """A forest over the pairs of a bucket whose estimate reaches `low`."""
    forest, out, done = _Forest(ids), [], np.zeros(len(ids), bool)
    i = 0
    while True:
        done[i] = True
        other = np.flatnonzero(forest.of != forest.of[i])
        out += [(ids[i], ids[j]) for j in forest.join_all(i, other[estimate(sig[i], sig[other]) >= low])]
        rest = np.flatnonzero(~done & (forest.of != forest.largest()))  # each pair of trees has one outside the largest
        if forest.count == 1 or not len(rest):
            return out
        i = rest[0]


def clustered(classes: DataFrame, low: float, bucket: int = 20_000) -> DataFrame:
    """Forests of all buckets: pairs a < b. classes: id, sig, bands.

    A bucket of more than `bucket` members is dealt into blocks of about that many, and each two blocks meet
    in a task of their own, so a band that much of the corpus agrees in is neither one task nor held at once."""
    n = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    members = classes.select(F.explode("bands").alias("key"), "id", "sig")
    if classes.count() > bucket:
        size = classes.select(F.explode("bands").alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket)
        # at most bands * classes / bucket keys
        blocks = F.broadcast(size.select("k", F.ceil(F.col("n") / bucket).cast("int").alias("blocks")))
        told = members.join(blocks, F.col("key") == F.col("k"), "left")
        own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
        meets = F.when(F.col("k").isNull(), F.array("key")).otherwise(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.xxhash64("key", F.least(b, own), F.greatest(b, own))))
        members = told.select(F.explode(meets).alias("key"), "id", "sig")
    dealt = members.repartition(n, "key").sortWithinPartitions("key", "id")

    def run(batches):
        pairs = []
        for t in by_key(batches):
            pairs += bucket_forest(t["id"].to_numpy(), _signatures(t), low)
            if len(pairs) > 50_000:
                yield pair_batch(pairs)
                pairs = []
        yield pair_batch(pairs)

    return dealt.mapInArrow(run, "a long, b long").distinct()


def confirmed(ids: np.ndarray, sig: np.ndarray, sets: list[np.ndarray], comp: np.ndarray, first: np.ndarray, low: float, num: int, den: int) -> list[tuple[int, int]]:
    """Links on full sets that join components of a block. Every pair with `first` set on one side,
    in different components and with an estimate of `low` or more, is confirmed or refused,
    best estimates first, until both sides are one component."""
    size = np.array([len(x) for x in sets])
    at = np.concatenate([[0], np.cumsum(size)])
    flat = np.concatenate(sets)
    forest, out, done = _Forest(comp), [], np.zeros(len(ids), bool)
    for i in np.flatnonzero(first):
        done[i] = True
        other = np.flatnonzero((forest.of != forest.of[i]) & ~done)
        # sizes alone bound the similarity
        other = other[(den * np.minimum(size[other], size[i]) >= num * np.maximum(size[other], size[i]))]
        if not len(other):
            continue
        est = estimate(sig[i], sig[other])
        other = other[np.argsort(-est, kind="stable")[: int((est >= low).sum())]]
        step = 8
        while len(other):
            part, other = other[:step], other[step:]
            step = min(4 * step, 512)
            reach = np.repeat(at[part] - np.concatenate([[0], np.cumsum(size[part])[:-1]]), size[part]) + np.arange(size[part].sum())
            values = flat[reach]
            spot = np.minimum(np.searchsorted(sets[i], values), size[i] - 1)
            both = np.add.reduceat((sets[i][spot] == values).astype(np.int64), np.concatenate([[0], np.cumsum(size[part])[:-1]]))
            out += [(ids[i], ids[j]) for j in forest.join_all(i, part[den * both >= num * (size[part] + size[i] - both)])]
            other = other[forest.of[other] != forest.of[i]]
    return out


def _linked(rows: DataFrame, low: float, num: int, den: int) -> DataFrame:
    """Links found inside blocks. rows: key, id, sig, set, comp, first."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("key", "id", "sig", "set", "comp", "first").repartition(n, "key").sortWithinPartitions("key", "id")

    def run(batches):
        pairs = []
        for t in by_key(batches):
            sets = [np.frombuffer(x, U) for x in t["set"].to_pylist()]
            pairs += confirmed(t["id"].to_numpy(), _signatures(t), sets, t["comp"].to_numpy(), t["first"].to_numpy(zero_copy_only=False), low, num, den)
        yield pair_batch(pairs)

    return dealt.mapInArrow(run, "a long, b long")


def _classes(full: DataFrame) -> tuple[DataFrame, bool]:
    """h1, h2, rep (least doc_id of the set), n, sig, bands, id; and whether a rep has several sets.
    The id is the rep, or the set's hash where the rep stands for another set already."""
    classes = full.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    classes = written(classes, "classes")
    shared = classes.groupBy("rep").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("h1", "h2")).alias("one")).where("c > 1").select(F.col("rep").alias("__rep"), "one")
    if shared.isEmpty():
        return classes.withColumn("id", F.col("rep")), False
    own = F.col("__rep").isNull() | (F.struct("h1", "h2") == F.col("one"))
    classes = classes.join(shared, F.col("rep") == F.col("__rep"), "left").withColumn("id", F.when(own, F.col("rep")).otherwise(F.col("h1")))
    return written(classes.drop("__rep", "one"), "classes"), True


def _settled(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, block_bytes: int = 16 << 20) -> tuple[DataFrame, DataFrame, bool, DataFrame]:
    """Signed rows, classes, whether a rep has several classes, links (a, b) of class ids."""
    low = num / den - MARGIN
    every = written(signed(docs, k), "signed")
    classes, shared = _classes(every.where("n_shingles > 0 and doc_id is not null"))

    forest = written(clustered(classes, low), "forest")
    cluster = written(components(forest), "clusters").select(F.col("node").alias("id"), F.col("component").alias("cluster"))
    rows = classes.select("id", "rep", "h1", "h2", "n", "sig").join(cluster, "id")
    wanted = rows.select("rep")
    weight = rows.groupBy("cluster").agg(F.sum(F.col("n") * 8 + 100).alias("w")).select(F.col("cluster").alias("__c"), F.ceil(F.col("w") / block_bytes).cast("int").alias("blocks"))
    rows = rows.join(weight, F.col("cluster") == F.col("__c")).drop("__c").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = written(rows.join(_sets(docs, wanted, k), ["rep", "h1", "h2"]), "sets")

    # 1. inside blocks: every candidate pair of a block is settled
    links = written(_linked(rows.select(F.xxhash64("cluster", "block").alias("key"), "id", "sig", "set", F.col("id").alias("comp"), F.lit(True).alias("first")), low, num, den), "links")
    if not rows.where("blocks > 1").isEmpty():
        # 2. clusters of several blocks: of every component of a block, its first member meets the others', so that what
        # hangs together is one component before anything meets every block
        large = rows.where("blocks > 1")
        heads = large.join(components(links).where("node <> component").select(F.col("node").alias("id")), "id", "left_anti")
        first = heads.select(F.xxhash64("cluster", F.expr("hash(id) % greatest(1, blocks div 64)")).alias("key"), "id", "sig", "set", F.col("id").alias("comp"), F.lit(True).alias("first"))
        links = written(links.union(_linked(first, low, num, den)), "links")
        # 3. what is outside a cluster's largest component then meets every block
        comp = written(components(links), "components")
        large = large.join(comp, F.col("id") == F.col("node"), "left").withColumn("comp", F.coalesce("component", "id")).drop("node", "component")
        main = large.groupBy("cluster", "comp").count().groupBy(F.col("cluster").alias("__c")).agg(F.max_by("comp", F.struct("count", "comp")).alias("main"))
        large = written(large.join(main, F.col("cluster") == F.col("__c")), "large")
        out = large.where("comp <> main").withColumn("part", F.col("block"))
        here = F.xxhash64("cluster", "part", "block").alias("key")
        meet = out.select("cluster", "part").distinct()
        one = out.drop("block").withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)"))).select(here, "id", "sig", "set", "comp", F.lit(True).alias("first"))
        two = large.join(meet, "cluster").where("block <> part or comp = main").select(here, "id", "sig", "set", "comp", F.lit(False).alias("first"))
        links = links.union(written(_linked(one.union(two), low, num, den), "links"))
    return every, classes, shared, links


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, class_id (least id of an equal set), component_id, kept."""
    every, classes, shared, links = _settled(docs, **options)
    # an id on several texts ties their classes
    full = every.where("n_shingles > 0 and doc_id is not null")
    again = full.groupBy("doc_id").count().where("count > 1").select("doc_id")
    ties = full.join(again, "doc_id", "left_semi").join(classes.select("h1", "h2", F.col("id").alias("b")), ["h1", "h2"]).select(F.col("doc_id").alias("a"), "b").where("a <> b")
    comp = written(components(links.union(ties.select("a", "b"))), "components")
    of = classes.select("h1", "h2", "id", F.col("rep").alias("class_id")).join(comp, F.col("id") == F.col("node"), "left")
    of = of.select("h1", "h2", "class_id", F.coalesce("component", "id").alias("component"))
    if shared:  # a set's hash may be the least of a component
        of = of.join(of.groupBy("component").agg(F.min("class_id").alias("least")), "component").select("h1", "h2", "class_id", F.col("least").alias("component"))
    out = every.select("doc_id", "n_shingles", "h1", "h2").join(of, ["h1", "h2"], "left")
    linked = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    out = out.select("doc_id", "n_shingles", F.when(linked, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), F.when(linked, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs without near duplicates of a kept one; of rows that repeat an id and a set, one."""
    every, classes, shared, links = _settled(docs, **options)
    comp = written(components(links), "components")
    of = classes.select("h1", "h2", "id", "rep").join(comp, F.col("id") == F.col("node"), "left").withColumn("component", F.coalesce("component", "id"))
    if shared:  # of several sets of the least doc_id, one stays
        first = of.groupBy("component").agg(F.min(F.struct("rep", "h1", "h2")).alias("first"))
        of = of.join(first, "component").withColumn("stays", F.struct("rep", "h1", "h2") == F.col("first"))
    else:
        of = of.withColumn("stays", F.col("id") == F.col("component"))
    of = of.select("h1", "h2", F.when(F.col("stays"), F.col("rep")).alias("stays"))
    found = every.where("doc_id is not null").select("doc_id", "t", "n_shingles", "h1", "h2").join(of, ["h1", "h2"], "left")
    kept = (F.col("n_shingles") == 0) | F.coalesce(F.col("stays") == F.col("doc_id"), F.lit(False))
    found = written(found.select("doc_id", "t", "h1", "h2", kept.alias("kept")), "kept")
    again = found.groupBy("doc_id").count().where("count > 1").select("doc_id")
    if again.isEmpty():
        return docs.join(found.where("not kept").select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    gone = found.where("not kept").select("doc_id").distinct()
    single = docs.join(gone.union(again), "doc_id", "left_anti").select(*docs.columns)
    # rows of ids that stand on several are told by their texts
    told = found.join(again, "doc_id", "left_semi").where("kept").select(F.col("doc_id").alias("__id"), F.col("t").alias("__t"), "h1", "h2").distinct()
    several = docs.join(told, (F.col("doc_id").cast("long") == F.col("__id")) & (F.xxhash64("text") == F.col("__t")))
    first = several.withColumn("__n", F.row_number().over(Window.partitionBy("__id", "h1", "h2").orderBy("text")))
    return single.union(first.where("__n = 1").select(*docs.columns))


def _sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """rep, h1, h2, set (sorted 64-bit shingle hashes) of the wanted documents' texts."""

    def run(batches):
        for rows, raw, off in chunks(batches, "text"):
            with np.errstate(over="ignore"):
                h, cut = sets_of(raw, off, k)
            digest = digests(h, cut)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array([h[cut[i] : cut[i + 1]].tobytes() for i in range(len(cut) - 1)], pa.binary())], ["rep", "h1", "h2", "set"])

    found = docs.selectExpr("cast(doc_id as long) as rep", "text").join(wanted, "rep", "left_semi")
    return found.mapInArrow(run, "rep long, h1 long, h2 long, set binary")


def op3_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), k=4)


QUERIES = {"op3_minhash_neardup": op3_minhash}
ORACLES: dict[str, str] = {}
