"""Mixing sources to target weights, in DataFrame operations only.

1. Targets: every source gets its weight's share of the wanted words, stopped at
   `cap` times its size, the excess reshared by weight (water filling, closed form).
2. Packing: the words of a source, documents in a fixed order, are cut into blocks of
   `block` words; a block may span documents.
3. Draw: output slots are dealt to shards of `slots_per_shard`; the draw of source
   counts is multinomial, conditioned on every source's total (so totals meet the
   targets whatever the shards draw). It is made by one pseudorandom permutation of
   all slots.
4. The k-th slot of a source maps through the source's own pseudorandom permutation
   of block indices (another one for each pass over the source) to a block, and
   blocks are joined by index. The last slot of a source takes only the words that its
   target lacks, so the taken words of every source, however small, are its target
   rounded to a word.

Permutations are swap-or-not shuffles: exact on any length, no table, no sort.
Prefix sums go through hash chunks of documents, so a hot source spreads over tasks.

Null texts and texts without words have size 0 and are never taken; a null source is
a source of its own, the last; an empty table gives an empty result. Rows that repeat
an id have places of their own, in the order of size and text hash; a very long text
spans many blocks. `mix` returns its own columns only; `mixed_texts` keeps the columns
of docs, and columns that clash with working names (size, off) keep their values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_JAVA, read, without, written

BLOCK, CAP, SEED, ROUNDS = 128, 3, 20250131, 20
CHUNKS, SLOTS_PER_SHARD, RUN = 1024, 4096, 4096


def permuted(x: Column, n: Column, key: Column, rounds: int = ROUNDS, back: bool = False) -> Column:
    """Swap-or-not permutation of 0..n-1 at x, keyed; back: its inverse (each round is its own)."""

    def turn(at: Column, i: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(key, i), n) - at, n)
        return F.when(F.xxhash64(key, i, F.greatest(at, other)).bitwiseAND(1) == 1, other).otherwise(at)

    order = range(rounds)[::-1] if back else range(rounds)
    return F.aggregate(F.array(*[F.lit(i) for i in order]), x.cast("long"), turn)


def block_key(seed: int, turn: Column) -> Column:
    """Key of a source's permutation of its blocks in one pass."""
    return F.xxhash64(F.lit(seed + 1), "source", turn)


def sized(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs plus size (words) and __text (a hash that orders rows of one id)."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD_JAVA)), F.lit(0)).cast("long")
    return without(docs, "size").withColumn("size", size).withColumn("__text", F.xxhash64(text_col))


def chunk_of(id_col: str = "doc_id") -> Column:
    return F.pmod(F.xxhash64(F.col(id_col), F.col("__text")), F.lit(CHUNKS))


def placed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """docs plus off (words of the source before the row), and sums by source and chunk."""
    keyed = docs.withColumn("__chunk", chunk_of(id_col))
    chunk = keyed.groupBy(F.col(source_col).alias("__source"), F.col("__chunk").alias("__c")).agg(F.sum("size").alias("__n"))
    upto = Window.partitionBy("__source").orderBy("__c").rowsBetween(Window.unboundedPreceding, 0)
    before = chunk.withColumn("__before", F.sum("__n").over(upto) - F.col("__n")).drop("__n")
    inside = Window.partitionBy(source_col, "__chunk").orderBy(id_col, "size", "__text").rowsBetween(Window.unboundedPreceding, 0)
    out = keyed.withColumn("__in", F.sum("size").over(inside) - F.col("size"))
    out = out.join(before.hint("merge"), F.col(source_col).eqNullSafe(F.col("__source")) & (F.col("__chunk") == F.col("__c")))
    return out.withColumn("off", F.col("__before") + F.col("__in")).select(*docs.columns, "off"), chunk


def targets(chunk: DataFrame, cap: float = CAP, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """Per source: source_size, weight, target double, n_blocks, n_slots, first_slot, all_slots, and how many
    words the last slot takes (last_words)."""
    by = chunk.groupBy(F.col("__source").alias("source")).agg(F.sum("__n").alias("source_size"))
    # a row for each source from here on
    by = by.withColumn("weight", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rank = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    by = by.withColumn("__r", F.row_number().over(rank)).withColumn("__total", F.sum("source_size").over(every).cast("double"))
    w = Window.orderBy("__r")
    by = by.withColumn("__full", F.coalesce(F.sum(F.col("source_size") * cap).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    by = by.withColumn("__rest", F.sum("weight").over(w.rowsBetween(0, Window.unboundedFollowing)))
    # the level if exactly the sources before this one are full; the first that fits ends the filling
    by = by.withColumn("__level", (F.col("__total") - F.col("__full")) / F.col("__rest"))
    by = by.withColumn("level", F.min(F.when(F.col("__level") * F.col("weight") <= F.col("source_size") * cap, F.struct("__r", "__level"))).over(every)["__level"])
    by = by.withColumn("target", F.least(F.col("level") * F.col("weight"), (F.col("source_size") * cap).cast("double")))
    by = by.withColumn("n_blocks", F.expr(f"(source_size + {block - 1}) div {block}"))
    # whole passes, then whole slots of one more pass; its permutation tells where the short block of the source stands
    by = by.withColumn("__want", F.round("target").cast("long")).withColumn("__turn", F.expr("if(source_size > 0, __want div source_size, 0L)"))
    by = by.withColumn("__left", F.col("__want") - F.col("__turn") * F.col("source_size")).withColumn("__short", F.expr(f"source_size - {block} * greatest(n_blocks - 1, 0)"))
    by = by.withColumn("__spot", F.when(F.col("n_blocks") > 0, permuted(F.col("n_blocks") - 1, F.col("n_blocks"), block_key(seed, F.col("__turn")), back=True)).otherwise(0))
    before, whole = F.expr(f"__spot * {block}"), F.expr(f"(__left - __short) div {block}")
    slots = F.when(F.col("__left") <= before, F.expr(f"__left div {block}")).when(F.col("__left") < before + F.col("__short"), F.col("__spot")).otherwise(1 + whole)
    rest = F.when(F.col("__left") <= before, F.col("__left") % block).when(F.col("__left") < before + F.col("__short"), F.col("__left") - before).otherwise((F.col("__left") - F.col("__short")) % block)
    by = by.withColumn("__whole", F.col("__turn") * F.col("n_blocks") + slots).withColumn("__rest", rest)
    by = by.withColumn("n_slots", F.when(F.col("source_size") > 0, F.col("__whole") + (F.col("__rest") > 0).cast("long")).otherwise(0).cast("long"))
    by = by.withColumn("last_words", F.when(F.col("__rest") > 0, F.col("__rest")))
    by = by.withColumn("first_slot", F.sum("n_slots").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_slots")).withColumn("all_slots", F.sum("n_slots").over(every))
    return by.select("source", "source_size", "weight", "target", "n_blocks", "n_slots", "first_slot", "all_slots", "last_words")


def _numbers(df: DataFrame, n: str, name: str) -> DataFrame:
    """A row for each number from 0 to n - 1, through runs of RUN, so no array grows with n."""
    runs = df.withColumn("__run", F.explode(F.expr(f"sequence(0L, {n} - 1, {RUN}L)")))
    n_tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = runs.repartition(n_tasks, "__run", *[c for c in df.columns if c in ("source", "shard")])
    return runs.withColumn(name, F.explode(F.expr(f"sequence(__run, least(__run + {RUN}, {n}) - 1)"))).drop("__run")


def draw(by: DataFrame, seed: int = SEED, slots_per_shard: int = SLOTS_PER_SHARD) -> DataFrame:
    """Source counts for each output shard, and the ordinal of its first slot in the source."""
    slots = _numbers(by.where("n_slots > 0"), "n_slots", "k")
    at = permuted(F.col("first_slot") + F.col("k"), F.col("all_slots"), F.lit(seed))
    slots = slots.withColumn("shard", F.floor(at / F.lit(float(slots_per_shard))).cast("long"))
    keys = ["source", "source_size", "target", "n_blocks", "n_slots", "last_words"]
    drawn = slots.groupBy(*keys, "shard").agg(F.count(F.lit(1)).alias("n_drawn"))
    # prefix sums in two steps, through runs of shards: no task holds all shards of a source
    drawn = drawn.withColumn("__run", F.expr(f"shard div {RUN}"))
    runs = drawn.groupBy(F.col("source").alias("__s"), F.col("__run").alias("__r")).agg(F.sum("n_drawn").alias("__n"))
    upto = Window.partitionBy("__s").orderBy("__r").rowsBetween(Window.unboundedPreceding, 0)
    runs = runs.withColumn("__before", F.sum("__n").over(upto) - F.col("__n")).drop("__n")
    inside = Window.partitionBy("source", "__run").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    drawn = drawn.withColumn("__in", F.sum("n_drawn").over(inside) - F.col("n_drawn"))
    drawn = drawn.join(runs.hint("merge"), F.col("source").eqNullSafe(F.col("__s")) & (F.col("__run") == F.col("__r")))
    return drawn.select(*keys, "shard", "n_drawn", (F.col("__before") + F.col("__in")).alias("first_k"))


def slots(drawn: DataFrame, seed: int = SEED) -> DataFrame:
    """shard, source, k, block, words: every output slot, the block that fills it, and how many of the block's
    first words it takes (null: all)."""
    out = _numbers(drawn, "n_drawn", "__i").withColumn("k", F.col("first_k") + F.col("__i"))
    block = permuted(F.col("k") % F.col("n_blocks"), F.col("n_blocks"), block_key(seed, F.expr("k div n_blocks")))
    return out.select("shard", "source", "k", block.alias("block"), F.when(F.col("k") == F.col("n_slots") - 1, F.col("last_words")).alias("words"))


def block_uses(by: DataFrame, seed: int = SEED, slots_per_shard: int = SLOTS_PER_SHARD) -> DataFrame:
    """How often the mix takes each block whole (times), and the first words that its source's last slot takes of it (part)."""
    each = slots(draw(by, seed, slots_per_shard), seed).groupBy(F.col("source").alias("__source"), F.col("block").alias("__block"))
    return each.agg(F.count_if(F.col("words").isNull()).alias("__times"), F.coalesce(F.max("words"), F.lit(0)).alias("__part"))


def pieces(rows: DataFrame, uses: DataFrame, source_col: str = "source", block: int = BLOCK) -> DataFrame:
    """rows (with size, off) by the blocks they reach into: lo and hi, counted in the row's own words, and times."""
    cut = rows.where("size > 0").withColumn("__b", F.explode(F.expr(f"sequence(off div {block}, (off + size - 1) div {block})")))
    cut = cut.join(uses.hint("merge"), F.col(source_col).eqNullSafe(F.col("__source")) & (F.col("__b") == F.col("__block")))
    begin = F.col("__b") * block - F.col("off")
    lo, hi = F.greatest(begin, F.lit(0)), F.least(begin + block, F.col("size"))
    edge = F.greatest(lo, F.least(hi, begin + F.col("__part")))
    part = lambda a, b, n: F.struct(a.alias("lo"), b.alias("hi"), n.alias("times"))
    cut = cut.withColumn("__x", F.explode(F.array(part(lo, edge, F.col("__times") + 1), part(edge, hi, F.col("__times")))))
    return cut.where("__x.lo < __x.hi and __x.times > 0").select(*rows.columns, "__x.*")


def mix(docs: DataFrame, block: int = BLOCK, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """Per row: doc_id, source, size, off, source_size, target, taken."""
    rows, chunk = placed(sized(docs).select("doc_id", "source", "size", "__text"))
    by = targets(chunk, cap, block, seed)
    cut = pieces(rows, block_uses(by, seed), block=block)
    taken = cut.groupBy(F.col("doc_id").alias("__id"), F.col("source").alias("__s"), F.col("off").alias("__off")).agg(F.sum((F.col("hi") - F.col("lo")) * F.col("times")).alias("taken"))
    rows = rows.join(by.select(F.col("source").alias("__src"), "source_size", "target"), F.col("source").eqNullSafe(F.col("__src")))
    rows = rows.join(taken.hint("merge"), (F.col("size") > 0) & F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("source").eqNullSafe(F.col("__s")) & (F.col("off") == F.col("__off")), "left")
    return rows.select("doc_id", "source", "size", "off", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_texts(docs: DataFrame, block: int = BLOCK, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """The mix as documents, columns as in docs: a row taken in full is whole; one taken in
    part holds the words of its taken blocks, in order and with the white space after
    them; what is taken twice or thrice comes in a second or third row of the same id."""
    # columns of docs that working names would hide wait under other names
    hidden = {c: f"__own_{c}" for c in docs.columns if c in ("size", "off")}
    for c, own in hidden.items():
        docs = docs.withColumnRenamed(c, own)
    whole = written(placed(sized(docs))[0], "mix-rows")
    slim = whole.select("doc_id", "source", "size", "off", "__text")
    chunk = slim.groupBy(F.col("source").alias("__source"), chunk_of().alias("__c")).agg(F.sum("size").alias("__n"))
    cut = pieces(slim, block_uses(targets(chunk, cap, block, seed), seed), block=block)
    plan = cut.groupBy(F.col("doc_id").alias("__id"), F.col("source").alias("__s"), F.col("off").alias("__off")).agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "times"))).alias("__cut"))
    got = whole.join(plan.hint("merge"), F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("source").eqNullSafe(F.col("__s")) & (F.col("off") == F.col("__off")) & (F.col("size") > 0))
    got = got.withColumn("__copy", F.explode(F.expr("sequence(1L, array_max(__cut.times))")))
    got = got.withColumn("__now", F.expr("filter(__cut, x -> x.times >= __copy)")).withColumn("__words", F.expr("aggregate(__now, 0L, (n, x) -> n + x.hi - x.lo)"))
    words = F.regexp_extract_all("text", F.lit(r"(?s)(?:^[\x20\x09-\x0D]+)?[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))
    part = got.withColumn("__all", F.when(F.col("__words") < F.col("size"), words))
    some = F.expr("array_join(flatten(transform(__now, x -> slice(__all, int(x.lo) + 1, int(x.hi - x.lo)))), '')")
    text = F.when(F.col("__words") == F.col("size"), F.col("text")).otherwise(some)
    out = part.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast("long"))
    out = out.select(*docs.columns)
    for c, own in hidden.items():
        out = out.withColumnRenamed(own, c)
    return out


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op6_source_mixing": op6_mixing}
ORACLES: dict[str, str] = {}
