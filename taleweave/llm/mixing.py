"""Mixing sources to target weights with fixed-length blocks (DataFrame functions only).

The words of a source form one stream, cut into blocks of ``block_words``; the
last block of a source may be shorter.  Output is a row of slots, ``shard_slots``
to a shard, each filled by one block.  Every slot draws its source from the
target distribution by a hash of its number, so a shard's counts of sources are
multinomial.  Over the whole output, sources drawn beyond their target hand the
surplus to those below (some square root of all slots), so that targets are met
to within a block and no document is used up too often.  The j-th draw of a
source takes block ``perm(j)`` of a pseudorandom permutation of its block indices
and starts another permutation when all blocks are used.  Blocks and draws meet in
an equi-join on (source, block index).

All positions come from hashes of keys and from prefix sums over buckets:
reruns agree, and a source with a third of all rows is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taleweave.llm.frames import join_on
from taleweave.llm.scratch import written

WORD = r"[^\x20\x09-\x0D]+"
BUCKET_ROWS = 8192  # documents in one sort
SUPER = 1024  # shards in one sort
CELLS = 4096  # of the table by which slots find their source
ROUNDS = 12  # of a permutation
SMALL = 20_000  # sources up to which that table is broadcast (some 100 bytes each)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def permuted(df: DataFrame, name: str, index: Column, n: Column, salt: Column) -> DataFrame:
    """``df`` with a column ``name``: ``index`` under a pseudorandom bijection of [0, n) that ``salt`` decides.

    Swap-or-not: every round pairs x with its mirror image k - x modulo n, and a
    hash of the pair says whether the two change places.  It works for any n,
    and nothing is larger than 2 n.
    """
    df = df.withColumn(name, index)
    for r in range(ROUNDS):
        mirror = F.pmod(F.pmod(F.xxhash64(F.lit(r), salt), n) - F.col(name), n)
        df = df.withColumn("mirror", mirror)
        swap = F.xxhash64(F.lit(r), salt, F.greatest(F.col(name), F.col("mirror"))).bitwiseAND(F.lit(1)) == 1
        df = df.withColumn(name, F.when(swap, F.col("mirror")).otherwise(F.col(name)))
    return df.drop("mirror")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), limit: int = 3) -> DataFrame:
    """(source, source_size) to (source, source_size, weight, target), one row a source.

    Sources in code-point order, null last, take ``weights`` in turn.  The sum
    of all sizes is shared by weight; a target stops at ``limit`` times its
    source's size and the excess goes to the others by weight.  The sharing has
    a closed form: with sources by limit/weight, those up to the first whose
    share of the rest is below its limit are full.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    most = F.col("source_size").cast("double") * limit
    every = Window.partitionBy()
    by_fill = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    t = sizes.withColumn("weight", weight).withColumn("most", most)
    left = F.sum(F.col("source_size").cast("double")).over(every) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    t = t.withColumn("level", left / F.sum("weight").over(rest))
    t = t.withColumn("open", F.col("level") * F.col("weight") <= F.col("most"))
    level = F.min(F.when(F.col("open"), F.struct((F.col("most") / F.col("weight")).alias("r"), F.col("level").alias("level")))).over(every)["level"]
    target = F.least(F.col("most"), F.coalesce(level * F.col("weight"), F.col("most")))
    return t.select("source", "source_size", "weight", target.alias("target"))


def keyed_documents(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """doc_id, source, size, the text's hash and the first word's place in its source's stream."""
    key = F.xxhash64(F.col(id_col), F.col(text_col))
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), key.alias("h"))
    base = written(base, "mix-sizes")  # the only look at the texts
    n_buckets = base.count() // BUCKET_ROWS + 1
    base = base.withColumn("bucket", F.pmod("h", F.lit(n_buckets)))
    in_bucket = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "size")
    local = F.sum("size").over(in_bucket.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    base = base.withColumn("local", local)
    by_bucket = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = base.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    sums = sums.withColumn("base", F.coalesce(F.sum("words").over(by_bucket), F.lit(0))).drop("words")
    return join_on(base, sums, ["source", "bucket"]).select("doc_id", "source", "size", "h", (F.col("base") + F.col("local")).cast("long").alias("start"))


def shard_counts(sources: DataFrame, n_slots: int, shard_slots: int, seed: int) -> DataFrame:
    """(shard, source, n): how many of a shard's slots drew the source, a multinomial draw with probabilities draws / n_slots.

    ``sources`` has source, draws and low, the sum of draws before.
    """
    spark = sources.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    width = -(-n_slots // CELLS) or 1
    cells = sources.where("draws > 0").select("source", "low", (F.col("low") + F.col("draws")).alias("high"))
    cells = written(cells.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor((F.col("high") - 1) / width)))), "cells")
    slots = spark.range(0, n_slots, 1, parts).select(F.floor(F.col("id") / shard_slots).alias("shard"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(n_slots)).alias("u"))
    slots = slots.withColumn("cell", F.floor(F.col("u") / width))
    small = cells.count() <= SMALL + CELLS
    drawn = slots.join(F.broadcast(cells) if small else cells, "cell").where("u >= low AND u < high")
    return drawn.groupBy("shard", "source").agg(F.count("*").alias("n"))


def draw_slots(targets: DataFrame, block_words: int, shard_slots: int, seed: int) -> DataFrame:
    """Every output slot: shard, slot, source, block, turn (how often the block's source had been used up)."""
    n_blocks = F.ceil(F.col("source_size") / block_words).cast("long")
    sources = targets.where("source_size > 0").withColumn("n_blocks", n_blocks)
    # a draw brings source_size / n_blocks words on average; never more than 3 rounds as target <= 3 * size
    sources = sources.withColumn("draws", F.round(F.col("target") * F.col("n_blocks") / F.col("source_size")).cast("long"))
    order = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)  # a row a source
    sources = written(sources.select("source", "n_blocks", "draws").withColumn("low", F.coalesce(F.sum("draws").over(order), F.lit(0))), "mix-sources")
    n_slots = sources.agg(F.sum("draws")).first()[0] or 0
    counts = written(shard_counts(sources, n_slots, shard_slots, seed), "mix-counts")
    # surplus draws over a source's target go to those below theirs, one by one
    drawn = join_on(sources, counts.groupBy("source").agg(F.sum("n").alias("drawn")), ["source"], "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    drawn = drawn.withColumn("over", F.greatest(F.col("drawn") - F.col("draws"), F.lit(0))).withColumn("under", F.greatest(F.col("draws") - F.col("drawn"), F.lit(0)))
    drawn = drawn.withColumn("over_low", F.coalesce(F.sum("over").over(order), F.lit(0))).withColumn("under_low", F.coalesce(F.sum("under").over(order), F.lit(0)))
    takers = drawn.where("under > 0").withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("under") - 1)))
    takers = takers.select((F.col("under_low") + F.col("k")).alias("hand"), F.col("source").alias("taker"), (F.col("drawn") + F.col("k")).alias("taken"))
    # how often a source was drawn in the shards before
    counts = counts.withColumn("super", F.floor(F.col("shard") / SUPER))
    sums = counts.groupBy("source", "super").agg(F.sum("n").alias("m"))
    base = F.coalesce(F.sum("m").over(Window.partitionBy("source").orderBy("super").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = F.sum("n").over(Window.partitionBy("source", "super").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    in_shard = F.sum("n").over(Window.partitionBy("shard").orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    runs = join_on(counts.withColumn("before", before), sums.withColumn("base", base).drop("m"), ["source", "super"]).withColumn("place", in_shard)
    runs = join_on(runs.withColumn("first", F.col("base") + F.col("before")), drawn.select("source", "n_blocks", "draws", "over_low"), ["source"])
    parts = int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a run has few bytes and makes many rows
    runs = runs.repartition(parts, "shard", "source").withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    runs = runs.withColumn("draw", F.col("first") + F.col("k")).withColumn("place", F.col("place") + F.col("k"))
    runs = runs.select("shard", "place", "source", "n_blocks", "draw", "draws", F.when(F.col("draw") >= F.col("draws"), F.col("over_low") + F.col("draw") - F.col("draws")).alias("hand"))
    kept = runs.where("hand IS NULL").select("shard", "place", "source", "n_blocks", "draw")
    handed = runs.where("hand IS NOT NULL").select("shard", "place", "hand").join(takers, "hand").select("shard", "place", F.col("taker").alias("source"), F.col("taken").alias("draw"))
    handed = join_on(handed, sources.select("source", "n_blocks"), ["source"]).select("shard", "place", "source", "n_blocks", "draw")
    slots = kept.unionByName(handed).withColumn("turn", F.floor(F.col("draw") / F.col("n_blocks")))
    slots = permuted(slots, "block", F.col("draw") % F.col("n_blocks"), F.col("n_blocks"), F.struct(F.lit(seed), F.col("source"), F.col("turn")))
    first = F.col("shard") * shard_slots
    slots = slots.withColumn("room", F.least(F.lit(shard_slots).cast("long"), F.lit(n_slots) - first))
    slots = permuted(slots, "nth", F.col("place"), F.col("room"), F.struct(F.lit(seed), F.col("shard")))
    return slots.select("shard", (first + F.col("nth")).alias("slot"), "source", "block", "turn")


def cut_blocks(keyed: DataFrame, block_words: int) -> DataFrame:
    """The pieces of every block: source, block, doc_id, start, size, low and high (words within the document)."""
    full = keyed.where("size > 0")
    last = F.floor((F.col("start") + F.col("size") - 1) / block_words)
    pieces = full.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block_words), last)))
    at = F.col("block") * block_words
    return pieces.select(
        "source",
        "block",
        "doc_id",
        "h",
        "start",
        "size",
        F.greatest(at - F.col("start"), F.lit(0)).alias("low"),
        F.least(at + block_words - F.col("start"), F.col("size")).alias("high"),
    )


def mix_plan(docs: DataFrame, block_words: int = 32, shard_slots: int = 4096, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame, tuple[DataFrame, DataFrame]]:
    """Documents with their places, sources with their targets, and the slots and pieces of blocks."""
    keyed = keyed_documents(docs, id_col, text_col, source_col)
    targets = source_targets(keyed.groupBy("source").agg(F.sum("size").alias("source_size")))
    return keyed, targets, (draw_slots(targets, block_words, shard_slots, seed), cut_blocks(keyed, block_words))


def mixed_spans(slots: DataFrame, pieces: DataFrame) -> DataFrame:
    """The mix: for every slot the word spans that fill it."""
    return join_on(slots, pieces, ["source", "block"], merge=True)


def mix_amounts(docs: DataFrame, block_words: int = 32, shard_slots: int = 4096, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row a document: doc_id, size, source_size, target, taken (words that the mix takes, repeats counted).

    Null texts and texts without words have size 0 and are never taken; a null
    source is a source of its own, the last one.  Repeated rows are documents of
    their own.  An empty table gives no rows.  Other columns are ignored.
    """
    keyed, targets, (slots, pieces) = mix_plan(docs, block_words, shard_slots, seed, id_col, text_col, source_col)
    taken = mixed_spans(slots, pieces).groupBy("source", "start").agg(F.sum(F.col("high") - F.col("low")).alias("taken"))
    # a document with words is known by its place in its source's stream
    out = join_on(keyed.where("size > 0"), taken, ["source", "start"], "left").unionByName(keyed.where("size = 0"), allowMissingColumns=True)
    out = join_on(out, targets, ["source"])
    return out.select(F.col("doc_id").alias(id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source")


def mix_documents(docs: DataFrame, block_words: int = 32, shard_slots: int = 4096, seed: int = 1) -> DataFrame:
    """The mix as documents: columns doc_id, text, lang, source, n_chars.

    A document gives one row for every turn in which some of its words are
    taken; the row's text holds the taken words with the white space after
    them.  Documents without words are left out.  Nulls are treated as in
    ``mix_amounts``.
    """
    base = docs.select("doc_id", "text", "lang", "source")
    keyed, _, (slots, pieces) = mix_plan(base, block_words, shard_slots, seed)
    spans = mixed_spans(slots, pieces).groupBy("source", "start", "turn").agg(F.sort_array(F.collect_list(F.struct("low", "high"))).alias("spans"))
    # rows of one source with the same id and text are numbered among all such rows, taken or not; they differ in their language at most
    same = ["source", "doc_id", "h"]
    numbered = keyed.where("size > 0").select(*same, "start", "size", F.row_number().over(Window.partitionBy(*same).orderBy("start")).alias("nth"))
    spans = join_on(spans, numbered, ["source", "start"])
    texts = base.withColumn("h", F.xxhash64("doc_id", "text")).groupBy(*same, "lang").agg(F.first("text").alias("text"), F.count("*").alias("n"))
    texts = texts.withColumn("last", F.sum("n").over(Window.partitionBy(*same).orderBy("lang").rowsBetween(Window.unboundedPreceding, 0)))
    whole = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["high"] - s["low"]) == F.col("size")
    words = F.regexp_extract_all(F.col("text"), F.lit(rf"({WORD}[\x20\x09-\x0D]*)"), F.lit(1))
    # bound once: a lambda would take the text apart again for every span
    cut = F.get(F.transform(F.array(words), lambda w: F.array_join(F.flatten(F.transform("spans", lambda s: F.slice(w, (s["low"] + 1).cast("int"), (s["high"] - s["low"]).cast("int")))), "")), F.lit(0))
    out = join_on(spans, texts, same).where("nth > last - n AND nth <= last")
    out = out.select("doc_id", F.when(whole, F.col("text")).otherwise(cut).alias("text"), "lang", "source")
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select("doc_id", "text", "lang", "source", "n_chars")
