"""N-gram Jaccard join by signature trees: which documents are linked, directly or through others.

The join runs over classes of equal shingle sets, in bounded pieces:

1. every text gives its set size and a fingerprint of its set; equal sets form
   one class, represented by its smallest document id;
2. every shingle is sent once to the range of its hash.  A shingle of one class
   only cannot be part of an overlap and is forgotten there; the others return
   to their class.  What a class got back bounds all its overlaps, so classes
   with less than the needed overlap drop out;
3. the remaining classes meet in groups, first by a few min-hashes, which join
   most near copies cheaply, then by every token of their prefix (the n - o + 1
   first tokens, of which two linked sets share at least one; tokens of many sets
   come last), but only where a group still holds two components.  In each group a signature tree is
   built and traversed against itself.  Groups larger than ``BLOCK`` are dealt as
   pairs of blocks;
4. components of the links give the result.

With ``count_links`` the classes meet once more by all their prefix tokens, with
no regard to components, and every link of every class is counted once.

The second part of step 3 is complete, so no link between different texts is
lost; hashes of 48 bits stand for shingles, and every link is decided by the
exact count of common hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taleweave.llm import kernels
from taleweave.llm.components import components
from taleweave.llm.frames import KEY, join_on, with_key
from taleweave.llm.scratch import forget_shuffles, written
from taleweave.llm.signature_tree import PER_CENT, LinkCounts, SignatureTree

U64 = np.uint64
CHUNK_TOKENS = 1 << 19  # shingles gathered in a task before they are sent
RANGE_TOKENS = 1 << 20  # shingles of one hash range; a chunk goes to every range in a row, so small ranges make many small rows
MIN_HASHES = 3
BUCKET_SETS = 1000  # classes that get their tokens back in one task's group
BLOCK = 3000  # sets in one block of a large group
CLUSTER = 16 * BLOCK  # sets that are compared as pairs of blocks
FREQUENT, MOST_FREQUENT = 32, 1 << 18  # sets from which on a token comes last in the order, and tokens that do at most
WIDTH = 7  # bytes of a token with its mark


def _fingerprint(tokens: np.ndarray) -> int:
    """Of a whole set; never 0, the mark of a witness."""
    return int(kernels.mix(np.array([np.bitwise_xor.reduce(kernels.mix(tokens + U64(1))) + U64(len(tokens))], dtype=U64))[0] >> U64(1)) or 1


def document_sets(docs: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n_shingles, set_key, KEY) of every row; set_key null for an empty set."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys = [], []
            for _, tokens in kernels.shingle_sets(batch["text"], shingle):
                sizes.append(len(tokens))
                keys.append(_fingerprint(tokens) if len(tokens) else None)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), *(batch[k] for k in KEY)], ["doc_id", "n_shingles", "set_key", *KEY])
            del batch
            kernels.give_back()

    rows = with_key(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    return rows.mapInArrow(measure, f"doc_id long, n_shingles long, set_key long, {', '.join(f'{k} long' for k in KEY)}")


def _send(n_ranges: int, n_buckets: int, shingle: int):
    """Chunks of texts to rows (to, part, keys, counts, tokens): part 0 for hash ranges, 1 for what is known to be shared."""

    def pack(tokens: list[np.ndarray], keys: list[int]) -> Iterator[tuple]:
        if not keys:
            return
        first: dict[int, int] = {}
        keep = [i for i, k in enumerate(keys) if first.setdefault(k, i) == i]
        own = np.repeat(np.arange(len(keep), dtype=np.int64), [len(tokens[i]) for i in keep])
        key = np.array([keys[i] for i in keep], dtype=np.int64)
        token = np.concatenate([tokens[i] for i in keep])
        order = np.argsort(token)
        token, own = token[order], own[order]
        new = np.empty(len(token), dtype=bool)
        new[0] = True
        np.not_equal(token[1:], token[:-1], out=new[1:])
        count = np.diff(np.append(np.flatnonzero(new), len(token)))
        several = np.repeat(count > 1, count)
        # tokens of several sets of this chunk are known to be shared: one witness tells the others
        lone = new.copy()
        witness = several & new
        sent, who = token[lone], np.where(witness[lone], -1, own[lone])
        to = ((sent >> U64(16)) * U64(n_ranges)) >> U64(32)
        cuts = np.searchsorted(to, np.arange(n_ranges + 1, dtype=U64))
        for r in np.flatnonzero(np.diff(cuts)).tolist():
            t, w = sent[cuts[r] : cuts[r + 1]], who[cuts[r] : cuts[r + 1]]
            used, local = np.unique(w, return_inverse=True)
            table = np.where(used < 0, 0, key[used])
            yield r, 0, table.astype("<i8").tobytes(), kernels.to_planes(local.astype(U64), 3), kernels.to_planes(t, 6)
        if several.any():
            yield from by_bucket(key[own[several]], token[several], n_buckets, n_ranges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, keys, total = [], [], 0
        for batch in batches:
            for _, t in kernels.shingle_sets(batch["text"], shingle):
                if len(t):
                    keys.append(_fingerprint(t))
                    # 48 bits; sorted order and distinctness stay but for rare collisions
                    tokens.append(np.unique(t >> U64(16)))
                    total += len(t)
                if total >= CHUNK_TOKENS:
                    yield _rows(pack(tokens, keys))
                    tokens, keys, total = [], [], 0
            del batch
            kernels.give_back()
        yield _rows(pack(tokens, keys))
        tokens, keys = [], []
        kernels.give_back()

    return run


SENT = pa.schema([("to", pa.int32()), ("part", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("tokens", pa.binary())])
SENT_SQL = "to int, part int, keys binary, counts binary, tokens binary"


def _rows(rows: Iterator[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(SENT)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SENT, strict=True)], schema=SENT)


def by_bucket(keys: np.ndarray, tokens: np.ndarray, n_buckets: int, n_ranges: int) -> Iterator[tuple]:
    """Shared tokens, packed by class and dealt by bucket of the class; ``to`` spreads them over the ranges' tasks."""
    order = np.lexsort((tokens, keys))
    keys, tokens = keys[order], tokens[order]
    bucket = keys % n_buckets
    order = np.argsort(bucket, kind="stable")
    keys, tokens, bucket = keys[order], tokens[order], bucket[order]
    cuts = np.searchsorted(bucket, np.arange(n_buckets + 1))
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        k, t = keys[cuts[b] : cuts[b + 1]], tokens[cuts[b] : cuts[b + 1]]
        at = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        yield b % n_ranges, 1 + b, k[at].astype("<i8").tobytes(), kernels.to_planes(np.diff(np.append(at, len(k))).astype(U64), 4), kernels.to_planes(t, 6)


def _then_give_back(work):
    """A group's work, after which what it held goes: the worker may wait long for its next group."""

    def run(table: pa.Table) -> pa.Table:
        out = work(table)
        kernels.give_back()
        return out

    return run


def _settle(n_ranges: int, n_buckets: int):
    """A hash range: which of its tokens belong to two classes or more."""

    def run(table: pa.Table) -> pa.Table:
        part = table["part"].to_numpy()
        out = [table.filter(pa.array(part > 0))]
        mine = table.filter(pa.array(part == 0))
        if mine.num_rows:
            tokens = np.concatenate([kernels.from_planes(b, 6) for b in mine["tokens"].to_pylist()])
            keys = np.concatenate([np.frombuffer(k, "<i8")[kernels.from_planes(c, 3).astype(np.int64)] for k, c in zip(mine["keys"].to_pylist(), mine["counts"].to_pylist(), strict=True)])
            order = np.lexsort((keys, tokens))
            tokens, keys = tokens[order], keys[order]
            new = np.append(True, tokens[1:] != tokens[:-1])
            at = np.flatnonzero(new)
            ends = np.append(at[1:], len(tokens)) - 1
            # sorted by key: two classes, or a witness (0), first
            shared = np.repeat((keys[at] != keys[ends]) | (keys[at] == 0), np.diff(np.append(at, len(tokens)))) & (keys != 0)
            shared[1:] &= new[1:] | (keys[1:] != keys[:-1])
            if shared.any():
                out.append(pa.Table.from_batches([_rows(by_bucket(keys[shared], tokens[shared], n_buckets, n_ranges))]))
        return pa.concat_tables([t.cast(SENT) for t in out])

    return _then_give_back(run)


LIVE_SQL = "rep long, n long, tokens binary, hashes array<long>"


def _gather(per_cent: int):
    """A bucket of classes: their shared tokens, where they may suffice for a link."""

    def work(shared: pa.Table, sets: pa.Table) -> pa.Table:
        out = {"rep": [], "n": [], "tokens": [], "hashes": []}
        known = dict(zip(sets["set_key"].to_pylist(), zip(sets["rep"].to_pylist(), sets["n"].to_pylist(), strict=True), strict=True))
        if shared.num_rows:
            keys, counts = [], []
            for k, c in zip(shared["keys"].to_pylist(), shared["counts"].to_pylist(), strict=True):
                keys.append(np.frombuffer(k, "<i8"))
                counts.append(kernels.from_planes(c, 4).astype(np.int64))
            owner = np.repeat(np.concatenate(keys), np.concatenate(counts))
            tokens = np.concatenate([kernels.from_planes(b, 6) for b in shared["tokens"].to_pylist()])
            order = np.lexsort((tokens, owner))
            owner, tokens = owner[order], tokens[order]
            at = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            for a, b in zip(at.tolist(), np.append(at[1:], len(owner)).tolist(), strict=True):
                rep, n = known[int(owner[a])]
                own = np.unique(tokens[a:b])
                if 100 * len(own) >= per_cent * n:
                    out["rep"].append(rep)
                    out["n"].append(n)
                    out["tokens"].append(kernels.to_planes(own, 6))
                    out["hashes"].append([int(kernels.mix(own + U64(salt << 50)).min() >> U64(1)) for salt in range(1, MIN_HASHES + 1)])
        return pa.table(out, schema=pa.schema([("rep", pa.int64()), ("n", pa.int64()), ("tokens", pa.binary()), ("hashes", pa.list_(pa.int64()))]))

    def run(shared: pa.Table, sets: pa.Table) -> pa.Table:
        out = work(shared, sets)
        kernels.give_back()  # the worker may wait long for its next group
        return out

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, n): tokens of several sets of a chunk, and of how many."""
    schema = pa.schema([("token", pa.int64()), ("n", pa.int64())])

    def counted(tokens: list[np.ndarray]) -> pa.RecordBatch:
        token, n = np.unique(np.concatenate(tokens) if tokens else np.empty(0, U64), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(token[n > 1].astype(np.int64)), pa.array(n[n > 1].astype(np.int64))], schema=schema)

    tokens, total = [], 0
    for batch in batches:
        for blob in batch["tokens"].to_pylist():
            tokens.append(kernels.from_planes(blob, 6))
            total += len(tokens[-1])
            if total >= CHUNK_TOKENS:
                yield counted(tokens)
                tokens, total = [], 0
    yield counted(tokens)
    kernels.give_back()


def _rare_first(live: DataFrame) -> DataFrame:
    """``live`` with a mark above the tokens of many sets, so that they come last in every set.

    Prefixes of sets meet whatever the order of tokens is, as long as it is one:
    with rare tokens first, a passage that many texts share brings together only
    those that share little else.  Which tokens are marked therefore never
    changes a result, and their list has a bound.
    """
    counts = live.select("tokens").mapInArrow(_repeated, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    few = counts.where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "token").limit(MOST_FREQUENT).select("token").toArrow()
    frequent = np.sort(few["token"].to_numpy().astype(U64))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for blob in batch["tokens"].to_pylist():
                t = kernels.from_planes(blob, 6)
                if len(frequent):
                    at = np.minimum(np.searchsorted(frequent, t), len(frequent) - 1)
                    t = np.sort(np.where(frequent[at] == t, t | U64(1 << 48), t))
                out.append(kernels.to_planes(t, WIDTH))
            yield pa.RecordBatch.from_arrays([batch["rep"], batch["n"], pa.array(out, pa.binary()), batch["hashes"]], ["rep", "n", "tokens", "hashes"])
        kernels.give_back()

    return live.select("rep", "n", "tokens", "hashes").mapInArrow(mark, LIVE_SQL)


def _traverse(per_cent: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("rep", "ascending")])
        rep = table["rep"].to_numpy()
        tokens = [kernels.from_planes(b, WIDTH) for b in table["tokens"].to_pylist()]
        found = SignatureTree(tokens, table["n"].to_numpy(), table["component"].to_numpy(), per_cent).run()
        a = pa.array([int(rep[i]) for i, _ in found], pa.int64())
        b = pa.array([int(rep[j]) for _, j in found], pa.int64())
        return pa.table({"a": a, "b": b})

    return _then_give_back(run)


def _count(per_cent: int, by_token: bool):
    """Links of each class, in documents; a pair that meets by several tokens counts by the smallest."""

    def run(table: pa.Table) -> pa.Table:
        i, j, block = table["i"][0].as_py(), table["j"][0].as_py(), table["block"].to_numpy()
        tokens = [kernels.from_planes(b, WIDTH) for b in table["tokens"].to_pylist()]
        only = table["group"][0].as_py() if by_token else None
        counts = LinkCounts(tokens, table["n"].to_numpy(), table["component"].to_numpy(), table["docs"].to_numpy(), block == j if i != j else np.zeros(len(block), bool), per_cent, only).run()
        some = pa.array(counts > 0)
        return pa.table({"rep": table["rep"].filter(some).cast(pa.int64()), "links": pa.array(counts, pa.int64()).filter(some)})

    return run


def _members() -> list:
    """Two columns that tell sets of members apart."""
    return [F.bit_xor(F.xxhash64(F.lit(k), "rep")).alias(f"members{k}") for k in (1, 2)]


def _linked(live: DataFrame, members: DataFrame, all_pairs: bool, per_cent: int, count_by: str | None = None) -> DataFrame:
    """Links inside the groups of ``members`` (group, rep, component, count); large groups as pairs of blocks.

    With ``count_by`` (cluster or token) the numbers of links (rep, links) of the groups; ``live`` has ``docs`` then.
    """
    n = F.ceil(F.col("count") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("rep"), n).cast("int")
    if all_pairs:
        partners = F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.struct(F.least(block, j).alias("i"), F.greatest(block, j).alias("j")))
    else:  # every block meets block 0
        partners = F.when(block == 0, F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.struct(F.lit(0).alias("i"), j.alias("j")))).otherwise(F.array(F.struct(F.lit(0).alias("i"), block.alias("j"))))
    if count_by:
        dealt = members.select("group", "rep", "component", block.alias("block"), F.explode(partners).alias("pair"))
        rows = dealt.hint("merge").join(live.select("rep", "n", "docs", "tokens").hint("merge"), "rep")
        rows = rows.select("group", F.col("pair.i").alias("i"), F.col("pair.j").alias("j"), "rep", "component", "block", "n", "docs", "tokens")
        return rows.groupBy("group", "i", "j").applyInArrow(_count(per_cent, count_by == "token"), "rep long, links long")
    dealt = members.select("group", "rep", "component", F.explode(partners).alias("pair"))
    rows = dealt.hint("merge").join(live.select("rep", "n", "tokens").hint("merge"), "rep")
    rows = rows.select("group", F.col("pair.i").alias("i"), F.col("pair.j").alias("j"), "rep", "component", "n", "tokens")
    return rows.groupBy("group", "i", "j").applyInArrow(_traverse(per_cent), "a long, b long")


def _met(live: DataFrame, prefix: DataFrame, which: Column, per_cent: int, count: bool = False) -> DataFrame:
    """Links, or their numbers, of classes that share a prefix token of those in ``which``."""
    mixed = prefix.groupBy("token").agg(F.count("*").alias("count"), F.min("rep").alias("first"), *_members(), F.min("component").alias("low"), F.max("component").alias("high")).where(which).drop("low", "high")
    mixed = written(mixed, "mixed")
    meet = written(prefix.join(mixed.select("token", "first"), "token").select("rep", "component", "first").distinct(), "meet")
    # texts that share such tokens, directly or through others, make one group: however many tokens two share, they meet once
    cluster = written(components(meet.select(F.col("rep").alias("a"), F.col("first").alias("b"))), "clusters")
    sizes = cluster.groupBy("component").agg(F.count("*").alias("count")).withColumnRenamed("component", "group")
    dealt = cluster.select(F.col("node").alias("rep"), F.col("component").alias("group")).join(sizes, "group")
    comps = meet.select("rep", "component").distinct()
    rest = _linked(live, dealt.where(F.col("count") <= CLUSTER).join(comps, "rep").select("group", "rep", "component", "count"), True, per_cent, "cluster" if count else None)
    # a cluster too large for pairs of blocks is taken apart again: by tokens, those with the same members as one
    wide = prefix.join(dealt.where(F.col("count") > CLUSTER).select("rep"), "rep")
    tokens = mixed.groupBy("count", "members1", "members2").agg(F.min("token").alias("token")).select("token", "count")
    return rest.unionByName(_linked(live, wide.join(tokens, "token").select(F.col("token").alias("group"), "rep", "component", "count"), True, per_cent, "token" if count else None))


def near_duplicate_components(docs: DataFrame, shingle: int = 5, per_cent: int = PER_CENT, id_col: str = "doc_id", text_col: str = "text", count_links: bool = False, range_tokens: int = RANGE_TOKENS) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, set_rep, with ``count_links`` n_links, set_key, the text's KEY, and stays.

    ``component_id`` is the smallest id reachable through links (Jaccard of
    shingle sets of at least ``per_cent`` %), itself included; ``set_rep`` is
    the smallest id with an equal set; ``n_links`` is the number of other rows
    that it is linked with, those with an equal set included.  A null or wordless text has no shingles
    and is linked with nothing.  Repeated rows give repeated results, rows with
    one id and different texts are documents of their own.  A row
    with a null id keeps it and is linked with nothing.  ``stays`` marks the rows of the class that stands for a component.  An empty table gives no rows.  Other columns
    are ignored.
    """
    sets = written(document_sets(docs, shingle, id_col, text_col), "sets")
    known = sets.where("set_key IS NOT NULL AND doc_id IS NOT NULL")
    # a class goes by its fingerprint until the end: one id may have several texts
    of_set = [F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("n"), F.count("*").alias("docs")]
    classes = written(known.groupBy("set_key").agg(*of_set).withColumn("rep", F.col("set_key")), "classes")
    total, n_classes = classes.agg(F.sum("n"), F.count("*")).first()
    n_ranges = max(32, -(-(total or 0) // range_tokens))
    n_buckets = max(32, -(-n_classes // BUCKET_SETS))

    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(text_col).alias("text"))
    sent = texts.mapInArrow(_send(n_ranges, n_buckets, shingle), SENT_SQL)
    shared = sent.groupBy("to").applyInArrow(_settle(n_ranges, n_buckets), SENT_SQL)
    buckets = shared.where("part > 0").withColumn("bucket", F.col("part") - 1)
    mine = classes.withColumn("bucket", F.pmod("set_key", F.lit(n_buckets)).cast("int"))
    gathered = buckets.groupBy("bucket").cogroup(mine.groupBy("bucket")).applyInArrow(_gather(per_cent), LIVE_SQL)
    live = written(gathered, "gathered")
    forget_shuffles(docs.sparkSession)  # every shingle has been moved twice by now
    live = written(_rare_first(live), "live")

    keys = live.select("rep", F.posexplode("hashes").alias("salt", "hash")).withColumn("group", F.xxhash64("salt", "hash"))
    counts = keys.groupBy("group").agg(F.count("*").alias("count")).where("count > 1")
    members = keys.join(counts, "group").withColumn("component", F.col("rep")).select("group", "rep", "component", "count")
    near = written(components(_linked(live, members, False, per_cent)), "near")

    prefix = live.select("rep", "n", "tokens").mapInArrow(_prefixes(per_cent), "rep long, token long")
    prefix = prefix.join(near, prefix["rep"] == near["node"], "left").select("rep", "token", F.coalesce("component", "rep").alias("component"))
    prefix = written(prefix, "prefix")
    forget_shuffles(docs.sparkSession)
    # tokens whose members are still in two components or more
    rest = _met(live, prefix, F.col("low") < F.col("high"), per_cent)
    final = components(rest.unionByName(near.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    of_class = classes.join(final, classes["rep"] == final["node"], "left").select("set_key", "rep", "docs", "first_id", F.coalesce("component", "rep").alias("label"))
    if count_links:
        counted = _met(live.join(classes.select("rep", "docs"), "rep"), prefix, F.col("count") > 1, per_cent, count=True)
        of_class = join_on(of_class, counted.groupBy("rep").agg(F.sum("links").alias("links")), ["rep"], "left")
        of_class = of_class.withColumn("n_links", F.col("docs") - 1 + F.coalesce("links", F.lit(0))).drop("links")
    of_class = written(of_class, "of-class")
    # the smallest id, and of its classes the one with the smallest fingerprint, stands for a component
    chosen = of_class.groupBy("label").agg(F.min(F.struct("first_id", "rep")).alias("chosen"))
    of_class = of_class.join(chosen, "label").withColumn("component_id", F.col("chosen.first_id")).withColumn("stays", F.col("chosen.rep") == F.col("rep"))
    out = join_on(sets, of_class.drop("docs", "label", "rep", "chosen"), ["set_key"], "left")
    has_id = F.col("doc_id").isNotNull()
    own = [F.when(has_id, F.coalesce("n_links", F.lit(0))).otherwise(0).alias("n_links")] if count_links else []
    stays = F.coalesce(~has_id | F.col("set_key").isNull() | F.col("stays") & (F.col("first_id") == F.col("doc_id")), F.lit(True)).alias("stays")
    return out.select(F.col("doc_id").alias(id_col), "n_shingles", F.when(has_id, F.coalesce("component_id", "doc_id")).alias("component_id"), F.when(has_id, F.coalesce("first_id", "doc_id")).alias("set_rep"), *own, "set_key", *KEY, stays)


def one_of_each(docs: DataFrame, shingle: int = 5, per_cent: int = PER_CENT, range_tokens: int = RANGE_TOKENS) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and others) but for those near another: of each component one row of its smallest id stays.

    Rows with a null id or a wordless text all stay.  Of rows with one id and
    equal shingles one stays; different texts of one id are judged apart.
    Smaller ranges take less memory in a task and more rows on the way to it.
    """
    told = written(near_duplicate_components(docs, shingle, per_cent, range_tokens=range_tokens), "near-duplicates")
    keyed = with_key(docs)
    rest = join_on(keyed, told.where("NOT stays").select("doc_id", *KEY).distinct(), ["doc_id", *KEY], "left_anti")
    # the rows that stand for a component under one id: one of them
    shown = told.where("stays AND doc_id IS NOT NULL AND n_shingles > 0")
    several = shown.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    if not several.isEmpty():
        again = shown.join(several, "doc_id").select("doc_id", "set_key", *KEY).distinct()
        rows = join_on(rest, again, ["doc_id", *KEY])
        once = rows.groupBy("doc_id", "set_key").agg(F.min(F.struct(*KEY, *[c for c in docs.columns if c != "doc_id"])).alias("row")).select("doc_id", "row.*")
        rest = join_on(rest, again.drop("set_key"), ["doc_id", *KEY], "left_anti").unionByName(once)
    return rest.select(*docs.columns)


def _prefixes(per_cent: int):
    """The tokens by which a set can meet any set that it links with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rep, n, blob in zip(batch["rep"].to_pylist(), batch["n"].to_pylist(), batch["tokens"].to_pylist(), strict=True):
                tokens = kernels.from_planes(blob, WIDTH)
                length = max(0, len(tokens) - -(-per_cent * n // 100) + 1)
                yield pa.RecordBatch.from_arrays([pa.array([rep] * length, pa.int64()), pa.array(tokens[:length].astype(np.int64))], ["rep", "token"])

    return run
