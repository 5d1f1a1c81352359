"""Repair of the structure of conversations at least cost.

A repaired conversation's roles read ``(s?(ua)+)?``: nothing, or a system turn
if any and then user and assistant in turns.  A row may be kept (0), change its
role to user or assistant (3) or be deleted (4; required for blank rows and for
repetitions), and empty turns of the user or assistant may be inserted (3); a
truncated row that stays costs 3 more.  The cheapest edits are found by a
recursive DuckDB query over a whole batch of conversations: each recursion
advances one turn of every conversation of the batch and keeps, for each state of
the grammar, the least cost and of equally cheap audits (the edits' initials) the
first in ASCII order.  Two audits of the same rows are never prefixes of each
other, so the best of a state is the best start of whatever follows.

Batches are hash partitions of bounded size.  A conversation beyond a batch is
cut into segments by a distributed sort; the same query runs on a segment from
every state that it may begin in, and segments are joined by their costs and
audits alone.  Rows that repeat as a whole within a long conversation travel as
one row with a count, and texts seen in earlier segments are known by a hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taleweave.llm.frames import join_on
from taleweave.llm.scratch import written

BATCH_ROWS, BATCH_BYTES = 2048, 8 << 20  # mean of a batch
LONG_ROWS, LONG_BYTES = 1024, 4 << 20  # a conversation beyond is cut into segments of this size
GAP = r"\x20\x09-\x0D"  # characters between words

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)  # states: the last role of what is kept
FINE, CUT, GONE = range(3)  # kinds of rows: fine, truncated, to be deleted
#: What may follow a state, and the state that it leads to.
FOLLOWS = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
NAMES = {"u": "user", "a": "assistant"}


def _turn(state: int) -> str:
    """The role that an inserted or changed row has after ``state``."""
    return "a" if state == USER else "u"


def _inserted(state: int, n: int) -> int:
    for _ in range(n):
        state = FOLLOWS[state][_turn(state)]
    return state


def steps() -> list[tuple[int, str, int, int, str, int]]:
    """(state, initial, kind, next state, letters, cost) of all ways to go on by a row.

    Insertions come before a row that stays; before a deleted one they would
    only come later in ASCII order than after it.  More than two never pay.
    """
    out = []
    for state in FOLLOWS:
        for initial in "sua?":
            for kind in (FINE, CUT, GONE):
                out.append((state, initial, kind, state, "D", DELETE))
                for n in range(3 if kind != GONE else 0):
                    at, extra = _inserted(state, n), n * INSERT + (TRUNCATED if kind == CUT else 0)
                    if initial in FOLLOWS[at]:
                        out.append((state, initial, kind, FOLLOWS[at][initial], "I" * n + "K", extra))
                    out.append((state, initial, kind, FOLLOWS[at][_turn(at)], "I" * n + "R", extra + REROLE))
    return out


#: Letters at the end of a conversation, and their cost.
ENDS = {START: ("", 0), SYSTEM: ("II", 2 * INSERT), USER: ("I", INSERT), ASSISTANT: ("", 0)}

MARKED = rf"""
CREATE TEMP TABLE marked AS
WITH placed AS (
  SELECT *, dense_rank() OVER (ORDER BY conv_id NULLS FIRST, segment) AS g,
         row_number() OVER (PARTITION BY conv_id, segment ORDER BY seen DESC, turn NULLS FIRST, role, text) - count(*) FILTER (WHERE seen) OVER (PARTITION BY conv_id, segment) AS pos
  FROM rows_in),
known AS (
  SELECT *, row_number() OVER (PARTITION BY g, key, CASE WHEN key IS NULL THEN role END, CASE WHEN key IS NULL THEN text END ORDER BY pos) > 1 AS again
  FROM placed),
judged AS (
  SELECT g, conv_id, segment, role, text, copies, pos, again, substr(role, 1, 1) AS initial,
         NOT regexp_matches(text, '[^{GAP}]') AS blank,
         NOT regexp_matches(text, '[.!?][{GAP}]*\z') AS cut
  FROM known WHERE NOT seen)
SELECT *, CASE WHEN initial IN ('s', 'u', 'a') THEN initial ELSE '?' END AS known,
       CASE WHEN blank OR again THEN {GONE} WHEN cut THEN {CUT} ELSE {FINE} END AS kind,
       lag(initial) OVER (PARTITION BY g ORDER BY pos) AS before
FROM judged
"""

FAULTS = """
SELECT g, any_value(conv_id) AS conv_id, any_value(segment) AS segment,
       CAST(sum(CASE WHEN blank THEN copies ELSE 0 END) AS BIGINT) AS blank,
       CAST(sum(CASE WHEN blank THEN 0 ELSE copies - 1 + CAST(again AS BIGINT) END) AS BIGINT) AS duplicate,
       CAST(sum(CASE WHEN kind = 1 THEN 1 ELSE 0 END) AS BIGINT) AS truncated,
       CAST(sum(copies - 1 + CASE WHEN before IS NULL OR before || initial IN ('su', 'ua', 'au') THEN 0 ELSE 1 END) AS BIGINT) AS illegal,
       arg_min(initial, pos) AS first_initial, arg_max(initial, pos) AS last_initial
FROM marked GROUP BY g ORDER BY g
"""

#: One recursion advances one turn of every conversation; USING KEY keeps the newest row of each state.
PATHS = f"""
WITH RECURSIVE lengths AS (SELECT g, max(pos) AS n FROM marked GROUP BY g),
path(g, entry, state, pos, best) USING KEY (g, entry, state) AS (
  SELECT g, entry, entry, CAST(0 AS BIGINT), {{'cost': CAST(0 AS BIGINT), 'audit': ''}} FROM lengths, entries
  UNION
  SELECT p.g, p.entry, s.next, m.pos,
         min({{'cost': p.best.cost + s.cost + {DELETE} * (m.copies - 1), 'audit': p.best.audit || s.letters || repeat('D', m.copies - 1)}})
  FROM path p JOIN marked m ON m.g = p.g AND m.pos = p.pos + 1
  JOIN steps s ON s.state = p.state AND s.initial = m.known AND s.kind = m.kind
  GROUP BY p.g, p.entry, s.next, m.pos)
SELECT g, entry, state AS exit, best.cost AS cost, best.audit AS audit FROM path JOIN lengths USING (g) WHERE pos = n ORDER BY g, entry, exit
"""

TURN = "struct<role: string, text: string, edit: string>"
FAULT = "blank long, duplicate long, truncated long, illegal long"
PIECE = f"conv_id long, segment int, {FAULT}, cost long, audit string, turns array<{TURN}>"
WAY = f"conv_id long, segment int, {FAULT}, first_initial string, last_initial string, entry int, exit int, cost long, audit string"
CHOSEN = f"conv_id long, segment int, {FAULT}, entry int, cost long, audit string"


def _paths(rows: pa.Table, entries: list[int]) -> tuple[dict, dict, dict]:
    """The rows in order, their faults, and the best ways through each group from each entry to each exit."""
    import duckdb

    con = duckdb.connect(config={"threads": 1, "temp_directory": ""})
    try:
        con.register("rows_in", rows)
        con.register("steps", pa.table(dict(zip(("state", "initial", "kind", "next", "letters", "cost"), zip(*steps(), strict=True), strict=True))))
        con.register("entries", pa.table({"entry": pa.array(entries, pa.int32())}))
        con.execute(MARKED)
        kept, faults, ways = (con.sql(q).to_arrow_table().to_pydict() for q in ("SELECT g, role, text, copies FROM marked ORDER BY g, pos", FAULTS, PATHS))
    finally:
        con.close()
    return kept, faults, ways


def applied(audit: str, entry: int, rows: list[tuple[str, str, int]]) -> list[dict]:
    """The repaired turns; ``rows`` are (role, text, copies)."""
    out, state, at, left = [], entry, 0, 0
    for letter in audit:
        if letter == "I":
            initial = _turn(state)
            out.append({"role": NAMES[initial], "text": "", "edit": letter})
        else:
            if left:  # further copies of the row before are always deleted
                left -= 1
                continue
            role, text, copies = rows[at]
            at, left = at + 1, copies - 1
            if letter == "D":
                continue
            initial = role[0] if letter == "K" else _turn(state)
            out.append({"role": role if letter == "K" else NAMES[initial], "text": text, "edit": letter})
        state = FOLLOWS[state][initial]
    return out


def _rows_of(kept: dict) -> dict[int, list[tuple[str, str, int]]]:
    out: dict[int, list] = {}
    for g, role, text, copies in zip(kept["g"], kept["role"], kept["text"], kept["copies"], strict=True):
        out.setdefault(g, []).append((role, text, copies))
    return out


def _repair_batch(types: pa.Schema):
    def repair_batch(rows: pa.Table) -> pa.Table:
        """Whole conversations: one piece each."""
        kept, faults, ways = _paths(rows, [START])
        best: dict[int, tuple[int, str]] = {}
        for g, state, cost, audit in zip(ways["g"], ways["exit"], ways["cost"], ways["audit"], strict=True):
            letters, more = ENDS[state]
            best[g] = min(best.get(g, (2**62, "")), (cost + more, audit + letters))
        own = _rows_of(kept)
        faults["cost"] = [best[g][0] for g in faults["g"]]
        faults["audit"] = [best[g][1] for g in faults["g"]]
        faults["turns"] = [applied(best[g][1], START, own[g]) for g in faults["g"]]
        return pa.table({x: faults[x] for x in types.names}, schema=types)

    return repair_batch


def _ways_of_segment(types: pa.Schema):
    def ways_of_segment(rows: pa.Table) -> pa.Table:
        """A segment of a long conversation: the best way from every state to every state."""
        _, faults, ways = _paths(rows, [START, SYSTEM, USER, ASSISTANT])
        n = len(ways["g"])
        return pa.table({x: ways[x] if x in ways else faults[x] * n for x in types.names}, schema=types)

    return ways_of_segment


def _join_segments(types: pa.Schema):
    def join_segments(ways: pa.Table) -> pa.Table:
        """The way through all segments of a conversation: the audit of each, and what it costs.

        Audits of the same rows are no prefixes of each other, so their order is
        that of the states' ranks after the segment before, then of the last pieces.
        """
        ways = ways.sort_by([("segment", "ascending"), ("entry", "ascending"), ("exit", "ascending")]).to_pydict()
        segments: list[dict] = []
        for k, segment in enumerate(ways["segment"]):
            if not segments or segments[-1]["segment"] != segment:
                segments.append({x: ways[x][k] for x in ("conv_id", "segment", "blank", "duplicate", "truncated", "illegal", "first_initial", "last_initial")} | {"ways": []})
            segments[-1]["ways"].append((ways["entry"][k], ways["exit"][k], ways["cost"][k], ways["audit"][k]))
        at = {START: (0, 0)}  # state: cost, rank of the audit among the states
        back: list[dict[int, tuple[int, str, int]]] = []
        for segment in segments:
            best: dict[int, tuple] = {}
            for entry, to, cost, audit in segment["ways"]:
                if entry in at:
                    found = (at[entry][0] + cost, at[entry][1], audit, entry, cost)
                    best[to] = min(best.get(to, found), found)
            ranks = {state: r for r, state in enumerate(sorted(best, key=lambda s: best[s][1:3]))}
            at = {state: (x[0], ranks[state]) for state, x in best.items()}
            back.append({state: (x[3], x[2], x[4]) for state, x in best.items()})
        state = min(at, key=lambda s: (at[s][0] + ENDS[s][1], at[s][1]))
        letters, more = ENDS[state]
        for segment, ways_back in zip(reversed(segments), reversed(back), strict=True):
            state, audit, cost = ways_back[state]
            segment |= {"entry": state, "audit": audit + letters, "cost": cost + more}
            letters, more = "", 0
        for a, b in zip(segments, segments[1:], strict=False):
            b["illegal"] += a["last_initial"] + b["first_initial"] not in ("su", "ua", "au")
        return pa.table({x: [s[x] for s in segments] for x in types.names}, schema=types)

    return join_segments


def _apply_segment(types: pa.Schema):
    def apply_segment(rows: pa.Table, chosen: pa.Table) -> pa.Table:
        rows = rows.to_pydict()
        order = sorted(range(len(rows["role"])), key=lambda i: (rows["turn"][i] is not None, rows["turn"][i] or 0, rows["role"][i].encode(), rows["text"][i].encode()))
        own = [(rows["role"][i], rows["text"][i], rows["copies"][i]) for i in order]
        c = chosen.to_pylist()[0]
        return pa.table({x: [applied(c["audit"], c["entry"], own) if x == "turns" else c[x]] for x in types.names}, schema=types)

    return apply_segment


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): rows as crc32(``conv_id:turn``) % 20 damages them; null ids, turns, roles and texts count as one space.

    0 drops a row, 1 empties its text, 2 removes its ``[.!?]``, 3 doubles it and 4 makes it the user's.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat_ws(":", space("conv_id"), space("turn")).cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), h.alias("h"))
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("h") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("h") == 0, 0).when(F.col("h") == 3, 2).otherwise(1).cast("long").alias("copies"))


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pieces of the repaired conversations, and the profile of all conversations.

    ``rows`` has conv_id, turn, role, text and copies (how often the row stands
    there, one after the other; 0: only its conversation is known).  No role or
    text is null.  Rows go by turn, nulls first, then by role and text.  A role
    whose first character isn't s, u or a can't be kept, nor can an empty one.

    Pieces: conv_id, segment (-1: the whole conversation), blank, duplicate,
    truncated, illegal, cost, audit, turns (role, text, edit).  The pieces of a
    conversation follow each other by segment; their numbers add up.  A
    conversation without rows has none.  Profile: conv_id, n_rows, gaps.
    """
    n_bytes = F.octet_length("role") + F.octet_length("text")
    there = F.when(F.col("copies") > 0, F.col("turn"))
    profile = rows.groupBy("conv_id").agg(
        F.sum(F.when(F.col("copies") > 0, 1).otherwise(0)).alias("n_rows"),
        F.sum(F.when(F.col("copies") > 0, n_bytes).otherwise(0)).alias("n_bytes"),
        F.coalesce(F.max(there) - F.min(there) + 1 - F.count_distinct(there), F.lit(0)).alias("gaps"),
    )
    profile = written(profile, "conversations")
    is_long = (F.col("n_rows") > LONG_ROWS) | (F.col("n_bytes") > LONG_BYTES)
    zero = F.lit(0).cast("long")
    total = profile.agg(
        F.sum("n_rows").alias("rows"),
        F.sum("n_bytes").alias("bytes"),
        F.sum(F.when(is_long, F.col("n_rows")).otherwise(zero)).alias("long_rows"),
        F.sum(F.when(is_long, F.col("n_bytes")).otherwise(zero)).alias("long_bytes"),
    ).first()
    present = rows.where("copies > 0")
    if total["long_rows"]:
        flag = profile.where(is_long).select("conv_id", F.lit(True).alias("long"))
        present = join_on(present, flag, ["conv_id"], "left")
        short, long = present.where("long IS NULL").drop("long"), present.where("long").drop("long")
    else:
        short, long = present, None
    n_batches = int(max(1, (total["rows"] or 0) // BATCH_ROWS, (total["bytes"] or 0) // BATCH_BYTES)) if total["rows"] else 1
    blank = {"segment": F.lit(-1), "key": F.lit(None).cast("string"), "seen": F.lit(False)}
    batches = short.withColumns(blank).withColumn("batch", F.pmod(F.xxhash64("conv_id"), F.lit(n_batches)))
    pieces = batches.groupBy("batch").applyInArrow(_repair_batch(_arrow(PIECE)), PIECE)
    if long is not None:
        pieces = pieces.unionByName(_repair_long(long, int(max(total["long_rows"] // LONG_ROWS, total["long_bytes"] // LONG_BYTES, 1))))
    return written(pieces, "repaired"), profile.select("conv_id", "n_rows", "gaps")


def _repair_long(rows: DataFrame, n_segments: int) -> DataFrame:
    order = ["conv_id", "turn", "role", "text"]
    rows = rows.groupBy(*order).agg(F.sum("copies").alias("copies")).repartitionByRange(n_segments, *order)
    rows = written(rows.withColumn("segment", F.spark_partition_id()), "segments")
    key = F.sha2(F.to_binary(F.concat_ws(":", F.octet_length("role"), "role", "text"), F.lit("utf-8")), 256)
    rows = rows.withColumn("key", key).withColumn("seen", F.lit(False))
    # what earlier segments have seen: a row a segment and key
    held = rows.select("conv_id", "segment", "key").distinct()
    before = held.withColumn("first", F.min("segment").over(Window.partitionBy("conv_id", "key"))).where("segment > first")
    nothing = {"turn": F.lit(None).cast("long"), "role": F.lit(""), "text": F.lit(""), "copies": F.lit(0).cast("long"), "seen": F.lit(True)}
    both = rows.unionByName(before.drop("first").withColumns(nothing))
    ways = both.groupBy("conv_id", "segment").applyInArrow(_ways_of_segment(_arrow(WAY)), WAY)
    chosen = written(ways.groupBy("conv_id").applyInArrow(_join_segments(_arrow(CHOSEN)), CHOSEN), "chosen")
    pairs = rows.select(*order, "copies", "segment").groupBy("conv_id", "segment").cogroup(chosen.groupBy("conv_id", "segment"))
    return pairs.applyInArrow(_apply_segment(_arrow(PIECE)), PIECE)


def _lines(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")


def _streamed(types: pa.Schema):
    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """SHA-256 of the lines of a conversation's pieces, which come one after the other."""
        now, sha, some = None, hashlib.sha256(), False
        done: list[tuple] = []
        for batch in batches:
            for conv, part, line in zip(*(batch[x].to_pylist() for x in ("conv_id", "has_turns", "lines")), strict=True):
                if now is None or now[0] != conv:
                    if now is not None:
                        done.append((now[0], sha.hexdigest()))
                    now, sha, some = (conv,), hashlib.sha256(), False
                if part:
                    sha.update((b"\n" if some else b"") + line.encode())
                    some = True
        if now is not None:
            done.append((now[0], sha.hexdigest()))
        yield pa.RecordBatch.from_pylist([{"conv_id": c, "repaired_sha256": s} for c, s in done], schema=types)

    return streamed


def summary(pieces: DataFrame, profile: DataFrame) -> DataFrame:
    """One row a conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    counts = ("blank", "duplicate", "truncated", "illegal", "cost")
    whole = pieces.where("segment < 0").select("conv_id", *counts, "audit", F.sha2(_lines(F.col("turns")).cast("binary"), 256).alias("repaired_sha256"))
    parts = pieces.where("segment >= 0")
    # the text of a long conversation is hashed in order, a piece at a time
    lines = parts.select("conv_id", "segment", (F.size("turns") > 0).alias("has_turns"), _lines(F.col("turns")).alias("lines"))
    hashed = lines.repartition("conv_id").sortWithinPartitions("conv_id", "segment").select("conv_id", "has_turns", "lines")
    hashes = hashed.mapInArrow(_streamed(_arrow("conv_id long, repaired_sha256 string")), "conv_id long, repaired_sha256 string")
    audit = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("segment", "audit"))), lambda p: p["audit"]), "")
    joined = join_on(parts.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in counts], audit.alias("audit")), hashes, ["conv_id"])
    out = join_on(profile, whole.unionByName(joined), ["conv_id"], "left")
    empty = hashlib.sha256().hexdigest()
    return out.select("conv_id", "gaps", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
