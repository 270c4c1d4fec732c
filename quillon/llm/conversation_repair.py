"""Conversation structure repair by shortest paths on an implicit edit lattice.

A conversation is legal where the initials of its roles match `(s?(ua)+)?`.
What turns it into a legal one is a path through nodes (turn index, grammar
state): keep a row (0), give it the role user or assistant (3), delete it (4;
blank and duplicate rows must go), insert an empty turn (3); a truncated row
that stays adds 3.  Dijkstra's algorithm pops nodes by (cost, audit), where the
audit is the initials of the edits so far, and stops at the first accepting end
node; edges are made when a node is popped.

Rows are sorted by ranges of (conversation, turn), so that a conversation of
any length is dealt over tasks, and cut into blocks of neighbouring rows.  A
conversation of one block is one search.  Of longer ones each block is searched
from every grammar state to every other; these small matrices of (cost, audit)
multiply in a tree.  That is exact: of two cheapest paths between the same
nodes neither audit can be a proper prefix of the other, as it would take
further inserts, so what is less stays less whatever follows.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm._store import Workspace, bounded_batches

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Grammar states: nothing yet, after the system turn, after a user's, after an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
STEPS = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
ACCEPTING = (START, ASSISTANT)
#: Rows of a block, and blocks that one step of the tree multiplies.
BLOCK, FAN = 128, 64
#: A path has one letter an edit: Keep, Delete, U and A for the new role of a row, u and a for an inserted turn.
AUDIT = str.maketrans("UAua", "RRII")
_ENTRIES = "array<struct<source: int, target: int, cost: bigint, path: string>>"
_SUMMARY = f"illegal bigint, first string, last string, entries {_ENTRIES}"

Entries = dict[tuple[int, int], tuple[int, str, str]]


def shortest(codes: str, source: int, first_end: bool = False) -> Entries:
    """(cost, audit, path) from `source` before the first row to states after the
    last, by (source, target); with `first_end` just the best accepting one.
    `codes` has two letters a row: its role's initial (or -) and b, d, t or - for
    blank, duplicate, truncated or sound.
    """
    n, found, closed = len(codes) // 2, {}, set()
    heap = [(0, "", "", 0, source)]
    while heap:
        cost, audit, path, i, state = heapq.heappop(heap)
        if (i, state) in closed:
            continue
        closed.add((i, state))
        if i == n:
            if not first_end:
                found[source, state] = cost, audit, path
            elif state in ACCEPTING:
                return {(source, state): (cost, audit, path)}
        edges = []
        if i < n:
            role, fault = codes[2 * i], codes[2 * i + 1]
            edges.append((DELETE, "D", i + 1, state))
            if fault not in "bd":
                stays = TRUNCATED * (fault == "t")
                for to, target in STEPS[state].items():
                    if to == role:
                        edges.append((KEEP + stays, "K", i + 1, target))
                    elif to != "s":
                        edges.append((REROLE + stays, to.upper(), i + 1, target))
        edges += [(INSERT, to, i, target) for to, target in STEPS[state].items() if to != "s"]
        for more, letter, j, target in edges:
            if (j, target) not in closed:
                heapq.heappush(heap, (cost + more, audit + letter.translate(AUDIT), path + letter, j, target))
    return found


def joined(a: Entries, b: Entries) -> Entries:
    """What follows from going through `a` and then `b`."""
    out: Entries = {}
    for (source, middle), (cost, audit, path) in a.items():
        for (other, target), (more, then, rest) in b.items():
            if other == middle:
                new = cost + more, audit + then, path + rest
                out[source, target] = min(out.get((source, target), new), new)
    return out


def _illegal(roles: str) -> int:
    return sum(pair not in ("su", "ua", "au") for pair in _pairs(roles))


def _pairs(roles: str) -> Iterator[str]:
    return (roles[i : i + 2] for i in range(len(roles) - 1))


def _listed(entries: Entries) -> list[dict]:
    return [{"source": s, "target": t, "cost": c, "path": p} for (s, t), (c, _, p) in entries.items()]


_KIND = pa.list_(pa.struct([("source", pa.int32()), ("target", pa.int32()), ("cost", pa.int64()), ("path", pa.string())]))


def _batch(like: pa.RecordBatch, columns: list[str], rows: list[tuple]) -> pa.RecordBatch:
    """The named columns of `like` beside the summaries `rows`."""
    values = list(zip(*rows)) if rows else [()] * 4
    arrays = [like.column(c) for c in columns] + [pa.array(v, t) for v, t in zip(values, (pa.int64(), pa.string(), pa.string(), _KIND))]
    return pa.record_batch(arrays, [*columns, "illegal", "first", "last", "entries"])


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The summary of each block; a conversation of a single one needs just its best path."""
    for batch in batches:
        rows = []
        for codes, alone, begins in zip(*(batch.column(c).to_pylist() for c in ("codes", "alone", "begins"))):
            entries: Entries = {}
            for source in (START,) if begins else range(4):
                entries |= shortest(codes, source, alone)
            roles = codes[::2]
            rows.append((_illegal(roles), roles[0], roles[-1], _listed(entries)))
        yield _batch(batch, ["conv_id", "block"], rows)


def _multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Summaries of neighbouring blocks, in order, into one."""
    for batch in batches:
        rows = []
        for parts in batch.column("parts").to_pylist():
            total, illegal, last = None, 0, None
            for p in parts:
                entries = {(e["source"], e["target"]): (e["cost"], e["path"].translate(AUDIT), e["path"]) for e in p["entries"]}
                total = entries if total is None else joined(total, entries)
                illegal += p["illegal"] + (_illegal(last + p["first"]) if last else 0)
                last = p["last"]
            rows.append((illegal, parts[0]["first"], last, _listed(total)))
        yield _batch(batch, ["conv_id", "block"], rows)


def damage(rows: DataFrame) -> DataFrame:
    """Conversations with planted faults, by crc32 of `conv_id:turn` modulo 20: 0
    drops a row, 1 empties its text, 2 removes `.`, `!` and `?` from it, 3 repeats
    the row, 4 gives it the role user.  A null counts as one space, in role and
    text too.
    """
    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    marked = rows.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    return marked.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def _ordered(work: Workspace, rows: DataFrame) -> DataFrame:
    """The rows numbered from 0 without gaps (place), conversation by conversation in order of turn (nulls first), role and text.

    The number in the input parts rows that are alike in all columns, so no key is too large for a range.
    """
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    key = ["conv_id", "turn", "role", "text", "came"]
    dealt = rows.withColumn("came", F.monotonically_increasing_id()).repartitionByRange(*key).sortWithinPartitions(*key).drop("came")
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    fault = F.when(last == "", "b").when(~last.isin(".", "!", "?"), "t").otherwise("-")
    written = work.write(dealt.withColumn("fault", fault).withColumn("at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("at", 33)
    counts = written.groupBy(part.alias("part")).count()
    # One row a range: the window is over as many rows as there are ranges.
    offsets = counts.withColumn("before", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "before")
    return written.withColumn("part", part).join(offsets, "part").withColumn("place", F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)).drop("part", "before", "at")


def plan_repairs(work: Workspace, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The ordered rows (conv_id, turn, role, text, fault, place) and, per
    conversation, its place of the first row, counts of faults and gaps, illegal
    pairs, cost and path of its cheapest repair.
    """
    spark = work.spark
    ordered = _ordered(work, rows)
    digest = F.md5("text")
    seen = ordered.where("fault <> 'b'").groupBy("conv_id", "role", digest.alias("digest")).agg(F.min("place").alias("earliest"), F.count("*").alias("n")).where("n > 1").select(F.col("conv_id").alias("c"), F.col("role").alias("r"), "digest", "earliest")
    light = ordered.select("conv_id", "turn", "role", digest.alias("text"), "fault", "place")
    repeated = (F.col("fault") != "b") & F.coalesce(F.col("place") > F.col("earliest"), F.lit(False))
    flagged = light.join(seen, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("text") == F.col("digest")), "left")
    initial = F.substring("role", 1, 1)
    code = F.concat(F.when(initial.isin("s", "u", "a"), initial).otherwise("-"), F.col("fault"))
    flagged = work.write(flagged.withColumn("fault", F.when(repeated, "d").otherwise(F.col("fault"))).select("conv_id", "turn", "place", "fault", code.alias("code")), "flagged")

    by_turn = flagged.groupBy("conv_id", "turn").agg(F.min("place").alias("start"), *[F.sum((F.col("fault") == f).cast("long")).alias(f) for f in "bdt"])
    counts = by_turn.groupBy("conv_id").agg(
        F.min("start").alias("start"), F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"), F.sum("b").alias("blank"), F.sum("d").alias("duplicate"), F.sum("t").alias("truncated"),
    )
    block = F.floor(F.col("place") / BLOCK)
    groups = flagged.groupBy("conv_id", block.alias("block")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "code"))), lambda x: x["code"]), "").alias("codes"))
    groups = work.write(groups, "blocks")
    ends = groups.groupBy(F.col("conv_id").alias("c")).agg(F.min("block").alias("head"), F.max("block").alias("tail"))
    placed = groups.join(ends, F.col("conv_id").eqNullSafe(F.col("c"))).select("conv_id", "block", "codes", (F.col("head") == F.col("tail")).alias("alone"), (F.col("block") == F.col("head")).alias("begins"))
    schema = f"conv_id bigint, block bigint, {_SUMMARY}"
    done = work.write(placed.mapInArrow(_searched, schema), "searched-0")
    span = ends.agg(F.max(F.col("tail") - F.col("head")).alias("most")).first().most or 0
    level = 0
    while span > 0:
        level += 1
        wide = span >= FAN  # else one step is enough, wherever the blocks are
        parts = done.groupBy("conv_id", (F.floor(F.col("block") / FAN) if wide else F.lit(0).cast("long")).alias("group")).agg(F.array_sort(F.collect_list(F.struct("block", "illegal", "first", "last", "entries"))).alias("parts"))
        parts = parts.select("conv_id", F.col("group").alias("block"), F.transform("parts", lambda p: F.struct(p["illegal"].alias("illegal"), p["first"].alias("first"), p["last"].alias("last"), p["entries"].alias("entries"))).alias("parts"))
        done = work.write(parts.mapInArrow(_multiplied, schema), f"searched-{level}")
        span = (span + FAN - 1) // FAN if wide else 0
    audit = lambda e: F.translate(e["path"], "UAua", "RRII")
    ends_well = F.filter("entries", lambda e: (e["source"] == START) & e["target"].isin(*ACCEPTING))
    best = F.array_min(F.transform(ends_well, lambda e: F.struct(e["cost"].alias("cost"), audit(e).alias("audit"), e["path"].alias("path"))))
    paths = done.select(F.col("conv_id").alias("c"), "illegal", best.alias("best"))
    plans = counts.join(paths, F.col("conv_id").eqNullSafe(F.col("c"))).select("conv_id", "start", "gaps", "blank", "duplicate", "truncated", "illegal", "best.cost", "best.audit", "best.path")
    return ordered, work.write(plans, "plans")


def repaired_turns(ordered: DataFrame, plans: DataFrame) -> DataFrame:
    """(conv_id, place, turns) in the order of place: the turns (role, text) that stand there after the repair.

    Before a row come those inserted there; deleted rows leave none of their own.
    """
    token = plans.select("conv_id", "start", F.posexplode(F.regexp_extract_all("path", F.lit("[ua]*[KDUA]|[ua]+$"), F.lit(0))).alias("k", "edits")).select(F.col("conv_id").alias("c"), (F.col("start") + F.col("k")).alias("place"), "edits")
    # A trailing insert has the place of the next conversation's first row: the join asks for both keys.
    both = token.join(ordered.select("conv_id", F.col("place").alias("p"), "role", "text"), F.col("c").eqNullSafe(F.col("conv_id")) & (F.col("place") == F.col("p")), "left")
    added = F.transform(F.regexp_extract_all("edits", F.lit("[ua]"), F.lit(0)), lambda x: F.struct(F.when(x == "u", "user").otherwise("assistant").alias("role"), F.lit("").alias("text")))
    own = F.substring("edits", -1, 1)
    role = F.when(own == "U", "user").when(own == "A", "assistant").otherwise(F.col("role"))
    stays = F.when(own.isin("K", "U", "A"), F.array(F.struct(role.alias("role"), F.col("text").alias("text")))).otherwise(F.array().cast("array<struct<role: string, text: string>>"))
    return both.select(F.col("c").alias("conv_id"), "place", F.concat(added, stays).alias("turns"))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's lines, which come in order: one hash is open at a time."""
    open_id, digest, lines, begun = None, None, False, False
    ids: list[int | None] = []
    sums: list[str] = []
    for batch in batches:
        for conv, text in zip(batch.column("conv_id").to_pylist(), batch.column("lines").to_pylist()):
            if not begun or conv != open_id:
                if begun:
                    ids.append(open_id)
                    sums.append(digest.hexdigest())
                open_id, digest, lines, begun = conv, hashlib.sha256(), False, True
            if text is not None:
                digest.update(("\n" + text if lines else text).encode())
                lines = True
        yield pa.record_batch({"c": pa.array(ids, pa.int64()), "repaired_sha256": pa.array(sums, pa.string())})
        ids, sums = [], []
    if begun:
        yield pa.record_batch({"c": pa.array([open_id], pa.int64()), "repaired_sha256": pa.array([digest.hexdigest()])})


def repair(spark: SparkSession, rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Per conversation of `rows` (conv_id, turn, role, text) and of `ids`: gaps,
    blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows go by turn, nulls first, ties by role and text; null roles and texts
    count as one space, an empty role has no legal place; rows with a null conv_id are one conversation.  A row's
    first fault counts: blank (no character but white space), duplicate (role and
    text seen before), truncated (the last other character is none of `.!?`).  Of
    equally cheap repairs the least audit counts.  A conversation of `ids` without
    rows has zeros, an empty audit and the hash of nothing.  Other columns are not
    read.

    The hash is of the whole repaired conversation, so its lines go through one
    task, in order and a batch at a time; all else of a long conversation is
    dealt.
    """
    work = Workspace(spark, "conversations")
    with bounded_batches(spark):
        ordered, plans = plan_repairs(work, rows)
        turns = repaired_turns(ordered, plans)
        lines = F.when(F.size("turns") > 0, F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n"))
        sums = work.write(turns.select("conv_id", "place", lines.alias("lines")).repartition("conv_id").sortWithinPartitions("conv_id", "place").select("conv_id", "lines").mapInArrow(_hashed, "c bigint, repaired_sha256 string"), "hashes")
    whole = plans.join(sums, F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c", "start", "path")
    if ids is not None:
        every = ids.select(F.col("conv_id").cast("long").alias("k")).distinct()
        whole = every.join(whole, F.col("k").eqNullSafe(F.col("conv_id")), "left").drop("conv_id").withColumnRenamed("k", "conv_id")
    numbers = [F.coalesce(n, F.lit(0).cast("long")).cast("long").alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return whole.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
