"""Conversation structure repair by a lightest-derivation agenda.

A conversation is repaired when its role initials read ``(s?(ua)+)?``: an optional system turn,
then user and assistant in turn, or nothing. A row may be kept (cost 0), given the role user or
assistant (2) or deleted (3); turns without text may be inserted anywhere (2); a blank or
repeated row must be deleted, and a truncated one that stays adds 1. The repair is the cheapest
one, and of the cheapest that whose edits, written as initials (``audit``), come first.

The edits are weighted deductions in a hypergraph. Items are ``(i, q)``: the first i rows are
repaired and the roles so far leave the automaton in state q. A rule joins a prefix item with
the item of a row (what that row can become) or lets a turn be inserted; its weight is a
superior function: costs add up, audits are appended. Knuth's algorithm pops the agenda in the
order of (cost, audit) and never revises a popped item, until the goal item is popped. (Two
audits of one item at one cost never stand in a prefix relation, since they spend the same
edits on the same rows, so appending keeps their order.)

At scale: rows are put in order by one range shuffle, and a conversation is cut into slices of
at most ``SLICE`` rows, wherever it lies. Each slice is solved by itself from every state it may
begin in, anywhere in the cluster; then one more agenda per conversation joins slice items
instead of rows. So a conversation with a third of all rows meets no single task before its
audit, which is one value of the result. First occurrences are aggregates by digest; texts are
joined to the edits by a key of their own row. The text of a repaired conversation is hashed as
a stream of sorted rows, never gathered.

Edge cases: a null role or text is one space, as is a null conv_id or turn in the damage key;
null conversations are one conversation; null turns come first; rows that tie in their turn go
by role, then text; equal rows count separately; a role without an initial fits nowhere; texts
of any length are read whole; an empty table gives no rows; other columns are not read, so
clashing names do not matter.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Hashable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import cut, scope

SLICE_BITS = 9
SLICE = 1 << SLICE_BITS
INSERT, DELETE, REROLE, TRUNCATED = 2, 3, 2, 1
# states: B nothing yet, S after the system turn, U after a user, A after an assistant
STEP = {"B": {"s": "S", "u": "U"}, "S": {"u": "U"}, "U": {"a": "A"}, "A": {"u": "U"}}
STATES, GOALS = "BSUA", "BA"
ROLES = {"u": "user", "a": "assistant"}
VISIBLE = "[^\\x20\\x09-\\x0D]"

Weight = tuple[int, str]
Item = Hashable
Rule = Callable[[Item], Iterator[tuple[Item, Weight]]]


# ---- the agenda ---------------------------------------------------------------------------

def lightest(axioms: dict[Item, Weight], rule: Rule, goals: set[Item] | None = None,
             back: dict[Item, Item] | None = None) -> dict[Item, Weight]:
    """Lightest derivation of each item that is popped; ends early when a goal is.

    ``rule`` gives the items that follow from a popped one and what they add. ``back`` receives
    the item that each popped one came from.
    """
    agenda = [(w, n, item, None) for n, (item, w) in enumerate(axioms.items())]
    heapq.heapify(agenda)
    done: dict[Item, Weight] = {}
    pushed = len(agenda)
    while agenda:
        weight, _, item, origin = heapq.heappop(agenda)
        if item in done:
            continue
        done[item] = weight
        if back is not None:
            back[item] = origin
        if goals and item in goals:
            break
        for new, (cost, audit) in rule(item):
            if new not in done:
                heapq.heappush(agenda, ((weight[0] + cost, weight[1] + audit), pushed, new, item))
                pushed += 1
    return done


def row_items(initial: str, fault: str) -> list[tuple[str, Weight]]:
    """What a row can become: "" (deleted) or a role initial, each with its weight."""
    out = [("", (DELETE, "D"))]
    if fault not in "bd":
        late = TRUNCATED if fault == "t" else 0
        out += [(r, (late, "K") if r == initial else (REROLE + late, "R")) for r in "ua"]
        if initial == "s":
            out.append(("s", (late, "K")))
    return out


def solve_slice(initials: str, faults: str) -> dict[tuple[str, str], Weight]:
    """Lightest repair of consecutive rows for each pair of states before and after them."""
    rows = [row_items(*x) for x in zip(initials, faults)]
    n, out = len(rows), {}

    def rule(item: Item) -> Iterator[tuple[Item, Weight]]:
        i, q = item
        for role in "ua":
            if role in STEP[q]:
                yield (i, STEP[q][role]), (INSERT, "I")
        if i < n:
            for role, weight in rows[i]:
                if not role:
                    yield (i + 1, q), weight
                elif role in STEP[q]:
                    yield (i + 1, STEP[q][role]), weight

    for start in STATES:
        found = lightest({(0, start): (0, "")}, rule)
        out |= {(start, q): found[n, q] for q in STATES if (n, q) in found}
    return out


def join_slices(slices: list[dict[tuple[str, str], Weight]]) -> tuple[Weight, list[tuple[str, str]]]:
    """Lightest repair of a conversation, and the states before and after each of its slices."""
    n = len(slices)

    def rule(item: Item) -> Iterator[tuple[Item, Weight]]:
        i, q = item
        if i < n:
            for end in STATES:
                if (q, end) in slices[i]:
                    yield (i + 1, end), slices[i][q, end]

    back: dict[Item, Item] = {}
    done = lightest({(0, "B"): (0, "")}, rule, {(n, q) for q in GOALS}, back)
    *_, goal = done
    path, item = [], goal
    while back[item] is not None:
        path.append((back[item][1], item[1]))
        item = back[item]
    return done[goal], path[::-1]


def spell(audit: str, state: str, initials: str) -> list[tuple[int | None, str | None]]:
    """(row, new role) of each turn that an audit leaves; an inserted turn has no row, a kept
    one no new role."""
    out, i = [], 0
    for edit in audit:
        role = next(r for r in STEP[state] if r != "s") if edit in "IR" else None
        if edit == "I":
            out.append((None, ROLES[role]))
        else:
            if edit == "R":
                out.append((i, ROLES[role]))
            elif edit == "K":
                role = initials[i]
                out.append((i, None))
            i += 1
        if edit != "D":
            state = STEP[state][role]
    return out


# ---- damage -------------------------------------------------------------------------------

def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after damage by CRC-32 of ``conv_id:turn``; a dropped row stays
    with ``gone``, so that its conversation is known."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"),
                   F.coalesce(F.col("turn").cast("string"), blank))
    kind = F.crc32(key.cast("binary")) % 20
    text = F.coalesce("text", blank)
    text = (F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", ""))
            .otherwise(text))
    role = F.when(kind == 4, "user").otherwise(F.coalesce("role", blank))
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(F.col("conv_id"), F.col("turn").cast("long").alias("turn"),
                       role.alias("role"), text.alias("text"), (kind == 0).alias("gone"),
                       F.explode(copies).alias("copy")).drop("copy")


# ---- the job ------------------------------------------------------------------------------

def _initial(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first.isin("s", "u", "a"), first).otherwise("x")


def ordered(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, gone) with ``at``, which follows the conversation and
    the order in it, and what the repair must know of the text, as a written table."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv_id", "turn", "role", "text", "uid"]  # uid: equal rows may be dealt apart
    laid = (rows.withColumn("uid", F.monotonically_increasing_id())
            .repartitionByRange(parts, *order).sortWithinPartitions(*order)
            .withColumn("at", F.monotonically_increasing_id()).drop("uid"))
    seen = F.regexp_extract("text", f"({VISIBLE})[\\x20\\x09-\\x0D]*\\z", 1)
    return cut(laid.select(
        "*", _initial(F.col("role")).alias("initial"), (seen == "").alias("blank"),
        (~seen.isin(".", "!", "?")).alias("open"),
        F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256).alias("digest")),
        "repair-rows")


def faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, at, initial, fault of every row (of :func:`ordered`) that is not gone;
    a fault is b(lank), d(uplicate), t(runcated) or n(one)."""
    some = rows.where(~F.col("gone"))
    first = (some.groupBy("conv_id", "digest").agg(F.min("at").alias("at"))
             .select("at", F.lit(True).alias("first")))
    fault = (F.when(F.col("blank"), "b").when(F.col("first").isNull(), "d")
             .when(F.col("open"), "t").otherwise("n"))
    return (some.select("conv_id", "turn", "at", "initial", "blank", "open")
            .join(first, "at", "left")
            .select("conv_id", "turn", "at", "initial", fault.alias("fault")))


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices (conv_id, slice, initials, faults) with the items of :func:`solve_slice`."""
    for batch in batches:
        items = [[{"start": a, "end": b, "cost": w[0], "audit": w[1]}
                  for (a, b), w in solve_slice(i, f).items()]
                 for i, f in zip(batch["initials"].to_pylist(), batch["faults"].to_pylist())]
        kind = pa.list_(pa.struct([("start", pa.string()), ("end", pa.string()),
                                   ("cost", pa.int64()), ("audit", pa.string())]))
        yield pa.RecordBatch.from_arrays(
            [batch["conv_id"], batch["slice"], batch["initials"], pa.array(items, kind)],
            names=["conv_id", "slice", "initials", "items"])


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations (conv_id, illegal, parts) with cost, audit, the path through their slices."""
    path = pa.list_(pa.struct([("slice", pa.int64()), ("start", pa.string()),
                               ("audit", pa.string())]))
    for batch in batches:
        costs, audits, paths = [], [], []
        for parts in batch["parts"].to_pylist():
            slices = [{(x["start"], x["end"]): (x["cost"], x["audit"]) for x in p["items"]}
                      for p in parts]
            (cost, audit), way = join_slices(slices)
            costs.append(cost)
            audits.append(audit)
            paths.append([{"slice": p["slice"], "start": q[0], "audit": s[q][1]}
                          for p, s, q in zip(parts, slices, way)])
        yield pa.RecordBatch.from_arrays(
            [batch["conv_id"], batch["illegal"], pa.array(costs, pa.int64()),
             pa.array(audits, pa.string()), pa.array(paths, path)],
            names=["conv_id", "illegal", "cost", "audit", "path"])


def _spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns (conv_id, slice, seq, at, role) of slices (conv_id, slice, start, audit, ats,
    initials); ``at`` is null for an inserted turn, ``role`` for a kept one."""
    for batch in batches:
        source, seqs, ats, roles = [], [], [], []
        columns = [batch[c].to_pylist() for c in ("start", "audit", "ats", "initials")]
        for n, (start, audit, at, initials) in enumerate(zip(*columns)):
            turns = spell(audit, start, initials)
            source += [n] * len(turns)
            seqs += range(len(turns))
            ats += [None if i is None else at[i] for i, _ in turns]
            roles += [role for _, role in turns]
        index = pa.array(source, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch["conv_id"].take(index), batch["slice"].take(index), pa.array(seqs, pa.int64()),
             pa.array(ats, pa.int64()), pa.array(roles, pa.string())],
            names=["conv_id", "slice", "seq", "at", "role"])


def _hash_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the newline-joined lines of each conversation; rows come sorted by it."""
    key = digest = None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([key, pa.array([digest.hexdigest()])],
                                          names=["conv_id", "repaired_sha256"])

    for batch in batches:
        convs = batch["conv_id"].to_pylist()
        for i, line in enumerate(batch["line"]):
            if digest is None or convs[i] != key[0].as_py():
                if digest is not None:
                    yield row()
                key, digest = batch["conv_id"].slice(i, 1), hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(line.as_buffer())
    if digest is not None:
        yield row()


class Repairs(NamedTuple):
    """``rows`` in order; ``marked``: their faults; ``slices``: conv_id, slice, ats, initials,
    faults; ``solved``: conv_id, illegal, cost, audit and the path through its slices."""

    rows: DataFrame
    marked: DataFrame
    slices: DataFrame
    solved: DataFrame


def repairs(rows: DataFrame) -> Repairs:
    """The lightest repair of every conversation of ``rows`` (as :func:`damaged` returns them)."""
    rows = ordered(rows)
    kind = dict(rows.dtypes)["conv_id"]
    marked = cut(faults(rows), "repair-faults")
    row = F.struct("at", "initial", "fault")
    slices = (marked.groupBy("conv_id", F.shiftright("at", SLICE_BITS).alias("slice"))
              .agg(F.sort_array(F.collect_list(row)).alias("r"))
              .select("conv_id", "slice", F.col("r.at").alias("ats"),
                      F.array_join("r.initial", "").alias("initials"),
                      F.array_join("r.fault", "").alias("faults")))
    slices = cut(slices, "repair-slices")
    items = slices.select("conv_id", "slice", "initials", "faults").mapInArrow(
        _solve, f"conv_id {kind}, slice long, initials string, "
                "items array<struct<start string, end string, cost long, audit string>>")
    whole = items.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("slice", "initials", "items"))).alias("parts"))
    text = F.array_join("parts.initials", "")
    fits = F.regexp_count(text, F.lit("s(?=u)|u(?=a)|a(?=u)"))
    illegal = (F.length(text) - 1 - fits).cast("long")
    solved = whole.select("conv_id", illegal.alias("illegal"), "parts").mapInArrow(
        _join, f"conv_id {kind}, illegal long, cost long, audit string, "
               "path array<struct<slice long, start string, audit string>>")
    return Repairs(rows, marked, slices, cut(solved, "repair-solved"))


def repaired_turns(found: Repairs) -> DataFrame:
    """conv_id, slice, seq, role, text of every turn after repair, in the order of (slice, seq)."""
    kind = dict(found.rows.dtypes)["conv_id"]
    way = (found.solved.withColumnRenamed("conv_id", "c").select("c", F.explode("path").alias("p"))
           .select("c", F.col("p.slice").alias("s"), "p.start", "p.audit"))
    todo = found.slices.join(
        way, (F.col("slice") == F.col("s")) & F.col("conv_id").eqNullSafe(F.col("c")))
    turns = todo.select("conv_id", "slice", "start", "audit", "ats", "initials").mapInArrow(
        _spell, f"conv_id {kind}, slice long, seq long, at long, role string")
    turns = cut(turns, "repair-turns")
    old = (turns.where(F.col("at").isNotNull()).withColumnRenamed("role", "new_role")
           .join(found.rows.select("at", "role", "text"), "at")
           .select("conv_id", "slice", "seq", F.coalesce("new_role", "role").alias("role"),
                   "text"))
    new = turns.where(F.col("at").isNull()).select("conv_id", "slice", "seq", "role",
                                                   F.lit("").alias("text"))
    return old.unionByName(new)


def report(conversations: DataFrame) -> DataFrame:
    """gaps, faults, illegal neighbours, cost, audit and hash of the repair of every conversation
    after :func:`damaged`."""
    with scope() as made:
        out = cut(_measures(repairs(damaged(conversations))), "repair-out")
        made.remove(out)
    return out


def _measures(found: Repairs) -> DataFrame:
    kind = dict(found.rows.dtypes)["conv_id"]
    span = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    counts = found.marked.groupBy("conv_id").agg(
        span.alias("gaps"), *[F.count_if(F.col("fault") == f[0]).alias(f)
                              for f in ("blank", "duplicate", "truncated")])
    line = F.encode(F.concat("role", F.lit(":"), "text"), "UTF-8")
    lines = repaired_turns(found).select("conv_id", "slice", "seq", line.alias("line"))
    hashes = (lines.repartition("conv_id").sortWithinPartitions("conv_id", "slice", "seq")
              .select("conv_id", "line")
              .mapInArrow(_hash_stream, f"conv_id {kind}, repaired_sha256 string"))
    out = found.rows.select("conv_id").distinct()
    # one row of each conversation from each side: no key is hot
    for side in (counts, found.solved.drop("path"), hashes):
        side = side.withColumnRenamed("conv_id", "c")
        out = out.join(side, F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return out.select(
        "conv_id", *[F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
