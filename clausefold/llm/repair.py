"""Repair of conversations by alignment with an alternating grammar.

A sound conversation's roles read ``(s?(ua)+)?``.  A cheapest list of edits
makes any conversation sound: Keep 0, Rerole to user or assistant 2, Delete 3,
Insert an empty turn 2; blank and repeated turns must go, and a truncated turn
that stays costs 1 more.  Of equally cheap audits (the edits' initials in
order) the smallest string counts.

Method: Wagner-Fischer alignment of the turns with each feasible length of the
grammar's string, inside a Ukkonen band that follows from the incumbent's
cost; the audits traced back are compared.  Turns are range-sorted and cut
into blocks, so a conversation of any length is spread over tasks: a block is
aligned once from each state of the grammar to each other, an insertion counts
with the turn after it (which makes audits of a block prefix-free), and one
light pass per conversation joins the blocks by cost, then by audit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausefold.llm.common import bound_batches, written

#: Costs of the edits, and of a truncated turn that stays.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1

NAMES = {"u": "user", "a": "assistant"}

#: Turns of a block.
BLOCK = 64

#: States of the grammar: nothing yet, only s so far, an assistant's turn is
#: due, a pair is complete.
BEGIN, SYSTEM, DUE, DONE = range(4)

#: What a conversation still has to insert at its end, by state.
ENDING = {BEGIN: "", SYSTEM: "ua", DUE: "a", DONE: ""}

#: White space, and what ends a whole sentence.
BLANK = " \t\n\v\f\r"
STOPS = ".!?"

Best = tuple[int, str]


@dataclass
class Turn:
    """What the alignment needs of a turn."""

    initial: str
    must_go: bool
    truncated: bool


def alternating(start: str, length: int) -> str:
    pair = "ua" if start == "u" else "au"
    return (pair * (length // 2 + 1))[:length]


def band(n: int, m: int, bound: int) -> tuple[int, int] | None:
    """Smallest and largest offset (target position minus turn) of a path of
    at most ``bound``: an offset needs its insertions or deletions on the way
    there, and others on the way to the end.  None if there is no path."""
    def least(d: int) -> int:
        return INSERT * d if d > 0 else -DELETE * d

    low, high = min(0, m - n), max(0, m - n)
    if least(m - n) > bound:
        return None
    # past both ends of [low, high] each step costs one insertion and one deletion
    slack = (bound - least(m - n)) // (INSERT + DELETE)
    return low - slack, high + slack


def align(turns: list[Turn], target: str, bound: int) -> Best | None:
    """The cheapest alignment of ``turns`` with ``target`` that costs no more
    than ``bound``, and of those the smallest audit.  The last edit is a
    turn's.  None if there is none."""
    n, m = len(turns), len(target)
    limits = band(n, m, bound)
    if limits is None or (n == 0 and m):
        return None
    low, high = limits
    never = bound + 1
    # cost[i][j - (i + low)]: of the turns from i on and the target from j on
    width = high - low + 1
    cost: list[list[int]] = [[]] * n
    after = [never] * (width + 2)
    if 0 <= m - n - low < width:
        after[m - n - low] = 0
    last = after
    for i in range(n - 1, -1, -1):
        turn = turns[i]
        stay = TRUNCATED if turn.truncated else 0
        row = [never] * (width + 2)
        for k in range(width - 1, -1, -1):
            j = i + low + k
            if j < 0 or j > m:
                continue
            # deleting leaves the same j: one offset less in the next row
            best = DELETE + after[k - 1] if k else never
            if j < m:
                if not turn.must_go:
                    kept = stay + (0 if turn.initial == target[j] else REROLE if target[j] in NAMES else never)
                    best = min(best, kept + after[k])
                best = min(best, INSERT + row[k + 1] if target[j] in NAMES else never)
            row[k] = min(best, never)
        cost[i] = after = row
    begin = -low
    total = (cost[0] if n else last)[begin]
    if total > bound:
        return None
    audit, i, k = [], 0, begin
    while i < n:
        turn, j, here = turns[i], i + low + k, cost[i][k]
        below = cost[i + 1] if i + 1 < n else last
        stay = TRUNCATED if turn.truncated else 0
        # in the order of the letters: D, I, K, R
        if k and DELETE + below[k - 1] == here:
            audit.append("D")
            i, k = i + 1, k - 1
        elif j < m and target[j] in NAMES and INSERT + cost[i][k + 1] == here:
            audit.append("I")
            k += 1
        else:
            audit.append("K" if turn.initial == target[j] and stay + below[k] == here else "R")
            i += 1
    return total, "".join(audit)


def best_of(turns: list[Turn], targets: list[str]) -> Best | None:
    """The best alignment with any of ``targets``, the likeliest length first;
    the incumbent's cost bounds the bands of the others."""
    best: Best | None = None
    bound = (DELETE + TRUNCATED) * len(turns) + INSERT * (len(turns) + 2)
    for target in targets:
        found = align(turns, target, bound)
        if found and (best is None or found < best):
            best, bound = found, found[0]
    return best


def lengths(n: int, parity: int, least: int) -> list[int]:
    """Feasible target lengths of a parity, the nearest to ``n`` first: before
    each turn one insertion at most is of use, and a first pair."""
    return sorted((m for m in range(least, 2 * n + 2) if m % 2 == parity), key=lambda m: (abs(m - n), m))


def transfers(turns: list[Turn]) -> dict[tuple[int, int], Best]:
    """The best (cost, audit) of a block from each state to each other."""
    n = len(turns)
    out: dict[tuple[int, int], Best] = {}
    gone = (DELETE * n, "D" * n)
    users = {p: best_of(turns, [alternating("u", m) for m in lengths(n, p, 1)]) for p in (0, 1)}
    answers = {p: best_of(turns, [alternating("a", m) for m in lengths(n, p, 1)]) for p in (0, 1)}
    led: dict[int, Best | None] = {0: None, 1: None}
    if any(t.initial == "s" and not t.must_go for t in turns):
        led = {p: best_of(turns, ["s" + alternating("u", m) for m in lengths(n, p, 1)]) for p in (0, 1)}
        alone = align(turns, "s", (DELETE + TRUNCATED) * n)
        if alone:
            out[BEGIN, SYSTEM] = alone
    out[BEGIN, BEGIN] = out[SYSTEM, SYSTEM] = out[DUE, DUE] = out[DONE, DONE] = gone
    found = [
        ((BEGIN, DUE), users[1]), ((BEGIN, DUE), led[1]), ((BEGIN, DONE), users[0]), ((BEGIN, DONE), led[0]),
        ((SYSTEM, DUE), users[1]), ((SYSTEM, DONE), users[0]),
        ((DUE, DONE), answers[1]), ((DUE, DUE), answers[0]),
        ((DONE, DUE), users[1]), ((DONE, DONE), users[0]),
    ]
    for way, best in found:
        if best and (way not in out or best < out[way]):
            out[way] = best
    return out


def route(blocks: list[dict[tuple[int, int], tuple[int, int]]]) -> tuple[int, list[tuple[int, int]]]:
    """The cheapest cost of a conversation and the (state before, state after)
    of each block, from the (cost, rank of the audit) of each block's ways:
    of equal costs the audit that is smaller in the first block that differs.
    """
    rest: list[dict[int, int]] = [{s: INSERT * len(e) for s, e in ENDING.items()}]
    for ways in reversed(blocks):
        after, here = rest[-1], {}
        for (s, e), (cost, _) in ways.items():
            if e in after and cost + after[e] < here.get(s, 1 << 62):
                here[s] = cost + after[e]
        rest.append(here)
    rest.reverse()
    state, path = BEGIN, []
    for k, ways in enumerate(blocks):
        open_ways = [(rank, e) for (s, e), (cost, rank) in ways.items() if s == state and e in rest[k + 1] and cost + rest[k + 1][e] == rest[k][s]]
        _, after = min(open_ways)
        path.append((state, after))
        state = after
    return rest[0][BEGIN], path


def repaired(state: int, audit: str, said: list[tuple[str, str]]) -> tuple[list[tuple[str, str]], int]:
    """The turns that an audit makes of ``said`` from a state on, and the
    state after them."""
    out, at = [], 0
    for edit in audit:
        due = "a" if state == DUE else "u"
        if edit == "D":
            at += 1
            continue
        if edit == "I":
            out.append((NAMES[due], ""))
        else:
            role, text = said[at]
            out.append((role if edit == "K" else NAMES[due], text))
            at += 1
        first = out[-1][0][:1]
        state = SYSTEM if first == "s" else DUE if first == "u" else DONE
    return out, state


def piece_of(turns: list[tuple[str, str]]) -> bytes:
    return "\n".join(f"{role}:{text}" for role, text in turns).encode()


@dataclass
class Block:
    """Consecutive turns of a conversation, and what they are counted for."""

    conv: object
    turns: list[Turn] = field(default_factory=list)
    said: list[tuple[str, str]] = field(default_factory=list)
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    distinct: int = 0
    first_turn: int | None = None
    last_turn: int | None = None

    def add(self, turn: int | None, role: str, text: str, repeated: bool) -> None:
        plain = text.strip(BLANK)
        must_go = not plain or repeated
        cut = not must_go and plain[-1] not in STOPS
        self.blank += not plain
        self.duplicate += bool(plain) and repeated
        self.truncated += cut
        if self.turns:
            self.illegal += not sound(self.turns[-1].initial, role[:1])
        if turn is not None and turn != self.last_turn:
            self.distinct += 1
        if turn is not None:
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        self.turns.append(Turn(role[:1], must_go, cut))
        self.said.append(("", "") if must_go else (role, text))


def sound(before: str, after: str) -> bool:
    return before + after in ("su", "ua", "au")


SUMS = ("blank", "duplicate", "truncated", "illegal", "distinct")

_WAY = T.StructType([T.StructField("before", T.IntegerType()), T.StructField("after", T.IntegerType()), T.StructField("cost", T.LongType()),
                     T.StructField("rank", T.LongType()), T.StructField("audit", T.StringType())])
_SAID = T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])

#: What a block is known by after its alignment; of a conversation that lies
#: in one block and one task as a whole, ``audit`` and ``sha`` are known too.
_BLOCK = [
    *(T.StructField(c, T.LongType()) for c in ("task", "number", "n_turns", *SUMS, "first_turn", "last_turn", "cost")),
    *(T.StructField(c, T.StringType()) for c in ("first_initial", "last_initial", "audit", "sha")),
    T.StructField("ways", T.ArrayType(_WAY)), T.StructField("said", T.ArrayType(_SAID)),
]
RESULT = [*(T.StructField(c, T.LongType()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
          T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())]


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows of ``conversations`` after damage by crc32 of ``conv_id:turn``
    modulo 20: 0 drops a row, 1 empties its text, 2 takes its ``[.!?]``, 3
    repeats it, 4 makes it a user's.  A null counts as one space."""
    def said(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.pmod(F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")), F.lit(20))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), said("role").alias("role"), said("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", STOPS, "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.when(F.col("kind") == 3, F.lit(2)).otherwise(F.lit(1))
    return rows.where(F.col("kind") != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.cast("long").alias("copies"))


def ordered_turns(rows: DataFrame) -> DataFrame:
    """Distinct turns with ``copies`` and ``repeated`` (role and text stand at
    an earlier turn), range-sorted by conversation, turn (a null first), role
    and text.  Equal turns are counted map-side, so none is hot; a long
    conversation is dealt out to many tasks."""
    same = ["conv_id", "turn", "role", "text"]
    key = F.sha2(F.concat(F.length("role"), F.lit(":"), F.col("role"), F.col("text")), 256)
    turns = rows.groupBy(*same).agg(F.sum("copies").alias("copies")).withColumn("key", key)
    spread = rows.select("conv_id", key.alias("key"), F.struct("turn").alias("at")).groupBy("conv_id", "key").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    earlier = spread.where(~F.col("first").eqNullSafe(F.col("last"))).select(F.col("conv_id").alias("__conv"), F.col("key").alias("__key"), "first")
    met = turns.join(earlier, F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("key") == F.col("__key")), "left")
    repeated = F.col("__key").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn"))
    return met.select(*same, "copies", repeated.alias("repeated")).repartitionByRange(
        "conv_id", "turn", "role", F.substring("text", 1, 16)).sortWithinPartitions(*same)


def _streamed(rows: DataFrame, schema: T.StructType, work) -> DataFrame:
    """``work`` turns the dicts of a partition's rows, in order, into tuples
    of ``schema``; neither side is held whole."""
    from pyspark.sql.pandas.types import to_arrow_schema

    bound_batches(rows.sparkSession)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = zip(*held, strict=True)
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)
            held.clear()
            return batch

        for row in work(r for batch in batches for r in batch.to_pylist()):
            held.append(row)
            if len(held) == 1024:
                yield flush()
        if held:
            yield flush()

    return rows.mapInArrow(run, schema)


def aligned_blocks(turns: DataFrame) -> DataFrame:
    """conv_id and the fields of ``_BLOCK`` for every block of the sorted
    turns.  A block with both neighbours in its task is a whole conversation
    and is finished there; others keep their ways and texts."""
    def work(rows: Iterator[dict]) -> Iterator[tuple]:
        from pyspark import TaskContext
        task, number, own, opens = TaskContext.get().partitionId(), 0, None, True

        def close(block: Block, whole: bool) -> tuple:
            ways = transfers(block.turns)
            cost = audit = sha = None
            links, said = [], []
            if whole:
                total, path = route([ways])
                cost, audit = total, ways[path[0]][1] + "I" * len(ENDING[path[0][1]])
                made, _ = repaired(BEGIN, audit, block.said)
                sha = hashlib.sha256(piece_of(made)).hexdigest()
            else:
                ranks = {a: k for k, a in enumerate(sorted({a for _, a in ways.values()}))}
                links = [{"before": s, "after": e, "cost": c, "rank": ranks[a], "audit": a} for (s, e), (c, a) in ways.items()]
                said = [{"role": r, "text": t} for r, t in block.said]
            return (block.conv, task, number, len(block.turns), *(getattr(block, c) for c in SUMS), block.first_turn, block.last_turn, cost,
                    block.turns[0].initial, block.turns[-1].initial, audit, sha, links, said)

        for row in rows:
            for copy in range(row["copies"]):
                other = own is not None and own.conv != row["conv_id"]
                if other or own is not None and len(own.turns) == BLOCK:
                    yield close(own, other and not opens)
                    # what follows opens in this task only if another conversation ended
                    number, own, opens = number + 1, None, not other
                own = own or Block(row["conv_id"])
                own.add(row["turn"], row["role"], row["text"], row["repeated"] or copy > 0)
        if own is not None:
            yield close(own, False)

    return _streamed(turns, T.StructType([turns.schema["conv_id"], *_BLOCK]), work)


def _joined_counts(blocks: list[dict]) -> tuple[int, ...]:
    """gaps, blank, duplicate, truncated and illegal of a conversation."""
    sums = {c: sum(b[c] for b in blocks) for c in SUMS}
    first = last = None
    for k, b in enumerate(blocks):
        if k:
            sums["illegal"] += not sound(blocks[k - 1]["last_initial"], b["first_initial"])
        if b["first_turn"] is not None:
            first = b["first_turn"] if first is None else first
            sums["distinct"] -= b["first_turn"] == last
            last = b["last_turn"]
    gaps = 0 if first is None else last - first + 1 - sums["distinct"]
    return (gaps, *(sums[c] for c in SUMS[:4]))


def _groups(rows: Iterator[dict]) -> Iterator[list[dict]]:
    held: list[dict] = []
    for row in rows:
        if held and held[0]["conv_id"] != row["conv_id"]:
            yield held
            held = []
        held.append(row)
    if held:
        yield held


def joined(blocks: DataFrame) -> DataFrame:
    """conv_id and RESULT of the conversations whose blocks lie apart.  The
    route through a conversation's blocks is found from their costs alone;
    texts are read once more, block by block, for the digest."""
    ids = blocks.schema["conv_id"]
    place = [T.StructField("task", T.LongType()), T.StructField("number", T.LongType())]
    ways = F.transform("ways", lambda w: F.struct(w["before"].alias("before"), w["after"].alias("after"), w["cost"].alias("cost"), w["rank"].alias("rank")))
    light = blocks.select("conv_id", "task", "number", *SUMS, "first_turn", "last_turn", "first_initial", "last_initial", ways.alias("ways"))
    counts = [f for f in RESULT if isinstance(f.dataType, T.LongType)]

    def choose(rows: Iterator[dict]) -> Iterator[tuple]:
        for group in _groups(rows):
            total, path = route([{(w["before"], w["after"]): (w["cost"], w["rank"]) for w in b["ways"]} for b in group])
            for k, (b, (before, after)) in enumerate(zip(group, path, strict=True)):
                known = (*_joined_counts(group), total) if k + 1 == len(group) else (None,) * len(counts)
                yield (b["task"], b["number"], before, after, *known)

    chosen = _streamed(light.repartition("conv_id").sortWithinPartitions("conv_id", "task", "number"),
                       T.StructType([*place, T.StructField("before", T.IntegerType()), T.StructField("after", T.IntegerType()), *counts]), choose)
    way = F.element_at(F.filter("ways", lambda w: (w["before"] == F.col("before")) & (w["after"] == F.col("after"))), 1)
    met = blocks.select("conv_id", "task", "number", "ways", "said").join(chosen, ["task", "number"]).select(
        "conv_id", "task", "number", "before", way["audit"].alias("audit"), "said", "after", *[f.name for f in counts])

    def write(rows: Iterator[dict]) -> Iterator[tuple]:
        own, digest, audits, empty = None, hashlib.sha256(), [], True
        for row in rows:
            if own is None or own["conv_id"] != row["conv_id"]:
                own, digest, audits, empty = row, hashlib.sha256(), [], True
            ends = row["cost"] is not None
            audit = row["audit"] + ("I" * len(ENDING[row["after"]]) if ends else "")
            turns, _ = repaired(row["before"], audit, [(s["role"], s["text"]) for s in row["said"]])
            if turns:
                digest.update((b"" if empty else b"\n") + piece_of(turns))
                empty = False
            audits.append(audit)
            if ends:
                yield (row["conv_id"], *(row[f.name] for f in counts), "".join(audits), digest.hexdigest())

    return _streamed(met.repartition("conv_id").sortWithinPartitions("conv_id", "task", "number"), T.StructType([ids, *RESULT]), write)


def repair_audit(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and
    repaired_sha256 of every conv_id of ``conversations``, for the turns
    ``rows`` (conv_id, turn, role, text, copies) that it has.

    Turns are taken by turn (nulls first), then role, then text; equal turns
    lie together, and all but the first of them are duplicates.  A turn's
    first fault counts: blank (only white space), duplicate (role and text
    seen earlier), truncated (last character not ``[.!?]``).  ``gaps`` are the
    numbers missing between the smallest and the largest turn, ``illegal`` the
    neighbours whose role initials are not su, ua or au.  Roles and texts are
    not null in ``rows``; a null conv_id is a conversation of its own.  A
    conversation without turns has zeros, an empty audit and the digest of
    nothing; an empty table gives no rows.
    """
    blocks = written(aligned_blocks(ordered_turns(rows)), "aligned-turns")
    gaps = F.when(F.col("first_turn").isNull(), F.lit(0)).otherwise(F.col("last_turn") - F.col("first_turn") + 1 - F.col("distinct"))
    near = blocks.where(F.col("sha").isNotNull()).select("conv_id", gaps.cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit",
                                                         F.col("sha").alias("repaired_sha256"))
    found = near.unionByName(joined(blocks.where(F.col("sha").isNull()))).withColumnRenamed("conv_id", "__conv")
    nothing = hashlib.sha256(b"").hexdigest()
    every = conversations.select("conv_id").distinct()
    out = every.join(found, F.col("conv_id").eqNullSafe(F.col("__conv")), "left")
    filled = [F.coalesce(f.name, F.lit({"audit": "", "repaired_sha256": nothing}.get(f.name, 0)).cast(f.dataType)).alias(f.name) for f in RESULT]
    return out.select("conv_id", *filled)


def repair_digest(conversations: DataFrame) -> DataFrame:
    """The audit of every conversation after damage; a null conv_id, turn,
    role or text counts as one space."""
    return repair_audit(conversations, damaged(conversations))
