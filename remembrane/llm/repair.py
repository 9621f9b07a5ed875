"""Repair of a conversation's structure at the least cost, by layers of cost over bitsets of grammar states.

Roles have to read `(s?(ua)+)?`. Its automaton has four states: 0 at the start, 1 after s, 2 after u, 3 after a; 0 and 3 accept.
A turn's word holds, for each of sixteen costs above the turn's least, the bitset of states from which the rest of the
conversation can be completed at exactly that cost. One row's edits are shifts of the next turn's word: Keep by 0 layers,
Rerole and Insert by 3, Delete by 4. The lowest layer of the first word that holds the start gives the cost, and reading
the words forward, with the least letter that some word allows, gives the least audit. From any state any other is at most
ten away (an insert is 3, a dropped system turn 4), so sixteen layers lose no state's least cost.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STATES, LAYERS = 4, 16
ONES = sum(1 << STATES * k for k in range(LAYERS + 16))
MASK = (1 << STATES * LAYERS) - 1
#: Where a role's initial leads, by state.
STEP = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
#: The only role that can be put in at each state, and where it leads.
PUT = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
GOOD, BLANK, DUPLICATE, TRUNCATED = range(4)
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def user_before(word: int) -> int:
    return (word >> 2 & ONES) * 0b1011


def assistant_before(word: int) -> int:
    return (word >> 3 & ONES) << 2


def system_before(word: int) -> int:
    return word >> 1 & ONES


BEFORE = {"s": system_before, "u": user_before, "a": assistant_before}


def with_inserts(word: int) -> int:
    for _ in range(3):
        word |= (user_before(word) | assistant_before(word)) << 3 * STATES
    return word


def least_repair(initials: str, kinds: bytes) -> tuple[int, str]:
    """Cost and audit for turns given by their roles' initials and their faults; 16 bytes a turn are held."""
    n = len(initials)
    words, least = array("Q", bytes(8 * (n + 1))), array("q", bytes(8 * (n + 1)))
    word, low = with_inserts(0b1001) & MASK, 0
    words[n] = word
    for i in range(n - 1, -1, -1):
        after, kind = word, kinds[i]
        word = after << 4 * STATES
        if kind not in (BLANK, DUPLICATE):
            late = 3 * STATES if kind == TRUNCATED else 0
            word |= (user_before(after) | assistant_before(after)) << 3 * STATES + late
            if keep := BEFORE.get(initials[i]):
                word |= keep(after) << late
        word = with_inserts(word)
        empty = ((word & -word).bit_length() - 1) // STATES
        low += empty
        word = word >> STATES * empty & MASK
        words[i], least[i] = word, low

    def completes(i: int, state: int, cost: int) -> bool:
        layer = cost - least[i]
        return 0 <= layer < LAYERS and bool(words[i] >> STATES * layer + state & 1)

    cost = next(least[0] + k for k in range(LAYERS) if completes(0, 0, least[0] + k))
    audit, i, state, left = bytearray(), 0, 0, cost
    while i < n or left:
        put = PUT[state][1]
        late = 3 if i < n and kinds[i] == TRUNCATED else 0
        stays = i < n and kinds[i] not in (BLANK, DUPLICATE)
        if i < n and completes(i + 1, state, left - 4):
            letter, left, i = b"D", left - 4, i + 1
        elif completes(i, put, left - 3):
            letter, left, state = b"I", left - 3, put
        elif stays and (to := STEP.get(initials[i], {}).get(state)) is not None and completes(i + 1, to, left - late):
            letter, left, state, i = b"K", left - late, to, i + 1
        else:
            letter, left, state, i = b"R", left - 3 - late, put, i + 1
        audit += letter
    return cost, audit.decode()


def damage(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone: turns damaged by crc32 of `conv_id:turn` modulo 20, a null written as one space everywhere.

    0 drops the row (it stays, marked gone, so that its conversation comes back), 1 empties its text, 2 takes out `[.!?]`,
    3 repeats it, 4 makes its role user; the rest stay as they are.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    lot = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(F.col("lot") == 1, "").when(F.col("lot") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), lot.alias("lot"))
    copies = F.explode(F.when(F.col("lot") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(F.col("lot") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("lot") == 0).alias("gone"), copies.alias("copy")).drop("copy")


def with_digest(turns: DataFrame) -> DataFrame:
    return turns.withColumn("digest", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))


PLAN = pa.schema([
    ("conv_id", pa.int64()), ("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()),
])
PLAN_DDL = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def plan_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Plans of conversations whose turns come in order; of one conversation a few bytes a turn are held, never its texts."""
    rows, conv, begun = [], None, False
    initials, kinds, low, high, distinct, seen = [], bytearray(), None, None, 0, None

    def close() -> None:
        pairs = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        cost, audit = least_repair([*initials], bytes(kinds))
        gaps = min(high - low + 1 - distinct, (1 << 63) - 1) if distinct else 0
        rows.append((conv, gaps, *(kinds.count(k) for k in (BLANK, DUPLICATE, TRUNCATED)), pairs, cost, audit))

    for batch in batches:
        for c, turn, initial, kind, gone in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "turn", "initial", "kind", "gone")), strict=True):
            if not begun or c != conv:
                if begun:
                    close()
                conv, begun = c, True
                initials, kinds, low, high, distinct, seen = [], bytearray(), None, None, 0, None
            if gone:
                continue
            initials.append(initial)
            kinds.append(kind)
            if turn is not None and turn != seen:
                low, high, seen, distinct = turn if low is None else low, turn, turn, distinct + 1
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), PLAN, strict=True)], schema=PLAN)
            rows = []
    if begun:
        close()
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), PLAN, strict=True)], schema=PLAN)


def repair_plans(turns: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of every conversation.

    turns: conv_id, turn, role, text (no nulls in the last two), gone. Rows marked gone are no turns, but their conversation
    comes back. Turns are ordered by turn (null first), role, then the digest of role and text; a null conv_id is a
    conversation of its own. A row's first fault counts: blank (nothing but ASCII white space), duplicate (same role and
    text before), truncated (last character that is no white space not `[.!?]`).
    """
    trimmed = F.rtrim("text", F.lit(SPACE))
    rows = with_digest(turns).select(
        "conv_id", "turn", "role", "gone", "digest", F.substring("role", 1, 1).alias("initial"),
        F.when(F.length(trimmed) == 0, BLANK).when(F.right(trimmed, F.lit(1)).isin(".", "!", "?"), GOOD).otherwise(TRUNCATED).alias("kind"),
    ).repartition("conv_id")
    nth = F.row_number().over(Window.partitionBy("conv_id", "gone", "digest").orderBy("turn"))
    rows = rows.withColumn("nth", nth).withColumn("kind", F.when((F.col("kind") != BLANK) & (F.col("nth") > 1), DUPLICATE).otherwise(F.col("kind")))
    ordered = rows.sortWithinPartitions("conv_id", "turn", "role", "digest", "nth")
    return ordered.select("conv_id", "turn", "initial", "kind", "gone").mapInArrow(plan_stream, PLAN_DDL)


REPAIRED = pa.schema([("conv_id", pa.int64()), ("seq", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string()), *[PLAN.field(i) for i in range(1, len(PLAN))]])
REPAIRED_DDL = "conv_id long, seq long, edit string, role string, text string, " + PLAN_DDL.split(", ", 1)[1]


def apply_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repaired turns of conversations that come as their plan and then their rows in order, and a closing row with the plan (seq null)."""
    rows, size, plan, at, state, seq = [], 0, None, 0, 0, 0
    facts = [f.name for f in PLAN][1:]
    blank = (None,) * len(facts)

    def put(edit: str, role: str, text: str) -> None:
        nonlocal seq, size
        rows.append((plan[0], seq, edit, role, text, *blank))
        seq, size = seq + 1, size + len(text)

    def inserts() -> None:
        nonlocal at, state
        audit = plan[-1]
        while at < len(audit) and audit[at] == "I":
            role, state = PUT[state]
            put("I", role, "")
            at += 1

    def close() -> None:
        inserts()
        rows.append((plan[0], None, None, None, None, *plan[1:]))

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), REPAIRED, strict=True)], schema=REPAIRED)

    for batch in batches:
        for first, conv, role, text, *known in zip(*(batch.column(c).to_pylist() for c in ("first", "conv_id", "role", "text", *facts)), strict=True):
            if first:
                if plan is not None:
                    close()
                plan, at, state, seq = (conv, *known), 0, 0, 0
                continue
            inserts()
            edit = plan[-1][at]
            at += 1
            if edit == "R":
                role, state = PUT[state]
            elif edit == "K":
                state = STEP[role[0]][state]
            if edit != "D":
                put(edit, role, text)
            if size > 1 << 22:
                yield out()
                rows, size = [], 0
        if rows:
            yield out()
            rows, size = [], 0
    if plan is not None:
        close()
        yield out()


def repaired_turns(turns: DataFrame, plans: DataFrame) -> DataFrame:
    """conv_id, seq, edit, role, text of the repaired conversations in order, and for each a closing row (seq null) with its plan.

    Rows meet their plan in order of turn, and stream through: a task holds one row and one plan.
    """
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in plans.schema.fields[1:]]
    rows = with_digest(turns.where(~F.col("gone"))).select(F.lit(False).alias("first"), "conv_id", "turn", "role", "text", "digest", *none)
    heads = plans.select(F.lit(True).alias("first"), "conv_id", *[F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("text", "string"), ("digest", "string"))], *plans.columns[1:])
    both = heads.unionByName(rows).repartition("conv_id").sortWithinPartitions("conv_id", F.desc("first"), "turn", "role", "digest")
    return both.drop("turn", "digest").mapInArrow(apply_stream, REPAIRED_DDL)


def digest_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([*PLAN, ("repaired_sha256", pa.string())])
    state, names = hashlib.sha256(), [f.name for f in PLAN]
    for batch in batches:
        done = []
        for seq, role, text, *plan in zip(*(batch.column(c).to_pylist() for c in ("seq", "role", "text", *names)), strict=True):
            if seq is not None:
                state.update(f"{chr(10) if seq else ''}{role}:{text}".encode())
                continue
            done.append((*plan, state.hexdigest()))
            state = hashlib.sha256()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)


def repair_digests(turns: DataFrame, plans: DataFrame) -> DataFrame:
    """Each conversation's plan, and the digest of its repaired `role:text` lines as read back from the repaired turns."""
    return repaired_turns(turns, plans).mapInArrow(digest_stream, PLAN_DDL + ", repaired_sha256 string")
