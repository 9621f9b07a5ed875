"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example: all turns before it are context, only its text is trainable.
Writing each example's context out costs the square of a conversation's length, so the examples of a conversation share
one rendering: segment rows in order, each with its place in the rendering, and the example (if any) that it is the
target of. `example_rows` explodes them: a row for each example, with the context that it has (its end, and the digest of
its text, which a running hash gives without writing it out) and its target. `expand_examples` writes examples in full.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
SEGMENT = re.compile(r"<\|im_start\|>([^\n]*)\n(.*)<\|im_end\|>\n", re.S)
ESCAPED = re.compile(r"\\(.)", re.S)


def escape(c, newline: bool = False):
    r"""Column: backslashes doubled, `<|` as `<\|`, so that no control string is left; role names also lose line ends."""
    c = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))
    return F.replace(c, F.lit("\n"), F.lit("\\n")) if newline else c


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text) if "\\" in text else text


def format_conversations(turns: DataFrame, target_role: str = "assistant") -> DataFrame:
    """Segments of every conversation's rendering: conv_id, seq, segment, start, example, loss_start, loss_end.

    turns: conv_id, turn, role, text; other columns are left out. Null role or text counts as empty; null conv_id is a
    conversation of its own; null turns come first; equal turns are ordered by role, then text, and repeated rows stay.
    start, loss_start and loss_end count characters in the conversation's rendering; example numbers the target turns
    from 0 and is null, like the loss span, for others. No turns: no rows.
    """
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    rows = rows.withColumn("head", F.concat(F.lit(START), escape(F.col("role"), newline=True), F.lit("\n"))).withColumn("body", escape(F.col("text")))
    rows = rows.withColumn("segment", F.concat("head", "body", F.lit(END + "\n")))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    target = F.col("role") == target_role
    rows = rows.select(
        "conv_id", (F.row_number().over(order) - 1).cast("long").alias("seq"), "segment",
        (F.sum(F.length("segment")).over(so_far) - F.length("segment")).cast("long").alias("start"),
        F.when(target, F.sum(target.cast("long")).over(so_far) - 1).alias("example"),
        F.length("head").cast("long").alias("h"), F.length("body").cast("long").alias("b"),
    )
    at = F.when(F.col("example").isNotNull(), F.col("start") + F.col("h"))
    return rows.select("conv_id", "seq", "segment", "start", "example", at.alias("loss_start"), (at + F.col("b")).alias("loss_end"))


def expand_examples(segments: DataFrame, max_context: int | None = None) -> DataFrame:
    """Examples in full: conv_id, example, text (context and target), loss_start, loss_end within text.

    The size of what is returned grows with the square of a conversation's turns; segments hold the same in linear size.
    max_context keeps only examples whose text has at most so many characters (None: all).
    """
    goals = segments.where(F.col("example").isNotNull()).select(F.col("conv_id").alias("c"), "example", F.col("seq").alias("last"), "loss_start", "loss_end")
    if max_context is not None:
        goals = goals.where(F.col("loss_end") + len(END) + 1 <= max_context)
    parts = segments.select("conv_id", "seq", "segment")
    pairs = parts.join(goals, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("seq") <= F.col("last")))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "segment"))), lambda x: x["segment"]), "")
    return pairs.groupBy("conv_id", "example").agg(whole.alias("text"), F.first("loss_start").alias("loss_start"), F.first("loss_end").alias("loss_end"))


EXAMPLE = pa.schema([
    ("conv_id", pa.int64()), ("example", pa.int64()), ("context_end", pa.int64()), ("context_sha256", pa.string()), ("target", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64()),
    ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("formatted_chars", pa.int64()),
])


def explode_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Examples of conversations whose segments come in order, and after them a row for the conversation itself (example null),
    with the digest of all turns as read back from the rendering; holds one segment and two hash states at a time."""
    current, state, rows, size = None, None, [], 0

    def close() -> None:
        n, turns, rendered, chars = state
        rows.append((current, None, chars, rendered.hexdigest(), None, None, None, n, turns.hexdigest(), chars))

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), EXAMPLE, strict=True)], schema=EXAMPLE)

    for batch in batches:
        for conv, segment, example, start, a, b in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "segment", "example", "start", "loss_start", "loss_end")), strict=True):
            if state is None or conv != current:
                if state is not None:
                    close()
                state, current = [0, hashlib.sha256(), hashlib.sha256(), 0], conv
            role, text = SEGMENT.fullmatch(segment).groups()
            if example is not None:
                # the context ends where the target begins: all turns before, and the head of this one
                before = state[2].copy()
                before.update(segment[: a - start].encode())
                rows.append((conv, example, a, before.hexdigest(), segment[a - start : b - start], a, b, None, None, None))
                size += b - a
            state[0] += 1
            state[1].update(f"{unescape(role)}\n{unescape(text)}\n".encode())
            state[2].update(segment.encode())
            state[3] += len(segment)
            if size > 1 << 22:
                yield out()
                rows, size = [], 0
        if rows:
            yield out()
            rows, size = [], 0
    if state is not None:
        close()
        yield out()


def example_rows(segments: DataFrame) -> DataFrame:
    """conv_id, example, context_end, context_sha256, target, loss_start, loss_end of every example, in order of example, and a
    closing row of each conversation (example null) with n_turns, turns_sha256 and formatted_chars.

    Rows stream through in order; a hash over a whole conversation is sequential, so one conversation's rows pass through
    one task, which never holds more than one of them. Partitions come out ordered by conversation.
    """
    ordered = segments.repartition("conv_id").sortWithinPartitions("conv_id", "seq")
    kind = "conv_id long, example long, context_end long, context_sha256 string, target string, loss_start long, loss_end long, n_turns long, turns_sha256 string, formatted_chars long"
    return ordered.mapInArrow(explode_stream, kind)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long"


def digest_examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of conversations from their example rows as they come: the closing row ends a conversation."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_examples", pa.int64())])
    loss, chars, seen = hashlib.sha256(), 0, 0
    for batch in batches:
        done = []
        for conv, example, target, n, turns, formatted in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "example", "target", "n_turns", "turns_sha256", "formatted_chars")), strict=True):
            if example is not None:
                text = unescape(target)
                loss.update(text.encode())
                chars, seen = chars + len(text), seen + 1
                continue
            done.append({"conv_id": conv, "n_turns": n, "turns_sha256": turns, "loss_chars": chars, "loss_sha256": loss.hexdigest(), "formatted_chars": formatted, "n_examples": seen})
            loss, chars, seen = hashlib.sha256(), 0, 0
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)


def conversation_digests(segments: DataFrame) -> DataFrame:
    """Read examples back: per conversation its turns, and what lies under the loss masks of its examples, as counts and digests."""
    return example_rows(segments).mapInArrow(digest_examples, DIGEST)
