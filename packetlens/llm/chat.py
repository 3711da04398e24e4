"""Chat formatting by incremental rendering of a black-box template.

A template is any function from a list of turns to a string. Rendering the
successive prefixes of a conversation and comparing each output with the one
before locates every turn's span; where the earlier output isn't a prefix of
the later one, the template has rewritten history, and the row says how many
characters it took back. The text's own span inside a turn is found by
rendering the same prefix once more with a marker in place of the text.

By default every prefix is rendered whole, from the first turn on: right for
any template, but the turns of a conversation are held in memory, one task has
them all, and the work grows with the square of their number. With ``lookback``
at most so many turns are held and rendered, which bounds memory and work per
turn. That is exact only for a template declared ``local``, so any other raises
``ValueError``.

Conversations of a local template are also cut into blocks of ``block_turns``
turns, each rendered by itself after the ``reach`` turns before it, so a very
long conversation is spread over many tasks. Positions come from counts of
(conversation, range of turn) and their prefix sums; only turns with the same
number must be numbered by one task. ``read_conversations`` still reads a
conversation in one task: its digests run over the whole of it.

Defined results: null role or text is empty; a null conversation id is a
conversation of its own; rows are taken in the order of turn (nulls first),
role and text, so ties and repeated rows are turns like any other; texts of any
length are rendered whole; an empty table gives an empty result; other columns
aren't read, so none can clash.
"""

from __future__ import annotations

import hashlib
import os.path
import re
from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetlens.llm.common import materialise, small

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

START, END = "<|im_start|>", "<|im_end|>"
_MARK = "\ue000"
_OPENED = re.compile(r"<(\\*)\|")
_SHUT = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    """No ``<|`` is left: each gets a backslash between (one more where some are)."""
    return _OPENED.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _SHUT.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def local(reach: int) -> Callable[[Template], Template]:
    """Declares that a turn changes the output by what depends on it and the
    ``reach`` turns before it only: what it adds and what it takes back."""
    def declared(template: Template) -> Template:
        template.reach = reach
        return template
    return declared


def check_lookback(template: Template, lookback: int | None) -> None:
    reach = getattr(template, "reach", None)
    if lookback is not None and (reach is None or lookback < 2 * reach + 2):
        raise ValueError("lookback needs a template declared local, and 2 * reach + 2 turns at least")


@local(reach=0)
def turn_template(turns: list[Turn]) -> str:
    """Every turn between control strings; those inside roles and texts are escaped."""
    return "".join(f"{START}{escape_role(role)}\n{escape(text)}{END}\n" for role, text in turns)


def render_spans(turns: Iterator[Turn], template: Template, lookback: int | None = None,
                 earlier: list[Turn] | None = None) -> Iterator[tuple[str, int, int, int]]:
    """Per turn: what the output gained, characters taken back before that, and
    the text's span inside the gain (-1, -1 if the template doesn't show it).
    A conversation of more than ``lookback`` turns needs a local template.
    ``earlier``: the turns just before, if these aren't the conversation's first."""
    seen: list[Turn] = list(earlier or [])
    before = template(seen)
    lead = before if earlier is None else ""
    for turn in turns:
        if lookback is not None and len(seen) >= lookback:
            check_lookback(template, lookback)
            seen = seen[len(seen) // 2 + 1:]
            before = template(seen)
        now = template([*seen, turn])
        common = len(before) if now.startswith(before) else len(os.path.commonprefix([before, now]))
        gain, back = now[common:], len(before) - common
        # the same prefix with a marker as the text, one that occurs nowhere in it
        mark, tries = _MARK, 0
        while mark in now or mark in before:
            mark, tries = f"{_MARK}{tries}{_MARK}", tries + 1
        probe = template([*seen, (turn[0], mark)])
        at = probe.find(mark)
        head, tail = (probe[common:at], probe[at + len(mark):]) if at >= common else ("", None)
        if tail is not None and gain.startswith(head) and gain.endswith(tail) and len(gain) >= len(head) + len(tail):
            span = (len(head), len(gain) - len(tail))
        else:
            span = (-1, -1)
        if lead:  # what the template puts before the first turn belongs to its span
            gain, span, lead = lead + gain, tuple(x + len(lead) if x >= 0 else x for x in span), ""
        yield gain, back, *span
        seen.append(turn)
        before = now


def _runs(batches, columns: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Rows in order, as one iterator per run of equal values in the first ``columns``."""
    rows = (r for b in batches for r in zip(*[c.to_pylist() for c in b.columns]))
    row = next(rows, None)

    def run(key):
        nonlocal row
        while row is not None and row[:columns] == key:
            yield row
            row = next(rows, None)

    while row is not None:
        key = row[:columns]
        yield key, (own := run(key))
        for _ in own:
            pass


def _written(rows: Iterator[tuple], names: list[str], schema: pa.Schema, size: int = 4096):
    held = []
    for r in rows:
        held.append(r)
        if len(held) >= size:
            yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*held)))), schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*held)))), schema)


def _in_blocks(src: DataFrame, reach: int, block_turns: int) -> DataFrame:
    """``src`` with ``blk`` and ``i``: conversations above ``block_turns`` turns
    in blocks of so many, numbered in order, each with the ``reach`` turns
    before it; others whole, with a null ``i``."""
    turn = F.col("turn").cast("double")
    spans = src.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.min(turn).alias("lo"), F.max(turn).alias("hi"))
    width = F.greatest(F.lit(1.0), (F.col("hi") - F.col("lo") + 1) * block_turns / F.col("n"))
    long = materialise(spans.where(F.col("n") > block_turns).select(F.col("conv_id").alias("c"), "lo", width.alias("width")), "chat-long")
    whole = src.withColumns({"blk": F.lit(0).cast("long"), "i": F.lit(None).cast("long")})
    if long.isEmpty():
        return whole
    long = small(long)
    same = F.col("conv_id").eqNullSafe(F.col("c"))
    bucket = F.coalesce(F.floor((turn - F.col("lo")) / F.col("width")), F.lit(-1)).cast("long")
    rows = src.join(long, same).select(*src.columns, bucket.alias("b"))
    counts = rows.groupBy("conv_id", "b").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialise(counts.select(F.col("conv_id").alias("c"), F.col("b").alias("at"),
                                       F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")), "chat-starts")
    own = Window.partitionBy("conv_id", "b").orderBy("turn", "role", "text")
    placed = (rows.join(small(starts), same & (F.col("b") == F.col("at")))
              .withColumn("i", F.col("start") + F.row_number().over(own) - 1))
    blk = F.floor(F.col("i") / block_turns).cast("long")
    copied = F.when(F.col("i") % block_turns >= block_turns - reach, F.array(blk, blk + 1)).otherwise(F.array(blk))
    placed = placed.withColumn("blk", F.explode(copied)).select(whole.columns)
    return whole.join(long, same, "left_anti").unionByName(placed)


def format_conversations(rows: DataFrame, template: Template = turn_template, conv: str = "conv_id",
                         turn: str = "turn", role: str = "role", text: str = "text",
                         learn_from: tuple[str, ...] = ("assistant",), lookback: int | None = None,
                         block_turns: int = 512) -> DataFrame:
    """One row per turn: ``conv_id, n, gain, back, loss_from, loss_to``. A
    conversation's formatted text is built by appending the gains in order, each
    after taking ``back`` characters off the end; ``loss_from`` and ``loss_to``
    mark the text to learn from inside the gain (-1 where there is none).
    ``lookback`` (off by default) is for local templates, see the module's text."""
    check_lookback(template, lookback)
    src = rows.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"),
                      F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    reach = getattr(template, "reach", None)
    if reach is None:
        parts = src.withColumns({"blk": F.lit(0).cast("long"), "i": F.lit(None).cast("long")})
    else:
        block_turns = max(block_turns, reach + 1)
        parts = _in_blocks(src, reach, block_turns)
    ordered = (parts.repartition("conv_id", "blk").sortWithinPartitions("conv_id", "blk", "i", "turn", "role", "text")
               .select("conv_id", "blk", "i", "role", "text"))
    names = ["conv_id", "n", "gain", "back", "loss_from", "loss_to"]
    arrow = pa.schema([("conv_id", pa.int64()), ("n", pa.int64()), ("gain", pa.string()), ("back", pa.int64()),
                       ("loss_from", pa.int64()), ("loss_to", pa.int64())])

    def run(batches):
        def out():
            for (key, blk), own in _runs(batches, 2):
                roles: list[str] = []
                first, earlier = blk * block_turns, [] if blk else None
                if blk:
                    for row in own:
                        if row[2] >= first:
                            own = chain([row], own)
                            break
                        earlier.append(row[3:])

                def turns(own=own, roles=roles):
                    for *_, r, t in own:
                        roles[:] = [r]
                        yield r, t

                for n, (gain, back, a, b) in enumerate(render_spans(turns(), template, lookback, earlier), first):
                    learn = roles[0] in learn_from
                    yield key, n, gain, back, a if learn else -1, b if learn else -1
        yield from _written(out(), names, arrow)

    return ordered.mapInArrow(run, "conv_id long, n long, gain string, back long, loss_from long, loss_to long")


def read_conversations(formatted: DataFrame) -> DataFrame:
    """Digests read back from formatted turns of ``turn_template``: one row per conversation."""
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "n")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    arrow = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                       ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches):
        def out():
            for (key,), own in _runs(batches, 1):
                turns, loss, n, loss_chars, chars, text = hashlib.sha256(), hashlib.sha256(), 0, 0, 0, ""
                for _, _, gain, back, a, b in own:
                    if back:
                        raise ValueError("this reader needs a template that leaves history alone")
                    chars += len(gain)
                    if a >= 0:
                        learned = unescape(gain[a:b])
                        loss_chars += len(learned)
                        loss.update(learned.encode())
                    text += gain
                    while (end := text.find(END + "\n")) >= 0:
                        role, _, body = text[:end].removeprefix(START).partition("\n")
                        turns.update(f"{unescape_role(role)}\n{unescape(body)}\n".encode())
                        n += 1
                        text = text[end + len(END) + 1:]
                if text:
                    raise ValueError("formatted text ends inside a turn")
                yield key, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars
        yield from _written(out(), names, arrow)

    schema = T.StructType([T.StructField(x, T.StringType() if x.endswith("sha256") else T.LongType()) for x in names])
    return ordered.mapInArrow(run, schema)


def conversation_digests(rows: DataFrame, **options) -> DataFrame:
    """Format all conversations, write the result, and read it back."""
    return read_conversations(materialise(format_conversations(rows, **options), "formatted-chat"))
