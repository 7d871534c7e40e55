"""Chat formatting by event-sourced reconstruction.

A log holds events (conv_id, turn, seq, kind, role, text): ``open`` starts a message,
``delta`` adds to its end, ``edit`` replaces its text, ``regenerate`` empties it for new
deltas and may change its role, ``delete`` takes it out. The events of a message, sorted by
seq, fold into its final state. Messages become turns of the template

    ### Role: text</turn>\\n

in which a backslash stands before every backslash, ``###`` and ``</turn>`` of a role or
text (and before ``:`` in a role), so reading the output gives the messages back. The loss
mask covers the text of assistant turns.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KINDS = ("open", "delta", "edit", "regenerate", "delete")
EVENT = "conv_id long, turn long, part long, seq long, kind string, role string, text string"


def escape(text: str, extra: str = "") -> str:
    return re.sub(r"\\|###|</turn>" + (f"|{re.escape(extra)}" if extra else ""), lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(\\|###|</turn>|:)", r"\1", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn, and where its text starts and stops in it."""
    head = f"### {escape(role, ':')}: "
    body = escape(text)
    return f"{head}{body}</turn>\n", len(head), len(head) + len(body)


TURN = re.compile(r"### ((?:[^\\:]|\\.)*?): ((?:[^\\<]|\\(?:\\|###|</turn>)|<(?!/turn>))*)</turn>\n", re.S)


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, stop) of each turn of a formatted stretch of whole turns; ValueError if it is none."""
    out, at = [], 0
    while at < len(formatted):
        found = TURN.match(formatted, at)
        if not found:
            raise ValueError("not a formatted conversation")
        out.append((unescape(found[1]), unescape(found[2]), found.start(2), found.end(2)))
        at = found.end()
    return out


MESSAGE = "conv_id long, turn long, part long, role string, text string"
FORMATTED = "conv_id long, turn long, part long, formatted string, loss_start long, loss_stop long"


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    kinds = [pa.int64() if k == "long" else pa.string() for _, k in fields]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [n for n, _ in fields])


def in_order(events: DataFrame) -> DataFrame:
    """The log dealt by conversation, its events in order: one shuffle serves folding and all that follows."""
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    dealt = events.select("conv_id", "turn", "part", "seq", "kind", "role", "text").repartition("conv_id")
    return dealt.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "part", F.col("seq").asc_nulls_first(), order, "text")


def folded(batches):
    """Batches of ordered events to batches of messages; a message's events are held, not its conversation's."""
    now, role, parts, alive = None, "", [], False

    def message():
        return (*now, role, "".join(parts))

    for batch in batches:
        rows = []
        for conv, turn, part, _, kind, who, text in zip(*(c.to_pylist() for c in batch.columns[:7])):
            key = (conv, turn, part)
            if key != now:
                if alive:
                    rows.append(message())
                now, role, parts, alive = key, "", [], False
            if kind == "delta":
                parts.append(text or "")
                role = role or who or ""
            elif kind in ("open", "regenerate"):
                parts, role = [text or ""], who or role
            elif kind == "edit":
                parts = [text or ""]
            elif kind != "delete":
                raise ValueError(f"unknown event {kind!r}")
            alive = kind != "delete"
        yield _batch(rows, MESSAGE)
    yield _batch([message()] if alive else [], MESSAGE)


def formatted(batches):
    """Batches of messages to batches of formatted turns with their loss spans."""
    for batch in batches:
        rows = []
        for conv, turn, part, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            out, start, stop = render(role, text)
            rows.append((conv, turn, part, out, *((start, stop) if role == "assistant" else (0, 0))))
        yield _batch(rows, FORMATTED)


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, turn, part, role, text): the final message of each (conv_id, turn, part).

    A conversation's events stream through one task in the order of turn, part and seq (ties
    by kind in the order above, then text); what is held is a message. Null roles and texts
    are empty, null seqs come first; an unknown kind raises an error. A message that was
    deleted has no row.
    """
    return in_order(events).mapInArrow(folded, MESSAGE)


def format_messages(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, part, formatted, loss_start, loss_stop): a row for each turn; its loss span is empty unless an assistant speaks."""
    return messages.select("conv_id", "turn", "part", "role", "text").mapInArrow(formatted, FORMATTED)


def format_log(events: DataFrame) -> DataFrame:
    """The formatted turns of a log of events, a conversation's in one partition and in order."""
    return in_order(events).mapInArrow(lambda batches: formatted(folded(batches)), FORMATTED)


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted): whole conversations as one text, for those that are known to fit a row."""
    ordered = F.sort_array(F.collect_list(F.struct("turn", "part", "formatted")))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: x["formatted"]), "").alias("formatted"))


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(turns: DataFrame, ordered: bool = False) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of each conversation, parsed from its formatted turns.

    A conversation's turns stream in order through the digests, which hold nothing of it.
    ``ordered``: they already stand so, as ``format_log`` leaves them. Null ids are a
    conversation of their own.
    """

    def run(batches):
        now, state, seen = None, None, False

        def row():
            return (now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

        for batch in batches:
            rows = []
            for conv, text, start, stop in zip(*(batch.column(i).to_pylist() for i in (0, 3, 4, 5))):
                if not seen or conv != now:
                    if seen:
                        rows.append(row())
                    now, state, seen = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0], True
                ((role, plain, _, _),) = parse(text)
                lost = unescape(text[start:stop])
                state[0] += 1
                state[1].update(f"{role}\n{plain}\n".encode())
                state[2] += len(lost)
                state[3].update(lost.encode())
                state[4] += len(text)
            yield _batch(rows, DIGESTS)
        yield _batch([row()] if seen else [], DIGESTS)

    turns = turns.select("conv_id", "turn", "part", "formatted", "loss_start", "loss_stop")
    if not ordered:
        turns = turns.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "part")
    return turns.mapInArrow(run, DIGESTS)


def finished(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, part, role, text) of a table of messages. Rows with one turn number are messages of their own (part), in the order of role and text."""
    same = W.partitionBy("conv_id", "turn").orderBy("role", "text")
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").repartition("conv_id")
    return rows.withColumn("part", F.row_number().over(same).cast("long"))


def events_of(rows: DataFrame) -> DataFrame:
    """A table of finished messages (conv_id, turn, role, text) as a log: each row opens its message."""
    return finished(rows).withColumn("seq", F.lit(0).cast("long")).withColumn("kind", F.lit("open"))


def streamed(rows: DataFrame) -> DataFrame:
    """A table of finished messages as the log of a chat that ended so.

    By a hash of conversation and turn a message is opened with its text; or opened empty
    and streamed in two deltas; or drafted, regenerated and streamed; or drafted and edited.
    """
    text, half = F.col("text"), F.floor(F.char_length("text") / 2).cast("int")
    first, rest = F.substring(text, F.lit(1), half), F.substring(text, half + 1, F.char_length(text))

    def log(*events):
        return F.array(*[F.struct(F.lit(i).cast("long").alias("seq"), F.lit(kind).alias("kind"), what.alias("text")) for i, (kind, what) in enumerate(events)])

    none, draft = F.lit(""), F.lit("### draft </turn>")
    way = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(4))
    events = (
        F.when(way == 0, log(("open", text)))
        .when(way == 1, log(("open", none), ("delta", first), ("delta", rest)))
        .when(way == 2, log(("open", draft), ("delta", draft), ("regenerate", none), ("delta", first), ("delta", rest)))
        .otherwise(log(("open", draft), ("delta", draft), ("edit", text)))
    )
    return finished(rows).withColumn("e", F.explode(events)).select("conv_id", "turn", "part", "e.seq", "e.kind", "role", "e.text")


#: Rows that use the template's own control strings.
HARD = r"\### Assistant: </turn> ok"


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hard = spark.createDataFrame([(-7, 0, "user", HARD), (-7, 1, "assistant", HARD)], "conv_id long, turn long, role string, text string")
    return read_back(format_log(streamed(rows.union(hard))), ordered=True)
