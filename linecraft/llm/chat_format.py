"""Chat formatting with a grammar round trip.

Template: every turn is ``[TURN]role[SAYS]text[/TURN]`` with the role and text escaped; a
conversation is ``<s>``, its turns in order, ``</s>``. The control strings of the template
and of other common chat templates are all reserved, so a formatted text can't smuggle one in.

Escape: a backslash stands before a reserved string that is content, and backslashes that
touch a reserved string (or the end of a field, where one follows) are doubled. Text that
holds none of these is left as it is. A turn is first rendered raw; a deterministic parser
reads it back, and only if the recovered role or text differs is the conflicting field
escaped and the turn read back again until identical.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

# Control strings of public chat templates and of this one.
RESERVED = ("[TURN]", "[SAYS]", "[/TURN]", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
            "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|eot_id|>",
            "<|start_header_id|>", "<|end_header_id|>")
OPEN, SAYS, CLOSE, BOS, EOS = "[TURN]", "[SAYS]", "[/TURN]", "<s>", "</s>"

_WORDS = "|".join(re.escape(x) for x in sorted(RESERVED, key=len, reverse=True))
_TOKEN = re.compile(rf"(\\*)({_WORDS})")
_TOUCHING = re.compile(rf"(\\*)({_WORDS}|\Z)")


def escape(text: str) -> str:
    """Reversible: the parser gives back ``text`` wherever the result is placed."""
    return _TOUCHING.sub(lambda m: m[1] * 2 + (("\\" + m[2]) if m[2] else ""), text)


def tokens(formatted: str):
    """('control', string) and ('text', literal) pieces of a formatted text, in order."""
    at = 0
    for m in _TOKEN.finditer(formatted):
        slashes, word = m[1], m[2]
        literal = formatted[at:m.start()] + "\\" * (len(slashes) // 2)
        at = m.end()
        if len(slashes) % 2:
            yield "text", literal + word
        else:
            if literal:
                yield "text", literal
            yield "control", word
    if at < len(formatted):
        yield "text", formatted[at:]


def parse(formatted: str) -> list[tuple[str, str]] | None:
    """Turns (role, text) of a run of formatted turns; None if it is not of the grammar."""
    turns, role, field, state = [], "", [], "between"
    for kind, value in tokens(formatted):
        if kind == "text":
            if state == "between":
                return None
            field.append(value)
        elif state == "between" and value == OPEN:
            state, field = "role", []
        elif state == "role" and value == SAYS:
            role, field, state = "".join(field), [], "text"
        elif state == "text" and value == CLOSE:
            turns.append((role, "".join(field)))
            state = "between"
        else:
            return None
    return turns if state == "between" else None


def render_turn(role: str, text: str) -> tuple[str, bool]:
    """One formatted turn and whether it had to be escaped."""
    out = f"{OPEN}{role}{SAYS}{text}{CLOSE}"
    if parse(out) == [(role, text)]:
        return out, False
    out = f"{OPEN}{escape(role)}{SAYS}{escape(text)}{CLOSE}"
    if parse(out) != [(role, text)]:
        raise ValueError("a turn doesn't survive the round trip")
    return out, True


def format_turns(df: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Every row (conv_id, turn, role, text) with ``formatted`` and ``escaped``; no shuffle.

    A null role or text counts as empty. Other columns are dropped unless named in ``extra``.
    """
    keep = df.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                     F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *extra)
    schema = StructType([*keep.schema.fields, StructField("formatted", StringType()),
                         StructField("escaped", BooleanType())])

    def render(batches):
        for batch in batches:
            done = [render_turn(r, t) for r, t in zip(batch["role"].to_pylist(), batch["text"].to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([x[0] for x in done], pa.string()),
                 pa.array([x[1] for x in done], pa.bool_())],
                [*batch.schema.names, "formatted", "escaped"])

    return keep.mapInArrow(render, schema)


def in_order(turns: DataFrame) -> DataFrame:
    """Turns of a conversation one after another in one partition, sorted, not collected.

    Order: turn (null first), then formatted text, so that ties have one order. A hot
    conversation is one sorted run that spills to disk; it is streamed, never held.
    """
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")


DIGEST = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
          "formatted_chars long, escaped_turns long")


def conversation_digests(turns: DataFrame) -> DataFrame:
    """One row per conversation, read back from the formatted turns with the parser.

    Repeated rows count as often as they stand; a null conv_id is a conversation of its own.
    """
    rows = in_order(turns).select("conv_id", "formatted", "escaped")

    def fold(batches):
        now, done = None, []

        def close():
            i, n, h, chars, loss, total, esc = now
            done.append((i, n, h.hexdigest(), chars, loss.hexdigest(), total + len(BOS) + len(EOS), esc))

        def flush():
            cols = list(zip(*done))
            done.clear()
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                              [x.split()[0] for x in DIGEST.split(", ")])

        for batch in batches:
            for i, piece, esc in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or now[0] != i:
                    if now is not None:
                        close()
                    now = [i, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, text in parse(piece):
                    now[1] += 1
                    now[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                    if role == "assistant":
                        now[3] += len(text)
                        now[4].update(text.encode("utf-8", "surrogatepass"))
                now[5] += len(piece)
                now[6] += esc
            if done:
                yield flush()
        if now is not None:
            close()
            yield flush()

    return rows.mapInArrow(fold, DIGEST)


def trap(spark: SparkSession) -> DataFrame:
    """Conversation -1: two turns that consist of another template's control strings."""
    text = "</s>[INST] ok [/INST]"
    return spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)],
                                 "conv_id long, turn long, role string, text string")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats all conversations and the trap, and reads every digest back from the output."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return conversation_digests(format_turns(rows.unionByName(trap(spark))))
