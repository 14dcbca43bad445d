"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it as context, and only its
text under the loss mask.  A conversation that does not end with an assistant turn has one more
example, without any loss, so that the output holds every turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from logquarry.llm.common import materialize, rows_of, ship_package, text_or_empty

TARGET = "assistant"
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), TARGET: ("<s>", "</s>")}
# Any other role: its percent-encoded name stands between these, and the text before the last.
OTHER = ("[ROLE:", "]", "[/ROLE]")
CONTROL = [mark for pair in MARKS.values() for mark in pair] + [OTHER[0], OTHER[2]]
# Characters of a batch of examples.
BATCH_CHARS = 4_000_000
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_OPEN = re.compile("|".join([re.escape(a) for a, _ in MARKS.values()] + [re.escape(OTHER[0]) + r"([^\]]*)\]"]))


def escape(text: str) -> str:
    """A text without control strings: backslashes are doubled, and one is put behind a control string's first character."""
    return _CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    """What was escaped."""
    return re.sub(r"\\(\\?)", r"\1", text)


def marks(role: str) -> tuple[str, str]:
    """What stands before and behind the text of a turn."""
    return MARKS.get(role) or (f"{OTHER[0]}{quote(role, safe='')}{OTHER[1]}", OTHER[2])


def turns_of(formatted: str) -> Iterator[tuple[str, str]]:
    """``(role, text)`` of each turn of a formatted text."""
    roles = {pair[0]: role for role, pair in MARKS.items()}
    at = 0
    while at < len(formatted):
        opening = _OPEN.match(formatted, at)
        role = roles[opening[0]] if opening[0] in roles else unquote(opening[1])
        end = formatted.index(marks(role)[1], opening.end())
        yield role, unescape(formatted[opening.end() : end])
        at = end + len(marks(role)[1])


def chat_examples(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """``(<conv_col>, example, text, loss_start, loss_end, whole)``: the training examples of conversations.

    ``text`` is the formatted context and target, ``loss_start`` and ``loss_end`` the code points of the
    target's escaped text in it; ``whole`` marks the example that holds all turns.  Turns are ordered by
    number, null first, then role and text, so ties and repeated rows each are a turn of their own.  A
    null text or role counts as empty; turns with a null conversation are one conversation.  Other
    columns are not read.  An empty table gives no rows.  A conversation of n turns has up to n examples
    of up to n turns, which one task writes in turn order, holding one example at a time.
    """
    ship_package(turns.sparkSession)
    kind = turns.schema[conv_col].dataType
    arrow = [to_arrow_type(kind), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]
    names = ["conv", "example", "text", "loss_start", "loss_end", "whole"]

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = 0
        context, pending, number = "", None, 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), arrow, strict=True)], names)

        def finish() -> None:
            # The last turn of a conversation: its example holds the whole.
            conv, role, text = pending
            out.append(example(conv, role, text, True))

        def example(conv: object, role: str, text: str, whole: bool) -> tuple:
            before, behind = marks(role)
            start = len(context) + len(before)
            end = start + len(text) if role == TARGET else start
            return conv, number, f"{context}{before}{text}{behind}", start, end, whole

        first = True
        for conv, role, text in rows_of(batches):
            if not first and pending[0] == conv:
                if pending[1] == TARGET:
                    out.append(example(*pending, False))
                    number += 1
                before, behind = marks(pending[1])
                context = f"{context}{before}{pending[2]}{behind}"
            elif not first:
                finish()
                context, number = "", 0
            first = False
            pending = (conv, role, escape(text))
            held += len(context)
            if held >= BATCH_CHARS and out:
                yield batch()
                out, held = [], 0
        if not first:
            finish()
        if out:
            yield batch()

    rows = turns.select(
        F.col(conv_col).alias("conv"),
        F.col(turn_col).alias("turn"),
        text_or_empty(role_col).alias("role"),
        text_or_empty(text_col).alias("text"),
    )
    dealt = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text").select("conv", "role", "text")
    schema = f"conv {kind.simpleString()}, example int, text string, loss_start long, loss_end long, whole boolean"
    return dealt.mapInArrow(expand, schema).withColumnRenamed("conv", conv_col)


def read_back(examples: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """``(<conv_col>, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)`` of written examples.

    The turns are those of the whole example, digested as role, line feed, text, line feed; the loss is
    all text under the masks, unescaped, in order; ``formatted_chars`` counts all examples.
    """
    ship_package(examples.sparkSession)
    kind = examples.schema[conv_col].dataType
    arrow = [to_arrow_type(kind), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = ["conv", "example", "n_turns", "turns_sha256", "loss", "chars"]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, number, text, start, end, whole in rows_of([batch], 64):
                found, digest = None, None
                if whole:
                    found, sha = 0, hashlib.sha256()
                    for role, said in turns_of(text):
                        sha.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                        found += 1
                    digest = sha.hexdigest()
                rows.append((conv, number, found, digest, unescape(text[start:end]), len(text)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), arrow, strict=True)], names)

    schema = f"conv {kind.simpleString()}, example int, n_turns long, turns_sha256 string, loss string, chars long"
    parsed = examples.select(conv_col, "example", "text", "loss_start", "loss_end", "whole").mapInArrow(parse, schema)
    # As many rows a group as the conversation has turns, each with its own text only.
    ordered = F.array_sort(F.collect_list(F.struct("example", "loss"))).alias("parts")
    found = parsed.groupBy("conv").agg(
        F.max("n_turns").alias("n_turns"), F.max("turns_sha256").alias("turns_sha256"), ordered, F.sum("chars").alias("formatted_chars")
    )
    loss = F.array_join(F.transform("parts", lambda part: part["loss"]), "")
    return found.select(
        F.col("conv").alias(conv_col),
        "n_turns",
        "turns_sha256",
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def formatted_conversations(turns: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Conversations formatted, written, and read back from the output."""
    return read_back(materialize(chat_examples(turns, conv_col), "chat_examples"), conv_col)
