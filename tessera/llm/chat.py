"""Chat formatting by incremental rendering of a black-box template.

A template turns a list of (role, text) into one string.  Successive prefixes
of a conversation are rendered and consecutive outputs compared: if the longer
output begins with the shorter one, the rest is the new turn's span; if not,
the template rewrote history and the conversation is flagged.  Where a turn's
text lies within its span is found by rendering the turn once more around a
probe text.  Assistant texts under the loss mask follow from these spans.

Rows are dealt by conversation and sorted by turn; tasks stream over them and
hold one conversation.  Every prefix is rendered and compared with the one
before, whatever its length, for a black box may rewrite history at any turn: the
work is the square of a conversation's turns (a template may keep what it made
of a turn, as ``MarkedTurns`` does, so that only the joining is repeated).

Defined results: a null text or role is empty; turns are ordered by (turn, role,
text), nulls first, so ties have one order and repeated rows are turns of their
own; rows with a null ``conv_id`` are one conversation; an empty table gives no
rows.  Columns other than the four named are not read.  A turn whose text isn't
found in its span has start and end -1 and is reported as ``unplaced``; it is
outside the loss mask.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import parts

#: Text that stands in for a turn's own while its place is located.
PROBE = "\ue000probe\ue000"


def escape(text: str) -> str:
    """Puts one backslash more between < and |, so that no control string is left."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text) if "<" in text else text


def unescape(text: str) -> str:
    """The inverse of ``escape``."""
    return re.sub(r"<\\(\\*)\|", r"<\1|", text) if "<" in text else text


def _role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _unrole(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


@lru_cache(4096)
def marked(role: str, text: str) -> str:
    return f"<|im_start|>{_role(role)}\n{escape(text)}<|im_end|>\n"


class MarkedTurns:
    """Turns between start and end marks; control strings in texts are escaped."""

    turn = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)

    def __call__(self, messages: list[tuple[str, str]]) -> str:
        return "".join(marked(r, t) for r, t in messages)

    def read(self, buffer: str) -> tuple[list[tuple[str, str]], str]:
        """(complete turns of an output, what is left of it)."""
        found, end = [], 0
        while m := self.turn.match(buffer, end):
            found.append((_unrole(m[1]), unescape(m[2])))
            end = m.end()
        return found, buffer[end:]


class Spans:
    """Renders the successive prefixes of one conversation."""

    def __init__(self, template):
        self.template, self.messages = template, []
        self.output, self.rewrites = "", False

    def push(self, role: str, text: str) -> tuple[str, int, int]:
        """(the turn's piece of the output, start and end of its text in the
        piece); start is -1 if the text isn't found there, or if the template
        rewrote what it had rendered: then the piece is the whole output."""
        self.messages.append((role, text))
        before, output = self.output, self.template(self.messages)
        if not output.startswith(before):
            return self._rewritten()
        self.output, piece = output, output[len(before) :]
        probed = self.template([*self.messages[:-1], (role, PROBE)])
        at = probed.find(PROBE, len(before))
        tail = len(probed) - at - len(PROBE)
        start, end = at - len(before), len(piece) - tail
        if at < 0 or not probed.startswith(before) or start > end:
            start = end = -1
        return piece, start, end

    def _rewritten(self) -> tuple[str, int, int]:
        self.rewrites, self.output = True, self.template(self.messages)
        return self.output, -1, -1


PIECES = "conv_id long, piece string, text_start int, text_end int, in_loss boolean, rewrites boolean, unplaced boolean"


def _turns(batches) -> Iterator[tuple]:
    """(conversation, role, text, whether it is the conversation's last) of sorted rows."""
    held = None
    for batch in batches:
        for row in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if held is not None:
                yield *held, held[0] != row[0]
            held = row
    if held is not None:
        yield *held, True


def format_turns(df: DataFrame, template, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_roles: Iterable[str] = ("assistant",)) -> DataFrame:
    """One row a turn: its piece of the conversation's output (the pieces in
    order are the output), the span of its text in the piece, whether that span
    is under the loss mask, whether history was rewritten, and whether a text
    that belongs under the mask has no place."""
    loss = frozenset(loss_roles)
    rows = df.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    dealt = rows.repartition(parts(df.sparkSession, df), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches):
        spans, out, size = None, [], 0
        for conv, r, t, last in _turns(batches):
            spans = spans or Spans(template)
            piece, start, end = spans.push(r, t)
            out.append((conv, piece, start, end, r in loss and start >= 0, spans.rewrites, r in loss and start < 0))
            size += len(piece)
            if last:
                spans = None
            if size > 1 << 20 or len(out) >= 10_000:
                yield _batch(out)
                out, size = [], 0
        if out:
            yield _batch(out)

    return dealt.mapInArrow(run, PIECES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.bool_()]
    names = [f.split()[0] for f in PIECES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites boolean, unplaced long"


def read_back(pieces: DataFrame, template) -> DataFrame:
    """Parses each conversation's output again and digests what it holds.

    ``pieces`` come straight from ``format_turns``: a conversation's rows stand
    together, in order.  The turns are read from the joined output by its marks
    alone; the texts under the loss mask from the mask's spans.
    """

    def run(batches) -> Iterator[pa.RecordBatch]:
        now, state, done = object(), None, []

        def close():
            if state is not None:
                if state["left"]:
                    raise ValueError(f"conversation {now}: its output does not end with a turn")
                done.append((now, state["turns"], state["all"].hexdigest(), state["chars"], state["loss"].hexdigest(), state["size"], state["rewrites"], state["unplaced"]))

        for batch in batches:
            for r in batch.to_pylist():
                if r["conv_id"] != now:
                    close()
                    now, state = r["conv_id"], {"turns": 0, "all": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "size": 0, "left": "", "rewrites": False, "unplaced": 0}
                if r["rewrites"] and not state["rewrites"]:
                    state |= {"turns": 0, "all": hashlib.sha256(), "size": 0, "left": "", "rewrites": True}
                state["size"] += len(r["piece"])
                turns, state["left"] = template.read(state["left"] + r["piece"])
                for role, text in turns:
                    state["turns"] += 1
                    state["all"].update(f"{role}\n{text}\n".encode())
                state["unplaced"] += r["unplaced"]
                if r["in_loss"]:
                    text = unescape(r["piece"][r["text_start"] : r["text_end"]])
                    state["chars"] += len(text)
                    state["loss"].update(text.encode())
            if done:
                yield _digests(done)
                done = []
        close()
        if done:
            yield _digests(done)

    return pieces.mapInArrow(run, DIGESTS)


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=[f.split()[0] for f in DIGESTS.split(", ")])
