"""Chat formatting by a grammar round trip.

A conversation becomes a run of turns

    ### User: text
    </turn>

    turn  := "### " name ": " body newline "</turn>" newline
    name  := System | User | Assistant | '"' quoted role '"'
    body  := any text in which "### " and "</turn>" stand only behind a backslash

A turn is first rendered as it is.  A deterministic parser reads it back; if
role or text differ from the source (or the text does not parse), the turn is
escaped one step further and read again, until it is identical: step 1 puts a
backslash before every control string of the text, step 2 quotes the role as
well.  Then the whole block of turns is parsed and compared once more.  Reading
removes exactly one backslash before a control string, so every text, with
backslashes or control strings of its own, comes back unchanged.

Rows are dealt by range of (conversation, turn), so a conversation of any size
is formatted by many tasks; a task holds one block of at most ``BLOCK_CHARS``
characters (or one longer text).  The output, a Parquet table of blocks, has
the formatted text, the place of the block and the loss mask: code point spans
of the assistant texts.  ``conversations`` reads it back with the same parser:
a conversation that lies in one block is settled where it is read, only blocks
of longer ones are dealt by conversation and streamed in order.  Their digest
is one SHA-256 over the whole conversation, so it must see them in sequence; a
task then holds one batch of blocks, never a conversation.

Defined cases: null text is empty; null role is an empty, quoted role; rows of
one turn number (ties, repeated rows) all stay, ordered by role, then text; a
null turn comes before all others; rows without conversation form one of their
own; an empty table gives an empty result; other columns of the input are
ignored, whatever their names; texts of any length are formatted whole.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick

BLOCK_CHARS = 1 << 14

CONTROL = re.compile(r"### |</turn>")
_ESCAPED = re.compile(r"\\(### |</turn>)")
_HEAD = re.compile(r'### (System|User|Assistant|"((?:[A-Za-z0-9_.-]|%[0-9A-F]{6})*)"): ')
_PLAIN = re.compile(r"[^A-Za-z0-9_.-]")
_CODE = re.compile(r"%([0-9A-F]{6})")
_END = "\n</turn>\n"

BLOCKS = "conv_id {id}, part int, seq long, whole boolean, n_turns int, text string, mask_start array<int>, mask_end array<int>"


class GrammarError(ValueError):
    pass


def render(role: str, text: str, step: int) -> tuple[str, int, int]:
    """The turn's text and the span of its body, escaped to ``step``."""
    name = role.capitalize() if step < 2 else '"' + _PLAIN.sub(lambda m: f"%{ord(m[0]):06X}", role) + '"'
    head = f"### {name}: "
    body = CONTROL.sub(lambda m: "\\" + m[0], text) if step else text
    return head + body + _END, len(head), len(head) + len(body)


def unescape(body: str) -> str:
    return _ESCAPED.sub(r"\1", body)


def parse(text: str) -> list[tuple[str, str, int, int]]:
    """(role, text, body start, body end) of each turn; raises ``GrammarError``."""
    turns, at = [], 0
    while at < len(text):
        head = _HEAD.match(text, at)
        if not head:
            raise GrammarError(f"no turn begins at {at}")
        role = head[1].lower() if head[2] is None else _CODE.sub(lambda m: chr(int(m[1], 16)), head[2])
        body = head.end()
        for mark in CONTROL.finditer(text, body):
            if mark.start() == body or text[mark.start() - 1] != "\\":
                break
        else:
            raise GrammarError("a turn does not end")
        end = mark.start() - 1
        if mark[0] != "</turn>" or end < body or not text.startswith(_END, end):
            raise GrammarError(f"control string inside a turn at {mark.start()}")
        turns.append((role, unescape(text[body:end]), body, end))
        at = end + len(_END)
    return turns


def _reads_back(out: str, turns: list[tuple[str, str]]) -> bool:
    try:
        return [t[:2] for t in parse(out)] == turns
    except GrammarError:
        return False


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The least escaped rendering that the parser reads back as (role, text)."""
    for step in range(3):
        out = render(role, text, step)
        if _reads_back(out[0], [(role, text)]):
            return out
    raise GrammarError(f"turn of role {role!r} does not survive the round trip")


def _blocks(schema: pa.Schema):
    def run(batches):
        seq, held, first, size = 0, [], True, 0

        def block(last: bool, known_end: bool):
            # ``held``: conversation, partition, then (role, text, rendered, start, end) of each turn
            nonlocal seq, first
            conv, part, turns = held[0][0], held[0][1], [t[2:] for t in held]
            text = "".join(t[2] for t in turns)
            if not _reads_back(text, [t[:2] for t in turns]):
                raise GrammarError(f"conversation {conv}: the block does not read back")
            starts, ends, at = [], [], 0
            for role, _, out, s, e in turns:
                if role == "assistant":
                    starts.append(at + s)
                    ends.append(at + e)
                at += len(out)
            row = (conv, part, seq, first and last and known_end, len(turns), text, starts, ends)
            seq += 1
            first = last
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

        begun = False       # a conversation began inside this partition, so its first block is known to be its first
        for b in batches:
            for conv, part, role, text in zip(*(b.column(i).to_pylist() for i in range(4))):
                if held and held[0][0] != conv:
                    yield block(True, begun)
                    held, size, begun = [], 0, True
                elif held and size > BLOCK_CHARS:
                    yield block(False, False)
                    held, size = [], 0
                turn = format_turn(role, text)
                held.append((conv, part, role, text, *turn))
                size += len(turn[0])
        if held:            # the next partition may go on with this conversation
            yield block(True, False)
    return run


def formatted(rows: DataFrame, conv_id: Column | str = "conv_id", turn: Column | str = "turn",
              role: Column | str = "role", text: Column | str = "text") -> DataFrame:
    """Blocks of formatted conversations: text, place and loss mask spans (code points)."""
    own = pick(rows, conv_id=conv_id, turn=turn, role=role, text=text)
    key = own.schema["conv_id"].dataType.simpleString()
    empty = F.lit("")
    own = own.select("conv_id", "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    order = ["conv_id", "turn", "role", "text"]
    dealt = (own.repartitionByRange(*order).sortWithinPartitions(*order)
             .select("conv_id", F.spark_partition_id().alias("part"), "role", "text"))
    ddl = BLOCKS.format(id=key)
    return dealt.mapInArrow(_blocks(_arrow(rows.sparkSession, ddl)), ddl)


def _arrow(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string
    return to_arrow_schema(_parse_datatype_string(ddl))


def write(rows: DataFrame, path: str, **columns) -> None:
    formatted(rows, **columns).write.parquet(path)


def _turns(batches):
    """The turns of each block as they are read back, with what the mask covers of each."""
    for b in batches:
        for conv, part, seq, text, starts, ends in zip(*(b[c].to_pylist() for c in
                                                         ("conv_id", "part", "seq", "text", "mask_start", "mask_end"))):
            mask = dict(zip(starts, ends))
            for k, (role, body, s, e) in enumerate(parse(text)):
                yield conv, part, seq, k, role, body, unescape(text[s:mask[s]]) if s in mask else None


def read_turns(blocks: DataFrame) -> DataFrame:
    """Turns read back from stored blocks: conv_id, part, seq, place, role, text, loss_text (null: not in the mask)."""
    key = blocks.schema["conv_id"].dataType.simpleString()
    ddl = f"conv_id {key}, part int, seq long, place int, role string, text string, loss_text string"
    schema = _arrow(blocks.sparkSession, ddl)

    def run(batches):
        for b in batches:
            rows = list(_turns([b]))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)
    return blocks.mapInArrow(run, ddl)


DIGEST = "conv_id {id}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digests(schema: pa.Schema):
    """One row per run of blocks of the same conversation, from a stream in order."""
    def run(batches):
        now, out = None, []
        for b in batches:
            for conv, text, starts, ends in zip(*(b[c].to_pylist() for c in ("conv_id", "text", "mask_start", "mask_end"))):
                if now is None or now[0] != conv:
                    if now:
                        out.append(now)
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, body, _, _ in parse(text):
                    now[1] += 1
                    now[2].update(f"{role}\n{body}\n".encode())
                for s, e in zip(starts, ends):
                    loss = unescape(text[s:e])
                    now[3] += len(loss)
                    now[4].update(loss.encode())
                now[5] += len(text)
            if len(out) >= 4096:
                yield _rows(out, schema)
                out = []
        yield _rows([*out, *([now] if now else [])], schema)
    return run


def _rows(out: list, schema: pa.Schema) -> pa.RecordBatch:
    plain = [[v.hexdigest() if hasattr(v, "hexdigest") else v for v in r] for r in out]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in plain], f.type) for i, f in enumerate(schema)], schema=schema)


def conversations(blocks: DataFrame) -> DataFrame:
    """Per conversation, read back from stored blocks: turns, their digest, the text under the mask, characters."""
    ddl = DIGEST.format(id=blocks.schema["conv_id"].dataType.simpleString())
    digest = _digests(_arrow(blocks.sparkSession, ddl))
    cols = ["conv_id", "text", "mask_start", "mask_end"]
    alone = blocks.filter("whole").select(cols)
    rest = (blocks.filter("not whole").repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").select(cols))
    return alone.mapInArrow(digest, ddl).unionByName(rest.mapInArrow(digest, ddl))
