"""Chat formatting of typed content parts.

A visitor flattens the parts of a turn (text, image, audio, document) in order: text is escaped, every attachment
becomes a placeholder with its number in the conversation, its reference is recorded, and its tokens are counted as
expanded (image tiles, audio seconds, document pages). Turns are marked by control strings; a text can't hold one, as
every "<" and every backslash in it is followed by a backslash, which read() takes away again; in a role every ">" is too, so its mark
ends at the first ">" before a line end.

    <s><turn user>\\nHello\\n</turn><turn assistant>\\nHi\\n</turn></s>

Formatting streams: rows are dealt by conversation and sorted by turn inside tasks, and every turn gives one row, so a
conversation of any length is never held in memory. assemble() joins the segments for consumers that want one string.

Defined results: a null text is empty, a null role too; turns are ordered by turn (null first), then role, then text, so
repeated rows stay, next to each other; parts of an unknown type give nothing; an empty table gives an empty result;
rows with a null conv_id form one conversation. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ESCAPED = "<\\"
OPEN, CLOSE, END_TURN = "<s>", "</s>", "\n</turn>"
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
TILE, TILE_TOKENS, TOKENS_A_SECOND, TOKENS_A_PAGE = 448, 256, 25, 500
SEGMENT = "conv_id long, seq long, role string, segment string, mask array<struct<start:int,end:int>>, attachments array<struct<n:int,type:string,ref:string,tokens:long>>, tokens long"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "<\\") if "<" in text or "\\" in text else text


def escape_role(role: str) -> str:
    """As a text, and every ">" is followed by a backslash too: a role can't end its own mark."""
    return escape(role).replace(">", ">\\")


def unescape(text: str, marks: str = "<") -> str:
    if "\\" not in text:
        return text
    out, i = [], 0
    while True:
        at = text.find("\\", i)
        if at < 0:
            out.append(text[i:])
            return "".join(out)
        # "<\" stands for "<"; a backslash not after a mark stands with its twin
        if at > i and text[at - 1] in marks:
            out.append(text[i:at])
            i = at + 1
        else:
            out.append(text[i : at + 1])
            i = at + 2


class Visitor:
    """Flattens the parts of one conversation's turns; numbers attachments across them."""

    def __init__(self) -> None:
        self.count = 0

    def turn(self, parts: list[dict | None]) -> tuple[str, list[dict], int]:
        self.out, self.attachments, self.tokens = [], [], 0
        for part in parts:
            getattr(self, f"visit_{(part or {}).get('type')}", self.visit_other)(part)
        return "".join(self.out), self.attachments, self.tokens

    def visit_text(self, part: dict) -> None:
        text = part.get("text") or ""
        self.out.append(escape(text))
        self.tokens += len(text.split())

    def visit_image(self, part: dict) -> None:
        tiles = math.ceil((part.get("width") or 1) / TILE) * math.ceil((part.get("height") or 1) / TILE)
        self.attach(part, tiles * TILE_TOKENS)

    def visit_audio(self, part: dict) -> None:
        self.attach(part, math.ceil((part.get("seconds") or 0) * TOKENS_A_SECOND))

    def visit_document(self, part: dict) -> None:
        self.attach(part, (part.get("pages") or 1) * TOKENS_A_PAGE)

    def visit_other(self, part: dict | None) -> None:
        pass

    def attach(self, part: dict, tokens: int) -> None:
        self.count += 1
        self.attachments.append({"n": self.count, "type": part["type"], "ref": part.get("ref"), "tokens": tokens})
        self.out.append(f"<{part['type']} {self.count}>")
        self.tokens += tokens


def format_conversations(turns: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Segments of turns(conv_id, turn, role, text, or parts array<PART> in its place), in order within each task.

    One row a turn and a last one that closes the conversation: conv_id, seq, role, segment, mask (code points of the
    segment under the loss), attachments, tokens (expanded).
    """
    if "parts" in turns.columns:
        parts, text = F.col("parts").cast(f"array<{PART}>"), F.lit(None).cast("string")
    else:
        parts, text = F.lit(None).cast(f"array<{PART}>"), F.col("text")
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), text.alias("text"), parts.alias("parts"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    kind = pa.schema([("conv_id", pa.int64()), ("seq", pa.int64()), ("role", pa.string()), ("segment", pa.string()), ("mask", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("attachments", pa.list_(pa.struct([("n", pa.int32()), ("type", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))), ("tokens", pa.int64())])

    def run(batches):
        conv, seq, visitor = (), 0, None
        out = []
        for batch in batches:
            for row in batch.to_pylist():
                head = ""
                if conv != (row["conv_id"],):
                    if conv:
                        out.append(closing(conv[0], seq))
                    conv, seq, visitor, head = (row["conv_id"],), 0, Visitor(), OPEN
                given = row["parts"] if row["parts"] is not None else [{"type": "text", "text": row["text"]}]
                content, attachments, tokens = visitor.turn(given)
                head += f"<turn {escape_role(row['role'])}>\n"
                mask = [{"start": len(head), "end": len(head) + len(content)}] if row["role"] in loss_roles and content else []
                out.append({"conv_id": conv[0], "seq": seq, "role": row["role"], "segment": f"{head}{content}{END_TURN}", "mask": mask, "attachments": attachments, "tokens": tokens})
                seq += 1
            yield from pa.Table.from_pylist(out, schema=kind).to_batches()
            out = []
        if conv:
            yield from pa.Table.from_pylist([closing(conv[0], seq)], schema=kind).to_batches()

    def closing(conv_id, seq):
        return {"conv_id": conv_id, "seq": seq, "role": None, "segment": CLOSE, "mask": [], "attachments": [], "tokens": 0}

    return rows.mapInArrow(run, SEGMENT)


def assemble(segments: DataFrame) -> DataFrame:
    """conv_id, formatted, tokens: one string a conversation; a conversation then is a row and must fit one."""
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "segment"))), lambda x: x["segment"]), "")
    return segments.groupBy("conv_id").agg(joined.alias("formatted"), F.sum("tokens").alias("tokens"))


class Reader:
    """Reads the formatted text of one conversation back, segment by segment."""

    def __init__(self, conv_id) -> None:
        self.conv_id, self.n, self.chars, self.loss = conv_id, 0, 0, 0
        self.all, self.under = hashlib.sha256(), hashlib.sha256()

    def read(self, segment: str, mask: list[dict]) -> None:
        self.chars += len(segment)
        for m in mask:
            text = unescape(segment[m["start"] : m["end"]])
            self.loss += len(text)
            self.under.update(text.encode())
        body = segment.removeprefix(OPEN)
        while body.startswith("<turn "):
            head, rest = body[len("<turn ") :].split(">\n", 1)
            content, body = rest.split(END_TURN, 1)
            self.n += 1
            self.all.update(f"{unescape(head, '<>')}\n{unescape(content)}\n".encode())

    def row(self) -> dict:
        return {"conv_id": self.conv_id, "n_turns": self.n, "turns_sha256": self.all.hexdigest(), "loss_chars": self.loss, "loss_sha256": self.under.hexdigest(), "formatted_chars": self.chars}


def read_back(segments: DataFrame) -> DataFrame:
    """What the formatted output says, read from its segments, one pass, no shuffle. The segments must come as format_conversations() leaves
    them: a conversation's rows in one partition, next to each other, in the order of seq."""
    kind = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches):
        reader = None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["seq"] == 0:
                    reader = Reader(row["conv_id"])
                reader.read(row["segment"], row["mask"])
                if row["segment"] == CLOSE and row["role"] is None:
                    out.append(reader.row())
            yield from pa.Table.from_pylist(out, schema=kind).to_batches()

    return segments.select("conv_id", "seq", "role", "segment", "mask").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
