"""Chat formatting with typed content parts.

A turn is a role and an array of parts (type, text, ref, tokens). A visitor flattens the parts, in order: text is escaped,
an image, audio or document part becomes a numbered placeholder, and its reference and the number of tokens it expands to
are recorded. A turn is written as <s>ROLE[INST]BODY[/INST]</s>. All control strings begin with < or [; inside roles and
texts these two and the backslash get a backslash before them, so a text that holds control strings reads back unchanged.

The loss mask is a span of characters per turn: the body of a turn of the trained role, and an empty span otherwise. Only
text counts under it, placeholders do not.

parse_turn() gives back role and parts from a formatted turn and its attachments; text parts next to each other come back as
one. In the digest of turns a turn with attachments stands for its parts, so that no text can look like one.

Nulls: a null role or text counts as empty, null parts as none; a part of an unknown type counts as text. Turns that share a
number follow each other by role and text. A conversation is read as a stream of its turns and never held whole.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART = "struct<type:string,text:string,ref:string,tokens:int>"
ATTACHMENT = pa.struct([("place", pa.int32()), ("type", pa.string()), ("ref", pa.string()), ("tokens", pa.int32())])
FORMATTED = "conv_id long, turn long, role string, formatted string, loss_start int, loss_end int, expanded_tokens long, attachments array<struct<place:int,type:string,ref:string,tokens:int>>"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
TURN = re.compile(r"<s>((?:[^\\<\[]+|\\.)*)\[INST\]((?:[^\\<\[]+|\\.|\[(?:IMAGE|AUDIO|DOCUMENT) \d+\])*)\[/INST\]</s>", re.DOTALL)
PLACE = re.compile(r"\\.|\[(?:IMAGE|AUDIO|DOCUMENT) (\d+)\]", re.DOTALL)
HELD = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    """Text in which no control string is left."""
    return text.replace("\\", "\\\\").replace("<", "\\<").replace("[", "\\[")


def unescape(text: str) -> str:
    """What escape() was given."""
    return HELD.sub(r"\1", text) if "\\" in text else text


def split_body(body: str) -> list[str | int]:
    """Texts (unescaped) and numbers of placeholders of a body, in order."""
    out: list[str | int] = []
    at = 0
    for m in PLACE.finditer(body):
        if m.group(1) is not None:
            out += [unescape(body[at : m.start()]), int(m.group(1))]
            at = m.end()
    out.append(unescape(body[at:]))
    return [x for x in out if x != ""]


def parse_turn(formatted: str, attachments: list[dict]) -> tuple[str, list[dict]]:
    """(role, parts) of a formatted turn."""
    role, body = TURN.fullmatch(formatted).groups()
    held = {a["place"]: a for a in attachments}
    parts = [{"type": "text", "text": x, "ref": None, "tokens": None} if isinstance(x, str) else {"type": held[x]["type"], "text": None, "ref": held[x]["ref"], "tokens": held[x]["tokens"]} for x in split_body(body)]
    return unescape(role), parts


def _said(role: str, body: str, attachments: list[dict]) -> bytes:
    """What a turn adds to the digest of turns."""
    if not attachments:
        return f"{unescape(role)}\n{unescape(body)}\n".encode()
    parts = [x if isinstance(x, str) else [x, *((a["type"], a["ref"], a["tokens"]) for a in attachments if a["place"] == x)] for x in split_body(body)]
    return f"{unescape(role)}\n".encode() + hashlib.sha256(json.dumps(parts).encode()).digest() + b"\n"


class Flattener:
    """Visits the parts of one turn and gathers its body, attachments and tokens."""

    def __init__(self) -> None:
        self.body: list[str] = []
        self.attachments: list[dict] = []
        self.expanded = 0

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part['type'] or 'text'}", self.visit_text)(part)

    def visit_text(self, part: dict) -> None:
        self.body.append(escape(part["text"] or ""))

    def visit_image(self, part: dict) -> None:
        self._attach("IMAGE", part)

    def visit_audio(self, part: dict) -> None:
        self._attach("AUDIO", part)

    def visit_document(self, part: dict) -> None:
        self._attach("DOCUMENT", part)

    def _attach(self, name: str, part: dict) -> None:
        place = len(self.attachments)
        self.body.append(f"[{name} {place}]")
        self.attachments.append({"place": place, "type": part["type"], "ref": part["ref"], "tokens": part["tokens"] or 0})
        self.expanded += part["tokens"] or 0


def _format(trained: str):
    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            out: dict[str, list] = {k: [] for k in ("formatted", "loss_start", "loss_end", "expanded_tokens", "attachments")}
            for role, parts in zip(batch.column("role").to_pylist(), batch.column("parts").to_pylist()):
                seen = Flattener()
                for part in parts or []:
                    if part is not None:
                        seen.visit(part)
                head, body = f"<s>{escape(role or '')}[INST]", "".join(seen.body)
                out["formatted"].append(f"{head}{body}[/INST]</s>")
                out["loss_start"].append(len(head))
                out["loss_end"].append(len(head) + (len(body) if role == trained else 0))
                out["expanded_tokens"].append(seen.expanded)
                out["attachments"].append(seen.attachments)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("conv_id"), batch.column("turn"), batch.column("role"), pa.array(out["formatted"], pa.string()), pa.array(out["loss_start"], pa.int32()),
                    pa.array(out["loss_end"], pa.int32()), pa.array(out["expanded_tokens"], pa.int64()), pa.array(out["attachments"], pa.list_(ATTACHMENT)),
                ],
                ["conv_id", "turn", "role", "formatted", "loss_start", "loss_end", "expanded_tokens", "attachments"],
            )

    return run


def text_parts(text: Column | str) -> Column:
    """A turn that has only text, as an array of parts."""
    none = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("type"), F.col(text).alias("text") if isinstance(text, str) else text.alias("text"), none.cast("string").alias("ref"), none.cast("int").alias("tokens"))).cast(f"array<{PART}>")


def format_turns(turns: DataFrame, parts: str = "parts", trained: str = "assistant") -> DataFrame:
    """One row per turn: its formatted text, its loss span in it, its attachments and the tokens they expand to."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role"), F.col(parts).alias("parts"))
    return rows.mapInArrow(_format(trained), FORMATTED)


def _read(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by conversation and turn; everything is taken from the formatted text and its spans."""
    now: tuple | None = None
    n = loss_chars = chars = 0
    turns_hash, loss_hash = hashlib.sha256(), hashlib.sha256()

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    for batch in found:
        done = []
        for conv, formatted, a, b, attachments in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_end", "attachments"))):
            if (conv,) != now:
                if now is not None:
                    done.append((*now, n, turns_hash.hexdigest(), loss_chars, loss_hash.hexdigest(), chars))
                now, n, loss_chars, chars, turns_hash, loss_hash = (conv,), 0, 0, 0, hashlib.sha256(), hashlib.sha256()
            chars += len(formatted)
            for role, body in TURN.findall(formatted):
                n += 1
                turns_hash.update(_said(role, body, attachments or []))
            loss = "".join(x for x in split_body(formatted[a:b]) if isinstance(x, str))
            loss_chars += len(loss)
            loss_hash.update(loss.encode())
        if done:
            yield batch_of(done)
    if now is not None:
        yield batch_of([(*now, n, turns_hash.hexdigest(), loss_chars, loss_hash.hexdigest(), chars)])


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from the formatted turns: counts and digests of its turns and of the text under the loss mask."""
    dealt = formatted.select("conv_id", "turn", "role", "formatted", "loss_start", "loss_end", "attachments").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "formatted")
    return dealt.drop("turn", "role").mapInArrow(_read, DIGESTS)
