"""Operator 9, chat formatting by incremental black-box rendering.

A template is a function from turns to one string; nothing else about it is known. Every prefix of the turns
is rendered and compared with the one before: where the shorter output begins the longer, the rest is the new
turn's span; where it doesn't, the template rewrites history. Probes, which put a character that occurs
nowhere else in place of a turn's text, locate header and footer, and tell the role. Control strings inside
texts are escaped reversibly before rendering; what is read back is held against what went in.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

#: Strings that mark turns in common chat templates.
CONTROL_STRINGS = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

_CONTROL = re.compile("|".join(map(re.escape, CONTROL_STRINGS)))
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    """Double every backslash, then break each control string with one after its first character."""
    return _CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


def chatml(turns: list[Turn]) -> str:
    return "".join(f"<|im_start|>{role}\n{text}<|im_end|>\n" for role, text in turns)


@dataclass
class Located:
    """A turn in the output: its role as the output shows it, and (start, end) of its text there."""

    role: str
    start: int
    end: int


@dataclass
class Rendered:
    """``output``; per turn its (start, end) in it, none for a template that rewrites history; ``turns``: those
    that can be read back; whether a turn of the input is missing from these or reads differently."""

    output: str = ""
    spans: list[tuple[int, int]] = field(default_factory=list)
    turns: list[Located] = field(default_factory=list)
    rewrites_history: bool = False
    alters_content: bool = False


#: A role with what its turn puts before and after the text.
Frame = tuple[str, str, str]


def _frames(template: Template, before: list[Turn], after: list[Turn], roles: list[str], mark: str, start: str) -> list[Frame]:
    """The frames that the roles' turns have between ``before`` and ``after``, of the output that follows ``start``.

    A role that the template refuses there, or whose text it doesn't show exactly once, has none.
    """
    out = []
    for role in roles:
        try:
            probed = template([*before, (role, mark), *after])
        except Exception:  # noqa: BLE001  a template may refuse a role at this place: then the turn hasn't got it
            continue
        if probed.startswith(start) and probed.count(mark) == 1:
            head, tail = probed[len(start) :].split(mark)
            out.append((role, head, tail))
    return out


def _fit(frames: list[Frame], shown: str) -> Frame | None:
    """The longest frame that ``shown`` has at its two ends."""
    fitting = [f for f in frames if len(f[1]) + len(f[2]) <= len(shown) and shown.startswith(f[1]) and shown.endswith(f[2])]
    return max(fitting, key=lambda f: len(f[1]) + len(f[2]), default=None)


def _unused(turns: list[Turn], output: str) -> str:
    """A character that neither the turns nor the output have."""
    used = set(output).union(*(set(role) | set(text) for role, text in turns))
    return next(c for c in map(chr, range(0xE000, 0x110000)) if c not in used)


def render(template: Template, turns: list[Turn]) -> Rendered:
    """Render and locate. ``turns`` hold escaped texts.

    Each prefix is rendered whole, so a template that changes earlier output at any distance is found; the
    work grows with the square of a conversation's turns, as a black box allows no less. Probes are only
    made where the frames seen so far don't give the turn back as it went in.
    """
    whole = template(turns)
    mark, roles = _unused(turns, whole), list(dict.fromkeys(role for role, _ in turns))
    out, known, previous = Rendered(whole), [], template([])
    for i, (role, text) in enumerate(turns):
        longer = template(turns[: i + 1]) if i + 1 < len(turns) else whole
        if not longer.startswith(previous):
            return _render_rewritten(template, turns, whole, roles, mark)
        at, delta = len(previous), longer[len(previous) :]
        frame = _fit(known, delta)
        if frame is None or frame[0] != role or delta != frame[1] + text + frame[2]:
            fresh = _frames(template, turns[:i], [], roles, mark, previous)
            known = list(dict.fromkeys([*known, *fresh]))
            frame = _fit(fresh, delta)
        out.spans.append((at, at + len(delta)))
        if frame is not None:
            out.turns.append(Located(frame[0], at + len(frame[1]), at + len(delta) - len(frame[2])))
        out.alters_content |= frame is None or frame[0] != role or delta != frame[1] + text + frame[2]
        previous = longer
    return out


def _render_rewritten(template: Template, turns: list[Turn], whole: str, roles: list[str], mark: str) -> Rendered:
    """The turns that the whole output shows, each located by probing its place in the whole conversation."""
    out = Rendered(whole, rewrites_history=True)
    for i, (role, text) in enumerate(turns):
        frame = _fit(_frames(template, turns[:i], turns[i + 1 :], roles, mark, ""), whole)
        if frame is not None:
            out.turns.append(Located(frame[0], len(frame[1]), len(whole) - len(frame[2])))
        out.alters_content |= frame is None or frame[0] != role or whole != frame[1] + text + frame[2]
    return out


_TURN = pa.struct([("role", pa.string()), ("text", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("loss", pa.bool_())])
_RESULT = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("turns", pa.list_(_TURN)), ("rewrites_history", pa.bool_()), ("alters_content", pa.bool_())])
RESULT_DDL = (
    "conv_id bigint, formatted string, turns array<struct<role:string,text:string,start:bigint,end:bigint,loss:boolean>>, "
    "rewrites_history boolean, alters_content boolean"
)


def format_conversation(turns: list[Turn], template: Template = chatml, trained: str = "assistant") -> tuple[str, list[dict], bool, bool]:
    """(formatted, turns read back from it with the place of their text and whether it is under the loss mask,
    whether the template rewrites history, whether it alters or hides what went in)."""
    done = render(template, [(escape(role), escape(text)) for role, text in turns])
    back = [{"role": unescape(t.role), "text": unescape(done.output[t.start : t.end]), "start": t.start, "end": t.end} for t in done.turns]
    return done.output, [t | {"loss": t["role"] == trained} for t in back], done.rewrites_history, done.alters_content


def format_chats(rows: DataFrame, template: Template = chatml) -> DataFrame:
    """One row per conversation: conv_id, formatted, turns (read back), rewrites_history, alters_content.

    Rows are dealt by conv_id, sorted by turn (then role and text: ties and repeated rows keep a defined
    order) and streamed; one conversation at a time is held. Null turns come first, null texts and roles
    are empty strings, very long texts are rendered whole, rows with a null conv_id form one conversation.
    Extra columns are ignored; an empty table gives no rows.
    """
    bound_batches(rows.sparkSession, 1024)
    tidy = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = tidy.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, turns, out = None, [], []
        started = False
        for batch in batches:
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                if started and conv != key:
                    out.append((key, *format_conversation(turns, template)))
                    turns = []
                key, started = conv, True
                turns.append((role, text))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t.type) for i, t in enumerate(_RESULT)], schema=_RESULT)
                out = []
        if started:
            out.append((key, *format_conversation(turns, template)))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t.type) for i, t in enumerate(_RESULT)], schema=_RESULT)

    return dealt.mapInArrow(formatted, RESULT_DDL)

