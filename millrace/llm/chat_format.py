"""Chat formatting with a grammar round trip (operator 7).

    conversation := turn*
    turn         := "### " role ":" NEWLINE text "</turn>" NEWLINE

A role or text is written as it is if the parser gives it back; otherwise with a
backslash before each control string in it ("### ", "</turn>", "\\", and in roles
":"). The parser takes a backslash before a control string away and leaves any
other backslash alone. Rendered text is always parsed again and held against the
source.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAD, TAIL, ROLE_END = "### ", "</turn>\n", ":\n"
_CONTROL = re.compile(r"\\|### |</turn>")
_ROLE_CONTROL = re.compile(r"\\|### |</turn>|:")
_TOKEN = re.compile(r"\\(\\|### |</turn>)|(### |</turn>)")
_ROLE_TOKEN = re.compile(r"\\(\\|### |</turn>|:)|(### |</turn>|:)")
Turn = tuple[str, str]


class GrammarError(ValueError):
    """Text that is not a conversation of this grammar."""


def _field(text: str, at: int, token: re.Pattern, stop: str) -> tuple[str, int, int]:
    """A field's unescaped content, where it ends, and where the text after its stop begins."""
    out = []
    for m in token.finditer(text, at):
        out.append(text[at : m.start()])
        at = m.end()
        if m[1] is not None:
            out.append(m[1])
        elif text.startswith(stop, m.start()):
            return "".join(out), m.start(), m.start() + len(stop)
        else:
            raise GrammarError(f"control string at {m.start()}")
    raise GrammarError("field without an end")


def parse(text: str) -> tuple[list[Turn], list[tuple[int, int]]]:
    """Turns of a formatted conversation, and where each turn's text lies in it."""
    turns, spans, at = [], [], 0
    while at < len(text):
        if not text.startswith(HEAD, at):
            raise GrammarError(f"no turn at {at}")
        role, _, begin = _field(text, at + len(HEAD), _ROLE_TOKEN, ROLE_END)
        content, end, at = _field(text, begin, _TOKEN, TAIL)
        turns.append((role, content))
        spans.append((begin, end))
    return turns, spans


def _reads_back(role: str, text: str, turn: Turn) -> bool:
    try:
        return parse(f"{HEAD}{role}{ROLE_END}{text}{TAIL}")[0] == [turn]
    except GrammarError:
        return False


def render(turns: list[Turn]) -> str:
    """Format turns; a field that wouldn't be read back is escaped, and then must be."""
    out = []
    for turn in turns:
        role, text = turn
        if not _reads_back(role, "", (role, "")):
            role = _ROLE_CONTROL.sub(lambda m: "\\" + m[0], role)
        if not _reads_back("", text, ("", text)):
            text = _CONTROL.sub(lambda m: "\\" + m[0], text)
        if not _reads_back(role, text, turn):
            raise GrammarError("escaping failed")
        out.append(f"{HEAD}{role}{ROLE_END}{text}{TAIL}")
    return "".join(out)


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def format_conversations(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """One formatted text a conversation, with the spans that training loss covers.

    ``turns`` needs conv_id, turn, role and text; other columns are ignored. Returns
    conv_id, formatted, loss_mask (start and end in code points of each
    ``trained_role`` text in formatted, escapes included). Turns stand in the order of turn,
    then role, then text; null turns first. Null roles and texts are empty.
    Repeated rows are turns of their own. A null conv_id is a conversation. An
    empty table gives an empty result.
    """
    grouped = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    grouped = grouped.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))

    def write(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts, masks = [], []
                for conversation in part.column("t").to_pylist():
                    source = [(x["role"], x["text"]) for x in conversation]
                    texts.append(render(source))
                    back, spans = parse(texts[-1])
                    if back != source:
                        raise GrammarError("a conversation was not read back as it was")
                    masks.append([{"start": a, "end": b} for (role, _), (a, b) in zip(back, spans, strict=True) if role == trained_role])
                yield pa.RecordBatch.from_arrays([part.column("conv_id"), pa.array(texts, pa.string()), pa.array(masks, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], ["conv_id", "formatted", "loss_mask"])

    return grouped.mapInArrow(write, "conv_id long, formatted string, loss_mask array<struct<start:long,end:long>>")


def unescape(text: str) -> str:
    """A masked stretch's text as it was."""
    return _TOKEN.sub(lambda m: m[1] if m[1] is not None else m[0], text)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of conversations as the parser and the loss mask give them back.

    Takes what ``format_conversations`` returns. Returns conv_id, n_turns,
    turns_sha256 (hex, of role, newline, text, newline per turn), loss_chars,
    loss_sha256 (code points and hex digest of the unescaped text under the mask)
    and formatted_chars.
    """

    def read(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                out = []
                for text, mask in zip(part.column("formatted").to_pylist(), part.column("loss_mask").to_pylist(), strict=True):
                    turns, _ = parse(text)
                    loss = "".join(unescape(text[m["start"] : m["end"]]) for m in mask)
                    out.append((len(turns), _sha256("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), _sha256(loss), len(text)))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("conv_id"), *[pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)]], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
