"""Chat formatting: conversations rendered through compiled templates, with a loss mask, and read back."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.template import compile_template
from folioflow.session import parts

#: Marks each turn; only what an assistant says is under the loss mask.
TEMPLATE = (
    "{% for m in messages %}### {{ m.role | head }}: "
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | body }}{% endgeneration %}{% else %}{{ m.text | body }}{% endif %}"
    "</turn>\n{% endfor %}"
)

_BODY = re.compile(r"\\|###|</turn>")
_HEAD = re.compile(r"\\|###|</turn>|:")
_TURN = re.compile(r"### ((?:[^\\:]++|\\.)*+): ((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.S)


def escape_body(text: str | None) -> str:
    """Text with a backslash before every backslash and every control string; ``unescape`` undoes it."""
    return _BODY.sub(lambda m: "\\" + m[0], text or "")


def escape_head(role: str | None) -> str:
    """As ``escape_body``, for what stands before the colon."""
    return _HEAD.sub(lambda m: "\\" + m[0], role or "")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


FILTERS = {"body": escape_body, "head": escape_head}


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn begins at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def _format(template: str, kinds: list[str]):
    def run(batches):
        render = compile_template(template, FILTERS)
        now, messages, done, kind = None, [], [], None

        def finish():
            text, spans = render({"messages": messages})
            done.append((now[0], text, [{"b": b, "e": e} for b, e in spans]))

        def flush():
            ids, texts, spans = zip(*done, strict=True)
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(texts, pa.string()), pa.array(spans, pa.list_(pa.struct([("b", pa.int64()), ("e", pa.int64())])))], kinds)

        size = 0
        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if now is None or conv != now[0]:
                    if now is not None:
                        finish()
                    if size > 4 << 20:
                        yield flush()
                        size = 0
                    now, messages = (conv,), []
                messages.append({"role": role or "", "text": text or ""})
                size += len(text or "")
        if now is not None:
            finish()
        if done:
            yield flush()

    return run


def format_conversations(turns: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """One row for each conversation of ``turns`` (conv_id, turn, role, text): conv_id, formatted and loss (spans of code points).

    Turns are in order of turn, ties in order of role and text; a turn that is null comes first. Null roles and texts are empty. Rows whose
    conv_id, of any type, is null form one conversation. Repeated rows are turns of their own. An empty table gives no rows. Other
    columns are ignored, whatever their names. A conversation, the result row, is what a task holds at a time.
    """
    rows = turns.select("conv_id", "turn", "role", "text").repartition(parts(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.mapInArrow(_format(template, ["conv_id", "formatted", "loss"]), f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, formatted string, loss array<struct<b long, e long>>")


def _digest(batches):
    sha = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()
    for batch in batches:
        rows = []
        for conv, text, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss")), strict=True):
            turns = read_back(text)
            said = "".join(unescape(text[x["b"] : x["e"]]) for x in loss)
            rows.append((conv, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(said), sha(said), len(text)))
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [batch.schema.field("conv_id").type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        columns = list(zip(*rows, strict=True)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def digests(formatted: DataFrame) -> DataFrame:
    """What formatted conversations say when read back: turns and loss text as digests, and lengths in code points."""
    return formatted.mapInArrow(_digest, f"conv_id {formatted.schema['conv_id'].dataType.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
