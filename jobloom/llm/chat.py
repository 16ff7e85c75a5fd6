"""Chat formatting: a finite-state machine over roles, a declarative template, per-segment loss flags, and a reader."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


@dataclass(frozen=True)
class Template:
    """Marks of each role before and after its text, whether its text is trained on, and the turn order.

    `turns` is the state machine: state -> role -> next state; it starts in "start". A role without marks gets `other`, which
    spells the role out. Texts hold no unescaped mark: `escape` stands before each escape or first character of a mark.
    """

    marks: dict[str, tuple[str, str]] = field(default_factory=lambda: {"system": ("[SYS] ", " [/SYS]"), "user": ("[INST] ", " [/INST]"), "assistant": ("[ANS] ", " </s>")})
    other: tuple[str, str, str] = ("[ROLE] ", " [SAYS] ", " [/ROLE]")
    loss: tuple[str, ...] = ("assistant",)
    turns: dict[str, dict[str, str]] = field(default_factory=lambda: {"start": {"system": "ready", "user": "asked"}, "ready": {"user": "asked"}, "asked": {"assistant": "answered"}, "answered": {"user": "asked"}})
    ends: tuple[str, ...] = ("answered",)
    escape: str = "\\"

    def controls(self) -> list[str]:
        """Every control string without the spaces around it, longest first."""
        return sorted({x.strip() for pair in [*self.marks.values(), self.other] for x in pair} | {"<s>"}, key=lambda x: (-len(x), x))


class Formatter:
    def __init__(self, template: Template):
        self.t = template
        e = re.escape(template.escape)
        self.special = re.compile(f"{e}|(?:{'|'.join(map(re.escape, template.controls()))})")
        self.unescape_ = re.compile(f"{e}(.)", re.DOTALL)
        marks = {x for pair in template.marks.values() for x in pair} | set(template.other)
        self.scan = re.compile(f"{e}.|(?P<mark>{'|'.join(map(re.escape, sorted(marks, key=lambda x: (-len(x), x))))})", re.DOTALL)
        self.opens = {a: (role, b) for role, (a, b) in template.marks.items()}

    def escape(self, text: str) -> str:
        return self.special.sub(lambda m: self.t.escape + m[0], text)

    def unescape(self, text: str) -> str:
        return self.unescape_.sub(r"\1", text)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """(text, loss flag) parts of one turn; only the body of a trained role is flagged."""
        if role in self.t.marks:
            before, after = self.t.marks[role]
        else:
            before, after = self.t.other[0] + self.escape(role) + self.t.other[1], self.t.other[2]
        return [(before, False), (self.escape(text), role in self.t.loss), (after, False)]

    def read(self, formatted: str) -> list[tuple[str, str]]:
        """(role, text) of each turn of a formatted text: the inverse of joining the segments."""
        out, at, role, closing = [], 0, None, None
        for m in self.scan.finditer(formatted):
            mark = m["mark"]
            if mark is None:
                continue
            if role is None and mark in self.opens:
                (role, closing), at = self.opens[mark], m.end()
            elif role is None and mark == self.t.other[0]:
                role, closing, at = "", self.t.other[1], m.end()
            elif role is not None and mark == closing and closing == self.t.other[1]:
                role, closing, at = self.unescape(formatted[at : m.start()]), self.t.other[2], m.end()
            elif role is not None and mark == closing:
                out.append((role, self.unescape(formatted[at : m.start()])))
                role = closing = None
        return out


SEGMENTS = "conv_id long, turn_no long, segment_no int, text string, loss boolean, state string, valid boolean"


def format_chats(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """(conv_id, turn, role, text) -> segments in order, partitioned by conversation and sorted (conv_id, turn_no, segment_no).

    Each turn gives three segments: mark, escaped text, mark; `loss` is set on the text of the template's trained roles alone.
    `state` is the machine's state after the turn and `valid` says whether the turn order was right so far ("error" is never
    left). Null text and null role count as empty strings; an empty text keeps its (empty) segment. Rows go by turn, null turns
    first; rows of one turn number go by role and text, and repeated rows are turns of their own. A null conv_id is one
    conversation. Extra columns are not looked at. Tasks stream: no conversation is gathered, however many turns it has.
    """
    template = template or Template()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = Formatter(template)
        last, state, no = object(), "start", 0
        for b in batches:
            rows = []
            for conv, role, text in zip(b["conv_id"], b["role"], b["text"], strict=True):
                key = None if pd.isna(conv) else int(conv)
                if key != last:
                    last, state, no = key, "start", 0
                state = template.turns.get(state, {}).get(role, "error")
                rows += [(key, no, i, part, loss, state, state != "error") for i, (part, loss) in enumerate(f.segments(role, text))]
                no += 1
            out = pd.DataFrame(rows, columns=["conv_id", "turn_no", "segment_no", "text", "loss", "state", "valid"])
            yield out.astype({"conv_id": "Int64"})

    # The text is not a sort key for distinct turns; it settles rows of one turn number.
    t = turns.select(F.col("conv_id").cast("long"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return t.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInPandas(run, SEGMENTS)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"


def digest_chats(segments: DataFrame, template: Template | None = None) -> DataFrame:
    """Reads formatted conversations back: one row each with its turns' and its trained text's digests.

    Takes the segments as format_chats leaves them (a conversation's rows together, in order) and keeps running digests, so
    memory does not grow with a conversation. `valid` also asks that the last turn may end a conversation.
    """
    template = template or Template()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = Formatter(template)
        done: list[tuple] = []
        now = None

        def close() -> None:
            if now:
                done.append((now["id"], now["n"], now["turns"].hexdigest(), now["chars"], now["loss"].hexdigest(), now["all"], now["valid"] and now["state"] in template.ends))

        for b in batches:
            rows = zip(b["conv_id"], b["turn_no"], b["text"], b["loss"], b["state"], b["valid"], strict=True)
            for (conv, _), part in groupby(rows, key=lambda r: (None if pd.isna(r[0]) else int(r[0]), r[1])):
                part = list(part)
                if now is None or now["id"] != conv:
                    close()
                    now = {"id": conv, "n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "chars": 0, "all": 0, "valid": True, "state": "", "open": ""}
                text = now["open"] + "".join(r[2] for r in part)
                read = f.read(text)
                now["open"] = "" if read else text  # a turn's segments may lie in two batches
                for role, said in read:
                    now["n"] += 1
                    now["turns"].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                for r in part:
                    now["all"] += len(r[2])
                    if r[3]:
                        trained = f.unescape(r[2])
                        now["chars"] += len(trained)
                        now["loss"].update(trained.encode("utf-8", "surrogatepass"))
                now["valid"], now["state"] = now["valid"] and bool(part[-1][5]), part[-1][4]
            if done:
                yield pd.DataFrame(done, columns=[c.split()[0] for c in DIGEST.split(", ")]).astype({"conv_id": "Int64"})
                done.clear()
        close()
        if done:
            yield pd.DataFrame(done, columns=[c.split()[0] for c in DIGEST.split(", ")]).astype({"conv_id": "Int64"})

    return segments.mapInPandas(run, DIGEST)


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts hold control strings, formatted and read back; null texts are empty, see `format_chats` for the rest."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return digest_chats(format_chats(c.unionByName(extra)))


QUERIES = {"op4_chat": op4_chat}
ORACLE_SQL: dict[str, str] = {}
