r"""Chat formatting in budgeted windows.

A conversation becomes one or more windows of text. Prefix sums of the turns'
tokens choose where a window ends, always between turns: turns whose sums end
in the same stretch of tokens stand together, and a large turn stands alone.
Every window starts with the system turn if there is one, then repeats a little
of what came before, then has its own turns. Loss falls on the assistant turns of a window
that are not repeats, so each is learnt from once.

Each turn reads ``### role:``, a line end, its text and ``</turn>``. Inside
roles and texts a backslash is put before backslashes, ``###`` and ``</turn>``;
taking it away again gives the text back exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.bpe import encoding
from tidemark.llm.common import Scratch

#: Turn numbers that are summed together before the sums are added up, so that
#: a long conversation is summed by many tasks. The result does not depend on it.
TOGETHER = 64
OPEN, CLOSE, AGAIN = "### ", "</turn>\n", " (again)"
_CONTROL = re.compile(r"\\|###|</turn>|:(?=\n)|\(again\)")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"### ((?:[^\\:]|\\.|:(?!\n))*):\n((?:[^\\<]|\\.|<(?!/turn>))*)</turn>\n", re.DOTALL)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_window(parts: list[tuple[str, str, bool]]) -> tuple[str, list[tuple[int, int]]]:
    """Text of turns (role, text, repeated) and the ranges that carry loss."""
    out, mask, at = [], [], 0
    for role, text, repeated in parts:
        head = f"{OPEN}{escape(role)}{AGAIN if repeated else ''}:\n"
        body = escape(text)
        if role == "assistant" and not repeated and body:
            mask.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(out), mask


def parse_window(text: str) -> list[tuple[str, str, bool]]:
    """The turns of a window, the inverse of ``format_window``."""
    out, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        if m is None:
            raise ValueError(f"no turn at character {at}")
        repeated = m[1].endswith(AGAIN)
        out.append((unescape(m[1].removesuffix(AGAIN) if repeated else m[1]), unescape(m[2]), repeated))
        at = m.end()
    return out


def token_counter(ranks_path: str, pattern: str) -> Callable[[Column, Column], Column]:
    """Tokens of a turn with its marks, by a tokenizer's ranks; never fewer than
    it takes in a window, also where it is marked as repeated.

    A turn ends in a line end and the next begins with a mark, which is a border
    of pre-tokens, so the counts of turns add up to that of a window.
    """

    @F.pandas_udf("long")
    def count(roles: pd.Series, texts: pd.Series) -> pd.Series:
        encode = encoding(ranks_path, pattern).encode_ordinary
        return pd.Series([len(encode(f"{OPEN}{escape(r)}{AGAIN}:\n{escape(t)}{CLOSE}")) for r, t in zip(roles, texts)])

    return count


_MASK = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))


def placed_turns(rows: DataFrame, budget: int, history: int, tokens: Callable[[Column, Column], Column]) -> DataFrame:
    """Every turn with its position in its conversation and the window it is in.

    A window is known by ``w``: the stretch of tokens in which the prefix sum
    of a turn ends, and how many large turns there are up to it. Sums run
    within parts of a conversation first, then over the parts.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    r = rows.select(F.struct("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), tokens(role, text).cast("long").alias("tokens"))
    cut = budget // 4
    large = (F.col("tokens") > cut).cast("int")
    r = r.withColumn("part", F.coalesce(F.floor(F.col("turn") / TOGETHER), F.lit(-1)).cast("long"))
    inside = Window.partitionBy("conv", "part").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    r = r.select("conv", "part", "role", "text", "tokens", large.alias("large"), F.count("*").over(inside).alias("n"), F.sum("tokens").over(inside).alias("sum"), F.sum(large).over(inside).alias("larges"))
    at = F.struct("n", F.when(F.col("role") == "system", F.col("tokens")).alias("system"))
    parts = r.groupBy("conv", "part").agg(F.max("n").alias("n"), F.max("sum").alias("sum"), F.max("larges").alias("larges"), F.min(at)["system"].alias("system"))
    order = Window.partitionBy("conv").orderBy("part")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        "conv",
        "part",
        *(F.coalesce(F.sum(x).over(before), F.lit(0)).alias(f"{x}_before") for x in ("n", "sum", "larges")),
        F.first("system").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("system"),
        F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("turns"),
    )
    t = r.join(offsets, ["conv", "part"])
    step = F.greatest(budget - history - cut - F.coalesce("system", F.lit(0)), F.lit(1))
    w = F.struct(F.floor((F.col("sum") + F.col("sum_before") - F.coalesce("system", F.lit(0)) - 1) / step).alias("stretch"), (F.col("larges") + F.col("larges_before")).alias("larges"), "large")
    pos = F.col("n") + F.col("n_before")
    # The system turn joins the first window as its context, unless it is all there is.
    head = (pos == 1) & F.col("system").isNotNull() & (F.col("turns") > 1)
    return t.select("conv", pos.alias("pos"), "role", "text", "tokens", w.alias("w"), F.col("system").isNotNull().alias("has_system"), head.alias("head"))


def format_conversations(rows: DataFrame, tokens: Callable[[Column, Column], Column], budget: int = 1024, history: int = 256, history_turns: int = 2) -> DataFrame:
    """(conv_id, window, text, mask): the windows of every conversation.

    ``tokens`` counts those of a turn from its role and text. ``window`` is the position of its first own turn. Rows have conv_id, turn,
    role and text; others are not read. Turns stand by turn number, then role,
    then text; repeated rows are turns of their own. Null texts and roles are
    empty; null turn numbers come first; rows with a null conv_id form one
    conversation; an empty table has no window. The system turn and the history
    take from the budget. A turn of over a quarter of the budget has a window of
    its own, so does one that alone exceeds it; very long texts stay whole.
    """
    scratch = Scratch(rows.sparkSession)
    turns = scratch.table(placed_turns(rows, budget, history, tokens), "turns")
    one = F.struct("pos", "role", "text", "tokens")
    own = turns.where("not head").groupBy("conv", "w").agg(F.sort_array(F.collect_list(one)).alias("own"), F.min("pos").alias("window"), F.first("has_system").alias("has_system"))
    own = scratch.table(own.drop("w"), "windows")
    first = F.when(F.col("has_system") & (F.col("window") > 1), F.array(F.lit(1).cast("long"))).otherwise(F.array().cast("array<long>"))
    back = F.filter(F.transform(F.sequence(F.lit(1), F.lit(max(history_turns, 1))), lambda k: F.col("window") - k), lambda p: p >= 1)
    wanted = own.select("conv", "window", F.explode(F.array_union(first, back) if history_turns else first).alias("pos"))
    context = wanted.join(turns.select("conv", "pos", "role", "text", "tokens"), ["conv", "pos"]).groupBy("conv", "window").agg(F.collect_list(one).alias("context"))
    joined = own.join(context, ["conv", "window"], "left").select("conv.conv_id", "window", "own", "context", "has_system")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, masks = [], []
            for window, mine, context, has_system in zip(*(c.to_pylist() for c in batch.columns[1:])):
                system, shown, used = None, [], 0
                for t in sorted(context or [], key=lambda t: -t["pos"]):
                    if has_system and t["pos"] == 1:
                        system = t
                    elif t["pos"] == window - 1 - len(shown) and used + t["tokens"] <= history:
                        shown.append(t)
                        used += t["tokens"]
                parts = [(system["role"], system["text"], window > 2)] if system else []
                parts += [(t["role"], t["text"], True) for t in reversed(shown)]
                text, mask = format_window(parts + [(t["role"], t["text"], False) for t in mine])
                texts.append(text)
                masks.append([{"start": s, "stop": e} for s, e in mask])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(masks, _MASK)], ["conv_id", "window", "text", "mask"])

    kind = rows.schema["conv_id"].dataType.simpleString()
    return scratch.last(joined.mapInArrow(run, f"conv_id {kind}, window long, text string, mask array<struct<start:int,stop:int>>"), "formatted")


class _Digest:
    """Running digests of one conversation, fed with its windows in order."""

    def __init__(self, conv_id: pa.Scalar) -> None:
        self.conv_id, self.turns, self.loss = conv_id, hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0

    def add(self, text: str, mask: list[dict]) -> None:
        for role, turn, repeated in parse_window(text):
            if not repeated:
                self.turns.update(f"{role}\n{turn}\n".encode())
                self.n_turns += 1
        for m in mask:
            part = unescape(text[m["start"] : m["stop"]])
            self.loss.update(part.encode())
            self.loss_chars += len(part)
        self.chars += len(text)


def read_back(windows: DataFrame) -> DataFrame:
    """The contract's columns, from the formatted windows alone.

    The digests run over whole conversations, whose windows pass through one
    task in order; nothing but the running digests is held.
    """

    def give(done: list[_Digest], kind: pa.DataType) -> pa.RecordBatch:
        columns = [pa.array([d.conv_id.as_py() for d in done], kind), *(pa.array([f(d) for d in done]) for f in (lambda d: d.n_turns, lambda d: d.turns.hexdigest(), lambda d: d.loss_chars, lambda d: d.loss.hexdigest(), lambda d: d.chars))]
        return pa.RecordBatch.from_arrays(columns, ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kind = None, None
        for batch in batches:
            done, kind = [], batch.column(0).type
            for conv, text, mask in zip(batch.column(0), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if now is None or not conv.equals(now.conv_id):
                    if now is not None:
                        done.append(now)
                    now = _Digest(conv)
                now.add(text, mask)
            if done:
                yield give(done, kind)
        if now is not None:
            yield give([now], kind)

    kind = windows.schema["conv_id"].dataType.simpleString()
    ordered = windows.select("conv_id", "window", "text", "mask").repartition("conv_id").sortWithinPartitions("conv_id", "window")
    return ordered.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def digest(turns: list[tuple[str, str]]) -> tuple[str, int, str]:
    """turns_sha256, loss_chars and loss_sha256 of a conversation, for tests."""
    loss = "".join(t for r, t in turns if r == "assistant")
    return hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()
