"""Chat formatting by quotation linking.

A message's lines are parsed into quote levels (the number of leading ``>``
marks, blanks between them allowed).  Neighbouring lines of one level form a passage, which
blank lines end.  Each passage and each of its lines is normalised (lower
case, white space as one blank) and hashed with 128 bits.  Unquoted passages and lines of all messages are
hashed the same way, and quotes are joined to the message of the conversation that wrote them first.

The parent of a message is the original of its outermost linked quotes: the message
that most of those passages (then lines: re-wrapped or cut quotes still match by line) come
from, the latest one on ties, always an earlier turn.  Conversations are
rebuilt from parents: root and depth by pointer doubling, rows sorted by
(conversation, root, turn), so every reply follows what it answers.  The reply text
has no quotes and no attribution line (``... wrote:``) before a quote.  A
message without a linked quote starts its own thread, which in a chat without
quotes leaves the turns in their order.

All steps are joins and aggregates on (conversation, hash).  Copies of a line
collapse to one row per conversation before the join, and no conversation is
ever collected.

Edge cases: null texts are empty messages; null conversations or turns stay as
rows without links; repeated rows all keep their row; a quote of nothing known
is removed but links nothing; very long messages are parsed whole, in linear
time; an empty table gives an empty result; other columns pass through, those named like a result
column are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import packed

MARK = re.compile(r"[ \t]*((?:>[ \t]?)+)")
WROTE = re.compile(r"\bwrote:\s*$", re.I)
PARSED = "reply string, n_quoted int, units array<struct<level:int, passage:boolean, hash:binary>>"


def split_levels(text: str) -> list[tuple[int, str]]:
    """(quote level, line without marks) of every line."""
    out = []
    for line in text.split("\n"):
        m = MARK.match(line)
        out.append((m[1].count(">"), line[m.end():].rstrip("\r")) if m else (0, line.rstrip("\r")))
    return out


def normalise(line: str) -> str:
    return " ".join(line.lower().split())


def digest(text: str) -> bytes:
    return xxhash.xxh3_128_digest(text.encode())


def parse_message(text: str | None) -> tuple[str, int, list[dict]]:
    """Reply text, number of quoted lines, hashed units (each level, passage or line once)."""
    lines = split_levels(text or "")
    own, units, passage, level = [], set(), [], -1

    def close():
        if passage:
            units.add((level, True, digest(" ".join(passage))))
            passage.clear()

    for i, (at, line) in enumerate(lines):
        flat = normalise(line)
        if at != level or not flat:
            close()
        level = at
        if flat:
            passage.append(flat)
            units.add((at, False, digest(flat)))
        if at == 0 and not (WROTE.search(line) and i + 1 < len(lines) and lines[i + 1][0]):
            own.append(line)
    close()
    reply = re.sub(r"\n{3,}", "\n\n", "\n".join(own)).strip()
    return reply, sum(at > 0 for at, _ in lines), [{"level": a, "passage": p, "hash": h} for a, p, h in sorted(units)]


def with_parsed(df: DataFrame, text_col: str) -> DataFrame:
    @F.pandas_udf(PARSED)
    def parsed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [parse_message(t) for t in batch]
            yield pd.DataFrame({k: [r[j] for r in rows] for j, k in enumerate(("reply", "n_quoted", "units"))})

    return df.withColumn("_p", parsed(F.col(text_col)))


def quote_links(units: DataFrame) -> DataFrame:
    """(conv, turn, parent, n_linked) of messages with a linked quote; units: (conv, turn, level, passage, hash)."""
    # Both sides of the join are written tables, so a passage that a whole conversation quotes is split over tasks.
    first = units.filter("level = 0").groupBy("conv", "passage", "hash").agg(F.min("turn").alias("origin"))
    first = materialize(first, "quote_origins")
    quoted = materialize(units.filter("level > 0").distinct(), "quoted")
    found = quoted.join(first, ["conv", "passage", "hash"]).filter("origin < turn")
    votes = found.groupBy("conv", "turn", "level", "origin").agg(
        F.count_if("passage").alias("passages"), F.count_if(~F.col("passage")).alias("lines"))
    best = votes.groupBy("conv", "turn").agg(
        F.max(F.struct((-F.col("level")).alias("outer"), "passages", "lines", "origin")).alias("best"),
        F.sum("lines").alias("n_linked"))
    return best.select("conv", "turn", F.col("best.origin").alias("parent"), "n_linked")


def thread_roots(links: DataFrame) -> DataFrame:
    """(conv, turn, parent, n_linked, root, depth): pointer doubling up the reply links."""
    state = materialize(links.withColumns({"root": F.col("parent"), "depth": F.lit(1).cast("long")}), "quote_links")
    while True:
        up = state.select(F.col("conv").alias("_c"), F.col("turn").alias("_t"), F.col("root").alias("_r"), F.col("depth").alias("_d"))
        on = (F.col("conv") == F.col("_c")) & (F.col("root") == F.col("_t"))
        if state.join(up, on, "left_semi").isEmpty():
            return state
        state = materialize(state.join(up, on, "left").select(
            "conv", "turn", "parent", "n_linked", F.coalesce("_r", "root").alias("root"),
            (F.col("depth") + F.coalesce("_d", F.lit(0))).alias("depth")), "quote_roots")


def format_conversations(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text",
                         role_col: str = "role") -> DataFrame:
    """``df`` in reply order with ``parent_turn``, ``root_turn``, ``depth``, ``n_quoted``, ``n_linked`` (linked quoted
    lines), ``reply`` and ``formatted`` (role header and reply)."""
    df = df.drop("parent_turn", "root_turn", "depth", "n_quoted", "n_linked", "reply", "formatted")
    rows = df.select(packed(df), F.col(conv_col).alias("_conv"), F.col(turn_col).alias("_turn"), F.col(text_col).alias("_text"),
                     F.coalesce(F.col(role_col).cast("string"), F.lit("unknown")).alias("_role"))
    parsed = with_parsed(rows, "_text")
    units = (parsed.filter(F.col("_conv").isNotNull() & F.col("_turn").isNotNull())
             .select(F.col("_conv").alias("conv"), F.col("_turn").alias("turn"), F.inline("_p.units")))
    links = thread_roots(quote_links(materialize(units, "quote_units")))
    joined = parsed.join(links, (F.col("_conv") == F.col("conv")) & (F.col("_turn") == F.col("turn")), "left")
    root = F.coalesce("root", "_turn")
    out = joined.orderBy("_conv", root, "_turn")
    return out.select("_in.*", F.col("parent").alias("parent_turn"), root.alias("root_turn"),
                      F.coalesce("depth", F.lit(0)).alias("depth"), F.col("_p.n_quoted").alias("n_quoted"),
                      F.coalesce("n_linked", F.lit(0)).alias("n_linked"), F.col("_p.reply").alias("reply"),
                      F.concat(F.lit("<|"), F.col("_role"), F.lit("|>\n"), F.col("_p.reply")).alias("formatted"))
