"""Repair of conversation structure by grammar-compressed dynamic programming.

A conversation should read ``(s?(ua)+)?`` in role initials.  Allowed edits: Keep
a row (0), Rerole it to user or assistant (2), Delete it (3; required for blank
and repeated rows), Insert an empty row of user or assistant (2); a truncated
row that stays costs 1 more.  The cheapest edits are wanted, ties by the least
string of edit letters.

Every row becomes a symbol of its role and its fault (16 of them).  A symbol is a
min-plus transfer matrix over the four states of the pattern (nothing yet,
after s, after u, after a); an entry holds the least cost and, as a rope, the
edit letters that give it.  Equal costs over the same rows never have one
string as the start of the other (the rest would be inserts, which cost), so
the least string of a whole is made of least strings of its parts.

1. Rows are range-partitioned by conversation and turn and cut into segments of at most
   ``SEGMENT`` rows, so a conversation of any size is spread over tasks.
2. Re-Pair: frequent neighbouring symbols of all distinct segments (weighted by how often
   they occur) become rules, some per round, until none occurs twice or ``rules`` are found.
3. Each rule's matrix is the product of its two parts, computed once, bottom up, and
   shipped with the task.  Each distinct segment is rewritten by the rules and multiplied out
   once, however many conversations share it.
4. Conversations fold the matrices of their segments in order, rows of a few hundred
   bytes.  The letters found go back to the segments, whose texts are rebuilt side by side.
5. SHA-256 has to read a text in order: conversations of one segment are hashed where they are,
   longer ones as a stream of their rebuilt segments (one task per conversation,
   one segment in memory).

Edge cases: null texts, roles and keys count as one space (a null turn sorts
first, a null conversation is a conversation of its own); equal turns are ordered by role, then
by a digest of role and text, copies next to each other; roles with another initial can
only be reroled or deleted; an empty role has no initial; conversations
without rows after damage have zeros, an empty audit and the hash of the empty string; an empty
table gives an empty result; other columns are ignored whatever their names.
"""

from __future__ import annotations

import hashlib
from itertools import zip_longest

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import materialize

SEGMENT, SEGMENT_CHARS = 256, 1 << 20
STATES, START, FINAL = range(4), 0, (0, 3)
SPACES = " \t\n\x0b\f\r"
ROLES, FINE, CUT, BLANK, TWICE = "sua", 0, 1, 2, 3
RULE_BASE = 0xE000  # private code points for rules

# ---------------------------------------------------------------------------
# Ropes and transfer matrices: a matrix is a list of 16 entries, None or (cost, rope)
# ---------------------------------------------------------------------------


def leaves(rope):
    todo = [rope]
    while todo:
        r = todo.pop()
        if isinstance(r, str):
            yield r
        else:
            todo += (r[1], r[0])


def flat(rope) -> str:
    return rope if isinstance(rope, str) else "".join(leaves(rope))


def before(a, b) -> bool:
    """Is rope ``a`` the lesser string?"""
    if a is b:
        return False
    chars = lambda rope: (c for leaf in leaves(rope) for c in leaf)
    for x, y in zip_longest(chars(a), chars(b), fillvalue=""):
        if x != y:
            return x < y
    return False


def better(new, old):
    return old is None or new[0] < old[0] or new[0] == old[0] and before(new[1], old[1])


def product(a: list, b: list) -> list:
    out = [None] * 16
    for i in STATES:
        for j in STATES:
            left = a[4 * i + j]
            if left is None:
                continue
            for k in STATES:
                right = b[4 * j + k]
                if right is None:
                    continue
                cost, old = left[0] + right[0], out[4 * i + k]
                if old is not None and cost > old[0]:
                    continue
                new = (cost, (left[1], right[1]) if left[1] and right[1] else left[1] or right[1])
                if better(new, old):
                    out[4 * i + k] = new
    return out


def matrix(steps) -> list:
    out = [None] * 16
    for i, k, cost, letters in steps:
        if better((cost, letters), out[4 * i + k]):
            out[4 * i + k] = (cost, letters)
    return out


#: Any inserts: user after nothing, s or a; assistant after u.
INSERTS = matrix([(i, i, 0, "") for i in STATES] + [(i, 2, 2, "I") for i in (0, 1, 3)] + [(2, 3, 2, "I")]
                 + [(i, 3, 4, "II") for i in (0, 1)])


def row_matrix(role: int, fault: int) -> list:
    """Inserts before a row, then one edit of it; ``role``: place in ``ROLES``, 3 for any other."""
    steps = [(i, i, 3, "D") for i in STATES]
    if fault in (FINE, CUT):
        keeps = {0: [(0, 1)], 1: [(0, 2), (1, 2), (3, 2)], 2: [(2, 3)]}.get(role, [])
        steps += [(i, k, fault, "K") for i, k in keeps]
        steps += [(i, k, 2 + fault, "R") for i, k in ((0, 2), (1, 2), (3, 2), (2, 3))]
    return product(INSERTS, matrix(steps))


def symbol(role: int, fault: int) -> str:
    return chr(ord("A") + 4 * role + fault)


def symbol_of(s: str) -> tuple[int, int]:
    return divmod(ord(s) - ord("A"), 4)


BASE = {symbol(r, f): row_matrix(r, f) for r in range(4) for f in range(4)}


def rule_matrices(rules: list[tuple[str, str, str]]) -> dict[str, list]:
    """Matrix of every symbol and rule (new, left, right); a rule's parts come before it."""
    known = dict(BASE)
    for new, left, right in rules:
        known[new] = product(known[left], known[right])
    return {s: [e and (e[0], flat(e[1])) for e in m] for s, m in known.items()}


def compress(segment: str, rules: list[tuple[str, str, str]]) -> str:
    for new, left, right in rules:
        segment = segment.replace(left + right, new)
    return segment


# ---------------------------------------------------------------------------
# Steps
# ---------------------------------------------------------------------------

def damage(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """Rows (``_conv``, ``_turn``, ``_role``, ``_text``, ``_copy``) after the contract's damage."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said(conv_col), F.lit(":"), said(turn_col)).cast("binary")) % 20
    rows = df.select(F.col(conv_col).alias("_conv"), F.col(turn_col).cast("long").alias("_turn"), said("role").alias("_role"),
                     said("text").alias("_text"), kind.alias("_kind")).filter("_kind <> 0")
    return rows.select("_conv", "_turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("_role")).alias("_role"),
                       F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("_text", ".!?", ""))
                        .otherwise(F.col("_text")).alias("_text"),
                       F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"))


def symbols(rows: DataFrame) -> DataFrame:
    """``rows`` with ``_sym``, the symbol of role and first fault, and ``_digest``, ``_u`` for their order."""
    kept = materialize(rows.withColumns({
        "_digest": F.unhex(F.sha2(F.concat(F.octet_length("_role").cast("string"), F.lit(":"), "_role", "_text"), 256)),
        "_u": F.xxhash64(F.monotonically_increasing_id())}), "damaged")
    place = F.struct(F.col("_turn").isNotNull().alias("t"), F.coalesce("_turn", F.lit(0)).alias("turn"), "_copy", "_u")
    # First of equal rows, by aggregation: no task holds all copies of a row.
    first = (kept.groupBy("_conv", "_digest").agg(F.count(F.lit(1)).alias("_n"), F.min(place).alias("_first")).filter("_n > 1")
                 .select(F.col("_conv").alias("_c"), F.col("_digest").alias("_d"), "_first"))
    joined = kept.join(first, kept["_conv"].eqNullSafe(first["_c"]) & (kept["_digest"] == first["_d"]), "left")
    trimmed = F.rtrim("_text", F.lit(SPACES))
    last = F.substring(trimmed, -1, 1)
    fault = (F.when(trimmed == "", BLANK).when(F.col("_first").isNotNull() & (place != F.col("_first")), TWICE)
              .when(last.isin(".", "!", "?"), FINE).otherwise(CUT))
    role: Column = F.lit(len(ROLES))
    for k, initial in enumerate(ROLES):
        role = F.when(F.substring("_role", 1, 1) == initial, k).otherwise(role)
    return joined.withColumn("_sym", F.char(F.lit(ord("A")) + 4 * role + fault)).drop("_c", "_d", "_first")


def segments(rows: DataFrame, conv_type) -> DataFrame:
    """Segments in order (``part``, ``k``): symbols, roles, texts and what the turns show."""
    spark = rows.sparkSession
    order = [F.col("_conv").asc_nulls_first(), F.col("_turn").asc_nulls_first(), F.col("_role"), F.col("_digest"), F.col("_copy"), F.col("_u")]
    placed = (rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
                  .select("_conv", "_turn", "_role", "_text", "_sym"))
    schema = pa.schema([("conv", to_arrow_type(conv_type)), ("part", pa.int32()), ("k", pa.int64()), ("sym", pa.string()),
                        ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("first", pa.int64()), ("last", pa.int64()),
                        ("turns", pa.int64())])

    def cut(batches):
        part, k, conv, held, chars, out, size = TaskContext.get().partitionId(), 0, None, [], 0, [], 0

        def close():
            nonlocal k, held, chars
            turns = [t for t, _, _, _ in held if t is not None]
            out.append({"conv": conv, "part": part, "k": k, "sym": "".join(h[3] for h in held), "roles": [h[1] for h in held],
                        "texts": [h[2] for h in held], "first": turns[0] if turns else None, "last": turns[-1] if turns else None,
                        "turns": len(set(turns))})
            k, held, chars = k + 1, [], 0

        for batch in batches:
            for c, turn, role, text, sym in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if held and (c != conv or len(held) == SEGMENT or chars > SEGMENT_CHARS):
                    size += chars
                    close()
                    if size > SEGMENT_CHARS or len(out) >= 4096:
                        yield pa.RecordBatch.from_pylist(out, schema=schema)
                        out, size = [], 0
                conv = c
                held.append((turn, role, text, sym))
                chars += len(text)
        if held:
            close()
        yield pa.RecordBatch.from_pylist(out, schema=schema)

    return placed.mapInArrow(cut, f"conv {conv_type.simpleString()}, part int, k long, sym string, roles array<string>, "
                                  "texts array<string>, first long, last long, turns long")


def learn_rules(distinct: DataFrame, rules: int = 160, per_round: int = 32) -> list[tuple[str, str, str]]:
    """Re-Pair rules from (``sym``, ``n``): the most frequent neighbours of each round that do not overlap.

    The driver gets at most ``4 * per_round`` pairs a round and holds ``rules`` rules.
    """
    found: list[tuple[str, str, str]] = []
    current = distinct.select("sym", "n")
    while len(found) < rules:
        chars = F.regexp_extract_all("sym", F.lit("(?s)."), 0)
        pairs = (current.filter(F.char_length("sym") > 1).select("n", chars.alias("c"))
                 .select("n", F.explode(F.zip_with(F.expr("slice(c, 1, size(c) - 1)"), F.expr("slice(c, 2, size(c) - 1)"), lambda a, b: F.concat(a, b))).alias("p"))
                 .groupBy("p").agg(F.sum("n").alias("n")).filter("n > 1").orderBy(F.desc("n"), "p").limit(4 * per_round).collect())
        lefts, rights, fresh = set(), set(), []
        for r in pairs:
            a, b = r["p"]
            if a not in rights and b not in lefts and len(fresh) < min(per_round, rules - len(found)):
                lefts.add(a)
                rights.add(b)
                fresh.append((chr(RULE_BASE + len(found) + len(fresh)), a, b))
        if not fresh:
            break
        for new, a, b in fresh:
            current = current.withColumn("sym", F.replace("sym", F.lit(a + b), F.lit(new)))
        found += fresh
    return found


def segment_matrices(distinct: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(``sym``, ``costs``: 16 numbers, -1 for none, ``edits``: 16 strings) of each distinct segment."""

    def run(batches):
        known = rule_matrices(rules)
        for batch in batches:
            sym, costs, edits = batch.column(0).to_pylist(), [], []
            for s in sym:
                total = None
                for part in compress(s, rules):
                    total = known[part] if total is None else product(total, known[part])
                costs.append([-1 if e is None else e[0] for e in total])
                edits.append([None if e is None else flat(e[1]) for e in total])
            yield pa.RecordBatch.from_arrays([pa.array(sym, pa.string()), pa.array(costs, pa.list_(pa.int32())),
                                              pa.array(edits, pa.list_(pa.string()))], ["sym", "costs", "edits"])

    return distinct.select("sym").mapInArrow(run, "sym string, costs array<int>, edits array<string>")


class Fold:
    """Best edits of one conversation, segment by segment; a path is a chain (chain before, state before, letters)."""

    def __init__(self):
        self.best, self.keys, self.syms, self.low, self.high, self.turns, self.last = [(0, None), None, None, None], [], [], None, None, 0, None

    def add(self, key, sym, costs, edits, first, last, turns):
        new = [None] * 4
        for j in STATES:
            for i in STATES:
                c = costs[4 * i + j]
                if self.best[i] is None or c < 0:
                    continue
                cost, path = self.best[i][0] + c, (self.best[i][1], i, edits[4 * i + j])
                if new[j] is None or cost < new[j][0] or cost == new[j][0] and self._before(path, new[j][1]):
                    new[j] = (cost, path)
        self.best = new
        self.keys.append(key)
        self.syms.append(sym)
        if first is not None:
            self.low = first if self.low is None else min(self.low, first)
            self.high = last if self.high is None else max(self.high, last)
            self.turns += turns - (self.last == first)
            self.last = last

    @staticmethod
    def _before(a, b) -> bool:
        """Compare two paths of equal length from where they part."""
        x, y = [], []
        while a is not b:
            x.append(a[2])
            y.append(b[2])
            a, b = a[0], b[0]
        return "".join(reversed(x)) < "".join(reversed(y))

    def result(self):
        """(totals, [(key, state before, letters)])."""
        best = None
        for i in STATES:
            for k in FINAL:
                end = INSERTS[4 * i + k]
                if self.best[i] is None or end is None:
                    continue
                cost, chain = self.best[i][0] + end[0], self.best[i][1]
                path = (chain[0], chain[1], chain[2] + end[1])
                if best is None or cost < best[0] or cost == best[0] and self._before(path, best[1]):
                    best = (cost, path)
        cost, path = best
        slices = []
        while path is not None:
            slices.append((path[1], path[2]))
            path = path[0]
        slices.reverse()
        faults, illegal, before_ = [0] * 4, 0, None
        for sym in self.syms:
            for s in sym:
                role, fault = symbol_of(s)
                faults[fault] += 1
                illegal += before_ is not None and (before_, role) not in ((0, 1), (1, 2), (2, 1))
                before_ = role
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        totals = {"gaps": gaps, "blank": faults[BLANK], "duplicate": faults[TWICE], "truncated": faults[CUT], "illegal": illegal,
                  "cost": cost, "audit": "".join(letters for _, letters in slices)}
        return totals, [(key, state, letters) for key, (state, letters) in zip(self.keys, slices)]


TOTALS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def fold(segs: DataFrame, matrices: DataFrame, conv_type) -> DataFrame:
    """(``conv``, ``part``, ``k``, ``state``, ``letters``, ``alone``, ``totals``: set in a conversation's last segment)."""
    parts = int(segs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slim = (segs.select("conv", "part", "k", "sym", "first", "last", "turns").join(matrices, "sym")
                .repartition(parts, "conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), "part", "k")
                .select("conv", "part", "k", "sym", "costs", "edits", "first", "last", "turns"))
    total_type = pa.struct([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in TOTALS.split(", ")])
    schema = pa.schema([("conv", to_arrow_type(conv_type)), ("part", pa.int32()), ("k", pa.int64()), ("state", pa.int32()),
                        ("letters", pa.string()), ("alone", pa.bool_()), ("totals", total_type)])

    def run(batches):
        conv, current, out = None, None, []

        def close():
            totals, slices = current.result()
            for n, ((part, k), state, letters) in enumerate(slices, 1):
                out.append({"conv": conv, "part": part, "k": k, "state": state, "letters": letters, "alone": len(slices) == 1,
                            "totals": totals if n == len(slices) else None})

        for batch in batches:
            for c, part, k, *rest in zip(*(batch.column(i).to_pylist() for i in range(9))):
                if current is not None and c != conv:
                    close()
                    current = None
                    if len(out) >= 1024:
                        yield pa.RecordBatch.from_pylist(out, schema=schema)
                        out = []
                current, conv = current or Fold(), c
                current.add((part, k), *rest)
        if current is not None:
            close()
        yield pa.RecordBatch.from_pylist(out, schema=schema)

    return slim.mapInArrow(run, f"conv {conv_type.simpleString()}, part int, k long, state int, letters string, alone boolean, "
                                f"totals struct<{', '.join(c.replace(' ', ': ') for c in TOTALS.split(', '))}>")


def rebuild(state: int, letters: str, roles: list[str], texts: list[str]) -> list[tuple[str, str]]:
    """(role, text) rows that the edit letters leave of a segment that begins in ``state``."""
    out, at = [], 0
    for letter in letters:
        if letter in "IR":
            role, state = ("assistant", 3) if state == 2 else ("user", 2)
            out.append((role, texts[at] if letter == "R" else ""))
        elif letter == "K":
            state = 1 + ROLES.index(roles[at][0])
            out.append((roles[at], texts[at]))
        at += letter != "I"
    return out


def repair(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", damaged: DataFrame | None = None,
           rules: int = 160) -> DataFrame:
    """One row per conversation of ``df``: its faults, cheapest edits and the hash of what they leave.

    The rows repaired are ``damaged`` (default: ``damage(df)``), in the columns that ``damage`` returns.
    """
    conv_type = df.schema[conv_col].dataType
    rows = damage(df, conv_col, turn_col) if damaged is None else damaged
    segs = materialize(segments(symbols(rows), conv_type), "segments")
    distinct = materialize(segs.groupBy("sym").agg(F.count(F.lit(1)).alias("n")), "distinct_segments")
    matrices = segment_matrices(distinct, learn_rules(distinct, rules))
    found = materialize(fold(segs, matrices, conv_type), "folded")
    kind = conv_type.simpleString()
    conv_arrow = to_arrow_type(conv_type)

    def texts(batches):
        for batch in batches:
            out = []
            for state, letters, alone, roles, words in zip(*(batch.column(i).to_pylist() for i in range(1, 6))):
                body = "\n".join(f"{r}:{t}" for r, t in rebuild(state, letters, roles, words)).encode()
                out.append((hashlib.sha256(body).hexdigest() if alone else None, None if alone else body))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in (0, 3, 6, 7, 8)), pa.array([o[0] for o in out], pa.string()),
                                              pa.array([o[1] for o in out], pa.binary())],
                                             ["conv", "alone", "part", "k", "totals", "sha", "body"])

    def hashes(batches):
        conv, state, empty, fresh = None, None, True, True
        for batch in batches:
            out = []
            for c, totals, body in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if fresh or c != conv:
                    conv, state, empty, fresh = c, hashlib.sha256(), True, False
                if body:
                    state.update(body if empty else b"\n" + body)
                    empty = False
                if totals is not None:
                    out.append((c, totals, state.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], conv_arrow), pa.array([o[1] for o in out], batch.column(1).type),
                                              pa.array([o[2] for o in out], pa.string())], ["conv", "totals", "sha"])

    total_ddl = f"totals struct<{', '.join(c.replace(' ', ': ') for c in TOTALS.split(', '))}>"
    built = materialize(found.join(segs.select("part", "k", "roles", "texts"), ["part", "k"])
                        .select("conv", "state", "letters", "alone", "roles", "texts", "part", "k", "totals")
                        .mapInArrow(texts, f"conv {kind}, alone boolean, part int, k long, {total_ddl}, sha string, body binary"), "rebuilt")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    streamed = (built.filter(~F.col("alone")).repartition(parts, "conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), "part", "k")
                     .select("conv", "totals", "body").mapInArrow(hashes, f"conv {kind}, {total_ddl}, sha string"))
    done = built.filter("alone").select("conv", "totals", "sha").unionByName(streamed).select(F.col("conv").alias("_c"), "totals.*", "sha")
    every = df.select(F.col(conv_col).alias("_conv")).distinct()
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return every.join(done, F.col("_conv").eqNullSafe(F.col("_c")), "left").select(
        F.col("_conv").alias(conv_col), *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
