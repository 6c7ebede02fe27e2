import hashlib
import random
import re
import zlib
from itertools import product

import pytest
from conftest import SF_SMALL

from casewise.llm import conversation_repair as R
from casewise.llm.queries import op13_conversation_repair

SPACES = " \t\n\x0b\x0c\r"


def damaged(rows):
    """Rows of one conversation (conv, turn, role, text) after damage, in order."""
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        role, text = "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(turn, role, text, c) for c in range(2 if kind == 3 else 1)]
    digest = lambda r: hashlib.sha256(f"{len(r[1].encode())}:{r[1]}{r[2]}".encode()).digest()
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), digest(r), r[3]))


def faults(rows):
    out, seen = [], set()
    for _, role, text, _ in rows:
        t = text.strip(SPACES)
        out.append("blank" if not t else "duplicate" if (role, text) in seen else "truncated" if t[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def viterbi(rows, found):
    """Least (cost, letters) by a plain pass over rows with whole strings."""
    step = {(0, "s"): 1, **{(i, "u"): 2 for i in (0, 1, 3)}, (2, "a"): 3}

    def inserts(best):
        for _ in range(3):
            for (i, c), j in step.items():
                if c != "s" and i in best:
                    new = (best[i][0] + 2, best[i][1] + "I")
                    if j not in best or new < best[j]:
                        best[j] = new
        return best

    best = inserts({0: (0, "")})
    for (_, role, _, _), fault in zip(rows, found):
        new = {}

        def put(j, cost, letters):
            if j not in new or (cost, letters) < new[j]:
                new[j] = (cost, letters)

        for i, (cost, letters) in best.items():
            put(i, cost + 3, letters + "D")
            if fault in ("blank", "duplicate"):
                continue
            extra = fault == "truncated"
            if (i, role[:1]) in step:
                put(step[i, role[:1]], cost + extra, letters + "K")
            for c in "ua":
                if (i, c) in step:
                    put(step[i, c], cost + 2 + extra, letters + "R")
        best = inserts(new)
    return min(best[i] for i in (0, 3) if i in best)


def result(rows):
    rows = damaged(rows)
    found = faults(rows)
    turns = {r[0] for r in rows if r[0] is not None}
    initials = [r[1][:1] for r in rows]
    cost, audit = viterbi(rows, found)
    out, at = [], 0
    for letter in audit:
        if letter in "IR":
            role = "assistant" if out and out[-1][0][0] == "u" else "user"
            out.append((role, rows[at][2] if letter == "R" else ""))
        if letter == "K":
            out.append(rows[at][1:3])
        at += letter != "I"
    assert re.fullmatch("(s?(ua)+)?", "".join(r[0][0] for r in out))
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(found.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest())


def slow(rows):
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    return {c: result(rs) for c, rs in by.items()}


def test_given_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = op13_conversation_repair(spark, SF_SMALL).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == slow(rows) and len(got) == len({r[0] for r in rows})


def test_plain_pass_is_least_of_all_edits():
    """The plain pass against every edit string of short conversations."""
    rng = random.Random(4)
    for _ in range(60):
        rows = [(n, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["a.", "b", "", "a."]), 0) for n in range(rng.randrange(5))]
        found, best = faults(rows), None
        for gaps in product(range(4), repeat=len(rows) + 1):
            for edits in product("KRD", repeat=len(rows)):
                letters = "I" * gaps[0] + "".join(e + "I" * g for e, g in zip(edits, gaps[1:]))
                cost, state, at = 2 * sum(gaps), "", 0
                for c in letters:
                    if c == "I":
                        state += "a" if state[-1:] == "u" else "u"
                        continue
                    f, role = found[at], rows[at][1][:1]
                    at += 1
                    if c == "D":
                        cost += 3
                    elif f in ("blank", "duplicate"):
                        cost += 10 ** 6
                    else:
                        cost += (f == "truncated") + 2 * (c == "R")
                        state += ("a" if state[-1:] == "u" else "u") if c == "R" else role
                if re.fullmatch("(s?(ua)+)?", state) and (best is None or (cost, letters) < best):
                    best = (cost, letters)
        assert viterbi(rows, found) == best


def test_random_conversations_and_segments(spark, monkeypatch):
    monkeypatch.setattr(R, "SEGMENT", 5)
    rng = random.Random(13)
    rows = []
    for c in [*range(150), None]:
        for _ in range(rng.randrange(30)):
            rows.append((c, rng.choice([None, *range(20)]), rng.choice(["user", "assistant", "system", None, "", "tool", "Übel"]),
                         rng.choice([None, "", " \t", "Yes.", "No", "a\nb!", "So? ", "x" * 50])))
    rows += [(777, t, ("user", "assistant")[t % 2] if t % 11 else "assistant", f"line {t}" + "." * (t % 7 > 0)) for t in range(1500)]
    rows += [(778, 1, "user", "same.")] * 60 + [(779, None, "user", "?")] * 3
    # A conversation that damage empties.
    gone = next(c for c in range(10_000, 20_000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    rows += [(gone, 1, "user", "Hi.")]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, k int, totals string")
    got = R.repair(df.repartition(6), rules=20).collect()
    want = slow(rows)
    assert len(got) == len(want)
    for r in got:
        assert tuple(r)[1:] == want[r[0]], r[0]
    assert want[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_rules_and_products(spark):
    """Rewriting by rules changes neither costs nor letters, and rules repeat pairs of the corpus."""
    rng = random.Random(6)
    syms = ["".join(rng.choices("AEIBM", k=rng.randrange(1, 40))) for _ in range(200)] + ["EIEIEIEI"] * 50
    distinct = spark.createDataFrame([(s, 2) for s in set(syms)], "sym string, n long")
    rules = R.learn_rules(distinct, rules=40, per_round=8)
    assert 8 < len(rules) <= 40 and len({r[0] for r in rules}) == len(rules)
    assert {"EI", "IE"} & {a + b for _, a, b in rules}
    plain = {r["sym"]: (r["costs"], r["edits"]) for r in R.segment_matrices(distinct, []).collect()}
    packed = {r["sym"]: (r["costs"], r["edits"]) for r in R.segment_matrices(distinct, rules).collect()}
    assert plain == packed
    assert all(len(R.compress(s, rules)) < len(s) for s in syms if len(s) > 20)


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert R.repair(df).collect() == []


@pytest.mark.parametrize("a,b,least", [("a", "b", True), (("a", "c"), "ab", False), ("", "a", True), (("a", ("b", "c")), "abc", False)])
def test_rope_order(a, b, least):
    assert R.before(a, b) is least and (R.flat(a) < R.flat(b)) is least
