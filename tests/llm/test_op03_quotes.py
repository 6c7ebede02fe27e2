from casewise.llm import quotes as Q

MAIL = [
    (1, 0, "user", "Does the  engine start?\n\nIt made a noise."),
    (1, 1, "assistant", "On Monday A wrote:\n> does the engine START?\n\nYes, it starts."),
    (1, 2, "user", "B wrote:\n>> Does the engine start?\n> Yes, it starts.\nGood.\n\n\n\nThanks."),
    (1, 3, "other", "> It made a noise.\nWhich noise?"),
    (1, 4, "user", "> never said\nHm."),
    (2, 0, "user", None),
    (2, 1, "user", "> It made a noise.\nother conversation"),
    (None, 5, "user", "lost"),
    (1, None, "user", "> Yes, it starts."),
    (3, 0, "user", ""),
]


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], "conv_id long, turn long, role string, text string, reply string, conv int")
    return Q.format_conversations(df.repartition(3)).collect()


def test_threads(spark):
    got = {(r["conv_id"], r["turn"]): r for r in run(spark, MAIL)}
    pick = {k: (r["parent_turn"], r["root_turn"], r["depth"]) for k, r in got.items()}
    assert pick[1, 0] == (None, 0, 0)
    assert pick[1, 1] == (0, 0, 1)
    assert pick[1, 2] == (1, 0, 2)
    assert pick[1, 3] == (0, 0, 1)
    assert pick[1, 4] == (None, 4, 0)
    assert pick[2, 1] == (None, 1, 0)
    assert pick[None, 5] == (None, 5, 0) and pick[1, None] == (None, None, 0)
    assert got[1, 1]["reply"] == "Yes, it starts."
    assert got[1, 2]["formatted"] == "<|user|>\nGood.\n\nThanks."
    assert got[2, 0]["reply"] == "" and got[1, 2]["n_quoted"] == 2


def test_order_and_repeats(spark):
    rows = run(spark, MAIL + MAIL)
    assert len(rows) == 2 * len(MAIL)
    key = [(r["conv_id"], r["root_turn"], r["turn"]) for r in rows if r["conv_id"] == 1 and r["turn"] is not None]
    assert key == sorted(key)
    assert {r["parent_turn"] for r in rows if (r["conv_id"], r["turn"]) == (1, 2)} == {1}


def test_long_chain_matches_walk(spark):
    """Every message quotes the one before; pointer doubling must reach the first."""
    rows = [(9, 0, "user", "line 0")] + [(9, k, "user", f"> line {k - 1}\nline {k}") for k in range(1, 40)]
    got = {r["turn"]: r for r in run(spark, rows)}
    assert all((got[k]["parent_turn"], got[k]["root_turn"], got[k]["depth"]) == (k - 1, 0, k) for k in range(1, 40))


def test_parse_long_message():
    text = "\n".join("> " * (i % 4) + f"word {i}" for i in range(50_000))
    reply, n, units = Q.parse_message(text)
    assert n == 37_500 and reply.count("\n") == 12_499 and len(units) == 100_000


def test_empty(spark):
    assert run(spark, []) == []
