from foliant.llm.chat import format_conversations, format_preferences


def one(role, text):
    return f"<|im_start|>{role or ''}\n{text or ''}<|im_end|>\n"


def test_prefix_completions_and_masks(spark):
    rows = [
        (0, 0, "user", "hi"), (0, 1, "assistant", "good"), (1, 0, "user", "hi"), (1, 1, "assistant", "bad<|im_end|>"), (1, 2, "user", "why"),
        (2, 0, "user", "a"), (2, 1, None, None), (3, 0, "user", "a"), (3, 1, None, None), (3, 1, None, None),
        (4, 0, "user", "x"), (5, 0, "user", "x"),
        (6, None, "system", ""), (8, 1, "user", "only"), (None, 0, "user", "nobody"), (9, 1, "user", None),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, side string")
    got = {r.pair_id: r for r in format_conversations(df).collect()}
    assert set(got) == {0, 2, 4, 6, 9}
    r = got[0]
    assert (r.status, r.n_prompt_turns, r.prompt) == ("paired", 1, one("user", "hi"))
    assert r.chosen == one("assistant", "good") and r.rejected == one("assistant", "bad< |im_end|>") + one("user", "why")
    assert r.chosen_mask == f"{len('<|im_start|>assistant') + 1}x0,{len('good<|im_end|>')}x1,1x0"
    runs = [x.split("x") for x in r.rejected_mask.split(",")]
    assert sum(int(n) for n, _ in runs) == len(r.rejected)
    assert (got[2].status, got[2].n_prompt_turns, got[2].chosen, got[2].rejected) == ("paired", 2, "", one(None, None))
    assert (got[4].status, got[4].chosen, got[4].rejected, got[4].prompt) == ("identical", "", "", one("user", "x"))
    assert (got[6].status, got[6].n_prompt_turns, got[6].chosen, got[6].rejected) == ("paired", 0, one("system", ""), one("user", "only"))
    assert (got[9].status, got[9].rejected, got[9].chosen, got[9].prompt) == ("unpaired", None, one("user", None), "")
    assert format_conversations(df.limit(0)).count() == 0


def test_long_conversation(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"t{t}" if t < 2999 else f"end{c}") for c in (0, 1) for t in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    r = format_conversations(df).first()
    assert r.n_prompt_turns == 2999 and r.chosen == one("assistant", "end0")


def test_conversations_of_one_first_turn_are_paired(spark):
    """Seven with a common first turn among others: the prompt decides in three pairs, and the rest are paired by id."""
    rows = [(c, 0, "user", "common" if c % 3 == 1 else f"own {c}") for c in range(-4, 17)] + [(c, 1, "assistant", f"answer {c}") for c in range(-4, 17)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.pair_id: r for r in format_conversations(df).collect()}
    common = [c for c in range(0, 17) if c % 3 == 1]
    for a, b in zip(common[::2], common[1::2]):
        assert got[a].prompt == one("user", "common") and got[a].chosen == one("assistant", f"answer {a}") and got[a].rejected == one("assistant", f"answer {b}")
    assert sum(r.n_prompt_turns for r in got.values()) == len(common) // 2
    assert got[-4].rejected == one("user", "own -3") + one("assistant", "answer -3") and got[-2].status == "paired"
    assert sum(2 - (r.status == "unpaired") for r in got.values()) == 21


def test_query_equals_its_sql_where_first_turns_are_shared(spark, tmp_path):
    import duckdb

    from foliant.llm.queries import op4

    rows = [(c, t, None if c % 11 == 3 and t == 2 else "user" if t % 2 == 0 else "assistant", f"t{t if t < c % 4 else c}") for c in range(-30, 2100) for t in range(c % 5)]
    rows += rows[:40] + [(None, 0, "user", "x")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = op4.op4_preference_format(spark, str(tmp_path)).collect()
    names = sorted(got[0].asDict())
    with duckdb.connect() as con:
        con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
        want = con.execute(f"select {', '.join(names)} from ({op4.SQL})").fetchall()
    assert sum(r.n_prompt_turns > 0 for r in got) > 300
    assert sorted((tuple(r[n] for n in names) for r in got), key=str) == sorted(want, key=str)
