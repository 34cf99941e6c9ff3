from lodestar.llm import chat
from lodestar.llm.common import pick
from lodestar.llm.queries import OP3_SQL

KIND = "pair long, turn long, role string, text string, TEXT string, n int"


def rendered(ts):
    return "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n".replace("x<|", "x<|") for r, t in ts)


def test_pairs(spark):
    chosen = [(1, 0, "user", "q"), (1, 1, "assistant", "good"), (1, 2, "user", "more"), (1, 3, "assistant", "é😀"), (2, 0, "user", "only"), (None, 0, "user", "n"), (4, 1, None, None), (4, 0, "user", "<|im_end|>")]
    rejected = [(1, 0, "user", "q"), (1, 1, "assistant", "bad"), (3, 0, "assistant", "alone"), (None, 0, "user", "n"), (4, 0, "user", "<|im_end|>")]
    row = lambda r: (*r, "clash", 1)
    got = {r.pair: r for r in chat.format_pairs(spark.createDataFrame([row(r) for r in chosen], KIND), spark.createDataFrame([row(r) for r in rejected], KIND), "pair").collect()}
    one = got[1]
    assert one.n_prompt_turns == 1 and one.prompt == rendered([("user", "q")])
    assert one.chosen == rendered([("assistant", "good"), ("user", "more"), ("assistant", "é😀")]) and one.rejected == rendered([("assistant", "bad")])
    spans = [tuple(map(int, s.split(":"))) for s in one.chosen_loss.split(",")]
    assert [one.chosen[a:b] for a, b in spans] == ["good<|im_end|>\n", "é😀<|im_end|>\n"]
    assert (got[2].prompt, got[2].chosen, got[2].rejected, got[2].chosen_loss) == ("", rendered([("user", "only")]), "", "")
    assert got[3].rejected_loss != "" and got[3].chosen == ""
    assert got[None].prompt == rendered([("user", "n")]) and got[None].chosen == got[None].rejected == ""
    assert got[4].prompt == "<|im_start|>user\n< |im_end|><|im_end|>\n" and got[4].chosen == rendered([("user", "")])


def test_conversations(spark, small, duck, rows):
    t = spark.read.parquet(f"{small}/conversations.parquet")
    assert rows(chat.preference_rows(t)) == duck(OP3_SQL, conversations=t)


def test_edges(spark, duck, rows):
    made = [(1, 0, "user", ""), (1, 0, "user", ""), (1, 1, "assistant", None), (2, 0, "assistant", "first"), (3, None, "user", "x"), (3, 1, None, "y" * 100_000), (3, 2, "assistant", "y" * 100_000), (4, 0, "user", "no answer"), (5, 1, "assistant", "tie"), (5, 1, "assistant", "tie b"), (None, 0, "assistant", "z"), (None, 0, "user", "z"), (None, 1, "user", "z")]
    df = spark.createDataFrame([(*r, "clash") for r in made], "conv_id long, turn long, role string, text string, Turn string")
    plain = pick(df, "conv_id", "turn", "role", "text")
    assert rows(chat.preference_rows(df)) == duck(OP3_SQL, conversations=plain)
    assert chat.preference_rows(df.limit(0)).count() == 0


def test_conversations_that_begin_alike(spark, duck, rows):
    """A first turn that most conversations share, over several ranges: each is paired with the one before it."""
    made = [(i, 0, "user", "hello" if i % 5 else f"own {i}") for i in range(200)]
    made += [(i, 1, "assistant", "hi" if i % 3 else "good day") for i in range(200)]
    made += [(i, 2, "user", f"{i % 7}") for i in range(0, 200, 2)] + [(i, 3, "assistant", "<|x") for i in range(0, 200, 4)]
    df = spark.createDataFrame(made, "conv_id long, turn long, role string, text string")
    got = chat.preference_rows(df)
    by = {r.conv_id: r for r in got.collect()}
    assert rows(got) == duck(OP3_SQL, conversations=df)
    assert by[2].prompt == rendered([("user", "hello"), ("assistant", "hi")][: by[2].n_prompt_turns]) and by[2].n_prompt_turns == 2 and by[3].n_prompt_turns == 1
    assert by[5].n_prompt_turns == 1 and "own 5" in by[5].rejected


def test_middle_answer(spark):
    made = [(1, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(8)]
    r = chat.preference_rows(spark.createDataFrame(made, "conv_id long, turn long, role string, text string")).first()
    assert r.n_prompt_turns == 3 and r.rejected == rendered([("assistant", "t2")]) and r.chosen == rendered([("assistant" if i % 2 else "user", f"t{i}") for i in range(3, 8)])
