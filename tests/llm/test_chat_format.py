import hashlib
import random

from docloom.llm import chat_format, queries


def test_round_trip(spark):
    r = random.Random(7)
    pieces = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "\\-", "<", "[", "s>", "/s>", "INST]", "\n", " ", "é𝄞", "[/INST] ", "$1", "\\E", ""]
    text = lambda: "".join(r.choice(pieces) for _ in range(r.randrange(0, 9)))
    turns = [(c, t, r.choice(["user", "assistant", "system", "tool </s>", " [/INST]", ""]), text()) for c in range(60) for t in range(r.randrange(1, 6))]
    turns += [(99, None, None, None), (99, 1, "assistant", None), (99, 1, "assistant", None), (None, 0, "user", "x")]
    df = spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn long, role string, text string, place int")
    rows = chat_format.format_conversations(chat_format.format_turns(df))
    rows = rows.withColumn("back", chat_format.read_back(rows["formatted"])).collect()
    want = {}
    for c, t, role, x in sorted(turns, key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or "")):
        want.setdefault(c, []).append((role or "", x or ""))
    assert {r.conv_id: [tuple(t) for t in r.back] for r in rows} == want
    for row in rows:
        assert row.formatted == "".join(s.text for s in row.segments)
        assert row.formatted.count("</s>") == row.formatted.count("<s>") == len(row.back)
        assert [s.loss for s in row.segments] == [x for role, _ in want[row.conv_id] for x in (False, role == "assistant", False)]


def test_states(spark):
    talks = {1: ["user", "assistant"], 2: ["system", "user", "assistant", "user", "assistant"], 3: ["user"], 4: ["assistant", "user"], 5: ["user", "user", "assistant"], 6: ["user", "assistant", "system", "user", "assistant"], 7: ["tool"]}
    df = spark.createDataFrame([(c, k, role, "x") for c, roles in talks.items() for k, role in enumerate(roles)], "conv_id long, turn long, role string, text string")
    out = chat_format.format_conversations(chat_format.format_turns(df)).collect()
    assert {r.conv_id for r in out if r.valid} == {1, 2}
    assert chat_format.format_turns(df.limit(0)).count() == 0


def test_planted(spark, sf_dir):
    row = queries.op6_chat_formatting(spark, sf_dir).where("conv_id = -1").first()
    text = queries.PLANTED_TEXT
    turns = f"user\n{text}\nassistant\n{text}\n"
    assert row.n_turns == 2 and row.turns_sha256 == hashlib.sha256(turns.encode()).hexdigest()
    assert row.loss_chars == len(text) and row.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_sql(spark, sf_dir, same_rows):
    same_rows(queries.op6_chat_formatting(spark, sf_dir), queries.OP6_SQL)


def test_native(spark, sf_dir):
    plan = queries.op6_chat_formatting(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
