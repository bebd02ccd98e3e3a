import hashlib

from pyspark.sql import functions as F

from strandloom.llm import chat

ODD = ["</s>[INST] ok [/INST]", "%5B[<%3C]%25", "<<SYS>>x<</SYS>>", "[ROLE=a]b[/ROLE]", "", None, "é\n漢字 <s>"]


def rows():
    out = []
    for c in range(12):
        for t in range(c * 9 % 40):
            role = "system" if t == 0 and c % 3 == 0 else ("assistant" if t % 2 else "user")
            out.append((c, t, role, ODD[(c + t) % 7] if t % 5 == 0 else f"turn {t} " * (t * 7 % 60)))
    out += [(50, None, "user", "null turn"), (50, 0, None, "no role"), (50, 1, "tool]x[", "a tool"), (51, 0, "assistant", "x" * 30_000), (51, 1, "assistant", "after")]
    return out + [(None, 0, "user", "no id"), (None, 1, "assistant", "yes"), (52, 1, "user", "same"), (52, 1, "user", "same"), (52, 1, "assistant", "tie")]


def expected(data):
    by = {}
    for c, t, role, text in data:
        by.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    return {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in by.items()}


def test_round_trip(spark):
    df = spark.createDataFrame([(*r, "f") for r in rows()], "conv_id long, turn long, role string, text string, formatted string")
    windows = chat.format_windows(df, span_tokens=200, history_tokens=60)
    read = chat.read_windows(windows).orderBy("conv_id", "span").collect()
    turns, targets = {}, {}
    for r in read:
        turns.setdefault(r["conv_id"], []).extend((t["role"], t["text"]) for t in r["turns"])
        targets.setdefault(r["conv_id"], []).extend(r["targets"])
    want = expected(rows())
    assert turns == want
    assert targets == {c: [x for role, x in v if role == "assistant"] for c, v in want.items()}


def test_windows_keep_system_and_budget(spark):
    data = [(1, 0, "system", "be kind")] + [(1, t, "assistant" if t % 2 == 0 else "user", "word " * 20) for t in range(1, 60)]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    got = chat.format_windows(df, span_tokens=200, history_tokens=60).orderBy("span").collect()
    assert len(got) > 5
    for r in got:
        assert r["formatted"].startswith("<<SYS>>be kind<</SYS>>")
        assert len(r["formatted"]) / 4 < 200 + 60 + 60
    assert all(r["n_repeated"] == 3 for r in got[1:])  # system and two turns
    assert chat.format_windows(df.limit(0)).collect() == []


def test_no_python_on_executors(spark):
    df = spark.createDataFrame(rows(), "conv_id long, turn long, role string, text string")
    plan = chat.read_windows(chat.format_windows(df))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_digest_of_hidden_targets(spark):
    df = spark.createDataFrame([(-7, 0, "user", ODD[0]), (-7, 1, "assistant", ODD[0])], "conv_id long, turn long, role string, text string")
    r = chat.read_windows(chat.format_windows(df)).select(F.sha2(F.array_join("targets", ""), 256)).first()
    assert r[0] == hashlib.sha256(ODD[0].encode()).hexdigest()
