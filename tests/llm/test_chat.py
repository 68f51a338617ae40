"""Conversation collapse against brute force."""
from collections import defaultdict

from pyspark.sql import functions as F

from coldlake.llm import chat


def table(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return df.withColumns({c: F.lit("x") for c in ("k", "n", "h1", "lone", "part", "copies", "a")})


def log():
    rows = []
    for conv, words in {1: "abc", 2: "abcde", 3: "abcde", 4: "ab", 5: "abx", 6: "a", 7: "z", 8: "abcde", 9: "bcde"}.items():
        rows += [(conv, k, ("user", "assistant")[k % 2], w) for k, w in enumerate(words)]
    rows += [(10, 5 * k, None, None) for k in range(3)] + [(11, 0, None, None)] + [(12, 0, "", "")]
    rows += [(13, 0, "user", "a"), (13, 0, "user", "a"), (13, 1, "assistant", "q")]  # a repeated row
    rows += [(14, 0, "user", "two"), (14, 0, "user", "one"), (15, None, "user", "no turn"), (15, 1, "user", "a")]
    rows += [(16, k, "user", f"long {k}") for k in range(700)] + [(17, k, "user", f"long {k}") for k in range(600)]
    rows += [(None, 0, "user", "lone"), (None, 0, "user", "lone"), (None, 3, "user", "other"), (18, 0, "user", "long 0"), (18, 1, "user", "long 2")]
    return rows


def test_collapse_and_rendering(spark):
    rows = log()
    convs = defaultdict(set)
    for conv, turn, role, text in rows:
        convs[(conv, None) if conv is not None else (None, (turn, role, text))].add((turn, role, text))
    content = {}
    for key, turns in convs.items():
        order = sorted(turns, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "", x[2] or ""))
        content[key] = tuple((role, text) for _, role, text in order)
    ties = {14}  # tied turns run by content hash
    want = {}
    for key, c in content.items():
        if key[0] in ties or any(len(d) > len(c) and d[:len(c)] == c for d in content.values()):
            continue
        same = [k for k, d in content.items() if d == c]
        if key == min(same, key=lambda k: (k[0] is not None, k[0] or 0)):
            want[key[0], c] = len(c), len(same)
    got = defaultdict(list)
    for r in chat.format_chats(table(spark, rows)).collect():
        got[r["conv_id"], r["n_turns"], r["copies"]].append((r["part"], r["rendered"]))
    assert sum(k[0] == 14 for k in got) == 1
    rendered = {(k, "".join(t for _, t in sorted(v))) for k, v in got.items() if k[0] != 14 and k[0] is not None}
    assert rendered == {((i, n, m), "".join(f"<|im_start|>{role or ''}\n{text or ''}<|im_end|>\n" for role, text in c)) for (i, c), (n, m) in want.items() if i is not None}
    assert sorted(t for k, v in got.items() if k[0] is None for _, t in v) == ["<|im_start|>user\nlone<|im_end|>\n", "<|im_start|>user\nother<|im_end|>\n"]
    assert [p for p, _ in sorted(got[16, 700, 1])] == [0, 1, 2] and not any(k[0] in (1, 3, 4, 6, 8, 17) for k in got)


def test_no_rows_and_native_plan(spark):
    assert chat.format_chats(table(spark, [])).count() == 0
    plan = chat.format_chats(table(spark, log()[:9]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
