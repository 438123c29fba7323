import hashlib
import random
import re
import time

from evimap.llm.chat import digests, format_chats, read_back

SCHEMA = "conv_id long, turn long, role string, text string, block int, window int"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def expected(rows):
    convs = {}
    for r in rows:
        convs.setdefault(r[0], []).append((r[1] if r[1] is not None else -(10**9), r[2] or "", r[3] or ""))
    out = {}
    for c, turns in convs.items():
        turns.sort()
        loss = "".join(t for _, role, t in turns if role == "assistant")
        out[c] = (len(turns), sha("".join(f"{role}\n{t}\n" for _, role, t in turns)), len(loss), sha(loss))
    return out


def rows_of(spark):
    rows = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    rows += [(1, 0, "system", "Be <|im_end|> \\<|x [\\INST] [\\[/INST]")] + [(1, i, "user" if i % 2 else "assistant", f"t{i} <\\|im_start|> <<SYS>> <\\<SYS>> 😀 " * (i % 7)) for i in range(1, 1300)]
    rows += [(2, 0, None, None), (2, None, "assistant", ""), (2, 0, "to\nol %+ <|", "x"), (2, 0, "to\nol %+ <|", "x"), (3, 5, "assistant", "word " * 9000)]
    rows += [(None, 0, "assistant", "a"), (None, 1, "user", None)]
    return [(*r, 1, 2) for r in rows]


def test_round_trip(spark):
    rows = rows_of(spark)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in digests(format_chats(spark.createDataFrame(rows, SCHEMA), budget=200, history=40)).collect()}
    assert got == expected(rows)


def cost_of(text):
    return 4 + len(re.findall(r"[^\W_]+|[^\w\s]|_", text))


def test_windows_keep_budget_system_and_history(spark):
    rows = [(1, 0, "system", "rules"), *((1, i, "user" if i % 2 else "assistant", "w " * 10) for i in range(1, 1030))]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], SCHEMA)
    windows = format_chats(df, budget=100, history=30).orderBy("window").collect()
    assert len(windows) == 1 + -(-(1029 - 6) // 4)  # six turns beside the system turn in the first, four new ones after that
    seen = []
    for w in windows:
        assert w.formatted.startswith("<|im_start|>system\nrules<|im_end|>\n")
        assert sum(cost_of(w.formatted[t.text_at : t.text_at + t.text_chars]) for t in w.turns) <= 100
        seen.append([t.repeated for t in w.turns])
    assert all(s[:4] == [True, True, True, False] for s in seen[1:])  # system, two repeated turns, then own ones
    assert all(sum(not x for x in s) == 4 for s in seen[1:-1])  # at turn 512 as anywhere
    assert read_back(format_chats(df, budget=100, history=30)).first().n_turns == 1030


def plain_windows(rows, budget, history):
    """For each window the positions of its turns and which of them are repeated, turn by turn."""
    cost = [cost_of(t) for _, _, _, t in rows]
    system = min(cost[0], budget // 2) if rows[0][2] == "system" else 0
    cost[0] = system or cost[0]
    out, used = [], None
    for i, c in enumerate(cost):
        if used is not None and used + c <= budget:
            out[-1].append((i, False))
            used += c
            continue
        past = i
        while past > (1 if system else 0) and sum(cost[past - 1 : i]) <= history:
            past -= 1
        lead = system if i else 0
        past = past if lead + sum(cost[past:i]) + c <= budget else i
        used = lead + sum(cost[past : i + 1])
        out.append([(0, True)] * (system > 0 and i > 0) + [(k, True) for k in range(past, i)] + [(i, False)])
    return out


def test_windows_against_plain_planning(spark):
    r = random.Random(6)
    rows, want = [], {}
    for conv in range(40):
        own = [(conv, i, "system" if i == 0 and conv % 2 else r.choice(["user", "assistant"]), f"t{i} " * r.choice([0, 1, 3, 20, 70])) for i in range(r.randint(1, 90))]
        rows += own
        want[conv] = [[(own[k][3], repeated) for k, repeated in w] for w in plain_windows(own, 100, 30)]
    got = {}
    for w in format_chats(spark.createDataFrame([(*x, 0, 0) for x in rows], SCHEMA), budget=100, history=30).orderBy("conv_id", "window").collect():
        got.setdefault(w.conv_id, []).append([(w.formatted[t.text_at : t.text_at + t.text_chars], t.repeated) for t in w.turns])
    assert got == want


def test_many_turns(spark):
    """Planning is linear in a conversation's turns; no window ends for another reason than its budget."""
    n = 200_000
    rows = spark.range(n).selectExpr("1L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "'ab' AS text")
    began = time.time()
    windows = format_chats(rows).selectExpr("window", "size(turns) AS n", "size(filter(turns, t -> t.repeated)) AS past").orderBy("window").collect()
    assert time.time() - began < 120
    assert sum(w.n - w.past for w in windows) == n and {w.n for w in windows[:-1]} == {windows[0].n}


def test_turns_over_the_budget(spark):
    big = [(1, 0, "system", "s " * 300), (1, 1, "user", "u"), (1, 2, "assistant", "a " * 500), (1, 3, "user", "v")]
    lead = [(2, 0, "system", "s " * 40), (2, 1, "user", "u " * 50), (2, 2, "assistant", "a " * 20)]
    df = spark.createDataFrame([(*r, 0, 0) for r in big + lead], SCHEMA)
    shown = {}
    for w in format_chats(df, budget=100, history=30).orderBy("window").collect():
        shown.setdefault(w.conv_id, []).append([(w.formatted[t.text_at], t.repeated) for t in w.turns])
    # of a large system turn half of the budget counts, and a turn that is over the budget alone goes without history
    assert shown[1] == [[("s", False), ("u", False)], [("s", True), ("a", False)], [("s", True), ("v", False)]]
    assert shown[2] == [[("s", False), ("u", False)], [("s", True), ("a", False)]]


def test_long_conversation(spark):
    rows = [(1, i, "user" if i % 2 else "assistant", f"w{i} " * 2000) for i in range(600)]
    got = digests(format_chats(spark.createDataFrame([(*r, 0, 0) for r in rows], SCHEMA))).first()
    assert (got.n_turns, got.turns_sha256, got.loss_chars, got.loss_sha256) == expected(rows)[1]


def test_empty(spark):
    assert digests(format_chats(spark.createDataFrame([], SCHEMA))).collect() == []
