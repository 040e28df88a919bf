"""Chat windows: exact round trips, budgets and masks."""

import hashlib

from hypothesis import given
from hypothesis import strategies as st

from waymill.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, window string"
TRICKY = st.lists(st.sampled_from([*"ab \\<>[]/|lo\nSYINTRUE", "</s>", "[/INST]", "\\\\"]), max_size=40).map("".join)
TURNS = st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool", "", "[x]"]), TRICKY), max_size=12)


@given(TRICKY)
def test_escapes(text):
    assert chat.unescape(chat.escape(text)) == text
    for mark in ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "[ANS]", "[TURN]"):
        assert mark not in chat.escape(text)


@given(TURNS, st.integers(1, 60), st.integers(0, 30))
def test_windows(turns, budget, history):
    said, targets, at = [], [], 0
    for first, new, last, tokens, text, spans in chat.windows(turns, budget, history):
        parsed = chat.parse(text)
        assert new == at and first <= new < last
        system = turns[:1] if new and turns[0][0] == "system" else []
        assert parsed == system + turns[first:last]
        assert tokens <= budget or last == new + 1
        said += parsed[len(parsed) - (last - new) :]
        targets += [chat.unescape(text[s:e]) for s, e in spans]
        at = last
    assert said == turns and targets == [t for r, t in turns if r == "assistant"]


def listed(turns, budget, history, counter):
    """The windows by prefix sums over the whole list of turns."""
    total = [0]
    for r, t in turns:
        total.append(total[-1] + counter(chat.render(r, t)[0]))
    system = 1 if turns and turns[0][0] == "system" else 0
    at = 0
    while at < len(turns):
        first, kept = at, total[system] if at else 0
        while at > system and first > system and total[at] - total[first - 1] <= history:
            first -= 1
        while first < at and kept + total[at + 1] - total[first] > budget:
            first += 1
        last = at + 1
        while last < len(turns) and kept + total[last + 1] - total[first] <= budget:
            last += 1
        yield first, at, last, kept + total[last] - total[first]
        at = last


@given(TURNS, st.integers(1, 60), st.integers(0, 30))
def test_the_stream_gives_the_windows_of_prefix_sums(turns, budget, history):
    assert [w[:4] for w in chat.windows(iter(turns), budget, history)] == list(listed(turns, budget, history, chat.count_tokens))


def test_a_long_conversation_is_never_held():
    import tracemalloc

    turns = (("user" if i % 2 == 0 else "assistant", f"turn {i} " * 20) for i in range(20_000))
    tracemalloc.start()
    n = sum(last - new for _, new, last, *_ in chat.windows(turns, 512, 128))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 20_000 and peak < 1 << 20


def test_rows_without_a_conversation_stay_apart(spark):
    rows = [(None, 0, "user", f"nobody {i % 3}", "w") for i in range(30)] + [(5, 0, "user", "x", "w")]
    got = chat.digest_windows(chat.format_conversations(spark.createDataFrame(rows, SCHEMA))).collect()
    assert len(got) == 31 and all(r["n_turns"] == 1 for r in got)
    assert len({r["turns_sha256"] for r in got}) == 4


def test_history_is_repeated_within_its_budget():
    turns = [("system", "be brief"), *[("user" if i % 2 == 0 else "assistant", "word " * 8) for i in range(12)]]
    found = list(chat.windows(turns, 60, 30))
    assert len(found) > 1 and all(first < new for first, new, *_ in found[1:])


def test_table(spark):
    rows = [(1, 1, "assistant", "B"), (1, 0, "user", "A"), (2, 0, None, None), (None, 0, "user", "nobody"), (3, None, "assistant", "é\0"), (1, 1, "assistant", "B"), (4, 0, "user", "long " * 30_000), (4, 1, "assistant", "</s>[INST] ok [/INST]")]
    df = spark.createDataFrame([(*r, "w") for r in rows], SCHEMA)
    got = {r["conv_id"]: tuple(r)[1:] for r in chat.digest_windows(chat.format_conversations(df)).collect()}
    assert len(got) == 5

    def digest(turns):
        return hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()

    for conv, turns in {1: [("user", "A"), ("assistant", "B"), ("assistant", "B")], 2: [("", "")], None: [("user", "nobody")], 3: [("assistant", "é\0")], 4: [("user", "long " * 30_000), ("assistant", rows[-1][3])]}.items():
        target = "".join(t for r, t in turns if r == "assistant")
        assert got[conv][:4] == (len(turns), digest(turns), len(target), hashlib.sha256(target.encode()).hexdigest())
    assert chat.format_conversations(df.limit(0)).collect() == []
