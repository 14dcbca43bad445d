import hashlib
import random

from hypothesis import given
from hypothesis import strategies as st

from logquarry.llm.chat import CONTROL, chat_examples, escape, formatted_conversations, marks, turns_of, unescape

texts = st.lists(st.sampled_from([*CONTROL, "\\", "<", ">", "[", "]", "s", "/", "é𝄞", "\n", " "]), max_size=12).map("".join)


@given(texts)
def test_escape_is_reversible(text):
    hidden = escape(text)
    assert unescape(hidden) == text and not any(mark in hidden for mark in CONTROL)


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "a]b\\<s>"]), texts), max_size=6))
def test_turns_are_read_back(turns):
    formatted = "".join(f"{marks(role)[0]}{escape(text)}{marks(role)[1]}" for role, text in turns)
    assert list(turns_of(formatted)) == turns


def plain(rows):
    convs = {}
    for c, t, r, x in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        convs.setdefault(c, []).append((r or "", x or ""))
    out = []
    for c, turns in convs.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        whole = hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        sizes = [len(escape(x)) + sum(map(len, marks(r))) for r, x in turns]
        ends = [i for i, (r, _) in enumerate(turns) if r == "assistant" or i == len(turns) - 1]
        chars = sum(sum(sizes[: i + 1]) for i in ends)
        out.append((c, len(turns), whole, len(loss), hashlib.sha256(loss.encode()).hexdigest(), chars))
    return sorted(out, key=repr)


SCHEMA = "conv_id long, turn long, role string, text string"


def corpus():
    rng = random.Random(14)
    rows = []
    for c in range(40):
        for t in range(rng.choice([1, 2, 3, 8]) if c else 300):
            role = rng.choice(["user", "assistant", "assistant", "system", "tool", None])
            text = rng.choice([None, "", "hi", "</s>[INST] ok [/INST]", "\\<s>", "é" * 50, "two\nlines"])
            rows.append((c, t, role, text))
    rows += [(50, 1, "user", "tie"), (50, 1, "assistant", "tie"), (50, 1, "assistant", "tie"), (50, None, "user", "first")]
    rows += [(None, 0, "user", "q"), (None, 1, "assistant", "a"), (60, 0, "assistant", "x" * 1_000_000)]
    rng.shuffle(rows)
    return rows


def test_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as conv", "2 as example", "3 as loss")
    got = formatted_conversations(df)
    assert sorted(map(tuple, got.collect()), key=repr) == plain(rows)


def test_each_example_trains_one_reply(spark):
    rows = corpus()
    got = chat_examples(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len([r for r in got if r.loss_end > r.loss_start]) == len([1 for _, _, r, x in rows if r == "assistant" and x])
    for r in got:
        parsed = list(turns_of(r.text))
        if r.loss_end > r.loss_start:
            assert parsed[-1] == ("assistant", unescape(r.text[r.loss_start : r.loss_end]))
            assert r.text[r.loss_end :] == "</s>"
    assert sum(r.whole for r in got) == len({r[0] for r in rows})


def test_empty_table(spark):
    assert formatted_conversations(spark.createDataFrame([], SCHEMA)).collect() == []
