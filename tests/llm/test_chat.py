"""Chat formatting: read back against the rows, with control strings, ties, nulls and long conversations."""

import collections
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quarry.llm import chat

BITS = ["</s>", "<s>", "[INST]", "[/INST]", "<|im_sep|>", "<|im_end|>\n", "<|im_start|>", "<|endoftext|>", "\\", "<",
        "[", "<\\s>", "<\\\\|im_sep|>", "a", "\n", "é", " ", "$1"]


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(2)

    def text():
        return rnd.choice([None, "".join(rnd.choice(BITS) for _ in range(rnd.randint(0, 8)))])

    out = [(c, rnd.choice([t, t, 0, None]), rnd.choice(["user", "assistant", "system", "a\\n<|im_sep|>\nb", None, "\\"]),
            text()) for c in [*range(40), None] for t in range(rnd.randint(1, 9))]
    out += [(99, i, rnd.choice(["user", "assistant"]), f"turn {i}") for i in range(2500)]
    return out + [out[0]]


def test_read_back(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows],
                               "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(df)).collect()}
    by = collections.defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t is not None, t or 0, r or "", x or ""))
    assert got.keys() == by.keys()
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in turns).encode()).hexdigest()
        assert got[c].loss_chars == len(loss) and got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_adjacent_turns_of_a_role_share_a_run(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 600, "user", "c"),
                                (1, 601, "assistant", "d")], "conv_id long, turn long, role string, text string")
    got = chat.format_chats(df).first().formatted
    assert got == "<|im_start|>user\na<|im_sep|>b<|im_sep|>c<|im_end|>\n<|im_start|>assistant\nd<|im_end|>\n"


def test_escaped_texts_hold_no_control_string(spark):
    df = spark.createDataFrame([("".join(BITS),), ("</s>[INST] ok [/INST]",)], "t string")
    got = df.select("t", chat.escape(F.col("t")).alias("e")).withColumn("u", chat.unescape(F.col("e"))).collect()
    for r in got:
        assert r.u == r.t
        assert not any(x in r.e for x in ("</s>", "<s>", "[INST]", "[/INST]", "<|im_", "<|endoftext|>"))


def test_plan_has_no_python_and_empty_table(spark, rows, capsys):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    plan = chat.read_back(chat.format_chats(df))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
    assert chat.read_back(chat.format_chats(df.limit(0))).count() == 0
