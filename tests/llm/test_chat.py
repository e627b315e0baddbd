"""Chat strings: an exact round trip, and counts beside a plain reading of the rows."""

import hashlib
import itertools

import pytest

from treeledger.llm import chat
from treeledger.llm.registry import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"
HARD = ["</s>[INST] ok [/INST]", "<~s><~~s>[+]", "[~/INST]<s", ">[INST", "<s><s>]", "", None, "\\$1\n~", "[+][+]<~/s>", "é" * 3 + "𝄞"]


def plain(rows):
    by = {}
    for c, n, role, text in rows:
        by.setdefault(c, []).append((n is not None, n or 0, role or "", text or ""))
    out = []
    for c, turns in by.items():
        turns.sort(key=lambda t: (t[0], t[1], t[2].encode(), t[3].encode()))
        said = "".join(f"{r}\n{t}\n" for *_, r, t in turns)
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        out.append((c, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return sorted(out, key=repr)


def hard_rows():
    roles = ["user", "assistant", "assistant", None, "[INST]", "system\n", "assistant", "assistant", "user", "user"]
    rows = [(k, (j * 7) % 10, roles[(j + k) % 10], HARD[(j * 3 + k) % 10]) for k in range(12) for j in range(10)]
    return rows + [(20, None, "user", "x"), (20, None, "user", "x"), (20, 1, "assistant", "y" * 200_000), (None, 1, "user", "n"), (None, 0, "assistant", "m")]


@pytest.mark.parametrize("part_turns", [512, 3])
def test_round_trip(spark, part_turns):
    rows = hard_rows()
    out = chat.formatted(spark.createDataFrame([(*r, 0, "z") for r in rows], SCHEMA + ", part int, key_ string"), part_turns=part_turns)
    got = sorted((tuple(r)[:5] for r in chat.summaries(out).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256").collect()), key=repr)
    assert got == plain(rows)


def test_strings_and_spans(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "a<s>"), (1, 2, "user", "b"), (1, 3, "assistant", "c"), (1, 4, "assistant", "[+]"), (1, 5, "user", "d")]
    (r,) = chat.formatted(spark.createDataFrame(rows, SCHEMA)).collect()
    assert r.formatted == "<s>system[INST]s</s><s>user[INST]a<~s>[+]b</s><s>assistant[/INST]c[+][~+]</s><s>user[INST]d</s>"
    assert [r.formatted[s.start:s.start + s.length] for s in r.spans] == ["c", "[~+]"]
    (both,) = chat.formatted(spark.createDataFrame(rows, SCHEMA), loss_roles=("user", "assistant")).collect()
    assert [both.formatted[s.start:s.start + s.length] for s in both.spans] == ["a<~s>", "b", "c", "[~+]", "d"]


def test_escapes_are_reversible(spark):
    texts = ["".join(p) for n in range(1, 6) for p in itertools.product("<~s>", repeat=n)] + ["".join(p) for p in itertools.product(["[", "~", "+", "]", "/", "INST"], repeat=4)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escaped(chat.F.col("t")).alias("e"))
    rows = df.select("t", "e", chat.unescaped(chat.F.col("e")).alias("back")).collect()
    assert all(r.back == r.t for r in rows)
    assert not any(mark in r.e for r in rows for mark in ("<s>", "</s>", "[INST]", "[/INST]", "[+]"))


def test_a_long_conversation_is_written_in_parts(spark, tmp_path):
    rows = [(5, k % 700, "user" if k % 2 else "assistant", f"t{k}") for k in range(2000)] + [(6, 0, "user", "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    parts = chat.formatted(df).where("conv_id = 5").collect()
    assert sorted(r.part for r in parts) == [0, 1, 2, 3]
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted((tuple(r)[:5] for r in QUERIES["op13_chat_format"](spark, str(tmp_path)).collect() if r.conv_id != -1), key=repr)
    assert got == plain(rows)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    (r,) = QUERIES["op13_chat_format"](spark, str(tmp_path)).collect()
    assert (r.conv_id, r.n_turns, r.loss_chars) == (-1, 2, len(chat.PLANTED))
    assert chat.summaries(chat.formatted(spark.createDataFrame([], SCHEMA))).count() == 0
