import hashlib

import pytest

from almanac.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, segments string, valid int, turns string, state string, formatted int"
NASTY = r"\### Assistant: </turn> ok"


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1, "y", "z", 2) for r in rows], SCHEMA)
    return {r.conv_id: r for r in chat.digest(chat.format_conversations(df)).collect()}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_round_trip_of_control_strings(spark):
    texts = [NASTY, "\\", "\\\\1", "##", "####", "</turn>", "</turn", "\n</turn>\n", "\\0\\1\\2\\n", "### user\nhi\n</turn>\n", "", None, "é\U0001f600", "x" * 200_000, " lead\n\n"]
    rows = [(i, t, role, text) for i, text in enumerate(texts) for t, role in ((1, "assistant"), (0, "user"))]
    got = run(spark, rows)
    for i, text in enumerate(texts):
        text = text or ""
        r = got[i]
        assert r.n_turns == 2 and r.valid and r.first_bad_turn is None
        assert r.turns_sha256 == sha(f"user\n{text}\nassistant\n{text}\n"), text[:50]
        assert (r.loss_chars, r.loss_sha256) == (len(text), sha(text))


def test_role_order(spark):
    orders = {1: ["user"], 2: ["system", "user", "assistant"], 3: ["assistant", "user"], 4: ["user", "user", "assistant"], 5: ["system", "system"], 6: ["tool"], 7: [None, "user"], 8: ["user", "assistant", "user", "assistant"], 9: ["us\ner ###"]}
    got = run(spark, [(c, t, role, f"t{t}") for c, roles in orders.items() for t, role in enumerate(roles)])
    assert {c: (r.valid, r.first_bad_turn) for c, r in got.items()} == {1: (False, None), 2: (True, None), 3: (False, 0), 4: (False, 1), 5: (False, 1), 6: (False, 0), 7: (False, 0), 8: (True, None), 9: (False, 0)}
    assert got[9].turns_sha256 == sha("us\ner ###\nt0\n")
    assert got[8].loss_sha256 == sha("t1t3")


def test_ties_repeats_and_nulls(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, None, "system", "s"), (1, 0, "user", "a"), (None, 0, "user", "x"), (None, 1, "assistant", "y")]
    got = run(spark, rows)
    assert got[1].n_turns == 4 and got[1].turns_sha256 == sha("system\ns\nuser\na\nuser\na\nuser\nb\n")
    assert got[None].valid


def test_empty_and_template(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_conversations(df).count() == 0
    own = chat.Template(open="<|", header_end="|>", close="<|end|>", controls=("<|", "|>"), transitions={("start", "a"): "end"}, accepting=("end",), loss_roles=("a",))
    df = spark.createDataFrame([(1, 0, "a", "<|x|> \\ <|end|>")], "conv_id long, turn long, role string, text string")
    r = chat.digest(chat.format_conversations(df, own), own).first()
    assert r.valid and r.turns_sha256 == sha("a\n<|x|> \\ <|end|>\n") and r.loss_chars == 15


def test_segments_join_to_the_output(spark):
    df = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a")], "conv_id long, turn int, role string, text string")
    r = chat.format_conversations(df).first()
    assert r.formatted == "".join(s.text for s in r.segments) == "### user\nq\n</turn>\n### assistant\na\n</turn>\n"
    assert [s.text for s in r.segments if s.loss] == ["a"]


def test_templates_that_could_not_be_read_back_are_refused():
    for odd in (dict(controls=("###",)), dict(header_end=": "), dict(controls=("###", "</turn>", "1")), dict(controls=("###", "</turn>", "a\\b")), dict(controls=("###", "</turn>", *"abcdefgh"))):
        with pytest.raises(ValueError):
            chat.Template(**odd)
    chat.Template(header_end=" ###: ")
