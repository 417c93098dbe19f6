from quarry.llm import preference as pf

SCHEMA = "pair_id long, turn int, role string, text string"
CHOSEN = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "good"), (2, 0, "user", "x"), (3, 0, "user", "same"), (None, 0, "user", "lost")]
REJECTED = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "bad"), (1, 3, "user", "more"), (2, 0, "user", "y"), (3, 0, "user", "same"), (4, 0, None, None)]


def strings(spark, chosen, rejected):
    rows = pf.segments(spark.createDataFrame(chosen, SCHEMA), spark.createDataFrame(rejected, SCHEMA))
    return {r["pair_id"]: r for r in pf.assemble(rows).collect()}


def test_prefix_once_and_masked_completions(spark):
    found = strings(spark, CHOSEN, REJECTED)
    one = found[1]
    assert one["prompt"] == "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\nu<|im_end|>\n"
    assert one["chosen"] == "<|im_start|>assistant\ngood<|im_end|>\n"
    assert one["rejected"] == "<|im_start|>assistant\nbad<|im_end|>\n<|im_start|>user\nmore<|im_end|>\n"
    trained = [one["rejected"][s["start"] : s["stop"]] for s in one["rejected_trained"]]
    assert trained == ["bad<|im_end|>\n"]
    assert found[2]["prompt"] == "" and found[2]["chosen_trained"] == []
    assert found[3]["chosen"] == found[3]["rejected"] == "" and "same" in found[3]["prompt"]
    assert found[4]["rejected"] == "<|im_start|>\n<|im_end|>\n" and set(found) == {1, 2, 3, 4}


def test_repeated_and_missing_turn_numbers(spark):
    turns = [(1, None, "user", "first"), (1, 5, "user", "b"), (1, 5, "user", "a"), (1, 5, "user", "a"), (1, 7, "assistant", "end")]
    found = strings(spark, turns, turns[:-1])[1]
    bodies = [p.split("\n")[1].removesuffix("<|im_end|>") for p in found["prompt"].split("<|im_start|>")[1:]]
    assert bodies == ["first", "a", "a", "b"] and "end" in found["chosen"] and found["rejected"] == ""


def test_a_middle_turn_differs(spark):
    left = [(1, k, "assistant", str(k)) for k in range(5)]
    right = [(1, k, "assistant", "other" if k == 2 else str(k)) for k in range(5)]
    found = strings(spark, left, right)[1]
    assert "0<" in found["prompt"] and "1<" in found["prompt"] and "3<" not in found["prompt"]
    assert found["chosen"].count("<|im_start|>") == found["rejected"].count("<|im_start|>") == 3


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert pf.segments(none, none).count() == 0
    empty = spark.createDataFrame([], "conv_id long, turn int, role string, text string, kept int")
    assert pf.segments(*pf.swapped_endings(empty)).count() == 0
