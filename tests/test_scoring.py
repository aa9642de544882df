"""The scoring stage against a plain loop."""

import json
import math
import re
from collections import Counter

import numpy as np
import pytest

from paperloom.operators import scoring as sg


def plain_model(rows):
    yes, no = Counter(), Counter()
    for text, risky in rows:
        if risky is not None:
            for b in {int(__import__("hashlib").md5(w.lower().encode()).hexdigest()[:3], 16) for w in re.findall(sg.WORD, text or "")}:
                (yes if risky else no)[b] += 1
    return [math.floor(1000 * math.log((yes[b] + 1) / (no[b] + 1))) for b in range(sg.BUCKETS)]


def test_model_is_counted_whole(spark):
    rows = [("good words here", False), ("Bad words words", True), (None, True), ("ignored text", None), ("", False), ("bad bad", True)]
    model = sg.learn_word_model(spark.createDataFrame(rows, "text string, risky boolean").repartition(3))
    assert model.tolist() == plain_model(rows)
    assert not sg.learn_word_model(spark.createDataFrame([], "text string, risky boolean")).any()


def test_chain(spark):
    def first(model, prompts):
        if any("boom" in p for p in prompts):
            raise RuntimeError("503 boom")
        return ["not json" if "bad" in p else ValueError("401 key") if "key" in p else json.dumps({"m": model, "p": p}) for p in prompts]

    def second(_, prompts):
        return [ValueError("429 quota") if "never" in p else '{"second": true}' for p in prompts]

    rows = [(i, p) for i, p in enumerate(["a", "boom", "bad", "key", "never boom", None, "", "z", "boom never"] * 40)]
    df = spark.createDataFrame(rows, "clause_id long, prompt string").repartition(4)
    got = {r["clause_id"]: r for r in sg.score_pieces(df, [sg.Scorer("one", first, 7), sg.Scorer("two", second)], batch=16).collect()}
    assert len(got) == len(rows)
    for i, p in rows:
        p, r = p or "", got[i]
        if "key" in p:
            assert (r["answer"], r["model"], r["error"]) == (None, None, "one: 401 key")
        elif "never" in p:
            assert (r["answer"], r["model"], r["error"]) == (None, None, "two: 429 quota")
        elif "boom" in p or "bad" in p:
            assert (json.loads(r["answer"]), r["model"], r["error"]) == ({"second": True}, "two", None)
        else:
            assert (json.loads(r["answer"]), r["model"], r["error"]) == ({"m": 7, "p": p}, "one", None)


def test_wrong_number_of_answers_is_a_failure(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "clause_id long, prompt string").coalesce(1)
    got = sg.score_pieces(df, [sg.Scorer("one", lambda m, p: ["{}", "{}", "{}"])]).collect()
    assert all(r["answer"] is None and "3 answers to 1 prompts" in r["error"] for r in got)
    assert sg.score_pieces(df.limit(0), [sg.Scorer("one", lambda m, p: p)]).count() == 0
    assert [r["error"] for r in sg.score_pieces(df, []).collect()] == ["no scorer"] * 2


def test_word_risk_is_a_plain_mean():
    model = np.arange(sg.BUCKETS) - 2000
    for prompt in ("some words", "Some other words here", "x"):
        answer = sg.word_risk(model, [prompt])[0]
        words = re.findall(sg.WORD, prompt)
        if not words:
            assert isinstance(answer, ValueError)
            continue
        mean = sum(int(model[int(__import__("hashlib").md5(w.lower().encode()).hexdigest()[:3], 16)]) for w in words) // len(words)
        assert json.loads(answer)["riskSummary"] == f"mean weight {mean}"


def test_worst_piece_speaks_for_the_clause(spark):
    rows = [(1, 0, '{"riskLevel":"low"}', "a"), (1, 1, '{"riskLevel":"HIGH"}', "b"), (1, 2, '{"riskLevel":"high"}', "c"), (2, 0, None, None), (2, 1, '{"riskLevel":1}', "d"), (3, 0, None, None)]
    got = {r["clause_id"]: (r["answer"], r["model"]) for r in sg.worst_answers(spark.createDataFrame(rows, "clause_id long, piece_no long, answer string, model string")).collect()}
    assert got == {1: ('{"riskLevel":"HIGH"}', "b"), 2: ('{"riskLevel":1}', "d"), 3: (None, None)}


@pytest.mark.parametrize("limit", [1, 3])
def test_short_prompts(limit):
    f = sg.short_prompts(limit, lambda m, ps: [f"[{len(p)}]" for p in ps])
    out = f(None, ["", "a", "abc", "abcd"])
    assert [isinstance(x, Exception) for x in out] == [len(p) > limit for p in ["", "a", "abc", "abcd"]]
