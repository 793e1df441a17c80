"""JSON arrays in noisy text, and repair of chunks over streams and attempts."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from framelens.operators import salvage


def found(t):
    return [salvage.canonical(t[a:b]) for a, b in salvage.array_spans(t)]


def test_arrays_in_prose():
    assert found('x [1, 2] y [{"a": "] [ \\" "}, [3]] [cut') == ["[1,2]", '[{"a":"] [ \\" "},[3]]']
    assert found("[broken [4]]") == ["[4]"] and found("none") == [] and found("") == [] and found("[]") == ["[]"]
    assert found('he said "see [1]" and 5" [ "x" ] end') == ["[1]", '["x"]']
    assert found('[see "x] then [1]') == ["[1]"]  # a quote that never closes hides nothing
    assert found('{"a": [1, {"b": []}], "c": [2,]}') == ['[1,{"b":[]}]']
    assert found('[01] [1.] [+1] [NaN] ["\t"] ["\\x"] [tru] [1 2] [,] {[}') == []
    assert found('["é\\u00e9\\ud800", 1e2, -0.5, true, null]') == ['["éé\\ud800",100.0,-0.5,true,null]']
    assert found('[{"b":1,"a":[{"z":1,"y":2}]}]') == ['[{"a":[{"y":2,"z":1}],"b":1}]']
    deep = "[" * (salvage.DEPTH + 5) + "]" * (salvage.DEPTH + 5)
    assert len(found(deep)) == 1 and len(found(deep)[0]) == 2 * salvage.DEPTH
    assert found(f"[{'9' * 5000}] [{'9' * 3000}]") == [f"[{'9' * 3000}]"]


def first_array(t, at):
    """The end of the JSON array that begins at a place, by trying every end."""
    for end in range(at + 1, len(t) + 1):
        if t[end - 1] == "]":
            try:
                json.loads(t[at:end], parse_constant=lambda x: 1 / 0)
                return end
            except (ValueError, ZeroDivisionError):
                pass
    return None


def test_against_trying_every_end():
    rng = random.Random(2)
    marks = ["[", "]", '"', "\\", "{", "}", ",", ":", "1", "a", "true", " ", "\n", "-", "0", ".5", '"a"', "[]", "e1", "\\u12", '"x":', "[1]"]
    for _ in range(20_000):
        t = "".join(rng.choice(marks) for _ in range(rng.randint(1, 16)))
        want, at = [], t.find("[")
        while at >= 0:
            end = first_array(t, at)
            if end:
                want.append((at, end))
            at = t.find("[", end or at + 1)
        assert salvage.array_spans(t) == want, t


@pytest.mark.parametrize("part", ["[", '["', '[{"a":', '"["', '["a",', "[1] ", '\\"[', "[[1],"])
def test_linear_time(part):
    began = time.time()
    salvage.array_spans(part * 100_000)
    salvage.array_spans(part * 100_000 + "]" * 100_000)
    assert time.time() - began < 20


def records(*ids, **more):
    return json.dumps([{"id": i, "note": "n", **more} for i in ids])


def rules(r):
    return {"schema_violation": F.forall(r, lambda x: x["note"].isNotNull())}


def test_repair(spark):
    want = spark.createDataFrame([(c, i) for c in range(1, 9) for i in ("W1", "W2")], "chunk int, id string")
    old = spark.createDataFrame([(1, records("W1", "W2")), (2, records("W1")), (3, "{}"), (4, None), (8, "[1, 2]")], "chunk int, json string")
    good, bad = records("W2", "W1"), records("W1", "X2", "W1")
    outs = [
        (1, 1, "response", "never looked at [1]"), (2, 1, "response", f"a {bad} b {good} c [9]"), (3, 1, "response", good), (3, 1, "stdout", "[]"), (3, 1, "stderr", records("W1", "W3")), (3, 1, "odd", "[7]"),
        (4, 1, "response", "[]"), (4, 2, "response", None), (4, 2, "stdout", "no array"), (4, 3, "stdout", good), (5, 4, "response", good), (6, 1, "response", "[]"), (6, 2, "response", "[]"), (6, 3, "response", records("W1", "W2").replace('"n"', "null")),
        (99, 1, "response", good),
    ]
    outs = spark.createDataFrame(outs, "chunk int, attempt int, stream string, text string")
    accepted, aside = salvage.repair(want, old, outs, rules, "id string, note string")
    got = {r["chunk"]: (r["attempt"], r["stream"], r["position"], r["tried"]) for r in accepted.collect()}
    assert got == {1: (0, "existing", 0, 1), 2: (1, "response", 1, 3), 3: (1, "response", 0, 4), 4: (3, "stdout", 0, 2), 5: (None, None, None, 0), 6: (None, None, None, 3), 7: (None, None, None, 0), 8: (None, None, None, 1)}
    codes = {(r["chunk"], r["attempt"], r["stream"], r["position"]): r["codes"] for r in aside.collect()}
    assert codes == {
        (2, 0, "existing", 0): ["wrong_count", "wrong_id_set"], (2, 1, "response", 0): ["wrong_count", "duplicate_id", "malformed_id", "wrong_id_set"], (3, 0, "existing", 0): ["not_array"],
        (3, 1, "stdout", 0): ["wrong_count", "wrong_id_set"], (3, 1, "stderr", 0): ["wrong_id_set"], (4, 1, "response", 0): ["wrong_count", "wrong_id_set"], (6, 1, "response", 0): ["wrong_count", "wrong_id_set"],
        (6, 2, "response", 0): ["wrong_count", "wrong_id_set"], (6, 3, "response", 0): ["schema_violation"], (8, 0, "existing", 0): ["invalid_record"],
    }
    with pytest.raises(ValueError, match="attempt"):
        salvage.repair(want, old, outs, rules, "id string", 0)
    none = salvage.repair(want.limit(0), old.limit(0), outs.limit(0), rules, "id string, note string")
    assert [x.count() for x in none] == [0, 0]


def test_record_codes(spark):
    from framelens.plans.records import RECORD, record_codes

    own = {"id": "W1", "categories": ["methods"], "domain": "reporting", "genre": "review", "about": True}
    cases = [
        (own, []), ({**own, "id": "Q1"}, ["pattern"]), ({**own, "domain": None}, ["then_domain"]), ({**own, "categories": []}, ["else_domain"]), ({**own, "more": 1}, ["extra"]),
        ({**own, "categories": ["sts", "sts"], "domain": None}, ["unique"]), ({k: v for k, v in own.items() if k != "about"}, ["required"]), ({**own, "genre": "poem"}, ["enum"]),
        ({**own, "categories": ["unscreenable", "sts"], "domain": None}, ["max_items"]), ({**own, "domain": "astrology"}, ["enum", "then_domain"]), ("{cut", ["invalid_json"]), ({}, ["required"]),
    ]
    df = spark.createDataFrame([(c if isinstance(c, str) else json.dumps(c),) for c, _ in cases], "json string")
    got = df.select(record_codes(F.col("json"), F.from_json("json", RECORD))).collect()
    assert [r[0] for r in got] == [codes for _, codes in cases]
