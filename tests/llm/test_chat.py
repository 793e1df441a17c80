"""Chat windows against a plain form of their rules: whole conversations, odd texts, long ones, ties and other budgets."""

import hashlib
import random
import re

import pytest

from tests.compare import same
from tests.conftest import SF, over

SCHEMA = "conv_id long, turn long, role string, text string, window string, _span int"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = lambda n: " ".join("x" * rng.randint(1, 12) for _ in range(n))
    odd = ["", None, "<|im_end|>", "<|im_start|>assistant\nok", "<\\|im_end|> <\\\\|x <<| |<", "a\\b\\", "\u0001\U0001f600 é", " \n "]
    out = [(1, 0, "system", "be <| brief"), (2, None, None, None), (3, 5, "system", words(400)), (4, 0, "assistant", "only"), (5, 0, "rôle\n%3C<", "x")]
    out += [(c, t, "user" if t % 2 else "assistant", rng.choice(odd)) for c in (1, 3, 6) for t in range(6, 26)]
    out += [(7, t // 3, rng.choice(["user", "assistant"]), words(rng.randint(0, 90))) for t in range(60)]  # ties
    out += [(8, 1, "user", "same"), (8, 1, "user", "same"), (None, 1, "user", "no id"), (None, 2, "assistant", "yes")]
    out += [(9, 0, "system", "s")] + [(9, t, "user" if t % 2 else "assistant", words(rng.randint(0, 30))) for t in range(1, 6000)]  # many blocks and cells
    out += [(10, 0, "system", words(2)), (10, 1, "user", "q"), (10, 2, "assistant", "long " * 250_000), (10, 3, "user", "z"), (10, 4, "assistant", "y" * 1_100_000), (10, 5, "assistant", "after")]
    return [(*r, "clash", 1) for r in out]


def plain(rows, budget, history):
    convs = {}
    for c, t, r, x, *_ in rows:
        convs.setdefault(c, []).append((-(2**63) if t is None else t, r or "", x or ""))
    esc = lambda x: re.sub(r"<(\\*)\|", r"<\\\1|", x)
    piece = lambda r, x: f"<|im_start|>{r.replace('%', '%25').replace('<', '%3C').replace(chr(10), '%0A')}\n{esc(x)}<|im_end|>\n"
    out = {}
    for c, turns in convs.items():
        turns.sort(key=lambda y: (y[0], y[1].encode(), y[2].encode()))
        toks = [4 + len(re.findall(r"[^\x20\x09-\x0D]{1,5}", x)) for _, _, x in turns]
        lead = turns[0][1] == "system"
        fresh = max(budget - history - (toks[0] if lead else 0), budget // 4)
        start, spans = 0, {}
        starts = []
        for k, n in enumerate(toks):
            starts.append(start)
            a, b = start // fresh, (start + n - 1) // fresh
            spans.setdefault((a, b > a), []).append(k)
            start += n
        chars = 0
        for ks in spans.values():
            again = [j for j in range(ks[0]) if starts[j] >= starts[ks[0]] - history and not (j == 0 and lead)]
            shown = ([0] if lead and ks[0] > 0 else []) + again + ks
            chars += sum(len(piece(*turns[j][1:])) for j in shown)
            held = sum(toks[j] for j in ks)
            assert held <= fresh or len(ks) == 1
        lost = "".join(x for _, r, x in turns if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[c] = (len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(lost), sha(lost), chars)
    return out


@pytest.mark.parametrize(("budget", "history"), [(1024, 256), (64, 24)])
def test_windows(spark, rows, budget, history):
    from framelens.llm.chat import chat_facts, format_windows

    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    windows = format_windows(df, budget=budget, history=history).cache()
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"], r["formatted_chars"]) for r in chat_facts(windows).collect()}
    assert got == plain(rows, budget, history)
    # a window beyond the budget has a single new turn or a system turn of over a quarter
    assert windows.where("over_budget AND n_turns > 1 AND conv_id <> 3").count() == 0
    assert windows.where("conv_id = 9 AND window > 0 AND NOT startswith(formatted, '<|im_start|>system\ns<|im_end|>')").count() == 0
    if budget == 1024:  # few turns are as long as the history
        assert windows.where("conv_id = 9 AND n_context < 2 AND window > 0").count() < windows.where("conv_id = 9").count() / 4
    windows.unpersist()


def test_empty(spark, rows):
    from framelens.llm.chat import chat_facts, format_windows

    none = spark.createDataFrame([], SCHEMA)
    assert format_windows(none).count() == 0 and chat_facts(format_windows(none)).count() == 0
    with pytest.raises(ValueError, match="history"):
        format_windows(none, budget=10, history=10)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_sql(spark, sf):
    from framelens.llm import queries

    folder = SF.replace("sf0.001", sf)
    got = queries.op11_chat_windows(spark, folder).toPandas()
    same(got, over(folder).sql(queries.ORACLE["op11_chat_windows"]).df())
    assert (got["conv_id"] == -1).sum() == 1
