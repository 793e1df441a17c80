"""Fill in the middle: against a plain form of the contract, the registered SQL, and odd texts."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tests.compare import same
from tests.conftest import SF

ODD = [
    (None, "a b"), (1, None), (2, ""), (3, " \t\r\n "), (4, "  lead and trail \x0b"), (5, "has <P> in it"), (6, "<S"), (7, "a<M>"), (8, "< P><"), (9, "x" * 1_200_000),
    (10, " ".join(["wörd"] * 200_000)), (11, "\n".join(["q z"] * 30)), (11, "\n".join(["q z"] * 30)), (12, "non break \U0001f600 smile line"), (13, "<P <S <M >"), (14, "\x00 nul \x1c fs"),
]


def plain(i, text):
    t = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", t)
    d = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    if not t or any(s in t for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return (i, len(units), "plain", None, None, sha(t), sha(t))
    x, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form, out = ("spm", f"<S>{s}<P>{x}<M>{m}") if h[3] % 100 < 80 else ("psm", f"<P>{x}<S>{s}<M>{m}")
    return (i, len(units), form, len(x), len(m), sha(out), sha(t))


def test_odd_texts_under_many_ids(spark):
    from framelens.llm.fill_middle import fim_facts

    some = [(None if i is None else i + 100 * k, t) for k in range(12) for i, t in ODD if k < 2 or len(t or "") < 1000]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in some], "doc_id long, text string, form string, _units int")
    got = [tuple(r) for r in fim_facts(df).collect()]
    assert sorted(got, key=repr) == sorted((plain(i, t) for i, t in some), key=repr)
    assert {r[2] for r in got} == {"plain", "spm", "psm"}
    assert fim_facts(df.limit(0)).count() == 0


def test_read_back(spark):
    from framelens.llm.fill_middle import fill_in_middle, restored

    some = [(k, f" <{k} P> a\n<b {'<' * (k % 5)} c") for k in range(60)]
    out = fill_in_middle(spark.createDataFrame(some, "doc_id long, text string"), rate=100, spm=50)
    assert {r["form"] for r in out.collect()} == {"psm", "spm"}
    assert dict(out.select("doc_id", restored(F.col("output"), F.col("form"))).collect()) == dict(some)
    other = F.when(F.col("form") == "psm", "spm").otherwise("psm")
    assert out.where(restored(F.col("output"), other).isNotNull()).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_sql(spark, sf):
    from framelens.llm import queries
    from tests.conftest import over

    folder = SF.replace("sf0.001", sf)
    same(queries.op12_fill_in_middle(spark, folder).toPandas(), over(folder).sql(queries.ORACLE["op12_fill_in_middle"]).df())
