"""Text queries over whole documents against brute force, on a fixture with texts past the old cuts."""

from collections import defaultdict

import pytest

from framelens.plans import texts


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    long = " ".join(f"w{i % 170}" for i in range(700))
    rows = [(1, long, "en"), (2, "  der \n Hund\tder\n\n" + long, "de"), (3, "un deux un", "fr"), (4, "one", "en")]
    d = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame([(i, t, lang, "s", len(t)) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    return d, {i: t for i, t, _ in rows}


def test_invert_index_whole(spark, corpus):
    d, rows = corpus
    want = set()
    for i, t in rows.items():
        at = defaultdict(list)
        for p, w in enumerate(t.split()):
            at[w].append(p)
        want |= {(i, w, len(ps), ",".join(map(str, ps))) for w, ps in at.items()}
    got = [(r["doc_id"], r["token"], r["n"], r["positions"]) for r in texts.invert_index(spark, d).collect()]
    assert len(got) == len(want) and set(got) == want


def test_deinvert_roundtrip_whole(spark, corpus):
    d, rows = corpus
    got = [(r["doc_id"], r["text"]) for r in texts.deinvert_roundtrip(spark, d).collect()]
    assert sorted(got) == [(i, " ".join(t.split())) for i, t in sorted(rows.items())]


def test_top_values_long_texts(spark, corpus):
    from collections import Counter

    d, rows = corpus
    count = Counter()
    for t in rows.values():
        count.update(v for x in t.replace("\n", ";").replace(".", ";").split(";") if (v := x.strip(" ").removeprefix("+")))
    got = [(r["value"], r["n"]) for r in texts.top_values(spark, d).collect()]
    assert sorted(got) == sorted(count.items()) and any(len(v) > 400 for v, _ in got)
