"""Toxic documents that the fit never saw, as they are, with every matched term misspelled, and with every match quoted."""

import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF


def slips(scorer, text, rng):
    from framelens.llm.toxicity import WORD

    def one(m):
        w = m.group()
        if len(w) < 5 or not scorer.kind(w.lower())[0]:
            return w
        at = rng.randrange(1, len(w))
        return w[:at] + rng.choice([c for c in "abdeghiklmnoprstuz" if c != w[at].lower()]) + w[at + 1 :]

    return WORD.sub(one, text)


@pytest.mark.parametrize(("sf", "least", "least_slipped"), [("sf0.01", 0.6, 0.5), ("sf0.1", 0.9, 0.83)])
def test_held_out_documents(spark, sf, least, least_slipped):
    from framelens.llm import toxicity as T

    folder = SF.replace("sf0.001", sf)
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang"), spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic")
    model = T.fit(docs.select("doc_id", "text"), labels)
    held = docs.join(labels, "doc_id").where(T.held_out() & F.col("text").isNotNull()).toPandas()
    s, rng = T.Scorer(model), random.Random(5)
    called = lambda texts: [s.score(t) >= T.THRESHOLD for t in texts]
    toxic, clean = held[held.toxic == 1], held[held.toxic == 0]
    found = called(toxic.text)
    wrong = called(clean.text)
    slipped = called([slips(s, t, rng) for t in toxic.text])
    print(sf, "weights", [round(w, 2) for w in model.weights], "found", sum(found), "slipped", sum(slipped), "of", len(toxic), "wrong", sum(wrong), "of", len(clean))
    for lang, part in toxic.assign(found=found, slipped=slipped).groupby("lang"):
        print(lang, len(part), part.found.sum(), part.slipped.sum())
    assert sum(found) >= least * len(toxic) and sum(wrong) <= 0.01 * len(clean) + 1
    assert sum(slipped) >= least_slipped * len(toxic)
