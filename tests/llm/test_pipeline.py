"""The pipeline on the smallest tables against its operators' brute-force rules."""

import hashlib

import public_tokenizers as P
import pytest

from tests.conftest import SF


def test_pipeline(spark):
    import tiktoken

    import corpus_pipeline as c
    from framelens.llm import bpe
    from framelens.llm.common import written

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [docs]
    for name, stage in c.STAGES:
        kept.append(written(stage(spark, kept[-1], SF), name))
    assert all(d.columns == docs.columns for d in kept[:-1])
    ids = [{r["doc_id"] for r in d.select("doc_id").collect()} for d in kept]
    assert ids[0] >= ids[1] == ids[2] >= ids[3] == ids[4] == ids[5]
    # near copies: of two kept documents none is at 0.8 or above
    sets = {r["doc_id"]: frozenset(zip(*[r["text"].lower().split()[k:] for k in range(5)])) for r in kept[3].collect()}
    have = [s for s in sets.values() if s]
    assert all(5 * len(a & b) < 4 * len(a | b) for i, a in enumerate(have) for b in have[:i])
    # line dedup: no key of ten characters in two documents
    seen: dict = {}
    for r in kept[2].collect():
        assert r["n_chars"] == len(r["text"])
        for line in set(r["text"].split("\n")):
            k = line.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
            assert len(k) < 10 or seen.setdefault(k, r["doc_id"]) == r["doc_id"]
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path(c.TOKENIZER)), special_tokens={})
    texts = {r["doc_id"]: r["text"] for r in kept[4].collect()}
    for r in kept[5].collect():
        assert r["n_tokens"] == len(enc.encode_ordinary(texts[r["doc_id"]]))
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_rows_of_one_id(spark):
    """Repeated and null ids, clashing columns: what goes is a copy, what stays is whole."""
    import corpus_pipeline as c

    words = [" ".join(f"{x}{(k * k + i) % 97}" for i in range(80)) for k, x in enumerate("tuvw")]
    t, u, v, w = words
    rows = [(3, t), (8, t), (8, u), (8, u), (9, t + " more"), (None, v), (None, w), (5, v), (6, None), (7, ""), (7, "")]
    docs = spark.createDataFrame([(i, x, "en", "a", 0, k, "s") for k, (i, x) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, _id int, score string")
    got = c.drop_near_copies(spark, docs, SF)
    assert got.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr) == sorted([(3, t), (8, u), (None, v), (None, w), (6, None)], key=repr)
    for stage in (c.drop_toxic, c.mix_sources, c.drop_repeated_lines):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        kept = sorted(((r["doc_id"], r["_id"], r["score"]) for r in out.collect()), key=repr)
        assert kept == sorted(((i, k, "s") for k, (i, _) in enumerate(rows)), key=repr)


def test_empty(spark):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in c.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


@pytest.mark.parametrize("name", ["op2_line_dedup", "op5_warc"])
def test_oracle(spark, duck, name):
    from framelens.llm import queries
    from tests.compare import same

    same(queries.queries()[name](spark, SF).toPandas(), duck.sql(queries.oracle_sql()[name]).df())


def test_nothing_is_left_in_the_shared_folder(spark):
    import corpus_pipeline as c
    from framelens.llm.common import paths

    before = set(paths())
    out = c.run(spark, SF)
    left = [p for p in paths() if p not in before]
    assert len(left) == 1 and "stage-byte_bpe" in left[0]
    assert out.count() > 0 and out.where("n_tokens IS NULL").count() == 0


def test_small_batches(spark):
    """The byte-pair step brings down what Spark gathers for Python at once; a session's own setting stays."""
    import public_tokenizers
    import pyarrow as pa
    from framelens.llm import bpe, common

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    key = common.ARROW_BATCH[0]
    before = spark.conf.get(key, "1b")
    try:
        spark.conf.unset(key)
        docs = spark.range(0, 24, 1, 1).selectExpr("id as doc_id", "repeat('x', 1 << 20) as text")
        bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
        got = [r["n"] for r in docs.mapInArrow(sizes, "n long").collect()]
        assert len(got) > 2 and max(got) <= 10 << 20
        spark.conf.set(key, "1m")
        common.small_batches(spark)
        assert spark.conf.get(key) == "1m"
    finally:
        spark.conf.unset(key)
        if before != "1b":
            spark.conf.set(key, before)


def test_ranks_are_not_in_the_plan(spark):
    """The driver keeps the text of every plan that ran: no vocabulary may stand in it."""
    from framelens.llm import bpe

    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    out = bpe.encode_decode(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, digests_only=True)
    assert len(out._jdf.queryExecution().executedPlan().toString()) < 50_000


def test_classes_are_asked_once(spark, monkeypatch):
    """The pattern's classes take jobs over every code point: once an application, not once a query."""
    from framelens.llm import bpe

    want = bpe.java_pattern(spark, P.PATTERN)
    monkeypatch.setattr(bpe, "java_class", None)
    assert bpe.java_pattern(spark, P.PATTERN) == want


def test_ids_of_the_fold_have_room(spark, tmp_path):
    """Ids share a long with ranks and places: a rank that has no room is refused."""
    import base64

    from framelens.llm import bpe

    path = tmp_path / "ranks"
    path.write_text("".join(f"{base64.b64encode(bytes([i])).decode()} {i + bpe.NONE - 255}\n" for i in range(256)))
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    with pytest.raises(ValueError, match="ranks"):
        bpe.encode_decode(docs, str(path), P.PATTERN)
    path.write_text("".join(f"{base64.b64encode(bytes([i])).decode()} {i + bpe.NONE - 256}\n" for i in range(256)))
    assert bpe.encode_decode(docs.limit(0), str(path), P.PATTERN).schema.names == ["doc_id", "n_tokens", "ids", "decoded"]
