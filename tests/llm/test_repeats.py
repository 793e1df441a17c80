"""Pages that repeat an id under other urls, and files of tokenizers whose texts may not be cut."""

import json

import duckdb
import public_tokenizers as P
import pytest

from tests.compare import same


def test_repeated_page_ids(spark):
    from framelens.llm import queries, warc

    body = "<p>" + "x" * 200
    data = [(1, "u", body), (1, "v", body), (2, "w", body), (2, "w", body), (3, "z", "short"), (4, "z", "short"), (5, "b", "y" * 120), (5, "a", "y" * 120), (6, "c", "y" * 120), (6, "d", None)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string")
    got = warc.capture_facts(pages.repartition(3)).drop("verified", "has_request").toPandas()
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", data)
    same(got, con.sql(queries.ORACLE["op5_warc"]).df())
    assert sorted(got[got.record_type == "revisit"].refers_to) == [1, 1, 5]


def test_where_texts_may_be_cut(spark, tmp_path):
    from tokenizers import Tokenizer

    from framelens.llm.token_counts import cuts_at_spaces, token_counts

    own = json.load(open(P.path("byte_bpe_50k.json")))
    assert cuts_at_spaces(own) and not cuts_at_spaces(json.load(open(P.path("word_bpe_49k.json"))))
    split = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": P.PATTERN}, "behavior": "Isolated", "invert": False}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
    assert cuts_at_spaces(own | {"pre_tokenizer": split}) and not cuts_at_spaces(own | {"pre_tokenizer": split["pretokenizers"][1]})
    for other in ({"pre_tokenizer": own["pre_tokenizer"] | {"add_prefix_space": True}}, {"normalizer": {"type": "NFC"}}, {"added_tokens": [own["added_tokens"][0] | {"lstrip": True}]}, {"pre_tokenizer": None}):
        assert not cuts_at_spaces(own | other)
    # a tokenizer without a pre-tokenizer merges across spaces: texts of its file are counted whole
    path = str(tmp_path / "whole.json")
    json.dump(own | {"pre_tokenizer": None}, open(path, "w"))
    texts = [(1, "Ġthe end of Ġa"), (2, "x y z " * 50), (3, None), (4, "é" * 1_100_000 + " a b")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    for p in (path, P.path("byte_bpe_50k.json")):
        tok = Tokenizer.from_file(p)
        want = [(i, len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False))) for i, t in texts[: 3 if p == path else 4]]
        got = sorted((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in token_counts(df.where(f"doc_id <= {len(want)}"), p).collect())
        assert got == want
    with pytest.raises(ValueError, match="cut"):
        token_counts(df, path, cut=True)
