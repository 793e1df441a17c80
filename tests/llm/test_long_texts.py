"""Each operator on texts of a megabyte and more: many lines, one line, one word, white space only."""

import hashlib
import random

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(9)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(5000)]
    words = [rng.choice(vocab) for _ in range(180_000)]
    line = " ".join(words)
    near = words.copy()
    for _ in range(300):
        near[rng.randrange(len(near))] = "other"
    lines = "\n".join(" ".join(words[i : i + 12]) for i in range(0, len(words), 12))
    return {1: line, 2: " ".join(near), 3: lines, 4: "x" * 1_100_000, 5: " \t" * 550_000, 6: "é\U0001f600 " * 300_000, 7: "short text"}


@pytest.fixture(scope="module")
def docs(spark, texts):
    assert sum(len(t.encode()) >= 1 << 20 for t in texts.values()) >= 5
    return spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("lang", F.lit("en")).withColumn("source", F.lit("a")).repartition(3)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_near_duplicates(docs):
    from framelens.llm.ngram_join import near_duplicates

    got = by_id(near_duplicates(docs.select("doc_id", "text")))
    names = {i: [v for k, v in r.asDict().items() if "class" in k][0] for i, r in got.items()}
    assert names[1] == names[2] == names[3] and len({names[i] for i in (1, 4, 5, 6, 7)}) == 5


def test_lines(docs, texts):
    from framelens.llm.line_dedup import dedup_lines

    got = by_id(dedup_lines(docs.select("doc_id", "text")))
    assert all(got[i]["n_dropped"] == 0 and got[i]["kept_text"] == t for i, t in texts.items())
    assert got[3]["n_lines"] == 15_000


def test_media(docs, texts):
    from framelens.llm.media import payload_facts

    got = by_id(payload_facts(docs.select("doc_id", "text")))
    for i, t in texts.items():
        b = t.encode()
        padded = b + bytes(-len(b) % 64)
        assert (got[i]["n_bytes"], got[i]["payload_bytes"], got[i]["payload_sha256"]) == (len(b), len(padded), hashlib.sha256(padded).hexdigest())


def test_scores(spark, docs):
    from framelens.llm import toxicity as T

    model = T.Model({"loathsome": 1.0}, {}, weights=[-3.0, 4.0, 0.0, 0.0, -1.0, 0.5, 0.5])
    got = by_id(T.score(docs.unionByName(docs.where("doc_id = 1").withColumns({"doc_id": F.lit(8).cast("long"), "text": F.concat("text", F.lit(" you loathsome loathsme loathsome"))})), model))
    assert got[8]["predicted"] == 1 and sum(r["predicted"] for r in got.values()) == 1


def test_archives(spark, texts):
    from framelens.llm.warc import capture_facts

    pages = spark.createDataFrame([(i, "u", t) for i, t in texts.items()] + [(9, "v", texts[1])], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in capture_facts(pages).collect()}
    assert all(got[i]["payload_digest"] == hashlib.sha256(t.encode()).hexdigest() and got[i]["verified"] for i, t in texts.items()) and got[9]["refers_to"] == 1


def test_tokens(docs, texts):
    import tiktoken
    from tokenizers import Tokenizer

    from framelens.llm import bpe
    from framelens.llm.token_counts import token_counts

    some = [1, 3, 5, 6, 7]  # libraries take very long for a word of a megabyte
    path = P.path("byte_bpe_multi_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    got = by_id(bpe.encode_decode(docs.where(F.col("doc_id").isin(some)), path, P.PATTERN, digests_only=True))
    # the library can't encode a megabyte of white space; that text is only read back
    assert {i: r["n_tokens"] for i, r in got.items() if i != 5} == {i: len(enc.encode_ordinary(texts[i])) for i in some if i != 5}
    assert all(got[i]["decoded_sha256"] == hashlib.sha256(texts[i].encode()).hexdigest() for i in some)
    path = P.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    got = by_id(token_counts(docs.where(F.col("doc_id").isin(some)), path))
    assert {i: r["n_tokens"] for i, r in got.items()} == {i: len(tok.encode(texts[i], add_special_tokens=False)) for i in some}


def test_pages(spark, texts):
    from framelens.llm.html_extract import main_text

    body = "".join(f"<p>{texts[3][k : k + 400]}</p>" for k in range(0, 1_000_000, 400))
    page = f"<html><body><nav><a href=x>menu</a></nav><article>{body}</article><footer>foot</footer></body></html>"
    got = main_text(spark.createDataFrame([(1, "u", page), (2, "u", texts[4])], "page_id long, url string, html string")).collect()
    whole = {r["page_id"]: r for r in got}[1]
    assert whole["n_chars"] == len(whole["text"]) > 900_000


def test_rules(docs, spark):
    from framelens.llm.quality_rules import quality_verdicts

    got = by_id(quality_verdicts(docs, spark.createDataFrame([], "doc_id long, quality int")))
    assert [got[i]["n_words"] for i in (1, 3, 4, 5, 6)] == [180_000, 180_000, 1, 0, 300_000]
    assert [got[i]["base_failed"] for i in (1, 3, 4, 5, 6)] == [False, False, True, True, True]


def test_collocations(docs):
    from framelens.llm.collocations import collocations

    got = collocations(docs, least=1000).collect()
    # each longer one occurs once less, so none covers another
    assert {r["phrase"]: r["a"] for r in got} == {" ".join(["é\U0001f600"] * k): 300_001 - k for k in (2, 3, 4, 5)}
