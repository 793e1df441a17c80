"""The operators of the subpackage against brute force on small inputs with nulls, empty and long texts, ties,
repeated rows, clashing columns, and on empty tables."""

import hashlib
import random
import struct
import time
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF

WS = " \t\n\x0b\x0c\r"
SCHEMA = "doc_id long, text string, lang string, source string, n_lines string, h int, _id int"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    vocab = ["".join(rng.choice("abcdeéñß") for _ in range(rng.randint(1, 8))) for _ in range(400)]
    words = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    base = [words(120) for _ in range(6)]
    out = [(None, None), (1, None), (2, ""), (3, " \t\n "), (4, "x"), (5, "one two three four"), (6, "y" * 3000), (7, "Shared Line of text\nother"), (8, "  shared line OF text\t\nmore"), (8, "  shared line OF text\t\nmore"), (9, "short\nshort\nshort"), (10, "<|endoftext|> a <|endoftext|>")]
    for i in range(60):  # near copies: a few words changed
        w = base[i % 6].split()
        for _ in range(i % 4):
            w[rng.randrange(len(w))] = "changed"
        out.append((100 + i, " ".join(w)))
    out += [(200 + i, base[0]) for i in range(5)] + [(300 + i, words(rng.randint(1, 80)) + "\n" + words(9) + "\n" + base[i % 6][:60]) for i in range(30)]
    out.append((400, "\n".join(words(12) for _ in range(400)) + "\n" + "\n".join([words(12)] * 300)))
    return [(i, t, ["en", "fr", None][k % 3], ["a", "a", "b", None][k % 4], "clash", k, k) for k, (i, t) in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def table(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_line_dedup(docs, none, rows):
    from framelens.llm.line_dedup import dedup_lines

    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(WS).translate(fold)
    who = defaultdict(set)
    small = lambda i: -(2**63) if i is None else i
    for i, t, *_ in rows:
        for x in (t or "").split("\n"):
            who[key(x)].add(small(i))
    owner = {k: min(v) for k, v in who.items() if len(v) > 1 and len(k) >= 10}
    want = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if owner.get(key(x), small(i)) == small(i)]
        want.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    for batches, fanout in ((1, 2), (5, 2)):
        out = dedup_lines(docs, batches=batches, fanout=fanout)
        assert set(out.columns) == {*docs.columns, "n_lines", "n_dropped", "kept_text"}
        assert table(out.select("doc_id", "n_lines", "n_dropped", "kept_text")) == sorted(want, key=repr)
    assert dedup_lines(none).count() == 0


def test_ngram_join(docs, none, rows):
    from framelens.llm.ngram_join import near_duplicates, recall_at

    sets = [frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if (w := (t or "").lower().split()) else frozenset() for _, t, *_ in rows]
    seq = [tuple((t or "").lower().split()) for _, t, *_ in rows]
    n = len(rows)
    par = list(range(n))

    def root(x):
        while par[x] != x:
            x = par[x]
        return x

    links = Counter()
    for i in range(n):
        for j in range(n):
            inter = len(sets[i] & sets[j])
            if i != j and (seq[i] == seq[j] or sets[i] and 5 * inter >= 4 * (len(sets[i]) + len(sets[j]) - inter)):
                links[i] += 1
                a, b = root(i), root(j)
                par[max(a, b)] = min(a, b)
    low = defaultdict(list)
    for i in range(n):
        low[root(i)].append(-(2**63) if rows[i][0] is None else rows[i][0])
    name = lambda i: None if (m := min(low[root(i)])) == -(2**63) else m
    want = sorted(((rows[i][0], name(i), links[i]) for i in range(n)), key=repr)
    for block in (256, 4):
        assert table(near_duplicates(docs, block=block).select("doc_id", "class_id", "n_links")) == want
    assert near_duplicates(none).count() == 0
    assert recall_at(dict.fromkeys(range(24), 4), 0.8) > 0.9999
    assert near_duplicates(docs, threshold=Fraction(1, 1)).where("n_links > 0").count() > 0


def test_components(spark):
    from framelens.llm.graph import components

    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(50)] + [(7, 7)]
    got = {r["id"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{100 + i: 100 for i in range(1, 50)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_media(docs, none, rows):
    from framelens.llm import media

    got = table(media.payload_facts(docs).drop("n_chunks"))
    want = []
    for i, t, *_ in rows:
        b = (t or "").encode()
        p = b + bytes(-len(b) % 64 or (0 if b else 64))
        head, start = b"CDC1" + struct.pack("<QQ", len(p), len(ends := media.cuts(p))), 0
        for end in ends:
            head += hashlib.sha256(p[start:end]).digest() + struct.pack("<I", end - start)
            start = end
        nibbles = Counter(x >> 4 for x in p)
        feature = "h=" + ",".join(str(nibbles[k]) for k in range(16)) + f";e={sum(x * x for x in p)};c={sum(x != y for x, y in zip(p, p[1:]))}"
        want.append((i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(head) + len(p), hashlib.sha256(head + p).hexdigest(), feature))
    assert got == sorted(want, key=repr)
    assert max(len(media.cuts(media.pad((t or "").encode()))) for _, t, *_ in rows) > 1
    assert media.payload_facts(none).count() == 0


def test_media_tampering(spark, docs):
    from framelens.llm import media

    recipes, path = media.store_payloads(docs)
    assert media.read_payloads(recipes, path).count() > 0
    store = spark.read.schema(media.STORE).parquet(path)
    changes = {"data": F.overlay("data", F.unhex(F.lit("00")), F.lit(1)), "head": F.overlay("head", F.unhex(F.lit("07")), F.lit(5))}
    for col, changed in changes.items():
        bad = path + "-" + col
        store.withColumn(col, changed).write.parquet(bad)
        with pytest.raises(Exception, match="does not match its digest|does not fit its chunks"):
            media.read_payloads(recipes, bad).collect()
    with pytest.raises(ValueError):
        media.facts(media.container_head([(b"x" * 32, 64)]), [(hashlib.sha256(bytes(64)).digest(), bytes(64))])


def test_gear_cuts_follow_content():
    from framelens.llm import media

    data = bytes(random.Random(3).randrange(256) for _ in range(200_000))
    slow = [0] * 300
    for i in range(300):
        for age in range(min(32, i + 1)):
            slow[i] = (slow[i] + (int(media.GEAR[data[i - age]]) << age)) % 2**32
    assert media.rolling(data[:300]).tolist() == slow
    a, b = media.recipe(data), media.recipe(data[:50_000] + b"inserted" + data[50_000:])
    assert len({d for d, _ in a} & {d for d, _ in b}) >= len(a) - 3
    assert all(n <= media.MAX_CHUNK for _, n in a) and sum(n for _, n in a) == len(data)


def test_toxicity(spark, docs, none):
    from framelens.llm import toxicity as T

    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(300)]
    data, labels = [], []
    for i in range(600):
        w = [rng.choice(words) for _ in range(40)]
        bad = i % 4 == 0
        if bad:
            w[3:3] = [rng.choice(("wretched", "loathsome", "grubo" + rng.choice(words)[:3]))] * 2
        elif i % 60 == 1:
            w[3:3] = ["he", "wrote", '"wretched"', "once"]
        data.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    train, lab = spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(labels + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = T.fit(train, lab)
    assert {"wretched", "loathsome"} <= {*model.terms, *model.stems}
    got = {r["doc_id"]: r["predicted"] for r in T.score(train, model).collect()}
    right = sum(got[i] == y for i, y in labels)
    assert right >= 0.95 * len(labels)
    s = T.Scorer(model)
    assert s.score("you are a loathsme wreched person") > s.score("you are a person") and 0 <= s.score("") <= 1
    # misspelled and quoted forms against the term aimed at someone, in each language
    for aimed, report in (("you are a wretched person", 'she said the word "wretched" was wrong'), ("du bist ein wretched mensch", "er schrieb das wort „wretched“ in dem text"),
                          ("tu es un wretched homme", "il a écrit le mot « wretched » dans un texte"), ("eres un wretched hombre tú", "escribió la palabra «wretched» en un texto")):
        assert s.score(aimed) > s.score(report)
        slip = aimed.replace("wretched", "wretchd")
        assert s.score(aimed) >= s.score(slip) > s.score(aimed.replace("wretched", "kindly"))
    again = T.fit(train.repartition(7), lab.repartition(5))
    assert (again.terms, again.stems, again.exceptions, again.report, again.address) == (model.terms, model.stems, model.exceptions, model.report, model.address)
    assert np.allclose(again.weights, model.weights)
    out = T.score(docs.withColumn("score", F.lit("clash")), model)
    assert out.count() == docs.count() and out.where("score IS NULL").count() == 0
    assert T.score(none, T.fit(none, lab)).count() == 0


def test_automaton_against_edit_distance():
    from framelens.llm.toxicity import Automaton, allowed_edits

    def dist(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        return row[-1]

    rng = random.Random(2)
    terms = {"".join(rng.choice("abc") for _ in range(rng.randint(3, 10))) for _ in range(12)}
    auto = Automaton(dict.fromkeys(terms, 1.0), {"cabba": 2.0})
    for _ in range(3000):
        w = "".join(rng.choice("abc") for _ in range(rng.randint(1, 12)))
        ok = [d for t in terms if (d := dist(w, t)) <= allowed_edits(t)]
        want = 1 if 0 in ok else 3 if w.startswith("cabba") else 2 if ok else 0
        assert auto.match(w)[0] == want, w


def test_warc(spark):
    from framelens.llm import warc

    big = "<p>WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n" + "x" * 200
    data = [(3, "http://a/1", big), (1, "http://a/2", big), (2, None, None), (4, "u v", "tiny"), (5, "w", "tiny"), (9, "http://a/9", big), (9, "http://a/9b", "é" * 80)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").repartition(2)
    got = {(r["page_id"], r["payload_digest"][:6]): r for r in warc.capture_facts(pages).collect()}
    assert len(got) == 7 and all(r["verified"] and r["has_request"] for r in got.values())
    for i, _, h in data:
        b = (h or "").encode()
        r = got[i, hashlib.sha256(b).hexdigest()[:6]]
        later = h == big and i != 1
        assert (r["payload_bytes"], r["record_type"], r["refers_to"]) == (len(b), "revisit" if later else "response", 1 if later else None)
    # exact repeats, a long payload in a file of its own, columns of clashing names
    long = "ü" * 200_000
    again = spark.createDataFrame([(i, u, h, k, "x") for k, (i, u, h) in enumerate([*data, *data, data[0], (20, "l", long), (21, "m", long)])], "page_id long, url string, html string, _id int, type string")
    got = warc.capture_facts(again.repartition(3)).collect()
    assert len(got) == 2 * len(data) + 3 and all(r["verified"] and r["has_request"] for r in got)
    assert sorted(r["refers_to"] for r in got if r["record_type"] == "revisit") == [1] * 5 + [20]
    assert warc.capture_facts(pages.limit(0)).count() == 0
    with pytest.raises(ValueError):
        list(warc.parse_file(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort\r\n\r\n"))


def test_bpe(docs, none, rows):
    import tiktoken

    from framelens.llm import bpe

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = bpe.load_ranks(path)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted(((i, enc.encode_ordinary(t or ""), (t or "").encode()) for i, t, *_ in rows), key=repr)
    got = sorted(((r["doc_id"], list(r["ids"]), bytes(r["decoded"])) for r in bpe.encode_decode(docs, path, P.PATTERN).collect()), key=repr)
    assert got == want
    assert bpe.encode_decode(none, path, P.PATTERN, digests_only=True).count() == 0
    # long words by the fold and by the heap, against the library's own merges of one piece
    words = [b"a" * 150, "éñ".encode() * 40, b"abcabcabd" * 15, "".join(random.Random(5).choice("abcdeéñ") for _ in range(120)).encode()]
    few = docs.sparkSession.createDataFrame([(k, w.decode()) for k, w in enumerate(words)], "doc_id long, text string")
    one = [enc._encode_single_piece(w) for w in words]
    assert [bpe.heap_merge(w, ranks) for w in words] == one
    assert bpe.heap_merge(b"abcabcabd" * 800, ranks) == enc._encode_single_piece(b"abcabcabd" * 800)
    for long_word in (4, 512):
        got = {r["doc_id"]: list(r["ids"]) for r in bpe.encode_decode(few, path, P.PATTERN, long_word=long_word).collect()}
        assert [got[k] for k in range(len(words))] == one
    before = dict(docs.sparkSession.conf.getAll)
    bpe.encode_decode(docs, path, P.PATTERN).count()
    assert before == dict(docs.sparkSession.conf.getAll)


def test_bpe_classes(spark):
    """Every code point is of the library's class; those whose class differs from the JVM's, and common ones, are split
    before, after and between letters, digits, marks and spaces as the library does."""
    import tiktoken

    from framelens.llm import bpe

    path = P.path("byte_bpe_multi_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    every, other = set(map(ord, bpe._every())), set(range(0x2100)) | set(range(0x3000, 0x3100))
    for name in (r"\p{L}", r"\p{N}"):
        here, there = bpe.java_class(spark, name), bpe.library_class(name)
        inside, outside = bpe._member(name, there - here, here - there)
        assert bpe.java_class(spark, inside) == there and bpe.java_class(spark, outside) == every - there
        other |= {c + k for c in here ^ there for k in (-1, 0, 1)}
    points = sorted(other & every)
    rows = [(k, "".join(f"a{chr(c)}1{chr(c)}{chr(c)} {chr(c)}.{chr(c)} \n" for c in points[k : k + 256])) for k in range(0, len(points), 256)]
    got = {r["doc_id"]: list(r["ids"]) for r in bpe.encode_decode(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), path, P.PATTERN).collect()}
    assert all(got[k] == enc.encode_ordinary(t) for k, t in rows)


def test_token_counts(docs, none, rows):
    from tokenizers import Tokenizer

    from framelens.llm.token_counts import token_counts

    path = P.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    want = [(i, len((t or "").encode()), n := len(tok.encode(t or "", add_special_tokens=False)), n > 512) for i, t, *_ in rows]
    assert table(token_counts(docs, path)) == sorted(want, key=repr)
    assert table(token_counts(docs, path, cut=False)) == sorted(want, key=repr)
    assert token_counts(none, path).count() == 0


def test_html():
    from framelens.llm import html_extract as H

    model = H.fit(H.labelled_pages())
    held = H.labelled_pages(80, 77)
    right = 0
    for page in held:
        nodes, texts = H.parse(page)
        want = " ".join("".join(" " if t == H.BREAK else t for i, t in texts if t == H.BREAK or nodes[i].label == 1).split())
        right += model.extract(page) == want
    assert right >= 0.8 * len(held)
    assert model.extract(None) == "" == model.extract("")
    assert "kept" in model.extract("<article><p>This text is kept here, it is long enough.<p>And so is this.")
    began = time.time()
    for deep in ("<div>" * 60_000, "<b>" * 60_000, "<p><button>" + "<div>" * 60_000, "<ul><li>" * 30_000, "<span><p>" * 30_000, "<table><tr><td>" * 20_000):
        model.extract(deep + "deep")
        model.extract(deep + "deep" + deep.replace("<", "</"))
    assert time.time() - began < 60
    model.extract("<a <b> '\"<!-- open")


def test_html_on_spark(spark):
    import html
    import re

    from framelens.llm import html_extract as H

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    # by hand: these pages hold one article element and nothing else in it
    want = {}
    for r in pages.collect():
        inner = re.search("<article>(.*?)</article>", r["html"], re.S).group(1)
        want[r["page_id"]] = " ".join(html.unescape(re.sub("<[^>]*>", lambda m: "" if re.match("</?[ab][ >]", m.group()) else " ", inner)).split())
    got = {r["page_id"]: r for r in H.main_text(pages).collect()}
    same = sum(got[i]["text"] == t for i, t in want.items())
    assert same >= 0.98 * len(want) and all(r["n_chars"] == len(r["text"]) for r in got.values())
    odd = [(None, "u", "<article><p>Some text stands here, it is quite long.</p></article>", "c"), (1, None, None, "c"), (1, None, None, "c"), (2, "", "", "c"), (3, "v", "<div>" * 5000, "c")]
    out = H.main_text(spark.createDataFrame(odd, "page_id long, url string, html string, text string"))
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    assert table(out)[:4] == sorted([(1, None, "", 0), (1, None, "", 0), (2, "", "", 0), (3, "v", "", 0)], key=repr)
    assert [r["text"] for r in out.where("page_id IS NULL").collect()] == ["Some text stands here, it is quite long."]
    assert H.main_text(pages.limit(0)).count() == 0


def test_marginals_against_enumeration():
    import itertools

    from framelens.llm import html_extract as H

    model = H.fit(H.labelled_pages(60))
    nodes, texts = H.parse("<body><nav><a href=x>home</a></nav><div><p>Some words here.</p><aside>other</aside></div></body>")
    seen = H.look(nodes, texts)
    total, hit = 0.0, np.zeros(len(nodes))
    for state in itertools.product((0, 1), repeat=len(nodes)):
        p = model.prior[state[0]]
        for i, x in enumerate(nodes):
            p *= np.exp(sum((model.emit.get(f) or model.unseen[f[0]])[state[i]] for f in seen[i]))
            if i:
                p *= model.turn.get(H.kind(x.tag), model.turn["other"])[state[x.parent]][state[i]]
        total += p
        hit += p * np.array(state)
    assert np.allclose(model.marginals(nodes, seen), hit / total)


def test_quality(spark, docs, none, rows):
    import re

    from framelens.llm import quality_rules as Q

    lab = spark.createDataFrame([(i, 1) for i, *_ in rows] + [(None, None)], "doc_id long, quality int")
    got = table(Q.quality_verdicts(docs, lab).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))
    want = []
    for i, t, *_ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        tri = Counter(zip(w, w[1:], w[2:]))
        cover = {j for k in range(len(w) - 2) if tri[w[k], w[k + 1], w[k + 2]] > 1 for j in (k, k + 1, k + 2)}
        lines = [x for x in t.split("\n") if x.strip(WS)]
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover), len(w) < 50 or 100 * len(cover) > 50 * len(w)))
    assert got == sorted(want, key=repr)
    assert Q.quality_verdicts(none, lab).count() == 0
    assert Q.quality_verdicts(docs, lab.limit(0)).where("kept = base_failed").count() == 0


def test_binomial_tail(spark):
    import math

    from framelens.llm.quality_rules import binomial_at_most

    cases = [(0, 10), (3, 1000), (40, 5000), (1, 1), (200, 60_000)]
    df = spark.createDataFrame(cases, "k long, n long")
    for r in df.select("k", "n", binomial_at_most(F.col("k"), F.col("n"), 0.01).alias("p")).collect():
        k, n = r["k"], r["n"]
        exact = 1.0 if k >= n * 0.01 else math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(0.01) + (n - i) * math.log1p(-0.01)) for i in range(k + 1))
        assert r["p"] == pytest.approx(exact, rel=1e-6)


def test_names_of_texts(spark):
    """Texts whose names meet get others."""
    from framelens.llm import ngram_join as N

    texts = spark.range(50).select(F.unhex(F.md5(F.col("id").cast("string"))).alias("_key"))
    assert N._named(texts).select("id").distinct().count() == 50


def test_mixing(docs, none, rows):
    from framelens.llm import mixing as M

    got = M.mix(docs, block=4, period=16).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in got) == sorted((i is None, i) for i, *_ in rows)
    assert len({(r["slot"], r["place"]) for r in got}) == len(rows)
    assert M.mix(none).count() == 0
