"""Pages whose head is never closed, and pages rows that are equal."""


def test_open_head():
    from framelens.llm import html_extract as H

    model = H.fit(H.labelled_pages())
    text = "This text is kept here, it is long enough to be read. And so is this sentence."
    want = model.extract(f"<html><head><title>x</title></head><body><article><p>{text}</p></article></body></html>")
    assert text in want
    for page in (f"<head><title>x</title><body><article><p>{text}</p></article>", f"<head><title>x</title><meta charset=utf-8><article><p>{text}</article>",
                 f"<html><head><script>a<b</script><noscript><style>p</style></noscript><body><article><p>{text}</p></article></body></html>"):
        assert model.extract(page) == want
    said = lambda page: "".join(t for _, t in H.parse(page)[1] if t != H.BREAK)
    assert said(f"<head><title>x</title>{text}") == text
    assert said("<head><template><div>no</div></template><noscript><img><p>no</p></noscript><title>no</title></head><p>yes") == "yes"


def test_equal_rows(spark):
    from framelens.llm import warc

    big = "<p>" + "x" * 200
    rows = [(1, "u", big)] * 3 + [(2, "v", big)] * 2 + [(3, "w", "tiny")] * 1300 + [(4, "z", None)] * 2 + [(5, "one", "é" * 80)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = warc.capture_facts(pages).collect()
    assert all(r["verified"] and r["has_request"] for r in got)
    count = lambda i: sum(r["page_id"] == i for r in got)
    assert [count(i) for i in range(1, 6)] == [3, 2, 1300, 2, 1] and len(got) == len(rows)
    assert {(r["page_id"], r["record_type"], r["refers_to"]) for r in got} == {(1, "response", None), (2, "revisit", 1), (3, "response", None), (4, "response", None), (5, "response", None)}
