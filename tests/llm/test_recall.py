"""Links and classes of the n-gram join on a whole test table against all pairs, found by shared windows."""

from collections import Counter, defaultdict

from tests.conftest import SF


def all_links(rows):
    """Links and class of each row, by exact similarity of 0.8 or more."""
    seqs = [tuple((r["text"] or "").lower().split()) for r in rows]
    first, where = {}, defaultdict(list)
    for k, s in enumerate(seqs):
        first.setdefault(s, k)
    copies = Counter(seqs)
    sets = {k: {s[j : j + 5] for j in range(max(1, len(s) - 4))} if s else set() for s, k in first.items()}
    links, root = Counter(), {k: k for k in sets}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for k, own in sets.items():
        shared = Counter(j for w in own for j in where[w])
        for j, both in shared.items():
            if 5 * both >= 4 * (len(own) + len(sets[j]) - both):
                links[k] += copies[seqs[j]]
                links[j] += copies[seqs[k]]
                root[max(top(k), top(j))] = min(top(k), top(j))
        for w in own:
            where[w].append(k)
    low = defaultdict(list)
    for s, r in zip(seqs, rows, strict=True):
        low[top(first[s])].append(r["doc_id"])
    return {r["doc_id"]: (min(low[top(first[s])]), copies[s] - 1 + links[first[s]]) for s, r in zip(seqs, rows, strict=True)}


def found_and_true(spark, sf, **how):
    from framelens.llm.ngram_join import near_duplicates

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in near_duplicates(docs, **how).collect()}
    return got, all_links(docs.collect())


def test_whole_table(spark):
    got, want = found_and_true(spark, SF.replace("sf0.001", "sf0.01"), block=3)
    assert sum(n for _, n in want.values()) > 0 and got == want
