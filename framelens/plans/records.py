"""Decision records, validation of returned records, versions, inventories, nested routes and reports of arms.

What the tables lack (returned JSON records, a second genre, record types) follows from digits of an md5 of the id."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelens.functions import text as T
from framelens.operators import contracts as C
from framelens.operators import salvage
from framelens.plans import agreement
from framelens.session import table

GENRES = ["review", "empirical", "editorial", "other"]


def _digit(key: str, seed: str, at: int = 1):
    """A digit of the md5 of an id, 0 to 15."""
    return F.conv(F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(seed))), at, 1), 16, 10).cast("int")


def _sql_digit(key: str, seed: str, at: int = 1) -> str:
    return f"CAST('0x' || substr(md5(CAST({key} AS VARCHAR) || '{seed}'), {at}, 1) AS INTEGER)"


# -- decision records

HEADS = ["c0", "c1", "c2", "sys", "topic"]
CUTS = {"a": 0.1, "b": 0.12}
DOMAINS, KINDS = ["none", "methods", "reporting"], ["review", "empirical", "other"]


AXES = {"domain": (DOMAINS, 11), "kind": (KINDS, 17)}


def record(spark, d, axes, scores: bool):
    """The record of a decision: candidates and consensus of both arms, a domain only where c0 is decided, the largest disagreement over all heads and the
    largest closeness to a cut; with the packed scores that it follows from, if asked."""
    e = table(spark, d, "embeddings")
    at = lambda i: F.round(F.abs(F.element_at("embedding", i).cast("double")), 4)
    s = {arm: [at(5 * k + 1 + i) for i in range(5)] for k, arm in enumerate("ab")}
    cols = {f"{arm}_{h}": s[arm][i] for arm in "ab" for i, h in enumerate(HEADS)}
    for name, (_, start) in axes.items():
        for k, arm in enumerate("ab"):
            cols[f"{arm}_{name}"] = F.array(*[at(start + 3 * k + i) for i in range(3)])
    e = e.select("vec_id", *[c.alias(n) for n, c in cols.items()])
    hit = lambda arm, h: F.col(f"{arm}_{h}") >= CUTS[arm]
    either, both = (lambda h: hit("a", h) | hit("b", h)), (lambda h: hit("a", h) & hit("b", h))
    listed = lambda rule: F.array_join(F.array_compact(F.array(*[F.when(rule(h), F.lit(h)) for h in HEADS[:3]])), ",")

    def axis(name):
        a, b = F.col(f"a_{name}"), F.col(f"b_{name}")
        best = lambda v: F.element_at(F.array(*map(F.lit, axes[name][0])), F.array_position(v, F.array_max(v)).cast("int"))
        return best(a), best(b), best(F.zip_with(a, b, lambda x, y: (x + y) / 2)), F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))

    def close(arm, h):
        x, t = F.col(f"{arm}_{h}"), CUTS[arm]
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - F.abs(x - t) / F.when(x < t, t).otherwise(1.0 - t)))

    done = {name: axis(name) for name in axes}
    da, db, dc, _ = done["domain"]
    told = lambda c: F.nullif(c, F.lit("none"))
    own = {"": lambda arm: F.array(*[F.col(f"{arm}_{h}") for h in HEADS[:3]])} | {f"{h}_": (lambda arm, h=h: F.array(F.col(f"{arm}_{h}"))) for h in HEADS[3:]} | {f"{n}_": (lambda arm, n=n: F.col(f"{arm}_{n}")) for n in axes}
    return e.select(
        "vec_id", F.lit("v1").alias("model_version"), listed(either).alias("candidates"), listed(both).alias("consensus"),
        *[f(h).alias(f"{h}_{n}") for h in HEADS[3:] for f, n in ((either, "candidate"), (both, "consensus"))],
        told(da).alias("domain_a"), told(db).alias("domain_b"), F.when(either("c0"), told(dc)).alias("domain_candidate"), F.when(both("c0") & (da == db), told(da)).alias("domain_consensus"),
        *[c for n, (a, b, m, _) in done.items() if n != "domain" for c in (a.alias(f"{n}_a"), b.alias(f"{n}_b"), m.alias(f"{n}_candidate"), F.when(a == b, a).alias(f"{n}_consensus"))],
        *[T.packed_scores(f(arm)).alias(f"{n}scores_{arm}") for n, f in own.items() for arm in "ab" if scores],
        F.round(F.greatest(*[F.abs(F.col(f"a_{h}") - F.col(f"b_{h}")) for h in HEADS], *[x[3] for x in done.values()]), 6).alias("disagreement"),
        F.round(F.greatest(*[close(arm, h) for arm in "ab" for h in HEADS]), 6).alias("uncertainty"), F.lit("unvalidated").alias("status"),
    )


def prediction_row(spark, d):
    return record(spark, d, AXES, False)


# -- returned records

FIELDS = ["id", "categories", "domain", "genre", "about"]
RECORD = "id string, categories array<string>, domain string, genre string, about boolean"


def returned(spark, d):
    """(doc_id, json): a record for each document as an arm returned it, some with faults."""
    n = lambda k: _digit("doc_id", "r", k)
    r = T.once(table(spark, d, "documents").select("doc_id"), "_d", F.struct(*[n(k).alias(f"d{k}") for k in range(1, 7)])).select("doc_id", "_d.*")
    c = F.col
    words = lambda *w: F.array(*map(F.lit, w)) if w else F.array().cast("array<string>")
    cats = F.when(c("d2") < 5, words()).when(c("d2") < 9, words("methods")).when(c("d2") < 12, words("methods", "sts")).when(c("d2") == 12, words("sts", "sts"))
    cats = cats.when(c("d2") == 13, words("magic")).when(c("d2") == 14, words("unscreenable")).otherwise(words("unscreenable", "sts"))
    own = F.struct(
        F.when(c("d1") != 14, F.concat(F.when(c("d1") == 15, "X").otherwise("W"), c("doc_id").cast("string"))).alias("id"), cats.alias("categories"),
        F.when(c("d3") >= 8, F.when(c("d3") < 14, "reporting").otherwise("astrology")).alias("domain"),
        F.when(c("d4") != 14, F.when(c("d4") == 15, "poem").otherwise("review")).alias("genre"), F.when(c("d5") != 15, c("d5") % 2 == 0).alias("about"),
    )
    r = T.once(r.select("doc_id", "d6", own.alias("own")), "j", F.to_json("own"))
    return T.once(r, "json", F.when(c("d6") == 15, F.substring("j", 1, 10)).when(c("d6") == 14, F.regexp_replace("j", r"\}$", ',"extra":1}')).otherwise(F.col("j"))).select("doc_id", "json")


def record_codes(json, r):
    """Codes of the rules that a record breaks, given as JSON and parsed: JSON, closed set of fields, required fields, pattern, vocabularies, repeats,
    a domain if and only if the record is of methods, nothing beside unscreenable."""
    cats = F.coalesce(r["categories"], F.array().cast("array<string>"))
    methods = F.array_contains(cats, "methods")
    known = F.forall(cats, lambda x: x.isin("methods", "sts", "unscreenable")) & F.coalesce(r["genre"].isin("review", "empirical"), F.lit(True)) & F.coalesce(r["domain"].isin("reporting", "evaluation"), F.lit(True))
    rules = {
        "extra": F.size(F.array_except(F.json_object_keys(json), F.array(*map(F.lit, FIELDS)))) == 0,
        "required": r["id"].isNotNull() & r["categories"].isNotNull() & r["genre"].isNotNull() & r["about"].isNotNull(),
        "pattern": F.coalesce(r["id"].rlike(r"^W\d+$"), F.lit(True)),
        "enum": known,
        "unique": F.size(F.array_distinct(cats)) == F.size(cats),
        "then_domain": ~methods | F.coalesce(r["domain"].isin("reporting", "evaluation"), F.lit(False)),
        "else_domain": methods | r["domain"].isNull(),
        "max_items": ~F.array_contains(cats, "unscreenable") | (F.size(cats) <= 1),
    }
    return F.when(F.try_parse_json(json).isNull(), F.array(F.lit("invalid_json"))).otherwise(C.codes(rules))


def json_validate(spark, d):
    r = T.once(returned(spark, d), "record", F.from_json("json", RECORD))
    return T.once(r, "codes", F.array_join(record_codes(F.col("json"), F.col("record")), ",")).select("doc_id", "codes").where("codes <> ''")


def chunk_ids(spark, d):
    """Chunks of ids against what was returned for them: counts, repeats, malformed ids, the set of ids, the vocabulary."""
    n = _digit("doc_id", "r", 1)
    docs = table(spark, d, "documents").select("doc_id", F.floor(F.col("doc_id") / 20).alias("chunk"), n.alias("n"), _digit("doc_id", "r", 4).alias("g"))
    want = docs.select("chunk", F.concat(F.lit("W"), F.col("doc_id").cast("string")).alias("id"), F.lit(1).alias("want"), F.lit(0).alias("got"), F.lit(False).alias("odd"))
    came = docs.where("n <> 13").select("chunk", F.concat(F.when(F.col("n") == 15, "X").otherwise("W"), F.col("doc_id").cast("string")).alias("id"), F.lit(0).alias("want"), F.when(F.col("n") == 12, 2).otherwise(1).alias("got"), (F.col("g") == 15).alias("odd"))
    per = want.unionByName(came).groupBy("chunk", "id").agg(F.sum("want").alias("want"), F.sum("got").alias("got"), F.max("odd").alias("odd"))
    g = per.groupBy("chunk").agg(
        F.sum("want").alias("w"), F.sum("got").alias("g"), F.max("got").alias("most"), F.max((F.col("got") > 0) & ~F.col("id").rlike(r"^W\d+$")).alias("bad"),
        F.max((F.col("want") > 0) != (F.col("got") > 0)).alias("differs"), F.max("odd").alias("odd"),
    )
    rules = {"wrong_count": F.col("w") == F.col("g"), "duplicate_id": F.col("most") <= 1, "malformed_id": ~F.col("bad"), "wrong_id_set": ~F.col("differs"), "vocabulary": ~F.col("odd")}
    return g.select("chunk", F.array_join(C.codes(rules), ",").alias("codes")).where("codes <> ''")


def json_array_salvage(spark, d):
    """The first array by turn that meets the contract, from texts with broken, foreign and nested arrays around them, and
    how many others were set aside."""
    conv = F.col("conv_id").cast("string")
    good = F.concat(F.lit('[{"id":"W'), conv, F.lit('","note":"a ] b [ \\"c","more":[[1],[2]]}]'))
    made = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("[cut "), F.lit('[{"id":'))).when(F.col("turn") % 3 == 1, F.lit('first [1,2] then [{"id":"none"}]')).otherwise(F.concat(F.lit("[note] "), good, F.lit(" and "), good))
    c = table(spark, d, "conversations").select("conv_id", "turn", F.concat(F.coalesce("text", F.lit("")), F.lit(" "), made, F.lit(" "), F.coalesce("text", F.lit(""))).alias("raw"))
    ok = lambda x: F.forall(F.from_json(x, "array<struct<id:string>>"), lambda r: r["id"].rlike(r"^W\d+$"))
    found = salvage.candidates(c, ["conv_id"], ["turn"], F.col("raw"), ok)
    out = found.groupBy("conv_id").agg(F.max(F.when(F.col("chosen"), F.col("turn"))).alias("attempt"), F.max(F.when(F.col("chosen"), F.col("candidate"))).alias("accepted"), F.count_if(~F.col("chosen")).alias("set_aside"))
    return out.where("attempt IS NOT NULL")


# -- versions, inventories, parameters

def replace_version(spark, d):
    """Rows of the versions that come again are replaced, those of others stay."""
    e = table(spark, d, "events").select(F.col("event_type").alias("version"), "event_id", F.round("value", 4).alias("value"))
    new = e.where("version IN ('click', 'view') AND event_id % 2 = 0").withColumn("value", F.lit(1.0))
    out = C.replace_versions(e, new, "version")
    return out.groupBy("version").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


def activate_version(spark, d):
    """One version is active after a load, and only if its rows are as many as announced."""
    rows = table(spark, d, "events").select(F.col("event_type").alias("version"))
    registry = rows.groupBy("version").agg(F.count("*").alias("row_count")).withColumn("active", F.col("version") == "click")
    return C.activated(registry, rows, "version", "view")


def unnest_params(spark, d):
    return C.among(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", [3, 7, 11, 11, None, 10**9])


def bytes_by_part(spark, d):
    """Bytes of each partition, whether it is done, and the share of all that is done."""
    g = table(spark, d, "documents").groupBy(F.col("source").alias("part")).agg(F.sum(F.octet_length("text")).alias("bytes")).withColumn("done", F.substring(F.md5("part"), 1, 1) < "8")
    total = g.agg(F.sum("bytes").alias("total"), F.sum(F.when(F.col("done"), F.col("bytes")).otherwise(0)).alias("have"))
    return g.join(F.broadcast(total)).select("part", "bytes", "done", F.round(100.0 * F.col("have") / F.col("total"), 1).alias("pct_done"))


def parts_inventory(spark, d):
    """Parts of ids: rows, bounds and the digest of the ids in order, each with its length before it."""
    o = table(spark, d, "orders").select(F.floor(F.col("o_orderkey") / 2000).alias("part"), F.col("o_orderkey").alias("id"))
    return C.inventory(o, "part", "id")


def parquet_metadata(spark, d):
    """Rows and columns of tables, from the files' footers."""
    out = None
    for name in ("documents", "labels", "orders"):
        t = table(spark, d, name)
        row = t.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows", F.lit(len(t.columns)).cast("long").alias("columns"))
        out = row if out is None else out.unionByName(row)
    return out


def attach_view(spark, d):
    table(spark, d, "nation").createOrReplaceTempView("attached_nation")
    out = spark.sql("SELECT n_regionkey, count(*) AS nations FROM attached_nation GROUP BY 1")
    spark.catalog.dropTempView("attached_nation")  # the plan has what it needs
    return out


def parity_check(spark, d):
    """Fields that training wants and the table can't serve: no column, or no row that fills it."""
    return C.served(table(spark, d, "documents"), ["text", "lang", "abstract", "venue"]).where("NOT has_column OR empty = rows").select("field")


# -- routes over nested records

def nested_routes(spark, d):
    """Works with nested authorships: affiliation by any place or any country, funding by two lists against a pinned one,
    venue by a marker join that keeps an unknown venue unknown."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    inner = li.groupBy("l_orderkey", "l_partkey").agg(F.collect_list(F.struct((F.col("l_suppkey") % 5).alias("country"), F.col("l_suppkey").alias("id"))).alias("institutions"), F.collect_set((F.col("l_suppkey") % 7)).alias("countries"))
    works = inner.groupBy("l_orderkey").agg(F.collect_list(F.struct("institutions", "countries")).alias("authorships"))
    aff = F.exists("authorships", lambda a: F.exists(a["institutions"], lambda i: i["country"] == 3) | F.array_contains(a["countries"], 6))
    funders = F.flatten(F.transform("authorships", lambda a: F.transform(a["institutions"], lambda i: i["id"])))
    pinned = F.array(*[F.lit(x).cast("long") for x in (2, 4, 8)])
    works = works.select(F.col("l_orderkey").alias("o_orderkey"), aff.alias("route_aff"), F.arrays_overlap(funders, pinned).alias("route_fund"))
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 9 != 0, F.col("o_custkey")).alias("venue"))
    venues = table(spark, d, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("venue"), F.lit(True).alias("marked"))
    o = o.join(venues, "venue", "left").select("o_orderkey", F.when(F.col("venue").isNotNull(), F.coalesce("marked", F.lit(False))).alias("route_venue"))
    return works.join(o, "o_orderkey").select("o_orderkey", "route_aff", "route_fund", "route_venue")


# -- reports of arms

def _genre(seed: str, key: str = "doc_id"):
    return F.element_at(F.array(*map(F.lit, GENRES)), _digit(key, seed) % 4 + 1)


def _genres(spark, d):
    a = agreement.arms(spark, d)
    same = _digit("doc_id", "same") < 11
    return a.withColumns({"a_genre": _genre("ga"), "b_genre": F.when(same, _genre("ga")).otherwise(_genre("gb"))})


def arm_fields(spark, d):
    """Agreement of two arms on whole sets of categories and on the genre, by rows and by weight."""
    a = _genres(spark, d)
    sets = F.col("a_quality").eqNullSafe(F.col("b_quality")) & F.col("a_toxic").eqNullSafe(F.col("b_toxic"))
    x = F.explode(F.array(F.struct(F.lit("category_set").alias("field"), sets.alias("same")), F.struct(F.lit("genre").alias("field"), (F.col("a_genre") == F.col("b_genre")).alias("same"))))
    g = a.select("w", x.alias("x")).groupBy("x.field").agg(F.count("*").alias("records"), F.count_if("x.same").alias("agree"), F.sum(F.when(F.col("x.same"), F.col("w")).otherwise(0.0)).alias("sw"), F.sum("w").alias("w"))
    return g.select("field", "records", "agree", F.round(F.col("agree") / F.col("records"), 6).alias("rate"), F.round(F.col("sw") / F.col("w"), 6).alias("weighted_rate"))


def category_counts(spark, d):
    """Members of every category under both policies, in one scan."""
    a = _genres(spark, d)
    either = {g: [(F.col("a_genre") == g) | (F.col("b_genre") == g), (F.col("a_genre") == g) & (F.col("b_genre") == g)] for g in GENRES}
    row = a.agg(*[F.count_if(c).alias(f"{g}_{k}") for g, cs in either.items() for k, c in enumerate(cs)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(g).alias("category"), F.col(f"{g}_0").alias("candidates"), F.col(f"{g}_1").alias("consensus")) for g in GENRES])).alias("x")).select("x.*")


def vocab_audit(spark, d):
    """How much of what each arm said is legal under either of two vocabularies."""
    x = F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), F.coalesce(F.col(f"{a}_genre"), F.lit("<missing>")).alias("genre")) for a in "ab"]))
    g = _genres(spark, d).select(x.alias("x")).groupBy("x.arm").agg(
        F.count("*").alias("labels"), F.count_distinct("x.genre").alias("distinct_values"),
        *[F.round(100.0 * F.avg(F.col("x.genre").isin(v).cast("double")), 1).alias(n) for n, v in (("pct_first", GENRES[:2]), ("pct_second", GENRES[1:]))],
    )
    return g


def _votes(spark, d):
    return agreement.arms(spark, d).select("lang", F.coalesce("a_quality", F.lit(0)).alias("x"), F.coalesce("b_quality", F.lit(0)).alias("y"), (1 - F.col("a_toxic")).alias("z"))


def three_arm_jaccard(spark, d):
    pairs = [("x", "y"), ("x", "z"), ("y", "z")]
    e = F.explode(F.array(*[F.struct(F.lit(f"{p}{q}").alias("pair"), F.col(p).alias("p"), F.col(q).alias("q")) for p, q in pairs]))
    g = _votes(spark, d).select(e.alias("e")).groupBy("e.pair").agg(F.sum(F.col("e.p") * F.col("e.q")).alias("n_both"), F.sum(F.greatest("e.p", "e.q")).alias("n_either"))
    return g.withColumn("jaccard", F.round(F.when(F.col("n_either") == 0, 1.0).otherwise(F.try_divide("n_both", "n_either")), 6))


def contested_by_stratum(spark, d):
    s = F.col("x") + F.col("y") + F.col("z")
    g = _votes(spark, d).groupBy("lang").agg(F.count("*").alias("n"), F.count_if((s == 0) | (s == 3)).alias("unanimous"), F.count_if((s > 0) & (s < 3)).alias("contested"))
    return g.withColumn("pct", F.round(100.0 * F.col("contested") / F.col("n"), 1))


def prevalence_se(spark, d):
    """Design-weighted prevalence, its effective sample size and standard error."""
    w = F.col("w")
    g = agreement.arms(spark, d).groupBy("lang").agg((F.sum(w * F.col("a_toxic")) / F.sum(w)).alias("p"), (F.sum(w) * F.sum(w) / F.sum(w * w)).alias("n_eff"))
    return g.select("lang", F.round("p", 6).alias("p"), F.round("n_eff", 6).alias("n_eff"), F.round(F.sqrt(F.greatest(F.col("p") * (1 - F.col("p")), F.lit(1e-12)) / F.col("n_eff")), 6).alias("se"))


FIRST_YEAR = {"randomized": 1992, "observational": 1995, "review": 1997}


def eligibility_gate(spark, d):
    """A class is judged on human-indexed records of the years in which it could be given, by the lower bound (Wilson, 95 %) of
    its recall and precision; else it ships as a score."""
    o = table(spark, d, "orders").select(F.year("o_orderdate").alias("year"), _digit("o_orderkey", "t").alias("t"), _digit("o_orderkey", "p").alias("p"), F.substring("o_orderpriority", 1, 1).alias("how"))
    classes = F.explode(F.array(*[F.struct(F.lit(c).alias("class"), F.lit(y).alias("first"), F.lit(k).alias("k")) for k, (c, y) in enumerate(FIRST_YEAR.items())]))
    stratum = F.when(F.col("how").isin("1", "2"), "human").when(F.col("how") == "3", "curated").otherwise("automated")
    x = o.select("*", classes.alias("c"), stratum.alias("stratum")).where("year >= c.first")
    true, said = F.col("t") % 3 == F.col("c.k"), F.when(F.col("p") < 15, F.col("t") % 3).otherwise(F.col("p") % 2) == F.col("c.k")
    g = x.groupBy("c.class", "stratum").agg(F.count("*").alias("n"), F.count_if(true & said).alias("tp"), F.count_if(said).alias("said"), F.count_if(true).alias("truth"))

    def low(k, n):
        z, p = 1.959964, F.col(k) / F.col(n)
        return F.when(F.col(n) > 0, (p + z * z / (2 * F.col(n)) - z * F.sqrt((p * (1 - p) + z * z / (4 * F.col(n))) / F.col(n))) / (1 + z * z / F.col(n)))

    g = g.select("class", "stratum", "n", F.round(low("tp", "said"), 6).alias("precision_low"), F.round(low("tp", "truth"), 6).alias("recall_low"))
    passed = (F.col("stratum") == "human") & (F.col("n") >= 200) & (F.col("precision_low") >= 0.9) & (F.col("recall_low") >= 0.8)
    return g.withColumn("ships_as", F.when(F.coalesce(passed, F.lit(False)), "label").otherwise("score"))


def word_names(spark, d):
    """Whole words of names, in any case."""
    return table(spark, d, "part").where(F.col("p_name").rlike(r"(?i)\b(" + "|".join(T.quoted(w) for w in ("red", "blue", "hot")) + r")\b")).select("p_partkey", "p_name")


def empty_strings(spark, d):
    """Unknown goes out as the empty string and comes back as unknown."""
    o = table(spark, d, "orders").select("o_orderkey", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("p"))
    out = o.select("o_orderkey", F.coalesce("p", F.lit("")).alias("text"))
    return out.select("o_orderkey", "text", F.nullif("text", F.lit("")).isNull().alias("unknown"))


_PR = {"a": lambda i: f"a[{i + 1}]", "b": lambda i: f"b[{i + 1}]"}
_HIT = lambda arm, i: f"{_PR[arm](i)} >= {CUTS[arm]}::DOUBLE"
_EITHER, _BOTH = (lambda i: f"({_HIT('a', i)} OR {_HIT('b', i)})"), (lambda i: f"({_HIT('a', i)} AND {_HIT('b', i)})")
_LISTED = lambda rule: "concat_ws(',', " + ", ".join(f"CASE WHEN {rule(i)} THEN '{HEADS[i]}' END" for i in range(3)) + ")"
_BEST = lambda v, names: f"({names})[list_position({v}, list_max({v}))]"
_CLOSE = lambda arm, i: f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.0::DOUBLE - abs({_PR[arm](i)} - {CUTS[arm]}::DOUBLE) / CASE WHEN {_PR[arm](i)} < {CUTS[arm]}::DOUBLE THEN {CUTS[arm]}::DOUBLE ELSE 1.0::DOUBLE - {CUTS[arm]}::DOUBLE END))"
_V = lambda lo, hi: f"list_transform(embedding[{lo}:{hi}], lambda x: round(abs(x::DOUBLE), 4))"
_PAIR = lambda x, y, f: "[" + ", ".join(f.format(f"{x}[{i}]", f"{y}[{i}]") for i in (1, 2, 3)) + "]"
_TOLD = lambda x: f"nullif({x}, 'none')"
_PACKED = lambda v: f"CASE WHEN list_max({v}) <= 1 THEN array_to_string(list_transform({v}, lambda x: substr(lpad(lower(to_hex(CAST(floor(x * 65535.0::DOUBLE + 0.5::DOUBLE) AS BIGINT))), 4, '0'), 3, 2) || substr(lpad(lower(to_hex(CAST(floor(x * 65535.0::DOUBLE + 0.5::DOUBLE) AS BIGINT))), 4, '0'), 1, 2)), '') END"


def record_sql(axes, scores: bool) -> str:
    names = {n: "[" + ", ".join(f"'{x}'" for x in v) + "]" for n, (v, _) in axes.items()}
    vectors = ", ".join(f"{_V(at + 3 * k, at + 3 * k + 2)} AS {n}{arm}" for n, (_, at) in axes.items() for k, arm in enumerate("ab"))
    best = ", ".join(f"{_BEST(f'{n}a', names[n])} AS x{n}a, {_BEST(f'{n}b', names[n])} AS x{n}b, {_BEST(_PAIR(f'{n}a', f'{n}b', '({} + {}) / 2'), names[n])} AS x{n}c" for n in axes)
    others = "".join(f"x{n}a AS {n}_a, x{n}b AS {n}_b, x{n}c AS {n}_candidate, CASE WHEN x{n}a = x{n}b THEN x{n}a END AS {n}_consensus,\n" for n in axes if n != "domain")
    own = {"": "{0}[1:3]", "sys_": "{0}[4:4]", "topic_": "{0}[5:5]"} | {f"{n}_": n + "{0}" for n in axes}
    packed = "".join(f"{_PACKED(v.format(arm))} AS {n}scores_{arm},\n" for n, v in own.items() for arm in "ab") if scores else ""
    apart = ", ".join(f"list_max({_PAIR(f'{n}a', f'{n}b', 'abs({} - {})')})" for n in axes)
    return f"""WITH s AS (SELECT vec_id, {_V(1, 5)} AS a, {_V(6, 10)} AS b, {vectors} FROM embeddings), m AS (SELECT *, {best} FROM s)
SELECT vec_id, 'v1' AS model_version, {_LISTED(_EITHER)} AS candidates, {_LISTED(_BOTH)} AS consensus, {_EITHER(3)} AS sys_candidate, {_BOTH(3)} AS sys_consensus, {_EITHER(4)} AS topic_candidate, {_BOTH(4)} AS topic_consensus,
{_TOLD('xdomaina')} AS domain_a, {_TOLD('xdomainb')} AS domain_b, CASE WHEN {_EITHER(0)} THEN {_TOLD('xdomainc')} END AS domain_candidate, CASE WHEN {_BOTH(0)} AND xdomaina = xdomainb THEN {_TOLD('xdomaina')} END AS domain_consensus,
{others}{packed}round(greatest({", ".join(f"abs(a[{i}] - b[{i}])" for i in range(1, 6))}, {apart}), 6) AS disagreement,
round(greatest({", ".join(_CLOSE(arm, i) for arm in "ab" for i in range(5))}), 6) AS uncertainty, 'unvalidated' AS status FROM m"""


_DIG = ", ".join(f"{_sql_digit('doc_id', 'r', k)} AS d{k}" for k in range(1, 7))
_SG = f"""CASE {_sql_digit('doc_id', '{0}')} % 4 WHEN 0 THEN 'review' WHEN 1 THEN 'empirical' WHEN 2 THEN 'editorial' ELSE 'other' END"""
_G = f"{agreement._A}, g AS (SELECT *, {_SG.format('ga')} AS a_genre, CASE WHEN {_sql_digit('doc_id', 'same')} < 11 THEN {_SG.format('ga')} ELSE {_SG.format('gb')} END AS b_genre FROM arms)"
_VOTES = f"{agreement._A}, v AS (SELECT lang, coalesce(a_quality, 0) AS x, coalesce(b_quality, 0) AS y, 1 - a_toxic AS z FROM arms)"
_LOW = lambda k, n: f"CASE WHEN {n} > 0 THEN ({k}::DOUBLE / {n} + 3.841458881296::DOUBLE / (2 * {n}) - 1.959964::DOUBLE * sqrt(({k}::DOUBLE / {n} * (1 - {k}::DOUBLE / {n}) + 3.841458881296::DOUBLE / (4 * {n})) / {n})) / (1 + 3.841458881296::DOUBLE / {n}) END"
QUERIES = {f.__name__: f for f in (prediction_row, json_validate, chunk_ids, json_array_salvage, replace_version, activate_version, unnest_params, bytes_by_part, parts_inventory, parquet_metadata, attach_view, parity_check, nested_routes, arm_fields, category_counts, vocab_audit, three_arm_jaccard, contested_by_stratum, prevalence_se, eligibility_gate, word_names, empty_strings)}
ORACLE = {
    "prediction_row": record_sql(AXES, False),
    "json_validate": f"""WITH r AS (SELECT doc_id, {_DIG} FROM documents)
SELECT * FROM (SELECT doc_id, CASE WHEN d6 = 15 THEN 'invalid_json' ELSE concat_ws(',', CASE WHEN d6 = 14 THEN 'extra' END, CASE WHEN d1 = 14 OR d4 = 14 OR d5 = 15 THEN 'required' END, CASE WHEN d1 = 15 THEN 'pattern' END,
CASE WHEN d2 = 13 OR d3 >= 14 OR d4 = 15 THEN 'enum' END, CASE WHEN d2 = 12 THEN 'unique' END, CASE WHEN d2 BETWEEN 5 AND 11 AND (d3 < 8 OR d3 >= 14) THEN 'then_domain' END,
CASE WHEN d2 NOT BETWEEN 5 AND 11 AND d3 >= 8 THEN 'else_domain' END, CASE WHEN d2 = 15 THEN 'max_items' END) END AS codes FROM r) WHERE codes <> ''""",
    "chunk_ids": f"""WITH r AS (SELECT doc_id // 20 AS chunk, {_DIG} FROM documents), g AS (SELECT chunk, count(*) AS w, sum(CASE d1 WHEN 13 THEN 0 WHEN 12 THEN 2 ELSE 1 END) AS n, bool_or(d1 = 12) AS twice, bool_or(d1 = 15) AS bad, bool_or(d1 IN (13, 15)) AS differs, bool_or(d1 <> 13 AND d4 = 15) AS odd FROM r GROUP BY 1)
SELECT * FROM (SELECT chunk, concat_ws(',', CASE WHEN w <> n THEN 'wrong_count' END, CASE WHEN twice THEN 'duplicate_id' END, CASE WHEN bad THEN 'malformed_id' END, CASE WHEN differs THEN 'wrong_id_set' END, CASE WHEN odd THEN 'vocabulary' END) AS codes FROM g) WHERE codes <> ''""",
    "json_array_salvage": """WITH g AS (SELECT conv_id, min(turn) FILTER (WHERE turn % 3 = 2) AS attempt, count(*) FILTER (WHERE turn % 3 = 1) AS odd, count(*) FILTER (WHERE turn % 3 = 2) AS good FROM conversations GROUP BY 1)
SELECT conv_id, attempt, '[{"id":"W' || conv_id || '","more":[[1],[2]],"note":"a ] b [ \\"c"}]' AS accepted, 2 * odd + 2 * good - 1 AS set_aside FROM g WHERE attempt IS NOT NULL""",
    "replace_version": "SELECT version, count(*) AS n, round(sum(value), 2) AS total FROM (SELECT event_type AS version, CASE WHEN event_type IN ('click', 'view') THEN 1.0::DOUBLE ELSE round(value, 4) END AS value FROM events WHERE event_type NOT IN ('click', 'view') OR event_id % 2 = 0) GROUP BY 1",
    "activate_version": "SELECT event_type AS version, count(*) AS row_count, event_type = 'view' AS active FROM events GROUP BY 1",
    "unnest_params": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT unnest([3, 7, 11, 11, NULL, 1000000000]))",
    "bytes_by_part": "WITH g AS (SELECT source AS part, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes, substr(md5(source), 1, 1) < '8' AS done FROM documents GROUP BY 1) SELECT *, round(100.0::DOUBLE * (SELECT coalesce(sum(bytes) FILTER (WHERE done), 0) FROM g) / (SELECT sum(bytes) FROM g), 1) AS pct_done FROM g",
    "parts_inventory": "SELECT o_orderkey // 2000 AS part, count(*) AS rows, min(o_orderkey) AS first, max(o_orderkey) AS last, sha256(unhex(string_agg(printf('%08x', length(CAST(o_orderkey AS VARCHAR))) || hex(CAST(o_orderkey AS VARCHAR)), '' ORDER BY o_orderkey))) AS digest FROM orders GROUP BY 1",
    "parquet_metadata": "SELECT 'documents' AS name, count(*) AS rows, CAST(5 AS BIGINT) AS columns FROM documents UNION ALL SELECT 'labels', count(*), 3 FROM labels UNION ALL SELECT 'orders', count(*), (SELECT count(*) FROM (DESCRIBE orders)) FROM orders",
    "attach_view": "SELECT n_regionkey, count(*) AS nations FROM nation GROUP BY 1",
    "parity_check": "SELECT 'abstract' AS field UNION ALL SELECT 'venue' UNION ALL SELECT 'text' FROM documents HAVING count(*) = count(*) FILTER (WHERE coalesce(text, '') = '') UNION ALL SELECT 'lang' FROM documents HAVING count(*) = count(*) FILTER (WHERE coalesce(lang, '') = '')",
    "nested_routes": """WITH w AS (SELECT l_orderkey, bool_or(l_suppkey % 5 = 3 OR l_suppkey % 7 = 6) AS route_aff, bool_or(l_suppkey IN (2, 4, 8)) AS route_fund FROM lineitem GROUP BY 1)
SELECT o_orderkey, route_aff, route_fund, CASE WHEN o_orderkey % 9 <> 0 THEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) END AS route_venue FROM w JOIN orders ON o_orderkey = l_orderkey""",
    "arm_fields": f"""WITH {_G}, x AS (SELECT 'category_set' AS field, w, a_quality IS NOT DISTINCT FROM b_quality AND a_toxic IS NOT DISTINCT FROM b_toxic AS same FROM g UNION ALL SELECT 'genre', w, a_genre = b_genre FROM g)
SELECT field, count(*) AS records, count(*) FILTER (WHERE same) AS agree, round(count(*) FILTER (WHERE same)::DOUBLE / count(*), 6) AS rate, round(coalesce(sum(w) FILTER (WHERE same), 0) / sum(w), 6) AS weighted_rate FROM x GROUP BY 1""",
    "category_counts": f"WITH {_G} SELECT category, count(*) FILTER (WHERE a_genre = category OR b_genre = category) AS candidates, count(*) FILTER (WHERE a_genre = category AND b_genre = category) AS consensus FROM g, (SELECT unnest(['review', 'empirical', 'editorial', 'other']) AS category) GROUP BY 1",
    "vocab_audit": f"""WITH {_G}, x AS (SELECT 'a' AS arm, a_genre AS genre FROM g UNION ALL SELECT 'b', b_genre FROM g)
SELECT arm, count(*) AS labels, count(DISTINCT genre) AS distinct_values, round(100.0::DOUBLE * avg(CAST(genre IN ('review', 'empirical') AS DOUBLE)), 1) AS pct_first, round(100.0::DOUBLE * avg(CAST(genre IN ('empirical', 'editorial', 'other') AS DOUBLE)), 1) AS pct_second FROM x GROUP BY 1""",
    "three_arm_jaccard": f"WITH {_VOTES}, p AS (SELECT 'xy' AS pair, x AS p, y AS q FROM v UNION ALL SELECT 'xz', x, z FROM v UNION ALL SELECT 'yz', y, z FROM v) SELECT pair, CAST(sum(p * q) AS BIGINT) AS n_both, CAST(sum(greatest(p, q)) AS BIGINT) AS n_either, round(CASE WHEN sum(greatest(p, q)) = 0 THEN 1 ELSE sum(p * q)::DOUBLE / sum(greatest(p, q)) END, 6) AS jaccard FROM p GROUP BY 1",
    "contested_by_stratum": f"WITH {_VOTES}, s AS (SELECT lang, x + y + z AS s FROM v), g AS (SELECT lang, count(*) AS n, count(*) FILTER (WHERE s IN (0, 3)) AS unanimous, count(*) FILTER (WHERE s IN (1, 2)) AS contested FROM s GROUP BY 1) SELECT *, round(100.0::DOUBLE * contested / n, 1) AS pct FROM g",
    "prevalence_se": f"WITH {agreement._A}, g AS (SELECT lang, sum(w * a_toxic) / sum(w) AS p, sum(w) * sum(w) / sum(w * w) AS n_eff FROM arms GROUP BY 1) SELECT lang, round(p, 6) AS p, round(n_eff, 6) AS n_eff, round(sqrt(greatest(p * (1 - p), 1e-12::DOUBLE) / n_eff), 6) AS se FROM g",
    "eligibility_gate": f"""WITH o AS (SELECT year(o_orderdate) AS year, {_sql_digit('o_orderkey', 't')} AS t, {_sql_digit('o_orderkey', 'p')} AS p, CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '2') THEN 'human' WHEN substr(o_orderpriority, 1, 1) = '3' THEN 'curated' ELSE 'automated' END AS stratum FROM orders),
x AS (SELECT class, stratum, t % 3 = k AS truth, CASE WHEN p < 15 THEN t % 3 ELSE p % 2 END = k AS said FROM o, (VALUES ('randomized', 1992, 0), ('observational', 1995, 1), ('review', 1997, 2)) AS c(class, first, k) WHERE year >= first),
g AS (SELECT class, stratum, count(*) AS n, count(*) FILTER (WHERE truth AND said) AS tp, count(*) FILTER (WHERE said) AS s, count(*) FILTER (WHERE truth) AS t FROM x GROUP BY 1, 2),
b AS (SELECT class, stratum, n, round({_LOW('tp', 's')}, 6) AS precision_low, round({_LOW('tp', 't')}, 6) AS recall_low FROM g)
SELECT *, CASE WHEN stratum = 'human' AND n >= 200 AND precision_low >= 0.9::DOUBLE AND recall_low >= 0.8::DOUBLE THEN 'label' ELSE 'score' END AS ships_as FROM b""",
    "word_names": "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '\\b(red|blue|hot)\\b', 'i')",
    "empty_strings": "SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE o_orderpriority END AS text, o_orderpriority = '5-LOW' AS unknown FROM orders",
}
