"""Toxicity scores from a lexicon, matched with misspellings, and the context of each match.

Fitting (labelled rows only, at most TRAIN_ROWS of them by hash order of the id): terms are words, and stems
of words with varied endings, that stand in toxic documents so much more often than in others that chance
is excluded at MAX_CHANCE over all candidates. The lexicon is a trie of all of them; a Levenshtein automaton for the
number of edits that a term's length allows is intersected with it, state by state as words need it. Words near a
term that clean labelled documents use are exceptions. Of labelled rows that are near copies with the same label, which
would be so many witnesses of one thing, the one of smallest id counts.

Each match has a quotation score from the window of WINDOW words around it, 0 to 1: marks on both sides and words of
report raise it. A match counts as much as it is not quoted, and a misspelled one a little less than an exact one;
those that stand near a word of address are summed apart. To the fixed words of report and of address come those that
the labelled rows show: words that stand nearer to the matches of clean, or of toxic, documents than chance explains. A logistic regression weighs the sums. As labelled
rows hold few misspelled terms, each toxic one counts in part (PLANTED) with a letter changed in every term that may be misspelled; and a misspelled match may not
fall below LEAST_MISSPELLED of an exact one. A quoted match can't raise a score above that of one that is
aimed at someone, as its weights may not have the wrong sign.

Scoring reads whole texts in Arrow functions. A task matches each distinct word once. The number of terms is bounded
by the labelled rows only.

Inputs of a score are the text and the fitted model only. Defined cases: a null or empty text has no match
and gets the model's base score; without labels, or labels of one kind, the score is the smoothed share of
toxic labels for every row; rows that repeat a doc_id get a row each; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelens.llm.common import written

TRAIN_ROWS = 20_000
MIN_SUPPORT, MIN_SHARE, MIN_STEM_SHARE, MAX_CHANCE = 4, 0.8, 0.5, 0.1
STEM_LENGTHS, STEM_ENDINGS = (4, 5, 6, 7), 3
WINDOW, THRESHOLD = 6, 0.3
#: What a misspelled match counts beside an exact one; what marks and what each word of report add to a quotation score.
MISSPELLED, IN_MARKS, REPORTED = 0.7, 0.6, 0.4
#: Least weight of misspelled matches, as a share of that of exact ones.
LEAST_MISSPELLED = 0.6
#: What the misspelled form of a labelled toxic document counts in the fit.
PLANTED = 0.5
#: Signs that the weights of Scorer.features may have; 0: either. A misspelled match counts no more than an exact one.
SIGNS = (1, -1, 0, -1, 1, 1)
MEMORY_WORDS, MEMORY_STATES = 400_000, 50_000
WORD = re.compile(r"\w+")

# Marks and words that show quotation or report, and words that address someone.
QUOTES = "\"'`«»‹›“”„‟‘’"
REPORT = frozenset("said says wrote called quote quoted word term slur report reported dit écrit mot terme sagte schrieb wort begriff dijo escribió palabra término".split())
ADDRESS = frozenset("you your yours u ur du dich dir ihr euch tu toi te vous tú usted ustedes vos".split())


def allowed_edits(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Automaton:
    """Levenshtein automaton over a trie of terms (matched whole) and stems (matched as beginnings), each with a weight."""

    def __init__(self, terms: dict[str, float], stems: dict[str, float]):
        self.child, self.allow, self.whole, self.stem, self.weight = [{}], [0], [-1], [0.0], [0.0]
        for t, is_stem in [*((t, False) for t in terms), *((t, True) for t in stems)]:
            node, most = 0, 0 if is_stem else allowed_edits(t)
            self.allow[0] = max(self.allow[0], most)
            for c in t:
                if c not in self.child[node]:
                    self.child[node][c] = len(self.child)
                    self.child.append({})
                    self.allow.append(0)
                    self.whole.append(-1)
                    self.stem.append(0.0)
                    self.weight.append(0.0)
                node = self.child[node][c]
                self.allow[node] = max(self.allow[node], most)
            if is_stem:
                self.stem[node] = stems[t]
            else:
                self.whole[node], self.weight[node] = most, terms[t]
        self._reset()

    def _reset(self) -> None:
        self.states, self.numbers, self.next, self.verdicts = [], {}, [], []
        self.start = self._number({0: 0})

    def _number(self, at: dict[int, int]) -> int:
        """at: fewest edits by node. Closed under leaving out a letter of the term."""
        todo = list(at.items())
        while todo:
            node, e = todo.pop()
            for n in self.child[node].values():
                if e + 1 <= self.allow[n] and at.get(n, 9) > e + 1:
                    at[n] = e + 1
                    todo.append((n, e + 1))
        key = frozenset(at.items())
        if key not in self.numbers:
            self.numbers[key] = len(self.states)
            self.states.append(at)
            self.next.append({})
            ends = [(e, -self.weight[n]) for n, e in at.items() if e <= self.whole[n]]
            self.verdicts.append((*min(ends, default=(-1, 0.0)), max((self.stem[n] for n, e in at.items() if e == 0), default=0.0)))
        return self.numbers[key]

    def _step(self, state: int, c: str) -> int:
        out: dict[int, int] = {}
        for node, e in self.states[state].items():
            if e + 1 <= self.allow[node] and out.get(node, 9) > e + 1:
                out[node] = e + 1
            for x, n in self.child[node].items():
                d = e + (x != c)
                if d <= max(self.allow[n], 0 if x != c else e) and out.get(n, 9) > d:
                    out[n] = d
        return self._number(out) if out else -1

    def match(self, word: str) -> tuple[int, float]:
        """Kind (0: none, 1: a term, 2: a misspelled term, 3: a stem) and weight."""
        if len(self.states) > MEMORY_STATES:
            self._reset()
        s, stem = self.start, 0.0
        for c in word:
            n = self.next[s].get(c)
            if n is None:
                n = self.next[s][c] = self._step(s, c)
            if n < 0:
                return (3, stem) if stem else (0, 0.0)
            s = n
            stem = max(stem, self.verdicts[s][2])
        edits, weight, _ = self.verdicts[s]
        return (1, -weight) if edits == 0 else (3, stem) if stem else (2, -weight) if edits > 0 else (0, 0.0)


class Model:
    """What fitting gives; small, and sent to the tasks with the function that uses it."""

    def __init__(self, terms=(), stems=(), exceptions=(), weights=None, base=0.1, report=(), address=()):
        self.terms, self.stems, self.exceptions = dict(terms), dict(stems), frozenset(exceptions)
        self.weights, self.base = weights, base
        self.report, self.address = REPORT.union(report), ADDRESS.union(address)


class Scorer:
    def __init__(self, model: Model):
        self.model, self.auto, self.known = model, Automaton(model.terms, model.stems), {}

    def kind(self, word: str) -> tuple[int, float]:
        k = self.known.get(word)
        if k is None:
            if len(self.known) > MEMORY_WORDS:
                self.known.clear()
            k = self.auto.match(word)
            if k[0] > 1 and word in self.model.exceptions:
                k = (0, 0.0)
            self.known[word] = k
        return k

    def matches(self, text: str):
        """(kind, weight, the words around, whether it stands in marks) of each match, and the number of words."""
        low = text.lower()
        hits = {w: k for w in set(WORD.findall(low)) if (k := self.kind(w))[0]}
        if not hits:
            return [], 0
        spans = [(m.start(), m.end(), m.group()) for m in WORD.finditer(low)]
        found = []
        for i, (a, b, w) in enumerate(spans):
            if k := hits.get(w):
                left, right = spans[max(0, i - WINDOW)][0], spans[min(len(spans) - 1, i + WINDOW)][1]
                # a mark may stand right after the last word of the window, or before its first
                in_marks = any(c in QUOTES for c in low[max(0, left - 1) : a]) and any(c in QUOTES for c in low[b : right + 1])
                found.append((*k, {x for _, _, x in spans[max(0, i - WINDOW) : i + WINDOW + 1] if x not in hits}, in_marks))
        return found, len(spans)

    def features(self, text: str) -> list[float]:
        """Logarithms of the sums of what is not quoted of all, of misspelled and of stem matches, of the quotation
        scores, and of the addressed ones, and what is not quoted a word."""
        found, words = self.matches(text)
        if not found:
            return [0.0] * 6
        n = [0.0, 0.0, 0.0]
        quoted = addressed = total = 0.0
        for kind, weight, around, in_marks in found:
            quote = min(1.0, IN_MARKS * in_marks + REPORTED * len(self.model.report & around))
            own = (1 - quote) * weight * (MISSPELLED if kind == 2 else 1.0)
            n[0] += own
            if kind > 1:
                n[kind - 1] += own
            quoted += quote
            addressed += own * (not self.model.address.isdisjoint(around))
            total += 1 - quote
        return [math.log1p(n[0]), math.log1p(n[1]), math.log1p(n[2]), math.log1p(quoted), math.log1p(addressed), total / words]

    def score(self, text: str) -> float:
        if self.model.weights is None:
            return self.model.base
        w = self.model.weights
        z = w[0] + sum(a * b for a, b in zip(w[1:], self.features(text), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _word_counts(batches):
    """(text, toxic) to documents by word and by beginning, summed for the task so far as memory allows."""

    def flush():
        keys = list(counts)
        cols = ([k[0] for k in keys], [k[1] for k in keys], [counts[k][0] for k in keys], [counts[k][1] for k in keys])
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.bool_()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], ["term", "stem", "clean", "toxic"])

    counts: dict = {}
    for b in batches:
        for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            words = set(WORD.findall((text or "").lower()))
            found = {(w, False) for w in words} | {(w[:n], True) for w in words for n in STEM_LENGTHS if n < len(w)}
            for k in found:
                counts.setdefault(k, [0, 0])[toxic] += 1
            if len(counts) > 300_000:
                yield flush()
    yield flush()


#: Signature values of a labelled text; near copies have BAND neighbouring ones in common.
SIGNATURE, BAND = 9, 3


def _signatures(batches):
    """(id, text, toxic) with hashes of each band of the smallest 3-word hashes under several multipliers: texts that share 0.8
    of their 3-word windows share a band with a chance of 0.88, those that share 0.3 with one of 0.08."""
    odd = np.array([xxhash.xxh64_intdigest(str(k)) | 1 for k in range(SIGNATURE)], np.uint64)
    for b in batches:
        bands = []
        for text in b.column(1).to_pylist():
            w = text.lower().split()
            h = np.array([xxhash.xxh64_intdigest(" ".join(w[i : i + 3])) for i in range(max(1, len(w) - 2))], np.uint64)
            own = (h[None, :] * odd[:, None]).min(axis=1)
            bands.append([xxhash.xxh64_intdigest(own[k : k + BAND].tobytes()) for k in range(0, SIGNATURE, BAND)])
        bands = np.array(bands, np.uint64).astype(np.int64).reshape(-1, SIGNATURE // BAND)
        yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(bands[:, k]) for k in range(bands.shape[1])]], ["_id", "_text", "_toxic", *[f"s{k}" for k in range(bands.shape[1])]])


def _around(model: "Model"):
    """(text, toxic) to (word, toxic, inside, every): how often a word stands within WINDOW words of a match, and how
    often at all, in the documents that have one."""

    def run(batches):
        s, counts = Scorer(model), {}
        for b in batches:
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = WORD.findall(text.lower())
                hits = {i for i, w in enumerate(words) if s.kind(w)[0]}
                near = {j for i in hits for j in range(i - WINDOW, i + WINDOW + 1)}
                for i, w in enumerate(words) if hits else ():
                    if i not in hits:
                        own = counts.setdefault((w, toxic), [0, 0])
                        own[0] += i in near
                        own[1] += 1
        keys = list(counts)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), *[pa.array([counts[k][j] for k in keys], pa.int64()) for j in (0, 1)]], ["w", "toxic", "inside", "every"])

    return run


def _learn_context(sample: DataFrame, model: "Model") -> tuple[list[str], list[str]]:
    """Words that stand nearer to the matches than chance explains, by the words of their own documents: in clean
    documents words of report, in toxic ones words of address."""
    near = sample.mapInArrow(_around(model), "w string, toxic int, inside long, every long").groupBy("w", "toxic").agg(F.sum("inside").alias("inside"), F.sum("every").alias("every"))
    near = written(near, "toxic-around")
    whole = near.groupBy("toxic").agg((F.sum("inside") / F.sum("every")).alias("share")).where("share < 1")
    some = near.where(F.col("every") >= MIN_SUPPORT).join(F.broadcast(whole), "toxic").withColumn("p", F.col("inside") / F.col("every"))
    odd = some.where(F.col("p") > F.col("share")).withColumn("surprise", _divergence(F.col("p"), F.col("share")) * F.col("every"))
    odd = odd.where(F.col("surprise") >= math.log(max(1, some.count()) / MAX_CHANCE)).select("w", "toxic").collect()
    return [r["w"] for r in odd if not r["toxic"]], [r["w"] for r in odd if r["toxic"]]


def _divergence(p: Column, share: Column) -> Column:
    """Of a share p from the base rate (Kullback and Leibler)."""
    part = lambda x, y: F.when(x > 0, x * F.log(x / y)).otherwise(0.0)
    return part(p, share) + part(1 - p, 1 - share)


def _choose(rows: list, clean: int, toxic: int) -> tuple[dict[str, float], dict[str, float]]:
    """rows: (term, stem, clean, toxic, endings), best first. Terms and stems with their log-likelihood ratios over 4. Of stems that extend each other, the longest that keeps 95 % of the shortest one's documents."""
    words = [r["term"] for r in rows if not r["stem"]]
    stems: list[str] = []
    counts = {r["term"]: r["toxic"] for r in rows if r["stem"] and r["endings"] >= STEM_ENDINGS}
    for short in sorted(counts, key=lambda s: (len(s), s)):
        if any(short.startswith(s) or s.startswith(short) for s in stems):
            continue
        stems.append(max((s for s in counts if s.startswith(short) and counts[s] >= 0.95 * counts[short]), key=len))
    weight = {(r["term"], r["stem"]): max(0.25, math.log((r["toxic"] + 0.5) / (toxic + 1)) - math.log((r["clean"] + 0.5) / (clean + 1))) / 4 for r in rows}
    return {w: weight[w, False] for w in words}, {s: weight[s, True] for s in stems}


def _regress(x: np.ndarray, y: np.ndarray, size: np.ndarray | None = None, signs: tuple[int, ...] = SIGNS) -> np.ndarray:
    """The intercept, then the weights: features whose weights have the wrong sign are left out. size: the weights of the rows."""
    size = np.ones(len(y)) if size is None else size

    def of(free: list[int], tied: bool) -> np.ndarray:
        z = x.copy()
        if tied:  # misspelled matches at their least: a share of the weight of all is taken back
            z[:, 0] -= (1 - LEAST_MISSPELLED) * x[:, 1]
        while True:
            got = _newton(z[:, free], y, size)
            wrong = [j for j, w in zip(free, got[1:], strict=True) if signs[j] * w < 0]
            if not wrong:
                out = np.zeros(1 + x.shape[1])
                out[[0, *[1 + j for j in free]]] = got
                if tied:
                    out[2] = -(1 - LEAST_MISSPELLED) * out[1]
                out[3] = max(out[3], -out[1])  # a stem match may count for nothing, but not against
                return out
            free = [j for j in free if j not in wrong]

    out = of(list(range(x.shape[1])), False)
    return out if out[2] >= -(1 - LEAST_MISSPELLED) * out[1] else of([j for j in range(x.shape[1]) if j != 1], True)


def _newton(x: np.ndarray, y: np.ndarray, size: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Logistic regression by Newton's method with a ridge on all but the intercept."""
    x = np.column_stack([np.ones(len(x)), x])
    w, r = np.zeros(x.shape[1]), np.full(x.shape[1], ridge * max(1.0, size.sum() ** 0.5))
    r[0] = 1e-6
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (size * p * (1 - p) + 1e-9)[:, None]) + np.diag(r), x.T @ (size * (y - p)) - r * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def slipped(scorer: Scorer, text: str) -> str:
    """The text with one letter changed, after the first, in each word that is a term and may be misspelled; which one follows from the word."""

    def slip(m: re.Match) -> str:
        w = m.group()
        if scorer.kind(w.lower())[0] != 1 or not allowed_edits(w):
            return w
        h = xxhash.xxh64_intdigest(w.lower())
        at = 1 + h % (len(w) - 1)
        other = next(c for c in "aeiornst"[h % 7 :] + "aeiornst" if c != w[at].lower())
        return w[:at] + other + w[at + 1 :]

    return WORD.sub(slip, text)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> Model:
    """Learns only from labelled rows that held_out() does not hold out. A document with several labels is toxic if any says so."""
    own = labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).cast("long").alias("_id")).agg((F.max("toxic") >= 1).cast("int").alias("_toxic"))
    own = written(own.orderBy(F.xxhash64("_id"), "_id").limit(rows), "toxic-labels")
    text = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    # own has at most `rows` rows, whatever the size of the corpus
    bands = [f"s{k}" for k in range(SIGNATURE // BAND)]
    sample = text.join(F.broadcast(own), "_id").select("_id", "_text", "_toxic").mapInArrow(_signatures, "_id long, _text string, _toxic int, " + ", ".join(f"{s} long" for s in bands))
    sample = written(sample, "toxic-signed")
    rest = F.struct("_id", "_text", *bands)
    for s in bands:
        sample = sample.groupBy(F.col(s).alias("_band"), "_toxic").agg(F.min(rest).alias("_row")).select("_toxic", "_row.*")
    sample = written(sample.select("_text", "_toxic"), "toxic-sample")
    n, toxic = sample.agg(F.count("*"), F.coalesce(F.sum("_toxic"), F.lit(0))).first()
    share = (toxic + 0.5) / (n + 1)
    if not toxic or toxic == n:
        return Model(base=share)
    counts = sample.mapInArrow(_word_counts, "term string, stem boolean, clean long, toxic long").groupBy("term", "stem").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counts = written(counts, "toxic-words")
    odd = counts.where(F.col("toxic") >= MIN_SUPPORT).withColumn("p", F.col("toxic") / (F.col("toxic") + F.col("clean")))
    # chance of at least this share by the base rate (Chernoff), for all candidates
    kl = _divergence(F.col("p"), F.lit(share))
    odd = odd.where((F.col("p") >= F.when(F.col("stem"), MIN_STEM_SHARE).otherwise(MIN_SHARE)) & (F.col("p") > share)).withColumn("surprise", kl * (F.col("toxic") + F.col("clean")))
    candidates = max(1, odd.count() + counts.where(F.col("toxic") >= MIN_SUPPORT).count())
    odd = odd.where(F.col("surprise") >= math.log(candidates / MAX_CHANCE))
    words = counts.where(~F.col("stem") & (F.col("toxic") > 0)).select(F.col("term").alias("w"))
    ends = words.select(F.explode(F.array(*[F.when(F.char_length("w") > k, F.substring("w", 1, k)) for k in STEM_LENGTHS])).alias("term")).where("term is not null").groupBy("term").agg(F.count("*").alias("endings"))
    best = odd.join(ends, "term", "left").select("term", "stem", "clean", "toxic", F.coalesce("endings", F.lit(0)).alias("endings"), "surprise").orderBy(F.desc("surprise"), "term")
    terms, stems = _choose(best.collect(), n - toxic, toxic)
    near = Model(terms, stems)

    def clean_words(batches):
        auto = Automaton(near.terms, near.stems)
        for b in batches:
            yield b.filter(pa.array([auto.match(w)[0] == 2 for w in b.column(0).to_pylist()], pa.bool_()))

    # of the sample's words, those of mostly clean documents that the automaton would take for a term
    plain = counts.where(~F.col("stem") & (F.col("clean") > 0) & (F.col("toxic") < MIN_SHARE * (F.col("toxic") + F.col("clean")))).select("term", "clean")
    plain = {r["term"]: r["clean"] for r in plain.mapInArrow(clean_words, "term string, clean long").collect()}
    model = Model(terms, stems, plain)
    report, address = _learn_context(sample, model)
    model = Model(terms, stems, plain, report=report, address=address)
    # a clean document may not owe an exception to itself: new documents' words are not among the exceptions either
    others = Model(terms, stems, [w for w, n in plain.items() if n > 1], report=report, address=address)
    got = sample.mapInArrow(_features([others, model]), "f array<double>, y double, size double").toPandas()
    model.weights = _regress(np.stack(got["f"].to_numpy()), got["y"].to_numpy(), got["size"].to_numpy()).tolist()
    return model


def _features(models: list[Model]):
    """models: for clean and for toxic documents. A toxic document with terms that may be misspelled gives two rows, which weigh one together."""

    def run(batches):
        s = [Scorer(m) for m in models]
        for b in batches:
            rows = []
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                planted = slipped(s[1], text) if toxic else text
                for t in (text,) if planted == text else (text, planted):
                    rows.append((s[toxic].features(t), float(toxic), 1.0 if planted == text else PLANTED if t is planted else 1 - PLANTED))
            cols = list(zip(*rows, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.list_(pa.float64())), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.float64())], ["f", "y", "size"])

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """All columns of docs, then score (double) and predicted (int); they replace columns of these names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # terms and weights, bounded by the labelled rows

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        s = Scorer(shared.value)
        for part in parts:
            yield pd.Series([s.score(t or "") for t in part], dtype="float64")

    return docs.withColumn("score", scored(F.col(text_col))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


__all__ = ["Automaton", "Model", "Scorer", "fit", "held_out", "score"]
