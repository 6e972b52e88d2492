"""Toxicity by a learnt lexicon, misspellings included.

Terms that mark toxic documents are learnt from labelled rows and kept in a trie. The Levenshtein automata of
its terms are intersected with the trie into one deterministic automaton, built state by state as words ask for it;
all words of a slice run through it side by side. What stands around a hit, in a window of words, tells
quotation and report from abuse. A logistic regression turns the hits of a document into its score.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import annotate, column, read_table, table, text_bytes

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Labelled rows that are learnt from, of each label at most, chosen by a hash of their id.
LEARNT = 10_000
#: Terms of the lexicon and words kept from being taken for a misspelt term, at most.
TERMS, EXCEPTIONS = 300, 3_000
#: Least toxic documents with a term, and least standard errors of its log odds above 0.
SUPPORT, CERTAIN = 3, 3.0
#: Longest term; longer words are no terms.
LONGEST = 32
#: Edits allowed in a term, by its least length.
EDITS = ((9, 2), (4, 1), (1, 0))
#: What a hit counts after so many edits.
EXACT = (1.0, 0.7, 0.4)
#: Words on either side of a hit that are its context, and what a hit counts in a quotation, by a word of
#: report, and by a word that speaks to the reader.
WINDOW, QUOTED, REPORTED, AIMED = 8, 0.2, 0.5, 1.5

# Quotation marks, and words of report and address in four languages.
QUOTES = "\"“”„«»"
REPORTS = "said says called calls wrote writes quoted quote dit écrit appelle sagte schrieb nannte zitat dijo escribió llamó cita".split()
ADDRESSES = "you your youre tu toi vous votre ton du dich dir dein ihr euch tú ti usted ustedes vosotros".split()
# Signs that stand for letters.
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}

_TERM, _REPORT, _ADDRESS, _CLEAN = range(4)
#: Mass of hits in all, in the densest window, in quotations, by misspelt terms, and for 100 words.
FEATURES = ["mass", "dense", "quoted", "misspelt", "share"]


def allowed(term: str) -> int:
    return next(e for least, e in EDITS if len(term) >= least)


class Automaton:
    """Deterministic automaton of all words within the allowed edits of a term.

    A state is the set of trie nodes that the letters so far may have reached, each with its fewest edits.
    ``terms`` is a list of (word, kind, weight); other kinds than terms are met by the exact word only.
    """

    def __init__(self, terms: list[tuple[str, int, float]]):
        self.children, self.ends, self.reach, self.terms = [{}], [[]], [0], terms
        for i, (word, kind, _) in enumerate(terms):
            edits = allowed(word) if kind == _TERM else 0
            node = 0
            for c in word:
                self.reach[node] = max(self.reach[node], edits)
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                    self.reach.append(0)
                node = self.children[node][c]
            self.reach[node] = max(self.reach[node], edits)
            self.ends[node].append((i, edits))
        self.letters = {c: k + 1 for k, c in enumerate(sorted({c for w, _, _ in terms for c in w}))}
        self.names = [None, *sorted(self.letters)]  # class 0: letters of no term
        self.known, self.sets = {}, []
        self.next = np.zeros((0, len(self.names)), np.int32)
        self.accept = []
        self.state({})  # dead
        self.state(self.closed({0: 0}))

    def closed(self, nodes: dict[int, int]) -> dict[int, int]:
        """With the nodes reached by leaving out letters of a term."""
        todo = list(nodes.items())
        while todo:
            node, e = todo.pop()
            if nodes[node] == e:
                for child in self.children[node].values():
                    if e + 1 <= self.reach[child] and nodes.get(child, 99) > e + 1:
                        nodes[child] = e + 1
                        todo.append((child, e + 1))
        return nodes

    def state(self, nodes: dict[int, int]) -> int:
        key = frozenset(nodes.items())
        if key not in self.known:
            self.known[key] = len(self.sets)
            self.sets.append(nodes)
            met = [(i, e) for node, e in nodes.items() for i, most in self.ends[node] if e <= most]
            kinds = {self.terms[i][1] for i, e in met}
            best = max(((self.terms[i][2] * EXACT[e], -e, -i) for i, e in met if self.terms[i][1] == _TERM), default=None)
            if best and _CLEAN in kinds and best[1] < 0:
                best = None  # a word of its own, not a misspelt term
            self.accept.append((best[0], -best[1], -best[2]) if best else (0.0, 0, -1))
            self.accept[-1] += (_REPORT in kinds, _ADDRESS in kinds)
            if len(self.next) < len(self.sets):
                more = np.full((max(64, len(self.next)), len(self.names)), -1, np.int32)
                self.next = np.concatenate([self.next, more])
            if not nodes:
                self.next[self.known[key]] = self.known[key]
        return self.known[key]

    def step(self, state: int, letter: int) -> int:
        c, out = self.names[letter], {}
        for node, e in self.sets[state].items():
            for own, child in self.children[node].items():
                cost = e if own == c else e + 1
                if cost <= self.reach[child] and out.get(child, 99) > cost:
                    out[child] = cost
            if e + 1 <= self.reach[node] and out.get(node, 99) > e + 1:
                out[node] = e + 1
        return self.state(self.closed(out))

    def run(self, letters: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """State of each word after its last letter; ``letters`` are classes."""
        states = np.ones(len(starts), np.int32)
        live, k = np.flatnonzero(lengths > 0), 0
        while len(live):
            letter = letters[starts[live] + k]
            after = self.next[states[live], letter]
            if (after < 0).any():
                pairs = np.unique(states[live[after < 0]].astype(np.int64) * len(self.names) + letter[after < 0])
                for pair in pairs:
                    s, c = divmod(int(pair), len(self.names))
                    to = self.step(s, c)
                    self.next[s, c] = to
                after = self.next[states[live], letter]
            states[live] = after
            k += 1
            live = live[(after > 0) & (lengths[live] > k)]
        return states


class Words:
    """Words (runs of letters and of signs for letters, with a letter) of a slice of texts, folded to small letters."""

    def __init__(self, texts: pa.Array):
        body, offsets = text_bytes(texts)
        self.codes = np.frombuffer(body.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
        self.cuts = np.concatenate([[0], np.cumsum((body & 0xC0) != 0x80)])[offsets]
        present = np.flatnonzero(np.bincount(self.codes)) if len(self.codes) else np.empty(0, np.int64)
        fold, real = np.zeros(int(present[-1]) + 1 if len(present) else 1, np.uint32), []
        for c in present:
            letter = chr(c)
            if letter.isalpha():
                fold[c] = ord(letter.lower()[0])
                real.append(c)
            elif letter in SIGNS:
                fold[c] = ord(SIGNS[letter])
        self.folded = fold[self.codes]
        is_real = np.zeros(len(fold), bool)
        is_real[real] = True
        inside = self.folded > 0
        first, last = inside.copy(), inside.copy()
        if len(inside):
            first[1:] &= ~inside[:-1]
            last[:-1] &= ~inside[1:]
            cuts = self.cuts[1:-1]
            cuts = cuts[(cuts > 0) & (cuts < len(inside))]
            first[cuts] |= inside[cuts]
            last[cuts - 1] |= inside[cuts - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        letters = np.concatenate([[0], np.cumsum(is_real[self.codes])])
        true = letters[ends] > letters[starts]
        self.starts, self.ends = starts[true], ends[true]
        self.bounds = np.searchsorted(self.starts, self.cuts)

    def classes(self, letters: dict[str, int]) -> np.ndarray:
        top = int(self.folded.max()) if len(self.folded) else 0
        place = np.zeros(top + 1, np.int64)
        for c, k in letters.items():
            if ord(c) <= top:
                place[ord(c)] = k
        return place[self.folded]

    def distinct(self, i: int) -> list[str]:
        """Different words of text ``i`` that are short enough for a term."""
        text = self.folded[self.cuts[i] : self.cuts[i + 1]].tobytes().decode("utf-32-le", "replace")
        lo = self.cuts[i]
        return sorted({text[a - lo : b - lo] for a, b in zip(self.starts[self.bounds[i] : self.bounds[i + 1]], self.ends[self.bounds[i] : self.bounds[i + 1]]) if b - a <= LONGEST})


@dataclass
class Hits:
    """Hits of a slice: index of text and word, mass, edits, term, whether quoted."""

    text: np.ndarray
    word: np.ndarray
    mass: np.ndarray
    edits: np.ndarray
    term: np.ndarray
    quoted: np.ndarray


def find_hits(words: Words, automaton: Automaton) -> Hits:
    states = automaton.run(words.classes(automaton.letters), words.starts, words.ends - words.starts)
    accept = np.array(automaton.accept, np.float64)
    at = np.flatnonzero(accept[states, 0] > 0)
    score, edits, term = accept[states[at], 0], accept[states[at], 1].astype(np.int64), accept[states[at], 2].astype(np.int64)
    text = np.searchsorted(words.bounds, at, "right") - 1
    # Context: words within the window, inside the same text.
    lo, hi = np.maximum(at - WINDOW, words.bounds[text]), np.minimum(at + WINDOW + 1, words.bounds[text + 1])
    near = lambda k: (lambda c: c[hi] > c[lo])(np.concatenate([[0], np.cumsum(accept[states, k])]))
    # A quotation: an odd number of marks since the line began and a further one before it ends.
    marks = np.concatenate([[0], np.cumsum(np.isin(words.codes, [ord(c) for c in QUOTES]))])
    breaks = np.unique(np.concatenate([words.cuts, np.flatnonzero(words.codes == 10)]))
    line = np.searchsorted(breaks, words.starts[at], "right")
    begin, end = breaks[line - 1], breaks[np.minimum(line, len(breaks) - 1)]
    before = marks[words.starts[at]] - marks[begin]
    quoted = (before % 2 == 1) & (marks[end] > marks[words.starts[at]])
    mass = score * np.where(quoted, QUOTED, 1.0) * np.where(near(3), REPORTED, 1.0) * np.where(near(4), AIMED, 1.0)
    return Hits(text, at, mass, edits, term, quoted)


def features(words: Words, hits: Hits) -> np.ndarray:
    """One row per text, see FEATURES; zeros without hits."""
    n = len(words.cuts) - 1
    total = lambda v: np.bincount(hits.text, v, minlength=n)
    open_mass = np.where(hits.quoted, 0.0, hits.mass)
    sums = np.concatenate([[0], np.cumsum(hits.mass)])
    first = np.maximum(np.searchsorted(hits.word, hits.word - WINDOW, "left"), np.searchsorted(hits.text, hits.text, "left"))
    dense = np.zeros(n)
    np.maximum.at(dense, hits.text, sums[np.arange(1, len(hits.word) + 1)] - sums[first])
    size = np.maximum(np.diff(words.bounds), 1)
    out = np.stack([total(open_mass), dense, total(np.where(hits.quoted, hits.mass, 0.0)), total(np.where(hits.edits > 0, open_mass, 0.0)), 100 * total(open_mass) / size], axis=1)
    return np.log1p(out)


@dataclass
class Model:
    """A lexicon (word, kind, weight) and the regression; without a lexicon every score is ``base``."""

    terms: list[tuple[str, int, float]] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(len(FEATURES)))
    intercept: float = 0.0
    base: float = 0.0

    def scores(self, rows: np.ndarray) -> np.ndarray:
        if not self.terms:
            return np.full(len(rows), self.base)
        return 1 / (1 + np.exp(-np.clip(rows @ self.weights + self.intercept, -50, 50)))


def held_out(id):
    """Whether CRC-32 of the id as text, modulo 5, is 0; a null id is not held out, nor learnt from."""
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def part_of(id, n: int, salt: int):
    return F.pmod(F.xxhash64(id.cast("string"), F.lit(salt)), F.lit(n))


def _log_odds(a, b, n1: int, n0: int):
    """(log odds of a term between toxic and clean documents, its standard error)"""
    a, b = a + 0.5, b + 0.5
    odds = F.log(a / (n1 + 1 - a)) - F.log(b / (n0 + 1 - b))
    return odds, F.sqrt(1 / a + 1 / b)


def feature_rows(docs: DataFrame, terms: list, keep: list[str]) -> DataFrame:
    def make():
        automaton = Automaton(terms)

        def run(texts):
            words = Words(texts)
            return [pa.array(c) for c in features(words, find_hits(words, automaton)).T]

        return run

    return annotate(docs, "text", ", ".join(f"{f} double" for f in FEATURES), make, keep)


def learn(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", learnt: int = LEARNT) -> Model:
    """A model from labelled rows that are not held out: at most ``learnt`` of each label.

    Two thirds give the lexicon, the rest the regression. Repeated labels of an id: toxic if any is. Texts that
    repeat are learnt once. Rows without id, text or label are not learnt from. Without toxic and clean
    rows, or terms, the model gives the share of toxic rows (0 without rows) to every text.
    """
    spark = docs.sparkSession
    own = labels.select(column(labels, id).alias("id"), column(labels, label).alias("label")).where("id is not null and label is not null").where(~held_out(F.col("id")))
    own = own.groupBy("id").agg(F.max((F.col("label") == 1).cast("int")).alias("label"))
    sizes = {r[0]: r[1] for r in own.groupBy("label").count().collect()}
    share = F.when(F.col("label") == 1, F.lit(int(min(1.0, learnt / sizes.get(1, learnt)) * 1_000_000))).otherwise(int(min(1.0, learnt / sizes.get(0, learnt)) * 1_000_000))
    chosen = own.where(part_of(F.col("id"), 1_000_000, 7) < share)
    texts = docs.select(column(docs, id).alias("id"), column(docs, text).cast("string").alias("text")).where("text is not null")
    # About 2 * learnt ids: small whatever the tables.
    rows = texts.join(F.broadcast(chosen), "id").groupBy(F.sha2("text", 256).alias("key")).agg(F.max("text").alias("text"), F.max("label").alias("label"))
    rows = table(rows, "labelled")
    counts = {(r[0], r[1]): r[2] for r in rows.groupBy("label", (part_of(F.col("key"), 3, 11) < 2).alias("lexicon")).count().collect()}
    total = sum(counts.values())
    base = sum(n for (label, _), n in counts.items() if label == 1) / total if total else 0.0
    if not all(counts.get((a, b)) for a in (0, 1) for b in (False, True)):
        return Model(base=base)
    for_terms, for_weights = rows.where(part_of(F.col("key"), 3, 11) < 2), rows.where(part_of(F.col("key"), 3, 11) == 2)
    n1, n0 = counts[1, True], counts[0, True]

    def make():
        def run(texts):
            words = Words(texts)
            return [pa.array([words.distinct(i) for i in range(len(texts))], pa.list_(pa.string()))]

        return run

    seen = annotate(for_terms, "text", "words array<string>", make, ["label"]).select("label", F.explode("words").alias("word"))
    seen = seen.groupBy("word").agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b"))
    odds, error = _log_odds(F.col("a"), F.col("b"), n1, n0)
    seen = table(seen.where("a + b > 1").withColumn("odds", odds).withColumn("error", error), "words")
    found = seen.where((F.col("a") >= SUPPORT) & (F.col("odds") >= CERTAIN * F.col("error")) & (F.length("word") > 2))
    lexicon = [(r["word"], _TERM, float(r["odds"] - 1.64 * r["error"])) for r in found.orderBy((F.col("odds") / F.col("error")).desc(), "word").limit(TERMS).collect()]
    if not lexicon:
        return Model(base=base)

    def make_edits():
        automaton = Automaton(lexicon)

        def run(values):
            words = Words(values)
            hits = find_hits(words, automaton)
            edits = np.full(len(values), -1)
            edits[hits.text] = hits.edits
            return [pa.array(edits)]

        return run

    near = annotate(seen, "word", "edits long", make_edits)
    clean = near.where("edits > 0 and b > 1").where(F.col("odds") < CERTAIN * F.col("error"))
    known = [(r["word"], _CLEAN, 0.0) for r in clean.orderBy(F.col("b").desc(), "word").limit(EXCEPTIONS).collect()]
    used = {w for w, _, _ in lexicon}
    context = [(w, kind, 0.0) for kind, group in ((_REPORT, REPORTS), (_ADDRESS, ADDRESSES)) for w in group if w not in used]
    terms = lexicon + known + context
    weights, intercept = fitted(feature_rows(for_weights, terms, ["label"]), sizes, counts)
    return Model(terms, weights, intercept, base)


def fitted(rows: DataFrame, sizes: dict, counts: dict) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression; rows count as many as their label has in all."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.linalg import DenseMatrix

    weight = F.when(F.col("label") == 1, float(sizes[1] / counts[1, False])).otherwise(float(sizes[0] / counts[0, False]))
    rows = table(rows.withColumn("weight", weight), "features")
    packed = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows.withColumn("label", F.col("label").cast("double")))
    # More open abuse never lowers a score.
    least = DenseMatrix(1, len(FEATURES), [-1e3 if f == "quoted" else 0.0 for f in FEATURES])
    model = LogisticRegression(weightCol="weight", regParam=1e-3, standardization=False, maxIter=60, lowerBoundsOnCoefficients=least).fit(packed)
    return model.coefficients.toArray(), float(model.intercept)


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, spans: bool = False) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5); ``spans`` adds ``hits``.

    ``hits``: (start, end) in code points, the term, its edits, whether quoted, and what the hit counts. A null or
    empty text has no hits and the score of a text without any. Existing columns of these names are replaced.
    """
    own_names = [t[0] for t in model.terms]

    def make():
        automaton = Automaton(model.terms) if model.terms else None

        def run(texts):
            if automaton is None:
                values = model.scores(np.zeros((len(texts), len(FEATURES))))
                return [pa.array(values), pa.array((values >= 0.5).astype(np.int32)), *([pa.array([[]] * len(texts), hit_type)] if spans else [])]
            words = Words(texts)
            hits = find_hits(words, automaton)
            values = model.scores(features(words, hits))
            made = [pa.array(values), pa.array((values >= 0.5).astype(np.int32))]
            if spans:
                starts, ends = words.starts[hits.word] - words.cuts[hits.text], words.ends[hits.word] - words.cuts[hits.text]
                each = [pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array([own_names[t] for t in hits.term], pa.string()), pa.array(hits.edits, pa.int32()), pa.array(hits.quoted), pa.array(hits.mass)]
                rows = pa.StructArray.from_arrays(each, fields=list(hit_type.value_type))
                made.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(hits.text, np.arange(len(texts) + 1)), pa.int32()), rows))
            return made

        return run

    hit_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("term", pa.string()), ("edits", pa.int32()), ("quoted", pa.bool_()), ("mass", pa.float64())]))
    results = "score double, predicted int" + (", hits array<struct<start:int,end:int,term:string,edits:int,quoted:boolean,mass:double>>" if spans else "")
    return annotate(docs, text, results, make, keep)


def op13_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    out = score(docs, learn(docs, read_table(spark, folder, "labels")), keep=["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
