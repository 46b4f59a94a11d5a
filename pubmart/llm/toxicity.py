"""Toxicity by weak supervision (operator 12).

Voters are lexicons and patterns that look at a whole text and fire or stay silent. One lexicon is
a fixed list; the others are induced: words and word stems that the training labels tie to toxic
texts, dealt to several lexicons. A generative label model (class, and a tree of dependences
between voters given the class, chosen by conditional mutual information) is fitted by expectation
maximisation on the counts of vote patterns of **all** documents, with the labelled patterns held at
their labels. It gives each voter's accuracy, the correlations, and a posterior label for every
vote pattern. A linear classifier over the terms and votes is then trained on posterior labels.

Bounds: terms are induced and the classifier is trained on at most ``LABELLED`` labelled documents,
those of smallest hash; at most ``TERMS`` terms are kept; there are 2**len(VOTERS) vote patterns at
most, so that this is also what the driver holds. Scoring reads every text and shuffles nothing.

Defined results: a null text counts as empty. Null labels are left out, several labels of one
document count as their majority, a tie as 1. Without labels of both classes every score is the
smoothed share of label 1, 0.5 without any. Repeated rows are scored each on its own; a null doc_id
is not held out and never learnt from. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pubmart.llm.common import bounded_batches, chunks_of, per_text, staged, whole_texts
from pubmart.llm.quality import FOLDS, remainder

LABELLED = 20_000
TERMS = 4000
STEMS = (4, 5, 6)
LEAST_DOCUMENTS = 4
#: Terms of a voter are so many times likelier in one class than in the other.
LEAST_RATIO = 8.0
PASSES = 25
STEPS = 150
RIDGE = 1e-4
THRESHOLD = 0.5
KNOWN = 300_000

# A public list of insults in the four languages.
INSULTS = frozenset(
    "idiot idiots moron morons stupid loser losers scum trash pathetic worthless disgusting clown dumb fool bastard "
    "idiotin dumm dummkopf trottel abschaum arschloch versager widerlich "
    "idiote imbécile stupide crétin connard salaud ordure minable "
    "idiota imbécil estúpido tonto basura escoria asqueroso payaso".split()
)

VOTERS = (
    "listed words_1 words_2 words_3 stems_4 stems_5 stems_6 several_terms dense_terms clean_words shouting exclaiming".split()
)
_EDGES = ".,;:!?\"'()[]{}«»¿¡…-–—"
_SHOUT = re.compile(r"\b[A-ZÄÖÜÀÉÈÑ]{4,}\b")


def term_kinds(word: str) -> list[str]:
    """A word's terms: the word itself and its stems, told apart by their first letter."""
    return [f"w{word}"] + [f"{k}{word[:k]}" for k in STEMS if len(word) >= k]


def words_of(text: str) -> list[str]:
    return [x for x in (w.strip(_EDGES) for w in text.lower().split()) if x]


class Lexicons:
    """Terms with the class they point to, and the voters built on them."""

    def __init__(self, terms: list[tuple[str, float]]):
        """``terms``: (term, log ratio), strongest first; positive ratios point to toxic texts."""
        self.names = [t for t, _ in terms]
        self.place = {t: i for i, t in enumerate(self.names)}
        self.toxic = np.array([r > 0 for _, r in terms], dtype=bool)
        voter = np.full(len(terms), -1)
        dealt = 0
        for i, (term, ratio) in enumerate(terms):
            if ratio < 0:
                voter[i] = VOTERS.index("clean_words")
            elif term[0] == "w":
                voter[i] = 1 + dealt % 3
                dealt += 1
            else:
                voter[i] = VOTERS.index(f"stems_{term[0]}")
        self.voter = voter

    def reader(self):
        """A function from a text to its term numbers and its vote pattern."""
        known: dict[str, tuple[int, ...]] = {}
        place, toxic, voter = self.place, self.toxic.tolist(), self.voter.tolist()
        clean = VOTERS.index("clean_words")

        def read(text: str) -> tuple[list[int], int]:
            words = words_of(text)
            if len(known) > KNOWN:
                known.clear()
            found: set[int] = set()
            listed = False
            for word in set(words):
                own = known.get(word)
                if own is None:
                    own = known[word] = tuple(place[t] for t in term_kinds(word) if t in place)
                found.update(own)
                listed = listed or word in INSULTS
            votes, bad, good = int(listed), 0, 0
            for i in found:
                if toxic[i]:
                    votes |= 1 << voter[i]
                    bad += 1
                else:
                    good += 1
            votes |= (bad >= 3) << VOTERS.index("several_terms")
            votes |= (bad >= 1 and 50 * bad >= len(words)) << VOTERS.index("dense_terms")
            votes |= (good >= 2) << clean
            votes |= (len(_SHOUT.findall(text)) * 10 > max(1, len(words))) << VOTERS.index("shouting")
            votes |= (text.count("!") * 20 > max(1, len(words))) << VOTERS.index("exclaiming")
            return sorted(found), votes

        return read


class LabelModel:
    """P(class) and P(vote | vote of the parent voter, class) for a tree of voters."""

    def __init__(self, voters: int):
        self.voters = voters
        codes = np.arange(2**voters)
        self.bits = (codes[:, None] >> np.arange(voters)) & 1

    def fit(self, counts: np.ndarray, labelled: np.ndarray) -> LabelModel:
        """``counts`` by pattern over all texts; ``labelled`` [class, pattern] over labelled ones."""
        self._estimate(labelled)
        for _ in range(PASSES):
            chance = self.posterior()
            self._estimate(labelled + counts * np.stack([1 - chance, chance]))
        return self

    def _estimate(self, weights: np.ndarray) -> None:
        total = weights.sum(axis=1)
        self.prior = (total + 1) / (total.sum() + 2)
        on = np.stack([1 - self.bits, self.bits])
        # joint[c, j, a, k, b]: voter j says a and voter k says b in class c
        joint = np.einsum("cp,apj,bpk->cjakb", weights, on, on, optimize=True) + 0.25
        joint /= joint.sum(axis=(2, 4), keepdims=True)
        single = joint.sum(axis=4)[:, :, :, 0]
        self.accuracy = single[:, :, 1]
        expected = single[:, :, :, None, None] * single[:, None, None, :, :]
        shared = (joint * np.log(joint / expected)).sum(axis=(2, 4))
        self.dependence = np.einsum("c,cjk->jk", self.prior, shared)
        self.parent = [-1] * self.voters
        inside, order = {0}, [0]
        while len(inside) < self.voters:
            j, k = max(((j, k) for j in inside for k in range(self.voters) if k not in inside), key=lambda e: (self.dependence[e], -e[1]))
            self.parent[k] = j
            inside.add(k)
            order.append(k)
        self.tables = [
            np.log(single[:, k] if p < 0 else joint[:, p, :, k, :] / single[:, p, :, None])
            for k, p in enumerate(self.parent)
        ]

    def posterior(self) -> np.ndarray:
        """P(toxic) of each vote pattern."""
        log = np.repeat(np.log(self.prior)[:, None], len(self.bits), axis=1)
        for k, (p, table) in enumerate(zip(self.parent, self.tables, strict=True)):
            own = self.bits[:, k]
            log += table[:, own] if p < 0 else table[:, self.bits[:, p], own]
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -60, 60)))


class Linear:
    """Logistic regression over term and vote presence."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        if not rows:
            return np.zeros(0)
        lengths = np.array([len(r) for r in rows])
        at = np.repeat(np.arange(len(rows)), lengths)
        margin = self.bias + np.bincount(at, self.weights[np.concatenate(rows)] / scale(lengths)[at], len(rows))
        return 1 / (1 + np.exp(-np.clip(margin, -60, 60)))


def scale(lengths: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(1, lengths))


def train_linear(rows: list[np.ndarray], targets: np.ndarray, width: int) -> Linear:
    """Minimise the cross entropy to soft targets by Adam on the whole (bounded) table."""
    lengths = np.array([len(r) for r in rows])
    at = np.repeat(np.arange(len(rows)), lengths)
    column = np.concatenate(rows) if len(rows) else np.zeros(0, dtype=np.int64)
    value = 1 / scale(lengths)[at]
    share = min(max(targets.mean(), 1e-3), 1 - 1e-3)
    w, bias = np.zeros(width), float(np.log(share / (1 - share)))
    first, second = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, STEPS + 1):
        margin = bias + np.bincount(at, w[column] * value, len(rows))
        slope = 1 / (1 + np.exp(-np.clip(margin, -60, 60))) - targets
        gradient = np.append(np.bincount(column, slope[at] * value, width) / len(rows) + RIDGE * w, slope.mean())
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        move = 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        w -= move[:-1]
        bias -= float(move[-1])
    return Linear(w, bias)


class Detector:
    """All that scoring needs: lexicons, posteriors by vote pattern and the linear classifier."""

    def __init__(self, lexicons: Lexicons, posterior: np.ndarray, linear: Linear):
        self.lexicons, self.posterior, self.linear = lexicons, posterior, linear

    def reader(self):
        read, terms = self.lexicons.reader(), len(self.lexicons.names)
        return lambda text: row_of(*read(text), terms)


def row_of(found: list[int], votes: int, terms: int) -> tuple[np.ndarray, int]:
    """The columns that are 1: terms first, then voters."""
    fired = [terms + j for j in range(len(VOTERS)) if votes >> j & 1]
    return np.array(found + fired, dtype=np.int64), votes


def _labelled_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, label and text of at most LABELLED labelled training documents."""
    chosen = (
        labels.select("doc_id", F.col("toxic").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & (remainder(F.col("doc_id"), FOLDS) != 0))
        .groupBy("doc_id")
        .agg((F.avg("label") >= 0.5).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(LABELLED)
    )
    # at most LABELLED rows of an id and a flag: a proven bound
    return whole_texts(docs).join(F.broadcast(chosen), "doc_id")


def _terms(texts: DataFrame) -> list[tuple[str, float]]:
    """The terms of the labelled texts that tell the classes apart, strongest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column("text").to_pylist()
            labels = batch.column("label").to_pylist()
            for part in chunks_of(every):
                counts: dict[str, list[int]] = {}
                for text, label in zip(every[part], labels[part], strict=True):
                    for term in {t for w in set(words_of(text)) for t in term_kinds(w)}:
                        counts.setdefault(term, [0, 0])[label] += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(counts), type=pa.string()), *(pa.array([c[k] for c in counts.values()], type=pa.int64()) for k in (0, 1))],
                    names=["term", "clean", "toxic"],
                )

    bounded_batches(texts.sparkSession)
    size = {r["label"]: r["n"] for r in texts.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(size) < 2:
        return []
    counts = texts.select("text", "label").mapInArrow(run, "term string, clean long, toxic long")
    counts = counts.groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    ratio = F.log((F.col("toxic") + 0.5) / (size[1] + 1)) - F.log((F.col("clean") + 0.5) / (size[0] + 1))
    strong = (
        counts.where(F.col("toxic") + F.col("clean") >= LEAST_DOCUMENTS)
        .select("term", ratio.alias("ratio"), F.greatest(F.col("toxic") / size[1], F.col("clean") / size[0]).alias("share"))
        .where(F.abs("ratio") >= float(np.log(LEAST_RATIO)))
        .orderBy(F.desc(F.abs("ratio") * F.col("share")), "term")
        .limit(TERMS)
    )
    return [(r["term"], r["ratio"]) for r in strong.collect()]


def _patterns(docs: DataFrame, lexicons: Lexicons) -> np.ndarray:
    """Documents by vote pattern, over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = lexicons.reader()
        counts = np.zeros(2 ** len(VOTERS), dtype=np.int64)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                counts[read(text)[1]] += 1
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], names=["votes", "n"])

    bounded_batches(docs.sparkSession)
    counts = whole_texts(docs).select("text").mapInArrow(run, "votes long, n long")
    total = np.zeros(2 ** len(VOTERS))
    for r in counts.groupBy("votes").agg(F.sum("n").alias("n")).collect():
        total[r["votes"]] = r["n"]
    return total


def learned(docs: DataFrame, labels: DataFrame) -> Detector:
    """Induce the lexicons, fit the label model and train the classifier on its posteriors."""
    texts = staged(_labelled_texts(docs, labels), "labelled-texts")
    lexicons = Lexicons(_terms(texts))
    terms = len(lexicons.names)

    def start():
        read = lexicons.reader()

        def of_texts(every):
            rows = [row_of(*read(t), terms) for t in every]
            return [[r.tolist() for r, _ in rows], [v for _, v in rows]]

        return of_texts

    # a document with several rows is learnt from once: from its row of smallest columns
    read = per_text(texts, start, {"columns": "array<int>", "votes": "long"})
    rows = read.groupBy("doc_id", "label").agg(F.min(F.struct("columns", "votes")).alias("row")).orderBy("doc_id").collect()
    votes = np.array([r["row"]["votes"] for r in rows], dtype=np.int64)
    label = np.array([r["label"] for r in rows], dtype=np.int64)
    if len(np.unique(label)) < 2:
        share = (label.sum() + 0.5) / (len(label) + 1)
        bias = float(np.log(share / (1 - share)))
        return Detector(lexicons, np.full(2 ** len(VOTERS), share), Linear(np.zeros(terms + len(VOTERS)), bias))
    held = np.zeros((2, 2 ** len(VOTERS)))
    np.add.at(held, (label, votes), 1)
    posterior = LabelModel(len(VOTERS)).fit(_patterns(docs, lexicons), held).posterior()
    columns = [np.array(r["row"]["columns"], dtype=np.int64) for r in rows]
    return Detector(lexicons, posterior, train_linear(columns, posterior[votes], terms + len(VOTERS)))


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; also its votes and their posterior."""
    detector = learned(docs, labels)

    def start():
        read = detector.reader()

        def of_texts(texts):
            rows = [read(t) for t in texts]
            score = detector.linear.score([r for r, _ in rows])
            votes = np.array([v for _, v in rows], dtype=np.int64)
            return [score, (score >= THRESHOLD).astype(np.int32), votes, detector.posterior[votes]]

        return of_texts

    held_out = F.coalesce(remainder(F.col("doc_id"), FOLDS) == 0, F.lit(False))
    added = {"score": "double", "predicted": "int", "votes": "long", "posterior": "double"}
    rows = per_text(whole_texts(docs), start, added)
    return rows.select("doc_id", held_out.alias("held_out"), *added)
