"""Quality classifier: histogram gradient-boosted trees over document statistics (operator 5).

Statistics of a whole text (never its id, source, language or label) are cut into bins at
quantiles; trees of fixed depth are grown on gradient histograms of the logistic loss and kept as
flat arrays, so that a batch of documents walks through all trees in a few numpy steps.

Fitting reads at most ``LABELLED`` labelled documents, those of smallest hash, which bounds the
driver's share at every input size. Scoring reads every text and shuffles nothing.

Defined results: a null text counts as empty and gets the score of its statistics (all zero). Labels
that are null are left out; several labels of one document count as their majority, a tie as 1.
Without labels every score is 0.5; with one class only, the share of that class, kept off 0 and 1.
Repeated rows are scored each on its own; a null doc_id is not held out. Other columns of the
documents pass through or are not read.
"""

from __future__ import annotations

from collections import Counter
from operator import eq

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pubmart.llm.common import per_text

LABELLED = 20_000
FOLDS = 5
TREES = 80
DEPTH = 4
BINS = 64
RATE = 0.15
RIDGE = 1.0
LEAST_WEIGHT = 3.0
THRESHOLD = 0.3

# Frequent words of the four languages.
FREQUENT = frozenset(
    "the of and to in a is that it for on was be with as by at from this are "
    "de la le les des et en un une du que qui dans est pour pas sur par au avec "
    "der die das und den von zu mit sich auf für ist im dem nicht ein eine als auch es "
    "el los las y se del una por con no su para al lo como más o sus".split()
)

NAMES = (
    "chars words word_length distinct_words top_word repeated_words longest_run upper digits symbols "
    "marks bars ends frequent lines line_words distinct_lines distinct_pairs capitals exclamations "
    "other_bytes short_words long_words blanks".split()
)
_SYMBOLS = [ord(c) for c in "#$%&*@^~_=+<>{}[]\\`/"]
_MARKS = [ord(c) for c in "!?;:\"'()-"]


def statistics(text: str) -> list[float]:
    """The statistics NAMES of one whole text; all zero for an empty one."""
    words = text.split()
    n = len(words)
    if not n:
        return [float(np.log1p(len(text)))] + [0.0] * (len(NAMES) - 1)
    counts = Counter(words)
    bytes_ = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8), minlength=256)
    size = float(bytes_.sum())
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    same = np.fromiter(map(eq, words, words[1:]), dtype=bool, count=n - 1)
    breaks = np.flatnonzero(np.concatenate([[True], ~same, [True]]))
    lines = [x for x in text.split("\n") if x]
    pairs = len(set(zip(words, words[1:], strict=False)))
    return [
        float(np.log1p(len(text))),
        float(np.log1p(n)),
        float(lengths.mean()),
        len(counts) / n,
        counts.most_common(1)[0][1] / n,
        float(same.sum()) / n,
        float(np.diff(breaks).max()) / n,
        float(bytes_[65:91].sum()) / size,
        float(bytes_[48:58].sum()) / size,
        float(bytes_[_SYMBOLS].sum()) / size,
        float(bytes_[_MARKS].sum()) / size,
        counts.get("|", 0) / n,
        float(bytes_[46] + bytes_[44]) / n,
        sum(k for w, k in counts.items() if w in FREQUENT) / n,
        float(np.log1p(len(lines))),
        n / max(1, len(lines)),
        len(set(lines)) / max(1, len(lines)),
        pairs / n,
        sum(k for w, k in counts.items() if w[0].isupper()) / n,
        float(bytes_[33]) / n,
        float(bytes_[128:].sum()) / size,
        float((lengths <= 2).mean()),
        float((lengths >= 15).mean()),
        float(bytes_[32]) / size,
    ]


class Boosted:
    """Trees as arrays [tree, node]; the children of node i are 2i+1 and 2i+2."""

    def __init__(self, base: float, feature: np.ndarray, cut: np.ndarray, value: np.ndarray):
        self.base, self.feature, self.cut, self.value = base, feature, cut, value

    def score(self, rows: np.ndarray) -> np.ndarray:
        total = np.full(len(rows), self.base)
        at = np.arange(len(rows))
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            node = np.zeros(len(rows), dtype=np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (rows[at, feature[node]] > cut[node])
            total += value[node - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-total))


def fit(rows: np.ndarray, labels: np.ndarray) -> Boosted:
    """Fit on a bounded table of statistics (rows) and 0/1 labels."""
    width = len(NAMES)
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    if len(labels) == 0:
        rows, labels = np.zeros((0, width)), np.zeros(0)
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    base = float(np.log(share / (1 - share)))
    empty = Boosted(base, np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, leaves)))
    if len(np.unique(labels)) < 2:
        return empty
    edges = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, BINS)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(e, rows[:, f], side="left") for f, e in enumerate(edges)])
    margin = np.full(len(labels), base)
    features, cuts, values = [], [], []
    for _ in range(TREES):
        chance = 1 / (1 + np.exp(-margin))
        slope, weight = labels - chance, chance * (1 - chance)
        feature, cut = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        node = np.zeros(len(labels), dtype=np.int64)
        for depth in range(DEPTH):
            first, n = 2**depth - 1, 2**depth
            best = np.zeros(n)
            local = node - first
            chosen_bin = np.full(n, BINS)
            for f in range(width):
                key = local * BINS + binned[f]
                g = np.bincount(key, slope, n * BINS).reshape(n, BINS)
                h = np.bincount(key, weight, n * BINS).reshape(n, BINS)
                left_g, left_h = g.cumsum(1), h.cumsum(1)
                all_g, all_h = left_g[:, -1:], left_h[:, -1:]
                gain = (
                    left_g**2 / (left_h + RIDGE)
                    + (all_g - left_g) ** 2 / (all_h - left_h + RIDGE)
                    - all_g**2 / (all_h + RIDGE)
                )
                gain[(left_h < LEAST_WEIGHT) | (all_h - left_h < LEAST_WEIGHT)] = 0
                gain[:, len(edges[f]) :] = 0
                at = gain.argmax(1)
                top = gain[np.arange(n), at]
                better = top > best + 1e-9
                best[better] = top[better]
                feature[first : first + n][better] = f
                chosen_bin[better] = at[better]
                cut[first : first + n][better] = [edges[f][b] for b in at[better]]
            taken = feature[first : first + n]
            node = 2 * node + 1 + (binned[taken[local], np.arange(len(labels))] > chosen_bin[local])
        leaf = node - inner
        g, h = np.bincount(leaf, slope, leaves), np.bincount(leaf, weight, leaves)
        value = RATE * g / (h + RIDGE)
        margin += value[leaf]
        features.append(feature)
        cuts.append(cut)
        values.append(value)
    return Boosted(base, np.array(features), np.array(cuts), np.array(values))


def remainder(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def learned(docs: DataFrame, labels: DataFrame, column: str = "quality") -> Boosted:
    """Fit on at most LABELLED documents whose remainder is not 0."""
    chosen = (
        labels.select("doc_id", F.col(column).alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & (remainder(F.col("doc_id"), FOLDS) != 0))
        .groupBy("doc_id")
        .agg((F.avg("label") >= 0.5).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(LABELLED)
    )
    # at most LABELLED rows of an id and a flag: a proven bound
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")

    def start():
        return lambda texts: [[statistics(t) for t in texts]]

    rows = (
        per_text(texts, start, {"statistics": "array<double>"})
        .groupBy("doc_id", "label")
        .agg(F.min("statistics").alias("statistics"))
        .orderBy("doc_id")
        .collect()
    )
    return fit(
        np.array([r["statistics"] for r in rows], dtype=np.float64).reshape(len(rows), len(NAMES)),
        np.array([r["label"] for r in rows], dtype=np.float64),
    )


def scored(docs: DataFrame, model: Boosted, names: tuple[str, str], drop: tuple[str, ...] = ()) -> DataFrame:
    """The documents with a score and a 0/1 decision; null texts count as empty but stay null."""

    def start():
        def of_texts(texts):
            rows = np.array([statistics(t or "") for t in texts]).reshape(len(texts), len(NAMES))
            score = model.score(rows)
            return [score, (score >= THRESHOLD).astype(np.int32)]

        return of_texts

    return per_text(docs, start, {names[0]: "double", names[1]: "int"}, drop)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = learned(docs, labels)
    held_out = F.coalesce(remainder(F.col("doc_id"), FOLDS) == 0, F.lit(False))
    rows = scored(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), model, ("score", "predicted"), ("text",))
    return rows.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier does not reject, with their own columns."""
    rows = scored(docs, learned(docs, labels), ("__score", "__predicted"))
    return rows.where("__predicted = 1").select(*[F.col(f"`{c}`") for c in docs.columns])
