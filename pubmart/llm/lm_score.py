"""Log-likelihood of documents under a gated recurrent language model (operator 1).

Counts of all training tokens give the unigram base and the shares inside tail classes. The
recurrent part learns by truncated backpropagation on all training documents, once: replicas of
about REPLICA_TOKENS tokens start from the same weights, and their results are averaged
by tokens. A replica is a run of what one task reads, so that no text is dealt out. Counting, learning and scoring all grow with the corpus and are split over
it; the driver holds the weights and the KNOWN most frequent words, both of fixed size.

Texts stay where they are; their words are looked up once, and learning and scoring read the written ids. Words outside the KNOWN ones are scored by joining (row, word) pairs
with the counts; as the frequent words are not among them, no word is hot.

Score of a text: sum over its words and the end of log10 P(class | state) + log10 P(word | class).
A tail class shares its probability out by (count + 1), and has one more share for unseen words.

Defined results: null and empty texts are the end alone; rows that repeat a doc_id are scored (and
counted) each on its own; a null doc_id is not held out. Without training documents N and V are 0
and every token of the base has log10(1/1). Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pubmart.llm import gru
from pubmart.llm.common import KINDS, bounded_batches, chunks_of, merged, split_words, staged, whole_texts

FOLDS = 7
HELD_OUT = 2
KNOWN = 200_000
REPLICA_TOKENS = 2_000_000
FAN = 64
FLUSH = 300_000
#: Ids scored at a time, two bytes each.
SCORED_BYTES = 8 << 20


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def tail_of(word: str) -> int:
    """Tail class of a word: a code of its last two characters."""
    return zlib.crc32(word[-2:].encode("utf-8", "replace")) % gru.TAILS


def word_counts(docs: DataFrame) -> DataFrame:
    """word and count over all documents given; partitions count first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flushed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(counts), type=pa.string()), pa.array(list(counts.values()), type=pa.int64())],
                names=["word", "n"],
            )

        for batch in batches:
            for text in batch.column("text").to_pylist():
                counts.update(split_words(text))
                if len(counts) > FLUSH:
                    yield flushed()
                    counts.clear()
        yield flushed()

    bounded_batches(docs.sparkSession)
    counted = docs.select("text").mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("c"))


class _Index(dict):
    """Word to index; -1 for a word that is not known."""

    def __missing__(self, word: str) -> int:
        return -1


class Vocabulary:
    """The most frequent words, at most KNOWN, with their counts, and what the model's classes hold."""

    def __init__(self, words: list[str], counts: np.ndarray, ends: int, tokens: int, types: int, tail_mass: np.ndarray):
        self.tokens, self.types, self.ends = tokens, types, ends
        # id 0 is the end of a text; head words follow by frequency, the other known ones are tail
        self.index = _Index(zip(words, range(1, len(words) + 1), strict=True))
        self.count = np.concatenate([[ends], counts]).astype(np.float64)
        head = np.arange(len(self.count)) < gru.HEAD
        tails = np.array([0] + [tail_of(w) for w in words])
        self.model_id = np.where(head, np.arange(len(self.count)), gru.HEAD + tails)
        # log10 of the share inside the class, 0 for head words
        of_head = np.bincount(tails[1:][head[1:]], self.count[1:][head[1:]] + 1, gru.TAILS)
        self.tail_total = np.maximum(tail_mass - of_head, 0) + 1
        inside = np.log10(self.count + 1) - np.log10(self.tail_total[tails])
        self.inside = np.where(head, 0.0, inside)
        self.base = np.log10(self.count + 1)
        self.head_counts = np.zeros(gru.HEAD)
        n = min(gru.HEAD, len(self.count))
        self.head_counts[:n] = self.count[:n] + 1

    def started(self) -> gru.Weights:
        return gru.started(self.head_counts, self.tail_total)


def vocabulary(counts: DataFrame, ends: int) -> Vocabulary:
    # the lowest count of which no more than KNOWN words have as much: found on a row per count
    by_count = counts.groupBy("c").agg(F.count("*").alias("words")).toPandas().sort_values("c", ascending=False)
    fit = by_count["c"][by_count["words"].cumsum() <= KNOWN]
    known = counts.where(F.col("c") >= int(fit.min())).toPandas() if len(fit) else counts.limit(0).toPandas()
    known = known.sort_values(["c", "word"], ascending=[False, True])
    totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("tokens"), F.count("*").alias("types")).first()
    code = (F.crc32(F.substring("word", -2, 2).cast("binary")) % gru.TAILS).alias("tail")
    mass = np.zeros(gru.TAILS)
    for r in counts.groupBy(code).agg(F.sum(F.col("c") + 1).alias("mass")).collect():
        mass[r["tail"]] = r["mass"]
    return Vocabulary(
        known["word"].tolist(), known["c"].to_numpy(), ends, totals["tokens"] + ends, totals["types"] + (ends > 0), mass
    )


def coded(words: list[str], vocab: Vocabulary) -> tuple[np.ndarray, list[str]]:
    """Indices of the known words (-1: not known), and the words that are not."""
    index = np.fromiter(map(vocab.index.__getitem__, words), dtype=np.int64, count=len(words))
    return index, [words[i] for i in np.flatnonzero(index < 0).tolist()]


def model_ids(index: np.ndarray, rare: list[str], vocab: Vocabulary) -> np.ndarray:
    """Ids of the model, with the end."""
    out = np.zeros(len(index) + 1, dtype=np.int64)
    out[:-1] = vocab.model_id[index]
    if rare:
        out[:-1][index < 0] = gru.HEAD + np.array([tail_of(w) for w in rare])
    return out


def _ids(batch: pa.RecordBatch, vocab: Vocabulary) -> Iterator[np.ndarray]:
    """Ids of the model of each row: those written by ``_coded``, or of its text."""
    if "ids" in batch.schema.names:
        for ids in batch.column("ids").to_pylist():
            yield np.frombuffer(ids, dtype=np.int16)
    else:
        for text in batch.column("text").to_pylist():
            yield model_ids(*coded(split_words(text), vocab), vocab).astype(np.int16)


def _lessons(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """tokens and weights (times the tokens, as bytes) of each task, over all its replicas.

    ``docs`` has the column ids of ``_coded``, or text. A replica is what a task has read when it holds
    REPLICA_TOKENS tokens; a long text is cut into segments, and may lie in several. So neither equal rows nor
    one id nor one long text make a large replica.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun = vocab.started()
        total, tokens = np.zeros(gru.size()), 0
        held: list[np.ndarray] = []
        n = 0

        def learn() -> None:
            nonlocal total, tokens, held, n
            after, learnt = gru.train(begun, held)
            total += gru.flat(after).astype(np.float64) * learnt
            tokens += learnt
            held, n = [], 0

        for batch in batches:
            for ids in _ids(batch, vocab):
                for at in range(0, len(ids), gru.SEGMENT):
                    held.append(ids[at : at + gru.SEGMENT])
                    n += len(held[-1])
                    if n >= REPLICA_TOKENS:
                        learn()
        learn()
        yield _row(tokens, total)

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(run, "tokens long, weights binary")


def _row(tokens: int, total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([tokens], type=pa.int64()), pa.array([total.tobytes()], type=pa.binary())], names=["tokens", "weights"]
    )


def _added(tokens: list[int], weights: list[bytes]) -> tuple[int, np.ndarray]:
    total = np.zeros(gru.size())
    for x in weights:
        total += np.frombuffer(x)
    return sum(tokens), total


def trained(docs: DataFrame, vocab: Vocabulary) -> gru.Weights:
    """The mean weights, by tokens, of replicas that together learn from all documents once.

    The sums of the tasks are added up in tasks, FAN at a time, until the driver takes FAN at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, total = 0, np.zeros(gru.size())
        for batch in batches:
            more = _added(batch.column("tokens").to_pylist(), batch.column("weights").to_pylist())
            tokens, total = tokens + more[0], total + more[1]
        yield _row(tokens, total)

    sums = _lessons(docs, vocab)
    count = sums.rdd.getNumPartitions()
    while count > FAN:
        count = -(-count // FAN)
        sums = sums.repartition(count).mapInArrow(run, "tokens long, weights binary")
    found = sums.toArrow()
    tokens, total = _added(found["tokens"].to_pylist(), found["weights"].to_pylist())
    return gru.shaped(total / tokens) if tokens else vocab.started()


def _coded(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """A row per document with a row number, its sums over known words, its other words, and the model's ids (16 bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for part in chunks_of(texts):
                rows = []
                for text in texts[part]:
                    index, rare = coded(split_words(text), vocab)
                    model = model_ids(index, rare, vocab)
                    seen = index[index >= 0]
                    inside = vocab.inside[seen].sum()
                    if rare:
                        inside -= np.log10(vocab.tail_total[model[:-1][index < 0] - gru.HEAD]).sum()
                    counts = Counter(rare)
                    rows.append(
                        (
                            len(index) + 1,
                            len(seen) + (vocab.ends > 0),
                            vocab.base[seen].sum() + vocab.base[0],
                            inside,
                            list(counts),
                            list(counts.values()),
                            model.astype(np.int16).tobytes(),
                        )
                    )
                columns = list(zip(*rows, strict=True))
                n = len(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(number + np.arange(n)), batch.column("doc_id").slice(part.start, n)]
                    + [pa.array(c, type=KINDS[k]) for c, k in zip(columns, kinds.values(), strict=True)],
                    names=["row", "doc_id", *kinds],
                )
                number += n

    kinds = {"n_tokens": "long", "n_known": "long", "base": "double", "inside": "double"}
    kinds |= {"words": "array<string>", "times": "array<int>", "ids": "binary"}
    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(run, "row long, doc_id long, " + ", ".join(f"{c} {k}" for c, k in kinds.items()))


def _scored(rows: DataFrame, weights: gru.Weights) -> DataFrame:
    """The rows of ``_coded`` with the model's log10 probability instead of words and ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in merged(batches, SCORED_BYTES):  # many texts at a time keep all steps wide
            texts = batch.column("ids").to_pylist()
            for part in chunks_of(texts, SCORED_BYTES):
                likely = gru.log_likelihoods(weights, [np.frombuffer(x, dtype=np.int16) for x in texts[part]]) / np.log(10)
                mine = batch.slice(part.start, len(likely))
                model = pa.array(likely + mine.column("inside").to_numpy())
                yield pa.RecordBatch.from_arrays([mine.column(c) for c in kept] + [model], names=[*kept, "model"])

    kept = ["row", "doc_id", "n_tokens", "n_known", "base"]
    bounded_batches(rows.sparkSession)
    schema = "row long, doc_id long, n_tokens long, n_known long, base double, model double"
    return rows.select(*kept, "inside", "ids").mapInArrow(run, schema)


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    texts = whole_texts(docs)
    training = texts.where(~held_out())
    counts = staged(word_counts(training), "word-counts")
    vocab = vocabulary(counts, training.count())
    rows = staged(_coded(texts, vocab), "lm-rows")
    weights = trained(rows.where(~held_out()).select("ids"), vocab)
    rare = rows.select("row", F.explode(F.arrays_zip("words", "times")).alias("pair")).select(
        "row", F.col("pair.words").alias("word"), F.col("pair.times").alias("times")
    )
    found = (
        rare.join(counts, "word")
        .groupBy("row")
        .agg(F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("more"), F.sum("times").alias("known"))
    )
    more = F.coalesce("more", F.lit(0.0))
    total = float(np.log10(vocab.tokens + vocab.types + 1))
    return _scored(rows, weights).join(found, "row", "left").select(
        "doc_id",
        held_out().alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(vocab.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * total).alias("base_score"),
        (F.col("model") + more).alias("score"),
    )
