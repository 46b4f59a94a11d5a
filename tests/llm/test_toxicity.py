"""Toxicity: the label model against brute force, held-out accuracy, odd rows."""

from __future__ import annotations

import itertools
import random
import zlib

import numpy as np
import pytest
from test_operators import DOCS, prose, rows_of

from pubmart.llm import toxicity as T

LABELS = "doc_id long, quality int, toxic int"


def planted(rng: random.Random, n: int) -> tuple[dict, list]:
    """Toxic texts hold listed insults, or words of two stems that are in no list."""
    texts, labels = {}, []
    for i in range(n):
        words, toxic = prose(rng, rng.randint(20, 150)).split(), i % 4 == 0
        for _ in range(rng.randint(3, 6) if toxic else 0):
            bad = rng.choice(["idiot", "scum", "loser"]) if i % 8 == 0 else rng.choice(["grixo", "vlump"]) + rng.choice("abcdefg")
            words.insert(rng.randrange(len(words)), bad)
        texts[i] = " ".join(words)
        labels.append((i, 1, int(toxic)))
    return texts, labels


def test_posteriors_against_the_full_joint():
    """The tree's posterior equals Bayes' rule over its own probabilities, for every pattern."""
    rng = np.random.default_rng(4)
    model = T.LabelModel(4)
    labelled = rng.integers(1, 30, (2, 16)).astype(float)
    model._estimate(labelled)
    for code, chance in enumerate(model.posterior()):
        likely = []
        for c in (0, 1):
            p = model.prior[c]
            for k, parent in enumerate(model.parent):
                own = code >> k & 1
                p *= np.exp(model.tables[k][c, own] if parent < 0 else model.tables[k][c, code >> parent & 1, own])
            likely.append(p)
        assert chance == pytest.approx(likely[1] / sum(likely))
        assert sum(np.exp(model.tables[0][0])) == pytest.approx(1)


def test_the_tree_has_the_most_dependence():
    rng = np.random.default_rng(8)
    model = T.LabelModel(4)
    model._estimate(rng.integers(1, 60, (2, 16)).astype(float))
    edges = list(itertools.combinations(range(4), 2))
    trees = [t for t in itertools.combinations(edges, 3) if len(set(itertools.chain(*t))) == 4]
    best = max(sum(model.dependence[e] for e in t) for t in trees)
    assert sum(model.dependence[k, p] for k, p in enumerate(model.parent) if p >= 0) == pytest.approx(best)


def test_accuracies_and_correlations_are_estimated():
    """Two copies of one voter count as one; a good voter is told from a poor one with few labels."""
    rng = np.random.default_rng(2)
    n = 20_000
    y = rng.random(n) < 0.3
    good = np.where(rng.random(n) < 0.9, y, ~y)
    poor = np.where(rng.random(n) < 0.6, y, ~y)
    others = [np.where(rng.random(n) < p, y, ~y) for p in (0.8, 0.85, 0.8)]
    votes = np.stack([good, poor, poor, *others], axis=1) @ (1 << np.arange(6))
    labelled = np.zeros((2, 64))
    np.add.at(labelled, (y[:200].astype(int), votes[:200]), 1)
    model = T.LabelModel(6).fit(np.bincount(votes, minlength=64).astype(float), labelled)
    assert model.accuracy[1, 0] == pytest.approx(0.9, abs=0.05) and model.accuracy[1, 1] == pytest.approx(0.6, abs=0.06)
    assert (model.parent[2] == 1 or model.parent[1] == 2) and model.dependence[1, 2] == model.dependence[~np.eye(6, dtype=bool)].max()
    assert ((model.posterior()[votes] > 0.5) == y).mean() > 0.88


def test_held_out_documents(spark):
    texts, labels = planted(random.Random(3), 400)
    docs = spark.createDataFrame(rows_of(texts), DOCS)
    rows = {r.doc_id: r for r in T.toxicity_scores(docs, spark.createDataFrame(labels, LABELS)).collect()}
    assert len(rows) == 400
    held = [i for i in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sorted(held) == sorted(i for i, r in rows.items() if r.held_out)
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in rows.values())
    assert sum(rows[i].predicted == labels[i][2] for i in held) >= 0.95 * len(held)


def test_held_out_labels_teach_nothing(spark):
    texts, labels = planted(random.Random(5), 200)
    docs = spark.createDataFrame(rows_of(texts), DOCS)
    turned = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    score = lambda marks: {r.doc_id: r.score for r in T.toxicity_scores(docs, spark.createDataFrame(marks, LABELS)).collect()}
    assert score(labels) == score(turned)


def test_odd_documents_and_labels(spark, tmp_path):
    texts, labels = planted(random.Random(9), 120)
    odd = [(1000, None), (1001, ""), (1002, " \n\t"), (None, "you idiot scum loser"), (None, None), (3, texts[3]), (4, "another text"), (1003, "a" * 70_000), (1004, prose(random.Random(1), 20_000))]
    docs = spark.createDataFrame(rows_of([*texts.items(), *odd]), DOCS).withColumnsRenamed({"lang": "votes", "source": "posterior"})
    marks = [*labels, (None, 1, 1), (5, 1, None), (7, None, 1), (7, 1, 0), (9999, 1, 1)]
    rows = T.toxicity_scores(docs, spark.createDataFrame(marks, LABELS)).collect()
    assert len(rows) == 129 and all(0 <= r.score <= 1 for r in rows)
    of = lambda d: [r for r in rows if r.doc_id == d]
    assert len({r.score for d in (1000, 1001, 1002) for r in of(d)}) == 1 and not of(1000)[0].predicted
    assert len({r.score for r in of(3)}) == 1 and len(of(4)) == 2
    assert not any(r.held_out for r in of(None)) and any(r.predicted for r in of(None))


def test_without_labels_or_documents(spark):
    docs, none = spark.createDataFrame(rows_of({1: "you idiot", 2: "fine"}), DOCS), spark.createDataFrame([], LABELS)
    assert {r.score for r in T.toxicity_scores(docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1, 1), (2, 1, 1)], LABELS)
    assert len({r.score for r in T.toxicity_scores(docs, one).collect()}) == 1
    assert T.toxicity_scores(docs.limit(0), one).collect() == []


def test_voters_read_whole_texts():
    lexicons = T.Lexicons([("wgrixo", 4.0), ("5vlump", 3.0), ("wfine", -3.0), ("wgood", -3.0)])
    read = lexicons.reader()
    found, votes = read("Fine good " * 5000 + "GRIXO, vlumpish!")
    fired = {T.VOTERS[j] for j in range(len(T.VOTERS)) if votes >> j & 1}
    assert found == [0, 1, 2, 3] and fired == {"words_1", "stems_5", "clean_words"}
    assert read("you idiot grixo!!")[1] & 1
    assert read("")[0] == [] and read("")[1] == 0
