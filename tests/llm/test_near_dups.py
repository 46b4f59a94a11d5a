"""Near-duplicates: blocks and clumps against brute force, groups around the threshold, shared ids."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from test_operators import DOCS, brute_components, prose, rows_of

from pubmart.llm import near_dups


def sets_of(rng, n: int, letters: int) -> list[np.ndarray]:
    return [np.unique(rng.integers(0, letters, rng.integers(0, 40))).astype(np.uint64) for _ in range(n)]


@pytest.mark.parametrize("letters", [12, 50, 400])
def test_linked_rows_against_pairs(letters, monkeypatch):
    rng = np.random.default_rng(letters)
    monkeypatch.setattr(near_dups, "COLUMNS", 7)
    for _ in range(20):
        sets = sets_of(rng, int(rng.integers(2, 30)), letters)
        sets += [sets[0], sets[1][:-1]]
        values, sizes = np.concatenate(sets), np.array([len(s) for s in sets])
        want = np.array([[i != j and near_dups.linked(a, b) for j, b in enumerate(sets)] for i, a in enumerate(sets)])
        got = near_dups.linked_rows(values, sizes, 0)
        np.fill_diagonal(got, False)
        assert (got == want).all()
        asked = int(rng.integers(1, len(sets)))
        crossed = near_dups.linked_rows(values, sizes, asked)
        want[:asked, :asked] = want[asked:, asked:] = False
        assert (crossed == want).all()


def test_stars_connect_what_links_connect():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 200, 150), rng.integers(0, 200, 150)
    found = near_dups.star(a, b)
    pairs = list(zip(found.column("a").to_pylist(), found.column("b").to_pylist(), strict=True))
    root = {x: x for x in [*a, *b]}
    for _ in range(200):
        for x, y in zip(a, b, strict=True):
            root[x] = root[y] = min(root[x], root[y])
    assert len(pairs) < len(root) and len(set(y for _, y in pairs)) == len(pairs)
    assert all(root[x] == root[y] for x, y in pairs)
    assert len({frozenset([x, y]) for x, y in pairs}) == sum(1 for x in root if root[x] != x)


def group(rng: random.Random, first: int, kind: str, n: int, changed: int) -> list[tuple]:
    """Copies of one text with so many words changed: each of the first one (star), or of the one before (chain)."""
    words = prose(rng, 160).split()
    rows = [(first, " ".join(words))]
    for i in range(1, n):
        own = list(words)
        for place in rng.sample(range(len(own)), changed):
            own[place] = f"w{rng.randint(0, 10**9)}"
        rows.append((first + i, " ".join(own)))
        if kind == "chain":
            words = own
    return rows


def found(spark, rows) -> Counter:
    return Counter(map(tuple, near_dups.near_duplicates(spark.createDataFrame(rows, DOCS).repartition(3)).collect()))


def test_stars_and_chains_around_the_threshold(spark, monkeypatch):
    """Groups whose links are just above or just below, met in small blocks: members of a star are not near each other."""
    rng = random.Random(31)
    texts = [r for k, (kind, changed) in enumerate([("star", 4), ("star", 5), ("chain", 4), ("chain", 5)]) for r in group(rng, 1000 * k, kind, 90, changed)]
    rows = rows_of(texts)
    monkeypatch.setattr(near_dups, "BLOCK", 16)
    monkeypatch.setattr(near_dups, "BLOCK_SHINGLES", 16 * 150)
    got = found(spark, rows)
    assert got == brute_components(rows)
    sizes = Counter(r[2] for r in got)
    assert max(sizes.values()) >= 80 and len(sizes) > 20


def test_unlike_texts_under_one_id_stay(spark):
    """Only equal sets under a kept id count once; a near copy of either text goes with that id's group."""
    rng = random.Random(5)
    one, two, three = (prose(rng, 100) for _ in range(3))
    rows = rows_of([(1, one), (1, two), (1, one.upper()), (1, None), (1, ""), (2, two + " end"), (3, three), (None, one), (None, one)])
    docs = spark.createDataFrame(rows, DOCS).withColumnRenamed("score", "id").withColumnRenamed("source", "row")
    kept = near_dups.distinct_documents(docs)
    assert kept.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(
        [(1, min(one, one.upper())), (1, two), (1, None), (1, ""), (3, three), (None, one), (None, one)]
    )


def test_one_id_with_very_many_rows(spark):
    rng = random.Random(6)
    one, two = prose(rng, 60), prose(rng, 60)
    rows = rows_of([(7, one)] * 500 + [(7, two)] * 300 + [(8, one + " more"), (9, two + " more")])
    assert {r[2] for r in found(spark, rows)} == {7}
    kept = near_dups.distinct_documents(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(r.text for r in kept) == sorted([one, two])
