"""The prefix trie against a brute-force trie, and its skeleton's bounds."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from pubmart.llm import prefix_trie, queries

TURNS = "conv_id long, turn long, role string, text string, seg string, path int, shard long, length string"


def brute(rows: list[tuple]) -> Counter:
    """(smallest member, depth, parent's, members, children, leaves, savings, hash of ends) of every node."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            unit = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
            own[conv].append((turn is not None, turn or 0, unit, role, text))
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for conv in sorted(own):
        head = zlib.crc32(str(conv).encode()) % 6
        base = sorted(own.get(conv - int(math.fmod(conv, 100)), []))
        turns = tuple(x[3:] for x in base[:head] + sorted(own[conv])[head:])
        for d in range(len(turns) + 1):
            members[turns[:d]].append(conv)
            if d:
                children[turns[: d - 1]].add(turns[:d])
        ends[turns].append(conv)
    leaves, saved = Counter(), Counter()
    for node, who in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(who) - 1) * len(node[-1][1]) if node else 0
    return Counter(
        (who[0], len(node), members[node[:-1]][0] if node else None, len(who), len(children[node]), leaves[node], saved[node],
         hashlib.sha256(",".join(map(str, ends[node])).encode()).hexdigest())
        for node, who in members.items()
    )


def frame(spark, rows: list[tuple]):
    return spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], TURNS)


def found(docs, segment: int = prefix_trie.SEGMENT) -> Counter:
    rows = prefix_trie.prefix_trie(docs, segment)
    assert {t for _, t in rows.drop("ends_sha256").dtypes} == {"bigint"}
    return Counter(tuple(r) for r in rows.collect())


@pytest.fixture(scope="module")
def odd() -> list[tuple]:
    """Null ids, turns, roles and texts; repeated rows and turns; negative ids; absent bases; prefixes and copies."""
    rng = random.Random(5)
    rows: list[tuple] = [(None, 1, "u", "a"), (5, 1, "u", "a"), (5, 1, "u", "a"), (5, 1, "v", "b"), (301, 0, None, None), (400, 0, "u", "x" * 50_000)]
    for conv in [*range(-104, -90), *range(0, 60), *range(2300, 2310), 1001]:
        letters = random.Random(rng.choice([1, 2, 3]))
        for turn in range(rng.choice([1, 3, 7, 20, 33, 33])):
            text = letters.choice("abé𝔘") if rng.random() < 0.98 else None
            rows.append((conv, None if rng.random() < 0.02 else turn, "u" if rng.random() < 0.97 else None, text))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("segment", [512, 4, 1])
def test_every_node_is_found(spark, odd, segment):
    assert found(frame(spark, odd).repartition(3), segment) == brute(odd)


def test_many_ranges_cut_a_large_group_of_copies(spark, monkeypatch):
    rows = [(c, t, "u", f"turn {t}") for c in range(0, 30_000, 100) for t in range(4)]
    rows += [(c, t, "u", f"own {c % 7} {t}") for c in range(7, 3000, 100) for t in range(5)]
    monkeypatch.setattr(prefix_trie, "parts", lambda spark: 9)
    monkeypatch.setattr(prefix_trie, "CHUNK", 64)
    assert found(frame(spark, rows)) == brute(rows)


def test_no_conversations(spark):
    assert found(frame(spark, [])) == Counter()
    assert found(frame(spark, [(None, 1, "u", "a")])) == Counter()
    # a conversation shorter than its head whose base is absent has no turns
    short = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 1)
    assert found(frame(spark, [(short, 0, "u", "a")])) == brute([(short, 0, "u", "a")])


def test_the_skeleton_is_the_trie_of_the_splitters():
    unit = lambda c: c.encode() * prefix_trie.DIGEST + (5).to_bytes(8, "big")
    splitters = [(0, 0, 0, b"", 1), (0, 0, 0, unit("a") + unit("b"), 3), (0, 0, 0, unit("a") + unit("c"), 3), (1, 7, 7, unit("a"), 3)]
    skeleton = prefix_trie.Skeleton(splitters)
    assert [(n[1], n[2], n[5]) for n in skeleton.nodes] == [(None, 0, 0), (0, 0, 1), (1, 0, 2), (1, 0, 2), (None, 1, 0), (4, 1, 1)]
    assert all(n[6] == (5 if n[5] else 0) for n in skeleton.nodes)


def test_sums_over_subtrees_of_a_long_chain(spark):
    chain = [(str(i), str(i - 1) if i else None, 1, 2 * i) for i in range(37)] + [("side", "5", 1, 100)]
    sums = {r.id: (r.a, r.b) for r in prefix_trie.subtree_sums(spark.createDataFrame(chain, "id string, parent string, a long, b long"), "a", "b").collect()}
    for i in range(37):
        assert sums[str(i)] == (37 - i + (i <= 5), sum(2 * k for k in range(i, 37)) + 100 * (i <= 5))


def test_sql_agrees_with_the_brute_trie(odd):
    rows = [r for r in odd if r[0] is not None and r[1] is not None]
    import pandas as pd

    conversations = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).drop_duplicates(["conv_id", "turn"])  # noqa: F841
    got = duckdb.sql(queries.ORACLES["op11_prefix_trie"]).fetchall()
    plain = [tuple(None if isinstance(v, float) else v for v in r) for r in conversations.itertuples(index=False, name=None)]
    assert Counter(got) == brute([(int(c), int(t), r, x) for c, t, r, x in plain])
