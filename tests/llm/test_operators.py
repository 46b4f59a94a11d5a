"""The operators against brute force and the libraries on small fixtures, odd rows included."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from pubmart.llm import ann, bpe, chunks, common, gru, lm_score, near_dups, packing, pii, quality, queries, spotsigs, url_filter
from pubmart.llm.common import components, split_words

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, component_id int, `part` int"
WORDS = "ba ce di fo gu ha je ki lo mu na pe ri so tu va we xi yo zu".split()
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(rng: random.Random, n: int) -> str:
    common = ["the", "of", "and", "to", "in"]
    made = lambda: "".join(rng.choice(WORDS) for _ in range(rng.randint(1, 4)))
    return " ".join(rng.choice(common) if rng.random() < 0.3 else made() for _ in range(n))


def rows_of(texts: dict | list) -> list[tuple]:
    pairs = texts.items() if isinstance(texts, dict) else texts
    return [(i, t, "en", "src0", None if t is None else len(t), "x", 7, 3) for i, t in pairs]


@pytest.fixture(scope="module")
def odd() -> list[tuple]:
    """Nulls, empty and blank texts, a very long one, ties and repeated rows."""
    rng = random.Random(1)
    one = prose(rng, 80)
    long = prose(rng, 15_000)
    return rows_of(
        [
            (1, one), (1, one), (2, None), (3, ""), (4, " \n\t "), (None, "the word of it"), (None, None), (5, long),
            (6, one), (7, "Ünïcode ñandú 𝔘𝔫𝔦 e\u0301 İstanbul ΑΣ\x85\xa0x"), (8, prose(rng, 120)), (9, "a" * 70_000),
            (10, "word"), (11, "the the the"),
        ]
    )


@pytest.fixture(scope="module")
def odd_docs(spark, odd):
    return spark.createDataFrame(odd, DOCS)


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def test_words_are_split_at_six_blanks_only():
    text = "Ab\x0bC\x0cd\re\x1cF\x85\xa0 ÉÀ\tİ\n"
    assert split_words(text) == re.findall(r"[^\x20\x09-\x0D]+", text.translate(ASCII))


def test_components_of_chains_stars_and_rings(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, x) for x in range(200, 260)] + [(300, 301), (301, 302), (302, 300)]
    edges += [(5, 5), (159, 7)]
    rng.shuffle(edges)
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    assert {found[i] for i in range(100, 161)} | {found[x] for x in range(200, 260)} == {7}
    assert {found[i] for i in (300, 301, 302)} == {300}


# 1 language model


def test_language_model_counts_and_base(spark, odd, odd_docs):
    rows = lm_score.scores(odd_docs).collect()
    assert len(rows) == len(odd)
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    tokens = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(ASCII)) + [None]
    c = Counter(w for d, t, *_ in odd if not held(d) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = Counter()
    for d, t, *_ in odd:
        k = tokens(t)
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in k)
        want[(d, held(d), len(k), sum(c[w] > 0 for w in k), n, round(base, 4))] += 1
    got = Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in rows)
    assert got == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows)


def test_language_model_of_no_documents(no_docs):
    assert lm_score.scores(no_docs).collect() == []


def test_the_language_model_learns_from_all_training_documents(spark, monkeypatch):
    rng = random.Random(17)
    docs = spark.createDataFrame(rows_of([(i, prose(rng, 20)) for i in range(200)]), DOCS)
    training = docs.where(~lm_score.held_out())
    kept = []
    lessons = lm_score._lessons

    def seen(docs, vocab):
        kept.append(lessons(docs, vocab))
        return kept[-1]

    monkeypatch.setattr(lm_score, "_lessons", seen)
    monkeypatch.setattr(lm_score, "REPLICA_TOKENS", 100)
    monkeypatch.setattr(lm_score, "FAN", 2)
    lm_score.scores(docs.repartition(7))
    # the end of a text is a token
    assert sum(r.tokens for r in kept[0].collect()) == 21 * training.count()
    assert kept[0].count() > 2


def test_equal_rows_and_long_texts_make_no_large_replica(spark, monkeypatch):
    """A third of all rows with a null id and one text, and one very long text: replicas stay of their size."""
    rng = random.Random(18)
    rows = [(None, "the same text again")] * 300 + [(i, prose(rng, 30)) for i in range(600)] + [(1000, prose(rng, 5000))]
    docs = spark.createDataFrame(rows_of(rows), DOCS).coalesce(1)
    sizes = []
    train = gru.train

    def seen(w, texts, rate=gru.RATE):
        sizes.append(sum(map(len, texts)))
        return train(w, texts, rate)

    monkeypatch.setattr(gru, "train", seen)
    monkeypatch.setattr(lm_score, "REPLICA_TOKENS", 4000)
    training = docs.where(~lm_score.held_out())
    counts = lm_score.word_counts(training)
    vocab = lm_score.vocabulary(counts, training.count())
    batches = [pa.RecordBatch.from_pydict({"text": [r.text for r in training.collect()]})]

    class Frame:
        sparkSession = spark

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return list(run(iter(batches)))

    (row,) = lm_score._lessons(Frame(), vocab)
    assert row.column("tokens").to_pylist() == [vocab.tokens] == [sum(sizes)]
    assert max(sizes) < 4000 + gru.SEGMENT


def test_scores_against_a_plain_reading(spark, monkeypatch):
    """Each token's class and its share of the class, one at a time: known, rare, unseen and held-out words."""
    rng = random.Random(19)
    rows = [(i, prose(rng, rng.randint(1, 60))) for i in range(60)] + [(100, "neverseen " * 3 + "the"), (101, None), (None, "the of zzz")]
    docs = spark.createDataFrame(rows_of(rows), DOCS)
    kept = []
    trained = lm_score.trained

    def seen(docs, vocab):
        kept.append((vocab, trained(docs, vocab)))
        return kept[-1][1]

    monkeypatch.setattr(lm_score, "trained", seen)
    monkeypatch.setattr(lm_score, "KNOWN", 40)
    got = {r.doc_id: r.score for r in lm_score.scores(docs).collect()}
    vocab, w = kept[0]
    w = {k: v.astype(np.float64) for k, v in w.items()}
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    count = Counter(x for d, t in rows if not held(d) for x in (t or "").split())
    known = dict(vocab.index)
    tails = Counter()
    for x, n in count.items():
        if x not in known:
            tails[lm_score.tail_of(x)] += n + 1
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    softmax = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    for doc, text in rows:
        h, last, total = np.zeros(gru.UNITS), gru.START, 0.0
        for word in [*(text or "").split(), None]:
            x, g = w["read"][last] + w["bias"], h @ w["again"]
            z, r = sigmoid(x[: gru.UNITS] + g[: gru.UNITS]), sigmoid(x[gru.UNITS : 2 * gru.UNITS] + g[gru.UNITS : 2 * gru.UNITS])
            fresh = np.tanh(x[2 * gru.UNITS :] + r * g[2 * gru.UNITS :])
            h = z * h + (1 - z) * fresh
            classes = softmax(h @ w["to_class"] + w["class_bias"])
            if word is None or word in known:
                last = 0 if word is None else known[word]
                c, place = divmod(last, gru.CLASS_SIZE)
                share = softmax(h @ w["to_word"][c] + w["word_bias"][c])[place]
            else:
                tail = lm_score.tail_of(word)
                last, c = gru.HEAD + tail, gru.HEAD_CLASSES + tail
                share = (count[word] + 1) / (tails[tail] + 1)
            total += np.log10(classes[c]) + np.log10(share)
        assert got[doc] == pytest.approx(total, rel=1e-4), doc


def test_chances_sum_to_one_and_windows_do_not_matter():
    rng = np.random.default_rng(1)
    w = gru.started(rng.integers(1, 99, gru.HEAD).astype(float), rng.integers(1, 99, gru.TAILS).astype(float))
    h = rng.normal(size=(1, gru.UNITS)).astype(np.float32)
    ids = np.arange(gru.HEAD + gru.TAILS)
    assert abs(np.exp(gru._log_chances(w, np.repeat(h, len(ids), 0), ids)).sum() - 1) < 1e-4
    texts = [rng.integers(0, gru.HEAD + gru.TAILS, n) for n in (70, 1, 33, 32, 200)]
    whole = gru.log_likelihoods(w, texts, window=500)
    assert np.allclose(whole, gru.log_likelihoods(w, texts, window=7), rtol=1e-4)
    assert np.allclose(whole, [gru.log_likelihoods(w, [t])[0] for t in texts], rtol=1e-4)


def test_gradient_against_differences():
    rng = np.random.default_rng(3)
    w = gru.started(np.ones(gru.HEAD), np.ones(gru.TAILS))
    w = {k: (v + rng.normal(0, 0.1, v.shape)).astype(np.float64) for k, v in w.items()}
    ids = rng.integers(0, gru.HEAD, (5, 3))
    ids[0], ids[3, 1] = gru.START, gru.START
    target, weight = rng.integers(0, gru.HEAD + gru.TAILS, (5, 3)), np.ones((5, 3), dtype=np.float32)
    start = np.zeros((3, gru.UNITS))
    slopes, _ = gru._slopes(w, ids, target, start, weight)

    def value() -> float:
        h, total = start, 0.0
        for t in range(5):
            x = (w["read"] + w["bias"])[ids[t]]
            h = gru._gates(w["again"], x, np.where((ids[t] == gru.START)[:, None], 0, h))[-1]
            total += gru._log_chances(w, h, target[t]).sum()
        return total / 15

    for name in ("again", "bias", "read", "to_class", "class_bias"):
        place = np.unravel_index(np.abs(slopes[name]).argmax(), slopes[name].shape)
        kept = w[name][place]
        w[name][place] = kept + 1e-3
        up = value()
        w[name][place] = kept - 1e-3
        down = value()
        w[name][place] = kept
        assert abs((up - down) / 2e-3 - slopes[name][place]) < 2e-3 * max(1, abs(slopes[name][place])), name


def test_learning_beats_the_unigram_on_held_out_text():
    rng = np.random.default_rng(5)
    made = lambda: np.concatenate([(np.arange(30) * s + rng.integers(2)) % 40 + 1 for s in rng.integers(1, 4, 4)])
    texts = [made() for _ in range(300)]
    counts = np.bincount(np.concatenate(texts), minlength=gru.HEAD) + 1.0
    before = gru.started(counts, np.ones(gru.TAILS))
    after, n = gru.train(before, texts)
    fresh = [made() for _ in range(20)]
    assert n == sum(map(len, texts))
    assert gru.log_likelihoods(after, fresh).sum() > 0.8 * gru.log_likelihoods(before, fresh).sum()


# 2 url filter


def test_urls_against_sql(spark, tmp_path):
    urls = [
        "http://a.org/x", "https://EXAMPLE.org/es/1", "x://example.org/en/1", "http://www.example.org/en/12?q#f",
        "http://example.org/en/2", "http://notexample.org/es/", "http://a.com/fr/", "http://a.com/de/x?y", "http://com/de/",
        "http://a.com/de", "http://org", "http://b.net/", "nohost", "", None, "http:///path", "a://b://c/d", "http://É.org/Ä",
        "http://a.org\n/x", "http://a.org/x\ny?z",
    ]
    urls += [f"http://h{i % 37}.{t}/{p}/{i}" for i in range(400) for t in ("com", "net") for p in ("de", "fr")]
    rows = [(i, u, "html", "x", "y") for i, u in enumerate(urls)] + [(3, urls[3], None, "x", "y"), (None, urls[0], None, "x", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string, verdict string")
    pages.toPandas().astype({"page_id": "Int64"}).to_parquet(tmp_path / "pages.parquet")
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet'")
        want = db.sql(queries.OP2_SQL).fetchall()
    got = [tuple(r) for r in url_filter.judged(pages).collect()]
    assert Counter(got) == Counter(want)
    assert url_filter.judged(pages.limit(0)).collect() == []


def test_cascade_is_exact_for_its_universe(spark):
    keys = spark.range(3000).selectExpr("concat('h', id % 90) AS host", "concat('/', id) AS path", "id % 3 = 0 AS listed")
    cascade = url_filter.Cascade(keys)
    wrong = keys.where(cascade.listed(keys["host"], keys["path"]) != keys["listed"])
    assert len(cascade.levels) > 1 and wrong.count() == 0


def test_the_cascade_runs_no_python(spark):
    pages = spark.createDataFrame([(1, "http://a.com/de/x")], "page_id long, url string")
    plan = url_filter.judged(pages)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Join", plan)


# 3 fingerprints


def test_edited_pairs_against_brute_force(spark, odd, odd_docs):
    spotted = spotsigs.Spotter()
    ordered = sorted(((d, t or "") for d, t, *_ in odd), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))

    def alike(a, b):
        a, b = set(a.tolist()), set(b.tolist())
        return 1.0 if not a | b else len(a & b) / len(a | b)

    want = Counter()
    for i, (d, t) in enumerate(ordered):
        after = ordered[(i + 1) % len(ordered)][1]
        half = len(t) // 2
        changed = t[: len(t) - half] + after[:half]
        own, other = spotted(t), spotted(changed)
        want[
            (d, len(t), hashlib.sha256(changed.encode()).hexdigest(), spotsigs.written(own), spotsigs.written(other),
             round(alike(own, other), 9), round(alike(own, spotted(after)), 9))
        ] += 1
    got = Counter(
        (r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9))
        for r in spotsigs.edited_pairs(odd_docs.repartition(3)).collect()
    )
    assert got == want


def test_fingerprints_of_few_documents(spark, no_docs):
    assert spotsigs.edited_pairs(no_docs).collect() == []
    alone = spotsigs.edited_pairs(spark.createDataFrame(rows_of([(1, "the cat of hats and dogs")]), DOCS)).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0


def test_likeness_is_pruned_only_below_the_least():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a, b = (np.unique(rng.integers(0, 60, rng.integers(0, 50)).astype(np.uint32)) for _ in range(2))
        exact = spotsigs.likeness(a, b)
        for least in (0.2, 0.5, 0.8):
            pruned = spotsigs.likeness(a, b, least)
            assert pruned == exact or (pruned == 0.0 and exact < least)


def test_similar_pairs_against_brute_force(spark):
    rng = random.Random(8)
    texts = {i: prose(rng, 150) for i in range(20)}
    for i in range(20, 40):
        words = texts[i % 7].split()
        for _ in range(rng.choice((0, 2, 20))):
            words[rng.randrange(len(words))] = "changed" + str(rng.randint(0, 99))
        texts[i] = " ".join(words)
    spotted = spotsigs.Spotter()
    sets = {i: spotted(t) for i, t in texts.items()}
    want = {(a, b) for a in sets for b in sets if a < b and spotsigs.likeness(sets[a], sets[b]) >= 0.6}
    found = spotsigs.similar_pairs(spark.createDataFrame(rows_of(texts), DOCS), 0.6)
    assert {(r.a, r.b) for r in found.collect()} == want


def test_a_star_of_near_duplicates_is_linked_through_its_hub(spark):
    rng = random.Random(31)
    hub = [f"h{i}" for i in range(400)]
    texts = [(5000, " ".join(hub))]
    for i in range(1100):  # each near the hub, hardly any two near each other
        words = list(hub)
        for at in rng.sample(range(2, 398), 10):
            words[at] = f"s{i}x{at}"
        texts.append((6000 + i, " ".join(words)))
    got = near_dups.near_duplicates(spark.createDataFrame(rows_of(texts), DOCS).repartition(3)).collect()
    # ten changed words change 50 of 396 shingles at most: 346 / 446 with the hub
    assert len(got) == 1101 and {r.component_id for r in got} == {5000} and sum(r.kept for r in got) == 1


# 4 substring deduplication


def test_repeated_passages(spark):
    rng = random.Random(4)
    shared = prose(rng, 90)
    texts = {i: prose(rng, 200) for i in range(12)}
    for i in (2, 5, 9):
        texts[i] = prose(rng, 40 + i) + " " + shared + " " + prose(rng, 30)
    docs = spark.createDataFrame(rows_of(texts), DOCS)
    found = chunks.repeated_passages(docs).collect()
    assert {r.doc_id for r in found} == {5, 9} and {r.first_doc_id for r in found} == {2}
    for r in found:
        piece = texts[r.doc_id][r.start : r.end]
        assert piece in texts[2] and hashlib.sha256(piece.encode()).hexdigest() == r.sha256 and r.words == len(piece.split())
        assert r.words > 55
    kept = {r.doc_id: r for r in chunks.without_repeats(docs).collect()}
    for i, t in texts.items():
        assert (kept[i].text == t) == (i not in (5, 9)) and kept[i].n_chars == len(kept[i].text)
    assert all(len(shared) - len(" ".join(set(shared.split()) & set(kept[i].text.split()))) > 0 for i in (5, 9))


def test_borders_move_with_the_content():
    rng = random.Random(6)
    text = prose(rng, 3000).encode()
    moved = b"something new in front " + text
    pieces = lambda d: set(chunks.digests(d)[1])
    assert len(pieces(text) - pieces(moved)) <= 3
    data = ("é" * 5000).encode()
    ends = chunks.borders(data)
    assert ends[-1] == len(data) and all(data[:e].decode() for e in ends.tolist())


def test_odd_texts_in_substring_deduplication(odd, odd_docs, no_docs):
    got = chunks.without_repeats(odd_docs).collect()
    want = Counter((d, t) for d, t, *_ in odd)
    changed = Counter((r.doc_id, r.text) for r in got) - want
    assert len(got) == len(odd) and set(changed) == {(6, "")}  # a copy of document 1
    assert got[0].asDict().keys() == odd_docs.first().asDict().keys()
    assert chunks.repeated_passages(no_docs).collect() == [] == chunks.without_repeats(no_docs).collect()


# 5 quality


def labelled(rng, n):
    good = {i: prose(rng, rng.randint(20, 200)) for i in range(n)}
    bad = {}
    for i in range(n, 2 * n):
        words = prose(rng, 60).split()
        bad[i] = rng.choice((" ".join(w + "&&&" for w in words), " | ".join(words), " ".join([words[0]] * 80), " ".join(words).upper() + "!!"))
    return good | bad, [(i, int(i < n), 0) for i in range(2 * n)]


def test_quality_on_held_out_documents(spark, odd):
    texts, marks = labelled(random.Random(9), 150)
    docs = spark.createDataFrame(rows_of(texts) + [(1000 + i, *r[1:]) for i, r in enumerate(odd)], DOCS)
    labels = spark.createDataFrame([*marks, (3, None, 0), (None, 1, 0), (5, 1, 1)], "doc_id long, quality int, toxic int")
    rows = quality.quality_scores(docs, labels).collect()
    assert len(rows) == len(texts) + len(odd) and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id < 300]
    assert {r.doc_id for r in held} == {i for i in texts if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r.predicted == (r.doc_id < 150) for r in held]) > 0.95
    assert all(r.predicted == (r.score >= 0.3) for r in rows)
    kept = quality.good_documents(docs, labels).collect()
    assert Counter(r.doc_id for r in kept) == Counter(r.doc_id for r in rows if r.predicted)


def test_quality_without_labels(odd, odd_docs, no_docs, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.quality_scores(odd_docs, none).collect()} == {0.5}
    assert quality.quality_scores(no_docs, none).collect() == []
    one = spark.createDataFrame([(i, 1, 0) for i in range(12)], "doc_id long, quality int, toxic int")
    assert {r.predicted for r in quality.quality_scores(odd_docs, one).collect()} == {1}


# 6 near-duplicates


def brute_components(rows):
    sets = defaultdict(set)
    sizes = []
    for d, t, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(ASCII))
        own = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
        sizes.append((d, len(own)))
        if own and d is not None:
            sets[d].add(frozenset(own))
    root = {d: d for d, *_ in rows if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and any(100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return Counter((d, n, None if d is None else find(d), d is None or find(d) == d) for d, n in sizes)


def test_near_duplicates_against_brute_force(spark, odd):
    rng = random.Random(12)
    texts = [(100 + i, prose(rng, rng.randint(1, 150))) for i in range(60)]
    for i in range(90):  # copies with a few words changed, around the threshold
        words = texts[rng.randrange(60)][1].split()
        for _ in range(rng.choice((0, 1, 2, 3, 4, 5, 6))):
            words[rng.randrange(len(words))] = rng.choice(WORDS) * 2
        texts.append((200 + i, " ".join(words).upper() if i % 9 == 0 else " ".join(words)))
    hot = prose(rng, 200).split()  # a dense group
    for i in range(120):
        words = list(hot)
        for _ in range(3):
            words[rng.randrange(len(words))] = f"x{rng.randint(0, 30)}"
        texts.append((400 + i, " ".join(words)))
    rows = rows_of(texts) + odd
    got = near_dups.near_duplicates(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    assert Counter(map(tuple, got)) == brute_components(rows)


def test_one_document_of_each_group_stays(odd, odd_docs, no_docs):
    kept = near_dups.distinct_documents(odd_docs)
    assert kept.columns == odd_docs.columns
    # 1 stands for its repeated row and for 6; rows without an id stay
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 2, 3, 4, 5, 7, 8, 9, 10, 11, None, None])
    assert near_dups.near_duplicates(no_docs).collect() == []


def test_the_model_learns_and_scores_without_looking_words_up_again(spark, monkeypatch):
    """Words become ids once; learning and scoring read the written ids."""
    rng = random.Random(23)
    docs = spark.createDataFrame(rows_of([(i, prose(rng, rng.randint(1, 40))) for i in range(80)] + [(100, None)]), DOCS)
    columns = []
    lessons = lm_score._lessons

    def seen(docs, vocab):
        columns.append(docs.columns)
        return lessons(docs, vocab)

    monkeypatch.setattr(lm_score, "_lessons", seen)
    lm_score.scores(docs)
    assert columns == [["ids"]]
    monkeypatch.undo()
    texts = common.whole_texts(docs)
    training = texts.where(~lm_score.held_out())
    vocab = lm_score.vocabulary(lm_score.word_counts(training), training.count())
    rows = lm_score._coded(texts.coalesce(1), vocab)
    again = lm_score.trained(rows.where(~lm_score.held_out()).select("ids"), vocab)
    plain = lm_score.trained(training.select("text").coalesce(1), vocab)
    assert all((again[k] == plain[k]).all() for k in plain)


def test_learning_asks_for_its_memory_once(monkeypatch):
    rng = np.random.default_rng(4)
    texts = [rng.integers(0, gru.HEAD, gru.STREAM_TOKENS) for _ in range(3)]
    rooms = []
    slopes = gru._slopes

    def seen(w, ids, target, h, weight, room):
        rooms.append((room, {k: id(v) for k, v in room.held.items() if k != "mine"}))
        return slopes(w, ids, target, h, weight, room)

    monkeypatch.setattr(gru, "_slopes", seen)
    gru.train(gru.started(np.ones(gru.HEAD), np.ones(gru.TAILS)), texts)
    assert len(rooms) == gru.STREAM_TOKENS // gru.WINDOW and len({id(r) for r, _ in rooms}) == 1
    assert rooms[1][1]["x"] == rooms[-1][1]["x"] and rooms[1][1]["through"] == rooms[-1][1]["through"]


def test_scores_beyond_the_range_of_exponentials_stay_finite():
    rng = np.random.default_rng(5)
    w = {k: v.astype(np.float32) for k, v in gru.started(np.ones(gru.HEAD), np.ones(gru.TAILS)).items()}
    w["to_class"] = rng.normal(0, 60, gru.SHAPES["to_class"]).astype(np.float32)
    w["to_word"] = rng.normal(0, 60, gru.SHAPES["to_word"]).astype(np.float32)
    assert not gru._tame(w["to_class"], w["class_bias"]) and not gru._tame(w["to_word"], w["word_bias"])
    h = np.repeat(np.tanh(rng.normal(size=(1, gru.UNITS))).astype(np.float32), gru.HEAD + gru.TAILS, 0)
    chances = gru._log_chances(w, h, np.arange(gru.HEAD + gru.TAILS))
    assert np.isfinite(chances).all() and abs(np.exp(chances).sum() - 1) < 1e-4


# 7 packing


def test_packing_against_the_library(spark, odd, odd_docs, no_docs):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path(packing.VOCABULARY)
    library = Tokenizer.from_file(path)
    rows = packing.packed(odd_docs.repartition(3), path, with_ids=True).collect()
    want = Counter((d, bytes(np.array(library.encode(t or "", add_special_tokens=False).ids + [1], dtype="<u4"))) for d, t, *_ in odd)
    whole, line = Counter(), defaultdict(list)
    for r in rows:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        line[r.sequence_id].append(r)
    stream, place = [], 0
    for s in sorted(line):
        at = 0
        for r in sorted(line[s], key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
            stream.append(r)
        place += at
        assert at == packing.LENGTH or s == max(line)
    ids = b""
    for r in stream:  # the pieces of a document follow each other in the stream
        ids = ids + r.ids if r.start else r.ids
        if r.start + r.length == r.doc_tokens:
            whole[(r.doc_id, ids)] += 1
    assert whole == want and place == sum(len(k[1]) // 4 * n for k, n in want.items())
    assert packing.packed(no_docs, path).collect() == []


def test_letter_merges_equal_the_library():
    words = packing.WordIds(queries.tokenizer_path(packing.VOCABULARY))
    rng = random.Random(3)
    made = list({"".join(rng.choice("aabcdeeghinorstéèüñßç") for _ in range(rng.randint(1, 24))) for _ in range(4000)})
    library = words.tokenizer.encode_batch(made, add_special_tokens=False)
    assert words.letters(made) == [np.array(e.ids, dtype="<u4").tobytes() for e in library]
    text = "abc<| x<|endoftext|>.. wörd&&&\nNext\tTab. a's. don't'. x.'s (Foo) É.É\r\nb\x85c\x1cd &&'s !! ab-cd. ªº µ,"
    assert words([text])[0] == np.array(words.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_letter_merges_look_up_changed_pairs_only(monkeypatch):
    """First pairs come from a table; each join then looks at the pairs on its two sides."""
    words = packing.WordIds(queries.tokenizer_path(packing.VOCABULARY))
    looked = []
    ranks = words.letters._ranks

    def seen(left, right):
        looked.append(left.size)
        return ranks(left, right)

    monkeypatch.setattr(words.letters, "_ranks", seen)
    made = ["thethingandé", "qxzvkqxz", "a", "inter"]
    joins = sum(len(w.encode()) - len(ids) // 4 for w, ids in zip(made, words.letters(made), strict=True))
    assert sum(looked) <= 2 * joins


# 8 personal data

PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
]


def plain_spans(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            checks = (True, kind != 1 or all(int(x) <= 255 for x in m[0].split(".")), 16 <= len(digits) <= 19 and pii.luhn(digits), 8 <= len(digits) <= 15)
            if checks[kind]:
                out.append((kind, *m.span()))
    return out


def test_patterns_against_plain_regular_expressions():
    rng = random.Random(1)
    for _ in range(20_000):
        text = "".join(rng.choice("0123456789" * 2 + "..@@+-- ()aB%") for _ in range(rng.randint(0, 60)))
        assert pii.base_spans(text) == plain_spans(text), text


def test_personal_data(spark, odd):
    more = [
        (50, "mail joe.1@site.example.com or 10.2.33.4 now"),
        (51, "call (415) 555-0199 today, phone 415-555-0111."),
        (52, "contact joe [at] site [dot] org please"),
        (53, "card 4111 1111 1111 1111 and +1 (988) 555-2485 in 2024-05-06 at 12:30"),
        (54, "1" * 100_000 + "@" + "." * 1000),
    ]
    docs = spark.createDataFrame(rows_of(more) + odd, DOCS)
    rows = pii.personal_data(docs).collect()
    for d, t, *_ in rows_of(more) + odd:
        base = plain_spans(t or "") if len(t or "") < 10_000 else []
        digest = hashlib.sha256(",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in base).encode()).hexdigest()
        mine = [r for r in rows if r.doc_id == d]
        assert digest in {r.base_sha256 for r in mine}
    spans = {r.doc_id: r.spans for r in rows}
    assert spans[51] == "phone:5:19,phone:33:45" and spans[52] == "email:8:31"
    assert [(r.n_email, r.n_ip, r.n_card, r.n_phone) for r in rows if r.doc_id in (50, 53)] == [(1, 1, 0, 0), (0, 0, 1, 1)]
    masked = {r.doc_id: r for r in pii.masked(docs).collect()}
    assert masked[50].text == "mail [EMAIL] or [IP] now" and masked[50].n_chars == 24
    assert masked[2].text is None and masked[8].text == dict(r[:2] for r in odd)[8]
    assert pii.masked(docs.limit(0)).collect() == [] == pii.personal_data(docs.limit(0)).collect()


def test_the_field_finds_fresh_forms():
    field = pii.trained(pii.labelled_table())
    hit = total = wrong = 0
    for text, spans in pii.labelled_table(3, 99):
        base = pii.base_spans(text)
        found = set(base) | set(pii.added_spans(field, [text], [base])[0])
        total += len(spans)
        hit += len(found & set(spans))
        wrong += len(found - set(spans))
    assert hit / total > 0.85 and wrong / total < 0.12


# 9 byte-level BPE


def test_bpe_against_the_library(odd, odd_docs, no_docs):
    import public_tokenizers
    import tiktoken

    path = queries.tokenizer_path(bpe.FILE)
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for d, t, *_ in odd:
        ids = np.array(library.encode_ordinary(t or ""), dtype="<u4")
        want[(d, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())] += 1
    got = Counter(map(tuple, bpe.encoded(odd_docs, path, public_tokenizers.PATTERN).collect()))
    assert got == want
    assert bpe.encoded(no_docs, path, public_tokenizers.PATTERN).collect() == []


def test_bpe_merges_many_pieces_at_once():
    import public_tokenizers
    import tiktoken

    tokens = bpe.load_ranks(queries.tokenizer_path(bpe.FILE))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    rng = random.Random(8)
    pieces = [bytes(rng.choices(range(256) if i % 2 else b"abceghinorst \xc3\xa9", k=rng.randint(1, 40))) for i in range(2000)]
    pieces += [b"a", b"ab" * 3000]
    assert list(bpe.Merges(tokens)(pieces)) == [library._core_bpe.encode_single_piece(p) for p in pieces]
    with pytest.raises(ValueError, match="byte"):
        bpe.Merges(tokens[256:])


def test_bpe_keeps_pieces_that_are_used_again(monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(bpe, "KEPT", 3)
    tokens = bpe.load_ranks(queries.tokenizer_path(bpe.FILE))
    merges, merged = bpe.Merges(tokens), Counter()

    def seen(pieces):
        merged.update(pieces)
        return merges(pieces)

    coder = bpe.TwoTier(tokens, bpe.PerfectHash(tokens), seen, public_tokenizers.PATTERN)
    for i in range(20):
        assert coder.decode(coder.encode([f" qxzvkqxz rare{i}zzqx yy{i}vvqxk"])[0]).decode() == f" qxzvkqxz rare{i}zzqx yy{i}vvqxk"
    assert merged[b" qxzvkqxz"] == 1 and len(coder.new) + len(coder.old) <= 20


def test_the_hash_is_perfect_and_minimal():
    tokens = bpe.load_ranks(queries.tokenizer_path(bpe.FILE))[:5000]
    perfect = bpe.PerfectHash(tokens)
    assert perfect.candidates(tokens).tolist() == list(range(5000)) and len(perfect.rank) == 5000


# 10 nearest neighbours


def test_nearest_neighbours_reach_the_recall(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 16))
    vectors = centres[rng.integers(0, 30, 3000)] + 0.3 * rng.normal(size=(3000, 16))
    vectors[1000:1600] = vectors[40]  # a vector that a fifth of the rows share
    rows = [(i, v.astype(np.float32).tolist(), 1, 0.5) for i, v in enumerate(vectors)]
    odd = [(5000, None, 1, 0.1), (5020, [], 1, 0.1), (5040, [0.0] * 16, 1, 0.1), (5060, [float("nan")] * 16, 1, 0.1),
           (5080, [None] * 16, 1, 0.1), (None, [1.0] * 16, 1, 0.1), (5100, [float("inf")] * 16, 1, 0.1), (5120, [1.0, 2.0], 1, 0.1),
           (40, rows[40][1], 1, 0.2)]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int, score double").repartition(4)
    found = ann.neighbours(frame, ann.every_twentieth(frame)).toPandas()
    given = {i: np.array(v, dtype=np.float64) for i, v, *_ in rows} | {5120: np.array([1.0, 2.0] + [0.0] * 14)}
    ids, matrix = np.array(list(given)), np.array(list(given.values()))
    assert set(found["query_id"]) == {i for i in given if i % 20 == 0}
    hits = total = 0
    for query_id, own in found.groupby("query_id"):
        own = own.sort_values("rank")
        scores = matrix @ given[query_id]
        scores[ids == query_id] = -np.inf
        best = ids[np.lexsort((ids, -scores.round(9)))[:20]]
        assert own["rank"].tolist() == list(range(1, 21)) and query_id not in set(own["vec_id"])
        assert np.allclose(own["score"], [given[query_id] @ given[i] for i in own["vec_id"]])
        assert (np.diff(own["score"]) <= 0).all()
        hits += len(set(best) & set(own["vec_id"]))
        total += 20
    assert hits / total >= 0.9


def test_few_vectors(spark):
    schema = "vec_id long, embedding array<double>, label int"
    three = spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [0.5, 0.5], 1), (2, [0.5, 0.5], 1)], schema)
    assert [tuple(r) for r in ann.neighbours(three, ann.every_twentieth(three)).orderBy("rank").collect()] == [(0, 1, 1, 0.5), (0, 2, 2, 0.5)]
    assert ann.neighbours(three.limit(0), three.limit(0)).collect() == []
    assert ann.neighbours(three.limit(1), three.limit(1)).collect() == []
