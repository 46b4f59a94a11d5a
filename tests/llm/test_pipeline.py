"""The corpus pipeline on planted documents: every stage's decisions, and the packed result."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from test_operators import brute_components, labelled, prose, rows_of

import corpus_pipeline
from pubmart.llm import packing, queries

NAMES = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    rng = random.Random(21)
    texts, marks = labelled(rng, 150)
    passage = prose(rng, 90)
    texts[1000] = texts[3]  # an exact copy
    words = prose(rng, 200).split()
    texts[1001] = " ".join(words)
    words[50], words[120] = "changed", "words"
    texts[1002] = " ".join(words)  # a near copy
    texts[1003] = prose(rng, 80) + " " + passage + " " + prose(rng, 40)
    texts[1004] = prose(rng, 60) + " " + passage + " " + prose(rng, 70)
    texts[1005] = prose(rng, 60) + " mail ann.2@site.example.com or call (415) 555-0199 now " + prose(rng, 60)
    folder = tmp_path_factory.mktemp("corpus")
    frame = pd.DataFrame([r[:5] for r in rows_of(texts)], columns=NAMES)
    frame.to_parquet(folder / "documents.parquet")
    pd.DataFrame(marks, columns=["doc_id", "quality", "toxic"]).to_parquet(folder / "labels.parquet")
    return str(folder), texts, passage


def test_stages_and_result(spark, corpus):
    folder, texts, passage = corpus
    docs, after = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == NAMES, name
        rows = docs.collect()
        docs = spark.createDataFrame(rows, docs.schema)
        after[name] = {r.doc_id: r.text for r in rows}
        assert len(after[name]) == len(rows) and all(r.n_chars == len(r.text) for r in rows), name
    good, distinct, cut, masked = (after[name] for name, _ in corpus_pipeline.STAGES[:-1])

    assert sum(i in good for i in range(150)) >= 147 and sum(i in good for i in range(150, 300)) <= 6
    assert {1000, 1001, 1002, 1003, 1004, 1005} <= set(good)
    assert all(good[i] == texts[i] for i in good)

    found = brute_components(rows_of(good))
    assert set(distinct) == {d for d, _, _, kept in found if kept} and 1000 not in distinct and 1002 not in distinct

    assert set(cut) == set(distinct) and passage in cut[1003] and passage not in cut[1004]
    changed = {i for i in cut if cut[i] != distinct[i]}
    assert changed == {1004} and len(cut[1004].split()) < len(distinct[1004].split()) - 55

    assert {i for i in masked if masked[i] != cut[i]} == {1005}
    assert "[EMAIL] or call [PHONE] now" in masked[1005]

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer_path(packing.VOCABULARY))
    pieces = defaultdict(list)
    for r in corpus_pipeline.run(spark, folder).collect():
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    assert set(pieces) == set(masked)
    import zlib

    for i, text in masked.items():
        ids = np.array(library.encode(text, add_special_tokens=False).ids + [1], dtype="<u4")
        for start, length, crc, n in pieces[i]:
            assert n == len(ids) and zlib.crc32(ids[start : start + length].tobytes()) == crc
        assert sum(p[1] for p in pieces[i]) == len(ids)


def test_empty_corpus(spark, tmp_path):
    pd.DataFrame({n: pd.Series(dtype="str" if n in ("text", "lang", "source") else "int64") for n in NAMES}).to_parquet(tmp_path / "documents.parquet")
    pd.DataFrame({"doc_id": [1], "quality": [1], "toxic": [0]}).to_parquet(tmp_path / "labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_odd_corpus(spark, tmp_path):
    """Null texts and ids, repeated ids, extra columns and a very long text go through every stage."""
    rng = random.Random(23)
    texts, marks = labelled(rng, 60)
    long = prose(rng, 20_000)
    rows = [*texts.items(), (500, None), (501, ""), (None, texts[1]), (None, None), (2, texts[2]), (2, prose(rng, 90)), (502, long)]
    extra = ["score", "part", "component_id", "votes"]
    frame = pd.DataFrame([[*r[:5], "x", 1, 2, 3] for r in rows_of(rows)], columns=NAMES + extra)
    frame["doc_id"] = frame["doc_id"].astype("Int64")
    frame["n_chars"] = frame["n_chars"].astype("Int64")
    frame.to_parquet(tmp_path / "documents.parquet")
    pd.DataFrame(marks, columns=["doc_id", "quality", "toxic"]).to_parquet(tmp_path / "labels.parquet")
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    given = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == NAMES + extra, name
        kept = docs.collect()
        assert 0 < len(kept) <= given and all((r.score, r.part, r.component_id, r.votes) == ("x", 1, 2, 3) for r in kept), name
        docs, given = spark.createDataFrame(kept, docs.schema), len(kept)
    ids = [r.doc_id for r in kept]
    assert ids.count(2) <= 2 and [r.text for r in kept if r.doc_id == 502] in ([], [long])
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {p.doc_id for p in pieces} == set(ids)
    offsets = sorted((p.sequence_id, p.offset, p.length) for p in pieces)
    places = [s * packing.LENGTH + o for s, o, _ in offsets]
    assert places == [0, *(p + n for p, (_, _, n) in zip(places, offsets, strict=True))][:-1]
