"""The pipeline's rows against its stages in plain Python, on the smallest tables."""

import hashlib
import os
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
from ridgeline.llm import mixing, quality_rules
from ridgeline.llm.common import table

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")


def five_words(text):
    words = text.encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_rows_equal_plain_stages(spark):
    docs = table(spark, FOLDER, "documents")
    good = {r.doc_id for r in quality_rules.judge(docs).where("kept").collect()}  # held against brute force elsewhere
    rows = {r.doc_id: r for r in docs.collect() if r.doc_id in good}
    texts = defaultdict(list)
    for i, r in rows.items():
        texts[r.text.encode().lower()].append(i)
    rows = {i: rows[i] for i in (max(own) for own in texts.values())}
    ids = sorted(rows)
    sets = {i: five_words(rows[i].text) for i in ids}
    low = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if low[b] < low[a] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                    low[a], changed = low[b], True
    assert len(set(low.values())) < len(ids)  # some are near copies
    rows = {i: rows[i] for i in ids if low[i] == i}
    left = spark.createDataFrame(list(rows.values()), docs.schema)
    times = {r.doc_id: r.taken // r.size for r in mixing.mix(left).collect()}  # its SQL counterpart is compared elsewhere
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    wanted = Counter()
    for i, r in rows.items():
        packed = model.encode(r.text, add_bos=True, add_eos=True)
        wanted[i, len(packed), hashlib.sha256(np.array(packed, "<u4").tobytes()).hexdigest(), hashlib.sha256(model.decode(packed).encode()).hexdigest()] += times[i]
    assert Counter(map(tuple, corpus_pipeline.run(spark, FOLDER).collect())) == +wanted


def test_stages_keep_the_columns(spark):
    docs = table(spark, FOLDER, "documents").limit(0)
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, docs, FOLDER)
        assert out.columns == docs.columns and out.collect() == [], name
