"""Scores beside a plain version: the same sample, dictionaries and sizes from the library, and weights by Newton's method."""

import random
import struct

import numpy as np
import pytest
import xxhash
import zstandard

from ridgeline.llm import zstd_quality

RANDOM = random.Random(9)
GOOD = ["the", "river", "runs", "past", "old", "stones", "and", "quiet", "fields", "of", "barley", "under", "rain"]
BAD = ["BUY", "now!!", "click", "here", "win", "$$$", "free", "offer", "the", "of"]


def prose(words, n):
    return " ".join(RANDOM.choice(words) for _ in range(n))


def some(n):
    rows = []
    for i in range(n):
        good = i % 2
        words = GOOD if good else BAD
        rows.append((i, prose(words + (BAD if RANDOM.random() < 0.2 else GOOD), RANDOM.randrange(20, 300)), good))
    return rows


def place(i):
    return struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(struct.pack("<q", i), 42)))[0]


def plain_model(rows, per_label, dictionary):
    by = {}
    for k in (0, 1):
        own = sorted((place(i), t.encode()) for i, t, y in rows if y == k)[:per_label]
        by[k] = [t for _, t in own]
    packers = {}
    for k, own in by.items():
        trained = zstandard.train_dictionary(dictionary, own[: len(own) // 2], level=3)
        packers[k] = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(trained.as_bytes()), write_content_size=False, write_dict_id=False)

    def figures(text):
        good, bad, n = len(packers[1].compress(text)), len(packers[0].compress(text)), max(1, len(text))
        gap, ratio, size = (bad - good) / (bad + good), good / n, np.log(1 + n) / 10
        return np.array([1, gap, ratio, gap * ratio, ratio**2, size, size * ratio])

    x = np.array([figures(t) for k in (0, 1) for t in by[k][len(by[k]) // 2 :]])
    y = np.array([float(k) for k in (0, 1) for _ in by[k][len(by[k]) // 2 :]])
    w, pull = np.zeros(7), 1e-5 * len(y) * np.diag([0.0] + [1.0] * 6)
    for _ in range(200):
        p = 1 / (1 + np.exp(-x @ w))
        w = w + np.linalg.solve(x.T @ np.diag(p * (1 - p)) @ x + pull + 1e-9 * np.eye(7), x.T @ (y - p) - pull @ w)
    return lambda text: 1 / (1 + np.exp(-np.clip(figures(text.encode()) @ w, -30, 30)))


def tables(spark, rows):
    table = spark.createDataFrame(rows, "doc_id bigint, text string, quality int")
    return table.select("doc_id", "text"), table.select("doc_id", "quality")


def test_scores_equal_the_plain_version(spark):
    rows = some(400)
    docs, labels = tables(spark, rows)
    model = zstd_quality.fit(docs, labels, per_label=120, dictionary=4096)
    plain = plain_model(rows, 120, 4096)
    found = {r.doc_id: r.score for r in zstd_quality.score(docs, model).collect()}
    assert len(found) == 400
    for i, t, _ in rows:
        assert found[i] == pytest.approx(plain(t), abs=1e-7)
    held = [(found[i] >= 0.5) == bool(y) for i, _, y in rows]
    assert sum(held) > 0.8 * len(held)


def test_the_sample_is_bounded_by_rows_and_bytes(spark, monkeypatch):
    """An id on very many rows counts once; texts beyond the bound of bytes stay out of the training task."""
    rows = some(100) + [(7, "copy of the same id " + str(i), 1) for i in range(3000)] + [(1001, "x y " * 400_000, 1), (1003, "z " * 700_000, 1)]
    docs, labels = tables(spark, rows)
    one = zstd_quality.fit(docs, labels, per_label=30, sample_bytes=60_000)
    two = zstd_quality.fit(docs.repartition(7), labels, per_label=30, sample_bytes=60_000)
    assert one == two
    traced = zstd_quality._train
    seen = spark.sparkContext.accumulator(0)
    largest = spark.sparkContext.accumulator(0)

    def counting(pairs, dictionary):
        seen.add(len(pairs))
        largest.add(sum(len(t) for t, _ in pairs))
        return traced(pairs, dictionary)

    monkeypatch.setattr(zstd_quality, "_train", counting)
    zstd_quality.fit(docs, labels, per_label=30, sample_bytes=60_000)
    assert 0 < seen.value <= 60 and 0 < largest.value <= 60_000


def test_repeated_rows_and_empty_tables(spark):
    rows = some(120)
    docs, labels = tables(spark, rows)
    model = zstd_quality.fit(docs, labels, per_label=60, dictionary=4096)
    twice = zstd_quality.score(docs.unionByName(docs), model).groupBy("doc_id").agg({"score": "count"}).collect()
    assert {r["count(score)"] for r in twice} == {2}
    assert zstd_quality.score(docs.limit(0), model).collect() == []
    nothing = zstd_quality.fit(docs.limit(0), labels)
    assert nothing["weights"] is None and {r.score for r in zstd_quality.score(docs, nothing).collect()} == {0.5}
