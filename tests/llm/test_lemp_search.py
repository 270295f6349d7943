"""Ranked search against a brute force over all documents."""

import math
import random
import re
from collections import Counter

from ridgeline.llm import lemp_search

RANDOM = random.Random(11)
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id bigint, text string, _item int, score string"


def cut(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, top):
    counts = [Counter(cut(t)) for _, t in docs]
    held = [c for c in counts if c]
    n_docs, n_terms = len(held), sum(sum(c.values()) for c in held)
    df = Counter(t for c in held for t in c)
    found = []
    for item, text in items:
        scored = []
        for (doc, _), c in zip(docs, counts):
            m = 75 + (25 * sum(c.values()) * n_docs) // n_terms if n_terms else 0
            score = 0
            for t, times in Counter(cut(text)).items():
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += times * w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        found += [(item, r, None if none else doc, -s) for r, (s, none, doc) in enumerate(sorted(scored)[:top], 1)]
    return Counter(found)


def some(n, words):
    return " ".join(RANDOM.choice(words) for _ in range(n))


def rows_of(frame):
    return Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in frame.collect())


def test_equals_brute_force(spark, monkeypatch):
    """Small buckets and batches, ties, copies, rows without id or text, a very long text, upper case and marks."""
    monkeypatch.setattr(lemp_search, "ROWS", 64)
    monkeypatch.setattr(lemp_search, "CELLS", 4000)
    words = [f"w{i}" for i in range(60)] + ["Ärger", "KAPPA", "Kappa", "x_y", "日本", "7"]
    docs = [(i, some(RANDOM.randrange(1, 60), words)) for i in range(300)]
    docs += [(900 + i, "w1 w2 w3") for i in range(40)] + [(5, "w1 w2"), (5, "w1 w2"), (None, "w1 w2 w3"), (None, "w4")]
    docs += [(700, None), (701, ""), (702, " .,_ "), (703, some(50_000, words))]
    items = [(i, some(RANDOM.randrange(1, 12), words)) for i in range(25)] + [(1, "w1 w1 w2"), (77, None), (78, "absent"), (None, "w3 w9")]
    frame = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], SCHEMA).repartition(5)
    asked = spark.createDataFrame(items, "item_id bigint, text string")
    for top in (1, 20):
        assert rows_of(lemp_search.search(frame, asked, top=top)) == brute(docs, items, top)
    assert rows_of(lemp_search.search(frame, asked, top=5, block=7)) == brute(docs, items, 5)


def test_buckets_are_pruned(spark):
    """Documents without an item's rare terms are not scored once better ones are known."""
    queries = [lemp_search._Query({0: 1}, lemp_search.weights(lemp_search.np.array([2, 900]), 1000))]
    assert queries[0].rest == 0.0 and queries[0].length == 1.0


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    asked = spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "a")], "doc_id bigint, text string")
    found = lemp_search.search(none, asked)
    assert found.collect() == [] and found.columns == ["item_id", "rank", "doc_id", "score"]
    assert lemp_search.search(docs, asked.limit(0)).collect() == []
    assert lemp_search.search(docs, spark.createDataFrame([(1, None)], "item_id bigint, text string")).collect() == []
