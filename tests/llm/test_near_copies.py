"""One row of every class of near copies stays; rows without ids or with one id are told apart."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ridgeline.llm import bk_simhash, shingle_links

RANDOM = random.Random(23)
SCHEMA = "doc_id bigint, text string, source string"


def prose(n):
    return " ".join(f"w{RANDOM.randrange(5000)}" for _ in range(n))


UNLIKE = [prose(200) for _ in range(6)]
#: Several rows without an id, one id with unlike texts, and an exact repeat of a row without id.
SHARED = [(None, UNLIKE[0], "a"), (None, UNLIKE[1], "a"), (None, UNLIKE[2], "b"), (None, UNLIKE[2], "b"), (5, UNLIKE[3], "a"), (5, UNLIKE[4], "b"), (9, UNLIKE[3], "c"), (8, UNLIKE[5], "c"), (None, UNLIKE[5], "c")]


def kept(rows):
    return sorted((r.text, r.doc_id or 0) for r in rows.collect())


@pytest.mark.parametrize("keep", [bk_simhash.keep_one, shingle_links.keep_one])
def test_every_class_keeps_one_row(spark, keep):
    docs = spark.createDataFrame(SHARED, SCHEMA)
    wanted = sorted(zip(UNLIKE, (0, 0, 0, 5, 5, 8)))
    found = keep(docs)
    assert found.columns == docs.columns and kept(found) == wanted


def grams(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def similarity(a, b):
    return len(grams(a) & grams(b)) / len(grams(a) | grams(b))


def changed(text, least):
    """Words replaced one by one while the similarity stays at ``least`` or above."""
    while True:
        words = text[-1].split()
        words[RANDOM.randrange(len(words))] = f"new{RANDOM.randrange(10**6)}"
        if similarity(text[0], " ".join(words)) < least:
            return text[-1]
        text = [text[0], " ".join(words)]


def test_stage_finds_near_copies_down_to_four_fifths(spark):
    pairs = [(t, changed([t], s)) for s in (0.8, 0.85, 0.9, 0.95) for _ in range(25) for t in [prose(300)]]
    below = [(t, " ".join(w if i % 12 else f"new{i}" for i, w in enumerate(t.split()))) for _ in range(10) for t in [prose(300)]]
    assert all(similarity(*p) >= 0.8 for p in pairs) and all(0.3 < similarity(*p) < 0.8 for p in below)
    rows = [(i, t, "a") for i, t in enumerate(t for p in pairs + below for t in p)]
    docs = spark.createDataFrame(rows, SCHEMA)
    stays = {r.doc_id for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, "").collect()}
    n = 2 * len(pairs)
    assert stays == {*range(0, n, 2), *range(n, len(rows))}


def test_classes_equal_brute_force(spark):
    """Chains, a large family whose members are not all alike, texts sharing a long line, short and blank texts."""
    base, line = prose(150), prose(60)
    texts = [None, "", " \n", "one two", "One  two", "one three", *[f"{line} {prose(RANDOM.randrange(10, 60))}" for _ in range(90)]]
    for _ in range(90):
        words = base.split()
        for _ in range(RANDOM.randrange(6)):
            words[RANDOM.randrange(150)] = f"v{RANDOM.randrange(9)}"
        texts.append(" ".join(words))
    sets = [grams(t or "") for t in texts]
    low = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if low[a] != low[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                x, y = sorted((low[a], low[b]))
                low = [x if v == y else v for v in low]
    assert 90 < len(set(low)) < 150
    docs = spark.createDataFrame([(i, t, "a") for i, t in enumerate(texts)], SCHEMA)
    assert sorted(r.doc_id for r in shingle_links.keep_one(docs).collect()) == sorted(set(low))
    assert shingle_links.keep_one(docs.where("false")).collect() == []


def test_unlike_texts_with_a_common_line_make_few_pairs(spark, monkeypatch):
    """Texts of 100 words that share 60 are no candidates: compared pairs grow no faster than the rows."""
    asked = []
    plain = shingle_links._verified

    def counting(pairs, arrays, percent):
        asked.append(pairs.count())
        return plain(pairs, arrays, percent)

    monkeypatch.setattr(shingle_links, "_verified", counting)
    line, made = prose(60), []
    for n in (150, 600):
        asked.clear()
        docs = spark.createDataFrame([(i, f"{prose(20)} {line} {prose(20)}", "a") for i in range(n)], SCHEMA)
        assert shingle_links.keep_one(docs).count() == n
        made.append(sum(asked))
    assert made[0] <= 150 and made[1] <= 600


def test_sizes_and_places_of_the_prefix_lose_no_pair(spark):
    """Subsets and supersets right at the threshold, unsampled orders, and a family that needs several representatives."""
    base = prose(120).split()
    texts = [" ".join(base[a:b]) for a in range(0, 24, 3) for b in range(96, 121, 3)]
    texts += [" ".join(base[:60] + base[60 + k :]) for k in range(0, 30, 2)]
    sets = [grams(t) for t in texts]
    low = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if low[a] != low[b] and 10 * len(sets[a] & sets[b]) >= 9 * len(sets[a] | sets[b]):
                x, y = sorted((low[a], low[b]))
                low = [x if v == y else v for v in low]
    docs = spark.createDataFrame([(i, t, "a") for i, t in enumerate(texts)], SCHEMA)
    assert sorted(r.doc_id for r in shingle_links.keep_one(docs, percent=90).collect()) == sorted(set(low))


def test_names_maps_and_long_texts(spark):
    """Odd and clashing names, a MAP column on repeated rows, and a very long text, in both stages that choose a row."""
    long = prose(60_000)
    rows = [(3, long, {"a": 1}, "x"), (3, long, {"b": 2}, "x"), (4, long + " more", {}, "y"), (5, "one two", None, None), (5, "one two", None, None)]
    schema = "doc_id bigint, text string, `my-col` map<string,int>, digest string"
    docs = spark.createDataFrame(rows, schema).select("*", *(F.lit(1).alias(c) for c in ("class", "row", "keys", "n", "_id")))
    for name, ids in (("exact_dedup", [3, 4, 5]), ("near_dedup", [3, 5])):
        found = dict(corpus_pipeline.STAGES)[name](spark, docs, "")
        assert found.columns == docs.columns and sorted(r.doc_id for r in found.collect()) == ids, name
