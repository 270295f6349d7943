"""Phrases against counts of all n-grams in plain Python, and the transducers by themselves."""

import random
import re
from array import array
from collections import Counter, defaultdict

import pytest

from ridgeline.llm import common, phrase_automata

RANDOM = random.Random(13)
FIELDS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def pieces(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def brute(docs, least, top):
    f = defaultdict(Counter)
    for lang, text in docs:
        for p in pieces(text):
            for size in (1, 2, 3):
                f[lang or "und"].update(tuple(p[i : i + size]) for i in range(len(p) - size + 1))
    found = []
    for lang, own in f.items():
        n = sum(c for g, c in own.items() if len(g) == 1)
        candidates = {g: c for g, c in own.items() if len(g) > 1 and c >= least}
        rows = []
        for g, a in candidates.items():
            if any(100 * c >= 50 * a and g in (h[:2], h[1:]) for h, c in candidates.items() if len(h) > len(g)):
                continue
            score, _, left, right = min((1_000_000 * a * a // (own[g[:k]] * own[g[k:]]), k, own[g[:k]], own[g[k:]]) for k in range(1, len(g)))
            rows.append((-score, -a, " ".join(g).encode(), left, right))
        found += [(lang, i, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)]
    return sorted(found)


def texts(n):
    words = [f"w{i}" for i in range(30)] + ["Über", "ÉTÉ", "a b", "New", "York", "city"]
    share = [1 / (i + 1) for i in range(len(words))]
    out = []
    for i in range(n):
        text = RANDOM.choices(words, share, k=RANDOM.randrange(0, 80))
        marks = [w + RANDOM.choice([" ", " ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "!"]) for w in text]
        out.append((RANDOM.choice(["en", "en", "de", None, "und"]), "".join(marks) + RANDOM.choice(["", "New York city", "the hot pair"])))
    return out + [("en", None), (None, ""), ("xx", " .,"), ("de", "long " * 5000), ("yy", "x" * 100_000)]


@pytest.mark.parametrize(("shard", "size"), [(1 << 21, 1 << 18), (200, 30)])
def test_equals_counts_of_all_ngrams(spark, monkeypatch, shard, size):
    """Also with tiny shards and with frequent first words spread over many ranges."""
    monkeypatch.setattr(phrase_automata, "SHARD", shard)
    monkeypatch.setattr(phrase_automata, "RANGE", size)
    docs = texts(300)
    docs += docs[:40]
    frame = spark.createDataFrame([(lang, t, 1, "x") for lang, t in docs], "lang string, text string, head int, phrase string").repartition(4)
    for top in (15, 2000):
        found = sorted(tuple(r[f] for f in FIELDS) for r in phrase_automata.collocations(frame, least=10, top=top).collect())
        assert found == brute(docs, 10, top) and len(found) > 15


def test_empty_table(spark):
    none = spark.createDataFrame([], "lang string, text string")
    found = phrase_automata.collocations(none)
    assert found.collect() == [] and found.columns == list(FIELDS)


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_transducer_round_trip(depth):
    """Paths come back in order with their counts, and equal states are stored once."""
    letters = [bytes([c]) for c in b"abcdef"]
    grams = sorted({tuple(RANDOM.choice(letters) for _ in range(depth)) for _ in range(150)})
    weights = {g: 1 + (g[-1][0] % 3) for g in grams}
    build, runs = phrase_automata.Builder(depth), defaultdict(list)
    for g in grams:
        runs[g[:-1]].append(g[-1])
    for prefix, labels in runs.items():
        build.add(prefix, labels, array("q", [weights[prefix + (x,)] for x in labels]).tobytes())
    words, values = build.finish()
    assert list(phrase_automata.paths(words, values, depth)) == [(b" ".join(g), weights[g]) for g in grams]
    total = {}
    for _ in range(2):
        phrase_automata.add_paths(total, words, values, depth)
    twice = phrase_automata.transducer(total, depth, 4)
    assert list(phrase_automata.paths(*twice, depth)) == [(b" ".join(g), 2 * weights[g]) for g in grams if weights[g] >= 2]
    assert len(set(zip(words[:-1], values[:-1]))) == len(words) - 1


def test_bit_table_never_loses_a_key(spark, monkeypatch):
    from pyspark.sql import functions as F

    keys = spark.range(3000).select(F.lit("en").alias("lang"), F.concat(F.lit("k"), "id").alias("word"))
    own = [f"k{i}".encode() for i in range(3000)]
    for bits in (1 << 28, 1 << 12):
        monkeypatch.setattr(common, "BITS", bits)
        held = common.BitTable(keys.select(F.xxhash64("lang", "word").alias("h")))
        assert held.holds(phrase_automata._hashes(own, phrase_automata._start("en"))).all()


@pytest.mark.parametrize("n", [5, 1 << 20, 1 << 30])
def test_counts_of_rows_of_numbers(n):
    """Also of numbers that do not fit in 64 bits together."""
    np = phrase_automata.np
    for width in (2, 3):
        rows = [[RANDOM.choice([0, 1, n // 2, n - 1]) for _ in range(width)] for _ in range(200)]
        columns, count = phrase_automata._counted([np.array(c, np.int64) for c in zip(*rows)], n)
        assert dict(zip(zip(*(c.tolist() for c in columns)), count.tolist())) == Counter(map(tuple, rows))
        assert list(zip(*(c.tolist() for c in columns))) == sorted(set(map(tuple, rows)))


def test_texts_are_cut_into_words_once(spark, monkeypatch):
    cut = spark.sparkContext.accumulator(0)
    whole = phrase_automata.tokens

    def counting(text):
        cut.add(1)
        return whole(text)

    monkeypatch.setattr(phrase_automata, "tokens", counting)
    rows = [(i, "fr" if i % 3 else None, "red green, blue red green blue\nred" if i % 7 else None) for i in range(200)]
    found = phrase_automata.collocations(spark.createDataFrame(rows, "doc_id bigint, lang string, text string"))
    assert ("und", "red green blue") in {(r.lang, r.phrase) for r in found.collect()}
    assert cut.value == 200
