import math
import re
from collections import Counter

from ridgeline.llm import quality_rules as Q

BLANK = "[\x20\x09-\x0d]"


def brute(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [line for line in text.split("\n") if re.search("[^\x20\x09-\x0d]", line)]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
        len(words) < 50 or 100 * len(covered) > 50 * len(words),
    )


TEXTS = [
    None, "", "  \n\t", "a b c a b c", "a a a a a a", "x\n\nx\n x\nx", "Ä\xa0ö # | <b>\r\ncd\x0bef\x1cgh ijk\x85l", "a b c " * 5000 + "tail " * 3,
    " ".join(f"w{i}" for i in range(20000)), "one two three four\none two three four\nfive one two three", " lead", "trail ", "a b c d b c d e b c d",
]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "n", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, n_words string, row int")


def test_figures_match_brute_force(spark):
    rows = {r.doc_id: r for r in Q.judge(frame(spark, TEXTS)).collect()}
    for i, text in enumerate(TEXTS):
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(text), i


def em(patterns, rules, rounds=50):
    """The same estimate in plain Python."""
    prior, wrong, caught = 0.8, [0.05] * rules, [0.5] * rules

    def good(v):
        odds = math.log(prior / (1 - prior))
        for j, x in enumerate(v):
            odds += math.log(wrong[j] / caught[j]) if x == -1 else math.log((1 - wrong[j]) / (1 - caught[j])) if x == 1 else 0
        return 1 / (1 + math.exp(-odds))

    for _ in range(rounds):
        q = {v: good(v) for v in patterns}
        prior_next = (sum(n * q[v] for v, n in patterns.items()) + 1) / (sum(patterns.values()) + 2)

        def rate(j, of, hits, votes):
            return (sum(n * of(v) for v, n in patterns.items() if v[j] == -1) + hits) / (sum(n * of(v) for v, n in patterns.items() if v[j]) + votes)

        new = [rate(j, lambda v: q[v], *Q.WRONG) for j in range(rules)], [rate(j, lambda v: 1 - q[v], *Q.CAUGHT) for j in range(rules)]
        prior, (wrong, caught) = prior_next, new
    return good


def test_posterior_matches_plain_em(spark):
    good = "Each of these plain sentences says something new about number {} and then goes on with word{} and more{} as it should. "
    texts = ["".join(good.format(k, k * i, k + i) for k in range(20 + i % 9)) for i in range(60)]
    texts += ["".join(f"W{k}*** x{k}### y{k * i}&&& " for k in range(60)) for i in range(1, 6)]
    texts += ["".join(f"SHOUT{k}!! AT{k * i}!! ALL{k}!! " for k in range(60)) for i in range(1, 6)]
    rows = Q.judge(frame(spark, texts)).collect()
    prob = em(Counter(tuple(r.votes) for r in rows if not r.base_failed), len(Q.RULES))
    for r in rows:
        assert abs(r.probability - prob(tuple(r.votes))) < 1e-6
        assert r.kept == (not r.base_failed and r.doc_id < 60)


def test_keep_good_keeps_columns_and_rows(spark):
    docs = frame(spark, TEXTS + ["plain words number %d here" % i * 30 for i in range(3)]).unionByName(frame(spark, TEXTS[8:9]))
    kept = Q.keep_good(docs)
    assert kept.columns == docs.columns
    wanted = sorted((r.doc_id) for r in Q.judge(docs).where("kept").collect())
    assert sorted(r.doc_id for r in kept.collect()) == wanted


def test_empty_table(spark):
    none = frame(spark, TEXTS).where("false")
    assert Q.judge(none).collect() == [] and Q.keep_good(none).collect() == []
