"""The language model against a plain dictionary version, and sums to one in every context."""

import math
import random
import types
import zlib
from collections import Counter, defaultdict

import pytest

from ridgeline.llm import katz

RANDOM = random.Random(2)
WORDS = [f"w{i}" for i in range(60)] + ["Über", "ÜBER", "the", "The"]


def text(n):
    return " ".join(RANDOM.choice(WORDS[: RANDOM.choice([4, 20, 64])]) for _ in range(n)) + RANDOM.choice(["", "\n", " end"])


ROWS = [(i, t, "x") for i, t in enumerate([None, "", " \t", "the The THE", "unseen" * 9, *[text(RANDOM.randrange(1, 60)) for _ in range(150)], text(4000)])] + [(None, "w1 w2", "x"), (7, "w1 w2", "x")]
SCHEMA = "doc_id bigint, text string, score string"
END = "</s>"


def tokens(t):
    return [w.decode() for w in (t or "").encode().lower().split()] + [END]


def is_out(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2


class Plain:
    def __init__(self, texts, order):
        self.order = order
        self.counts = [Counter() for _ in range(order + 1)]
        for t in texts:
            seq = tokens(t)
            for i in range(len(seq)):
                for n in range(1, order + 1):
                    self.counts[n][self.gram(seq, i, n)] += 1
        self.figures = {}
        for n in range(1, order + 1):
            kinds = Counter(self.counts[n].values())
            self.figures[n] = katz.Figures(len(self.counts[n]), sum(self.counts[n].values()), [kinds[c] for c in range(1, katz.K + 2)])
        self.after = [defaultdict(list) for _ in range(order + 1)]
        for n in range(2, order + 1):
            for gram in self.counts[n]:
                self.after[n][gram[:-1]].append(gram)

    @staticmethod
    def gram(seq, i, n):
        """A gram starts at most one before the text."""
        return tuple((["<s>"] + seq)[max(0, i + 2 - n) : i + 2])

    def cut(self, n, c):
        return c * (self.figures[n].discounts()[c] if c <= katz.K else 1.0)

    def unigram(self, word):
        f = self.figures[1]
        left = sum(c * (1 - f.discounts()[c]) * k for c, k in enumerate(f.of_count[: katz.K], 1))
        base = f.total if left > 0 else f.total + 1
        c = self.counts[1][(word,)]
        return self.cut(1, c) / base if c else (left or 1.0) / base

    def prob(self, gram, n):
        """Recursive, for the last word of a gram of order n at most."""
        if n == 1:
            return self.unigram(gram[-1])
        shorter = gram if len(gram) < n else gram[1:]  # at the start of a text the gram stays whole
        seen = self.after[n].get(gram[:-1], [])
        if not seen:
            return self.prob(shorter, n - 1)
        total = sum(self.counts[n][g] for g in seen)
        kept = sum(self.cut(n, self.counts[n][g]) for g in seen)
        if total - kept < 1e-9:
            total += 1
        if self.counts[n][gram]:
            return self.cut(n, self.counts[n][gram]) / total
        lower = sum(self.prob(g if len(g) < n else g[1:], n - 1) for g in seen)
        return (1 - kept / total) / (1 - lower) * self.prob(shorter, n - 1)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_equal_plain_model(spark, order):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    scored, _ = katz.train_and_score(docs, order=order, is_held_out=katz.crc32_held_out(7, 2), block_tokens=300, bucket_tokens=500)
    plain = Plain([t for i, t, _ in ROWS if not is_out(i)], order)
    f = plain.figures[1]
    wanted = []
    for i, t, _ in ROWS:
        seq = tokens(t)
        known = [plain.counts[1][(w,)] for w in seq]
        base = sum(math.log10((c + 1) / (f.total + f.distinct + 1)) for c in known)
        score = sum(math.log10(plain.prob(plain.gram(seq, j, order) if order > 1 else (w,), order)) for j, w in enumerate(seq))
        wanted.append((str(i), is_out(i), len(seq), sum(c > 0 for c in known), f.total, base, score))
    found = [(str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in scored.collect()]
    assert [x[:5] for x in sorted(found)] == [x[:5] for x in sorted(wanted)]
    for x, y in zip(sorted(found), sorted(wanted)):
        assert abs(x[5] - y[5]) < 1e-6 and abs(x[6] - y[6]) < 1e-6 * x[2] + 1e-9
    if order > 1:
        vocabulary = [w for (w,) in plain.counts[1]] + ["never seen"]
        for context in list(plain.after[order])[:40] + [("w1", "never")[: order - 1]]:
            assert abs(sum(plain.prob((*context, w), order) for w in vocabulary) - 1) < 1e-9


def test_empty_table_and_no_training_text(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    assert katz.train_and_score(docs.where("false"))[0].collect() == []
    rows = katz.train_and_score(docs.limit(5), is_held_out=lambda i: True)[0].collect()
    assert len(rows) == 5 and {(r.score, r.n_known, r.train_tokens) for r in rows} == {(0.0, 0, 0)}


def test_counts_and_totals_beyond_32_bits():
    keys, n = katz.np.array([5, 9], katz.np.uint64), 3 * 2**30
    part = lambda block, *columns: types.SimpleNamespace(block=block, bucket=0, keys=katz.pack_sorted(keys), **dict(zip("abc", columns)))
    counts = katz.pack(katz.np.array([n, 1], katz.np.uint32))
    rows = katz._sum_counts(1, [part("x", counts), part("y", counts)])
    answers = [{"kind": r[0], "order": r[1], "bucket": r[3], "a": r[6], "b": r[7]} for r in rows if r[2] == "x"]
    assert katz._answers({"answers": answers}, "counts", 1, "ab")[0].tolist() == [2 * n, 2]
    assert [katz.unpack(r[6], katz.np.uint64).tolist() for r in rows if r[0] == "grams"] == [[2 * n, 2]]
    masses = [katz.pack(katz.np.array(v, float)) for v in ([n, 1], [n - 9, 0.5], [0.5, 0.5])]
    rows = katz._sum_contexts(2, [part("x", *masses), part("y", *masses)])
    answers = [{"kind": r[0], "order": r[1], "bucket": r[3], "a": r[6], "b": r[7]} for r in rows if r[2] == "x"]
    assert katz._answers({"answers": answers}, "contexts", 2, "ab")[0].tolist() == [2 * n, 2]


def test_query_uses_the_default_order(monkeypatch):
    from ridgeline.llm import queries

    asked = []
    monkeypatch.setattr(queries, "table", lambda *_: None)
    monkeypatch.setattr(katz, "train_and_score", lambda docs, *, order=3, **_: (asked.append(order), None))
    queries.op1_lm_scores(None, "")
    assert asked == [3]


def test_numbers_and_keys_are_exact():
    np, rnd = katz.np, katz.np.random.default_rng(3)
    for width in (1, 2, 7, 8):
        assert sorted(katz.mixed(np.arange(1 << width, dtype=np.uint64), width).tolist()) == list(range(1 << width))
    for bits in (5, 40, 64):  # with and without room for positions beside the key
        keys = rnd.integers(0, 1 << min(bits, 6), 500, dtype=np.uint64) << np.uint64(max(0, bits - 6))
        first, of = katz.numbered(keys, bits)
        unique, at, inverse = np.unique(keys, return_index=True, return_inverse=True)
        assert first.tolist() == at.tolist() and of.tolist() == inverse.tolist() and keys[first].tolist() == unique.tolist()
    near = rnd.permutation(np.arange(500, dtype=np.uint64)) + (np.uint64(1) << np.uint64(63))  # differ in low bits only
    assert near[katz.ascending(near, 64)].tolist() == sorted(near.tolist())
    model = katz.Model(2, {}, [], {1: np.array([0, 2**40])})
    pairs = [model.keys(2, np.array([c], np.uint64), np.array([w], np.uint64))[0] for c in range(20) for w in range(20)]
    assert len(set(pairs)) == 400  # hashed, as 81 bits do not fit


def test_what_a_run_leaves_on_disk(spark, tmp_path, monkeypatch):
    """Two blocks of 40,000 tokens: a few bytes for each n-gram; answers are moved, old blocks deleted, shuffles dropped."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was, rnd, made = spark.conf.get(setting), random.Random(5), []
    rows = [(i, " ".join(f"w{int(rnd.paretovariate(0.6)) % 20_000}" for _ in range(1999)), "x") for i in range(40)]
    monkeypatch.setattr(katz, "new_path", lambda _, label: made.append(tmp_path / f"{label}-{len(made)}") or str(made[-1]))
    scored, model = katz.train_and_score(spark.createDataFrame(rows, SCHEMA).coalesce(1), block_tokens=40_000)
    assert scored.count() == 40 and spark.conf.get(setting) == was
    grams = [spark.read.parquet(str(p)).selectExpr("sum(length(keys)) / sum(size)").first()[0] for p in tmp_path.glob("*/kind=grams/order=3")]
    assert len(grams) == 1 and grams[0] < 4, grams  # bytes of a key; 64-bit hashes take six
    assert len([p for p in made if p.exists() and "blocks" in p.name]) == 1
    assert not list(tmp_path.glob("katz-model-*/kind=counts"))
    assert {p.name for p in tmp_path.glob("katz-model-*/kind=grams/order=*")} == {"order=1", "order=2", "order=3"}
    assert {p for p in map(str, made) if "model" in p} == set(model.paths)


def test_masses_take_few_bytes_and_come_back_exactly():
    np, rnd = katz.np, katz.np.random.default_rng(4)
    total = np.where(rnd.random(5000) < 0.5, 0, rnd.integers(1, 5, 5000)).astype(float)
    lower = np.where(total > 0, rnd.integers(1, 1 << 24, 5000) * katz.STEP, 0.0)
    for values, most in ((total, 0.5), (total * 0.6321, 0.5), (lower, 2.5), (np.zeros(0), 99), (np.ones(1), 99)):
        packed = katz.pack(values)
        assert np.array_equal(katz.unpack(packed, np.float64), values) and len(packed) <= most * max(1, len(values))


def test_weights_are_answered_only_where_asked_for():
    """The lowest bit of a key asks; totals are answered for all contexts, and the model has all weights."""
    np = katz.np
    masses = [katz.pack(np.array(v)) for v in ([4.0, 6.0, 8.0], [3.0, 5.0, 7.0], [0.25, 0.5, 0.75])]
    part = types.SimpleNamespace(block="x", bucket=0, keys=katz.pack_sorted(np.array([2, 5, 6], np.uint64)), **dict(zip("abc", masses)))
    answer, model = katz._sum_contexts(2, [part])
    assert katz.unpack(answer[6], np.uint64).tolist() == [4, 6, 8]
    assert katz.unpack(answer[7], np.float32).tolist() == [np.float32((1 - 5 / 6) / 0.5)]
    assert katz.unpack_sorted(model[5]).tolist() == [1, 2, 3] and len(katz.unpack(model[7], np.float32)) == 3


def test_blocks_are_not_written_again_for_each_order(spark, monkeypatch):
    """Answers join the blocks where both lie: two writes of blocks, and no shuffle of theirs in the last step."""
    written, table = [], katz._table
    monkeypatch.setattr(katz, "_table", lambda rows, label: written.append((label, "ids" in rows.columns)) or table(rows, label))
    docs = spark.createDataFrame(ROWS, SCHEMA)
    scored, _ = katz.train_and_score(docs, order=3, is_held_out=katz.crc32_held_out(7, 2), block_tokens=300, bucket_tokens=500)
    assert written == [("katz-blocks", True), ("katz-blocks", True), ("katz-answers", False), ("katz-answers", False)]
    assert scored.count() == len(ROWS)
