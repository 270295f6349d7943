"""Operators on whole documents against brute force, with nulls, ties, repeats and clashing columns."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
import zlib
from tokenizers import Tokenizer

from ridgeline.llm import bk_simhash, common, fuse_dedup, mixing, pieces, shard_tree, token_counts, zstd_quality

RANDOM = random.Random(11)
VOCABULARY = ["the", "of", "Zürich", "naïve", "🦙", "x1", "a", "B-2", "<|endoftext|>", "▁", "漢字", "it's", "\x85", "x" * 50]


def prose(n):
    return "".join(RANDOM.choice(VOCABULARY) + RANDOM.choice([" ", " ", " ", "\n", "  ", "\t", ""]) for _ in range(n))


LONG = prose(9000)
TEXTS = [None, "", " ", "Same text here", "same TEXT here", "same text here ", "Ä", "ä", "one", "one two", LONG, LONG, LONG.replace("x1", "x2", 1), *[prose(RANDOM.randrange(80)) for _ in range(60)]]
ROWS = [(i if i % 13 else None if i == 13 else i, t, ["b", "a", None, "a", "a"][i % 5], 1, "x") for i, t in enumerate(TEXTS)] + [(3, "Same text here", "a", 1, "x")] * 2
SCHEMA = "doc_id bigint, text string, source string, n_tokens int, digest string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def test_pieces_equal_library(docs, none):
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    wanted = []
    for i, t, *_ in ROWS:
        ids = model.encode(t or "", add_bos=True, add_eos=True)
        wanted.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(model.decode(ids).encode()).hexdigest()))
    assert Counter(map(tuple, pieces.digests(docs, path, remember=10).collect())) == Counter(wanted)
    assert pieces.digests(none, path).collect() == []


def test_token_counts_equal_library(docs, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    wanted = Counter((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in ROWS)
    assert Counter(map(tuple, token_counts.count_tokens(docs, path, chunk=700, overlap=40, remember=50).collect())) == wanted
    assert token_counts.count_tokens(none, path).collect() == []


def test_splicing_widens_where_nothing_aligns(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = ["x" * 1000 + " y", "ab " * 300, " " * 900 + "z", "<|endoftext|>" * 90, "a<|endoftext|" * 80, "'s" * 500, "\n \n" * 333 + "q"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(rows, path, chunk=64, overlap=20).collect()}
    assert found == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_dedup_equals_grouping(docs, none):
    groups = defaultdict(list)
    for i, t, *_ in ROWS:
        groups[(t or "").encode().lower()].append(i)
    rows = fuse_dedup.deduplicate(docs).collect()
    assert len(rows) == len(ROWS)
    seen = defaultdict(list)
    for r in rows:
        seen[r.text_sha256].append(r)
    assert len(seen) == len(groups)
    for text, ids in groups.items():
        own = seen[hashlib.sha256(text).hexdigest()]
        keep = max((i for i in ids if i is not None), default=None)
        assert Counter(r.doc_id for r in own) == Counter(ids) and {(r.keep_id, r.group_size) for r in own} == {(keep, len(ids))}
        assert [r.doc_id for r in own if r.kept] == [keep]
    kept = fuse_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.text or "").lower() for r in kept.collect()) == sorted(t.decode().lower() for t in groups)
    assert fuse_dedup.deduplicate(none).collect() == [] and fuse_dedup.keep_one(none).collect() == []


def test_fuse_filter_has_no_false_negative():
    draw = np.random.default_rng(3)
    for n in (1, 2, 7, 100, 5000):
        keys = draw.integers(0, 2**63, n).astype(np.uint64)
        built = fuse_dedup.FuseFilter.build(keys)
        assert built.contains(keys).all()
        assert built.contains(draw.integers(0, 2**63, 50_000).astype(np.uint64)).mean() < 0.001


def fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_classes_equal_brute_force(docs, none):
    prints = [fingerprint(t) for _, t, *_ in ROWS]
    root = list(range(len(ROWS)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ROWS)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                root[max(find(i), find(j))] = min(find(i), find(j))
    lowest = defaultdict(list)
    for i, row in enumerate(ROWS):
        lowest[find(i)].append(row[0])
    wanted = Counter((r[0], f"{prints[i]:016x}", min((x for x in lowest[find(i)] if x is not None), default=None)) for i, r in enumerate(ROWS))
    assert Counter(map(tuple, bk_simhash.near_duplicates(docs, limit=3).collect())) == wanted
    kept = bk_simhash.keep_one(docs)
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect()) == Counter({c for _, _, c in wanted})
    assert bk_simhash.near_duplicates(none).collect() == [] and bk_simhash.keep_one(none).collect() == []


def test_shards_of_links_lose_no_link(spark):
    base = [RANDOM.getrandbits(64) for _ in range(40)]
    values = {b ^ sum(1 << k for k in RANDOM.sample(range(64), RANDOM.randrange(7))) for b in base for _ in range(12)}
    signed = spark.createDataFrame([(bk_simhash._signed(v),) for v in values], "fp bigint")
    found = [(r.a & 2**64 - 1, r.b & 2**64 - 1) for r in bk_simhash.link_shards(signed, limit=2).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in found)

    def classes(links):
        root = {v: v for v in values}

        def find(v):
            while root[v] != v:
                v = root[v]
            return v

        for a, b in links:
            root[max(find(a), find(b))] = min(find(a), find(b))
        return {v: find(v) for v in values}

    assert classes(found) == classes([(a, b) for a in values for b in values if (a ^ b).bit_count() <= 4])


def test_sharding_law_and_slots(docs, none):
    leaves = shard_tree.tree(8)
    rows = shard_tree.shard(docs, leaves).collect()
    assert len(rows) == len(ROWS)
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 8)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and set(by) <= set(range(8))
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in ROWS)
    assert shard_tree.shard(none, leaves).collect() == []


def test_shard_weights_are_met_and_moves_stay_in_the_grown_subtree(spark):
    leaves = [shard_tree.Leaf(0, "r", "a", 1.0), shard_tree.Leaf(1, "r", "b", 3.0), shard_tree.Leaf(2, "s", "c", 4.0)]
    more = [shard_tree.Leaf(0, "r", "a", 1.0), shard_tree.Leaf(1, "r", "b", 6.0), shard_tree.Leaf(2, "s", "c", 4.0)]
    keys = spark.range(20_000).selectExpr("cast(id as string) k")
    rows = keys.select(shard_tree.place(keys["k"], leaves).alias("a"), shard_tree.place(keys["k"], more).alias("b")).collect()
    share = Counter(r.a for r in rows)
    assert [round(share[s] / 2500) for s in range(3)] == [1, 3, 4]
    assert {(r.a, r.b) for r in rows if r.a != r.b} <= {(0, 1), (2, 1), (2, 0)}


def test_mix_meets_targets(docs, none):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(ROWS) and sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs.repartition(3)).collect()))
    source, taken, size = {}, defaultdict(int), defaultdict(int)
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
        source[r.target, r.source_size] = 1
        taken[r.target, r.source_size] += r.taken
        size[r.target, r.source_size] += r.size
    total = sum(r.size for r in rows)
    assert abs(sum(t for t, _ in source) - total) < 1e-6
    largest = max(r.size for r in rows)
    for (target, whole), got in taken.items():
        assert size[target, whole] == whole and target <= 3 * whole + 1e-9 and abs(got - target) <= largest
    repeated = mixing.mixed_rows(docs)
    assert repeated.columns == docs.columns and repeated.count() >= sum(r.taken // r.size for r in rows if r.size)
    assert mixing.mix(none).collect() == [] and mixing.mixed_rows(none).collect() == []


def test_classifier_on_held_out_rows(spark):
    good = [" ".join(RANDOM.choice(["river", "stone", "walks", "under", "quiet", "light", "every", "morning"]) + RANDOM.choice(["", "s", ","]) for _ in range(60)) for _ in range(120)]
    bad = [" ".join(RANDOM.choice(["BUY", "NOW", "CLICK", "WIN", "$$$", "FREE"]) + "!!" for _ in range(60)) for _ in range(120)]
    rows = [(i, t, int(i < 120)) for i, t in enumerate(good + bad)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, quality int")
    model = zstd_quality.fit(table.select("doc_id", "text"), table.where("doc_id % 4 <> 2").select("doc_id", "quality"))
    found = {r.doc_id: r.score for r in zstd_quality.score(table, model).collect()}
    held = [(y, found[i]) for i, _, y in rows if i % 4 == 2]
    assert sum((s >= 0.5) == bool(y) for y, s in held) >= 0.95 * len(held)
    odd = spark.createDataFrame([(None, None, 0), (1, "", 0), (1, "x" * 300_000, 0)], "doc_id bigint, text string, score int")
    assert all(0 <= r.score <= 1 for r in zstd_quality.score(odd, model).collect())
    nothing = zstd_quality.fit(table.select("doc_id", "text"), table.where("false").select("doc_id", "quality"))
    assert {r.score for r in zstd_quality.score(odd, nothing).collect()} == {0.5}


def test_held_out_is_crc32(spark):
    rows = spark.range(50)
    found = [r.h for r in rows.select(common.held_out(rows["id"], 7, 2).alias("h")).collect()]
    assert found == [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(50)]


def test_plain_characters_split_as_in_the_library():
    """The claim behind ``PLAIN``: both engines put all its characters into the same classes."""
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for code in range(0xD800):
        char = chr(code)
        if token_counts.PLAIN.fullmatch(char):
            text = f"a{char}b1{char}2 {char} x!{char}?"
            assert token_counts.WORDS.findall(text) == [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)], hex(code)
