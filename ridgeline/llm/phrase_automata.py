"""Collocations by weighted acyclic automata over words.

Texts are lower-cased (A-Z), cut into pieces at ``. , ; : ! ?`` and line breaks, and pieces into words
at blanks and tabs, once: shards of words by number are kept until all n-grams are counted.  Everything is counted per
language; a null language is ``und``.

* A task builds *count transducers* from the sorted n-grams of a shard of tokens: one for each *prefix
  range*, whose paths are n-grams and whose last arcs carry counts.  States are closed in
  sorted order and equal ones are stored once.  A range holds first words by their hash; a frequent first word is spread
  over several ranges by the words that follow.  Ranges follow the number of tokens, and each row holds an n-gram at least.
* Transducers of one range meet in a task, which sums weights and keeps paths of at least ``least`` occurrences.
* Parts of a phrase are looked up by *composing* them with the transducer of their prefix range.

An n-gram can only reach ``least`` if its parts do.  Bit tables of the frequent words and pairs, of at most
``common.BITS`` bits, keep hopeless n-grams out of the shuffle.  They let a few through that the union drops; what
they keep out cannot be a candidate, so counts are exact at every size.  Tables of more keys than bits let more through.

Scores are exact integers of any size.  Null and empty texts have no words.  Repeated rows count as
often as they occur; ids are not used.  Ties are broken by count and by the bytes of the phrase.  Very long
texts are one list of words in memory at a time.  An empty table gives no rows.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.llm.common import BitTable, utf8
from ridgeline.llm.katz import pack, unpack
from ridgeline.staging import discard, new_path, stage, stage_at

_BREAK = 255  # no byte of UTF-8
_FOLDED = bytes(_BREAK if chr(c) in ".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in bytes(range(256)).lower())
#: Tokens of a shard, tokens whose n-grams make a prefix range, and the number of words that may be cut into several ranges.
SHARD, RANGE, HEAVY = 1 << 21, 1 << 18, 1 << 16
_AUTOMATON = "lang string, part bigint, words array<binary>, values array<binary>"


def tokens(text: bytes) -> list[bytes]:
    """Words, and the break byte between pieces."""
    return text.translate(_FOLDED).replace(b"\xff", b" \xff ").split()


class Builder:
    """Acyclic transducer of word sequences of one length, from runs in sorted order.

    A state is its labels, joined by line breaks, and its 64-bit values: counts in a last state,
    numbers of states in others.  The state after which nothing can follow is closed and looked up among
    its equals; the root comes last.
    """

    def __init__(self, depth: int) -> None:
        self.register: dict[tuple[bytes, bytes], int] = {}
        self.open: list[tuple[list[bytes], list[int]]] = [([], []) for _ in range(depth - 1)]
        self.path: tuple[bytes, ...] = ()

    def add(self, prefix: tuple[bytes, ...], labels: list[bytes], counts: bytes) -> None:
        """All words after ``prefix`` in order, with their counts as 64-bit integers; prefixes come in order, too."""
        same = 0
        while same < len(prefix) and self.path[same : same + 1] == prefix[same : same + 1]:
            same += 1
        self._close(same)
        for level in range(same, len(prefix)):
            self.open[level][0].append(prefix[level])
        self.path = prefix
        number = self.register.setdefault((b"\n".join(labels), counts), len(self.register))
        if prefix:
            self.open[-1][1].append(number)

    def _close(self, level: int) -> None:
        """States below ``level`` get no more arcs."""
        for at in range(len(self.path) - 1, level, -1):
            labels, targets = self.open[at]
            state = (b"\n".join(labels), array("q", targets).tobytes())
            self.open[at - 1][1].append(self.register.setdefault(state, len(self.register)))
            self.open[at] = ([], [])

    def finish(self) -> tuple[list[bytes], list[bytes]]:
        self._close(0)
        words, values = [s[0] for s in self.register], [s[1] for s in self.register]
        if self.open:
            labels, targets = self.open[0]
            words.append(b"\n".join(labels))
            values.append(array("q", targets).tobytes())
        return words, values


def add_paths(total: dict, words: list[bytes], values: list[bytes], depth: int, at: int = -1) -> None:
    """Add the counts of all paths from a state to nested dictionaries of words."""
    arcs = zip(words[at].split(b"\n"), memoryview(values[at]).cast("q").tolist())
    if depth == 1:
        held = total.get
        for label, count in arcs:
            total[label] = held(label, 0) + count
    else:
        for label, target in arcs:
            below = total.get(label)
            if below is None:
                below = total[label] = {}
            add_paths(below, words, values, depth - 1, target)


def paths(words: list[bytes], values: list[bytes], depth: int, at: int = -1) -> Iterator[tuple[bytes, int]]:
    """Every path from a state, words joined by a blank, with its count."""
    for label, target in zip(words[at].split(b"\n"), memoryview(values[at]).cast("q").tolist()):
        if depth == 1:
            yield label, target
        else:
            for rest, count in paths(words, values, depth - 1, target):
                yield label + b" " + rest, count


def transducer(total: dict, depth: int, least: int) -> tuple[list[bytes], list[bytes]] | None:
    """Transducer of the paths with at least ``least`` occurrences in nested dictionaries; None if there are none."""
    build, some = Builder(depth), False

    def walk(below: dict, prefix: tuple[bytes, ...]) -> None:
        nonlocal some
        if len(prefix) == depth - 1:
            kept = sorted((w, c) for w, c in below.items() if c >= least)
            if kept:
                some = True
                build.add(prefix, [w for w, _ in kept], array("q", [c for _, c in kept]).tobytes())
            return
        for word in sorted(below):
            walk(below[word], (*prefix, word))

    walk(total, ())
    return build.finish() if some else None


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


_SHARD = "lang string, words binary, ids binary"


def _shards(docs: DataFrame) -> DataFrame:
    """Texts cut into words, once for all passes: a row for each language of a shard with its words by number (0 is the break)
    and the numbers of its tokens."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[_Numbers, list[np.ndarray]]] = {}
        size = 0

        def full() -> Iterator[pa.RecordBatch]:
            for lang, (numbers, parts) in held.items():
                ids = pack(np.concatenate([np.zeros(1, np.int32), *parts]))
                words = zstandard.ZstdCompressor(level=1).compress(b"\n".join(numbers))
                yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array([words], pa.binary()), pa.array([ids], pa.binary())], ["lang", "words", "ids"])
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                if lang not in held:
                    held[lang] = (_Numbers({b"\xff": 0}), [])
                numbers, parts = held[lang]
                found = tokens(text.as_py())
                parts.append(np.fromiter(map(numbers.__getitem__, found), np.int32, len(found)))
                parts.append(np.zeros(1, np.int32))
                size += len(found) + 1
                if size >= SHARD:
                    yield from full()
                    size = 0
        yield from full()

    return _texts(docs).mapInArrow(task, _SHARD)


def _read_shards(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes], np.ndarray]]:
    """Language, words by number and the numbers of the tokens of a shard."""
    for batch in batches:
        for lang, words, ids in zip(*(batch.column(c) for c in ("lang", "words", "ids"))):
            # no word holds a line break
            yield lang.as_py(), zstandard.ZstdDecompressor().decompress(words.as_py()).split(b"\n"), unpack(ids.as_py(), np.int32).astype(np.int64)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), utf8(F.col("text")).alias("text"))


def _word_counts(shards: DataFrame) -> DataFrame:
    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words, ids in _read_shards(batches):
            count = np.bincount(ids, minlength=len(words))[1:]
            columns = [pa.array([lang] * len(count), pa.string()), pa.array(words[1:], pa.binary()).cast(pa.string()), pa.array(count, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "word", "f"])

    rows = shards.mapInArrow(task, "lang string, word string, f bigint")
    return rows.groupBy("lang", "word").agg(F.sum("f").alias("f"))


def _hashes(words: Iterable[bytes], seed: int) -> np.ndarray:
    """What ``xxhash64`` gives in Spark for a language and each word, when ``seed`` is the hash of the language."""
    digest = xxhash.xxh64_intdigest
    return np.array([digest(w, seed) for w in words], np.uint64)


def _pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    total = first * np.uint64(0x9E3779B97F4A7C15) + second
    return (total ^ (total >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def _start(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode(), 42)


def _counted(columns: list[np.ndarray], n: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct n-grams of word numbers below ``n`` in order, and how often each occurs."""
    bits = max(1, n).bit_length()
    head, used = columns[0], bits
    steps = []  # where the numbers would not fit in 64 bits, prefixes are numbered first
    for c in columns[1:]:
        if used + bits > 62:
            prefix, head = np.unique(head, return_inverse=True)
            steps.append(prefix)
            used = len(prefix).bit_length()
        head, used = (head << bits) | c, used + bits
    key, count = np.unique(head, return_counts=True)
    found, mask = [], (1 << bits) - 1
    while len(found) < len(columns) - 1:
        found.append(key & mask)
        key = key >> bits
        if steps and len(found) == len(columns) - 2:
            key = steps.pop()[key]
    return [key, *reversed(found)], count


def _automata(lang: str, order: list[bytes], columns: list[np.ndarray], part: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
    """A row for each prefix range of sorted n-grams."""
    new = np.diff(part, prepend=-1) != 0
    run = new.copy()
    for c in columns[:-1]:
        run |= np.diff(c, prepend=-1) != 0
    starts = np.flatnonzero(run)
    tails, stops, fresh = [order[t] for t in columns[-1].tolist()], [*starts[1:].tolist(), len(count)], new[starts].tolist()
    prefixes = zip(*([order[i] for i in c[starts].tolist()] for c in columns[:-1]))
    builds: list[Builder] = []
    packed = np.ascontiguousarray(count, np.int64).tobytes()
    for a, b, prefix, first in zip(starts.tolist(), stops, prefixes, fresh):
        if first:
            builds.append(Builder(len(columns)))
        builds[-1].add(prefix, tails[a:b], packed[8 * a : 8 * b])
    found = [b.finish() for b in builds]
    blobs = pa.list_(pa.binary())
    arrays = [pa.array([lang] * len(found), pa.string()), pa.array(part[new], pa.int64()), pa.array([f[0] for f in found], blobs), pa.array([f[1] for f in found], blobs)]
    return pa.RecordBatch.from_arrays(arrays, ["lang", "part", "words", "values"])


class _Ranges:
    """Which prefix range an n-gram falls in: one for each first word, several for a frequent one."""

    def __init__(self, n: int, shares: dict[tuple[str, str], int]) -> None:
        self.n, self.shares = n, shares

    def share(self, lang: str, word: bytes) -> int:
        return self.shares.get((lang, word.decode()), 1) if self.shares else 1

    def of(self, lang: str, head: bytes, spread: int) -> int:
        home = xxhash.xxh64_intdigest(head, _start(lang)) >> 2
        return (home % self.n + spread % self.share(lang, head)) % self.n


def _gram_rows(shards: DataFrame, size: int, known: BitTable, pairs: BitTable | None, ranges: _Ranges) -> DataFrame:
    """Transducers of each shard's n-grams of ``size`` words, cut into prefix ranges."""

    def grams(lang: str, words: list[bytes], ids: np.ndarray) -> tuple[list[bytes], np.ndarray, list[np.ndarray], np.ndarray]:
        """Frequent words in order and their hashes; the sorted n-grams as columns of word numbers, and counts."""
        hashes = _hashes(words, _start(lang))
        keep = known.holds(hashes)
        keep[0] = False
        kept = sorted(np.flatnonzero(keep).tolist(), key=words.__getitem__)
        rank = np.full(len(words), -1, np.int64)
        rank[kept] = np.arange(len(kept))
        order, hashes, ids = [words[i] for i in kept], hashes[kept], rank[ids]
        at = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
        if size == 2:
            return order, hashes, *_counted([ids[at], ids[at + 1]], len(order))
        at = at[pairs.holds(_pair_hashes(hashes[ids[at]], hashes[ids[at + 1]]))]
        at = at[np.flatnonzero(np.diff(at) == 1)]  # both pairs of the triple
        return order, hashes, *_counted([ids[at], ids[at + 1], ids[at + 2]], len(order))

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words, ids in _read_shards(batches):
            order, hashes, columns, count = grams(lang, words, ids)
            share = np.array([ranges.share(lang, w) for w in order], np.uint64)
            home = (hashes >> np.uint64(2)) % np.uint64(ranges.n)
            spread = hashes[columns[1]] if size == 2 else hashes[columns[1]] * np.uint64(31) + hashes[columns[2]]
            part = ((home[columns[0]] + spread % share[columns[0]]) % np.uint64(ranges.n)).astype(np.int64)
            moved = np.argsort(part.astype(np.uint16) if ranges.n <= 1 << 16 else part, kind="stable")
            columns, part, count = [c[moved] for c in columns], part[moved], count[moved]
            starts = np.flatnonzero(np.diff(part, prepend=-1))
            block = starts[np.flatnonzero(np.diff(starts // 50_000, prepend=-1))].tolist()  # whole ranges, few in memory as rows
            for a, b in zip(block, [*block[1:], len(part)]):
                yield _automata(lang, order, [c[a:b] for c in columns], part[a:b], count[a:b])

    return shards.mapInArrow(task, _AUTOMATON)


def _union(rows: DataFrame, depth: int, least: int) -> DataFrame:
    """One transducer for each prefix range: weights summed, paths below ``least`` dropped."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, {}

        def closed() -> Iterator[pa.RecordBatch]:
            found = transducer(total, depth, least)
            if found is not None:
                blobs = pa.list_(pa.binary())
                arrays = [pa.array([key[0]], pa.string()), pa.array([key[1]], pa.int64()), pa.array([found[0]], blobs), pa.array([found[1]], blobs)]
                yield pa.RecordBatch.from_arrays(arrays, ["lang", "part", "words", "values"])

        for batch in batches:
            for lang, part, words, values in zip(*(batch.column(c) for c in ("lang", "part", "words", "values"))):
                if (lang.as_py(), part.as_py()) != key:
                    yield from closed()
                    key, total = (lang.as_py(), part.as_py()), {}
                add_paths(total, words.as_py(), values.as_py(), depth)
        yield from closed()

    return rows.repartition("lang", "part").sortWithinPartitions("lang", "part").mapInArrow(task, _AUTOMATON)


def _flat(automata: DataFrame, depth: int) -> DataFrame:
    """``lang, phrase, a`` of every path, and ``h``, the hash of its first two words."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, words, values in zip(*(batch.column(c) for c in ("lang", "words", "values"))):
                found = list(paths(words.as_py(), values.as_py(), depth))
                phrases = pa.array([p for p, _ in found], pa.binary()).cast(pa.string())
                ends = list(zip(*(p.split(b" ", 2)[:2] for p, _ in found)))
                pair = _pair_hashes(*(_hashes(e, _start(lang.as_py())) for e in ends))
                columns = [pa.array([lang.as_py()] * len(found), pa.string()), phrases, pa.array([c for _, c in found], pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(pair.view(np.int64))], ["lang", "phrase", "a", "h"])

    return automata.select("lang", "words", "values").mapInArrow(task, "lang string, phrase string, a bigint, h bigint")


def _queries(flat: DataFrame, ranges: _Ranges) -> DataFrame:
    """The parts of each phrase in the ranges that know them: ``head`` and ``next`` word, ``side`` names the part."""
    names = ["lang", "part", "head", "next", "phrase", "a", "side"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for lang, phrase, a in zip(*(c.to_pylist() for c in batch.columns)):
                words = phrase.split(" ")
                for cut in range(1, len(words)):
                    for side, piece in ((f"l{cut}", words[:cut]), (f"r{cut}", words[cut:])):
                        # all ranges of a word know its count; a pair is known in the one of its second word
                        spread = xxhash.xxh64_intdigest(piece[1].encode(), _start(lang)) if len(piece) > 1 else xxhash.xxh64_intdigest(phrase.encode())
                        part = ranges.of(lang, piece[0].encode(), spread)
                        rows.append((lang, part, piece[0], piece[1] if len(piece) > 1 else None, phrase, a, side))
            columns = zip(*rows) if rows else ([] for _ in names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)

    return flat.select("lang", "phrase", "a").mapInArrow(task, "lang string, part bigint, head string, next string, phrase string, a bigint, side string")


_QUERY = ["lang", "part", "kind", "head", "f", "words", "values", "next", "phrase", "a", "side"]


def _composed(queries: DataFrame, words: DataFrame, pairs: DataFrame, heavy: DataFrame, n: int) -> DataFrame:
    """``lang, phrase, a, side, f``: the count of every part, from the words and the transducer of its range."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, single, arcs = None, {}, {}
        for batch in batches:
            rows = []
            for lang, part, kind, head, f, labels, values, follow, phrase, a, side in zip(*(c.to_pylist() for c in batch.columns)):
                if (lang, part) != key:
                    key, single, arcs = (lang, part), {}, {}
                if kind == 0:
                    single[head] = f
                elif kind == 1:
                    add_paths(arcs, labels, values, 2)
                else:
                    rows.append((lang, phrase, a, side, single[head] if follow is None else arcs[head.encode()][follow.encode()]))
            columns = list(zip(*rows)) if rows else [[]] * 5
            kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["lang", "phrase", "a", "side", "f"])

    spread = words.join(F.broadcast(heavy), ["lang", "word"], "left")  # fewer than HEAVY rows
    spread = spread.withColumn("i", F.explode(F.sequence(F.lit(0), F.coalesce("shares", F.lit(1)) - 1)))
    part = F.expr(f"(shiftrightunsigned(xxhash64(lang, word), 2) % {n}L + i) % {n}L")
    blobs = F.lit(None).cast("array<binary>")
    empty = {"head": "string", "f": "bigint", "next": "string", "phrase": "string", "a": "bigint", "side": "string"}
    empty = {c: F.lit(None).cast(k) for c, k in empty.items()} | {"words": blobs, "values": blobs}

    def shaped(rows: DataFrame, kind: int) -> DataFrame:
        rows = rows.withColumns({c: v for c, v in empty.items() if c not in rows.columns})
        return rows.withColumn("kind", F.lit(kind)).select(_QUERY)

    rows = shaped(spread.select("lang", part.alias("part"), F.col("word").alias("head"), "f"), 0)
    rows = rows.unionByName(shaped(pairs, 1)).unionByName(shaped(queries, 2))
    rows = rows.repartition("lang", "part").sortWithinPartitions("lang", "part", "kind")
    return rows.mapInArrow(task, "lang string, phrase string, a bigint, side string, f bigint")


def _scored(parts: DataFrame) -> DataFrame:
    """``lang, phrase, a, l, r, score`` of the lowest-scoring cut, in integers of any size."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                min((1_000_000 * a * a // (x * y), cut, x, y) for cut, (x, y) in enumerate(((l1, r1), (l2, r2)), 1) if x is not None)
                for a, l1, r1, l2, r2 in zip(*(batch.column(c).to_pylist() for c in ("a", "l1", "r1", "l2", "r2")))
            ]
            figures = [pa.array([f[i] for f in found], pa.int64()) for i in (2, 3, 0)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("lang", "phrase", "a")] + figures, ["lang", "phrase", "a", "l", "r", "score"])

    sides = [F.max(F.when(F.col("side") == s, F.col("f"))).alias(s) for s in ("l1", "r1", "l2", "r2")]
    return parts.groupBy("lang", "phrase", "a").agg(*sides).mapInArrow(task, "lang string, phrase string, a bigint, l bigint, r bigint, score bigint")


def collocations(docs: DataFrame, *, least: int = 10, share: int = 50, top: int = 2000) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the best phrases of two and three words of each language."""
    spark, path = docs.sparkSession, new_path(docs.sparkSession, "phrase-shards")
    shards = stage_at(_shards(docs), path)
    counts = stage(_word_counts(shards), "phrase-words")
    totals = counts.groupBy("lang").agg(F.sum("f").alias("n"))
    words = counts.where(F.col("f") >= least)
    whole = counts.agg(F.coalesce(F.sum("f"), F.lit(0)).alias("n")).first().n
    limit = max(RANGE, whole // HEAVY)
    heavy = words.where(F.col("f") > limit).select("lang", "word", F.ceil(F.col("f") / limit).cast("int").alias("shares"))
    heavy = stage(heavy, "phrase-heavy")
    # fewer than HEAVY words can be that frequent
    ranges = _Ranges(max(1, whole // RANGE), {(r.lang, r.word): r.shares for r in heavy.collect()})
    known = BitTable(words.select(F.xxhash64("lang", "word").alias("h")))
    pairs = stage(_union(_gram_rows(shards, 2, known, None, ranges), 2, least), "phrase-pairs")
    two = stage(_flat(pairs, 2), "phrase-two")
    both = F.split("phrase", " ")
    frequent = BitTable(two.select("h"))
    three = stage(_flat(_union(_gram_rows(shards, 3, known, frequent, ranges), 3, least), 3), "phrase-three")
    discard(spark, path)

    scored = _scored(_composed(_queries(two.unionByName(three), ranges), words, pairs, heavy, ranges.n))
    ends = F.array(F.concat_ws(" ", both[0], both[1]), F.concat_ws(" ", both[1], both[2]))
    inside = three.select("lang", F.explode(ends).alias("phrase"), F.col("a").alias("longer"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    left = scored.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = left.drop("longer").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, 1 AS size, unnest(w) AS phrase FROM lists
  UNION ALL
  SELECT lang, 2, unnest([w[i] || ' ' || w[i + 1] FOR i IN generate_series(1, len(w) - 1)]) FROM lists
  UNION ALL
  SELECT lang, 3, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN generate_series(1, len(w) - 2)]) FROM lists),
f AS (SELECT lang, size, phrase, count(*)::BIGINT AS a FROM grams GROUP BY lang, size, phrase),
totals AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
candidates AS (SELECT lang, size, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND a >= 10),
cuts AS (
  SELECT lang, phrase, a, 1 AS k, w[1] AS first, array_to_string(w[2:], ' ') AS rest FROM candidates
  UNION ALL
  SELECT lang, phrase, a, 2, w[1] || ' ' || w[2], w[3] FROM candidates WHERE size = 3),
valued AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.a AS l, y.a AS r, ((1000000 * c.a::HUGEINT * c.a) // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.first JOIN f y ON y.lang = c.lang AND y.phrase = c.rest),
lowest AS (SELECT * FROM valued QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, part, max(a) AS longer
  FROM (SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS part FROM candidates WHERE size = 3) GROUP BY lang, part),
ranked AS (
  SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, s.a DESC, phrase) AS rank
  FROM lowest s LEFT JOIN inside i ON i.lang = s.lang AND i.part = s.phrase WHERE i.longer IS NULL OR 100 * i.longer < 50 * s.a)
SELECT lang, rank::BIGINT AS rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
