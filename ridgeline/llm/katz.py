"""Katz backoff language model over all training text, evaluated on all text.

Words are 64-bit keys (XXH64).  Texts are read once into blocks of about a million tokens with their own
dictionaries.  For every order a block sends its distinct n-grams with their training counts, sorted and packed, to buckets
of the key space; a bucket adds the counts up, keeps its part of the model, numbers its n-grams, and answers
each block in the order it asked.  So what is shuffled is distinct n-grams of blocks, never words or
single occurrences; keys are spread evenly, so the most frequent word burdens no bucket.

An n-gram's key is the number of its context, the (n-1)-gram before, beside the number of its last word, shuffled
by a bijection; a text starts in a fixed context and closes with an end token.  Numbers are dense, so sorted keys differ
by few bits and a context is named by a few bits, too: two or three bytes where a hash takes six.  The answers
of an order become one row for each block, bucketed like the blocks, and what they were read from is deleted.

* Good-Turing: with ``N_c`` n-grams of count ``c``, counts up to ``K`` are discounted the usual way;
  where the counts of counts allow none, absolute discounting stands in.
* Backoff weights: for each context the discounted mass and the lower-order probabilities of its seen words
  are added up over their owners (the first block that has the n-gram), in a second exchange
  keyed by context.  A block is answered the totals of all its contexts, but the weights only of those after
  which it has an unseen n-gram: nothing else is multiplied by them.  Contexts that one block alone has only go into the model: the block has all their n-grams.  ``alpha = (1 - mass) / (1 - lower mass)`` makes every context sum to one,
  with all unknown words as one event.  A context whose counts leave no mass gets one more in its total.
* Evaluation per token: seen n-gram, else weight of the context times the next lower order,
  down to unigrams and the unknown word.

The model is left in the shared folder, partitioned by kind and order: packed n-gram keys and counts, and
contexts with their totals and weights (single precision), named by 0 for the start of a text and else by 1 plus the number
of the n-gram.  Two different words with one 64-bit key would be counted as one; among a billion words the expected number
of such pairs is 0.03.  Longer n-grams are exact as long as the numbers of a context and a word fit in 64 bits; beyond
that they are hashed to 64 bits like words.

Null and blank texts are the end token alone.  Repeated rows count as often as they occur.  Without
training text every word is unknown and an unknown word has probability one.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm.common import texts
from ridgeline.staging import discard, new_path

#: Highest count that is discounted.
K = 5
END = 0x51ED270B9F652295  # key of the end token; texts' words have XXH64 keys
#: Masses of contexts are sent in steps of this size; answers have 6e-8 of a weight.
STEP = 2.0**-32
_DOUBLES = "<?QQ"  # whether values are listed, how many there are, bytes of their places


def pack(values: np.ndarray) -> bytes:
    """Compressed by planes: first all lowest bytes, then all second bytes, and so on."""
    if values.dtype == np.float64:
        return _pack_doubles(values)
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T if len(values) else np.zeros(0, np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(blob: bytes, kind) -> np.ndarray:
    if np.dtype(kind) == np.float64:
        return _unpack_doubles(blob)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(kind).ravel() if len(raw) else np.zeros(0, kind)


def _pack_doubles(values: np.ndarray) -> bytes:
    """Masses: few distinct ones by their places in a list, else those that are not zero, and where they are."""
    listed, of = np.unique(values, return_inverse=True)
    few = 8 * len(listed) <= len(values)
    some = values != 0
    marks = pack(of.astype(np.uint32) if few else np.packbits(some))
    return struct.pack(_DOUBLES, few, len(values), len(marks)) + marks + pack((listed if few else values[some]).view(np.uint64))


def _unpack_doubles(blob: bytes) -> np.ndarray:
    few, size, cut = struct.unpack_from(_DOUBLES, blob)
    rest = blob[struct.calcsize(_DOUBLES) :]
    marks, kept = rest[:cut], unpack(rest[cut:], np.uint64).view(np.float64)
    if few:
        return kept[unpack(marks, np.uint32)]
    values = np.zeros(size)
    values[np.unpackbits(unpack(marks, np.uint8), count=size).astype(bool)] = kept
    return values


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob, np.uint64), dtype=np.uint64)


def gram_keys(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Keys of n-grams; order matters, and all bits of both keys enter."""
    h = context * np.uint64(0x9E3779B97F4A7C15) + word
    for shift in (32, 29):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def mixed(keys: np.ndarray, width: int) -> np.ndarray:
    """A bijection on numbers of ``width`` bits that spreads them evenly."""
    mask, half = np.uint64((1 << width) - 1), np.uint64((width + 1) // 2)
    for factor in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9):
        keys = (keys * np.uint64(factor)) & mask
        keys = keys ^ (keys >> half)
    return keys


def numbered(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """First position of each distinct key of ``bits`` bits, ascending by key, and the number of the key at each position."""
    width = len(keys).bit_length()
    if bits + width <= 64:  # a plain sort, with the position below the key, is several times faster
        both = keys << np.uint64(width)
        both |= np.arange(len(keys), dtype=np.uint64)
        both.sort()
        position, keys = (both & np.uint64((1 << width) - 1)).astype(np.int64), both >> np.uint64(width)
    else:
        position = np.argsort(keys, kind="stable")
        keys = keys[position]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    of = np.empty(len(keys), np.int32 if width < 32 else np.int64)
    of[position] = np.cumsum(new, dtype=of.dtype) - 1
    return position[new], of


def ascending(keys: np.ndarray, bits: int) -> np.ndarray:
    """The order of keys of ``bits`` bits; equal keys in any fixed order."""
    width = len(keys).bit_length()
    spare = np.uint64(max(0, bits + width - 64))  # low bits that find no room beside the position
    both = keys >> spare
    both <<= np.uint64(width)
    both |= np.arange(len(keys), dtype=np.uint64)
    both.sort()
    order = (both & np.uint64((1 << width) - 1)).astype(np.int64)
    if spare:
        found = keys[order]
        if (found[1:] < found[:-1]).any():  # keys that differ in these bits alone
            return np.argsort(keys, kind="stable")
    return order


@dataclass
class Grams:
    """The distinct n-grams of one order in a block, by the block's own numbers."""

    first: np.ndarray  # n-gram -> a position
    of: np.ndarray  # position -> n-gram
    context: np.ndarray  # position -> 0 at the start of a text, else 1 plus the (n-1)-gram before


class Block:
    """Tokens of some texts, and their n-grams."""

    def __init__(self, row: dict):
        self.words = unpack(row["ids"], np.int32)
        self.lengths, self.train = np.asarray(list(row["lengths"]), np.int64), np.asarray(list(row["train"]), bool)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.in_training = np.repeat(self.train, self.lengths)

    def orders(self, order: int) -> Iterator[Grams]:
        size = int(self.words.max()) + 1
        first = np.empty(size, np.int64)
        first[self.words[::-1]] = np.arange(len(self.words))[::-1]
        grams = Grams(first, self.words, np.zeros(len(self.words), np.int32))
        yield grams
        for _ in range(1, order):
            context = np.roll(grams.of, 1) + 1
            context[self.starts] = 0
            key = context.astype(np.uint64)
            key *= np.uint64(size)
            key += self.words.astype(np.uint64)
            grams = Grams(*numbered(key, ((len(grams.first) + 1) * size).bit_length()), context)
            yield grams

    def counts(self, grams: Grams) -> np.ndarray:
        return np.bincount(grams.of, weights=self.in_training, minlength=len(grams.first)).astype(np.uint32)


BLOCKS = "block string, doc_ids array<bigint>, lengths array<int>, train array<boolean>, keys binary, ids binary"


def read_blocks(docs: DataFrame, is_held_out: Callable[[int | None], bool], block_tokens: int) -> DataFrame:
    """One row for each block: documents in order, their tokens as numbers of the block's dictionary, which ascends by key."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        known: dict[bytes, int] = {}
        ids, doc_ids, lengths = [], [], []

        def close() -> pa.RecordBatch:
            nonlocal known, ids, doc_ids, lengths, number
            keys = np.fromiter((xxhash.xxh64_intdigest(w) for w in known), np.uint64, len(known))
            keys, of = np.unique(np.concatenate([np.array([END], np.uint64), keys]), return_inverse=True)
            packed = pack_sorted(keys), pack(of.astype(np.int32)[np.asarray(ids, np.int32)])
            row = [f"{part}-{number}"], [doc_ids], [lengths], [[not is_held_out(i) for i in doc_ids]], [packed[0]], [packed[1]]
            kinds = pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.binary(), pa.binary()
            known, ids, doc_ids, lengths, number = {}, [], [], [], number + 1
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(row, kinds)], [c.split()[0] for c in BLOCKS.split(", ")])

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                found = text.as_py().lower().split()
                ids += [known.setdefault(w, len(known) + 1) for w in found]
                ids.append(0)
                doc_ids.append(doc)
                lengths.append(len(found) + 1)
                if len(ids) >= block_tokens:
                    yield close()
        if doc_ids:
            yield close()

    return texts(docs).mapInArrow(task, BLOCKS)


def bucket_ranges(keys: np.ndarray, buckets: int, space: int = 1 << 64) -> np.ndarray:
    """Where each of the equal ranges of the key space starts among ascending keys."""
    edges = np.array([b * space // buckets for b in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


PACKED = "kind string, order int, block string, bucket int, size bigint, keys binary, a binary, b binary, c binary"


def _packed(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in PACKED.split(", ")])


_PACKED = {c.split()[0]: {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}[c.split()[1]] for c in PACKED.split(", ")}


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    """One row at a time as Python values."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _send(blocks: DataFrame, work: Callable[[dict], list[tuple]]) -> DataFrame:
    """Rows of ``PACKED`` that ``work`` makes from each row."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            columns = list(zip(*work(row))) or [()] * len(_PACKED)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _PACKED.values())], list(_PACKED))

    return blocks.mapInArrow(task, PACKED)


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Spark deletes the shuffle files of each query once its result is written."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _exchange(sent: DataFrame, label: str, highest: int) -> tuple[DataFrame, str]:
    """Brings the parts of each bucket together and stages what is made of them, by kind and order."""

    def bucket(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("block")
        kind, n, parts = frame["kind"].iloc[0], int(frame["order"].iloc[0]), list(frame.itertuples(index=False))
        if kind == "asked":
            return _packed(_sum_counts(n, parts, n < highest))
        return _packed((_sum_contexts if kind == "masses" else _lone_contexts)(n, parts))

    path = new_path(sent.sparkSession, label)
    sent.groupBy("kind", "order", "bucket").applyInPandas(bucket, PACKED).write.partitionBy("kind", "order").parquet(path)
    return sent.sparkSession.read.schema(PACKED).parquet(path), path


def _sum_counts(order: int, parts: list[tuple], number: bool = True) -> list[tuple]:
    """Adds counts; answers each block with counts, whether it owns the n-gram (1) and alone has it (2), and if asked for, the n-gram's number in the bucket."""
    sent = [unpack_sorted(p.keys) for p in parts]
    keys = np.concatenate(sent)
    low = keys.min()
    first, of = numbered(keys - low, int(keys.max() - low).bit_length())
    total = np.bincount(of, weights=np.concatenate([unpack(p.a, np.uint32) for p in parts]), minlength=len(first)).astype(np.int64)
    flags = (np.bincount(of) == 1)[of].astype(np.uint8) * 2
    flags[first] += 1
    out, at = [], 0
    for p, k in zip(parts, sent):
        mine = slice(at, at + len(k))
        numbers = pack_sorted(of[mine].astype(np.uint64)) if number else b""
        out.append(("counts", order, p.block, p.bucket, len(k), b"", pack(total[of[mine]].astype(np.uint64)), pack(flags[mine]), numbers))
        at += len(k)
    seen = total > 0
    histogram = np.bincount(np.minimum(total[seen], K + 2), minlength=K + 3)
    for which, figure in enumerate([seen.sum(), total.sum(), *histogram[1 : K + 2]]):
        out.append(("figures", order, "", which, int(figure), b"", b"", b"", b""))
    out.append(("sizes", order, "", parts[0].bucket, len(first), b"", b"", b"", b""))
    out.append(("grams", order, "", parts[0].bucket, int(seen.sum()), pack_sorted(keys[first][seen]), pack(total[seen].astype(np.uint64)), b"", b""))
    return out


def weights(total: np.ndarray, kept: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What counts are divided by, and the backoff weight, of contexts with these masses."""
    base = np.where((total > 0) & (total - kept < 1e-9), total + 1, total)  # no mass left: one more in the total
    with np.errstate(invalid="ignore", divide="ignore"):
        return base, np.where(total > 0, (1 - kept / base) / (1 - lower), 1.0)


def _sum_contexts(order: int, parts: list[tuple]) -> list[tuple]:
    """Adds the masses of contexts; answers with the totals, and the backoff weights of those asked for (lowest bit of a key)."""
    keys = [unpack_sorted(p.keys) for p in parts]
    unique, of = np.unique(np.concatenate(keys) >> np.uint64(1), return_inverse=True)
    total, kept, lower = (np.bincount(of, weights=np.concatenate([unpack(getattr(p, c), np.float64) for p in parts]), minlength=len(unique)) for c in "abc")
    base, alpha = weights(total, kept, lower)
    out, at = [], 0
    for p, k in zip(parts, keys):
        mine = of[at : at + len(k)]
        asked = mine[k % np.uint64(2) == 1]
        # single precision: 6e-8 of a weight
        out.append(("contexts", order, p.block, p.bucket, len(mine), b"", pack(base[mine].astype(np.uint64)), pack(alpha[asked].astype(np.float32)), b""))
        at += len(k)
    seen = total > 0
    out.append(("weights", order, "", parts[0].bucket, int(seen.sum()), pack_sorted(unique[seen]), pack(base[seen].astype(np.uint64)), pack(alpha[seen].astype(np.float32)), b""))
    return out


def _lone_contexts(order: int, parts: list[tuple]) -> list[tuple]:
    """Weights of contexts that one block alone has."""
    keys, base, alpha = (np.concatenate(v) for v in zip(*((unpack_sorted(p.keys), unpack(p.a, np.uint64), unpack(p.b, np.float32)) for p in parts)))
    at = np.argsort(keys)
    return [("weights", order, "", parts[0].bucket, len(at), pack_sorted(keys[at]), pack(base[at]), pack(alpha[at]), b"")]


@dataclass
class Figures:
    """Sums over an order: distinct n-grams, occurrences, numbers of n-grams of count 1 to K + 1."""

    distinct: int = 0
    total: int = 0
    of_count: list[int] = field(default_factory=lambda: [0] * (K + 1))

    def discounts(self) -> np.ndarray:
        """Factor for each count 0 to K; larger counts keep theirs."""
        n = [0, *self.of_count]
        if all(n[1:]):
            cut = (K + 1) * n[K + 1] / n[1]
            found = [((c + 1) * n[c + 1] / (c * n[c]) - cut) / (1 - cut) if cut != 1 else 2.0 for c in range(1, K + 1)]
            if all(0 < d < 1 for d in found):
                return np.array([0.0, *found])
        off = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        return np.array([0.0, *[(c - off) / c if off < c else 0.5 for c in range(1, K + 1)]])


@dataclass
class Model:
    """What is known of all orders, and where the tables of the model lie."""

    order: int
    figures: dict[int, Figures]
    paths: list[str]
    starts: dict[int, np.ndarray] = field(default_factory=dict)  # number of the first n-gram of each bucket, and of all n-grams

    def key_width(self, n: int) -> int:
        """Bits of a key of order ``n``, of them the word's; 64 at most."""
        return min(64, self.context_bits(n) + self.word_bits) if n > 1 else 64

    @property
    def word_bits(self) -> int:
        return int(self.starts[1][-1]).bit_length()

    def context_bits(self, n: int) -> int:
        return int(self.starts[n - 1][-1] + 1).bit_length()

    def keys(self, n: int, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Keys of n-grams from the names of their contexts and the numbers of their words."""
        if self.context_bits(n) + self.word_bits > 64:
            return gram_keys(context, word)
        return mixed((context << np.uint64(self.word_bits)) | word, self.key_width(n))

    def discounted(self, n: int, counts: np.ndarray) -> np.ndarray:
        d = self.figures[n].discounts()
        return np.where(counts <= K, d[np.minimum(counts, K)], 1.0) * counts

    def unigrams(self, counts: np.ndarray) -> np.ndarray:
        """Probability of words with these counts; 0 stands for the unknown word."""
        f = self.figures[1]
        if not f.total:
            return np.ones(len(counts))
        c = np.arange(1, K + 1)
        left = float(((1 - self.figures[1].discounts()[1:]) * c * np.array(f.of_count[:K])).sum())
        base = f.total if left > 0 else f.total + 1
        return np.where(counts > 0, self.discounted(1, counts) / base, (left or 1.0) / base)


_KINDS = {"counts": (np.uint64, np.uint8), "contexts": (np.uint64, np.float32)}


def _parts(answers: Iterable[dict], kind: str, order: int) -> list[dict]:
    return sorted((p for p in answers if p["kind"] == kind and p["order"] == order), key=lambda p: p["bucket"])


def _answers(row: dict, kind: str, order: int, columns: str) -> list[np.ndarray]:
    """What the buckets answered, put together in order of the keys."""
    parts = _parts(row["answers"], kind, order)
    return [np.concatenate([unpack(bytes(p[c]), k) for p in parts]) for c, k in zip(columns, _KINDS[kind])]


def _walk(model: Model, row: dict, block: Block, upto: int) -> Iterator[tuple]:
    """For each order: its n-grams, then in order of keys these and the keys, then by the block's numbers counts, flags and names.

    A name stands for the n-gram as a context of the next order; 0 comes first, for the start of a text.  What is
    not counted yet has keys but no counts; what is counted has no keys, but its order still follows from them.
    """
    names = words = None
    for n, grams in enumerate(block.orders(upto), 1):
        parts = _parts(row["answers"], "counts", n)
        if n > 1:
            keys = model.keys(n, names[grams.context[grams.first]], words[block.words[grams.first]])
            order = ascending(keys, model.key_width(n))
        else:  # words are numbered by their keys
            keys, order = None if parts else unpack_sorted(bytes(row["keys"])), np.arange(len(grams.first))
        if not parts:
            yield n, grams, order, keys[order], None, None, None
            return
        counts, flags = np.empty(len(order), np.int64), np.empty(len(order), np.uint8)
        counts[order], flags[order] = _answers(row, "counts", n, "ab")
        names = np.zeros(len(order) + 1, np.uint64)
        if n < model.order:
            names[1:][order] = np.concatenate([unpack_sorted(bytes(p["c"])) + np.uint64(model.starts[n][p["bucket"]] + 1) for p in parts])
        if n == 1:
            words = names[1:] - np.uint64(1)
        yield n, grams, order, None, counts, flags, names


def _masses(model: Model, n: int, grams: Grams, counts: np.ndarray, flags: np.ndarray, lower: np.ndarray, size: int) -> list[np.ndarray]:
    """For each context of the block: count, discounted count and lower-order probability of the n-grams that the block owns."""
    mine = (flags % 2 == 1) & (counts > 0)
    at, own = grams.first[mine], counts[mine]
    total, kept, below = (np.bincount(grams.context[at], weights=v, minlength=size).astype(np.float64) for v in (own, model.discounted(n, own), lower[at]))  # integers if there are none
    return [total, kept, np.round(below / STEP) * STEP]


def _backed_off(model: Model, row: dict, n: int, grams: Grams, counts: np.ndarray, flags: np.ndarray, p: np.ndarray, names: tuple, buckets: int) -> tuple[np.ndarray, list[tuple]]:
    """Probabilities of order ``n`` from those of the order below, or, when the masses are not answered, what the block sends of them."""
    contexts, alone, name = names
    at, out, used = counts[grams.of], [], np.zeros(len(alone), bool)
    used[grams.context] = True
    total, kept, lower = _masses(model, n, grams, counts, flags, p, len(alone))
    contexts = contexts[used[contexts]]
    base, alpha = weights(total, kept, lower)
    shared = contexts[~alone[contexts]]
    asked = np.zeros(len(alone), bool)  # contexts whose weight is multiplied by
    asked[grams.context[at == 0]] = True
    if _parts(row["answers"], "contexts", n):
        base[shared], alpha[shared[asked[shared]]] = _answers(row, "contexts", n, "ab")
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(at > 0, model.discounted(n, at) / base[grams.context], alpha[grams.context] * p), out
    lone = contexts[alone[contexts] & (total[contexts] > 0)]
    for kind, some, values in (("masses", shared, (total, kept, lower)), ("lone", lone, (base.astype(np.uint64), alpha.astype(np.float32)))):
        cut = bucket_ranges(name[some], buckets, int(model.starts[n - 1][-1]) + 1)
        for b, (lo, hi) in enumerate(zip(cut, cut[1:])):
            if hi > lo:
                part = some[lo:hi]
                packed = [pack(v[part]) for v in values]
                called = name[part] if kind == "lone" else name[part] * np.uint64(2) + asked[part]
                out.append((kind, n, row["block"], b, int(hi - lo), pack_sorted(called), *packed, *[b""] * (3 - len(packed))))
    return p, out


def _work(model: Model, row: dict, upto: int, buckets: int) -> tuple[list[tuple], np.ndarray, np.ndarray]:
    """What a block sends when all orders to ``upto`` are counted: masses of this order and n-grams of the next.

    When the masses are answered, too: the probability of every token, and the training count of its word.
    """
    block, out, p, seen = Block(row), [], None, None
    before = None  # contexts of the next order: in order of names, whether one block alone has them, and names
    for n, grams, order, keys, counts, flags, names in _walk(model, row, block, min(upto + 1, model.order)):
        if counts is None:
            cut, own = bucket_ranges(keys, buckets, 1 << model.key_width(n)), block.counts(grams)[order]
            for b, (lo, hi) in enumerate(zip(cut, cut[1:])):
                if hi > lo:
                    out.append(("asked", n, row["block"], b, int(hi - lo), pack_sorted(keys[lo:hi]), pack(own[lo:hi]), b"", b""))
            break
        if n == 1:
            seen = counts[grams.of]
            p = model.unigrams(seen)
        else:
            p, more = _backed_off(model, row, n, grams, counts, flags, p, before, buckets)
            out += more
        before = np.concatenate([[0], order + 1]), np.concatenate([[False], flags >= 2]), names
    return out, p, seen


def _table(rows: DataFrame, label: str) -> tuple[DataFrame, Callable[[], None]]:
    """Rows of blocks as a table in the shared folder, bucketed so that such tables join where they lie, and what deletes it."""
    spark = rows.sparkSession
    path, parts = new_path(spark, label), int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = label.replace("-", "_") + "_" + path.rsplit("-", 1)[-1]
    rows.write.bucketBy(parts, "block").option("path", path).saveAsTable(name)

    def drop() -> None:
        spark.sql(f"DROP TABLE {name}")
        discard(spark, path)

    return spark.table(name), drop


def _by_block(answers: DataFrame) -> DataFrame:
    """One row for each block: at most orders * buckets parts."""
    return answers.where("kind in ('counts', 'contexts')").groupBy("block").agg(F.collect_list(F.struct("kind", "order", "bucket", "a", "b", "c")).alias("more"))


def _with_answers(blocks: DataFrame, packed: DataFrame) -> DataFrame:
    return blocks.join(packed, "block").withColumn("answers", F.concat("answers", "more")).drop("more")


def train_and_score(
    docs: DataFrame, *, order: int = 3, is_held_out: Callable[[int | None], bool] = lambda i: False, block_tokens: int = 1_000_000, bucket_tokens: int = 1_000_000
) -> tuple[DataFrame, Model]:
    """Scores of all documents under a model of those not held out, and the model.

    Columns: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``; scores are log10.
    """
    with _shuffles_dropped(docs.sparkSession):
        return _train_and_score(docs, order, is_held_out, block_tokens, bucket_tokens)


def _add_figures(model: Model, answers: DataFrame, n: int, buckets: int) -> None:
    """What the buckets say of order ``n``: K + 3 sums, and a number for each bucket."""
    sums = answers.where(f"kind = 'figures' and order = {n}").groupBy("bucket").agg(F.sum("size").alias("n")).collect()
    found, f = {r.bucket: r.n for r in sums}, model.figures[n]
    f.distinct, f.total, *f.of_count = (found.get(which, 0) for which in range(K + 3))
    starts = np.zeros(buckets + 1, np.int64)
    for r in answers.where(f"kind = 'sizes' and order = {n}").select("bucket", "size").collect():
        starts[r.bucket + 1] = r.size
    model.starts[n] = np.cumsum(starts)


def _train_and_score(docs: DataFrame, order: int, is_held_out: Callable[[int | None], bool], block_tokens: int, bucket_tokens: int) -> tuple[DataFrame, Model]:
    spark = docs.sparkSession
    nothing = F.expr("cast(array() as array<struct<kind: string, order: int, bucket: int, a: binary, b: binary, c: binary>>)")
    blocks, drop = _table(read_blocks(docs, is_held_out, block_tokens).withColumn("answers", nothing), "katz-blocks")
    tokens = blocks.select(F.sum(F.aggregate("lengths", F.lit(0).cast("bigint"), lambda s, x: s + x))).first()[0] or 0
    buckets = max(1, -(-tokens // bucket_tokens))
    model = Model(order, {n: Figures() for n in range(1, order + 1)}, [])
    for upto in range(order):
        answers, path = _exchange(_send(blocks, lambda row, upto=upto: _work(model, row, upto, buckets)[0]), "katz-model", order)
        model.paths.append(path)
        _add_figures(model, answers, upto + 1, buckets)
        if upto == 0:  # words have numbers now
            blocks, _ = _table(_with_answers(blocks, _by_block(answers)).withColumn("keys", F.lit(b"").cast("binary")), "katz-blocks")
            drop()
        else:
            blocks = _with_answers(blocks, _table(_by_block(answers), "katz-answers")[0])
        for kind in ("counts", "contexts"):  # now in rows of blocks
            discard(spark, f"{path}/kind={kind}")
    if order > 1:
        answers, path = _exchange(_send(blocks, lambda row: _work(model, row, order, buckets)[0]), "katz-model", order)
        model.paths.append(path)
        blocks = _with_answers(blocks, _by_block(answers))

    first = model.figures[1]

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            _, p, known = _work(model, row, order, buckets)
            block = Block(row)
            base = np.log10((known + 1) / (first.total + first.distinct + 1))
            sums = [np.add.reduceat(v, block.starts) for v in ((known > 0).astype(np.int64), base, np.log10(p))]
            columns = {"doc_id": pa.array(row["doc_ids"], pa.int64()), "held_out": ~block.train, "n_tokens": block.lengths, "n_known": sums[0]}
            columns |= {"train_tokens": np.full(len(block.lengths), first.total, np.int64), "base_score": sums[1], "score": sums[2]}
            yield pa.RecordBatch.from_pydict(columns)

    kinds = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return blocks.mapInArrow(task, kinds), model


def crc32_held_out(modulus: int, remainder: int) -> Callable[[int | None], bool]:
    """Held out by the crc32 of the id as text."""
    return lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % modulus == remainder
