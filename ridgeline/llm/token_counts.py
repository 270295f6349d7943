"""Token counts of byte-level BPE, with huge documents cut into overlapping chunks.

Encoding first splits a text at special strings and then, from left to right, into words by a
pattern; tokens never cross the end of a word.  From any word end onward, the words depend only
on the text that follows.  Two neighbouring chunks may therefore be spliced at a position that
ends a word in both, if that end is proven in the left chunk, that is:

* the word after it also ends inside the left chunk with at least one word behind it, so the
  end does not depend on text the chunk cannot see;
* at least the longest special string lies between it and the end of the chunk, so none is cut.

A document longer than ``chunk`` characters becomes rows of one chunk each, spread over tasks.
A chunk reports word ends with running token counts in its first and last overlap only, and its
total; each joint takes its first common proven end.  Documents with a joint that has none are
encoded again with overlaps (and chunks) ``widen`` times as wide, in the end as one chunk, so counts are
exact whatever the text.

The tokens of a word are counted once for each distinct word of a task.  Words are
split by the same pattern where a text has only characters on whose class both pattern engines
agree (``PLAIN``), else by the library's own splitter.

Null counts as empty: no bytes, no tokens.  Repeated rows and equal ids are counted row by row;
an empty table gives an empty result.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ridgeline.llm.common import per_document, texts
from ridgeline.staging import stage

#: White space, and the splitting pattern of byte-level BPE.
BLANK = r"\t-\r \x85\xa0  -     　"
WORDS = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{BLANK}\p{{L}}\p{{N}}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+"
)
#: Latin, Greek, Cyrillic, punctuation, kana and Han: classes of letters and digits long settled.
PLAIN = regex.compile(r"[\x00-ͯЀ-ԧ‐-›€ぁ-ゖァ-ヺ一-龥]*+")


def _merger(library: Tokenizer) -> tiktoken.Encoding | None:
    """The same merges for single words with less overhead for each call, if they are provably the same.

    A merge applies in order of its rank; where the ids of the merged tokens have that very order,
    merging by id gives the library's tokens.  Otherwise the library is asked word by word.
    """
    model = json.loads(library.to_str())["model"]
    vocabulary = model["vocab"]
    merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    made = [vocabulary[m] for m in merges]
    if made != sorted(set(made)) or model.get("ignore_merges") or model.get("dropout"):
        return None
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    odd = [b for b in range(256) if b not in set(printable)]
    to_byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(odd)}  # bytes stand as visible characters
    basic = [t for t in vocabulary if len(t) == 1]
    if len(basic) != 256 or max(vocabulary[t] for t in basic) > made[0]:
        return None
    ranks = {bytes(to_byte[c] for c in t): vocabulary[t] for t in [*basic, *merges]}
    return tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})


class WordCounter:
    """Splits a text into words and counts the tokens of each."""

    def __init__(self, path: str, remember: int = 400_000):
        self.library = Tokenizer.from_file(path)
        if self.library.normalizer is not None or type(self.library.pre_tokenizer).__name__ != "ByteLevel":
            raise ValueError(f"{path}: only byte-level BPE without normalisation can be spliced")
        self.library.no_truncation()
        self.library.no_padding()
        specials = sorted((t.content for t in self.library.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.specials = regex.compile("|".join(map(regex.escape, specials))) if specials else None
        self.margin = max(map(len, specials), default=0)
        self.special_set = set(specials)
        self.merger = _merger(self.library)
        self.remember = remember
        self.counts: dict[str, int] = {}

    def split(self, text: str) -> list[str]:
        """The words in order; joined they are the text.  A special string is one word."""
        out, at = [], 0
        for m in self.specials.finditer(text) if self.specials else ():
            out += [*self._words(text[at : m.start()]), m.group()]
            at = m.end()
        return out + self._words(text[at:]) if at else self._words(text)

    def _words(self, text: str) -> list[str]:
        if PLAIN.fullmatch(text):
            return WORDS.findall(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def sizes(self, found: list[str]) -> list[int]:
        """Tokens of each word."""
        counts = self.counts
        if len(counts) > self.remember:
            counts.clear()  # only costs time: words are counted anew
        new = [w for w in set(found) if w not in counts]
        if new:
            self._learn(new)
        return [counts[w] for w in found]

    def _learn(self, new: list[str]) -> None:
        if self.merger is None:
            found = map(len, self.library.encode_batch_fast(new, add_special_tokens=False))
        else:
            one = self.merger.encode_ordinary
            found = (1 if w in self.special_set else len(one(w)) for w in new)
        self.counts.update(zip(new, found))

    def count(self, text: str) -> int:
        return sum(self.sizes(self.split(text)))


def chunk_ends(counter: WordCounter, body: str, start: int, last: bool, chunk: int, overlap: int) -> tuple[int, list, list]:
    """Total of tokens, then (end, tokens so far) in the first overlap, and those proven in the last."""
    found = counter.split(body)
    at, done, ends = start, 0, []
    for word, n in zip(found, counter.sizes(found)):
        at, done = at + len(word), done + n
        if at <= start + overlap or at > start + chunk:
            ends.append((at, done))
    head = [e for e in ends if e[0] <= start + overlap] if start else []
    seen = start + len(body) - counter.margin
    tail = [] if last else [e for e in ends[:-2] if start + chunk < e[0] <= seen]
    return done, head, tail


def _slices(big: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """``text_key, k, pieces, body`` of the long texts; each slice reads on into the next."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, raw in zip(batch.column("text_key").to_pylist(), batch.column("text")):
                text = raw.as_py().decode("utf-8", "replace")
                pieces = max(1, -(-(len(text) - overlap) // chunk))
                for k in range(pieces):
                    body = text[k * chunk :] if k == pieces - 1 else text[k * chunk : (k + 1) * chunk + overlap]
                    cols = [pa.array([key]), pa.array([k], pa.int32()), pa.array([pieces], pa.int32()), pa.array([body])]
                    yield pa.RecordBatch.from_arrays(cols, ["text_key", "k", "pieces", "body"])

    return big.mapInArrow(task, "text_key string, k int, pieces int, body string").repartition("text_key", "k")


def _ends(slices: DataFrame, path: str, chunk: int, overlap: int, remember: int) -> DataFrame:
    """One row per word end in an overlap (``joint``: number of the left chunk) and per total."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = WordCounter(path, remember)
        for batch in batches:
            for key, k, pieces, body in zip(*(batch.column(c).to_pylist() for c in ("text_key", "k", "pieces", "body"))):
                total, head, tail = chunk_ends(counter, body, k * chunk, k == pieces - 1, chunk, overlap)
                rows = [(k - 1, e, None, n) for e, n in head] + [(k, e, n, None) for e, n in tail]
                if k == pieces - 1:
                    rows.append((k, None, total, None))
                if rows:
                    joint, end, left, right = (pa.array(c, pa.int64()) for c in zip(*rows))
                    fixed = [pa.array([v] * len(rows), t) for v, t in ((key, pa.string()), (pieces, pa.int64()))]
                    yield pa.RecordBatch.from_arrays([*fixed, joint, end, left, right], ["text_key", "pieces", "joint", "cut", "l", "r"])

    return slices.mapInArrow(task, "text_key string, pieces bigint, joint bigint, cut bigint, l bigint, r bigint")


def spliced(big: DataFrame, path: str, *, chunk: int, overlap: int, widen: int = 4, remember: int = 400_000) -> DataFrame:
    """``text_key, n_tokens`` of long texts (columns ``text_key``, ``text``), cut and spliced.

    Equal texts share a key and a result.
    """
    done = None
    while True:
        ends = _ends(_slices(big, chunk, overlap), path, chunk, overlap, remember)
        # equal texts give equal rows, so the largest stands for all; a total has no cut
        common = ends.groupBy("text_key", "pieces", "joint", "cut").agg(F.max("l").alias("l"), F.max("r").alias("r"))
        share = F.when(F.col("cut").isNull(), F.col("l")).otherwise(F.col("l") - F.col("r"))
        joints = common.withColumn("n", share).where("n is not null").groupBy("text_key", "pieces", "joint")
        joints = joints.agg(F.min_by("n", F.coalesce("cut", F.lit(0))).alias("n"))
        counted = joints.groupBy("text_key", "pieces").agg(F.sum("n").alias("n_tokens"), F.count("*").alias("joints"))
        round_ = stage(counted, "spliced")
        whole = round_.where("joints = pieces").select("text_key", "n_tokens")
        done = whole if done is None else done.unionByName(whole)
        left = round_.where("joints < pieces").select("text_key")
        if left.isEmpty():
            return done
        big = big.join(left, "text_key", "left_semi")
        chunk, overlap = chunk * widen, overlap * widen


def count_tokens(docs: DataFrame, path: str, *, chunk: int = 32_768, overlap: int = 1_024, remember: int = 400_000) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of every row; texts of more than ``chunk`` bytes are cut."""
    rows = texts(docs)
    size = F.octet_length("text")

    def make():
        counter = WordCounter(path, remember)
        return lambda text: (len(text), counter.count(text.decode("utf-8", "replace")))

    small = per_document(rows.where(size <= chunk), "n_bytes bigint, n_tokens bigint", make)
    big = rows.where(size > chunk).withColumn("text_key", F.sha2("text", 256))
    found = spliced(big.select("text_key", "text"), path, chunk=chunk, overlap=overlap, remember=remember)
    big = big.select("doc_id", size.cast("bigint").alias("n_bytes"), "text_key").join(found, "text_key")
    return small.unionByName(big.select("doc_id", "n_bytes", "n_tokens"))
