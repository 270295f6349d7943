"""Ranked lexical search: the best documents for each item by norm buckets of impact vectors.

A document is a vector over the items' terms: the coordinate of a term is its weight times its
impact in the document, both integers, and an item is the vector of its term counts.  The score is
their product.  In the manner of LEMP:

* a task orders its vectors by length and cuts them into buckets;
* for an item, a bucket whose longest vector times the item's length stays below the item's
  ``top``-th best score so far ends the search, as all later buckets are shorter (Cauchy-Schwarz);
* inside a bucket a bound on the item's heaviest coordinate prunes single vectors:
  ``c * v + |rest of the item| * |rest of the vector|``;
* survivors are scored in 64-bit integers.  Bounds are widened by a millionth of a millionth, so
  rounding never loses a document.

Every task returns its best ``top`` rows of each item, and the best of these are the result.  Bounds
only use what a task has seen, so tasks are independent and may be lost and run again.

Items are the stated query set; they come to the tasks in blocks of at most ``block`` items, whose
terms are the only ones kept of a document.  Null texts have no terms.  Each row of ``docs`` is a
document of its own, rows with equal or no id too; a null id comes after all others among equal
scores.  Each row of ``items`` is a query of its own.  An item without terms or matches has no rows.  Very
long texts are cut into terms whole, one text in memory at a time.  Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.llm.common import utf8
from ridgeline.staging import number_rows, stage

#: Letters and digits and all characters beyond ASCII belong to terms; A-Z are lower-cased.
_FOLDED = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in bytes(range(256)).lower())
#: Vectors that a task orders by length at a time, and cells of a bucket's table of coordinates.
ROWS, CELLS = 8192, 1 << 21
SLACK = 1 + 1e-12


def terms(text: bytes) -> list[bytes]:
    return text.translate(_FOLDED).split()


def _vectors(docs: DataFrame, known: dict[bytes, int]) -> DataFrame:
    """``doc_id, n, term, tf`` of every document: its length and its counts of known terms."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, numbers, counts = [], [], []
            for text in batch.column("text"):
                found = terms(text.as_py())
                own = {known[t]: c for t, c in Counter(found).items() if t in known}
                sizes.append(len(found))
                numbers.append(list(own.keys()))
                counts.append(list(own.values()))
            columns = [batch.column("doc_id"), pa.array(sizes, pa.int64())]
            columns += [pa.array(numbers, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "term", "tf"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), utf8(F.col("text")).alias("text"))
    return rows.mapInArrow(task, "doc_id bigint, n bigint, term array<int>, tf array<bigint>")


def _holders(vectors: DataFrame, n_terms: int) -> np.ndarray:
    """How many documents hold each known term; as many numbers as the block of items has terms."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            total += np.bincount(batch.column("term").flatten().to_numpy(), minlength=n_terms)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["term", "df"])

    rows = vectors.select("term").mapInArrow(task, "term int, df bigint").groupBy("term").agg(F.sum("df").alias("df")).collect()
    found = np.zeros(n_terms, np.int64)
    for r in rows:
        found[r.term] = r.df
    return found


def weights(holders: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in holders], np.int64)


class _Best:
    """The best ``top`` (score, id) of one item, highest score first, then smallest id, no id last."""

    def __init__(self, top: int) -> None:
        self.top, self.least = top, 1
        self.scores, self.ids, self.missing = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    def add(self, scores: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        missing = np.concatenate([self.missing, missing])
        order = np.lexsort((ids, missing, -scores))[: self.top]
        self.scores, self.ids, self.missing = scores[order], ids[order], missing[order]
        if len(order) == self.top:
            self.least = int(self.scores[-1])


class _Query:
    def __init__(self, counts: dict[int, int], weight: np.ndarray) -> None:
        self.term = np.array(list(counts), np.int64)
        self.count = np.array(list(counts.values()), np.int64)
        self.length = math.sqrt(float((self.count.astype(float) ** 2).sum()))
        focus = int(np.argmax(self.count * weight[self.term]))
        self.focus, self.factor = int(self.term[focus]), int(self.count[focus])
        self.rest = math.sqrt(max(0.0, self.length**2 - float(self.factor) ** 2))


def _norms(sizes: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """The length part of the formula; Python integers where 64 bits would not do."""
    if 25 * int(sizes.max(initial=0)) * n_docs < 1 << 62:
        return 75 + (25 * sizes * n_docs) // n_terms
    return np.array([75 + 25 * int(n) * n_docs // n_terms for n in sizes], np.int64)


def _search(batch: pa.RecordBatch, queries: list[_Query], best: list[_Best], weight: np.ndarray, n_docs: int, n_terms: int) -> None:
    """Let the vectors of one batch compete."""
    held = np.diff(batch.column("term").offsets.to_numpy())
    doc = np.repeat(np.arange(len(batch)), held)
    term, tf = (batch.column(c).flatten().to_numpy() for c in ("term", "tf"))
    m = _norms(batch.column("n").to_numpy(), n_docs, n_terms)
    value = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[doc]))
    squares = np.bincount(doc, value.astype(float) ** 2, minlength=len(batch))
    order = np.argsort(-squares, kind="stable")
    order = order[squares[order] > 0]
    place = np.full(len(batch), -1)
    place[order] = np.arange(len(order))
    by_place = np.argsort(place[doc], kind="stable")
    term, value, spot = term[by_place], value[by_place], place[doc][by_place]
    ids = batch.column("doc_id")
    missing, ids = np.asarray(ids.is_null())[order], ids.fill_null(0).to_numpy()[order]
    squares = squares[order]
    lengths = np.sqrt(squares)
    width = max(1, min(512, CELLS // max(1, len(weight))))
    table, open_ = np.zeros((len(weight), width), np.int64), list(range(len(queries)))
    for start in range(0, len(order), width):
        open_ = [q for q in open_ if queries[q].length * lengths[start] * SLACK >= best[q].least]
        if not open_:
            return
        stop = min(start + width, len(order))
        a, b = np.searchsorted(spot, [start, stop])
        at = (term[a:b], spot[a:b] - start)
        table[at] = value[a:b]
        for q in open_:
            query = queries[q]
            first = table[query.focus, : stop - start].astype(float)
            bound = query.factor * first + query.rest * np.sqrt(np.maximum(0.0, squares[start:stop] * SLACK - first**2))
            alive = np.flatnonzero(bound * SLACK >= best[q].least)
            if len(alive):
                scores = query.count @ table[np.ix_(query.term, alive)]
                good = scores >= best[q].least
                if good.any():
                    alive = alive[good] + start
                    best[q].add(scores[good], ids[alive], missing[alive])
        table[at] = 0


def _ranked(docs: DataFrame, items: list[tuple[int, object, dict[bytes, int]]], top: int) -> DataFrame | None:
    """Rows for one block of items, given as number, id and counts of terms."""
    known = {t: i for i, t in enumerate(sorted({t for _, _, counts in items for t in counts}))}
    if not known:
        return None
    vectors = stage(_vectors(docs, known), "search-vectors")
    total = vectors.agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    weight = weights(_holders(vectors, len(known)), total.docs)
    n_docs, n_terms = total.docs, total.terms
    asked = [(number, {known[t]: c for t, c in counts.items()}) for number, _, counts in items if counts]

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, best = [_Query(counts, weight) for _, counts in asked], [_Best(top) for _ in asked]
        for batch in batches:
            for start in range(0, len(batch), ROWS):
                _search(batch.slice(start, ROWS), queries, best, weight, n_docs, n_terms)
        numbers = np.repeat([number for number, _ in asked], [len(b.scores) for b in best]).astype(np.int64)
        ids = pa.array(np.concatenate([b.ids for b in best]), pa.int64(), mask=np.concatenate([b.missing for b in best]))
        yield pa.RecordBatch.from_arrays([pa.array(numbers), ids, pa.array(np.concatenate([b.scores for b in best]))], ["_item", "doc_id", "score"])

    found = vectors.where(F.size("term") > 0).mapInArrow(task, "_item bigint, doc_id bigint, score bigint")
    order = Window.partitionBy("_item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, *, top: int = 20, block: int = 500) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` documents of every item with a score above zero."""
    spark = docs.sparkSession
    texts = items.select("item_id", utf8(F.col("text")).alias("text"))
    numbered = stage(number_rows(texts, [F.col("item_id"), F.col("text")], "_item"), "search-items")
    parts = []
    for start in range(0, numbered.count(), block):
        rows = numbered.where((F.col("_item") >= start) & (F.col("_item") < start + block)).collect()
        part = _ranked(docs, [(r["_item"], r["item_id"], Counter(terms(bytes(r["text"])))) for r in rows], top)
        if part is not None:
            parts.append(part)
    kind = dict(items.dtypes)["item_id"]
    if not parts:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    ranked = parts[0]
    for part in parts[1:]:
        ranked = ranked.unionByName(part)
    return ranked.join(numbered.select("_item", "item_id"), "_item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


ORACLE = r"""
WITH raw AS (
  SELECT doc_id, row_number() OVER () AS row_no, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
words AS (
  SELECT row_no, doc_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM raw),
counts AS (SELECT row_no, any_value(doc_id) AS doc_id, term, count(*)::BIGINT AS tf FROM words GROUP BY row_no, term),
sizes AS (SELECT row_no, sum(tf)::BIGINT AS n FROM counts GROUP BY row_no),
whole AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM sizes),
holders AS (SELECT term, count(*)::BIGINT AS df FROM counts GROUP BY term),
weight AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM holders, whole),
asked AS (
  SELECT item_no, any_value(item_id) AS item_id, term, count(*)::BIGINT AS c
  FROM (SELECT item_no, item_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM (SELECT item_id, row_number() OVER () AS item_no,
                     translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM benchmark))
  GROUP BY item_no, term),
scored AS (
  SELECT item_no, any_value(a.item_id) AS item_id, c.row_no, any_value(c.doc_id) AS doc_id,
         sum(a.c * w.w * ((1000000000 * c.tf) // (1000 * c.tf + 12 * (75 + (25 * s.n * whole.big_n) // whole.big_l))))::BIGINT AS score
  FROM asked a JOIN counts c USING (term) JOIN weight w USING (term) JOIN sizes s ON s.row_no = c.row_no, whole
  GROUP BY item_no, c.row_no),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_no ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""
