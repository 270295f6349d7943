"""Main text of web pages; a host's suffix arrays find the runs that its pages repeat.

* Each page becomes blocks of text (``html_blocks``).  Blocks marked as menus, headers, footers, sidebars,
  notices, adverts, forms or comments go.  Where a page marks its article (or main part), the other
  blocks go too.
* The blocks outside articles of a host's distinct pages are concatenated to streams of words.  Tasks
  sort the suffixes of their streams by prefix doubling up to ``words`` words.  Suffixes that agree that far
  are one class: a run of at least that length.  Classes are summed over all tasks.  A run is *repeated* if it is on
  two distinct pages or more and on at least ``share`` percent of the host's distinct pages.
* Words that repeated runs cover are removed from unmarked blocks, and unique runs stay.  A block inside an
  article goes only if such runs, found outside of articles, cover it whole: what articles alone share is
  text that they quote or copy from each other, and stays.

A stretch of ``words`` words or more is on several pages just if all its windows of that many words are, so classes of
windows cover the same words as the longest repeated substrings do.  Streams are cut anywhere between pages, so a host may
be as large as it likes.  Windows are told apart by 128 bits.

Pages with equal blocks are one page in the counts.  Null html is empty; a null or relative url has host ``''``.
Rows are independent of ``page_id`` and ``url``, which may be null or repeated.  A page without main text has the text ``''``.
Very long pages are read whole, one in memory at a time.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import utf8
from ridgeline.llm.html_blocks import split
from ridgeline.staging import stage

#: Words that a task's suffix array holds at least, unless its streams end before.
STREAM = 1 << 20
#: Rows up to which a table of removals is broadcast; each has at most a few hundred bytes, more rows are joined by a shuffle.
FEW = 50_000


def _parsed(pages: DataFrame) -> DataFrame:
    """Blocks of every page; ``page`` is a digest of them."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 500):  # blocks of few pages in memory at a time
                part = batch.slice(at, 500)
                main, other, apart, digests = [], [], [], []
                for html in part.column("html"):
                    inner, rest = split(html.as_py().decode("utf-8", "replace"))
                    main.append(inner)
                    other.append([t for _, t in rest])
                    apart.append([a for a, _ in rest])
                    digests.append(xxhash.xxh3_128_digest("\n".join(["" if inner is None else "\t".join(inner), *other[-1]]).encode()))
                columns = [pa.array(main, pa.list_(pa.string())), pa.array(other, pa.list_(pa.string())), pa.array(apart, pa.list_(pa.bool_()))]
                columns = [*(part.column(c) for c in kept), pa.array(digests, pa.binary()), *columns]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    kept = ["_row", "page_id", "url", "host"]
    empty = [F.lit(None).cast(k).alias(c) for c, k in (("page", "binary"), ("main", "array<string>"), ("other", "array<string>"), ("apart", "array<boolean>"))]
    schema = pages.select(*kept, *empty).schema
    return pages.select(*kept, utf8(F.col("html")).alias("html")).mapInArrow(task, schema)


def _same_windows(ids: np.ndarray, words: int) -> np.ndarray:
    """The class of every suffix by its first ``words`` words, numbered in suffix order.

    Classes by one word are doubled to 2, 4, 8, ...; the last step overlaps.  A suffix that ends before
    counts as followed by nothing.
    """
    rank, known = np.unique(ids, return_inverse=True)[1].astype(np.int64) + 1, 1
    while known < words:
        step = min(known, words - known)
        later = np.zeros_like(rank)
        later[: max(0, len(rank) - step)] = rank[step:]
        rank = np.unique(rank << 32 | later, return_inverse=True)[1].astype(np.int64) + 1
        known += step
    return rank


def _windows(streams: Iterable[tuple[str, bytes, list[str]]], words: int) -> Iterator[tuple[str, np.ndarray, list[bytes], np.ndarray, list[bytes]]]:
    """For each host among the streams: number of the page and window of every place, digests of windows, positions, pages."""
    hosts: dict[str, list[tuple[bytes, list[str]]]] = {}
    for host, page, text in streams:
        hosts.setdefault(host, []).append((page, text))
    for host, members in hosts.items():
        number: dict[str, int] = {}
        ids, owner, place = [], [], []
        for k, (_, text) in enumerate(members):
            own = [number.setdefault(w, len(number)) for w in text]
            ids += own
            ids.append(-1 - k)  # no run goes on into the next page
            owner += [k] * (len(own) + 1)
            place += range(len(own) + 1)
        ids, owner, place = np.array(ids, np.int64), np.array(owner, np.int64), np.array(place, np.int64)
        lengths = np.array([len(t) for _, t in members], np.int64)
        rank = _same_windows(ids, words)
        whole = np.flatnonzero(place + words <= lengths[owner])
        if not len(whole):
            continue
        _, first, same = np.unique(rank[whole], return_index=True, return_inverse=True)
        starts = whole[first].tolist()
        digests = [xxhash.xxh3_128_digest("\n".join(members[owner[s]][1][place[s] : place[s] + words]).encode()) for s in starts]
        yield host, owner[whole], digests, same, place[whole], [p for p, _ in members]


def _streams(batches: Iterable[pa.RecordBatch]) -> Iterator[list[tuple[str, bytes, list[str]]]]:
    """Lists of (host, page, words) with at least STREAM words together; the last may have fewer."""
    held, size = [], 0
    for batch in batches:
        for host, page, other in zip(batch.column("host").to_pylist(), batch.column("page").to_pylist(), batch.column("other")):
            text = " ".join(other.as_py()).split()
            held.append((host, page, text))
            size += len(text)
            if size >= STREAM:
                yield held
                held, size = [], 0
    yield held


def _repeated(distinct: DataFrame, words: int, share: int) -> DataFrame:
    """``host, window`` of the runs that enough of a host's distinct pages have."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _streams(batches):
            for host, owner, digests, same, _, members in _windows(held, words):
                on = np.bincount(np.unique(same * len(members) + owner) // len(members), minlength=len(digests))
                yield pa.RecordBatch.from_arrays([pa.array([host] * len(digests), pa.string()), pa.array(digests, pa.binary()), pa.array(on, pa.int64())], ["host", "window", "pages"])

    classes = distinct.select("host", "page", "other").mapInArrow(task, "host string, window binary, pages bigint")
    classes = classes.groupBy("host", "window").agg(F.sum("pages").alias("pages")).where("pages >= 2")
    sizes = distinct.groupBy("host").agg(F.count("*").alias("all"))
    return classes.join(sizes, "host").where(100 * F.col("pages") >= share * F.col("all")).select("host", "window")


def _places(rows: DataFrame, words: int) -> DataFrame:
    """``host, window, page, at`` of every window of the streams."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _streams(batches):
            for host, owner, digests, same, place, members in _windows(held, words):
                window = pa.array(digests, pa.binary()).take(pa.array(same))
                page = pa.array(members, pa.binary()).take(pa.array(owner))
                yield pa.RecordBatch.from_arrays([pa.array([host] * len(same), pa.string()), window, page, pa.array(place, pa.int64())], ["host", "window", "page", "at"])

    return rows.select("host", "page", "other").mapInArrow(task, "host string, window binary, page binary, at bigint")


def _anchors(rows: DataFrame, words: int) -> DataFrame:
    """``host, window, _row, block``: the first window of every block inside an article."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row, host, main in zip(batch.column("_row").to_pylist(), batch.column("host").to_pylist(), batch.column("main")):
                for k, block in enumerate(main.as_py()):
                    first = block.split(maxsplit=words)[:words]
                    if len(first) == words:
                        found.append((host, xxhash.xxh3_128_digest("\n".join(first).encode()), row, k))
            columns = zip(*found) if found else ([] for _ in range(4))
            kinds = (pa.string(), pa.binary(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["host", "window", "_row", "block"])

    return rows.select("_row", "host", "main").mapInArrow(task, "host string, window binary, _row bigint, block int")


def _joined(rows: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """Left join with a staged table, broadcast where a count shows that it is small."""
    return rows.join(F.broadcast(small) if small.count() <= FEW else small, keys, "left")


def _covered_blocks(articles: DataFrame, repeated: DataFrame, words: int) -> DataFrame:
    """``_row, blocks``: blocks inside articles that repeated runs cover whole."""
    suspects = stage(_anchors(articles, words).join(repeated, ["host", "window"], "left_semi").select("_row", "block"), "site-suspects")
    by_row = suspects.groupBy("_row").agg(F.collect_set("block").alias("blocks"))
    if suspects.isEmpty():
        return by_row
    held = _joined(articles, stage(by_row, "site-rows"), ["_row"]).where("blocks is not null")
    place = F.concat_ws(":", "_row", "block").cast("binary").alias("page")
    texts = held.select("_row", "host", "main", F.explode("blocks").alias("block"))
    texts = stage(texts.select("_row", "block", "host", place, F.array(F.expr("main[block]")).alias("other")), "site-blocks")
    places = _places(texts, words)
    known = places.join(repeated, ["host", "window"], "left_semi").groupBy("page").agg(F.array_sort(F.collect_set("at")).alias("at"))
    last = places.groupBy("page").agg(F.max("at").alias("last"))
    # whole: the first and the last window are repeated, and no gap between two is wider than a window
    far = F.expr(f"exists(zip_with(at, slice(at, 2, size(at)), (x, y) -> y - x > {words}), wide -> wide)")
    whole = known.join(last, "page").where((F.col("at")[0] == 0) & (F.element_at("at", -1) == F.col("last")) & ~F.coalesce(far, F.lit(False)))
    return texts.join(whole, "page", "left_semi").groupBy("_row").agg(F.collect_list("block").alias("blocks"))


def _article_text(rows: DataFrame) -> DataFrame:
    """The article's blocks but those in ``blocks``."""
    kept = F.expr("filter(main, (b, i) -> blocks is null or not array_contains(blocks, i))")
    return rows.select("page_id", "url", F.concat_ws(" ", kept).alias("text"))


def _unique_text(rows: DataFrame, words: int) -> DataFrame:
    """The words of unmarked blocks that no window at a place in ``at`` covers."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for other, apart, at in zip(*(batch.column(c).to_pylist() for c in ("other", "apart", "at"))):
                flat = [(w, a) for block, a in zip(other, apart) for w in block.split()]
                covered = np.zeros(len(flat) + 1, np.int64)
                for x in at or ():
                    covered[x] += 1
                    covered[x + words] -= 1
                found.append(" ".join(w for (w, a), c in zip(flat, np.cumsum(covered).tolist()) if not a and not c))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(found, pa.string())], ["page_id", "url", "text"])

    schema = rows.select("page_id", "url", F.lit("").alias("text")).schema
    return rows.select("page_id", "url", "other", "apart", "at").mapInArrow(task, schema)


def extract(pages: DataFrame, *, words: int = 8, share: int = 10) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    address = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), address, 1)).alias("host")
    rows = pages.select(F.monotonically_increasing_id().alias("_row"), "page_id", "url", host, "html")
    parsed = stage(_parsed(rows), "site-pages")
    distinct = stage(parsed.groupBy("host", "page").agg(F.first("other").alias("other"), F.first(F.col("main").isNull()).alias("unmarked")), "site-streams")
    repeated = stage(_repeated(distinct, words, share), "site-runs")
    articles, unmarked = parsed.where("main is not null"), parsed.where("main is null")
    marked_text = _article_text(_joined(articles, stage(_covered_blocks(articles, repeated, words), "site-covered"), ["_row"]))
    places = _places(distinct.where("unmarked"), words).join(repeated, ["host", "window"], "left_semi")
    covered = places.groupBy("host", "page").agg(F.collect_list("at").alias("at"))
    found = marked_text.unionByName(_unique_text(unmarked.join(covered, ["host", "page"], "left"), words))
    return found.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))
