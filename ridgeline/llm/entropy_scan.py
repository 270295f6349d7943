"""Secret scan: named patterns, and strings of high entropy in a sliding window.

Everything is DataFrame and SQL expressions.  Positions come from cutting the text at a pattern:
the lengths of the parts between and of the matches themselves, summed up in order, give the ends of the
matches, in code points.

Base kinds are leftmost non-overlapping matches: ``assign`` (a named credential and its value),
``access`` (access keys) and ``hex`` (long hexadecimal runs).  The method adds the kind
``entropy``: in each maximal run of key characters (a name before ``=`` is a run of its own) of at least
20 with a digit and a letter, a window moves one character at a time; the counts of the leaving and the entering character update the sum
of ``c log2 c``, which gives the Shannon entropy of the window.  From the first to the last window that
reaches the threshold of the run's character class, the run is reported, unless it lies inside a base
span or is on the allow list.

Null counts as empty; a text without matches has no spans and the digest of the empty string.
Rows are scanned one by one, so repeated rows and equal ids give equal results; without rows the
result is empty.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run is matched as a whole or not at all, so the least length can stand in the pattern.
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
#: An equals sign ends a run, so a name before it is judged apart from its value; only padding at the end belongs to a run.
KEY_RUN = "[A-Za-z0-9+/_-]{18,}(?:={1,2}(?![A-Za-z0-9+/_=-]))?"
KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 20
#: Bits for each character of a window of 20 (at most 4.32).
THRESHOLDS = {"^[0-9a-fA-F]+=*$": 3.0, "^[A-Z0-9]+=*$": 3.5, "^[a-z0-9]+=*$": 3.5, "": 3.8}
#: A word of up to 15 letters that could stand in a dictionary: vowels, with at most three consonants in a row.
_WORD_PART = "(?=[a-z]{2,15}[0-9]{0,4}(?:/|$))(?:[b-df-hj-np-tv-xz]{0,3}[aeiouy]{1,2})+[b-df-hj-np-tv-xz]{0,3}[0-9]{0,4}"
#: Runs that are no secrets: UUIDs, dates and numbers, values with a sample word inside, paths of plain words.
#: A sample word counts only inside the last part, and only if that is long enough for a value, not in a name or path.
ALLOWED = (
    "^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$",
    "^[0-9+/_=-]+$",
    "(?i)(?:^|[/_+-])(?=[A-Za-z0-9]{16,}=*$)[A-Za-z0-9]*(?:example|sample|placeholder|changeme|x{6})",
    f"^/?(?:{_WORD_PART}/)+(?:{_WORD_PART})?$",
)
#: ``c log2 c`` for the counts a window can hold.
_PLOGP = "array(" + ", ".join(f"{c * math.log2(c) if c else 0.0!r}D" for c in range(WINDOW + 1)) + ")"


def running_sums(lengths: str) -> str:
    """SQL for inclusive running sums of an integer array, in blocks so that the work stays near linear."""
    block = 256
    cut = f"transform(sequence(0, (size({lengths}) - 1) div {block}), b -> slice({lengths}, b * {block} + 1, {block}))"
    sums = f"transform({cut}, c -> aggregate(c, 0L, (s, x) -> s + x))"
    inside = "transform(c, (x, i) -> aggregate(slice(c, 1, i + 1), 0L, (s, y) -> s + y) + aggregate(slice(sums, 1, b), 0L, (s, y) -> s + y))"
    return f"flatten(transform(array({sums}), sums -> flatten(transform({cut}, (c, b) -> {inside}))))"


def _spans(text: str, pattern: str, order: int, group: int, least: int) -> str:
    """SQL for the sorted-by-position array of (start, ord, stop) of the matches whose group has ``least`` characters."""
    quoted = "r'" + pattern.replace("'", "\\x27") + "'"
    hits = f"regexp_extract_all({text}, {quoted}, 0)"
    values = f"regexp_extract_all({text}, {quoted}, {group})" if group else "hits"
    lengths = f"transform(hits, (h, i) -> char_length(parts[i]) + char_length(h))"
    spans = f"transform(arrays_zip(hits, vals, ends), x -> struct(x.ends - char_length(x.hits) as start, {order} as ord, x.ends as stop, char_length(x.vals) as size))"
    body = f"filter({spans}, x -> x.size >= {least})"
    body = f"flatten(transform(array({running_sums('lengths')}), ends -> {body}))"
    body = f"flatten(transform(array({lengths}), lengths -> {body}))"
    body = f"flatten(transform(array({values}), vals -> {body}))"
    body = f"flatten(transform(array(split({text}, {quoted}, -1)), parts -> {body}))"
    body = f"flatten(transform(array({hits}), hits -> {body}))"
    empty = "array()"
    return f"if({text} rlike {quoted}, transform({body}, x -> struct(x.start as start, x.ord as ord, x.stop as stop)), {empty})"


def _window_range() -> str:
    """SQL lambda body: from the characters ``a`` of a run to (first start, last stop) of windows at the threshold ``least``."""
    def count(ch: str, lo: str, n: str) -> str:
        return f"aggregate(slice(a, {lo} + 1, {n}), 0, (k, x) -> if(x = {ch}, k + 1, k))"

    leave = f"if(i < {WINDOW}, 0D, element_at({_PLOGP}, lc) - element_at({_PLOGP}, lc + 1))"
    enter = f"element_at({_PLOGP}, ec + 2) - element_at({_PLOGP}, ec + 1)"
    # lc: count of the leaving character in the window before; ec: of the entering one among those that stay
    lc = f"if(i < {WINDOW}, 1, {count(f'a[i - {WINDOW}]', f'i - {WINDOW}', str(WINDOW))})"
    ec = count("a[i]", f"greatest(0, i - {WINDOW - 1})", f"least(i, {WINDOW - 1})")
    moved = f"transform(array(struct({lc} as lc, {ec} as ec)), c -> s.plogp + {leave.replace('lc', 'c.lc')} + {enter.replace('ec', 'c.ec')})[0]"
    hot = f"i >= {WINDOW - 1} and {math.log2(WINDOW)!r}D - p / {WINDOW} >= least"
    step = (
        f"transform(array({moved}), p -> struct(p as plogp, if({hot} and s.lo < 0, i - {WINDOW - 1}, s.lo) as lo, if({hot}, i + 1, s.hi) as hi))[0]"
    )
    return f"aggregate(sequence(0, size(a) - 1), struct(0D as plogp, -1 as lo, -1 as hi), (s, i) -> {step})"


def _entropy_spans(text: str) -> str:
    """SQL for the spans of high entropy, before those inside base spans are taken out."""
    allowed = " or ".join(f"run rlike r'{p}'" for p in ALLOWED)
    least = "case " + " ".join(f"when run rlike r'{p}' then {t}D" for p, t in THRESHOLDS.items() if p) + f" else {THRESHOLDS['']}D end"
    runs = _spans(text, KEY_RUN, 3, 0, WINDOW)
    named = f"transform({runs}, x -> struct(x.start as start, x.stop as stop, substring({text}, int(x.start) + 1, int(x.stop - x.start)) as run))"
    likely = f"filter({named}, y -> y.run rlike '[0-9]' and y.run rlike '[A-Za-z]' and not ({allowed.replace('run ', 'y.run ')}))"
    window = _window_range().replace("least)", "y.least)").replace(">= least", ">= y.least")
    ranged = (
        f"transform({likely}, z -> transform(array(struct(z.start as start, split(z.run, '') as a, {least.replace('run ', 'z.run ')} as least)), "
        f"y -> transform(array(y.a), a -> struct(y.start as start, {window} as w))[0])[0])"
    )
    return f"transform(filter({ranged}, x -> x.w.lo >= 0), x -> struct(x.start + x.w.lo as start, 3 as ord, x.start + x.w.hi as stop))"


def _listed(spans: str) -> str:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return f"array_join(transform(sort_array({spans}), x -> concat({names}[x.ord], ':', x.start, ':', x.stop)), ',')"


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``base`` and ``added``: arrays of (start, ord, stop), ``ord`` counting in ``KINDS``.

    Starts and ends are code points, the end exclusive.
    """
    kind = "array<struct<start:bigint,ord:int,stop:bigint>>"
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_t"))
    found = rows.select(
        "doc_id",
        *[
            F.expr(f"cast({_spans('_t', p, k, group, least)} as {kind})").alias(f"_{KINDS[k]}")
            for k, (p, group, least) in enumerate(((ASSIGN, 2, 12), (ACCESS, 0, 18), (HEX, 0, 16)))
        ],
        F.expr(f"cast(if(_t rlike r'{KEY_RUN}', {_entropy_spans('_t')}, array()) as {kind})").alias("_entropy"),
    )
    base = F.sort_array(F.concat("_assign", "_access", "_hex"))
    outside = F.expr("filter(_entropy, e -> not exists(base, b -> b.start <= e.start and e.stop <= b.stop))")
    return found.select("doc_id", base.alias("base"), "_entropy").select("doc_id", "base", outside.alias("added"))


def report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` for every row."""
    counts: list[Column] = [F.expr(f"cast(size(filter(base, x -> x.ord = {k})) as bigint)").alias(f"n_{KINDS[k]}") for k in range(3)]
    return scan(docs).select(
        "doc_id", *counts, F.sha2(F.expr(_listed("base")).cast("binary"), 256).alias("base_sha256"), F.expr(_listed("concat(base, added)")).alias("spans")
    )
