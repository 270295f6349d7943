"""Weakly supervised document quality: rules vote or abstain, EM weighs them.

Everything is DataFrame and SQL expressions.  One narrow pass gives per document the figures the
rules read.  Each rule votes good (1), bad (-1) or abstains (0).  Documents are reduced to
the distinct vote vectors and their counts, at most ``3 ^ rules`` rows whatever the input, and
expectation-maximisation runs on those: a vote of a rule is wrong or right at rates that differ for
good and bad documents, abstaining says nothing.  The posterior probability of being good decides,
instead of all rules having to pass.

Null and blank texts have no words, fail the base rule (fewer than 50 words) and are not kept.
Repeated rows and equal ids are judged row by row; without rows the result is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import SPACE, words
from ridgeline.staging import stage

#: rule name: (bad if, good if), over the figures of ``figures``; neither: abstains.
RULES: dict[str, tuple[str, str]] = {
    "repeats": ("100 * n_repeat_words > 40 * n_words", "100 * n_repeat_words <= 5 * n_words"),
    "lines": ("100 * n_dup_lines > 60 * n_lines", "n_dup_lines = 0"),
    "symbols": ("10 * n_symbols > n_words", "100 * n_symbols <= n_words"),
    "symbol_ends": ("10 * n_symbol_ends > n_words", "100 * n_symbol_ends <= n_words"),
    "plain_words": ("100 * n_plain_words < 70 * n_words", "100 * n_plain_words >= 90 * n_words"),
    "word_length": ("word_chars < 2.5 * n_words or word_chars > 12 * n_words", "word_chars between 3.5 * n_words and 9 * n_words"),
    "capitals": ("100 * n_capitals > 30 * word_chars", "100 * n_capitals <= 10 * word_chars"),
    "exclamations": ("20 * n_exclamations > n_words", "100 * n_exclamations <= n_words"),
    "length": ("n_words < 50", "n_words >= 200"),
}
#: Words that end in a symbol; words of letters with at most one mark of punctuation behind.
SYMBOL_END = r"[#*$%&|<>](?![^\x20\x09-\x0D])"
PLAIN_WORD = r"(?<![^\x20\x09-\x0D])\p{L}++(?:['’-]\p{L}++)?[.,;:!?)]?(?![^\x20\x09-\x0D])"

def figures(docs: DataFrame, carry: Column | None = None) -> DataFrame:
    """Counts over the whole text, beside ``row``: the id, or what ``carry`` gives.

    Words in repeated windows: the hashed windows of three words are sorted together with their
    positions, those equal to a neighbour are repeated, and the words they cover are counted once.
    """
    text = F.coalesce("_text", F.lit(""))
    carried = F.struct("doc_id") if carry is None else carry
    rows = docs.select(carried.alias("row"), F.col("text").cast("string").alias("_text"))
    filled = F.expr(r"filter(split(coalesce(_text, ''), '\n', -1), l -> btrim(l, ' \t\n\u000b\f\r') != '')")
    rows = rows.select(
        "row",
        words(F.col("_text")).alias("_w"),
        filled.alias("_lines"),
        (F.char_length(text) - F.regexp_count(text, F.lit(SPACE))).cast("bigint").alias("word_chars"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).cast("bigint").alias("n_capitals"),
        F.regexp_count(text, F.lit("!")).cast("bigint").alias("n_exclamations"),
        F.regexp_count(text, F.lit(SYMBOL_END)).cast("bigint").alias("n_symbol_ends"),
        F.regexp_count(text, F.lit(PLAIN_WORD)).cast("bigint").alias("n_plain_words"),
    )
    counts = ["row", "word_chars", "n_symbols", "n_capitals", "n_exclamations", "n_symbol_ends", "n_plain_words"]
    windows = F.expr(
        "if(size(_w) < 3, array(), sort_array(transform(sequence(0, size(_w) - 3), i -> struct(xxhash64(_w[i], _w[i + 1], _w[i + 2]) as h, i as p))))"
    )
    rows = rows.select(
        *counts,
        F.size("_w").cast("bigint").alias("n_words"),
        F.size("_lines").cast("bigint").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        windows.alias("_sorted"),
    )
    counts += ["n_words", "n_lines", "n_dup_lines"]
    repeated = F.expr(
        "filter(_sorted, (x, i) -> (i > 0 and _sorted[i - 1].h = x.h) or (i < size(_sorted) - 1 and _sorted[i + 1].h = x.h))"
    )
    covered = F.expr(
        "aggregate(sort_array(_repeated.p), struct(0L as n, 0 as upto), (s, p) -> struct(s.n + p + 3 - greatest(p, s.upto) as n, p + 3 as upto), s -> s.n)"
    )
    return rows.select(*counts, repeated.alias("_repeated")).select(*counts, covered.alias("n_repeat_words"))


def votes(rules: dict[str, tuple[str, str]] = RULES) -> Column:
    """Array of votes in the order of the rules."""
    return F.array(*[F.when(F.expr(bad), -1).when(F.expr(good), 1).otherwise(0) for bad, good in rules.values()])


#: Prior votes (bad, all): a rule rarely speaks against a good document, and against about
#: every second bad one.  They keep small inputs sane and vanish in large ones.
WRONG, CAUGHT = (0.5, 50.0), (10.0, 20.0)

#: Log odds of being good for votes ``v`` under a model ``m``.
_LOG_ODDS = """aggregate(sequence(0, size({v}) - 1), ln({m}.prior / (1 - {m}.prior)), (s, j) -> s + case {v}[j]
  when -1 then ln({m}.wrong[j] / {m}.caught[j]) when 1 then ln((1 - {m}.wrong[j]) / (1 - {m}.caught[j])) else 0D end)"""


def posterior(v: str, m: str) -> str:
    """SQL for the probability of being good."""
    return f"1 / (1 + exp(-({_LOG_ODDS.format(v=v, m=m)})))"


def _rate(weight: str, hits: float, all_: float) -> str:
    """SQL for the rate of bad votes of each rule under the posterior weights, with a prior of ``hits`` in ``all_`` votes."""
    total = f"aggregate(e, 0D, (s, x) -> s + if(x.v[j] {{}}, x.n * {weight}, 0D))"
    return f"transform(sequence(0, rules - 1), j -> ({total.format('= -1')} + {hits}D) / ({total.format('<> 0')} + {all_}D))"


def fit(voted: DataFrame, *, rounds: int = 50, prior: float = 0.8) -> DataFrame:
    """One row ``model``: prior of good, rates of bad votes on good (``wrong``) and bad (``caught``) documents.

    ``voted`` has the column ``votes``, null where a document has no say.  The rounds are folded over the array of distinct vote
    vectors, so they cost one small expression and no job each.
    """
    seen = voted.groupBy("votes").count()
    listed = F.collect_list(F.struct(F.col("votes").alias("v"), F.col("count").alias("n")))
    # no where(): a filter would be pushed below the figures and repeat them for each use
    table = seen.agg(F.sort_array(F.filter(listed, lambda x: x["v"].isNotNull())).alias("seen"))
    table = table.withColumn("rules", F.coalesce(F.size(F.get(F.col("seen"), F.lit(0))["v"]), F.lit(1)))
    expected = f"transform(seen, x -> struct(x.v as v, x.n as n, {posterior('x.v', 'm')} as q))"
    prior_next = "(aggregate(e, 0D, (s, x) -> s + x.n * x.q) + 1D) / (aggregate(e, 0D, (s, x) -> s + x.n) + 2D)"
    step = f"transform(array({expected}), e -> struct({prior_next} as prior, {_rate('x.q', *WRONG)} as wrong, {_rate('(1 - x.q)', *CAUGHT)} as caught))[0]"
    start = f"struct({prior}D as prior, array_repeat(0.05D, rules) as wrong, array_repeat(0.5D, rules) as caught)"
    return table.select(F.expr(f"aggregate(sequence(1, {rounds}), {start}, (m, i) -> {step})").alias("model"))


def judge(docs: DataFrame, *, keep_from: float = 0.5, rounds: int = 50) -> DataFrame:
    """``doc_id``, the figures, ``base_failed``, ``kept``, the votes and ``probability`` for every row."""
    counted = stage(figures(docs), "figures").withColumn("votes", votes())
    scored = _scored(counted, fit(counted.select(F.when(~F.expr(BASE), F.col("votes")).alias("votes")), rounds=rounds), keep_from)
    return scored.select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", F.expr(BASE).alias("base_failed"), "kept", "votes", "probability"
    )


BASE = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"


def _scored(counted: DataFrame, model: DataFrame, keep_from: float) -> DataFrame:
    scored = counted.crossJoin(F.broadcast(model)).withColumn("probability", F.expr(posterior("votes", "model")))  # one row
    return scored.withColumn("kept", F.expr(f"not ({BASE})") & (F.col("probability") >= keep_from))


def keep_good(docs: DataFrame, *, keep_from: float = 0.5, rounds: int = 50) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with their columns.

    The model comes from a first pass; a second computes the figures beside each row and filters
    in place, so equal ids cannot be confused and no text is shuffled or written.
    """
    counted = figures(docs, F.struct(*docs.columns)).withColumn("votes", votes())
    model = stage(fit(counted.select(F.when(~F.expr(BASE), F.col("votes")).alias("votes")), rounds=rounds), "quality-model")
    scored = _scored(counted, model, keep_from)
    # a filter would be pushed below and repeat the costly figures for each use; a generator stays where it is
    chosen = scored.select(F.explode_outer(F.expr("if(kept, array(row), array())")).alias("row"))
    return chosen.where("row is not null").select("row.*")
