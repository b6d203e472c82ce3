r"""Document quality by weak supervision, in DataFrame expressions alone.

Rules vote good (1), bad (-1) or abstain (0). Documents are counted by their
pattern of votes, at most 3 to the number of rules; on that table
expectation-maximisation estimates the share of good documents and how often
each rule votes which way on good and on bad ones. The posterior probability
that a document is good follows from its pattern and replaces the demand that
every rule be passed.

Words are runs without blanks. Base measures: ``word_chars`` (code points in
words), ``n_symbols`` (of ``#*$%&|<>``), ``n_dup_lines`` (lines with a word,
equal to an earlier line), ``n_repeat_words`` (words in a window of three that
the text holds twice or more). A text below ``min_words``, or with more than
half its words repeated, fails at once and takes no part in the estimate.

Defined cases: a null text has no words and fails; repeated rows count as
often as they occur; an empty table gives an empty result; if all documents
fail at once the estimate stays at its start; further columns are ignored.

Windows are compared by 64-bit hashes within one text.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acequia.llm.common import BLANKS, col
from acequia.session import materialize

MIN_WORDS = 50
WINDOW = 3
#: Rounds of expectation-maximisation stop at this change of the log-likelihood a document.
TOLERANCE = 1e-9
MOST_ROUNDS = 500
#: A vote's share is estimated as if it had been seen this often already.
PRIOR_VOTES = 2.0

# Frequent short words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that was for with on are as by this from or be an at "
    "der die und das den von zu mit sich des im ist auf für ein eine nicht dem "
    "le la les de et un une des en que qui dans pour par sur du au est avec "
    "el los las del y que una con se su al no es para por lo"
)


def repeated_words(words: Column) -> Column:
    """Words inside a window of ``WINDOW`` words that occurs more than once.

    Hashed windows are sorted with their places; a window is repeated if it
    equals its neighbour in that order. Each repeated start covers ``WINDOW``
    words, less what the next repeated start covers again. The work for a text
    of n words is that of sorting n numbers.
    """
    n = F.size(words) - (WINDOW - 1)
    hashed = F.transform(
        F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(
            F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]).alias("h"), i.alias("i")
        ),
    )
    return F.transform(F.array(F.sort_array(hashed)), _covered)[0]


def _covered(ordered: Column) -> Column:
    same = F.filter(
        ordered,
        lambda x, k: (x["h"] == F.get(ordered, k - 1)["h"]).eqNullSafe(F.lit(True))
        | (x["h"] == F.get(ordered, k + 1)["h"]).eqNullSafe(F.lit(True)),
    )
    starts = F.sort_array(F.transform(same, lambda x: x["i"]))
    # Each start adds its distance from the last one, at most the window's length.
    total = F.aggregate(
        starts,
        F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda acc, i: F.struct(
            (acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n"), i.alias("last")
        ),
        lambda acc: acc["n"],
    )
    return total.cast("long")


def measures(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Base measures, and those the rules need, of each document."""
    given = F.coalesce(col(text), F.lit(""))
    rows = docs.select(col(id).alias("id"), given.alias("text"))
    words = F.filter(F.split("text", f"{BLANKS}+"), lambda w: w != "")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{BLANKS[1:]}"))
    rows = rows.select("id", "text", words.alias("words"), lines.alias("lines"))

    def count(pattern: str) -> Column:
        return F.regexp_count("text", F.lit(pattern)).cast("long")

    stops = sorted(set(STOP_WORDS.split()))
    return rows.select(
        "id",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        count(r"[#*$%&|<>]").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        count(r"\p{Lu}").alias("n_upper"),
        F.char_length(F.regexp_replace("text", r"[^\p{L}]+", "")).cast("long").alias("n_letters"),
        count(r"!").alias("n_shouts"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(*stops))).cast("long").alias("n_stops"),
    )


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))


def rules() -> dict[str, Column]:
    """Votes from the measures. Each rule has a range it takes for good, one for bad, and abstains between."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    letters = F.greatest(F.col("n_letters"), F.lit(1))

    def share(a: str, b: Column) -> Column:
        return F.col(a) / b

    symbols, upper = share("n_symbols", words), share("n_upper", letters)
    shouts, repeats = share("n_shouts", words), share("n_repeat_words", words)
    lines = share("n_dup_lines", F.greatest(F.col("n_lines"), F.lit(1)))
    length, stops = share("word_chars", words), share("n_stops", words)
    letter_share = share("n_letters", F.greatest(F.col("word_chars"), F.lit(1)))
    return {
        "symbols": _vote(symbols < 0.05, symbols > 0.2),
        "upper": _vote(upper < 0.15, upper > 0.4),
        "shouts": _vote(shouts < 0.05, shouts > 0.2),
        "repeats": _vote(repeats < 0.1, repeats > 0.3),
        "lines": _vote(lines < 0.1, lines > 0.3),
        "length": _vote((length >= 3) & (length <= 10), (length < 2) | (length > 15)),
        "stops": _vote(stops > 0.1, stops < 0.01),
        "letters": _vote(letter_share > 0.85, letter_share < 0.6),
    }


def estimate(patterns: list[tuple[tuple[int, ...], int]], start: float = 0.8) -> tuple[float, list[dict]]:
    """Share of good documents, and each rule's vote shares on good and bad ones.

    ``patterns`` holds votes and their number of documents. The start takes a
    rule to vote rightly in ``start`` of its votes.
    """
    n_rules = len(patterns[0][0]) if patterns else 0
    total = sum(n for _, n in patterns)
    shares = []
    for r in range(n_rules):
        silent = (sum(n for v, n in patterns if v[r] == 0) + 1) / (total + 2)
        spoken = 1 - silent
        shares.append(
            {
                True: {1: start * spoken, -1: (1 - start) * spoken, 0: silent},
                False: {1: (1 - start) * spoken, -1: start * spoken, 0: silent},
            }
        )
    good, last, settled = 0.8, -math.inf, not total
    for _ in range(MOST_ROUNDS if total else 0):
        likelihood, right = 0.0, []
        for votes, n in patterns:
            a = math.log(good) + sum(math.log(s[True][v]) for s, v in zip(shares, votes, strict=True))
            b = math.log(1 - good) + sum(math.log(s[False][v]) for s, v in zip(shares, votes, strict=True))
            top = max(a, b)
            both = top + math.log(math.exp(a - top) + math.exp(b - top))
            likelihood += n * both
            right.append(math.exp(a - both))
        mass = sum(p * n for p, (_, n) in zip(right, patterns, strict=True))
        good = min(max((mass + 1) / (total + 2), 1e-6), 1 - 1e-6)
        for r, s in enumerate(shares):
            for kind in (True, False):
                weight = mass if kind else total - mass
                for vote in (1, -1, 0):
                    own = sum(
                        (p if kind else 1 - p) * n
                        for p, (v, n) in zip(right, patterns, strict=True)
                        if v[r] == vote
                    )
                    s[kind][vote] = (own + PRIOR_VOTES / 3) / (weight + PRIOR_VOTES)
        if abs(likelihood - last) < TOLERANCE * total:
            settled = True
            break
        last = likelihood
    if not settled:
        warnings.warn(f"the estimate still moved after {MOST_ROUNDS} rounds", stacklevel=2)
    return good, shares


def _posterior(good: float, shares: list[dict], votes: list[Column]) -> Column:
    logit = F.lit(math.log(good / (1 - good)))
    for s, vote in zip(shares, votes, strict=True):
        step = {v: math.log(s[True][v] / s[False][v]) for v in (1, -1, 0)}
        logit = logit + F.when(vote == 1, step[1]).when(vote == -1, step[-1]).otherwise(step[0])
    return 1 / (1 + F.exp(-logit))


def judge(
    docs: DataFrame,
    *,
    id: str = "doc_id",
    text: str = "text",
    min_words: int = MIN_WORDS,
    threshold: float = 0.5,
) -> DataFrame:
    """Measures, posterior quality and verdict of each document.

    The measures, a few numbers a document, are written to the shared folder:
    the estimate and the verdict both read them.
    """
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    made = measures(docs, id=id, text=text)
    named = rules()
    base = materialize(
        made.select("*", failed.alias("base_failed"), *[v.alias(f"vote_{n}") for n, v in named.items()]),
        "quality",
    )
    votes = [F.col(f"vote_{n}") for n in named]
    # At most 3 ** len(rules) rows, whatever the input.
    patterns = base.where("not base_failed").groupBy(*votes).count().collect()
    good, shares = estimate(sorted((tuple(r[:-1]), r[-1]) for r in patterns))
    if not shares:
        quality = F.lit(0.0)
    else:
        quality = _posterior(good, shares, votes)
    return base.withColumn("quality", quality).withColumn(
        "kept", ~F.col("base_failed") & (F.col("quality") >= threshold)
    )
