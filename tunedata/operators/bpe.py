"""Subword counts: byte-pair merges learned on the corpus, as token counts closer to a tokenizer's than words.

Learning runs on the table of distinct words, counted once with map-side combine. Each round counts the adjacent pairs of
symbols, takes the most frequent ones that have no symbol in common, and rewrites the words. Such pairs cannot
touch each other, so a round of sixteen merges costs one pass instead of sixteen. Encoding applies the merges in the
order in which they were learned."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunedata.functions.text import whitespace_tokens
from tunedata.operators.keyfilter import written

MERGES = 128
PER_ROUND = 16
#: Pairs of the ranking that a round looks through for those without a common symbol.
RANKED = 256
#: Words that a task remembers the counts of before it starts anew.
MEMO = 200_000
# Marks around a symbol. Texts lose these two control characters before they are cut.
OPEN, CLOSE = "\x02", "\x03"


def _wrapped(word: Column) -> Column:
    """Each character as a symbol of its own, between marks."""
    chars = F.split(F.translate(word, OPEN + CLOSE, "��"), "")
    return F.array_join(F.transform(chars, lambda c: F.concat(F.lit(OPEN), c, F.lit(CLOSE))), "")


def word_counts(df: DataFrame, text: str) -> DataFrame:
    """``word, n`` of the corpus; words are cut at white space."""
    words = df.select(F.explode(whitespace_tokens(F.coalesce(F.col(text), F.lit("")))).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def pair_counts(words: DataFrame) -> DataFrame:
    """``left, right, n`` over the words' adjacent symbols, weighted by how often a word occurs."""
    symbols = F.split(F.expr("substring(symbols, 2, length(symbols) - 2)"), CLOSE + OPEN)
    pairs = words.select("n", symbols.alias("s")).where(F.size("s") > 1).select(
        "n", F.explode(F.arrays_zip(F.slice("s", F.lit(1), F.size("s") - 1).alias("left"), F.slice("s", F.lit(2), F.size("s") - 1).alias("right"))).alias("p"))
    return pairs.groupBy("p.left", "p.right").agg(F.sum("n").alias("n"))


def choose(ranked: list[tuple[str, str]], limit: int) -> list[tuple[str, str]]:
    """The first pairs of the ranking that share no symbol with one taken before, nor make one of its symbols."""
    used: set[str] = set()
    taken = []
    for a, b in ranked:
        if len(taken) < limit and not {a, b, a + b} & used:
            taken.append((a, b))
            used |= {a, b, a + b}
    return taken


def _merge_text(a: str, b: str) -> tuple[str, str]:
    return f"{OPEN}{a}{CLOSE}{OPEN}{b}{CLOSE}", f"{OPEN}{a + b}{CLOSE}"


def learn_merges(df: DataFrame, text: str, merges: int = MERGES, per_round: int = PER_ROUND, least: int = 2) -> list[tuple[str, str]]:
    """``merges`` pairs (fewer where the corpus has no pair ``least`` times left), in the order to apply them.

    Ties of frequency go by the symbols' names. Only the ranking's first ``RANKED`` pairs of a round reach the driver.
    Null and empty texts have no words; an empty corpus gives no merges."""
    words = written(word_counts(df, text).select(_wrapped(F.col("word")).alias("symbols"), "n"), "bpe-words")
    found: list[tuple[str, str]] = []
    while len(found) < merges:
        top = pair_counts(words).where(F.col("n") >= least).orderBy(F.desc("n"), "left", "right").limit(RANKED).collect()
        taken = choose([(r["left"], r["right"]) for r in top], min(per_round, merges - len(found)))
        if not taken:
            break
        found += taken
        symbols = F.col("symbols")
        for a, b in taken:
            before, after = _merge_text(a, b)
            symbols = F.replace(symbols, F.lit(before), F.lit(after))
        words = written(words.select(symbols.alias("symbols"), "n"), "bpe-words")
    return found


def word_counter(merges: list[tuple[str, str]]) -> Callable[[str], int]:
    """Tokens of one word, remembered for ``MEMO`` words at a time: most words of a text are old ones."""
    steps = [_merge_text(a, b) for a, b in merges]
    memo: dict[str, int] = {}

    def count(word: str) -> int:
        n = memo.get(word)
        if n is None:
            s = "".join(OPEN + c + CLOSE for c in word.replace(OPEN, "�").replace(CLOSE, "�"))
            for before, after in steps:
                if before in s:
                    s = s.replace(before, after)
            n = s.count(OPEN)
            if len(memo) >= MEMO:
                memo.clear()
            memo[word] = n
        return n

    return count


def token_counter(merges: list[tuple[str, str]]) -> Callable[[pd.Series], pd.Series]:
    """A counter for the token-counter hook: whole texts in Arrow batches, the few merges go with the tasks."""
    def counter(texts: pd.Series) -> pd.Series:
        count = word_counter(merges)
        return texts.map(lambda t: sum(map(count, t.split())))

    return counter


def token_column(merges: list[tuple[str, str]], text: str) -> Column:
    """Token counts as a column; null texts count 0."""
    from tunedata.operators.ext import token_counter as hook

    return hook(token_counter(merges))(F.col(text))
