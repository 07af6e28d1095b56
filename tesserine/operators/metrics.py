"""Text generation metrics: ROUGE-1, -2, -L and BLEU, over token lists."""

from __future__ import annotations

from collections import Counter
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..plugins import Scorer


def tokens(c: Column | str) -> Column:
    """Runs of letters and digits in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def ngrams(words: Column, n: int) -> Column:
    """Runs of n words, by zipping the list with itself shifted: a lambda that looked into the list would compute it anew each time."""
    if n == 1:
        return words
    count = F.greatest(F.size(words) - (n - 1), F.lit(0))
    return F.zip_with(F.slice(ngrams(words, n - 1), 1, count), F.slice(words, n, count), lambda a, b: F.concat(a, F.lit(" "), b))


def f_measure(hits: Column, found: Column, wanted: Column) -> Column:
    p, r = hits / found, hits / wanted
    return F.when((hits == 0) | (found == 0) | (wanted == 0), 0.0).otherwise(2 * p * r / (p + r))


def overlap(df: DataFrame, keys: list[str], a: Column, b: Column, sizes: tuple[int, ...]) -> DataFrame:
    """keys, n, hits, found, wanted: for each size the n-grams that two token lists share, as often as both have them, and have.

    n-grams become rows and meet by a grouped count, so long texts cost no more than their length.
    """

    def marked(words: Column, n: int, mine: int) -> Column:
        return F.transform(ngrams(words, n), lambda g: F.struct(F.lit(n).alias("n"), F.lit(mine).alias("mine"), g.alias("g")))

    every = F.flatten(F.array(*(marked(words, n, mine) for words, mine in ((a, 1), (b, 0)) for n in sizes)))
    sides = df.select(*keys, F.explode(every).alias("x")).select(*keys, "x.*")
    counted = sides.groupBy(*keys, "n", "g").agg(F.sum("mine").alias("p"), F.sum(1 - F.col("mine")).alias("r"))
    return counted.groupBy(*keys, "n").agg(F.sum(F.least("p", "r")).alias("hits"), F.sum("p").alias("found"), F.sum("r").alias("wanted"))


def rouge_n(df: DataFrame, keys: list[str], prediction: str, reference: str, sizes: tuple[int, ...] = (1, 2)) -> DataFrame:
    """keys and rouge1, rouge2, ... of each row; 0 where either text has no such n-gram."""
    met = overlap(df, keys, tokens(prediction), tokens(reference), sizes)
    scored = met.groupBy(*keys).agg(*(F.max(F.when(F.col("n") == n, f_measure(F.col("hits"), F.col("found"), F.col("wanted")))).alias(f"rouge{n}") for n in sizes))
    return df.select(*keys).join(scored, keys, "left").fillna(0.0, [f"rouge{n}" for n in sizes])


def longest_common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a bit for each item of the second list."""
    at: dict[str, int] = {}
    for i, x in enumerate(b):
        at[x] = at.get(x, 0) | (1 << i)
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        hit = row & at.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(b) - row.bit_count()


def rouge_l(prediction: Column, reference: Column) -> Column:
    """ROUGE-L of two texts. A subsequence is beyond the built-in functions, so batches of token lists go through Python."""

    def lengths(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([longest_common(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype="int64")

    a, b = tokens(prediction), tokens(reference)
    return f_measure(F.pandas_udf(lengths, "long")(a, b), F.size(a), F.size(b))


def clipped(a: list[str], b: list[str], most: int) -> list[int]:
    """hits, found and wanted of two token lists, for each size of n-grams in turn."""
    out: list[int] = []
    for n in range(1, most + 1):
        x, y = (Counter(zip(*(words[i:] for i in range(n)), strict=False)) for words in (a, b))
        out += [sum(min(c, y[g]) for g, c in x.items() if g in y), x.total(), y.total()]
    return out


def corpus_bleu(df: DataFrame, prediction: str, reference: str, *, most: int = 4) -> DataFrame:
    """One row, bleu: clipped n-gram precisions of the corpus and its brevity penalty, 0 if any precision is.

    A row's n-grams are counted where the row is, by a helper, so only sums are shuffled.
    """
    sizes = tuple(range(1, most + 1))

    def counts(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([clipped(list(x), list(y), most) for x, y in zip(a, b, strict=True)], dtype="object")

    met = df.select(F.pandas_udf(counts, "array<long>")(T.words_of(T.normalize_spaces(prediction)), T.words_of(T.normalize_spaces(reference))).alias("c"))
    sums = met.agg(*(F.sum(F.element_at("c", 3 * (n - 1) + i)).alias(f"{c}{n}") for n in sizes for i, c in enumerate(("hits", "found", "wanted"), 1)))
    logs = reduce(lambda a, b: a + b, (F.log(F.col(f"hits{n}") / F.col(f"found{n}")) for n in sizes))
    some = reduce(lambda a, b: a & b, (F.coalesce(F.col(f"hits{n}") > 0, F.lit(False)) for n in sizes))
    penalty = F.when(F.col("found1") >= F.col("wanted1"), 1.0).otherwise(F.exp(1 - F.col("wanted1") / F.col("found1")))
    return sums.select(F.round(F.when(some, penalty * F.exp(logs / most)).otherwise(0.0), 4).alias("bleu"))


def corpus_rouge(df: DataFrame, prediction: str, reference: str) -> DataFrame:
    """One row of means: rouge1, rouge2, rougeL."""
    keyed = df.withColumn("_row", F.monotonically_increasing_id())
    each = rouge_n(keyed, ["_row"], prediction, reference).join(keyed.select("_row", rouge_l(F.col(prediction), F.col(reference)).alias("rougeL")), "_row")
    return each.agg(*(F.round(F.avg(c), 4).alias(c) for c in ("rouge1", "rouge2", "rougeL")))


def model_scores(df: DataFrame, prediction: str, reference: str, scorer: Scorer) -> DataFrame:
    """One row of a plugged-in scorer's means: precision, recall, f1; 0 for no rows."""
    each = scorer.score(df.select(prediction, reference), prediction, reference)
    return each.agg(*(F.round(F.coalesce(F.avg(c), F.lit(0.0)), 4).alias(c) for c in ("precision", "recall", "f1")))


def align(predictions: DataFrame, references: DataFrame, *, by: str = "row_index") -> DataFrame:
    """by, prediction, reference: rows of the same number in both tables."""
    return predictions.select(by, "prediction").join(references.select(by, "reference"), by)


def compare_runs(runs: dict[str, DataFrame], metrics: list[str]) -> DataFrame:
    """One row per run with the same metrics; what a run lacks is 0."""
    each = [df.select(F.lit(name).alias("run"), *(F.coalesce(F.col(m), F.lit(0.0)).alias(m) if m in df.columns else F.lit(0.0).alias(m) for m in metrics)) for name, df in runs.items()]
    return reduce(DataFrame.unionByName, each)
