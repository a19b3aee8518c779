"""Vocabularies: frequencies, prevalence filters, top-k, subsamples, membership."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vocabularies of up to this many tokens are broadcast; larger ones are joined as Spark plans it.
BROADCAST_TOKENS = 200_000
#: Hex digits of the digest that subsample() counts by.
DRAW_DIGITS = 4


def occurrences(tokens: DataFrame, by=("token",)) -> DataFrame:
    """How often each token occurs, repeats within a sample included."""
    return tokens.groupBy(*by).agg(F.count(F.lit(1)).alias("df"))


def document_frequency(tokens: DataFrame, by=("token",)) -> DataFrame:
    """In how many samples each token occurs; tokens: distinct (sample, token)."""
    return occurrences(tokens, by)


def absolute_bounds(n: int) -> tuple[int, int]:
    """One and ninety-nine hundredths of n, rounded half to even."""
    return round(n / 100), round(n * 99 / 100)


def relative_bounds(n: int, percent: float = 0.1) -> tuple[int, int]:
    """percent of n, and n less that, both cut to integers."""
    share = n * percent / 100
    return int(share), int(n - share)


def prevalent(frequencies: DataFrame, bounds: tuple[int, int]) -> DataFrame:
    """Strictly between the bounds."""
    return frequencies.where((F.col("df") > bounds[0]) & (F.col("df") < bounds[1]))


def top_share(frequencies: DataFrame, share: float = 0.0001) -> DataFrame:
    """The most frequent tokens: share times the vocabulary's size, cut to an integer; equal ones by token."""
    return top_k(frequencies, int(frequencies.count() * share))


def top_k(frequencies: DataFrame, k: int) -> DataFrame:
    return frequencies.orderBy(F.desc("df"), F.asc("token")).limit(k)


def subsample(rows: DataFrame, n: int, *, key: str, seed: int = 42) -> DataFrame:
    """n rows without replacement, the same on every run: the first in order of the md5 of key and seed. All of them if there are fewer.

    The rows are counted by the digest's first digits, from the key alone; of the buckets below the cut all rows stay where they are,
    and only the bucket that holds the cut is ordered. So no task holds n rows, and wide columns of the others never move.
    """
    draw = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}")).cast("binary"))
    bucket = F.conv(F.substring(draw, 1, DRAW_DIGITS), 16, 10).cast("int")
    below = 0
    for b, size in sorted(tuple(r) for r in rows.groupBy(bucket).count().collect()):  # 16 ** DRAW_DIGITS at most
        if below + size >= n:
            return rows.where(bucket < b).unionByName(rows.where(bucket == b).orderBy(draw, F.col(key)).limit(n - below))
        below += size
    return rows


def members(tokens: DataFrame, vocabulary: DataFrame, size: int | None = None, on=("token",)) -> DataFrame:
    """The tokens that are in the vocabulary; broadcast if it is known to be small."""
    known = vocabulary.select(*on)
    return tokens.join(F.broadcast(known) if size is not None and size <= BROADCAST_TOKENS else known, list(on), "left_semi")


def tfidf(tokens: DataFrame, frequencies: DataFrame, n: int) -> DataFrame:
    """tokens (sample, token, tf) with weight = ln(1 + tf) * ln(n / (1 + df)); absent tokens stay implicit zeros."""
    return tokens.join(frequencies, "token").withColumn("weight", F.ln(1.0 + F.col("tf")) * F.ln(F.lit(float(n)) / (1.0 + F.col("df"))))


def size_limit(files: DataFrame, megabytes: float, length: str = "length") -> DataFrame:
    return files.where(F.col(length) <= math.floor(megabytes * 1024 * 1024))
