"""From selected tokens to one row per sample, and the wide view."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vocabulary import BROADCAST_TOKENS


def _numbered(tokens: DataFrame, words: list) -> DataFrame:
    """The tokens that are in the vocabulary, with their places in it. The vocabulary is broadcast up to BROADCAST_TOKENS words."""
    kind = tokens.schema["token"].dataType.simpleString()
    known = tokens.sparkSession.createDataFrame([(bytearray(w) if isinstance(w, bytes) else w, k) for k, w in enumerate(words)], f"token {kind}, _at int")
    return tokens.join(F.broadcast(known) if len(words) <= BROADCAST_TOKENS else known, "token")


def _filled(places: Column, size: int, default: Column, value) -> Column:
    """An array of `size` defaults with value(p) at each of the ascending places p, in one pass: gaps and values by turns."""
    at = lambda p: p["_at"]
    before = lambda i: F.when(i > 0, at(F.get(places, i - 1))).otherwise(F.lit(-1))
    parts = F.flatten(F.transform(places, lambda p, i: F.concat(F.array_repeat(default, at(p) - before(i) - 1), F.array(value(p)))))
    return F.concat(parts, F.array_repeat(default, F.lit(size) - 1 - F.coalesce(at(F.try_element_at(places, F.lit(-1))), F.lit(-1))))


def _padded(samples: DataFrame, hits: DataFrame, size: int, default: Column, value, sample: str, out: str) -> DataFrame:
    own = hits.groupBy(sample).agg(F.array_sort(F.collect_set(F.struct("_at", *[c for c in hits.columns if c not in ("_at", "token", sample)]))).alias("_hits"))
    filled = F.when(F.col("_hits").isNull(), F.array_repeat(default, size)).otherwise(_filled(F.col("_hits"), size, default, value))
    return samples.join(own, sample, "left").withColumn(out, filled).drop("_hits")


def pad_presence(samples: DataFrame, tokens: DataFrame, vocabulary: list, *, sample: str, out: str = "features") -> DataFrame:
    """samples with an array of booleans, one for each vocabulary token in order; samples without tokens are all false.

    Tokens outside of the (selected) vocabulary go before the shuffle; a row costs its hits and the array's length.
    """
    words = sorted(vocabulary)
    if not words:
        return samples.withColumn(out, F.array().cast("array<boolean>"))
    hits = _numbered(tokens.select(sample, "token"), words)
    return _padded(samples, hits, len(words), F.lit(False), lambda p: F.lit(True), sample, out)


def pad_weights(samples: DataFrame, weights: DataFrame, vocabulary: list, *, sample: str, out: str = "weights") -> DataFrame:
    """samples with an array of doubles, one for each vocabulary token in order; absent tokens weigh 0. weights: (sample, token, weight), one each."""
    words = sorted(vocabulary)
    if not words:
        return samples.withColumn(out, F.array().cast("array<double>"))
    hits = _numbered(weights.select(sample, "token", "weight"), words)
    return _padded(samples, hits, len(words), F.lit(0.0), lambda p: p["weight"], sample, out)


def bits_text(flags: Column) -> Column:
    return F.array_join(F.transform(flags, lambda x: F.when(x, F.lit("1")).otherwise(F.lit("0"))), "")


def column_name(prefix: str, token: str | bytes) -> str:
    """A name that Spark tells apart from others: bytes as hex; capitals marked, as names ignore case."""
    if isinstance(token, bytes):
        return f"{prefix}{token.hex()}"
    return prefix + re.sub("[A-Z]", lambda m: f"^{m[0].lower()}", token.replace("^", "^^").replace("`", "^'").replace(".", "^,"))


def wide(frame: DataFrame, arrays: dict[str, tuple[str, list]]) -> DataFrame:
    """One column for each feature. arrays: array column -> (prefix, sorted vocabulary)."""
    out = [F.col(f"`{c}`") for c in frame.columns if c not in arrays]
    for name, (prefix, words) in arrays.items():
        out += [F.get(F.col(name), i).alias(column_name(prefix, w)) for i, w in enumerate(sorted(words))]
    return frame.select(*out)
