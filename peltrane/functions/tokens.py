"""From a sample's bytes or sequence to tokens, as long relations (sample, ..., token)."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scalars import strip

NGRAM_SIZES = (4, 6)
SEQUENCE_MAX = 3
PRINTABLE_RUN = r"[\t\x20-\x7e]{4,}"


def byte_entropy_function():
    """Entropy as an Arrow UDF: a histogram of each file in bounded memory; also for spark.udf.register."""

    def entropy(s: pd.Series) -> pd.Series:
        out = np.zeros(len(s))
        for i, x in enumerate(s):
            if x:
                c = np.bincount(np.frombuffer(x, dtype=np.uint8))
                c = c[c > 0]
                out[i] = max(0.0, np.log2(len(x)) - float((c * np.log2(c)).sum()) / len(x))
        return pd.Series(out)

    return F.pandas_udf(entropy, "double")


def byte_entropy(content: Column) -> Column:
    """Shannon entropy of the bytes in bits; 0 for no bytes or null."""
    return byte_entropy_function()(content)


def printable_strings(text: Column) -> Column:
    """Distinct runs of four or more printable characters, stripped, of which more than three are left."""
    runs = F.transform(F.regexp_extract_all(text, F.lit(PRINTABLE_RUN), F.lit(0)), strip)
    return F.array_distinct(F.filter(runs, lambda s: F.length(s) > 3))


def string_tokens(samples: DataFrame, *, sample: str, content: str) -> DataFrame:
    """(sample, token) distinct: the printable strings of bytes."""
    return samples.select(sample, F.explode(printable_strings(F.decode(F.col(content), "ISO-8859-1"))).alias("token"))


def gram_starts(length: int, size: int, include_last: bool = False) -> int:
    """How many n-grams of a size a file has. Four-byte grams leave the last one out, as do all shorter ones, six-byte ones don't."""
    return max(0, length - size + (1 if include_last or size > 4 else 0))


def _wide(data: bytes, size: int, include_last: bool) -> np.ndarray:
    """The distinct n-grams of up to eight bytes in order, as numbers."""
    n = gram_starts(len(data), size, include_last)
    wide = np.zeros(n, dtype=np.uint64)
    flat = np.frombuffer(data, dtype=np.uint8)
    for k in range(size if n else 0):
        wide = (wide << np.uint64(8)) | flat[k : k + n]
    return np.unique(wide)


def _grams(data: bytes, size: int, include_last: bool, known: np.ndarray | None = None) -> np.ndarray:
    """The distinct n-grams in order, as rows of bytes; with known (sorted numbers, or rows as bytes), those among them."""
    if size > 8:
        n = gram_starts(len(data), size, include_last)
        if not n:
            return np.zeros((0, size), dtype=np.uint8)
        rows = np.unique(np.lib.stride_tricks.sliding_window_view(np.frombuffer(data, dtype=np.uint8), size)[:n], axis=0)
        return rows if known is None else rows[np.isin(rows.view(f"V{size}").ravel(), known)]
    wide = _wide(data, size, include_last)
    if known is not None:
        at = np.searchsorted(wide, known)
        at[at == len(wide)] = 0
        wide = known[wide[at] == known] if len(wide) else wide
    return wide.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - size :]


def byte_ngrams(samples: DataFrame, *, sample: str, content: str, sizes=NGRAM_SIZES, include_last: bool = False, carry: tuple[str, ...] = (), only: list[bytes] | None = None) -> DataFrame:
    """(sample, carried columns, size, token binary) distinct. A sample is one row, so its distinct tokens need no shuffle.

    only: a selected vocabulary; other n-grams then never leave the worker.
    """
    own = [sample, *carry]
    rows = samples.select(content, *own)
    known: dict[int, np.ndarray | None] = dict.fromkeys(sizes)
    if only is not None:
        for size in sizes:
            words = sorted({w for w in only if len(w) == size})
            known[size] = np.array([int.from_bytes(w, "big") for w in words], dtype=np.uint64) if size <= 8 else np.array(words, dtype=f"V{size}")

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                data = b.column(0)[i].as_py() or b""
                for size in sizes:
                    grams = _grams(data, size, include_last, known[size])
                    for at in range(0, len(grams), 1 << 20):
                        part = np.ascontiguousarray(grams[at : at + (1 << 20)])
                        offsets = np.arange(0, part.size + 1, size, dtype=np.int32)
                        token = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(offsets), pa.py_buffer(part)])
                        beside = [pa.repeat(b.column(k + 1)[i], len(part)) for k in range(len(own))]
                        yield pa.RecordBatch.from_arrays([*beside, pa.array(np.full(len(part), size, np.int32)), token], names=[*own, "size", "token"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in own) + ", size int, token binary")


def sequence_ngrams(sequences: DataFrame, *, sample: str, items: str, longest: int = SEQUENCE_MAX, include_last: bool = False) -> DataFrame:
    """(sample, token, tf): n-grams of 1 to `longest` items joined by blanks. The last n-gram of each size is left out."""
    words, spare = F.col(items), 0 if include_last else 1

    def of(n: int) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.size(words) - n + 1 - spare), lambda i: F.array_join(F.slice(words, i, n), " "))
        return F.when(F.size(words) >= n + spare, grams).otherwise(F.array().cast("array<string>"))

    lists = [of(n) for n in range(1, longest + 1)]
    return sequences.select(sample, F.explode(F.concat(*lists)).alias("token")).groupBy(sample, "token").agg(F.count(F.lit(1)).alias("tf"))


def row_ngrams(rows: DataFrame, *, sample: str, order: list[str], item: str, longest: int = SEQUENCE_MAX, include_last: bool = False) -> DataFrame:
    """(sample, token, tf) as sequence_ngrams(), of items that are rows: a window, so no sample's rows are gathered in memory."""
    w = Window.partitionBy(sample).orderBy(*order)
    word = F.coalesce(F.col(item).cast("string"), F.lit(""))
    steps = rows.select(sample, *[F.lead(word, k).over(w).alias(f"_w{k}") if k else word.alias("_w0") for k in range(longest)], *[F.lead(F.lit(True), k).over(w).alias(f"_more{k}") for k in range(1, longest + 1)])
    grams = []
    for n in range(1, longest + 1):
        after = n - 1 if include_last else n  # how many rows must follow
        gram = F.concat_ws(" ", *[F.col(f"_w{k}") for k in range(n)])
        grams.append(F.when(F.col(f"_more{after}"), gram) if after else gram)
    return steps.select(sample, F.explode(F.array_compact(F.array(*grams))).alias("token")).groupBy(sample, "token").agg(F.count(F.lit(1)).alias("tf"))
