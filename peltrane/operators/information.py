"""Information gain of tokens about labels, from contingency counts; no dense matrix of tokens by samples.

With f(x) = x log2 x, n samples, n_y of class y, and c_vy samples of class y with value v of a token (v = 0: absent, implicit):
  IG = H(y) + (1 / n) sum over v of (sum over y of f(c_vy) - f(n_v)).
The absent value's counts are n_y less the present ones; classes in which a token never occurs add f(n_y), so the sum over
classes is that of all f(n_y) corrected only where the token occurs. Work grows with the pairs, not with tokens times
classes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _f(x: Column) -> Column:
    return F.when(x > 0, x * F.log2(x.cast("double"))).otherwise(F.lit(0.0))


class Classes:
    """The labels' class sizes (label -> samples), few enough for the driver, and what follows from them."""

    def __init__(self, labels: DataFrame, label: str):
        self.sizes = labels.groupBy(F.col(label).alias("_y")).agg(F.count(F.lit(1)).alias("_ny"))
        total = self.sizes.agg(F.sum("_ny").alias("n"), F.sum(_f(F.col("_ny"))).alias("fy")).first()
        self.n, self.fy = total["n"] or 0, total["fy"] or 0.0
        self.entropy = math.log2(self.n) - self.fy / self.n if self.n else 0.0

    def sums(self, cells: DataFrame, by: list[str]) -> DataFrame:
        """cells (by, _y, _c) to (by, _n1, _f1, _f0): per token its samples, and f over present and corrected absent counts."""
        rest = F.col("_ny") - F.col("_c")
        joined = cells.join(self.sizes, "_y")
        return joined.groupBy(*by).agg(F.sum("_c").alias("_n1"), F.sum(_f(F.col("_c"))).alias("_f1"), F.sum(_f(rest) - _f(F.col("_ny"))).alias("_f0"))

    def gain(self, present: Column, base: float) -> Column:
        """The gain of a row of sums(); present: sum over the present values of f(c) less f of their totals."""
        absent = F.lit(self.fy) + F.col("_f0") - _f(F.lit(self.n) - F.col("_n1"))
        bits = F.lit(self.entropy) + (present + absent) / F.lit(float(max(self.n, 1)))
        return F.greatest(F.lit(0.0), bits / F.lit(math.log2(base)))


def labelled_gain(tokens: DataFrame, labels: DataFrame, *, label: str, by=("token",), bounds: tuple[int, int] | None = None, base: float = 2.0, strict: bool = False) -> DataFrame:
    """(token, ..., df, ig) in one pass: presence gain of tokens that carry their sample's label.

    tokens: distinct (sample, token) rows with the label beside; labels: one row per sample. bounds: only tokens whose
    document frequency is strictly between them; it is the sum of the cells, so no vocabulary is joined back. Tokens without a
    label don't count; strict: they are an error.
    """
    classes = Classes(labels, label)
    if strict:
        tokens = tokens.withColumn(label, F.coalesce(label, F.raise_error(F.lit("a sample has no label")).cast(dict(tokens.dtypes)[label])))
    cells = tokens.where(F.col(label).isNotNull()).groupBy(*by, F.col(label).alias("_y")).agg(F.count(F.lit(1)).alias("_c"))
    sums = classes.sums(cells, list(by))
    if bounds:
        sums = sums.where((F.col("_n1") > bounds[0]) & (F.col("_n1") < bounds[1]))
    return sums.select(*by, F.col("_n1").alias("df"), classes.gain(F.col("_f1") - _f(F.col("_n1")), base).alias("ig"))


def information_gain(pairs: DataFrame, labels: DataFrame, *, sample: str, label: str, by=("token",), value: str | None = None, base: float = 2.0, strict: bool = False) -> DataFrame:
    """(token, ..., ig). pairs: distinct (sample, token[, value]); labels: (sample, label), one row per sample.

    value: a column of integer values, each a category; without it presence is the category. Pairs of samples without
    a label don't count, as with an inner join; strict: they are an error.
    """
    classes, keys = Classes(labels, label), list(by)
    known = pairs.join(labels.select(sample, F.col(label).alias("_y")), sample, "left" if strict else "inner")
    if strict:
        known = known.withColumn("_y", F.coalesce("_y", F.raise_error(F.concat(F.lit("no label for sample "), F.col(sample).cast("string"))).cast(dict(known.dtypes)["_y"])))
    cells = known.groupBy(*keys, *([value] if value else []), "_y").agg(F.count(F.lit(1)).alias("_c"))
    if not value:
        return classes.sums(cells, keys).select(*keys, classes.gain(F.col("_f1") - _f(F.col("_n1")), base).alias("ig"))
    present = cells.groupBy(*keys, value).agg(F.sum(_f(F.col("_c"))).alias("_fc"), F.sum("_c").alias("_nv")).groupBy(*keys).agg(F.sum(F.col("_fc") - _f(F.col("_nv"))).alias("_present"))
    sums = classes.sums(cells.groupBy(*keys, "_y").agg(F.sum("_c").alias("_c")), keys)
    return sums.join(present, keys).select(*keys, classes.gain(F.col("_present"), base).alias("ig"))


def tfidf_gain(tokens: DataFrame, labels: DataFrame, frequencies: DataFrame, n: int, *, sample: str, label: str, base: float = 2.0, strict: bool = False) -> DataFrame:
    """Information gain with the TF-IDF weight as category: it tells counts apart unless idf is 0 (df = n - 1), where gain is 0."""
    counts = tokens.select(sample, "token", "tf")
    gain = information_gain(counts, labels, sample=sample, label=label, value="tf", base=base, strict=strict)
    return gain.join(frequencies, "token").select("token", F.when(F.col("df") == n - 1, F.lit(0.0)).otherwise(F.col("ig")).alias("ig"))
