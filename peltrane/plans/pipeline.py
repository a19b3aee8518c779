"""The run from files and a split to the feature table: select vocabularies on train, then extract train and test.

Each file is parsed and disassembled once; the parsed table, the vocabularies with their gains, and the dataset are Parquet
tables of the experiment's folder, which is where the lineage is cut.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tokens
from ..operators import information, padding, pe_features, selection, vocabulary
from ..sources import disassembly, pe, samples
from .config import Config

KEY = "sha256"


@dataclass(frozen=True)
class Family:
    """A family of presence features beside the built-in ones.

    extract: parsed files (sha256, family, length, content, pe, ops) to distinct (sha256, token string).
    select: those tokens of train, and how many files train has, to the vocabulary (token, df).
    """

    name: str
    extract: Callable[[DataFrame], DataFrame]
    select: Callable[[DataFrame, int], DataFrame]


class Pipeline:
    """select() and build() over an experiment folder; run() does both.

    files (sha256, family, length, content) and split (sha256, split) stand in for the config's folders.
    """

    def __init__(self, spark: SparkSession, config: Config, experiment: str, decoder: disassembly.Decoder = disassembly.capstone_decoder, families: tuple[Family, ...] = (), files: DataFrame | None = None, split: DataFrame | None = None):
        self.files, self.split = files, split
        self.spark, self.config, self.experiment, self.decoder, self.families = spark, config, experiment.rstrip("/"), decoder, families

    def _stored(self, name: str, make: Callable[[], DataFrame], *partition: str) -> DataFrame:
        samples.write_table(make(), path := f"{self.experiment}/{name}", *partition)
        return self.spark.read.parquet(path)

    # -- Extraction ------------------------------------------------------------------------------------------------------

    def parsed(self) -> DataFrame:
        """(sha256, family, split, length, content, pe, ops): labelled files, parsed and disassembled once."""

        def make() -> DataFrame:
            split = self.split if self.split is not None else samples.load_split(self.spark, self.config.split).select(KEY, "split")
            found = self.files if self.files is not None else samples.read_files(self.spark, self.config.files)
            small = split.limit(self.config.broadcast_files + 1).count() <= self.config.broadcast_files  # so contents aren't shuffled
            files = found.join(F.broadcast(split) if small else split, KEY).withColumn("pe", pe.parse_pe(F.col("content")))
            return files.withColumn("ops", disassembly.disassemble(F.col("pe"), self.decoder)).withColumn("pe", F.col("pe").dropFields("code"))

        return self._stored("parsed", make)

    def sequence_tokens(self, files: DataFrame) -> DataFrame:
        good = files.where(F.col("ops.error").isNull()).select(KEY, F.col("ops.items").alias("items"))
        return tokens.sequence_ngrams(good, sample=KEY, items="items", longest=self.config.sequence_max, include_last=self.config.include_last)

    def grams(self, files: DataFrame, only: list[bytes] | None = None) -> DataFrame:
        return tokens.byte_ngrams(files, sample=KEY, content="content", include_last=self.config.include_last, only=only)

    # -- Selection -------------------------------------------------------------------------------------------------------

    def select_imports(self, train: DataFrame) -> DataFrame:
        found = pe_features.import_tokens(train, sample=KEY)
        if self.config.import_counts == "document":
            found = found.distinct()
        bounds = vocabulary.relative_bounds(train.count(), self.config.import_percent)
        return vocabulary.prevalent(vocabulary.occurrences(found, ("kind", "token")), bounds).select("kind", F.encode("token", "UTF-8").alias("token"), "df")

    def select_strings(self, train: DataFrame) -> DataFrame:
        df = vocabulary.document_frequency(tokens.string_tokens(train, sample=KEY, content="content"))
        return vocabulary.top_share(df, self.config.string_share).select(F.lit("string").alias("kind"), F.encode("token", "UTF-8").alias("token"), "df")

    def gram_gains(self, train: DataFrame) -> DataFrame:
        """Gains of the byte n-grams of a subsample that are neither rare nor everywhere, in one pass over it."""
        some = vocabulary.subsample(train.select(KEY, "family", "content"), self.config.sample_files, key=KEY, seed=self.config.seed)
        some = self._stored("sample", lambda: some)
        grams = tokens.byte_ngrams(some, sample=KEY, content="content", include_last=self.config.include_last, carry=("family",))
        gains = information.labelled_gain(grams, some.select(KEY, "family"), label="family", by=("size", "token"), bounds=vocabulary.absolute_bounds(some.count()), base=self.config.ig_base, strict=True)
        gains = self._stored("sample_gains", lambda: gains)
        if gains.count() > self.config.sample_grams:
            gains = vocabulary.subsample(gains.withColumn("_name", F.hex("token")), self.config.sample_grams, key="_name", seed=self.config.seed)
        return gains.select(F.lit("byte").alias("kind"), "token", "ig")

    def sequence_gains(self, train: DataFrame) -> DataFrame:
        found = self._stored("train_sequences", lambda: self.sequence_tokens(train))
        good = train.where(F.col("ops.error").isNull()).select(KEY, "family")
        n = good.count()
        df = vocabulary.document_frequency(found)
        base = df.count() if self.config.opcode_bounds == "vocabulary" else n
        known = vocabulary.prevalent(df, vocabulary.relative_bounds(base, self.config.import_percent))
        kept = vocabulary.members(found, known)
        gains = information.tfidf_gain(kept, good, known, n, sample=KEY, label="family", base=self.config.ig_base, strict=True)
        return gains.select(F.lit("opcode").alias("kind"), F.encode("token", "UTF-8").alias("token"), "ig")

    def select(self) -> DataFrame:
        """(kind, token, df, ig): the vocabularies, stored by kind; the gains with their ccdf are stored beside them."""
        files = self.parsed()
        train = files.where("split = 'train'")
        gains = self._stored("ig", lambda: selection.ccdf(selection.union_gains(self.gram_gains(train), self.sequence_gains(train))))
        chosen = selection.select_features(gains, self.config.ig_threshold).select("kind", "token", "ig")
        scope = files if self.config.opcode_scope == "all" else train
        df = vocabulary.document_frequency(self.sequence_tokens(scope)).select(F.lit("opcode").alias("kind"), F.encode("token", "UTF-8").alias("token"), "df")
        by_gain = chosen.join(df, ["kind", "token"], "left").select("kind", "token", "df", "ig")
        plain = self.select_imports(train).unionByName(self.select_strings(train))
        for f in self.families:
            plain = plain.unionByName(f.select(f.extract(train), train.count()).select(F.lit(f.name).alias("kind"), F.encode("token", "UTF-8").alias("token"), "df"))
        plain = plain.withColumn("ig", F.lit(None).cast("double"))
        return self._stored("vocabulary", lambda: plain.unionByName(by_gain), "kind")

    def import_gains(self, train: DataFrame) -> DataFrame:
        """Gains of the prevalent imports' presence; not part of the selection, which goes by prevalence."""
        found = pe_features.import_tokens(train, sample=KEY).distinct()
        known = self.select_imports(train).select("kind", F.decode("token", "UTF-8").alias("token"))
        kept = vocabulary.members(found, known, on=("kind", "token"))
        return information.information_gain(kept, train.select(KEY, "family"), sample=KEY, label="family", by=("kind", "token"), base=self.config.ig_base)

    # -- Dataset ---------------------------------------------------------------------------------------------------------

    def _words(self, known: DataFrame, kind: str, binary: bool = False) -> list:
        rows = known.where(F.col("kind") == kind).select("token").collect()  # a selected vocabulary
        return sorted(bytes(r["token"]) if binary else bytes(r["token"]).decode() for r in rows)

    def build(self) -> DataFrame:
        """One row per file: scalar columns, and an array for each family of tokens whose vocabulary isn't empty."""
        files, known = self.spark.read.parquet(f"{self.experiment}/parsed"), self.spark.read.parquet(f"{self.experiment}/vocabulary")
        rows = pe_features.section_features(files.select(KEY, "length", "content", "pe"))
        rows = pe_features.enriched(rows)
        rows = rows.select(KEY, F.col("length").alias("generic_fileSize"), tokens.byte_entropy(F.col("content")).alias("generic_fileEntropy"), *pe_features.header_features(F.col("pe")), *[F.col(f"`{c}`") for c in rows.columns if c.startswith("pesection") or c == "section_error"])
        dlls, imports = self._words(known, "dll"), self._words(known, "import")
        if dlls and imports:
            found = pe_features.import_tokens(files, sample=KEY)
            rows = padding.pad_presence(rows, found.where("kind = 'dll'"), dlls, sample=KEY, out="dlls")
            rows = padding.pad_presence(rows, found.where("kind = 'import'"), imports, sample=KEY, out="imports")
        if strings := self._words(known, "string"):
            rows = padding.pad_presence(rows, tokens.string_tokens(files, sample=KEY, content="content"), strings, sample=KEY, out="strings")
        if grams := self._words(known, "byte", binary=True):
            rows = padding.pad_presence(rows, self.grams(files, grams).select(KEY, "token"), grams, sample=KEY, out="ngrams")
        if words := self._words(known, "opcode"):
            df = known.where("kind = 'opcode'").select(F.decode("token", "UTF-8").alias("token"), "df")
            weights = vocabulary.tfidf(self.sequence_tokens(files), df, files.count())
            rows = padding.pad_weights(rows, weights, words, sample=KEY, out="opcodes")
        for f in self.families:
            if words := self._words(known, f.name):
                rows = padding.pad_presence(rows, f.extract(files), words, sample=KEY, out=f.name)
        return self._stored(self.config.dataset, lambda: rows)

    def wide(self) -> DataFrame:
        """The dataset with one column for each feature, under names that tell all tokens apart."""
        known = self.spark.read.parquet(f"{self.experiment}/vocabulary")
        frame = self.spark.read.parquet(f"{self.experiment}/{self.config.dataset}")
        kinds = {"dlls": ("", "dll"), "imports": ("", "import"), "strings": ("str_", "string"), "ngrams": ("ngram_", "byte"), "opcodes": ("opcode_", "opcode")} | {f.name: (f"{f.name}_", f.name) for f in self.families}
        return padding.wide(frame, {c: (prefix, self._words(known, kind, kind == "byte")) for c, (prefix, kind) in kinds.items() if c in frame.columns})

    def run(self) -> DataFrame:
        self.select()
        return self.build()
