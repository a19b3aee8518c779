"""Configuration of a run, passed explicitly."""

from __future__ import annotations

import os
from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    """Where a run reads and writes, and its parameters. Parallelism is Spark's own configuration."""

    files: str  # folder of files kept as family/sha256
    split: str  # folder with X_train, y_train, X_test, y_test in Parquet
    dataset: str = "dataset"  # folder of the final table, within the experiment's
    seed: int = 42
    sample_files: int = 1000
    sample_grams: int = 5_000_000
    import_percent: float = 0.1
    string_share: float = 0.0001
    sequence_max: int = 3
    ig_threshold: float = 0.36
    ig_base: float = 2.0
    broadcast_files: int = 500_000  # a split of up to this many files (64-byte keys) is broadcast to them
    include_last: bool = False  # the last n-gram of a file or sequence, which is left out by default
    import_counts: str = "occurrence"  # or "document"
    opcode_bounds: str = "vocabulary"  # or "samples"
    opcode_scope: str = "all"  # frequencies of the final weights from all samples, or "train"

    @classmethod
    def from_env(cls, env=os.environ) -> Config:
        missing = [k for k in ("MALWARE_DIR_PATH", "SPLITTED_DATASET_PATH") if not env.get(k)]
        if missing:
            raise ValueError(f"not set: {', '.join(missing)}")
        return cls(env["MALWARE_DIR_PATH"], env["SPLITTED_DATASET_PATH"], env.get("FINAL_DATASET_DIR") or "dataset")
