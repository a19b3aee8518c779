"""The functions that need Python, for SQL text."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..sources import disassembly, pe
from . import tokens


def register(spark: SparkSession, decoder: disassembly.Decoder = disassembly.capstone_decoder) -> None:
    """parse_pe(content), disassemble(machine, code, address, error) and byte_entropy(content)."""
    spark.udf.register("parse_pe", pe.parse_pe_function())
    spark.udf.register("disassemble", disassembly.disassemble_function(decoder))
    spark.udf.register("byte_entropy", tokens.byte_entropy_function())
