"""Codecs over streams of block tables.

Only codecs whose scales come from the block itself apply to an unbounded stream; tensor-wide scales need the whole input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tilepress.operators.codecs import CODECS

PER_BLOCK = ("q8_0", "q4_0", "bf16", "fp16", "mxfp8", "mxfp4", "nf4")


def encode_stream(blocks: DataFrame, codec: str) -> DataFrame:
    """Codes of a streaming block table (block_id, vals): a stateless projection, in any output mode."""
    if codec not in PER_BLOCK:
        raise ValueError(f"{codec} needs a tensor-wide scale; a stream has {PER_BLOCK}")
    return CODECS[codec].encode(blocks)
