"""Packed sizes and counts, as plain arithmetic on the plan side."""

from __future__ import annotations

import math

import numpy as np

#: Bytes of the packed headers.
BUFFER_HEADER, CUDA_HEADER, TOPK_HEADER, MATRIX_HEADER = 24, 48, 8, 200
#: Bytes of each flat codec's struct.
STRUCT = {"q8_0": 40, "q4_0": 40, "q2_k": 32, "q2_k_fast": 32, "bf16": 16, "fp16": 16, "fp8": 24, "fp4": 24, "mxfp8": 40, "mxfp4": 40, "nvfp4": 48, "nf4": 40, "nf4_dq": 48}


def blocks(n: int, size: int) -> int:
    return -(-n // size) if n and size else 0


def nibbles(n: int) -> int:
    return (n + 1) // 2


def payload(codec: str, n: int) -> int:
    """Bytes of scales and codes of n values."""
    return {
        "q8_0": lambda: 4 * blocks(n, 32) + n,
        "q4_0": lambda: 4 * blocks(n, 32) + nibbles(n),
        "q2_k": lambda: 84 * blocks(n, 256),
        "q2_k_fast": lambda: 84 * blocks(n, 256),
        "bf16": lambda: 2 * n,
        "fp16": lambda: 2 * n,
        "fp8": lambda: n,
        "fp4": lambda: nibbles(n),
        "mxfp8": lambda: blocks(n, 32) + n,
        "mxfp4": lambda: blocks(n, 32) + nibbles(n),
        "nvfp4": lambda: blocks(n, 16) + nibbles(n),
        "nf4": lambda: 4 * blocks(n, 64) + nibbles(n),
        "nf4_dq": lambda: blocks(n, 64) + nibbles(n),
    }[codec]()


def buffer_size(codec: str, n: int) -> int:
    """Bytes of a flat codec's relocatable buffer."""
    return BUFFER_HEADER + STRUCT[codec] + payload(codec, n)


def section_size(storage: str, n: int) -> int:
    """Bytes of a dense or quantized section: FP32 is raw; NF4 and NF4_DQ have a packed header, scales and nibbles."""
    if n <= 0:
        return 0
    if storage == "FP32":
        return 4 * n
    return CUDA_HEADER + payload(storage.lower(), n)


def topk_count(columns: int, ratio: float) -> int:
    """Elements per row: float32 columns * ratio, rounded half away from zero; at least 1 for a ratio above 0."""
    if not math.isfinite(ratio) or ratio < 0 or ratio > 1:
        raise ValueError("ratio must lie in 0..1")
    x = float(np.float32(columns) * np.float32(ratio))
    k = min(columns, math.floor(x + 0.5))
    return max(1, k) if ratio > 0 and columns > 0 else k


def topk_size(rows: int, columns: int, k: int) -> int:
    return TOPK_HEADER + 6 * rows * k if rows and columns else 0


def bits_per_value(size: int, n: int) -> float:
    return 8.0 * size / n
