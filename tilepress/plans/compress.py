"""Compression of a wide float32 matrix: outliers, direct codes or low-rank factors, and error correction.

    O = per-row largest magnitudes of A          R = A without them
    C = what R's codes or factors decode to      E = per-row largest magnitudes of R - C
    decompressed: (C + E) + O, added in this order in float32
"""

from __future__ import annotations

import math
import struct
import time
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilepress.functions import sizes
from tilepress.operators import blocks as bl
from tilepress.operators import kernels, lowrank, topk
from tilepress.sources import packing

FORMATS = ("NONE", "NF4", "NF4_DQ")
#: Below or at this magnitude a residual counts as zero: the float32 epsilon.
EPSILON = 1.1920928955078125e-07
SECTIONS = ("u", "s", "v", "direct", "outlier", "error")
#: Rows of one packed object at most: its header has 16 bits for them. A whole object of more rows keeps the low 16 bits there; its cells,
#: of which there are 32 bits, tell how many rows it has.
TILE_ROWS = 65_535


def _ratio(x: float) -> None:
    if not math.isfinite(x) or not 0 <= x <= 1:
        raise ValueError("ratios must be finite and in 0..1")


@dataclass(frozen=True)
class CompressConfig:
    rows: int
    columns: int
    outlier_ratio: float = 0.0
    error_ratio: float = 0.0
    ranks: int = 0
    niters: int = 2
    uv_format: str = "NONE"
    s_format: str = "NONE"
    only_format: str = "NONE"
    #: Whether there may be more than TILE_ROWS rows. Sections then hold all rows; packed objects are made of `tiles`, or of
    #: all rows with `whole=True`.
    tall: bool = False

    def __post_init__(self) -> None:
        if not (1 <= self.rows <= (2**31 - 1 if self.tall else TILE_ROWS) and 1 <= self.columns <= 65_535):
            raise ValueError("dimensions must lie in 1..65535")
        _ratio(self.outlier_ratio)
        _ratio(self.error_ratio)
        if any(f not in FORMATS for f in (self.uv_format, self.s_format, self.only_format)):
            raise ValueError(f"formats must be of {FORMATS}")
        if self.ranks < 0 or (self.ranks and self.niters < 1):
            raise ValueError("ranks must not be negative; with ranks, niters must be at least 1")

    @property
    def rank(self) -> int:
        return min(self.ranks, self.rows, self.columns) if self.ranks else 0

    @property
    def outlier_k(self) -> int:
        return sizes.topk_count(self.columns, self.outlier_ratio)

    @property
    def error_k(self) -> int:
        return sizes.topk_count(self.columns, self.error_ratio)


@dataclass(frozen=True)
class DecompressConfig(CompressConfig):
    """What the receiving side expects; here ranks must equal the rank that was packed."""


@dataclass
class CompressedMatrix:
    config: CompressConfig
    sections: dict[str, DataFrame]
    storage: dict[str, str]
    profile: dict[str, float] = field(default_factory=dict)
    #: Frames that compression has persisted.
    held: list[DataFrame] = field(default_factory=list)

    def __enter__(self) -> CompressedMatrix:
        return self

    def __exit__(self, *_) -> None:
        self.unpersist()

    def layout(self) -> list[tuple[str, str, int, int]]:
        """(section, storage, offset, size) of what is stored, in payload order; offsets count from the payload."""
        c, out, at = self.config, [], 0
        count = {"u": c.rows * c.rank, "s": c.rank, "v": c.columns * c.rank, "direct": c.rows * c.columns}
        for name in SECTIONS:
            if name in self.storage:
                kind = self.storage[name]
                size = sizes.topk_size(c.rows, c.columns, c.outlier_k if name == "outlier" else c.error_k) if kind == "TOPK" else sizes.section_size(kind, count[name])
                out.append((name, kind, at, size))
                at += size
        return out

    def packed_size(self, whole: bool = False) -> int:
        """Bytes of the packed object; of a taller matrix, of the objects of its tiles, or of the whole object."""
        rows = self.config.rows
        if rows > TILE_ROWS and not whole:
            parts = [n for n in {TILE_ROWS: rows // TILE_ROWS, rows % TILE_ROWS: 1}.items() if n[0]]
            return sum(k * replace(self, config=replace(self.config, rows=n)).packed_size() for n, k in parts)
        return sizes.MATRIX_HEADER + max((offset + size for _, _, offset, size in self.layout()), default=0)

    def bits_per_value(self) -> float:
        return sizes.bits_per_value(self.packed_size(), self.config.rows * self.config.columns)

    def unpersist(self) -> None:
        """Releases what compression holds; the matrix can still be read, and is worked out anew."""
        while self.held:
            self.held.pop().unpersist()


def tiles(wide: DataFrame, rows: int) -> Iterator[tuple[int, DataFrame]]:
    """(rows, wide matrix with rows from 0) of each packed object that a matrix of more than TILE_ROWS rows needs."""
    for first in range(0, rows, TILE_ROWS):
        n = min(TILE_ROWS, rows - first)
        yield n, wide.where((F.col("row") >= first) & (F.col("row") < first + n)).withColumn("row", (F.col("row") - first).cast("int"))


def _flat_blocks(wide: DataFrame, columns: int) -> DataFrame:
    return bl.matrix_blocks(wide, columns, 64)


def _encode(wide: DataFrame, columns: int, storage: str) -> DataFrame:
    """Section rows of a wide matrix: raw rows, or codes of its flattened blocks."""
    return wide.select("row", F.col("vec").cast("array<float>").alias("vec")) if storage == "FP32" else kernels.encode(_flat_blocks(wide, columns), storage.lower())


def _decode(section: DataFrame, columns: int, storage: str) -> DataFrame:
    if storage == "FP32":
        return section
    blocks = kernels.decode(section, storage.lower())
    if columns % 64 == 0:  # rows hold whole blocks: gather them by row
        per = columns // 64
        ordered = F.array_sort(F.collect_list(F.struct("block_id", "vals")))
        row = F.floor(F.col("block_id") / per).cast("int").alias("row")
        return blocks.groupBy(row).agg(F.flatten(F.transform(ordered, lambda x: x["vals"])).alias("vec"))
    cells = bl.flatten(blocks, 64, "vals", "v")
    return bl.to_wide(cells.select(F.floor(F.col("idx") / columns).cast("int").alias("row"), F.pmod("idx", F.lit(columns)).cast("int").alias("col"), "v"))


def _storage(form: str) -> str:
    return "FP32" if form == "NONE" else form


def _factors(sections: dict[str, DataFrame], storage: dict[str, str], rank: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """U stays distributed; S (rank) and V (columns x rank) are small by the limits on dimensions."""
    u = _decode(sections["u"], rank, storage["u"])
    s = np.array(_decode(sections["s"], rank, storage["s"]).orderBy("row").first().vec, np.float32)
    v = np.array([r.vec for r in _decode(sections["v"], rank, storage["v"]).orderBy("row").toLocalIterator()], np.float32)
    return u, s, v


def compress(wide: DataFrame, config: CompressConfig) -> CompressedMatrix:
    """wide: (row, vec) with rows 0..rows-1 and `columns` finite floats each. The input is not changed."""
    c, began, profile = config, time.monotonic(), dict.fromkeys(("topk", "svd", "encode", "decode", "reconstruct", "error"), 0.0)
    sections: dict[str, DataFrame] = {}
    storage: dict[str, str] = {}
    held: list[DataFrame] = []

    def keep(frame: DataFrame) -> DataFrame:
        held.append(frame.persist())
        return held[-1]

    rest = wide.select(F.col("row").cast("int").alias("row"), F.col("vec").cast("array<float>").alias("vec"))
    if c.outlier_k:
        split = keep(topk.separate(rest, c.outlier_k))
        sections["outlier"], storage["outlier"] = split.select("row", "picks"), "TOPK"
        rest = split.select("row", "vec")
    if c.rank:
        t = time.monotonic()
        f = lowrank.lowrank_svd(rest, c.columns, c.rank, c.niters)
        profile["svd"] = time.monotonic() - t
        spark = wide.sparkSession
        one = spark.createDataFrame([(0, [float(x) for x in f.s])], "row int, vec array<float>")
        for name, frame, form, width in (("u", f.u, c.uv_format, c.rank), ("s", one, c.s_format, c.rank), ("v", f.v_frame(), c.uv_format, c.rank)):
            storage[name] = _storage(form)
            sections[name] = keep(_encode(frame, width, storage[name]))
    else:
        storage["direct"] = _storage(c.only_format)
        sections["direct"] = keep(_encode(rest, c.columns, storage["direct"]))
    # without factors, an unquantized section leaves no error to correct
    if c.error_k and (c.rank or c.only_format != "NONE"):
        t = time.monotonic()
        diff = rest.join(_approximation(sections, storage, c).withColumnRenamed("vec", "near"), "row").select("row", F.zip_with("vec", "near", lambda a, b: a - b).alias("vec"))
        some = diff.agg(F.max(F.array_max(F.transform("vec", lambda e: F.abs(e)))).alias("m")).first().m
        if some is not None and some > EPSILON:
            sections["error"], storage["error"] = keep(topk.extract(diff, c.error_k)), "TOPK"
        profile["error"] = time.monotonic() - t
    profile["other"] = max(0.0, time.monotonic() - began - sum(profile.values()))
    return CompressedMatrix(c, sections, {k: storage[k] for k in SECTIONS if k in storage}, profile, held)


def _approximation(sections: dict[str, DataFrame], storage: dict[str, str], c: CompressConfig) -> DataFrame:
    if c.rank:
        return lowrank.reconstruct(*_factors(sections, storage, c.rank))
    return _decode(sections["direct"], c.columns, storage["direct"])


def validate(matrix: CompressedMatrix, config: DecompressConfig) -> None:
    """Raises where the receiving side cannot decode the matrix."""
    m = matrix.config
    if (m.rows, m.columns) != (config.rows, config.columns):
        raise ValueError("shapes differ")
    if m.rank != config.ranks:
        raise ValueError("the packed rank differs")
    stored = matrix.storage
    for name, form in (("u", config.uv_format), ("v", config.uv_format), ("s", config.s_format), ("direct", config.only_format)):
        if name in stored and stored[name] != _storage(form):
            raise ValueError(f"section {name} is stored as {stored[name]}")
    for name, k, most in (("outlier", m.outlier_k, config.outlier_k), ("error", m.error_k, config.error_k)):
        if name in stored and k > most:
            raise ValueError(f"section {name} needs room for {k} values a row")
    wanted = {"u", "s", "v"} if m.rank else {"direct"}
    if not wanted <= set(stored) or (set(stored) & {"u", "s", "v", "direct"}) != wanted:
        raise ValueError("sections are missing or superfluous")


def decompress(matrix: CompressedMatrix, config: DecompressConfig | None = None) -> DataFrame:
    """(row, vec)."""
    if config is not None:
        validate(matrix, config)
    out = _approximation(matrix.sections, matrix.storage, matrix.config)
    for name in ("error", "outlier"):
        if name in matrix.sections:
            out = topk.apply(out, matrix.sections[name])
    return out


def write(matrix: CompressedMatrix, path: str) -> None:
    """Sections as Parquet tables below path, and one row of metadata."""
    spark = next(iter(matrix.sections.values())).sparkSession
    for name, frame in matrix.sections.items():
        frame.write.mode("overwrite").parquet(f"{path}/{name}")
    c = matrix.config
    meta = [(c.rows, c.columns, c.outlier_ratio, c.error_ratio, c.ranks, c.niters, c.uv_format, c.s_format, c.only_format, [list(map(str, x)) for x in matrix.layout()])]
    spark.createDataFrame(meta, "rows int, columns int, outlier_ratio double, error_ratio double, ranks int, niters int, uv_format string, s_format string, only_format string, layout array<array<string>>").write.mode("overwrite").parquet(f"{path}/metadata")


def read(spark, path: str) -> CompressedMatrix:
    m = spark.read.parquet(f"{path}/metadata").first()
    config = CompressConfig(m.rows, m.columns, m.outlier_ratio, m.error_ratio, m.ranks, m.niters, m.uv_format, m.s_format, m.only_format)
    storage = {x[0]: x[1] for x in m.layout}
    return CompressedMatrix(config, {k: spark.read.parquet(f"{path}/{k}") for k in storage}, storage)


#: Storage numbers of a section and bits of the flags.
STORAGE = {"NONE": 0, "FP32": 1, "QUANT": 2, "TOPK": 3}
HAS_SVD, HAS_OUTLIER, HAS_ERROR = 1, 2, 4
_FIXED, _SECTION = "<HHIffhhhhiiiiI4x", "<QQB7x"


def header(matrix: CompressedMatrix, whole: bool = False) -> bytes:
    """The 200 bytes before the payload: shape, settings, flags, six section descriptors, an empty pointer."""
    c, held = matrix.config, {name: (kind, at, size) for name, kind, at, size in matrix.layout()}
    if c.rows > TILE_ROWS and not whole:
        raise ValueError("a packed object holds 65535 rows at most; pack the tiles")
    if c.rows * c.columns >= 2**32:
        raise ValueError("a packed object holds 2^32 - 1 cells at most; pack the tiles")
    flags = HAS_SVD * bool(c.rank) + HAS_OUTLIER * ("outlier" in held) + HAS_ERROR * ("error" in held)
    forms = [packing.METHODS[f] for f in (c.uv_format, c.s_format, c.only_format)]
    out = struct.pack(_FIXED, c.rows % (TILE_ROWS + 1), c.columns, c.rows * c.columns, c.outlier_ratio, c.error_ratio, c.ranks, c.niters, c.rank, 0, *forms, 0, flags)
    for name in SECTIONS:
        kind, at, size = held.get(name, ("NONE", 0, 0))
        out += struct.pack(_SECTION, at, size, STORAGE["QUANT" if kind in ("NF4", "NF4_DQ") else kind])
    return out + bytes(8)


def pack(matrix: CompressedMatrix, whole: bool = False) -> DataFrame:
    """The packed matrix as segments (offset_bytes, bytes): header and payload. packing.assemble makes one value of them.

    whole: one object also of more than TILE_ROWS rows, which only `load` reads; other readers need the tiles."""
    c, spark = matrix.config, next(iter(matrix.sections.values())).sparkSession
    out = spark.createDataFrame([(0, bytearray(header(matrix, whole)))], packing.SEGMENTS)
    count = {"u": c.rows * c.rank, "s": c.rank, "v": c.columns * c.rank, "direct": c.rows * c.columns}
    width = {"u": c.rank, "s": c.rank, "v": c.rank, "direct": c.columns}
    for name, kind, at, _ in matrix.layout():
        frame, at = matrix.sections[name], sizes.MATRIX_HEADER + at
        if kind == "TOPK":
            part = packing.topk_segments(frame, c.rows, c.columns, c.outlier_k if name == "outlier" else c.error_k, at)
        elif kind == "FP32":
            part = packing.dense_segments(frame, width[name], at)
        else:
            part = packing.section_segments(frame, kind, count[name], at)
        out = out.unionByName(part)
    return out


def load(spark, data: bytes) -> CompressedMatrix:
    """The matrix of one packed value. Raises ValueError where the header, a section's bounds or a section's own header do not fit;
    bytes beyond the payload are passed over."""
    if len(data) < sizes.MATRIX_HEADER:
        raise ValueError("shorter than its header")
    low, columns, n, outlier, error, ranks, niters, rank, _, uv, s_, only, _, flags = struct.unpack_from(_FIXED, data)
    rows = n // max(1, columns)  # of a whole object, `low` has their low 16 bits
    names = {v: k for k, v in packing.METHODS.items()}
    forms = [names.get(f, "") for f in (uv, s_, only)]
    if n != rows * columns or low != rows % (TILE_ROWS + 1) or any(f not in FORMATS for f in forms):
        raise ValueError("the header does not fit")
    c = CompressConfig(rows, columns, outlier, error, ranks, niters, *forms, tall=rows > TILE_ROWS)
    payload, storage, sections = len(data) - sizes.MATRIX_HEADER, {}, {}
    shape = {"u": (rows, rank, c.uv_format), "s": (1, rank, c.s_format), "v": (columns, rank, c.uv_format), "direct": (rows, columns, c.only_format)}
    for k, name in enumerate(SECTIONS):
        at, size, kind = struct.unpack_from(_SECTION, data, struct.calcsize(_FIXED) + k * struct.calcsize(_SECTION))
        if kind == STORAGE["NONE"]:
            if size:
                raise ValueError(f"section {name} has bytes but no storage")
            continue
        if not size or at > payload or size > payload - at or kind not in STORAGE.values():
            raise ValueError(f"section {name} lies outside the payload")
        part = data[sizes.MATRIX_HEADER + at : sizes.MATRIX_HEADER + at + size]
        if kind == STORAGE["TOPK"]:
            if name not in ("outlier", "error"):
                raise ValueError(f"section {name} is stored as TOPK")
            storage[name], sections[name] = "TOPK", packing.unpack_topk(spark, part, rows, columns, columns)
            continue
        if name not in shape:
            raise ValueError(f"section {name} is not stored as TOPK")
        high, wide, form = shape[name]
        storage[name] = _storage(form)
        if (kind == STORAGE["FP32"]) != (storage[name] == "FP32"):
            raise ValueError(f"storage and format of section {name} differ")
        if storage[name] == "FP32":
            sections[name] = packing.unpack_dense(spark, part, high, wide)
        else:
            head = packing.QuantHeader.unpack(part)
            if (head.method, head.elements) != (storage[name], high * wide):
                raise ValueError(f"section {name} is of another shape")
            sections[name] = packing.unpack_quantized(spark, part)
    wanted = {"u", "s", "v"} if flags & HAS_SVD else {"direct"}
    if rank != c.rank or bool(flags & HAS_SVD) != bool(rank) or set(storage) - {"outlier", "error"} != wanted or ("outlier" in storage, "error" in storage) != (bool(flags & HAS_OUTLIER), bool(flags & HAS_ERROR)):
        raise ValueError("flags, rank and sections do not agree")
    return CompressedMatrix(c, sections, storage)
