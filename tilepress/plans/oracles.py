"""DuckDB SQL for the registered queries, written out independently of the column expressions."""

from __future__ import annotations

import numpy as np

from tilepress.functions.floats import E2M1_LEVELS, NF4_LEVELS

EMB = "emb AS (SELECT vec_id * 64 + i AS idx, CAST(x AS FLOAT) AS v FROM (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding) AS x FROM embeddings))"
EVENTS = "ev AS (SELECT event_id AS idx, CAST(value AS FLOAT) AS v FROM events)"
FLAT = {"embeddings": ("emb", EMB), "events": ("ev", EVENTS)}


def negative(c: str) -> str:
    return f"({c} < 0 OR ({c} = 0 AND CAST({c} AS VARCHAR) = '-0.0'))"


def e4m3(c: str) -> str:
    a = f"CAST(least(abs({c}), 448::FLOAT) AS DOUBLE)"
    steps = " ".join(f"WHEN {a} < {2.0 ** (k + 1)!r}::DOUBLE THEN {8 * (k + 7)} + round_even(({a} / {2.0**k!r}::DOUBLE - 1) * 8, 0)" for k in range(-6, 9))
    return f"CAST((CASE WHEN {negative(c)} THEN 128 ELSE 0 END) + (CASE WHEN {a} < {2.0**-6!r}::DOUBLE THEN least(round_even({a} * 512, 0), 7) {steps} END) AS INTEGER)"


def e4m3_value(c: str) -> str:
    m, e = f"(({c}) % 8)", f"((({c}) % 128) // 8)"
    return f"CAST((CASE WHEN {c} >= 128 THEN -1 ELSE 1 END) * (CASE WHEN {e} = 0 THEN {m} / 8.0::DOUBLE * {2.0**-6!r}::DOUBLE ELSE (1 + {m} / 8.0::DOUBLE) * pow(2.0::DOUBLE, {e} - 7) END) AS FLOAT)"


def e2m1(c: str) -> str:
    tests = " ".join(f"WHEN abs({c}) <= {(a + b) / 2}::FLOAT THEN {k}" for k, (a, b) in enumerate(zip(E2M1_LEVELS, E2M1_LEVELS[1:], strict=False)))
    return f"(CASE {tests} ELSE 7 END + CASE WHEN {negative(c)} THEN 8 ELSE 0 END)"


def e2m1_value(c: str) -> str:
    return f"CAST((CASE WHEN {c} >= 8 THEN -1 ELSE 1 END) * list_extract([{', '.join(map(str, E2M1_LEVELS))}]::FLOAT[], ({c}) % 8 + 1) AS FLOAT)"


_LEVELS = "[" + ", ".join(f"{x!r}" for x in NF4_LEVELS) + "]::FLOAT[]"


def nf4(c: str) -> str:
    errors = f"list_transform({_LEVELS}, lambda l: abs({c} - l))"
    return f"(list_position({errors}, list_min({errors})) - 1)"


def nf4_value(c: str) -> str:
    return f"list_extract({_LEVELS}, {c} + 1)"


def small_float(c: str, exponent: int, mantissa: int) -> str:
    bias, top = 2 ** (exponent - 1) - 1, 2**exponent - 1
    a = f"CAST(abs({c}) AS DOUBLE)"
    g = f"(CASE WHEN {a} > 0 THEN CAST(floor(log2({a})) AS INTEGER) ELSE {1 - bias} END)"
    e = f"greatest({g} + (CASE WHEN {a} >= pow(2.0::DOUBLE, {g} + 1) THEN 1 WHEN {a} < pow(2.0::DOUBLE, {g}) AND {a} > 0 THEN -1 ELSE 0 END), {1 - bias})"
    bits = f"(({e} + {bias} - 1) * {2**mantissa} + CAST(round_even({a} / pow(2.0::DOUBLE, {e}) * {2**mantissa}, 0) AS BIGINT))"
    return f"CAST(least({bits}, {top * 2**mantissa}) + (CASE WHEN {negative(c)} THEN {2 ** (exponent + mantissa)} ELSE 0 END) AS INTEGER)"


def small_float_value(c: str, exponent: int, mantissa: int) -> str:
    bias = 2 ** (exponent - 1) - 1
    m, e = f"(({c}) % {2**mantissa})", f"((({c}) // {2**mantissa}) % {2**exponent})"
    value = f"(CASE WHEN {e} = 0 THEN {m} / {float(2**mantissa)}::DOUBLE * {2.0 ** (1 - bias)!r}::DOUBLE ELSE (1 + {m} / {float(2**mantissa)}::DOUBLE) * pow(2.0::DOUBLE, {e} - {bias}) END)"
    return f"CAST((CASE WHEN ({c}) >= {2 ** (exponent + mantissa)} THEN -1 ELSE 1 END) * {value} AS FLOAT)"


def _coded(codec: str, source: str) -> str:
    """CTEs ending in `coded`: idx, v, block_id, scale columns, code, decoded."""
    name, cte = FLAT[source]
    size = {"q8_0": 32, "q4_0": 32, "mxfp8": 32, "mxfp4": 32, "nvfp4": 16, "nf4": 64, "nf4_dq": 64}.get(codec, 256)
    top = f"max(abs(v)) OVER (PARTITION BY idx // {size})"
    start = f"WITH {cte}, b AS (SELECT idx, v, idx // {size} AS block_id, {top} AS top FROM {name})"
    if codec in ("q8_0", "q4_0"):
        most = 127 if codec == "q8_0" else 7
        return f"""{start}, s AS (SELECT *, CAST(top / {most}::FLOAT AS FLOAT) AS scale FROM b),
        t AS (SELECT *, CASE WHEN scale = 0 THEN 0::FLOAT ELSE CAST(1::FLOAT / scale AS FLOAT) END AS inv FROM s),
        u AS (SELECT *, CAST(greatest(least(round_even(CAST(v * inv AS FLOAT), 0), {most}), -{most}) AS INTEGER) AS code FROM t),
        coded AS (SELECT idx, v, block_id, scale, code, CAST(scale * CAST(code AS FLOAT) AS FLOAT) AS decoded FROM u)"""
    if codec in ("fp8", "fp4"):
        most, enc, dec = (448, e4m3, e4m3_value) if codec == "fp8" else (6, e2m1, e2m1_value)
        return f"""{start}, g AS (SELECT max(top) AS all_top FROM b), s AS (SELECT b.*, CASE WHEN all_top = 0 THEN 1::FLOAT ELSE CAST(all_top / {most}::FLOAT AS FLOAT) END AS scale FROM b, g),
        t AS (SELECT *, CAST(v * CAST(1::FLOAT / scale AS FLOAT) AS FLOAT) AS x FROM s), u AS (SELECT *, {enc("x")} AS code FROM t),
        coded AS (SELECT idx, v, block_id, scale, code, CAST(scale * {dec("code")} AS FLOAT) AS decoded FROM u)"""
    if codec in ("mxfp8", "mxfp4"):
        most, enc, dec = (448, e4m3, e4m3_value) if codec == "mxfp8" else (6, e2m1, e2m1_value)
        return f"""{start}, s AS (SELECT *, CASE WHEN top > 0 THEN CAST(ceil(CAST(log2(CAST(top / {most}::FLOAT AS FLOAT)) AS FLOAT)) AS INTEGER) ELSE 0 END AS exponent FROM b),
        t AS (SELECT *, CAST(v / CAST(pow(2.0::DOUBLE, exponent) AS FLOAT) AS FLOAT) AS x FROM s), u AS (SELECT *, {enc("x")} AS code FROM t),
        coded AS (SELECT idx, v, block_id, exponent, code, CAST(CAST(pow(2.0::DOUBLE, exponent) AS FLOAT) * {dec("code")} AS FLOAT) AS decoded FROM u)"""
    if codec == "nvfp4":
        return f"""{start}, g AS (SELECT max(top) AS all_top FROM b), s AS (SELECT b.*, CASE WHEN all_top = 0 THEN 1::FLOAT ELSE CAST(all_top / 6::FLOAT AS FLOAT) END AS tensor_scale FROM b, g),
        w AS (SELECT *, max(abs(CAST(v / tensor_scale AS FLOAT))) OVER (PARTITION BY block_id) AS near FROM s),
        x AS (SELECT *, CASE WHEN CAST(near / 6::FLOAT AS FLOAT) > 0 THEN CAST(near / 6::FLOAT AS FLOAT) ELSE 1::FLOAT END AS target FROM w),
        y AS (SELECT *, {e4m3("target")} AS scale_code FROM x), z AS (SELECT *, {e4m3_value("scale_code")} AS block_scale FROM y),
        t AS (SELECT *, CAST(CAST(v * CAST(1::FLOAT / tensor_scale AS FLOAT) AS FLOAT) * CAST(1::FLOAT / block_scale AS FLOAT) AS FLOAT) AS r FROM z), u AS (SELECT *, {e2m1("r")} AS code FROM t),
        coded AS (SELECT idx, v, block_id, tensor_scale, scale_code, code, CAST(CAST(tensor_scale * block_scale AS FLOAT) * {e2m1_value("code")} AS FLOAT) AS decoded FROM u)"""
    if codec == "nf4":
        return f"""{start}, s AS (SELECT *, CASE WHEN top > 0 THEN top ELSE 1::FLOAT END AS scale FROM b), t AS (SELECT *, CAST(v * CAST(1::FLOAT / scale AS FLOAT) AS FLOAT) AS x FROM s),
        u AS (SELECT *, {nf4("x")} AS code FROM t), coded AS (SELECT idx, v, block_id, scale, code, CAST(scale * {nf4_value("code")} AS FLOAT) AS decoded FROM u)"""
    if codec == "nf4_dq":
        return f"""{start}, a AS (SELECT *, CASE WHEN top > 0 THEN top ELSE 1::FLOAT END AS absmax FROM b), g AS (SELECT CAST(max(absmax) / 448::FLOAT AS FLOAT) AS dq_scale FROM a),
        s AS (SELECT a.*, dq_scale, CAST(absmax / dq_scale AS FLOAT) AS part FROM a, g), y AS (SELECT *, {e4m3("part")} AS scale_code FROM s),
        z AS (SELECT *, CAST(dq_scale * {e4m3_value("scale_code")} AS FLOAT) AS found FROM y), q AS (SELECT *, CASE WHEN found = 0 THEN 1::FLOAT ELSE found END AS scale FROM z),
        t AS (SELECT *, CAST(v * CAST(1::FLOAT / scale AS FLOAT) AS FLOAT) AS x FROM q), u AS (SELECT *, {nf4("x")} AS code FROM t),
        coded AS (SELECT idx, v, block_id, dq_scale, scale_code, code, CAST(scale * {nf4_value("code")} AS FLOAT) AS decoded FROM u)"""
    exponent, mantissa = (8, 7) if codec == "bf16" else (5, 10)
    return f"""{start}, u AS (SELECT *, {small_float("v", exponent, mantissa)} AS code FROM b), coded AS (SELECT idx, v, block_id, code, {small_float_value("code", exponent, mantissa)} AS decoded FROM u)"""


KEPT = {"q8_0": ["scale"], "q4_0": ["scale"], "fp8": ["scale"], "fp4": ["scale"], "mxfp8": ["exponent"], "mxfp4": ["exponent"], "nvfp4": ["tensor_scale", "scale_code"], "nf4": ["scale"], "nf4_dq": ["dq_scale", "scale_code"], "bf16": [], "fp16": []}


def codes(codec: str) -> str:
    more = "".join(f", CAST({c} AS DOUBLE) AS {c}" if c in ("scale", "tensor_scale", "dq_scale") else f", {c}" for c in KEPT[codec])
    return f"{_coded(codec, 'embeddings')} SELECT idx, block_id{more}, CAST(code AS INTEGER) AS code FROM coded"


def roundtrip(codec: str) -> str:
    return f"{_coded(codec, 'events')} SELECT idx, CAST(v AS DOUBLE) AS v, CAST(decoded AS DOUBLE) AS decoded FROM coded"


def metrics(codec: str) -> str:
    d = "(CAST(v AS DOUBLE) - CAST(decoded AS DOUBLE))"
    return f"{_coded(codec, 'events')} SELECT count(*) AS n, round(avg(abs({d})), 6) AS mae, round(avg({d} * {d}), 6) AS mse, round(max(abs({d})), 6) AS max_abs FROM coded"


def packed(codec: str) -> str:
    """Hexadecimal of the nibble data of each block."""
    digits = "substr('0123456789ABCDEF', CAST(code AS INTEGER) + 1, 1)"
    return f"{_coded(codec, 'events')}, h AS (SELECT block_id, count(*) AS n, string_agg({digits}, '' ORDER BY idx) AS d FROM coded GROUP BY block_id) SELECT block_id, CAST(n AS INTEGER) AS n, CASE WHEN n % 2 = 1 THEN d || '0' ELSE d END AS data FROM h"


def _le(x: str, width: int) -> str:
    """Hexadecimal of a non-negative integer of `width` bytes, the low byte first."""
    return "(" + " || ".join(f"printf('%02X', CAST(({x}) // {256**k} % 256 AS INTEGER))" for k in range(width)) + ")"


def _float_bits(c: str) -> str:
    return _le(small_float(c, 8, 23), 4)


#: Method number, block size, bytes of a block's scale, bits of a code and tensor-wide column of each flat codec.
_BUFFER = {
    "q8_0": (0, 32, 4, 8, None), "q4_0": (1, 32, 4, 4, None), "bf16": (3, 256, 0, 16, None), "fp16": (4, 256, 0, 16, None), "fp8": (5, 256, 0, 8, "scale"), "fp4": (6, 256, 0, 4, "scale"),
    "mxfp8": (7, 32, 1, 8, None), "mxfp4": (8, 32, 1, 4, None), "nvfp4": (9, 16, 1, 4, "tensor_scale"), "nf4_dq": (10, 64, 1, 4, "dq_scale"), "nf4": (11, 64, 4, 4, None),
}


def buffer(codec: str) -> str:
    """The segments of a flat codec's buffer over the event values: offset and hexadecimal of header, scales and data of each block."""
    method, size, width, bits, tensor = _BUFFER[codec]
    blocks = f"((n + {size - 1}) // {size})"
    counts = {"bf16": [], "fp16": [], "fp8": [], "fp4": []}.get(codec, [blocks, str(size)])
    pointers = 1 if bits == 16 or codec in ("fp8", "fp4") else 2
    struct = " || ".join([_le("n", 8), *(_le(x, 8) for x in counts), *([_float_bits("t"), "'00000000'"] if tensor else []), f"repeat('00', {8 * pointers})"])
    head = 24 + {True: 16, False: 8 + (8 * len(counts)) + 8 * pointers + (8 if tensor else 0)}[bits == 16]
    digit = "substr('0123456789ABCDEF', CAST((code + 16) % 16 AS INTEGER) + 1, 1)"
    one = {4: digit, 8: _le("(code + 256) % 256", 1), 16: _le("code", 2)}[bits]
    data = "CASE WHEN n % 2 = 1 THEN d || '0' ELSE d END" if bits == 4 else "d"
    scale = {0: "''", 1: _le("(any_value(exponent) + 256) % 256" if codec.startswith("mx") else "any_value(scale_code)", 1), 4: _float_bits("any_value(scale)")}[width]
    scales = f"UNION ALL SELECT CAST({head} + block_id * {width} AS BIGINT), s FROM cut" if width else ""
    return f"""{_coded(codec, "events")}, whole AS (SELECT count(*) AS n, {f"any_value({tensor})" if tensor else "0"} AS t FROM coded),
    cut AS (SELECT block_id, count(*) AS n, {scale} AS s, string_agg({one}, '' ORDER BY idx) AS d FROM coded GROUP BY block_id)
    SELECT CAST(0 AS BIGINT) AS offset_bytes, {_le(str(method), 4)} || '00000000' || {_le("n", 8)} || repeat('00', 8) || {struct} AS bytes FROM whole {scales}
    UNION ALL SELECT CAST({head} + {width} * ((SELECT {blocks} FROM whole)) + block_id * {size * bits // 8} AS BIGINT), {data} FROM cut"""


_GRID = f"""{EVENTS}, last AS (SELECT max(idx) AS m FROM ev), grid AS (SELECT unnest(range(0, (m // 256 + 1) * 256)) AS idx FROM last),
    p AS (SELECT g.idx, coalesce(v, 0::FLOAT) AS v, v IS NOT NULL AS real FROM grid g LEFT JOIN ev ON g.idx = ev.idx)"""


def _q2_k_tail(decoded: bool, method: int | None = None) -> str:
    """From b (idx, v, real, and low and scale of the sub-block) to codes or values, or to the segments of the method's buffer."""
    f16, f16v = small_float, small_float_value
    byte = "f.idx % 256 // 128 * 32 + f.idx % 32"
    segments = f"""g AS (SELECT idx // 256 AS b, {byte} AS k, CAST(sum(code * pow(4, idx % 128 // 32)) AS INTEGER) AS byte FROM f GROUP BY 1, 2), h AS (SELECT b, string_agg({_le("byte", 1)}, '' ORDER BY k) AS d FROM g GROUP BY b),
    i AS (SELECT idx // 256 AS b, any_value(super_scale) AS ss, any_value(super_min) AS sm, string_agg({_le("scale_code", 1)}, '' ORDER BY idx) AS c FROM f WHERE idx % 16 = 0 GROUP BY 1), n AS (SELECT count(*) AS n FROM ev)
    SELECT CAST(0 AS BIGINT) AS offset_bytes, {_le(str(method), 4)} || '00000000' || {_le("n", 8)} || repeat('00', 8) || {_le("n", 8)} || {_le("(n + 255) // 256 * 256", 8)} || {_le("(n + 255) // 256", 4)} || repeat('00', 12) AS bytes FROM n
    UNION ALL SELECT CAST(56 + i.b * 84 AS BIGINT), {_le("ss", 2)} || {_le("sm", 2)} || c || d FROM i JOIN h ON i.b = h.b"""
    tail = segments if method is not None else "SELECT idx, CAST(v AS DOUBLE) AS v, CAST(CAST(sub_min + CAST(sub_scale * CAST(code AS FLOAT) AS FLOAT) AS FLOAT) AS DOUBLE) AS decoded FROM f WHERE real" if decoded else "SELECT idx, super_scale, super_min, scale_code, code FROM f WHERE real"
    return f"""c AS (SELECT *, max(scale) OVER (PARTITION BY idx // 256) AS top, max(abs(low)) OVER (PARTITION BY idx // 256) AS top_min FROM b),
    c2 AS (SELECT *, CAST(top / 15::FLOAT AS FLOAT) AS s15, CAST(top_min / 7::FLOAT AS FLOAT) AS m7 FROM c),
    d AS (SELECT *, CASE WHEN top > 0 THEN {f16("s15", 5, 10)} ELSE 0 END AS super_scale, CASE WHEN top_min > 0 THEN {f16("m7", 5, 10)} ELSE 0 END AS super_min,
      CASE WHEN top > 0 THEN CAST(round_even(CAST(CAST(15::FLOAT / top AS FLOAT) * scale AS FLOAT), 0) AS INTEGER) ELSE 0 END AS sl,
      CASE WHEN top_min > 0 THEN CAST(greatest(least(round_even(CAST(CAST(7::FLOAT / top_min AS FLOAT) * low AS FLOAT), 0), 7), -8) AS INTEGER) ELSE 0 END AS ml FROM c2),
    e AS (SELECT *, CAST({f16v("super_scale", 5, 10)} * CAST(sl AS FLOAT) AS FLOAT) AS sub_scale, CAST({f16v("super_min", 5, 10)} * CAST(ml AS FLOAT) AS FLOAT) AS sub_min, sl + ((ml + 16) % 16) * 16 AS scale_code FROM d),
    f AS (SELECT *, CASE WHEN sub_scale > 0 THEN CAST(greatest(least(round_even(CAST(CAST(v - sub_min AS FLOAT) / sub_scale AS FLOAT), 0), 3), 0) AS INTEGER) ELSE 0 END AS code FROM e){", " if method is not None else " "}{tail}"""


def q2_k_fast(decoded: bool, method: int | None = None) -> str:
    return f"""WITH {_GRID}, a AS (SELECT *, min(v) OVER (PARTITION BY idx // 16) AS low FROM p),
    b AS (SELECT *, CAST(max(CAST(v - low AS FLOAT)) OVER (PARTITION BY idx // 16) / 3::FLOAT AS FLOAT) AS scale FROM a), {_q2_k_tail(decoded, method)}"""


def q2_k_search(decoded: bool, weight: str = "abs(v)", method: int | None = None) -> str:
    """The search over one plain and sixteen least-squares candidates as a recursive query, one round for each candidate; sums are
    float32 from the first element on. weight: of a value v that is not filling."""

    def total(term: str) -> str:
        return f"list_reduce(list_transform(range(1, 17), lambda i: CAST({term} AS FLOAT)), lambda a, b: CAST(a + b AS FLOAT))"

    def codes(inverse: str) -> str:
        return f"list_transform(x, lambda e: CAST(greatest(least(round_even(CAST({inverse} * CAST(e - low AS FLOAT) AS FLOAT), 0), 3), 0) AS FLOAT))"

    def error(scale: str, low: str) -> str:
        return total(f"w[i] * abs(CAST(CAST(CAST({scale} * c[i] AS FLOAT) + {low} AS FLOAT) - x[i] AS FLOAT))")

    f = np.float32
    steps = "[" + ", ".join(repr(float(f(f(f(-0.5) + f(f(0.1) * f(k))) + f(3)))) for k in range(16)) + "]::FLOAT[]"
    minus = lambda a, b, c, d: f"CAST(CAST({a} * {b} AS FLOAT) - CAST({c} * {d} AS FLOAT) AS FLOAT)"
    return f"""WITH RECURSIVE {_GRID}, l AS (SELECT idx // 16 AS sub, list(v ORDER BY idx) AS x, list(CAST(CASE WHEN real THEN {weight} ELSE 0 END AS FLOAT) ORDER BY idx) AS w FROM p GROUP BY 1),
    l1 AS (SELECT *, {total("w[i]")} AS sw, {total("w[i] * x[i]")} AS sx, least(list_min(x), 0::FLOAT) AS low, list_max(x) AS high FROM l),
    l2 AS (SELECT *, high = low AS flat, CASE WHEN high = low THEN 1::FLOAT ELSE CAST(3::FLOAT / CAST(high - low AS FLOAT) AS FLOAT) END AS inv FROM l1),
    l3 AS (SELECT *, CAST(1::FLOAT / inv AS FLOAT) AS scale, {codes("inv")} AS c FROM l2),
    s AS (SELECT sub, x, w, sw, sx, high, flat, low, scale, {error("scale", "low")} AS best, 0 AS step FROM l3 UNION ALL
      SELECT sub, x, w, sw, sx, high, flat, CASE WHEN better THEN new_low ELSE low END, CASE WHEN better THEN new_scale ELSE scale END, CASE WHEN better THEN err ELSE best END, step + 1 FROM (
        SELECT *, NOT flat AND det > 0 AND err < best AS better FROM (SELECT *, {error("new_scale", "new_low")} AS err FROM (
        SELECT * EXCLUDE (ns, nl), CASE WHEN nl > 0 THEN CAST(lx / l2 AS FLOAT) ELSE ns END AS new_scale, CASE WHEN nl > 0 THEN 0::FLOAT ELSE nl END AS new_low FROM (
        SELECT *, CASE WHEN det > 0 THEN CAST({minus("sw", "lx", "sx", "l1")} / det AS FLOAT) ELSE 0 END AS ns, CASE WHEN det > 0 THEN CAST({minus("l2", "sx", "l1", "lx")} / det AS FLOAT) ELSE 0 END AS nl FROM (
        SELECT *, {minus("sw", "l2", "l1", "l1")} AS det FROM (SELECT *, {total("w[i] * c[i]")} AS l1, {total("CAST(w[i] * c[i] AS FLOAT) * c[i]")} AS l2, {total("CAST(w[i] * c[i] AS FLOAT) * x[i]")} AS lx FROM (
        SELECT *, {codes("inv")} AS c FROM (SELECT *, CASE WHEN high > low THEN CAST(list_extract({steps}, step + 1) / CAST(high - low AS FLOAT) AS FLOAT) ELSE 0::FLOAT END AS inv FROM s WHERE step < 16)))))))) t),
    b AS (SELECT p.*, s.low, CASE WHEN s.flat THEN 0::FLOAT ELSE s.scale END AS scale FROM p JOIN s ON p.idx // 16 = s.sub AND s.step = 16), {_q2_k_tail(decoded, method)}"""


LONG = "m AS (SELECT CAST(vec_id AS INTEGER) AS row, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS col, CAST(unnest(embedding) AS FLOAT) AS v FROM embeddings)"
RANKED = f"WITH {LONG}, r AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY CASE WHEN isnan(v) THEN '-inf'::FLOAT ELSE abs(v) END DESC, col) AS rank FROM m)"


def topk(kind: str, k: int) -> str:
    return {
        "extract": f"{RANKED} SELECT row, CAST(rank - 1 AS INTEGER) AS rank, col, CAST(v AS DOUBLE) AS v FROM r WHERE rank <= {k}",
        "separate": f"{RANKED} SELECT row, col, CAST(CASE WHEN rank <= {k} THEN 0 ELSE v END AS DOUBLE) AS v FROM r",
        "decompress": f"{RANKED} SELECT row, col, CAST(CASE WHEN rank <= {k} THEN v ELSE 0 END AS DOUBLE) AS v FROM r",
        "apply": f"{RANKED} SELECT row, col, CAST(CASE WHEN rank <= {k} THEN CAST(v + v AS FLOAT) ELSE v END AS DOUBLE) AS v FROM r",
        "roundtrip": f"WITH {LONG} SELECT row, col, CAST(v AS DOUBLE) AS v FROM m",
    }[kind]


GRAM = f"WITH {LONG} SELECT a.col AS i, b.col AS j, round(sum(CAST(a.v AS DOUBLE) * CAST(b.v AS DOUBLE)), 6) AS x FROM m a JOIN m b ON a.row = b.row AND a.col <= b.col GROUP BY 1, 2"
RECONSTRUCT = f"""WITH {LONG}, s AS (SELECT col AS p, sum(CAST(v AS DOUBLE)) AS x FROM m GROUP BY col),
w AS (SELECT a.col, b.col AS p, sum(CAST(a.v AS DOUBLE) * CAST(b.v AS DOUBLE)) / (SELECT count(*) FROM embeddings) AS x FROM m a JOIN m b ON a.row = b.row GROUP BY 1, 2)
SELECT m.row, w.col, round(sum(CAST(m.v AS DOUBLE) * s.x * w.x), 6) AS x FROM m JOIN s ON m.col = s.p JOIN w ON m.col = w.p GROUP BY 1, 2"""
MOMENTS = f"""WITH {LONG}, g AS (SELECT a.col AS i, b.col AS j, sum(CAST(a.v AS DOUBLE) * CAST(b.v AS DOUBLE)) AS x FROM m a JOIN m b ON a.row = b.row GROUP BY 1, 2),
t AS (SELECT 1 AS k, sum(x) AS x FROM g WHERE i = j UNION ALL SELECT 2, sum(x * x) FROM g UNION ALL SELECT 3, sum(a.x * b.x * c.x) FROM g a JOIN g b ON a.j = b.i JOIN g c ON b.j = c.i AND c.j = a.i)
SELECT k, CAST(printf('%.4e', x) AS DOUBLE) AS x FROM t"""
ORTHONORMAL = "SELECT side, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS x FROM (VALUES ('u'), ('v')) t(side), range(64) a(i), range(64) b(j) WHERE i <= j"
NEAR = f"WITH {LONG} SELECT row, col, true AS near FROM m"


def matrix_object(kind: str) -> str:
    """The packed matrix of the embeddings without outliers: 200 bytes of header, then raw rows or one section."""
    bits = small_float("v", 8, 23)
    raw = _le(bits[: -len("AS INTEGER)")] + "AS BIGINT)", 4)
    size, storage, form = ("4 * 64 * n", 1, "FFFFFFFF") if kind == "fp32" else ("48 + 4 * n + 32 * n", 2, "0B000000")
    none = f"repeat('00', {24})"
    # shape, cells; two ratios; no ranks, two iterations, no rank; formats; flags
    fixed = f"{_le('n', 2)} || '4000' || {_le('n * 64', 4)} || repeat('00', 8) || '0000' || '0200' || '0000' || '0000' || 'FFFFFFFF' || 'FFFFFFFF' || '{form}' || repeat('00', 12)"
    head = f"{fixed} || {none} || {none} || {none} || repeat('00', 8) || {_le(size, 8)} || '{storage:02X}' || repeat('00', 7) || {none} || {none} || repeat('00', 8)"
    if kind == "fp32":
        return f"""WITH {LONG}, whole AS (SELECT count(*) AS n FROM embeddings) SELECT CAST(0 AS BIGINT) AS offset_bytes, {head} AS bytes FROM whole
        UNION ALL SELECT CAST(200 + 256 * row AS BIGINT), string_agg({raw}, '' ORDER BY col) FROM m GROUP BY row"""
    digit = "substr('0123456789ABCDEF', CAST(code AS INTEGER) + 1, 1)"
    section = f"'55435451' || '0100' || '0000' || '0B000000' || '00000000' || {_le('n * 64', 8)} || {_le('n', 8)} || {_le('64', 8)} || repeat('00', 8)"
    return f"""{_coded("nf4", "embeddings")}, whole AS (SELECT count(*) AS n FROM embeddings), cut AS (SELECT block_id, {_float_bits("any_value(scale)")} AS s, string_agg({digit}, '' ORDER BY idx) AS d FROM coded GROUP BY block_id)
    SELECT CAST(0 AS BIGINT) AS offset_bytes, {head} AS bytes FROM whole UNION ALL SELECT 200, {section} FROM whole UNION ALL SELECT CAST(248 + 4 * block_id AS BIGINT), s FROM cut
    UNION ALL SELECT CAST(248 + 4 * (SELECT n FROM whole) + 32 * block_id AS BIGINT), d FROM cut"""


def matrix_sizes(cases) -> str:
    """Sizes of packed matrices of 512 x 8192 cells from the sizes of their sections."""
    rows = ", ".join(f"({o!r}::DOUBLE, {e!r}::DOUBLE, {r}, '{u}', '{s}', '{d}')" for o, e, r, u, s, d in cases)

    def section(form: str, n: str) -> str:
        return f"CASE {form} WHEN 'NF4' THEN 48 + 4 * (({n} + 63) // 64) + ({n} + 1) // 2 WHEN 'NF4_DQ' THEN 48 + (({n} + 63) // 64) + ({n} + 1) // 2 ELSE 4 * {n} END"

    topk = lambda c: f"CASE WHEN {c} > 0 THEN 8 + 6 * 512 * greatest(1, CAST(floor(8192 * CAST(CAST({c} AS FLOAT) AS DOUBLE) + 0.5) AS BIGINT)) ELSE 0 END"
    return f"""WITH c(outlier, error, ranks, uv, s, direct) AS (VALUES {rows}),
    z AS (SELECT *, 200 + {topk("outlier")} + {topk("error")} + CASE WHEN ranks > 0 THEN ({section("uv", "(512 * ranks)")}) + ({section("s", "ranks")}) + ({section("uv", "(8192 * ranks)")}) ELSE {section("direct", "(512 * 8192)")} END AS size FROM c)
    SELECT outlier, error, ranks, uv, s, direct, CAST(size AS BIGINT) AS packed_size, round(8.0::DOUBLE * size / (512 * 8192), 6) AS bits FROM z"""


DIRECT_FP32 = f"WITH {LONG} SELECT row, col, CAST(v AS DOUBLE) AS v FROM m"


def direct(codec: str) -> str:
    return f"{_coded(codec, 'embeddings')} SELECT CAST(idx // 64 AS INTEGER) AS row, CAST(idx % 64 AS INTEGER) AS col, CAST(decoded AS DOUBLE) AS v FROM coded"


def outlier_error_nf4(k_outlier: int, k_error: int) -> str:
    return f"""{RANKED}, b AS (SELECT row, col, v, rank <= {k_outlier} AS out, CASE WHEN rank <= {k_outlier} THEN 0::FLOAT ELSE v END AS rest FROM r),
    s AS (SELECT *, max(abs(rest)) OVER (PARTITION BY row) AS top FROM b), t AS (SELECT *, CASE WHEN top > 0 THEN top ELSE 1::FLOAT END AS scale FROM s),
    t2 AS (SELECT *, CAST(rest * CAST(1::FLOAT / scale AS FLOAT) AS FLOAT) AS x FROM t), u AS (SELECT *, {nf4("x")} AS code FROM t2),
    c AS (SELECT *, CAST(scale * {nf4_value("code")} AS FLOAT) AS near FROM u), e AS (SELECT *, CAST(rest - near AS FLOAT) AS err FROM c),
    f AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY abs(err) DESC, col) AS er FROM e),
    g AS (SELECT *, CASE WHEN er <= {k_error} THEN CAST(near + err AS FLOAT) ELSE near END AS one FROM f)
    SELECT row, col, CAST(CASE WHEN out THEN CAST(one + v AS FLOAT) ELSE one END AS DOUBLE) AS v FROM g"""


WAVE = "SELECT CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col, round(CAST(CAST(sin(0.11::DOUBLE * (r * 64 + c)) + cos(0.07::DOUBLE * (r + c)) AS FLOAT) AS DOUBLE), 5) AS v FROM range(128) t(r), range(64) u(c)"
RAMP = "SELECT CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col, c * 0.25::DOUBLE + r * 0.5::DOUBLE AS v FROM range(8) t(r), range(8) u(c)"
SIZES = """WITH c(codec, struct, block, scale, block_bytes, halves) AS (VALUES ('q8_0', 40, 32, 4, 0, 2), ('q4_0', 40, 32, 4, 0, 1), ('q2_k', 32, 256, 84, 0, 0), ('q2_k_fast', 32, 256, 84, 0, 0), ('bf16', 16, 256, 0, 0, 4), ('fp16', 16, 256, 0, 0, 4),
('fp8', 24, 256, 0, 0, 2), ('fp4', 24, 256, 0, 0, 1), ('mxfp8', 40, 32, 1, 0, 2), ('mxfp4', 40, 32, 1, 0, 1), ('nvfp4', 48, 16, 1, 0, 1), ('nf4', 40, 64, 4, 0, 1), ('nf4_dq', 48, 64, 1, 0, 1)), n AS (SELECT count(*) AS n FROM events)
SELECT codec, n AS elements, CAST(24 + struct + scale * ((n + block - 1) // block) + (n * halves + 1) // 2 AS BIGINT) AS bytes, round(8.0::DOUBLE * (24 + struct + scale * ((n + block - 1) // block) + (n * halves + 1) // 2) / n, 6) AS bits FROM c, n"""
LAYOUT = """WITH d AS (SELECT count(*) AS rows FROM embeddings), s AS (SELECT 'direct' AS section, 'NF4' AS storage, CAST(0 AS BIGINT) AS o, 48 + 4 * rows + (rows * 64 + 1) // 2 AS size, 1 AS k, rows FROM d
UNION ALL SELECT 'outlier', 'TOPK', 0, 8 + 6 * rows * 6, 2, rows FROM d UNION ALL SELECT 'error', 'TOPK', 0, 8 + 6 * rows * 3, 3, rows FROM d)
SELECT section, storage, CAST(sum(size) OVER (ORDER BY k) - size AS BIGINT) AS offset_bytes, CAST(size AS BIGINT) AS size, CAST(200 + sum(size) OVER () AS BIGINT) AS packed_size FROM s"""
E4M3 = f"WITH {EVENTS}, x AS (SELECT idx, v, {e4m3('v')} AS code FROM ev) SELECT idx, code, CAST({e4m3_value('code')} AS DOUBLE) AS decoded FROM x"
E2M1 = f"WITH {EVENTS}, w AS (SELECT idx, CAST(v / 16::FLOAT AS FLOAT) AS x FROM ev), y AS (SELECT idx, {e2m1('x')} AS code FROM w) SELECT idx, CAST(code AS INTEGER) AS code, CAST({e2m1_value('code')} AS DOUBLE) AS decoded FROM y"
_BITS = small_float("v", 8, 23)
_ALT = small_float("x", 5, 10).replace(f", {31 * 1024})", ", 32767)")
_ALT_VALUE = f"CAST((CASE WHEN alt >= 32768 THEN -1 ELSE 1 END) * (CASE WHEN alt // 1024 % 32 = 0 THEN (alt % 1024) / 1024.0::DOUBLE * {2.0**-14!r}::DOUBLE ELSE (1 + (alt % 1024) / 1024.0::DOUBLE) * pow(2.0::DOUBLE, alt // 1024 % 32 - 15) END) AS DOUBLE)"
BITS = f"""WITH {EVENTS}, w AS (SELECT idx, v, CAST(least(greatest(CAST(v * 300::FLOAT AS FLOAT), -131008::FLOAT), 131008::FLOAT) AS FLOAT) AS x FROM ev), y AS (SELECT idx, v, {_BITS[: -len("AS INTEGER)")]}AS BIGINT) AS bits, {_ALT} AS alt FROM w)
SELECT idx, bits, CAST(v AS DOUBLE) AS v, CAST(v AS DOUBLE) / 3.0::DOUBLE AS third, alt, {_ALT_VALUE} AS alt_value FROM y"""
_SHIFT1 = "xor(x, x * 8192 % 4294967296)"
_SHIFT2 = f"xor({_SHIFT1}, {_SHIFT1} // 131072)"
_STEP = f"xor({_SHIFT2}, {_SHIFT2} * 32 % 4294967296)"
XORSHIFT = f"""WITH RECURSIVE g(idx, x) AS (SELECT 0, {_STEP} FROM (SELECT CAST({0x13579BDF} AS BIGINT) AS x) UNION ALL SELECT idx + 1, {_STEP} FROM g WHERE idx < 1023)
SELECT CAST(idx // 64 AS INTEGER) AS row, CAST(idx % 64 AS INTEGER) AS col, CAST(CAST(x % 16777216 AS FLOAT) / 16777216::FLOAT * 2::FLOAT - 1::FLOAT AS DOUBLE) AS v FROM g"""


def pair_metrics(pairs: str) -> str:
    d = "(CAST(v AS DOUBLE) - CAST(decoded AS DOUBLE))"
    return f"SELECT count(*) AS n, round(avg(abs({d})), 6) AS mae, round(avg({d} * {d}), 6) AS mse, round(max(abs({d})), 6) AS max_abs FROM ({pairs})"


def compressed_metrics(cells: str) -> str:
    """Errors of cells (row, col, v) against the embeddings."""
    own = "SELECT CAST(vec_id AS INTEGER) AS row, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS col, CAST(CAST(unnest(embedding) AS FLOAT) AS DOUBLE) AS v FROM embeddings"
    return pair_metrics(f"SELECT o.v, c.v AS decoded FROM ({own}) o JOIN ({cells}) c ON o.row = c.row AND o.col = c.col")
