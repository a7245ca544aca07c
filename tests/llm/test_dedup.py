"""Exact, near and substring deduplication against brute force."""

import hashlib
import re

import numpy as np
import pytest
from conftest_llm import LONG, ODD, frame, words
from pyspark.sql import functions as F

from tilepress.llm.bpe import _GEAR, gear_cuts
from tilepress.llm.components import components
from tilepress.llm.exact_dedup import exact_dedup
from tilepress.llm.near_dedup import forest, near_dedup
from tilepress.llm.substring_dedup import chunk_ends, substring_dedup

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def exact_model(pairs):
    norm = [(d, SPACE.sub(" ", t or "")) for d, t in pairs]
    out = []
    for d, t in norm:
        ids = [x for x, u in norm if u == t and x is not None]
        out.append((d, min(ids) if ids else None, sum(u == t for _, u in norm), hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


def weak(text):
    return F.crc32(text.cast("binary")).bitwiseAND(F.lit(1)).cast("string")


@pytest.mark.parametrize("digest", [None, weak])
def test_exact(odd, digest):
    got = exact_dedup(odd, digest=digest).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=str) == exact_model(ODD)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got}) and all(r.doc_id == r.keep_id for r in kept)


def test_exact_stream_goes_on(spark, tmp_path):
    state = str(tmp_path / "state")
    exact_dedup(frame(spark, [(5, "a"), (6, "b")]), state_dir=state, max_bytes=1).collect()
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup(frame(spark, [(2, "a"), (7, "c")]), state_dir=state, max_bytes=1).collect()}
    assert got[2] == (2, 2, True) and got[5] == (2, 2, False) and got[7] == (7, 1, True)


def test_exact_stream_compares_bytes_with_earlier_rows(spark, tmp_path):
    """Digests collide between runs; null and repeated ids; rows that come from no file."""
    state, one, two = str(tmp_path / "state"), [(5, "a"), (6, "b"), (None, "c"), (None, "c")], [(2, "a"), (2, "d"), (None, "e"), (7, "c"), (7, "c")]
    exact_dedup(frame(spark, one), state_dir=state, digest=weak).collect()
    got = exact_dedup(frame(spark, two), state_dir=state, digest=weak).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=str) == exact_model(one + two)
    assert sum(r.kept for r in got) == 5


def test_exact_many_rows_without_id(spark):
    pairs = [(None, f"t{i % 300}") for i in range(900)]
    got = exact_dedup(frame(spark, pairs)).collect()
    assert len(got) == 900 and {r.group_size for r in got} == {3} and sum(r.kept for r in got) == 300


def shingle_set(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near_model(pairs):
    sets = [shingle_set(t) for _, t in pairs]
    root = list(range(len(pairs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(pairs)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                root[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(pairs):
        ids = [pairs[j][0] for j in range(len(pairs)) if find(j) == find(i) and pairs[j][0] is not None]
        out.append((d, len(sets[i]), (min(ids) if ids else None) if sets[i] else d))
    return sorted(out, key=str)


def check_near(docs, pairs, **more):
    got = near_dedup(docs, **more).collect()
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got], key=str) == near_model(pairs)
    assert all(r.kept == (r.component_id is None or r.doc_id == r.component_id) for r in got)


def test_near_odd(odd):
    check_near(odd, ODD)


def chain():
    """A long chain in which neighbours are linked and others mostly not, twice, with copies."""
    base = words(3, 200, 10_000).split()
    out = []
    for k in range(40):
        own = list(base)
        for i in range(k):
            own[i * 5 % 200] = f"z{i}"
        out += [(1000 - k, " ".join(own)), (2000 + k, " ".join(own) + " tail")]
    return out + [(3000 + k, out[k][1]) for k in range(10)]


@pytest.mark.parametrize("block", [8192, 7])
def test_near_chain(spark, block):
    pairs = chain()
    check_near(frame(spark, pairs), pairs, block=block)


def test_near_clusters_of_long_texts_make_more_blocks(spark):
    pairs = chain()
    check_near(frame(spark, pairs), pairs, block_shingles=1000)


def test_forest_spans_what_all_pairs_span():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, 25)) for _ in range(60)]
    linked = lambda c, a, b: 100 * c >= 45 * (a + b - c)
    root = list(range(60))
    for a, b in forest(sets, linked):
        root = [root[a] if r == root[b] else r for r in root]
    model = list(range(60))
    for i in range(60):
        for j in range(i):
            c = len(np.intersect1d(sets[i], sets[j]))
            if 100 * c >= 45 * (len(sets[i]) + len(sets[j]) - c):
                model = [model[j] if r == model[i] else r for r in model]
    assert all((root[i] == root[j]) == (model[i] == model[j]) for i in range(60) for j in range(60))
    assert len(set(root)) < 60


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 31)}, 101: 100, 102: 100}


def test_gear_cuts_do_not_shift():
    a, b = words(4, 3000).encode(), b"inserted " + words(4, 3000).encode()
    x, y = set(gear_cuts(a).tolist()), {c - 9 for c in gear_cuts(b).tolist()}
    assert {c for c in x if c > 64} == {c for c in y if c > 64}
    assert chunk_ends(b"") == [] and chunk_ends(a)[-1] == len(a)


def model_chunks(data):
    """Chunks by the classic loop: a 32-bit gear hash, one byte after the other."""
    ends, last, h = [], 0, 0
    for i, b in enumerate(data):
        h = ((h << 1) + int(_GEAR[b])) & 0xFFFFFFFF
        if h >> 27:  # the five highest bits: one byte in 32
            continue
        cut = i + 1
        while cut < len(data) and data[cut] & 0xC0 == 0x80:
            cut += 1
        if cut - last >= 16 and cut < len(data):
            ends.append(cut)
            last = cut
    return ends + [len(data)] if len(data) > last else ends


def substring_model(pairs, least=64):
    """Per row: chunks, removed chunks, and removed runs; first occurrences by (id, row, position) stay."""
    order = sorted(range(len(pairs)), key=lambda i: (pairs[i][0] is None, pairs[i][0] or 0, i))
    seen, out = set(), {}
    for i in order:
        data, last, runs = (pairs[i][1] or "").encode(), 0, []
        ends = model_chunks(data)
        for e in ends:
            if data[last:e] in seen:
                if runs and runs[-1][1] == last:
                    runs[-1] = (runs[-1][0], e, runs[-1][2] + 1)
                else:
                    runs.append((last, e, 1))
            seen.add(data[last:e])
            last = e
        runs = [r for r in runs if r[1] - r[0] >= least]
        out[i] = (pairs[i][0], len(ends), sum(r[2] for r in runs), sum(r[1] - r[0] for r in runs), ",".join(f"{a}:{b}" for a, b, _ in runs))
    return sorted(out.values(), key=str)


@pytest.mark.parametrize("hot", [1 / 4096, 0.0])
def test_substrings_against_model(spark, hot):
    """Every digest is hot where the share is 0."""
    a, b = words(50, 90, 10_000), words(51, 120, 10_000)
    pairs = [(i, f"{words(60 + i, 30)} {a if i % 2 else b} {words(90 + i, 20 + i)}") for i in range(30)] + [(40, "na " * 900), (41, "na " * 900), (42, LONG), (None, LONG[:5000]), (43, LONG[2000:9000]), (44, None), (45, ""), (46, "é" * 300)]
    got = substring_dedup(frame(spark, pairs), hot_share=hot, outputs=True).collect()
    assert sorted([(r.doc_id, r.n_chunks, r.n_repeated, r.removed_bytes, r.spans) for r in got], key=str) == substring_model(pairs)
    text = dict(pairs)
    for r in got:
        data, left, last = (text[r.doc_id] or "").encode(), b"", 0
        for x, y in (map(int, z.split(":")) for z in r.spans.split(",") if z):
            left, last = left + data[last:x], y
        assert r.text.encode() == left + data[last:]


def test_substrings(spark, odd):
    passage = words(5, 80, 10_000)
    pairs = [(1, words(6, 100) + " " + passage + " " + words(7, 100)), (2, words(8, 50) + " x " + passage + " y " + words(9, 60)), (3, words(10, 90)), (4, None), (5, "é" * 300)]
    got = {r.doc_id: r for r in substring_dedup(frame(spark, pairs), outputs=True).collect()}
    assert got[1].removed_bytes == got[3].removed_bytes == got[5].removed_bytes == 0 and got[2].removed_bytes > 0.5 * len(passage)
    data = pairs[1][1].encode()
    cut = b"".join(data[a:b] for a, b in (map(int, s.split(":")) for s in got[2].spans.split(",")))
    assert cut.decode() in passage and len(got[2].text.encode()) == len(data) - got[2].removed_bytes
    assert substring_dedup(odd).count() == len(ODD)


def test_passages_of_just_over_50_words(spark):
    """Every passage with a repeated chunk of average length loses it; only those that hardly hold two cuts stay."""
    passages = [words(1000 + i, 51 + i % 10, 2_000) for i in range(300)]
    pairs = [(k * 1000 + i, f"{words(2000 + k * 1000 + i, 30, 2_000)} {p} {words(7000 + k * 1000 + i, 30, 2_000)}") for k in (0, 1) for i, p in enumerate(passages)]
    got = {r.doc_id: r for r in substring_dedup(frame(spark, pairs)).collect()}
    for d, text in pairs[300:]:
        data = text.encode()
        cut = [data[a:b].decode() for a, b in (map(int, s.split(":")) for s in got[d].spans.split(",") if s)]
        assert all(c in pairs[d - 1000][1] for c in cut)
    assert sum(got[d].removed_bytes == 0 for d, _ in pairs[300:]) <= 0.05 * 300
    assert not any(got[d].removed_bytes for d, _ in pairs[:300])


def test_empty(empty):
    assert exact_dedup(empty).collect() == near_dedup(empty).collect() == substring_dedup(empty).collect() == []
