"""MinHash near-duplicates by a signature-coordinate inverted join.

Every distinct shingle set is posted under each (coordinate, minimum) pair of its signature. Pairs that collide in at least
`least` of the coordinates are candidates. Postings are ordered by frequency and only the prefix of a signature that a pair of
`least` collisions cannot avoid is merged; values that occur once are skipped, as they collide with nothing. The candidates
of a posting list form clusters, in which links are confirmed on full shingle sets; only a spanning forest of the confirmed
links leaves a task, never all pairs of a group. A list of more than `BLOCK` is compared block by block, each with a few hubs of the
whole list; only nodes that this leaves outside the list's largest component are then compared with all of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilepress.llm._common import shuffle_partitions, table, text_batches, text_of, written
from tilepress.llm._text import Words, mix, shingles, slices, texts
from tilepress.llm.components import components

WORDS = 5
#: Coordinates of a signature, and collisions of a candidate. At similarity 0.85 a pair has 27.2 collisions on average; the
#: chance of fewer than 16 is below 1e-6 (binomial tail), which is the operator's chance to miss a link.
COORDINATES, LEAST = 32, 16
#: Members of a posting list that one task compares; longer ones are dealt to blocks.
BLOCK = 8192
#: Shingles of a block's full sets together (8 bytes each); clusters of long texts make more blocks.
BLOCK_SHINGLES = 4 << 20


def similar(common: np.ndarray, a: int, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * common >= percent * (a + b - common)


def forest(sets: list[np.ndarray], linked) -> list[tuple[int, int]]:
    """Spanning forest of the links between sorted distinct arrays; linked(common, size, sizes) tells links of one array.

    Breadth first: an array is compared with all arrays not reached yet at once, through an inverted index, so links inside
    what is connected already are never listed.
    """
    n, size = len(sets), np.array([len(s) for s in sets])
    if n < 2:
        return []
    if n == 2:
        common = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(0, 1)] if linked(np.array([common]), int(size[0]), size[1:])[0] else []
    _, place = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), size)
    order = np.argsort(place, kind="stable")
    posted, bounds = owner[order], np.searchsorted(place[order], np.arange(place.max() + 2))
    ends = np.cumsum(size)
    left, edges = np.ones(n, bool), []
    for seed in range(n):
        if not left[seed]:
            continue
        left[seed], queue = False, [seed]
        while queue:
            x = queue.pop()
            mine = place[ends[x] - size[x] : ends[x]]
            low, long = bounds[mine], bounds[mine + 1] - bounds[mine]
            at = np.repeat(low - np.concatenate(([0], np.cumsum(long)[:-1])), long) + np.arange(long.sum())
            common = np.bincount(posted[at], minlength=n)
            hit = np.flatnonzero(left & (common > 0) & linked(common, int(size[x]), size))
            left[hit] = False
            edges += [(x, int(y)) for y in hit]
            queue += hit.tolist()
            if not left.any():
                break
    return edges


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows with equal values in the first columns, from batches sorted by them; holds one run and one batch."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        t = t if rest is None else pa.concat_tables([rest, t])
        columns = [t.column(k).to_numpy() for k in range(keys)]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        first = 0
        for x in change.tolist():
            yield t.slice(first, x - first)
            first = x
        rest = t.slice(first)
    if rest is not None and rest.num_rows:
        yield rest


def _sketches(lower: bool, words: int, coordinates: int):
    rng = np.random.default_rng(4242)
    flips = rng.integers(0, 2**63, coordinates, dtype=np.uint64)
    factors = rng.integers(0, 2**62, coordinates, dtype=np.uint64) * np.uint64(4) + np.uint64(1)

    def of(items: list[bytes], want_sets: bool):
        for a, b in slices(items):
            w = Words(items[a:b], lower)
            h, doc = shingles(w, words)
            bounds = np.searchsorted(doc, np.arange(b - a + 1))
            full = np.flatnonzero(bounds[1:] > bounds[:-1])
            tokens = np.zeros((b - a, coordinates), np.uint64)
            if len(full) and not want_sets:
                for k in range(coordinates):
                    least = np.minimum.reduceat((h ^ flips[k]) * factors[k], bounds[full])
                    tokens[full, k] = mix(least + np.uint64(k + 1))
            m1, m2 = mix(h ^ np.uint64(0x51ED270B9A3F1C77)), mix(h + np.uint64(0x2545F4914F6CDD1D))
            for i in range(b - a):
                lo, hi = bounds[i], bounds[i + 1]
                if lo == hi:
                    yield None, 0, None
                    continue
                own = np.sort(h[lo:hi])
                distinct = own[np.concatenate(([True], own[1:] != own[:-1]))]
                n = len(distinct)
                if n == hi - lo:
                    one, two = m1[lo:hi].sum(), m2[lo:hi].sum()
                else:
                    one, two = mix(distinct ^ np.uint64(0x51ED270B9A3F1C77)).sum(), mix(distinct + np.uint64(0x2545F4914F6CDD1D)).sum()
                yield one.tobytes() + two.tobytes(), n, distinct if want_sets else tokens[i]

    return of


def _spread(m: Column, member: Column) -> Column:
    """Block pairs in which a member of a group of m blocks is compared: [(0, 0)] for one."""
    b = F.pmod(F.xxhash64(member), m).cast("int")
    return F.when(m <= 1, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(
        F.transform(F.sequence(F.lit(0), m - 1), lambda j: F.struct(F.least(b, j).alias("i"), F.greatest(b, j).alias("j")))
    )


#: Ids that are broadcast at most, 8 bytes each.
BROADCAST_IDS = 500_000
#: Members of a large posting list, on average, that every block of it is compared with first.
HUBS = 16


def _first_cells(n: Column, node: Column, block: int) -> Column:
    """Cells (i, j) in which a node of a list of n is compared at first: its own block's, and all of them for the list's hubs."""
    m = F.ceil(n / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64(node), m).cast("int")
    hub = F.pmod(F.xxhash64(node, F.lit(7)), F.ceil(n / F.lit(HUBS))) == 0
    cell = lambda k: F.struct(k.alias("i"), k.alias("j"))
    return F.when(m <= 1, F.array(cell(F.lit(0)))).when(hub, F.transform(F.sequence(F.lit(0), m - 1), cell)).otherwise(F.array(cell(own)))


def _rest_cells(postings: DataFrame, roots: DataFrame, block: int) -> DataFrame:
    """Adds the cells b of what is left of the large lists after the first links. In each list, nodes of its largest component are not
    compared with each other again, as they are connected; every other node is compared with all of the list. So the work grows
    with the square of those others only, and with them times the list."""
    at = postings.join(roots.withColumnRenamed("root", "found"), "node", "left").withColumn("found", F.coalesce("found", "node"))
    sizes = at.groupBy("token", "found").agg(F.count(F.lit(1)).alias("k")).groupBy("token").agg(F.max(F.struct("k", "found")).alias("top"), F.sum("k").alias("all"))
    blocks = lambda n: F.ceil(n / F.lit(block)).cast("int")
    sizes = sizes.select("token", F.col("top.found").alias("largest"), blocks(F.col("all") - F.col("top.k")).alias("others"), blocks(F.col("top.k")).alias("inside")).where("others > 0")
    at = at.join(sizes, "token")
    cell = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    others, inside = F.sequence(F.lit(0), F.col("others") - 1), F.sequence(F.lit(0), F.col("inside") - 1)
    own, own_inside = F.pmod(F.xxhash64("node"), F.col("others")), F.pmod(F.xxhash64("node"), F.col("inside"))
    apart = F.concat(F.transform(others, lambda k: cell(F.least(own, k.cast("long")), F.greatest(own, k.cast("long")))), F.transform(inside, lambda k: cell(own, F.col("others") + k)))
    together = F.transform(others, lambda k: cell(k, F.col("others") + own_inside))
    return at.withColumn("b", F.explode(F.when(F.col("found") == F.col("largest"), together).otherwise(apart))).drop("found", "largest", "others", "inside")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, words: int = WORDS, coordinates: int = COORDINATES, least: int = LEAST, block: int = BLOCK, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """One row per document row: doc_id, n_shingles, component_id, kept.

    A-Z are lower-cased; a document's set holds its distinct `words`-word shingles (64-bit hashes of them), or its whole
    sequence if it has fewer words. Documents with 100 * intersection >= percent * union are linked; component_id is the
    smallest id reachable. Null, empty and blank texts have the empty set and are linked with nothing. Null ids are never a
    component_id; a document without any id in reach has component_id null and is kept, as is each of several rows that
    repeat the kept id. An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    text_batches(spark)
    sketches = _sketches(True, words, coordinates)
    base = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("text"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(sketches(texts(batch.column(1)), False))
            tokens = [None if x[2] is None else x[2].view(np.int64) for x in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x[0] for x in found], pa.binary()), pa.array([x[1] for x in found], pa.int64()), pa.array(tokens, pa.list_(pa.int64()))],
                names=["doc_id", "cid", "n_shingles", "tokens"],
            )

    sketched = written(base.mapInArrow(sketch, "doc_id long, cid binary, n_shingles long, tokens array<long>"), "near-sketch")
    # one representative of each distinct set: copies meet in a partial aggregate and are never paired
    classes = sketched.where("cid is not null").groupBy("cid").agg(F.min("doc_id").alias("least_id"), F.first("tokens").alias("tokens"), F.first("n_shingles").alias("n_shingles"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "near-classes")

    posted = classes.select("node", "n_shingles", F.explode("tokens").alias("token"))
    often = posted.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = posted.join(often, "token").groupBy("node", "n_shingles").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("shared"))
    shared = written(shared.where(F.size("shared") >= least), "near-shared")
    prefix = F.explode(F.slice("shared", F.lit(1), F.size("shared") - (least - 1))).alias("p")
    postings = shared.select("node", "n_shingles", F.transform("shared", lambda x: x["token"]).alias("tokens"), prefix).select("node", "n_shingles", "tokens", "p.token", "p.n")
    parts = shuffle_partitions(spark)

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enough = lambda common, a, b: common >= least
        for g in groups(batches, 3):
            if g.num_rows < 2:
                continue
            nodes, size = g.column("node").to_numpy(), g.column("n_shingles").to_numpy()
            sets = [np.sort(x) for x in _lists(g.column("tokens"))]
            root = np.arange(len(nodes))
            for a, b in forest(sets, enough):  # breadth first: a is in its tree before b
                root[b] = root[a]
            for r in np.flatnonzero(np.bincount(root, minlength=len(nodes)) > 1):
                own = np.sort(nodes[root == r])
                key = mix(own.astype(np.uint64)).sum().astype(np.int64)
                blocks = max(-(-len(own) // block), min(len(own), -(-int(size[root == r].sum()) // block_shingles)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), key)), pa.array(own), pa.array(np.full(len(own), blocks, np.int32))], names=["cluster", "node", "blocks"])

    def full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x for x in sketches(texts(batch.column(1)), True) if x[0] is not None]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.binary()), pa.array([x[2].view(np.int64) for x in found], pa.list_(pa.int64()))], names=["cid", "set"])

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        linked = lambda common, a, b: similar(common, a, b, percent)
        for g in groups(batches, 3):
            nodes = g.column("node").to_numpy()
            if len(nodes) < 2:
                continue
            sets = [np.sort(x) for x in _lists(g.column("set"))]
            edges = forest(sets, linked)
            if edges:
                a, b = np.array(edges).T
                yield pa.RecordBatch.from_arrays([pa.array(nodes[a]), pa.array(nodes[b])], names=["u", "v"])

    def confirmed(cells: DataFrame, rest: bool = False) -> DataFrame | None:
        """(u, v): a spanning forest of the links between the postings that meet in a cell b of their token's list. Of the rest of large
        lists there may be no candidates, or few: then no text is shuffled for them."""
        lists = cells.select("token", F.col("b.i").alias("i"), F.col("b.j").alias("j"), "node", "tokens", "n_shingles")
        lists = lists.repartition(parts, "token", "i", "j").sortWithinPartitions("token", "i", "j", "node")
        # the same cluster comes from several lists; one is enough
        members = written(lists.mapInArrow(candidates, "cluster long, node long, blocks int").dropDuplicates(["cluster", "node"]), "near-members")
        n = members.select("node").distinct().count() if rest else None
        if n == 0:
            return None
        wanted = classes.join(members.select("node").distinct(), "node").select("node", "cid", "least_id")
        ids = wanted.select("least_id").distinct()
        # else a sort-merge join whatever the sizes: re-planned to a broadcast, the texts are shuffled in vain
        texts_of = base.join(F.broadcast(ids), F.col("doc_id").eqNullSafe(F.col("least_id"))) if rest and n <= BROADCAST_IDS else base.hint("merge").join(ids, F.col("doc_id").eqNullSafe(F.col("least_id")))
        fetched = texts_of.select("doc_id", "text")
        sets = fetched.mapInArrow(full_sets, "cid binary, set array<long>").join(wanted, "cid").select("node", "set").dropDuplicates(["node"])
        clusters = members.join(sets, "node").select("cluster", F.explode(_spread(F.col("blocks"), F.col("node"))).alias("b"), "node", "set")
        clusters = clusters.select("cluster", F.col("b.i").alias("i"), F.col("b.j").alias("j"), "node", "set")
        clusters = clusters.repartition(parts, "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "node")
        return clusters.mapInArrow(confirm, "u long, v long")

    roots = components(confirmed(postings.withColumn("b", F.explode(_first_cells(F.col("n"), F.col("node"), block)))))
    if (shared.agg(F.max(F.array_max(F.transform("shared", lambda x: x["n"])))).first()[0] or 0) > block:
        more = confirmed(_rest_cells(postings.where(F.col("n") > block), roots, block), rest=True)
        if more is not None:
            roots = components(more.unionByName(roots.select(F.col("node").alias("u"), F.col("root").alias("v"))))
    ids = classes.select("node", "cid", "least_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = ids.join(ids.groupBy("root").agg(F.min("least_id").alias("component_id")), "root").select("cid", "component_id")
    out = sketched.select("doc_id", "cid", "n_shingles").join(ids, "cid", "left")
    own = F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, own.isNull()).alias("kept"))


def _lists(column: pa.ChunkedArray) -> Iterator[np.ndarray]:
    for chunk in column.chunks:
        offsets, values = chunk.offsets.to_numpy(), chunk.values.to_numpy()
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            yield values[a:b]


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))


#: The same rows in DuckDB, by a join of all shingles and the reach of every document.
OP8_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
t AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM d WHERE len(ws) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS g FROM t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT p.a, p.b FROM p JOIN n x ON p.a = x.doc_id JOIN n y ON p.b = y.doc_id WHERE 100 * c >= 85 * (x.n + y.n - c)),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN m ON d.doc_id = m.a
"""
