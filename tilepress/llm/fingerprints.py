"""I-Match document fingerprints, native.

Terms outside a band of inverse document frequency are dropped; the others form the lexicon. The lexicon is dealt at random
into subsets of several sizes; per subset, a document's distinct terms are sorted and hashed. Documents are alike in the
share of subsets, among those in which either has a term, whose hashes agree. Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilepress.llm._common import SPACE, shuffle_partitions, table, text_of, written

#: Document frequencies of the band, as shares of all distinct texts (idf from ln 10 to ln 1000). Of a corpus with t distinct terms
#: a document on average, at most t / MIN_SHARE terms reach the lower end, whatever the corpus' size: that bounds the lexicon.
MIN_SHARE, MAX_SHARE = 0.001, 0.1
#: Lexicon terms that are sent to every executor; a larger lexicon is joined by a shuffle instead.
BROADCAST_TERMS = 400_000
#: (number of subsets, share of the lexicon in each); the shares sum to 1. Small subsets tell long texts apart, large ones short ones.
SUBSETS = ((2, 1 / 8), (4, 1 / 16), (8, 1 / 32), (8, 1 / 64), (16, 1 / 256), (32, 1 / 512))
N_SUBSETS = sum(n for n, _ in SUBSETS)
#: Texts of at most so many distinct terms keep all of them, as the band may leave them none.
SHORT = 24
#: So do texts with fewer terms than that in the band, whatever their length.
FEW = 8
_NONE = "-" * 8


def terms(text: Column) -> Column:
    """Distinct lower-cased white-space words; may hold one empty string."""
    return F.array_distinct(F.split(F.lower(text), SPACE))


def lexicon(texts: DataFrame, min_share: float = MIN_SHARE, max_share: float = MAX_SHARE) -> DataFrame:
    """term and df of every term of the column `text` whose document frequency lies in the band; copies count once."""
    n = texts.select(F.xxhash64("text"), F.xxhash64(F.lit(1), "text")).distinct().count()  # 128 bits of each text
    seen = texts.select("text").distinct().select(F.explode(terms(F.col("text"))).alias("term")).where("term != ''").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return written(seen.where((F.col("df") >= min_share * n) & (F.col("df") <= max(max_share * n, 1))), "imatch-lexicon")


def subset_of(term: Column, seed: int) -> Column:
    """Number of the random lexicon subset a term is dealt to, as two digits."""
    r = F.pmod(F.xxhash64(term, F.lit(seed)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    out, low, first = F.lit(N_SUBSETS - 1), 0.0, 0
    bounds = []
    for n, share in SUBSETS:
        bounds.append((low, low + n * share, share, first))
        low, first = low + n * share, first + n
    for a, b, share, start in reversed(bounds):
        out = F.when(r < b, F.least(F.floor((r - a) / share) + start, F.lit(N_SUBSETS - 1))).otherwise(out)
    return F.lpad(out.cast("string"), 2, "0")


def subset_hashes(entries: Column) -> Column:
    """From "NN term" strings, 32 bits of a hash of the sorted terms per subset, in order; dashes where there is none."""
    marks = F.array(*[F.lit(f"{k:02d}\t") for k in range(N_SUBSETS)])
    runs = F.slice(F.split(F.array_join(F.array_sort(F.concat(entries, marks)), " "), "[0-9][0-9]\t"), 2, N_SUBSETS)
    return F.transform(runs, lambda r: F.when(F.trim(r) == "", F.lit(_NONE)).otherwise(F.substring(F.lpad(F.hex(F.xxhash64(F.trim(r))), 16, "0"), 9, 8)))


def likeness(a: Column, b: Column) -> Column:
    """1 for equal fingerprints, else the share of agreeing hashes among the subsets in which either has a term."""
    pairs = F.zip_with(a, b, lambda x, y: F.when((x == _NONE) & (y == _NONE), F.lit(0)).when(x == y, F.lit(1001)).otherwise(F.lit(1)))
    total = F.aggregate(pairs, F.lit(0), lambda s, x: s + x)
    return F.when(a == b, F.lit(1.0)).when(total == 0, F.lit(0.0)).otherwise(F.floor(total / 1000).cast("double") / (total - F.floor(total / 1000) * 1000))


def _bucket(bounds: list[int], value: Column) -> Column:
    """Number of bounds below the value: a two-level search, so that the work per row grows with the root of their number."""
    if not bounds:
        return F.lit(0)
    width = max(1, int(len(bounds) ** 0.5))
    upper = bounds[width - 1 :: width]
    parts = [bounds[k * width : (k + 1) * width] for k in range(len(upper) + 1)]
    lists = F.array(*[F.array(*[F.lit(x).cast("long") for x in p]) if p else F.array().cast("array<bigint>") for p in parts])
    chosen = F.size(F.filter(F.array(*[F.lit(x).cast("long") for x in upper]), lambda x: x < value))
    inside = F.size(F.filter(F.element_at(lists, chosen + 1), lambda x: x < value))
    return F.coalesce(chosen * width + inside, F.lit(0))


def with_next(docs: DataFrame, per_partition: int = 4) -> DataFrame:
    """(bucket, rn, guest, doc_id, text, next_text) in descending id, null ids last, after the last the first.

    Rows are dealt by id range, those without id by ranges of their texts' first bytes; the first row of each range is also a guest
    behind the range before it, so the follower of every row that is not a guest stands in its own range and no global order is
    needed.
    """
    spark = docs.sparkSession
    n = shuffle_partitions(spark) * per_partition
    start = F.conv(F.rpad(F.hex(F.substring(F.col("text").cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("long")
    docs = docs.withColumn("lone", F.when(F.col("doc_id").isNull(), start))  # in the order of the texts
    shares = F.array(*[F.lit(k / n) for k in range(1, n)])
    found = docs.select(F.percentile_approx("doc_id", shares, F.lit(10_000)), F.percentile_approx("lone", shares, F.lit(10_000))).first() if n > 1 else ([], [])
    by_id, by_text = (sorted(set(x or [])) for x in found)
    own = F.when(F.col("lone").isNull(), _bucket(by_id, F.col("doc_id"))).otherwise(F.lit(-1) - _bucket(by_text, F.col("lone"))).cast("int")
    firsts = docs.select(own.alias("bucket"), "doc_id", "lone").groupBy("bucket").agg(F.max("doc_id").alias("head"), F.min("lone").alias("head_lone"))
    heads = {r.bucket: (r.head, r.head_lone) for r in firsts.collect()}  # one row per range
    order = sorted(heads)
    guests = [(*heads[b], order[(i + 1) % len(order)]) for i, b in enumerate(order)]
    guest_rows = F.broadcast(spark.createDataFrame(guests, "head long, head_lone long, at int"))
    rows = docs.join(guest_rows, F.col("doc_id").eqNullSafe(F.col("head")) & F.col("lone").eqNullSafe(F.col("head_lone")), "left").withColumn("own", own)
    places = F.when(F.col("at").isNull(), F.array(F.struct(F.col("own").alias("bucket"), F.lit(0).alias("guest")))).otherwise(
        F.array(F.struct(F.col("own").alias("bucket"), F.lit(0).alias("guest")), F.struct(F.col("at").alias("bucket"), F.lit(1).alias("guest")))
    )
    rows = rows.select("doc_id", "text", F.explode(places).alias("p")).select("p.bucket", "p.guest", "doc_id", "text")
    w = Window.partitionBy("bucket").orderBy("guest", F.col("doc_id").desc_nulls_last(), "text")
    return rows.withColumn("rn", F.row_number().over(w)).withColumn("next_text", F.coalesce(F.lead("text").over(w), F.lit("")))


def imatch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 11, lexicon_of: DataFrame | None = None) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next document,
    in descending id. fingerprint: the subsets' hashes, joined. Null is the empty text; texts without terms have the
    fingerprint without hashes, which is alike to itself and to nothing else. Repeated ids follow each other in text order;
    null ids come last. An empty table gives no rows. lexicon_of: (term) to use instead of the documents' own band.
    """
    base = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("text"))
    lex = lexicon_of if lexicon_of is not None else lexicon(base)
    lex = lex.select("term", subset_of(F.col("term"), seed).alias("subset"))
    if lex.count() <= BROADCAST_TERMS:
        lex = F.broadcast(lex)
    rows = with_next(base)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.select("bucket", "rn", "guest", "doc_id", n.cast("long").alias("n_chars"), F.array(F.col("text"), F.when(F.col("guest") == 0, edited).otherwise(F.lit(""))).alias("versions"))
    rows = rows.select("bucket", "rn", "guest", "doc_id", "n_chars", F.posexplode("versions").alias("version", "text"))
    rows = rows.select("bucket", "rn", "guest", "doc_id", "n_chars", "version", F.sha2(F.col("text").cast("binary"), 256).alias("sha"), terms(F.col("text")).alias("terms"))
    rows = rows.withColumn("short", F.size("terms") <= SHORT)
    rows = rows.select("bucket", "rn", "version", "short", "guest", "doc_id", "n_chars", "sha", F.posexplode("terms").alias("pos", "term"))
    rows = rows.join(lex, "term", "left")
    subset = F.coalesce(F.col("subset"), F.when(F.col("term") != "", subset_of(F.col("term"), seed)))
    banded = F.col("subset").isNotNull()
    first = F.col("pos") == 0
    rows = rows.select(
        "bucket", "rn", "version", F.when(first, F.col("guest")).alias("guest"), F.when(first, F.col("doc_id")).alias("doc_id"), F.when(first, F.col("n_chars")).alias("n_chars"),
        F.when(first & (F.col("version") == 1), F.col("sha")).alias("sha"), F.concat(subset, F.lit(" "), F.col("term")).alias("entry"), banded.alias("banded"),
        F.when(first, F.col("short")).alias("short"),
    )
    per_doc = rows.groupBy("bucket", "rn").agg(
        F.max("guest").alias("guest"), F.max("doc_id").alias("doc_id"), F.max("n_chars").alias("n_chars"), F.max("sha").alias("edited_sha256"),
        *[F.collect_list(F.when((F.col("version") == v) & (F.col("banded") == b), F.col("entry"))).alias(f"{name}_{'in' if b else 'out'}") for v, name in ((0, "own"), (1, "edited")) for b in (True, False)],
        *[F.max(F.when(F.col("version") == v, F.col("short"))).alias(f"{name}_short") for v, name in ((0, "own"), (1, "edited"))],
    )
    # a text with few terms in the band keeps all; its edited version does likewise, so that the two can be compared
    own_all = F.col("own_short") | (F.size("own_in") < FEW)
    edited_all = own_all | F.col("edited_short") | (F.size("edited_in") == 0)
    own, edited = (F.when(whole, F.concat(f"{name}_in", f"{name}_out")).otherwise(F.col(f"{name}_in")) for name, whole in (("own", own_all), ("edited", edited_all)))
    prints = per_doc.select("bucket", "rn", "guest", "doc_id", "n_chars", "edited_sha256", subset_hashes(own).alias("own"), subset_hashes(edited).alias("edited"))
    w = Window.partitionBy("bucket").orderBy("rn")
    prints = prints.withColumn("next", F.coalesce(F.lead("own").over(w), "own")).where("guest = 0")
    return prints.select(
        "doc_id", "n_chars", "edited_sha256", F.array_join("own", "").alias("fingerprint"), F.array_join("edited", "").alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"),
    )


def op2_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch(table(spark, sf_dir, "documents"))
