"""Secret scans through an incremental ledger of content-addressed blobs.

Every version of a document is a blob named by the digest of its bytes. The ledger holds (blob, rule, rule version,
findings); a run scans one representative of each blob only for the rule versions that the ledger does not hold yet, then
joins the findings back to all documents ("paths") that carry the blob.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilepress.llm._common import scratch, table, text_batches, text_of, written


@dataclass(frozen=True)
class Rule:
    """pattern: leftmost non-overlapping matches; a match is dropped when the group has fewer than least characters.
    hint: an RE2 pattern without which a text cannot hold a match that stays."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int
    hint: str


#: The three base kinds, in their order.
RULES = (
    Rule("assign", 1, r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, r"(?i)(?:passw|secret|token|api_?key)[a-z]*[\"']?\x20*[:=]"),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 16, r"AKIA[A-Z0-9]{12}"),
    Rule("hex", 1, r"[0-9a-f]+", 0, 32, r"[0-9a-f]{32}"),
)


def scan(text: str, rules=RULES) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start, then the rules' order."""
    found = []
    for order, rule in enumerate(rules):
        # a run of 32 or more is a whole maximal run, so the counted form finds the same spans without the short ones
        pattern = r"[0-9a-f]{32,}" if rule.pattern == r"[0-9a-f]+" and rule.least == 32 else rule.pattern
        for m in re.finditer(pattern, text):
            if m.end(rule.group) - m.start(rule.group) >= rule.least:
                found.append((m.start(), order, m.end(), rule.kind))
    return [(a, b, kind) for a, _, b, kind in sorted(found)]


LEDGER = "blob string, rule string, version int, spans array<struct<start: int, end: int>>"


def scan_secrets(docs: DataFrame, ledger: str | None = None, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: doc_id, blob, n_<kind> for each rule, spans (kind:start:end by start, then rule order).

    ledger: folder of the ledger, kept between runs; by default a new one. Blobs that it holds are not scanned again for the
    same rule version; a rule with a new version is scanned over all blobs. Spans are half open, in code points.
    Null and empty texts have no findings. Null ids stay null. Repeated rows give repeated rows; an empty table gives none.
    """
    spark = docs.sparkSession
    text_batches(spark)
    ledger = ledger or scratch(spark, "secret-ledger")
    base = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("text"))
    blob = F.sha2(F.col("text").cast("binary"), 256)
    paths = written(base.select("doc_id", blob.alias("blob")), "secret-paths")
    known = _read(spark, ledger)
    wanted = spark.createDataFrame([(r.kind, r.version) for r in rules], "rule string, version int")
    # blob x rule version pairs without a ledger row; the number of rules is fixed
    blobs = paths.groupBy("blob").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id")).alias("first"))
    if known is None:
        unseen = blobs.withColumn("todo", F.lit(",".join(r.kind for r in rules)))
    else:
        held = known.join(F.broadcast(wanted), ["rule", "version"], "left_semi").groupBy("blob").agg(F.collect_set("rule").alias("held"))
        unseen = (
            blobs.join(held, "blob", "left")
            .withColumn("todo", F.array_except(F.array(*[F.lit(r.kind) for r in rules]), F.coalesce("held", F.array().cast("array<string>"))))
            .where(F.size("todo") > 0)
            .withColumn("todo", F.array_join("todo", ","))
        )
    unseen = unseen.select("blob", F.col("first.doc_id").alias("doc_id"), "todo")
    new = _scan_blobs(base, unseen, rules)
    new.write.mode("append").parquet(f"{ledger}/entries")
    entries = _read(spark, ledger).join(F.broadcast(wanted), ["rule", "version"], "left_semi").dropDuplicates(["blob", "rule"])
    return _join_back(paths, entries, rules)


def _read(spark: SparkSession, ledger: str) -> DataFrame | None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{ledger}/entries")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema(LEDGER).parquet(f"{ledger}/entries")


def _scan_blobs(base: DataFrame, unseen: DataFrame, rules) -> DataFrame:
    """Ledger rows of the unseen blobs: fetches the document of each by id and digest, so ids that repeat or are null meet only their
    own blob, and scans it."""
    held = base.withColumn("held", F.sha2(F.col("text").cast("binary"), 256))
    wanted = unseen.select(F.col("doc_id").alias("want"), "blob", "todo")
    texts = held.join(wanted, (F.col("held") == F.col("blob")) & F.col("doc_id").eqNullSafe(F.col("want"))).select("blob", "todo", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hinted = {r.kind: pc.match_substring_regex(batch.column(2), r.hint).to_pylist() for r in rules}
            out = []
            text = batch.column(2)
            for i, (blob, todo) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                for r in rules:
                    if r.kind in todo.split(","):
                        spans = scan(text[i].as_py(), (r,)) if hinted[r.kind][i] else []
                        out.append({"blob": blob, "rule": r.kind, "version": r.version, "spans": [{"start": a, "end": b} for a, b, _ in spans]})
            schema = pa.schema([("blob", pa.string()), ("rule", pa.string()), ("version", pa.int32()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return texts.mapInArrow(run, LEDGER)


def _join_back(paths: DataFrame, entries: DataFrame, rules) -> DataFrame:
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    some = entries.where(F.size("spans") > 0)
    flat = some.select("blob", "rule", F.explode("spans").alias("s"))
    per_blob = flat.groupBy("blob").agg(
        F.array_sort(F.collect_list(F.struct(F.col("s.start").alias("start"), order[F.col("rule")].alias("order"), F.col("s.end").alias("end"), "rule"))).alias("found"),
        *[F.count_if(F.col("rule") == r.kind).alias(f"n_{r.kind}") for r in rules],
    )
    spans = F.array_join(F.transform("found", lambda s: F.concat_ws(":", s["rule"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    per_blob = per_blob.select("blob", *[f"n_{r.kind}" for r in rules], spans.alias("spans"))
    counts = [F.coalesce(F.col(f"n_{r.kind}"), F.lit(0)).alias(f"n_{r.kind}") for r in rules]
    return paths.join(per_blob, "blob", "left").select("doc_id", "blob", *counts, F.coalesce("spans", F.lit("")).alias("spans"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("spans").cast("binary"), 256).alias("base_sha256"), "spans")


def _op7_sql() -> str:
    """The base kinds in DuckDB: all matches of a kind and the texts between them, whose lengths give the places."""
    letters = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else f"{c}?" for c in word) for word in ("password", "passwd", "secret", "token", "api_key"))
    sign = r"""["']?\x20*[:=]\x20*["']?"""
    kinds = {
        "assign": (f"(?:{letters}){sign}[A-Za-z0-9+/_.=-]+", f"^(?:{letters}){sign}([A-Za-z0-9+/_.=-]+)$", 8),
        "access": ("AKIA[A-Z0-9]+", "(.+)", 16),
        "hex": ("[0-9a-f]+", "(.+)", 32),
    }
    q = lambda x: "'" + x.replace("'", "''") + "'"
    parts = []
    for order, (kind, (pattern, counted, least)) in enumerate(kinds.items()):
        parts.append(
            f"""SELECT doc_id, '{kind}' AS kind, {order} AS o, s - length(m) AS a, s AS b FROM (
            SELECT doc_id, m, sum(length(g) + length(m)) OVER (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS s FROM (
            SELECT doc_id, generate_subscripts(ms, 1) AS k, unnest(ms) AS m, unnest(gs[1:len(ms)]) AS g FROM (
            SELECT doc_id, regexp_extract_all(t, {q(pattern)}) AS ms, regexp_split_to_array(t, {q(pattern)}) AS gs FROM d) WHERE len(ms) > 0))
            WHERE length(regexp_extract(m, {q(counted)}, 1)) >= {least}"""
        )
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({" UNION ALL ".join(parts)}),
    g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
      string_agg(kind || ':' || CAST(a AS BIGINT) || ':' || CAST(b AS BIGINT), ',' ORDER BY a, o) AS spans FROM f GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM d LEFT JOIN g ON d.doc_id = g.doc_id"""


#: The same rows in DuckDB.
OP7_SQL = _op7_sql()
