"""Line dedup: content-defined chunks of lines, in DataFrame operations only.

A document's lines are hashed; a rolling hash covers each line and the one before
it; a chunk ends after a line whose rolling hash is a strict local minimum.  The
boundary depends on the neighbouring lines only, so a passage that repeats in
another document or at another place is cut the same way but for its edges, and
every chunk but the first and last of a document has two lines at least.

Chunks whose 64-bit hash occurs more than once are candidates (hashes only are
shuffled, combined before the exchange).  Candidate chunks are then grouped by
their text itself, which is the byte comparison; of equal chunks the first
(smallest document, then position) stays and the others are removed.  Lookups of a
chunk's first occurrence go through (run, chunk) keys, runs being a hash of the
document, so that a chunk which a third of all documents share is spread out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_keys, stored, tasks, text_of

#: base of the rolling hash over two line hashes of 28 bits
ROLL_BASE = 31


def line_hash(line: Column) -> Column:
    """28 bits of the line's MD5."""
    return F.conv(F.substring(F.md5(line), 1, 7), 16, 10).cast("long")


def with_chunks(rows: DataFrame) -> DataFrame:
    """Adds ``_lines`` (array) and ``_ends`` (1-based last line of each chunk) to rows with ``_text``."""
    hashed = rows.withColumn("_lines", F.split("_text", "\n", -1)) \
        .withColumn("_h", F.transform("_lines", line_hash))
    rolled = hashed.withColumn("_r", F.transform(
        "_h", lambda h, i: F.when(i == 0, h).otherwise(F.col("_h")[i - 1] * ROLL_BASE + h)))
    n = F.size("_lines")
    inner = F.filter(
        F.when(n > 2, F.sequence(F.lit(2), n - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: (F.col("_r")[i - 1] < F.col("_r")[i - 2]) & (F.col("_r")[i - 1] < F.col("_r")[i]))
    return rolled.withColumn("_ends", F.concat(inner, F.array(n))).drop("_h", "_r")


def _chunk_at(k: Column) -> Column:
    start = F.when(k == 0, F.lit(0)).otherwise(F.col("_ends")[k - 1])
    return F.struct(
        k.cast("int").alias("_pos"), (F.col("_ends")[k] - start).alias("_n_lines"),
        F.array_join(F.slice("_lines", start + 1, F.col("_ends")[k] - start), "\n").alias("_chunk"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 2,
               carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: ``doc_id, text, n_lines, n_removed`` with later copies of repeated chunks cut out.

    Columns named in ``carry`` follow unchanged.

    Lines end at a line feed; a null text counts as empty, and an empty text is one empty line.
    Only chunks of ``min_lines`` lines or more are compared.  The first occurrence stays: smallest
    doc_id (null first), then hash of the document's text, then position.  Rows that repeat both
    doc_id and text count as one occurrence and get the same result.  Other columns are ignored,
    whatever their names; an empty table gives an empty result.
    """
    runs = tasks(docs.sparkSession)
    carried = F.struct(*[F.col(c) for c in carry]) if carry else F.lit(None)
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"), carried.alias("_carry")).select(
        "_id", F.xxhash64("_text").alias("_key"), "_text", "_carry")
    chunked = with_chunks(rows).select("_id", "_key", F.explode(
        F.transform(F.sequence(F.lit(0), F.size("_ends") - 1), _chunk_at)).alias("_c")) \
        .select("_id", "_key", "_c.*").where(F.col("_n_lines") >= min_lines) \
        .withColumn("_hash", F.xxhash64("_chunk"))
    repeated = stored(chunked.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_hash"))

    spot = F.struct(F.col("_id").alias("i"), F.col("_key").alias("k"), F.col("_pos").alias("p"))
    found = join_keys(chunked, repeated, "_hash", "left_semi").select(
        F.pmod(F.xxhash64("_id", "_key"), F.lit(runs)).cast("int").alias("_run"), "_hash", "_chunk",
        "_id", "_key", "_pos")
    leaves = found.groupBy("_run", "_hash", "_chunk").agg(F.min(spot).alias("_first"))
    top = leaves.groupBy("_hash", "_chunk").agg(F.min("_first").alias("_first"))
    down = leaves.select("_run", "_hash", "_chunk").join(top, ["_hash", "_chunk"])
    later = found.join(down, ["_run", "_hash", "_chunk"]).where(spot > F.col("_first")) \
        .groupBy("_id", "_key").agg(F.collect_set("_pos").alias("_drop"))

    later = later.select(F.col("_id").alias("_id2"), F.col("_key").alias("_key2"), "_drop")
    joined = rows.join(later, rows["_id"].eqNullSafe(later["_id2"]) & (rows["_key"] == later["_key2"]), "left")
    cut = with_chunks(joined.select("_id", "_text", "_carry", "_drop"))
    start = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.col("_ends")[k - 1])
    kept = F.flatten(F.transform(
        F.filter(F.sequence(F.lit(0), F.size("_ends") - 1), lambda k: ~F.array_contains("_drop", k)),
        lambda k: F.slice("_lines", start(k) + 1, F.col("_ends")[k] - start(k))))
    cut = cut.withColumn("_kept", F.when(F.col("_drop").isNull(), F.col("_lines")).otherwise(kept))
    return cut.select(
        F.col("_id").alias("doc_id"), F.array_join("_kept", "\n").alias("text"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size("_kept")).cast("long").alias("n_removed"),
        *[F.col("_carry")[c].alias(c) for c in carry])


def oracle_sql() -> str:
    """DuckDB: the same definition by windows over line rows, chunk texts grouped directly."""
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
u AS (SELECT doc_id, t, unnest(string_split(t, chr(10))) AS line,
             generate_subscripts(string_split(t, chr(10)), 1) AS pos FROM d),
h AS (SELECT doc_id, line, pos, ('0x' || substr(md5(line), 1, 7))::BIGINT AS h FROM u),
r AS (SELECT *, CASE WHEN pos = 1 THEN h ELSE lag(h) OVER w * {ROLL_BASE} + h END AS r FROM h
      WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
e AS (SELECT *, coalesce(r < lag(r) OVER w AND r < lead(r) OVER w, FALSE) AS is_end FROM r
      WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
g AS (SELECT *, coalesce(sum(is_end::INT) OVER (PARTITION BY doc_id ORDER BY pos
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk FROM e),
c AS (SELECT doc_id, chunk, count(*) AS n, string_agg(line, chr(10) ORDER BY pos) AS body FROM g GROUP BY 1, 2),
k AS (SELECT *, n >= 2 AND row_number() OVER (PARTITION BY body, n >= 2 ORDER BY doc_id, chunk) > 1 AS gone FROM c)
SELECT doc_id, sum(n)::BIGINT AS n_lines, coalesce(sum(n) FILTER (gone), 0)::BIGINT AS n_removed,
       sha256(coalesce(string_agg(body, chr(10) ORDER BY chunk) FILTER (NOT gone), '')) AS kept_sha256
FROM k GROUP BY doc_id"""
