"""Cross-site boilerplate lines by distinct-site spread, in DataFrame functions only.

Each line's 128-bit hash gets a HyperLogLog sketch of the sites (``source``) it occurs on; sketches merge by
aggregation, so a line that a third of the rows share is one row per task before the shuffle. Lines whose estimate
lies within ``margin`` of the threshold get an exact count of distinct sites; lines on ``min_sites`` sites or more
are boilerplate and are removed from every document, by position.

Defined results: lines are split at newlines and compared whole; blank lines are layout, never boilerplate; a null
site is no site; null text stays null with 0 lines; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pdforge.llm.common import stored

MIN_SITES, LG_K, MARGIN = 5, 10, 0.25


def _key(line):
    """128 bits of hash as two longs."""
    return F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2")


def _lines(docs: DataFrame) -> DataFrame:
    t = docs.select("doc_id", F.xxhash64("text").alias("th"), F.col("source").alias("site"),
                    F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return t.where(F.trim("line") != "").select("doc_id", "th", "site", "pos", *_key(F.col("line")))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K, margin: float = MARGIN) -> DataFrame:
    """(h1, h2, n_sites) of the lines on at least ``min_sites`` sites; n_sites is the estimate, or exact near the
    threshold. The relative error of a sketch is 1.04 / sqrt(2^lg_k), 3 %: the margin is eight times that."""
    spread = stored(lines.where(F.col("site").isNotNull()).groupBy("h1", "h2")
                    .agg(F.hll_sketch_agg("site", lg_k).alias("sketch"))
                    .select("h1", "h2", F.hll_sketch_estimate("sketch").alias("n_sites"))
                    .where(F.col("n_sites") >= min_sites * (1 - margin)), "line-spread")
    near = spread.where(F.col("n_sites") <= min_sites * (1 + margin)).select("h1", "h2")
    exact = (lines.where(F.col("site").isNotNull()).select("h1", "h2", "site").join(near, ["h1", "h2"], "left_semi")
             .distinct().groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_sites")))
    return exact.where(F.col("n_sites") >= min_sites).unionByName(
        spread.where(F.col("n_sites") > min_sites * (1 + margin)))


def query(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Per document: doc_id, n_lines, n_removed, text without boilerplate lines."""
    lines = _lines(docs)
    bad = stored(boilerplate(lines, min_sites).select("h1", "h2"), "line-boilerplate")
    cut = stored(lines.select("doc_id", "th", "pos", "h1", "h2").join(bad, ["h1", "h2"], "left_semi")
                 .groupBy(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).agg(F.collect_set("pos").alias("_cut")), "line-cuts")
    # the cuts grow with the corpus: the same shuffle join at every size
    t = docs.select("doc_id", "text").join(cut.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id"))
                                           & (F.xxhash64("text") == F.col("_th")), "left")
    parts = F.split("text", "\n")
    kept = F.filter(parts, lambda line, i: ~F.array_contains(F.col("_cut"), i))
    return t.select("doc_id", F.coalesce(F.size(parts), F.lit(0)).cast("long").alias("n_lines"),
                    F.coalesce(F.when(F.col("text").isNotNull(), F.size("_cut")), F.lit(0)).cast("long").alias("n_removed"),
                    F.when(F.col("_cut").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"))


SQL = """
WITH l AS (SELECT doc_id, source, pos, line FROM (
             SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
             FROM documents)),
b AS (SELECT line FROM l WHERE trim(line) <> '' GROUP BY line HAVING count(DISTINCT source) >= 5),
k AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE line NOT IN (SELECT line FROM b)) AS text,
             count(*) AS n_lines, count(*) FILTER (WHERE line IN (SELECT line FROM b)) AS n_removed FROM l GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id
"""
