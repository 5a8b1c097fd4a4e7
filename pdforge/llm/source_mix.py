"""Mixing sources to target weights: whole copies plus one hash-seeded Bernoulli copy per document.

Tokens are summed per source, the targets are found by water-filling (targets stop at ``max_rate`` times their
source), the repetition rate of a source is target / size, and a document is emitted floor(rate) times plus once
more when its draw u (an md5 hash of seed and doc_id, in [0, 1)) falls below the fraction. A plain Bernoulli cut
at exactly the fraction misses the target of a source with a few long documents by far, so the cut of each
source is moved to the draw at which its taken words come nearest to the target: the draws and their order are
those of the Bernoulli copies, only the threshold is settled on the words actually drawn.

Defined results: null text has size 0; null source is a group of its own, ordered last; size 0 sources have
target 0 and take nothing; rows with equal doc_id share a draw; a null doc_id draws by
its text; an empty table gives an empty table; other columns, whatever their names, are carried along.
One row per source is sorted in one task (sources, not documents).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pdforge.llm.common import WORD, stored

WEIGHTS, TOTAL, MAX_RATE, SEED = (3, 1, 2), (3, 2), 2, "mix"
BUCKETS = 4096


def draw(doc_id, seed: str = SEED):
    """u in [0, 1): 52 bits of md5(seed:doc_id); without a doc_id, of the text's md5."""
    key = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce("text", F.lit("")))))
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), key)), 1, 13), 16, 10).cast("double") / 2.0 ** 52


def targets(sizes: DataFrame, weights=WEIGHTS, total=TOTAL, max_rate: int = MAX_RATE) -> DataFrame:
    """(source, s) -> (source, s, target): weights repeat over the sources by code point, null last.

    Sources sorted by s / weight are capped up to the first one that its share does not fill; all sums are
    exact decimals, so the order of the rows does not matter.
    """
    num, den = total
    dec = lambda c: F.col(c).cast("decimal(38,0)")
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    t = sizes.withColumn("w", F.element_at(F.array(*[F.lit(x) for x in weights]),
                                           ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    by_fill = Window.orderBy(F.col("s") / F.col("w"), F.col("source").isNull(), "source")
    every = Window.partitionBy()
    t = (t.withColumn("_all", F.sum(dec("s")).over(every)).withColumn("_w", F.sum(dec("w")).over(every))
         .withColumn("_before", F.sum(dec("s")).over(by_fill) - dec("s"))
         .withColumn("_from", F.col("_w") - F.sum(dec("w")).over(by_fill) + dec("w"))
         # what the sources from here on share, times den
         .withColumn("_share", F.lit(num) * F.col("_all") - F.lit(den * max_rate) * F.col("_before"))
         .withColumn("_free", F.lit(den * max_rate) * dec("s") * F.col("_from") >= dec("w") * F.col("_share")))
    # the first free source in this order fixes the level for all later ones
    first = Window.orderBy(F.col("s") / F.col("w"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, 0)
    level = lambda c: F.first(F.when(F.col("_free"), F.col(c)), ignorenulls=True).over(first)
    t = t.withColumn("_s1", level("_share")).withColumn("_w1", level("_from"))
    return t.select("source", "s", F.coalesce(
        (dec("w") * F.col("_s1")).cast("double") / (F.lit(den) * F.col("_w1")).cast("double"),
        (F.lit(max_rate) * F.col("s")).cast("double")).alias("target"))


def mix(docs: DataFrame, seed: str = SEED) -> tuple[DataFrame, DataFrame]:
    """(documents with size and draw, one row per source with base copies and the draw up to which a
    document gets one more)."""
    rows = stored(docs.select(
        "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        draw(F.col("doc_id"), seed).alias("u")), "mix-sizes")
    plan = stored(targets(rows.groupBy("source").agg(F.sum("size").alias("s"))), "mix-targets")
    plan = plan.withColumn("base", F.when(F.col("s") > 0, F.floor(F.col("target") / F.col("s"))).otherwise(0).cast("int")) \
        .withColumn("want", F.col("target") - F.col("base") * F.col("s")) \
        .withColumn("fraction", F.when(F.col("s") > 0, F.col("target") / F.col("s") - F.col("base")).otherwise(0.0))
    # words drawn by bucket of u, then by u inside the bucket where the target is crossed
    spread = stored(rows.groupBy("source", F.floor(F.col("u") * BUCKETS).alias("b")).agg(F.sum("size").alias("n")), "mix-draws")
    w = Window.partitionBy("source").orderBy("b")
    crossed = (spread.withColumn("before", F.sum("n").over(w) - F.col("n")).alias("x")
               .join(plan.alias("p"), F.col("x.source").eqNullSafe(F.col("p.source")))
               .where((F.col("before") <= F.col("want")) & (F.col("want") < F.col("before") + F.col("n")) & (F.col("want") > 0))
               .select("x.source", "b", "before", "want"))
    crossed = stored(crossed, "mix-crossed")
    inside = (rows.alias("r").join(crossed.alias("c"), F.col("r.source").eqNullSafe(F.col("c.source"))
                                   & (F.floor(F.col("r.u") * BUCKETS) == F.col("c.b")))
              .groupBy("c.source", "b", "before", "want", "u").agg(F.sum("size").alias("n")))
    gap = F.abs(F.col("before") + F.sum("n").over(Window.partitionBy("source").orderBy("u")) - F.col("want"))
    best = (inside.withColumn("gap", gap).groupBy("source", "b", "before", "want")
            .agg(F.min(F.struct("gap", "u")).alias("best"))
            # the cut before the whole bucket may be nearer than any inside it
            .select("source", F.when(F.col("want") - F.col("before") <= F.col("best.gap"), F.col("b") / F.lit(float(BUCKETS)))
                    .otherwise(F.col("best.u")).alias("cut"),
                    (F.col("want") - F.col("before") > F.col("best.gap")).alias("closed")))
    best = stored(best, "mix-cuts")
    plan = (plan.alias("p").join(best.alias("c"), F.col("p.source").eqNullSafe(F.col("c.source")), "left")
            .select("p.source", "s", "target", "base", "fraction", "cut", "closed"))
    return rows, stored(plan, "mix-plan")


def copies():
    """Copies of a document, of the columns u, base, cut and closed."""
    u, base, cut, closed = (F.col(c) for c in ("u", "base", "cut", "closed"))
    extra = F.when(cut.isNull(), F.lit(0)).when(closed, (u <= cut).cast("int")).otherwise((u < cut).cast("int"))
    return base + extra


def query(docs: DataFrame) -> DataFrame:
    rows, plan = mix(docs)
    return (rows.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")))
            .select("doc_id", "size", F.col("s").alias("source_size"), "target",
                    (F.col("size") * copies()).cast("long").alias("taken")))


def repeated(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The mixed corpus: the rows of ``docs``, each as often as the mix takes it; no shuffle of texts."""
    _, plan = mix(docs, seed)
    t = docs.select(F.struct(*docs.columns).alias("row"), F.col("source").alias("of"), draw(F.col("doc_id"), seed).alias("u"))
    t = t.join(plan.select("source", "base", "cut", "closed"), F.col("of").eqNullSafe(F.col("source")))
    return t.select("row", F.explode(F.array_repeat(F.lit(1), copies())).alias("copy")).select("row.*")


SQL = r"""
WITH d AS (SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
                  ('0x' || substr(md5('mix:' || doc_id::VARCHAR), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u FROM documents),
s AS (SELECT source, sum(size)::HUGEINT AS s FROM d GROUP BY source),
w AS (SELECT source, s, [3, 1, 2][(((row_number() OVER (ORDER BY source IS NULL, source)) - 1) % 3 + 1)::INT]::HUGEINT AS w FROM s),
f AS (SELECT *, sum(s) OVER ()::HUGEINT AS total, sum(s) OVER o::HUGEINT - s AS before, sum(w) OVER ()::HUGEINT - sum(w) OVER o::HUGEINT + w AS wfrom
      FROM w WINDOW o AS (ORDER BY s::DOUBLE / w::DOUBLE, source IS NULL, source)),
l AS (SELECT *, 3 * total - 4 * before AS share, 4 * s * wfrom >= w * (3 * total - 4 * before) AS free FROM f),
lev AS (SELECT arg_min(share, s::DOUBLE / w::DOUBLE) AS share1, max(wfrom) AS w1 FROM l WHERE free),
t AS (SELECT source, s, CASE WHEN free THEN (w * share1)::DOUBLE / (2 * w1)::DOUBLE ELSE (2 * s)::DOUBLE END AS target FROM l, lev),
p AS (SELECT *, CASE WHEN s > 0 THEN floor(target / s::DOUBLE) ELSE 0 END::INT AS base FROM t),
q AS (SELECT *, target - (base * s)::DOUBLE AS want FROM p),
c AS (SELECT d.*, q.s, q.target, q.base, q.want, sum(size) OVER (PARTITION BY d.source ORDER BY u) AS upto
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
b AS (SELECT source, min(want) AS want, max(CASE WHEN upto <= want THEN u END) AS lo_u, coalesce(max(CASE WHEN upto <= want THEN upto END), 0) AS lo,
             min(CASE WHEN upto > want THEN u END) AS hi_u, min(CASE WHEN upto > want THEN upto END) AS hi FROM c WHERE want > 0 GROUP BY source),
k AS (SELECT source, CASE WHEN hi IS NULL THEN -1.0 WHEN want - lo <= hi - want THEN coalesce(lo_u, -1.0) ELSE hi_u END AS cut FROM b)
SELECT doc_id, size, s::BIGINT AS source_size, target, size * (base + CASE WHEN u <= cut THEN 1 ELSE 0 END)::BIGINT AS taken
FROM c LEFT JOIN k ON c.source IS NOT DISTINCT FROM k.source
"""
