"""Exact dedup by deterministic block naming.

A text is cut into blocks of ``block`` characters. Distinct blocks are sorted (by a 64-bit hash, then by content
where different blocks share a hash) and numbered; then the names of adjacent pairs are sorted and numbered again,
until each document has one name. Names are numbers of distinct contents, so equal names at a level mean equal
texts: hashes only choose the sort order. That no two different blocks share a hash is checked against all block
contents (smallest and largest block of each hash, combined before the shuffle); blocks of a shared hash are
numbered by content.

Rounds: log2 of the blocks of the longest text; each moves 8-byte names, and documents leave as soon as they have
one name. Hot names (a text that a third of the rows share) are counted before the shuffle, and joins read
written tables so that skewed partitions are split.

Defined results: null counts as the empty text (one empty block), so null and '' are equal; a null doc_id comes before
all others; of rows that repeat the kept doc_id one stays, the same in every run; columns other than doc_id and text are
not read, whatever their names (``distinct_documents`` carries them along); an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pdforge.llm.common import dense_names, stored

BLOCK = 4096


def _blocks(block: int):
    text = F.coalesce("text", F.lit(""))
    return F.when(F.length(text) <= block, F.array(text)).otherwise(
        F.regexp_extract_all(text, F.lit(f"(?s).{{1,{block}}}"), F.lit(0)))


def _named(rows: DataFrame, cols: list[str]) -> DataFrame:
    """(rid, n, names): the names of ``cols`` of each row, in the order of pos."""
    rows = stored(rows, "block-rows")
    names = stored(dense_names(stored(rows.select(*cols).distinct(), "block-keys"), cols), "block-names")
    return stored(rows.join(names, cols).groupBy("rid").agg(F.collect_list(F.struct("pos", "name")).alias("_p"))
                  .select("rid", F.expr("transform(array_sort(_p), x -> x.name)").alias("names")), "block-docs")


def identities(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(rid, doc_id, text_sha256, level, name): texts are equal when level and name are."""
    blocks = _blocks(block)
    head = stored(docs.select(
        F.monotonically_increasing_id().alias("rid"), "doc_id",
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"),
        F.transform(blocks, lambda b: F.xxhash64(b)).alias("hashes")), "block-hashes")
    shared = stored(docs.select(F.explode(blocks).alias("b")).select(F.xxhash64("b").alias("h"), "b")
                    .groupBy("h").agg(F.min("b").alias("lo"), F.max("b").alias("hi"))
                    .where(F.col("lo") != F.col("hi")).select("h"), "block-shared")
    rows = head.select("rid", F.posexplode("hashes").alias("pos", "h"))
    if shared.isEmpty():
        rows = rows.withColumn("k", F.lit(0).cast("long"))
    else:  # different blocks under one hash: number them by content
        holders = rows.join(shared, "h", "left_semi").select("rid").distinct().join(head, "rid").select(
            "rid", F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"))
        same = (docs.join(holders, F.col("doc_id").eqNullSafe(F.col("_id"))
                          & (F.sha2(F.coalesce("text", F.lit("")), 256) == F.col("_sha")))
                .select("rid", F.posexplode(blocks).alias("pos", "b")).distinct()
                .withColumn("h", F.xxhash64("b")).join(shared, "h", "left_semi"))
        same = stored(same, "block-same")
        k = same.select("h", "b").distinct().withColumn("k", F.row_number().over(Window.partitionBy("h").orderBy("b")).cast("long"))
        rows = (rows.join(same.join(k, ["h", "b"]).select("rid", "pos", "k"), ["rid", "pos"], "left")
                .withColumn("k", F.coalesce("k", F.lit(0).cast("long"))))
    docs_now = _named(rows, ["h", "k"])
    most = head.agg(F.max(F.size("hashes"))).first()[0] or 1
    done, level = [], 0
    while True:
        done.append(docs_now.where(F.size("names") == 1).select("rid", F.lit(level).alias("level"), F.col("names")[0].alias("name")))
        if most <= 1:
            break
        level, most = level + 1, (most + 1) // 2
        # adjacent pairs; an odd last name is paired with 0, which names nothing
        pairs = F.expr("transform(sequence(0, (size(names) - 1) div 2), "
                       "i -> struct(names[2 * i] as a, coalesce(get(names, 2 * i + 1), 0L) as b))")
        rows = (docs_now.where(F.size("names") > 1).select("rid", F.posexplode(pairs).alias("pos", "p"))
                .select("rid", "pos", "p.a", "p.b"))
        docs_now = _named(rows, ["a", "b"])
    names = done[0]
    for d in done[1:]:
        names = names.unionByName(d)
    return head.select("rid", "doc_id", "text_sha256").join(names, "rid")


def exact_groups(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    ids = stored(identities(docs, block), "block-ids")
    groups = stored(ids.groupBy("level", "name").agg(
        F.max(F.struct("doc_id", "rid")).alias("keep"), F.count(F.lit(1)).alias("group_size")), "block-groups")
    return ids.join(groups, ["level", "name"]).select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size",
        (F.col("keep.rid") == F.col("rid")).alias("kept"), "text_sha256")


def distinct_documents(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` that stay, one per distinct text, all columns."""
    keep = stored(exact_groups(docs, block).where("kept").select("doc_id", "text_sha256"), "block-kept")
    # the whole row travels as one struct, so no column name can clash
    t = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    t = t.join(keep.hint("merge"), F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("sha") == F.col("text_sha256")))
    # rows that repeat id and text differ in other columns at most: the first by a hash of the row
    one = F.row_number().over(Window.partitionBy("id", "sha").orderBy(F.xxhash64("row"), F.hash("row")))
    return t.select("row", one.alias("place")).where("place = 1").select("row.*")


query = exact_groups

SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
