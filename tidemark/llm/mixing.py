"""Mixing sources to target weights by systematic sampling.

Inside a source every document expects ``target / source_size`` copies. The expected copies
are summed in a fixed order, one random offset per source is added, and a document is taken
once for every integer boundary its interval crosses.

Defined cases: a NULL text has size 0; a NULL source is a source of its own, last in order;
documents of size 0 may be taken but add no words; a table without words gets targets of 0 and
nothing is taken; an empty table gives an empty result; repeated rows are sampled one by one,
and rows equal in source, size and id are interchangeable; extra columns pass through, and the
columns added replace columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.ranks import cell_count, id_hash, rank_in_cells
from tidemark.llm.store import stored

WORD = r"[^\x20\x09-\x0D]+"
# Documents of a source are walked in order of size, so that the words taken stay near the
# target; classes of sizes are the coarse step of that order.
CLASS_WORDS = 64
CLASSES = 1024
SEED = 7


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def source_key(source: str = "source") -> Column:
    """A key without NULL whose order is the order of the sources, NULL last."""
    return F.when(F.col(source).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source)))


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most_copies: int = 3
) -> DataFrame:
    """(_source, source_size, target) from (_source, size).

    The sum of all sizes is shared by weight; a target stops at ``most_copies`` times its
    source's size and the excess is shared again. All sources below their limit end at the same
    level per unit of weight, so with the sources sorted by limit per weight one pass of prefix
    sums finds it. The windows span the sources, one row each.
    """
    everything = Window.partitionBy(F.lit(0))
    by_name = everything.orderBy("_source")
    by_limit = everything.orderBy(F.col("_limit") / F.col("_weight"), "_source")
    nth = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(w).cast("bigint") for w in weights]), (nth + 1).cast("int"))
    totals = (
        sizes.groupBy("_source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("_weight", weight)
        .withColumn("_limit", F.col("source_size") * most_copies)
        .withColumn("_all", F.sum("source_size").over(everything))
    )
    capped = F.coalesce(
        F.sum("_limit").over(by_limit.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    open_weight = F.sum("_weight").over(by_limit.rowsBetween(0, Window.unboundedFollowing))
    levels = totals.withColumn("_level", (F.col("_all") - capped) / open_weight).withColumn(
        "_place", F.row_number().over(by_limit)
    )
    fits = F.col("_level") * F.col("_weight") <= F.col("_limit")
    level = F.min_by(F.when(fits, F.col("_level")), F.when(fits, F.col("_place"))).over(everything)
    return levels.withColumn("_level", level).select(
        "_source",
        "source_size",
        F.least(F.col("_limit").cast("double"), F.col("_level") * F.col("_weight")).alias("target"),
    )


def mix(
    docs: DataFrame,
    size: Column | None = None,
    weights: tuple[int, ...] = (5, 2, 1),
    most_copies: int = 3,
    seed: int = SEED,
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
) -> DataFrame:
    """``docs`` with size, source_size, target, copies (of this row) and taken (words).

    Ids, sources and sizes are written once, so a text is counted once.
    """
    numbered = docs.drop("size", "source_size", "target", "copies", "taken")
    narrow = set(numbered.columns) <= {doc_id, source, text}
    sized = numbered.withColumn("_source", source_key(source)).withColumn(
        "size", word_count(text) if size is None else size
    )
    if narrow:
        sized = sized.drop(text)
    sized = stored(sized, "mix-sizes")
    targets = source_targets(sized.select("_source", "size"), weights, most_copies)
    cells = cell_count(sized.count())
    ranked = rank_in_cells(
        sized.withColumn("_class", F.least(F.expr(f"size div {CLASS_WORDS}"), F.lit(CLASSES - 1)))
        .withColumn("_cell", id_hash(doc_id) % cells),
        ["_source"],
        "_class",
        "_cell",
        [F.col("size"), F.col(doc_id)],
        "_rank",
    )
    offset = id_hash(F.concat(F.lit(f"mix-{seed}:"), F.col("_source"))) / F.lit(4294967296.0)
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)

    def boundaries(rank: Column) -> Column:
        return F.floor(rank * F.col("_expected") + F.col("_offset"))

    copies = F.least(
        boundaries(F.col("_rank") + 1) - boundaries(F.col("_rank")), F.lit(most_copies).cast("bigint")
    )
    return (
        ranked.join(targets, "_source")
        .withColumn("_expected", expected)
        .withColumn("_offset", offset)
        .withColumn("copies", copies)
        .withColumn("taken", F.col("copies") * F.col("size"))
        .drop("_source", "_class", "_cell", "_rank", "_expected", "_offset")
    )


def take_copies(mixed: DataFrame) -> DataFrame:
    """One row per copy taken."""
    return mixed.where(F.col("copies") > 0).withColumn(
        "_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    ).drop("_copy")


MIX_SQL = f"""
WITH s AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
                  CASE WHEN source IS NULL THEN '1' ELSE concat('0', source) END AS k FROM documents),
t AS (SELECT k, CAST(sum(size) AS BIGINT) AS source_size,
             [5, 2, 1][((row_number() OVER (ORDER BY k) - 1) % 3) + 1] AS w FROM s GROUP BY k),
u AS (SELECT k, source_size, w, CAST(sum(source_size) OVER () AS BIGINT) AS total, 3 * source_size / w AS r FROM t),
v AS (SELECT *, (total - CAST(coalesce(sum(3 * source_size) OVER (ORDER BY r, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT))
                / CAST(sum(w) OVER (ORDER BY r, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS level,
             row_number() OVER (ORDER BY r, k) AS place FROM u),
l AS (SELECT min_by(level, place) AS level FROM v WHERE level * w <= 3 * source_size),
g AS (SELECT k, source_size, least(CAST(3 * source_size AS DOUBLE), l.level * w) AS target FROM v, l),
n AS (SELECT greatest(1, count(*) // 65536) AS cells FROM s),
d AS (SELECT doc_id, size, k,
             row_number() OVER (PARTITION BY k ORDER BY least(size // {CLASS_WORDS}, {CLASSES - 1}),
               CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) % n.cells, size, doc_id) - 1 AS i,
             CAST('0x' || substr(md5(concat('mix-{SEED}:', k)), 1, 8) AS BIGINT) / 4294967296.0 AS o FROM s, n),
e AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS x FROM d JOIN g USING (k))
SELECT doc_id, size, source_size, target,
       CAST(least(floor((i + 1) * x + o) - floor(i * x + o), 3) AS BIGINT) * size AS taken FROM e
"""
