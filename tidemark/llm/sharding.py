"""Shards of linked documents by balanced label propagation, with DataFrame operations only.

Clusters of more than a shard's share of a shard (rows / shards / shards, so at most some
shards * shards clusters) start whole: the driver deals their sizes out, whole shards first and
then what is left of each into the fullest shard that still takes it. All other documents start in
a random split over the places left. Each round counts, per cluster of linked documents and
shard, how many members sit there; members want to move to the shard with most of their cluster.
A quota per pair of shards keeps every shard's row count as it is: as many documents go back as
come in, first those that want to, then documents without links. Only the quotas, one number per
pair of shards, pass through the driver.

Links are given as a cluster per document, so a cluster of n documents costs n rows, not n * n.
A cluster larger than a shard fills whole shards and one more with its rest; the rest is cut only
where no shard has room for it.

Defined cases: a NULL text counts as empty (size 1, crc32 0) and is equal to an empty one;
repeated rows are placed one by one; ids may be NULL or repeat; an empty table gives an empty
result; a table smaller than the number of shards leaves shards empty; extra columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.ranks import cell_count, id_hash, rank_in_cells
from tidemark.llm.store import stored

SHARDS = 16
ROUNDS = 10


def quotas(wanted: dict[tuple[int, int], int], unlinked: dict[int, int], shards: int):
    """Moves allowed from i to j, and documents without links that go back from j to i.

    Both are matrices ``[from][to]``; together they leave every shard's count unchanged.
    """
    moves = [[0] * shards for _ in range(shards)]
    back = [[0] * shards for _ in range(shards)]
    for j in range(shards):
        swapped = [min(wanted.get((i, j), 0), wanted.get((j, i), 0)) for i in range(shards)]
        excess = [wanted.get((i, j), 0) - swapped[i] for i in range(shards)]
        free, needed = unlinked.get(j, 0), sum(excess)
        asked = 0
        for i in range(shards):
            before, asked = asked, asked + excess[i]
            # Differences of floored sums: all free places are dealt out.
            granted = excess[i] if needed <= free else asked * free // needed - before * free // needed
            moves[i][j] = swapped[i] + granted
            back[j][i] = granted
    return moves, back


def whole_places(sizes: dict[str, int], places: list[int]) -> tuple[dict[str, list[tuple[int, int]]], list[int]]:
    """(shard, rows) parts of every cluster, in as few shards as fit, and the places left per shard."""
    left, rest, parts = list(places), {}, {}
    largest_first = sorted(sizes, key=lambda c: (-sizes[c], c))
    empty = sorted(range(len(places)), key=lambda s: -places[s])
    for c in largest_first:
        rest[c], parts[c] = sizes[c], []
        for s in [s for s in empty if 0 < places[s]]:
            if rest[c] >= places[s]:
                parts[c].append((s, places[s]))
                rest[c] -= places[s]
                left[s] = 0
                empty.remove(s)
    for c in sorted(largest_first, key=lambda c: (-rest[c], c)):
        while rest[c]:
            fitting = [s for s in range(len(left)) if left[s] >= rest[c]]
            s = min(fitting, key=lambda s: left[s]) if fitting else max(range(len(left)), key=lambda s: left[s])
            n = min(rest[c], left[s])
            parts[c].append((s, n))
            rest[c] -= n
            left[s] -= n
    return parts, left


def _ends(parts: list[tuple[int, int]]) -> list[dict]:
    total, ends = 0, []
    for shard, n in parts:
        total += n
        ends.append({"end": total, "shard": shard})
    return ends


def first_split(numbered: DataFrame, rows: int, shards: int, cells: int) -> DataFrame:
    """(..., _linked, shard): large clusters in as few shards as they fit, the others at random."""
    sizes = numbered.groupBy("_cluster").agg(F.count(F.lit(1)).alias("_n"))
    large = {
        r["_cluster"]: r["_n"]
        # Less than shards * shards clusters when there are as many rows as that.
        for r in sizes.where((F.col("_n") > 1) & (F.col("_n") * shards > rows // shards)).collect()
    }
    parts, left = whole_places(large, [rows // shards + (s < rows % shards) for s in range(shards)])
    kind = "array<struct<end:bigint,shard:int>>"
    planned = json.dumps([{"_cluster": c, "_ends": _ends(p)} for c, p in parts.items()])
    plan = numbered.sparkSession.range(1).select(
        F.inline(F.from_json(F.lit(planned), f"array<struct<_cluster:string,_ends:{kind}>>"))
    )
    others = F.from_json(F.lit(json.dumps(_ends(list(enumerate(left))))), kind)
    spread = F.xxhash64("_row", F.lit(2))
    ranked = rank_in_cells(
        numbered.join(sizes.select("_cluster", (F.col("_n") > 1).alias("_linked")), "_cluster")
        .join(plan, "_cluster", "left")
        .withColumn("_of", F.when(F.col("_ends").isNull(), "").otherwise(F.col("_cluster")))
        .withColumn("_zero", F.lit(0))
        .withColumn("_cell", spread.bitwiseAND(F.lit(0x7FFFFFFF)) % cells),
        ["_of"],
        "_zero",
        "_cell",
        [spread, F.col("_row")],
        "_place",
    )
    later = F.filter(F.coalesce("_ends", others), lambda e: e["end"] > F.col("_place"))
    return ranked.withColumn("shard", F.get(later, F.lit(0))["shard"]).drop("_ends", "_of", "_zero", "_cell", "_place")


def _lookup(matrix: list[list[int]], row: Column, column: Column) -> Column:
    literal = F.array(*[F.array(*[F.lit(v).cast("bigint") for v in line]) for line in matrix])
    return F.get(F.get(literal, row), column)


def propagate(state: DataFrame, shards: int, cells: int) -> DataFrame | None:
    """One round over (_row, _cluster, _linked, shard, ...), or None when nothing can move."""
    room = F.floor(F.lit(state.count()) / shards)
    linked = state.where("_linked")
    counts = linked.groupBy("_cluster", "shard").agg(F.count(F.lit(1)).alias("n"))
    # A shard that a cluster fills already is no aim for its other members.
    open_shard = F.when(F.col("n") < room, F.col("shard"))
    order = F.when(
        F.col("n") < room, F.struct("n", F.xxhash64("_cluster", "shard").alias("tie"), "shard")
    )
    aims = counts.groupBy("_cluster").agg(
        F.max_by(open_shard, order).cast("int").alias("_aim"),
        F.max(F.when(F.col("n") < room, F.col("n"))).alias("_most"),
        F.map_from_entries(F.collect_list(F.struct("shard", "n"))).alias("_here"),  # one entry per shard
    )
    joined = state.join(aims, "_cluster", "left")
    gains = (
        F.col("_linked")
        & (F.col("_aim") != F.col("shard"))
        & (F.col("_most") >= F.col("_here")[F.col("shard")])
        & (F.col("_here")[F.col("shard")] < room)
    )
    labelled = stored(
        joined.withColumn("_aim", F.when(gains, F.col("_aim")))
        .drop("_most", "_here")
        .withColumn("_cell", (F.xxhash64("_row", F.lit(1)).bitwiseAND(F.lit(0x7FFFFFFF)) % cells)),
        "shard-aims",
    )
    tally = (
        labelled.where(F.col("_aim").isNotNull() | ~F.col("_linked"))
        .groupBy("shard", "_aim")
        .count()
        .collect()  # at most shards * shards rows
    )
    wanted = {(r["shard"], r["_aim"]): r["count"] for r in tally if r["_aim"] is not None}
    unlinked = {r["shard"]: r["count"] for r in tally if r["_aim"] is None}
    moves, back = quotas(wanted, unlinked, shards)
    if not any(map(any, moves)):
        return None

    one = F.lit(0).alias("_zero")
    active = labelled.where(F.col("_aim").isNotNull() | ~F.col("_linked"))
    ranked = rank_in_cells(
        active.select("*", one).withColumn("_to", F.coalesce("_aim", F.lit(-1))),
        ["shard", "_to"],
        "_zero",
        "_cell",
        [F.col("_row")],
        "_place",
    )
    ends = []
    for line in back:
        total, sums = 0, []
        for n in line:
            total += n
            sums.append(total)
        ends.append(sums)
    upto = F.get(F.array(*[F.array(*[F.lit(v).cast("bigint") for v in s]) for s in ends]), F.col("shard"))
    returned = F.size(F.filter(upto, lambda end: end <= F.col("_place")))
    moved = F.when(
        F.col("_to") >= 0,
        F.when(F.col("_place") < _lookup(moves, F.col("shard"), F.col("_to")), F.col("_to")),
    ).otherwise(F.when(returned < shards, returned))
    changed = ranked.withColumn("shard", F.coalesce(moved, F.col("shard")).cast("int"))
    still = labelled.where(F.col("_aim").isNull() & F.col("_linked"))
    return stored(still.select(*state.columns).unionByName(changed.select(*state.columns)), "shard-state")


def balanced_shards(
    docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): row counts at most one apart.

    Documents with equal texts are linked.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    narrow = stored(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            (F.octet_length(body) + 1).cast("bigint").alias("size"),
            F.crc32(body).alias("text_crc32"),
            F.md5(body).alias("_cluster"),
        ),
        "shard-docs",
    )
    rows = narrow.count()
    cells = cell_count(rows)
    numbered = rank_in_cells(
        narrow.withColumn("_zero", F.lit(0)).withColumn("_cell", id_hash("doc_id") % cells),
        [],
        "_zero",
        "_cell",
        [F.col("doc_id"), F.col("_cluster")],
        "_row",
    )
    numbered = stored(numbered.drop("_zero", "_cell"), "shard-rows")
    state = stored(first_split(numbered, rows, shards, cells), "shard-state")
    for _ in range(rounds):
        later = propagate(state, shards, cells)
        if later is None:
            break
        state = later
    placed = rank_in_cells(
        state.withColumn("_zero", F.lit(0)).withColumn("_cell", F.col("_row") % cells),
        ["shard"],
        "_zero",
        "_cell",
        [F.col("_row")],
        "slot",
    )
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        F.col("slot").cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
