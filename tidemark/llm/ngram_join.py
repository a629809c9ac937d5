"""Near duplicates: an exact Jaccard join over word shingles by vertical partitioning.

Texts with the same shingle set form one class. Shingles found in one class only cannot be
common to two, so only their number is kept per class; the rest, with the number of classes that
have them, form the class's set. The global order of shingles is (logarithm of that number, hash),
rare ones first. Two classes that link share a shingle among the first ``n - ceil(0.8 n) + 1``
of each. Overlaps are counted by vertical partitions: the global order is cut into fragments,
every fragment's partial overlap is counted separately, and the counts are summed per pair.

A group of n near copies has n * n pairs. They are not all listed: first every class is paired
with one leader per shingle (the class with the fewest shingles of its own), and the links found
give components. After that only pairs of different components are left, where one of the two is
outside the largest component that has the shingle; all of those are counted. So every link between
components is found, and the components are exact.

Defined cases: NULL or wordless texts have an empty set, link with nothing and are their own
component; fewer than five words are one shingle; repeated rows are in one class; the component
of rows whose ids are all NULL is NULL; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.graph import components
from tidemark.llm.shingles import set_key, shingle_set
from tidemark.llm.store import small_batches, stored

SHINGLE_WORDS = 5
PERCENT = 80
#: Rounds of pairing with leaders before the rest is counted in full.
LEADER_ROUNDS = 3
#: A shingle in more than this share of a batch is dealt to several tasks.
HOT_SHARE = 0.05
HOT_BAND = 63
_PARTS_PER_PARTITION = 4
_SALTS = 64


def document_sets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, key) of every whole text; equal sets have equal keys."""
    small_batches(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, SHINGLE_WORDS) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([set_key(s) for s in sets], pa.int64()),
                ],
                names=["doc_id", "n_shingles", "key"],
            )

    return docs.select(doc_id, text).mapInArrow(scan, f"doc_id {kind}, n_shingles bigint, key bigint")


def shared_shingles(docs: DataFrame, text: str = "text") -> DataFrame:
    """(key, token, band) of the shingles that two classes or more have.

    ``band`` is the logarithm of the number of classes. Shingles are dealt by hash as packed
    arrays. A shingle that is frequent in a batch goes to one of several tasks with its classes,
    and as two marks to the task of its hash, so that all tasks give it the last band.
    """
    spark = docs.sparkSession
    small_batches(spark)
    parts = _PARTS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for number, batch in enumerate(batches):
            keys, sets = [], []
            for text in batch.column(0).to_pylist():
                found = shingle_set(text, SHINGLE_WORDS)
                key = set_key(found)
                if len(found) and key not in seen:
                    seen.add(key)
                    keys.append(key)
                    sets.append(found)
            if len(seen) > 100_000:
                seen.clear()
            if not sets:
                continue
            tokens = np.concatenate(sets)
            owner = np.repeat(np.array(keys, np.int64), [len(s) for s in sets])
            distinct, inverse, counts = np.unique(tokens, return_inverse=True, return_counts=True)
            often = counts > max(16, HOT_SHARE * len(sets))
            hot = often[inverse]
            salt = np.uint64(hash((number, keys[0])) % _SALTS)
            part = (tokens >> np.uint64(20)) % np.uint64(parts)
            part[hot] = (part[hot] + salt + np.uint64(1)) % np.uint64(parts)
            marked = np.repeat(distinct[often], 2)
            marks = np.tile(np.array([0, 1], np.int64), len(marked) // 2)
            for state, p, t, o in (
                (0, part[~hot], tokens[~hot], owner[~hot]),
                (1, part[hot], tokens[hot], owner[hot]),
                (2, (marked >> np.uint64(20)) % np.uint64(parts), marked, marks),
            ):
                if len(t) == 0:
                    continue
                by = np.argsort(p, kind="stable")
                p, t, o = p[by], t[by], o[by]
                cuts = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
                ends = np.append(cuts[1:], len(p))
                # Classes stand in runs: each once, with the length of its run.
                runs = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (o[1:] != o[:-1])]))
                lengths = np.diff(np.append(runs, len(p))).astype("<u4")
                heads, places = o[runs], np.searchsorted(runs, np.append(cuts, len(p)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(p[cuts].astype(np.int32)),
                        pa.array(np.full(len(cuts), state, np.int32)),
                        pa.array([t[a:b].tobytes() for a, b in zip(cuts, ends)], pa.binary()),
                        pa.array([heads[a:b].tobytes() for a, b in zip(places, places[1:])], pa.binary()),
                        pa.array([lengths[a:b].tobytes() for a, b in zip(places, places[1:])], pa.binary()),
                    ],
                    names=["part", "state", "tokens", "owners", "runs"],
                )

    def whole(table: pa.Table, name: str, kind: str) -> np.ndarray:
        return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)

    def joined(table: pa.Table, state: int) -> tuple[np.ndarray, np.ndarray]:
        chosen = table.filter(pc.equal(table.column("state"), state))
        tokens = whole(chosen, "tokens", "<i8")
        owners = np.repeat(whole(chosen, "owners", "<i8"), whole(chosen, "runs", "<u4"))
        order = np.lexsort((owners, tokens))
        tokens, owners = tokens[order], owners[order]
        new = np.ones(len(tokens), bool)
        new[1:] = (tokens[1:] != tokens[:-1]) | (owners[1:] != owners[:-1])
        return tokens[new], owners[new]

    def count(table: pa.Table) -> pa.Table:
        hot_tokens, hot_owners = joined(table, 1)
        tokens, owners = joined(table, 0)
        marked = np.unique(joined(table, 2)[0])
        first = np.flatnonzero(np.concatenate([np.ones(min(1, len(tokens)), bool), tokens[1:] != tokens[:-1]]))
        counts = np.diff(np.append(first, len(tokens)))
        band = np.zeros(len(counts), np.int32)
        band[counts > 0] = np.floor(np.log2(counts[counts > 0])).astype(np.int32)
        band[np.isin(tokens[first], marked)] = HOT_BAND
        shared = np.repeat(band > 0, counts)
        band = np.repeat(band, counts)
        return pa.table(
            {
                "key": np.concatenate([owners[shared], hot_owners]),
                "token": np.concatenate([tokens[shared], hot_tokens]),
                "band": np.concatenate([band[shared], np.full(len(hot_tokens), HOT_BAND, np.int32)]),
            }
        )

    dealt = docs.select(text).mapInArrow(deal, "part int, state int, tokens binary, owners binary, runs binary")
    return dealt.groupBy("part").applyInArrow(count, "key bigint, token bigint, band int")


def required(n: Column) -> Column:
    """The least overlap with any text that links with one of ``n`` shingles."""
    return F.floor((n * PERCENT + 99) / 100)


def class_sets(sets: DataFrame, shared: DataFrame) -> DataFrame:
    """(key, n, own, tokens): ``own`` shingles no other class has, then the others in order."""
    classes = sets.where("n_shingles > 0").groupBy("key").agg(F.first("n_shingles").alias("n"))
    # A class may come from several tasks of one hot shingle.
    tokens = shared.groupBy("key").agg(
        F.array_sort(F.collect_set(F.struct("band", "token"))).alias("tokens")
    )
    return tokens.join(classes, "key").select("key", "n", (F.col("n") - F.size("tokens")).alias("own"), "tokens")


def prefixes(sets: DataFrame) -> DataFrame:
    """(token, key, n, own, at) of the shingles by which a class may find partners.

    ``at`` shingles of the class stand before ``token`` in the global order.
    """
    length = F.col("n") - required(F.col("n")) + 1 - F.col("own")
    return sets.where(length > 0).select(
        "key", "n", "own", F.posexplode(F.slice("tokens", F.lit(1), length.cast("int"))).alias("_p", "_t")
    ).select(F.col("_t.token").alias("token"), "key", "n", "own", (F.col("own") + F.col("_p")).alias("at"))


def fragments(sets: DataFrame) -> DataFrame:
    """(key, fragment, segment): the sets cut at fixed points of the global order."""
    at = F.expr("_t.band div 4")
    cut = sets.select("key", F.explode("tokens").alias("_t")).select(
        "key", at.cast("int").alias("fragment"), F.col("_t.token").alias("token")
    )
    return cut.groupBy("key", "fragment").agg(F.collect_list("token").alias("segment"))


def similar_pairs(pairs: DataFrame, segments: DataFrame, sizes: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) that link, with their overlap summed over the fragments."""
    left = segments.select(F.col("key").alias("a"), "fragment", F.col("segment").alias("_sa"))
    right = segments.select(F.col("key").alias("b"), "fragment", F.col("segment").alias("_sb"))
    partial = F.size(F.array_intersect("_sa", "_sb"))
    overlaps = (
        pairs.select("a", "b").join(left, "a").join(right, ["b", "fragment"])
        .select("a", "b", partial.alias("overlap"))
        .groupBy("a", "b").agg(F.sum("overlap").alias("overlap"))
    )
    na, nb = (sizes.select(F.col("key").alias(c), F.col("n").alias(f"_n{c}")) for c in "ab")
    union = F.col("_na") + F.col("_nb") - F.col("overlap")
    return (
        overlaps.join(na, "a").join(nb, "b")
        .where(100 * F.col("overlap") >= PERCENT * union)
        .select("a", "b", "overlap")
    )


def _fitting(n: str, at: str, other_n: str, other_at: str) -> Column:
    """Whether a pair can link whose first common shingle stands at these places.

    Then all common shingles are among those from there on. A pair that links passes at its
    first common shingle, whatever happens at its others.
    """
    most = F.least(F.col(n) - F.col(at), F.col(other_n) - F.col(other_at))
    return (100 + PERCENT) * most >= PERCENT * (F.col(n) + F.col(other_n))


def _labelled(index: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Prefix rows with their component, of shingles that several components have."""
    if labels is None:
        known = index.withColumn("component", F.col("key"))
    else:
        known = index.join(labels, "key", "left").withColumn("component", F.coalesce("component", "key"))
    mixed = known.groupBy("token").agg(F.min("component").alias("_low"), F.max("component").alias("_high"))
    return known.join(mixed.where("_low < _high").select("token"), "token")


def component_links(sets: DataFrame) -> DataFrame:
    """(key, component) of the classes that link with another."""
    index = stored(prefixes(sets), "join-prefixes")
    segments = stored(fragments(sets.join(index.select("key").distinct(), "key", "left_semi")), "join-segments")
    sizes = sets.select("key", "n")
    links, labels = None, None
    for nth in range(LEADER_ROUNDS + 1):
        rows = stored(_labelled(index, labels), "join-index")
        if rows.isEmpty():
            break
        if nth < LEADER_ROUNDS:
            # The classes with the fewest shingles of their own first, later any.
            rank = F.struct(
                (F.col("own") * 1000 / F.col("n")).cast("int") if nth == 0 else F.lit(0).alias("_r"),
                F.xxhash64("key", F.lit(nth)).alias("_h"),
                "key",
                "n",
                "at",
                "component",
            )
            leaders = rows.groupBy("token").agg(F.min(rank).alias("_l"))
            pairs = (
                rows.join(leaders, "token")
                .where(F.col("component") != F.col("_l.component"))
                .where(_fitting("n", "at", "_l.n", "_l.at"))
                .select(F.col("_l.key").alias("a"), F.col("key").alias("b"))
            )
        else:
            held = rows.groupBy("token", "component").count()
            largest = held.groupBy("token").agg(
                F.max_by("component", F.struct("count", "component")).alias("_largest")
            )
            outside = (
                rows.join(largest, "token").where(F.col("component") != F.col("_largest"))
                .select("token", F.col("key").alias("a"), F.col("n").alias("_n"), F.col("at").alias("_at"), F.col("component").alias("_c"))
            )
            pairs = (
                outside.join(rows.withColumnRenamed("key", "b"), "token")
                .where((F.col("_c") != F.col("component")) & _fitting("_n", "_at", "n", "at"))
                .select("a", "b")
            )
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        found = stored(similar_pairs(pairs, segments, sizes), "join-links")
        links = found if links is None else links.unionByName(found)
        if not found.isEmpty():
            labels = components(links)
    if labels is None:
        labels = sets.where("false").select("key", F.col("key").alias("component"))
    return labels


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, class_key, component_id) of every document."""
    documents = stored(document_sets(docs, doc_id, text), "join-documents")
    sets = stored(class_sets(documents, shared_shingles(docs, text)), "join-sets")
    labels = component_links(sets)
    classes = documents.groupBy("key").agg(F.min("doc_id").alias("_least"))
    placed = classes.join(labels, "key", "left").withColumn("component", F.coalesce("component", "key"))
    least = placed.groupBy("component").agg(F.min("_least").alias("component_id"))
    of_class = placed.join(least, "component").select("key", "component_id")
    return documents.join(of_class, "key").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("key")).alias("class_key"),
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component, the one with the least id.

    Documents without words are not duplicates of anything and stay. Rows that repeat id and
    text are one document.
    """
    found = near_duplicates(docs, doc_id, text)
    kept = (
        found.where(F.col("doc_id").eqNullSafe(F.col("component_id")) | (F.col("n_shingles") == 0))
        .groupBy(F.col("doc_id").alias("_kept"))
        .agg((F.count(F.lit(1)) > 1).alias("_repeated"))
    )
    chosen = docs.join(kept, F.col(doc_id).eqNullSafe(F.col("_kept"))).drop("_kept")
    once = chosen.where("not _repeated").unionByName(
        chosen.where("_repeated").dropDuplicates([doc_id, text])
    )
    return once.drop("_repeated")
