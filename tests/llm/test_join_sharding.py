import re
from collections import Counter, defaultdict
from itertools import combinations

from corpus import changed, frame, pandas, prose

from tidemark.llm import graph, imatch, ngram_join, sharding
from tidemark.llm.queries import table


def sets_of(rows):
    found = {}
    for r in rows:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        found[r["doc_id"], r["text"]] = frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()
    return found


def brute_components(rows):
    sets = sets_of(rows)
    up = {k: k for k in sets}

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, b in combinations(sets, 2):
        common = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
            up[top(a)] = top(b)
    least = {}
    for k in sets:
        if k[0] is not None:
            least[top(k)] = min(least.get(top(k), k[0]), k[0])
    return Counter(
        (r["doc_id"], len(sets[r["doc_id"], r["text"]]), least.get(top((r["doc_id"], r["text"])))) for r in rows
    )


def components_of(spark, rows):
    return Counter(
        (r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(frame(spark, rows)).collect()
    )


def test_components_of_awkward_rows(spark):
    assert components_of(spark, None) == brute_components(frame(spark).collect())
    assert components_of(spark, []) == Counter()


def test_components_of_a_large_group_of_near_copies(spark):
    base = prose(7, 150)
    line = "the same very common line of words"
    rows = []
    for k in range(260):
        text = changed(base, k, k % 12) if k % 2 else f"{line}\n{prose(1000 + k, 30)}"
        rows.append((500 - k, text, *[None] * 9))
    assert components_of(spark, rows) == brute_components(frame(spark, rows).collect())


def test_one_document_of_each_group_stays(spark):
    rows = frame(spark).collect()
    kept = pandas(ngram_join.keep_one(frame(spark)))
    found = brute_components(rows)
    groups = {c for (i, n, c), _ in found.items() if n}
    assert {r["doc_id"] for r in kept if (r["text"] or "").split()} == groups
    assert Counter(r["doc_id"] for r in kept).most_common(1)[0][1] == 1


def test_chains_are_one_component(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    found = {r["key"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert set(found.values()) == {0, 100} and len(found) == 101
    none = spark.createDataFrame([], "a bigint, b bigint")
    assert graph.components(none).collect() == []


def shards_of(spark, rows, shards=16):
    return pandas(sharding.balanced_shards(frame(spark, rows), shards))


def test_shards_are_even_and_keep_equal_texts(spark):
    rows = [(k, f"text {k % 60 if k % 3 else k}" if k % 5 else None if k == 5 else "", *[None] * 9) for k in range(300)]
    found = shards_of(spark, rows, 8)
    counts = Counter(r["shard"] for r in found)
    assert max(counts.values()) - min(counts.values()) <= 1 and set(counts) == set(range(8))
    slots = defaultdict(list)
    for r in found:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    texts = {k: t or "" for k, t, *_ in rows}
    homes = defaultdict(set)
    for r in found:
        homes[texts[r["doc_id"]]].add(r["shard"])
        assert r["size"] == len(texts[r["doc_id"]]) + 1
    # The empty texts exceed a shard; of the others hardly any group is cut.
    assert sum(len(h) > 1 for t, h in homes.items() if t) <= 8
    assert len(homes[""]) <= 4


def test_shards_of_awkward_rows(spark):
    found = shards_of(spark, None)
    assert len(found) == len(frame(spark).collect())
    counts = Counter(r["shard"] for r in found)
    assert max(counts.values()) - min(counts.values()) <= 1
    assert shards_of(spark, []) == []
    assert [(r["shard"], r["slot"], r["size"]) for r in shards_of(spark, [(None, None, *[None] * 9)])] == [(0, 0, 1)]


def test_a_group_of_a_third_of_all_rows_takes_as_few_shards_as_it_needs(spark):
    # 960 rows, 60 a shard: 6 shards for the large group, 1 for a group of 50, hardly a row without copies.
    texts = ["large"] * 320 + ["middle"] * 50 + [f"pair {k // 2}" for k in range(578)] + [f"alone {k}" for k in range(12)]
    rows = [(k * 7 % 960, t, *[None] * 9) for k, t in enumerate(texts)]
    names = {r[0]: r[1] for r in rows}
    found = shards_of(spark, rows)
    homes, counts = defaultdict(set), Counter(r["shard"] for r in found)
    for r in found:
        homes[names[r["doc_id"]]].add(r["shard"])
    assert len(found) == 960 and set(counts.values()) == {60}
    assert (len(homes["large"]), len(homes["middle"])) == (6, 1)


def test_large_groups_fill_whole_shards_first():
    parts, left = sharding.whole_places({"a": 25, "b": 14, "c": 6}, [11, 10, 10, 10, 10])
    assert {c: (len(p), sum(n for _, n in p)) for c, p in parts.items()} == {"a": (3, 25), "b": (2, 14), "c": (1, 6)}
    assert sum(left) == 6 and min(left) == 0
    assert sharding.whole_places({}, [1, 0]) == ({}, [1, 0])


def test_quotas_deal_out_all_free_places():
    _, back = sharding.quotas({(i, 0): 3 for i in range(1, 8)}, {0: 5}, 8)
    assert sum(back[0]) == 5


def test_quotas_keep_counts():
    moves, back = sharding.quotas({(0, 1): 9, (1, 0): 4, (2, 1): 3}, {1: 4}, 3)
    for j in range(3):
        came = sum(moves[i][j] + back[i][j] for i in range(3))
        went = sum(moves[j][i] + back[j][i] for i in range(3))
        assert came == went
    assert moves[0][1] >= 4 and sum(back[1]) <= 4


def test_sharding_plan_has_no_python(spark):
    df = sharding.balanced_shards(table(spark, "/root/testdata/sf0.001", "documents", "doc_id", "text"))
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_fingerprints_of_awkward_rows(spark):
    docs = frame(spark)
    rows = sorted(
        docs.collect(),
        key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0), r["text"] or ""),
    )
    inside = imatch.lexicon(docs)
    found = pandas(imatch.edited_fingerprints(docs, inside))
    texts = [r["text"] or "" for r in rows]
    wanted = Counter()
    for k, t in enumerate(texts):
        after = texts[(k + 1) % len(texts)]
        e = imatch.edited_text(t, after)
        f, g, h = (imatch.fingerprint(imatch.terms(x), inside) for x in (t, e, after))
        wanted[rows[k]["doc_id"], len(t), f, g, imatch.likeness(f, g), imatch.likeness(f, h)] += 1
    names = ["doc_id", "n_chars", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert Counter(tuple(r[n] for n in names) for r in found) == wanted
    assert imatch.edited_fingerprints(frame(spark, []), imatch.lexicon(frame(spark, []))).collect() == []


def test_lexicon_counts_documents(spark):
    rows = [(k, "common " + ("mid " if k % 20 == 0 else "") + f"rare{k}", *[None] * 9) for k in range(400)]
    inside = imatch.lexicon(frame(spark, rows), least=0.01, most=0.1)

    def has(word):
        slot = imatch.term_slots(imatch.terms(word))
        return bool((inside[slot >> 3] >> (7 - (slot & 7)) & 1)[0])

    assert has("mid") and not has("common") and not has("rare7")


def test_copies_do_not_push_their_terms_out_of_the_lexicon(spark):
    base = " ".join(f"copied{k}" for k in range(300))
    rows = [(k, base, *[None] * 9) for k in range(60)]
    rows += [(100 + k, " ".join(f"own{k}x{j}" for j in range(300)), *[None] * 9) for k in range(120)]
    inside = imatch.lexicon(frame(spark, rows))
    slots = imatch.term_slots(imatch.terms(base))
    assert (inside[slots >> 3] >> (7 - (slots & 7)) & 1).all()
    assert imatch.distinct_texts(frame(spark, rows)).count() == 121
    near = pandas(imatch.edited_fingerprints(frame(spark, rows), inside))
    last = next(r for r in near if r["doc_id"] == 0)
    assert last["near_edited"] > last["near_next"]


def test_texts_outside_the_lexicon_share_subsets_with_their_edited_texts():
    every, near = 30, Counter()
    for n in range(every):
        a, b = " ".join(f"a{n}x{k}" for k in range(400)), " ".join(f"b{n}x{k}" for k in range(400))
        inside = __import__("numpy").zeros((1 << imatch.TERM_BITS) // 8, "uint8")
        for slot in imatch.term_slots(imatch.terms(b)):
            inside[slot >> 3] |= 128 >> (slot & 7)
        own, edited, other = (imatch.fingerprint(imatch.terms(t), inside) for t in (a, imatch.edited_text(a, b), b))
        near["edited"] += imatch.likeness(own, edited) / every
        near["next"] += imatch.likeness(own, other) / every
    assert near["edited"] > 0.01 and near["next"] < 0.002


def test_likeness_grades_shared_parts():
    every = (255 * __import__("numpy").ones((1 << imatch.TERM_BITS) // 8)).astype("uint8")
    a, b = prose(11, 400), prose(12, 400)
    own, half, other = (imatch.fingerprint(imatch.terms(t), every) for t in (a, imatch.edited_text(a, b), b))
    assert imatch.likeness(own, own) == 1 and imatch.likeness(own, half) > imatch.likeness(own, other)
    assert imatch.fingerprint(imatch.terms(""), every) == imatch.fingerprint(imatch.terms(" \n"), every)
