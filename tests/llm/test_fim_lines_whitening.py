import hashlib
import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from corpus import awkward, changed, frame, pandas, prose
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import fim, line_dedup, whitening

TOKEN = re.compile("[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
BLANKS = " \t\n\x0b\x0c\r"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- fill-in-middle ------------------------------------------------------------------------


def expected_fim(doc_id, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    mixed = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(mixed[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(tokens) + 1), h[1] % (len(tokens) + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(tokens), "plain", None, None, text
    if h[3] % 100 < 80:
        return len(tokens), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(tokens), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_forms_and_cuts_are_those_of_whole_texts(spark):
    rows = awkward()
    texts = ["a<P>b", "ends <", " <P", "P> S>", "   ", "one ", "\x1c\x1d word \x85 nbsp\xa0x", "é" * 5000]
    texts += [prose(1, 9000) + changed(prose(9, 3000), 4, 5)]
    rows += [(1000 + k, t, *rows[0][2:]) for k, t in enumerate(texts * 9)]
    docs = frame(spark, rows).withColumn("n", F.lit("clash")).withColumn("output", F.lit("clash"))
    made = fim.transform(docs)
    found = pandas(made.withColumn("restored", fim.restore(F.col("output"), F.col("form"))))
    got = sorted((repr((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["restored"])) for r in found))
    assert got == sorted(repr((r[0], *expected_fim(r[0], r[1]), r[1] or "")) for r in rows)
    assert {"score", "key", "length"} <= set(made.columns)
    assert {r["form"] for r in found} == {"plain", "psm", "spm"}


def test_empty_table(spark):
    assert fim.transform(frame(spark, [])).count() == 0
    assert line_dedup.drop_shared_lines(frame(spark, [])).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\té", max_size=400).map(lambda t: t * 7), max_size=6), st.integers(0, 1 << 32))
def test_counts_of_chunks_add_up(texts, draw):
    encoded = [t.encode() for t in texts]
    bounds = np.cumsum([0] + [len(t) for t in encoded])
    data = np.frombuffer(b"".join(encoded), np.uint8)
    draws = np.array([[draw, draw // 3]] * len(texts), np.int64).reshape(-1, 2)
    counts = fim.ChunkCounts(2000)
    for _ in range(2):  # the second time from kept chunks
        tokens, prefix, middle = fim.locate(data, bounds, draws, counts)
        for k, text in enumerate(texts):
            found = TOKEN.findall(text)
            a, b = sorted((draw % (len(found) + 1), draw // 3 % (len(found) + 1)))
            assert (tokens[k], prefix[k], middle[k]) == (len(found), len("".join(found[:a])), len("".join(found[a:b])))


def test_a_kept_summary_is_used_for_equal_bytes_only():
    counts = fim.ChunkCounts()
    counts.of([b"one two "])
    key = next(iter(counts.young))
    # A colliding hash: the key of other content.
    counts.young[key] = (b"something else", (99, 99, 1, 1))
    assert counts.of([b"one two "])[0].tolist() == [2, 8, 1, 0]
    assert counts.hits == 0 and counts.of([b"one two "])[0].tolist() == [2, 8, 1, 0] and counts.hits == 1


def test_texts_with_a_common_passage_share_its_chunks():
    passage = prose(5, 4000).encode()
    counts = fim.ChunkCounts()
    for head in (b"", b"another beginning of some length, longer than the window of the hash "):
        text = head + passage
        data = np.frombuffer(text, np.uint8)
        fim.locate(data, np.array([0, len(text)]), np.array([[5, 9]]), counts)
    assert counts.hits >= len(passage) // 1024 // 2


def test_chunks_are_bounded_and_kept_bytes_too():
    data = np.zeros(5 * fim.LONGEST_CHUNK + 7, np.uint8)
    ends = fim.chunk_ends(data, np.array([0]), np.array([len(data)]))
    assert ends[-1] == len(data) and np.diff(ends, prepend=0).max() <= fim.LONGEST_CHUNK
    counts = fim.ChunkCounts(10_000)
    counts.of([bytes([k % 256, k // 256]) * 50 for k in range(3000)])
    assert sum(len(c) for c, _ in [*counts.young.values(), *counts.old.values()]) <= 2 * 10_000


# --- lines ---------------------------------------------------------------------------------


def expected_lines(rows, min_chars=40, min_documents=5):
    holders = defaultdict(set)

    def key(line):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANKS))

    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(-math.inf if doc_id is None else doc_id)
    made = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        mine = -math.inf if doc_id is None else doc_id
        kept = [x for x in lines if len(holders[key(x)]) < min_documents or max(holders[key(x)]) == mine]
        made.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(made, key=repr)


def lines_of(spark, rows, **options):
    made = line_dedup.drop_shared_lines(frame(spark, rows), **options)
    assert {"score", "key", "length", "kept"} <= set(made.columns)
    return sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in pandas(made)), key=repr)


def test_shared_lines_leave_all_but_the_last_document(spark):
    pick = random.Random(3)
    common = "\xa0Terms of use of EVERY page of this site, été 2020"
    ascii_line = "All rights reserved by the owners of this page."
    short = "x" * 39
    just = "y" * 40
    pool = [common, "  " + common.replace("T", "t") + "\r", ascii_line, "\t" + ascii_line.upper() + " ", short, just, "", " ", "own", just.upper()]
    rows = awkward()
    for k in range(40):
        text = "\n".join(pick.choice(pool) for _ in range(pick.randrange(12)))
        rows.append((pick.choice([None, k, k, k // 2, 5000 + k]), text, *rows[0][2:]))
    rows += [rows[-1]] * 3
    rows.append((9999, "\n".join([just] * 3), *rows[0][2:]))
    found = lines_of(spark, rows)
    assert found == expected_lines([r[:2] for r in rows])
    assert sum(r[2] for r in found) > 30
    assert [r[2:] for r in found if r[0] == 9999] == [(0, "\n".join([just] * 3))]
    loose = dict(min_chars=0, min_documents=2)
    assert lines_of(spark, rows, **loose) == expected_lines([r[:2] for r in rows], **loose)


def test_one_below_the_threshold_stays_and_copies_of_one_id_count_once(spark):
    line = "this line is long enough to count as a shared one"
    rows = awkward()[:1] + [(k, f"{line}\nown {k}", *awkward()[0][2:]) for k in (1, 2, 3, 4, 4, 4)]
    assert all(r[2] == 0 for r in lines_of(spark, rows))
    rows.append((5, line, *awkward()[0][2:]))
    assert sum(r[2] for r in lines_of(spark, rows)) == 6


def test_no_python_runs_for_lines(spark):
    made = line_dedup.drop_shared_lines(frame(spark))
    assert not re.search("Python|Arrow|Pandas", made._jdf.queryExecution().toString())


# --- whitening -----------------------------------------------------------------------------

VECTORS = "vec_id bigint, embedding array<float>, label int, n string, whitened string"


def vectors(spark, rows):
    return spark.createDataFrame([(k, v, 0, "clash", "clash") for k, v in rows], VECTORS)


def made_rows(count, dims, seed, rank=None):
    pick = np.random.default_rng(seed)
    base = pick.standard_normal((count, rank or dims)) @ pick.standard_normal((rank or dims, dims))
    return [(k, [float(c) for c in v]) for k, v in enumerate(base * np.linspace(3, 0.5, dims))]


def brute_force(rows, components=16):
    usable = [(k, v) for k, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1000000 for c in v] for _, v in usable], object)
    distinct = sorted(set(map(tuple, x)))
    n, sums = len(distinct), [sum(d) for d in zip(*distinct)]
    c = np.array([[float(n * a - s) for a, s in zip(v, sums)] for v in distinct]) / n
    values, basis = np.linalg.eigh(c.T @ c / n)
    values, basis = values[::-1][:components], basis[:, ::-1][:, :components]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(v, sums)) for v in x]
    centred = np.array([[float(n * a - s) for a, s in zip(v, sums)] for v in x]) / n
    return usable, n, deviation, centred @ basis / np.sqrt(values), values / np.trace(c.T @ c / n)


@pytest.mark.parametrize("dims", [1, 3, 20, 64])
def test_components_agree_with_an_eigendecomposition(spark, dims):
    rows = made_rows(400, dims, dims)
    rows += [(1000 + k, rows[7][1]) for k in range(200)] + [rows[3], rows[3], (None, rows[2][1])]
    rows += [(2000, None), (2001, [None] * dims), (2002, [math.nan] * dims), (2003, [math.inf] * dims)]
    usable, n, deviation, whitened, explained = brute_force(rows)
    found = pandas(whitening.whiten(vectors(spark, rows)))
    k = min(dims, 16)
    assert len(found) == len(usable) * k
    assert {r["n"] for r in found} == {n}
    value = {(r["vec_id"], r["component"]): r["whitened"] for r in found}  # repeated rows are equal
    got = np.array([[value[v[0], c + 1] for c in range(k)] for v in usable])
    want = whitened
    signs = np.sign((got * want).sum(axis=0))
    assert np.abs(got * signs - want).max() < 1e-9
    assert {(r["vec_id"], r["deviation"]) for r in found} == {(v[0], d) for v, d in zip(usable, deviation)}
    assert all(abs(r["explained"] / explained[r["component"] - 1] - 1) < 1e-9 for r in found)
    assert max(r["identity_error"] for r in found) < 1e-9


def test_directions_without_variance_are_left_out(spark):
    found = pandas(whitening.whiten(vectors(spark, [(k, [float(a), 2.0 * a, 0.5]) for k, a in enumerate([1, 2, 5, 5, 9])])))
    assert {r["component"] for r in found} == {1} and len(found) == 5
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0]), (2, [1.0])], [(1, []), (2, [])], [(1, None)]):
        assert whitening.whiten(vectors(spark, rows)).count() == 0


def test_ragged_and_huge_vectors(spark):
    rows = made_rows(60, 4, 1) + [(900, [1.0, 2.0]), (901, [1e30] * 4), (902, [])]
    found = pandas(whitening.whiten(vectors(spark, rows)))
    assert {r["vec_id"] for r in found} == set(range(60))
    large = [(k, [float(c * 1e6) for c in v]) for k, v in made_rows(60, 4, 1)]
    again = pandas(whitening.whiten(vectors(spark, large)))
    assert len(again) == 240 and max(r["identity_error"] for r in again) < 1e-9


def test_low_rank_and_flat_spectra(spark):
    low = pandas(whitening.whiten(vectors(spark, made_rows(300, 40, 2, rank=5))))
    assert max(r["identity_error"] for r in low) < 1e-4
    corners = [(k, [float((k >> d & 1) * 8) for d in range(7)]) for k in range(128)]  # all eigenvalues equal
    flat = pandas(whitening.whiten(vectors(spark, corners), components=3))
    assert len(flat) == 384 and max(r["identity_error"] for r in flat) < 1e-9
    assert all(abs(r["explained"] - 1 / 7) < 1e-9 for r in flat)
