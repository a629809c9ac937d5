import unicodedata

import pytest
from pyspark.sql import functions as F

from tidemark.functions import paths as pt
from tidemark.operators.diff import collision_members, path_collisions


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "p string").select(column(F.col("p"))).first()[0]


def test_forms_are_nfc_and_fully_case_folded(spark):
    given = ["notes/cafe\u0301.txt", "Straße/FILE.txt", "STRASSE/file.txt", "Plain/Name", None, "ΑΣ/ς"]
    rows = pt.normalize_paths(spark.createDataFrame([(g,) for g in given], "p string"), "p").collect()
    by_path = {r.p: (r.display, r.path_key) for r in rows}
    assert by_path[given[0]] == ("notes/caf\u00e9.txt", "notes/caf\u00e9.txt")
    assert by_path[given[1]][1] == by_path[given[2]][1] == "strasse/file.txt"
    assert by_path[given[1]][0] == "Straße/FILE.txt"
    assert by_path["Plain/Name"] == ("Plain/Name", "plain/name")
    assert by_path[None] == (None, None)
    key = "/".join(unicodedata.normalize("NFC", part.casefold()) for part in given[5].split("/"))
    assert by_path[given[5]][1] == key


@pytest.mark.parametrize(
    "path, error",
    [
        ("", "EMPTY"),
        ("/absolute.txt", "NOT_RELATIVE"),
        ("folder/", "NOT_RELATIVE"),
        ("folder//file.txt", "EMPTY_COMPONENT"),
        ("../secret.txt", "TRAVERSAL"),
        ("a/./b", "TRAVERSAL"),
        ("a/" + "é" * 128, "COMPONENT_TOO_LONG"),
        ("a/" + "é" * 127, None),
        ("folder/trailing. ", "TRAILING_DOT_OR_SPACE"),
        ("CON.txt", "RESERVED_NAME"),
        ("a/lpt9", "RESERVED_NAME"),
        ("a/COM0", None),
        ("folder\\file.txt", "FORBIDDEN_CHAR"),
        ("a/b\u0085c", "FORBIDDEN_CHAR"),
        ("a/what?", "FORBIDDEN_CHAR"),
        ("x" * 300 + "/..", "COMPONENT_TOO_LONG"),
        ("/".join(["d" * 200] * 21), "PATH_TOO_LONG"),
        ("docs/report.txt", None),
        ("line\nbreak", "FORBIDDEN_CHAR"),
        ("ends.\n", "FORBIDDEN_CHAR"),
    ],
)
def test_first_failing_rule(spark, path, error):
    assert one(spark, path, pt.path_error) == error


@pytest.mark.parametrize(
    "path, parts",
    [
        ("docs/quarterly.report.pdf", ("docs", "quarterly.report.pdf", "quarterly.report", "pdf")),
        (".bashrc", (None, ".bashrc", ".bashrc", None)),
        ("a/name.", ("a", "name.", "name.", None)),
        ("a/b/plain", ("a/b", "plain", "plain", None)),
        ("été.ß", (None, "été.ß", "été", "ß")),
    ],
)
def test_parts(spark, path, parts):
    df = spark.createDataFrame([(path,)], "p string")
    p = F.col("p")
    row = df.select(pt.parent_path(p), pt.file_name(p), pt.file_stem(p), pt.file_extension(p)).first()
    assert tuple(row) == parts


@pytest.mark.parametrize(
    "label, expected",
    [
        ("Desk/Top:1", "Desk_Top_1"),
        ("  padded . .", "padded"),
        ("...", "device"),
        (" x ", "x"),
        ("a\tb", "a_b"),
        ("é" * 40, "é" * 24),
        ("x" + "é" * 40, "x" + "é" * 23),
        ("😀" * 20, "😀" * 12),
        ("ab" + "😀" * 20, "ab" + "😀" * 11),
    ],
)
def test_labels(spark, label, expected):
    assert one(spark, label, pt.portable_label) == expected


@pytest.mark.parametrize("limit", range(0, 12))
def test_truncation_never_splits_a_character(spark, limit):
    text = "aé漢😀z"
    got = one(spark, text, lambda p: pt.truncate_bytes(p, F.lit(limit)))
    expected = text.encode()[:limit].decode(errors="ignore")
    assert got == expected


def test_conflict_name_keeps_extension_and_fits(spark):
    revision = F.lit("00000000-0000-0000-0000-000000001234")
    name = one(
        spark,
        "docs/quarterly.report.pdf",
        lambda p: pt.conflict_path(p, F.lit("My/Desktop:1"), F.lit(1_700_000), revision, "Copy conflict"),
    )
    assert name == "docs/quarterly.report (Copy conflict My_Desktop_1 1700000 00000000).pdf"
    long = one(spark, "é" * 120 + ".txt", lambda p: pt.conflict_path(p, F.lit("d"), F.lit(1), revision))
    assert len(long.encode()) <= 255 and long.endswith(" (conflict d 1 00000000).txt")


def test_collisions_report_every_row(spark):
    rows = [("docs/A.txt",), ("docs/a.txt",), ("docs/b.txt",), ("Straße",), ("STRASSE",)]
    df = pt.normalize_paths(spark.createDataFrame(rows, "path string"), "path")
    found = {r.path_key: (r.n, r.first_path, r.last_path) for r in path_collisions(df).collect()}
    assert found == {"docs/a.txt": (2, "docs/A.txt", "docs/a.txt"), "strasse": (2, "STRASSE", "Straße")}
    assert collision_members(df).count() == 4
