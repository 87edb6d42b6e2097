"""Files of records with quoted line breaks, in several encodings and split anywhere, against the plain csv module."""

import csv
import io
import random

import pytest

from quadrat.sources import delimited as D

PAGES = ("utf-8", "utf-8-sig", "cp1252", "cp850", "utf-16")


def made(seed, accents):
    chance = random.Random(seed)
    parts = ["a", "b c", "\n", '"', ";", "\r\n", ",", "x\n\ny", *accents]
    cell = lambda: "".join(chance.choice(parts) for _ in range(chance.randrange(6)))
    return [(f"r{i}", cell(), "end" + cell().replace('"', "")) for i in range(400)]


def written(rows, page, breaks):
    out = io.StringIO()
    csv.writer(out, delimiter=";", quoting=csv.QUOTE_ALL, lineterminator=breaks).writerows([("id", "nota", "fim"), *rows])
    return out.getvalue().encode(page)


def seen(cell):
    return cell.replace("\r\n", "\n").replace("\r", "\n") or None


@pytest.mark.parametrize("page", PAGES)
@pytest.mark.parametrize("breaks", ["\n", "\r\n"])
def test_records_of_split_files(spark, tmp_path, page, breaks):
    rows = made(page, ["São João", "açaí", "maçã", "ção"] * 2)
    (tmp_path / "a.csv").write_bytes(written(rows, page, breaks))
    want = [(i, *map(seen, r)) for i, r in enumerate(rows)]
    for size in ("1g", "700"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        try:
            got, report = D.read_delimited(spark, str(tmp_path / "a.csv"))
            assert sorted(tuple(r) for r in got.collect()) == want, size
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
    assert report.headers == ["id", "nota", "fim"] and report.delimiter == ";"
    assert set(report.encodings) <= {"UTF-8", {"cp1252": "Windows-1252", "cp850": "CP850", "utf-16": "UTF-16LE"}.get(page, "UTF-8")}


def test_several_files_with_headers_and_a_sep_line(spark, tmp_path):
    for name in ("b", "a"):
        (tmp_path / f"{name}.csv").write_text(f'sep=;\nx;"y\n2"\n{name};"1\n{name}"\n\n{name};2\n', encoding="utf-8")
    got, report = D.read_delimited(spark, str(tmp_path))
    assert report.sep_line and report.headers == ["x", "y\n2"]
    rows = sorted(tuple(r) for r in got.collect())
    assert [r[1:] for r in rows] == [("a", "1\na"), ("a", "2"), ("b", "1\nb"), ("b", "2")] and len({r[0] for r in rows}) == 4


def test_long_header_and_late_vote(spark, tmp_path):
    """A header of more lines than any peek, in a code page that only the last line tells."""
    head = '"' + "\n".join(f"l{i}" for i in range(80)) + 'ç";b\n'
    (tmp_path / "a.csv").write_bytes((head + "x;y\n" * 500 + "ã" * 40 + ";ç\n").encode("cp850"))
    got, report = D.read_delimited(spark, str(tmp_path / "a.csv"))
    assert report.headers[0].endswith("l79ç") and got.count() == 501
    assert got.filter("b = 'ç'").count() == 1


def test_nul_bytes_are_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"a,b\n1,\x00\n")
    with pytest.raises(Exception, match="NUL"):
        D.read_delimited(spark, str(tmp_path / "a.csv"))[0].collect()
