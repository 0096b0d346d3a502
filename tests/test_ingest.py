from __future__ import annotations

import csv
import hashlib
import io
import random

import pytest

from tallymark.contracts import RAW_COLUMNS
from tallymark.errors import SourceArtifactError
from tallymark.operators.bronze import parse_instant
from tallymark.sources import csv_artifact
from tallymark.sources.csv_artifact import artifact_digests, read_artifact, read_artifacts

HEADER = ",".join(RAW_COLUMNS)


def line(year="2025", value='"1,234"', name="Agriculture"):
    return f"{year},Level 1,AA,{name},Dollars (millions),H01,Total income,Financial performance,{value},ANZSIC A"


def write(path, *lines, bom=True, ending="\n", encoding="utf-8"):
    text = ending.join([HEADER, *lines]) + ending
    path.write_bytes((b"\xef\xbb\xbf" if bom else b"") + text.encode(encoding))
    return str(path)


def test_text_is_kept_as_it_is(spark, tmp_path):
    path = write(tmp_path / "a.csv", line(), line("2024", "C"), line("2023", ""), line("2022", '" "'),
                 line("2021", '""'), line("x", "007", '"He said ""no"""'), ending="\r\n")
    artifact = read_artifact(spark, path)
    rows = artifact.rows.orderBy("source_row_number").collect()
    assert [r.Value for r in rows] == ["1,234", "C", "", " ", "", "007"]
    assert [r.source_row_number for r in rows] == [1, 2, 3, 4, 5, 6]
    assert rows[5].Industry_name_NZSIOC == 'He said "no"'
    assert artifact.row_count == 6
    expected = hashlib.sha256((tmp_path / "a.csv").read_bytes()).hexdigest().upper()
    assert artifact.source_sha256 == expected


def test_quoted_line_breaks(spark, tmp_path):
    path = write(tmp_path / "a.csv", line(), line("2024", "1", '"Two\nlines"'), line("2023"))
    rows = read_artifact(spark, path).rows.orderBy("source_row_number").collect()
    assert [(r.Year, r.source_row_number) for r in rows] == [("2025", 1), ("2024", 2), ("2023", 3)]
    assert rows[1].Industry_name_NZSIOC == "Two\nlines"


def test_row_numbers_over_many_splits(spark, tmp_path):
    path = write(tmp_path / "a.csv", *[line(str(n), str(n)) for n in range(4_000)])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "60000")
    try:
        artifact = read_artifact(spark, path)
        assert artifact.rows.rdd.getNumPartitions() > 1
        wrong = artifact.rows.where("source_row_number <> CAST(Year AS INT) + 1").count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert (artifact.row_count, wrong) == (4_000, 0)


@pytest.mark.parametrize(
    "content",
    [
        HEADER + "\n",
        "",
        HEADER.upper() + "\n" + line() + "\n",
        HEADER.replace("Year,", "") + "\n" + line() + "\n",
        HEADER + "\n" + line() + ",extra\n",
        HEADER + "\n" + line() + "\n2025,Level 1\n",
        HEADER + "\n" + line() + "\n   \n",
        line() + "\n" + HEADER + "\n",
    ],
)
def test_flawed_files_are_rejected_whole(spark, tmp_path, content):
    (tmp_path / "a.csv").write_text(content)
    with pytest.raises(SourceArtifactError):
        read_artifact(spark, str(tmp_path / "a.csv"))


def test_missing_file_and_bad_encoding(spark, tmp_path):
    with pytest.raises(SourceArtifactError):
        read_artifact(spark, str(tmp_path / "none.csv"))
    path = write(tmp_path / "l.csv", line(name="Pêche"), bom=False, encoding="latin-1")
    with pytest.raises(SourceArtifactError):
        read_artifact(spark, path)


def test_folder_of_artifacts(spark, tmp_path):
    for name, years in (("a.csv", "12"), ("b.csv", "345")):
        write(tmp_path / name, *[line(y) for y in years])
    rows = read_artifacts(spark, str(tmp_path)).collect()
    found = sorted((r.source_file[-5:], r.Year, r.source_row_number, r.row_count) for r in rows)
    assert found == [("a.csv", "1", 1, 2), ("a.csv", "2", 2, 2), ("b.csv", "3", 1, 3),
                     ("b.csv", "4", 2, 3), ("b.csv", "5", 3, 3)]
    assert len({r.source_sha256 for r in rows}) == 2


@pytest.fixture
def small_blocks(spark):
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)

    def set_to(size):
        spark.conf.set(name, str(size))

    yield set_to
    spark.conf.set(name, before)


@pytest.mark.parametrize("block, ending", [(300, "\n"), (150, "\r\n")])
def test_fields_over_lines_and_blocks(spark, tmp_path, small_blocks, block, ending):
    """Records are what Python's reader finds, wherever blocks begin; clean files stay as they are."""
    rng = random.Random(block)
    fields = ["x", "", '""', '"a, b"', f'"{ending}"', f'"two{ending}lines"', f'"q ""{ending}"" q"', f'",{ending}{ending}"', '5" pipe', '"end"""', "\u00e9"]
    lines = [line(str(n), rng.choice(fields), rng.choice(fields)) for n in range(40)] + ["", line("40", f'"{"long " * 60}{ending * 40}"')]
    write(tmp_path / "a.csv", *lines, ending=ending)
    write(tmp_path / "b.csv", *[line(str(n)) for n in range(9)], bom=False)
    small_blocks(block)
    found = read_artifacts(spark, str(tmp_path)).orderBy("source_file", "source_row_number").collect()
    for name in "ab":
        content = (tmp_path / f"{name}.csv").read_bytes()
        wanted = list(csv.reader(io.StringIO(content.decode("utf-8-sig"), newline="")))[1:]
        mine = [r for r in found if r.source_file.endswith(f"{name}.csv")]
        assert [[r[c] for c in RAW_COLUMNS] for r in mine] == [w for w in wanted if w]
        assert [r.source_row_number for r in mine] == list(range(1, len(mine) + 1))
        assert {r.source_sha256 for r in mine} == {hashlib.sha256(content).hexdigest().upper()}


@pytest.mark.parametrize("tail", ['2025,"never closed\n', "2025,x\ry,Level 1\n", ",,\n"])
def test_flaws_beside_fields_over_lines(spark, tmp_path, small_blocks, tail):
    (tmp_path / "a.csv").write_text(HEADER + "\n" + line(name='"a\nb"') + "\n" + tail, newline="")
    small_blocks(60)
    with pytest.raises(SourceArtifactError):
        read_artifact(spark, str(tmp_path / "a.csv"))


@pytest.mark.parametrize("content", [b"\n", b"a", b"a\n", b"\xef\xbb\xbf", b"\xef\xbb\xbfa\n\n", b"\r\n\ra\r", b"ab\n" * 500, b"\n" * 99 + b"z"])
@pytest.mark.parametrize("pack", [1, 1 << 20])
def test_digests_of_any_bytes_in_any_blocks(spark, tmp_path, small_blocks, monkeypatch, content, pack):
    monkeypatch.setattr(csv_artifact, "PACK_BYTES", pack)
    (tmp_path / "a.csv").write_bytes(content)
    (tmp_path / "b.csv").write_bytes(content * 2 + b"b")
    small_blocks(30)
    found = {r.file[-5:]: (r.length, r.source_sha256) for r in artifact_digests(spark, str(tmp_path)).collect()}
    for name in ("a.csv", "b.csv"):
        data = (tmp_path / name).read_bytes()
        assert found[name] == (len(data), hashlib.sha256(data).hexdigest().upper())


def test_timestamps_need_an_offset():
    assert parse_instant("2026-01-02T03:04:05Z").isoformat() == "2026-01-02T03:04:05+00:00"
    assert parse_instant("2026-01-02T03:04:05+13:00").hour == 14
    for bad in ("2026-01-02T03:04:05", "yesterday"):
        with pytest.raises(ValueError):
            parse_instant(bad)


def test_quote_states_are_worked_out_once(spark, tmp_path, monkeypatch):
    """What a line does to the state is stored; neither the blocks' starts nor the lines read it off the text again."""
    from tallymark.sources import csv_artifact

    path = tmp_path / "breaks.csv"
    row = ",".join(["a"] * (len(csv_artifact.RAW_COLUMNS) - 1))
    path.write_text(",".join(csv_artifact.RAW_COLUMNS) + f'\n{row},"x\ny"\n{row},z\n')
    plans, whole = {}, csv_artifact.stage

    def staged(frame, name, **options):
        plans[name] = frame._jdf.queryExecution().optimizedPlan().toString()
        return whole(frame, name, **options)

    monkeypatch.setattr(csv_artifact, "stage", staged)
    last = csv_artifact.RAW_COLUMNS[-1]
    found = {r.source_row_number: r[last] for r in csv_artifact.read_artifacts(spark, str(path)).collect()}
    assert found == {1: "x\ny", 2: "z"}
    assert "aggregate(" in plans["csv-states"]
    assert "aggregate(" not in plans["csv-starts"] and "aggregate(" not in plans["csv-lines"]


def test_windows_hold_a_stretch_of_a_block(spark, tmp_path, monkeypatch):
    """However large a block is, few lines are put in order as one; records go on over many stretches and are parsed once."""
    monkeypatch.setattr(csv_artifact, "STRETCH_LINES", 5)
    rng = random.Random(5)
    fields = ["x", '"a, b"', '"two\nlines"', '"q ""\n"" q"', '"\n\n\n"']
    lines = [line(str(n), rng.choice(fields), rng.choice(fields)) for n in range(60)] + ["", line("60", '"' + "z\n" * 40 + '"'), line("61")]
    write(tmp_path / "a.csv", *lines)
    content, staged, whole = (tmp_path / "a.csv").read_text("utf-8-sig"), {}, csv_artifact.stage
    monkeypatch.setattr(csv_artifact, "stage", lambda frame, name, **options: staged.setdefault(name, whole(frame, name, **options)))
    found = read_artifacts(spark, str(tmp_path / "a.csv")).orderBy("source_row_number").collect()
    wanted = [row for row in list(csv.reader(io.StringIO(content, newline="")))[1:] if row]
    assert [[r[c] for c in RAW_COLUMNS] for r in found] == wanted
    assert [r.source_row_number for r in found] == list(range(1, len(wanted) + 1))
    per_stretch = [r["count"] for r in staged["csv-lines"].groupBy("file", "block", "stretch").count().collect()]
    assert max(per_stretch) <= 5 < sum(per_stretch) / 10
    assert staged["csv-records"].count() == len(wanted)
