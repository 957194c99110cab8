"""CSV files with quoted line breaks, cut at many places, against Spark's own multi-line reader."""

import random

import pytest

from cohortloom.sources import csv_records, read_notes

SCHEMA = "id long, part long, text string"
BITS = ["plain", 'a "quoted" word', "line\nbreak", "\r\ncr lf", "comma, here", '"', '""', "\n\n\n", "", "\u00e9\u6f22", 'end"\n"start', " lead",
        "trail ", "x" * 900, '\n"\n']


def own(spark, path):
    return spark.read.schema(SCHEMA).options(header=True, multiLine=True, escape='"', quote='"').csv(str(path))


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("split_bytes", [700, 9000, None])
def test_torture_files(spark, tmp_path, split_bytes):
    draw = random.Random(split_bytes)
    for n in range(3):
        with open(tmp_path / f"{n}.csv", "w", newline="", encoding="utf-8") as f:
            f.write("id,part,text\n")
            for i in range(150):
                text = "".join(draw.choice(BITS) for _ in range(draw.randrange(5))).replace('"', '""')
                f.write(f'{i},{i % 7 or ""},"{text}"' + draw.choice(["\n", "\r\n", "\n\n"]))
            f.write(f"{n},1,plain tail")
    assert rows(read_notes(spark, str(tmp_path), SCHEMA, split_bytes=split_bytes)) == rows(own(spark, tmp_path))
    splits = csv_records(spark, str(tmp_path), split_bytes).select("file", "split").distinct().count()
    assert splits > 3 if split_bytes else splits >= 3


def test_one_record_over_many_splits(spark, tmp_path):
    text = "\n".join(f'line {i} says ""so""' for i in range(2000))
    (tmp_path / "long.csv").write_text(f'id,part,text\n1,2,"{text}"\n3,4,"short"\n')
    got = rows(read_notes(spark, str(tmp_path), SCHEMA, split_bytes=4000))
    assert got == [(1, 2, text.replace('""', '"')), (3, 4, "short")]


@pytest.mark.parametrize("content", ["", "id,part,text\n", "id,part,text", 'id,part,text\n1,2,"open\nto the end\n'])
def test_short_and_broken_files(spark, tmp_path, content):
    (tmp_path / "x.csv").write_text(content)
    got = rows(read_notes(spark, str(tmp_path), SCHEMA, split_bytes=8))
    assert len(got) == (1 if "open" in content else 0)
    assert all(r[:2] == (1, 2) and r[2].startswith("open\nto the end") for r in got)


def test_split_size_is_put_back(spark, tmp_path):
    (tmp_path / "x.csv").write_text("id,part,text\n1,2,x\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    assert read_notes(spark, str(tmp_path), SCHEMA, split_bytes=5).count() == 1
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before
