"""Pages by ranges of bytes against files decoded whole."""

import random

import pytest
from pyspark.sql import functions as F

from paperloom.operators.ingest import decode_files, page_rows
from paperloom.sources import page_source
from paperloom.sources.landing import landing_files
from paperloom.sources.page_source import _Range, listed, numbered_pages, pages_in, read_pages, stream_pages


def write(folder, name, content):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content)
    return path


@pytest.fixture
def landing(tmp_path):
    draw = random.Random(3)
    folder = tmp_path / "land ing"
    for i in range(4):
        pages = ["é漢 ab\n" * draw.randrange(0, 9) for _ in range(draw.randrange(1, 12))]
        write(folder, f"{i % 3}/file {i}#%20.pdf", "\f".join(pages).encode())
    write(folder, "empty.PDF", b"")
    write(folder, "ends.pdf", b"one\f")
    write(folder, "only.pdf", b"\f\f")
    write(folder, "notes.txt", b"no")
    return folder


@pytest.mark.parametrize("size", [100, 10**6])
def test_pages_equal_those_of_whole_files(spark, landing, monkeypatch, size):
    files = landing_files(spark, str(landing))
    want = sorted(tuple(r) for r in page_rows(decode_files(files)).collect())
    rows = read_pages(spark, str(landing), rangeBytes=size)
    got = sorted(tuple(r) for r in numbered_pages(rows).collect())
    assert got == want and len({r[0] for r in got}) == 6
    times = {r.path: r.modificationTime for r in files.select("path", "modificationTime").collect()}
    assert all(abs((r.modificationTime - times[r.path]).total_seconds()) < 0.01 for r in rows.collect())


def test_every_range_and_piece_gives_each_page_once(tmp_path, monkeypatch):
    draw = random.Random(5)
    for _ in range(150):
        content = bytes(draw.choice(b"ab\f") for _ in range(draw.randrange(40)))
        path = str(write(tmp_path, "x.pdf", content))
        monkeypatch.setattr(page_source, "_PIECE", draw.randrange(1, 9))
        parts = page_source.ranges([(0, path, len(content))], draw.randrange(1, 12))
        got = [page for part in parts for page in pages_in(part, b"\f")]
        assert [page for _, page in got] == content.split(b"\f")
        places = [begins for begins, _ in got]
        assert places == sorted(set(places))


def test_large_file_is_read_by_many_tasks(spark, tmp_path):
    line = ("x" * 999 + "\f").encode()
    write(tmp_path, "large.pdf", line * 20_000)
    rows = read_pages(spark, str(tmp_path), rangeBytes=2_000_000)
    counts = rows.groupBy(F.spark_partition_id()).count().collect()
    assert len(counts) == 10 and {r["count"] for r in counts} <= {2000, 2001}
    part = _Range(f"file:{tmp_path}/large.pdf", 0, 4_000_000, 6_000_000, len(line) * 20_000)
    assert sum(1 for _ in pages_in(part, b"\f")) == 2000


def test_a_page_that_cannot_be_read_fails_its_file_alone(spark, tmp_path):
    write(tmp_path, "bad.pdf", b"good\f\xff\fgood")
    write(tmp_path, "good.pdf", b"a\fb")
    rows = read_pages(spark, str(tmp_path), rangeBytes=2)
    failed = rows.filter("error_message is not null").collect()
    assert [r.begins for r in failed] == [5] and failed[0].error_message.startswith("Failed to extract text")
    assert {r.path.rsplit("/", 1)[1] for r in numbered_pages(rows).collect()} == {"good.pdf"}
    upper = read_pages(spark, str(tmp_path), decode=lambda content: content.decode("latin-1").upper())
    assert upper.filter("page_text = 'GOOD'").count() == 2
    with pytest.raises(Exception, match="boundary"):
        read_pages(spark, str(tmp_path), boundary="ab").count()
    assert read_pages(spark, str(tmp_path / "nowhere")).count() == 0


def test_stream_takes_each_file_once(spark, tmp_path):
    folder, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    folder.mkdir()

    def run():
        query = (
            stream_pages(spark, str(folder), rangeBytes=3)
            .writeStream.format("parquet")
            .option("checkpointLocation", state)
            .trigger(availableNow=True)
            .start(out)
        )
        assert query.awaitTermination(120) and query.exception() is None

    write(folder, "a.pdf", b"one\ftwo")
    run()
    run()
    write(folder, "b/c.pdf", b"three\fffff")
    run()
    rows = spark.read.parquet(out).collect()
    assert sorted((r.path.rsplit("/", 1)[1], r.page_text) for r in rows) == [
        ("a.pdf", "one"), ("a.pdf", "two"), ("c.pdf", "ffff"), ("c.pdf", "three"),
    ]
    assert [x[1] for x in listed(str(folder), ".pdf")][0].startswith("file:/")
