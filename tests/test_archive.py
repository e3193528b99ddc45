"""Archive names from state, and files that lie where the tables say."""

import os
import random
from hashlib import md5

import pytest
from pyspark.sql import functions as F
from test_ingest import NOW, put, run, table
from test_naming import names_by_counting

from paperloom import schemas
from paperloom.operators import name_registry
from paperloom.operators.name_registry import Counters, Names, counted_as
from paperloom.plans import ingest_flow
from paperloom.sources.archive import ARCHIVED, MISSING, TAKEN, move_file
from paperloom.streaming.archive_stream import start_archiving
from paperloom.streaming.ingest_stream import start_ingest


def dispositions(spark, store):
    schema = spark.createDataFrame([], ingest_flow.DISPOSITION).schema
    return table(spark, store, ingest_flow.DISPOSITION_TABLE, schema)


def test_counters_are_the_lowest_that_are_free():
    draw = random.Random(1)
    for _ in range(200):
        counters, used = Counters(), set()
        for _ in range(draw.randrange(8)):
            first = draw.randrange(0, 30)
            last = first + draw.randrange(4)
            counters.add(first, last)
            used.update(range(first, last + 1))
        assert all(counters.holds(n) == (n in used) for n in range(40))
        assert all(b[0] > a[1] + 1 for a, b in zip(counters.intervals, counters.intervals[1:]))
        count = draw.randrange(12)
        runs = counters.free(count)
        free = [n for n in range(1, 60) if n not in used][:count]
        assert [n for at, run_ in runs for n in range(at, at + run_)] == free
    assert counted_as("a_1_12.pdf") == ("a_1.pdf", 12) and counted_as("a_01") == ("a_01", 0)


def granted(batch, names_of, files):
    """Names by path for files of one batch, from the grants of their names."""
    counts, out = {}, {}
    ordered = sorted(files, key=lambda one: (md5(one[0].encode()).hexdigest(), one[0]))
    positions = {}
    for path, name in ordered:
        positions[path] = counts.get(name, 0)
        counts[name] = positions[path] + 1
    grants = {}
    for name, position, run_, counter in names_of.serve(batch, counts):
        for k in range(run_):
            grants[name, position + k] = counter + k
    for path, name in files:
        counter = grants[name, positions[path]]
        stem, extension = os.path.splitext(name)
        out[path] = f"{stem}_{counter}{extension}" if counter else name
    return out


def test_names_of_many_batches_equal_counting():
    draw = random.Random(7)
    pool = ["hot.pdf"] * 5 + ["hot_1.pdf", "hot_2.pdf", "hot_1_1.pdf", "hot_12.pdf", "hot_3_2.pdf"]
    state, used = {}, set()
    names = Names(state.get, state.__setitem__)
    for batch in range(60):
        files = [(f"in/{batch}/{i}/{name}", name) for i, name in enumerate(draw.choices(pool, k=draw.randrange(9)))]
        found = granted(batch, names, files)
        assert found == names_by_counting(files, used)
        again = granted(batch, names, files)
        assert again == found  # asked for again, as after a failure
        used |= set(found.values())
    # What is kept for the most frequent name does not grow with its files.
    assert len(state["hot.pdf"]["used"]) <= 3


def landing_with(folder, rows):
    for name, text in rows:
        put(folder, name, text)


def test_stream_names_equal_those_of_all_batches(spark, tmp_path):
    store, landing = str(tmp_path / "store"), tmp_path / "landing"
    checkpoints = str(tmp_path / "c1"), str(tmp_path / "c2")
    draw, used, want = random.Random(3), set(), {}
    for step in range(3):
        rows = [
            (f"{step}/{i}/{draw.choice(['x.pdf', 'x_1.pdf', 'y.PDF', 'bad.pdf'])}", f"text {step} {i}")
            for i in range(6)
        ]
        landing_with(landing, [(n, b"\xff" if "bad" in n else t) for n, t in rows])
        run(start_ingest(spark, str(landing), store, checkpoints[0], clock=lambda: NOW))
        files = []
        for name, _ in rows:
            folder = "errors" if "bad" in name else "processed"
            path = f"file:{landing}/{name}"
            files.append((path, f"{folder}/{name.rsplit('/', 1)[1]}"))
        found = names_by_counting(files, used)
        used |= set(found.values())
        want.update(found)
        run(start_archiving(spark, store, checkpoints[1], str(tmp_path / "archive")))
    rows = dispositions(spark, tmp_path / "store").collect()
    assert {r.src_path: r.archived_path for r in rows} == want
    for r in rows:
        step, i, _ = r.src_path.rsplit("/", 3)[1:]
        text = (tmp_path / "archive" / r.archived_path).read_bytes()
        assert text == (b"\xff" if "bad" in r.src_path else f"text {step} {i}".encode())
    assert not [p for p in landing.rglob("*") if p.is_file()]
    assert table(spark, tmp_path / "store", "document", schemas.DOCUMENT).count() == sum("bad" not in p for p in want)


def test_batch_that_was_cut_off_goes_on(spark, tmp_path):
    store, landing, archive = str(tmp_path / "store"), tmp_path / "landing", tmp_path / "archive"
    checkpoints = str(tmp_path / "c1"), str(tmp_path / "c2")
    texts = {f"{i}/same.pdf": f"text {i}" for i in range(9)}
    landing_with(landing, texts.items())
    run(start_ingest(spark, str(landing), store, checkpoints[0], clock=lambda: NOW))
    limit = str(tmp_path / "moved")

    def breaking(source, target):
        with open(limit, "a") as log:
            log.write("x")
        if os.path.getsize(limit) > 4:
            raise OSError("cut off")
        return move_file(source, target)

    query = start_archiving(spark, store, checkpoints[1], str(archive), breaking)
    with pytest.raises(Exception, match="cut off"):
        query.awaitTermination(120)
    left = [p for p in landing.rglob("*.pdf")]
    there = [p for p in archive.rglob("*.pdf")]
    assert left and there and len(left) + len(there) == 9
    before = {r.src_path: r.archived_path for r in dispositions(spark, tmp_path / "store").collect()}
    # An ingest batch that is replayed now does not lose the files that are gone.
    assert ingest_flow.is_taken_in(
        spark, store, spark.createDataFrame([(f"file:{p}",) for p in left], "path string"), 0
    )
    run(start_archiving(spark, store, checkpoints[1], str(archive)))
    rows = dispositions(spark, tmp_path / "store").collect()
    assert {r.src_path: r.archived_path for r in rows} == before and len(rows) == 9
    assert not [p for p in landing.rglob("*.pdf")]
    for r in rows:
        assert (archive / r.archived_path).read_text() == texts["/".join(r.src_path.split("/")[-2:])]
    moves = spark.read.parquet(f"{store}/{ingest_flow.MOVE_TABLE}").collect()
    assert len(moves) == 9 and {r.state for r in moves} == {ARCHIVED}


def test_moves_never_overwrite_and_can_be_repeated(tmp_path):
    a, b = tmp_path / "a b#1.pdf", tmp_path / "to" / "c%20.pdf"
    a.write_text("one")
    assert move_file(f"file:{a}", str(b)) == ARCHIVED and b.read_text() == "one" and not a.exists()
    assert move_file(f"file:{a}", str(b)) == ARCHIVED
    a.write_text("two")
    assert move_file(f"file:{a}", str(b)) == TAKEN and a.exists() and b.read_text() == "one"
    a.write_text("one")  # a copy that was cut off before its source went
    assert move_file(str(a), f"file://{b}") == ARCHIVED and not a.exists()
    assert move_file(str(a), str(tmp_path / "none")) == MISSING


def test_hot_name_is_spread_and_batches_do_not_depend_on_each_other(spark):
    rows = [(f"in/{i}/hot.pdf", "hot.pdf", "processed", "p") for i in range(3000)]
    rows += [(f"in/{i}/n{i}.pdf", f"n{i}.pdf", "processed", "p") for i in range(300)]
    asked = spark.createDataFrame(rows, "src_path string, file_name string, outcome string, target_folder string")
    requested = name_registry.requests(asked)
    taken = name_registry.takes(requested)
    assert taken.count() == 301
    assert taken.filter("file_name = 'hot.pdf'").first().files == 3000
    grants = spark.createDataFrame(
        [(0, "p", "hot.pdf", 0, 1, 0), (0, "p", "hot.pdf", 1, 2000, 5), (0, "p", "hot.pdf", 2001, 999, 9000)]
        + [(0, "p", f"n{i}.pdf", 0, 1, 0) for i in range(300)],
        name_registry.GRANTED,
    )
    named = name_registry.granted_names(requested, grants).collect()
    hot = {r.archived_path for r in named if "/hot" in r.archived_path}
    want = {"p/hot.pdf", *(f"p/hot_{5 + i}.pdf" for i in range(2000)), *(f"p/hot_{9000 + i}.pdf" for i in range(999))}
    assert hot == want and len(named) == 3300
    assert requested.filter(F.col("position") < 0).isEmpty()
