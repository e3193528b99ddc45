import os
import random
from hashlib import md5

from paperloom.operators import naming
from pyspark.sql import functions as F


def names_by_counting(files, taken):
    """One file after the other, names of the batch itself set aside first."""
    used = set(taken)
    own = {name for _, name in files}
    result = {}
    for path, name in sorted(files, key=lambda one: (one[1], md5(one[0].encode()).hexdigest())):
        candidate, counter = name, 0
        stem, extension = os.path.splitext(name)
        while candidate in used or (counter and candidate in own):
            counter += 1
            candidate = f"{stem}_{counter}{extension}"
        used.add(candidate)
        result[path] = candidate
    return result


def archived(spark, files, taken):
    frame = spark.createDataFrame(files, "src_path string, file_name string")
    known = spark.createDataFrame([(name,) for name in taken], "file_name string")
    rows = naming.archive_names(frame, known).collect()
    assert len(rows) == len(files)
    return {row.src_path: row.archive_name for row in rows}


def test_archive_names_small_cases(spark):
    files = [("l/1/a.pdf", "a.pdf"), ("l/2/a.pdf", "a.pdf"), ("l/3/b.pdf", "b.pdf"), ("l/c", "c"), ("l/9/c", "c")]
    taken = ["a.pdf", "a_1.pdf", "a_3.pdf", "c_01", "b_x.pdf", "other.pdf"]
    found = archived(spark, files, taken)
    assert sorted(found[p] for p in ("l/1/a.pdf", "l/2/a.pdf")) == ["a_2.pdf", "a_4.pdf"]
    assert found["l/3/b.pdf"] == "b.pdf"
    assert sorted([found["l/c"], found["l/9/c"]]) == ["c", "c_1"]
    assert archived(spark, [("x/n.pdf", "n.pdf")], []) == {"x/n.pdf": "n.pdf"}


def test_archive_names_against_counting(spark, monkeypatch):
    monkeypatch.setattr(naming, "_COUNTERS_PER_SEGMENT", 5)
    pick = random.Random(5)
    pool = ["hot.pdf"] * 8 + ["hot_1.pdf", "hot_1_1.pdf", "hot_12.pdf", "v1.2.pdf", "plain", "plain_2", ".x", ".x_1"]
    files = [(f"in/{i}/{name}", name) for i, name in enumerate(pick.choices(pool, k=120))]
    taken = [f"hot_{i}.pdf" for i in pick.sample(range(1, 90), 40)] + ["hot.pdf", "plain_1", "hot_007.pdf"]
    found = archived(spark, files, taken)
    assert found == names_by_counting(files, taken)
    assert len(set(found.values())) == len(files) and not set(found.values()) & set(taken)


def test_landing_paths(spark):
    uploads = spark.createDataFrame([(1, "a.b.pdf"), (2, "noext"), (3, "a.b.pdf")], "k long, name string")
    folder = naming.landing_folder("cat", "sch")
    assert folder == "/Volumes/cat/sch/documents/landing"
    rows = naming.landing_paths(uploads, "name", F.col("k"), folder).orderBy("k").collect()
    assert [row.landing_path.rsplit(".", 1)[1] for row in rows] == ["pdf", "noext", "pdf"]
    assert all(row.landing_path == f"{folder}/{row.upload_id}.{row.name.split('.')[-1]}" for row in rows)
    assert len({row.upload_id for row in rows}) == 3
