"""Change streams: snapshots by digest, and the newest change of each path."""

import random
import time

from graphloom.sources.watch import NONE, Snapshots
from graphloom.streaming.newest import newest_changes


def plain(before, after):
    old, new = ({p: (n, t) for p, n, t in files} for files in (before, after))
    rows = [(p, "added" if p not in old else "modified", x[1]) for p, x in new.items() if old.get(p) != x]
    return sorted(rows + [(p, "deleted", old[p][1] + 1) for p in old.keys() - new.keys()])


def test_snapshots_tell_all_changes(tmp_path):
    draw, s = random.Random(3), Snapshots(f"file://{tmp_path}")
    trees = [[]]
    for _ in range(12):
        files = {p: (n, t) for p, n, t in trees[-1]}
        for _ in range(30):
            p = "/".join(f"d{draw.randrange(3)}" for _ in range(draw.randrange(4))) + f"/f{draw.randrange(9)}.py"
            files[p.lstrip("/")] = (draw.randrange(5), draw.randrange(100))
        for p in draw.sample(sorted(files), 10):
            del files[p]
        trees.append([(p, n, t) for p, (n, t) in files.items()])
    digests = [s.take(x) for x in trees]
    assert digests[0] == NONE and s.take(list(reversed(trees[3]))) == digests[3]
    for i in range(len(trees)):
        for j in (i, max(0, i - 1), draw.randrange(len(trees))):
            assert sorted(s.changes(digests[i], digests[j])) == plain(trees[i], trees[j])


def test_a_file_becomes_a_folder(tmp_path):
    s = Snapshots(str(tmp_path))
    a, b = s.take([("x.py", 1, 5)]), s.take([("x.py/y.py", 1, 6)])
    assert sorted(s.changes(a, b)) == [("x.py", "deleted", 6), ("x.py/y.py", "added", 6)]


def test_only_differing_folders_are_read_and_written(tmp_path):
    files = [(f"a{i}/b{j}/f{k}.py", 1, 1) for i in range(10) for j in range(10) for k in range(10)]
    s = Snapshots(f"file://{tmp_path}")
    first = s.take(files)
    assert s.written == 3 and len(first) == 64  # equal folders are kept once
    s.read = s.written = 0
    second = s.take([(p, n, 2 if p == "a3/b4/f5.py" else t) for p, n, t in files])
    assert s.written == 3 and list(s.changes(first, second)) == [("a3/b4/f5.py", "modified", 2)] and s.read == 6
    assert s.take(files) == first and s.written == 3


def stream(spark, folder, name, **options):
    changes = spark.readStream.schema("path string, change string, at long").option("maxFilesPerTrigger", 1).json(str(folder / "in"))
    out = newest_changes(changes, **options)
    return lambda trigger: out.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(folder / "check")).trigger(**trigger).start()


def put(spark, folder, k, *rows):
    (folder / "in").mkdir(exist_ok=True)
    import json

    (folder / "in" / f"{k:03d}.json").write_text("".join(json.dumps(dict(zip(("path", "change", "at"), r))) + "\n" for r in rows))
    time.sleep(0.02)  # files are taken in order of their times


def test_late_changes_are_dropped_across_batches(spark, tmp_path):
    put(spark, tmp_path, 0, ("a", "added", 1), ("a", "modified", 5), ("b", "added", 2))
    put(spark, tmp_path, 1, ("a", "modified", 4), ("b", "deleted", 3), ("c", "added", 9))
    put(spark, tmp_path, 2, ("a", "deleted", 5), ("c", "modified", 8), ("b", "added", 7), ("b", "modified", 7))
    query = stream(spark, tmp_path, "late", delay_ms=0)({"availableNow": True})
    assert query.awaitTermination(120)
    got = sorted(map(tuple, spark.table("late").collect()))
    assert got == [("a", "modified", 5), ("b", "added", 2), ("b", "deleted", 3), ("b", "modified", 7), ("c", "added", 9)]


def test_changes_wait_until_a_path_rests(spark, tmp_path):
    put(spark, tmp_path, 0, ("a", "added", 1), ("b", "added", 1))
    put(spark, tmp_path, 1, ("a", "modified", 2), *[("many", "modified", i) for i in range(1, 6)])
    put(spark, tmp_path, 2, ("a", "modified", 3))
    query = stream(spark, tmp_path, "rest", delay_ms=4000, waiting=5)({"processingTime": "200 milliseconds"})
    try:
        seen, until = [], time.time() + 90
        while time.time() < until and len(seen) < 3:
            seen = sorted(map(tuple, spark.table("rest").collect()))
            time.sleep(0.3)
    finally:
        query.stop()
    assert seen == [("a", "modified", 3), ("b", "added", 1), ("many", "modified", 5)]
