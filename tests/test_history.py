"""Histories of clones against git's own answers and against walking back by hand."""

import random
import subprocess

from pyspark.sql import functions as F

from veritrail.sources import history


def test_a_clone_with_renames(spark, tmp_path):
    """Renames, a name that is used again, a deletion and odd names: each file's commits are those
    that git gives when it follows the file; three commits a partition."""
    def git(*a):
        return subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=Ann", "-c", "user.email=a@b.c", *a], check=True, capture_output=True, text=True).stdout

    def commit(message, **files):
        for name, text in files.items():
            name = name.replace("__", "/")
            (tmp_path / name).parent.mkdir(exist_ok=True)
            (tmp_path / name).write_text(text)
        git("add", "-A"), git("commit", "-qm", message)

    body = "".join(f"line {i}\n" for i in range(30))
    git("init", "-q")
    commit("one", a=body, other="x\n" * 40)
    commit("two", a=body + "more\n")
    git("mv", "a", "b c é"), git("commit", "-qm", "three")
    (tmp_path / "b c é").write_text(body + "still more\n")
    git("commit", "-qam", "four")
    commit("five", a="another file\n" * 9)
    git("mv", "b c é", "d"), git("commit", "-qm", "six")
    git("rm", "-q", "other"), git("commit", "-qm", "seven")
    spark.dataSource.register(history.Clones)
    changes = spark.read.format("clone").option("paths", f"{tmp_path},{tmp_path}/none").option("range", 3).load()
    assert changes.rdd.getNumPartitions() == 3 and changes.count() == 8
    found = history.commit_files(changes)
    want = {p: git("log", "--follow", "--format=%H", "HEAD", "--", p).split() for p in ("a", "d")}
    for path, shas in want.items():
        assert [r.sha for r in found.where(F.col("path") == path).orderBy("position").collect()] == shas
    assert {r.path for r in found.select("path").distinct().collect()} == {"a", "d"}
    assert history.commit_files(changes, spark.createDataFrame([("a",), ("other",)], "path string")).select("path").distinct().count() == 1
    assert history.commit_files(changes.limit(0)).count() == 0


def test_long_chains_of_names(spark):
    """Random histories with many renames, among them names that change places."""
    rng = random.Random(9)
    rows = []
    for position in range(1, 120):
        names = rng.sample("abcdef", 2)
        kind = rng.choice(["M", "M", "R", "R", "D"])
        rows.append(("r", position, f"s{position}", None, kind, names[0], names[1] if kind == "R" else None))

    def there(path):
        for r in rows:
            if r[5] == path:
                return r[4] != "D"
            if r[6] == path:
                return False
        return False

    def touching(path):
        out, name = [], path
        for r in rows:
            if name in (r[5], r[6]):
                out.append(r[2])
            if r[5] == name:
                name = r[6] or name
        return out

    changes = spark.createDataFrame(rows, history.CHANGES)
    got = {r.path: r.shas for r in history.commit_files(changes).groupBy("path").agg(F.transform(F.sort_array(F.collect_list(F.struct("position", "sha"))), lambda x: x["sha"]).alias("shas")).collect()}
    assert got == {p: touching(p) for p in "abcdef" if there(p)}


def test_a_name_that_is_taken_again_and_again(spark):
    """Commits meet the episodes that end where their stretch of the name ends: of a name with n episodes
    and n commits, n pairs are made, not n times n."""
    n = 400
    rows = [("r", i, f"s{i}", None, "R", "ab"[i % 2], "ab"[(i + 1) % 2]) for i in range(1, n + 1)]
    found = history.commit_files(spark.createDataFrame(rows, history.CHANGES))
    assert [r.position for r in found.orderBy("position").collect()] == list(range(1, n + 1))
    joined = found._jdf.queryExecution().optimizedPlan().toString()
    assert "until" in joined[joined.index("Join Inner") :].split("\n")[0]


def test_events_are_numbered_in_ranges(spark):
    """No task takes all events in order to number them."""
    import __spark_entry__

    plan = __spark_entry__.queries()["history_window"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    numbers = [line for line in plan.splitlines() if "row_number" in line]
    assert numbers and all("_range" in line for line in numbers)
