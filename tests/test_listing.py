"""Folders are listed by tasks, with what Spark's own listing gives."""

from blockloom.sources import ranges


def test_a_tree_is_listed_as_spark_lists_it(spark, tmp_path):
    for name in ("a", "b/c d", "b/e/f", "b/_g", "b/.h", "_i/j", "b/k=1/l", "_m=2/n"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())
    (tmp_path / "b/empty").write_bytes(b"")
    for root in (str(tmp_path), f"file://{tmp_path}/"):
        want = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")
        got = [tuple(r) for r in ranges.list_tree(spark, root).collect()]
        assert sorted((p.removeprefix("file:"), *rest) for p, *rest in got) == sorted((p.removeprefix("file:"), *rest) for p, *rest in map(tuple, want.collect()))
