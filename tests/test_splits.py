"""Pattern files of many splits are numbered and paired like small ones."""

import random

from stringloom.sources import texts as sources


def test_pairs_across_splits(spark, tmp_path):
    rng, files = random.Random(1), {}
    for name in ("a.fa", "b.fa"):
        lines = [x for i in range(200) for x in (f"> {i}", "".join(rng.choice("ACGT") for _ in range(rng.randint(0, 90))))]
        files[name] = lines + (["> alone"] if name == "b.fa" else [])
        end = "\r\n" if name == "b.fa" else "\n"
        (tmp_path / name).write_bytes((end.join(files[name]) + end).encode())
    (tmp_path / "c.fa").write_text("")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        numbered = sources.numbered_lines(spark, str(tmp_path))
        got = {(r["path"].rsplit("/", 1)[1], r["line"]): r["value"] for r in numbered.collect()}
        assert got == {(f, i): x for f, lines in files.items() for i, x in enumerate(lines)}
        pairs = {(r["path"].rsplit("/", 1)[1], r["pattern_id"]): (r["header"], r["seq"]) for r in sources.read_patterns(spark, str(tmp_path)).collect()}
        assert pairs == {(f, i // 2): (lines[i], lines[i + 1]) for f, lines in files.items() for i in range(0, len(lines) - 1, 2)}
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_interval_header(spark, tmp_path):
    (tmp_path / "i").write_text("# number=2 length=10 file=some text.txt\n1,10\n5,14\n")
    assert [tuple(r)[1:] for r in sources.read_interval_header(spark, str(tmp_path / "i")).collect()] == [(2, 10, "some text.txt")]
    assert sources.read_intervals(spark, str(tmp_path / "i")).count() == 2
