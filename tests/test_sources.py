import pytest
from pyspark.sql import functions as F

from twinfold.policy import load_policy
from twinfold.sources import sinks, snapshots
from twinfold.sources.staging import materialize


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_csv_is_read_as_text_in_file_order(spark, tmp_path):
    path = write(tmp_path / "a.csv", " Worker ID ,Salary,Note\n007,1.50,\nx,,\"a,b\"\n")
    rows = snapshots.read_snapshot(spark, path).orderBy("src_ord").collect()
    assert [r.asDict() for r in rows] == [
        {"Worker ID": "007", "Salary": "1.50", "Note": "", "src_ord": 0},
        {"Worker ID": "x", "Salary": "", "Note": "a,b", "src_ord": 1}]
    nulls = snapshots.read_snapshot(spark, path, blank_as_null=True).orderBy("src_ord").collect()
    assert nulls[1]["Salary"] is None


def test_quoted_text_is_read_as_written(spark, tmp_path):
    import pandas as pd

    text = 'id,note,more\n1,"line one\nline two",a\n2,"He said ""hi"", twice",b\n3,"end\\\\",c\n4,back\\\\slash,"x,y"\n'
    path = write(tmp_path / "q.csv", text)
    expected = pd.read_csv(path, dtype=str).to_dict("records")
    got = snapshots.read_snapshot(spark, path).orderBy("src_ord").drop("src_ord").collect()
    assert [r.asDict() for r in got] == expected


def split_small(spark, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")


@pytest.fixture
def splits(spark):
    yield lambda size: split_small(spark, size)
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("size", [70, 900, 1 << 27])
def test_quoted_line_breaks_are_read_in_splits(spark, tmp_path, splits, size):
    import random

    import pandas as pd

    random.seed(size)
    expected = []
    for part, end in enumerate(("\n", "\r\n")):
        def field():
            inner = "".join(random.choice(["a", " ", ",", '""', "\n", "x", "\r\n", "é"]) for _ in range(random.randint(0, 8)))
            return random.choice([f'"{inner}"', f'"{inner}"', "", "pl'ain", 'in"side'])

        lines = ['id,"no\nte",c'] + [f"{k},{field()},{field()}" + random.choice(["", "", end]) for k in range(150)]
        path = tmp_path / f"p{part}.csv"
        path.write_text(end.join(lines) + random.choice(["", end]), encoding="utf-8", newline="")
        expected += pd.read_csv(path, dtype=str, keep_default_na=False).values.tolist()
    splits(size)
    df = snapshots.read_snapshot(spark, str(tmp_path))
    assert df.columns == ["id", "no\nte", "c", "src_ord"] and (size > 1000 or df.rdd.getNumPartitions() > 4)
    rows = sorted(map(tuple, df.collect()), key=lambda r: r[3])
    assert [list(r[:3]) for r in rows] == expected and [r[3] for r in rows] == list(range(len(expected)))


def test_odd_csv_files(spark, tmp_path, splits):
    splits(16)
    one = lambda text: [tuple(r) for r in snapshots.read_snapshot(spark, write(tmp_path / "o.csv", text)).orderBy("src_ord").collect()]
    assert one("a,b\n") == [] and one("a,b") == []
    assert one("a,b\n1\n2,3,4\n\n  \n5,6") == [("1", "", 0), ("2", "3", 1), ("5", "6", 2)]
    whole = "y" * 100 + "\n\n" + "z" * 40  # a record over many splits, some wholly inside it
    assert one(f'a,b\n1,"{whole}"\n2,x\n') == [("1", whole, 0), ("2", "x", 1)]
    assert one('a,b\n1,x\n2,"never closed\n3,4\n')[0] == ("1", "x", 0) and len(one('a,b\n1,x\n2,"never closed\n3,4\n')) == 2


def test_numbering_covers_many_splits(spark, tmp_path, splits):
    spark.range(5000).select(F.col("id").cast("string").alias("v")).coalesce(1).write.csv(str(tmp_path / "t"), header=True)
    splits(4096)
    df = snapshots.read_snapshot(spark, str(tmp_path / "t"))
    assert df.rdd.getNumPartitions() > 1
    rows = df.collect()
    assert all(r["v"] == str(r["src_ord"]) for r in rows) and len(rows) == 5000


def test_aliases_first_claimant_wins(spark):
    df = spark.createDataFrame([("1", "2", "3", "4")], "`Emp-ID` string, `Staff ID` string, salary string, `Base Salary` string")
    named = snapshots.resolve_aliases(df)
    assert named.columns == ["worker_id", "Staff ID", "salary", "Base Salary"]
    assert snapshots.resolve_aliases(df, {"Staff ID": "recon_id"}).columns[1] == "recon_id"


def test_audit_aliases_collapse_to_the_first_value(spark):
    df = spark.createDataFrame([(0, None, "b"), (1, "a", "c")], "src_ord bigint, emp_id string, `Employee ID` string")
    assert [r["worker_id"] for r in snapshots.audit_aliases(df).orderBy("src_ord").collect()] == ["b", "a"]


def test_mapping(spark):
    df = spark.createDataFrame(
        [(0, " E1 ", "María José", "O'Brien Jr.", "1/2/1980", "$50,000", "Austin, TX", "Active", "123-45-6789")],
        "src_ord bigint, `Employee ID` string, fname string, Surname string, DOB string, `Annual Salary` string, site string, "
        "`Emp Status` string, SSN string")
    row = snapshots.map_columns(df.withColumnRenamed("DOB", "birth date")).first()
    assert row["worker_id"] == " E1 " and row["full_name_norm"] == "mara jos o'brien jr"
    assert (row["first_name_norm"], row["middle_name"], row["last_name_norm"], row["suffix"]) == ("maria", "jose", "o'brien", "Jr.")
    assert (row["dob"], row["salary"], row["location_state"], row["worker_status"], row["last4_ssn"]) == (
        "1980-01-02", 50000.0, "TX", "active", "6789")


def test_policy_merges_deeply(tmp_path):
    policy = load_policy({"sanity_gate": {"health_thresholds": {"min_det_rate": 0.5}}})
    assert policy["sanity_gate"]["health_thresholds"]["min_det_rate"] == 0.5
    assert policy["sanity_gate"]["health_thresholds"]["min_approve_rate"] == 0.75
    path = write(tmp_path / "p.json", '{"extra_fields": {"enabled": false}}')
    assert load_policy(path)["extra_fields"]["enabled"] is False


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("=x", "A & B"), ("y", "a-b"), ("z", "")], "pair_id string, old_district string")
    sinks.write_table(df, str(tmp_path / "csv"), "csv")
    assert {r["pair_id"] for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()} == {"'=x", "y", "z"}
    sinks.write_table(df.limit(0), str(tmp_path / "none"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "none")).columns == ["pair_id", "old_district"]
    sinks.write_partitioned_queue(df, str(tmp_path / "q"))
    assert {r["dept_slug"] for r in spark.read.parquet(str(tmp_path / "q")).collect()} == {"a_b", "a_b_2", "unknown"}
    for n in (1, 2):
        sinks.append_run_history(spark, {"run": n, "pairs": 5}, str(tmp_path / "h"))
    assert spark.read.parquet(str(tmp_path / "h")).count() == 2


def test_a_repeated_run_leaves_one_copy(spark, tmp_path):
    trail = spark.createDataFrame([("a",), ("b",)], "pair_id string")
    for run in ("r1", "r2", "r1"):
        sinks.append_audit_trail(trail if run == "r1" else trail.limit(1), str(tmp_path / "trail"), run)
        sinks.append_run_history(spark, {"run_id": run, "pairs": 5}, str(tmp_path / "runs"))
    assert sorted((r["run_id"], r["pair_id"]) for r in spark.read.parquet(str(tmp_path / "trail")).collect()) == [("r1", "a"), ("r1", "b"), ("r2", "a")]
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "runs")).select("run_id", "pairs").collect())) == [("r1", 5), ("r2", 5)]


def test_manifest(spark, tmp_path):
    path = write(tmp_path / "a.csv", "abc")
    row = snapshots.input_manifest(spark, [path]).first()
    assert (row["filename"], row["size_bytes"]) == ("a.csv", 3)
    assert row["sha256"] == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"


def test_required_columns_fail_fast(spark):
    with pytest.raises(ValueError, match="pair_id"):
        snapshots.require_columns(spark.range(1), ["pair_id"])


def test_stage_folder_follows_the_session(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    stored = materialize(spark.range(3), "t")
    assert stored.count() == 3 and "range" not in stored._jdf.queryExecution().optimizedPlan().toString().lower()
