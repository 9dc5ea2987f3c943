import json

import pytest
from pyspark.sql import functions as F

from reviewloom.operators import segments as S
from reviewloom.sources import reviews as IO
from reviewloom.sources import seeds as J


@pytest.fixture
def raw_csv(tmp_path):
    path = tmp_path / "a.csv"
    path.write_text(
        "Company,Rating,Date,Job,Title,Status,Location,Work_Policy,Pros,Cons\n"
        'Microsoft,4.0,2024,Dev,T,Full,X,Remote,Good work culture,Slow promotion\n'
        'Acme,NA,,,,,,,"Says ""hi"", twice\nand more",none\n'
        "Beta,3,,,,,,,N/A,nil\n"
        "Gamma,3,,,,,,,NULL,\n", encoding="utf-8")
    return str(path)


def test_read_and_split(spark, raw_csv):
    raw = IO.read_reviews(spark, raw_csv, "glassdoor")
    rows = {r["review_id"]: r for r in S.split_sides(S.standardize_columns(raw, "glassdoor")).collect()}
    assert sorted(rows) == ["gd_0_cons", "gd_0_pros", "gd_1_pros", "gd_2_cons"]
    assert rows["gd_0_pros"]["review_text"] == "Good work culture"
    assert rows["gd_0_cons"]["review_text"] == "Slow promotion"
    assert rows["gd_0_cons"]["side"] == "cons_gd" and rows["gd_0_cons"]["company"] == "Microsoft"
    assert rows["gd_1_pros"]["review_text"] == 'Says "hi", twice and more'
    assert rows["gd_1_pros"]["rating"] is None and rows["gd_2_cons"]["review_text"] == "nil"


def test_max_rows_and_missing_file(spark, raw_csv):
    assert IO.read_reviews(spark, raw_csv, "glassdoor", 2).count() == 2
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        IO.read_reviews(spark, raw_csv + ".none", "glassdoor").count()


def test_lines_know_whether_a_cell_is_open():
    from reviewloom.sources.csv_lines import ends_inside
    for line, inside, want in [("a,b", False, False), ('a,"b', False, True), ('b",c', True, False), ("b,c", True, True), ('a,""', False, False),
                               ('a,"""', False, True), ('say ""', True, True), ('5" disk,x', False, False), ('"a"b"c,"d', False, True),
                               ('x","y', True, True), ("", True, True), ('"', False, True), ('",', True, False)]:
        assert ends_inside(line, inside) == want, line


@pytest.mark.parametrize("split", ["1000000", "700"])
def test_quoted_line_breaks_read_alike_in_any_split(spark, tmp_path, split):
    import csv
    import random

    rng = random.Random(1)
    cells = ["plain", "two\nlines", 'a "quoted" word', "comma, here", "", "\n\nfar\n" * 9, "é😀\r\nx", '"', 'end"', ",", "x" * 300]
    folder = tmp_path / "many"
    folder.mkdir()
    want = []
    for name in ("a.csv", "b.csv"):
        rows = [[str(len(want) + k), rng.choice(cells), rng.choice(cells)] for k in range(120)]
        with open(folder / name, "w", newline="", encoding="utf-8") as out:
            csv.writer(out, lineterminator="\r\n" if name == "b.csv" else "\n").writerows([["key", "Pros", "a\nb"], *rows])
            out.write("\n\n")
        want += rows
    (folder / "c.csv").write_text('key,Pros,"a\nb"')
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = IO.read_reviews(spark, str(folder), "glassdoor")
        assert got.columns == ["key", "Pros", "a\nb", "source_row_id"]
        rows = sorted(got.collect(), key=lambda r: r["source_row_id"])
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [r["source_row_id"] for r in rows] == list(range(240))
    assert [[r[0], r[1] or "", r[2] or ""] for r in rows] == want


def test_an_open_cell_at_the_end_is_an_error(spark, tmp_path):
    (tmp_path / "bad.csv").write_text('a,b\n1,"open\n2,x\n')
    with pytest.raises(ValueError, match="inside a quoted cell"):
        IO.read_reviews(spark, str(tmp_path / "bad.csv"), "glassdoor")
    (tmp_path / "none.csv").write_text("")
    with pytest.raises(ValueError, match="no header"):
        IO.read_reviews(spark, str(tmp_path / "none.csv"), "glassdoor")


def test_ordinals_follow_file_order(spark, tmp_path):
    path = tmp_path / "n.csv"
    path.write_text("v\n" + "\n".join(f"row{i:06d}" for i in range(30000)) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        scan = spark.read.option("header", True).csv(str(path))
        assert scan.rdd.getNumPartitions() > 3
        numbered = IO.with_row_ordinal(scan)
        wrong = numbered.where(F.format_string("row%06d", "row_ordinal") != F.col("v")).count()
        assert numbered.count() == 30000 and wrong == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_missing_text_column_gives_no_rows(spark):
    raw = spark.createDataFrame([(1, "x")], "source_row_id long, Company string")
    assert S.split_sides(S.standardize_columns(raw, "ambitionbox")).count() == 0


def test_seed_layouts(spark, tmp_path):
    new = tmp_path / "new.json"
    new.write_text(json.dumps({"_meta": {"backend": "x"}, "categories": {
        "b": [{"term": " Fair  Play ", "score": 0.9, "source": "s"}, "Plain", {"word": "w"}, {"term": ""}],
        "empty": [], "a": [{"word": "z", "score": 0.5}]}}))
    rows = J.read_seed(spark, str(new)).orderBy("category_ord", "term_ord").collect()
    assert [(r["category"], r["category_ord"], r["term"], r["score"]) for r in rows] == [
        ("b", 0, "fair play", 0.9), ("b", 0, "plain", 1.0), ("b", 0, "w", 1.0), ("a", 1, "z", 0.5)]
    old = tmp_path / "old.json"
    old.write_text(json.dumps({"c": [{"word": "Love", "score": 1.0}]}))
    assert J.read_seed(spark, str(old)).first()["term"] == "love"
    none = tmp_path / "none.json"
    none.write_text(json.dumps({"categories": {"c": []}}))
    with pytest.raises(ValueError):
        J.read_seed(spark, str(none))


def test_seed_exact_round_trip(spark, tmp_path):
    path = str(tmp_path / "seed")
    J.write_seed(J.seed_exact(spark), path, {"backend": "paper_exact"})
    assert (J.read_seed(spark, path).select(*J.SEED_COLUMNS).orderBy("category_ord", "term_ord").collect()
            == J.seed_exact(spark).orderBy("category_ord", "term_ord").collect())
    assert J.seed_exact(spark).count() == 42


def test_keywords(spark, tmp_path):
    path = tmp_path / "k.csv"
    path.write_text("id,term\n1,Beta\n2,NA\n3,alpha\n4, beta \n")
    rows = J.read_keywords(spark, str(path)).orderBy("first_at").collect()
    assert [r["keyword"] for r in rows] == ["beta", "alpha"]
    bad = tmp_path / "bad.csv"
    bad.write_text("id\n1\n")
    with pytest.raises(ValueError):
        J.read_keywords(spark, str(bad))


def test_sinks(spark, tmp_path, raw_csv):
    sides = S.split_sides(S.standardize_columns(IO.read_reviews(spark, raw_csv, "glassdoor"), "glassdoor"))
    IO.write_sides(sides, str(tmp_path / "sides"))
    assert IO.read_sides(spark, str(tmp_path / "sides")).where("side = 'pros_gd'").count() == 2
    one = IO.side_file(sides, "cons_gd")
    assert one.columns[-2:] == ["Cons", "review_text"] and one.count() == 2
    labelled = sides.withColumn("classification", F.when(F.col("side") == "pros_gd", "HR").otherwise("Non HR"))
    IO.write_excluded_hr(labelled, str(tmp_path / "hr"), "r1")
    assert spark.read.parquet(str(tmp_path / "hr")).where("run_id = 'r1'").count() == 2
    manifest = IO.run_manifest(spark, {"segments": 4}, {"k": 1}, {"segments": "p"}).first()
    assert manifest["row_counts"] == {"segments": 4} and manifest["config"] == {"k": "1"}
