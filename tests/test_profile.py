from pyspark.sql import functions as F

from corpusloom.operators import profile

EXPECT = "column_name string, allowed_values string, min_value long, max_value long"


def found(spark, rows, **kw):
    df = spark.createDataFrame(rows, "load_no int, fmt string, width string")
    e = spark.createDataFrame([("fmt", "PNG|JPEG", None, None), ("width", None, 16, 16384)], EXPECT)
    kinds = profile.classified(profile.masked(df, "load_no", ["fmt", "width"]), e)
    return {tuple(r) for r in profile.findings(kinds, **kw).collect()}


def test_masks(spark):
    df = spark.createDataFrame([("PNG",), ("image/jpeg",), ("0x200",), (" a b",), ("猫",), ("",), (None,)], "v string")
    assert [r[0] for r in df.select(profile.whole_mask(F.col("v"))).collect()] == ["A", "a/a", "9a9", "_a_a", "x", "", "(null)"]


def test_the_mask_decides_before_the_value(spark):
    # Under another mask the value isn't looked at, under one of the allowed values' masks it is.
    values = [(1, "fmt", v, 1, m) for v, m in (("PNG", "A"), ("PNG", "other"), ("GIF", "A"))]
    e = spark.createDataFrame([("fmt", "PNG|JPEG", None, None)], EXPECT)
    got = profile.classified(spark.createDataFrame(values, "load_no int, column_name string, value string, n long, mask string"), e).collect()
    assert [(r["value"], r["kind"]) for r in got] == [("PNG", "valid"), ("PNG", "invalid"), ("GIF", "invalid")]


def test_kinds(spark):
    values = [None, "", " n/a ", "-", "?", "PNG", "png", "PNG ", "512", "0512", "+5", "0", "15", "99999", "9" * 60, "٣"]
    df = spark.createDataFrame([(1, v, v) for v in values], "load_no int, fmt string, width string")
    e = spark.createDataFrame([("fmt", "PNG|JPEG", None, None), ("width", None, 16, 16384)], EXPECT)
    got = {(r["column_name"], r["value"]): r["kind"] for r in profile.classified(profile.masked(df, "load_no", ["fmt", "width"]), e).collect()}
    assert got["fmt", None] == got["width", None] == "missing"
    assert [got["fmt", v] for v in values[5:8]] == ["valid", "invalid", "invalid"]
    assert [got["width", v] for v in values[8:]] == ["valid", "invalid", "invalid", "outside", "outside", "outside", "outside", "invalid"]


def test_findings(spark):
    calm = [(1, "PNG", "512")] * 20
    assert found(spark, calm + [(2, "PNG", "512")] * 20) == set()
    assert found(spark, calm + [(2, None, "512")] * 3 + [(2, "PNG", "512")] * 17) == {(2, "fmt", "missing")}
    assert found(spark, calm + [(2, "JPEG", "512")] * 10 + [(2, "PNG", "99999")] * 1 + [(2, "PNG", "512")] * 9) == {(2, "fmt", "shift"), (2, "fmt", "new_value"), (2, "width", "range")}
    assert found(spark, calm + [(2, "png", "512")] * 2 + [(2, "PNG", "512")] * 18) == {(2, "fmt", "invalid")}
    # A share that equals a threshold is not above it.
    assert found(spark, calm + [(2, "png", "512")] * 1 + [(2, "PNG", "512")] * 19) == set()
    assert found(spark, []) == set()


def test_profile_of_odd_tables(spark, scratch):
    df = spark.createDataFrame([(1, None, "x"), (1, "a", "x"), (2, "b1", None), (None, "c", "y")], "load_no int, value string, mask string")
    out = {(r["load_no"], r["column_name"]): r for r in profile.column_profile(df, "load_no", df.columns, scratch).collect()}
    assert len(out) == 6 and out[1, "value"]["missing_share"] == 0.5 and out[2, "mask"]["distinct_values"] == 0
    assert out[2, "value"]["divergence"] == 1.0
    assert profile.column_profile(df.where("false"), "load_no", df.columns, scratch).count() == 0


SHA, SHA2 = "4be361506aaf43e9d4b2de57c0596358ff1fa9b8", "0f" * 20


def test_whole_masks(spark):
    place = "set@{}:data/p-0.parquet:{}"
    good, other = place.format(SHA, 7), place.format(SHA2, 81)
    bad = [good + "x", place.format(SHA[:-1], 7), place.format(SHA + "0", 7), place.format(SHA[:30] + "g" + SHA[31:], 7), place.format(SHA.upper(), 7), good.replace(":7", "")]
    df = spark.createDataFrame([(v,) for v in [good, other, *bad, "1" * 40, None, "", "a1" * 7, "A1b" * 20]], "v string")
    got = [r[0] for r in df.select(profile.whole_mask(F.col("v"))).collect()]
    assert got[0] == got[1] == "a@h{40}:a/a-9.a:9"
    assert len({got[0], *got[2:8]}) == 7
    assert got[8:] == ["9", "(null)", "", "a9" * 7, "A9a" * 20]


def test_profile_sees_the_end_of_long_values(spark, scratch):
    rows = [(1 + k // 150, f"set@{SHA}:data/p-0.parquet:{k}") for k in range(300)] + [(2, f"set@{SHA}:data/p-0.parquet:x")]
    df = spark.createDataFrame(rows, "load_no int, locator string")
    out = {r["load_no"]: r for r in profile.column_profile(df, "load_no", df.columns, scratch).collect()}
    assert [(out[k]["masks"], out[k]["rare_example"], out[k]["distinct_values"]) for k in (1, 2)] == [(1, None, 150), (2, "a@h{40}:a/a-9.a:a", 151)]
    assert out[2]["divergence"] == round(1 / 151, 6)


def test_findings_stand_in_the_profile(spark, scratch):
    df = spark.createDataFrame([(1, "PNG", "x")] * 20 + [(2, None, "x")] * 3 + [(2, "png", "y")] * 17, "load_no int, fmt string, findings string")
    e = spark.createDataFrame([("fmt", "PNG|JPEG", None, None)], EXPECT)
    out = {(r["load_no"], r["column_name"]): r["findings"] for r in profile.column_profile(df, "load_no", df.columns, scratch, e).collect()}
    assert out == {(1, "fmt"): "", (2, "fmt"): "invalid+missing", (1, "findings"): None, (2, "findings"): None}


def test_distinct_values_are_exact(spark, scratch):
    df = spark.range(20_011).select(F.lit(1).alias("load_no"), F.concat(F.lit("im"), "id").alias("name"))
    df = df.union(df)
    assert profile.column_profile(df, "load_no", df.columns, scratch).first()["distinct_values"] == 20_011


def test_rare_masks_of_all_columns(spark, tmp_path):
    from corpusloom.plans import profile_queries

    rows = [(1 + k % 2, f"set@{SHA}:{k}", SHA2, "ok") for k in range(300)] + [(2, "set@main:1", SHA2[1:], None), (2, "set@main:2", "", "ok")]
    spark.createDataFrame(rows, "load_no int, locator string, prompt_hash string, format string").write.parquet(f"{tmp_path}/source_catalog.parquet")
    got = {tuple(r) for r in profile_queries.p2_rare_masks(spark, str(tmp_path)).collect()}
    assert got == {(2, "locator", "a@a:9", 2, 2, "set@main:1"), (2, "prompt_hash", "h{39}", 1, 1, SHA2[1:])}
