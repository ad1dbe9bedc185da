import datetime

from pyspark.sql import functions as F

from litevidence.functions import areas, articles, dates, text


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(make("v")).first()[0]


def test_split_list_trims_and_keeps_bare_commas(spark):
    assert one(spark, " A0,  B,C, 1,2-x, ", text.split_list) == ["A0", "B,C", "1,2-x"]
    assert one(spark, "", text.split_list) == []
    assert one(spark, None, text.split_list) is None


def test_printed_lists(spark):
    assert one(spark, "['X', 'Y']", text.literal_items) == ["X", "Y"]
    assert one(spark, "['X']", text.strip_literal) == "X"
    assert one(spark, "[\"a b\", 'c']", text.redelimit) == "a b|c"
    assert one(spark, None, text.redelimit) is None


def test_drop_vague_is_by_token(spark):
    def drop(c):
        return text.drop_vague(c, "defect")

    assert one(spark, "a|defects", drop) == "a|defects"
    assert one(spark, "defect|b", drop) == "b"
    assert one(spark, "a|defect", drop) == "a"
    assert one(spark, "defect", drop) == "defect"
    assert one(spark, "defect|defect", drop) == "defect"
    assert one(spark, None, drop) is None


def test_nulls_and_arrays(spark):
    assert one(spark, [], text.empty_to_null, "array<int>") is None
    assert one(spark, [1], text.empty_to_null, "array<int>") == [1]
    assert one(spark, None, text.empty_to_null, "array<int>") is None
    assert one(spark, None, lambda c: text.differs(c, "Other")) is True
    assert one(spark, "Other", lambda c: text.differs(c, "Other")) is False


def test_map_values_takes_whole_cells(spark):
    def named(c):
        return text.map_values(c, {"title": "TITLE"})

    assert one(spark, "title", named) == "TITLE"
    assert one(spark, "subtitle", named) == "subtitle"
    assert one(spark, None, named) is None


def test_control_class(spark):
    for value, want in (("CX", "name"), ("Keyword", "keyword"), (None, "none"), ("x", None)):
        assert one(spark, value, text.control_class) == want


def test_preferred_area(spark):
    for value, want in (
        ("EFO_1|MONDO_2", "EFO_1"), ("MONDO_2|EFO_1", "MONDO_2"), ("GO_1|OTAR_3", "OTAR_3"),
        ("GO_1||HP_2", "GO_1"), ("OTARX|EFO_9", "EFO_9"), ("", None), (None, None),
    ):
        assert one(spark, value, areas.preferred_area_of_text) == want
    assert one(spark, ["GO_1", "OTAR_3"], areas.preferred_area, "array<string>") == "OTAR_3"
    assert one(spark, None, areas.flat_areas, "array<string>") == ""


def test_article_labels(spark):
    cases = [
        (["Review"], True, "review", "Review Article"),
        (["Systematic Review"], True, "primary", "Review Article"),
        ([], True, "primary", "Primary Research / Other"),
        (None, True, None, "Primary Research / Other"),
        (None, False, "primary", "ID Not Found"),
    ]
    df = spark.createDataFrame([c[:2] for c in cases], "types array<string>, listed boolean")
    out = df.select(
        articles.article_label(articles.is_review("types", F.col("listed"))),
        articles.detailed_label("types", F.col("listed")),
    ).collect()
    assert [tuple(r) for r in out] == [c[2:] for c in cases]


def test_month_year(spark):
    for value, want in (("Mar-15", datetime.date(2015, 3, 1)), ("Dec-69", datetime.date(1969, 12, 1)),
                        ("Jan-68", datetime.date(2068, 1, 1)), ("None", None), (None, None), ("x-y", None)):
        assert one(spark, value, dates.month_year) == want
    assert one(spark, "Mar-15", dates.month_part) == "Mar"
    assert one(spark, "None", dates.year_part) is None
