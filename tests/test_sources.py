import pytest
from conftest import rows

from litevidence import schemas
from litevidence.sources import readers, writers


def test_text_round_trip_keeps_awkward_text(spark, tmp_path):
    data = [('say "x"', "tab\there", ["a", "b"]), ("NA", "two\nlines", []), ("None", None, None)]
    df = spark.createDataFrame(data, "x string, y string, z array<string>")
    for write in (writers.write_text, writers.write_single_text):
        path = str(tmp_path / write.__name__)
        write(df, path)
        back = readers.read_text(spark, path)
        assert back.columns == ["x", "y", "z"]
        assert [r[:2] for r in rows(back)] == sorted([d[:2] for d in data], key=repr)
        assert "a, b" in [r[2] for r in rows(back)]
    assert len(list((tmp_path / "write_single_text").glob("part-*"))) == 1


def test_text_columns_are_found_by_name(spark, tmp_path):
    (tmp_path / "p.tsv").write_text("SYNOMS\tCOMPOUND_KEY\nA, B\tC1\n")
    got = readers.read_text(spark, str(tmp_path / "p.tsv"), schemas.PROBES_TEXT)
    row = got.first()
    assert got.columns == schemas.PROBES_TEXT.fieldNames()
    assert (row.SYNOMS, row.COMPOUND_KEY, row.GENE) == ("A, B", "C1", None)


def test_comma_text(spark, tmp_path):
    (tmp_path / "good.csv").write_text("Name,InChI key\n\"x, y\",K1\n")
    assert rows(readers.read_text(spark, str(tmp_path / "good.csv"), sep=",")) == [("x, y", "K1")]


def test_lines(spark, tmp_path):
    (tmp_path / "b.tsv").write_text("diseaseId\nEFO_1 \nMONDO_2\n")
    got = readers.read_lines(spark, str(tmp_path / "b.tsv"), schemas.DISEASE_BLACKLIST)
    assert sorted(r[0].strip() for r in got.collect()) == ["EFO_1", "MONDO_2"]


def test_source_folders_are_one_scan_with_pruning(spark, tmp_path, capsys):
    df = spark.createDataFrame([("d", "g", "s", 2001, None, None, "a"), ("d", "g", "s", 2002, 2000, None, "b")], schemas.DATED_EVIDENCE)
    writers.write_parquet(df, str(tmp_path / "dated"), ["sourceId"])
    back = readers.read_dated_evidence(spark, str(tmp_path / "dated"))
    assert rows(back.select(df.columns)) == rows(df)
    back.where("sourceId = 'a'").select("curationYear").explain()
    plan = capsys.readouterr().out
    assert "PartitionFilters: [isnotnull(sourceId" in plan and "ReadSchema: struct<curationYear:int>" in plan


def test_matches_are_renamed_and_pruned(spark, tmp_path, capsys):
    df = spark.createDataFrame([("1", "l", "i", "CD", None, "s", "t")], schemas.RAW_MATCHES)
    writers.write_parquet(df, str(tmp_path / "m"))
    back = readers.read_matches(spark, str(tmp_path / "m"))
    assert rows(back) == [("1", "l", "i", "CD", None, "s", "t")]
    back.select("pmid").distinct().explain()
    assert "ReadSchema: struct<pmid:string>" in capsys.readouterr().out


def test_tables_by_name(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "probe.parquet"))
    assert readers.read_tables(spark, str(tmp_path), ["probe"])["probe"].count() == 3


def test_staged_tables_go_to_the_checkpoint_folder(spark):
    staged = writers.staged(spark.range(5), "x")
    folder = writers.stage_folder(spark)
    assert staged.count() == 5
    assert all(folder.removeprefix("file:") in f for f in staged.inputFiles())


@pytest.mark.parametrize("n", [1, 3])
def test_preview_and_report(spark, n):
    assert writers.preview(spark.range(5), n).count() == n
    assert rows(writers.column_report(spark.createDataFrame([(1, None), (2, "x")], "a int, b string"))) == [(2, 1)]
