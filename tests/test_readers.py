"""Text files read by their header."""

import pytest

from spendlens.sources import read_cycles


def write(folder, name, text):
    (folder / name).write_text(text)
    return str(folder)


def test_columns_are_found_by_name(spark, tmp_path):
    path = write(tmp_path, "a.csv", ",clicks,idadvertiser,idadvertiser_master,Region\n0,5,11,7,north\n1,,12,8,\n")
    df = read_cycles(spark, path)
    assert df.columns[0] == "idadvertiser_master" and df.columns[-2:] == ["clicks", "Region"]
    rows = df.orderBy("idadvertiser").collect()
    assert [(r["idadvertiser_master"], r["idadvertiser"], r["clicks"], r["Region"]) for r in rows] == [
        (7, 11, 5, "north"), (8, 12, None, None)]
    assert dict(df.dtypes)["campaign_budget"] == "double" and rows[0]["campaign_budget"] is None
    assert df.count() == 2


def test_files_of_another_layout_raise(spark, tmp_path):
    write(tmp_path, "a.csv", "idadvertiser,clicks\n1,2\n")
    path = write(tmp_path, "b.csv", "clicks,idadvertiser\n3,4\n")
    with pytest.raises(Exception, match="header|Header"):
        read_cycles(spark, path).select("idadvertiser", "clicks").collect()
