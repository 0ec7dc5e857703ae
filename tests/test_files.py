import json

import pytest

from wearline.sources import files

HEADER = ",".join(files.CHANNELS)


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("raw")
    unit = root / "35Hz12kN" / "Unit1_1"
    unit.mkdir(parents=True)
    bodies = {
        "1": "\n6.75,0.125\n-3.5,9.0", "2": "\r\n6.75,0.125\r\n-3.5,9.0\r\n", "3": "\n-0.0,7e-2\n0,-7\n", "4": "\n8,-8\n21\n", "5": "\n5,6\n\n7,8\n",
        "6": "\n4,four\n", "7": "\ninf,17\nnan,-inf\n", "8": "\n", "010": "\n11,12\n", "9": "\n13,14\n" * 3,
    }
    for name, body in bodies.items():
        (unit / f"{name}.csv").write_bytes((HEADER + body).encode())
    (unit / "11.csv").write_bytes(b"")
    (unit / "12.csv").write_bytes((HEADER + "\n" + "1,2\n" * (5 * 1024 * 1024)).encode())
    return str(root)


def test_inspection_isolates_bad_files(spark, tree):
    got = {r["path"].rsplit("/", 1)[1][:-4]: r for r in files.inspect_files(spark, tree).collect()}
    for name in ("1", "2", "3"):
        assert got[name]["parse_error"] is None and got[name]["sample_count"] == 2 and got[name]["channel_count"] == 2
    assert list(got["1"]["header"]) == list(files.CHANNELS)
    assert (got["4"]["parse_error"], got["5"]["parse_error"], got["6"]["parse_error"]) == ("ragged_row", "blank_line", "non_numeric_value")
    assert (got["7"]["nan_count"], got["7"]["infinite_count"]) == (1, 2)
    assert (got["8"]["parse_error"], got["12"]["parse_error"]) == ("no_samples", "file_too_large")
    assert (got["11"]["parse_error"], got["11"]["file_size_bytes"], got["11"]["sample_count"]) == ("empty_file", 0, 0)
    assert len(got) == 12


def test_listing_walks_all_levels(spark, tmp_path):
    for name in ("top.csv", "a/one.csv", "a/b/two.csv", "a/b/c/three.csv", "a/b/c/d/four.csv", "a/b/c/note.txt", "_hidden.csv"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x" * len(path.stem))
    got = {r["path"].rsplit("/", 1)[1]: r["length"] for r in files.inventory(spark, str(tmp_path)).collect()}
    assert got == {"top.csv": 3, "one.csv": 3, "two.csv": 3, "three.csv": 5, "four.csv": 4}
    same = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(str(tmp_path)).select("path")
    assert {r["path"] for r in files.inventory(spark, f"file://{tmp_path}").collect()} == {r["path"] for r in same.collect()}


def test_keys_and_signals(spark, tree):
    keys = {r["path"].rsplit("/", 1)[1]: r for r in files.path_keys(files.inventory(spark, tree)).collect()}
    assert keys["2.csv"]["condition"] == "35Hz12kN" and keys["2.csv"]["unit"] == "Unit1_1"
    assert keys["2.csv"]["acquisition_number"] == 2 and keys["010.csv"]["acquisition_number"] is None
    rows = {r["acquisition_number"]: r for r in files.signals_from_files(spark, tree).where("acquisition_number IN (1, 2)").collect()}
    assert rows[1]["horizontal"] == [6.75, -3.5] == rows[2]["horizontal"] and rows[1]["vertical"] == [0.125, 9.0]


def test_nested_fold_plan(spark, tmp_path):
    path = tmp_path / "folds.json"
    path.write_text(json.dumps({"folds": [{"fold": 0, "train": ["a", "b"], "validation": ["c"], "test": ["d"]}]}, indent=1))
    assert files.folds_from_json(spark, str(path)).count() == 4
    assert files.json_manifest(spark, str(path), "folds").count() == 1
