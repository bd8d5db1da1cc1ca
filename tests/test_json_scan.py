"""The scan of one JSON value by byte ranges, cut at every place."""

import json
import random

import pytest

from quillon.sources import records

RECORDS = [
    {"text": 'quote " and \\ and \\" end', "image_path": "a}b{c"},
    {"text": "brackets ]}[{ in a string", "image_path": "x", "more": {"deep": [{"er": "}"}], "s": "\\\\"}},
    {"text": "ünï 漢字 \n line", "image_path": "y", "list": [[], [1, [2]], {}]},
    {},
    {"text": "}", "image_path": "]", "a": {"b": {"c": {"d": "}}}}"}}}},
]
STRAY = [7, "stray }] \\\" {", None, [{"inner": 1}, [{"x": 2}]], 1.5, True, []]


def mixed(rng):
    rows = [*RECORDS, *STRAY]
    rng.shuffle(rows)
    return rows


SHAPES = {
    "list": lambda rows: rows,
    "items": lambda rows: {"name": "d", "tags": ["a", "b"], "meta": {"x": {"y": 1}, "data": [1]}, "items": rows, "after": [{"no": 1}], "end": {}},
    "priority": lambda rows: {"samples": [{"no": 1}], "records": rows, "other": [{"no": 2}]},
    "any": lambda rows: {"meta": {"x": [1]}, "n}me": 3, "stuff": rows, "later": [{"no": 1}]},
    "odd key": lambda rows: {'we}ird " key': rows, "z": 1},
}


def expected(rows):
    return [json.dumps(r, sort_keys=True, ensure_ascii=False) for r in rows if isinstance(r, dict)]


def scanned(spark, path):
    rows = records.scan_dataset(spark, str(path)).selectExpr("dataset_index", "to_json(record) AS r").collect()
    assert sorted(r.dataset_index for r in rows) == list(range(len(rows)))
    return [json.dumps(json.loads(r.r), sort_keys=True, ensure_ascii=False) for r in sorted(rows, key=lambda r: r.dataset_index)]


@pytest.fixture
def split_bytes(spark):
    """Sets how many bytes of a file a task reads."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")

    def limit(n):
        for name in names:
            spark.conf.set(name, str(n))

    yield limit
    for name in names:
        spark.conf.unset(name)


class TestScanDataset:
    @pytest.mark.parametrize("size", [1 << 20, 64])
    def test_shapes_and_split_points(self, spark, tmp_path, split_bytes, size):
        """All shapes, and the same text moved byte by byte against the ranges; each record says what file it is of."""
        rng, files = random.Random(1), {}
        for shape, wrap in SHAPES.items():
            rows = [{**r, "f": shape} if isinstance(r, dict) else r for r in mixed(rng)]
            files[shape] = rows, json.dumps(wrap(rows), ensure_ascii=False, indent=rng.choice([None, 1])) + "\n"
        for shift in range(0, 64, 7):
            rows = [{**RECORDS[0], "f": f"at{shift}"}, 'a "}" {', {**RECORDS[1], "f": f"at{shift}"}]
            files[f"at{shift}"] = rows, " " * shift + json.dumps({"data": rows})
        for name, (_, text) in files.items():
            (tmp_path / f"{name.replace(' ', '')}.json").write_text(text, encoding="utf-8")
        split_bytes(size)
        found = records.scan_dataset(spark, str(tmp_path)).selectExpr("dataset_index", "variant_get(record, '$.f', 'string') AS f", "to_json(record) AS r").collect()
        for name, (rows, _) in files.items():
            mine = sorted((r.dataset_index, json.dumps(json.loads(r.r), sort_keys=True, ensure_ascii=False)) for r in found if r.f == name)
            assert mine == list(enumerate(expected(rows))), name
        assert len(found) == sum(len(expected(rows)) for rows, _ in files.values())

    def test_many_tasks(self, spark, tmp_path, split_bytes):
        rows = [{"text": f"t{i} }}", "image_path": f"p{i}"} for i in range(2000)]
        (tmp_path / "d.json").write_text(json.dumps(rows))
        split_bytes(8192)
        assert spark.read.option("lineSep", "}").text(str(tmp_path / "d.json")).rdd.getNumPartitions() > 10
        assert scanned(spark, tmp_path / "d.json") == expected(rows)

    def test_several_files(self, spark, tmp_path):
        for i in range(3):
            (tmp_path / f"{i}.json").write_text(json.dumps([{"i": i}, {"i": i + 10}]))
        assert sorted((r.dataset_index, r.i) for r in records.scan_dataset(spark, str(tmp_path)).selectExpr("dataset_index", "variant_get(record, '$.i', 'int') AS i").collect()) == [(0, 0), (0, 1), (0, 2), (1, 10), (1, 11), (1, 12)]

    def test_no_records(self, spark, tmp_path):
        for i, text in enumerate(["[]", '{"data": []}', '[1, "x", [{"a": 1}]]']):
            (tmp_path / f"{i}.json").write_text(text)
        assert scanned(spark, tmp_path) == []

    @pytest.mark.parametrize("text", ['{"a": 1}', "3", '[{"a": 1}, {"b": 2', '[{"a": "x]}', '{"data": [{"a": 1}]', '[{"a": 1}, {"b" 2}]'])
    def test_other_shapes_and_broken_json_raise(self, spark, tmp_path, text):
        (tmp_path / "d.json").write_text(text)
        with pytest.raises(Exception, match="unsupported JSON structure"):
            scanned(spark, tmp_path / "d.json")
