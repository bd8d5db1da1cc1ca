"""Scalar helpers: media, JSON, search rows, paths, labels, judges."""

import base64

import duckdb
import pytest
from pyspark.sql import functions as F

from quillon.functions import jsonx, labels, text
from quillon.operators import calibration, metrics
from quillon.plans import catalogue, claims


def one(spark, *columns):
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return row[0] if len(columns) == 1 else tuple(row)


def over(spark, values, column, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}").select("i", column(F.col("x")).alias("y")).collect()
    return [r.y for r in sorted(rows)]


class TestMedia:
    def test_mime_by_suffix(self, spark):
        assert over(spark, ["sample.JPG", "a/b.webp", "x.unknown", "none", ".png"], text.mime_type) == ["image/jpeg", "image/webp", "image/png", "image/png", "image/png"]

    def test_data_url_round_trip(self, spark):
        url = one(spark, text.data_url(F.lit(b"\x00\xffabc"), F.lit("image/gif")))
        assert url == "data:image/gif;base64," + base64.b64encode(b"\x00\xffabc").decode()
        back = one(spark, text.parse_data_url(F.lit(url)))
        assert (back.mime, bytes(back.content)) == ("image/gif", b"\x00\xffabc")
        assert one(spark, text.parse_data_url(F.lit("http://x"))) is None

    @pytest.mark.parametrize("n", [56, 57, 58, 115, 1000])
    def test_data_url_has_no_line_breaks(self, spark, n):
        content = bytes(i % 256 for i in range(n))
        url = one(spark, text.data_url(F.lit(content), F.lit("image/png")))
        assert url == "data:image/png;base64," + base64.b64encode(content).decode()
        broken = "data:image/png;base64," + base64.encodebytes(content).decode().replace("\n", "\r\n")
        assert [bytes(one(spark, text.parse_data_url(F.lit(u))).content) for u in (url, broken)] == [content] * 2

    def test_data_url_of_long_and_missing_urls(self, spark, tmp_path):
        urls = ["http://x/" + "a" * 60, "", None, "http://ä/" + "漢" * 40]
        spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
        with duckdb.connect() as con:
            con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
            expected = con.execute(catalogue.oracle_sql()["data_url"]).fetchall()
        assert sorted(map(tuple, catalogue.queries()["data_url"](spark, str(tmp_path)).collect())) == sorted(expected)


class TestJson:
    def test_object(self, spark):
        values = ['Result: {"value": 7} -- end', '{"value": 8}', "not json", "[1]", "a } b {", None, '{"value": 1} and {"value": 2}']
        assert over(spark, values, lambda x: jsonx.get(jsonx.extract_object(x), "$.value", "int")) == [7, 8, None, None, None, None, None]

    def test_array_and_fallback(self, spark):
        values = ['prefix ["a", "b"] suffix', "- one\n\n • two\nab", '{"a": [1]}']
        found = lambda x: jsonx.with_fallback(jsonx.strings(jsonx.extract_array(x)), text.bullet_lines(x))
        assert over(spark, values, found) == [["a", "b"], ["one", "two"], ["1"]]

    def test_selection(self, spark):
        assert over(spark, ['{"index": 2}', '{"index": 9}', "?", '{"index": -1}', '{"index": "3"}'], lambda x: jsonx.selection_index(x, F.lit(3))) == [2, 3, 1, 1, 3]

    def test_strict_number(self, spark):
        values = ['{"c": 0.5}', '{"c": true}', '{"c": "0.5"}', '{"c": null}', "{}"]
        assert over(spark, values, lambda x: jsonx.strict_number(F.parse_json(x), "$.c")) == [0.5, 1.0, None, None, None]


class TestSearch:
    def test_alias_keys_and_missing_url(self, spark):
        item = lambda **k: F.struct(*[F.lit(k.get(n)).cast("string").alias(n) for n in ("title", "href", "url", "snippet", "body", "source")])
        rows = one(spark, text.search_rows(F.array(item(href=" u ", title="T", body="b", source="s"), item(title="no url")), {"title", "href", "url", "snippet", "body", "source"}))
        assert [tuple(r) for r in rows] == [("T", "u", "b", "s")]

    def test_legacy_payload(self, spark):
        empty, old = F.array(F.struct(F.lit("").alias("url"))), F.array(F.struct(F.lit("x").alias("href")))
        assert one(spark, text.payload_rows(empty, {"url"}, old, {"href"}))[0].url == "x"

    def test_key_ignores_case_and_spaces(self, spark):
        a, b, c = one(spark, text.search_key(F.lit("A  b\n C")), text.search_key(F.lit(" a b c ")), text.search_key(F.lit("a b c"), F.create_map(F.lit("page"), F.lit("2"))))
        assert a == b != c


class TestPaths:
    def test_normal_form(self, spark):
        assert over(spark, ["/a/./b/../c", "/../x", "//a//b/", "/"], text.normal_path) == ["/a/c", "/x", "/a/b", "/"]

    def test_record_path(self, spark):
        assert over(spark, ["images/item.jpg", "/abs/x", "", None, "\\win"], lambda x: text.record_path(x, "/root")) == ["/root/images/item.jpg", "/abs/x", None, None, "/root/win"]

    def test_candidates(self, spark):
        got = over(spark, ["images/item.jpg", "/images/item.jpg", "/root/images/item.jpg"], lambda x: text.path_candidates(x, "/root"))
        assert all("images/item.jpg" in g or "/root/images/item.jpg" in g for g in got)
        assert got[0] == ["/root/images/item.jpg", "images/item.jpg"] and got[1][:2] == ["/images/item.jpg", "/root/images/item.jpg"]


class TestLabels:
    def test_index_coercion(self, spark):
        assert over(spark, ["5", "10", "true", "", "3.0", " -4 ", None, "99999999999999999999"], labels.index) == [5, 10, None, None, None, -4, None, None]

    def test_branch_order(self, spark):
        values = ["Misinformation? not", "Not Misinformation", "misleading", "Uncertain", None]
        assert over(spark, values, labels.metric_prediction) == [1, 0, 1, None, None]
        assert over(spark, values, labels.report_prediction) == [0, 0, 1, None, None]

    def test_clamp_and_score(self, spark):
        assert over(spark, [-1.0, 0.4, 7.0, float("nan")], labels.clamp, "double") == [0.0, 0.4, 1.0, 1.0]
        assert one(spark, labels.misinformation_score(F.lit("Not Misinformation"), F.lit(0.75)), labels.misinformation_score(F.lit("?"), F.lit(0.9)), labels.misinformation_score(F.lit("Misinformation"), F.lit(None))) == (0.25, 0.5, 0.5)

    def test_heuristic(self, spark):
        judge = lambda *a: one(spark, labels.heuristic_judgement(*[F.lit(x).cast(t) for x, t in zip(a, ("string", "double", "boolean", "double"), strict=True)]))
        assert tuple(judge(None, None, None, None)) == ("Uncertain", 0.3, [])
        sure = judge("false", 0.9, True, 0.8)
        assert (sure.label, sure.confidence) == ("Misinformation", 0.9) and sure.key_factors[0] == "Relevancy misaligned (conf ~0.90)"
        assert judge("true", 1.0, False, 0.5).label == "Not Misinformation"

    def test_cascade(self, spark):
        stage = lambda raw, kind: labels.stage_verdict(F.lit(raw), kind)
        got = one(spark, labels.cascade(stage("Finish[TEXT SUPPORTS]", "text"), stage("", "image"), stage("Finish[MATCH]", "cross")))
        assert (got.label, got.fake_cls) == ("Not Misinformation", "original") and got.confidence == pytest.approx((0.8 + 0.7 + 0.8) / 3)
        with pytest.raises(ValueError):
            stage("", "smell")

    def test_answers(self, spark):
        got = one(spark, claims.answer(F.lit('x {"answer": "yes", "citations": ["u", {"url": "v", "title": "t"}], "confidence": "0.5"}')))
        assert got.answer == "yes" and [tuple(c) for c in got.citations] == [("u", ""), ("v", "t")] and got.confidence == 0.5
        assert one(spark, claims.answer(F.lit(" plain "))).answer == "plain"


class TestGoldens:
    def test_confusion(self, spark):
        cells = [(1, 1)] * 511 + [(0, 1)] * 86 + [(1, 0)] * 189 + [(0, 0)] * 214
        row = metrics.confusion(spark.createDataFrame(cells, "truth int, pred int")).first()
        assert (row.tp, row.fp, row.fn, row.tn) == (511, 86, 189, 214)
        assert (row.accuracy, row.precision, row.recall, row.f1, row.recall_neg, row.support) == (0.725, 0.8559, 0.73, 0.788, 0.7133, 1000)

    def test_calibration(self, spark):
        rows = [(c, int(i < k)) for n, k, c in ((259, 136, 2 / 3), (144, 78, 2.3 / 3), (597, 511, 0.8)) for i in range(n)]
        recs = spark.createDataFrame(rows, "conf double, correct int")
        s = calibration.calibration_summary(recs).first()
        assert (s.total, s.brier_score, s.expected_calibration_error) == (1000, 0.188298, 0.102467)
        bins = calibration.calibration_bins(recs).collect()
        assert len(bins) == 10 and sum(b["count"] == 0 and b.accuracy is None for b in bins) == 7

    def test_no_records(self, spark):
        recs = spark.createDataFrame([], "conf double, correct int")
        assert calibration.calibration_bins(recs).count() == 0
        assert tuple(calibration.calibration_summary(recs).first()) == (0, None, None, 10)

    def test_empty_cells(self, spark):
        row = metrics.confusion(spark.createDataFrame([], "truth int, pred int")).first()
        assert (row.accuracy, row.f1, row.support) == (0.0, 0.0, 0)
