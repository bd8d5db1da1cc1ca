"""Sources, sinks, configuration, resumption, the evaluation and the command line."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from quillon.plans import claims, cli
from quillon.plans.claims import investigate, run_baseline, run_offline
from quillon.plans.evaluation import evaluate
from quillon.sources import archive, clients, records, sinks
from quillon.sources.config import RunConfig, dataset_path
from quillon.sources.schemas import OUTPUT
from quillon.streaming import resume


@pytest.mark.parametrize("shape", [lambda r: r, lambda r: {"data": r}, lambda r: {"n": 1, "samples": r}, lambda r: {"n": "x", "other": r}])
def test_dataset_shapes(spark, tmp_path, shape):
    (tmp_path / "d.json").write_text(json.dumps(shape([{"text": "a", "image_path": "i"}, 7, {"text": None, "image_path": "j"}, {"text": "no image"}])))
    rows = records.project_records(records.scan_dataset(spark, str(tmp_path / "d.json"))).orderBy("dataset_index").collect()
    assert [(r.dataset_index, r.text, r.image_path) for r in rows] == [(0, "a", "i"), (1, None, "j")]


def test_other_shapes_raise(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"a": 1}')
    with pytest.raises(Exception, match="unsupported JSON structure"):
        records.scan_dataset(spark, str(tmp_path / "d.json")).collect()


def test_jsonl_modes(spark, tmp_path):
    path = str(tmp_path / "o.jsonl")
    (tmp_path / "o.jsonl").write_text('{"headline": "a", "sample_index": 1, "iteration_index": 0}\n\nbroken {\n[1]\n{"headline": "b", "sample_index": 3, "iteration_index": 1}\n')
    assert [r.headline for r in records.scan_jsonl(spark, path).filter("headline is not null").collect()] == ["a", "b"]
    with pytest.raises(Exception):
        records.scan_jsonl(spark, path, mode="strict").collect()
    assert [r._corrupt for r in records.scan_jsonl(spark, path, mode="ledger").collect() if r._corrupt] == ["broken {", "[1]"]
    assert [tuple(r) for r in records.corruption_ledger(spark, path).orderBy("line_no").collect()] == [(3, "json_decode_error"), (4, "json_decode_error")]
    good = records.scan_jsonl(spark, path).filter("headline is not null")
    assert records.check_sequence(good.filter("headline = 'a'")).count() == 1
    with pytest.raises(Exception, match="not sequential"):
        records.check_sequence(good).collect()


def test_images(spark, tmp_path):
    (tmp_path / "img").mkdir()
    (tmp_path / "img/a.png").write_bytes(b"abc")
    files = records.scan_images(spark, str(tmp_path / "img"))
    assert files.first().data_url == "data:image/png;base64,YWJj"
    recs = spark.createDataFrame([(0, "img/a.png"), (1, "/img/a.png"), (2, "img/gone.png")], "dataset_index long, image_path string")
    found, missing = records.existing(recs, files, str(tmp_path))
    assert sorted(r.dataset_index for r in found.collect()) == [0, 1] and missing.first().missing == 1


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "ä", None), (2, "b", 3)], "b long, a string, c long")
    path = str(tmp_path / "out")
    sinks.append_jsonl(df, path)
    sinks.append_jsonl(df, path)
    back = spark.read.schema("a string, b long, c long").json(path)
    assert back.count() == 4 and "ä" in {r.a for r in back.collect()}
    assert sinks.rewrite_jsonl(back.filter("b = 1"), path, dry_run=True) is None
    backup = sinks.rewrite_jsonl(back.filter("b = 1"), path)
    assert spark.read.json(path).count() == 2 and spark.read.json(backup).count() == 4
    sinks.write_csv(df, str(tmp_path / "csv"))
    assert next((tmp_path / "csv").glob("*.csv")).read_text().splitlines()[0] == "a,b,c"
    sinks.write_json_report({"t": df}, str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text())["t"][1] == {"b": 2, "a": "b", "c": 3}
    sinks.write_html_report({"t": spark.createDataFrame([("<x>",)], "a string")}, str(tmp_path / "r.html"), "T & T")
    assert "&lt;x&gt;" in (tmp_path / "r.html").read_text() and "T &amp; T" in (tmp_path / "r.html").read_text()
    sinks.write_metadata(str(tmp_path / "m.json"), "running", run_id="r")
    sinks.write_metadata(str(tmp_path / "m.json"), "completed", n=1)
    assert json.loads((tmp_path / "m.json").read_text()) == {"run_id": "r", "status": "completed", "n": 1}


def test_config(tmp_path):
    config = RunConfig.from_env({"QUILLON_SEED": "7", "QUILLON_DISABLE_QUESTIONS": "Yes", "QUILLON_STRATIFY_BY": "a, b", "OTHER": "1"})
    assert (config.seed, config.stratify_by) == (7, ("a", "b"))
    assert config.modules == {"relevancy": True, "visual_veracity": True, "questions": False, "question_answering": False, "judge": True}
    assert RunConfig(max_samples=5).fingerprint() == RunConfig().fingerprint() != RunConfig(seed=1).fingerprint()
    (tmp_path / "x.json").write_text("[]")
    assert dataset_path(str(tmp_path)).endswith("x.json") and dataset_path("/none", "o") == "o"


def test_unpack(tmp_path):
    for name, content in (("good.zip", "a/b.txt"), ("bad.zip", "../b.txt")):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            z.writestr(content, "x")
    assert archive.unpack(str(tmp_path / "good.zip"), str(tmp_path / "t")) == 1 and (tmp_path / "t/a/b.txt").read_text() == "x"
    with pytest.raises(ValueError):
        archive.unpack(str(tmp_path / "bad.zip"), str(tmp_path / "t"))


def test_retry():
    left = [2]

    def flaky():
        left[0] -= 1
        if left[0] >= 0:
            raise OSError
        return "ok"

    assert clients.with_retry(flaky, 3, 0.0) == ("ok", 3)
    with pytest.raises(OSError):
        clients.with_retry(lambda: (_ for _ in ()).throw(OSError()), 2, 0.0)


def test_model_errors_do_not_fail_the_task(spark):
    class Broken:
        def ask(self, system, user, image_url=None):
            raise RuntimeError("down")

    samples = spark.createDataFrame([(1, "i.png", "h")], "sample_index long, image_path string, headline string")
    row = run_offline(samples, RunConfig(), Broken).first()
    assert (row.judgement.label, row.judgement.confidence) == ("Uncertain", 0.3)
    fields = [f.split()[0] for f in "image_path headline provider model settings run_params relevancy visual_veracity best_qa_per_chain token_usage modules sample_index dataset_order_index iteration_index sample_details".split()]
    assert run_offline(samples, RunConfig(disable_judge=True)).columns == fields
    whole = spark.createDataFrame([], OUTPUT)
    kinds = lambda df: {f.name: f.dataType.simpleString() for f in df.schema.fields}
    assert kinds(run_offline(samples, RunConfig(), Broken)) == kinds(whole)


def test_resume(spark, tmp_path):
    source, sink, folder = (str(tmp_path / n) for n in ("in", "out", "state"))
    spark.range(10).write.json(source)
    start = lambda fp="f": resume.run(spark, "r", fp, source, "id long", lambda df: df.withColumn("twice", F.col("id") * 2), sink, folder)
    assert start() == "completed" and start() == "up_to_date"
    spark.range(10, 15).write.mode("append").json(source)
    assert start() == "completed"
    rows = spark.read.json(sink).collect()
    assert sorted(r.id for r in rows) == list(range(15)) and all(r.twice == 2 * r.id for r in rows)
    with pytest.raises(ValueError):
        start("other settings")
    state = resume.read_state(spark, f"{folder}/r.json").first()
    assert (state.run_id, state.processed_count, state.next_index, state.chunk_size, state.jsonl_path) == ("r", 15, 15, 100, sink)


def test_resume_counts_read_and_written_rows(spark, tmp_path):
    """Three starts of ten rows each: some kept, none kept, some kept; the first start's chunk size wins."""
    source, sink, folder = (str(tmp_path / n) for n in ("in", "out", "state"))
    few, none = (lambda df: df.filter("id % 10 < 6")), (lambda df: df.filter("id < 0"))
    start = lambda n, f: resume.run(spark, "r", "f", source, "id long", f, sink, folder, files_per_batch=n)
    state = lambda: {k: resume.RunState(spark, f"{folder}/r.json").data[k] for k in ("processed_count", "next_index", "written_count", "chunk_size")}
    for i, (f, status, written) in enumerate(((few, "completed", 6), (none, "no_samples_processed", 6), (few, "completed", 12))):
        spark.range(10 * i, 10 * i + 10, 1, 4).write.mode("append").json(source)
        assert start(1 + i, f) == status
        assert state() == {"processed_count": 10 * (i + 1), "next_index": 10 * (i + 1), "written_count": written, "chunk_size": 1}
    assert start(1, few) == "up_to_date" and state()["written_count"] == 12
    assert sorted(r.id for r in spark.read.schema("id long").json(sink).collect()) == [i for i in range(30) if i % 10 < 6 and i // 10 != 1]
    nothing = str(tmp_path / "empty")
    (tmp_path / "empty").mkdir()
    assert resume.run(spark, "e", "f", nothing, "id long", few, f"{sink}-e", folder) == "no_samples"


def test_a_batch_that_fails_is_done_again(spark, tmp_path):
    """A start that dies behind its output, before its manifest and commit: the next one replaces what it wrote."""
    source, sink, checkpoint = (str(tmp_path / n) for n in ("in", "out", "c"))
    spark.range(0, 8, 1, 4).write.json(source)
    go = lambda: resume.process_new(spark, source, "id long", lambda df: df, sink, checkpoint, files_per_batch=1)
    write, seen = sinks.write_text, []

    def dies(*args):
        seen.append(args[1])
        if len(seen) == 3:
            raise RuntimeError("lost")
        write(*args)

    sinks.write_text = dies
    try:
        with pytest.raises(Exception, match="lost"):
            go()
    finally:
        sinks.write_text = write
    assert resume.totals(spark, checkpoint) == (4, 4)
    assert go() == (4, 4, 8, 8)
    assert sorted(r.id for r in spark.read.schema("id long").json(sink).collect()) == list(range(8))
    assert go() == (0, 0, 8, 8)


def test_a_transform_that_sees_no_input(spark, tmp_path):
    """The optimiser may drop the input of a join with nothing."""
    spark.range(5).write.json(str(tmp_path / "in"))
    nothing = spark.createDataFrame([], "id long")
    done = resume.process_new(spark, str(tmp_path / "in"), "id long", lambda df: df.join(nothing, "id"), str(tmp_path / "out"), str(tmp_path / "c"))
    assert done.written == 0 and done.all_written == 0


def test_checkpoint_of_a_run_by_hand(spark, tmp_path):
    state = resume.RunState(spark, str(tmp_path / "r.json"))
    state.open("r", "f", "sink", 5)
    state.save("running", processed_count=3)
    assert resume.RunState(spark, str(tmp_path / "r.json")).reconcile(8) == 8
    with pytest.warns(UserWarning, match="notes 3 rows"):
        assert resume.RunState(spark, str(tmp_path / "r.json")).reconcile(2) == 3


def test_resume_point(spark):
    samples = spark.createDataFrame([(i, f"{i}.png", f"h{i}") for i in range(1, 6)], "sample_index long, image_path string, headline string")
    assert resume.check_resume(samples.filter("sample_index <= 3"), samples) == 3
    assert resume.check_resume(samples.filter("sample_index < 0"), samples) == 0
    with pytest.raises(ValueError, match="sequential"):
        resume.check_resume(samples.filter("sample_index != 2"), samples)
    with pytest.raises(ValueError, match="last"):
        resume.check_resume(samples.filter("sample_index <= 3").withColumn("headline", F.lit("x")), samples)


def test_streams_join(spark, tmp_path):
    rows = lambda n, step: spark.createDataFrame([(f"k{i % 3}", 1_000_000 + i * step) for i in range(n)], "k string, s long").select("k", F.timestamp_seconds("s").alias("ts"))
    rows(20, 60).write.parquet(str(tmp_path / "a"))
    rows(20, 90).withColumnRenamed("ts", "rts").write.parquet(str(tmp_path / "b"))
    a, b = (spark.read.parquet(str(tmp_path / n)) for n in "ab")
    read = lambda n, like: spark.readStream.schema(like.schema).parquet(str(tmp_path / n))
    query = resume.joined_streams(read("a", a), read("b", b), "k", "ts", "rts", "5 minutes", late="1 hour").writeStream.format("memory").queryName("pairs").trigger(availableNow=True).start()
    query.awaitTermination()
    expected = resume.joined_streams(a, b, "k", "ts", "rts", "5 minutes").collect()
    assert len(expected) > 5 and sorted(map(tuple, spark.table("pairs").collect())) == sorted(map(tuple, expected))


def test_stream_windows_equal_batch(spark, tmp_path):
    events = spark.createDataFrame([(i, "k%d" % (i % 2), i * 600) for i in range(30)], "i long, k string, s long").select("k", F.timestamp_seconds("s").alias("ts"))
    events.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    query = resume.windowed_counts(stream, "ts", "k", "1 hour", late="1 minute").writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(spark.table("windows").collect()) == sorted(resume.windowed_counts(events, "ts", "k", "1 hour").collect())


def _run_files(tmp_path):
    data = [{"text": f"h{i}", "image_path": f"/img/{i}.png", "gt_answers": "Fake" if i % 2 else "Real", "fake_cls": "mismatch" if i % 2 else "original", "image_source": "AI-generated image"} for i in range(6)]
    (tmp_path / "d.json").write_text(json.dumps(data))
    lines = [{"image_path": f"img/{i}.png", "headline": f"h{i}", "sample_index": i + 1, "iteration_index": i, "judgement": {"label": label, "confidence": 0.8}, "visual_veracity": {"ai_generated": i % 3 == 0} if i < 5 else {}, "token_usage": {"prompt": 3, "completion": 1}} for i, label in enumerate(["Not Misinformation", "Misinformation", "Misinformation", "Uncertain", "Not Misinformation", "Misinformation"])]
    lines.append({"image_path": "nowhere.png", "judgement": {"label": "Misinformation"}, "sample_index": 7})
    (tmp_path / "run.jsonl").write_text("\n".join(map(json.dumps, lines)))


def test_evaluate(spark, tmp_path):
    _run_files(tmp_path)
    tables = evaluate(spark, str(tmp_path / "run.jsonl"), str(tmp_path / "d.json"), "/data", report=str(tmp_path / "r.json"), csv=str(tmp_path / "csv"))
    assert tuple(tables["counts"].first()) == (7, 1, 1, 0.1667)
    everyone = tables["judge_by_class"].filter("cls = '__all__'").first()
    assert (everyone.tp, everyone.fp, everyone.fn, everyone.tn) == (2, 1, 1, 2)
    assert tables["ai_coverage"].first().covered == 5 and tables["calibration"].first().total == 5
    assert json.loads((tmp_path / "r.json").read_text())["label_distribution"]


def test_command_line(spark, tmp_path, capsys):
    _run_files(tmp_path)
    run = str(tmp_path / "run.jsonl")
    cli.main(["repair", "--outputs", run, "--dataset-json", str(tmp_path / "d.json"), "--image-root", "/data", "--dry-run"])
    assert "matched" in capsys.readouterr().out
    cli.main(["report", "--outputs", run, "--html", str(tmp_path / "r.html"), "--title", "Run"])
    assert (tmp_path / "r.html").exists()
    cli.main(["pipeline", "--dataset-json", str(tmp_path / "d.json"), "--save-jsonl", str(tmp_path / "new"), "--echo"])
    assert spark.read.json(str(tmp_path / "new")).count() == 6
    cli.main(["pipeline", "--image", "a.png", "--headline", "h", "--save-jsonl", str(tmp_path / "one")])
    assert spark.read.json(str(tmp_path / "one")).first().judgement.label == "Uncertain"


def test_pipeline_command_resumes(spark, tmp_path, monkeypatch):
    _run_files(tmp_path)
    monkeypatch.setenv("QUILLON_CHECKPOINT_EVERY", "2")
    out = str(tmp_path / "new")
    start = lambda *more: cli.main(["pipeline", "--dataset-json", str(tmp_path / "d.json"), "--save-jsonl", out, "--echo", "--no-questions", *more])
    start("--max-samples", "3")
    rows = sorted(records.scan_jsonl(spark, out).collect(), key=lambda r: r.sample_index)
    assert [r.sample_index for r in rows] == [1, 2, 3] and [r.iteration_index for r in rows] == [0, 1, 2]
    assert all(r.sample_details.dataset_index == r.dataset_order_index and r.headline == f"h{r.dataset_order_index}" for r in rows)
    with pytest.raises(SystemExit):
        start()
    start("--resume")
    again = sorted(records.scan_jsonl(spark, out).collect(), key=lambda r: r.sample_index)
    assert again[:3] == rows and [r.sample_index for r in again] == [1, 2, 3, 4, 5, 6]
    state = resume.RunState(spark, f"{out}.run.json").data
    assert (state["status"], state["processed_count"], state["chunk_size"]) == ("completed", 6, 2)
    start("--resume")
    assert resume.RunState(spark, f"{out}.run.json").data["status"] == "up_to_date"
    with pytest.raises(ValueError, match="fingerprint"):
        start("--resume", "--model", "another")
    cli.main(["report", "--outputs", out, "--samples-html", str(tmp_path / "samples.html")])
    assert (tmp_path / "samples.html").read_text().count("<tr>") == 7


def test_figures_of_commands(spark, tmp_path):
    _run_files(tmp_path)
    run = str(tmp_path / "run.jsonl")
    cli.main(["evaluate", "--outputs", run, "--dataset-json", str(tmp_path / "d.json"), "--image-root", "/data", "--figure-dir", str(tmp_path / "fig")])
    assert {"judge_filtered.svg", "calibration_bins.svg"} <= {p.name for p in (tmp_path / "fig").glob("*.svg")}
    rows = [{"image_path": "a", "judgement": {"label": "Misinformation", "confidence": 0.1 * i}, "sample_details": {"gt_answers": "Fake" if i % 2 else "Real"}} for i in range(6)]
    (tmp_path / "one.jsonl").write_text("\n".join(map(json.dumps, rows)))
    cli.main(["curves", "--inputs", str(tmp_path / "one.jsonl"), "--labels", "one", "--output-dir", str(tmp_path / "curves")])
    assert "<svg" in (tmp_path / "curves/roc-one.svg").read_text()


def test_investigate(spark):
    class Scripted:
        def ask(self, system, user, image_url=None):
            if "Sources:" in user:
                return '{"answer": "a", "confidence": %s, "citations": ["u"]}' % (0.9 if "two" in user else 0.4), 1, 1
            return '["one?", "two?", "ONE?"]' if "Chain 0" in user else '["one?", "three?"]', 1, 1

    samples = spark.createDataFrame([(1, "h"), (2, "g")], "sample long, headline string")
    rows = investigate(samples, RunConfig(q_chains=2), Scripted).collect()
    assert sorted((r.sample, r.chain, r.question, r.found.confidence) for r in rows) == [(1, 0, "two?", 0.9), (1, 1, "three?", 0.4), (2, 0, "two?", 0.9), (2, 1, "three?", 0.4)]
    only = investigate(samples, RunConfig(q_chains=1, disable_answers=True), Scripted)
    assert only.count() == 4 and "found" not in only.columns


def test_baseline_asks_no_more_than_needed(spark):
    class Staged:
        def ask(self, system, user, image_url=None):
            if "TEXT" in user:
                return ("Finish[TEXT REFUTES]" if "lie" in user else "Finish[TEXT SUPPORTS]"), 1, 1
            assert "lie" not in user
            if "IMAGE" in user:
                return ("Finish[IMAGE REFUTES]" if "fake" in user else "?"), 1, 1
            assert "fake" not in user
            return ("Finish[MISMATCH]" if "other" in user else "Finish[MATCH]"), 1, 1

    samples = spark.createDataFrame([(1, "lie"), (2, "fake"), (3, "other"), (4, "fine")], "sample_index long, headline string")
    rows = {r.sample_index: (r.judgement.label, r.judgement.fake_cls) for r in run_baseline(samples, Staged).collect()}
    assert rows == {1: ("Misinformation", "textual_veracity_distortion"), 2: ("Misinformation", "visual_veracity_distortion"), 3: ("Misinformation", "mismatch"), 4: ("Not Misinformation", "original")}


def test_backfill_and_baseline_commands(spark, tmp_path):
    _run_files(tmp_path)
    (tmp_path / "runs").mkdir()
    (tmp_path / "run.jsonl").rename(tmp_path / "runs/run.jsonl")
    arguments = ["backfill", "--results-dir", str(tmp_path / "runs"), "--dataset-json", str(tmp_path / "d.json"), "--image-root", "/data"]
    cli.main(arguments)
    report = tmp_path / "runs/run.metrics.json"
    assert json.loads(report.read_text())["judge_by_class"] and "calibration_bins" in (tmp_path / "runs/run.metrics.html").read_text()
    report.write_text('{"judge_metrics": {"metrics": {"precision": 1}}}')
    cli.main(arguments)
    assert "judge_metrics" in report.read_text()
    out = str(tmp_path / "base")
    for _ in range(2):  # the second start finds nothing left
        cli.main(["baseline", "--dataset-json", str(tmp_path / "d.json"), "--save-jsonl", out, "--echo"])
    assert spark.read.json(out).count() == 6
    with pytest.raises(SystemExit):
        cli.main(["baseline", "--dataset-json", str(tmp_path / "d.json"), "--save-jsonl", out])


def _plain_pipeline(model, headline, config):
    """The stages for one headline, call by call, without Spark: (best pairs, judgement label and confidence, tokens)."""
    tokens, load = 0, lambda raw: json.loads(raw[raw.index("{") : raw.rindex("}") + 1])

    def ask(system, user):
        nonlocal tokens
        raw, prompt, completion = model.ask(system, user)
        tokens += prompt + completion
        return raw

    def prompt(k, prior, answered):
        known = "\n".join(f"Q: {q}\nA: {a}..." for q, a in answered[-3:])
        seen = "Already asked:\n- " + "\n- ".join(prior) + "\n" if prior else ""
        told = f"Known so far:\n{known}\n" if answered else ""
        return f"Headline: {headline}\n{seen}{told}Ask {k} short questions that would help to verify it. Answer with a JSON array of strings."

    def fresh(raw, prior, k):
        out = []
        for q in json.loads(raw):
            if q.strip() and q.strip().lower() not in {x.lower() for x in [*prior, *out]}:
                out.append(q.strip())
        return out[:k]

    rel, ver = load(ask(claims._RELEVANCY_PROMPT, headline)), load(ask(claims._VERACITY_PROMPT, headline))
    prior, answered, best = [], [], []
    for chain in range(config.q_chains):
        new = fresh(ask(claims._QUESTION_PROMPT, prompt(config.q_per_chain, prior, answered) + f" Chain {chain}"), prior, config.q_per_chain)
        prior = prior + new
        items = [(q, load(ask(claims._ANSWER_PROMPT, f"Question: {q}\nSources:\n\nAnswer with one JSON object with answer, confidence, citations and rationale."))) for q in new]
        answered = answered + [(q, a["answer"]) for q, a in items]
        listed = "\n".join(f"{i}. {q} -> {a['answer']}" for i, (q, a) in enumerate(items, 1))
        chosen = load(ask(claims._ANSWER_PROMPT, f"Headline: {headline}\n{listed}\nAnswer with one JSON object with index and reason."))["index"]
        follow = ask(claims._QUESTION_PROMPT, prompt(config.followups_per_chain, prior, []) + f" Follow-ups {chain}")
        best.append(items[min(chosen, len(items)) - 1])
        prior = prior + fresh(follow, prior, config.followups_per_chain)
    return best, rel, ver, tokens


def test_pipeline_against_plain_calls(spark):
    """Every question, choice and token count of the stages, against a loop that asks one call after the other."""
    model, config = clients.EchoModel(), RunConfig(q_chains=3, q_per_chain=2)
    heads = ["the moon is far", "", "one two\nthree"]
    samples = spark.createDataFrame([(i + 1, f"/img/{i}.png", h, 10 + i, "Fake" if i else None) for i, h in enumerate(heads)], "sample_index long, image_path string, headline string, dataset_index long, gt_answers string")
    out = run_offline(samples, config, clients.EchoModel)
    rows = {r.sample_index: r for r in out.collect()}
    for i, h in enumerate(heads):
        row, (best, rel, ver, tokens) = rows[i + 1], _plain_pipeline(model, h, config)
        assert [(q.question, q.answer, q.confidence, [c.url for c in q.citations]) for q in row.best_qa_per_chain] == [(q, a["answer"], a["confidence"], [c["url"] for c in a["citations"]]) for q, a in best]
        assert row.relevancy.confidence == rel["confidence"] and row.visual_veracity.confidence == ver["confidence"]
        pairs = [{"question": q, "answer": a["answer"], "confidence": a["confidence"], "citations_count": len(a["citations"])} for q, a in best]
        payload = json.loads(spark.createDataFrame([row], out.schema).select(claims.compact_payload({"headline": F.col("headline"), "relevancy": F.col("relevancy"), "veracity": F.col("visual_veracity"), "best_qa": F.col("best_qa_per_chain")})).first()[0])
        assert payload["best_qa_per_chain"] == pairs and payload["headline"] == h
        assert row.judgement.label in clients._LABELS and row.judgement.key_factors and row.judgement.raw
        judged = len(json.dumps(payload, ensure_ascii=False, separators=(",", ":")).split()) + len(row.judgement.raw.split())
        assert row.token_usage.total == tokens + judged
        assert (row.dataset_order_index, row.iteration_index, row.sample_details.dataset_index, row.sample_details.gt_answers) == (10 + i, i, 10 + i, "Fake" if i else None)
        assert row.run_params.q_per_chain == 2 and row.settings.answer_questions and row.modules.judge


def test_judge_takes_token_probabilities_and_the_image(spark):
    class Sure:
        def ask(self, system, user, image_url=None):
            if "with label, confidence" in system:
                return '{"label": "misinformation", "confidence": 0.7}', 1, 1, [-0.1, -0.3]
            return '{"aligned": "%s", "ai_generated": "yes", "confidence": 0.5}' % ("yes" if image_url == "data:x" else "no"), 1, 1

    samples = spark.createDataFrame([(1, "i.png", "h", "data:x")], "sample_index long, image_path string, headline string, url string")
    row = run_offline(samples, RunConfig(disable_questions=True), Sure, image_url="url").first()
    assert row.relevancy.aligned == "true" and row.judgement.label == "Misinformation"
    assert row.judgement.logprob_stats.token_count == 2 and abs(row.judgement.logprob_confidence - 2.718281828459045**-0.2) < 1e-9


def test_providers():
    sent = []

    def transport(url, headers, body=None):
        sent.append((url, headers, body))
        if "generateContent" in url:
            return {"candidates": [{"content": {"parts": [{"text": "a"}, {"text": "b"}]}}], "usageMetadata": {"promptTokenCount": 4, "candidatesTokenCount": 2}}
        return {"choices": [{"message": {"content": "hi"}, "logprobs": {"content": [{"logprob": -0.5}]}}], "usage": {"prompt_tokens": 3, "completion_tokens": 1}}

    chat = clients.model_client("OpenAI", "http://x/v1/", "k", "m", logprobs=True, transport=transport)
    assert chat.ask("s", "u") == ("hi", 3, 1, [-0.5]) and sent[-1][0] == "http://x/v1/chat/completions" and sent[-1][2]["logprobs"]
    chat.ask("s", "u", "data:image/png;base64,AA")
    assert "logprobs" not in sent[-1][2] and sent[-1][2]["messages"][1]["content"][1]["image_url"]["url"].startswith("data:")
    other = clients.model_client("google", "http://y", "k", "m", transport=transport)
    assert other.ask("s", "u", "data:image/png;base64,AA") == ("ab", 4, 2, None)
    assert sent[-1][2]["contents"][0]["parts"][1] == {"inline_data": {"mime_type": "image/png", "data": "AA"}}
    with pytest.raises(ValueError):
        clients.model_client("nobody", "", "", "")
    assert clients.search_provider(" DuckDuckGo") == "duckduckgo" and clients.search_provider("?") == clients.search_provider(None) == "brave"
    web = clients.WebSearch("http://z", "t", lambda url, headers: {"web": {"results": [{"url": url}, 3]}})
    assert web.search("a b", count=2, offset=None) == [{"url": "http://z?q=a+b&count=2"}]
    assert clients.KeywordSearch(lambda q, **p: [{"q": q, **p}]).search("x", region="de", other=1, page=None) == [{"q": "x", "region": "de"}]


def test_limiter():
    now, slept = [1000.0], []

    def sleep(seconds):
        slept.append(seconds)
        now[0] += seconds

    make = lambda **o: clients.Limiter(clock=lambda: now[0], sleep=sleep, seed=1, **o)
    spaced = make(interval=2.0, jitter=0.5)
    for _ in range(3):
        spaced.acquire()
    assert all(1.0 <= s <= 3.0 for s in slept) and len(slept) == 2
    slept.clear()
    minute = make(per_minute=3)
    for _ in range(4):
        minute.acquire()
    assert abs(sum(slept) - 60.0) < 0.01
    daily = make(daily=2)
    daily.acquire(), daily.acquire()
    with pytest.raises(RuntimeError):
        daily.acquire()
    daily.give_back()
    daily.acquire()
    now[0] += 86400
    daily.acquire()
    slept.clear()
    refused = make()
    refused.acquire()
    refused.back_off(limit=10, reset_ms=int((now[0] + 30) * 1000))
    refused.acquire()
    assert refused.per_minute == 10 and refused.interval == 6.0 and abs(sum(slept) - 30) < 0.01
    class Down:
        def ask(self):
            raise OSError

    limited = clients.LimitedClient(Down(), make(daily=1))
    for _ in range(3):
        with pytest.raises(OSError):
            limited.ask()


def test_quota_comes_back_the_next_day():
    """A refusal closes the day, not the days after it."""
    now = [86400.0 * 10]
    limiter = clients.Limiter(daily=5, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))

    class Server:
        def __init__(self):
            self.refuse = True

        def ask(self):
            if self.refuse:
                raise clients.Refused(500, None)
            return "yes"

    server = Server()
    client = clients.LimitedClient(server, limiter)
    with pytest.raises(clients.Refused):
        client.ask()
    assert limiter.today == 1  # the refused call counts
    server.refuse = False
    with pytest.raises(RuntimeError, match="quota"):
        client.ask()
    now[0] += 86400
    assert [client.ask() for _ in range(5)] == ["yes"] * 5
    with pytest.raises(RuntimeError, match="quota"):
        client.ask()


def test_equal_pairs_are_asked_once_and_see_the_image(spark):
    samples = spark.createDataFrame([(1, "h", "a.png"), (2, "h", "a.png"), (3, "h", "b.png"), (4, None, "a.png"), (5, "", "a.png"), (6, "h", None)], "sample_index long, headline string, image_path string")
    images = spark.createDataFrame([("a.png", "data:A"), ("b.png", "data:B")], "image_path string, image_url string")

    class Sees:
        def ask(self, system, user, image_url=None):
            if "label" in system:
                raise RuntimeError("none")
            return json.dumps({"aligned": "true", "ai_generated": "false", "confidence": 0.5, "explanation": f"{user}|{image_url}"}), 1, 0

    out = claims.run_offline(samples, RunConfig(disable_questions=True), Sees, images=images).collect()
    assert {r.sample_index: (r.relevancy.explanation, r.token_usage.prompt) for r in out} == {1: ("h|data:A", 2), 2: ("h|data:A", 0), 3: ("h|data:B", 2), 4: ("|data:A", 2), 5: ("|data:A", 0), 6: ("h|None", 2)}


def test_answers_are_searched(spark):
    class Asks:
        def ask(self, system, user, image_url=None):
            if "JSON array" in user:
                return '["who?"]', 1, 1
            return json.dumps({"answer": "searched" if "d 1" in user else "not", "confidence": 0.5}), 1, 1

    class Finds:
        def search(self, query, **parameters):
            return [{"title": "t", "url": "u", "description": f"d {parameters['max_results'] // parameters['max_results']}"}]

    samples = spark.createDataFrame([(1, "h")], "sample long, headline string")
    assert [b.answer for b in claims.chains(samples, RunConfig(q_chains=1), Asks, Finds).first().best] == ["searched"]
    assert [b.answer for b in claims.chains(samples, RunConfig(q_chains=1), Asks).first().best] == ["not"]


@pytest.mark.parametrize("questions", [False, True])
def test_texts_are_not_kept_with_what_is_found(spark, questions):
    """Only digests and answers are written; rows that repeat an index or have none stay rows."""
    rows = [(1, "a", "one claim"), (2, "a", "one claim"), (3, "b", "one claim"), (4, "a", None), (5, None, ""), (6, "a", "other"), (6, "a", "other"), (None, "c", "no index")]
    samples, kept = spark.createDataFrame(rows, "sample_index long, image_path string, headline string"), []

    def keep(df):
        kept.append(df.schema.simpleString())
        return sinks.written(df)

    out = claims.run_offline(samples, RunConfig(disable_questions=not questions, q_chains=1), clients.EchoModel, keep=keep)
    got = sorted(((r.sample_index, r.image_path, r.headline) for r in out.collect()), key=repr)
    assert got == sorted(rows, key=repr)
    assert kept and not [k for k in kept if "headline" in k or "_user:" in k]
