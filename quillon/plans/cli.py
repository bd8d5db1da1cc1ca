"""Command line: evaluate, curves, repair, report, pipeline, baseline, backfill, unpack."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def session(name: str = "quillon") -> SparkSession:
    """A session with the settings the operators are written for."""
    conf = {"spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.sql.mapKeyDedupPolicy": "LAST_WIN", "spark.speculation": "false"}
    return SparkSession.builder.appName(name).config(map=conf).getOrCreate()


def _evaluate(args) -> None:
    from quillon.plans.evaluation import evaluate

    for name, table in evaluate(session(), args.outputs, args.dataset_json, args.image_root, args.save_report, args.save_csv, args.save_html, args.figure_dir).items():
        print(name)
        table.show(truncate=False)


def _curves(args) -> None:
    from quillon.functions import labels
    from quillon.operators import curves
    from quillon.sources import sinks
    from quillon.sources.records import scan_jsonl

    spark, runs = session(), None
    for path, label in zip(args.inputs, args.labels or args.inputs, strict=True):
        rows = scan_jsonl(spark, path, mode="strict")
        truth = labels.known_truth(F.col("sample_details.gt_answers"), F.col("sample_details.fake_cls"))
        score = labels.misinformation_score(F.col("judgement.label"), F.col("judgement.confidence"))
        one = rows.select(F.lit(label).alias("run"), score.alias("score"), truth.alias("truth")).filter("truth IS NOT NULL")
        runs = one if runs is None else runs.unionByName(one)
    curves.areas(runs).show(truncate=False)
    curves.latex_rows(curves.areas(runs)).show(truncate=False)
    if args.output_dir:
        curves.roc_points(runs).write.mode("overwrite").parquet(f"{args.output_dir}/roc")
        curves.pr_points(runs).write.mode("overwrite").parquet(f"{args.output_dir}/pr")
        for name, points, x, y in (("roc", curves.roc_points(runs), "fpr", "tpr"), ("pr", curves.pr_points(runs), "recall", "precision")):
            for label in args.labels or args.inputs:  # a figure has as many points as a run has different scores
                line = [(r[0], r[1]) for r in points.filter(F.col("run") == label).orderBy(F.desc_nulls_first("score")).select(x, y).toLocalIterator()]
                sinks.write_text(spark, f"{args.output_dir}/{name}-{label.rsplit('/', 1)[-1]}.svg", sinks.curve_svg(line, f"{name} {label}", diagonal=name == "roc"))


def _repair(args) -> None:
    from quillon.functions.text import record_path
    from quillon.operators import lookup
    from quillon.sources import records, sinks

    spark = session()
    data = sinks.written(records.project_records(records.scan_dataset(spark, args.dataset_json)), "dataset")
    known = data.select(F.col("dataset_index").alias("idx"), record_path(F.col("image_path"), args.image_root).alias("path"), F.col("text").alias("headline"))
    outputs = records.scan_jsonl(spark, args.outputs)
    keyed = outputs.withColumn("path", record_path(F.col("image_path"), args.image_root)).withColumn("details_index", F.col("sample_details.dataset_index"))
    matched = lookup.cascade_join(keyed, known, [("dataset_order_index", "dataset_order_index"), ("details_index", "sample_details.dataset_index")])
    lookup.repair_stats(matched).show()
    lookup.source_counts(matched).orderBy(F.desc("n"), "match_source").show()
    details = data.select(F.col("dataset_index").alias("match_index"), F.struct("dataset_index", "gt_answers", "fake_cls", "text_source", "image_source").alias("_details"))
    fixed = matched.join(details, "match_index", "left").withColumn("sample_details", F.coalesce("_details", "sample_details"))
    sinks.rewrite_jsonl(fixed.withColumn("dataset_order_index", F.coalesce("match_index", "dataset_order_index")).select(*outputs.columns), args.outputs, args.dry_run)


def _report(args) -> None:
    from quillon.operators import usage
    from quillon.sources import records, sinks

    outputs = records.scan_jsonl(session(), args.outputs)
    if args.tokens_csv:
        sinks.write_tokens_csv(outputs, args.tokens_csv)
    if args.samples_html:
        sinks.write_sample_report(outputs, args.samples_html, args.title or "Run")
    if args.html:
        sinks.write_html_report({"tokens": usage.token_totals(outputs.select("token_usage.*"))}, args.html, args.title or "Run")


def _model(args, config):
    """The factory of the model client that the arguments and settings name; None without one."""
    import os

    from quillon.sources.clients import EchoModel, Limiter, LimitedClient, model_client

    if args.echo:
        return EchoModel
    if not (config.base_url and config.model):
        return None
    key = os.environ.get(args.key_variable or "QUILLON_KEY", "")
    options = {"temperature": config.temperature} | ({"logprobs": True} if config.logprobs else {})
    limits = {"per_minute": config.requests_per_minute, "daily": config.daily_quota}
    return lambda: LimitedClient(model_client(config.provider, config.base_url, key, config.model, **options), Limiter(**limits))


def _search(args, config):
    """The factory of the search client that the arguments name; None without one."""
    import os

    from quillon.sources.clients import EchoSearch, LimitedClient, Limiter, WebSearch

    if args.echo:
        return EchoSearch
    if not args.search_url:
        return None
    token = os.environ.get("QUILLON_SEARCH_KEY", "")
    return lambda: LimitedClient(WebSearch(args.search_url, token), Limiter(config.search_interval, config.search_jitter))


def _images(spark, samples, root: str | None):
    """(image_path, image_url) of the samples' images below a folder; None without one."""
    from quillon.sources import records

    if not root:
        return None
    files = records.scan_images(spark, root)
    found, _ = records.existing(samples.select("dataset_index", "image_path").dropDuplicates(["image_path"]), files, root)
    return found.join(files, "path").select("image_path", F.col("data_url").alias("image_url"))


def _samples(spark, args, config):
    """The run's samples in its order: sample_index counts from 1."""
    from quillon.operators.ordered import numbered
    from quillon.operators.sampling import shuffled, stratified_order
    from quillon.sources import records, sinks

    if args.image and args.headline:
        data = records.single_pair(spark, args.image, args.headline)
    else:
        data = sinks.written(records.project_records(records.scan_dataset(spark, args.dataset_json)), "dataset")
    ordered = stratified_order(data, list(config.stratify_by), config.seed, "dataset_index") if config.stratify_by else shuffled(data, config.seed, "dataset_index").withColumnRenamed("shuffle_key", "order_score")
    placed = numbered(ordered, "order_score", "iteration_index").withColumn("sample_index", F.col("iteration_index") + 1).withColumnRenamed("text", "headline")
    placed = placed.filter(F.col("sample_index") <= config.max_samples) if config.max_samples is not None else placed
    details = [c for c in ("gt_answers", "fake_cls", "text_source", "image_source") if c in placed.columns]
    return placed.select("sample_index", "iteration_index", "dataset_index", "image_path", "headline", *details)


def _pipeline(args) -> None:
    """Runs the claim stages chunk by chunk, in the run's order, and notes after each how far it is; ``--resume`` goes on from there."""
    from dataclasses import replace

    from quillon.plans.claims import run_offline
    from quillon.sources import records, sinks
    from quillon.sources.config import RunConfig
    from quillon.streaming import resume

    config, spark = RunConfig.from_env(), session()
    given = {"max_samples": args.max_samples and int(args.max_samples), "provider": args.provider, "model": args.model, "base_url": args.base_url}
    config = replace(config, **{k: v for k, v in given.items() if v is not None}, **({"disable_questions": True} if args.no_questions else {}), **({"disable_judge": True} if args.no_judge else {}))
    samples = sinks.written(_samples(spark, args, config), "samples")
    total = samples.count()
    state = resume.RunState(spark, f"{args.save_jsonl}.run.json")
    if state.data and not args.resume:
        raise SystemExit(f"{args.save_jsonl} has a run already; give --resume to go on")
    size = state.open(args.run_id or "run", config.fingerprint(), args.save_jsonl, config.checkpoint_every)
    outputs = records.scan_jsonl(spark, args.save_jsonl) if resume.sink_rows(spark, args.save_jsonl) else None
    done = state.reconcile(0 if outputs is None else resume.check_resume(outputs, samples))
    if not total or done >= total:
        state.save("up_to_date" if total else "no_samples", processed_count=done, next_index=done)
        return
    state.save("running", next_index=done)
    each = size * spark.sparkContext.defaultParallelism  # the more tasks, the more samples between two notes
    for start in range(done, total, each):
        chunk = samples.filter((F.col("sample_index") > start) & (F.col("sample_index") <= start + each))
        out = run_offline(chunk, config, _model(args, config), _search(args, config), images=_images(spark, chunk, args.image_root))
        sinks.append_jsonl(out, args.save_jsonl)
        done = min(total, start + each)
        state.save("running", processed_count=done, next_index=done)
    state.save("completed", processed_count=done, next_index=done)


def _baseline(args) -> None:
    """The three-stage baseline with the model and search that are given; what the output holds already is checked to be the first samples, and not asked again."""
    from dataclasses import replace

    from quillon.plans.claims import run_baseline, with_knowledge
    from quillon.sources import records, sinks
    from quillon.sources.config import RunConfig
    from quillon.streaming import resume

    spark, config = session(), RunConfig.from_env()
    config = replace(config, **{k: v for k, v in {"provider": args.provider, "model": args.model, "base_url": args.base_url}.items() if v is not None})
    model, search = _model(args, config), _search(args, config)
    if model is None:
        raise SystemExit("give --base-url and --model of a model, or --echo")
    data = sinks.written(records.project_records(records.scan_dataset(spark, args.dataset_json)), "dataset")
    samples = data.select((F.col("dataset_index") + 1).alias("sample_index"), "image_path", F.col("text").alias("headline"))
    done = resume.check_resume(records.scan_jsonl(spark, args.save_jsonl), samples) if resume.sink_rows(spark, args.save_jsonl) else 0
    left = samples.filter(F.col("sample_index") > done)
    if args.knowledge_site and search:
        left = with_knowledge(left, search, args.knowledge_site)
    if not left.isEmpty():
        images = _images(spark, left.withColumn("dataset_index", F.col("sample_index") - 1), args.image_root)
        sinks.append_jsonl(run_baseline(left, model, images=images), args.save_jsonl)


def _backfill(args) -> None:
    """Reports, JSON and HTML with the calibrations, for runs of a folder that have none yet, wherever Spark can read it."""
    from quillon.functions.jsonx import has_precision
    from quillon.plans.evaluation import evaluate
    from quillon.sources import sinks

    spark, folder = session(), args.results_dir.rstrip("/")
    for name in sorted(n for n in sinks.file_names(spark, folder) if n.endswith(".jsonl")):
        stem = f"{folder}/{name.removesuffix('.jsonl')}"
        report = sinks.read_text(spark, f"{stem}.metrics.json")
        if report is not None and not args.force:
            known = spark.createDataFrame([(report,)], "t string").select(has_precision(F.try_parse_json("t"))).first()[0]
            if known or args.skip_existing:
                continue
        evaluate(spark, f"{stem}.jsonl", args.dataset_json, args.image_root, report=f"{stem}.metrics.json", html=f"{stem}.metrics.html")
        print(f"{stem}.metrics.json")


def _unpack(args) -> None:
    from quillon.sources.archive import unpack

    print(unpack(args.zip, args.dest), "files")


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="quillon", description=__doc__)
    commands = parser.add_subparsers(required=True)

    def command(name: str, run, *options: str, flags: tuple[str, ...] = (), needed: tuple[str, ...] = (), many: tuple[str, ...] = ()) -> None:
        sub = commands.add_parser(name)
        sub.set_defaults(run=run)
        for o in options:
            sub.add_argument(f"--{o}", required=o in needed, nargs="+" if o in many else None)
        for f in flags:
            sub.add_argument(f"--{f}", action="store_true")

    command("evaluate", _evaluate, "outputs", "dataset-json", "image-root", "save-report", "save-csv", "save-html", "figure-dir", needed=("outputs", "dataset-json", "image-root"))
    command("curves", _curves, "inputs", "labels", "output-dir", needed=("inputs",), many=("inputs", "labels"))
    command("repair", _repair, "outputs", "dataset-json", "image-root", flags=("dry-run",), needed=("outputs", "dataset-json"))
    command("report", _report, "outputs", "html", "samples-html", "title", "tokens-csv", needed=("outputs",))
    settings = ("max-samples", "provider", "model", "base-url", "key-variable", "run-id")
    command("pipeline", _pipeline, "dataset-json", "image", "headline", "save-jsonl", "image-root", "search-url", *settings, flags=("echo", "resume", "no-questions", "no-judge"), needed=("save-jsonl",))
    command("baseline", _baseline, "dataset-json", "save-jsonl", "knowledge-site", "image-root", "search-url", "provider", "model", "base-url", "key-variable", flags=("echo",), needed=("dataset-json", "save-jsonl"))
    command("backfill", _backfill, "results-dir", "dataset-json", "image-root", flags=("force", "skip-existing"), needed=("results-dir", "dataset-json", "image-root"))
    command("unpack", _unpack, "zip", "dest", needed=("zip", "dest"))
    args = parser.parse_args(argv)
    args.run(args)


if __name__ == "__main__":
    main(sys.argv[1:])
