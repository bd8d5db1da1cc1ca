"""The claim pipeline: stages over (headline, image) records, each a plan of its own.

What stages find is kept in narrow tables beside the samples, by ``_id``; texts
are joined in where a prompt needs them, and never written with an answer.

A stage that is switched off is not in the plan. Stages with a model ask it
through ``sources.clients.ask_model`` and parse its answer with column
expressions; without a model the deterministic judge decides from the signals
that there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import jsonx, labels, messages, text
from quillon.operators import lookup, qa
from quillon.operators.calibration import logprob_summary
from quillon.sources.clients import ask_model, search_web
from quillon.sources.config import RunConfig
from quillon.sources.sinks import dealt, written

_RELEVANCY_PROMPT = "You judge whether an image fits a headline. Answer with one JSON object with aligned, confidence and explanation."
_VERACITY_PROMPT = "You judge whether an image is authentic. Answer with one JSON object with ai_generated, confidence, explanation and anomalies."
_JUDGE_PROMPT = "You judge a claim from what is known about it. Answer with one JSON object with label, confidence, rationale and key_factors."
_QUESTION_PROMPT = "You ask questions that help to verify a claim."
_ANSWER_PROMPT = "You answer questions from the sources that are given."


def relevancy(raw: Column) -> Column:
    """struct(aligned, confidence, explanation, raw) of a model's answer."""
    found = jsonx.extract_object(raw)
    explanation = F.coalesce(jsonx.get(found, "$.explanation", "string"), F.trim(raw))
    return F.struct(labels.aligned(jsonx.get(found, "$.aligned", "string")).alias("aligned"), jsonx.confidence(found).alias("confidence"), explanation.alias("explanation"), raw.alias("raw"))


def veracity(raw: Column) -> Column:
    """struct(ai_generated, confidence, explanation, anomalies, raw) of a model's answer; one anomaly may stand alone."""
    found = jsonx.extract_object(raw)
    one = jsonx.get(found, "$.anomalies", "string")
    many = F.coalesce(F.try_variant_get(found, "$.anomalies", "array<string>"), F.when(one.isNotNull(), F.array(one)), F.array().cast("array<string>"))
    explanation = F.coalesce(jsonx.get(found, "$.explanation", "string"), F.trim(raw))
    return F.struct(labels.generated(jsonx.get(found, "$.ai_generated", "string")).alias("ai_generated"), jsonx.confidence(found).alias("confidence"), explanation.alias("explanation"), many.alias("anomalies"), raw.alias("raw"))


def answer(raw: Column) -> Column:
    """struct(answer, citations, confidence, rationale) of a model's answer; text that is no JSON is the answer itself."""
    found = jsonx.extract_object(raw)
    cites = F.transform(
        F.coalesce(F.try_variant_get(found, "$.citations", "array<variant>"), F.array().cast("array<variant>")),
        lambda c: F.struct(
            F.coalesce(F.try_variant_get(c, "$.url", "string"), F.try_variant_get(c, "$", "string"), F.lit("")).alias("url"), F.coalesce(F.try_variant_get(c, "$.title", "string"), F.lit("")).alias("title")
        ),
    )
    return F.struct(F.coalesce(jsonx.get(found, "$.answer", "string"), F.trim(raw)).alias("answer"), cites.alias("citations"), jsonx.confidence(found).alias("confidence"), jsonx.get(found, "$.rationale", "string").alias("rationale"))


def judgement(raw: Column) -> Column:
    """struct(label, confidence, rationale, key_factors) of a model's answer; uncertain at 0.5 without JSON."""
    found = jsonx.extract_object(raw)
    one = jsonx.get(found, "$.key_factors", "string")
    factors = F.coalesce(F.try_variant_get(found, "$.key_factors", "array<string>"), F.when(one.isNotNull(), F.array(one)), F.array().cast("array<string>"))
    conf = labels.clamp(F.coalesce(jsonx.confidence(found), F.lit(0.5)))
    return F.struct(labels.canonical_label(F.coalesce(jsonx.get(found, "$.label", "string"), F.lit(labels.UNCERTAIN))).alias("label"), conf.alias("confidence"), F.coalesce(jsonx.get(found, "$.rationale", "string"), F.trim(raw)).alias("rationale"), factors.alias("key_factors"))


def compact_payload(record: dict[str, Column]) -> Column:
    """The judge's input as JSON: headline, signals, and questions with the number of citations."""
    pairs = F.transform(record["best_qa"], lambda q: F.struct(q["question"].alias("question"), q["answer"].alias("answer"), q["confidence"].alias("confidence"), F.coalesce(F.size(q["citations"]), F.lit(0)).alias("citations_count")))
    return F.to_json(F.struct(record["headline"].alias("headline"), record["relevancy"].alias("relevancy"), record["veracity"].alias("visual_veracity"), pairs.alias("best_qa_per_chain")))


def questions(raw: DataFrame, per_chain: int, prior: DataFrame | None = None) -> DataFrame:
    """(sample, chain, pos, question) of ``raw(sample, chain, raw)``: JSON arrays or plain lines, new ones only, the first of each chain."""
    items = F.coalesce(jsonx.strings(jsonx.extract_array(F.col("raw"))), text.bullet_lines(F.col("raw")))
    asked = raw.select("sample", "chain", F.posexplode(items).alias("pos", "question")).withColumn("question", F.trim("question"))
    fresh = qa.dedup_questions(asked, "sample", ["chain", "pos"], prior=prior)
    ranked = fresh.withColumn("_chain", F.struct("sample", "chain"))
    return qa.top_k(ranked, "_chain", ["pos"], per_chain).drop("_chain", "rank")


def select_best(pairs: DataFrame, choice: DataFrame | None = None) -> DataFrame:
    """One question for each (sample, chain): the model's ``choice(sample, chain, raw)``, else the most confident."""
    best = qa.best_answer(pairs, ["sample", "chain"], "pos")
    if choice is None:
        return best
    sizes = pairs.groupBy("sample", "chain").agg(F.count(F.lit(1)).cast("int").alias("_size"))
    chosen = sizes.join(choice, ["sample", "chain"]).select("sample", "chain", jsonx.selection_index(F.col("raw"), F.col("_size")).alias("_index"))
    from pyspark.sql import Window

    numbered = pairs.withColumn("_n", F.row_number().over(Window.partitionBy("sample", "chain").orderBy("pos")))
    picked = numbered.join(chosen, ["sample", "chain"]).filter("_n = _index").drop("_n", "_index")
    return picked.unionByName(best.join(chosen, ["sample", "chain"], "left_anti"))


#: What the three stages of the baseline are asked; each ends in a marker that labels.stage_verdict knows.
_STAGE_PROMPTS = {
    "text": "Do the facts support this headline? {knowledge} Headline: {headline} End with Finish[TEXT SUPPORTS] or Finish[TEXT REFUTES].",
    "image": "Is the image of this claim authentic? Say what you see after Observation:. Headline: {headline} End with Finish[IMAGE SUPPORTS] or Finish[IMAGE REFUTES].",
    "cross": "Does the image show what the headline says? Headline: {headline} End with Finish[MATCH] or Finish[MISMATCH].",
}


def with_knowledge(samples: DataFrame, factory, site: str, most: int = 3, keep=written) -> DataFrame:
    """``samples`` with ``knowledge``: what a search of ``site`` tells about the headline; equal headlines are searched once."""
    asked = samples.select("headline").distinct().withColumn("_query", F.concat(F.lit(f"site:{site} "), F.coalesce("headline", F.lit(""))))
    found = keep(search_web(asked, factory, "_query", "_found", max_results=most))
    told = found.select(F.col("headline").alias("_headline"), text.knowledge(F.coalesce("_found", F.array().cast(_SOURCES)), most).alias("knowledge"))
    return samples.join(told, F.col("headline").eqNullSafe(F.col("_headline")), "left").drop("_headline")


def with_images(samples: DataFrame, images: DataFrame) -> DataFrame:
    """``samples(image_path, ...)`` with ``image_url`` from ``images(image_path, image_url)``, a row for each path; null where there is none."""
    shown = images.select(F.col("image_path").alias("_path"), "image_url")
    return samples.join(shown, F.col("image_path") == F.col("_path"), "left").drop("_path")


def run_baseline(samples: DataFrame, factory, keep=written, images: DataFrame | None = None) -> DataFrame:
    """``samples(sample_index, headline[, knowledge])`` with three stage verdicts and the cascade's judgement.

    With ``images(image_path, image_url)`` the stages about the image show it;
    samples then have ``image_path``.

    A stage that objects decides, so later stages are asked only about what is
    left: the plan splits after each stage instead of asking all of them. ``keep``
    holds a stage's answers, so that no branch asks again; where answers are
    dear, give a function that writes and rereads them.
    """
    columns, out = samples.columns, None
    knowledge = F.col("knowledge") if "knowledge" in columns else F.lit("")
    left = samples
    passed = {k: F.struct(F.lit(None).cast("string").alias("verdict"), F.lit(None).cast("double").alias("confidence")) for k in _STAGE_PROMPTS}
    for kind, objection in (("text", "REFUTES"), ("image", "REFUTES"), ("cross", "MISMATCH")):
        prompt = messages.fill(_STAGE_PROMPTS[kind], headline=F.col("headline"), knowledge=knowledge)
        seen = with_images(left, images) if images is not None and kind != "text" else left
        asked = ask_model(seen.withColumn("_user", prompt), factory, "You check claims.", "_user", "_s", "image_url" if seen is not left else None).withColumn(kind, labels.stage_verdict(F.coalesce("_s_raw", F.lit("")), kind))
        asked = keep(asked.drop("image_url", "_user", "_s_raw", "_s_prompt", "_s_completion", "_s_error", "_s_logprobs"))
        stopped = asked.filter(F.col(f"{kind}.verdict") == objection)
        for later in list(_STAGE_PROMPTS)[list(_STAGE_PROMPTS).index(kind) + 1 :]:
            stopped = stopped.withColumn(later, passed[later])
        out = stopped if out is None else out.unionByName(stopped)
        left = asked.filter(F.col(f"{kind}.verdict") != objection)
    everyone = out.unionByName(left)
    return everyone.withColumn("judgement", labels.cascade(F.col("text"), F.col("image"), F.col("cross")))


_ASKED = "array<string>"
_ANSWERED = "array<struct<question: string, answer: string>>"
_BEST = "array<struct<chain: int, pos: int, question: string, answer: string, confidence: double, citations: array<struct<url: string, title: string>>>>"
_SOURCES = "array<struct<title: string, url: string, description: string, source: string>>"


def _fresh(items: Column, prior: Column, most: int | None = None) -> Column:
    """The first ``most`` of the items that are new: compared trimmed and in lower case, with each other and with ``prior``."""
    low = lambda xs: F.transform(xs, lambda x: F.lower(F.trim(x)))
    trimmed = F.transform(F.coalesce(items, F.array().cast(_ASKED)), lambda x: F.trim(x))
    new = lambda x, i: (x != "") & (F.array_position(low(trimmed), F.lower(x)) == i + 1) & ~F.array_contains(low(prior), F.lower(x))
    found = F.filter(trimmed, new)
    return F.slice(found, 1, most) if most else found


def _items(raw: Column) -> Column:
    return F.coalesce(jsonx.strings(jsonx.extract_array(raw)), text.bullet_lines(raw))


def _answers(asked: DataFrame, config: RunConfig, factory, search, keep) -> DataFrame:
    """(_id, pos, question, answer struct, tokens) of ``asked(_id, sample, chain, pos, question)``: equal questions of all samples are answered once."""

    def evaluate(distinct: DataFrame) -> DataFrame:
        none = F.array().cast(_SOURCES)
        with_sources = distinct.select("question")
        if callable(search):
            with_sources = keep(search_web(with_sources, search, "question", "sources", max_results=config.answer_max_sources).drop("sources_error"))
        else:
            with_sources = with_sources.join(search, "question", "left") if search is not None else with_sources.withColumn("sources", none)
        with_sources = with_sources.withColumn("_user", messages.answer_prompt(F.col("question"), F.coalesce("sources", none), config.answer_max_sources))
        found = ask_model(with_sources.select("question", "_user"), factory, _ANSWER_PROMPT, "_user", "_a")
        return keep(found.select("question", F.when(F.col("_a_error").isNull(), answer(F.col("_a_raw"))).alias("found"), "_a_prompt", "_a_completion"))

    answered = lookup.dedup_eval(asked.withColumn("_order", F.struct("sample", "_id", "chain", "pos")), "question", "_order", evaluate)
    paid = lambda c: F.when(F.col("duplicate"), 0).otherwise(F.col(c)).cast("long").alias(c)  # noqa: E731  # the first that asked pays
    return answered.select("_id", "pos", "question", "found", paid("_a_prompt"), paid("_a_completion"))


def chains(samples: DataFrame, config: RunConfig, factory, search=None, keep=written, choose: bool = True) -> DataFrame:
    """``samples(sample, headline)`` with what the question chains found: asked, answered, best, _prompt and _completion.

    ``search`` gives the answers' sources: a table (question, sources), or a factory
    of a search client, which is asked once for each new question.

    Chains follow each other: a chain's prompt lists all earlier questions, the
    follow-ups that were proposed, and the last answers. Each chain is a few
    stages over all samples, whose outcome is written before the next, without
    the headlines: these are written once, dealt by ``_id``. Samples that have an
    ``_id``, one each, are taken as dealt. With ``choose`` the model picks the
    best pair of a chain and proposes follow-ups; where it fails, and without
    ``choose``, the most confident answer counts.
    """
    if "_id" not in samples.columns:
        samples = dealt(samples.select(F.to_json(F.struct("sample")).alias("_id"), "sample", "headline"), "_id", "headlines")  # a null has an id too
    told = samples.select("_id", "headline")
    state = samples.select(
        "_id", "sample", F.array().cast(_ASKED).alias("prior"), F.array().cast(_ASKED).alias("asked"), F.array().cast(_ANSWERED).alias("answered"), F.array().cast(_BEST).alias("best"),
        F.lit(0).cast("long").alias("_prompt"), F.lit(0).cast("long").alias("_completion"),
    )
    cost = lambda name: (F.coalesce(F.col(f"{name}_prompt"), F.lit(0)), F.coalesce(F.col(f"{name}_completion"), F.lit(0)))
    base = ["_id", "sample", "prior", "asked", "answered", "best"]
    for chain in range(config.q_chains):
        prompt = F.concat(messages.question_prompt(F.col("headline"), config.q_per_chain, F.col("prior"), F.col("answered")), F.lit(f" Chain {chain}"))
        state = ask_model(told.join(state, "_id").withColumn("_user", prompt).drop("headline"), factory, _QUESTION_PROMPT, "_user", "_q")
        p, c = cost("_q")
        new = _fresh(_items(F.col("_q_raw")), F.col("prior"), config.q_per_chain)
        state = keep(state.select(*base, new.alias("new"), (F.col("_prompt") + p).alias("_prompt"), (F.col("_completion") + c).alias("_completion")))
        grown = {"prior": F.concat("prior", "new"), "asked": F.concat("asked", "new")}
        if not config.modules["question_answering"]:
            state = state.withColumns(grown).drop("new")
            continue
        single = state.select("_id", "sample", F.lit(chain).alias("chain"), F.posexplode("new").alias("pos", "question"))
        found = _answers(single, config, factory, search, keep)
        pairs = found.groupBy("_id").agg(
            F.array_sort(F.collect_list(F.struct("pos", "question", F.col("found.answer").alias("answer"), F.col("found.confidence").alias("confidence"), F.col("found.citations").alias("citations")))).alias("items"),
            F.sum("_a_prompt").alias("_a_prompt"), F.sum("_a_completion").alias("_a_completion"),
        )  # a chain's questions
        state = state.join(pairs, "_id", "left").withColumn("items", F.coalesce("items", F.array()))
        p, c = cost("_a")
        answered = F.concat("answered", F.transform(F.filter("items", lambda q: q["answer"].isNotNull()), lambda q: F.struct(q["question"].alias("question"), q["answer"].alias("answer"))))
        state = state.withColumns(grown | {"answered": answered, "_prompt": F.col("_prompt") + p, "_completion": F.col("_completion") + c}).drop("new", "_a_prompt", "_a_completion")
        top = F.array_max(F.transform("items", lambda q: F.coalesce(q["confidence"], F.lit(0.0))))
        at = F.filter(F.transform("items", lambda q, i: F.when(F.coalesce(q["confidence"], F.lit(0.0)) == top, i + 1)), lambda i: i.isNotNull())[0]
        more = F.array().cast(_ASKED)
        if choose:
            state = told.join(state, "_id").withColumn("_user", messages.selection_prompt(F.col("headline"), F.col("items")))
            state = ask_model(state, factory, _ANSWER_PROMPT, "_user", "_s")
            follow = messages.question_prompt(F.col("headline"), config.followups_per_chain, F.col("prior"), F.array().cast(_ANSWERED))
            state = ask_model(state.withColumn("_user", F.concat(follow, F.lit(f" Follow-ups {chain}"))).drop("headline"), factory, _QUESTION_PROMPT, "_user", "_f")
            at = F.when(F.col("_s_error").isNull(), jsonx.selection_index(F.col("_s_raw"), F.size("items"))).otherwise(at)
            more = _fresh(_items(F.col("_f_raw")), F.col("prior"), config.followups_per_chain)
            (p, c), (q, d) = cost("_s"), cost("_f")
            state = state.withColumns({"_prompt": F.col("_prompt") + p + q, "_completion": F.col("_completion") + c + d})
        pick = F.get("items", at.cast("int") - 1)
        chosen = F.struct(F.lit(chain).alias("chain"), *[pick[n].alias(n) for n in ("pos", "question", "answer", "confidence", "citations")])
        best = F.when(F.size("items") > 0, F.concat("best", F.array(chosen).cast(_BEST))).otherwise(F.col("best"))
        state = keep(state.select("_id", "sample", F.concat("prior", more).alias("prior"), "asked", "answered", best.alias("best"), "_prompt", "_completion"))
    return told.join(state.drop("prior"), "_id")


def investigate(samples: DataFrame, config: RunConfig, factory, search: DataFrame | None = None, keep=written, choose: bool = False) -> DataFrame:
    """The best pair of each chain as rows: sample, chain, pos, question and the answer struct ``found``.

    Without answers: sample, chain (0, all of them), pos and question of everything asked.
    """
    state = chains(samples, config, factory, search, keep, choose)
    if not config.modules["question_answering"]:
        return state.select("sample", F.lit(0).alias("chain"), F.posexplode("asked").alias("pos", "question"))
    one = state.select("sample", F.explode("best").alias("b"))
    return one.select("sample", "b.chain", "b.pos", "b.question", F.struct(F.col("b.answer").alias("answer"), F.col("b.citations").alias("citations"), F.col("b.confidence").alias("confidence")).alias("found"))


def slim_pairs(pairs: Column) -> Column:
    """What a record keeps of its best pairs: no nulls in the list, citations at least empty."""
    citations = F.array().cast("array<struct<url: string, title: string>>")
    slim = lambda q: F.struct(q["question"].alias("question"), q["answer"].alias("answer"), q["confidence"].alias("confidence"), F.coalesce(q["citations"], citations).alias("citations"))
    return F.transform(F.filter(pairs, lambda q: q.isNotNull()), slim)


def sample_details(columns: list[str], index: Column) -> Column:
    """The dataset's fields of a sample, with its place there if they have none; null if there is nothing."""
    known = {n: F.col(n) for n in ("gt_answers", "fake_cls", "text_source", "image_source") if n in columns}
    fields = F.struct(index.alias("dataset_index"), *[known.get(n, F.lit(None).cast("string")).alias(n) for n in ("gt_answers", "fake_cls", "text_source", "image_source")])
    anything = index.isNotNull()
    for c in known.values():
        anything = anything | c.isNotNull()
    return F.when(anything, fields)


def assemble(stages: DataFrame, config: RunConfig) -> DataFrame:
    """Output records, in the form of schemas.OUTPUT, of what the stages gave."""
    modules, columns = config.modules, stages.columns
    answers = modules["question_answering"]
    settings = {
        "q_chains": F.lit(config.q_chains), "q_per_chain": F.lit(config.q_per_chain), "answer_questions": F.lit(answers), "answer_max_sources": F.lit(config.answer_max_sources),
        "temperature": F.lit(float(config.temperature)), "search_provider": F.lit(config.search_provider),
    }
    named = {"provider": F.lit(config.provider), "model": F.lit(config.model).cast("string")}
    run = named | settings | {"questions_enabled": F.lit(modules["questions"])}
    order = "provider model temperature q_chains q_per_chain answer_questions answer_max_sources search_provider questions_enabled".split()
    index = F.col("dataset_index") if "dataset_index" in columns else F.lit(None).cast("long")
    place = F.col("iteration_index") if "iteration_index" in columns else (F.col("sample_index") - 1).cast("long")
    out = stages.select(
        "image_path", "headline", *[c.alias(n) for n, c in named.items()], F.struct(*[c.alias(n) for n, c in settings.items()]).alias("settings"), F.struct(*[run[n].alias(n) for n in order]).alias("run_params"),
        "relevancy", "visual_veracity", slim_pairs(F.col("best_qa")).alias("best_qa_per_chain"), "token_usage", F.struct(*[F.lit(v).alias(k) for k, v in modules.items()]).alias("modules"), "sample_index",
        F.coalesce(index, place).alias("dataset_order_index"), place.alias("iteration_index"), sample_details(columns, index).alias("sample_details"), *(["judgement"] if "judgement" in columns else []),
    )
    return out


def judge(stages: DataFrame, factory, keep=written) -> DataFrame:
    """``stages`` with ``judgement``: the model's where it answers, else the rules'. Costs are added to _prompt and _completion."""
    ruled = labels.heuristic_judgement(F.col("relevancy.aligned"), F.col("relevancy.confidence"), F.col("visual_veracity.ai_generated"), F.col("visual_veracity.confidence"))
    none = lambda kind: F.lit(None).cast(kind)
    stats_kind = "struct<token_count: int, avg_logprob: double, geo_mean_prob: double>"

    def row(j: Column, rationale: Column, raw: Column, stats: Column) -> Column:
        return F.struct(j["label"].alias("label"), j["confidence"].alias("confidence"), labels.clamp(stats["geo_mean_prob"]).alias("logprob_confidence"), rationale.alias("rationale"), j["key_factors"].alias("key_factors"), raw.alias("raw"), stats.alias("logprob_stats"))

    by_rules = row(ruled, none("string"), none("string"), none(stats_kind))
    if factory is None:
        return stages.withColumn("judgement", by_rules)
    record = {"headline": F.col("headline"), "relevancy": F.col("relevancy"), "veracity": F.col("visual_veracity"), "best_qa": F.col("best_qa")}
    asked = keep(ask_model(stages.withColumn("_user", compact_payload(record)), factory, _JUDGE_PROMPT, "_user", "_j").drop("_user"))
    said = judgement(F.col("_j_raw"))
    by_model = row(said, said["rationale"], F.col("_j_raw"), logprob_summary(F.col("_j_logprobs")).cast(stats_kind))
    judged = asked.withColumn("judgement", F.when(F.col("_j_error").isNull() & F.col("_j_raw").isNotNull(), by_model).otherwise(by_rules))
    judged = judged.withColumns({"_prompt": F.col("_prompt") + F.col("_j_prompt"), "_completion": F.col("_completion") + F.col("_j_completion")})
    return judged.drop(*[f"_j_{n}" for n in ("raw", "prompt", "completion", "error", "logprobs")])


#: So many pairs that occur more than once are broadcast (about 100 bytes each); more are joined by a shuffle.
BROADCAST_PAIRS = 250_000


def identified(samples: DataFrame) -> DataFrame:
    """``samples`` with ``_pair``, a digest of headline and image, and ``_id``, the pair with the sample's index."""
    image = F.coalesce(F.concat(F.lit("="), "image_path"), F.lit(""))
    paired = samples.withColumn("_pair", F.sha2(F.concat(F.sha2(F.coalesce("headline", F.lit("")), 256), image), 256))
    return paired.withColumn("_id", F.concat_ws(" ", F.col("sample_index").cast("string"), F.col("_pair")))


def signals(samples: DataFrame, asks: list[tuple], factory, keep=written, image_url: str | None = None, images: DataFrame | None = None) -> DataFrame:
    """(_id, a column for each of ``asks``, _prompt, _completion) of identified ``samples``: what the model says about headline and image, and its cost.

    ``asks`` are (name, prompt, parse). Equal pairs of headline and image are
    asked once; the first sample pays. The image is in the column ``image_url``,
    or in ``images(image_path, image_url)``, which is joined to the different pairs only.
    """
    places = samples.select("_pair", "sample_index").groupBy("_pair").agg(F.min("sample_index").alias("_first"), F.count(F.lit(1)).alias("_n"))
    copies = keep(places.filter("_n > 1").drop("_n"))
    known = F.broadcast(copies) if copies.count() <= BROADCAST_PAIRS else copies
    first = samples.join(known, "_pair", "left").filter("_first IS NULL OR sample_index = _first")
    shown, column = (with_images(first, images), "image_url") if images is not None else (first, image_url)
    asked = shown.select("_pair", F.coalesce("headline", F.lit("")).alias("_user"), *([column] if column else []), F.lit(0).cast("long").alias("_p"), F.lit(0).cast("long").alias("_c"))
    names = [name for name, _, _ in asks]
    for name, prompt, parse in asks:
        asked = ask_model(asked, factory, prompt, "_user", "_r", column)
        asked = asked.withColumns({name: parse(F.when(F.col("_r_error").isNull(), F.col("_r_raw"))), "_p": F.col("_p") + F.col("_r_prompt"), "_c": F.col("_c") + F.col("_r_completion")})
        asked = asked.drop(*[f"_r_{n}" for n in ("raw", "prompt", "completion", "error", "logprobs")])
    answers = keep(asked.select("_pair", *names, "_p", "_c")).dropDuplicates(["_pair"])  # rows that repeat an index with its pair are both asked
    each = samples.select("_id", "_pair", "sample_index").distinct().join(known, "_pair", "left").join(answers, "_pair")
    paid = lambda c: F.when(F.col("sample_index") != F.col("_first"), 0).otherwise(F.col(c)).cast("long")
    return each.select("_id", *names, paid("_p").alias("_prompt"), paid("_c").alias("_completion"))


def run_offline(samples: DataFrame, config: RunConfig, factory=None, search=None, keep=written, image_url: str | None = None, images: DataFrame | None = None) -> DataFrame:
    """Output records of ``samples(sample_index, image_path, headline, ...)`` through the stages that ``config`` switches on.

    With ``factory`` a model client gives the signals, asks, answers and judges;
    without one signals are missing, there are no questions, and rules judge.
    ``image_url`` names the column that holds what the client is shown, or
    ``images(image_path, image_url)`` is a table of it; ``search`` is as in
    ``chains``. A sample's index must be its own.
    """
    modules, samples = config.modules, identified(samples)
    stages = (("relevancy", _RELEVANCY_PROMPT, relevancy), ("visual_veracity", _VERACITY_PROMPT, veracity))
    asks = [s for s in stages if factory and modules[s[0]]]
    if asks:
        state = signals(samples, asks, factory, keep, image_url, images)
    else:
        state = samples.select("_id", *[F.lit(0).cast("long").alias(c) for c in ("_prompt", "_completion")]).distinct()
    state = state.withColumns({name: parse(F.lit(None).cast("string")) for name, _, parse in stages if name not in [a[0] for a in asks]})
    texts = samples.select("_id", F.col("sample_index").alias("sample"), "headline")
    if factory and (modules["questions"] or modules["judge"]) and not samples.groupBy("_id").count().filter("count > 1").isEmpty():
        texts = texts.dropDuplicates(["_id"])
    if factory and modules["questions"]:
        state, texts = keep(state), dealt(texts, "_id", "headlines")
        found = chains(texts.withColumn("headline", F.coalesce("headline", F.lit(""))), config, factory, search, keep)
        found = found.select("_id", F.col("best").alias("best_qa"), F.col("_prompt").alias("_qp"), F.col("_completion").alias("_qc"))
        state = state.join(found, "_id").withColumns({"_prompt": F.col("_prompt") + F.col("_qp"), "_completion": F.col("_completion") + F.col("_qc")}).drop("_qp", "_qc")
    else:
        state = state.withColumn("best_qa", F.array().cast(_BEST))
    if modules["judge"] and factory:
        state = judge(texts.drop("sample").join(state, "_id"), factory, lambda df: keep(df.drop("headline")))
    elif modules["judge"]:
        state = judge(state, None)
    usage = F.struct(F.col("_prompt").alias("prompt"), F.col("_completion").alias("completion"), (F.col("_prompt") + F.col("_completion")).alias("total"))
    return assemble(samples.drop("_pair").join(state, "_id").withColumn("token_usage", usage), config)
