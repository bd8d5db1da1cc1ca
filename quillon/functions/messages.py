"""Chat messages and prompts, as column expressions.

A message is struct(role, content), its content an array of parts
struct(type, text, image_url).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.text import collapse_spaces, preview, shorten

PARTS = "array<struct<type: string, text: string, image_url: string>>"


def text_part(text: Column) -> Column:
    return F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("image_url"))


def image_part(url: Column) -> Column:
    return F.struct(F.lit("image_url").alias("type"), F.lit(None).cast("string").alias("text"), url.alias("image_url"))


def message(role: str, *parts: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), F.array(*parts).alias("content"))


def parse_content(raw: Column) -> Column:
    """Parts of a content that is plain text or a JSON array of parts; an image's url may be nested."""
    parsed = F.try_parse_json(raw)
    listed = F.when(F.schema_of_variant(parsed).startswith("ARRAY"), F.try_variant_get(parsed, "$", "array<variant>"))
    get = lambda v, path: F.try_variant_get(v, path, "string")
    part = lambda v: F.struct(get(v, "$.type").alias("type"), get(v, "$.text").alias("text"), F.coalesce(get(v, "$.image_url.url"), get(v, "$.image_url")).alias("image_url"))
    return F.coalesce(F.transform(listed, part), F.array(text_part(raw)))


def text_only(messages: Column) -> Column:
    """Whether no message has an image; only then can token probabilities be asked for."""
    return F.forall(messages, lambda m: F.forall(m["content"], lambda p: p["type"] == "text"))


def joined_text(content: Column) -> Column:
    return F.array_join(F.transform(F.filter(content, lambda p: p["type"] == "text"), lambda p: p["text"]), "\n")


def system_prompt(messages: Column) -> Column:
    """The text of the first system message; null without one."""
    return F.try_element_at(F.transform(F.filter(messages, lambda m: m["role"] == "system"), lambda m: joined_text(m["content"])), F.lit(1))


def without_system(messages: Column) -> Column:
    return F.filter(messages, lambda m: m["role"] != "system")


def fill(template: str, **values: Column) -> Column:
    """A template's {names} replaced by columns, in one pass: values are not looked through again."""
    parts, rest = [], template
    while rest:
        before, brace, after = rest.partition("{")
        if before:
            parts.append(F.lit(before))
        if not brace:
            break
        name, _, rest = after.partition("}")
        parts.append(F.coalesce(values[name].cast("string"), F.lit("")))
    return F.concat(*parts)


def question_prompt(headline: Column, k: int, prior: Column, answered: Column) -> Column:
    """Asks for ``k`` new questions: earlier questions are listed, and the last three answers.

    ``prior`` is an array of questions, ``answered`` one of struct(question, answer).
    """
    seen = F.when(F.size(prior) > 0, F.concat(F.lit("Already asked:\n- "), F.array_join(prior, "\n- "), F.lit("\n"))).otherwise("")
    last = F.slice(answered, F.greatest(F.size(answered) - 2, F.lit(1)), 3)
    known = F.array_join(F.transform(last, lambda a: F.concat(F.lit("Q: "), a["question"], F.lit("\nA: "), preview(shorten(collapse_spaces(a["answer"]), 220), 150))), "\n")
    told = F.when(F.size(answered) > 0, F.concat(F.lit("Known so far:\n"), known, F.lit("\n"))).otherwise("")
    return fill("Headline: {headline}\n{seen}{told}Ask {k} short questions that would help to verify it. Answer with a JSON array of strings.", headline=headline, seen=seen, told=told, k=F.lit(k))


def answer_prompt(question: Column, sources: Column, most: int) -> Column:
    """Asks to answer from the first ``most`` sources (struct(title, url, description))."""
    first = F.slice(sources, 1, max(1, most))
    lines = F.array_join(F.transform(first, lambda s: F.concat_ws(" | ", s["title"], s["url"], s["description"])), "\n")
    return fill("Question: {question}\nSources:\n{lines}\nAnswer with one JSON object with answer, confidence, citations and rationale.", question=question, lines=lines)


def selection_prompt(headline: Column, items: Column) -> Column:
    """Asks for the index of the most useful of ``items`` (struct(question, answer))."""
    lines = F.array_join(F.transform(items, lambda q, i: F.concat((i + 1).cast("string"), F.lit(". "), q["question"], F.lit(" -> "), F.coalesce(q["answer"], F.lit("no answer")))), "\n")
    return fill("Headline: {headline}\n{lines}\nAnswer with one JSON object with index and reason.", headline=headline, lines=lines)
