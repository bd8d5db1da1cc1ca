"""Text, path, hash, search-row and media helpers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Media types by suffix.
MIME_TYPES = {".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png", ".webp": "image/webp", ".gif": "image/gif", ".bmp": "image/bmp"}
#: Parameters that belong to a search's identity, in this order.
# The parameters of a search that are part of its identity.
SEARCH_PARAMETERS = ("region", "safesearch", "timelimit", "max_results", "page", "backend", "proxy", "timeout")


def collapse_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def shorten(text: Column, limit: int) -> Column:
    """At most ``limit`` characters, the last three being dots where something was cut."""
    return F.when(F.char_length(text) > limit, F.concat(F.left(text, F.lit(limit - 3)), F.lit("..."))).otherwise(text)


def preview(text: Column, limit: int) -> Column:
    """The first ``limit`` characters and always dots."""
    return F.concat(F.left(text, F.lit(limit)), F.lit("..."))


def first_non_empty(*candidates: Column) -> Column:
    return F.coalesce(*[F.nullif(F.trim(c.cast("string")), F.lit("")) for c in candidates], F.lit(""))


def bullet_lines(text: Column) -> Column:
    """Lines without list marks, those of one or two characters dropped."""
    lines = F.transform(F.split(text, r"\r\n|\n|\r"), lambda line: F.btrim(line, F.lit(" -•\t")))
    return F.filter(lines, lambda line: F.char_length(line) > 2)


def html_escape(value: Column) -> Column:
    out = F.coalesce(value.cast("string"), F.lit(""))
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def observation(raw: Column) -> Column:
    """The text between ``Observation:`` and the next ``Action``; null without one."""
    after = F.try_element_at(F.split(raw, "Observation:"), F.lit(2))
    return F.trim(F.split(after, "Action")[0])


def mime_type(path: Column, default: str = "image/png") -> Column:
    suffix = F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))
    table = F.create_map(*[F.lit(x) for pair in MIME_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, suffix), F.lit(default))


def data_url(content: Column, mime: Column) -> Column:
    """On one line: Spark breaks base64 every 76 characters."""
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.translate(F.base64(content), "\r\n", ""))


def parse_data_url(url: Column) -> Column:
    """struct(mime, content) of a data url, with or without line breaks in its base64; null for other text."""
    pattern = r"(?s)^data:([^;,]*);base64,(.*)$"
    parsed = F.struct(F.regexp_extract(url, pattern, 1).alias("mime"), F.unbase64(F.regexp_extract(url, pattern, 2)).alias("content"))
    return F.when(url.rlike(pattern), parsed)


# ---- paths -------------------------------------------------------------------


def normal_path(path: Column) -> Column:
    """``.`` and ``..`` resolved in an absolute path of forward slashes; links are not followed."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    empty = F.array().cast("array<string>")
    walk = F.aggregate(parts, empty, lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, p)))
    return F.concat(F.lit("/"), F.array_join(walk, "/"))


def record_path(path: Column, root: str | None) -> Column:
    """The normal form of a record's path under an absolute root; null if empty."""
    if root is None:
        return F.when(path != "", normal_path(path))
    stripped = F.regexp_replace(path, r"^[/\\]+", "")
    return F.when(path != "", normal_path(F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(root + "/"), stripped))))


def relative_path(path: Column, root: str) -> Column:
    """The path below ``root``, else with forward slashes and without leading ones."""
    prefix = root.rstrip("/") + "/"
    return F.when(path.startswith(prefix), F.substring(path, len(prefix) + 1, 1 << 20)).otherwise(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^/+", ""))


def path_candidates(path: Column, root: str) -> Column:
    """The spellings under which a path may be known, best first, without repeats."""
    rel = relative_path(path, root)
    below = normal_path(F.concat(F.lit(root + "/"), F.regexp_replace(path, "^/+", "")))
    first = F.when(path.startswith("/"), F.array(normal_path(path), below)).otherwise(F.array(normal_path(F.concat(F.lit(root + "/"), path))))
    return F.array_distinct(F.concat(first, F.array(rel, relative_path(F.concat(F.lit("/"), rel), root))))


def unsafe_member(name: Column) -> Column:
    """Whether an archive member's name leaves the folder it is unpacked in."""
    return name.startswith("/") | F.array_contains(F.split(name, "/"), "..")


# ---- identities --------------------------------------------------------------


def job_id(query: Column) -> Column:
    return F.left(F.sha1(F.trim(query)), F.lit(16))


def search_key(query: Column, parameters: Column | None = None) -> Column:
    """Identity of a search: its words in lower case and the known parameters that are set."""
    parts = [F.lower(collapse_spaces(query))]
    if parameters is not None:
        parts += [F.concat(F.lit(f"{p}="), F.try_element_at(parameters, F.lit(p))) for p in SEARCH_PARAMETERS]
    return F.sha2(F.concat_ws("|", *parts), 256)


def checkpoint_name(run_id: Column, count: Column) -> Column:
    return F.format_string("%s.upto%05d.json", run_id, count)


def resume_hint(path: Column) -> Column:
    """The option that goes on from a checkpoint; empty without one."""
    return F.coalesce(F.concat(F.lit("--resume "), F.nullif(path, F.lit(""))), F.lit(""))


def jittered(interval: Column, share: float, draw: Column) -> Column:
    """An interval moved by up to ``share`` of it either way, by a draw from [0, 1)."""
    return F.greatest(F.lit(0.0), interval * (1 + share * (2 * draw - 1)))


def path_from(folder: Column, path: Column) -> Column:
    """``path`` as seen from ``folder``, both absolute and normal: up from what they do not share, then down."""
    a, b = (F.filter(F.split(p, "/"), lambda x: x != "") for p in (folder, path))
    both = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    shared = F.coalesce(F.array_position(both, F.lit(False)) - 1, F.lit(0)).cast("int")
    shared = F.when(F.array_position(both, F.lit(False)) == 0, F.size(both)).otherwise(shared)
    up = F.array_repeat(F.lit(".."), F.size(a) - shared)
    found = F.array_join(F.concat(up, F.slice(b, shared + 1, F.size(b))), "/")
    return F.when(found == "", ".").otherwise(found)


def backoff(attempt: Column, base: float, factor: float, most: float = 30.0) -> Column:
    """Seconds to wait before the next attempt."""
    return F.least(F.lit(most), base * F.pow(F.lit(factor), F.greatest(F.lit(0), attempt - 1)))


def reset_time(epoch_ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(epoch_ms), "yyyy-MM-dd HH:mm:ss 'UTC'")


def run_name(started: Column) -> Column:
    return F.date_format(started, "yyyyMMdd-HHmmss")


def utc_text(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def seconds_between(start: Column, stop: Column) -> Column:
    return F.round((F.unix_micros(stop) - F.unix_micros(start)) / 1e6, 3)


def key_values(mapping: Column) -> Column:
    return F.array_join(F.transform(F.map_entries(mapping), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), ", ")


def without_nulls(mapping: Column) -> Column:
    return F.map_filter(mapping, lambda _, v: v.isNotNull())


# ---- search rows -------------------------------------------------------------


def search_row(item: Column, names: set[str]) -> Column:
    """title, url, description, source of a raw result with the usual alias names; the host may be nested in meta_url."""
    pick = lambda *keys: first_non_empty(*[item[k] for k in keys if k in names], *([item["meta_url"]["host"]] if "source" in keys and "meta_url" in names else []))
    return F.struct(
        pick("title").alias("title"), pick("url", "href").alias("url"), pick("description", "snippet", "body").alias("description"), pick("source", "host").alias("source")
    )


def search_rows(items: Column, names: set[str]) -> Column:
    """All results that have a url, in the common form."""
    return F.filter(F.transform(items, lambda i: search_row(i, names)), lambda r: r["url"] != "")


def payload_rows(results: Column, names: set[str], legacy: Column, legacy_names: set[str]) -> Column:
    """The payload's own results, or those of an older form where there are none."""
    own = search_rows(results, names)
    return F.when(F.size(own) > 0, own).otherwise(F.coalesce(search_rows(legacy, legacy_names), F.filter(own, lambda _: F.lit(False))))


def knowledge(results: Column, most: int = 3) -> Column:
    """``title: description`` of the first results that have a description."""
    named = F.filter(F.slice(results, 1, most), lambda r: F.coalesce(r["description"], F.lit("")) != "")
    text = F.array_join(F.transform(named, lambda r: F.concat_ws(": ", F.coalesce(r["title"], F.lit("")), r["description"])), "\n")
    return F.coalesce(F.nullif(text, F.lit("")), F.lit("No external knowledge available."))
