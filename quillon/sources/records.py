"""Scans of JSON datasets and JSONL outputs, and other file sources."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions.text import data_url, mime_type
from quillon.sources.schemas import OUTPUT

# Keys under which a dataset object may hold its records, in the order they are tried.
CONTAINER_KEYS = ("data", "items", "records", "samples")


def _outside(stripped: Column, inside: int) -> Column:
    """What of a piece without escapes is outside of strings, if it starts outside (0) or inside (1) of one."""
    return F.array_join(F.filter(F.split(stripped, '"'), lambda _, i: i % 2 == inside), " ")


def _count(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _lists(pieces: DataFrame) -> DataFrame:
    """Where lists of a document's top level open and close: file, block, id, kind, key, offset and depth of its elements.

    ``pieces`` has (file, block, id, text, inside, depth), few: those that touch the top level.
    """
    token = re.compile(r'"(?:[^"\\]|\\.)*"?|[\[\]{}:]', re.DOTALL)
    schema = "file string, block long, id long, kind string, key string, offset int, base int"

    def walk(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            found = []
            for file, block, at, text, inside, depth in batch.itertuples(index=False):
                begin = re.match(r'(?:[^"\\]|\\.)*"', text, re.DOTALL) if inside else None
                start = begin.end() if begin else len(text) if inside else 0
                last, key, top = "}" + text[: start - 1] if begin else None, None, "{" if depth else None
                for t in token.finditer(text, start):
                    c = t.group()
                    if c[0] == '"':
                        last = c[1:-1]
                    elif c == ":":
                        key = last if depth == 1 else key
                    elif c in "[{":
                        top = c if depth == 0 else top
                        if c == "[" and (depth == 0 or (depth == 1 and top == "{" and key is not None)):
                            found.append((file, block, at, "open", key if depth else None, t.end(), depth + 1))
                        depth, key = depth + 1, None if depth else key
                    else:
                        depth -= 1
                        if c == "]" and depth <= 1:
                            found.append((file, block, at, "close", None, t.start(), depth + 1))
            yield pd.DataFrame(found, columns=[c.split()[0] for c in schema.split(", ")])

    return pieces.select("file", "block", "id", "text", "inside", "depth").mapInPandas(walk, schema)


def scan_dataset(spark: SparkSession, path: str) -> DataFrame:
    """(dataset_index, record VARIANT) of JSON files in any of the known shapes.

    A file is a list, or an object that holds a list under one of CONTAINER_KEYS
    or, failing that, under any key (the first). Elements that are no objects are
    dropped before they are numbered. Another shape, and broken JSON, raises.

    One JSON value may be larger than a task can hold, so a file is read by byte
    ranges: its text in pieces that end at closing braces. A piece cannot know if
    it starts inside a string, so its brackets are counted for both cases; prefix
    sums over a range's pieces, and over the ranges, tell which case holds and how
    deep each piece starts. Where a piece's brace brings the depth back to that of
    the list, an element ends; elements are numbered across ranges by the same
    sums, and only a record's own pieces come together.
    """
    read = spark.read.option("lineSep", "}").text(path)
    meta = F.col("_metadata")
    # the pieces of a block are read in order by one task
    raw = read.select(meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), meta["file_size"].alias("bytes"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("text"))
    plain = raw.withColumn("_plain", F.regexp_replace("text", r"(?s)\\.", ""))
    deep = lambda inside: _count(_outside(F.col("_plain"), inside), "[{") - _count(_outside(F.col("_plain"), inside), "]")  # noqa: E731  # without the piece's own brace
    counted = plain.withColumns({"quotes": _count(F.col("_plain"), '"') % 2, "deep0": deep(0), "deep1": deep(1), "close0": _count(_outside(F.col("_plain"), 0), "]"), "close1": _count(_outside(F.col("_plain"), 1), "]")}).drop("_plain")
    before, block = Window.unboundedPreceding, Window.partitionBy("file", "block").orderBy("id")
    earlier = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(before, -1)), F.lit(0))
    # the brace at a piece's end counts if the piece ends outside of a string
    turn = lambda start: F.when(start == 0, F.col("deep0") - F.when(F.col("quotes") == 0, 1).otherwise(0)).otherwise(F.col("deep1") - F.when(F.col("quotes") == 1, 1).otherwise(0))
    local = counted.withColumn("flips", earlier("quotes", block) % 2)
    local = local.withColumns({"turn0": turn(F.col("flips")), "turn1": turn((F.col("flips") + 1) % 2)})
    local = local.withColumns({"down0": earlier("turn0", block), "down1": earlier("turn1", block)})
    blocks = local.groupBy("file", "block").agg(F.sum("quotes").alias("q"), F.sum("turn0").alias("t0"), F.sum("turn1").alias("t1"), F.sum(F.octet_length("text") + 1).alias("read"), F.max("bytes").alias("bytes"))
    files = Window.partitionBy("file").orderBy("block")  # a row for each block
    states = blocks.withColumn("start", earlier("q", files) % 2)
    states = states.withColumn("turn", F.when(F.col("start") == 0, F.col("t0")).otherwise(F.col("t1"))).withColumn("above", earlier("turn", files))
    starts = states.select("file", "block", "start", "above")
    placed = local.join(starts, ["file", "block"])
    placed = placed.withColumns({"inside": (F.col("flips") + F.col("start")) % 2, "depth": F.col("above") + F.when(F.col("start") == 0, F.col("down0")).otherwise(F.col("down1"))})
    closing = F.when(F.col("inside") == 0, F.col("close0")).otherwise(F.col("close1"))
    events = _lists(placed.filter(F.col("depth") - closing <= 1))
    place = F.struct("block", "id", "offset")
    rank = F.coalesce(F.array_position(F.lit(list(CONTAINER_KEYS)), F.col("key")), F.lit(0))
    opened = events.filter("kind = 'open'").groupBy("file").agg(F.min(F.struct(F.when((F.col("base") == 2) & (rank == 0), len(CONTAINER_KEYS) + 1).otherwise(rank).alias("rank"), place.alias("from"), "base")).alias("list"))
    opened = opened.select("file", "list.from", "list.base")
    closed = events.filter("kind = 'close'").select("file", "base", place.alias("to")).join(opened, ["file", "base"]).filter(F.col("to") >= F.col("from")).groupBy("file").agg(F.min("to").alias("to"))
    # a text of n bytes has n bytes in its pieces and their braces; without a brace at the end it is one less
    ends = states.groupBy("file").agg(F.sum("turn").alias("turn"), (F.sum("read") - F.max("bytes")).alias("missing"), (F.sum("q") % 2).alias("open_string"))
    known = ends.join(opened.join(closed, "file", "left"), "file", "left")
    whole = F.col("from").isNotNull() & F.col("to").isNotNull() & (F.col("open_string") == 0) & (F.col("turn") + F.col("missing") == 0)
    known = known.filter(whole | F.raise_error(F.concat(F.lit("unsupported JSON structure in "), F.col("file"))).cast("boolean")).select("file", "from", "to", "base")
    held = placed.join(known, "file").filter((F.struct("block", "id") >= F.struct("from.block", "from.id")) & (F.struct("block", "id") < F.struct("to.block", "to.id")))
    after = F.col("depth") + turn(F.col("inside"))
    is_end = (after == F.col("base")) & ((F.col("inside") + F.col("quotes")) % 2 == 0)
    first = (F.col("block") == F.col("from.block")) & (F.col("id") == F.col("from.id"))
    cut = held.select("file", "block", "id", is_end.cast("long").alias("ends"), F.when(first, F.substr("text", F.col("from.offset") + 1)).otherwise(F.col("text")).alias("text"))
    cut = cut.withColumn("_done", earlier("ends", block))
    done = cut.groupBy("file", "block").agg(F.sum("ends").alias("_n")).select("file", "block", earlier("_n", files).alias("_shift"))
    numbered = cut.join(done, ["file", "block"]).withColumn("dataset_index", F.col("_done") + F.col("_shift"))
    parts = numbered.groupBy("file", "dataset_index").agg(F.array_sort(F.collect_list(F.struct("block", "id", "text"))).alias("p"), F.max("ends").alias("ends")).filter("ends = 1")  # of one record
    text = F.concat(F.lit("["), F.regexp_replace(F.array_join(F.transform("p", lambda x: x["text"]), "}"), r"^\s*,", ""), F.lit("}]"))
    # elements that are no objects stand before the object
    record = F.element_at(F.try_variant_get(F.try_parse_json(text), "$", "array<variant>"), -1)
    record = F.coalesce(record, F.raise_error(F.concat(F.lit("unsupported JSON structure in "), F.col("file"))).cast("variant"))
    return parts.select("dataset_index", record.alias("record"))


def project_records(raw: DataFrame, names: dict[str, str] | None = None, required: str = "image_path") -> DataFrame:
    """Typed records of ``scan_dataset``; ``names`` renames fields, rows without the required one go."""
    names = {f: f for f in ("text", "image_path", "text_source", "image_source", "gt_answers", "fake_cls")} | (names or {})
    columns = [F.try_variant_get("record", f"$.{source}", "string").alias(field) for field, source in names.items()]
    return raw.select(F.col("dataset_index").cast("long").alias("dataset_index"), *columns).filter(F.col(required).isNotNull())


def scan_jsonl(spark: SparkSession, path: str, schema: str = OUTPUT, mode: str = "lenient") -> DataFrame:
    """JSON lines: ``lenient`` drops bad lines, ``strict`` raises, ``ledger`` keeps them in ``_corrupt``."""
    reader = spark.read.schema(schema if mode != "ledger" else f"{schema}, _corrupt string")
    if mode == "strict":
        return reader.option("mode", "FAILFAST").json(path)
    if mode == "ledger":
        return reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return reader.option("mode", "DROPMALFORMED").json(path)


def scan_values(spark: SparkSession, path: str) -> DataFrame:
    """(value VARIANT) of all JSON lines, objects or not; lines that are no JSON, and blank ones, go."""
    return spark.read.text(path).select(F.try_parse_json("value").alias("value")).filter("value IS NOT NULL")


def corruption_ledger(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, reason) of lines that hold no JSON object; blank lines are none.

    Rows are numbered within their task, and a task's rows are shifted by the
    number of lines in those before it: one small aggregation, no Python.
    """
    tagged = spark.read.text(path).withColumn("_id", F.monotonically_increasing_id())
    tagged = tagged.withColumn("_task", F.shiftright("_id", 33))
    sizes = tagged.groupBy("_task").agg(F.count(F.lit(1)).alias("_n"))  # a row for each task
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = sizes.select("_task", before.alias("_shift"))
    lines = tagged.join(F.broadcast(shifts), "_task").withColumn("line_no", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_shift") + 1)
    bad = (F.trim("value") != "") & ~F.coalesce(F.schema_of_variant(F.try_parse_json("value")).startswith("OBJECT"), F.lit(False))
    return lines.filter(bad).select("line_no", F.lit("json_decode_error").alias("reason"))


def check_sequence(outputs: DataFrame) -> DataFrame:
    """``outputs`` unchanged; reading a row raises if iteration_index does not count 0, 1, 2 ... or sample_index is not one more."""
    from quillon.operators.ordered import numbered

    placed = numbered(outputs, "iteration_index", "_place")
    fits = (F.col("iteration_index") == F.col("_place")) & (F.col("sample_index") == F.col("iteration_index") + 1)
    return placed.filter(F.coalesce(fits, F.lit(False)) | F.raise_error(F.lit("outputs are not sequential")).cast("boolean")).select(*outputs.columns)


def scan_images(spark: SparkSession, path: str, with_content: bool = True) -> DataFrame:
    """(path, data_url) of image files; without content just the paths."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    plain = F.regexp_replace("path", "^file:/*", "/").alias("path")
    return files.select(plain, data_url(F.col("content"), mime_type(F.col("path"))).alias("data_url")) if with_content else files.select(plain)


def existing(records: DataFrame, files: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """Records whose image is among ``files(path)``, with ``path`` resolved, and the count of the others.

    A path that looks absolute counts as below ``root`` if it exists there.
    """
    below = F.concat(F.lit(root.rstrip("/") + "/"), F.regexp_replace("image_path", "^/+", ""))
    spelled = records.withColumn("_spellings", F.array_distinct(F.when(F.col("image_path").startswith("/"), F.array(below, F.col("image_path"))).otherwise(F.array(below))))
    probes = spelled.select("dataset_index", F.posexplode("_spellings").alias("_at", "path")).join(files.select("path"), "path")
    found = probes.groupBy("dataset_index").agg(F.min_by("path", "_at").alias("path"))
    return records.join(found, "dataset_index"), records.join(found, "dataset_index", "left_anti").agg(F.count(F.lit(1)).alias("missing"))


def single_pair(spark: SparkSession, image: str, headline: str) -> DataFrame:
    """An ad-hoc source of one claim."""
    return spark.createDataFrame([(0, image, headline)], "dataset_index long, image_path string, text string")


def run_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, stem) of the JSONL files in a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl").load(folder).select("path")
    return files.withColumn("stem", F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"\..*", ""))
