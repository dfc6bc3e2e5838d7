"""Result documents of any size: written in ordered lines, read in byte ranges.

A document is one JSON object per run with the run's samples in the array
``sample_results``. As a value it would have to fit one task; here it never is one.

**Writing.** Head, one line per sample and tail are rows with a number. Rows are
dealt by range of run and number, so the part files of a run's folder, in the
order of their names, are the document.

**Reading.** Files are cut at every closing brace, which Spark's line reader
does from any byte on, so one long line is read by many tasks. For each piece,
quotes and brackets are counted for both cases, that it begins inside a string
or not. Sums by byte range, then running sums inside each range, tell the string
state and the depth at every piece: that is the index of the document. Pieces
between the opening and the closing bracket of the samples are put together
sample by sample; what remains is the document without its samples.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions import jsontext
from plumbline.operators.ordinals import with_position
from plumbline.session import shared_path

# Fixed value: the key of the samples in a document.
SAMPLES = "sample_results"

_OPENING = rf'"{SAMPLES}"\s*:\s*\['


# --- writing --------------------------------------------------------------------


def document_lines(summaries: DataFrame, exported: DataFrame, keys: Sequence[str], order: str = "id") -> DataFrame:
    """Lines of the documents of all runs: ``keys``, ``line_no``, ``line``.

    ``summaries`` has one row per run: ``keys`` and the fields of the document's
    head. ``exported`` has ``keys``, ``order`` (unique within a run) and the JSON
    objects of ``export_sample``. Samples of runs without a summary are left
    out; a run without samples has an empty array. Both tables are stored, so that numbering
    and dealing, which pass over the samples several times, do not score them again.
    """
    keys = list(keys)
    summaries = _stored(summaries, "document-heads")
    fields = [c for c in summaries.columns if c not in keys or c == "model"]
    head = F.regexp_replace(F.to_json(F.struct(*fields)), r"\}\z", f',"{SAMPLES}":[')
    known = exported.join(summaries.select(*keys), keys, "left_semi").select(*keys, order, "exported")
    placed = with_position(_stored(known, "document-exports"), keys, order, "_place")
    sample = F.when(F.col("_place") == 0, F.col("exported")).otherwise(F.concat(F.lit(","), "exported"))
    return (
        summaries.select(*keys, F.lit(0).cast("bigint").alias("line_no"), head.alias("line"))
        .unionByName(placed.select(*keys, (F.col("_place") + 1).alias("line_no"), sample.alias("line")))
        .unionByName(summaries.select(*keys, F.lit(2**63 - 1).alias("line_no"), F.lit("]}").alias("line")))
    )


def write_documents(lines: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Write ``document_lines``, one folder per run, its parts in the order of their names."""
    order = [*keys, "line_no"]
    dealt = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt.select(*keys, "line").write.partitionBy(*keys).text(path)


# --- reading --------------------------------------------------------------------


def _count(text: Column, signs: str) -> Column:
    """How often ASCII signs occur: what a text loses without them."""
    without = reduce(lambda t, sign: F.replace(t, F.lit(sign), F.lit("")), signs, text)
    return (F.octet_length(text) - F.octet_length(without)).cast("bigint")


def _unescaped(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("\\")), F.regexp_replace(text, r"(?s)\\.", "__")).otherwise(text)


def _rise(text: Column, inside: bool) -> Column:
    """Opened less closed brackets of an unescaped text that begins outside or inside a string."""
    begun = F.regexp_replace(text, r'\A[^"]*("|\z)', "") if inside else text
    bare = F.regexp_replace(begun, r'"[^"]*("|\z)', "")
    return _count(bare, "[{") - _count(bare, "]}")


def _pieces(spark: SparkSession, paths: Sequence[str], parts: bool) -> DataFrame:
    """Pieces between closing braces: document, file, byte range, number, text and counts."""
    texts = spark.read.option("lineSep", "}").option("recursiveFileLookup", "true").text(list(paths))
    file = F.col("_metadata.file_path")
    # Part numbers have five digits, or more where there are more parts.
    folder, name = F.regexp_extract(file, r"^(.*)/", 1), F.substring_index(file, "/", -1)
    digits = F.length(F.regexp_extract(name, r"^part-(\d+)", 1))
    return texts.select(
        (folder if parts else file).alias("doc"),
        F.struct(digits.alias("digits"), name.alias("name")).alias("part"),
        F.col("_metadata.file_size").alias("file_size"),
        F.col("_metadata.file_block_start").alias("range"),
        F.monotonically_increasing_id().alias("no"),
        "value",
        _unescaped(F.col("value")).alias("plain"),
    ).select(
        "*",
        _count(F.col("plain"), '"').alias("quotes"),
        _rise(F.col("plain"), False).alias("rise_outside"),
        _rise(F.col("plain"), True).alias("rise_inside"),
    )


def _stored(table: DataFrame, label: str) -> DataFrame:
    path = shared_path(table.sparkSession, label)
    table.write.parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


def _rise_from(state: Column) -> Column:
    """Change of depth over a piece and its closing brace, from a string state (0: outside)."""
    closes = F.when((state + F.col("quotes")) % 2 == 0, 1).otherwise(0)
    return F.when(state == 0, F.col("rise_outside")).otherwise(F.col("rise_inside")) - closes


def _ranges(pieces: DataFrame) -> DataFrame:
    """What each byte range begins with: string state and depth; whether its last piece has no brace.

    ``pieces`` have ``odd``, the quotes before them in their range.
    """
    sums = pieces.groupBy("doc", "part", "file_size", "range").agg(
        F.sum("quotes").alias("quotes"),
        F.sum(_rise_from(F.col("odd") % 2)).alias("outside"),
        F.sum(_rise_from((F.col("odd") + 1) % 2)).alias("inside"),
        F.sum(F.octet_length("value") + 1).alias("bytes"),
    )
    earlier = Window.partitionBy("doc").orderBy("part", "range").rowsBetween(Window.unboundedPreceding, -1)
    file = Window.partitionBy("doc", "part")
    # The last piece of a file ends with a brace unless one byte is missing.
    cut_off = (F.sum("bytes").over(file) == F.col("file_size") + 1) & (F.max("range").over(file) == F.col("range"))
    state = F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2
    known = sums.select("*", state.alias("state"), cut_off.alias("cut_off"))
    rise = F.when(F.col("state") == 0, F.col("outside")).otherwise(F.col("inside"))
    unclosed = F.when(F.col("cut_off") & ((F.col("state") + F.col("quotes")) % 2 == 0), 1).otherwise(0)
    risen = known.withColumn("rise", rise + unclosed)
    depth = F.coalesce(F.sum("rise").over(earlier), F.lit(0)).alias("depth")
    return risen.select(F.col("doc").alias("_doc"), F.col("part").alias("_part"), F.col("range").alias("_range"), "state", "cut_off", depth)


def _indexed(pieces: DataFrame) -> DataFrame:
    """Pieces with the string state, the depth before and after, and samples that ended before."""
    place = Window.partitionBy("doc", "part", "range").orderBy("no")
    before = place.rowsBetween(Window.unboundedPreceding, -1)
    counted = pieces.withColumns(
        {"odd": F.coalesce(F.sum("quotes").over(before), F.lit(0)), "last": F.lead("no").over(place).isNull()}
    )
    same = (F.col("doc") == F.col("_doc")) & (F.col("part") == F.col("_part")) & (F.col("range") == F.col("_range"))
    begun = counted.join(_ranges(counted), same).drop("_doc", "_part", "_range")
    state = (F.col("state") + F.col("odd")) % 2
    closed = ~(F.col("cut_off") & F.col("last"))
    told = begun.withColumns({"string": state, "closed": closed}).withColumn(
        "rise",
        _rise_from(F.col("string"))
        + F.when(~F.col("closed") & ((F.col("string") + F.col("quotes")) % 2 == 0), 1).otherwise(0),
    )
    risen = told.withColumn("at", F.col("depth") + F.coalesce(F.sum("rise").over(before), F.lit(0)))
    after = F.col("at") + F.col("rise")
    outside = (F.col("string") + F.col("quotes")) % 2 == 0
    ended = risen.withColumn("ends", (F.col("closed") & outside & (after == 2)).cast("int"))
    return ended.select(
        "doc",
        "part",
        "range",
        "no",
        "value",
        "closed",
        "string",
        "at",
        "ends",
        F.coalesce(F.sum("ends").over(before), F.lit(0)).alias("ended"),
        _opens_samples().alias("opens"),
        ((F.col("string") == 0) & (F.col("at") == 2) & F.rlike("value", F.lit(r"\A\s*\]"))).alias("closes"),
    )


def _opens_samples() -> Column:
    """Whether the samples begin in a piece: their key at the depth of the document."""
    head = _unescaped(F.regexp_extract("value", rf"(?s)\A(.*?){_OPENING}", 1))
    rise = F.when(F.col("string") == 0, _rise(head, False)).otherwise(_rise(head, True))
    outside = (F.col("string") + _count(head, '"')) % 2 == 0
    found = F.rlike("value", F.lit(_OPENING))
    return F.when(found, outside & (F.col("at") + rise == 1)).otherwise(False)


_PLACE = ("part", "range", "no")


def _regions(index: DataFrame) -> DataFrame:
    """Per document: the piece in which its samples begin and that in which they end."""
    place = F.struct(*_PLACE)
    opened = index.filter("opens").groupBy("doc").agg(F.min(F.struct(place.alias("place"), F.col("value"))).alias("o"))
    opened = opened.select("doc", F.col("o.place").alias("opened"), F.rlike("o.value", F.lit(_OPENING + r"\s*\]")).alias("none"))
    closings = index.filter("closes").select("doc", place.alias("place"))
    closed = closings.join(opened, "doc").filter("place > opened").groupBy("doc").agg(F.min("place").alias("closed"))
    return opened.join(closed, "doc", "left").select(
        F.col("doc").alias("_doc"), "opened", F.when(F.col("none"), F.col("opened")).otherwise(F.col("closed")).alias("closed_at"), "none"
    )


def _joined(rows: DataFrame, *keys: str) -> DataFrame:
    """Texts of the pieces of each key, put together in their order."""
    pieces = F.sort_array(F.collect_list(F.struct(*_PLACE, "text")))
    return rows.groupBy(*keys).agg(
        F.array_join(F.transform(pieces, lambda p: p["text"]), "").alias("text"), F.bool_or("opens").alias("first")
    )


def read_split(spark: SparkSession, paths: Sequence[str], *, parts: bool = False) -> tuple[DataFrame, DataFrame]:
    """Documents without their samples, and the samples, as JSON texts.

    The first table has ``doc``, ``text`` and ``valid`` (text, all samples and the
    commas between them are JSON); the second ``doc``, ``number`` (its order) and
    ``text``. With ``parts`` a document is all files of a folder, in the order of
    their names; otherwise it is a file. A sample has to fit one value, as has
    the document without its samples. Where a document repeats the key of the
    samples, the first array counts.
    """
    index = _stored(_indexed(_pieces(spark, paths, parts)), "document-index")
    regions = _stored(_regions(index), "document-regions")
    earlier = Window.partitionBy("doc").orderBy("part", "range").rowsBetween(Window.unboundedPreceding, -1)
    totals = index.groupBy("doc", "part", "range").agg(F.sum("ends").alias("n"))
    starts = totals.select(
        F.col("doc").alias("_of"), F.col("part").alias("_part"), F.col("range").alias("_range"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before")
    )
    starts = _stored(starts, "document-ranges")
    same = (F.col("doc") == F.col("_of")) & (F.col("part") == F.col("_part")) & (F.col("range") == F.col("_range"))
    rows = index.join(starts, same).join(regions, F.col("doc") == F.col("_doc"), "left")

    place = F.struct(*_PLACE)
    brace = F.when(F.col("closed"), F.lit("}")).otherwise("")
    is_first = F.coalesce(place == F.col("opened"), F.lit(False)) & ~F.coalesce("none", F.lit(False))
    inside = F.coalesce((place > F.col("opened")) & (place < F.col("closed_at")), F.lit(False)) & ~F.coalesce("none", F.lit(False))
    head, rest = rf"(?s)\A(.*?{_OPENING}).*\z", rf"(?s)\A.*?{_OPENING}"
    outer = rows.filter(~inside).select(
        "doc", *_PLACE, F.when(is_first, F.regexp_replace("value", head, "$1")).otherwise(F.concat("value", brace)).alias("text"), "opens"
    )
    inner = rows.filter(is_first | inside).select(
        "doc",
        (F.col("_before") + F.col("ended")).alias("number"),
        *_PLACE,
        F.concat(F.when(is_first, F.regexp_replace("value", rest, "")).otherwise(F.col("value")), brace).alias("text"),
        is_first.alias("opens"),
    )
    found = _joined(inner, "doc", "number").filter(F.rlike("text", F.lit(r"\S")))
    comma = F.rlike("text", F.lit(r"\A\s*,"))
    samples = found.select(
        "doc", "number", F.regexp_replace("text", r"\A\s*,?\s*", "").alias("text"), (comma != F.col("first")).alias("apart")
    )
    samples = _stored(samples, "document-samples")
    faults = samples.groupBy("doc").agg(F.bool_and(F.col("apart") & jsontext.is_json(F.trim("text"))).alias("sound"))
    documents = _joined(outer, "doc").select("doc", "text").join(faults, "doc", "left")
    valid = jsontext.is_json(F.trim("text")) & F.coalesce("sound", F.lit(True))
    return documents.select("doc", "text", valid.alias("valid")), samples.select("doc", "number", "text")
