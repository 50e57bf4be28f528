"""Readers of the files around a labelled data set: listings, metadata, labels, dictionaries, run records, prose."""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions.names import SPLIT_SPELLINGS


def require_inputs(*paths: str) -> None:
    """Raises with all missing inputs at once; a path with a scheme is left to Spark."""
    missing = [p for p in paths if "://" not in p and not Path(p).exists()]
    if missing:
        raise FileNotFoundError("missing inputs: " + ", ".join(missing))


def image_listing(spark: SparkSession, folder: str, extensions: Sequence[str] = ("jpg", "jpeg", "png")) -> DataFrame:
    """(filename, split, path, length) of the images under a folder; the innermost folder that names a split gives it.

    Files under no such folder have a null split. Contents aren't read; files of no bytes aren't listed.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    parts = F.split(F.col("path"), "/")
    known = F.create_map(*[F.lit(x) for pair in SPLIT_SPELLINGS.items() for x in pair])
    named = F.filter(F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p: F.try_element_at(known, F.lower(p))), lambda s: s.isNotNull())
    return files.where(F.lower("path").rlike(rf"\.({'|'.join(extensions)})\z")).select(
        F.element_at(parts, -1).alias("filename"), F.try_element_at(named, F.lit(-1)).alias("split"), "path", "length"
    )


def trimmed_csv(spark: SparkSession, path: str, key: str | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(rows, repeats) of a CSV with every header and value stripped and a byte-order mark dropped.

    With a key the last row of each key wins, and the repeated keys come with their number; rows with a blank key stay out of
    both. All columns are text.
    """
    raw = spark.read.csv(path, header=True, quote='"', escape='"', encoding="UTF-8", inferSchema=False)
    clean = [c.lstrip("\ufeff").strip() for c in raw.columns]
    df = raw.toDF(*clean).select(*[N.strip(F.col(f"`{c}`")).alias(c) for c in clean], F.monotonically_increasing_id().alias("_row"))
    if key is None:
        return df.drop("_row"), None
    given = df.where(F.col(f"`{key}`").isNotNull() & (F.col(f"`{key}`") != ""))
    repeats = given.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
    last = given.groupBy(key).agg(F.max(F.struct("_row", *[F.col(f"`{c}`") for c in clean if c != key])).alias("_r"))
    return last.select(*[F.col(f"`{c}`") if c == key else F.col(f"_r.`{c}`").alias(c) for c in clean]), repeats


def label_boxes(spark: SparkSession, path: str) -> DataFrame:
    """(image, position, class_id, cx, cy, w, h) of label text files; lines that aren't five numbers are skipped.

    position is the line's place in its file, from 0; it is the order in which boxes are matched.
    """
    text = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.col("_metadata.file_name").alias("f"), "value")
    lines = text.select(F.regexp_replace("f", r"\.[^.]*\z", "").alias("image"), F.posexplode(F.split("value", "\r?\n")).alias("position", "line"))
    parts = F.split(N.strip("line"), r"\s+")
    read = lines.where(F.size(parts) == 5).select(
        "image", "position", F.get(parts, 0).try_cast("int").alias("class_id"), *[F.get(parts, k).try_cast("double").alias(c) for k, c in enumerate(("cx", "cy", "w", "h"), 1)]
    )
    return read.na.drop(subset=["class_id", "cx", "cy", "w", "h"])


def class_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(class_id, class_name) of a dataset description with nc and a list of names; unequal numbers are an error."""
    text = spark.read.text(path, wholetext=True)
    listed = F.regexp_extract("value", r"(?ms)^names:\s*(\[.*?\])", 1)
    names = F.from_json(F.regexp_replace(listed, "'", '"'), "array<string>")
    count = F.regexp_extract("value", r"(?m)^nc:\s*(\d+)\s*$", 1).cast("int")
    checked = F.when(F.size(names) == count, names).otherwise(F.raise_error(F.lit("nc and the number of names differ")))
    return text.select(F.posexplode(checked).alias("class_id", "class_name"))


def flat_settings(spark: SparkSession, path: str) -> DataFrame:
    """(run, key, value) of flat key: value files; run is the file's name without extension, null stays text."""
    text = spark.read.option("recursiveFileLookup", "true").text(path).select(F.col("_metadata.file_name").alias("f"), "value")
    pattern = r"\A([A-Za-z_][\w.-]*):\s*(.*?)\s*\z"
    return text.where(F.col("value").rlike(pattern)).select(
        F.regexp_replace("f", r"\.[^.]*\z", "").alias("run"), F.regexp_extract("value", pattern, 1).alias("key"), F.regexp_extract("value", pattern, 2).alias("value")
    )


def json_records(spark: SparkSession, path: str, array: str, key: str, exclude: Sequence[str] = ()) -> DataFrame:
    """The structs of an array in JSON files, one row each; a repeated or missing key is an error, excluded files are left out."""
    read = spark.read.option("multiLine", "true").json(path).withColumn("_file", F.col("_metadata.file_name"))
    rows = read.where(~F.col("_file").isin(*exclude) if exclude else F.lit(True)).select(F.explode(array).alias("r")).select("r.*")
    n = F.count("*").over(Window.partitionBy(key))
    sound = F.col(key).isNotNull() & (F.col("_n") == 1)
    return rows.withColumn("_n", n).withColumn(key, F.when(sound, F.col(key)).otherwise(F.raise_error(F.lit(f"missing or repeated {key}")))).drop("_n")


def manifest(spark: SparkSession, path: str, name: str = "image_name", split: str = "split") -> DataFrame:
    """(image_name, split) of an assignment; repeated names and unknown splits are errors."""
    rows, _ = trimmed_csv(spark, path)
    n = F.count("*").over(Window.partitionBy(name))
    label = N.split_label(split)
    checked = F.when(label.isNull(), F.raise_error(F.lit("unknown split"))).when(F.col("_n") > 1, F.raise_error(F.lit("repeated image"))).otherwise(label)
    return rows.withColumn("_n", n).select(name, checked.alias("split"))


def first_existing(spark: SparkSession, layouts: Sequence[DataFrame], key: str) -> DataFrame:
    """Rows of the first layout that has the key, for files that may lie in several places."""
    tagged = None
    for k, df in enumerate(layouts):
        one = df.withColumn("_layout", F.lit(k))
        tagged = one if tagged is None else tagged.unionByName(one)
    best = F.min("_layout").over(Window.partitionBy(key))
    return tagged.withColumn("_best", best).where("_layout = _best").drop("_layout", "_best")


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, text) of text files, lines numbered from 1."""
    text = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    return text.select("file", F.posexplode(F.split("value", "\r?\n")).alias("p", "text")).select("file", (F.col("p") + 1).alias("line"), "text")


def markdown_tables(lines: DataFrame) -> DataFrame:
    """(file, line, cells) of the body rows of Markdown tables; head and rule rows are left out."""
    row = F.col("text").rlike(r"\A\s*\|.*\|\s*\z")
    rule = F.col("text").rlike(r"\A\s*\|[\s:|-]+\|\s*\z")
    along = Window.partitionBy("file").orderBy("line")
    head = F.lead(rule).over(along)
    kept = lines.withColumn("_body", row & ~rule & ~F.coalesce(head, F.lit(False))).where("_body")
    return kept.select("file", "line", F.transform(F.split(F.regexp_replace("text", r"\A\s*\||\|\s*\z", ""), r"\|"), lambda c: F.trim(c)).alias("cells"))


def bibliography(lines: DataFrame) -> DataFrame:
    """(key, kind, title) of the entries of a bibliography, one for each @kind{key, line."""
    head = r"\A\s*@(\w+)\{([^,\s]+),"
    along = Window.partitionBy("file").orderBy("line")
    numbered = lines.withColumn("_e", F.sum(F.col("text").rlike(head).cast("int")).over(along))
    title = F.regexp_extract("text", r"(?i)\A\s*title\s*=\s*[{\"]+(.*?)[}\"]+,?\s*\z", 1)
    return (
        numbered.where("_e > 0")
        .groupBy("file", "_e")
        .agg(F.max(F.when(F.col("text").rlike(head), F.regexp_extract("text", head, 2))).alias("key"), F.max(F.when(F.col("text").rlike(head), F.lower(F.regexp_extract("text", head, 1)))).alias("kind"), F.max(title).alias("title"))
        .select("key", "kind", "title")
    )


def hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, length) of every file under a path; files of no bytes aren't listed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"), "length")


def empty_files(spark: SparkSession, folder: str) -> list[str]:
    """The files of no bytes under a folder, which no reader gives rows for: the listing that Spark keeps on the driver, less those with bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()

    def length(path: str) -> int:
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(conf).getFileStatus(p).getLen()

    return sorted(p for p in files.inputFiles() if length(p) == 0)


def unindexed_text(index: Column) -> Column:
    """The text of an inverted index (map of word to places): words in order of place."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " ")
