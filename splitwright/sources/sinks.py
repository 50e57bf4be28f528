"""Writers: CSV, run folders that are never overwritten, provenance records, Markdown reports, splits on disk."""

from __future__ import annotations

import hashlib
import json
import platform
import time
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import SPLITS
from ..operators import expectations as X


def run_folder(base: str, name: str) -> str:
    """A new folder base/name, or name_02, name_03, ... if that exists; never one that was there before."""
    for k in range(1, 10_000):
        path = Path(base) / (name if k == 1 else f"{name}_{k:02d}")
        try:
            path.mkdir(parents=True)
            return str(path)
        except FileExistsError:
            continue
    raise RuntimeError("too many runs")


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """A CSV folder with a header and line feeds; an existing one is an error. single: one file, for small reports only."""
    (df.coalesce(1) if single else df).write.mode("errorifexists").option("lineSep", "\n").csv(path, header=True, nullValue="", emptyValue="")


def write_provenance(folder: str, parameters: dict, inputs: Sequence[str] = (), name: str = "config.json") -> dict:
    """A record of when, where and with what a run was made, with the SHA-256 of its input files; returned and written."""
    record = {
        "written_utc": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()),
        "python": platform.python_version(),
        "platform": platform.platform(),
        "parameters": parameters,
        "inputs": {p: hashlib.sha256(Path(p).read_bytes()).hexdigest() for p in inputs},
    }
    Path(folder, name).write_text(json.dumps(record, indent=2, sort_keys=True, default=str) + "\n")
    return record


def markdown_table(df: DataFrame, most: int = 200) -> str:
    """A Markdown table of a small result; larger ones are an error, for a report isn't the place for them."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|")
    lines = [df.columns, ["---"] * len(df.columns), *[[cell(v) for v in r] for r in rows]]
    return "\n".join("| " + " | ".join(line) + " |" for line in lines)


def thousands(c: Column | str) -> Column:
    return F.format_number(F.col(c) if isinstance(c, str) else c, 0)


def signed(c: Column | str, digits: int = 1) -> Column:
    return F.format_string(f"%+.{digits}f", (F.col(c) if isinstance(c, str) else c).cast("double"))


def yes_no(c: Column | str) -> Column:
    return F.when(F.col(c) if isinstance(c, str) else c, "yes").otherwise("NO")


def latex_escape(c: Column | str) -> Column:
    out = F.col(c) if isinstance(c, str) else c
    for plain in ("&", "%", "$", "#", "_"):
        out = F.replace(out, F.lit(plain), F.lit("\\" + plain))
    return out


def materialise(assignment: DataFrame, path: str, least: dict[str, int] | None = None, name: str = "image_name") -> DataFrame:
    """Writes an assignment by split and checks what was written by reading it again; returns the report.

    Before: names unique, splits known. The target must not exist. After: as many rows as were given, the same content
    by an order-free checksum, each split at least as large as asked. A failed check raises.
    """
    spark: SparkSession = assignment.sparkSession
    before = X.report(
        [X.unique(assignment, [name], "names are unique"), X.checks(assignment, {"splits are known": F.col("split").isin(*SPLITS), "names are given": F.col(name).isNotNull()})]
    )
    X.require(before)
    mark = lambda df: df.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*sorted(assignment.columns))).alias("x")).first()
    assignment.write.mode("errorifexists").partitionBy("split").parquet(path)
    again = spark.read.parquet(path).withColumn("split", F.col("split").cast("string"))
    given, found = mark(assignment), mark(again)
    sizes = {r["split"]: r["n"] for r in again.groupBy("split").agg(F.count("*").alias("n")).collect()}  # three rows
    told = [("rows written", abs(given["n"] - found["n"])), ("content written", int(given["x"] != found["x"]))]
    told += [(f"{s} is large enough", int(sizes.get(s, 0) < n)) for s, n in (least or {}).items()]
    after = spark.createDataFrame([(c, v, "PASS" if v == 0 else "FAIL") for c, v in told], "check string, violations long, verdict string")
    X.require(after)
    return before.unionByName(after)


def build_checks(images: DataFrame, boxes: DataFrame, classes: DataFrame) -> DataFrame:
    """(check, n, violations, verdict) of a built data set: labels beside images, no orphans, ids and numbers in range, no label twice.

    images: filename; boxes: image, class_id, cx, cy, w, h; classes: class_id. Null names count as none; empty tables pass.
    """
    files = images.where("filename is not null").select(F.col("filename").alias("name")).distinct()
    labelled = boxes.where("image is not null").select(F.col("image").alias("name")).distinct()
    both = files.withColumn("_f", F.lit(1)).join(labelled.withColumn("_l", F.lit(1)), "name", "full_outer")
    known = classes.select("class_id", F.lit(1).alias("_k")).distinct()
    marked = boxes.join(known, "class_id", "left")
    inside = F.lit(True)
    for c in ("cx", "cy", "w", "h"):
        inside = inside & F.coalesce((F.col(c) > 0) & (F.col(c) <= 1), F.lit(False))
    repeated = boxes.groupBy("image", "class_id", "cx", "cy", "w", "h").agg((F.count("*") - 1).alias("k"))
    parts = (
        both.agg(F.lit("images have labels").alias("check"), F.count("_f").alias("n"), F.count_if(F.col("_f").isNotNull() & F.col("_l").isNull()).alias("violations")),
        both.agg(F.lit("labels have images").alias("check"), F.count("_l").alias("n"), F.count_if(F.col("_l").isNotNull() & F.col("_f").isNull()).alias("violations")),
        marked.agg(F.lit("class ids are known").alias("check"), F.count("*").alias("n"), F.count_if(F.col("_k").isNull()).alias("violations")),
        marked.agg(F.lit("numbers are in range").alias("check"), F.count("*").alias("n"), F.count_if(~inside).alias("violations")),
        repeated.agg(F.lit("no label is repeated").alias("check"), F.coalesce(F.sum(F.col("k") + 1), F.lit(0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("violations")),
    )
    out = parts[0]
    for one in parts[1:]:
        out = out.unionByName(one)
    return out.withColumn("verdict", F.when(F.col("violations") == 0, "PASS").otherwise("FAIL"))


#: Numbers that prose writes as words.
WORDS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve")


def number_word(c: Column | str) -> Column:
    """A small whole number as a word, a larger one in digits with separators; null gives null."""
    n = F.col(c) if isinstance(c, str) else c
    return F.when(n.between(0, len(WORDS) - 1), F.get(F.array(*[F.lit(w) for w in WORDS]), n.cast("int"))).otherwise(F.format_number(n, 0))


def latex_table(df: DataFrame, caption: str, label: str, most: int = 200) -> str:
    """A booktabs table of a small result: numbers to the right, texts to the left, every cell escaped; larger ones are an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    numbers = [t in ("int", "bigint", "smallint", "tinyint", "float", "double") or t.startswith("decimal") for _, t in df.dtypes]

    def cell(v: object) -> str:
        out = "--" if v is None else str(v)
        for plain in ("\\", "&", "%", "$", "#", "_", "{", "}"):
            out = out.replace(plain, "\\textbackslash " if plain == "\\" else "\\" + plain)
        return out

    body = [" & ".join(cell(v) for v in r) + r" \\" for r in rows]
    head = [r"\begin{table}", r"\centering", rf"\caption{{{cell(caption)}}}", rf"\label{{{label}}}", r"\begin{tabular}{" + "".join("r" if n else "l" for n in numbers) + "}", r"\toprule"]
    return "\n".join([*head, " & ".join(cell(c) for c in df.columns) + r" \\", r"\midrule", *body, r"\bottomrule", r"\end{tabular}", r"\end{table}"])


def correct_field(df: DataFrame, condition: Column, field: str, old: str, new: str, expected: int) -> tuple[DataFrame, bool]:
    """The frame with one field corrected where the condition holds and the old value stands; whether anything was to do.

    Idempotent: if the rows have the new value already nothing changes. If neither as many old nor as many new values
    as expected are there, the evidence doesn't fit and it raises.
    """
    n = df.where(condition).agg(F.count_if(F.col(field) == old).alias("old"), F.count_if(F.col(field) == new).alias("new")).first()
    if n["old"] == 0 and n["new"] == expected:
        return df, False
    if n["old"] != expected:
        raise X.CheckFailed(f"expected {expected} rows with {old!r}, found {n['old']}")
    return df.withColumn(field, F.when(condition & (F.col(field) == old), F.lit(new)).otherwise(F.col(field))), True
