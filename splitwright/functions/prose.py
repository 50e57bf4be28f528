"""Prose lint: doubled words, control characters, sentences, paragraphs, rules, and a guard for commands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Abbreviations whose full stop ends no sentence, and commands that must not be run,
ABBREVIATIONS = ("e.g.", "i.e.", "et al.", "cf.", "Fig.", "Eq.", "vs.", "approx.", "No.")
# reason: pattern at the start of a part of a command line, in any case; and what excuses it
DENIED = {
    "detached checkout": (r"git\s+(checkout|switch)\s(.*\s)?--detach\b", None),
    "discards changes": (r"git\s+checkout\s(.*\s)?--(\s|\z)", None),
    "checkout of a commit": (r"git\s+checkout\s(.*\s)?([0-9a-f]{7,40}|\S*(@\{|[~^])\S*)(\s|\z)", r"\s-b(\s|\z)"),
    "clone over the network": (r"git\s+clone\s(.*\s)?((https?|ssh|git|ftps?)://|[^-/\\@\s][^/\\@\s]*@[^/\\:\s]+:|[a-z0-9][a-z0-9._-]*\.[a-z]{2,}:)", None),
    "deletes or moves files": (r"(rm|rmdir|rd|del|erase|mv|remove-item|move-item|rename-item|clear-content|ri|ren)(\s|\z)|git\s+(rm|clean)\b", None),
    "rewrites history": (r"git\s+(rebase|filter-branch)\b|git\s+reset\b.*--hard\b|git\s+commit\b.*--amend\b|git\s+push\b.*(--force|\s-f\b|\s\+\S)", None),
    "installs packages": (r"(pip3?|conda|npm|npx|winget|choco|mpm|miktex|install-module|install-package)(\s|\z)|python\s+-m\s+pip(\s|\z)|.*\.ps1\s(.*\s)?-allowinstall\b", None),
    "downloads": (r"(curl|wget|invoke-webrequest|invoke-restmethod|iwr|irm|start-bitstransfer)(\s|\z)", None),
    "writes to a device": (r"dd\s+.*\bof=/dev/", None),
    "changes all rights": (r"chmod\s+(-\w+\s+)*777(\s|\z)", None),
}


def doubled_words(text: Column | str) -> Column:
    """How often a word of letters is followed by itself, across line breaks too, case aside."""
    t = F.col(text) if isinstance(text, str) else text
    return F.regexp_count(t, F.lit(r"(?iU)\b(\p{L}+)\s+(?=\1\b)"))


def control_characters(text: Column | str) -> Column:
    """How many control characters other than tab, line feed and carriage return there are."""
    t = F.col(text) if isinstance(text, str) else text
    return F.regexp_count(t, F.lit(r"[\x00-\x08\x0b\x0c\x0e-\x1f]"))


def sentences(text: Column | str) -> Column:
    """The sentences of a text as an array; a full stop of an abbreviation ends none; null gives null, an empty text none."""
    t = F.col(text) if isinstance(text, str) else text
    for k, a in enumerate(ABBREVIATIONS):
        t = F.replace(t, F.lit(a), F.lit(a.replace(".", "\ue000")))
    cut = F.split(t, r"(?<=[.!?])\s+")
    return F.filter(F.transform(cut, lambda s: F.trim(F.replace(s, F.lit("\ue000"), F.lit(".")))), lambda s: F.length(s) > 0)


def strip_markup(text: Column | str) -> Column:
    """Tags removed and the common entities decoded."""
    t = F.regexp_replace(F.col(text) if isinstance(text, str) else text, r"<[^<>]*>", " ")
    for entity, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(plain))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def strip_comments(text: Column | str) -> Column:
    """LaTeX comments and inline mathematics removed; an escaped percent sign is no comment."""
    t = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.regexp_replace(t, r"(?<!\\)%.*", ""), r"(?<!\\)\$[^$]*\$", " ")


def paragraphs(lines: DataFrame) -> DataFrame:
    """(file, paragraph, first_line, text): runs of lines between blank ones. lines: file, line, text.

    A file's lines are ordered in one task: a file, not the corpus, is the unit here.
    """
    along = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    blank = F.trim("text") == ""
    marked = lines.withColumn("_p", F.sum(blank.cast("int")).over(along)).where(~blank)
    held = marked.groupBy("file", "_p").agg(F.min("line").alias("first_line"), F.array_sort(F.collect_list(F.struct("line", "text"))).alias("_l"))
    text = F.array_join(F.transform("_l", lambda x: x["text"]), " ")
    number = F.row_number().over(Window.partitionBy("file").orderBy("first_line"))
    return held.select("file", number.alias("paragraph"), "first_line", text.alias("text"))


def doubled_across_lines(lines: DataFrame) -> DataFrame:
    """(file, line, word): a line's last word that the next line begins with; a break can't hide it."""
    along = Window.partitionBy("file").orderBy("line")
    last = F.lower(F.regexp_extract("text", r"(\p{L}+)\s*\z", 1))
    first = F.lower(F.regexp_extract(F.lead("text").over(along), r"\A\s*(\p{L}+)\b", 1))
    marked = lines.select("file", "line", last.alias("word"), first.alias("_next"))
    return marked.where((F.col("word") != "") & (F.col("word") == F.col("_next"))).select("file", "line", "word")


def rule_report(texts: DataFrame, rules: Sequence[tuple[str, str, str, int]], text: str = "text") -> DataFrame:
    """(rule, kind, found, verdict). rules: (name, kind, pattern, number); kind is present, absent or count.

    All patterns are counted in one pass over the texts.
    """
    hits = [F.coalesce(F.sum(F.regexp_count(F.col(text), F.lit(p))), F.lit(0)).alias(f"r{k}") for k, (_, _, p, _) in enumerate(rules)]
    counted = texts.agg(*hits)
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(k).alias("kind"), F.col(f"r{i}").alias("found"), F.lit(w).alias("wanted")) for i, (n, k, _, w) in enumerate(rules)]))
    good = (
        F.when(F.col("kind") == "present", F.col("found") > 0).when(F.col("kind") == "absent", F.col("found") == 0).otherwise(F.col("found") == F.col("wanted"))
    )
    return counted.select(rows.alias("r")).select("r.*").select("rule", "kind", "found", F.when(good, "PASS").otherwise("FAIL").alias("verdict"))


def citation_uses(lines: DataFrame) -> DataFrame:
    """(key, file, line, section): every use of a citation key, with the section it stands in."""
    along = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    title = F.when(F.col("text").rlike(r"\\(sub)*section\*?\{"), F.regexp_extract("text", r"\\(?:sub)*section\*?\{([^}]*)\}", 1))
    known = lines.withColumn("section", F.last(title, ignorenulls=True).over(along))
    keys = F.explode(F.flatten(F.transform(F.regexp_extract_all(strip_comments("text"), F.lit(r"\\cite[a-z]*\*?(?:\[[^\]]*\])*\{([^}]*)\}"), F.lit(1)), lambda k: F.split(k, r"\s*,\s*"))))
    return known.select(keys.alias("key"), "file", "line", "section").withColumn("key", F.trim("key"))


def citation_audit(uses: DataFrame, entries: DataFrame) -> DataFrame:
    """(key, n_uses, verdict): used keys without an entry (missing), entries never used (uncited), the rest cited."""
    n = uses.groupBy("key").agg(F.count("*").alias("n"))
    both = n.join(entries.select("key", F.lit(True).alias("_e")).distinct(), "key", "full_outer")
    verdict = F.when(F.col("_e").isNull(), "missing").when(F.col("n").isNull(), "uncited").otherwise("cited")
    return both.select("key", F.coalesce("n", F.lit(0)).alias("n_uses"), verdict.alias("verdict"))


def command_parts(command: Column) -> Column:
    """The parts of a command line between its separators, a single pipe too, without what only wraps the command."""
    parts = F.transform(F.split(command, r"&&|\|\||[;\n|]"), lambda p: F.trim(F.regexp_replace(F.trim(p), r"\A(?:(?:sudo|env|nohup|time|\w+=\S*)\s+)+", "")))
    return F.filter(parts, lambda p: p != "")


def denied_reason(command: Column | str) -> Column:
    """Why a command line must not be run, or null: the reason of its first part that has one.

    A part is judged by what it begins with, so a word inside a message is no command; a separator inside a quoted text does end a part, which
    errs on the safe side. Null and empty give null.
    """

    def judged(part: Column) -> Column:
        out = F.lit(None).cast("string")
        for reason, (pattern, excuse) in reversed(DENIED.items()):
            hit = part.rlike(rf"(?i)\A(?:{pattern})")
            out = F.when(hit & ~part.rlike(rf"(?i){excuse}") if excuse else hit, F.lit(reason)).otherwise(out)
        return out

    parts = command_parts(F.col(command) if isinstance(command, str) else command)
    return F.get(F.filter(F.transform(parts, judged), lambda r: r.isNotNull()), F.lit(0))
