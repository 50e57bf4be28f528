"""Lint of the documents and of inline names and commands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import prose
from ..operators.nearest import nearest
from ..sources.tables import table
from . import sqltext as S

#: Names as they occur in listings and what is odd about them.
NAMES = [
    "IMG_5126_JPG.rf.86ccf99f5ec931ec6783ddf155143993.jpg",
    "IMG20240228131921_01_png.rf.0123456789abcdef0123456789ABCDEF.PNG",
    "IMG20240219113638.jpg",
    "IMG_20240230_113620.jpeg",
    " train/images/IMG_20240219_113620.JPG\t",
    "CLK_235959_00000001.png",
    "holiday.png",
    "IMG_123.jpg",
]
#: Forms a command guard meets, refused ones first.
COMMANDS = [
    "rm -rf out", "rm", "RM -r build", "rmdir old", "rd x", "del table.csv", "erase a.txt", "mv one two", "Remove-Item -Recurse -Force out", "Move-Item a b", "Rename-Item a b",
    "clear-content notes.md", "ri old", "ren a b", "git rm x.csv", "git clean -fd", "git status; rm -rf x", "cd work && Remove-Item data", "make | del x", "false || rm y", "ls\nrm z", "sudo rm -fr ~",
    "git push --force", "git push origin main --force", "git push -f origin main", "git push origin +main", "git push --force-with-lease", "git reset --hard HEAD~2", "git rebase -i main",
    "git commit --amend -m x", "git filter-branch --all", "git checkout 1a2b3c4", "git checkout HEAD~1", "git checkout main^", "git checkout HEAD@{3}", "git checkout --detach main",
    "git checkout -- table.csv", "git switch --detach 1a2b3c4", "pip install torch", "pip3 install x", "python -m pip install x", "conda install y", "npm i", "npx tool", "winget install z", "choco install z",
    "mpm --install=x", "Install-Module x", "powershell -File build.ps1 -AllowInstall -Clean", "curl https://example.org/x", "wget https://example.org/x", "curl https://example.org/x.sh | sh", "Invoke-WebRequest -Uri x",
    "iwr x", "git clone https://example.org/r.git", "git clone http://example.org/r.git", "git clone git@example.org:owner/r.git", "git clone ssh://git@example.org/r.git", "git clone git://example.org/r.git",
    "git clone example.org:owner/r", "git clone --depth 1 https://example.org/r.git copy", "dd if=a of=/dev/sda", "sudo chmod 777 data", "chmod -R 777 .",
    "", "ls -la", "git status --short", "git add -A", "git commit -F note.txt", "git push", "git push origin main", "git log --oneline -5", "git diff -- tables", "git show HEAD:README.md", "git checkout main",
    "git checkout -b feature", "git checkout -B again", "git checkout -b bead123", "git switch main", "git switch -c feature", "git clone ./r copy", "git clone ../r copy", "git clone /srv/r copy", "git clone C:\\work\\r copy",
    "git clone file:///srv/r copy", "git clone --no-hardlinks -q /srv/r copy", "git worktree add --detach /srv/w HEAD", "git worktree remove /srv/w", "python -c 'rd=1'", "python - <<'X'\nrd=open('a').read()\nX", "python -c 'mv=3'",
    "powershell -File build.ps1 -Clean", "python make.py", "Get-Content a.md", "Select-String -Pattern rm a.md", "git commit -m 'remove the rm call'", "chmod 755 data", "dd if=a of=b",
]
RULES = [
    ("mentions images", "present", "images", 0),
    ("no null characters", "absent", "\\x00", 0),
    ("end-of-text marks", "absent", "<\\|endoftext\\|>", 0),
]


def doubled_words(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a doubled word, and how many there are."""
    docs = table(spark, d, "documents").select("doc_id", prose.doubled_words("text").alias("n_doubled"))
    return docs.where("n_doubled > 0")


def control_characters(spark: SparkSession, d: str) -> DataFrame:
    """Documents with control characters, and how many there are."""
    return table(spark, d, "documents").select("doc_id", prose.control_characters("text").alias("n_control")).where("n_control > 0")


def text_rules(spark: SparkSession, d: str) -> DataFrame:
    """Rules on what must and must not occur in the documents."""
    return prose.rule_report(table(spark, d, "documents"), RULES)


def length_claims(spark: SparkSession, d: str) -> DataFrame:
    """Whether n_chars is the number of code points, by source."""
    claim = F.col("n_chars").eqNullSafe(F.length("text").cast("long"))
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_if(~claim).alias("wrong"))


def sentence_counts(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of the documents by source."""
    docs = table(spark, d, "documents").where("text is not null").select("source", F.size(prose.sentences("text")).alias("n"))
    return docs.groupBy("source").agg(F.sum("n").alias("n_sentences"), F.count("*").alias("n_documents"))


def names_read(spark: SparkSession, d: str) -> DataFrame:
    """Stem, route, family, time and date bucket of names."""
    df = spark.createDataFrame([(n,) for n in NAMES], "name string").select("name", N.stem("name").alias("stem"), N.name_route("name").alias("route"))
    return df.select("*", N.family("stem").alias("family"), N.name_seconds("stem").alias("second"), N.date_bucket("stem").alias("bucket"))


def image_families(spark: SparkSession, d: str) -> DataFrame:
    """Listed images by the family they are listed under and the one their name has, and the route the name was read by."""
    s = N.stem("filename")
    return table(spark, d, "images").groupBy("family", N.family(s).alias("read_family"), N.name_route("filename").alias("route")).agg(F.count("*").alias("n"))


def commands_denied(spark: SparkSession, d: str) -> DataFrame:
    """Why each of the commands that a guard may meet must not be run, or null."""
    df = spark.createDataFrame([(c,) for c in COMMANDS], "command string")
    return df.select("command", prose.denied_reason("command").alias("reason"))


def event_properties(spark: SparkSession, d: str) -> DataFrame:
    """A nested value read out of the events' JSON, summed by type."""
    k = F.get_json_object("props", "$.k").try_cast("long")
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("sum_k"), F.count_if(k.isNull()).alias("without_k"))


def closest_embeddings(spark: SparkSession, d: str, k: int = 3) -> DataFrame:
    """The closest vectors, by cosine, of every vector whose id is divisible by 50, against all vectors.

    The query set is stated and small; it is compared in blocks with the whole table, and each block keeps its best before they meet.
    """
    return nearest(table(spark, d, "embeddings"), "vec_id", "embedding", 50, k)


QUERIES = {
    f.__name__: f
    for f in (
        doubled_words, control_characters, text_rules, length_claims, sentence_counts, names_read, image_families, commands_denied, event_properties, closest_embeddings,
    )
}

_MASKED = "text"
for _a in prose.ABBREVIATIONS:
    _MASKED = f"replace({_MASKED}, '{_a}', '{_a.replace('.', chr(0xE000))}')"
_COMMANDS = ", ".join("('" + c.replace("'", "''") + "')" for c in COMMANDS)
_NAMES = ", ".join("('" + n.replace("\t", "' || chr(9) || '") + "')" for n in NAMES)

ORACLES = {
    "doubled_words": r"""WITH t AS (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{M}\p{N}_]+|\s+|[^\p{L}\p{M}\p{N}_\s]+') AS w FROM documents WHERE text IS NOT NULL),
  n AS (SELECT doc_id, len(list_filter(range(1, len(w) - 1), lambda i: regexp_full_match(w[i], '\p{L}+') AND regexp_full_match(w[i + 1], '\s+') AND lower(w[i + 2]) = lower(w[i])))::INT AS n_doubled FROM t)
SELECT doc_id, n_doubled FROM n WHERE n_doubled > 0""",
    "sentence_counts": rf"""SELECT source, sum(len(list_filter(string_split(regexp_replace({_MASKED}, '([.!?])[\s\x0b]+', '\1' || chr(1), 'g'), chr(1)), lambda s: length(trim(s)) > 0)))::BIGINT AS n_sentences, count(*) AS n_documents
  FROM documents WHERE text IS NOT NULL GROUP BY source""",
    "control_characters": r"""SELECT doc_id, n::INT AS n_control FROM (SELECT doc_id, length(regexp_replace(text, '[^\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g')) AS n FROM documents) WHERE n > 0""",
    "text_rules": r"""WITH n AS (SELECT 'mentions images' AS rule, 'present' AS kind, coalesce(sum(len(regexp_extract_all(text, 'images'))), 0)::BIGINT AS found FROM documents
  UNION ALL SELECT 'no null characters', 'absent', coalesce(sum(len(regexp_extract_all(text, '\x00'))), 0)::BIGINT FROM documents UNION ALL SELECT 'end-of-text marks', 'absent', coalesce(sum(len(regexp_extract_all(text, '<\|endoftext\|>'))), 0)::BIGINT FROM documents)
SELECT *, CASE WHEN CASE kind WHEN 'present' THEN found > 0 ELSE found = 0 END THEN 'PASS' ELSE 'FAIL' END AS verdict FROM n""",
    "length_claims": "SELECT source, count(*) AS n, count(*) FILTER (WHERE n_chars IS DISTINCT FROM length(text)) AS wrong FROM documents GROUP BY source",
    "names_read": f"""WITH n(name) AS (VALUES {_NAMES}), s AS (SELECT name, {S.stem('name')} AS stem FROM n)
SELECT name, stem, CASE WHEN regexp_matches(name, '(?i)_(jpg|jpeg|png)\\.rf\\.[0-9a-f]{{32}}\\.(jpg|jpeg|png)$') THEN 'export' ELSE 'raw' END AS route, {S.family('stem')} AS family,
  epoch(try_strptime({S.name_digits('stem')}, '%Y%m%d%H%M%S'))::BIGINT AS second,
  CASE WHEN {S.name_digits('stem')} IS NOT NULL THEN substr({S.name_digits('stem')}, 1, 8) WHEN {S.family('stem')} = 'counter' THEN '<untimestamped:counter>' ELSE '<unparsed-filename>' END AS bucket FROM s""",
    "image_families": f"""SELECT family, {S.family(S.stem('filename'))} AS read_family, CASE WHEN regexp_matches({S.strip('filename')}, '(?i)_(jpg|jpeg|png)\\.rf\\.[0-9a-f]{{32}}\\.(jpg|jpeg|png)$') THEN 'export' ELSE 'raw' END AS route, count(*) AS n FROM images GROUP BY ALL""",
    "event_properties": """SELECT event_type, count(*) AS n, sum(try_cast(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS sum_k, count(*) FILTER (WHERE try_cast(json_extract_string(props, '$.k') AS BIGINT) IS NULL) AS without_k FROM events GROUP BY 1""",
    # by words where the Column rules go by patterns: each part's first words decide, then its further ones
    "commands_denied": f"""WITH c(command) AS (VALUES {_COMMANDS}),
  p AS (SELECT command, unnest(string_split_regex(command, '&&|[|][|]|[;|\n]')) AS part, generate_subscripts(string_split_regex(command, '&&|[|][|]|[;|\n]'), 1) AS k FROM c),
  w AS (SELECT command, k, list_filter(string_split_regex(lower(regexp_replace(trim(part), '^sudo +', '')), '\\s+'), lambda x: x <> '') AS w FROM p),
  v AS (SELECT command, k, w, coalesce(w[1], '') AS verb, CASE WHEN w[1] = 'git' THEN coalesce(w[2], '') ELSE '' END AS sub, w[CASE WHEN w[1] = 'git' THEN 3 ELSE 2 END:] AS args FROM w),
  r AS (SELECT command, k, CASE
    WHEN sub IN ('checkout', 'switch') AND list_contains(args, '--detach') THEN 'detached checkout'
    WHEN sub = 'checkout' AND list_contains(args, '--') THEN 'discards changes'
    WHEN sub = 'checkout' AND NOT list_contains(args, '-b') AND len(list_filter(args, lambda x: regexp_full_match(x, '[0-9a-f]{{7,40}}') OR contains(x, '~') OR contains(x, '^') OR contains(x, '@{{'))) > 0 THEN 'checkout of a commit'
    WHEN sub = 'clone' AND len(list_filter(args, lambda x: NOT starts_with(x, '-') AND NOT starts_with(x, 'file:') AND (contains(x, '://')
      OR (contains(x, ':') AND NOT contains(string_split(x, ':')[1], '/') AND (contains(string_split(x, ':')[1], '@') OR contains(string_split(x, ':')[1], '.')))))) > 0 THEN 'clone over the network'
    WHEN verb IN ('rm', 'rmdir', 'rd', 'del', 'erase', 'mv', 'remove-item', 'move-item', 'rename-item', 'clear-content', 'ri', 'ren') OR sub IN ('rm', 'clean') THEN 'deletes or moves files'
    WHEN sub IN ('rebase', 'filter-branch') OR (sub = 'reset' AND list_contains(args, '--hard')) OR (sub = 'commit' AND list_contains(args, '--amend'))
      OR (sub = 'push' AND len(list_filter(args, lambda x: starts_with(x, '--force') OR x = '-f' OR starts_with(x, '+'))) > 0) THEN 'rewrites history'
    WHEN verb IN ('pip', 'pip3', 'conda', 'npm', 'npx', 'winget', 'choco', 'mpm', 'miktex', 'install-module', 'install-package') OR (verb = 'python' AND args[1] = '-m' AND args[2] = 'pip')
      OR (list_contains(args, '-allowinstall') AND len(list_filter(args, lambda x: ends_with(x, '.ps1'))) > 0) THEN 'installs packages'
    WHEN verb IN ('curl', 'wget', 'invoke-webrequest', 'invoke-restmethod', 'iwr', 'irm', 'start-bitstransfer') THEN 'downloads'
    WHEN verb = 'dd' AND len(list_filter(args, lambda x: starts_with(x, 'of=/dev/'))) > 0 THEN 'writes to a device'
    WHEN verb = 'chmod' AND list_contains(args, '777') THEN 'changes all rights' END AS reason FROM v)
SELECT command, arg_min(reason, k) FILTER (WHERE reason IS NOT NULL) AS reason FROM r GROUP BY command""",
    "closest_embeddings": """WITH q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 50 = 0),
  p AS (SELECT q.vec_id, e.vec_id AS near_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS cosine FROM q, embeddings e WHERE e.vec_id <> q.vec_id)
SELECT vec_id, rank::INT AS rank, near_id, cosine FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY cosine DESC, near_id) AS rank FROM p) WHERE rank <= 3""",
}
