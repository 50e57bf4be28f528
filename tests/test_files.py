import json

import pytest
from pyspark.sql import functions as F

from splitwright.functions import prose
from splitwright.operators.expectations import CheckFailed
from splitwright.sources import files, sinks


def test_listing_takes_the_innermost_split(spark, tmp_path, rows):
    for p in ("train/val/a.jpg", "Test/images/b.PNG", "c.jpeg", "valid/notes.txt"):
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(b"x")
    assert rows(files.image_listing(spark, str(tmp_path)).select("filename", "split", "length")) == sorted([("a.jpg", "valid", 1), ("b.PNG", "test", 1), ("c.jpeg", None, 1)], key=repr)


def test_csv_is_trimmed_and_the_last_row_wins(spark, tmp_path, rows):
    f = tmp_path / "m.csv"
    f.write_bytes('\ufeff NAME , DEVICE\n a ,"x ""y"", z"\nb,\t2\na, 3 \n,4\n'.encode())
    got, repeats = files.trimmed_csv(spark, str(f), "NAME")
    assert rows(got) == [("a", "3"), ("b", "2")] and rows(repeats) == [("a", 2)]
    everything, none = files.trimmed_csv(spark, str(f))
    assert none is None and everything.where("NAME = 'a'").count() == 2


def test_labels_skip_malformed_lines(spark, tmp_path, rows):
    (tmp_path / "a.txt").write_text(" 1 0.1 0.2 0.3 0.4\nbroken\n2 0.1 0.2 x 0.4\n\n3\t.5 .5 .1 .1 \n")
    (tmp_path / "b.txt").write_text("")
    assert rows(files.label_boxes(spark, str(tmp_path))) == [("a", 0, 1, 0.1, 0.2, 0.3, 0.4), ("a", 4, 3, 0.5, 0.5, 0.1, 0.1)]


def test_dictionary_and_settings(spark, tmp_path, rows):
    (tmp_path / "d.yaml").write_text("nc: 2\nnames: ['fuse',\n  'relay']\n")
    assert rows(files.class_dictionary(spark, str(tmp_path / "d.yaml"))) == [(0, "fuse"), (1, "relay")]
    assert ("d", "nc", "2") in rows(files.flat_settings(spark, str(tmp_path)))
    (tmp_path / "e.yaml").write_text("nc: 3\nnames: ['fuse']\n")
    with pytest.raises(Exception, match="differ"):
        files.class_dictionary(spark, str(tmp_path / "e.yaml")).collect()


def test_json_records(spark, tmp_path, rows):
    (tmp_path / "r.json").write_text(json.dumps({"models": [{"slug": "a", "ms": 1.5}, {"slug": "b", "ms": 2.0}]}))
    (tmp_path / "skip.json").write_text(json.dumps({"models": [{"slug": "a", "ms": 9.0}]}))
    assert rows(files.json_records(spark, str(tmp_path), "models", "slug", ["skip.json"]).select("slug", "ms")) == [("a", 1.5), ("b", 2.0)]
    with pytest.raises(Exception, match="repeated"):
        files.json_records(spark, str(tmp_path), "models", "slug").collect()


def test_manifest_refuses_repeats_and_unknown_splits(spark, tmp_path, rows):
    f = tmp_path / "s.csv"
    f.write_text("image_name,split\na,train\nb,val\n")
    assert rows(files.manifest(spark, str(f))) == [("a", "train"), ("b", "valid")]
    f.write_text("image_name,split\na,train\na,test\n")
    with pytest.raises(Exception, match="repeated image"):
        files.manifest(spark, str(f)).collect()


def test_first_existing_layout_and_missing_inputs(spark, tmp_path, rows):
    a, b = spark.createDataFrame([("x", 1)], "k string, v int"), spark.createDataFrame([("x", 2), ("y", 3)], "k string, v int")
    assert rows(files.first_existing(spark, [a, b], "k")) == [("x", 1), ("y", 3)]
    with pytest.raises(FileNotFoundError, match="nope"):
        files.require_inputs(str(tmp_path), str(tmp_path / "nope"))


def test_markdown_bibliography_citations(spark, tmp_path, rows):
    (tmp_path / "t.md").write_text("text\n| a | b |\n|---|:-:|\n| 1 | x y |\n| 2 | |\n")
    assert [r[2] for r in rows(files.markdown_tables(files.text_lines(spark, str(tmp_path / "t.md"))))] == [["1", "x y"], ["2", ""]]
    (tmp_path / "r.bib").write_text("@article{k1,\n  title = {One},\n}\n@Book{k2,\n title={Two}}\n")
    entries = files.bibliography(files.text_lines(spark, str(tmp_path / "r.bib")))
    assert rows(entries.select("key", "kind")) == [("k1", "article"), ("k2", "book")]
    (tmp_path / "p.tex").write_text("\\section{Data}\nSee \\cite{k1, k3} % \\cite{k2}\nand \\citep[p.~2]{k1}.\n")
    uses = prose.citation_uses(files.text_lines(spark, str(tmp_path / "p.tex")))
    assert rows(uses.select("key", "line", "section")) == [("k1", 2, "Data"), ("k1", 3, "Data"), ("k3", 2, "Data")]
    assert rows(prose.citation_audit(uses, entries)) == [("k1", 2, "cited"), ("k2", 0, "uncited"), ("k3", 1, "missing")]


def test_hashes_and_inverted_index(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"abc")
    assert files.hashes(spark, str(tmp_path / "a")).first()["sha256"].startswith("ba7816bf8f01cfea")
    df = spark.createDataFrame([({"b": [1], "a": [0, 2]},)], "i map<string, array<int>>")
    assert df.select(files.unindexed_text(F.col("i"))).first()[0] == "a b a"


def test_run_folders_are_never_reused(tmp_path):
    names = [sinks.run_folder(str(tmp_path), "run").rsplit("/", 1)[1] for _ in range(3)]
    assert names == ["run", "run_02", "run_03"]
    record = sinks.write_provenance(str(tmp_path / "run"), {"tau": 15})
    assert json.loads((tmp_path / "run/config.json").read_text())["parameters"] == record["parameters"] == {"tau": 15}


def test_csv_and_markdown(spark, tmp_path):
    df = spark.createDataFrame([(1, "a|b"), (2, None)], "n int, t string").orderBy("n")
    sinks.write_csv(df, str(tmp_path / "out"), single=True)
    part = next((tmp_path / "out").glob("*.csv"))
    assert part.read_bytes() == b"n,t\n1,a|b\n2,\n"
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_csv(df, str(tmp_path / "out"))
    assert sinks.markdown_table(df).splitlines()[2] == "| 1 | a\\|b |"
    with pytest.raises(ValueError):
        sinks.markdown_table(df, most=1)


def test_formats(spark):
    row = spark.range(1).select(sinks.thousands(F.lit(12937)), sinks.signed(F.lit(1.25), 1), sinks.yes_no(F.lit(False)), sinks.latex_escape(F.lit("a_b & 5%"))).first()
    assert row[0] == "12,937" and row[1].startswith("+1.") and row[2] == "NO" and row[3] == "a\\_b \\& 5\\%"


def test_materialised_split_is_checked(spark, tmp_path):
    df = spark.createDataFrame([("a", "train"), ("b", "test")], "image_name string, split string")
    assert {r["verdict"] for r in sinks.materialise(df, str(tmp_path / "s"), {"train": 1}).collect()} == {"PASS"}
    with pytest.raises(CheckFailed, match="large enough"):
        sinks.materialise(df, str(tmp_path / "s2"), {"valid": 1})
    with pytest.raises(CheckFailed, match="unique"):
        sinks.materialise(df.unionByName(df), str(tmp_path / "s3"))


def test_field_correction_is_gated_and_idempotent(spark, rows):
    df = spark.createDataFrame([("m", "old"), ("n", "old")], "k string, f string")
    fixed, changed = sinks.correct_field(df, F.col("k") == "m", "f", "old", "new", 1)
    assert changed and rows(fixed) == [("m", "new"), ("n", "old")]
    again, changed = sinks.correct_field(fixed, F.col("k") == "m", "f", "old", "new", 1)
    assert not changed and rows(again) == rows(fixed)
    with pytest.raises(CheckFailed):
        sinks.correct_field(df, F.col("k") == "z", "f", "old", "new", 1)


def test_prose(spark, rows):
    df = spark.createDataFrame([(1, "the the cat\nCat sat."), (2, "one\x07 two"), (3, None), (4, "")], "i int, t string")
    got = {r["i"]: (r["d"], r["c"]) for r in df.select("i", prose.doubled_words("t").alias("d"), prose.control_characters("t").alias("c")).collect()}
    assert got == {1: (2, 0), 2: (0, 1), 3: (None, None), 4: (0, 0)}
    one = spark.createDataFrame([("See Fig. 2. It works, e.g. here! Yes?",)], "t string").select(prose.sentences("t")).first()[0]
    assert one == ["See Fig. 2.", "It works, e.g. here!", "Yes?"]
    assert spark.range(1).select(prose.strip_markup(F.lit("<jats:p>a &lt; b &amp; c</jats:p>"))).first()[0] == "a < b & c"
    lines = spark.createDataFrame([("f", 1, "end of the"), ("f", 2, "The line"), ("f", 3, ""), ("f", 4, "x")], "file string, line int, text string")
    assert rows(prose.doubled_across_lines(lines)) == [("f", 1, "the")]
    assert rows(prose.paragraphs(lines)) == [("f", 1, 1, "end of the The line"), ("f", 2, 4, "x")]


@pytest.mark.parametrize("command, denied", [("rm -rf /", True), ("ls; sudo rm -fr ~", True), ("rm -r build/x", True), ("git push -f", True), ("git push origin main", False), ("echo 'rm'", False), ("dd if=a of=/dev/sda", True), ("", False)])
def test_guard(spark, command, denied):
    assert (spark.createDataFrame([(command,)], "c string").select(prose.denied_reason("c")).first()[0] is not None) is denied


def test_numbers_as_words_and_tables(spark):
    df = spark.createDataFrame([(0,), (12,), (13,), (1300,), (None,)], "n long")
    assert [r[0] for r in df.select(sinks.number_word("n")).collect()] == ["zero", "twelve", "13", "1,300", None]
    text = sinks.latex_table(spark.createDataFrame([("a_b", 5, None)], "name string, n int, x double"), "50 % of it", "t:one")
    assert r"a\_b & 5 & -- \\" in text and r"\caption{50 \% of it}" in text and "{lrr}" in text and r"\toprule" in text


def test_a_built_data_set_is_checked(spark, rows):
    images = spark.createDataFrame([("a.jpg",), ("b.jpg",), (None,), ("a.jpg",)], "filename string")
    boxes = spark.createDataFrame(
        [("a.jpg", 1, 0.5, 0.5, 0.1, 0.1), ("a.jpg", 1, 0.5, 0.5, 0.1, 0.1), ("c.jpg", 9, 0.5, None, 0.1, 1.2)], "image string, class_id int, cx double, cy double, w double, h double"
    )
    classes = spark.createDataFrame([(1,)], "class_id int")
    got = {r["check"]: (r["n"], r["violations"]) for r in sinks.build_checks(images, boxes, classes).collect()}
    assert got == {"images have labels": (2, 1), "labels have images": (2, 1), "class ids are known": (3, 1), "numbers are in range": (3, 1), "no label is repeated": (3, 1)}
    assert all(r["verdict"] == "PASS" for r in sinks.build_checks(images.limit(0), boxes.limit(0), classes).collect())


def test_files_of_no_bytes_are_listed(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.jpg").write_bytes(b"x")
    (tmp_path / "sub" / "b.jpg").write_bytes(b"")
    assert [p.rsplit("/", 1)[-1] for p in files.empty_files(spark, str(tmp_path))] == ["b.jpg"]


def test_a_workspace_ends_with_its_block(spark):
    from splitwright.session import Workspace

    with Workspace(spark, "block") as ws:
        df = ws.keep(spark.range(3).toDF("k"))
        assert df.count() == 3
        path = df._splitwright_path
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path).count()


def test_nearest_in_many_blocks(spark, monkeypatch):
    import numpy as np

    from splitwright.operators import nearest as near

    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(120, 4)).round(2)
    vectors[7] = 0
    vectors[40] = vectors[41]
    rows = [(k, v.tolist(), "clash") for k, v in enumerate(vectors)] + [(None, [1.0] * 4, ""), (500, None, "")]
    df = spark.createDataFrame(rows, "id long, v array<double>, _block string")
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)
    cosine = (unit @ unit.T).round(6)
    for block, part in ((2_000, 40_000), (3, 17)):
        monkeypatch.setattr(near, "BLOCK", block)
        monkeypatch.setattr(near, "PART", part)
        got = {(r["id"], r["rank"]): r["near_id"] for r in near.nearest(df, "id", "v", 10, 3).collect()}
        for q in range(0, 120, 10):
            others = sorted((-cosine[q, j], j) for j in range(120) if j not in (q, 7))
            assert [got[q, k] for k in (1, 2, 3)] == [j for _, j in others[:3]]
    assert near.nearest(df.limit(0), "id", "v", 10, 3).count() == 0
