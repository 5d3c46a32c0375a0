import json

import pytest
from pyspark.sql import functions as F

from tracelode import session
from tracelode.operators import ranges as rg
from tracelode.sources import readers as rd
from tracelode.sources import sinks as sk


def test_eval_lines(spark, tmp_path):
    good = {"id": "c1", "query": " q ", "relevant": [{"sourceFilename": "a.pdf", "pages": [1, 2]}]}
    lines = [json.dumps(good), "", "{bad", "[]", json.dumps(good), json.dumps({**good, "id": "c2", "query": " "}),
             json.dumps({**good, "id": "c3", "relevant": [{"sourceFilename": "a.pdf", "pages": [True]}]}),
             json.dumps({**good, "id": "c4", "relevant": [{"sourceFilename": "a.pdf", "pages": [1, 1]}]}),
             json.dumps({**good, "id": "c5", "relevant": "x"})]
    path = tmp_path / "cases.jsonl"
    path.write_text("\n".join(lines))
    got = [r["errors"] for r in rd.check_eval_lines(rd.read_eval_lines(spark, str(path))).orderBy("line_no").collect()]
    assert got == ["", "invalid_json", "not_an_object", "duplicate_id", "missing_query", "invalid_pages", "invalid_pages", "missing_labels"]


def study_line(**changes):
    row = dict(zip(rd.STUDY_COLUMNS, ["p1", "s1", "t1", "table", '"a, ""b""\nc"', "", "", "manual", "2026-01-01T10:00:00Z", "2026-01-01T10:05:00Z",
                                      "", "", "yes", "pass", "pass", "", "none", ""]))
    row.update(changes)
    return ",".join(row[c] for c in rd.STUDY_COLUMNS)


def test_study_csv(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text("\n".join([
        ",".join(rd.STUDY_COLUMNS), study_line(), study_line(workflow="robot"), study_line(task_id="t2", completed_at="2026-01-01T10:05:00"),
        study_line(task_id="t3", started_at="2026-01-01T12:00:00+01:00"), study_line(),
    ]) + "\n")
    rows = rd.check_study_results(rd.read_study_results(spark, str(path))).orderBy("line_no").collect()
    assert [r["errors"] for r in rows] == ["", "workflow", "times", "times", "duplicate"]
    assert rows[0]["question"] == 'a, "b"\nc' and rows[0]["seconds"] == 300.0


def test_study_header_must_match(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text(",".join(reversed(rd.STUDY_COLUMNS)) + "\n")
    with pytest.raises(ValueError):
        rd.read_study_results(spark, str(path))


def test_manifest(spark, tmp_path):
    manifest = {
        "schemaVersion": "x",
        "participants": [{"participantId": "p", "kind": "model_agent", "targetProfileConfirmed": True, "qualificationEvidenceId": "e"}],
        "assets": [{"assetId": "a", "modality": "pdf", "origin": "demo", "complexityConfirmed": False, "qualificationEvidenceId": "e", "sourceGroup": "s", "layoutGroup": "l"}] * 2,
        "tasks": [{"taskId": "t", "taskType": "table", "origin": "real_project", "scoreable": True, "assetIds": ["a", "zz"], "qualificationEvidenceId": "e"}],
    }
    path = tmp_path / "m.json"
    path.write_text(json.dumps(manifest, indent=1))
    parts = {k: rd.check_manifest(v, k) for k, v in rd.read_manifest(spark, str(path)).items()}
    assert [r["errors"] for r in parts["participants"].collect()] == ["confirmed_non_target"]
    assert [r["errors"] for r in parts["assets"].collect()] == ["duplicate_id", "duplicate_id"]
    assert [r["errors"] for r in parts["tasks"].collect()] == [""]
    assert [r["asset_id"] for r in rd.unknown_assets(parts["tasks"], parts["assets"]).collect()] == ["zz"]


def test_binary_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "b.pdf").write_bytes(b"\x89PNG\r\n\x1a\nxx")
    files = rd.read_binary_assets(spark, str(tmp_path), "*.pdf").select(
        F.element_at(F.split("path", "/"), -1).alias("name"), "content", F.lit("application/pdf").alias("declared_mime"), F.col("length").alias("declared_size")
    )
    got = {r["name"]: r["outcome"] for r in rd.inspect_binary(files).collect()}
    assert got == {"a.pdf": "ok", "b.pdf": "signature_mismatch"}
    # File scans leave out files without bytes, so an empty upload only shows up as a row.
    empty = spark.createDataFrame([(bytearray(), "application/pdf", 0)], "content binary, declared_mime string, declared_size long")
    assert rd.inspect_binary(empty).first()["outcome"] == "empty"


def test_pages_fall_back_to_ocr(spark):
    native = spark.createDataFrame([(1, 1, "text"), (1, 2, " "), (2, 1, ""), (3, 2, "x"), (4, 1, "")], "asset_id int, page_number int, text string")
    ocr = spark.createDataFrame([(1, 1, "o1"), (1, 2, "o2"), (4, 1, " ")], "asset_id int, page_number int, text string")
    pages, verdict = rd.merge_pages(native, ocr)
    assert {r["asset_id"]: r["outcome"] for r in verdict.collect()} == {1: "ok", 2: "ocr_incomplete", 3: "page_order", 4: "no_text"}
    assert {(r["page_number"], r["source_kind"], r["text"]) for r in pages.collect()} == {(1, "layout", "text"), (2, "ocr", "o2")}


def test_replacement_is_idempotent(spark):
    old = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "asset_id string, generation int")
    new = spark.createDataFrame([("a", 3)], "asset_id string, generation int")
    once = sk.replace_generation(old, new, ["asset_id"])
    twice = sk.replace_generation(once, new, ["asset_id"])
    assert sorted(once.collect()) == sorted(twice.collect()) == [("a", 3), ("b", 1)]


def test_report_and_key(spark, tmp_path):
    df = spark.createDataFrame([("b", 1), ("a", 2)], "z string, n int")
    path = str(tmp_path / "report")
    sk.write_report(df, path, ["z"])
    assert [r["value"] for r in spark.read.text(path).collect()] == ['{"n":2,"z":"a"}', '{"n":1,"z":"b"}']
    key = df.limit(1).select(sk.object_key(F.lit("w"), F.lit("x"), F.lit("Scan.v2.PNG")), sk.object_key(F.lit("w"), F.lit("x"), F.lit("noext"))).first()
    assert key == ("workspaces/w/assets/x/original.png", "workspaces/w/assets/x/original.pdf")


def test_labels_are_checked_by_type(spark):
    lines = [
        '{"id": "a", "query": "q", "relevant": [{"sourceFilename": "f.pdf", "pages": [1, 2]}]}',
        '{"id": "b", "query": "q", "relevant": [{"sourceFilename": "f.pdf", "pages": ["1"]}]}',
        '{"id": "c", "query": "q", "relevant": {"sourceFilename": "f.pdf", "pages": [1]}}',
        '{"id": "d", "query": "q", "relevant": [{"sourceFilename": "f.pdf", "pages": [1.5]}]}',
    ]
    df = spark.createDataFrame(list(enumerate(lines)), "line_no long, line string")
    got = {r["case_id"]: r["errors"] for r in rd.check_eval_lines(df).collect()}
    assert got["a"] == "" and got["b"] == "invalid_pages" and got["c"] == "missing_labels" and got["d"] == "invalid_pages"


def test_study_header_may_be_quoted(spark, tmp_path):
    path = tmp_path / "study.csv"
    path.write_text(",".join(f'"{c}"' for c in rd.STUDY_COLUMNS) + "\n" + ",".join("x" for _ in rd.STUDY_COLUMNS) + "\n")
    assert rd.read_study_results(spark, str(path)).count() == 1


def test_report_is_replaced_as_a_whole(spark, tmp_path):
    path = str(tmp_path / "report")
    for n in (1, 2):
        sk.write_report(spark.range(n).withColumn("b", F.lit(n)), path, ["id"])
    assert sorted((r["id"], r["b"]) for r in spark.read.json(path).collect()) == [(0, 2), (1, 2)]
    assert [p.name for p in tmp_path.iterdir()] == ["report"]


def test_a_cluster_needs_a_shared_folder():
    for master in ("local", "local[8]", "local[*]"):
        session.require_local(master)
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1024]", "k8s://x"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            session.require_local(master)


def test_excerpt_behind_many_blank_units(spark):
    box = {"x": 0.1, "y": 0.1, "width": 0.2, "height": 0.2}
    selected = spark.createDataFrame([(1, 1, *box.values())], "k int, region_id int, x double, y double, width double, height double")
    units = spark.createDataFrame(
        [(1, n, n, " " if n < 2400 else f"t{n}", *box.values()) for n in range(2500)],
        "k int, unit_order int, unit_id int, unit_text string, x double, y double, width double, height double",
    )
    captions = spark.createDataFrame([(1, "caption")], "k int, caption string")
    row = rg.region_excerpt(selected, units, captions, "k").first()
    want = "\n".join("" if n < 2400 else f"t{n}" for n in range(2500))[:4000]
    assert row["from_units"] and row["excerpt"] == want


def test_changed_input_is_seen(spark, tmp_path):
    from tracelode.plans.registry import tables

    folder = str(tmp_path)
    for text in ("first text", "second text, longer"):
        spark.createDataFrame([(1, text, "en", "src1", len(text))], "doc_id long, text string, lang string, source string, n_chars long").write.mode(
            "overwrite").parquet(f"{folder}/documents.parquet")
        assert [r["text"] for r in tables(spark, folder)("v_unit_base").collect()] == [text]
