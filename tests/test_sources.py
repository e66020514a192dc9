"""Sources, sinks and streams round trip."""

import json

import pytest
from pyspark.sql import functions as F

from veridock.sources import evidence as e
from veridock.sources import sinks
from veridock.streaming import logs


def item(i, text, **more):
    return {"evidence_id": f"EV-{i}", "document_id": "D", "ord": i, "page": 1, "text": text, "item_type": "BULLET", "citable": True} | more


def test_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"sha256": "a", "extraction_version": "2", "items": [item(1, "x"), item(2, "y")]}, indent=1))
    (tmp_path / "b.json").write_text(json.dumps({"sha256": "b", "extraction_version": "1", "items": [item(3, "z")]}))
    (tmp_path / "c.json").write_text("{ not json")
    docs = e.read_documents(spark, str(tmp_path), "2")
    assert sorted(r.evidence_id for r in e.items(docs).collect()) == ["EV-1", "EV-2"]


LONG = "a text that is longer than forty characters, so that a prefix will do"


def test_overrides(spark):
    rows = [("EV-1", "D", 1, "BULLET", "Short ₹5", None, "BASE", "v"), ("EV-2", "D", 1, "BULLET", LONG + " and more", "r", "BASE", "v"), ("EV-3", "D", 1, "BULLET", "twin", None, None, "v"), ("EV-4", "D", 1, "BULLET", "twin", None, None, "v")]
    ev = spark.createDataFrame(rows, "evidence_id string, document_id string, page int, item_type string, text string, row_label string, benefit_tier string, variant string")
    sel = [(0, "D", 1, None, None, "short `5", True, ["benefit_tier"], "ADDON", None), (1, "D", 1, "BULLET", "R", LONG, False, ["variant"], None, None), (2, "D", 1, None, None, "twin", True, [], None, None), (3, "D", 2, None, None, "short `5", True, [], None, None), (4, "D", 1, None, None, LONG[:30], False, [], None, None)]
    s = spark.createDataFrame(sel, "ord int, document_id string, page int, item_type string, row_label string, text_prefix string, exact boolean, fields_set array<string>, new_benefit_tier string, new_variant string")
    assert {(r.selector, r.n) for r in e.unresolved(ev, s).collect()} == {(2, 2), (3, 0), (4, 0)}
    out = {r.evidence_id: r for r in e.overlaid(ev, s.where("ord < 2"), ["benefit_tier", "variant"]).collect()}
    assert (out["EV-1"].benefit_tier, out["EV-1"].variant, out["EV-2"].benefit_tier, out["EV-2"].variant) == ("ADDON", "v", "BASE", None)
    assert all(out[r[0]].text == r[4] for r in rows)
    with pytest.raises(ValueError):
        e.overlaid(ev, s, ["text"])


def test_keys(spark):
    a, b = "a" * 64, "ab" + "0" * 62
    files = spark.createDataFrame([(a, "pa"), (b, "pb")], "sha256 string, path string")
    bundled = spark.createDataFrame([("POL-X", a)], "document_id string, sha256 string")
    keys = spark.createDataFrame([(a,), ("POL-X",), ("POL-UPL-AB0000",), ("POL-UPL-FF",)], "key string")
    assert {r.key: r.path for r in e.resolved_keys(keys, files, bundled).collect()} == {a: "pa", "POL-X": "pa", "POL-UPL-AB0000": "pb", "POL-UPL-FF": None}


def test_logs(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    path.write_text('{"timestamp": "2024-01-01T00:00:00", "run_id": "r", "event": "start", "actor": "system", "payload": {"a": 1}}\n\n  \n{"timestamp": "2024-01-01T00:01:00", "run_id": "r", "event": "end", "actor": "rules", "payload": {}}\n')
    rows = e.read_log(spark, str(path)).collect()
    assert [(r.event, r.payload) for r in rows] == [("start", '{"a":1}'), ("end", "{}")]
    assert e.read_log(spark, str(tmp_path / "none")).count() == 0
    good = spark.createDataFrame([("t", "r", "x", "llm", "{}")], e.LOG)
    sinks.append_log(good, str(tmp_path / "out"))
    sinks.append_log(good, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    with pytest.raises(ValueError):
        sinks.append_log(good.withColumn("actor", F.lit("someone")), str(tmp_path / "out"))


def test_records(spark, tmp_path):
    text = "# T\n\n## MS-001 — First one\n\n| Field | Value |\n|---|---|\n| Status | OK |\n| Words | keep it |\n\n## Other\n\n## MS-002 — Second\n| Field | Value |\n| :-- | --- |\n| Status | CONTEXT |\n"
    rows = {r.record_id: r for r in e.markdown_records(spark.createDataFrame([(text,)], "value string")).collect()}
    assert {k: (r.title, r.fields) for k, r in rows.items()} == {"MS-001": ("First one", {"Status": "OK", "Words": "keep it"}), "MS-002": ("Second", {"Status": "CONTEXT"})}
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7")
    (tmp_path / "b.txt").write_bytes(b"x")
    (tmp_path / "d.pdf").write_bytes(b"%PDF" * 100)
    assert sorted(r.issue or "" for r in e.files(spark, str(tmp_path), 100).collect()) == ["", "NOT_PDF", "TOO_LARGE"]
    old = json.dumps({"facts": [{"fact_id": "f1"}]})
    new = json.dumps({"profile": {"facts": [{"fact_id": "f1"}]}, "exposures": [{"exposure_id": "x", "basis_fact_ids": ["f1", "f2"]}]})
    out = e.profile(spark.createDataFrame([(old,), (new,)], "value string")).collect()
    assert [len(r.exposures) for r in out] == [0, 1] and [r.missing for r in out] == [[], ["f2"]]


def test_yaml(spark):
    pytest.importorskip("yaml")
    table = e.yaml_table(spark, "x:\n- id: A\n  name: n\n- id: B\n", "x", "ord int, id string, name string")
    assert [tuple(r) for r in table.orderBy("ord").collect()] == [(0, "A", "n"), (1, "B", None)]
    with pytest.raises(ValueError):
        e.yaml_table(spark, "x: [{id: A}, {id: A}]", "x", "id string")


def test_reports(spark, tmp_path):
    results = spark.createDataFrame([("c1", "VERIFIED", ["e2", "e9"]), ("c2", "NEEDS_REVIEW", [])], "claim_id string, status string, supporting_evidence_ids array<string>")
    claims = spark.createDataFrame([("c1", "A | b", 1), ("c2", "x", 2)], "claim_id string, text string, ord int")
    ev = spark.createDataFrame([("e2", "D", 3, "quoted", 0, "BULLET"), ("e3", "D", 1, "more", 1, "BULLET")], "evidence_id string, document_id string, page int, text string, ord int, item_type string")
    rows = sinks.report(results, claims, ev)
    assert [r.line for r in sinks.report_markdown(rows).orderBy("ord").collect()] == ["| c1 | VERIFIED | A / b | e2, e9 (missing) |", "| c2 | NEEDS_REVIEW | x |  |"]
    assert [r.line for r in sinks.evidence_dump(ev).orderBy("ord").collect()][0] == "BULLET 2"
    steps = spark.createDataFrame([("r", 0, "a", None, 2.0, "ok", 1), ("r", 1, "b", None, 2.0, "ok", 1), ("r", 2, "c", "a", 9.0, "failed", 0)], "run_id string, index int, name string, parent string, seconds double, status string, model_calls int")
    assert tuple(sinks.timing_report(steps).first()) == ("r", 4.0, "a", 2.0, 1, 2)
    sinks.write_table(ev, str(tmp_path / "t"))
    sinks.write_table(ev.limit(1), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1


def test_streams(spark, tmp_path):
    schema = "timestamp string, run_id string, target_id string, event string, action string"
    rows = [("2024-01-01T00:00:01", "r", "t1", "approve", "APPROVE"), ("2024-01-01T00:03:01", "r", "t1", "edit", "EDIT"), ("2024-01-01T00:30:01", "r", "t2", "approve", "APPROVE")]
    spark.createDataFrame(rows, schema).coalesce(1).write.json(str(tmp_path / "in"))
    events = logs.log_stream(spark, str(tmp_path / "in"), schema)
    for name, frame, mode in (("counts", logs.event_counts(events), "append"), ("state", logs.latest_state(events), "complete")):
        stream = frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        stream.processAllAvailable()
        stream.stop()
    assert {(r.event, r.n) for r in spark.table("counts").collect()} == {("approve", 1), ("edit", 1)}
    assert {(r.target_id, r.action) for r in spark.table("state").collect()} == {("t1", "EDIT"), ("t2", "APPROVE")}
