import json
import time

import golden
import pytest

from veritab.operators import review, suggest
from veritab.service import Service, ServiceError
from veritab.sources import spec
from veritab.sources.store import MemoryStore, ParquetStore
from veritab.sources.tables import read_csv, sniff, write_csv


@pytest.fixture(scope="module")
def paths(tmp_path_factory):
    return golden.write(tmp_path_factory.mktemp("files"))


def ready(spark, paths, store=None, **more):
    service = Service(spark, store, **more)
    source, dest = service.create_dataset("SOURCE", "s", paths[0])["id"], service.create_dataset("DESTINATION", "d", paths[1])["id"]
    return service, source, dest, service.create_code_lists(golden.CODES)["id"]


@pytest.mark.parametrize("kind", ["memory", "parquet"])
def test_run_and_reopen(spark, paths, tmp_path, kind):
    store = MemoryStore() if kind == "memory" else ParquetStore(spark, str(tmp_path / "store"))
    service, source, dest, codes = ready(spark, paths, store)
    template, mapping = service.create_template(golden.TEMPLATE)["id"], service.create_mapping(golden.MAPPING)["id"]
    run = service.start_run(template, mapping, source, dest, codes, golden.AS_OF)
    assert run["status"] == "COMPLETED" and run["summary"] == golden.SUMMARY
    assert run["by_field"] == {"seats": 1, "cabin": 1, "load": 2, "cross:paid_adds_up": 2} and run["by_severity"] == {"ERROR": 3, "WARNING": 3}
    again = Service(spark, ParquetStore(spark, str(tmp_path / "store"))) if kind == "parquet" else service
    assert again.run(run["run_id"])["summary"] == golden.SUMMARY
    page = again.results(run["run_id"], category="MISMATCH")
    assert page["total"] == 4 and {r["field_key"] for r in page["items"]} == {"seats", "cabin", "load", "cross:paid_adds_up"}
    assert [r["run_id"] for r in again.runs()] == [run["run_id"]]
    assert again.kept["template"][template]["version"] == "1.0.0"
    assert dict(map(tuple, again.store.rollup(run["run_id"]).collect())) == golden.ROLLUP
    again.export(run["run_id"], str(tmp_path / "report"), "csv")
    with pytest.raises(ServiceError):
        again.results(run["run_id"], page_size=1001)
    with pytest.raises(ServiceError):
        again.run("nope")


def test_background_and_failed_runs(spark, paths):
    service, source, dest, codes = ready(spark, paths)
    template, mapping = service.create_template(golden.TEMPLATE)["id"], service.create_mapping(golden.MAPPING)["id"]
    run = service.start_run(template, mapping, source, dest, codes, golden.AS_OF, background=True)
    assert run["status"] == "QUEUED"
    assert service.wait(run["run_id"], 120)["status"] == "COMPLETED"
    progress = service.progress(run["run_id"])
    assert progress["status"] == "COMPLETED" and 0 < progress["tasks_done"] <= progress["tasks"]
    with pytest.raises(ServiceError, match="run failed") as failed:
        service.start_run(template, mapping, source, dest)  # no code list
    assert failed.value.status == 422 and service.runs()[0]["status"] == "FAILED"


def test_specification_to_report(spark, paths):
    service, source, dest, codes = ready(spark, paths, ocr=spec.CannedOcr([golden.SPEC]))
    scanned = service.create_document(spec.Document.of_texts([" "]))
    assert scanned["is_scanned"]
    draft = service.extract(scanned["id"])
    assert draft["status"] == "DRAFT" and draft["pending_review"]["total_pending"] == 14
    assert draft["pending_review"]["low_confidence"] == ["rule:seats_cross_field"]
    suggestion = service.suggest_mapping(draft["template_id"], source, dest)
    keys = {e["to_node"] for e in suggestion["graph"]["edges"] if e["is_key"]}
    assert "src_TICKET" in keys
    approved = service.approve_suggestion(suggestion["suggestion_id"])
    assert len(approved["mapping"]["key_pairs"]) == 1 and len(approved["mapping"]["field_bindings"]) == 7
    args = (draft["template_id"], approved["mapping_id"], source, dest, codes, golden.AS_OF)
    with pytest.raises(ServiceError, match="not fully approved"):
        service.start_run(*args)
    service.approve_template(draft["template_id"])
    untrimmed = {"mismatch_count": 3, "match_count": 10}  # a suggestion has no transforms
    assert service.start_run(*args)["summary"] == golden.SUMMARY | untrimmed
    with pytest.raises(ServiceError, match="no key fields"):
        service.approve_suggestion(suggestion["suggestion_id"], [e["id"] for e in suggestion["graph"]["edges"] if e["is_key"]])


def test_scanned_without_ocr_and_unknown_things(spark, paths):
    service, *_ = ready(spark, paths)
    document = service.create_document(spec.Document.of_texts([""]))["id"]
    with pytest.raises(ServiceError, match="OCR"):
        service.extract(document)
    for call in (lambda: service.extract("x"), lambda: service.extract(document, extractor="x"), lambda: service.create_dataset("X", "n", paths[0]), lambda: service.dataset_schema("x")):
        with pytest.raises(ServiceError):
            call()
    assert service.health()["status"] == "ok"


def test_section_extraction():
    found = spec.SectionExtractor().extract(spec.Document.of_texts([golden.SPEC, "odd | BLOB | \n a :: MAGIC x=1.5 y=true z=-3 w=t"]))
    assert len(found.fields) == 7 and len(found.rules) == 8
    cabin = found.fields[1]
    assert (cabin.datatype, cabin.enum_code_list, cabin.required, cabin.confidence) == ("ENUM", "CABINS", True, 0.9)
    odd = found.rules[-1]
    assert (odd.type, odd.params, odd.severity, odd.confidence) == ("EQUALITY", {"x": 1.5, "y": True, "z": -3, "w": "t"}, "ERROR", 0.5)


#: A family of specifications made up for this test.
ROW = r"(?P<name>.+?) (?:(?P<need>Must|May) )?(?P<char>A/N|AN|A|N) (?:(?P<lentype>[FV]) )?(?P<length>\d+) (?P<text>.*)"
FORMAT = spec.TableFormat(
    segments={"Parcel part": ("pc", "tagged"), "Closing part": ("cl", "fixed")},
    kinds={"tagged": rf"(?P<tag>[A-Z]{{2}}|\d\d) {ROW}", "fixed": r"(?P<position>\d+) (?P<name>.+?) (?P<char>A/N|AN|A|N) (?P<length>\d+) (?P<text>.*)"},
    begins={"tagged": r"([A-Z]{2}|\d\d) [A-Za-z]", "fixed": r"\d+ [A-Za-z]"},
    furniture=["^sheet ", "for depots only"],
    mandatory=("must",),
    optional=("blanks",),
    amounts=("fee",),
    dates={"yyyymmdd": "%Y%m%d"},
)
TABLE = """Preface
01 Not a row Must AN V 5 before any title
Parcel  Part
PC Opening Must A/N F 4 Holds P001.
01 Parcel number Must AN V 25
as printed on the label
Sheet 7
09 Sent on May N F 8 As YYYYMMDD.
12 Handling fee May N V 9 In cents.
13 X May N V 9 Too short a name.
12 Handling fee May N V 9 Again.
Closing part
1 Opening A 4 Holds the word.
For depots only
5 Spare A/N 10 Fill with blanks.
999 Far away A 1 Beyond the last position.
"""


def test_table_extraction():
    document = spec.Document.of_texts(TABLE.split("Sheet 7\n"))
    found = spec.TableExtractor(FORMAT).extract(document)
    assert [f.field_key for f in found.fields] == ["pc.opening", "pc.parcel_number", "pc.sent_on", "pc.handling_fee", "cl.opening", "cl.spare"]
    assert [f.datatype for f in found.fields] == ["STRING", "STRING", "DATE", "DECIMAL", "STRING", "STRING"]
    assert [f.citation.page for f in found.fields] == [1, 1, 2, 2, 2, 2] and found.fields[1].citation.source_text.endswith("as printed on the label")
    assert {r.rule_key for r in found.rules} == {"pc.opening__not_null", "pc.parcel_number__not_null", "pc.sent_on__date_valid", "cl.opening__not_null"}
    layout = spec.layout_of(document, FORMAT)
    assert layout["pc"]["fmt"] == "tagged" and layout["cl"]["fields"][1]["position"] == 5 and layout["pc"]["fields"][1] == {"field_key": "pc.parcel_number", "tag": "01", "position": None, "char": "A/N", "length": 25, "lentype": "V"}


def test_locked_templates_stay(spark, paths):
    service, *_ = ready(spark, paths)
    key = service.extract(service.create_document(spec.Document.of_texts([golden.SPEC]))["id"])["template_id"]
    assert service.reject(key, "load_tolerance")["pending_review"]["total_pending"] == 13
    service.update_template(key, service.kept["template"][key] | {"note": "still a draft"})
    service.approve_template(key)
    for change in (lambda: service.update_template(key, {}), lambda: service.reject(key, "load_tolerance"), lambda: service.approve_template(key)):
        with pytest.raises(ServiceError, match="published") as refused:
            change()
        assert refused.value.status == 409
    assert service.kept["template"][key]["note"] == "still a draft"


def test_review():
    template = {"fields": [{"field_key": "a", "review_status": "SUGGESTED", "confidence": 0.0}], "rules": [{"rule_id": "r", "review_status": "SUGGESTED", "confidence": 0.5}]}
    assert review.pending(template)["low_confidence"] == ["rule:r"]
    review.reject(template, "r")
    assert review.pending(template)["total_pending"] == 1
    review.approve_all(template)
    assert template["locked"] and template["rules"][0]["review_status"] == "REJECTED"
    with pytest.raises(ValueError):
        review.require_unlocked(template)


def test_similarity():
    assert suggest.similarity("account_no", "ACCOUNT-NO") == 1.0
    assert suggest.best_column("zzz", "STRING", [{"column_name": "abc", "sample_values": []}]) is None
    assert suggest.best_column("rate", "DECIMAL", [{"column_name": "RATE", "sample_values": ["1", "2.5"]}])[1:] == (1.0, "name similarity 1.00, datatype compatible")


def test_csv(spark, tmp_path):
    assert sniff(["a;b;c", "1;2,5;3"]) == ";" and sniff(["a"]) == ","
    path = tmp_path / "x.csv"
    path.write_text('a.b;c\n"";NULL\n"x;y";"say ""hi"""\n')
    rows = read_csv(spark, str(path)).collect()
    assert [tuple(r) for r in rows] == [(None, "NULL"), ("x;y", 'say "hi"')]
    write_csv(read_csv(spark, str(path)), str(tmp_path / "out"), ["c", "nope", "a.b"])
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).columns == ["c", "nope", "a.b"]
    path.write_text('k,t\n1,"x\ny"\n2,"say ""z"""\n')
    assert [tuple(r) for r in read_csv(spark, str(path)).collect()] == [("1", "x\ny"), ("2", 'say "z"')]
    path.write_text("a,a\n1,2\n")
    with pytest.raises(ValueError, match="repeated"):
        read_csv(spark, str(path))


def test_command_line(spark, paths, tmp_path, capsys):
    from veritab.__main__ import main

    for name, body in (("template", golden.TEMPLATE), ("mapping", golden.MAPPING), ("codes", golden.CODES)):
        (tmp_path / f"{name}.json").write_text(json.dumps(body))
    args = ["--template", str(tmp_path / "template.json"), "--mapping", str(tmp_path / "mapping.json"), "--code-lists", str(tmp_path / "codes.json"), "--source", paths[0], "--dest", paths[1], "--as-of", golden.AS_OF]
    assert main([*args, "--json", "--dump-plan", str(tmp_path / "plan"), "--out", str(tmp_path / "out")]) == 0
    assert json.loads(capsys.readouterr().out)["summary"] == golden.SUMMARY
    assert "Physical Plan" in (tmp_path / "plan").read_text()
    assert main(args) == 0 and "MISSING_IN_DEST" in capsys.readouterr().out


def test_cancelled_runs(spark, paths, tmp_path, monkeypatch):
    """A run that is cancelled fails and says so while another goes on; one that still waits never starts."""
    from veritab.sources import tables

    slow, plain = str(tmp_path / "slow.csv"), tables.read_csv
    with open(paths[0]) as f, open(slow, "w") as out:
        out.write(f.read())

    def sleepy(session, path, *more):
        table = plain(session, path, *more)
        return table.mapInArrow(lambda batches: (b for b in batches if not time.sleep(20)), table.schema) if path == slow else table

    service, source, dest, codes = ready(spark, paths, workers=2)
    slow_source = service.create_dataset("SOURCE", "slow", slow)["id"]
    monkeypatch.setattr(tables, "read_csv", sleepy)
    template, mapping = service.create_template(golden.TEMPLATE)["id"], service.create_mapping(golden.MAPPING)["id"]
    start = lambda s: service.start_run(template, mapping, s, dest, codes, golden.AS_OF, background=True)["run_id"]
    one, other = start(slow_source), start(slow_source)
    waiting, good = start(slow_source), start(source)
    assert service.cancel(waiting)["status"] == "FAILED"
    deadline = time.time() + 60
    while service.progress(one)["tasks"] == 0 and time.time() < deadline:
        time.sleep(0.2)
    service.cancel(one)
    assert (service.wait(one, 60)["status"], service.run(one)["error_message"]) == ("FAILED", "cancelled")
    assert service.wait(good, 120)["summary"] == golden.SUMMARY and service.run(other)["status"] == "RUNNING"
    service.cancel(other)
    assert service.wait(other, 60)["error_message"] == service.run(waiting)["error_message"] == "cancelled"
    with pytest.raises(ServiceError, match="not in progress") as refused:
        service.cancel(good)
    assert refused.value.status == 409
