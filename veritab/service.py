"""The engine's service operations: documents, templates, mappings, datasets, runs.

Each public method is one request of the service API; errors carry an HTTP-like status.
"""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

from veritab.operators import profile, report, review, suggest
from veritab.operators.reconcile import reconcile
from veritab.plans.config import AS_OF, ENGINE_VERSION, resolve
from veritab.sources import spec, tables
from veritab.sources.store import MemoryStore, Run, Store


CANCELLED = "cancelled"


class ServiceError(Exception):
    def __init__(self, status: int, message: str) -> None:
        super().__init__(message)
        self.status = status


def _id() -> str:
    return str(uuid.uuid4())


class Service:
    def __init__(self, spark: SparkSession, store: Store | None = None, extractors: dict | None = None, ocr: spec.Ocr | None = None, workers: int = 4) -> None:
        """workers: background runs at one time; in a scheduler pool named runs, which shares fairly where the cluster's scheduler does."""
        self.spark, self.store, self.ocr = spark, store or MemoryStore(), ocr
        self.extractors = extractors or {"default": spec.SectionExtractor(), "section": spec.SectionExtractor()}
        self.datasets: dict[str, dict] = {}
        self.documents: dict[str, spec.Document] = {}
        self.extraction_runs: dict[str, dict] = {}
        self.suggestions: dict[str, suggest.Graph] = {}
        self.kept = {kind: self.store.artifacts(kind) for kind in ("template", "mapping", "code_list")}
        self._workers, self._jobs, self._cancelled = ThreadPoolExecutor(max_workers=workers), {}, set()

    def _keep(self, kind: str, body: dict, key: str | None = None) -> str:
        key = key or _id()
        self.kept[kind][key] = body
        self.store.put_artifact(kind, key, body)
        return key

    @staticmethod
    def _find(where: dict, key: str, what: str):
        if key not in where:
            raise ServiceError(404, f"{what} not found")
        return where[key]

    def health(self) -> dict:
        return {"status": "ok", "store": type(self.store).__name__}

    # -- registration
    def create_template(self, body: dict) -> dict:
        return {"id": self._keep("template", body), "version": body.get("version")}

    def create_mapping(self, body: dict) -> dict:
        return {"id": self._keep("mapping", body)}

    def create_code_lists(self, body: dict) -> dict:
        return {"id": self._keep("code_list", body), "lists": list(body)}

    def create_dataset(self, role: str, name: str, path: str) -> dict:
        if role not in ("SOURCE", "DESTINATION"):
            raise ServiceError(400, "role must be SOURCE or DESTINATION")
        frame = tables.read_csv(self.spark, path)
        key = _id()
        found = {r["column_name"]: r["kind"] for r in profile.inferred(profile.kinds(frame)).collect()} if frame.columns else {}
        columns = [c | {"kind": found[c["column_name"]]} for c in profile.samples(frame)]
        self.datasets[key] = {"id": key, "role": role, "name": name, "path": path, "status": "READY", "columns": columns}
        return self.datasets[key]

    def dataset_schema(self, dataset_id: str) -> list[dict]:
        return self._find(self.datasets, dataset_id, "dataset")["columns"]

    # -- specification documents
    def create_document(self, document: spec.Document) -> dict:
        key = _id()
        self.documents[key] = document
        return {"id": key, "pages": len(document.pages), "is_scanned": document.is_scanned, "file_hash": document.file_hash}

    def extract(self, document_id: str, template_key: str = "extracted", extractor: str = "default") -> dict:
        document = self._find(self.documents, document_id, "document")
        if extractor not in self.extractors:
            raise ServiceError(400, f"unknown extractor {extractor!r}")
        document = spec.with_ocr(document, document_id, self.ocr)
        try:
            result = self.extractors[extractor].extract(document)
        except ValueError as e:
            raise ServiceError(422, str(e)) from e
        run = spec.extraction_run(result, document)
        self.extraction_runs[run["run_id"]] = run
        template = spec.draft_template(result, document, run["run_id"], template_key)
        return {"template_id": self._keep("template", template), "status": template["status"], "extraction_run": run, "pending_review": review.pending(template)}

    def review_template(self, template_id: str) -> dict:
        t = self._find(self.kept["template"], template_id, "template")
        return {"status": t.get("status"), "pending_review": review.pending(t), "fields": t.get("fields"), "rules": t.get("rules")}

    def approve_template(self, template_id: str, approver: str = "system") -> dict:
        t = self._find(self.kept["template"], template_id, "template")
        self._require_unlocked(t)
        t = review.approve_all(t, approver)
        self._keep("template", t, template_id)
        return {"status": t["status"], "pending_review": review.pending(t)}

    def reject(self, template_id: str, key: str) -> dict:
        """Rejects one field or rule of a draft."""
        t = self._find(self.kept["template"], template_id, "template")
        self._require_unlocked(t)
        try:
            review.reject(t, key)
        except ValueError as e:
            raise ServiceError(404, str(e)) from e
        self._keep("template", t, template_id)
        return {"status": t.get("status"), "pending_review": review.pending(t)}

    def update_template(self, template_id: str, body: dict) -> dict:
        """A new text of a template; an approved one is locked, a changed one needs a version of its own."""
        self._require_unlocked(self._find(self.kept["template"], template_id, "template"))
        return {"id": self._keep("template", body, template_id), "version": body.get("version")}

    @staticmethod
    def _require_unlocked(template: dict) -> None:
        try:
            review.require_unlocked(template)
        except ValueError as e:
            raise ServiceError(409, str(e)) from e

    # -- mapping suggestion
    def suggest_mapping(self, template_id: str, source_dataset_id: str, dest_dataset_id: str) -> dict:
        template = self._find(self.kept["template"], template_id, "template")
        source, dest = (self._find(self.datasets, d, "dataset") for d in (source_dataset_id, dest_dataset_id))
        key = _id()
        self.suggestions[key] = suggest.suggest(template, source["columns"], dest["columns"], source_dataset_id, dest_dataset_id)
        return {"suggestion_id": key} | self.suggestion(key)

    def suggestion(self, suggestion_id: str) -> dict:
        graph = self._find(self.suggestions, suggestion_id, "suggestion")
        return {"pending": review.pending_edges(graph), "graph": graph.as_dict()}

    def approve_suggestion(self, suggestion_id: str, reject_ids: list[str] | None = None, name: str = "suggested") -> dict:
        graph = review.approve_edges(self._find(self.suggestions, suggestion_id, "suggestion"), reject_ids)
        mapping = suggest.to_mapping(graph, name)
        if not mapping["key_pairs"]:
            raise ServiceError(422, "approved mapping has no key fields")
        return {"mapping_id": self._keep("mapping", mapping), "mapping": mapping}

    # -- runs
    def start_run(self, template_id: str, mapping_id: str, source_dataset_id: str, dest_dataset_id: str, code_lists_id: str | None = None, as_of_date: str = AS_OF, engine_version: str = ENGINE_VERSION, background: bool = False) -> dict:
        template, mapping = (self._find(self.kept[kind], key, kind) for kind, key in (("template", template_id), ("mapping", mapping_id)))
        source, dest = (self._find(self.datasets, d, "dataset") for d in (source_dataset_id, dest_dataset_id))
        codes = self.kept["code_list"].get(code_lists_id, {}) if code_lists_id else {}
        try:
            review.require_approved(template)
        except ValueError as e:
            raise ServiceError(422, str(e)) from e
        run = Run(template_id, mapping_id, source_dataset_id, dest_dataset_id, engine_version, as_of_date)
        self.store.create_run(run)

        def work() -> None:
            context = self.spark.sparkContext
            context.setJobGroup(run.run_id, f"run {run.run_id}", interruptOnCancel=True)
            context.setLocalProperty("spark.scheduler.pool", "runs" if background else None)
            planned = None
            try:
                self._go_on(run.run_id)
                self.store.mark_running(run.run_id)
                config = resolve(template, mapping, codes, as_of_date, engine_version)
                own = SparkSession(context, self.spark._jsparkSession.cloneSession())  # planning sets an option of its session
                planned = reconcile(config, *(tables.read_csv(own, d["path"]) for d in (source, dest))).persist()
                self._go_on(run.run_id)
                self.store.save_results(run.run_id, planned.field_results, planned.record_rollup)
                self.store.mark_completed(run.run_id)
            except Exception as e:  # noqa: BLE001  whatever it is, the run has failed and says why
                self.store.mark_failed(run.run_id, CANCELLED if run.run_id in self._cancelled else str(e))
            finally:
                if planned is not None:
                    planned.unpersist()
                context.setLocalProperty("spark.jobGroup.id", None)

        if background:
            self._jobs[run.run_id] = self._workers.submit(inheritable_thread_target(self.spark)(work))
            return run.as_dict()
        work()
        done = self.store.get_run(run.run_id)
        if done.status == "FAILED":
            raise ServiceError(422, f"run failed: {done.error_message}")
        return done.as_dict()

    def _go_on(self, run_id: str) -> None:
        if run_id in self._cancelled:
            raise RuntimeError(CANCELLED)

    def wait(self, run_id: str, seconds: float | None = None) -> dict:
        """A background run once it has ended."""
        if run_id in self._jobs:
            self._jobs[run_id].result(seconds)
        return self.run(run_id)

    def cancel(self, run_id: str) -> dict:
        """Ends a background run, whose record says so; what other runs do goes on.  409 if it has ended already."""
        if self.run(run_id)["status"] not in ("QUEUED", "RUNNING") or run_id not in self._jobs:
            raise ServiceError(409, "run is not in progress")
        self._cancelled.add(run_id)
        if self._jobs[run_id].cancel():  # it was still waiting
            self.store.mark_failed(run_id, CANCELLED)
        else:
            self.spark.sparkContext._jsc.sc().cancelJobGroupAndFutureJobs(run_id)  # jobs that it has yet to start, too
        return self.run(run_id)

    def progress(self, run_id: str) -> dict:
        """status, and how many tasks of the run's jobs so far are done, of how many."""
        tracker, done, tasks = self.spark.sparkContext.statusTracker(), 0, 0
        for job in tracker.getJobIdsForGroup(run_id):
            for stage in (found.stageIds if (found := tracker.getJobInfo(job)) else ()):
                if info := tracker.getStageInfo(stage):
                    done, tasks = done + info.numCompletedTasks, tasks + info.numTasks
        return {"status": self.run(run_id)["status"], "tasks_done": done, "tasks": tasks}

    def runs(self) -> list[dict]:
        return [r.as_dict() for r in self.store.list_runs()]

    def run(self, run_id: str) -> dict:
        found = self.store.get_run(run_id)
        if found is None:
            raise ServiceError(404, "run not found")
        return found.as_dict()

    def results(self, run_id: str, category: str | None = None, field_key: str | None = None, page: int = 1, page_size: int = 50) -> dict:
        self.run(run_id)
        try:
            total, items = self.store.results(run_id, category, field_key, page, page_size)
        except ValueError as e:
            raise ServiceError(422, str(e)) from e
        return {"total": total, "page": page, "page_size": page_size, "items": items}

    def export(self, run_id: str, path: str, format: str = "xlsx") -> str:
        """The report as a workbook, or as CSV folders."""
        writer = report.write_csv if format == "csv" else report.write_excel
        return writer(self.run(run_id), report.drilldown(self.store.rows(run_id)), path)
