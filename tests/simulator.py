"""The model rules applied one event at a time in plain Python, to check the set-based plans."""

from __future__ import annotations

from dataclasses import dataclass, field

FINAL = {"COMPLETE", "FAIL", "FAILED", "ABORT", "ABORTED"}
NO_SCHEMA: tuple = ()


def split_name(name):
    parts = (name or "unknown.unknown_table").split(".")
    return parts[0], parts[1] if len(parts) > 2 else "public", parts[-1]


def qualified(name):
    return ".".join(split_name(name))


def datasets(items):
    for item in items or []:
        listed = ((item.get("facets") or {}).get("schema") or {}).get("fields") or []
        yield qualified(item.get("name")), tuple((f["name"], f.get("type") or "unknown") for f in listed if f.get("name"))


def lineage(outputs):
    rows = []

    def add(table, attribute, field_, scope):
        if not field_.get("name") or not field_.get("field"):
            return
        for t in field_.get("transformations") or []:
            if isinstance(t, dict):
                upper = lambda v: None if v is None else str(v).upper()
                mask = t.get("masking")
                rows.append(
                    (table, attribute, field_["name"], field_["field"], upper(t.get("type")), upper(t.get("subtype")),
                     t.get("description"), mask if isinstance(mask, bool) else None, scope)
                )

    for out in outputs or []:
        facet = (out.get("facets") or {}).get("columnLineage") or {}
        table = out.get("name") or "unknown_table"
        for attribute, entry in (facet.get("fields") or {}).items():
            for f in entry.get("inputFields") or []:
                add(table, attribute, f, "FIELD")
        for f in facet.get("dataset") or []:
            add(table, "__dataset__", f, "DATASET")
    return rows


@dataclass
class Simulator:
    """Tables, jobs and transformation sets after a list of (seq, event) applied in order."""

    tables: dict = field(default_factory=dict)  # name -> list of schemas, one per version
    closed: set = field(default_factory=set)  # names whose last version is closed
    jobs: dict = field(default_factory=dict)  # name -> list of signatures
    sets: dict = field(default_factory=dict)  # (job, version) -> list of sorted rows
    links: dict = field(default_factory=dict)  # seq -> (job, version)
    stored: list = field(default_factory=list)  # (seq, job, version, set number, row)

    def upsert(self, name, schema):
        versions = self.tables.setdefault(name, [])
        open_ = bool(versions) and name not in self.closed
        if not open_ or (schema and versions[-1] != schema):
            versions.append(schema)
            self.closed.discard(name)
        return len(versions)

    def resolve(self, table, attribute):
        versions = self.tables.get(table)
        if not versions or table in self.closed or attribute not in {n for n, _ in versions[-1]}:
            return None
        return table, len(versions), attribute

    def apply(self, seq, event):
        if event.get("eventType") not in FINAL or not event.get("outputs"):
            return
        used = {("input", t, self.upsert(t, s)) for t, s in datasets(event.get("inputs"))}
        used |= {("output", t, self.upsert(t, s)) for t, s in datasets(event["outputs"])}
        job = event["job"]
        sql = ((job.get("facets") or {}).get("sql") or {})
        signature = (sql.get("query"), sql.get("dialect"), tuple(sorted(used)))
        versions = self.jobs.setdefault(job.get("name") or "unknown_job", [])
        if not versions or versions[-1] != signature:
            versions.append(signature)
        key = (job.get("name") or "unknown_job", len(versions))
        self.links[seq] = key
        parsed = lineage(event["outputs"])
        if not parsed:
            return
        rows = []
        for out_t, out_a, in_t, in_a, *rest in parsed:
            target = self.resolve(out_t, out_a)
            if target is not None:
                rows.append((self.resolve(in_t, in_a), target, *rest))
        rows.sort(key=repr)
        kept = self.sets.setdefault(key, [])
        if (kept[-1] if kept else []) != rows:
            kept.append(rows)
            self.stored += [(seq, *key, len(kept), row) for row in rows]
