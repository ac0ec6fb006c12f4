"""``python -m quillstrata.cli``: queries, single writes, reports, exchange and merge of stores.

Exit codes: 0 done, 1 the operation failed, 2 wrong usage.
"""

from __future__ import annotations

import argparse
import json
import socket
import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstrata.operators import merging, reading, reporting, search, writing
from quillstrata.session import get_spark
from quillstrata.sources import exchange
from quillstrata.sources.store import Snapshot, Store, default_path, uuid_v7


#: Verbs that write one thing, with their words; those with ? may be left out.
WRITES = {
    "project-add": ("name", "description?", "status?"),
    "project-set-status": ("name", "status"),
    "observation-add": ("project", "kind", "body", "doi?"),
    "concept-add": ("name", "description?", "identifier_type?", "identifier_value?"),
    "source-add": ("title", "identifier_type?", "identifier_value?", "authors?", "published_date?", "publisher?", "rights?", "version?"),
    "source-remove": ("id",),
    "source-retract": ("id", "note"),
    "link-concept": ("project", "concept"),
    "link-observation": ("observation", "concept"),
    "link-source": ("observation", "source", "relationship?"),
}


def word_default(word: str) -> str:
    return {"status?": "active", "relationship?": "cited"}.get(word, "")


def written(s: Snapshot, args: argparse.Namespace, now: Column) -> tuple[Snapshot, set[str]]:
    """The store after a verb of WRITES, and the tables it touched."""
    spark = s.projects.sparkSession
    fresh = {"uuid": str(spark.range(1).select(uuid_v7(now)).first()[0]), "origin_host": socket.gethostname(), "seq": 1}

    def row(**values: object) -> DataFrame:
        values = fresh | values
        return spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {'long' if isinstance(v, int) else 'string'}" for n, v in values.items()))

    given = vars(args)
    if args.verb == "project-add":
        return writing.upsert_projects(s, row(name=args.name, description=args.description, status=args.status), now), {"projects"}
    if args.verb == "project-set-status":
        return writing.set_status(s, row(name=args.name, status=args.status), now), {"projects"}
    if args.verb == "observation-add":
        return writing.append_observations(s, row(project_id=_project(s, args.project), kind=args.kind, body=args.body, source_doi=args.doi), now), {"observations"}
    if args.verb == "concept-add":
        return writing.upsert_concepts(s, row(**{n.rstrip("?"): given[n.rstrip("?")] for n in WRITES[args.verb]}), now), {"concepts"}
    if args.verb == "source-add":
        return writing.upsert_sources(s, row(**{n.rstrip("?"): given[n.rstrip("?")] for n in WRITES[args.verb]}), now), {"sources"}
    if args.verb == "source-remove":
        return writing.remove_sources(s, row(id=int(args.id))), {"sources"}
    if args.verb == "source-retract":
        return writing.retract_sources(s, row(id=int(args.id), note=args.note)), {"sources"}
    if args.verb == "link-source":
        return writing.link(s, "observation_sources", row(observation_id=int(args.observation), source_id=int(args.source), relationship=args.relationship)), {"observation_sources"}
    concept = reading.concept_by_name(s, args.concept).first()
    if concept is None:
        raise reading.NotFound(f"no such concept: {args.concept}")
    if args.verb == "link-concept":
        return writing.link(s, "project_concepts", row(project_id=_project(s, args.project), concept_id=concept.id)), {"project_concepts"}
    return writing.link(s, "observation_concepts", row(observation_id=int(args.observation), concept_id=concept.id)), {"observation_concepts"}


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="quillstrata")
    parser.add_argument("--store", default=default_path("."))
    parser.add_argument("--master", default=None)
    parser.add_argument("--json", action="store_true")
    verbs = parser.add_subparsers(dest="verb", required=True)
    for name in ("projects", "concepts", "sources", "summary", "counts"):
        verbs.add_parser(name)
    verbs.add_parser("search").add_argument("term", nargs="+")
    for name, words in WRITES.items():
        write = verbs.add_parser(name)
        for word in words:
            write.add_argument(f"--{word[:-1]}", default=word_default(word)) if word.endswith("?") else write.add_argument(word)
    verbs.add_parser("observations").add_argument("project")
    verbs.add_parser("format").add_argument("project", nargs="?")
    export = verbs.add_parser("export")
    export.add_argument("path")
    export.add_argument("--project")
    verbs.add_parser("import").add_argument("path")
    merge = verbs.add_parser("merge")
    for flag in ("-a", "-b", "-o"):
        merge.add_argument(flag, required=True)
    merge.add_argument("--force", action="store_true")
    return parser


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = get_spark("quillstrata", args.master)
    try:
        return _run(spark, args)
    except (LookupError, ValueError, RuntimeError) as error:
        print(error, file=sys.stderr)
        return 1


def _show(rows, as_json: bool) -> None:
    for row in rows.toLocalIterator():
        print(json.dumps(row.asDict(), default=str, ensure_ascii=False) if as_json else "\t".join("" if v is None else str(v) for v in row))


def _project(s, name: str) -> int:
    row = reading.project_by_name(s, name).first()
    if row is None:
        raise reading.NotFound(f"no such project: {name}")
    return row.id


def _run(spark, args) -> int:
    if args.verb == "merge":
        merged, summary = merging.merge_stores(Store(spark, args.a).read(), Store(spark, args.b).read(), args.force)
        target = Store(spark, args.o)
        if target.version():
            raise writing.Refused(f"{args.o} holds a store already")
        target.write(merged)
        _show(summary.orderBy("nth"), args.json)
        return 0
    store = Store(spark, args.store)
    at = store.version()
    s = store.read(at)
    if args.verb in WRITES:
        after, changed = written(s, args, F.date_trunc("second", F.current_timestamp()))
        print(store.write(after, changed, at))
    elif args.verb == "search":
        _show(search.search(s, " ".join(args.term)).orderBy("nth"), args.json)
    elif args.verb == "summary":
        print(reporting.summary(s), end="")
    elif args.verb == "format":
        print(reporting.markdown(s, _project(s, args.project) if args.project else None), end="")
    elif args.verb == "observations":
        _show(reading.observations_of(s, _project(s, args.project)).orderBy("nth"), args.json)
    elif args.verb == "export":
        print(exchange.write_lines(s, args.path, args.project))
    elif args.verb == "import":
        grown, summary = exchange.import_lines(s, exchange.read_lines(spark, args.path))
        store.write(grown)
        _show(summary.orderBy("nth"), args.json)
    else:
        _show({"projects": reading.projects, "concepts": reading.concepts, "sources": reading.sources, "counts": reading.table_counts}[args.verb](s), args.json)
    return 0


if __name__ == "__main__":
    sys.exit(main())
