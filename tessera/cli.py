"""Command line: update, import, matrix, candidates-build, search, stream, start, work, poll, cancel, status, stats, metrics, errors, verify, repair-truncated, replicate, inventory-compare, metadata-upgrade, scope.

Every command prints JSON, one object a line.  Models are named as
``module:attribute``: the encoder (an object, or a class or function that makes
one for a dimension) has ``text_vecs``, the scorer takes pairs of query and text.
"""

from __future__ import annotations

import argparse
import importlib
import json
import os
import subprocess
import sys
from dataclasses import fields
from pathlib import Path

from .engine import Index, Request
from .sources.imports import admitted, check_scopes, load_scopes, save_scopes


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera", description="A document index on Spark")
    p.add_argument("--index", required=True, help="folder of the index, shared by the driver and all executors")
    p.add_argument("--dim", type=int, default=384)
    p.add_argument("--scopes", help="file with the configuration of scopes")
    p.add_argument("--encoder", help="module:attribute of the encoder")
    p.add_argument("--scorer", help="module:attribute of the reranker's scorer")
    sub = p.add_subparsers(dest="command", required=True)
    up = sub.add_parser("update")
    up.add_argument("roots", nargs="+")
    up.add_argument("--names-only", action="store_true")
    up.add_argument("--max-files", type=int, default=0)
    up.add_argument("--batch-files", type=int, default=0)
    up.add_argument("--exclude", action="append", default=[])
    im = sub.add_parser("import")
    im.add_argument("source")
    im.add_argument("--model", required=True)
    im.add_argument("--root", required=True)
    m = sub.add_parser("matrix")
    m.add_argument("--dtype", choices=["int8", "int4", "fp16"], default="int8")
    m.add_argument("--full", action="store_true")
    for name in ("search", "stream", "start"):
        s = sub.add_parser(name)
        s.add_argument("query")
        s.add_argument("--top-k", type=int, default=12)
        s.add_argument("--kind", default="all")
        s.add_argument("--scope", action="append", dest="in_scopes", default=[])
        for o in ("after", "before", "path"):
            s.add_argument(f"--{o}")
        for o in ("keyword-only", "names-only", "require-all", "early", "deep", "rerank", "deltas"):
            s.add_argument(f"--{o}", action="store_true")
        for o in ("expansions", "lexical-queries", "semantic-queries"):
            s.add_argument(f"--{o}", action="append", default=[])
        s.add_argument("--rerank-limit", type=int, default=36)
        s.add_argument("--rerank-mix", type=float, default=1.0)
        s.add_argument("--max-seconds", type=float)
        s.add_argument("--emit-seconds", type=float, default=0.0)
        if name != "start":
            s.add_argument("--refresh", action="store_true", help="repair a few files beside the search")
    sub.add_parser("work").add_argument("job")
    q = sub.add_parser("poll")
    q.add_argument("job")
    q.add_argument("--after", type=int, default=0)
    q.add_argument("--limit", type=int, default=32)
    sub.add_parser("cancel").add_argument("job")
    for name in ("status", "stats", "metrics", "verify", "candidates-build", "repair-truncated", "metadata-upgrade"):
        sub.add_parser(name)
    sub.add_parser("errors").add_argument("--run", type=int)
    sub.add_parser("replicate").add_argument("target")
    sub.add_parser("inventory-compare").add_argument("other")
    sc = sub.add_parser("scope")
    sc.add_argument("name")
    sc.add_argument("root")
    sc.add_argument("--priority", type=int, default=100)
    sc.add_argument("--offline", action="store_true")
    return p


def request_of(a: argparse.Namespace) -> Request:
    values = {f.name: getattr(a, f.name) for f in fields(Request) if hasattr(a, f.name) and f.name != "scopes"}
    return Request.of({**values, "scopes": a.in_scopes})


def named(name: str | None, dim: int | None = None):
    """The object that module:attribute names; called with the dimension if it can make an encoder."""
    if name is None:
        return None
    module, _, attribute = name.partition(":")
    found = getattr(importlib.import_module(module), attribute)
    return found(dim) if dim is not None and callable(found) and not hasattr(found, "text_vecs") or isinstance(found, type) else found


def detached(a: argparse.Namespace, job: str) -> None:
    """A process of its own for a job, which goes on when this one has ended."""
    options = [x for n in ("scopes", "encoder", "scorer") if (v := getattr(a, n)) for x in (f"--{n}", v)]
    command = [sys.executable, "-m", "tessera.cli", "--index", a.index, "--dim", str(a.dim), *options, "work", job]
    quiet = {"stdin": subprocess.DEVNULL, "stdout": subprocess.DEVNULL, "stderr": subprocess.DEVNULL}
    subprocess.Popen(command, start_new_session=True, env={**os.environ, "PYTHONPATH": os.pathsep.join(filter(None, [str(Path(__file__).resolve().parents[1]), os.environ.get("PYTHONPATH")]))}, **quiet)


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    show = lambda x: print(json.dumps(x, ensure_ascii=False, default=str), flush=True)
    scopes = load_scopes(a.scopes) if a.scopes else check_scopes({"version": 1, "collections": {}})
    if a.command == "scope":
        scopes["collections"][a.name] = {"root": a.root, "priority": a.priority, "searchable": not a.offline}
        save_scopes(scopes, a.scopes)
        show({"scopes": len(scopes["collections"])})
        return 0
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("tessera").getOrCreate()
    index = Index(spark, a.index, dim=a.dim, scopes=scopes, encoder=named(a.encoder, a.dim), scorer=named(a.scorer))
    if a.command in ("search", "stream", "start"):
        request = request_of(a)
        admitted(a.in_scopes, scopes)
        if a.command == "start":
            job = index.submit(request)
            detached(a, job)
            show({"job": job})
            return 0
        last: list[dict] = []
        for e in index.search_with_refresh(request) if a.refresh else index.stream(request):
            last = e["results"]
            if a.command == "stream":
                show(e)
        for r in last if a.command == "search" else []:
            show(r)
        return 0
    rows = {"metrics": lambda: index.counters(), "errors": lambda: index.failures(a.run)}
    if a.command in rows:
        for r in rows[a.command]().toLocalIterator():
            show(r.asDict())
        return 0
    commands = {
        "update": lambda: index.update(a.roots, names_only=a.names_only, max_files=a.max_files, excluded=tuple(a.exclude), batch_files=a.batch_files),
        "import": lambda: index.import_bundle(a.source, model=a.model, root=a.root),
        "matrix": lambda: index.build_matrix(a.dtype, full=a.full),
        "candidates-build": index.build_candidates,
        "work": lambda: index.work(a.job),
        "poll": lambda: index.poll(a.job, a.after, a.limit),
        "cancel": lambda: index.cancel(a.job),
        "status": index.status,
        "stats": index.stats,
        "verify": index.verify,
        "repair-truncated": lambda: {"repaired": index.repair_truncated()},
        "metadata-upgrade": index.upgrade_metadata,
        "replicate": lambda: index.store.replicate(a.target),
        "inventory-compare": lambda: index.compare(Index(spark, a.other, dim=a.dim)),
    }
    found = commands[a.command]()
    if found is not None:
        show(found)
    return 0


if __name__ == "__main__":
    sys.exit(main())
