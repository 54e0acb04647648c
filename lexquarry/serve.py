"""A thin HTTP face of the engine: GET and POST routes that return JSON, and the five tools as plain functions.

Requests read one published engine object; a rebuild makes a new one and replaces it in one step, so readers take no lock.
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import CorpusEngine, clean_path
from .operators.corpus import totals


def rows(df: DataFrame) -> list[dict]:
    """The rows of a bounded result, without internal columns."""
    hidden = {"walk_key", "signature", "ordinal"} if "entry_type" in df.columns else {"ordinal"}
    return [{k: v for k, v in r.asDict(recursive=True).items() if k not in hidden} for r in df.collect()]


def _tree(entries: list[dict]) -> dict:
    """Entries nested by their parent paths, in walk order."""
    nodes = {e["path"]: e | {"children": []} for e in entries}
    for e in nodes.values():
        if e["path"] != ".":
            nodes[e["parent_path"]]["children"].append(e)
    return nodes["."]


class Service:
    """Routes by method and path; each takes the request's parameters and returns what JSON shows."""

    def __init__(self, engine: CorpusEngine) -> None:
        self.engine = engine
        self.get: dict[str, Callable[[dict], object]] = {
            "/": self.index, "/health": lambda q: self.engine.health(), "/fs/models": lambda q: rows(self._live(q)), "/fs/tree": lambda q: _tree(rows(self._live(q))), "/fs/snapshot": self.snapshot, "/index/stats": lambda q: self.stats(),
            "/index/file": lambda q: rows(self.engine.entry(self._need(q, "path")))[0], "/index/children": self.children, "/index/search": self.search, "/index/symbols": self.symbols, "/index/usages": self.usages,
            "/index/skeleton": lambda q: {"path": clean_path(self._need(q, "path")), "skeleton_dsl": self.engine.skeleton(self._need(q, "path"))}, "/index/contour": self.contour, "/ask": lambda q: self.engine.ask(q.get("q", "")),
        }
        self.post: dict[str, Callable[[dict], object]] = {"/ask": lambda q: self.engine.ask(q.get("question") or q.get("q") or ""), "/index/rebuild": self.rebuild, "/ramdisk/create": self.no_disk, "/ramdisk/destroy": self.no_disk}

    @staticmethod
    def _need(q: dict, name: str) -> str:
        if not q.get(name):
            raise ValueError(f"{name} is required")
        return q[name]

    def index(self, q: dict) -> dict:
        return {"routes": {"GET": sorted(self.get), "POST": sorted(self.post)}}

    def _live(self, q: dict) -> DataFrame:
        return self.engine.scan(q.get("path", ".")).orderBy("walk_key", "path")

    def snapshot(self, q: dict) -> dict:
        live = self._live(q)
        return {"summary": totals(live).first().asDict(), "models": rows(live)}

    def stats(self) -> dict:
        return self.engine.index_stats().first().asDict()

    def children(self, q: dict) -> dict:
        kids = rows(self.engine.children(q.get("path", ".")))
        return {"parent": clean_path(q.get("path", ".")), "count": len(kids), "children": kids}

    def search(self, q: dict) -> dict:
        found = self.engine.search(q.get("q", ""), content_query=q.get("content", ""), entry_type=q.get("type"), suffix=q.get("suffix"), path_prefix=q.get("path_prefix"), limit=int(q.get("limit", 50)))
        return {"query": q, "results": rows(found.withColumn("score", F.round("score", 6))), "stats": self.stats()}

    def symbols(self, q: dict) -> dict:
        return {"symbols": rows(self.engine.symbols(q.get("name", ""), q.get("kind"), q.get("path_prefix"), int(q.get("limit", 20))))}

    def usages(self, q: dict) -> dict:
        return {"usages": rows(self.engine.usages(q.get("name", ""), q.get("path_prefix"), int(q.get("limit", 20))))}

    def contour(self, q: dict) -> dict:
        return {"query": q.get("q", ""), "skeleton_dsl": self.engine.contour(q.get("q", ""), int(q.get("limit", 10)))}

    def rebuild(self, q: dict) -> dict:
        fresh = CorpusEngine.from_tree(self.engine.spark, self.engine.root)
        self.engine = fresh
        return self.stats()

    @staticmethod
    def no_disk(q: dict) -> None:
        raise RuntimeError("memory disks are not managed here; cache() holds tables in executor memory")

    def answer(self, method: str, path: str, params: dict) -> tuple[int, object]:
        """Status and body: 404 for what isn't there, 400 for bad values, 409 for what can't be done now, 500 otherwise."""
        route = (self.get if method == "GET" else self.post).get(path)
        if route is None:
            return 404, {"error": f"no such route: {path}"}
        try:
            return 200, route(params)
        except FileNotFoundError as e:
            return 404 if method == "GET" else 500, {"error": str(e)}
        except ValueError as e:
            return 400, {"error": str(e)}
        except RuntimeError as e:
            return 409, {"error": str(e)}
        except Exception as e:  # noqa: BLE001  every other failure is the server's
            return 500, {"error": str(e)}


def tools(engine: CorpusEngine) -> dict[str, Callable]:
    """The tools that assistants call, by name."""

    def search_codebase(query: str, limit: int = 20) -> list[dict]:
        hits = rows(engine.search(query, limit=limit))
        return [{"path": h["path"], "entry_type": h["entry_type"], "score": round(h["score"], 6), "excerpt": engine.excerpt(h["path"], query)} for h in hits]

    return {
        "get_file_skeleton": engine.skeleton, "get_symbol_contour": lambda query, limit=10: engine.contour(query, limit), "search_codebase": search_codebase, "ask_codebase": engine.ask,
        "get_index_stats": lambda: engine.index_stats().first().asDict(),
    }


def handler(service: Service) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def _send(self, status: int, body: object) -> None:
            data = json.dumps(body, ensure_ascii=False, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:  # noqa: N802
            url = urlsplit(self.path)
            self._send(*service.answer("GET", url.path, {k: v[-1] for k, v in parse_qs(url.query).items()}))

        def do_POST(self) -> None:  # noqa: N802
            raw = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            try:
                params = json.loads(raw) if raw else {}
            except ValueError:
                self._send(400, {"error": "the body is not JSON"})
                return
            self._send(*service.answer("POST", urlsplit(self.path).path, params))

        def log_message(self, *args: object) -> None:
            pass

    return Handler


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="Serves a directory tree over HTTP.")
    p.add_argument("--root", required=True)
    p.add_argument("--host", default="127.0.0.1")
    p.add_argument("--port", type=int, default=8000)
    a = p.parse_args(argv)
    engine = CorpusEngine.from_tree(SparkSession.builder.appName("lexquarry").getOrCreate(), a.root)
    engine.cache()
    ThreadingHTTPServer((a.host, a.port), handler(Service(engine))).serve_forever()


if __name__ == "__main__":
    main()
