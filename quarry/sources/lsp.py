"""A client of language servers: JSON-RPC over a process's pipes, and its answers as rows.

A server is started where its task runs, so it must be installed on the workers and the workspace must be readable there.
"""

from __future__ import annotations

import json
import os
import queue
import subprocess
import threading
import time
from collections.abc import Iterator
from urllib.parse import quote, unquote, urlparse

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from quarry.functions.text import from_utf16, utf16_of


class ServerError(RuntimeError):
    """The server cannot be started, has died, does not answer in time or answers with an error."""


class LspClient:
    """One running server. Lines and columns count from 1, columns in bytes of UTF-8, whatever encoding the server speaks."""

    def __init__(self, command: list[str], root: str, timeout: float = 60.0):
        self.root, self.timeout = os.path.realpath(root), timeout
        try:
            self.process = subprocess.Popen(command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, cwd=self.root)
        except OSError as e:
            raise ServerError(f"{command[0]} cannot be started: {e}") from e
        self._answers: queue.Queue = queue.Queue()
        self._busy: set = set()
        self._told = False
        self._next = 0
        self._open: dict[str, list[str]] = {}
        self._lock = threading.Lock()
        threading.Thread(target=self._listen, daemon=True).start()
        uri = self._uri("")
        asked = {"general": {"positionEncodings": ["utf-8", "utf-16"]}, "window": {"workDoneProgress": True}, "textDocument": {"definition": {"linkSupport": True}, "references": {}}}
        got = self.request("initialize", {"processId": os.getpid(), "rootUri": uri, "capabilities": asked, "workspaceFolders": [{"uri": uri, "name": "root"}]})
        self.encoding = (got or {}).get("capabilities", {}).get("positionEncoding") or "utf-16"
        self.notify("initialized", {})

    # ------------------------------------------------------------------ messages

    def _send(self, message: dict) -> None:
        body = json.dumps({"jsonrpc": "2.0"} | message).encode()
        try:
            with self._lock:
                self.process.stdin.write(b"Content-Length: %d\r\n\r\n" % len(body) + body)
                self.process.stdin.flush()
        except (OSError, ValueError) as e:
            raise ServerError(f"the server is gone: {e}") from e

    def _listen(self) -> None:
        stream = self.process.stdout
        while True:
            size = 0
            while line := stream.readline().strip():
                name, _, value = line.partition(b":")
                if name.lower() == b"content-length":
                    size = int(value)
            if not size:
                self._answers.put(None)
                return
            message = json.loads(stream.read(size))
            if "method" not in message:
                self._answers.put(message)
            elif message["method"] == "$/progress":
                kind = message["params"].get("value", {}).get("kind")
                token = str(message["params"].get("token"))
                self._told = True
                (self._busy.add if kind == "begin" else self._busy.discard if kind == "end" else str)(token)
            elif "id" in message:  # a question of the server's
                items = (message.get("params") or {}).get("items")
                self._send({"id": message["id"], "result": [None] * len(items) if message["method"] == "workspace/configuration" and items else None})

    def notify(self, method: str, params: dict) -> None:
        self._send({"method": method, "params": params})

    def request(self, method: str, params: dict | None):
        self._next += 1
        self._send({"id": self._next, "method": method, "params": params})
        end = time.monotonic() + self.timeout
        while True:
            try:
                message = self._answers.get(timeout=max(0.01, end - time.monotonic()))
            except queue.Empty:
                raise ServerError(f"{method} was not answered within {self.timeout} s") from None
            if message is None:
                raise ServerError("the server is gone")
            if message.get("id") == self._next:
                if message.get("error"):
                    raise ServerError(f"{method}: {message['error'].get('message')}")
                return message.get("result")

    # ------------------------------------------------------------------ places

    def _uri(self, path: str) -> str:
        return "file://" + quote(os.path.join(self.root, path).rstrip("/"))

    def _path(self, uri: str) -> str | None:
        """Relative to the root; None for a file outside it."""
        full = os.path.realpath(unquote(urlparse(uri).path))
        return os.path.relpath(full, self.root) if full.startswith(self.root + "/") else None

    def _line(self, path: str, line: int) -> str:
        if path not in self._open:
            try:
                with open(os.path.join(self.root, path), encoding="utf-8") as f:
                    self._open[path] = f.read().split("\n")
            except (OSError, UnicodeDecodeError):
                self._open[path] = []
        lines = self._open[path]
        return lines[line - 1] if 0 < line <= len(lines) else ""

    def _position(self, path: str, line: int, column: int) -> dict:
        return {"line": line - 1, "character": column - 1 if self.encoding == "utf-8" else utf16_of(self._line(path, line), column)}

    def _places(self, found) -> list[tuple[str, int, int]]:
        out = []
        for place in [found] if isinstance(found, dict) else found or []:
            path = self._path(place.get("targetUri") or place.get("uri"))
            start = (place.get("targetSelectionRange") or place.get("range"))["start"]
            if path is not None:
                line, units = start["line"] + 1, start["character"]
                out.append((path, line, units + 1 if self.encoding == "utf-8" else from_utf16(self._line(path, line), units)))
        return out

    # ------------------------------------------------------------------ questions

    def did_open(self, path: str, language: str) -> None:
        self._line(path, 1)
        text = "\n".join(self._open[path])
        self.notify("textDocument/didOpen", {"textDocument": {"uri": self._uri(path), "languageId": language, "version": 1, "text": text}})

    def goto_definition(self, path: str, line: int, column: int) -> list[tuple[str, int, int]]:
        return self._places(self.request("textDocument/definition", {"textDocument": {"uri": self._uri(path)}, "position": self._position(path, line, column)}))

    def find_references(self, path: str, line: int, column: int) -> list[tuple[str, int, int]]:
        params = {"textDocument": {"uri": self._uri(path)}, "position": self._position(path, line, column), "context": {"includeDeclaration": False}}
        return self._places(self.request("textDocument/references", params))

    def wait_until_ready(self, quiet: float = 1.0) -> bool:
        """Until what the server reports as under way has ended; one that reports nothing within a moment counts as ready."""
        end, calm = time.monotonic() + self.timeout, None
        while time.monotonic() < end:
            now = time.monotonic()
            calm = None if self._busy else calm or now
            if calm is not None and now - calm >= quiet:
                return True
            time.sleep(0.05)
        return False

    def shutdown(self) -> None:
        try:
            self.request("shutdown", None)
            self.notify("exit", {})
            self.process.wait(5)
        except (ServerError, subprocess.TimeoutExpired):
            self.process.kill()
            self.process.wait()

    def __enter__(self) -> LspClient:
        return self

    def __exit__(self, *_) -> None:
        self.shutdown()


def definitions(refs: DataFrame, root: str, command: list[str], language: str, timeout: float = 60.0, servers: int = 1) -> DataFrame:
    """(ref_path, ref_line, ref_column, def_path, def_line): where a server finds what refs (path, line, column) mean.

    Files are dealt to `servers` tasks, each with a server of its own. A question that fails has no row; a server
    that cannot be started is an error.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, seen = None, set()
        try:
            for batch in batches:
                rows = []
                for path, line, column in zip(batch["path"], batch["line"], batch["column"], strict=True):
                    if client is None:
                        client = LspClient(command, root, timeout)
                        client.wait_until_ready()
                    if path not in seen:
                        seen.add(path)
                        client.did_open(path, language)
                    try:
                        found = client.goto_definition(path, int(line), int(column))
                    except ServerError:
                        if client.process.poll() is not None:
                            raise
                        continue
                    rows += [(path, line, column, found[0][0], found[0][1])] if found else []
                yield pd.DataFrame(rows, columns=["ref_path", "ref_line", "ref_column", "def_path", "def_line"])
        finally:
            if client is not None:
                client.shutdown()

    dealt = refs.select("path", "line", "column").distinct().repartition(servers, "path").sortWithinPartitions("path", "line", "column")
    return dealt.mapInPandas(run, "ref_path string, ref_line int, ref_column int, def_path string, def_line int")


def references(spark: SparkSession, root: str, command: list[str], language: str, path: str, line: int, column: int, timeout: float = 60.0) -> DataFrame:
    """(path, line): where a server finds uses of the symbol at a place."""
    with LspClient(command, root, timeout) as client:
        client.wait_until_ready()
        client.did_open(path, language)
        found = client.find_references(path, line, column)
    return spark.createDataFrame([(p, n) for p, n, _ in found], "path string, line int").distinct()
