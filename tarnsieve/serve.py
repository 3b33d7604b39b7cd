"""A dashboard on the driver: a form at / and a scan as one HTML page at /scan, for a browser on the same machine.

Only GET is answered. A scan beyond its time is cancelled, jobs and all, and answered with code 124; one that fails, with
code 2. What the query string leaves out comes from the command line.
"""

from __future__ import annotations

import html
import ipaddress
import os
import shlex
import threading
import time
import uuid
from dataclasses import dataclass, field
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlencode, urlsplit

from pyspark.sql import SparkSession

from tarnsieve import config as cfg
from tarnsieve.plans.engine import Engine
from tarnsieve.rules.base import SEVERITIES
from tarnsieve.sinks import report as sinks

HOST, PORT, TIMEOUT = "127.0.0.1", 8765, 120.0
_GATES = (*SEVERITIES, "none")
_FLAGS = ("noConfig", "noBaseline", "includeIgnored", "interactive")


@dataclass
class Defaults:
    root: str = "."
    paths: list[str] = field(default_factory=list)
    config: str = ""
    no_config: bool = False
    baseline: str = ""
    no_baseline: bool = False
    include_ignored: bool = False
    diff: bool = False
    fail_on: str = ""
    interactive: bool = False
    editor: str = "none"
    timeout: float = TIMEOUT

    def state(self) -> dict[str, str]:
        """What the form shows at first. The gate: the command line's, else the configuration's, else that of dashboards."""
        gate = self.fail_on
        if not gate:
            try:
                gate = cfg.load_auto(self.root, self.config or None, self.no_config).fail_on("dashboard")
            except (OSError, ValueError):
                gate = cfg.Config().fail_on("dashboard")
        flag = lambda x: "1" if x else ""
        return {
            "project": os.path.abspath(self.root), "paths": ",".join(self.paths), "scope": "diff" if self.diff else "full", "failOn": gate, "config": self.config, "baseline": self.baseline,
            "noConfig": flag(self.no_config), "noBaseline": flag(self.no_baseline), "includeIgnored": flag(self.include_ignored), "interactive": flag(self.interactive),
        }

    def asked(self, query: str) -> dict[str, str]:
        given = {k: v[0].strip() for k, v in parse_qs(query).items() if v[0].strip()}
        return {k: given.get(k, v) for k, v in self.state().items()}


def loopback(host: str) -> bool:
    try:
        return host.lower() == "localhost" or ipaddress.ip_address(host).is_loopback
    except ValueError:
        return False


def command_of(s: dict[str, str], editor: str = "none") -> str:
    """The command that gives the same page."""
    out = ["python", "-m", "tarnsieve", "analyse", "--format", "html", "--root", s["project"]]
    out += ["--interactive"] * (s["interactive"] == "1") + (["--editor", editor] if editor != "none" else [])
    out += ["--no-config"] if s["noConfig"] == "1" else ["--config", s["config"]] if s["config"] else []
    out += ["--baseline", s["baseline"]] if s["baseline"] and s["noBaseline"] != "1" else []
    out += ["--diff", "HEAD"] * (s["scope"] == "diff") + ["--include-ignored"] * (s["includeIgnored"] == "1") + ["--fail-on", s["failOn"]]
    return shlex.join([*out, *_paths(s)])


def _paths(s: dict[str, str]) -> list[str]:
    return [x.strip() for x in s["paths"].split(",") if x.strip()]


def form_page(s: dict[str, str]) -> str:
    e = lambda x: html.escape(str(x), quote=True)
    text = "".join(f"<label>{k} <input name='{k}' value='{e(s[k])}'></label> " for k in ("project", "paths", "config", "baseline"))
    choice = lambda k, values: f"<label>{k} <select name='{k}'>{''.join(f'<option{' selected' if v == s[k] else ''}>{v}</option>' for v in values)}</select></label> "
    flags = "".join(f"<label><input type='checkbox' name='{k}' value='1'{' checked' if s[k] == '1' else ''}> {k}</label> " for k in _FLAGS)
    return f"<!doctype html><html><head><meta charset='utf-8'><title>Code quality</title></head><body><form action='/scan' target='scan'>{text}{choice('scope', ('full', 'diff'))}{choice('failOn', _GATES)}{flags}<button>Scan</button></form><iframe name='scan' src='/scan?{e(urlencode(s))}' style='width:100%;height:85vh;border:0'></iframe></body></html>\n"


def error_page(title: str, detail: str, code: int, ms: int) -> str:
    return f"<!doctype html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1><p>{html.escape(detail)}</p><p>exit {code}, {ms} ms</p></body></html>\n"


def scan_page(spark: SparkSession, d: Defaults, s: dict[str, str]) -> str:
    """One scan as a page, within d.timeout seconds (0: without end)."""
    began, group, out = time.monotonic(), f"scan-{uuid.uuid4().hex}", {}
    ms = lambda: int((time.monotonic() - began) * 1000)

    def run() -> None:
        try:
            spark.sparkContext.setJobGroup(group, "dashboard scan", True)
            engine = Engine(spark, s["project"], cfg.load_auto(s["project"], s["config"] or None, s["noConfig"] == "1"))
            gate = s["failOn"] if s["failOn"] in _GATES else engine.config.fail_on("dashboard")
            baseline = s["baseline"] if s["baseline"] and s["noBaseline"] != "1" else None
            r = engine.analyse(_paths(s) or None, baseline=baseline, diff="HEAD" if s["scope"] == "diff" else None, fail_on=gate, command="dashboard", include_ignored=s["includeIgnored"] == "1")
            out["page"] = sinks.as_html(r, s["interactive"] == "1", d.editor, os.path.abspath(s["project"]))
            out["code"] = r.exit_code
        except Exception as e:  # whatever it is, the page tells it and the server goes on
            out["error"] = str(e)

    worker = threading.Thread(target=run, daemon=True)
    worker.start()
    worker.join(d.timeout or None)
    if worker.is_alive():
        spark.sparkContext.cancelJobGroup(group)
        return error_page(f"Scan exceeded {d.timeout:g}s timeout.", "It was cancelled before it was done; --scan-timeout allows more.", 124, ms())
    if "error" in out:
        return error_page("Scan failed.", out["error"], 2, ms())
    about = f"<footer>exit {out['code']}, {ms()} ms, {html.escape(os.path.abspath(s['project']))}<br><code>{html.escape(command_of(s, d.editor))}</code></footer>"
    return out["page"].replace("</body>", f"{about}</body>")


def server(spark: SparkSession, d: Defaults, host: str = HOST, port: int = PORT, public: bool = False) -> ThreadingHTTPServer:
    """Bound, not yet serving. Other hosts than this machine's own need public."""
    if not loopback(host) and not public:
        raise ValueError(f"{host} isn't a loopback address; --allow-public binds to it")

    class Handler(BaseHTTPRequestHandler):
        timeout = 30

        def reply(self, code: int, text: str) -> None:
            raw = text.encode()
            self.send_response(code)
            self.send_header("Content-Type", "text/html; charset=utf-8")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def do_GET(self) -> None:
            at = urlsplit(self.path)
            if at.path == "/":
                self.reply(200, form_page(d.asked(at.query)))
            elif at.path == "/scan":
                self.reply(200, scan_page(spark, d, d.asked(at.query)))
            else:
                self.reply(404, error_page("Not found.", at.path, 404, 0))

        def refuse(self) -> None:
            self.reply(405, error_page("Method not allowed.", self.command, 405, 0))

        do_POST = do_PUT = do_DELETE = do_PATCH = refuse

        def log_message(self, *_) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)


def serve(spark: SparkSession, d: Defaults, host: str, port: int, public: bool) -> int:
    s = server(spark, d, host, port, public)
    print(f"http://{host}:{s.server_address[1]}/?{urlencode(d.state())}", flush=True)
    try:
        s.serve_forever()
    except KeyboardInterrupt:
        pass
    finally:
        s.server_close()
    return 0
