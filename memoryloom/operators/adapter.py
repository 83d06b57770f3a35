"""Another system under evaluation: a command that gets the cases as JSON and prints an outcome for each."""

from __future__ import annotations

import json
import shlex
import subprocess
from dataclasses import dataclass, field
from typing import Any

PROTOCOL = "memoryloom-adapter-v1"
#: Seconds that a command may take, and characters of a message that are kept.
SECONDS, MOST_CHARS = 600, 256
#: What an outcome may leave out, and the value it then has.
OPTIONAL: dict[str, Any] = {"returned_ids": [], "receipt": "", "latency_us": 0.0, "supported": True}


@dataclass(frozen=True)
class Report:
    system: str
    status: str
    version: str = PROTOCOL
    outcomes: list[dict] = field(default_factory=list)
    error: str = ""


def parsed(payload: str, ids: list[str]) -> tuple[str, list[dict]]:
    """Version and outcomes, in the order of ids, of what a command printed; each case must stand there exactly once."""
    answer = json.loads(payload)
    rows = answer["cases"]
    if sorted(r["case_id"] for r in rows) != sorted(ids):
        raise ValueError("not every case was reported exactly once")
    by_id = {r["case_id"]: r for r in rows}
    out = [{"case_id": i, "correct": bool(by_id[i]["correct"]), "allowed": bool(by_id[i]["allowed"])} | {k: type(v)(by_id[i].get(k, v)) for k, v in OPTIONAL.items()} for i in ids]
    return str(answer.get("adapter_version", PROTOCOL))[:64], out


def execute(system: str, command: str | None, cases: list[dict], repeats: int = 1, seconds: float = SECONDS) -> Report:
    """Runs the command on the driver over a bounded suite of cases: executed, error, or unavailable without a command."""
    if not (command or "").strip():
        return Report(system, "unavailable")
    request = json.dumps({"protocol": PROTOCOL, "repeats": repeats, "cases": cases}, sort_keys=True)
    try:
        done = subprocess.run(shlex.split(command), input=request, capture_output=True, text=True, timeout=seconds, check=True)
        version, outcomes = parsed(done.stdout, [c["case_id"] for c in cases])
    except Exception as e:  # noqa: BLE001 - whatever goes wrong with another system is reported
        return Report(system, "error", error=str(e)[:MOST_CHARS])
    return Report(system, "executed", version, outcomes)
