"""Jobs that workers hold by leases: one request after the other, as a step that batches and streams share.

A request names its op (submit, claim, acquire, renew, progress, propose, fail, cancel, complete), the microsecond at
which it is made, and what its op needs of: owner, digest, most, token, ttl, progress_at. A refused request changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

#: Microseconds that a lease may run at most before it is renewed.
MOST_TTL = 3_600_000_000
#: States that nothing leaves.
ENDED = ("completed", "cancelled")

Job = dict[str, Any]


def _moved(job: Job, at: int, **changes: Any) -> None:
    job |= {"at": at, "revision": job["revision"] + 1, **changes}


def _submit(job: Job, r: Job) -> str:
    terms = {"owner": r["owner"], "digest": r["digest"], "most": r["most"]}
    if job:
        return "known" if terms.items() <= job.items() else "collision"
    job |= {**terms, "status": "pending", "attempts": 0, "revision": 0, "at": r["at"], "progress_at": r["at"], "token": None, "until": None, "proposal": None}
    return "submitted"


def _acquire(job: Job, r: Job) -> str:
    if job["status"] in ENDED:
        return "terminal"
    if job["status"] == "proposal_ready":
        return "needs_recovery"
    if job["until"] is not None and job["until"] > r["at"]:
        return "held"
    if job["attempts"] >= job["most"]:
        _moved(job, r["at"], status="cancelled", token=None, until=None)
        return "exhausted"
    _moved(job, r["at"], status="leased", attempts=job["attempts"] + 1, token=r["token"], until=r["at"] + r["ttl"])
    return "leased"


def _claim(job: Job, r: Job) -> str:
    """Submits or finds the job, then leases it, unless its proposal or its end is what the caller has to take up."""
    if _submit(job, r) == "collision":
        return "collision"
    found = {"proposal_ready": "ready", "completed": "done", "cancelled": "terminal"}.get(job["status"])
    return found or _checked(job, r | {"op": "acquire"})


def _renew(job: Job, r: Job) -> str:
    if r["at"] + r["ttl"] <= job["until"]:
        return "not_extended"
    _moved(job, r["at"], until=r["at"] + r["ttl"])
    return "renewed"


def _progress(job: Job, r: Job) -> str:
    if r["progress_at"] < job["progress_at"]:
        return "regressed"
    _moved(job, r["at"], progress_at=r["progress_at"])
    return "progressed"


def _propose(job: Job, r: Job) -> str:
    """Stages a proposal's digest; a later attempt has to come to the same one."""
    if job["proposal"] not in (None, r["digest"]):
        return "collision"
    if job["status"] == "proposal_ready":
        return "ready"
    _moved(job, r["at"], status="proposal_ready", proposal=r["digest"])
    return "staged"


def _fail(job: Job, r: Job) -> str:
    out = "given_up" if job["attempts"] >= job["most"] else "failed"
    _moved(job, r["at"], status="cancelled" if out == "given_up" else "failed", token=None, until=None)
    return out


def _cancel(job: Job, r: Job) -> str:
    if job["owner"] != r["owner"]:
        return "stale"
    if job["status"] in ENDED:
        return "terminal"
    _moved(job, r["at"], status="cancelled", token=None, until=None)
    return "cancelled"


def _complete(job: Job, r: Job) -> str:
    """Ends a job whose staged proposal was committed; the lease no longer matters."""
    if job["status"] != "proposal_ready":
        return "terminal" if job["status"] in ENDED else "unstaged"
    if job["proposal"] != r["digest"]:
        return "collision"
    _moved(job, r["at"], status="completed", token=None, until=None)
    return "completed"


_LEASED = {"renew": _renew, "progress": _progress, "propose": _propose, "fail": _fail}
_OTHER = {"acquire": _acquire, "cancel": _cancel, "complete": _complete}


def _lease_fault(job: Job, r: Job) -> str | None:
    """Why the request may not use the job's lease: the token is the credential, and only while the lease runs."""
    if job["status"] in ENDED:
        return "terminal"
    if job["status"] not in ("leased", "proposal_ready"):
        return "idle"
    return "stale" if job["until"] <= r["at"] or job["token"] != r["token"] else None


def _checked(job: Job, r: Job) -> str:
    op = r["op"]
    if op in ("acquire", "renew") and not 0 < r["ttl"] <= MOST_TTL:
        return "bad_ttl"
    if not job:
        return "missing"
    if r["at"] < job["at"]:
        return "backdated"
    if op in _LEASED:
        return _lease_fault(job, r) or _LEASED[op](job, r)
    return _OTHER[op](job, r)


def step(job: Job, request: Job) -> str:
    """What became of the request; job, empty before it is submitted, is changed in place."""
    first: dict[str, Callable[[Job, Job], str]] = {"submit": _submit, "claim": _claim}
    return first.get(request["op"], _checked)(job, request)
