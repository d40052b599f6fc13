"""A report of standing questions, handed only to recipients on a list, and by default to nobody."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from sparkseek.services.nlq import Model, ask

QUESTIONS = ["how many flights are there?", "which aircraft types are flying?", "what are the altitude percentiles?", "is the cluster healthy?"]
TITLE = "Cluster briefing"


class Allowlist:
    """Addresses that may get mail, whatever their case; an empty list allows none."""

    def __init__(self, addresses: list[str] | str = ()):
        parts = addresses.split(",") if isinstance(addresses, str) else addresses
        self.addresses = {a.strip().lower() for a in parts if a.strip()}

    def allows(self, address: str) -> bool:
        return address.strip().lower() in self.addresses


@dataclass
class DryRun:
    """Sends nothing and notes what it would have sent."""

    sent: list[tuple[str, str]] = field(default_factory=list)

    def send(self, to: str, subject: str, body: str) -> None:
        self.sent.append((to, subject))


@dataclass
class Briefing:
    subject: str
    body: str
    provenance: list[str]


def compose(model: Model, run_tool: Callable[[str, dict], str], questions: list[str] | None = None) -> Briefing:
    body, provenance = f"{TITLE}\n{'=' * len(TITLE)}\n\n", []
    for q in QUESTIONS if questions is None else questions:
        answer = ask(model, run_tool, q)
        body += f"Q: {q}\n{answer.text}\n\n"
        provenance += answer.provenance
    if provenance:
        body += "— evidence —\n" + "".join(f"  [{i}] {p}\n" for i, p in enumerate(provenance, 1))
    return Briefing(TITLE, body, provenance)


def send(briefing: Briefing, recipients: list[str], allowlist: Allowlist, emailer=None) -> tuple[list[str], list[str]]:
    """Who got it, and what went wrong with the others."""
    emailer = emailer or DryRun()
    delivered, errors = [], []
    for r in recipients:
        if not allowlist.allows(r):
            errors.append(f"recipient not allowlisted: {r}")
            continue
        try:
            emailer.send(r, briefing.subject, briefing.body)
            delivered.append(r)
        except Exception as e:
            errors.append(f"send to {r} failed: {e}")
    return delivered, errors
