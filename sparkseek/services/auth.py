"""Tokens with a scope: operators may do what readers may."""

from __future__ import annotations

from dataclasses import dataclass, field

_RANK = {"read": 1, "operator": 2}


class Unauthenticated(Exception):
    """No token, or one that nobody knows."""


class PermissionDenied(Exception):
    """A known token of too small a scope."""


@dataclass
class Auth:
    """Without tokens, everything is allowed."""

    tokens: dict[str, str] = field(default_factory=dict)

    @classmethod
    def parse(cls, text: str) -> Auth:
        """One ``token scope`` a line; blank lines and those that start with # are skipped. A file without tokens is an error."""
        tokens = {}
        for line in map(str.strip, text.splitlines()):
            if not line or line.startswith("#"):
                continue
            parts = line.split()
            if len(parts) < 2:
                raise ValueError(f"bad token line: {line!r}")
            if parts[1] not in _RANK:
                raise ValueError(f"unknown scope: {parts[1]!r}")
            tokens[parts[0]] = parts[1]
        if not tokens:
            raise ValueError("no tokens defined")
        return cls(tokens)

    @classmethod
    def from_file(cls, path: str | None) -> Auth:
        if path is None:
            return cls()
        with open(path) as f:
            return cls.parse(f.read())

    @property
    def enabled(self) -> bool:
        return bool(self.tokens)

    def require(self, token: str | None, scope: str) -> None:
        if not self.enabled:
            return
        if token is None:
            raise Unauthenticated("missing bearer token")
        if token not in self.tokens:
            raise Unauthenticated("unknown token")
        if _RANK[self.tokens[token]] < _RANK[scope]:
            raise PermissionDenied(f"{scope} scope required")
