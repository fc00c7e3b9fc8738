"""Errors with codes."""

from __future__ import annotations


class MemoryError_(ValueError):
    """A request that can't be planned."""

    def __init__(self, code: str, message: str = ""):
        super().__init__(f"{code}: {message}" if message else code)
        self.code = code


def require(**given) -> None:
    """MISSING_<NAME> for the first argument that is null or empty."""
    for name, value in given.items():
        if value is None or value == "":
            raise MemoryError_(f"MISSING_{name.upper()}", f"{name} is required")


SCOPES = ("user", "agent", "session")


def check_scope(scope: str, agent_id=None, session_id=None) -> None:
    if scope not in SCOPES:
        raise MemoryError_("INVALID_SCOPE", f"{scope!r} is none of {', '.join(SCOPES)}")
    if scope == "agent":
        require(agent_id=agent_id)
    if scope == "session":
        require(session_id=session_id)
