"""The error contract: a code, a message and details, raised before any job starts."""

from __future__ import annotations

#: The codes that callers match on.
CODES = frozenset(
    """invalid_input invalid_request solution_not_selected solution_not_found invalid_path path_out_of_scope
    symbol_not_found ambiguous_symbol invalid_new_name rename_conflict fix_not_found action_not_found
    workspace_changed stale_workspace_snapshot fix_conflict policy_blocked analysis_failed internal_error""".split()
)


class QueryError(Exception):
    """An error of the contract; blank details are left out."""

    def __init__(self, code: str, message: str, **details: str | None):
        if code not in CODES:
            raise ValueError(f"unknown error code {code}")
        super().__init__(f"{code}: {message}")
        self.code, self.message = code, message
        self.details = {k: str(v) for k, v in details.items() if v is not None and str(v).strip()}

    def as_dict(self) -> dict:
        return {"code": self.code, "message": self.message, "details": self.details}


def require(value: str | None, name: str, code: str = "invalid_input") -> str:
    """The trimmed value, or an error if it is blank."""
    if value is None or not value.strip():
        raise QueryError(code, f"{name} must not be blank", parameter=name)
    return value.strip()
