"""Errors a caller may want to catch."""


class IngestError(ValueError):
    """An export that cannot be loaded; nothing of the run becomes visible."""


class SqlGuardError(ValueError):
    """A query text that is not a single read-only query over published views."""


class QueryTimeoutError(RuntimeError):
    """A guarded query that ran past its limit and was cancelled."""


class EditError(ValueError):
    """An edit of a list that must not be carried out."""


class CandidateError(ValueError):
    """A candidate without artist or title, or no candidate at all."""
