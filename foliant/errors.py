"""Errors that a caller can tell apart."""


class EngineError(Exception):
    """The base of all of them."""


class UnsupportedInput(EngineError):
    """The bytes are of no known kind."""


class ConversionFailed(EngineError):
    """A document could not be turned into text."""


class SourceUnavailable(EngineError):
    """A remote source did not answer usefully."""


class InvalidQuery(EngineError):
    """A search that cannot be sent."""


class IndexNotReady(EngineError):
    """The chunk index is empty, not committed or of another embedder."""


class NotConfigured(EngineError):
    """A plug-in that was not chosen is needed."""
