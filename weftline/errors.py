"""Error classes of the engine."""


class WeftlineError(Exception):
    """Base of all errors raised by the engine itself."""


class InvalidRequest(WeftlineError, ValueError):
    """Arguments that can never work, found before any data is read."""


class WriteConflict(WeftlineError):
    """Another writer published the version first, or the expected version is not the head."""


class WriteError(WeftlineError):
    """A commit that could not be published."""


class CatalogConflict(WeftlineError):
    """An identifier is registered with other content."""


class ReleaseConflict(WeftlineError):
    """A release is registered with other content, or no longer matches its tables."""


class TooManyMatches(WeftlineError):
    """A lookup found more rows than allowed."""


class StateLimitExceeded(WeftlineError):
    """A partial aggregation state is larger than allowed."""


class StateSerializationError(WeftlineError):
    """A partial aggregation state cannot be pickled."""


class UnsupportedOption(WeftlineError, NotImplementedError):
    """An option that this engine does not have."""


class UnsupportedSource(WeftlineError, NotImplementedError):
    """A source that needs a library or client that is not there."""


class StallError(WeftlineError):
    """A stream made no progress within its limit."""
