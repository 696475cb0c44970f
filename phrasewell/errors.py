"""The error hierarchy; every class is raised somewhere."""


class PhrasewellError(Exception):
    """Base of all errors of this library."""


class QuerySyntaxError(PhrasewellError, ValueError):
    """A query doesn't follow the query language; the message lists each fault."""


class DocumentIdError(PhrasewellError, ValueError):
    """An id isn't a ULID."""


class MissingDocumentError(PhrasewellError, KeyError):
    """No live document has this id."""


class MissingIndexError(PhrasewellError, KeyError):
    """The registry has no index of this name."""


class ConfigError(PhrasewellError, ValueError):
    """A configuration file can't be read or has values of the wrong kind."""
