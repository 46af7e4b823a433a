"""Errors of the engine."""


class EngineError(Exception):
    """Base of all errors here."""


class ValidationError(EngineError):
    """Input that breaks a rule of the data model."""


class SourceError(EngineError):
    """A file that can't be read or written."""


class SchemaError(EngineError):
    """A stored schema version that this engine doesn't know."""
