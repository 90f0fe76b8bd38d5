"""Exceptions; all derive from AssayError."""


class AssayError(Exception):
    """Base of every error raised here."""


class ConfigError(AssayError):
    """A configuration that lacks something or contradicts itself."""


class SchemaError(AssayError):
    """A table that does not fit its declared schema."""


class RegistryError(AssayError):
    """An unknown or doubly registered name."""


class PreparationError(AssayError):
    """A table of which nothing usable is left."""


class CastError(AssayError):
    """A declared type that can't be applied."""
