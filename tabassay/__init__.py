"""Compare a real table with a synthetic one of the same schema on Spark: fidelity, utility and privacy."""

from tabassay.errors import AssayError, CastError, ConfigError, PreparationError, RegistryError, SchemaError
from tabassay.schema import ColumnType, TableSchema

__all__ = ["AssayError", "CastError", "ColumnType", "ConfigError", "PreparationError", "RegistryError", "SchemaError", "TableSchema"]
