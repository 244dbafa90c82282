"""Errors of stores."""


class StoreError(Exception):
    """Base of the others."""


class AbortError(StoreError):
    """Raised to end a transaction without its changes and without an error outside."""


class ConfigError(StoreError):
    """Something is set up in a way that contradicts what is stored."""


class NameInUse(StoreError):
    """A name is taken."""


class NotFound(StoreError):
    """No such collection."""


class TxnError(StoreError):
    """A write outside a transaction that allows it."""
