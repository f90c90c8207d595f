"""The queries: the registry is loaded first, so that each module finds it whole."""

from . import registry  # noqa: F401
