"""The registered queries, by subject. The registry loads all of them in its order, whichever is imported first."""

from .. import registry  # noqa: F401
