"""Connected components of a distributed edge list."""

from ..components import components, join_hot  # noqa: F401
