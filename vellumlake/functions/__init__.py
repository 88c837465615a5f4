"""Column functions of the document model."""

from .scalars import *  # noqa: F403
