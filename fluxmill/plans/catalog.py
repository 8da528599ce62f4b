"""All core queries: importing this module registers them."""

from . import live, problems, reference  # noqa: F401
from .registry import core  # noqa: F401
