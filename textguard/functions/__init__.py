"""Column expressions (JVM-side) for text cleaning, predicates and vectors."""

from .predicates import *  # noqa: F401,F403
from .text import *  # noqa: F401,F403
