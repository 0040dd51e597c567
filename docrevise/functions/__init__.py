"""Column-expression helpers (JVM-side, no Python UDFs)."""

from docrevise.functions.text import *  # noqa: F401,F403
