"""Import every query module so that the registry is complete."""

from docrevise.plans import queries  # noqa: F401
from docrevise.plans import queries_revision  # noqa: F401
from docrevise.plans import queries_html  # noqa: F401
from docrevise.plans import queries_jobs  # noqa: F401
from docrevise.plans import queries_sources  # noqa: F401
from docrevise.plans import queries_flow  # noqa: F401
from docrevise.plans.registry import REGISTRY  # noqa: F401
