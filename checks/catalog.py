"""All registered queries."""

from checks import columns, core, ruled, stored, streams  # noqa: F401
from checks.base import ORACLE, QUERIES  # noqa: F401
