"""All queries by name, with the SQL that gives the same rows; importing the modules registers them."""

from vartide.plans import contexts, datasets, detail, fitted, methods, report, scaled, shortfall, surface, variants  # noqa: F401
from vartide.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
