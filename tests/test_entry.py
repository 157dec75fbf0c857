"""The driver's contract, each part in a fresh interpreter."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("module", ["vartide.plans.report", "vartide.plans.fitted", "vartide.plans.datasets", "vartide.plans.variants", "vartide.plans.api", "vartide.plans.catalog", "__spark_entry__"])
def test_modules_import_alone(module):
    subprocess.run([sys.executable, "-c", f"import {module}"], cwd=ROOT, check=True, timeout=120)


def test_every_sql_has_a_query():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(names) and len(names) > 60
