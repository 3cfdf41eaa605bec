"""The registered queries without what only some of them need."""

import json
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[1]
HIDING = """
import json, sys

class Hidden:
    def find_spec(self, name, path=None, target=None):
        if any(name == h or name.startswith(h + ".") for h in {hidden!r}):
            raise ModuleNotFoundError(name)

sys.meta_path.insert(0, Hidden())
import __spark_entry__ as entry
print(json.dumps([sorted(entry.queries()), sorted(entry.oracle_sql())]))
"""


def registered(*hidden):
    run = subprocess.run([sys.executable, "-c", HIDING.format(hidden=hidden)], cwd=REPO, capture_output=True, text=True, check=True)
    return json.loads(run.stdout.splitlines()[-1])


@pytest.mark.parametrize("hidden", ["xxhash", "corpus_pipeline", "hearthlens.llm"])
def test_other_queries_stay(hidden):
    from hearthlens.plans.catalogue import QUERIES

    found, sql = registered(hidden)
    assert found == sql == sorted(QUERIES)
