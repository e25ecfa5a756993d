"""The driver's entry without the corpus operators or a package of theirs."""

import subprocess
import sys

import pytest

CODE = """
import sys
sys.path.insert(0, {repo!r})
class Missing:
    def find_spec(self, name, path=None, target=None):
        if name.partition('.')[0] == {name!r}:
            raise ModuleNotFoundError(f'No module named {{name!r}}', name=name)
sys.meta_path.insert(0, Missing())
import __spark_entry__ as e
names = set(e.queries())
assert 'write_markers' in names and set(e.oracle_sql()) <= names
print('op1_near_dedup' in names, len(names))
"""


@pytest.mark.parametrize("name", ["xxhash", "sentencepiece", "none_such"])
def test_core_queries_survive_a_missing_package(name):
    repo = __file__.rsplit("/", 2)[0]
    run = subprocess.run([sys.executable, "-c", CODE.format(repo=repo, name=name)], capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr
    has, n = run.stdout.split()
    assert int(n) > 100 and (has == "False" or name == "none_such")
