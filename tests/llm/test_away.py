from __future__ import annotations

import os
import subprocess
import sys

import pytest

from tests.conftest import SMALL


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables not present")
def test_workers_need_no_installed_package():
    """Queries and pipeline stages run where only the driver finds this package."""
    code = (
        f"import sys; sys.path.insert(0, {os.getcwd()!r})\n"
        "from biospark.session import build_session\n"
        "import __spark_entry__ as e\n"
        "s = build_session('away', 'local[2]', **{'spark.sql.shuffle.partitions': '2', 'spark.log.level': 'ERROR'})\n"
        f"print('rows', e.queries()['op10_bpe_round_trip'](s, {SMALL!r}).count(), e.queries()['op1_simhash_near_dedup'](s, {SMALL!r}).count())\n"
    )
    away = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd="/tmp", env=away, capture_output=True, text=True, timeout=300)
    assert "rows 200 200" in done.stdout, done.stderr[-2000:]
