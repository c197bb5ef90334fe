"""A plain session: no setting names a shared folder."""

import os
import subprocess
import sys

import pytest
from oracle import DATA

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def run_plain(code, tmp_path):
    """Runs code in a process of its own, whose Spark reads no defaults."""
    (tmp_path / "conf").mkdir()
    env = {k: v for k, v in os.environ.items() if not k.startswith("SPARK_")} | {"SPARK_CONF_DIR": str(tmp_path / "conf"), "TMPDIR": str(tmp_path), "PYTHONPATH": ROOT}
    start = "from gleanery.session import local_session\nspark = local_session('2', 2, '2g')\nassert not spark.conf.get('spark.checkpoint.dir', None)\n"
    return subprocess.run([sys.executable, "-c", start + code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_streams_and_exports_need_no_setting(tmp_path):
    code = f"from gleanery import registry\nfor name in ('stream_daily_counts', 'exported_csv'):\n    assert registry.queries()[name](spark, {DATA!r}).count() > 0\n"
    done = run_plain(code, tmp_path)
    assert done.returncode == 0, done.stderr[-3000:]


def test_one_folder_for_an_application(spark, monkeypatch):
    from gleanery import session

    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, default=None: default)
    assert session.scratch(spark) == session.scratch(spark)


def test_a_cluster_needs_the_setting(monkeypatch):
    from types import SimpleNamespace

    from gleanery import session

    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        spark = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: default), sparkContext=SimpleNamespace(master=master, applicationId="a"))
        with pytest.raises(ValueError):
            session.shared_folder(spark)
