"""Where intermediate tables go, and when they go."""

import os
import subprocess
import sys
import textwrap

import pytest

from loomgrid.llm import common

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_tables_are_dropped_when_the_result_does_not_read_them(spark):
    @common.scoped
    def operator(fail=False):
        first = common.materialize(spark.range(10))
        second = common.materialize(first.where("id > 3"))
        if fail:
            raise ValueError
        return second.where("id > 5")

    before = list(common._written)
    out = operator()
    assert len(common._written) == len(before) + 1 and out.count() == 4
    with pytest.raises(ValueError):
        operator(fail=True)
    assert len(common._written) == len(before) + 1


def test_a_session_without_a_checkpoint_folder(tmp_path):
    code = """
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
        from loomgrid.llm import common
        assert not spark.conf.get("spark.checkpoint.dir", None)
        for _ in range(2):
            assert common.materialize(spark.range(3)).count() == 3
        class Far:
            master, applicationId, _jsc = "spark://host:7077", "x", spark.sparkContext._jsc
        class Session:
            sparkContext, conf = Far(), spark.conf
        try:
            common.shared_folder(Session())
        except RuntimeError as e:
            print("raised", e)
    """
    said = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], cwd=ROOT, env=os.environ | {"SPARK_CONF_DIR": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr[-2000:]
    assert "raised set spark.checkpoint.dir" in said.stdout
