import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from tests.compare import assert_same
from tidemark.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    df = registry.QUERIES[name](spark, SF)
    if name in registry.ORACLES:
        assert_same(df, registry.ORACLES[name], SF)
    else:
        assert df.count() > 0


def test_least_similarity_has_no_row_limit_and_all_users_get_rings(spark):
    from tidemark.sources import tables

    plan = registry.QUERIES["similar_least"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "GlobalLimit" not in plan
    many = tables.table(spark, SF, "events").groupBy("user_id").count().where("count > 1").count()
    assert registry._with_back_edges(spark, SF).count() == tables.user_links(spark, SF).count() + many


def test_entry_survives_without_the_llm_folder(tmp_path):
    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root, tmp_path / "r", ignore=shutil.ignore_patterns("llm", ".git", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; assert len(e.queries()) > 50 and not [q for q in e.queries() if q.startswith(('op1', 'pipeline'))]"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path / "r")


def test_tests_of_payloads_stay_above_the_version_and_keys_go_below(spark):
    from tidemark.engine import Engine
    from tidemark.model import Facts
    from tidemark.sources import tables

    q = Engine(Facts.of(tables.line_facts(spark, SF))).query("FACTS event_id OF part:* FACET R WHERE price > 50000", 1).table
    plan = q._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("FileScan") :]
    assert "EqualTo(l_returnflag,R)" in scan and "GreaterThan(l_extendedprice" not in scan
    assert "l_linestatus" not in scan[: scan.index("PushedFilters")]  # not asked for, not read
