import re

import pytest

from strata.plans import queries as core


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_same_as_sql(spark, small, same, name):
    same(core.QUERIES[name](spark, small), core.SQL[name])


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_point_lookup_is_pushed_down(spark, small):
    plan = core.get_point(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "user_id" in plan


def test_merge_and_seek_over_all_runs(spark, small):
    merged = core.QUERIES["compact_merge"](spark, small)
    assert merged.agg({"seq": "max"}).first()[0] == core.clog(spark, small).agg({"seq": "max"}).first()[0]
    keys = core.table(spark, small, "run_row").where("key IS NOT NULL").select("key").distinct().count()
    starts = [r.start_pos for r in core.QUERIES["index_seek_bytes"](spark, small).select("start_pos").distinct().collect()]
    assert keys > 100 and max(p for p in starts if p is not None) == (keys - 1) // 10 * 10


def test_nothing_outside_imports_the_subpackage():
    from pathlib import Path

    for p in Path(core.__file__).resolve().parent.parent.rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"\bllm\b", p.read_text()), p
