"""What the driver and one task must hold doesn't grow with the tables."""

import importlib

import pytest
from marginalia import queries
from marginalia.operators import spread

C = importlib.import_module("marginalia.check")


def sent_whole(df):
    """Stored tables below the broadcasts of a plan."""
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        if p.nodeName() == "BroadcastExchange" and "FileScan" in p.toString():
            found.append(p.toString())
        todo += [p.children().apply(k) for k in range(p.children().size())]
    return found


@pytest.fixture
def plain(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.enabled")


@pytest.mark.parametrize("name", ["check_files", "fix_text"])
def test_no_table_of_files_is_broadcast(plain, sf_dir, monkeypatch, name):
    plans, keep = [], C.keep

    def kept(df):
        plans.append(sent_whole(df))
        return keep(df)

    monkeypatch.setattr(C, "keep", kept)
    plans.append(sent_whole(queries.QUERIES[name](plain, sf_dir)))
    assert len(plans) > 5 and not any(plans)


SHARED = "dead_ignore suppression precedence ignore_reason narration_blocks comment_runs hedging_blocks loose_directives ignore_binding restate_subset vague_blocks attachment attribution_blocks block_text directive_drop".split()


@pytest.mark.parametrize("name", SHARED)
def test_rows_are_dealt_out_once(plain, sf_dir, name):
    """One exchange, by path, into as many parts as the table's size asks for; no join."""
    exchanges, joins, todo = [], [], [queries.QUERIES[name](plain, sf_dir)._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        exchanges += [p.outputPartitioning().toString()] if p.nodeName() == "Exchange" else []
        joins += [p.nodeName()] if "Join" in p.nodeName() else []
        todo += [p.children().apply(k) for k in range(p.children().size())]
    assert len(exchanges) >= 1 and len(set(exchanges)) == 1 and "hashpartitioning(path" in exchanges[0] and not joins


def test_parts_follow_the_size(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    assert spread.parts(table, size // 50) >= 50 and spread.parts(table, 10 * size) == spark.sparkContext.defaultParallelism
