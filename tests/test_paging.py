import random
import re

import pytest
from pyspark.sql import functions as F

from tidegate.operators import paging


@pytest.fixture
def table(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, 1, 2, 3, 4, 5]), k) for k in range(400)]
    return rows, spark.createDataFrame(rows, "a int, id int").repartition(5)


@pytest.mark.parametrize("down", [False, True])
def test_pages_and_seeks_equal_the_whole_order(spark, tmp_path, table, down):
    rows, df = table
    order = [("a", down), ("id", down)]
    index = paging.PageIndex.build(df, order, str(tmp_path / "p"), 9)
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]), reverse=down)
    assert index.total == 400
    for offset, limit in ((0, 10), (37, 50), (390, 50), (400, 5), (0, 500)):
        got = [(r.a, r.id) for r in index.slice(offset, limit).collect()]
        assert got == want[offset : offset + limit]
        assert [r.place for r in index.slice(offset, limit).collect()] == list(range(offset, min(400, offset + limit)))
    for at in (0, 60, 200, 398, 399):
        last = dict(zip(("a", "id"), want[at], strict=True))
        assert [(r.a, r.id) for r in index.after(last, 30).collect()] == want[at + 1 : at + 31]
    assert [(r.a, r.id) for r in index.page(3, 20).collect()] == want[40:60]
    again = paging.PageIndex.open(spark, str(tmp_path / "p"), order, 9)
    assert again.counts == index.counts


def test_a_deep_page_reads_its_ranges_only(spark, tmp_path, table):
    _, df = table
    index = paging.PageIndex.build(df, [("id", False)], str(tmp_path / "p"), 8)
    page = index.slice(380, 10)
    plan = page._jdf.queryExecution().executedPlan().toString()
    read = re.search(r"PartitionFilters: \[([^\]]*range_[^\]]*)\]", plan)[1]
    assert 1 <= len(re.findall(r"[^#\d](\d)(?=[,)]|$)", read)) <= 2, read
    assert [r.id for r in page.collect()] == list(range(380, 390))


def test_wrong_pages(spark, tmp_path, table):
    _, df = table
    for page, size in ((0, 10), (1, 0), (1, 501)):
        with pytest.raises(ValueError):
            paging.offset_of(page, size)
    assert paging.offset_of(3, 500) == 1000
    whole = paging.PageIndex.build(df, [("id", False)], str(tmp_path / "q"), 2)
    for offset, limit in ((-1, 5), (0, 0)):
        with pytest.raises(ValueError):
            whole.slice(offset, limit)
    assert set(paging.ORDERS) == {"keys", "keywords", "rules", "settings", "whitelist", "logs"}
    assert whole.slice(0, 3).agg(F.sum("id")).first()[0] == 3
