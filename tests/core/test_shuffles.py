"""Rows that the revision queries write to shuffles, in times the table's rows."""

import pytest
from shuffled import jobs_shuffled

from tessella import queries

DATA = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name, most", [("rev_merge", 10), ("rev_chains", 8), ("rev_compaction", 5), ("rev_replicate", 6)])
def test_revisions_are_shuffled_a_few_times(spark, name, most):
    run = lambda: queries.QUERIES[name](spark, DATA).write.format("noop").mode("overwrite").save()
    assert jobs_shuffled(spark, run) < most * 10_000
