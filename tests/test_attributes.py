"""The attribute index does not make distinct again what is distinct."""

from places import SF

from sleevenotes.operators import attributes as T
from sleevenotes.plans.entity import ALBUM
from sleevenotes.sources.driver_tables import DriverCatalog


def below(lines, k):
    """The plan's lines under line k."""

    def depth(line):
        return len(line) - len(line.lstrip(" :+-"))

    for line in lines[k + 1 :]:
        if depth(line) <= depth(lines[k]):
            return
        yield line


def test_lists_without_repeats_are_not_made_distinct_again(spark):
    rows = T.attribute_rows(ALBUM, DriverCatalog(spark, SF))
    plan = rows._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert any("artistids AS field" in line for line in plan)
    for k, line in enumerate(plan):
        if line.lstrip(" :+-").startswith("Aggregate [field"):
            assert not any("artistids AS field" in x for x in below(plan, k))
    assert rows.count() == rows.distinct().count()
