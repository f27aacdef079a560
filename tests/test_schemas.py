"""Operator outputs keep the declared shapes of fanin.schemas (names and types)."""

from fanin import schemas
from fanin.plans.q_capture import resolved
from fanin.plans.q_report import rows
from fanin.plans.q_search import Ctx, normalised

SF = "/root/testdata/sf0.001"


def _shape(struct):
    return [(f.name, f.dataType.simpleString()) for f in struct.fields]


def test_declared_shapes(spark):
    c = Ctx(spark, SF)
    assert _shape(normalised(c).schema) == _shape(schemas.RESULTS)
    assert _shape(resolved(c).select(*schemas.PAGES_RESOLVED.names).schema) == _shape(schemas.PAGES_RESOLVED)
    assert _shape(rows(c).schema) == _shape(schemas.REPORT_ROW)
