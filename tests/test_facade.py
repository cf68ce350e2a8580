import pytest
from pyspark.sql import functions as F

from rivulet.plans.facade import Console, Settings
from rivulet.plans.operations import _members
from rivulet.plans.projections import decided
from rivulet.plans.tables import DAY

TABLES = "/root/testdata/sf0.001"


def test_settings():
    s = Settings.of({"RIVULET_BUDGET": "0.05", "RIVULET_MESH": "on", "RIVULET_SEEDS": "a:1, b:2,", "OTHER": "x"})
    assert (s.budget, s.mesh, s.seeds, s.dead) == (0.05, True, ("a:1", "b:2"), 12.0)
    assert Settings.of({}) == Settings() and not Settings().mesh
    assert s.changed(budget=0.1).budget == 0.1
    for bad in ({"RIVULET_BUDGET": "2"}, {"RIVULET_SUSPECT": "20"}, {"RIVULET_MIRROR": "much"}):
        with pytest.raises(ValueError):
            Settings.of(bad)


def test_console(spark):
    d = decided(spark, TABLES)
    rules = spark.createDataFrame([(0, "a > 1"), (1, "b > 2")], "number int, rule string")
    console = Console(d, Settings(dedup_us=DAY, discovery=0.5), _members(spark, TABLES), d.withColumnRenamed("dst", "ip"), rules)
    one = console.metrics(F.col("port") > 70).first()
    shown = console.alerts()
    assert one.packets == d.count() and one.alerts == shown.count() and one.active_campaigns == shown.select("src").distinct().count() == console.campaigns().count()
    r = console.report().first()
    assert (r.tp, r.fp, r.tn, r.fn) == (one.tp, one.fp, one.tn, one.fn) and abs(r.fnr + r.recall - 1) < 2e-6
    assert console.history(7).count() == 7
    c = console.cluster().first()
    assert c.alive + c.suspect + c.dead <= console.members.count() and c.quorum == (c.alive > console.members.count() / 2)
    last = d.agg(F.max("us")).first()[0]
    assert console.shared(F.lit(last), DAY).filter(F.col("us") < last - DAY).count() == 0
    assert [x.approved for x in console.approved(1).orderBy("number").collect()] == [False, True]
    assert [x.approved for x in console.approved().collect()] == [False, False]
