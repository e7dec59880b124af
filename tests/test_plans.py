"""Plans that read or send no more than they need."""

from foliospark.plans.views import compiled

def exchanged(df):
    """The rows that the plan's exchanges get, by its text."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_blocks_meet_their_region_without_a_join(spark, sf_dir):
    from foliospark import queries

    plan = exchanged(queries.queries()["TBL-14"](spark, sf_dir))
    assert "Join" not in plan and "Window" in plan


def test_boxes_go_to_few_cells(spark, sf_dir):
    """The exchanges' rows are at most three times the boxes; nine copies of each were sent before."""
    from foliospark import queries

    boxes = spark.sql(compiled(queries.SPARK, "SELECT * FROM blocks", ("blocks",), sf_dir)).count()
    select = queries.DECLARED["LAY-05"][1](queries.SPARK)
    inner = select[select.index("JOIN (") + 6 : select.index(") b ON")]
    assert boxes < spark.sql(compiled(queries.SPARK, inner, ("blocks",), sf_dir)).count() < 2 * boxes
