import pytest

from ladderlens.tables import folder, keep


class Session:
    """Settings of a session, and its master."""

    def __init__(self, master, **settings):
        self.sparkContext, self.settings = type("C", (), {"master": master}), settings
        self.conf = self

    def get(self, name, default=None):
        return self.settings.get(name, default)


def test_the_folder_is_one_that_executors_share():
    own = {"spark.sql.warehouse.dir": "file:/tmp/w/"}
    assert folder(Session("local[4]", **own)) == "file:/tmp/w/scratch"
    assert folder(Session("spark://h:1", **own, **{"spark.checkpoint.dir": "hdfs://h/c"})) == "hdfs://h/c"
    assert folder(Session("spark://h:1", **{"spark.sql.warehouse.dir": "hdfs://h/w"})) == "hdfs://h/w/scratch"
    with pytest.raises(ValueError, match="checkpoint"):
        folder(Session("spark://h:1", **own))


def test_a_kept_table_is_written_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = keep(spark.range(20).mapInArrow(count, "id long"), "t")
    assert df.count() == 20 and df.where("id > 3").count() == 16 and seen.value == 20
