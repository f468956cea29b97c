"""Wire formats as data sources: what the column parser gives, byte ranges, streams, quarantine, commit, a user's format."""

import pytest
from pyspark.sql import functions as F

from tideweave.sources import lines as L
from tideweave.sources import views as V
from tideweave.sources import wire as W

SF = "/root/testdata/sf0.001"
COLUMNS = ["type", "id", "ms", "pk", "fk", "sel1", "sel2", "long1", "long2", "filter_attr", "text", "json"]


def entity_text(spark):
    e, empty = V.entity(spark, SF), F.lit("")
    whole = [F.col(c).cast("string") for c in ("id", "ms", "ms", "pk", "fk", "sel1", "sel2", "long1", "long2", "filter_attr")]
    return e.select(F.concat_ws("\t", "type", *whole, F.concat(F.lit("text"), F.col("id").cast("string")), *[empty] * 4).alias("value"))


def rows(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()), key=str)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("wire") / "lines"
    spark.dataSource.register(W.EntityLines)
    entity_text(spark).repartition(3).write.format("entity_lines").mode("append").save(str(path))
    return str(path)


def test_batch_and_commit(spark, folder):
    import os

    names = os.listdir(folder)
    assert len(names) == 3 and all(n.startswith("part-") for n in names)
    assert rows(spark.read.format("entity_lines").load(folder)) == rows(L.entity_lines(entity_text(spark))) != []


def test_stream(spark, folder, tmp_path):
    s = spark.readStream.format("entity_lines").load(folder)
    out = lambda: s.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    out()
    out()  # nothing is new
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == rows(L.entity_lines(entity_text(spark)))


def test_byte_ranges(tmp_path, monkeypatch):
    """Every line comes once, wherever files are cut."""
    lines = ["", "a", "bb\r", "c" * 50, "", "é", "last"]
    (tmp_path / "x.txt").write_bytes("\n".join(lines).encode())
    want = [x.removesuffix("\r") for x in lines]
    for split in (1, 2, 3, 7, 1000):
        monkeypatch.setattr(W, "SPLIT", split)
        got = [x for span in W._spans(W._files(str(tmp_path))) for x in W._lines(str(tmp_path), span)]
        assert got == want, split


class Pairs(W.LineSource):
    columns = "k string, v bigint"

    @classmethod
    def name(cls):
        return "pairs"

    @classmethod
    def parse(cls, line):
        k, v = line.split("=")
        return k, int(v)


def test_quarantine_and_own_format(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x=1\nbroken\ny=2\nz=none\n")
    spark.dataSource.register(Pairs)
    got = spark.read.format("pairs").option("strict", "false").load(str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("x", 1, None), (None, None, "broken"), ("y", 2, None), (None, None, "z=none")], key=str)
    with pytest.raises(Exception, match="malformed line: broken"):
        spark.read.format("pairs").load(str(tmp_path)).collect()
