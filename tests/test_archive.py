"""Maps merged in order, and archives that hold nested columns and arcs."""

import json

from pyspark.sql import functions as F

from streetloom.functions import cells
from streetloom.sources import archive

from . import micro


def test_missing_maps_are_passed_over(spark):
    maps = spark.createDataFrame([([{"a": "1", "b": "2"}, None, {"a": "3"}, {"c": None}],), ([],), (None,)], "m array<map<string,string>>")
    assert [r[0] for r in maps.select(cells.merged(F.col("m"))).collect()] == [{"a": "3", "b": "2", "c": None}, {}, None]


def test_archive_with_nested_columns_and_arcs(spark, tmp_path):
    g = micro.oneway(spark)
    tags = F.when(F.col("pos") != 1, F.create_map(F.lit("name"), F.concat(F.lit("ß"), F.col("pos").cast("string")), F.lit("none"), F.lit(None).cast("string")))
    g = g.with_(nodes=g.nodes.withColumns({"tags": tags, "routes": F.array(F.lit("1"), F.lit(None))}))
    path = archive.export_archive(g, str(tmp_path / "one"), include_arcs=True)
    again = archive.import_archive(spark, path)
    plain = lambda graph: sorted(json.dumps(r.asDict(recursive=True), sort_keys=True) for r in graph.nodes.select("node_id", "tags", "routes").collect())
    assert plain(again) == plain(g) and again.meta == g.meta
    assert sorted(archive.archived_arcs(spark, path).collect()) == sorted(g.arcs().collect())
    assert archive.archived_arcs(spark, archive.export_archive(g, str(tmp_path / "two"))) is None
