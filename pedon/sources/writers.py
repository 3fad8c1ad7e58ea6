"""Reports and geometries as text rows that Spark's writers take."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pedon.operators.matching import depth_duplicates
from pedon.operators.similarity import suggestions
from pedon.session import durable


def match_report(pairs: DataFrame) -> DataFrame:
    """(ponto, laudo, confianca, metodo), the surest pairs first, and of those by identifiers."""
    return pairs.select(F.col("point_id").alias("ponto"), F.col("lab_id").alias("laudo"), F.col("confidence").alias("confianca"), F.col("method").alias("metodo")).orderBy(F.desc("confianca"), "ponto", "laudo")


def write_csv(rows: DataFrame, path: str, sep: str = ";", mark: bool = True) -> None:
    """``rows`` as CSV files, each with a header and, with ``mark``, a byte order mark before it: every part file opens as a sheet by itself."""
    first, *rest = rows.columns
    marked = rows.toDF("\ufeff" + first, *rest) if mark else rows
    marked.write.mode("overwrite").csv(path, header=True, sep=sep, encoding="UTF-8")


def run_summary(points: DataFrame, lab: DataFrame, pairs: DataFrame, zone: int, epsg: int, approximate: float = 1.0) -> DataFrame:
    """One row: (zone, epsg, n_points, n_lab, n_pairs, n_approximate, n_point_orphans, n_lab_orphans)."""
    side = lambda df, c: df.select(c).where(F.col(c).isNotNull()).distinct().join(pairs.select(c, F.lit(True).alias("paired")), c, "left")
    # each table is read once, for all that is counted of it
    counted = [
        side(points, "point_id").agg(F.count(F.lit(1)).alias("n_points"), F.count_if(F.col("paired").isNull()).alias("n_point_orphans")),
        side(lab, "lab_id").agg(F.count(F.lit(1)).alias("n_lab"), F.count_if(F.col("paired").isNull()).alias("n_lab_orphans")),
        pairs.agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if(F.col("confidence") < approximate).alias("n_approximate")),
    ]
    names = ["n_points", "n_lab", "n_pairs", "n_approximate", "n_point_orphans", "n_lab_orphans"]
    together = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), counted).agg(*[F.sum(n).alias(n) for n in names])
    return together.select(F.lit(zone).alias("zone"), F.lit(epsg).alias("epsg"), *names)


def run_record(points: DataFrame, lab: DataFrame, pairs: DataFrame, zone: int, epsg: int, point_field: str, lab_field: str) -> DataFrame:
    """(part, value): the whole record of a run as rows, value in JSON, so that no list has to fit in one row.

    Parts: campo_id_pontos, coluna_id_laudo, zona_utm, epsg, pontos, pares (one
    row each), and a row for each of aproximados_para_confirmar,
    pontos_sem_par, laudo_sem_uso, sugestoes_para_os_sem_par and
    duplicados_laudo; atencao only where identifiers repeat.
    """
    p, b = durable(points.select("point_id").where("point_id is not null").distinct()), durable(lab.select("lab_id").where("lab_id is not null").distinct())
    free_p, free_b = durable(p.join(pairs, "point_id", "left_anti")), durable(b.join(pairs, "lab_id", "left_anti"))
    spark = points.sparkSession
    fixed = spark.createDataFrame([("campo_id_pontos", f'"{point_field}"'), ("coluna_id_laudo", f'"{lab_field}"'), ("zona_utm", str(zone)), ("epsg", str(epsg))], "part string, value string")
    count = lambda df, part: df.agg(F.count(F.lit(1)).cast("string").alias("value")).select(F.lit(part).alias("part"), "value")
    rows = lambda df, part: df.select(F.lit(part).alias("part"), F.to_json(F.struct(*df.columns)).alias("value"))
    doubles = durable(depth_duplicates(b))
    warned = doubles.limit(1).select(F.lit("atencao").alias("part"), F.lit('"o laudo tem ids repetidos (profundidades?): escolha uma"').alias("value"))
    parts = [fixed, count(p, "pontos"), count(pairs, "pares"), rows(pairs.where("method = 'aproximado'"), "aproximados_para_confirmar"), rows(free_p, "pontos_sem_par"), rows(free_b, "laudo_sem_uso"), rows(suggestions(free_p, free_b), "sugestoes_para_os_sem_par"), rows(doubles.select("base_id", "n"), "duplicados_laudo"), warned]
    return reduce(DataFrame.unionByName, parts)


def json_report(elements: DataFrame) -> DataFrame:
    """(element, json): each element's block of the run report."""
    return elements.select("element", F.to_json(F.struct(*elements.columns)).alias("json"))


def _ring_text(vertices: DataFrame, pair: str, sep: str, keys: list[str]) -> DataFrame:
    """(keys..., text) of closed rings: a ring is one row's array, bounded by its vertices."""
    ring = vertices.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))).alias("v"))
    first, last = F.col("v")[0], F.element_at("v", -1)
    closed = F.when((first["x"] == last["x"]) & (first["y"] == last["y"]), F.col("v")).otherwise(F.concat("v", F.array(first)))
    return ring.select(*keys, F.array_join(F.transform(closed, lambda p: F.format_string(pair, p["x"].cast("string"), p["y"].cast("string"))), sep).alias("text"))


def _polygons(vertices: DataFrame, pair: str, sep: str, outer: str, inner: str, between: str) -> DataFrame:
    """(geom_id, n, text): the geometry's polygons; rings are (geom_id, poly_id, ring_id, is_exterior, seq, x, y)."""
    keys = ["geom_id", "poly_id", "ring_id", "is_exterior"]
    rings = _ring_text(vertices, pair, sep, keys).select("geom_id", "poly_id", "ring_id", F.when(F.col("is_exterior"), F.format_string(outer, "text")).otherwise(F.format_string(inner, "text")).alias("text"))
    join = lambda order, s: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda x: x["text"]), s)
    polys = rings.groupBy("geom_id", "poly_id").agg(join("ring_id", "" if between == "" else ",").alias("text"))
    return polys, join


def kml_placemarks(vertices: DataFrame, names: DataFrame) -> DataFrame:
    """(geom_id, kml): a Placemark for each geometry; names is (geom_id, name). Several polygons are a MultiGeometry."""
    ring = "<{0}><LinearRing><coordinates>%s</coordinates></LinearRing></{0}>"
    polys, join = _polygons(vertices, "%s,%s,0", " ", ring.format("outerBoundaryIs"), ring.format("innerBoundaryIs"), "")
    polys = polys.select("geom_id", "poly_id", F.format_string("<Polygon>%s</Polygon>", "text").alias("text"))
    whole = polys.groupBy("geom_id").agg(F.count(F.lit(1)).alias("n"), join("poly_id", "").alias("text"))
    body = F.when(F.col("n") > 1, F.format_string("<MultiGeometry>%s</MultiGeometry>", "text")).otherwise(F.col("text"))
    name = F.coalesce(F.col("name"), F.lit("feição"))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        name = F.replace(name, F.lit(a), F.lit(b))
    return whole.join(names, "geom_id", "left").select("geom_id", F.format_string("<Placemark><name>%s</name>%s</Placemark>", name, body).alias("kml"))


def geojson_features(vertices: DataFrame, properties: DataFrame) -> DataFrame:
    """(geom_id, geojson): a Feature for each geometry; properties is (geom_id, ...)."""
    polys, join = _polygons(vertices, "[%s,%s]", ",", "[%s]", "[%s]", ",")
    polys = polys.select("geom_id", "poly_id", F.format_string("[%s]", "text").alias("text"))
    whole = polys.groupBy("geom_id").agg(F.count(F.lit(1)).alias("n"), join("poly_id", ",").alias("text"))
    shape = F.when(F.col("n") > 1, F.format_string('{"type":"MultiPolygon","coordinates":[%s]}', "text")).otherwise(F.format_string('{"type":"Polygon","coordinates":%s}', "text"))
    rest = [c for c in properties.columns if c != "geom_id"]
    props = F.coalesce(F.to_json(F.struct(*rest)) if rest else F.lit("{}"), F.lit("{}"))
    return whole.join(properties, "geom_id", "left").select("geom_id", F.format_string('{"type":"Feature","properties":%s,"geometry":%s}', props, shape).alias("geojson"))


def geojson_collections(features: DataFrame, key: str, epsg: int = 4674) -> DataFrame:
    """(key, geojson): a FeatureCollection with its reference system for each value of ``key`` (a property's code), of the features (key, geom_id, geojson) that have it, by geom_id. A property's features are few; null keys have no collection."""
    one = features.where(F.col(key).isNotNull()).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("geom_id", "geojson"))), lambda f: f["geojson"]), ",").alias("all"))
    head = f'{{"type":"FeatureCollection","crs":{{"type":"name","properties":{{"name":"urn:ogc:def:crs:EPSG::{epsg}"}}}},"features":['
    return one.select(key, F.concat(F.lit(head), "all", F.lit("]}")).alias("geojson"))
