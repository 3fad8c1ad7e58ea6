"""Reports, points and perimeters as DataFrames; every column is read as text, so that identifiers and decimal commas survive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pedon.operators.matching import lab_filter

# Names of coordinate columns.
LON, LAT = ["lon", "long", "longitude", "lng", "x"], ["lat", "latitude", "y"]


#: Lines at a file's beginning that tell its delimiter; their first characters count.
HEAD_LINES, HEAD_CHARACTERS = 4096, 4096


def _heads(spark: SparkSession, path: str) -> DataFrame:
    """(file, head, first): the first characters and the first line of each file, from its first block alone."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at")).where("start = 0")
    top = lines.withColumn("no", F.row_number().over(Window.partitionBy("file").orderBy("at"))).where(F.col("no") <= HEAD_LINES)
    whole = top.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", F.substring("value", 1, HEAD_CHARACTERS).alias("v")))), lambda x: x["v"]), "\n").alias("head"), F.min_by("value", "no").alias("first"))
    return whole.select("file", F.substring("head", 1, HEAD_CHARACTERS).alias("head"), F.regexp_replace("first", "^\ufeff", "").alias("first"))


def _csv(spark: SparkSession, path: str, sep: Column, file_col: str | None) -> DataFrame | None:
    """The files at ``path``, each by its own delimiter and header; columns are united by name. None without files that have a line.

    Files of one delimiter and header are read together, so there are as many
    scans as kinds of files.
    """
    kinds = _heads(spark, path).groupBy(sep.alias("sep"), "first").agg(F.array_sort(F.collect_list("file")).alias("files"), F.min("file").alias("least")).orderBy("least").collect()
    found = None
    for kind in kinds:
        rows = spark.read.csv(list(kind["files"]), sep=kind["sep"], header=True, inferSchema=False, multiLine=True)
        rows = rows.select(*[F.col(f"`{c}`").alias(c.lstrip("\ufeff")) for c in rows.columns], *([F.col("_metadata.file_path").alias(file_col)] if file_col else []))
        found = rows if found is None else found.unionByName(rows, allowMissingColumns=True)
    return found


def _more(text: str, sign: str, other: str, ties: bool) -> Column:
    count = lambda c: F.char_length(text) - F.char_length(F.replace(F.col(text), F.lit(c), F.lit("")))
    return F.when(count(sign) >= count(other) if ties else count(sign) > count(other), sign).otherwise(other)


def lab_csv(spark: SparkSession, path: str, wanted: str | None = None, file_col: str | None = None) -> DataFrame:
    """Laboratories' CSVs: a file's delimiter is ';' if its first 4096 characters have more of it than of ',', else ','; blank rows are dropped.

    Columns of several files are united by name, and a row has nulls where its
    file has no such column; ``file_col`` names a column for the file. With
    ``wanted``, only rows with a cell of that canonical form, or one that ends
    with it. A report without rows is an error.
    """
    rows = _csv(spark, path, _more("head", ";", ",", False), file_col)
    if rows is not None:
        own = [c for c in rows.columns if c != file_col]
        rows = rows.where(F.concat_ws("", *[F.trim(F.col(f"`{c}`")) for c in own]) != "")
        rows = lab_filter(rows, wanted) if wanted else rows
    if rows is None or rows.isEmpty():
        raise ValueError("the report has no rows")
    return rows


def sheet_csv(spark: SparkSession, path: str, file_col: str | None = None) -> DataFrame:
    """Spreadsheets' CSVs: a file's delimiter is ';' if its first line has as many of it as of ',' or more. A sheet without a header is an error."""
    rows = _csv(spark, path, _more("first", ";", ",", True), file_col)
    if rows is None:
        raise ValueError("the sheet has no header")
    return rows


def places_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(code, name, uf) of municipalities, tab separated without a header; shorter lines are left out."""
    rows = spark.read.csv(path, sep="\t", schema="code string, name string, uf string", header=False)
    return rows.where("uf is not null")


def points_csv(spark: SparkSession, path: str) -> DataFrame:
    """(props map, x, y); rows without coordinates are left out."""
    rows = lab_csv(spark, path)
    pick = lambda names: next(c for c in rows.columns if c.strip().lower() in names)
    x, y = pick(LON), pick(LAT)
    number = lambda c: F.replace(F.col(f"`{c}`"), F.lit(","), F.lit(".")).try_cast("double")
    props = F.map_from_arrays(F.array(*[F.lit(c) for c in rows.columns if c not in (x, y)]), F.array(*[F.col(f"`{c}`") for c in rows.columns if c not in (x, y)]))
    return rows.select(props.alias("props"), number(x).alias("x"), number(y).alias("y")).where("x is not null and y is not null")


def geojson_points(spark: SparkSession, path: str) -> DataFrame:
    """(props map, x, y) of the point features of a collection."""
    kind = "struct<features: array<struct<properties: map<string,string>, geometry: struct<type: string, coordinates: string>>>>"
    f = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)["features"]).alias("f"))
    xy = F.from_json("f.geometry.coordinates", "array<double>")
    return f.where("f.geometry.type = 'Point'").select(F.col("f.properties").alias("props"), xy[0].alias("x"), xy[1].alias("y"))


def _geometry_key() -> Column:
    return F.concat("file", F.lit("#"), F.col("no").cast("string")).alias("geom_id")


def kml_points(spark: SparkSession, path: str) -> DataFrame:
    """(props map, x, y) of the placemarks that hold a Point: its first coordinate, the name, and the attributes of Data and SimpleData.

    Of several points or names in a placemark the last counts. A Data's value is
    its first child's text. Attributes without a name, and placemarks without a
    coordinate, are left out. Markup is read by Spark's XPath functions, with
    name spaces taken off first.
    """
    plain = F.regexp_replace(F.regexp_replace("value", r"<(/?)[\w.-]+:", "<$1"), r"\s(?:xmlns(?::[\w.-]+)?|[\w.-]+:[\w.-]+)\s*=\s*(?:\"[^\"]*\"|'[^']*')", "")
    marks = spark.read.text(path, wholetext=True).select(F.explode(F.regexp_extract_all(plain, F.lit(r"(?s)<Placemark(?:\s[^>]*)?>.*?</Placemark>"), 0)).alias("p"))
    item = r"(?s)<((?:Simple)?Data)(?=[\s>])(?:[^>]*/>|.*?</\1>)"
    m = marks.select("p", F.regexp_extract_all("p", F.lit(item), 0).alias("items"), F.xpath("p", F.lit("//Point//coordinates/text()")).alias("places"), F.xpath("p", F.lit("//name/text()")).alias("names"))
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    value = lambda d: strip(F.when(d.startswith("<Data"), F.xpath_string(d, F.lit("/Data/*[1]"))).otherwise(F.xpath_string(d, F.lit("/SimpleData"))))
    own = F.filter(F.transform("items", lambda d: F.struct(F.xpath_string(d, F.lit("/*/@name")).alias("key"), F.coalesce(value(d), F.lit("")).alias("value"))), lambda e: e["key"] != "")
    name = F.array(F.struct(F.lit("name").alias("key"), F.coalesce(strip(F.try_element_at("names", F.lit(-1))), F.lit("")).alias("value")))
    # a repeated name: the last counts
    entries = F.concat(name, own)
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == e["key"]))
    place = F.split(F.split(strip(F.try_element_at("places", F.lit(-1))), r"\s+")[0], ",")
    at = m.select(F.map_from_entries(last).alias("props"), F.get(place, F.lit(0)).try_cast("double").alias("x"), F.get(place, F.lit(1)).try_cast("double").alias("y"))
    return at.where("x is not null and y is not null")


def geojson_rings(spark: SparkSession, path: str) -> DataFrame:
    """(geom_id, poly_id, ring_id, is_exterior, seq, x, y) of the polygons of collections, single features and bare geometries; other geometries have no rows. geom_id is the file and the feature's place in it."""
    shape = "struct<type: string, coordinates: string>"
    kind = f"struct<type: string, coordinates: string, geometry: {shape}, features: array<struct<geometry: {shape}>>>"
    f = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", kind).alias("f"))
    one = F.struct(F.coalesce("f.geometry.type", "f.type").alias("type"), F.coalesce("f.geometry.coordinates", "f.coordinates").alias("coordinates"))
    all_ = F.when(F.col("f.features").isNotNull(), F.transform("f.features", lambda x: x["geometry"])).otherwise(F.array(one))
    g = f.select("file", F.posexplode(all_).alias("no", "g")).select(_geometry_key(), "g")
    ring = "array<array<array<double>>>"
    polys = F.when(F.col("g.type") == "Polygon", F.array(F.from_json("g.coordinates", ring))).when(F.col("g.type") == "MultiPolygon", F.from_json("g.coordinates", f"array<{ring}>"))
    r = g.select("geom_id", F.posexplode(polys).alias("poly_id", "rings")).select("geom_id", "poly_id", F.posexplode("rings").alias("ring_id", "ring"))
    v = r.select("geom_id", "poly_id", "ring_id", (F.col("ring_id") == 0).alias("is_exterior"), F.posexplode("ring").alias("seq", "p"))
    return v.select("geom_id", "poly_id", "ring_id", "is_exterior", "seq", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))


def kml_rings(spark: SparkSession, path: str) -> DataFrame:
    """(geom_id, ring_id, is_exterior, seq, x, y): every coordinate list inside a Polygon; geom_id is the file and the polygon's place in it."""
    polygon = F.regexp_extract_all("value", F.lit(r"(?s)<(?:\w+:)?Polygon[ >].*?</(?:\w+:)?Polygon>"), 0)
    g = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(polygon).alias("no", "p")).select(_geometry_key(), "p")
    part = F.regexp_extract_all("p", F.lit(r"(?s)<(?:\w+:)?(outerBoundaryIs|innerBoundaryIs)>.*?<(?:\w+:)?coordinates>.*?</(?:\w+:)?coordinates>"), 0)
    r = g.select("geom_id", F.posexplode(part).alias("ring_id", "r"))
    text = F.regexp_extract("r", r"(?s)coordinates>(.*?)</", 1)
    v = r.select("geom_id", "ring_id", F.col("r").contains("outerBoundaryIs").alias("is_exterior"), F.posexplode(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")).alias("seq", "c")).withColumn("c", F.split("c", ","))
    return v.select("geom_id", "ring_id", "is_exterior", "seq", F.col("c")[0].try_cast("double").alias("x"), F.col("c")[1].try_cast("double").alias("y"))


def wkt_rings(rows: DataFrame, id_col: str = "geom_id", wkt_col: str = "wkt") -> DataFrame:
    """(geom_id, ring_id, seq, x, y) of polygons in WKT; other geometries have no rows."""
    rings = F.regexp_extract_all(F.col(wkt_col), F.lit(r"\(([^()]+)\)"), 1)
    r = rows.where(F.upper(wkt_col).contains("POLYGON")).select(F.col(id_col).alias("geom_id"), F.posexplode(rings).alias("ring_id", "ring"))
    v = r.select("geom_id", "ring_id", F.posexplode(F.split("ring", ",")).alias("seq", "pair")).withColumn("p", F.split(F.trim("pair"), r"\s+"))
    return v.select("geom_id", "ring_id", "seq", F.col("p")[0].try_cast("double").alias("x"), F.col("p")[1].try_cast("double").alias("y"))


def prj_zone(text: str) -> str:
    """SQL for struct(zone, south) of a .prj text column."""
    return f"struct(try_cast(regexp_extract({text}, '(?i)UTM[_ ]?zone[_ ]?([0-9]+)', 1) as int) as zone, {text} rlike '(?i)UTM[_ ]?zone[_ ]?[0-9]+ *S' or {text} rlike 'false_northing\\\\W+10000000' as south)"
