"""Property registry: place names from codes and filling of sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pedon.functions.text import br_format, degrees, plain, registry_code


# Numbers of the states, their letters and names.
STATES = """
11 RO Rondônia; 12 AC Acre; 13 AM Amazonas; 14 RR Roraima; 15 PA Pará; 16 AP Amapá; 17 TO Tocantins; 21 MA Maranhão; 22 PI Piauí;
23 CE Ceará; 24 RN Rio Grande do Norte; 25 PB Paraíba; 26 PE Pernambuco; 27 AL Alagoas; 28 SE Sergipe; 29 BA Bahia; 31 MG Minas Gerais;
32 ES Espírito Santo; 33 RJ Rio de Janeiro; 35 SP São Paulo; 41 PR Paraná; 42 SC Santa Catarina; 43 RS Rio Grande do Sul;
50 MS Mato Grosso do Sul; 51 MT Mato Grosso; 52 GO Goiás; 53 DF Distrito Federal
"""


def states() -> list[tuple[str, str, str]]:
    """(number, letters, name) of each state."""
    return [tuple(x.split(None, 2)) for x in " ".join(STATES.split()).split("; ")]


def locate(rows: DataFrame, places: DataFrame, code_col: str = "code") -> DataFrame:
    """``rows`` with (place, uf, state) by a registry code; places is (code, name, uf), one row for each code.

    The municipality's number decides; where ``places`` lacks it, its first two
    digits give the state alone, and place is ''. Invalid codes have nulls.
    """
    pairs = lambda i, j: F.create_map(*[F.lit(x) for s in states() for x in (s[i], s[j])])
    p = places.groupBy(F.col("code").alias("_m")).agg(F.min(F.struct("name", "uf")).alias("_p"))
    got = rows.withColumn("_c", F.substring(registry_code(code_col), 4, 7)).join(p, F.col("_c") == F.col("_m"), "left")
    uf = F.coalesce("_p.uf", pairs(0, 1)[F.substring("_c", 1, 2)])
    return got.select(*rows.columns, F.coalesce("_p.name", F.when(F.col("_c").isNotNull(), "")).alias("place"), uf.alias("uf"), pairs(1, 2)[uf].alias("state"))


def result_rows(records: DataFrame, decimal: bool = True) -> DataFrame:
    """(code, latitude, longitude, area, place, state, uf, modules, created) of registry records, as a sheet shows them: decimal commas, '' for what is missing."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    angle = lambda c: F.when(text(c) != "", F.coalesce(degrees(c).cast("string"), F.lit(""))).otherwise("") if decimal else text(c)
    number = lambda c: F.coalesce(br_format(c), F.lit(""))
    return records.select(
        F.col("codeProperty").alias("code"), angle("latitude").alias("latitude"), angle("longitude").alias("longitude"), number("haRegisteredArea").alias("area"), text("nameCity").alias("place"),
        text("nameState").alias("state"), text("idState").alias("uf"), number("fiscalModules").alias("modules"), text("createdAt").alias("created"),
    )


def fill(sheet: DataFrame, records: DataFrame, code_col: str, targets: list[str], overwrite: bool = False, offline: DataFrame | None = None, status_col: str = "status") -> DataFrame:
    """``sheet`` with its blank target cells filled from ``records`` (code, targets...), and a status: invalid, not found or found.

    ``offline`` (code and some of the targets) fills first; a record then takes
    the place of what offline filled, and a code without record counts as not
    found though its offline cells stay. Columns that the sheet lacks are
    appended in the order of ``targets``; of several records for a code the
    smallest counts. The status column must be a new one.
    """
    if status_col in sheet.columns:
        raise ValueError(f"the sheet has a column {status_col}")
    rows = sheet.withColumn("_code", registry_code(code_col))
    got, sources = rows, []
    for name, source in (("_new", records), ("_off", offline)):
        if source is None:
            continue
        has = [t for t in targets if t in source.columns]
        known = source.groupBy(F.col("code").alias(f"{name}_code")).agg(F.min(F.struct(*has)).alias(name))
        got = got.join(known, F.col("_code") == F.col(f"{name}_code"), "left")
        sources.append((name, has))
    blank = lambda c: (F.trim(F.coalesce(F.col(c), F.lit(""))) == "") | F.lit(overwrite)
    new = {}
    for t in targets:
        found = F.coalesce(*[F.col(f"{name}.{t}") for name, has in sources if t in has], F.lit(None).cast("string"))
        new[t] = F.when(blank(t), F.coalesce(found, F.col(t))).otherwise(F.col(t)) if t in sheet.columns else found
    status = F.when(F.col("_code").isNull(), "invalid").when(F.col("_new").isNull(), "not found").otherwise("found")
    return got.select(*[new.get(c, F.col(c)).alias(c) for c in sheet.columns], *[new[t].alias(t) for t in targets if t not in sheet.columns], status.alias(status_col))


def fill_summary(filled: DataFrame, targets: list[str], status_col: str = "status") -> DataFrame:
    """One row: (total, invalid, not_found, found, complete, partial); complete and partial are found rows with all or only some targets filled."""
    full = F.lit(True)
    for t in targets:
        full &= F.trim(F.coalesce(F.col(t), F.lit(""))) != ""
    found = F.col(status_col) == "found"
    n = lambda c, name: F.count_if(c).alias(name)
    return filled.agg(F.count(F.lit(1)).alias("total"), n(F.col(status_col) == "invalid", "invalid"), n(F.col(status_col) == "not found", "not_found"), n(found, "found"), n(found & full, "complete"), n(found & ~full, "partial"))


# What a header holds, and the field it then stands for; the first that fits an unused field counts.
HEADER_FIELDS = [("latitude", "latitude"), ("longitude", "longitude"), ("area", "area"), ("municipio", "municipio"), ("cidade", "municipio"), ("estado", "estado"), ("uf", "uf"), ("modulo", "modulos"), ("cadastro", "cadastro"), ("data", "cadastro")]
CODE_HEADERS = ["car", "registro"]


def map_headers(headers: Column) -> Column:
    """array<struct<position, field>> of an array of a sheet's headers, positions from 0: which columns hold which field, and the first that holds the code ("code").

    Headers are compared without accents and case. A header takes the first
    field of HEADER_FIELDS that it holds and no header before it took; others
    have no entry, and neither have null headers.
    """
    rules = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(f).alias("field")) for k, f in HEADER_FIELDS])
    start = F.struct(F.lit(-1).alias("at"), F.array().cast("array<struct<position: int, field: string>>").alias("found"))

    def step(state: Column, header: Column) -> Column:
        at, taken = state["at"] + 1, F.transform(state["found"], lambda e: e["field"])
        key = F.lower(plain(F.coalesce(header, F.lit(""))))
        code = F.lit(False)
        for c in CODE_HEADERS:
            code |= key.contains(c)
        free = F.filter(rules, lambda r: key.contains(r["key"]) & ~F.array_contains(taken, r["field"]))
        field = F.when(code & ~F.array_contains(taken, "code"), "code").otherwise(F.get(free, F.lit(0))["field"])
        entry = F.when(field.isNotNull(), F.array(F.struct(at.alias("position"), field.alias("field")))).otherwise(F.array().cast("array<struct<position: int, field: string>>"))
        return F.struct(at.alias("at"), F.concat(state["found"], entry).alias("found"))

    return F.aggregate(headers, start, step)["found"]
