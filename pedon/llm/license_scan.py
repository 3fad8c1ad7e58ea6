"""Licence scan: canonical digest lookup of whole texts.

A text's canonical form folds case, drops copyright lines, turns punctuation
and white space into single spaces and unifies equivalent spellings. The
SHA-256 of that form is joined to the digests of known licence texts.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pedon.llm.licence_texts import DIGESTS, LICENCES

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A line that begins with a copyright statement (a year, sign, holder in brackets or "by" follows the word), with its newline before.
COPYRIGHT_LINE = r"(^|\n)[ \t*#/;%-]*(copyright[ \t]*(\(c\)|©|[0-9\[<{(:]|by )|\(c\)|©|all rights reserved)[^\n]*"
#: Runs of ASCII that are neither letter nor digit (after folding).
PUNCTUATION = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Equivalent spellings (fixed values: the SPDX matching guidelines' list, as far as one word becomes one word).
SPELLINGS = {
    "acknowledgement": "acknowledgment",
    "analogue": "analog",
    "analyse": "analyze",
    "artefact": "artifact",
    "authorisation": "authorization",
    "authorised": "authorized",
    "calibre": "caliber",
    "cancelled": "canceled",
    "capitalisations": "capitalizations",
    "catalogue": "catalog",
    "categorise": "categorize",
    "centre": "center",
    "emphasised": "emphasized",
    "favour": "favor",
    "favourite": "favorite",
    "fulfil": "fulfill",
    "fulfilment": "fulfillment",
    "https": "http",
    "initialise": "initialize",
    "judgement": "judgment",
    "labelling": "labeling",
    "labour": "labor",
    "licence": "license",
    "licenced": "licensed",
    "maximise": "maximize",
    "modelled": "modeled",
    "modelling": "modeling",
    "offence": "offense",
    "optimise": "optimize",
    "organisation": "organization",
    "organise": "organize",
    "practise": "practice",
    "programme": "program",
    "realise": "realize",
    "recognise": "recognize",
    "signalling": "signaling",
    "sublicence": "sublicense",
    "utilisation": "utilization",
    "whilst": "while",
    "wilful": "willful",
}
#: Licence tables of at most so many rows are broadcast.
BROADCAST_ROWS = 100_000
#: Digest of the empty form.
EMPTY = hashlib.sha256(b"").hexdigest()


_SPACED = bytes(c if 0x30 <= c < 0x3A or 0x61 <= c < 0x7B or c >= 0x80 else 0x20 for c in (x + 32 if 0x41 <= x < 0x5B else x for x in range(256)))
_FOLDED = bytes(x + 32 if 0x41 <= x < 0x5B else x for x in range(256))
_LINE = re.compile(COPYRIGHT_LINE.encode())
_SPELL = {a.encode(): b.encode() for a, b in SPELLINGS.items()}


def canonical(text: bytes) -> bytes:
    """Canonical form of a UTF-8 text."""
    folded = text.translate(_FOLDED)
    if b"copyright" in folded or b"(c)" in folded or "©".encode() in folded or b"all rights reserved" in folded:
        folded = _LINE.sub(b"\n", folded)
    spell = _SPELL.get
    return b" ".join([spell(w, w) for w in folded.translate(_SPACED).split()])


def digests(rows: DataFrame, key: str, text_col: str) -> DataFrame:
    """(key, canonical_sha256, empty) of each row; null text counts as empty."""

    def run(batches):
        for batch in batches:
            forms = (canonical(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in batch.column(1).cast(pa.large_binary()))
            out = [(hashlib.sha256(c).hexdigest(), not c) for c in forms]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.bool_())], names=["key", "canonical_sha256", "empty"]
            )

    rows = rows.select(F.col(key).alias("key"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, canonical_sha256 string, empty boolean").withColumnRenamed("key", key)


def known_licences(spark: SparkSession) -> DataFrame:
    """(license_id, canonical_sha256) of the built-in licences."""
    return spark.createDataFrame(builtin_digests(), "license_id string, canonical_sha256 string")


def license_scan(docs: DataFrame, licences: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: (id_col, canonical_sha256, license_id, is_license).

    A text is a licence if its whole canonical form is that of one in
    ``licences``, which has (license_id, text) or (license_id,
    canonical_sha256); the smallest license_id wins where two share one form.
    Null and empty texts, and texts that are copyright lines only, have the
    empty form, which matches nothing. Repeated rows each get their row.
    """
    known = licences if "canonical_sha256" in licences.columns else digests(licences, "license_id", "text").where("not empty")
    known = known.where(F.col("canonical_sha256") != EMPTY).groupBy("canonical_sha256").agg(F.min("license_id").alias("license_id"))
    rows = digests(docs, id_col, text_col)
    if licences.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        known = F.broadcast(known)
    return rows.join(known, "canonical_sha256", "left").select(
        id_col, "canonical_sha256", "license_id", F.col("license_id").isNotNull().alias("is_license")
    )


def sql(digests: list[tuple[str, str]]) -> str:
    """DuckDB SQL for the scan of ``documents`` against (license_id, SHA-256 of the canonical form)."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    c = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
    c = f"regexp_replace({c}, {q(COPYRIGHT_LINE)}, chr(10), 'g')"
    c = f"' ' || regexp_replace({c}, {q(PUNCTUATION)}, '  ', 'g') || ' '"
    for a, b in SPELLINGS.items():
        c = f"replace({c}, ' {a} ', ' {b} ')"
    values = ", ".join(f"({q(i)}, '{d}')" for i, d in digests)
    return f"""
        WITH known(license_id, digest) AS (VALUES {values}),
        forms AS (SELECT doc_id, sha256(trim(regexp_replace({c}, ' +', ' ', 'g'))) AS canonical_sha256 FROM documents)
        SELECT doc_id, canonical_sha256, license_id, license_id IS NOT NULL AS is_license
        FROM forms LEFT JOIN known ON canonical_sha256 = digest
    """


def builtin_digests() -> list[tuple[str, str]]:
    """(license_id, SHA-256 of the canonical form) of the built-in licences."""
    return sorted([*DIGESTS.items(), *((i, hashlib.sha256(canonical(text.encode())).hexdigest()) for i, text in LICENCES.items())])
