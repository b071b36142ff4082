"""Multi-line SDF records as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Record end, field patterns and the fixed-width counts and atom lines.
RECORD_MARK, RECORD_END = "$$$$", "$$$$\n"
FIELD = r"(?m)^>[^<\n]*<([^>\n]+)>[^\n]*\n((?:[^\n]+\n?)*)"
COUNTS_LINE = r"^[^\n]*\n[^\n]*\n[^\n]*\n([ \d]{3})[^\n]*V2000"
ATOM_LINE = r"(?m)^ *(-?\d+\.\d+) *(-?\d+\.\d+) *(-?\d+\.\d+) +([A-Z][a-z]?)\b"
# The newer block: counts and atoms on lines with a prefix, a line that ends in a hyphen goes on in the next.
NEW_COUNTS = r"(?m)^M  V30 COUNTS +(\d+)"
NEW_ATOMS = r"(?s)M  V30 BEGIN ATOM\n(.*?)M  V30 END ATOM"
NEW_ATOM_LINE = r"(?m)^M  V30 +\d+ +([A-Z][a-z]?)\S* +(-?\d+(?:\.\d*)?(?:[eE][-+]?\d+)?) +(-?\d+(?:\.\d*)?(?:[eE][-+]?\d+)?) +(-?\d+(?:\.\d*)?(?:[eE][-+]?\d+)?)"
NEW_BLOCK = r"^[^\n]*\n[^\n]*\n[^\n]*\n[^\n]*V3000"
NEW_JOIN = r"-[ \t]*\nM  V30 "
NAME_FIELD = "IDNUMBER"

# Mass of the main isotope of common elements.
ELEMENT_MASS = {
    "H": 1.00782503223, "B": 11.00930536, "C": 12.0, "N": 14.00307400443, "O": 15.99491461957,
    "F": 18.99840316273, "Na": 22.989769282, "Si": 27.97692653465, "P": 30.97376199842,
    "S": 31.9720711744, "Cl": 34.968852682, "K": 38.9637064864, "Br": 78.9183376, "I": 126.9044719,
    "Li": 7.0160034366, "Be": 9.012183065, "Mg": 23.985041697, "Al": 26.98153853, "Ca": 39.962590863, "Ti": 47.94794198,
    "Cr": 51.94050623, "Mn": 54.93804391, "Fe": 55.93493633, "Co": 58.93319429, "Ni": 57.93534241, "Cu": 62.92959772,
    "Zn": 63.92914201, "As": 74.92159457, "Se": 79.9165218, "Pd": 105.9034804, "Ag": 106.9050916, "Sn": 119.90220163,
    "Pt": 194.9647917, "Au": 196.96656879, "Hg": 201.9706434,
}


def parse_records(records: DataFrame, column: str = "record") -> DataFrame:
    """``(name, props, atoms, n_atoms, is_valid, record, elements)`` from record text.

    A record is valid when its counts line can be read and as many atom lines
    follow as it announces, in a V2000 or a V3000 block.
    """
    # Each step is a column of its own: inside a lambda an expression would be searched for again with every element.
    text, keys, values, newer, block = (F.col(f"_{c}") for c in ("text", "keys", "values", "newer", "block"))
    records = records.select(F.col(column).alias("record"), F.regexp_replace(F.col(column), "\r\n", "\n").alias("_text"))
    records = records.select(
        "record",
        "_text",
        F.regexp_extract_all(text, F.lit(FIELD), F.lit(1)).alias("_keys"),
        F.transform(F.regexp_extract_all(text, F.lit(FIELD), F.lit(2)), lambda v: F.regexp_replace(v, r"\n+$", "")).alias("_values"),
        text.rlike(NEW_BLOCK).alias("_newer"),
        F.element_at(F.split(text, r"(?m)^M  END", 2), 1).alias("_block"),
    )
    # A repeated field keeps its last value.
    pairs = F.arrays_zip(keys.alias("k"), values.alias("v"))
    unique = F.filter(
        F.transform(pairs, lambda p, i: F.struct(p["k"].alias("k"), p["v"].alias("v"), i.alias("i"))),
        lambda p: F.size(F.filter(F.slice(keys, p["i"] + 2, F.greatest(F.size(keys), F.lit(1))), lambda k: k == p["k"])) == 0,
    )
    fields = F.map_from_entries(F.transform(unique, lambda p: F.struct(p["k"], p["v"])))
    joined = F.regexp_replace(block, NEW_JOIN, "")

    def atoms_of(lines, pattern: str, element: int, first: int):
        groups = [F.regexp_extract_all(lines, F.lit(pattern), F.lit(k)).alias(n) for k, n in ((element, "e"), (first, "x"), (first + 1, "y"), (first + 2, "z"))]
        return F.transform(
            F.arrays_zip(*groups),
            lambda a: F.struct(a["e"].alias("elem"), a["x"].cast("double").alias("x"), a["y"].cast("double").alias("y"), a["z"].cast("double").alias("z")),
        )

    atoms = F.when(newer, atoms_of(F.regexp_extract(joined, NEW_ATOMS, 1), NEW_ATOM_LINE, 1, 2)).otherwise(atoms_of(block, ATOM_LINE, 4, 1))
    # Counted by one search, so that a report need not take the atoms apart.
    listed = F.when(newer, F.regexp_count(F.regexp_extract(joined, NEW_ATOMS, 1), F.lit(NEW_ATOM_LINE))).otherwise(F.regexp_count(block, F.lit(ATOM_LINE)))
    # The elements alone, so that a weight need not either.
    elements = F.when(newer, F.regexp_extract_all(F.regexp_extract(joined, NEW_ATOMS, 1), F.lit(NEW_ATOM_LINE), F.lit(1))).otherwise(
        F.regexp_extract_all(block, F.lit(ATOM_LINE), F.lit(4))
    )
    announced = F.when(newer, F.regexp_extract(joined, NEW_COUNTS, 1)).otherwise(F.trim(F.regexp_extract(text, COUNTS_LINE, 1))).try_cast("int")
    return (
        records.select("record", fields.alias("props"), atoms.alias("atoms"), listed.alias("n_atoms"), announced.alias("announced"), elements.alias("elements"))
        .select(
            F.coalesce(F.trim(F.try_element_at("props", F.lit(NAME_FIELD))), F.lit("")).alias("name"),
            "props",
            "atoms",
            "n_atoms",
            F.coalesce(F.col("announced") == F.col("n_atoms"), F.lit(False)).alias("is_valid"),
            "record",
            "elements",
        )
    )


def read_sdf_records(spark: SparkSession, path: str) -> DataFrame:
    """Scan SDF files: one row per record, split by the record mark whatever line ends follow it."""
    raw = spark.read.option("lineSep", RECORD_MARK).text(path).withColumnRenamed("value", "record").filter(F.col("record").rlike(r"\S"))
    # What is left of the mark's line goes; a file's first record has no such rest, but may begin with an empty title.
    tail = F.regexp_replace("record", r"^[ \t]*\r?\n", "")
    titled = F.regexp_replace("record", "\r\n", "\n").rlike(f"{COUNTS_LINE}|{NEW_BLOCK}")
    raw = raw.select(F.when(titled, F.col("record")).otherwise(tail).alias("record"))
    return parse_records(raw)


def record_weight(spark: SparkSession, records: DataFrame) -> DataFrame:
    """Add ``mol_weight``: summed mass of the listed atoms; null if an element is unknown."""
    masses = F.create_map(*[F.lit(v) for pair in ELEMENT_MASS.items() for v in pair])
    elements = F.col("elements") if "elements" in records.columns else F.transform("atoms", lambda a: a["elem"])
    parts = F.transform(elements, lambda e: F.try_element_at(masses, e))
    return records.withColumn("mol_weight", F.aggregate(parts, F.lit(0.0), lambda s, m: s + m))


def sdf_to_table(records: DataFrame) -> DataFrame:
    """``(name, mol_weight)`` of the readable records; weights rounded to 2 decimals.

    Only atoms listed in the record count: implicit hydrogens are not added. A
    record with an element of unknown mass stays, without a weight.
    """
    weighed = record_weight(records.sparkSession, records)
    # Not a filter: pushed below the parsed columns it would search the text again for each of them.
    row = F.struct("name", F.round("mol_weight", 2).alias("mol_weight"))
    return weighed.select(F.inline(F.when(F.col("is_valid"), F.array(row))))


def conversion_report(records: DataFrame) -> DataFrame:
    """One row: total, processed and failed records, and processed ones without a name."""
    ok = F.col("is_valid")
    return records.agg(
        F.count("*").alias("total"),
        F.count_if(ok).alias("processed"),
        F.count_if(~ok).alias("failed"),
        F.count_if(ok & (F.trim(F.coalesce("name", F.lit(""))) == "")).alias("empty_names"),
    )


def write_sdf_records(records: DataFrame, path: str, compression: str | None = None) -> None:
    """Write record texts verbatim, ended by the record mark; null records are left out."""
    records.filter("record IS NOT NULL").select("record").write.option("lineSep", RECORD_END).text(path, compression=compression)
