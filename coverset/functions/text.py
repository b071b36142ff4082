"""Line-notation text: normalising and counting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns of the usual one-line structure notation.
ISOTOPE_LABEL = r"\[\d+([A-Za-z])"
TEXT_PATTERNS = {
    "heavy_atoms": r"Cl|Br|[BCNOPSFI]|[bcnops]|\*",
    "aromatic_atoms": r"[bcnops]",
    "ring_closures": r"%\d\d|\d",
    "carbon": r"C(?!l)|c",
    "nitrogen": r"N|n",
    "oxygen": r"O|o",
    "sulfur": r"S|s",
    "halogen": r"F|Cl|Br|I",
}


def normalise_smiles_text(column: str | Column, largest_fragment: bool = False) -> Column:
    """Drop isotope labels in brackets; optionally keep the longest ``.``-separated part.

    Equal lengths keep the first part.
    """
    c = F.col(column) if isinstance(column, str) else column
    plain = F.regexp_replace(F.trim(c), ISOTOPE_LABEL, "[$1")
    if not largest_fragment:
        return plain
    longer = lambda kept, part: F.when(F.length(part) > F.length(kept), part).otherwise(kept)
    return F.aggregate(F.split(plain, r"\."), F.lit(""), longer)


def bare_atoms(column: str | Column) -> Column:
    """Bracket atoms by their element alone: the usual ones as bare symbols, others as ``*``, hydrogen as nothing."""
    c = F.col(column) if isinstance(column, str) else column
    plain = F.regexp_replace(c, r"\[\d*H[^a-z\]]*\]", "")
    plain = F.regexp_replace(plain, r"\[\d*(Cl|Br|[BCNOPSFI](?![a-z])|[bcnops](?![a-z]))[^\]]*\]", "$1")
    return F.regexp_replace(plain, r"\[[^\]]*\]", "*")


def text_counts(df: DataFrame, column: str, patterns: dict[str, str] | None = None) -> DataFrame:
    """Add one ``long`` column per pattern: its matches in the text (null text gives null).

    The default patterns count atoms after ``bare_atoms``, and each ring closure
    once for its two marks.
    """
    text = F.col(column) if patterns else bare_atoms(column)
    made = {name: F.regexp_count(text, F.lit(pattern)).cast("long") for name, pattern in (patterns or TEXT_PATTERNS).items()}
    if not patterns:
        made["ring_closures"] = F.call_function("div", made["ring_closures"], F.lit(2).cast("long"))
    return df.withColumns(made)
