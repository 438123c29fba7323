"""Scalar expressions that several operators use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Monoisotopic residue masses, of the two termini and the proton: fixed values.
RESIDUE_MASS = {
    "G": 57.02146, "A": 71.03711, "S": 87.03203, "P": 97.05276, "V": 99.06841, "T": 101.04768, "C": 103.00918, "L": 113.08406,
    "I": 113.08406, "N": 114.04293, "D": 115.02694, "Q": 128.05858, "K": 128.09496, "E": 129.04259, "M": 131.04048, "O": 132.08988,
    "H": 137.05891, "F": 147.06841, "U": 150.95363, "R": 156.10111, "Y": 163.06333, "W": 186.07931,
}
N_TERMINUS, C_TERMINUS, PROTON = 1.007825, 17.00274, 1.00727649
#: What may be added to a residue or terminus (n, c): fixed values.
MODIFICATIONS = (
    ("K", 42.0106), ("n", 42.0106), ("C", 57.0215), ("C", 58.0055), ("Q", 0.9840), ("N", 0.9840),
    ("c", 14.0157), ("M", 15.9949), ("S", 79.9663), ("T", 79.9663), ("Y", 79.9663),
)


def rounded(x: Column, places: int) -> Column:
    """Half to even after scaling, as numpy rounds."""
    scale = 10.0**places
    return F.rint(x * scale) / scale


def extracted(text: Column, pattern: str) -> Column:
    """The first group of a pattern, null where it doesn't match."""
    # not nullif: within a coalesce it would search the text twice
    return F.get(F.array_remove(F.array(F.regexp_extract(text, pattern, 1)), ""), F.lit(0))


def once(x: Column) -> Column:
    """x as a column of its own (alone in a select): conditions on it read it, instead of computing it once more for each of them."""
    return F.explode(F.array(x))


def attribute_map(text: Column) -> Column:
    """Column 9 of an annotation as a map: k=v first, else k "v", other parts go; of equal keys the last stays."""
    parts = F.filter(F.transform(F.split(text, ";"), lambda p: F.trim(p)), lambda p: p.contains("=") | p.contains(" "))
    pairs = F.transform(parts, lambda p: F.when(p.contains("="), F.struct(F.trim(F.substring_index(p, "=", 1)).alias("k"), F.regexp_extract(p, "=(.*)$", 1).alias("v"))).otherwise(F.struct(F.substring_index(p, " ", 1).alias("k"), F.regexp_extract(p, r"\s+(.*)$", 1).alias("v"))))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p["k"], F.regexp_replace(F.trim(p["v"]), '^"+|"+$', ""))))


def residues(sequence: Column) -> Column:
    """I as L, stops removed."""
    return F.translate(sequence, "I*", "L")


def peptide_mass(peptide: Column) -> Column:
    """Of the protonated peptide; letters that are no residue weigh nothing."""
    table = F.create_map(*[F.lit(x) for kv in RESIDUE_MASS.items() for x in kv])
    return F.aggregate(F.split(peptide, ""), F.lit(C_TERMINUS + N_TERMINUS + PROTON), lambda a, c: a + F.coalesce(F.element_at(table, c), F.lit(0.0)))


def searchable(peptide: Column, least: int = 5) -> Column:
    """Whether a peptide can be looked up: long enough, and of the twenty residues only."""
    return (F.length(peptide) >= least) & peptide.rlike("^[ACDEFGHIKLMNPQRSTVWY]+$")


def general_number(x: Column) -> Column:
    """A double in up to six significant digits without trailing zeros, as %g writes it."""
    exponent = F.floor(F.log10(F.abs(x))).cast("int")
    scale = F.pow(F.lit(10.0), 5 - exponent)
    six = F.rint(x * scale) / scale
    plain = F.format_string("%.10f", six)
    plain = F.regexp_replace(F.regexp_replace(plain, "0+$", ""), r"\.$", "")
    mantissa = F.regexp_replace(F.regexp_replace(F.format_string("%.5f", six / F.pow(F.lit(10.0), exponent)), "0+$", ""), r"\.$", "")
    power = F.concat(mantissa, F.lit("e"), F.when(exponent < 0, "-").otherwise("+"), F.lpad(F.abs(exponent).cast("string"), 2, "0"))
    return F.when(x == 0, "0").when((exponent < -4) | (exponent >= 6), power).otherwise(plain)
