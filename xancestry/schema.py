"""Names, patterns and tokens that the engine's tables share."""

from __future__ import annotations

from pyspark.sql import types as T

# Standard column names, the patterns that source columns are told by, tokens that mean null,
# allowed chromosomes and bases, frequency bounds.
STANDARD = ("SNP", "BP", "CHR", "BETA", "FREQ", "SE", "A1", "A2", "P", "INFO", "N", "Z")
REQUIRED = ("SNP", "CHR", "BETA", "FREQ", "SE", "A1", "A2", "BP", "P")
PATTERNS = {
    "SNP": ".*SNP.*|.*RS.*",
    "BP": ".*BP.*|.*POS.*",
    "CHR": ".*CHR.*",
    "BETA": ".*BETA.*",
    "FREQ": ".*FREQ.*|.*FRQ.*|.*AF",
    "SE": ".*SE.*",
    "A1": ".*A1.*|.*MAJOR.*|.*EFFECT.*ALL.*|REF.*",
    "A2": ".*A2.*|.*MINOR.*|.*OTHER.*ALL.*|ALT.*",
    "P": "P|P.*VAL.*",
    "INFO": "INFO",
    "N": "N",
}
NULLS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "n/a", "nan", "null")
CHROMOSOMES = (*map(str, range(1, 23)), "X", "Y")
BASES, COMPLEMENTS = "ACGT", "TGCA"
FREQUENCIES = (0.01, 0.99)

TYPES = {"SNP": T.StringType(), "CHR": T.StringType(), "A1": T.StringType(), "A2": T.StringType(), "BP": T.LongType()}


def type_of(name: str) -> T.DataType:
    return TYPES.get(name, T.DoubleType())
