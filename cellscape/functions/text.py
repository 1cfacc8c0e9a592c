"""Normalisers for names, bands and flags."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Technology by band letter, accepted spellings of yes, band by cell-name letter.
TECHNOLOGY_BY_LETTER = {"L": "LTE", "N": "NR", "U": "UMTS", "G": "GSM"}
YES_WORDS = ["y", "yes", "true", "1"]
NO_WORDS = ["n", "no", "false", "0"]
BAND_BY_CELL_LETTER = {"K": "L700", "L": "L800", "H": "L1800", "T": "L2100"}


def choose(key: Column, table: dict, default: Column | None = None) -> Column:
    """CASE expression over a small fixed table."""
    out = default if default is not None else F.lit(None)
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def normalise_band(band: Column, keep_nr: bool = False) -> Column:
    """Upper-case band with an L prefix; ``keep_nr`` leaves NR bands (N78) unprefixed."""
    cleaned = F.regexp_replace(F.upper(F.trim(band.cast("string"))), r"\.0$", "")
    has_prefix = cleaned.startswith("L")
    if keep_nr:
        has_prefix = has_prefix | cleaned.rlike(r"^N\d")
    return F.when(has_prefix, cleaned).otherwise(F.concat(F.lit("L"), cleaned))


def yes_no(flag: Column) -> Column:
    return F.when(F.lower(F.trim(flag.cast("string"))).isin(YES_WORDS), "y").otherwise("n")


def neighbour_relation(flag: Column) -> Column:
    """Y, N or N/A for a neighbour-list flag of mixed spelling."""
    word = F.lower(F.trim(flag.cast("string")))
    return F.when(word.isin(YES_WORDS), "Y").when(word.isin(NO_WORDS), "N").otherwise("N/A")


def technology(band: Column) -> Column:
    return choose(F.substring(F.upper(F.trim(band.cast("string"))), 1, 1), TECHNOLOGY_BY_LETTER, F.lit("UNKNOWN"))


def pci_in_range(pci: Column, band: Column) -> Column:
    """LTE identities run 0-503, NR ones 0-1007."""
    name = F.upper(F.trim(band.cast("string")))
    is_nr = name.startswith("N") | name.contains("NR")
    return pci.between(F.lit(0), F.when(is_nr, F.lit(1007)).otherwise(F.lit(503)))


def site_from_cell(cell_name: Column, prefix_length: int | None = None) -> Column:
    """Site id: the first characters, or the name without its last two."""
    if prefix_length is not None:
        return F.substring(cell_name, 1, prefix_length)
    return F.when(F.length(cell_name) > 2, F.substr(cell_name, F.lit(1), F.length(cell_name) - 2)).otherwise(cell_name)


def site_and_sector(cell_name: Column, pattern: str) -> Column:
    """struct(site, sector) from a two-group pattern; null when it does not match."""
    hit = cell_name.rlike(pattern)
    return F.when(
        hit,
        F.struct(
            F.regexp_extract(cell_name, pattern, 1).alias("site"),
            F.regexp_extract(cell_name, pattern, 2).alias("sector"),
        ),
    )


def band_from_cell(cell_name: Column) -> Column:
    """Band from the letter before the trailing digits of a cell name."""
    letter = F.regexp_extract(F.upper(cell_name), r"([KLHT])\d$", 1)
    return choose(letter, BAND_BY_CELL_LETTER)
