"""Column expressions: cleaning of identifiers and text, photometry, geometry, hashing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Trim every kind of white space, not just spaces."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def canonical_id(c: Column) -> Column:
    """Identifier as trimmed text; a printed bytes literal (b'...') gives its content, other values stay."""
    text = strip(c.cast("string"))
    literal = r"(?s)^b(['\"])(.*)\1$"
    return F.when(text.rlike(literal), strip(F.regexp_extract(text, literal, 2))).otherwise(text)


def refuse(why: str | Column) -> Column:
    """Where this is evaluated, the job stops with that message: a check that costs no pass of its own."""
    return F.raise_error(why if isinstance(why, Column) else F.lit(why)).cast("string")


def missing(c: Column) -> Column:
    """NaN as null."""
    return F.nanvl(c, F.lit(None).cast("double"))


def distance_regime(z: Column) -> Column:
    """Redshift bucket with edges 0.1, 0.5, 1 and 2; null stays null."""
    # Bucket names.
    return F.when(z < 0.1, "very close (local universe)").when(z < 0.5, "close").when(z < 1, "intermediate").when(z < 2, "far").when(z.isNotNull(), "very far (high redshift)")


def magnitude(flux: Column) -> Column:
    """Difference magnitude at zero point 27.5; null where the flux is zero."""
    return F.when(flux != 0, 27.5 - 2.5 * F.log10(F.abs(flux)))


def magnitude_error(flux: Column, err: Column) -> Column:
    return F.when(flux != 0, err * (2.5 / F.ln(F.lit(10.0))) / F.abs(flux))


def snr(flux: Column, err: Column) -> Column:
    """Flux over error; 0 without a positive error. NaN ranks above all numbers in comparisons, so it is left out by name."""
    return F.when((err > 0) & ~F.isnan(err), flux / err).otherwise(0.0)


def band_name(c: Column) -> Column:
    return F.when(c == 1, "g").when(c == 2, "r").otherwise(c.cast("string"))


def canonical_band(label: Column) -> Column:
    """Last part of a label behind '-' or '_', in lower case."""
    return F.element_at(F.split(F.lower(strip(label)), "[-_]"), -1)


def haversine_arcsec(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """Angular separation; keeps its precision at small angles."""
    d1, d2 = F.radians(dec1), F.radians(dec2)
    h = F.pow(F.sin((d2 - d1) / 2), 2) + F.cos(d1) * F.cos(d2) * F.pow(F.sin(F.radians(ra2 - ra1) / 2), 2)
    return F.degrees(2 * F.asin(F.sqrt(F.least(h, F.lit(1.0))))) * 3600


def draw_key(seed: str | int, *parts: Column) -> Column:
    """Pseudo-random order key: the same on every run and layout."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]), 256)


def hash_uniform(seed: str | int, *parts: Column) -> Column:
    """Number in [0, 1) from the first 48 bits of the draw key."""
    return F.conv(F.substring(draw_key(seed, *parts), 1, 12), 16, 10).cast("double") / float(1 << 48)


def fingerprint(*columns: Column) -> Column:
    """SHA-256 of the canonical JSON of columns, which are put in the order of their names by the caller."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def short_fingerprint(*columns: Column) -> Column:
    return F.substring(fingerprint(*columns), 1, 16)


def clean_quotes(quotes: Column, least: int = 20) -> Column:
    """Trimmed quotes of at least ``least`` characters, the first of equal ones kept in place."""
    return F.array_distinct(F.filter(F.transform(quotes, strip), lambda q: F.length(q) >= least))


def line_name(name: Column) -> Column:
    """Display name of an emission line, with (broad) for a closing _BROAD; unknown names stay."""
    base = F.regexp_replace(name, "_BROAD$", "")
    shown = F.try_element_at(F.create_map(*[F.lit(x) for kv in LINE_LABELS.items() for x in kv]), base)
    return F.concat(F.coalesce(shown, base), F.when(name.endswith("_BROAD"), " (broad)").otherwise(""))


#: Emission line names and how they are shown.
LINE_LABELS = {
    "LYALPHA": "Lyα",
    "NV_1240": "N V 1240",
    "OI_1304": "O I 1304",
    "SILIV_1396": "Si IV 1396",
    "CIV_1549": "C IV 1549",
    "HEII_1640": "He II 1640",
    "ALIII_1857": "Al III 1857",
    "SILIII_1892": "Si III 1892",
    "CIII_1908": "C III] 1908",
    "MGII_2796": "Mg II 2796",
    "MGII_2803": "Mg II 2803",
    "NEV_3346": "[Ne V] 3346",
    "NEV_3426": "[Ne V] 3426",
    "OII_3726": "[O II] 3726",
    "OII_3729": "[O II] 3729",
    "NEIII_3869": "[Ne III] 3869",
    "H6": "Hδ",
    "HEPSILON": "Hε",
    "HDELTA": "Hδ",
    "HGAMMA": "Hγ",
    "OIII_4363": "[O III] 4363",
    "HEI_4471": "He I 4471",
    "HEII_4686": "He II 4686",
    "HBETA": "Hβ",
    "OIII_4959": "[O III] 4959",
    "OIII_5007": "[O III] 5007",
    "NII_5755": "[N II] 5755",
    "HEI_5876": "He I 5876",
    "OI_6300": "[O I] 6300",
    "SIII_6312": "[S III] 6312",
    "NII_6548": "[N II] 6548",
    "HALPHA": "Hα",
    "NII_6584": "[N II] 6584",
    "SII_6716": "[S II] 6716",
    "SII_6731": "[S II] 6731",
    "ARIII_7135": "[Ar III] 7135",
    "OII_7320": "[O II] 7320",
    "OII_7330": "[O II] 7330",
    "SIII_9069": "[S III] 9069",
    "SIII_9532": "[S III] 9532",
}
