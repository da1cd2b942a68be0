"""Plates and vehicle identification numbers."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.ranking import first_true

# The public VIN transliteration, position weights and model-year alphabet.
VIN_LETTERS = "ABCDEFGHJKLMNPRSTUVWXYZ"
VIN_LETTER_VALUES = "12345678123457923456789"
VIN_WEIGHTS = [8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2]
VIN_YEAR_CODES = "ABCDEFGHJKLMNPRSTVWXY123456789"
TR_PLATE = r"^\d{2}(?:[A-Z]\d{4}|[A-Z]{2}\d{3,4}|[A-Z]{3}\d{2,3})$"


def normal_plate(value: Column) -> Column:
    """Upper case without blanks and dashes; look-alike characters are never guessed."""
    return F.regexp_replace(F.upper(value), r"[\s-]", "")


def plausible_plate(plate: Column, country: Column) -> Column:
    shape = plate.rlike("^[A-Z0-9]{2,12}$")
    turkish = plate.rlike(TR_PLATE) & F.substring(plate, 1, 2).try_cast("int").between(1, 81)
    return F.coalesce(shape & ((country != "TR") | turkish), F.lit(False))


def normal_vin(text: Column) -> Column:
    return F.translate(F.upper(F.trim(text)), "IOQ", "100")


def vin_check_ok(vin: Column) -> Column:
    """Position nine equals the weighted sum modulo eleven (ten is written X)."""
    value = normal_vin(vin)
    well_formed = value.rlike("^[0-9A-HJ-NPR-Z]{17}$")
    digits = F.split(F.translate(F.when(well_formed, value).otherwise("0" * 17), VIN_LETTERS, VIN_LETTER_VALUES), "")
    weights = F.array(*[F.lit(w) for w in VIN_WEIGHTS])
    total = F.aggregate(F.zip_with(F.slice(digits, 1, 17), weights, lambda d, w: d.cast("int") * w),
                        F.lit(0), lambda acc, x: acc + x)
    remainder = total % 11
    expected = F.when(remainder == 10, "X").otherwise(remainder.cast("string"))
    return F.coalesce(well_formed & (F.substring(value, 9, 1) == expected), F.lit(False))


def north_american(vin: Column) -> Column:
    return F.substring(normal_vin(vin), 1, 1).isin(*"12345")


def vin_model_year(vin: Column) -> Column:
    """Model year; only North American numbers encode one."""
    value = normal_vin(vin)
    offset = F.instr(F.lit(VIN_YEAR_CODES), F.substring(value, 10, 1)) - 1
    seventh = F.substring(value, 7, 1)
    known = (F.length(value) == 17) & (offset >= 0) & north_american(vin)
    return F.when(known & seventh.rlike("[A-Z]"), offset + 2010).when(
        known & seventh.rlike("[0-9]"), offset + 1980)


def vin_year_problem(decoded: Column, declared: Column) -> Column:
    return first_true([(decoded.isNull() | declared.isNull(), "no_opinion"),
                       (F.abs(decoded - declared) > 1, "conflict")]).otherwise("agrees")
