"""Check digits as column expressions; they stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def luhn_valid(digits: Column) -> Column:
    """Whether a string of digits passes the mod-10 check; the empty string does, null gives null."""
    return F.when(digits == "", F.lit(True)).otherwise(F.call_function("luhn_check", digits))


def nir_valid(nir: Column) -> Column:
    """A social security number of 15 characters, upper case, without separators.

    Month 01-12, department 01-99 or 2A or 2B, order from 001, key 97 - body mod 97 with 19 for 2A and 18 for 2B.
    """
    dept = F.substring(nir, 6, 2)
    body = F.concat(F.substring(nir, 1, 5), F.when(dept == "2A", "19").when(dept == "2B", "18").otherwise(dept), F.substring(nir, 8, 6))
    month, order = F.substring(nir, 4, 2).try_cast("int"), F.substring(nir, 11, 3).try_cast("int")
    ok = (F.length(nir) == 15) & month.between(1, 12) & (dept.isin("2A", "2B") | (dept.try_cast("int") >= 1)) & (order >= 1)
    return F.coalesce(ok & (F.substring(nir, 14, 2).try_cast("int") == 97 - body.try_cast("bigint") % 97), F.lit(False))


def iban_fr_valid(iban: Column) -> Column:
    """A French IBAN of 27 characters, upper case, without separators: the number it spells is 1 modulo 97."""
    turned = F.concat(F.substring(iban, 5, 23), F.substring(iban, 1, 4))
    spelt = F.transform(F.split(turned, ""), lambda c: F.when(c.rlike("^[A-Z]$"), F.ascii(c) - 55).when(c.rlike("^[0-9]$"), c.try_cast("int")))
    rest = F.aggregate(F.filter(spelt, lambda v: v.isNotNull()), F.lit(0), lambda m, v: (m * F.when(v > 9, 100).otherwise(10) + v) % 97)
    return (F.length(iban) == 27) & iban.rlike("^[0-9A-Z]{27}$") & (rest == 1)
