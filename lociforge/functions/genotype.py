"""Genotype calls ("0/1", "1|2", "./.") as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Contigs that take part in an analysis (a fixed value of the study design).
CONTIG_PATTERN = r"^(chr)?([1-9]|1[0-9]|2[0-2]|X|Y|M|.*_alt|.*_PAR)$"


def alleles_of(gt: Column) -> Column:
    """Allele numbers of a call; null if the call is missing in part or whole."""
    called = F.transform(F.split(gt, r"[/|]"), lambda a: a.try_cast("int"))
    return F.when(F.forall(called, lambda a: a.isNotNull()), called)


def n_alt(gt: Column) -> Column:
    """How many alleles differ from the reference."""
    return F.size(F.filter(alleles_of(gt), lambda a: a > 0))


def is_hom_ref(gt: Column) -> Column:
    return F.forall(alleles_of(gt), lambda a: a == 0)


def is_non_ref(gt: Column) -> Column:
    return F.exists(alleles_of(gt), lambda a: a > 0)


def is_het(gt: Column) -> Column:
    return F.size(F.array_distinct(alleles_of(gt))) > 1


def is_hom_var(gt: Column) -> Column:
    return is_non_ref(gt) & ~is_het(gt)


def zygosity(gt: Column) -> Column:
    """0 for two reference alleles, 1 for unequal ones, 2 for equal others, null if missing."""
    return F.when(is_hom_ref(gt), 0).when(is_het(gt), 1).when(is_hom_var(gt), 2)


def binarised(gt: Column) -> Column:
    """1 if any allele differs from the reference, else 0; null if missing."""
    return F.when(is_non_ref(gt), 1).when(is_hom_ref(gt), 0)


CODINGS = {"zygosity": zygosity, "binary": binarised, "n_alt": n_alt}


def variant_id(contig: Column, position: Column) -> Column:
    return F.concat_ws(":", contig, position.cast("string"))


def parse_variant_id(name: Column) -> tuple[Column, Column]:
    """Contig without 'chr' and position; nulls for what cannot be read."""
    parts = F.split(name, ":")
    return F.regexp_replace(F.get(parts, F.lit(0)), "^chr", ""), F.get(parts, F.lit(1)).try_cast("int")


def is_snp(alleles: Column) -> Column:
    """Every allele is one character long."""
    return F.forall(alleles, lambda a: F.length(a) == 1)
