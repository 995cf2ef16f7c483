"""Long genotype tables (contig, pos, sample_id, gt): per-variant statistics, quality filter, pivot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociforge.functions.genotype import CONTIG_PATTERN, is_snp, variant_id

VARIANT = ("contig", "pos")


def variant_stats(entries: DataFrame, gt: str = "gt", copies: int = 2, key: tuple[str, ...] = VARIANT) -> DataFrame:
    """Alternate-allele frequency, population deviation and missingness of each variant, over all samples.

    copies is what a full alternate genotype counts: 2 for zygosity, 1 for binarised calls. Missing calls are left out of
    the means. One shuffle on the variant, partial sums before it.
    """
    g = F.col(gt)
    return entries.groupBy(*key).agg(
        (F.avg(g) / copies).alias("maf"), F.stddev_pop(g).alias("stdev"), F.bool_or(g.isNull()).alias("has_missing"), F.count("*").alias("n_samples")
    )


def qc_condition(min_maf: float = 0.005, max_maf: float = 1.0, contigs: str = CONTIG_PATTERN, allow_missing: bool = False, alleles: str | None = None) -> Column:
    """One conjunction over the columns of variant_stats: variable, on a wanted contig, frequent enough, complete, and,
    where alleles names a column of them, of single bases.
    """
    maf = F.col("maf")
    keep = (maf > 0) & (maf < 1) & F.col("contig").rlike(contigs) & maf.between(min_maf, max_maf)
    if alleles:
        keep = keep & is_snp(F.col(alleles))
    return keep if allow_missing else keep & ~F.col("has_missing")


def qc_variants(entries: DataFrame, gt: str = "gt", copies: int = 2, **limits) -> DataFrame:
    """Variants that pass the quality filter, with their statistics."""
    return variant_stats(entries, gt, copies).where(qc_condition(**limits)).withColumn("variant_id", variant_id(F.col("contig"), F.col("pos")))


def pivot_genotypes(long: DataFrame, variants: list[str], sample: str = "sample_id", variant: str = "variant_id", gt: str = "gt") -> DataFrame:
    """One row for each sample, one column for each listed variant; the largest call where a variant has several.

    The list is given, so no job runs to find it. For lists beyond some ten thousand use genotype_vectors.
    """
    return long.groupBy(sample).pivot(variant, variants).agg(F.max(gt))


def genotype_vectors(long: DataFrame, positions: DataFrame, sample: str = "sample_id", variant: str = "variant_id", gt: str = "gt") -> DataFrame:
    """Sparse rows: for each sample the positions and calls that differ from 0, positions from (variant, position)."""
    called = long.where(F.col(gt) != 0).groupBy(sample, variant).agg(F.max(gt).alias("v")).join(positions, variant)
    entry = F.array_sort(F.collect_list(F.struct(F.col("position").alias("i"), F.col("v"))))
    return called.groupBy(sample).agg(entry.alias("e")).select(sample, F.transform("e", lambda x: x["i"]).alias("positions"), F.transform("e", lambda x: x["v"]).alias("calls"))
