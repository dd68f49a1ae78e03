"""Candidate variants of paired and single samples, with genotypes and VCF rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions import likelihood
from strandlake.operators.pileup import BASES

PLACE = ["ref_id", "pos"]


def paired(piles: DataFrame) -> DataFrame:
    """Tumour and normal counts of places that both have: columns t_* and n_*.

    piles has one row for each sample and place, so that each maximum is over one value:
    both samples come from one pass over the reads, without a join. A pileup is dealt by
    ref_id and p, so that its pairs are made where it is.
    """
    kept = [c for c in piles.columns if c not in ("sample", "p", *PLACE)]
    side = lambda s: [F.max(F.when(F.col("sample") == s, F.col(c))).alias(f"{s}_{c}") for c in kept]
    both = piles.groupBy("ref_id", "p").agg(*side("t"), *side("n")).filter("t_n_all is not null and n_n_all is not null")
    return both.withColumn("pos", F.col("p") + 1).drop("p")


def single(piles: DataFrame, sample: str = "t") -> DataFrame:
    """One sample's counts as columns t_*."""
    return piles.filter(F.col("sample") == sample).select(*PLACE, *[F.col(c).alias(f"t_{c}") for c in piles.columns if c not in ("sample", "p", *PLACE)])


def at_index(prefix: str, kind: str, index: Column) -> Column:
    """A count of the base with an index from 0 to 3; null for others."""
    return F.get(F.array(*[F.col(f"{prefix}{kind}_{b}") for b in BASES]), index.cast("int"))


def other_counts(ref: Column, prefix: str = "t_") -> Column:
    """The largest count of a base that is not the reference's."""
    return F.greatest(*[F.when(ref == i, -1).otherwise(F.col(f"{prefix}n_{b}")) for i, b in enumerate(BASES)])


def is_candidate(ref: Column, variant_reads: int = 2, normal_percent: int | None = 25) -> Column:
    """Enough tumour reads with one other base, and few enough of any other base in the normal sample."""
    keep = (ref < 4) & (other_counts(ref) >= variant_reads)
    if normal_percent is None:
        return keep
    other = (F.col("n_n_all") - at_index("n_", "n", ref)) / F.col("n_n_all")
    return keep & ~(other > normal_percent / 100)


def alternative(ref: Column, prefix: str = "t_") -> Column:
    """The second allele where the first is the reference's, else the first."""
    return F.when(F.col(f"{prefix}major") == ref, F.col(f"{prefix}minor")).otherwise(F.col(f"{prefix}major"))


def with_shares(named: DataFrame, samples: dict[str, str]) -> DataFrame:
    """named (with alt) with the normalised genotype likelihoods of each sample, as _{prefix}shares.

    Each step is a column of its own, so that later ones do not compute it again.
    """
    pair = lambda p: (at_index(p, "n", F.col("alt")), F.col(f"{p}n_all"))
    out = named.withColumns({f"_{p}choose": likelihood.log_choose(*pair(p)) for p in samples})
    out = out.withColumns({f"_{p}each": likelihood.genotype_likelihoods(*pair(p), kind, F.col(f"_{p}choose")) for p, kind in samples.items()})
    return out.withColumns({f"_{p}shares": likelihood.genotype_shares(F.col(f"_{p}each")) for p in samples})


def sample_fields(prefix: str) -> list[Column]:
    """RC, AC, NI, ND, DP, GT, PL of one sample, from ref, alt and its shares."""
    shares = F.col(f"_{prefix}shares")
    pl = F.array_join(F.transform(shares, lambda s: likelihood.phred_likelihood(s).cast("string")), ",")
    values = [at_index(prefix, "n", F.col("ref")), at_index(prefix, "n", F.col("alt")), F.col(f"{prefix}ins"), F.col(f"{prefix}dels"), F.col(f"{prefix}n_all")]
    return [v.alias(f"{prefix}{n}") for v, n in zip([*values, likelihood.genotype(shares), pl], ("rc", "ac", "ni", "nd", "dp", "gt", "pl"))]


def calls(candidates: DataFrame, samples: dict[str, str]) -> DataFrame:
    """candidates (with ref, and trinucleotide) with alt, indel share and each sample's fields; samples: prefix to kind."""
    named = with_shares(candidates.withColumn("alt", alternative(F.col("ref"))), samples)
    share = (sum((F.col(f"t_indel_{b}") for b in BASES[1:]), F.col("t_indel_A")) / F.col("t_n_all")).alias("indel_share")
    fields = [f for prefix in samples for f in sample_fields(prefix)]
    more = [c for c in ("trinucleotide", "probability") if c in candidates.columns]
    return named.select(*PLACE, "ref", "alt", share, *more, *fields)


def filter_flag(threshold: float = 0.5, indel_threshold: float = 0.05) -> Column:
    return F.when(F.col("indel_share") > indel_threshold, "INDL").when(F.col("probability") >= threshold, "PASS").otherwise("FAIL")


def two_digits(x: Column) -> Column:
    return F.format_string("%.2f", F.bround(x, 2))


def vcf_rows(called: DataFrame, names: list[str], prefixes: list[str], threshold: float = 0.5, all_rows: bool = False) -> DataFrame:
    """ref_id, pos and the line of each call at or above the threshold."""
    kept = called if all_rows else called.filter(F.col("probability") >= threshold)
    base = lambda c: F.get(F.array(*[F.lit(b) for b in BASES]), F.col(c).cast("int"))
    sample = lambda p: F.concat_ws(":", *[F.col(f"{p}{n}").cast("string") for n in ("rc", "ac", "ni", "nd", "dp", "gt", "pl")])
    info = F.concat(F.lit("PR="), two_digits(F.col("probability")), F.lit(";TC="), F.col("trinucleotide"))
    line = F.concat_ws(
        "\t", F.get(F.array(*[F.lit(n) for n in names]), F.col("ref_id")), F.col("pos").cast("string"), F.lit("."), base("ref"), base("alt"),
        two_digits(likelihood.phred_quality(F.col("probability"))), filter_flag(threshold), info, F.lit("RC:AC:NI:ND:DP:GT:PL"), *[sample(p) for p in prefixes],
    )
    return kept.select(*PLACE, line.alias("line"))


def normal_variants(pairs: DataFrame) -> DataFrame:
    """Places (with ref) with enough reads of another base in the normal sample, and what genotypes need of both samples.

    They are few. Genotypes are long expressions, which a filter on them repeats: write these places before, so that they are not computed over the pileup.
    """
    kept = [f"{p}{c}" for p in ("t_", "n_") for c in (*[f"n_{b}" for b in BASES], "n_all", "ins", "dels", "major", "minor")]
    return pairs.filter((F.col("ref") < 4) & (other_counts(F.col("ref"), "n_") >= 2)).select(*PLACE, "ref", *kept)


def heterozygous(pairs: DataFrame) -> DataFrame:
    """Places at which the normal sample is 0/1, with both samples' counts of the normal's alleles.

    pairs has ref; candidates are chosen on the normal sample alone.
    """
    chosen = normal_variants(pairs)
    named = with_shares(chosen.withColumn("alt", alternative(F.col("ref"), "n_")), {"n_": "n", "t_": "t"})
    return named.select(*PLACE, "ref", "alt", *sample_fields("n_"), *sample_fields("t_")).filter("n_gt = '0/1'")
