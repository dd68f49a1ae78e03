"""Queries of the variant caller: candidates, genotypes, features, regions, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions import likelihood, sequence
from strandlake.operators import caller, features, pileup
from strandlake.plans import derived
from strandlake.plans.derived import READS_SQL
from strandlake.plans.queries import NAMES, PILEUP_SQL, rounded
from strandlake.sources.staging import staged

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def with_reference(places: DataFrame) -> DataFrame:
    """places with ref, the index of the reference's base."""
    return places.withColumn("ref", derived.reference_base(F.col("ref_id").cast("long"), (F.col("pos") - 1).cast("long")).cast("int"))


def piles(spark: SparkSession, folder: str) -> DataFrame:
    return pileup.pileup(derived.alignments(spark, folder))


def pairs(spark: SparkSession, folder: str) -> DataFrame:
    return with_reference(caller.paired(piles(spark, folder)))


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    return pairs(spark, folder).filter(caller.is_candidate(F.col("ref")))


COUNTS = [f"n_{b}" for b in "ACGT"]
PAIRS_SQL = f"""{PILEUP_SQL},
pairs AS (
    SELECT t.ref_id, t.pos, ((t.p * 1103515245::BIGINT + t.ref_id * 12345 + 7) % 2147483648) // 65536 % 4 AS ref, t, n
    FROM pile t JOIN pile n ON t.ref_id = n.ref_id AND t.pos = n.pos AND t.sample = 't' AND n.sample = 'n'
),
cand AS (
    SELECT *, CASE WHEN t.major = ref THEN t.minor ELSE t.major END AS alt,
        (SELECT coalesce(max_by(i, t.ns[i + 1] * 10 - i), [1, 2, 0, 0][ref + 1]) FROM (SELECT unnest(range(4)) AS i) WHERE i <> ref AND t.ns[i + 1] > 0) AS other
    FROM pairs WHERE list_max(list_transform(t.ns, lambda x, i: CASE WHEN i - 1 = ref THEN -1 ELSE x END)) >= 2
        AND NOT (n.n_all - n.ns[ref + 1]) / n.n_all > 0.25
)"""


#: The few columns of both samples that some queries need, paired in one aggregation.
SLIM_SQL = f"""{PILEUP_SQL},
slim AS (
    SELECT ref_id, pos, any_value(p) AS p, max(n_all) FILTER (sample = 't') AS t_all, max(n_all) FILTER (sample = 'n') AS n_all,
        any_value(ns) FILTER (sample = 't') AS t_ns, any_value(ns) FILTER (sample = 'n') AS n_ns, max(major) FILTER (sample = 'n') AS n_major, max(minor) FILTER (sample = 'n') AS n_minor
    FROM pile GROUP BY ref_id, pos HAVING count(DISTINCT sample) = 2
),
matched AS (SELECT *, ((p * 1103515245::BIGINT + ref_id * 12345 + 7) % 2147483648) // 65536 % 4 AS ref FROM slim)"""


@query("paired_places", f"WITH {READS_SQL}, {SLIM_SQL} SELECT ref_id, pos, ref::INT AS ref, t_all AS t_depth, n_all AS n_depth FROM matched")
def paired_places(spark: SparkSession, folder: str) -> DataFrame:
    return pairs(spark, folder).select("ref_id", "pos", "ref", F.col("t_n_all").alias("t_depth"), F.col("n_n_all").alias("n_depth"))


@query(
    "paired_candidates",
    f"WITH {READS_SQL}, {PAIRS_SQL} SELECT ref_id, pos, ref::INT AS ref, alt::INT AS alt, other::INT AS other, t.n_all AS t_depth, t.ns[alt + 1] AS t_alt, "
    "n.n_all AS n_depth, n.ns[alt + 1] AS n_alt FROM cand",
)
def paired_candidates(spark: SparkSession, folder: str) -> DataFrame:
    found = candidates(spark, folder).withColumns({"alt": caller.alternative(F.col("ref")), "other": features.other_index(F.col("ref"))})
    return found.select(
        "ref_id", "pos", "ref", F.col("alt").cast("int"), F.col("other").cast("int"), F.col("t_n_all").alias("t_depth"), caller.at_index("t_", "n", F.col("alt")).alias("t_alt"),
        F.col("n_n_all").alias("n_depth"), caller.at_index("n_", "n", F.col("alt")).alias("n_alt"),
    )


@query(
    "single_candidates",
    f"WITH {READS_SQL}, {PILEUP_SQL}, refd AS (SELECT *, ((p * 1103515245::BIGINT + ref_id * 12345 + 7) % 2147483648) // 65536 % 4 AS ref FROM pile WHERE sample = 't') "
    "SELECT ref_id, pos, ref::INT AS ref, n_all AS depth FROM refd WHERE list_max(list_transform(ns, lambda x, i: CASE WHEN i - 1 = ref THEN -1 ELSE x END)) >= 2",
)
def single_candidates(spark: SparkSession, folder: str) -> DataFrame:
    found = with_reference(caller.single(piles(spark, folder)))
    return found.filter(caller.is_candidate(F.col("ref"), normal_percent=None)).select("ref_id", "pos", "ref", F.col("t_n_all").alias("depth"))


def _pmf(k: str, n: str, p: float) -> str:
    return f"exp(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1) + {k} * ln({p}) + ({n} - {k}) * ln(1 - {p}))"


def _genotype_sql(s: str, kind: str, ns: str = "{s}.ns", depth: str = "{s}.n_all") -> str:
    ps = likelihood.PRIORS[kind]
    each = ", ".join(_pmf(f"{ns.format(s=s)}[alt + 1]", depth.format(s=s), p) for p in ps)
    return f"list_transform([{each}], lambda x: x) AS {s}_raw"


_GENOTYPES_SQL = f"""
raw AS (SELECT *, {_genotype_sql('t', 't')}, {_genotype_sql('n', 'n')} FROM cand),
shares AS (
    SELECT *, list_transform(t_raw, lambda x: round(x / CASE WHEN list_sum(t_raw) = 0 THEN 1e-150 ELSE list_sum(t_raw) END, 4)) AS t_s,
        list_transform(n_raw, lambda x: round(x / CASE WHEN list_sum(n_raw) = 0 THEN 1e-150 ELSE list_sum(n_raw) END, 4)) AS n_s
    FROM raw
)"""
_PL = "array_to_string(list_transform({s}_s, lambda x: CASE WHEN x = 0 THEN 255 WHEN x = 1 THEN 0 ELSE floor(-10 * log10(x))::INT END), ',')"
_GT = "['0/0', '0/1', '1/1'][list_position({s}_s, list_max({s}_s))]"


@query(
    "genotypes",
    f"WITH {READS_SQL}, {PAIRS_SQL}, {_GENOTYPES_SQL} SELECT ref_id, pos, alt::INT AS alt, round((t.indel_A + t.indel_C + t.indel_G + t.indel_T) / t.n_all, 6) AS indel_share, "
    f"{_GT.format(s='t')} AS t_gt, {_PL.format(s='t')} AS t_pl, {_GT.format(s='n')} AS n_gt, {_PL.format(s='n')} AS n_pl FROM shares",
)
def genotypes(spark: SparkSession, folder: str) -> DataFrame:
    called = caller.calls(candidates(spark, folder), {"t_": "t", "n_": "n"})
    return called.select("ref_id", "pos", F.col("alt").cast("int"), rounded("indel_share").alias("indel_share"), "t_gt", "t_pl", "n_gt", "n_pl")


@query(
    "heterozygous_calls",
    f"WITH {READS_SQL}, {SLIM_SQL}, het AS (SELECT *, CASE WHEN n_major = ref THEN n_minor ELSE n_major END AS alt FROM matched "
    "WHERE list_max(list_transform(n_ns, lambda x, i: CASE WHEN i - 1 = ref THEN -1 ELSE x END)) >= 2), "
    f"raw AS (SELECT *, {_genotype_sql('n', 'n', '{s}_ns', '{s}_all')} FROM het), "
    "shares AS (SELECT *, list_transform(n_raw, lambda x: round(x / CASE WHEN list_sum(n_raw) = 0 THEN 1e-150 ELSE list_sum(n_raw) END, 4)) AS n_s FROM raw) "
    f"SELECT ref_id, pos, alt::INT AS alt, n_ns[alt + 1] AS n_ac, t_ns[alt + 1] AS t_ac, t_ns[ref + 1] AS t_rc, {_PL.format(s='n')} AS n_pl FROM shares WHERE {_GT.format(s='n')} = '0/1'",
)
def heterozygous_calls(spark: SparkSession, folder: str) -> DataFrame:
    found = staged(caller.normal_variants(pairs(spark, folder)), "normal-variants")
    return caller.heterozygous(found).select("ref_id", "pos", F.col("alt").cast("int"), "n_ac", "t_ac", "t_rc", "n_pl")


# Reference ----------------------------------------------------------------------------------


def reference_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The derived reference in chunks, as far as reads reach."""
    parts = spark.read.parquet(f"{folder}/lineitem.parquet").agg(F.max("l_partkey").alias("k"))
    ends = parts.select(F.explode(F.sequence(F.lit(0), F.lit(derived.REFERENCES - 1))).alias("ref_id"), (F.col("k") * 7 + 600).alias("size"))
    chunks = ends.select("ref_id", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("size") / sequence.CHUNK))).alias("chunk"))
    first = F.greatest(F.col("chunk") * sequence.CHUNK - sequence.MARGIN, F.lit(0))
    last = F.least((F.col("chunk") + 1) * sequence.CHUNK + sequence.MARGIN, F.col("size")) - 1
    symbol = lambda p: F.substring(F.lit("ACGT"), derived.reference_base(F.col("ref_id").cast("long"), p).cast("int") + 1, 1)
    return chunks.select("ref_id", "chunk", F.array_join(F.transform(F.sequence(first, last), symbol), "").alias("bases"), first.alias("offset"), "size")


def with_context(places: DataFrame, chunks: DataFrame) -> DataFrame:
    """places (ref_id, 1-based pos) with hf, hb, gc, re and trinucleotide."""
    keyed = places.withColumn("chunk", F.floor((F.col("pos") - 1) / sequence.CHUNK))
    held = sequence.with_runs(chunks).select("ref_id", "chunk", "size", "runs", F.col("bases").alias("seq"), F.col("offset").alias("seq_at"))
    joined = keyed.join(held, ["ref_id", "chunk"]).withColumn("_w", sequence.window(F.col("pos"), F.col("size")))
    pos = F.col("pos")
    return joined.withColumns(
        {"hf": sequence.homopolymer_forward(pos), "hb": sequence.homopolymer_backward(pos), "gc": sequence.gc_content(F.col("_w")),
         "re": sequence.sequence_entropy(F.col("_w")), "trinucleotide": sequence.trinucleotide(pos)}
    ).drop("_w", "seq", "seq_at", "size", "chunk", "runs")


def _rb(p: str, ref: str = "ref_id") -> str:
    return f"((({p}) * 1103515245::BIGINT + {ref} * 12345 + 7) % 2147483648) // 65536 % 4"


CONTEXT_SQL = f"""
sizes AS (SELECT max(l_partkey) * 7 + 600 AS size FROM lineitem),
windows AS (
    SELECT c.*, CASE WHEN pos - 251 < 0 THEN 0 WHEN pos + 249 > size THEN size - 500 ELSE pos - 251 END AS w0 FROM cand c, sizes
),
wbase AS (SELECT ref_id, pos, {_rb('w0 + i')} AS b FROM (SELECT ref_id, pos, w0, unnest(range(500)) AS i FROM windows)),
wcount AS (SELECT ref_id, pos, count(*) FILTER (b IN (1, 2)) / 500 AS gc, [count(*) FILTER (b = 0), count(*) FILTER (b = 1), count(*) FILTER (b = 2), count(*) FILTER (b = 3)] AS bs FROM wbase GROUP BY ref_id, pos),
runs AS (
    SELECT ref_id, pos, list_position(list_append(list_transform(range(60), lambda i: {_rb('pos + i')} <> {_rb('pos + i + 1')}), true), true) - 1 AS hf,
        list_position(list_append(list_transform(range(60), lambda i: pos - 2 - i <= 2 OR {_rb('pos - 2 - i')} <> {_rb('pos - 3 - i')}), true), true) - 1 AS hb,
        concat(substr('ACGT', ({_rb('pos - 2')})::INT + 1, 1), substr('ACGT', ({_rb('pos - 1')})::INT + 1, 1), substr('ACGT', ({_rb('pos')})::INT + 1, 1)) AS tri
    FROM cand
),
context AS (
    SELECT w.ref_id, w.pos, gc, -list_sum(list_transform(bs, lambda c: CASE WHEN c = 0 THEN 0 ELSE c / 500 * ln(c / 500) / ln(4) END)) AS re, hf, hb, CASE WHEN w.pos = 1 THEN 'N' || substr(tri, 2) ELSE tri END AS trinucleotide
    FROM wcount w JOIN runs r ON w.ref_id = r.ref_id AND w.pos = r.pos
)"""


@query(
    "reference_context",
    f"WITH {READS_SQL}, {PAIRS_SQL}, {CONTEXT_SQL} SELECT ref_id, pos, round(gc, 6) AS gc, round(re, 6) AS re, hf::INT AS hf, CASE WHEN pos < 3 THEN 0 ELSE hb END::INT AS hb, trinucleotide FROM context",
)
def reference_context(spark: SparkSession, folder: str) -> DataFrame:
    found = with_context(candidates(spark, folder).select("ref_id", "pos"), reference_chunks(spark, folder))
    return found.select("ref_id", "pos", rounded("gc").alias("gc"), rounded("re").alias("re"), "hf", "hb", "trinucleotide")


# Features -----------------------------------------------------------------------------------


def featured_of(found: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """Paired candidates with what their features need."""
    named = found.withColumn("other", features.other_index(F.col("ref")).cast("int"))
    return with_context(features.prepared(named, {"t_": "t", "n_": "n"}), reference_chunks(spark, folder))


def featured(spark: SparkSession, folder: str) -> DataFrame:
    return featured_of(candidates(spark, folder), spark, folder)


def _features_frame(df: DataFrame, columns: dict) -> DataFrame:
    return df.select("ref_id", "pos", *[rounded(c).alias(name) for name, c in columns.items()])


EP = "1e-5"


def _samples_sql(samples: str) -> str:
    """Columns tD, tDb, tDa, ... of the samples."""
    kinds = {"D": "n", "Q": "bq", "M": "mq", "X": "dist", "R": "rev"}
    out = []
    for s in samples:
        for name, kind in kinds.items():
            of = f"[{', '.join(f'{s}.{kind}_{b}' for b in 'ACGT')}]"
            out += [f"{s}.{kind}_all AS {s}{name}", f"{of}[ref + 1] AS {s}{name}b", f"{of}[other + 1] AS {s}{name}a"]
        out += [f"{s}.entropy AS {s}H", f"{s}.ins AS {s}I", f"{s}.dels AS {s}L", f"{s}.indel_A + {s}.indel_C + {s}.indel_G + {s}.indel_T AS {s}indel"]
        out += [f"[{', '.join(f'{s}.bq_{b}' for b in 'ACGT')}] AS {s}bq"]
        out += [f"[{', '.join(_pmf(f'{s}.ns[other + 1]', f'{s}.n_all', p) for p in likelihood.PRIORS[s])}] AS {s}pmf"]
    return ", ".join(out)


def _facts_sql(samples: str) -> str:
    return f"""
facts AS (
    SELECT c.ref_id, c.pos, c.ref, c.other, x.gc, x.re, x.hf, CASE WHEN c.pos < 3 THEN 0 ELSE x.hb END AS hb, {_samples_sql(samples)}
    FROM cand c JOIN context x ON c.ref_id = x.ref_id AND c.pos = x.pos
)"""


#: Places and candidates of the tumour sample alone, whatever the normal one has.
SINGLES_SQL = f"""{PILEUP_SQL},
pairs AS (SELECT t.ref_id, t.pos, ((t.p * 1103515245::BIGINT + t.ref_id * 12345 + 7) % 2147483648) // 65536 % 4 AS ref, t FROM pile t WHERE t.sample = 't'),
cand AS (
    SELECT *, (SELECT coalesce(max_by(i, t.ns[i + 1] * 10 - i), [1, 2, 0, 0][ref + 1]) FROM (SELECT unnest(range(4)) AS i) WHERE i <> ref AND t.ns[i + 1] > 0) AS other
    FROM pairs WHERE list_max(list_transform(t.ns, lambda x, i: CASE WHEN i - 1 = ref THEN -1 ELSE x END)) >= 2
)"""
_RATIOS = {f"ratio_{k}": f"((n{k}a / (nDa + {EP})) / nD) / ((t{k}a / (tDa + {EP})) / tD + {EP})" for k in "RMQX"}
_CROSS = (
    "CASE WHEN tQ = 0 OR nQ = 0 THEN 0 ELSE list_sum(list_transform([1, 2, 3, 4], lambda i: CASE WHEN tbq[i] = 0 THEN 0 WHEN nbq[i] = 0 THEN 7 * tbq[i] / tQ "
    "ELSE -ln(nbq[i] / nQ) * tbq[i] / tQ END)) END"
)


def _strand_sql() -> str:
    counts = ["nDb - nRb", "nRb", "nDa - nRa", "nRa", "tDb - tRb", "tRb", "tDa - tRa", "tRa"]
    logs = ", ".join(" + ".join(f"({c}) * ln({p / sum(row)!r})" for c, p in zip(counts, row)) for row in features.STRAND_CLASSES)
    return f"[{logs}]"


_STRAND = (
    f"list_sum(list_transform(({_strand_sql()})[1:3], lambda x: exp(x - list_max({_strand_sql()})))) / list_sum(list_transform({_strand_sql()}, lambda x: exp(x - list_max({_strand_sql()}))))"
)


def _features_sql(columns: dict[str, str]) -> str:
    return ", ".join(f"round(coalesce(({c})::DOUBLE, 0), 6) AS {name}" for name, c in columns.items())


_SINGLE = {
    "insertions": "tI / tD", "entropy": "tH", "mapq": "tM / tD", "baseq": "tQ / tD", "distance": "tX / tD", "reverse": "tR / tD", "ref_share": "tDb / tD",
    "ref_baseq": f"tQb / (tDb + {EP})", "ref_mapq": f"tMb / (tDb + {EP})", "ref_reverse": "tRb / tD", "ref_reverse_share": f"tRb / (tDb + {EP})",
    "region_entropy": "re", "gc": "gc", "forward_run": "hf", "backward_run": "hb", "other_baseq": f"(tQ - tQb) / (tD - tDb + {EP})",
    "other_reverse": f"(tR - tRb) / (tD - tDb + {EP})", "other_distance": f"(tX - tXb) / (tD - tDb + {EP})", "other_share": "(tD - tDb) / tD",
    "other_mapq": f"(tM - tMb) / (tD - tDb + {EP})", "hom": f"tpmf[1] / (list_sum(tpmf) + {EP})", "het": f"tpmf[2] / (list_sum(tpmf) + {EP})",
    "hom_alt": f"tpmf[3] / (list_sum(tpmf) + {EP})", "depth": "tD / 30.0", "purity": "0.7", "whole_genome": "0",
}
_PAIRED = {
    "backward_run": "hb", "forward_run": "hf", "normal_depth": "nD", "normal_distance": "nX / nD", "normal_entropy": "nH", "normal_mapq": "nM / nD", "normal_baseq": "nQ / nD",
    "normal_ref_baseq": f"nQb / (nDb + {EP})", "depth_ratio": "tD / nD", "reverse_ratio": f"(tR / tD) / (nR / nD + {EP})", "entropy_ratio": "nH / (tH + 1e-8)",
    "mapq_ratio": f"(tM / tD) / (nM / nD + {EP})", "ref_share_ratio": f"(tDb / tD + {EP}) / (nDb / nD + {EP})",
    "ref_reverse_ratio": f"(tRb / (tDb + {EP})) / (nRb / (nDb + {EP}) + {EP})", "normal_variant_distance": f"nXa / (nDa + {EP})", "normal_variant_mapq": f"nMa / (nDa + {EP})",
    "normal_variant_baseq": f"nQa / (nDa + {EP})", "tumour_depth": "tD", "tumour_distance": "tX / tD", "tumour_mapq": "tM / tD", "tumour_baseq": "tQ / tD",
    "tumour_ref_baseq": f"tQb / (tDb + {EP})", "tumour_variant_distance": f"tXa / (tDa + {EP})", "tumour_variant_mapq": f"tMa / (tDa + {EP})",
    "tumour_variant_baseq": f"tQa / (tDa + {EP})", "normal_variant_mapq_depth": f"nMa / (nDa + {EP}) / (nD + {EP})", "tumour_variant_mapq_depth": f"tMa / (tDa + {EP}) / (tD + {EP})",
    "tumour_variant_baseq_depth": f"tQa / (tDa + {EP}) / (tD + {EP})", **_RATIOS, "normal_distance_sum": "nX", "normal_variant_reverse": "nRa",
    "normal_variant_distance_sum": "nXa", "normal_variant_mapq_sum": "nMa", "normal_variant_baseq_sum": "nQa", "tumour_distance_sum": "tX", "tumour_variant_reverse": "tRa",
    "tumour_variant_distance_sum": "tXa", "tumour_variant_mapq_sum": "tMa", "tumour_variant_baseq_sum": "tQa", "strand_posterior": _STRAND, "cross_entropy": _CROSS,
}


def _deep_side(s: str) -> dict[str, str]:
    return {
        f"{s}_reverse": f"{s}R / {s}D", f"{s}_distance": f"{s}X / {s}D", f"{s}_entropy": f"{s}H", f"{s}_indels": f"({s}I + {s}L) / {s}D", f"{s}_mapq": f"{s}M / {s}D",
        f"{s}_baseq": f"{s}Q / {s}D", f"{s}_ref_share": f"{s}Db / ({s}Db + {EP})", f"{s}_ref_reverse_share": f"{s}Rb / ({s}Db + {EP})", f"{s}_ref_reverse": f"{s}Rb / {s}D",
        f"{s}_ref_baseq": f"{s}Qb / ({s}Db + {EP})", f"{s}_alt_share": f"{s}Da / {s}D", f"{s}_other_share": f"({s}D - {s}Db) / {s}D", f"{s}_alt_reverse": f"{s}Ra / ({s}Da + {EP})",
        f"{s}_alt_distance": f"{s}Xa / ({s}Da + {EP})", f"{s}_alt_mapq": f"{s}Ma / ({s}Da + {EP})", f"{s}_other_baseq": f"({s}Q - {s}Qb) / ({s}D - {s}Db + {EP})",
        **{f"{s}_alt_{k}_depth": f"{s}{k}a / ({s}Da + {EP}) / ({s}D + {EP})" for k in "RMQX"}, f"{s}_indel_reads": f"{s}indel / {s}D",
        f"{s}_background": f"{s}_bg", f"{s}_background_p": f"{s}_bg_p",
    }


_JOINT = "(" + " + ".join(f"tpmf[{i + 1}] * npmf[{j + 1}] * {features.JOINT_PRIOR[i][j]}" for i in range(3) for j in range(3)) + f" + {EP})"


def _joint(*at: tuple[int, int]) -> str:
    return "(" + " + ".join(f"tpmf[{i + 1}] * npmf[{j + 1}] * {features.JOINT_PRIOR[i][j]}" for i, j in at) + f") / {_JOINT}"


_DEEP = {
    "backward_run": "hb", "forward_run": "hf", **_deep_side("n"), **_deep_side("t"), "depth_ratio": "tD / nD", "reverse_ratio": f"(tR / tD) / (nR / nD + {EP})",
    "entropy_ratio": f"nH / (tH + {EP})", "mapq_ratio": f"(tM / tD) / (nM / nD + {EP})", "baseq_ratio": f"(tQ / tD) / (nQ / nD + {EP})",
    "ref_share_ratio": f"(tDb / tD + {EP}) / (nDb / nD + {EP})", "ref_reverse_ratio": f"(tRb / (tDb + {EP})) / (nRb / (nDb + {EP}) + {EP})", "region_entropy": "re", "gc": "gc",
    **_RATIOS, "somatic": _joint((1, 0), (2, 0)), "germline": _joint((1, 1), (2, 2)), "wildtype": _joint((0, 0)), "loh": _joint((0, 1), (2, 1)), "error": _joint((0, 2), (1, 2)),
    "purity": "0.7", "whole_genome": "0", "cross_entropy": _CROSS,
}


def _background_sql(s: str) -> str:
    tail = _pmf("i", f"greatest({s}Da, {s}_depth)", 0.5).replace("ln(0.5)", f"ln({s}_bg)").replace("ln(1 - 0.5)", f"ln(1 - {s}_bg)")
    return (
        f"CASE WHEN {s}_bg IS NULL THEN NULL WHEN {s}Da <= 0 THEN 1 WHEN {s}_bg <= 0 THEN 0 WHEN {s}_bg >= 1 THEN 1 "
        f"ELSE least(1, list_sum(list_transform(range({s}Da, greatest({s}Da, {s}_depth) + 1), lambda i: {tail}))) END AS {s}_bg_p"
    )


def _regions_sql(samples: str) -> str:
    """The background of each place, from all places of its region, and facts with it."""
    most = ", ".join(f"list_max(list_transform({s}.ns, lambda x, i: CASE WHEN i - 1 = ref THEN 0 ELSE x END)) AS {s}_o, {s}.ns[ref + 1] AS {s}_r" for s in samples)
    own = ", ".join(f"{s}_o + {s}_r AS {s}_depth, coalesce({s}_o / nullif({s}_o + {s}_r, 0), 0) AS {s}_own" for s in samples)
    mean = ", ".join(f"{s}_depth, CASE WHEN count(*) OVER r > 1 THEN greatest(0, least(1, (sum({s}_own) OVER r - {s}_own) / (count(*) OVER r - 1))) END AS {s}_bg" for s in samples)
    return f"""
owns AS (SELECT ref_id, pos, {most} FROM pairs),
shared AS (SELECT ref_id, pos, {own} FROM owns),
bg AS (SELECT ref_id, pos, {mean} FROM shared WINDOW r AS (PARTITION BY ref_id, pos // 1000)),
deep AS (SELECT *, {', '.join(_background_sql(s) for s in samples)} FROM facts JOIN bg USING (ref_id, pos))"""


_FACTS = f"WITH {READS_SQL}, {PAIRS_SQL}, {CONTEXT_SQL}, {_facts_sql('tn')}"
_SINGLE_FACTS = f"WITH {READS_SQL}, {SINGLES_SQL}, {CONTEXT_SQL}, {_facts_sql('t')}"


@query("paired_features", f"{_FACTS} SELECT ref_id, pos, {_features_sql(_PAIRED)} FROM facts")
def paired_features(spark: SparkSession, folder: str) -> DataFrame:
    return _features_frame(featured(spark, folder), features.paired_features())


def singles(spark: SparkSession, folder: str) -> DataFrame:
    """All places of the tumour sample with its reference's base."""
    return with_reference(caller.single(piles(spark, folder)))


def single_featured(spark: SparkSession, folder: str, places: DataFrame) -> DataFrame:
    """What the features of one sample need, of places' candidates; no normal sample is asked."""
    found = places.filter(caller.is_candidate(F.col("ref"), normal_percent=None)).withColumn("other", features.other_index(F.col("ref")).cast("int"))
    return with_context(features.prepared(found, {"t_": "t"}), reference_chunks(spark, folder))


@query("single_features", f"{_SINGLE_FACTS} SELECT ref_id, pos, {_features_sql(_SINGLE)} FROM facts")
def single_features(spark: SparkSession, folder: str) -> DataFrame:
    return _features_frame(single_featured(spark, folder, singles(spark, folder)), features.single_features())


def with_region(places: DataFrame) -> DataFrame:
    return places.withColumn("region", F.concat_ws(":", "ref_id", F.floor(F.col("pos") / 1000)))


def deep_places(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates with the backgrounds of all places of their regions, quiet ones among them."""
    piled = staged(with_region(pairs(spark, folder)), "pairs")
    return features.with_background(featured_of(piled.filter(caller.is_candidate(F.col("ref"))), spark, folder), piled, ["t_", "n_"])


def deep_single_places(spark: SparkSession, folder: str) -> DataFrame:
    piled = staged(with_region(singles(spark, folder)), "singles")
    return features.with_background(single_featured(spark, folder, piled), piled, ["t_"])


@query("deep_features", f"{_FACTS}, {_regions_sql('tn')} SELECT ref_id, pos, {_features_sql(_DEEP)} FROM deep")
def deep_features(spark: SparkSession, folder: str) -> DataFrame:
    return _features_frame(deep_places(spark, folder), features.deep_features())


@query(
    "deep_single_features",
    f"{_SINGLE_FACTS}, {_regions_sql('t')} SELECT ref_id, pos, {_features_sql({k: v for k, v in _SINGLE.items() if k != 'other_share'} | {'background': 't_bg', 'background_p': 't_bg_p'})} FROM deep",
)
def deep_single_features(spark: SparkSession, folder: str) -> DataFrame:
    more = {"background": features.clean(F.col("t_bg")), "background_p": features.clean(F.col("t_bg_p"))}
    return _features_frame(deep_single_places(spark, folder), features.single_features(deep=True) | more)
