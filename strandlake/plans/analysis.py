"""Queries on regions, pairs, call sets and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions import reads
from strandlake.operators import caller, evaluate, features, models, pileup, regions, resolve, toolkit
from strandlake.plans import calling, derived
from strandlake.plans.calling import PAIRS_SQL
from strandlake.plans.derived import READS_SQL
from strandlake.plans.queries import NAMES, PILE_COLUMNS, PILEUP_SQL, rounded
from strandlake.sources import bam
from strandlake.sources.staging import new_path, staged

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


# Regions ------------------------------------------------------------------------------------


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    part = spark.read.parquet(f"{folder}/part.parquet")
    start = F.col("p_partkey") * 7
    return part.select(F.col("p_partkey").alias("region_id"), (F.col("p_partkey") % 5).cast("int").alias("ref_id"), F.concat(F.lit("chr"), F.col("p_partkey") % 5 + 1).alias("chrom"), start.alias("start"), (start + 10 + F.col("p_size")).alias("stop"))


def targets(spark: SparkSession, folder: str) -> DataFrame:
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    return orders.select(F.concat(F.lit("chr"), F.col("o_custkey") % 5 + 1).alias("chrom"), (F.col("o_custkey") * 9).alias("start"), (F.col("o_custkey") * 9 + F.col("o_orderkey") % 40).alias("stop"))


REGIONS_SQL = """
manifest AS (SELECT p_partkey AS region_id, p_partkey % 5 AS ref_id, 'chr' || (p_partkey % 5 + 1) AS chrom, p_partkey * 7 AS m0, p_partkey * 7 + 10 + p_size AS m1 FROM part),
targets AS (SELECT 'chr' || (o_custkey % 5 + 1) AS chrom, o_custkey * 9 AS t0, o_custkey * 9 + o_orderkey % 40 AS t1 FROM orders)"""


@query(
    "targets_in_interval",
    f"WITH {REGIONS_SQL} SELECT chrom, greatest(t0, 500) AS start, least(t1, 9000) AS stop, count(*) AS n FROM targets WHERE chrom = 'chr2' AND greatest(t0, 500) <= least(t1, 9000) GROUP BY ALL",
)
def targets_in_interval(spark: SparkSession, folder: str) -> DataFrame:
    cut = regions.plan(targets(spark, folder), "chr2:500-9000", None, targets(spark, folder))
    return cut.groupBy("chrom", "start", "stop").agg(F.count(F.lit(1)).alias("n"))


@query(
    "targets_in_manifest",
    f"WITH {REGIONS_SQL} SELECT chrom, greatest(t0, m0) AS start, least(t1, m1) AS stop, count(*) AS n FROM targets JOIN manifest USING (chrom) "
    "WHERE t0 < m1 AND CASE WHEN t0 = t1 THEN m0 <= t0 ELSE m0 < t1 END AND greatest(t0, m0) <= least(t1, m1) GROUP BY ALL",
)
def targets_in_manifest(spark: SparkSession, folder: str) -> DataFrame:
    cut = regions.plan(targets(spark, folder), None, manifest(spark, folder), targets(spark, folder))
    return cut.groupBy("chrom", "start", "stop").agg(F.count(F.lit(1)).alias("n"))


@query(
    "reads_by_region",
    f"WITH {READS_SQL}, {REGIONS_SQL} SELECT region_id, count(*) AS n, sum(mapq)::BIGINT AS mapq FROM aln JOIN manifest m ON aln.ref_id = m.ref_id AND pos < m1 AND pos + span > m0 GROUP BY region_id",
)
def reads_by_region(spark: SparkSession, folder: str) -> DataFrame:
    aln = derived.alignments(spark, folder).select("ref_id", "pos", "cigar", "mapq")
    met = regions.reads_in_regions(aln, manifest(spark, folder), reads.end_position(F.col("pos"), F.col("cigar")))
    return met.groupBy("region_id").agg(F.count(F.lit(1)).alias("n"), F.sum("mapq").alias("mapq"))


@query(
    "region_tuples",
    f"WITH {READS_SQL}, {PILEUP_SQL}, {REGIONS_SQL} SELECT region_id, {', '.join(PILE_COLUMNS)}, round(entropy, 6) AS entropy FROM pile JOIN (SELECT region_id, ref_id AS mr, m0, m1 FROM manifest) ON ref_id = mr AND p >= m0 - 1 AND p < m1",
)
def region_tuples(spark: SparkSession, folder: str) -> DataFrame:
    """Pileups of the manifest's regions, which overlap: a place is there for each region that holds it."""
    found = pileup.region_pileup(derived.alignments(spark, folder), manifest(spark, folder))
    return found.select("region_id", *PILE_COLUMNS, rounded("entropy").alias("entropy"))


@query(
    "region_flanks",
    f"WITH {REGIONS_SQL}, t AS (SELECT DISTINCT chrom, t0 AS start FROM targets), m AS (SELECT chrom, m0, m0 + 6 AS m1 FROM manifest) "
    'SELECT t.chrom, t.start, m.m0 AS "left", m.m1 AS "right" FROM t LEFT JOIN m ON t.chrom = m.chrom AND t.start >= m.m0 AND t.start < m.m1',
)
def region_flanks(spark: SparkSession, folder: str) -> DataFrame:
    points = targets(spark, folder).select("chrom", "start").distinct().withColumn("stop", F.col("start"))
    apart = manifest(spark, folder).select("chrom", "start", (F.col("start") + 6).alias("stop"))
    return regions.flanks(points, apart).select("chrom", "start", "left", "right")


@query(
    "bam_region_scan",
    f"WITH {READS_SQL} SELECT name, flag, ref_id, pos, mapq, cigar FROM aln WHERE ref_id = 1 AND pos >= 2000 AND pos < 60000",
)
def bam_region_scan(spark: SparkSession, folder: str) -> DataFrame:
    """All reads written as sorted files, and a region of them read back: the scan takes the filter and decodes six columns."""
    path = new_path(spark, "bam")
    spark.dataSource.register(bam.BamSource)
    head = "\n".join(["@HD\tVN:1.6\tSO:coordinate", *[f"@SQ\tSN:{n}\tLN:{1 << 29}" for n in NAMES], ""])
    aln = derived.alignments(spark, folder).select(*bam.COLUMNS)
    aln.repartitionByRange("ref_id", "pos").sortWithinPartitions("ref_id", "pos").write.format("bam").mode("append").option("header", head).save(path)
    found = bam.scan(spark, path, ["name", "flag", "ref_id", "pos", "mapq", "cigar"]).filter("ref_id = 1 and pos >= 2000 and pos < 60000")
    return found.withColumn("cigar", reads.cigar_text(F.col("cigar")))


# Pairs --------------------------------------------------------------------------------------

RESOLVE_SQL = """
modelled AS (
    SELECT *, (flag & 64) <> 0 AS f1, (flag & 16) <> 0 AS rv, (flag & 32) <> 0 AS mrv, (flag & 13) = 1 AND ref_id = mate_ref_id AS eligible FROM aln
),
models AS (
    SELECT *, CASE WHEN (CASE WHEN f1 THEN pos ELSE mate_pos END) < (CASE WHEN f1 THEN mate_pos ELSE pos END)
        THEN 1 + 2 * (CASE WHEN f1 THEN rv ELSE mrv END)::INT + (CASE WHEN f1 THEN mrv ELSE rv END)::INT
        ELSE 5 + 2 * (CASE WHEN f1 THEN mrv ELSE rv END)::INT + (CASE WHEN f1 THEN rv ELSE mrv END)::INT END AS model
    FROM modelled
),
seen AS (
    SELECT *, row_number() OVER w AS k, mapq >= 1 AS uniq, lag(mapq >= 1) OVER w AS before FROM models WHERE eligible WINDOW w AS (PARTITION BY rg, name ORDER BY seq, ref_id, pos)
),
closed AS (SELECT rg, name, model, abs(insert_size) AS fragment FROM seen WHERE k % 2 = 0 AND uniq AND before),
ranked AS (SELECT rg, model, count(*) AS n, row_number() OVER (PARTITION BY rg ORDER BY count(*) DESC, model) AS place FROM closed GROUP BY rg, model),
tops AS (
    SELECT rg, max(model) FILTER (place = 1) AS top, max(model) FILTER (place = 2) AS second, coalesce(sum(n) FILTER (place > 2), 0) / sum(n) FILTER (place <= 2) > 0.1 AS ambiguous
    FROM ranked GROUP BY rg
),
frags AS (SELECT c.rg, list_sort(list(fragment)) AS f FROM closed c JOIN tops USING (rg) WHERE model IN (top, second) GROUP BY c.rg),
stats AS (
    SELECT rg, top, second, ambiguous, f[floor(len(f) * (1 - 0.9973) / 2)::INT + 1] AS shortest, f[floor(len(f) * 0.5)::INT + 1] AS middle,
        f[floor(len(f) * (1 - (1 - 0.9973) / 2))::INT + 1] AS longest
    FROM tops JOIN frags USING (rg)
)"""


@query("pair_statistics", f'WITH {READS_SQL}, {RESOLVE_SQL} SELECT rg, top, second AS "next", ambiguous, shortest, middle, longest FROM stats')
def pair_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return resolve.group_statistics(resolve.candidate_pairs(resolve.with_group(derived.alignments(spark, folder))))


@query(
    "pair_models",
    f"WITH {READS_SQL}, {RESOLVE_SQL} SELECT rg, model, count(*) AS n FROM models WHERE eligible GROUP BY rg, model",
)
def pair_models(spark: SparkSession, folder: str) -> DataFrame:
    grouped = resolve.with_group(derived.alignments(spark, folder)).filter(resolve.eligible())
    return grouped.groupBy("rg", resolve.model().alias("model")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "mark_proper_pairs",
    f"WITH {READS_SQL}, {RESOLVE_SQL} SELECT rg, sum(CASE WHEN eligible AND mapq >= 1 AND model IN (top, second) AND abs(insert_size) BETWEEN shortest AND longest "
    "AND (rg, name) IN (SELECT (rg, name) FROM closed) THEN 1 ELSE 0 END)::BIGINT AS proper, count(*) AS n FROM models LEFT JOIN stats USING (rg) GROUP BY rg",
)
def mark_proper_pairs(spark: SparkSession, folder: str) -> DataFrame:
    marked = resolve.with_group(resolve.marked(derived.alignments(spark, folder)))
    proper = F.when(reads.has(F.col("flag"), "proper_pair"), 1).otherwise(0)
    return marked.groupBy("rg").agg(F.sum(proper).alias("proper"), F.count(F.lit(1)).alias("n"))


@query(
    "two_pass_pairs",
    f"WITH {READS_SQL}, {RESOLVE_SQL} SELECT seq, name, ((flag & ~2) | CASE WHEN eligible AND mapq >= 1 AND model IN (top, second) AND abs(insert_size) BETWEEN shortest AND longest "
    "AND (rg, name) IN (SELECT (rg, name) FROM closed) THEN 2 ELSE 0 END)::INT AS flag FROM models LEFT JOIN stats USING (rg)",
)
def two_pass_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """The flags of all reads after both jobs: one writes statistics, the other reads them and marks."""
    return resolve.two_pass(derived.alignments(spark, folder), new_path(spark, "pairs")).select("seq", "name", "flag")


# Evaluation ---------------------------------------------------------------------------------


def scored_calls(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates with the share of the other base as their score."""
    found = calling.candidates(spark, folder).withColumn("alt", caller.alternative(F.col("ref")))
    share = caller.at_index("t_", "n", F.col("alt")) / F.col("t_n_all")
    return found.select("ref_id", "pos", share.alias("score"))


def truth(spark: SparkSession, folder: str) -> DataFrame:
    """A label for the places that the derivation varies, and for every seventh other place, as far as reads start there."""
    places = derived.alignments(spark, folder).filter("ref_id >= 0").select("ref_id", F.explode(F.sequence(F.col("pos") + 1, F.col("pos") + 7)).alias("pos")).distinct()
    varied = derived.is_variant(F.col("ref_id").cast("long"), (F.col("pos") - 1).cast("long"))
    return places.select("ref_id", "pos", F.when(varied, "SOMATIC").when(F.col("pos") % 7 == 0, "WILDTYPE").alias("label")).filter("label is not null")


TRUTH_SQL = """
truth AS (
    SELECT ref_id, pos, CASE WHEN ((pos - 1)::BIGINT * 69621 + ref_id * 17) % 2147483647 % 97 = 0 THEN 'SOMATIC' WHEN pos % 7 = 0 THEN 'WILDTYPE' END AS label
    FROM (SELECT DISTINCT ref_id, pos + i AS pos FROM (SELECT ref_id, pos, unnest(range(1, 8)) AS i FROM aln WHERE ref_id >= 0))
)"""
CALLS_SQL = f"""{PAIRS_SQL},
calls AS (SELECT ref_id, pos, t.ns[alt + 1] / t.n_all AS score FROM cand),
{TRUTH_SQL},
scored AS (SELECT c.*, label, label = 'SOMATIC' AS positive FROM calls c JOIN truth t ON c.ref_id = t.ref_id AND c.pos = t.pos WHERE label IS NOT NULL)"""


def scored(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.compared(scored_calls(spark, folder), truth(spark, folder), ["ref_id", "pos"])[0]


@query("call_rates", f"WITH {READS_SQL}, {CALLS_SQL}, c AS (SELECT count(*) FILTER (positive AND score >= 0.3) AS tp, count(*) FILTER (NOT positive AND score >= 0.3) AS fp, "
       "count(*) FILTER (NOT positive AND score < 0.3) AS tn, count(*) FILTER (positive AND score < 0.3) AS fn FROM scored) SELECT *, round(tp / nullif(tp + fn, 0), 6) AS tpr, round(tn / nullif(tn + fp, 0), 6) AS tnr FROM c")  # fmt: skip
def call_rates(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.rates(scored(spark, folder), 0.3).select("tp", "fp", "tn", "fn", rounded("tpr").alias("tpr"), rounded("tnr").alias("tnr"))


@query(
    "calls_without_truth",
    f"WITH {READS_SQL}, {CALLS_SQL} SELECT 'call' AS side, ref_id, pos FROM calls c WHERE NOT EXISTS (SELECT 1 FROM truth t WHERE t.ref_id = c.ref_id AND t.pos = c.pos AND label IS NOT NULL) "
    "UNION ALL SELECT 'truth', ref_id, pos FROM truth t WHERE label = 'SOMATIC' AND NOT EXISTS (SELECT 1 FROM calls c WHERE t.ref_id = c.ref_id AND t.pos = c.pos)",
)
def calls_without_truth(spark: SparkSession, folder: str) -> DataFrame:
    _, only_calls, only_truth = evaluate.compared(scored_calls(spark, folder), truth(spark, folder), ["ref_id", "pos"])
    missed = only_truth.filter("label = 'SOMATIC'").select(F.lit("truth").alias("side"), "ref_id", "pos")
    return only_calls.select(F.lit("call").alias("side"), "ref_id", "pos").unionByName(missed)


CURVE_SQL = """
points AS (SELECT score, count(*) FILTER (positive) AS p, count(*) FILTER (NOT positive) AS n FROM scored GROUP BY score),
curve AS (SELECT score, sum(n) OVER d / nullif(sum(n) OVER (), 0) AS fpr, sum(p) OVER d / nullif(sum(p) OVER (), 0) AS tpr FROM points WINDOW d AS (ORDER BY score DESC)),
steps AS (SELECT *, coalesce(lag(fpr) OVER d, 0) AS f0, coalesce(lag(tpr) OVER d, 0) AS t0 FROM curve WINDOW d AS (ORDER BY score DESC))"""


@query("roc_curve", f"WITH {READS_SQL}, {CALLS_SQL}, {CURVE_SQL} SELECT score, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM curve")
def roc_curve(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.curve(scored(spark, folder)).select("score", rounded("fpr").alias("fpr"), rounded("tpr").alias("tpr"))


@query("roc_area", f"WITH {READS_SQL}, {CALLS_SQL}, {CURVE_SQL} SELECT round(sum((fpr - f0) * (tpr + t0) / 2), 6) AS area, round(sum((fpr - f0) * (tpr + t0) / 2) FILTER (f0 < 0.1), 6) AS area_10 FROM steps")
def roc_area(spark: SparkSession, folder: str) -> DataFrame:
    points = evaluate.curve(scored(spark, folder))
    return points.agg(rounded(evaluate.area_under()).alias("area"), rounded(evaluate.area_under(0.1)).alias("area_10"))


@query("score_histogram", f"WITH {READS_SQL}, {CALLS_SQL} SELECT round(score, 4) AS score, positive, count(*) AS n FROM scored GROUP BY ALL")
def score_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.histogram(scored(spark, folder))


@query(
    "feature_boxes",
    f"WITH {READS_SQL}, {CALLS_SQL}, long AS (SELECT label, 'score' AS feature, score AS value FROM scored UNION ALL SELECT label, 'pos', pos FROM scored), "
    "q AS (SELECT label, feature, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM long GROUP BY label, feature) "
    "SELECT label, feature, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, count(*) FILTER (value > q3 + 1.5 * (q3 - q1)) AS above, "
    "count(*) FILTER (value < q1 - 1.5 * (q3 - q1)) AS below FROM long JOIN q USING (label, feature) GROUP BY label, feature, q1, median, q3",
)
def feature_boxes(spark: SparkSession, folder: str) -> DataFrame:
    found = evaluate.boxes(scored(spark, folder), "label", ["score", "pos"])
    return found.select("label", "feature", *[rounded(c).alias(c) for c in ("q1", "median", "q3")], "above", "below")


# Calls as rows ------------------------------------------------------------------------------


_FIELDS = "concat_ws(':', {s}.ns[ref + 1], {s}.ns[alt + 1], {s}.ins, {s}.dels, {s}.n_all, {gt}, {pl})"


@query(
    "vcf_rows",
    f"WITH {READS_SQL}, {PAIRS_SQL}, {calling.CONTEXT_SQL}, {calling._GENOTYPES_SQL}, probable AS (SELECT *, round(t.ns[alt + 1] / t.n_all, 4) AS pr FROM shares), "
    "flagged AS (SELECT *, CASE WHEN (t.indel_A + t.indel_C + t.indel_G + t.indel_T) / t.n_all > 0.05 THEN 'INDL' ELSE 'PASS' END AS flag, "
    "CASE WHEN pr = 0 THEN 0.0 WHEN pr = 1 THEN 100.0 ELSE -10 * log10(1 - pr) END AS qual FROM probable WHERE pr >= 0.3) "
    "SELECT f.ref_id, f.pos, concat_ws(chr(9), 'chr' || (f.ref_id + 1), f.pos, '.', substr('ACGT', ref::INT + 1, 1), substr('ACGT', alt::INT + 1, 1), printf('%.2f', round_even(qual, 2)), flag, "
    "'PR=' || printf('%.2f', round_even(pr, 2)) || ';TC=' || x.trinucleotide, 'RC:AC:NI:ND:DP:GT:PL', "
    + _FIELDS.format(s="t", gt=calling._GT.format(s="t"), pl=calling._PL.format(s="t")) + ", " + _FIELDS.format(s="n", gt=calling._GT.format(s="n"), pl=calling._PL.format(s="n"))
    + ") AS line FROM flagged f JOIN context x ON f.ref_id = x.ref_id AND f.pos = x.pos",
)
def vcf_rows(spark: SparkSession, folder: str) -> DataFrame:
    found = calling.with_context(calling.candidates(spark, folder), calling.reference_chunks(spark, folder))
    share = caller.at_index("t_", "n", caller.alternative(F.col("ref"))) / F.col("t_n_all")
    called = caller.calls(found.withColumn("probability", F.round(share, 4)), {"t_": "t", "n_": "n"})
    return caller.vcf_rows(called, NAMES, ["t_", "n_"], threshold=0.3)


@query("random_reads")
def random_reads(spark: SparkSession, folder: str) -> DataFrame:
    """A sample: its size is the feature."""
    aln = derived.alignments(spark, folder).filter("ref_id >= 0")
    lengths = aln.groupBy("ref_id").agg((F.max("pos") + 1).alias("length"))
    return toolkit.random_reads(spark, aln.select("seq", "ref_id", "pos", "mapq"), lengths, 2000).select("draw", "seq", "ref_id", "pos", "mapq")


# Models -------------------------------------------------------------------------------------


def training_rows(spark: SparkSession, folder: str) -> DataFrame:
    named = features.paired_features()
    found = calling.featured(spark, folder).select("ref_id", "pos", *[c.alias(n) for n, c in named.items()])
    return found.join(truth(spark, folder), ["ref_id", "pos"], "left").fillna("WILDTYPE", ["label"])


@query("forest_scores")
def forest_scores(spark: SparkSession, folder: str) -> DataFrame:
    rows = staged(models.labelled(training_rows(spark, folder), ("SOMATIC",)), "training")
    model = models.forest(rows, [*features.paired_features()], trees=20, depth=8)
    return models.scored(model, rows).select("ref_id", "pos", "target", rounded("probability", 4).alias("probability"))
