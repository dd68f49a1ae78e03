"""Queries on training rows, all places, and the smaller parts of evaluation and the toolkit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions import reads, sequence
from strandlake.operators import caller, evaluate, features, models, pileup, toolkit, training
from strandlake.plans import analysis, calling, derived
from strandlake.plans.analysis import CALLS_SQL, REGIONS_SQL, TRUTH_SQL
from strandlake.plans.calling import CONTEXT_SQL, PAIRS_SQL
from strandlake.plans.derived import READS_SQL
from strandlake.plans.queries import NAMES, rounded
from strandlake.sources import text
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


# Training rows ------------------------------------------------------------------------------

#: Pairs of all places with a counted base in both samples, and those of them that have a label, as candidates.
_PAIRS_FROM_ONE = PAIRS_SQL[: PAIRS_SQL.index("cand AS (")].replace("n_all >= 4", "n_all >= 1")
_OTHER = "(SELECT coalesce(max_by(i, t.ns[i + 1] * 10 - i), [1, 2, 0, 0][ref + 1]) FROM (SELECT unnest(range(4)) AS i) WHERE i <> ref AND t.ns[i + 1] > 0) AS other"
_LABELLED_SQL = f"""{_PAIRS_FROM_ONE}
{TRUTH_SQL},
labels AS (SELECT ref_id, pos, label FROM truth WHERE label IS NOT NULL),
cand AS (SELECT *, {_OTHER} FROM pairs WHERE (ref_id, pos) IN (SELECT (ref_id, pos) FROM labels)),
{CONTEXT_SQL}, {calling._facts_sql('tn')}"""


def training_places(spark: SparkSession, folder: str) -> DataFrame:
    """What the features of labelled places need, called or not; places whose reference is none of the four bases go."""
    labels = staged(analysis.truth(spark, folder), "labels")
    found = calling.with_reference(training.labelled_pairs(derived.alignments(spark, folder), labels))
    return calling.featured_of(found.filter("ref < 4"), spark, folder)


@query("training_features", f"WITH {READS_SQL}, {_LABELLED_SQL} SELECT ref_id, pos, label, {calling._features_sql(calling._PAIRED)} FROM facts JOIN labels USING (ref_id, pos)")
def training_features(spark: SparkSession, folder: str) -> DataFrame:
    return training_places(spark, folder).select("ref_id", "pos", "label", *[rounded(c).alias(n) for n, c in features.paired_features().items()])


_DEEP_SQL = calling._regions_sql("tn").replace("FROM pairs)", "FROM pairs JOIN manifest m ON m.ref_id = pairs.ref_id AND pos >= m0 AND pos <= m1)").replace(
    "SELECT ref_id, pos", "SELECT region_id, m0, ref_id, pos").replace("PARTITION BY ref_id, pos // 1000", "PARTITION BY region_id").replace("region_id, m0, ref_id, pos, list_max", "region_id, m0, pairs.ref_id, pos, list_max")


@query(
    "deep_training_features",
    f"WITH {READS_SQL}, {REGIONS_SQL}, {_LABELLED_SQL}, {_DEEP_SQL} SELECT ref_id, pos, label, region_id, {calling._features_sql(calling._DEEP)} FROM deep JOIN labels USING (ref_id, pos)",
)
def deep_training_features(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled places of the manifest's regions, both ends among them, with the backgrounds of all other places of their regions.

    Regions overlap: a place has a row for each region that holds it.
    """
    piled = calling.with_reference(training.region_pairs(derived.alignments(spark, folder), analysis.manifest(spark, folder))).withColumnRenamed("region_id", "region")
    piled = staged(piled.filter("ref < 4"), "training")
    labelled = piled.join(analysis.truth(spark, folder), ["ref_id", "pos"])
    found = features.with_background(calling.featured_of(labelled, spark, folder), piled, ["t_", "n_"])
    return found.select("ref_id", "pos", "label", F.col("region").alias("region_id"), *[rounded(c).alias(n) for n, c in features.deep_features().items()])


@query("net_weights")
def net_weights(spark: SparkSession, folder: str) -> DataFrame:
    """The weight of each feature in the elastic net that folds of the training rows choose, and whether a forest would get it."""
    columns = [*features.paired_features()]
    rows = training_places(spark, folder).select("ref_id", "pos", "label", *[c.alias(n) for n, c in features.paired_features().items()])
    net = models.elastic_net(staged(models.labelled(rows, ("SOMATIC",)), "net"), columns, ["ref_id", "pos"])
    stay = models.kept(net, ("strand_posterior",))
    return spark.createDataFrame([(c, w, c in stay) for c, w in net.weights.items()], "feature string, weight double, kept boolean")


# Calls of all places ------------------------------------------------------------------------


@query(
    "all_places",
    f"WITH {READS_SQL}, {_PAIRS_FROM_ONE.replace('mapq >= 10', 'mapq >= 0').replace('bq >= 10', 'bq >= 0').rstrip().rstrip(',')}, "
    "named AS (SELECT *, CASE WHEN t.major = ref THEN t.minor ELSE t.major END AS alt FROM pairs) "
    "SELECT ref_id, pos, ref::INT AS ref, alt::INT AS alt, t.n_all AS t_depth, t.ns[alt + 1] AS t_alt, n.n_all AS n_depth, n.ns[alt + 1] AS n_alt FROM named",
)
def all_places(spark: SparkSession, folder: str) -> DataFrame:
    """Every place that both samples cover with a base, of any quality: no candidate rule, no thresholds."""
    piled = pileup.pileup(derived.alignments(spark, folder), **pileup.ALL_PLACES)
    found = calling.with_reference(caller.paired(piled)).withColumn("alt", caller.alternative(F.col("ref")).cast("int"))
    return found.select(
        "ref_id", "pos", "ref", "alt", F.col("t_n_all").alias("t_depth"), caller.at_index("t_", "n", F.col("alt")).alias("t_alt"),
        F.col("n_n_all").alias("n_depth"), caller.at_index("n_", "n", F.col("alt")).alias("n_alt"),
    )


# Evaluation ---------------------------------------------------------------------------------


@query(
    "variant_ratios",
    f"WITH {READS_SQL}, {PAIRS_SQL} SELECT ref_id, pos, round(t.ns[alt + 1] / nullif(t.ns[alt + 1] + t.ns[ref + 1], 0), 6) AS ratio FROM cand",
)
def variant_ratios(spark: SparkSession, folder: str) -> DataFrame:
    found = calling.candidates(spark, folder).withColumn("alt", caller.alternative(F.col("ref")))
    ratio = evaluate.variant_ratio(caller.at_index("t_", "n", F.col("alt")), caller.at_index("t_", "n", F.col("ref")))
    return found.select("ref_id", "pos", rounded(ratio).alias("ratio"))


@query("distinct_labels", f"WITH {READS_SQL}, {TRUTH_SQL} SELECT label, count(*) AS n FROM truth WHERE label IS NOT NULL GROUP BY label")
def distinct_labels(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.labels(analysis.truth(spark, folder))


@query(
    "score_integral",
    f"WITH {READS_SQL}, {CALLS_SQL}, points AS (SELECT score, count(*) AS n, row_number() OVER (ORDER BY score) - 1 AS i FROM scored GROUP BY score), "
    "below AS (SELECT p.score, p.n, p.i AS m, list(q.n ORDER BY q.i) AS y FROM points p LEFT JOIN points q ON q.i < p.i GROUP BY ALL), "
    "parts AS (SELECT score, n, m, y, list_sum(list_transform(range(1, m - 1, 2), lambda k: y[k] + 4 * y[k + 1] + y[k + 2])) / 3 AS from_first, "
    "list_sum(list_transform(range(2, m - 1, 2), lambda k: y[k] + 4 * y[k + 1] + y[k + 2])) / 3 AS from_second FROM below) "
    "SELECT score, n, round(0.1 * CASE WHEN m < 2 THEN 0 WHEN m % 2 = 1 THEN from_first ELSE (coalesce(from_first, 0) + (y[m - 1] + y[m]) / 2 + coalesce(from_second, 0) + (y[1] + y[2]) / 2) / 2 END, 6) AS integral FROM parts",
)
def score_integral(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.integral(analysis.scored(spark, folder), 0.1).select("score", "n", rounded("integral").alias("integral"))


@query(
    "labelled_features",
    f"WITH {READS_SQL}, {CALLS_SQL} SELECT t.ref_id, t.pos, label, round(score, 6) AS score, CASE WHEN score IS NULL THEN NULL WHEN label = 'SOMATIC' THEN CASE WHEN score >= 0.3 THEN 'TP' ELSE 'FN' END "
    "WHEN score >= 0.3 THEN 'FP' ELSE 'TN' END AS bucket FROM truth t LEFT JOIN calls c ON t.ref_id = c.ref_id AND t.pos = c.pos WHERE label IS NOT NULL",
)
def labelled_features(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled places with the score and the bucket of their call, if there is one."""
    met = evaluate.labelled_features(analysis.truth(spark, folder), analysis.scored_calls(spark, folder), ["ref_id", "pos"], 0.3)
    return met.select("ref_id", "pos", "label", rounded("score").alias("score"), "bucket")


# Reference and reads ------------------------------------------------------------------------


def written_reference(spark: SparkSession, folder: str, width: int = 60) -> str:
    """The path of the derived reference as FASTA text, in parts that go on from each other."""
    symbol = lambda p: F.substring(F.lit("ACGT"), derived.reference_base(F.col("ref_id").cast("long"), p).cast("int") + 1, 1)
    sizes = spark.read.parquet(f"{folder}/lineitem.parquet").agg((F.max("l_partkey") * 7 + 600).alias("size"))
    ends = sizes.select("size", F.explode(F.sequence(F.lit(0), F.lit(derived.REFERENCES - 1))).alias("ref_id"))
    lines = ends.select("ref_id", "size", F.explode(F.sequence(F.lit(-1).cast("long"), F.floor((F.col("size") - 1) / width))).alias("n"))
    bases = F.array_join(F.transform(F.sequence(F.col("n") * width, F.least((F.col("n") + 1) * width, F.col("size")) - 1), symbol), "")
    value = F.when(F.col("n") < 0, F.concat(F.lit(">chr"), F.col("ref_id") + 1, F.lit(" derived"))).otherwise(bases)
    path = new_path(spark, "fasta")
    lines.repartitionByRange("ref_id", "n").sortWithinPartitions("ref_id", "n").select(value.alias("value")).write.text(path)
    return path


_REFERENCE_SQL = "sizes AS (SELECT max(l_partkey) * 7 + 600 AS size FROM lineitem), refs AS (SELECT unnest(range(5)) AS ref_id, size FROM sizes)"


@query(
    "fasta_index",
    f"WITH {_REFERENCE_SQL} SELECT 'chr' || (ref_id + 1) AS name, size AS length, (ref_id + 1) * 14 + ref_id * (size + (size + 59) // 60) AS \"offset\", 60 AS line_bases, 61 AS line_bytes, ref_id::INT AS ref_id FROM refs",
)
def fasta_index(spark: SparkSession, folder: str) -> DataFrame:
    return text.fasta_index(spark, written_reference(spark, folder))


@query(
    "fasta_chunks",
    f"WITH {_REFERENCE_SQL}, parts AS (SELECT ref_id, size, unnest(range((size + 4095) // 4096)) AS chunk FROM refs), "
    "bounds AS (SELECT *, greatest(chunk * 4096 - 512, 0) AS lo, least((chunk + 1) * 4096 + 512, size) AS hi FROM parts), "
    f"letters AS (SELECT ref_id, chunk, size, lo, i, substr('ACGT', ({calling._rb('i')})::INT + 1, 1) AS b FROM (SELECT *, unnest(range(lo, hi)) AS i FROM bounds)) "
    "SELECT ref_id::INT AS ref_id, chunk::INT AS chunk, lo::INT AS \"offset\", size::INT AS size, md5(string_agg(b, '' ORDER BY i)) AS bases FROM letters GROUP BY ref_id, chunk, lo, size",
)
def fasta_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The reference, written as text and read in parts: a digest of each chunk's bases."""
    return text.fasta_chunks(spark, written_reference(spark, folder)).withColumn("bases", F.md5("bases"))


@query(
    "wide_context",
    f"WITH {READS_SQL}, {PAIRS_SQL}, sizes AS (SELECT max(l_partkey) * 7 + 600 AS size FROM lineitem), "
    "windows AS (SELECT ref_id, pos, size, CASE WHEN pos - 251 < 0 THEN 0 WHEN pos + 249 > size THEN size - 500 ELSE pos - 251 END AS w0 FROM cand, sizes), "
    f"letters AS (SELECT ref_id, pos, i, substr('ACGT', ({calling._rb('w0 + i')})::INT + 1, 1) AS b FROM (SELECT *, unnest(range(501)) AS i FROM windows) WHERE w0 + i < size) "
    "SELECT ref_id, pos, count(*)::INT AS n, md5(string_agg(b, '' ORDER BY i)) AS bases FROM letters GROUP BY ref_id, pos",
)
def wide_context(spark: SparkSession, folder: str) -> DataFrame:
    """The 501 bases around each candidate, both ends among them, as their number and their digest."""
    chunks = calling.reference_chunks(spark, folder)
    places = calling.candidates(spark, folder).select("ref_id", "pos").withColumn("chunk", F.floor((F.col("pos") - 1) / sequence.CHUNK))
    held = places.join(chunks.select("ref_id", "chunk", "size", F.col("bases").alias("seq"), F.col("offset").alias("seq_at")), ["ref_id", "chunk"])
    around = held.select("ref_id", "pos", sequence.window(F.col("pos"), F.col("size"), closed=True).alias("w"))
    return around.select("ref_id", "pos", F.length("w").alias("n"), F.md5("w").alias("bases"))


@query(
    "tag_types",
    f"WITH {READS_SQL} SELECT CASE WHEN ln = 1 THEN 'NM,OQ,RG' ELSE 'NM,RG' END AS names, 'C' AS nm_type, CASE WHEN ln = 1 THEN 'Z' END AS oq_type, count(*) AS n FROM aln GROUP BY ALL",
)
def tag_types(spark: SparkSession, folder: str) -> DataFrame:
    tags = F.col("tags")
    named = derived.alignments(spark, folder).select(F.array_join(reads.tag_names(tags), ",").alias("names"), reads.tag_type(tags, "NM").alias("nm_type"), reads.tag_type(tags, "OQ").alias("oq_type"))
    return named.groupBy("names", "nm_type", "oq_type").agg(F.count(F.lit(1)).alias("n"))


_PERCENTS = {
    "mapped": "(flag & 4) = 0", "forward": "(flag & 16) = 0", "reverse": "(flag & 16) <> 0", "failed_qc": "(flag & 512) <> 0", "duplicates": "(flag & 1024) <> 0", "paired": "(flag & 1) <> 0",
    "proper_pairs": "(flag & 3) = 3", "both_mapped": "(flag & 13) = 1", "first_mates": "(flag & 65) = 65", "second_mates": "(flag & 129) = 129", "singletons": "(flag & 13) = 9",
}


@query("read_percents", f"WITH {READS_SQL} SELECT count(*) AS total, {', '.join(f'round(100 * count(*) FILTER ({t}) / count(*), 6) AS {n}' for n, t in _PERCENTS.items())} FROM aln")
def read_percents(spark: SparkSession, folder: str) -> DataFrame:
    found = toolkit.percents(toolkit.statistics(derived.alignments(spark, folder)))
    return found.select("total", *[rounded(n).alias(n) for n in _PERCENTS])


#: The first base of a read, clipped or not, and whether mapped or not.
_NOISE = "((ok * 7919 + ln * 104729) * 48271 % 2147483647 % 100)"
_FIRST_BASE = (
    f"CASE WHEN ln = 4 THEN (ok + ln) % 4 WHEN {_NOISE} = 99 THEN 4 WHEN (pos0::BIGINT * 69621 + ref0 * 17) % 2147483647 % 97 = 0 AND ok % 4 = 1 THEN ({calling._rb('pos0', 'ref0')} + 2) % 4 "
    f"WHEN {_NOISE} < 1 THEN ({calling._rb('pos0', 'ref0')} + 1) % 4 ELSE {calling._rb('pos0', 'ref0')} END"
)
#: A token for each property of a filter, and the same in SQL.
_PROPERTIES = {
    "alignmentFlag": (">=99", "flag >= 99"), "cigar": ("*I*", "contains(cigar, 'I')"), "insertSize": ("<0", "insert_size < 0"), "isDuplicate": ("true", "(flag & 1024) <> 0"),
    "isFailedQC": ("true", "(flag & 512) <> 0"), "isFirstMate": ("false", "(flag & 64) = 0"), "isMapped": ("true", "(flag & 4) = 0"), "isMateMapped": ("false", "(flag & 8) <> 0"),
    "isMateReverseStrand": ("true", "(flag & 32) <> 0"), "isPaired": ("true", "(flag & 1) <> 0"), "isPrimaryAlignment": ("false", "(flag & 256) <> 0"), "isProperPair": ("true", "(flag & 2) <> 0"),
    "isReverseStrand": ("true", "(flag & 16) <> 0"), "isSecondMate": ("true", "(flag & 128) <> 0"), "isSingleton": ("true", "(flag & 13) = 9"), "length": ("50", "true"),
    "mapQuality": ("!30", "mapq <> 30"), "matePosition": (">5000", "mate_pos > 5000"), "mateReference": ("chr2", "(flag & 8) = 0 AND mate_ref_id = 1"), "name": ("r1*", "prefix(name, 'r1')"),
    "position": ("<=5000", "pos <= 5000"), "reference": ("chr1", "ref_id = 0"), "tag": ("NM:<=2", "nm <= 2"), "queryBases": ("A*", f"{_FIRST_BASE} = 0"),
}


@query("filter_properties", f"WITH {READS_SQL} SELECT sample, {', '.join(f'count(*) FILTER ({t}) AS {n}' for n, (_, t) in _PROPERTIES.items())} FROM aln GROUP BY sample")
def filter_properties(spark: SparkSession, folder: str) -> DataFrame:
    """How many reads of each sample every property of a filter lets through, in one pass."""
    aln = derived.alignments(spark, folder)
    return aln.groupBy("sample").agg(*[F.count_if(toolkit.property_test(n, token, NAMES)).alias(n) for n, (token, _) in _PROPERTIES.items()])
