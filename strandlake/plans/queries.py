"""Queries over reads derived from the tables, and the same in SQL for an independent engine.

Doubles are rounded on both sides: sums of doubles depend on their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions import reads
from strandlake.operators import formats, ordered, pileup, toolkit
from strandlake.plans import derived
from strandlake.plans.derived import READS_SQL

NAMES = [f"chr{i}" for i in range(1, derived.REFERENCES + 1)]
NAMES_SQL = "['chr1', 'chr2', 'chr3', 'chr4', 'chr5']"
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, extra: str = ""):
    """Register a query; sql comes after the common tables, extra adds to them."""

    def register(f):
        QUERIES[name] = lambda spark, folder: f(derived.alignments(spark, folder))
        if sql:
            common = READS_SQL + (f",{extra}" if extra else "")
            ORACLE_SQL[name] = f"WITH {common}{',' if sql.startswith('marks AS') else ''} {sql}"
        return f

    return register


def rounded(column: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, digits)


# Scalar functions ---------------------------------------------------------------------------


@query(
    "read_flags",
    "SELECT count(*) AS n, flag, (flag & 4) = 0 AS mapped, (flag & 256) = 0 AS is_primary, (flag & 16) <> 0 AS reversed, "
    "(flag & 1) <> 0 AND (flag & 4) = 0 AND (flag & 8) <> 0 AS singleton, (flag & ~1024) AS undup, flag | 4 AS unmapped_flag FROM aln GROUP BY flag",
)
def read_flags(aln: DataFrame) -> DataFrame:
    f = F.col("flag")
    return aln.groupBy("flag").agg(F.count(F.lit(1)).alias("n")).select(
        "n", "flag", reads.has(f, "mapped").alias("mapped"), reads.has(f, "primary").alias("is_primary"), reads.has(f, "reverse").alias("reversed"),
        reads.is_singleton(f).alias("singleton"), reads.with_flag(f, "duplicate", False).alias("undup"), reads.with_flag(f, "mapped", False).alias("unmapped_flag"),
    )


@query(
    "read_extents",
    "SELECT seq, ref_id, pos + span AS end_pos, pos + span + CASE WHEN ln = 2 THEN 1 ELSE 0 END AS padded_end, pos + span - 1 AS closed_end, "
    "cigar, CASE WHEN pos >> 14 = (pos + span - 1) >> 14 THEN 4681 + (pos >> 14) WHEN pos >> 17 = (pos + span - 1) >> 17 THEN 585 + (pos >> 17) "
    "WHEN pos >> 20 = (pos + span - 1) >> 20 THEN 73 + (pos >> 20) WHEN pos >> 23 = (pos + span - 1) >> 23 THEN 9 + (pos >> 23) "
    "WHEN pos >> 26 = (pos + span - 1) >> 26 THEN 1 + (pos >> 26) ELSE 0 END AS bin FROM aln WHERE ref_id >= 0",
)
def read_extents(aln: DataFrame) -> DataFrame:
    pos, cigar = F.col("pos"), F.col("cigar")
    end = reads.end_position(pos, cigar)
    return aln.filter("ref_id >= 0").select(
        "seq", "ref_id", end.alias("end_pos"), reads.end_position(pos, cigar, padded=True).alias("padded_end"),
        reads.end_position(pos, cigar, closed=True).alias("closed_end"), reads.cigar_text(cigar).alias("cigar"), reads.minimum_bin(pos, end).alias("bin"),
    )


@query(
    "soft_clips",
    "SELECT seq, 5 AS size, CASE WHEN ln = 4 THEN 5 ELSE 45 END AS read_at, CASE WHEN ln = 4 THEN pos ELSE pos + 45 END AS clip_pos FROM aln WHERE ln IN (4, 7)",
)
def soft_clips(aln: DataFrame) -> DataFrame:
    clips = aln.select("seq", F.explode(reads.soft_clips(F.col("pos"), F.col("cigar"))).alias("c"))
    return clips.select("seq", F.col("c.size").alias("size"), F.col("c.read_at").alias("read_at"), F.col("c.pos").alias("clip_pos"))


@query(
    "candidate_bins",
    "SELECT ref_id, pos, len(list_distinct(list_concat([0], range(1 + (pos >> 26), 2 + ((pos + span - 1) >> 26)), range(9 + (pos >> 23), 10 + ((pos + span - 1) >> 23)), "
    "range(73 + (pos >> 20), 74 + ((pos + span - 1) >> 20)), range(585 + (pos >> 17), 586 + ((pos + span - 1) >> 17)), "
    "range(4681 + (pos >> 14), 4682 + ((pos + span - 1) >> 14))))) AS n_bins, count(*) AS n FROM aln WHERE ref_id >= 0 GROUP BY ALL",
)
def candidate_bins(aln: DataFrame) -> DataFrame:
    bins = F.size(reads.candidate_bins(F.col("pos"), reads.end_position(F.col("pos"), F.col("cigar")))).alias("n_bins")
    return aln.filter("ref_id >= 0").select("ref_id", "pos", bins).groupBy("ref_id", "pos", "n_bins").agg(F.count(F.lit(1)).alias("n"))


BASES_SQL = """
qs AS (SELECT *, unnest(range(50)) AS i FROM aln),
qb AS (
    SELECT *, CASE ln WHEN 2 THEN CASE WHEN i < 20 THEN i WHEN i > 20 THEN i - 1 END WHEN 3 THEN CASE WHEN i < 25 THEN i ELSE i + 2 END
        WHEN 4 THEN CASE WHEN i >= 5 THEN i - 5 END WHEN 5 THEN CASE WHEN i < 20 THEN i ELSE i + 10 END WHEN 7 THEN CASE WHEN i < 45 THEN i END ELSE i END AS o
    FROM qs
),
qc AS (
    SELECT *, (((pos0 + o) * 1103515245::BIGINT + ref0 * 12345 + 7) % 2147483648) // 65536 % 4 AS rb,
        (ok * 7919 + ln * 104729 + i * 1299709) * 48271 % 2147483647 % 100 AS noise, ((pos0 + o) * 69621 + ref0 * 17) % 2147483647 % 97 = 0 AS variant
    FROM qb
),
qd AS (
    SELECT *, substr('ACGTN', 1 + (CASE WHEN o IS NULL THEN (ok + ln + i) % 4 WHEN noise = 99 AND i % 10 = 0 THEN 4
        WHEN variant AND ok % 4 = 1 THEN (rb + 2) % 4 WHEN noise < 1 THEN (rb + 1) % 4 ELSE rb END)::INT, 1) AS base,
        chr((35 + (ok * 13 + ln * 7 + i * 31) % 35)::INT) AS qual
    FROM qc
),
strings AS (
    SELECT seq, sk, string_agg(base, '' ORDER BY i) AS bases, string_agg(qual, '' ORDER BY i) AS quals,
        any_value(name) AS name, any_value(sample) AS sample, any_value(flag) AS flag, any_value(ref_id) AS ref_id, any_value(pos) AS pos, any_value(mapq) AS mapq,
        any_value(cigar) AS cigar, any_value(ln) AS ln, any_value(span) AS span, any_value(mate_ref_id) AS mate_ref_id, any_value(mate_pos) AS mate_pos,
        any_value(insert_size) AS insert_size, any_value(rg) AS rg, any_value(nm) AS nm, count(*) // 50 AS copies
    FROM (SELECT *, row_number() OVER (PARTITION BY seq, sk, i) AS copy FROM qd) GROUP BY seq, sk, copy
)"""


@query(
    "aligned_bases",
    "SELECT seq, CASE ln WHEN 3 THEN left(bases, 25) || '--' || right(bases, 25) WHEN 4 THEN substr(bases, 6) "
    "WHEN 5 THEN left(bases, 20) || 'NNNNNNNNNN' || right(bases, 30) WHEN 7 THEN left(bases, 45) ELSE bases END AS aligned, "
    "reverse(translate(bases, 'ACGT', 'TGCA')) AS other_strand FROM strings",
    BASES_SQL,
)
def aligned_bases(aln: DataFrame) -> DataFrame:
    return aln.select("seq", reads.aligned_bases(F.col("bases"), F.col("cigar")).alias("aligned"), reads.reverse_complement(F.col("bases")).alias("other_strand"))


@query(
    "read_tags",
    "SELECT rg, count(*) AS n, sum(nm)::BIGINT AS nm, count(*) FILTER (ln = 1) AS with_oq, sum(CASE WHEN ln = 1 THEN 3 ELSE 2 END)::BIGINT AS n_tags FROM aln GROUP BY rg",
)
def read_tags(aln: DataFrame) -> DataFrame:
    tags = F.col("tags")
    return aln.groupBy(reads.tag(tags, "RG", "s").alias("rg")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(reads.tag(tags, "NM", "i")).alias("nm"), F.count_if(F.map_contains_key(tags, "OQ")).alias("with_oq"),
        F.sum(F.size(F.map_keys(tags))).cast("long").alias("n_tags"),
    )


# Toolkit ------------------------------------------------------------------------------------

REGION = (1, 1000, 2, 6000)
IN_REGION_SQL = "ref_id >= 0 AND (ref_id > 1 OR (ref_id = 1 AND pos + span > 1000)) AND (ref_id < 2 OR (ref_id = 2 AND pos < 6000))"


@query("count_reads", f"SELECT count(*) AS n FROM aln WHERE {IN_REGION_SQL}")
def count_reads(aln: DataFrame) -> DataFrame:
    name, start, other, stop = toolkit.parse_region("chr2:1000..chr3:6000")
    return toolkit.count(aln, (NAMES.index(name), start, NAMES.index(other), stop))


@query(
    "read_statistics",
    "SELECT count(*) AS total, count(*) FILTER ((flag & 4) = 0) AS mapped, count(*) FILTER ((flag & 16) = 0) AS forward, "
    "count(*) FILTER ((flag & 16) <> 0) AS reverse, count(*) FILTER ((flag & 512) <> 0) AS failed_qc, count(*) FILTER ((flag & 1024) <> 0) AS duplicates, "
    "count(*) FILTER ((flag & 1) <> 0) AS paired, count(*) FILTER ((flag & 3) = 3) AS proper_pairs, count(*) FILTER ((flag & 13) = 1) AS both_mapped, "
    "count(*) FILTER ((flag & 65) = 65) AS first_mates, count(*) FILTER ((flag & 129) = 129) AS second_mates, count(*) FILTER ((flag & 13) = 9) AS singletons FROM aln",
)
def read_statistics(aln: DataFrame) -> DataFrame:
    return toolkit.statistics(aln)


@query("insert_sizes", "SELECT round(avg(abs(insert_size)), 6) AS mean, median(abs(insert_size)) AS median FROM aln WHERE (flag & 64) <> 0 AND insert_size <> 0")
def insert_sizes(aln: DataFrame) -> DataFrame:
    return toolkit.insert_sizes(aln).select(rounded("mean").alias("mean"), "median")


SCRIPT = {
    "filters": [
        {"id": "good", "mapQuality": ">=20", "isDuplicate": "false", "reference": "!chr3"},
        {"id": "first", "isFirstMate": "true", "name": "*.1"},
        {"id": "group", "tag": "RG:rg2"},
        {"id": "edited", "tag": "NM:>3", "cigar": "*D*"},
    ],
    "rule": "good & (first | !group) | edited",
}


@query(
    "filter_script",
    "SELECT sample, flag, count(*) AS n, sum(pos)::BIGINT AS places FROM aln WHERE (mapq >= 20 AND (flag & 1024) = 0 AND ref_id >= 0 AND ref_id <> 2 "
    "AND (((flag & 64) <> 0 AND suffix(name, '.1')) OR NOT rg = 'rg2')) OR (nm > 3 AND contains(cigar, 'D')) GROUP BY sample, flag",
)
def filter_script(aln: DataFrame) -> DataFrame:
    kept = toolkit.filtered(aln, SCRIPT, NAMES)
    return kept.groupBy("sample", "flag").agg(F.count(F.lit(1)).alias("n"), F.sum("pos").alias("places"))


@query(
    "sort_by_position",
    "SELECT seq, ref_id, pos, rank() OVER (ORDER BY ref_id < 0, ref_id, pos, seq) AS place FROM aln",
)
def sort_by_position(aln: DataFrame) -> DataFrame:
    """Every read of both files with its place in the order of both."""
    both = toolkit.merged([aln.filter(F.col("sample") == s).select("seq", "ref_id", "pos") for s in "tn"])
    return ordered.running(both, toolkit.by_position(), {}, "place")


@query("sort_by_tag", "SELECT seq, nm, rank() OVER (ORDER BY nm DESC, seq) AS place FROM aln")
def sort_by_tag(aln: DataFrame) -> DataFrame:
    found = ordered.running(aln.select("seq", "tags"), toolkit.by_tag("NM", "i", descending=True), {}, "place")
    return found.select("seq", reads.tag(F.col("tags"), "NM", "i").alias("nm"), "place")


@query("sort_by_name", "SELECT seq, name, rank() OVER (ORDER BY name, seq) AS place FROM aln")
def sort_by_name(aln: DataFrame) -> DataFrame:
    return ordered.running(aln.select("seq", "name"), toolkit.by_name(), {}, "place")


@query(
    "split_reads",
    "SELECT CASE WHEN (flag & 4) = 0 THEN 'MAPPED' ELSE 'UNMAPPED' END AS by_map, CASE WHEN ref_id < 0 THEN 'unmapped' ELSE 'REF_' || ref_id END AS by_reference, "
    "'TAG_RG_' || rg AS by_tag, count(*) AS n FROM aln GROUP BY ALL",
)
def split_reads(aln: DataFrame) -> DataFrame:
    keys = [toolkit.split_key("mapped").alias("by_map"), toolkit.split_key("reference").alias("by_reference"), toolkit.split_key("tag", "RG").alias("by_tag")]
    return aln.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


@query("revert_reads", "SELECT seq, CASE WHEN ln = 1 THEN reverse(quals) ELSE quals END AS quals, flag & ~1024 AS flag, 2 AS n_tags FROM strings", BASES_SQL)
def revert_reads(aln: DataFrame) -> DataFrame:
    return toolkit.reverted(aln).select("seq", "quals", "flag", F.size("tags").alias("n_tags"))


@query("coverage", "SELECT ref_id, p AS pos, count(*) AS depth FROM offq GROUP BY ref_id, p")
def coverage(aln: DataFrame) -> DataFrame:
    return pileup.coverage(aln)


# Formats ------------------------------------------------------------------------------------


@query(
    "convert_bed",
    f"SELECT seq, concat_ws(chr(9), {NAMES_SQL}[ref_id + 1], pos, pos + span, name, mapq, CASE WHEN (flag & 16) <> 0 THEN '-' ELSE '+' END) AS line FROM aln WHERE ref_id >= 0",
)
def convert_bed(aln: DataFrame) -> DataFrame:
    return aln.filter("ref_id >= 0").select("seq", formats.bed(NAMES).alias("line"))


@query(
    "convert_fasta",
    "SELECT seq, '>' || name || chr(10) || CASE WHEN (flag & 16) <> 0 THEN reverse(translate(bases, 'ACGT', 'TGCA')) ELSE bases END AS line FROM strings",
    BASES_SQL,
)
def convert_fasta(aln: DataFrame) -> DataFrame:
    return aln.select("seq", formats.fasta().alias("line"))


@query(
    "convert_fastq",
    "SELECT seq, '@' || name || CASE WHEN (flag & 64) <> 0 THEN '/1' ELSE '/2' END || chr(10) || CASE WHEN (flag & 16) <> 0 THEN reverse(translate(bases, 'ACGT', 'TGCA')) "
    "ELSE bases END || chr(10) || '+' || chr(10) || CASE WHEN (flag & 16) <> 0 THEN reverse(quals) ELSE quals END AS line FROM strings",
    BASES_SQL,
)
def convert_fastq(aln: DataFrame) -> DataFrame:
    return aln.select("seq", formats.fastq().alias("line"))


@query(
    "convert_sam",
    f"SELECT seq, concat_ws(chr(9), name, flag, coalesce({NAMES_SQL}[CASE WHEN ref_id >= 0 THEN ref_id + 1 END], '*'), pos + 1, mapq, cigar, "
    f"CASE WHEN mate_ref_id = ref_id THEN '=' ELSE {NAMES_SQL}[mate_ref_id + 1] END, mate_pos + 1, insert_size, bases, quals, "
    "'NM:i:' || nm || CASE WHEN ln = 1 THEN chr(9) || 'OQ:Z:' || reverse(quals) ELSE '' END || chr(9) || 'RG:Z:' || rg) AS line FROM strings",
    BASES_SQL,
)
def convert_sam(aln: DataFrame) -> DataFrame:
    return aln.select("seq", formats.sam(NAMES).alias("line"))


@query(
    "convert_json",
    f"SELECT seq, replace(json_object('name', name, 'alignmentFlag', flag::VARCHAR, 'reference', CASE WHEN ref_id >= 0 THEN {NAMES_SQL}[ref_id + 1] END, 'position', pos + 1, 'mapQuality', mapq, 'cigar', cigar, "
    f"'mateReference', {NAMES_SQL}[mate_ref_id + 1], 'matePosition', mate_pos + 1, 'insertSize', insert_size, 'queryBases', bases, "
    "'qualities', list_transform(string_split(quals, ''), lambda c: ascii(c) - 33), 'tags', CASE WHEN ln = 1 THEN json_object('RG', rg, 'NM', nm::VARCHAR, 'OQ', reverse(quals)) "
    "ELSE json_object('RG', rg, 'NM', nm::VARCHAR) END)::VARCHAR, '\"reference\":null,', '') AS line FROM strings",
    BASES_SQL,
)
def convert_json(aln: DataFrame) -> DataFrame:
    return aln.select("seq", formats.json_line(NAMES).alias("line"))


_MATE_SQL = f"""'"mate":{{"reference":"' || {NAMES_SQL}[mate_ref_id + 1] || '","position":' || (mate_pos + 1) || ',"insertSize":' || insert_size || '}}'"""
_TAGS_SQL = """'"tags":{"RG":"' || rg || '","NM":' || nm || CASE WHEN ln = 1 THEN ',"OQ":' || to_json(reverse(quals))::VARCHAR ELSE '' END || '}'"""


@query(
    "convert_json_record",
    f"""SELECT seq, '{{' || concat_ws(',', '"name":"' || name || '"', '"alignmentFlag":"' || flag || '"', CASE WHEN ref_id >= 0 THEN '"reference":"' || {NAMES_SQL}[ref_id + 1] || '"' END, '"position":' || (pos + 1),
    '"mapQuality":' || mapq, '"cigar":["' || array_to_string(regexp_extract_all(cigar, '[0-9]+[A-Z]'), '","') || '"]', CASE WHEN (flag & 1) <> 0 THEN {_MATE_SQL} END, '"queryBases":"' || bases || '"',
    '"qualities":[' || array_to_string(list_transform(string_split(quals, ''), lambda c: ascii(c) - 33), ',') || ']', '"filename":"' || sample || '.bam"', {_TAGS_SQL}) || '}}' AS line FROM strings""",
    BASES_SQL,
)
def convert_json_record(aln: DataFrame) -> DataFrame:
    return aln.select("seq", formats.json_record(NAMES, F.concat("sample", F.lit(".bam"))).alias("line"))


@query(
    "convert_yaml",
    f"SELECT seq, concat('---', chr(10), '- Name: ', name, chr(10), '   AlignmentFlag: ', flag, chr(10), '   Reference: ', CASE WHEN ref_id >= 0 THEN {NAMES_SQL}[ref_id + 1] END, chr(10), "
    "'   Position: ', pos, chr(10), '   MapQuality: ', mapq, chr(10), "
    f"'   MateReference: ', {NAMES_SQL}[mate_ref_id + 1], chr(10), '   MatePosition: ', mate_pos, chr(10), '   InsertSize: ', insert_size, chr(10), "
    "'   Cigar: ', cigar, chr(10), '   QueryBases: ', bases, chr(10), '   Qualities: ', quals) AS line FROM strings",
    BASES_SQL,
)
def convert_yaml(aln: DataFrame) -> DataFrame:
    return aln.select("seq", formats.yaml(NAMES).alias("line"))


# Pileup -------------------------------------------------------------------------------------

_OF_BASE = ", ".join(
    f"count(*) FILTER (here AND b = {i}) AS n_{x}, coalesce(sum(bq) FILTER (here AND b = {i}), 0)::BIGINT AS bq_{x}, "
    f"coalesce(sum(mapq) FILTER (here AND b = {i}), 0)::BIGINT AS mq_{x}, coalesce(sum(dist) FILTER (here AND b = {i}), 0)::BIGINT AS dist_{x}, "
    f"count(*) FILTER (here AND b = {i} AND rev) AS rev_{x}, count(*) FILTER (here AND b = {i} AND ln IN (2, 3)) AS indel_{x}"
    for i, x in enumerate("ACGT")
)
_TOTALS = ", ".join(f"{k}_A + {k}_C + {k}_G + {k}_T AS {k}_all" for k in ("n", "bq", "mq", "dist", "rev"))
_ENTROPY = " - ".join(["0", *(f"CASE WHEN n_{x} > 0 THEN n_{x} / raw * ln(n_{x} / raw) ELSE 0 END" for x in "ACGT")])
PILEUP_SQL = f"""
good AS (
    SELECT *, (flag & 16) <> 0 AS rev, (flag & 1536) = 0 AS used, CASE WHEN (flag & 16) <> 0 THEN 50 - q - 1 ELSE q END AS dist,
        (flag & 1536) = 0 AND mapq >= 10 AND (gone OR bq >= 10) AS ok_here, (flag & 1536) = 0 AND mapq >= 10 AND NOT gone AND bq >= 10 AS here
    FROM cell
),
counted AS (
    SELECT sample, ref_id, p, {_OF_BASE}, count(*) FILTER (used) AS coverage, count(*) AS raw, count(*) FILTER (here AND b = 4) AS ambiguous,
        count(*) FILTER (ok_here AND ln = 2) AS ins, count(*) FILTER (ok_here AND ln = 3) AS dels
    FROM good GROUP BY sample, ref_id, p
),
totals AS (SELECT *, p + 1 AS pos, {_TOTALS}, {_ENTROPY} AS entropy, [n_A, n_C, n_G, n_T] AS ns FROM counted),
alleles AS (
    SELECT *, list_position(ns, list_max(ns)) - 1 AS major FROM totals WHERE n_all >= 4
),
pile AS (
    SELECT *, CASE WHEN list_max(others) > ns[(major + 1) % 4 + 1] THEN list_position(others, list_max(others)) - 1 ELSE (major + 1) % 4 END::INT AS minor
    FROM (SELECT *, list_transform(ns, lambda n, i: CASE WHEN i - 1 = major THEN -1 ELSE n END) AS others FROM alleles)
)"""
PILE_COLUMNS = [
    "sample", "ref_id", "pos", *[f"{k}_{x}" for x in (*"ACGT", "all") for k in ("n", "bq", "mq", "dist", "rev")], *[f"indel_{x}" for x in "ACGT"],
    "ambiguous", "ins", "dels", "coverage", "raw", "major", "minor",
]


@query("pileup_tuples", f"SELECT {', '.join(PILE_COLUMNS)}, round(entropy, 6) AS entropy FROM pile", PILEUP_SQL)
def pileup_tuples(aln: DataFrame) -> DataFrame:
    return pileup.pileup(aln).select(*PILE_COLUMNS, rounded("entropy").alias("entropy"))


@query(
    "convert_pileup",
    """, marks AS (
        SELECT ref_id, p, seq, (flag & 16) <> 0 AS rev, CASE WHEN o = 0 THEN '^' || chr(33 + mapq) ELSE '' END AS head, CASE WHEN o = span - 1 THEN '$' ELSE '' END AS tail, gone,
            substr('ACGTN', b::INT + 1, 1) AS base, substr('ACGT', rb::INT + 1, 1) AS ref, chr((33 + bq)::INT) AS bqc,
            CASE WHEN ln = 2 AND o = 19 THEN '+1' || substr('ACGT', ((ok + ln + 20) % 4)::INT + 1, 1) WHEN ln = 3 AND o = 24 THEN '-2NN' ELSE '' END AS indel
        FROM cell
    ),
    said AS (
        SELECT *, head || CASE WHEN gone THEN '*' ELSE CASE WHEN base = ref THEN CASE WHEN rev THEN ',' ELSE '.' END WHEN rev THEN lower(base) ELSE base END
            || CASE WHEN rev THEN lower(indel) ELSE indel END END || tail AS text FROM marks
    )
    SELECT ref_id, p + 1 AS pos, any_value(ref) AS ref, count(*) AS depth, string_agg(text, '' ORDER BY seq, text, bqc) AS text FROM said GROUP BY ref_id, p""".lstrip(", "),
)
def convert_pileup(aln: DataFrame) -> DataFrame:
    return formats.pileup_text(aln, derived.reference_bytes).select("ref_id", "pos", "ref", "depth", "text")


@query("mean_coverage", "SELECT sample, round(sum(coverage) / count(*), 6) AS mean, count(*) AS places FROM pile GROUP BY sample", PILEUP_SQL)
def mean_coverage(aln: DataFrame) -> DataFrame:
    """The mean depth of counted places before quality, by sample."""
    piles = pileup.pileup(aln)
    return piles.groupBy("sample").agg(rounded(F.sum("coverage") / F.count(F.lit(1))).alias("mean"), F.count(F.lit(1)).alias("places"))
