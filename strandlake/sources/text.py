"""Text sources and sinks: FASTA, headers, positions, manifests, training files, VCF, feature tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The kinds of header lines, with what each must have; what each should have; the forms of values; fields that no two lines share.
HEADER_KEYS = {"HD": [], "SQ": ["SN", "LN"], "RG": ["ID"], "PG": ["ID"], "CO": []}
HEADER_WISHES = {"HD": ["VN", "SO"]}
HEADER_VALUES = [
    ("HD", "VN", r"^[0-9]+\.[0-9]+$"),
    ("HD", "SO", "^(coordinate|queryname|unsorted)$"),
    ("HD", "GO", "^(none|query|reference)$"),
    ("SQ", "SN", "^[^=*]"),
    ("RG", "PL", "(?i)^(capillary|helicos|illumina|iontorrent|ls454|pacbio|solid)$"),
]
HEADER_UNIQUE = ["SQ SN", "RG ID", "RG PU", "PG ID"]
LONGEST_SEQUENCE = (1 << 29) - 1
VCF_COLUMNS = ["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT"]


def fasta_lines(spark: SparkSession, path: str) -> DataFrame:
    """ref_id, at, size, offset, bytes, value of each line of a FASTA file, in any order of rows.

    at is the number of the sequence's bases before the line, size that of the line's own; offset is
    the line's first byte and bytes their number, with the line's end. A line with a name has at -1 and size 0. Lines before the first name go.
    Files of a folder are one file, in the order of their names. A sequence is never brought together: sums run
    over the lines of each split, and only one row of each split is ordered among all.
    """
    block = ["file", "block"]
    source = spark.read.option("lineSep", "\n").text(path)
    lines = source.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    named = F.col("value").startswith(">")
    lines = lines.withColumns({"named": named, "bytes": F.octet_length("value").cast("long") + 1, "size": F.when(named, 0).otherwise(F.length(F.regexp_replace("value", r"\s+", ""))).cast("long")})
    upto = Window.partitionBy(*block).orderBy("n")
    prior = lambda c: F.coalesce(F.sum(c).over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lines = lines.withColumns({"names": F.count_if("named").over(upto), "bases_before": prior("size"), "bytes_before": prior("bytes")})
    lines = lines.withColumn("from", F.max(F.when(F.col("named"), F.col("bases_before"))).over(upto))

    sums = lines.groupBy(*block).agg(F.count_if("named").alias("b_names"), F.sum("size").alias("b_bases"), F.sum("bytes").alias("b_bytes"), F.max("from").alias("b_from"))
    earlier = Window.orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    starts = sums.select(*block, "b_from", before("b_names").alias("b_names"), before("b_bases").alias("b_bases"), before("b_bytes").alias("b_bytes"))
    starts = starts.withColumn("b_open", F.max(F.col("b_bases") + F.col("b_from")).over(earlier)).drop("b_from")

    met = lines.join(starts, block)
    began = F.coalesce(F.col("b_bases") + F.col("from"), F.col("b_open"))
    at = F.when(F.col("named"), -1).otherwise(F.col("b_bases") + F.col("bases_before") - began)
    ref_id = (F.col("b_names") + F.col("names") - 1).cast("int")
    return met.select(ref_id.alias("ref_id"), at.alias("at"), "size", (F.col("b_bytes") + F.col("bytes_before")).alias("offset"), "bytes", "value").filter("ref_id >= 0")


def fasta_index(spark: SparkSession, path: str) -> DataFrame:
    """name, length, offset of the first base, bases and bytes of a line, as an index file has them; and ref_id.

    The first line's numbers are taken for all of a sequence's lines. A sequence without lines has 0 in them.
    """
    return _indexed(fasta_lines(spark, path))


def _indexed(lines: DataFrame) -> DataFrame:
    named, first = F.col("at") < 0, F.struct("at", "offset", "size", "bytes")
    name = F.max(F.when(named, F.regexp_extract("value", r"^>\s*([^\s]+)", 1)))
    after = F.max(F.when(named, F.col("offset") + F.col("bytes")))
    each = lines.groupBy("ref_id").agg(name.alias("name"), F.sum("size").alias("length"), after.alias("offset"), F.min(F.when(~named, first)).alias("line"))
    line = lambda c: F.coalesce(F.col(f"line.{c}"), F.lit(0))
    return each.select("name", "length", "offset", line("size").alias("line_bases"), line("bytes").alias("line_bytes"), "ref_id")


def fasta_chunks(spark: SparkSession, path: str, chunk: int = 4096, margin: int = 512) -> DataFrame:
    """ref_id, chunk, bases, offset, size of all sequences, as `chunks` makes them, straight from the lines of a file.

    No row is larger than a chunk or a line, however long a sequence is.
    """
    lines = fasta_lines(spark, path)
    sizes = _indexed(lines).select("ref_id", F.col("length").alias("size"))
    held = lines.filter("size > 0").select("ref_id", "at", "size", F.regexp_replace("value", r"\s+", "").alias("own"))
    first = F.floor(F.greatest(F.col("at") - margin, F.lit(0)) / chunk)
    each = held.withColumn("chunk", F.explode(F.sequence(first, F.floor((F.col("at") + F.col("size") - 1 + margin) / chunk))))
    low = F.greatest(F.col("at"), F.col("chunk") * chunk - margin)
    high = F.least(F.col("at") + F.col("size"), (F.col("chunk") + 1) * chunk + margin)
    part = F.substring(F.col("own"), (low - F.col("at") + 1).cast("int"), (high - low).cast("int"))
    cut = each.filter(high > low).select("ref_id", F.col("chunk").cast("int").alias("chunk"), F.struct(low.alias("at"), part.alias("own")).alias("part"))
    whole = cut.groupBy("ref_id", "chunk").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    bases = F.array_join(F.col("parts.own"), "")
    offset = F.greatest(F.col("chunk") * chunk - margin, F.lit(0))
    return whole.join(sizes, "ref_id").filter(F.col("chunk") * chunk < F.col("size")).select("ref_id", "chunk", bases.alias("bases"), offset.alias("offset"), F.col("size").cast("int").alias("size"))


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """ref_id, name, bases of each sequence, for short ones: a sequence is one row. `fasta_chunks` reads long ones."""
    lines = fasta_lines(spark, path)
    parts = lines.filter("size > 0").groupBy("ref_id").agg(F.array_sort(F.collect_list(F.struct("at", F.regexp_replace("value", r"\s+", "").alias("own")))).alias("parts"))
    return _indexed(lines).join(parts, "ref_id", "left").select("ref_id", "name", F.coalesce(F.array_join("parts.own", ""), F.lit("")).alias("bases"))


def chunks(sequences: DataFrame, chunk: int = 4096, margin: int = 512) -> DataFrame:
    """ref_id, chunk, bases, offset, size: pieces with margins on both sides, from ref_id and bases."""
    size = F.length("bases")
    each = sequences.withColumn("size", size).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / chunk).cast("int"))))
    first = F.greatest(F.col("chunk") * chunk - margin, F.lit(0))
    last = F.least((F.col("chunk") + 1) * chunk + margin, F.col("size"))
    return each.select("ref_id", "chunk", F.substring(F.col("bases"), first + 1, last - first).alias("bases"), first.alias("offset"), "size")


def header(spark: SparkSession, path: str) -> DataFrame:
    """n, kind, fields (a map) and text of each header line."""
    lines = spark.read.text(path).filter(F.col("value").startswith("@")).withColumn("n", F.monotonically_increasing_id())
    parts = F.slice(F.split("value", "\t"), F.lit(2), F.size(F.split("value", "\t")))
    pairs = F.filter(F.transform(parts, lambda p: F.struct(F.substring(p, 1, 2).alias("key"), F.substring(p, F.lit(4), F.length(p)).alias("value"))), lambda p: F.length(p["key"]) == 2)
    kind = F.substring("value", 2, 2)
    fields = F.when(kind != "CO", F.map_from_entries(F.array_distinct(pairs))).otherwise(F.create_map().cast("map<string,string>"))
    return lines.select("n", kind.alias("kind"), fields.alias("fields"), F.col("value").alias("text"))


def header_faults(lines: DataFrame) -> DataFrame:
    """text, fault and level (error or warning) of header lines.

    Each line by itself: its kind, the fields that it must have or should have, and the values of fields. Over all lines: names,
    groups, platform units and programs given twice (the first line of each is named), and programs whose previous one is not there.
    """
    by_kind = lambda fixed: F.try_element_at(F.create_map(*[x for k, v in fixed.items() for x in (F.lit(k), F.array(*[F.lit(n) for n in v]).cast("array<string>"))]), F.col("kind"))
    value = lambda key: F.nullif(F.try_element_at(F.col("fields"), F.lit(key)), F.lit(""))
    lacking = lambda need: F.filter(need, lambda n: F.coalesce(F.try_element_at(F.col("fields"), n), F.lit("")) == "")
    fault = lambda test, text, level="error": F.when(test, F.struct(text.alias("fault"), F.lit(level).alias("level")))
    need, wish = by_kind(HEADER_KEYS), by_kind(HEADER_WISHES)
    found = [
        fault(need.isNull(), F.lit("unknown kind")),
        fault(F.size(lacking(need)) > 0, F.concat(F.lit("lacks "), F.array_join(lacking(need), ","))),
        fault(F.size(lacking(wish)) > 0, F.concat(F.lit("should have "), F.array_join(lacking(wish), ",")), "warning"),
    ]
    for kind, key, pattern in HEADER_VALUES:
        found.append(fault((F.col("kind") == kind) & ~value(key).rlike(pattern), F.concat(F.lit(f"bad {key}: "), value(key))))
    length = value("LN").try_cast("long")
    found.append(fault((F.col("kind") == "SQ") & value("LN").isNotNull() & ~F.coalesce(length.between(1, LONGEST_SEQUENCE), F.lit(False)), F.concat(F.lit("bad LN: "), value("LN"))))
    single = lines.select("text", F.explode(F.array_compact(F.array(*found))).alias("f")).select("text", "f.fault", "f.level")

    pairs = lines.filter("kind != 'CO'").select("n", "text", "kind", F.explode("fields").alias("key", "value")).filter("value != ''")
    unique = F.concat("kind", F.lit(" "), "key").isin(*HEADER_UNIQUE)
    repeated = pairs.filter(unique).groupBy("kind", "key", "value").agg(F.count(F.lit(1)).alias("times"), F.min_by("text", "n").alias("text"))
    repeated = repeated.filter("times > 1").select("text", F.concat(F.lit("repeated "), "key", F.lit(": "), "value").alias("fault"), F.lit("error").alias("level"))
    programs = pairs.filter("kind = 'PG' and key = 'ID'").select("value")
    orphans = pairs.filter("kind = 'PG' and key = 'PP'").join(programs, "value", "left_anti").select("text", F.concat(F.lit("unknown PP: "), "value").alias("fault"), F.lit("error").alias("level"))
    return single.unionByName(repeated).unionByName(orphans)


def merged_header(lines: list[DataFrame]) -> DataFrame:
    """The first header's lines, with the read groups of the others that it does not have."""
    first, groups = lines[0], lines[0].filter("kind = 'RG'").select(F.col("fields")["ID"].alias("id"))
    more = None
    for other in lines[1:]:
        new = other.filter("kind = 'RG'").withColumn("id", F.col("fields")["ID"])
        more = new if more is None else more.unionByName(new)
    if more is None:
        return first
    return first.unionByName(more.join(groups, "id", "left_anti").dropDuplicates(["id"]).drop("id"))


def positions(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start, stop of lines chr, chr:start or chr:start-stop; what is no number leaves the whole chromosome."""
    lines = spark.read.text(path).select(F.trim("value").alias("v")).filter("v != ''")
    bounds = r"^[^:]+:([0-9]+)(?:-([0-9]+))?$"
    number = lambda i: F.nullif(F.regexp_extract("v", bounds, i), F.lit("")).cast("long")
    return lines.select(F.regexp_extract("v", r"^([^:]+)", 1).alias("chrom"), number(1).alias("start"), F.coalesce(number(2), number(1)).alias("stop"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start, stop of a table of regions, with or without a first line of names; an empty region is an error."""
    rows = spark.read.option("sep", "\t").schema("chrom string, a string, b string").csv(path).filter("chrom != 'chrom'")
    rows = rows.select("chrom", F.col("a").cast("long").alias("start"), F.col("b").cast("long").alias("stop"))
    wrong = F.raise_error(F.lit("a region's end must be greater than its start")).cast("long")
    return rows.withColumn("stop", F.when(F.col("stop") > F.col("start"), F.col("stop")).otherwise(wrong))


def training(spark: SparkSession, path: str) -> DataFrame:
    """tumour, normal, reference, manifest, chrom, pos, label of training files.

    Lines `# key value` hold for their whole file, the last one of a key; rows without
    a label are left out.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("n"))
    keyed = lines.filter(F.col("value").startswith("#")).select("file", "n", F.split(F.trim(F.regexp_replace("value", "^#", "")), r"\s+").alias("p"))
    names = ["tumour", "normal", "reference", "manifest"]
    heads = keyed.groupBy("file").agg(*[F.max_by(F.get("p", F.lit(1)), F.when(F.get("p", F.lit(0)) == k, F.col("n"))).alias(k) for k in names])
    rows = lines.filter(~F.col("value").startswith("#")).select("file", F.split(F.trim("value"), r"\s+").alias("p")).filter(F.size("p") >= 3)
    values = [F.get("p", F.lit(0)).alias("chrom"), F.get("p", F.lit(1)).cast("long").alias("pos"), F.get("p", F.lit(2)).alias("label")]
    return rows.join(heads, "file", "left").select(*names, *values)


def vcf_header(samples: list[str], meta: dict[str, str] | None = None) -> list[str]:
    more = [f"##{k}={v}" for k, v in (meta or {}).items()]
    return ["##fileformat=VCFv4.1", *more, "\t".join([*VCF_COLUMNS, *samples])]


def write_vcf(rows: DataFrame, path: str, samples: list[str], meta: dict[str, str] | None = None) -> None:
    """Rows (ref_id, pos, line) in order, in parts; the first part begins with the header."""
    spark = rows.sparkSession
    head = spark.createDataFrame([(-1, i, line) for i, line in enumerate(vcf_header(samples, meta))], "ref_id int, pos int, line string")
    both = head.unionByName(rows.select(F.col("ref_id").cast("int"), F.col("pos").cast("int"), "line"))
    both.repartitionByRange("ref_id", "pos").sortWithinPartitions("ref_id", "pos").select("line").write.text(path)


def write_features(frame: DataFrame, path: str, key: list[Column], columns: list[str]) -> DataFrame:
    """Key and feature values as tab-separated text; gives back the frame, so that what follows goes on from it."""
    frame.select(F.concat_ws(";", *key).alias("key"), *columns).write.option("sep", "\t").option("header", True).csv(path)
    return frame
