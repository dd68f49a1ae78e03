"""Golden values of pileups and genotypes, filter tokens, target planning, sources, streams."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from strandlake.functions import likelihood, reads, sequence
from strandlake.operators import evaluate, formats, models, pileup, regions, resolve, toolkit
from strandlake.plans import derived
from strandlake.sources import bam, text
from strandlake.streaming import pileup as stream


def one(df):
    return df.first().asDict()


#: Base counts, raw depth, major, minor, entropy.
TUPLES = [
    ((0, 0, 17, 0), 17, 2, 3, 0.0),
    ((1, 0, 23, 0), 25, 2, 0, 0.20546611321865493),
    ((10, 0, 1, 0), 11, 0, 2, 0.30463609734923813),
    ((20, 0, 0, 0), 22, 0, 1, 0.08664561800393172),
    ((0, 9, 0, 0), 9, 1, 2, 0.0),
    ((1, 5, 0, 0), 6, 1, 0, 0.45056120886630463),
    ((0, 0, 0, 33), 35, 3, 0, 0.055478185735908694),
    ((0, 0, 0, 51), 53, 3, 0, 0.03701472306070941),
]


def test_finishing(spark):
    names = [f"{k}_{b}" for b in "ACGT" for k in ("n", "bq", "mq", "dist", "rev")]
    rows = [[i, *[c if k == 0 else 0 for c in counts for k in range(5)], raw] for i, (counts, raw, *_) in enumerate(TUPLES)]
    counted = spark.createDataFrame(rows, ["p", *names, "raw"])
    got = {r["p"]: r for r in pileup.finished(counted, 4).collect()}
    for i, (_, _, major, minor, entropy) in enumerate(TUPLES):
        assert (got[i]["major"], got[i]["minor"]) == (major, minor) and got[i]["entropy"] == pytest.approx(entropy, abs=1e-12)


def test_genotypes(spark):
    rows = [(2, 17, "0/0", "0,10,255"), (4, 16, "0/1", "32,0,255"), (2, 26, "0/0", "0,36,255")]
    df = spark.createDataFrame(rows, "alt int, depth int, gt string, pl string")
    choose = likelihood.log_choose(F.col("alt"), F.col("depth"))
    shares = likelihood.genotype_shares(likelihood.genotype_likelihoods(F.col("alt"), F.col("depth"), "n", choose))
    pl = F.array_join(F.transform(shares, lambda s: likelihood.phred_likelihood(s).cast("string")), ",")
    for r in df.select("gt", "pl", likelihood.genotype(shares).alias("g"), pl.alias("p")).collect():
        assert (r["g"], r["p"]) == (r["gt"], r["pl"])


def test_log_factorial(spark):
    import math

    got = spark.range(0, 3000, 7).select("id", likelihood.log_factorial(F.col("id")).alias("f")).collect()
    assert all(r["f"] == pytest.approx(math.lgamma(r["id"] + 1), rel=1e-13, abs=1e-12) for r in got)


@pytest.mark.parametrize(
    ("token", "value", "holds"),
    [("ab", "ab", True), ("!ab", "ab", False), ("*b", "abab", True), ("a*", "abab", True), ("*ba*", "abab", True), ("*", "x", False), ("!a", "b", True), (">a", "b", True)],
)
def test_tokens(spark, token, value, holds):
    assert one(spark.range(1).select(toolkit.compared(F.lit(value), token, False).alias("t")))["t"] is holds


@pytest.mark.parametrize(("token", "value", "holds"), [("5", 5, True), ("!5", 5, False), (">=5", 5, True), ("<5", 5, False), ("<=4", 5, False), (">4", 5, True)])
def test_number_tokens(spark, token, value, holds):
    assert one(spark.range(1).select(toolkit.compared(F.lit(value), token, True).alias("t")))["t"] is holds


def test_rules(spark):
    rng = random.Random(2)
    names = ["a", "b", "c"]
    df = spark.createDataFrame([(bool(i & 1), bool(i & 2), bool(i & 4)) for i in range(8)], names)

    def make(depth):
        kind = rng.random()
        if depth == 0 or kind < 0.3:
            return rng.choice(names)
        if kind < 0.5:
            return f"!{make(depth - 1)}" if rng.random() < 0.5 else f"!({make(depth - 1)})"
        return f"({make(depth - 1)} {rng.choice('&|')} {make(depth - 1)})"

    for _ in range(20):
        rule = make(3)
        python = rule.replace("!", " not ").replace("&", " and ").replace("|", " or ")
        got = df.select(*names, toolkit.rule_column(rule, {n: F.col(n) for n in names}).alias("t")).collect()
        assert all(r["t"] == eval(python, {}, {n: r[n] for n in names}) for r in got), rule
    with pytest.raises(ValueError):
        toolkit.rule_column("(a & b", {n: F.col(n) for n in names})


def test_regions_text():
    assert toolkit.parse_region("chr1") == ("chr1", 0, "chr1", None)
    assert toolkit.parse_region("chr1:5") == ("chr1", 5, "chr1", None)
    assert toolkit.parse_region("chr1:5..9") == ("chr1", 5, "chr1", 9)
    assert toolkit.parse_region("chr1:5..chr2:9") == ("chr1", 5, "chr2", 9)
    assert regions.parse_position("1:5-9") == ("1", 5, 9) and regions.parse_position("1:x") == ("1", None, None)


P = ["1:1-20000", "1:21000-30000", "3:1-1000", "5:500-2000", "10:1-20000"]
M = ["1:1-90", "1:92-130", "1:500-650", "6:6000-6500", "1:179076833-179076890"]
PLANS = [
    ("1", P, None, ["1:1-20000", "1:21000-30000"]),
    ("1:1-1000", P, None, ["1:1-1000"]),
    ("1", P, M, ["1:1-90", "1:92-130", "1:500-650"]),
    ("1:1-100", P, M, ["1:1-90", "1:92-100"]),
    ("1", None, M, ["1:1-90", "1:92-130", "1:500-650", "1:179076833-179076890"]),
    ("1:1-100", None, M, ["1:1-90", "1:92-100"]),
    (None, None, None, ["1", "2"]),
    ("1", None, None, ["1"]),
    ("11", P, None, []),
    (None, ["1:1000", "4:2-1000"], ["1:1-2000"], ["1:1000-1000"]),
]


@pytest.mark.parametrize(("interval", "positions", "manifest", "want"), PLANS)
def test_plans(spark, interval, positions, manifest, want):
    table = lambda texts: None if texts is None else regions.position_table(spark, texts)
    got = regions.plan(table(positions), interval, table(manifest), spark.createDataFrame([("1",), ("2",)], "chrom string"))
    said = sorted(r["chrom"] if r["start"] is None else f"{r['chrom']}:{r['start']}-{r['stop']}" for r in got.collect())
    assert said == sorted(want)


def test_flanks_in_two_regions_fail(spark):
    with pytest.raises(Exception, match="several regions"):
        regions.flanks(regions.position_table(spark, ["1:5"]), regions.position_table(spark, ["1:1-9", "1:2-9"])).collect()


def test_homopolymers(spark):
    seq = "ACCCGTTTTA"
    df = spark.createDataFrame([(i, seq, 0, None) for i in range(1, 11)], "pos int, seq string, seq_at int, runs array<struct<run_start:long,run_end:long>>")
    got = {r["pos"]: (r["f"], r["b"]) for r in df.select("pos", sequence.homopolymer_forward(F.col("pos")).alias("f"), sequence.homopolymer_backward(F.col("pos")).alias("b")).collect()}
    assert got[1] == (2, 0) and got[5] == (3, 1) and got[10][1] == 3 and got[4] == (0, 0)


def test_long_homopolymers(spark):
    """Runs of any length over several chunks, at the ends and on borders, against a plain count."""
    rng = random.Random(7)
    some = lambda n: "".join(rng.choices("ACGT", k=n))
    seqs = ["A" * 300 + some(3000) + "c" * 5000 + "C" * 5000 + some(500) + "G" * 199 + some(40) + "T" * 256 + some(900) + "G" * 700, some(4096 - 210) + "A" * 210 + "A" * 4096 + "T" + "G" * 4095 + "G" * 3 + some(9), "T" * 10_000]
    table = spark.createDataFrame(list(enumerate(seqs)), "ref_id int, bases string")
    chunks = sequence.with_runs(text.chunks(table, sequence.CHUNK, sequence.MARGIN))
    runs = sequence.long_runs(text.chunks(table, sequence.CHUNK, sequence.MARGIN))
    want = []
    for ref, seq in enumerate(seqs):
        start = 0
        for i in range(1, len(seq) + 1):
            if i == len(seq) or seq[i].upper() != seq[start].upper():
                if i - start >= sequence.LONG_RUN:
                    want.append((ref, start, i))
                start = i
    assert sorted(tuple(r) for r in runs.select("ref_id", "run_start", "run_end").collect()) == want
    places = [(ref, p) for ref, seq in enumerate(seqs) for p in sorted({*range(1, 6), *rng.sample(range(1, len(seq)), 150), *(x + d for _, a, b in [w for w in want if w[0] == ref] for x in (a, b) for d in (-1, 0, 1, 2))}) if 1 <= p < len(seq)]
    keyed = spark.createDataFrame(places, "ref_id int, pos long").withColumn("at", F.col("pos") - 1)
    held = sequence.with_chunk(keyed, chunks, "at")
    got = {(r["ref_id"], r["pos"]): (r["f"], r["b"]) for r in held.select("ref_id", "pos", sequence.homopolymer_forward(F.col("pos")).alias("f"), sequence.homopolymer_backward(F.col("pos")).alias("b")).collect()}
    assert len(got) == len(set(places))
    for (ref, pos), found in got.items():
        seq = seqs[ref].upper()
        f = 0
        while pos + f + 1 < len(seq) and seq[pos + f + 1] == seq[pos]:
            f += 1
        b = 0
        while pos >= 3 and pos - 2 - b - 1 >= 2 and seq[pos - 2 - b - 1] == seq[pos - 2]:
            b += 1
        assert found == (f, b), (ref, pos)


CIGAR = [("S", 2), ("M", 4), ("I", 1), ("M", 2), ("D", 2), ("N", 3), ("M", 1), ("H", 2)]


def test_cigars(spark):
    df = spark.createDataFrame([(10, [*CIGAR], "ACGTACGTAC")], "pos int, cigar array<struct<op:string,len:int>>, bases string")
    r = one(
        df.select(
            reads.end_position(F.col("pos"), F.col("cigar")).alias("end"), reads.end_position(F.col("pos"), F.col("cigar"), padded=True).alias("padded"),
            reads.aligned_bases(F.col("bases"), F.col("cigar")).alias("aligned"), reads.cigar_text(F.col("cigar")).alias("text"),
            reads.parse_cigar(reads.cigar_text(F.col("cigar"))).alias("parsed"), reads.soft_clips(F.col("pos"), F.col("cigar")).alias("clips"),
        )
    )
    assert (r["end"], r["padded"], r["text"]) == (22, 23, "2S4M1I2M2D3N1M2H")
    assert r["aligned"] == "GTACGTA--NNNC" and [tuple(c) for c in r["parsed"]] == CIGAR
    assert [(c["size"], c["read_at"], c["pos"]) for c in r["clips"]] == [(2, 2, 10)]


def test_tags(spark):
    df = spark.range(1).select(F.create_map().cast("map<string,struct<type:string,i:bigint,f:double,s:string>>").alias("tags"))
    more = df.select(reads.with_tag(reads.with_tag(F.col("tags"), "NM", "i", i=F.lit(3)), "RG", "Z", s=F.lit("x")).alias("tags"))
    assert one(more.select(reads.tag(F.col("tags"), "NM", "i").alias("n"), reads.tag(reads.without_tag(F.col("tags"), "RG"), "RG", "s").alias("r"))) == {"n": 3, "r": None}


HEADER = "@HD\tVN:1.6\tSO:unsorted\n@SQ\tSN:chr1\tLN:1000\n@SQ\tSN:chr2\tLN:500\n@RG\tID:a\n"


def test_bam_round_trip(spark, tmp_path):
    spark.dataSource.register(bam.BamSource)
    tag = lambda kind, i=None, f=None, s=None: (kind, i, f, s)
    rows = [
        ("r1", 99, 0, 5, 60, [("M", 4)], 0, 90, 120, "ACGT", "IIII", {"NM": tag("C", i=3), "RG": tag("Z", s="a"), "XF": tag("f", f=0.5), "XB": tag("B", s="s,1,-2")}),
        ("r2", 4, -1, -1, 0, [], -1, -1, 0, "ACN", "", {}),
        ("r3", 16, 1, 400, 7, [("S", 1), ("M", 2)], -1, -1, 0, "GGG", "!5I", {"XA": tag("A", s="q")}),
    ]
    df = spark.createDataFrame(rows * 2000, bam.SCHEMA)
    df.repartition(3).write.format("bam").mode("overwrite").option("header", HEADER).save(str(tmp_path / "out"))
    back = spark.read.format("bam").load(str(tmp_path / "out"))
    key = lambda r: json.dumps(r.asDict(recursive=True), sort_keys=True)
    assert sorted(map(key, back.collect())) == sorted(map(key, df.collect()))
    assert bam.read_header(str(next((tmp_path / "out").glob("*.bam"))))[1] == [("chr1", 1000), ("chr2", 500)]


def made_bam(spark, folder, n=1500, order="unsorted"):
    """A file of reads of very different sizes: some are longer than several blocks."""
    rng = random.Random(6)
    rows = []
    for i in range(n):
        size = rng.choice([0, 1, 7, 50, 50, 50, 151]) if i % 97 else 90_001
        bases = "".join(rng.choices("ACGTN", k=size))
        quals = "".join(chr(33 + rng.randrange(60)) for _ in range(size)) if rng.random() < 0.8 else ""
        tags = {"NM": ("i", i, None, None), "XS": ("Z", None, None, "x" * rng.randrange(30))} if i % 3 else {}
        ref = rng.choice([-1, 0, 0, 1])
        rows.append((f"read{i}", rng.randrange(2048), ref, -1 if ref < 0 else rng.randrange(1000), rng.randrange(256), [("M", size)] if size else [], rng.choice([-1, 0, 1]), i % 7 - 1, i - 50, bases, quals, tags))
    rows.sort(key=lambda r: (r[2] < 0, r[2], r[3]) if order == "coordinate" else r[0])
    spark.dataSource.register(bam.BamSource)
    head = HEADER.replace("SO:unsorted", f"SO:{order}")
    spark.createDataFrame(rows, bam.SCHEMA).coalesce(1).write.format("bam").mode("overwrite").option("header", head).save(str(folder))
    return rows


def plain_read(r):
    return json.dumps(r.asDict(recursive=True), sort_keys=True)


@pytest.mark.parametrize("split", [3000, 20_000, 65_536, 1 << 30])
def test_bam_splits(spark, tmp_path, split):
    """A file in many splits has the reads of the whole, each once, wherever records cross blocks."""
    rows = made_bam(spark, tmp_path / "out")
    back = bam.scan(spark, str(tmp_path / "out"), split_bytes=split)
    size = sum(f.stat().st_size for f in (tmp_path / "out").glob("*.bam"))
    assert back.rdd.getNumPartitions() == -(-size // split)
    assert sorted(map(plain_read, back.collect())) == sorted(map(plain_read, spark.createDataFrame(rows, bam.SCHEMA).collect()))


@pytest.mark.parametrize("order", ["unsorted", "coordinate"])
def test_bam_pushdown(spark, tmp_path, order):
    rows = made_bam(spark, tmp_path / "out", order=order)
    table = spark.createDataFrame(rows, bam.SCHEMA)
    for test in ("ref_id = 0 and pos < 300 and pos >= 100", "ref_id = 1 and pos <= 10", "ref_id < 1", "ref_id in (-1, 1) and mapq > 200", "flag = 4 or pos > 990", "name like 'read1%' and ref_id = 0 and pos = 5"):
        got = bam.scan(spark, str(tmp_path / "out"), ["pos", "name", "ref_id", "mapq", "flag"], 50_000).filter(test)
        assert sorted(map(plain_read, got.collect())) == sorted(map(plain_read, table.filter(test).select("pos", "name", "ref_id", "mapq", "flag").collect())), test
    plan = bam.scan(spark, str(tmp_path / "out"), ["pos", "ref_id"]).filter("ref_id = 0 and pos < 300")._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan and "Project [pos" in plan  # the scan has taken all filters


def test_bam_stops_early_in_sorted_files(spark, tmp_path):
    made_bam(spark, tmp_path / "out", order="coordinate")
    reader = bam.FilteringReader({"path": str(tmp_path / "out")}, ["pos"], {})
    reader.tests = [("ref_id", "==", 0), ("pos", "<", 100)]
    bam_together, bam.TOGETHER = bam.TOGETHER, 20
    try:
        read = sum(1 for _ in reader.read(reader.partitions()[0]))
        reader.tests = []
        assert read * 4 < sum(1 for _ in reader.read(reader.partitions()[0]))
    finally:
        bam.TOGETHER = bam_together


def test_bam_faults(spark, tmp_path):
    made_bam(spark, tmp_path / "out", n=300)
    path = next((tmp_path / "out").glob("*.bam"))
    data = path.read_bytes()
    for i, bad in enumerate([data[: len(data) // 2], data[:400] + bytes([data[400] ^ 255]) + data[401:], b"no blocks here"]):
        (tmp_path / f"{i}.bam").write_bytes(bad)
        with pytest.raises(Exception):  # noqa: B017
            bam.scan(spark, str(tmp_path / f"{i}.bam")).count()
    # A block head with another field before the size.
    body = data[:10] + b"\x0b\x00" + b"XX\x01\x00z" + data[12:16] + data[16:]
    assert bam.block_size(body) == bam.block_size(data)
    made_bam(spark, tmp_path / "two", n=5, order="coordinate")
    (tmp_path / "two" / "other.bam").write_bytes(data)
    with pytest.raises(Exception, match="sorted in different ways"):
        bam.scan(spark, str(tmp_path / "two")).count()
    with pytest.raises(Exception, match="no such columns"):
        bam.scan(spark, str(path), ["pos", "nothing"]).count()


def test_text_sources(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one first\nACGTA\nCG\n>two\nGGGTT\nT\n")
    got = [tuple(r) for r in text.fasta(spark, str(tmp_path / "a.fa")).orderBy("ref_id").collect()]
    assert got == [(0, "one", "ACGTACG"), (1, "two", "GGGTTT")]
    index = [tuple(r) for r in text.fasta_index(spark, str(tmp_path / "a.fa")).orderBy("offset").collect()]
    assert index == [("one", 7, 11, 5, 6, 0), ("two", 6, 25, 5, 6, 1)]
    (tmp_path / "p").write_text("1:1-20\n20:17\nchr2\n3:x\n")
    assert [tuple(r) for r in text.positions(spark, str(tmp_path / "p")).collect()] == [("1", 1, 20), ("20", 17, 17), ("chr2", None, None), ("3", None, None)]
    (tmp_path / "m").write_text("chrom\tbegin\tend\n1\t92\t130\n")
    assert [tuple(r) for r in text.manifest(spark, str(tmp_path / "m")).collect()] == [("1", 92, 130)]
    (tmp_path / "t").write_text("# tumour a.bam\n# normal b.bam\n1 100\tSOMATIC\n2 5\n")
    assert [(r["tumour"], r["normal"], r["pos"], r["label"]) for r in text.training(spark, str(tmp_path / "t")).collect()] == [("a.bam", "b.bam", 100, "SOMATIC")]
    (tmp_path / "h").write_text(HEADER + "@RG\tPU:x\n@SQ\tSN:chr1\tLN:9\n")
    faults = sorted(r["fault"] for r in text.header_faults(text.header(spark, str(tmp_path / "h"))).collect())
    assert faults == ["lacks ID", "repeated SN: chr1", *(["should have SO"] if "SO:" not in HEADER else [])]
    lines = text.header(spark, str(tmp_path / "h"))
    assert text.merged_header([lines.filter("n < 3"), lines.filter("n < 4")]).count() == 4


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_fasta_parts(spark, tmp_path, end):
    """Sequences over many splits and files: bases, places and offsets equal those of a plain walk."""
    rng = random.Random(4)
    made, sizes = {}, [0, 1, 59, 60, 61, 9000, 20_011, 7, 4096, 8192]
    for i, size in enumerate(sizes):
        made[f"s{i}"] = "".join(rng.choices("ACGTN", k=size))
    whole = end.join(x for n, b in made.items() for x in (f">{n} more words", *[b[k : k + 60] for k in range(0, len(b), 60)])) + end
    (tmp_path / "parts").mkdir()
    cut = whole.index(end, len(whole) // 3) + len(end)
    (tmp_path / "parts" / "a.fa").write_bytes(whole[:cut].encode())
    (tmp_path / "parts" / "b.fa").write_bytes(whole[cut:].encode())
    want, at = [], 0
    for i, (n, b) in enumerate(made.items()):
        at += len(f">{n} more words") + len(end)
        first = min(len(b), 60)
        want.append((n, len(b), at, first, first + len(end) if b else 0, i))
        at += len(b) + len(end) * -(-len(b) // 60)
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        path = str(tmp_path / "parts")
        assert spark.read.text(path).rdd.getNumPartitions() > 40
        assert [tuple(r) for r in text.fasta_index(spark, path).orderBy("ref_id").collect()] == want
        assert {r["name"]: r["bases"] for r in text.fasta(spark, path).collect()} == made
        got = text.fasta_chunks(spark, path, 1000, 128)
        frame = spark.createDataFrame([(i, b) for i, b in enumerate(made.values()) if b], "ref_id int, bases string")
        key = lambda df: sorted(tuple(r) for r in df.select("ref_id", "chunk", "bases", "offset", "size").collect())
        assert key(got) == key(text.chunks(frame, 1000, 128))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)


#: Lines, and the faults of each.
HEADERS = [
    (["@HD\tVN:1.6\tSO:coordinate\tGO:query", "@SQ\tSN:a\tLN:536870911", "@RG\tID:x\tPL:Illumina", "@RG\tID:y", "@PG\tID:p", "@PG\tID:q\tPP:p", "@CO\tSN: any"], []),
    (["@HD\tVN:16\tSO:unsorted"], ["bad VN: 16"]),
    (["@HD\tVN:1.x\tSO:unsorted"], ["bad VN: 1.x"]),
    (["@HD\tVN:.6\tSO:unsorted"], ["bad VN: .6"]),
    (["@HD\tVN:1.6"], ["should have SO"]),
    (["@HD\tGO:none"], ["should have VN,SO"]),
    (["@HD\tVN:1.6\tSO:unknown"], ["bad SO: unknown"]),
    (["@HD\tVN:1.6\tSO:unsorted\tGO:some"], ["bad GO: some"]),
    (["@SQ\tLN:9", "@SQ\tSN:\tLN:9"], ["lacks SN", "lacks SN"]),
    (["@SQ\tSN:=a\tLN:9", "@SQ\tSN:*\tLN:9"], ["bad SN: *", "bad SN: =a"]),
    (["@SQ\tSN:a", "@SQ\tSN:b\tLN:0", "@SQ\tSN:c\tLN:536870912", "@SQ\tSN:d\tLN:x"], ["bad LN: 0", "bad LN: 536870912", "bad LN: x", "lacks LN"]),
    (["@SQ\tSN:a\tLN:9", "@SQ\tSN:a\tLN:8"], ["repeated SN: a"]),
    (["@RG\tID:x\tPU:u", "@RG\tID:x\tPU:v", "@RG\tID:y\tPU:v"], ["repeated ID: x", "repeated PU: v"]),
    (["@RG\tPL:SOLID", "@RG\tID:z\tPL:abacus"], ["bad PL: abacus", "lacks ID"]),
    (["@PG\tID:p", "@PG\tID:p\tPP:q"], ["repeated ID: p", "unknown PP: q"]),
    (["@XX\tID:p"], ["unknown kind"]),
]


def test_header_rules(spark, tmp_path):
    for i, (lines, want) in enumerate(HEADERS):
        (tmp_path / f"h{i}").write_text("\n".join(lines) + "\n")
        found = text.header_faults(text.header(spark, str(tmp_path / f"h{i}"))).collect()
        assert sorted(r["fault"] for r in found) == want, lines
        assert {r["level"] for r in found} <= {"warning" if "should" in f else "error" for f in want}


def test_resolve_modes(spark, tmp_path):
    """Statistics go out and in without loss, and all modes mark alike."""
    aln = derived.alignments(spark, "/root/testdata/sf0.001").select("seq", "name", "flag", "ref_id", "pos", "mapq", "mate_ref_id", "mate_pos", "insert_size", "tags")
    resolve.make_statistics(aln, str(tmp_path / "r"), min_mapq=5)
    stats, options = resolve.read_statistics(spark, str(tmp_path / "r" / "statistics"))
    direct = resolve.group_statistics(resolve.candidate_pairs(resolve.with_group(aln), 5))
    rows = lambda df: sorted(str(sorted(r.asDict().items())) for r in df.collect())
    assert rows(stats) == rows(direct) and len(rows(stats)) == 4
    assert options["MinimumMapQuality"] == "5" and options["ConfidenceInterval"] == "0.9973"
    key = lambda df: sorted((r["seq"], r["flag"]) for r in df.select("seq", "flag").collect())
    want = key(resolve.marked(aln, 5))
    assert want == key(resolve.mark_pairs(aln, str(tmp_path / "r"))) == key(resolve.two_pass(aln, str(tmp_path / "t"), 5))
    (tmp_path / "odd").write_text("[Options]\nShoeSize=4\n")
    with pytest.raises(ValueError, match="ShoeSize"):
        resolve.read_statistics(spark, str(tmp_path / "odd"))


def test_vcf(spark, tmp_path):
    rows = spark.createDataFrame([(0, 9, "x"), (0, 3, "y")], "ref_id int, pos int, line string")
    text.write_vcf(rows, str(tmp_path / "v"), ["TUMOUR"])
    got = [r["value"] for r in spark.read.text(str(tmp_path / "v")).collect()]
    assert sorted(got) == sorted([*text.vcf_header(["TUMOUR"]), "x", "y"])


def test_fasta_lines(spark):
    df = spark.createDataFrame([("r", 0, "A" * 120), ("q", 16, "ACGTN")], "name string, flag int, bases string")
    got = [r["l"] for r in df.select(formats.fasta().alias("l")).collect()]
    assert got == [">r\n" + "A" * 50 + "\n" + "A" * 50 + "\n" + "A" * 20, ">q\nNACGT"]


def test_json_record(spark):
    schema = "name string, flag int, ref_id int, pos int, mapq int, cigar array<struct<op:string,len:int>>, mate_ref_id int, mate_pos int, insert_size int, bases string, quals string, tags map<string,struct<type:string,i:bigint,f:double,s:string>>"
    rows = [
        ('a"b', 1, 0, 4, 7, [("M", 2), ("S", 1)], 0, 9, -3, "ACG", '!"I', {"XA": ("A", None, None, "c"), "XF": ("f", None, 0.5, None), "NM": ("C", 3, None, None)}),
        ("bare", 4, -1, -1, 0, [], -1, -1, 0, "", "", {}),
        ("single", 0, 1, 0, 1, [("M", 1)], 1, 5, 0, "A", "", {}),
    ]
    got = [json.loads(r["line"]) for r in spark.createDataFrame(rows, schema).coalesce(1).select(formats.json_record(["x", "y"], F.lit("f.bam")).alias("line")).collect()]
    assert got == [
        {"name": 'a"b', "alignmentFlag": "1", "reference": "x", "position": 5, "mapQuality": 7, "cigar": ["2M", "1S"], "mate": {"reference": "x", "position": 10, "insertSize": -3},
         "queryBases": "ACG", "qualities": [0, 1, 40], "filename": "f.bam", "tags": {"XA": "c", "XF": 0.5, "NM": 3}},
        {"name": "bare", "alignmentFlag": "4", "position": 0, "mapQuality": 0, "filename": "f.bam"},
        {"name": "single", "alignmentFlag": "0", "reference": "y", "position": 1, "mapQuality": 1, "cigar": ["1M"], "queryBases": "A", "filename": "f.bam"},
    ]


def test_split_by_arrays(spark, tmp_path):
    df = spark.createDataFrame([(0, 0, 0, 0, {"XB": ("B", None, None, "i,1,2")})], "seq long, ref_id int, pos int, flag int, tags map<string,struct<type:string,i:bigint,f:double,s:string>>")
    with pytest.raises(Exception, match="holds an array"):
        toolkit.split(df, str(tmp_path / "s"), "tag", "XB")


def test_pileup_lines(spark):
    cells = [(0, 4, 1, "A", 40, 60, False, "A", True, False, ""), (0, 4, 2, "C", 30, 10, True, "A", False, True, "+2ac"), (0, 4, 3, None, None, 10, False, "A", False, False, "")]
    df = spark.createDataFrame(cells, "ref_id int, p int, seq int, base string, quality int, mapq int, reverse boolean, ref string, first boolean, last boolean, indel string")
    r = one(formats.pileup_lines(df, mapq=True))
    assert (r["pos"], r["depth"], r["text"], r["quals"], r["mapqs"]) == (5, 3, "^].c+2ac$*", "I?", "]++")


def test_evaluation(spark):
    rows = [(0.9, "TRUE"), (0.8, "FALSE"), (0.7, "TRUE"), (0.1, "FALSE")]
    scored = spark.createDataFrame(rows, "score double, label string")
    assert one(evaluate.area(evaluate.curve(scored)))["area"] == pytest.approx(0.75)
    assert [(r["score"], r["side"]) for r in evaluate.strict_lists(scored, 0.7).collect()] == [(0.9, "TP")]
    assert one(evaluate.rates(scored, 0.75))["tpr"] == 0.5


def test_models(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, float(i % 2), rng.random(), "SOMATIC" if i % 2 else "WILDTYPE") for i in range(200)]
    df = models.labelled(spark.createDataFrame(rows, "id int, x double, y double, label string"), ("SOMATIC",))
    model = models.forest(df, ["x", "y"], trees=5, depth=3)
    models.saved(model, str(tmp_path / "m"))
    got = models.scored(models.loaded(str(tmp_path / "m")), df).collect()
    assert all((r["probability"] > 0.5) == (r["target"] == 1) for r in got)
    assert models.importances(spark, model, 1).first()["feature"] == "x"
    assert models.selected(df, ["x", "y"], strength=0.05, always=("y",)) == ["x", "y"]
    assert models.cross_validated(df, ["x", "y"], ["id"], trees=3, depth=3).count() == 200
    with pytest.raises(ValueError):
        models.labelled(df, ("ODD",))


def test_stream(spark, tmp_path):
    schema = "ref_id int, pos int, flag int, cigar array<struct<op:string,len:int>>, at timestamp"
    batch = spark.createDataFrame([(0, 5, 0, [("M", 3)]), (0, 6, 0, [("M", 3)]), (0, 6, 4, [("M", 3)])], "ref_id int, pos int, flag int, cigar array<struct<op:string,len:int>>")
    batch.withColumn("at", F.current_timestamp()).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = stream.coverage_stream(source).writeStream.outputMode("complete").format("memory").queryName("depths").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(tuple(r) for r in spark.table("depths").collect()) == [(0, 5, 1), (0, 6, 2), (0, 7, 2), (0, 8, 1)]


def sorted_parts(spark, folder, parts=12, backwards=False):
    """Files of reads in the order of their places, each a batch of a stream, and a read after all; the reads as one frame."""
    aln = derived.alignments(spark, "/root/testdata/sf0.001").select("sample", "ref_id", "pos", "mapq", "cigar", "flag", "bases", "quals").filter("ref_id >= 0")
    rows = sorted(aln.collect(), key=lambda r: (r["ref_id"], r["pos"]))
    folder.mkdir()
    size = -(-len(rows) // parts)
    batches = [rows[i : i + size] for i in range(0, len(rows), size)]
    batches = (batches[::-1] if backwards else batches) + [[("t", 9, 0, 0, [("M", 1)], 0, "A", "!")]]
    for i, batch in enumerate(batches):
        one_file = folder.parent / f"{folder.name}{i}"
        spark.createDataFrame(batch, aln.schema).coalesce(1).write.parquet(str(one_file))
        made = next(one_file.glob("*.parquet"))
        os.utime(made, (1_000_000 + i, 1_000_000 + i))
        made.rename(folder / f"{i:03}.parquet")
    return spark.createDataFrame(rows, aln.schema)


def run_stream(spark, folder, schema, f, name):
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    q = f(source).writeStream.outputMode("append").format("memory").queryName(name).trigger(availableNow=True).start()
    stream.finished(q, 0.2)
    return spark.table(name), q


def test_closed_places(spark, tmp_path):
    """A sorted stream gives each place once, as the whole table does; most of them before the end."""
    aln = sorted_parts(spark, tmp_path / "in")
    got, q = run_stream(spark, tmp_path / "in", aln.schema, lambda s: stream.closed_depths(s, 100), "closed_depths")
    key = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*sorted(df.columns)).collect())
    assert key(got) == key(pileup.coverage(aln))
    assert sum(p.stateOperators[0].numRowsRemoved > 0 for p in q.recentProgress if p.stateOperators) > 6
    got, q = run_stream(spark, tmp_path / "in", aln.schema, lambda s: stream.closed_pileup(s, min_count=1, span=100), "closed_pileup")
    assert key(got) == key(pileup.pileup(aln, min_count=1))


def test_closed_places_ask_for_order(spark, tmp_path):
    aln = sorted_parts(spark, tmp_path / "in", parts=3, backwards=True)
    with pytest.raises(ValueError, match="not sorted"):
        run_stream(spark, tmp_path / "in", aln.schema, lambda s: stream.closed_depths(s, 100), "backwards")
    with pytest.raises(Exception, match="covers more than 20 places"):
        run_stream(spark, tmp_path / "in", aln.schema, lambda s: stream.closed_depths(s, 20), "long_reads")


def test_split_and_layout(spark, tmp_path):
    df = spark.createDataFrame([(i, i % 3 - 1, i, 1 if i % 2 else 5, {"RG": ("Z", None, None, f"g{i % 2}")}) for i in range(30)],
                               "seq long, ref_id int, pos int, flag int, tags map<string,struct<type:string,i:bigint,f:double,s:string>>")
    toolkit.split(df, str(tmp_path / "s"), "tag", "RG")
    assert {r["split"] for r in spark.read.parquet(str(tmp_path / "s")).select("split").distinct().collect()} == {"TAG_RG_g0", "TAG_RG_g1"}
    places = [(r["ref_id"], r["pos"]) for r in toolkit.index_layout(df, 2).collect()]
    assert places == sorted(places)


def test_random_reads(spark):
    rows = [(i, 0, i * 7000, 60) for i in range(20)] + [(100 + i, 1, 500_000 + i * 3, 60) for i in range(5)] + [(999, -1, -1, 0)]
    df = spark.createDataFrame(rows, "seq long, ref_id int, pos int, mapq int")
    lengths = spark.createDataFrame([(0, 140_000), (1, 600_000)], "ref_id int, length int")
    got = toolkit.random_reads(spark, df, lengths, 400, seed=3).collect()
    assert 250 < len(got) < 400 and {r["ref_id"] for r in got} == {0, 1}
    assert len({r["seq"] for r in got if r["ref_id"] == 0}) > 15
    assert sum(r["seq"] == 100 for r in got) > 100


def test_references_match(spark):
    a = spark.createDataFrame([("chr1", 0), ("chr2", 1)], "name string, ref_id int")
    b = spark.createDataFrame([("chr2", 0), ("chr3", 1)], "name string, ref_id int")
    assert one(regions.references_match(a, a)) == {"shared": 2, "same": True} and one(regions.references_match(a, b)) == {"shared": 1, "same": False}


@pytest.mark.parametrize("kind", ["deep_features", "deep_single_features"])
def test_background_of_all_places(spark, kind):
    """A background's mean is over all places of a region but the focal one, quiet ones too."""
    from strandlake.operators import caller
    from strandlake.plans import calling

    folder = "/root/testdata/sf0.001"
    paired = kind == "deep_features"
    piled = calling.pairs(spark, folder) if paired else calling.with_reference(caller.single(calling.piles(spark, folder)))
    shares = {}
    for r in piled.select("ref_id", "pos", "ref", *[f"t_n_{b}" for b in "ACGT"]).collect():
        n = list(r)[3:]
        other = max(x for i, x in enumerate(n) if i != r["ref"])
        total = other + n[r["ref"]]
        shares.setdefault((r["ref_id"], r["pos"] // 1000), {})[r["pos"]] = other / total if total else 0.0
    name = "t_background" if paired else "background"
    rows = calling.QUERIES[kind](spark, folder).select("ref_id", "pos", name).collect()
    assert rows
    for r in rows:
        others = [v for p, v in shares[r["ref_id"], r["pos"] // 1000].items() if p != r["pos"]]
        assert r[name] == pytest.approx(sum(others) / len(others) if others else 0, abs=2e-6)


def test_walk_of_a_long_read(spark):
    """A read of 20,000 bases and 5,000 operations has each base once, at its place."""
    from strandlake.functions import reads
    from strandlake.operators import pileup

    bases = "".join("ACGT"[i * 7 % 4] for i in range(20_000))
    row = [("".join(["7M1D1M1I"] * 1250 + ["8749M1I"]), bases, "I" * 20_000)]
    table = spark.createDataFrame(row, "c string, bases string, quals string").withColumn("cigar", reads.parse_cigar(F.col("c")))
    table = table.select(F.lit(0).alias("pos"), "cigar", F.col("bases").cast("binary").alias("bases"), F.col("quals").cast("binary").alias("quals"))
    cells = pileup.cells(table).orderBy("at", "q").select("at", "q", F.chr("code").alias("base"), "bq").collect()
    want, at, q = [], 0, 0
    for size, op in [(7, "M"), (1, "D"), (1, "M"), (1, "I")] * 1250 + [(8749, "M"), (1, "I")]:
        for i in range(size):
            if op != "I":
                want.append((at + i, None if op == "D" else q + i, None if op == "D" else bases[q + i], None if op == "D" else 40))
        at, q = at + size * (op != "I"), q + size * (op != "D")
    assert [tuple(c) for c in cells] == want


READS = "sample string, ref_id int, pos int, mapq int, c string, flag int, bases string, quals string"


def some_reads(spark, rows):
    from strandlake.functions import reads

    return spark.createDataFrame(rows, READS).withColumn("cigar", reads.parse_cigar(F.col("c"))).drop("c")


def test_hot_stretches_are_dealt(spark, monkeypatch):
    """A stretch with most of the reads, many of them equal, gives the same pileup when it is dealt over tasks."""
    rng = random.Random(4)
    rows = [("t", 0, 100, 30, "20M", 0, "ACGTACGTACGTACGTACGT", "I" * 20)] * 300
    rows += [("t", 0, rng.randrange(5000), 30, "5M1D5M", rng.choice([0, 16, 1024]), "ACGTACGTAC", "I" * 10) for _ in range(200)]
    table = some_reads(spark, rows)
    whole = sorted(map(tuple, pileup.pileup(table).collect()))
    monkeypatch.setattr(pileup, "HOT_READS", 16)
    dealt = pileup.by_stretch(table, 16)
    assert dealt.filter("stretch = 0").select("salt").distinct().count() > 8
    monkeypatch.setattr(pileup.by_stretch, "__defaults__", (16,))
    assert sorted(map(tuple, pileup.pileup(table).collect())) == whole


def test_region_pileup(spark):
    """Overlapping, repeated, empty and unbounded regions, and one over several bins, against a plain filter of the whole pileup."""
    rng = random.Random(5)
    rows = [("n", rng.randrange(2), rng.randrange(40_000), 30, rng.choice(["10M", "4M3D6M", "5M20000N5M", "2S8M", "3M2I5M"]), 0, "ACGTACGTAC", "I" * 10) for _ in range(3000)]
    rows += [("n", 0, 16380, 30, "10M", 0, "ACGTACGTAC", "I" * 10)] * 6
    table = some_reads(spark, rows)
    regions_ = [(1, 0, 16381, 16390, 50_000), (2, 0, 16385, 16385, 50_000), (3, 0, 100, 39_000, 50_000), (3, 0, 100, 39_000, 50_000), (4, 1, None, None, 50_000), (5, 1, 30, 20, 50_000), (6, 7, 1, 10, 50_000)]
    targets = spark.createDataFrame(regions_, "region_id int, ref_id int, start long, stop long, size long")
    got = pileup.region_pileup(table, targets, min_count=1)
    columns = [c for c in got.columns if c != "region_id"]
    whole = [r.asDict() for r in pileup.pileup(table, min_count=1).select(*columns).collect()]
    want = []
    for i, ref, start, stop, size in regions_:
        low, high = (start or 1) - 1, stop or size
        want += [(i, *[r[c] for c in columns]) for r in whole if r["ref_id"] == ref and low <= r["p"] < high]
    assert sorted(tuple(r[c] for c in ["region_id", *columns]) for r in got.collect()) == sorted(want)
    assert pileup.region_pileup(table, targets.limit(0)).count() == 0


def test_curve_keeps_close_scores(spark):
    """Scores that differ by less than any rounding are points of their own."""
    from strandlake.operators import evaluate

    rows = [(0.50000001, "SOMATIC"), (0.5, "WILDTYPE"), (0.49999999, "SOMATIC"), (0.2, "WILDTYPE")]
    points = evaluate.curve(spark.createDataFrame(rows, "score double, label string"))
    assert points.count() == 4
    assert evaluate.area(points).first()["area"] == pytest.approx(0.75)


def test_pairs_are_not_dealt_by_read_group(spark):
    """Statistics go to the reads: a read group, of which there are few, is never brought together in one task."""
    aln = derived.alignments(spark, "/root/testdata/sf0.001")
    plan = resolve.marked(aln)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=broadcast") >= 2


def test_batches_are_encoded_like_records(monkeypatch):
    """Reads of all kinds, in one batch: its bytes are those of its records; odd values are left to these."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(bam.SCHEMA))
    tag = lambda kind, i=None, f=None, s=None: {"type": kind, "i": i, "f": f, "s": s}
    rng = random.Random(3)
    rows = []
    for k in range(200):
        n = rng.choice([0, 1, 7, 50])
        cigar = [{"op": rng.choice(bam.OPS), "len": rng.randrange(0, 70_000)} for _ in range(rng.randrange(0, 4))]
        tags = [("NM", tag(rng.choice("cCsSiI"), i=rng.randrange(0, 100))), ("ZZ", tag("Z", s="x" * rng.randrange(0, 5))), ("AS", tag("f", f=0.5)), ("XA", tag("A", s="q"))]
        rng.shuffle(tags)
        rows.append({"name": rng.choice(["", None, f"read{k}"]), "flag": rng.randrange(0, 4096), "ref_id": rng.randrange(-1, 3), "pos": rng.choice([-1, 0, 5, 1 << 20]), "mapq": k, "cigar": cigar,
                     "mate_ref_id": -1, "mate_pos": -1, "insert_size": -k, "bases": "".join(rng.choice("ACGTNacgtRX=?") for _ in range(n)), "quals": rng.choice(["", "#" * n]), "tags": tags[: rng.randrange(0, 5)]})
    want = lambda rows: b"".join(bam.encode_record({**r, "tags": dict(r["tags"])}) for r in rows)
    with monkeypatch.context() as m:
        m.setattr(bam, "encode_record", None)
        got = bam.encode_batch(pa.RecordBatch.from_pylist(rows, schema))
        part = bam.encode_batch(pa.RecordBatch.from_pylist(rows, schema)[50:60])
    assert got == want(rows) and part == want(rows[50:60])
    rows[3]["tags"] = [("XB", tag("B", s="c,1,2"))]
    assert bam.encode_batch(pa.RecordBatch.from_pylist(rows, schema)) == want(rows)
    rows[3]["mapq"] = 256
    with pytest.raises(Exception, match="format"):
        bam.encode_batch(pa.RecordBatch.from_pylist(rows, schema))


def test_pileup_lines_are_made_where_reads_are(spark):
    """Reads are dealt by stretch once; their cells, fifty times as many, are not dealt again."""
    aln = derived.alignments(spark, "/root/testdata/sf0.001")
    lines = formats.pileup_lines(formats.pileup_cells(aln, F.lit("A")))
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert lines.select("ref_id", "pos").distinct().count() == lines.count()


def test_batches_are_summed_up_like_cells(spark):
    """No plan makes a row of a cell; the sums are those of single cells, as streams count them."""
    aln = derived.alignments(spark, "/root/testdata/sf0.001").limit(300)
    for df in (pileup.pileup(aln), pileup.coverage(aln)):
        assert "Generate explode" not in df._jdf.queryExecution().optimizedPlan().toString()
    each = pileup.cells(pileup.piled_reads(aln, False)).withColumnRenamed("at", "p")
    want = pileup.finished(pileup.counted(each, ["sample", "ref_id", "p"], 10, 10), 1)
    got = pileup.pileup(aln, min_count=1).select(*want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_genotypes_are_not_computed_over_the_pileup(spark):
    """What heterozygous_calls computes long expressions of are the few candidates, written before."""
    from strandlake.plans import calling

    plan = calling.heterozygous_calls(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "Aggregate" not in plan


def test_pileup_text_is_that_of_cells(spark):
    """Lines made of flat arrays are those made of single cells, however reads come in batches: deep places, equal and missing seqs, reads over stretches, indels at ends."""
    import numpy as np

    rng = random.Random(7)
    cigars = ["10M", "4M3D6M", "5M20000N5M", "2S8M", "3M2I5M", "4=1X2D5M", "9M1I", "10M2D", "3I7M", "5M5I", "2M6D2I6M", "10S", "5M2N5M"]
    rows = []
    for k in range(3000):
        bases = "".join(rng.choice("ACGTNacgt") for _ in range(rng.choice([10, 10, 10, 7])))
        pos = rng.choice([rng.randrange(300), 4090, rng.randrange(9000)])
        rows.append((rng.choice([0, 1, 1, None]), pos, rng.choice([k, k // 2, 5, None]), rng.choice([0, 30, 200, None]), rng.choice([0, 16, 4]), rng.choice(cigars), bases, "".join(rng.choice("!5I") for _ in bases)))
    table = spark.createDataFrame(rows, "ref_id int, pos int, seq long, mapq int, flag int, c string, bases string, quals string").withColumn("cigar", reads.parse_cigar(F.col("c"))).drop("c")
    columns = ["ref_id", "pos", "ref", "depth", "text", "quals", "mapqs"]
    letters = np.frombuffer(b"ACGT", np.uint8)
    at = F.substring(F.lit("ACGT"), (F.col("p") % 4 + 1).cast("int"), F.lit(1))
    want = formats.pileup_lines(formats.pileup_cells(table, F.when(F.col("ref_id").isNotNull(), at)), mapq=True).select(*columns)
    want = sorted(map(str, want.collect()))
    for size in ("10000", "1", "13"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        got = formats.pileup_text(table, lambda ref, pos: letters[pos % 4])
        assert sorted(map(str, got.select(*columns).collect())) == want
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert formats.pileup_text(table.limit(0), lambda ref, pos: letters[pos % 4]).count() == 0


def test_convert_pileup_makes_no_rows_of_cells(spark):
    from strandlake.plans import queries

    plan = queries.QUERIES["convert_pileup"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and plan.count("Generate") == 1  # the stretches of a read


def test_sums_of_regions_are_not_dealt(spark, monkeypatch):
    """Reads and regions meet in one exchange; the rows are the same in small batches, and where a stretch is hot."""
    from strandlake.plans import analysis

    folder = "/root/testdata/sf0.001"
    aln, manifest = derived.alignments(spark, folder).filter("ref_id < 2"), analysis.manifest(spark, folder)
    found = pileup.region_pileup(aln, manifest)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_COL") == 1 and plan.rindex("REPARTITION_BY_COL") > plan.index("MapInArrow")
    whole = sorted(map(str, found.select(sorted(found.columns)).collect()))
    monkeypatch.setattr(pileup, "FEW_BINS", 0)
    monkeypatch.setattr(pileup, "ROWS_TOGETHER", 7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    got = pileup.region_pileup(aln, manifest)
    assert sorted(map(str, got.select(sorted(got.columns)).collect())) == whole
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    monkeypatch.setattr(pileup, "HOT_READS", 16)
    hot = pileup.region_pileup(aln, manifest)
    assert sorted(map(str, hot.select(sorted(found.columns)).collect())) == whole
