"""Quality rules, personal data, secrets and mixing against brute force."""

import collections
import hashlib
import re

import pytest
from llm_oracle import same
from hypothesis import given, settings
from hypothesis import strategies as st

from strandlake.llm import mixing, pii, quality, queries, secrets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, row int, n int"
LONG = " ".join(f"w{i % 700}" for i in range(20_000)) + "."
ODD = [
    (1, None, None, None, None, "x", 1, 1),
    (2, "", "en", "a", 0, "x", 1, 1),
    (None, "one two.", "en", "a", 8, None, None, None),
    (3, LONG, "en", None, len(LONG), "x", 1, 1),
    (4, "same row again " * 9, "en", "b", 5, "x", 1, 1),
    (4, "same row again " * 9, "en", "b", 5, "x", 1, 1),
    (5, "\n\n \t\n", "en", "b", 5, "x", 1, 1),
    (6, "é a@b.co 10.0.0.256 1.2.3.4 +44 20 7946 0958 4111 1111 1111 1111", "en", "a", 5, "x", 1, 1),
    (7, "API_KEY='abcdefghijkl' deadbeefdeadbeef AKIAABCDEFGHIJKLMN token=token:ABCDEFGHIJKLMNO", "en", "c", 5, "x", 1, 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def rows(df):
    return [r.asDict() for r in df.collect()]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def base_quality(text):
    text = text or ""
    w = words(text)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    times = collections.Counter(windows)
    covered = {p for i, x in enumerate(windows) if times[x] > 1 for p in range(i, i + 8)}
    full = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(full) - len(set(full)), len(covered)


def test_quality_counts(odd, docs):
    for df in (odd, docs):
        texts = collections.Counter((r["doc_id"], base_quality(r["text"])) for r in rows(df))
        got = rows(quality.quality(df))
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        assert collections.Counter((r["doc_id"], tuple(r[n] for n in names)) for r in got) == texts
        for r in got:
            assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
            assert not (r["kept"] and r["base_failed"])


def test_sql(spark):
    same(spark, queries, "op5_quality_rules", "/root/testdata/sf0.01")
    same(spark, queries, "op6_secret_scans", "/root/testdata/sf0.01")


def test_quality_lines(spark):
    first = "This is a line of plain prose that ends as a sentence should end."
    second = "Here another sentence follows, with quite different words in it, so that nothing repeats."
    text = "\n".join([first, second, "Home | About | Contact | Help", "All rights reserved.", "Menu"])
    (kept,) = rows(quality.quality(spark.createDataFrame([(1, text)], "doc_id long, text string")))
    assert kept["clean_text"] == f"{first}\n{second}" and kept["kept"]
    text = "\n".join([first, " | ".join(f"word{i}" for i in range(30))])
    (lost,) = rows(quality.quality(spark.createDataFrame([(1, text)], "doc_id long, text string")))
    assert not lost["base_failed"] and not lost["kept"]


def test_quality_clean_keeps_columns(odd):
    assert quality.clean(odd).columns == odd.columns
    assert {r["doc_id"] for r in rows(quality.clean(odd))} <= {r[0] for r in ODD}


def plain_pii(text):
    text, spans = text or "", []
    for kind, pattern in pii.BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(digits[::-1])) % 10 == 0):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            spans.append((kind, m.start(), m.end()))
    return spans


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a.@-1 4+()\n%é0", max_size=60))
def test_pii_patterns(text):
    assert [s[:3] for s in pii.find(text) if s.kind in pii.BASE] == plain_pii(text)


def test_pii_checks():
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765433")
    found = {s.kind: s for s in pii.find("Pay to account GB82 WEST 1234 5698 7654 32 now")}
    assert found["iban"].score > pii.SCORES["iban"]
    assert not pii.find("part 123-45-6789") and pii.find("my ssn: 123-45-6789")[0].kind == "id"
    assert len(pii.find("a" * 200_000 + "@" + "9" * 100_000)) == 0


def test_pii_query(spark):
    got = {r["doc_id"]: r for r in rows(queries.op2_pii(spark, "/root/testdata/sf0.001"))}
    for r in rows(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")):
        spans = plain_pii(r["text"])
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        mine = got[r["doc_id"]]
        assert mine["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert [mine[f"n_{k}"] for k in pii.BASE] == [sum(s[0] == k for s in spans) for k in pii.BASE]


def test_pii_odd(odd, spark):
    assert pii.detect(odd).count() == len(ODD)
    assert {r["doc_id"]: r["text"] for r in rows(pii.redact(odd))}[1] is None
    assert "<email>" in {r["doc_id"]: r["text"] for r in rows(pii.redact(odd))}[6]
    assert pii.detect(odd.limit(0)).count() == 0


def plain_secrets(text):
    text, spans = text or "", []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 12:
            spans.append((m.start(), 0, m.end()))
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans))


def test_secrets(odd, docs):
    for df in (odd, docs):
        got = collections.Counter((r["doc_id"], r["base_spans"]) for r in rows(secrets.scan(df)))
        assert got == collections.Counter((r["doc_id"], plain_secrets(r["text"])) for r in rows(df))
    assert secrets.scan(odd.limit(0)).count() == 0


def test_secrets_ownership(spark):
    key = "ghp_" + "a1B2" * 10
    data = [(i, f"key {key}x{i if i == 9 else 0} end", "en", f"s{i}") for i in range(10)]
    got = {r["doc_id"]: r for r in rows(secrets.scan(spark.createDataFrame(data, "doc_id long, text string, lang string, source string")))}
    assert got[9]["n_live"] == 1 and got[9]["spans"].startswith("vendor:4:")
    assert all(got[i]["n_example"] == 1 and got[i]["spans"] == "" for i in range(9))


def test_secrets_of_one_owner(spark):
    """One owner's value stays live in any number of texts; two owners' needs several texts to be an example."""
    key = lambda c: "ghp_" + c * 30
    data = [(i, f"{i} {key('X')}", "one") for i in range(9)] + [(20 + i, f"{i} {key('Y')}", f"s{i % 2}") for i in range(5)] + [(30 + i, f"same {key('Z')}", f"s{i % 2}") for i in range(8)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    want = {r["doc_id"]: (r["n_live"], r["n_example"]) for r in rows(secrets.scan(df))}
    assert {want[i] for i in range(9)} == {(1, 0)} and {want[20 + i] for i in range(5)} == {(0, 1)} and {want[30 + i] for i in range(8)} == {(1, 0)}
    assert {r["doc_id"]: (r["n_live"], r["n_example"]) for r in rows(secrets.scan(df, hot_rows=6))} == want


def level_targets(sizes, share=1.5, cap=2.0):
    """Reshare the excess until no source is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    full, total = {}, share * sum(sizes.values())
    while True:
        free = [s for s in names if s not in full]
        rest = total - sum(full.values())
        got = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if got[s] > cap * sizes[s]]
        if not above:
            return full | got
        full |= {s: cap * sizes[s] for s in above}


def test_mixing(odd, docs):
    for df in (odd, docs):
        got = rows(mixing.taken(df))
        size = collections.Counter()
        for r in rows(df):
            size[r["source"]] += len(words(r["text"]))
        assert collections.Counter((r["doc_id"], r["size"]) for r in got) == collections.Counter((r["doc_id"], len(words(r["text"]))) for r in rows(df))
        want, taken = level_targets(size), collections.Counter()
        for r in got:
            taken[r["source"]] += r["taken"]
            assert 0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == size[r["source"]]
            assert r["target"] == pytest.approx(want[r["source"]], rel=1e-9)
        assert all(abs(taken[s] - want[s]) <= 0.5 for s in size)
        assert sorted(map(str, got)) == sorted(map(str, rows(mixing.taken(df))))


def test_mix_rows(odd, docs):
    assert mixing.mix(odd).columns == odd.columns and mixing.mix(odd.limit(0)).count() == 0
    taken = collections.Counter()
    for r in rows(mixing.taken(docs)):
        taken[r["doc_id"]] += r["taken"]
    mixed, texts = collections.Counter(), {r["doc_id"]: r["text"] for r in rows(docs)}
    for r in rows(mixing.mix(docs)):
        mixed[r["doc_id"]] += len(words(r["text"]))
        assert texts[r["doc_id"]].startswith(r["text"])
    assert +mixed == +taken


def test_staged_tables_can_be_cleared(spark):
    import os

    from strandlake.sources import staging

    staging.staged(spark.range(3), "test")
    path = staging.STAGED[-1].removeprefix("file://")
    assert os.path.isdir(path) and staging.clear_staged(spark) >= 1 and not os.path.exists(path) and not staging.STAGED
