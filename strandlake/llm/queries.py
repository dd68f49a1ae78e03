"""The queries of this subpackage: each operator over its whole table, with its production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import linededup, mixing, neardup, pagetext, pieces, pii, quality, quantised, ranked, secrets, spelling, tokencount, urlfilter


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def said(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def op1_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    found = pagetext.extracted(table(spark, folder, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op2_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.detect(table(spark, folder, "documents"))
    of_kind = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    base = F.filter("spans", lambda s: s["kind"].isin(list(pii.BASE)))
    return found.select(
        "doc_id",
        *[F.size(of_kind(kind)).cast("long").alias(f"n_{kind}") for kind in pii.KINDS],
        F.sha2(said(base), 256).alias("base_sha256"),
        said(F.col("spans")).alias("spans"),
        F.array_max(F.transform("spans", lambda s: s["score"])).alias("top_score"),
    )


def op3_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.taken(table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source")


def op4_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = linededup.deduped(table(spark, folder, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality.quality(table(spark, folder, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_kept_words"
    )


def op6_secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.scan(table(spark, folder, "documents"))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_live", "n_example"
    )


def op7_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    return urlfilter.judged(table(spark, folder, "pages"))


def op8_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.classes(table(spark, folder, "documents"))


def op9_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return quantised.search(vectors, F.col("vec_id") % quantised.QUERY_EVERY == 0)


def op10_sentencepiece(spark: SparkSession, folder: str, model: str | None = None) -> DataFrame:
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path("piece_bpe_32k.model")
    coded = pieces.encode_and_decode(table(spark, folder, "documents"), model)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op11_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranked.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op12_token_counts(spark: SparkSession, folder: str, model: str | None = None) -> DataFrame:
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path("piece_bpe_32k.model")
    return tokencount.counts(table(spark, folder, "documents"), model)


def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(table(spark, folder, "documents"))


QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_pii": op2_pii,
    "op3_mixing": op3_mixing,
    "op4_line_dedup": op4_line_dedup,
    "op5_quality_rules": op5_quality_rules,
    "op6_secret_scans": op6_secret_scans,
    "op7_url_filters": op7_url_filters,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_nearest_neighbours": op9_nearest_neighbours,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_ranked_search": op11_ranked_search,
    "op12_token_counts": op12_token_counts,
    "op13_spelling_variants": op13_spelling_variants,
}

WORD_SQL = r"[^\x20\x09-\x0D]+"
SPACES_SQL = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"



def secrets_sql() -> str:
    """Places of matches are the lengths of all pieces and matches before them."""
    found = []
    for k, (name, pattern, group, least, measured) in enumerate(secrets.KINDS):
        regex = pattern.replace("'", "''")
        found.append(
            f"SELECT r, {k} AS kind, '{name}' AS name, regexp_extract_all(text, '{regex}') AS m, regexp_extract_all(text, '{regex}', {group}) AS v, "
            f"regexp_split_to_array(text, '{regex}') AS g, {least} AS least, {'true' if measured else 'false'} AS by_value FROM docs"
        )
    return f"""
        WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, source FROM documents),
        found AS ({' UNION ALL '.join(found)}),
        hits AS (
            SELECT r, kind, name, unnest(v) AS value, unnest(list_transform(range(1, len(m) + 1), lambda i: list_sum(list_transform(g[1:i], lambda x: length(x)))
                + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)))::BIGINT AS s, unnest(list_transform(m, lambda x: length(x))) AS n, least, by_value
            FROM found WHERE len(m) > 0
        ),
        good AS (SELECT h.*, source, text FROM hits h JOIN docs USING (r) WHERE CASE WHEN by_value THEN length(value) ELSE n END >= least),
        held AS (
            SELECT value, count(DISTINCT coalesce(source, chr(1))) >= {secrets.EXAMPLE_OWNERS} OR (count(DISTINCT coalesce(source, chr(1))) > 1
                AND count(DISTINCT (coalesce(source, chr(1)), text)) >= {secrets.EXAMPLE_REPOSITORIES}) AS example
            FROM good GROUP BY value
        ),
        spans AS (SELECT g.*, example, kind < {secrets.BASE_KINDS} AS base, name || ':' || s || ':' || (s + n) AS said FROM good g JOIN held USING (value)),
        agg AS (
            SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
                string_agg(said, ',' ORDER BY s, kind) FILTER (base) AS b, string_agg(said, ',' ORDER BY s, kind) FILTER (base OR NOT example) AS a,
                count(*) FILTER (NOT example) AS n_live, count(*) FILTER (example) AS n_example
            FROM spans GROUP BY r
        )
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256,
            coalesce(a, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
        FROM docs LEFT JOIN agg USING (r)"""


TERM_SQL = r"[^\x{00}-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LOWER_SQL = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


ORACLE_SQL: dict[str, str] = {
    "op11_ranked_search": f"""
        WITH docs AS (SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(translate(text, {LOWER_SQL}), '{TERM_SQL}') AS t FROM documents),
        items AS (SELECT row_number() OVER () AS i, item_id, regexp_extract_all(translate(text, {LOWER_SQL}), '{TERM_SQL}') AS t FROM benchmark),
        asked AS (SELECT i, t, count(*) AS q FROM (SELECT i, unnest(t) AS t FROM items) GROUP BY i, t),
        totals AS (SELECT count(*) AS n_docs, sum(len(t))::BIGINT AS n_terms FROM docs WHERE len(t) > 0),
        held AS (SELECT d, t, count(*) AS tf FROM (SELECT d, unnest(t) AS t FROM docs) WHERE t IN (SELECT t FROM asked) GROUP BY d, t),
        weights AS (SELECT t, floor(1000 * ln((2 * max(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM held, totals GROUP BY t),
        lengths AS (SELECT d, doc_id, 100 - 25 + ((25 * len(t) * n_docs) // n_terms) AS m FROM docs, totals WHERE len(t) > 0),
        scored AS (
            SELECT i, d, sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
            FROM held JOIN weights USING (t) JOIN lengths USING (d) JOIN asked USING (t) GROUP BY i, d
        )
        SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score
        FROM scored JOIN items USING (i) JOIN docs USING (d) WHERE score > 0
        QUALIFY row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) <= 20""",
    "op6_secret_scans": secrets_sql(),
    "op4_line_dedup": f"""
        WITH docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
        each AS (SELECT r, doc_id, unnest(l) AS line, unnest(range(len(l))) AS i FROM docs),
        keyed AS (
            SELECT *, translate(trim(line, {SPACES_SQL}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM each
        ),
        shared AS (SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT r) >= 10),
        marked AS (SELECT *, k IN (SELECT k FROM shared) AS gone FROM keyed)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY r, doc_id""",
    "op5_quality_rules": rf"""
        WITH docs AS (
            SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD_SQL}') AS w,
                string_split(coalesce(text, ''), chr(10)) AS l
            FROM documents
        ),
        windows AS (SELECT r, i, w[i + 1:i + 8] AS x FROM (SELECT r, w, unnest(range(len(w) - 7)) AS i FROM docs WHERE len(w) >= 8)),
        again AS (SELECT r, list(i) AS spots FROM windows GROUP BY r, x HAVING count(*) > 1),
        covered AS (SELECT r, count(DISTINCT i + k) AS n FROM (SELECT r, i, unnest(range(8)) AS k FROM (SELECT r, unnest(spots) AS i FROM again)) GROUP BY r),
        lines AS (SELECT r, line, regexp_extract_all(line, '{WORD_SQL}') AS w FROM (SELECT r, unnest(l) AS line FROM docs)),
        rated AS (
            SELECT r, len(w) AS n, len(w) > 0 AND (
                (len(w) < 6 AND NOT regexp_matches(trim(line, {SPACES_SQL}), '[.!?:;…。！？।][''")\]”’»]*$'))
                OR (len(w) <= 25 AND regexp_matches(line, '(?i)\b(?:all rights reserved|terms of (?:use|service)|privacy policy|cookie policy|uses? cookies|accept (?:all )?cookies|enable javascript|click here|read more|sign up (?:now|for)|log ?in to|subscribe to our|share (?:this|on)|follow us|back to top|skip to (?:main )?content|lorem ipsum|licensed under|released under the)\b'))
                OR (len(list_filter(string_split(replace(line, chr(9), ' '), ' '), lambda x: regexp_full_match(x, '[|»›·>•/]+'))) >= 2
                    AND len(list_filter(string_split(replace(line, chr(9), ' '), ' '), lambda x: regexp_full_match(x, '[|»›·>•/]+'))) * 4 >= len(w))
                OR len(list_filter(w, lambda x: regexp_matches(x, '([#*$%&|<>]{{2,}}|[!?]{{2,}})$'))) * 100 > len(w) * 30
            ) AS fails
            FROM lines
        ),
        lost AS (SELECT r, sum(n) AS n FROM rated WHERE fails GROUP BY r),
        facts AS (
            SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
                len(list_filter(l, lambda x: regexp_matches(x, '{WORD_SQL}'))) - len(list_distinct(list_filter(l, lambda x: regexp_matches(x, '{WORD_SQL}')))) AS n_dup_lines,
                coalesce(covered.n, 0) AS n_repeat_words, (len(w) - coalesce(lost.n, 0))::BIGINT AS n_kept_words
            FROM docs LEFT JOIN covered USING (r) LEFT JOIN lost USING (r)
        )
        SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
            NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 100 * n_kept_words >= 50 * n_words AS kept
        FROM facts""",
    "op7_url_filters": """
        WITH cut AS (
            SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
        ),
        parts AS (
            SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
            FROM cut
        ),
        ruled AS (
            SELECT *, CASE
                WHEN (host = 'example.org' OR suffix(host, '.example.org')) AND prefix(path, '/en/1') THEN 'example.org/en/1'
                WHEN (host = 'example.org' OR suffix(host, '.example.org')) AND prefix(path, '/es/') THEN 'example.org/es/'
                WHEN (host = 'com' OR suffix(host, '.com')) AND prefix(path, '/fr/') THEN 'com/fr/'
                WHEN (host = 'com' OR suffix(host, '.com')) AND prefix(path, '/de/') THEN 'com/de/'
                WHEN (host = 'org' OR suffix(host, '.org')) AND prefix(path, '/') THEN 'org/'
            END AS rule
            FROM parts
        )
        SELECT page_id, host, path, rule, CASE
            WHEN rule IN ('org/', 'com/fr/') THEN 'allow'
            WHEN rule IS NOT NULL THEN 'block'
            WHEN list_has_any(regexp_split_to_array(host, '[.-]'), ['adult', 'casino', 'porn', 'sex', 'xxx', 'gambling', 'poker',
                'betting', 'warez', 'torrent', 'phishing', 'malware', 'pills']) THEN 'block'
            ELSE 'allow' END AS verdict
        FROM ruled""",
}
