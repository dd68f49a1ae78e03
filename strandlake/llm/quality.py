"""Quality rules, line first, with DataFrame functions alone.

Each line is judged by rules on punctuation, navigation and boilerplate. Lines that
fail are removed, and a document that loses too much of its text is rejected. Rules
on the whole text come before that.

Defined results: a null text counts as empty; an empty text has no words, fails the
rules and is not kept; null ids and other null columns pass through; equal rows are
judged alike; an empty table gives an empty table; input columns beyond those named
are ignored by `quality` and kept by `clean`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm.shared import SPACES, WORD, let, words

#: Fixed values of the contract.
WINDOW = 8
SYMBOL_RUN = r"[#*$%&|<>]+"
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

#: Line rules: a line of fewer words than this must end a sentence.
SHORT_LINE = 6
SENTENCE_END = r"[.!?:;…。！？।]['\")\]”’»]*$"
#: At least this many separators, and one for every four words, make a navigation line.
SEPARATOR = r"(^|[\x20\t])[|»›·>•/]+(?=[\x20\t]|$)"
MIN_SEPARATORS = 2
#: Words glued to symbols or to repeated marks; lines with this share of them fail.
MARKED_WORD = r"([#*$%&|<>]{2,}|[!?]{2,})(?=[\x20\x09-\x0D]|$)"
MARKED_PERCENT = 30
BOILERPLATE = (
    r"(?i)\b(?:all rights reserved|terms of (?:use|service)|privacy policy|cookie policy|uses? cookies"
    r"|accept (?:all )?cookies|enable javascript|click here|read more|sign up (?:now|for)|log ?in to|subscribe to our"
    r"|share (?:this|on)|follow us|back to top|skip to (?:main )?content|lorem ipsum|licensed under|released under the)\b"
)
#: A boilerplate phrase condemns a line of up to this many words; in longer ones it is part of prose.
BOILERPLATE_WORDS = 25
#: A document that keeps less than this share of its words is rejected.
MIN_KEPT_PERCENT = 50


def repeated_words(text_words: Column, width: int = WINDOW) -> Column:
    """How many words lie in windows of `width` words that occur twice or more.

    Windows are compared by a 64-bit hash of their words' 64-bit hashes.
    """

    def covered(windows: Column) -> Column:
        def positions(by_hash: Column) -> Column:
            equal = lambda e, k: F.coalesce(F.get(by_hash, k)["h"] == e["h"], F.lit(False))
            found = F.transform(by_hash, lambda e, k: F.when(equal(e, k - 1) | equal(e, k + 1), e["p"]))
            return F.sort_array(F.filter(found, lambda p: p.isNotNull()))

        def total(at: Column) -> Column:
            gaps = F.transform(at, lambda p, k: F.least(F.lit(width), F.coalesce(F.get(at, k + 1) - p, F.lit(width))))
            return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)

        pairs = F.sort_array(F.transform(windows, lambda h, p: F.struct(h.alias("h"), p.alias("p"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(
            let(pairs, lambda s: let(positions(s), total))
        )

    def windows(hashes: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(hashes) - width)
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(width)]))

    return F.when(F.size(text_words) < width, F.lit(0).cast("long")).otherwise(
        let(F.transform(text_words, lambda w: F.xxhash64(w)), lambda h: let(windows(h), covered))
    )


def line_fails(line: Column) -> Column:
    """Whether a line fails one of the rules. Lines without a word do not."""

    def rules(n_words: Column) -> Column:
        short = (n_words < SHORT_LINE) & ~F.btrim(line, F.lit(SPACES)).rlike(SENTENCE_END)
        boilerplate = (n_words <= BOILERPLATE_WORDS) & line.rlike(BOILERPLATE)
        separators = lambda n: (n >= MIN_SEPARATORS) & (n * 4 >= n_words)
        navigation = line.rlike(SEPARATOR) & let(F.regexp_count(line, F.lit(SEPARATOR)), separators)
        marked = line.rlike(MARKED_WORD) & (F.regexp_count(line, F.lit(MARKED_WORD)) * 100 > n_words * MARKED_PERCENT)
        return (n_words > 0) & (short | boilerplate | navigation | marked)

    return let(F.size(words(line)), rules)


def judged(text: Column) -> Column:
    """A struct of all counts on one text, with the text that its lines leave."""
    has_word = lambda line: F.btrim(line, F.lit(SPACES)) != ""
    whole = F.coalesce(text, F.lit(""))

    def counts(lines: Column, text_words: Column, rated: Column) -> Column:
        full = F.filter(lines, has_word)
        lost = F.transform(F.filter(rated, lambda r: r["fails"]), lambda r: r["line"])
        kept = F.transform(F.filter(rated, lambda r: ~r["fails"]), lambda r: r["line"])
        return F.struct(
            F.size(text_words).cast("long").alias("n_words"),
            F.length(F.array_join(text_words, "")).cast("long").alias("word_chars"),
            (F.length(whole) - F.length(F.regexp_replace(whole, SYMBOL_RUN, ""))).cast("long").alias("n_symbols"),
            (F.size(full) - F.size(F.array_distinct(full))).cast("long").alias("n_dup_lines"),
            repeated_words(text_words).cast("long").alias("n_repeat_words"),
            (F.size(text_words) - F.size(words(F.array_join(lost, "\n")))).cast("long").alias("n_kept_words"),
            F.array_join(kept, "\n").alias("clean_text"),
        )

    def of_lines(lines: Column) -> Column:
        rated = F.transform(lines, lambda line: F.struct(line.alias("line"), line_fails(line).alias("fails")))
        return let(words(whole), lambda w: let(rated, lambda r: counts(lines, w, r)))

    return let(F.split(whole, "\n"), of_lines)


def quality(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, the counts, base_failed, kept, n_kept_words and clean_text."""
    return with_verdicts(docs.select("doc_id", judged(F.col("text")).alias("j")).select("doc_id", "j.*"))


def with_verdicts(facts: DataFrame) -> DataFrame:
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    enough = 100 * F.col("n_kept_words") >= MIN_KEPT_PERCENT * F.col("n_words")
    return facts.withColumns({"base_failed": failed, "kept": ~failed & enough})


def clean(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with failing lines removed; all columns of docs."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    # An exploded array keeps the filter from judging each text a second time.
    facts = with_verdicts(docs.select(row, F.explode(F.array(judged(F.col("text")))).alias("j")).select("row", "j.*"))
    clean_values = {"text": F.col("clean_text"), "n_chars": F.length("clean_text").cast("long")}
    return facts.filter("kept").select(*[clean_values.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
