"""Per-document text quality statistics, and rules that tell prose from lists, tables and junk.

All statistics are JVM expressions over the whole text: counts of regular
expressions and lengths of what they match.  :func:`published_rules` are fixed
thresholds from the literature, each with its source; :func:`rules` tell the
kinds apart, by published thresholds where there are some and by thresholds on
the layout elsewhere.  Every rule that fires is recorded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Frequent function words of English, German, French and Spanish.
COMMON_WORDS = (
    "a about after all an and are as at be been before both but by can could do each even for from had has have how if in into is it its "
    "more most no nor not now of on only or other our out over since so some still than that the their them then there they this "
    "those three to two under until was we were what when where which while who why will with would yet "
    "als am auf aus bei beide bis das dass dem den der des die ein eine einen es etwa für hat im ist kaum man mit nach nicht "
    "noch oder sich sie sind sodass um und unser unsere vom von vor während war warum was weil wie wir wird wurde zu zum zur "
    "ainsi alors au aux avec ce ces cette dans de depuis des dont du elle en est et il la le les leur mais ne on ou où par pas pour "
    "pourquoi puis que qui sa se ses son sont sur un une "
    "al como con cuando del desde después el ella en entre era es esta este fue ha hay las lo los más mientras muy no para pero por "
    "porque que se sin sobre su tras una unos y ya"
).split()

#: One to three words: what a cell of a table without a delimiter holds.
_CELL = r"[^\s|]+(?: [^\s|]+){0,2}"
_MARK = r"(?:[-*+•·‣▪–—]|[#№][0-9]{1,4}[.:)]?|\(?[0-9]{1,3}[.)]|\(?[A-Za-z][.)]|\(?[ivx]{1,4}[.)]|\[[ xX]?\]|☐|☑)"

LINE_KINDS = {
    # rows of a table, one pattern a delimiter; a cell may be empty
    "pipe_row": r"(?m)^[ \t]*\|[^\n]*\|[ \t]*$",
    "bar_row": r"(?m)^[^|\n]{0,40}(?:\|[^|\n]{0,40}){2,}$",
    "rule_row": r"(?m)^[ \t]*[+|][-=+|: ]{3,}[+|][ \t]*$",
    "tab_row": r"(?m)^[^\t\n]{0,40}(?:\t[^\t\n]{0,40}){2,}$",
    "semicolon_row": r"(?m)^[^;\n]{0,40}(?:;[^;\n]{0,40}){2,}$",
    "comma_row": r"(?m)^[^,\n]{0,40}(?:,(?:[^, \n][^,\n]{0,39})?){2,}$",
    "gap_row": r"(?m)^ *" + _CELL + r"(?: {2,}" + _CELL + r"){1,} *$",
}
#: A sign that every row of the kind has.
LINE_SIGNS = {"pipe_row": "|", "bar_row": "|", "rule_row": "--", "tab_row": "\t", "semicolon_row": ";", "comma_row": ",", "gap_row": "  "}
ENTRY_KINDS = {
    "marked": r"(?m)^[ \t]*" + _MARK + r"[ \t]+[^\n]{1,90}$",
    "labelled": r"(?m)^[ \t]*[^\s:;,.][^:\n;,.]{0,24}:[ \t]+[^\n]{1,60}$",
    "bare": r"(?m)^[ \t]*[\p{Lu}\p{N}](?:[^\s]*(?:[ \t]+[^\s]+){0,6}[ \t]+)?[^\s]*[^\s.!?,][ \t]*$",
    "closed": r"(?m)^[ \t]*[^\s]+(?:[ \t]+[^\s]+){1,9};[ \t]*$",
}
_ENTRY = "(?m)(?:" + "|".join("(?:" + p.replace("(?m)", "") + ")" for p in ENTRY_KINDS.values()) + ")"
_ROW = "(?m)(?:" + "|".join("(?:" + p.replace("(?m)", "") + ")" for p in LINE_KINDS.values()) + ")"
_STRIP = _ENTRY + "|" + _ROW
#: Of the text, before entries or rows can make it a list or table.
LEAST_SHARE = 0.35
#: Between entries that share a line.
_BETWEEN = r", | / |; | \| | • | · "
_SENTENCE_END = r"(?m)[\p{L}\p{N})\"'”»][.!?][\"'”»)]*(?:\s|$)"
_LONG = r"\S{45,}"
_CELL_TAG = r"(?i)<t[dh]\b"
_LINE = r"(?m)^[^\n]*\S"
_PUNCTUATED = r"(?m)[.!?:;…][\"'”»)]*[ \t]*$"
_UNIT_END = r"[.!?]\s+|\n+"
_HEX = r"(?m)^[0-9a-fA-F]{4,8}:?(?:[ \t]+[0-9a-fA-F]{2,8}){4,}[^\n]*$"
#: Blanks beside the plain one, and signs of no width.
BLANKS = "[\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000]"
NO_WIDTH = "[\u00ad\u200b-\u200d\u2060\ufeff]"
#: Signs inside words, capitals after small letters, and what is left of texts read in a wrong encoding.
_GARBLED = [r"[,;:!|~�=^]\p{L}", r"[a-zA-Z]\.[a-z]", r"[a-zà-ÿ][A-ZÀ-Þ]", "[�¿½¼»¡¢°€™ÃÂÐ]"]
_TAG = r"</?[A-Za-z][^<>\n]{0,200}>"
#: The stop words of Rae et al. 2021, table A1.
STOP_WORDS = ["the", "be", "to", "of", "and", "that", "have", "with"]
_SYMBOLS = r"#|\.\.\.|…"
_ELLIPSIS_LINE = r"(?m)(?:\.\.\.|…)[ \t]*$"
_NO_LETTER = r"(?<!\S)[^\s\p{L}]+(?!\S)"
_SHORT_LINE = r"(?m)^[ \t]*\S[^\n]{0,29}$"
#: Words in a run by which repetition is told.
RUN = 5


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def _found(text: Column, pattern: str, might: Column | None = None) -> Column:
    """All matches; where ``might`` says that there can be none, the expression is not run."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return found if might is None else F.when(might, found).otherwise(F.array().cast("array<string>"))


def _length(found: Column) -> Column:
    """Characters of all matches, without blanks."""
    return F.length(F.regexp_replace(F.array_join(found, ""), r"\s+", ""))


def layout(text: Column) -> Column:
    """The text with one kind of line end and of blank, without signs of no width."""
    text = F.coalesce(text, F.lit(""))
    lines = F.when(F.contains(text, F.lit("\r")), F.regexp_replace(text, r"\r\n?", "\n")).otherwise(text)
    plain = F.regexp_replace(F.regexp_replace(lines, NO_WIDTH, ""), BLANKS, " ")
    return F.when(F.octet_length(text) == F.length(text), lines).otherwise(plain)


def _distinct_runs(words: Column) -> Column:
    """Different runs of five words, NULL where they cannot be as few as a quarter of the words.

    Every word but the last four begins a run, so there are at least as many
    different runs as different words but four; few texts have to be cut.
    """
    n = F.size(words)
    runs = F.transform(F.sequence(F.lit(1), n - (RUN - 1)), lambda i: F.xxhash64(F.slice(words, i, RUN)))
    return F.when((n > RUN) & (4 * (F.size(F.array_distinct(words)) - (RUN - 1)) <= n), F.size(F.array_distinct(runs)))


#: The statistics that :func:`rules` look at.
OF_KINDS = (
    "n_words cell_tags hex_share long_share n_rows n_sentences_apart row_share n_runs n_units distinct_units distinct_share single_share garbled_share "
    "n_entries bullet_share entry_share common_share n_between n_sentences letterless_share mean_word_length symbol_share"
).split()


def text_statistics(documents: DataFrame, text: str = "text", only: list[str] | None = None) -> DataFrame:
    """``documents`` with a column ``stats``, a struct of counts and shares; ``only`` names those that are wanted.

    A NULL text counts as an empty one; shares of nothing are 0.  Whole texts
    are read, however long; an expression is skipped only where a sign that all
    its matches hold is not in the text, or where no rule can ask for it.
    """
    t, plain, words = F.col("_t"), F.col("_plain"), F.col("_words")  # plain: without markup
    chars, lines, n = F.col("_chars"), F.col("_lines"), F.size("_words")
    has = lambda sign: F.contains(t, F.lit(sign))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    rows = {k: F.col(f"_{k}") for k in LINE_KINDS}
    letters = F.length(F.array_join(words, ""))
    row_lengths = [_length(r) for k, r in rows.items() if k not in ("pipe_row", "rule_row")] + [_length(rows["pipe_row"]) + _length(rows["rule_row"])]
    stats = {
        "n_chars": F.length(t),
        "n_words": n,
        "n_lines": lines,
        "mean_word_length": share(letters, n),
        "symbol_share": share(chars - letters, chars),
        "punctuated_share": share(_count(t, _PUNCTUATED), lines),
        "bullet_share": share(_count(t, r"(?m)^[ \t]*" + _MARK + r"[ \t]+\S"), lines),
        "common_share": share(F.size(F.filter(words, lambda w: w.isin(COMMON_WORDS))), n),
        "distinct_share": share(F.size(F.array_distinct(words)), n),
        "single_share": share(F.size(F.filter(words, lambda w: F.length(w) == 1)), n),
        "long_share": share(_length(_found(plain, _LONG)), chars),
        "hex_share": share(_length(_found(t, _HEX)), chars),
        "garbled_share": share(sum((_count(plain, p) for p in _GARBLED[:-1]), F.when(F.octet_length(plain) > F.length(plain), _count(plain, _GARBLED[-1])).otherwise(0)), n),
        "cell_tags": F.when(has("<"), _count(t, _CELL_TAG)).otherwise(0),
        "row_share": share(F.greatest(*row_lengths), chars),
        "n_rows": F.greatest(*[F.size(r) for r in rows.values()]),
        "entry_share": share(_length(F.col("_entries")), chars),
        "n_entries": F.size("_entries"),
        "n_between": _count(plain, _BETWEEN),
        "n_sentences": _count(plain, _SENTENCE_END),
        "n_sentences_apart": F.col("_apart"),
        "distinct_units": share(F.size(F.array_distinct(F.col("_units"))), F.size("_units")),
        "n_units": F.size("_units"),
        "n_runs": _distinct_runs(words),
        # what the published rules ask for besides
        "hash_share": share(_count(t, _SYMBOLS), n),
        "ellipsis_share": share(_count(t, _ELLIPSIS_LINE), lines),
        "letterless_share": share(_count(t, _NO_LETTER), _count(t, r"\S+")),
        "n_stop_words": F.size(F.array_intersect(words, F.array(*map(F.lit, STOP_WORDS)))),
        "repeated_line_share": share(lines - F.size(F.array_distinct(F.filter(F.transform(F.split(t, "\n"), lambda x: F.trim(x)), lambda x: x.rlike(r"\S")))), lines),
        "short_line_share": share(_count(t, _SHORT_LINE), lines),
    }
    base = documents.withColumn("_t", layout(F.col(text)))
    base = base.withColumn("_plain", F.when(has("<"), F.regexp_replace("_t", _TAG, " ")).otherwise(t))
    base = base.withColumns(
        {
            "_words": F.filter(F.split(F.lower("_plain"), r"[^\p{L}\p{N}]+"), lambda w: w != ""),
            "_units": F.filter(F.split("_plain", _UNIT_END), lambda u: F.trim(u) != ""),
            "_chars": F.length(F.regexp_replace("_plain", r"\s+", "")),
            "_lines": _count(t, _LINE),
            "_entries": _found(t, _ENTRY),
        }
        | {f"_{k}": _found(t, p, has(LINE_SIGNS[k])) for k, p in LINE_KINDS.items()}
    )
    # sentences outside of entries and rows, asked for only where these make up enough of the text to be a list or table
    apart = _count(F.regexp_replace(t, _STRIP, ""), _SENTENCE_END)
    entries = (F.size("_entries") >= 3) & (_length(F.col("_entries")) > LEAST_SHARE * chars)
    in_rows = (F.greatest(*[F.size(r) for r in rows.values()]) >= 3) & (F.greatest(*row_lengths) > LEAST_SHARE * chars)
    base = base.withColumn("_apart", F.when(entries | in_rows | (has("<") & (_count(t, _CELL_TAG) >= 4)), apart).otherwise(0))
    return base.withColumn("stats", F.struct(*[c.alias(k) for k, c in stats.items() if only is None or k in only])).drop("_t", "_plain", "_words", "_units", "_chars", "_lines", "_entries", "_apart", *[f"_{k}" for k in LINE_KINDS])


def published_rules(s: str = "stats") -> dict[str, Column]:
    """Thresholds as published; a text that fails one of them is not wanted in a training corpus.

    gopher: Rae et al. 2021, "Scaling Language Models", appendix A1.1.
    fineweb: Penedo et al. 2024, "The FineWeb Datasets", section 3.6.
    c4: Raffel et al. 2020, section 2.2.
    Short notes fail the rules on length whatever they are, so the rules are
    recorded for each text; which of them decide a kind is said in :func:`rules`.
    """
    c = lambda name: F.col(f"{s}.{name}")
    some = c("n_words") > 0
    return {
        "gopher_words": ~c("n_words").between(50, 100_000),
        "gopher_mean_word_length": some & ~c("mean_word_length").between(3, 10),
        "gopher_symbols": c("hash_share") > 0.1,
        "gopher_bullets": c("bullet_share") > 0.9,
        "gopher_ellipsis": c("ellipsis_share") > 0.3,
        "gopher_letters": c("letterless_share") > 0.2,
        "gopher_stop_words": c("n_stop_words") < 2,
        "gopher_repeated_lines": c("repeated_line_share") > 0.3,
        "fineweb_punctuation": c("punctuated_share") <= 0.12,
        "fineweb_short_lines": c("short_line_share") >= 0.67,
        "c4_sentences": c("n_sentences") < 3,
    }


def rules(s: str = "stats") -> dict[str, dict[str, Column]]:
    """Thresholds by kind, in the order in which kinds are tried.

    Those named gopher are the published ones; on the layout of lists and tables
    nothing is published, so the others were set by reading texts.
    """
    c = lambda name: F.col(f"{s}.{name}")
    long_enough = c("n_words").between(50, 100_000)
    wordy = c("n_words") >= 8
    # entries or rows against sentences beside them, so that one leading sentence does not hide a list
    outweigh = lambda n: n > 1.5 * c("n_sentences_apart")
    return {
        "junk": {
            "blank": (c("n_words") == 0) & (c("cell_tags") == 0),
            # the rules between rows of a drawn table are long runs too
            "encoded": (c("hex_share") > 0.5) | ((c("long_share") > 0.5) & (c("cell_tags") < 4) & (c("n_rows") < 3)),
        },
        "table": {
            "cells": (c("cell_tags") >= 4) & (c("cell_tags") > 4 * c("n_sentences_apart")),
            "rows": (c("n_rows") >= 3) & (c("row_share") > LEAST_SHARE) & outweigh(c("n_rows")),
        },
        "junk_repeated": {
            # of the words a quarter begins a run that is new
            "repeated_runs": (c("n_words") > RUN) & F.coalesce(4 * c("n_runs") <= c("n_words"), F.lit(False)),
            "repeated_units": (c("n_units") >= 5) & (c("distinct_units") < 0.25) & (c("distinct_share") < 0.15),
        },
        "junk_garbled": {
            "spaced_letters": wordy & (c("single_share") > 0.5),
            "garbled": c("garbled_share") > 0.015,
        },
        "list": {
            "gopher_bullets": (c("n_entries") >= 3) & (c("bullet_share") > 0.9),
            # German nouns start lines of wrapped prose with capitals; function words give it away
            "entries": (c("n_entries") >= 3) & (c("entry_share") > LEAST_SHARE) & outweigh(c("n_entries")) & ((c("common_share") < 0.35) | (c("entry_share") > 0.8) | ((c("n_entries") >= 5) & (c("n_entries") > 4 * c("n_sentences_apart")))),
            "inline_entries": (c("n_between") >= 3) & (c("n_words") < 6.5 * (c("n_between") + 1)) & (c("n_sentences") <= 0.1 * c("n_between")),
        },
        "junk_rest": {
            # meant for texts of the length that the same source asks for
            "gopher_letters": (c("letterless_share") > 0.2) & long_enough,
            "gopher_mean_word_length": c("mean_word_length") > 10,
            "symbols": c("symbol_share") > 0.3,
            "no_common_words": wordy & (c("common_share") < 0.1),
        },
    }


def judge(stats: DataFrame, published: bool = True) -> DataFrame:
    """Adds ``kind`` (prose, list, table or junk), ``reasons``, every rule on kinds that fired, and, if asked for, ``failures``, every published rule.

    Kinds are tried in the order of :func:`rules`; a text for which no rule
    fires is prose, with empty reasons.  NULL, empty and blank texts are junk.
    """
    kind, reasons = F.lit("prose"), []
    for name, tests in reversed(rules().items()):
        fired = F.lit(False)
        for reason, test in tests.items():
            reasons.append(F.when(test, F.lit(f"{name.split('_')[0]}:{reason}")))
            fired = fired | test
        kind = F.when(fired, F.lit(name.split("_")[0])).otherwise(kind)
    named = lambda tests: F.array_join(F.array_compact(F.array(*tests)), ",")
    out = stats.withColumn("kind", kind).withColumn("reasons", named(reasons))
    failures = [F.when(test, F.lit(reason)) for reason, test in published_rules().items()] if published else []
    return out.withColumn("failures", named(failures)) if published else out


def other_than_prose(judged: DataFrame, *columns: str) -> DataFrame:
    """The rows of lists, tables and junk, with ``columns`` and ``kind``.

    A generator drops the others: a filter would be pushed below the statistics
    and have all of them computed once more.
    """
    return judged.select(*columns, F.explode(F.filter(F.array("kind"), lambda k: k != "prose")).alias("kind"))
