"""Quality rules: a threshold table compiled into one projection of built-in expressions; no user functions.

Measures are named SQL expressions in layers, each layer a projection over the one before; a rule is a measure with a
least and a greatest value.  Rules become one boolean column each and ``kept`` their conjunction.

Repeated windows are found inside each row: word hashes are paired up to hashes of two, four and eight words, and only
where some window hash occurs twice are places sorted.  Hashes have 64 bits.

Defined cases: a null text counts as empty (no words, fails the length rule); ratios of a text without words are 0;
repeated rows each give a row; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that running text of English, German, French or Spanish holds many of.
STOP_WORDS = (
    "the of and to in a is that it for was on as with be by this are or an from at not which "
    "der die und das ist von mit zu den des im ein eine auf für nicht sich dem "
    "le la les de et des que en un une est pour dans par sur au pas qui "
    "el los las y se no una con por para del al lo"
).split()

_SPACE = r"[\\x20\\x09-\\x0D]+"

#: Measures by layer; a layer may use the names of those before it.
LAYERS: tuple[dict[str, str], ...] = (
    {
        "words": rf"filter(split(text, '{_SPACE}'), w -> w <> '')",
        "lines": r"filter(split(text, '\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')",
        "word_chars": rf"cast(char_length(regexp_replace(text, '{_SPACE}', '')) as bigint)",
        "n_symbols": "cast(char_length(text) - char_length(regexp_replace(text, '[#*$%&|<>]+', '')) as bigint)",
        "n_upper": r"cast(char_length(text) - char_length(regexp_replace(text, '\\p{Lu}+', '')) as bigint)",
    },
    {
        "n_words": "cast(size(words) as bigint)",
        "n_lines": "cast(size(lines) as bigint)",
        "n_dup_lines": "cast(size(lines) - size(array_distinct(lines)) as bigint)",
        "n_stop": f"cast(size(filter(words, w -> lower(w) in ({', '.join(repr(w) for w in sorted(set(STOP_WORDS)))}))) as bigint)",
        "hash1": "transform(words, w -> xxhash64(w))",
    },
    {
        "n_same": "cast(size(hash1) - size(filter(zip_with(hash1, slice(hash1, 2, greatest(size(hash1) - 1, 0)), (a, b) -> a = b), x -> x is null or not x)) as bigint)",
        "hash2": "zip_with(slice(hash1, 1, greatest(size(hash1) - 1, 0)), slice(hash1, 2, greatest(size(hash1) - 1, 0)), (a, b) -> xxhash64(a, b))",
    },
    {"hash4": "zip_with(slice(hash2, 1, greatest(size(hash2) - 2, 0)), slice(hash2, 3, greatest(size(hash2) - 2, 0)), (a, b) -> xxhash64(a, b))"},
    {"hash8": "zip_with(slice(hash4, 1, greatest(size(hash4) - 4, 0)), slice(hash4, 5, greatest(size(hash4) - 4, 0)), (a, b) -> xxhash64(a, b))"},
    {"repeats": "size(array_distinct(hash8)) < size(hash8)"},
    {"by_hash": "if(repeats, sort_array(transform(hash8, (h, i) -> struct(h as h, i as i))), null)"},
    {"starts": "if(repeats, sort_array(transform(filter(by_hash, (x, k) -> x.h = get(by_hash, k - 1).h or x.h = get(by_hash, k + 1).h), x -> x.i)), null)"},
    {"n_repeat_words": "cast(if(repeats, aggregate(transform(starts, (s, k) -> coalesce(least(8, get(starts, k + 1) - s), 8)), 0, (a, x) -> a + x), 0) as bigint)"},
    {
        "symbol_ratio": "coalesce(try_divide(n_symbols, n_words), 0)",
        "stop_ratio": "coalesce(try_divide(n_stop, n_words), 0)",
        "dup_line_ratio": "coalesce(try_divide(n_dup_lines, n_lines), 0)",
        "mean_word": "coalesce(try_divide(word_chars, n_words), 0)",
        "upper_ratio": "coalesce(try_divide(n_upper, word_chars), 0)",
        "same_ratio": "coalesce(try_divide(n_same, n_words), 0)",
        "base_failed": "n_words < 20 or 100 * n_repeat_words > 30 * n_words",
    },
)

#: Rule name, measure, least, greatest.
RULES: tuple[tuple[str, str, float | None, float | None], ...] = (
    ("symbols", "symbol_ratio", None, 0.1),
    ("stop_words", "stop_ratio", 0.06, None),
    ("duplicate_lines", "dup_line_ratio", None, 0.5),
    ("word_length", "mean_word", 3.0, 10.0),
    ("capitals", "upper_ratio", None, 0.3),
    ("stutter", "same_ratio", None, 0.2),
)


def rule_condition(measure: str, least: float | None, greatest: float | None):
    """A rule as a boolean expression."""
    met = F.lit(True)
    if least is not None:
        met = met & (F.col(measure) >= least)
    if greatest is not None:
        met = met & (F.col(measure) <= greatest)
    return met


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id with every measure of ``LAYERS``."""
    df = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    for layer in LAYERS:
        df = df.select("*", *(F.expr(sql).alias(name) for name, sql in layer.items()))
    return df


def quality_rules(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, counts, base_failed, kept and ``failed``, the names of the rules that the text breaks."""
    df = measured(docs, id_col, text_col)
    failed = F.array_compact(F.array(F.when(F.col("base_failed"), F.lit("base")), *(F.when(~rule_condition(m, lo, hi), F.lit(name)) for name, m, lo, hi in rules)))
    counts = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return df.select(*counts, failed.alias("failed")).select(*counts, (F.size("failed") == 0).alias("kept"), F.array_join("failed", ",").alias("failed"))
