"""Text scalar functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The English stop words that token removal leaves out.
STOP_WORDS = (
    "a an the and or but in on at to for of with by from is are was were be been being have has had do does did "
    "will would could should may might must shall can this that these those i you he she it we they"
).split()

# Scripts in order of precedence, with their character ranges.
SCRIPTS = {
    "Latin": "A-zÀ-ɏ",
    "Cyrillic": "Ѐ-ӿ",
    "Arabic": "؀-ۿ",
    "CJK": "一-鿿",
    "Hangul": "가-힯",
    "Devanagari": "ऀ-ॿ",
}

# Language codes with an English name.
LANGUAGE_NAMES = {
    "en": "English", "de": "German", "fr": "French", "es": "Spanish", "it": "Italian", "pt": "Portuguese", "nl": "Dutch",
    "pl": "Polish", "ru": "Russian", "ja": "Japanese", "zh": "Chinese", "ko": "Korean", "ar": "Arabic", "tr": "Turkish",
    "vi": "Vietnamese", "th": "Thai", "id": "Indonesian", "hi": "Hindi", "bn": "Bengali", "ta": "Tamil", "unknown": "Unknown",
}

#: Tags before and after a highlighted word, by style.
HIGHLIGHT_TAGS = {"mark": ("<mark>", "</mark>"), "terminal": ("\033[1;33m", "\033[0m"), "html": ('<span class="highlight">', "</span>"), "markdown": ("**", "**")}


#: The white space that (?U)\\s matches.
SPACES = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(c, F.lit(SPACES))


def normalise(c: Column) -> Column:
    """White space runs become one space, none at the ends; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def word_count(c: Column, normal: bool = False) -> Column:
    """Runs of characters other than white space; null has none. normal: c comes from normalise()."""
    if normal:
        return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit(""))) + (c != "").cast("int")
    parts = F.split(F.coalesce(c, F.lit("")), r"(?U)\s+")
    n = F.size(parts)
    # Only the first and the last part may be empty.
    return n - (F.get(parts, F.lit(0)) == "").cast("int") - ((n > 1) & (F.get(parts, n - 1) == "")).cast("int")


def tokens(c: Column, drop_stop_words: bool = False) -> Column:
    """Lower-cased runs of ASCII letters, digits and underscores; null has none."""
    t = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9_]+"), 0)
    return F.filter(t, lambda x: ~x.isin(STOP_WORDS)) if drop_stop_words else t


def token_text(c: Column) -> Column:
    """The tokens without stop words, joined by spaces."""
    return F.array_join(tokens(c, drop_stop_words=True), " ")


def text_stats(c: Column) -> Column:
    """Struct of char_count, token_count, unique_tokens and mean token length (0 without tokens)."""
    t = tokens(c)
    n = F.size(t)
    total = F.aggregate(t, F.lit(0), lambda s, x: s + F.length(x))
    return F.struct(
        F.length(F.coalesce(c, F.lit(""))).cast("long").alias("char_count"),
        n.cast("long").alias("token_count"),
        F.size(F.array_distinct(t)).cast("long").alias("unique_tokens"),
        F.when(n > 0, total / n).otherwise(F.lit(0.0)).alias("avg_token_length"),
    )


def content_hash(c: Column) -> Column:
    """SHA-256 of the lower-cased text without outer white space."""
    return F.sha2(strip(F.lower(F.coalesce(c, F.lit("")))), 256)


def shingles(c: Column, width: int = 3) -> Column:
    """Distinct character shingles of the lower-cased, stripped text; a shorter text is its own shingle, an empty one has none."""
    t = strip(F.lower(F.coalesce(c, F.lit(""))))
    n = F.length(t)
    many = F.regexp_extract_all(t, F.lit(f"(?s)(?=(.{{{width}}}))"), 1)  # overlapping runs in one pass over the text
    return F.when(n == 0, F.array().cast("array<string>")).when(n < width, F.array(t)).otherwise(F.array_distinct(many))


def cache_key(query: Column, **params: object) -> Column:
    """MD5 of the query and its parameters, by sorted name."""
    fixed = F.to_json(F.struct(*(F.lit(v).alias(k) for k, v in sorted(params.items())))) if params else F.lit("{}")
    return F.md5(F.concat(query, F.lit(":"), fixed))


def semantic_cache_key(query: Column) -> Column:
    return F.md5(strip(F.lower(query)))


def script(c: Column) -> Column:
    """The script with most characters among the first 500; ties in the order of SCRIPTS; null if none occurs."""
    head = F.substring(F.coalesce(c, F.lit("")), 1, 500)
    counts = {name: F.regexp_count(head, F.lit(f"[{chars}]")) for name, chars in SCRIPTS.items()}
    best = F.greatest(*counts.values())
    out = F.when(best == 0, F.lit(None).cast("string"))
    for name, n in counts.items():
        out = out.when(n == best, F.lit(name))
    return out


def language_name(code: Column) -> Column:
    """English name of a language code; upper-cased code where there is none."""
    names = F.create_map(*(F.lit(x) for kv in LANGUAGE_NAMES.items() for x in kv))
    return F.coalesce(F.try_element_at(names, code), F.upper(code))


def highlight(text: Column, query: Column, style: str = "mark", before: str | None = None, after: str | None = None) -> Column:
    """Whole words of the query, in any case, between tags; without query tokens the text is unchanged."""
    a, b = HIGHLIGHT_TAGS[style]
    a, b = before if before is not None else a, after if after is not None else b
    words = F.array_distinct(tokens(query))
    pattern = F.concat(F.lit(r"(?iU)\b("), F.array_join(words, "|"), F.lit(r")\b"))
    safe = lambda t: t.replace("\\", "\\\\").replace("$", "\\$")
    return F.when(F.size(words) == 0, text).otherwise(F.regexp_replace(text, pattern, F.lit(safe(a) + "$1" + safe(b))))


def preview(c: Column, n: int = 200) -> Column:
    """The first n characters, with an ellipsis if there are more."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)
