"""String functions over columns: spaces, accents, keys, tokens, rewriting and answer cleaning.

Lengths count code points. Patterns are Unicode-aware where words or white space
of any script matter. None of these functions run Python on the executors.
"""

from __future__ import annotations

import itertools
import sys
import unicodedata
from collections.abc import Callable
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

_SPACE = r"(?U)[\s\x1c-\x1f]+"
#: The same characters one by one.
_WHITE = "".join(filter(str.isspace, map(chr, range(0x3001))))


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of a column that f uses more than once: as a lambda's variable it is computed once."""
    return F.element_at(F.transform(F.array(c), f), 1)


def text_or_empty(c: Column | str) -> Column:
    """The text without white space around it; null is empty."""
    return strip(F.coalesce(_col(c).cast("string"), F.lit("")))


def strip(c: Column | str) -> Column:
    return F.btrim(_col(c), F.lit(_WHITE))


def first_text(*cs: Column | str) -> Column:
    """The first of the columns that isn't blank, stripped; empty if all are."""
    return F.coalesce(*(F.nullif(text_or_empty(c), F.lit("")) for c in cs), F.lit(""))


def normalize_spaces(c: Column | str) -> Column:
    """White space of any script as single spaces, none at either end; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(_col(c), F.lit("")), _SPACE, " "))


@cache
def _accents() -> tuple[str, str]:
    """Characters of the basic plane that are one base character with marks, and those bases."""
    found = {}
    for i in range(0x80, min(sys.maxunicode, 0xFFFF) + 1):
        c = chr(i)
        if 0xD800 <= i <= 0xDFFF or unicodedata.category(c) == "Mn":
            continue
        base = [x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn"]
        if len(base) == 1 and base[0] != c:
            found[c] = base[0]
    return "".join(found), "".join(found.values())


def strip_accents(c: Column | str) -> Column:
    """Without combining marks; the stroked d stays."""
    return F.translate(F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"\p{Mn}+", ""), *_accents())


def strip_diacritics(c: Column | str) -> Column:
    """Without combining marks, and with a plain d for the stroked one."""
    source, target = _accents()
    return F.translate(F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"\p{Mn}+", ""), source + "đĐ", target + "dD")


@cache
def _vietnamese_letters() -> str:
    """The accented letters of Vietnamese: each vowel with each tone, without plain letters."""
    vowels, tones = "aăâeêioôơuưy", ["", "\u0300", "\u0301", "\u0323", "\u0309", "\u0303"]
    letters = {unicodedata.normalize("NFC", v + t) for v, t in itertools.product(vowels, tones)} - set("aeiouy") | {"đ"}
    return "".join(sorted(letters | {x.upper() for x in letters}))


def has_vietnamese_accent(c: Column | str) -> Column:
    return F.coalesce(_col(c), F.lit("")).rlike(f"[{_vietnamese_letters()}]")


def slug(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(strip_diacritics(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def lookup_key(c: Column | str) -> Column:
    """A keyword's key: plain lower-case words without the usual endings, each cut off once, in order."""
    key = F.lower(normalize_spaces(c))
    key = normalize_spaces(F.regexp_replace(strip_diacritics(key), r"(?U)[^a-z0-9\s]+", " "))
    for ending in fixed.KEY_SUFFIXES:
        key = F.trim(F.regexp_replace(key, f"{ending}$", ""))
    return key


def loose_key(c: Column | str) -> Column:
    """Lower-cased with single spaces; texts must be composed (NFC): see ``readers.composed``."""
    return F.lower(normalize_spaces(c))


def matching_key(c: Column | str) -> Column:
    return normalize_spaces(F.regexp_replace(F.lower(strip_diacritics(c)), r"(?U)[^a-z0-9\s]+", " "))


def words_of(key: Column) -> Column:
    """The words of a key with single spaces; an empty key has none."""
    return F.when(key == "", F.array().cast("array<string>")).otherwise(F.split(key, " "))


def _strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def token_set(c: Column | str) -> Column:
    """Distinct words of a text without accents and stop words, sorted."""
    return F.array_sort(F.array_except(F.array_distinct(words_of(matching_key(c))), _strings(fixed.STOP_WORDS)))


def is_broad_new_year_question(c: Column | str) -> Column:
    tokens = token_set(c)
    return F.array_contains(tokens, "tet") & ~F.arrays_overlap(tokens, _strings(fixed.FOOD_TERMS))


def subject_words(c: Column | str) -> Column:
    """Letters and digits of a text in plain lower case, as a list of runs; a stroked d parts them."""
    plain = strip_accents(F.lower(F.coalesce(_col(c), F.lit(""))))
    return F.regexp_extract_all(F.translate(plain, "_-", "  "), F.lit("[a-z0-9]+"), F.lit(0))


def keyword_subject(c: Column | str) -> Column:
    """The words of a keyword that name its subject: all of one or two, else those that aren't stop words."""
    words = subject_words(c)
    telling = F.filter(words, lambda w: ~w.isin(fixed.SUBJECT_STOP_WORDS))
    return F.when(F.size(words) <= 2, words).when(F.size(telling) > 0, telling).otherwise(words)


def names_subject(keyword: Column | str, question: Column | str) -> Column:
    """Whether a question has enough words of a keyword's subject: one of one, else two, repeats counted."""
    subject, asked = keyword_subject(keyword), subject_words(question)
    found = F.size(F.filter(subject, lambda w: F.array_contains(asked, w)))
    return (F.size(subject) > 0) & (F.size(asked) > 0) & (found >= F.when(F.size(subject) == 1, 1).otherwise(2))


def capitalize_first(c: Column | str) -> Column:
    return F.concat(F.upper(F.substring(_col(c), 1, 1)), F.substring(_col(c), 2, 1 << 30))


def rewrite_rule(question: Column | str) -> Column:
    """The number of the first rewriting rule whose pattern a question starts with, or null."""
    q = _col(question)
    return reduce(lambda chain, rule: chain.when(q.rlike(f"(?U){rule[1][0]}"), rule[0]), enumerate(fixed.REWRITE_RULES[1:], 1), F.when(q.rlike(f"(?U){fixed.REWRITE_RULES[0][0]}"), 0))


def rewrite_question(keyword: Column | str, question: Column | str) -> Column:
    """The question with its keyword in place of what points at a picture; null if no rule applies.

    No rule applies where either is empty or the question has the keyword already.
    """
    k, q = _col(keyword), _col(question)
    parts = []
    for pattern, form in fixed.REWRITE_RULES:
        before, after = form.split("{keyword}")
        rest = F.substr(q, F.char_length(F.regexp_extract(q, f"(?U){pattern}", 0)) + 1)
        parts.append((q.rlike(f"(?U){pattern}"), F.concat(F.lit(before), k, F.lit(after), rest)))
    chain = F.when(parts[0][0], parts[0][1])
    for when, then in parts[1:]:
        chain = chain.when(when, then)
    usable = (k != "") & (q != "") & ~F.contains(F.lower(q), F.lower(k))
    return F.when(usable, once(chain, capitalize_first))


def replace_keyword(text: Column | str, raw: Column | str, normalized: Column | str) -> Column:
    """A text with a keyword, and then its lookup key, replaced whatever their letter case; then capitalized."""
    literal = lambda c: F.concat(F.lit("(?iu)"), F.regexp_replace(c, r"([^\p{L}\p{N}\s])", r"\\$1"))
    into = lambda n: F.regexp_replace(n, r"([\\$])", r"\\$1")

    def replaced(t: Column, r: Column, n: Column) -> Column:
        first = F.regexp_replace(t, literal(r), into(n))
        second = once(lookup_key(r), lambda key: F.when((key != "") & (key != F.lower(r)), F.regexp_replace(first, literal(key), into(n))).otherwise(first))
        return F.when((t == "") | (r == "") | (r == n), t).otherwise(once(second, capitalize_first))

    given = F.struct(F.coalesce(_col(text), F.lit("")).alias("t"), normalize_spaces(raw).alias("r"), normalize_spaces(normalized).alias("n"))
    return once(given, lambda g: replaced(g["t"], g["r"], g["n"]))


def word_count(c: Column | str) -> Column:
    return F.size(words_of(normalize_spaces(c)))


def char_count(c: Column | str) -> Column:
    return F.char_length(text_or_empty(c))


def short_hash(c: Column | str, n: int = 12) -> Column:
    return F.substring(F.sha1(normalize_spaces(c).cast("binary")), 1, n)


def rewrite_key(caption: Column | str, question: Column | str) -> Column:
    return F.sha1(F.concat_ws("||", normalize_spaces(caption), normalize_spaces(question)).cast("binary"))


def keyword_matches(actual: Column | str, expected: Column | str) -> Column:
    """Equal in loose form, or a narrower one that starts with the expected words."""
    a, e = loose_key(actual), loose_key(expected)
    return (e != "") & ((a == e) | F.startswith(a, F.concat(e, F.lit(" "))))


def category_matches(actual: Column | str, expected: Column | str) -> Column:
    a, e = loose_key(actual), loose_key(expected)
    return (e != "") & (a == e)


def error_type(expected: Column | str, retrieved: Column | str) -> Column:
    """Why a keyword was missed, judged by the keyword of the best hit."""
    e, t = loose_key(expected), loose_key(retrieved)
    return (
        F.when(t == "", "no_retrieved_keyword")
        .when((e != "") & (F.contains(t, e) | F.contains(e, t)), "keyword_variant_or_parent_child")
        .when(F.arrays_overlap(words_of(e), words_of(t)), "same_keyword_family")
        .otherwise("semantic_neighbor")
    )


def strip_code_fence(c: Column | str) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(strip(_col(c)), r"^```(?:json)?\s*", ""), r"\s*```$", ""))


def clean_optional(c: Column | str) -> Column:
    return F.nullif(strip(_col(c)), F.lit(""))


def escape_html(c: Column | str) -> Column:
    out = _col(c)
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def percent(c: Column | str) -> Column:
    return F.when(_col(c).isNull(), "N/A").otherwise(F.format_string("%.2f%%", _col(c).cast("double") * 100))


def preview(c: Column | str, n: int = 180) -> Column:
    return F.substring(_col(c), 1, n)


def path_tail(c: Column | str, n: int = 3) -> Column:
    parts = F.filter(F.split(F.replace(_col(c), F.lit("\\"), F.lit("/")), "/"), lambda p: p != "")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - n + 1, F.lit(1)), n), "/")


def _ignoring_case(pattern: str) -> str:
    return f"(?iuU){pattern}"


def _trim_marks(c: Column) -> Column:
    return F.regexp_replace(normalize_spaces(c), r"^[ ,;:\-]+|[ ,;:\-]+$", "")


def _without_phrases(c: Column) -> Column:
    for pattern in fixed.VISUAL_PHRASES:
        c = F.regexp_replace(c, _ignoring_case(pattern), "")
    return c


def _clean_sentence(s: Column) -> Column:
    s = strip(F.regexp_replace(strip(s), _ignoring_case(fixed.LEADING_VISUAL), ""))
    s = _trim_marks(_without_phrases(s))
    s = strip(F.regexp_replace(s, _ignoring_case(fixed.LEADING_CLASSIFIER), ""))
    return strip(F.regexp_replace(s, _ignoring_case(fixed.APPOSITION), fixed.APPOSITION_AS))


def sanitize_answer(c: Column | str) -> Column:
    """An answer without talk of pictures: sentence by sentence, and whole if no sentence is left."""
    return once(text_or_empty(c), _sanitized)


def _sanitized(answer: Column) -> Column:
    sentences = F.split(F.replace(answer, F.lit("\n"), F.lit(" ")), rf"(?U)(?<=[{fixed.SENTENCE_ENDS}])\s+")
    kept = F.filter(F.transform(F.transform(sentences, _clean_sentence), capitalize_first), lambda s: (s != "") & ~s.rlike(_ignoring_case(fixed.VISUAL_TERMS)))
    joined = F.regexp_replace(F.regexp_replace(F.array_join(kept, " "), r"(?U)\s+([,.!?])", "$1"), r"\.{2,}", ".")
    whole = _trim_marks(_without_phrases(strip(F.regexp_replace(answer, _ignoring_case(fixed.LEADING_VISUAL), ""))))
    return once(joined, lambda j: F.when(j != "", j).otherwise(whole))


def postprocess_answer(c: Column | str) -> Column:
    """``sanitize_answer`` after taking off what announces an answer."""
    out = text_or_empty(c)
    for prefix in fixed.ANSWER_PREFIXES:
        out = F.when(F.startswith(out, F.lit(prefix)), strip(F.substring(out, len(prefix) + 1, 1 << 30))).otherwise(out)
    return sanitize_answer(out)


def complete_sentences(c: Column | str) -> Column:
    """(done, rest): a text cut after the last end of a sentence that white space follows."""
    pattern = rf"(?sU)^(.*[{fixed.SENTENCE_ENDS}]\s+)(.*)$"
    t = F.coalesce(_col(c), F.lit(""))
    return F.when(t.rlike(pattern), F.struct(F.regexp_extract(t, pattern, 1).alias("done"), F.regexp_extract(t, pattern, 2).alias("rest"))).otherwise(F.struct(F.lit("").alias("done"), t.alias("rest")))


def display_chunks(c: Column | str, leading_space: bool = False) -> Column:
    """The words of a text, each with a space before it but the first, which has one if asked for."""
    return F.transform(words_of(normalize_spaces(c)), lambda w, i: F.when((i == 0) & F.lit(not leading_space), w).otherwise(F.concat(F.lit(" "), w)))
