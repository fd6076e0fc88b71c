"""Scalar string functions (file names, text cleaning, snippets, URL encoding).

Every function returns a Spark ``Column`` built from built-in expressions, so
it stays inside whole-stage codegen. Each has a ``*_sql`` twin that writes the
same definition as DuckDB SQL for the oracle checks.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from ragloom import constants as C

WS = C.WS_CLASS


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _lit_sql(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# ---------------------------------------------------------------- whitespace

def py_strip(c) -> Column:
    """Python ``str.strip()``: remove leading/trailing Unicode whitespace."""
    return F.regexp_replace(_col(c), f"^{WS}+|{WS}+$", "")


def py_strip_sql(e: str) -> str:
    return f"regexp_replace({e}, '^{WS}+|{WS}+$', '', 'g')"


def collapse_ws(c) -> Column:
    """``re.sub(r"\\s+", " ", s)`` with Python's Unicode whitespace."""
    return F.regexp_replace(_col(c), f"{WS}+", " ")


def collapse_ws_sql(e: str) -> str:
    return f"regexp_replace({e}, '{WS}+', ' ', 'g')"


def is_blank(c) -> Column:
    """True when the text has no non-whitespace character (``not s.strip()``)."""
    return F.coalesce(~_col(c).rlike(f"[^\\t\\n\\x0B\\f\\r\\x1C-\\x1F\\x85\\p{{Z}}]"), F.lit(True))


def is_blank_sql(e: str) -> str:
    return f"coalesce(NOT regexp_matches({e}, '[^\\t\\n\\x0B\\f\\r\\x1C-\\x1F\\x85\\p{{Z}}]'), true)"


# ---------------------------------------------------------------- file names
# Extension as os.path.splitext sees a bare file name: the last ".suffix",
# provided some non-dot character comes before that dot.
_SPLITEXT = r"(?s)^(\.*[^.].*)(\.[^.]*)$"


def file_stem(c) -> Column:
    c = _col(c)
    return F.when(c.rlike(_SPLITEXT), F.regexp_extract(c, _SPLITEXT, 1)).otherwise(c)


def file_ext(c) -> Column:
    return F.regexp_extract(_col(c), _SPLITEXT, 2)


def file_stem_sql(e: str) -> str:
    return f"(CASE WHEN regexp_matches({e}, '{_SPLITEXT}') THEN regexp_extract({e}, '{_SPLITEXT}', 1) ELSE {e} END)"


def file_ext_sql(e: str) -> str:
    return f"regexp_extract({e}, '{_SPLITEXT}', 2)"


def _clean_stem(stem: Column) -> Column:
    return py_strip(collapse_ws(F.translate(stem, ",[]()", "")))


def _clean_stem_sql(stem: str) -> str:
    return py_strip_sql(collapse_ws_sql(f"translate({stem}, ',[]()', '')"))


def clean_filename(c) -> Column:
    """B1: drop commas and brackets from the stem, collapse and strip spaces, keep the extension."""
    return F.concat(_clean_stem(file_stem(c)), file_ext(c))


def clean_filename_sql(e: str) -> str:
    return f"({_clean_stem_sql(file_stem_sql(e))} || {file_ext_sql(e)})"


def file_hash(c) -> Column:
    """B2: SHA-256 of the cleaned name's UTF-8 bytes, as lowercase hex."""
    return F.sha2(clean_filename(c), 256)


def file_hash_sql(e: str) -> str:
    return f"sha256({clean_filename_sql(e)})"


def bounded_filename(c, max_length: int = C.MAX_FILE_NAME) -> Column:
    """Cleaned stem cut to ``max_length - len(ext)`` characters, extension re-added.

    A negative budget cuts from the end, as a negative slice bound does.
    """
    cleaned = clean_filename(c)
    stem, ext = file_stem(cleaned), file_ext(cleaned)
    budget = F.lit(max_length) - F.length(ext)
    keep = F.when(budget >= 0, budget).otherwise(F.greatest(F.length(stem) + budget, F.lit(0)))
    return F.concat(F.left(stem, keep), ext)


def bounded_filename_sql(e: str, max_length: int = C.MAX_FILE_NAME) -> str:
    cleaned = clean_filename_sql(e)
    stem, ext = file_stem_sql(cleaned), file_ext_sql(cleaned)
    budget = f"({max_length} - length({ext}))"
    keep = f"(CASE WHEN {budget} >= 0 THEN {budget} ELSE greatest(length({stem}) + {budget}, 0) END)"
    return f"(left({stem}, {keep}) || {ext})"


# ---------------------------------------------------------------- chunk text

def clean_text(c) -> Column:
    """Delete NUL, newline and tab become a space; nothing else changes."""
    return F.translate(_col(c), "\n\t\x00", "  ")


def clean_text_sql(e: str) -> str:
    return f"translate({e}, chr(10) || chr(9), '  ')"


def squash_ws(c) -> Column:
    """``" ".join(s.split())``: whitespace runs become one space, ends stripped, case kept."""
    return py_strip(collapse_ws(_col(c)))


def squash_ws_sql(e: str) -> str:
    return py_strip_sql(collapse_ws_sql(e))


def normalize(c) -> Column:
    """``" ".join(s.strip().lower().split())``."""
    return py_strip(collapse_ws(F.lower(_col(c))))


def normalize_sql(e: str) -> str:
    return py_strip_sql(collapse_ws_sql(f"lower({e})"))


def clean_snippet(c) -> Column:
    """Newline->space, split letters from following digits, lower, de-hyphenate,
    drop three characters at each end, strip."""
    s = F.regexp_replace(_col(c), "\n", " ")
    s = F.regexp_replace(s, r"([a-zA-Z]+)(\p{Nd}+)", "$1 $2")
    s = F.replace(F.lower(s), F.lit("- "), F.lit(""))
    n = F.length(s)
    s = F.when(n > 6, F.substring(s, 4, 2147483647)).otherwise(F.lit(""))
    s = F.when(n > 6, F.left(s, n - 6)).otherwise(s)
    return py_strip(s)


def clean_snippet_sql(e: str) -> str:
    s = f"replace({e}, chr(10), ' ')"
    s = f"regexp_replace({s}, '([a-zA-Z]+)(\\p{{Nd}}+)', '\\1 \\2', 'g')"
    s = f"replace(lower({s}), '- ', '')"
    s = f"(CASE WHEN length({s}) > 6 THEN substring({s}, 4, length({s}) - 6) ELSE '' END)"
    return py_strip_sql(s)


def url_quote(c, keep_slash: bool = False) -> Column:
    """Percent-encoding of UTF-8 bytes keeping only ``A-Za-z0-9_.-~`` (and ``/`` if asked)."""
    s = F.url_encode(_col(c))
    s = F.replace(s, F.lit("+"), F.lit("%20"))
    s = F.replace(s, F.lit("*"), F.lit("%2A"))
    s = F.replace(s, F.lit("%7E"), F.lit("~"))
    if keep_slash:
        s = F.replace(s, F.lit("%2F"), F.lit("/"))
    return s


def url_quote_sql(e: str, keep_slash: bool = False) -> str:
    s = f"url_encode({e})"
    return f"replace({s}, '%2F', '/')" if keep_slash else s


def double_url_encode(c) -> Column:
    """The snippet quoted twice with nothing kept safe."""
    return url_quote(url_quote(c))


def double_url_encode_sql(e: str) -> str:
    return url_quote_sql(url_quote_sql(e))


def short_title(c) -> Column:
    """First 70 characters plus an ellipsis, always."""
    return F.concat(F.left(_col(c), F.lit(C.TITLE_CHARS)), F.lit("..."))


def short_title_sql(e: str) -> str:
    return f"(left({e}, {C.TITLE_CHARS}) || '...')"


# ---------------------------------------------------------------- language

def language_config(code) -> Column:
    """Detected language code -> text search configuration, ``simple`` otherwise."""
    pairs = []
    for k, v in C.LANGUAGE_CONFIG.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), _col(code)), F.lit(C.FALLBACK_CONFIG))


def language_config_sql(e: str) -> str:
    whens = " ".join(f"WHEN {_lit_sql(k)} THEN {_lit_sql(v)}" for k, v in C.LANGUAGE_CONFIG.items())
    return f"(CASE {e} {whens} ELSE '{C.FALLBACK_CONFIG}' END)"


# ---------------------------------------------------------------- accents
# Accent folding table, generated by a rule: every Latin letter in U+00C0..U+024F
# whose canonical decomposition is one ASCII letter plus combining marks maps to
# that letter. Letters without such a decomposition are listed explicitly.

def _build_fold_table():
    src, dst = [], []
    for cp in range(0x00C0, 0x0250):
        ch = chr(cp)
        base = unicodedata.normalize("NFD", ch)
        if len(base) > 1 and base[0].isascii() and base[0].isalpha() and all(
            unicodedata.combining(x) for x in base[1:]
        ):
            src.append(ch)
            dst.append(base[0])
    # fixed values: single letters folded without a decomposition
    for a, b in (("Ø", "O"), ("ø", "o"), ("Đ", "D"), ("đ", "d"), ("Ł", "L"), ("ł", "l"),
                 ("Ð", "D"), ("ð", "d"), ("Ħ", "H"), ("ħ", "h"), ("ı", "i")):
        src.append(a)
        dst.append(b)
    return "".join(src), "".join(dst)


FOLD_FROM, FOLD_TO = _build_fold_table()
# fixed values: letters folded to two characters
FOLD_MULTI = (("ß", "ss"), ("Æ", "AE"), ("æ", "ae"), ("Œ", "OE"), ("œ", "oe"), ("Þ", "TH"), ("þ", "th"))


def unaccent(c) -> Column:
    """fold accented Latin letters to their base letters."""
    s = F.translate(_col(c), FOLD_FROM, FOLD_TO)
    for a, b in FOLD_MULTI:
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def unaccent_sql(e: str) -> str:
    s = f"translate({e}, {_lit_sql(FOLD_FROM)}, {_lit_sql(FOLD_TO)})"
    for a, b in FOLD_MULTI:
        s = f"replace({s}, {_lit_sql(a)}, {_lit_sql(b)})"
    return s


# ---------------------------------------------------------------- tokens

def tokens(c, fold_accents: bool) -> Column:
    """Lower-cased tokens of letters and digits, in text order, empty ones removed."""
    s = F.lower(unaccent(c) if fold_accents else _col(c))
    s = F.regexp_replace(s, "^" + C.TOKEN_SPLIT, "")
    return F.filter(F.split(s, C.TOKEN_SPLIT), lambda t: t != F.lit(""))


def tokens_sql(e: str, fold_accents: bool) -> str:
    s = f"lower({unaccent_sql(e) if fold_accents else e})"
    s = f"regexp_replace({s}, '^{C.TOKEN_SPLIT}', '')"
    return f"list_filter(regexp_split_to_array({s}, '{C.TOKEN_SPLIT}'), lambda t: t <> '')"
