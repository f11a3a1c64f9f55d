"""Scalar text kernels as Column -> Column functions; all of them stay in the JVM but for `nfc`.

Lengths count characters. White space is the ASCII kind, and so are the word characters that bound a word in a pattern: look-arounds for \\w
say so, as \\b means letters of all scripts to some Java versions and ASCII to others and to SQL. A null text gives null unless a function says otherwise.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

INDIC = "ऀ-ॿঀ-৿਀-੿઀-૿଀-୿஀-௿ఀ-౿ಀ-೿ഀ-ൿ"
NON_LATIN = "ऀ-෿᳐-᳿꣠-ꣿ؀-ۿݐ-ݿࢠ-ࣿ"
SCRIPTS = {
    "devanagari": ("ऀ-ॿ꣠-ꣿ", "Deva", ["hi", "sa"]),
    "tamil": ("஀-௿", "Taml", ["ta"]),
    "telugu": ("ఀ-౿", "Telu", ["te"]),
    "bengali": ("ঀ-৿", "Beng", ["bn"]),
    "arabic": ("؀-ۿ", "Arab", ["ur"]),
}
STOPWORDS = (
    "a an and are as at be by can define do explain for from give how i in is it me of on or show tell that the this "
    "to what where which who why with you your"
).split()
FURNITURE = "issn|www\\.|http|volume|issue|journal"
SECTIONS = "introduction|materials|methods|results|discussion|conclusion|references|abstract"
ROW_LABELS = "appearance|colour|color|consistency|temperature|total loss|loss|odour|odor|taste|hardness|breakable|soft|weight|ph"

_DROPPED = "­​‌‍﻿"
_SPELLED = {"…": "...", "ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st"}
_PLAIN_FROM, _PLAIN_TO = " ’‘“”–—", " ''\"\"--"
_MARKED, _BARE = "āīūēōṣśḥṃṭḍṇñṅṉṛṟḷḻẓ", "aiueosshmtdnnnnrrllz"
_LATIN_FROM = "àáäãåèéëìíïòóöõøùúüýÿçśšźžżłÀÁÄÃÅÈÉËÌÍÏÒÓÖÕØÙÚÜÇ"
_LATIN_TO = "aaaaaeeeiiiooooouuuyycsszzzlAAAAAEEEIIIOOOOOUUUC"


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Canonical composition, which has no built-in counterpart."""
    return text.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is computed once a row however often `use` names it. A plain expression is computed at each place."""
    return F.element_at(F.transform(F.array(value), use), 1)


def compact(text: Column) -> Column:
    """White space runs as one blank, none at the ends. Single blanks are no match, as most of a text's white space is such."""
    return F.trim(F.regexp_replace(text, r"[\t\n\x0B\f\r]\s*| \s+", " "))


def foreign(text: Column) -> Column:
    """The characters beyond ASCII."""
    return F.regexp_replace(text, r"[\x00-\x7f]+", "")


def others(text: Column, beyond: Column, ascii_kept: str, kept: str) -> Column:
    """Number of characters in neither class; `beyond` is foreign(text). Classes of ASCII alone are matched much faster."""
    plain = F.regexp_replace(text, f"[\\x{{80}}-\\x{{10ffff}}{ascii_kept}]+", "")
    return F.length(plain) + F.length(F.regexp_replace(beyond, f"[{kept}]+", ""))


def matches(text: Column, pattern: str) -> Column:
    """Whether the pattern is found anywhere."""
    return text.rlike(pattern)


def share(text: Column, kept: str) -> Column:
    """Number of characters of the class `kept`."""
    return F.length(text) - F.length(F.regexp_replace(text, f"[{kept}]+", ""))


def word_list(text: Column) -> Column:
    """Words between white space; none for an empty text."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(word_list(text))


def normalize_text(text: Column, latin_fold: bool = False, composed: bool = False) -> Column:
    """Search form: typographic marks, ligatures and transliteration diacritics become plain. Null gives ''.

    `composed`: the input is known to be in composed form, which saves the only Python step."""
    out = F.coalesce(text, F.lit(""))
    if not composed:
        # Plain ASCII is in composed form already. It goes to Python as null: a branch wouldn't keep it from being sent.
        out = F.coalesce(nfc(F.when(out.rlike(r"[^\x00-\x7f]"), out)), out)
    out = F.translate(out, _PLAIN_FROM + _DROPPED, _PLAIN_TO)
    out = reduce(lambda t, kv: F.replace(t, F.lit(kv[0]), F.lit(kv[1])), _SPELLED.items(), out)
    # The pairs of a retroflex letter and h fold like the letter alone.
    out = F.translate(out, _MARKED + _MARKED.upper(), _BARE + _BARE.upper())
    if latin_fold:
        out = F.translate(out, _LATIN_FROM, _LATIN_TO)
    return F.regexp_replace(out, r"\s+\\\s+", " ")


def detect_script(text: Column) -> Column:
    """Script of the first character that belongs to a known one, else latin."""
    first = F.regexp_extract(F.coalesce(text, F.lit("")), "[" + "".join(s[0] for s in SCRIPTS.values()) + "]", 0)

    def named(char: Column) -> Column:
        out = F.lit("latin")
        for name, (chars, _, _) in SCRIPTS.items():
            out = F.when(char.rlike(f"[{chars}]"), name).otherwise(out)
        return out

    return let(first, named)


def script_code(script: Column) -> Column:
    out = F.when(script == "latin", "Latn").otherwise("Zyyy")
    for name, (_, code, _) in SCRIPTS.items():
        out = F.when(script == name, code).otherwise(out)
    return out


def script_languages(script: Column) -> Column:
    out = F.when(script == "latin", F.array(F.lit("en"))).otherwise(F.array(F.lit("unknown")))
    for name, (_, _, languages) in SCRIPTS.items():
        out = F.when(script == name, F.array(*map(F.lit, languages))).otherwise(out)
    return out


def snippet(text: Column, limit: int = 320) -> Column:
    flat = compact(F.coalesce(text, F.lit("")))
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, limit - 3)), F.lit("...")))


def keywords(text: Column) -> Column:
    """Distinct words of three letters or more that are no stopwords or numbers, with naive singular forms, sorted."""
    found = F.filter(
        F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)),
        lambda w: (F.length(w) >= 3) & ~w.isin(STOPWORDS) & ~w.rlike(r"^\p{Nd}+$"),
    )
    short = F.transform(F.filter(found, lambda w: F.endswith(w, F.lit("s")) & (F.length(w) >= 5)), lambda w: F.left(w, F.length(w) - 1))
    shorter = F.transform(F.filter(found, lambda w: F.endswith(w, F.lit("es")) & (F.length(w) >= 6)), lambda w: F.left(w, F.length(w) - 2))
    return F.array_sort(F.array_distinct(F.concat(found, short, shorter)))


def is_garbled(text: Column) -> Column:
    """Many odd symbols, or marks of a wrong decoding in a text of no Indic or Arabic script."""

    def judged(t: Column, beyond: Column) -> Column:
        odd = others(t, beyond, r"A-Za-z0-9\s|.,;:!?()\[\]{}'\"/-", r"\p{L}\p{N}\p{M}।॥")
        marks = "Ã[ƒ‚]|ï¿½|�"
        wrong = beyond.rlike(marks) & t.rlike(marks) & ~beyond.rlike("[ऀ-ॿ؀-ۿఀ-౿]")
        return (F.length(t) >= 5) & ((odd / F.length(t) > 0.30) | wrong)

    return let(F.trim(F.coalesce(text, F.lit(""))), lambda t: let(foreign(t), lambda beyond: judged(t, beyond)))


def is_non_latin(text: Column) -> Column:
    flat = compact(F.coalesce(text, F.lit("")))

    def foreign(flat: Column, letters: Column) -> Column:
        some = F.length(F.regexp_replace(letters, f"[^{NON_LATIN}]+", ""))
        return (F.length(flat) >= 5) & (F.length(letters) > 0) & (some / F.greatest(F.length(letters), F.lit(1)) >= 0.20)

    return let(flat, lambda f: let(F.regexp_replace(f, r"[^\p{L}]+", ""), lambda letters: foreign(f, letters)))


#: A word with a letter and two word characters, whose part between its first and last word character holds no mojibake.
_MEANINGFUL = r"(?<!\S)(?=\S*\p{L})(?=\S*?[\p{L}\p{N}_]\S*?[\p{L}\p{N}_])(?!\S*(?:[ÃÂï]\S*[\p{L}\p{N}_]|à[¤¥¦¨]\S*[\p{L}\p{N}_]|à[ª³]))\S+"


#: Of a compact text with a blank before it: a blank is found much faster than a place without a character before it is told.
#: Words without a letter, or whose only word character is a letter: those that aren't meaningful where no mojibake is.
_EMPTY = r" (?:[^\s\p{L}]++|[^\s\p{L}\p{N}_]*+\p{L}[^\s\p{L}\p{N}_]*+)(?!\S)"


def _measures(flat: Column, beyond: Column) -> dict[str, Column]:
    """quality of a compact text and its foreign characters, which are columns or lets."""
    chars = F.greatest(F.length(flat), F.lit(1))
    words = F.when(flat == "", 0).otherwise(F.length(flat) - F.length(F.replace(flat, F.lit(" "), F.lit(""))) + 1)
    n = F.greatest(words, F.lit(1))
    odd = others(flat, beyond, r"A-Za-z0-9\s.,:;!?()\[\]{}'\"/_%+&*#$=|-", r"\p{L}\p{N}\p{M}°₹।॥")
    # Words are counted by one scan of the text, with what a word must hold as look-ahead from the blank before it.
    padded = F.concat(F.lit(" "), flat)
    suspect = beyond.rlike("[ÃÂï]|à[¤¥¦¨ª³]")
    meaningful = F.when(suspect, F.regexp_count(padded, F.lit(_MEANINGFUL.replace(r"(?<!\S)", " ", 1)))).otherwise(words - F.regexp_count(padded, F.lit(_EMPTY)))
    mixed = F.regexp_count(padded, F.lit(rf" (?=[^\s\x{{80}}-\x{{10ffff}}]*+[^\x00-\x7f])(?=\S*[A-Za-z])(?!\S*[{INDIC}])\S+"))
    return {
        "symbol_ratio": odd / chars,
        "non_ascii_ratio": F.length(beyond) / chars,
        "indic_ratio": share(beyond, INDIC) / chars,
        "mojibake_ratio": F.when(suspect, F.regexp_count(flat, F.lit("[ÃÂï].|à[¤¥¦¨ª³]"))).otherwise(0) / chars,
        "mixed_ratio": F.when(beyond != "", mixed).otherwise(0) / n,
        "meaningful_ratio": meaningful / n,
        "too_short": F.length(flat) < 40,
    }


def quality(text: Column) -> Column:
    """The measures that decide whether a page's text is usable, as a struct."""
    measured = lambda flat, beyond: F.struct(*(c.alias(name) for name, c in _measures(flat, beyond).items()))
    return let(compact(F.coalesce(text, F.lit(""))), lambda flat: let(foreign(flat), lambda beyond: measured(flat, beyond)))


def looks_like_index(text: Column) -> Column:
    """Three lines or more, two of them short entries with a number in front, two with a page range."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), compact), lambda x: x != "")

    def listed(lines: Column) -> Column:
        ranges = F.size(F.filter(lines, lambda x: x.rlike(r"(?<!\w)\d{1,4}\s*-\s*\d{1,4}(?!\w)")))
        entries = F.size(F.filter(lines, lambda x: x.rlike(r"^\d{1,3}(?!\w)") & (word_count(x) <= 8)))
        return (F.size(lines) >= 3) & (entries >= 2) & (ranges >= 2)

    # Most texts hold no range at all, so that their lines needn't be parted.
    return F.coalesce(text, F.lit("")).rlike(r"\d\s*-\s*\d") & let(lines, listed)


def ocr_reason(text: Column) -> Column:
    """Why a page's text must be read anew, or why not (native_good, index_like_native)."""

    def listed(q: Column) -> Column:
        reasons = F.array(
            F.when(q["too_short"], "too_short"),
            F.when(q["mojibake_ratio"] > 0.08, "mojibake_like"),
            F.when(q["mixed_ratio"] > 0.10, "legacy_mixed_tokens"),
            F.when((q["non_ascii_ratio"] > 0.55) & (q["indic_ratio"] < 0.10), "high_non_ascii_ratio"),
            F.when(q["meaningful_ratio"] < 0.45, "low_meaningful_words"),
            F.when(q["symbol_ratio"] > 0.30, "high_symbol_ratio"),
            F.when(q["symbol_ratio"] > 0.15, "symbol_regex_hit"),
        )
        return let(F.array_join(F.array_compact(reasons), ","), lambda r: F.when(r != "", F.concat(F.lit("quality:"), r)).otherwise("native_good"))

    def reason(t: Column) -> Column:
        return (
            F.when(t == "", "empty_native")
            .when(looks_like_index(t), "index_like_native")
            .when(is_garbled(t), "parser_garbled")
            .otherwise(let(quality(t), listed))
        )

    return let(F.trim(F.coalesce(text, F.lit(""))), reason)


def page_type(text: Column, image_ratio: Column, reason: Column | None = None) -> Column:
    """scanned, blank, digitized or ocr_fallback; `reason`: the text's ocr_reason, where it is at hand."""
    t = F.trim(F.coalesce(text, F.lit("")))
    heavy, reason = image_ratio >= 0.75, ocr_reason(t) if reason is None else reason
    return (
        F.when((F.length(t) < 40) & heavy, "scanned")
        .when((t == "") & ~heavy, "blank")
        .when(reason.isin("native_good", "index_like_native"), "digitized")
        .when(t != "", "ocr_fallback")
        .otherwise("scanned")
    )


def clean_lines(text: Column) -> Column:
    """Compact non-empty lines, without a journal's running footers and funding notes."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), compact)
    low = F.lower
    kept = F.filter(
        lines,
        lambda x: (x != "")
        & ~(low(x).rlike(r"(?<!\w)www\.ijaar\.in(?!\w)") & low(x).contains("volume") & low(x).contains("issue"))
        & ~low(x).rlike(r"^\d{1,4}\s+www\.ijaar\.in(?!\w)")
        & ~low(x).rlike("conflict of interest|source of support|financial support"),
    )
    return F.array_join(kept, "\n")


def numbers(flat: Column) -> Column:
    return F.regexp_count(flat, F.lit(r"\d+(?:\.\d+)?"))


SERIAL = r"^\d{1,3}[.)]?\s+"


def _words_of(flat: Column) -> Column:
    """Number of words of a compact text that isn't empty."""
    return F.length(flat) - F.length(F.replace(flat, F.lit(" "), F.lit(""))) + 1


def is_table_row(text: Column, exempt_sections: bool = False) -> Column:
    """The builder's test; with `exempt_sections` the native parser's, which spares numbered section titles."""

    def row(flat: Column, n: Column) -> Column:
        # The patterns begin the text and need no more of it than this.
        low, serial = F.lower(F.left(flat, F.lit(64))), flat.rlike(SERIAL)
        spared = low.rlike(SERIAL + f"({SECTIONS})") if exempt_sections else F.lit(False)
        return (flat != "") & (
            low.rlike(r"^(table |table no|s\.no|sample no)") | ((n <= 12) & ~spared & ((serial & ((n <= 4) | (numbers(flat) >= 2))) | (numbers(flat) >= 3)))
        )

    return let(compact(F.coalesce(text, F.lit(""))), lambda flat: let(_words_of(flat), lambda n: row(flat, n)))


def is_loose_table_row(text: Column) -> Column:
    """The chunker's test."""

    def row(flat: Column, n: Column) -> Column:
        low = F.lower(flat)
        alphabetic = F.exists(word_list(flat), lambda w: w.rlike(r"^\p{L}+$"))
        return (flat != "") & (
            F.when(F.lower(F.left(flat, F.lit(64))).rlike(r"^(table |fig|s\.no|sample no)"), True)
            .when(n > 12, False)
            .when(flat.rlike(SERIAL) & (n <= 4), True)
            .when(F.exists(word_list(low), lambda w: w.isin("nil", "na", "n/a", "nd")), True)
            .when(flat.rlike("[%°]"), (numbers(flat) >= 1) | alphabetic)
            .when(numbers(flat) >= 2, True)
            .otherwise(F.regexp_count(flat, F.lit(r"\d")) >= 6)
        )

    return let(compact(F.coalesce(text, F.lit(""))), lambda flat: let(_words_of(flat), lambda n: row(flat, n)))


def is_table_anchor(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit(""))).rlike(r"(?<!\w)table\s*(no\.?\s*\d+|\d+)(?!\w)")


def is_contextual_row(text: Column) -> Column:
    """A row of a table that an anchor above has announced."""
    flat = compact(F.coalesce(text, F.lit("")))
    low, n = F.lower(flat), word_count(flat)
    return (flat != "") & (
        F.when(is_table_row(flat), True)
        .when(n > 18, False)
        .when(flat.rlike(r"[.!?]\s*$") & (n >= 8), False)
        .when(low.rlike(f"^({ROW_LABELS})"), True)
        .when(numbers(flat) >= 1, True)
        .otherwise((n <= 6) & ~low.rlike(r"(?<!\w)(the|and|with|were|was|is|are|this|that|from|into|over|under)(?!\w)"))
    )


def is_context_break(text: Column) -> Column:
    flat = compact(F.coalesce(text, F.lit("")))
    return (word_count(flat) >= 16) & flat.rlike("[.!?;]") & F.lower(flat).rlike(r"(?<!\w)(method|observations|prepared|adopting|objective|analysis|discussion|conclusion)(?!\w)")


def is_numeric_dense(text: Column) -> Column:
    def dense(flat: Column, digits: Column, letters: Column) -> Column:
        return (digits + letters > 0) & (digits / F.greatest(digits + letters, F.lit(1)) >= 0.35) & (word_count(flat) <= 14)

    kept = lambda flat, kind: F.length(F.regexp_replace(flat, rf"[^\p{{{kind}}}]+", ""))
    return let(compact(F.coalesce(text, F.lit(""))), lambda flat: let(F.struct(kept(flat, "Nd").alias("d"), kept(flat, "L").alias("l")), lambda n: dense(flat, n["d"], n["l"])))


def is_title_case(text: Column) -> Column:
    """Whether every cased word begins with a capital and goes on small."""
    return ~text.rlike(r"(^|[^\p{Lu}\p{Ll}\p{Lt}])\p{Ll}") & ~text.rlike(r"[\p{Lu}\p{Ll}\p{Lt}]\p{Lu}")


def is_section_heading(text: Column, table_heavy: Column, tagged: Column) -> Column:
    """Whether a unit opens a section; `tagged`: the parser called it a heading."""
    flat = compact(F.coalesce(text, F.lit("")))
    low, n = F.lower(flat), word_count(flat)
    numbered = flat.rlike(r"(?i)^\s*(\d+(\.\d+)?|[IVXLCDM]+)(?![\p{L}\p{N}_])")
    rest = F.trim(F.regexp_replace(low, r"(?i)^\s*(\d+(\.\d+)?|[IVXLCDM]+)[.)\-: ]*", ""))
    cell = ~low.rlike(f"^({SECTIONS})") & ~F.endswith(flat, F.lit(":")) & (n <= 6)
    return (
        F.when((flat == "") | (F.length(flat) > 120), False)
        .when(low.rlike(FURNITURE) | is_table_row(flat), False)
        .when(table_heavy & cell, False)
        .when(flat.rlike(r"^[(\[]?\d{1,4}[)\]]?$"), False)
        .when(tagged, True)
        .when(numbered, rest.rlike(f"^({SECTIONS})") | F.endswith(flat, F.lit(":")))
        .otherwise((n >= 2) & (n <= 10) & (is_title_case(flat) | F.endswith(flat, F.lit(":"))))
    )


def is_verse(text: Column, only_latin: Column | None = None) -> Column:
    """Two of: verse mark, number in front, two to four short lines, few prose endings; in an Indic script only."""
    t = F.trim(F.coalesce(text, F.lit("")))
    flat = compact(t)
    low, n = F.lower(flat), word_count(flat)
    lines = F.filter(F.transform(F.split(t, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    row = low.rlike(r"^(s\.no|sample no|parameter|inference)") | (flat.rlike(SERIAL) & (n <= 8)) | ((numbers(flat) >= 3) & (n <= 12))
    reference = (
        low.rlike(r"^(table |table no|fig|references|reference|chapter )|www\.|issn")
        | row
        | flat.rlike("[%°]")
        | (F.regexp_count(flat, F.lit(r"\p{Nd}")) >= 5)
        | ((n >= 10) & flat.rlike("[.?!]$"))
    )
    danda = t.rlike(r"।|॥|à¥¤|à¥¥|\|")
    numbered = t.rlike("^\\s*([0-9०-९౦-౯]+([.)-][0-9०-९౦-౯]+)?)(?![\\p{L}\\p{N}_])")
    multiline = (F.size(lines) >= 2) & (F.size(lines) <= 4) & F.forall(lines, lambda x: word_count(x) <= 14)
    prose = F.size(F.filter(lines, lambda x: x.rlike("[.?!]$")))
    signals = danda.cast("int") + numbered.cast("int") + multiline.cast("int") + (prose <= F.floor(F.size(lines) / 3)).cast("int")
    out = (flat != "") & ~reference & t.rlike("[ऀ-ॿఀ-౿]") & (signals >= 2) & (multiline | danda)
    return out if only_latin is None else out & ~only_latin


def noise_form(text: Column) -> Column:
    """What stays the same of a running header or footer from page to page."""
    digit = lambda c: c.between("0", "9")
    headless = lambda t: F.when(digit(F.left(t, F.lit(1))), F.regexp_replace(t, r"^\s*\d{1,4}\s*", "")).otherwise(t)
    endless = lambda t: F.when(digit(F.right(t, F.lit(1))), F.regexp_replace(t, r"\s*\d{1,4}\s*$", "")).otherwise(t)
    # A compact text begins and ends with no white space, and stays compact.
    return let(F.lower(compact(F.coalesce(text, F.lit("")))), lambda t: F.btrim(let(headless(t), endless), F.lit(" |.-")))


def is_page_number(text: Column) -> Column:
    return F.trim(text).rlike(r"^[(\[]?\d{1,4}[)\]]?$")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def stable_doc_id(name: Column, size: Column, path: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", name, size.cast("string"), path).cast("binary")), 1, 16)


def point_id(raw: Column, kind: str) -> Column:
    """A UUID in canonical form, or the name-based UUID (version 5, URL space) of kind:raw. Blank gives null."""
    name = F.trim(raw)
    bare = F.lower(F.regexp_replace(name, "^urn:uuid:|[{}-]", ""))
    digest = F.sha1(F.concat(F.unhex(F.lit("6ba7b8119dad11d180b400c04fd430c8")), F.encode(F.concat(F.lit(f"{kind}:"), name), "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    made = F.concat(F.substring(digest, 1, 12), F.lit("5"), F.substring(digest, 14, 3), variant, F.substring(digest, 18, 15))
    plain = F.when(bare.rlike("^[0-9a-f]{32}$"), bare).otherwise(made)
    dashed = F.concat_ws("-", *(F.substring(plain, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    return F.when(name != "", dashed)


def too_little_text(text: Column) -> Column:
    """Under 40 characters, or under 20 letters and digits: what a scanned page gives."""
    flat = F.trim(F.coalesce(text, F.lit("")))
    return (F.length(flat) < 40) | (F.length(F.regexp_replace(flat, r"[^\p{L}\p{N}]", "")) < 20)


def is_meaningful(token: Column) -> Column:
    """A token with a letter and two word characters that holds no mojibake."""
    return F.coalesce(token, F.lit("")).rlike(f"^{_MEANINGFUL.removeprefix('(?<!\\S)')}$")


def is_weird_symbol(char: Column) -> Column:
    """A character that is no letter, digit, mark, white space or ordinary punctuation."""
    return (F.length(char) == 1) & ~char.rlike(r"^[\p{L}\p{N}\p{M}\s.,:;!?()\[\]{}'\"/\-_%+&*#°₹$=|।॥]$")


def has_indic(token: Column) -> Column:
    return F.coalesce(token, F.lit("")).rlike(f"[{INDIC}]")


def is_blank_like(text: Column, kind: Column, heavy: Column) -> Column:
    """A page with nothing to read: blank by its type, or without a large image and empty, a few marks, or one or two short words."""
    flat = compact(F.coalesce(text, F.lit("")))
    return F.when(kind == "blank", True).when(heavy, False).otherwise((flat == "") | ((F.length(flat) <= 24) & ~flat.rlike(r"\p{L}")) | ((F.length(flat) <= 8) & (word_count(flat) <= 2)))


def clean_structured(text: Column) -> Column:
    """White space as one blank, bars with one on either side."""
    return compact(F.regexp_replace(compact(F.coalesce(text, F.lit(""))), r"\s*\|\s*", " | "))


def clean_cell(value: Column) -> Column:
    flat = F.trim(F.coalesce(value, F.lit("")))
    return F.when(F.lower(flat) == "nan", "").otherwise(compact(flat))


def safe_path(value: Column) -> Column:
    """A file name: marks that file systems reserve become underscores."""
    flat = F.regexp_replace(F.regexp_replace(F.coalesce(value, F.lit("")), r'[<>:"/\\|?*]+', "_"), r"^\s+|\s+$", "")
    bare = F.regexp_replace(flat, r"^[ .]+|[ .]+$", "")
    return F.when(bare == "", "untitled").otherwise(bare)


def folder(value: Column, fallback: str) -> Column:
    """The parts of a path as slugs; `fallback` if none is left."""
    parts = F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), "/"), slug), lambda p: p != "")
    return F.when(F.size(parts) > 0, F.array_join(parts, "/")).otherwise(fallback)


def public_id(root: Column, doc_id: Column, source: Column, page: Column, figure: Column) -> Column:
    """root/document/page_N/figure_N, the document by its id, or by its file's name."""
    stem = F.regexp_replace(F.regexp_extract(F.coalesce(source, F.lit("")), r"[^/]*$", 0), r"(?<=.)\.[^.]*$", "")
    name = F.coalesce(F.nullif(slug(F.coalesce(doc_id, F.lit(""))), F.lit("")), F.nullif(slug(stem), F.lit("")), F.lit("unknown_source"))
    number = lambda c: F.greatest(F.lit(1), F.coalesce(c, F.lit(1))).cast("string")
    return F.concat(root, F.lit("/"), name, F.lit("/page_"), number(page), F.lit("/figure_"), number(figure))


def cleaned_list(values: Column) -> Column:
    """Trimmed values in order, each once, without blank ones."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.trim(F.coalesce(v, F.lit("")))), lambda v: v != ""))


def cleaned_int(value: Column) -> Column:
    return F.trim(value).try_cast("int")
