"""Column functions on strings, names and numbers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: What counts as a CJK character, a Hangul syllable, and Hangul or CJK of any kind.
CJK = "[぀-ヿ㐀-鿿豈-﫿]"
HANGUL = "[가-힣]"
HANGUL_OR_CJK = "[ᄀ-ᇿ㄰-㆏가-힣぀-ヿ㐀-鿿豈-﫿]"
LETTER = r"[\p{L}\p{N}]"
#: Characters that the Windows encoding has besides Latin-1.
WINDOWS_EXTRA = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
#: Patterns of font names.
SERIF = "(times|serif|roman|georgia|garamond|minion|cambria|book ?antiqua|palatino|batang|myeong|mincho|song|ming|바탕|명조|궁서|gungs|hymj|h2mj|mjre|hcr ?batang|함초롬바탕)"
MONO = "(courier|mono|consol|code|d2coding|menlo|fixed)"
BOLD = r"(bold|black|heavy|semibold|demi|extrabold|ultra|-b$|,b$|\bbd\b|^(hy|h2)[a-z0-9]+b$)"
ITALIC = "(italic|oblique|-it$|,it$|-i$)"
KOREAN_FONT = "(malgun|gulim|dotum|batang|gungsuh|nanum|hy|hcr|함초롬|맑은|굴림|돋움|바탕|궁서|noto ?sans ?(kr|cjk)|noto ?serif ?(kr|cjk)|pretendard|apple ?sd|spoqa|kopub|yoon|hangul)"


def rounded(x: Column, scale: int = 1) -> Column:
    """Half up towards plus infinity, to 1/scale."""
    return F.floor(x * scale + 0.5) / scale if scale != 1 else F.floor(x + 0.5)


def strip_extension(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^/.]+$", "")


def format_bytes(n: Column) -> Column:
    """Bytes whole; KB with one, MB with one, GB with two decimals, halves rounded up."""
    said = lambda scale, digits, unit: F.concat(F.format_string(f"%.{digits}f", rounded(n / scale, 10**digits)), F.lit(unit))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024**2, said(1024, 1, " KB")).when(n < 1024**3, said(1024**2, 1, " MB")).otherwise(said(1024**3, 2, " GB"))


def build_filename(pattern: Column, name: Column, page: Column, total: Column, ext: str) -> Column:
    """Fills {name}, {n} (padded to the width of total), {N} and {total}, in that order."""
    own, all_ = page.cast("string"), total.cast("string")
    out = F.replace(pattern, F.lit("{name}"), name)
    out = F.replace(out, F.lit("{n}"), F.lpad(own, F.greatest(F.length(own), F.length(all_)), F.lit("0")))
    out = F.replace(F.replace(out, F.lit("{N}"), own), F.lit("{total}"), all_)
    return F.concat(out, F.lit("." + ext))


def page_range(said: Column, total: Column) -> Column:
    """Pages of a selection such as `1-3, 5`: ascending, each once; all for an empty one; null if any part is wrong."""
    parts = F.filter(F.transform(F.split(F.trim(said), ","), lambda p: F.trim(p)), lambda p: p != "")
    ends = F.transform(parts, lambda p: F.transform(F.split(p, r"\s*-\s*"), lambda e: F.when(e.rlike(r"^\d{1,9}$"), e.cast("int"))))
    right = F.forall(parts, lambda p: p.rlike(r"^\d+(\s*-\s*\d+)?$")) & F.forall(ends, lambda e: F.forall(e, lambda n: F.coalesce((n >= 1) & (n <= total), F.lit(False))))
    pages = F.flatten(F.transform(ends, lambda e: F.sequence(F.array_min(e), F.array_max(e))))
    every = F.when(total >= 1, F.sequence(F.lit(1), total.cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.when(F.trim(said) == "", every).when(right, F.array_sort(F.array_distinct(pages)))


def strip_subset_tag(name: Column) -> Column:
    return F.regexp_replace(name, r"^[A-Z]{6}\+", "")


@F.pandas_udf(StringType())
def repaired_name(name: pd.Series) -> pd.Series:
    """Font names whose Korean bytes (with the extended syllables) were read as Latin-1, read as what they are; others, and those without Hangul in them, stay."""

    def one(n: str | None) -> str | None:
        if n is None or n.isascii() or any(c > "\xff" for c in n):
            return n
        try:
            said = n.encode("latin-1").decode("cp949")
        except UnicodeDecodeError:
            return n
        return said if any("가" <= c <= "힣" for c in said) else n

    return name.map(one)


def describe_font(base: Column, bold: Column | bool = False, italic: Column | bool = False, css: Column | None = None) -> Column:
    """Family, weight and slant that a font's name, once it is repaired, its flags and its style's family tell."""
    shown = repaired_name(strip_subset_tag(F.coalesce(base, F.lit(""))))
    is_ = lambda p: shown.rlike("(?i)" + p)
    set_ = lambda c: F.coalesce(F.lit(c) if isinstance(c, bool) else c, F.lit(False))
    css = F.lit("") if css is None else F.coalesce(css, F.lit(""))
    family = F.when(is_(MONO) | (css == "monospace"), "mono").when((~is_("sans") & is_(SERIF)) | (css == "serif"), "serif").otherwise("sans")
    return F.struct(F.coalesce(base, F.lit("")).alias("base_font"), F.when(shown == "", "—").otherwise(shown).alias("display_name"), family.alias("family"), (set_(bold) | is_(BOLD)).alias("bold"), (set_(italic) | is_(ITALIC)).alias("italic"))


def run_size(t: Column) -> Column:
    """The size of a text item from its transform: its height, or its width where that is 0."""
    return F.coalesce(F.nullif(F.abs(t[3]), F.lit(0.0)), F.abs(t[0]))


def all_windows(text: Column) -> Column:
    """Whether a text has characters of the Windows encoding only."""
    return ~text.rlike(f"[^\\x20-\\x7e\\xa0-\\xff{WINDOWS_EXTRA}]")


def letters(text: Column) -> Column:
    return F.regexp_count(text, F.lit(LETTER))


def hangul_share(text: Column) -> Column:
    n = letters(text)
    return F.when(n > 0, F.regexp_count(text, F.lit(HANGUL)) / n).otherwise(0.0)


def mostly_hangul(hangul: Column, all_letters: Column) -> Column:
    """Whether over a quarter of a page's letters are Hangul."""
    return (all_letters > 0) & (hangul / F.nullif(all_letters, F.lit(0)) > 0.25)


#: Languages of recognition with their labels, modes of page segmentation in order, and the languages that an interface language starts with.
OCR_LANGUAGES = {"eng": "English", "kor": "한국어", "jpn": "日本語", "chi_sim": "简中", "chi_tra": "繁中", "spa": "Español", "fra": "Français", "deu": "Deutsch", "ita": "Italiano", "por": "Português", "rus": "Русский", "ara": "العربية"}
SEGMENTATION = ("3", "1", "4", "6", "7", "8", "11", "12", "13")
FIRST_LANGUAGES = {"ko": ["kor", "eng"], "es": ["spa"], "": ["eng"]}


def first_languages(ui: Column) -> Column:
    said = lambda k: F.array(*map(F.lit, FIRST_LANGUAGES[k]))
    return F.when(ui == "ko", said("ko")).when(ui == "es", said("es")).otherwise(said(""))


def prefers_korean(text: Column, font: Column, korean_page: Column) -> Column:
    return text.rlike(HANGUL_OR_CJK) | F.coalesce(font.rlike("(?i)" + KOREAN_FONT), F.lit(False)) | F.coalesce(korean_page, F.lit(False))


def join_lines(lines: Column) -> Column:
    """Lines as flowing text: a hyphen before a small letter joins, CJK neighbours touch, others take a space."""

    def step(out: Column, t: Column) -> Column:
        last = F.right(out, F.lit(1))
        touch = last.rlike(CJK) & F.coalesce(F.left(t, F.lit(1)).rlike(CJK), F.lit(False))
        return F.when(out == "", t).when((last == "-") & t.rlike("^[a-z]"), F.concat(F.substring(out, F.lit(1), F.char_length(out) - 1), t)).when(touch, F.concat(out, t)).otherwise(F.concat(out, F.lit(" "), t))

    return F.aggregate(lines, F.lit(""), step)


def literal(query: str, case_sensitive: bool) -> str:
    """A pattern that finds the query as it stands."""
    return ("" if case_sensitive else "(?iu)") + "\\Q" + query.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def replace_literal(text: Column, query: str, replacement: str, case_sensitive: bool) -> Column:
    return F.regexp_replace(text, literal(query, case_sensitive), replacement.replace("\\", "\\\\").replace("$", "\\$"))


def language(url: Column, saved: Column, browser: Column, zone: Column, zones: dict[str, str], known=("en", "ko", "es")) -> Column:
    """The first of: the url's, the saved one, the browser's if Korean or Spanish, the time zone's, English."""
    base = lambda c: F.element_at(F.split(F.lower(c), "[-_]"), 1)
    as_known = lambda c, ok=known: F.when(base(c).isin(*ok), base(c))
    table = F.create_map(*(F.lit(x) for kv in zones.items() for x in kv))
    by_zone = F.coalesce(F.when(zone.startswith("America/Argentina/"), "es"), F.try_element_at(table, zone))
    return F.coalesce(as_known(url), as_known(saved), as_known(browser, ("ko", "es")), by_zone, F.lit("en"))


def sanitize(value: Column, fallback: float, lo: float, hi: float) -> Column:
    return F.when(value.between(lo, hi), value).otherwise(fallback)


def clamp(value: Column, lo: float, hi: float, default: float | None = None) -> Column:
    given = value if default is None else F.coalesce(F.nullif(value, F.lit(0)), F.lit(default))
    return F.least(F.greatest(given, F.lit(lo)), F.lit(hi))
