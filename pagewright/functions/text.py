"""Scalar text rules as column functions: no Python runs in them.

Java's ``\\d``, ``\\w`` and ``\\s`` are ASCII; the classes below say what they mean.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: alphabets, word lists and patterns that results depend on

THAI = r"[฀-๿]"
THAI_CONSONANT = r"[ก-ฮ]"
TONE = r"[่-๋]"
SARA_AM = "ำ"
#: Combining vowels and tone marks that a reader can't see apart from their consonant.
THAI_MARKS = r"^[ัิ-ู่-์]+$"

KNOWN_CORRECTIONS = {
    "วันที": ("วันที่", "vowel_tone"),
    "อนุญาติ": ("อนุญาต", "spelling"),
    "เพือ": ("เพื่อ", "vowel_tone"),
    "อยาง": ("อย่าง", "vowel_tone"),
    "เทคโนโลยี่": ("เทคโนโลยี", "vowel_tone"),
    "พดโวยวาย": ("พูดโวยวาย", "vowel_tone"),
    "ป้ามี่": ("ป้าที่", "spelling"),
}

INJECTION = (
    r"(?i)ignore\s+(all\s+)?(previous\s+)?instructions",
    r"(?i)system\s+override",
    r"(?i)you\s+are\s+now",
    "คำสั่งลับ",
    "ลบข้อความทั้งหมด",
    "ให้แต่งนิทาน",
    "สรุปเนื้อหาเป็น",
)

#: Kinds of tokens that a translation must carry over, all case-insensitive.
CRITICAL = {
    "number": r"(?<![A-Za-z0-9_])[-+]?\d(?:\d|,(?=\d))*(?:\.\d+)?%?(?![A-Za-z0-9_])",
    "date": r"\b\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}\b",
    "time": r"\b\d{1,2}:\d{2}(?::\d{2})?\b",
    "money": r"(?:[$€£฿¥]\s?\d[\d,.]*|\d[\d,.]*\s?(?:USD|THB|EUR|GBP|CNY))",
    "url": r"https?://[^\s<]+",
    "email": r"[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}",
    "citation": r"(?:\[[0-9,\- ]+\]|\([A-Z][A-Za-z-]+,?\s+\d{4}[a-z]?\))",
    "unit": r"(?<![A-Za-z])\d+(?:\.\d+)?\s?(?:mm|cm|m|km|mg|g|kg|ml|L|°C|°F|kWh|MB|GB|GHz)\b",
    "code": r"`[^`]+`|\b(?:[A-Za-z_][A-Za-z0-9_]*\([^\n)]*\)|[A-Za-z_][A-Za-z0-9_]{1,}\.[A-Za-z_][A-Za-z0-9_]{1,})",
}

KEPT_HYPHEN_PREFIXES = ("self", "well", "co", "cross", "ex", "all", "half", "quasi", "step", "great", "user", "state", "cost", "real", "high", "low", "open", "end", "peer")

TARGET_SCRIPTS = {
    "th": r"[\u0E00-\u0E7F]",
    "zh": r"[\u3400-\u9FFF]",
    "ja": r"[\u3040-\u30FF\u3400-\u9FFF]",
    "ko": r"[\uAC00-\uD7AF]",
    "en": r"[A-Za-z]",
    "de": r"[A-Za-zÀ-ÿ]",
    "fr": r"[A-Za-zÀ-ÿ]",
    "es": r"[A-Za-zÀ-ÿ]",
    "vi": r"[A-Za-zÀ-ỹ]",
    "id": r"[A-Za-z]",
    "ms": r"[A-Za-z]",
}
#: Code shapes, each from the first character that isn't blank.
CODE_SHAPES = (
    r"(?:def|class)\s+[A-Za-z_]\w*",
    r"function\s+[A-Za-z_]\w*\s*\(",
    r"(?:const|let|var)\s+[A-Za-z_]\w*\s*=",
    r"import\s+(?=(?U:\s*\S))",
    r"#include\b",
    r"</?[A-Za-z][^>]*>",
    r"[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*\([^\n)]*\);?(?U:\s*)\z",
)
LIST_BULLETS = r"^\s*(?:([-*•▪◦])|(\d{1,3})[.)])\s+(.+)$"
HEADING_PREFIX = r"^(บทที่|ตอนที่|ส่วนที่|ภาคผนวก|หัวข้อที่|\d+(\.\d+)*)\s+"

# ---- quality of extracted text


def any_match(text: Column, patterns) -> Column:
    return reduce(lambda a, b: a | b, (text.rlike(p) for p in patterns))


def encoding_broken(text: Column) -> Column:
    """Replacement or NUL characters, too many private-use ones, or stacked tone marks."""
    private = F.regexp_count(text, F.lit(r"[\x{E000}-\x{F8FF}]"))
    return text.contains("�") | text.contains("\u0000") | (private > F.greatest(F.lit(2.0), F.length(text) * 0.05)) | (F.regexp_count(text, F.lit(r"[่-๎]{2,}")) > 5)


def route(chars: Column, broken: Column, images: Column, area: Column, blank: Column) -> Column:
    """Which extraction a page takes; the first rule that fits."""
    return (
        F.when(chars == 0, F.when(blank, "blank").otherwise("ocr_image"))
        .when(broken, "ocr_image")
        .when((images > 0) & (area >= 0.4) & (chars < 15), "ocr_image")
        .when((images > 0) & (area >= 0.15) & (chars >= 15), "hybrid")
        .otherwise("direct_text")
    )


def visually_blank(low: Column, high: Column, variance: Column) -> Column:
    return F.when(high - low < 5, True).otherwise(F.sqrt(variance) < 2.0)


def printable_ratio(text: Column) -> Column:
    visible = F.length(F.regexp_replace(text, r"\s", ""))
    return F.when(F.length(text) > 0, F.bround(visible / F.length(text), 4)).otherwise(0.0)


# ---- repairs


def repair_sara_am(text: Column) -> Column:
    """Rejoins a vowel that recognition split off with blanks; the text is NFC already."""
    out = F.translate(text, "\u200b\ufeff", "")
    out = F.regexp_replace(out, rf"({THAI_CONSONANT})[ \u00A0]+({TONE})า", f"$1$2{SARA_AM}")
    return F.regexp_replace(out, rf"({THAI_CONSONANT})[ \u00A0]+า", f"$1{SARA_AM}")


def known_correction(text: Column) -> Column:
    """struct(corrected, category) for a word that is safe to correct, else nulls."""
    split = rf"^{THAI_CONSONANT}[ \u00A0]+{TONE}?า$"
    joined = F.regexp_replace(text, rf"({THAI_CONSONANT})[ \u00A0]+({TONE}?)า", f"$1$2{SARA_AM}")
    words = F.create_map(*(F.lit(x) for k, v in KNOWN_CORRECTIONS.items() for x in (k, v[0])))
    kinds = F.create_map(*(F.lit(x) for k, v in KNOWN_CORRECTIONS.items() for x in (k, v[1])))
    fixed = F.coalesce(F.try_element_at(words, text), F.when(text.rlike(split), joined))
    kind = F.coalesce(F.try_element_at(kinds, text), F.when(text.rlike(split), F.lit("vowel_tone")))
    return F.struct(fixed.alias("corrected"), kind.alias("category"))


# ---- recognisers


def strip(text: Column) -> Column:
    """Blanks of all kinds off both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def looks_like_code(text: Column) -> Column:
    """Indented, or of a code's shape once blanks at both ends are passed over, which the
    patterns do themselves: one look at the text for all shapes."""
    braces = text.contains("{") & (text.contains("}") | text.rlike(r";(?U:\s*)\z"))
    return text.rlike(r"^\s{2,}\S") | text.rlike(r"^(?U:\s*)(?:" + "|".join(CODE_SHAPES) + ")") | text.contains("=>") | braces


#: Characters of which a token of a kind has one at least; kinds that aren't here have a digit.
_HAS = {"url": ("://",), "email": ("@",), "citation": ("[", "("), "code": ("`", "(", ".")}


def critical(text: Column, kind: str) -> Column:
    """All tokens of one kind, in order.  Texts without what any such token has aren't searched."""
    may = reduce(lambda a, b: a | b, (F.contains(text, F.lit(c)) for c in _HAS[kind])) if kind in _HAS else text.rlike("[0-9]")
    found = F.regexp_extract_all(text, F.lit("(?iu)" + CRITICAL[kind]), F.lit(0))
    return F.when(may, found).when(text.isNotNull(), F.array().cast("array<string>"))


def language_tag(value: Column) -> Column:
    """A BCP-47 tag in its usual case, or null."""
    parts = F.split(strip(value), "-")
    cased = F.transform(parts, lambda p, i: F.when(i == 0, F.lower(p)).when(F.length(p) == 2, F.upper(p)).otherwise(p))
    return F.when(strip(value).rlike(r"^[A-Za-z]{2,3}(?:-[A-Za-z0-9]{2,8})*$"), F.array_join(cased, "-"))


def script_counts(text: Column) -> tuple[Column, Column, Column]:
    return tuple(F.regexp_count(text, F.lit(p)) for p in (r"[฀-๿]", r"[㐀-鿿]", r"[A-Za-z]"))


def main_script(th: Column, zh: Column, en: Column) -> tuple[Column, Column]:
    """The commonest of three scripts (ties in that order) and its share; und without any."""
    total, most = th + zh + en, F.greatest(th, zh, en)
    name = F.when(total == 0, "und").when(th == most, "th").when(zh == most, "zh").otherwise("en")
    return name, F.when(total == 0, 0.0).otherwise(F.bround(most / F.greatest(total, F.lit(1)), 4))


def term_fits_language(term: Column, language: str | None) -> Column:
    base = (language or "auto").split("-")[0].lower()
    pattern = {k: TARGET_SCRIPTS[k] for k in ("th", "zh", "ja", "ko")}.get(base) or (r"[A-Za-zÀ-ỹ]" if base in ("en", "de", "fr", "es", "vi", "id", "ms") else None)
    return F.lit(True) if pattern is None else (F.length(strip(term)) < 4) | term.rlike(pattern)


def target_script_missing(source: Column, target: Column, language: str) -> Column:
    """A sentence that was handed back instead of translated."""
    pattern = TARGET_SCRIPTS.get(language.split("-")[0].lower())
    letters = F.regexp_count(source, F.lit(r"[A-Za-z\u0E00-\u0E7F\u3400-\u9FFF\u3040-\u30FF\uAC00-\uD7AF]"))
    words = F.regexp_count(source, F.lit(r"(?U)\S+"))
    return F.lit(False) if pattern is None else ~looks_like_code(source) & (letters >= 12) & (words >= 3) & ~target.rlike(pattern)


def injected(text: Column) -> Column:
    return any_match(text, INJECTION)


def has_digit(text: Column) -> Column:
    return text.rlike(r"(?U)[\d๐-๙]")


def dehyphenation(before: Column, after: Column) -> Column:
    """struct(rule, merge, separator): how a line that may end in a hyphen joins the next."""
    outcome = lambda rule, merge, separator: F.struct(F.lit(rule).alias("rule"), F.lit(merge).alias("merge"), F.lit(separator).alias("separator"))
    address = r"https?://|\S@\S"
    technical = before.rlike(address + r"|[`_]|\[\d+\]|\(\w+,\s*\d{4}\)") | after.rlike(address) | looks_like_code(before) | looks_like_code(after)
    head, tail = F.regexp_extract(before, r"([A-Za-z]+)-$", 1), F.regexp_extract(after, r"^([A-Za-z]+)", 1)
    return (
        F.when(before.endswith("­"), outcome("soft_hyphen_merge", True, ""))
        .when(~before.endswith("-"), outcome("line_continuation", False, " "))
        .when(before.endswith(" -") | before.endswith(" --"), outcome("minus_sign_preserve", False, " "))
        .when(technical, outcome("code_or_identifier_preserve", False, ""))
        .when((head == "") | (tail == ""), outcome("non_alpha_hyphen_preserve", False, ""))
        .when(tail.rlike("^[A-Z]"), outcome("capitalized_suffix_preserve", False, " "))
        .when(F.lower(head).isin(*KEPT_HYPHEN_PREFIXES), outcome("compound_word_preserve", False, ""))
        .otherwise(outcome("eol_split_word_merge", True, ""))
    )


def joined_lines(before: Column, after: Column) -> Column:
    how = dehyphenation(before, after)
    kept = F.when(how["merge"], F.substring(before, 1, F.length(before) - 1)).otherwise(before)
    return F.concat(kept, how["separator"], after)


# ---- spots

#: What a page scan looks for, in order; of equal spans the first stays.
SPOTS = (
    (r"[\u0e01-\u0e2e][ \u00a0]+[\u0e48-\u0e4b]?\u0e32", "split_sara_am"),
    (r"[\u0e48-\u0e4b]{2,}", "double_tone_mark"),
    (r"[\u0e31\u0e34-\u0e37]{2,}", "double_upper_vowel"),
    (r"[\u0e38\u0e39]{2,}", "double_lower_vowel"),
    (r"[\u0e48-\u0e4b][\u0e31\u0e34-\u0e37]", "inverted_tone_vowel"),
    (r"[\u0e40-\u0e44][\s,.\-!?]", "orphan_leading_vowel"),
    (r"\u0e40\u0e40", "double_sara_e"),
    (r"วันที(?=[\s\d]|$)", "missing_mai_ek"),
    (r"อนุญาติ", "superfluous_vowel"),
    (r"เพือ(?=[\s\u0e01-\u0e2e]|$)", "missing_mai_ek"),
    (r"อยาง(?=[\s\u0e01-\u0e2e]|$)", "missing_mai_ek"),
    (r"พดโวยวาย", "missing_vowel"),
    (r"ป้ามี่(?=[\s\u0e01-\u0e2e]|$)", "confused_consonant"),
    (r"เทคโนโลยี่", "superfluous_tone"),
)

_SPANS = "array<struct<start:int,ord:int,end:int,matched:string,reason:string>>"


def suspicious_spots(text: Column) -> Column:
    """array<struct<start, end, matched, reason>>: spans (code points) of likely
    recognition errors, by where they start; of equal spans the first pattern's stays.

    Where a match is comes from the lengths of the matches and of what is between them.
    """

    def found(ord_: int, pattern: str, reason: str) -> Column:
        pattern = "(?U)" + pattern
        pieces = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
        zero = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("spans"))

        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + F.length(x["gap"])
            end = start + F.length(x["hit"])
            one = F.struct(start.alias("start"), F.lit(ord_).alias("ord"), end.alias("end"), x["hit"].alias("matched"), F.lit(reason).alias("reason"))
            return F.when(x["hit"].isNull(), acc).otherwise(F.struct(end.alias("at"), F.array_append(acc["spans"], one).alias("spans")))

        return F.when(text.rlike(pattern), F.aggregate(pieces, zero, step, lambda acc: acc["spans"])).otherwise(F.array().cast(_SPANS))

    slim = "array<struct<start:int,end:int,matched:string,reason:string>>"
    every = F.array_sort(F.concat(*(found(i, p, r) for i, (p, r) in enumerate(SPOTS))))

    def once(acc: Column, x: Column) -> Column:
        same = F.exists(acc, lambda y: (y["start"] == x["start"]) & (y["end"] == x["end"]))
        return F.when(same, acc).otherwise(F.array_append(acc, F.struct(x["start"].alias("start"), x["end"].alias("end"), x["matched"].alias("matched"), x["reason"].alias("reason"))))

    kept = F.aggregate(every, F.array().cast(slim), once)
    return F.when(text.rlike("(?U)" + "|".join(p for p, _ in SPOTS)), kept).otherwise(F.array().cast(slim))


# ---- output


def escape_html(text: Column, quotes: bool = False) -> Column:
    """Control characters out (tabs and line ends stay), then markup characters escaped."""
    out = F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *((('"', "&quot;"), ("'", "&#x27;")) if quotes else ())):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def heading_level(text: Column, size_ratio: Column, bold: Column, first: Column, gap: Column) -> Column:
    """h1, h2, h3 or null: two signals are needed, long and full-stop lines never qualify."""
    big, strong, prefixed = size_ratio >= 1.2, bold >= 0.8, text.rlike(HEADING_PREFIX)
    signals = big.cast("int") + strong.cast("int") + (first | (gap >= 1.5)).cast("int") + prefixed.cast("int")
    no = (text == "") | (F.length(text) > 80) | (text.endswith(".") & ~text.rlike(r"(?<![A-Za-z0-9_])[A-Za-z0-9]\.$")) | (signals < 2)
    return F.when(no, None).when(big | (strong & first), "h1").when((size_ratio >= 1.1) | strong | prefixed, "h2").otherwise("h3")


def without_page_header(text: Column, ignore_case: bool = True) -> Column:
    return F.regexp_replace(text, ("(?i)" if ignore_case else "") + r"^\s*---\s*Page\s+\d+\s*---\s*\n?", "")


def list_marker(text: Column) -> Column:
    """struct(kind, number, body) of a line that starts with a bullet or a number."""
    found = text.rlike(LIST_BULLETS)
    number = F.regexp_extract(text, LIST_BULLETS, 2)
    kind = F.when(~found, None).when(number == "", "unordered").otherwise("ordered")
    return F.struct(kind.alias("kind"), F.when(found & (number != ""), number.cast("int")).alias("number"), F.when(found, F.regexp_extract(text, LIST_BULLETS, 3)).alias("body"))


def output_text(final: Column, translated: Column, source: Column) -> Column:
    """A final text, even an empty one, before a translated one, before the source."""
    return F.coalesce(final, translated, source)


def stable_hash(text: Column, length: int = 24) -> Column:
    return F.substring(F.sha2(text, 256), 1, length)


def safe_job_id(value: Column) -> Column:
    return value.rlike(r"^[A-Za-z0-9_-]{1,64}$")


def safe_member_path(value: Column) -> Column:
    """Relative, forward slashes only, no empty, dot or parent part."""
    return ~value.startswith("/") & ~value.contains("\\") & ~value.contains(":") & ~value.rlike(r"(^|/)(\.{0,2})(/|$)")


# ---- markup, settings and noisy answers


def inline_styles(text: Column, bold: Column, italic: Column, spans: Column) -> Column:
    """Escaped text in b and i where a line's ratio is 0.8 or more; span by span
    (struct text, bold, italic) only where the spans make up just the text."""
    wrap = lambda t, b, i: F.concat(F.when(b, "<b>").otherwise(""), F.when(i, "<i>").otherwise(""), t, F.when(i, "</i>").otherwise(""), F.when(b, "</b>").otherwise(""))
    whole = wrap(escape_html(text), bold >= 0.8, italic >= 0.8)
    parts = F.array_join(F.transform(spans, lambda s: wrap(escape_html(s["text"]), s["bold"], s["italic"])), "")
    joined = F.array_join(F.transform(spans, lambda s: s["text"]), "")
    return F.when((bold >= 0.8) | (italic >= 0.8) | spans.isNull() | (joined != text), whole).otherwise(parts)


#: What translation settings may be.
STYLES = {"general": "ทั่วไป", "novel": "นิยาย", "academic": "วิชาการ", "official": "ราชการ"}
PROVIDERS = ("local", "local_api", "cli_codex", "cli_gemini", "cli_agy", "cli_claude", "cli_lms", "google", "hybrid")
MANUAL = ("preserve", "rebase", "reset")


def settings_checked(source: Column, target: Column, style: Column, provider: Column, manual: Column) -> Column:
    """struct(source, target, style, provider, errors): languages and names in their usual form, and what is wrong."""
    own = F.lower(strip(F.coalesce(style, F.lit("general"))))
    own = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for k, v in STYLES.items() for x in (v, k))), own), own)
    src = F.when(F.lower(strip(source)) == "auto", "auto").otherwise(language_tag(source))
    dst, who = language_tag(target), F.lower(F.coalesce(provider, F.lit("local")))
    rules = ((src.isNull(), "source_language"), (dst.isNull(), "target_language"), (F.lower(src) == F.lower(dst), "same_language"), (~own.isin(*STYLES), "style"), (~who.isin(*PROVIDERS), "provider"), (~F.lower(F.coalesce(manual, F.lit("preserve"))).isin(*MANUAL), "manual_strategy"))
    errors = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for c, n in rules)))
    return F.struct(src.alias("source"), dst.alias("target"), own.alias("style"), who.alias("provider"), errors.alias("errors"))


def clean_metadata(value: Column, most: int) -> Column:
    """Without control characters, stripped, of at most ``most`` characters."""
    return F.substring(strip(F.regexp_replace(value, r"[\x00-\x1F\x7F]", "")), 1, most)


def iso_date(value: Column) -> Column:
    """The date where the value is one written YYYY, YYYY-MM or YYYY-MM-DD, else null."""
    full = F.when(value.rlike(r"^\d{4}$"), F.concat(value, F.lit("-01-01"))).when(value.rlike(r"^\d{4}-\d{2}$"), F.concat(value, F.lit("-01"))).when(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), value)
    return F.when(F.try_to_timestamp(full, F.lit("yyyy-MM-dd")).isNotNull(), value)


def json_object(answer: Column) -> Column:
    """The JSON object in a noisy answer: of a fenced block, else from the first brace to the last; null if it isn't one."""
    fenced = F.regexp_extract(answer, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    outer = F.regexp_extract(answer, r"(?s)(\{.*\})", 1)
    found = F.when(fenced != "", fenced).otherwise(outer)
    return F.when(F.get_json_object(found, "$").isNotNull(), found)
