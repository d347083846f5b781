"""Column functions on text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMBED_CHARS = 450
_SPACE = r"(?U)\s+"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once and used by name, however often."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalized(c) -> Column:
    """White space as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(col(c), _SPACE, " "))


def useful(c) -> Column:
    """Without white space."""
    return F.regexp_replace(col(c), _SPACE, "")


#: What (?U)\s stands for.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def is_usable(c, least: int = 4) -> Column:
    return F.length(useful(c)) >= least


def redacted(c) -> Column:
    """Bearer tokens and values of secret keys as [REDACTED]."""
    bearer = F.regexp_replace(col(c), r"(?i)\b(bearer)\s+[A-Za-z0-9._~+/=-]+", "$1 [REDACTED]")
    return F.regexp_replace(bearer, r"(?i)\b(api[_-]?key|token|password|secret|authorization)\b(\s*[=:]\s*)[\"']?[^\s\"',;]+[\"']?", "$1$2[REDACTED]")


# Characters that join two letters, two digits, or either, when they stand between them.
MID_LETTER = ":··՟״‧︓﹕："
MID_NUMBER = ",;;։،؍٬߸⁄︐︔﹐﹔，；"
MID_EITHER = ".'‘’․﹒＇．"

_SCRIPTS = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}ーｰ"
#: Letters of scripts that are written with blanks between words.
_LETTER = rf"[^\P{{L}}{_SCRIPTS}]"
_LETTER_MARK = rf"(?:{_LETTER}|\p{{Nl}}|\p{{M}})"
_BREAKS = "|".join(
    [
        rf"[^\p{{L}}\p{{Nl}}\p{{Nd}}\p{{Pc}}\p{{M}}{MID_LETTER}{MID_NUMBER}{MID_EITHER}]",
        rf"(?<![\p{{L}}\p{{Nl}}\p{{Nd}}\p{{Pc}}\p{{M}}])\p{{M}}+",
        rf"(?<!{_LETTER_MARK})[{MID_LETTER}{MID_EITHER}](?!\p{{Nd}})|[{MID_LETTER}](?!{_LETTER}|\p{{Nl}})|(?<!{_LETTER_MARK})[{MID_LETTER}]",
        rf"(?<![\p{{Nd}}\p{{M}}])[{MID_NUMBER}]|[{MID_NUMBER}](?!\p{{Nd}})",
        rf"(?<![\p{{Nd}}\p{{M}}])[{MID_EITHER}](?!{_LETTER}|\p{{Nl}})|(?<!{_LETTER_MARK})[{MID_EITHER}](?={_LETTER}|\p{{Nl}})|[{MID_EITHER}](?!{_LETTER}|\p{{Nl}}|\p{{Nd}})",
    ]
)
_MIDDLE = rf"[{MID_LETTER}{MID_NUMBER}{MID_EITHER}](?<={_LETTER_MARK}[{MID_LETTER}{MID_EITHER}](?={_LETTER}|\p{{Nl}})|[\p{{Nd}}\p{{M}}][{MID_NUMBER}{MID_EITHER}](?=\p{{Nd}}))"
_START, _GO_ON = (rf"[\p{{L}}\p{{Nl}}\p{{Nd}}{more}&&[^{_SCRIPTS}]]" for more in ("", r"\p{Pc}\p{M}"))
#: A word of a text without Katakana: an ideograph, or a run that nothing above breaks. Its loops are such that the matcher does not recurse.
_WORD = rf"[\p{{IsHan}}\p{{IsHiragana}}]\p{{M}}*+|(?:\p{{Pc}}[\p{{Pc}}\p{{M}}]*+)?+{_START}{_GO_ON}*+(?:{_MIDDLE}{_GO_ON}+)*+"
_KANA = r"[\p{IsKatakana}ーｰ]"
#: Characters of a token at most; what is longer is cut.
TOKEN_CHARS = 255


def tokens(c) -> Column:
    """Words of a text as a standard analyzer takes them, lower-cased: segmentation by word-break classes (UAX #29).

    Each ideograph and each Hiragana character is a token; runs of Katakana are; other letters and digits are
    taken together, with connecting punctuation (``_``) and with single marks between two letters (``can't``,
    ``a.b``) or two digits (``3.14``, ``1,000``). Combining marks stay with their character. Scripts that need
    a dictionary (Thai and its like) count as letters. Tokens of over 255 characters are cut into such.

    Words are matched as such; only texts with Katakana, whose runs end at other letters, are cut at what breaks them.
    """
    low = F.lower(col(c))
    spaced = F.regexp_replace(low, _BREAKS, " ")
    single = F.regexp_replace(spaced, r"[\p{IsHan}\p{IsHiragana}]\p{M}*", " $0 ")
    apart = F.regexp_replace(single, rf"(?<={_KANA})(?={_LETTER}|\p{{Nl}}|\p{{Nd}})|(?<={_LETTER}|\p{{Nl}}|\p{{Nd}})(?={_KANA})", " ")
    cut_out = F.filter(F.split(apart, " +"), lambda t: F.rlike(t, F.lit(r"[\p{L}\p{Nl}\p{Nd}]")))
    words = F.when(F.rlike(low, F.lit(_KANA)), cut_out).otherwise(F.regexp_extract_all(low, F.lit(_WORD), F.lit(0)))
    cut = lambda t: F.transform(F.sequence(F.lit(0), F.floor((F.length(t) - 1) / TOKEN_CHARS).cast("int")), lambda i: F.substring(t, i * TOKEN_CHARS + 1, F.lit(TOKEN_CHARS)))
    whole = lambda t: F.when(F.length(t) <= TOKEN_CHARS, F.array(t)).otherwise(cut(t))
    return let(words, lambda w: F.when(F.exists(w, lambda t: F.length(t) > TOKEN_CHARS), F.flatten(F.transform(w, whole))).otherwise(w))


def ngrams(c, sizes=(2, 3, 4)) -> Column:
    """Distinct substrings of the given lengths, longest first, then by place."""
    c = col(c)
    of = lambda n: F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.flatten(F.array(*[of(n) for n in sorted(sizes, reverse=True)])))


def truncated_for_embedding(c, limit: int = EMBED_CHARS) -> Column:
    """At most ``limit`` characters: leading header lines stay, the rest is cut after its last sentence end."""
    c = col(c)
    header = F.regexp_extract(c, r"^((?:\[(?:文档|章节)\][^\n]*\n)*)", 1)
    budget = F.greatest(F.lit(0), F.lit(limit) - F.length(header))
    room = F.substring(c, F.length(header) + 1, budget)
    cut = F.regexp_extract(room, r"(?s)^(.*[。！？；])", 1)
    return (
        F.when(F.length(c) <= limit, c)
        .when(F.length(header) >= limit, F.left(c, F.lit(limit)))
        .otherwise(F.concat(header, F.when(F.length(cut) > 0, cut).otherwise(room)))
    )


def snippet(text, query: str, before: int = 600, head: int = 1800, longest: int = 8) -> Column:
    """The text around the longest query substring (first of that length) that it holds, else its beginning."""
    text = col(text)
    grams = dict.fromkeys(query[i : i + n] for n in range(longest, 1, -1) for i in range(len(query) - n + 1))
    hit = F.coalesce(*[F.when(F.contains(text, F.lit(g)), F.lit(g)) for g in grams], F.lit(None).cast("string"))

    def around(found: Column) -> Column:
        at = F.position(found, text)
        begin = F.greatest(F.lit(1), at - before)
        end = F.least(F.length(text), at + F.length(found) - 1 + before)
        cut = F.concat(F.when(begin > 1, "…").otherwise(""), F.substring(text, begin, end - begin + 1), F.when(end < F.length(text), "…").otherwise(""))
        return F.when(found.isNull(), F.left(text, F.lit(head))).otherwise(cut)

    return let(hit, around)


def char_overlap(a, b) -> Column:
    """Distinct letters and digits that both hold, without case."""
    chars = lambda c: F.array_distinct(F.split(F.regexp_replace(F.lower(col(c)), r"[^\p{L}\p{N}]", ""), ""))
    return F.size(F.array_except(F.array_intersect(chars(a), chars(b)), F.array(F.lit(""))))


def literal_offsets(text, keyword: str, case_sensitive: bool = False, whole_word: bool = False) -> Column:
    """0-based starts of all non-overlapping matches of a literal in the text as it stands, from the lengths between them."""
    plain = "".join("\\" + ch if not ch.isalnum() and ch != "_" and ord(ch) < 128 else ch for ch in keyword)
    rule = rf"(?U)(?<!\w){plain}(?!\w)" if whole_word else plain
    parts = F.split(col(text), rule if case_sensitive else f"(?iu){rule}", -1)
    none = F.array().cast("array<int>")
    walked = F.aggregate(
        F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))),
        F.struct(F.lit(0).alias("at"), none.alias("starts")),
        lambda acc, p: F.struct((acc["at"] + F.length(p) + len(keyword)).alias("at"), F.concat(acc["starts"], F.array(acc["at"] + F.length(p))).alias("starts")),
        lambda acc: acc["starts"],
    )
    return F.coalesce(walked, none)


def stripped(c) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+\z", "")


# Names and patterns of text that is no finding, in the order they are tried.
SEQUENCE_ONLY = r"\s*(?:(?:第?[一二三四五六七八九十百千]+(?:章|节|条|款|项)?[、.]?)|(?:[（(][一二三四五六七八九十百千\dA-Za-z]+[）)])|(?:[（(]?\d+[）).、.]?)|(?:[（(]?[A-Za-z][）).、.]?)|[①-⑳])\s*"
PLACEHOLDER = r"(?:_{2,}|＿{2,}|﹍{2,}|-{3,}|…{2,})|(?:[_＿﹍]+\s*年\s*[_＿﹍]+\s*月\s*[_＿﹍]+\s*日)|(?:[_＿﹍]{1,}\s*(?:元|万元|美元|人民币))"
CHECKBOX = r"[□☐☑☒○◯●◎]|(?:^|[\s:：;；,，])口(?:$|[\s:：;；,，])"
FORMAT_ONLY = r"[\s:：;；,，.。·•\-—–_=＿﹍/\\|]+"
STANDARD_LABEL = r"(?:甲方|乙方|丙方|用人单位|劳动者|员工|签字|签名|盖章|公章|工资结算|工资发放|结算|发放|日期|年月日|经办人|法定代表人)(?:\s*[（(][^）)]{0,12}[）)])?\s*[:：]?\s*"
SIGNATURE_LINE = r"(?:(?:甲方|乙方|丙方|用人单位|劳动者|员工)\s*[:：]?\s*)?(?:签字|签名|盖章|公章)\s*[:：]?\s*"
ISOLATED_DATE = r"\s*(?:\d{4}|[一二〇零]{4})\s*[年./-]\s*\d{1,2}\s*[月./-]\s*\d{1,2}\s*日?\s*"
ISOLATED_NUMBER = r"\s*(?:人民币|RMB|CNY|USD|US\$|美元|[$￥¥])?\s*[+-]?(?:\d{1,3}(?:[,，]\d{3})+|\d+)(?:\.\d+)?\s*[万亿]?\s*(?:人民币|RMB|CNY|USD|美元|元|万元|亿元|天|日|个月|月|年|%|％)?\s*"
FALSE_POSITIVES = (
    ("sequence_marker", f"^(?:{SEQUENCE_ONLY})\\z"),
    ("placeholder", PLACEHOLDER),
    ("checkbox_or_option", CHECKBOX),
    ("format_marker", f"^(?:{FORMAT_ONLY})\\z"),
    ("standard_contract_label", f"^(?:{STANDARD_LABEL}|{SIGNATURE_LINE})\\z"),
    ("isolated_date", f"^(?:{ISOLATED_DATE})\\z"),
    ("isolated_numeric_value", f"^(?i:{ISOLATED_NUMBER})\\z"),
)


def false_positive_reason(quote) -> Column:
    """Why a quote is no finding, first reason first; null for a real one."""
    q = stripped(quote)
    out = F.when(q.isNull() | (q == ""), "empty")
    for name, rule in FALSE_POSITIVES:
        out = out.when(q.rlike(rule), name)
    return out


def heading_level(c) -> Column:
    return F.when(col(c).rlike(r"^第[一二三四五六七八九十百零〇\d]+章"), 1).when(col(c).rlike(r"^第[一二三四五六七八九十百零〇\d]+节"), 2).when(col(c).rlike(r"^第[一二三四五六七八九十百零〇\d]+条"), 3).otherwise(2)


# Words of questions that need several documents.
COMPLEX_WORDS = ("比较", "区别", "各", "分别", "所有", "总结", "汇总")


def is_complex(c, longest: int = 20) -> Column:
    return (F.length(col(c)) > longest) | col(c).rlike("|".join(COMPLEX_WORDS))


# Fixed pattern: how a numbered heading begins.
HEADING = r"^(第[一二三四五六七八九十百零0-9]+[章节条款]|[一二三四五六七八九十]+[、.．]|（[一二三四五六七八九十]）|\d+[.、])"


def is_heading(c, longest: int = 40) -> Column:
    """A short text that begins with a heading number."""
    t = F.trim(col(c))
    return (F.length(t) <= longest) & t.rlike(HEADING)


def first_present(*columns) -> Column:
    """The first text that is not blank, trimmed; empty if none."""
    return F.coalesce(*[F.nullif(F.trim(col(c)), F.lit("")) for c in columns], F.lit(""))


def common_prefix(a, b) -> Column:
    """Length of the longest common prefix."""
    a, b = col(a), col(b)
    # By halves: prefixes of one length are compared as a whole; where one text begins with the other there is nothing to halve.
    steps = F.array(*[F.lit(1 << k) for k in range(24, -1, -1)])
    longer = lambda n: lambda have, step: F.when((have + step <= n) & (F.substring(a, F.lit(1), have + step) == F.substring(b, F.lit(1), have + step)), have + step).otherwise(have)
    halved = let(F.least(F.length(a), F.length(b)), lambda n: F.aggregate(steps, F.lit(0), longer(n)))
    return F.when(F.startswith(a, b), F.length(b)).when(F.startswith(b, a), F.length(a)).when(a.isNotNull() & b.isNotNull(), halved)


def flattened(c) -> Column:
    """The text of a plain string, of a JSON list of {text} or of a JSON object with text."""
    c = col(c)
    parts = F.transform(F.from_json(c, "array<struct<text: string>>"), lambda x: x["text"])
    return F.when(c.startswith("["), F.array_join(F.array_compact(parts), "")).when(c.startswith("{"), F.coalesce(F.get_json_object(c, "$.text"), F.lit(""))).otherwise(c)


def partial_answer(c) -> Column:
    """The answer so far in JSON that may still be arriving; null before it begins or while it ends inside an escape."""
    c = col(c)
    closed = F.regexp_extract_all(c, F.lit(r'"answer"\s*:\s*"((?:[^"\\]|\\.)*)"'), 1)
    opened = F.regexp_replace(F.regexp_extract(c, r'(?s)"answer"\s*:\s*"(.*)$', 1), r"\\$", "")
    body = F.when(F.size(closed) > 0, F.element_at(closed, -1)).when(opened != "", opened)
    return F.get_json_object(F.concat(F.lit('{"a":"'), body, F.lit('"}')), "$.a")


def route_label(decision) -> Column:
    """local if the decision says so or is missing, else web."""
    d = F.lower(col(decision))
    return F.when(d.isNull() | F.contains(d, F.lit("local")), "local").otherwise("web")


def hashed_vector(c, dims: int = 16) -> Column:
    """Token counts by the first hexadecimal digit of their hash: a stand-in where no embedding service is at hand."""
    digits = F.transform(tokens(c), lambda t: F.conv(F.left(F.md5(t.cast("binary")), F.lit(1)), 16, 10).cast("int") % dims)
    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda k: F.size(F.filter(digits, lambda x: x == k)).cast("double"))


def parsed_time(c, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """A timestamp, or null for what is none."""
    return F.try_to_timestamp(col(c), F.lit(pattern))


def threshold(c) -> Column:
    """A decimal from text with thousands separators; null if it is none, which leaves a rule indeterminate."""
    return F.regexp_replace(col(c), "[,，]", "").try_cast("decimal(38,6)")


def model_items(c, schema: str) -> Column:
    """The items of the first {...} in a model's answer; null if it does not parse."""
    return F.from_json(F.regexp_extract(col(c), r"(?s)\{.*\}", 0), f"items array<{schema}>")["items"]
