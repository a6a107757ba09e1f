"""Text functions as columns: redaction, hashes, n-grams, similarity, templates."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Patterns and marks of redaction. Fixed values.
ID_CARD = r"(?<![0-9A-Za-z])[1-9][0-9]{5}(?:19|20)[0-9]{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])[0-9]{3}[0-9Xx](?![0-9A-Za-z])"
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
ORDER_NUMBER = r"(?:订单号|订单编号|订单流水号|订单ID|订单\s*id)\s*[:：#为是]?\s*[A-Za-z0-9][A-Za-z0-9\-]{5,}"
TRACKING_NUMBER = r"(?:运单号|快递单号|物流单号|包裹号|快递编号)\s*[:：#为是]?\s*[A-Za-z0-9][A-Za-z0-9\-]{5,}"
PHONE = r"(?<![0-9A-Za-z])(?:\+?86[-\s]?|0086[-\s]?)?1[3-9][0-9](?:[-\s]?[0-9]{4}){2}(?![0-9A-Za-z])"
# An address, what makes one of a match (a bare city stays), and the short form that is replaced after it.
ADDRESS = r"(?:[一-龥]{2,8}(?:省|自治区|特别行政区))?[一-龥]{2,8}(?:市|自治州|地区|盟)(?:[一-龥]{2,8}(?:区|县|旗|市))?(?:[一-龥A-Za-z0-9]{1,20}(?:路|街|街道|巷|弄|大道))?(?:\s*[0-9]{1,5}\s*号)?(?:[一-龥A-Za-z0-9]{0,20}(?:小区|大厦|广场|公寓|花园|写字楼|号楼|栋|单元|室))?"
PLACE = "区|县|镇|街道|路|街|巷|弄|大道|号|小区|大厦|广场|公寓|花园|号楼|栋|单元|室"
SHORT_ADDRESS = r"[一-龥]{2,6}(?:市|省)[一-龥]{2,8}(?:区|县|镇|街道|路|街)"
# Topic inputs: a label that stays, and what follows it.
LABELLED = [
    (r"((?:姓名|收件人|联系人|我叫)\s*[:：]?\s*)[一-鿿]{2,4}", "[姓名]"), (r"((?:账号|账户|银行卡号|支付宝|微信号)\s*[:：]?\s*)[A-Za-z0-9_@.\-]{3,}", "[账号]"),
    (r"()(?<![A-Za-z0-9])[0-9]{10,}(?![A-Za-z0-9])", "[长编号]"), (r"((?:地址|住址|收货地址)\s*[:：]\s*)[^，。；\n]+", "[地址]"),
]
REDACTIONS = {"id_card": ID_CARD, "email": EMAIL, "order": ORDER_NUMBER, "tracking": TRACKING_NUMBER, "phone": PHONE}


def mark(kind: str) -> str:
    return f"[{kind.upper()}]"


# What a match of the patterns can't lack. Marks bring none of it in, so a text without it is as it was after each step. Fixed values.
NEEDED = ("@", "订单", "单号", "包裹号", "快递编号", "市", "省", "自治州", "地区", "盟", "\ufdd0", "\ufdd1")
DIGITS = r"[0-9]{17}|1[3-9][0-9][-\s]?[0-9]{4}"
LABELS = ("姓名", "收件人", "联系人", "我叫", "账号", "账户", "银行卡号", "支付宝", "微信号", "地址", "住址")


def _may_match(text: Column, words: Iterable[str], digits: str) -> Column:
    """Whether a text holds a word or digits: looking for these costs much less than the patterns, which are tried from each character."""
    return reduce(lambda p, q: p | q, (F.contains(text, F.lit(w)) for w in words)) | text.rlike(digits)


def redact(text: Column) -> Column:
    """Private data as marks: identity cards, e-mail, order and tracking numbers, phones, then addresses. Null is empty."""
    return F.when(_may_match(text, NEEDED, DIGITS), _redacted(text)).otherwise(F.coalesce(text, F.lit("")))


def _redacted(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for kind, pattern in REDACTIONS.items():
        out = F.regexp_replace(out, pattern, mark(kind))
    # Every match is put between two characters that no text has; those with a place in them are replaced, the others freed.
    out = F.regexp_replace(out, f"({ADDRESS})", f"{_OPEN}$1{_SHUT}")
    out = F.regexp_replace(out, f"{_OPEN}[^{_SHUT}]*(?:{PLACE})[^{_SHUT}]*{_SHUT}", mark("address"))
    return F.regexp_replace(F.translate(out, _OPEN + _SHUT, ""), SHORT_ADDRESS, mark("address"))


#: Noncharacters of Unicode.
_OPEN, _SHUT = "\ufdd0", "\ufdd1"


def private_kinds(text: Column) -> Column:
    """Which kinds of private data a text holds, in the order of redaction."""
    kinds = F.array(*(F.when(text.rlike(p), k) for k, p in REDACTIONS.items()), F.when(F.contains(_redacted(text), F.lit(mark("address"))) & ~F.contains(text, F.lit(mark("address"))), "address"))
    return F.when(_may_match(text, NEEDED, DIGITS), F.filter(kinds, lambda k: k.isNotNull())).otherwise(F.array().cast("array<string>"))


def topic_input(text: Column) -> Column:
    """A question as the classifier gets it: redacted, with labelled names, accounts, long numbers and addresses as marks. Null if blank."""
    out = _redacted(text)
    for pattern, token in LABELLED:
        out = F.regexp_replace(out, pattern, "$1" + token)
    out = F.when(_may_match(text, NEEDED + LABELS, DIGITS + "|[0-9]{10}"), out).otherwise(F.coalesce(text, F.lit("")))
    return F.when(F.trim(F.coalesce(text, F.lit(""))) != "", F.regexp_replace(out, r"^\s+|\s+$", ""))


def canonical_json(**fields: Column) -> Column:
    """A JSON object with its keys in order and no spaces; nulls are written."""
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"})


def numbered_list(text: Column, header: str) -> Column:
    """The entries of a list under a header line, numbered 1, 2, 3, ... without a gap; null if anything else stands there, or one repeats."""
    lines = F.split(text, "\n")
    entries = F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))
    names = F.transform(entries, lambda x: F.regexp_extract(x, r"^[0-9]+[.、] (.+)$", 1))
    numbers = F.transform(entries, lambda x: F.regexp_extract(x, r"^([0-9]+)[.、] .+$", 1))
    counted = F.transform(F.sequence(F.lit(1), F.size(entries)), lambda i: i.cast("string"))
    fine = (F.get(lines, F.lit(0)) == header) & (F.size(entries) > 0)
    sound = (numbers == counted) & (F.size(F.array_distinct(names)) == F.size(names)) & F.forall(names, lambda x: (F.length(x) <= 64) & (x == F.trim(x)) & ~x.rlike(r"[\x00-\x1f\u2028\u2029]"))
    return F.when(fine & sound, names)


def resolve_option(text: Column, options: Column, index: Column) -> Column:
    """Which of the listed options a text means: the one that stands in it as a whole, in any case, if there is just one and the number given, if any, is its place; else the one at that number. Null if none or unclear."""
    # An option is a whole word of the text if both, with borders around, are: identifiers have no borders inside.
    words = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), "[^a-z0-9_#-]+", " "), F.lit(" "))
    named = F.filter(options, lambda o: F.contains(words, F.concat(F.lit(" "), F.lower(o), F.lit(" "))))
    listed = F.when((index >= 1) & (index <= F.size(options)), F.get(options, index - 1))
    only = F.get(named, F.lit(0))
    return F.when((F.size(named) == 1) & (index.isNull() | (only == listed)), only).when(F.size(named) == 0, listed)


def covered(quote: Column, text: Column) -> Column:
    """Whether a quote stands in a text, both in lower case and without white space and punctuation; a blank quote doesn't."""
    plain = lambda c: F.lower(F.regexp_replace(c, r"[\s\p{Punct}]+", ""))
    return (plain(quote) != "") & F.contains(plain(text), plain(quote))


def has_mark(text: Column) -> Column:
    return text.rlike(r"\[(?:" + "|".join(k.upper() for k in [*REDACTIONS, "address"]) + r")\]")


def digest(*parts: Column, by: str = "\n") -> Column:
    return F.sha2(F.concat_ws(by, *parts), 256)


def token_estimate(text: Column) -> Column:
    """0 for an empty text, else at least 1: characters over 1.1, rounded up."""
    return F.when(F.length(text) == 0, 0).otherwise(F.greatest(F.lit(1), (F.length(text) / F.lit(1.1) + F.lit(0.999)).cast("int")))


def ngrams(text: Column, n: int) -> Column:
    """Distinct runs of n characters; a shorter text is its only one."""
    return F.when(F.length(text) <= n, F.array(text)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n)))))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def grounded(claim: Column, source: Column, n: int = 4, short: int = 12, least: float = 0.6) -> Column:
    """A short claim stands in the source; of a longer one, enough n-grams do."""
    own = ngrams(claim, n)
    return F.when(F.length(claim) <= short, F.contains(source, claim)).otherwise(F.size(F.array_intersect(own, ngrams(source, n))) / F.size(own) >= least)


def confidence(text: Column) -> Column:
    """A number from 0 to 1, or null."""
    value = text.try_cast("double")
    return F.when((value >= 0) & (value <= 1), value)


def whole_identifier(text: Column, identifier: str) -> Column:
    """The identifier stands in the text, and not as a part of a longer one."""
    escaped = "".join(f"\\{c}" if not c.isalnum() else c for c in identifier)
    return text.rlike(rf"(?<![A-Za-z0-9_-]){escaped}(?![A-Za-z0-9_-])")


def citations(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.cast("int"))


#: A marker, in either kind of brackets, with the blanks before it; fixed values.
BARE_MARKER = r"[ \t]*(?:\[[0-9]+\]|［[0-9]+］)"


def checked_citations(answer: Column, permitted: Column) -> Column:
    """What becomes of an answer that may cite the numbers of `permitted` (array of int): verdict, used and text.

    Without any permitted number the markers stand for nothing and are taken out (plain). Else the numbers that it uses, in order and once each, must be some and all
    be permitted (cited); an answer that cites nothing, or something else, is refused, and has no text. A null answer, or permitted, counts as empty.
    """
    text, allowed = F.coalesce(answer, F.lit("")), F.coalesce(permitted, F.array().cast("array<int>"))
    # Markers of more digits than an int has are permitted by nothing.
    used = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\[([0-9]+)\]"), F.lit(1)), lambda x: F.coalesce(x.try_cast("int"), F.lit(-1))))
    verdict = F.when(F.size(allowed) == 0, "plain").when((F.size(used) > 0) & (F.size(F.array_except(used, allowed)) == 0), "cited").otherwise("refused")
    kept = F.when(verdict == "plain", F.regexp_replace(text, BARE_MARKER, "")).when(verdict == "cited", text)
    return F.struct(verdict.alias("verdict"), F.when(verdict == "cited", used).otherwise(F.array().cast("array<int>")).alias("used"), kept.alias("text"))


def embedding_text(category: Column, questions: Column, answer: Column) -> Column:
    """The text that a chunk's vector stands for; blank parts are left out."""
    asked = F.array_join(F.filter(questions, lambda q: F.trim(q) != ""), " / ")
    parts = F.array(F.concat(F.lit("category: "), F.nullif(category, F.lit(""))), F.concat(F.lit("questions: "), F.nullif(asked, F.lit(""))), F.concat(F.lit("answer: "), F.nullif(answer, F.lit(""))))
    return F.array_join(F.filter(parts, lambda p: p.isNotNull()), "\n")


@F.pandas_udf(T.DoubleType())
def ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Ratcliff-Obershelp similarity. Costly: apply it to pairs that have passed length and n-gram bounds."""
    from difflib import SequenceMatcher

    for a, b in pairs:
        yield pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)])


@F.pandas_udf(T.ArrayType(T.StringType()))
def sentences(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Sentences of a text: lines are cut after terminators and the quotes or brackets that close them; decimals are kept whole."""
    import re

    # Terminators, closers, what may stand before a full stop and after it.
    end = re.compile(r"(?:(?:[。！？；!?]|…{2,}|\.{3,})+|(?<=[A-Za-z0-9)\]\"'%])\.(?=[\"'”’）\]】》」』]*\s+[A-Z一-鿿]))[\"'”’）\]】》」』]*")

    def cut(text: str | None) -> list[str]:
        out = []
        for line in re.split(r"\n+", text or ""):
            line, at = line.strip(" \t　"), 0
            for m in end.finditer(line):
                out.append(line[at : m.end()].strip(" \t　"))
                at = m.end()
            out.append(line[at:].strip(" \t　"))
        return [s for s in out if s]

    for series in texts:
        yield series.map(cut)
