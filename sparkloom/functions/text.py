"""Scalar functions on texts and payloads, as column expressions."""

from __future__ import annotations

import difflib
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Numerals, title prefixes, law tokens, hints and patterns that results depend on.
DIGITS = {"零": 0, "〇": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
UNITS = {"十": 10, "百": 100, "千": 1000}
TEN_THOUSAND = "万"
NUMERAL = "0-9一二三四五六七八九十百千万零〇两"
TITLE_PREFIXES = ("中华人民共和国", "中国人民", "国务院")
IMPLEMENTING = ("实施条例", "实施细则")
SELF_TOKEN = "本(?:法|条例|办法|细则|规定|规则)"
LAW_TOKEN = SELF_TOKEN + r"|《[^》]{2,60}》|[一-鿿]{2,40}?(?:条例|办法|细则|规定|通知|公告|决定|规则|(?<!本)法)"
CITATION = (
    rf"(?U)({LAW_TOKEN})\s*第\s*([{NUMERAL}]+)\s*条"
    rf"(?:\s*第\s*([{NUMERAL}]+)\s*款)?(?:\s*第?\s*[（(]\s*([{NUMERAL}]+)\s*[)）]\s*项)?"
)
SECTION_ARTICLE = rf"(?U)^\s*第\s*([{NUMERAL}]+)\s*条"
OUTER_MARKS = "《》〈〉「」『』【】()（）[]〔〕“”\"'、,，。.；;：:!！?？…·-—_/\\|"
TRAILING_NOISE = ("等", "的", "相关", "有关规定")
ENTITY_TYPES = {"tax_type": "税种", "taxpayer": "纳税主体", "tax_object": "征税对象", "preference": "优惠政策", "procedure": "征管事项"}
QUOTA_HINTS = ("quota", "insufficient", "balance", "arrears", "billing", "余额", "额度", "欠费", "账户")
RATE_HINTS = ("rate limit", "too many requests", "429", "concurrent", "并发", "限流")
PROCEDURAL = r"(自[^，。；]{1,20}起(?:施行|执行|生效))|((?:予以|同时|决定)?废止)|(特此(?:公告|通知|说明))"


def squeezed(text: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", "")


def numeral(text: Column) -> Column:
    """The value of an Arabic or Chinese numeral; null if it is empty or isn't one. A bare unit counts as one of it."""
    s = squeezed(text)
    digit = F.create_map(*(x for k, v in DIGITS.items() for x in (F.lit(k), F.lit(v))))
    unit = F.create_map(*(x for k, v in UNITS.items() for x in (F.lit(k), F.lit(v))))
    state = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("group"), F.lit(0).cast("long").alias("digit"))

    def step(a, ch):
        d, u = F.try_element_at(digit, ch), F.try_element_at(unit, ch)
        return (
            F.when(d.isNotNull(), F.struct(a["total"].alias("total"), a["group"].alias("group"), d.cast("long").alias("digit")))
            .when(u.isNotNull(), F.struct(a["total"].alias("total"), (a["group"] + F.greatest(a["digit"], F.lit(1)) * u).cast("long").alias("group"), F.lit(0).cast("long").alias("digit")))
            .otherwise(F.struct((a["total"] + (a["group"] + a["digit"]) * 10000).alias("total"), F.lit(0).cast("long").alias("group"), F.lit(0).cast("long").alias("digit")))
        )

    chinese = F.aggregate(F.split(s, ""), state, step, lambda a: a["total"] + a["group"] + a["digit"])
    letters = "".join([*DIGITS, *UNITS, TEN_THOUSAND])
    return F.when(s.rlike("^[0-9]+$"), F.try_to_number(s, F.lit("9" * 18)).cast("long")).when(s.rlike(f"^[{letters}]+$"), chinese)


def normal_title(title: Column) -> Column:
    return F.regexp_replace(squeezed(title), "^[《》]+|[《》]+$", "")


def short_title(title: Column) -> Column:
    """Without the first fitting prefix, if more than one letter is left."""
    t = normal_title(title)
    out = t
    for p in reversed(TITLE_PREFIXES):
        out = F.when(t.startswith(p) & (F.length(t) > len(p) + 1), F.substring(t, len(p) + 1, 10_000)).otherwise(out)
    return out


def implemented_title(title: Column) -> Column:
    """What an implementing regulation implements, else null."""
    t = normal_title(title)
    out = F.lit(None).cast("string")
    for s in reversed(IMPLEMENTING):
        out = F.when(t.endswith(s) & (F.length(t) > len(s)), F.regexp_replace(t, f"{s}$", "")).otherwise(out)
    return out


def citations(text: Column) -> Column:
    """array<struct<law,article,paragraph,item>> of a text's citations; those whose article can't be read are dropped."""
    t = F.coalesce(text, F.lit(""))
    parts = [F.regexp_extract_all(t, F.lit(CITATION), g) for g in range(1, 5)]
    zipped = F.arrays_zip(*(p.alias(n) for p, n in zip(parts, ("law", "article", "paragraph", "item"))))
    rows = F.transform(
        zipped,
        lambda x: F.struct(F.trim(x["law"]).alias("law"), numeral(x["article"]).alias("article"), numeral(x["paragraph"]).alias("paragraph"), numeral(x["item"]).alias("item")),
    )
    return F.filter(rows, lambda x: x["article"].isNotNull())


def title_references(text: Column) -> Column:
    """Distinct names in 《》, in order of first appearance."""
    names = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("《([^》]{2,60})》"), 1), normal_title)
    return F.array_distinct(F.filter(names, lambda x: x != ""))


def section_article(section: Column) -> Column:
    return numeral(F.regexp_extract(F.coalesce(section, F.lit("")), SECTION_ARTICLE, 1))


def _strip_marks(text: Column) -> Column:
    return F.btrim(text, F.lit(OUTER_MARKS))


def entity_name(raw: Column) -> Column:
    """White space, outer marks and trailing filler words removed."""
    name = _strip_marks(squeezed(raw))
    for noise in TRAILING_NOISE:  # only if three letters or more are left
        name = F.regexp_replace(name, f"^(.{{3,}}){noise}$", "$1")
    return _strip_marks(name)


def entity_type(raw: Column) -> Column:
    """One of the closed list's keys, from a key or its label; else null."""
    token = F.btrim(squeezed(raw), F.lit("`\"'。.：:"))
    known = F.create_map(*(F.lit(x) for k, v in ENTITY_TYPES.items() for x in (k, k, v, k)))
    return F.coalesce(F.try_element_at(known, token), F.try_element_at(known, F.lower(token)))


def entity_key(kind: Column, name: Column) -> Column:
    return F.concat_ws(":", kind, name)


def mention_kind(name: Column, text: Column, clean: bool = False) -> Column:
    """exact: the name stands in the squeezed text; partial: one of its 3-letter parts does; else absent. clean: the name is
    normal already (a column computed before is read several times here)."""
    n = name if clean else entity_name(name)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(n) - 2, F.lit(1))), lambda i: F.substring(n, i, F.lit(3)))
    some = (F.length(n) >= 3) & F.exists(grams, lambda g: F.contains(text, g))
    return F.when(n == "", "absent").when(F.contains(text, n), "exact").when(some, "partial").otherwise("absent")


def is_truncated(finish_reason: Column, content: Column) -> Column:
    c = F.trim(F.coalesce(content, F.lit("")))
    count = lambda x: F.length(c) - F.length(F.replace(c, F.lit(x), F.lit("")))
    return F.coalesce(finish_reason == "length", F.lit(False)) | (count("{") > count("}"))


def failure_kind(message: Column) -> Column:
    m = F.lower(message)
    has = lambda hints: F.exists(F.array(*map(F.lit, hints)), lambda h: F.contains(m, h))
    return F.when(has(QUOTA_HINTS), "quota").when(has(RATE_HINTS), "rate_limit").otherwise("other")


def salvaged_json(content: Column) -> Column:
    """The JSON object of a model's answer, as text: the whole, a fenced block, the outermost braces, those without trailing
    commas; the first that is an object, else null."""
    strip = lambda c: F.btrim(c, F.lit(" \t\n\x0b\x0c\r"))
    t = strip(F.coalesce(content, F.lit("")))
    fenced = strip(F.regexp_extract(t, r"(?s)```(?:json)?\s*(.*?)```", 1))
    braces = F.regexp_extract(t, r"(?s)(\{.*\})", 1)
    tidy = F.regexp_replace(braces, r",\s*([}\]])", "$1")
    # the parser stops after a value; as the only item of an array nothing may follow it
    listed = lambda c: F.concat(F.lit("["), c, F.lit("]"))
    ok = lambda c: F.when(F.startswith(c, F.lit("{")) & F.try_parse_json(listed(c)).isNotNull() & (F.json_array_length(listed(c)) == 1), c)
    return F.coalesce(*map(ok, (t, fenced, braces, tidy)))


def masked_url(url: Column) -> Column:
    """Credentials as ***; a user name with a password stays."""
    u = F.coalesce(url, F.lit(""))
    both = F.regexp_replace(u, r"^([a-z0-9+.-]+://)([^@/:]*):[^@/]*@", "$1$2:***@")
    return F.when(u.rlike(r"^[a-z0-9+.-]+://[^@/:]*:[^@/]*@"), both).otherwise(F.regexp_replace(u, r"^([a-z0-9+.-]+://)[^@/]+@", "$1***@"))


def is_procedural(text: Column) -> Column:
    return F.rlike(text, F.lit(PROCEDURAL))


def message_title(message: Column) -> Column:
    """White space collapsed, 40 letters at most."""
    return F.substring(F.trim(F.regexp_replace(F.coalesce(message, F.lit("")), r"(?U)\s+", " ")), 1, 40)


def clipped(text: Column, most: int) -> Column:
    return F.substring(text, 1, most)


@F.pandas_udf(T.StringType())
def statement_key(text: pd.Series) -> pd.Series:
    """Compatibility-composed, lower-cased letters and digits only. Spark has no Unicode normalisation."""
    return text.map(lambda t: "".join(c for c in unicodedata.normalize("NFKC", t or "").lower() if c.isalnum()))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """difflib's ratio of two texts."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)], dtype=float)
