"""Language detection by script, tags and codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tag by name, and the codes that mean it.
LANGUAGES = {
    "ChineseSimplified": ("zh-Hans", ("zh", "zh-hans", "chs", "zh-cn")),
    "ChineseTraditional": ("zh-Hant", ("zh-tw", "zh-hant", "cht")),
    "Japanese": ("ja", ("ja", "jpn")),
    "Korean": ("ko", ("ko", "kor")),
    "English": ("en", ("en", "eng")),
    "German": ("de", ("de", "deu")),
    "French": ("fr", ("fr", "fra")),
    "Spanish": ("es", ("es", "spa")),
    "Russian": ("ru", ("ru", "rus")),
    "Portuguese": ("pt", ("pt", "por")),
    "Italian": ("it", ("it", "ita")),
    "Dutch": ("nl", ("nl", "dut")),
    "Polish": ("pl", ("pl", "pol")),
    "Czech": ("cs", ("cs", "cze")),
    "Hungarian": ("hu", ("hu", "hun")),
}
UNKNOWN_TAG = "und"
#: Scripts in the order in which they are tried, with tag and confidence.
SCRIPTS = (
    (r"[\x{3040}-\x{30FF}]", "ja", 0.9),
    (r"[\x{AC00}-\x{D7AF}]", "ko", 0.9),
    (r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}]", "zh-Hans", 0.8),
    (r"[\x{0041}-\x{007A}\x{00C0}-\x{024F}]", "en", 0.5),
)


def _chain(pairs, default: Column) -> Column:
    out = default
    for condition, value in reversed(pairs):
        out = F.when(condition, value).otherwise(out)
    return out


def detect_tag(c: Column) -> Column:
    return _chain([(c.rlike(p), F.lit(tag)) for p, tag, _ in SCRIPTS], F.lit(UNKNOWN_TAG))


def detect_confidence(c: Column) -> Column:
    return _chain([(c.rlike(p), F.lit(x)) for p, _, x in SCRIPTS], F.lit(0.0))


def tag_of_code(c: Column) -> Column:
    """Tag of a language code, in any case; null for an unknown one."""
    low = F.lower(c)
    return _chain([(low.isin(*codes), F.lit(tag)) for tag, codes in LANGUAGES.values()], F.lit(None).cast("string"))


def parse_code(code: str) -> str | None:
    """The same on the driver."""
    return next((tag for tag, codes in LANGUAGES.values() if code.lower() in codes), None)
