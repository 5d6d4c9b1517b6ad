"""Text functions, Column -> Column. Null in, null out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .entities import unescape  # noqa: F401

# What the article rules look for.
PROMPT_PREFIX = r"(?i)^(?:Show|Launch|Ask|Tell) HN:\s*"
KEYWORDS = (
    "ai|llm|gpt|claude|gemini|llama|openai|anthropic|deepseek|mistral|opencode|"
    "tokens|transformer|diffusion|machine.?learning|deep.?learning|neural.?net|"
    "language.?model|artificial.?intelligen|stable.?diffusion|midjourney|copilot|"
    "chatbot|rag|fine.?tun|embedding|token|lora|rlhf|gguf|ollama|hugging.?face"
)
BLOCKERS = (
    r"(?is)something went wrong.*don't fret",
    r"(?i)disable.*privacy\s+extensions",
    r"(?i)privacy\s+extensions.*and.*retry",
    r"(?i)please\s+(?:sign|log)\s*in",
    r"(?i)sign\s*in\s+to\s+(?:continue|read|access)",
    r"(?i)log\s*in\s+to\s+(?:continue|read|access)",
    r"(?i)subscribe\s+to\s+(?:continue|read|access|unlock)",
    r"(?i)create\s+an?\s+account\s+to\s+(?:continue|read|access)",
    r"(?i)enable\s+javascript\s+to\s+(?:continue|view|use)",
    r"(?i)javascript\s+is\s+(?:disabled|required)",
    r"(?i)access\s+denied",
    r"(?i)403\s+forbidden",
)
BLOCKER_LENGTH = 50
PLAIN = (
    ("[‘’‚]", "'"), ("[“”„]", '"'), ("→", "->"), ("←", "<-"), ("↔", "<->"), ("[–—]", "-"), ("…", "..."), ("[•‣◦▪▫]", "-"),
)
QUIET_ISSUE = r"(?i)^not much happened"
QUOTE_PAIRS = (('"', '"'), ("'", "'"), ("“", "”"), ("‘", "’"))

_SPACE = r"[\s\x1c-\x1f]"


def strip(c: Column) -> Column:
    """Without white space at the ends, Unicode's and the four ASCII separators included (trim() knows the blank only)."""
    return F.regexp_replace(c, f"(?U)^{_SPACE}+|{_SPACE}+$", "")


def whitespace_norm(c: Column) -> Column:
    return strip(F.regexp_replace(c, f"(?U){_SPACE}+", " "))


def clean_title(c: Column) -> Column:
    return strip(F.regexp_replace(c, PROMPT_PREFIX.replace("(?i)", "(?iU)"), ""))


def strip_wrappers(c: Column) -> Column:
    """Strip; one leading [tag]; one leading number; one pair of quotes around all, and the white space inside it."""
    s = F.regexp_replace(strip(c), r"(?U)^\[[^\]]+\]\s*", "")
    s = F.regexp_replace(s, r"(?U)^\d+\.\s*", "")
    inner = strip(F.substring(s, F.lit(2), F.length(s) - 2))
    quoted = F.lit(False)
    for a, b in QUOTE_PAIRS:
        quoted = quoted | (s.startswith(a) & s.endswith(b))
    return F.when((F.length(s) >= 2) & quoted, inner).otherwise(s)


def _pictographs() -> list[list[int]]:
    """Ranges of the characters that carry the emoji-presentation or pictographic property, taken from the regex library's tables
    on the driver, since Java 17's engine doesn't know the properties."""
    import regex

    wanted = regex.compile(r"[\p{Emoji_Presentation}\p{Extended_Pictographic}]")
    ranges: list[list[int]] = []
    for cp in range(0x80, 0x20000):
        if not 0xD800 <= cp < 0xE000 and wanted.match(chr(cp)):
            if ranges and ranges[-1][1] == cp - 1:
                ranges[-1][1] = cp
            else:
                ranges.append([cp, cp])
    return ranges


def _class(ranges) -> str:
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{z:X}}}" for a, z in ranges) + "]"


_EMOJI: list[str] = []


def _emoji() -> str:
    """A pictograph, or several joined; a few coarse ranges in front, since a class of many ranges is slow at every letter."""
    if not _EMOJI:
        fine = _pictographs()
        coarse: list[list[int]] = []
        for a, z in fine:
            if coarse and a - coarse[-1][1] < 0x400:
                coarse[-1][1] = z
            else:
                coarse.append([a, z])
        p = _class(fine)
        _EMOJI.append(f"(?={_class(coarse)}){p}\\x{{FE0F}}?(?:\\x{{200D}}{p}\\x{{FE0F}}?)*")
    return _EMOJI[0]


def sanitize(c: Column) -> Column:
    """ASCII quotes, arrows, dashes, dots and bullets; no emoji; single blanks; stripped. Bullets go before emoji, which would take them.
    Texts of ASCII characters alone skip all but the blanks."""
    plain = c
    for pattern, new in (*PLAIN, (_emoji(), "")):
        plain = F.regexp_replace(plain, pattern, new)
    c = F.when(F.octet_length(c) > F.length(c), plain).otherwise(c)
    return strip(F.regexp_replace(c, " {2,}", " "))


def keyword_match(c: Column) -> Column:
    return c.rlike(rf"(?iu)(?:^|[^\p{{L}}\p{{N}}_])(?:{KEYWORDS})(?:$|[^\p{{L}}\p{{N}}_])")


def is_blocker(c: Column) -> Column:
    """Text too short to be an article, or a wall in front of one."""
    out = F.length(c) < BLOCKER_LENGTH
    for p in BLOCKERS:
        out = out | c.rlike(p.replace("(?i", "(?iU", 1))  # white space is Unicode's
    return out


def is_quiet_issue(title: Column) -> Column:
    return title.rlike(QUIET_ISSUE)


def leaks_source(title: Column, source: Column) -> Column:
    return F.contains(F.lower(title), F.lower(source))


def accept_title(new: Column, old: Column, source: Column) -> Column:
    """The rewritten title, unwrapped and sanitised, unless it is empty, unchanged or names the source; then the old one."""
    made = sanitize(strip_wrappers(new))
    return F.when((made != "") & (made != old) & ~leaks_source(made, source), made).otherwise(old)


def or_empty(c: Column, default: str) -> Column:
    """``default`` where the value is null or empty."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def initials(c: Column) -> Column:
    return F.upper(F.array_join(F.transform(F.slice(F.split(c, " "), 1, 2), lambda w: F.substring(w, 1, 1)), ""))


def split_list(c: Column) -> Column:
    """Comma-separated values, trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(c, ","), strip), lambda x: x != "")


def embedding_text(title: Column, summary: Column, separator: str = "\n\n") -> Column:
    return F.when(F.coalesce(summary, F.lit("")) != "", F.concat(title, F.lit(separator), summary)).otherwise(title)


def lowered(c: Column) -> Column:
    return F.transform(c, lambda x: F.lower(x))


def json_list(c: Column) -> Column:
    """A list of texts from its JSON form; null where it is none."""
    return F.from_json(c, "array<string>")


def list_json(c: Column) -> Column:
    return F.to_json(c)
