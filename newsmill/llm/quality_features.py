"""Document statistics that the quality classifier sees; none of them uses an id, a language or a source."""

from __future__ import annotations

import math
import re

# Byte classes of the UTF-8 text; bytes from 0x80 on count as letters.
_UPPER = bytes(range(65, 91))
_DIGIT = bytes(range(48, 58))
_SYMBOL = b"#*$%&|<>{}[]~^=+_\\@/"
_STOP = b".!?:;,"
_KEEP = bytes(range(256))
_RUN = re.compile(rb"(.)\1{2,}", re.S)

NAMES = (
    "log_words", "log_chars", "word_length", "long_words", "short_words", "distinct_words", "repeat_next", "upper", "digits", "symbols", "bars",
    "stops", "exclaims", "non_ascii", "log_lines", "line_words", "stop_ends", "same_lines", "short_lines", "blank_lines", "top_word", "runs",
    "symbol_words", "capital_words", "pair_repeats", "spread",
)


def _share(a: float, b: float) -> float:
    return a / b if b else 0.0


def features(text: bytes) -> list[float]:
    """Statistics of a whole text; an empty text gives zeros."""
    words = text.split()
    n, size = len(words), len(text)
    if not n:
        return [0.0] * len(NAMES)
    letters = sum(map(len, words))
    count = lambda cls: size - len(text.translate(None, cls))
    lines = text.split(b"\n")
    full = [x for x in lines if x.strip()]
    distinct = set(words)
    lengths = list(map(len, words))
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    nexts = sum(map(bytes.__eq__, words, words[1:]))
    upper = count(_UPPER)
    symbols = count(_SYMBOL)
    symbol_words = sum(w[-1] in b"#*$%&|<>!" for w in words)
    capital = sum(map(bytes.istitle, words))
    mean = letters / n
    return [
        math.log1p(n),
        math.log1p(size),
        mean,
        _share(sum(x > 12 for x in lengths), n),
        _share(sum(x < 4 for x in lengths), n),
        len(distinct) / n,
        _share(nexts, n),
        upper / letters,
        count(_DIGIT) / letters,
        symbols / letters,
        text.count(b"|") / n,
        count(_STOP) / n,
        text.count(b"!") / n,
        (size - len(text.translate(None, _KEEP[128:]))) / letters,
        math.log1p(len(full)),
        math.log1p(n / max(1, len(full))),
        _share(sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in full), len(full)),
        1 - _share(len(set(full)), len(full)),
        _share(sum(len(x) < 30 for x in full), len(full)),
        _share(len(lines) - len(full), len(lines)),
        max(seen.values()) / n,
        len(_RUN.findall(text)) / n,
        symbol_words / n,
        capital / n,
        1 - _share(len(set(zip(words, words[1:]))), n - 1) if n > 1 else 0.0,
        math.sqrt(max(0.0, sum(x * x for x in lengths) / n - mean * mean)),
    ]
