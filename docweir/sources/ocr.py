"""What is done around a recogniser of images. None is installed here; one can be passed in."""

from __future__ import annotations

import re
from collections.abc import Callable

from docweir.functions.chars import PY_WS
from docweir.functions.text import CJK_GAPS

CONFIDENCE, CJK_LEAST, LATIN_MOST = 60, 20, 0.4
_CJK = re.compile("[\u3400-\u4dbf\u4e00-\u9fff]")
_LATIN = re.compile("[A-Za-z]")


_GAPS = re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), CJK_GAPS))


def recognised(text: str | None) -> str:
    """What a recogniser gives, trimmed and without the spaces that it puts between CJK characters."""
    return _GAPS.sub("", (text or "").strip(PY_WS))


def latin_share(text: str) -> float:
    latin, cjk = len(_LATIN.findall(text)), len(_CJK.findall(text))
    return latin / max(1, latin + cjk)


def warnings_of(text: str, confidence: int | None) -> list[str]:
    if not text:
        return ["OCR_EMPTY"]
    low = confidence is not None and confidence < CONFIDENCE
    mixed = len(_CJK.findall(text)) >= CJK_LEAST and latin_share(text) > LATIN_MOST
    return ["LOW_OCR_CONF"] * low + ["MIXED_SCRIPT"] * mixed


def score(text: str, confidence: int | None) -> float:
    return (confidence or 0) - 100 * latin_share(text)


def best_attempt(recognise: Callable[[int], tuple[str, int | None]]) -> tuple[str, list[str]]:
    """The text of the first attempt, or of a second, turned one if the first has warnings and the second scores strictly higher."""

    def attempt(n: int) -> tuple[str, int | None]:
        text, confidence = recognise(n)
        return recognised(text), confidence

    best = attempt(0)
    if warnings_of(*best):
        other = attempt(1)
        if score(*other) > score(*best):
            best = other
    return best[0], warnings_of(*best)
