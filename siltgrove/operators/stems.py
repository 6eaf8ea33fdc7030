"""English stems after the published Porter algorithms, as a table of suffix rules that one small engine applies."""

from __future__ import annotations

import re
from functools import lru_cache

# Suffix rules of the revised algorithm (longest match counts), words with stems of their own.
STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate",
    "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive",
    "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less",
}
STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize".split()
EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
    "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
KEPT = frozenset("inning outing canning herring earring proceed exceed succeed".split())
# End of fixed values.

_VOWEL = "aeiouy"
_DOUBLE = re.compile(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$")


def _regions(w: str) -> tuple[int, int]:
    """Where the first and the second region start: after the first consonant that follows a vowel, and again."""

    def after(k: int) -> int:
        m = re.search(r"[aeiouy][^aeiouy]", w[k:])
        return k + m.end() if m else len(w)

    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = after(0) if r1 is None else r1
    return r1, after(r1)


def _short(w: str, r1: int) -> bool:
    return r1 >= len(w) and bool(re.search(r"([^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$", w))


@lru_cache(maxsize=200_000)
def english(word: str) -> str:
    """The stem of an English word under the revised algorithm."""
    w = word.lower().replace("’", "'")
    if len(w) <= 2:
        return w
    if w in EXCEPTIONS:
        return EXCEPTIONS[w]
    w = w.lstrip("'")
    w = re.sub(r"(^|[aeiouy])y", r"\1Y", w)
    r1, r2 = _regions(w)
    w = re.sub(r"'s'$|'s$|'$", "", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(r"[aeiouy].+s$", w) and re.search(r"[aeiouy]", w[:-2]):
        w = w[:-1]
    if w in KEPT:
        return w
    m = re.search(r"(eedly|eed|ingly|edly|ing|ed)$", w)
    if m and m[1] in ("eed", "eedly"):
        if m.start() >= r1:
            w = w[: m.start()] + "ee"
    elif m and re.search(r"[aeiouy]", w[: m.start()]):
        w = w[: m.start()]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _DOUBLE.search(w):
            w = w[:-1]
        elif _short(w, min(r1, len(w)) if r1 >= len(w) else r1):
            w += "e"
    w = re.sub(r"(?<=[^aeiouy])(?<!^)[yY]$", "i", w) if len(w) > 2 else w
    for suffix in sorted([*STEP2, "ogi", "li"], key=len, reverse=True):
        if w.endswith(suffix):
            at = len(w) - len(suffix)
            if at >= r1:
                if suffix == "ogi":
                    w = w[:-1] if w[at - 1 : at] == "l" else w
                elif suffix == "li":
                    w = w[:-2] if w[at - 1 : at] and w[at - 1] in "cdeghkmnrt" else w
                else:
                    w = w[:at] + STEP2[suffix]
            break
    for suffix in sorted([*STEP3, "ative"], key=len, reverse=True):
        if w.endswith(suffix):
            at = len(w) - len(suffix)
            if suffix == "ative":
                w = w[:at] if at >= r2 else w
            elif at >= r1:
                w = w[:at] + STEP3[suffix]
            break
    for suffix in sorted([*STEP4, "ion"], key=len, reverse=True):
        if w.endswith(suffix):
            at = len(w) - len(suffix)
            if at >= r2 and (suffix != "ion" or w[at - 1 : at] in ("s", "t")):
                w = w[:at]
            break
    if w.endswith("e"):
        at = len(w) - 1
        if at >= r2 or at >= r1 and not re.search(r"([^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$", w[:-1]):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()
