"""The English Snowball stemmer (Porter2), written from its published definition."""

from __future__ import annotations

from functools import lru_cache

_VOWELS = "aeiouy"
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli",
    "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = [
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"),
    ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"),
    ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
]
_STEP3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", "")]
_STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic"]


def _region(word: str, start: int) -> int:
    """The place after the first consonant that follows a vowel, from start on."""
    for k in range(start + 1, len(word)):
        if word[k] not in _VOWELS and word[k - 1] in _VOWELS:
            return k + 1
    return len(word)


def _short_end(word: str) -> bool:
    n = len(word)
    if n == 2:
        return word[0] in _VOWELS and word[1] not in _VOWELS
    return n > 2 and word[-3] not in _VOWELS and word[-2] in _VOWELS and word[-1] not in _VOWELS + "wxY"


@lru_cache(1 << 16)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of fewer than three letters stay."""
    if len(word) < 3:
        return word
    if word in _SPECIAL:
        return _SPECIAL[word]
    w = word.lstrip("'")
    w = "".join("Y" if c == "y" and (k == 0 or w[k - 1] in _VOWELS) else c for k, c in enumerate(w))
    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None) or _region(w, 0)
    r2 = _region(w, r1)

    for end in ("'s'", "'s", "'"):
        if w.endswith(end):
            w = w[: -len(end)]
            break

    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in _VOWELS for c in w[:-2]):
        w = w[:-1]
    if w in _AFTER_1A:
        return w

    if w.endswith(("eedly", "eed")):
        end = 5 if w.endswith("eedly") else 3
        if len(w) - end >= r1:
            w = w[:-end] + "ee"
    else:
        end = next((e for e in ("ingly", "edly", "ing", "ed") if w.endswith(e)), None)
        if end and any(c in _VOWELS for c in w[: -len(end)]):
            w = w[: -len(end)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif w.endswith(_DOUBLES):
                w = w[:-1]
            elif r1 >= len(w) and _short_end(w):
                w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWELS:
        w = w[:-1] + "i"

    for end, new in _STEP2:
        if w.endswith(end):
            if len(w) - len(end) >= r1:
                if end == "ogi":
                    w = w[:-1] if w[-4:-3] == "l" else w
                elif end == "li":
                    w = w[:-2] if w[-3:-2] and w[-3] in "cdeghkmnrt" else w
                else:
                    w = w[: -len(end)] + new
            break
    for end, new in _STEP3:
        if w.endswith(end):
            if len(w) - len(end) >= (r2 if end == "ative" else r1):
                w = w[: -len(end)] + new
            break
    for end in _STEP4:
        if w.endswith(end):
            if len(w) - len(end) >= r2 and (end != "ion" or w[-4:-3] in ("s", "t")):
                w = w[: -len(end)]
            break
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_end(w[:-1])):
            w = w[:-1]
    elif w.endswith("l") and len(w) - 1 >= r2 and w.endswith("ll"):
        w = w[:-1]
    return w.replace("Y", "y")
