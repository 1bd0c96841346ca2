"""The Porter2 (Snowball English) stemmer, after its published definition."""

from __future__ import annotations

import re

# Fixed values of the definition.
VOWELS = "aeiouy"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
BEFORE_LI = "cdeghkmnrt"
WHOLE_PREFIXES = ("gener", "commun", "arsen")
FIXED = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"} | {w: w for w in ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")}
FIXED_LATER = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")

_REGION = re.compile(f"[{VOWELS}][^{VOWELS}]")
_VOWEL = re.compile(f"[{VOWELS}]")
_SHORT = re.compile(f"(?:^[{VOWELS}][^{VOWELS}]|[^{VOWELS}][{VOWELS}][^{VOWELS}wxY])$")


def _longest(word: str, suffixes) -> str | None:
    return max((x for x in suffixes if word.endswith(x)), key=len, default=None)


def _regions(word: str) -> tuple[int, int]:
    whole = next((p for p in WHOLE_PREFIXES if word.startswith(p)), None)
    m = _REGION.search(word)
    one = len(whole) if whole else m.end() if m else len(word)
    m = _REGION.search(word, one)
    return one, m.end() if m else len(word)


def stem(word: str) -> str:
    """The stem of a word in lower case."""
    if len(word) <= 2:
        return word
    if word in FIXED:
        return FIXED[word]
    w = word.removeprefix("'")
    w = re.sub(f"^y|(?<=[{VOWELS}])y", "Y", w)
    one, two = _regions(w)
    # possessives, plurals
    w = w.removesuffix(_longest(w, ("'", "'s", "'s'")) or "")
    if x := _longest(w, ("sses", "ied", "ies", "us", "ss", "s")):
        if x == "sses":
            w = w[:-2]
        elif x in ("ied", "ies"):
            w = w[:-2] if len(w) > 4 else w[:-1]
        elif x == "s" and _VOWEL.search(w[:-2]):
            w = w[:-1]
    if w in FIXED_LATER:
        return w
    # past tenses, participles
    if x := _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly")):
        body = w[: -len(x)]
        if x in ("eed", "eedly"):
            w = body + "ee" if len(body) >= one else w
        elif _VOWEL.search(body):
            w = body
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif w.endswith(DOUBLES):
                w = w[:-1]
            elif _SHORT.search(w) and len(w) <= one:
                w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    # suffixes, the longest that fits decides
    if (x := _longest(w, STEP_2)) and len(w) - len(x) >= one:
        before = w[: -len(x)][-1:]
        if not (x == "ogi" and before != "l" or x == "li" and before not in BEFORE_LI):
            w = w[: -len(x)] + STEP_2[x]
    if (x := _longest(w, STEP_3)) and len(w) - len(x) >= (two if x == "ative" else one):
        w = w[: -len(x)] + STEP_3[x]
    if (x := _longest(w, STEP_4)) and len(w) - len(x) >= two and (x != "ion" or w[:-3].endswith(("s", "t"))):
        w = w[: -len(x)]
    if w.endswith("e"):
        if len(w) - 1 >= two or len(w) - 1 >= one and not _SHORT.search(w[:-1]):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= two:
        w = w[:-1]
    return w.replace("Y", "y")
