"""The English stemmer of the Snowball project (Porter2), and the stop words that go with it."""

from __future__ import annotations

from functools import lru_cache

# Fixed values of the algorithm.
_VOWELS = "aeiouy"
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_BEFORE_LI = "cdeghkmnrt"
_WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_DONE_AFTER_PLURAL = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
_REGION_AFTER = ("gener", "commun", "arsen")
_SECOND = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "ization": "ize", "izer": "ize", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousness": "ous", "ousli": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
_THIRD = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
_FOURTH = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")
STOP_WORDS = frozenset(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves "
    "what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while "
    "of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there "
    "when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now".split())  # fmt: skip


def _region(word: str, start: int) -> int:
    """Where the text after the first consonant that follows a vowel begins."""
    for i in range(start + 1, len(word)):
        if word[i] not in _VOWELS and word[i - 1] in _VOWELS:
            return i + 1
    return len(word)


def _ends_short(w: str) -> bool:
    """Whether the word ends in a short syllable."""
    if len(w) == 2:
        return w[0] in _VOWELS and w[1] not in _VOWELS
    return len(w) > 2 and w[-1] not in _VOWELS + "wxY" and w[-2] in _VOWELS and w[-3] not in _VOWELS


def _longest(w: str, endings) -> str:
    return max((e for e in endings if w.endswith(e)), key=len, default="")


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word) <= 2:
        return word
    if word in _WHOLE:
        return _WHOLE[word]
    w = word.lstrip("'")
    w = "".join("Y" if c == "y" and (i == 0 or w[i - 1] in _VOWELS) else c for i, c in enumerate(w))
    head = next((p for p in _REGION_AFTER if w.startswith(p)), "")
    r1 = len(head) or _region(w, 0)
    r2 = _region(w, r1)
    w = w.removesuffix(_longest(w, ("'s'", "'s", "'")))

    end = _longest(w, ("sses", "ied", "ies", "us", "ss", "s"))
    if end == "sses":
        w = w[:-2]
    elif end in ("ied", "ies"):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif end == "s" and any(c in _VOWELS for c in w[:-2]):
        w = w[:-1]
    if w in _DONE_AFTER_PLURAL:
        return w

    end = _longest(w, ("eedly", "ingly", "edly", "eed", "ing", "ed"))
    if end in ("eed", "eedly"):
        if len(w) - len(end) >= r1:
            w = w[: -len(end)] + "ee"
    elif end and any(c in _VOWELS for c in w[: -len(end)]):
        w = w[: -len(end)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(_DOUBLES):
            w = w[:-1]
        elif len(w) <= r1 and _ends_short(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWELS:
        w = w[:-1] + "i"

    end = _longest(w, _SECOND)
    if end and len(w) - len(end) >= r1 and (end != "ogi" or w.endswith("logi")) and (end != "li" or w[-3:-2] in tuple(_BEFORE_LI)):
        w = w[: -len(end)] + _SECOND[end]
    end = _longest(w, _THIRD)
    if end and len(w) - len(end) >= (r2 if end == "ative" else r1):
        w = w[: -len(end)] + _THIRD[end]
    end = _longest(w, _FOURTH)
    if end and len(w) - len(end) >= r2 and (end != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(end)]
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _ends_short(w[:-1]))) or (w.endswith("ll") and len(w) - 1 >= r2):
        w = w[:-1]
    return w.lower()
