"""Two public suffix-stripping stemmers for English, applied to distinct terms."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOWELS = set("aeiouy")


class Porter:
    """The original 1980 algorithm."""

    STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
    STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
    STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")

    @staticmethod
    def _shape(word: str) -> str:
        out = []
        for i, c in enumerate(word):
            vowel = c in "aeiou" or (c == "y" and i > 0 and out[-1] == "c")
            out.append("v" if vowel else "c")
        return "".join(out)

    def measure(self, stem: str) -> int:
        return len(re.findall("v+c+", self._shape(stem)))

    def _double(self, w: str) -> bool:
        return len(w) > 1 and w[-1] == w[-2] and self._shape(w)[-1] == "c"

    def _cvc(self, w: str) -> bool:
        return len(w) > 2 and self._shape(w)[-3:] == "cvc" and w[-1] not in "wxy"

    def __call__(self, word: str) -> str:
        w = word
        if len(w) <= 2 or not w.isascii() or not w.isalpha():
            return w
        for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
            if w.endswith(end):
                w = w[: len(w) - len(end)] + new
                break
        if w.endswith("eed"):
            if self.measure(w[:-3]) > 0:
                w = w[:-1]
        else:
            for end in ("ed", "ing"):
                if w.endswith(end) and "v" in self._shape(w[: -len(end)]):
                    w = w[: -len(end)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif self._double(w) and w[-1] not in "lsz":
                        w = w[:-1]
                    elif self.measure(w) == 1 and self._cvc(w):
                        w += "e"
                    break
        if w.endswith("y") and "v" in self._shape(w[:-1]):
            w = w[:-1] + "i"
        for rules in (self.STEP2, self.STEP3):
            for end, new in sorted(rules, key=lambda r: -len(r[0])):
                if w.endswith(end):
                    if self.measure(w[: -len(end)]) > 0:
                        w = w[: -len(end)] + new
                    break
        for end in sorted(self.STEP4, key=lambda e: -len(e)):
            if w.endswith(end):
                stem = w[: -len(end)]
                if self.measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
                    w = stem
                break
        if w.endswith("e"):
            m = self.measure(w[:-1])
            if m > 1 or (m == 1 and not self._cvc(w[:-1])):
                w = w[:-1]
        if w.endswith("ll") and self.measure(w) > 1:
            w = w[:-1]
        return w


class Porter2:
    """The revised algorithm of the Snowball project for English."""

    SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
    KEPT = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
    DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
    STEP2 = (("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""))
    STEP3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", ""))
    STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")

    @staticmethod
    def _regions(w: str) -> tuple[int, int]:
        def after(start: int) -> int:
            for i in range(start + 1, len(w)):
                if w[i] not in VOWELS and w[i - 1] in VOWELS:
                    return i + 1
            return len(w)

        r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
        r1 = after(0) if r1 is None else r1
        return r1, after(r1)

    @staticmethod
    def _short_syllable(w: str) -> bool:
        if len(w) == 2:
            return w[0] in VOWELS and w[1] not in VOWELS
        return len(w) > 2 and w[-3] not in VOWELS and w[-2] in VOWELS and w[-1] not in VOWELS and w[-1] not in "wxY"

    def __call__(self, word: str) -> str:
        w = word
        if len(w) <= 2 or not w.isascii() or not re.fullmatch(r"[a-z']+", w):
            return w
        if w in self.SPECIAL:
            return self.SPECIAL[w]
        w = w.lstrip("'")
        w = re.sub(r"^y|(?<=[aeiouy])y", "Y", w)
        r1, r2 = self._regions(w)
        for end in ("'s'", "'s", "'"):
            if w.endswith(end):
                w = w[: -len(end)]
                break
        if w.endswith("sses"):
            w = w[:-2]
        elif w.endswith(("ied", "ies")):
            w = w[:-2] if len(w) > 4 else w[:-1]
        elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in VOWELS for c in w[:-2]):
            w = w[:-1]
        if w in self.KEPT:
            return w
        for end in ("eedly", "ingly", "edly", "eed", "ing", "ed"):
            if w.endswith(end):
                if end in ("eed", "eedly"):
                    if len(w) - len(end) >= r1:
                        w = w[: -len(end)] + "ee"
                elif any(c in VOWELS for c in w[: -len(end)]):
                    w = w[: -len(end)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif w.endswith(self.DOUBLES):
                        w = w[:-1]
                    elif r1 >= len(w) and self._short_syllable(w):
                        w += "e"
                break
        if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
            w = w[:-1] + "i"
        for end, new in self.STEP2:
            if w.endswith(end):
                if len(w) - len(end) >= r1:
                    if end == "ogi":
                        w = w[:-1] if w.endswith("logi") else w
                    elif end == "li":
                        w = w[:-2] if len(w) > 2 and w[-3] in "cdeghkmnrt" else w
                    else:
                        w = w[: -len(end)] + new
                break
        for end, new in self.STEP3:
            if w.endswith(end):
                if len(w) - len(end) >= r1 and (end != "ative" or len(w) - len(end) >= r2):
                    w = w[: -len(end)] + new
                break
        for end in self.STEP4:
            if w.endswith(end):
                if len(w) - len(end) >= r2 and (end != "ion" or w[-4:-3] in ("s", "t")):
                    w = w[: -len(end)]
                break
        if w.endswith("e"):
            if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not self._short_syllable(w[:-1])):
                w = w[:-1]
        elif w.endswith("ll") and len(w) - 1 >= r2:
            w = w[:-1]
        return w.replace("Y", "y")


def stem_dictionary(terms: DataFrame, term: str = "term", algorithm: str = "porter2") -> DataFrame:
    """``term, stem`` of each distinct term: the stemmer sees each word once, however often it occurs. Null terms are left out."""
    stemmer = {"porter": Porter, "porter2": Porter2}[algorithm]()

    @F.pandas_udf("string")
    def stem(values: pd.Series) -> pd.Series:
        return values.map(stemmer)

    return terms.where(F.col(term).isNotNull()).select(F.col(term).alias("term")).distinct().withColumn("stem", stem("term"))
