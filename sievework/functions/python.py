"""The few functions that built-in ones cannot express, in Arrow batches."""

from __future__ import annotations

import difflib
import functools
import html
import json
import re
import unicodedata
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_VOWELS = frozenset("aeiou")


def _measure(stem: str) -> int:
    """How many vowel-consonant turns a stem has."""
    kinds = re.sub(r"(.)\1+", r"\1", "".join("v" if _is_vowel(stem, i) else "c" for i in range(len(stem))))
    return kinds.count("vc")


def _is_vowel(word: str, i: int) -> bool:
    return word[i] in _VOWELS or (word[i] == "y" and i > 0 and not _is_vowel(word, i - 1))


def _has_vowel(stem: str) -> bool:
    return any(_is_vowel(stem, i) for i in range(len(stem)))


def _doubled(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and word[-1] not in _VOWELS


def _short(word: str) -> bool:
    return len(word) > 2 and not _is_vowel(word, len(word) - 3) and _is_vowel(word, len(word) - 2) and not _is_vowel(word, len(word) - 1) and word[-1] not in "wxy"


# Fixed values of the published suffix-stripping algorithm (Porter, 1980), in its order.
_STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize bli:ble alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble logi:log"
_STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"


def porter(word: str) -> str:
    """The stem of a lower-case word by Porter's published algorithm."""
    if len(word) < 3:
        return word
    if (word.endswith("sses") and len(word) > 4) or (word.endswith("ies") and len(word) > 3):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed") and len(word) > 3:
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        for end in ("ed", "ing"):
            if word.endswith(end):
                if _has_vowel(word[: -len(end)]):
                    word = word[: -len(end)]
                    if word.endswith(("at", "bl", "iz")):
                        word += "e"
                    elif _doubled(word) and word[-1] not in "lsz":
                        word = word[:-1]
                    elif _measure(word) == 1 and _short(word):
                        word += "e"
                break
    if word.endswith("y") and _has_vowel(word[:-1]):
        word = word[:-1] + "i"
    for table in (_STEP2, _STEP3):
        pairs = sorted((x.split(":") for x in table.split()), key=lambda p: -len(p[0]))
        for old, new in pairs:
            if word.endswith(old):
                if _measure(word[: -len(old)]) > 0:
                    word = word[: -len(old)] + new
                break
    for end in sorted(_STEP4.split(), key=len, reverse=True):
        if word.endswith(end):
            left = word[: -len(end)]
            if _measure(left) > 1 and (end != "ion" or left[-1:] in ("s", "t")):
                word = left
            break
    if word.endswith("e"):
        left = word[:-1]
        if _measure(left) > 1 or (_measure(left) == 1 and not _short(left)):
            word = left
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


# The combining marks that the full-text engine drops within a word. All others end a word.
DROPPED_MARKS = (0x300, 0x301, 0x302, 0x303, 0x304, 0x306, 0x307, 0x308, 0x309, 0x30A, 0x30B, 0x30C, 0x30F, 0x311, 0x31B, 0x323, 0x324, 0x325, 0x326, 0x327, 0x328, 0x32D, 0x32E, 0x330, 0x331)
_DROPPED = frozenset(map(chr, DROPPED_MARKS))


@functools.lru_cache(maxsize=1 << 16)
def _engine_letter(c: str) -> str | None:
    """A character as the full-text engine has it: a letter or digit of a word, nothing, or null where a word ends.

    Simple case folding; a Latin letter with one mark loses it, one with two keeps both.
    """
    if c in _DROPPED:
        return ""
    if unicodedata.category(c)[0] not in "LN" and unicodedata.category(c) != "Co":
        return None
    low = next((x for x in (c.casefold(), c.lower()) if len(x) == 1), c.lower()[0])
    parts = unicodedata.decomposition(low).split(" ")
    if len(parts) == 2 and parts[0][0] != "<" and unicodedata.combining(chr(int(parts[1], 16))) and int(parts[0], 16) < 128:
        return chr(int(parts[0], 16))
    return low


def engine_words(text: str) -> list[str]:
    """A text's words as the full-text engine splits and folds them, before they are stemmed.

    Characters that Unicode has assigned since the engine's tables (2012) count by today's tables.
    """
    if text.isascii():
        return re.findall("[a-z0-9]+", text.lower())
    out: list[str] = []
    inside = False
    for c in text:
        letter = _engine_letter(c)
        if letter is None or (letter == "" and not inside):  # a mark begins no word
            inside = False
        elif inside:
            out[-1] += letter
        else:
            out.append(letter)
            inside = True
    return out


def engine_stem(word: str) -> str:
    """The stem of a word of 3 to 64 bytes, each byte a letter; others stay."""
    data = word.encode()
    return porter(data.decode("latin-1")).encode("latin-1").decode("utf-8", "replace") if 3 <= len(data) <= 64 else word


@F.pandas_udf(T.ArrayType(T.StringType()))
def porter_tokens(texts: pd.Series) -> pd.Series:
    """Stems of a text's words in order, as the full-text engine has them."""
    known: dict[str, str] = {}

    def stems(text: str | None) -> list[str]:
        words = engine_words(text or "")
        if len(known) > 1 << 18:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = engine_stem(w)
        return [known[w] for w in words]

    return texts.map(stems)


@F.pandas_udf(T.StringType())
def folded(texts: pd.Series) -> pd.Series:
    """Compatibility composition (NFKC)."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(T.StringType())
def unescaped(texts: pd.Series) -> pd.Series:
    """Character references decoded."""
    return texts.map(lambda t: None if t is None else html.unescape(t))


@F.pandas_udf(T.DoubleType())
def best_ratio(sentence: pd.Series, others: pd.Series) -> pd.Series:
    """The greatest matching-blocks ratio of a sentence with any of an array of others; 0 without any."""
    return pd.Series([max((difflib.SequenceMatcher(None, a or "", b or "", autojunk=True).ratio() for b in (bs if bs is not None else [])), default=0.0) for a, bs in zip(sentence, others, strict=True)])


def _near(a: str, b: str, least: float) -> float:
    """The matching-blocks ratio if it reaches `least`, else 0: lengths and counts of characters rule most pairs out."""
    whole = len(a) + len(b)
    if whole and (2.0 * min(len(a), len(b)) / whole < least or 2.0 * sum((Counter(a) & Counter(b)).values()) / whole < least):
        return 0.0
    ratio = difflib.SequenceMatcher(None, a, b, autojunk=True).ratio()
    return ratio if ratio >= least else 0.0


def near_ratio(sentence: Column, others: Column, least: float) -> Column:
    """As best_ratio() where that reaches `least`; 0 elsewhere."""

    @F.pandas_udf(T.DoubleType())
    def near(sentence: pd.Series, others: pd.Series) -> pd.Series:
        return pd.Series([max((_near(a or "", b or "", least) for b in (bs if bs is not None else [])), default=0.0) for a, bs in zip(sentence, others, strict=True)])

    return near(sentence, others)


#: Fixed names: where a row's keywords come from, in order.
KEYWORD_NAMES = ("keywords", "extra_keywords", "retrieval_terms", "terms", "synonyms", "query_plan", "raw_content")
_WORDS = T.ArrayType(T.StringType())
_OBLIGATION = T.StructType([T.StructField(n, _WORDS if n in ("draft_anchor_ids", "missing_or_weak_dimensions") else T.StringType()) for n in ("id", "requirement", "kind", "draft_anchor_ids", "coverage", "missing_or_weak_dimensions")])
OBLIGATIONS = T.StructType([T.StructField("valid", T.ArrayType(_OBLIGATION)), T.StructField("reasons", _WORDS)])


def flat_terms(value: object) -> list[str]:
    """All non-blank strings of nested lists and objects, in order, however deep they are nested."""
    out, open_ = [], [value]
    while open_:
        x = open_.pop()
        if isinstance(x, str):
            out += [x.strip()] if x.strip() else []
        elif isinstance(x, (list, dict)):
            open_ += reversed(x if isinstance(x, list) else list(x.values()))
    return out


def _object(text: str | None) -> dict:
    """A JSON object; anything else, and what is nested deeper than the parser goes, is an empty one."""
    try:
        value = json.loads(text or "")
    except (ValueError, RecursionError):
        return {}
    return value if isinstance(value, dict) else {}


@F.pandas_udf(T.StringType())
def keyword_string(rows: pd.Series) -> pd.Series:
    """The terms of a JSON row's keyword fields, without regard to case each once, joined by spaces: at most 4,000 characters."""

    def joined(text: str | None) -> str:
        unique: dict[str, str] = {}
        for term in flat_terms([_object(text).get(name) for name in KEYWORD_NAMES]):
            unique.setdefault(term.casefold(), term)
        return " ".join(unique.values())[:4000]

    return rows.map(joined)


def checked_obligations(payload: dict, known: set[str]) -> tuple[list[dict], list[str]]:
    """The valid obligations and why others are not: no object, or an id that is blank or repeated or a blank requirement."""
    raw = payload.get("obligations")
    if not isinstance(raw, list):
        return [], ["obligations_not_list"]
    text = lambda x: str(x or "").strip()
    valid: dict[str, dict] = {}
    reasons = []
    for i, item in enumerate(raw, 1):
        if not isinstance(item, dict):
            reasons.append(f"obligation_{i}_not_object")
            continue
        name, requirement = text(item.get("id")), text(item.get("requirement"))
        if not name or name in valid or not requirement:
            reasons.append(f"obligation_{i}_invalid_identity")
            continue
        ids = [str(x).strip() for x in item.get("draft_anchor_ids") or []]
        weak = [str(x).strip() for x in item.get("missing_or_weak_dimensions") or []]
        valid[name] = {"id": name, "requirement": requirement, "kind": text(item.get("kind")), "draft_anchor_ids": [x for x in ids if x in known], "coverage": text(item.get("coverage")), "missing_or_weak_dimensions": [x for x in weak if x]}
    return list(valid.values()), reasons if valid else [*reasons, "no_valid_obligations"]


@F.pandas_udf(OBLIGATIONS)
def obligations(payloads: pd.Series, anchor_ids: pd.Series) -> pd.DataFrame:
    """checked_obligations() of a JSON payload and the array of its answer's anchors."""
    found = [checked_obligations(_object(p), set(() if a is None else a)) for p, a in zip(payloads, anchor_ids, strict=True)]
    return pd.DataFrame(found, columns=["valid", "reasons"])


@F.pandas_udf(T.StringType())
def yaml_object(texts: pd.Series) -> pd.Series:
    """The object of a YAML text as JSON, for model texts that are no JSON; null if it is none, or without a YAML parser."""
    try:
        import yaml
    except ImportError:
        return pd.Series([None] * len(texts), dtype=object)

    def one(text: str | None) -> str | None:
        try:
            found = yaml.safe_load(text) if text else None
        except (yaml.YAMLError, ValueError, RecursionError):  # a date that is none is a ValueError
            return None
        try:
            return json.dumps(found, ensure_ascii=False, default=str) if isinstance(found, dict) else None
        except (TypeError, ValueError, RecursionError):  # a key that JSON has none for, or an object within itself
            return None

    return texts.map(one)
