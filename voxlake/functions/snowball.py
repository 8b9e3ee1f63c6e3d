"""The published Snowball stemmer for Spanish."""

from __future__ import annotations

import functools

VOWELS = frozenset("aeiouáéíóúü")
PLAIN = str.maketrans("áéíóú", "aeiou")

# The published algorithm's endings.
PRONOUNS = "me se sela selo selas selos la le lo las les los nos".split()
BEFORE_PRONOUN = "iéndo ándo ár ér ír iendo ando ar er ir yendo".split()
STANDARD = {
    "delete": "anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos".split(),
    "ic": "adora ador ación adoras adores aciones acion ante antes ancia ancias".split(),
    "log": "logía logías".split(),
    "u": "ución uciones ucion".split(),
    "ente": "encia encias".split(),
    "amente": ["amente"],
    "mente": ["mente"],
    "idad": "idad idades".split(),
    "iva": "iva ivo ivas ivos".split(),
}
Y_VERBS = "ya ye yan yen yeron yendo yo yó yas yes yais yamos".split()
GU_VERBS = "en es éis emos".split()
VERBS = (
    "arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré irían irías irán irás iríais iría iréis iríamos iremos irá iré "
    "aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais "
    "arais ierais aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos"
).split()
RESIDUAL = "os a o á í ó e é".split()

KIND = {s: kind for kind, endings in STANDARD.items() for s in endings}


def _after_vowel(word: str, start: int) -> int:
    """Behind the first consonant that follows a vowel."""
    for k in range(start + 1, len(word)):
        if word[k] not in VOWELS and word[k - 1] in VOWELS:
            return k + 1
    return len(word)


def _verb_region(word: str) -> int:
    if len(word) < 3:
        return len(word)
    if word[1] not in VOWELS:
        return next((k + 1 for k in range(2, len(word)) if word[k] in VOWELS), len(word))
    if word[0] in VOWELS:
        return next((k + 1 for k in range(2, len(word)) if word[k] not in VOWELS), len(word))
    return 3


def _longest(word: str, endings, least: int = 0) -> str | None:
    """The longest ending of word that begins at least or later."""
    return max((s for s in endings if word.endswith(s) and len(word) - len(s) >= least), key=len, default=None)


def _drop(word: str, ending: str, region: int) -> str:
    return word[: -len(ending)] if word.endswith(ending) and len(word) - len(ending) >= region else word


def _standard(word: str, r1: int, r2: int) -> str:
    ending = _longest(word, KIND)
    if ending is None:
        return word
    kind, at = KIND[ending], len(word) - len(ending)
    if at < (r1 if kind == "amente" else r2):
        return word
    base = word[:at]
    if kind in ("log", "u", "ente"):
        return base + kind
    if kind == "ic":
        return _drop(base, "ic", r2)
    if kind == "amente":
        shorter = _drop(base, "iv", r2)
        if shorter != base:
            return _drop(shorter, "at", r2)
        before = next((x for x in ("os", "ic", "ad") if base.endswith(x)), "")
        return _drop(base, before, r2) if before else base
    more = {"mente": ("ante", "able", "ible"), "idad": ("abil", "ic", "iv"), "iva": ("at",)}.get(kind, ())
    before = next((x for x in more if base.endswith(x)), "")
    return _drop(base, before, r2) if before else base


def _verbs(word: str, rv: int) -> str:
    ending = _longest(word, Y_VERBS, rv)
    if ending and word[: -len(ending)].endswith("u"):
        return word[: -len(ending)]
    ending = _longest(word, [*VERBS, *GU_VERBS], rv)
    if ending is None:
        return word
    base = word[: -len(ending)]
    return base[:-1] if ending in GU_VERBS and base.endswith("gu") else base


@functools.lru_cache(100_000)
def stem(word: str) -> str:
    """The stem of a word; lower-cased."""
    word = word.lower()
    r1 = _after_vowel(word, 0)
    r2 = _after_vowel(word, r1)
    rv = _verb_region(word)
    pronoun = _longest(word, PRONOUNS, rv)
    if pronoun:
        base = word[: -len(pronoun)]
        before = _longest(base, BEFORE_PRONOUN, rv)
        if before and (before != "yendo" or base[: -len(before)].endswith("u")):
            word = base[: -len(before)] + (before.translate(PLAIN) if before in ("iéndo", "ándo", "ár", "ér", "ír") else before)
    done = _standard(word, r1, r2)
    if done == word:
        done = _verbs(word, rv)
    word = done
    ending = _longest(word, RESIDUAL, rv)
    if ending:
        word = word[: -len(ending)]
        if ending in ("e", "é") and word.endswith("gu") and len(word) - 1 >= rv:
            word = word[:-1]
    return word.translate(PLAIN)
