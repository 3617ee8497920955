"""D17, statistical: a function-word vote over the languages of the posts.

Every word of a text votes for the languages in whose list it stands, with its weight
divided among them; the language with the most votes wins if it leads by the margin. The lists
are ordinary function words, in lower case and also without accents, so the vote
reads raw and cleaned texts alike. It is row-local: the words are counted by the set of
languages they belong to, without exploding a text or shuffling it.
"""
from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from fansignal.functions.common import let

# Common function words; a word of several lists counts a share for each.
FUNCTION_WORDS = {
    "en": "the of and to in is that was for it with as on at by this are from or be not have which they were than",
    "fr": "le la les des du un une et est dans que qui pour pas au aux ce cette ne se sur il elle avec sont mais ou",
    "de": "der die das und ist nicht ein eine zu den dem mit von auf für im sich auch es an werden wie bei oder ich aber",
    "es": "el la los las de del un una y es en que por para con no se lo su al como más pero sus o este está son",
}


def _plain(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))


def shared_words(lists: dict[str, str] | None = None) -> dict[tuple[str, ...], list[str]]:
    """Set of languages -> the words that exactly these languages share."""
    owners: dict[str, set[str]] = {}
    for lang, words in (lists or FUNCTION_WORDS).items():
        for w in words.split():
            for form in {w, _plain(w)}:
                owners.setdefault(form, set()).add(lang)
    out: dict[tuple[str, ...], list[str]] = {}
    for w, langs in sorted(owners.items()):
        out.setdefault(tuple(sorted(langs)), []).append(w)
    return out


def _is_one_of(words: list[str]):
    return lambda t: t.isin(words)


def language_votes(text: Column, lists: dict[str, str] | None = None) -> Column:
    """array<struct<votes, lang>>: the votes of each language, best first (ties: later name first)."""
    lists = lists or FUNCTION_WORDS
    groups = shared_words(lists)
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\p{L}+"), F.lit(0))

    def count(tokens):
        n = {langs: F.size(F.filter(tokens, _is_one_of(ws))) for langs, ws in groups.items()}
        rows = []
        for lang in sorted(lists):
            parts = [n[g] / F.lit(float(len(g))) for g in groups if lang in g]
            rows.append(F.struct(reduce(lambda a, b: a + b, parts).alias("votes"), F.lit(lang).alias("lang")))
        return F.sort_array(F.array(*rows), asc=False)
    return let(words, count)


def detect_by_vote(text: Column, margin: float = 1.0, lists: dict[str, str] | None = None) -> Column:
    """The winning language, or 'unknown' where no language leads by ``margin`` votes."""
    def pick(v):
        second = F.coalesce(F.try_element_at(v, F.lit(2))["votes"], F.lit(0.0))
        return F.when(v[0]["votes"] - second >= margin, v[0]["lang"]).otherwise("unknown")
    return let(language_votes(text, lists), pick)
