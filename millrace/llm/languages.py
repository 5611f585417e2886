"""Language of prose by function words and script: enough to tell which of a few languages a sentence is written in.

Only words without content of their own are listed (articles, pronouns, prepositions, conjunctions, auxiliaries, quantity words), so
the lists hold for any subject. `own_share` needs no list of the other language: prose in any language, listed or not, lacks the
function words of a language it is not written in.
"""

from __future__ import annotations

import re
import unicodedata

from millrace.functions.words import WORD, normalise

#: Frequent function words of each language.
FUNCTION_WORDS = {
    "en": "i a t m ll ve re won can don didn doesn isn please the of and to in is that it for as with was on are by this be at from or an have has had not but they which you we one all were there their been if more when will would who so no what up its about into than them only other some could these those two may then do does did any my now such like our over even most after also many before must through where your because each just how too between own against under while during without within since until once both few per whether let us hence thus therefore near given he she her his him me should",
    "de": "der die das und zu in den von mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei wir ihr ihre ihm ihn diese dieser dieses jede jeder jedes kein keine welche welcher viele viel wenn dann danach damit also weil zuerst später davon hinzu genau zwischen unter gegen ohne ich du uns insgesamt somit daher muss kann soll darf mir mich dir dich",
    "fr": "le la les de des du un une et à en est que qui dans pour pas sur au aux avec ce se ne par plus il elle ils elles son sa ses leur leurs on nous vous je mais ou où donc or ni car cette ces cet comme tout tous toute toutes être sont été fait peut deux chaque combien quel quelle quels quelles puis ensuite ainsi encore sans sous entre vers chez après avant d'abord seulement très même aussi si l d n s c qu j m y dois suis",
    "es": "el la los las de del un una unos unas y a en que es se no por con para su sus al lo como más pero o este esta estos estas ese esa aquel aquella cada cuántas cuántos cuántas qué cuál cuáles son fue ha han hay ser está están entre sin sobre hasta hacia tras desde donde cuando porque también muy ya todo todos todas le les me nos mi tu si así por tanto luego después primero entonces todavía junto ella ellos fueron siendo puede tiene dos tres",
    "pt": "o a os as de do da dos das um uma uns umas e em no na nos nas que é se não por com para seu sua seus suas ao aos à às como mais mas ou este esta esse essa isso aquela cada quantos quantas qual quais são foi há ser está estão entre sem sobre até desde onde quando porque também muito já todo todos toda todas lhe me minha meu assim portanto logo depois primeiro então temos ainda pelo pela tem pode ela eles dois três",
    "it": "il lo la i gli le del dello dei delle un una uno e a in che è si non per con su al alla come più ma o questo questa ogni quanti quante quale sono stato ha hanno essere tra senza dove quando perché anche molto già tutto tutti quindi poi prima allora ancora di da nel nella mi",
    "nl": "de het een en van in is dat op te voor met zijn niet aan er om ook als bij door naar uit over maar dan nog wel kan heeft hebben wordt worden deze dit elke hoeveel welke daarna dus ik je we ze",
    "pl": "i w na z do nie się to że jest o jak po za od przez dla ale czy co ten ta te tego tej są być był była było ma mają który która które lub albo oraz więc jeśli gdy bardzo już tylko każdy każda każde ile jaki jaka przy między pod nad bez też także potem następnie najpierw teraz tak jego jej ich",
    "ru": "и в не на что с по как из у за к от но о же так для это он она они мы вы я был была было были есть быть если то или также все всех его её их при до без под над после между затем сначала каждый сколько какой чему пусть",
}
LANGUAGES = tuple([*FUNCTION_WORDS, "zh"])
_weights: dict[str, list[tuple[str, float]]] = {}
for _language, _list in FUNCTION_WORDS.items():
    for _word in set(_list.split()):
        _weights.setdefault(_word, []).append((_language, 1.0))
for _word, _owners in _weights.items():
    _weights[_word] = [(language, 1.0 / len(_owners) ** 1.5) for language, _ in _owners]

#: Scripts that by themselves tell one of the listed languages.
SCRIPT_LANGUAGES = {"CYRILLIC": "ru", "CJK": "zh"}
SPLIT = re.compile(r"(?<=[.!?;:。！？；])\s+|\n+|(?<=[。！？；])")
MARKS = {
    "ł": "pl",
    "ż": "pl",
    "ą": "pl",
    "ę": "pl",
    "ś": "pl",
    "ß": "de",
    "ä": "de",
    "ñ": "es",
    "¿": "es",
    "¡": "es",
    "ã": "pt",
    "õ": "pt",
    "ê": "fr",
    "è": "fr",
    "û": "fr",
    "œ": "fr",
    "ù": "fr",
    "ö": "de",
    "ü": "de",
    "ç": "fr",
    "à": "fr",
}


_scripts: dict[str, str] = {}


def main_script(text: str) -> str | None:
    """Script of most letters by the first word of their Unicode names (kana and hanzi apart); null without letters."""
    if text.isascii():
        return "LATIN" if any(ch.isalpha() for ch in text) else None
    counts: dict[str, int] = {}
    for ch in text:
        if ch.isalpha():
            script = _scripts.get(ch)
            if script is None:
                script = _scripts[ch] = unicodedata.name(ch, "OTHER").split(" ")[0]
            # a hanzi says as much as two letters
            counts[script] = counts.get(script, 0) + 1 + (script == "CJK")
    if "HIRAGANA" in counts or "KATAKANA" in counts:
        kana = counts.pop("HIRAGANA", 0) + counts.pop("KATAKANA", 0)
        counts["KANA"] = kana + counts.pop("CJK", 0)
    return max(counts, key=lambda k: (counts[k], k)) if counts else None


_lists = {language: frozenset(held.split()) for language, held in FUNCTION_WORDS.items()}


def own_share(words: list[str], language: str | None) -> float | None:
    """Share of the words (of two letters and more, no digits) that are function words of a listed language; null for few words."""
    spoken = [w for w in words if len(w) > 1 and not w[0].isdigit()]
    if language not in _lists or len(spoken) < 8:
        return None
    return sum(w in _lists[language] for w in spoken) / len(spoken)


def sentence_language(sentence: str, favoured: str | None = None) -> tuple[str | None, int]:
    """Language and number of words; null where nothing tells. Chinese counts characters, two to a word.

    The favoured language wins if it scores nearly as much as the best.
    """
    text = normalise(sentence)
    tokens = WORD.findall(text)
    letters = [w for w in tokens if not w[0].isdigit()]
    if not letters:
        return None, 0
    script = main_script(text)
    if script not in (None, "LATIN"):
        return SCRIPT_LANGUAGES.get(script, script.lower()), max(1, sum(map(len, letters)) // 2) if script == "CJK" else len(letters)
    score: dict[str, float] = {}
    for w in letters:
        for language, weight in _weights.get(w, ()):
            score[language] = score.get(language, 0.0) + weight
    if not text.isascii():
        for ch in set(text):
            if ch in MARKS:
                score[MARKS[ch]] = score.get(MARKS[ch], 0.0) + 0.4
    if not score:
        return None, len(letters)
    best = max(score, key=lambda k: (score[k], k))
    if favoured in score and score[favoured] >= 0.75 * score[best]:
        best = favoured
    return best, len(letters)


def language_words(text: str, favoured: str | None = None) -> tuple[dict[str, int], dict[str, int]]:
    """Words and sentences by language, over the sentences whose language shows."""
    counts: dict[str, int] = {}
    sentences: dict[str, int] = {}
    for sentence in SPLIT.split(text):
        language, n = sentence_language(sentence, favoured)
        if language and n >= 2:
            counts[language] = counts.get(language, 0) + n
            sentences[language] = sentences.get(language, 0) + 1
    return counts, sentences


def main_language(text: str) -> str | None:
    """The language of most words; null where none shows."""
    counts: dict[str, float] = {}
    for sentence in SPLIT.split(text):
        language, n = sentence_language(sentence)
        if language and n >= 2:
            counts[language] = counts.get(language, 0) + n
    if len(counts) > 1:  # sentences that fit several languages go with the text
        best = max(counts, key=lambda k: (counts[k], k))
        counts = dict(language_words(text, best)[0])
    return max(counts, key=lambda k: (counts[k], k)) if counts else None
